"""Streams: tailing by executors, keyed state against the batch forms, restarts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from memlattice.operators import lifecycle, writes
from memlattice.streaming import keyed
from memlattice.streaming.tail import SessionTail, TailReader


@pytest.fixture(autouse=True)
def provider(spark):
    spark.conf.set(*keyed.PROVIDER)
    yield
    spark.conf.unset(keyed.PROVIDER[0])


def lines(reader, start, end):
    return [v for p in reader.partitions(start, end) for _, v in reader.read(p)]


def test_tail_offsets(tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    path = str(logs / "a.jsonl")
    (logs / "a.jsonl").write_text("old\n")
    (logs / "x.txt").write_text("not a session\n")
    reader = lambda place="p", **o: TailReader({"dirs": str(logs), "positions": str(tmp_path / place), "quiet": "0", **o})
    with pytest.raises(ValueError):
        TailReader({"dirs": str(logs)})
    start = reader().initialOffset()
    assert start == {path: 4}  # from the end
    with open(path, "a") as f:
        f.write("one\n\ntwo\nhalf")
    end = reader().latestOffset()
    assert end == {path: 13} and lines(reader(), start, end) == ["one", "two"] and reader().latestOffset() == end
    assert lines(reader(split="3"), start, end) == ["one", "two"]  # a line belongs to the range in which it begins
    (logs / "b.jsonl").write_text("new file\n")
    (logs / "a.jsonl").write_text("cut\n")  # shorter: from the beginning
    then = reader().latestOffset()
    assert sorted(lines(reader(), end, then)) == ["cut", "new file"] and reader().initialOffset() == start
    assert reader("q", quiet="1000", start="beginning").latestOffset() == {path: 0, str(logs / "b.jsonl"): 0}  # not quiet: later
    (logs / "b.jsonl").unlink()
    assert lines(reader(), end, then) == ["cut"]


def test_tail_takes_twenty_lines_a_poll_and_loses_none(tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    for name, n in (("a", 33), ("b", 12), ("c", 0)):
        (logs / f"{name}.jsonl").write_text("".join(f"{name}{i}\n" for i in range(n)))
    options = {"dirs": str(logs), "positions": str(tmp_path / "p"), "quiet": "0", "start": "beginning"}
    at, got, polls = TailReader(options).initialOffset(), [], []
    while True:
        end = TailReader(options).latestOffset()  # a new reader at each poll, as after a restart
        if end == at:
            break
        new = lines(TailReader(options), at, end)
        got, at = got + new, end
        polls.append(len(new))
    assert polls == [20, 20, 5] and sorted(got) == sorted([f"a{i}" for i in range(33)] + [f"b{i}" for i in range(12)])
    whole = TailReader({**options, "positions": str(tmp_path / "q"), "lines": "0"})
    assert len(lines(whole, whole.initialOffset(), whole.latestOffset())) == 45


def test_tail_is_read_in_partitions_and_goes_on_after_a_restart(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    for i in range(6):
        (logs / f"{i}.jsonl").write_text("".join(f"{i}-{j}\n" for j in range(5)))
    spark.dataSource.register(SessionTail)

    def run():
        stream = spark.readStream.format("session_tail").option("dirs", str(logs)).option("positions", str(tmp_path / "p")).option("quiet", "0").option("start", "beginning").load()
        query = stream.withColumn("part", F.spark_partition_id()).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).start()
        query.processAllAvailable()
        query.stop()

    run()
    with open(logs / "3.jsonl", "a") as f:
        f.write("3-5\n3-6")
    (logs / "4.jsonl").write_text("again\n")  # written while no query ran
    run()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["value"] for r in out.collect()) == sorted([f"{i}-{j}" for i in range(6) for j in range(5)] + ["3-5", "again"])
    assert out.select("part").distinct().count() > 1


START = dt.datetime(2026, 1, 5, 23, 50)


def feed(spark, folder, rows, schema, lots):
    """The rows dealt into lots, a file for each, so that each is a batch."""
    for k in range(lots):
        spark.createDataFrame(rows[k::lots], schema).coalesce(1).write.mode("append").parquet(folder)


def drain(stream, out, checkpoint):
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination(300)


def in_two_runs(spark, tmp_path, rows, schema, made, flush):
    """What a stream tells of shuffled rows, stopped in between and restarted from its checkpoint; `flush` lets the watermark pass all."""
    random.Random(5).shuffle(rows)
    folder, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")
    stream = lambda: made(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder))
    half = len(rows) // 2
    feed(spark, folder, rows[:half], schema, 2)
    drain(stream(), out, checkpoint)
    feed(spark, folder, rows[half:], schema, 2)
    feed(spark, folder, flush, schema, 1)
    drain(stream(), out, checkpoint)
    return spark.read.parquet(out)


def test_quotas_of_a_shuffled_stream_equal_the_batch(spark, tmp_path):
    rng = random.Random(3)
    schema = "ns string, kind string, ts timestamp, key long"
    kinds = ["write", "search", "backup", "other"]
    rows = [(rng.choice(["a", "b", None]), rng.choice(kinds), START + dt.timedelta(seconds=rng.randrange(1200), microseconds=rng.choice([0, 0, 500])), i) for i in range(240)]
    rows += [("a", "search", START, 1000 + i) for i in range(5)]  # ties in time
    limits = {"write": 20, "search": 1, "profile": 0, "backup": 0}
    flush = [("z", "other", START + dt.timedelta(days=3), -1)]
    got = in_two_runs(spark, tmp_path, rows, schema, lambda s: keyed.admit(s, limits, "2 hours"), flush).filter("key >= 0")
    want = writes.admit(spark.createDataFrame(rows, schema), limits)
    both = lambda df: sorted((r["key"], r["admitted"]) for r in df.select("key", "admitted").collect())
    assert both(got) == both(want) and got.filter("not admitted").count() > 50
    told = {r["key"]: r for r in got.collect()}
    for ns, kind, ts, key in rows:
        r = told[key]
        if r["admitted"]:
            assert r["retry_after"] == 0
        else:
            at = ts.hour * 3600 + ts.minute * 60 + ts.second
            assert r["retry_after"] == {"write": 86400 - at, "search": 60 - at % 60, "backup": 3600 - at % 3600}[kind]


def test_phases_of_a_shuffled_stream_equal_the_batch_and_a_loop(spark, tmp_path):
    rng = random.Random(4)
    schema = "phase string, ns string, ts timestamp, key long, cursor string, items int"
    rows = []
    for i in range(200):
        t = rng.randrange(3600)
        cursor = rng.choice([None, "", f"2026-01-{1 + t // 400:02d}", f"2026-01-{1 + t // 400:02d}T{i % 24:02d}"])
        rows.append((rng.choice(["consolidate", "decay", "graph"]), rng.choice(["a", "b"]), START + dt.timedelta(seconds=t), i, cursor, rng.choice([None, 1, 2])))
    want, state = {}, {}
    for phase, ns, ts, key, cursor, items in sorted(rows, key=lambda r: (r[2], r[3])):
        last, held, runs, done = state.get((phase, ns), (None, "", 0, 0))
        wait = {"consolidate": 0, "decay": 60, "graph": 90}[phase]
        if not cursor:
            told = "empty"
        elif runs and cursor <= held:
            told = "behind"
        elif runs and (ts - last).total_seconds() < wait:
            told = "early"
        else:
            told, state[phase, ns] = "ok", (ts, cursor, runs + 1, done + (items or 0))
        now = state.get((phase, ns), (None, None, 0, 0))
        want[key] = (told, *now[1:])
    told = lambda df: {r["key"]: (r["told"], r["cursor"], r["runs"], r["items"]) for r in df.collect()}
    batch = told(lifecycle.phase_updates(spark.createDataFrame(rows, schema), {"graph": 90}))
    assert batch == want and {v[0] for v in want.values()} == {"empty", "behind", "early", "ok"}
    flush = [("none", "z", START + dt.timedelta(days=1), -1, "x", 0)]
    got = in_two_runs(spark, tmp_path, rows, schema, lambda s: keyed.phase_updates(s, {"graph": 90}, "2 hours"), flush)
    assert told(got.filter("key >= 0")) == want
    empty = lifecycle.phase_updates(spark.createDataFrame([], schema))
    assert empty.collect() == []


def test_keyed_state_asks_for_its_provider(spark, tmp_path):
    spark.conf.unset(keyed.PROVIDER[0])
    with pytest.raises(ValueError):
        keyed.admit(spark.readStream.schema("ns string, kind string, ts timestamp, key long").parquet(str(tmp_path)))
