"""Writes as old state -> new state: folding duplicates, superseding, decay, evolution, quotas, retention."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.temporal import closing_time, valid_at

#: Seconds that lie at least between two runs of a phase, and of any other phase.
COOLDOWN, OTHER_PHASES = {"consolidate": 0, "decay": 60}, 300
#: Requests of a kind that a namespace has in a window.
QUOTAS = {"write": 10_000, "search": 600, "profile": 10, "backup": 12}


def fold_exact(batch: DataFrame) -> DataFrame:
    """One row for each content id: largest importance, the number of further arrivals, first tags that aren't empty.

    batch(key, content, importance, confidence, tags); arrival is by key.
    """
    order = F.struct("key")
    return batch.groupBy(T.content_id(F.col("content")).alias("id")).agg(
        F.max("importance").alias("importance"),
        F.max(F.greatest("confidence", F.lit(0.8))).alias("confidence"),
        (F.count(F.lit(1)) - 1).alias("recall_count"),
        F.min("key").alias("first_key"),
        F.min_by("tags", F.when(F.size("tags") > 0, order)).alias("tags"),
    )


def supersede_status(requests: DataFrame, memories: DataFrame) -> DataFrame:
    """(key, target, status): 409 for itself or a row that is superseded, 404 for none, 403 for another namespace, else 200."""
    t = memories.select(F.col("key").alias("target"), F.col("namespace").alias("t_ns"), F.col("superseded_by").alias("t_by"))
    out = requests.join(t, "target", "left")
    status = F.when(F.col("key") == F.col("target"), 409).when(F.col("t_ns").isNull(), 404).when(F.col("t_ns") != F.col("namespace"), 403).when(F.col("t_by").isNotNull(), 409).otherwise(200)
    return out.select("key", "target", status.alias("status"))


def apply_supersede(memories: DataFrame, pairs: DataFrame, now: str) -> DataFrame:
    """Rows that a pair (old, new) names get superseded_by, the cold tier and a closed interval."""
    new = memories.select(F.col("key").alias("new"), F.col("valid_from").alias("new_from"))
    p = pairs.join(new, "new").select(F.col("old").alias("key"), "new", "new_from")
    out = memories.join(p, "key", "left")
    hit = F.col("new").isNotNull()
    return out.withColumn("superseded_by", F.when(hit, F.col("new").cast("string")).otherwise(F.col("superseded_by"))).withColumn("tier", F.when(hit, "cold").otherwise(F.col("tier"))).withColumn("valid_to", F.when(hit, closing_time(F.col("valid_to"), F.col("new_from"), now)).otherwise(F.col("valid_to"))).drop("new", "new_from")


def decay_step(memories: DataFrame) -> DataFrame:
    """Hot and warm rows decay by 5 % down to .1; rarely recalled ones at or under .1 turn cold."""
    live = F.col("tier").isin("hot", "warm")
    new = F.when(live & (F.col("decay") > 0.1), F.round(F.col("decay") * 0.95, 4)).otherwise(F.col("decay"))
    cold = live & (new <= 0.1) & (F.col("recall_count") < 3)
    return memories.withColumn("new_decay", new).withColumn("new_tier", F.when(cold, "cold").otherwise(F.col("tier")))


def quota_admission(requests: DataFrame, limits: dict[str, int] | int, window: str) -> DataFrame:
    """requests(ns, kind, ts, key) with the window, the place in it and whether it is admitted; denied ones don't count."""
    start = F.window("ts", window)
    w = Window.partitionBy("ns", "kind", "window_start").orderBy("ts", "key")
    limit = F.lit(limits) if isinstance(limits, int) else F.element_at(F.create_map(*(F.lit(x) for kv in limits.items() for x in kv)), F.col("kind"))
    out = requests.withColumn("window_start", start["start"]).withColumn("window_end", start["end"]).withColumn("place", F.row_number().over(w))
    return out.withColumn("admitted", F.col("place") <= limit).withColumn("retry_after", F.when(~F.col("admitted"), F.unix_timestamp("window_end") - F.unix_timestamp("ts")).otherwise(0))


def cooldown(runs: DataFrame, seconds: int) -> DataFrame:
    """runs(phase, ns, ts, key) with whether the run before is at least so long ago."""
    w = Window.partitionBy("phase", "ns").orderBy("ts", "key")
    gap = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(w))
    return runs.withColumn("allowed", F.coalesce(gap >= seconds, F.lit(True)))


def backups_to_keep(backups: DataFrame, keep: dict[str, int] | None = None) -> DataFrame:
    """backups(day) with tier (monthly, weekly or daily) and whether it is among the newest of its tier."""
    keep = keep or {"daily": 7, "weekly": 4, "monthly": 3}
    tier = F.when(F.dayofmonth("day") == 1, "monthly").when(F.dayofweek("day") == 2, "weekly").otherwise("daily")
    limit = F.element_at(F.create_map(*(F.lit(x) for kv in keep.items() for x in kv)), F.col("tier"))
    return backups.withColumn("tier", tier).withColumn("n", F.row_number().over(Window.partitionBy("tier").orderBy(F.desc("day")))).withColumn("kept", F.col("n") <= limit).drop("n")


def observe_cursor(memories: DataFrame, since: str, limit: int = 200) -> DataFrame:
    """The next unconsolidated observations after a cursor."""
    w = F.col("category") == "observation"
    return memories.filter((F.col("created_at") > since) & (w | F.col("category").isNull())).orderBy("created_at", "key").limit(limit)


def profile(memories: DataFrame, now: str, as_of: str | None = None, static: int = 12, dynamic: int = 15) -> DataFrame:
    """memories with part, kind and n: the first static and dynamic rows of each namespace, valid and, without as_of, not superseded.

    Static are preferences with a tag for one and rows tagged profile_static, hard rules first; dynamic are decisions,
    facts and patterns, by category or tag, that aren't insights. A row may be both.
    """
    live = memories.filter(valid_at(F.col("valid_from"), F.col("valid_to"), as_of or now))
    live = live if as_of else live.filter("superseded_by is null")
    has = lambda *names: F.coalesce(F.arrays_overlap("tags", F.array(*map(F.lit, names))), F.lit(False))
    live = live.withColumn("kind", T.kind_of(F.col("category"), F.col("tags")))
    a = live.filter(((F.col("category") == "preference") & has("hard_rule", "pref", "style")) | has("profile_static")).select("*", F.lit("static").alias("part"), has("hard_rule").alias("_top"))
    b = live.filter((F.col("category").isin("decision", "fact", "pattern") | has("decision", "fact", "pattern")) & ~has("insight", "auto_insight")).select("*", F.lit("dynamic").alias("part"), F.lit(False).alias("_top"))
    w = Window.partitionBy("namespace", "part").orderBy(F.desc("_top"), F.desc("importance"), F.desc("created_at"), "key")
    out = a.unionByName(b).withColumn("n", F.row_number().over(w))
    return out.filter(F.col("n") <= F.when(F.col("part") == "static", static).otherwise(dynamic)).drop("_top")


def recall_feedback(memories: DataFrame, recalls: DataFrame) -> DataFrame:
    """memories with the recalls(key, ts) added: recall_count grows by their number, last_recalled becomes the last one's time."""
    seen = recalls.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.max("ts").alias("_last"))
    out = memories.join(seen, "key", "left")
    return out.withColumn("recall_count", F.col("recall_count") + F.coalesce("_n", F.lit(0))).withColumn("last_recalled", F.coalesce("_last", "last_recalled")).drop("_n", "_last")


def move_namespace(tables: dict[str, DataFrame], old: str, new: str) -> dict[str, DataFrame]:
    """Memories, relations and preferences of a namespace under another name."""
    moved = F.when(F.col("namespace") == old, new).otherwise(F.col("namespace"))
    return {name: df.withColumn("namespace", moved) for name, df in tables.items()}


def decay_log(log: DataFrame, memories: DataFrame) -> DataFrame:
    """Rows of a decay log (key, ...) with their memory's namespace; of memories that are gone none."""
    return log.join(memories.select("key", "namespace"), "key")


#: Vectors without a memory that a clean-up removes at most; more are refused, as something else must be wrong.
ORPHANS = 5000


def remove_orphans(vectors: DataFrame, memories: DataFrame, most: int = ORPHANS) -> DataFrame:
    """vectors without those of no memory; raises if they are more than `most`."""
    n = vectors.join(memories.select("key"), "key", "left_anti").limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} vectors without a memory")
    return vectors.join(memories.select("key"), "key", "left_semi")


def cursor_states(runs: DataFrame) -> DataFrame:
    """runs(phase, ns, cursor, items) -> one row for each phase and namespace: last cursor, runs and items so far.

    A run counts if its cursor is over all cursors before it; runs are in order of `at`.
    """
    before = F.max("cursor").over(Window.partitionBy("phase", "ns").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    good = runs.withColumn("_b", before).filter(F.col("_b").isNull() | (F.col("cursor") > F.col("_b")))
    return good.groupBy("phase", "ns").agg(F.max("cursor").alias("cursor"), F.count(F.lit(1)).alias("runs"), F.sum("items").alias("items"))


def phase_waits(waits: dict[str, int], phase: str) -> int:
    """Seconds between two runs of a phase: the caller's, else the fixed ones."""
    return waits.get(phase, COOLDOWN.get(phase, OTHER_PHASES))


def next_phase(state: tuple | None, at: int, cursor: object, items: int | None, wait: int) -> tuple[tuple, str]:
    """((at, cursor, runs, items) after an update at `at` microseconds, what is told of it). An update that is refused changes nothing."""
    last, held, runs, done = state or (None, None, 0, 0)
    if cursor is None or cursor == "":
        return (last, held, runs, done), "empty"
    if held is not None and cursor <= held:
        return (last, held, runs, done), "behind"
    if last is not None and at - last < wait * 1_000_000:
        return (last, held, runs, done), "early"
    return (at, cursor, runs + 1, done + (items or 0)), "ok"


def phase_updates(updates: DataFrame, waits: dict[str, int] | None = None) -> DataFrame:
    """updates(phase, ns, ts, key, cursor, items), in order of ts and key, with what is told of each and cursor, runs and items after it.

    `empty`: no cursor; `behind`: not over the cursor before; `early`: sooner after the last update that counted than the phase allows
    (waits: seconds by phase, over the fixed ones); `ok`: it counts. Those refused change nothing, so each depends on all before it:
    the rows of a phase and namespace are read once, in order, and four numbers are carried along, however many they are. Rows without ts have no place in the order and are left out.
    """
    waits = waits or {}
    kind = {c: updates.schema[c].dataType.simpleString() for c in ("phase", "ns", "ts", "key", "cursor")}
    rows = updates.select("phase", "ns", "ts", "key", "cursor", F.col("items").cast("long").alias("items"), F.unix_micros(F.col("ts").cast("timestamp")).alias("_at")).filter("ts is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            phases, spaces = batch.column("phase").to_pylist(), batch.column("ns").to_pylist()
            told, cursors, runs, items = [], [], [], []
            for phase, ns, at, cursor, n in zip(phases, spaces, *(batch.column(c).to_pylist() for c in ("_at", "cursor", "items")), strict=True):
                if (phase, ns) != last:
                    last, state = (phase, ns), None
                state, now = next_phase(state, at, cursor, n, phase_waits(waits, phase))
                told.append(now)
                cursors.append(state[1])
                runs.append(state[2])
                items.append(state[3])
            out = [batch.column(c) for c in ("phase", "ns", "ts", "key")]
            out += [pa.array(told, pa.string()), pa.array(cursors, batch.column("cursor").type), pa.array(runs, pa.int64()), pa.array(items, pa.int64())]
            yield pa.RecordBatch.from_arrays(out, names=["phase", "ns", "ts", "key", "told", "cursor", "runs", "items"])

    schema = f"phase {kind['phase']}, ns {kind['ns']}, ts {kind['ts']}, key {kind['key']}, told string, cursor {kind['cursor']}, runs long, items long"
    return rows.repartition("phase", "ns").sortWithinPartitions("phase", "ns", "ts", "key").mapInArrow(run, schema)


def update(memories: DataFrame, changes: DataFrame) -> DataFrame:
    """memories with the last change of each key: changes(key, at, and any columns to set); a null leaves a column as it is."""
    named = [c for c in changes.columns if c not in ("key", "at")]
    last = changes.groupBy("key").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(f"_{c}") for c in named))
    out = memories.join(last, "key", "left")
    return out.select(*(F.coalesce(f"_{c}", c).alias(c) if c in named else F.col(c) for c in memories.columns))


def delete_vectors(vectors: DataFrame, gone: DataFrame) -> DataFrame:
    """vectors without those of the memories that go."""
    return vectors.join(gone.select("key").distinct(), "key", "left_anti")


def delete(memories: DataFrame, relations: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(memories, relations) without the keys of gone and all relations that touch them; see delete_vectors for their vectors."""
    keys = gone.select("key").distinct()
    left = relations
    for end in ("source_id", "target_id"):
        left = left.join(keys.withColumnRenamed("key", end), end, "left_anti")
    return memories.join(keys, "key", "left_anti"), left


def newest(rows: DataFrame, by: str, n: int, *order: F.Column) -> DataFrame:
    """The first n rows of each value of `by` in the order given, with rank from 1."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= n)


def dead_agents(agents: DataFrame) -> DataFrame:
    """agents(agent_id, badge) without a badge, or whose id begins with test or demo and one more character."""
    return agents.filter((F.coalesce("badge", F.lit("")) == "") | F.col("agent_id").like("test_%") | F.col("agent_id").like("demo_%"))


def health(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(tab, rows, no_key, repeated, status) of each table and its key column; fail if a key is missing or repeated."""
    out = None
    for name, (df, key) in tables.items():
        per = df.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        one = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n"))), F.lit(0)).alias("no_key"), F.count(F.when(F.col("k").isNotNull() & (F.col("n") > 1), 1)).alias("repeated")).select(F.lit(name).alias("tab"), "*")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("status", F.when((F.col("no_key") > 0) | (F.col("repeated") > 0), "fail").otherwise("ok"))
