import collections
import hashlib
import math
import random
import re
import sys
import zlib
from pathlib import Path

import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[1]))
from parity import SF  # noqa: E402

from memlattice.llm import resample, tput, winnowing  # noqa: E402
from memlattice.llm.ranks import ranked  # noqa: E402

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [(None, "No id here at all"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b c d e f g h i j"), (6, "a b c d e f g h i j"), (6, "a b c d e f g h i j"), (6, "another text of this id"), (7, "é" * 9000 + " x"), (8, "Ä B C D E F G H I J 𝄞𝄞")]


def docs_of(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clash = ("rank", "h", "copies", "grp", "next", "term", "block", "prints", "w", "bucket", "place", "_part")
    return df.select("*", *(F.lit("x").alias(c) for c in clash)).repartition(3)


def made(seed, n=150):
    rng = random.Random(seed)
    vocab = [f"w{int(rng.expovariate(0.05))}" for _ in range(60)] + ["É", "ß", "9"]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 80)))) for i in range(n)]
    return rows + [(500 + i, rows[3][1]) for i in range(70)] + ODD


# ranked lexical search


def answers(rows, asks, k):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    docs = [(i, collections.Counter(w), len(w)) for i, t in rows if (w := cut(t))]
    n_all, tokens = len(docs), sum(d[2] for d in docs)
    df = collections.Counter(t for d in docs for t in d[1])
    items = collections.defaultdict(set)
    for i, t in asks:
        items[i] |= set(cut(t))
    out = []
    for item, terms in items.items():
        found = []
        for i, tf, n in docs:
            m = 100 - 50 + (50 * n * n_all) // tokens
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in terms if tf[t])
            if score > 0:
                found.append((-score, i is not None, i or 0))
        out += [(item, r, i if known else None, -s) for r, (s, known, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("docs", "items", "k"), [(1024, 512, 50), (7, 3, 5), (16, 2, 300)])
def test_search_against_brute_force(spark, monkeypatch, docs, items, k):
    monkeypatch.setattr(tput, "DOCS", docs)
    monkeypatch.setattr(tput, "ITEMS", items)
    rows = made(1)
    asks = [(i, t) for i, t in made(2, 12)[:12]] + [(3, "again w1"), (None, "no id w2 w3"), (90, None), (91, ""), (92, "unknownword"), (93, " ".join(rows[3][1].split()[:9]))]
    asked = spark.createDataFrame(asks, "item_id long, text string").withColumn("term", F.lit("x"))
    got = sorted((tuple(r) for r in tput.search(docs_of(spark, rows), asked, k).collect()), key=str)
    assert got == answers(rows, asks, k)


def test_search_looks_up_less_than_all(spark):
    """Rare words decide; the thresholds keep most entries of the common ones in their lists."""
    rng = random.Random(4)
    rows = [(i, " ".join(["common"] * rng.randint(1, 9) + [f"r{rng.randrange(40)}" for _ in range(20)])) for i in range(400)]
    rows += [(1000 + i, "common rare1 rare2 rare3") for i in range(5)]
    got = tput.search(docs_of(spark, rows), spark.createDataFrame([(1, "common rare1 rare2 rare3")], "item_id long, text string"), 5).collect()
    assert [tuple(r) for r in sorted(got)] == answers(rows, [(1, "common rare1 rare2 rare3")], 5)
    assert {r["doc_id"] for r in got} == {1000, 1001, 1002, 1003, 1004}


def test_search_of_empty_tables(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert tput.search(none, one).collect() == []
    assert tput.search(spark.createDataFrame([(1, "a")], "doc_id long, text string"), one.filter("item_id > 1")).collect() == []
    assert tput.search(spark.createDataFrame([(1, None), (2, "..")], "doc_id long, text string"), one).collect() == []


# fingerprints


def fingerprint(s):
    grams = [s[i : i + winnowing.GRAM] for i in range(len(s) - winnowing.GRAM + 1)] or ([s] if s else [])
    h, out = [xxhash.xxh64(g.encode(), seed=42).intdigest() >> 32 for g in grams], set()
    for i in range(max(1, len(h) - winnowing.WINDOW + 1) if h else 0):
        window = h[i : i + winnowing.WINDOW]
        out.add((i + max(j for j, x in enumerate(window) if x == min(window)), min(window)))
    return [(x, p) for p, x in sorted(out)]


@pytest.mark.parametrize("piece", [1 << 16, 40])
def test_winnowing_against_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(winnowing, "PIECE", piece)
    rows = [(i + 1000 if i is not None and i < 60 and t not in dict(ODD).values() else i, t) for i, t in made(3, 60) if i not in (6, 7)]
    rows += [(7, "é" * 300), (9, "abcdefghijklmnopqrstuvwxyz" * 4), (10, "𝄞é" * 40)]
    got = {r["doc_id"]: r for r in winnowing.fingerprints(docs_of(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert len(got) == len(rows)
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for at, (i, t) in enumerate(order):
        t, after, r = t or "", order[(at + 1) % len(order)][1] or "", got[i]
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        assert (r["n_chars"], r["edited"]) == (len(t), edited)
        assert [tuple(p) for p in r["prints"]] == fingerprint(t)
        assert [tuple(p) for p in r["edited_prints"]] == fingerprint(edited)
        own, other, following = ({h for h, _ in fingerprint(x)} for x in (t, edited, after))
        assert (r["near_edited"], r["near_next"]) == (like(own, other), like(own, following))


def test_winnowing_of_long_repeated_and_no_rows(spark):
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefgh ") for _ in range(300_000))
    same = [(5, "x" * 50)] * 40
    got = winnowing.fingerprints(docs_of(spark, [(1, long), *same, (5, "other text of that id"), (0, None)])).collect()
    assert len(got) == 43
    assert [tuple(p) for p in next(r for r in got if r["doc_id"] == 1)["prints"]] == fingerprint(long)
    # equal rows follow each other, then comes the other row of that id or before them
    assert sum(r["near_next"] == 1.0 for r in got if r["doc_id"] == 5) == 39
    assert winnowing.fingerprints(docs_of(spark, same).filter("doc_id = 1")).collect() == []
    alone = winnowing.fingerprints(docs_of(spark, [(3, "abcdefghijkl")])).collect()
    assert [(r["edited"], r["near_next"]) for r in alone] == [("abcdefghabcd", 1.0)]


def test_winnowing_finds_shared_runs(spark):
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    other = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = other(winnowing.GRAM + winnowing.WINDOW - 1)
    rows = [(1, other(100) + shared + other(57)), (2, other(31) + shared + other(80))]
    a, b = ({(p["hash"], p["pos"] - (100 if r["doc_id"] == 1 else 31)) for p in r["prints"]} for r in sorted(winnowing.fingerprints(docs_of(spark, rows)).collect()))
    assert a & b  # at the same place of the run


# resampling


def drawn(rows, targets, percent, least, ngrams, buckets, seed):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    runs = lambda w: [" ".join(w[i : i + n]) for n in range(ngrams[0], ngrams[1] + 1) for i in range(len(w) - n + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = collections.Counter(bucket(f) for _, t in rows for f in runs(cut(t)))
    t_ = collections.Counter(bucket(f) for t in targets for f in runs(cut(t)))
    big_s, big_t = sum(s.values()), sum(t_.values())
    gain = lambda b: math.floor(1000 * math.log((t_[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for i, t in rows:
        w = cut(t)
        f = runs(w)
        weight = sum(gain(bucket(x)) for x in f)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((o for o in out if o[1] >= least), key=lambda o: (-o[4], o[0] is not None, o[0] or 0, o[2]))
    ranks = collections.defaultdict(list)
    for r, o in enumerate(able, 1):
        ranks[tuple(o)].append(r if r <= percent * len(able) // 100 else None)
    return sorted(((*o, ranks[tuple(o)].pop(0) if o[1] >= least else None) for o in out), key=str)


@pytest.mark.parametrize(("percent", "least", "ngrams", "buckets"), [(10, 20, (1, 1), 10_000), (60, 1, (1, 3), 97), (100, 0, (2, 2), 50)])
def test_resample_against_brute_force(spark, percent, least, ngrams, buckets):
    rows, targets = made(6), ["w1 w2 w3 w5", None, "", "É ß w1 9"]
    target = spark.createDataFrame([(t,) for t in targets], "text string")
    got = resample.resample(docs_of(spark, rows), target, percent, least, ngrams, buckets, 7).collect()
    assert sorted((tuple(r) for r in got), key=str) == drawn(rows, targets, percent, least, ngrams, buckets, 7)


def test_resample_of_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert resample.resample(none, some).collect() == []
    assert sorted((r["doc_id"], r["n_features"], r["rank"]) for r in resample.resample(some, none, 100, 0).collect()) in ([(1, 2, 1), (2, 0, 2)], [(1, 2, 2), (2, 0, 1)])


def test_ranks_with_copies(spark):
    rows = spark.createDataFrame([(i % 50, 1 + i % 3) for i in range(50)], "v int, n int").repartition(5)
    got = {r["v"]: r["rank"] for r in ranked(rows, [F.col("v").desc()], "n").collect()}
    at, want = 1, {}
    for v in sorted(range(50), reverse=True):
        want[v] = at
        at += 1 + v % 3
    assert got == want


def test_registered_fingerprints_of_equal_texts(spark):
    from memlattice.llm.queries import QUERIES

    got = QUERIES["op12_winnowing"](spark, SF).toPandas()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    by = collections.defaultdict(set)
    for i, f in zip(got["doc_id"], got["fingerprint"], strict=True):
        by[texts[i]].add(f)
    assert len(got) == len(texts)
    assert all(len(f) == 1 for f in by.values())
    assert len({next(iter(f)) for f in by.values()}) == len(by)
    long = got[got["n_chars"] >= 200]
    assert (long["near_edited"] > long["near_next"]).mean() > 0.97
