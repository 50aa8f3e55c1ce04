import itertools
import math
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from memlattice.functions import segment as S
from memlattice.operators import keyword as K
from memlattice.operators import signals

DICTIONARY = [("研究", 50), ("研究生", 30), ("生命", 40), ("命", 20), ("起源", 25), ("生", 10), ("的", 200), ("南京", 30), ("南京市", 28), ("市长", 22), ("长江", 26), ("长江大桥", 12), ("大桥", 15), ("江大桥", 1), ("权限", 9)]


def all_paths(run, words, total):
    """Every path through the graph of a run, best first; equal ones by longer words first."""
    starts = [[n for n in range(1, len(run) - i + 1) if run[i : i + n] in words] or [1] for i in range(len(run))]

    def walk(i):
        if i == len(run):
            yield 0, ()
        else:
            for n in starts[i]:
                weight = math.floor(S.SCALE * math.log(words.get(run[i : i + n], 1) / total) + 0.5)
                for w, rest in walk(i + n):
                    yield w + weight, (n, *rest)

    lengths = max(walk(0))[1]
    ends = list(itertools.accumulate(lengths))
    return [run[e - n : e] for n, e in zip(lengths, ends, strict=True)]


def test_segments_ambiguous_runs_as_all_paths_do(spark):
    rng = random.Random(1)
    letters = "甲乙丙丁"
    words = dict(DICTIONARY)
    for _ in range(30):
        words["".join(rng.choice(letters) for _ in range(rng.randint(1, 4)))] = rng.randint(1, 50)
    # words whose products are equal: the longer first word wins
    words |= {"戊己": 6, "庚": 1, "戊": 2, "己庚": 3}
    runs = ["研究生命的起源", "南京市长江大桥", "戊己庚", "权", "没有词", "𠀀"] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 11))) for _ in range(60)]
    table = spark.createDataFrame([*words.items(), ("无", 0), ("", 5)], "word string, freq long")
    got = {r["run"]: r["words"] for r in S.segment(spark.createDataFrame([(r,) for r in [*runs, None, ""]], "run string"), table).collect()}
    total = sum(words.values())
    assert got == {r: all_paths(r, words, total) for r in runs}
    assert got["研究生命的起源"] == ["研究", "生命", "的", "起源"]
    assert got["南京市长江大桥"] == ["南京市", "长江大桥"]
    assert got["戊己庚"] == ["戊己", "庚"]


def test_segments_long_runs_and_without_a_dictionary(spark):
    run = "研究生命" * 5000
    table = spark.createDataFrame(DICTIONARY, "word string, freq long")
    got = S.segment(spark.createDataFrame([(run,), (run,)], "run string"), table).collect()
    assert [r["words"] for r in got] == [["研究", "生命"] * 5000]
    assert S.segment(spark.createDataFrame([("研究",)], "run string"), table.limit(0)).first()["words"] == ["研", "究"]


def test_query_terms(spark):
    table = spark.createDataFrame(DICTIONARY, "word string, freq long")
    q = spark.createDataFrame([(1, "[pattern] 研究生命的Agent权限 RUST_REWRITE_PLAN.md naïve"), (2, None), (3, "的 -- ")], "query_id long, text string")
    got = sorted((r["query_id"], r["term"]) for r in S.query_terms(q, ["query_id"], table).collect())
    assert got == sorted((1, t) for t in ["研究", "生命", "agent", "权限", "rust_rewrite_plan.md", "rust", "rewrite", "plan", "md", "naive"])


def made(seed=2, n=300):
    rng = random.Random(seed)
    word = lambda: f"w{min(int(rng.paretovariate(0.7)), 400)}"
    rows = [(i, " ".join(word() for _ in range(rng.randint(1, 120))), f"n{i % 3}") for i in range(n)]
    rows += [(1000 + i, rows[5][1], "n1") for i in range(40)] + [(2000, None, "n0"), (2001, "", "n1")]
    asks = [(q, " ".join(word() for _ in range(rng.randint(1, 30))), f"n{q % 3}") for q in range(25)] + [(50, rows[5][1], "n1"), (51, "nothing known", "n0"), (52, None, "n0")]
    return rows, asks


def scores(rows, asks, by_namespace):
    words = lambda t: re.findall(r"[^\W_]+", unicodedata.normalize("NFC", (t or "").lower()))
    bags = {key: (words(f"{t or ''} {ns}"), ns) for key, t, ns in rows}
    avgdl = sum(len(b) for b, _ in bags.values()) / len(bags)
    out = {}
    for q, text, ns in asks:
        for key, (bag, own) in bags.items():
            s = 0
            for t in set(words(text)):
                if (tf := bag.count(t)) and (own == ns or not by_namespace):
                    df = sum(t in b for b, _ in bags.values())
                    s += max(math.log((len(bags) - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(bag) / avgdl))
            if s:
                out[q, key] = s
    return out


def top(scored, k):
    by = {}
    for (q, key), s in scored.items():
        by.setdefault(q, []).append((-round(s, 6), key))
    return {(q, key): -s for q, found in by.items() for s, key in sorted(found)[:k]}


@pytest.mark.parametrize(("same", "k", "block", "pairs"), [([], 10, 512, 1 << 17), (["namespace"], 5, 16, 40), ([], 1000, 7, 1 << 17)])
def test_best_equals_scoring_all_pairs(spark, monkeypatch, same, k, block, pairs):
    monkeypatch.setattr(K, "BLOCK", block)
    monkeypatch.setattr(K, "PAIRS", pairs)
    rows, asks = made()
    docs = spark.createDataFrame(rows, "key long, content string, namespace string").repartition(3)
    q = spark.createDataFrame(asks, "query_id long, text string, namespace string")
    found = K.best(S.query_terms(q, ["query_id", *same]), K.index_of(docs, same), k)
    kept = signals.ranked(found, "keyword", k)
    got = {(r["query_id"], r["key"]): r["score"] for r in kept.collect()}
    want = top(every := scores(rows, asks, bool(same)), k)
    assert got.keys() == want.keys()
    assert all(math.isclose(got[x], want[x], rel_tol=1e-9, abs_tol=2e-6) for x in got)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert found.count() <= min(len(every), tasks * k * len(asks))


def test_blocks_that_cannot_reach_the_bound_are_passed_over():
    asked = K._Asked({}, {"rare": 5.0, "often": 0.1}, 10.0, 1, K.K1, K.B)
    looked = []

    class Counted(dict):
        def __getitem__(self, term):
            looked.append(term)
            return super().__getitem__(term)

    row = lambda keys: (1, 10, np.array(keys), np.ones(len(keys)), np.full(len(keys), 10.0))
    held = {}
    asked.search(Counted(rare=row([7]), often=row([7, 8])), [(0, ["often", "rare"])], held)
    assert held[0][1].tolist() == [7] and looked
    looked.clear()
    asked.search(Counted(often=row([1, 2, 3])), [(0, ["often", "rare"])], held)
    assert not looked and held[0][1].tolist() == [7]


def test_best_of_empty_sides(spark):
    rows, asks = made()
    docs = spark.createDataFrame(rows, "key long, content string, namespace string")
    q = spark.createDataFrame(asks, "query_id long, text string, namespace string")
    assert K.best(S.query_terms(q.limit(0), ["query_id"]), K.index_of(docs), 5).collect() == []
    assert K.best(S.query_terms(q, ["query_id"]), K.index_of(docs.limit(0)), 5).collect() == []


def test_whole_symbols_and_words_of_runs_are_found(spark):
    table = spark.createDataFrame(DICTIONARY, "word string, freq long")
    docs = spark.createDataFrame([(1, "see plan_b.md"), (2, "md b plan"), (3, "研究生命的起源"), (4, "研究生"), (5, "other")], "key long, content string")
    index = K.index_of(docs, [], table, with_symbols=True)
    q = spark.createDataFrame([(1, "plan_b.md"), (2, "生命研究")], "query_id long, text string")
    got = {(r["query_id"], r["key"]): r["score"] for r in K.best(S.query_terms(q, ["query_id"], table), index, 5).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 3)}
    assert got[1, 1] > got[1, 2]
    dl = {r["key"]: r["dl"] for r in index.blocks.select(F.explode("docs").alias("d")).select("d.*").distinct().collect()}
    assert dl == {1: 4, 2: 3, 3: 4, 4: 1, 5: 1}
