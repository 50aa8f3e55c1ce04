import collections
import itertools
import math
import random

import pytest

from memlattice.functions import segment as S
from memlattice.operators import graph, signals, vector

LETTERS = "甲乙丙丁"


def plain_paths(run, words, unknown):
    """Letter by letter from the end, the largest weight and then the longest word."""
    best, step = [0] * (len(run) + 1), [1] * len(run)
    for i in range(len(run) - 1, -1, -1):
        known = [(words[run[i : i + n]] + best[i + n], n) for n in range(1, 6) if i + n <= len(run) and run[i : i + n] in words]
        best[i], step[i] = max(known or [(unknown + best[i + 1], 1)])
    out, at = [], 0
    while at < len(run):
        out.append(run[at : at + step[at]])
        at += step[at]
    return out


@pytest.mark.parametrize(("letters", "chunk"), [(S.LETTERS, S.CHUNK), (40, 50)])
def test_chinese_runs_are_cut_where_they_stand(spark, monkeypatch, letters, chunk):
    """no substring is a row; a dictionary in several pieces and texts in several lots give the same."""
    monkeypatch.setattr(S, "LETTERS", letters)
    monkeypatch.setattr(S, "CHUNK", chunk)
    rng = random.Random(5)
    any_of = lambda n: "".join(rng.choice(LETTERS) for _ in range(n))
    freq = {any_of(rng.randint(1, 5)): rng.randint(1, 9) for _ in range(60)}
    texts = {i: " ".join([any_of(rng.randint(1, 40)), "ab ab", any_of(5), "天"][rng.randrange(2) :]) for i in range(40)} | {40: "", 41: "no", 42: "甲-b 甲"}
    dictionary = spark.createDataFrame([*freq.items()], "word string, freq long")
    docs = spark.createDataFrame([*texts.items()], "key long, content string")
    cut = S.segment(docs.selectExpr("key as run").selectExpr("cast(run as string) as run"), dictionary)
    found = S.counted_terms(docs, docs["content"], ["key"], dictionary, with_symbols=True)
    for plan in (x._jdf.queryExecution().optimizedPlan().toString() for x in (cut, found)):
        assert "Join" not in plan and "Generate" not in plan
    total = sum(freq.values())
    weigh = lambda n: math.floor(S.SCALE * math.log(n / total) + 0.5)
    words = {w: weigh(n) for w, n in freq.items()}
    want = set()
    for key, text in texts.items():
        parts = [w for t in text.replace("-", " ").split() for w in (plain_paths(t, words, weigh(1)) if t[0] > "z" else [t])]
        want |= {(key, w, n, len(parts)) for w, n in collections.Counter(parts + ["甲-b"] * (key == 42)).items()}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_repeated_keys_are_counted_together(spark):
    docs = spark.createDataFrame([(1, "甲乙"), (1, "甲乙")], "key long, content string")
    dictionary = spark.createDataFrame([("甲", 1), ("乙", 2)], "word string, freq long")
    assert {tuple(r) for r in S.counted_terms(docs, docs["content"], ["key"], dictionary).collect()} == {(1, "甲", 2, 2), (1, "乙", 2, 2)}


@pytest.mark.parametrize("needles", [signals.NEEDLES, 3])
def test_literal_search_moves_no_texts(spark, monkeypatch, needles):
    """texts stay in their task; batches of queries give the same."""
    monkeypatch.setattr(signals, "NEEDLES", needles)
    rng = random.Random(6)
    any_of = lambda n: "".join(rng.choice(LETTERS + "aB ") for _ in range(n))
    texts = {f"k{i}": any_of(rng.randint(0, 60)) for i in range(80)}
    asked = {i: any_of(rng.randint(1, 4)) for i in range(30)} | {30: "plain", 31: "[pattern] 甲乙", 32: "戊己", 33: "甲A乙"}
    docs = spark.createDataFrame([*texts.items(), ("none", None)], "key string, content string")
    found = signals.keyword_contains(spark.createDataFrame([*asked.items()], "query_id long, text string"), docs)
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString() and "content" not in "".join(x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "hashpartitioning" in x)
    clean = {q: t.removeprefix("[pattern]").strip(" ")[:24].strip(" ").lower() for q, t in asked.items()}
    want = {(q, k, -20.0) for q, n in clean.items() if any("一" <= c <= "鿿" for c in n) for k, t in texts.items() if n in t.lower()}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def plain_pairs(rows):
    by = collections.defaultdict(set)
    for k, x in rows:
        by[k].add(x)
    return collections.Counter(p for xs in by.values() for p in itertools.combinations(sorted(xs), 2))


@pytest.mark.parametrize(("kind", "shift"), [("long", -7), ("long", 1 << 40), ("int", 0), ("string", 0)])
@pytest.mark.parametrize("pairs", [graph.PAIRS, 20])
def test_pairs_are_counted_in_packs(spark, monkeypatch, kind, shift, pairs):
    """a pair of whole numbers is no row before it is counted."""
    monkeypatch.setattr(graph, "PAIRS", pairs)
    if kind != "string":
        monkeypatch.setattr(graph, "pairs_of", None)
    rng = random.Random(7)
    rows = {(rng.randrange(12), rng.randrange(40) + shift) for _ in range(150)} | {(99, x + shift) for x in range(33)} | {(100, shift), (101, 39 + shift)}
    rows = {(k, str(x) if kind == "string" else x) for k, x in rows}
    found = graph.counted_pairs(spark.createDataFrame([*rows], f"k long, x {kind}"), "k", "x", lot=9)
    assert {c: t for c, t in found.dtypes} == {"a": kind.replace("long", "bigint"), "b": kind.replace("long", "bigint"), "shared": "bigint"}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len({r[:2] for r in got}) and {(a, b): n for a, b, n in got} == plain_pairs(rows)


def test_pairs_of_odd_rows(spark):
    odd = spark.createDataFrame([(1, 0), (1, 1 << 60), (2, 0), (2, 1 << 60), (2, None)], "k long, x long")
    assert [tuple(r) for r in graph.counted_pairs(odd, "k", "x").collect()] == [(0, 1 << 60, 2)]
    odd = spark.createDataFrame([(1, 3), (1, 5), (1, None), (None, 3), (None, 5), (None, 6)], "k long, x long")
    assert {tuple(r) for r in graph.counted_pairs(odd, "k", "x").collect()} == {tuple(r) for r in graph.pairs_of(odd, "k", "x").groupBy("a", "b").count().collect()}
    assert graph.counted_pairs(odd.limit(0), "k", "x").collect() == []


@pytest.mark.parametrize("weights", [10_000, 2, 1])
def test_light_edges_are_dropped_before_they_are_ranked(spark, monkeypatch, weights):
    """rounds took all open edges, over and over."""
    monkeypatch.setattr(vector, "REST", 30)
    rows, real = [], vector.cut

    def cut(df, **options):
        out = real(df, **options)
        rows.append(out.count())
        return out

    monkeypatch.setattr(vector, "cut", cut)
    rng = random.Random(8)
    edges = [(ns, a, b, rng.randrange(weights) / weights) for ns, n in (("x", 50), ("y", 20)) for a, b in itertools.combinations(range(n), 2)]
    got = [tuple(r) for r in vector.capped_graph(spark.createDataFrame(edges, "namespace string, a long, b long, weight double"), 3).collect()]
    degree, want = collections.Counter(), set()
    for ns, a, b, w in sorted(edges, key=lambda e: (e[0], -e[3], e[1], e[2])):
        if degree[ns, a] < 3 and degree[ns, b] < 3:
            degree.update([(ns, a), (ns, b)])
            want.add((ns, a, b, w))
    assert len(got) == len(want) and set(got) == want
    if weights > 2:
        assert sum(rows) < 3 * len(edges)
