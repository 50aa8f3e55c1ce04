import collections
import itertools
import random

import pandas as pd
import pytest

from memlattice.operators import embedding, entities, questions
from memlattice.operators import inference as I


def slow(triples):
    """All rules over all triples until nothing is new."""
    every = {t for t in triples if None not in t}
    while True:
        new, by = set(), collections.defaultdict(set)
        for s, p, o in every:
            by[p].add((s, o))
        trans = {s for s, o in by[I.TYPE] if o == I.TRANSITIVE} | {I.SUB_CLASS, I.SUB_PROPERTY}
        same, sym = by[I.SAME], {s for s, o in by[I.TYPE] if o == I.SYMMETRIC} | ({I.SAME} if by[I.SAME] else set())
        for s, p, o in every:
            new |= {(s, I.TYPE, d) for c, d in by[I.SUB_CLASS] if p == I.TYPE and c == o}
            new |= {(s, q, o) for a, q in by[I.SUB_PROPERTY] if a == p}
            new |= {(s, I.TYPE, c) for q, c in by[I.DOMAIN] if q == p} | {(o, I.TYPE, c) for q, c in by[I.RANGE] if q == p}
            new |= {(o, b, s) for a, b in by[I.INVERSE] if a == p} | {(o, a, s) for a, b in by[I.INVERSE] if b == p}
            new |= {(o, p, s)} if p in sym else set()
            new |= {(s, p, z) for y, z in by[p] if y == o} if p in trans else set()
            for a, b in same:
                new |= ({(b, p, o)} if s == a else set()) | ({(s, p, b)} if o == a else set()) | ({(s, b, o)} if p == a else set())
        if new <= every:
            return every
        every |= new


@pytest.mark.parametrize("seed", range(2))
def test_inference_against_all_rules_over_all_triples(spark, seed):
    rng = random.Random(seed)
    things, kinds, props = [f"x{i}" for i in range(9)], [f"C{i}" for i in range(5)], [f"p{i}" for i in range(4)]
    facts = [(rng.choice(things), rng.choice(props), rng.choice(things)) for _ in range(12)]
    schema = [(rng.choice(kinds), I.SUB_CLASS, rng.choice(kinds)) for _ in range(4)] + [("p0", I.SUB_PROPERTY, "p1"), ("p1", I.SUB_PROPERTY, "p2"), ("p0", I.DOMAIN, "C0"), ("p3", I.RANGE, "C1")]
    schema += [("p2", I.TYPE, I.TRANSITIVE), ("p3", I.TYPE, I.SYMMETRIC), ("p1", I.INVERSE, "p3"), ("x0", I.SAME, "x1"), ("x1", I.SAME, "x2")] if seed else [("p1", I.TYPE, I.TRANSITIVE), ("C0", I.SUB_CLASS, "C1"), ("C1", I.SUB_CLASS, "C0")]
    triples = [*facts, *schema, *facts[:2], (None, "p0", "x1")]
    got = I.infer(spark.createDataFrame(triples, "s string, p string, o string")).collect()
    assert {(r["s"], r["p"], r["o"]) for r in got} == slow(triples)
    assert len(got) == len({(r["s"], r["p"], r["o"]) for r in got})


def test_cycles_end_and_paths_double(spark):
    ring = [(f"n{i}", "next", f"n{(i + 1) % 40}") for i in range(40)] + [("next", I.TYPE, I.TRANSITIVE)]
    got = I.infer(spark.createDataFrame(ring, "s string, p string, o string"), ("transitive",)).collect()
    assert len(got) == 40 * 40 + 1
    assert max(r["round"] for r in got) <= 6
    assert I.infer(spark.createDataFrame([], "s string, p string, o string")).collect() == []


def test_entities_mentions_and_edges_are_merged_in_order(spark):
    e = "entity_id string, namespace string, entity_type string, name string, aliases string, summary string"
    m, d = "namespace string, name string, memory_id long, context string, at long", "namespace string, source string, target string, relation_type string, weight double, evidence string, at long"
    start = entities.Graph(spark.createDataFrame([("e1", "a", "tool", "Spark", "[]", "old")], e), spark.createDataFrame([("e1", 1, "first")], "entity_id string, memory_id long, context string"), spark.createDataFrame([], "source_id string, target_id string, relation_type string, weight double, evidence string"))
    wrote = spark.createDataFrame([(None, "a", "other", " Spark ", "[x]", "new", 5), (None, "a", "tool", "Java", "[]", "j1", 1), (None, "a", "lang", "Java", "[]", "j2", 2), (None, "b", "tool", "Spark", "[]", "", 1), (None, "a", "t", "  ", "", "", 1), ("e9", "a", "t", "Given", "", "", 1)], e + ", at long")
    said = spark.createDataFrame([("a", "Spark", 1, "again", 9), ("a", "Java", 2, "late", 9), ("a", "Java", 2, "early", 3), ("a", "Nobody", 2, "", 1)], m)
    drawn = spark.createDataFrame([("a", "Spark", "Java", "uses", 0.5, "first", 1), ("a", "Spark", "Java", "uses", 0.7, "second", 2), ("a", "Spark", "Java", "eats", 1.0, "", 1), ("a", "Spark", "Nobody", "uses", 1.0, "", 1)], d)
    got, refused = entities.upsert(start, wrote, said, drawn)
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    held = {(r["namespace"], r["name"]): r for r in got.entities.collect()}
    assert set(held) == {("a", "Spark"), ("a", "Java"), ("b", "Spark"), ("a", "Given")}
    assert tuple(held["a", "Spark"])[:1] + tuple(held["a", "Spark"])[2:] == ("e1", "tool", "Spark", "[x]", "new")
    assert (held["a", "Java"]["entity_type"], held["a", "Java"]["summary"], held["a", "Given"]["entity_id"]) == ("tool", "j2", "e9")
    java = held["a", "Java"]["entity_id"]
    assert rows(got.mentions) == sorted([("e1", 1, "first"), (java, 2, "early")], key=str)
    assert rows(got.edges) == [("e1", java, "uses", 0.7, "second")]
    assert {(r["kind"], r["reason"]) for r in refused.collect()} == {("entity", "empty name"), ("mention", "no such entity"), ("edge", "unknown type"), ("edge", "no such entity")}
    again, _ = entities.upsert(got, wrote, said, drawn)
    for a, b in zip((got.entities, got.mentions, got.edges), (again.entities, again.mentions, again.edges), strict=True):
        assert rows(a) == rows(b)


def test_embedding_with_a_cache_and_tries(spark, tmp_path):
    log = str(tmp_path / "asked")

    def embedder(texts):
        with open(log, "a") as f:
            f.writelines(f"{t}\n" for t in texts)
        asked = open(log).read().split("\n")
        if any(t == "bad" or t.startswith("flaky") and asked.count(t) < 2 for t in texts):
            raise OSError("try later")
        return pd.Series([[float(len(t)), 0.0 if t == "zero" else 1.0] if t != "zero" else [0.0, 0.0] for t in texts])

    rows = spark.createDataFrame([(1, "one"), (2, "one"), (3, "flaky3"), (4, "bad"), (5, None), (6, "zero"), (7, "flaky7")], "key long, content string").coalesce(1)
    got = embedding.embed_cached(rows, embedding.empty_cache(rows), embedder, 2, "2024-01-01", wait=0.01)
    vectors = {r["key"]: r["v"] for r in got.vectors.collect()}
    assert set(vectors) == {1, 2, 3, 7} and vectors[1] == vectors[2] and abs(sum(x * x for x in vectors[1]) - 1) < 1e-12
    assert {r["key"]: r["error"] for r in got.failed.collect()} == {4: "OSError: try later", 5: "no text", 6: "unsound vector"}
    before = open(log).read().count("\n")
    more = spark.createDataFrame([(1, "one"), (8, "eight"), (9, "flaky3")], "key long, content string")
    later = embedding.embed_cached(more, got.cache, embedder, 2, "2024-01-02", wait=0.01, most=2)
    assert {r["key"] for r in later.vectors.collect()} == {1, 8, 9} and later.failed.count() == 0
    assert open(log).read()[:].count("\n") - before == 1  # the new text alone, once
    assert later.cache.count() == 2 and {r["used"] for r in later.cache.collect()} == {"2024-01-02"}
    assert len(list(itertools.chain(got.cache.collect()))) == 3


def test_an_interrupted_question_build_ends_as_a_whole_one(spark, tmp_path):
    log = tmp_path / "asked"
    stop = tmp_path / "stop"
    stop.write_text("")

    def asks(texts):
        with open(log, "a") as f:
            f.writelines(f"{t}\n" for t in texts)
        return texts.map(lambda t: [f"{t} a", f" {t} b ", "", f"{t} a"] if t != "mute" else [])

    def vectors(texts):
        if stop.exists() and any(t.startswith("late") for t in texts):
            raise SystemExit  # no error of the text: the task dies with it
        return texts.map(lambda t: [float(len(t)), 1.0] if not t.startswith("odd") else [0.0, 0.0])

    rows = spark.createDataFrame([(1, "one"), (2, "mute"), (3, "late three"), (4, None), (5, "odd five"), (6, "six"), (7, "seven"), (8, "eight")], "key long, content string")
    path = str(tmp_path / "built")
    with pytest.raises(Exception):  # noqa: B017, PT011  the job fails as its task does
        questions.build(rows, path, asks, vectors, 2, lots=4)
    before = log.read_text().split()
    stop.unlink()
    got = {(r["key"], r["question"]) for r in questions.build(rows, path, asks, vectors, 2, lots=4).collect()}
    whole = {(r["key"], r["question"]) for r in questions.build(rows, str(tmp_path / "anew"), asks, vectors, 2, lots=4).collect()}
    assert got == whole == {(k, f"{t} {x}") for k, t in ((1, "one"), (3, "late three"), (6, "six"), (7, "seven"), (8, "eight")) for x in "ab"}
    assert before
    asked = log.read_text()
    again = {(r["key"], r["question"]) for r in questions.build(rows, path, asks, vectors, 2, lots=4).collect()}
    # only the row whose vectors are unsound is asked for again
    assert again == got and log.read_text()[len(asked) :] == "odd five\n"
    failed = {r["key"] for r in questions.stored(spark, path).filter("error is not null").collect()}
    assert failed == {5}


def test_roads_with_several_vectors_for_a_key(spark):
    content = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(6)], "key long, v array<double>")
    asked = spark.createDataFrame([(9, [1.0, x / 100]) for x in range(8)] + [(1, [1.0, 0.5])], "key long, v array<double>")
    got = questions.search(spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, v array<double>"), {"content": content, "question": asked}, 3).collect()
    assert sorted((r["key"], r["source"]) for r in got) == [(0, "content"), (1, "question"), (9, "question")]


def test_equal_sets_are_compared_once(spark):
    """Keys of one set share its comparisons, in blocks where they are many; every pair of keys is given."""
    import itertools

    from memlattice.operators import graph

    sets = {k: [{"a", "b", "c"}, {"a", "b", "c", "d"}, {"x", "y"}, {"c", "d", "e"}][k % 7 % 4] for k in range(40)}
    rows = spark.createDataFrame([(k, w) for k, s in sets.items() for w in sorted(s)], "k long, w string")
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    want = {(a, b, like(a, b)) for a, b in itertools.combinations(sets, 2) if like(a, b) >= 0.6}
    for lot in (3, 2000):
        got = [tuple(r) for r in graph.jaccard_pairs(rows, 0.6, lot).collect()]
        assert len(got) == len(want) and set(got) == want


def test_neighbours_are_found_for_the_frontier_alone(spark, monkeypatch):
    """Few nodes are sent to the relations, many are joined with them; what is reached is the same, each relation counting once."""
    from memlattice.operators import graph

    types = ["semantic_related", "updates", "same_entity", "chronological", "extends"]
    made = [(k % 37, (k * 7 + 1) % 41, types[k % 5], k % 10 / 10) for k in range(400)]
    relations = spark.createDataFrame(made + made[:50], "source_id long, target_id long, relation_type string, weight double")
    seeds = spark.createDataFrame([(q, q * 5 + i, 1.0 / (1 + i)) for q in range(3) for i in range(2)], "query_id long, node long, score double")
    got = []
    for most in (1 << 18, 0):
        monkeypatch.setattr(graph, "NODES", most)
        got.append(sorted(map(tuple, graph.expand(seeds, relations, 2).collect())))
    assert got[0] == got[1] and {r[2] for r in got[0]} == {1, 2}
