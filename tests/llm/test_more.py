"""Learned parts against slow versions, odd inputs with a model, and the finer points of the operators' contracts."""

import collections
import importlib.util
import math
import os
import random
import re
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[1]))
sys.path.insert(0, str(Path(__file__).parent))
from parity import SF, both  # noqa: E402
from test_ops import ODD, _around, docs_of  # noqa: E402

from memlattice.llm import ann_join, common, itq_dedup, lm_score, packing, queries, source_mix, suffix_dedup, toxicity  # noqa: E402
from memlattice.llm.boosting import BoostedTrees, Isotonic, bins_of  # noqa: E402
from memlattice.llm.kernels import mix as mixed_hash  # noqa: E402
from memlattice.llm.quality import BUCKETS, PSEUDO, REPEAT, OrdinalModel, quality  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_trees(x, y, trees, depth, rate, bins, ridge):
    """Boosting with one row and one cut at a time."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    b = bins_of(x, cuts)
    margin = [math.log(y.mean() / (1 - y.mean()))] * len(y)

    def grow(rows, level, g, h):
        if level == depth:
            return rate * sum(g[r] for r in rows) / (sum(h[r] for r in rows) + ridge)
        worth = lambda part: sum(g[r] for r in part) ** 2 / (sum(h[r] for r in part) + ridge)
        best, at = 1e-9, (0, 255)
        for j in range(x.shape[1]):
            for k in range(bins):
                left, right = [r for r in rows if b[r, j] <= k], [r for r in rows if b[r, j] > k]
                gain = worth(left) + worth(right) - worth(rows)
                if gain > best + 1e-12:
                    best, at = gain, (j, k)
        j, k = at
        return j, k, grow([r for r in rows if b[r, j] <= k], level + 1, g, h), grow([r for r in rows if b[r, j] > k], level + 1, g, h)

    for _ in range(trees):
        q = [1 / (1 + math.exp(-m)) for m in margin]
        tree = grow(list(range(len(y))), 0, [yi - qi for yi, qi in zip(y, q)], [max(qi * (1 - qi), 1e-6) for qi in q])
        for r in range(len(y)):
            node = tree
            while isinstance(node, tuple):
                node = node[2] if b[r, node[0]] <= node[1] else node[3]
            margin[r] += node
    return np.array(margin)


def test_boosting_against_slow_version():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((70, 3))
    y = (x[:, 0] + x[:, 1] ** 2 + 0.3 * rng.standard_normal(70) > 0.7).astype(float)
    model = BoostedTrees(trees=4, depth=2, rate=0.3, bins=6, ridge=2.0).fit(x, y)
    assert np.allclose(model.margin(x), slow_trees(x, y, 4, 2, 0.3, 6, 2.0))


def test_isotonic_against_slow_version():
    rng = np.random.default_rng(9)
    x = np.sort(rng.standard_normal(60))
    y = (rng.random(60) < 1 / (1 + np.exp(-x))).astype(float)
    steps = [max(min(y[a : b + 1].mean() for b in range(i, 60)) for a in range(i + 1)) for i in range(60)]
    blocks = collections.defaultdict(list)
    for i, s in enumerate(steps):
        blocks[round(s, 9)].append(i)
    got = Isotonic().fit(x, y)
    assert np.allclose(got.x, [x[b].mean() for b in blocks.values()])
    assert np.allclose(got.y, np.maximum.accumulate([(y[b].sum() + 0.5) / (len(b) + 1) for b in blocks.values()]))
    assert (np.diff(got.predict(x)) > 0).all()


def test_ordinal_model_against_slow_version():
    rng = np.random.default_rng(10)
    y = rng.integers(0, 3, 300)
    x = rng.poisson(1.0, (300, BUCKETS + 1)).astype(np.float32)
    x[:, 5] += 40 * y
    model = OrdinalModel().fit(x, y, 3)
    assert (np.diff(model.cuts) > 0).all()  # thresholds are ordered
    texts = ["the cat sat on on on the mat", None, "", "a", "ab", "abc abc", "ж" * 50]
    got = model.tails(pa.array(texts, pa.string()))
    for text, tails in zip(texts, got):
        raw = (text or "").encode()
        words = WORD.findall(text or "")
        weights = [model.weights[int(mixed_hash(np.array([raw[i] | raw[i + 1] << 8 | raw[i + 2] << 16], np.uint64))[0] % np.uint64(BUCKETS))] for i in range(len(raw) - 2)]
        again = REPEAT * sum(a == b for a, b in zip(words, words[1:]))
        n = len(weights) + again
        score = (sum(weights) + again * model.weights[BUCKETS] + n * model.base) / (n + PSEUDO)
        assert np.allclose(tails, [1 / (1 + math.exp(-(score - c))) for c in model.cuts])

    def loss(w, cuts):
        n = x.sum(axis=1)
        score = (x @ w + n * -float((x / n[:, None]).mean(axis=0) @ w)) / (n + PSEUDO)
        p = np.c_[np.ones(300), 1 / (1 + np.exp(-(score[:, None] - cuts))), np.zeros(300)]
        return -np.log(np.maximum(p[range(300), y] - p[range(300), y + 1], 1e-9)).mean()

    assert loss(model.weights, model.cuts) < 0.6 * loss(0 * model.weights, np.log([(y < k).mean() / (y >= k).mean() for k in (1, 2)]))


def labelled(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")


def odd_rows():
    return [(None, "you stupid idiot"), (-1, None), (-2, ""), (-3, "x " * 300_000), (-4, "a text that stands here twice"), (-4, "a text that stands here twice")]


def test_toxicity_of_odd_texts_with_a_model(spark):
    docs, labels = labelled(spark)
    odd = spark.createDataFrame(odd_rows(), "doc_id long, text string")
    out = toxicity.toxicity(docs.union(odd).withColumn("toxic", F.lit("clash")).withColumn("fold", F.lit(1)).withColumn("score", F.lit(2)), labels).filter("doc_id is null or doc_id < 0").collect()
    assert len(out) == 6 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    assert [r["held_out"] for r in out if r["doc_id"] is None] == [False]
    twice = [r["score"] for r in out if r["doc_id"] == -4]
    assert twice[0] == twice[1]
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_toxicity_counts_repeated_labels(spark):
    """Clean ids labelled 0, 0, 0, 1 stay mostly clean: the last label doesn't stand for all."""
    docs, labels = labelled(spark)
    more = labels.filter("toxic = 0").select("doc_id", F.explode(F.array(F.lit(0), F.lit(0), F.lit(1))).alias("toxic"))
    out = toxicity.toxicity(docs, labels.select("doc_id", "toxic").unionAll(more)).join(labels, "doc_id").filter("held_out")
    by = {r["toxic"]: (r["score"], r["n"]) for r in out.groupBy("toxic").agg(F.avg("score").alias("score"), F.count("*").alias("n")).collect()}
    assert by[0][0] < 0.45 < by[1][0]


def test_toxicity_bounds_what_the_driver_takes(spark):
    docs, labels = labelled(spark)
    out = toxicity.toxicity(docs.union(docs).union(docs), labels, sample=400)
    assert out.count() == 3 * docs.count()


def test_quality_of_odd_texts_with_a_model(spark):
    docs, _ = labelled(spark)
    grades = queries.grades(spark, "/root/testdata/sf0.01")
    odd = spark.createDataFrame(odd_rows(), "doc_id long, text string")
    out = quality(docs.union(odd).withColumn("grade", F.lit("clash")).withColumn("id", F.lit(1)).withColumn("x", F.lit(2)), grades.union(grades))
    assert {"grade", "id", "x", "expected_grade", "tail_probability", "keep"} < set(out.columns)
    got = out.filter("doc_id is null or doc_id < 0").collect()
    assert len(got) == 6 and all(0 <= r["tail_probability"] <= 1 and 0 <= r["expected_grade"] <= 2 and r["keep"] == (r["tail_probability"] >= 0.5) for r in got)
    assert quality(docs.limit(0), grades).count() == 0


def test_lm_counts_repeated_rows(spark):
    """Equal rows of one (or no) id are each counted, and each scored by all the others."""
    rows = [(7, "b c d e")] * 40 + [(None, "b c x")] * 30 + [(8, "never seen words")]
    got = lm_score.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), order=2).collect()
    assert collections.Counter((r["doc_id"], r["n_words"]) for r in got) == {(7, 4): 40, (None, 3): 30, (8, 3): 1}
    total = 40 * 4 + 30 * 3 + 3
    b, c = 70 - 1, 70 - 1
    score = math.log(0.4) + math.log(b / (total - 4)) + math.log(c / b) + math.log(39 / c) + math.log(39 / 39)
    assert all(math.isclose(r["log_score"], score - math.log(0.4)) for r in got if r["doc_id"] == 7)
    one = next(r for r in got if r["doc_id"] == 8)
    assert math.isclose(one["log_score"], 5 * math.log(0.4) - 3 * math.log(total - 3 + 1))


def test_lm_in_many_buckets_and_blocks(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = {r["doc_id"]: r["log_score"] for r in lm_score.lm_scores(docs).collect()}
    monkeypatch.setattr(lm_score, "BUCKET_BYTES", 1 << 14)
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 1 << 12)
    monkeypatch.setattr(lm_score, "LOT", 500)
    many = {r["doc_id"]: r["log_score"] for r in lm_score.lm_scores(docs).collect()}
    assert one.keys() == many.keys() and all(math.isclose(one[i], many[i], rel_tol=1e-9, abs_tol=1e-9) for i in one)


def test_mix_against_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(source_mix, "SHARD_DOCS", 20)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string"))))
    seed = 17
    rows = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(source_mix.WORD)), F.lit(0)).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("o"), F.xxhash64(F.lit(seed + 1), "doc_id", "text").alias("s")).collect()
    names = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    shards = max(1, -(-max(collections.Counter(r["source"] for r in rows).values()) // 20))
    size = {s: sum(r["size"] for r in rows if r["source"] == s) for s in names}
    goal = dict(zip(names, source_mix.targets([size[s] for s in names])))
    cells = collections.defaultdict(list)
    for r in rows:
        cells[r["source"], r["s"] % shards].append(r)
    blocks = {c: max(1, sum(r["size"] for r in rs) // source_mix.BLOCK) if sum(r["size"] for r in rs) else 0 for c, rs in cells.items()}
    many = np.array([sum(n for c, n in blocks.items() if c[0] == s) for s in names])
    share = np.array([goal[s] / size[s] * n for s, n in zip(names, many)])
    quotas = dict(zip(names, source_mix.apportion(round(share.sum()), share, 2 * many)))
    taken = {}
    for s in names:
        mine = sorted(c for c in cells if c[0] == s) if s else sorted((c for c in cells if c[0] is None), key=lambda c: c[1])
        n = np.array([blocks[c] for c in mine])
        for c, k, quota in zip(mine, n, source_mix.apportion(quotas[s], n, 2 * n)):
            rng = np.random.default_rng([seed, c[1]])
            step = int(rng.integers(1, max(k, 1) + 1))
            while math.gcd(step, max(int(k), 1)) > 1:
                step = step % max(int(k), 1) + 1
            shift, k = int(rng.integers(0, max(k, 1))), max(int(k), 1)
            words = [(r["doc_id"], j) for r in sorted(cells[c], key=lambda r: (r["o"], r["doc_id"])) for j in range(r["size"])]
            for block in range(k):
                lot = words[block * len(words) // k : (block + 1) * len(words) // k]
                for i, _ in lot:
                    taken[i] = taken.get(i, 0) + quota // k + ((block * step + shift) % k < quota % k)
    got = {r["doc_id"]: r["taken"] for r in source_mix.mix(docs).collect()}
    assert {i: n for i, n in got.items() if n} == {i: n for i, n in taken.items() if n}


def test_mix_keeps_the_callers_columns(spark):
    docs = docs_of(spark)
    for c in ("p_source", "p_shard", "_at", "_n", "_q", "_shard", "_source", "_total", "_order", "_kept", "taken"):
        docs = docs.withColumn(c, F.lit(f"own {c}"))
    out = source_mix.mix(docs)
    rows = out.collect()
    assert len(rows) == len(ODD) and all(r["_at"] == "own _at" and r["p_source"] == "own p_source" and r["_kept"] == "own _kept" for r in rows)
    assert all(isinstance(r["taken"], int) for r in rows)
    assert sorted(out.columns) == sorted({*docs.columns, "size", "source_size", "target", "taken", "whole", "parts"})


def test_mixed_text_keeps_line_breaks(spark):
    part = "array(named_struct('start', {}L, 'length', {}L), named_struct('start', {}L, 'length', {}L))"
    row = spark.sql(f"select ' one\\ntwo  three\\tfour five\\n' text, 1L whole, {part.format(0, 3, 4, 1)} parts")
    assert row.select(source_mix.mixed_text()).first()[0] == " one\ntwo  three\tfour five\n\none\ntwo  three\nfive"


def test_packing_with_any_tokenizer(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = [(1, "Hello World, don't  split\n\nthese   words! İ T̈ 12345"), (1, "Hello World, don't  split\n\nthese   words! İ T̈ 12345"), (2, ""), (3, None), (4, "x <|endoftext|> y " * 2000)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        tok = Tokenizer.from_file(path)
        assert packing.wordwise(path) == name.startswith("word")
        pieces = packing.pack_pow2(spark.createDataFrame(texts, "doc_id long, text string").withColumn("ids", F.lit(0)).withColumn("bucket", F.lit("clash")), path)
        out = pieces.orderBy("sequence_id").collect()
        assert all(r["length"] == 1 << r["bucket"] for r in out)
        want = collections.Counter()
        for i, t in texts:
            want[i, np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()] += 1
        got, at = collections.Counter(), b""
        for r in out:  # pieces of a row follow each other
            at = at + r["ids"] if r["start"] else r["ids"]
            if len(at) == 4 * r["doc_tokens"]:
                got[r["doc_id"], at] += 1
        assert got == want
    assert packing.pack_pow2(docs_of(spark).limit(0), path).count() == 0
    packing.write_buckets(pieces, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.filter("length <> shiftleft(1, bucket)").count() == 0 and back.count() == len(out)


def test_suffix_refuses_clashing_columns(spark):
    with pytest.raises(ValueError, match="carry"):
        suffix_dedup.remove_repeats(docs_of(spark).withColumn("kept", F.lit(1)), carry=("kept",))


def brute_nearest(vectors, asked, k):
    fine = [(i, np.array(v, float)) for i, v in vectors if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    out = set()
    for q, x in [(i, v) for i, v in fine if asked(i)]:
        near = sorted((-float(x @ y) / math.sqrt(float(x @ x) * float(y @ y)), i) for i, y in fine if i != q and len(y) == len(x))[:k]
        out |= {(q, n + 1, i, round(-s, 12)) for n, (s, i) in enumerate(near)}
    return out


def test_nearest_scores_ties_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann_join, "BLOCK", 37)
    monkeypatch.setattr(ann_join, "QUERIES", 5)
    rng = np.random.default_rng(12)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.integers(-2, 3, (400, 4)).astype(float))]  # many ties
    rows += [(500, None), (550, [0.0] * 4), (600, [float("nan"), 1.0, 0.0, 0.0]), (650, [1.0, None, 0.0, 0.0]), (None, [1.0] * 4), (700, [1.0, 2.0]), (701, [2.0, 1.0]), (750, [float("inf")] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("part", F.lit("clash")).withColumn("v", F.lit(1))
    out = ann_join.nearest(df, df.filter("vec_id % 50 = 0"), 5).collect()
    got = {(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 12)) for r in out}
    assert len(out) == len(got)
    expected = brute_nearest(rows, lambda i: i % 50 == 0, 5)
    key = lambda rs: {(q, n): s for q, n, _, s in rs}
    assert key(got) == key(expected)
    # among equal cosines (to the last bit or not) the ids are those of the brute force wherever scores are apart
    clear = {(q, n) for q, n, _, s in expected if sum(abs(s - t) < 1e-9 for p, _, _, t in expected if p == q) == 1}
    assert {(q, n, i) for q, n, i, _ in got if (q, n) in clear} == {(q, n, i) for q, n, i, _ in expected if (q, n) in clear}
    assert {(r[0], r[1], r[2]) for r in got if r[0] == 700} == {(700, 1, 701)}  # all candidates, if fewer
    exact = [r for r in out if r["query_id"] < 400]
    by = collections.defaultdict(list)
    for r in sorted(exact, key=lambda r: (r["query_id"], r["rank"])):
        by[r["query_id"]].append((-r["score"], r["vec_id"]))
    assert all(v == sorted(v) for v in by.values())  # equal scores stand in order of vec_id


def test_nearest_with_repeated_ids(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (1, [1.0, 0.1])], "vec_id long, embedding array<double>")
    out = ann_join.nearest(df, df.filter("vec_id = 0"), 3).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in out] == [(0, 1)] * 3 and round(out[0]["score"], 4) == round(1 / math.sqrt(1.01), 4)


@pytest.mark.parametrize(("step", "parts", "rows"), [(1, 16, 2048), (50, 2, 512), (1, 25, 2048)])
def test_blocks_of_sequential_ids_use_most_parts(spark, step, parts, rows):
    vectors = spark.range(0, 200_000 * step, step, 4).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("v"))
    ddl = "part int, dim int, n int, ids binary, data binary, code binary, scale binary, error binary"
    dealt = {r["part"]: r["n"] for r in common.in_arrow(vectors, ann_join._blocks(rows, parts), ddl).groupBy("part").agg(F.sum("n").alias("n")).collect()}
    assert sum(dealt.values()) == 200_000
    assert len(dealt) >= 0.8 * parts
    assert max(dealt.values()) <= 3 * 200_000 / parts


def test_grid_copies_little():
    assert ann_join.grid(16, 10**6, 2 * 10**4) == (16, 1)
    c, q = ann_join.grid(5000, 10**9, 2 * 10**7)
    assert q == 10 and c == 500
    assert ann_join.grid(8, 0, 0) == (8, 1)


def recall(spark, x, **options):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    out = {r["vec_id"]: r["n_links"] for r in itq_dedup.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), **options).collect()}
    got = np.array([out[i] for i in range(len(x))])
    assert (got <= near.sum(axis=1)).all()
    return got.sum() / max(1, near.sum())


@pytest.mark.parametrize("shift", [16, 24, 32])
def test_near_vectors_with_a_shared_direction(spark, shift):
    x = np.random.default_rng(6).standard_normal((1000, 64))
    x[:, 0] += shift
    assert recall(spark, x) >= 0.99


@pytest.mark.parametrize("shift", [0, 8, 10, 16, 24])
def test_near_vectors_with_learned_codes(spark, shift):
    """More vectors than a rotation takes to be learned, whatever is common to them: by codes at 0 and 8, exactly at 10 and 16, nearly all in balls at 24."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((4000, 64))
    x[:, 0] += shift
    x = np.concatenate([x, *(_around(rng, v, 0.9001, 1) for v in x[:600])])
    plan = itq_dedup.plan(itq_dedup.units(x), 0.9, 18)
    if shift < 24:
        assert bool(plan.models) == (shift < 10)
    if shift < 10:
        assert plan.models[0][0].any()  # learned, about the mean
    assert recall(spark, x) >= 0.98


@pytest.mark.parametrize("bits", [20, 24])
def test_near_vectors_with_wide_substrings(spark, monkeypatch, bits):
    """As for millions of vectors: fewer and wider substrings, more sets of codes."""
    monkeypatch.setattr(itq_dedup, "width", lambda n: bits)
    rng = np.random.default_rng(7)
    free = rng.standard_normal((1500, 64))
    assert recall(spark, np.concatenate([free, *(_around(rng, v, 0.9001, 1) for v in free[:700])])) >= 0.98


def test_width_grows_with_the_vectors():
    assert [itq_dedup.width(n) for n in (10, 1 << 16, 1 << 20, 1 << 30, 1 << 40)] == [16, 16, 20, 30, 32]


def test_near_vectors_against_their_sql(spark, tmp_path):
    """The query and its SQL on vectors that do link: planted pairs, copies, a chain and odd rows."""
    rng = np.random.default_rng(13)
    x = rng.standard_normal((120, 64))
    chain = [x[3]]
    for _ in range(4):
        chain.append(_around(rng, chain[-1], 0.93, 1)[0])
    rows = [*x, *(_around(rng, v, 0.91, 1)[0] for v in x[:30]), *(_around(rng, v, 0.89, 1)[0] for v in x[30:60]), *chain, x[7], x[7], x[8]]
    dtype = pq.read_schema(f"{SF}/embeddings.parquet")
    table = pa.table({"vec_id": pa.array(range(len(rows)), dtype.field("vec_id").type), "embedding": pa.array([r.tolist() for r in rows], dtype.field("embedding").type), "label": pa.array([0] * len(rows), dtype.field("label").type)})
    for name in os.listdir(SF):
        if name != "embeddings.parquet":
            os.symlink(f"{SF}/{name}", tmp_path / name)
    pq.write_table(table, tmp_path / "embeddings.parquet")
    got, expected = both(spark, queries.QUERIES["op10_near_vectors"], queries.ORACLES["op10_near_vectors"], str(tmp_path))
    assert got == expected and sum(int(r[2]) for r in got) > 70


class _Session:
    def __init__(self, master):
        self.conf = {"spark.master": master}


def test_a_cluster_needs_a_shared_folder():
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_dir(_Session(master))


def _folder(df):
    return df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:")


def test_a_scope_removes_what_was_cut_in_it(spark):
    before = common.cut(spark.range(5))
    with common.scope(spark):
        inner = _folder(common.cut(spark.range(6)))
        with common.scope(spark):
            innermost = _folder(common.cut(spark.range(7)))
        assert os.path.isdir(inner) and not os.path.exists(innermost)
    assert not os.path.exists(inner)
    with pytest.raises(ZeroDivisionError), common.scope(spark):
        failed = _folder(common.cut(spark.range(6)))
        raise ZeroDivisionError
    assert not os.path.exists(failed)
    assert before.count() == 5
    common.discard(spark, _folder(before))
    assert not os.path.exists(_folder(before))


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline here")
def test_a_lazy_result_outlives_a_pipeline_run(spark):
    import corpus_pipeline as cp

    from memlattice.llm.queries import QUERIES

    lazy = QUERIES["op4_jaccard_join"](spark, SF)
    assert cp.run(spark, SF).count() > 0
    assert lazy.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline here")
@pytest.mark.parametrize("stage", range(5))
def test_pipeline_stages_with_odd_input(spark, stage):
    """Nulls, empty and very long texts, repeated rows, empty tables and extra columns, in the way the stages' docstrings say."""
    import corpus_pipeline as cp

    long = " ".join(random.Random(3).choices([f"word{i}" for i in range(5000)], k=60_000))
    rows = [(None, "a row without an id that has some words"), (1, None), (2, ""), (3, " \n "), (4, "the same row twice over and over again"), (4, "the same row twice over and over again"), (5, long), (6, long), (7, None)]
    docs = spark.createDataFrame([(i, t, None, None if i == 5 else "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("keep", "kept", "spans", "n", "rep", "h", "size", "taken", "parts", "ids", "length", "bucket", "component_id", "_c0", "_d"):
        docs = docs.withColumn(c, F.lit("clash"))
    name, run = cp.STAGES[stage]
    out = run(spark, docs, SF)
    got = out.collect()
    ids = collections.Counter(r["doc_id"] for r in got)
    assert run(spark, docs.limit(0), SF).count() == 0
    if name != "pack":
        assert out.columns == cp.COLUMNS
    if name == "quality":
        assert ids[1] == ids[7] == ids[2] and ids[4] in (0, 2)
    if name == "jaccard":
        assert ids == {None: 1, 1: 1, 2: 1, 3: 1, 4: 2, 5: 1, 7: 1}
    if name == "repeats":
        assert ids == {None: 1, 1: 1, 2: 1, 3: 1, 4: 2, 5: 1, 7: 1} and {r["text"] for r in got if r["doc_id"] in (1, 2, 7)} == {None, ""}
    if name == "mix":
        assert not {1, 2, 3, 7} & set(ids) and ids[5] == ids[6] == 1
    if name == "pack":
        assert sorted(ids[i] for i in (1, 2, 3, 7)) == [1, 1, 1, 1] and {r["doc_tokens"] for r in got if r["doc_id"] == 1} == {1}
