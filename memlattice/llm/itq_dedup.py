"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables, crowded regions by exact tiles.

A rotation is learned that makes the signs of the rotated vectors balanced codes of 64 bits. Each code is cut in
substrings, one for each table: four of 16 bits, or fewer of more bits for many vectors, so that a table's keys are as many as the
vectors and the pairs that meet by chance grow with the vectors, not with their square. Both sides of a pair stand in a table under
their substring and all substrings one bit away, so a pair meets if some substring differs in two bits at most. Pairs that meet are
held against the Hamming radius, then reranked with the original vectors. Equal vectors are one row with a count.

Codes tell little where many vectors lie close together. So balls are drawn around sampled vectors that have many links. A
vector within the link angle of a ball's centre is inside; whatever links with it is within twice that angle. Inside and
this rim are compared exactly, as tiles of cosines; the codes are learned from, and used for, the vectors outside all balls.
Pairs at the least cosine are drawn around sampled vectors to find the radius and how many sets of codes (other rotations)
leave at most MISS of them apart. This holds for any number of vectors. Where max_sets() don't do, or exact is asked for, all are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_arrow, n_parts
from .graph import components, contract
from .vectors import cosines, matrices, usable

BITS = 64
#: Bits of a substring at least and at most.
SUB_LEAST, SUB_MOST = 16, 32
#: Vectors the rotation is learned from; the smallest by a hash of their ids.
SAMPLE = 10_000
#: Rows of a table key or cell that one task compares with each other; larger ones are dealt in pairs of blocks.
LOT = 4096
#: Rows of a key up to which keys are compared many at a time, and pairs held then.
FEW, HELD_PAIRS = 256, 2_000_000
#: Share of a sample that makes a ball, and the balls at most.
CROWD, BALLS = 0.005, 64
#: Share of pairs at the least cosine that the codes may leave apart by the drawn pairs.
MISS = 0.002
#: Sampled vectors outside the balls from which a rotation is learned; with fewer it is random.
LEARNABLE = 1024


def width(n: int) -> int:
    """Bits of a substring for n vectors: each of 17 or more keys of a vector should be shared by a few others."""
    return min(SUB_MOST, max(SUB_LEAST, int(n).bit_length() - 1))


def max_sets(sub: int) -> int:
    """Sets of codes at most. Wider substrings are fewer and agree less often, so they take more sets."""
    return 4 + (sub - SUB_LEAST)


def learn(sample: np.ndarray, rounds: int = 30, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection to BITS dimensions) by iterative quantisation of a sample of unit vectors."""
    mean = sample.mean(axis=0)
    x = sample - mean
    _, _, axes = np.linalg.svd(x.T @ x)
    parts, have, rng = [], 0, np.random.default_rng(seed)
    while have < BITS:
        dim = min(x.shape[1], BITS - have)
        v = x @ axes[:dim].T
        turn, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
        for _ in range(rounds):
            left, _, right = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
            turn = (left @ right).T
        parts.append(axes[:dim].T @ turn)
        have += dim
    return mean, np.hstack(parts)


def units(x: np.ndarray) -> np.ndarray:
    unit = x / np.abs(x).max(axis=1, keepdims=True)
    return unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True))


def encode(x: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    bits = (units(x) - model[0]) @ model[1] >= 0
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]


def random_model(dim: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """No mean and random directions, orthogonal as far as the dimension allows: what two codes differ in depends on the angle alone."""
    rng, parts = np.random.default_rng(seed), []
    while sum(p.shape[1] for p in parts) < BITS:
        parts.append(np.linalg.qr(rng.standard_normal((dim, dim)))[0])
    return np.zeros(dim), np.hstack(parts)[:, :BITS]


@dataclass(frozen=True)
class Plan:
    """How vectors of one dimension are compared: centres of balls, sets of codes for the rest (none: exactly) and their radius."""

    centres: np.ndarray
    models: tuple[tuple[np.ndarray, np.ndarray], ...]
    radius: int
    sub: int = SUB_LEAST


def drawn_pairs(x: np.ndarray, least: float, seed: int = 11, n: int = 10_000) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs at cosine `least` from rows of x: towards any direction, and towards other rows."""
    rng = np.random.default_rng(seed)
    a = x[rng.integers(0, len(x), n)]
    out = []
    for to in (rng.standard_normal(a.shape), x[rng.integers(0, len(x), n)] - x[rng.integers(0, len(x), n)]):
        to = to - (to * a).sum(axis=1, keepdims=True) * a
        size = np.sqrt((to * to).sum(axis=1, keepdims=True))
        fine = size[:, 0] > 1e-6
        out.append((a[fine], least * a[fine] + np.sqrt(1 - least * least) * to[fine] / size[fine]))
    return out


def crowded(x: np.ndarray, least: float) -> np.ndarray:
    """Centres of balls: sampled vectors with links to many, most first, each counted without those of balls before it."""
    near = (x[:2000].astype(np.float32) @ x.T.astype(np.float32)) >= least
    free, centres = np.ones(len(x), bool), []
    while len(centres) < BALLS:
        links = (near & free[None, :]).sum(axis=1)
        best = int(links.argmax())
        if links[best] < max(2, CROWD * len(x)):
            break
        centres.append(best)
        free &= ~near[best]
    return x[centres]


def plan(x: np.ndarray, least: float, radius: int, sub: int = SUB_LEAST) -> Plan:
    """For a sample x of unit vectors, with substrings of sub bits."""
    centres = crowded(x, least)
    rest = x[(x @ centres.T < least).all(axis=1)] if len(centres) else x
    if len(rest) < 2:
        return Plan(centres, (), radius)
    pairs, models = drawn_pairs(rest, least), []
    apart = [np.ones(len(a), bool) for a, _ in pairs]
    for seed in range(max_sets(sub)):
        models.append(learn(rest, seed=7 + seed) if len(rest) >= LEARNABLE else random_model(x.shape[1], seed))
        diffs = [encode(a, models[-1]) ^ encode(b, models[-1]) for a, b in pairs]
        bits = np.concatenate([np.bitwise_count(d) for d in diffs])
        if not len(bits):
            return Plan(centres, (), radius)
        if not seed:
            radius = max(radius, int(np.ceil(np.quantile(bits, 1 - MISS / 4))))
        for k, d in enumerate(diffs):
            subs = np.stack([np.bitwise_count((d >> np.uint64(sub * t)) & np.uint64((1 << sub) - 1)) for t in range(BITS // sub)])
            apart[k] &= (subs > 2).all(axis=0) | (np.bitwise_count(d) > radius)
        if max(m.mean() for m in apart if len(m)) <= MISS:
            return Plan(centres, tuple(models), radius, sub)
    return Plan(centres, (), radius)


def _cells(plans: dict[int, Plan], least: float):
    """A row for each cell a vector is compared in exactly: its own (inside) and others whose rim it is on; -1 if codes do for it.

    A pair of two inside vectors of different balls is compared in the first ball: the rim takes only vectors of later ones and of none.
    """
    wide = np.cos(min(np.pi, 2 * np.arccos(least) + 1e-6)) - 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in matrices(batch.column("v")):
                p = plans.get(x.shape[1], Plan(np.zeros((0, x.shape[1])), (), 0))
                k = len(p.centres)
                cos = units(x) @ p.centres.T
                own = np.where((cos >= least).any(axis=1), (cos >= least).argmax(axis=1), k) if k else np.zeros(len(x), np.int64)
                rim, ball = np.nonzero((cos >= wide) & (np.arange(k)[None, :] < own[:, None]))
                cell = np.where((own == k) & bool(p.models), -1, own | (x.shape[1] << 20))
                at = pa.array(np.concatenate([rows, rows[rim]]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([cell, ball | (x.shape[1] << 20)]).astype(np.int64)), pa.array(np.r_[np.ones(len(rows), bool), np.zeros(len(rim), bool)]), batch.column("rep").take(at), batch.column("v").take(at), batch.column("n").take(at)],
                    names=["cell", "inside", "rep", "v", "n"],
                )

    return run


def _tiles(least: float):
    """(a, b, w) of each block of a cell: w, without b, is how many rows link with a there; b, without w, ends a star of the links."""

    def compare(i: int, j: int, side, inside, rep, v, n) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
        one, two = (np.arange(len(rep)),) * 2 if i == j else (np.flatnonzero(side == i), np.flatnonzero(side != i))
        x = matrices(v)[0][1]
        unit, w = units(x), np.zeros(len(rep), np.int64)
        stars: list[tuple[np.ndarray, np.ndarray]] = []
        for s in range(0, len(one), 512):
            a = one[s : s + 512]
            cos = unit[a] @ unit[two].T
            open_ = (cos >= least - 1e-9) & (inside[a][:, None] | inside[two][None, :])
            if i == j:
                open_ &= two[None, :] > a[:, None]
            near = open_ & (cos >= least + 1e-9)
            p, q = np.nonzero(open_ & ~near)
            near[p, q] = cosines(x[a[p]], x[two[q]]) >= least
            w[a] += near @ n[two]
            w[two] += n[a] @ near
            p, q = np.nonzero(near)
            if len(p):
                stars.append(contract(rep[a[p]], rep[two[q]]))
        if stars:
            ends = contract(*(np.concatenate(c) for c in zip(*stars, strict=True)))
            hit = np.flatnonzero(w)
            none = lambda m: pa.nulls(m, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(rep[hit]), none(len(hit)), pa.array(w[hit])], names=["a", "b", "w"])
            yield pa.RecordBatch.from_arrays([pa.array(ends[0]), pa.array(ends[1]), none(len(ends[0]))], names=["a", "b", "w"])

    def group(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if t.num_rows > 1:
            col = lambda c: t.column(c).to_numpy()
            yield from compare(t.column("i")[0].as_py(), t.column("j")[0].as_py(), col("side"), col("inside"), col("rep"), t.column("v"), col("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the block that is still being read
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("cell", "i", "j")])
            new = np.r_[0, np.flatnonzero((cols[:, 1:] != cols[:, :-1]).any(axis=0)) + 1, batch.num_rows]
            for s, e in zip(new[:-1], new[1:], strict=True):
                now = tuple(cols[:, s])
                if now != last and held:
                    yield from group(pa.Table.from_batches(held))
                    held = []
                last = now
                held.append(batch.slice(s, e - s))
        if held:
            yield from group(pa.Table.from_batches(held))

    return run


def _keys(plans: dict[int, Plan]):
    """A row for each set of codes, table and key of a vector's code. A key holds dimension, set (6 bits), table (2 bits) and substring (32 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("rep").to_numpy()
            for rows, x in matrices(batch.column("v")):
                bits = plans[x.shape[1]].sub
                flips = np.r_[0, 1 << np.arange(bits, dtype=np.int64)]
                for k, model in enumerate(plans[x.shape[1]].models):
                    code = encode(x, model)
                    for t in range(BITS // bits):
                        sub = ((code >> np.uint64(bits * t)) & np.uint64((1 << bits) - 1)).astype(np.int64)
                        key = (sub[:, None] ^ flips[None, :]).reshape(-1) | (t << 32) | (k << 34) | (x.shape[1] << 40)
                        n = len(flips)
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(ids[rows], n)), pa.array(np.repeat(code.view(np.int64), n))], names=["key", "rep", "code"])

    return run


def _meets_here(a: np.ndarray, b: np.ndarray, table: int, sub: int | np.ndarray, bits: int) -> np.ndarray:
    """Of all places where two codes meet, one counts: the first table, and there the smallest common key."""
    here = np.ones(a.shape, bool)
    for t in range(table + 1):
        diff = ((a ^ b) >> np.uint64(bits * t)) & np.uint64((1 << bits) - 1)
        far = np.bitwise_count(diff)
        if t < table:
            here &= far > 2
            continue
        sa = (a >> np.uint64(bits * t)) & np.uint64((1 << bits) - 1)
        sb = sa ^ diff
        low = diff & (~diff + np.uint64(1))
        # no bit apart: the substring itself; one: the smaller of both; two: the smaller of the two between
        key = np.where(far == 0, sa, np.where(far == 1, np.minimum(sa, sb), np.minimum(sa ^ low, sb ^ low)))
        here &= (far <= 2) & (key == np.uint64(sub))
    return here


def _meet(radii: dict[int, tuple[int, int]]):
    """radii: Hamming radius and bits of a substring, for each dimension."""

    def compare(key: int, ra, ca, rb, cb, same: bool) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
        table, sub, (radius, bits) = (key >> 32) & 3, key & ((1 << 32) - 1), radii[key >> 40]
        for s in range(0, len(ra), 512):
            a, b = ca[s : s + 512, None], cb[None, :]
            near = np.bitwise_count(a ^ b) <= radius
            if same:
                near &= np.arange(len(rb))[None, :] > np.arange(s, s + a.shape[0])[:, None]
            i, j = np.nonzero(near)
            keep = _meets_here(ca[s + i], cb[j], table, sub, bits)
            i, j = i[keep] + s, j[keep]
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ra[i], rb[j])), pa.array(np.maximum(ra[i], rb[j]))], names=["a", "b"])

    def small(key: np.ndarray, ends: np.ndarray, rep: np.ndarray, code: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The pairs of keys with few rows each, all at once; ends: for each row where its key's rows end."""
        after = ends[rows] - 1 - rows
        lot = np.cumsum(after) // HELD_PAIRS
        for part in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(lot)) + 1):
            n = after[part]
            a = np.repeat(rows[part], n)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
            apart = np.bitwise_count(code[a] ^ code[b])
            for dim in np.unique(key[rows[part]] >> 40).tolist():
                radius, bits = radii[dim]
                near = (apart <= radius) & (key[a] >> 40 == dim)
                for table in range(BITS // bits):
                    at = np.flatnonzero(near & (((key[a] >> 32) & 3) == table))
                    x, y = a[at], b[at]
                    keep = _meets_here(code[x], code[y], table, (key[x] & ((1 << 32) - 1)).astype(np.uint64), bits)
                    x, y = rep[x[keep]], rep[y[keep]]
                    if len(x):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    def group(key: int, i: int, j: int, side: np.ndarray, rep: np.ndarray, code: np.ndarray) -> Iterator[pa.RecordBatch]:
        if i == j:
            yield from compare(key, rep, code, rep, code, True)
        else:
            m = side == i
            yield from compare(key, rep[m], code[m], rep[~m], code[~m], False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in ("key", "i", "j", "side", "rep", "code")]
            if held is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(held, cols, strict=True)]
            if not len(cols[0]):
                continue
            new = np.flatnonzero(np.r_[True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])])
            if len(new) > 1:
                few = (np.diff(new) <= FEW) & (cols[1][new[:-1]] == cols[2][new[:-1]])
                rows = np.flatnonzero(np.repeat(few, np.diff(new)))
                if len(rows):
                    yield from small(cols[0], np.repeat(new[1:], np.diff(new)), cols[4], cols[5].view(np.uint64), rows)
                few = np.r_[few, False]
            for k, (s, e) in enumerate(zip(new[:-1], new[1:], strict=True)):
                if e - s > 1 and not few[k]:
                    yield from group(int(cols[0][s]), int(cols[1][s]), int(cols[2][s]), cols[3][s:e], cols[4][s:e], cols[5][s:e].view(np.uint64))
            held = [c[new[-1] :] for c in cols]
        if held is not None and len(held[0]) > 1:
            yield from group(int(held[0][0]), int(held[1][0]), int(held[2][0]), held[3], held[4], held[5].view(np.uint64))

    return run


def _rerank(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            va, vb = matrices(batch.column("va")), dict()
            for rows, x in matrices(batch.column("vb")):
                vb[x.shape[1]] = (rows, x)
            keep = np.zeros(batch.num_rows, bool)
            for rows, x in va:
                if x.shape[1] in vb:  # keys hold the dimension, so both sides of a row have the same
                    keep[rows] = cosines(x, vb[x.shape[1]][1]) >= least
            yield batch.filter(pa.array(keep)).select(["a", "b", "na", "nb"])

    return run


def _dealt(rows: DataFrame, key: str, *carry: str) -> DataFrame:
    """(key, i, j, side, *carry): the rows of a key that has more than LOT stand in several sides, which meet two at a time."""
    large = rows.groupBy(key).agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > LOT).select(key, F.ceil(F.col("c") / LOT).cast("int").alias("g"))
    if not large.limit(1).count():
        return rows.select(key, F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), *carry)
    dealt = rows.join(large, key, "left").withColumn("side", F.pmod(F.xxhash64("rep"), F.coalesce("g", F.lit(1))).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.coalesce("g", F.lit(1)) - 1))
    return dealt.select(key, "side", *carry, other.alias("o")).select(key, F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j"), "side", *carry)


def near_duplicates(vectors: DataFrame, least: float = 0.9, radius: int = 18, exact: bool = False) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors(vec_id, embedding).

    Two vectors link if their cosine is at least `least` in double precision; codes bring all but about MISS of the pairs at that
    cosine together, exact cells all; with exact all vectors of a dimension are one cell, whose blocks meet two at a time, and no link
    is missed. radius is the smallest Hamming radius that is used. n_links
    counts the other rows linked directly, equal ones included; component_id is the smallest vec_id reached; kept marks it. Null,
    zero or not finite vectors link with nothing, and so do vectors of different dimensions; a null id keeps a null component
    and is not kept. Of several rows with one id each counts. Other columns are ignored; an empty table gives no rows.
    """
    spark, p = vectors.sparkSession, n_parts(vectors.sparkSession)
    rows = usable(vectors)
    classes = cut(rows.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    plans = {}
    if not exact:
        for dim, n in classes.groupBy(F.size("v")).count().collect():
            picked = classes.filter(F.size("v") == dim).orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("v").collect()
            plans[dim] = plan(units(np.array([r["v"] for r in picked])), least, radius, width(n))
    cells = cut(classes.transform(in_arrow, _cells(plans, least), "cell long, inside boolean, rep long, v array<double>, n long"))
    found = cut(_dealt(cells.filter("cell >= 0"), "cell", "inside", "rep", "v", "n").repartition(p, "cell", "i", "j").sortWithinPartitions("cell", "i", "j").transform(in_arrow, _tiles(least), "a long, b long, w long"))
    degree, links = found.filter("b is null").select(F.col("a").alias("rep"), "w"), found.filter("b is not null").select("a", "b")
    if any(x.models for x in plans.values()):
        coded = cells.filter("cell = -1").select("rep", "v", "n")
        keys = cut(coded.select("rep", "v").transform(in_arrow, _keys(plans), "key long, rep long, code long"))
        pairs = _dealt(keys, "key", "rep", "code").repartition(p, "key", "i", "j").sortWithinPartitions("key", "i", "j").transform(in_arrow, _meet({d: (x.radius, x.sub) for d, x in plans.items()}), "a long, b long")
        if max(len(x.models) for x in plans.values()) > 1:
            pairs = pairs.distinct()  # each set of codes may bring a pair together
        left = coded.select(F.col("rep").alias("a"), F.col("v").alias("va"), F.col("n").alias("na"))
        right = coded.select(F.col("rep").alias("b"), F.col("v").alias("vb"), F.col("n").alias("nb"))
        met = cut(pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "va", "vb").transform(in_arrow, _rerank(least), "a long, b long, na long, nb long"))
        degree = degree.unionAll(met.select(F.col("a").alias("rep"), F.col("nb").alias("w"))).unionAll(met.select(F.col("b").alias("rep"), F.col("na").alias("w")))
        links = links.unionAll(met.select("a", "b"))
    degree = degree.groupBy("rep").agg(F.sum("w").alias("w"))
    labels = components(links).withColumnRenamed("node", "rep")
    named = classes.join(degree, "rep", "left").join(labels, "rep", "left")
    named = named.select("v", (F.col("n") - 1 + F.coalesce("w", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    out = every.join(named, "v", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
