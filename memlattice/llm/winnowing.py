"""Document fingerprints by winnowing, in DataFrame functions alone.

Every run of GRAM characters of the whole text is hashed; of every WINDOW neighbouring hashes the least is chosen, of equal ones the
rightmost, and kept with its position. So two texts that share GRAM + WINDOW - 1 characters in a row share a fingerprint
there, and the positions say where. A hash and its position are one number while the minima are taken (the position counted down, so that the least number is the
rightmost of equal hashes). Two windows of minima, as far apart as they are wide, make one of twice the width; both lists are walked side by side, which costs less
than looking neighbours up by their place.
Very long texts are worked on in pieces that overlap by what a window needs, which changes no choice and bounds memory.

A text's neighbour in the order of ids is found without sorting texts: the ids are ranked, every so many ranks a bound is
set, rows go to the group between two bounds, and the first row of each group goes to the group before it as well.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_parts
from .ranks import ranked

#: Characters of a gram; grams of a window.
GRAM, WINDOW = 8, 16
#: Grams that begin in one piece of a text. Positions in a piece take the lower bits of a number.
PIECE, _PLACES = 1 << 16, (1 << 23) - 1
#: Groups of neighbouring documents for each partition.
GROUPS = 4


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _codes(piece: Column) -> Column:
    """Numbers of hash and position of all grams of a piece that has GRAM characters or more.

    A gram is cut out of the piece's bytes: its place is known, where a string would be read from its start. Where characters take
    several bytes, the places are those of bytes that begin one.
    """
    # the upper half of the hash over the place counted down: the bits below it are set before the place is taken off
    code = lambda g, i: F.shiftrightunsigned(F.xxhash64(g), 9).bitwiseOR(F.lit(_PLACES)) - i
    n, inner = F.octet_length(piece), [F.lit(bytearray([x])) for x in (0x80, 0xBF)]
    whole = lambda b: F.transform(F.sequence(F.lit(1), n - GRAM + 1), lambda s, i: code(F.substring(b, s, F.lit(GRAM)), i))
    begins = lambda b: F.concat(F.filter(F.sequence(F.lit(1), n), lambda i: ~F.substring(b, i, F.lit(1)).between(*inner)), F.array(n + 1))
    placed = lambda b: _bind(begins(b), lambda at: F.transform(F.slice(at, 1, F.size(at) - GRAM), lambda s, i: code(F.substring(b, s, at[i + GRAM] - s), i)))
    return _bind(piece.cast("binary"), lambda b: F.when(n == F.length(piece), whole(b)).otherwise(placed(b)))


def _once(x: Column, what: Callable[[Column], Column] = lambda v: v) -> Column:
    """x without elements that repeat the one before; equal ones follow each other."""
    return _bind(x, lambda m: F.filter(m, lambda v, i: (i == 0) | (what(v) != what(m[F.greatest(i - 1, F.lit(0))]))))


def _chosen(piece: Column) -> Column:
    """What winnowing chooses of a piece's grams: numbers of hash and position in the piece, by position."""
    alone = F.array(F.shiftleft(F.shiftrightunsigned(F.xxhash64(piece), 32), 23).bitwiseOR(F.lit(_PLACES).cast("long")))
    codes = F.when(F.length(piece) >= GRAM, _codes(piece)).when(piece != "", alone).otherwise(F.array().cast("array<bigint>"))

    def least_of_twice(width: int) -> Callable[[Column], Column]:
        # the last ones have no neighbour, a null, which least() passes over
        return lambda x: F.zip_with(x, F.slice(x, width + 1, F.size(x)), lambda a, b: F.least(a, b))

    def minima(x: Column) -> Column:
        full = x
        for width in (1, 2, 4, 8):  # up to WINDOW
            full = _bind(full, least_of_twice(width))
        full = F.slice(full, F.lit(1), F.size(x) - (WINDOW - 1))
        return F.when(F.size(x) >= WINDOW, _once(full)).when(F.size(x) > 0, F.array(F.array_min(x))).otherwise(x)

    return _bind(codes, minima)


def prints(text: Column, first: Column | int = 0) -> Column:
    """array<struct<hash long, pos long>> of a text by position, counted from first; a text of fewer than GRAM characters is one gram, an empty one has none."""
    grams = F.length(text) - (GRAM - 1)
    pieces = F.greatest(F.lit(1), F.ceil((grams - (WINDOW - 1)) / F.lit(PIECE))).cast("int")
    reach = PIECE + WINDOW - 1 + GRAM - 1

    def one(own: Column, i: Column) -> Column:
        return F.transform(_chosen(own), lambda c: F.struct(F.shiftrightunsigned(c, 23).alias("hash"), (_PLACES - c.bitwiseAND(F.lit(_PLACES)) + i * PIECE + first).cast("long").alias("pos")))

    # where two pieces meet, the last gram of one may be the first of the next: positions never go back
    cut_out = F.transform(F.sequence(F.lit(0), pieces - 1), lambda i: F.substring(text, i * PIECE + 1, F.lit(reach)))
    return F.when(pieces == 1, one(text, F.lit(0))).otherwise(_once(F.flatten(F.transform(cut_out, one)), lambda p: p["pos"]))


def likeness(a: Column, b: Column) -> Column:
    """Share of the hashes of two fingerprints that both have, 1 if neither has any."""
    hashes = lambda x: F.array_distinct(F.transform(x, lambda p: p["hash"]))
    share = lambda n, both: F.when(n > 0, both / (n - both)).otherwise(1.0)
    return _bind(F.struct(hashes(a).alias("a"), hashes(b).alias("b")), lambda h: _bind(F.size(F.array_intersect(h["a"], h["b"])), lambda both: share(F.size(h["a"]) + F.size(h["b"]), both)))


def as_string(of: Column) -> Column:
    """hash@position of each chosen gram, the hash in hexadecimal."""
    return F.array_join(F.transform(of, lambda p: F.concat(F.hex(p["hash"]), F.lit("@"), p["pos"].cast("string"))), " ")


def _place(doc_id: Column, text: Column) -> Column:
    """Sorts by descending id, nulls last; rows of one id by a hash of their text."""
    return F.struct(doc_id.isNull().alias("a"), F.bitwise_not(F.coalesce(doc_id, F.lit(0))).alias("b"), F.xxhash64(text).alias("c"))


def with_next(docs: DataFrame) -> DataFrame:
    """(grp, ghost, place, doc_id, text, next): each row with the text of the next one by descending id, the last with the first's.

    Rows of grp, ordered by ghost and place, are neighbours; the one ghost of a group is the first row of the next.
    Equal rows (id and text) follow each other and stay in one group.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("place", _place(F.col("doc_id"), F.col("text")))
    places = cut(rows.select("place").groupBy("place").agg(F.count(F.lit(1)).alias("n")))
    order = ranked(places, [F.col("place")], "n")
    total = places.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    every = max(1, -(-total // (GROUPS * n_parts(spark))))
    # the place with which each group of ranks begins: as many as groups
    firsts = order.groupBy(F.expr(f"(rank - 1) div {every}").alias("g")).agg(F.min("place").alias("place")).orderBy("g").collect() if total else []
    bounds = [list(r["place"]) for r in firsts]
    wide = max(1, int(len(bounds) ** 0.5))
    lists = [bounds[i : i + wide] for i in range(0, len(bounds), wide)]
    kind = "struct<a: boolean, b: bigint, c: bigint>"
    known = lambda x, of: F.from_json(F.lit(json.dumps(x)), of)
    as_rows = lambda part: [dict(zip("abc", b, strict=True)) for b in part]
    heads = known(as_rows([part[0] for part in lists]), f"array<{kind}>")
    tails = known([as_rows(part) for part in lists], f"array<array<{kind}>>")
    upto = lambda of, x: F.size(F.filter(of, lambda b: b <= x))
    rows = rows.withColumn("hi", upto(heads, F.col("place")) - 1)
    rows = rows.withColumn("lo", upto(tails[F.col("hi")], F.col("place")) - 1).withColumn("grp", F.col("hi") * wide + F.col("lo"))
    to = lambda g, ghost: F.struct(g.cast("int").alias("grp"), F.lit(ghost).alias("ghost"))
    before = F.when(F.col("grp") == 0, F.lit(len(bounds) - 1)).otherwise(F.col("grp") - 1)
    starts = tails[F.col("hi")][F.col("lo")] == F.col("place")
    sent = rows.select("doc_id", "text", "place", F.explode(F.when(starts, F.array(to(F.col("grp"), False), to(before, True))).otherwise(F.array(to(F.col("grp"), False)))).alias("x"))
    dealt = sent.select("x.grp", "x.ghost", "place", "doc_id", "text").repartition(n_parts(spark), "grp")
    return dealt.withColumn("next", F.lead("text").over(Window.partitionBy("grp").orderBy("ghost", "place")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited, prints, edited_prints, near_edited, near_next) of whole texts.

    edited is the text with its last third (floor(n_chars / 3) characters) replaced by as many first characters of the next text by descending id, or all
    that it has. near_edited and near_next say how alike the fingerprint is to that of the edited and of the next text.
    Null texts are empty; empty texts have no fingerprint and are alike (1.0) to each other. Null ids come last, rows of one id in the order of a hash of their
    texts; equal rows follow each other; the last row's next is the first, a single row's next is itself. Other columns are ignored, no rows give none.
    """
    by = Window.partitionBy("grp").orderBy("ghost", "place")
    rows = with_next(docs).withColumn("prints", prints(F.col("text"))).withColumn("next_prints", F.lead("prints").over(by)).filter("not ghost")
    n, kept = F.length("text"), F.col("kept")
    rows = rows.withColumn("kept", (n - F.floor(n / 3)).cast("int"))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), kept), F.substring("next", F.lit(1), n - kept)))
    # grams up to `same` lie in windows of the kept text alone; those after it are chosen by windows from `again` on
    grams = kept - (GRAM - 1)
    same, again = grams - WINDOW, F.greatest(F.lit(0), grams - 2 * WINDOW + 2)
    rest = prints(F.substring("edited", again + 1, F.length("edited")), again)
    joined = F.concat(F.filter("prints", lambda p: p["pos"] <= same), F.filter(rest, lambda p: p["pos"] > same))
    rows = rows.withColumn("edited_prints", joined)
    near = lambda b: likeness(F.col("prints"), F.col(b))
    return rows.select("doc_id", n.cast("long").alias("n_chars"), "edited", "prints", "edited_prints", near("edited_prints").alias("near_edited"), near("next_prints").alias("near_next"))
