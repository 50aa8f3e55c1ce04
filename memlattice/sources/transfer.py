"""Export to and import from lines of JSON, session lines, document files, Turtle triples."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import RELATION_OF
from . import pdf, xls


def to_lines(rows: DataFrame, table: str) -> DataFrame:
    """A line {"table": ..., "row": {...}} for each row, ready for write.text."""
    return rows.select(F.to_json(F.struct(F.lit(table).alias("table"), F.struct(*rows.columns).alias("row"))).alias("value"))


def header(tables: dict[str, DataFrame], version: int = 1) -> DataFrame:
    """The first line: version and row counts."""
    counts = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("t"), "n")
        counts = one if counts is None else counts.unionByName(one)
    if counts is None:
        raise ValueError("no table to export")
    return counts.agg(F.map_from_entries(F.collect_list(F.struct("t", "n"))).alias("counts")).select(F.to_json(F.struct(F.lit(version).alias("version"), "counts")).alias("value"))


#: Exported tables with their columns; vectors travel as base64.
EXPORTED = {
    "memories": "id namespace source content category confidence recall_count last_recalled created_at promoted_at tier evidence importance decay_factor tags valid_from valid_to superseded_by".split(),
    "user_prefs": "key value evidence confidence updated_at namespace".split(),
    "decisions": "id namespace topic decision rationale context session_id created_at".split(),
    "memory_relations": "id namespace source_id target_id relation_type weight evidence created_at valid_from valid_to".split(),
    "memory_vectors": "id namespace vector updated_at".split(),
    "entities": "id namespace entity_type name aliases summary created_at".split(),
    "entity_mentions": "id entity_id memory_id context namespace created_at".split(),
    "entity_edges": "id namespace source_entity_id target_entity_id relation_type weight evidence created_at valid_from valid_to".split(),
}
VERSION = 1


def export_lines(tables: dict[str, DataFrame], include_vectors: bool = True) -> DataFrame:
    """(value): a header and a line for each row of the tables in EXPORTED, with those of their columns that they have."""
    sent = {t: df for t, df in tables.items() if t in EXPORTED and (include_vectors or t != "memory_vectors")}
    out = header(sent)
    for t, df in sent.items():
        held = df.select(*(c for c in EXPORTED[t] if c in df.columns))
        if t == "memory_vectors":
            held = held.withColumn("vector", F.regexp_replace(F.base64(vector_to_bytes(F.col("vector"))), "[\r\n]", ""))
        out = out.unionByName(to_lines(held, t))
    return out


def check_header(line: str) -> None:
    """Raises if an export's first line has no version, or one that is too new."""
    try:
        version = json.loads(line).get("version")
    except (ValueError, AttributeError) as e:
        raise ValueError("the header is not JSON") from e
    if not isinstance(version, int):
        raise ValueError("the header has no version")
    if version > VERSION:
        raise ValueError(f"unsupported export version {version}")


def import_lines(lines: DataFrame, namespace: str, old: dict[str, DataFrame], on_conflict: str = "ignore") -> DataFrame:
    """(value, table, id, action) of exported lines (value) without their header.

    action is an error (parse error, missing table, missing row, unknown table, ns mismatch), or inserted, or, for a row whose id (key for
    preferences) its table in old(id) has, ignored or replaced. Blank lines drop out.
    """
    there = None
    for t, df in old.items():
        one = df.select(F.lit(t).alias("table"), F.col("id").cast("string").alias("id"), F.lit(True).alias("_old")).distinct()
        there = one if there is None else there.unionByName(one)
    rows = lines.filter(F.trim("value") != "").withColumn("j", F.try_parse_json("value"))
    text = lambda path: F.try_variant_get("j", path, "string")
    rows = rows.withColumn("table", text("$.table")).withColumn("id", F.coalesce(text("$.row.id"), text("$.row.key"))).withColumn("ns", text("$.row.namespace"))
    fault = (
        F.when(F.col("j").isNull(), "parse error").when(F.col("table").isNull(), "missing table").when(F.try_variant_get("j", "$.row", "map<string, variant>").isNull(), "missing row")
        .when(~F.col("table").isin(*EXPORTED), "unknown table").when(F.coalesce("ns", F.lit("")) != namespace, "ns mismatch")
    )
    rows = rows.withColumn("fault", fault).drop("j")
    if there is not None:
        rows = rows.join(there, ["table", "id"], "left")
    else:
        rows = rows.withColumn("_old", F.lit(None).cast("boolean"))
    done = F.when(F.coalesce("_old", F.lit(False)), "ignored" if on_conflict == "ignore" else "replaced").otherwise("inserted")
    return rows.select("value", "table", "id", F.coalesce("fault", done).alias("action"))


def import_rows(old: DataFrame, new: DataFrame, key: str, on_conflict: str = "ignore") -> DataFrame:
    """The new rows with what happens to them: inserted, or ignored or replaced if the key is there."""
    there = old.select(key).distinct().withColumn("_old", F.lit(True))
    return new.join(there, key, "left").withColumn("action", F.when(F.col("_old"), "ignored" if on_conflict == "ignore" else "replaced").otherwise("inserted")).drop("_old")


def dialog(lines: DataFrame) -> DataFrame:
    """Content of the user's lines of a session log; malformed and other lines drop out. lines(value)."""
    j = F.from_json("value", "role string, content string")
    return lines.select(j.alias("j")).filter(F.col("j.role").isin("user", "human") & (F.trim("j.content") != "")).select(F.col("j.role").alias("role"), F.col("j.content").alias("content"))


def _docx(data: bytes) -> str:
    import io
    import zipfile
    from xml.etree import ElementTree as X

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = X.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    return "\n\n".join(t for p in body.iter(f"{w}p") if (t := "".join(x.text or "" for x in p.iter(f"{w}t"))))


def _xlsx(data: bytes) -> str:
    import io
    import zipfile
    from xml.etree import ElementTree as X

    m = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = [("".join(t.text or "" for t in si.iter(f"{m}t"))) for si in X.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
    out = []
    for name in sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
        out.append(f"# {name[14:-4]}")
        for row in X.fromstring(z.read(name)).iter(f"{m}row"):
            cells = []
            for c in row.iter(f"{m}c"):
                v = c.find(f"{m}v")
                value = "".join(t.text or "" for t in c.iter(f"{m}t")) if v is None else v.text or ""
                cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
            out.append("\t".join(cells))
    return "\n".join(out)


def extract_files(files: DataFrame) -> DataFrame:
    """(path, text, error) of files(path, content) as the binaryFile source reads them: docx, xlsx, xls, pdf, and plain text.

    Broken files get an error, as do PDFs with hardly any text.
    """
    readers = {".docx": _docx, ".xlsx": _xlsx, ".pdf": pdf.text_of, ".xls": xls.text_of}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for path, data in zip(frame["path"], frame["content"], strict=True):
                low = path.lower()
                try:
                    read = next((f for end, f in readers.items() if low.endswith(end)), lambda b: b.decode("utf-8"))
                    rows.append((path, read(data), None))
                except Exception as e:  # noqa: BLE001  a broken file is a result
                    rows.append((path, None, str(e)[:200]))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, text string, error string")


_TOKEN = re.compile(r'<[^>]*>|"(?:[^"\\]|\\.)*"(?:\^\^\S+|@\w+)?|#[^\n]*|@prefix|@base|_:\w+|[\w\-]*:[\w\-./]*|\ba\b|[;,.]|\S+')


def parse_turtle(text: str, vocabularies: tuple[str, ...]) -> list[tuple[str, str, str]]:
    """(subject, relation, object) of resources whose predicate is a name that stands for a relation, directly under one of the
    vocabularies (IRIs up to their last / or #); prefixes and base are resolved, literals dropped."""
    prefixes: dict[str, str] = {}
    base, out = "", []

    def iri(token: str) -> str | None:
        if token.startswith("<"):
            inner = token[1:-1]
            return inner if ":" in inner or not base else base + inner
        if token.startswith('"'):
            return None
        head, colon, tail = token.partition(":")
        return prefixes.get(head, head + ":") + tail if colon and head != "_" else token

    tokens = [t for t in _TOKEN.findall(text.removeprefix("\ufeff")) if not t.startswith("#")]
    i, subject, predicate, place = 0, None, None, 0
    while i < len(tokens):
        t = tokens[i]
        if t == "@prefix":
            prefixes[tokens[i + 1].rstrip(":")], i = tokens[i + 2][1:-1], i + 4
        elif t == "@base":
            base, i = tokens[i + 1][1:-1], i + 3
        elif t in ".;,":
            place = {".": 0, ";": 1, ",": 2}[t]
            i += 1
        else:
            if place == 0:
                subject, place = iri(t), 1
            elif place == 1:
                predicate, place = iri(t), 2
            else:
                o = iri(t)
                relation = next((RELATION_OF.get(predicate[len(v) :]) for v in vocabularies if predicate and predicate.startswith(v)), None)
                if o and subject and relation:
                    out.append((subject, relation, o))
            i += 1
    return out


def triples(texts: DataFrame, vocabularies: tuple[str, ...]) -> DataFrame:
    """(s, p, o) of whole Turtle texts (value)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield pd.DataFrame([t for text in frame["value"] for t in parse_turtle(text or "", vocabularies)], columns=["s", "p", "o"])

    return texts.select("value").mapInPandas(run, "s string, p string, o string")


def read_triples(spark: SparkSession, path: str, vocabularies: tuple[str, ...]) -> DataFrame:
    """(s, p, o) of the Turtle files under a path."""
    return triples(spark.read.text(path, wholetext=True), vocabularies)


def write_audit(events: DataFrame, path: str, params: str = "params") -> None:
    """Append audit rows, secrets masked, in a folder for each ISO week."""
    from ..functions.text import iso_week, mask_secrets

    events.withColumn(params, mask_secrets(F.col(params))).withColumn("iso_week", iso_week(F.col("ts"))).write.mode("append").partitionBy("iso_week").parquet(path)


def vector_to_bytes(v: Column) -> Column:
    """Little-endian 32-bit floats."""

    def pack(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return F.pandas_udf(pack, "binary")(v)


def bytes_to_vector(b: Column) -> Column:
    """The vector, or null if the bytes are no more than one float or no whole number of them."""

    def unpack(b: pd.Series) -> pd.Series:
        return b.map(lambda x: None if x is None or len(x) <= 4 or len(x) % 4 else np.frombuffer(x, "<f4"))

    return F.pandas_udf(unpack, "array<float>")(b)
