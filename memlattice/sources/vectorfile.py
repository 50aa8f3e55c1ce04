"""Binary vector files: a count (unsigned 32 bits), then for each vector the length of its id, the id and its 32-bit floats, all little-endian."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def _bytes(pdf: pd.DataFrame, dim: int) -> bytes:
    out = [struct.pack("<I", len(pdf))]
    for name, v in zip(pdf["id"], pdf["v"], strict=True):
        raw = name.encode()
        x = np.asarray(v, "<f4")
        if len(x) != dim:
            raise ValueError(f"a vector of {len(x)} components among those of {dim}")
        out += [struct.pack("<I", len(raw)), raw, x.tobytes()]
    return b"".join(out)


def _parse(data: bytes, dim: int) -> list[tuple[str, list[float]]]:
    (count,), at, out = struct.unpack_from("<I", data, 0), 4, []
    for _ in range(count):
        (n,) = struct.unpack_from("<I", data, at)
        name, at = data[at + 4 : at + 4 + n].decode(), at + 4 + n
        out.append((name, np.frombuffer(data, "<f4", dim, at).astype(float).tolist()))
        at += 4 * dim
    return out


def save(vectors: DataFrame, path: str, dim: int) -> None:
    """vectors(id, v) as Parquet of one row for each part, (n, data): data is a vector file of its rows. Written by the tasks, in the store that Spark writes to."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"n": [len(pdf)], "data": [_bytes(pdf, dim)]})

    vectors.select("id", "v").mapInPandas(run, "n long, data binary").write.parquet(path)


def load(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """(id, v, error) of what save() wrote, or of plain vector files (*.bin) under a path; a broken file is a row with its error."""
    files = spark.read.format("binaryFile").load(path).selectExpr("content as data") if path.endswith(".bin") else spark.read.parquet(path).select("data")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf["data"]:
                try:
                    got = [(i, v, None) for i, v in _parse(data, dim)]
                except (ValueError, struct.error) as e:
                    got = [(None, None, str(e)[:200])]
                yield pd.DataFrame(got, columns=["id", "v", "error"])

    return files.mapInPandas(run, "id string, v array<double>, error string")
