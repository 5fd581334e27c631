"""Helpers shared by the operators: tables in the shared folder, row keys, word splitting."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize, shared_dir

__all__ = ["LAST_ID", "ascii_words", "bounds", "crc_mod", "materialize", "partitions", "shared_dir", "slices", "text_key", "with_row_key"]

#: Rows without an id are ordered after every row that has one.
LAST_ID = 2**63 - 1


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_key(text):
    return F.xxhash64(text)


def with_row_key(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Adds ``mf_id`` (the id, null last) and ``mf_key`` (a hash of the text): rows equal in both are the same document."""
    return df.withColumns({"mf_id": F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)), "mf_key": text_key(F.col(text_col))})


def ascii_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` in UTF-8, A-Z lower-cased; none for null."""
    return text.encode().lower().split() if text else []


def bounds(lengths: np.ndarray) -> np.ndarray:
    """Start of every run of the given lengths, and the end of the last."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def crc_mod(col: str, m: int):
    """crc32 of the id as text, modulo ``m`` (null for a null id)."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % m


def slices(batches, most_bytes: int = 24 << 20, column: str = "text"):
    """Arrow record batches cut so that each holds at most about ``most_bytes`` of text."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = max(1, batch.column(batch.schema.get_field_index(column)).nbytes)
        step = max(1, int(n * most_bytes / size)) if size > most_bytes else n
        for at in range(0, n, step):
            yield batch.slice(at, step)
