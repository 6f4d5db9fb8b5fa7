"""Helpers that several training-data operators share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: True for bytes of words: all but space and \t \n \v \f \r.
WORD_BYTE = np.ones(256, dtype=bool)
WORD_BYTE[[0x20, *range(0x09, 0x0E)]] = False

#: Arrow batches are worked through in runs of texts of about so many bytes.
RUN_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is named, a local session (one machine, as in tests) gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="lapwing-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality of the key columns."""
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def running(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column | str], sums: dict[str, str]) -> DataFrame:
    """Exclusive running totals inside each key that never put a whole key into one task.

    ``bucket`` splits a key into runs that keep its ``order``. Each run is totalled first,
    the small table of totals is accumulated per key, and a window inside the run adds the rest.
    ``sums`` maps new columns to the columns that they accumulate; ``"1"`` counts rows.
    """
    b, carry = "__bucket", {new: f"__carry_{i}" for i, new in enumerate(sums)}
    value = {new: F.lit(1) if of == "1" else F.col(of) for new, of in sums.items()}
    df = df.withColumn(b, bucket)
    within = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, b).agg(*[F.sum(value[new]).alias(carry[new]) for new in sums])
    totals = totals.select(*keys, b, *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(c) for c in carry.values()])
    run = Window.partitionBy(*keys, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.select("*", *[F.coalesce(F.sum(value[new]).over(run), F.lit(0)).alias(new) for new in sums])
    out = rows.join(totals, same(rows, totals, [*keys, b]), "left")
    return out.select(*[rows[c] for c in rows.columns if c != b and c not in sums], *[(rows[new] + totals[carry[new]]).alias(new) for new in sums])


def hashed_sample(df: DataFrame, text_col: str, most: int) -> list[str]:
    """At most ``most`` different texts, those with the least hashes; only hashes are ordered, so no partition sends texts that are not chosen."""
    hashed = df.where(F.col(text_col).isNotNull()).select(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    least = [r["h"] for r in hashed.select("h").distinct().orderBy("h").limit(most).collect()] if most else []
    if not least:
        return []
    found = hashed.where(F.col("h") <= least[-1]).groupBy("h").agg(F.min("text").alias("text"))
    return [r["text"] for r in sorted(found.collect(), key=lambda r: r["h"])]


#: Bits of ``marks``: 8 MB, whatever the number of rows.
MARK_BITS = 26


def marks(rows: DataFrame, column: str):
    """A test of 64-bit hashes against ``column`` of ``rows``: never false for one of them, true by chance for few others while
    rows are fewer than bits. A bitmap of fixed size, for tasks to leave rows out of a shuffle that it need not see."""
    words = rows.groupBy(F.shiftrightunsigned(column, 70 - MARK_BITS).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - MARK_BITS}) & 63 as int))")).alias("bits"))
    found = words.toArrow()  # at most 2**MARK_BITS / 64 rows
    bits = np.zeros(1 << (MARK_BITS - 6), dtype=np.int64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(bits.view(np.uint64))

    def test(hashes: np.ndarray) -> np.ndarray:
        place = hashes.view(np.uint64) >> np.uint64(64 - MARK_BITS)
        return (shared.value[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)

    return test


def word_counts(texts: pa.Array) -> np.ndarray:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in each text; null: 0."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or at[-1] == at[0]:
        return np.zeros(len(texts), dtype=np.int64)
    word = WORD_BYTE[np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]]]
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    begins = at[:-1][at[:-1] < at[-1]] - at[0]
    starts[begins] = word[begins]
    return np.diff(np.searchsorted(np.flatnonzero(starts), at - at[0])).astype(np.int64)


def runs(texts: pa.Array, most: int = RUN_BYTES, count: int = 1 << 30):
    """(start, list of bytes) over runs of at most ``count`` texts of about ``most`` bytes; null: empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    ends = np.cumsum(np.fromiter((len(x.as_buffer()) if x.is_valid else 0 for x in texts), dtype=np.int64, count=len(texts)))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        stop = min(stop, start + count)
        yield start, texts.slice(start, stop - start).to_pylist()
        start = stop
