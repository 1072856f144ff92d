"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.sources.tables import scratch, shared_dir, written

__all__ = ["BitFilter", "ascii_lower", "row_key", "scratch", "shared_dir", "strip_spaces", "table", "words", "written"]
#: The white space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only; other letters stay as they are. Where there are no others, lower() does the same faster."""
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def strip_spaces(col: Column) -> Column:
    return F.btrim(col, F.lit(SPACES))


def words(col: Column) -> Column:
    """The maximal runs of characters that are not in SPACES; null and blank texts have none."""
    bare = F.coalesce(strip_spaces(col), F.lit(""))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_CLASS))


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Two columns without nulls that tell rows apart by id and text.

    Rows that agree in both are copies of one row, for which every operator here decides alike.
    """
    return [
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("_rk_id"),
        F.xxhash64(F.col(text_col)).alias("_rk_text"),
    ]


class BitFilter:
    """A set of longs as bits of their hashes, 16 for each but 32 MB in all at most, so it can be broadcast at any size.

    It lets members through and, the fuller it is, others too: a step that thins rows before a join, not a test. Of more
    members than a few 10 ** 7 it thins less and less, and what follows has more rows to look at.
    """

    LEAST, MOST, BLOCK = 20, 28, 15

    def __init__(self, spark: SparkSession, bits: bytes, log: int):
        self.bits, self.log = spark.sparkContext.broadcast(bits), log

    @staticmethod
    def _places(x: np.ndarray, log: int) -> np.ndarray:
        h = np.asarray(x, np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - log)

    @classmethod
    def of(cls, df: DataFrame, col: str, n: int) -> BitFilter:
        """Of a column with about n longs. Members meet by blocks of bits, and a block comes to the driver as one row."""
        log = min(cls.MOST, max(cls.LEAST, int(16 * n).bit_length()))
        size = 1 << cls.BLOCK

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.unique(cls._places(batch.column(0).to_numpy(), log)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((at >> cls.BLOCK).astype(np.int32)), pa.array((at & (size - 1)).astype(np.int32))], ["block", "bit"])

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, own in zip(*(batch.column(c) for c in (0, 1)), strict=True):
                    bits = np.zeros(size, bool)
                    bits[own.values.to_numpy()] = True
                    yield pa.RecordBatch.from_arrays([pa.array([block.as_py()], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])

        held = np.zeros((1 << log) // 8, np.uint8)
        at = df.select(F.col(col).cast("long")).where(F.col(col).isNotNull()).mapInArrow(places, "block int, bit int")
        blocks = at.groupBy("block").agg(F.collect_set("bit")).mapInArrow(packed, "block int, bits binary")
        for r in blocks.collect():  # 2 ** (MOST - BLOCK) rows of 4 KB at most
            held[r.block * size // 8 : (r.block + 1) * size // 8] = np.frombuffer(r.bits, np.uint8)
        return cls(df.sparkSession, held.tobytes(), log)

    def holds(self, x: np.ndarray) -> np.ndarray:
        bits, at = np.frombuffer(self.bits.value, np.uint8), self._places(x, self.log)
        return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def where(self, df: DataFrame, col: str, held: bool = True) -> DataFrame:
        @F.pandas_udf("boolean")
        def test(x: pd.Series) -> pd.Series:
            return pd.Series(self.holds(x.to_numpy(np.int64)) == held)

        return df.where(test(F.col(col)))
