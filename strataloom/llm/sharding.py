"""Shards of near-equal size by sampled splitters.

Records are keyed by a hash of their text, then by id, so equal texts lie side by side. A sample of keys, drawn in
proportion to the records' sizes, gives quantile boundaries; records are range-partitioned by them, and ranges that
turn out overfull are subdivided. The bytes before each range are then known exactly, so every record's place in the
whole order is too, and the order is cut into shards of equal bytes to within one record.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.llm.common import written

#: Ranges for each shard, and sampled keys for each range: together they bound what comes to the driver.
RANGES_A_SHARD, KEYS_A_RANGE = 8, 24
#: A range with more than so many times the mean bytes is subdivided.
OVERFULL = 2.0
#: Bytes of a record besides its text.
OVERHEAD = 16


def _sortable(key: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Pairs of longs as 16-byte strings in the same order."""
    out = np.empty((len(key), 2), ">u8")
    for k, x in enumerate((key, tie)):
        out[:, k] = np.asarray(x, np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return out.reshape(-1).view("S16")


def _splitters(sample: np.ndarray, n: int) -> np.ndarray:
    """n - 1 quantiles of the sorted sample at most, without repeats."""
    at = (np.arange(1, n) * len(sample)) // n
    return np.unique(sample[at[at < len(sample)]]) if len(sample) else sample


def shard_by_bytes(
    df: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, whole_groups: float = 0.05
) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of each row, under the law `bytes`.

    size: UTF-8 bytes of the text plus 16; a null text has none and the CRC of nothing, 0. slot: gapless from 0 in
    each shard. Rows with equal texts stay together where they hold at most `whole_groups` of a shard's bytes, by which
    shards may then differ; larger groups are cut like any range, as else shards would not be near equal. Rows that tie,
    of one id and different texts too, are in the order of the texts' hashes. Null ids sort first. Repeated rows are rows of their own. An empty table gives no rows.
    Which boundaries the sample gives affects only the work of each task, not the result. grown_shard is null.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("_size"),
        F.crc32(F.encode(text, "UTF-8")).alias("_crc"),
        F.xxhash64(text).alias("_key"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("_tie"),
    )
    rows = written(rows, "shard-keys")  # some 30 bytes a row: texts are read once
    total = rows.agg(F.coalesce(F.sum("_size"), F.lit(0)).alias("t")).first().t
    n_ranges = n_shards * RANGES_A_SHARD
    share = F.least(F.lit(1.0), F.col("_size") * (n_ranges * KEYS_A_RANGE / max(1, total)))
    drawn = rows.where(F.rand(seed) < share).select("_key", "_tie").toPandas()  # n_ranges * KEYS_A_RANGE on average
    sample = np.sort(_sortable(drawn["_key"].to_numpy(np.int64), drawn["_tie"].to_numpy(np.int64)))
    splitters = _splitters(sample, n_ranges)

    def ranged(bounds: np.ndarray) -> DataFrame:
        @F.pandas_udf("int")
        def place(key: pd.Series, tie: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(bounds, _sortable(key.to_numpy(), tie.to_numpy()), "right").astype(np.int32))

        return rows.withColumn("_range", place("_key", "_tie"))

    def counted(r: DataFrame) -> pd.DataFrame:  # a row for each range
        return r.groupBy("_range").agg(F.sum("_size").alias("bytes"), F.count("*").alias("n")).toPandas().sort_values("_range")

    placed = ranged(splitters)
    counts = counted(placed)
    while True:
        full = counts[counts["bytes"] > OVERFULL * max(1, total) / n_ranges]
        more = []
        for r, size in zip(full["_range"], full["bytes"], strict=True):
            low = splitters[r - 1] if r > 0 else b""
            own = sample[(sample > low) & ((sample < splitters[r]) if r < len(splitters) else True)]
            more.append(_splitters(own, int(size * n_ranges // max(1, total)) + 1))
        finer = np.unique(np.concatenate([splitters, *more]))
        if len(finer) == len(splitters):  # none is overfull, or the sample has no key within those that are
            break
        splitters = finer
        placed = ranged(splitters)
        counts = counted(placed)
    before = pd.DataFrame({"_range": counts["_range"].astype("int32"), "_bytes0": counts["bytes"].cumsum() - counts["bytes"], "_n0": counts["n"].cumsum() - counts["n"]})
    spark = df.sparkSession
    offsets = spark.createDataFrame(list(before.itertuples(index=False, name=None)), "_range int, _bytes0 long, _n0 long")
    own = Window.partitionBy("_range").orderBy("_key", "_tie")
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = (
        placed.withColumns({"_sum": F.sum("_size").over(upto), "_rn": F.row_number().over(own)})
        .join(F.broadcast(offsets), "_range")  # a row for each range
        .select("_id", "_size", "_crc", "_key", (F.col("_bytes0") + F.col("_sum") - F.col("_size")).alias("_before"), (F.col("_n0") + F.col("_rn") - 1).alias("_at"))
    )
    shard_of = lambda start, size: F.least(F.lit(n_shards - 1), F.floor((2 * start + size) * n_shards / (2 * max(1, total)))).cast("int")
    cut = written(ordered.withColumn("_shard", shard_of(F.col("_before"), F.col("_size"))), "shard-order")
    # groups across a cut: one for each cut at most, as groups lie side by side
    split = cut.groupBy("_key").agg(F.min("_shard").alias("_a"), F.max("_shard").alias("_b"), F.min("_before").alias("_start"), F.sum("_size").alias("_all"))
    split = split.where((F.col("_a") != F.col("_b")) & (F.col("_all") <= whole_groups * total / n_shards)).select("_key", shard_of(F.col("_start"), F.col("_all")).alias("_moved"))
    kept = cut.join(F.broadcast(split), "_key", "left").withColumn("_shard", F.coalesce("_moved", "_shard"))
    starts = kept.groupBy("_shard").agg(F.min("_at").alias("_from"))  # a row for each shard
    return kept.join(F.broadcast(starts), "_shard").select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_crc").cast("long").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("_shard").alias("shard"),
        (F.col("_at") - F.col("_from")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
