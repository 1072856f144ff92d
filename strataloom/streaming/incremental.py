"""A catalog that follows a growing source tree, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from strataloom.model import TABLES
from strataloom.plans.scan import SCANNERS, first_wins, scanner_ids, union_all
from strataloom.plans.staging import own_files, staged


def follow(files: DataFrame, out: str, checkpoint: str, mode: str = "auto", enabled: tuple[str, ...] = (), groups: tuple[str, ...] = ()) -> StreamingQuery:
    """Appends what each new batch of files (rel_path, content) holds to the tables below out, and goes on.

    A batch's rows carry its number, and a batch that is run again after a failure overwrites its own part, so every
    file counts once. Joins across files see one batch; the catalog's keys are settled when it is read, by catalog().
    """
    chosen = [i for i in scanner_ids(mode, enabled, groups) if i in SCANNERS]

    def take(batch: DataFrame, number: int) -> None:
        tree = staged(batch, chosen)
        for table, df in union_all(batch.sparkSession, (SCANNERS[i].run(own_files(tree, i)) for i in chosen)).items():
            df.write.mode("overwrite").parquet(f"{out}/{table}/batch={number}")

    return files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def catalog(spark, out: str) -> dict[str, DataFrame]:
    """The tables below out as they are now, one row for each key.

    The batches are read by name: what comes later does not change what was asked for, and two catalogs of one folder
    are two relations, so that Spark does not take the one for the other.
    """

    def now(table: str) -> DataFrame:
        root = f"{out}/{table}"
        batches = sorted(r.batch for r in spark.read.parquet(root).select("batch").distinct().collect())
        if not batches:  # no batch has rows
            return spark.read.parquet(root).drop("batch").limit(0)
        return spark.read.option("basePath", root).parquet(*(f"{root}/batch={b}" for b in batches)).drop("batch")

    return {t: first_wins(now(t), t) for t in TABLES}
