"""Questions to the catalog: joins, groups, quality figures. Inputs are model tables, outputs DataFrames."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.functions.text import glob_regex


def component_names(df: DataFrame, id_col: str, components: DataFrame, out: str = "component_name") -> DataFrame:
    """Adds the name of the component; its id where it is unknown, `-` where it is null."""
    names = components.groupBy("id").agg(F.min("name").alias(out)).withColumnRenamed("id", id_col)
    return df.join(names, id_col, "left").withColumn(out, F.coalesce(out, id_col, F.lit("-")))


def component_counts(components: DataFrame, endpoints: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, name, endpoints, entities): counted before the join, so no pairs arise."""
    count = lambda df, n: df.groupBy(F.col("component_id").alias("id")).agg(F.count("*").alias(n))
    out = components.select("id", "name").join(count(endpoints, "endpoints"), "id", "left").join(count(entities, "entities"), "id", "left")
    return out.fillna(0, ["endpoints", "entities"])


def endpoint_groups(endpoints: DataFrame) -> DataFrame:
    """(component_id, n, methods): endpoints by component."""
    return endpoints.groupBy("component_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("method")), ",").alias("methods"))


def dependency_matrix(dependencies: DataFrame) -> DataFrame:
    """(source_component_id, n, artifacts, direct): dependencies by source."""
    return dependencies.groupBy("source_component_id").agg(F.count("*").alias("n"), F.countDistinct("group_id", "artifact_id").alias("artifacts"), F.count_if("direct").alias("direct"))


def direct_and_transitive(dependencies: DataFrame) -> DataFrame:
    return dependencies.agg(F.count_if("direct").alias("direct"), F.count_if(~F.col("direct")).alias("transitive"))


def components_by_type(components: DataFrame) -> DataFrame:
    return components.groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("repository").alias("repositories"))


def flows_by_topic(flows: DataFrame, order: Sequence[str]) -> DataFrame:
    """(topic, n, publishers, subscribers, broker): the broker is the first, by order, that is not null."""
    first = F.min_by("broker", F.when(F.col("broker").isNotNull(), F.struct(*order)))
    return flows.groupBy("topic").agg(F.count("*").alias("n"), F.countDistinct("publisher_component_id").alias("publishers"), F.countDistinct("subscriber_component_id").alias("subscribers"), first.alias("broker"))


def inferred_keys(entities: DataFrame) -> DataFrame:
    """(name, field, target): fields `x_id` or `xId` that point to an entity named x or xs, in any case; the smallest."""
    fields = entities.select("name", F.explode("fields.name").alias("field"))
    stems = fields.withColumn("stem", F.lower(F.regexp_extract("field", r"^(.+?)(?:_id|Id)$", 1))).where("stem <> ''")
    named = entities.select(F.col("name").alias("target"), F.lower("name").alias("key")).distinct()
    wanted = stems.withColumn("key", F.explode(F.array("stem", F.concat("stem", F.lit("s")))))
    return wanted.join(named, "key").where(F.col("target") != F.col("name")).groupBy("name", "field").agg(F.min("target").alias("target"))


def gated(df: DataFrame, dependencies: DataFrame, words: Iterable[str]) -> DataFrame:
    """df if some dependency's group or artifact holds one of the words, else none of it."""
    pattern = "|".join(words)
    hit = dependencies.where(F.lower("group_id").rlike(pattern) | F.lower("artifact_id").rlike(pattern)).limit(1).select(F.lit(1).alias("_gate"))
    return df.withColumn("_gate", F.lit(1)).join(F.broadcast(hit), "_gate", "left_semi").drop("_gate")


def unknown_ids(configured: DataFrame, available: DataFrame) -> DataFrame:
    """The configured scanner ids that do not exist."""
    return configured.select("scanner_id").distinct().join(available.select("scanner_id"), "scanner_id", "left_anti")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(entity, n): a row for each table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("entity"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def files_in(files: DataFrame, globs: Sequence[str]) -> DataFrame:
    """(files): distinct paths that one glob or more select."""
    return files.where(F.col("rel_path").rlike("|".join(glob_regex(g) for g in globs))).agg(F.countDistinct("rel_path").alias("files"))


def expected_files(files: DataFrame, categories: dict[str, Sequence[str]]) -> DataFrame:
    """(category, expected): a file counts once for each glob that selects it. One pass over the paths."""
    sums = [F.coalesce(F.sum(sum((F.col("rel_path").rlike(glob_regex(g)).cast("long") for g in globs), F.lit(0))), F.lit(0)).alias(c) for c, globs in categories.items()]
    return files.agg(*sums).unpivot([], list(categories), "category", "expected")


def coverage(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(category, expected, found, coverage): in per cent, 100 at most; categories with neither are left out."""
    both = expected.join(found, "category", "full").select("category", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("expected", "found"))).where("expected > 0 OR found > 0")
    return both.withColumn("coverage", F.when(F.col("expected") == 0, F.lit(100.0)).otherwise(F.least(F.lit(100.0), 100.0 * F.col("found") / F.col("expected"))))


def scan_rates(runs: DataFrame) -> DataFrame:
    """(scanner_id, scanned, success_rate, overall_rate, failure_rate) in per cent; 0 where nothing was scanned."""
    total = runs.groupBy("scanner_id").agg(*(F.sum(c).alias(c) for c in ("scanned", "parsed", "fallback", "failed")))
    rate = lambda c: F.when(F.col("scanned") == 0, F.lit(0.0)).otherwise(100.0 * c / F.col("scanned"))
    return total.select("scanner_id", "scanned", rate(F.col("parsed")).alias("success_rate"), rate(F.col("parsed") + F.col("fallback")).alias("overall_rate"), rate(F.col("failed")).alias("failure_rate"))


def quality_gaps(runs: DataFrame, most_failures: float = 20.0) -> DataFrame:
    """(scanner_id, severity, message): scanners that failed, that warned, or that failed on too many files."""
    failed = runs.where(~F.col("success")).select("scanner_id", F.lit("ERROR").alias("severity"), F.coalesce("error", F.lit("unknown error")).alias("message"))
    warned = runs.where(F.col("warning").isNotNull()).select("scanner_id", F.lit("WARNING").alias("severity"), F.col("warning").alias("message"))
    share = F.when(F.col("scanned") == 0, F.lit(0.0)).otherwise(100.0 * F.col("failed") / F.col("scanned"))
    rated = runs.where(share > most_failures).select("scanner_id", F.lit("WARNING").alias("severity"), F.lit("high failure rate").alias("message"))
    return failed.unionByName(warned).unionByName(rated)


def error_details(outcomes: DataFrame, most: int = 10) -> DataFrame:
    """(error_type, n, details): the first `most` details of each error type, in order; the limit is the report's.

    The filter on the rank is the window's own limit, so each task passes on its first `most` of a type and no more; a
    frequent error's details are dealt out to buckets and ranked there before the buckets' first meet.
    """
    known = outcomes.where(F.col("error_type").isNotNull())
    bucket = F.pmod(F.xxhash64("detail"), F.lit(64)).alias("bucket")
    by = lambda *keys: F.row_number().over(Window.partitionBy("error_type", *keys).orderBy("detail"))
    distinct = known.select("error_type", "detail", bucket).distinct()
    few = distinct.withColumn("rank", by("bucket")).where(F.col("rank") <= most).drop("rank")
    first = few.withColumn("rank", by()).where(F.col("rank") <= most)
    listed = first.groupBy("error_type").agg(F.array_sort(F.collect_list("detail")).alias("details"))
    return known.groupBy("error_type").agg(F.count("*").alias("n")).join(listed, "error_type")


def error_histogram(outcomes: DataFrame, most: int = 10) -> DataFrame:
    """(error_type, n): the most frequent errors; the limit is the report's."""
    return outcomes.where(F.col("error_type").isNotNull()).groupBy("error_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error_type").limit(most)


def external_systems(components: DataFrame, include_external: bool, most: int = 20) -> DataFrame:
    """The systems of a context diagram; without external ones, the first `most` by id."""
    if include_external:
        return components
    return components.where("type <> 'EXTERNAL'").orderBy("id").limit(most)


def edges_with_names(relationships: DataFrame, components: DataFrame) -> DataFrame:
    """relationships with source_name and target_name; an end that is no component keeps its id."""
    return component_names(component_names(relationships, "source_id", components, "source_name"), "target_id", components, "target_name")


def confidence(spark: SparkSession, counts: DataFrame) -> DataFrame:
    """(level, n): all findings but dependencies and relationships count as HIGH."""
    n = counts.where(~F.col("entity").isin("dependencies", "relationships")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return n.select(F.explode(F.array(*(F.struct(F.lit(x).alias("level"), (F.col("n") if x == "HIGH" else F.lit(0).cast("long")).alias("n")) for x in ("HIGH", "MEDIUM", "LOW")))).alias("c")).select("c.*")
