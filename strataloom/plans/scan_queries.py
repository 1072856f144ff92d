"""Queries that run each scanner over the tree derived from the suppliers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.plans import text_oracles
from strataloom.plans.corpus import SAMPLES, derived_files, expected_sql
from strataloom.plans.scan import SCANNERS

Query = Callable[[SparkSession, str], DataFrame]


def fields_text(fields: str = "fields"):
    """name:type:nullable of each field, joined by commas."""
    return F.array_join(F.transform(fields, lambda f: F.concat(f["name"], F.lit(":"), f["data_type"], F.lit(":"), f["nullable"].cast("string"))), ",")


def _query(scanner: str, table: str, columns: list[str]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = SCANNERS[scanner].run(derived_files(spark, sf_dir))[table]
        return found.select(*(fields_text().alias("fields") if c == "fields" else F.col(c) for c in columns))

    return run


QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_seen: dict[tuple[str, str], int] = {}
for _sample in SAMPLES:
    for _table, (_columns, _) in _sample.finds.items():
        if (_sample.scanner, _table) in _seen:
            continue
        _k = _seen[_sample.scanner, _table] = sum(s == _sample.scanner for s, _ in _seen)
        _name = f"scan_{_sample.scanner.replace('-', '_')}" + (f"_{_table}" if _k else "")
        QUERIES[_name] = _query(_sample.scanner, _table, _columns.split())
        ORACLES[_name] = expected_sql(_sample.scanner, _table)
# where the syntax allows, SQL that reads the texts takes the place of what they are expected to yield
ORACLES |= text_oracles.ORACLES
