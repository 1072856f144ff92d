"""The tables of the architecture catalog and the keys by which their rows are one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = "array<struct<name:string,data_type:string,nullable:boolean>>"
#: Columns of each table, with types; all but `direct` and `fields` are strings.
TABLES = {
    "components": {c: "string" for c in ("id", "name", "type", "description", "technology", "repository")},
    "dependencies": {c: "string" for c in ("source_component_id", "group_id", "artifact_id", "version", "scope")} | {"direct": "boolean"},
    "relationships": {c: "string" for c in ("source_id", "target_id", "type", "description", "technology")},
    "api_endpoints": {c: "string" for c in ("component_id", "type", "path", "method", "description", "request_schema", "response_schema", "authentication")},
    "message_flows": {c: "string" for c in ("publisher_component_id", "subscriber_component_id", "topic", "message_type", "schema", "broker")},
    "data_entities": {"component_id": "string", "name": "string", "type": "string", "fields": FIELDS, "primary_key": "string", "description": "string"},
}
#: Rows of a table that agree in these are one.
KEYS = {
    "components": ["id"],
    "dependencies": ["group_id", "artifact_id", "version"],
    "relationships": ["source_id", "target_id", "type"],
    "api_endpoints": ["component_id", "method", "path"],
    "message_flows": ["topic", "publisher_component_id", "subscriber_component_id"],
    "data_entities": ["component_id", "name"],
}
#: Where a row was found: the order in which the first of equal rows is chosen.
ORIGIN = {"scanner_id": "string", "rel_path": "string", "pos": "int"}


def rows(table: str, df: DataFrame, scanner_id: str, **columns: Column | str) -> DataFrame:
    """df as rows of a model table: given columns by name, the others null, with their origin."""
    unknown = set(columns) - set(TABLES[table])
    if unknown:
        raise ValueError(f"{table} has no {unknown}")
    if table == "dependencies":
        columns["scope"] = F.coalesce(columns.get("scope", F.lit(None)), F.lit("compile"))
        columns.setdefault("direct", F.lit(True))
    made = [(columns[c] if isinstance(columns.get(c), Column) else F.lit(columns.get(c))).cast(t).alias(c) for c, t in TABLES[table].items()]
    pos = F.col("pos") if "pos" in df.columns else F.lit(0)
    out = df.select(F.lit(scanner_id).alias("scanner_id"), F.col("rel_path"), pos.cast("int").alias("pos"), *made)
    if table == "message_flows":
        out = out.where("publisher_component_id IS NOT NULL OR subscriber_component_id IS NOT NULL")
    return out
