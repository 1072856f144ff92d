"""Relational queries over model tables that stand for the given tables, and their SQL.

pages are endpoints (component: host), events flows (topic: event type), lineitem dependencies (source: supplier),
supplier components (repository: nation), orders with customers relationships, documents files and outcomes of scans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions.text import base_path, make_id
from strataloom.operators import relational as rel
from strataloom.operators.schema_lang import crud_flows, event_endpoints
from strataloom.plans import render
from strataloom.model import KEYS
from strataloom.plans.corpus import derived_files, keys_sql
from strataloom.plans.scan import SCANNERS, first_wins, registry, scan, scan_with_runs
from strataloom.plans.staging import outcomes, scan_runs, staged
from strataloom.plans.text_oracles import runs_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def endpoints(spark: SparkSession, sf: str) -> DataFrame:
    p = _t(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("component_id"), F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1).alias("path"))
    method = F.element_at(F.array(*(F.lit(m) for m in ("GET", "POST", "PUT", "DELETE"))), (F.col("page_id") % 4 + 1).cast("int"))
    return p.select(F.lit("pages").alias("scanner_id"), F.col("component_id").alias("rel_path"), F.col("page_id").cast("int").alias("pos"), "component_id", F.lit("REST").alias("type"), "path", method.alias("method"), F.lit(None).cast("string").alias("request_schema"), F.lit(None).cast("string").alias("response_schema"))


ENDPOINTS = """ep AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS component_id,
  regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS path,
  list_extract(['GET', 'POST', 'PUT', 'DELETE'], (page_id % 4 + 1)::INT) AS method FROM pages)"""


def components(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.element_at(F.array(*(F.lit(m) for m in ("SERVICE", "LIBRARY", "EXTERNAL"))), (F.col("s_suppkey") % 3 + 1).cast("int"))
    s = _t(spark, sf, "supplier").join(_t(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(F.lit("supplier").alias("scanner_id"), F.lit("").alias("rel_path"), F.lit(0).alias("pos"), F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), kind.alias("type"), F.col("n_name").alias("repository"))


COMPONENTS = """comp AS (SELECT s_suppkey::VARCHAR AS id, s_name AS name,
  list_extract(['SERVICE', 'LIBRARY', 'EXTERNAL'], (s_suppkey % 3 + 1)::INT) AS type, n_name AS repository
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def dependencies(spark: SparkSession, sf: str) -> DataFrame:
    s = lambda c: F.col(c).cast("string")
    return _t(spark, sf, "lineitem").select(F.lit("lineitem").alias("scanner_id"), s("l_orderkey").alias("rel_path"), F.col("l_linenumber").cast("int").alias("pos"), s("l_suppkey").alias("source_component_id"), F.lit("part").alias("group_id"), s("l_partkey").alias("artifact_id"), s("l_linenumber").alias("version"), F.lit("compile").alias("scope"), (F.col("l_returnflag") != "R").alias("direct"))


DEPENDENCIES = """dep AS (SELECT l_orderkey::VARCHAR AS rel_path, l_linenumber AS pos, l_suppkey::VARCHAR AS source_component_id,
  'part' AS group_id, l_partkey::VARCHAR AS artifact_id, l_linenumber::VARCHAR AS version, l_returnflag <> 'R' AS direct FROM lineitem)"""


def flows(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    user = F.concat(F.lit("user"), F.col("user_id").cast("string"))
    return _t(spark, sf, "events").select(F.lit("events").alias("scanner_id"), F.lit("").alias("rel_path"), e.cast("int").alias("pos"), e.alias("event_id"), F.when(e % 7 != 0, user).alias("publisher_component_id"), F.concat(F.lit("svc"), (e % 5).cast("string")).alias("subscriber_component_id"), F.col("event_type").alias("topic"), F.when(e % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("broker"), (e % 2).cast("string"))).alias("broker"))


FLOWS = """fl AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN 'user' || user_id END AS publisher_component_id,
  'svc' || event_id % 5 AS subscriber_component_id, event_type AS topic,
  CASE WHEN event_id % 3 <> 0 THEN 'broker' || event_id % 2 END AS broker FROM events)"""


def relationships(spark: SparkSession, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders").join(_t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.lit("orders").alias("scanner_id"), F.lit("").alias("rel_path"), F.col("o_orderkey").cast("int").alias("pos"), F.col("c_custkey").cast("string").alias("source_id"), F.col("c_nationkey").cast("string").alias("target_id"), F.col("o_orderpriority").alias("type"))


RELATIONSHIPS = "rl AS (SELECT c_custkey::VARCHAR AS source_id, c_nationkey::VARCHAR AS target_id, o_orderpriority AS type FROM orders JOIN customer ON o_custkey = c_custkey)"


def files(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("rel_path"), F.col("text").alias("content"))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """A scan run for each source: documents without a label were not scanned, toxic ones failed."""
    d = _t(spark, sf, "documents").join(_t(spark, sf, "labels"), "doc_id", "left")
    by = d.groupBy(F.col("source").alias("scanner_id")).agg(F.count("toxic").alias("scanned"), F.count_if((F.col("toxic") == 0) & (F.col("quality") == 1)).alias("parsed"), F.count_if((F.col("toxic") == 0) & (F.col("quality") == 0)).alias("fallback"), F.count_if(F.col("toxic") == 1).alias("failed"), F.count_if(F.col("toxic").isNull()).alias("skipped"))
    return by.withColumns({"success": F.col("failed") < 3, "error": F.when(F.col("failed") >= 3, F.concat(F.col("failed").cast("string"), F.lit(" files failed"))), "warning": F.when(F.col("skipped") > F.col("scanned"), F.concat(F.col("skipped").cast("string"), F.lit(" files skipped")))})


RUNS = """rn AS (SELECT source AS scanner_id, count(toxic) AS scanned, count(*) FILTER (toxic = 0 AND quality = 1) AS parsed,
  count(*) FILTER (toxic = 0 AND quality = 0) AS fallback, count(*) FILTER (toxic = 1) AS failed, count(*) FILTER (toxic IS NULL) AS skipped
  FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source)"""


@query(f"WITH {ENDPOINTS} SELECT component_id, method, path, min(page_id) AS first_page FROM ep GROUP BY ALL")
def endpoint_dedup(spark, sf):
    return first_wins(endpoints(spark, sf), "api_endpoints").select("component_id", "method", "path", F.col("pos").cast("long").alias("first_page"))


@query(f"WITH {ENDPOINTS} SELECT component_id, count(*) AS n, string_agg(DISTINCT method, ',' ORDER BY method) AS methods FROM ep GROUP BY 1")
def endpoints_by_component(spark, sf):
    return rel.endpoint_groups(endpoints(spark, sf))


@query(f"WITH {ENDPOINTS} SELECT page_id, CASE WHEN b = '' THEN '/' ELSE b END AS base FROM (SELECT page_id, regexp_replace(regexp_replace(path, '/:[^/]+', '', 'g'), '(.)/$', '\\1') AS b FROM ep)")
def base_path_normalize(spark, sf):
    return endpoints(spark, sf).select(F.col("pos").cast("long").alias("page_id"), base_path(F.col("path")).alias("base"))


@query(f"""WITH {ENDPOINTS}, b AS (SELECT *, CASE WHEN regexp_replace(path, '(.)/$', '\\1') = '' THEN '/' ELSE regexp_replace(path, '(.)/$', '\\1') END AS base FROM ep)
SELECT base AS topic, arg_min(component_id, (component_id, page_id)) AS publisher_component_id, arg_min(component_id, (component_id, page_id)) AS subscriber_component_id, 'restful-crud' AS broker
FROM b GROUP BY base HAVING bool_or(method IN ('POST', 'PUT', 'PATCH')) AND bool_or(method = 'GET')""")
def crud_patterns(spark, sf):
    return crud_flows(endpoints(spark, sf)).select("topic", "publisher_component_id", "subscriber_component_id", "broker")


#: Paths of pages, every seventh below /events and every fifth with a past-tense verb at its end.
EVENT_PATHS = """ev AS (SELECT page_id, component_id, method, CASE WHEN page_id % 7 = 0 THEN '/events' || path
  WHEN page_id % 5 = 0 THEN regexp_replace(path, '/$', '') || '/order-created' ELSE path END AS path FROM ep)"""


@query(f"""WITH {ENDPOINTS}, {EVENT_PATHS} SELECT page_id, component_id, path FROM ev
WHERE regexp_matches(lower(path), '/events/|/domain-events/|/webhooks/|/notifications/|-events/|/event/') OR (method = 'POST' AND regexp_matches(lower(path), '[-_/](created|updated|deleted|removed|completed|processed|confirmed|approved|rejected|cancelled|failed|succeeded|registered|activated|deactivated|suspended|reserved|released|allocated|assigned)([-_/]|$)'))""")
def rest_event_endpoints(spark, sf):
    p = F.col("path")
    path = F.when(F.col("pos") % 7 == 0, F.concat(F.lit("/events"), p)).when(F.col("pos") % 5 == 0, F.concat(F.regexp_replace(p, "/$", ""), F.lit("/order-created"))).otherwise(p)
    return event_endpoints(endpoints(spark, sf).withColumn("path", path)).select(F.col("pos").cast("long").alias("page_id"), F.col("subscriber_component_id").alias("component_id"), F.col("topic").alias("path"))


@query(f"WITH {DEPENDENCIES} SELECT group_id, artifact_id, version, count(*) AS n, arg_min(source_component_id, (rel_path, pos, source_component_id)) AS source FROM dep GROUP BY ALL")
def dependency_dedup(spark, sf):
    """Of equal rows the first by path, place and source, and how many there are: one aggregate."""
    return first_wins(dependencies(spark, sf), "dependencies", "n").select("group_id", "artifact_id", "version", "n", F.col("source_component_id").alias("source"))


@query(f"WITH {DEPENDENCIES} SELECT source_component_id, count(*) AS n, count(DISTINCT artifact_id) AS artifacts, count(*) FILTER (direct) AS direct FROM dep GROUP BY 1")
def dependency_matrix(spark, sf):
    return rel.dependency_matrix(dependencies(spark, sf))


@query(f"WITH {DEPENDENCIES} SELECT count(*) FILTER (direct) AS direct, count(*) FILTER (NOT direct) AS transitive FROM dep")
def dependency_direct_transitive(spark, sf):
    return rel.direct_and_transitive(dependencies(spark, sf))


@query(f"WITH {DEPENDENCIES}, {COMPONENTS} SELECT rel_path, pos, coalesce(name, source_component_id, '-') AS component_name FROM dep LEFT JOIN comp ON id = source_component_id AND type <> 'EXTERNAL'")
def component_name_lookup(spark, sf):
    known = components(spark, sf).where("type <> 'EXTERNAL'")
    return rel.component_names(dependencies(spark, sf), "source_component_id", known).select("rel_path", "pos", "component_name")


@query(f"""WITH {COMPONENTS}, e AS (SELECT (page_id % 97)::VARCHAR AS id, count(*) AS n FROM pages GROUP BY 1), x AS (SELECT l_suppkey::VARCHAR AS id, count(*) AS n FROM lineitem GROUP BY 1)
SELECT comp.id, name, coalesce(e.n, 0) AS endpoints, coalesce(x.n, 0) AS entities FROM comp LEFT JOIN e USING (id) LEFT JOIN x USING (id)""")
def component_counts(spark, sf):
    e = endpoints(spark, sf).select((F.col("pos") % 97).cast("string").alias("component_id"))
    return rel.component_counts(components(spark, sf), e, dependencies(spark, sf).select(F.col("source_component_id").alias("component_id")))


@query(f"WITH {COMPONENTS} SELECT type, count(*) AS n, count(DISTINCT repository) AS repositories FROM comp GROUP BY 1")
def components_by_type(spark, sf):
    return rel.components_by_type(components(spark, sf))


@query(f"WITH {COMPONENTS} SELECT id, name FROM comp WHERE type <> 'EXTERNAL' ORDER BY id LIMIT 20")
def context_systems_top20(spark, sf):
    return rel.external_systems(components(spark, sf), False).select("id", "name")


@query(f"WITH {FLOWS} SELECT topic, count(*) AS n, count(DISTINCT publisher_component_id) AS publishers, count(DISTINCT subscriber_component_id) AS subscribers, arg_min(broker, event_id) FILTER (broker IS NOT NULL) AS broker FROM fl GROUP BY topic")
def flows_by_topic(spark, sf):
    return rel.flows_by_topic(flows(spark, sf), ["event_id"])


@query(f"WITH {FLOWS} SELECT topic, publisher_component_id, subscriber_component_id, min(event_id) AS first_event FROM fl GROUP BY ALL")
def flow_dedup(spark, sf):
    return first_wins(flows(spark, sf), "message_flows").select("topic", "publisher_component_id", "subscriber_component_id", F.col("event_id").alias("first_event"))


@query(f"WITH {RELATIONSHIPS} SELECT source_id, target_id, type, count(*) AS n FROM rl GROUP BY ALL")
def relationship_dedup(spark, sf):
    return first_wins(relationships(spark, sf), "relationships", "n").select("source_id", "target_id", "type", "n")


@query(f"WITH {RELATIONSHIPS}, {COMPONENTS}, n AS (SELECT id, min(name) AS name FROM comp GROUP BY id) SELECT source_id, target_id, coalesce(a.name, source_id) AS source_name, coalesce(b.name, target_id) AS target_name FROM rl LEFT JOIN n a ON a.id = source_id LEFT JOIN n b ON b.id = target_id")
def service_call_edges(spark, sf):
    return rel.edges_with_names(relationships(spark, sf), components(spark, sf)).select("source_id", "target_id", "source_name", "target_name")


@query(f"WITH {FLOWS} SELECT event_id FROM fl WHERE EXISTS (SELECT 1 FROM part WHERE lower(p_name) LIKE '%a%')")
def dependency_gate_semi(spark, sf):
    parts = _t(spark, sf, "part").select(F.col("p_brand").alias("group_id"), F.col("p_name").alias("artifact_id")).where(F.lower("p_name").contains("a"))
    return rel.gated(flows(spark, sf), parts.select(F.lit("a").alias("group_id"), "artifact_id"), ["a"]).select("event_id")


@query("SELECT DISTINCT source AS scanner_id FROM documents WHERE source NOT IN (SELECT DISTINCT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND doc_id % 2 = 0)")
def unknown_scanner_ids_anti(spark, sf):
    seen = _t(spark, sf, "documents").join(_t(spark, sf, "labels").where("toxic = 1"), "doc_id").where("doc_id % 2 = 0")
    known = registry(spark).select("scanner_id").unionByName(seen.select(F.col("source").alias("scanner_id")))
    return rel.unknown_ids(_t(spark, sf, "documents").select(F.col("source").alias("scanner_id")), known)


@query(f"WITH {RUNS} SELECT scanner_id, scanned, CASE WHEN scanned = 0 THEN 0 ELSE 100.0 * parsed / scanned END AS success_rate, CASE WHEN scanned = 0 THEN 0 ELSE 100.0 * (parsed + fallback) / scanned END AS overall_rate, CASE WHEN scanned = 0 THEN 0 ELSE 100.0 * failed / scanned END AS failure_rate FROM rn")
def scan_rates(spark, sf):
    return rel.scan_rates(runs(spark, sf))


@query(f"""WITH {RUNS} SELECT scanner_id, 'ERROR' AS severity, failed || ' files failed' AS message FROM rn WHERE failed >= 3
UNION ALL SELECT scanner_id, 'WARNING', skipped || ' files skipped' FROM rn WHERE skipped > scanned
UNION ALL SELECT scanner_id, 'WARNING', 'high failure rate' FROM rn WHERE scanned > 0 AND 100.0 * failed / scanned > 20""")
def quality_gaps(spark, sf):
    return rel.quality_gaps(runs(spark, sf))


@query("SELECT lang AS error_type, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY 1 ORDER BY n DESC, error_type LIMIT 10")
def error_histogram_top10(spark, sf):
    d = _t(spark, sf, "documents").join(_t(spark, sf, "labels").where("toxic = 1"), "doc_id")
    return rel.error_histogram(d.select(F.col("lang").alias("error_type")))


@query("SELECT count(DISTINCT doc_id) AS files FROM documents WHERE lang IN ('en', 'fr')")
def file_count_distinct(spark, sf):
    return rel.files_in(files(spark, sf), ["**/*.en", "**/*.fr"])


CATEGORIES = {"english": ["**/*.en", "src0/*.en"], "romance": ["**/*.fr", "**/*.es"], "none": ["**/*.java"]}


@query("""WITH e AS (SELECT 'english' AS category, count(*) FILTER (lang = 'en') + count(*) FILTER (lang = 'en' AND source = 'src0') AS expected FROM documents
UNION ALL SELECT 'romance', count(*) FILTER (lang IN ('fr', 'es')) FROM documents),
f AS (SELECT CASE lang WHEN 'en' THEN 'english' ELSE 'romance' END AS category, count(*) AS found FROM documents JOIN labels USING (doc_id) WHERE lang IN ('en', 'fr', 'es') GROUP BY 1)
SELECT category, expected, coalesce(found, 0) AS found, least(100.0, 100.0 * coalesce(found, 0) / expected) AS coverage FROM e LEFT JOIN f USING (category)""")
def coverage_by_category(spark, sf):
    d = _t(spark, sf, "documents").join(_t(spark, sf, "labels"), "doc_id").where("lang IN ('en', 'fr', 'es')")
    found = d.groupBy(F.when(F.col("lang") == "en", "english").otherwise("romance").alias("category")).agg(F.count("*").alias("found"))
    return rel.coverage(rel.expected_files(files(spark, sf), CATEGORIES), found)


@query(f"WITH {ENDPOINTS} SELECT 'components' AS entity, count(*) AS n FROM supplier UNION ALL SELECT 'dependencies', count(*) FROM (SELECT DISTINCT l_partkey, l_linenumber FROM lineitem) UNION ALL SELECT 'api_endpoints', count(*) FROM (SELECT DISTINCT component_id, method, path FROM ep)")
def summary_counts(spark, sf):
    return rel.table_counts({"components": first_wins(components(spark, sf), "components"), "dependencies": first_wins(dependencies(spark, sf), "dependencies"), "api_endpoints": first_wins(endpoints(spark, sf), "api_endpoints")})


@query("SELECT s_suppkey, substr(sha256('maven|' || s_name || '|null'), 1, 16) AS id FROM supplier")
def component_ids(spark, sf):
    return _t(spark, sf, "supplier").select("s_suppkey", make_id("maven", F.col("s_name"), F.lit(None)).alias("id"))


@query("SELECT n AS entity_name, 'team_id' AS field, 'teams' AS target FROM (SELECT 'users' || s_suppkey AS n FROM supplier)")
def er_fk_inference(spark, sf):
    f = lambda n: F.struct(F.lit(n).alias("name"), F.lit("INTEGER").alias("data_type"), F.lit(True).alias("nullable"))
    s = _t(spark, sf, "supplier")
    users = s.select(F.concat(F.lit("users"), F.col("s_suppkey").cast("string")).alias("name"), F.array(f("id"), f("team_id"), f("paid")).alias("fields"))
    teams = s.select(F.lit("teams").alias("name"), F.array(f("id")).alias("fields")).distinct()
    return rel.inferred_keys(users.unionByName(teams)).withColumnRenamed("name", "entity_name")


def _keys(table: str) -> str:
    """The keys of a table of the derived tree's catalog; flows with those derived from paths that are read and written."""
    sql = keys_sql(table, KEYS[table])
    if table != "message_flows":
        return sql
    base = "regexp_replace(regexp_replace(regexp_replace(path, '/\\{[^}]+\\}', '', 'g'), '/:[^/]+', '', 'g'), '(.)/$', '\\1')"
    return f"""{sql}
UNION SELECT CASE WHEN {base} = '' THEN '/' ELSE {base} END AS topic, 'derived', 'derived' FROM ({keys_sql("api_endpoints", ["method", "path"])})
GROUP BY 1 HAVING bool_or(method IN ('POST', 'PUT', 'PATCH')) AND bool_or(method = 'GET')"""


@query("\nUNION ALL ".join(f"SELECT '{t}' AS entity, count(*) AS n FROM ({_keys(t)})" for t in KEYS))
def scan_all(spark, sf):
    """The whole catalog of the derived tree, counted by table."""
    return rel.table_counts(scan(derived_files(spark, sf)))


@query(f"""WITH {DEPENDENCIES} SELECT DISTINCT '    ' || source_component_id || CASE WHEN direct THEN ' --> ' ELSE ' -.-> ' END || 'part_' || artifact_id AS line FROM dep
UNION ALL SELECT '```mermaid' UNION ALL SELECT 'graph LR'""")
def render_dependency_graph(spark, sf):
    return render.dependency_graph(dependencies(spark, sf)).select("line")


@query(f"""WITH {FLOWS} SELECT DISTINCT '    ' || publisher_component_id || ' --> topic_' || regexp_replace(topic, '[^a-zA-Z0-9_]', '_', 'g') AS line FROM fl WHERE publisher_component_id IS NOT NULL
UNION ALL SELECT DISTINCT '    topic_' || regexp_replace(topic, '[^a-zA-Z0-9_]', '_', 'g') || ' --> ' || subscriber_component_id FROM fl
UNION ALL SELECT '```mermaid' UNION ALL SELECT 'graph LR'""")
def render_message_flow(spark, sf):
    return render.message_flow_graph(flows(spark, sf)).select("line")


@query(f"""WITH {COMPONENTS}, {RELATIONSHIPS} SELECT '    ' || CASE WHEN type = 'EXTERNAL' THEN 'System_Ext' ELSE 'System' END || '(' || id || ', "' || name || '")' AS line FROM comp
UNION ALL SELECT DISTINCT '    Rel(' || source_id || ', ' || target_id || ', "' || type || '")' FROM rl
UNION ALL SELECT '```mermaid' UNION ALL SELECT 'C4Context'""")
def render_c4_context(spark, sf):
    return render.c4_context(components(spark, sf), relationships(spark, sf)).select("line")


@query(f"""WITH {ENDPOINTS}, {COMPONENTS} SELECT DISTINCT '| ' || replace(component_id, '|', '\\|') || ' | ' || method || ' | ' || replace(path, '|', '\\|') || ' | - |' AS line FROM ep
UNION ALL SELECT unnest(['# API catalog', '', '| Component | Method | Path | Request |', '|---|---|---|---|'])""")
def render_api_catalog(spark, sf):
    return render.api_catalog(endpoints(spark, sf), components(spark, sf)).select("line")


@query(None)
def render_all(spark, sf):
    """Lines of every document of the derived tree's catalog, counted by document."""
    catalog, runs = scan_with_runs(derived_files(spark, sf))
    return render.documents(catalog, rel.table_counts(catalog), runs=runs).groupBy("path").agg(F.count("*").alias("n"))


def _tree(spark: SparkSession, sf: str) -> DataFrame:
    return staged(derived_files(spark, sf), list(SCANNERS))


TREE_RUNS = runs_sql()


@query(f"{TREE_RUNS} SELECT scanner_id, discovered, scanned, parsed, fallback, failed FROM rn")
def tree_scan_runs(spark, sf):
    """What became of the files of the derived tree with each scanner."""
    return scan_runs(_tree(spark, sf)).select("scanner_id", "discovered", "scanned", "parsed", "fallback", "failed")


@query(f"""{TREE_RUNS} SELECT scanner_id, scanned, CASE WHEN scanned = 0 THEN 0 ELSE 100.0 * parsed / scanned END AS success_rate,
CASE WHEN scanned = 0 THEN 0 ELSE 100.0 * (parsed + fallback) / scanned END AS overall_rate, CASE WHEN scanned = 0 THEN 0 ELSE 100.0 * failed / scanned END AS failure_rate FROM rn""")
def tree_scan_rates(spark, sf):
    return rel.scan_rates(scan_runs(_tree(spark, sf)))


@query(f"{TREE_RUNS} SELECT sum(scanned)::BIGINT AS files_analysed, sum(discovered)::BIGINT AS files_discovered FROM rn")
def tree_files_analysed(spark, sf):
    """A file counts once for each scanner that scans it."""
    return scan_runs(_tree(spark, sf)).agg(F.sum("scanned").alias("files_analysed"), F.sum("discovered").alias("files_discovered"))


@query(f"""{TREE_RUNS} SELECT 'HIGH' AS confidence, sum(parsed)::BIGINT AS n FROM rn UNION ALL SELECT 'MEDIUM', sum(fallback)::BIGINT FROM rn""")
def tree_confidence(spark, sf):
    """Scanned files by the confidence of what was found in them."""
    return outcomes(_tree(spark, sf)).where("confidence IS NOT NULL").groupBy("confidence").agg(F.count("*").alias("n"))


@query(f"""{TREE_RUNS} SELECT error_type, count(*) AS n, array_to_string(list_sort(list(DISTINCT rel_path || ': ' || error_type))[1:10], ';') AS details FROM broken GROUP BY 1""")
def tree_error_details(spark, sf):
    return rel.error_details(outcomes(_tree(spark, sf))).withColumn("details", F.array_join("details", ";"))


@query(f"""{TREE_RUNS} SELECT scanner_id, 'ERROR' AS severity, failed || ' files failed' AS message FROM rn WHERE failed > 0 AND failed = scanned
UNION ALL SELECT scanner_id, 'WARNING', concat_ws('; ', CASE WHEN failed > 0 AND failed < scanned THEN failed || ' files failed' END, CASE WHEN fallback > 0 THEN fallback || ' files by fallback' END)
FROM rn WHERE (failed > 0 AND failed < scanned) OR fallback > 0
UNION ALL SELECT scanner_id, 'WARNING', 'high failure rate' FROM rn WHERE scanned > 0 AND 100.0 * failed / scanned > 20""")
def tree_quality_gaps(spark, sf):
    return rel.quality_gaps(scan_runs(_tree(spark, sf)))
