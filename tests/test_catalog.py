"""Text functions, keys, derived flows, quality figures, documents, streaming and the driver contract."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strataloom import api
from strataloom.functions import text
from strataloom.operators import relational as rel
from strataloom.operators.schema_lang import rest_event_flow
from strataloom.plans import render
from strataloom.plans.corpus import derived_files
from strataloom.plans.scan import empty, first_wins, scan
from strataloom.streaming import incremental

SF = "/root/testdata/sf0.001"


def evaluated(spark, rows, f):
    return [r.y for r in spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "k int, x string").select("k", f(F.col("x")).alias("y")).orderBy("k").collect()]


def test_text_functions(spark):
    assert evaluated(spark, ["OrderItem", "HTTPServer", "already_snake"], text.snake_case) == ["order_item", "http_server", "already_snake"]
    assert evaluated(spark, ["order-created", "a_b", ""], text.pascal_case) == ["OrderCreated", "AB", ""]
    assert evaluated(spark, ["category", "bus", "day", "dish"], text.plural) == ["categories", "buses", "days", "dishes"]
    assert evaluated(spark, ["/users/{id}", "/a/:x/b/", "/", "/{id}"], text.base_path) == ["/users", "/a/b", "/", "/"]
    assert evaluated(spark, ["/api/v1/orders", "/api", "/s"], text.resource_name) == ["Order", "Resource", "S"]
    assert evaluated(spark, ["a", None], lambda c: text.make_id("x", c)) == evaluated(spark, ["x|a", "x|null"], lambda c: F.substring(F.sha2(c, 256), 1, 16))
    assert evaluated(spark, ["/x", "x/", "", None], lambda c: text.join_paths(F.lit("/api/"), c)) == ["/api/x", "/api/x", "/api", "/api"]


@pytest.mark.parametrize(("glob", "path", "fits"), [("**/pom.xml", "pom.xml", False), ("**/pom.xml", "a/b/pom.xml", True), ("src/*.py", "src/a.py", True), ("src/*.py", "src/a/b.py", False), ("a?.x", "ab.x", True)])
def test_globs(spark, glob, path, fits):
    assert evaluated(spark, [path], lambda c: c.rlike(text.glob_regex(glob))) == [fits]


ENDPOINT = "scanner_id string, rel_path string, pos int, component_id string, type string, path string, method string, request_schema string, response_schema string"


def flows(spark, *ends):
    df = spark.createDataFrame([("s", "f", k, "c", "REST", p, m, req, res) for k, (m, p, req, res) in enumerate(ends)], ENDPOINT)
    return {(r.topic, r.message_type, r.broker) for r in rest_event_flow(df)["message_flows"].collect()}


def test_events_are_known_by_path_verb_or_schema(spark):
    assert flows(spark, ("POST", "/events/order", None, None)) == {("/events/order", "OrderEvent", "rest-event")}
    assert flows(spark, ("POST", "/order-created", None, None)) == {("/order-created", "OrderCreatedEvent", "rest-event")}
    assert flows(spark, ("GET", "/order-created", None, None)) == set()
    assert flows(spark, ("PUT", "/x", "PaidEvent", None)) == {("/x", "PaidEvent", "rest-event")}
    assert flows(spark, (None, "/plain", None, None)) == set()


def test_crud_needs_reads_and_writes(spark):
    assert flows(spark, ("POST", "/api/orders", None, None), ("GET", "/api/orders/{id}", None, None)) == {("/api/orders", "OrderEvent", "restful-crud")}
    assert flows(spark, ("DELETE", "/a", None, None), ("GET", "/a", None, None)) == set()
    assert flows(spark, ("post", "/a", None, None), ("get", "/a", None, None)) == set()


def test_first_of_equal_rows_by_priority_path_and_place(spark):
    rows = [("rails-route", "b", 0, "c", "REST", "/p", "GET", "late", None), ("spring-rest-api", "z", 1, "c", "REST", "/p", "GET", "second", None), ("spring-rest-api", "a", 9, "c", "REST", "/p", None, "other", None), ("jaxrs-api", "z", 0, "c", "REST", "/p", "GET", "first", None)]
    out = first_wins(spark.createDataFrame(rows, ENDPOINT).repartition(3), "api_endpoints").collect()
    assert {r.request_schema for r in out} == {"first", "other"}
    assert first_wins(empty(spark, "components"), "components").count() == 0


def test_quality_figures(spark):
    runs = spark.createDataFrame([("a", 10, 7, 2, 1, True, None, None), ("b", 0, 0, 0, 0, False, "boom", "slow"), ("c", 4, 1, 1, 2, True, None, None)], "scanner_id string, scanned int, parsed int, fallback int, failed int, success boolean, error string, warning string")
    assert {r.scanner_id: (r.success_rate, r.overall_rate, r.failure_rate) for r in rel.scan_rates(runs).collect()} == {"a": (70, 90, 10), "b": (0, 0, 0), "c": (25, 50, 50)}
    assert {(r.scanner_id, r.severity, r.message) for r in rel.quality_gaps(runs).collect()} == {("b", "ERROR", "boom"), ("b", "WARNING", "slow"), ("c", "WARNING", "high failure rate")}
    both = rel.coverage(spark.createDataFrame([("x", 4), ("y", 0), ("z", 0)], "category string, expected int"), spark.createDataFrame([("x", 1), ("z", 9)], "category string, found int"))
    assert {r.category: r.coverage for r in both.collect()} == {"x": 25.0, "z": 100.0}


def test_lookups_and_gates(spark):
    comp = spark.createDataFrame([("1", "one", "SERVICE"), ("2", "two", "EXTERNAL")], "id string, name string, type string")
    used = spark.createDataFrame([("1",), ("9",), (None,)], "component_id string")
    assert sorted(r.component_name for r in rel.component_names(used, "component_id", comp).collect()) == ["-", "9", "one"]
    dep = spark.createDataFrame([("org.Spring", "x")], "group_id string, artifact_id string")
    assert rel.gated(used, dep, ["spring"]).count() == 3 and rel.gated(used, dep, ["kafka"]).count() == 0
    assert [r.id for r in rel.external_systems(comp, False).collect()] == ["1"]
    named = {r.level: r.n for r in rel.confidence(spark, spark.createDataFrame([("components", 3), ("dependencies", 5)], "entity string, n long")).collect()}
    assert named == {"HIGH": 3, "MEDIUM": 0, "LOW": 0}


def test_whole_scan_of_a_tree_on_disk(spark, tmp_path):
    for r in derived_files(spark, SF).where("rel_path LIKE '%s1/%' OR rel_path LIKE '%app1/%'").collect():
        p = tmp_path / "src" / r.rel_path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(r.content)
    got = api.scan_tree(spark, str(tmp_path / "src"), api.Config.from_dict({"scanners": {"groups": ["go", "java"]}}), output=str(tmp_path / "out"))
    assert {r.technology for r in got["components"].collect()} == {"Go", "Maven", "Gradle", "Spring"}
    made = {str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*.*")}
    assert {"mermaid/dependency-graph.md", "markdown/index.md", "json/system.json", "markdown/quality.md"} <= made
    links = re.findall(r"\]\(([^)]+)\)", (tmp_path / "out/markdown/index.md").read_text())
    assert len(links) == 6 and {f"markdown/{x}" for x in links} <= made
    assert got["scan_runs"].where("scanner_id = 'go-modules' AND discovered = 1 AND parsed = 1").count() == 1
    assert api.project_type(spark.createDataFrame([("go.mod",), ("a/pom.xml",)], "rel_path string")).first().type == "go"


def test_documents_and_their_order(spark):
    found = scan(derived_files(spark, SF).where("rel_path LIKE 's1/%'"), "explicit", ["jpa-entities", "sql-migration"])
    lines = [r.line.strip() for r in render.er_diagram(found["data_entities"]).orderBy("part", "at", "line").collect()]
    assert lines[:2] == ["```mermaid", "erDiagram"] and "Long id PK" in lines and lines.count("}") == 4
    assert lines.index("ORDER_ITEM {") < lines.index("Long id PK") < lines.index("int quantity")


def test_diff_and_streaming(spark, tmp_path):
    tree = derived_files(spark, SF).where("rel_path LIKE '%s1/%' OR rel_path LIKE '%s2/%'")
    tree.where("rel_path LIKE '%s1/%'").write.parquet(f"{tmp_path}/in")
    files = spark.readStream.schema("rel_path string, content string").parquet(f"{tmp_path}/in")
    follow = lambda: incremental.follow(files, f"{tmp_path}/out", f"{tmp_path}/check", "groups", groups=("go",)).awaitTermination()
    follow()
    before = incremental.catalog(spark, f"{tmp_path}/out")
    assert before["components"].count() == 1 and before["dependencies"].count() == 3
    tree.where("rel_path LIKE '%s2/%'").write.mode("append").parquet(f"{tmp_path}/in")
    follow()
    after = incremental.catalog(spark, f"{tmp_path}/out")
    assert {r.name for r in after["components"].collect()} == {"example.org/shop1", "example.org/shop2"}
    changes = api.diff(before, after, ["components"]).collect()
    assert [r.change for r in changes] == ["added"]


def test_driver_contract(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 80
    assert entry.entry(spark).count() == 6
