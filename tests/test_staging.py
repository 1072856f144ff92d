"""The tree read once, broken files among it, gates, runs, configuration and the JSON document."""

import dataclasses
import json
from importlib.util import find_spec

import pytest
from pyspark.sql import functions as F

from strataloom import api
from strataloom.functions import text
from strataloom.operators import gates
from strataloom.operators import relational as rel
from strataloom.plans import render, staging
from strataloom.plans import scan as scan_module
from strataloom.plans.corpus import derived_files
from strataloom.plans.scan import SCANNERS, scan, scan_with_runs
from strataloom.sources.files import one_pass, read_files
from strataloom.sources.tables import release, scratch, written

SF = "/root/testdata/sf0.001"
POM = "<project><groupId>g</groupId><artifactId>a</artifactId><dependencies><dependency><groupId>org.springframework</groupId><artifactId>spring-web</artifactId></dependency></dependencies></project>"
SERVICE = "package p;\nimport org.springframework.stereotype.*;\n@Service\npublic class S {}\n"


def tree_of(spark, files):
    return spark.createDataFrame(files, "rel_path string, content string")


def test_broken_and_huge_files_leave_a_scan_whole(spark):
    long = "x" * 100_000
    files = [
        ("a/pom.xml", POM), ("b/pom.xml", "<project><artifactId>torn"), ("c/pom.xml", "<project><dependency><groupId>x.y</groupId><artifactId>z</artifactId></dependency>"),
        ("a/package.json", "{"), ("a/pyproject.toml", "= ="), ("a/x.avsc", "{]"), ("a/S.java", SERVICE), ("a/nothing.java", None),
        ("a/C.java", f'package p;\n@RestController\n@Other("{long}")\n@Deep(a(b), "{"(x)" * 25_000}")\npublic class C {{\n  @GetMapping("/{long[:50]}")\n  public String get() {{ return ""; }}\n}}\n'),
        ("a/api.py", f'from fastapi import FastAPI\n@app.get("/long", responses={{"a": ({long!r})}})\ndef f():\n    pass\n@app.get("/many", x={"(1), " * 20_000})\ndef g():\n    pass\n'),
        ("a/big.proto", "message M {" + "oneof o { string a = 1; } " * 5_000 + "}"),
    ]
    catalog, runs = scan_with_runs(tree_of(spark, files))
    assert {r.name for r in catalog["components"].collect()} >= {"a", "S"}
    assert {r.artifact_id for r in catalog["dependencies"].collect()} == {"spring-web", "z"}
    assert {r.path for r in catalog["api_endpoints"].collect()} == {f"/{long[:50]}", "/long", "/many"}
    got = {r.scanner_id: r for r in runs.collect()}
    maven = got["maven-dependencies"]
    assert (maven.discovered, maven.scanned, maven.parsed, maven.fallback, maven.failed) == (3, 3, 1, 1, 1) and maven.success
    assert maven.summary == "Discovered: 3, Scanned: 3, Success: 1 (33.3%), Fallback: 1, Failed: 1 (33.3%)"
    assert not got["npm-dependencies"].success and got["npm-dependencies"].error == "1 files failed"
    assert got["spring-rest-api"].discovered == 2 and got["spring-rest-api"].scanned == 1 and got["spring-rest-api"].skipped == 1
    assert {(r.scanner_id, r.severity) for r in rel.quality_gaps(runs).collect()} >= {("npm-dependencies", "ERROR"), ("maven-dependencies", "WARNING")}


def test_outcomes_errors_and_their_details(spark):
    files = [(f"d{k}/package.json", "{") for k in range(15)] + [("a/pom.xml", POM), ("b/pom.xml", "<project>"), ("c/pom.xml", "<project><dependency>")]
    tree = staging.staged(tree_of(spark, files), list(SCANNERS))
    found = staging.outcomes(tree)
    assert {(r.rel_path, r.outcome, r.confidence) for r in found.where("scanner_id = 'maven-dependencies'").collect()} == {("a/pom.xml", "parsed", "HIGH"), ("b/pom.xml", "failed", None), ("c/pom.xml", "fallback", "MEDIUM")}
    errors = {r.error_type: (r.n, len(r.details)) for r in rel.error_details(found).collect()}
    assert errors == {"malformed JSON": (15, 10), "malformed XML": (2, 2)}


def test_the_source_is_read_once(spark, tmp_path):
    derived_files(spark, SF).write.parquet(f"{tmp_path}/in")
    catalog = scan(spark.read.parquet(f"{tmp_path}/in"))
    assert all(str(tmp_path) not in df._jdf.queryExecution().toString() for df in catalog.values())


def test_every_scanner_is_staged():
    assert set(staging.LOOKS) == set(SCANNERS)


def test_gates(spark):
    none = tree_of(spark, [("a/x.py", "import os")])
    dep = spark.createDataFrame([("com.rabbitmq", "client"), ("x", None)], "group_id string, artifact_id string")
    value = lambda gate, files=none, deps=dep: gates.evidence(files, deps).agg(gate.alias("g")).first().g
    assert value(gates.uses("rabbitmq")) and not value(gates.uses("kafka"))
    assert value(gates.has_files("**/*.py") & ~gates.has_files("**/*.java")) and value(gates.uses("kafka") | gates.always())
    assert not value(gates.never()) and not value(gates.has_file_containing("flask")) and value(gates.has_file_containing("os", "flask"))
    assert not value(gates.has_files("**/*"), none.limit(0), dep.limit(0))
    tree = staging.staged(none, list(SCANNERS))
    applies = {r.scanner_id: r.applies for r in gates.applicable(tree, dep.where("group_id = 'x'"), staging.LOOKS).collect()}
    assert set(applies) == set(gates.GATES) and not any(applies.values())
    service = tree_of(spark, [("a/S.java", SERVICE)])
    assert scan(service)["components"].count() == 0 and scan(service, gated=False)["components"].count() == 1
    assert scan(service.unionByName(tree_of(spark, [("a/pom.xml", POM)])))["components"].count() == 2


def test_configuration(spark, tmp_path):
    given = {"project": {"name": "p", "version": 2}, "repositories": [{"name": "r", "path": f"{tmp_path}/r"}, {"name": "no path"}], "generators": {"enabled": ["json"]}, "output": {"directory": f"{tmp_path}/out"}, "scanners": {"mode": "auto", "config": {"rest-event-flow": {"detectCrudPatterns": False}}}, "unknown": 1}
    (tmp_path / "c.json").write_text(json.dumps(given))
    c = api.Config.from_file(spark, f"{tmp_path}/c.json")
    assert (c.project, c.version, c.repositories, c.detect_crud) == ("p", "2", [("r", f"{tmp_path}/r")], False)
    assert c.get("rest-event-flow", "detectCrudPatterns", True) is False and c.get("x", "y", 3) == 3
    (tmp_path / "bad.json").write_text("{: [")
    assert api.Config.from_file(spark, f"{tmp_path}/bad.json") == api.Config() == api.Config.from_file(spark, f"{tmp_path}/none.json")
    for where in ("root/a", "r/b"):
        (tmp_path / where).mkdir(parents=True)
        (tmp_path / where / "go.mod").write_text(f"module {where}\n")
    got = api.scan_tree(spark, f"{tmp_path}/root", c)
    assert {r.rel_path: r.name for r in got["components"].collect()} == {"a/go.mod": "root/a", "r/b/go.mod": "r/b"}
    assert {str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*") if p.is_file() and p.suffix != ".crc"} == {"json/system.json"}
    (tmp_path / "c.yaml").write_text("scanners:\n  mode: groups\n")
    if find_spec("yaml") is None:
        with pytest.raises(RuntimeError, match="YAML"):
            api.Config.from_file(spark, f"{tmp_path}/c.yaml")
    assert {r.kind for r in api.listing(spark).collect()} == {"scanner", "generator", "renderer"} and api.listing(spark).where("kind = 'scanner'").count() == 42


def test_json_document(spark):
    rows = [("1", 'Order "X" Service', "SERVICE", "Spring", None), ("2", "tools", "LIBRARY", None, "g/tools.git"), ("3", "db", "DATABASE", "?", None)]
    comp = spark.createDataFrame(rows, "id string, name string, type string, technology string, repository string")
    lines = [r.line for r in render.system_json(comp, 'my "p"', "d").orderBy("part", "at", "line").collect()]
    made = json.loads("".join(lines))
    assert made["name"] == 'my "p"' and made["extensions"] == ["java"]
    paths = {c["name"]: [f["pathPattern"] for f in c["files"]] for c in made["logicalComponents"]}
    assert paths['Order "X" Service'][0] == "**/orderx/**" and paths["tools"] == ["**/tools/**", "lib/tools/**", "gtools/**"] and "**/db/**" in paths["db"]
    assert sorted(r.extension for r in render.extensions(comp.where("id = '3'")).collect()) == sorted(render.COMMON_EXTENSIONS)
    assert json.loads("".join(r.line for r in render.system_json(comp.limit(0), "p").orderBy("part", "at", "line").collect()))["logicalComponents"] == []


@pytest.mark.parametrize(
    ("f", "cases"),
    [
        (lambda c: text.method_path(F.lit("/api/"), c), {"x": "/api/x", "/x": "/api/x", "": "/api/"}),
        (lambda c: text.method_path(F.lit(""), c), {"x": "/x", "": "/"}),
        (lambda c: text.resource_path(F.lit(""), c), {"": "/", "x": "/x"}),
        (lambda c: text.group_path(c, F.lit("y")), {"": "y", "/g": "/g/y"}),
        (lambda c: text.template_path(F.lit("api"), c), {"~/a": "/a", "b": "/api/b"}),
        (text.unquoted, {" 'a' ": "a", '"b': '"b', "`c`": "c"}),
        (text.is_comment, {"  // x": True, "# x": True, "-- x": True, "/* x": True, "* x": True, "x // y": False}),
        (lambda c: text.part_of(c, 1, 3), {"abcd": "bc", "a": "", "ab": "b"}),
        (text.extension, {"a/b.Tar.GZ": "gz", "a.b/c": ""}),
        (lambda c: text.xml_attribute(c, "Include"), {'<X Include="a" />': "a", "<X/>": None}),
        (text.json_list, {'["a",1]': ["a", "1"], "a": ["a"]}),
        (lambda c: text.json_text(c, "$.a"), {'{"a": 1}': "1", "{": None}),
        (lambda c: text.first_per_line(c, r"(a\d)"), {"a1 a2\nb\r\na3": ["a1", "a3"]}),
        (lambda c: text.coverage_text(c, F.lit(47), F.lit(95.7)), {"45": "45/47 (96%)"}),
    ],
)
def test_text_helpers(spark, f, cases):
    df = spark.createDataFrame([(k,) for k in cases], "x string").select("x", f(F.col("x")).alias("y"))
    assert {r.x: r.y for r in df.collect()} == cases


def test_scratch_is_released(spark, tmp_path):
    df = written(spark.range(3), "numbers")
    assert df.count() == 3 and scratch(spark, "x") != scratch(spark, "x")
    folder = df.inputFiles()[0]
    release(spark)
    with pytest.raises(Exception, match="."):
        spark.read.parquet(folder).count()


def test_a_scanner_that_breaks_off_leaves_the_others(spark, monkeypatch, tmp_path):
    calls = []

    def counted(scanner):
        def run(files):
            calls.append(scanner.id)
            return scanner.run(files)

        return dataclasses.replace(scanner, run=run)

    def torn(files):
        return {"components": files.select(F.raise_error(F.lit("torn")).alias("id"))}

    own = {i: counted(s) for i, s in SCANNERS.items()}
    monkeypatch.setattr(scan_module, "SCANNERS", own | {"go-modules": dataclasses.replace(SCANNERS["go-modules"], run=torn)})
    files = derived_files(spark, SF).where("rel_path RLIKE '(7|8)/'")
    catalog, runs = scan_with_runs(files, into=f"{tmp_path}/scan")
    assert [(r.scanner_id, r.severity) for r in rel.quality_gaps(runs).where("severity = 'ERROR'").collect() if "torn" in r.message] == [("go-modules", "ERROR")]
    assert {r.id for r in catalog["components"].collect()} and not catalog["dependencies"].where("scanner_id = 'go-modules'").count()
    assert catalog["dependencies"].where("scanner_id = 'maven-dependencies'").count()
    monkeypatch.setattr(scan_module, "SCANNERS", own)
    calls.clear()
    again, runs = scan_with_runs(files, into=f"{tmp_path}/scan")
    assert calls == ["go-modules"] and again["dependencies"].where("scanner_id = 'go-modules'").count()
    assert not [r for r in rel.quality_gaps(runs).collect() if "torn" in r.message]


def test_words_are_found_in_one_pass(spark):
    words = ["KafkaListener", "Kafka", "Listener", "net/http", "`", ".Map", "a.b"]
    texts = ["x KafkaListenerX", "Kafka KafkaListene", "`net/http`", "aab a.b.Map", "", "none"]
    df = spark.createDataFrame([(t,) for t in texts], "content string")
    found = df.select("content", F.array_distinct(F.regexp_extract_all("content", F.lit(one_pass(words)), F.lit(1))).alias("w")).collect()
    for r in found:
        assert {w for w in words if any(f.startswith(w) for f in r.w)} == {w for w in words if w in r.content}


def test_documents_bear_their_names(spark, tmp_path, capsys):
    lines = [("markdown/index.md", 0, f"{k:04}", f"line {k}") for k in range(40)] + [("json/a.json", 0, "0", "{}"), ("markdown/b.md", 0, "0", "# b")]
    df = spark.createDataFrame(lines, render.LINE).repartition(7)
    for _ in range(2):
        assert render.write_documents(df, f"{tmp_path}/out") == ["json/a.json", "markdown/b.md", "markdown/index.md"]
        assert (tmp_path / "out/markdown/index.md").read_text() == "".join(f"line {k}\n" for k in range(40))
    split = render.write_documents(df, f"{tmp_path}/split", file_lines=10)
    assert len(split) > 3 and all(x.startswith("markdown/index.") for x in split if x not in ("json/a.json", "markdown/b.md"))
    parts = sorted((x for x in split if "index" in x), key=lambda x: int(x.split(".")[1]) if x.count(".") > 1 else 1)
    assert "".join((tmp_path / "split" / x).read_text() for x in parts) == "".join(f"line {k}\n" for k in range(40))
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_")]
    render.show(df, "markdown/b.md", colours=True)
    assert capsys.readouterr().out == f"\033[1;36mmarkdown/b.md\033[0m\n{'=' * 80}\n\033[1;36m# b\033[0m\n{'-' * 80}\n"


def test_bytes_that_are_no_utf8_are_flagged(spark, tmp_path):
    (tmp_path / "in/a").mkdir(parents=True)
    (tmp_path / "in/a/go.mod").write_bytes(b"module x\xff\n")
    files = read_files(spark, f"{tmp_path}/in")
    found = staging.outcomes(staging.staged(files, ["go-modules"])).first()
    assert (found.outcome, found.error_type) == ("fallback", "malformed UTF-8")
