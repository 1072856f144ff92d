"""Every scanner over one project of the derived tree, against what its sample says it has to find."""

import hashlib

import pytest

from strataloom.plans.corpus import SAMPLES
from strataloom.plans.scan import DERIVED, SCANNERS, scanner_ids
from strataloom.plans.scan_queries import fields_text


def filled(v, key="7"):
    if not isinstance(v, str):
        return v
    text = v.removeprefix("sha:").replace("@K@", key)
    return hashlib.sha256(text.encode()).hexdigest()[:16] if v.startswith("sha:") else text


@pytest.fixture(scope="module")
def tree(spark):
    files = [(p.replace("@K@", "7"), t.replace("@K@", "7")) for s in SAMPLES for p, t in s.files] + [("empty.java", ""), ("nothing.py", None)]
    return spark.createDataFrame(files, "rel_path string, content string").cache()


@pytest.mark.parametrize("sample", SAMPLES, ids=lambda s: f"{s.scanner}-{s.when[0]}-{s.when[1]}")
def test_scanner_finds_what_its_sample_holds(tree, sample):
    out = SCANNERS[sample.scanner].run(tree)
    own = [p.replace("@K@", "7") for p, _ in sample.files]
    if not sample.finds:
        assert all(df.where(df.rel_path.isin(own)).isEmpty() for df in out.values())
    for table, (columns, rows) in sample.finds.items():
        names = columns.split()
        df = out[table].where(out[table].rel_path.isin(own))
        found = df.select(*(fields_text().alias("fields") if n == "fields" else n for n in names)).collect()
        assert sorted(map(tuple, found), key=str) == sorted((tuple(filled(v) for v in r) for r in rows), key=str)


def test_every_scanner_has_a_sample_and_the_modes_choose():
    assert {s.scanner for s in SAMPLES} == set(SCANNERS) and len(SCANNERS) == 41
    assert len(scanner_ids()) == 42 and scanner_ids()[-1] == DERIVED
    assert scanner_ids("explicit", ["kafka-messaging", "no-such"]) == ["kafka-messaging"]
    assert set(scanner_ids("groups", groups=["go"])) == {"go-modules", "go-http-router", "grpc-service-go", "go-struct"}
    with pytest.raises(ValueError):
        scanner_ids("other")


def one(spark, scanner, table, files):
    return SCANNERS[scanner].run(spark.createDataFrame(files, "rel_path string, content string"))[table]


def test_root_files_are_not_below_a_folder(spark):
    pom = "<project><artifactId>a</artifactId></project>"
    assert [r.name for r in one(spark, "maven-dependencies", "components", [("pom.xml", pom), ("a/pom.xml", pom)]).collect()] == ["a"]


def test_broken_inputs_give_nothing(spark):
    files = [("a/package.json", "{"), ("a/pyproject.toml", "= ="), ("a/x.avsc", "{]"), ("a/pom.xml", "no xml"), ("a/b.graphql", "type {"), ("a/c.proto", "message")]
    assert one(spark, "npm-dependencies", "dependencies", files).count() == 0
    assert one(spark, "pip-poetry-dependencies", "dependencies", files).count() == 0
    assert one(spark, "avro-schema", "data_entities", files).count() == 0
    assert one(spark, "maven-dependencies", "dependencies", files).count() == 0
    assert one(spark, "graphql-schema", "data_entities", files).count() == 0


def test_entities_inherit_through_bases(spark):
    text = "namespace N;\npublic class Db : DbContext\n{\n public DbSet<Animal> A { get; set; }\n}\npublic class Animal\n{\n public int Id { get; set; }\n}\npublic class Dog : Animal\n{\n public string Name { get; set; }\n}\npublic class Other\n{\n public int Id { get; set; }\n}\n"
    assert {r.name for r in one(spark, "entity-framework", "data_entities", [("a/x.cs", text)]).collect()} == {"Animals", "Dogs"}


def test_nested_route_scopes(spark):
    text = "draw do\n  namespace :api do\n    resources :teams, only: [:show] do\n      resources :members, only: [:index]\n    end\n    match '/ping', to: 'p#p', via: [:get, :post]\n  end\n  root 'home#index'\nend\n"
    got = {(r.method, r.path) for r in one(spark, "rails-route", "api_endpoints", [("a/config/routes.rb", text)]).collect()}
    assert got == {("GET", "/api/teams/:id"), ("GET", "/api/teams/:id/members"), ("GET", "/api/ping"), ("POST", "/api/ping"), ("GET", "/")}
