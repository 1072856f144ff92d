"""All scanners, which of them run, and the scan of a source tree into the catalog."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions.text import text_or_null
from strataloom.model import KEYS, ORIGIN, TABLES
from strataloom.operators import dotnet, jvm, python_lang, schema_lang, web_go_ruby
from strataloom.operators.gates import GATES, applicable
from strataloom.plans.staging import LOOKS, own_files, scan_runs, staged
from strataloom.sources.tables import Place, committed, is_committed, scratch


@dataclass(frozen=True)
class Scanner:
    """id, ecosystem, what it looks for, and files -> tables. Lower priorities come first when equal rows meet."""

    id: str
    language: str
    subject: str
    priority: int
    run: Callable[[DataFrame], dict[str, DataFrame]]


def _all() -> list[Scanner]:
    d, s, a, e, m, r = "dependencies", "structure", "api", "entities", "messaging", "relationships"
    listed = [
        ("maven-dependencies", "java", d, 10, jvm.maven_dependencies), ("gradle-dependencies", "java", d, 10, jvm.gradle_dependencies),
        ("npm-dependencies", "javascript", d, 10, web_go_ruby.npm_dependencies), ("pip-poetry-dependencies", "python", d, 10, python_lang.pip_poetry_dependencies),
        ("nuget-dependencies", "dotnet", d, 10, dotnet.nuget_dependencies), ("dotnet-solution", "dotnet", d, 12, dotnet.dotnet_solution),
        ("go-modules", "go", d, 10, web_go_ruby.go_modules), ("bundler-dependencies", "ruby", d, 80, web_go_ruby.bundler_dependencies),
        ("spring-components", "java", s, 15, jvm.spring_components), ("django-apps", "python", s, 15, python_lang.django_apps),
        ("spring-rest-api", "java", a, 50, jvm.spring_rest_api), ("jaxrs-api", "java", a, 50, jvm.jaxrs_api),
        ("fastapi-rest", "python", a, 50, python_lang.fastapi_rest), ("flask-rest", "python", a, 51, python_lang.flask_rest),
        ("aspnetcore-rest", "dotnet", a, 50, dotnet.aspnetcore_rest), ("express-api", "javascript", a, 50, web_go_ruby.express_api),
        ("go-http-router", "go", a, 50, web_go_ruby.go_http_router), ("rails-api", "ruby", a, 50, web_go_ruby.rails_api),
        ("rails-route", "ruby", a, 50, web_go_ruby.rails_route), ("grpc-service", "java", a, 55, jvm.grpc_service),
        ("grpc-service-dotnet", "dotnet", a, 55, dotnet.grpc_service_dotnet), ("grpc-service-go", "go", a, 55, web_go_ruby.grpc_service_go),
        ("graphql-schema", "schema", a, 60, schema_lang.graphql_schema), ("protobuf-schema", "schema", a, 60, schema_lang.protobuf_schema),
        ("jpa-entities", "java", e, 60, jvm.jpa_entities), ("mongodb", "java", e, 61, jvm.mongodb),
        ("sqlalchemy-entities", "python", e, 60, python_lang.sqlalchemy_entities), ("django-orm", "python", e, 61, python_lang.django_orm),
        ("entity-framework", "dotnet", e, 60, dotnet.entity_framework), ("go-struct", "go", e, 60, web_go_ruby.go_struct),
        ("avro-schema", "schema", e, 70, schema_lang.avro_schema), ("sql-migration", "schema", e, 60, schema_lang.sql_migration),
        ("kafka-messaging", "java", m, 70, jvm.kafka_messaging), ("rabbitmq-messaging", "java", m, 70, jvm.rabbitmq_messaging),
        ("kafka-streams", "java", m, 75, jvm.kafka_streams), ("dotnet-kafka-messaging", "dotnet", m, 70, dotnet.dotnet_kafka_messaging),
        ("streamiz-kafka", "dotnet", m, 75, dotnet.streamiz_kafka), ("celery-tasks", "python", m, 50, python_lang.celery_tasks),
        ("faust-streaming", "python", m, 65, python_lang.faust_streaming), ("sidekiq-jobs", "ruby", m, 50, web_go_ruby.sidekiq_jobs),
        ("java-http-client", "java", r, 60, jvm.java_http_client),
    ]
    return [Scanner(*x) for x in listed]


SCANNERS = {s.id: s for s in _all()}
#: Derived from the endpoints of the others, after them.
DERIVED = "rest-event-flow"


def scanner_ids(mode: str = "auto", enabled: Iterable[str] = (), groups: Iterable[str] = ()) -> list[str]:
    """The scanners that run: all, those named, or those of the named languages or subjects; unknown names are ignored."""
    known = [*SCANNERS, DERIVED]
    if mode == "explicit":
        return [i for i in known if i in set(enabled)]
    if mode == "groups":
        chosen = {g.lower() for g in groups}
        return [i for i in known if i in SCANNERS and {SCANNERS[i].language, SCANNERS[i].subject} & chosen] + [DERIVED] * ("messaging" in chosen)
    if mode != "auto":
        raise ValueError(f"no such mode: {mode}")
    return known


def registry(spark: SparkSession) -> DataFrame:
    """(scanner_id, language, subject, priority): a row for each scanner."""
    own = [(s.id, s.language, s.subject, s.priority) for s in SCANNERS.values()] + [(DERIVED, "any", "messaging", 150)]
    return spark.createDataFrame(own, "scanner_id string, language string, subject string, priority int")


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in (ORIGIN | TABLES[table]).items()))


def union_all(spark: SparkSession, parts: Iterable[dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """The rows of all parts, table by table."""
    out = {}
    for part in parts:
        for table, df in part.items():
            out[table] = out[table].unionByName(df) if table in out else df
    return {t: out.get(t) if t in out else empty(spark, t) for t in TABLES}


def first_wins(df: DataFrame, table: str, count: str | None = None) -> DataFrame:
    """The first row of each key, by the scanner's priority, then path and place; null in a key is a value like any.

    With `count`, a column of that name tells how many rows had the key.

    The order is an aggregate, not a window: only the best row of a key leaves each task.
    """
    key = [text_or_null(F.col(c)).alias(f"_k{i}") for i, c in enumerate(KEYS[table])]
    priority = F.try_element_at(F.create_map(*(x for s in SCANNERS.values() for x in (F.lit(s.id), F.lit(s.priority)))), F.col("scanner_id"))
    rank = F.struct(F.coalesce(priority, F.lit(150)).alias("p"), "scanner_id", "rel_path", "pos")
    # the row itself settles ties, column by column, so the choice does not depend on the partitioning
    ranked = df.select(*key, F.struct(rank.alias("rank"), F.struct(*df.columns).alias("row")).alias("c"))
    best = ranked.groupBy(*(f"_k{i}" for i in range(len(key)))).agg(F.min("c").alias("c"), F.count("*").alias("_n"))
    return best.select("c.row.*", *([F.col("_n").alias(count)] if count else []))


#: Scanners that run at a time; each has jobs of its own.
AT_ONCE = 8


def _run_one(scanner: Scanner, files: DataFrame, root: str) -> dict[str, str]:
    """Writes what a scanner finds, table by table, and returns the paths; jobs bear the scanner's id as their tag."""
    spark, own = files.sparkSession, f"{root}/{scanner.id}"
    done = Place(spark, f"{own}/done")
    spark.addTag(scanner.id)
    try:
        if not done.exists():
            for table, df in scanner.run(files).items():
                committed(df, f"{own}/{table}")
            done.mark()
        return {t: f"{own}/{t}" for t in TABLES if is_committed(spark, f"{own}/{t}")}
    finally:
        spark.removeTag(scanner.id)


def run_scanners(chosen: Iterable[str], tree: DataFrame, root: str) -> tuple[dict[str, list[str]], dict[str, str]]:
    """Runs scanners side by side, each by itself: (paths by table, what those that broke off said by scanner).

    What a scanner finds counts when all its tables are there. One that breaks off leaves nothing but its error, and a
    later run in the same folder repeats only what was not done.
    """
    paths: dict[str, list[str]] = {}
    errors: dict[str, str] = {}
    with ThreadPoolExecutor(AT_ONCE) as pool:
        started = {i: pool.submit(inheritable_thread_target(tree.sparkSession)(_run_one), SCANNERS[i], own_files(tree, i), root) for i in chosen}
        for i, one in started.items():
            try:
                for table, path in one.result().items():
                    paths.setdefault(table, []).append(path)
            except Exception as e:  # whatever it is, it is this scanner's alone
                errors[i] = f"{type(e).__name__}: {str(e).strip().splitlines()[0][:300] if str(e).strip() else ''}"
    return paths, errors


def _read(spark: SparkSession, table: str, paths: list[str]) -> DataFrame:
    blank = empty(spark, table)
    return spark.read.schema(blank.schema).parquet(*paths) if paths else blank


def scan_with_runs(
    files: DataFrame, mode: str = "auto", enabled: Iterable[str] = (), groups: Iterable[str] = (), detect_crud: bool = True, gated: bool = True, into: str | None = None
) -> tuple[dict[str, DataFrame], DataFrame]:
    """The catalog of a source tree, each model table with one row for each key; and the runs of the scanners.

    The tree is read once. With `gated`, scanners that ask for a framework run only where the tree uses it. A scanner
    that breaks off has a failed run with its error, and the others' findings stand. With a folder `into`, a scan that is
    run again there goes on where the last one ended.
    """
    spark = files.sparkSession
    chosen = scanner_ids(mode, enabled, groups)
    runs = sorted((c for c in chosen if c in SCANNERS), key=lambda c: (SCANNERS[c].priority, c))
    root = into or scratch(spark, "scan")
    tree = staged(files, runs, f"{root}/tree")
    first = [i for i in runs if SCANNERS[i].subject == "dependencies"]
    paths, errors = run_scanners(first, tree, root)
    if gated and set(runs) & set(GATES):
        dependencies = _read(spark, "dependencies", paths.get("dependencies", []))
        off = {r.scanner_id for r in applicable(tree, dependencies, LOOKS).where("NOT applies").collect()}  # a row a scanner
        runs = [i for i in runs if i not in off]
    more, broke = run_scanners([i for i in runs if i not in first], tree, root)
    tables = {t: _read(spark, t, paths.get(t, []) + more.get(t, [])) for t in TABLES}
    if DERIVED in chosen:
        flows = schema_lang.rest_event_flow(first_wins(tables["api_endpoints"], "api_endpoints"), detect_crud)["message_flows"]
        tables["message_flows"] = tables["message_flows"].unionByName(flows)
    return {t: first_wins(df, t) for t, df in tables.items()}, scan_runs(tree, errors | broke)


def scan(files: DataFrame, *args, **how) -> dict[str, DataFrame]:
    """The catalog alone; takes the arguments of scan_with_runs()."""
    return scan_with_runs(files, *args, **how)[0]
