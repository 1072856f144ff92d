"""The source tree, read once: each file goes to the scanners that look for it, and what became of it is kept."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions.text import extension
from strataloom.operators.jvm import POM
from strataloom.operators.python_lang import is_toml
from strataloom.sources.files import in_globs, one_pass, unbalanced
from strataloom.sources.tables import committed, written

JAVA, PY, CS, GO = ["**/*.java"], ["**/*.py"], ["**/*.cs"], ["**/*.go"]
#: What each scanner looks for: globs, and words of which a file must hold one (any file if there are none).
LOOKS: dict[str, tuple[list[str], list[str]]] = {
    "maven-dependencies": (["**/pom.xml"], ["<project"]),
    "gradle-dependencies": (["**/build.gradle", "**/build.gradle.kts"], []),
    "npm-dependencies": (["**/package.json"], []),
    "pip-poetry-dependencies": (["**/requirements*.txt", "**/pyproject.toml", "**/Pipfile", "**/setup.py"], []),
    "nuget-dependencies": (["**/*.csproj", "**/packages.config", "**/Directory.Build.props", "**/Directory.Packages.props"], []),
    "dotnet-solution": (["**/*.sln"], []),
    "go-modules": (["go.mod", "**/go.mod"], []),
    "bundler-dependencies": (["Gemfile", "Gemfile.lock", "**/Gemfile", "**/Gemfile.lock"], []),
    "spring-components": (JAVA, ["org.springframework"]),
    "django-apps": (["**/settings.py", "**/settings/*.py", "**/__init__.py", "**/apps.py", "**/models.py"], []),
    "spring-rest-api": (JAVA, ["RestController", "Controller", "RequestMapping"]),
    "jaxrs-api": (JAVA, ["javax.ws.rs", "jakarta.ws.rs"]),
    "fastapi-rest": (PY, ["fastapi", "FastAPI"]),
    "flask-rest": (PY, ["flask", "Flask", "Blueprint"]),
    "aspnetcore-rest": (CS, ["Controller", "ApiController", "AspNetCore", ".MapGet", ".MapPost", ".MapPut", ".MapDelete", "PageModel"]),
    "express-api": (["**/*.js", "**/*.ts"], ["express", "Router"]),
    "go-http-router": (GO, ["gin-gonic", "labstack/echo", "go-chi", "gorilla/mux", "gofiber", "net/http"]),
    "rails-api": (["**/*_controller.rb"], []),
    "rails-route": (["**/routes.rb", "**/routes/*.rb"], []),
    "grpc-service": (JAVA, ["ImplBase"]),
    "grpc-service-dotnet": (CS, ["Base"]),
    "grpc-service-go": (GO, ["grpc", "pb."]),
    "graphql-schema": (["**/*.graphql", "**/*.gql"], []),
    "protobuf-schema": (["**/*.proto"], []),
    "jpa-entities": (JAVA, ["@Entity", "@Document"]),
    "mongodb": (JAVA, ["data.mongodb"]),
    "sqlalchemy-entities": (PY, ["sqlalchemy", "sqlmodel"]),
    "django-orm": (["**/models.py", "**/*_models.py"], ["models.Model"]),
    "entity-framework": (CS, ["class", "DbContext", "DbSet<", "EntityFramework"]),
    "go-struct": (GO, ["`"]),
    "avro-schema": (["**/*.avsc", "**/*.avro"], []),
    "sql-migration": (["**/migrations/**.sql", "**/migration/**.sql", "**/db/**.sql", "**/schema.sql"], []),
    "kafka-messaging": (JAVA, ["KafkaListener", "KafkaTemplate", "kafkaTemplate", "SendTo"]),
    "rabbitmq-messaging": (JAVA, ["RabbitListener", "RabbitTemplate", "rabbitTemplate"]),
    "kafka-streams": (JAVA, ["StreamsBuilder"]),
    "dotnet-kafka-messaging": (CS, ["Confluent.Kafka", "KafkaConsumer", "KafkaProducer", "ProduceAsync"]),
    "streamiz-kafka": (CS, ["Streamiz"]),
    "celery-tasks": (PY, ["celery", "shared_task", ".delay", ".apply_async"]),
    "faust-streaming": (PY, ["faust"]),
    "sidekiq-jobs": (["**/*.rb"], ["Sidekiq", "ApplicationWorker", "perform_"]),
    "java-http-client": (JAVA, ["FeignClient", "RestTemplate", "restTemplate", "WebClient", "webClient"]),
}
#: Bytes from which on a schema file is worth a warning.
LARGE = 5_000_000
#: Languages whose files are broken if their brackets do not match, by extension; what can be read of them is read then.
BRACKETS = {"java": "java", "cs": "csharp", "go": "go", "js": "javascript", "ts": "javascript", "py": "python", "proto": "java", "graphql": "python", "gql": "python"}


def _glob_kind(glob: str) -> str:
    found = re.search(r"\.(\w+)$", glob)
    return found[1].lower() if found else "other"


#: What folders the tree is dealt to: the extensions that scanners look for.
KINDS = {i: sorted({_glob_kind(g) for g in globs}) for i, (globs, _) in LOOKS.items()}


def _implied(words: Iterable[str], vocabulary: Iterable[str]) -> list[str]:
    """The words of the vocabulary that begin with one of the words: of words that begin at one place, the longest is found."""
    return [v for v in vocabulary if any(v.startswith(w) for w in words)]


def _broken(kind: Column) -> Column:
    """Why a file cannot be parsed, or not whole; null if it can."""
    name = F.col("rel_path")
    pom = name.rlike(r"(^|/)pom\.xml$") & F.col("content").contains("<project")
    toml = name.rlike(r"(^|/)(pyproject\.toml|Pipfile)$")
    out = (
        F.when(pom & F.from_xml("content", POM)["artifactId"].isNull(), "malformed XML")
        .when((name.rlike(r"(^|/)package\.json$") | kind.isin("avsc", "avro")) & F.try_parse_json("content").isNull(), "malformed JSON")
        .when(toml & ~is_toml(F.when(toml, F.col("content"))), "malformed TOML")
    )
    for ext, language in BRACKETS.items():
        out = out.when((kind == ext) & (F.size("wanted") > 0) & unbalanced(F.col("content"), language), "unbalanced brackets")
    return out.when(F.contains("content", F.lit("\ufffd")), "malformed UTF-8")


def staged(files: DataFrame, chosen: Iterable[str], into: str | None = None) -> DataFrame:
    """(rel_path, content, wanted, looked, words, broken, partial, large, kind): a row for each file that a scanner looks for.

    wanted: the scanners that scan it, as it holds one of their words; looked: those whose words it does not hold. Content
    that nobody wants stays behind. It is searched once for all words, and written once, by kind; what follows reads the
    narrow columns, or the content of its own kinds. partial: broken, but what can be read of it is.

    The table goes to `into`, or to a new place; what is there from an earlier run is used as it is.
    """
    chosen, kinds = list(chosen), sorted({k for ks in KINDS.values() for k in ks})
    ext = extension(F.col("rel_path"))
    kind = F.when(ext.isin([k for k in kinds if k != "other"]), ext).otherwise("other")
    by_kind = {k: sorted({w for i in chosen if k in KINDS[i] for w in LOOKS[i][1]}) for k in kinds}
    found = F.array().cast("array<string>")
    for k, words in by_kind.items():
        if words:
            found = F.when(F.col("kind") == k, F.array_distinct(F.regexp_extract_all("content", F.lit(one_pass(words)), F.lit(1)))).otherwise(found)

    def held(i: str) -> Column:
        out = F.lit(False)
        for k in KINDS[i]:
            out = out | ((F.col("kind") == k) & F.arrays_overlap("words", F.array(*map(F.lit, _implied(LOOKS[i][1], by_kind[k])))))
        return out

    mine = lambda i: F.when(in_globs(LOOKS[i][0]), F.lit(i))
    looking = F.array_compact(F.array(*map(mine, chosen)))
    tagged = files.where(F.col("content").isNotNull()).select("rel_path", "content", kind.alias("kind"), looking.alias("looking")).where(F.size("looking") > 0)
    tagged = tagged.withColumn("words", found)
    holding = F.array_compact(F.array(*(F.when(held(i) if LOOKS[i][1] else F.lit(True), F.lit(i)) for i in chosen)))
    tagged = tagged.withColumn("wanted", F.array_intersect("looking", holding)).withColumn("looked", F.array_except("looking", "wanted"))
    tagged = tagged.withColumn("broken", _broken(F.col("kind")))
    partial = F.col("broken").isNotNull() & (F.col("broken").isin("unbalanced brackets", "malformed UTF-8") | ((F.col("broken") == "malformed XML") & F.col("content").contains("<dependency>")))
    large = (F.octet_length("content") > LARGE) & F.col("kind").isin("graphql", "gql")
    rows = tagged.select(
        "rel_path", F.when(F.size("wanted") > 0, F.col("content")).alias("content"), "wanted", "looked", "words", "broken", partial.alias("partial"), large.alias("large"), "kind",
    )
    return written(rows, "tree", by=["kind"]) if into is None else committed(rows, into, by=["kind"])


def own_files(tree: DataFrame, scanner_id: str) -> DataFrame:
    """(rel_path, content) of the files that a scanner scans; only the folders of its kinds are read."""
    return tree.where(F.col("kind").isin(KINDS[scanner_id]) & F.array_contains("wanted", scanner_id)).select("rel_path", "content")


def outcomes(tree: DataFrame) -> DataFrame:
    """(scanner_id, rel_path, outcome, confidence, error_type, detail, large): what became of each file with each scanner.

    Outcomes: skipped, parsed, fallback, failed. Of a broken file of code, what can be read is read, and of a broken
    Maven file what patterns find: a fallback, whose findings are of medium confidence.
    """
    each = tree.select(
        "rel_path", "broken", "partial", "large",
        F.explode(F.concat(F.transform("wanted", lambda i: F.struct(i.alias("id"), F.lit(True).alias("scanned"))), F.transform("looked", lambda i: F.struct(i.alias("id"), F.lit(False).alias("scanned"))))).alias("s"),
    ).select("rel_path", "broken", "partial", F.col("s.id").alias("scanner_id"), F.col("s.scanned"), (F.col("large") & F.col("s.scanned")).alias("large"))
    outcome = F.when(~F.col("scanned"), "skipped").when(F.col("broken").isNull(), "parsed").when(F.col("partial"), "fallback").otherwise("failed")
    error = F.when(F.col("scanned"), F.col("broken"))
    return each.select(
        "scanner_id", "rel_path", outcome.alias("outcome"), F.when(outcome == "parsed", "HIGH").when(outcome == "fallback", "MEDIUM").alias("confidence"),
        error.alias("error_type"), F.concat("rel_path", F.lit(": "), error).alias("detail"), "large",
    )


def scan_runs(tree: DataFrame, errors: Mapping[str, str] | None = None) -> DataFrame:
    """(scanner_id, discovered, scanned, parsed, fallback, failed, skipped, success, error, warning, summary) by scanner.

    errors: what scanners that broke off said; their runs have failed, whether they looked for files or not.
    """
    count = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    found = outcomes(tree)
    by = found.groupBy("scanner_id").agg(
        F.count("*").alias("discovered"), F.count_if(F.col("outcome") != "skipped").alias("scanned"), count("parsed"), count("fallback"), count("failed"), count("skipped"), F.count_if("large").alias("large"),
    )
    broke = tree.sparkSession.createDataFrame(list((errors or {}).items()), "scanner_id string, broke string")
    by = by.join(F.broadcast(broke), "scanner_id", "left").fillna(0)  # a row a scanner
    lost = (F.col("failed") > 0) & (F.col("failed") == F.col("scanned"))
    said = lambda n, what: F.when(F.col(n) > 0, F.concat(F.col(n).cast("string"), F.lit(f" files {what}")))
    rate = lambda c: F.when(F.col("scanned") == 0, F.lit(0.0)).otherwise(100.0 * F.col(c) / F.col("scanned"))
    summary = F.format_string("Discovered: %d, Scanned: %d, Success: %d (%.1f%%), Fallback: %d, Failed: %d (%.1f%%)", "discovered", "scanned", "parsed", rate("parsed"), "fallback", "failed", rate("failed"))
    warning = F.nullif(F.concat_ws("; ", F.when(~lost, said("failed", "failed")), said("fallback", "by fallback"), said("large", "are very large")), F.lit(""))
    good = ~lost & F.col("broke").isNull()
    error = F.coalesce("broke", F.when(lost, said("failed", "failed")))
    return by.select("*", good.alias("success"), error.alias("error"), warning.alias("warning"), summary.alias("summary")).drop("large", "broke")
