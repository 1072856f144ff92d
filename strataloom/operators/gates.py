"""Whether a scanner applies to a tree: predicates on its files and its dependencies.

A predicate is an aggregate over the rows of evidence(); predicates combine with `&`, `|` and `~`.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions.text import glob_regex


def evidence(files: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(rel_path, content, group_id, artifact_id): a row for each file and one for each dependency."""
    none = F.lit(None).cast("string")
    own = files.select("rel_path", "content", none.alias("group_id"), none.alias("artifact_id"))
    return own.unionByName(dependencies.select(none.alias("rel_path"), none.alias("content"), "group_id", "artifact_id"))


def _some(condition: Column) -> Column:
    return F.coalesce(F.bool_or(F.coalesce(condition, F.lit(False))), F.lit(False))


def always() -> Column:
    return _some(F.lit(True)) | F.lit(True)


def never() -> Column:
    return _some(F.lit(False)) & F.lit(False)


def has_files(*globs: str) -> Column:
    return _some(F.col("rel_path").rlike("|".join(glob_regex(g, True) for g in globs)))


def has_file_containing(*words: str) -> Column:
    return _some(reduce(lambda a, b: a | b, (F.col("content").contains(w) for w in words)))


def has_dependency(*words: str) -> Column:
    """Whether some dependency's group or artifact holds one of the words, in any case."""
    text = F.lower(F.concat_ws(":", "group_id", "artifact_id"))
    named = F.col("artifact_id").isNotNull()
    return _some(named & reduce(lambda a, b: a | b, (text.contains(w.lower()) for w in words)))


#: What the dependencies of a framework's users are called.
FRAMEWORKS = {
    "spring": ["org.springframework"],
    "jax-rs": ["javax.ws.rs", "jakarta.ws.rs", "jersey", "resteasy"],
    "jpa": ["javax.persistence", "jakarta.persistence", "hibernate", "eclipselink"],
    "kafka": ["kafka"],
    "kafka-streams": ["kafka-streams"],
    "rabbitmq": ["rabbitmq", "spring-rabbit"],
    "mongodb": ["mongodb", "spring-data-mongodb"],
    "fastapi": ["fastapi"],
    "flask": ["flask"],
    "celery": ["celery"],
    "faust": ["faust"],
    "sqlalchemy": ["sqlalchemy"],
    "aspnetcore": ["microsoft.aspnetcore"],
    "entity-framework": ["microsoft.entityframeworkcore", "entityframework"],
}


def uses(framework: str) -> Column:
    return has_dependency(*FRAMEWORKS[framework])


#: Scanners that ask for a framework.
GATES = {
    "spring-components": "spring", "spring-rest-api": "spring", "jaxrs-api": "jax-rs", "jpa-entities": "jpa", "mongodb": "mongodb", "kafka-messaging": "kafka",
    "kafka-streams": "kafka-streams", "rabbitmq-messaging": "rabbitmq", "entity-framework": "entity-framework", "aspnetcore-rest": "aspnetcore", "celery-tasks": "celery",
    "flask-rest": "flask", "faust-streaming": "faust", "fastapi-rest": "fastapi",
}
#: Of these only a dependency tells.
BY_DEPENDENCY = ["spring-components"]
#: Words that scanners look for, but that other code has, too.
LOOSE = {"Controller", "@Document", "SendTo", "kafkaTemplate", "rabbitTemplate", "class", ".delay", ".apply_async", "Blueprint", "RequestMapping"}


def applicable(tree: DataFrame, dependencies: DataFrame, looks: Mapping[str, tuple[list[str], list[str]]]) -> DataFrame:
    """(scanner_id, applies): a row for each scanner with a gate, by one rule and one pass over the words found in the files.

    A scanner applies if the tree depends on its framework, or if a file that it scans holds a word that it looks for and
    that is not a loose one. tree: (wanted, words); looks: by scanner its globs and words.
    """
    none = F.lit(None)
    seen = tree.select("wanted", "words", none.cast("string").alias("group_id"), none.cast("string").alias("artifact_id"))
    listed = none.cast("array<string>")
    both = seen.unionByName(dependencies.select(listed.alias("wanted"), listed.alias("words"), "group_id", "artifact_id"))

    def gate(scanner: str) -> Column:
        telling = [w for w in looks[scanner][1] if w not in LOOSE]
        told = F.exists("words", lambda x: reduce(lambda a, b: a | b, (x.startswith(w) for w in telling)))
        in_code = _some(F.array_contains("wanted", scanner) & told)
        return uses(GATES[scanner]) if scanner in BY_DEPENDENCY else uses(GATES[scanner]) | in_code

    return both.agg(*(gate(i).alias(i) for i in GATES)).unpivot([], list(GATES), "scanner_id", "applies")
