"""Extraction from Python sources and packaging files."""

from __future__ import annotations

import tomllib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.functions.text import capitalised, first, folder_name, make_id, one_of, snake_case, unquoted
from strataloom.model import FIELDS, rows
from strataloom.operators.declared import members
from strataloom.sources.files import code_files, lines, matches, select_files
from strataloom.sources.syntax import declarations

PY = ["**/*.py"]


def module(path: Column) -> Column:
    """app/orders/views.py -> app.orders.views."""
    return F.replace(F.regexp_replace(path, r"\.py$", ""), F.lit("/"), F.lit("."))


def functions(own: DataFrame) -> DataFrame:
    """A row for each decorator of each function of the files, nested ones included: rel_path, pos, component, decorator, args
    (null without parentheses), fn, params.
    """
    found = declarations(own, "python").where("kind = 'file'").withColumn("component", module(F.col("rel_path")))
    each = members(found, "component").select("*", F.posexplode("notes").alias("_k", "_n"))
    return each.select(
        "rel_path", (F.col("pos") * 100 + F.col("_k")).alias("pos"), "component", F.col("_n.name").alias("decorator"), F.col("_n.args").alias("args"),
        F.regexp_extract("words", r"(\w+)$", 1).alias("fn"), "params",
    )


def classes(own: DataFrame) -> DataFrame:
    """A row for each class: rel_path, part, name, bases, members, mod."""
    return declarations(own, "python").where("kind = 'class'").withColumn("mod", module(F.col("rel_path")))


def decorated_by(name: Column, methods: str) -> Column:
    """Which of the methods a decorator `x.method` calls; null for others."""
    return first(name, rf"^\w+\.({methods})$")


REQUIREMENTS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("name", "version", "scope")]))


@F.pandas_udf(REQUIREMENTS)
def toml_requirements(texts: pd.Series) -> pd.Series:
    """Requirements of pyproject.toml and Pipfile texts; texts that are not TOML have none."""

    def one(line: str, scope: str) -> dict:
        cut = next((i for i, c in enumerate(line) if not (c.isalnum() or c in "._-")), len(line))
        version = line[cut:].split(";")[0]
        return {"name": line[:cut], "version": version.split("]")[-1].strip() or "*", "scope": scope}

    def table(deps: dict, scope: str) -> list[dict]:
        return [{"name": k, "version": v if isinstance(v, str) else str(v.get("version", "*")), "scope": scope} for k, v in deps.items() if k != "python" and isinstance(v, str | dict)]

    def read(text: str) -> list[dict]:
        try:
            t = tomllib.loads(text)
        except (tomllib.TOMLDecodeError, TypeError):
            return []
        project, poetry = t.get("project", {}), t.get("tool", {}).get("poetry", {})
        out = [one(x, "compile") for x in project.get("dependencies", [])]
        for name, own in project.get("optional-dependencies", {}).items():
            out += [one(x, "test" if name in ("dev", "test") else "optional") for x in own]
        for own in t.get("dependency-groups", {}).values():
            out += [one(x, "test") for x in own if isinstance(x, str)]
        out += table(poetry.get("dependencies", {}), "compile") + table(poetry.get("dev-dependencies", {}), "test")
        for own in poetry.get("group", {}).values():
            out += table(own.get("dependencies", {}), "test")
        return out + table(t.get("packages", {}), "compile") + table(t.get("dev-packages", {}), "test")

    return texts.map(read)


@F.pandas_udf(T.BooleanType())
def is_toml(texts: pd.Series) -> pd.Series:
    """Whether a text is TOML; null counts as such."""

    def good(text: str | None) -> bool:
        try:
            return text is None or tomllib.loads(text) is not None
        except tomllib.TOMLDecodeError:
            return False

    return texts.map(good).astype(bool)


def pip_poetry_dependencies(files: DataFrame) -> dict[str, DataFrame]:
    named = select_files(files, ["**/requirements*.txt"])
    plain = lines(named).where(~F.col("line").rlike(r"^\s*(#|-e|-r|$)"))
    plain = plain.select("rel_path", F.col("line_no").alias("pos"), F.regexp_extract("line", r"^\s*([A-Za-z0-9._-]+)(?:\[[^\]]*\])?\s*((?:==|>=|<=|~=|!=|>|<).*?)\s*(?:[;#].*)?$", 1).alias("name"), F.regexp_extract("line", r"^\s*[A-Za-z0-9._-]+(?:\[[^\]]*\])?\s*(?:==|>=|<=|~=|!=|>|<)\s*([^\s,;#]+)", 1).alias("version"), F.lit("compile").alias("scope")).where("name <> ''")
    toml = select_files(files, ["**/pyproject.toml", "**/Pipfile"]).select("rel_path", F.posexplode(toml_requirements("content")).alias("pos", "r")).select("rel_path", "pos", "r.name", "r.version", "r.scope")
    setup = select_files(files, ["**/setup.py"]).select("rel_path", F.regexp_extract("content", r"(?s)install_requires\s*=\s*\[(.*?)\]", 1).alias("content"))
    setup = matches(setup, r"['\"]([A-Za-z0-9._-]+)\s*(?:[=<>~!]=?\s*([^'\",;]+))?[^'\"]*['\"]", ["name", "version"]).select("rel_path", "pos", "name", F.coalesce("version", F.lit("*")).alias("version"), F.lit("compile").alias("scope"))
    deps = plain.unionByName(toml).unionByName(setup)
    project = folder_name(F.col("rel_path"))
    own = deps.select("rel_path").distinct()
    return {
        "components": rows("components", own, "pip-poetry-dependencies", id=make_id("python", project), name=project, type="SERVICE", technology="Python"),
        "dependencies": rows("dependencies", deps, "pip-poetry-dependencies", source_component_id=make_id("python", project), group_id="pypi", artifact_id=F.col("name"), version=F.regexp_replace("version", "^[=<>~!^]+\\s*", ""), scope=F.col("scope")),
    }


def django_apps(files: DataFrame) -> dict[str, DataFrame]:
    settings = select_files(files, ["**/settings.py", "**/settings/*.py"], ["INSTALLED_APPS"])
    block = settings.select("rel_path", F.regexp_extract("content", r"(?s)INSTALLED_APPS\s*\+?=\s*[\[(](.*?)[\])]", 1).alias("content"))
    apps = matches(block, r"['\"]([\w.]+)['\"]", ["app"]).where(~F.col("app").startswith("django.contrib."))
    root = F.regexp_replace("rel_path", r"[^/]+/settings(?:/[^/]+)?\.py$", "")
    apps = apps.withColumns({"name": F.regexp_extract("app", r"^([\w.]+?)(?:\.apps\.\w+)?$", 1)}).withColumn("folder", F.concat(root, F.replace("name", F.lit("."), F.lit("/"))))
    kept = files.select(F.regexp_extract("rel_path", r"^(.*)/(?:__init__|apps|models)\.py$", 1).alias("folder"), F.regexp_extract("rel_path", r"([^/]+)$", 1).alias("file"), F.when(F.col("rel_path").endswith("/apps.py"), first(F.col("content"), r"verbose_name\s*=\s*['\"]([^'\"]+)['\"]")).alias("verbose")).where("folder <> ''")
    local = kept.groupBy("folder").agg((F.bool_or(F.col("file") == "__init__.py") & F.bool_or(F.col("file") != "__init__.py")).alias("local"), F.max("verbose").alias("verbose"))
    found = apps.join(local, "folder", "left")
    return {"components": rows("components", found, "django-apps", id=make_id("django", F.col("name")), name=F.coalesce("verbose", F.element_at(F.split("name", r"\."), -1)), type=F.when(F.coalesce("local", F.lit(False)), "MODULE").otherwise("LIBRARY"), technology="Django")}


PRIMITIVE = "^(str|int|float|bool|dict|list|bytes|None|Optional|List|Dict|Request|Response|Session|Depends)\\b"


def fastapi_rest(files: DataFrame) -> dict[str, DataFrame]:
    found = functions(select_files(files, PY, ["fastapi", "FastAPI"])).withColumn("verb", decorated_by(F.col("decorator"), "get|post|put|delete|patch"))
    found = found.withColumn("path", F.regexp_extract("args", r"^\s*(?:path\s*=\s*)?[rf]?['\"]([^'\"]*)['\"]", 1))
    found = found.where(F.col("verb").isNotNull() & F.col("args").rlike(r"^\s*(?:path\s*=\s*)?[rf]?['\"]"))
    in_path = F.regexp_extract_all("path", F.lit(r"\{(\w+)"), F.lit(1))
    typed = F.filter("params", lambda p: F.size(p["notes"]) > 0)
    params = F.transform(typed, lambda p: F.struct(p["words"].alias("n"), p["notes"][0]["args"].alias("t")))
    shown = lambda label, keep: F.concat(F.lit(f"{label}: "), F.array_join(F.transform(F.filter(params, keep), lambda p: F.concat(p["n"], F.lit(": "), p["t"])), ", "))
    is_path = lambda p: F.array_contains(in_path, p["n"])
    is_body = lambda p: ~is_path(p) & ~p["t"].rlike(PRIMITIVE)
    parts = [(is_path, "Path"), (lambda p: ~is_path(p) & p["t"].rlike("^(str|int|float|bool)\\b"), "Query"), (is_body, "Body")]
    schema = F.array_join(F.array_compact(F.array(*(F.when(F.size(F.filter(params, k)) > 0, shown(n, k)) for k, n in parts))), "; ")
    made = rows(
        "api_endpoints", found, "fastapi-rest", component_id=F.col("component"), type="REST", path=F.col("path"), method=F.upper("verb"),
        description=F.concat(F.lit("Handler "), F.col("fn")), request_schema=F.nullif(schema, F.lit("")), response_schema="dict",
    )
    return {"api_endpoints": made}


def flask_rest(files: DataFrame) -> dict[str, DataFrame]:
    found = functions(select_files(files, PY, ["flask", "Flask", "Blueprint"])).withColumn("verb", decorated_by(F.col("decorator"), "get|post|put|delete|patch|route"))
    found = found.withColumn("path", first(F.col("args"), r"^\s*(?:rule\s*=\s*)?['\"]([^'\"]+)['\"]")).where("verb IS NOT NULL AND path IS NOT NULL")
    listed = F.regexp_extract_all(F.regexp_extract("args", r"methods\s*=\s*[\[({]([^\])}]*)", 1), F.lit(r"['\"](\w+)['\"]"), F.lit(1))
    verbs = F.when(F.col("verb") != "route", F.array(F.upper("verb"))).when(F.size(listed) > 0, F.transform(listed, F.upper)).otherwise(F.array(F.lit("GET")))
    each = found.withColumn("method", F.explode(verbs))
    in_path = F.regexp_extract_all("path", F.lit(r"<(?:\w+:)?\w+>"), F.lit(0))
    shown = F.transform(in_path, lambda p: F.concat(F.regexp_extract(p, r"(\w+)>$", 1), F.lit(": "), F.coalesce(first(p, r"<(\w+):"), F.lit("string"))))
    made = rows(
        "api_endpoints", each, "flask-rest", component_id=F.col("component"), type="REST", path=F.col("path"), method=F.col("method"),
        description=F.concat(F.lit("Handler "), F.col("fn")), request_schema=F.nullif(F.array_join(shown, ", "), F.lit("")),
    )
    return {"api_endpoints": made}


#: A text in either quotes, and one given to a keyword.
STRING = r"(\"[^\"\n]+\"|'[^'\n]+')"
KEYWORD = r"\b{}\s*=\s*(\"[^\"\n]+\"|'[^'\n]+')"


def celery_tasks(files: DataFrame) -> dict[str, DataFrame]:
    """A flow for each call of a task that is defined anywhere; of definitions of one name the last path's counts."""
    words = ["celery", "shared_task", ".delay", ".apply_async"]
    marked = functions(select_files(files, PY, words)).where(F.col("decorator").rlike(r"(?:^|\.)(?:shared_task|task)$"))
    args = F.coalesce("args", F.lit(""))
    queue = F.coalesce(unquoted(first(args, KEYWORD.format("queue"))), F.lit("celery"))
    task = F.coalesce(unquoted(first(args, KEYWORD.format("name"))), F.concat("component", F.lit("."), "fn"))
    one = F.struct(F.col("component").alias("definer"), queue.alias("queue"), task.alias("task"))
    # an aggregate, so only the best row of a name such as `run` leaves each task
    last = marked.groupBy("fn").agg(F.max_by(one, F.struct("rel_path", -F.col("pos"))).alias("d")).select("fn", "d.*")
    own = code_files(files, PY, words, "python").withColumn("component", module(F.col("rel_path")))
    calls = matches(own, r"(\w+)\.(?:delay|apply_async)\s*\(([^\n]*)", ["fn", "rest"], keep=["component"])
    joined = calls.join(last, "fn")
    override = unquoted(first(F.coalesce("rest", F.lit("")), KEYWORD.format("queue")))
    made = rows(
        "message_flows", joined, "celery-tasks", publisher_component_id=F.col("component"), subscriber_component_id=F.col("definer"),
        topic=F.coalesce(override, F.col("queue")), message_type=F.col("task"), broker="celery",
    )
    return {"message_flows": made}


def faust_streaming(files: DataFrame) -> dict[str, DataFrame]:
    own = code_files(files, PY, ["faust"], "python").withColumn("component", module(F.col("rel_path")))
    topics = matches(own, rf"\b(\w+)(?:\s*:\s*[\w.\[\], ]+)?\s*=\s*[\w.]+\.topic\(\s*(?:topics\s*=\s*)?{STRING}", ["var", "topic"]).withColumn("topic", unquoted(F.col("topic"))).groupBy("rel_path", "var").agg(F.min_by("topic", "pos").alias("topic"))
    agents = functions(select_files(files, PY, ["faust"])).where(F.col("decorator").rlike(r"^\w+\.agent$"))
    agents = agents.withColumn("var", first(F.col("args"), r"^\s*(\w+)")).where("var IS NOT NULL").join(topics, ["rel_path", "var"], "left")
    sends = matches(own, r"(\w+)\.send\s*\(", ["var"], keep=["component"]).join(topics, ["rel_path", "var"], "left")
    direct = matches(own, rf"\.stream\(\s*{STRING}", ["topic"], keep=["component"]).withColumn("topic", unquoted(F.col("topic")))
    flow = lambda df, topic, **side: rows("message_flows", df, "faust-streaming", topic=topic, broker="kafka", **side)
    named = F.coalesce("topic", "var")
    out = flow(agents, named, subscriber_component_id=F.concat("component", F.lit("."), "fn"))
    out = out.unionByName(flow(sends, named, publisher_component_id=F.col("component")))
    return {"message_flows": out.unionByName(flow(direct, F.col("topic"), subscriber_component_id=F.col("component")))}


def _entities(found: DataFrame, keep: list[str], entry: Column, pk: Column) -> DataFrame:
    grouped = found.groupBy("rel_path", "part", *keep).agg(
        F.array_sort(F.collect_list(F.struct(F.col("pos"), entry.alias("f")))).alias("fs"), F.min_by("words", F.when(pk, F.col("pos"))).alias("pk"),
    )
    return grouped.withColumn("fields", F.transform("fs", lambda x: x["f"]).cast(FIELDS))


def _field(name: Column, kind: Column, nullable: Column) -> Column:
    return F.struct(name.alias("name"), kind.alias("data_type"), nullable.alias("nullable"))


# Column types of Python types, in small letters; others stay as they are.
HINT_TYPES = {
    "int": "Integer",
    "str": "String",
    "float": "Float",
    "bool": "Boolean",
    "datetime": "DateTime",
    "datetime.datetime": "DateTime",
    "date": "Date",
    "datetime.date": "Date",
    "decimal": "Numeric",
    "decimal.decimal": "Numeric",
}


def sqlalchemy_entities(files: DataFrame) -> dict[str, DataFrame]:
    """Classes below Base, or tables of SQLModel. Fields with a type hint are a class's fields, or if there are none, those with
    a value; a column's type is its hint's, or the first argument's. Classes without fields are none.
    """
    own = select_files(files, PY, ["sqlalchemy", "sqlmodel"]).where(~F.col("content").rlike(r"(?m)^(from|import)\s+django"))
    bases = F.transform(F.split(F.coalesce("bases", F.lit("")), ","), lambda b: F.trim(b))
    cut = classes(own).where("name <> 'Base'").where(F.array_contains(bases, "Base") | F.col("bases").rlike(r"\btable\s*=\s*True\b"))
    named = F.filter("members", lambda m: m["words"] == "__tablename__")
    cut = cut.withColumn("tbl", F.coalesce(first(F.try_element_at(named, F.lit(1))["value"], r"^['\"]([^'\"]+)['\"]"), snake_case(F.col("name"))))
    plain = F.filter("members", lambda m: m["params"].isNull() & m["words"].rlike("^[a-z][a-z0-9_]*$"))
    hinted = F.filter(plain, lambda m: m["tail"].isNotNull())
    cut = cut.withColumn("members", F.when(F.size(hinted) > 0, hinted).otherwise(F.filter(plain, lambda m: m["value"].isNotNull())))
    found = members(cut.withColumn("fqn", F.concat("mod", F.lit("."), "name")), "fqn", "tbl")
    value = F.coalesce("value", F.lit(""))
    relates = value.rlike(r"\b[Rr]elationship\s*\(")
    hint = F.regexp_replace(F.regexp_replace("tail", r"Mapped\[(.+)\]", "$1"), r"Optional\[(.+)\]", "$1")
    known = F.create_map(*(F.lit(x) for kv in HINT_TYPES.items() for x in kv))
    by_hint = F.when((F.col("tail") != "Any") & F.col("value").isNotNull(), F.coalesce(F.try_element_at(known, F.lower(hint)), hint))
    kind = F.coalesce(by_hint, first(F.col("value"), r"\bColumn\s*\(\s*(?:['\"][^'\"]*['\"]\s*,\s*)?([\w.]+)"), F.lit("Unknown"))
    columns = found.where(~relates)
    nullable = F.coalesce(first(value, r"\bnullable\s*=\s*(True|False)") == "True", F.lit(True))
    made = _entities(columns, ["fqn", "tbl"], _field(F.col("words"), kind, nullable), value.rlike(r"\bprimary_key\s*=\s*True"))
    keyed = F.coalesce(first(value, r"\bforeign_key\s*=\s*['\"](\w+)"), first(value, r"\bForeignKey\s*\(\s*['\"](?:\w+\.)*?(\w+)\.\w+['\"]"))
    entity = F.array_join(F.transform(F.split(keyed, "_"), capitalised), "")
    fks = columns.withColumns({"target": entity, "what": F.lit("Foreign key reference")}).where("target IS NOT NULL")
    quoted = F.coalesce(first(F.col("tail"), r"[Ll]ist\s*\[\s*['\"](.+?)['\"]\s*\]"), first(F.col("tail"), r"['\"]([A-Z]\w*)['\"]"))
    target = F.coalesce(first(value, r"\brelationship\s*\(\s*['\"]([^'\"]+)['\"]"), quoted)
    rels = found.where(relates).withColumns({"target": target, "what": F.lit("SQLAlchemy relationship")}).where("target IS NOT NULL")
    edges = fks.unionByName(rels)
    return {
        "data_entities": rows("data_entities", made, "sqlalchemy-entities", component_id=F.col("fqn"), name=F.col("tbl"), type="table", fields=F.col("fields"), primary_key=F.col("pk")),
        "relationships": rows("relationships", edges, "sqlalchemy-entities", source_id=F.col("fqn"), target_id=F.col("target"), type="DEPENDS_ON", description=F.col("what"), technology="SQLAlchemy"),
    }


# Fixed values, in the order in which they are tried: the first that the field's class contains decides; others stay.
DJANGO_TYPES = [
    ("CharField", "VARCHAR"),
    ("TextField", "VARCHAR"),
    ("EmailField", "VARCHAR"),
    ("URLField", "VARCHAR"),
    ("IntegerField", "INTEGER"),
    ("BooleanField", "BOOLEAN"),
    ("DateTimeField", "DATETIME"),
    ("DateField", "DATE"),
    ("TimeField", "TIME"),
    ("DecimalField", "DECIMAL"),
    ("FloatField", "FLOAT"),
    ("BinaryField", "BLOB"),
    ("JSONField", "JSON"),
    ("UUIDField", "UUID"),
    ("AutoField", "SERIAL"),
]


def django_orm(files: DataFrame) -> dict[str, DataFrame]:
    own = select_files(files, ["**/models.py", "**/*_models.py"], ["models.Model"]).where(~F.col("content").rlike(r"(?m)^(from|import)\s+sqlalchemy"))
    cut = classes(own).where(F.col("bases").contains("models.Model")).withColumn("fqn", F.concat("mod", F.lit("."), "name"))
    found = members(cut, "fqn", "name").withColumn("kind", first(F.col("value"), r"^models\.(\w+)\s*\(")).where("kind IS NOT NULL")
    args = F.regexp_extract("value", r"^models\.\w+\s*(?s)\((.*)\)\s*$", 1)
    related = F.col("kind").isin("ForeignKey", "OneToOneField", "ManyToManyField")
    entry = _field(F.col("words"), one_of(F.col("kind"), DJANGO_TYPES, F.col("kind")), args.rlike(r"\b(null|blank)\s*=\s*True"))
    made = _entities(found.where(~related), ["fqn", "name"], entry, args.rlike(r"\bprimary_key\s*=\s*True"))
    implicit = F.array(F.struct(F.lit("id"), F.lit("AutoField"), F.lit(False)).cast(FIELDS.removeprefix("array<")[:-1]))
    fields = F.when(F.col("pk").isNull(), F.concat(implicit, "fields")).otherwise(F.col("fields"))
    edges = found.where(related).withColumn("target", first(args, r"^\s*(?:to\s*=\s*)?['\"]?(?:\w+\.)?(\w+)"))
    return {
        "data_entities": rows("data_entities", made, "django-orm", component_id=F.col("fqn"), name=snake_case(F.col("name")), type="table", fields=fields, primary_key=F.coalesce("pk", F.lit("id"))),
        "relationships": rows("relationships", edges, "django-orm", source_id=F.col("fqn"), target_id=F.col("target"), type="DEPENDS_ON", description=F.col("kind"), technology="Django"),
    }
