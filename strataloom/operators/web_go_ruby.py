"""Extraction from JavaScript, Go and Ruby sources and their packaging files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions.text import file_stem, first, folder_name, group_path, make_id, snake_case, unquoted
from strataloom.model import FIELDS, rows
from strataloom.operators.declared import has_note, members, types
from strataloom.sources.files import code_files, in_order, matches, select_files
from strataloom.sources.tables import written


def npm_dependencies(files: DataFrame) -> dict[str, DataFrame]:
    own = select_files(files, ["**/package.json"]).where(~F.col("rel_path").contains("node_modules/") & F.try_parse_json("content").isNotNull())
    kinds = {"dependencies": "compile", "devDependencies": "test", "peerDependencies": "provided"}
    parsed = own.select("rel_path", F.from_json("content", "name string, version string, " + ", ".join(f"{k} map<string,string>" for k in kinds)).alias("p")).select("rel_path", F.coalesce("p.name", folder_name(F.col("rel_path"))).alias("name"), "p.version", *(f"p.{k}" for k in kinds))
    each = None
    for kind, scope in kinds.items():
        part = parsed.select("rel_path", "name", F.lit(scope).alias("scope"), F.explode(F.map_entries(kind)).alias("e"))
        each = part if each is None else each.unionByName(part)
    scoped = F.col("e.key").startswith("@")
    return {
        "components": rows("components", parsed, "npm-dependencies", id=make_id("npm", F.col("name")), name=F.col("name"), type="SERVICE", technology="Node.js"),
        "dependencies": rows("dependencies", each, "npm-dependencies", source_component_id=F.col("name"), group_id=F.when(scoped, F.split_part("e.key", F.lit("/"), F.lit(1))).otherwise("npm"), artifact_id=F.when(scoped, F.split_part("e.key", F.lit("/"), F.lit(2))).otherwise(F.col("e.key")), version=F.col("e.value"), scope=F.col("scope")),
    }


def express_api(files: DataFrame) -> dict[str, DataFrame]:
    own = code_files(files, ["**/*.js", "**/*.ts"], ["express", "Router"], "javascript").withColumn("component", file_stem(F.col("rel_path")))
    found = matches(own, r"\b(?:app|router)\.(get|post|put|delete|patch)\s*\(\s*['\"`]([^'\"`]+)['\"`]", ["verb", "path"], keep=["component"])
    return {"api_endpoints": rows("api_endpoints", found, "express-api", component_id=F.col("component"), type="REST", path=F.col("path"), method=F.upper("verb"))}


def go_modules(files: DataFrame) -> dict[str, DataFrame]:
    own = files.where(F.col("rel_path").rlike(r"(^|/)go\.mod$")).withColumn("module", first(F.col("content"), r"(?m)^module\s+(\S+)"))
    blocks = matches(own, r"require\s*\(([^)]+)\)", ["body"], keep=["module"]).withColumnRenamed("pos", "block")
    inside = matches(blocks, r"([\w./-]+)\s+(v[\w.+-]+)([^\n]*)", ["path", "version", "note"], "body", ["module", "block"]).withColumn("pos", F.row_number().over(Window.partitionBy("rel_path").orderBy("block", "pos"))).drop("block")
    single = matches(own, r"(?m)^require\s+([\w./-]+)\s+(v[\w.+-]+)([^\n]*)", ["path", "version", "note"], keep=["module"])
    deps = in_order([inside, single])
    # a version suffix stays with the name before it: a/b/v2 -> a, b/v2
    group, artifact = F.regexp_extract("path", r"^(.*?)/?([^/]+(?:/v\d+)?)$", 1), F.regexp_extract("path", r"^(.*?)/?([^/]+(?:/v\d+)?)$", 2)
    return {
        "components": rows("components", own, "go-modules", id=make_id("go", F.col("module")), name=F.col("module"), type="SERVICE", technology="Go"),
        "dependencies": rows("dependencies", deps, "go-modules", source_component_id=F.col("module"), group_id=group, artifact_id=artifact, version=F.col("version"), direct=~F.coalesce("note", F.lit("")).contains("indirect")),
    }


def go_package(content: Column) -> Column:
    return F.coalesce(first(content, r"(?m)^package\s+(\w+)"), F.lit("main"))


#: A Go string, interpreted or raw.
GO_STRING = r"(\"[^\"\n]*\"|`[^`]*`)"
GO_VERBS = "GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS|Get|Post|Put|Delete|Patch|Head|Options"


def _whole_prefixes(groups: DataFrame) -> DataFrame:
    """(rel_path, var, prefix): each group's prefix with those of all groups around it before it; circles end.

    Each round puts what the parent has gathered so far in front, so its reach doubles.
    """
    full = written(groups.withColumn("seen", F.array("var")), "groups")
    while True:
        outer = full.select("rel_path", F.col("var").alias("parent"), F.col("parent").alias("_up"), F.col("prefix").alias("_pre"), F.col("seen").alias("_seen"))
        step = full.join(outer, ["rel_path", "parent"], "left")
        on = F.col("_seen").isNotNull() & ~F.arrays_overlap("seen", "_seen")
        step = step.withColumn("moved", F.coalesce(on, F.lit(False)))
        full = written(
            step.select(
                "rel_path", "var", F.when(F.col("moved"), F.col("_up")).alias("parent"), F.when(F.col("moved"), group_path(F.col("_pre"), F.col("prefix"))).otherwise(F.col("prefix")).alias("prefix"),
                F.when(F.col("moved"), F.array_union("seen", "_seen")).otherwise(F.col("seen")).alias("seen"), "moved",
            ), "groups",
        )
        if full.where("moved").isEmpty():
            return full.select("rel_path", "var", "prefix")
        full = full.drop("moved")


def go_http_router(files: DataFrame) -> dict[str, DataFrame]:
    own = code_files(files, ["**/*.go"], ["gin-gonic", "labstack/echo", "go-chi", "gorilla/mux", "gofiber", "net/http"], "go").withColumn("component", go_package(F.col("content")))
    groups = matches(own, rf"\b(\w+)\s*:?=\s*(\w+)\s*\.\s*Group\s*\(\s*{GO_STRING}", ["var", "parent", "prefix"])
    groups = groups.groupBy("rel_path", "var").agg(F.min_by(F.struct("parent", unquoted(F.col("prefix")).alias("prefix")), "pos").alias("g")).select("rel_path", "var", "g.parent", "g.prefix")
    full = _whole_prefixes(groups)
    fn = r"\s*,\s*([\w.]+)"
    verbs = matches(own, rf"\b(\w+)\s*\.\s*({GO_VERBS})\s*\(\s*{GO_STRING}{fn}", ["var", "verb", "path", "fn"], keep=["component"])
    mux = matches(own, rf"\b(\w+)\s*\.\s*HandleFunc\s*\(\s*{GO_STRING}{fn}\s*\)\s*\.\s*Methods\s*\(([^)]*)\)", ["var", "path", "fn", "verb"], keep=["component"])
    mux = mux.withColumn("verb", F.explode(F.regexp_extract_all("verb", F.lit(r"(?:\"|Method)(\w+)"), F.lit(1))))
    plain = matches(own, rf"\b(http)\s*\.\s*HandleFunc\s*\(\s*{GO_STRING}{fn}", ["var", "path", "fn"], keep=["component"]).withColumn("verb", F.lit("GET"))
    routes = in_order([verbs, mux.select(verbs.columns), plain.select(verbs.columns)]).join(full, ["rel_path", "var"], "left")
    return {"api_endpoints": rows("api_endpoints", routes, "go-http-router", component_id=F.col("component"), type="REST", path=group_path(F.col("prefix"), unquoted(F.col("path"))), method=F.upper("verb"), description=F.concat(F.lit("Handler "), "fn"))}


def grpc_service_go(files: DataFrame) -> dict[str, DataFrame]:
    own = code_files(files, ["**/*.go"], ["grpc", "pb."], "go").where(~F.col("rel_path").endswith(".pb.go")).withColumns({"component": go_package(F.col("content")), "service": first(F.col("content"), r"\bpb\.Register(\w+?)Server\(")}).where("service IS NOT NULL")
    found = matches(own, r"func\s+\(\w+\s+\*?\w+\)\s+(\w+)\(\s*\w+\s+context\.Context\s*,\s*\w+\s+\*(?:pb\.)?(\w+)\s*\)\s*\(\s*\*(?:pb\.)?(\w+)", ["rpc", "req", "res"], keep=["component", "service"])
    return {"api_endpoints": rows("api_endpoints", found, "grpc-service-go", component_id=F.col("component"), type="GRPC", path=F.concat(F.lit("/"), "service", F.lit("/"), "rpc"), method="POST", request_schema=F.col("req"), response_schema=F.col("res"))}


# SQL types of Go types; others stay as they are.
GO_TYPES = {
    "int": "INTEGER",
    "int32": "INTEGER",
    "int64": "INTEGER",
    "uint": "INTEGER",
    "uint32": "INTEGER",
    "uint64": "INTEGER",
    "string": "VARCHAR",
    "bool": "BOOLEAN",
    "float32": "FLOAT",
    "float64": "FLOAT",
    "time.Time": "TIMESTAMP",
    "[]byte": "BLOB",
}
# The fields that gorm.Model embeds.
GORM_FIELDS = [("id", "INTEGER", False), ("created_at", "TIMESTAMP", True), ("updated_at", "TIMESTAMP", True), ("deleted_at", "TIMESTAMP", True)]


def go_struct(files: DataFrame) -> dict[str, DataFrame]:
    own = types(files, "go", ["**/*.go"], ["`"], ["type"]).where(F.col("bases") == "struct").withColumn("component", F.coalesce("space", F.lit("main")))
    embeds = F.exists("members", lambda m: m["words"] == "gorm.Model")
    tagged = F.exists("members", lambda m: m["words"].rlike(r"`[^`]*\b(gorm|xorm|db|sql):\""))
    structs = own.withColumn("gorm", embeds).where(tagged | F.col("gorm"))
    line = r"^([A-Z]\w*)\s+([\w.\[\]*]+)\s*`([^`]*)`$"
    part = lambda k: F.regexp_extract("words", line, k)
    found = members(structs, "component", "name").where(F.col("words").rlike(line)).withColumns({"field": part(1), "kind": part(2), "tags": part(3)})
    tag = lambda p: first(F.col("tags"), p)
    column = F.coalesce(tag(r"xorm:\"[^\"]*'(\w+)'"), tag(r"gorm:\"[^\"]*column:(\w+)"), tag(r"\bdb:\"(\w+)"), tag(r"\bsql:\"(\w+)"), snake_case(F.col("field")))
    bare = F.regexp_replace("kind", r"\*", "")
    kind = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in GO_TYPES.items() for x in kv)), bare), bare)
    is_key = F.lower("tags").rlike(r"primary_?key|\bpk\b")
    entry = F.struct(F.col("pos"), F.struct(column.alias("name"), kind.alias("data_type"), (~F.lower("tags").rlike(r"not ?null|primary_?key|\bpk\b")).alias("nullable")).alias("f"))
    grouped = found.withColumn("column", column).groupBy("rel_path", "part").agg(F.array_sort(F.collect_list(entry)).alias("fs"), F.min_by("column", F.when(is_key, F.col("pos"))).alias("pk"))
    base = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(t).alias("data_type"), F.lit(x).alias("nullable")) for n, t, x in GORM_FIELDS)).cast(FIELDS)
    made = structs.join(grouped, ["rel_path", "part"], "left")
    fields = F.concat(F.when(F.col("gorm"), base).otherwise(F.array().cast(FIELDS)), F.coalesce(F.transform("fs", lambda x: x["f"]).cast(FIELDS), F.array().cast(FIELDS)))
    return {"data_entities": rows("data_entities", made, "go-struct", component_id=F.col("component"), name=F.concat(snake_case(F.col("name")), F.lit("s")), type="table", fields=fields, primary_key=F.coalesce("pk", F.when(F.col("gorm"), "id")))}


def _gemfile(lines_: Column) -> Column:
    """For each line the groups that are open there, joined by commas: a fold with the open blocks as its state."""
    opens = lambda x: x.rlike(r"^\s*[a-z]\w*\b.*\bdo\b(\s*\|[^|]*\|)?\s*(#.*)?$")
    groups = lambda x: F.when(x.rlike(r"^\s*group\b"), F.array_join(F.regexp_extract_all(F.regexp_extract(x, r"^\s*group\b(.*?)\bdo\b", 1), F.lit(r"[:'\"](\w+)"), F.lit(1)), ",")).otherwise(F.lit(""))
    start = F.struct(F.array().cast("array<string>").alias("open"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        pop = F.slice(s["open"], F.lit(1), F.greatest(F.lit(0), F.size(s["open"]) - 1))
        now = F.when(opens(x), F.array_append(s["open"], groups(x))).when(x.rlike(r"^\s*end\b"), pop).otherwise(s["open"])
        return F.struct(now.alias("open"), F.array_append(s["out"], F.array_join(F.filter(s["open"], lambda g: g != ""), ",")).alias("out"))

    return F.aggregate(lines_, start, step, lambda s: s["out"])


def bundler_dependencies(files: DataFrame) -> dict[str, DataFrame]:
    gemfiles = files.where(F.col("rel_path").rlike("(^|/)Gemfile$"))
    split = gemfiles.select("rel_path", F.regexp_replace("rel_path", "[^/]*$", "").alias("folder"), F.split("content", "\r?\n", -1).alias("lines"))
    each = split.select("rel_path", "folder", F.posexplode(F.arrays_zip(F.col("lines").alias("line"), _gemfile(F.col("lines")).alias("open"))).alias("line_no", "x")).select("rel_path", "folder", "line_no", "x.*")
    gems = each.select("rel_path", "folder", "line_no", "open", first(F.col("line"), r"^\s*gem\s*\(?\s*['\"]([^'\"]+)['\"]").alias("name"), first(F.col("line"), r"^\s*gem\s*\(?\s*['\"][^'\"]+['\"]\s*,\s*['\"]([^'\"]+)['\"]").alias("asked"), F.nullif(F.array_join(F.regexp_extract_all(F.regexp_extract("line", r"\bgroups?:?\s*(?:=>\s*)?(\[[^\]]*\]|:\w+)", 1), F.lit(r":(\w+)"), F.lit(1)), ","), F.lit("")).alias("inline")).where("name IS NOT NULL")
    gems = gems.withColumn("rn", F.row_number().over(Window.partitionBy("rel_path", "name").orderBy(F.desc("line_no")))).where("rn = 1")
    locks = files.where(F.col("rel_path").rlike(r"(^|/)Gemfile\.lock$"))
    locked = matches(locks, r"(?m)^ {4}([\w.-]+) \(([^)]+)\)", ["name", "locked"]).select(F.regexp_replace("rel_path", "[^/]*$", "").alias("folder"), "name", "locked").groupBy("folder", "name").agg(F.max("locked").alias("locked"))
    deps = gems.join(locked, ["folder", "name"], "left").withColumnRenamed("line_no", "pos")
    group = F.split(F.coalesce("inline", "open"), ",")
    project = folder_name(F.col("rel_path"))
    return {
        "components": rows("components", gemfiles, "bundler-dependencies", id=make_id("bundler", project), name=project, type="SERVICE", technology="Ruby"),
        "dependencies": rows("dependencies", deps, "bundler-dependencies", source_component_id=make_id("bundler", project), group_id="rubygems", artifact_id=F.col("name"), version=F.coalesce("locked", "asked", F.lit("*")), scope=F.when(F.arrays_overlap(group, F.array(F.lit("test"), F.lit("development"))), "test").otherwise("compile")),
    }


#: The REST actions with their methods and path suffixes.
ACTIONS = [("index", "GET", ""), ("show", "GET", "/:id"), ("new", "GET", "/new"), ("create", "POST", ""), ("edit", "GET", "/:id/edit"), ("update", "PUT", "/:id"), ("destroy", "DELETE", "/:id")]


def rails_api(files: DataFrame) -> dict[str, DataFrame]:
    """Public methods of controllers; what follows `private` or `protected` in a class is not public."""
    own = types(files, "ruby", ["**/*_controller.rb"], kinds=["class"]).where(F.col("bases").rlike("Controller(::Base|::API)?$"))
    own = own.withColumn("name", first(F.col("name"), r"^([\w:]+)Controller$")).where("name IS NOT NULL")
    defs = members(own, "name").where(~has_note(F.col("notes"), "hidden")).withColumn("action", first(F.col("words"), r"^def\s+([a-z_]\w*[?!]?)$"))
    defs = defs.where("action IS NOT NULL")
    dimension = files.sparkSession.createDataFrame(ACTIONS, "action string, verb string, suffix string")
    base = F.concat(F.lit("/"), snake_case(F.replace("name", F.lit("::"), F.lit("/"))))
    found = defs.join(F.broadcast(dimension), "action", "left")  # seven rows
    component = make_id("rails", F.col("name"))
    return {
        "components": rows("components", own, "rails-api", id=component, name=F.concat("name", F.lit("Controller")), type="SERVICE", technology="Rails"),
        "api_endpoints": rows("api_endpoints", found, "rails-api", component_id=component, type="REST", path=F.concat(base, F.coalesce("suffix", F.concat(F.lit("/"), "action"))), method=F.coalesce("verb", F.lit("GET")), description=F.concat(F.lit("Action "), "action")),
    }


def _routes(text: str) -> Iterator[tuple[str, str, str]]:
    """(method, path, action) of a routes file; namespaces, scopes and resources with a block nest."""
    import re

    plural = [(a, "PATCH" if a == "update" else m, s) for a, m, s in ACTIONS]
    stack: list[str] = []
    for line in text.split("\n"):
        line = re.sub(r"(^|\s)#.*$", "", line).strip()  # in 'home#index' it is no comment
        opens = bool(re.search(r"\bdo\b(\s*\|.*\|)?$", line))
        base = "".join(stack)
        pushed = ""
        if m := re.match(r"namespace\s+:?['\"]?([\w/]+)", line):
            pushed = "/" + m[1].strip("/")
        elif m := re.match(r"scope\s+(?:path:\s*)?:?['\"]?(/?[\w/:-]+)", line):
            pushed = "/" + m[1].strip("/") if not m[1].startswith("module") else ""
        elif m := re.match(r"(resources?)\s+:?['\"]?(\w+)", line):
            only, skip = (re.search(rf"{w}:\s*(\[[^\]]*\]|:\w+)", line) for w in ("only", "except"))
            named = lambda x: set(re.findall(r"\w+", x[1]))
            for action, verb, suffix in plural:
                if m[1] == "resource":
                    if action == "index":
                        continue
                    suffix = suffix.replace("/:id", "")
                if (not only or action in named(only)) and (not skip or action not in named(skip)):
                    yield verb, f"{base}/{m[2]}{suffix}", f"{m[2]}#{action}"
            pushed = f"/{m[2]}" + ("/:id" if m[1] == "resources" else "")
        elif m := re.match(r"(get|post|put|patch|delete)\b(.*)", line):
            texts = re.findall(r"['\"]([^'\"]*)['\"]", m[2])
            named_path = texts[0] if texts else next(iter(re.findall(r"^[\s(]*:(\w+)", m[2])), "")
            if named_path:
                yield m[1].upper(), f"{base}/{named_path.strip('/')}", texts[1] if len(texts) > 1 and re.search(r"\bto:|=>", m[2]) else named_path
        elif m := re.match(r"match\s+['\"]([^'\"]+)['\"]", line):
            for verb in re.findall(r":(get|post|put|patch|delete)\b", line.partition("via:")[2]):
                yield verb.upper(), f"{base}/{m[1].strip('/')}", m[1]
        elif m := re.match(r"root\s+(?:to:\s*)?['\"]([^'\"]+)['\"]", line):
            yield "GET", base or "/", m[1]
        if opens:
            stack.append(pushed)
        elif line == "end" and stack:
            stack.pop()


def rails_route(files: DataFrame) -> dict[str, DataFrame]:
    """Scopes nest to any depth, so each file is folded line by line, in Arrow batches."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(path, k, *route) for path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k, route in enumerate(_routes(text or ""))]
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["rel_path", "pos", "verb", "path", "action"])

    own = select_files(files, ["**/routes.rb", "**/routes/*.rb"]).select("rel_path", "content")
    found = own.mapInArrow(fold, "rel_path string, pos int, verb string, path string, action string")
    return {"api_endpoints": rows("api_endpoints", found, "rails-route", component_id=make_id("rails-routes", F.regexp_extract("rel_path", r"^(.*?)/?config/routes", 1)), type="REST", path=F.col("path"), method=F.col("verb"), description=F.concat(F.lit("Route to "), "action"))}


def sidekiq_jobs(files: DataFrame) -> dict[str, DataFrame]:
    """A flow for each call of a worker that is defined anywhere, by its full name."""
    own = types(files, "ruby", ["**/*.rb"], ["Sidekiq", "ApplicationWorker", "perform_"], ["class"])
    own = own.withColumn("name", F.concat_ws("::", "space", "name"))
    lines_of = members(own, "name")
    holds = lambda p: F.exists("members", lambda m: m["words"].rlike(p))
    queue = first(F.col("words"), r"^sidekiq_options\b.*?\bqueue:?\s*(?:=>)?\s*(?::|['\"])([\w-]+)")
    queues = lines_of.withColumn("queue", queue).where("queue IS NOT NULL").groupBy("name").agg(F.min("queue").alias("queue"))
    workers = own.where(holds(r"^include\s+(Sidekiq::(Worker|Job)|ApplicationWorker)")).select("name").distinct()
    defined = workers.join(queues, "name", "left").select("name", F.coalesce("queue", F.lit("default")).alias("queue"))
    call = r"\b((?:[A-Z]\w*::)*+[A-Z]\w*)\s*\.\s*(?:set\([^)]*\)\s*\.\s*)?perform_(?:async|in|at|bulk)\b"
    calls = lines_of.select("rel_path", "pos", F.col("name").alias("caller"), F.explode(F.regexp_extract_all("words", F.lit(call), F.lit(1))).alias("callee"))
    found = calls.join(defined, calls.callee == defined.name)
    return {"message_flows": rows("message_flows", found, "sidekiq-jobs", publisher_component_id=F.col("caller"), subscriber_component_id=F.col("name"), topic=F.col("queue"), message_type=F.col("name"), broker="sidekiq")}
