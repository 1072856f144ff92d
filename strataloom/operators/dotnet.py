"""Extraction from C# sources, project and solution files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions.text import file_stem, first, folder_name, make_id, one_of, plural, some, template_path
from strataloom.model import FIELDS, rows
from strataloom.operators.declared import has_note, members, names_of, note, type_of, types
from strataloom.operators.jvm import streams
from strataloom.sources.files import code_files, in_order, matches, select_files
from strataloom.sources.tables import written

CS = ["**/*.cs"]

def namespace(content: Column) -> Column:
    return first(content, r"namespace\s+([\w.]+)")


def classes(files: DataFrame, words: list[str]) -> DataFrame:
    """The classes of C# files, with their attributes, bases and members."""
    return types(files, "csharp", CS, words, ["class", "record", "struct"])


def nuget_dependencies(files: DataFrame) -> dict[str, DataFrame]:
    own = select_files(files, ["**/*.csproj", "**/packages.config", "**/Directory.Build.props", "**/Directory.Packages.props"]).withColumn("project", F.when(F.col("rel_path").endswith(".csproj"), file_stem(F.col("rel_path"))).otherwise(folder_name(F.col("rel_path"))))
    refs = matches(own, r"<(?:PackageReference|PackageVersion)\s+([^>]*)(?:/>|>([^<]*(?:<Version>[^<]*)?))", ["attrs", "rest"], keep=["project"])
    attr = lambda n, col="attrs": first(F.col(col), rf"\b{n}\s*=\s*\"([^\"]*)\"")
    modern = refs.select("rel_path", "pos", "project", F.coalesce(attr("Include"), attr("Update")).alias("name"), F.coalesce(attr("Version"), first(F.col("rest"), r"<Version>\s*([^<\s]+)"), F.lit("*")).alias("version"))
    old = matches(own, r"<Reference\s+Include=\"([^\",]+)([^\"]*)\"[^>]*?(?:/>|>((?s).*?)</Reference>)", ["name", "attrs", "rest"], keep=["project"]).where(~F.col("name").rlike(r"^(System(\..*)?|mscorlib|Microsoft\.CSharp)$"))
    old = old.select("rel_path", "pos", "project", "name", F.coalesce(first(F.col("attrs"), r"Version=(\d+\.\d+\.\d+)"), first(F.col("rest"), r"<HintPath>[^<]*?\.(\d+\.\d+(?:\.\d+)?)[\\/]"), F.lit("*")).alias("version"))
    config = matches(own, r"<package\s+([^>]*?)/?>", ["attrs"], keep=["project"]).select("rel_path", "pos", "project", attr("id").alias("name"), F.coalesce(attr("version"), F.lit("*")).alias("version"))
    deps = in_order([modern, old, config]).where("name IS NOT NULL")
    projects = own.where(F.col("rel_path").endswith(".csproj"))
    source = make_id("nuget", F.col("project"))
    return {
        "components": rows("components", projects, "nuget-dependencies", id=source, name=F.col("project"), type="SERVICE", technology=".NET"),
        "dependencies": rows("dependencies", deps, "nuget-dependencies", source_component_id=source, group_id="nuget", artifact_id=F.col("name"), version=F.col("version")),
    }


def dotnet_solution(files: DataFrame) -> dict[str, DataFrame]:
    own = select_files(files, ["**/*.sln"])
    found = matches(own, r"(?m)^\s*Project\(\"[^\"]*\"\)[ =]*\"([^\"]*)\"[ ,]*\"([^\"]*)\"", ["name", "path"]).where(~F.col("path").endswith(".sln") & F.col("path").rlike(r"proj$"))
    once = found.withColumn("rn", F.row_number().over(Window.partitionBy("rel_path", "name").orderBy("pos"))).where("rn = 1")
    kind = one_of(F.lower("path"), [("web", "SERVICE"), ("api", "SERVICE"), ("mvc", "SERVICE"), ("test", "MODULE"), ("infra", "MODULE"), ("data", "MODULE"), ("core", "MODULE")], F.lit("LIBRARY"))
    return {"components": rows("components", once, "dotnet-solution", id=make_id("dotnet-project", F.col("name")), name=F.col("name"), type=kind, technology=".NET")}


PRIMITIVE = r"^(int|long|string|bool|double|decimal|float|Guid|DateTime)\??$"


def _parameters(params: Column, path: Column) -> Column:
    """`Route: a; Query: b; Body: T` of a method's parameters, null without any."""
    source = lambda p: F.regexp_replace(F.try_element_at(F.filter(p["notes"], lambda n: n["name"].startswith("From")), F.lit(1))["name"], "^From", "")
    each = F.transform(params, lambda p: F.struct(F.element_at(names_of(p["words"]), 1).alias("n"), type_of(p["words"]).alias("t"), F.coalesce(source(p), F.lit("")).alias("f")))
    in_route = lambda p: (p["f"] == "Route") | ((p["f"] == "") & F.contains(path, F.concat(F.lit("{"), p["n"])))
    in_query = lambda p: (p["f"] == "Query") | ((p["f"] == "") & ~in_route(p) & p["t"].rlike(PRIMITIVE))
    in_body = lambda p: (p["f"] == "Body") | ((p["f"] == "") & ~in_route(p) & ~in_query(p) & (p["t"] != "CancellationToken"))
    shown = lambda label, keep: F.when(F.size(F.filter(each, keep)) > 0, F.concat(F.lit(f"{label}: "), F.array_join(F.transform(F.filter(each, keep), lambda p: F.concat(p["n"], F.lit(": "), p["t"])), ", ")))
    return some(F.array_join(F.array_compact(F.array(shown("Route", in_route), shown("Query", in_query), shown("Body", in_body))), "; "))


HTTP_VERBS = ["HttpGet", "HttpPost", "HttpPut", "HttpDelete", "HttpPatch"]


def aspnetcore_rest(files: DataFrame) -> dict[str, DataFrame]:
    text = lambda args: first(args, r"^\s*(?:template\s*:\s*)?@?\"([^\"]*)\"")
    own = classes(files, ["Controller", "ControllerBase"]).where(F.col("name").endswith("Controller") | has_note(F.col("notes"), "ApiController"))
    short = F.lower(F.regexp_replace("name", "Controller$", ""))
    base = F.coalesce(F.regexp_replace(text(note(F.col("notes"), "Route")["args"]), r"\[controller\]", F.lit("\u0001")), F.concat(F.lit("api/"), short))
    own = own.withColumn("base", F.replace(base, F.lit("\u0001"), short))
    found = members(own, "fqn", "base").withColumn("verb", note(F.col("notes"), *HTTP_VERBS)).where("params IS NOT NULL AND verb IS NOT NULL AND words LIKE '%public%'")
    whole = template_path(F.col("base"), text(F.col("verb.args")))
    response = F.regexp_replace(F.regexp_replace(type_of(F.col("words")), r"^(?:Value)?Task<(.*)>$", "$1"), r"^ActionResult<(.*)>$", "$1")
    out = rows(
        "api_endpoints", found, "aspnetcore-rest", component_id=F.col("fqn"), type="REST", path=whole, method=F.upper(F.regexp_replace("verb.name", "^Http", "")),
        description=F.concat(F.lit("Action "), F.element_at(names_of(F.col("words")), 1)), request_schema=_parameters(F.col("params"), whole), response_schema=response,
    )
    minimal = matches(code_files(files, CS, [".MapGet", ".MapPost", ".MapPut", ".MapDelete"], "csharp").withColumn("fqn", file_stem(F.col("rel_path"))), r"\.Map(Get|Post|Put|Delete|Patch)\s*\(\s*\"([^\"]*)\"", ["verb", "path"], keep=["fqn"])
    out = out.unionByName(rows("api_endpoints", minimal, "aspnetcore-rest", component_id=F.col("fqn"), type="REST", path=F.col("path"), method=F.upper("verb"), description="Minimal API"))
    pages = code_files(files, ["**/Pages/**.cshtml.cs"], ["PageModel"], "csharp").withColumn("fqn", F.concat(F.coalesce(F.concat(namespace(F.col("content")), F.lit(".")), F.lit("")), F.coalesce(first(F.col("content"), r"class\s+(\w+)"), file_stem(F.col("rel_path")))))
    handlers = matches(pages, r"\bOn(Get|Post|Put|Delete)(?:Async)?\s*\(", ["verb"], keep=["fqn"])
    route = F.regexp_replace(F.regexp_replace(F.regexp_extract("rel_path", r"(?:^|/)Pages(/.*)\.cshtml\.cs$", 1), r"/Index$", ""), "^$", "/")
    return {"api_endpoints": out.unionByName(rows("api_endpoints", handlers, "aspnetcore-rest", component_id=F.col("fqn"), type="REST", path=route, method=F.upper("verb"), description="Razor Page"))}


def grpc_service_dotnet(files: DataFrame) -> dict[str, DataFrame]:
    own = classes(files, ["Base"]).withColumn("service", first(F.col("bases"), r":\s*(?:\w+\.)*(\w+)\.\1Base\b")).where("service IS NOT NULL")
    found = members(own, "fqn", "service").where("params IS NOT NULL").where(F.col("words").rlike(r"\boverride\b"))
    found = found.withColumn("res", first(type_of(F.col("words")), r"^Task<(\w+)>$")).where("res IS NOT NULL AND size(params) > 0")
    rpc, asked = F.element_at(names_of(F.col("words")), 1), type_of(F.col("params")[0]["words"])
    path = F.concat(F.lit("/"), "service", F.lit("/"), rpc)
    return {"api_endpoints": rows("api_endpoints", found, "grpc-service-dotnet", component_id=F.col("fqn"), type="GRPC", path=path, method="POST", request_schema=asked, response_schema=F.col("res"))}


# SQL types of C# types, in small letters; others stay, in capitals.
SQL_TYPES = {
    "int": "INTEGER",
    "int32": "INTEGER",
    "long": "BIGINT",
    "int64": "BIGINT",
    "short": "SMALLINT",
    "int16": "SMALLINT",
    "byte": "TINYINT",
    "bool": "BOOLEAN",
    "boolean": "BOOLEAN",
    "string": "NVARCHAR",
    "datetime": "DATETIME",
    "datetimeoffset": "DATETIMEOFFSET",
    "decimal": "DECIMAL",
    "double": "FLOAT",
    "float": "REAL",
    "single": "REAL",
    "guid": "UNIQUEIDENTIFIER",
    "byte[]": "VARBINARY",
    "timespan": "TIME",
}


def _closure(known: DataFrame, inherits: DataFrame) -> DataFrame:
    """Classes whose chain of bases reaches a known one; no order of files matters, and circles end.

    Each class looks up its base's base, that one's and so on, twice as far each round, so a chain of n takes log n rounds.
    """
    known = written(known.distinct(), "known")
    hit = known.select(F.col("name").alias("up"), F.lit(True).alias("hit"))
    ways = inherits.select("name", F.col("base").alias("up")).distinct().join(hit, "up", "left")
    ways = written(ways.select("name", "up", F.coalesce("hit", F.lit(False)).alias("hit")), "ways")
    left, reach = ways.count(), 1
    while reach <= left:
        on = ways.select(F.col("name").alias("up"), F.col("up").alias("far"), F.col("hit").alias("also"))
        step = ways.join(on, "up", "left").select("name", F.coalesce("far", "up").alias("up"), (F.col("hit") | F.coalesce("also", F.lit(False))).alias("hit"), F.col("far").isNotNull().alias("moved"))
        ways = written(step.groupBy("name", "up").agg(F.bool_or("hit").alias("hit"), F.bool_or("moved").alias("moved")), "ways")
        reach *= 2
        if ways.where("moved AND NOT hit").isEmpty():
            break
        ways = ways.drop("moved")
    return known.unionByName(ways.where("hit").select("name")).distinct()


#: Names that make a base an entity's: they end in BaseEntity, Entity, AuditableEntity and the like, or EntityBase.
ENTITY_BASE = r"^(?:\w+\.)*\w*(?:Entity|EntityBase)$"
COLLECTIONS = "ICollection|List|IList|IEnumerable|HashSet"


def entity_framework(files: DataFrame) -> dict[str, DataFrame]:
    """Classes of a context's sets, or below an entity's base or another such class, with their properties."""
    made = written(classes(files, ["class", "record"]).select("rel_path", "part", "fqn", F.col("name").alias("cls"), "bases", "members"), "classes")
    bare = F.col("bases")
    for _ in range(4):  # generic arguments, from the inside
        bare = F.regexp_replace(bare, "<[^<>]*>", "")
    bases = F.transform(F.split(F.regexp_extract(bare, r":\s*([^{]*?)(?:\s+where\b.*)?$", 1), ","), lambda b: F.trim(b))
    listed = made.select("cls", bases.alias("bases"))
    sets = matches(code_files(files, CS, ["DbSet<", ".Entity<"], "csharp"), r"(?:DbSet<|\.Entity<)(\w+)>", ["name"]).select("name")
    known = sets.unionByName(listed.where(F.exists("bases", lambda b: b.rlike(ENTITY_BASE))).select(F.col("cls").alias("name")))
    inherits = listed.select(F.col("cls").alias("name"), F.element_at(F.split(F.col("bases")[0], r"\."), -1).alias("base")).where("base NOT IN ('', 'DbContext')")
    names = written(_closure(known, inherits), "entities")
    own = made.join(names.withColumnRenamed("name", "cls"), "cls", "left_semi")
    found = members(own, "fqn", "cls").where("params IS NULL AND block").where(F.col("words").rlike(r"\bpublic\b"))
    found = found.withColumns({"kind": type_of(F.col("words")), "field": F.element_at(names_of(F.col("words")), 1)}).where("kind <> ''")
    many = first(F.col("kind"), rf"^(?:{COLLECTIONS})<(\w+)>")
    found = found.withColumns({"many": many, "bare": F.regexp_replace("kind", r"\?$", "")})
    sql = F.create_map(*(F.lit(x) for kv in SQL_TYPES.items() for x in kv))
    found = found.join(names.select(F.col("name").alias("bare"), F.lit(True).alias("known")), "bare", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    plain = found.where("many IS NULL AND NOT known").withColumn("sql", F.coalesce(F.try_element_at(sql, F.lower("bare")), F.upper("bare")))
    is_key = has_note(F.col("notes"), "Key") | (F.col("field") == "Id") | (F.col("field") == F.concat("cls", F.lit("Id")))
    entry = F.struct(F.col("pos"), F.struct(F.col("field").alias("name"), F.col("sql").alias("data_type"), F.col("kind").contains("?").alias("nullable")).alias("f"))
    grouped = plain.groupBy("rel_path", "part", "fqn", "cls").agg(F.array_sort(F.collect_list(entry)).alias("fs"), F.min_by("field", F.when(is_key, F.col("pos"))).alias("pk"))
    grouped = grouped.withColumn("fields", F.transform("fs", lambda x: x["f"]).cast(FIELDS))
    targets = found.withColumn("target", F.coalesce("many", "bare")).join(names.withColumnRenamed("name", "target"), "target", "left_semi")
    how = F.when(F.col("many").isNotNull(), "one-to-many").otherwise("many-to-one")
    return {
        "data_entities": rows("data_entities", grouped, "entity-framework", component_id=F.col("fqn"), name=plural(F.col("cls")), type="table", fields=F.col("fields"), primary_key=F.col("pk")),
        "relationships": rows("relationships", targets, "entity-framework", source_id=F.col("cls"), target_id=F.col("target"), type="DEPENDS_ON", description=how, technology="Entity Framework"),
    }


def dotnet_kafka_messaging(files: DataFrame) -> dict[str, DataFrame]:
    """Flows of each class: attributes by class; fields and calls, which are the file's, for each of its classes."""
    words = ["Confluent.Kafka", "KafkaConsumer", "KafkaProducer", "ProduceAsync"]
    own = code_files(files, CS, words, "csharp").withColumn("ns", namespace(F.col("content")))
    prefix = F.coalesce(F.concat("ns", F.lit(".")), F.lit(""))
    cls = F.array_distinct(F.regexp_extract_all("content", F.lit(r"(?m)^[^/\n]*?\bclass\s+(\w+)"), F.lit(1)))
    named = F.when(F.size(cls) > 0, cls).otherwise(F.array(file_stem(F.col("rel_path"))))
    each = own.select("rel_path", F.explode(named).alias("cls"), prefix.alias("ns_prefix")).select("rel_path", F.concat("ns_prefix", "cls").alias("fqn"))
    of_class = members(classes(files, words), "fqn")
    marked = lambda kind: of_class.withColumn("topic", first(note(F.col("notes"), f"Kafka{kind}")["args"], r"^\s*\"([^\"]+)\"")).where("topic IS NOT NULL")
    of_file = lambda pattern, names: matches(own, pattern, names).join(each, "rel_path")
    calls = of_file(r"\.(Subscribe|Consume|Produce|ProduceAsync)\s*\(\s*\"([^\"]+)\"", ["call", "topic"])
    held = of_file(r"\bI(Consumer|Producer)<[^>]+>\s+\w+\s*[;{=]", ["side"]).withColumn("topic", F.lit("unknown-topic"))
    reads = F.col("call").isin("Subscribe", "Consume")
    columns = ["rel_path", "pos", "fqn", "topic"]
    consumes = [marked("Consumer"), calls.where(reads), held.where("side = 'Consumer'")]
    produces = [marked("Producer"), calls.where(~reads), held.where("side = 'Producer'")]
    flow = lambda df, pub, sub: rows("message_flows", df.select(*columns), "dotnet-kafka-messaging", topic=F.col("topic"), broker="kafka", publisher_component_id=pub, subscriber_component_id=sub)
    parts = [flow(df, F.lit("unknown-publisher"), F.col("fqn")) for df in consumes] + [flow(df, F.col("fqn"), F.lit("unknown-subscriber")) for df in produces]
    return {"message_flows": reduce(DataFrame.unionByName, parts)}


def streamiz_kafka(files: DataFrame) -> dict[str, DataFrame]:
    own = code_files(files, CS, ["Streamiz"], "csharp").withColumns({"ns": namespace(F.col("content")), "cls": F.coalesce(first(F.col("content"), r"class\s+(\w+)"), file_stem(F.col("rel_path")))})
    own = own.withColumn("fqn", F.concat(F.coalesce(F.concat("ns", F.lit(".")), F.lit("")), "cls"))
    return streams(own, "streamiz-kafka", r"\.(?:Stream|Table|GlobalTable)<[^>]+>\s*\(\s*\"([^\"]+)\"", r"\.To\s*\(\s*\"([^\"]+)\"", r"\.Through\s*\(\s*\"([^\"]+)\"")
