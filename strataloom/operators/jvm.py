"""Extraction from Java, Kotlin and JVM build files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions.text import capitalised, file_stem, first, folder_name, make_id, method_path, resource_path, snake_case, some
from strataloom.model import FIELDS, rows
from strataloom.operators.declared import has_note, members, names_of, note, type_of, types
from strataloom.sources.files import code_files, matches, select_files

JAVA = ["**/*.java"]
#: One text or several in braces.
TEXTS = r"(\{\s*(?:\"[^\"]*\"\s*,?\s*)*+\}|\"[^\"]*\")"


def package(content: Column) -> Column:
    return first(content, r"(?m)^\s*package\s+([\w.]+)")


def qualified(pkg: Column, name: Column) -> Column:
    return F.when(pkg.isNull(), name).otherwise(F.concat(pkg, F.lit("."), name))


def java_class(files: DataFrame) -> DataFrame:
    """Adds pkg, cls and fqn of the file's first class; its name is the file's if it has none."""
    with_pkg = files.withColumns({"pkg": package(F.col("content")), "cls": F.coalesce(first(F.col("content"), r"(?:class|interface|record)\s+(\w+)"), file_stem(F.col("rel_path")))})
    return with_pkg.withColumn("fqn", qualified(F.col("pkg"), F.col("cls")))


_DEPENDENCY = "dependency array<struct<groupId:string,artifactId:string,version:string,scope:string>>"
POM = (
    f"artifactId string, groupId string, version string, packaging string, parent struct<groupId:string,version:string>, "
    f"dependencies struct<{_DEPENDENCY}>, dependencyManagement struct<dependencies:struct<{_DEPENDENCY}>>"
)


def maven_dependencies(files: DataFrame) -> dict[str, DataFrame]:
    """Project and management dependencies; those of plugins are not the project's.

    Of a file that is no XML the dependencies are found by pattern, outside of plugins; it gives no component.
    """
    poms = select_files(files, ["**/pom.xml"], ["<project"])
    own = poms.select("rel_path", "content", F.from_xml("content", POM).alias("p"))
    value = lambda c: some(F.trim(c))
    own = own.select(
        "rel_path", "content", value("p.artifactId").alias("artifact"), value("p.packaging").alias("packaging"),
        F.coalesce(value("p.groupId"), value("p.parent.groupId")).alias("grp"),
        F.coalesce(value("p.version"), value("p.parent.version")).alias("ver"),
        F.concat(F.coalesce("p.dependencies.dependency", F.array()), F.coalesce("p.dependencyManagement.dependencies.dependency", F.array())).alias("listed"),
        F.regexp_extract("content", r"(?s)<properties>(.*?)</properties>", 1).alias("props"),
    )
    names, values = (F.regexp_extract_all("props", F.lit(r"(?s)<([\w.-]+)>\s*(.*?)\s*</\1>"), F.lit(g)) for g in (1, 2))
    once = F.array_distinct(names)
    given = F.map_from_arrays(once, F.transform(once, lambda n: F.element_at(values, F.array_position(names, n).cast("int"))))
    builtin = {"project.groupId": "grp", "project.artifactId": "artifact", "project.version": "ver"}
    built = F.map_from_arrays(F.array(*(F.lit(k) for k in builtin)), F.array(*(F.coalesce(c, F.lit("")) for c in builtin.values())))
    own = own.withColumn("known", F.map_concat(F.map_filter(given, lambda k, _: ~k.isin(list(builtin))), built))
    good = own.where("artifact IS NOT NULL")
    parsed = good.select("rel_path", "artifact", "known", F.posexplode("listed").alias("pos", "d")).select("rel_path", "artifact", "known", "pos", "d.*")
    broken = own.where("artifact IS NULL").withColumn("content", F.regexp_replace("content", r"(?s)<plugins>.*?</plugins>", ""))
    blocks = matches(broken, r"(?s)<dependency>(.*?)</dependency>", ["dep"], keep=["known"])
    tag = lambda t: some(F.trim(F.regexp_extract("dep", rf"(?s)<{t}>(.*?)</{t}>", 1))).alias(t)
    matched = blocks.select("rel_path", F.lit("unknown").alias("artifact"), "known", "pos", *(tag(t) for t in ("groupId", "artifactId", "version", "scope")))

    def filled(col: Column) -> Column:
        """Each ${property} once by its value, or left as it is."""
        asked = F.array_distinct(F.regexp_extract_all(col, F.lit(r"\$\{([^}]+)\}"), F.lit(1)))
        put = lambda s, k: F.replace(s, F.concat(F.lit("${"), k, F.lit("}")), F.coalesce(F.try_element_at("known", k), F.concat(F.lit("${"), k, F.lit("}"))))
        return F.when(col.isNull(), col).otherwise(F.aggregate(asked, col, put))

    deps = parsed.unionByName(matched)
    deps = deps.select("rel_path", "artifact", "pos", *(filled(value(F.col(t))).alias(t) for t in ("groupId", "artifactId", "version", "scope")))
    deps = deps.where("groupId IS NOT NULL AND artifactId IS NOT NULL")
    kind = F.when(F.coalesce("packaging", F.lit("jar")) == "jar", "LIBRARY").otherwise("SERVICE")
    return {
        "components": rows("components", good, "maven-dependencies", id=make_id("maven", F.col("grp"), F.col("artifact")), name=F.col("artifact"), type=kind, technology="Maven"),
        "dependencies": rows("dependencies", deps, "maven-dependencies", source_component_id=F.col("artifact"), group_id=F.col("groupId"), artifact_id=F.col("artifactId"), version=F.col("version"), scope=F.col("scope")),
    }


CONFIGURATIONS = "implementation|api|compileOnly|runtimeOnly|testImplementation|testRuntimeOnly|annotationProcessor"


def gradle_dependencies(files: DataFrame) -> dict[str, DataFrame]:
    builds = select_files(files, ["**/build.gradle", "**/build.gradle.kts"]).withColumn("project", folder_name(F.col("rel_path")))
    names = ["configuration", "grp", "artifact", "version"]
    text = matches(builds, rf"\b({CONFIGURATIONS})\s*\(?\s*['\"]([^:'\"]+):([^:'\"]+)(?::([^'\"]+))?['\"]", names, keep=["project"])
    by_map = matches(builds, rf"\b({CONFIGURATIONS})\s*\(?\s*group\s*[:=]\s*['\"]([^'\"]+)['\"]\s*,\s*name\s*[:=]\s*['\"]([^'\"]+)['\"](?:\s*,\s*version\s*[:=]\s*['\"]([^'\"]+)['\"])?", names, keep=["project"])
    deps = text.unionByName(by_map)
    scope = F.when(F.col("configuration").startswith("test"), "test").when(F.col("configuration") == "compileOnly", "provided").when(F.col("configuration") == "runtimeOnly", "runtime").when(F.col("configuration") == "annotationProcessor", "provided").otherwise("compile")
    return {
        "components": rows("components", builds, "gradle-dependencies", id=make_id("gradle", F.col("project")), name=F.col("project"), type="SERVICE", technology="Gradle"),
        "dependencies": rows("dependencies", deps, "gradle-dependencies", source_component_id=F.col("project"), group_id=F.col("grp"), artifact_id=F.col("artifact"), version=F.col("version"), scope=scope),
    }


STEREOTYPES = ["RestController", "Controller", "Service", "Repository", "Component", "Configuration"]


def spring_components(files: DataFrame) -> dict[str, DataFrame]:
    """One component for each simple class name and kind of id: of several classes of one name the first path's stays."""
    found = types(files, "java", JAVA, ["org.springframework"], ["class"])
    found = found.select("rel_path", "fqn", F.col("name").alias("cls"), note(F.col("notes"), *STEREOTYPES)["name"].alias("kind"))
    found = found.where("kind IS NOT NULL").dropDuplicates(["rel_path", "fqn"])
    service = F.col("kind").isin("RestController", "Controller", "Service")
    return {"components": rows("components", found, "spring-components", id=make_id(F.col("fqn")), name=F.col("cls"), type=F.when(service, "SERVICE").otherwise("MODULE"), technology="Spring")}


def _parameters(params: Column, annotations: list[str]) -> Column:
    """`Annotation:name:Type` of each annotated parameter, joined by commas; null without any."""
    marked = F.filter(params, lambda p: has_note(p["notes"], *annotations))
    name = lambda p: F.element_at(names_of(p["words"]), 1)
    shown = F.transform(marked, lambda p: F.concat_ws(":", note(p["notes"], *annotations)["name"], name(p), type_of(p["words"])))
    return some(F.array_join(shown, ", "))


def _texts(args: Column, attributes: str) -> Column:
    """The texts of an annotation's attribute, or of its only value: one or several; [""] without any."""
    some_text = F.coalesce(first(args, rf"\b(?:{attributes})\s*=\s*{TEXTS}"), first(args, rf"^\s*{TEXTS}"))
    texts = F.regexp_extract_all(some_text, F.lit(r'"([^"]*)"'), F.lit(1))
    return F.when(F.coalesce(F.size(texts), F.lit(0)) > 0, texts).otherwise(F.array(F.lit("")))


MAPPINGS = ["GetMapping", "PostMapping", "PutMapping", "DeleteMapping", "PatchMapping", "RequestMapping"]


def spring_rest_api(files: DataFrame) -> dict[str, DataFrame]:
    """A row for each method, path and HTTP method; braces in paths are kept."""
    own = types(files, "java", JAVA, ["RestController", "Controller"]).where(has_note(F.col("notes"), "RestController", "Controller"))
    own = own.withColumn("base", F.element_at(_texts(note(F.col("notes"), "RequestMapping")["args"], "value|path"), 1))
    found = members(own, "fqn", "base").withColumn("mapping", note(F.col("notes"), *MAPPINGS)).where("params IS NOT NULL AND mapping IS NOT NULL")
    found = found.withColumns({"verb": F.regexp_replace("mapping.name", "Mapping$", ""), "args": F.coalesce("mapping.args", F.lit(""))})
    listed = F.regexp_extract_all("args", F.lit(r"RequestMethod\.(\w+)|(?<==\s{0,3})(GET|POST|PUT|DELETE|PATCH)\b"), F.lit(0))
    named = F.transform(listed, lambda x: F.regexp_replace(x, r"^RequestMethod\.", ""))
    verbs = F.when(F.col("verb") != "Request", F.array(F.upper("verb"))).when(F.size(listed) > 0, named).otherwise(F.array(F.lit("GET")))
    each = found.withColumn("method", F.explode(verbs)).withColumn("path", F.explode(_texts(F.col("args"), "value|path")))
    made = rows(
        "api_endpoints", each, "spring-rest-api", component_id=F.col("fqn"), type="REST", path=method_path(F.col("base"), F.col("path")), method=F.col("method"),
        description=F.concat("fqn", F.lit("."), F.element_at(names_of(F.col("words")), 1)),
        request_schema=_parameters(F.col("params"), ["PathVariable", "RequestParam", "RequestBody", "RequestHeader"]), response_schema=type_of(F.col("words")),
    )
    return {"api_endpoints": made}


# The constants for content types.
MEDIA_TYPES = {
    "MediaType.APPLICATION_JSON": "application/json",
    "MediaType.APPLICATION_XML": "application/xml",
    "MediaType.TEXT_PLAIN": "text/plain",
    "MediaType.TEXT_HTML": "text/html",
    "MediaType.MULTIPART_FORM_DATA": "multipart/form-data",
    "MediaType.APPLICATION_FORM_URLENCODED": "application/x-www-form-urlencoded",
    "MediaType.APPLICATION_OCTET_STREAM": "application/octet-stream",
}


def _content_type(notes: Column, annotation: str) -> Column:
    """The content types of @Produces or @Consumes, without quotes and braces; null without any."""
    args = F.coalesce(note(notes, annotation)["args"], F.lit(""))
    bare = F.trim(F.regexp_replace(F.regexp_replace(args, r"^\s*value\s*=\s*", ""), r"[\"'{}\[\]]", ""))
    for name, value in MEDIA_TYPES.items():
        bare = F.replace(bare, F.lit(name), F.lit(value))
    return some(bare)


JAXRS_VERBS = ["GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS"]
JAXRS_PARAMETERS = ["PathParam", "QueryParam", "FormParam", "HeaderParam", "MatrixParam", "CookieParam"]


def jaxrs_api(files: DataFrame) -> dict[str, DataFrame]:
    path = lambda: first(note(F.col("notes"), "Path")["args"], r"^\s*(?:value\s*=\s*)?\"([^\"]*)\"")
    own = types(files, "java", JAVA, ["javax.ws.rs", "jakarta.ws.rs"]).where(has_note(F.col("notes"), "Path"))
    own = own.withColumns({"base": path(), "made": _content_type(F.col("notes"), "Produces"), "taken": _content_type(F.col("notes"), "Consumes")})
    found = members(own.where("base IS NOT NULL"), "fqn", "base", "made", "taken")
    found = found.withColumn("verb", note(F.col("notes"), *JAXRS_VERBS)["name"]).where("params IS NOT NULL AND verb IS NOT NULL")
    produces = F.coalesce(_content_type(F.col("notes"), "Produces"), "made")
    response = F.concat(type_of(F.col("words")), F.coalesce(F.concat(F.lit(" ("), produces, F.lit(")")), F.lit("")))
    made = rows(
        "api_endpoints", found, "jaxrs-api", component_id=F.col("fqn"), type="REST", path=resource_path(F.col("base"), path()), method=F.col("verb"),
        description=F.concat("fqn", F.lit("."), F.element_at(names_of(F.col("words")), 1)),
        request_schema=F.coalesce(_parameters(F.col("params"), JAXRS_PARAMETERS), _content_type(F.col("notes"), "Consumes"), "taken"), response_schema=response,
    )
    return {"api_endpoints": made}


def grpc_service(files: DataFrame) -> dict[str, DataFrame]:
    own = java_class(code_files(files, JAVA, ["ImplBase"])).withColumn("service", first(F.col("content"), r"extends\s+(?:\w+\.)*?(\w+?)(?:Grpc\.\w+)?ImplBase"))
    found = matches(own, r"(?:@Override\s+)?public\s+void\s+(\w+)\s*\(\s*(\w+)\s+\w+\s*,\s*StreamObserver<(\w+)>", ["rpc", "req", "res"], keep=["fqn", "service"])
    return {"api_endpoints": rows("api_endpoints", found, "grpc-service", component_id=F.col("fqn"), type="GRPC", path=F.concat(F.lit("/"), F.col("service"), F.lit("/"), capitalised(F.col("rpc"))), method="POST", request_schema=F.col("req"), response_schema=F.col("res"))}


def _topics(found: DataFrame, args: str) -> DataFrame:
    return found.withColumn("topic", F.explode(F.regexp_extract_all(args, F.lit(r"\"([^\"]+)\""), F.lit(1))))


def kafka_messaging(files: DataFrame) -> dict[str, DataFrame]:
    own = java_class(code_files(files, JAVA, ["KafkaListener", "KafkaTemplate", "kafkaTemplate", "SendTo"]))
    listen = _topics(matches(own, r"@KafkaListener\s*\([^)]*?topics\s*=\s*(\{[^}]*\}|\"[^\"]*\")", ["args"], keep=["fqn"]), "args")
    reply = _topics(matches(own, r"@SendTo\s*\(\s*(\{[^}]*\}|\"[^\"]*\")", ["args"], keep=["fqn"]), "args")
    send = matches(own, r"(?i:kafkaTemplate)\.send\s*\(\s*([^,)]+)", ["arg"], keep=["fqn"])
    flow = lambda df, topic, **side: rows("message_flows", df, "kafka-messaging", topic=topic, broker="kafka", **side)
    out = flow(listen, F.col("topic"), subscriber_component_id=F.col("fqn"))
    out = out.unionByName(flow(reply, F.col("topic"), publisher_component_id=F.col("fqn")))
    return {"message_flows": out.unionByName(flow(send, F.regexp_replace(F.trim("arg"), '^"|"$', ""), publisher_component_id=F.col("fqn")))}


def rabbitmq_messaging(files: DataFrame) -> dict[str, DataFrame]:
    own = java_class(code_files(files, JAVA, ["RabbitListener", "RabbitTemplate", "rabbitTemplate"]))
    listen = _topics(matches(own, r"@RabbitListener\s*\([^)]*?queues\s*=\s*(\{[^}]*\}|\"[^\"]*\")", ["args"], keep=["fqn"]), "args")
    declared = _topics(matches(own, r"queuesToDeclare\s*=\s*@Queue\s*\(([^)]*)\)", ["args"], keep=["fqn"]), "args")
    send = matches(own, r"(?i:rabbitTemplate)\.(?:convertAndSend|send)\s*\(\s*([^,)]+)", ["arg"], keep=["fqn"])
    flow = lambda df, topic, **side: rows("message_flows", df, "rabbitmq-messaging", topic=topic, broker="rabbitmq", **side)
    out = flow(listen.unionByName(declared), F.col("topic"), subscriber_component_id=F.col("fqn"))
    return {"message_flows": out.unionByName(flow(send, F.regexp_replace(F.trim("arg"), '^"|"$', ""), publisher_component_id=F.col("fqn")))}


def streams(own: DataFrame, scanner_id: str, reads: str, writes: str, through: str, who: str = "fqn") -> dict[str, DataFrame]:
    """Flows of a stream topology: what is read is subscribed to, what is written published, what goes through both."""
    flow = lambda df, **side: rows("message_flows", df, scanner_id, topic=F.col("topic"), broker="kafka", **side)
    both = matches(own, through, ["topic"], keep=[who])
    out = flow(matches(own, reads, ["topic"], keep=[who]), subscriber_component_id=F.col(who))
    out = out.unionByName(flow(matches(own, writes, ["topic"], keep=[who]), publisher_component_id=F.col(who)))
    return {"message_flows": out.unionByName(flow(both, publisher_component_id=F.col(who))).unionByName(flow(both, subscriber_component_id=F.col(who)))}


def kafka_streams(files: DataFrame) -> dict[str, DataFrame]:
    own = java_class(code_files(files, JAVA, ["StreamsBuilder"]))
    return streams(own, "kafka-streams", r"\.(?:stream|table|globalTable)\s*\(\s*\"([^\"]+)\"", r"\.to\s*\(\s*\"([^\"]+)\"", r"\.through\s*\(\s*\"([^\"]+)\"")


RELATIONS = ["OneToMany", "ManyToOne", "OneToOne", "ManyToMany"]


def _fields(own: DataFrame, *keep: str) -> DataFrame:
    """A row for each field that a class declares itself: notes, kind, field, pos; `int a, b` declares two."""
    found = members(own, *keep).where("params IS NULL AND NOT block").withColumn("kind", F.regexp_replace(type_of(F.col("words")), r"(\[\])+$", ""))
    names = found.where("kind <> ''").withColumnRenamed("pos", "line").select("*", F.posexplode(names_of(F.col("words"))).alias("k", "field"))
    return names.withColumn("pos", F.col("line") * 100 + F.col("k")).drop("line", "k")


def _entities(found: DataFrame, keep: list[str], name: Column, nullable: Column, plain: Column) -> DataFrame:
    """Plain fields by class, in their order, and the first key among them; a class without any is there too."""
    entry = F.struct("pos", F.struct(name.alias("name"), F.col("kind").alias("data_type"), nullable.alias("nullable")).alias("f"))
    key = F.when(has_note(F.col("notes"), "Id") & plain, F.col("pos"))
    grouped = found.groupBy("rel_path", "part", *keep).agg(F.array_sort(F.collect_list(F.when(plain, entry))).alias("fs"), F.min_by(name, key).alias("pk"))
    return grouped.withColumn("fields", F.transform("fs", lambda x: x["f"]).cast(FIELDS))


def _edges(found: DataFrame, annotations: list[str], scanner_id: str, technology: str) -> DataFrame:
    edges = found.withColumn("relation", note(F.col("notes"), *annotations)["name"]).where("relation IS NOT NULL")
    target = F.regexp_replace("kind", r"^(?:List|Set|Collection)<(.+)>$", "$1")
    said = F.concat("relation", F.lit(" relation"))
    return rows("relationships", edges, scanner_id, source_id=F.col("fqn"), target_id=target, type="DEPENDS_ON", description=said, technology=technology)


def _collection() -> Column:
    named = first(note(F.col("notes"), "Document")["args"], r"^\s*(?:collection\s*=\s*|value\s*=\s*)?\"([^\"]+)\"")
    return F.coalesce(named, first(note(F.col("notes"), "Document")["args"], r"\bcollection\s*=\s*\"([^\"]+)\""), snake_case(F.col("name")))


def jpa_entities(files: DataFrame) -> dict[str, DataFrame]:
    """Classes marked as entities or documents, with each field that they declare, by its own name."""
    own = types(files, "java", JAVA, ["@Entity", "@Document"]).where(has_note(F.col("notes"), "Entity", "Document"))
    named = F.coalesce(first(note(F.col("notes"), "Table")["args"], r"\bname\s*=\s*\"([^\"]+)\""), snake_case(F.col("name")))
    is_table = has_note(F.col("notes"), "Entity")
    own = own.withColumns({"tbl": F.when(is_table, named).otherwise(_collection()), "what": F.when(is_table, "table").otherwise("collection")})
    keep = ["fqn", "tbl", "what"]
    found = _fields(own, *keep)
    required = F.coalesce(note(F.col("notes"), "Column")["args"], F.lit("")).rlike(r"\bnullable\s*=\s*false\b")
    made = _entities(found, keep, F.col("field"), ~required, ~has_note(F.col("notes"), *RELATIONS))
    made = own.select("rel_path", "part", *keep).join(made, ["rel_path", "part", *keep], "left").withColumn("fields", F.coalesce("fields", F.array().cast(FIELDS)))
    return {
        "data_entities": rows("data_entities", made, "jpa-entities", component_id=F.col("fqn"), name=F.col("tbl"), type=F.col("what"), fields=F.col("fields"), primary_key=F.col("pk")),
        "relationships": _edges(found, RELATIONS, "jpa-entities", "JPA"),
    }


def mongodb(files: DataFrame) -> dict[str, DataFrame]:
    own = types(files, "java", JAVA, ["data.mongodb"]).where(has_note(F.col("notes"), "Document")).withColumn("tbl", _collection())
    keep = ["fqn", "tbl"]
    found = _fields(own, *keep)
    name = F.coalesce(first(note(F.col("notes"), "Field")["args"], r"^\s*(?:name\s*=\s*|value\s*=\s*)?\"([^\"]+)\""), F.col("field"))
    made = _entities(found, keep, name, F.lit(True), ~has_note(F.col("notes"), "DBRef"))
    return {
        "data_entities": rows("data_entities", made, "mongodb", component_id=F.col("fqn"), name=F.col("tbl"), type="collection", fields=F.col("fields"), primary_key=F.col("pk")),
        "relationships": _edges(found, ["DBRef"], "mongodb", "MongoDB"),
    }


# Hosts that are no services.
PRIVATE_HOSTS = r"^(localhost|127\.0\.0\.1|192\.168\..*|10\..*|example\.com)$"


def java_http_client(files: DataFrame) -> dict[str, DataFrame]:
    own = code_files(files, JAVA, ["FeignClient", "RestTemplate", "restTemplate", "WebClient", "webClient"]).withColumn("source", F.coalesce(first(package(F.col("content")), r"^([^.]+)"), F.lit("default")))
    keep = ["source"]
    feign = matches(own, r"@FeignClient\s*\(([^)]*)\)", ["args"], keep=keep)
    named = F.coalesce(first(F.col("args"), r"\bname\s*=\s*\"([^\"]+)\""), first(F.col("args"), r"\bvalue\s*=\s*\"([^\"]+)\""), first(F.col("args"), r"^\s*\"([^\"]+)\""), first(F.col("args"), r"url\s*=\s*\"(?:https?://)?([^\"/:]+)"))
    calls = feign.select("rel_path", "pos", "source", named.alias("target"), F.lit("Feign").alias("technology"))
    rest = matches(own, r"(?i:restTemplate)\.(?:getForObject|getForEntity|postForObject|postForEntity|exchange|put|delete|patchForObject)\s*\(\s*\"https?://([^\"/:]+)", ["target"], keep=keep)
    web = matches(own, r"(?:\.uri|WebClient\.create|\.baseUrl)\s*\(\s*\"https?://([^\"/:]+)", ["target"], keep=keep)
    calls = calls.unionByName(rest.withColumn("technology", F.lit("RestTemplate"))).unionByName(web.withColumn("technology", F.lit("WebClient")))
    good = calls.where(F.col("target").rlike("^[a-zA-Z0-9_-]+$") & ~F.col("target").rlike(PRIVATE_HOSTS))
    return {"relationships": rows("relationships", good, "java-http-client", source_id=F.col("source"), target_id=F.col("target"), type="CALLS", technology=F.col("technology")).dropDuplicates(["source_id", "target_id", "technology"])}
