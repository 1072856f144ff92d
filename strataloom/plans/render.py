"""The catalog as diagrams and documents: tables of lines, in order, for each document.

A document is never gathered in one place: its lines are rows (path, part, at, line), and write_documents() sorts them
on disk. `part` orders the sections, `at` the lines within.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions.text import markdown_cell, node_id
from strataloom.operators.relational import component_counts, component_names, external_systems, inferred_keys, quality_gaps, scan_rates
from strataloom.sources.tables import written

LINE = "path string, part int, at string, line string"


def _lines(df: DataFrame, path: str, part: int, at: Column, line: Column) -> DataFrame:
    return df.select(F.lit(path).alias("path"), F.lit(part).alias("part"), at.cast("string").alias("at"), line.alias("line")).distinct()


def _head(df: DataFrame, path: str, *lines: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(path, 0, f"{k:04}", line) for k, line in enumerate(lines)], LINE)


def _join(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("-")) for p in parts))


def c4_context(components: DataFrame, relationships: DataFrame) -> DataFrame:
    path, c = "mermaid/c4-context.md", F.col
    nodes = _lines(components, path, 1, c("id"), _text("    ", F.when(c("type") == "EXTERNAL", "System_Ext").otherwise("System"), "(", node_id(c("id")), ', "', c("name"), '")'))
    edges = _lines(relationships, path, 2, _text(c("source_id"), c("target_id")), _text("    Rel(", node_id(c("source_id")), ", ", node_id(c("target_id")), ', "', c("type"), '")'))
    return _join(_head(components, path, "```mermaid", "C4Context"), nodes, edges)


def c4_level(components: DataFrame, level: str, types: list[str]) -> DataFrame:
    """The container or component level: the components of some types."""
    path, c = f"mermaid/c4-{level.lower()}.md", F.col
    chosen = components.where(c("type").isin(types))
    return _join(_head(components, path, "```mermaid", f"C4{level.capitalize()}"), _lines(chosen, path, 1, c("id"), _text(f"    {level.capitalize()}(", node_id(c("id")), ', "', c("name"), '", "', c("type"), '")')))


def dependency_graph(dependencies: DataFrame) -> DataFrame:
    """Solid edges for direct dependencies, dotted ones for the others."""
    path, c = "mermaid/dependency-graph.md", F.col
    arrow = F.when(c("direct"), " --> ").otherwise(" -.-> ")
    artifact = _text(c("group_id"), ":", c("artifact_id"))
    return _join(_head(dependencies, path, "```mermaid", "graph LR"), _lines(dependencies, path, 1, _text(c("source_component_id"), artifact), _text("    ", node_id(c("source_component_id")), arrow, node_id(artifact))))


def er_diagram(entities: DataFrame) -> DataFrame:
    path, c = "mermaid/er-diagram.md", F.col
    name = F.upper(node_id(c("name")))
    opened = _lines(entities, path, 1, _text(c("name"), "|0"), _text("    ", name, " {"))
    fields = entities.select("name", "primary_key", F.posexplode("fields").alias("k", "f"))
    body = _lines(fields, path, 1, _text(c("name"), "|1|", F.lpad(c("k").cast("string"), 6, "0")), _text("        ", node_id(c("f.data_type")), " ", node_id(c("f.name")), F.when(c("f.name") == c("primary_key"), " PK").otherwise("")))
    closed = _lines(entities, path, 1, _text(c("name"), "|2"), F.lit("    }"))
    keys = inferred_keys(entities)
    edges = _lines(keys, path, 2, _text(c("name"), c("field")), _text("    ", F.upper(node_id(c("target"))), " ||--o{ ", F.upper(node_id(c("name"))), ' : "', c("field"), '"'))
    return _join(_head(entities, path, "```mermaid", "erDiagram"), opened, body, closed, edges)


def message_flow_graph(flows: DataFrame) -> DataFrame:
    path, c = "mermaid/message-flow.md", F.col
    topic = _text("topic_", node_id(c("topic")))
    out = _lines(flows.where("publisher_component_id IS NOT NULL"), path, 1, _text(c("publisher_component_id"), c("topic")), _text("    ", node_id(c("publisher_component_id")), " --> ", topic))
    into = _lines(flows.where("subscriber_component_id IS NOT NULL"), path, 2, _text(c("topic"), c("subscriber_component_id")), _text("    ", topic, " --> ", node_id(c("subscriber_component_id"))))
    return _join(_head(flows, path, "```mermaid", "graph LR"), out, into)


def api_sequence(endpoints: DataFrame) -> DataFrame:
    path, c = "mermaid/sequence.md", F.col
    who = _lines(endpoints, path, 1, c("component_id"), _text("    participant ", node_id(c("component_id"))))
    calls = _lines(endpoints, path, 2, _text(c("component_id"), c("path"), c("method")), _text("    Client->>", node_id(c("component_id")), ": ", c("method"), " ", c("path")))
    return _join(_head(endpoints, path, "```mermaid", "sequenceDiagram"), who, calls)


def _table(df: DataFrame, path: str, title: str, columns: dict[str, Column], at: Column) -> DataFrame:
    head = _head(df, path, f"# {title}", "", f"| {' | '.join(columns)} |", f"|{'---|' * len(columns)}")
    cells: list[Column | str] = []
    for v in columns.values():
        cells += [" | ", markdown_cell(v.cast("string"))]
    return _join(head, _lines(df, path, 1, at, _text("| ", *cells[1:], " |")))


def api_catalog(endpoints: DataFrame, components: DataFrame) -> DataFrame:
    named = component_names(endpoints, "component_id", components)
    c = F.col
    return _table(named, "markdown/api-catalog.md", "API catalog", {"Component": c("component_name"), "Method": c("method"), "Path": c("path"), "Request": c("request_schema")}, _text(c("component_name"), c("path"), c("method")))


def dependency_table(dependencies: DataFrame, components: DataFrame) -> DataFrame:
    named, c = component_names(dependencies, "source_component_id", components), F.col
    return _table(named, "markdown/dependency-matrix.md", "Dependencies", {"Component": c("component_name"), "Group": c("group_id"), "Artifact": c("artifact_id"), "Version": c("version"), "Scope": c("scope")}, _text(c("component_name"), c("group_id"), c("artifact_id")))


def component_catalog(components: DataFrame, endpoints: DataFrame, entities: DataFrame) -> DataFrame:
    counted, c = component_counts(components, endpoints, entities).join(components.select("id", "type"), "id"), F.col
    return _table(counted, "markdown/component-catalog.md", "Components", {"Type": c("type"), "Name": c("name"), "Endpoints": c("endpoints"), "Entities": c("entities")}, _text(c("type"), c("name"), c("id")))


def data_catalog(entities: DataFrame) -> DataFrame:
    c, fields = F.col, entities.select("component_id", "name", "primary_key", F.posexplode("fields").alias("k", "f"))
    return _table(fields, "markdown/data-catalog.md", "Data", {"Entity": c("name"), "Field": c("f.name"), "Type": c("f.data_type"), "Nullable": c("f.nullable"), "Key": F.when(c("f.name") == c("primary_key"), "PK")}, _text(c("name"), F.lpad(c("k").cast("string"), 6, "0")))


def message_flow_catalog(flows: DataFrame) -> DataFrame:
    c = F.col
    return _table(flows, "markdown/message-flow-catalog.md", "Message flows", {"Topic": c("topic"), "Broker": c("broker"), "Publisher": c("publisher_component_id"), "Subscriber": c("subscriber_component_id"), "Message": c("message_type")}, _text(c("topic"), c("publisher_component_id"), c("subscriber_component_id")))


def quality_section(rates: DataFrame, gaps: DataFrame, runs: DataFrame) -> DataFrame:
    """Rates, gaps and a summary of each scanner's run."""
    c = F.col
    one = _table(rates, "markdown/quality.md", "Scan quality", {"Scanner": c("scanner_id"), "Scanned": c("scanned"), "Success %": F.format_number("success_rate", 1)}, c("scanner_id"))
    said = _lines(runs, "markdown/quality.md", 3, c("scanner_id"), _text("- ", c("scanner_id"), ": ", c("summary")))
    return _join(one, said, _lines(gaps, "markdown/quality.md", 2, _text(c("scanner_id"), c("message")), _text("- ", c("severity"), " ", c("scanner_id"), ": ", c("message"))))


def index_page(counts: DataFrame, quality: bool = True) -> DataFrame:
    c = F.col
    links = ["api-catalog", "dependency-matrix", "component-catalog", "data-catalog", "message-flow-catalog"] + ["quality"] * quality
    page = _table(counts, "markdown/index.md", "Architecture", {"Table": c("entity"), "Rows": c("n")}, c("entity"))
    return _join(page, counts.sparkSession.createDataFrame([("markdown/index.md", 2, x, f"- [{x}]({x}.md)") for x in links], LINE))


# The extensions of a technology's sources, and those where no technology is known.
EXTENSIONS = {
    "java": ["java"], "spring": ["java"], "spring boot": ["java"], "maven": ["java"], "gradle": ["java"],
    "kotlin": ["kt", "kts"],
    "python": ["py"], "django": ["py"], "flask": ["py"], "fastapi": ["py"],
    "javascript": ["js", "jsx"], "node.js": ["js", "jsx"], "express": ["js", "jsx"], "react": ["js", "jsx"], "vue": ["js", "jsx"],
    "typescript": ["ts", "tsx"], "angular": ["ts", "tsx"],
    "c#": ["cs"], ".net": ["cs"], "asp.net": ["cs"],
    "go": ["go"], "ruby": ["rb"], "rails": ["rb"], "php": ["php"], "laravel": ["php"], "rust": ["rs"], "scala": ["scala"],
}
COMMON_EXTENSIONS = ["java", "py", "js", "ts", "cs", "go"]
# Where the sources of a component of some type lie; {n} stands for its name.
PATTERNS = {
    "SERVICE": ["**/{n}/**", "src/main/java/{n}/**", "src/{n}/**"],
    "MODULE": ["**/{n}/**", "src/main/java/{n}/**", "src/{n}/**"],
    "LIBRARY": ["**/{n}/**", "lib/{n}/**"],
    "DATABASE": ["**/migrations/**", "**/schema/**", "**/db/**"],
    "API_GATEWAY": ["**/gateway/**", "**/api/**"],
    "MESSAGE_BROKER": ["**/messaging/**", "**/events/**"],
}


def extensions(components: DataFrame) -> DataFrame:
    """(extension): those of the components' technologies; common ones if no technology is known."""
    spark = components.sparkSession
    known = spark.createDataFrame([(t, e) for t, own in EXTENSIONS.items() for e in own], "technology string, extension string")
    found = components.select(F.lower("technology").alias("technology")).distinct().join(F.broadcast(known), "technology").select("extension").distinct()
    common = spark.createDataFrame([(e,) for e in COMMON_EXTENSIONS], "extension string")
    some_ = found.limit(1).select(F.lit(1).alias("_some"))
    return found.unionByName(common.withColumn("_some", F.lit(1)).join(F.broadcast(some_), "_some", "left_anti").drop("_some"))


def path_patterns(components: DataFrame) -> DataFrame:
    """components with `patterns`: the globs of each one's sources, by type, name and repository."""
    bare = F.regexp_replace(F.lower("name"), "[^a-z0-9]", "")
    for suffix in ("service", "application", "api"):
        bare = F.regexp_replace(bare, f"{suffix}$", "")
    own = F.array(F.lit("**/{n}/**"))
    for kind, globs in PATTERNS.items():
        own = F.when(F.col("type") == kind, F.array(*(F.lit(g) for g in globs))).otherwise(own)
    repository = F.regexp_replace(F.replace(F.coalesce("repository", F.lit("")), F.lit("/"), F.lit("")), r"\.git$", "")
    whole = F.when(repository == "", F.array().cast("array<string>")).otherwise(F.array(F.concat(repository, F.lit("/**"))))
    return components.withColumn("_bare", bare).withColumn("patterns", F.concat(F.transform(own, lambda g: F.replace(g, F.lit("{n}"), F.col("_bare"))), whole)).drop("_bare")


def system_json(components: DataFrame, project: str, description: str = "", version: str = "") -> DataFrame:
    """The system's JSON configuration: metadata, extensions, scope, components with their paths, analysis and goals.

    Sections are lines, so that no list is gathered in one place; all but the first of a list begin with a comma.
    """
    path, c = "json/system.json", F.col
    spark = components.sparkSession
    quoted = lambda x: F.regexp_replace(F.to_json(F.struct(x.alias("v"))), r'(?s)^\{"v":(.*)\}$', "$1")
    fixed = lambda part, at, line: spark.createDataFrame([(path, part, at, line)], LINE)
    meta = spark.range(1).select(F.lit(path).alias("path"), F.lit(0).alias("part"), F.lit("0").alias("at"), F.concat(F.lit('{"name":'), quoted(F.lit(project)), F.lit(',"description":'), quoted(F.lit(description)), F.lit(',"version":'), quoted(F.lit(version)), F.lit(",")).alias("line"))

    def listed(df: DataFrame, part: int, at: Column, line: Column) -> DataFrame:
        rows = _lines(df, path, part, at, line)
        least = rows.agg(F.min("at").alias("_least")).withColumn("_one", F.lit(1))
        return rows.withColumn("_one", F.lit(1)).join(F.broadcast(least), "_one").select("path", "part", "at", F.when(c("at") == c("_least"), c("line")).otherwise(F.concat(F.lit(","), "line")).alias("line"))

    one = F.to_json(F.struct(c("name"), F.transform("patterns", lambda g: F.struct(g.alias("pathPattern"))).alias("files"), c("type"), c("technology")))
    return _join(
        meta, fixed(1, "0", '"extensions":['), listed(extensions(components), 2, c("extension"), quoted(c("extension"))), fixed(3, "0", "],"),
        fixed(4, "0", '"ignore":[{"pathPattern":"**/test/**"},{"pathPattern":"**/node_modules/**"},{"pathPattern":"**/target/**"},{"pathPattern":"**/build/**"}],'),
        fixed(5, "0", '"logicalComponents":['), listed(path_patterns(components), 6, _text(c("name"), "|", c("id")), one), fixed(7, "0", "],"),
        fixed(8, "0", '"analysis":{"skipDuplication":false,"skipDependencies":false},"goals":[]}'),
    )


def documents(catalog: dict[str, DataFrame], counts: DataFrame, project: str = "project", runs: DataFrame | None = None, include_external: bool = True, description: str = "", version: str = "") -> DataFrame:
    """All documents of a scanned catalog; the page on the scan's quality too if its runs are given.

    Without external systems, the context diagram has the first systems only, as many as such a diagram shows.
    """
    comp, dep, ep, fl, ent, re = (catalog[t] for t in ("components", "dependencies", "api_endpoints", "message_flows", "data_entities", "relationships"))
    shown = comp if include_external else external_systems(comp, False)
    pages = [quality_section(scan_rates(runs), quality_gaps(runs), runs)] if runs is not None else []
    return _join(
        *pages, c4_context(shown, re), c4_level(comp, "container", ["SERVICE", "EXTERNAL"]), c4_level(comp, "component", ["MODULE", "LIBRARY", "SERVICE"]),
        dependency_graph(dep), er_diagram(ent), message_flow_graph(fl), api_sequence(ep), api_catalog(ep, comp), dependency_table(dep, comp),
        component_catalog(comp, ep, ent), data_catalog(ent), message_flow_catalog(fl), index_page(counts, runs is not None), system_json(comp, project, description, version),
    )


#: Lines up to which a document is one file.
FILE_LINES = 200_000


def write_documents(lines: DataFrame, folder: str, file_lines: int = FILE_LINES) -> list[str]:
    """Writes each document below folder under its own path and returns the paths, in order.

    A document of more than `file_lines` lines goes on in files with numbers before their extension. The lines are
    written by Spark, which commits whole files, to a folder beside, and get their names by renaming: a task that runs
    again leaves nothing behind, and a document is there whole or as it was. No lines go through the driver.
    """
    spark = lines.sparkSession
    lines = written(lines, "lines")
    sizes = {r.path: r["count"] for r in lines.groupBy("path").count().collect()}  # a row a document, of which there are some fifteen kinds
    key, beside = ["path", "part", "at", "line"], f"{folder.rstrip('/')}/_writing-{uuid.uuid4().hex}"
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    try:
        for k, long in enumerate((False, True)):
            chosen = [p for p, n in sizes.items() if (n > file_lines) == long]
            if not chosen:
                continue
            own = lines.where(F.col("path").isin(chosen))
            dealt = own.repartitionByRange(max(2, sum(sizes[p] for p in chosen) // file_lines), *key) if long else own.repartition("path")
            ordered = dealt.withColumn("document", F.md5("path")).sortWithinPartitions("document", *key)  # as the writer asks for it
            ordered.select("document", F.col("line").alias("value")).write.partitionBy("document").text(f"{beside}/{k}")
            for path in chosen:
                made = fs.listStatus(fs_path(f"{beside}/{k}/document={hashlib.md5(path.encode()).hexdigest()}"))
                stem, dot, ext = path.rpartition(".")
                for n, at in enumerate(sorted(str(x.getPath()) for x in made), 1):
                    name = path if n == 1 else f"{stem}.{n}{dot}{ext}"
                    target = fs_path(f"{folder}/{name}")
                    fs.mkdirs(target.getParent())
                    fs.delete(target, False)
                    if not fs.rename(fs_path(at), target):
                        raise OSError(f"{at} cannot be renamed to {target}")
                    out.append(name)
    finally:
        fs.delete(fs_path(beside), True)
    return sorted(out)


#: What a terminal takes as a colour, and as its end.
_COLOUR, _PLAIN = "\033[1;36m", "\033[0m"


def show(lines: DataFrame, path: str, most: int = 200, colours: bool = False, width: int = 80) -> None:
    """Prints the first lines of one document below its name, headings in colour if asked for; the limit is a console's."""
    bright = lambda text: f"{_COLOUR}{text}{_PLAIN}" if colours else text
    print(bright(path))
    print("=" * width)
    for r in lines.where(F.col("path") == path).orderBy("part", "at", "line").limit(most).collect():
        print(bright(r.line) if r.line.startswith("#") else r.line)
    print("-" * width)
