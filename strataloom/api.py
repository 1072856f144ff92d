"""What a user calls: scan a source tree, see what kind of project it is, list the scanners, compare two catalogs."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions.text import text_or_null
from strataloom.model import KEYS
from strataloom.operators.relational import table_counts
from strataloom.plans import render
from strataloom.plans.scan import registry, scan_with_runs
from strataloom.sources.files import read_files


@dataclass(frozen=True)
class Config:
    """mode: auto, groups or explicit; groups are languages or subjects. Unknown keys of from_dict() are ignored.

    repositories: (name, path) of trees that are scanned beside the root, each below its name. generators: the kinds of
    documents that are written (mermaid, markdown, json), all if empty.
    """

    project: str = "project"
    mode: str = "auto"
    enabled: list[str] = field(default_factory=list)
    groups: list[str] = field(default_factory=list)
    detect_crud: bool = True
    description: str = ""
    version: str = ""
    repositories: list[tuple[str, str]] = field(default_factory=list)
    generators: list[str] = field(default_factory=list)
    include_external: bool = True
    output: str | None = None
    index: bool = True
    settings: dict = field(default_factory=dict)

    @classmethod
    def from_dict(cls, given: dict) -> Config:
        part = lambda d, k: d.get(k) if isinstance(d.get(k), dict) else {}
        scanners, project, generators, output = (part(given, k) for k in ("scanners", "project", "generators", "output"))
        enabled, groups = list(scanners.get("enabled") or []), list(scanners.get("groups") or [])
        mode = str(scanners.get("mode") or ("groups" if groups else "explicit" if enabled else "auto")).lower()
        crud = part(part(scanners, "config"), "rest-event-flow").get("detectCrudPatterns", True)
        repositories = [(str(r["name"]), str(r["path"])) for r in given.get("repositories") or [] if isinstance(r, dict) and r.get("name") and r.get("path")]
        return cls(
            str(project.get("name") or "project"), mode, enabled, groups, bool(crud), str(project.get("description") or ""), str(project.get("version") or ""),
            repositories, list(generators.get("enabled") or []), bool(generators.get("includeExternal", True)), output.get("directory"), bool(output.get("generateIndex", True)), part(scanners, "config"),
        )

    @classmethod
    def from_file(cls, spark: SparkSession, path: str) -> Config:
        """The configuration in a YAML or JSON file, wherever Spark can read it; the default if there is none or it is bad.

        YAML needs a YAML library; without one the file must be JSON, which is YAML too, and a YAML file that is not is an
        error: its restrictions would be lost in silence.
        """
        try:
            import yaml

            load, bad = yaml.safe_load, yaml.YAMLError
        except ImportError:
            load, bad = json.loads, ValueError
        try:
            text = spark.read.text(path, wholetext=True).first()
            given = load(text.value) if text else None
        except AnalysisException:
            return cls()
        except bad:
            if load is json.loads and path.endswith((".yaml", ".yml")):
                raise RuntimeError(f"{path} cannot be read: no YAML library is installed, and it is no JSON") from None
            return cls()
        return cls.from_dict(given) if isinstance(given, dict) else cls()

    def get(self, scanner: str, key: str, default: object = None) -> object:
        """A setting of a scanner, or the default."""
        own = self.settings.get(scanner)
        return own.get(key, default) if isinstance(own, dict) else default


def scan_tree(spark: SparkSession, root: str, config: Config | None = None, output: str | None = None) -> dict[str, DataFrame]:
    """The catalog of the files below root and of the configured repositories, and `scan_runs`, the scanners' runs.

    With an output folder, given here or in the configuration, the documents are written there.
    """
    config = config or Config()
    files = read_files(spark, root)
    for name, path in config.repositories:
        files = files.unionByName(read_files(spark, path).withColumn("rel_path", F.concat(F.lit(f"{name}/"), "rel_path")))
    catalog, runs = scan_with_runs(files, config.mode, config.enabled, config.groups, config.detect_crud)
    if folder := output or config.output:
        pages = render.documents(catalog, table_counts(catalog), config.project, runs, config.include_external, config.description, config.version)
        if config.generators:
            pages = pages.where(F.split_part("path", F.lit("/"), F.lit(1)).isin(config.generators))
        if not config.index:
            pages = pages.where("path <> 'markdown/index.md'")
        render.write_documents(pages, folder)
    return catalog | {"scan_runs": runs}


#: What marks a project, in the order in which it is looked for.
MARKERS = [("pom.xml", "maven"), ("build.gradle", "gradle"), ("package.json", "npm"), ("go.mod", "go"), ("pyproject.toml", "python"), ("requirements.txt", "python"), ("Cargo.toml", "rust")]


def project_type(files: DataFrame) -> DataFrame:
    """(type): by the first marker that some file at the root bears, or generic."""
    out = F.lit("generic")
    for name, kind in reversed(MARKERS):
        out = F.when(F.coalesce(F.bool_or(F.col("rel_path").rlike(rf"^{name}(\.kts)?$")), F.lit(False)), F.lit(kind)).otherwise(out)
    return files.agg(out.alias("type"))


#: What documents are made by and where they go.
GENERATORS = {"mermaid": "diagrams of components, dependencies, entities, flows and calls", "markdown": "catalogs, the scan's quality and an index", "json": "the system's configuration"}
RENDERERS = {"filesystem": "one file a document", "console": "the first lines of a document"}


def listing(spark: SparkSession) -> DataFrame:
    """(kind, id, about): the scanners, generators and renderers that there are."""
    own = [("generator", k, v) for k, v in GENERATORS.items()] + [("renderer", k, v) for k, v in RENDERERS.items()]
    about = F.concat_ws(", ", "language", "subject")
    return registry(spark).select(F.lit("scanner").alias("kind"), F.col("scanner_id").alias("id"), about.alias("about")).unionByName(spark.createDataFrame(own, "kind string, id string, about string"))


def scanners(spark: SparkSession) -> DataFrame:
    return registry(spark)


def diff(before: dict[str, DataFrame], after: dict[str, DataFrame], tables: Iterable[str] = tuple(KEYS)) -> DataFrame:
    """(entity, key, change): rows by key that one catalog has and the other has not."""
    out = None
    for t in tables:
        key = F.concat_ws("|", *(text_or_null(F.col(c)) for c in KEYS[t]))
        old, new = (d[t].select(key.alias("key")).distinct() for d in (before, after))
        both = old.withColumn("was", F.lit(True)).join(new.withColumn("now", F.lit(True)), "key", "full").where("was IS NULL OR now IS NULL")
        part = both.select(F.lit(t).alias("entity"), "key", F.when(F.col("was").isNull(), "added").otherwise("removed").alias("change"))
        out = part if out is None else out.unionByName(part)
    return out
