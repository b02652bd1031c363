"""Project graphs out of what build tools leave behind, as (nodes, edges) tables: nodes (project, root), edges (source,
target, kind). Nothing is run; captured reports and manifests are read. Providers register by name, so other tools can be
added: a provider tells whether it applies to a folder and reads its graph."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES, EDGES = "project string, root string", "source string, target string, kind string"
Graph = tuple[DataFrame, DataFrame]
Provider = Callable[[SparkSession, str], Graph]
PROVIDERS: dict[str, tuple[str, Provider]] = {}


def provider(name: str, pattern: str) -> Callable[[Provider], Provider]:
    """Registers a reader for captures whose file name matches a glob."""

    def add(f: Provider) -> Provider:
        PROVIDERS[name] = (pattern, f)
        return f

    return add


@provider("nx", "nx-graph*.json")
def nx_graph(spark: SparkSession, path: str) -> Graph:
    """An Nx graph file: projects with their roots, dependencies between projects; external ones are left out."""
    schema = "graph struct<nodes:map<string,struct<data:struct<root:string>>>,dependencies:map<string,array<struct<source:string,target:string,type:string>>>>"
    g = spark.read.schema(schema).json(path, multiLine=True).select("graph.*")
    nodes = g.select(F.explode("nodes").alias("project", "n")).select("project", F.col("n.data.root").alias("root"))
    edges = g.select(F.explode("dependencies").alias("_s", "d")).select(F.explode("d").alias("d")).select("d.source", "d.target", F.coalesce("d.type", F.lit("static")).alias("kind"))
    return nodes, edges.join(nodes.select(F.col("project").alias("target")), "target", "left_semi").select("source", "target", "kind")


@provider("pants", "pants-peek*.json")
def pants_targets(spark: SparkSession, path: str) -> Graph:
    """The output of a peek over all targets: addresses and their dependencies."""
    t = spark.read.schema("address string, target_type string, dependencies array<string>").json(path, multiLine=True)
    nodes = t.select(F.col("address").alias("project"), F.regexp_extract("address", r"^(?://)?([^:#]*)", 1).alias("root"))
    return nodes, t.select(F.col("address").alias("source"), F.explode("dependencies").alias("target")).withColumn("kind", F.lit("dependency"))


@provider("gradle", "gradle-projects*.json")
def gradle_projects(spark: SparkSession, path: str) -> Graph:
    """A report of projects: path, directory, project dependencies by configuration."""
    p = spark.read.schema("projects array<struct<path:string,projectDir:string,dependencies:array<struct<configuration:string,path:string>>>>").json(path, multiLine=True).select(F.explode("projects").alias("p")).select("p.*")
    nodes = p.select(F.col("path").alias("project"), F.col("projectDir").alias("root"))
    return nodes, p.select(F.col("path").alias("source"), F.explode("dependencies").alias("d")).select("source", F.col("d.path").alias("target"), F.col("d.configuration").alias("kind"))


POM = r"<{tag}>\s*([^<]+?)\s*</{tag}>"


@provider("maven", "pom.xml")
def maven_modules(spark: SparkSession, path: str) -> Graph:
    """The pom.xml files below a folder: modules of their parents' folders, and dependencies between them by artifact."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "pom.xml").text(path, wholetext=True).select(F.col("value").alias("xml"), F.regexp_replace(F.col("_metadata.file_path"), r"/pom\.xml$", "").alias("root"))
    tag = lambda t, c: F.regexp_extract(c, POM.format(tag=t), 1)
    # The project's own artifact: the first outside the parent and the dependencies.
    own = F.regexp_replace("xml", r"(?s)<(parent|dependencies|dependencyManagement|build|profiles)>.*?</\1>", "")
    poms = rows.select("xml", "root", tag("artifactId", own).alias("project"))
    nodes = poms.select("project", "root")
    wants = poms.select(F.col("project").alias("source"), F.explode(F.regexp_extract_all("xml", F.lit(r"(?s)<dependency>(.*?)</dependency>"), F.lit(1))).alias("d")).select("source", tag("artifactId", F.col("d")).alias("target"), F.when(tag("scope", F.col("d")) == "", "compile").otherwise(tag("scope", F.col("d"))).alias("kind"))
    inside = wants.join(nodes.select(F.col("project").alias("target")).distinct(), "target", "left_semi").select("source", "target", "kind")
    modules = poms.select(F.col("project").alias("source"), "root", F.explode(F.regexp_extract_all(own, F.lit(POM.format(tag="module")), F.lit(1))).alias("m")).select("source", F.concat("root", F.lit("/"), "m").alias("at"))
    held = modules.join(nodes.select(F.col("project").alias("target"), F.col("root").alias("at")), "at").select("source", "target", F.lit("module").alias("kind"))
    return nodes, inside.union(held)


@provider("go", "go.mod")
def go_modules(spark: SparkSession, path: str) -> Graph:
    """The go.mod files below a folder: required modules that are themselves in it."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "go.mod").text(path, wholetext=True).select(F.col("value").alias("text"), F.regexp_replace(F.col("_metadata.file_path"), r"/go\.mod$", "").alias("root"))
    mods = rows.select(F.regexp_extract("text", r"(?m)^module\s+(\S+)", 1).alias("project"), "root", "text")
    nodes = mods.select("project", "root")
    block = F.array_join(F.regexp_extract_all("text", F.lit(r"(?s)require\s*\((.*?)\)"), F.lit(1)), "\n")
    listed = F.regexp_extract_all(block, F.lit(r"(?m)^\s*([^\s/][^\s]*)\s+v"), F.lit(1))
    single = F.regexp_extract_all("text", F.lit(r"(?m)^require\s+([^\s(]+)\s+v"), F.lit(1))
    wants = mods.select(F.col("project").alias("source"), F.explode(F.array_distinct(F.concat(listed, single))).alias("target")).withColumn("kind", F.lit("require"))
    return nodes, wants.join(nodes.select(F.col("project").alias("target")), "target", "left_semi").select("source", "target", "kind")


@provider("cargo", "cargo-metadata*.json")
def cargo_packages(spark: SparkSession, path: str) -> Graph:
    """Cargo's metadata: packages of the workspace and what they need of each other by path."""
    schema = "packages array<struct<name:string,manifest_path:string,dependencies:array<struct<name:string,kind:string,path:string>>>>"
    p = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("packages").alias("p")).select("p.*")
    nodes = p.select(F.col("name").alias("project"), F.regexp_replace("manifest_path", r"/Cargo\.toml$", "").alias("root"))
    wants = p.select(F.col("name").alias("source"), F.explode("dependencies").alias("d")).where("d.path IS NOT NULL").select("source", F.col("d.name").alias("target"), F.coalesce("d.kind", F.lit("normal")).alias("kind"))
    return nodes, wants.join(nodes.select(F.col("project").alias("target")), "target", "left_semi").select("source", "target", "kind")


@provider("vitest", "vite-graph*.json")
def vite_graph(spark: SparkSession, path: str) -> Graph:
    """A module graph by file: {"modules": {file: [imported file]}}."""
    m = spark.read.schema("modules map<string,array<string>>").json(path, multiLine=True).select(F.explode("modules").alias("source", "t"))
    edges = m.select("source", F.explode("t").alias("target")).withColumn("kind", F.lit("import"))
    return m.select(F.col("source").alias("project"), F.col("source").alias("root")), edges


def resolved_imports(spark: SparkSession, path: str) -> DataFrame:
    """Imports that a language's own resolver captured, one JSON object a line: importer, specifier, resolved file, state.

    The same form serves a TypeScript resolver and a Python type server."""
    rows = spark.read.schema("importer string, specifier string, resolved string, external boolean").json(path)
    state = F.when(F.col("external"), "external").when(F.col("resolved").isNull(), "unresolved").otherwise("resolved")
    return rows.select(F.col("importer").alias("path"), "specifier", F.when(state == "resolved", F.col("resolved")).alias("target"), state.alias("state"))


def structural_matches(spark: SparkSession, path: str, limit: int) -> DataFrame:
    """Matches that a structural search captured, one JSON object a line: file, range, text; the first `limit` by place."""
    schema = "file string, text string, range struct<start:struct<line:int,column:int>,end:struct<line:int,column:int>>"
    m = spark.read.schema(schema).json(path).select(F.col("file").alias("path"), (F.col("range.start.line") + 1).alias("start_line"), (F.col("range.end.line") + 1).alias("end_line"), (F.col("range.start.column") + 1).alias("column"), "text")
    return m.orderBy("path", "start_line", "column", "text").limit(limit)


def collected_tests(spark: SparkSession, path: str) -> DataFrame:
    """(suite, path, test) of a captured test collection: node ids path::name, repeated ones once."""
    r = spark.read.schema("suite string, tests array<string>").json(path, multiLine=True).select("suite", F.explode("tests").alias("id"))
    return r.select("suite", F.substring_index("id", "::", 1).alias("path"), F.regexp_extract("id", r"::(.*)$", 1).alias("test")).distinct()


def declared_links(spark: SparkSession, text: str) -> Graph:
    """Links that a user declares in TOML: [[project]] name, root, inputs; [[link]] source, target, kind. Projects that
    name one shared input are linked by it."""
    import tomllib

    d = tomllib.loads(text)
    projects, links = d.get("project", []), d.get("link", [])
    nodes = spark.createDataFrame([(p["name"], p.get("root", "")) for p in projects], NODES)
    known = {p["name"] for p in projects}
    for x in links:
        if {x["source"], x["target"]} - known:
            raise ValueError(f"a link names no declared project: {json.dumps(x, sort_keys=True)}")
    explicit = spark.createDataFrame([(x["source"], x["target"], x.get("kind", "declared")) for x in links], EDGES)
    inputs = spark.createDataFrame([(p["name"], i) for p in projects for i in p.get("inputs", [])], "project string, input string")
    shared = inputs.select(F.concat(F.lit("input:"), "input").alias("target"), F.col("project").alias("source")).distinct()
    several = shared.groupBy("target").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("target")
    return nodes, explicit.union(shared.join(several, "target", "left_semi").select("source", "target", F.lit("shared-input").alias("kind")))


def enriched(spark: SparkSession, captures: dict[str, str]) -> Graph:
    """The graphs of several captures (provider to path) as one, each row with its provider; unknown names are an error."""
    nodes, edges = spark.createDataFrame([], NODES).withColumn("provider", F.lit("")), spark.createDataFrame([], EDGES).withColumn("provider", F.lit(""))
    for name, path in sorted(captures.items()):
        if name not in PROVIDERS:
            raise ValueError(f"no provider named {name}")
        n, e = PROVIDERS[name][1](spark, path)
        nodes = nodes.unionByName(n.withColumn("provider", F.lit(name)))
        edges = edges.unionByName(e.withColumn("provider", F.lit(name)))
    return nodes, edges


#: Kinds of typed inputs.
INPUT_KINDS = ("file", "directory", "glob")


def input_patterns(inputs: list[dict[str, str]]) -> list[str]:
    """Path globs for typed inputs: {"file": p}, {"directory": p} or {"glob": g}; exactly one kind each."""
    out = []
    for x in inputs:
        if len(x) != 1 or next(iter(x)) not in INPUT_KINDS:
            raise ValueError(f"an input is one of {', '.join(INPUT_KINDS)}: {x}")
        kind, value = next(iter(x.items()))
        value = value.removeprefix("./").rstrip("/") if kind != "glob" else value
        if not value or value.startswith("/") or ".." in value.split("/"):
            raise ValueError(f"not a path inside the tree: {x}")
        if kind != "glob" and any(c in value for c in "*?["):
            raise ValueError(f"a {kind} holds no wildcards: {x}")
        out.append(f"{value}/**" if kind == "directory" else value)
    return out
