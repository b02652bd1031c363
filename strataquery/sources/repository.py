"""Scans of source trees, snapshots as sinks, and captured reports as sources. Nothing is run on executors: native tools'
output is read from the files they left."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquery.functions.text import glob_regex, is_secret_path, language_of, module_name, token_estimate


def admission(path: Column, rules: list[tuple[str, bool | None, str | None]]) -> tuple[Column, Column]:
    """(index, visibility) of a path: secrets are denied first; of the rules (glob, index, visibility) that match, each
    field's last given value holds; what isn't indexed is denied."""
    index, visible = F.lit(True), F.lit("source")
    for glob, i, v in rules:
        hit = path.rlike(glob_regex(glob))
        index = index if i is None else F.when(hit, F.lit(i)).otherwise(index)
        visible = visible if v is None else F.when(hit, F.lit(v)).otherwise(visible)
    secret = is_secret_path(path)
    allowed = ~secret & index
    return allowed, F.when(~allowed, "deny").otherwise(visible)


#: Folders that a scan doesn't enter.
PRUNED = (".git", ".hg", ".svn", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", "target")


def walk(root: str) -> Iterator[tuple[str, int, float]]:
    """(path, size, modification time) of the files below a folder; pruned folders are not entered. Only names are
    read here: Spark's own file sources pass over names that begin with an underscore or a dot."""
    fs, base = pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root)
    todo = [base.rstrip("/")]
    while todo:
        for f in sorted(fs.get_file_info(pafs.FileSelector(todo.pop())), key=lambda f: f.path):
            if f.type == pafs.FileType.Directory:
                if f.base_name not in PRUNED:
                    todo.append(f.path)
            elif f.type == pafs.FileType.File:
                yield f.path[len(base.rstrip("/")) + 1 :], f.size, f.mtime.timestamp() if f.mtime else 0.0


def named(root: str, paths: list[str]) -> Iterator[tuple[str, int, float]]:
    """What `walk` gives, for some paths only: those that are files now."""
    fs, base = pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root)
    base = base.rstrip("/")
    inside = [p for p in sorted(set(paths)) if not set(p.split("/")[:-1]) & set(PRUNED) and ".." not in p.split("/")]
    for f in fs.get_file_info([f"{base}/{p}" for p in inside]):
        if f.type == pafs.FileType.File:
            yield f.path[len(base) + 1 :], f.size, f.mtime.timestamp() if f.mtime else 0.0


def scan(spark: SparkSession, root: str, rules: list | None = None, partitions: int | None = None, only: list[str] | None = None) -> DataFrame:
    """Admitted files below a folder (or only some paths of it): path, language, module, visibility, size, digest, tokens,
    text. The driver lists names and sizes; contents are read by the tasks."""
    listed = spark.createDataFrame(list(walk(root) if only is None else named(root, only)), "path string, size long, modificationTime double")
    index, visible = admission(F.col("path"), rules or [])
    rows = listed.withColumn("evidence_visibility", visible).where(index)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root)
        for b in batches:
            for i, path in enumerate(b.column(0).to_pylist()):
                with fs.open_input_stream(f"{base.rstrip('/')}/{path}", compression=None) as f:
                    yield pa.RecordBatch.from_arrays([*b.slice(i, 1).columns, pa.array([f.read()], pa.binary())], [*b.schema.names, "content"])

    raw = rows.repartition(partitions or spark.sparkContext.defaultParallelism, "path").mapInArrow(read, "path string, size long, modificationTime double, evidence_visibility string, content binary")
    text = F.expr("try_validate_utf8(CAST(content AS STRING))")
    return raw.select(
        "path", language_of(F.col("path")).alias("language"), module_name(F.col("path")).alias("module_name"), "evidence_visibility", "size", "modificationTime",
        F.sha2("content", 256).alias("file_digest"), F.coalesce(text, F.lit("")).alias("text"),
    ).withColumn("full_tokens", token_estimate(F.col("text")))


def resolve_globs(paths: DataFrame, globs: list[str], exclude: list[str] | None = None) -> DataFrame:
    """Paths that any glob matches, without excluded ones and without what lies below another match."""
    from strataquery.operators.delta import collapse_descendants

    any_of = lambda gs: reduce(lambda a, b: a | b, [F.col("path").rlike(glob_regex(g)) for g in gs], F.lit(False))
    return collapse_descendants(paths.where(any_of(globs) & ~any_of(exclude or [])).select("path").distinct())


def changed_files(now: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose (path, modificationTime, size) the digest cache doesn't have."""
    return now.join(cache.select("path", "modificationTime", "size"), ["path", "modificationTime", "size"], "left_anti")


def unparsed(files: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Files whose content, language and parser have no stored artifact."""
    key = F.sha2(F.concat_ws("|", "file_digest", "language", F.lit("parser-1")), 256)
    return files.withColumn("artifact_key", key).join(artifacts.select("artifact_key"), "artifact_key", "left_anti")


def store_blobs(files: DataFrame, path: str) -> None:
    """Content-addressed store: new contents only, by digest; what is stored already is not written again."""
    spark = files.sparkSession
    new = files.select("file_digest", "text").dropDuplicates(["file_digest"])
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        new = new.join(spark.read.parquet(path).select("file_digest"), "file_digest", "left_anti")
    new.write.mode("append").parquet(path)


def corrupt_blobs(spark: SparkSession, path: str) -> DataFrame:
    """Digests of stored contents that don't have that digest."""
    return spark.read.parquet(path).where(F.sha2(F.col("text").cast("binary"), 256) != F.col("file_digest")).select("file_digest")


def export_snapshot(df: DataFrame, path: str, kind: str = "parquet") -> None:
    df.write.mode("overwrite").format(kind).save(path)


def as_json(df: DataFrame) -> DataFrame:
    """Rows as compact JSON text with keys in order."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("json"))


SCIP = "documents array<struct<relative_path:string,occurrences:array<struct<range:array<int>,symbol:string,symbol_roles:int>>>>"


def scip(spark: SparkSession, path: str) -> DataFrame:
    """Occurrences of a captured index: path, symbol, line (from 1), role."""
    d = spark.read.schema(SCIP).json(path, multiLine=True).select(F.explode("documents").alias("d"))
    o = d.select(F.col("d.relative_path").alias("path"), F.explode("d.occurrences").alias("o"))
    return o.select("path", F.col("o.symbol").alias("symbol"), (F.element_at("o.range", 1) + 1).alias("line"), F.when(F.col("o.symbol_roles").bitwiseAND(1) == 1, "definition").otherwise("reference").alias("role"))


LSP = "name string, method string, subject string, path string, position struct<line:int,character:int>"


def lsp_requests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LSP).json(path, multiLine=True).select("name", "method", "subject", "path", (F.col("position.line") + 1).alias("line"), (F.col("position.character") + 1).alias("column"))


NPM_LOCK = "lockfileVersion int, packages map<string, struct<name:string,version:string,dev:boolean,optional:boolean,dependencies:map<string,string>>>"


def npm_lock(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(selections, relationships) of a package-lock, version 2 or 3."""
    p = spark.read.schema(NPM_LOCK).json(path, multiLine=True).select(F.explode("packages").alias("location", "p"))
    name = F.coalesce("p.name", F.regexp_extract("location", r"(?:^|/)node_modules/((?:@[^/]+/)?[^/]+)$", 1))
    nodes = p.select(F.col("location").alias("node"), name.alias("component"), F.col("p.version").alias("version"), F.coalesce("p.dev", F.lit(False)).alias("dev"))
    # A dependency means the nearest enclosing node_modules that has it.
    want = p.select(F.col("location").alias("source"), F.explode("p.dependencies").alias("dep", "range"))
    steps = F.expr("filter(transform(sequence(0, size(split(source, '/node_modules/'))), n -> concat_ws('/node_modules/', slice(split(source, '/node_modules/'), 1, n))), x -> true)")
    tried = want.select("source", "dep", "range", F.posexplode(steps).alias("depth", "base")).withColumn("target", F.when(F.col("base") == "", F.concat(F.lit("node_modules/"), "dep")).otherwise(F.concat("base", F.lit("/node_modules/"), "dep")))
    hit = tried.join(nodes.select(F.col("node").alias("target")), "target").groupBy("source", "dep", "range").agg(F.max_by("target", "depth").alias("target"))
    return nodes, hit


def uv_lock(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """(selections, relationships) of a uv.lock; one file, parsed by the standard library."""
    import tomllib

    packages = tomllib.loads(text).get("package", [])
    nodes = [(p["name"], p.get("version"), next(iter(p.get("source", {})), None)) for p in packages]
    edges = [(p["name"], d["name"], d.get("marker")) for p in packages for d in p.get("dependencies", [])]
    return spark.createDataFrame(nodes, "component string, version string, source string"), spark.createDataFrame(edges, "source string, target string, marker string")


def maven_list(spark: SparkSession, path: str) -> DataFrame:
    """Coordinates g:a:type[:classifier]:version:scope of a dependency list report."""
    line = F.trim(F.regexp_replace("value", r"^\[INFO\]\s*|\s+--.*$", ""))
    parts = spark.read.text(path).select(F.split(line, ":").alias("p")).where(F.size("p").between(5, 6))
    return parts.select(F.concat_ws(":", F.element_at("p", 1), F.element_at("p", 2)).alias("component"), F.element_at("p", -2).alias("version"), F.element_at("p", -1).alias("scope"))


def maven_tree(spark: SparkSession, text: str) -> DataFrame:
    """Edges of a dependency tree report (nested JSON), level by level."""
    import json

    rows, level = [], [(None, json.loads(text))]
    while level:
        below = []
        for parent, n in level:
            own = f"{n['groupId']}:{n['artifactId']}"
            if parent:
                rows.append((parent, own, n.get("version"), n.get("scope")))
            below += [(own, c) for c in n.get("children", [])]
        level = below
    return spark.createDataFrame(rows, "source string, target string, version string, scope string")


def dist_owners(spark: SparkSession, path: str) -> DataFrame:
    """Which distribution owns which top-level module, from RECORD files below a folder."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "RECORD").text(path).withColumn("file", F.col("_metadata.file_path"))
    file = F.element_at(F.split("value", ","), 1)
    top = F.regexp_extract(file, r"^([A-Za-z_][A-Za-z0-9_]*)(?:/|\.py$)", 1)
    return rows.select(F.regexp_extract("file", r"([^/]+)-[^/-]+\.dist-info/RECORD$", 1).alias("distribution"), top.alias("module")).where("module <> ''").distinct()


def npm_workspaces(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the package.json files below a folder: edges join on the package's name."""
    schema = "name string, version string, dependencies map<string,string>, devDependencies map<string,string>"
    p = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "package.json").json(path, multiLine=True).withColumn("manifest", F.col("_metadata.file_path"))
    nodes = p.where("name IS NOT NULL").select(F.col("name").alias("project_id"), "manifest")
    wants = p.select(F.col("name").alias("source"), F.explode(F.map_keys(F.map_concat(F.coalesce("dependencies", F.create_map().cast("map<string,string>")), F.coalesce("devDependencies", F.create_map().cast("map<string,string>"))))).alias("target"))
    return nodes, wants.join(nodes.select(F.col("project_id").alias("target")), "target", "left_semi")
