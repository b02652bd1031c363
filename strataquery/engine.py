"""One object over an indexed source tree: the operations a user asks for, each a DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataquery.functions import parse
from strataquery.functions.text import impact_role, is_test_path, line_terms, short_name
from strataquery.operators import aggregate, context, delta, dependency, graph, incremental, lookup, rank, retrieval, structure, topk
from strataquery.sources import repository
from strataquery.sources.corpus import file_terms
from strataquery.sources.generations import Generations
from strataquery.sources.postings import Postings
from strataquery.sources.stored import fresh_path


class Engine:
    """Tables of one generation of an index. `build` scans a folder; any tables of the same columns serve."""

    def __init__(self, files: DataFrame, symbols: DataFrame, edges: DataFrame, parsed: DataFrame | None = None, index: Postings | None = None) -> None:
        self.spark, self.index = files.sparkSession, index
        self.parsed = parsed if parsed is not None else parse.parse_all(files) if {"text", "language"} <= set(files.columns) else None
        self.files, self.symbols = files, symbols
        self.edges = edges.withColumn("target_short", short_name(F.col("target")))
        lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("_p", "content")).select("path", (F.col("_p") + 1).alias("line"), "content")
        self.lines = lines
        self.postings = lines.select("path", "line", F.explode(line_terms(F.col("content"))).alias("token"))

    def indexed(self, path: str | None = None) -> Engine:
        """The engine with stored postings, at a path or in the shared folder for as long as the application lives: lexical
        questions then read the row groups of their terms, not the texts."""
        index = Postings.write(self.files.select("path", "text"), path or fresh_path(self.spark, "postings"))
        return Engine(self.files, self.symbols, self.edges.drop("target_short"), self.parsed, index)

    @classmethod
    def build(cls, spark: SparkSession, root: str, rules: list | None = None) -> Engine:
        files = repository.scan(spark, root, rules).where("evidence_visibility <> 'deny'")
        parsed = graph.cut(parse.parse_all(files))
        return cls(files, parse.parse_symbols(parsed), parse.parse_edges(parsed), parsed)

    def save(self, path: str) -> int:
        """Publishes the three tables together as the generation after the current one; readers bind to one."""
        store = Generations(self.spark, path)
        return store.publish(store.current(), {"files": self.files, "symbols": self.symbols, "edges": self.edges})

    @classmethod
    def load(cls, spark: SparkSession, path: str, generation: int | None = None) -> Engine:
        store = Generations(spark, path)
        at = generation or store.current()
        files, symbols, edges = (store.table(n, at) for n in ("files", "symbols", "edges"))
        return cls(files, symbols, edges.drop("target_short"))

    def refreshed(self, root: str, paths: list[str], rules: list | None = None) -> tuple[Engine, DataFrame]:
        """The engine after some paths have changed, and what changed: only these are read and parsed again; those that
        are gone or no longer admitted lose their rows."""
        new = graph.cut(repository.scan(self.spark, root, rules, only=paths).where("evidence_visibility <> 'deny'"))
        parsed = graph.cut(parse.parse_all(new))
        changed = self.spark.createDataFrame([(p,) for p in sorted(set(paths))], "path string")
        swap = lambda old, rows: delta.delete_paths(old, changed).unionByName(rows.select(old.columns))
        after = Engine(swap(self.files, new), swap(self.symbols, parse.parse_symbols(parsed)), swap(self.edges.drop("target_short"), parse.parse_edges(parsed)), swap(self.parsed, parsed))
        return after, after.delta(self).join(changed, "path", "left_semi").where("status <> 'unchanged'")

    def _counted(self) -> dict[str, tuple[DataFrame, list[str]]]:
        return {"terms": (file_terms(self.files), ["token"]), "languages": (self.files.select("path", "language"), ["language"]), "targets": (self.edges.select("path", "target_short"), ["target_short"])}

    def kept_counts(self) -> dict[str, incremental.KeptCounts]:
        """Document frequencies of terms, files of languages and references to names, to be kept by `refresh_counts`."""
        return {name: incremental.KeptCounts(rows, keys) for name, (rows, keys) in self._counted().items()}

    def refresh_counts(self, before: Engine, counts: dict[str, incremental.KeptCounts], paths: list[str]) -> dict[str, int]:
        """Brings the counts of the engine before up to this one, which differs from it in some paths: only their rows are
        read, and only the differences are written. By how many keys each differs. The engine before has to be a stored
        one (`load`): one that was just built reads its files as they are now."""
        changed = self.spark.createDataFrame([(p,) for p in sorted(set(paths))], "path string")
        rows = lambda e: {name: df for name, (df, _) in e._counted().items()}
        return incremental.refresh_all(counts, rows(before), rows(self), changed)

    def stats(self) -> DataFrame:
        one = lambda name, df: df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
        return one("files", self.files).union(one("symbols", self.symbols)).union(one("edges", self.edges))

    def languages(self) -> DataFrame:
        return aggregate.category_counts(self.files, "language")

    def symbol(self, name: str, n: int = 50) -> DataFrame:
        return lookup.exact_symbol(self.symbols, name, n)

    def outline(self, path: str) -> DataFrame:
        return self.symbols.where(F.col("path") == path).orderBy("start_line", "qualname")

    def read(self, path: str, start: int = 1, end: int = 1 << 30) -> DataFrame:
        return self.lines.where((F.col("path") == path) & F.col("line").between(start, end)).orderBy("line")

    def source(self, qualname: str) -> DataFrame:
        """Text of symbols of a qualified name."""
        hit = self.symbols.where(F.col("qualname") == qualname).join(self.files.select("path", "text"), "path")
        return hit.select("path", "start_line", "end_line", F.expr("array_join(slice(split(text, '\n'), start_line, end_line - start_line + 1), '\n')").alias("text"))

    def grep(self, literal: str, n: int = 100) -> DataFrame:
        """Lines that hold a literal, case-insensitively; only files that hold it are cut into lines."""
        files = self.files.where(F.contains(F.lower("text"), F.lit(literal.lower())))
        may_hold = self.index.files_with(literal) if self.index else None
        files = files if may_hold is None else files.join(may_hold, "path", "left_semi")
        lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("_p", "content")).select("path", (F.col("_p") + 1).alias("line"), "content")
        return topk.bounded(lines.where(F.contains(F.lower("content"), F.lit(literal.lower()))), ["path", "line"], n)

    def refs(self, name: str, n: int = 1024) -> DataFrame:
        return topk.bounded(lookup.references(self.edges, name).select("path", "source", "kind", "target", "line"), ["path", "line", F.coalesce("source", F.lit("")), "kind"], n)

    def enclosing(self, path: str, line: int) -> DataFrame:
        return lookup.containing(self.symbols.where(F.col("path") == path), line).orderBy("width", "start_line")

    def lexical(self, query: str, n: int = 120) -> DataFrame:
        """(path, boost) of the n files that hold most of a query's terms."""
        terms = rank.query_terms(query)[:16]
        if self.index:
            matched = self.index.of(terms).groupBy("path").agg(F.count(F.lit(1)).alias("matches"))
        else:
            matched = self.postings.where(F.col("token").isin(terms)).groupBy("path").agg(F.countDistinct("token").alias("matches"))
        some = matched.orderBy(F.desc("matches"), "path").limit(n)
        return some.select("path", rank.file_boost(F.col("matches"), max(1, len(terms))).alias("boost"))

    def find(self, query: str, n: int = 20, definitions: DataFrame | None = None) -> DataFrame:
        """Hybrid search: symbols by name, files by terms, producers' definitions, callers and types, each path before
        any path twice."""
        return retrieval.find(query, self.symbols, self.edges, self.files, n, definitions, self.lexical(query, max(80, 6 * n)))

    def find_task(self, task: str, n: int = 20) -> DataFrame:
        """Retrieval for a whole task description: by a rare identifier, by a small island of files, or by fusing the
        searches of several views of it. An engine without stored postings (`indexed`) writes some first."""
        from strataquery.operators import task as tasks

        if self.index is None:
            return self.indexed().find_task(task, n)

        def search(view: tasks.View) -> DataFrame:
            hits = self.find(" ".join(view.terms), view.fetch)
            place = F.row_number().over(Window.orderBy("tier", F.desc("score"), "path", "row_type", "qualname", "start_line"))  # over `fetch` rows
            return hits.select(F.lit(view.name).alias("view"), place.alias("place"), "path", "score", "qualname", "start_line")

        return tasks.find_task(task, self.index, self.files.select("path"), self.symbols, search, n)

    def action_map(self, task: str, n: int = 20, per_role: int = 3) -> DataFrame:
        """Paths of a search by what to do with them: edit, verify, contract, inspect. The search's own order stays."""
        hits = self.find(task, n).groupBy("path").agg(F.max("score").alias("score"))
        role = impact_role(F.col("path"))
        action = F.when(role == "verification", "verify").when(role == "contract", "contract").when(role == "implementation", "edit").otherwise("inspect")
        return topk.top_per_group(hits.select(action.alias("role"), "path", "score"), ["role"], [F.desc("score"), "path"], per_role)

    def verifiers(self, paths: list[str], depth: int = 8, per_path: int = 16) -> DataFrame:
        """(path, verifier, distance): the nearest tests that reach each changed path over imports, by one batch of walks for
        each 32 paths."""
        if not paths:
            raise ValueError("no changed paths")
        none = F.lit(None).cast("string").alias("marker")
        edges, nodes = graph.cut(self.imports().select("source", "target", none)), self.files.select(F.col("path").alias("node"), none)
        found, all_of_them = [], (1 << 31) - 1
        paths = sorted(set(paths))
        for first in range(0, len(paths), dependency.QUERIES):
            some = paths[first : first + dependency.QUERIES]
            starts = self.spark.createDataFrame([(p, p) for p in some], "query string, node string")
            reached, _ = dependency.batched_walks(edges, nodes, starts, {p: dependency.Walk(depth, all_of_them, all_of_them, True) for p in some})
            found.append(reached.where(is_test_path(F.col("node"))).select(F.col("query").alias("path"), F.col("node").alias("verifier"), F.col("depth").alias("distance")))
        found = reduce(DataFrame.unionByName, found)
        return topk.top_per_group(found, ["path"], ["distance", "verifier"], per_path, "_rn").drop("_rn")

    def brief(self, task: str, paths: list[str], per_section: int = 8) -> DataFrame:
        """What a change needs at a glance: changed paths with their digests, what they affect by role, where the task
        points, and the tests to run."""
        row = lambda df, section, detail: df.select(F.lit(section).alias("section"), "path", detail.cast("string").alias("detail"))
        changed = row(self.files.where(F.col("path").isin(paths)), "changed", F.col("file_digest"))
        affected = row(self.impact(paths, per_section), "affected", F.col("role"))
        points = row(self.action_map(task), "task", F.col("role"))
        tests = row(self.verifiers(paths).select(F.col("verifier").alias("path"), "distance").groupBy("path").agg(F.min("distance").alias("distance")), "verify", F.col("distance"))
        return topk.top_per_group(changed.union(affected).union(points).union(tests), ["section"], ["path", "detail"], per_section, "_rn").drop("_rn")

    def imports(self) -> DataFrame:
        return context.import_graph(self.files, self.edges)

    def affected(self, paths: list[str], depth: int = 12) -> DataFrame:
        seeds = self.spark.createDataFrame([(p,) for p in paths], "node string")
        return graph.closure(self.imports(), seeds, depth, reverse=True)

    def affected_tests(self, paths: list[str], depth: int = 12) -> DataFrame:
        return self.affected(paths, depth).where(is_test_path(F.col("node")))

    def impact(self, paths: list[str], n: int = 20) -> DataFrame:
        return context.by_role(self.affected(paths).select(F.col("node").alias("path"), "depth"), ["depth", "path"], n)

    def neighbours(self, paths: list[str]) -> DataFrame:
        seeds = self.spark.createDataFrame([(p,) for p in paths], "node string")
        return graph.adjacency(self.imports().withColumn("kind", F.lit("imports")), seeds, {"imports": 42.0})

    def context_pack(self, task: str, budget: int) -> DataFrame:
        hits = self.find(task, 64).groupBy("path").agg(F.max("score").alias("score"))
        return context.pack(hits.join(self.files.select("path", F.col("full_tokens").alias("cost")), "path"), budget)

    def findings(self) -> DataFrame:
        return parse.parse_findings(self.parsed)

    def bindings(self) -> DataFrame:
        return parse.parse_bindings(self.parsed)

    def exports(self) -> DataFrame:
        return parse.exports(self.bindings())

    def import_owner(self, path: str, name: str) -> DataFrame:
        """Who defines a name that a module lets out, behind re-exports: modules become paths by the table of files."""
        modules = self.files.where("module_name IS NOT NULL").select(F.col("module_name").alias("module"), F.col("path").alias("owner"))
        passed = self.bindings().where("kind = 'reexport'").select("path", "name", F.regexp_replace("target", r"\.[^.]*$", "").alias("module"), F.substring_index("target", ".", -1).alias("owner_name"))
        chains = passed.join(modules, "module").select("path", "name", "owner", "owner_name")
        defined = self.bindings().where("kind IN ('declaration', 'value')").select("path", "name")
        return structure.import_owners(self.spark.createDataFrame([(path, name)], "path string, name string"), chains, defined)

    def digests(self) -> DataFrame:
        return aggregate.merkle_tree(self.files, "path", "file_digest", "size")

    def delta(self, before: Engine) -> DataFrame:
        return delta.keyed_delta(before.files, self.files, ["path"], ["file_digest"])

    def freshness(self, recorded: DataFrame) -> DataFrame:
        return delta.freshness(recorded, self.files.select("path", F.col("file_digest").alias("digest")), "path")
