"""Bounded questions about a dependency observation: packages, walks with limits, paths, projections, verification.

Nodes are (node, context, ecosystem, name, version, marker), edges (source, target, marker). Limits are part of the
answers: what they leave out comes back as an omission. Loops run on the driver with one join per level; only counts
reach it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataquery.functions.versions import version_state
from strataquery.operators.graph import cut, unconditional
from strataquery.operators.topk import top_per_group
from strataquery.sources.stored import Parts


def canonical_name(ecosystem: Column, name: Column) -> Column:
    """PyPI names compare in lower case with runs of - _ . as one -; all others as they are."""
    return F.when(ecosystem == "pypi", F.lower(F.regexp_replace(name, r"[-_.]+", "-"))).otherwise(name)


def package_matches(nodes: DataFrame, ecosystem: str, name: str, version: str | None = None, spec: str | None = None, context: str | None = None) -> DataFrame:
    """Selected nodes of a package, with `state`: match, nonmatch or unclassified under a version predicate."""
    if version is not None and spec is not None:
        raise ValueError("ask for a version or for a range of them")
    wanted = canonical_name(F.lit(ecosystem), F.lit(name))
    rows = nodes.where((F.col("ecosystem") == ecosystem) & (canonical_name(F.col("ecosystem"), F.col("name")) == wanted))
    rows = rows if context is None else rows.where(F.col("context") == context)
    rows = rows if version is None else rows.where(F.col("version") == version)
    return rows.withColumn("state", F.lit("match") if spec is None else version_state("version", spec, ecosystem))


def package_query(nodes: DataFrame, max_results: int, **selector: str) -> tuple[DataFrame, DataFrame]:
    """The first matches by (context, node), and one row that sums up all of them."""
    rows = package_matches(nodes, **selector)
    hits = rows.where("state = 'match'")
    summary = rows.agg(
        F.count_if(F.col("state") == "match").alias("match_count"),
        (F.count_if(F.col("state") == "match") > max_results).alias("truncated"),
        F.count_if(F.col("state") == "unclassified").alias("unclassified"),
        (F.count_distinct(F.when(F.col("state") == "match", F.col("version"))) > 1).alias("multiple_versions"),
        (F.count_distinct(F.when(F.col("state") == "match", F.col("context"))) > 1).alias("multiple_contexts"),
    )
    return hits.orderBy("context", "node").limit(max_results), summary


def inventory_assessment(coverage: DataFrame, contexts: DataFrame) -> DataFrame:
    """Each declared context's inventory: complete, incomplete or unknown, and whether absence counts in it.

    coverage: (context, kind, completeness, truncation); a context without rows is unknown."""
    rows = coverage.where("kind = 'resolved-inventory'").groupBy("context").agg(
        F.bool_and((F.col("completeness") == "complete") & (F.col("truncation") == "complete")).alias("all"),
        F.bool_or((F.col("completeness") == "incomplete") | (F.col("truncation") == "truncated")).alias("some"),
    )
    state = F.when(F.col("all"), "complete").when(F.col("some"), "incomplete").otherwise("unknown")
    admissible = F.when(F.coalesce("all", F.lit(False)), "admissible-within-declared-scope").otherwise("not-admissible")
    return contexts.select("context").distinct().join(rows, "context", "left").select("context", state.alias("completeness"), admissible.alias("negative_evidence"))


#: Fixed value: queries of one call.
QUERIES = 32


@dataclass(frozen=True)
class Walk:
    """Limits of one query of a batch."""

    max_depth: int
    max_results: int
    max_visits: int
    reverse: bool = False


def batched_walks(edges: DataFrame, nodes: DataFrame, starts: DataFrame, walks: dict[str, Walk]) -> tuple[DataFrame, DataFrame]:
    """Many bounded walks over unconditional edges at once: (query, node, depth), each query's nodes at their least depth,
    the first max_results by depth and node; and omissions (query, reason, node).

    starts: (query, node). All queries share one frontier keyed by query and node, so a level is one join and one job
    for all of them, whatever their number (`QUERIES` at most); its writer also counts each query's edges. A level whose
    edges would take a query's visits past its max_visits isn't walked for that query; the others go on. Where edges and
    nodes have a column `context`, node ids are taken to be of one context each, as observations give them."""
    if len(walks) > QUERIES:
        raise ValueError(f"{len(walks)} queries; {QUERIES} are allowed")
    spark = starts.sparkSession
    free, cond = unconditional(edges, nodes)
    ways = [w for w in (False, True) if w in {x.reverse for x in walks.values()}] or [False]
    turned = lambda e, way: e.select(F.lit(way).alias("way"), *(F.col(c).alias(n) for c, n in zip(("target", "source") if way else ("source", "target"), ("source", "target"), strict=True)))
    free, cond = (cut(reduce(DataFrame.unionByName, [turned(e, w) for w in ways])) for e in (free, cond))
    rows = [(q, w.reverse, w.max_depth, w.max_results) for q, w in walks.items()]
    asked = F.broadcast(spark.createDataFrame(rows, "query string, way boolean, max_depth int, max_results int"))  # at most QUERIES rows
    seen, allowed = Parts(spark, "walks"), [set(walks)]
    known = seen.add(starts.select("query", "node").distinct().join(asked.select("query"), "query", "left_semi").withColumns({"depth": F.lit(0), "new": F.lit(True), "edges": F.lit(0).cast("long")}))
    visits, limits = dict.fromkeys(walks, 0), []
    walked = lambda: reduce(DataFrame.unionByName, [seen.part(i).where(F.col("new") & F.col("query").isin(sorted(q))) for i, q in enumerate(allowed)]).select("query", "node", "depth")
    depth = 0
    while known and depth < max((w.max_depth for w in walks.values()), default=0):
        depth += 1
        going = [q for q in sorted(allowed[-1]) if walks[q].max_depth >= depth]
        if not going:
            break
        frontier = seen.part(-1).where(F.col("new") & F.col("query").isin(going)).join(asked, "query")
        out = frontier.join(free, (F.col("node") == F.col("source")) & (frontier["way"] == free["way"])).groupBy("query", F.col("target").alias("node")).agg(F.count(F.lit(1)).alias("edges"))
        step = out.join(walked().select("query", "node", F.lit(False).alias("_old")), ["query", "node"], "left").select("query", "node", F.lit(depth).alias("depth"), F.coalesce("_old", F.lit(True)).alias("new"), "edges")
        counts = [F.sum(F.when(F.col("query") == q, F.col("edges"))).alias(f"n{i}") for i, q in enumerate(going)]
        known, told = seen.add(step, counts)
        over = {q for i, q in enumerate(going) if visits[q] + (told[f"n{i}"] or 0) > walks[q].max_visits}
        limits += [(q, "visit-limit") for q in sorted(over)]
        for i, q in enumerate(going):
            visits[q] += told[f"n{i}"] or 0
        allowed.append(set(going) - over)
    reached = cut(walked())
    found = reached.where("depth > 0").join(asked, "query")
    most = max((w.max_results for w in walks.values()), default=0)
    kept = top_per_group(found, ["query"], ["depth", "node"], most, "_rn").where("_rn <= max_results").select("query", "node", "depth")
    many = found.groupBy("query", "max_results").agg(F.count(F.lit(1)).alias("n")).where("n > max_results").select("query", F.lit("result-limit").alias("reason"))
    ends = reached.join(asked, "query")
    out = lambda e: e.select(F.col("way"), F.col("source").alias("node")).distinct()
    left = ends.where("depth < max_depth").join(out(cond), ["way", "node"], "left_semi").select("query", F.lit("conditional-edge").alias("reason"), "node")
    last = ends.where("depth = max_depth").join(out(free.union(cond)), ["way", "node"], "left_semi").select("query", F.lit("depth-limit").alias("reason"), "node")
    names = spark.createDataFrame(limits, "query string, reason string").union(many).withColumn("node", F.lit(None).cast(dict(starts.dtypes)["node"]))
    return kept, left.union(last).union(names)


def bounded_walk(edges: DataFrame, nodes: DataFrame, start: DataFrame, max_depth: int, max_results: int, max_visits: int, reverse: bool = False) -> tuple[DataFrame, DataFrame]:
    """One bounded walk (`batched_walks`) from the start nodes (node): (node, depth), and omissions (reason, node)."""
    kept, left = batched_walks(edges, nodes, start.select(F.lit("one").alias("query"), "node"), {"one": Walk(max_depth, max_results, max_visits, reverse)})
    return kept.drop("query"), left.drop("query")


def bounded_paths(edges: DataFrame, start: DataFrame, target: int | str, max_depth: int, max_results: int, max_visits: int) -> tuple[DataFrame, list[str]]:
    """Simple paths to the target, shortest first and then by their nodes, max_results of them, and the limits met.

    A level is written before the next one; one that would take the visits past max_visits is not walked, and none is
    once there are enough paths."""
    e = cut(edges.select("source", "target").distinct())
    now = cut(start.select(F.array("node").alias("path")))
    out, visits, found, limits = [], 0, 0, []
    for depth in range(max_depth + 1):
        hits = now.where(F.element_at("path", -1) == target).withColumn("depth", F.lit(depth))
        out.append(hits)
        found += hits.count()
        if found > max_results:
            limits.append("result-limit")
            break
        if depth == max_depth:
            break
        step = now.where(F.element_at("path", -1) != target).join(e, F.element_at("path", -1) == F.col("source"))
        n = step.count()
        if not n:
            break
        if visits + n > max_visits:
            limits.append("visit-limit")
            break
        visits += n
        now = cut(step.where(~F.array_contains("path", F.col("target"))).select(F.concat("path", F.array("target")).alias("path")))
    rows = out[0]
    for df in out[1:]:
        rows = rows.union(df)
    return rows.orderBy("depth", "path").limit(max_results), limits


def batch(queries: dict[str, DataFrame], most: int = QUERIES) -> DataFrame:
    """Several answers of one shape in one table, each row with its query's name; `most` queries a call."""
    if len(queries) > most:
        raise ValueError(f"{len(queries)} queries; {most} are allowed")
    rows = None
    for name, df in queries.items():
        one = df.withColumn("query", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    if rows is None:
        raise ValueError("no queries")
    return rows


def projection(nodes: DataFrame, edges: DataFrame, consumers: DataFrame, names: list[str], max_results: int) -> DataFrame:
    """For the packages of some names: their selected nodes, what depends on each directly, and the files that use it,
    counted whole and listed up to max_results."""
    wanted = nodes.where(F.col("name").isin(names)).select("node", "name", "version")

    def first(df: DataFrame, column: str, name: str) -> DataFrame:
        rows = df.join(wanted.select("node"), "node", "left_semi").select("node", column).distinct()
        total = rows.groupBy("node").agg(F.count(F.lit(1)).alias(f"n_{name}"))
        some = top_per_group(rows, ["node"], [column], max_results, "_rn").groupBy("node").agg(F.array_sort(F.collect_list(column)).alias(name))
        return total.join(some, "node")

    up = first(edges.select(F.col("target").alias("node"), F.col("source").alias("dependent")), "dependent", "dependents")
    use = first(consumers, "path", "files")
    return wanted.join(up, "node", "left").join(use, "node", "left").na.fill(0, ["n_dependents", "n_files"])


def requalified(members: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """Members of a retained projection against the present table: current, changed or gone, by digest."""
    now = observed.select(key, F.col("digest").alias("_now"))
    state = F.when(F.col("_now").isNull(), "gone").when(F.col("_now") == F.col("digest"), "current").otherwise("changed")
    return members.join(now, key, "left").select(key, state.alias("state"))


def verification_chains(consumers: DataFrame, edges: DataFrame, verifiers: DataFrame, most: int | None = None) -> DataFrame:
    """(node, dependency, path, verifier): files that use a node, the node itself and what it depends on directly, and
    the verifiers of those files. More chains than `most` are an error, for part of them would prove nothing.

    Distinct sides make distinct chains, so these are not grouped; files meet their verifiers first, for what a node
    depends on multiplies the rows."""
    reach = edges.select(F.col("source").alias("node"), F.col("target").alias("dependency")).union(edges.select(F.col("source").alias("node"), F.col("source").alias("dependency"))).distinct()
    used = consumers.select("path", "node").distinct().join(verifiers.select("path", "verifier").distinct(), "path")
    chains = used.join(reach, "node").select("node", "dependency", "path", "verifier")
    if most is not None and chains.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} chains")
    return chains


def explained(matches: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """How each matched node came to be selected: as a root, through how many dependents, or neither."""
    up = edges.select(F.col("target").alias("node"), "source").distinct().groupBy("node").agg(F.count(F.lit(1)).alias("through"), F.min("source").alias("first_through"))
    rows = matches.join(up, "node", "left").join(roots.select("node", F.lit(True).alias("_root")).distinct(), "node", "left")
    why = F.when(F.col("_root"), "declared-root").when(F.col("through") > 0, "transitive").otherwise("unexplained")
    return rows.select("node", why.alias("derivation"), F.coalesce("through", F.lit(0)).alias("through"), "first_through")


def replayed(delta: DataFrame, again: DataFrame) -> DataFrame:
    """What tells a retained delta from one computed anew out of its endpoints: no rows mean that it is valid."""
    cols = delta.columns
    gone = delta.exceptAll(again.select(cols)).withColumn("side", F.lit("only-retained"))
    return gone.unionByName(again.select(cols).exceptAll(delta).withColumn("side", F.lit("only-recomputed")))
