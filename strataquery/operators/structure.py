"""Structure of source: owners behind re-exports, call graphs with limits, ownership, cycles, digests of surfaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataquery.operators.graph import cut, levels
from strataquery.operators.topk import best_per_group, top_per_group
from strataquery.sources.stored import Parts


def jumps(single: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where chains of single steps (k, t) end: (k, at) by pointer doubling, log(length) rounds; and the keys (k) whose
    chain runs into a circle. An end may be any key that is no k.

    A round makes every pointer as long again. While a chain is left, each round settles some of it, so when a round
    settles none the rest are circles and what leads to them."""
    spark, parts = single.sparkSession, []
    now, left = single.select("k", F.col("t").alias("at"), F.lit(False).alias("done")), None
    while True:
        ahead = now.select(F.col("k").alias("at"), F.col("at").alias("_at"), F.col("done").alias("_done"))
        step = now.where("NOT done").join(ahead, "at", "left").select("k", F.coalesce("_at", "at").alias("at"), (F.col("_at").isNull() | F.col("_done")).alias("done"))
        parts.append(Parts(spark, "jumps"))
        _, told = parts[-1].add(now.where("done").unionByName(step), [F.count_if(~F.col("done")).alias("open")])
        now = parts[-1].df
        if told["open"] in (0, left):
            return now.where("done").select("k", "at"), now.where("NOT done").select("k")
        left = told["open"]


def settled(rows: DataFrame) -> DataFrame:
    """(k, low, high, loose) of every key out of rows (k, next, low, high, loose), where a row with a `next` stands for what
    that key gives: the least low, the greatest high, whether any is loose.

    Each round reads what the last one left and writes what it leaves, so the rounds together cost about as much as the
    graph has rows, however deep it is; a key leaves as soon as none of its rows waits. What is left then runs in circles
    or leads to one: loose, and with an end if any key on the way has one."""
    parts, mine = Parts(rows.sparkSession, "settled"), Window.partitionBy("k")

    def add(open_: DataFrame) -> int:
        return parts.add(open_.withColumn("ready", F.bool_and(F.col("next").isNull()).over(mine)), [F.count_if("ready").alias("ready")])[1]["ready"]

    value = lambda df: df.where("ready").groupBy("k").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.bool_or("loose").alias("loose"))
    while add(rows):
        now = value(parts.part(-1)).select(F.col("k").alias("next"), F.col("low").alias("_low"), F.col("high").alias("_high"), F.col("loose").alias("_loose"), F.lit(True).alias("_known"))
        left = parts.part(-1).where("NOT ready").drop("ready")
        met = left.where("next IS NOT NULL").join(now, "next", "left")
        pick = lambda c: F.when(F.col("_known"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
        rows = met.select("k", F.when(F.col("_known").isNull(), F.col("next")).alias("next"), pick("low"), pick("high"), pick("loose")).union(left.where("next IS NULL"))
    rest = parts.part(-1)
    reached = levels(rest.where("next IS NOT NULL").select(F.col("next").alias("source"), F.col("k").alias("target")), rest.where("low IS NOT NULL").select(F.col("k").alias("node")), 1 << 30)
    return value(parts.df).union(reached.select(F.col("node").alias("k"), F.col("node").alias("low"), F.col("node").alias("high"), F.lit(True).alias("loose")))


def import_owners(requests: DataFrame, exports: DataFrame, definitions: DataFrame) -> DataFrame:
    """(path, name, status, owner, owner_name): who defines a name imported from a facade (path, name).

    exports: (path, name, owner, owner_name), what a module passes on; definitions: (path, name). A walk ends at a
    definition; it is resolved-unique with one end and no loose end (nothing to follow, or a circle), ambiguous with several
    ends or a loose one besides, else unresolved. Each (module, name) is resolved once for all who ask: chains of any
    length by pointer doubling, names that several modules pass on in the order in which all they pass on is known; what
    is left then runs in circles. All ends of a name are told apart by the least and the greatest."""
    at = lambda p, n: F.struct(F.col(p).alias("path"), F.col(n).alias("name"))
    ends = cut(definitions.select(at("path", "name").alias("k")).distinct())
    steps = cut(exports.select(at("path", "name").alias("k"), at("owner", "owner_name").alias("t")).distinct().join(ends, "k", "left_anti"))
    counted = cut(steps.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t")))
    chains, circles = jumps(counted.where("n = 1").select("k", "t"))
    several = counted.where("n > 1").select("k")
    # The steps of names passed on by several, each followed to the end of its chain.
    led = steps.join(several, "k", "left_semi").join(chains.select(F.col("k").alias("t"), "at"), "t", "left").join(circles.select(F.col("k").alias("t"), F.lit(True).alias("_circle")), "t", "left")
    led = led.select("k", F.coalesce("at", "t").alias("t"), F.coalesce("_circle", F.lit(False)).alias("_circle")).distinct()
    led = led.join(ends.select(F.col("k").alias("t"), F.lit(True).alias("_end")), "t", "left").join(several.select(F.col("k").alias("t"), F.lit(True).alias("_more")), "t", "left")
    open_ = led.select("k", F.when(F.col("_more"), F.col("t")).alias("next"), F.when(F.col("_end"), F.col("t")).alias("end"), (F.col("_circle") | (F.col("_end").isNull() & F.col("_more").isNull())).alias("loose"))
    known = settled(open_.select("k", "next", F.col("end").alias("low"), F.col("end").alias("high"), "loose"))
    asked = requests.select("path", "name").distinct().withColumn("k", at("path", "name")).join(chains, "k", "left").withColumn("at", F.coalesce("at", "k"))
    rows = asked.join(ends.select(F.col("k").alias("at"), F.lit(True).alias("_end")), "at", "left").join(known.select(F.col("k").alias("at"), "low", "high", "loose"), "at", "left")
    low, high = F.coalesce("low", F.when(F.col("_end"), F.col("at"))), F.coalesce("high", F.when(F.col("_end"), F.col("at")))
    status = F.when(low.isNull(), "unresolved").when((low == high) & ~F.coalesce("loose", F.lit(False)), "resolved-unique").otherwise("ambiguous")
    return rows.select("path", "name", status.alias("status"), F.when(status == "resolved-unique", low["path"]).alias("owner"), F.when(status == "resolved-unique", low["name"]).alias("owner_name"))


def first_owned(candidates: DataFrame, owners: DataFrame) -> DataFrame:
    """(context, module, node): of each context's candidates (context, ord, module) the first that anyone owns, with all
    its owners (module, node)."""
    owned = candidates.join(owners.select("module").distinct(), "module", "left_semi")
    return best_per_group(owned, ["context"], ["ord", "module"]).select("context", "module").join(owners.select("module", "node").distinct(), "module").select("context", "module", "node")


def call_symbols(calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(path, target, owner): calls (path, target) to symbols (path, name) of the same last name in files that the
    caller's file imports (path, imported): by the imported file and the name, never by the name alone."""
    short = calls.select("path", "target", F.substring_index("target", ".", -1).alias("name")).distinct()
    seen = short.join(imports.select("path", F.col("imported").alias("owner")).distinct(), "path")
    return seen.join(symbols.select(F.col("path").alias("owner"), "name").distinct(), ["owner", "name"], "left_semi").select("path", "target", "owner")


def limited_levels(edges: DataFrame, seeds: DataFrame, max_depth: int, per_node: int, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(node, depth) over the first per_node edges of each node in an order, and (node, edges) of those that have more."""
    ordered = edges.select("source", "target", *[c for c in order if c not in ("source", "target")]).distinct()
    kept = cut(top_per_group(ordered, ["source"], order, per_node).select("source", "target").distinct())
    seen = frontier = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, max_depth + 1):
        nxt = frontier.join(kept, F.col("node") == F.col("source")).select(F.col("target").alias("node")).distinct()
        frontier = cut(nxt.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = cut(seen.union(frontier))
    many = ordered.groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("edges")).where(F.col("edges") > per_node)
    return seen, many.join(seen.where(F.col("depth") < max_depth).select("node"), "node", "left_semi")


def with_parents(edges: DataFrame, levels: DataFrame) -> DataFrame:
    """Each node of (node, depth) with its best parent: of the level above, by weight and then by name.

    edges: (source, target, weight)."""
    up = levels.select(F.col("node").alias("source"), (F.col("depth") + 1).alias("depth"))
    steps = edges.join(up, "source").join(levels.select(F.col("node").alias("target"), "depth"), ["target", "depth"])
    best = best_per_group(steps, ["target"], [F.desc("weight"), "source"]).select(F.col("target").alias("node"), F.col("source").alias("parent"), "weight")
    return levels.join(best, "node", "left")


def delegated(baseline: DataFrame, delegates: DataFrame) -> DataFrame:
    """(task, owner, by): the nearest delegate (task, owner, distance) where there is exactly one at the least distance,
    else the baseline's owner (task, owner)."""
    near = delegates.groupBy("task").agg(F.min("distance").alias("distance"))
    first = delegates.join(near, ["task", "distance"]).groupBy("task").agg(F.count_distinct("owner").alias("n"), F.min("owner").alias("_d")).where("n = 1").drop("n")
    return baseline.join(first, "task", "left").select("task", F.coalesce("_d", "owner").alias("owner"), F.when(F.col("_d").isNotNull(), "delegate").otherwise("baseline").alias("by"))


def task_relationships(*parts: tuple[str, DataFrame]) -> DataFrame:
    """(source, target, reason) out of several edge tables; an edge keeps the first reason that brings it."""
    rows = None
    for at, (reason, df) in enumerate(parts):
        one = df.select("source", "target").distinct().select("source", "target", F.struct(F.lit(at).alias("at"), F.lit(reason).alias("reason")).alias("_r"))
        rows = one if rows is None else rows.union(one)
    return rows.groupBy("source", "target").agg(F.min("_r").alias("_r")).select("source", "target", "_r.reason")


def cycles(edges: DataFrame, max_length: int) -> DataFrame:
    """(node, length): nodes on a cycle of at most max_length edges, with the length of the shortest.

    Nodes that nothing enters or leaves are peeled off first; walks start only from what is left."""
    e = cut(edges.select("source", "target").distinct())
    for _ in range(max_length):
        kept = cut(e.join(e.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(e.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target"))
        if kept.count() == e.count():
            break
        e = kept
    now = e.select(F.col("source").alias("start"), F.col("target").alias("at"))
    out = None
    for length in range(1, max_length + 1):
        hit = now.where("start = at").select(F.col("start").alias("node"), F.lit(length).alias("length"))
        out = hit if out is None else out.union(hit)
        if length < max_length:
            # a walk that is back at its start is done
            now = cut(now.where("start <> at").join(e, F.col("at") == F.col("source")).select("start", F.col("target").alias("at")).distinct())
    return out.groupBy("node").agg(F.min("length").alias("length"))


def surface_digests(rows: DataFrame, key: str, surfaces: dict[str, str]) -> DataFrame:
    """(key, surface, digest): for each surface, the digest of the sorted distinct values of its column, as JSON."""
    parts = F.array(*[F.struct(F.lit(name).alias("surface"), F.sha2(F.to_json(F.array_sort(F.collect_set(column))), 256).alias("digest")) for name, column in surfaces.items()])
    return rows.groupBy(key).agg(parts.alias("x")).select(key, F.explode("x").alias("x")).select(key, "x.surface", "x.digest")


def spans_first(rows: DataFrame, group: str, index: str, inside: str, n: int) -> DataFrame:
    """n rows of each group, those inside the span first and then by index; the caller shows them by index."""
    return top_per_group(rows, [group], [F.col(inside).cast("int").desc(), index], n, "_rn").drop("_rn")
