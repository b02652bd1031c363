"""Evidence packets: what was observed, by whom, whether it still holds, and what it supports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataquery.functions.text import digest
from strataquery.operators.topk import top_per_group
from strataquery.sources.stored import Parts


def edges_from(edges: DataFrame, path: str, source: str, n: int) -> DataFrame:
    """Edges of one symbol or of anything inside it, the first n by line."""
    own = (F.col("source") == source) | F.col("source").startswith(source + ".")
    return edges.where((F.col("path") == path) & own).orderBy("line", "target", "kind").limit(n)


def latest_digests(cache: DataFrame, key: str = "folder") -> DataFrame:
    """A write-behind cache read back: the newest digest of each folder (key, generation, digest); ties by digest."""
    return cache.groupBy(key).agg(F.max(F.struct("generation", "digest")).alias("_x")).select(key, "_x.generation", "_x.digest")


def staleness(rows: DataFrame, built: str, seen: str, known: str) -> DataFrame:
    """Adds `stale`: null where nothing is known of the present, else whether it is past what the row was built from."""
    return rows.withColumn("stale", F.when(F.col(known), F.col(seen) > F.col(built)))


def observed_spans(spans: DataFrame, files: DataFrame) -> DataFrame:
    """(scope, path, start, end, state, digest) of caller spans: bytes `start` to `end` of a file's text; missing-path,
    out-of-range or observed with the digest of just those bytes."""
    rows = spans.join(files.select("path", "text"), "path", "left")
    inside = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.octet_length("text"))
    state = F.when(F.col("text").isNull(), "missing-path").when(~inside, "out-of-range").otherwise("observed")
    part = F.substring(F.col("text").cast("binary"), F.col("start") + 1, F.col("end") - F.col("start"))
    return rows.select("scope", "path", "start", "end", state.alias("state"), F.when(state == "observed", F.sha2(part, 256)).alias("digest"))


def discovered(spark: SparkSession, providers: dict[str, Callable[[SparkSession], DataFrame]], most: int) -> DataFrame:
    """Declarations (concept, subject, value) of several providers, each with its provider and a state: a provider's
    first `most` rows are qualified, what is beyond is `beyond-bound`; a provider that two others contradict isn't dropped."""
    out = None
    for name, run in sorted(providers.items()):
        one = run(spark).select(F.lit(name).alias("provider"), "concept", "subject", "value").distinct()
        out = one if out is None else out.union(one)
    if out is None:
        raise ValueError("no providers")
    ranked = top_per_group(out, ["provider"], ["concept", "subject", "value"], most, "_rn")
    return out.join(ranked.select("provider", "concept", "subject", "value", F.lit("qualified").alias("state")), ["provider", "concept", "subject", "value"], "left").na.fill("beyond-bound", ["state"])


def relationships(claims: DataFrame, target: str) -> DataFrame:
    """Claims of all producers that mention a symbol on either side: one row for each relationship, with its producers."""
    hit = claims.where((F.col("subject") == target) | (F.col("object") == target))
    return hit.groupBy("subject", "kind", "object").agg(F.array_join(F.array_sort(F.collect_set("producer")), ",").alias("producers"), F.count_distinct("producer").alias("n"))


def cross_repository(impacts: DataFrame, links: DataFrame) -> DataFrame:
    """Per repository: its own affected paths, and those of repositories that link to it (repository, path; source, target)."""
    own = impacts.groupBy("repository").agg(F.count_distinct("path").alias("own"))
    other = links.select(F.col("source").alias("_by"), F.col("target").alias("repository")).distinct().join(impacts.select(F.col("repository").alias("_by"), "path"), "_by").groupBy("repository").agg(F.count_distinct("_by", "path").alias("linked"), F.count_distinct("_by").alias("repositories"))
    return own.join(other, "repository", "full_outer").na.fill(0)


def qualified_identity(imports: DataFrame, owners: DataFrame) -> DataFrame:
    """Imports (path, module) with the one owner of their module (module, owner); shared and unowned ones get none."""
    one = owners.groupBy("module").agg(F.count_distinct("owner").alias("n"), F.min("owner").alias("owner"))
    rows = imports.select("path", "module").distinct().join(one, "module", "left")
    state = F.when(F.col("n").isNull(), "unowned").when(F.col("n") == 1, "qualified").otherwise("shared")
    return rows.select("path", "module", state.alias("state"), F.when(F.col("n") == 1, F.col("owner")).alias("owner"))


def context_identity(parts: dict[str, Column], domain: str) -> Column:
    """The digest of a context's parts in the order of their names; a part that is null isn't one that is empty."""
    return digest(*[parts[k].cast("string") for k in sorted(parts)], domain=domain)


def reacquired(claimed: DataFrame, observed: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Supplied claims against what is observed again: confirmed, contradicted or unobserved. What was only observed
    confirms nothing and isn't shown."""
    now = observed.select(*keys, F.col(value).alias("_now"), F.lit(True).alias("_seen"))
    state = F.when(F.col("_seen").isNull(), "unobserved").when(F.col(value).eqNullSafe(F.col("_now")), "confirmed").otherwise("contradicted")
    return claimed.join(now, keys, "left").select(*keys, state.alias("state"))


def declaration_explained(rows: DataFrame, concept: str) -> DataFrame:
    """Why a concept stands as it does: each value with its subjects, and whether it is the only one, one of several equal
    in support, or outnumbered. Nothing is chosen."""
    own = rows.where(F.col("concept") == concept).groupBy("value").agg(F.count_distinct("subject").alias("subjects"), F.min("subject").alias("first_subject"))
    total = own.agg(F.count(F.lit(1)).alias("_n"), F.max("subjects").alias("_most"))
    state = F.when(F.col("_n") == 1, "sole").when(F.col("subjects") == F.col("_most"), "leading-or-tied").otherwise("outnumbered")
    return own.crossJoin(F.broadcast(total)).select("value", "subjects", "first_subject", state.alias("state"))  # one row


def decision_trace(candidates: DataFrame, admitted: DataFrame, rejected: DataFrame) -> DataFrame:
    """Candidates (task, owner, score) with their status: rejected with its reason, admitted where it is the task's only
    best admissible one, competing where others are as good; and a digest that identifies the proof."""
    rows = candidates.join(admitted.select("owner", F.lit(True).alias("_ok")).distinct(), "owner", "left").join(rejected.groupBy("owner").agg(F.min("reason").alias("reason")), "owner", "left")
    open_ = F.col("_ok") & F.col("reason").isNull()
    best = rows.where(open_).groupBy("task").agg(F.max("score").alias("_best"))
    rows = rows.join(best, "task", "left")
    top = rows.where(open_ & (F.col("score") == F.col("_best"))).groupBy("task").agg(F.count(F.lit(1)).alias("_top"))
    leads = F.coalesce(open_ & (F.col("score") == F.col("_best")), F.lit(False))
    status = F.when(F.col("reason").isNotNull(), "rejected").when(F.col("_ok").isNull(), "not-admitted").when(leads & (F.col("_top") == 1), "admitted").when(leads, "competing").otherwise("outscored")
    proof = digest(F.col("task").cast("string"), F.col("owner").cast("string"), status, F.col("reason"), domain="trace")
    return rows.join(top, "task", "left").select("task", "owner", status.alias("status"), "reason", proof.alias("proof"))


def unequal(cold: DataFrame, warm: DataFrame) -> DataFrame:
    """Rows that a warm answer has and a cold one doesn't, or the other way round; none where a cache changes nothing."""
    a, b = cold.exceptAll(warm), warm.exceptAll(cold)
    return a.withColumn("side", F.lit("cold")).unionByName(b.withColumn("side", F.lit("warm")))


def changed_set(changed: DataFrame, reach: DataFrame, verifiers: DataFrame, per_path: int) -> DataFrame:
    """Verifiers of changed paths: those of the path itself (distance 0), then of what reaches it (path, dependent,
    distance); the first per_path by distance and name, with how many there are."""
    near = changed.select("path", F.col("path").alias("dependent"), F.lit(0).alias("distance"))
    both = near.union(changed.join(reach, "path").select("path", "dependent", "distance"))
    found = both.join(verifiers.select(F.col("path").alias("dependent"), "verifier"), "dependent").groupBy("path", "verifier").agg(F.min("distance").alias("distance"))
    total = found.groupBy("path").agg(F.count(F.lit(1)).alias("total"))
    return top_per_group(found, ["path"], ["distance", "verifier"], per_path, "_rn").drop("_rn").join(total, "path")


def evaluated(nodes: DataFrame, edges: DataFrame, value: str, combine: Callable[[Column, Column], Column], rounds: int) -> DataFrame:
    """(node, value, settled, height): a node's value out of its own and its dependencies', by a caller's function of (own,
    sorted array of theirs), level by level from the leaves (height 0); nodes not settled after `rounds`, those on cycles
    included, keep null. `incremental.recomputed` brings the values up to date.

    A round reads and writes only the dependencies of nodes that still wait. Its joins are merged, never broadcast, for
    each of them would send up to a broadcast's size through the driver."""
    own, mine = F.col(value), Window.partitionBy("node")
    made = dict(nodes.select(combine(own, F.array().cast(f"array<{dict(nodes.dtypes)[value]}>")).alias("v")).dtypes)["v"]
    needs = edges.select(F.col("source").alias("node"), "target", F.lit(False).alias("known")).distinct()
    rows = nodes.select("node", own.alias("own")).join(needs.hint("merge"), "node", "left").select("node", "own", "target", F.coalesce("known", F.lit(True)).alias("known"), F.lit(None).cast(made).alias("v"))
    parts = Parts(nodes.sparkSession, "evaluated")
    values = lambda df: df.where("ready").groupBy("node", "height").agg(F.first("own").alias("own"), F.array_sort(F.collect_list("v")).alias("_vs")).select("node", combine(F.col("own"), F.col("_vs")).cast(made).alias("v"), "height")
    for height in range(rounds + 1):
        n, told = parts.add(rows.withColumn("ready", F.bool_and("known").over(mine)).withColumn("height", F.lit(height)), [F.count_if("ready").alias("ready")])
        if told["ready"] in (0, n):
            break
        now = values(parts.part(-1)).select(F.col("node").alias("target"), F.col("v").alias("_v"), F.lit(True).alias("_now"))
        left = parts.part(-1).where("NOT ready")
        met = left.where("NOT known").join(now.hint("merge"), "target", "left").select("node", "own", "target", F.coalesce("_now", F.lit(False)).alias("known"), F.col("_v").alias("v"))
        rows = met.union(left.where("known").select(met.columns))
    return nodes.select("node").join(values(parts.df).hint("merge"), "node", "left").select("node", F.col("v").alias("value"), F.col("v").isNotNull().alias("settled"), "height")


def retried(run: Callable[[], DataFrame], passing: tuple[type[Exception], ...], times: int = 3) -> DataFrame:
    """A run repeated after failures that pass by themselves, such as a generation that has moved on; others are raised."""
    for n in range(times):
        try:
            return run()
        except passing:
            if n == times - 1:
                raise
    raise ValueError("times must be 1 or more")
