"""Retrieval for a whole task description: several views of it are searched, and their ranked lists are fused by path.

A view is a query of its own: the task's most telling words, the same with words that its cues of governance and scope ask
for, and with words of the families of evidence that it touches. A path counts in each list by the place at which it is
first seen; its hit is the best one of any list. Two short-cuts end a search before that: a rare identifier, or a small
island of files that share several rare terms, where these alone reach a test and something to act on. Only the task's own
words and their frequencies, at most some dozens, reach the driver."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataquery.functions.text import impact_role, is_test_path
from strataquery.operators import rank
from strataquery.operators.topk import first_seen_rank
from strataquery.sources.postings import Postings

#: Words of tasks that say nothing about the repository.
STOPWORDS = """a about above affect affected after again against all also an and any appropriate are area at be been before being below belong
belongs between both but by can capability change changes changing could describe did do does down during each else fact facts few file files
first for from further happen happens here how if in include including instead into is just likely local may might more most move must name need
needed needs no nor not now of off on once one only or other out over own predict reconsidered relevant remain remains responsibility rule rules
same should so some start such than the then there through to too two under untouched up very was were what when where which who why will with
without would"""
#: Words that ask who governs something, and what is looked for then.
GOVERNANCE = """allowed architectural architecture authoritative authority belong belongs boundaries boundary contract contracts forbidden invariant
invariants must never owned owner owners ownership owns proposal responsibility review should"""
GOVERNANCE_TERMS = "ownership authority architecture contract agents readme"
#: Words that name a scope, and what is looked for with each.
SCOPES = [
    ("frontend", "frontend readme agents"), ("backend api", "backend readme agents"), ("plan plans", "plan agents readme"), ("make certify certification setup bootstrap", "make certification docs contract"),
    ("generated openapi", "generated contract agents readme"), ("schedule scheduler", "schedule scheduler ownership backend agents"),
]
#: Words of a family of evidence, and what the family is looked for by.
FAMILIES = [
    ("privacy private public secret secrets leak leaking redact redaction sanitize sanitized", "privacy security confidentiality redaction exposure"),
    ("observe observer observability diagnostic diagnostics log logs logging metric metrics status", "observability diagnostics logging metrics status"),
    ("local offline checkout repository workspace", "local offline repository workspace"),
    ("ci cd pipeline release delivery automation", "ci cd pipeline release delivery automation"),
    ("lock lockfile fingerprint hash digest identity provenance", "lock identity fingerprint digest provenance"),
    ("dependency dependencies package packages lockfile materialize materialization resolution", "dependency lockfile package materialization resolution"),
    ("browser", "browser preflight"), ("observer readonly read_only read-only", "observer readonly"), ("snapshot snapshots content workspace sandbox", "snapshot content workspace sandbox"),
    ("retry retries backoff network egress", "retry network backoff egress"), ("capacity resource resources headroom memory cpu pressure limit limits", "capacity resource headroom memory cpu limits"),
]
#: Words under which neither short-cut is taken, for they ask for authority at large; and words that are
#: too common in tasks to make an island.
BROAD = "config configuration settings makefile pyproject toml yaml yml sql schema policy invariant authority agents"
COMMON = "accepted actually active behavior change drives implementation owner request response that update verification verify"
#: Weights of the views, the most terms of each, and the constant of rank fusion.
WEIGHTS, TERMS, K = {"base": 1.2, "governance": 1.0, "evidence": 0.8}, {"base": 10, "governance": 16, "evidence": 18}, 60.0
#: The most files of a rare identifier; terms, files and least shared terms of an island.
RARE_FILES, ISLAND_TERMS, ISLAND_FILES, ISLAND_SHARED = 8, 6, 16, 2
ACTION_ROLES = ["implementation", "contract", "build_config"]


@dataclass(frozen=True)
class View:
    name: str
    terms: tuple[str, ...]
    weight: float
    fetch: int


def words(task: str) -> dict[str, str]:
    """The task's words in their order, lower-cased to as written, without stop words."""
    stop, found = set(STOPWORDS.split()), {}
    for raw in re.findall(r"[^\W\d]\w*", task):
        low = raw.lower().strip("_-")
        if len(low) >= 2 and low not in stop:
            found.setdefault(low, raw)
    return found


def cued(task: str, table: list[tuple[str, str]]) -> list[str]:
    said = {w.lower() for w in re.findall(r"[^\W\d]\w*", task)}
    return [term for cues, terms in table if said & set(cues.split()) for term in terms.split()]


def views(task: str, frequencies: dict[str, int], total: int, limit: int = 20, base_terms: int = TERMS["base"]) -> list[View]:
    """The views of a task, those of the same terms once. frequencies: files that hold each of the task's words."""
    own = words(task)
    base = rank.formulate(own, frequencies, total, base_terms) or list(own)[:base_terms]
    extra = {"base": [], "governance": cued(task, [(GOVERNANCE, GOVERNANCE_TERMS), *SCOPES]), "evidence": cued(task, FAMILIES)}
    fetch = {"evidence": max(24, min(40, limit * 2))}
    out: dict[tuple[str, ...], View] = {}
    for name, more in extra.items():
        terms = tuple(dict.fromkeys([*base, *more]))[: max(TERMS[name], len(base))]
        out.setdefault(terms, View(name, terms, WEIGHTS[name], fetch.get(name, max(40, min(80, limit * 4)))))
    return list(out.values())


def fused(hits: DataFrame, chosen: list[View], n: int) -> DataFrame:
    """path, score, views and the columns of the best hit, out of hits (view, place, path, score, ...): the n best paths.

    A path's best hit is the one with the highest score, of equals that of the first view and place."""
    spark = hits.sparkSession
    told = F.broadcast(spark.createDataFrame([(v.name, v.weight, i) for i, v in enumerate(chosen)], "view string, _weight double, _at int"))  # at most three rows
    firsts = first_seen_rank(hits, ["view"], "path", "place").join(told, "view")
    scores = firsts.groupBy("path").agg(F.round(F.sum(F.col("_weight") / (F.lit(K) + F.col("path_rank"))) * 1000, 6).alias("fused"), F.count(F.lit(1)).alias("views"))
    kept = [c for c in hits.columns if c not in ("view", "place", "path")]
    best = hits.join(told, "view").groupBy("path").agg(F.max_by(F.struct(*kept), F.struct("score", -F.col("_at"), -F.col("place"))).alias("_hit"))
    rows = scores.join(best, "path").select("path", F.col("fused").alias("score"), "views", *[F.col("_hit")[c].alias(c) for c in kept if c != "score"])
    return rows.orderBy(F.desc("score"), "path").limit(n)


def line_hits(index: Postings, view: View) -> DataFrame:
    """view, place, path, line, score: the view's lines by how many of its terms they hold."""
    from pyspark.sql import Window

    lines = index.lines_of(list(view.terms)).groupBy("path", "line").agg(F.count(F.lit(1)).cast("double").alias("score"))
    order = [F.desc("score"), "path", "line"]
    some = lines.orderBy(*order).limit(view.fetch)
    return some.select(F.lit(view.name).alias("view"), F.row_number().over(Window.orderBy(*order)).alias("place"), "path", "line", "score")  # over `fetch` rows


def answers(found: DataFrame) -> DataFrame:
    """The files found if one of them is a test, another one can be acted on and there are not too many; else none."""
    roles = found.withColumn("_test", is_test_path(F.col("path"))).withColumn("_acts", ~is_test_path(F.col("path")) & impact_role(F.col("path")).isin(ACTION_ROLES))
    sums = roles.agg(F.count(F.lit(1)).alias("_n"), F.count_if("_test").alias("_tests"), F.count_if("_acts").alias("_acting"))
    return roles.crossJoin(F.broadcast(sums)).where("_n >= 2 AND _tests >= 1 AND _acting >= 1")  # one row


def rare_identifier(task: str, index: Postings) -> str | None:
    """The task's first identifier, with a digit or an underscore, that only a few files hold."""
    said = [t for t in re.findall(r"[^\W\d]\w*", task) if len(t) >= 3 and ("_" in t or any(c.isupper() for c in t[1:])) and (not t.isupper() or any(c.isdigit() for c in t))]
    asked = [t for t in said if "_" in t or any(c.isdigit() for c in t)]
    if not asked or set(words(task)) & set(BROAD.split()):
        return None
    df = {r["token"]: r["df"] for r in index.frequencies([t.lower() for t in asked[:4]]).collect()}
    return next((t for t in asked if 0 < df.get(t.lower(), 0) <= RARE_FILES), None)


def anchored(token: str, index: Postings, files: DataFrame, symbols: DataFrame, n: int) -> DataFrame:
    """path, score, qualname, start_line of files that hold a rare identifier or have it in their path, tests first; a
    symbol that carries it raises a file. No rows unless they answer (`answers`)."""
    low = token.lower()
    named = files.where(F.contains(F.lower("path"), F.lit(low))).select("path").orderBy("path").limit(max(8, min(32, 2 * n)))
    found = answers(index.of([low]).select("path").union(named).distinct())
    carries = reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(low)) for c in ("path", "name", "qualname")])
    first = symbols.join(found.select("path"), "path", "left_semi").where(carries).groupBy("path").agg(F.min(F.struct("start_line", "qualname")).alias("_s"))
    rows = found.join(first, "path", "left").select("path", F.when(F.col("_s").isNotNull(), 1000.0).otherwise(900.0).alias("score"), F.col("_s.qualname").alias("qualname"), F.col("_s.start_line").alias("start_line"))
    return rows.orderBy(F.when(is_test_path(F.col("path")), 0).otherwise(1), F.size(F.split("path", "/")), "path").limit(n)


def island_terms(task: str, index: Postings, total: int) -> list[str]:
    """The task's rare terms, the rarest first."""
    out = set(STOPWORDS.split()) | set(COMMON.split())
    terms = [t for t in rank.query_terms(task) if len(t) >= 4 and t not in out and not t.isdigit()]
    if len(terms) < 2 or set(words(task)) & set(BROAD.split()):
        return []
    most = max(12, min(64, total // 4))
    df = {r["token"]: r["df"] for r in index.frequencies(terms).collect()}
    return sorted((t for t in terms if 0 < df.get(t, 0) <= most), key=lambda t: (df[t], -len(t), t))[:ISLAND_TERMS]


def island(terms: list[str], index: Postings, n: int) -> DataFrame:
    """path, score, matches of files that share several of the terms, tests first; no rows unless these are few, with
    exactly one test, and answer."""
    from pyspark.sql import Window

    shared = index.of(terms).groupBy("path").agg(F.count(F.lit(1)).alias("matches")).where(F.col("matches") >= ISLAND_SHARED)
    found = answers(shared).where(f"_n <= {ISLAND_FILES} AND _tests = 1")
    order = [F.col("_test").desc(), F.desc("matches"), F.size(F.split("path", "/")), "path"]
    return found.select("path", (981.0 - F.row_number().over(Window.orderBy(*order))).alias("score"), "matches").orderBy(F.desc("score")).limit(n)  # at most ISLAND_FILES rows


def find_task(task: str, index: Postings, files: DataFrame, symbols: DataFrame, search: Callable[[View], DataFrame], n: int = 20) -> DataFrame:
    """path, score, route (rare-identifier, lexical-island or fusion) and, where known, qualname and start_line.

    search gives the hits of a view: (view, place, path, score, qualname, start_line). A short-cut that answers is the whole
    answer; the views aren't searched then."""
    columns = ["path", F.col("score").cast("double").alias("score"), F.col("qualname").cast("string").alias("qualname"), F.col("start_line").cast("long").alias("start_line")]
    if token := rare_identifier(task, index):
        found = anchored(token, index, files, symbols, n)
        if not found.isEmpty():
            return found.select(F.lit("rare-identifier").alias("route"), *columns)
    total = files.count()
    terms = island_terms(task, index, total)
    if len(terms) >= 2:
        found = island(terms, index, n)
        if not found.isEmpty():
            return found.withColumns({"qualname": F.lit(None), "start_line": F.lit(None)}).select(F.lit("lexical-island").alias("route"), *columns)
    df = {r["token"]: r["df"] for r in index.frequencies(list(words(task))).collect()}
    chosen = [v for v in views(task, df, total, n) if v.terms]
    if not chosen:
        raise ValueError("a task without a word to look for")
    hits = reduce(DataFrame.unionByName, [search(v) for v in chosen])
    return fused(hits, chosen, n).select(F.lit("fusion").alias("route"), *columns)
