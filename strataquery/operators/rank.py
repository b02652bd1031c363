"""Scoring and ranking of search candidates."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataquery.functions.text import is_test_path
from strataquery.operators.graph import cut

#: Weights of whole-query and per-term matches.
EXACT_QUALNAME, EXACT_NAME, IN_QUALNAME, IN_PATH, IN_SIGNATURE = 120.0, 100.0, 70.0, 55.0, 45.0
TERM_NAME, TERM_IN_NAME, TERM_PATH, TERM_QUALNAME, TERM_SIGNATURE = 30.0, 20.0, 12.0, 15.0, 8.0
RECENT, TEST_WANTED, TEST_UNWANTED, RANK_WEIGHT = 24.0, 12.0, -16.0, 18.0


def query_terms(query: str) -> list[str]:
    """Identifier terms of a query, longest first."""
    found: set[str] = set()
    for token in re.findall(r"[A-Za-z_][A-Za-z0-9_-]*|[0-9]+", query):
        found.add(token.lower())
        for part in re.findall(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+", re.sub(r"([A-Z])([A-Z][a-z])", r"\1_\2", token)):
            found.add(part.lower())
    return sorted((t for t in found if len(t) >= 2), key=lambda t: (-len(t), t))


def idf(df: DataFrame, total: Column) -> DataFrame:
    """ln((N + 1) / (df + 1)) + 1 for (token, df)."""
    return df.withColumn("idf", F.round(F.log((F.greatest(total, F.lit(1)) + 1) / (F.col("df") + 1)) + 1, 6))


def term_bonus(raw: str) -> float:
    upper = any(c.isupper() for c in raw[1:]) or raw.isupper()
    return 2.5 * upper + 1.5 * any(c in raw for c in "_-/")


def formulate(terms: dict[str, str], frequencies: dict[str, int], total: int, n: int = 10) -> list[str]:
    """The n most telling terms of a task: rarity, casing and separators count; terms (lower-cased to raw)."""
    score = lambda t: (math.log((max(1, total) + 1) / (frequencies[t] + 1)) + 1.0 + term_bonus(terms[t]), len(t), t)
    return sorted((t for t in terms if t in frequencies), key=score, reverse=True)[:n]


def score(query: str, boost: Column | None = None, recent: Column | None = None, rank: Column | None = None) -> Column:
    """The score of a row (path, name, qualname, signature); all comparisons are on lower-cased text."""
    low = {c: F.lower(F.coalesce(c, F.lit(""))) for c in ("path", "name", "qualname", "signature")}
    raw, terms = query.strip().lower(), query_terms(query)
    give = lambda c, w: F.when(c, w).otherwise(0.0)
    has = lambda c, t: F.contains(low[c], F.lit(t))
    parts = [F.lit(0.0)]
    if raw:
        parts += [give(low["qualname"] == raw, EXACT_QUALNAME), give(low["name"] == raw, EXACT_NAME), give(has("qualname", raw), IN_QUALNAME), give(has("path", raw), IN_PATH), give(has("signature", raw), IN_SIGNATURE)]
    for t in terms:
        parts += [F.when(low["name"] == t, TERM_NAME).when(has("name", t), TERM_IN_NAME).otherwise(0.0), give(has("path", t), TERM_PATH), give(has("qualname", t), TERM_QUALNAME), give(has("signature", t), TERM_SIGNATURE)]
    wanted = bool({"test", "tests", "spec"} & set(terms))
    parts.append(give(is_test_path(low["path"]), TEST_WANTED if wanted else TEST_UNWANTED))
    if recent is not None:
        parts.append(give(recent, RECENT))
    if rank is not None:
        parts.append(rank * RANK_WEIGHT)
    if boost is not None:
        parts.append(F.coalesce(boost, F.lit(0.0)))
    return reduce(lambda a, b: a + b, parts)


def file_boost(matches: Column, terms: int) -> Column:
    return F.least(F.lit(72.0), 6.0 * matches + 30.0 * matches / terms)


def symbol_boost(matches: Column) -> Column:
    return F.least(F.lit(18.0), 2.0 * matches)


def domain_boost(position: Column, control: Column) -> Column:
    """42 less 7 for each place in the query's list of domains, 16 at least; control files 12 more; 60 at most."""
    return F.least(F.lit(60), F.greatest(F.lit(16), 42 - 7 * position) + F.when(control, 12).otherwise(0))


#: Words that tell a query's intent, by intent in the order in which they are tried.
INTENT_WORDS = {
    "config": "config configuration manifest makefile dockerfile pyproject package lockfile yaml yml toml json ini setting settings env",
    "test": "test tests testing spec specs fixture fixtures coverage",
    "relationship": "caller callers calls called reference references refs import imports imported depend depends dependency dependencies dependent dependents uses usage",
    "structural": "class function method struct interface enum signature definition definitions symbol symbols export exports",
    "conceptual": "architecture flow lifecycle authority ownership orchestration pipeline how where why design boundary boundaries overview",
}
#: Suffixes of file names in queries.
NAMED_FILES = "py pyi js jsx ts tsx go rs java kt c h cc cpp hpp cs rb php swift toml yaml yml json ini cfg conf md"
#: Words that name a domain of the repository, in the order in which domains are preferred.
DOMAIN_WORDS = {
    "ownership": "owner owners ownership owns owned authority authoritative responsibility responsibilities responsible governs governed allowed forbidden",
    "architecture": "architecture architectural design boundary boundaries structure structural shape layer layers",
    "build": "build make makefile init setup bootstrap package packaging release",
    "plan": "plan plans template templates orchestration pipeline",
    "config": "config configuration manifest setting settings yaml yml toml json env lockfile",
    "script": "script scripts shell bash command commands",
    "contract": "contract contracts schema schemas invariant invariants policy policies requirement requirements allowed forbidden valid invalid rule rules",
    "doc": "doc docs documentation readme guide",
    "test": "test tests testing spec fixture coverage",
    "source": "class function method symbol implementation code source",
}
#: Words of change and consequence, which call for source, architecture and contract.
IMPACT_WORDS = "lifecycle state terminal cancel cancellation change changes changed break breaks impact happen happens if"


def is_identifier(query: str) -> bool:
    """One name, or two joined by a dot."""
    parts = query.strip().split(".")
    return len(parts) <= 2 and all(p.isidentifier() for p in parts)


def names_path(query: str) -> bool:
    """A path with a slash, or a file name with a known suffix."""
    words = re.split(r"\s+", query.strip())
    suffixes = set(NAMED_FILES.split())
    named = lambda w: any(m[1].lower() in suffixes for m in re.finditer(r"[\w-]\.([A-Za-z]+)\b", w))
    return any(re.match(r"^\.?[\w.-]+/[\w./-]", w) or named(w) for w in words)


def preferred_domains(words: set[str]) -> list[str]:
    found = [d for d, vocabulary in DOMAIN_WORDS.items() if words & set(vocabulary.split())]
    if words & set(IMPACT_WORDS.split()):
        found += [d for d in ("source", "architecture", "contract") if d not in found]
    return found


def route(query: str) -> dict[str, object]:
    """How a query is to be answered: its intent, how sure that is, which stages serve it, the domains it prefers."""
    if not query.strip():
        raise ValueError("an empty query has no route")
    words = {w.lower() for w in re.findall(r"[A-Za-z_][A-Za-z0-9_-]*|[0-9]+", query)}
    told = {name: bool(words & set(vocabulary.split())) for name, vocabulary in INTENT_WORDS.items()}
    tries = [("path", names_path(query)), *((n, told[n]) for n in ("config", "test", "relationship", "structural")), ("identifier", is_identifier(query)), ("conceptual", told["conceptual"])]
    intent = next((name for name, hit in tries if hit), "hybrid")
    sure = {"structural": "medium", "conceptual": "medium", "hybrid": "low"}.get(intent, "high")
    expands = intent not in ("path", "config", "test")
    return {"intent": intent, "confidence": sure, "native_definitions": expands, "caller_expansion": expands, "domains": preferred_domains(words)}


def term_counts(docs: DataFrame, terms: list[str], fields: list[str]) -> DataFrame:
    """path, a length for each field, and an array of each term's occurrences for each field, all inside the row.

    A field stands once in the plan: it is handed to a function as a whole, which looks through it once for all terms and
    then counts among what it found."""

    def counts(field: str) -> Column:
        count = lambda found, t: F.size(F.filter(found, lambda x: x == t))
        hits = lambda tokens: F.array(F.filter(tokens, lambda x: x.isin(terms)))
        each = lambda tokens, found: F.struct(F.size(tokens).alias("n"), F.array(*[count(found, t) for t in terms]).alias("tf"))
        return F.transform(F.array(field), lambda tokens: F.transform(hits(tokens), lambda found: each(tokens, found))[0])[0].alias(field)

    rows = cut(docs.select("path", *map(counts, fields)))
    return rows.select("path", *[F.col(f)["n"].alias(f"len_{f}") for f in fields], *[F.col(f)["tf"].alias(f"tf_{f}") for f in fields])


def bm25(docs: DataFrame, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 of documents from (path, tokens): lengths and document frequencies over all documents that have tokens."""
    return fielded_bm25(docs, terms, {"tokens": 1.0}, k1, {"tokens": b})


def fielded_bm25(docs: DataFrame, terms: list[str], weights: dict[str, float], k1: float = 1.2, b: dict[str, float] | None = None) -> DataFrame:
    """BM25F: occurrences in several fields (arrays of tokens) are scaled by the field's length and weight and summed
    before they are dampened. Counts are made inside each row in one pass over the documents and written; statistics (one
    row) and scores are read from them."""
    fields = list(weights)
    rows = term_counts(docs, terms, fields).where(reduce(lambda x, y: x | y, [F.col(f"len_{f}") > 0 for f in fields]))
    held = lambda i: reduce(lambda x, y: x | y, [F.col(f"tf_{f}")[i] > 0 for f in fields])
    stats = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"len_{f}").alias(f"avg_{f}") for f in fields], *[F.count_if(held(i)).alias(f"df_{i}") for i in range(len(terms))])
    joined = rows.where(reduce(lambda x, y: x | y, [held(i) for i in range(len(terms))])).crossJoin(F.broadcast(stats))  # one row
    total = F.lit(0.0)
    for i in range(len(terms)):
        tf = sum((weights[f] * F.col(f"tf_{f}")[i] / (1 - (b or {}).get(f, 0.75) + (b or {}).get(f, 0.75) * F.col(f"len_{f}") / F.when(F.col(f"avg_{f}") > 0, F.col(f"avg_{f}")).otherwise(1.0)) for f in fields), F.lit(0.0))
        weight = F.log(1 + (F.col("n") - F.col(f"df_{i}") + 0.5) / (F.col(f"df_{i}") + 0.5))
        total = total + weight * tf * (k1 + 1) / (tf + k1)
    return joined.select("path", F.round(total, 6).alias("bm25"))


def confidence(best: Column) -> Column:
    return F.when(best >= 70, "high").when(best >= 30, "medium").otherwise("abstain")
