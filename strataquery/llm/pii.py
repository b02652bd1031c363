r"""Personal data: pattern spans, and information-theoretic sanitisation of the terms that give them away.

Everything here is DataFrame and SQL functions. Patterns find base spans of four kinds (email, ip, card, phone). Then
each found value is a protected entity, and the corpus tells how strongly a term (a word of at least three letters)
reveals it: PMI(t; e) = log2(N n(t,e) / (n(t) n(e))) is set against the entity's own information IC(e) = log2(N / n(e)).
From a share of `GENERALISE` of that information on a term is generalised, from `REMOVE` on removed, provided that it
stands with the entity in at least `SUPPORT` documents. Its spans, in every text that holds the entity, come beside the
base ones, which all stay.

Counts are of independent documents: equal texts count once, and so do near copies that hold an entity (`families`:
banded min-hashes of five-word shingles, which bring together 0.91 of pairs at a similarity of 0.8, 0.99 at 0.87 and
0.006 at 0.3; bands chain, so a large group of near copies counts once). Otherwise different documents with the same signature block stay independent.
A term stands with an entity anywhere in the text: texts of more than `PASSAGE` characters are covered by overlapping
passages of twice that, and the two meet if they begin in one passage; no word is cut.

Patterns are written with possessive repetition and look-behind where nothing is gained by trying again, so the time is
linear and Java's matcher needs no deep recursion on very long runs; the matches are the same. Running sums over a
text's matches are taken in about sqrt(n) blocks, and texts are cut in a fixed-width encoding, so very long texts with
very many matches cost little more than in proportion.

Edge cases: null texts count as empty and keep null when sanitised; texts without personal data have no spans and stay as
they are; overlapping spans of different kinds are all reported, and their union is replaced once, by the mark of the
first (of two that begin together, the longer; of equal ones, any); repeated rows get equal results; an empty table
gives an empty result; other columns, whatever their names, are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquery.llm.common import FEW, HOT, components, skewed_join, stored

PASSAGE, SUPPORT, GENERALISE, REMOVE = 8192, 3, 0.85, 0.98
BANDS, ROWS, SHINGLE = 8, 6, 5
#: Bytes of a table that are broadcast, by a sum over its rows.
BROADCAST = 32 << 20
#: Kinds in their order of output: a cheap test that a text can hold one at all, the pattern, the test of a match.
KINDS = {
    "email": ("instr({text}, '@') > 0", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "true"),
    "ip": (
        r"{text} rlike '[0-9]\\.[0-9]++\\.[0-9]'",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        r"x.m rlike '^0*(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(\\.0*(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])){3}$'",
    ),
    "card": (
        r"{text} rlike '(?:[0-9][ -]?+){15}[0-9]'",
        r"[0-9](?:[\x20-]?+[0-9])++",
        "CASE WHEN length(x.d) BETWEEN 16 AND 19 THEN aggregate(sequence(1, length(x.d)), 0, (s, i) -> s + "
        "(CAST(substring(x.d, length(x.d) - i + 1, 1) AS INT) * (2 - i % 2)) - "
        "IF(i % 2 = 0 AND CAST(substring(x.d, length(x.d) - i + 1, 1) AS INT) > 4, 9, 0)) % 10 = 0 ELSE false END",
    ),
    "phone": ("instr({text}, '+') > 0", r"\+[0-9][\x20().0-9-]+[0-9]", "length(x.d) BETWEEN 8 AND 15"),
}
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]", "removed": ""}
SPAN = "struct<k:string,s:int,e:int,v:string>"
NONE = f"CAST(array() AS array<{SPAN}>)"
WORD = r"\p{L}{3,}"


def literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(name: str, value: str, body: str) -> str:
    """SQL that computes a value once and uses it by name."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def scan(array: str, start: str, over_block: str, step: str, none: str) -> str:
    """SQL for a running fold over `array` that gives an array: `step` makes, from a.p (the state before x), a struct of
    the state after x and a.o with x's output appended; `over_block` is the state after block `z` from the state a.p.

    The array is cut into about sqrt(n) blocks: appending copies an output, which would otherwise take n steps squared."""
    width = "CAST(greatest(1, floor(sqrt(size(p)))) AS INT)"
    blocks = f"transform(sequence(0, CAST((size(p) - 1) DIV {width} AS INT)), b -> slice(p, b * {width} + 1, {width}))"
    starts = f"aggregate(q, named_struct('p', {start}, 'o', CAST(array() AS array<int>)), (a, z) -> named_struct('p', {over_block}, 'o', concat(a.o, array(a.p))), a -> a.o)"
    inner = f"flatten(zip_with(q, {starts}, (z, y) -> aggregate(z, named_struct('p', y, 'o', {none}), (a, x) -> {step}, a -> a.o)))"
    return let("p", array, f"CASE WHEN size(p) > 0 THEN {let('q', blocks, inner)} ELSE {none} END")


def spans(kind: str, pattern: str, valid: str, may: str, text: str) -> Column:
    """Spans of a pattern's matches: what stands between the matches and the matches themselves alternate, and the
    running sum of their lengths (code points) gives each match's place. Each array is computed once for a text."""
    digits = "regexp_replace(m, '[^0-9]', '')" if "x.d" in valid else "''"
    pieces = f"zip_with(split({text}, {literal(pattern)}, -1), regexp_extract_all({text}, {literal(pattern)}, 0), (g, m) -> named_struct('g', length(g), 'm', m, 'd', {digits}))"
    span = f"named_struct('k', '{kind}', 's', a.p + x.g, 'e', a.p + x.g + length(x.m), 'v', x.m)"
    step = f"named_struct('p', a.p + x.g + coalesce(length(x.m), 0), 'o', IF(x.m IS NOT NULL AND ({valid}), concat(a.o, array({span})), a.o))"
    over = "a.p + aggregate(z, 0, (c, x) -> c + x.g + coalesce(length(x.m), 0))"
    return F.expr(f"CASE WHEN {may} THEN {scan(pieces, '0', over, step, NONE)} ELSE {NONE} END")


def detect(rows: DataFrame) -> DataFrame:
    """Adds one array of spans for each kind, `_email` and so on. Reads the column `_text`, which must not be null."""
    return rows.withColumns({f"_{k}": spans(k, pattern, valid, may.replace("{text}", "_text"), "_text") for k, (may, pattern, valid) in KINDS.items()})


def keyed(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """The given columns with `_text` (never null) and `_key`, its digest."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(*columns, text.alias("_text"), F.md5(text.cast("binary")).alias("_key"))


def with_base(rows: DataFrame) -> DataFrame:
    """Adds `_base`, the spans of all kinds."""
    return detect(rows).withColumn("_base", F.concat(*[F.col(f"_{k}") for k in KINDS])).drop(*[f"_{k}" for k in KINDS])


def fits(df: DataFrame, size: Column) -> bool:
    """Whether a table is small enough to be broadcast, by the sum of `size` (bytes) over its rows."""
    return (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST


def families(texts: DataFrame) -> DataFrame:
    """(node, unit) for texts (node, _text) that are near copies of others: one unit for all that share a band of min-hashes."""
    words = texts.select("node", F.split(F.trim(F.lower("_text")), r"\s+").alias("w"))
    shingle = f"explode(transform(sequence(0, greatest(size(w) - {SHINGLE}, 0)), i -> xxhash64(slice(w, i + 1, {SHINGLE}))))"
    least = [F.min(F.xxhash64("h", F.lit(i))).alias(f"m{i}") for i in range(BANDS * ROWS)]
    sketch = words.select("node", F.expr(shingle).alias("h")).groupBy("node").agg(*least)
    bands = F.array(*[F.xxhash64(F.lit(b), *[f"m{b * ROWS + r}" for r in range(ROWS)]) for b in range(BANDS)])
    rows = stored(sketch.select("node", F.explode(bands).alias("band")), "pii-bands")
    shared = stored(rows.groupBy("band").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1"), "pii-shared-bands")
    edges = skewed_join(rows, shared, ["band"], "n", rows.count()).select(F.col("node").alias("a"), F.col("low").alias("b"))
    return components(edges, "pii-families").select("node", F.col("component").alias("unit"))


def in_passages(place: str) -> Column:
    """The passages that a place lies in, one row for each: passage i covers 2 x PASSAGE characters from i x PASSAGE on."""
    return F.explode(F.expr(f"array_distinct(array({place} DIV {PASSAGE}, greatest({place} DIV {PASSAGE} - 1, 0)))"))


def texts_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(_key, node, _text) of distinct texts, for keys (_key, copies) out of rows (_key, _text)."""
    if fits(keys, F.lit(64)):
        rows = docs.join(F.broadcast(keys), "_key", "left_semi")
    else:
        rows = skewed_join(docs, keys, ["_key"], "copies", keys.agg(F.sum("copies")).first()[0])
    return rows.groupBy("_key").agg(F.first("_text").alias("_text")).select("_key", F.xxhash64("_key").alias("node"), "_text")


def text_counts(docs: DataFrame, terms: DataFrame, repeated: DataFrame, held: DataFrame) -> DataFrame:
    """(term, n): in how many distinct texts of rows (_key, _text) each of some terms stands, those of `held` left out.

    A text of one row is counted where it lies, so only sums by term are shuffled; texts of several rows (`repeated`,
    (_key, copies)) are first reduced to their distinct terms."""
    word = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("_text"), F.lit(WORD), F.lit(0)))).alias("term")
    few = F.broadcast(terms) if fits(terms, F.octet_length("term") + 64) else terms
    key = F.xxhash64("_key").alias("node")
    others = docs.select(key, "_text").join(F.broadcast(held.select(key)) if fits(held, F.lit(24)) else held.select(key), "node", "left_anti")
    many = repeated.select(key, "copies")
    if fits(many, F.lit(24)):
        once, often = others.join(F.broadcast(many), "node", "left_anti"), others.join(F.broadcast(many), "node", "left_semi")
    else:
        total = docs.count()
        often = skewed_join(others, many, ["node"], "copies", total)
        once = others.join(F.broadcast(many.where(F.col("copies") > max(FEW, total // HOT)).select("node")), "node", "left_anti").join(many, "node", "left_anti")
    single = once.select(word).join(few, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    several = often.select("node", word).join(few, "term", "left_semi").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return single.union(several).groupBy("term").agg(F.sum("n").alias("n"))


def disclosing_terms(once: DataFrame, per_key: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """(_key, term, kind) for texts that hold an entity which some term reveals, and the texts (_key, _text) that hold
    one that may be revealed; None where there are none.

    once: distinct texts with base spans (_key, _base, copies); per_key: all distinct texts (_key, copies); docs: (_key,
    _text) of all rows."""
    seen = once.select("_key", F.xxhash64("_key").alias("node"), F.explode("_base").alias("b")).select("_key", "node", F.xxhash64("b.k", F.lower("b.v")).alias("entity"), F.col("b.s").alias("place"))
    seen = stored(seen, "pii-seen")
    often = seen.groupBy("entity").agg(F.countDistinct("node").alias("n")).where(F.col("n") >= SUPPORT).select("entity")
    seen = stored(seen.join(stored(often, "pii-often"), "entity"), "pii-recurring")
    if seen.isEmpty():
        return None
    held = stored(once.select("_key", "copies").join(seen.select("_key").distinct(), "_key"), "pii-held")
    texts = stored(texts_of(docs, held), "pii-holders")
    family = stored(families(texts), "pii-units")
    unit = F.coalesce("unit", "node")
    seen = stored(seen.join(family, "node", "left").withColumn("unit", unit), "pii-entities")
    own = stored(seen.groupBy("entity").agg(F.countDistinct("unit").alias("n_e")).where(F.col("n_e") >= SUPPORT), "pii-support")
    if own.isEmpty():
        return None
    places = seen.join(own.select("entity"), "entity", "left_semi").select("node", "entity", in_passages("place").alias("passage")).distinct()
    found = texts.select("node", F.explode(spans("term", WORD, "true", "true", "_text")).alias("w")).select("node", F.lower("w.v").alias("term"), F.col("w.s").alias("s"))
    words = stored(found.select("node", "term", in_passages("s").alias("passage")).distinct().join(family, "node", "left").withColumn("unit", unit), "pii-words")
    # n(t) is at least the number of units that hold t beside an entity; with fewer than SUPPORT there is nothing to tell.
    by_any = words.groupBy("term").agg(F.countDistinct("unit").alias("n_any"), F.count(F.lit(1)).alias("rows")).where(F.col("n_any") >= SUPPORT)
    pairs = skewed_join(words, stored(by_any, "pii-any"), ["term"], "rows", words.count()).join(places, ["node", "passage"])
    joint = pairs.groupBy("entity", "term", "n_any").agg(F.countDistinct("unit").alias("n_te")).where(F.col("n_te") >= SUPPORT).join(own, "entity")
    n = per_key.count() - family.agg(F.count(F.lit(1)) - F.countDistinct("unit")).first()[0]
    most = F.col("n_te") * F.pow(F.lit(float(n)) / F.col("n_e"), F.lit(1 - GENERALISE))
    joint = stored(joint.where(F.col("n_any") <= most), "pii-joint")
    terms = stored(joint.select("term").distinct(), "pii-terms")
    if terms.isEmpty():
        return None
    others = text_counts(docs, terms, per_key.where("copies > 1"), held)
    counts = terms.join(others, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n_others"))
    joint = joint.join(counts, "term").withColumn("n_t", F.col("n_any") + F.col("n_others"))
    weighed = joint.withColumn("ic", F.log2(F.lit(float(n)) / F.col("n_e"))).withColumn("pmi", F.log2(F.lit(float(n)) * F.col("n_te") / (F.col("n_t") * F.col("n_e"))))
    told = weighed.where((F.col("ic") > 0) & (F.col("pmi") >= GENERALISE * F.col("ic"))).select("entity", "term", F.when(F.col("pmi") >= REMOVE * F.col("ic"), "removed").otherwise("term").alias("kind"))
    # A term that several entities of a text call for is removed if any of them calls for that.
    worst = seen.select("_key", "entity").distinct().join(told, "entity").groupBy("_key", "term").agg(F.min("kind").alias("kind"))
    return stored(worst, "pii-disclosing"), texts


def term_spans(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(_key, extra): spans of the words that `terms` (_key, term, kind) names, outside the base spans, in order."""
    marked = texts.join(terms.select("_key").distinct(), "_key", "left_semi")
    words = marked.select("_key", F.explode(spans("term", WORD, "true", "true", "_text")).alias("w")).select("_key", "w", F.lower("w.v").alias("term"))
    hits = stored(words.join(terms, ["_key", "term"]).select("_key", F.col("w.s").alias("s"), F.col("w.e").alias("e"), F.col("w.v").alias("v"), "kind"), "pii-hits")
    # A word that meets a base span: both are looked up by the stretches of 64 characters that they touch.
    touch = lambda s, e: F.explode(F.sequence(F.expr(f"{s} DIV 64"), F.expr(f"({e} - 1) DIV 64"))).alias("at")
    base = marked.select("_key", F.explode("_base").alias("b")).select("_key", F.col("b.s").alias("bs"), F.col("b.e").alias("be"), touch("b.s", "b.e"))
    inside = hits.select("_key", "s", "e", touch("s", "e")).join(base, ["_key", "at"]).where("bs < e AND s < be").select("_key", "s", "e").distinct()
    span = F.struct("s", "e", F.col("kind").alias("k"), "v")
    free = hits.join(inside, ["_key", "s", "e"], "left_anti").groupBy("_key").agg(F.sort_array(F.collect_list(span)).alias("x"))
    return free.select("_key", F.transform("x", lambda y: F.struct(y["k"].alias("k"), y["s"].alias("s"), y["e"].alias("e"), y["v"].alias("v"))).alias("extra"))


def analyse(rows: DataFrame, docs: DataFrame) -> tuple[DataFrame, bool]:
    """(_key, copies, extra) for each distinct text with base spans; extra is null where no term is disclosing. And
    whether any is. rows: (_key, _base); docs: (_key, _text), both of all rows."""
    some = rows.where(F.size("_base") > 0)
    once = stored(some.groupBy("_key").agg(F.first("_base").alias("_base"), F.count(F.lit(1)).alias("copies")), "pii-once")
    per_key = stored(rows.groupBy("_key").agg(F.count(F.lit(1)).alias("copies")), "pii-texts")
    found = disclosing_terms(once, per_key, docs)
    if found is None or found[0].isEmpty():
        return once.select("_key", "copies", F.lit(None).cast(f"array<{SPAN}>").alias("extra")), False
    extra = term_spans(found[1].join(once.select("_key", "_base"), "_key"), found[0])
    return stored(once.select("_key", "copies").join(extra, "_key", "left"), "pii-extra"), True


def with_extra(rows: DataFrame, extra: DataFrame, any_: bool) -> DataFrame:
    """Rows (.., _key, _base) with their text's extra spans (null for none). Rows without base spans meet nothing."""
    if not any_:
        return rows.withColumn("extra", F.lit(None).cast(f"array<{SPAN}>"))
    told = extra.where("extra IS NOT NULL").select("_key", "extra")
    if fits(told, F.lit(64) + F.expr("aggregate(extra, 0L, (a, x) -> a + 64 + octet_length(x.v))")):
        return rows.join(F.broadcast(told), "_key", "left")
    none = rows.where(F.size("_base") == 0).withColumn("extra", F.lit(None).cast(f"array<{SPAN}>"))
    some = skewed_join(rows.where(F.size("_base") > 0), extra, ["_key"], "copies", extra.agg(F.sum("copies")).first()[0])
    return some.drop("copies").unionByName(none)


def joined(*arrays: str) -> Column:
    return F.concat_ws(",", *[F.transform(a, lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))) for a in arrays])


def replaced(text: str, ordered: str) -> Column:
    """The text with each union of overlapping spans (sorted) replaced by the mark of the first.

    It is cut in UTF-32, where a place is found without reading up to it, and each piece is read back with a byte order
    mark of its own, so that one in the text isn't taken for it."""
    mark = "CASE x.k " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MARKS.items()) + " END"
    cut = lambda a, b: f"decode(concat(X'0000FEFF', substring(u, 4 * {a} + 1, 4 * ({b} - {a}))), 'UTF-32')"
    piece = "named_struct('f', a.p, 's', x.s, 'k', x.k)"
    step = f"named_struct('p', greatest(a.p, x.e), 'o', IF(x.s >= a.p, concat(a.o, array({piece})), a.o))"
    pieces = scan(ordered, "0", "greatest(a.p, array_max(transform(z, x -> x.e)))", step, "CAST(array() AS array<struct<f:int,s:int,k:string>>)")
    ends = f"array_max(transform({ordered}, x -> x.e))"
    parts = f"transform({pieces}, x -> concat({cut('x.f', 'x.s')}, {mark}))"
    return F.expr(let("u", f"encode({text}, 'UTF-32')", f"concat(array_join({parts}, ''), {let('t', ends, cut('t', 'length(' + text + ')'))})"))


def sanitise(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with spans in `text` replaced by marks; all other columns stay."""
    names = {c: "`" + c.replace("`", "``") + "`" for c in docs.columns if c != "text"}
    row = F.struct(F.lit(None).cast("string").alias("text"), *[F.col(q).alias(c) for c, q in names.items()]).alias("row")
    ids = stored(with_base(keyed(docs)).select("_key", "_base"), "pii-base")
    extra, any_ = analyse(ids, keyed(docs))
    rows = with_extra(with_base(keyed(docs, row, F.col("text").isNull().alias("null"))), extra, any_)
    order = "(x, y) -> CASE WHEN x.s <> y.s THEN x.s - y.s ELSE y.e - x.e END"
    rows = rows.withColumn("all", F.expr(f"array_sort(concat(_base, coalesce(extra, {NONE})), {order})"))
    text = F.when(F.col("null"), F.lit(None)).when(F.size("all") > 0, replaced("_text", "`all`")).otherwise(F.col("_text"))
    return rows.select(*[text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = stored(with_base(keyed(docs, "doc_id")).select("doc_id", "_key", "_base"), "pii-base")
    extra, any_ = analyse(ids, keyed(docs))
    both = with_extra(ids, extra, any_)
    count = lambda kind: F.size(F.filter("_base", lambda x: x["k"] == kind)).cast("long").alias(f"n_{kind}")
    more = F.expr(f"coalesce(concat(filter(extra, x -> x.k = 'term'), filter(extra, x -> x.k = 'removed')), {NONE})")
    return both.withColumn("more", more).select("doc_id", *map(count, KINDS), F.sha2(joined("_base"), 256).alias("base_sha256"), joined("_base", "more").alias("spans"))
