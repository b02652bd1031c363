"""Source divergence audit by sort-based streaming.

How far each source's use of words stands from the other sources of its language. A task counts terms of whole texts into
(lang, term, source, block, documents, occurrences) rows, one for each term and source of a block of documents; these are
dealt by (lang, term, source), secondary-sorted with the block, and a run-length scan adds them up. What is left, one
row for each term and source, is dealt and sorted once more by (lang, term, source): a second scan sees all sources of a
term in one run, yields its document frequency and count, drops rare terms and emits the run's rows. From these come the
terms that a source overuses, and partial sums of distances between sources, again by a sorted stream of runs: sources
of a language are cut into blocks, and each pair of blocks adds up its distances in one small matrix.

A term's share in a group is p = 1 + floor(1e9 * (count + 5) / (N + 5 V)), N the group's occurrences of kept terms, V the
number of terms that the language keeps (in at least `MIN_DOCS` of its documents). Distance: the sum of abs(p - p') over
all kept terms. All arithmetic is in integers.

Scale: a term and source has one row for each block of documents, so a word of all documents is no hot key; a
term's run holds one row for each source of the language, and block pairs hold `BLOCK` squared sums. The result has the
square of the number of sources, which is what is asked for. Broadcasts: none of ours.

Edge cases: null texts, langs and sources are the empty string; each row is a document, also where ids repeat; groups
without terms take part (count 0 for each term); a language that keeps no term has distances 0 and no term rows; ties
in value go by item; texts of any length are cut as a whole; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataquery.llm.common import Stored

MIN_DOCS, SMOOTH, SCALE = 30, 5, 1_000_000_000
#: Terms and sources that a task holds before it hands them on (a quarter more at most, but for those of one text); sources
#: of a block.
HELD, BLOCK = 1_000_000, 256
#: Runs of letters and of anything beyond ASCII, in UTF-8.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
COUNTED = "lang string, term string, source string, block long, docs long, n long"


def count_terms(docs: DataFrame) -> DataFrame:
    """Documents and occurrences of each (lang, term, source) in each block of documents."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        block = since = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (docs, n) in held.items():
                terms = pa.array(list(n), pa.binary()).cast(pa.string())
                same = [pa.repeat(pa.scalar(v), len(terms)) for v in (lang, source, block)]
                counts = [pa.array([docs[t] for t in n], pa.int64()), pa.array(list(n.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays([same[0], terms, same[1], same[2], *counts], ["lang", "term", "source", "block", "docs", "n"])
            held.clear()

        for b in batches:
            for data, lang, source in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                words = TERM.findall(data.lower())
                if words:
                    docs, n = held.setdefault((lang, source), (Counter(), Counter()))
                    docs.update(set(words))
                    n.update(words)
                    since += len(words)
                if since > HELD // 4:  # so that a batch of long texts is handed on in parts too
                    since = 0
                    if sum(len(n) for _, n in held.values()) > HELD:
                        yield from out()
                        block += 1
        yield from out()

    return docs.select(text("text").cast("binary").alias("text"), text("lang").alias("lang"), text("source").alias("source")).mapInArrow(run, COUNTED)


def _starts(columns: list[pa.Array]) -> np.ndarray:
    """Where a row's key differs from the row's before it, the first row included."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """From batches sorted by keys of any type: rows of whole runs, with the start of each run."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k) for k in keys]
        if held and last != tuple(c[0].as_py() for c in cols):
            whole, held = pa.concat_batches(held), []
            yield whole, _starts([whole.column(k) for k in keys])
        last = tuple(c[len(c) - 1].as_py() for c in cols)
        cut = int(_starts(cols)[-1])
        if cut:
            whole, held = pa.concat_batches([*held, b.slice(0, cut)]), [b.slice(cut)]
            yield whole, _starts([whole.column(k) for k in keys])
        else:
            held.append(b)
    if held:
        whole = pa.concat_batches(held)
        yield whole, _starts([whole.column(k) for k in keys])


def sorted_runs(df: DataFrame, dealt: list[str], *then: str) -> DataFrame:
    return df.repartition(*dealt).sortWithinPartitions(*dealt, *then)


def add_up(counted: DataFrame) -> DataFrame:
    """One row for each (lang, term, source): a run of blocks is added up as it streams by."""
    keys = ["lang", "term", "source"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, starts in whole_runs(batches, keys):
            first = b.select(keys).take(pa.array(starts))
            sums = [pa.array(np.add.reduceat(b.column(c).to_numpy(), starts)) for c in ("docs", "n")]
            yield pa.RecordBatch.from_arrays([*first.columns, *sums], [*keys, "docs", "n"])

    return sorted_runs(counted, keys, "block").mapInArrow(run, "lang string, term string, source string, docs long, n long")


def kept_terms(sums: DataFrame, least: int) -> DataFrame:
    """(lang, term, source, n, total, first) for terms in at least `least` documents of the language: total counts the
    term in the whole language, first marks one row of each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, starts in whole_runs(batches, ["lang", "term"]):
            lengths = np.diff(np.append(starts, b.num_rows))
            docs, total = (np.add.reduceat(b.column(c).to_numpy(), starts) for c in ("docs", "n"))
            keep = np.repeat(docs >= least, lengths)
            first = np.zeros(b.num_rows, bool)
            first[starts] = True
            rows = b.select(["lang", "term", "source", "n"]).filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.repeat(total, lengths)[keep]), pa.array(first[keep])], ["lang", "term", "source", "n", "total", "first"])

    return sorted_runs(sums, ["lang", "term"], "source").mapInArrow(run, "lang string, term string, source string, n long, total long, first boolean")


def share(count: str, total: str) -> F.Column:
    """p, exact: the product is a decimal, for it may pass 64 bits."""
    return F.expr(f"1 + (CAST({count} + {SMOOTH} AS DECIMAL(20, 0)) * {SCALE}BD) div CAST({total} + {SMOOTH} * v AS DECIMAL(20, 0))").cast("long")


def distances(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for all ordered pairs of sources of a language.

    A pair of source blocks gets, for each of its parts, the shares that terms have without an occurrence, then the
    runs of its terms. Terms that no source of either block has count by number: they add the same each time."""
    block = (F.col("idx") / BLOCK).cast("int")
    placed = groups.withColumn("own", block).withColumn("blocks", F.max(block + 1).over(Window.partitionBy("lang")))
    pairs = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("k")).agg(F.sum(F.expr("k * (k + 1) / 2"))).first()[0] or 1
    parts = max(1, int(int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions")) // pairs))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    cols = ["part", "term", "source", "idx", "p", "v"]
    at = lambda df: df.select("lang", "own", other, *cols).select("lang", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", *cols)
    bare = placed.withColumn("p", F.when(F.col("v") > 0, share("0", "n_kept")).otherwise(0)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("term", F.lit(""))
    used = kept.join(placed, ["lang", "source"]).withColumn("p", share("n", "n_kept")).withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int")).withColumn("source", F.lit(None).cast("string"))
    rows = at(bare).unionByName(at(used))
    keys = ["lang", "i", "j", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}

        def out() -> Iterator[pa.RecordBatch]:
            if not state:
                return
            (lang, i, j, part), z, names = state["key"], state["z"], state["names"]
            apart = np.abs(z[i][:, None] - z[j][None, :])
            sums = state["sums"] + ((state["v"] if part == 0 else 0) - state["seen"]) * apart
            a, b = np.nonzero(np.triu(np.ones(sums.shape, bool), 1)) if i == j else np.nonzero(np.ones(sums.shape, bool))
            values = sums[a, b]
            some = np.flatnonzero(values) if part else np.arange(len(values))
            left, right = names[i].take(pa.array(a[some])), names[j].take(pa.array(b[some]))
            for x, y in ((left, right), (right, left)):
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(some)), x, y, pa.array(values[some])], ["lang", "source", "item", "value"])

        def add(b: pa.RecordBatch, starts: np.ndarray) -> None:
            """Adds the distances over whole runs of terms to the sums of the block pair at hand."""
            i, j = state["key"][1:3]
            own, idx, p = (b.column(c).to_numpy() for c in ("own", "idx", "p"))
            run_of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, b.num_rows)))
            state["seen"] += len(starts)
            z = state["z"]
            step = max(1, 4_000_000 // (len(z[i]) + len(z[j])))
            for first in range(0, len(starts), step):
                lo, hi = np.searchsorted(run_of, (first, first + step))
                m = min(step, len(starts) - first)
                dense = {}
                for k in {i, j}:
                    mine = own[lo:hi] == k
                    dense[k] = np.repeat(z[k][None, :], m, axis=0)
                    dense[k][run_of[lo:hi][mine] - first, idx[lo:hi][mine] % BLOCK] = p[lo:hi][mine]
                for a in range(len(z[i])):
                    state["sums"][a] += np.abs(dense[i][:, a, None] - dense[j]).sum(axis=0)

        for b, starts in whole_runs(batches, [*keys, "term"]):
            ends = np.append(starts, b.num_rows)
            heads = _starts([b.column(k) for k in keys])
            for lo, hi in zip(heads, np.append(heads[1:], b.num_rows), strict=True):
                key = tuple(b.column(k)[int(lo)].as_py() for k in keys)
                one = b.slice(int(lo), int(hi - lo))
                if state.get("key") != key:
                    yield from out()
                    plain = pc.sum(pc.equal(one.column("term"), "")).as_py()
                    head, one = one.slice(0, plain), one.slice(plain)
                    own = head.column("own").to_numpy()
                    order = head.column("idx").to_numpy()
                    z, names = {}, {}
                    for k in {key[1], key[2]}:
                        mine = np.flatnonzero(own == k)
                        mine = mine[np.argsort(order[mine])]
                        z[k], names[k] = head.column("p").to_numpy()[mine], head.column("source").take(pa.array(mine))
                    state.update(key=key, z=z, names=names, v=int(head.column("v")[0].as_py()), seen=0, sums=np.zeros((len(z[key[1]]), len(z[key[2]])), np.int64))
                    lo += plain
                if one.num_rows:
                    add(one, starts[(starts >= lo) & (starts < hi)] - lo)
        yield from out()

    # The empty term comes first: each part starts with the blocks' bare shares, one row for each source of either block.
    partial = sorted_runs(rows, keys, "term").mapInArrow(run, "lang string, source string, item string, value long")
    return partial.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, least: int = MIN_DOCS, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank."""
    there = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    kept = Stored(kept_terms(add_up(count_terms(docs)), least), "divergence-terms").df
    by_lang = kept.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("v"), F.sum("n").alias("n_lang"))
    by_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_kept"))
    numbers = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("idx")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    groups = Stored(there.join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left").select("lang", "source", numbers, zero("v"), zero("n_lang"), zero("n_kept")), "divergence-groups").df
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = distances(kept, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    over = kept.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), (share("n", "n_kept") - share("total", "n_lang")).alias("value")).where("value > 0")
    term = over.select("lang", "source", F.lit("term").alias("part"), "item", "value", F.row_number().over(order).alias("rank")).where(F.col("rank") <= top)
    return pair.unionByName(term)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
o AS (SELECT lang, source, doc, unnest(terms) AS term FROM d),
keep AS (SELECT lang, term, count(*) AS total FROM o GROUP BY ALL HAVING count(DISTINCT doc) >= 30),
c AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM o JOIN keep USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n_lang FROM keep GROUP BY lang),
g AS (SELECT lang, source, coalesce((SELECT sum(n) FROM c WHERE c.lang = x.lang AND c.source = x.source), 0)::HUGEINT AS n_kept FROM (SELECT DISTINCT lang, source FROM d) x),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (n_kept + 5 * v) AS p,
    1 + (1000000000::HUGEINT * (k.total + 5)) // (n_lang + 5 * v) AS q
  FROM g JOIN l USING (lang) JOIN keep k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r) WHERE part = 'pair' OR rank <= 50
"""
