"""Language identification by rank-order n-gram profiles (Cavnar and Trenkle, 1994).

A profile is the list of the most frequent 1- to 3-grams of letters, words padded with one blank. A document's own
profile is compared with each language's by out-of-place distance: the sum, over the document's n-grams, of the
differences in rank, or of the profile's length for n-grams that the language's profile lacks. The nearest language is
predicted; the score is 1 less the distance's share of the largest possible one.

Profiles are learned from all labelled rows of all labels: n-grams are counted where the texts lie, the counts are summed
by a shuffle and only the profiles (at most `size` n-grams for each language) reach the driver. Prediction reads the text
alone and the whole of it, in blocks. `acceptance` tells the score from which a text may pass for one of the languages: a
fixed share of what nearly all labelled texts reach, by all of their scores.

Edge cases: null texts and texts without a letter are `und` with score 0; a text none of whose n-grams stands in any
profile scores 0 and gets the first language in alphabetical order, as do ties; with nothing to learn from, all are `und`;
repeated rows get equal results; very long texts are counted block by block; an empty table gives an empty result;
columns named lang_pred and score are replaced, other columns stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataquery.llm.common import stored

SIZE, BLOCK = 400, 1 << 20
#: The labelled rows of a language that profiles are learned from: all.
SAMPLE = math.inf
#: n-grams with counts that a task holds before it merges and sends them; cells of a histogram of scores.
HELD, CELLS = 1 << 20, 4096
#: The share of labelled texts that may score less than the level, and the share of that level that is asked for.
BELOW, ASKED = 0.01, 0.5


def letter_codes(text: str) -> np.ndarray:
    """Code points plus 1 of the lower-cased text's letters, runs of anything else as one 1 (a blank), one at either end.

    A blank is not 0, so that n-grams of different lengths never look alike."""
    low = text.lower()
    codes = np.frombuffer(low.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    kinds, where = np.unique(codes, return_inverse=True) if len(codes) > 4096 else (None, None)
    if kinds is None:
        letter = np.fromiter((c.isalpha() for c in low), bool, len(codes))
    else:
        letter = np.fromiter((chr(k).isalpha() for k in kinds), bool, len(kinds))[where]
    codes = np.concatenate(([1], np.where(letter, codes + 1, 1), [1]))
    return codes[np.concatenate(([True], (codes[1:] != 1) | (codes[:-1] != 1)))]


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 1- to 3-grams (21 bits a code point) in ascending order, and their counts."""
    codes = letter_codes(text)
    kinds, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(codes) < 3:
        return kinds, counts
    for at in range(0, len(codes), BLOCK):
        c = codes[at : at + BLOCK + 2]
        single, pair = c[:BLOCK], (c[:-1] << 21 | c[1:])[:BLOCK]
        one, two, three = (c[i : len(c) - 2 + i][:BLOCK] for i in range(3))
        k, n = np.unique(np.concatenate((single[single != 1], pair, (one << 42 | two << 21 | three)[two != 1])), return_counts=True)
        if at:
            merged, where = np.unique(np.concatenate((kinds, k)), return_inverse=True)
            counts = np.bincount(where, np.concatenate((counts, n)), len(merged)).astype(np.int64)
            kinds = merged
        else:
            kinds, counts = k, n
    return kinds, counts


def ranked(kinds: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The `size` most frequent n-grams, ties in ascending order."""
    return kinds[np.argsort(-counts, kind="stable")[:size]]


def learn_profiles(docs: DataFrame, size: int = SIZE) -> dict[str, np.ndarray]:
    """Profiles of the languages of labelled rows (text, lang)."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, list] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, found in own.items():
                kinds, where = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
                counts = np.bincount(where, np.concatenate([c for _, c in found]), len(kinds)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(kinds), pa.string()), pa.array(kinds), pa.array(counts)], ["lang", "gram", "n"])

        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = ngram_counts(text)
                own.setdefault(lang, []).append(found)
                held += len(found[0])
                if held > HELD:
                    yield from flush()
                    own, held = {}, 0
        yield from flush()

    summed = known.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = summed.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= size)
    told = best.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "gram")))["gram"].alias("grams")).toArrow()
    return {k: v.values.to_numpy() for k, v in sorted(zip(told["lang"].to_pylist(), told["grams"], strict=True))}


class Classifier:
    """Profiles by n-gram: that at `grams[i]` stands in languages `lang[starts[i] : starts[i + 1]]`, at these ranks."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int) -> None:
        self.langs, self.size = sorted(profiles), size
        own = [profiles[k] for k in self.langs]
        grams = np.concatenate([*own, np.zeros(0, np.int64)])
        order = np.argsort(grams, kind="stable")
        self.grams, starts = np.unique(grams[order], return_index=True)
        self.starts = np.append(starts, len(grams))
        self.lang = np.repeat(np.arange(len(own)), [len(x) for x in own])[order]
        self.rank = np.concatenate([*map(np.arange, map(len, own)), np.zeros(0, np.int64)])[order].astype(np.int64)

    def predict(self, text: str | None) -> tuple[str, float]:
        kinds, counts = ngram_counts(text) if text else (np.zeros(0, np.int64), None)
        if not len(kinds) or not self.langs:
            return "und", 0.0
        own = ranked(kinds, counts, self.size)
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        rank = np.flatnonzero(self.grams[at] == own)
        at = at[rank]
        many = self.starts[at + 1] - self.starts[at]
        theirs = np.repeat(self.starts[at] - np.cumsum(many) + many, many) + np.arange(many.sum())
        near = np.maximum(self.size - np.abs(self.rank[theirs] - np.repeat(rank, many)), 0)
        apart = self.size * len(own) - np.bincount(self.lang[theirs], near, len(self.langs))
        best = int(np.argmin(apart))
        return self.langs[best], 1.0 - float(apart[best]) / (self.size * len(own))


def predict_languages(docs: DataFrame, profiles: dict[str, np.ndarray], size: int = SIZE) -> DataFrame:
    """All columns of `docs` but those named lang_pred and score, then lang_pred and score."""
    kept = docs.drop("lang_pred", "score")
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(profiles, size)
        for b in batches:
            found = [model.predict(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], [*b.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(run, schema)


def least_reached(scores: DataFrame, share: float) -> float | None:
    """The exact quantile of a stored column `score` without nulls: the least score that at least `share` of the rows don't
    exceed. A histogram between the least and the largest score left names the cell that holds it, until that cell is one
    score; the driver gets at most `CELLS` rows each time, whatever the input."""
    n, low, high = scores.agg(F.count(F.lit(1)), F.min("score"), F.max("score")).first()
    left = max(1, math.ceil(share * n))
    while n and low < high:
        part = scores.where(F.col("score").between(low, high))
        cell = F.least(F.floor((F.col("score") - low) / (high - low) * CELLS), F.lit(CELLS - 1)).alias("cell")
        for r in sorted(part.groupBy(cell).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).collect()):
            if left <= r["n"]:
                low, high = r["low"], r["high"]
                break
            left -= r["n"]
    return low


def acceptance(docs: DataFrame, profiles: dict[str, np.ndarray]) -> float:
    """`ASKED` of the score that all but `BELOW` of labelled rows (text, lang) reach; 0 where none are labelled. Texts of
    no learned language lie far below: random letters, codes and other scripts reach about 0.1 to 0.3, sentences of a
    language 0.5 or more."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("text")
    scores = predict_languages(known, profiles).where("lang_pred <> 'und'").select("score")
    level = least_reached(stored(scores, "langid-scores"), BELOW)
    return ASKED * level if level is not None else 0.0


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = learn_profiles(docs.where(~held_out()))
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return predict_languages(rows, profiles).select("doc_id", "held_out", "lang_pred", "score")
