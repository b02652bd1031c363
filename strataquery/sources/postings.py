"""A stored inverted index: postings (token, path, lines, file_terms) and terms (token, df), as Parquet in runs sorted by token
and path, so a question about some terms reads the pages that hold them and nothing of the texts.

A task sorts the postings of its own files and writes them, run after run: postings are never shuffled and written once,
and a token that very many files hold is spread over the files of the index as its texts are. file_terms counts the
distinct terms of the posting's file, for scores that need its length."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquery.functions.text import TOKEN

#: Bytes of a row group: small, for one holds the postings of some hundred thousand files of a token, or of many rare ones.
ROW_GROUP = 4 << 20


POSTING = "token string, path string, lines array<int>, file_terms int"
#: Tokens whose parts a task keeps, postings of one batch, and bytes of Arrow memory that a task sorts at once.
KEPT, BATCH, RUN = 500_000, 50_000, 96 << 20


def token_terms(token: str) -> tuple[str, ...]:
    """What `identifier_terms` gives for a token."""
    parts = re.findall("[A-Z]?[a-z]+|[A-Z]+|[0-9]+", re.sub("([A-Z])([A-Z][a-z])", r"\1_\2", token))
    return tuple(dict.fromkeys([token.lower(), *(p.lower() for p in parts if len(p) >= 2)]))


def file_postings(text: str, find: Callable[[str], list[str]], known: dict[str, tuple[str, ...]]) -> dict[str, list[int]]:
    """A file's terms, each with its lines in order."""
    out: dict[str, list[int]] = {}
    for line, content in enumerate(text.split("\n"), 1):
        for token in set(find(content)):
            if token not in known:
                if len(known) >= KEPT:
                    known.clear()
                known[token] = token_terms(token)
            for term in known[token]:
                lines = out.setdefault(term, [])
                if not lines or lines[-1] != line:
                    lines.append(line)
    return out


def in_order(run: pa.Table) -> pa.Table:
    """A run by token and path. Both repeat, so their distinct values are ranked and the ranks compared."""

    def ranks(name: str) -> np.ndarray:
        coded = run[name].combine_chunks().dictionary_encode()
        place = np.empty(len(coded.dictionary), np.int64)
        place[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(place))
        return place[coded.indices.to_numpy()]

    return run.take(pa.array(np.argsort((ranks("token") << 32) | ranks("path"), kind="stable")))


def postings_rows(files: DataFrame, run_bytes: int = RUN) -> DataFrame:
    """token, path, lines (ascending), file_terms out of files (path, text), in runs by token and path: a file is cut once,
    in one pass of its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, known = re.compile(TOKEN).findall, {}
        held: tuple[list, list, list, list] = ([], [], [], [])
        kinds = (pa.string(), pa.string(), pa.list_(pa.int32()), pa.int32())
        made: list[pa.RecordBatch] = []

        def move() -> None:
            made.append(pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(held, kinds, strict=True)], ["token", "path", "lines", "file_terms"]))
            for c in held:
                c.clear()

        def out() -> Iterator[pa.RecordBatch]:
            if any(b.num_rows for b in made):
                yield from in_order(pa.Table.from_batches(made).combine_chunks()).to_batches(max_chunksize=BATCH)
            made.clear()

        for b in batches:
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                terms = file_postings(text or "", find, known)
                for column, values in zip(held, (terms.keys(), [path] * len(terms), terms.values(), [len(terms)] * len(terms)), strict=True):
                    column.extend(values)
                if len(held[0]) >= BATCH:
                    move()
                    if sum(x.nbytes for x in made) >= run_bytes:
                        yield from out()
        move()
        yield from out()

    return files.select("path", "text").mapInArrow(run, POSTING)


class Postings:
    """An index at a path. Tokens are lower-cased identifiers and their parts."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    @classmethod
    def write(cls, files: DataFrame, path: str, row_group: int = ROW_GROUP) -> Postings:
        cores = files.sparkSession.sparkContext.defaultParallelism
        spread = files if files.rdd.getNumPartitions() >= cores else files.repartition(cores, "path")
        postings_rows(spread).write.option("parquet.block.size", row_group).option("parquet.page.row.count.limit", 10_000).parquet(f"{path}/postings")
        index = cls(files.sparkSession, path)
        df = index.rows().groupBy("token").agg(F.count(F.lit(1)).alias("df"))
        df.repartitionByRange("token").sortWithinPartitions("token").write.option("parquet.block.size", row_group).parquet(f"{path}/terms")
        return index

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    def terms(self) -> DataFrame:
        """token, df of all terms."""
        return self.spark.read.parquet(f"{self.path}/terms")

    def of(self, tokens: list[str]) -> DataFrame:
        """The postings of some tokens. Each is an equality of its own in the filter that the reader gets: a list of more
        than a few would reach it as one range from the least to the greatest."""
        return self.rows().where(one_of("token", [t.lower() for t in tokens]))

    def lines_of(self, tokens: list[str]) -> DataFrame:
        """token, path, line."""
        return self.of(tokens).select("token", "path", F.explode("lines").alias("line"))

    def frequencies(self, tokens: list[str]) -> DataFrame:
        """token, df of some tokens; those that no file holds are left out."""
        return self.terms().where(one_of("token", [t.lower() for t in tokens]))

    def files_with(self, literal: str) -> DataFrame | None:
        """Paths of files that may hold a literal, whatever the case: those that hold all of its identifiers, whole inside of
        the literal and as an end or a beginning at its edges. None where it has no identifier to ask for."""
        low = literal.lower()
        found = None
        for m in re.finditer(TOKEN, low):
            start = re.search(r"[A-Za-z0-9_]*$", low[: m.start()])
            open_left, open_right = start.start() == 0, m.end() == len(low)
            if open_left and open_right:
                hit = F.contains("token", F.lit(m[0]))
            elif open_left:
                hit = F.col("token").endswith(m[0])
            elif open_right:
                hit = F.col("token").startswith(m[0])
            else:
                hit = F.col("token") == m[0]
            paths = self.rows().where(hit).select("path").distinct()
            found = paths if found is None else found.join(paths, "path", "left_semi")
        return found


def one_of(column: str, values: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(column) == v for v in sorted(set(values))], F.lit(False))
