"""Best-fit packing of whole documents into sequences: large-item matching, then best fit into what is left.

A piece is a document's ids with its end mark; only documents beyond the capacity are cut, into full pieces and a rest.
Full pieces are sequences of their own. Pieces above a third of the capacity are matched greedily, the largest first with
the largest that fits beside it: no more than two fit, so a sequence gets at most two of them. Smaller pieces, the
largest first, go to the fullest sequence that has room.

The order of pieces of one length makes no difference to the number of sequences, so the plan needs only how many there
are of each length: a run of equal pieces is placed into a run of sequences with equal gaps at once, with the very
result of one piece at a time. The driver holds at most one count for each length up to the capacity and runs of
sequences: each length splits at most two, so their number is bounded by the capacity, whatever the input. A piece finds
its place by its rank among those of its length; a length that very many pieces share is ranked in parts.

Tokens: a text is cut at ASCII white space, which the tokenizer drops and never joins over; a worker keeps the ids of at
most `CACHE` cuts (a bound on memory only), and new cuts are encoded by the library in one call.

Edge cases: a null or empty text is the end mark alone; a document of exactly the capacity is one full piece; repeated
rows are packed separately; null doc_ids are kept; pieces of equal length go by id, piece and checksum, and rows equal in
all of these are alike; an empty table gives an empty result; other columns are ignored. A document is encoded in one task.
"""

from __future__ import annotations

import functools
import re
import struct
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataquery.llm.bpe import byte_chars
from strataquery.llm.common import FEW, HOT, stored

CAPACITY, END_ID = 2048, 0
CACHE, CACHED_CHARS = 700_000, 200
#: Letters whose lower case and composed form are one letter each, whatever stands beside them.
LATIN = "".join(c for c in map(chr, range(0xC0, 0x100)) if c.isalpha())
WORD = re.compile(rf"([A-Za-z{LATIN}]+)([.,;:!?]{{0,4}})")
#: Characters of new cuts that the library encodes in one call.
CALL = 1_000_000


class Tokens:
    """Ids of texts as little-endian 32-bit numbers, by the tokenizers library."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.mark = next((t.content for t in self.model.get_added_tokens_decoder().values() if t.special and not (t.lstrip or t.rstrip or t.single_word)), None)
        self.mark_id = self.model.token_to_id(self.mark) if self.mark else None
        #: Ids of cuts, of words, and of the (at most four) marks that may follow a word.
        self.known: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        stands_for = {b: c for c, b in byte_chars().items()}
        self.stand_in = {ord(c): "".join(stands_for[b] for b in c.encode()) for c in LATIN}

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4")

    def word(self, word: str) -> bytes:
        """A lower-cased word of Latin letters, which the model takes as it is: its bytes, each as the letter that stands for
        it. Nothing else of the library's pipeline changes such a word."""
        ids = [t.id for t in self.model.model.tokenize(word if word.isascii() else word.translate(self.stand_in))]
        found = self.words[word] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def learn(self, cuts: set[str]) -> None:
        """Words with or without punctuation behind them are looked up by the word. The library reads the others, many in
        one text, with a special token between them, at which it cuts by itself."""
        if len(self.words) + len(cuts) > CACHE:
            self.words = {}
        plain, known, words, marks, cut = [], self.known, self.words, self.marks, WORD.fullmatch
        for c in cuts:
            m = cut(c) if len(c) <= CACHED_CHARS else None
            if m:
                word, mark = m.groups()
                word = word.lower()
                if mark not in marks:
                    marks[mark] = self.ids(mark).tobytes()
                known[c] = (words.get(word) or self.word(word)) + marks[mark]
            elif not self.mark or self.mark in c:
                self.known[c] = self.ids(c).tobytes()
            else:
                plain.append(c)
        at = 0
        while at < len(plain):
            size, first = 0, at
            while at < len(plain) and size < CALL:
                size += len(plain[at])
                at += 1
            ids = self.ids(self.mark.join(plain[first:at]))
            start = 0
            for c, end in zip(plain[first:at], [*np.flatnonzero(ids == self.mark_id).tolist(), len(ids)], strict=True):
                self.known[c] = ids[start:end].tobytes()
                start = end + 1

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        cut = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        seen = set().union(*cut)
        new = seen - self.known.keys()
        if len(self.known) + len(new) > CACHE:
            self.known, new = {"": b""}, seen - {""}
        self.learn(new)
        known = self.known
        out = [b"".join(map(known.__getitem__, cuts)) for cuts in cut]
        for c in new:
            if len(c) > CACHED_CHARS:
                del known[c]
        return out


@functools.cache
def tokens(path: str) -> Tokens:
    return Tokens(path)


def cut_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit numbers) of every document's pieces."""
    names = ["doc_id", "piece", "start", "length", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, end = tokens(path), np.array([END_ID], "<u4").tobytes()
        for b in batches:
            for first in range(0, b.num_rows, 256):
                part = b.slice(first, 256)
                rows: list[tuple] = []
                for doc, ids in zip(part.column(0).to_pylist(), model.encode_batch([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    data = ids + end
                    rows += [(doc, k, k * capacity, len(own) // 4, own) for k, own in enumerate(data[i : i + 4 * capacity] for i in range(0, len(data), 4 * capacity))]
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def note(ascending: list[int], value: int) -> None:
    """Adds a value to an ascending list that lacks it."""
    i = bisect_left(ascending, value)
    if i == len(ascending) or ascending[i] != value:
        ascending.insert(i, value)


def packing_plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, first sequence, pieces of this run in each sequence, offset), by length and rank, and the
    number of sequences. Piece number r of a run goes to sequence first + r // each, at offset + (r % each) * length."""
    plan, used = [], dict.fromkeys(counts, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs of sequences (first, how many)
    sequences = 0

    def place(length: int, first: int, n: int, each: int, gap: int, many: int) -> None:
        plan.append((length, used[length], first, each, capacity - gap))
        used[length] += many
        gaps.setdefault(gap - each * length, []).append((first, n))

    def fresh(length: int, n: int, each: int) -> int:
        nonlocal sequences
        first, sequences = sequences, sequences + n
        place(length, first, n, each, capacity, n * each)
        return first

    left = dict(counts)
    large = sorted((x for x in counts if 3 * x > capacity), reverse=True)
    # The largest piece with the largest that fits beside it, run by run.
    for a in large:
        for b in large:
            if not left[a]:
                break
            if a + b > capacity or b > a or not left[b]:
                continue
            if a == b:
                if left[a] > 1:
                    fresh(a, left[a] // 2, 2)
                left[a] %= 2
            else:
                n = min(left[a], left[b])
                first = fresh(a, n, 1)
                gaps[capacity - a].pop()
                place(b, first, n, 1, capacity - a, n)
                left[a] -= n
                left[b] -= n
        if left[a]:
            fresh(a, left[a], 1)
            left[a] = 0
    # The rest, the largest first, into the fullest sequences with room: one with a gap takes as many as fit in turn.
    open_gaps = sorted(g for g in gaps if gaps[g])
    for x in sorted((x for x in counts if 3 * x <= capacity), reverse=True):
        while left[x]:
            i = bisect_left(open_gaps, x)
            if i == len(open_gaps):
                gap, first, n = capacity, sequences, -(-left[x] // (capacity // x))
                sequences += n
            else:
                gap = open_gaps[i]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del open_gaps[i]
            each = gap // x
            whole = min(n, left[x] // each)
            some = left[x] - whole * each if whole < n else 0
            for start, many, per in ((first, whole, each), (first + whole, min(some, 1), some)):
                if many:
                    place(x, start, many, per, gap, many * per)
                    left[x] -= many * per
                    note(open_gaps, gap - per * x)
            if n > whole + min(some, 1):
                gaps[gap].append((first + whole + min(some, 1), n - whole - min(some, 1)))
                note(open_gaps, gap)
    return sorted(plan), sequences


def rank_in_length(rows: DataFrame, counts: dict[int, int], order: list[str]) -> DataFrame:
    """Adds `rank` (from 0) among the rows of one length. Lengths of very many rows are cut by hash into parts that are
    ranked apart; the parts' offsets are fewer than 2 x HOT rows, by the counts."""
    limit = max(FEW, sum(counts.values()) // HOT)
    parts = {x: -(-n // limit) for x, n in counts.items() if n > limit}
    if not parts:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("length").orderBy(*order)) - 1)
    of = F.element_at(F.create_map(*[F.lit(v) for kv in parts.items() for v in kv]), F.col("length"))
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(*order), F.coalesce(of, F.lit(1))))
    held = dealt.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("length", "_part").orderBy(*order)) - 1
    ranked = dealt.withColumn("_rank", inside).join(F.broadcast(offsets), ["length", "_part"])
    return ranked.select(*rows.columns, (F.col("_rank") + F.col("_offset")).alias("rank"))


def pack_pieces(pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces (length, from 1 to capacity, and other columns). Pieces of one
    length are ranked by `order`; rows equal in it should be equal in all columns. The table is read twice: store it."""
    full = F.monotonically_increasing_id()
    alone = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - full, "offset": F.lit(0).cast("long")})
    rest = pieces.where(F.col("length") < capacity)
    counts = {r["length"]: r["n"] for r in rest.groupBy("length").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    plan, _ = packing_plan(counts, capacity)
    kinds, ranks, firsts, each, offsets = (np.array([r[i] for r in plan], np.int64) for i in range(5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin = np.searchsorted(kinds, np.arange(capacity + 1))
        span = int(ranks.max(initial=0)) + 1
        exact = span < 2**62 // (capacity + 1)
        keys = kinds * span + ranks if exact else None
        for b in batches:
            length, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            if exact:
                at = np.searchsorted(keys, length * span + np.minimum(rank, span - 1), "right") - 1
            else:
                at = np.array([begin[x] + np.searchsorted(ranks[begin[x] : begin[x + 1]], r, "right") - 1 for x, r in zip(length, rank, strict=True)], np.int64)
            inside = rank - ranks[at]
            own = [c for n, c in zip(b.schema.names, b.columns, strict=True) if n != "rank"]
            yield pa.RecordBatch.from_arrays([*own, pa.array(firsts[at] + inside // each[at]), pa.array(offsets[at] + inside % each[at] * length)], [n for n in b.schema.names if n != "rank"] + ["sequence_id", "offset"])

    ranked = rank_in_length(rest, counts, order).withColumn("rank", F.col("rank").cast("long"))
    return alone.unionByName(ranked.mapInArrow(run, alone.schema))


def op12_bestfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = cut_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), str(public_tokenizers.path("word_bpe_49k.json")))
    rows = stored(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32")), "bestfit")
    return pack_pieces(rows, ["doc_id", "piece", "ids_crc32"])
