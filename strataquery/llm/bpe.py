"""BPE encoding by prefix-sharing trie traversal, and decoding.

For a BPE vocabulary every prefix of a word has one last token: the token t, ending there, that is compatible with the
last token of the prefix before t (the two, merged from their bytes, give back exactly these two). Distinct words of a batch
are put into a trie; a depth-first walk hands each node's last-token states down, so a prefix that many words share is
encoded once, and any word's encoding is read off by following last tokens back. The work is linear in the trie's size
times the longest token, also for a word of a million characters.

Words are what the byte-level pre-tokenizer cuts; added tokens of the vocabulary file (`<|endoftext|>`) inside a text
are their own ids, as in the tokenizers library. The vocabulary's path is a parameter.

Edge cases: null and empty texts have no tokens and decode to the empty text; repeated rows are encoded alike; ids are
not read; other columns are ignored. A worker keeps the encodings of at most `CACHE` words (a bound on memory only: a
word not kept is encoded again).
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

#: Fixed values of byte-level BPE: the pre-tokenizer's pattern (white space as Unicode's White_Space property).
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
CACHE = 400_000


def byte_chars() -> dict[str, int]:
    """The byte that each printable stand-in of byte-level BPE means."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = byte_chars()
        raw = lambda s: bytes(chars[c] for c in s)
        self.ids = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        self.bytes = {i: s for s, i in self.ids.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.ranks = {(raw(a), raw(b)): r for r, (a, b) in enumerate(pairs)}
        self.halves = {a + b: (a, b, r) for (a, b), r in sorted(self.ranks.items(), key=lambda x: -x[1])}  # the first merge that makes a token
        #: What words may end in: every suffix of a token, with its id where it is one.
        self.ends = dict.fromkeys((s[i:] for s in self.ids for i in range(len(s))), -1) | self.ids
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes |= {i: s.encode() for s, i in self.added.items()}
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.words = regex.compile(WORDS)
        self.fits: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.known: dict[str, tuple[int, bytes, bytes]] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """Plain BPE of a short byte string: the lowest-ranked pair first, leftmost of equals."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def edge(self, token: bytes, side: int) -> list[tuple[bytes, float]]:
        """The pieces that lie at one end of a token (0 left, 1 right) while it is merged, each with the rank at which
        the next merge takes it up."""
        out, until = [], float("inf")
        while True:
            out.append((token, until))
            if token not in self.halves:
                return out
            until = self.halves[token][2]
            token = self.halves[token][side]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of two tokens gives back exactly these two: no merge over their border comes before
        the merges within them take its pieces up (of equal ranks the one further left comes first)."""
        found = self.fits.get((left, right))
        if found is None:
            if len(self.fits) > 4_000_000:
                self.fits.clear()
            ranks = self.ranks
            for a, until_a in self.edge_of(left, 1):
                for b, until_b in self.edge_of(right, 0):
                    r = ranks.get((a, b))
                    if r is not None and r < until_a and r <= until_b:
                        self.fits[left, right] = False
                        return False
            found = self.fits[left, right] = True
        return found

    def edge_of(self, token: int, side: int) -> list[tuple[bytes, float]]:
        found = self.edges[side].get(token)
        if found is None:
            found = self.edges[side][token] = self.edge(self.bytes[token], side)
        return found

    def reachable(self, token: int) -> bool:
        """Whether the token's own bytes encode to it alone."""
        found = self.whole.get(token)
        if found is None:
            found = self.whole[token] = self.merged(self.bytes[token]) == [self.bytes[token]]
        return found

    def encode_words(self, words: set[bytes]) -> dict[bytes, list[int]]:
        """Depth-first over the trie of distinct words: sorted order visits it so, and the stack of last tokens is cut
        back to the prefix that a word shares with the one before."""
        ends, fits, out = self.ends, self.fits, {}
        last: list[int] = []  # last[i]: last token of the current path's first i + 1 bytes
        path = b""
        for word in sorted(words):
            same, most = 0, min(len(word), len(path))
            while same < most and word[same] == path[same]:
                same += 1
            del last[same:]
            for end in range(same + 1, len(word) + 1):
                tokens, start = [], end - 1
                while start >= 0 and (token := ends.get(word[start:end])) is not None:
                    if token >= 0:
                        tokens.append((start, token))
                    start -= 1
                for start, token in reversed(tokens):
                    if start:
                        fit = fits.get((last[start - 1], token))
                        if fit is None:
                            fit = self.compatible(last[start - 1], token)
                    else:
                        fit = self.reachable(token)
                    if fit:
                        last.append(token)
                        break
                else:
                    raise ValueError(f"the vocabulary has no token for byte {word[end - 1]}")
            path = word
            tokens, end = [], len(word)
            while end:
                tokens.append(last[end - 1])
                end -= len(self.bytes[last[end - 1]])
            out[word] = tokens[::-1]
        return out

    def learn(self, words: set[str]) -> None:
        """Keeps, for each word, its number of tokens, its decimal ids joined by commas and its decoded bytes."""
        new = words - self.known.keys()
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = words
        encoded = self.encode_words({w.encode("utf-8") for w in new})
        for w in new:
            ids = encoded[w.encode("utf-8")]
            self.known[w] = (len(ids), ",".join(map(str, ids)).encode(), b"".join(self.bytes[i] for i in ids))

    def pieces(self, text: str) -> list[str]:
        """A text's words in order; added tokens stand as they are."""
        if not self.split or not any(a in text for a in self.added):
            return self.words.findall(text)
        out, at = [], 0
        for m in self.split.finditer(text):
            out += self.words.findall(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self.words.findall(text[at:])

    def encode_batch(self, texts: list[str]) -> list[list[tuple[int, bytes, bytes]]]:
        """For each text, its words' (number of tokens, decimal ids, decoded bytes)."""
        cut = [self.pieces(t) for t in texts]
        added = {a: (1, str(i).encode(), a.encode()) for a, i in self.added.items()}
        self.learn({w for words in cut for w in words} - added.keys())
        known = self.known
        if any(a in t for a in added for t in texts):
            known = self.known | added
        return [[known[w] for w in words] for words in cut]

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self.encode_batch([text])[0] for i in ids.split(b",")]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes[i] for i in ids).decode("utf-8", "replace")


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


#: Characters of text whose words are put into one trie.
BLOCK = 4_000_000


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
        ids, texts, size = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t or "")
                size += len(texts[-1])
                if size > BLOCK:
                    yield ids, texts
                    ids, texts, size = [], [], 0
        if ids:
            yield ids, texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for ids, texts in blocks(batches):
            n, a, d = [], [], []
            for words in enc.encode_batch(texts):
                n.append(sum([w[0] for w in words]))
                a.append(hashlib.sha256(b",".join([w[1] for w in words])).hexdigest())
                d.append(hashlib.sha256(b"".join([w[2] for w in words]).decode("utf-8", "replace").encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(a), pa.array(d)], names)

    return docs.select(docs.doc_id.cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_and_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), str(public_tokenizers.path("byte_bpe_50k.json")))
