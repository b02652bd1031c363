from __future__ import annotations

import bisect
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strataquery.llm import bestfit, divergence, trie
from tests.compare import oracle, rows
from tests.llm import cases

SF = "/root/testdata/sf0.001"
VOCABULARY = str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.parametrize(("query", "sql"), [(divergence.op11_divergence, divergence.OP11_SQL), (trie.op13_trie, trie.OP13_SQL)])
def test_equal_to_sql(spark, query, sql):
    assert rows(query(spark, SF).toPandas()) == rows(oracle(SF).sql(sql).df())


# -- source divergence audit


def brute_divergence(docs: list[tuple], least: int, top: int) -> set[tuple]:
    """docs: text, lang, source."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    df, n, groups = Counter(), Counter(), defaultdict(set)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        df.update((lang, w) for w in set(words))
        n.update((lang, source, w) for w in words)
    out = set()
    for lang, sources in groups.items():
        kept = [w for (k, w), c in df.items() if k == lang and c >= least]
        v = len(kept)
        count = {s: [n[lang, s, w] for w in kept] for s in sources}
        share = lambda c, v=v: [1 + (10**9 * (x + 5)) // (sum(c) + 5 * v) for x in c]
        p = {s: share(c) for s, c in count.items()}
        q = share([sum(x) for x in zip(*count.values(), strict=True)])
        for s in sources:
            apart = [(-sum(abs(a - b) for a, b in zip(p[s], p[o], strict=True)), o.encode()) for o in sources - {s}]
            over = [(b - a, w.encode()) for w, c, a, b in zip(kept, count[s], p[s], q, strict=True) if c and a > b]
            out |= {(lang, s, "pair", o.decode(), -f, r + 1) for r, (f, o) in enumerate(sorted(apart))}
            out |= {(lang, s, "term", w.decode(), -f, r + 1) for r, (f, w) in enumerate(sorted(over)[:top])}
    return out


def audit_rows() -> list[tuple]:
    pick = random.Random(7)
    words = ["the", "The", "straße", "É", "é", "x", "zürich", "don't", "a1b"] + [f"w{chr(97 + i)}" for i in range(20)]
    made = [(" ".join(pick.choices(words, k=pick.randrange(12))), pick.choice(["en", "en", "en", "de", None]), pick.choice(["s0", "s0", "s0", "s1", "s2", "s3", "", None, "ü", "t"])) for _ in range(160)]
    return [*made, (None, "en", "nothing"), ("!!! 12", "fr", "a"), ("", "fr", "b"), ("the " * 30_000, "en", "s1"), ("once", None, "s9"), *[("same", "en", "s0")] * 3]


@pytest.mark.parametrize(("block", "held", "least"), [(256, 1_000_000, 3), (2, 4, 3), (3, 1_000_000, 1000)])
def test_divergence_matches_brute_force(spark, monkeypatch, block, held, least):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "HELD", held)
    docs = audit_rows()
    df = spark.createDataFrame([(*d, 0, 0, "") for d in docs], "text string, lang string, source string, n long, idx int, term string").repartition(3)
    got = [tuple(r) for r in divergence.divergence(df, least, 7).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_divergence(docs, least, 7)


def test_divergence_of_cases_and_nothing(spark):
    want = brute_divergence([(t, lang, s) for _, t, lang, s, _ in cases.rows()], 1, 50)
    assert {tuple(r) for r in divergence.divergence(cases.documents(spark, True), 1).collect()} == want
    assert divergence.divergence(cases.empty(spark)).count() == 0


# -- best-fit packing


def brute_bins(lengths: list[int], capacity: int) -> int:
    """One piece at a time: large ones in pairs, the rest into the fullest bin with room."""
    large, gaps = sorted(x for x in lengths if 3 * x > capacity), []
    while large:
        a = large.pop()
        at = bisect.bisect_right(large, capacity - a) - 1
        gaps.append(capacity - a - (large.pop(at) if at >= 0 else 0))
    gaps.sort()
    for x in sorted((x for x in lengths if 3 * x <= capacity), reverse=True):
        at = bisect.bisect_left(gaps, x)
        bisect.insort(gaps, (gaps.pop(at) if at < len(gaps) else capacity) - x)
    return len(gaps)


@given(st.lists(st.integers(1, 60), max_size=120), st.integers(60, 64))
@settings(max_examples=150, deadline=None)
def test_plan_places_every_piece_as_one_at_a_time(lengths, capacity):
    counts = Counter(lengths)
    plan, sequences = bestfit.packing_plan(dict(counts), capacity)
    held, seen = defaultdict(list), Counter()
    for k, (length, rank, first, each, offset) in enumerate(plan):
        end = plan[k + 1][1] if k + 1 < len(plan) and plan[k + 1][0] == length else counts[length]
        assert rank == seen[length]
        for r in range(end - rank):
            held[first + r // each].append((offset + r % each * length, length))
        seen[length] = end
    assert seen == counts and sequences == len(held) == brute_bins(lengths, capacity)
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity and sum(3 * x > capacity for _, x in places) <= 2


def test_plan_is_bounded_by_the_capacity():
    plan, sequences = bestfit.packing_plan({x: 10_000_000 + x * 7919 % 1000 for x in range(1, 2048)}, 2048)
    assert len(plan) < 60_000 and sequences >= sum(x * (10_000_000 + x * 7919 % 1000) for x in range(1, 2048)) / 2048


def check_packed(got: list, texts: dict, capacity: int) -> None:
    model = Tokenizer.from_file(VOCABULARY)
    want = Counter()
    for doc, text in texts:
        ids = model.encode(text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), capacity):
            own = np.array(ids[k : k + capacity], "<u4")
            want[doc, k // capacity, k, len(own), zlib.crc32(own.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    whole = [length for *_, length, _ in want.elements() if length == capacity]
    rest = [length for *_, length, _ in want.elements() if length < capacity]
    assert len(held) == len(whole) + brute_bins(rest, capacity)


def test_whole_table_is_packed(spark):
    texts = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check_packed(bestfit.op12_bestfit(spark, SF).collect(), texts, 2048)


@pytest.mark.parametrize("few", [10_000, 1])
@pytest.mark.parametrize("cache", [500_000, 5])
def test_packing_cases(spark, monkeypatch, few, cache):
    monkeypatch.setattr(bestfit, "FEW", few)
    monkeypatch.setattr(bestfit, "CACHE", cache)
    docs = cases.documents(spark, True).select("*", F.lit(1).alias("offset"), F.lit(1).alias("rank_"), F.lit("").alias("ids"))
    pieces = bestfit.cut_documents(docs, VOCABULARY, 64).withColumn("ids_crc32", F.crc32("ids").cast("long"))
    check_packed(bestfit.pack_pieces(pieces, ["doc_id", "piece", "ids_crc32"], 64).collect(), [(r[0], r[1]) for r in cases.rows()], 64)
    assert bestfit.pack_pieces(bestfit.cut_documents(cases.empty(spark), VOCABULARY), ["doc_id"]).count() == 0


MODEL, TOKENS = Tokenizer.from_file(VOCABULARY), bestfit.Tokens(VOCABULARY)


@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \t\n\r\x0b\x0c\x1c\x85 'sS<|>Aa9́Σİe"))), max_size=5))
@settings(max_examples=300, deadline=None)
def test_tokens_equal_the_library(texts):
    texts = [*texts, "a <|endoftext|> b<|startoftext|>c", "x" * 300 + " y"]
    assert [np.frombuffer(t, "<u4").tolist() for t in TOKENS.encode_batch(texts)] == [MODEL.encode(t, add_special_tokens=False).ids for t in texts]


# -- conversation prefix trie


def brute_trie(turns: list[tuple]) -> set[tuple]:
    """turns: conv_id, turn, role, text."""
    convs = defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs[conv].append((turn is not None, turn or 0, tie, (role, text)))
    convs = {c: [x[-1] for x in sorted(v)] for c, v in convs.items()}
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(convs.get(c - c % 5, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, path in sorted(rebuilt.items()):
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children, below = Counter(n[:-1] for n in members if n), defaultdict(lambda: [0, 0])
    for n in members:
        for d in range(len(n) + 1):
            below[n[:d]][0] += not children[n]
            below[n[:d]][1] += (len(members[n]) - 1) * (len(n[-1][1].encode()) if n else 0)
    sha = lambda n: hashlib.sha256(",".join(str(c) for c in members[n] if len(rebuilt[c]) == len(n)).encode()).hexdigest()
    return {(members[n][0], len(n), members[n[:-1]][0] if n else None, len(members[n]), children[n], *below[n], sha(n)) for n in members}


TURNS = "conv_id long, turn long, role string, text string, node string, depth int, bytes string"
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def built(spark, turns: list[tuple]) -> list[tuple]:
    df = spark.createDataFrame([(*t, "", 0, "") for t in turns], TURNS).repartition(3)
    return [tuple(r) for r in trie.prefix_trie(trie.with_heads(trie.turns_of(df))).select(*NODE).collect()]


@pytest.mark.parametrize(("few", "chunk"), [(10_000, 8192), (2, 3)])
def test_trie_matches_brute_force(spark, monkeypatch, few, chunk):
    from strataquery.llm import common

    monkeypatch.setattr(common, "FEW", few)
    monkeypatch.setattr(trie, "CHUNK", chunk)
    pick = random.Random(5)
    turns = []
    for c in [*range(0, 60), 103, 104, 1000, 1003, 999_999_999_999]:  # 100 and 999,999,999,995 are missing
        same = pick.random() < 0.4
        for t in range(pick.choice([1, 2, 9, 12]) if not same else 11):
            text = f"turn {t}" if same or pick.random() < 0.6 else f"é {pick.randrange(3)}"
            turns.append((c, t if pick.random() < 0.97 else None, pick.choice(["user", None]) if not same else "user", text if pick.random() < 0.95 else None))
    turns += [(7, 1, "user", "tie"), (7, 1, "user", "tie"), (7, 1, "user", "other"), (None, 0, "user", "nobody's"), (70, 0, "", "x" * 200_000), (71, 0, None, "x" * 200_000)]
    turns += [(200 + i, 0, "user", "short") for i in range(40)]
    got = built(spark, turns)
    assert len(got) == len(set(got)) and set(got) == brute_trie(turns)


def test_trie_of_nothing(spark):
    assert built(spark, []) == []
    assert built(spark, [(None, 1, "user", "x")]) == []
    (root,) = built(spark, [(3, 0, "user", "x")]) if zlib.crc32(b"3") % 9 else [None]
    assert root is None or (root[0], root[1], root[3], root[5], root[6]) == (3, 0, 1, 1, 0)
