from __future__ import annotations

import hashlib
import heapq
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strataquery.llm import bpe, jaccard, langid, packing, pii, sharding
from strataquery.llm.shingles import shingle_sets
from strataquery.llm.sigtree import similar, spanning_links
from tests.llm import cases

SF = "/root/testdata/sf0.001"
VOCABULARY = str(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module", params=[False, True], ids=["plain", "clashing columns"])
def docs(spark, request):
    return cases.documents(spark, request.param)


# -- language ID


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.op1_langid(spark, SF).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) and (got.lang == got.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def brute_language(text: str | None, profiles: dict[str, list[str]], size: int) -> tuple[str, float]:
    """Ranks and out-of-place distances by dictionaries of strings."""
    own = brute_ranks([text or ""], size)
    if not own:
        return "und", 0.0
    apart = {lang: sum(min(abs(own[g] - ranks[g]), size) if g in ranks else size for g in own) for lang, ranks in profiles.items()}
    best = min(sorted(apart), key=lambda lang: apart[lang])
    return best, 1 - apart[best] / (size * len(own))


def brute_ranks(texts: list[str], size: int) -> dict[str, int]:
    counts = Counter()
    for text in texts:
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        padded = " " + " ".join(words) + " " if words else ""
        for n in (1, 2, 3):
            for g in (padded[i : i + n] for i in range(len(padded) - n + 1)):
                if g.strip() and not (n == 3 and g[1] == " "):
                    counts[g] += 1
    # Ties as the operator breaks them: by code points, a blank (1) below every letter (code point + 1), shorter first.
    code = lambda g: sum((1 if c == " " else ord(c) + 1) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    return {g: i for i, g in enumerate(sorted(counts, key=lambda g: (-counts[g], code(g)))[:size])}


def test_language_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", langid.held_out()).collect()]
    assert max(Counter(r[2] for r in rows).values()) < langid.SAMPLE  # so that all labelled rows are learned from
    learn: dict[str, list] = {}
    for _, text, lang, out in rows:
        if not out and lang is not None and text is not None:
            learn.setdefault(lang, []).append(text)
    profiles = {lang: brute_ranks(texts, langid.SIZE) for lang, texts in learn.items()}
    got = {r["doc_id"]: (r["held_out"], r["lang_pred"], round(r["score"], 9)) for r in langid.op1_langid(spark, SF).collect()}
    want = {}
    for i, text, _, out in rows:
        lang, score = brute_language(text, profiles, langid.SIZE)
        want[i] = (out, lang, round(score, 9))
    assert got == want and {out for out, _, _ in want.values()} == {True, False}
    assert all(r[3] == (zlib.crc32(str(r[0]).encode()) % 4 == 2) for r in rows)


def test_language_cases(spark, docs):
    profiles = langid.learn_profiles(spark.read.parquet(f"{SF}/documents.parquet"))
    out = langid.predict_languages(docs, profiles)
    got = {(r["doc_id"], r["lang_pred"]) for r in out.collect()}
    assert {(0, "und"), (1, "und"), (2, "und"), (10, "und"), (14, "und")} <= got and (7, "und") not in got
    assert out.count() == len(cases.rows()) and langid.predict_languages(docs, {}).where("lang_pred <> 'und'").count() == 0
    assert langid.learn_profiles(cases.empty(spark)) == {} and langid.predict_languages(cases.empty(spark), profiles).count() == 0


def test_profiles_and_level_are_of_all_rows(spark, monkeypatch):
    """No row, label or score is left out: letters and labels of one row count, and the level is an exact quantile."""
    rows = [("the weather" if i % 500 else "the weather " + chr(0x3B1 + i // 500), "en") for i in range(10_000)]
    docs = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(rows + [(f"word {chr(0x4E00 + i)}", f"l{i}") for i in range(1001)])], "doc_id long, text string, lang string").repartition(3)
    for held in (langid.HELD, 50):
        monkeypatch.setattr(langid, "HELD", held)
        profiles = langid.learn_profiles(docs)
        assert len(profiles) == 1002
        code = lambda g: sum((1 if c == " " else ord(c) + 1) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
        assert profiles["en"].tolist() == [code(g) for g in brute_ranks([t for t, _ in rows], langid.SIZE)]
        assert profiles["l7"].tolist() == [code(g) for g in brute_ranks([f"word {chr(0x4E00 + 7)}"], langid.SIZE)]
    english = {"en": profiles["en"]}
    texts = ["the weather "[: 3 + i % 9] + np.base_repr(i * 7919, 26).translate(str.maketrans("0123456789", "qrstuvwxyz")) for i in range(25_000)]
    model = langid.Classifier(english, langid.SIZE)
    scores = sorted(model.predict(t)[1] for t in texts)
    monkeypatch.setattr(langid, "ASKED", 1.0)
    many = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string").repartition(4)
    for cells in (langid.CELLS, 3):
        monkeypatch.setattr(langid, "CELLS", cells)
        assert langid.acceptance(many, english) == scores[math.ceil(langid.BELOW * len(scores)) - 1]
    column = spark.createDataFrame([(s,) for s in scores[:101]], "score double")
    assert [langid.least_reached(column, q) for q in (0.0, 0.5, 1.0)] == [scores[0], scores[50], scores[100]]
    assert langid.least_reached(column.limit(0), 0.5) is None and langid.acceptance(many.limit(0), english) == 0.0


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_ngram_counts(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    padded = " " + " ".join(words) + " " if words else ""
    want = Counter()
    for i in range(len(padded)):
        for n in (1, 2, 3):
            g = padded[i : i + n]
            if len(g) == n and g.strip() and not (n == 3 and g[1] == " "):
                want[g] += 1
    kinds, counts = langid.ngram_counts(text)
    assert sum(counts) == sum(want.values()) and sorted(counts) == sorted(want.values())


def test_ngram_blocks(monkeypatch):
    text = "the quick brown fox " * 50
    whole = langid.ngram_counts(text)
    monkeypatch.setattr(langid, "BLOCK", 37)
    parts = langid.ngram_counts(text)
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])


# -- near duplicates


def brute_components(rows: list[tuple]) -> dict:
    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = [(i, shingles(t)) for i, t, *_ in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    return {(i, len(x)): find(i) if i is not None else None for i, x in sets}


def test_jaccard_cases(spark, docs):
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard.near_duplicates(docs).collect()}
    assert got == brute_components(cases.rows())
    assert got[(6, 56)] == 4 and jaccard.near_duplicates(cases.empty(spark)).count() == 0


def test_jaccard_large_groups(spark, monkeypatch):
    """Groups cut into blocks, a passage common to all, chains of near copies: the components are those of brute force."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = np.random.default_rng(3)
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for i in range(60):
        base = [f"w{i % 6}_{j}" for j in range(70)]
        for at in rng.choice(70, rng.integers(0, 4), replace=False):
            base[at] = f"edit{i}_{at}"
        rows.append((i, " ".join(base + passage if i % 2 else passage + base)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard.near_duplicates(df).collect()}
    assert got == brute_components(rows)
    assert 6 < len(set(got.values())) < 60


@given(st.lists(st.lists(st.integers(0, 40), min_size=0, max_size=25), min_size=1, max_size=40), st.integers(0, 3))
@settings(max_examples=100, deadline=None)
def test_signature_trees(lists, joined):
    sets = [np.unique(np.array(x, np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for x in lists]
    start = np.array([0 if i <= joined else i for i in range(len(sets))])  # some are in one component already
    links = spanning_links(sets, start, np.zeros(len(sets), np.int64))
    label = start.tolist()

    def find(p, i):
        while p[i] != i:
            i = p[i]
        return i

    for i, j in links:
        assert similar(sets[i], sets[j])
        label[find(label, j)] = find(label, i)
    want = start.tolist()
    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i]) and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j])):
                want[find(want, j)] = find(want, i)
    groups = lambda p: {frozenset(k for k in range(len(sets)) if find(p, k) == find(p, i)) for i in range(len(sets))}
    assert groups(label) == groups(want)


@given(st.lists(st.text(alphabet="aB \t\né.", max_size=30), max_size=6))
@settings(max_examples=200, deadline=None)
def test_shingles(texts):
    import pyarrow as pa

    got = shingle_sets(pa.array(texts, pa.string()))
    for t, s in zip(texts, got, strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", t.replace("B", "b"))
        want = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        assert len(s) == len(want)


def test_words_of_many_bytes_keep_apart():
    """Words that differ in letters as the Thue-Morse word and its complement do, and sets themselves, not only sizes."""
    import pyarrow as pa

    a = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    b = a.translate(str.maketrans("ab", "ba"))
    words = [a, b, a[:64], b[:64], a[:63], b[:63], a[:16], b[:16], "x", "y", "xy", "yx"]
    sets = shingle_sets(pa.array(words + [w.upper() for w in words]))
    assert len({s.tobytes() for s in sets}) == len(words) and [s.tobytes() for s in sets[: len(words)]] == [s.tobytes() for s in sets[len(words) :]]
    x, y = shingle_sets(pa.array(["a b c d e f g", "q a b c d e f"]))
    assert len(np.intersect1d(x, y)) == 2 and shingle_sets(pa.array(["b c d e f"]))[0][0] in x


# -- BPE


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def test_bpe_cases(spark, docs, library):
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode_and_decode(docs, VOCABULARY).collect()}
    want = set()
    for i, t, *_ in cases.rows():
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.add((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == want and bpe.encode_and_decode(cases.empty(spark), VOCABULARY).count() == 0


@given(st.text(max_size=80))
@settings(max_examples=300, deadline=None)
def test_bpe_matches_the_library(text):
    t = Tokenizer.from_file(VOCABULARY) if not hasattr(test_bpe_matches_the_library, "t") else test_bpe_matches_the_library.t
    test_bpe_matches_the_library.t = t
    enc = bpe.encoder(VOCABULARY)
    text = text.encode("utf-8", "replace").decode("utf-8")
    ids = enc.encode(text)
    assert ids == t.encode(text, add_special_tokens=False).ids and enc.decode(ids) == text


# -- personal data


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text: str) -> list[str]:
    def ok(kind, m):
        d = re.sub("[^0-9]", "", m)
        return kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m.split("."))) or (kind == "card" and 16 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 8 <= len(d) <= 15)

    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text) if ok(k, m[0])]


def base_of(df):
    return pii.with_base(pii.keyed(df, "doc_id"))


def extra_of(df) -> dict[str, list]:
    rows = base_of(df)
    extra, any_ = pii.analyse(rows.select("_key", "_base"), pii.keyed(df))
    return {r["_key"]: [(x["v"], x["k"], x["s"]) for x in r["extra"]] for r in extra.where("extra IS NOT NULL").collect()} if any_ else {}


def test_pii_cases(spark, docs):
    got = {(r["doc_id"], r["s"]) for r in base_of(docs).select("doc_id", pii.joined("_base").alias("s")).collect()}
    short = [(i, t) for i, t, *_ in cases.rows() if i not in (10, 11, 12)]
    assert {(i, ",".join(base_spans(t or ""))) for i, t in short} == {x for x in got if x[0] not in (10, 11, 12)}
    assert (12, "email:0:9002") in got and (10, "") in got and extra_of(docs) == {}
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert clean[0] is None and clean[4] == cases.COPY and clean[9].startswith("[EMAIL][EMAIL] and [PHONE], [IP] [IP].[IP] or 256.1.1.1; [CARD]!")
    assert pii.sanitise(cases.empty(spark)).count() == 0


def test_pii_keeps_columns_of_any_name(spark):
    """Names that are in use inside, maps, dots and capitals: all other columns come back as they went in."""
    names = ["_text", "_key", "_base", "_email", "_ip", "_card", "_phone", "extra", "row", "null", "all", "copies", "node", "unit", "a.b", "Row`s", "_found"]
    df = spark.createDataFrame([(1, "to a@b.org now", *[f"v{i}" for i in range(len(names))], {"k": 1}), (2, None, *[None] * len(names), None)], "doc_id long, text string, " + ", ".join(f"`{n.replace('`', '``')}` string" for n in names) + ", m map<string,int>")
    out = pii.sanitise(df)
    assert out.columns == df.columns and out.schema["m"].dataType == df.schema["m"].dataType
    got = {r["doc_id"]: tuple(r) for r in out.collect()}
    assert got == {1: (1, "to [EMAIL] now", *[f"v{i}" for i in range(len(names))], {"k": 1}), 2: (2, None, *[None] * len(names), None)}


def test_pii_cuts_by_code_points(spark):
    texts = ["\ufeffa@b.org\ufeff\U0001f600 c@d.org", "\U0001f600" * 300 + " a@b.org \ufeff", "é@a.b " * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert clean == {i: re.sub(PATTERNS["email"], "[EMAIL]", t) for i, t in enumerate(texts)}


@given(st.lists(st.text(alphabet="a1.@ +-()4é_\U0001f600", max_size=40), min_size=1, max_size=12))
@settings(max_examples=15, deadline=None)
def test_pii_matches_brute_force(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = base_of(df).select("doc_id", pii.joined("_base").alias("s"))
    assert {tuple(r) for r in found.collect()} == {(i, ",".join(base_spans(t))) for i, t in enumerate(texts)}


def test_many_matches_in_one_text(spark):
    """Places are right over many blocks of matches; time follows their number."""
    text = " ".join(f"u{i}@x{i % 7}.org é {i}" for i in range(16_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    at = [(m.start(), m.end()) for m in re.finditer(PATTERNS["email"], text)]
    assert [(b["s"], b["e"]) for b in base_of(df).first()["_base"]] == at
    began = time.time()
    assert pii.sanitise(df).first()["text"] == re.sub(PATTERNS["email"], "[EMAIL]", text)
    assert time.time() - began < 60


def test_disclosing_terms(spark):
    """A word that always stands with one address gives it away, near it or far; a common word and near copies don't."""
    filler = lambda i, n=6: " ".join(f"w{chr(97 + i)}{chr(97 + k % 26)}{chr(97 + k // 26)}x" for k in range(n))
    rows = [(i, f"the Quillfeather {filler(i, 60)} q@x.org and {filler(i + 8)}") for i in range(5)]
    rows += [(10 + i, f"the copied line of it by Marrowby is m@x.org again and so on, edit{chr(97 + i)}") for i in range(6)]
    rows += [(20 + i, f"{filler(i + 14, 80)} regards, Jane Featherstone, Head of Finance, s@y.net, Acme") for i in range(4)]
    rows += [(100 + i, f"the plain text number {i} and some more words of the head and finance jane regards acme") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(v, k) for spans in extra_of(df).values() for v, k, _ in spans} == {("Quillfeather", "removed"), ("Featherstone", "removed")}
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert clean[0] == f"the  {filler(0, 60)} [EMAIL] and {filler(8)}" and clean[100] == rows[-200][1] and "Marrowby is [EMAIL]" in clean[10]


def test_disclosure_matches_brute_force(spark, monkeypatch):
    """The whole query against document frequencies counted by hand, with passages shorter than the texts."""
    monkeypatch.setattr(pii, "PASSAGE", 150)
    rng = np.random.default_rng(11)
    words = [f"{a}{b}zz" for a in "bcdfghjklm" for b in "aeiou"]
    rows = []
    for i in range(60):
        own = [str(w) for w in rng.choice(words, 40)]
        for e in rng.choice(6, rng.integers(0, 3), replace=False):
            own.insert(int(rng.integers(0, 40)), f"p{e}@q.org")
            own.insert(int(rng.integers(0, 40)), f"{'abcdef'[e]}name")
        own += [f"{'abcdef'[i % 6]}name"] if i < 6 else []  # once each where the address may not stand
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows + [(90, rows[0][1]), (91, None)], "doc_id long, text string").repartition(3)
    n, n_t, n_e, n_te = len(rows) + 1, Counter(), Counter(), Counter()
    held, terms_in = {}, {}
    for i, t in rows:
        found = [(m[0].lower(), m.start()) for m in re.finditer(r"[^\W\d_]{3,}", t)]
        mail = [(m[0], m.start()) for m in re.finditer(PATTERNS["email"], t)]
        near = {(e, w) for w, at in found for e, x in mail if {at // 150, max(at // 150 - 1, 0)} & {x // 150, max(x // 150 - 1, 0)}}
        n_t.update({w for w, _ in found})
        n_e.update({e for e, _ in mail})
        n_te.update(near)
        held[i], terms_in[i] = {e for e, _ in mail}, found
    told = {}
    for (e, w), k in n_te.items():
        ic, pmi = np.log2(n / n_e[e]), np.log2(n * k / (n_t[w] * n_e[e]))
        if k >= pii.SUPPORT and n_e[e] >= pii.SUPPORT and ic > 0 and pmi >= pii.GENERALISE * ic:
            told[e, w] = "removed" if pmi >= pii.REMOVE * ic else "term"
    want = {}
    for i, t in rows:
        spans = []
        for m in re.finditer(r"[^\W\d_]{3,}", t):
            kinds = {told[e, m[0].lower()] for e in held[i] if (e, m[0].lower()) in told}
            if kinds and not any(x.start() < m.end() and m.start() < x.end() for x in re.finditer(PATTERNS["email"], t)):
                spans.append((min(kinds), m.start(), m.end()))
        want[i] = base_spans(t) + [f"{k}:{s}:{e}" for kind in ("term", "removed") for k, s, e in spans if k == kind]
    want[90], want[91] = want[0], []
    df.write.mode("overwrite").parquet(path := f"{pii.stored.__globals__['fresh_path'](spark, 'pii-test')}/documents.parquet")
    got = {r["doc_id"]: r for r in pii.op4_pii(spark, path.rsplit("/", 1)[0]).collect()}
    assert {i: r["spans"] for i, r in got.items()} == {i: ",".join(x) for i, x in want.items()}
    assert all(r["base_sha256"] == hashlib.sha256(",".join(x for x in want[i] if x.startswith("email")).encode()).hexdigest() for i, r in got.items())
    assert any("removed" in r["spans"] for r in got.values()) and len({k for k in told.values()}) == 2


# -- sharding and packing


def test_sharding(spark, docs):
    out = sharding.shard_by_bytes(docs, shards=3).toPandas()
    assert len(out) == len(cases.rows())
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert out.groupby("text_crc32").shard.nunique().max() == 1
    want = {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in cases.rows() if i is not None}
    assert want == {(int(a), b, c) for a, b, c in out.dropna(subset=["doc_id"])[["doc_id", "size", "text_crc32"]].itertuples(index=False)}
    assert sharding.shard_by_bytes(cases.empty(spark)).count() == 0


def test_lpt_is_near_equal(spark):
    out = sharding.op7_sharding(spark, SF).toPandas()
    sums = out.groupby("shard")["size"].sum()
    assert len(sums) == 8 and sums.max() - sums.min() <= out.groupby("text_crc32")["size"].sum().max()
    assert sharding.lpt_plan([(5, 1), (4, 1), (3, 2)], 2) == [[1, 1], [0, 1], [1, 2]]


def heap_loads(sizes: list[int], shards: int) -> list[list[int]]:
    """Sizes in each shard by one group at a time through a heap."""
    heap, held = [(0, s) for s in range(shards)], [[] for _ in range(shards)]
    for size in sorted(sizes, reverse=True):
        load, shard = heapq.heappop(heap)
        held[shard].append(size)
        heapq.heappush(heap, (load + size, shard))
    return held


@given(st.lists(st.tuples(st.integers(1, 30), st.integers(1, 200)), max_size=12), st.integers(1, 6))
@settings(max_examples=200, deadline=None)
def test_runs_go_where_single_groups_would(runs, shards):
    merged = sorted(Counter({s: sum(n for t, n in runs if t == s) for s, _ in runs}).items(), reverse=True)
    held = [[] for _ in range(shards)]
    for (size, _), ends in zip(merged, sharding.lpt_plan(merged, shards), strict=True):
        for s, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
            held[s] += [size] * (b - a)
    assert held == heap_loads([s for s, n in merged for _ in range(n)], shards)


def test_sharding_matches_the_heap(spark, monkeypatch):
    """The whole query's shards hold the groups that one heap over all groups gives them, hot sizes and texts included."""
    from strataquery.llm import common

    for few in (common.FEW, 2):
        monkeypatch.setattr(common, "FEW", few)
        monkeypatch.setattr(sharding, "FEW", few)
        monkeypatch.setattr(sharding, "HOT", 3 if few == 2 else 4096)
        monkeypatch.setattr(common, "HOT", 3 if few == 2 else 4096)
        out = sharding.op7_sharding(spark, SF).toPandas()
        texts = [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
        sizes = [n * (len(t.encode()) + 1) for t, n in Counter(texts).items()]
        own = out.groupby(["shard", "text_crc32"])["size"].sum().reset_index()
        assert [sorted(own[own.shard == s]["size"]) for s in range(8)] == [sorted(x) for x in heap_loads(sizes, 8)]
        assert sorted(out.doc_id) == sorted(r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
        assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))


@given(st.lists(st.integers(1, 60), min_size=1, max_size=14), st.integers(1, 4))
@settings(max_examples=100, deadline=None)
def test_boundaries_are_optimal(lengths, buckets):
    import itertools

    kinds = sorted(set(lengths))
    padding = lambda tops: sum(next(t for t in tops if t >= n) - n for n in lengths)
    best = min(padding(sorted({*c, kinds[-1]})) for r in range(min(buckets, len(kinds))) for c in itertools.combinations(kinds[:-1], r))
    tops = packing.best_boundaries(kinds, [lengths.count(k) for k in kinds], buckets)
    assert len(tops) <= buckets and padding(tops) == best


def test_packing(spark, docs):
    out = packing.pack(docs, packing.byte_length(), buckets=4, budget=2000).toPandas()
    assert len(out) == len(cases.rows()) and (out.padding == out.bucket_len - out.n_tokens).all() and (out.padding >= 0).all()
    for _, g in out.groupby("batch"):
        assert g.bucket.nunique() == 1 and sorted(g.slot) == list(range(len(g)))
        assert len(g) == 1 or len(g) * g.bucket_len.iloc[0] <= 2000
    assert sorted(out.batch.unique()) == list(range(out.batch.nunique()))
    assert packing.pack(cases.empty(spark), packing.byte_length()).count() == 0


def test_packing_matches_brute_force(spark):
    """The whole query pads as little as a plain program over all distinct lengths, and packs every row once."""
    lengths = [len((r[0] or "").encode()) + 1 for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    kinds, n = np.unique(lengths, return_counts=True)
    c, s = np.concatenate(([0], np.cumsum(n))), np.concatenate(([0], np.cumsum(n * kinds)))
    best = [0] + [10**15] * len(kinds)
    for _ in range(16):
        best = [0] + [min([best[j]] + [best[i] + int(kinds[j - 1] * (c[j] - c[i]) - (s[j] - s[i])) for i in range(j)]) for j in range(1, len(kinds) + 1)]
    out = packing.op8_packing(spark, SF).toPandas()
    assert out.padding.sum() == best[-1] and sorted(out.n_tokens) == sorted(lengths) and (out.padding >= 0).all()
    for _, g in out.groupby("batch"):
        assert g.bucket_len.nunique() == 1 and len(g) <= max(1, 65536 // g.bucket_len.iloc[0]) and sorted(g.slot) == list(range(len(g)))
    full = out.groupby(["bucket", "batch"]).size().groupby("bucket").apply(lambda x: (x < x.max()).sum())
    assert (full <= 1).all() and sorted(out.doc_id) == list(range(len(lengths)))


def test_every_column_may_be_null(spark):
    nothing = spark.createDataFrame([(None, None, None, None, None)] * 3, cases.DOCS)
    assert {r["lang_pred"] for r in langid.predict_languages(nothing, {}).collect()} == {"und"}
    assert {tuple(r) for r in jaccard.near_duplicates(nothing).collect()} == {(None, 0, None)}
    assert {r["n_tokens"] for r in bpe.encode_and_decode(nothing, VOCABULARY).collect()} == {0}
    assert pii.sanitise(nothing).where(F.col("text").isNotNull()).count() == 0
    assert sorted(r["slot"] for r in sharding.shard_by_bytes(nothing).collect()) == [0, 1, 2]
    assert packing.pack(nothing, packing.byte_length()).count() == 3
