from __future__ import annotations

import base64
import gzip
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs as pafs

import corpus_pipeline
from strataquery.llm import chat, warc
from tests.llm import cases

TURNS = "conv_id long, turn long, role string, text string, formatted string, _key long"


@given(st.lists(st.text(alphabet="<|\\ima_>é\n", max_size=12), min_size=1, max_size=4))
@settings(max_examples=300, deadline=None)
def test_escapes(texts):
    for raw, safe in zip(texts, chat.escape(pa.array(texts)).to_pylist(), strict=True):
        assert "<|" not in safe and chat.unescape(safe) == raw
    for raw, safe in zip(texts, chat.escape_roles(pa.array(texts)).to_pylist(), strict=True):
        assert "<|" not in safe and "\n" not in safe and chat.unescape_role(safe) == raw


def test_chat_cases(spark):
    probe = chat.PROBE
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", probe), (1, 1, "assistant", probe), (1, None, "system", None), (2, 5, None, "é\U0001f600"), (None, 0, "assistant", "x"), (3, 0, "a\nb\\n", "<"), (3, 1, "assistant", "|>\n"), (0, 0, "assistant", "zero")]
    df = spark.createDataFrame([(*r, "f", 9) for r in rows], TURNS).repartition(3)
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv in {r[0] for r in rows}:
        own = sorted((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv)
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert got[conv]["turns_sha256"] == sha("".join(f"{r}\n{x}\n" for _, r, x in own)) and got[conv]["n_turns"] == len(own)
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), sha(loss))
    assert len(got) == 5 and chat.read_back(chat.format_chats(df.limit(0))).count() == 0
    one = chat.format_chats(df.where("conv_id = 2")).first()
    assert one["formatted"] == "<|im_start|>\né\U0001f600<|im_end|>\n" and one["loss_starts"] == []


def test_warc_cases(spark, tmp_path):
    html = ["<p>a</p>", None, "", "<p>a</p>", "<p>a</p>", "é" * 1000, "\r\n\r\nWARC/1.1\r\n", "<p>a</p>"]
    rows = [(i, f"http://x/{i} \n" if i != 2 else None, h, "payload") for i, h in enumerate(html)] + [(7, "http://again", "<p>a</p>", "p"), (None, "u", "<p>a</p>", "p"), (None, "u", "lonely", "p")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string").repartition(3)
    paths, uri = warc.archive(df)
    got = warc.read_archives(paths, uri).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["record_type"] == "response" or r["refers_to"] is not None
        if r["record_type"] == "response":
            assert base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode() == r["payload_digest"] and len(r["payload"]) == r["payload_bytes"]
    kinds = {(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got}
    assert {(0, 8, "revisit", 7), (3, 8, "revisit", 7), (7, 8, "response", None), (None, 8, "revisit", 7), (1, 0, "revisit", 2), (2, 0, "response", None), (None, 6, "response", None), (5, 2000, "response", None)} <= kinds
    fs, root = pafs.FileSystem.from_uri(uri)
    for p in [r["path"] for r in paths.collect()]:
        data = fs.open_input_file(p).read()
        n, rest = 0, data
        while rest:  # every record is a member of its own
            z = zlib.decompressobj(31)
            assert z.decompress(rest).startswith(b"WARC/1.1\r\n")
            n, rest = n + 1, z.unused_data
        assert n == len(fs.open_input_file(p + ".idx").read().splitlines()) and (not data or gzip.decompress(data))
    own = "file://" + str(tmp_path / "kept")
    assert warc.archive(df, target=own)[1] == own and len(list((tmp_path / "kept").glob("*.warc.gz.idx"))) == len(list((tmp_path / "kept").glob("*.warc.gz"))) > 0
    empty, at = warc.archive(df.limit(0))
    assert warc.read_archives(empty, at).count() == 0
    assert {r["record_type"] for r in warc.read_archives(*warc.archive(df, least=9)).where("payload_bytes = 8").collect()} == {"response"}


def test_inflate_streams(monkeypatch):
    import io

    monkeypatch.setattr(warc, "CHUNK", 7)
    records = [warc.warc_record(i, "u", b"x" * i, "D", None, "d") for i in range(40)]
    for blob in (gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records))):
        assert list(warc.split_records(warc.inflated(io.BytesIO(blob)))) == records


@pytest.mark.parametrize("clash", [False, True], ids=["plain", "clashing columns"])
def test_pipeline(spark, clash):
    docs = cases.documents(spark, clash)
    if clash:
        names = ["row", "id", "own", "at", "g", "copies", "best", "who", "real", "null", "all", "_base", "_spread", "component_id", "n_shingles", "held_out", "a.b"]
        docs = docs.drop("score", "rank").selectExpr("*", *[f"doc_id * {i} AS `{n}`" for i, n in enumerate(names)], "0.5D AS score", "map('k', doc_id) AS m")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, "")
        assert kept.columns == docs.columns and kept.schema["text"].dataType == docs.schema["text"].dataType
    rows = {r["doc_id"]: r for r in kept.collect()}
    assert set(rows) == {None, 3, 4, 7, 9, 12, 13} and kept.count() == 7  # 11 is one letter repeated
    assert "[EMAIL]" in rows[9]["text"] and rows[9]["n_chars"] == len(rows[9]["text"]) and rows[4]["text"] == cases.COPY
    if clash:
        assert all(r["score"] == 0.5 and r["m"] == {"k": i} and [r[n] for n in names] == [i * k if i is not None else None for k in range(len(names))] for i, r in rows.items())
    assert corpus_pipeline.pack(spark, kept, "").count() == 7
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, cases.empty(spark), "").count() == 0


def test_rows_of_one_id_are_apart(spark, monkeypatch):
    """Different texts of one doc_id are different documents: only what is linked to a kept one goes."""
    from strataquery.llm import common

    other = " ".join(f"other{i}" for i in range(40))
    third = " ".join(f"third{i}" for i in range(40))
    rows = [(1, cases.COPY), (5, cases.NEAR), (5, other), (5, other), (7, other), (8, third), (8, third), (8, ""), (8, None), (None, third), (9, third + " end"), (3, "a lone text of some words")]
    df = spark.createDataFrame([(i, t, "en", "s", n) for n, (i, t) in enumerate(rows)], cases.DOCS).repartition(3)
    for few in (common.FEW, 0):
        monkeypatch.setattr(common, "FEW", few)
        got = sorted(((r["doc_id"] or 0), r["text"] or "-" * (r["text"] is None)) for r in corpus_pipeline.near_duplicates(spark, df, "").collect())
        assert len(got) in (6, 7) and [x for x in got if x[0] not in (8,)] == sorted([(0, third), (1, cases.COPY), (3, rows[-1][1]), (5, other)])
        assert (8, third) in got and sum(i == 8 for i, _ in got) in (2, 3)


def test_stored_tables_release_the_drivers_memory(spark, monkeypatch):
    """What finished steps left in the driver's heap goes with the next table, not when the heap is full."""
    from strataquery.llm import common

    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    for every, collects in ((0.0, True), (1e9, False)):
        monkeypatch.setattr(common, "RELEASE_S", every)
        before = whole()
        assert common.stored(spark.range(3), "release").count() == 3
        assert (whole() > before) == collects


def test_junk_is_no_language(spark):
    """Random letters, codes and other scripts are rejected, labelled texts stay, short ones too."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rng = np.random.default_rng(5)
    junk = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 800)), base64.b64encode(rng.bytes(600)).decode(), rng.bytes(500).hex(), "这是一个测试文档" * 20 + " the", "Это документ на русском языке о погоде " * 9 + "a"]
    more = spark.createDataFrame([(10_000 + i, t, None, "junk", len(t)) for i, t in enumerate(junk)], docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, docs.union(more), "").select("doc_id").collect()}
    labelled = {r["doc_id"] for r in docs.where("lang IS NOT NULL AND text rlike '[a-z]'").select("doc_id").collect()}
    assert not kept & {10_000 + i for i in range(len(junk))} and labelled <= kept


def test_warc_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    pages = [(r["page_id"], (r["html"] or "").encode()) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    lead: dict[bytes, int] = {}
    for i, html in pages:
        lead[html] = max(i, lead.get(html, i))
    digest = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    want = {(i, len(h), digest(h), "response" if lead[h] == i else "revisit", None if lead[h] == i else lead[h]) for i, h in pages}
    got = [tuple(r) for r in warc.op6_warc(spark, sf).collect()]
    assert set(got) == want and len(got) == len(pages)
