"""BPE, packing and WARC: exact round trips."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from auditlake.llm import byte_bpe, packing, warc

TEXTS = [None, "", " ", "hello  world", "it's\n\n\tfine…", "é" * 300, "naïve 中文 🙂🙂", "a" * 5000, "x1 y22 <|endoftext|> z", "ab " * 9000, "hello  world", "\x1c x \x85\x85 y\u180e \u3000 z\r\n\r\n ª²Ⅷ१ 𝟙𞤀"]


def test_bpe_matches_the_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.vocabulary(path).ranks, special_tokens={})
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    out = byte_bpe.decoded(byte_bpe.encoded(table, path, public_tokenizers.PATTERN), path).collect()
    assert len(out) == len(TEXTS)
    for r in out:
        text = TEXTS[r["doc_id"]] or ""
        assert r["ids"] == library.encode_ordinary(text) and bytes(r["data"]) == text.encode()
    assert byte_bpe.encoded(table.where("false"), path, public_tokenizers.PATTERN).collect() == []


def test_packing_places_every_id_once(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, f"word{i} " * (37 * i % 900)) for i in range(60)]
    ids = {d: [*library.encode(t or "", add_special_tokens=False).ids, 1] for d, t in rows}
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("mine")).repartition(3)
    out = packing.packed(table, path, with_ids=True).collect()
    for d, want in ids.items():
        pieces = sorted((r for r in out if r["doc_id"] == d), key=lambda r: r["start"])
        got = [i for r in pieces for i in np.frombuffer(bytes(r["ids"]), "<u4").tolist()]
        assert got == want
        assert [r["start"] for r in pieces] == np.cumsum([0, *[r["length"] for r in pieces]])[:-1].tolist()
        assert all(r["doc_tokens"] == len(want) and r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) for r in pieces)
    sequences = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append(r)
    padding = 0
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in pieces] == np.cumsum([0, *[r["length"] for r in pieces]])[:-1].tolist()
        total = sum(r["length"] for r in pieces)
        assert total <= packing.WINDOW
        padding += 0 if total & (total - 1) == 0 else packing.WINDOW - total
    assert padding == 0


def test_packing_of_nothing_and_of_null_ids(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    table = spark.createDataFrame([(None, None), (None, "x")], "doc_id long, text string")
    assert packing.packed(table.where("false"), path).collect() == []
    pieces = packing.packed(table, path).collect()
    assert {r["doc_tokens"] for r in pieces} == {1, 2} and sum(r["length"] for r in pieces) == 3 and all(r["doc_id"] is None for r in pieces)


def test_open_windows_stay_bounded():
    done = []
    packer = packing.Packer(done.append, window=8, most=3)
    for i, n in enumerate([5, 5, 5, 5, 7, 1, 3, 20, 2, 6]):
        packer.add(i, 0, np.arange(n, dtype="<u4"), n)
        assert len(packer.open) <= 3 and all(0 < free < 8 for free, _, _ in packer.open)
    assert all(sum(len(p[2]) for p in pieces) == 8 for pieces in done)


PAGES = [(1, "http://a/\r\nx", "é" * 3000), (2, None, ""), (3, "u", None), (None, "u", "zz"), (5, "u", "é" * 3000), (5, "u", "é" * 3000), (6, "u", "WARC/1.1\r\n\r\n" * 9)]


def test_archives_read_back_in_chunks(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"chunk": F.lit("x"), "data": F.lit(0)})
    manifest = warc.write(warc.chunked(warc.revisits(pages), chunk=1000))
    rows = warc.read(manifest, chunk=777).collect()
    first = {1: "é" * 3000, 2: "", None: "zz", 6: PAGES[6][2]}
    for page, text in first.items():
        chunks = sorted((r for r in rows if r["page_id"] == page and r["record_type"] == "response"), key=lambda r: r["chunk"])
        assert b"".join(bytes(r["data"]) for r in chunks) == text.encode()
        digest = base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()
        assert [r["last"] for r in chunks] == [False] * (len(chunks) - 1) + [True] and chunks[-1]["digest_so_far"] == chunks[-1]["payload_digest"] == digest
        assert all(len(r["data"]) <= 777 for r in chunks)
    revisits = sorted((r["page_id"], r["refers_to"], r["payload_bytes"]) for r in rows if r["record_type"] == "revisit")
    assert revisits == [(3, 2, 0), (5, 1, 6000), (5, 1, 6000)]
    assert sum(r["records"] for r in manifest.collect()) == len(PAGES)


def test_small_payloads_are_all_responses_and_nothing_is_read_from_nothing(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    rows = warc.read(warc.write(warc.chunked(warc.revisits(pages, least=1)))).where("last").collect()
    assert {(r["page_id"], r["record_type"]) for r in rows if r["payload_bytes"] == 0} == {(2, "response"), (3, "response")}
    assert warc.read(warc.write(warc.chunked(warc.revisits(pages.where("false"))))).collect() == []
