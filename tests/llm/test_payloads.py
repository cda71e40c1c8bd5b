"""Media containers, WARC archives, byte-level BPE and packing against plain versions."""

import gzip
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from irisframe.llm import bpe, media, packing, queries, warc
from irisframe.llm.tokens import TextEncoder
from irisframe.session import scratch_dir

from .test_native import odd_rows, table

FOLDER = "/root/testdata/sf0.001"


# media


@pytest.mark.parametrize("count", [1, 16, 17, 255, 256, 257, 512, 700])
def test_container_round_trip(count):
    payload = random.Random(count).randbytes(64 * count)
    raw = media.wrap(payload)
    (track,) = media.describe(raw)
    assert track.payload(raw) == payload
    assert (track.codec, track.timescale, track.duration) == ("raw", 8000, len(payload))
    for k, (offset, size) in enumerate(track.keyframe_ranges):
        assert raw[offset : offset + size] == payload[64 * 16 * k : 64 * 16 * k + 64]
    assert len(track.keyframe_ranges) == -(-count // 16)


def test_broken_containers():
    raw = media.wrap(bytes(64))
    for cut in (raw[:40], raw[:-1], b"\0\0\0\5moov"):
        with pytest.raises(ValueError):
            media.describe(cut)
    with pytest.raises(ValueError):
        media.wrap(bytes(63))


def test_media_columns_of_odd_files(spark):
    rows = [(1, bytearray(media.wrap(bytes(64)))), (2, None), (3, bytearray(b"junk that is no box")), (None, bytearray())]
    got = media.media_columns(spark.createDataFrame(rows, "key long, content binary")).collect()
    assert len(got) == 4
    assert [r for r in got if r.key == 1][0].codec == "raw" and all(r.error for r in got if r.key != 1)


def test_media_of_odd_texts(spark):
    out = media.media_digests(media.stored_texts(table(spark, odd_rows()))).collect()
    texts = sorted(hashlib.sha256(media.padded(t)).hexdigest() for _, t, _ in odd_rows())
    assert sorted(r.payload_sha256 for r in out) == texts
    for r in out:
        assert r.payload_bytes == max(64, -(-r.n_bytes // 64) * 64)


# archives


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, refers_to string")


def test_archive_round_trip(spark):
    long = "é中\r\n\r\nWARC/1.1\r\n" * 9000
    rows = [(5, "http://a/\r\nx: y", long), (3, None, long), (4, "u", ""), (6, "u", None), (None, "u", long), (7, "u", "short"), (8, "u", "short")]
    rows += [(9, "u", "z" * 100), (10, "u", "z" * 100), (11, "u", "z" * 99), (12, "u", "z" * 99), (3, None, long)]
    path = scratch_dir(spark, "test-warc")
    warc.write_archives(pages(spark, rows).drop("refers_to"), path)
    records = warc.read_records(spark, path)
    assert records.filter("number > 1").count() > 3
    found = warc.read_pages(spark, path).collect()
    assert len(found) == len(rows) and not [r for r in found if r.error]
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in found}
    assert kinds == {(3, "response", None), (5, "revisit", 3), (None, "response", None), (10, "revisit", 9)} | {
        (i, "response", None) for i in (4, 6, 7, 8, 9, 11, 12)
    }
    texts = {i: h or "" for i, _, h in rows}
    assert all(bytes(r.payload).decode() == texts[r.page_id] for r in found if r.record_type == "response")
    out = {r.page_id: r for r in warc.page_payloads(spark, path).collect()}
    assert out[5].payload_bytes == len(long.encode()) and out[10].payload_digest == hashlib.sha256(b"z" * 100).hexdigest()


def test_repeated_page_ids_keep_their_payloads(spark):
    a, b = "a" * 200, "b" * 300
    path = scratch_dir(spark, "test-warc")
    warc.write_archives(pages(spark, [(3, "u", a), (3, "u", b), (5, "u", a), (5, "u", b), (5, "u", "c" * 400)]), path)
    out = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to, r.reason) for r in warc.page_payloads(spark, path).collect())
    assert out == [(3, 200, "response", None, None), (3, 300, "response", None, None)] + [
        (5, 200, "revisit", 3, None), (5, 300, "revisit", 3, None), (5, 400, "response", None, None)
    ]


def test_damaged_records_come_back_with_a_reason(spark, monkeypatch):
    path = scratch_dir(spark, "test-warc")
    warc.write_archives(pages(spark, [(1, "u", "abc" * 20_000), (2, "u", "abc" * 20_000), (3, "u", "sound")]), path)
    whole = warc.read_records
    monkeypatch.setattr(warc, "read_records", lambda *a: whole(*a).filter("number IS NULL OR number <> 1"))
    out = warc.page_payloads(spark, path).collect()
    assert len(out) == 3 and sum(r.payload_bytes is None for r in out) == 2
    assert {r.reason for r in out} == {"missing segment", "no sound response", None}


def test_incomplete_segments_are_named(spark):
    path = scratch_dir(spark, "test-warc")
    warc.write_archives(pages(spark, [(1, "u", "abc" * 20_000)]), path)
    records = warc.read_records(spark, path)
    for lost in (1, 2, records.agg(F.max("number")).first()[0]):
        (row,) = warc.reassembled(records.filter(F.col("number") != lost)).collect()
        assert row.error and row.block is None


def record(block, **fields):
    head = "".join(f"{k.replace('_', '-')}:{v}\r\n" for k, v in fields.items())
    return f"WARC/1.0\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_archives_of_other_makers(spark, tmp_path):
    """A gzip member for each record, names as uuids, no digests, header lines
    without a space, a file that is cut off and one that is no archive."""
    http = b"HTTP/1.1 200 OK\r\n\r\n"
    page = b"p" * 500
    records = [record(b"x: y", WARC_Type="warcinfo", WARC_Record_ID="<urn:uuid:0>")]
    records += [record(http + page, WARC_Type="response", WARC_Record_ID="<urn:uuid:1>"), record(http, WARC_Type="revisit", WARC_Record_ID="<urn:uuid:2>", WARC_Refers_To="<urn:uuid:1>")]
    whole = b"".join(gzip.compress(r) for r in records)
    (tmp_path / "a.warc.gz").write_bytes(whole)
    (tmp_path / "b.warc").write_bytes(b"".join(records) + record(http + b"late", WARC_Type="response", WARC_Record_ID="<urn:uuid:3>")[:-9])
    (tmp_path / "c.warc.gz").write_bytes(whole[:-20])
    (tmp_path / "d.warc").write_bytes(b"no archive at all")
    (tmp_path / "e.warc").write_bytes(b"")
    out = warc.read_pages(spark, str(tmp_path)).collect()
    assert [bytes(r.payload) for r in out if r.record_type == "response"] == [page] * 3
    assert {r.refers_id for r in out if r.record_type == "revisit"} == {"<urn:uuid:1>"}
    faults = sorted(r.error for r in out if r.error)
    assert [f.rpartition("/")[2] for f in faults] == ["b.warc", "d.warc", "c.warc.gz"] and len(out) == 3 + 2 + 3
    found = warc.page_payloads(spark, str(tmp_path / "a.warc.gz")).collect()
    assert {(r.record_type, r.payload_bytes, r.reason) for r in found} == {("response", 500, None), ("revisit", 500, None)}


def test_very_long_page(spark):
    path = scratch_dir(spark, "test-warc")
    long = "0123456789abcdef" * (3 << 20)
    warc.write_archives(pages(spark, [(1, "u", long), (2, "u", "short")]), path)
    out = {r.page_id: r for r in warc.page_payloads(spark, path).collect()}
    assert out[1].payload_bytes == len(long) and out[1].payload_digest == hashlib.sha256(long.encode()).hexdigest() and out[1].reason is None


def test_archive_edge_cases(spark):
    path = scratch_dir(spark, "test-warc")
    warc.write_archives(pages(spark, []), path)
    assert warc.page_payloads(spark, path).count() == 0
    with pytest.raises(ValueError):
        list(warc.parse_records(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))
    with pytest.raises(ValueError):
        warc.decode_http(b"H\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabcd\r\n0\r\n\r\n")


# byte-level BPE


@pytest.fixture(scope="module")
def library():
    ranks = bpe.read_ranks(queries.RANKS)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_query(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    for r in queries.op10_recursive_bpe(spark, FOLDER).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_bpe_odd_texts(library):
    coder = bpe.Codec(queries.RANKS, public_tokenizers.PATTERN)
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab é  \x1c\x85\n\t 1,'s're中😀　") for _ in range(rng.randrange(30))) for _ in range(400)]
    texts += ["", "a" * 5000, " " * 999 + "x", "ab" * 101, "é" * 150, "<|endoftext|>"]
    got = coder.encode(texts)
    assert got == [",".join(map(str, library.encode_ordinary(t))) for t in texts]
    assert coder.decode(got) == [t.encode() for t in texts]


def test_bpe_odd_rows(spark):
    out = bpe.round_trip(table(spark, odd_rows()), queries.RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(r.decoded_sha256 for r in out) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t, _ in odd_rows())
    assert bpe.round_trip(table(spark, []), queries.RANKS, public_tokenizers.PATTERN).count() == 0


# packing


def check_pieces(rows, texts):
    """``texts``: (doc_id, text) rows; every id in one piece, sequences gapless."""
    tokenizer = Tokenizer.from_file(queries.VOCABULARY)
    ids = [(d, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in texts]
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        documents[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    expected = defaultdict(int)
    for d, found in ids:
        expected[d] += len(found)
    assert {d: sum(p[1] for p in parts) for d, parts in documents.items()} == dict(expected)
    if len(expected) == len(ids):
        for d, found in ids:
            at = 0
            for start, length, crc, tokens in sorted(documents[d]):
                assert start == at and tokens == len(found)
                assert crc == zlib.crc32(np.array(found[start : start + length], dtype="<u4").tobytes())
                at += length
    padding = sum(-sum(n for _, n in parts) % 2048 for parts in sequences.values())
    return padding / (2048 * len(sequences))


def test_packing_query(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert check_pieces(queries.op6_packing(spark, FOLDER).collect(), texts) < 0.02


def test_packing_odd_rows(spark):
    check_pieces(packing.pack(table(spark, odd_rows()), queries.VOCABULARY).collect(), [(i, t) for i, t, _ in odd_rows()])
    assert packing.pack(table(spark, []), queries.VOCABULARY).count() == 0


def test_part_encoder_equals_the_library():
    """Every letter of the BMP in context, odd white space, special tokens as such
    and as text."""
    rng = random.Random(3)
    letters = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x10000)]]
    texts = ["".join(f"a{c}b {c}1{c} x" for c in letters[at : at + 16]) for at in range(0, len(letters), 16)]
    some = ["a", "B", " ", "  ", "\n", "\n ", "\t", " \n", "é", "'s", "23", "...", "<|endoftext|>", " <|", "你", "\u3000", "\x85", "😀", "▁", "\0", " word"]
    texts += ["".join(rng.choices(some, k=rng.randint(0, 12))) for _ in range(5000)]
    library = Tokenizer.from_file(queries.VOCABULARY)
    for special in (True, False):
        library.encode_special_tokens = not special
        expected = [np.array(e.ids, dtype="<u4").tobytes() for e in library.encode_batch_fast(texts, add_special_tokens=False)]
        assert TextEncoder(queries.VOCABULARY, special=special)(pa.array(texts)) == expected
    other = TextEncoder(public_tokenizers.path("word_bpe_49k.json"))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert other(pa.array(["Two words, 3"])) == [np.array(library.encode("Two words, 3", add_special_tokens=False).ids, dtype="<u4").tobytes()]


def test_greedy_windows():
    rng = random.Random(5)
    histogram = {c: rng.randrange(40) for c in range(1, 129)}
    used = defaultdict(int)
    for classes, n in packing.greedy_counts(histogram, 128):
        assert 127 <= sum(classes) <= 128 and n > 0
        for c in classes:
            used[c] += n
    assert all(used[c] <= histogram[c] for c in used)
    assert packing.greedy_counts({}, 128) == [] and packing.greedy_counts({100: 5}, 128) == []
    assert packing.greedy_counts({100: 5, 28: 2}, 128) == [((100, 28), 2)]


def test_least_squares():
    rng = np.random.default_rng(4)
    for _ in range(20):
        a, x = rng.random((8, 12)), np.maximum(rng.normal(size=12), 0)
        found = packing.non_negative_least_squares(a, a @ x)
        assert (found >= 0).all() and np.abs(a @ found - a @ x).max() < 1e-6


def test_repeats_stay_within_the_histogram():
    rng = random.Random(2)
    histogram = {c: rng.randrange(5000) for c in range(1, 129)}
    used = defaultdict(int)
    for classes, n in packing.repeat_counts(histogram, 128):
        assert sum(classes) == 128
        for c in classes:
            used[c] += n
    assert all(used[c] <= histogram[c] for c in used)
    assert sum(c * n for c, n in used.items()) > 0.9 * sum(c * n for c, n in histogram.items())
