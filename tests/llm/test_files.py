"""Token files and web archives: exact round trips."""

import hashlib
import io
import random
import struct
import zipfile
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracklake.llm import tokens, warc
from tracklake.llm.queries import op3_token_output

SF = "/root/testdata/sf0.001"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=400), st.sampled_from([7, 130, 1024]))
def test_coding_round_trip(ids, block):
    words, starts = tokens.encode(np.array(ids, np.uint64), block)
    assert tokens.decode(words, starts, len(ids), block).tolist() == ids and len(starts) == -(-len(ids) // block)


def test_coding_is_dense_and_blocks_stand_alone():
    assert len(tokens.encode(np.zeros(1200, np.uint64), 1200)[0]) == 10
    assert len(tokens.encode(np.ones(600, np.uint64), 600)[0]) == 10
    ids = np.random.default_rng(1).integers(0, 50_000, 700_000).astype(np.uint64)
    words, starts = tokens.encode(ids)
    for b in (0, 3, 300, len(starts) - 1):
        end = starts[b + 1] if b + 1 < len(starts) else len(words)
        want = ids[b * 1024 : (b + 1) * 1024]
        assert (tokens.decode(words[starts[b] : end], starts[b : b + 1] * 0, len(want)) == want).all()


def test_shard_by_ranges():
    ids = [np.random.default_rng(k).integers(0, 50_000, n) for k, n in enumerate((5, 0, 3000, 1, 1024))]
    out = io.BytesIO()
    tokens.write_shard(out, [7, None, 8, 9, 9], np.array([len(x) for x in ids]), np.concatenate(ids))
    for first, last in ((0, None), (2, 3), (3, 5), (4, 9)):
        out.seek(0)
        got = list(tokens.read_shard(out, first, last))
        assert [d for d, _ in got] == [7, None, 8, 9, 9][first:last] and all((a == b).all() for (_, a), b in zip(got, ids[first:last], strict=True))
    with pytest.raises(ValueError):
        list(tokens.read_shard(io.BytesIO(b"something else")))


ODD = ["a", "é", "B", ".", ",", "the", "ß", "×", " ", "  ", "\n", "\t", "1", "'s", "'", "!", "\u00a0", "\u3000", "\x1c", "\x85", "<|endoftext|>", "漢", "\u0301", "😀", "\u200b", "²", "\r\n"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(ODD), max_size=14).map("".join))
def test_encoder_is_the_librarys(text):
    assert np.frombuffer(tokens.kept_encoder(tokens.default_tokenizer())([text])[0], "<u4").tolist() == library(text)


_tok = None


def library(text):
    global _tok
    if _tok is None:
        from tokenizers import Tokenizer

        _tok = Tokenizer.from_file(tokens.default_tokenizer())
        _tok.encode_special_tokens = True
    return _tok.encode(text, add_special_tokens=False).ids


def test_token_query(spark):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    start, want = 0, []
    for d, t in docs:
        ids = [*library(t), 0]
        want.append((d, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert sorted(map(tuple, op3_token_output(spark, SF).collect())) == want


def test_tokens_of_awkward_rows(spark, docs):
    df = docs([None, "", "x" * 100_000, "same", "same"]).unionByName(docs(["zero"])).select("doc_id", "text", "n_words")
    shards = tokens.write_tokens(df, shards=3)
    got = tokens.read_tokens(shards).orderBy("start").collect()
    assert [r.doc_id for r in got] == [0, 0, 1, 2, 3, 4] and [r.n_tokens for r in got if r.doc_id == 1] == [1]
    assert sum(r.n_tokens for r in got) == sum(r.n_ids for r in shards.collect())
    nulls = spark.createDataFrame([(None, "b"), (5, "a")], "doc_id long, text string")
    assert [r.doc_id for r in tokens.read_tokens(tokens.write_tokens(nulls)).orderBy("start").collect()] == [None, 5]
    assert tokens.read_tokens(tokens.write_tokens(df.limit(0))).count() == 0
    rolled = tokens.write_tokens(df, shards=2, most=3)  # files close after three ids: the same documents
    assert rolled.count() > 2 and sorted(map(tuple, tokens.read_tokens(rolled).collect())) == sorted(map(tuple, got))


def test_what_an_encoder_remembers_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "_KEPT", 3000)
    run = tokens.bpe_encoder(tokens.default_tokenizer())
    rng = random.Random(6)
    for _ in range(60):
        text = " ".join("".join(rng.choices("abcdé'1", k=rng.choice((3, 6, 90)))) for _ in range(30))
        assert np.frombuffer(run([text])[0], "<u4").tolist() == library(text)


def test_whole_documents_of_each_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("lang", "text").collect()
    run = tokens.kept_encoder(tokens.default_tokenizer())
    for lang in {r.lang for r in docs}:
        for text in [r.text or "" for r in docs if r.lang == lang][:60]:
            assert np.frombuffer(run([text])[0], "<u4").tolist() == library(text), lang


# ---- archives ----


def test_zip_directories():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", b"plain")
        z.writestr(zipfile.ZipInfo("dir/b.bin"), bytes(range(256)))
        z.writestr("c.txt", b"y" * 999, zipfile.ZIP_DEFLATED)
        z.comment = b"PK notes"
    got = warc.directory(out, len(out.getvalue()))
    assert got["c.txt"][0] == 8
    for name, want in (("a.txt", b"plain"), ("dir/b.bin", bytes(range(256)))):
        method, at, n = got[name]
        assert method == 0 and out.getvalue()[at : at + n] == want
    with pytest.raises(ValueError):
        warc.directory(io.BytesIO(b"no zip"), 6)


def test_zip64_directory():
    """All fields that ZIP64 can move are moved."""
    data, name = b"stored bytes", b"m"
    local = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, zlib.crc32(data), 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, len(data), len(data)) + data
    extra = struct.pack("<HH", 9, 2) + b"zz" + struct.pack("<HHQQQ", 1, 24, len(data), len(data), 0)
    central = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, zlib.crc32(data), 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    at = len(local)
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(central), at)
    tail = struct.pack("<4sIQI", b"PK\x06\x07", 0, at + len(central), 1) + struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    whole = local + central + end64 + tail
    method, start, n = warc.directory(io.BytesIO(whole), len(whole))["m"]
    assert method == 0 and whole[start : start + n] == data


def test_package_round_trip():
    rng = random.Random(3)
    pages = [({"page_id": i, "url": f"http://x/{i}\r\nX: y", "digest": "d", "bytes": 5, "refers_to": 0 if i % 3 == 2 else None}, None if i % 3 == 2 else rng.randbytes(rng.choice((0, 10, 5000)))) for i in range(50)]
    out = io.BytesIO()
    assert warc.write_package(out, iter(pages)) == 50
    for (page, payload), (entry, head, back) in zip(pages, warc.read_package(out, len(out.getvalue())), strict=True):
        assert entry["page_id"] == page["page_id"] and back == (payload or b"") and "X" not in head
        assert head["WARC-Type"] == ("revisit" if payload is None else "response")


def test_archives_of_awkward_pages(spark):
    big, text = "é" * 600, "n" * 2000
    rows = [(1, None, None), (2, "u", big), (9, "u", big), (5, "u", big), (3, "v", "small"), (4, "v", "small"), (None, None, big), (9, "u", big), (2**60 + 1, "w", text)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    got = sorted(map(repr, (tuple(r) for r in warc.read_archives(warc.write_archives(pages)).collect())))
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        to = 9 if h == big and i != 9 else None
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if to else "response", to))
    assert got == sorted(map(repr, want))
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0
    rolled = warc.write_archives(pages.coalesce(1), records=2)
    assert rolled.count() == 5 and sorted(map(repr, (tuple(r) for r in warc.read_archives(rolled).collect()))) == got


def test_many_repeated_payloads_are_joined(spark, monkeypatch):
    rows = [(i, f"u{i}", f"{i % 7} " * 800) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(map(tuple, warc.read_archives(warc.write_archives(pages)).collect()))
    monkeypatch.setattr(warc, "FEW", 2)
    assert sorted(map(tuple, warc.read_archives(warc.write_archives(pages)).collect())) == want and sum(r[3] == "response" for r in want) == 7
