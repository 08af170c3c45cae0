"""WARC records in ZIP packages: written as stored members with an index, read back by byte ranges."""

from __future__ import annotations

import gzip
import hashlib
import itertools
import json
import struct as packing
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import files, fresh_path, materialize, partitions, put_file, struct, text_batches

LEAST = 1000  # bytes from which equal payloads are stored once
DATA, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
DATE = "2020-01-01T00:00:00Z"
RANGE = 8 << 20  # bytes of neighbouring records fetched at a time
PACKAGE, RECORDS = 1 << 30, 50_000  # bytes and records of a package at most
FEW = 200_000  # repeated digests that are broadcast
CLEAN = {i: f"%{i:02X}" for i in [*range(0x21), 0x7F]}


# ---- records ----


def record(page: dict, payload: bytes | None) -> bytes:
    """One record as a gzip member; ``payload`` None makes a revisit of ``page["refers_to"]``."""
    head = {
        "WARC-Type": "revisit" if payload is None else "response",
        "WARC-Record-ID": f"<urn:page:{page['page_id']}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": (page["url"] or "").translate(CLEAN),
        "WARC-Payload-Digest": f"sha1:{page['digest']}",
        "Content-Type": "application/http;msgtype=response",
    }
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if payload is None:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{page['refers_to']}>", "X-Payload-Length": str(page["bytes"])}
    else:
        body += payload
    head["Content-Length"] = str(len(body))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return gzip.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + body + b"\r\n\r\n", 1, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record."""
    raw = gzip.decompress(member)
    top, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = top.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = dict(x.split(": ", 1) for x in lines)
    return head, rest[: int(head["Content-Length"])].partition(b"\r\n\r\n")[2]


# ---- ZIP directories ----


def directory(handle, size: int) -> dict[str, tuple[int, int, int]]:
    """Members of a ZIP file as (method, first byte of data, bytes), from its central directory.

    The end record gives the directory's place; where a field of it or of an entry is all ones,
    the ZIP64 end record or the entry's ZIP64 extra field gives the number instead.
    """
    tail_at = max(0, size - 65_557 - 20)
    handle.seek(tail_at)
    tail = handle.read(size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    n, length, offset = packing.unpack_from("<HII", tail, end + 10)
    if (n == 0xFFFF or length == 0xFFFFFFFF or offset == 0xFFFFFFFF) and end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":
        handle.seek(packing.unpack_from("<Q", tail, end - 12)[0])
        far = handle.read(56)
        if far[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        n, length, offset = packing.unpack_from("<QQQ", far, 32)
    handle.seek(offset)
    raw = handle.read(length)
    out, at = {}, 0
    for _ in range(n):
        if raw[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, _, _, _, packed, plain, name_len, extra_len, note_len, _, _, _, local = packing.unpack_from("<HHHIIIHHHHHII", raw, at + 10)
        name = raw[at + 46 : at + 46 + name_len].decode()
        extra = raw[at + 46 + name_len : at + 46 + name_len + extra_len]
        e = 0
        while e + 4 <= len(extra):
            kind, size_of = packing.unpack_from("<HH", extra, e)
            if kind == 1:
                field = e + 4
                if plain == 0xFFFFFFFF:
                    plain, field = packing.unpack_from("<Q", extra, field)[0], field + 8
                if packed == 0xFFFFFFFF:
                    packed, field = packing.unpack_from("<Q", extra, field)[0], field + 8
                if local == 0xFFFFFFFF:
                    local = packing.unpack_from("<Q", extra, field)[0]
            e += 4 + size_of
        handle.seek(local)
        head = handle.read(30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("broken member header")
        skip = sum(packing.unpack_from("<HH", head, 26))
        out[name] = (method, local + 30 + skip, packed)
        at += 46 + name_len + extra_len + note_len
    return out


def write_package(out, pages: Iterator[tuple[dict, bytes | None]], most: int = PACKAGE, records: int = RECORDS) -> int:
    """A ZIP of one stored member of records and one stored member with their byte ranges; returns the number of records.

    It takes pages until it holds ``most`` bytes or ``records`` records; the others stay in ``pages``.
    """
    index, at = [], 0
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        with z.open(zipfile.ZipInfo(DATA), "w", force_zip64=True) as data:
            while at < most and len(index) < records and (pair := next(pages, None)) is not None:
                page, payload = pair
                member = record(page, payload)
                data.write(member)
                index.append(json.dumps({"page_id": page["page_id"], "refers_to": page["refers_to"], "offset": at, "length": len(member)}))
                at += len(member)
        with z.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as lines:
            lines.write("\n".join(index).encode())
    return len(index)


def read_package(handle, size: int) -> Iterator[tuple[dict, dict[str, str], bytes]]:
    """(index entry, headers, payload) of each record, by ranges of the stored members; nothing is extracted."""
    members = directory(handle, size)
    for name in (DATA, INDEX):
        if members[name][0] != 0:
            raise ValueError(f"{name} is not stored")
    _, at, length = members[INDEX]
    handle.seek(at)
    entries = [json.loads(x) for x in handle.read(length).splitlines()]
    _, data, _ = members[DATA]
    i = 0
    while i < len(entries):
        j, first = i + 1, entries[i]["offset"]
        while j < len(entries) and entries[j]["offset"] + entries[j]["length"] - first <= RANGE:
            j += 1
        handle.seek(data + first)
        raw = handle.read(entries[j - 1]["offset"] + entries[j - 1]["length"] - first)
        for e in entries[i:j]:
            yield e, *parse(raw[e["offset"] - first : e["offset"] - first + e["length"]])
        i = j


# ---- tables ----


def assign(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, html, digest, bytes, refers_to): which record a page becomes.

    Of pages with equal payloads of at least 1,000 bytes the largest page_id is stored and the
    others refer to it and lose their html. Digests that repeat are aggregated and written, a row
    each, however many pages share one. Up to 200,000 of them are broadcast and html stays where
    it is; more are joined, with an exchange on either side, so that Spark splits a hot payload.
    Rows that repeat the largest page_id are all stored; null ids refer to it, and if all ids are
    null all rows are stored. Null html is empty.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    src = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), body.alias("html"), F.sha1(F.encode(body, "UTF-8")).alias("digest"), F.octet_length(body).cast("long").alias("bytes"))
    first = src.filter(F.col("bytes") >= LEAST).groupBy(F.col("digest").alias("of"), F.col("bytes").alias("of_bytes")).agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND first IS NOT NULL").drop("n")
    first = materialize(first, "repeated")
    few = F.broadcast if first.count() <= FEW else (lambda d: d)
    joined = src.join(few(first), (F.col("digest") == F.col("of")) & (F.col("bytes") == F.col("of_bytes")), "left")
    to = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", F.when(to.isNull(), F.col("html")).alias("html"), "digest", "bytes", to.alias("refers_to"))


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", folder: str | None = None, most: int = PACKAGE, records: int = RECORDS) -> DataFrame:
    """Write all pages to packages of up to ``most`` bytes and ``records`` records; returns (path, records), a row a package.

    A package appears whole or not at all, under the number of its task and its own; a worker
    holds one package's index and one page. Page ids are integers or null. Repeated rows are
    repeated records, in the order of their partition.
    """
    spark = pages.sparkSession
    text_batches(spark)
    folder = folder or fresh_path(spark, "warc")

    def write(frames):
        def rows():
            for frame in frames:
                for p, u, h, d, b, to in zip(*(frame[c] for c in ("page_id", "url", "html", "digest", "bytes", "refers_to")), strict=True):
                    yield {"page_id": None if pd.isna(p) else int(p), "url": u, "digest": d, "bytes": int(b), "refers_to": None if pd.isna(to) else int(to)}, None if h is None else h.encode("utf-8", "surrogatepass")

        left, file = rows(), 0
        while (head := next(left, None)) is not None:
            n = 0

            def save(out):
                nonlocal n
                n = write_package(out, whole, most, records)

            whole = itertools.chain([head], left)
            path = f"{folder}/part-{TaskContext.get().partitionId():06d}-{file:06d}.zip"
            put_file(path, save)
            file += 1
            yield pd.DataFrame({"path": [path], "records": [n]})

    # one id column may hold nulls, which pandas would turn into inexact floats
    src = assign(pages, page_id, url, html).withColumn("page_id", F.col("page_id").cast("string")).withColumn("refers_to", F.col("refers_to").cast("string"))
    return materialize(src.mapInPandas(write, struct("path string, records long")), "packages")


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of all records, from the packages.

    Responses are measured and hashed from their payloads; a revisit's figures stand in its headers.
    A task reads packages one after another, by ranges. Null ids come back null; without packages
    there are no rows.
    """

    def read(frames):
        for frame in frames:
            for path in frame["path"]:
                system, name = files(path)
                out = []
                with system.open_input_file(name) as handle:
                    for entry, head, payload in read_package(handle, handle.size()):
                        kind = head["WARC-Type"]
                        if kind == "response":
                            n, digest = len(payload), hashlib.sha1(payload).hexdigest()
                            if head["WARC-Payload-Digest"] != f"sha1:{digest}":
                                raise ValueError(f"page {entry['page_id']}: payload and digest differ")
                        else:
                            n, digest = int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
                        out.append((entry["page_id"], n, digest, kind, entry["refers_to"]))
                frame_out = pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], dtype=object)
                yield frame_out.astype({"page_id": "Int64", "payload_bytes": "int64", "refers_to": "Int64"})

    return archives.repartition(max(1, partitions(archives.sparkSession)), "path").mapInPandas(read, struct("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"))
