"""Token ids in Simple-8b blocks: packed 64-bit words, escapes, block offsets, a document index."""

from __future__ import annotations

import itertools
import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ragged import running_total
from .common import files, fresh_path, materialize, partitions, put_file, release, text_batches

#: (ids in a word, bits of each) by selector; selector 0 says that the next word is one raw id.
SELECTORS = ((1, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
BLOCK = 1024
SHARD = 4_000_000  # ids of a file, but for the document that goes beyond
TOGETHER = 256  # blocks packed in one go
MAGIC = b"TLS8B\x01\n\x00"


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Pack unsigned ids into words; returns the words and the first word of each block.

    A block holds ``block`` ids (the last one the rest) and is packed on its own.
    """
    words, starts, total = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    for i in range(0, len(ids), TOGETHER * block):
        w, s = _encode(np.ascontiguousarray(ids[i : i + TOGETHER * block], np.uint64), block)
        words.append(w)
        starts.append(s + total)
        total += len(w)
    return np.concatenate(words), np.concatenate(starts)


def _encode(ids: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for as many blocks as fit in memory easily: they advance together, one word at a time, so the greedy choice of selectors is vectorised."""
    n = len(ids)
    nb = -(-n // block)
    grid = np.zeros((nb, block + 128), np.uint64)
    grid[:-1, :block] = ids[: (nb - 1) * block].reshape(nb - 1, block)
    size = np.full(nb, block)
    size[-1] = n - (nb - 1) * block
    grid[-1, : size[-1]] = ids[(nb - 1) * block :]
    best = _choose(grid[:, :block])
    counts = np.array([c for c, _ in SELECTORS])
    # walk: the blocks step from word to word together, which gives each word's place and selector
    at, live = np.zeros(nb, np.int64), np.arange(nb)
    rows, places, sels = [], [], []
    while len(live):
        pos = at[live]
        sel = best[live, pos]
        rows.append(live)
        places.append(pos)
        sels.append(sel)
        at[live] = pos = pos + counts[sel]
        live = live[pos < size[live]]
    row, place, sel = np.concatenate(rows), np.concatenate(places), np.concatenate(sels).astype(np.int64)
    order = np.argsort(row, kind="stable")
    row, place, sel = row[order], place[order], sel[order]
    words = sel.astype(np.uint64) << np.uint64(60)
    flat, base = grid.ravel(), row * grid.shape[1] + place
    for s, (count, bits) in enumerate(SELECTORS):
        if s and bits and len(mine := np.flatnonzero(sel == s)):
            first = base[mine]
            for k in range(count):
                words[mine] |= flat[first + k] << np.uint64(k * bits)
    if (raw := sel == 0).any():
        after = np.flatnonzero(raw) + 1
        words, row = np.insert(words, after, flat[base[raw]]), np.insert(row, after, row[raw])
    return words, np.searchsorted(row, np.arange(nb))


def _choose(grid: np.ndarray) -> np.ndarray:
    """For each place of each block the selector that packs the most ids from there on; 0 is an escape."""
    if grid.max() < 1 << 16:
        bits = _BITS[grid.astype(np.uint16)]
    else:
        bits = np.frexp(grid.astype(np.float64))[1].astype(np.int8)  # rounding may count a bit too many, never too few
        bits[grid == 0] = 0
        bits[grid >= np.uint64(1 << 60)] = 64
    best = np.zeros(grid.shape, np.int8)
    block, run, width = grid.shape[1], 1, bits
    for s in range(len(SELECTORS) - 1, 0, -1):  # from few ids a word to many
        count, most = SELECTORS[s]
        while 2 * run <= count:  # width: the widest id among ``run`` from each place on, none beyond the block
            wide = width.copy()
            if run < block:
                np.maximum(width[:, :-run], width[:, run:], out=wide[:, :-run])
            width, run = wide, 2 * run
        top, far = width, count - run
        if 0 < far < block:
            top = width.copy()
            np.maximum(width[:, :-far], width[:, far:], out=top[:, :-far])
        fits = top <= most
        if not fits.any() and count < block:
            break
        best[fits] = s
    return best


_BITS = np.frexp(np.arange(1 << 16))[1].astype(np.int8)


def decode(words: np.ndarray, starts: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The ``n`` ids of consecutive whole blocks; ``starts`` are the blocks' first words."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    words = np.asarray(words, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    # a raw word after an escape is no selector; with no escape nothing needs a closer look
    raw = np.zeros(len(words), bool)
    if (sel == 0).any():
        i, zero = 0, np.flatnonzero(sel == 0)
        last = -2
        for i in zero:
            if i != last + 1 or not raw[i]:
                if not raw[i]:
                    raw[i + 1] = True
                    last = i
    counts = np.array([c for c, _ in SELECTORS])[sel]
    counts[raw] = 0
    ends = np.append(starts[1:], len(words))
    total = np.concatenate([[0], np.cumsum(counts)])
    first = np.repeat(np.arange(len(starts)) * block - total[starts], ends - starts) + total[:-1]
    payload = words & np.uint64((1 << 60) - 1)
    for s in range(2, len(SELECTORS)):
        count, b = SELECTORS[s]
        mine = np.flatnonzero((sel == s) & ~raw)
        if not len(mine):
            continue
        values = (payload[mine][:, None] >> (np.arange(count, dtype=np.uint64) * np.uint64(b))) & np.uint64((1 << b) - 1)
        place = first[mine][:, None] + np.arange(count)
        limit = np.minimum((first[mine] // block + 1) * block, n)[:, None]
        ok = place < limit
        out[place[ok]] = values[ok]
    if raw.any():
        at = np.flatnonzero(raw)
        out[first[at - 1]] = words[at]
    return out


def write_shard(out, doc_ids: list, lengths: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> None:
    """File: magic, header length, JSON header, document lengths, block offsets, packed words.

    All numbers are little-endian 64-bit; document ids stand in the header since they may be null.
    """
    words, starts = encode(ids, block)
    head = json.dumps({"block": block, "n_ids": len(ids), "n_words": len(words), "n_blocks": len(starts), "doc_ids": doc_ids}).encode()
    out.write(MAGIC + struct.pack("<Q", len(head)) + head)
    out.write(np.asarray(lengths, "<i8").tobytes() + starts.astype("<i8").tobytes() + words.astype("<u8").tobytes())


def read_shard(handle, first: int = 0, last: int | None = None) -> Iterator[tuple[object, np.ndarray]]:
    """(document id, ids) of documents ``first`` to ``last`` of a shard; only their blocks are read."""
    fixed = handle.read(len(MAGIC) + 8)
    if fixed[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token file")
    (size,) = struct.unpack("<Q", fixed[len(MAGIC) :])
    head = json.loads(handle.read(size))
    top, block = len(fixed) + size, head["block"]
    lengths = np.frombuffer(handle.read(8 * len(head["doc_ids"])), "<i8")
    starts = np.frombuffer(handle.read(8 * head["n_blocks"]), "<i8")
    top += 8 * (len(lengths) + len(starts))
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    last = len(lengths) if last is None else min(last, len(lengths))
    group = 1 << 20  # ids decoded at a time
    i = first
    while i < last:
        j = i + 1
        while j < last and bounds[j + 1] - bounds[i] <= group:
            j += 1
        b0, b1 = int(bounds[i] // block), int(-(-bounds[j] // block))
        ids = np.empty(0, np.uint64)
        if b1 > b0:
            w0, w1 = int(starts[b0]), int(starts[b1]) if b1 < len(starts) else head["n_words"]
            handle.seek(top + 8 * w0)
            words = np.frombuffer(handle.read(8 * (w1 - w0)), "<u8")
            ids = decode(words, starts[b0:b1] - w0, min(b1 * block, head["n_ids"]) - b0 * block, block)
        for k in range(i, j):
            yield head["doc_ids"][k], ids[bounds[k] - b0 * block : bounds[k + 1] - b0 * block]
        i = j


#: Where a byte-level BPE always starts a new piece: at a single space between two other characters.
_GAP = re.compile(r"(?<=\S)(?= \S)")
#: White space other than space and newline, where no text is cut without a closer look.
_SPACES = "\t\r\v\f\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
#: Runs that a byte-level BPE keeps apart: letters, digits, marks other than the apostrophe, single newlines.
_RUNS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]+|[!-&(-/:-@\[-`{-~]+|\n")
#: Marks at the end of a word, each a run of its own.
ENDS = frozenset(".,;:?!)\"")
#: Bytes of pieces and ids that an encoder remembers, and the longest piece among them.
_KEPT, _LONG = 16_000_000, 64
_encoders: dict[str, Callable[[list[str]], list[bytes]]] = {}


def kept_encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """One encoder for each file and process: a worker's next task starts with what it remembers."""
    if path not in _encoders:
        _encoders[path] = bpe_encoder(path)
    return _encoders[path]


def bpe_encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """Encoder of a byte-level ``tokenizers`` file: texts to ids as little-endian 32-bit bytes.

    The names of special tokens in a text are ordinary text. Pieces between single spaces are
    encoded once and remembered, as a byte-level BPE never merges across a space that stands
    between two other characters; a text with wider gaps is cut at such spaces alone. A new piece
    of plain runs goes straight to the library's BPE model, run by run; any other goes through the
    whole tokenizer.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    chars = bytes_to_chars()
    packed = [struct.pack("<I", i) for i in range(tok.get_vocab_size())]
    tokenize = tok.model.tokenize

    def whole(text: str) -> bytes:
        return np.array(tok.encode(text, add_special_tokens=False).ids, np.uint32).tobytes() if text else b""

    class Kept(dict):
        """Pieces and their ids, with or without a space before them; a new piece is encoded when it is asked for.

        When they take much memory, a new generation starts and takes over what is asked for
        again. Long pieces are not remembered.
        """

        size = 0

        def __init__(self, space: str, bare: Kept | None, before: dict[str, bytes]):
            self.space, self.bare, self.before = space, bare, before

        def runs(self, piece: str) -> bytes:
            runs = _RUNS.findall(piece)
            if len(runs) == 1 and runs[0] == piece:
                raw = piece if piece.isascii() and piece != "\n" else piece.encode().decode("latin-1").translate(chars)
                return b"".join([packed[t.id] for t in tokenize(self.space + raw)])
            if self.bare is not None and runs and "\n\n" not in piece and "".join(runs) == piece:
                first, *rest = runs
                return self[first] + b"".join(map(self.bare.__getitem__, rest))
            return whole(" " + piece)

        def __missing__(self, piece: str) -> bytes:
            ids = self.before.get(piece)
            if ids is None:
                if piece.isalpha():  # one run of letters, of any script
                    raw = piece if piece.isascii() else piece.encode().decode("latin-1").translate(chars)
                    ids = b"".join([packed[t.id] for t in tokenize(self.space + raw)])
                elif self.bare is not None and piece[-1:] in ENDS and piece[:-1].isalpha():
                    ids = self[piece[:-1]] + self.bare[piece[-1]]
                else:
                    ids = self.runs(piece)
            if len(piece) <= _LONG:
                self[piece] = ids
                self.size += 2 * len(piece) + len(ids)
            return ids

    bare = Kept("", None, {})
    kept = Kept("Ġ", bare, {})

    def run(texts: list[str]) -> list[bytes]:
        nonlocal kept, bare
        if kept.size + bare.size > _KEPT:
            bare.before, kept.before = {}, {}
            bare = Kept("", None, bare)
            kept = Kept("Ġ", bare, kept)
        out = []
        for text in texts:
            if "  " in text or "\n " in text or " \n" in text or text[:1] == " " or text[-1:] == " " or any(c in text for c in _SPACES):
                first, *rest = _GAP.split(text)
                rest = [x[1:] for x in rest]
            else:
                first, *rest = text.split(" ")
            out.append(whole(first) + b"".join(map(kept.__getitem__, rest)))
        return out

    return run


def bytes_to_chars() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for U+0100 onwards."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (b for b in range(256) if b not in plain)
    return {b: 0x100 + i for i, b in enumerate(rest)}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def write_tokens(df: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int | None = 0, shards: int | None = None, folder: str | None = None, most: int = SHARD) -> DataFrame:
    """Encode all texts, write files in ascending order of document id, return the files' table.

    One range shuffle deals documents to tasks (by id, then text and input place, so that equal
    ids can be split); each task tokenizes its range and closes a file when it holds ``most`` ids,
    so a worker's memory follows the file and the longest document, not the task. A file appears
    whole or not at all, under the number of its task and its own. Null ids come first, null texts
    are empty, ``end_id`` closes every document; repeated rows are repeated. The table has (shard,
    path, n_docs, n_ids, start): a row a file.
    """
    spark = df.sparkSession
    text_batches(spark)
    folder = folder or fresh_path(spark, "tokens")
    tokenizer = tokenizer or default_tokenizer()
    src = df.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")).withColumn("at", F.monotonically_increasing_id())
    keys = ["id", "h", "at"]
    src = src.repartitionByRange(shards or partitions(spark), *keys).sortWithinPartitions(*keys)

    def write(batches):
        run = kept_encoder(tokenizer)
        end = b"" if end_id is None else struct.pack("<I", end_id)
        task, file = TaskContext.get().partitionId(), 0
        doc_ids, lengths, parts, n = [], [], [], 0

        def close():
            nonlocal file, n
            ids = np.frombuffer(b"".join(parts), "<u4")
            path = f"{folder}/shard-{task:06d}-{file:06d}.s8b"
            put_file(path, lambda out: write_shard(out, doc_ids, np.array(lengths), ids))
            row = {"shard": [(task << 24) + file], "path": [path], "n_docs": [len(doc_ids)], "n_ids": [len(ids)]}
            for x in (doc_ids, lengths, parts):
                x.clear()
            file, n = file + 1, 0
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            texts = batch.column("text")
            for i in range(0, len(texts), 64):
                for doc, ids in zip(batch.column("id").slice(i, 64).to_pylist(), run(texts.slice(i, 64).to_pylist()), strict=True):
                    doc_ids.append(doc)
                    lengths.append((len(ids) + len(end)) // 4)
                    parts += [ids, end]
                    n += lengths[-1]
                    if n >= most:
                        yield close()
        if doc_ids:
            yield close()
        release()

    rows = src.select("id", "text").mapInArrow(write, "shard long, path string, n_docs long, n_ids long")
    return _started(materialize(rows, "token-files"))


def _started(files: DataFrame) -> DataFrame:
    """Add ``start``, the ids of all files before: a running sum over the files' table alone."""
    total = running_total(files, "shard", "n_ids", "start")
    return total.select("shard", "path", "n_docs", "n_ids", F.col("start").cast("long").alias("start"))


def read_tokens(shards: DataFrame, id_type: str = "long") -> DataFrame:
    """Documents of the files: (doc_id, start, n_tokens, ids_crc32), read from them.

    A task reads files one after another by ranges of blocks and gives up to 10,000 documents at a
    time. Null ids come back null, empty texts with their end id; without files there are no rows.
    """

    def read(batches):
        for batch in batches:
            for row in batch.itertuples():
                system, path = files(row.path)
                start = row.start
                with system.open_input_file(path) as handle:
                    docs = read_shard(handle)
                    while some := list(itertools.islice(docs, 10_000)):
                        n = np.array([len(ids) for _, ids in some])
                        frame = pd.DataFrame({"doc_id": pd.array([d for d, _ in some], "Int64" if id_type == "long" else object), "start": start + np.cumsum(n) - n, "n_tokens": n})
                        frame["ids_crc32"] = [zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in some]
                        start += int(n.sum())
                        yield frame

    return shards.repartition(max(1, partitions(shards.sparkSession)), "path").mapInPandas(read, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")
