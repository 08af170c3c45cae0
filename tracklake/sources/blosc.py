"""Blosc frames (version 1): the chunks of published array archives, packed and unpacked.

A frame is a header of 16 bytes, the places of its blocks, and the blocks: each a stream, or a
stream for each byte of an element, with a length before it. Blocks were shuffled by bytes or by
bits before they were packed.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

# The bits of the flags, the codecs by their number, the limits of splitting.
BYTES, COPIED, BITS, WHOLE = 0x01, 0x02, 0x04, 0x10
CODECS = {0: "blosclz", 1: "lz4", 2: "snappy", 3: "zlib", 4: "zstd"}
MOST_STREAMS, LEAST_STREAM = 16, 128
HEADER, HEADER_SIZE = "<BBBBIII", 16
ARROW = {"lz4": "lz4_raw", "snappy": "snappy", "zstd": "zstd"}


def _streams(flags: int, size: int, block: int, length: int) -> int:
    """Into how many streams a block of ``length`` bytes is split."""
    return size if not flags & WHOLE and length == block and size <= MOST_STREAMS and block // size >= LEAST_STREAM else 1


def _inflate(codec: str, raw: bytes, size: int) -> bytes:
    import pyarrow as pa

    return zlib.decompress(raw) if codec == "zlib" else pa.Codec(ARROW[codec]).decompress(raw, size, asbytes=True)


def _deflate(codec: str, raw: bytes, level: int) -> bytes:
    import pyarrow as pa

    if codec == "zlib":
        return zlib.compress(raw, level)
    return (pa.Codec("zstd", compression_level=level) if codec == "zstd" else pa.Codec(ARROW[codec])).compress(raw, asbytes=True)


def shuffled(block: bytes, size: int, flags: int) -> bytes:
    """A block with the first bytes (or bits) of all elements first; what fills no element stays at the end."""
    n = len(block) // size
    body, rest = np.frombuffer(block[: n * size], np.uint8).reshape(n, size), block[n * size :]
    if flags & BYTES and size > 1:
        return body.T.tobytes() + rest
    if flags & BITS and n % 8 == 0:
        bits = np.unpackbits(body[:, :, None], axis=2, bitorder="little")
        return np.packbits(bits.transpose(1, 2, 0), axis=2, bitorder="little").tobytes() + rest
    return block


def unshuffled(block: bytes, size: int, flags: int) -> bytes:
    n = len(block) // size
    body, rest = np.frombuffer(block[: n * size], np.uint8), block[n * size :]
    if flags & BYTES and size > 1:
        return body.reshape(size, n).T.tobytes() + rest
    if flags & BITS and n % 8 == 0 and n:
        bits = np.unpackbits(body.reshape(size, 8, n // 8), axis=2, bitorder="little")
        return np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little").tobytes() + rest
    return block


def decode(frame: bytes) -> bytes:
    """The bytes that a frame holds."""
    if len(frame) < HEADER_SIZE:
        raise ValueError("a Blosc frame has 16 bytes at least")
    _, _, flags, size, length, block, packed = struct.unpack_from(HEADER, frame)
    if packed > len(frame):
        raise ValueError(f"a Blosc frame of {packed} bytes ends after {len(frame)}")
    if flags & COPIED:
        return bytes(frame[HEADER_SIZE : HEADER_SIZE + length])
    codec = CODECS.get(flags >> 5, "?")
    if codec != "zlib" and codec not in ARROW:
        raise ValueError(f"no decoder for Blosc frames packed by {codec}")
    blocks = -(-length // block) if length else 0
    out = []
    for i, at in enumerate(struct.unpack_from(f"<{blocks}I", frame, HEADER_SIZE)):
        n = min(block, length - i * block)
        streams = _streams(flags, size, block, n)
        parts = []
        for _ in range(streams):
            (k,) = struct.unpack_from("<I", frame, at)
            raw = frame[at + 4 : at + 4 + k]
            parts.append(raw if k == n // streams else _inflate(codec, raw, n // streams))
            at += 4 + k
        out.append(unshuffled(b"".join(parts), size, flags))
    return b"".join(out)


def encode(raw: bytes, size: int = 1, codec: str = "lz4", shuffle: str = "bytes", level: int = 5, block: int = 1 << 18) -> bytes:
    """A frame of ``raw``, whose elements have ``size`` bytes; ``shuffle`` is bytes, bits or none.

    A stream that does not shrink is stored as it is, and so is a frame of which none does.
    """
    block = max(size, min(block, len(raw)) // (8 * size) * 8 * size or size)
    flags = {"bytes": BYTES, "bits": BITS, "none": 0}[shuffle] | {v: k for k, v in CODECS.items()}[codec] << 5
    if codec in ("zlib", "zstd") or size > MOST_STREAMS or block // size < LEAST_STREAM:
        flags |= WHOLE
    blocks = [raw[i : i + block] for i in range(0, len(raw), block)]
    at, starts, body = HEADER_SIZE + 4 * len(blocks), [], []
    for b in blocks:
        starts.append(at)
        mixed, n = shuffled(b, size, flags), _streams(flags, size, block, len(b))
        for k in range(n):
            piece = mixed[k * len(b) // n : (k + 1) * len(b) // n]
            packed = _deflate(codec, piece, level)
            kept = packed if len(packed) < len(piece) else piece
            body.append(struct.pack("<I", len(kept)) + kept)
            at += len(body[-1])
    if at >= HEADER_SIZE + len(raw):
        return struct.pack(HEADER, 2, 1, flags | COPIED, size, len(raw), block, HEADER_SIZE + len(raw)) + raw
    return struct.pack(HEADER, 2, 1, flags, size, len(raw), block, at) + struct.pack(f"<{len(starts)}I", *starts) + b"".join(body)
