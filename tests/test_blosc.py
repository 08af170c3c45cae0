"""Blosc frames: made by hand, of each codec and shuffle, and round trips."""

import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tracklake.sources import blosc

LZ4 = pa.Codec("lz4_raw")


def by_hand(streams, flags, size, length, block):
    """A frame of blocks, each a list of (bytes in the frame); written without the library's encoder."""
    at, starts, body = 16 + 4 * len(streams), [], b""
    for parts in streams:
        starts.append(at + len(body))
        body += b"".join(struct.pack("<I", len(p)) + p for p in parts)
    head = bytes([2, 1, flags, size]) + struct.pack("<III", length, block, at + len(body))
    return head + struct.pack(f"<{len(starts)}I", *starts) + body


def test_split_streams_of_shuffled_bytes_by_hand():
    """A block of 1,024 bytes in four streams, and a shorter last block in one."""
    values = np.arange(300, dtype="<u4")
    raw = values.tobytes()
    planes = [raw[:1024][k::4] for k in range(4)]
    last = b"".join(raw[1024:][k::4] for k in range(4))
    packed = [LZ4.compress(p, asbytes=True) for p in planes]
    kept = [c if len(c) < 256 else p for c, p in zip(packed, planes, strict=True)]
    assert kept[0] == planes[0] and kept[3] != planes[3]  # the low bytes do not shrink, the high ones do
    frame = by_hand([kept, [LZ4.compress(last, asbytes=True)]], 0x01 | 1 << 5, 4, 1200, 1024)
    assert blosc.decode(frame) == raw


@pytest.mark.parametrize(("number", "pack"), [(1, lambda x: LZ4.compress(x, asbytes=True)), (2, lambda x: pa.Codec("snappy").compress(x, asbytes=True)), (3, zlib.compress), (4, lambda x: pa.Codec("zstd").compress(x, asbytes=True))])
def test_each_codec_in_one_stream_by_hand(number, pack):
    raw = b"the same words, " * 200
    assert blosc.decode(by_hand([[pack(raw)]], 0x10 | number << 5, 8, len(raw), len(raw))) == raw


def test_bits_by_hand():
    """Eight elements of two bytes: bit k of byte j of all of them is one byte."""
    values = np.array([1, 2, 3, 4, 256, 512, 1024, 65535], "<u2")
    mixed = bytes(sum(((int(v) >> (8 * j + k)) & 1) << i for i, v in enumerate(values)) for j in range(2) for k in range(8))
    assert blosc.shuffled(values.tobytes(), 2, blosc.BITS) == mixed
    assert blosc.decode(by_hand([[mixed]], 0x04 | 0x10 | 1 << 5, 2, 16, 16)) == values.tobytes()
    odd = values[:7].tobytes()
    assert blosc.shuffled(odd, 2, blosc.BITS) == odd  # a count of elements that eight does not divide stays


def test_copied_and_broken_frames():
    raw = bytes(range(256))
    assert blosc.decode(bytes([2, 1, 0x02 | 1 << 5, 4]) + struct.pack("<III", 256, 256, 272) + raw) == raw
    with pytest.raises(ValueError, match="16 bytes"):
        blosc.decode(b"abc")
    with pytest.raises(ValueError, match="ends after"):
        blosc.decode(blosc.encode(raw * 50, 4)[:-5])
    with pytest.raises(ValueError, match="blosclz"):
        blosc.decode(by_hand([[b"x"]], 0x10, 1, 9, 9))


@pytest.mark.parametrize("codec", ["lz4", "zstd", "zlib", "snappy"])
@pytest.mark.parametrize("shuffle", ["bytes", "bits", "none"])
@pytest.mark.parametrize("size", [1, 2, 4, 8, 20, 32])
def test_round_trips(codec, shuffle, size):
    rng = np.random.default_rng(size)
    for n in (0, 1, 7, size, 1000, 4096 * size, 4096 * size + 3, 40_001):
        for raw in (bytes(n), rng.bytes(n), np.arange(n // 8 + 1, dtype="<f8").tobytes()[:n]):
            for block in (1 << 12, 1 << 18):
                frame = blosc.encode(raw, size, codec, shuffle, block=block)
                assert blosc.decode(frame) == raw
                assert len(frame) <= 16 + len(raw)
