"""MATLAB files of version 5: tagged elements, plain and compressed; numeric, character, cell and sparse arrays."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np

# The format's data types, its classes of arrays, and its flag bits.
NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MATRIX, COMPRESSED, UTF8, UTF16, UTF32 = 14, 15, 16, 17, 18
CELL, STRUCT, OBJECT, CHAR, SPARSE, DOUBLE = 1, 2, 3, 4, 5, 6
CLASSES = {6: "f8", 7: "f4", 8: "i1", 9: "u1", 10: "i2", 11: "u2", 12: "i4", 13: "u4", 14: "i8", 15: "u8"}
COMPLEX = 0x0800


class _Inflated(io.RawIOBase):
    """A compressed element as a stream, inflated as it is read."""

    def __init__(self, handle, size: int):
        self.handle, self.left, self.engine, self.ready = handle, size, zlib.decompressobj(), b""

    def read(self, n: int = -1) -> bytes:
        while len(self.ready) < n and (self.left or self.engine.unconsumed_tail):
            raw = self.engine.unconsumed_tail or self.handle.read(min(self.left, 1 << 16))
            if not self.engine.unconsumed_tail:
                self.left -= len(raw)
                if not raw:
                    raise ValueError("a compressed element ends early")
            self.ready += self.engine.decompress(raw, 1 << 20)
        out, self.ready = self.ready[:n], self.ready[n:]
        return out


class Reader:
    """Elements of a stream in one byte order."""

    def __init__(self, handle, order: str):
        self.handle, self.order = handle, order

    def _exactly(self, n: int) -> bytes:
        out = self.handle.read(n)
        if len(out) < n:
            raise ValueError("the file ends within an element")
        return out

    def tag(self) -> tuple[int, int, bytes | None] | None:
        """(type, bytes, data of a small element); None at the end."""
        raw = self.handle.read(8)
        if len(raw) < 8:
            return None
        first, size = struct.unpack(self.order + "II", raw)
        if first >> 16:  # four bytes at most, in the tag itself
            return first & 0xFFFF, first >> 16, raw[4 : 4 + (first >> 16)]
        return first, size, None

    def data(self) -> tuple[int, bytes]:
        """Type and bytes of an element that is not an array; padding is passed over."""
        found = self.tag()
        if found is None:
            raise ValueError("the file ends within an array")
        kind, size, small = found
        if small is not None:
            return kind, small
        raw = self._exactly(size)
        self._exactly(-size % 8)
        return kind, raw

    def numbers(self) -> np.ndarray:
        kind, raw = self.data()
        if kind in (UTF8, UTF16, UTF32):
            return np.array([ord(c) for c in raw.decode({UTF8: "utf-8", UTF16: "utf-16-le" if self.order == "<" else "utf-16-be", UTF32: "utf-32-le" if self.order == "<" else "utf-32-be"}[kind])], np.uint32)
        if kind not in NUMBERS:
            raise ValueError(f"no numbers of type {kind}")
        return np.frombuffer(raw, self.order + NUMBERS[kind])

    def array(self, size: int) -> tuple[str, object]:
        """Name and value of an array of ``size`` bytes: numbers by columns, texts, lists of cells; others are None."""
        if size == 0:
            return "", np.empty((0, 0))
        flags = int(self.numbers()[0])
        kind = flags & 0xFF
        if kind in (STRUCT, OBJECT) or kind > 15:
            raise _Skipped
        shape = tuple(int(n) for n in self.numbers())
        name = self.data()[1].decode("latin-1")
        if kind == CELL:
            cells = []
            for _ in range(int(np.prod(shape))):
                what, n, _ = self.tag()
                if what != MATRIX:
                    raise ValueError("a cell holds no array")
                cells.append(self.array(n)[1])
            return name, cells
        if kind == SPARSE:
            rows, starts, values = self.numbers(), self.numbers(), self.numbers().astype(float)
            if flags & COMPLEX:
                values = values + 1j * self.numbers()
            out = np.zeros(shape, values.dtype)
            for j in range(shape[1]):
                out[rows[starts[j] : starts[j + 1]], j] = values[starts[j] : starts[j + 1]]
            return name, out
        values = self.numbers()
        if kind == CHAR:
            codes = values.astype(np.uint32).reshape(shape, order="F")
            lines = ["".join(map(chr, row)).rstrip("\0 ") for row in codes] if len(shape) == 2 else []
            return name, lines[0] if len(lines) == 1 else "" if not lines else lines
        values = values.astype(CLASSES[kind])
        if flags & COMPLEX:
            values = values + 1j * self.numbers().astype(CLASSES[kind])
        return name, values.reshape(shape, order="F")


class _Skipped(Exception):
    """An array of a class that is not read."""


def read(handle, wanted: frozenset[str] | None = None) -> Iterator[tuple[str, object]]:
    """(name, value) of a file's variables, one after another; those not ``wanted``, structures and objects are passed over.

    Numbers are arrays, texts strings (a list for several lines), cells lists in column order. A
    compressed variable is inflated as it is read.
    """
    head = handle.read(128)
    if len(head) < 128 or head[126:128] not in (b"IM", b"MI"):
        raise ValueError("not a MATLAB file of version 5")
    order = "<" if head[126:128] == b"IM" else ">"
    top = Reader(handle, order)
    while (found := top.tag()) is not None:
        kind, size, _ = found
        end = handle.tell() + size
        inner = top
        if kind == COMPRESSED:
            inner = Reader(_Inflated(handle, size), order)
            kind, size, _ = inner.tag()
        if kind == MATRIX:
            try:
                name, value = inner.array(size)
                if wanted is None or name in wanted:
                    yield name, value
            except _Skipped:
                pass
        handle.seek(end)


# ---- writing ----


def _element(kind: int, raw: bytes) -> bytes:
    if 0 < len(raw) <= 4:
        return struct.pack("<HH", kind, len(raw)) + raw.ljust(4, b"\0")
    return struct.pack("<II", kind, len(raw)) + raw + bytes(-len(raw) % 8)


def _array(name: str, value) -> bytes:
    """An array element: cells for a list, characters for a text, else numbers."""
    if isinstance(value, list):
        kind, shape, body = CELL, (1, len(value)), b"".join(_array("", x) for x in value)
    elif isinstance(value, str):
        raw = value.encode("utf-16-le")
        kind, shape, body = CHAR, (1, len(raw) // 2), _element(UTF16, raw)
    else:
        x = np.atleast_2d(np.asarray(value))
        code = x.dtype.str[1:]
        kind, shape = {v: k for k, v in CLASSES.items()}[code], x.shape
        body = _element({v: k for k, v in NUMBERS.items()}[code], x.astype("<" + code).tobytes(order="F"))
    head = _element(6, struct.pack("<II", kind, 0)) + _element(5, struct.pack("<ii", *shape)) + _element(1, name.encode("latin-1"))
    return struct.pack("<II", MATRIX, len(head) + len(body)) + head + body


def write(handle, variables: dict[str, object], compress: bool = True) -> None:
    """Write variables (numbers, texts, lists of such) as a file of version 5, each compressed or plain."""
    handle.write(b"MATLAB 5.0 MAT-file".ljust(116) + bytes(8) + struct.pack("<H", 0x0100) + b"IM")
    for name, value in variables.items():
        raw = _array(name, value)
        if compress:
            raw = zlib.compress(raw)
            raw = struct.pack("<II", COMPRESSED, len(raw)) + raw
        handle.write(raw)
