"""MATLAB files: made by hand, round trips, and floats read from them."""

import io
import struct
import zlib

import numpy as np
import pytest

from tracklake.model import OBS, ROW
from tracklake.sources import matlab, providers


def loaded(raw, wanted=None):
    return dict(matlab.read(io.BytesIO(raw), wanted))


def header(order="<"):
    return b"by hand".ljust(124) + struct.pack(order + "H", 0x0100) + (b"IM" if order == "<" else b"MI")


def array(order, kind, flags, shape, name, *parts):
    """An array element by hand; parts are (type, bytes) or finished elements."""
    el = lambda k, raw: struct.pack(order + "II", k, len(raw)) + raw + bytes(-len(raw) % 8)
    body = el(6, struct.pack(order + "II", kind | flags, 0)) + el(5, struct.pack(f"{order}{len(shape)}i", *shape)) + el(1, name)
    body += b"".join(p if isinstance(p, bytes) else el(*p) for p in parts)
    return struct.pack(order + "II", 14, len(body)) + body


@pytest.mark.parametrize("order", ["<", ">"])
def test_elements_by_hand(order):
    small = struct.pack(order + "I", 2 << 16 | 2) + bytes([7, 9, 0, 0])  # two bytes in the tag itself
    plain = array(order, 6, 0, (2, 3), b"m", (9, struct.pack(order + "6d", 1, 2, 3, 4, 5, 6)))
    bytes_ = array(order, 6, 0, (1, 2), b"small", small)  # doubles kept as bytes
    text = array(order, 4, 0, (1, 3), b"text", (4, struct.pack(order + "3H", 97, 233, 99)))
    two = array(order, 4, 0, (2, 2), b"lines", (2, b"abxy"))
    cells = array(order, 1, 0, (1, 2), b"cells", array(order, 4, 0, (1, 1), b"", (16, b"q")), array(order, 6, 0, (0, 0), b"", (9, b"")))
    sparse = array(order, 5, 0, (3, 2), b"sparse", (5, struct.pack(order + "2i", 2, 0)), (5, struct.pack(order + "3i", 0, 1, 2)), (9, struct.pack(order + "2d", 5, 6)))
    odd = array(order, 2, 0, (1, 1), b"structure", (5, b"abcd"))
    rotary = array(order, 6, 0x0800, (1, 1), b"z", (9, struct.pack(order + "d", 1)), (9, struct.pack(order + "d", -2)))
    squeezed = zlib.compress(array(order, 12, 0, (1, 2), b"late", (5, struct.pack(order + "2i", -1, 8))))
    got = loaded(header(order) + plain + bytes_ + text + two + cells + sparse + odd + rotary + struct.pack(order + "II", 15, len(squeezed)) + squeezed)
    assert got["m"].tolist() == [[1, 3, 5], [2, 4, 6]] and got["small"].tolist() == [[7, 9]]
    assert got["text"] == "a\u00e9c" and got["lines"] == ["ax", "by"]
    assert got["cells"][0] == "q" and got["cells"][1].size == 0
    assert got["sparse"].tolist() == [[0, 6], [0, 0], [5, 0]] and got["z"].tolist() == [[1 - 2j]]
    assert got["late"].dtype == np.int32 and got["late"].tolist() == [[-1, 8]] and "structure" not in got


@pytest.mark.parametrize("compress", [False, True])
def test_round_trip(compress):
    rng = np.random.default_rng(2)
    values = {"x": rng.normal(size=(3, 70_000)), "n": np.arange(5, dtype="i4"), "f": np.array([[1.5]], "f4"), "t": "text \u00e9 \u65e5", "e": "", "c": [np.arange(3.0), "a", [np.arange(2.0), "b"], np.empty((0, 0))]}
    out = io.BytesIO()
    matlab.write(out, values, compress)
    got = loaded(out.getvalue())
    assert list(got) == list(values)
    assert np.array_equal(got["x"], values["x"]) and got["n"].tolist() == [[0, 1, 2, 3, 4]] and got["f"].dtype == np.float32 and got["t"] == values["t"] and got["e"] == ""
    assert got["c"][0].tolist() == [[0, 1, 2]] and got["c"][1] == "a" and got["c"][2][1] == "b" and got["c"][3].size == 0
    assert list(loaded(out.getvalue(), frozenset({"n"}))) == ["n"]


def test_broken_files():
    with pytest.raises(ValueError, match="version 5"):
        loaded(b"x" * 200)
    out = io.BytesIO()
    matlab.write(out, {"x": np.arange(1000.0)}, False)
    with pytest.raises(ValueError, match="ends"):
        loaded(out.getvalue()[:-100])


def test_floats(spark, tmp_path):
    """Two files with three floats; experiments of the first stand out of order, a vector is short, an optional variable is absent."""
    day = 719529.0  # 1970-01-01
    first = {
        "dtnum": [np.array([[day], [day + 1], [day + 2]]), np.array([[day + 5.5]])], "lon": [np.array([1.0, 2.0, 3.0]), np.array([9.0])], "lat": [np.array([4.0, 5.0]), np.array([8.0])], "p": [np.array([10.0, 11.0, 12.0]), np.empty((0, 0))],
        "expList": ["one", "two"], "indexExp": np.array([7.0, 3.0]), "indexFlt": np.array([1.0, 2.0]), "expName": [["deep"], "flat"], "fltType": ["SOFAR", np.empty((0, 0))],
    }
    second = {"dtnum": [np.array([day])], "lon": [np.array([5.0])], "expList": ["three"], "indexExp": np.array([4.0]), "indexFlt": np.array([3.0])}
    for name, content, how in (("a", first, True), ("b", second, False)):
        with open(tmp_path / f"{name}.mat", "wb") as f:
            matlab.write(f, content, how)
    f = providers.subsurface_mat(spark, [str(tmp_path / "a.mat"), str(tmp_path / "b.mat")])
    rows = [(r[ROW], r.rowsize, r.indexFlt, r.indexExp, r.expList, r.expName, r.fltType) for r in f.rows.orderBy(ROW).collect()]
    assert rows == [(0, 3, 1, 7, "two", "deep", "SOFAR"), (1, 1, 2, 3, "one", "flat", None), (2, 1, 3, 4, "three", None, None)]
    obs = [(r[ROW], r[OBS], r.time.isoformat(), r.lon, r.lat, r.pres, r.temp) for r in f.obs.orderBy(ROW, OBS).collect()]
    assert obs == [
        (0, 0, "1970-01-01T00:00:00", 1.0, 4.0, 10.0, None), (0, 1, "1970-01-02T00:00:00", 2.0, 5.0, 11.0, None), (0, 2, "1970-01-03T00:00:00", 3.0, None, 12.0, None),
        (1, 0, "1970-01-06T12:00:00", 9.0, 8.0, None, None), (2, 0, "1970-01-01T00:00:00", 5.0, None, None, None),
    ]
