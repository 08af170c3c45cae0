"""Functions of whole rows: map, reduce, several outputs; and the row kernels as operators."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sphere import EARTH_ROTATION_RATE
from ..model import OBS, ROW, RaggedFrame
from ..scratch import materialize
from . import signals, transfer


def _chosen(frame: RaggedFrame, columns: Sequence[str], rows: Sequence[int] | None) -> DataFrame:
    obs = frame.obs.select(ROW, OBS, *columns)
    return obs if rows is None else obs.filter(obs[ROW].isin(list(rows)))


def _array(pdf: pd.DataFrame, column: str) -> np.ndarray:
    """Values of a row; array columns give an axis more, with the observations first."""
    values = pdf[column].to_numpy()
    return np.stack(values) if len(values) and isinstance(values[0], np.ndarray) else values


def map_rows(frame: RaggedFrame, function: Callable, columns: Sequence[str], outputs: str | Sequence[str], *args, rows: Sequence[int] | None = None, kind: str = "double", **kwargs) -> DataFrame:
    """(row_idx, obs_idx, outputs): a function of a row's columns that gives one array (or a tuple of arrays) of its length.

    Each row is one group and goes to one task with its observations in order; ``rows`` selects
    rows before anything is moved. Complex results become name_re and name_im. Values may be arrays
    of one length: the function sees them with the observations as first axis, and may give such
    back (``kind`` array<double>).
    """
    names = [outputs] if isinstance(outputs, str) else list(outputs)
    parts = [f"{n}_{p}" for n in names for p in ("re", "im")] if kind == "complex" else names
    schema = f"{ROW} long, {OBS} long, " + ", ".join(f"`{n}` {'double' if kind == 'complex' else kind}" for n in parts)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(OBS)
        out = function(*(_array(pdf, c) for c in columns), *args, **kwargs)
        out = out if isinstance(out, tuple) else (out,)
        data = {ROW: pdf[ROW].to_numpy(), OBS: pdf[OBS].to_numpy()}
        for name, values in zip(names, out, strict=True):
            values = np.asarray(values)
            if len(values) != len(pdf):
                raise ValueError(f"{len(values)} values for {len(pdf)} observations")
            data |= {f"{name}_re": values.real, f"{name}_im": values.imag} if kind == "complex" else {name: list(values) if values.ndim > 1 else values}
        return pd.DataFrame(data)

    return _chosen(frame, columns, rows).groupBy(ROW).applyInPandas(run, schema)


def reduce_rows(frame: RaggedFrame, function: Callable, columns: Sequence[str], outputs: str | Sequence[str], *args, rows: Sequence[int] | None = None, kind: str = "double", **kwargs) -> DataFrame:
    """(row_idx, outputs): a function of a row's columns that gives one value (or a tuple of values)."""
    names = [outputs] if isinstance(outputs, str) else list(outputs)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(OBS)
        out = function(*(_array(pdf, c) for c in columns), *args, **kwargs)
        return pd.DataFrame([[pdf[ROW].iloc[0], *(out if isinstance(out, tuple) else (out,))]], columns=[ROW, *names])

    return _chosen(frame, columns, rows).groupBy(ROW).applyInPandas(run, f"{ROW} long, " + ", ".join(f"`{n}` {kind}" for n in names))


def expand_rows(frame: RaggedFrame, function: Callable[..., pd.DataFrame], columns: Sequence[str], schema: str) -> DataFrame:
    """(row_idx, schema): a function of a row's columns that gives any number of records."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(OBS)
        out = function(*(_array(pdf, c) for c in columns))
        out.insert(0, ROW, pdf[ROW].iloc[0])
        return out

    return _chosen(frame, columns, None).groupBy(ROW).applyInPandas(run, f"{ROW} long, {schema}")


# ---- rows of any length ----

#: A row of more places is cut into blocks of as many, with halos, for different tasks.
BLOCK = 1 << 16


def _long(frame: RaggedFrame, most: int) -> DataFrame | None:
    """(row_idx, n) of rows of more than ``most`` observations, written; None where there is none, as mostly."""
    known = frame.rows.select(ROW, F.col("rowsize").cast("long").alias("n")) if "rowsize" in frame.rows.columns else frame.obs.groupBy(ROW).agg(F.count(F.lit(1)).alias("n"))
    found = materialize(known.filter(F.col("n") > most), "long-rows")
    return found if found.limit(1).count() else None


def _cut_evenly(frame: RaggedFrame, reach: int | None, size: int) -> DataFrame | None:
    """(row_idx, n, reach, block) of rows that are cut into blocks of ``size`` with one halo; None where none is or no halo is enough."""
    found = None if reach is None else _long(frame, 2 * size)
    return None if found is None else found.select(ROW, "n", F.lit(reach).cast("long").alias("reach"), F.lit(size).cast("long").alias("block"))


def _blocks(frame: RaggedFrame, columns: Sequence[str], long_rows: DataFrame | None, boundary: str, held: Sequence[str] = ()) -> DataFrame:
    """(row_idx, part, place, n, reach, block, columns), dealt by row and part, in order: short rows as they are (part -1), long rows by block.

    A place goes to its block and to those in whose halo it is; beyond a row's ends stand its
    places again, mirrored or from the other end, as ``boundary`` says. A block's task gets the
    block and its halos alone, so a row of any length is spread over as many tasks as it has
    blocks. The records of rows that are cut are written, and broadcast if Spark finds them small.
    """
    obs = frame.obs.select(ROW, OBS, *columns)
    if long_rows is None:
        none = [F.lit(None).cast("long").alias(c) for c in ("n", "reach", "block")] + [F.lit(None).cast("double").alias(c) for c in held]
        spread = obs.select(ROW, F.lit(-1).cast("long").alias("part"), F.col(OBS).alias("place"), *none, *columns)
    else:
        n, reach, size, at = F.col("n"), F.col("reach"), F.col("block"), F.col(OBS)
        again = {"mirror": (-1 - at, 2 * n - 1 - at), "periodic": (at - n, at + n), "zeros": ()}[boundary]
        places = F.filter(F.array(at, *again), lambda p: (p >= -reach) & (p < n + reach))
        spread = obs.join(long_rows, ROW, "left").withColumn("place", F.explode(F.when(n.isNull(), F.array(at)).otherwise(places)))
        place, last = F.col("place"), F.floor((n - 1) / size)
        parts = F.sequence(F.greatest(F.lit(0), F.floor((place - reach) / size)), F.least(last, F.floor((place + reach) / size)))
        spread = spread.withColumn("part", F.explode(F.when(n.isNull(), F.array(F.lit(-1).cast("long"))).otherwise(parts)))
    return spread.select(ROW, "part", "place", "n", "reach", "block", *held, *columns).repartition(ROW, "part").sortWithinPartitions(ROW, "part", "place")


def _groups(frames: Iterator[pd.DataFrame], columns: Sequence[str]) -> Iterator[list[tuple[int, int, dict[str, np.ndarray]]]]:
    """The (row, part, columns) that are complete after each batch of sorted records."""
    held: list[dict] = []
    last = None
    for pdf in frames:
        if not len(pdf):
            continue
        rows, parts = pdf[ROW].to_numpy(), pdf["part"].to_numpy()
        values = {c: pdf[c].to_numpy() for c in columns}
        cuts = [0, *(np.flatnonzero((rows[1:] != rows[:-1]) | (parts[1:] != parts[:-1])) + 1).tolist(), len(pdf)]
        done = []
        for a, b in itertools.pairwise(cuts):
            key = int(rows[a]), int(parts[a])
            if held and key != last:
                done.append((*last, _together(held)))
                held = []
            held.append({c: v[a:b] for c, v in values.items()})
            last = key
        if done:
            yield done
    if held:
        yield [(*last, _together(held))]


def _together(pieces: list[dict]) -> dict[str, np.ndarray]:
    return pieces[0] if len(pieces) == 1 else {c: np.concatenate([p[c] for p in pieces]) for c in pieces[0]}


def _stretch(part: int, data: dict[str, np.ndarray]) -> tuple[int, int, int, int]:
    """(first place, places of the block, zeros before, zeros after) of a block's records: beyond a row without continuation there are none."""
    n, reach, size = int(data["n"][0]), int(data["reach"][0]), int(data["block"][0])
    first, stop = part * size, min(n, (part + 1) * size)
    return first, stop - first, int(data["place"][0]) - (first - reach), stop + reach - 1 - int(data["place"][-1])


def _whole(x: np.ndarray, before: int, after: int) -> np.ndarray:
    return np.pad(x.astype(float), (before, after)) if before or after else x.astype(float)


CUBE = ("order", "freq_idx", "frequency")


def _cubes(keys: Sequence[int], firsts: Sequence[int], cubes: np.ndarray, frequencies: Sequence[float]) -> dict:
    """Records of coefficients (row, order, frequency, place), in that order."""
    _, order, freq, obs = (x.ravel() for x in np.indices(cubes.shape))
    each = cubes[0].size
    return {ROW: np.repeat(np.asarray(keys, np.int64), each), "order": order, "freq_idx": freq, "frequency": np.asarray(frequencies, float)[freq], OBS: obs + np.repeat(np.asarray(firsts, np.int64), each)}


def _transformed(frame: RaggedFrame, columns: Sequence[str], names: Sequence[str], frequencies, reach, boundary: str, block: int, whole, middle) -> DataFrame:
    """Wavelet coefficients of all rows: ``whole(stacked columns)`` of short rows, those of one length together, ``middle(columns, reach, zeros)`` of blocks."""
    schema = f"{ROW} long, order long, freq_idx long, frequency double, {OBS} long, " + ", ".join(f"{n} double" for n in names)

    def records(keys, firsts, out) -> pd.DataFrame:
        data = _cubes(keys, firsts, out[0], frequencies)
        for i, cube in enumerate(out):
            data[names[2 * i]], data[names[2 * i + 1]] = cube.real.ravel(), cube.imag.ravel()
        return pd.DataFrame(data)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for done in _groups(frames, [*columns, "place", "n", "reach", "block"]):
            same: dict[int, list] = {}
            for row, part, data in done:
                if part < 0:
                    same.setdefault(len(data["place"]), []).append((row, data))
                    continue
                first, _, before, after = _stretch(part, data)
                out = middle([_whole(data[c], before, after) for c in columns], int(data["reach"][0]), (before, after))
                yield records([row], [first], [x[None] for x in out])
            for n, rows in same.items():
                at_once = max(1, (1 << 22) // (n * len(frequencies)))
                for i in range(0, len(rows), at_once):
                    some = rows[i : i + at_once]
                    yield records([r for r, _ in some], [0] * len(some), whole([np.stack([d[c].astype(float) for _, d in some]) for c in columns]))

    long_rows = _cut_evenly(frame, reach, max(block, 4 * (reach or 0)))
    return _blocks(frame, columns, long_rows, boundary).mapInPandas(run, schema)


def wavelets(frame: RaggedFrame, column: str, gamma: float, beta: float, frequencies: Sequence[float], order: int = 1, normalization: str = "bandpass", boundary: str = "periodic", tolerance: float = 1e-11, block: int = BLOCK) -> DataFrame:
    """(row_idx, order, freq_idx, frequency, obs_idx, re, im): Morse wavelet transform of each row.

    Rows of one length are transformed together. A row of more than two blocks is cut into blocks
    with halos beyond which less than ``tolerance`` of every wavelet's weight lies, so that the
    result differs by no more than that share of the largest value, and a task holds a block.
    Wavelets that Nyquist cuts off have no such halo: their rows stay whole.
    """
    if boundary not in signals.BOUNDARIES:
        raise ValueError(f"boundary must be one of {sorted(signals.BOUNDARIES)}")
    how = (gamma, beta, tuple(float(f) for f in frequencies), order, normalization)
    whole = lambda x: [signals.morse_transform(x[0], *how, boundary)]
    middle = lambda x, reach, zeros: [signals.morse_block(x[0], reach, *how)]
    return _transformed(frame, [column], ["re", "im"], how[2], signals.halo(*how, tolerance), boundary, block, whole, middle)


def wavelets_on_sphere(frame: RaggedFrame, lon: str, lat: str, gamma: float, beta: float, frequencies: Sequence[float], boundary: str = "periodic", tolerance: float = 1e-11, block: int = BLOCK) -> DataFrame:
    """The same for positions: east_re, east_im, north_re, north_im in meters; ``tolerance`` is a share of the earth's radius."""
    if boundary not in signals.BOUNDARIES:
        raise ValueError(f"boundary must be one of {sorted(signals.BOUNDARIES)}")
    how = (gamma, beta, tuple(float(f) for f in frequencies))

    def whole(x):
        out = [signals.morse_on_sphere(a, b, *how, boundary=boundary) for a, b in zip(*x, strict=True)]
        return [np.stack([o[k] for o in out]) for k in (0, 1)]

    middle = lambda x, reach, zeros: signals.morse_block_on_sphere(*x, reach, *how, zeros=zeros)
    return _transformed(frame, [lon, lat], ["east_re", "east_im", "north_re", "north_im"], how[2], signals.halo(*how, tolerance=tolerance), boundary, block, whole, middle)


def inertial(frame: RaggedFrame, lon: str = "lon", lat: str = "lat", relative_bandwidth: float | None = None, wavelet_duration: float | None = None, time_step: float = 3600.0, relative_vorticity: float = 0.0, tolerance: float = 1e-11, block: int = BLOCK) -> DataFrame:
    """(row_idx, obs_idx, x, y): inertial displacements of each row in meters; null for rows too short for one oscillation.

    A row's frequencies follow from its length and the ends of its inertial frequencies, which an
    aggregation finds; rows of more than two blocks are then cut, with the halo of their own
    wavelets, as in ``wavelets``.
    """
    beta = signals.inertial_beta(relative_bandwidth, wavelet_duration)
    f = F.abs(F.lit(2 * EARTH_ROTATION_RATE) * F.sin(F.radians(lat)) + F.lit(float(relative_vorticity)) * F.signum(lat))
    found = _long(frame, 2 * block)
    bounds = ["least", "turning", "most"]

    def halos(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                freqs = signals.inertial_frequencies(int(r.n), r.least, r.turning, r.most, beta, time_step)
                reach = signals.halo(signals.INERTIAL_GAMMA, beta, tuple(freqs.tolist()), tolerance=tolerance) if len(freqs) else None
                if reach is not None and r.n > 2 * max(block, 4 * reach):
                    out.append((r[0], r.n, reach, max(block, 4 * reach), r.least, r.turning, r.most))
            yield pd.DataFrame(out, columns=[ROW, "n", "reach", "block", *bounds])

    long_rows = None
    if found is not None:
        ends = frame.obs.join(found, ROW).groupBy(ROW, "n").agg(F.min(f).alias("least"), F.min(F.when(f > 0, f)).alias("turning"), F.max(f).alias("most"))
        long_rows = materialize(ends.mapInPandas(halos, f"{ROW} long, n long, reach long, block long, least double, turning double, most double"), "long-rows")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for done in _groups(frames, [lon, lat, "place", "n", "reach", "block", *bounds]):
            for row, part, data in done:
                if part < 0:
                    first = 0
                    x, y = signals.inertial_oscillation(data[lon], data[lat], wavelet_duration=math.sqrt(beta * signals.INERTIAL_GAMMA), time_step=time_step, relative_vorticity=relative_vorticity)
                else:
                    first = _stretch(part, data)[0]
                    freqs = signals.inertial_frequencies(int(data["n"][0]), *(float(data[b][0]) for b in bounds), beta, time_step)
                    x, y = signals.inertial_block(np.mod(data[lon].astype(float), 360), data[lat], int(data["reach"][0]), freqs, beta, time_step, relative_vorticity)
                yield pd.DataFrame({ROW: row, OBS: first + np.arange(len(x)), "x": x, "y": y})

    return _blocks(frame, [lon, lat], long_rows, "mirror", bounds).mapInPandas(run, f"{ROW} long, {OBS} long, x double, y double")


def analytic(frame: RaggedFrame, column: str, boundary: str = "periodic") -> DataFrame:
    """Analytic signal of a column: name_re, name_im. It needs all of a row, which one task holds."""
    return map_rows(frame, signals.analytic, [column], column, boundary, kind="complex")


def filtered(frame: RaggedFrame, column: str, response, dt: float | None = None) -> DataFrame:
    """A column filtered by a response per FFT frequency of its row, or a function of radian frequency: name_re, name_im.

    A response of any shape needs all of a row, which one task holds; ``filtered_sliding`` does not.
    """
    return map_rows(frame, transfer.apply_transfer, [column], column, response, dt, kind="complex")


def filtered_sliding(frame: RaggedFrame, column: str, response, window: int | None = None, step: int = 1, dt: float | None = None, kernel: str = "uniform", block: int = BLOCK) -> DataFrame:
    """The average of filtered windows of a mirrored column: name_re, name_im.

    A place depends on the windows over it, so a row of more than two blocks is cut with a window's
    length as halo, and blocks start where a window does: the result is that of the whole row.
    """
    width = window or len(response)
    size = -(-max(block, 4 * width) // step) * step
    long_rows = _cut_evenly(frame, 2 * width, size)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for done in _groups(frames, [column, "place", "n", "reach", "block"]):
            for row, part, data in done:
                if part < 0:
                    first, y = 0, transfer.apply_sliding_transfer(data[column], response, width if callable(response) else window, step, dt, kernel)[1]
                else:
                    first, n, _, _ = _stretch(part, data)
                    y = transfer.sliding_block(data[column].astype(float), int(data["place"][0]), first, n, int(data["n"][0]), response, width, step, dt, kernel)
                yield pd.DataFrame({ROW: row, OBS: first + np.arange(len(y)), f"{column}_re": y.real, f"{column}_im": y.imag})

    # a row's ends are mirrored in its first and last block, so nothing stands beyond them
    return _blocks(frame, [column], long_rows, "zeros").mapInPandas(run, f"{ROW} long, {OBS} long, `{column}_re` double, `{column}_im` double")


def wind_response(df: DataFrame, omega: str, z: str, out: tuple[str, str] = ("re", "im"), **layer) -> DataFrame:
    """``df`` with the wind response (real and imaginary part) at each row's frequency in radians a day and depth in meters.

    Row by row, without a shuffle; ``layer`` is that of ``transfer.wind``. Null frequencies and
    depths, and depths below the layer, have NaN. Columns named ``out`` are replaced.
    """

    @F.pandas_udf("re double, im double")
    def response(om: pd.Series, zz: pd.Series) -> pd.DataFrame:
        g = transfer.wind_at(om.to_numpy(float), zz.to_numpy(float), **layer)[0]
        return pd.DataFrame({"re": g.real, "im": g.imag})

    g = response(F.col(omega).cast("double"), F.col(z).cast("double"))
    return df.drop(*out).withColumn("wind_at_row", g).withColumns({out[0]: F.col("wind_at_row.re"), out[1]: F.col("wind_at_row.im")}).drop("wind_at_row")
