"""Transfer functions: filters of a row's values, and the response of an ocean layer to wind stress."""

from __future__ import annotations

import math
import warnings

import numpy as np

from ..functions.sphere import EARTH_DAY_SECONDS
from .special import i_scaled, k_scaled


def apply_transfer(x, response, dt: float | None = None) -> np.ndarray:
    """Filter a signal by a response given per FFT frequency, or as a function of radian frequency."""
    x = np.asarray(x)
    if x.ndim != 1:
        raise ValueError("x must have one dimension")
    if callable(response):
        if dt is None:
            raise ValueError("dt is needed for a function")
        gain = response(2 * math.pi * np.fft.fftfreq(len(x), dt))
    else:
        if dt is not None:
            warnings.warn("dt has no effect on an array", stacklevel=2)
        gain = np.asarray(response)
        if gain.shape != x.shape:
            raise ValueError("response and x must have one shape")
    return np.fft.ifft(np.fft.fft(x) * gain)


def kernel_weights(kernel: str | None, size: int) -> np.ndarray:
    """Weights of a window: uniform, or Epanechnikov without its zero ends."""
    name = (kernel or "uniform").lower()
    if name[0] == "u":
        return np.ones(size)
    if name[0] == "e":
        return 0.75 * (1 - np.linspace(-1, 1, size + 2)[1:-1] ** 2)
    raise ValueError("kernel must be uniform or epanechnikov")


def apply_sliding_transfer(x, response, window: int | None = None, step: int = 1, dt: float | None = None, kernel: str = "uniform") -> tuple[np.ndarray, np.ndarray]:
    """(windows, average): the filtered windows of a mirrored signal, and their weighted overlap average."""
    x = np.asarray(x)
    n = len(x)
    if callable(response):
        if window is None or not isinstance(window, int) or not 0 < window <= n:
            raise ValueError("window must be a positive integer no greater than the signal")
        if dt is None:
            raise ValueError("dt is needed for a function")
        gain = response(2 * math.pi * np.fft.fftfreq(window, dt))
    else:
        gain = np.asarray(response)
        if gain.ndim != 1:
            raise ValueError("response must have one dimension")
        window = window or len(gain)
        if window != len(gain):
            raise ValueError("response and window must have one length")
        if dt is not None:
            warnings.warn("dt has no effect on an array", stacklevel=2)
    if not isinstance(step, int) or step <= 0:
        raise ValueError("step must be a positive integer")
    before = window // 2
    wide = np.pad(x, (before, window - before), mode="reflect")
    filtered, average = _overlapped(wide, np.arange(0, len(wide) - window + 1, step), gain, kernel_weights(kernel, window))
    out = np.zeros((n // step + 1, window), complex)
    out[: len(filtered)] = filtered[: len(out)]
    return out, average[before : before + n]


def _overlapped(wide: np.ndarray, starts: np.ndarray, gain: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows from ``starts`` on, filtered, and their weighted average at each place."""
    window = len(gain)
    filtered = np.fft.ifft(np.fft.fft(np.lib.stride_tricks.sliding_window_view(wide, window)[starts]) * gain)
    total, weight = np.zeros(len(wide), complex), np.zeros(len(wide))
    for k in range(window):  # a window starts at a place once, so each sum is over different places
        total[starts + k] += filtered[:, k] * weights[k]
        weight[starts + k] += weights[k]
    with np.errstate(divide="ignore", invalid="ignore"):
        return filtered, total / weight


def sliding_block(x: np.ndarray, at: int, first: int, length: int, n: int, response, window: int, step: int, dt: float | None, kernel: str) -> np.ndarray:
    """The average of a row's places ``first`` to ``first + length``, from its values from place ``at`` on.

    The row has ``n`` places; at its ends the values are mirrored as those of a whole row are.
    Windows start where those of the whole row do.
    """
    gain = response(2 * math.pi * np.fft.fftfreq(window, dt)) if callable(response) else np.asarray(response)
    before = window // 2
    left, right = max(0, before - at) if at == 0 else 0, window - before if at + len(x) == n else 0
    wide = np.pad(x, (left, right), mode="reflect")
    origin = at - left + before  # of the first value of wide, in places of the whole mirrored row
    starts = np.arange(-(-origin // step) * step, origin + len(wide) - window + 1, step) - origin
    average = _overlapped(wide, starts, gain, kernel_weights(kernel, window))[1]
    return average[first - at + left : first - at + left + length]


def slab(omega, f: float, friction: float, depth: float, density: float = 1025.0) -> np.ndarray:
    """Response of a slab layer: ``omega`` and ``f`` in radians a day, ``friction`` a second (it is not scaled)."""
    if depth < 0 or density < 0:
        raise ValueError("depth and density must not be negative")
    turn = (np.atleast_1d(omega) + f) / EARTH_DAY_SECONDS
    return 1 / (density * depth * (friction + 1j * turn))


def wind(omega, z, f: float, delta: float, mu: float, depth: float, boundary: str = "no-slip", density: float = 1025.0, corrected: bool = False, method: str = "scaled"):
    """(response, its derivative by delta, by depth) over depths ``z`` and frequencies ``omega`` (radians a day).

    The viscosity K0 + K1 z has K0 = delta^2 |f| / 2 and K1 = mu |f| / 2; the layer is ``depth``
    deep (it may be infinite without slip). All cases are ratios of scaled Bessel or hyperbolic
    functions whose exponents are combined first, so none overflows. Below the layer the
    response is NaN. Derivatives exist for constant viscosity without slip, else they are empty.
    With free slip and both scales I of order 0 stands at the bottom, as in published values;
    ``corrected`` takes order 1, which is the one without a slope there. The other published
    ``method``, "unscaled", writes the same ratios without combining exponents; it has order 1 at a
    free bottom and no derivatives.
    """
    om, zz = np.meshgrid(np.atleast_1d(omega), np.atleast_1d(np.asarray(z, float)))
    return wind_at(om, zz, f, delta, mu, depth, boundary, density, corrected, method)


def wind_at(omega: np.ndarray, z: np.ndarray, f: float, delta: float, mu: float, depth: float, boundary: str = "no-slip", density: float = 1025.0, corrected: bool = False, method: str = "scaled"):
    """The same at pairs of frequencies and depths, arrays of one shape."""
    if method not in ("scaled", "unscaled"):
        raise ValueError("method must be scaled or unscaled")
    corrected = corrected or method == "unscaled"
    if (z < 0).any() or depth < 0 or delta < 0 or mu < 0 or density < 0:
        raise ValueError("depths, scales and density must not be negative")
    if boundary not in ("no-slip", "free-slip"):
        raise ValueError("boundary must be no-slip or free-slip")
    om, zz, f = np.asarray(omega, float) / EARTH_DAY_SECONDS, np.asarray(z, float), f / EARTH_DAY_SECONDS
    k0, k1 = delta**2 * abs(f) / 2, mu * abs(f) / 2
    turn = 1j * (om + f)
    slip = boundary == "free-slip"
    empty = np.array([])
    with np.errstate(all="ignore"):
        if k1 == 0:
            g, by_delta, by_depth = _constant(turn, zz, k0, delta, depth, slip, density)
            if slip:
                by_delta = by_depth = empty
        else:
            g = _linear(turn, zz, k0, k1, depth, slip, density, order=0 if slip and k0 and not corrected else 1)
            by_delta = by_depth = empty
        still = om == -f
        if still.any() and not slip:
            g[still] = _at_inertial(zz[still], k0, k1, depth, density)
    if method == "unscaled":
        by_delta = by_depth = empty
    g[zz > depth] = np.nan
    return g, by_delta, by_depth


def _constant(turn, z, k0, delta, depth, slip, density):
    m = np.sqrt(turn / k0)
    top = 1 / (density * k0 * m)
    if math.isinf(depth):
        g = top * np.exp(-m * z)
        return g, -g / delta + z * m * g / delta, np.zeros_like(g)
    # cosh and sinh of m (depth - z) over cosh of m depth, without their common exponential
    down, up, floor = np.exp(-m * z), np.exp(-m * (2 * depth - z)), np.exp(-2 * m * depth)
    even, odd = (down + up) / (1 + floor), (down - up) / (1 + floor)
    if slip:
        return top * (down + up) / (1 - floor), None, None
    g, slope = top * odd, 1 / (density * k0)
    bend = m * (1 - floor) / (1 + floor)
    return g, (-g - slope * (depth - z) * even + depth * bend * g) / delta, slope * even - bend * g


def _linear(turn, z, k0, k1, depth, slip, density, order):
    at = lambda d: 2 * np.sqrt(turn * (k0 + k1 * d)) / k1
    xz, x0 = at(z), at(0 * z)
    if k0:
        top, base = 1 / (density * np.sqrt(turn * k0)), x0
    else:
        top, base = 2 / (density * k1) * np.ones_like(turn), 0 * x0
    kz = k_scaled(0, xz)
    if math.isinf(depth):
        return top * np.exp(base - xz) * kz / (k_scaled(1, x0) if k0 else 1)
    xh = at(depth + 0 * z)
    iz = i_scaled(0, xz)
    ih, kh = (i_scaled(order, xh), k_scaled(1, xh)) if slip else (i_scaled(0, xh), k_scaled(0, xh))
    sign = 1 if slip else -1
    numer = np.exp(base - xz) * ih * kz + sign * np.exp(base + xz - 2 * xh) * kh * iz
    denom = ih * k_scaled(1, x0) - sign * np.exp(2 * x0 - 2 * xh) * kh * i_scaled(1, x0) if k0 else ih
    return top * numer / denom


def _at_inertial(z, k0, k1, depth, density):
    """Limit where the frequency cancels the rotation."""
    if math.isinf(depth):
        return np.full(z.shape, np.inf, complex)
    if k1 == 0:
        return (depth - z) / (density * k0)
    return np.log((k0 + k1 * depth) / (k0 + k1 * z)) / (density * k1)
