"""Row kernels against published numbers, direct formulas and inverses."""

import cmath
import math

import numpy as np
import pytest
from frames import of, values

from tracklake.functions import complexes
from tracklake.functions.sphere import EARTH_DAY_SECONDS
from tracklake.operators import apply, signals, special, transfer

RNG = np.random.default_rng(3)


def test_bessel_wronskian():
    z = np.array([0.05, 0.7, 4.2, 14, 19.9, 20.1, 60]) * cmath.exp(1j * math.pi / 4)
    for x in (z, np.conj(z), np.abs(z)):
        w = special.i_scaled(0, x) * special.k_scaled(1, x) + special.i_scaled(1, x) * special.k_scaled(0, x)
        assert np.allclose(w * x, 1, rtol=1e-10)
    assert np.allclose(special.k_scaled(0, 2.0) * np.exp(-2), 0.11389387275, rtol=1e-9) and np.isinf(special.k_scaled(0, 0.0))


OMEGA, Z, FREQ = np.arange(-10, 10 + 0.01, 0.01) * 2 * np.pi, np.arange(0, 50, 5), 2 * np.pi * 1.5
LAYER = {"delta": 20, "mu": 20, "depth": 50}


def scaled(i, **layer):
    return transfer.wind(OMEGA[i : i + 1], Z, FREQ, **(LAYER | layer))[0][:, 0] * abs(FREQ / EARTH_DAY_SECONDS) * 1025


def test_wind_golden_values():
    i = np.abs(OMEGA + FREQ).argmin()
    # Published responses at the inertial frequency, and with free slip at frequency 0.
    assert np.allclose(scaled(i), [0.1252763, 0.10296194, 0.08472979, 0.06931472, 0.05596158, 0.04418328, 0.03364722, 0.02411621, 0.01541507, 0.0074108], atol=1e-6)
    i = np.abs(OMEGA).argmin()
    g = transfer.wind([OMEGA[i]], Z, FREQ, **LAYER, boundary="free-slip")[0][:, 0] * abs(FREQ / EARTH_DAY_SECONDS) * 1025
    want = [0.04653128 - 0.0365929j, 0.02616164 - 0.03449013j, 0.01266338 - 0.03030143j, 0.00359447 - 0.02574129j, -0.00253419 - 0.02152846j, -0.00666497 - 0.01794904j, -0.00940876 - 0.01509089j, -0.01116722 - 0.01294936j, -0.01220577 - 0.01147741j, -0.01269919 - 0.01061011j]
    assert np.allclose(g, want, atol=1e-7)


@pytest.mark.parametrize("boundary", ["no-slip", "free-slip"])
@pytest.mark.parametrize("layer", [{"mu": 0}, {"delta": 0}, {}])
def test_wind_solves_its_equation(boundary, layer):
    """d/dz (K dG/dz) = i (omega + f) G, the stress at the top, and the bottom's condition."""
    p, om, h = LAYER | layer, [2.0, -30.0], 0.01
    z = np.arange(0.0, 50 + h / 2, h)
    g = transfer.wind(om, z, FREQ, **p, boundary=boundary, corrected=True)[0]
    f = FREQ / EARTH_DAY_SECONDS
    k = p["delta"] ** 2 * f / 2 + p["mu"] * f / 2 * (z[:-1] + h / 2)
    flux = k[:, None] * np.diff(g, axis=0) / h
    turn = 1j * (np.array(om) / EARTH_DAY_SECONDS + f)
    inner = slice(2000, 4900)
    assert np.allclose((np.diff(flux, axis=0) / h)[inner], (turn * g[1:-1])[inner], rtol=2e-3, atol=1e-9)
    if p["delta"]:
        assert np.allclose(flux[0], -1 / 1025, rtol=2e-3)
    assert np.allclose(g[-1] if boundary == "no-slip" else flux[-1], 0, atol=1e-6)


def test_wind_gradients_and_limits():
    p = {"delta": 20.0, "mu": 0.0, "depth": 50.0}
    g, by_delta, by_depth = transfer.wind([3.0], Z, FREQ, **p)
    e = 1e-5
    for name, want in (("delta", by_delta), ("depth", by_depth)):
        up, down = (transfer.wind([3.0], Z, FREQ, **(p | {name: p[name] + d}))[0] for d in (e, -e))
        assert np.allclose((up - down) / (2 * e), want, rtol=1e-4, atol=1e-10)
    near, at = (transfer.wind([w], [15.0], FREQ, **p)[0] for w in (-FREQ * (1 + 1e-9), -FREQ))
    assert np.allclose(near, at, rtol=1e-4)
    assert np.isnan(transfer.wind([1.0], [60.0], FREQ, **p)[0]).all() and np.isinf(transfer.wind([-FREQ], [1.0], FREQ, 20, 0, math.inf)[0]).all()
    for bad in ({"delta": -1}, {"mu": -1}, {"depth": -1}, {"boundary": "half"}):
        with pytest.raises(ValueError):
            transfer.wind([1.0], [1.0], FREQ, **(p | bad))


def test_filters():
    x = RNG.normal(size=64)
    low = lambda w: (np.abs(w) < 1).astype(float)
    y = transfer.apply_transfer(x, low, 1.0)
    assert np.allclose(transfer.apply_transfer(y.real, low, 1.0), y) and np.allclose(transfer.apply_transfer(x, np.ones(64)), x)
    for kernel in ("uniform", "e"):
        windows, mean = transfer.apply_sliding_transfer(x[:50], np.ones(10), step=1, kernel=kernel)
        assert windows.shape == (51, 10) and np.allclose(mean, x[:50])
    for bad in (lambda: transfer.apply_transfer(x, low), lambda: transfer.apply_transfer(x, np.ones(3)), lambda: transfer.apply_transfer(x.reshape(8, 8), low, 1.0), lambda: transfer.apply_sliding_transfer(x, low, 99, dt=1.0), lambda: transfer.apply_sliding_transfer(x, np.ones(4), 5), lambda: transfer.apply_sliding_transfer(x, np.ones(4), step=0), lambda: transfer.kernel_weights("triangle", 4)):
        with pytest.raises(ValueError):
            bad()
    with pytest.warns(UserWarning):
        transfer.apply_transfer(x, np.ones(64), 1.0)


def test_slab():
    g = transfer.slab([0.0], 6.0, 1e-5, 30.0)
    assert np.allclose(g, 1 / (1025 * 30 * (1e-5 + 1j * 6 / EARTH_DAY_SECONDS)))


@pytest.mark.parametrize("n", [50, 51])
@pytest.mark.parametrize("boundary", ["mirror", "zeros", "periodic"])
def test_analytic(n, boundary):
    x = RNG.normal(size=n)
    assert np.allclose(signals.analytic(x, boundary).real, x)
    p, q = signals.analytic(x + 1j * x[::-1], boundary)
    assert np.allclose(p + np.conj(q), x + 1j * x[::-1])
    with pytest.raises(ValueError):
        signals.analytic(x, "wrap")


def test_rotary_and_ellipse():
    u, v = RNG.normal(size=9) + 1j, RNG.normal(size=9) - 2j
    assert np.allclose(signals.cartesian(*signals.rotary(u, v)), (u, v))
    kappa, lam, theta, phi = np.full(40, 2.0), np.full(40, 0.4), np.full(40, 0.3), np.linspace(0, 12, 40)
    a, b = kappa * np.sqrt(1 + lam), kappa * np.sqrt(1 - lam)
    x, y = np.exp(1j * phi) * (a * np.cos(theta) + 1j * b * np.sin(theta)), np.exp(1j * phi) * (a * np.sin(theta) - 1j * b * np.cos(theta))
    for got, want in zip(signals.ellipse(x, y), (kappa, lam, theta, phi), strict=True):
        assert np.allclose(got - got[0], want - want[0], atol=1e-9)
    assert np.allclose(signals.ellipse(x, y)[0], kappa)


def test_ellipse_of_a_straight_line(spark):
    x, y = complexes.of(0.0, 0.0), complexes.of(0.1, 0.572)
    row = spark.range(1).select(complexes.ellipse(x, y).alias("e")).withColumn("s", complexes.from_ellipse("e.kappa", "e.lambda", "e.theta", "e.phi")).first()
    assert row.e["lambda"] == 1 and np.allclose([*row.s.x, *row.s.y], [0, 0, 0.1, 0.572])
    assert signals.ellipse(np.zeros(1), np.full(1, 0.1 + 0.572j))[1] == 1


@pytest.mark.parametrize("n", [1023, 1024])
def test_morse_wavelets(n):
    freqs = signals.morse_logspace(3, 10, n, (0.05, math.pi), (3, 0), 4)
    assert (np.diff(freqs) < 0).all()
    wave, spectrum = signals.morse_wavelet(n, 3, 10, freqs, 1)
    peak = np.abs(spectrum[0]).argmax(-1) * 2 * np.pi / n
    assert np.allclose(peak, freqs, atol=2 * np.pi / n)
    assert np.allclose(np.abs(spectrum[0]).max(-1), 2, rtol=4e-2)  # the grid misses the peak of low frequencies
    energy, _ = signals.morse_wavelet(n, 3, 10, freqs[5:10], 2, "energy")
    for k in range(2):
        assert np.allclose((np.abs(energy[k]) ** 2).sum(-1), 1, rtol=1e-3)
    assert np.allclose((energy[0] * np.conj(energy[1])).sum(-1), 0, atol=1e-6)
    back, _ = signals.morse_wavelet(n, 3, 10, -freqs[5:6])
    assert np.allclose(back, np.conj(signals.morse_wavelet(n, 3, 10, freqs[5:6])[0]))


def test_morse_numbers():
    assert np.allclose(signals.morse_freq(3, 4)[0], (4 / 3) ** (1 / 3)) and signals.morse_freq(3, 0)[0] == math.log(2) ** (1 / 3)
    assert np.allclose(signals.morse_properties(3, 4), (math.sqrt(12), 0, 3 - 2 / 12))
    assert signals.morse_amplitude(3, 0) == 2
    x = np.linspace(0, 3, 5)
    assert np.allclose(signals.laguerre(x, 2, 0.5), x**2 / 2 - 2.5 * x + 2.5 * 1.5 / 2)
    with pytest.raises(ValueError):
        signals.morse_wavelet(16, 3, 4, [1.0], normalization="none")


@pytest.mark.parametrize("boundary", ["mirror", "zeros", "periodic"])
def test_transform_of_a_cosine(boundary):
    n, om = 500, 2 * math.pi * 25 / 500
    t = np.arange(n)
    w = signals.morse_transform(np.cos(om * t), 3, 10, [om], boundary=boundary)[0, 0, 150:350]
    assert np.allclose(np.abs(w), 1, atol=0.02) and np.allclose(w.real, np.cos(om * t)[150:350], atol=0.03)
    p, q = signals.morse_transform(np.exp(1j * om * t), 3, 10, [om], boundary=boundary, complex_parts=True)
    assert np.abs(p[0, 0, 250]) > 0.9 and np.abs(q[0, 0, 250]) < 0.1


def test_inertial_oscillation_is_recovered():
    lat0, speed, n = 30.0, 0.5, 24 * 60
    f = 2 * 2 * math.pi / EARTH_DAY_SECONDS * math.sin(math.radians(lat0))
    t = np.arange(n) * 3600.0
    x, y = speed / f * np.sin(f * t), speed / f * np.cos(f * t)
    lat = lat0 + np.degrees(y / 6378100.0)
    lon = np.degrees(x / 6378100.0 / np.cos(np.radians(lat)))
    a, b = signals.inertial_oscillation(lon, lat, relative_bandwidth=0.15)
    inner = slice(240, n - 240)
    assert np.abs((a - x)[inner]).max() < 20 and np.abs((b - y)[inner]).max() < 20
    assert np.isnan(signals.inertial_oscillation(lon[:10], lat[:10], wavelet_duration=2)[0]).all()
    for bad in ({}, {"relative_bandwidth": 0.1, "wavelet_duration": 3}, {"relative_bandwidth": 2}, {"wavelet_duration": 0.5}):
        with pytest.raises(ValueError):
            signals.inertial_oscillation(lon, lat, **bad)


def test_rows_are_mapped_and_reduced(spark):
    f = of(spark, [1.0, 2.0, 4.0], [3.0], [5.0, 7.0])
    assert values(apply.map_rows(f, np.cumsum, ["x"], "s"), "s") == [(1,), (3,), (7,), (3,), (5,), (12,)]
    assert values(apply.reduce_rows(f, lambda x, k: (x.sum() * k, x.max()), ["x"], ["a", "b"], k=2, rows=[0, 2]), "row_idx", "a", "b") == [(0, 14, 4), (2, 24, 7)]
    with pytest.raises(Exception, match="1 values for 3"):
        apply.map_rows(f, lambda x: x[:1], ["x"], "s").collect()
    got = {tuple(r) for r in apply.wavelets(of(spark, RNG.normal(size=32).tolist()), "x", 3, 4, [0.5, 1.0], order=2).select("order", "freq_idx").distinct().collect()}
    assert got == {(0, 0), (0, 1), (1, 0), (1, 1)}


def test_rows_of_arrays(spark):
    f = of(spark, [[1.0, 2.0], [3.0, 4.0]], [[5.0, 6.0]])
    assert values(apply.map_rows(f, lambda x: np.cumsum(x, 0), ["x"], "s", kind="array<double>"), "s") == [([1, 2],), ([4, 6],), ([5, 6],)]
    assert values(apply.reduce_rows(f, lambda x: float(x.sum()), ["x"], "s"), "s") == [(10,), (11,)]
