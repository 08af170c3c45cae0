"""Bessel functions I and K of orders 0 and 1 for complex arguments in the right half-plane, scaled to stay finite."""

from __future__ import annotations

import math

import numpy as np

FAR = 20.0  # from this modulus on the large-argument series holds to double precision
NODES = 400


def _terms(nu: int, z: np.ndarray, n: int, sign: int) -> np.ndarray:
    """Sum of the first n terms a_k (sign / z)^k, each from the one before."""
    term = np.ones_like(z)
    total = np.ones_like(z)
    for k in range(1, n):
        term = term * sign * (4 * nu * nu - (2 * k - 1) ** 2) / (8 * k * z)
        total = total + term
    return total


def k_far(nu: int, z, terms: int = 30) -> np.ndarray:
    """K times exp(z) by the large-argument series."""
    z = np.asarray(z, complex)
    return np.sqrt(math.pi / (2 * z)) * _terms(nu, z, terms, 1)


def i_far(nu: int, z, terms: int = 30) -> np.ndarray:
    """I times exp(-z) by the large-argument series."""
    z = np.asarray(z, complex)
    return _terms(nu, z, terms, -1) / np.sqrt(2 * math.pi * z)


def k_scaled(nu: int, z) -> np.ndarray:
    """K times exp(z): the integral of exp(-z (cosh t - 1)) cosh(nu t), or the series far out; infinite at 0."""
    z = np.asarray(z, complex)
    flat = z.ravel()
    out = np.full(flat.shape, np.nan, complex)
    far = np.abs(flat) >= FAR
    out[far] = k_far(nu, flat[far])
    out[flat == 0] = np.inf
    near = np.flatnonzero(~far & (flat != 0) & np.isfinite(flat))
    if len(near):
        x = flat[near]
        end = np.arccosh(1 + 45 / np.maximum(x.real, 1e-300))
        t = end[:, None] * np.linspace(0, 1, NODES)
        f = np.exp(-x[:, None] * (np.cosh(t) - 1)) * np.cosh(nu * t)
        f[:, 0] /= 2
        out[near] = f.sum(1) * end / (NODES - 1)
    return out.reshape(z.shape)


def i_scaled(nu: int, z) -> np.ndarray:
    """I times exp(-z): the power series, or the large-argument one far out."""
    z = np.asarray(z, complex)
    flat = z.ravel()
    out = np.full(flat.shape, np.nan, complex)
    far = np.abs(flat) >= FAR
    out[far] = i_far(nu, flat[far])
    near = np.flatnonzero(~far & np.isfinite(flat))
    if len(near):
        x = flat[near]
        term = (x / 2) ** nu / math.factorial(nu)
        total = term.copy()
        for k in range(1, 80):
            term = term * (x / 2) ** 2 / (k * (k + nu))
            total += term
        out[near] = total * np.exp(-x)
    return out.reshape(z.shape)
