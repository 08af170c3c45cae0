"""Complex numbers as STRUCT<re, im> columns, and the rotary and ellipse functions on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sphere import Value, col


def of(re: Value, im: Value = 0.0) -> Column:
    return F.struct(col(re).alias("re"), col(im).alias("im"))


def add(a: Column, b: Column) -> Column:
    return of(a["re"] + b["re"], a["im"] + b["im"])


def sub(a: Column, b: Column) -> Column:
    return of(a["re"] - b["re"], a["im"] - b["im"])


def mul(a: Column, b: Column) -> Column:
    return of(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def div(a: Column, b: Column) -> Column:
    """Quotient; null parts where the divisor is 0."""
    n = b["re"] * b["re"] + b["im"] * b["im"]
    return of(F.try_divide(a["re"] * b["re"] + a["im"] * b["im"], n), F.try_divide(a["im"] * b["re"] - a["re"] * b["im"], n))


def scale(a: Column, k: Value) -> Column:
    return of(a["re"] * col(k), a["im"] * col(k))


def modulus(a: Column) -> Column:
    return F.hypot(a["re"], a["im"])


def angle(a: Column) -> Column:
    return F.atan2(a["im"], a["re"])


def unit(theta: Value) -> Column:
    """exp(i theta)."""
    return of(F.cos(col(theta)), F.sin(col(theta)))


def to_rotary(u: Column, v: Column) -> Column:
    """Struct (p, n): the counter-clockwise and clockwise halves (u + iv) / 2 and (u - iv) / 2 of complex components."""
    turned = of(-v["im"], v["re"])
    return F.struct(scale(add(u, turned), 0.5).alias("p"), scale(sub(u, turned), 0.5).alias("n"))


def from_rotary(p: Column, n: Column) -> Column:
    """Struct (u, v) of complex components from their rotary halves."""
    d = sub(p, n)
    return F.struct(add(p, n).alias("u"), of(d["im"], -d["re"]).alias("v"))


def ellipse(x: Column, y: Column) -> Column:
    """Struct (kappa, lambda, theta, phi) of an elliptical signal's components; angles are not unwrapped.

    A linearity of exactly 0 becomes 1e-12 with the sign of the rotation, as its sign carries meaning.
    Motion on a straight line turns neither way and has a linearity of 1; 0 is a circle.
    """
    halves = to_rotary(x, y)
    p, n = modulus(halves["p"]), modulus(halves["n"])
    power = p * p + n * n
    turn = F.when(p < n, -1.0).otherwise(1.0)
    lam = F.try_divide(2 * p * n * turn, power)
    lam = F.when(lam == 0, turn * 1e-12).otherwise(lam)
    ap, an = angle(halves["p"]), angle(halves["n"])
    return F.struct(F.sqrt(power).alias("kappa"), lam.alias("lambda"), ((ap - an) / 2).alias("theta"), ((ap + an) / 2).alias("phi"))


def from_ellipse(kappa: Value, lam: Value, theta: Value, phi: Value) -> Column:
    """Struct (x, y) of complex components from ellipse parameters; infinite where a parameter is."""
    kappa, lam, theta, phi = (col(v) for v in (kappa, lam, theta, phi))
    a = kappa * F.sqrt(1 + F.abs(lam))
    b = F.when(lam == 0, kappa).otherwise(F.signum(lam) * kappa * F.sqrt(1 - F.abs(lam)))
    turn = unit(phi)
    x, y = mul(turn, of(a * F.cos(theta), b * F.sin(theta))), mul(turn, of(a * F.sin(theta), -b * F.cos(theta)))
    far = F.abs(kappa * lam * theta * phi) == float("inf")
    inf = of(float("inf"), float("inf"))
    return F.struct(F.when(far, inf).otherwise(x).alias("x"), F.when(far, inf).otherwise(y).alias("y"))


def slab_response(omega: Value, f: Value, friction: Value, depth: Value, density: float = 1025.0, day: float = 86_164.091) -> Column:
    """Complex response of a slab layer to wind stress; ``omega`` and ``f`` in radians a day, ``friction`` a second."""
    turn = (col(omega) + col(f)) / day
    return div(of(1.0), scale(of(friction, turn), col(depth) * density))

