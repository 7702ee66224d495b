"""Nonlinear flow, k = k(u): Picard and Newton steps, and full approximation multigrid over a hierarchy's levels.

Levels are arrays (see montecarlo.levels): the iteration is sequential and its levels are coarse. M is divided by k at each
element's mean potential.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import algebra
from .montecarlo import Level


@dataclass(frozen=True)
class Conductivity:
    """exp(alpha u), or with beta: ks alpha / (alpha + |u - z|^beta)."""

    alpha: float
    beta: float | None = None
    ks: float = 1.0
    z: float = 0.0

    def value(self, u: np.ndarray) -> np.ndarray:
        return np.exp(self.alpha * u) if self.beta is None else self.ks * self.alpha / (self.alpha + np.abs(u - self.z) ** self.beta)

    def inverse_slope(self, u: np.ndarray) -> np.ndarray:
        """d (1 / k) / du."""
        if self.beta is None:
            return -self.alpha * np.exp(-self.alpha * u)
        p = u - self.z
        return self.beta * np.sign(p) * np.abs(p) ** (self.beta - 1) / (self.ks * self.alpha)


def conductivity(k: Conductivity, u: Column) -> Column:
    """k(u) as a column expression."""
    if k.beta is None:
        return F.exp(F.lit(k.alpha) * u)
    return F.lit(k.ks * k.alpha) / (F.lit(k.alpha) + F.pow(F.abs(u - F.lit(k.z)), F.lit(k.beta)))


def inverse_slope(k: Conductivity, u: Column) -> Column:
    """d (1 / k) / du as a column expression; 0 at u = z."""
    if k.beta is None:
        return -F.lit(k.alpha) * F.exp(-F.lit(k.alpha) * u)
    p = u - F.lit(k.z)
    return F.lit(k.beta / (k.ks * k.alpha)) * F.signum(p) * F.pow(F.abs(p), F.lit(k.beta - 1))


def residual(elements: DataFrame, d: DataFrame, k: Conductivity, x: DataFrame, right: DataFrame, w: DataFrame | None = None) -> DataFrame:
    """right - [[M(k(u)), D^T], [D, -W]] x over tables: x and right are (block, i, v), 0 the fluxes, 1 the potentials; an
    element (elem, i, j, v) is a vertex's, and divided by k at its potential."""
    from .elements import apply

    s, u = algebra.block_vector(x, 0), algebra.block_vector(x, 1)
    coefficient = u.select("i", conductivity(k, F.col("v")).alias("v"))
    top = algebra.combine((1.0, algebra.block_vector(right, 0)), (-1.0, apply(elements, s, coefficient)), (-1.0, algebra.matvec(d, u, transposed=True)))
    low = algebra.combine((1.0, algebra.block_vector(right, 1)), (-1.0, algebra.matvec(d, s)), *([(1.0, algebra.matvec(w, u))] if w is not None else []))
    return algebra.stacked(top, low)


def limited(change: DataFrame, alpha: float, limit: float) -> DataFrame:
    """A step (block, i, v), scaled down where the largest change of a potential times alpha is over log(limit)."""
    most = change.filter("block = 1").agg(F.coalesce(F.max(F.abs("v")), F.lit(0.0)).alias("most"))
    scale = 1 / F.greatest(F.lit(1.0), F.col("most") * alpha / math.log(limit))
    return change.join(F.broadcast(most)).select("block", "i", (F.col("v") * scale).alias("v"))


def picard(system, elements: DataFrame, k: Conductivity, f: DataFrame, *, most: int = 50, relative: float = 1e-8, absolute: float = 1e-12) -> tuple[DataFrame, list[float]]:
    """The potentials and fluxes (block, i, v) of the flow with conductivity k(u) on a level of elements (elem, i, j, v), by
    Picard's iteration over tables, and the norms of the residual before each step.

    A step solves the linear system with M divided by k at the last potentials, zero at first; it ends when the residual's norm
    is below max(absolute, relative x that of f), and raises if that takes more than `most` steps.
    """
    from ..sources.checkpoints import Rounds, written
    from .elements import assemble
    from .hierarchy import solve
    from .spectral import System

    zero = lambda t, c: t.select(F.col(c).alias("i"), F.lit(0.0).alias("v")).distinct()
    right = written(algebra.stacked(zero(system.edofs, "edof"), f), "right")
    state, mass = Rounds("state"), Rounds("mass")
    x = state(algebra.stacked(zero(system.edofs, "edof"), zero(system.vdofs, "vdof")))
    norm = lambda y: y.agg(F.coalesce(F.sqrt(F.sum(F.col("v") * F.col("v"))), F.lit(0.0))).first()[0]
    history, goal = [], max(absolute, relative * norm(right))
    for _ in range(most + 1):
        history.append(norm(residual(elements, system.d, k, x, right, system.w)))
        if history[-1] < goal:
            return x, history
        coefficient = algebra.block_vector(x, 1).select("i", conductivity(k, F.col("v")).alias("v"))
        linear = System(system.vdofs, system.edofs, mass(assemble(elements, coefficient)), system.d, system.constant, system.w)
        x = state(algebra.stacked(*solve(linear, f)))
    raise RuntimeError(f"residual {history[-1]:.1e} after {most} steps, above {goal:.1e}")


@dataclass
class Result:
    flux: np.ndarray
    potential: np.ndarray
    iterations: int
    residual: float
    history: list[float] = field(default_factory=list)


def _mean(l: Level, u: np.ndarray) -> np.ndarray:
    share = np.bincount(l.element_of, l.constant**2)
    return np.bincount(l.element_of, u * l.constant) / share


def _apply(l: Level, k: Conductivity, s: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return l.mass(k.value(_mean(l, u))) @ s + l.d.T @ u, l.d @ s - (l.w @ u if l.w is not None else 0)


def _step(l: Level, k: Conductivity, s, u, g, f, newton: bool, limit: float) -> tuple[np.ndarray, np.ndarray]:
    a = _apply(l, k, s, u)
    rg, rf = g - a[0], f - a[1]
    m = l.mass(k.value(_mean(l, u)))
    top = l.d.T.copy()
    if newton:
        share = np.bincount(l.element_of, l.constant**2)
        slope = k.inverse_slope(_mean(l, u))
        part = np.zeros((len(s), len(share)))
        np.add.at(part, (l.i, l.elem), l.v * slope[l.elem] * s[l.j])
        top += part[:, l.element_of] * (l.constant / share[l.element_of])
    n = len(s)
    w = l.w if l.w is not None else np.outer(l.constant, l.constant) * 1e-10
    x = np.linalg.solve(np.block([[m, top], [l.d, -w]]), np.r_[rg, rf])
    ds, du = x[:n], x[n:]
    change = np.abs(_mean(l, du)).max() * k.alpha / math.log(limit)
    scale = 1 / max(1.0, change)
    return s + scale * ds, u + scale * du


def _norm(l: Level, k: Conductivity, s, u, g, f) -> float:
    a = _apply(l, k, s, u)
    return float(np.sqrt(((g - a[0]) ** 2).sum() + ((f - a[1]) ** 2).sum()))


def solve(levels: list[Level], k: Conductivity, f: np.ndarray, g: np.ndarray | None = None, *, newton: bool = True, most: int = 100, relative: float = 1e-8, absolute: float = 1e-10, smoothing: int = 1, change: float = 2.0) -> Result:
    """Iterates from zero until the residual is less than max(absolute, relative x that of the right-hand side). With one
    level an iteration is a step; with more, a V-cycle: smoothing steps, the coarse problem with right-hand side
    P^T (f - A x) + A_c(Q x), correction, smoothing steps. A step that doesn't reduce the residual by a tenth is halved."""
    g = np.zeros(levels[0].d.shape[1]) if g is None else g
    s, u = np.zeros_like(g), np.zeros_like(f)
    start = float(np.sqrt((g**2).sum() + (f**2).sum()))
    history = []

    def smooth(l, s, u, g, f):
        before = _norm(l, k, s, u, g, f)
        new = _step(l, k, s, u, g, f, newton, change)
        for _ in range(4):
            if _norm(l, k, *new, g, f) <= 0.9 * before or before < absolute:
                break
            half = ((s + new[0]) / 2, (u + new[1]) / 2)
            if _norm(l, k, *half, g, f) >= _norm(l, k, *new, g, f):
                break
            new = half
        return new

    def cycle(at, s, u, g, f):
        l = levels[at]
        if at + 1 == len(levels):
            return smooth(l, s, u, g, f)
        for _ in range(smoothing):
            s, u = smooth(l, s, u, g, f)
        c = levels[at + 1]
        a = _apply(l, k, s, u)
        s0, u0 = np.linalg.lstsq(l.s, s, rcond=None)[0], l.u.T @ u
        ac = _apply(c, k, s0, u0)
        s1, u1 = cycle(at + 1, s0, u0, l.s.T @ (g - a[0]) + ac[0], l.u.T @ (f - a[1]) + ac[1])
        better = (s + l.s @ (s1 - s0), u + l.u @ (u1 - u0))
        if _norm(l, k, *better, g, f) < _norm(l, k, s, u, g, f):
            s, u = better
        for _ in range(smoothing):
            s, u = smooth(l, s, u, g, f)
        return s, u

    for n in range(most + 1):
        history.append(_norm(levels[0], k, s, u, g, f))
        if history[-1] < max(absolute, relative * start):
            return Result(s, u, n, history[-1], history)
        s, u = cycle(0, s, u, g, f)
    return Result(s, u, most, history[-1], history)
