"""Krylov solvers: conjugate gradients over tables, and for operators given as functions of numpy vectors, for the small
systems of a task."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Solution(NamedTuple):
    x: np.ndarray
    iterations: int
    residual: float


def conjugate_gradients(a: Callable, b: np.ndarray, precondition: Callable = lambda r: r, relative: float = 1e-9, absolute: float = 1e-12, most: int = 5000) -> Solution:
    x, r = np.zeros_like(b), b.copy()
    z = precondition(r)
    p, rz = z.copy(), r @ z
    stop = max(absolute, relative * np.linalg.norm(b))
    for k in range(most):
        if np.linalg.norm(r) <= stop:
            return Solution(x, k, float(np.linalg.norm(r)))
        ap = a(p)
        alpha = rz / (p @ ap)
        x, r = x + alpha * p, r - alpha * ap
        z = precondition(r)
        rz, last = r @ z, rz
        p = z + rz / last * p
    return Solution(x, most, float(np.linalg.norm(r)))


def gmres(a: Callable, b: np.ndarray, precondition: Callable = lambda r: r, relative: float = 1e-9, absolute: float = 1e-12, most: int = 5000, restart: int = 50) -> Solution:
    """Restarted, preconditioned from the right."""
    x, done = np.zeros_like(b), 0
    stop = max(absolute, relative * np.linalg.norm(b))
    while True:
        r = b - a(x)
        beta = np.linalg.norm(r)
        if beta <= stop or done >= most:
            return Solution(x, done, float(beta))
        q, h = [r / beta], np.zeros((restart + 1, restart))
        for j in range(restart):
            w = a(precondition(q[j]))
            for i, v in enumerate(q):
                h[i, j] = w @ v
                w = w - h[i, j] * v
            h[j + 1, j] = np.linalg.norm(w)
            done += 1
            e = np.zeros(j + 2)
            e[0] = beta
            y, *_ = np.linalg.lstsq(h[: j + 2, : j + 1], e, rcond=None)
            if np.linalg.norm(e - h[: j + 2, : j + 1] @ y) <= stop or h[j + 1, j] < 1e-14 or done >= most:
                break
            q.append(w / h[j + 1, j])
        x = x + precondition(np.column_stack(q[: len(y)]) @ y)


def minres(a: Callable, b: np.ndarray, relative: float = 1e-9, absolute: float = 1e-12, most: int = 5000) -> Solution:
    """For symmetric, indefinite operators: Lanczos vectors, and a running QR factorisation of their matrix."""
    n = len(b)
    x, beta = np.zeros(n), np.linalg.norm(b)
    stop = max(absolute, relative * beta)
    if beta <= stop:
        return Solution(x, 0, float(beta))
    v0, v1 = np.zeros(n), b / beta
    w0, w1 = np.zeros(n), np.zeros(n)
    c0, c1, s0, s1, eta = 1.0, 1.0, 0.0, 0.0, beta
    b1 = 0.0
    for k in range(1, most + 1):
        av = a(v1)
        alpha = v1 @ av
        v2 = av - alpha * v1 - b1 * v0
        b2 = np.linalg.norm(v2)
        delta = c1 * alpha - c0 * s1 * b1
        r1 = np.hypot(delta, b2)
        r2, r3 = s1 * alpha + c0 * c1 * b1, s0 * b1
        c2, s2 = delta / r1, b2 / r1
        w2 = (v1 - r3 * w0 - r2 * w1) / r1
        x = x + c2 * eta * w2
        eta = -s2 * eta
        if abs(eta) <= stop or b2 < 1e-300:
            return Solution(x, k, float(abs(eta)))
        v0, v1, w0, w1, c0, c1, s0, s1, b1 = v1, v2 / b2, w1, w2, c1, c2, s1, s2, b2
    return Solution(x, most, float(abs(eta)))


def over_tables(a: DataFrame, b: DataFrame, tolerance: float = 1e-9, most: int = 500, precondition: Callable[[DataFrame], DataFrame] | None = None, history: list[float] | None = None) -> DataFrame:
    """x (i, v) of A x = b by conjugate gradients from zero, preconditioned by A's diagonal, or by a symmetric positive operator on tables
    (i, v) that is given. `history` gets the preconditioned norm of the residual before each iteration. A (i, j, v) is symmetric and positive, or
    semidefinite with b in its range; b has a row for each unknown. Each iteration's vectors are written to the shared folder;
    RuntimeError if the residual isn't `tolerance` of the first after `most` iterations."""
    from ..operators import algebra
    from ..sources.checkpoints import Rounds

    table = Rounds("cg")
    diag = a.filter("i = j").select("i", F.col("v").alias("d"))

    def with_z(t: DataFrame) -> DataFrame:
        """Adds z, the preconditioned residual."""
        if precondition is None:
            return t.join(diag, "i").withColumn("z", F.col("r") / F.col("d")).drop("d")
        return t.join(precondition(t.select("i", F.col("r").alias("v"))).select("i", F.col("v").alias("z")), "i")

    total = lambda t, x: t.agg(F.sum(x)).first()[0] or 0.0
    state = table(with_z(b.select("i", F.col("v").alias("r"), F.lit(0.0).alias("x"))).withColumn("p", F.col("z")))
    start = rz = total(state, F.col("r") * F.col("z"))
    history = [] if history is None else history
    for _ in range(most):
        history.append(max(rz, 0.0) ** 0.5)
        if rz <= tolerance**2 * start:
            break
        ap = algebra.matvec(a, state.select("i", F.col("p").alias("v"))).select("i", F.col("v").alias("ap"))
        state = table(state.join(ap, "i"))
        alpha = rz / total(state, F.col("p") * F.col("ap"))
        state = state.select("i", (F.col("r") - alpha * F.col("ap")).alias("r"), (F.col("x") + alpha * F.col("p")).alias("x"), "p")
        state = table(with_z(state))
        now = total(state, F.col("r") * F.col("z"))
        state = state.withColumn("p", F.col("z") + now / rz * F.col("p"))
        rz = now
    if rz > tolerance**2 * start:
        raise RuntimeError(f"conjugate gradients: residual {(rz / start) ** 0.5:.1e} of the first after {most} iterations, above {tolerance:.1e}")
    return state.select("i", F.col("x").alias("v"))
