"""Krylov solvers over a planner. step() has no guard: after exact convergence it gives nan, as IEEE division does. solve() stops before."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import storage
from tessera.functions.scalar import Scalar
from tessera.plans.planner import RHS, SOL, SquarePlanner


class Solver:
    spaces = 0

    def __init__(self, planner: SquarePlanner):
        self.p = planner
        planner.allocate_workspace(self.spaces)
        self.residual_norm_squared: list[Scalar] = []

    def history(self) -> DataFrame:
        """(it, rr)"""
        return self.p.spark.createDataFrame([(k, float(x)) for k, x in enumerate(self.residual_norm_squared)], "it int, rr double")

    def step(self) -> None:
        raise NotImplementedError

    def run(self, iterations: int):
        for _ in range(iterations):
            self.step()
        return self

    def iterates(self, iterations: int) -> DataFrame:
        """(it, space, i, v): the solution before the first of the next steps and after each, in a table of its own."""
        kept = []
        for k in range(iterations + 1):
            if k:
                self.step()
            kept.append(storage.save(self.p.state.select(F.lit(k).alias("it"), "space", "i", F.col(self.p.name(SOL)).alias("v"))).df)
        return reduce(DataFrame.union, kept)

    def solve(self, tolerance: float = 1e-10, iterations: int = 1000):
        """Until the squared residual norm is at most tolerance squared times the first, or nothing is left to do."""
        first = float(self.residual_norm_squared[0])
        for _ in range(iterations):
            if not float(self.residual_norm_squared[-1]) > tolerance**2 * first:
                break
            self.step()
        return self

    def _residual(self, r: int, use_initial_guess: bool) -> None:
        """r = b, or b - A x."""
        if use_initial_guess:
            self.p.matvec(r, SOL)
            self.p.xpay(r, -1.0, RHS)
        else:
            self.p.copy(r, RHS)


class CG(Solver):
    """Conjugate gradients. Starts from x = 0 whatever x holds, unless use_initial_guess."""

    spaces = 3
    P, Q, R = 2, 3, 4

    def __init__(self, planner: SquarePlanner, use_initial_guess: bool = False):
        super().__init__(planner)
        self._residual(self.R, use_initial_guess)
        planner.copy(self.P, self.R)
        self.residual_norm_squared.append(planner.dot(self.R, self.R))

    def step(self) -> None:
        p, rr = self.p, self.residual_norm_squared[-1]
        p.matvec(self.Q, self.P)
        pq = p.dot(self.P, self.Q)
        p.axpy(SOL, rr, pq, self.P)
        p.axpy(self.R, -rr, pq, self.Q)
        now = p.dot(self.R, self.R)
        self.residual_norm_squared.append(now)
        p.xpay(self.P, now, rr, self.R)


class DoubleCG(Solver):
    """Two CG steps a pass: A p and A r by one join, then A q; the second step's q follows by recurrence."""

    spaces = 5
    P, Q, R, S, T = 2, 3, 4, 5, 6

    def __init__(self, planner: SquarePlanner, use_initial_guess: bool = True):
        super().__init__(planner)
        self._residual(self.R, use_initial_guess)
        planner.copy(self.P, self.R)
        self.residual_norm_squared.append(planner.dot(self.R, self.R))

    def step(self) -> None:
        p, rr = self.p, self.residual_norm_squared[-1]
        p.matvecs((self.Q, self.P), (self.S, self.R))
        p.matvec(self.T, self.Q)
        a = rr / p.dot(self.P, self.Q)
        p.axpy(SOL, a, self.P)
        p.axpy(self.R, -a, self.Q)
        mid = p.dot(self.R, self.R)
        p.xpay(self.P, mid, rr, self.R)
        p.scal(self.Q, mid, rr)
        p.axpy(self.Q, 1.0, self.S)
        p.axpy(self.Q, -a, self.T)
        b = mid / p.dot(self.P, self.Q)
        p.axpy(SOL, b, self.P)
        p.axpy(self.R, -b, self.Q)
        now = p.dot(self.R, self.R)
        p.xpay(self.P, now, mid, self.R)
        self.residual_norm_squared += [mid, now]


class BiCGStab(Solver):
    spaces = 6
    R, R0, P, V, S, U = 2, 3, 4, 5, 6, 7

    def __init__(self, planner: SquarePlanner, use_initial_guess: bool = False):
        super().__init__(planner)
        self._residual(self.R, use_initial_guess)
        planner.copy(self.R0, self.R)
        self.rho, self.alpha, self.omega = [Scalar(1.0, planner.dtype)], [Scalar(0.0, planner.dtype)], [Scalar(1.0, planner.dtype)]
        self.next_rho = planner.dot(self.R0, self.R)
        self.residual_norm_squared.append(self.next_rho)

    def step(self) -> None:
        p, rho = self.p, self.next_rho
        beta = (rho / self.rho[-1]) * (self.alpha[-1] / self.omega[-1])
        p.axpy(self.P, -self.omega[-1], self.V)
        p.xpay(self.P, beta, self.R)
        p.matvec(self.V, self.P)
        a = rho / p.dot(self.R0, self.V)
        p.copy(self.S, self.R)
        p.axpy(self.S, -a, self.V)
        p.matvec(self.U, self.S)
        su, uu = p.dots((self.S, self.U), (self.U, self.U))
        w = su / uu
        p.axpy(SOL, a, self.P)
        p.axpy(SOL, w, self.S)
        p.copy(self.R, self.S)
        p.axpy(self.R, -w, self.U)
        self.rho.append(rho)
        self.alpha.append(a)
        self.omega.append(w)
        self.next_rho, rr = p.dots((self.R0, self.R), (self.R, self.R))
        self.residual_norm_squared.append(rr)


class GMRES(Solver):
    """Restarted; a step is a whole cycle. coefficients="unit" adds every basis vector with coefficient 1, without least squares."""

    def __init__(self, planner: SquarePlanner, restart: int = 10, coefficients: str = "least_squares"):
        if coefficients not in ("least_squares", "unit"):
            raise ValueError(coefficients)
        self.restart, self.coefficients, self.spaces = restart, coefficients, restart + 1
        super().__init__(planner)
        self._start()

    def basis(self, k: int) -> int:
        return k + 2

    def _start(self) -> None:
        """The first basis vector is b - A x, which is the residual between cycles too."""
        self._residual(self.basis(0), True)
        self.residual_norm_squared.append(self.p.dot(self.basis(0), self.basis(0)))

    def step(self) -> None:
        p, m = self.p, self.restart
        first = self.residual_norm_squared[-1]
        p.scal(self.basis(0), first.rsqrt())
        h = np.zeros((m + 1, m))
        used = m
        for j in range(m):
            w = self.basis(j + 1)
            p.matvec(w, self.basis(j))
            # Classical Gram-Schmidt, twice: all products of a pass by one aggregation. What the second takes off is
            # tiny, so the norm follows from the one before it.
            for _ in range(2):
                *x, n = p.dots(*((w, self.basis(i)) for i in range(j + 1)), (w, w))
                for i, y in enumerate(x):
                    p.axpy(w, -y, self.basis(i))
                    h[i, j] += float(y)
            if j + 1 < m or self.coefficients == "least_squares":
                for y in x:
                    n = n - y * y
                h[j + 1, j] = float(n.sqrt())
                if self.coefficients == "least_squares" and float(n) <= 1e-28 * max(1.0, float(np.sum(h[:, j] ** 2))):
                    used = j + 1
                    break
                p.scal(w, n.rsqrt())
        if self.coefficients == "unit":
            c = np.ones(m)
        else:
            target = np.zeros(used + 1)
            target[0] = float(first.sqrt())
            c = np.linalg.lstsq(h[: used + 1, :used], target, rcond=None)[0]
        for j, x in enumerate(c):
            p.axpy(SOL, float(x), self.basis(j))
        self._start()
