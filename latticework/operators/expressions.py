"""Roots, quadrature and ODEs of Column-valued callables: the routine is an expression that Catalyst sees.

``f`` takes Columns and returns a Column, so there is no Python in the tasks. The
iterates are those of ``numerics``; a row that can't be solved gets a reason, not an
error, since one row must not end a job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import require
from .numerics import gauss_rule

Function = Callable[[Column], Column]

#: Steps of a round.
ROUND = 16


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once: the end of a fold without steps, which makes no array."""
    return F.aggregate(F.array(), value, lambda v, _: v, use)


def _record(**fields: Column) -> Column:
    return F.struct(*[c.alias(name) for name, c in fields.items()])


def _answer(state: Column) -> Column:
    return _record(**{c: state[c] for c in ("root", "error_estimate", "iterations")}, converged=state["reason"] == "converged", reason=state["reason"])


def _repeat(cap: int, start: Column, step: Callable[[Column], Column]) -> Column:
    """Steps until a state has a reason, ``cap`` at most; a row that has one passes over whole rounds of steps."""

    def going(s: Column, further: Column) -> Column:
        return F.when(s["reason"] != "iteration_cap", s).otherwise(further)

    rounds = F.array(*[F.sequence(F.lit(lo), F.lit(min(cap, lo + ROUND) - 1)) for lo in range(0, cap, ROUND)])
    last = F.aggregate(rounds, start, lambda s, r: going(s, F.aggregate(r, s, lambda s, _: going(s, step(s)))))
    return _let(last, _answer)


def bisection(f: Function, a: Column, b: Column, tolerance: float = 1e-12, cap: int = 200) -> Column:
    """Struct of root, error_estimate (half the bracket), iterations, converged and reason.

    The root is null with the reason no_bracket where the ends do not differ in sign or are no numbers.
    """
    require(cap >= 1, "one iteration at least")

    def opposite(u: Column, v: Column) -> Column:
        return ~F.isnan(u) & ~F.isnan(v) & ((u < 0) != (v < 0))

    def begin(ends: Column) -> Column:
        lo, hi, u, v = (ends[c] for c in ("lo", "hi", "u", "v"))
        reason = F.when((u == 0) | (v == 0), "converged").when(opposite(u, v), "iteration_cap").otherwise("no_bracket")
        error = F.when((u == 0) | (v == 0), 0.0).otherwise(F.abs(hi - lo) / 2)
        return _record(lo=lo, hi=hi, u=u, root=F.when(u == 0, lo).when(v == 0, hi), error_estimate=error, iterations=F.lit(0), reason=reason)

    def step(s: Column) -> Column:
        error = F.abs(s["hi"] - s["lo"]) / 2

        def halved(m: Column, w: Column) -> Column:
            def half(lo: Column, hi: Column, u: Column) -> Column:
                reason = F.when((w == 0) | (error <= tolerance), "converged").otherwise("iteration_cap")
                return _record(lo=lo, hi=hi, u=u, root=m, error_estimate=F.when(w == 0, 0.0).otherwise(error), iterations=s["iterations"] + 1, reason=reason)

            return F.when(opposite(s["u"], w), half(s["lo"], m, s["u"])).otherwise(half(m, s["hi"], w))

        return _let(s["lo"] + (s["hi"] - s["lo"]) / 2, lambda m: _let(f(m), lambda w: halved(m, w)))

    lo, hi = a.cast("double"), b.cast("double")
    return _repeat(cap, _let(_record(lo=lo, hi=hi, u=f(lo), v=f(hi)), begin), step)


def newton(f: Function, slope: Function, start: Column, tolerance: float = 1e-12, cap: int = 200) -> Column:
    """The same struct; the error is the last step, and a slope of zero ends a row as a breakdown."""
    require(cap >= 1, "one iteration at least")

    def step(s: Column) -> Column:
        def moved(x: Column, by: Column) -> Column:
            reason = F.when(F.isnan(x) | (F.abs(x) == float("inf")), "diverged").when(F.abs(by) <= tolerance, "converged").otherwise("iteration_cap")
            return _record(root=x, error_estimate=F.abs(by), iterations=s["iterations"] + 1, reason=reason)

        x = s["root"]
        broken = _record(root=x, error_estimate=s["error_estimate"], iterations=s["iterations"] + 1, reason=F.lit("breakdown"))
        return _let(slope(x), lambda rise: F.when(rise == 0, broken).otherwise(_let(F.try_divide(f(x), rise), lambda by: moved(x - by, by))))

    first = _record(root=start.cast("double"), error_estimate=F.lit(0.0), iterations=F.lit(0), reason=F.lit("iteration_cap"))
    return _repeat(cap, first, step)


def gauss_legendre(f: Function, a: Column, b: Column, points: int = 20) -> Column:
    """Struct of value and error_estimate, which is the gap to a rule of half the points; one flat expression."""

    def total(n: int) -> Column:
        out = F.lit(0.0)
        for x, w in gauss_rule(n):
            out = out + F.lit(w) * f((a + b) / 2 + (b - a) / 2 * F.lit(x))
        return (b - a) / 2 * out

    fine = total(points)
    return _record(value=fine, error_estimate=F.abs(fine - total(max(2, points // 2))))


def rk4(f: Callable[[Column, Column], Column], t0: Column, y0: Column, t1: Column, steps: int) -> Column:
    """Array of (t, y) from t0 to t1 by the classical fixed step; explode it for a row a step."""
    require(steps >= 1, "one step at least")

    def step(path: Column, k: Column) -> Column:
        h = (t1 - t0) / steps
        t = t0 + k * h

        def moved(y: Column) -> Column:
            half = t + h / 2
            end = lambda a, b, c, d: y + h / 6 * (a + 2 * b + 2 * c + d)
            return _let(f(t, y), lambda a: _let(f(half, y + h / 2 * a), lambda b: _let(f(half, y + h / 2 * b), lambda c: _let(f(t + h, y + h * c), lambda d: end(a, b, c, d)))))

        new = _record(t=t0 + (k + 1) * h, y=_let(F.element_at(path, -1)["y"], moved))
        return F.concat(path, F.array(new))

    start = F.array(_record(t=t0.cast("double"), y=y0.cast("double")))
    return F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), start, step)
