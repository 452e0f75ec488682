"""The library's functions for SQL: after register(), a session's SQL can call them; all are expressions or queries of built-in functions."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession

from .columns import GRID, NORMAL_BOTTOM, NORMAL_TOP

_FAN = {"q05": 0, "q25": 4, "q50": 9, "q75": 14, "q95": 18}


def _polynomial(terms: tuple[float, ...]) -> str:
    out = repr(terms[0]) + "D"
    for c in terms[1:]:
        out = f"({out} * abs(x) + {c!r}D)"
    return out


def _definitions() -> dict[str, str]:
    tail = f"CASE WHEN abs(x) > 7 THEN 0D ELSE exp(-x * x / 2) * {_polynomial(NORMAL_TOP)} / {_polynomial(NORMAL_BOTTOM)} END"
    angle = f"atan(x / {math.sqrt(5)!r}D)"
    grid = "array(" + ", ".join(f"{q!r}D" for q in GRID) + ")"
    at = "(size(filter(xs, v -> v <= x)) - 1)"
    prices = ", ".join(f"p0 * exp(mu * k / steps + sigma * get(z, {i}) * sqrt(k / steps))" for i in _FAN.values())
    return {
        "clipped(x DOUBLE, low DOUBLE, high DOUBLE) RETURNS DOUBLE": "CASE WHEN x IS NOT NULL THEN greatest(low, least(high, x)) END",
        "normal_cdf(x DOUBLE) RETURNS DOUBLE": f"CASE WHEN x > 0 THEN 1 - {tail} WHEN x <= 0 THEN {tail} END",
        "t5_cdf(x DOUBLE) RETURNS DOUBLE": f"0.5D + ({angle} + sin({angle}) * cos({angle}) * (1 + pow(cos({angle}), 2) * 2 / 3)) / pi()",
        "interpolated(x DOUBLE, xs ARRAY<DOUBLE>, ys ARRAY<DOUBLE>) RETURNS DOUBLE": f"""CASE WHEN x <= get(xs, 0) THEN get(ys, 0) WHEN x >= get(xs, size(xs) - 1) THEN get(ys, size(ys) - 1)
            ELSE get(ys, {at}) + (x - get(xs, {at})) * try_divide(get(ys, {at} + 1) - get(ys, {at}), get(xs, {at} + 1) - get(xs, {at})) END""",
        "probability_below(x DOUBLE, prices ARRAY<DOUBLE>) RETURNS DOUBLE": f"interpolated(x, prices, {grid})",
        "re_anchored(mu DOUBLE, lam_used DOUBLE, p0 DOUBLE, spot DOUBLE) RETURNS DOUBLE": "CASE WHEN abs(spot / p0 - 1) > 1e-6 THEN mu - lam_used * ln(spot / p0) ELSE mu END",
        f"fan(p0 DOUBLE, mu DOUBLE, sigma DOUBLE, z ARRAY<DOUBLE>, steps INT) RETURNS TABLE(step INT, {', '.join(f'{n} DOUBLE' for n in _FAN)})": f"SELECT k, {prices} FROM explode(sequence(1, steps)) AS t(k)",
    }


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session, and returns their names. fan is a table: SELECT ... FROM leaves, LATERAL fan(p0, mu, sigma, z, 12)."""
    made = _definitions()
    for head, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in made]
