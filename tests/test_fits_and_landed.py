"""Closed-form fits and the choice between two sources, on small tables."""

import numpy as np
import pytest

from tidemark.operators import volatility
from tidemark.plans import QUERIES
from tidemark.sources.tables import with_fallback

SF = "/root/testdata/sf0.01"


def test_targeted_variances_against_a_plain_walk(spark):
    rng = np.random.default_rng(3)
    r = [None, *(rng.normal(0, 0.02, 299)).tolist()]
    rows = [("a", i, x) for i, x in enumerate(r)] + [("flat", i, 0.0) for i in range(260)] + [("short", i, 0.01) for i in range(5)]
    d = spark.createDataFrame(rows, "index_id string, pos long, r double")
    got = {(x.index_id, x.pos): x for x in volatility.garch(d, fits=volatility.targeted_fits(d, 0.1, 0.8)).collect()}
    h = target = None
    for i, x in enumerate(r):
        if i >= volatility.MIN_HISTORY:
            if i == volatility.MIN_HISTORY or i % volatility.REFIT == 0:
                h = target = np.var([y for y in r[: i + 1] if y is not None])
            h = 0.1 * target + 0.1 * x * x + 0.8 * h
            assert got["a", i].v_garch == pytest.approx(h) and got["a", i].v_garch_failed == 0
        else:
            assert got["a", i].v_garch is None
    # Returns that don't vary have no fit: refits at 240 and 252 are counted, the seed stands.
    assert got["flat", 259].v_garch == 0 and got["flat", 259].v_garch_failed == 2
    assert all(got["short", i].v_garch is None for i in range(5))
    assert volatility.targeted_fits(d.limit(0)).count() == 0


def test_second_source_fills_whole_series_only(spark):
    s = "k string, d int, v double"
    one = spark.createDataFrame([("a", 1, 1.0), ("a", 2, None), (None, 1, 5.0)], s)
    two = spark.createDataFrame([("a", 3, 9.0), ("b", 1, 2.0), ("b", 1, 2.0)], s)
    rows = lambda x, y: sorted(map(tuple, with_fallback(x, y.withColumn("more", y["d"]), ["k"]).collect()), key=str)
    assert rows(one, two) == sorted([("a", 1, 1.0, "primary"), ("a", 2, None, "primary"), (None, 1, 5.0, "primary"), ("b", 1, 2.0, "second"), ("b", 1, 2.0, "second")], key=str)
    assert [r[-1] for r in rows(one.limit(0), two)] == ["second"] * 3 and len(rows(one, two.limit(0))) == 3


def test_the_queries_meet_their_cases(spark):
    """Coefficients that stay and go, both sources, and all states of short series but the flat one, which random prices don't have."""
    net = QUERIES["k16_one_feature_net"](spark, SF).collect()
    assert any(r.coef for r in net) and len({r.refit for r in net}) > 20
    assert {r.source for r in QUERIES["a09_two_sources"](spark, SF).select("source").distinct().collect()} == {"primary", "second"}
    assert {r.state for r in QUERIES["b16_short_series"](spark, SF).select("state").distinct().collect()} <= {"empty", "short", "flat", "scored"}
