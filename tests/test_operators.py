"""Properties and brute-force comparisons of the operators that SQL can't say, on small made series."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.columns import interpolate, normal_cdf, t5_cdf
from tidemark.operators import distribution, macro, scores, volatility, walk
from tidemark.operators import features as feat
from tidemark.operators.walk import YEAR, Horizon
from tidemark.plans import QUERIES
from tidemark.sources import tables

SF = "/root/testdata/sf0.01"


def panel(spark, n=1000, seed=1, index_id="x"):
    rng = np.random.default_rng(seed)
    dates = pd.date_range("1900-01-31", periods=n, freq="ME").date
    e = np.exp(np.cumsum(rng.normal(0.002, 0.01, n)))
    p = 15 * e * np.exp(np.sin(np.arange(n) / 40) / 3 + rng.normal(0, 0.04, n))
    return spark.createDataFrame(pd.DataFrame({"index_id": index_id, "date": dates, "p": p, "e": e}))


@pytest.fixture(scope="module")
def features(spark):
    return feat.valuation_features(feat.with_valuation(panel(spark))).cache()


def test_price_is_ratio_times_earnings(features):
    worst = features.agg(F.max(F.abs(F.col("p") - F.col("cape") * F.col("e10n")) / F.col("p"))).first()[0]
    assert worst < 1e-12


def test_degenerate_lambda(features):
    none = walk.walk(features, Horizon("t", 12, 0.0, 0.0, 0.5, 120, "core"))
    assert none.where("fc_level0_est <> fc_drift_only").count() == 0 and none.count() > 200
    assert walk.walk(features).where("abs(fc_full_reversion - fc_drift_only - gap) > 1e-12").count() == 0


def test_no_row_sees_its_future(spark, features):
    rows = {r.pos: r for r in walk.walk(features).collect()}
    at = sorted(rows)[150]
    cut = feat.valuation_features(feat.with_valuation(panel(spark)).where(F.col("pos") <= at + 12))
    then = {r.pos: r for r in walk.walk(cut).collect()}
    assert max(then) == at
    for c in ("lam_ols", "lam_used", "fc_level0_est", "fc_rw_drift", "band_q05", "band_q95"):
        assert then[at][c] == pytest.approx(rows[at][c], abs=1e-12)


def test_walk_matches_a_plain_loop(features):
    f = features.orderBy("pos").toPandas()
    rows = {r.pos: r for r in walk.walk(features).collect()}
    fwd = (f["log_p"].shift(-12) - f["log_p"]).to_numpy()
    g, gap = f["g"].to_numpy(float), f["gap"].to_numpy(float)
    ok = np.isfinite(fwd) & np.isfinite(g) & np.isfinite(gap)
    for i in list(rows)[::37]:
        j = np.flatnonzero(ok[: i - 11])
        lam = gap[j] @ (fwd[j] - g[j]) / (gap[j] @ gap[j])
        assert rows[i].lam_ols == pytest.approx(lam, rel=1e-9)
        assert rows[i].lam_used == pytest.approx(min(0.35, max(0.0, 0.5 * lam + 0.05)), rel=1e-9)
    assert len(rows) == sum(ok[i] and i >= 12 and ok[: i - 11].sum() >= 120 for i in range(len(f)))


@pytest.mark.parametrize("model", ["ewma", "garch"])
def test_simulated_matches_a_plain_loop(features, model):
    r = volatility.with_returns(features)
    v = volatility.unpivoted(volatility.ewma(r) if model == "ewma" else volatility.garch(r, refit=120), (model,))
    rows = distribution.simulated(distribution.level_calibrated(distribution.residuals(walk.walk(features), v, YEAR), YEAR), YEAR).orderBy("opos").toPandas()
    resid, raw = rows["resid"].to_numpy(float), rows["raw"].to_numpy(float)
    sigma = np.full(len(rows), np.nan)
    for i in range(len(rows)):
        done = np.arange(max(0, i - 11))
        ok = done[np.isfinite(raw[done])]
        if len(done) >= 120 and len(ok) >= 120 and np.isfinite(raw[i]):
            sigma[i] = raw[i] * np.sqrt(np.mean(resid[ok] ** 2) / np.mean(raw[ok] ** 2))
    np.testing.assert_allclose(rows["sigma"].to_numpy(float), sigma, rtol=1e-9)
    scored = 0
    for i in range(len(rows)):
        z = (resid / sigma)[: max(0, i - 11)]
        z = z[np.isfinite(z)]
        if np.isfinite(sigma[i]) and len(z) >= 120:
            scored += 1
            np.testing.assert_allclose(rows["quant"][i], rows["mu"][i] + sigma[i] * np.quantile(z, np.arange(1, 20) / 20), rtol=1e-9)
            assert rows["pit"][i] == pytest.approx(np.mean(z <= resid[i] / sigma[i]))
            assert list(rows["quant"][i]) == sorted(rows["quant"][i])
        else:
            assert rows["quant"][i] is None
    assert scored > 50


def test_kitchen_sink_matches_least_squares(features):
    xs = [F.col("log_cape"), F.col("gap"), F.col("g")]
    got = {r.pos: r.fc for r in walk.kitchen_sink(features, xs).collect()}
    f = features.orderBy("pos").toPandas()
    y = (f["log_p"].shift(-12) - f["log_p"]).to_numpy()
    x = f[["log_cape", "gap", "g"]].to_numpy(float)
    ok = np.isfinite(y) & np.isfinite(x).all(1)
    for i in list(got)[::53]:
        j = np.flatnonzero(ok[: i - 11])
        b = np.linalg.lstsq(np.column_stack([np.ones(len(j)), x[j]]), y[j], rcond=None)[0]
        assert got[i] == pytest.approx(b[0] + x[i] @ b[1:], rel=1e-5, abs=1e-7)


def simulated_returns(n=3000, seed=2, omega=0.1, alpha=0.1, beta=0.85):
    rng = np.random.default_rng(seed)
    h, r = omega / (1 - alpha - beta), np.zeros(n)
    for t in range(n):
        r[t] = math.sqrt(h) * rng.standard_t(8) * math.sqrt(6 / 8)
        h = omega + alpha * r[t] ** 2 + beta * h
    return r


def test_garch_finds_its_parameters():
    r = simulated_returns(4000)
    o, a, b, last = volatility.fit_garch(r)
    assert abs(a - 0.1) < 0.04 and abs(b - 0.85) < 0.07 and abs(o - 0.1) < 0.1 and last > 0
    path = volatility.variance_paths(r[None, :100], np.array([0.1]), np.array([0.1]), np.array([0.85]), 2.0)[0]
    v = 2.0
    for t in range(100):
        assert path[t] == pytest.approx(v, rel=1e-12)
        v = 0.1 + 0.1 * r[t] ** 2 + 0.85 * v
    with pytest.raises(ValueError, match="vary"):
        volatility.fit_garch(np.zeros(300))


def test_garch_fit_is_the_likelihoods_top():
    """No other start, and no step from the fit, has a higher likelihood, said here in plain words."""

    def minus_log(r, mu, omega, alpha, beta, nu):
        h, total = float(np.var(r)), 0.0
        for x in r - mu:
            total += math.lgamma(nu / 2) - math.lgamma((nu + 1) / 2) + 0.5 * math.log(math.pi * (nu - 2) * h) + (nu + 1) / 2 * math.log1p(x * x / (h * (nu - 2)))
            h = omega + alpha * x * x + beta * h
        return total / len(r)

    r = simulated_returns(900, seed=5)
    free = np.array([0.1, math.log(0.05), 3.0, -2.0, math.log(5.0)])
    natural = [float(p[0]) for p in volatility._natural(free[None, :], float(np.var(r)))]
    assert float(volatility.loss(free[None, :], r, float(np.var(r)))[0]) == pytest.approx(minus_log(r, *natural), rel=1e-9)
    omega, alpha, beta, _ = volatility.fit_garch(r)
    best = min(minus_log(r, mu, omega, alpha, beta, nu) for mu in np.linspace(-0.2, 0.2, 9) for nu in (5, 6, 7, 8, 10, 13, 20))
    assert best <= minus_log(r, 0.0, 0.1, 0.1, 0.85, 8.0) + 1e-3
    rng = np.random.default_rng(0)
    for _ in range(25):
        a, b = rng.uniform(0.01, 0.3), rng.uniform(0.5, 0.95)
        if a + b < 0.999:
            assert best <= minus_log(r, 0.0, rng.uniform(0.01, 0.5), a, b, rng.uniform(4, 12)) + 1e-3


def test_garch_matches_a_plain_walk(spark):
    """Series with gaps and one that never varies; each row's variance told anew from the fit in force."""
    r = {"a": simulated_returns(330) / 100, "b": simulated_returns(300, seed=9) / 100, "flat": np.zeros(280)}
    r["b"][[0, 250, 263, 264]] = np.nan
    rows = [(k, t, None if np.isnan(x) else float(x)) for k, xs in r.items() for t, x in enumerate(xs)]
    frame = spark.createDataFrame(rows, "index_id string, pos long, r double")
    got = {(x.index_id, x.pos): x for x in volatility.garch(frame, refit=24).collect()}
    assert len(got) == len(rows)
    for k, xs in r.items():
        known = lambda t: xs[: t + 1][~np.isnan(xs[: t + 1])] * 100
        made = {}
        for t in [t for t in range(240, len(xs)) if t == 240 or t % 24 == 0]:
            if np.var(known(t)) > 0:
                omega, alpha, beta, last = volatility.fit_garch(known(t))
                made[t] = (omega / 1e4, alpha, beta, last / 1e4)
        for t in range(len(xs)):
            if t < 240:
                assert got[k, t].v_garch is None
                continue
            start = max((s for s in made if s <= t), default=None)
            want = float(np.nanvar(xs[:240]))
            if start is not None:
                omega, alpha, beta, want = made[start]
                for x in xs[start : t + 1]:
                    want = want if np.isnan(x) else omega + alpha * x * x + beta * want
            assert got[k, t].v_garch == pytest.approx(want, rel=1e-9, abs=1e-15), (k, t)
            assert got[k, t].v_garch_failed == (0 if k != "flat" else len([s for s in range(240, t + 1) if s % 24 == 0]))


def test_garch_uses_the_past_only(spark):
    r = simulated_returns(300, seed=3) / 100
    frame = spark.createDataFrame([("x", t, float(x)) for t, x in enumerate(r)], "index_id string, pos long, r double")
    whole, cut = ({x.pos: x.v_garch for x in volatility.garch(frame.where(f"pos < {n}"), refit=30).collect()} for n in (300, 280))
    assert all(whole[t] == cut[t] for t in range(280)) and all(whole[t] is not None for t in range(240, 300))


def plain_elastic_net(x, y, alpha, ratio, passes=20000):
    """Coordinate descent on rows, centred within the call."""
    x, y = x - x.mean(axis=0), y - y.mean()
    w, n = np.zeros(x.shape[1]), len(y)
    for _ in range(passes):
        before = w.copy()
        for j in range(len(w)):
            rest = y - x @ w + x[:, j] * w[j]
            pull = x[:, j] @ rest / n
            w[j] = np.sign(pull) * max(abs(pull) - alpha * ratio, 0) / (x[:, j] @ x[:, j] / n + alpha * (1 - ratio))
        if np.abs(w - before).max() < 1e-13:
            break
    return w


def test_elastic_net_matches_plain_cross_validation():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(203, 4)) * [1, 5, 0.1, 1]
    x[:, 3] = 0.7 * x[:, 0] + 0.5 * x[:, 3]
    y = 2 * x[:, 0] - 0.4 * x[:, 1] + 0.3 + rng.normal(0, 2, 203)
    parts = np.array_split(np.arange(203), 5)
    edges = [0, *np.cumsum([len(p) for p in parts])]
    ratios, n_alphas = (0.5, 1.0), 12
    coef, level, alpha, ratio = macro.fit([macro.Moments.of(x[:e], y[:e]) for e in edges], ratios, n_alphas)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    best = (np.inf, 0, 0)
    for q in ratios:
        top = np.abs(z.T @ (y - y.mean())).max() / 203 / q
        for a in np.geomspace(top, top * 1e-3, n_alphas):
            error = 0.0
            for p in parts:
                t = np.setdiff1d(np.arange(203), p)
                w = plain_elastic_net(z[t], y[t], a, q)
                error += np.mean((y[p] - y[t].mean() - (z[p] - z[t].mean(axis=0)) @ w) ** 2) / 5
            if error < best[0] - 1e-12:
                best = (error, a, q)
    assert (alpha, ratio) == (pytest.approx(best[1], rel=1e-9), best[2])
    w = plain_elastic_net(z, y, best[1], best[2])
    assert coef == pytest.approx(w / x.std(axis=0), rel=1e-6, abs=1e-8)
    assert level == pytest.approx(y.mean() - x.mean(axis=0) @ (w / x.std(axis=0)), rel=1e-6)


def test_elastic_net_walks_forward(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(420, 3)) + [0, 100, 0]
    y = 2 * x[:, 0] - 0.4 * x[:, 1] + rng.normal(0, 0.1, 420)
    frame = pd.DataFrame({"index_id": "x", "pos": range(420), "y": y, **{f"f{i}": x[:, i] for i in range(3)}})
    frame.loc[[5, 77], "f1"] = None
    names = [f"f{i}" for i in range(3)]
    rows = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "index_id string, pos long, y double, f0 double, f1 double, f2 double")
    out = macro.walk_forward(rows, names, "y", 12, refit=60, ratios=(0.5, 1.0), n_alphas=10).orderBy("pos").toPandas()
    known = frame.dropna().reset_index(drop=True)
    assert len(out) == 418 - 191 and (out["at"] - out["trained"] == 11).all()
    for refit, one in out.groupby("refit"):
        n, first = int(one["trained"].iloc[0]), int(one["at"].iloc[0])
        assert first == max(191, 60 * refit)
        a, b = known[names].to_numpy()[:n], known["y"].to_numpy()[:n]
        edges = [0, *np.cumsum([len(p) for p in np.array_split(np.arange(n), 5)])]
        coef, level, _, _ = macro.fit([macro.Moments.of(a[:e], b[:e]) for e in edges], (0.5, 1.0), 10)
        at = known[known["pos"].isin(one["pos"])]
        assert one["fc"].to_numpy() == pytest.approx(level + at[names].to_numpy() @ coef, abs=1e-6)
    summary = {r.feature: r for r in macro.coefficient_summary(spark.createDataFrame([("x", 1, [1.0, 0.0]), ("x", 2, [-3.0, 1.0])], "index_id string, refit long, coef array<double>"), ["p", "q"]).collect()}
    assert (summary["p"].mean_abs, summary["p"].kept, summary["q"].kept) == (2.0, 1.0, 0.5)


def test_bootstrap_matches_a_plain_loop(spark):
    flags = (np.random.default_rng(5).random(101) < 0.9).astype(int)
    rows = spark.createDataFrame(pd.DataFrame({"k": "a", "pos": range(101), "f": flags}))
    got = scores.block_bootstrap(rows, F.col("f") == 1, ["k"], "pos", 12).first()
    rng, means = np.random.default_rng(0), []
    for _ in range(2000):
        starts = rng.integers(0, 101, size=9)
        means.append(flags[np.concatenate([np.arange(s, s + 12) % 101 for s in starts])[:101]].mean())
    assert (got.lo, got.hi) == pytest.approx((np.quantile(means, 0.1), np.quantile(means, 0.9)))


def test_distribution_functions(spark):
    x = spark.createDataFrame([(v,) for v in (-8.0, -1.96, 0.0, 1.0, 3.5)], "x double")
    from statistics import NormalDist

    for r in x.select("x", normal_cdf(F.col("x")).alias("n"), t5_cdf(F.col("x")).alias("t")).collect():
        assert r.n == pytest.approx(NormalDist().cdf(r.x), abs=1e-12) and 0 <= r.t <= 1
    ys = F.array(F.lit(0.0), F.lit(1.0), F.lit(4.0))
    got = [r[0] for r in x.select(interpolate(F.col("x"), F.array(F.lit(0.0), F.lit(1.0), F.lit(3.0)), ys)).collect()]
    assert got == [0.0, 0.0, 0.0, 1.0, 4.0]


def test_forecast_document(spark, tmp_path):
    (r,) = QUERIES["a14_forecast_document"](spark, SF).collect()
    d = json.loads(r.document)
    assert d["schema_version"] == 2 and d["default"] == {"index": "main", "horizon": "12mo"} and set(d["indices"]) == {"main", "side"}
    for index in d["indices"].values():
        assert {i["key"] for i in index["indicators"]} == {"cape", "rate", "spread", "level"} and set(index["horizons"]) == {h.key for h in walk.HORIZONS}
        for h in walk.HORIZONS:
            leaf = index["horizons"][h.key]
            assert leaf["horizon_months"] == h.steps and leaf["tier"] == h.tier and len(leaf["z_grid"]) == 19
            assert leaf["return_decomp"]["growth"] + leaf["return_decomp"]["valuation"] == pytest.approx(leaf["mu"], abs=1e-9)
            path, q = leaf["fan_path"], [leaf["price_quantiles"][n] for n in ("q05", "q25", "q50", "q75", "q95")]
            assert path["months"] == list(range(h.steps + 1)) and q == sorted(q) and q[0] > 0
            assert [path[n][-1] for n in ("q05", "q25", "q50", "q75", "q95")] == pytest.approx(q, abs=0.011) and path["q05"][0] == path["q95"][0] == pytest.approx(leaf["p0"], abs=0.011)
            assert leaf["calibration"]["n"] > 0
    docs = spark.createDataFrame([(1, r.document), (2, "no json"), (3, None), (4, '{"spot": 2, "p0": 1.5, "mu": 0.1}'), (5, '{"schema_version": 2}')], "k int, document string")
    tables.write_document(docs, str(tmp_path / "d"))
    back = tables.leaves_of(spark.read.schema("k int, document string").json(str(tmp_path / "d"))).collect()
    assert {(x.index_id, x.horizon): x.mu for x in back if x.k == 1} == {(i, h): leaf["mu"] for i, v in d["indices"].items() for h, leaf in v["horizons"].items()}
    assert [(x.k, x.index_id, x.horizon, x.spot, x.p0, x.mu, x.sigma) for x in back if x.k > 1] == [(4, "main", "12mo", 2.0, 1.5, 0.1, None)]


def test_parts_that_do_not_add_up_fail(spark):
    from tidemark.operators.document import decomposed

    ok = spark.createDataFrame([(0.2, 0.15, 0.05, 2.0)], "mu double, growth double, valuation double, years double")
    r = decomposed(ok).first()
    assert r.growth_pct + r.valuation_pct == pytest.approx(r.total_pct) and r.total_pct == pytest.approx(100 * (math.exp(0.1) - 1))
    with pytest.raises(Exception, match="add up"):
        decomposed(ok.withColumn("mu", F.col("mu") + 1e-6)).collect()


def brute_calibration(rows):
    """n, pinball, KS distance and coverage of one model's rows, plainly."""
    q, r, grid = np.array([x.quant for x in rows]), np.array([x.realized for x in rows]), np.arange(1, 20) / 20
    pit = np.sort([x.pit for x in rows if x.pit is not None])
    i = np.arange(1, len(pit) + 1)
    d = r[:, None] - q
    return len(rows), np.maximum(grid * d, (grid - 1) * d).mean(), max(np.abs(i / len(pit) - pit).max(), np.abs((i - 1) / len(pit) - pit).max()), np.mean((r >= q[:, 0]) & (r <= q[:, 18]))


@pytest.fixture(scope="module")
def with_garch(spark):
    """The panel of the small tables with all variances: GARCH fitted every 120 rows here, as only the chain after it is compared."""
    from tidemark.operators.volatility import constant, ewma, garch
    from tidemark.plans.panel import panel as plan
    from tidemark.sources.tables import kept

    return kept(garch(ewma(constant(plan(spark, SF))), refit=120).withColumn("v_vix", F.pow(F.col("rate") * 4, F.lit(2.0)) / 12))


def test_garch_goes_through_the_chain(spark, with_garch, monkeypatch):
    """The queries without SQL against plain calculations on the rows that their panel gives."""
    from collections import defaultdict

    from tidemark.operators.walk import horizon
    from tidemark.plans import spread
    from tidemark.plans.panel import fhs

    monkeypatch.setattr(spread, "features", lambda *_: with_garch)
    monkeypatch.setattr(spread, "with_variances", lambda f, names: f)
    monkeypatch.setattr(spread, "_KEYS", ("12mo", "60mo"))
    monkeypatch.setattr(spread, "BOARD_HORIZONS", ("36mo",))
    close = lambda got, want: got == pytest.approx(want, abs=2e-6)
    rows = {k: fhs(with_garch, horizon(k), ("const", "ewma", "garch", "vix")).where("quant IS NOT NULL").collect() for k in ("12mo", "60mo")}

    def shared(k, names):
        by = defaultdict(dict)
        for x in rows[k]:
            if x.model in names:
                by[x.index_id, x.opos][x.model] = x
        out = defaultdict(list)
        for (index_id, _), xs in by.items():
            if len(xs) == len(names):
                for m, x in xs.items():
                    out[index_id, m].append(x)
        return out

    got = spread.k31_common_window_garch(spark, SF).collect()
    assert len(got) == 12
    for x in got:
        own = [y for y in rows["12mo"] if (y.index_id, y.model) == (x.index_id, x.model)]
        want = brute_calibration(own if x.window == "own" else shared("12mo", ("const", "ewma", "garch"))[x.index_id, x.model])
        assert close((x.n, x.pinball, x.pit_ks, x.cover_90), want)
    for x in spread.k11_implied_against_garch(spark, SF).collect():
        by = shared(x.horizon, ("garch", "vix"))
        g, v = brute_calibration(by[x.index_id, "garch"]), brute_calibration(by[x.index_id, "vix"])
        assert close((x.n, x.garch_pinball, x.vix_pinball, x.garch_cover_90, x.vix_cover_90), (g[0], g[1], v[1], g[3], v[3]))
        assert x.winner == ("garch" if g[1] <= v[1] else "vix")
    for x in spread.e22_multi_horizon_garch(spark, SF).collect():
        want = brute_calibration(shared(x.horizon, ("const", "ewma", "garch"))[x.index_id, x.model])
        assert close((x.n, x.pinball, x.pit_ks, x.cover_90), want) and x.n_eff == max(1, x.n // horizon(x.horizon).steps)
        assert (x.lo is None) == (x.tier == "core") and (x.lo is None or x.lo <= x.cover_90 + 0.1 and x.lo <= x.hi)
    quant = spread.k30_predictive_quantiles(spark, SF).collect()
    assert {x.model for x in quant} == {"const", "ewma", "garch", "spread"}
    by = {(y.index_id, y.model, y.opos): y for y in rows["12mo"]}
    for x in quant:
        if x.model != "spread":
            y = by[x.index_id, x.model, x.opos]
            assert close((x.q05, x.q50, x.q95, x.pit), (y.quant[0], y.quant[9], y.quant[18], y.pit))
    own = {(x.index_id, x.opos) for x in quant if x.model == "spread"}
    for x in spread.k12_macro_question_garch(spark, SF).collect():
        if x.model != "spread":
            assert close((x.n, x.pinball, x.pit_ks, x.cover_90), brute_calibration([y for y in rows["12mo"] if (y.index_id, y.model) == (x.index_id, x.model) and (y.index_id, y.opos) in own]))
    board = spread.k14_distribution_leaderboard_garch(spark, SF).collect()
    h = horizon("36mo")
    fit = fhs(with_garch, h, ("garch",)).where("quant IS NOT NULL").collect()
    for x in board:
        own = [y for y in fit if y.index_id == x.index_id]
        assert x.n == len(own)
        if x.model == "garch_fhs":
            assert close((x.pinball, x.pit_ks, x.cover_90), brute_calibration(own)[1:])
        if x.model == "gaussian":
            from statistics import NormalDist

            assert close(x.cover_90, np.mean([abs((y.realized - y.mu) / y.sigma) <= NormalDist().inv_cdf(0.95) for y in own]))
    for index_id in {x.index_id for x in board}:
        ranked = sorted((x for x in board if x.index_id == index_id), key=lambda x: x.rank)
        assert [x.pinball for x in ranked] == sorted(x.pinball for x in ranked) and ranked[0].verdict == "best"


def test_kitchen_sink_on_the_leaderboard(spark):
    """The rows of the models with SQL are the same beside the one without."""
    few, all_ = (QUERIES[n](spark, SF).collect() for n in ("k13_point_leaderboard_horizons", "k13_point_leaderboard_all"))
    score = lambda x: (x.oos_r2, x.oos_r2_late, x.dir_hit, x.cw_t, x.n, x.n_eff, x.verdict)
    by = {(x.horizon, x.index_id, x.model): score(x) for x in all_}
    assert all(by[x.horizon, x.index_id, x.model] == score(x) for x in few) and {m for _, _, m in by} - {x.model for x in few} == {"goyal_welch"}


@pytest.mark.parametrize("name", ["d20_block_bootstrap", "e27_kitchen_sink"])
def test_queries_without_sql_have_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_sources(spark, tmp_path):
    (tmp_path / "RATE.csv").write_text("when,RATE\n2020-01-01,1.5\n2020-02-01,.\n2020-03-01,x\n")
    got = tables.read_series_csv(spark, str(tmp_path / "RATE.csv")).orderBy("date").collect()
    assert [(r.series_id, r.value) for r in got] == [("RATE", 1.5), ("RATE", None), ("RATE", None)]
    (tmp_path / "d.csv").write_text("date,open,high,low,close,volume\n1990-01-02,1,2,0.5,1.5,10\n1990-01-03,,,,NaN,\n")
    assert tables.read_daily_csv(spark, str(tmp_path / "d.csv"), 1990).count() == 1
    with pytest.raises(ValueError, match="history"):
        tables.read_daily_csv(spark, str(tmp_path / "d.csv"), 1980)
    doc = spark.createDataFrame([(1, [1.0, 2.0])], "a int, b array<double>")
    tables.write_document(doc, str(tmp_path / "doc"))
    assert tables.read_document(spark, str(tmp_path / "doc"), doc.schema).first() == doc.first()
    assert tables.read_optional(spark, str(tmp_path / "doc"), doc.schema).count() == 1
    none = tables.read_optional(spark, str(tmp_path / "no"), doc.schema)
    assert none.schema == doc.schema and none.count() == 0


def test_every_series_is_tried_before_it_fails(spark, tmp_path):
    for name, body in (("A", "d,A\n2020-01-01,1\n"), ("B", "d,B\n2020-01-01,.\n"), ("C", "d,C\n2020-02-01,3\n")):
        (tmp_path / f"{name}.csv").write_text(body)
    paths = {n: str(tmp_path / f"{n}.csv") for n in "ABCD"}
    with pytest.raises(ValueError, match="B: no values; D: "):
        tables.read_all_series(spark, paths)
    got = tables.read_all_series(spark, {n: paths[n] for n in "AC"})
    assert sorted((r.series_id, str(r.date), r.value) for r in got.collect()) == [("A", "2020-01-01", 1.0), ("C", "2020-02-01", 3.0)]


def test_a_second_index_never_breaks_the_first(spark):
    one = lambda n: spark.createDataFrame([(n, 1.0)], "index_id string, x double")

    def late():
        return one("late").withColumn("x", F.raise_error(F.lit("no data today")).cast("double"))

    def early():
        raise FileNotFoundError("no file")

    rows, failed = tables.isolated(one("main"), {"side": lambda: one("side"), "late": late, "early": early})
    assert {r.index_id for r in rows.collect()} == {"main", "side"} and set(failed) == {"late", "early"} and failed["early"] == "no file"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, 2.5)], "k string, n int, v double").withColumn("d", F.lit("2020-02-29").cast("date"))
    tables.write_table(df, str(tmp_path / "t"), "k")
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "t")).select(*df.columns).collect())) == sorted(map(str, df.collect()))
    tables.write_csv(df, str(tmp_path / "c"))
    assert spark.read.schema(df.schema).option("header", True).csv(str(tmp_path / "c")).orderBy("n").collect() == df.orderBy("n").collect()
    kept = tables.kept(df)
    assert kept.schema == df.schema and kept.count() == 2
    tables.forget(spark)
    with pytest.raises(Exception):
        kept.count()
    assert tables.kept(df).count() == 2


def test_gate_in_strict_mode(spark):
    rows = scores.gate(spark.createDataFrame([("a", "m", 0.9), ("b", "m", 0.85), ("c", "m", None)], "index_id string, model string, cover_90 double"))
    assert [r.passed for r in scores.enforce(rows).orderBy("index_id").collect()] == [True, False, None]
    with pytest.raises(ValueError, match="b m 0.850"):
        scores.enforce(rows.where("index_id <> 'c'"), strict=True)
    assert scores.enforce(rows.where("index_id = 'a'"), strict=True).count() == 1


def test_chunks(spark):
    from tidemark.operators.series import from_chunks

    day = lambda n: f"2020-01-{n:02d}"
    rows = [("ok", day(1 + 5 * c), day(5 + 5 * c), day(d), float(d)) for c in range(3) for d in range(1 + 5 * c, 6 + 5 * c)] + [("ok", day(6), day(10), day(5), -1.0)]
    rows += [("clamped", day(1 + 5 * c), day(5 + 5 * c), day(d), float(d)) for c in range(3) for d in range(12, 16)]
    df = spark.createDataFrame(rows, "series_id string, a string, b string, d string, value double").select("series_id", F.to_date("a").alias("since"), F.to_date("b").alias("until"), F.to_date("d").alias("date"), "value")
    got = sorted((r.series_id, str(r.date), r.value) for r in from_chunks(df).collect())
    assert got == sorted([("ok", day(d), float(d)) for d in range(1, 16)] + [("clamped", day(d), float(d)) for d in range(12, 16)])


def test_weighted_variance_in_blocks():
    from tidemark.streaming.live import folded_ewma

    r = np.random.default_rng(7).normal(size=1234)
    v, n = 0.0, 0
    for at in (0, 1, 700):
        v, n = folded_ewma(v, n, r[at : {0: 1, 1: 700, 700: 1234}[at]])
    want = r[0] ** 2
    for x in r[1:]:
        want = 0.94 * want + 0.06 * x * x
    assert n == 1234 and v == pytest.approx(want, rel=1e-9)
    assert folded_ewma(2.0, 5, np.zeros(0)) == (2.0, 5)


def test_golden_anchor(spark):
    """Growth, weight and gap of one published forecast, and what they come to; an estimate and its shrunk weight."""
    growth, weight, gap = 0.054596, 0.084136, -0.635474
    assert growth + weight * gap == pytest.approx(0.0011299, abs=1e-4)
    from tidemark.functions.columns import clip

    lam = spark.range(1).select(clip(0.5 * F.lit(0.068271) + 0.5 * F.lit(0.10), 0.0, 0.35)).first()[0]
    assert lam == pytest.approx(weight, abs=1e-6)
    high, low, close = 6945.77, 4835.04, 6845.50
    from tidemark.operators.series import annual_pivots

    days = spark.createDataFrame([("x", "2025-03-01", high, low, close - 100), ("x", "2025-12-31", high - 50, low + 50, close)], "index_id string, day string, high double, low double, close double").withColumn("date", F.to_date("day"))
    r = annual_pivots(days).first()
    assert (r.year, r.provisional) == (2026, False)
    assert [round(x, 2) for x in (r.mid, r.r1, r.s1, r.r2, r.s2)] == [6208.77, 7582.50, 5471.77, 8319.50, 4098.04]


def test_forecasts_at_turning_points_stay_sane(features):
    """Half-year forecasts at the highest and lowest prices against their trend: between -35 and +60 per cent, and lower at the top."""
    from tidemark.operators.walk import horizon

    rows = walk.walk(features, horizon("6mo")).orderBy("gap").toPandas()
    pct = 100 * (np.exp(rows["fc_level0_est"].to_numpy()) - 1)
    assert len(rows) > 200 and pct.min() > -35 and pct.max() < 60
    assert pct[:20].mean() < pct[-20:].mean()


def test_coverage_gate_on_simulated_prices(spark):
    """Prices whose variances come and go as GARCH says: a 90 per cent band that filters them covers 86 to 94."""
    n = 2600
    r = simulated_returns(n, seed=11) / 25
    dates = pd.date_range("1800-01-31", periods=n, freq="ME").date
    p = 100 * np.exp(np.cumsum(r) * 0.2 + 0.003 * np.arange(n))
    e = p / 15 * np.exp(np.random.default_rng(1).normal(0, 0.05, n))
    f = volatility.with_returns(feat.valuation_features(feat.with_valuation(spark.createDataFrame(pd.DataFrame({"index_id": "x", "date": dates, "p": p, "e": e})))))
    f = tables.kept(volatility.ewma(volatility.garch(f, refit=240)))
    rows = distribution.simulated(distribution.level_calibrated(distribution.residuals(walk.walk(f), volatility.unpivoted(f, ("ewma", "garch")), YEAR), YEAR), YEAR)
    got = {r.model: r for r in scores.gate(scores.calibration(rows, ["index_id", "model"])).collect()}
    assert got["garch"].n > 800 and got["garch"].passed, got


def test_elastic_net_queries(spark, monkeypatch):
    """The scores of k16 and the summary of d14 against the rows and fits that they are made of."""
    from tidemark.plans import moving
    from tidemark.plans.panel import panel as plan

    f = plan(spark, SF)
    monkeypatch.setattr(moving, "panel", lambda *_: f)
    made, whole = {}, moving.elastic
    monkeypatch.setattr(moving, "elastic", lambda f, mode: made.setdefault(mode, whole(f, mode)))
    monkeypatch.setattr(moving, "ELASTIC", {k: moving.ELASTIC[k] for k in ("core_standalone", "modern_residual")})
    for x in moving.k16_elastic_net(spark, SF).collect():
        j = made[x.mode][0].where(F.col("index_id") == x.index_id).toPandas()
        r, a, b = (j[c].to_numpy(float) for c in ("realized", "full", "fc_level0_est"))
        assert x.n == len(j) and x.rmse == pytest.approx(np.sqrt(np.mean((r - a) ** 2)), abs=2e-6)
        assert x.r2_level0 == pytest.approx(1 - np.sum((r - a) ** 2) / np.sum((r - b) ** 2), abs=2e-6) and x.hit == pytest.approx(np.mean(np.sign(a) == np.sign(r)), abs=2e-6)
        own = j["fc"].to_numpy(float) + (b if x.mode == "modern_residual" else 0)
        assert a == pytest.approx(own) and x.refits == made[x.mode][1].where(F.col("index_id") == x.index_id).count()
    fits = {(m, r.index_id, r.refit): r.coef for m, (_, t) in made.items() for r in t.collect()}
    for x in moving.d14_coefficients(spark, SF).collect():
        i = moving._named(moving.ELASTIC[x.mode][1]).index(x.feature)
        own = [c[i] for (m, k, _), c in fits.items() if (m, k) == (x.mode, x.index_id)]
        assert x.mean_abs == pytest.approx(np.mean(np.abs(own)), abs=2e-6) and x.kept == pytest.approx(np.mean(np.array(own) != 0), abs=2e-6)
