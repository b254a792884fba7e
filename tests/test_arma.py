"""Estimation and prediction against brute force on synthetic series."""

import numpy as np
import pandas as pd
import pytest

from marketlake.operators import arma
from marketlake.session import materialize

EXOG = ("poly_p_up", "poly_p_up_change_5m", "btc_volatility_5m")
BETA = np.array([0.5, -0.3, 0.8])
PHI, THETA = [1.2, -0.4], [0.5, 0.3]


def simulate(seed, n, phi, theta):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    e = rng.normal(scale=0.5, size=n)
    u = np.zeros(n)
    for t in range(n):
        u[t] = e[t]
        u[t] += sum(c * u[t - k - 1] for k, c in enumerate(phi) if t > k)
        u[t] += sum(c * e[t - k - 1] for k, c in enumerate(theta) if t > k)
    return x, x @ BETA + u


def brute_force(x, y, beta, phi, theta, back):
    """Row-by-row predictions with labels known up to row i - back."""
    u = y - x @ beta
    e = np.zeros(len(y))
    for t in range(len(y)):
        e[t] = u[t]
        e[t] -= sum(c * u[t - k - 1] for k, c in enumerate(phi) if t > k)
        e[t] -= sum(c * e[t - k - 1] for k, c in enumerate(theta) if t > k)
    out = []
    for i in range(len(y)):
        us, es = list(u[: max(i - back + 1, 0)]), list(e[: max(i - back + 1, 0)])
        for _ in range(back):
            step = sum(c * us[-k - 1] for k, c in enumerate(phi) if len(us) > k)
            step += sum(c * es[-k - 1] for k, c in enumerate(theta) if len(es) > k)
            us.append(step)
            es.append(0.0)
        # before the first known label nothing but the regression part is available
        out.append(x[i] @ beta + (us[-1] if i >= back else 0.0))
    return np.array(out)


@pytest.fixture(scope="module")
def data():
    return {
        "arma": simulate(1, 3000, PHI, THETA),
        "ar": simulate(2, 1500, [0.6], []),
    }


@pytest.fixture(scope="module")
def split(spark, data):
    frames = []
    for name, (x, y) in data.items():
        pdf = pd.DataFrame(x, columns=EXOG)
        pdf["log_return_5m"], pdf["series"] = y, name
        pdf["idx"] = np.arange(len(y))
        pdf["split"] = np.where(pdf["idx"] < int(len(y) * 0.8), "train", "holdout")
        frames.append(pdf)
    short = frames[0].head(6).assign(series="short", split="insufficient")
    return materialize(spark.createDataFrame(pd.concat([*frames, short])))


@pytest.fixture(scope="module")
def params(split):
    # a small chunk, so lags, halos and the recursion cross many borders
    return materialize(arma.fit_arx(split, chunk=257))


def by_series(params):
    return {r["series"]: r for r in params.collect()}


def test_recovers_coefficients(split, params):
    """At the true order the estimates are close; AIC may prefer a larger one, never a worse one."""
    true_order = by_series(arma.fit_arx(split, order=(2, 2), chunk=257))["arma"]
    assert np.allclose(true_order["beta"], BETA, atol=0.1)
    assert np.allclose(true_order["phi"], PHI, atol=0.1)
    assert np.allclose(true_order["theta"], THETA, atol=0.1)
    one = by_series(arma.fit_arx(split, order=(1, 0), chunk=257))["ar"]
    assert abs(one["phi"][0] - 0.6) < 0.1
    fitted = by_series(params)
    u = arma.residuals(split.where("split = 'train'"), arma.fit_exog(split).select("series", "beta"))
    aic = arma.order_grid(u, chunk=257).groupBy("series").min("aic").collect()
    assert {r[0]: r[1] for r in aic} == {n: r["aic"] for n, r in fitted.items() if r["status"] == "ok"}
    assert fitted["arma"]["p"] >= 2 and fitted["arma"]["q"] >= 1
    assert fitted["short"]["status"] == "insufficient" and fitted["short"]["phi"] is None


def test_chunk_size_does_not_matter(split, params):
    whole = by_series(arma.fit_arx(split, chunk=1_000_000))
    for name, row in by_series(params).items():
        if row["status"] == "ok":
            assert np.allclose(row["phi"], whole[name]["phi"], atol=1e-9)
            assert np.isclose(row["aic"], whole[name]["aic"])


@pytest.mark.parametrize("delay", [0, 5])
def test_walk_forward(split, params, data, delay):
    fitted = by_series(params)
    pred = arma.walk_forward(split, params, delay=delay, chunk=257).toPandas()
    for name, (x, y) in data.items():
        r = fitted[name]
        want = brute_force(x, y, np.array(r["beta"]), r["phi"], r["theta"], max(delay, 1))
        got = pred[pred["series"] == name].sort_values("idx")["pred"].to_numpy()
        assert len(got) == len(want)
        assert np.allclose(got, want, atol=1e-8)
    assert not (pred["series"] == "short").any()


def test_refit_matches_direct_least_squares(split, params, data):
    r = by_series(params)["ar"]
    x, y = data["ar"]
    u = y - x @ np.array(r["beta"])
    p, q = r["p"], r["q"]
    e = np.zeros(len(y))
    for t in range(len(y)):
        e[t] = u[t] - sum(c * u[t - k - 1] for k, c in enumerate(r["phi"]) if t > k)
        e[t] -= sum(c * e[t - k - 1] for k, c in enumerate(r["theta"]) if t > k)
    lag = lambda v, k: np.concatenate([np.zeros(k), v[:-k]])
    z = np.column_stack(
        [x] + [lag(u, k + 1) for k in range(p)] + [lag(e, k + 1) for k in range(q)]
    )
    got = arma.walk_forward_refit(split, params, delay=0, chunk=257).toPandas()
    got = got[got["series"] == "ar"].sort_values("idx")
    for i, value in list(zip(got["idx"], got["pred"]))[::40]:
        w = np.linalg.lstsq(z[:i], y[:i], rcond=None)[0]
        assert np.isclose(value, z[i] @ w, atol=1e-6)


def test_coef_table(split, params):
    rows = arma.coef_table(split, params, chunk=257).collect()
    terms = {(r["series"], r["term"]): r for r in rows}
    assert abs(terms["arma", "poly_p_up"]["coef"] - 0.5) < 4 * terms["arma", "poly_p_up"]["std_err"]
    assert terms["arma", "ar.L1"]["z"] > 5
    assert not any(r["series"] == "short" for r in rows)


def test_order_grid_is_complete(split):
    u = arma.residuals(split.where("split = 'train'"), arma.fit_exog(split).select("series", "beta"))
    grid = arma.order_grid(u, chunk=257).toPandas()
    assert (grid.groupby("series").size() == 15).all()
    assert not ((grid["p"] == 0) & (grid["q"] == 0)).any()


@pytest.mark.parametrize("phi,theta", [([0.0, 0.0, 0.0, 0.0, 0.5], []), ([0.3], [0.2, -0.1, 0.1, 0.4])])
def test_orders_beyond_the_default(spark, phi, theta):
    """Every coefficient counts, however long the lags."""
    x, y = simulate(5, 700, phi, theta)
    pdf = pd.DataFrame(x, columns=EXOG).assign(log_return_5m=y, series="s", idx=np.arange(len(y)))
    pdf["split"] = np.where(pdf["idx"] < 500, "train", "holdout")
    split = spark.createDataFrame(pdf)
    row = ("s", "ok", 500, len(phi), len(theta), 0.0, 0.01, BETA.tolist(), phi, theta, list(EXOG), "log_return_5m")
    given = spark.createDataFrame([row], arma.PARAMS_DDL)
    for delay in (0, 5):
        got = arma.walk_forward(split, given, delay, chunk=97).toPandas().sort_values("idx")["pred"].to_numpy()
        assert np.allclose(got, brute_force(x, y, BETA, phi, theta, max(delay, 1)), atol=1e-8)
    terms = {r["term"] for r in arma.coef_table(split, given, chunk=97).collect()}
    assert {f"ar.L{i + 1}" for i in range(len(phi))} | {f"ma.L{i + 1}" for i in range(len(theta))} <= terms


def test_recursion_by_stretches():
    rng = np.random.default_rng(4)
    for n, theta in ((1, [0.5]), (2, [0.1, 0.2, 0.3]), (100, [0.9]), (1001, [0.4, -0.3, 0.2])):
        v, state = rng.normal(size=n), rng.normal(size=len(theta))
        e = list(state[::-1])
        for value in v:
            e.append(value - sum(c * e[-j - 1] for j, c in enumerate(theta)))
        assert np.allclose(arma._recursion(v, np.array(theta), state), e[len(theta) :])
