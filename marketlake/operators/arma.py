"""Regression with ARMA errors for every series of a table, in parallel.

    y = X·β + u,    u_t = Σ φ_i·u_{t−i} + Σ θ_j·e_{t−j} + e_t        (no intercept, no differencing)

fitted with the two-stage least-squares estimator of Hannan & Rissanen (1982):

1. β by least squares from the Gram matrix of (X, y);
2. u = y − X·β; a long autoregression (Yule–Walker on the autocovariances) gives proxies of e;
3. φ and θ by least squares of u on its lags and on the lags of those proxies.

Every stage is one map-side-combined aggregate over all series; only matrices of order
≤ 20 are solved in Python, one row per series. All (p, q) orders share one Gram matrix of
the maximal design, so the whole AIC grid costs no further pass over the data. The one-row-
per-series results between stages are materialised, so no stage repeats an earlier pass.

Rows carry a 0-based `idx` per series. Lags are windows over chunks of `idx` with a halo,
so a long series is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from marketlake.operators.chunks import CHUNK, chunk_window, core_only, running_columns, with_halo
from marketlake.schemas import EXOG, TARGET
from marketlake.session import materialize

DEFAULT_ORDER = 3
LONG_AR = 20
INDEX_CHUNK = 65_536
DOUBLES = ArrayType(DoubleType())

PARAMS_DDL = (
    "series STRING, status STRING, n_train BIGINT, p INT, q INT, aic DOUBLE, sigma_log DOUBLE, "
    "beta ARRAY<DOUBLE>, phi ARRAY<DOUBLE>, theta ARRAY<DOUBLE>, exog ARRAY<STRING>, target STRING"
)
GRID_DDL = (
    "series STRING, p INT, q INT, n BIGINT, aic DOUBLE, sigma2 DOUBLE, "
    "phi ARRAY<DOUBLE>, theta ARRAY<DOUBLE>"
)


def gram(columns: list[Column]) -> Column:
    """Upper triangle of ΣzzT, row by row, as one array of sums."""
    return F.array(
        *[F.sum(a * b) for i, a in enumerate(columns) for b in columns[i:]]
    )


def _square(flat, size: int) -> np.ndarray:
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = np.asarray(flat, dtype=float)
    return out + np.triu(out, 1).T


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least-squares coefficients from normal equations; NaN if the design is singular."""
    if a.size == 0:
        return np.zeros(0)
    scale = np.sqrt(np.diag(a))
    if not np.all(np.isfinite(a)) or not np.all(scale > 0):
        return np.full(len(b), np.nan)
    normed = a / np.outer(scale, scale)
    if np.linalg.cond(normed) > 1e12:
        return np.full(len(b), np.nan)
    return np.linalg.solve(normed, b / scale) / scale


# ---------------------------------------------------------------------------
# stage 1: regression on the exogenous columns


def exog_gram(split: DataFrame, exog: tuple[str, ...] = EXOG, target: str = TARGET) -> DataFrame:
    """Per series: training rows, Gram matrix of (exog, target) and the target's deviation."""
    return (
        split.where(F.col("split") == "train")
        .groupBy("series")
        .agg(
            F.count("*").alias("n_train"),
            F.stddev_samp(target).alias("sigma_log"),
            gram([F.col(c) for c in (*exog, target)]).alias("gram"),
        )
    )


def _beta_udf(k: int):
    @F.pandas_udf(DOUBLES)
    def beta(g: pd.Series) -> pd.Series:
        def one(flat):
            m = _square(flat, k + 1)
            return _solve(m[:k, :k], m[:k, k])

        return g.map(one)

    return beta


def fit_exog(split: DataFrame, exog: tuple[str, ...] = EXOG, target: str = TARGET) -> DataFrame:
    """series, n_train, sigma_log, gram, beta."""
    return exog_gram(split, exog, target).withColumn("beta", _beta_udf(len(exog))("gram"))


def residuals(
    rows: DataFrame, params: DataFrame, exog: tuple[str, ...] = EXOG, target: str = TARGET
) -> DataFrame:
    """Add u = y − X·β and the regression part `xb`; the coefficients arrive by join."""
    xb = F.lit(0.0)
    for i, c in enumerate(exog):
        xb = xb + F.col(c) * F.col("beta")[i]
    return rows.join(params, "series").withColumn("xb", xb).withColumn("u", F.col(target) - F.col("xb"))


# ---------------------------------------------------------------------------
# stages 2 and 3


def _lags(rows: DataFrame, column: str, count: int, name: str) -> DataFrame:
    w = chunk_window(["series"], "idx")
    return rows.withColumns({f"{name}{k}": F.lag(column, k).over(w) for k in range(1, count + 1)})


def _mask_gaps(rows: DataFrame, names: list[str], step: int | None) -> DataFrame:
    """Blank lags that reach over a hole in time (`t` not `k` steps back)."""
    if step is None:
        return rows
    w = chunk_window(["series"], "idx")
    return rows.withColumns(
        {
            n: F.when(F.col("t") - F.lag("t", k).over(w) == k * step, F.col(n))
            for n in names
            for k in [int(n.lstrip("uez_"))]
        }
    )


def autocovariances(u_rows: DataFrame, lags: int = LONG_AR, chunk: int = INDEX_CHUNK) -> DataFrame:
    """Per series: row count and Σ u_t·u_{t−k} for k = 0…lags."""
    rows = with_halo(u_rows.select("series", "idx", "u"), "idx", max(chunk, lags), before=lags)
    rows = core_only(_lags(rows, "u", lags, "u"))
    sums = [F.sum(F.col("u") * F.col("u"))] + [
        F.sum(F.col("u") * F.col(f"u{k}")) for k in range(1, lags + 1)
    ]
    return rows.groupBy("series").agg(
        F.count("*").alias("n"),
        F.array(*[F.coalesce(s, F.lit(0.0)) for s in sums]).alias("acov"),
    )


@F.pandas_udf(DOUBLES)
def _long_ar(acov: pd.Series, n: pd.Series) -> pd.Series:
    """Yule–Walker coefficients of an autoregression of order min(20, n / 10), zero padded.

    NULL if its equations are singular: such a series has no proxies of e and is not fitted.
    """

    def one(r, n_rows):
        r = np.asarray(r, dtype=float)
        m = min(len(r) - 1, int(n_rows) // 10)
        out = np.zeros(len(r) - 1)
        if m < 1 or not r[0] > 0:
            return out
        index = np.abs(np.subtract.outer(np.arange(m), np.arange(m)))
        out[:m] = _solve(r[index], r[1 : m + 1])
        return out if np.isfinite(out).all() else None

    return pd.Series([one(r, k) for r, k in zip(acov, n)])


def longest(params: DataFrame) -> tuple[int, int]:
    """The greatest autoregressive and moving-average order among the fitted series."""
    sizes = [F.max(F.size(c)).alias(c) for c in ("phi", "theta")]
    row = params.where(F.col("status") == "ok").agg(*sizes).first()
    return row["phi"] or 0, row["theta"] or 0


def lag_gram(
    u_rows: DataFrame,
    max_lag: int = DEFAULT_ORDER,
    long_ar: int = LONG_AR,
    chunk: int = INDEX_CHUNK,
    step: int | None = None,
    moving_average: bool = True,
) -> DataFrame:
    """Per series: the Gram matrix of (u lags, e-proxy lags, u) on their common sample.

    With `step`, only rows whose lags are unbroken in time enter. Without `moving_average` there
    are no e lags, and the pass for their proxies is left out.
    """
    u_names = [f"u{k}" for k in range(1, max_lag + 1)]
    if not moving_average:
        rows = with_halo(
            u_rows.select("series", "idx", "u", *(["t"] if step else [])), "idx", max(chunk, max_lag), before=max_lag
        )
        rows = _mask_gaps(_lags(rows, "u", max_lag, "u"), u_names, step)
        return _gram_rows(rows, [*u_names, "u"])
    ar = materialize(
        autocovariances(u_rows, long_ar, chunk).select(
            "series", F.col("n").alias("_n"), _long_ar("acov", "n").alias("_ar")
        )
    )
    reach = long_ar + max_lag
    columns = ["series", "idx", "u", *(["t"] if step else [])]
    rows = with_halo(
        u_rows.select(*columns).join(ar, "series"), "idx", max(chunk, reach), before=reach
    )
    rows = _lags(rows, "u", long_ar, "u")
    proxy = F.col("u")
    for k in range(1, long_ar + 1):
        proxy = proxy - F.coalesce(F.col("_ar")[k - 1] * F.col(f"u{k}"), F.lit(0.0))
    order = F.least(F.lit(long_ar), F.floor(F.col("_n") / 10))
    rows = rows.withColumn("_e", F.when((F.col("idx") >= order) & F.col("_ar").isNotNull(), proxy))
    rows = _lags(rows, "_e", max_lag, "e")
    e_names = [f"e{k}" for k in range(1, max_lag + 1)]
    rows = _mask_gaps(rows, u_names + e_names, step)
    return _gram_rows(rows, [*u_names, *e_names, "u"])


def _gram_rows(rows: DataFrame, design: list[str]) -> DataFrame:
    return (
        core_only(rows)
        .dropna(subset=design)
        .groupBy("series")
        .agg(F.count("*").alias("n"), gram([F.col(c) for c in design]).alias("gram"))
    )


def order_grid(
    u_rows: DataFrame,
    max_p: int = DEFAULT_ORDER,
    max_q: int = DEFAULT_ORDER,
    n_exog: int = len(EXOG),
    chunk: int = INDEX_CHUNK,
    step: int | None = None,
    long_ar: int = LONG_AR,
) -> DataFrame:
    """AIC, φ and θ of every order p ≤ max_p, q ≤ max_q but (0, 0), for every series.

    AIC = N·ln(RSS / N) + 2·(p + q + exog + 1), all on one sample per series. An order whose
    design is singular gets a NULL AIC and is never selected.
    """
    max_lag = max(max_p, max_q)
    size = max_lag + 1 + (max_lag if max_q else 0)

    def solve_orders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for series, n, flat in zip(batch["series"], batch["n"], batch["gram"]):
                g = _square(flat, size)
                for p in range(max_p + 1):
                    for q in range(max_q + 1):
                        if p == q == 0:
                            continue
                        pick = [*range(p), *range(max_lag, max_lag + q)]
                        b = g[pick, -1]
                        w = _solve(g[np.ix_(pick, pick)], b)
                        rss = g[-1, -1] - w @ b
                        ok = np.isfinite(rss) and rss > 0 and n > p + q + n_exog + 1
                        out.append(
                            {
                                "series": series,
                                "p": p,
                                "q": q,
                                "n": n,
                                "aic": n * np.log(rss / n) + 2 * (p + q + n_exog + 1) if ok else None,
                                "sigma2": rss / n if ok else None,
                                "phi": w[:p] if ok else None,
                                "theta": w[p:] if ok else None,
                            }
                        )
            yield pd.DataFrame(out, columns=[c.split()[0] for c in GRID_DDL.split(", ")])

    grams = lag_gram(u_rows, max_lag, long_ar, chunk, step, max_q > 0)
    return grams.mapInPandas(solve_orders, GRID_DDL)


def select_order(grid: DataFrame) -> DataFrame:
    """Per series: the order with the smallest AIC."""
    best = F.min_by(
        F.struct("p", "q", "aic", "sigma2", "phi", "theta"),
        F.when(F.col("aic").isNotNull(), F.struct("aic", "p", "q")),
    )
    return grid.groupBy("series").agg(best.alias("b")).select("series", "b.*")


def fit_arx(
    split: DataFrame,
    order: tuple[int, int] | None = None,
    max_p: int = DEFAULT_ORDER,
    max_q: int = DEFAULT_ORDER,
    exog: tuple[str, ...] = EXOG,
    target: str = TARGET,
    chunk: int = INDEX_CHUNK,
    step: int | None = None,
    grid: DataFrame | None = None,
) -> DataFrame:
    """Parameters of every series: best order by AIC, or the given one. Materialised.

    Series without enough rows appear with status `insufficient` and no coefficients.
    """
    stage1 = materialize(fit_exog(split, exog, target))
    if grid is None:
        p_max, q_max = order or (max_p, max_q)
        u_rows = residuals(
            split.where(F.col("split") == "train"), stage1.select("series", "beta"), exog, target
        )
        grid = order_grid(u_rows, p_max, q_max, len(exog), chunk, step)
    if order:
        grid = grid.where((F.col("p") == order[0]) & (F.col("q") == order[1]))
    best = select_order(grid)
    everyone = split.groupBy("series").agg(F.count("*").alias("_rows")).drop("_rows")
    fitted = everyone.join(stage1, "series", "left").join(best, "series", "left")
    ok = F.col("aic").isNotNull() & F.forall("beta", lambda b: ~F.isnan(b))
    ok = F.coalesce(ok, F.lit(False))
    return materialize(fitted.select(
        "series",
        F.when(ok, "ok").otherwise("insufficient").alias("status"),
        F.coalesce("n_train", F.lit(0)).cast("bigint").alias("n_train"),
        F.when(ok, F.col("p")).cast("int").alias("p"),
        F.when(ok, F.col("q")).cast("int").alias("q"),
        F.when(ok, F.col("aic")).alias("aic"),
        "sigma_log",
        *[F.when(ok, F.col(c)).alias(c) for c in ("beta", "phi", "theta")],
        F.array(*[F.lit(c) for c in exog]).alias("exog"),
        F.lit(target).alias("target"),
    ))


def coef_table(
    split: DataFrame, params: DataFrame, exog: tuple[str, ...] = EXOG, target: str = TARGET,
    chunk: int = INDEX_CHUNK, orders: tuple[int, int] | None = None, step: int | None = None,
) -> DataFrame:
    """Coefficients with standard error and z value, from the same Gram matrices.

    `orders` and `step` are those of the fit (greatest p and q of the grid), which decide its
    sample; by default the greatest orders among the fitted series.
    """
    max_p, max_q = orders or longest(params)
    lag = max(max_p, max_q)
    fitted = params.where(F.col("status") == "ok")
    stage1 = exog_gram(split, exog, target).select("series", "n_train", F.col("gram").alias("g1"))
    u_rows = residuals(
        split.where(F.col("split") == "train"), fitted.select("series", "beta"), exog, target
    )
    stage2 = lag_gram(u_rows, lag, chunk=chunk, step=step, moving_average=max_q > 0).select(
        "series", F.col("n").alias("n2"), F.col("gram").alias("g2")
    )
    k = len(exog)
    names = list(exog)

    def table(series, n, flat, labels, w, pick):
        g = _square(flat, int(round((np.sqrt(8 * len(flat) + 1) - 1) / 2)))
        a, b = g[np.ix_(pick, pick)], g[pick, -1]
        dof = n - len(pick)
        if not len(pick) or dof <= 0:
            return []
        sigma2 = (g[-1, -1] - 2 * w @ b + w @ a @ w) / dof
        err = np.sqrt(np.maximum(np.diag(np.linalg.pinv(a)) * sigma2, 0.0))
        return [
            (series, label, float(c), float(e), float(c / e) if e > 0 else None)
            for label, c, e in zip(labels, w, err)
        ]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                out += table(r.series, r.n_train, r.g1, names, np.asarray(r.beta), list(range(k)))
                p, q = int(r.p), int(r.q)
                w = np.concatenate([np.asarray(r.phi, float), np.asarray(r.theta, float)])
                labels = [f"ar.L{i + 1}" for i in range(p)] + [f"ma.L{i + 1}" for i in range(q)]
                pick = [*range(p), *range(lag, lag + q)]
                out += table(r.series, r.n2, r.g2, labels, w, pick)
            yield pd.DataFrame(out, columns=["series", "term", "coef", "std_err", "z"])

    return (
        fitted.select("series", "p", "q", "beta", "phi", "theta")
        .join(stage1, "series")
        .join(stage2, "series")
        .mapInPandas(solve, "series string, term string, coef double, std_err double, z double")
    )


# ---------------------------------------------------------------------------
# innovations and walk-forward predictions


def _recursion(v: np.ndarray, theta: np.ndarray, state: np.ndarray) -> np.ndarray:
    """e_t = v_t − Σ θ_j·e_{t−j}, with `state` = (e_{−1}, e_{−2}, …).

    The recursion is linear: stretches of about √n values run side by side from zero, then each
    is corrected by the response to the values before it.
    """
    q, n = len(theta), len(v)
    if not q or not n:
        return np.array(v, float)
    length = max(int(np.sqrt(n)), q)
    count = -(-n // length)
    e = np.zeros((count, q + length))
    values = np.zeros(count * length)
    values[:n] = v
    values = values.reshape(count, length)
    response = np.zeros((q, q + length))
    response[:, :q] = np.eye(q)
    coef = theta[::-1]
    for i in range(length):
        e[:, q + i] = values[:, i] - e[:, i : i + q] @ coef
        response[:, q + i] = -(response[:, i : i + q] @ coef)
    before = np.asarray(state, float)[:q][::-1]
    for j in range(count):
        e[j, q:] += before @ response[:, q:]
        before = e[j, -q:]
    return e[:, q:].reshape(-1)[:n]


def innovations(u_rows: DataFrame, chunk: int = INDEX_CHUNK, orders: tuple[int, int] = (0, 0)) -> DataFrame:
    """Add the one-step innovations `e` of each row, given joined columns phi and theta.

    `orders`: the greatest lengths of phi and theta. Series without θ need no recursion. For the
    others, the recursion is sequential, but linear: over a chunk, the state it ends with is
    A^n·(state it starts with) + (what it ends with when started from zero). So each chunk runs
    from zero on its own, the chunk summaries are composed in order (one short row per chunk), and
    each chunk is then run from its true start. Exact, and no series is held by one task. Values
    before the first row count as zero.
    """
    max_p, max_q = orders
    rows = with_halo(u_rows, "idx", max(chunk, max_p), before=max_p)
    w = chunk_window(["series"], "idx")
    v = F.col("u")
    for k in range(1, max_p + 1):
        v = v - F.coalesce(F.get("phi", F.lit(k - 1)) * F.lag("u", k).over(w), F.lit(0.0))
    rows = rows.withColumn("v", v).where("_core").drop("_core")
    if not max_q:
        return rows.withColumnRenamed("v", "e").drop(CHUNK)

    direct = rows.where(F.size("theta") == 0).withColumn("e", F.col("v")).drop("v", CHUNK)
    moving = rows.where(F.size("theta") > 0)
    slim = moving.select("series", CHUNK, "idx", "v", "theta")
    out_schema = direct.schema

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        theta = np.asarray(pdf["theta"].iloc[0], float)
        e = _recursion(pdf["v"].to_numpy(), theta, np.zeros(len(theta)))
        end = np.concatenate([np.zeros(len(theta)), e])[::-1][: len(theta)]
        return pd.DataFrame(
            {
                "series": [pdf["series"].iloc[0]],
                CHUNK: [pdf[CHUNK].iloc[0]],
                "n": [len(pdf)],
                "theta": [theta],
                "end": [end],
            }
        )

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(CHUNK)
        theta = np.asarray(pdf["theta"].iloc[0], float)
        q = len(theta)
        step = np.zeros((q, q))
        step[0] = -theta
        step[1:, :-1] = np.eye(q - 1)
        state, starts = np.zeros(q), []
        for n, end in zip(pdf["n"], pdf["end"]):
            starts.append(state)
            state = np.linalg.matrix_power(step, int(n)) @ state + np.asarray(end, float)
        return pd.DataFrame({"series": pdf["series"], CHUNK: pdf[CHUNK], "_start": starts})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        theta = np.asarray(pdf["theta"].iloc[0], float)
        start = np.asarray(pdf["_start"].iloc[0], float)
        return pdf.assign(e=_recursion(pdf["v"].to_numpy(), theta, start))[out_schema.names]

    ends = slim.groupBy("series", CHUNK).applyInPandas(
        summary, f"series string, {CHUNK} bigint, n bigint, theta array<double>, end array<double>"
    )
    # a row per chunk: 65,536 input rows make one
    starts = ends.groupBy("series").applyInPandas(
        compose, f"series string, {CHUNK} bigint, _start array<double>"
    )
    run_out = moving.join(starts, ["series", CHUNK]).groupBy("series", CHUNK).applyInPandas(run, out_schema)
    return direct.unionByName(run_out)


def forecast_weights(steps: int, lag: int):
    """Weights of the newest `lag` u and e values in the forecast `steps` ahead, from φ and θ."""

    @F.pandas_udf(DOUBLES)
    def weights(phi: pd.Series, theta: pd.Series) -> pd.Series:
        def one(phi_, theta_):
            phi_, theta_ = np.asarray(phi_, float), np.asarray(theta_, float)
            p, q = len(phi_), len(theta_)
            m = np.zeros((2 * lag, 2 * lag))
            m[0, :p], m[0, lag : lag + q] = phi_, theta_
            m[1:lag, : lag - 1] += np.eye(lag - 1)
            m[lag + 1 :, lag:-1] += np.eye(lag - 1)
            return np.linalg.matrix_power(m, steps)[0]

        return pd.Series([one(a, b) for a, b in zip(phi, theta)])

    return weights


def with_states(
    rows: DataFrame, params: DataFrame, exog: tuple[str, ...] = EXOG, target: str = TARGET,
    chunk: int = INDEX_CHUNK, steps: int = 1,
) -> tuple[DataFrame, int]:
    """Rows with `xb`, `u`, `e` and the forecast weights `_w` of their series; the number of lags in `_w`."""
    orders = longest(params)
    lag = max(*orders, 1)
    usable = params.where(F.col("status") == "ok").select("series", "beta", "phi", "theta")
    weighted = usable.withColumn("_w", forecast_weights(steps, lag)("phi", "theta"))
    return innovations(residuals(rows, weighted, exog, target), chunk, orders), lag


def walk_forward(
    split: DataFrame,
    params: DataFrame,
    delay: int = 5,
    exog: tuple[str, ...] = EXOG,
    target: str = TARGET,
    chunk: int = INDEX_CHUNK,
) -> DataFrame:
    """Predictions of every row with frozen parameters: series, idx, split, y, pred.

    `delay` = rows until a label is known. Row i may use labels up to row i − max(delay, 1):
    0 assumes the previous label is known at once, the label horizon is the honest choice.
    Training rows get the in-sample fit. A prediction that is not finite becomes 0.
    """
    back = max(delay, 1)
    slim = split.select("series", "idx", "split", *exog, target)
    rows, lag = with_states(slim, params, exog, target, chunk, back)
    rows = with_halo(rows, "idx", max(chunk, back + lag), before=back + lag)
    w = chunk_window(["series"], "idx")
    pred = F.col("xb")
    for k in range(lag):
        for name, offset in (("u", 0), ("e", lag)):
            past = F.lag(name, back + k).over(w)
            pred = pred + F.coalesce(F.col("_w")[offset + k] * past, F.lit(0.0))
    out = core_only(rows.withColumn("_p", pred))
    bad = F.isnan("_p") | (F.abs("_p") == float("inf"))
    return out.select(
        "series",
        "idx",
        "split",
        F.col(target).alias("y"),
        F.when(bad, 0.0).otherwise(F.coalesce("_p", F.lit(0.0))).alias("pred"),
    )


def walk_forward_refit(
    split: DataFrame,
    params: DataFrame,
    delay: int = 5,
    exog: tuple[str, ...] = EXOG,
    target: str = TARGET,
    chunk: int = INDEX_CHUNK,
) -> DataFrame:
    """Holdout predictions with the regression re-estimated on the expanding window.

    Each holdout row solves the regression of y on (X, known u lags, known e lags) over all
    rows whose label is known by then. The lagged u and e are those of the given parameters;
    only the weights of X and of the lags are estimated anew. The Gram matrix of that window is
    a running sum, so a refit costs one small solve instead of a pass over the history.
    """
    back = max(delay, 1)
    k = len(exog)
    slim = split.select("series", "idx", "split", *exog, target)
    orders = params.where(F.col("status") == "ok").select("series", "p", "q")
    states, lag = with_states(slim, params, exog, target, chunk, back)
    rows = with_halo(materialize(states), "idx", max(chunk, back + lag), before=back + lag)
    w = chunk_window(["series"], "idx")
    past = {
        f"{name}{j + 1}": F.coalesce(F.lag(name, back + j).over(w), F.lit(0.0))
        for name in ("u", "e")
        for j in range(lag)
    }
    design = core_only(rows.withColumns(past)).select(
        "series", "idx", "split", *exog, *past, F.col(target).alias("y")
    )
    z = [*exog, *past, "y"]
    pairs = {
        f"g{i}_{j}": F.col(z[i]) * F.col(z[j]) for i in range(len(z)) for j in range(i, len(z))
    }
    design = materialize(design)
    first = design.where(F.col("split") == "holdout").groupBy("series").agg(F.min("idx").alias("_first"))
    running = (
        running_columns(design, ["series"], "idx", chunk, pairs)
        .withColumn("idx", F.col("idx") + back)
        .join(first, "series")
        .where(F.col("idx") >= F.col("_first"))
        .select("series", "idx", F.array(*pairs).alias("gram"))
    )
    target_rows = design.where(F.col("split") == "holdout").select(
        "series", "idx", "split", "y", F.array(*z[:-1]).alias("z")
    )

    @F.pandas_udf(DoubleType())
    def predict(g: pd.Series, x: pd.Series, p: pd.Series, q: pd.Series) -> pd.Series:
        def one(flat, row, p_, q_):
            m = _square(flat, k + 2 * lag + 1)
            pick = [*range(k + int(p_)), *range(k + lag, k + lag + int(q_))]
            value = _solve(m[np.ix_(pick, pick)], m[pick, -1]) @ np.asarray(row, float)[pick]
            return float(value) if np.isfinite(value) else 0.0

        return pd.Series([one(*a) for a in zip(g, x, p, q)])

    return (
        target_rows.join(running, ["series", "idx"])
        .join(orders, "series")
        .select("series", "idx", "split", "y", predict("gram", "z", "p", "q").alias("pred"))
    )

