"""The registered queries in SQL, for an independent engine over the same tables.

Written from the definitions, not from the Spark plans: dense grids, as-of joins and plain
whole-series windows where the Spark side uses sparse grids, chunks and halos.
"""

from __future__ import annotations

EVENTS = """
ev AS (
  SELECT event_id, user_id, event_type, value,
         epoch_us(ts) / 1e6 AS recv_ts,
         ['btc', 'eth', 'sol'][user_id % 3 + 1] AS a,
         CASE WHEN user_id % 2 = 0 THEN 'Up' ELSE 'Down' END AS o,
         ['btc', 'eth', 'sol'][user_id % 3 + 1] || '-updown-5m-'
           || CAST((epoch_us(ts) // 300000000) * 300 AS VARCHAR) AS slug,
         CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE) / 100 AS k,
         event_type IN ('click', 'purchase', 'error') AS spot
  FROM events
  WHERE event_type IN ('click', 'purchase', 'error', 'view', 'signup')
),
env AS (
  SELECT event_id, user_id, event_type, value, k, a, o, slug, recv_ts, spot,
         CAST(trunc(recv_ts * 1000000) AS BIGINT) AS us,
         CASE WHEN spot THEN 'binance' ELSE 'polymarket' END AS source,
         CASE event_type WHEN 'click' THEN 'aggTrade' WHEN 'purchase' THEN 'bookTicker'
              WHEN 'error' THEN 'depth20@100ms' WHEN 'view' THEN 'price_change'
              ELSE 'last_trade_price' END AS type,
         CASE WHEN event_type = 'click' THEN 'binance.trades' WHEN spot THEN 'binance.book'
              ELSE 'polymarket.events' END AS topic,
         CASE WHEN spot THEN a || 'usdt' END AS symbol,
         CASE WHEN NOT spot THEN slug || '#' || o END AS asset_id,
         CASE event_type WHEN 'click' THEN value * 100
              WHEN 'purchase' THEN ((value * 100 - 1) + (value * 100 + 1)) / 2
              WHEN 'view' THEN k WHEN 'signup' THEN k END AS price
  FROM ev
),
ticks AS (
  SELECT event_id, topic, source, type, coalesce(symbol, asset_id) AS ident, upper(a) AS asset,
         CASE WHEN spot THEN upper(symbol) ELSE upper(a) || ' ' || o END AS series,
         us, recv_ts, price,
         CASE WHEN spot THEN floor(price / 100) * 100 ELSE floor(price * 10) / 10 END AS price_bucket,
         CASE WHEN NOT spot THEN slug END AS market_slug,
         CASE WHEN NOT spot THEN o END AS market_outcome,
         type = 'bookTicker' AS spot_leg,
         NOT spot AND o = 'Up' AS prob_leg
  FROM env WHERE price > 0
)"""

CATALOGUE = """,
catalogue AS (
  SELECT slug, a, CAST(sum(CAST(value AS DECIMAL(20, 2))) AS DOUBLE) AS volume,
         min(event_id) AS pos, upper(a) || ' up or down' AS question
  FROM ev WHERE event_type IN ('view', 'signup') GROUP BY slug, a
),
tokens AS (
  SELECT slug || '#Up' AS asset_id, question, slug, 'Up' AS outcome
  FROM catalogue WHERE pos % 13 <> 0 AND pos % 11 <> 0
  UNION ALL
  SELECT slug || '#Down', question, slug, CASE WHEN pos % 7 <> 0 THEN 'Down' END
  FROM catalogue WHERE pos % 13 <> 0 AND pos % 11 <> 0
)"""

BOOK_ROWS = """,
book_rows AS (
  SELECT event_id, 'price_change' AS type, slug || '#' || o AS asset_id, k AS price, value AS size,
         CAST(NULL AS DOUBLE) AS last_trade_price FROM ev WHERE event_type = 'view'
  UNION ALL
  SELECT event_id, 'price_change', slug || '#' || CASE o WHEN 'Up' THEN 'Down' ELSE 'Up' END,
         1 - k, value, NULL FROM ev WHERE event_type = 'view'
  UNION ALL
  SELECT event_id, 'last_trade_price', slug || '#' || o, k, value, NULL
  FROM ev WHERE event_type = 'signup'
  UNION ALL
  SELECT event_id, 'book', slug || '#' || o, NULL, NULL, value FROM ev WHERE event_type = 'error'
)"""

RESOLVED = CATALOGUE + """,
wanted AS (SELECT DISTINCT a AS asset, CAST(floor(recv_ts) AS BIGINT) AS at FROM env WHERE spot),
resolved AS (
  SELECT w.asset, w.at, coalesce(c1.slug, c2.slug) AS slug,
         CASE WHEN c1.slug IS NOT NULL THEN true WHEN c2.slug IS NOT NULL THEN false END AS is_live
  FROM wanted w
  LEFT JOIN catalogue c1
    ON c1.slug = w.asset || '-updown-5m-' || CAST(w.at // 300 * 300 AS VARCHAR)
  LEFT JOIN catalogue c2
    ON c2.slug = w.asset || '-updown-5m-' || CAST(w.at // 300 * 300 + 300 AS VARCHAR)
)"""

POINTS = """,
points AS (
  SELECT asset, us // 600000000 * 600 AS sec,
         avg(price) FILTER (WHERE spot_leg) AS mid, avg(price) FILTER (WHERE prob_leg) AS prob
  FROM ticks GROUP BY ALL
)"""

FILLED = POINTS + """,
filled AS (
  SELECT asset, sec,
         last_value(mid IGNORE NULLS) OVER
           (PARTITION BY asset ORDER BY sec RANGE BETWEEN 21600 PRECEDING AND CURRENT ROW) AS mid,
         last_value(prob IGNORE NULLS) OVER
           (PARTITION BY asset ORDER BY sec RANGE BETWEEN 64800 PRECEDING AND CURRENT ROW) AS prob
  FROM points
)"""

BARS = FILLED + """,
pts AS (SELECT asset AS series, sec, mid, prob FROM filled WHERE mid IS NOT NULL AND prob IS NOT NULL),
opened AS (SELECT DISTINCT series, sec // 3600 * 3600 AS t FROM pts),
bars AS (
  SELECT o.series, o.t, p.mid, p.prob
  FROM opened o ASOF JOIN pts p ON o.series = p.series AND o.t >= p.sec
  WHERE o.t - p.sec <= 21600
)"""

BAR_FEATURES = BARS + """,
bar_x AS (
  SELECT series, t, mid, prob,
         coalesce(t - lag(t, 9) OVER w = 9 * 3600, false) AS contiguous,
         prob - lag(prob, 5) OVER w AS change,
         ln(mid / lag(mid, 5) OVER w) AS ret,
         row_number() OVER w AS bar_no
  FROM bars WINDOW w AS (PARTITION BY series ORDER BY t)
),
bar_v AS (
  SELECT *, stddev_samp(ret) OVER (PARTITION BY series ORDER BY t ROWS 4 PRECEDING) AS vol FROM bar_x
)"""


def _live(points: str, sigma: str, name: str) -> str:
    """Live features of the rows of `points` (series, sec, mid, prob), σ as an expression."""
    return f""",
{name}_at AS (
  SELECT q.series, q.sec, q.mid, q.prob, {sigma} AS sigma, b.t AS bar_t, b.bar_no, b.contiguous,
         b.prob AS bar_prob, b.change AS bar_change, b.vol AS bar_vol
  FROM {points} q ASOF LEFT JOIN bar_v b ON q.series = b.series AND q.sec >= b.t
),
{name}_list AS (
  SELECT q.series, q.sec, h.t, h.mid, h.prob
  FROM {name}_at q JOIN bar_v h ON q.series = h.series AND h.bar_no BETWEEN q.bar_no - 11 AND q.bar_no
  UNION ALL
  SELECT series, sec, sec, mid, prob FROM {name}_at WHERE bar_t IS NULL OR bar_t < sec
),
{name}_ret AS (
  SELECT *, ln(mid / lag(mid) OVER (PARTITION BY series, sec ORDER BY t)) AS ret FROM {name}_list
),
{name}_warm AS (
  SELECT series, sec,
         coalesce(arg_max(prob, t) FILTER (WHERE t <= sec - 18000), arg_min(prob, t)) AS anchor
  FROM {name}_ret GROUP BY series, sec
),
{name}_vol AS (
  SELECT series, sec, count(*) AS n, stddev_samp(ret) AS sd
  FROM (SELECT *, row_number() OVER (PARTITION BY series, sec ORDER BY t DESC) AS rn
        FROM {name}_ret WHERE ret IS NOT NULL)
  WHERE rn <= 5 GROUP BY series, sec
),
{name} AS (
  SELECT q.series, q.sec, q.mid, q.prob, q.sigma,
         CASE WHEN q.contiguous THEN 'exact' ELSE 'warm' END AS feature_mode,
         CASE WHEN q.contiguous THEN q.bar_prob ELSE q.prob END AS x1,
         CASE WHEN q.contiguous THEN q.bar_change ELSE q.prob - w.anchor END AS x2,
         CASE WHEN q.contiguous THEN q.bar_vol
              WHEN v.n >= 2 THEN greatest(v.sd * sqrt(5.0), q.sigma * 0.25) ELSE q.sigma END AS x3
  FROM {name}_at q
  JOIN {name}_warm w ON q.series = w.series AND q.sec = w.sec
  LEFT JOIN {name}_vol v ON q.series = v.series AND q.sec = v.sec
)"""


SECONDS = """,
secs AS (
  SELECT asset, us // 600000000 * 600 AS sec,
         arg_max(price, us) FILTER (WHERE spot_leg) AS mid,
         arg_max(price, us) FILTER (WHERE prob_leg) AS prob
  FROM ticks WHERE spot_leg OR prob_leg GROUP BY ALL
)"""

SNAPSHOTS = SECONDS + """,
spot_s AS (SELECT asset, sec, mid FROM secs WHERE mid IS NOT NULL),
prob_s AS (SELECT asset, sec, prob FROM secs WHERE prob IS NOT NULL),
prob_end AS (SELECT asset, max(sec) AS last_sec FROM prob_s GROUP BY asset),
grid AS (
  SELECT asset, unnest(generate_series(CAST(ceil(min(sec) / 3600.0) * 3600 AS BIGINT),
                                       max(sec) // 3600 * 3600, 3600)) AS t
  FROM spot_s GROUP BY asset
),
snaps AS (
  SELECT g.asset, g.t,
         CASE WHEN g.t - s.sec <= 21600 THEN s.mid END AS mid,
         CASE WHEN g.t - p.sec <= 43200 AND g.t <= e.last_sec THEN p.prob END AS prob
  FROM grid g
  ASOF LEFT JOIN spot_s s ON g.asset = s.asset AND g.t >= s.sec
  ASOF LEFT JOIN prob_s p ON g.asset = p.asset AND g.t >= p.sec
  LEFT JOIN prob_end e ON g.asset = e.asset
)"""

TRAINING = SNAPSHOTS + """,
feat AS (
  SELECT asset AS series, t, mid, prob,
         ln(mid / lag(mid, 5) OVER w) AS ret,
         prob - lag(prob, 5) OVER w AS change,
         ln(lead(mid, 5) OVER w / mid) AS y
  FROM snaps WINDOW w AS (PARTITION BY asset ORDER BY t)
),
feat_v AS (
  SELECT *, CASE WHEN count(ret) OVER v = 5 THEN stddev_samp(ret) OVER v END AS vol
  FROM feat WINDOW v AS (PARTITION BY series ORDER BY t ROWS 4 PRECEDING)
),
training AS (
  SELECT series, t, mid, prob, ret, vol, change, y FROM feat_v
  WHERE mid IS NOT NULL AND prob IS NOT NULL AND ret IS NOT NULL AND vol IS NOT NULL
    AND change IS NOT NULL AND y IS NOT NULL
)"""

SPLIT = TRAINING + """,
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY series ORDER BY t) - 1 AS idx,
         count(*) OVER (PARTITION BY series) AS total
  FROM training
),
split AS (
  SELECT *, CASE WHEN CAST(floor(total * 0.8) AS BIGINT) < 10
                   OR total - CAST(floor(total * 0.8) AS BIGINT) < 5 THEN 'insufficient'
                 WHEN idx < CAST(floor(total * 0.8) AS BIGINT) THEN 'train' ELSE 'holdout' END AS split
  FROM numbered
),
sigmas AS (
  SELECT series, count(*) AS n_train, stddev_samp(y) AS sigma_log
  FROM split WHERE split = 'train' GROUP BY series
)"""


def _det(*m: str) -> str:
    a, b, c, d, e, f, g, h, i = m
    return f"({a}*({e}*{i}-{f}*{h})-{b}*({d}*{i}-{f}*{g})+{c}*({d}*{h}-{e}*{g}))"


# x1 = prob, x2 = change, x3 = vol; Cramer's rule on the normal equations
_A = ("s11", "s12", "s13", "s12", "s22", "s23", "s13", "s23", "s33")
AR1 = SPLIT + f""",
gram AS (
  SELECT series, count(*) AS n,
         sum(prob*prob) AS s11, sum(prob*change) AS s12, sum(prob*vol) AS s13,
         sum(change*change) AS s22, sum(change*vol) AS s23, sum(vol*vol) AS s33,
         sum(prob*y) AS y1, sum(change*y) AS y2, sum(vol*y) AS y3, sum(y*y) AS yy
  FROM split WHERE split = 'train' GROUP BY series
),
betas AS (
  SELECT series, n,
    {_det("y1", "s12", "s13", "y2", "s22", "s23", "y3", "s23", "s33")} / {_det(*_A)} AS b1,
    {_det("s11", "y1", "s13", "s12", "y2", "s23", "s13", "y3", "s33")} / {_det(*_A)} AS b2,
    {_det("s11", "s12", "y1", "s12", "s22", "y2", "s13", "s23", "y3")} / {_det(*_A)} AS b3
  FROM gram
),
us_rows AS (
  SELECT s.*, b.n, b1*prob + b2*change + b3*vol AS xb, y - (b1*prob + b2*change + b3*vol) AS u
  FROM split s JOIN betas b USING (series)
),
us_lag AS (SELECT *, lag(u) OVER (PARTITION BY series ORDER BY idx) AS u1 FROM us_rows),
phis AS (
  SELECT series, sum(u * u1) / sum(u1 * u1) AS phi FROM us_lag
  WHERE split = 'train' AND idx >= 1 GROUP BY series
),
params AS (
  SELECT b.series, b.n, b1, b2, b3, phi, sigma_log
  FROM betas b JOIN phis USING (series) JOIN sigmas USING (series)
),
walk AS (
  SELECT r.series, r.idx, r.split, r.y, r.prob,
         xb + coalesce(phi * lag(u) OVER w, 0) AS pred0,
         xb + coalesce(phi*phi*phi*phi*phi * lag(u, 5) OVER w, 0) AS pred5
  FROM us_rows r JOIN phis USING (series)
  WINDOW w AS (PARTITION BY r.series ORDER BY r.idx)
)"""


def _minor(m: list[list[str]]) -> str:
    """Determinant of a square matrix of SQL terms, along its first row."""
    if len(m) == 1:
        return m[0][0]
    terms = [f"{'-' if j % 2 else '+'}{m[0][j]}*{_minor([r[:j] + r[j + 1:] for r in m[1:]])}" for j in range(len(m))]
    return f"({''.join(terms)})"


# a long autoregression of order 1: r1 / r0
PROXIES = AR1 + """,
u_train AS (SELECT series, idx, u, u1 FROM us_lag WHERE split = 'train'),
ar AS (SELECT series, sum(u * coalesce(u1, 0)) / sum(u * u) AS a, count(*) AS n FROM u_train GROUP BY series),
es AS (
  SELECT series, idx, u, u1, lag(e) OVER (PARTITION BY series ORDER BY idx) AS e1 FROM (
    SELECT t.*, CASE WHEN idx >= least(1, n // 10) THEN u - coalesce(CASE WHEN n >= 10 THEN a ELSE 0 END * u1, 0) END AS e
    FROM u_train t JOIN ar USING (series))
),
g AS (
  SELECT series, count(*) AS n, sum(u1*u1) AS uu, sum(u1*e1) AS ue, sum(e1*e1) AS ee,
         sum(u1*u) AS uy, sum(e1*u) AS ey, sum(u*u) AS yy
  FROM es WHERE u1 IS NOT NULL AND e1 IS NOT NULL GROUP BY series
),
rss AS (
  SELECT series, n, 0 AS p, 1 AS q, yy - ey * ey / ee AS rss FROM g
  UNION ALL SELECT series, n, 1, 0, yy - uy * uy / uu FROM g
  UNION ALL SELECT series, n, 1, 1, yy - ((uy*ee - ey*ue) * uy + (ey*uu - uy*ue) * ey) / (uu*ee - ue*ue) FROM g
),
aics AS (
  SELECT series, p, q, n, CASE WHEN rss > 0 AND n > p + q + 4 THEN n * ln(rss / n) + 2 * (p + q + 4) END AS aic,
         CASE WHEN rss > 0 AND n > p + q + 4 THEN rss / n END AS sigma2
  FROM rss
)"""


def _refit() -> str:
    z = ("prob", "change", "vol", "u1", "y")
    sums = ", ".join(
        f"sum({z[i]}*{z[j]}) OVER before AS g{i}{j}" for i in range(5) for j in range(i, 5)
    )
    g = [[f"g{min(i, j)}{max(i, j)}" for j in range(5)] for i in range(4)]
    full = [r[:4] for r in g]
    solved = [[[*r[:k], r_[4], *r[k + 1:]] for r, r_ in zip(full, g)] for k in range(4)]
    pred = " + ".join(f"{z[k]} * {_minor(solved[k])}" for k in range(4))
    return AR1 + f""",
known AS (SELECT series, idx, split, y, prob, change, vol, coalesce(u1, 0) AS u1 FROM us_lag JOIN phis USING (series)),
grams AS (
  SELECT *, {sums} FROM known
  WINDOW before AS (PARTITION BY series ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)
SELECT series, idx, split, round(y, 8) AS y, round(({pred}) / {_minor(full)}, 8) AS pred
FROM grams WHERE split = 'holdout'"""


def _phi(z: str) -> str:
    """P(N(0,1) < z) by the polynomial 7.1.26 of Abramowitz & Stegun."""
    x = f"(abs({z}) / sqrt(2.0))"
    t = f"(1.0 / (1.0 + 0.3275911 * {x}))"
    poly = (
        f"((((1.061405429*{t} - 1.453152027)*{t} + 1.421413741)*{t} - 0.284496736)*{t} "
        f"+ 0.254829592)*{t}"
    )
    return f"least(1.0, greatest(0.0, 0.5*(1.0 + sign({z})*(1.0 - {poly}*exp(-{x}*{x})))))"


METRICS = """
  SELECT {by}, forecaster, count(*) AS n, round(sqrt(avg((pred - y) * (pred - y))), 6) AS rmse,
         round(avg(abs(pred - y)), 6) AS mae,
         round(avg(CASE WHEN y <> 0 THEN CASE WHEN sign(pred) = sign(y) THEN 1.0 ELSE 0.0 END END), 6)
           AS dir_acc
  FROM ({rows}) GROUP BY ALL"""

STATS_COLUMNS = """source, ident, asset, series, market_outcome, round(price_bucket, 6) AS price_bucket,
  round(min(price), 6) AS price_min, round(max(price), 6) AS price_max,
  round(avg(price), 6) AS price_avg, round(var_samp(price), 6) AS price_var, count(*) AS n"""
STATS_KEYS = "source, ident, asset, series, market_outcome, price_bucket"

PROBS = AR1 + f""",
probs AS (
  SELECT w.series, w.idx, w.y, w.prob AS market_prob, {_phi("(w.pred5 / p.sigma_log)")} AS model_prob
  FROM walk w JOIN params p USING (series) WHERE w.split = 'holdout'
)"""

SCORED = (
    AR1
    + BAR_FEATURES
    + ",\nscore_pts AS (SELECT p.*, sigma_log FROM pts p JOIN params USING (series))"
    + ",\nbar_pts AS (SELECT b.series, b.t AS sec, b.mid, b.prob, sigma_log FROM bars b JOIN params USING (series))"
    + _live("score_pts", "q.sigma_log", "live")
    + _live("bar_pts", "q.sigma_log", "barlive")
    + """,
labels5 AS (
  SELECT series, t, t - 18000 AS origin_t, y FROM (
    SELECT series, t, lag(t, 5) OVER w AS o, ln(mid / lag(mid, 5) OVER w) AS y
    FROM bars WINDOW w AS (PARTITION BY series ORDER BY t)) WHERE o = t - 18000
),
known AS (
  SELECT l.series, l.t, l.y - (b1*x1 + b2*x2 + b3*x3) AS u
  FROM labels5 l JOIN barlive f ON l.series = f.series AND l.origin_t = f.sec
  JOIN params p ON p.series = l.series
),
scored AS (
  SELECT f.*, p.sigma_log,
         b1*x1 + b2*x2 + b3*x3 + coalesce(phi*phi*phi*phi*phi * k.u, 0) AS lr
  FROM live f JOIN params p USING (series)
  ASOF LEFT JOIN known k ON f.series = k.series AND f.sec >= k.t
)"""
)


def _sql(ctes: str, body: str) -> str:
    return f"WITH {EVENTS}{ctes}\n{body}"


def _timed(keys: str) -> str:
    """Bars of every boundary up to the watermark at which the newest point is fresh."""
    return f""",
wm AS (SELECT (max(sec) - 3600) // 3600 * 3600 AS passed FROM pts),
daily AS (SELECT *, sec // 86400 AS day, (sec + 3599) // 3600 * 3600 AS minute FROM pts),
grid AS (SELECT {keys}, unnest(generate_series(min(minute), (SELECT passed FROM wm), 3600)) AS t FROM daily GROUP BY {keys}),
closed AS (
  SELECT {", ".join(f"grid.{k}" for k in keys.split(", "))}, t, mid, prob
  FROM grid ASOF JOIN daily ON {" AND ".join(f"grid.{k} = daily.{k}" for k in keys.split(", "))} AND grid.t >= daily.sec
  WHERE t - sec <= 21600)"""


def _iso(seconds: str) -> str:
    return f"strftime(make_timestamp(CAST({seconds} AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%S.000Z')"


def _summary_rows() -> str:
    features = {
        "poly_p_up": "prob", "poly_p_up_change_5m": "change", "btc_volatility_5m": "vol",
        "btc_mid": "mid", "btc_return_5m": "ret", "log_return_5m": "y * 10000",
    }
    return " UNION ALL ".join(
        f"SELECT series, '{name}' AS feature, {expr} AS v FROM training" for name, expr in features.items()
    )


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}

    # parsing
    out["parse_envelope"] = _sql("", """
SELECT topic, source, type, recv_ts, symbol, asset_id,
       CASE WHEN NOT spot THEN slug END AS slug, CASE WHEN NOT spot THEN o END AS outcome,
       CASE WHEN type = 'aggTrade' THEN value * 100 END AS p,
       CASE WHEN type = 'bookTicker' THEN value * 100 - 1 END AS bid,
       CASE WHEN type = 'bookTicker' THEN 1.0::DOUBLE END AS bid_qty,
       CASE WHEN NOT spot THEN k END AS price,
       CASE WHEN type = 'aggTrade' THEN user_id % 2 = 1 END AS m
FROM env WHERE event_id % 50 NOT IN (0, 1, 2)""")
    out["parse_rejects"] = _sql("", """
SELECT topic, CASE WHEN event_id % 50 = 0 THEN 'malformed' ELSE 'incomplete' END AS reason, count(*) AS n
FROM env WHERE event_id % 50 IN (0, 1) GROUP BY ALL""")
    out["to_envelope"] = _sql("", """
SELECT topic, source, type, count(*) AS n, CAST(sum(CAST(floor(recv_ts) AS BIGINT)) AS BIGINT) AS recv_sec_sum,
       count(symbol) AS n_symbol, count(asset_id) AS n_asset_id
FROM env GROUP BY ALL""")
    out["decode_spot_frames"] = _sql("", """
SELECT event_id, source, symbol, type,
       CASE WHEN type = 'aggTrade' THEN value * 100 END AS p,
       CASE WHEN type = 'bookTicker' THEN value * 100 - 1 END AS bid,
       CASE WHEN type = 'bookTicker' THEN 2.0::DOUBLE END AS ask_qty
FROM env WHERE spot AND event_id % 40 NOT IN (0, 1)""")
    out["route_topic"] = _sql("", """
SELECT topic, type, count(*) AS n FROM env WHERE spot AND event_id % 40 NOT IN (0, 1) GROUP BY ALL""")
    out["flatten_book_frames"] = _sql(BOOK_ROWS, """
SELECT event_id, type, asset_id, 'polymarket' AS source, round(price, 6) AS price, size, last_trade_price
FROM book_rows""")
    out["token_map"] = _sql(CATALOGUE, "SELECT asset_id, question, slug, outcome FROM tokens")
    out["enrich_market"] = _sql(CATALOGUE + BOOK_ROWS, """
SELECT r.event_id, r.type, r.asset_id, t.slug, t.outcome FROM book_rows r LEFT JOIN tokens t USING (asset_id)""")
    for name, cond in (("top_markets", "true"), ("top_markets_keyword", "(question ILIKE '%eth%' OR slug ILIKE '%eth%')")):
        out[name] = _sql(CATALOGUE, f"""
SELECT slug, round(volume, 6) AS volume
FROM catalogue
WHERE pos % 13 <> 0 AND {cond} ORDER BY volume DESC, slug LIMIT 20""")
    out["resolve_rolling_market"] = _sql(RESOLVED, "SELECT r.asset, r.at, r.slug, r.is_live FROM resolved r")
    out["missing_markets"] = _sql(RESOLVED, """
SELECT asset, count(*) AS n_missing, min(r.at) AS first_at, max(r.at) AS last_at
FROM resolved r WHERE slug IS NULL GROUP BY asset""")
    out["rediscovery_deadline"] = _sql(RESOLVED, """
SELECT r.at, count(slug) AS n_found, count(*) - count(slug) AS n_missing,
       min(CAST(regexp_extract(slug, '([0-9]+)$', 1) AS DOUBLE) + 300) FILTER (WHERE slug IS NOT NULL) + 5.0 AS deadline
FROM resolved r GROUP BY r.at""")
    out["slug_window"] = _sql("", """
SELECT event_id, s AS slug, try_cast(split_part(s, '-', -1) AS BIGINT) AS window_start,
       coalesce(CAST(try_cast(split_part(s, '-', -1) AS BIGINT) + 300 AS DOUBLE), recv_ts + 300.0) AS window_end,
       split_part(s, '-', 1) || '-updown-5m-' || CAST(CAST(floor(recv_ts) AS BIGINT) // 300 * 300 + 300 AS VARCHAR) AS next_slug
FROM (SELECT *, CASE WHEN event_id % 30 = 0 THEN 'will-it-rain' ELSE slug END AS s FROM env WHERE NOT spot)""")
    out["read_ticks"] = _sql("", """
SELECT strftime(make_timestamp(us), '%Y-%m-%d') AS date, ident, type, count(*) AS n, round(sum(price), 4) AS price_sum
FROM ticks WHERE source = 'binance' AND hour(make_timestamp(us)) < 12 GROUP BY ALL""")
    out["compact_ticks"] = _sql("", """
SELECT source, strftime(make_timestamp(us), '%Y-%m-%d') AS date, count(*) AS n,
       count(DISTINCT hour(make_timestamp(us))) AS hours, round(max(price), 6) AS price_max
FROM ticks GROUP BY ALL""")
    out["compact_changed"] = _sql("", """
SELECT source, strftime(make_timestamp(us), '%Y-%m-%d') AS date, hour(make_timestamp(us))::INTEGER AS hour, count(*) AS n,
       source = 'binance' AND hour(make_timestamp(us)) >= 20 AS late, false AS again
FROM ticks GROUP BY ALL""")
    out["sigma_lookup"] = _sql("", """
SELECT series AS label, count(*) AS n,
       round(CASE WHEN asset IN ('ETH', 'SOL') THEN 0.0005
                  ELSE any_value((SELECT count(*) FROM ticks b WHERE b.asset = 'BTC')) / 1e7 END, 9) AS sigma_log
FROM ticks GROUP BY series, asset""")
    out["read_forecast_points"] = _sql(FILLED, """
SELECT asset AS series, sec, CASE WHEN sec // 600 % 5 = 0 THEN 1 ELSE 2 END::BIGINT AS n,
       round(mid, 6) AS btc_mid, round(prob, 6) AS poly_p_up
FROM filled WHERE mid IS NOT NULL AND prob IS NOT NULL""")
    out["top_of_book"] = _sql("", """
SELECT event_id, slug || '#' || o AS asset_id,
       CASE WHEN user_id % 4 > 0 THEN round(value - 1, 6) END AS best_bid,
       CASE WHEN user_id % 3 > 0 THEN round(value + 1, 6) END AS best_ask,
       user_id % 4 AS bid_depth, user_id % 3 AS ask_depth, value AS last_trade
FROM ev WHERE event_type = 'error'""")
    out["book_features"] = _sql("", """
SELECT event_id, CASE WHEN nb > 0 AND na > 0 THEN round((value + 1) - (value - 1), 6) END AS spread,
       CAST(nb * (nb + 1) AS DOUBLE) AS bid_size, CAST(na * (na + 1) AS DOUBLE) AS ask_size,
       CASE WHEN nb + na > 0 THEN round((nb*(nb+1) - na*(na+1)) / (nb*(nb+1) + na*(na+1)), 6) END AS imbalance
FROM (SELECT *, user_id % 4 AS nb, user_id % 3 AS na FROM ev WHERE event_type = 'error')""")

    # projections
    out["normalize_ticks"] = _sql("", """
SELECT source, type, ident, asset, series, make_timestamp(us) AS ts, round(price, 6) AS price,
       round(price_bucket, 6) AS price_bucket, market_slug, market_outcome,
       strftime(make_timestamp(us), '%Y-%m-%d') AS date, hour(make_timestamp(us)) AS hour
FROM ticks""")
    out["price_bucket"] = _sql("", """
SELECT source, price_bucket, count(*) AS n, round(min(price), 6) AS price_min, round(max(price), 6) AS price_max
FROM ticks GROUP BY ALL""")
    out["leg_predicates"] = _sql("", """
SELECT asset, type, count(*) AS n, count(*) FILTER (WHERE spot_leg) AS n_spot,
       count(*) FILTER (WHERE prob_leg) AS n_prob
FROM ticks GROUP BY ALL""")
    out["implied_forecast"] = _sql(TRAINING, """
SELECT series, t, round((prob * 2 - 1) * 0.0005, 6) AS log_return,
       round(mid * exp((prob * 2 - 1) * 0.0005), 6) AS forecast,
       round(mid * exp((prob * 2 - 1) * 0.0005) - mid, 6) AS drift,
       round(mid * 0.0005, 6) AS sigma, round(0.0005::DOUBLE, 6) AS sigma_log
FROM training""")
    out["prob_up"] = _sql(TRAINING, f"SELECT series, t, round({_phi('(y / 1.5)')}, 6) AS p_up FROM training")
    out["forecast_json"] = _sql(POINTS, f"""
SELECT asset AS key, {_iso("sec")} AS ts, round(mid, 6) AS btc_mid, round(prob, 6) AS poly_prob,
       mid IS NULL OR prob IS NULL AS drift_is_null
FROM points""")
    out["bands"] = _sql(FILLED, """
SELECT CASE WHEN prob < 0.4 THEN 'red' WHEN prob < 0.5 THEN 'orange' WHEN prob < 0.6 THEN 'gray'
            WHEN prob < 0.7 THEN 'blue' WHEN prob IS NOT NULL THEN 'green' END AS prob_band,
       CASE WHEN drift < -5 THEN 'red' WHEN drift < 5 THEN 'gray' WHEN drift IS NOT NULL THEN 'green' END AS drift_band,
       count(*) AS n
FROM (SELECT *, mid * exp((prob * 2 - 1) * 0.0005) - mid AS drift FROM filled) GROUP BY ALL""")
    out["basis_points"] = _sql(TRAINING, """
SELECT series, t, round(y * 10000, 4) AS label_bps, round(vol * 10000, 4) AS vol_bps FROM training""")

    # aggregations
    windowed_body = f"""
SELECT make_timestamp(us // 3600000000 * 3600000000) AS window_start,
       make_timestamp(us // 3600000000 * 3600000000 + 3600000000) AS window_end, {STATS_COLUMNS}
FROM ticks GROUP BY us // 3600000000, {STATS_KEYS}"""
    sliding_body = f"""
SELECT make_timestamp(w) AS window_start, make_timestamp(w + 7200000000) AS window_end, {STATS_COLUMNS}
FROM (SELECT *, unnest([us // 3600000000 * 3600000000, us // 3600000000 * 3600000000 - 3600000000]) AS w FROM ticks)
GROUP BY w, {STATS_KEYS}"""
    out["windowed_stats"], out["sliding_stats"] = _sql("", windowed_body), _sql("", sliding_body)
    out["forecast_stats"] = _sql(POINTS, """
SELECT asset, CAST(sec AS DOUBLE) AS ts, round(mid, 6) AS btc_mid, round(prob, 6) AS poly_prob,
       round((prob * 2 - 1) * 0.0005, 6) AS log_return,
       round(mid * exp((prob * 2 - 1) * 0.0005) - mid, 6) AS drift,
       round(mid * exp((prob * 2 - 1) * 0.0005), 6) AS forecast,
       round(mid * 0.0005, 6) AS sigma, 0.0005::DOUBLE AS sigma_log
FROM points""")
    out["last_per_bucket"] = _sql(SECONDS, """
SELECT asset, sec, round(mid, 6) AS btc_mid, round(prob, 6) AS poly_p_up FROM secs""")
    out["event_mix"] = _sql("", """
SELECT source, type, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM env), 6) AS share_pct
FROM env GROUP BY ALL""")
    out["throughput_summary"] = _sql("", """,
span AS (SELECT max(recv_ts) - min(recv_ts) AS s, count(*) AS n FROM env)
SELECT topic, count(*) AS n, round(count(*) / (SELECT s FROM span), 6) AS avg_rate, CAST(NULL AS VARCHAR) AS verdict
FROM env GROUP BY topic
UNION ALL
SELECT 'TOTAL', n, round(n / s, 6), CASE WHEN n / s >= 4000 THEN 'PASS' ELSE 'BELOW TARGET' END FROM span""")
    rolling = """,
times AS (SELECT topic, us AS t_us, count(*) AS n FROM env GROUP BY ALL),
rolling AS (
  SELECT topic, t_us, n, CAST(sum(n) OVER (PARTITION BY topic ORDER BY t_us
    RANGE BETWEEN 599999999 PRECEDING AND CURRENT ROW) AS BIGINT) AS rate FROM times
)"""
    out["rolling_rate"] = _sql(rolling, "SELECT topic, t_us, n, rate FROM rolling")
    out["message_rates"] = _sql(rolling, """,
whole AS (SELECT topic, sum(n) / ((max(t_us) - min(t_us)) / 1e6) AS avg_rate FROM times GROUP BY topic)
SELECT r.topic, t_us // 3600000000 * 3600 AS interval_start, CAST(sum(n) AS BIGINT) AS n,
       round(sum(n) / 3600.0::DOUBLE, 6) AS interval_rate, max(rate) AS peak_rate, round(any_value(avg_rate), 6) AS avg_rate
FROM rolling r JOIN whole USING (topic) GROUP BY r.topic, t_us // 3600000000""")
    out["latency_summary"] = """
SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean_us,
       round(quantile_cont(value, 0.5), 6) AS p50_us, round(quantile_cont(value, 0.95), 6) AS p95_us,
       round(quantile_cont(value, 0.99), 6) AS p99_us, round(max(value), 6) AS max_us,
       round(1e6 / avg(value), 6) AS throughput
FROM events WHERE value IS NOT NULL GROUP BY event_type"""
    out["feature_summary"] = _sql(TRAINING, f"""
SELECT series, feature, count(*) AS n, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std,
       round(min(v), 4) AS min, round(quantile_cont(v, 0.25), 4) AS p25, round(quantile_cont(v, 0.5), 4) AS p50,
       round(quantile_cont(v, 0.75), 4) AS p75, round(max(v), 4) AS max
FROM ({_summary_rows()}) GROUP BY ALL""")
    out["split_summary"] = _sql(SPLIT, """
SELECT series, split, count(*) AS n, round(avg(y) * 10000, 4) AS mean_bps, round(stddev_samp(y) * 10000, 4) AS std_bps
FROM split GROUP BY series, split""")
    base = """SELECT s.series, s.split, y, '{name}' AS forecaster, {pred} AS pred
              FROM split s JOIN sigmas g ON s.series = g.series"""
    out["regression_metrics"] = _sql(SPLIT, METRICS.format(
        by="series, split",
        rows=base.format(name="market", pred="(2 * prob - 1) * sigma_log") + " UNION ALL "
        + base.format(name="zero", pred="0.0"),
    ))
    out["sigma_by_series"] = _sql(SPLIT, "SELECT series, n_train, round(sigma_log, 6) AS sigma_log FROM sigmas")
    out["coverage_report"] = _sql("", """
SELECT asset, count(*) AS n_rows, make_timestamp(min(us)) AS first_ts, make_timestamp(max(us)) AS last_ts,
       count(DISTINCT us // 600000000) FILTER (WHERE spot_leg) AS spot_seconds,
       count(DISTINCT us // 600000000) FILTER (WHERE prob_leg) AS prob_seconds
FROM ticks GROUP BY asset""")

    # time series
    out["ffill_bounded"] = _sql(SECONDS, """,
ends AS (SELECT asset, max(sec) FILTER (WHERE mid IS NOT NULL) AS em, max(sec) FILTER (WHERE prob IS NOT NULL) AS ep
         FROM secs GROUP BY asset),
fills AS (
  SELECT asset, sec,
    last_value(mid IGNORE NULLS) OVER (PARTITION BY asset ORDER BY sec RANGE BETWEEN 21600 PRECEDING AND CURRENT ROW) AS m,
    last_value(prob IGNORE NULLS) OVER (PARTITION BY asset ORDER BY sec RANGE BETWEEN 43200 PRECEDING AND CURRENT ROW) AS p
  FROM secs)
SELECT asset, sec, CASE WHEN sec <= em THEN round(m, 6) END AS btc_mid, CASE WHEN sec <= ep THEN round(p, 6) END AS poly_p_up
FROM fills JOIN ends USING (asset)""")
    out["snapshot_grid"] = _sql(SNAPSHOTS, "SELECT asset, t, round(mid, 6) AS btc_mid, round(prob, 6) AS poly_p_up FROM snaps")
    out["build_training_table"] = _sql(TRAINING, """
SELECT series, t, round(mid, 6) AS btc_mid, round(prob, 6) AS poly_p_up, round(ret, 6) AS btc_return_5m,
       round(vol, 6) AS btc_volatility_5m, round(change, 6) AS poly_p_up_change_5m, round(y, 6) AS log_return_5m
FROM training""")
    out["time_split"] = _sql(SPLIT, "SELECT series, t, idx, split FROM split")
    out["latest_values"] = _sql(POINTS, """
SELECT asset, round(arg_max(mid, sec) FILTER (WHERE mid IS NOT NULL), 6) AS btc_mid,
       round(arg_max(prob, sec) FILTER (WHERE prob IS NOT NULL), 6) AS poly_prob,
       round(arg_max(mid * 0.0005, sec) FILTER (WHERE mid IS NOT NULL), 6) AS sigma,
       round(arg_max(mid * exp((prob * 2 - 1) * 0.0005) - mid, sec) FILTER (WHERE mid IS NOT NULL AND prob IS NOT NULL), 6) AS drift
FROM points GROUP BY asset""")
    out["last_n"] = _sql("", """
SELECT source, event_id, rn, round(price, 6) AS price
FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY us DESC, event_id DESC) AS rn FROM ticks)
WHERE rn <= 100""")
    out["gap_check"] = _sql(BARS, """
SELECT series, t, t - lag(t) OVER w AS gap_s, coalesce(t - lag(t, 9) OVER w = 9 * 3600, false) AS contiguous
FROM bars WINDOW w AS (PARTITION BY series ORDER BY t)""")
    out["latest_stats"] = _sql("", f"""
SELECT make_timestamp(us // 3600000000 * 3600000000) AS window_start, series, asset, source, market_outcome,
  round(price_bucket, 6) AS price_bucket, round(min(price), 6) AS price_min, round(max(price), 6) AS price_max,
  round(avg(price), 6) AS price_avg, round(var_samp(price), 6) AS price_var, count(*) AS n
FROM ticks GROUP BY us // 3600000000, {STATS_KEYS}""")

    # joins
    sides = """,
trades AS (SELECT event_id, asset, us FROM ticks WHERE type = 'aggTrade'),
quotes AS (SELECT asset, us, price AS mid FROM ticks WHERE type = 'bookTicker')"""
    join = "FROM trades t ASOF LEFT JOIN quotes q ON t.asset = q.asset AND t.us >= q.us"
    fresh = "t.us - q.us <= 3600000000"
    out["asof_join"] = _sql(sides, f"""
SELECT event_id, t.asset, CASE WHEN {fresh} THEN q.us END AS quote_us, CASE WHEN {fresh} THEN round(mid, 6) END AS mid {join}""")
    out["asof_join_unbounded"] = _sql(sides, f"""
SELECT event_id, t.asset, q.us AS quote_us, round(mid, 6) AS mid {join}""")
    out["asof_scan"], out["asof_scan_unbounded"] = out["asof_join"], out["asof_join_unbounded"]
    out["asof_anchor"] = out["asof_anchor_scan"] = _sql(BARS, """,
firsts AS (SELECT series, min(t) AS t, arg_min(prob, t) AS prob FROM bars GROUP BY series)
SELECT b.series, b.t, coalesce(a.t, f.t) AS anchor_t, round(CASE WHEN a.t IS NOT NULL THEN a.prob ELSE f.prob END, 6) AS poly_p_up_anchor
FROM bars b ASOF LEFT JOIN bars a ON b.series = a.series AND b.t - 18000 >= a.t
JOIN firsts f ON b.series = f.series""")
    out["realized_label"] = _sql(BARS, """
SELECT series, t, CASE WHEN o = t - 18000 THEN o END AS origin_t,
       CASE WHEN o = t - 18000 THEN round(y, 6) END AS realized
FROM (SELECT series, t, lag(t, 5) OVER w AS o, ln(mid / lag(mid, 5) OVER w) AS y
      FROM bars WINDOW w AS (PARTITION BY series ORDER BY t))""")
    out["union_streams"] = _sql(POINTS, """
SELECT asset, sec, round(mid, 6) AS btc_mid, round(mid * exp((prob * 2 - 1) * 0.0005), 6) AS forecast, CAST(NULL AS BIGINT) AS n FROM points
UNION ALL
SELECT asset, us // 3600000000 * 3600, NULL, NULL, count(*) FROM ticks GROUP BY asset, us // 3600000000""")
    three = " UNION ALL ".join(
        f"SELECT w.series, y, '{n}' AS forecaster, {e} AS pred FROM walk w JOIN sigmas g ON w.series = g.series WHERE split = 'holdout'"
        for n, e in (("model", "pred5"), ("market", "(2 * prob - 1) * sigma_log"), ("zero", "0.0"))
    )
    out["baseline_comparison"] = _sql(AR1, METRICS.format(by="series", rows=three))

    # stream-shaped operators
    filled_body = """
SELECT asset, sec, round(mid, 6) AS btc_mid, round(prob, 6) AS poly_prob,
       round((prob * 2 - 1) * 0.0005, 6) AS log_return,
       round(mid * exp((prob * 2 - 1) * 0.0005) - mid, 6) AS drift,
       round(mid * exp((prob * 2 - 1) * 0.0005), 6) AS forecast,
       round(mid * 0.0005, 6) AS sigma, 0.0005::DOUBLE AS sigma_log
FROM filled"""
    out["carry_forward"] = _sql(FILLED, filled_body)
    out["minute_bars"] = _sql(BARS, "SELECT series, t, round(mid, 6) AS btc_mid, round(prob, 6) AS poly_p_up FROM bars")
    out["bar_features"] = _sql(BAR_FEATURES, """
SELECT series, t, contiguous, CASE WHEN contiguous THEN round(prob, 6) END AS x_prob,
       CASE WHEN contiguous THEN round(change, 6) END AS x_change, CASE WHEN contiguous THEN round(vol, 6) END AS x_vol
FROM bar_v""")
    out["live_features"] = _sql(BAR_FEATURES + _live("pts", "0.0005::DOUBLE", "live"), """
SELECT series, sec, feature_mode, round(x1, 6) AS x_prob, round(x2, 6) AS x_change, round(x3, 6) AS x_vol FROM live""")
    out["throttle"] = "WITH RECURSIVE " + EVENTS + """,
seconds AS MATERIALIZED (
  SELECT series, us // 1000000 AS sec, min(price) AS price FROM ticks WHERE series IS NOT NULL GROUP BY ALL),
kept(series, sec) AS (
  SELECT series, min(sec) FROM seconds GROUP BY series
  UNION ALL
  SELECT k.series, min(s.sec) FROM kept k JOIN seconds s ON s.series = k.series AND s.sec >= k.sec + 3600
  GROUP BY k.series, k.sec)
SELECT series, sec, round(price, 6) AS price FROM kept JOIN seconds USING (series, sec)"""
    out["score_batch"] = _sql(SCORED, f"""
SELECT series, {_iso("sec")} AS ts, CAST(sec AS DOUBLE) AS ts_unix, {_iso("sec + 18000")} AS target_ts,
       18000::BIGINT AS target_horizon_s, 'sarimax' AS model, feature_mode,
       round(mid, 6) AS sarimax_input_btc_mid, round(prob, 6) AS sarimax_poly_prob, round(lr, 6) AS log_return_pred,
       round(mid * exp(lr), 3) AS sarimax_forecast, round(mid * exp(lr) - mid, 3) AS sarimax_drift,
       round({_phi("(lr / sigma_log)")}, 6) AS sarimax_prob_up, round(sigma_log, 6) AS sigma_log
FROM scored""")

    # streams: what the watermark has closed by the end of the input
    closed = """,
wm AS (SELECT max(us) // 1000 * 1000 - {delay} AS w FROM ticks)"""
    out["stream_windowed_stats"] = _sql(closed.format(delay=7200000000), f"""
SELECT * FROM ({windowed_body}) WHERE epoch_us(window_end) <= (SELECT w FROM wm)""")
    out["stream_sliding_stats"] = _sql(closed.format(delay=7200000000), f"""
SELECT * FROM ({sliding_body}) WHERE epoch_us(window_end) <= (SELECT w FROM wm)""")
    out["stream_forecast"] = _sql(FILLED + closed.format(delay=3600000000), f"""
{filled_body} WHERE (sec + 600) * 1000000 <= (SELECT w FROM wm)""")
    own_sigma = "CASE asset WHEN 'BTC' THEN 0.0004::DOUBLE WHEN 'ETH' THEN 0.0007::DOUBLE ELSE 0.0005::DOUBLE END"
    own_body = filled_body.replace("0.0005::DOUBLE", "0.0005").replace("0.0005", own_sigma)
    out["stream_forecast_sigmas"] = _sql(FILLED + closed.format(delay=3600000000), f"""
{own_body} WHERE (sec + 600) * 1000000 <= (SELECT w FROM wm)""")
    out["stream_minute_bars"] = _sql(BARS + _timed("series"), """
SELECT series, t, round(mid, 6) AS btc_mid, round(prob, 6) AS poly_p_up FROM closed""")
    out["stream_state_eviction"] = _sql(BARS + _timed("series, day"), """,
bar_count AS (SELECT series, day, count(*) AS n_bars FROM closed GROUP BY ALL),
held AS (
  SELECT series, day, count(DISTINCT minute) FILTER (WHERE minute > passed) AS open_minutes,
         coalesce(passed + 3600 - max(sec) FILTER (WHERE minute <= passed) <= 64800, false) AS carried
  FROM daily, wm GROUP BY series, day, passed)
SELECT series, day, coalesce(n_bars, 0) AS n_bars, open_minutes, carried
FROM held LEFT JOIN bar_count USING (series, day)
WHERE n_bars IS NOT NULL OR open_minutes > 0 OR carried""")
    out["stream_throttle"] = out["throttle"] + (
        " WHERE sec * 1000000 <= (SELECT max(us) // 1000000 * 1000000 - 3600000000 FROM ticks WHERE series IS NOT NULL)"
    )
    out["live_pipeline"] = _sql(FILLED + closed.format(delay=0), f""",
late(sink, delay) AS (VALUES ('stats', 7200000000), ('forecast_points', 3600000000), ('forecast', 3600000000))
SELECT 'ticks' AS sink, source AS key, count(*) AS n FROM ticks GROUP BY ALL
UNION ALL
SELECT sink, series, count(*) FROM ({windowed_body}), wm JOIN late ON sink = 'stats'
WHERE epoch_us(window_end) <= w - delay GROUP BY ALL
UNION ALL
SELECT sink, asset, count(*) FROM filled, wm JOIN late ON sink <> 'stats'
WHERE (sec + 600) * 1000000 <= w - delay GROUP BY ALL""")
    out["stream_stats_topic"] = out["stream_windowed_stats"]
    out["stream_late_rows"] = out["stream_windowed_stats"]
    out["stream_update_mode"] = out["windowed_stats"]
    out["stream_ordered_output"] = _sql(closed.format(delay=7200000000), f"""
SELECT 1::BIGINT AS n_files, count(*) AS n_rows, true AS in_order
FROM ({windowed_body}) WHERE epoch_us(window_end) <= (SELECT w FROM wm)""")
    keys = [k.split(" AS ")[-1].strip() for k in STATS_KEYS.split(",")]
    out["stream_numbered_output"] = _sql(closed.format(delay=7200000000), f"""
SELECT row_number() OVER (ORDER BY window_start, {", ".join(f"{k} NULLS FIRST" for k in keys)}) - 1 AS seq,
       window_start, {", ".join(keys)}
FROM ({windowed_body}) WHERE epoch_us(window_end) <= (SELECT w FROM wm)""")
    out["stream_ticks"] = out["compact_ticks"]
    out["score_stream"] = out["score_batch"]

    # modelling
    entries = ("s11", "s12", "s13", "y1", "s22", "s23", "y2", "s33", "y3", "yy")
    out["exog_gram"] = _sql(AR1, " UNION ALL ".join(
        f"SELECT series, n AS n_train, {i}::BIGINT AS pos, round({e}, 6) AS v FROM gram" for i, e in enumerate(entries)
    ))
    everyone = """(SELECT DISTINCT series FROM split) e LEFT JOIN params p ON e.series = p.series"""
    status = "CASE WHEN p.series IS NOT NULL THEN 'ok' ELSE 'insufficient' END AS status, coalesce(n, 0) AS n_train"
    out["fit_arx"] = _sql(AR1, f"""
SELECT e.series, {status}, round(b1, 6) AS beta1, round(b2, 6) AS beta2, round(b3, 6) AS beta3,
       round(phi, 6) AS phi1, round(sigma_log, 6) AS sigma_log FROM {everyone}""")
    out["model_round_trip"] = _sql(AR1, f"""
SELECT e.series, {status}, round(b1, 6) AS beta1, round(sigma_log, 6) AS sigma_log,
       'poly_p_up,poly_p_up_change_5m,btc_volatility_5m' AS exog, 'log_return_5m' AS target FROM {everyone}""")
    out["walk_forward"] = _sql(AR1, """
SELECT series, idx, split, round(y, 10) AS y, round(pred5, 10) AS pred FROM walk""")
    out["order_grid"] = _sql(PROXIES, "SELECT series, p, q, n, round(aic, 4) AS aic, round(sigma2, 10) AS sigma2 FROM aics")
    out["select_order"] = _sql(PROXIES, """
SELECT e.series, CASE WHEN b.aic IS NOT NULL THEN 'ok' ELSE 'insufficient' END AS status,
       coalesce(m.n, 0) AS n_train, b.p, b.q, round(b.aic, 4) AS aic
FROM (SELECT DISTINCT series FROM split) e LEFT JOIN gram m USING (series)
LEFT JOIN (SELECT * FROM aics WHERE aic IS NOT NULL
           QUALIFY row_number() OVER (PARTITION BY series ORDER BY aic, p, q) = 1) b USING (series)""")
    out["walk_forward_arma"] = "WITH RECURSIVE " + EVENTS + AR1 + """,
known AS MATERIALIZED (SELECT s.* FROM us_lag s JOIN phis USING (series)),
es(series, idx, u, e) AS (
  SELECT series, idx, u, u FROM known WHERE idx = 0
  UNION ALL
  SELECT k.series, k.idx, k.u, k.u - 0.5 * es.u - 0.3 * es.e FROM es JOIN known k ON k.series = es.series AND k.idx = es.idx + 1)
SELECT k.series, k.idx, split, round(y, 10) AS y, round(xb + coalesce(0.5 * es.u + 0.3 * es.e, 0), 10) AS pred
FROM known k LEFT JOIN es ON es.series = k.series AND es.idx = k.idx - 1"""
    out["walk_forward_refit"] = _sql(_refit(), "")
    terms = (("poly_p_up", "b1", ("s22", "s23", "s23", "s33")), ("poly_p_up_change_5m", "b2", ("s11", "s13", "s13", "s33")),
             ("btc_volatility_5m", "b3", ("s11", "s12", "s12", "s22")))
    one = "SELECT series, '{t}' AS term, round({c}, 6) AS coef, round({e}, 6) AS std_err, round({c} / {e}, 6) AS z FROM {f}"
    out["coef_table"] = _sql(AR1 + """,
lagged AS (
  SELECT series, count(*) AS n, sum(u1 * u1) AS uu, sum(u1 * u) AS uy, sum(u * u) AS yy
  FROM us_lag WHERE split = 'train' AND u1 IS NOT NULL GROUP BY series)""", " UNION ALL ".join([
        one.format(t=t, c=b, f="gram JOIN betas USING (series) JOIN phis USING (series)", e=(
            f"sqrt((yy - b1*y1 - b2*y2 - b3*y3) / (gram.n - 3) * ({m[0]}*{m[3]} - {m[1]}*{m[2]}) / {_det(*_A)})"))
        for t, b, m in terms
    ] + [one.format(t="ar.L1", c="uy / uu", e="sqrt((yy - uy * uy / uu) / (n - 1) / uu)", f="lagged JOIN phis USING (series)")]))
    out["in_sample_fit"] = _sql(AR1, "SELECT series, idx, round(pred0, 10) AS fitted FROM walk WHERE split = 'train'")

    # documented only
    out["calibration"] = _sql(PROBS, """
SELECT forecaster, least(CAST(floor(p * 10) AS BIGINT), 9) AS bucket, count(*) AS n,
       round(avg(p), 6) AS mean_prob, round(avg(CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END), 6) AS up_rate
FROM (SELECT 'model_prob' AS forecaster, model_prob AS p, y FROM probs
      UNION ALL SELECT 'market_prob', market_prob, y FROM probs) GROUP BY ALL""")
    out["edge_signal"] = _sql(PROBS, """
SELECT series, idx, round(model_prob, 6) AS model_prob, round(model_prob - market_prob, 6) AS edge,
       abs(model_prob - market_prob) > 0.05 AS alert FROM probs""")
    out["cumulative_volume_delta"] = _sql("", """
SELECT event_id, symbol, round(sum(CASE WHEN user_id % 2 = 1 THEN -value ELSE value END) OVER
         (PARTITION BY symbol ORDER BY us, event_id), 4) AS cvd
FROM env WHERE type = 'aggTrade'""")
    out["cumulative_volume_exact"] = _sql("", """
SELECT event_id, symbol, sum(CAST(CASE WHEN user_id % 2 = 1 THEN -value ELSE value END AS DECIMAL(28, 10))) OVER
         (PARTITION BY symbol ORDER BY us, event_id)::VARCHAR AS cvd
FROM env WHERE type = 'aggTrade'""")
    out["number_rows"] = _sql("", """
SELECT event_id, us AS t_us, row_number() OVER (ORDER BY us, event_id) - 1 AS seq FROM ticks""")
    return out
