"""Equivalent SQL of the registered queries, for a second engine on the same tables."""

from __future__ import annotations

from erascope.functions.numeric import (
    PPF_CENTRE,
    PPF_CENTRE_HALF_WIDTH,
    PPF_CENTRE_OFFSET,
    PPF_MIDDLE,
    PPF_MIDDLE_LIMIT,
    PPF_MIDDLE_OFFSET,
    PPF_TAIL,
)
from erascope.operators.trees import HistogramTrees
from erascope.plans.training import histogram_trees
from erascope.workloads.tables import EVENT_FEATURES, EVENT_TYPES, LINE_FEATURES, META_COLUMN, WIDE

CODE = " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(EVENT_TYPES))

PANEL = f"""panel AS (
  SELECT CAST(event_id AS VARCHAR) AS id,
    CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS INTEGER) AS era,
    CAST(((event_id * 7 + user_id) % 5) / 4.0 AS FLOAT) AS target,
    value AS preds_0,
    CAST((event_id * 37) % 101 AS DOUBLE) AS preds_1,
    CAST(user_id AS DOUBLE) AS meta,
    CAST(event_id % 5 AS TINYINT) AS feature_a,
    CAST(user_id % 5 AS TINYINT) AS feature_b,
    CAST(floor(CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) / 20) AS TINYINT) AS feature_c,
    CAST(CASE event_type {CODE} END AS TINYINT) AS feature_d,
    CAST(floor(extract(hour FROM ts) / 5) AS TINYINT) AS feature_e,
    event_id
  FROM events)"""

LINES = """lines AS (
  SELECT CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) AS INTEGER) AS era,
    CAST((CAST(floor(l_extendedprice) AS BIGINT) % 5) / 4.0 AS FLOAT) AS target,
    l_extendedprice AS preds_0,
    l_quantity AS meta,
    CAST(floor((l_quantity - 1) / 10) AS TINYINT) AS feature_1,
    CAST(CAST(round(l_discount * 100) AS INTEGER) % 5 AS TINYINT) AS feature_2,
    CAST(CAST(round(l_tax * 100) AS INTEGER) % 5 AS TINYINT) AS feature_3,
    CAST((l_linenumber - 1) % 5 AS TINYINT) AS feature_4,
    CAST(l_suppkey % 5 AS TINYINT) AS feature_5
  FROM lineitem)"""

RAW = f"""raw AS (
  SELECT id, era AS d,
    CASE WHEN era = 30 THEN 'X' ELSE lpad(CAST(era AS VARCHAR), 4, '0') END AS label,
    CASE WHEN era <= 15 THEN 'train' WHEN era < 26 THEN 'validation' WHEN era <= 29 THEN 'test' ELSE 'live' END
      AS data_type,
    {", ".join(EVENT_FEATURES)},
    CASE WHEN era < 26 THEN target END AS target,
    CASE WHEN era < 26 THEN target END AS target_cyrusd_20,
    CASE WHEN era < 18 THEN target END AS target_cyrusd_60,
    CASE WHEN era < 26 AND event_id % 11 <> 0 THEN target END AS target_jeremy_20,
    CASE WHEN era < 18 AND event_id % 13 <> 0 THEN target END AS target_jeremy_60,
    CASE WHEN era >= 10 THEN CAST(preds_0 / 500 AS FLOAT) END AS benchmark,
    CASE WHEN era >= 18 AND era < 26 THEN CAST(meta / 150 AS FLOAT) END AS meta_value
  FROM panel)"""

FILLED = """filled AS (
  SELECT * EXCLUDE (target_jeremy_20, target_jeremy_60),
    CASE WHEN d < 26 THEN coalesce(target_jeremy_20, 0.5) ELSE target_jeremy_20 END AS target_jeremy_20,
    CASE WHEN d < 18 THEN coalesce(target_jeremy_60, 0.5) ELSE target_jeremy_60 END AS target_jeremy_60
  FROM raw)"""

TARGETS = ["target", "target_cyrusd_20", "target_cyrusd_60", "target_jeremy_20", "target_jeremy_60"]


def query(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def r6(expression: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0"


def horner(coefficients, r: str) -> str:
    text = repr(coefficients[0]) + "::DOUBLE"
    for c in coefficients[1:]:
        text = f"({text} * {r} + {c!r}::DOUBLE)"
    return text


def ppf(p: str) -> str:
    """Normal quantile of a column."""
    centre = f"({PPF_CENTRE_OFFSET} - ({p} - 0.5) * ({p} - 0.5))"
    tail = f"sqrt(-ln(least({p}, 1.0 - {p})))"
    middle = f"({tail} - {PPF_MIDDLE_OFFSET})"
    far = f"({tail} - {PPF_MIDDLE_LIMIT})"
    return (
        f"CASE WHEN abs({p} - 0.5) <= {PPF_CENTRE_HALF_WIDTH} THEN ({p} - 0.5) * {horner(PPF_CENTRE[0], centre)}"
        f" / {horner(PPF_CENTRE[1], centre)}"
        f" WHEN {tail} <= {PPF_MIDDLE_LIMIT} THEN sign({p} - 0.5) * {horner(PPF_MIDDLE[0], middle)}"
        f" / {horner(PPF_MIDDLE[1], middle)}"
        f" ELSE sign({p} - 0.5) * {horner(PPF_TAIL[0], far)} / {horner(PPF_TAIL[1], far)} END"
    )


def avg_rank(value: str, by: str = "era") -> str:
    part = f"PARTITION BY {by}" if by else ""
    peers = f"PARTITION BY {by}, CAST({value} AS FLOAT)" if by else f"PARTITION BY CAST({value} AS FLOAT)"
    return (
        f"(rank() OVER ({part} ORDER BY CAST({value} AS FLOAT)) + (count(*) OVER ({peers}) - 1) / 2.0)"
    )


def share(value: str, by: str = "era") -> str:
    part = f"PARTITION BY {by}" if by else ""
    return f"(({avg_rank(value, by)} - 0.5) / count(*) OVER ({part}))"


def power(x: str) -> str:
    return f"(sign({x}) * pow(abs({x}), 1.5))"


def score_ctes(source: str, preds: str = "preds_0", meta: str = "meta", by: str = "era", where: str = "true",
               target: str = "target", tag: str = "") -> list[str]:
    """CTEs ending in ``scores<tag>(era, n, corr, mmc, payoff)``."""
    part = f"PARTITION BY {by}" if by else ""
    key = f"{by} AS era" if by else "0 AS era"
    return [
        f"""shares{tag} AS (SELECT {key}, CAST({target} AS DOUBLE) AS t,
          CAST({target} AS DOUBLE) - avg(CAST({target} AS DOUBLE)) OVER ({part}) AS c,
          {share(preds, by)} AS ps, {share(meta, by)} AS ms, CAST({meta} AS DOUBLE) AS raw FROM {source} WHERE {where})""",
        f"""normals{tag} AS (SELECT era, t, {power('c')} AS te, {ppf('ps')} AS p, {ppf('ms')} AS m, raw
          FROM shares{tag})""",
        f"""parts{tag} AS (SELECT era, count(*) AS n,
          covar_pop(te, {power('p')}) / (stddev_pop(te) * stddev_pop({power('p')})) AS corr,
          4 * (covar_pop(t, p) - sum(m * p) / sum(m * m) * covar_pop(t, m)) AS mmc
          FROM normals{tag} GROUP BY era)""",
        f"scores{tag} AS (SELECT *, 0.5 * corr + 2 * mmc AS payoff FROM parts{tag})",
    ]


ANNUAL = "pow(exp(avg(ln(1 + 0.1 * payoff))), 260) - 1"
SUMMARY = (
    f"SELECT {r6('avg(corr)')} AS corr, {r6('avg(mmc)')} AS mmc, {r6('avg(payoff)')} AS payoff,"
    f" {r6(ANNUAL, 4)} AS annual_return FROM scores"
)


def metric_rows(split: str, tag: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT '{split}' AS split, '{m}' AS metric, {r6(f'avg({m})')} AS value FROM scores{tag}"
        for m in ("corr", "mmc", "payoff")
    )


def long_features(source: str, features, extra: str = "", where: str = "true") -> str:
    return " UNION ALL ".join(
        f"SELECT {i} AS f, {c} AS x{extra} FROM {source} WHERE {where}" for i, c in enumerate(features)
    )


def pair_rows(source: str, features, where: str = "true") -> str:
    """All ordered pairs (full square) with the target class."""
    values = ", ".join(f"({i}, CAST({c} AS TINYINT))" for i, c in enumerate(features))
    side = f"(VALUES {values})"
    return (
        f"pairs AS (SELECT a.f AS f1, b.f AS f2, a.x AS u, b.x AS v, CAST(trunc(4 * target) AS TINYINT) AS y"
        f" FROM {source}, LATERAL {side} AS a(f, x), LATERAL {side} AS b(f, x) WHERE {where})"
    )


def pair_counts(source: str, features, where: str = "true") -> list[str]:
    return [
        pair_rows(source, features, where),
        "xxy AS (SELECT f1, f2, u, v, y, count(*) AS n FROM pairs GROUP BY ALL)",
    ]


INFORMATION = [
    """wide AS (SELECT *, sum(n) OVER (PARTITION BY f1, f2) AS nn, sum(n) OVER (PARTITION BY f1, f2, u) AS nu,
       sum(n) OVER (PARTITION BY f1, f2, v) AS nv, sum(n) OVER (PARTITION BY f1, f2, y) AS ny,
       sum(n) OVER (PARTITION BY f1, f2, u, v) AS nuv, sum(n) OVER (PARTITION BY f1, f2, u, y) AS nuy,
       sum(n) OVER (PARTITION BY f1, f2, v, y) AS nvy FROM xxy)""",
    """info AS (SELECT f1, f2,
       sum(n / nn * ln(CAST(nuv AS DOUBLE) * nn / (CAST(nu AS DOUBLE) * nv))) AS mi,
       sum(n / nn * ln(CAST(ny AS DOUBLE) * n / (CAST(nuy AS DOUBLE) * nvy))) AS cmi,
       sum(n / nn * ln(CAST(nuy AS DOUBLE) * nn / (CAST(nu AS DOUBLE) * ny))) AS rel
       FROM wide GROUP BY f1, f2)""",
    "rel AS (SELECT f1 AS f, rel FROM info WHERE f1 = f2)",
]

GREEDY = {
    "CIFE": "r.rel - sum(i.mi - i.cmi)",
    "JMI": "r.rel - avg(i.mi - i.cmi)",
    "CMIM": "r.rel - max(i.mi - i.cmi)",
    "JMIM": "r.rel - max(i.mi - i.cmi - s.rel)",
    "DMIM": "r.rel - max(i.mi) + max(i.cmi)",
}


def greedy_ctes(method: str, count: int) -> list[str]:
    """One CTE per pick, ending in ``<method>_picks(pos, f, objective)``."""
    m = method.lower()
    steps = [f"{m}0 AS (SELECT 0 AS pos, f, rel AS objective FROM rel ORDER BY rel DESC, f LIMIT 1)"]
    for k in range(1, count):
        chosen = " UNION ALL ".join(f"SELECT f FROM {m}{i}" for i in range(k))
        steps.append(
            f"""{m}{k} AS (SELECT {k} AS pos, r.f, {GREEDY[method]} AS objective
              FROM rel r JOIN info i ON i.f1 = r.f JOIN rel s ON s.f = i.f2
              WHERE i.f2 IN ({chosen}) AND r.f NOT IN ({chosen})
              GROUP BY r.f, r.rel ORDER BY objective DESC, r.f LIMIT 1)"""
        )
    steps.append(f"{m}_picks AS (" + " UNION ALL ".join(f"SELECT * FROM {m}{i}" for i in range(count)) + ")")
    return steps


def ols_ctes(source: str, features, targets=("target",), where: str = "true", tag: str = "") -> list[str]:
    """Normal equations solved by elimination; ends in one row ``fit<tag>(b<i>_<t>)``, b0 the intercept."""
    terms = ["1.0", *[f"CAST({c} AS DOUBLE)" for c in features]]
    k, w = len(terms), len(terms) + len(targets)
    full = [*terms, *[f"CAST({t} AS DOUBLE)" for t in targets]]
    sums = ", ".join(f"sum({full[i]} * {full[j]}) AS m{i}_{j}" for i in range(k) for j in range(w))
    steps = [f"g{tag}0 AS (SELECT {sums} FROM {source} WHERE {where})"]
    for p in range(k):
        cells = []
        for i in range(k):
            for j in range(w):
                if i == p:
                    cells.append(f"m{p}_{j} / m{p}_{p} AS m{i}_{j}")
                else:
                    cells.append(f"m{i}_{j} - m{i}_{p} * m{p}_{j} / m{p}_{p} AS m{i}_{j}")
        steps.append(f"g{tag}{p + 1} AS (SELECT {', '.join(cells)} FROM g{tag}{p})")
    last = ", ".join(f"m{i}_{k + t} AS b{i}_{t}" for i in range(k) for t in range(len(targets)))
    steps.append(f"fit{tag} AS (SELECT {last} FROM g{tag}{k})")
    return steps


def prediction(features, t: int = 0) -> str:
    return f"b0_{t} + " + " + ".join(f"{c} * b{i + 1}_{t}" for i, c in enumerate(features))


def model_rows(features, targets=("target",)) -> str:
    rows = []
    for t, name in enumerate(targets):
        for i, term in enumerate(["(intercept)", *features]):
            rows.append(
                f"SELECT '{name}' AS target, {i} AS pos, '{term}' AS term, {r6(f'b{i}_{t}')} AS value FROM fit"
            )
    return " UNION ALL ".join(rows)


def named(positions: str, features) -> str:
    return f"list_extract([{', '.join(repr(c) for c in features)}], CAST({positions} AS INTEGER) + 1)"


MODEL = [PANEL, *ols_ctes("panel", EVENT_FEATURES, where="era < 17")]
SCORED = [
    *MODEL,
    f"scored AS (SELECT panel.*, {prediction(EVENT_FEATURES)} AS prediction FROM panel, fit)",
]
EVALUATED = [
    *SCORED,
    *score_ctes("scored", "round(prediction, 12)", where="era >= 18 AND era < 26", tag="_val"),
    *score_ctes("scored", "round(prediction, 12)", where="era >= 26 AND era < 31", tag="_test"),
]


def violations(rule: str, column: str, condition: str, source: str) -> str:
    return (
        f"SELECT '{rule}' AS \"rule\", '{column}' AS \"column\", CAST(count(*) FILTER (WHERE {condition}) AS BIGINT)"
        f" AS violations FROM {source}"
    )


def window_violations(source: str) -> str:
    windows = [("v5_lgbm_cyrusd20", "benchmark", "((d >= 10 AND d < 31) OR data_type = 'live')")]
    windows.append((META_COLUMN, "meta_value", "(d >= 18 AND d < 26)"))
    windows += [(c, c, "(d < 26)") for c in TARGETS if c.endswith("20")]
    windows += [(c, c, "(d < 18)") for c in TARGETS if c.endswith("60")]
    rows = []
    for name, column, inside in windows:
        rows.append(violations("present_inside", name, f"{inside} AND {column} IS NULL", source))
        rows.append(violations("absent_outside", name, f"NOT {inside} AND {column} IS NOT NULL", source))
    return " UNION ALL ".join(rows)


def panel_digest(source: str) -> str:
    """Per era and part: rows, sums of features, counts and sums of the float columns."""
    cells = ["d AS era", "data_type", "count(*) AS n"]
    cells += [f"CAST(sum({c}) AS BIGINT) AS {c}" for c in EVENT_FEATURES]
    for c in TARGETS:
        cells += [f"count({c}) AS n_{c}", f"{r6(f'coalesce(sum(CAST({c} AS DOUBLE)), 0)', 4)} AS s_{c}"]
    for name, c in (("benchmark", "benchmark"), ("meta", "meta_value")):
        cells += [f"count({c}) AS n_{name}", f"{r6(f'coalesce(sum(CAST({c} AS DOUBLE)), 0)', 4)} AS s_{name}"]
    return f"SELECT {', '.join(cells)} FROM {source} GROUP BY ALL"


def tree_ctes(source: str, features: list[str], train: str, trees: HistogramTrees, tag: str = "") -> list[str]:
    """Boosted trees level by level: rows carry their prediction ``p`` and node, sums come from the ``train`` rows.

    Ends in ``nodes{tag}`` (the table of nodes without the base) and ``grown{tag}`` (all rows with their prediction).
    """
    xs = ", ".join(f"{c} AS x{i}" for i, c in enumerate(features))
    ctes = [
        f"r{tag}_0 AS MATERIALIZED (SELECT *, {xs}, CAST(target AS DOUBLE) AS y, ({train}) AS seen,"
        f" (SELECT avg(CAST(target AS DOUBLE)) FROM {source} WHERE {train}) AS p FROM {source})"
    ]
    nodes = []
    for t in range(trees.rounds):
        ctes.append(f"a{tag}_{t}_0 AS MATERIALIZED (SELECT *, 0 AS node FROM r{tag}_{t})")
        for d in range(trees.depth):
            name, first = f"{tag}_{t}_{d}", 2**d - 1
            long = " UNION ALL ".join(
                f"SELECT node, {f} AS f, x{f} AS x, y - p AS g FROM a{name} WHERE seen AND node >= {first}" for f in trees.sampled(t)
            )
            ctes += [
                f"c{name} AS MATERIALIZED (SELECT node, f, x, sum(g) AS g, count(*) AS n FROM ({long}) GROUP BY ALL)",
                f"s{name} AS (SELECT node, f, x, sum(g) OVER up AS gl, sum(n) OVER up AS nl, sum(g) OVER pair AS g, sum(n) OVER pair AS n"
                f" FROM c{name} WINDOW up AS (PARTITION BY node, f ORDER BY x ROWS UNBOUNDED PRECEDING), pair AS (PARTITION BY node, f))",
                f"b{name} AS MATERIALIZED (SELECT * FROM (SELECT node, f, x, n,"
                f" round(gl * gl / (nl + 1) + (g - gl) * (g - gl) / (n - nl + 1) - g * g / (n + 1), 9) AS gain FROM s{name} WHERE nl < n)"
                f" WHERE gain > 1e-6 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, x) = 1)",
                f"a{tag}_{t}_{d + 1} AS MATERIALIZED (SELECT a.* EXCLUDE (node), CASE WHEN b.node IS NULL THEN a.node"
                f" ELSE 2 * a.node + 1 + CAST(CASE b.f {' '.join(f'WHEN {f} THEN a.x{f}' for f in trees.sampled(t))} END > b.x AS INTEGER) END AS node"
                f" FROM a{name} a LEFT JOIN b{name} b ON a.node = b.node)",
            ]
            nodes.append(f"SELECT {t} AS tree, node, {named('f', features)} AS feature, x AS threshold, NULL AS value, gain, n AS rows FROM b{name}")
        last = f"{tag}_{t}_{trees.depth}"
        ctes += [
            f"v{tag}_{t} AS MATERIALIZED (SELECT node, {trees.rate} * sum(y - p) / (count(*) + 1) AS value, count(*) AS n FROM a{last} WHERE seen GROUP BY node)",
            f"r{tag}_{t + 1} AS MATERIALIZED (SELECT a.* EXCLUDE (node, p), p + coalesce(value, 0) AS p FROM a{last} a LEFT JOIN v{tag}_{t} v ON a.node = v.node)",
        ]
        nodes.append(f"SELECT {t}, node, NULL, NULL, value, 0, n FROM v{tag}_{t}")
    return [*ctes, f"nodes{tag} AS ({' UNION ALL '.join(nodes)})", f"grown{tag} AS (SELECT * FROM r{tag}_{trees.rounds})"]


def elimination_ctes(source: str, features: list[str], target: str = "target") -> list[str]:
    """Backward elimination by exchange steps on the products of ``a<i>`` and the target; ends in ``report``.

    An exchange step on all features turns the products into their inverse, the coefficients and the residual sum;
    a further step on one feature takes it out again.
    """
    size = len(features)
    products = " UNION ALL ".join(
        f"SELECT {i} AS i, {j} AS j, sum({a} * {b}) AS v FROM {source}"
        for i, a in enumerate([*features, target]) for j, b in enumerate([*features, target])
    )

    def exchange(before: str, pivot: str) -> str:
        return f"""SELECT x.i, x.j, CASE WHEN x.i = k AND x.j = k THEN 1 / d.v WHEN x.i = k THEN x.v / d.v WHEN x.j = k THEN -x.v / d.v
          ELSE x.v - c.v * r.v / d.v END AS v FROM {before} x, ({pivot}) p JOIN {before} d ON d.i = k AND d.j = k
          JOIN {before} c ON c.j = k JOIN {before} r ON r.i = k WHERE c.i = x.i AND r.j = x.j"""

    ctes = [f"z0 AS MATERIALIZED ({products})", f"many AS (SELECT count(*) AS n FROM {source})"]
    for k in range(size):
        ctes.append(f"z{k + 1} AS MATERIALIZED ({exchange(f'z{k}', f'SELECT {k} AS k')})")
    ctes += [f"e0 AS (SELECT * FROM z{size})", f"alive0 AS (SELECT unnest(range({size})) AS k)"]
    for s in range(size + 1):
        ctes += [
            f"""t{s} AS MATERIALIZED (SELECT k, b.v AS beta,
              b.v / sqrt(greatest(q.v, 0) / ((SELECT n FROM many) - (SELECT count(*) FROM alive{s})) * d.v) AS t
              FROM alive{s} JOIN e{s} b ON b.i = k AND b.j = {size} JOIN e{s} d ON d.i = k AND d.j = k JOIN e{s} q ON q.i = {size} AND q.j = {size})""",
            f"worst{s} AS MATERIALIZED (SELECT k FROM t{s} WHERE t < 0 ORDER BY t, k LIMIT 1)",
            f"alive{s + 1} AS MATERIALIZED (SELECT k FROM alive{s} WHERE k NOT IN (SELECT k FROM worst{s}))",
            f"e{s + 1} AS MATERIALIZED ({exchange(f'e{s}', f'SELECT k FROM worst{s}')} UNION ALL SELECT * FROM e{s} WHERE NOT EXISTS (SELECT 1 FROM worst{s}))",
        ]
    rows = [f"SELECT k, beta, t, {s + 1} AS dropped_at FROM t{s} WHERE k IN (SELECT k FROM worst{s})" for s in range(size)]
    rows.append(f"SELECT k, beta, t, NULL FROM t{size} WHERE t >= 0")
    return [*ctes, f"report AS ({' UNION ALL '.join(rows)})"]


def build() -> dict[str, str]:
    sql: dict[str, str] = {}
    feats = ", ".join(EVENT_FEATURES)
    five = len(EVENT_FEATURES)
    event_pairs = [PANEL, *pair_counts("panel", EVENT_FEATURES)]
    event_info = [*event_pairs, *INFORMATION]
    train_info = [PANEL, *pair_counts("panel", EVENT_FEATURES, "era < 16"), *INFORMATION]
    scores = [PANEL, *score_ctes("panel")]
    line_scores = [LINES, *score_ctes("lines")]

    # sources and sinks
    sql["s1_panel_scan"] = query(
        PANEL, select=f"SELECT id, era, target, {feats} FROM panel"
    )
    sql["s2_raw_scan"] = query(
        PANEL, RAW,
        select="""SELECT CASE WHEN d <= 15 THEN 'train' WHEN d = 30 THEN 'live' ELSE 'validation' END AS part,
            count(*) AS n FROM raw GROUP BY ALL
          UNION ALL SELECT CASE WHEN d <= 15 THEN 'train' WHEN d = 30 THEN 'live' ELSE 'validation' END
            || '_benchmark_models', count(benchmark) FROM raw WHERE d >= 10 GROUP BY ALL
          UNION ALL SELECT 'meta_model', count(meta_value) FROM raw""",
    )
    sql["s3_panel_sink"] = query(
        PANEL, select=f"SELECT era, count(*) AS n, {r6('sum(CAST(target AS DOUBLE))')} AS total FROM panel GROUP BY era"
    )
    set_rows = []
    for name, members in (("all", EVENT_FEATURES), ("small", EVENT_FEATURES[:3]), ("medium", ["feature_e", "feature_b"])):
        set_rows += [
            f"SELECT '{name}' AS set_name, {i} AS pos, '{c}' AS feature, CAST(sum({c}) AS BIGINT) AS total FROM panel"
            for i, c in enumerate(members)
        ]
    sql["s4_feature_sets"] = query(PANEL, select=" UNION ALL ".join(set_rows))
    methods = list(GREEDY)
    all_greedy = [c for m in methods for c in greedy_ctes(m, five)]
    sql["s5_ranked_sets"] = query(
        *train_info, *all_greedy,
        select=" UNION ALL ".join(
            f"SELECT '{m.lower()}' AS set_name, pos, {named('f', EVENT_FEATURES)} AS feature FROM {m.lower()}_picks"
            for m in methods
        ),
    )
    eras_sql = """SELECT 1 AS train, min(d) FILTER (WHERE benchmark IS NOT NULL) AS benchmark,
        min(d) FILTER (WHERE data_type = 'validation') AS validation,
        min(d) FILTER (WHERE meta_value IS NOT NULL) AS metamodel,
        min(d) FILTER (WHERE data_type = 'test') AS test, max(d) AS live FROM raw"""
    sql["s6_era_catalogue"] = query(PANEL, RAW, select=eras_sql)
    sql["s7_completeness"] = (
        "SELECT 'before' AS stage, false AS complete, CAST(0 AS BIGINT) AS n"
        " UNION ALL SELECT 'after', true, count(*) FROM events"
    )
    sql["s8_versions"] = (
        "SELECT 1 AS version, false AS is_current, count(*) AS n FROM events"
        " UNION ALL SELECT 2, true, count(*) FROM events"
    )
    sql["s9_selected_sink"] = query(
        *event_info,
        select=f"SELECT CAST(row_number() OVER (ORDER BY rel DESC, f) - 1 AS INTEGER) AS pos, {named('f', EVENT_FEATURES)} AS feature"
        " FROM rel ORDER BY rel DESC, f LIMIT 3",
    )
    both_splits = [
        PANEL,
        *score_ctes("panel", where="era >= 18 AND era < 26", tag="_val"),
        *score_ctes("panel", where="era >= 26 AND era < 31", tag="_test"),
    ]
    sql["s10_metrics_sink"] = query(
        *both_splits,
        select="SELECT 'value' AS run_id, * FROM ("
        + metric_rows("val", "_val") + " UNION ALL " + metric_rows("test", "_test") + ")",
    )
    sql["s11_run_parameters"] = """SELECT CAST(event_id AS VARCHAR) AS run_id, 'model.name' AS key,
          event_type AS value FROM events
        UNION ALL SELECT CAST(event_id AS VARCHAR), 'model.args.k', regexp_extract(props, '"k": *([0-9]+)', 1)
          FROM events
        UNION ALL SELECT CAST(event_id AS VARCHAR), 'clock.0', CAST(extract(hour FROM ts) AS VARCHAR) FROM events
        UNION ALL SELECT CAST(event_id AS VARCHAR), 'clock.1.minute', CAST(extract(minute FROM ts) AS VARCHAR)
          FROM events"""

    # projections and filters
    era_digest = f"SELECT era, count(*) AS n, {r6('sum(preds_0)', 4)} AS total FROM panel WHERE {{}} GROUP BY era"
    sql["p1_era_range"] = query(PANEL, select=era_digest.format("era >= 5 AND era < 12"))
    sql["p2_before_era"] = query(PANEL, select=era_digest.format("era < 16"))
    sql["p3_default_range"] = query(PANEL, select=era_digest.format("era >= 1 AND era < 2"))
    sql["p4_feature_resolver"] = query(
        PANEL,
        select=" UNION ALL ".join(
            f"SELECT {i} AS pos, '{c}' AS feature, CAST(sum({c}) AS BIGINT) AS total FROM panel"
            for i, c in enumerate(EVENT_FEATURES[:3])
        ),
    )
    sql["p5_target_resolver"] = query(
        PANEL, RAW,
        select=" UNION ALL ".join(
            f"SELECT '{ask}' AS asked, '{c}' AS target, count({c}) AS n, "
            f"{r6(f'sum(CAST({c} AS DOUBLE))', 4)} AS total FROM raw"
            for ask, c in (("none", "target"), ("two", "target_cyrusd_60"), ("two", "target_jeremy_20"))
        ),
    )
    sql["p6_prefix_suffix"] = query(
        PANEL, RAW,
        select=" UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count({c}) AS n FROM raw" for c in TARGETS if c.endswith("20")
        ),
    )
    sql["p7_panel_projection"] = query(
        PANEL,
        select=f"SELECT id, era, {feats}, target, CAST(meta AS FLOAT) AS {META_COLUMN} FROM panel"
        " WHERE era >= 3 AND era < 9",
    )
    sql["p8_feature_dtype"] = query(
        PANEL,
        select="SELECT id, 'Int8' AS dtype, CAST(feature_a AS DOUBLE) AS a, CAST(feature_c AS DOUBLE) AS c FROM panel"
        " UNION ALL SELECT id, 'Float32', feature_a, feature_c FROM panel",
    )
    cast_sums = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in EVENT_FEATURES)
    sql["p9_type_normalisation"] = query(
        PANEL, RAW,
        select=f"""SELECT d AS era, data_type, count(*) AS n, {cast_sums},
          {r6('coalesce(sum(CAST(target AS DOUBLE)), 0)', 4)} AS target,
          {r6('coalesce(sum(CAST(benchmark AS DOUBLE)), 0)', 4)} AS benchmark FROM raw GROUP BY ALL""",
    )
    sql["p10_live_relabel"] = query(PANEL, RAW, select="SELECT d AS era, data_type, count(*) AS n FROM raw GROUP BY ALL")
    fill_cells = ", ".join(
        f"count({c}) AS n_{c}, {r6(f'coalesce(sum(CAST({c} AS DOUBLE)), 0)', 4)} AS s_{c}" for c in TARGETS[3:]
    )
    sql["p11_conditional_fill"] = query(
        PANEL, RAW, FILLED, select=f"SELECT d AS era, {fill_cells} FROM filled GROUP BY d"
    )
    sql["p12_target_code"] = query(
        PANEL, select="SELECT CAST(trunc(4 * target) AS TINYINT) AS y, count(*) AS n FROM panel GROUP BY ALL"
    )
    split_case = (
        "CASE WHEN era >= 1 AND era < 17 THEN 'train' WHEN era >= 18 AND era < 26 THEN 'validation'"
        " WHEN era >= 26 AND era < 31 THEN 'test' ELSE 'none' END"
    )
    sql["p13_split_assignment"] = query(
        PANEL, select=f"SELECT {split_case} AS split, count(*) AS n, count(DISTINCT era) AS eras FROM panel GROUP BY ALL"
    )
    sql["p14_walk_forward"] = query(
        PANEL,
        select="""SELECT 'train' AS split, min(era) AS first, max(era) AS last, count(*) AS n FROM panel
          WHERE era >= 1 AND era < 17
          UNION ALL SELECT 'validation', min(era), max(era), count(*) FROM panel WHERE era >= 19 AND era < 27""",
    )

    # joins
    sql["j1_vertical_concat"] = query(
        PANEL, RAW, select="SELECT data_type, label AS era, count(*) AS n FROM raw GROUP BY ALL"
    )
    sql["j2_benchmark_join"] = query(PANEL, RAW, select="SELECT id, label AS era, data_type, benchmark FROM raw")
    sql["j3_meta_join"] = query(
        PANEL, RAW, select=f"SELECT id, label AS era, data_type, meta_value AS {META_COLUMN} FROM raw"
    )
    sql["j2_bucketed_joins"] = query(
        PANEL, RAW, select=f"SELECT id, label AS era, data_type, benchmark, meta_value AS {META_COLUMN} FROM raw"
    )
    sql["j4_panel_build"] = query(PANEL, RAW, select=panel_digest("raw"))
    sql["j5_prepare"] = query(PANEL, RAW, FILLED, select=panel_digest("filled"))

    # aggregates and checks
    sql["a1_special_eras"] = sql["s6_era_catalogue"]
    dirty = f"""dirty AS (SELECT * REPLACE (
        CASE WHEN event_id % 7 = 0 THEN CAST('nan' AS DOUBLE) WHEN event_id % 7 = 1 THEN NULL ELSE preds_0 END
          AS preds_0,
        CASE WHEN event_id % 50 = 0 THEN NULL ELSE feature_c END AS feature_c) FROM panel)"""
    sql["a2_nan_check"] = query(
        PANEL, dirty,
        select=" UNION ALL ".join(
            violations("not_nan", c, f"isnan({c})", "dirty") for c in ("target", "preds_0", "preds_1", "meta")
        ),
    )
    sql["a3_null_check"] = query(
        PANEL, dirty,
        select=" UNION ALL ".join(
            violations("not_null", c, f"{c} IS NULL", "dirty") for c in ("era", "id", *EVENT_FEATURES)
        ),
    )
    sql["a4_presence_windows"] = query(PANEL, RAW, select=window_violations("raw"))
    float_columns = [*[(c, c) for c in TARGETS], ("v5_lgbm_cyrusd20", "benchmark"), (META_COLUMN, "meta_value")]
    sql["a5_check_report"] = query(
        PANEL, RAW, FILLED,
        select=" UNION ALL ".join(
            [violations("not_nan", n, f"isnan({c})", "filled") for n, c in float_columns]
            + [
                violations("not_null", n, f"{c} IS NULL", "filled")
                for n, c in (("era", "d"), ("data_type", "data_type"), ("id", "id"), *[(c, c) for c in EVENT_FEATURES])
            ]
            + [window_violations("filled")]
        ),
    )
    sql["a6_row_count"] = query(PANEL, select='SELECT count(*) AS "rows" FROM panel WHERE era >= 1 AND era < 2')
    sql["a7_value_counts"] = query(
        LINES,
        select=f"SELECT f, x, count(*) AS n FROM ({long_features('lines', LINE_FEATURES)}) GROUP BY ALL",
    )
    with_y = ", CAST(trunc(4 * target) AS TINYINT) AS y"
    sql["a8_target_counts"] = query(
        LINES,
        select=f"SELECT f, x, y, count(*) AS n FROM ({long_features('lines', LINE_FEATURES, with_y)}) GROUP BY ALL",
    )
    line_pairs = [LINES, *pair_counts("lines", LINE_FEATURES)]
    sql["a9_pair_counts"] = query(
        *line_pairs, select="SELECT f1, f2, u, v, CAST(sum(n) AS BIGINT) AS n FROM xxy GROUP BY ALL"
    )
    sql["a10_pair_target_counts"] = query(*line_pairs, select="SELECT * FROM xxy")
    sql["a10_pair_target_counts_tiled"] = sql["a10_pair_target_counts"]
    sql["a11_marginal_target"] = sql["a8_target_counts"]
    sql["a12_marginal_pairs"] = sql["a9_pair_counts"]
    gram_columns = ["1.0", *[f"CAST({c} AS DOUBLE)" for c in [*LINE_FEATURES, "target"]]]
    gram_sql = query(
        LINES,
        select=" UNION ALL ".join(
            f"SELECT {i} AS i, {j} AS j, {r6(f'sum({gram_columns[i]} * {gram_columns[j]})')} AS value FROM lines"
            for i in range(len(gram_columns))
            for j in range(i, len(gram_columns))
        ),
    )
    sql["a13_gram"] = gram_sql
    sql["a13_gram_blocks"] = gram_sql
    sql["a14_mean_of_eras"] = query(
        *scores, select=f"SELECT {r6('avg(corr)')} AS corr, {r6('avg(payoff)')} AS payoff FROM scores"
    )
    sql["a15_annualized_return"] = query(*scores, select=f"SELECT {r6(ANNUAL, 4)} AS annual_return FROM scores")

    # per-era transforms
    sql["w1_average_rank"] = query(
        PANEL, select=f"SELECT id, era, {avg_rank('preds_0')} AS rank_0, {avg_rank('meta')} AS rank_m FROM panel"
    )
    sql["w1_average_rank_hot"] = sql["w1_average_rank"]
    centred = "CAST(target AS DOUBLE) - avg(CAST(target AS DOUBLE)) OVER (PARTITION BY era)"
    sql["w2_center"] = query(PANEL, select=f"SELECT id, era, {r6(centred)} AS centred FROM panel")
    normals = [PANEL, f"s AS (SELECT *, {share('preds_0')} AS ps, {share('meta')} AS ms FROM panel)",
               f"g AS (SELECT *, {ppf('ps')} AS g, {ppf('ms')} AS gm FROM s)"]
    sql["w3_gaussianize"] = query(*normals, select=f"SELECT id, era, {r6('g')} AS g, {r6('gm')} AS gm FROM g")
    sql["w4_normal_quantile"] = query(
        PANEL,
        "q AS (SELECT id, (event_id + 0.5) / (max(event_id) OVER () + 1.0) AS p FROM panel)",
        select=f"SELECT id, {r6(ppf('p'))} AS q FROM q",
    )
    sql["w5_signed_power"] = query(
        PANEL, "c AS (SELECT id, era, preds_0 - 50.0 AS x FROM panel)",
        select=f"SELECT id, era, {r6(power('x'))} AS y FROM c",
    )
    proj = (
        "preds_0 - meta * sum(meta * preds_0) OVER (PARTITION BY era) / sum(meta * meta) OVER (PARTITION BY era)"
    )
    sql["w6_orthogonal_projection"] = query(PANEL, select=f"SELECT id, era, {r6(proj)} AS rest FROM panel")
    sql["w7_standardize"] = query(
        *normals, select=f"SELECT id, era, {r6('g / stddev_pop(g) OVER (PARTITION BY era)')} AS z FROM g"
    )
    ens = [
        PANEL,
        f"s AS (SELECT *, {share('preds_0')} AS s0, {share('preds_1')} AS s1 FROM panel)",
        f"n AS (SELECT *, {ppf('s0')} AS g0, {ppf('s1')} AS g1 FROM s)",
        "e AS (SELECT *, round((g0 / stddev_pop(g0) OVER (PARTITION BY era)"
        " + g1 / stddev_pop(g1) OVER (PARTITION BY era)) / 2, 12) + 0.0 AS mean_z FROM n)",
    ]
    sql["w8_ensemble"] = query(
        *ens, f"f AS (SELECT id, era, {share('mean_z')} AS fs FROM e)",
        select=f"SELECT id, era, {r6(ppf('fs'))} AS ensemble FROM f",
    )
    sql["w8_ensemble_scores"] = query(*ens, *score_ctes("e", "mean_z"), select=SUMMARY)
    sql["w9_global_scores"] = query(
        LINES, *score_ctes("lines", by=""),
        select=f"SELECT n, {r6('corr')} AS corr, {r6('mmc')} AS mmc, {r6('payoff')} AS payoff FROM scores",
    )
    sql["w9_global_gaussianize"] = query(
        PANEL, f"s AS (SELECT id, {share('preds_0', '')} AS ps FROM panel)",
        select=f"SELECT id, {r6(ppf('ps'))} AS g FROM s",
    )

    # scores
    for name, metric in (("m1_corr_by_era", "corr"), ("m2_mmc_by_era", "mmc"), ("m3_payoff_by_era", "payoff")):
        sql[name] = query(*scores, select=f"SELECT era, {r6(metric)} AS {metric} FROM scores")
    table = f"SELECT era, n, {r6('corr')} AS corr, {r6('mmc')} AS mmc, {r6('payoff')} AS payoff FROM scores"
    sql["m4_era_scores"] = query(*line_scores, select=table)
    sql["m4_era_scores_hot"] = query(*line_scores, select=table)
    sql["m4_era_scores_prefix"] = query(*scores, select=table)
    sql["m5_corr"] = query(*scores, select=f"SELECT {r6('avg(corr)')} AS corr FROM scores")
    sql["m6_mmc"] = query(*scores, select=f"SELECT {r6('avg(mmc)')} AS mmc FROM scores")
    sql["m7_payoff"] = query(*scores, select=f"SELECT {r6('avg(payoff)')} AS payoff FROM scores")
    sql["m8_annual_return"] = query(
        *line_scores, select=f"SELECT {r6(ANNUAL, 4)} AS annual_return FROM scores"
    )
    spread = [
        PANEL,
        f"""k AS (SELECT id, era, count(*) OVER (PARTITION BY era) AS n, {centred} AS c,
          (row_number() OVER (PARTITION BY era ORDER BY event_id) - 0.5) / count(*) OVER (PARTITION BY era) AS ps
          FROM panel)""",
        f"v AS (SELECT id, era, n, {power('c')} AS te, {ppf('ps')} AS u FROM k)",
    ]
    corr_vec = (
        f"te / (n * stddev_pop(te) OVER (PARTITION BY era) * stddev_pop({power('u')}) OVER (PARTITION BY era))"
    )
    sql["m9_corr_vector"] = query(*spread, select=f"SELECT id, era, {r6(corr_vec, 9)} AS corr_vector FROM v")
    mmc_vec = [
        PANEL,
        f"s AS (SELECT id, era, count(*) OVER (PARTITION BY era) AS n, {centred} AS t, {share('meta')} AS ms"
        " FROM panel)",
        f"g AS (SELECT *, {ppf('ms')} AS m FROM s)",
        "w AS (SELECT id, era, 4.0 / n * (t - m * sum(m * t) OVER (PARTITION BY era)"
        " / sum(m * m) OVER (PARTITION BY era)) AS weight FROM g)",
    ]
    sql["m10_mmc_vector"] = query(*mmc_vec, select=f"SELECT id, era, {r6('weight', 9)} AS mmc_vector FROM w")
    sql["m11_payoff_vector"] = query(
        *mmc_vec, f"f AS (SELECT id, era, {share('weight')} AS ws FROM w)",
        select=f"SELECT id, era, {r6(ppf('ws'))} AS payoff_vector FROM f",
    )

    # information and orders
    sql["f1_mi_with_target"] = query(*event_info, select=f"SELECT f, {r6('rel', 9)} AS mi FROM rel")
    line_info = [*line_pairs, *INFORMATION]
    sql["f2_mi_of_pairs"] = query(*line_info, select=f"SELECT f1, f2, {r6('mi', 9)} AS mi FROM info")
    sql["f3_cmi_of_pairs"] = query(*line_info, select=f"SELECT f1, f2, {r6('cmi', 9)} AS cmi FROM info")
    for number, m in enumerate(methods, start=4):
        sql[f"f{number}_order_{m.lower()}"] = query(
            *event_info, *greedy_ctes(m, five),
            select=f"SELECT pos, f, {r6('objective', 9)} AS objective FROM {m.lower()}_picks",
        )
    sql["f9_greedy_orders"] = query(
        *event_info, *all_greedy,
        select=" UNION ALL ".join(f"SELECT '{m}' AS method, pos, f FROM {m.lower()}_picks" for m in methods),
    )
    sql["f9_lazy_orders"] = f"SELECT * FROM ({sql['f9_greedy_orders']}) WHERE method IN ('CMIM', 'JMIM', 'DMIM')"
    sql["f9_greedy_steps"] = query(
        *event_info, *greedy_ctes("DMIM", five), select="SELECT 'DMIM' AS method, pos, f FROM dmim_picks"
    )
    sql["f10_feature_ranking"] = query(
        *train_info, *all_greedy,
        select=" UNION ALL ".join(
            f"SELECT '{m}' AS method, pos, {named('f', EVENT_FEATURES)} AS feature FROM {m.lower()}_picks"
            for m in methods
        ),
    )
    sql["f11_selection_hook"] = query(
        *event_info, *greedy_ctes("JMI", 3),
        select=f"SELECT 'jmi' AS strategy, pos, {named('f', EVENT_FEATURES)} AS feature FROM jmi_picks",
    )
    attr = ", ".join(
        r6(f"({c} - avg({c}) OVER ()) * b{i + 1}_0") + f" AS attr_{c}" for i, c in enumerate(EVENT_FEATURES)
    )
    sql["f12_linear_attributions"] = query(
        *MODEL, select=f"SELECT id, {attr} FROM panel, fit WHERE era >= 18 AND era < 26"
    )

    # models
    sql["l1_ols_fit"] = query(LINES, *ols_ctes("lines", LINE_FEATURES, ("target", "meta")),
                              select=model_rows(LINE_FEATURES, ("target", "meta")))
    sql["l1_ols_fit_blocks"] = query(LINES, *ols_ctes("lines", LINE_FEATURES), select=model_rows(LINE_FEATURES))
    predicted = f"SELECT id, {r6('prediction')} AS prediction FROM scored"
    sql["l2_ols_predict"] = query(*SCORED, select=predicted)
    sql["l3_linear_preset"] = query(LINES, *ols_ctes("lines", LINE_FEATURES), select=model_rows(LINE_FEATURES))
    sql["l5_fit_step"] = query(*MODEL, select=model_rows(EVENT_FEATURES))
    sql["l6_guarded_predict"] = query(*SCORED, select=predicted + " WHERE era >= 18 AND era < 26")
    terms = [f"{(i % 11 - 5) / 8} * ((n * {i + 1} + feature_b) % 7)" for i in range(WIDE) if i % 11 != 5]
    wide = " + ".join("(" + " + ".join(terms[i : i + 30]) + ")" for i in range(0, len(terms), 30))
    sql["l2_ols_predict_wide"] = f"""WITH {PANEL}, w AS (SELECT *, CAST(id AS BIGINT) AS n FROM panel)
        SELECT id, {r6(f'0.25 + {wide}')} AS prediction FROM w"""
    sql["l7_evaluate_split"] = query(*EVALUATED, select=metric_rows("val", "_val"))
    both = metric_rows("val", "_val") + " UNION ALL " + metric_rows("test", "_test")
    sql["l8_cached_evaluation"] = query(*EVALUATED, select=both)
    sql["l8_refit_run"] = sql["l8_cached_evaluation"]
    sql["l9_model_reload"] = query(*SCORED, select=predicted + " WHERE era >= 26 AND era < 31")
    sql["l10_populate_metrics"] = sql["l8_cached_evaluation"]
    sql["l11_best_run"] = query(
        PANEL, *score_ctes("panel", "preds_0", tag="_a"), *score_ctes("panel", "preds_1", tag="_b"),
        *score_ctes("panel", "meta", tag="_c"),
        "runs AS (SELECT 'preds_0' AS run_id, avg(corr) AS value FROM scores_a UNION ALL SELECT 'preds_1',"
        " avg(corr) FROM scores_b UNION ALL SELECT 'meta', avg(corr) FROM scores_c)",
        select=f"SELECT * FROM (SELECT 'max' AS mode, run_id, {r6('value')} AS value FROM runs"
        f" ORDER BY runs.value DESC LIMIT 1) UNION ALL SELECT * FROM (SELECT 'min', run_id, {r6('value')}"
        " FROM runs ORDER BY runs.value LIMIT 1)",
    )
    monitored = f"SELECT split, metric, value, metric = 'payoff' AS is_monitor FROM ({both})"
    sql["l12_train_job"] = query(*EVALUATED, select=monitored)
    sql["l13_result_record"] = query(
        *both_splits,
        select="SELECT split, metric, value, metric = 'corr' AS is_monitor FROM ("
        + metric_rows("val", "_val") + " UNION ALL " + metric_rows("test", "_test") + ")",
    )
    sql["l14_live_predictions"] = query(*SCORED, select=predicted + " WHERE era = 30")
    sql["l15_splits"] = query(
        PANEL,
        select=" UNION ALL ".join(
            f"SELECT '{s}' AS split, count(*) AS n, {r6('sum(CAST(target AS DOUBLE))', 4)} AS target FROM panel"
            f" WHERE era >= {a} AND era < {b}"
            for s, a, b in (("train", 1, 17), ("val", 18, 26), ("test", 26, 31))
        ),
    )

    # elimination by t-values
    beta = ", ".join(
        f"b{i + 1}_0 * ({c} - (SELECT avg(CAST({c} AS DOUBLE)) FROM panel WHERE era BETWEEN 19 AND 26)) AS a{i}" for i, c in enumerate(EVENT_FEATURES)
    )
    sql["f13_normal_equations"] = query(
        PANEL, *ols_ctes("panel", EVENT_FEATURES, where="era < 17"),
        f"attributed AS MATERIALIZED (SELECT {beta}, CAST(target AS DOUBLE) AS target FROM panel, fit WHERE era BETWEEN 19 AND 26)",
        *elimination_ctes("attributed", [f"a{i}" for i in range(len(EVENT_FEATURES))]),
        select=f"SELECT CAST(k AS INTEGER) AS pos, {named('k', EVENT_FEATURES)} AS feature, {r6('beta')} AS coefficient,"
        f" {r6('t')} AS t_value, CAST(dropped_at AS INTEGER) AS dropped_at FROM report",
    )
    sql["p15_subsample"] = query(
        PANEL, "placed AS (SELECT event_id, ('0x' || substr(md5('42:' || era || ':' || id), 1, 8))::BIGINT / 4294967296.0 AS place FROM panel)",
        select=" UNION ALL ".join(
            f"SELECT '{f}' AS fraction, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM placed WHERE place < {1 if f is None else f}"
            for f in (None, 0.0, 0.05, 0.25)
        ),
    )
    wide_columns = ", ".join(f"(event_id * {i + 1} + feature_b) % 7 AS x{i}" for i in range(WIDE))
    sql["a13_gram_wide"] = query(
        PANEL, f"wide AS (SELECT {wide_columns} FROM panel)",
        f"added AS MATERIALIZED (SELECT *, {' + '.join(f'x{i}' for i in range(WIDE))} AS s FROM wide)",
        "sums AS (SELECT [" + ", ".join(f"sum(x{i} * s)" for i in range(WIDE)) + "] AS p, ["
        + ", ".join(f"sum(x{i} * x{i})" for i in range(WIDE)) + "] AS q FROM added)",
        select=f"SELECT unnest(range({WIDE}))::INTEGER AS i, unnest(p)::DOUBLE AS products, unnest(q)::DOUBLE AS squares FROM sums",
    )

    # boosted trees
    few = histogram_trees(EVENT_FEATURES, preset="small", rounds=4, depth=3, rate=0.3, column_fraction=0.4)
    event_trees = [PANEL, *tree_ctes("panel", EVENT_FEATURES, "era < 17", few)]
    sql["l4_tree_table"] = query(
        *event_trees,
        select="SELECT CAST(tree AS INTEGER) AS tree, CAST(node AS INTEGER) AS node, feature, CAST(threshold AS INTEGER) AS threshold,"
        f" {r6('value')} AS value, {r6('gain')} AS gain, CAST(rows AS BIGINT) AS rows FROM nodes"
        f" UNION ALL SELECT -1, 0, NULL, NULL, {r6('avg(CAST(target AS DOUBLE))')}, 0.0, 0 FROM panel WHERE era < 17",
    )
    sql["l4_tree_scores"] = query(
        *event_trees, select=f"SELECT era, count(*) AS n, {r6('avg(p)')} AS prediction, {r6('avg((y - p) * (y - p))')} AS error FROM grown GROUP BY era"
    )
    presets = {name: histogram_trees(LINE_FEATURES, preset=name, rounds=3, column_fraction=0.6) for name in ("small", "large", "deep")}
    sql["l4_tree_presets"] = query(
        LINES, "early AS (SELECT * FROM lines WHERE era < 40)",
        *[c for name, trees in presets.items() for c in tree_ctes("early", LINE_FEATURES, "TRUE", trees, f"_{name}")],
        select=" UNION ALL ".join(
            f"SELECT '{name}' AS preset, CAST(tree AS INTEGER) AS tree, CAST(sum(rows) AS BIGINT) AS rows, {r6('sum(value)', 9)} AS value, count(*) AS leaves"
            f" FROM nodes_{name} WHERE feature IS NULL GROUP BY tree"
            for name in presets
        ),
    )

    # sort, limit, top-k
    sql["t1_first_n_features"] = sql["s9_selected_sink"]
    sql["t2_argmax"] = query(
        *event_info, select=f"SELECT f, {r6('rel', 9)} AS mi FROM rel ORDER BY rel DESC, f LIMIT 1"
    )
    sql["t3_order_to_list"] = query(
        *event_info, *all_greedy,
        select=" UNION ALL ".join(
            f"SELECT '{m}' AS method, string_agg({named('f', EVENT_FEATURES)}, ',' ORDER BY pos) AS features"
            f" FROM {m.lower()}_picks"
            for m in methods
        ),
    )
    sql["t4_selected_filter"] = query(
        *event_info,
        select=f"SELECT f AS pos, {named('f', EVENT_FEATURES)} AS feature FROM rel"
        " WHERE rel > (SELECT avg(rel) FROM rel)",
    )

    # streams end in the same tables as batches
    upper = "SELECT * FROM xxy WHERE f1 <= f2"
    sql["r1_streaming_counts"] = query(*event_pairs, select=upper)
    sql["r1_accumulated_counts"] = query(*event_pairs, select=upper)
    sql["r2_streaming_corr"] = query(*scores, select=f"SELECT era, {r6('corr')} AS corr FROM scores")
    # by the time that the third batch comes, era 20 has closed the eras below 17
    admitted = """admitted AS (SELECT * FROM panel WHERE (era <= 10 AND event_id % 2 = 0) OR (era BETWEEN 8 AND 20 AND event_id % 2 = 1)
      OR (era >= 17 AND event_id % 2 = 0))"""
    sql["r2_closing_eras"] = query(PANEL, admitted, *score_ctes("admitted"), select=f"SELECT era, n, {r6('corr')} AS corr FROM scores")
    sql["r3_streaming_mmc"] = query(*scores, select=f"SELECT era, {r6('mmc')} AS mmc FROM scores")
    sql["r4_streaming_payoff"] = query(*scores, select=f"SELECT era, {r6('payoff')} AS payoff FROM scores")
    sql["r5_streaming_annual_return"] = query(*scores, select=f"SELECT {r6(ANNUAL, 4)} AS annual_return FROM scores")
    sql["r6_metric_bundle"] = query(
        *both_splits,
        select=" UNION ALL ".join(
            metric_rows(split, f"_{split}")
            + f" UNION ALL SELECT '{split}', 'annual_return', {r6(ANNUAL)} FROM scores_{split}"
            for split in ("val", "test")
        ),
    )

    # user functions
    pearson = "covar_pop(t, p) / (stddev_pop(t) * stddev_pop(p))"
    plain = [*scores[:3]]
    sql["u1_user_score"] = query(*plain, select=f"SELECT era, {r6(pearson)} AS pearson FROM normals GROUP BY era")
    sql["u1_user_score_arrays"] = sql["u1_user_score"]
    sql["u1_user_score_mergeable"] = sql["u1_user_score"]
    sql["u1_user_score_meta"] = query(*plain, select=f"SELECT era, {r6('avg(raw * p) + avg(t)')} AS shared FROM normals GROUP BY era")
    sql["u1_user_score_meta_arrays"] = sql["u1_user_score_meta"]
    sql["u1_user_score_compounded"] = query(
        *plain, f"per_era AS (SELECT {pearson} AS payoff FROM normals GROUP BY era)",
        select=f"SELECT {r6(f'ln(1 + ({ANNUAL}))')} AS log_return FROM per_era",
    )
    weights = " + ".join(f"{i + 1} * {c}" for i, c in enumerate(EVENT_FEATURES))
    sql["u2_user_model"] = query(PANEL, select=f"SELECT id, CAST({weights} AS DOUBLE) AS prediction FROM panel")
    sql["u3_user_strategy"] = query(
        PANEL,
        "cov AS (" + " UNION ALL ".join(
            f"SELECT {i} AS f, '{c}' AS feature, covar_pop({c}, target) AS c FROM panel"
            for i, c in enumerate(EVENT_FEATURES)
        ) + ")",
        select="SELECT CAST(row_number() OVER (ORDER BY c DESC, f) - 1 AS INTEGER) AS pos, feature FROM cov WHERE c > 0",
    )
    return sql
