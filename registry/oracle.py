"""DuckDB statements giving the same rows as the registered queries."""

from __future__ import annotations

from registry.boosting_sql import Growth
from registry.fixtures import CODES, LINE_COLUMNS, MODELS, STRATEGIES

SEED = 42
FEATURES = ("acctbal", "totalprice", "order_days", "prio_2", "prio_3", "prio_4", "near")
NUMERIC = FEATURES[:3]
CUST = ("acctbal", "spend", "zone_1", "zone_2", "zone_3", "near")
COUNTS = ("tn", "fp", "fn", "tp")


# ---- expressions -------------------------------------------------------------

def h(stream: str, *keys: str) -> str:
    return "md5(concat_ws('|', " + ", ".join([f"'{SEED}|{stream}'", *[f"CAST({k} AS VARCHAR)" for k in keys]]) + "))"


def u(stream: str, *keys: str) -> str:
    return f"(CAST('0x' || substr({h(stream, *keys)}, 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE))"


def pick(stream: str, n: str, *keys: str) -> str:
    return f"CAST(floor({u(stream, *keys)} * {n}) AS BIGINT)"


def r(expr: str, name: str | None = None, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0::DOUBLE AS {name or expr}"


def big(expr: str, name: str | None = None) -> str:
    return f"CAST({expr} AS BIGINT) AS {name or expr}"


def cohort(value: str, low: str, high: str) -> str:
    return (
        f"CASE WHEN {value} < {low} THEN 'Low' WHEN {value} <= {high} THEN 'Middle'"
        f" WHEN {value} > {high} THEN 'High' ELSE 'Unknown' END"
    )


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# ---- fixtures ----------------------------------------------------------------

ORD = f"""ord AS (
  SELECT o_orderkey AS row_id, c_acctbal AS acctbal, o_totalprice AS totalprice,
         CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS order_days,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS prio,
         CAST(c_nationkey < 12 AS INTEGER) AS near,
         CAST(o_orderstatus = 'P' AS INTEGER) AS label,
         {cohort('c_acctbal', '2000.0', '7000.0')} AS cohort
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

CUS = f"""cus AS (
  SELECT c_custkey AS row_id, round(c_acctbal, 2) / 1000 AS acctbal,
         round(round(coalesce(total, 0), 2), 0) / 1000000 AS spend,
         CAST(CASE WHEN c_nationkey % 4 = 1 THEN 1 ELSE 0 END AS DOUBLE) AS zone_1,
         CAST(CASE WHEN c_nationkey % 4 = 2 THEN 1 ELSE 0 END AS DOUBLE) AS zone_2,
         CAST(CASE WHEN c_nationkey % 4 = 3 THEN 1 ELSE 0 END AS DOUBLE) AS zone_3,
         CAST(CASE WHEN c_nationkey < 12 THEN 1 ELSE 0 END AS DOUBLE) AS near,
         CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS label,
         {cohort('round(c_acctbal, 2) / 1000', '2.0', '7.0')} AS cohort
  FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1) ON c_custkey = o_custkey)"""

VEC = """vec AS (
  SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS x, CAST(label < 5 AS INTEGER) AS label, label AS digit
  FROM embeddings)"""

TXT = "txt AS (SELECT l.doc_id AS row_id, 1 - quality AS label FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"

SCORE = f"""score AS (
  SELECT row_id, cohort, label, probability, CAST(probability >= 0.5 AS INTEGER) AS prediction
  FROM (SELECT *, round({u('score', 'row_id')}, 2) AS probability FROM ord))"""

RUNS = (
    "runs AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{m}', '{m.upper()}', '{s}')" for m in MODELS for s in STRATEGIES)
    + ") AS t(model_key, model_name, strategy))"
)
VARIANTS = f"""score AS (
  SELECT *, CAST(probability >= 0.5 AS INTEGER) AS prediction FROM (
    SELECT row_id, cohort, label, model_key, model_name, strategy,
           round({u('score', 'model_key', 'strategy', 'row_id')}, 2) AS probability
    FROM ord CROSS JOIN runs))"""


def split(source: str, prefix: str = "", out: str = "sides") -> list[str]:
    """Exact stratified split of ``source`` into rows marked train or test."""
    p = prefix
    return [
        f"{p}per AS (SELECT label, count(*) AS c FROM {source} GROUP BY label)",
        f"{p}tot AS (SELECT sum(c) AS n, sum(c) - CAST(ceil(0.3::DOUBLE * sum(c)) AS BIGINT) AS nt FROM {p}per)",
        f"{p}share AS (SELECT label, c, nt, (nt * c) // n AS base, (nt * c) % n AS frac FROM {p}per, {p}tot)",
        f"""{p}quota AS (SELECT label, c - base - CAST(row_number() OVER (ORDER BY frac DESC, label)
               <= max(nt) OVER () - sum(base) OVER () AS INTEGER) AS q FROM {p}share)""",
        f"""{out} AS (SELECT s.*, CASE WHEN rk <= q THEN 'test' ELSE 'train' END AS side FROM (
               SELECT *, row_number() OVER (PARTITION BY label ORDER BY {h('split', 'row_id')}) AS rk FROM {source}) s
               JOIN {p}quota USING (label))""",
    ]


CLEAN = """cl AS (
  SELECT min(row_id) AS row_id, acctbal, totalprice, order_days, prio, near, label, any_value(cohort) AS cohort
  FROM ord GROUP BY acctbal, totalprice, order_days, prio, near, label)"""

STATS = (
    "st AS (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}" for c in NUMERIC)
    + " FROM sides WHERE side = 'train')"
)
PROCESSED = (
    "pr AS (SELECT row_id, side, label, cohort, "
    + ", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in NUMERIC)
    + ", "
    + ", ".join(f"CAST(CASE WHEN prio = {k} THEN 1 ELSE 0 END AS DOUBLE) AS prio_{k}" for k in (2, 3, 4))
    + ", CAST(near AS DOUBLE) AS near FROM sides, st)"
)
PREPARE = [ORD, CLEAN, *split("cl"), STATS, PROCESSED]


def side_rows(side: str) -> str:
    return with_(*PREPARE) + (
        "SELECT row_id, " + ", ".join(r(c) for c in FEATURES) + f", label, cohort FROM pr WHERE side = '{side}'"
    )


# ---- neighbours, SMOTE, augmentation -----------------------------------------

def euclid(features) -> str:
    return "sqrt(" + " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in features) + ")"


LIST_DISTANCE = "sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"


def knn(source: str, distance: str, k: str, out: str = "knn", asked: str | None = None, same: bool = False) -> str:
    other = "" if same else "WHERE a.row_id <> b.row_id"
    return f"""{out} AS (
  SELECT * FROM (
    SELECT query, neighbor, distance, row_number() OVER (PARTITION BY query ORDER BY distance, neighbor) AS rank
    FROM (SELECT a.row_id AS query, b.row_id AS neighbor, {distance} AS distance
          FROM {asked or source} a CROSS JOIN {source} b {other}))
  WHERE rank <= {k})"""


NEIGHBORS = "SELECT query, CAST(rank AS INTEGER) AS rank, neighbor, " + r("distance") + " FROM knn"


def smote(source: str, features, numeric, groups, binary, out: str = "balanced", p: str = "") -> list[str]:
    """CTEs growing the smaller class of ``source``; k is 5 or what is there."""
    mixed = [f"a.{c} + gap * (b.{c} - a.{c}) AS {c}" for c in numeric]
    mixed += [f"CASE WHEN {u('smote-' + c, 'id')} < 0.5 THEN a.{c} ELSE b.{c} END AS {c}" for c in binary]
    for names in groups:
        mixed += [f"CASE WHEN {u('smote-' + names[0], 'id')} < 0.5 THEN a.{c} ELSE b.{c} END AS {c}" for c in names]
    columns = ", ".join(features)
    return [
        f"""{p}cnt AS (SELECT sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS n0,
               sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS n1, max(row_id) AS last FROM {source})""",
        f"""{p}need AS (SELECT CASE WHEN n0 < n1 THEN 0 ELSE 1 END AS minority, abs(n0 - n1) AS needed,
               least(n0, n1) AS size, least(5, least(n0, n1) - 1) AS k, last FROM {p}cnt)""",
        f"""{p}mem AS (SELECT s.*, row_number() OVER (ORDER BY {h('member', 'row_id')}) - 1 AS number
               FROM {source} s, {p}need WHERE label = minority)""",
        knn(f"{p}mem", euclid(features), f"(SELECT k FROM {p}need)", f"{p}near"),
        f"""{p}slot AS (SELECT id, {pick('anchor', 'size', 'id')} AS number, {pick('neighbor', 'k', 'id')} + 1 AS rank,
               {u('gap', 'id')} AS gap, last, minority
               FROM (SELECT unnest(range(CAST(needed AS BIGINT))) AS id, * FROM {p}need))""",
        f"""{p}made AS (SELECT last + 1 + id AS row_id, {', '.join(mixed)}, minority AS label
               FROM {p}slot s JOIN {p}mem a USING (number)
               JOIN {p}near n ON n.query = a.row_id AND n.rank = s.rank JOIN {p}mem b ON b.row_id = n.neighbor)""",
        f"""{out} AS (SELECT row_id, {columns}, label FROM {source}
               UNION ALL SELECT row_id, {columns}, label FROM {p}made)""",
    ]


ZONES = ("zone_1", "zone_2", "zone_3")
CUST_SMOTE = dict(features=CUST, numeric=("acctbal", "spend"), groups=[ZONES], binary=("near",))


def augment(times: int, high: str = "7.0") -> str:
    """Grow ``cus`` to ``times`` its rows by interpolation inside (label, cohort)."""
    mixed = [f"a.spend + {u('alpha', 'id')} * (b.spend - a.spend) AS spend",
             f"CASE WHEN {u('mix-near', 'id')} < 0.5 THEN a.near ELSE b.near END AS near"]
    mixed += [f"CASE WHEN {u('mix-zone_1', 'id')} < 0.5 THEN a.{c} ELSE b.{c} END AS {c}" for c in ZONES]
    return with_(
        CUS,
        f"lim AS (SELECT {high} AS hi)",
        f"src AS (SELECT cus.* EXCLUDE (cohort), {cohort('acctbal', '2.0', 'hi')} AS cohort FROM cus, lim)",
        "ext AS (SELECT min(acctbal) AS lowest, max(acctbal) AS highest, max(row_id) AS last, count(*) AS n FROM src)",
        """grid AS (SELECT g, label, cohort, lo, hi FROM (VALUES
             (0, 0, 'Low'), (1, 0, 'Middle'), (2, 0, 'High'), (3, 1, 'Low'), (4, 1, 'Middle'), (5, 1, 'High')) t(g, label, cohort)
             JOIN (SELECT 'Low' AS cohort, lowest AS lo, 2.0::DOUBLE AS hi FROM ext
                   UNION ALL SELECT 'Middle', 2.0, hi FROM lim
                   UNION ALL SELECT 'High', lim.hi, highest FROM lim, ext) USING (cohort))""",
        "wt AS (SELECT grid.*, coalesce(w, 0) AS w FROM grid LEFT JOIN (SELECT label, cohort, count(*) AS w FROM src GROUP BY ALL) USING (label, cohort))",
        f"""sh AS (SELECT wt.*, need, (need * w) // total AS base, (need * w) % total AS frac
             FROM wt, (SELECT sum(w) AS total FROM wt), (SELECT {times - 1} * n AS need FROM ext))""",
        """qt AS (SELECT *, base + CAST(row_number() OVER (ORDER BY frac DESC, g) <= need - sum(base) OVER () AS INTEGER) AS q,
             CASE WHEN w < 2 THEN label || '/*' ELSE label || '/' || cohort END AS pool FROM sh)""",
        "rng AS (SELECT *, sum(q) OVER (ORDER BY g) - q AS first, sum(q) OVER (ORDER BY g) AS past FROM qt)",
        """par AS (SELECT src.*, label || '/' || cohort AS pool FROM src UNION ALL SELECT src.*, label || '/*' FROM src)""",
        f"""num AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY {h('parent', 'row_id')}) - 1 AS number,
             count(*) OVER (PARTITION BY pool) AS size FROM par)""",
        "sizes AS (SELECT pool, count(*) AS size FROM par GROUP BY pool)",
        f"""slot AS (SELECT id, label, cohort, lo, hi, pool, {pick('parent-a', 'size', 'id')} AS na, {pick('parent-b', 'size', 'id')} AS nb
             FROM (SELECT CAST(unnest(range(CAST(first AS BIGINT), CAST(past AS BIGINT))) AS BIGINT) AS id, * FROM rng)
             JOIN sizes USING (pool))""",
        f"""made AS (SELECT last + 1 + id AS row_id, s.lo + {u('extent', 'id')} * (s.hi - s.lo) AS acctbal,
             {', '.join(mixed)}, s.label AS label
             FROM ext, slot s JOIN num a ON a.pool = s.pool AND a.number = s.na
             JOIN num b ON b.pool = s.pool AND b.number = s.nb)""",
    ) + " UNION ALL ".join(
        f"SELECT row_id, {', '.join(r(c) for c in CUST)}, CAST(label AS INTEGER) AS label FROM {t}" for t in ("src", "made")
    )


# ---- naive Bayes -------------------------------------------------------------

def naive_bayes(train: str, test: str, features, out: str = "nb", p: str = "") -> list[str]:
    """Gaussian naive Bayes fitted on ``train``, scoring ``test``."""
    moments = ", ".join(f"avg({c}) AS m_{c}, var_pop({c}) AS v_{c}" for c in features)
    spread = ", ".join(f"var_pop({c})" for c in features)
    like = " + ".join(
        f"ln(2 * pi() * (v_{c} + eps)) / 2 + ({c} - m_{c}) * ({c} - m_{c}) / (2 * (v_{c} + eps))" for c in features
    )
    return [
        f"{p}eps AS (SELECT 1e-9::DOUBLE * greatest({spread}) AS eps, count(*) AS n FROM {train})",
        f"{p}par AS (SELECT label AS k, count(*) AS c, {moments} FROM {train} GROUP BY label)",
        f"""{p}lik AS (SELECT t.row_id, k, ln(c / CAST(n AS DOUBLE)) - ({like}) AS l
               FROM {test} t, {p}par, {p}eps)""",
        f"""{out} AS (SELECT t.row_id, t.label, t.cohort, CAST(o > 0 AS INTEGER) AS prediction, 1 / (1 + exp(-o)) AS probability
               FROM {test} t JOIN (SELECT row_id, sum(CASE WHEN k = 1 THEN l ELSE -l END) AS o FROM {p}lik GROUP BY row_id) USING (row_id))""",
    ]


NB = [*PREPARE, "tr AS (SELECT * FROM pr WHERE side = 'train')", "te AS (SELECT * FROM pr WHERE side = 'test')"]
NB_ALL = [*NB, *naive_bayes("tr", "te", FEATURES)]
SCORES = "SELECT row_id, label, prediction, " + r("probability") + " FROM nb"
COHORT_SCORES = "SELECT row_id, cohort, label, prediction, " + r("probability") + " FROM "


def per_cohort(names=("Low", "Middle", "High"), rest: str | None = None, out: str = "special", train: str = "tr") -> list[str]:
    """One naive Bayes per cohort, the common model for the other rows."""
    parts, ctes = [], []
    for name in names:
        p = name.lower() + "_"
        ctes += [
            f"{p}tr AS (SELECT * FROM {train} WHERE cohort = '{name}')",
            f"{p}te AS (SELECT * FROM te WHERE cohort = '{name}')",
            *naive_bayes(f"{p}tr", f"{p}te", FEATURES, f"{p}nb", p),
        ]
        parts.append(f"SELECT * FROM {p}nb")
    if rest:
        parts.append(f"SELECT * FROM nb WHERE cohort NOT IN ({', '.join(repr(n) for n in names)})")
    return [*ctes, f"{out} AS ({' UNION ALL '.join(parts)})"]


# ---- metrics -----------------------------------------------------------------

CELLS = (
    "count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) FILTER (label = 0 AND prediction = 1) AS fp, "
    "count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 1 AND prediction = 1) AS tp"
)
RATIOS = {
    "accuracy": "(tn + tp) / (tn + fp + fn + tp)::DOUBLE",
    "precision": "coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0)",
    "recall": "coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0)",
    "f1": "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0)",
}


def quoted(name: str) -> str:
    return f'"{name}"'


def ranking(source: str, keys: str, out: str = "auc", p: str = "") -> list[str]:
    return [
        f"""{p}pt AS (SELECT {keys}, probability, sum(label) AS tp, sum(1 - label) AS fp FROM {source} GROUP BY {keys}, probability)""",
        f"""{p}cum AS (SELECT *, sum(tp) OVER w AS ctp, sum(fp) OVER w AS cfp FROM {p}pt
              WINDOW w AS (PARTITION BY {keys} ORDER BY probability DESC))""",
        f"""{out} AS (SELECT {keys},
              CASE WHEN sum(tp) > 0 AND sum(fp) > 0 THEN sum(fp * (ctp - tp / 2.0::DOUBLE)) / (sum(tp)::DOUBLE * sum(fp)) END AS roc_auc,
              CASE WHEN sum(tp) > 0 AND sum(fp) > 0 THEN sum(tp * (ctp / (ctp + cfp)::DOUBLE)) / sum(tp) END AS pr_auc
              FROM {p}cum GROUP BY {keys})""",
    ]


def report(source: str, scopes, keys: str = "", out: str = "rep") -> list[str]:
    """Metric rows per (keys, scope); scopes without rows are there too."""
    head = keys + ", " if keys else ""
    joined = ", ".join([*(k.strip() for k in keys.split(",") if k.strip()), "scope"])
    grid = "(SELECT * FROM (VALUES " + ", ".join(f"({i}, '{s}')" for i, s in enumerate(scopes)) + ") t(position, scope))"
    if keys:
        grid = f"(SELECT * FROM (SELECT DISTINCT {keys} FROM {source}), {grid})"
    return [
        f"sc AS (SELECT *, 'overall' AS scope FROM {source} UNION ALL SELECT *, cohort AS scope FROM {source})",
        f"cells AS (SELECT {head}scope, {CELLS} FROM sc GROUP BY {head}scope)",
        *ranking("sc", f"{head}scope"),
        f"""{out} AS (SELECT {head}position, scope, {', '.join(f'{e} AS {quoted(n)}' for n, e in RATIOS.items())}, roc_auc, pr_auc,
              {', '.join(f'CAST(coalesce({c}, 0) AS BIGINT) AS {c}' for c in COUNTS)},
              tn IS NULL AS empty_scope
              FROM {grid} LEFT JOIN cells USING ({joined}) LEFT JOIN auc USING ({joined}))""",
    ]


METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc")
VALUES = {m: (f'CASE WHEN NOT empty_scope THEN {quoted(m)} END') for m in METRICS}
METRIC_ROW = ", ".join([*(r(VALUES[m], quoted(m)) for m in METRICS), *COUNTS])
SCOPES = ("overall", "Low", "Middle", "High")
LONG = " UNION ALL ".join(f"SELECT scope, '{m}' AS metric, {VALUES[m]} AS value FROM rep" for m in METRICS)

SUMMARY_METRICS = ("accuracy", "roc_auc", "pr_auc", "recall", "f1")
KEYS = "model_key, model_name, strategy"
SUMMARY = [
    ORD, RUNS, VARIANTS, *report("score", ("overall",), KEYS),
    "summary AS (SELECT model_key, model_name, "
    + ", ".join(f"max({m}) FILTER (strategy = '{s}') AS {s}_{m}" for s in STRATEGIES for m in SUMMARY_METRICS)
    + " FROM rep GROUP BY model_key, model_name)",
]


def winner(a: str, b: str, first: str, second: str) -> str:
    return (
        f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN 'N/A' WHEN {b} > {a} THEN '{second}'"
        f" WHEN {a} > {b} THEN '{first}' ELSE 'Tie' END"
    )


def two_reports(a: str, b: str) -> str:
    """Side by side table of the long reports ``a`` and ``b``."""
    return f"""SELECT scope, metric, {r('a.value', 'value_a')}, {r('b.value', 'value_b')}, {r('b.value - a.value', 'delta')},
      {winner('a.value', 'b.value', 'Without SMOTE', 'With SMOTE')} AS winner
      FROM ({a}) a JOIN ({b}) b USING (scope, metric) WHERE scope = 'overall' OR metric <> 'precision'"""


# ---- sampling infos ----------------------------------------------------------

INFOS = """info AS (
  SELECT cohort AS scope, sum(1 - label) AS n0, sum(label) AS n1, greatest(sum(1 - label), sum(label)) AS big,
         least(sum(1 - label), sum(label)) AS small
  FROM cus GROUP BY cohort)"""

ORACLE: dict[str, str] = {
    "scan_orders": "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders",
    "cohort_split": with_(ORD) + f"SELECT cohort, count(*) AS n, {r('sum(totalprice)', 'total', 2)} FROM ord GROUP BY cohort",
    "results_json": with_(ORD) + """SELECT CAST('{"cohort":"' || cohort || '","counts":{"0":' || sum(1 - label) || ',"1":' || sum(label)
        || '},"pair":[' || sum(1 - label) || ',' || sum(label) || '],"roc_auc":null}' AS VARCHAR) AS json FROM ord GROUP BY cohort""",
    "dedup_rows": with_(ORD) + "SELECT DISTINCT acctbal, totalprice, order_days, prio, near, label FROM ord",
    "dedup_keyed": with_(ORD) + """SELECT min(row_id) AS row_id, acctbal, totalprice, order_days, prio, near, label
        FROM ord GROUP BY acctbal, totalprice, order_days, prio, near, label""",
    "drop_sentinel": with_(ORD) + "SELECT row_id, nullif(prio, 4) AS prio FROM ord WHERE nullif(prio, 4) IS DISTINCT FROM 5",
    "cohort_raw": with_(ORD) + "SELECT row_id, cohort FROM ord",
    "cohort_scaled": with_(ORD, "s AS (SELECT avg(acctbal) AS m, stddev_pop(acctbal) AS d FROM ord)")
    + f"SELECT row_id, {cohort('(acctbal - m) / d', '((2000 - m) / d)', '((7000 - m) / d)')} AS cohort FROM ord, s",
    "scaler_fit": with_(ORD) + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {r(f'avg({c})', 'mean')}, {r(f'stddev_pop({c})', 'std')} FROM ord""" for c in NUMERIC
    ),
    "scaler_apply": with_(ORD, "s AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in NUMERIC) + " FROM ord)")
    + "SELECT row_id, " + ", ".join(r(f"({c} - m_{c}) / s_{c}", c) for c in NUMERIC) + " FROM ord, s",
    "one_hot": with_(ORD) + "SELECT row_id, " + ", ".join(
        f"CAST(CASE WHEN prio = {k} THEN 1 ELSE 0 END AS DOUBLE) AS prio_{k}" for k in (2, 3, 4)) + " FROM ord",
    "scaled_cutoffs": with_(*PREPARE) + f"""SELECT {r('(2000 - m_acctbal) / s_acctbal', 'low')}, {r('(7000 - m_acctbal) / s_acctbal', 'high')},
        {r('m_acctbal', 'mean')}, {r('s_acctbal', 'std')} FROM st""",
    "preprocess_train": side_rows("train"),
    "prepare_test_side": side_rows("test"),
    "stratified_split": with_(ORD, *split("ord")) + "SELECT row_id, label, side FROM sides",
    "stratified_split_texts": with_(TXT, *split("txt")) + "SELECT row_id, label, side FROM sides",
    "allocate_counts": with_(
        ORD, "w AS (SELECT label, cohort, count(*) AS weight FROM ord GROUP BY ALL)",
        "s AS (SELECT *, (100000 * weight) // sum(weight) OVER () AS base, (100000 * weight) % sum(weight) OVER () AS frac FROM w)",
    ) + f"""SELECT label, cohort, weight, {big('''base + CAST(row_number() OVER (ORDER BY frac DESC, label,
          CASE cohort WHEN 'Low' THEN 0 WHEN 'Middle' THEN 1 ELSE 2 END) <= 100000 - sum(base) OVER () AS INTEGER)''', 'quota')} FROM s""",
    "number_members": with_(ORD) + f"SELECT row_id, cohort, row_number() OVER (PARTITION BY cohort ORDER BY {h('member', 'row_id')}) - 1 AS number FROM ord",
    "augment_rows": augment(3),
    "augment_sparse_pool": augment(4, "(SELECT DISTINCT acctbal FROM cus WHERE label = 1 ORDER BY 1 DESC LIMIT 1 OFFSET 1)"),
    "class_counts": with_(ORD) + f"SELECT cohort, {big('sum(1 - label)', 'class_0')}, {big('sum(label)', 'class_1')} FROM ord GROUP BY cohort",
    "knn_minority": with_(VEC, "rare AS (SELECT * FROM vec WHERE digit = 0)", knn("rare", LIST_DISTANCE, "5")) + NEIGHBORS,
    "knn_vectors": with_(VEC, knn("vec", LIST_DISTANCE, "5")) + NEIGHBORS,
    "knn_orders": with_(
        ORD, "rare AS (SELECT row_id, acctbal / 1000 AS x, totalprice / 50000 AS y, order_days / 250::DOUBLE AS z FROM ord WHERE label = 1)",
        knn("rare", euclid(("x", "y", "z")), "5"),
    ) + NEIGHBORS,
    "smote_rows": with_(CUS, *smote("cus", **CUST_SMOTE)) + "SELECT row_id, " + ", ".join(r(c) for c in CUST) + ", CAST(label AS INTEGER) AS label FROM balanced",
    "smote_info": with_(CUS, INFOS) + f"""SELECT scope, true AS applied, CAST(NULL AS VARCHAR) AS reason,
        CAST(CASE WHEN n0 < n1 THEN 0 ELSE 1 END AS INTEGER) AS minority_label, {big('n0', 'before_0')}, {big('n1', 'before_1')},
        {big('big', 'after_0')}, {big('big', 'after_1')}, {big('big - small', 'generated_samples')},
        CAST(least(5, small - 1) AS INTEGER) AS k_neighbors_used FROM info""",
    "smote_single_class": with_(ORD) + "SELECT label, count(*) AS n, false AS applied, 'single_class_train_data' AS reason FROM ord WHERE label = 1 GROUP BY label",
    "sampling_totals": with_(CUS, INFOS) + f"""SELECT {big('sum(n0)', 'before_0')}, {big('sum(n1)', 'before_1')},
        {big('sum(big)', 'after_0')}, {big('sum(big)', 'after_1')} FROM info""",
    "generated_rows": with_(CUS, INFOS) + f"""SELECT scope, {big('big - small', 'generated')} FROM info
        UNION ALL SELECT 'overall', CAST(sum(big - small) AS BIGINT) FROM info""",
    "score_gaussian_nb": with_(*NB_ALL) + SCORES,
    "fit_score_nb": with_(*NB_ALL) + SCORES,
    "fit_score_nb_smote": with_(
        CUS, *split("cus"), "tr AS (SELECT * FROM sides WHERE side = 'train')", "te AS (SELECT * FROM sides WHERE side = 'test')",
        *smote("tr", **CUST_SMOTE), *naive_bayes("balanced", "te", CUST, p="nb_"),
    ) + SCORES,
    "score_knn": with_(
        VEC, *split("vec"), "tr AS (SELECT * FROM sides WHERE side = 'train')", "te AS (SELECT * FROM sides WHERE side = 'test')",
        knn("tr", LIST_DISTANCE, "7", asked="te", same=True),
        """vote AS (SELECT query, coalesce(avg(CASE WHEN distance = 0 THEN label END),
             sum(CASE WHEN distance > 0 THEN label / distance END) / sum(CASE WHEN distance > 0 THEN 1 / distance END)) AS p
             FROM knn JOIN tr ON tr.row_id = neighbor GROUP BY query)""",
    ) + f"SELECT row_id, label, CAST(p > 0.5 AS INTEGER) AS prediction, {r('p', 'probability')} FROM te JOIN vote ON query = row_id",
    "specialist_nb": with_(*NB, *per_cohort()) + COHORT_SCORES + "special",
    "specialist_fallback_nb": with_(
        *NB, "cut AS (SELECT * FROM tr WHERE cohort <> 'Low' OR label = 0)", *naive_bayes("cut", "te", FEATURES),
        *per_cohort(("Middle", "High"), rest="nb", train="cut"),
    ) + COHORT_SCORES + "special",
    "sigmoid_fallback": with_(ORD, SCORE) + f"SELECT row_id, {r('1 / (1 + exp(-((probability - 0.5::DOUBLE) * 8)))', 'probability')} FROM score",
    "prevalence_fallback": with_(
        ORD, SCORE, f"gap AS (SELECT *, {u('lost', 'row_id')} < 0.05 AS filled FROM score)", "av AS (SELECT avg(label) AS share FROM ord)",
    ) + f"""SELECT row_id, CASE WHEN filled THEN CAST(share >= 0.5 AS INTEGER) ELSE prediction END AS prediction,
        {r('CASE WHEN filled THEN share ELSE probability END', 'probability')}, filled FROM gap, av""",
    "confusion_matrix": with_(ORD, SCORE) + f"SELECT cohort, {CELLS} FROM score GROUP BY cohort",
    "basic_metrics": with_(ORD, SCORE, f"c AS (SELECT cohort, {CELLS} FROM score GROUP BY cohort)")
    + "SELECT cohort, " + ", ".join(r(e, quoted(n)) for n, e in RATIOS.items()) + " FROM c",
    "roc_auc": with_(ORD, SCORE, *ranking("score", "cohort")) + f"SELECT cohort, {r('roc_auc')} FROM auc",
    "average_precision": with_(ORD, SCORE, *ranking("score", "cohort")) + f"SELECT cohort, {r('pr_auc')} FROM auc",
    "roc_auc_bucketed": with_(
        ORD, f"score AS (SELECT cohort, label, {u('fine', 'row_id')} AS probability FROM ord)", *ranking("score", "cohort"),
    ) + f"SELECT cohort, {r('roc_auc')} FROM auc",
    "metrics_by_cohort": with_(ORD, SCORE, *report("score", (*SCOPES, "Nobody"))) + f"SELECT position, scope, {METRIC_ROW} FROM rep",
    "nb_report": with_(*NB_ALL, *report("nb", SCOPES)) + f"SELECT position, scope, {METRIC_ROW} FROM rep",
    "wilson_interval": with_(
        ORD, SCORE, "w AS (SELECT cohort, count(*) FILTER (label = prediction) AS correct, count(*) AS total FROM score GROUP BY cohort)",
        "q AS (SELECT *, correct / total::DOUBLE AS p, 1.96::DOUBLE AS z FROM w)",
        """e AS (SELECT *, (p + z * z / (2 * total)) / (1 + z * z / total) AS mid,
             z * sqrt(p * (1 - p) / total + z * z / (4 * total * total)) / (1 + z * z / total) AS half FROM q)""",
    ) + f"SELECT cohort, correct, total, {r('mid - half', 'ci_low')}, {r('mid + half', 'ci_high')} FROM e",
    "correlation_matrix": " UNION ALL ".join(
        f"SELECT '{b}' AS row_name, '{a}' AS column_name, {r('max(NULL)' if 'constant' in (a, b) else f'corr({b}, {a})', 'correlation')} FROM lineitem"
        for i, a in enumerate((*LINE_COLUMNS, "constant")) for b in (*LINE_COLUMNS, "constant")[i + 1:]
    ),
    "cohort_counts": with_(ORD, "g AS (SELECT * FROM (VALUES (0, 'Low'), (1, 'Middle'), (2, 'High'), (3, 'Nobody')) a(position, cohort), (VALUES (0), (1)) b(label))")
    + "SELECT position, cohort, label, count(row_id) AS n FROM g LEFT JOIN ord USING (cohort, label) GROUP BY ALL",
    "frame_diff": with_(ORD) + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {big(e, 'mismatches')} FROM ord""" for c, e in {
            "acctbal": "sum(0)", "totalprice": "count(*) FILTER (prio = 1)", "order_days": "sum(0)", "prio": "sum(0)",
            "near": "count(*) FILTER (prio = 2)", "label": "sum(0)",
        }.items()
    ),
    "dataset_profile": with_(ORD, CLEAN, *split("cl")) + """SELECT side, count(*) AS "rows",
        count(*) FILTER (label = 0) AS class_0, count(*) FILTER (label = 1) AS class_1, count(*) FILTER (cohort = 'Low') AS cohort_low,
        count(*) FILTER (cohort = 'Middle') AS cohort_middle, count(*) FILTER (cohort = 'High') AS cohort_high FROM sides GROUP BY side""",
    "cross_model_summary": with_(*SUMMARY) + "SELECT model_key, model_name, "
    + ", ".join(r(f"{s}_{m}") for s in STRATEGIES for m in SUMMARY_METRICS) + ", "
    + ", ".join(r(f"age_specialist_{m} - baseline_{m}", f"delta_{m}") for m in SUMMARY_METRICS) + " FROM summary",
    "delta_matrix": with_(*SUMMARY) + " UNION ALL ".join(
        f"SELECT model_key, '{m}' AS metric, {r(f'age_specialist_{m} - baseline_{m}', 'delta')} FROM summary" for m in SUMMARY_METRICS),
    "metric_winner": with_(*SUMMARY) + " UNION ALL ".join(
        f"SELECT model_key, '{m}' AS metric, {winner(f'baseline_{m}', f'age_specialist_{m}', 'Baseline', 'Age-Specialist')} AS winner FROM summary"
        for m in SUMMARY_METRICS),
    "rank_models": with_(*SUMMARY) + f"""SELECT CAST(row_number() OVER (ORDER BY greatest(baseline_roc_auc, age_specialist_roc_auc) DESC, model_key) AS INTEGER) AS position,
        model_key, {r('greatest(baseline_roc_auc, age_specialist_roc_auc)', 'best')} FROM summary""",
    "compare_variants": with_(ORD, RUNS, VARIANTS, *report("score", SCOPES, KEYS)) + two_reports(*[
        " UNION ALL ".join(
            f"SELECT scope, '{m}' AS metric, {quoted(m)} AS value FROM rep WHERE model_key = 'm1' AND strategy = '{s}'" for m in METRICS)
        for s in STRATEGIES]),
    "metric_text": with_(ORD, SCORE, *report("score", (*SCOPES, "Nobody")), f"lng AS ({LONG})")
    + """SELECT scope, metric, coalesce(printf('%.4f', round(value, 9)), 'N/A') AS text,
        coalesce(printf('%+.4f', round(value - 0.5, 9)), 'N/A') AS delta FROM lng""",
    "feature_list_text": with_(ORD, "m AS (" + " UNION ALL ".join(f"SELECT '{c}' AS f, avg({c}) AS v FROM ord" for c in NUMERIC) + ")")
    + "SELECT 'overall' AS scope, string_agg(f, ', ' ORDER BY v DESC) AS features FROM m",
    "strategy_comparison_nb": with_(
        *NB_ALL, *per_cohort(),
        "score AS (SELECT 'naive_bayes' AS model_key, 'baseline' AS strategy, * FROM nb UNION ALL SELECT 'naive_bayes', 'age_specialist', * FROM special)",
        *report("score", SCOPES, "model_key, strategy"),
    ) + f"SELECT model_key, strategy, scope, {METRIC_ROW} FROM rep",
    "linear_attribution": with_(ORD) + " UNION ALL ".join(
        f"SELECT row_id, '{c}' AS feature, {r(f'{w} * ({c} - avg({c}) OVER ())', 'attribution')} FROM ord"
        for c, w in (("acctbal", "0.002::DOUBLE"), ("totalprice", "-0.0001::DOUBLE"), ("order_days", "0.01::DOUBLE"))),
    "attribution_importance": with_(ORD, "av AS (SELECT avg(acctbal) AS a, avg(totalprice) AS t, avg(order_days) AS d FROM ord)") + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {r(f'avg(abs({w} * ({c} - {m})))', 'importance', 4)} FROM ord, av"
        for c, w, m in (("acctbal", "0.002::DOUBLE", "a"), ("totalprice", "-0.0001::DOUBLE", "t"), ("order_days", "0.01::DOUBLE", "d"))),
    "column_kinds": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{k}' AS kind""" for c, k in {
            "prio_2": "group", "prio_3": "group", "prio_4": "group", "near": "binary"}.items()
    ),
}

KINDS = {c: f"CASE WHEN bool_and({e} IN (0, 1)) THEN 'binary' ELSE 'continuous' END" for c, e in {
    "acctbal": "acctbal", "totalprice": "totalprice", "order_days": "order_days",
    "pricey": "CAST(totalprice > 100000 AS INTEGER)"}.items()}
ORACLE["column_kinds"] = with_(ORD) + " UNION ALL ".join(
    [f"""SELECT '{c}' AS "column", {e} AS kind FROM ord""" for c, e in KINDS.items()]) + " UNION ALL " + ORACLE["column_kinds"]


def drawn(source: str, divisor: int, cte: list[str], columns: str) -> str:
    """Proportional draw without replacement of ``n // divisor`` rows."""
    return with_(
        *cte,
        f"w AS (SELECT label, cohort, count(*) AS c FROM {source} GROUP BY ALL)",
        f"s AS (SELECT *, ((sum(c) OVER () // {divisor}) * c) // sum(c) OVER () AS base, ((sum(c) OVER () // {divisor}) * c) % sum(c) OVER () AS frac, sum(c) OVER () // {divisor} AS total FROM w)",
        """q AS (SELECT label, cohort, base + CAST(row_number() OVER (ORDER BY frac DESC, label,
             CASE cohort WHEN 'Low' THEN 0 WHEN 'Middle' THEN 1 ELSE 2 END) <= total - sum(base) OVER () AS INTEGER) AS quota FROM s)""",
    ) + f"""SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY label, cohort ORDER BY {h('downsample', 'row_id')}) AS rk FROM {source})
        JOIN q USING (label, cohort) WHERE rk <= quota"""


ORACLE["downsample_exact"] = drawn("ord", 3, [ORD], "row_id, label, cohort")
ORACLE["resize_shrink"] = drawn("cus", 2, [CUS], "row_id, label")

# Both variants of the study fit one naive Bayes per cohort; the second balances first.
_study = [CUS, *split("cus"), "tr AS (SELECT * FROM sides WHERE side = 'train')", "te AS (SELECT * FROM sides WHERE side = 'test')"]
for _name in ("Low", "Middle", "High"):
    _p = _name.lower() + "_"
    _study += [
        f"{_p}tr AS (SELECT * FROM tr WHERE cohort = '{_name}')", f"{_p}te AS (SELECT * FROM te WHERE cohort = '{_name}')",
        *naive_bayes(f"{_p}tr", f"{_p}te", CUST, f"{_p}without", f"{_p}w_"),
        *smote(f"{_p}tr", **CUST_SMOTE, out=f"{_p}bal", p=f"{_p}s_"),
        *naive_bayes(f"{_p}bal", f"{_p}te", CUST, f"{_p}with", f"{_p}v_"),
    ]
_study.append("score AS (" + " UNION ALL ".join(
    f"SELECT '{v}' AS variant, * FROM {c}_{v}" for v in ("without", "with") for c in ("low", "middle", "high")) + ")")
ORACLE["smote_study"] = with_(*_study, *report("score", SCOPES, "variant")) + two_reports(*[
    " UNION ALL ".join(f"SELECT scope, '{m}' AS metric, {quoted(m)} AS value FROM rep WHERE variant = '{v}'" for m in METRICS)
    for v in ("without", "with")])

ORACLE["report_matrices"] = with_(*_study, *report("score", SCOPES, "variant")) + (
    f"SELECT CASE variant WHEN 'with' THEN 'WITH_SMOTE' ELSE 'WITHOUT_SMOTE' END AS variant, scope, {', '.join(COUNTS)} FROM rep")
_train_info = [
    CUS, *split("cus"),
    "info AS (SELECT cohort AS scope, abs(sum(1 - label) - sum(label)) AS gap, least(sum(1 - label), sum(label)) AS small"
    " FROM sides WHERE side = 'train' GROUP BY cohort)",
]
ORACLE["report_sampling"] = with_(*_train_info) + f"""
    SELECT 'WITH_SMOTE' AS variant, scope, true AS applied, CAST(NULL AS VARCHAR) AS reason, {big('gap', 'generated_samples')},
           CAST(least(5, small - 1) AS INTEGER) AS k_neighbors_used FROM info
    UNION ALL SELECT 'WITHOUT_SMOTE', scope, false, 'smote_disabled', 0, 0 FROM info"""

# Baseline and specialists, both balanced first.
_both = [
    *_study, *smote("tr", **CUST_SMOTE, out="all_bal", p="a_"), *naive_bayes("all_bal", "te", CUST, "all_nb", "an_"),
    "gaps AS (SELECT 'age_specialist' AS strategy, cohort AS scope, abs(sum(1 - label) - sum(label)) AS gap FROM tr GROUP BY cohort"
    " UNION ALL SELECT 'baseline', 'overall', abs(sum(1 - label) - sum(label)) FROM tr)",
    "two AS (SELECT 'baseline' AS strategy, * FROM all_nb UNION ALL"
    " SELECT 'age_specialist', * EXCLUDE (variant) FROM score WHERE variant = 'with')",
    "seen AS (SELECT *, 'overall' AS scope FROM two UNION ALL SELECT *, cohort AS scope FROM two)",
]
ORACLE["strategy_document_nb"] = with_(*_both) + f"""
    SELECT 'naive_bayes' AS model_key, strategy, scope, test_rows, accuracy, {big('gap', 'generated_samples')},
           CASE WHEN gap IS NOT NULL THEN 'applied' END AS status,
           CASE WHEN gap IS NOT NULL THEN '{", ".join(CUST)}' ELSE '' END AS features
    FROM (SELECT strategy, scope, count(*) AS test_rows, {r('avg(CAST(label = prediction AS INTEGER))', 'accuracy')}
          FROM seen GROUP BY strategy, scope) LEFT JOIN gaps USING (strategy, scope)"""

# Two smoothing values on an inner split of the training side.
_tune = [*NB, *split("tr0", "t_", "inner_sides"), "itr AS (SELECT * FROM inner_sides WHERE side = 'train')", "ite AS (SELECT * FROM inner_sides WHERE side = 'test')"]
_tune.insert(len(NB), "tr0 AS (SELECT * EXCLUDE (side) FROM tr)")
_runs = []
for _i, _v in enumerate(("1e-9", "0.5")):
    _runs += [c.replace("1e-9::DOUBLE", f"{_v}::DOUBLE") for c in naive_bayes("itr", "ite", FEATURES, f"nb{_i}", f"n{_i}_")]
ORACLE["tune_nb"] = with_(
    *_tune, *_runs,
    "score AS (SELECT 1e-9::DOUBLE AS var_smoothing, * FROM nb0 UNION ALL SELECT 0.5::DOUBLE, * FROM nb1)",
    *ranking("score", "var_smoothing"),
) + f"SELECT CAST(row_number() OVER (ORDER BY roc_auc DESC) AS INTEGER) AS position, var_smoothing, {r('roc_auc')} FROM auc"


# ---- invariants of fitted models -------------------------------------------------

_SEARCHED = ("decision_tree", "random_forest", "xgboost", "lightgbm", "catboost", "mlp", "svm", "adaboost")
ORACLE["fit_checks"] = " UNION ALL ".join(
    [f"SELECT '{k}' AS model_key, TRUE AS below_prior, TRUE AS ranks, TRUE AS follows, {'TRUE' if k == 'decision_tree' else 'NULL::BOOLEAN'} AS shares" for k in _SEARCHED]
    + ["SELECT 'logistic_regression', TRUE, TRUE, TRUE, NULL"]
)
ORACLE["logreg_gradient"] = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, TRUE AS flat" for c in (*FEATURES, "intercept")
)
ORACLE["split_many_classes"] = with_(
    """many AS (SELECT o_orderkey AS row_id, CAST(o_custkey % 150 AS INTEGER) AS label FROM orders JOIN customer ON o_custkey = c_custkey
         QUALIFY count(*) OVER (PARTITION BY o_custkey % 150) >= 2)""",
    *split("many"),
) + "SELECT row_id, label, side FROM sides"
_SOME = [
    *PREPARE, "gone AS (SELECT * REPLACE (CASE WHEN row_id % 10 <> 0 THEN cohort END AS cohort) FROM pr)",
    "tr AS (SELECT * FROM gone WHERE side = 'train')", "te AS (SELECT * FROM gone WHERE side = 'test')",
    *naive_bayes("tr", "te", FEATURES),
]
ORACLE["specialist_null_cohort"] = (
    with_(*_SOME, *per_cohort()) + COHORT_SCORES + "special UNION ALL " + COHORT_SCORES + "nb WHERE cohort IS NULL"
)
ORACLE["refit_flipped"] = with_(
    *NB_ALL, "ftr AS (SELECT * REPLACE (1 - label AS label) FROM tr)", *naive_bayes("ftr", "te", FEATURES, "fnb", "f_")
) + " UNION ALL ".join(
    f"SELECT row_id, '{n}' AS fitted_on, prediction, {r('probability')} FROM {t}" for n, t in (("train", "nb"), ("flipped", "fnb"))
)
ORACLE["clean_raw_headers"] = with_(ORD) + "SELECT DISTINCT acctbal, totalprice, order_days, prio, near, label FROM ord"
ORACLE["tree_attribution_sums"] = with_(*NB) + "SELECT row_id, TRUE AS adds_up FROM te"


# ---- boosted trees grown again ---------------------------------------------------

_codes = """codes AS (SELECT row_id, floor(round(acctbal, 2) / 100) AS bal, floor(round(totalprice, 2) / 4000) AS price,
  floor(order_days / 30) AS month, CAST(prio AS DOUBLE) AS prio, CAST(near AS DOUBLE) AS near, CAST(label AS DOUBLE) AS y FROM ord)"""
_grown = [
    Growth("level", "codes", CODES, "level", 3, 0.1, 1.0, 1, 1.0, True), Growth("leaf", "codes", CODES, "leaf", 5, 0.05, 0.0, 20, 1e-3, True),
    Growth("symmetric", "codes", CODES, "symmetric", 3, 0.05, 3.0, 1, 0.0, False),
]
for _g in _grown:
    for _t in range(2):
        _g.tree(_t)
ORACLE["boosted_nodes"] = with_(ORD, _codes, *[c.replace(" AS (", " AS MATERIALIZED (", 1) for g in _grown for c in g.parts]) + f"""
  SELECT model AS growth, CAST(tree AS INTEGER) AS tree, node AS path, CAST(depth AS INTEGER) AS depth, feature, threshold,
         {r('gain')}, {r('g', 'gradient', 4)}, {r('h', 'curvature', 4)}, {big('n', 'rows')}, {r('value')}
  FROM ({" UNION ALL ".join(n for g in _grown for n in g.nodes)})"""

# Mean gain per feature over the two trees grown by level.
_gains = f"""level_nodes AS ({" UNION ALL ".join(_grown[0].nodes)}),
  mean AS (SELECT feature, avg(gain) AS gain FROM level_nodes WHERE feature IS NOT NULL GROUP BY feature),
  share AS (SELECT feature, gain / (SELECT sum(gain) FROM mean) AS importance FROM mean),
  best AS (SELECT *, row_number() OVER (ORDER BY importance DESC) - 1 AS position FROM share QUALIFY position < 3)"""
_level = with_(ORD, _codes, *[c.replace(" AS (", " AS MATERIALIZED (", 1) for c in _grown[0].parts], _gains)
ORACLE["feature_importance_gains"] = _level + f"SELECT 'overall' AS scope, TRUE AS applied, 'top_k_selected' AS reason, CAST(position AS INTEGER) AS position, feature, {r('importance')} FROM best"
ORACLE["importance_panels"] = _level + f"SELECT 'overall' AS scope, CAST(row_number() OVER (ORDER BY importance) AS INTEGER) AS place, feature, {r('importance')} FROM best"
# Keys and names of the models, in catalogue order, and the points of their search.
_models = (
    ("logistic_regression", "Logistic Regression", 8), ("random_forest", "Random Forest", 8), ("xgboost", "XGBoost", 8), ("lightgbm", "LightGBM", 8),
    ("svm", "Support Vector Machine (SVM)", 8), ("mlp", "Artificial Neural Network (MLP)", 8), ("knn", "K-Nearest Neighbors (KNN)", 8),
    ("decision_tree", "Decision Tree", 8), ("naive_bayes", "Naive Bayes", 5), ("catboost", "CatBoost", 8), ("adaboost", "AdaBoost", 8),
)
ORACLE["catalogue"] = with_(ORD) + " UNION ALL ".join(
    f"SELECT {i}::INTEGER AS position, '{k}' AS model_key, '{n}' AS model_name, {t}::INTEGER AS search_iterations, TRUE AS available,"
    " TRUE AS all_defaults, (SELECT count(*) FROM ord WHERE label = 1) AS rare_rows"
    for i, (k, n, t) in enumerate(_models)
)
ORACLE["params_texts"] = with_(ORD) + """SELECT row_id, 'max_depth=' || label || CASE WHEN near = 1 THEN ', learning_rate=' || near ELSE '' END || ', zone=' || prio AS params,
  'N/A' AS no_params FROM ord"""
ORACLE["table_round_trip"] = f"SELECT o_orderkey, o_custkey, o_orderstatus, {r('round(o_totalprice, 2)', 'o_totalprice', 2)} FROM orders"
_contract = lambda t: f"""SELECT '{t}' AS name,
  (SELECT string_agg(column_name, ', ' ORDER BY column_index) FROM cols WHERE table_name = '{t}'
    AND column_name NOT IN ('l_orderkey', 'l_partkey', 'p_partkey', 'n_nationkey', 'event_id')) AS features,
  (SELECT string_agg(column_name, ', ' ORDER BY column_index) FROM cols WHERE table_name = '{t}' AND column_name <> 'l_quantity'
    AND regexp_matches(data_type, 'INT|DOUBLE|FLOAT|DECIMAL')) AS numeric,
  (SELECT coalesce(string_agg(c, ', ' ORDER BY c), '') FROM (VALUES ('l_orderkey'), ('l_quantity'), ('l_discount'), ('p_name')) w(c)
    WHERE c NOT IN (SELECT column_name FROM cols WHERE table_name = '{t}')) AS missing"""  # noqa: E731
ORACLE["column_contracts"] = with_("cols AS (SELECT table_name, column_name, column_index, data_type FROM duckdb_columns())") + " UNION ALL ".join(
    _contract(t) for t in ("lineitem", "part", "nation", "events")
)
ORACLE["smote_minority_of_one"] = with_(
    CUS, "kept AS (SELECT * FROM cus WHERE label = 0 OR row_id = (SELECT min(row_id) FROM cus WHERE label = 1))",
    "last AS (SELECT max(row_id) AS last FROM kept)", "slots AS (SELECT unnest(range((SELECT count(*) FROM kept WHERE label = 0) - 1)) AS slot)",
    f"made AS (SELECT last + 1 + slot AS row_id, {', '.join(f'k.{c}' for c in CUST)}, label FROM slots, last, kept k WHERE label = 1)",
    f"balanced AS (SELECT row_id, {', '.join(CUST)}, label FROM kept UNION ALL SELECT * FROM made)",
) + "SELECT row_id, " + ", ".join(r(c) for c in CUST) + ", CAST(label AS INTEGER) AS label, 0::INTEGER AS k_used FROM balanced"

# Forward and backward through two hidden units.
_w = (0.5, -0.25, 0.125, 0.75, -0.5, 0.25, 0.1, -0.2, 1.5, -1.0, 0.05)
_hidden = ", ".join(f"x0 * {_w[k]}::DOUBLE + x1 * {_w[2 + k]}::DOUBLE + x2 * {_w[4 + k]}::DOUBLE + {_w[6 + k]}::DOUBLE AS z{k}" for k in (0, 1))
_terms = {
    "loss": "ln(1 + exp(m)) - y * m", **{f"w{2 * i + k}": f"e * {_w[8 + k]}::DOUBLE * x{i} * CAST(z{k} > 0 AS INTEGER)" for i in range(3) for k in (0, 1)},
    **{f"w{6 + k}": f"e * {_w[8 + k]}::DOUBLE * CAST(z{k} > 0 AS INTEGER)" for k in (0, 1)}, **{f"w{8 + k}": f"e * greatest(z{k}, 0)" for k in (0, 1)}, "w10": "e",
}
ORACLE["mlp_gradient"] = with_(
    ORD, _codes, "inp AS (SELECT bal / 50 - 1 AS x0, price / 40 - 1 AS x1, month / 40 AS x2, y FROM codes)", f"hid AS (SELECT *, {_hidden} FROM inp)",
    f"mar AS (SELECT *, greatest(z0, 0) * {_w[8]}::DOUBLE + greatest(z1, 0) * {_w[9]}::DOUBLE + {_w[10]}::DOUBLE AS m FROM hid)", "err AS (SELECT *, 1 / (1 + exp(-m)) - y AS e FROM mar)",
) + " UNION ALL ".join(f"SELECT '{k}' AS name, {r(f'avg({v})', 'value')} FROM err" for k, v in _terms.items())
