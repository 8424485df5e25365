"""The registered queries again, as SQL over the given tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

APPLICATIONS = """
li AS (
  SELECT l_orderkey, CAST(COUNT(*) AS BIGINT) AS n_lines,
         CAST(SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS n_ret,
         MAX(CASE WHEN l_returnflag = 'R' AND l_quantity >= 48 THEN l_quantity END) AS big_ret_qty,
         MAX(l_extendedprice) AS max_line_price
  FROM lineitem GROUP BY l_orderkey),
o AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_totalprice,
         CAST(o_orderdate AS DATE) AS d,
         CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS dn
  FROM orders),
w AS (
  SELECT o.*,
    dn - MIN(dn) OVER (PARTITION BY o_custkey) AS tenure_days,
    dn - LAG(dn) OVER (PARTITION BY o_custkey ORDER BY dn, o_orderkey) AS since_last,
    COUNT(*) OVER (PARTITION BY o_custkey ORDER BY dn
                   RANGE BETWEEN 30 PRECEDING AND 1 PRECEDING) AS a30,
    COUNT(*) OVER (PARTITION BY o_custkey ORDER BY dn
                   RANGE BETWEEN 90 PRECEDING AND 1 PRECEDING) AS a90,
    COUNT(*) OVER (PARTITION BY o_custkey ORDER BY dn
                   RANGE BETWEEN 180 PRECEDING AND 1 PRECEDING) AS a180
  FROM o),
t AS MATERIALIZED (
  SELECT o_orderkey AS application_id, d AS applicationdate, o_custkey AS customer_id,
         CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS booked,
         CASE WHEN n_lines IS NULL THEN NULL WHEN n_ret >= 3 THEN 1 ELSE 0 END AS label,
         CAST(tenure_days AS DOUBLE) / CAST(365.25 AS DOUBLE) AS max_open_age,
         n_lines AS total_accts,
         a30 AS total_apps_in_last_30_days, a90 AS total_apps_in_last_90_days,
         a180 AS total_apps_in_last_180_days, since_last AS days_since_last_application,
         big_ret_qty AS cc_days_since_last_pd, max_line_price, o_totalprice, c_acctbal,
         o_orderpriority, c_mktsegment, n_name AS nation
  FROM w LEFT JOIN li ON o_orderkey = l_orderkey
         LEFT JOIN customer ON o_custkey = c_custkey
         LEFT JOIN nation ON c_nationkey = n_nationkey)"""

DOCUMENTS = """
t AS MATERIALIZED (
  SELECT d.doc_id, text, lang, source, n_chars, quality, toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

EVENTS = """
t AS MATERIALIZED (
  SELECT event_id, ts, user_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS bought,
         CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS booked, value, props
  FROM events)"""

LINES = """
t AS MATERIALIZED (
  SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS returned, l_shipdate, l_quantity,
         l_extendedprice, l_discount, l_tax, l_extendedprice * (1 - l_discount) AS revenue,
         l_linestatus
  FROM lineitem)"""

PARTS = "t AS (SELECT * FROM part)"

DIMS = [f"d{i}" for i in range(64)]
VECTORS = f"""
t AS MATERIALIZED (
  SELECT vec_id, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS upper_half,
         {", ".join(f"embedding[{i + 1}] AS d{i}" for i in range(64))}
  FROM embeddings)"""


@dataclass(frozen=True)
class Table:
    sql: str
    label: str
    numeric: Sequence[str]
    text: Sequence[str]
    key: str | None = None

    def query(self, body: str, *ctes: str) -> str:
        return "WITH " + ",\n".join([self.sql, *ctes]) + "\n" + body

    @property
    def y(self) -> str:
        return f"COALESCE({self.label}, 0)"


APP = Table(
    APPLICATIONS,
    "label",
    (
        "max_open_age",
        "total_accts",
        "total_apps_in_last_30_days",
        "total_apps_in_last_90_days",
        "total_apps_in_last_180_days",
        "days_since_last_application",
        "cc_days_since_last_pd",
        "max_line_price",
        "o_totalprice",
        "c_acctbal",
    ),
    ("o_orderpriority", "c_mktsegment", "nation"),
    "application_id",
)
DOC = Table(DOCUMENTS, "quality", ("n_chars", "toxic"), ("text", "lang", "source"), "doc_id")
EVENT = Table(EVENTS, "bought", ("value",), ("props",), "event_id")
LINE = Table(
    LINES,
    "returned",
    ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "revenue"),
    ("l_linestatus",),
)
EVENT_ROWS = Table("t AS (SELECT * FROM events)", "0", (), ("event_type", "props"), "event_id")
PART = Table(PARTS, "0", ("p_size", "p_retailprice"), ("p_name", "p_brand", "p_type"))
VECTOR = Table(VECTORS, "upper_half", DIMS, (), "vec_id")


def r(expression: str) -> str:
    """Rounded like the Spark side; adding 0 turns -0.0 into 0.0."""
    return f"(round({expression}, 6) + 0)"


def union(parts: Sequence[str]) -> str:
    return "\nUNION ALL ".join(parts)


def num_cte(t: Table, columns: Sequence[str] | None = None) -> str:
    rows = [
        f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value, {t.y} AS y FROM t"
        for c in columns or t.numeric
    ]
    return f"num AS MATERIALIZED ({union(rows)})"


def txt_cte(t: Table, columns: Sequence[str] | None = None) -> str:
    rows = [
        f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value, {t.y} AS y FROM t"
        for c in columns or t.text
    ]
    return f"txt AS MATERIALIZED ({union(rows)})"


def missing(t: Table, where: str = "") -> str:
    rows = [
        f"SELECT '{c}' AS feature, {c} IS NULL AS gone, {t.y} AS y FROM t"
        for c in (*t.numeric, *t.text)
    ]
    stats = """stats AS (SELECT feature,
      COUNT(*) FILTER (WHERE gone) / COUNT(*) AS missing_rate,
      AVG(y) FILTER (WHERE gone) AS fraud_rate_missing,
      AVG(y) FILTER (WHERE NOT gone) AS fraud_rate_present,
      CAST(COUNT(*) FILTER (WHERE gone) AS BIGINT) AS null_count FROM m GROUP BY feature)"""
    body = f"""SELECT feature, {r("missing_rate")} AS missing_rate,
      {r("fraud_rate_missing")} AS fraud_rate_missing,
      {r("fraud_rate_present")} AS fraud_rate_present, null_count FROM stats {where}"""
    return t.query(body, f"m AS ({union(rows)})", stats)


PERCENTILES = (("p1", 0.01), ("p10", 0.1), ("p25", 0.25), ("p50", 0.5)) + (
    ("p75", 0.75),
    ("p90", 0.9),
    ("p99", 0.99),
)
MOMENTS = f"""CAST(COUNT(value) AS BIGINT) AS count, {r("AVG(value)")} AS mean,
  {r("STDDEV_SAMP(value)")} AS std, {r("MIN(value)")} AS min, {r("MAX(value)")} AS max"""
QUANTILES = ", ".join(f"{r(f'quantile_cont(value, {p})')} AS {n}" for n, p in PERCENTILES)


def described(t: Table, select: str, extra: Sequence[str] = (), having: str = "") -> str:
    body = f"SELECT feature, {select} FROM num GROUP BY feature {having}"
    return t.query(body, num_cte(t, (*t.numeric, *extra)))


HAS_VALUES = "HAVING COUNT(value) > 0"


def categorical(t: Table) -> str:
    return t.query(
        """SELECT feature, CAST(COUNT(value) AS BIGINT) AS count,
        CAST(COUNT(*) - COUNT(value) AS BIGINT) AS null_count,
        CAST(COUNT(DISTINCT value) AS BIGINT) AS distinct_count FROM txt GROUP BY feature""",
        txt_cte(t),
    )


def monthly(t: Table, date: str) -> str:
    return t.query(
        f"""SELECT CAST(date_trunc('month', {date}) AS DATE) AS month_start,
        CAST(COUNT(*) AS BIGINT) AS total_apps, CAST(SUM(booked) AS BIGINT) AS total_booked,
        CAST(SUM({t.y}) AS BIGINT) AS total_fraud,
        {r("SUM(booked) / COUNT(*)")} AS booked_rate,
        {r(f"SUM({t.y}) / COUNT(*)")} AS fraud_rate FROM t GROUP BY 1"""
    )


def age_bins(extra: str = "", lowest: bool = False) -> str:
    first = ">=" if lowest else ">"
    bins = f"""b AS (SELECT CASE WHEN max_open_age {first} 0 AND max_open_age <= 0.5
      THEN 'new_custs_<6mo' WHEN max_open_age > 0.5 AND max_open_age <= 1 THEN 'newish_6mo_1y'
      WHEN max_open_age > 1 AND max_open_age <= 2 THEN 'somewhat_new_1y_2y'
      WHEN max_open_age > 2 AND max_open_age <= 999 THEN 'established_>2y' END AS relat_age_bin,
      {APP.y} AS y FROM t),
    g AS (SELECT relat_age_bin, CAST(COUNT(*) AS BIGINT) AS count,
      CAST(SUM(y) AS BIGINT) AS fraud_count, AVG(y) AS p, COUNT(*)::DOUBLE AS n
      FROM b WHERE relat_age_bin IS NOT NULL GROUP BY 1)"""
    body = f"SELECT relat_age_bin, count, fraud_count, {r('p')} AS fraud_rate {extra} FROM g"
    return APP.query(body, bins)


Z = "1.959963984540054::DOUBLE"
CENTRE = f"(p + {Z} * {Z} / (2 * n)) / (1 + {Z} * {Z} / n)"
HALF = f"{Z} / (1 + {Z} * {Z} / n) * sqrt(p * (1 - p) / n + {Z} * {Z} / (4 * n * n))"
WILSON = f", {r(f'{CENTRE} - {HALF}')} AS rate_low, {r(f'{CENTRE} + {HALF}')} AS rate_high"


def windows_cte() -> str:
    rows = [
        f"SELECT '{d}_days' AS win, CAST(total_apps_in_last_{d}_days AS DOUBLE) AS value FROM t"
        for d in (30, 90, 180)
    ]
    return f"v AS ({union(rows)})"


# --- information value ---------------------------------------------------------------


def iv_ctes(t: Table, missing_policy: str = "bin", binning: str = "quantile") -> list[str]:
    ctes = []
    parts = []
    if t.numeric:
        ctes.append(num_cte(t))
        if binning == "quantile":
            edges = "quantile_cont(value, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1])"
            inner = "[z FOR z IN list_distinct(e) IF z > e[1] AND z < e[11]]"
        else:
            steps = ", ".join(f"MIN(value) + (MAX(value) - MIN(value)) / 10 * {k}" for k in range(1, 10))
            edges = f"[MIN(value), {steps}, MAX(value)]"
            inner = "e[2:10]"
        ctes.append(
            f"""cut AS (SELECT feature, d, {inner} AS inner_edges FROM (
            SELECT feature, COUNT(DISTINCT value) AS d, {edges} AS e FROM num GROUP BY feature))"""
        )
        keep = "" if missing_policy == "bin" else "WHERE d <= 10 OR value IS NOT NULL"
        ctes.append(
            f"""numbins AS (SELECT feature, CASE WHEN value IS NULL THEN 'Missing'
            WHEN d <= 10 THEN CAST(value AS VARCHAR)
            ELSE CAST(len([z FOR z IN inner_edges IF value > z]) AS VARCHAR) END AS bin, y
            FROM num JOIN cut USING (feature) {keep})"""
        )
        parts.append("SELECT * FROM numbins")
    if t.text:
        ctes.append(txt_cte(t))
        parts.append("SELECT feature, COALESCE(value, 'Missing') AS bin, y FROM txt")
    ctes.append(
        f"""ct AS (SELECT feature, bin, CAST(SUM(1 - y) AS BIGINT) AS good,
        CAST(SUM(y) AS BIGINT) AS bad FROM ({union(parts)}) GROUP BY feature, bin),
      dist AS (SELECT feature, bin, good, bad,
        (good + 1e-6::DOUBLE) / (SUM(good) OVER f + 1e-6::DOUBLE) AS dg,
        (bad + 1e-6::DOUBLE) / (SUM(bad) OVER f + 1e-6::DOUBLE) AS db
        FROM ct WINDOW f AS (PARTITION BY feature)),
      ivb AS (SELECT feature, bin, good, bad, ln(dg / db) AS woe, (dg - db) * ln(dg / db) AS iv
        FROM dist)"""
    )
    return ctes


def iv_all(t: Table, *options: str) -> str:
    return t.query(
        f"""SELECT feature, {r("SUM(iv)")} AS iv, CAST(COUNT(*) AS BIGINT) AS n_bins
        FROM ivb GROUP BY feature""",
        *iv_ctes(t, *options),
    )


def iv_by_bin(t: Table) -> str:
    body = f"SELECT feature, bin, good, bad, {r('woe')} AS woe, {r('iv')} AS iv FROM ivb"
    return t.query(body, *iv_ctes(t))


# --- correlation ---------------------------------------------------------------------


def matrix_columns(t: Table) -> list[str]:
    # the label keeps its place in column order
    return [t.label, *t.numeric]


def imputed(t: Table, columns: Sequence[str]) -> str:
    cells = []
    for c in columns:
        x = f"COALESCE({c}, 0)" if c == t.label else c
        cells.append(f"CAST(COALESCE({x}, (SELECT median({c}) FROM t)) AS DOUBLE) AS {c}")
    key = f"{t.key}, " if t.key else ""
    return f"x AS MATERIALIZED (SELECT {key}{', '.join(cells)} FROM t)"


def ranked(columns: Sequence[str]) -> str:
    cells = [
        f"RANK() OVER (ORDER BY {c}) + (COUNT(*) OVER (PARTITION BY {c}) - 1) / 2 AS {c}"
        for c in columns
    ]
    return f"k AS MATERIALIZED (SELECT {', '.join(cells)} FROM x)"


def corr_cte(name: str, source: str, columns: Sequence[str], value: str) -> str:
    """All pairs in one aggregate, then unnested."""
    cells = ", ".join(
        f"{{'feat1': '{a}', 'feat2': '{b}', '{value}': corr({a}, {b})}}"
        for a in columns
        for b in columns
    )
    return f"{name} AS (SELECT unnest([{cells}], recursive := true) FROM {source})"


def pearson(t: Table) -> str:
    columns = matrix_columns(t)
    return t.query(
        f"SELECT feat1, feat2, {r('pearson')} AS pearson FROM p",
        imputed(t, columns),
        corr_cte("p", "x", columns, "pearson"),
    )


def spearman(t: Table) -> str:
    columns = matrix_columns(t)
    return t.query(
        f"SELECT feat1, feat2, {r('spearman')} AS spearman FROM s",
        imputed(t, columns),
        ranked(columns),
        corr_cte("s", "k", columns, "spearman"),
    )


def pearson_wide(t: Table) -> str:
    columns = matrix_columns(t)
    rows = []
    for a in columns:
        cells = ", ".join(f"{r(f'corr({a}, {b})')} AS {b}" for b in columns)
        rows.append(f"SELECT '{a}' AS feature, {cells} FROM x")
    return t.query(union(rows), imputed(t, columns))


def high_pairs(t: Table) -> str:
    columns = matrix_columns(t)
    place = "list_position([" + ", ".join(f"'{c}'" for c in columns) + "], {})"
    return t.query(
        f"""SELECT feat1, feat2, {r("pearson")} AS pearson, {r("spearman")} AS spearman
        FROM p JOIN s USING (feat1, feat2)
        WHERE {place.format("feat1")} < {place.format("feat2")}
          AND (abs(pearson) > 0.7 OR abs(spearman) > 0.7)""",
        imputed(t, columns),
        ranked(columns),
        corr_cte("p", "x", columns, "pearson"),
        corr_cte("s", "k", columns, "spearman"),
    )


def outliers(t: Table) -> str:
    rows = [
        f"""SELECT '{c}' AS feature, {r(f"AVG({c})")} AS mean, {r(f"STDDEV_SAMP({c})")} AS std,
        (SELECT CAST(COUNT(*) AS BIGINT) FROM x, (SELECT AVG({c}) AS m, STDDEV_SAMP({c}) AS s FROM x)
         WHERE abs({c} - m) > 5 * s) AS n_outliers FROM x"""
        for c in t.numeric
    ]
    return t.query(union(rows), imputed(t, t.numeric))


def impute(t: Table) -> str:
    cells = ", ".join(f"{r(c)} AS {c}" for c in t.numeric)
    return t.query(f"SELECT {t.key}, {cells} FROM x", imputed(t, t.numeric))


def uniform(key: str, seed: int = 42) -> str:
    digits = f"substr(md5(CAST({key} AS VARCHAR) || '|{seed}'), 1, 13)"
    return f"(CAST('0x' || {digits} AS BIGINT) / 4503599627370496)"


SCATTER = (
    ("total_apps_in_last_90_days", "total_apps_in_last_180_days"),
    ("total_apps_in_last_180_days", "days_since_last_application"),
)


# all pairs are strong at a threshold of 0; those with the label are left out
FOUND = tuple(
    (a, b) for i, a in enumerate(APP.numeric) for b in APP.numeric[i + 1 :]
)
LINE_KEY = "l_orderkey || '|' || l_linenumber || '|' || l_suppkey"


def time_percentiles() -> str:
    """Interpolated step by step: at this size a double has no digit to spare."""
    cells = []
    for name, p in PERCENTILES:
        at = f"({p}::DOUBLE * n)"
        low, high = (
            f"max(CASE WHEN k = CAST({side}({at}) AS BIGINT) THEN value END)"
            for side in ("floor", "ceil")
        )
        rest = f"max({at} - floor({at}))"
        cells.append(f"{r(f'{low} + ({high} - {low}) * {rest}')} AS {name}")
    return f"""SELECT 'ts_micros' AS feature, {", ".join(cells)} FROM (
      SELECT value, row_number() OVER (ORDER BY value) - 1 AS k, count(*) OVER () - 1 AS n
      FROM (SELECT CAST(epoch_us(ts) AS DOUBLE) AS value FROM events WHERE ts IS NOT NULL))"""


def codes(table: str, key: str, columns: Sequence[str]) -> str:
    cells = ", ".join(
        f"CAST(dense_rank() OVER (ORDER BY coalesce({c}, 'Missing')) - 1 AS DOUBLE) AS {c}"
        for c in columns
    )
    return f"SELECT {key}, {cells} FROM {table}"


def codes_of_others(table: str, key: str, columns: Sequence[str]) -> str:
    """Codes of the values on even keys, for the rows with odd keys; -1 where there is none."""
    fits = ", ".join(
        f"""f{i} AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS DOUBLE) AS code FROM (
          SELECT DISTINCT coalesce({c}, 'Missing') AS v FROM {table} WHERE {key} % 2 = 0))"""
        for i, c in enumerate(columns)
    )
    cells = ", ".join(f"coalesce(f{i}.code, -1) AS {c}" for i, c in enumerate(columns))
    joins = " ".join(
        f"LEFT JOIN f{i} ON f{i}.v = coalesce(t.{c}, 'Missing')" for i, c in enumerate(columns)
    )
    return f"WITH {fits} SELECT t.{key}, {cells} FROM {table} t {joins} WHERE t.{key} % 2 <> 0"


def scatter(t: Table, pairs: Sequence[tuple[str, str]], cap: int) -> str:
    columns = [c for c in t.numeric if any(c in p for p in pairs)]
    clean = ", ".join(
        f"CASE WHEN abs({c} - (SELECT AVG({c}) FROM x)) <= 5 * (SELECT STDDEV_SAMP({c}) FROM x)"
        f" THEN {c} END AS {c}"
        for c in columns
    )
    rows = [
        f"SELECT '{a}' AS feat1, '{b}' AS feat2, {t.key}, {a} AS x, {b} AS y, {t.label} FROM c"
        f" WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
        for a, b in pairs
    ]
    label = f"CAST({t.label} AS INTEGER) AS {t.label}"
    return t.query(
        f"""SELECT feat1, feat2, {t.key}, {r("x")} AS x, {r("y")} AS y, {t.label} FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY feat1, feat2
          ORDER BY {uniform(t.key)}, {t.key}) AS n FROM s) WHERE n <= {cap}""",
        imputed(t, [*columns, t.label]),
        f"c AS (SELECT {t.key}, {label}, {clean} FROM x)",
        f"s AS ({union(rows)})",
    )


# --- distributions -------------------------------------------------------------------

CLIPPED = """bounds AS (SELECT feature, quantile_cont(value, 0.01) AS lower,
    quantile_cont(value, 0.99) AS upper FROM num GROUP BY feature),
  clip AS MATERIALIZED (SELECT feature, value, y FROM num JOIN bounds USING (feature)
    WHERE value BETWEEN lower AND upper)"""


def histogram(t: Table, bins: str) -> str:
    if bins == "auto":
        count = """CASE WHEN MAX(value) > MIN(value) THEN ceil((MAX(value) - MIN(value)) /
          CASE WHEN quantile_cont(value, 0.75) > quantile_cont(value, 0.25)
          THEN least(2 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / cbrt(COUNT(*)),
                     (MAX(value) - MIN(value)) / (log2(COUNT(*)) + 1))
          ELSE (MAX(value) - MIN(value)) / (log2(COUNT(*)) + 1) END) ELSE 1 END"""
    else:
        count = bins
    return t.query(
        f"""SELECT feature, label, bin, {r("lo + width * bin")} AS bin_low,
        {r("lo + width * (bin + 1)")} AS bin_high, n,
        {r("n / (SUM(n) OVER (PARTITION BY feature, label) * width)")} AS density
        FROM (SELECT feature, CAST(y AS INTEGER) AS label,
          CAST(least(floor((value - lo) / ((hi - lo) / nb)), nb - 1) AS BIGINT) AS bin,
          CAST(COUNT(*) AS BIGINT) AS n, MAX(lo) AS lo, MAX((hi - lo) / nb) AS width
          FROM clip JOIN frame USING (feature) GROUP BY 1, 2, 3)""",
        num_cte(t),
        CLIPPED,
        f"""frame AS (SELECT feature,
          CASE WHEN MIN(value) = MAX(value) THEN MIN(value) - 0.5 ELSE MIN(value) END AS lo,
          CASE WHEN MIN(value) = MAX(value) THEN MAX(value) + 0.5 ELSE MAX(value) END AS hi,
          {count} AS nb FROM clip GROUP BY feature)""",
    )


def kde(t: Table) -> str:
    return t.query(
        f"""SELECT feature, label, point, {r("MAX(first + gx)")} AS x,
        {r("SUM(w * exp(-0.5 * ((gx - c) / h) * ((gx - c) / h))) / (MAX(n * h) * sqrt(2 * pi()))")}
        AS density FROM (
          SELECT cells.*, CAST(g AS INTEGER) AS point, span * g / 199 AS gx, n, h
          FROM cells JOIN band USING (feature, label), range(200) AS r(g))
        GROUP BY feature, label, point""",
        num_cte(t),
        CLIPPED,
        """span AS (SELECT feature, MIN(value) AS first, MAX(value) - MIN(value) AS span
          FROM clip GROUP BY feature HAVING MIN(value) < MAX(value)),
        cells AS (SELECT feature, CAST(y AS INTEGER) AS label,
          least(floor((value - first) / (span / 4096)), 4095) AS cell, COUNT(*) AS w,
          AVG(value - first) AS c, MAX(first) AS first, MAX(span) AS span
          FROM clip JOIN span USING (feature) GROUP BY 1, 2, 3),
        band AS (SELECT feature, CAST(y AS INTEGER) AS label, COUNT(*) AS n,
          STDDEV_SAMP(value) * pow(COUNT(*), -0.2) AS h FROM clip GROUP BY 1, 2
          HAVING STDDEV_SAMP(value) > 0)""",
    )


def category_rates(t: Table) -> str:
    return t.query(
        f"""SELECT feature, value, volume, {r("rate")} AS fraud_rate, n_categories FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY feature ORDER BY volume DESC, value) AS place,
          CAST(COUNT(*) OVER (PARTITION BY feature) AS BIGINT) AS n_categories
        FROM (SELECT feature, value, CAST(COUNT(*) AS BIGINT) AS volume, AVG(y) AS rate
          FROM txt WHERE value IS NOT NULL GROUP BY 1, 2)) WHERE place <= 20""",
        txt_cte(t),
    )


def counts(t: Table) -> str:
    return t.query(
        """SELECT feature, value, CAST(COUNT(*) AS BIGINT) AS count FROM txt
        WHERE value IS NOT NULL GROUP BY 1, 2""",
        txt_cte(t),
    )


def encoded(t: Table) -> str:
    cells = ", ".join(
        f"CAST(DENSE_RANK() OVER (ORDER BY COALESCE({c}, 'Missing')) - 1 AS DOUBLE) AS {c}"
        for c in t.text
    )
    return t.query(f"SELECT {t.key}, {cells} FROM t")


def retention() -> str:
    rows = [
        f"SELECT '{c}' AS feature, AVG(({c} IS NULL)::INT) AS missing_rate FROM t"
        for c in (*APP.numeric, *APP.text)
    ]
    return APP.query(
        f"""SELECT feature, {r("missing_rate")} AS missing_rate, {r("iv")} AS iv
        FROM m JOIN (SELECT feature, SUM(iv) AS iv FROM ivb GROUP BY feature) USING (feature)
        WHERE missing_rate >= 0.45 AND iv >= 0.05""",
        *iv_ctes(APP),
        f"m AS ({union(rows)})",
    )


TABLE_COLUMNS = """application_id, applicationdate, customer_id, booked, label,
  round(max_open_age, 6) AS max_open_age, total_accts, total_apps_in_last_30_days,
  total_apps_in_last_90_days, total_apps_in_last_180_days, days_since_last_application,
  cc_days_since_last_pd, max_line_price, o_totalprice, c_acctbal, o_orderpriority,
  c_mktsegment, nation"""

DISTANCE = """d AS (SELECT feature, abs(AVG(value) FILTER (WHERE y = 1)
  - AVG(value) FILTER (WHERE y = 0)) AS rf_importance_mean FROM num GROUP BY feature)"""
COMPARED = VECTOR.query(
    f"""SELECT feature, {r("iv")} AS iv, n_bins, {r("rf_importance_mean")} AS rf_importance_mean,
    0.0::DOUBLE AS rf_importance_std, {r("iv / (SELECT max(iv) FROM i)")} AS iv_norm,
    {r("rf_importance_mean / (SELECT max(rf_importance_mean) FROM d)")} AS rf_norm
    FROM i JOIN d USING (feature) ORDER BY i.iv DESC, feature LIMIT 30""",
    *iv_ctes(VECTOR),
    DISTANCE,
    """i AS (SELECT feature, SUM(iv) AS iv, CAST(COUNT(*) AS BIGINT) AS n_bins
      FROM ivb GROUP BY feature)""",
)
NAMED = "', '".join((*APP.numeric, "label", "booked"))
PERCENTILE_NAMES = ", ".join(f"'{name}'" for name, _ in PERCENTILES)
AGE_BINS = ("new_custs_<6mo", "newish_6mo_1y", "somewhat_new_1y_2y", "established_>2y")

ORACLES: dict[str, str] = {
    "bernoulli_sample_size": "SELECT true AS inside, true AS near",
    "sketched_percentile_ranks": f"""SELECT unnest(['{NAMED}']) AS feature, percentile,
      true AS "within" FROM (SELECT unnest([{PERCENTILE_NAMES}]) AS percentile)""",
    "age_bin_bootstrap_brackets": f"""SELECT unnest({list(AGE_BINS)}) AS relat_age_bin,
      true AS holds, true AS near""",
    "kde_curve_error": f"SELECT DISTINCT feature, label, true AS near FROM ({kde(APP)})",
    "rf_importance_sums": f"""SELECT unnest([0, 1, 2, 3, 4])::INTEGER AS seed,
      {len(APP.numeric) + len(APP.text)}::BIGINT AS features, 1.0::DOUBLE AS total""",
    "importance_comparison_top30": COMPARED,
    "importance_over_seeds": f"""SELECT feature, {r("AVG(share)")} AS rf_importance_mean,
      {r("STDDEV_SAMP(share)")} AS rf_importance_std FROM (
        SELECT feature, q / SUM(q) OVER (PARTITION BY seed) AS share FROM (
          SELECT l_linenumber % 5 AS seed, l_returnflag || '-' || l_linestatus AS feature,
                 SUM(l_quantity) AS q FROM lineitem GROUP BY 1, 2)) GROUP BY feature""",
    "missing_report_file": missing(APP),
    "importance_report_file": VECTOR.query(
        f"""SELECT feature, {r("rf_importance_mean")} AS rf_importance_mean,
        0.0::DOUBLE AS rf_importance_std FROM d""",
        num_cte(VECTOR),
        DISTANCE,
    ),
    "applications": APP.query(f"SELECT {TABLE_COLUMNS} FROM t"),
    "csv_round_trip": APP.query(f"SELECT {TABLE_COLUMNS} FROM t"),
    "documents_csv_round_trip": "SELECT * FROM documents",
    "capped_lines": f"""SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem
      ORDER BY {uniform("l_suppkey")}, {uniform(LINE_KEY)} LIMIT 10000""",
    "stored_sample": APP.query(
        f"SELECT {TABLE_COLUMNS} FROM t WHERE {uniform('application_id')} < 0.01"
    ),
    "hash_sample": APP.query(
        f"SELECT {TABLE_COLUMNS} FROM t WHERE {uniform('application_id')} < 0.05"
    ),
    "capped_sample": APP.query(
        f"SELECT {TABLE_COLUMNS} FROM t ORDER BY {uniform('application_id')} LIMIT 10000"
    ),
    "missing_stats": missing(APP),
    "missing_significant": missing(APP, "WHERE missing_rate > 0.001"),
    "numeric_describe": described(APP, MOMENTS, ("label", "booked")),
    "numeric_percentiles_exact": described(APP, QUANTILES, ("label", "booked"), HAS_VALUES),
    "numeric_summary": described(APP, f"{MOMENTS}, {QUANTILES}", ("label", "booked")),
    "categorical_describe": categorical(APP),
    "monthly_stats": monthly(APP, "applicationdate"),
    "incremental_monthly_stats": monthly(APP, "applicationdate"),
    "incremental_missing_stats": missing(APP),
    "incremental_numeric_describe": described(APP, MOMENTS, ("label", "booked")),
    "incremental_distinct_within": f"""SELECT unnest({[*APP.numeric, *APP.text]}) AS feature,
      true AS within""",
    "event_value_bootstrap_brackets": """SELECT event_type, CAST(count(value) AS BIGINT) AS count,
      true AS holds, true AS near, true AS same FROM events GROUP BY event_type""",
    "age_bin_rates": age_bins(),
    "age_bin_rates_from_zero": age_bins(lowest=True),
    "age_bin_wilson": age_bins(WILSON),
    "window_volume_stats": APP.query(
        f"""SELECT win AS "window", {r("AVG(value)")} AS avg_apps, MAX(value) AS max_apps,
        CAST(COUNT(*) FILTER (WHERE value = 0) AS BIGINT) AS zero_count FROM v GROUP BY win""",
        windows_cte(),
    ),
    "window_histogram": APP.query(
        """SELECT win AS "window", CAST(least(floor(value), 28) AS BIGINT) AS bin,
        CAST(COUNT(*) AS BIGINT) AS count FROM v WHERE value > 0 AND value <= 29 GROUP BY 1, 2""",
        windows_cte(),
    ),
    "iv_bins": iv_by_bin(APP),
    "iv_all_features": iv_all(APP),
    "iv_text_label": iv_all(APP),
    "iv_drop_missing": iv_all(APP, "drop"),
    "iv_width_bins": iv_all(APP, "bin", "width"),
    "pearson_matrix": pearson(APP),
    "pearson_matrix_wide": pearson_wide(APP),
    "spearman_matrix": spearman(APP),
    "high_corr_pairs": high_pairs(APP),
    "median_impute": impute(APP),
    "outlier_counts": outliers(APP),
    "scatter_pairs": scatter(APP, SCATTER, 10_000),
    "scatter_found_pairs": scatter(APP, FOUND, 500),
    "scatter_age_accounts": APP.query(
        f"""SELECT application_id, {r("max_open_age")} AS max_open_age, total_accts,
        CAST({APP.y} AS INTEGER) AS label FROM t
        ORDER BY {uniform("application_id")} LIMIT 5000"""
    ),
    "clip_bounds": APP.query(
        f"SELECT feature, {r('lower')} AS lower, {r('upper')} AS upper FROM bounds",
        num_cte(APP),
        CLIPPED,
    ),
    "clipped_density_hist": histogram(APP, "30"),
    "clipped_density_hist_auto": histogram(APP, "auto"),
    "kde_curve": kde(APP),
    "class_means": APP.query(
        f"""SELECT feature, {r("AVG(value) FILTER (WHERE y = 0)")} AS mean_0,
        {r("AVG(value) FILTER (WHERE y = 1)")} AS mean_1 FROM num GROUP BY feature""",
        num_cte(APP),
    ),
    "category_rates_top20": category_rates(APP),
    "value_counts": counts(APP),
    "ordinal_encode": encoded(APP),
    "retention_report": retention(),
    "document_missing_stats": missing(DOC),
    "document_iv": iv_all(DOC),
    "document_category_rates": category_rates(DOC),
    "event_monthly_stats": monthly(EVENT, "ts"),
    "event_density_hist": histogram(EVENT, "auto"),
    "event_category_describe": categorical(EVENT),
    "event_value_counts": counts(EVENT_ROWS),
    # means of two-decimal values often end in a 5 at the seventh digit, so both
    # engines round a value that lies a little above
    "line_numeric_summary": described(LINE, f"{MOMENTS}, {QUANTILES}", ("returned",)).replace(
        ", 6) + 0", " + 2e-8::DOUBLE, 6) + 0"
    ),
    "line_spearman_matrix": spearman(LINE),
    "event_time_percentiles": time_percentiles(),
    "document_text_codes": codes("documents", "doc_id", ("text", "source")),
    "part_name_codes": codes("part", "p_partkey", ("p_name", "p_brand")),
    "part_codes_of_other_rows": codes_of_others("part", "p_partkey", ("p_name", "p_brand", "p_type")),
    "document_codes_of_other_rows": codes_of_others("documents", "doc_id", ("text", "lang", "source")),
    "line_pearson_matrix": pearson(LINE),
    "line_iv": iv_all(LINE),
    "part_value_counts": counts(PART),
    "vector_iv": iv_all(VECTOR),
    "vector_pearson_matrix": pearson(VECTOR),
    "vector_spearman_matrix": spearman(VECTOR),
    "vector_outlier_counts": outliers(VECTOR),
}
