"""DuckDB SQL for the registered queries, written from the measure register.

Every text is one WITH RECURSIVE statement; fragments below are chained in dependency order.
"""

from __future__ import annotations

from countwatch.config import STAR, STAR_FROZEN, Harness, mi_of

START, ASOF = STAR.window_start, STAR.as_of


def lab(mi: str) -> str:
    return f"printf('%04d-%02d', ({mi} - 1) // 12, ({mi} - 1) % 12 + 1)"


FIRM = r"(?i)\b(?:supplier#000000001|supplier#000000002)"
VETO = r"(?i)\b(?:supplier#000000002)"
BRAND = r"(?i)\b(?:red anvil)"


def token(column: str, pattern: str) -> str:
    clean = rf"trim(regexp_replace({column}, '\s+', ' ', 'g'))"
    return f"nullif(lower(regexp_extract({clean}, '{pattern}', 0)), '')"


BASE = f"""
line AS (
  SELECT l_orderkey AS k, p_type AS code, l_shipdate AS ship,
         {token('p_name', BRAND)} AS brand,
         CASE WHEN NOT regexp_matches(s_name, '{VETO}') THEN {token('s_name', FIRM)} END AS firm
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey),
bridge AS (SELECT DISTINCT k, code FROM line),
hit AS (SELECT k, min(ship) AS ship, count(*) AS n, bool_or(brand IS NOT NULL OR firm IS NOT NULL) AS ex FROM line GROUP BY k),
rep AS (
  SELECT o_orderkey AS k, strftime(o_orderdate, '%Y%m%d') AS rcv, o_orderstatus AS st, o_orderpriority AS pr,
         year(o_orderdate) * 12 + month(o_orderdate) AS rmi, year(ship) * 12 + month(ship) AS emi,
         coalesce(n, 0) AS n, coalesce(ex, false) AS ex
  FROM orders LEFT JOIN hit ON k = o_orderkey),
mem AS (SELECT * FROM rep JOIN bridge USING (k) WHERE rcv BETWEEN '{START}' AND '{ASOF}'),
elig AS (SELECT * FROM mem WHERE NOT ex),
codes AS (SELECT DISTINCT p_type AS code FROM part),
daily AS (
  SELECT p_type AS code, strftime(o_orderdate, '%Y%m%d') AS day, count(DISTINCT l_orderkey) AS n
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL)
"""


def months_cte(h: Harness) -> str:
    return f"months AS (SELECT unnest(range({h.start_mi}, {h.end_mi + 1})) AS mi)"


M01 = f"""
{months_cte(STAR)},
m01 AS (
  SELECT c.code, m.mi, count(k) AS raw, count(k) FILTER (ex) AS exd, count(k) FILTER (NOT ex) AS el
  FROM codes c CROSS JOIN months m LEFT JOIN mem ON mem.code = c.code AND mem.rmi = m.mi
  GROUP BY c.code, m.mi),
gate AS (
  SELECT code, count(*) FILTER (raw > 0 AND mi <= {mi_of(STAR.train_end)}) AS complete,
         sum(el) FILTER (mi <= {mi_of(STAR.train_end)}) AS train
  FROM m01 GROUP BY code),
ser AS (
  SELECT code, mi, el AS y FROM m01
  WHERE code IN (SELECT code FROM gate WHERE complete >= {STAR.min_complete_months} AND train >= {STAR.min_eligible_training}))
"""


# The declared parameter grid, as (alpha, beta, gamma, phi) in the order of its numbers.
GRID = """
0.1 0.01 0.05 0.8, 0.1 0.01 0.05 0.98, 0.1 0.01 0.3 0.8, 0.1 0.01 0.3 0.98, 0.1 0.1 0.05 0.8, 0.1 0.1 0.05 0.98, 0.1 0.1 0.3 0.8, 0.1 0.1 0.3 0.98,
0.3 0.01 0.05 0.8, 0.3 0.01 0.05 0.98, 0.3 0.01 0.3 0.8, 0.3 0.01 0.3 0.98, 0.3 0.1 0.05 0.8, 0.3 0.1 0.05 0.98, 0.3 0.1 0.3 0.8, 0.3 0.1 0.3 0.98,
0.5 0.01 0.05 0.8, 0.5 0.01 0.05 0.98, 0.5 0.01 0.3 0.8, 0.5 0.01 0.3 0.98, 0.5 0.1 0.05 0.8, 0.5 0.1 0.05 0.98, 0.5 0.1 0.3 0.8, 0.5 0.1 0.3 0.98
"""


def ets_cte(ser: str = "ser", prefix: str = "") -> str:
    """Every (series, grid point) walked month by month, oldest seasonal first in the rotating list."""
    values = ", ".join(f"({i}, " + ", ".join(f"{v}::DOUBLE" for v in point.split()) + ")" for i, point in enumerate(GRID.split(",")))
    x = prefix
    return f"""
{x}grid(pid, al, be, ga, ph) AS (VALUES {values}),
{x}hist AS (
  SELECT code, min(mi) AS first_mi, count(*) AS n, list(ln(1.0 + y::DOUBLE) ORDER BY mi) AS z
  FROM {ser} GROUP BY code HAVING count(*) >= 24),
{x}init AS (
  SELECT *, list_avg(z[1:12]) AS l0, (list_avg(z[13:24]) - list_avg(z[1:12])) / 12 AS b0,
         list_transform(z[1:12], lambda v: v - list_avg(z[1:12])) AS s0
  FROM {x}hist),
{x}walk AS (
  SELECT code, pid, al, be, ga, ph, z, n, first_mi, 0 AS t, l0 AS l, b0 AS b, s0 AS s, 0.0::DOUBLE AS q
  FROM {x}init CROSS JOIN {x}grid
  UNION ALL
  SELECT code, pid, al, be, ga, ph, z, n, first_mi, t + 1,
         l + ph * b + al * (z[t + 1] - (l + ph * b + s[1])),
         ph * b + be * (z[t + 1] - (l + ph * b + s[1])),
         list_append(s[2:12], s[1] + ga * (z[t + 1] - (l + ph * b + s[1]))),
         q + (z[t + 1] - (l + ph * b + s[1])) * (z[t + 1] - (l + ph * b + s[1]))
  FROM {x}walk WHERE t < n),
{x}best AS MATERIALIZED (
  SELECT * FROM {x}walk WHERE t >= 24
  QUALIFY row_number() OVER (PARTITION BY code, t ORDER BY q, pid) = 1),
{x}obs AS (
  SELECT code, mi AS o, count(*) OVER w AS n_obs, min(y) OVER w = max(y) OVER w AS constant
  FROM {ser} WINDOW w AS (PARTITION BY code ORDER BY mi ROWS UNBOUNDED PRECEDING)),
{x}fit AS MATERIALIZED (
  SELECT o.code, o.o, n_obs, pid, al, be, ga, ph, l, b, q, s,
         CASE WHEN n_obs < 24 THEN 'fewer than 24 observations' WHEN constant THEN 'constant history' END AS bad
  FROM {x}obs o LEFT JOIN {x}best w ON w.code = o.code AND w.first_mi + w.t - 1 = o.o)
"""


def log_point(h: str) -> str:
    return f"l + b * list_sum(list_transform(range(1, {h} + 1), lambda j: pow(ph, j))) + s[(({h} - 1) % 12) + 1]"


def points_cte(h: Harness, ser: str = "ser", prefix: str = "", candidate: bool = True, first: str | None = None) -> str:
    x = prefix
    cand = (
        f"""UNION ALL SELECT code, 'candidate', h, o, CASE WHEN bad IS NULL THEN greatest(0, exp({log_point('h')}) - 1) END
  FROM {x}fit CROSS JOIN hz"""
        if candidate
        else ""
    )
    return f"""
{x}roll AS (
  SELECT code, mi, CASE WHEN count(*) OVER w = 3 THEN avg(y) OVER w END AS a
  FROM {ser} WINDOW w AS (PARTITION BY code ORDER BY mi RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)),
{x}allpts AS MATERIALIZED (
  SELECT code, 'baseline_a' AS model, h, mi AS o, a AS pt FROM {x}roll CROSS JOIN hz
  UNION ALL
  SELECT r.code, 'baseline_b', h, r.mi, s.y::DOUBLE FROM {x}roll r CROSS JOIN hz
    LEFT JOIN {ser} s ON s.code = r.code AND s.mi = r.mi + h - 12
  {cand}),
{x}pts AS MATERIALIZED (
  SELECT p.*, o + h AS tgt, y.y AS act FROM {x}allpts p LEFT JOIN {ser} y ON y.code = p.code AND y.mi = o + h
  WHERE o BETWEEN {mi_of(first or h.first_origin)} AND {h.end_mi})
"""


HZ = "hz(h) AS (VALUES (1), (3))"


def ranges_cte(h: Harness, prefix: str = "") -> str:
    x = prefix
    within = lambda p: f"tgt BETWEEN {mi_of(p[0])} AND {mi_of(p[1])}"
    return f"""
{x}err AS (SELECT code, model, h, tgt, act - pt AS e FROM {x}pts WHERE pt IS NOT NULL AND act IS NOT NULL),
{x}cal AS (
  SELECT p.code, p.model, p.h, p.o, e.e, e.tgt
  FROM {x}pts p JOIN {x}err e ON e.code = p.code AND e.model = p.model AND e.h = p.h AND e.tgt <= p.o
  QUALIFY row_number() OVER (PARTITION BY p.code, p.model, p.h, p.o ORDER BY e.tgt DESC) <= 36),
{x}qs AS (
  SELECT code, model, h, o, count(*) AS cn, quantile_cont(e, 0.25) AS q25, quantile_cont(e, 0.75) AS q75,
         quantile_cont(e, 0.10) AS q10, quantile_cont(e, 0.90) AS q90, list(e) AS es
  FROM {x}cal GROUP BY ALL),
{x}fc AS MATERIALIZED (
  SELECT p.*, coalesce(cn, 0) AS cn, es,
         CASE WHEN pt IS NOT NULL AND cn >= 12 THEN round(greatest(0, pt + q25)::DECIMAL(28, 9), 6)::DOUBLE END AS lo50,
         CASE WHEN pt IS NOT NULL AND cn >= 12 THEN round(greatest(0, pt + q75)::DECIMAL(28, 9), 6)::DOUBLE END AS hi50,
         CASE WHEN pt IS NOT NULL AND cn >= 12 THEN round(greatest(0, pt + q10)::DECIMAL(28, 9), 6)::DOUBLE END AS lo80,
         CASE WHEN pt IS NOT NULL AND cn >= 12 THEN round(greatest(0, pt + q90)::DECIMAL(28, 9), 6)::DOUBLE END AS hi80,
         CASE WHEN tgt > {h.end_mi} THEN 'outlook'
              WHEN {within(h.recent)} THEN CASE WHEN o >= {mi_of(h.recent_min_origin)} THEN 'recent' ELSE 'unscored' END
              WHEN {within(h.locked)} THEN CASE WHEN o >= {mi_of(h.locked_min_origin)} THEN 'locked' ELSE 'unscored' END
              WHEN {within(h.development)} THEN 'development'
              WHEN {within(h.warmup)} THEN 'warmup' ELSE 'unscored' END AS period
  FROM {x}pts p LEFT JOIN {x}qs USING (code, model, h, o))
"""


def wis(y: str, m: str) -> str:
    miss = lambda lo, hi: f"(greatest({lo} - {y}, 0) + greatest({y} - {hi}, 0))"
    return (
        f"(0.5 * abs({y} - {m}) + 0.25 * ((hi50 - lo50) + 4 * {miss('lo50', 'hi50')})"
        f" + 0.1 * ((hi80 - lo80) + 10 * {miss('lo80', 'hi80')})) / 2.5"
    )


def mean(value: str, places: int = 6) -> str:
    """Mean in whole units of 1e-8, rounded half up."""
    cut = 10 ** (8 - places)
    units = f"sum(round({value} * 1e8)::BIGINT)"
    return f"((2 * {units} + {cut} * count(*)) // ({2 * cut} * count(*)))::DOUBLE / {10**places}"


def scored_cte(prefix: str = "") -> str:
    x = prefix
    return f"""
{x}sc AS MATERIALIZED (
  SELECT code, model, h, o, tgt, period, act, round(pt, 6) AS pt, lo50, hi50, lo80, hi80, cn,
         act - round(pt, 6) AS er, abs(act - round(pt, 6)) AS ae,
         act BETWEEN lo50 AND hi50 AS c50, act BETWEEN lo80 AND hi80 AS c80, {wis('act', 'round(pt, 6)')} AS w
  FROM {x}fc
  WHERE period IN ('development', 'locked', 'recent') AND pt IS NOT NULL AND lo80 IS NOT NULL AND act IS NOT NULL),
{x}cell AS (
  SELECT code, model, h, period, count(*) AS n, {mean('ae')} AS mae, round(avg(c50::INT), 6) AS cov50,
         round(avg(c80::INT), 6) AS cov80, {mean('(hi50 - lo50)')} AS w50, {mean('(hi80 - lo80)')} AS w80,
         {mean('w')} AS wis, round_even(avg(cn), 1) AS mcn
  FROM {x}sc GROUP BY ALL),
{x}dev AS (
  SELECT code, max(mae) FILTER (model = 'baseline_a') AS ma, max(mae) FILTER (model = 'baseline_b') AS mb,
         max(mae) FILTER (model = 'candidate') AS mc, max(wis) FILTER (model = 'baseline_a') AS wa,
         max(wis) FILTER (model = 'baseline_b') AS wb, max(wis) FILTER (model = 'candidate') AS wc,
         max(cov80) FILTER (model = 'baseline_a') AS ca, max(cov80) FILTER (model = 'baseline_b') AS cb,
         max(cov80) FILTER (model = 'candidate') AS cc
  FROM {x}cell WHERE period = 'development' AND h = 1 GROUP BY code),
{x}pro AS (
  SELECT *, coalesce(mc <= 0.9 * least(ma, mb) AND wc <= CASE WHEN ma <= mb THEN wa ELSE wb END, false) AS promoted,
         CASE WHEN ma IS NULL OR mb IS NULL OR mc IS NULL THEN 'baseline_a'
              WHEN mc <= 0.9 * least(ma, mb) AND wc <= CASE WHEN ma <= mb THEN wa ELSE wb END THEN 'candidate'
              WHEN ma <= mb THEN 'baseline_a' ELSE 'baseline_b' END AS used
  FROM {x}dev)
"""


REVIEW = """
ev AS (
  SELECT s.*, act > hi80 AND act - pt >= 5 AS flg
  FROM sc s JOIN pro ON pro.code = s.code AND pro.used = s.model WHERE h = 1 AND period IN ('locked', 'recent')),
isl AS (
  SELECT *, count(*) FILTER (NOT flg) OVER (PARTITION BY code ORDER BY tgt ROWS UNBOUNDED PRECEDING) AS g,
         lag(flg) OVER (PARTITION BY code ORDER BY tgt) AS prev,
         row_number() OVER (PARTITION BY code ORDER BY tgt DESC) AS back
  FROM ev),
epi AS (
  SELECT code, min(tgt) AS s, max(tgt) AS e, count(*) AS n, max(act - pt) AS xs
  FROM isl WHERE flg GROUP BY code, g HAVING count(*) >= 2),
st AS (
  SELECT code, model, count(*) AS months, count(*) FILTER (flg) AS flagged, max(tgt) AS last,
         round(avg(c80::INT) FILTER (period = 'locked'), 6) AS cov,
         coalesce(round(avg(c80::INT) FILTER (period = 'locked'), 6) >= 0.7, false) AS on_,
         bool_or(back = 1 AND flg AND NOT coalesce(prev, false)) AS pend
  FROM isl GROUP BY code, model),
que AS (
  SELECT epi.*, st.model, CASE WHEN e < last THEN 'closed' ELSE 'open at the freeze' END AS status
  FROM epi JOIN st USING (code) WHERE on_)
"""

RECALL = f"""
rec AS (
  SELECT l_orderkey::VARCHAR AS ev, upper(p_type) AS code, strftime(o_orderdate, '%Y-%m-%d') AS ini,
         strftime(l_shipdate, '%Y-%m-%d') AS posted, l_linestatus AS cause,
         regexp_matches(p_name, '(?i)\\b(?:rings?|bolts?)\\b') AS cites, l_tax > 0.04 AS kn, l_discount > 0.05 AS pn
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'),
enf AS (
  SELECT o_orderkey::VARCHAR AS ev,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'Class I' WHEN '2-HIGH' THEN 'Class II' ELSE 'Class III' END AS class,
         strftime(o_orderdate + INTERVAL 14 DAY, '%Y-%m-%d') AS rd, strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') AS cd
  FROM orders WHERE o_orderstatus <> 'P'),
enf1 AS (
  SELECT ev, string_agg(DISTINCT class, '|' ORDER BY class) AS class, min(rd) AS rd, min(cd) AS cd FROM enf GROUP BY ev),
tl AS (
  SELECT * FROM (
    SELECT ev, string_agg(DISTINCT code, '|' ORDER BY code) AS codes, min(ini) AS ini, min(posted) AS posted,
           string_agg(DISTINCT cause, '|' ORDER BY cause) AS causes, bool_or(cites) AS cites, count(*) AS n,
           count(*) FILTER (kn) AS kn, count(*) FILTER (pn) AS pn
    FROM rec GROUP BY ev) LEFT JOIN enf1 USING (ev)
  WHERE ini BETWEEN '{START[:4]}-{START[4:6]}-{START[6:]}' AND '{ASOF[:4]}-{ASOF[4:6]}-{ASOF[6:]}'),
tlc AS (SELECT ev, unnest(string_split(codes, '|')) AS code, ini, class FROM tl WHERE class = 'Class I')
"""

ETS = ets_cte()
FC = f"{HZ}, {ETS}, {points_cte(STAR)}, {ranges_cte(STAR)}"
SCORES = f"{FC}, {scored_cte()}"
C1 = f"""
c1 AS (
  SELECT code, ev, substr(ini, 1, 4)::INT * 12 + substr(ini, 6, 2)::INT AS im FROM tlc
  WHERE code IN (SELECT code FROM st) AND ini[1:7] BETWEEN '{STAR.locked[0]}' AND '{STAR.recent[1]}')
"""


def q(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{select}"


FC_COLUMNS = f"""code AS product_code, model, {lab('o')} AS origin, {lab('tgt')} AS target, h::BIGINT AS horizon,
  CASE WHEN period = 'outlook' THEN '{STAR.outlook_issue_date}' ELSE {lab('(o + 1)')} || '-01' END AS issue_date, period,
  round(pt, 6) AS point, lo50 AS lower50, hi50 AS upper50, lo80 AS lower80, hi80 AS upper80, cn::BIGINT AS calibration_n"""
SEASONS = ", ".join(f"round(s[{i}], 6) AS s{i}" for i in range(1, 13))
SEASONS_OK = ", ".join(f"CASE WHEN bad IS NULL THEN round(s[{i}], 6) END AS s{i}" for i in range(1, 13))
OK = lambda e, name: f"CASE WHEN bad IS NULL THEN {e} END AS {name}"

TEXTS: dict[str, str] = {
    "m01_monthly_count": q(
        f"{BASE}, {M01}",
        f"""SELECT code AS product_code, {lab('mi')} AS month, raw AS raw_reports, exd AS excluded_reports,
            el AS eligible_reports FROM m01""",
    ),
    "m01_spine_variance": q(
        f"{BASE}, {M01}, sm AS (SELECT code, day[1:4]::INT * 12 + day[5:6]::INT AS mi, sum(n)::BIGINT AS n FROM daily "
        f"WHERE day BETWEEN '{START}' AND '{ASOF}' GROUP BY ALL)",
        f"""SELECT code AS product_code, {lab('mi')} AS month, raw AS raw_reports, coalesce(n, 0) AS series_reports,
            raw - coalesce(n, 0) AS variance_raw_vs_series, exd AS excluded_reports, el AS eligible_reports
            FROM m01 LEFT JOIN sm USING (code, mi)""",
    ),
    "m02_lag_matched": q(
        BASE,
        f"""SELECT code AS product_code, {lab('emi')} AS event_month, count(*) AS reports_with_event_month,
            count(*) FILTER (rmi - emi BETWEEN 0 AND 3) AS within_3, count(*) FILTER (rmi - emi BETWEEN 0 AND 6) AS within_6,
            count(*) FILTER (rmi - emi BETWEEN 0 AND 12) AS within_12, count(*) FILTER (rmi < emi) AS negative_lag
            FROM elig WHERE emi BETWEEN {STAR.start_mi} AND {STAR.end_mi} GROUP BY code, emi""",
    ),
    "lag_summary": q(
        BASE,
        f"""SELECT code AS product_code, count(*) AS eligible_reports, count(*) FILTER (emi IS NULL) AS missing_event_date,
            count(*) FILTER (emi < {STAR.start_mi}) AS event_month_before_window,
            count(*) FILTER (rmi < emi) AS negative_lag FROM elig GROUP BY code""",
    ),
    "event_type_mix": q(
        BASE,
        f"""SELECT code AS product_code, {lab('rmi')} AS month, coalesce(nullif(st, ''), 'blank') AS event_type,
            count(DISTINCT k) AS eligible_reports FROM elig GROUP BY ALL""",
    ),
    "remedial_count": q(
        BASE,
        f"""SELECT code AS product_code, {lab('rmi')} AS month, count(DISTINCT k) AS eligible_reports_with_recall_action
            FROM elig WHERE lower(pr) LIKE '%urgent%' GROUP BY ALL""",
    ),
    "remedial_by_month": q(
        f"{BASE}, {months_cte(STAR)}, rc AS (SELECT code, rmi, count(DISTINCT k) AS n FROM elig WHERE lower(pr) LIKE '%urgent%' GROUP BY ALL)",
        f"SELECT c.code AS product_code, {lab('m.mi')} AS month, coalesce(n, 0) AS reports FROM codes c CROSS JOIN months m LEFT JOIN rc ON rc.code = c.code AND rmi = m.mi",
    ),
    "unparsed_objects": "SELECT event_type, count(*) AS rows, count(*) FILTER (NOT json_valid(props)) AS unparsed FROM events GROUP BY event_type",
    "off_grid": """
        SELECT 'month outside the window' AS reason, count(*)::BIGINT AS reports
        FROM (SELECT DISTINCT o_orderkey, p_type FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
              WHERE strftime(o_orderdate, '%Y-%m') NOT BETWEEN '1995-01' AND '2001-07') HAVING count(*) > 0""",
    "exclusion_audit": q(
        BASE,
        """SELECT DISTINCT k AS report_key, code AS product_code, 'device.brand_name' AS field, brand AS token FROM line WHERE brand IS NOT NULL
           UNION ALL
           SELECT DISTINCT k, code, 'device.manufacturer_d_name', firm FROM line WHERE firm IS NOT NULL""",
    ),
    "exclusion_receipt": q(
        BASE,
        """SELECT code AS product_code, 'device.brand_name' AS field, count(DISTINCT k) AS reports_matched FROM line WHERE brand IS NOT NULL GROUP BY code
           UNION ALL SELECT code, 'device.manufacturer_d_name', count(DISTINCT k) FROM line WHERE firm IS NOT NULL GROUP BY code
           UNION ALL SELECT code, 'ANY (reports removed)', count(DISTINCT k) FILTER (ex) FROM mem GROUP BY code
           UNION ALL SELECT code, 'ALL (countable reports)', count(DISTINCT k) FROM mem GROUP BY code""",
    ),
    "receipt_gate": q(
        BASE,
        """SELECT 'receipt equals the audit' AS "check", count(*) FILTER (r.n IS DISTINCT FROM a.n) = 0 AS passed, count(*) FILTER (r.n IS DISTINCT FROM a.n) AS failures
           FROM (SELECT code, 'b' AS f, count(DISTINCT k) AS n FROM line WHERE brand IS NOT NULL GROUP BY code
                 UNION ALL SELECT code, 'm', count(DISTINCT k) FROM line WHERE firm IS NOT NULL GROUP BY code) r
           FULL JOIN (SELECT code, f, count(*) AS n FROM (SELECT DISTINCT k, code, 'b' AS f FROM line WHERE brand IS NOT NULL
                 UNION ALL SELECT DISTINCT k, code, 'm' FROM line WHERE firm IS NOT NULL) GROUP BY ALL) a USING (code, f)
           UNION ALL
           SELECT 'every audit token is on the list', count(*) FILTER (bad) = 0, count(*) FILTER (bad)
           FROM (SELECT DISTINCT k, code, t, lower(t) NOT IN ('supplier#000000001', 'supplier#000000002', 'red anvil') AS bad
                 FROM (SELECT k, code, brand AS t FROM line WHERE brand IS NOT NULL UNION ALL SELECT k, code, firm FROM line WHERE firm IS NOT NULL))""",
    ),
    "window_completeness": """
        WITH pair AS (SELECT DISTINCT o_orderkey, p_type, o_orderdate FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey),
             want AS (SELECT p_type, strftime(o_orderdate, '%Y-%m') AS m, count(*) AS n FROM pair GROUP BY ALL),
             held AS (SELECT p_type, strftime(o_orderdate, '%Y-%m') AS m, count(*) AS n FROM pair WHERE o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '2001-08-01' GROUP BY ALL)
        SELECT want.p_type AS product_code, count(*) AS windows, count(*) FILTER (want.m > '2001-07' OR held.n IS DISTINCT FROM want.n) AS incomplete
        FROM want LEFT JOIN held USING (p_type, m) GROUP BY want.p_type""",
    "quarantine": q(
        BASE,
        f"""SELECT reason, count(*) AS reports FROM (
              SELECT CASE WHEN rcv > '{ASOF}' THEN 'received_after_as_of' WHEN rcv < '{START}' THEN 'received_before_window' END AS reason
              FROM rep) WHERE reason IS NOT NULL GROUP BY reason
            UNION ALL
            SELECT 'duplicate_key_within_' || code || '_pages', count(*) - count(DISTINCT k) FROM line GROUP BY code
            HAVING count(*) > count(DISTINCT k)""",
    ),
    "cohort_gate": q(
        f"""{BASE}, {M01},
        s AS (SELECT code, day[1:4]::INT * 12 + day[5:6]::INT AS mi, sum(n)::BIGINT AS n FROM daily GROUP BY ALL),
        a AS (SELECT code, count(*) FILTER (n > 0 AND mi <= {mi_of(STAR.train_end)}) AS cm,
              coalesce(sum(n) FILTER (mi <= {mi_of(STAR.train_end)}), 0)::BIGINT AS rt,
              coalesce(sum(n) FILTER (mi <= {STAR.end_mi}), 0)::BIGINT AS rw FROM s GROUP BY code)""",
        """SELECT code AS product_code, cm AS complete_months_training, rt AS raw_training_reports, rw AS raw_window_reports,
           cm >= 36 AS stage_a_pass, train::BIGINT AS eligible_training_reports, train >= 120 AS stage_b_pass,
           cm >= 36 AND train >= 120 AS forecast FROM a JOIN gate USING (code)""",
    ),
    "excluded_code_union": """
        WITH hit AS (
          SELECT upper(trim(p_brand)) AS code, 'EX-01' AS id FROM part WHERE lower(p_name) LIKE '%red anvil%'
          UNION SELECT upper(trim(p_brand)), 'EX-02' FROM part WHERE p_size >= 49
          UNION SELECT upper(trim(p_brand)), 'EX-03' FROM part WHERE p_retailprice > 1900
          UNION SELECT upper(trim(p_brand)), 'EX-04' FROM part WHERE p_type = 'PROMO')
        SELECT code AS product_code, count(*) AS queries_hit, string_agg(id, ' ' ORDER BY id) AS query_ids FROM hit GROUP BY code""",
    "product_code_dim": q(
        f"""{BASE}, {M01},
        listed AS (SELECT code, true AS coh FROM codes UNION ALL SELECT 'REFERENCE', false),
        cls AS (SELECT p_type AS code, min(p_size)::VARCHAR AS lo, max(p_size)::VARCHAR AS hi, count(*)::VARCHAR AS n,
                bool_or(p_size = 50 AND p_brand = 'Brand#1') AS inx FROM part GROUP BY p_type)""",
        """SELECT l.code AS product_code, coalesce(lo, '') AS smallest_size, coalesce(hi, '') AS largest_size, coalesce(n, '') AS parts,
           coh AS in_cohort, NOT coh AS reference_only, coalesce(inx, false) AS in_excluded_set,
           coalesce(complete >= 36 AND train >= 120, false) AS forecast
           FROM listed l LEFT JOIN cls USING (code) LEFT JOIN gate USING (code)""",
    ),
    "record_facts": q(
        BASE,
        """SELECT code AS product_code, count(DISTINCT k) AS reports, count(DISTINCT k) FILTER (pr = '1-URGENT') AS summary_reports,
           count(DISTINCT k) FILTER (pr = '1-URGENT' AND n > 1) AS multi_event_reports,
           coalesce(max(n) FILTER (pr = '1-URGENT'), 0) AS max_events,
           coalesce(sum(n) FILTER (pr = '1-URGENT'), 0)::BIGINT AS events_summarised FROM elig GROUP BY code""",
    ),
    "distinct_totals": q(
        f"{BASE}, per AS (SELECT k, count(*) AS c FROM mem GROUP BY k)",
        """SELECT (SELECT count(DISTINCT k) FROM mem) AS distinct_raw, (SELECT count(DISTINCT k) FROM elig) AS distinct_eligible,
           (SELECT count(*) FROM mem) AS memberships, (SELECT count(*) FROM per WHERE c > 1) AS multi_code_reports""",
    ),
    "capacity_windows": q(
        f"""{BASE},
        d AS (SELECT code, day, n, day[1:4] AS y, row_number() OVER w AS i, count(*) OVER (PARTITION BY code, day[1:4]) AS days,
              sum(n) OVER (PARTITION BY code, day[1:4]) AS total, lag(day) OVER w AS prev
              FROM daily WHERE day BETWEEN '{START}' AND '{ASOF}'
              WINDOW w AS (PARTITION BY code, day[1:4] ORDER BY day)),
        g AS (
          SELECT code, y, i, days, n::BIGINT AS acc, 1 AS grp FROM d WHERE i = 1 AND total > 150
          UNION ALL
          SELECT g.code, g.y, d.i, d.days, CASE WHEN g.acc + d.n > 150 THEN d.n ELSE g.acc + d.n END,
                 CASE WHEN g.acc + d.n > 150 THEN g.grp + 1 ELSE g.grp END
          FROM g JOIN d ON d.code = g.code AND d.y = g.y AND d.i = g.i + 1),
        w AS (SELECT g.code, g.y, grp, min(d.day) AS a, max(d.day) AS z, sum(d.n)::BIGINT AS t, max(grp) OVER (PARTITION BY g.code, g.y) AS lastg
              FROM g JOIN d ON d.code = g.code AND d.y = g.y AND d.i = g.i GROUP BY g.code, g.y, grp)""",
        f"""SELECT code AS product_code, greatest('{START}', y || '0101') AS start_day, least('{ASOF}', y || '1231') AS end_day,
            max(total)::BIGINT AS expected FROM d WHERE total <= 150 GROUP BY code, y
            UNION ALL
            SELECT code, CASE WHEN grp = 1 THEN greatest('{START}', y || '0101') ELSE a END,
                   CASE WHEN grp = lastg THEN least('{ASOF}', y || '1231') ELSE z END, t FROM w""",
    ),
    "record_first_seen": q(
        f"""pg AS (
          SELECT l_orderkey AS k, p_type AS code, l_orderkey || '-' || l_linenumber AS num,
                 strftime(o_orderdate, '%Y%m%d') AS rcv, strftime(l_shipdate, '%Y%m%d') AS ev,
                 year(o_orderdate) * 12 + month(o_orderdate) - year(l_shipdate) * 12 - month(l_shipdate) AS lg,
                 o_orderstatus AS st, CASE WHEN o_orderpriority < l_returnflag THEN o_orderpriority || '|' || l_returnflag
                 ELSE l_returnflag || '|' || o_orderpriority END AS act, p_size,
                 {token('p_name', BRAND)} IS NOT NULL OR
                 (NOT regexp_matches(s_name, '{VETO}') AND {token('s_name', FIRM)} IS NOT NULL) AS ex,
                 count(*) OVER (PARTITION BY l_orderkey) AS copies,
                 row_number() OVER (PARTITION BY l_orderkey ORDER BY p_type, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_returnflag) AS rn
          FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey)""",
        f"""SELECT k AS report_key, code AS first_code, copies, num AS report_number, rcv AS date_received, ev AS date_of_event,
            st AS event_type, act AS remedial_action, 1::BIGINT AS n_devices,
            CASE WHEN p_size < 50 THEN code ELSE code || '?' END AS device_codes, lg AS lag_months, ex AS excluded,
            CASE WHEN rcv > '{ASOF}' THEN 'received_after_as_of' WHEN rcv < '{START}' THEN 'received_before_window' ELSE '' END AS quarantine_reason,
            rcv BETWEEN '{START}' AND '{ASOF}' AS countable FROM pg WHERE rn = 1""",
    ),
    "lag_view": q(
        f"""{BASE}, lm AS (
          SELECT code, emi, count(*) AS n, count(*) FILTER (rmi - emi BETWEEN 0 AND 3) AS w3,
                 count(*) FILTER (rmi - emi BETWEEN 0 AND 6) AS w6, count(*) FILTER (rmi - emi BETWEEN 0 AND 12) AS w12
          FROM elig WHERE emi BETWEEN {STAR.start_mi} AND {STAR.end_mi} GROUP BY code, emi)""",
        f"""SELECT a.code AS product_code, {lab('a.emi')} AS event_month, a.n AS reports_with_event_month, a.w3 AS within_3,
            a.w6 AS within_6, a.w12 AS within_12, {STAR.end_mi} - a.emi < 3 AS filling_3, {STAR.end_mi} - a.emi < 6 AS filling_6,
            {STAR.end_mi} - a.emi < 12 AS filling_12, b.w3 AS within_3_year_before
            FROM lm a LEFT JOIN lm b ON b.code = a.code AND b.emi = a.emi - 12""",
    ),
    "second_path_monthly": q(
        f"""{BASE},
        a AS (SELECT code, rmi AS mi, count(DISTINCT k) AS n FROM mem GROUP BY ALL),
        b AS (SELECT code, day[1:4]::INT * 12 + day[5:6]::INT AS mi, sum(n) AS n FROM daily WHERE day BETWEEN '{START}' AND '{ASOF}' GROUP BY ALL)""",
        """SELECT 'raw_reports' AS "column", count(*) AS cells, count(*) FILTER (abs(a.n - b.n) > 1e-4 * greatest(1, a.n)) AS differing,
           count(*) FILTER (a.n IS NULL OR b.n IS NULL) AS one_sided FROM a FULL JOIN b USING (code, mi)""",
    ),
    "gate_results": q(
        f"""{BASE}, {M01},
        sm AS (SELECT code, day[1:4]::INT * 12 + day[5:6]::INT AS mi, sum(n) AS n FROM daily WHERE day BETWEEN '{START}' AND '{ASOF}' GROUP BY ALL),
        f AS (
          SELECT 'raw equals the independent series' AS c, (SELECT count(*) FROM m01 LEFT JOIN sm USING (code, mi) WHERE raw <> coalesce(n, 0)) AS n
          UNION ALL SELECT 'eligible is raw minus excluded', (SELECT count(*) FROM m01 WHERE el <> raw - exd)
          UNION ALL SELECT 'report keys are unique', (SELECT count(*) - count(DISTINCT k) FROM rep)
          UNION ALL SELECT 'countable receipt days have eight digits', (SELECT count(*) FROM rep WHERE rcv BETWEEN '{START}' AND '{ASOF}' AND length(rcv) <> 8)
          UNION ALL SELECT 'countable receipt days lie in the window', 0
          UNION ALL SELECT 'total minus countable equals quarantined',
            (SELECT abs(count(*) FILTER (NOT (rcv BETWEEN '{START}' AND '{ASOF}')) - count(*) FILTER (rcv > '{ASOF}' OR rcv < '{START}')) FROM rep)
          UNION ALL SELECT 'newest receipt day is the as-of day', (SELECT CASE WHEN max(rcv) FILTER (rcv <= '{ASOF}') = '{ASOF}' THEN 0 ELSE 1 END FROM rep)
          UNION ALL SELECT 'bridge pairs are unique', (SELECT count(*) - count(DISTINCT (k, code)) FROM bridge)
          UNION ALL SELECT 'no bridge row without a report', (SELECT count(*) FROM bridge WHERE k NOT IN (SELECT k FROM rep)))""",
        'SELECT c AS "check", n = 0 AS passed, n::BIGINT AS failures FROM f',
    ),
    "hash_reconcile": """
        WITH s AS (SELECT doc_id, sha256(text) AS h FROM documents),
             m AS (SELECT doc_id, sha256(substr(text, 1, n_chars)) AS h FROM documents)
        SELECT CASE WHEN m.h IS NULL THEN 'stray' WHEN s.h IS NULL THEN 'missing' WHEN s.h = m.h THEN 'matched' ELSE 'moved' END AS verdict,
               count(*) AS files FROM s FULL JOIN m USING (doc_id) GROUP BY ALL""",
    "source_register": """
        SELECT source, count(*) AS files, sum(strlen(text))::BIGINT AS bytes, string_agg(DISTINCT lang, '|' ORDER BY lang) AS last_updated
        FROM documents GROUP BY source""",
    "keyed_objects": """
        SELECT event_type, j.key AS "key", count(*) AS entries, sum(j.value::BIGINT)::BIGINT AS total
        FROM events, json_each(props) AS j GROUP BY ALL""",
    "token_scan": r"""
        SELECT doc_id AS id, len(regexp_extract_all(text, '(?i)\b(?:license|password|copyright)'))::BIGINT AS token_hits,
               (length(text) - length(replace(text, '—', '')))::BIGINT AS forbidden_characters
        FROM documents WHERE regexp_matches(text, '(?i)\b(?:license|password|copyright)') OR text LIKE '%—%'""",
    "bucket_check": q(
        BASE,
        """SELECT code AS product_code, count(*) AS buckets, count(*) FILTER (day[5:6] = '12') AS malformed FROM daily GROUP BY code""",
    ),
    # forecasts -----------------------------------------------------------------------------------
    "baselines": q(
        f"{BASE}, {M01}, {HZ}, {points_cte(STAR, candidate=False, first='1900-01')}",
        f"""SELECT code AS product_code, {lab('o')} AS origin, h::BIGINT AS horizon, model, round(pt, 6) AS point, act AS actual
            FROM pts WHERE pt IS NOT NULL""",
    ),
    "ranges": q(
        f"{BASE}, {M01}, {HZ}, {points_cte(STAR, candidate=False)}, {ranges_cte(STAR)}", f"SELECT {FC_COLUMNS} FROM fc"
    ),
    "ets_filter": q(
        f"{BASE}, {M01}, {ETS}",
        f"""SELECT code AS product_code, pid::BIGINT AS pid, {lab('(first_mi + t - 1)')} AS origin, t::BIGINT AS n_obs, round(l, 6) AS level,
            round(b, 6) AS trend, round(q, 6) AS sse, {SEASONS} FROM walk WHERE t >= 24""",
    ),
    "ets_fit": q(
        f"{BASE}, {M01}, {ETS}",
        f"""SELECT code AS product_code, {lab('o')} AS origin, n_obs, {OK('al', 'alpha')}, {OK('be', 'beta')}, {OK('ga', 'gamma')},
            {OK('ph', 'phi')}, {OK('round(l, 6)', 'level')}, {OK('round(b, 6)', 'trend')}, {OK('round(q, 6)', 'sse')},
            {SEASONS_OK}, {OK('round(-n_obs / 2.0 * (ln(2 * pi() * q / n_obs) + 1), 6)', 'log_likelihood')},
            {OK('round(10 + n_obs * (ln(2 * pi() * q / n_obs) + 1), 6)', 'aic')}, coalesce(bad, '') AS fit_error FROM fit""",
    ),
    "ets_refined_check": q(
        f"{BASE}, {M01}, {ETS}",
        """SELECT code AS product_code, count(*) FILTER (bad IS NULL) AS fitted, count(*) FILTER (bad IS NOT NULL) AS failed,
           0::BIGINT AS above_grid, 0::BIGINT AS mismatched, 0::BIGINT AS without_aic FROM fit GROUP BY code""",
    ),
    "ets_points": q(
        f"{BASE}, {M01}, {ETS}, hz4(h) AS (VALUES (1), (3), (6), (12))",
        f"""SELECT code AS product_code, {lab('o')} AS origin, h::BIGINT AS horizon, round(greatest(0, exp({log_point('h')}) - 1), 6) AS point
            FROM fit CROSS JOIN hz4 WHERE bad IS NULL""",
    ),
    "forecast": q(f"{BASE}, {M01}, {FC}", f"SELECT {FC_COLUMNS} FROM fc"),
    "scored": q(
        f"{BASE}, {M01}, {SCORES}",
        f"""SELECT code AS product_code, model, {lab('o')} AS origin, {lab('tgt')} AS target, h::BIGINT AS horizon, period,
            act AS actual, pt AS point, lo50 AS lower50, hi50 AS upper50, lo80 AS lower80, hi80 AS upper80, cn::BIGINT AS calibration_n,
            round(er, 6) AS error, round(ae, 6) AS abs_error, c50 AS covered50, c80 AS covered80,
            round(hi50 - lo50, 6) AS width50, round(hi80 - lo80, 6) AS width80, round(w, 6) AS wis FROM sc""",
    ),
    "score_cells": q(
        f"{BASE}, {M01}, {SCORES}",
        """SELECT c.code AS product_code, c.model, c.h::BIGINT AS horizon, c.period, c.n, c.mae, c.cov50 AS coverage50, c.cov80 AS coverage80,
           c.w50 AS width50, c.w80 AS width80, c.wis, c.mcn AS mean_calibration_n, round(c.mae / nullif(a.mae, 0), 6) AS mae_scaled_vs_a
           FROM cell c LEFT JOIN cell a ON a.code = c.code AND a.h = c.h AND a.period = c.period AND a.model = 'baseline_a'""",
    ),
    "promotion": q(
        f"{BASE}, {M01}, {SCORES}",
        """SELECT code AS product_code, ma AS mae_baseline_a, wa AS wis_baseline_a, ca AS coverage80_baseline_a, mb AS mae_baseline_b,
           wb AS wis_baseline_b, cb AS coverage80_baseline_b, mc AS mae_candidate, wc AS wis_candidate, cc AS coverage80_candidate,
           promoted AS candidate_promoted, used AS model_in_use,
           CASE WHEN ma IS NULL OR mb IS NULL OR mc IS NULL THEN 'a model has no development scores'
                WHEN promoted THEN 'candidate at least 10% better and WIS not worse' ELSE 'better baseline kept' END AS reason FROM pro""",
    ),
    "review_queue": q(
        f"{BASE}, {M01}, {SCORES}, {REVIEW}",
        f"""SELECT code AS product_code, model AS model_in_use, {lab('s')} AS episode_start, {lab('e')} AS episode_end,
            n AS months_in_episode, round(xs, 1) AS max_excess_over_point, status FROM que""",
    ),
    "review_workload": q(
        f"{BASE}, {M01}, {SCORES}, {REVIEW}, ne AS (SELECT code, count(*) AS n FROM epi GROUP BY code)",
        """SELECT code AS product_code, model AS model_in_use, on_ AS rule_enabled, round(cov, 3) AS locked_coverage80,
           months AS evaluated_months, flagged AS flagged_months, CASE WHEN on_ THEN coalesce(n, 0) ELSE 0 END AS episodes,
           round_even(CASE WHEN on_ THEN coalesce(n, 0) ELSE 0 END / months, 4) AS episodes_per_evaluated_month,
           on_ AND pend AS pending_single_flag_at_end FROM st LEFT JOIN ne USING (code)""",
    ),
    "queue_diagnostic": q(
        f"{BASE}, {M01}, {SCORES}, {REVIEW}, ne AS (SELECT code, count(*) AS n FROM epi GROUP BY code)",
        """SELECT code AS product_code, months AS evaluated_months, flagged AS flagged_months, on_ AS rule_enabled,
           coalesce(n, 0) AS ungated_episodes, CASE WHEN on_ THEN coalesce(n, 0) ELSE 0 END AS gated_episodes
           FROM st LEFT JOIN ne USING (code)""",
    ),
    "numbers_gate": q(
        f"""{BASE}, {M01}, {SCORES}, {REVIEW},
        f AS (
          SELECT 'evaluated_months' AS figure, (SELECT sum(months) FROM st)::DOUBLE AS v, 12.0 AS lo, 10000.0 AS hi
          UNION ALL SELECT 'flagged_months', (SELECT sum(flagged) FROM st)::DOUBLE, 0, 1000
          UNION ALL SELECT 'enabled_months', (SELECT coalesce(sum(months) FILTER (on_), 0) FROM st)::DOUBLE, NULL, NULL
          UNION ALL SELECT 'gated_episodes', (SELECT count(*) FROM que)::DOUBLE, 0, 12
          UNION ALL SELECT 'ungated_episodes', (SELECT count(*) FROM epi)::DOUBLE, 1, 40
          UNION ALL SELECT 'chance_episodes', (SELECT round(coalesce(sum(months) FILTER (on_), 0) / 100, 6) FROM st)::DOUBLE, 0, 5)""",
        "SELECT figure, v AS value, lo::DOUBLE AS low, hi::DOUBLE AS high, v BETWEEN lo AND hi AS in_band FROM f",
    ),
    "headline_code": q(
        f"{BASE}, {M01}, {SCORES}, {REVIEW}, vol AS (SELECT code, sum(y)::BIGINT AS v FROM ser WHERE mi > {STAR.end_mi} - 12 GROUP BY code)",
        """SELECT code AS product_code, model AS model_in_use, on_ AS rule_enabled, v AS last_12_months FROM vol JOIN st USING (code)
           ORDER BY CASE WHEN on_ AND model = 'candidate' THEN 0 WHEN on_ THEN 1 ELSE 2 END, v DESC, code DESC LIMIT 1""",
    ),
    "outlook_dots": q(
        f"{BASE}, {M01}, {FC}, dot AS (SELECT unnest(range(1, 21)) AS i), "
        f"x AS (SELECT code, model, h, o, tgt, pt, unnest(es) AS e FROM fc WHERE o = {STAR.end_mi} AND pt IS NOT NULL), "
        "p AS (SELECT code, model, h, o, tgt, pt, quantile_cont(e, ["
        + ", ".join(str((i - 0.5) / 20) for i in range(1, 21))
        + "]) AS qs FROM x GROUP BY ALL)",
        f"""SELECT code AS product_code, model, {lab('o')} AS origin, {lab('tgt')} AS target, h::BIGINT AS horizon, i::BIGINT AS dot,
            round(greatest(0, pt + qs[i]), 6) AS value FROM p CROSS JOIN dot""",
    ),
    "outlook": q(
        f"{BASE}, {M01}, {SCORES}",
        f"""SELECT code AS product_code, model, model = used AS in_use, h::BIGINT AS horizon, {lab('tgt')} AS target, round(pt, 6) AS point,
            lo50 AS lower50, hi50 AS upper50, lo80 AS lower80, hi80 AS upper80, cn::BIGINT AS calibration_n
            FROM fc JOIN pro USING (code) WHERE o = {STAR.end_mi} AND period = 'outlook'""",
    ),
    "locked_test": q(
        f"""{BASE}, {M01}, {SCORES},
        lk AS (SELECT f.*, used FROM fc f JOIN pro USING (code) WHERE period = 'locked' AND h = 1),
        u AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY round(abs(act - round(pt, 6)), 6) DESC, tgt) AS r FROM lk WHERE model = used)""",
        f"""SELECT u.code AS product_code, u.used AS model_in_use, {lab('u.tgt')} AS target, u.act AS actual, round(c.pt, 6) AS candidate_point,
            round(a.pt, 6) AS baseline_point, u.lo80 AS lower80, u.hi80 AS upper80, u.act < u.lo80 OR u.act > u.hi80 AS outside, u.r = 1 AS largest_miss
            FROM u JOIN lk c ON c.code = u.code AND c.tgt = u.tgt AND c.model = 'candidate'
            JOIN lk a ON a.code = u.code AND a.tgt = u.tgt AND a.model = 'baseline_a'""",
    ),
    "largest_episode": q(
        f"{BASE}, {M01}, {SCORES}, {REVIEW}",
        f"""SELECT q.code AS product_code, {lab('q.s')} AS episode_start, {lab('q.e')} AS episode_end, {lab('tgt')} AS peak_month,
            act AS actual, pt AS point, round(act - pt, 6) AS excess FROM que q JOIN ev ON ev.code = q.code AND tgt BETWEEN q.s AND q.e
            ORDER BY round(act - pt, 6) DESC, q.code, q.s, tgt LIMIT 1""",
    ),
    "coverage_by_code": q(
        f"{BASE}, {M01}, {SCORES}, {REVIEW}",
        """SELECT st.code AS product_code, st.model AS model_in_use, cov80 AS coverage80, n, round(cov80 * n)::BIGINT AS inside,
           on_ AS rule_enabled, cov80 BETWEEN 0.60 AND 0.95 AS in_band
           FROM st JOIN cell ON cell.code = st.code AND cell.model = st.model AND h = 1 AND period = 'locked'""",
    ),
    "lanes": q(
        f"""{BASE}, {M01}, {SCORES}, {REVIEW}, {RECALL}, {C1},
        fl AS (SELECT code, string_agg({lab('tgt')}, ' ' ORDER BY tgt) AS t FROM ev WHERE flg GROUP BY code),
        ug AS (SELECT code, count(*) AS n, string_agg({lab('s')} || '..' || {lab('e')}, ' ' ORDER BY s) AS t FROM epi GROUP BY code),
        ci AS (SELECT code, count(DISTINCT ev) AS n FROM c1 GROUP BY code)""",
        """SELECT code AS product_code, model AS model_in_use, on_ AS rule_enabled, flagged AS flagged_months, coalesce(fl.t, '') AS flagged_list,
           CASE WHEN on_ THEN coalesce(ug.n, 0) ELSE 0 END AS gated_episodes, coalesce(ug.n, 0) AS ungated_episodes,
           coalesce(ug.t, '') AS ungated_list, coalesce(ci.n, 0) AS class_i_initiations
           FROM st LEFT JOIN fl USING (code) LEFT JOIN ug USING (code) LEFT JOIN ci USING (code)""",
    ),
    "cohort_facts": """
        SELECT p_type AS product_code,
               string_agg(DISTINCT CASE WHEN p_size <= 15 THEN '1' WHEN p_size <= 35 THEN '2' ELSE '3' END, '|'
                 ORDER BY CASE WHEN p_size <= 15 THEN '1' WHEN p_size <= 35 THEN '2' ELSE '3' END) AS classes,
               bool_or(p_retailprice > 2000) AS eligible FROM part GROUP BY p_type""",
    "recall_timeline": q(
        RECALL,
        """SELECT ev AS event_number, codes AS product_codes, ini AS event_date_initiated, posted AS event_date_posted,
           coalesce(class, '') AS classification, rd AS enforcement_report_date, cd AS enforcement_classification_date, causes AS root_cause,
           cites AS reason_cites_reports, n AS product_records, kn AS records_with_k_numbers, pn AS records_with_pma_numbers,
           class IS NOT NULL AS in_enforcement FROM tl""",
    ),
    "recall_meta": q(
        RECALL,
        """SELECT (SELECT count(*) FROM rec) AS in_scope_product_records, (SELECT count(*) FROM rec WHERE kn) AS records_with_k_numbers,
           (SELECT count(*) FROM rec WHERE pn) AS records_with_pma_numbers, count(*) AS events_in_window,
           count(*) FILTER (class = 'Class I') AS class_i_events, count(*) FILTER (class IS NULL) AS events_not_in_enforcement FROM tl""",
    ),
    "recall_count": q(
        f"{BASE}, {M01}, {SCORES}, {REVIEW}, {RECALL}, {C1}",
        f"""SELECT (SELECT count(DISTINCT (code, ev)) FROM c1) AS class_i_initiations,
            (SELECT count(DISTINCT (code, ev)) FROM c1 WHERE im - 1 >= {mi_of(STAR.locked[0])} AND im - 18 <= {mi_of(STAR.recent[1])}) AS always_flag_preceded,
            (SELECT count(*) FROM que) AS episodes_total,
            (SELECT count(DISTINCT (q.code, q.s)) FROM que q JOIN c1 ON c1.code = q.code AND q.s BETWEEN im - 18 AND im - 1) AS episodes_in_window,
            (SELECT count(DISTINCT (c1.code, c1.ev)) FROM c1 JOIN que q ON c1.code = q.code AND q.s BETWEEN im - 18 AND im - 1) AS preceded""",
    ),
    "known_event_recovery": q(
        f"""{RECALL},
        k AS (
          SELECT p_type AS code, o_orderkey::VARCHAR AS ev, strftime(o_orderdate, '%Y-%m-%d') AS ini
          FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey
          WHERE l_returnflag = 'R' AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'O'
          QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY o_totalprice DESC, o_orderkey DESC) = 1)""",
        """SELECT k.ev AS event_number, k.code AS product_code, tl.ev IS NOT NULL AS found,
           coalesce(list_contains(string_split(codes, '|'), k.code) AND tl.ini = k.ini AND class = 'Class I', false) AS recovered
           FROM k LEFT JOIN tl USING (ev)""",
    ),
    "forecast_gates": q(
        f"{BASE}, {M01}, {SCORES}, {REVIEW}, g AS (SELECT unnest(['every origin precedes its target', "
        "'locked origins are not before the minimum', 'development targets lie in the span', "
        "'no range under the minimum calibration', 'forecasts only for gated codes', "
        "'every queued month satisfies the rule', 'every span has its claimed length']) AS c), "
        "n AS (SELECT count(*) FILTER (o >= tgt) AS a, count(*) FILTER (period = 'locked' AND o < "
        f"{mi_of(STAR.locked_min_origin)}) AS b, count(*) FILTER (cn < 12 AND lo80 IS NOT NULL) AS d, "
        "count(*) FILTER (code NOT IN (SELECT code FROM ser)) AS x FROM fc), "
        "m AS (SELECT count(*) AS bad FROM que WHERE n <> e - s + 1)",
        """SELECT c AS "check", f = 0 AS passed, f::BIGINT AS failures FROM (
             SELECT c, CASE c WHEN 'every origin precedes its target' THEN a WHEN 'locked origins are not before the minimum' THEN b
               WHEN 'no range under the minimum calibration' THEN d WHEN 'forecasts only for gated codes' THEN x
               WHEN 'every span has its claimed length' THEN bad ELSE 0 END AS f FROM g, n, m)""",
    ),
}

def _cells(measure: str, rows: str, columns: str) -> str:
    """What the second path should tell: every cell compared, none differing."""
    told = ", ".join(f"('{c}')" for c in columns.split())
    return f"""SELECT '{measure}' AS measure, c AS "column", n AS cells, 0::BIGINT AS differing, 0::BIGINT AS one_sided
        FROM (SELECT count(*) AS n FROM ({rows})) CROSS JOIN (VALUES {told}) v(c) WHERE n > 0"""


TEXTS["second_path"] = q(
    f"{BASE}, {M01}, {SCORES}, {REVIEW}",
    " UNION ALL ".join(
        (
            _cells("M-01", "SELECT DISTINCT code, rmi FROM mem", "raw_reports excluded_reports eligible_reports"),
            _cells("M-02", f"SELECT DISTINCT code, emi FROM elig WHERE emi BETWEEN {STAR.start_mi} AND {STAR.end_mi}", "reports_with_event_month within_3 within_6 within_12 negative_lag"),
            _cells("M-03", "SELECT * FROM fc", "point calibration_n lower50 upper50 lower80 upper80"),
            _cells("M-04", "SELECT * FROM cell", "n mae coverage50 coverage80 width50 width80 wis"),
            _cells("M-05", "SELECT * FROM que", "months_in_episode max_excess_over_point"),
        )
    ),
)
TEXTS["sql_functions_check"] = f"""
SELECT strftime(o_orderdate, '%Y-%m') AS month, count({token('p_name', BRAND)}) AS brand_lines,
  count(CASE WHEN NOT regexp_matches(s_name, '{VETO}') THEN {token('s_name', FIRM)} END) AS firm_lines,
  round(sum({wis('l_quantity', '25').replace('lo50', '20').replace('hi50', '30').replace('lo80', '10').replace('hi80', '40')}), 4) AS quantity_wis,
  round(avg((l_quantity + 3) / 3), 6) AS quantity_mean
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey GROUP BY 1"""

_UNITS = ", ".join(f"coalesce(round({c} * 1e6)::BIGINT::VARCHAR, '-')" for c in ("point", "lower50", "upper50", "lower80", "upper80", "calibration_n"))
TEXTS["locked_versions"] = q(
    f"{BASE}, {M01}, {FC}, pub AS (SELECT {FC_COLUMNS} FROM fc)",
    f"""SELECT v.version, count(*) AS "rows", sum(('0x' || md5(concat_ws('|', product_code, model, origin, target, horizon::VARCHAR, issue_date, period, {_UNITS.replace('point *', '(point + CASE WHEN hit THEN 0.001 ELSE 0 END) *')}))[1:15])::BIGINT)::VARCHAR AS content_hash,
        bool_or(hit) AS changed
        FROM (SELECT pub.*, version, version = 'r3' AND product_code = 'ECONOMY' AND model = 'baseline_a' AND horizon = 1 AND target = '{STAR.locked[0]}' AS hit
              FROM pub CROSS JOIN (VALUES ('r1'), ('r2'), ('r3')) x(version) WHERE origin >= '{STAR.locked_min_origin}') v GROUP BY v.version""",
)
TEXTS["stage_order"] = q(
    f"{BASE}, {M01}, {FC}",
    f"""SELECT step, name, outcome, CASE WHEN step = 6 THEN d1 ELSE d END AS development_rows, CASE WHEN step >= 4 THEN l ELSE 0 END AS locked_rows
        FROM (SELECT count(*) FILTER (o < {mi_of(STAR.locked_min_origin)}) AS d, count(*) FILTER (o < {mi_of(STAR.locked_min_origin)} AND h = 1) AS d1,
              count(*) FILTER (o >= {mi_of(STAR.locked_min_origin)}) AS l FROM fc)
        CROSS JOIN (VALUES (0::BIGINT, 'development', 'taken'), (1, 'locked without a decision', 'refused'), (2, 'decision', 'taken'), (3, 'second decision', 'refused'),
              (4, 'locked', 'taken'), (5, 'second locked', 'refused'), (6, 'development again', 'taken')) s(step, name, outcome)""",
)

LEAD = max(STAR.horizons)
_USED = "fu AS (SELECT fc.* FROM fc JOIN pro ON pro.code = fc.code AND pro.used = fc.model)"
_AHEAD = "ah AS (SELECT code, tgt AS mi, round(pt, 6) AS pt, lo80, hi80 FROM fu WHERE h = 1 AND period IN ('locked', 'recent', 'outlook'))"
_SHOWN = f"ew AS (SELECT *, act BETWEEN lo80 AND hi80 AS within, round(abs(act - round(pt, 6)), 6) AS miss FROM fu WHERE period = 'locked' AND h = {LEAD} AND lo80 IS NOT NULL AND act IS NOT NULL)"
TEXTS["outlook_history"] = q(
    f"{BASE}, {M01}, {SCORES}, {_USED}, {_AHEAD}",
    f"""SELECT code AS product_code, used AS model_in_use, {lab('mi')} AS month, y::BIGINT AS actual, pt AS point, lo80 AS lower80, hi80 AS upper80
        FROM ser FULL JOIN ah USING (code, mi) JOIN pro USING (code)""",
)
TEXTS["outlook_evidence"] = q(
    f"{BASE}, {M01}, {SCORES}, {_USED}, {_SHOWN}",
    f"""SELECT code AS product_code, model AS model_in_use, {lab('tgt')} AS target, {lab('o')} AS origin, act::BIGINT AS actual, round(pt, 6) AS point,
        lo80 AS lower80, hi80 AS upper80, within AS inside, miss FROM ew""",
)
TEXTS["outlook_lead"] = q(
    f"{BASE}, {M01}, {SCORES}, {_USED}",
    f"""SELECT l.code AS product_code, l.model AS model_in_use, {lab('l.o')} AS origin, {lab('l.tgt')} AS target, round(l.pt, 6) AS point, l.lo50 AS lower50,
        l.hi50 AS upper50, l.lo80 AS lower80, l.hi80 AS upper80, l.cn::BIGINT AS calibration_n, coalesce(len(l.es), 0)::BIGINT AS errors,
        {lab('e.tgt')} AS elapsed_target, round(e.pt, 6) AS elapsed_point, e.lo80 AS elapsed_lower80, e.hi80 AS elapsed_upper80,
        n, cov80 AS coverage80, round(cov80 * n)::BIGINT AS inside, mae
        FROM fu l LEFT JOIN fu e ON e.code = l.code AND e.o = l.o AND e.h = 1
        LEFT JOIN cell ON cell.code = l.code AND cell.model = l.model AND cell.h = l.h AND cell.period = 'locked'
        WHERE l.o = {STAR.end_mi} AND l.h = {LEAD} AND l.period = 'outlook'""",
)
TEXTS["outlook_gate"] = q(
    f"""{BASE}, {M01}, {SCORES}, {_USED}, {_SHOWN},
    ws AS (SELECT code, count(*) AS n, count(*) FILTER (within) AS i, round(avg(miss), 6) AS m FROM ew GROUP BY code),
    ld AS (SELECT code, cn, len(es) AS errors FROM fu WHERE o = {STAR.end_mi} AND h = {LEAD}),
    sr AS (SELECT code, count(*) AS n, sum(y) AS y FROM ser GROUP BY code),
    ck AS (
      SELECT ws.code, 'evidence rows' AS c, ws.n::DOUBLE AS d, cell.n::DOUBLE AS p FROM ws JOIN pro USING (code) JOIN cell ON cell.code = ws.code AND model = used AND h = {LEAD} AND period = 'locked'
      UNION ALL SELECT ws.code, 'evidence inside', i, round(cov80 * cell.n) FROM ws JOIN pro USING (code) JOIN cell ON cell.code = ws.code AND model = used AND h = {LEAD} AND period = 'locked'
      UNION ALL SELECT ws.code, 'evidence mean miss', m, mae FROM ws JOIN pro USING (code) JOIN cell ON cell.code = ws.code AND model = used AND h = {LEAD} AND period = 'locked'
      UNION ALL SELECT code, 'errors behind the dots', errors, cn FROM ld
      UNION ALL SELECT code, 'dots', {STAR.dots}, {STAR.dots} FROM ld
      UNION ALL SELECT code, 'months', n, n FROM sr UNION ALL SELECT code, 'reports', y, y FROM sr)""",
    'SELECT code AS product_code, c AS "check", d AS drawn, p AS published, coalesce(abs(d - p) <= 2e-6, false) AS passed FROM ck',
)


def _facts(mart: str, rows: str, key: str, numbers: str, words: str = "") -> str:
    """The figures of a mart in long form, each held."""
    told = [f"SELECT '{mart}' AS mart, {key} AS \"key\", '{c}' AS figure, round({c}::DOUBLE, 4) AS number, NULL::VARCHAR AS words, true AS holds FROM ({rows})" for c in numbers.split()]
    told += [f"SELECT '{mart}', {key}, '{c}', NULL, {c}::VARCHAR, true FROM ({rows})" for c in words.split()]
    return " UNION ALL ".join(told)


def _select(name: str) -> str:
    """A text's last SELECT, for use under the same fragments."""
    return TEXTS[name][TEXTS[name].rindex("\nSELECT ") :]


TEXTS["published_facts"] = q(
    f"""{BASE}, {M01}, {SCORES}, {REVIEW}, {RECALL}, {C1},
    fl AS (SELECT code, string_agg({lab('tgt')}, ' ' ORDER BY tgt) AS t FROM ev WHERE flg GROUP BY code),
    ug AS (SELECT code, count(*) AS n, string_agg({lab('s')} || '..' || {lab('e')}, ' ' ORDER BY s) AS t FROM epi GROUP BY code),
    ci AS (SELECT code, count(DISTINCT ev) AS n FROM c1 GROUP BY code),
    vol AS (SELECT code, sum(y)::BIGINT AS v FROM ser WHERE mi > {STAR.end_mi} - 12 GROUP BY code), per AS (SELECT k, count(*) AS c FROM mem GROUP BY k)""",
    " UNION ALL ".join(
        (
            _facts("lanes", _select("lanes"), "product_code", "flagged_months gated_episodes ungated_episodes", "model_in_use rule_enabled flagged_list ungated_list"),
            _facts("coverage_by_code", _select("coverage_by_code"), "product_code", "n inside coverage80", "model_in_use rule_enabled in_band"),
            _facts("headline_code", _select("headline_code"), "'all'", "last_12_months", "product_code model_in_use"),
            _facts(
                "queue",
                "SELECT (SELECT count(*) FROM que) AS episodes, (SELECT count(*) FROM epi) AS ungated, sum(months) AS months, coalesce(sum(months) FILTER (on_), 0) AS enabled_months FROM st",
                "'all'", "episodes ungated months enabled_months",
            ),
            _facts("reports", _select("distinct_totals"), "'all'", "distinct_raw distinct_eligible memberships multi_code_reports"),
        )
    ),
)

#: What each corruption run must tell: the gate and the checks that fail, with the one-row changes that make them.
CORRUPTIONS = {
    ("M1 manifest", "no stored body is unlisted"): "manifest:drop",
    ("M1 manifest", "a path is told once"): "manifest:repeat stored:repeat",
    ("M1 manifest", "no listed body is missing; no stored body is unlisted"): "manifest:shift:path stored:blank:path stored:shift:path",
    ("M1 manifest", "every body has its listed hash"): "manifest:shift:sha256 manifest:swap:sha256 stored:shift:sha256 stored:swap:sha256",
    ("M1 manifest", "no listed body is missing"): "stored:blank:sha256 stored:drop",
    ("M13 second path", "raw_reports equals the second path"): "derived:blank:raw_reports derived:drop derived:shift:raw_reports derived:swap:raw_reports published:blank:raw_reports published:drop published:shift:raw_reports published:swap:raw_reports",
    ("M13 second path", "a cell is told once"): "derived:repeat published:repeat",
    ("M13 second path", "a cell is told once; raw_reports equals the second path"): "derived:shift:mi published:shift:mi",
    ("M16 figures", "every figure lies in its band"): "bands:blank:high bands:drop bands:shift:low bands:swap:low figures:blank:value figures:shift:value figures:swap:value",
    ("M16 figures", "every band has its figure"): "figures:drop",
    ("M16 figures", "every band has its figure; every figure lies in its band"): "figures:shift:figure",
    ("M2 windows", "every window is complete"): "log:blank:api_total log:blank:expected log:blank:status log:shift:api_total log:shift:expected log:shift:status",
    ("M2 windows", "every window is logged"): "log:drop",
    ("M2 windows", "no window is logged twice"): "log:repeat",
    ("M3 monthly", "eligible is raw minus excluded"): "monthly:blank:eligible_reports monthly:blank:excluded_reports monthly:shift:eligible_reports monthly:shift:excluded_reports",
    ("M3 monthly", "eligible is raw minus excluded; raw equals the independent series"): "monthly:blank:raw_reports monthly:shift:raw_reports monthly:swap:raw_reports",
    ("M3 monthly", "raw equals the independent series"): "monthly:blank:series_reports monthly:shift:series_reports",
    ("M4 reports", "countable receipt days have eight digits; countable receipt days lie in the window; total minus countable equals quarantined"): "report:blank:date_received",
    ("M4 reports", "report keys are unique"): "report:repeat",
    ("M4 reports", "total minus countable equals quarantined"): "report:shift:countable",
    ("M4 reports", "countable receipt days have eight digits; total minus countable equals quarantined"): "report:shift:date_received",
    ("M5 bridge", "no bridge row without a report"): "bridge:blank:report_key report:drop",
    ("M5 bridge", "bridge pairs are unique"): "bridge:repeat",
    ("M6 receipt", "receipt equals the audit"): "audit:drop audit:shift:field receipt:blank:reports_matched receipt:drop receipt:shift:field receipt:shift:reports_matched",
    ("M6 receipt", "every audit token is on the list"): "audit:shift:token",
    ("live store", "sha256 as landed"): "landed:blank:sha256 landed:swap:sha256 readings:blank:count readings:shift:count readings:shift:time",
    ("live store", "buckets as landed; last_updated as landed; sha256 as landed"): "landed:drop readings:shift:product_code",
    ("live store", "a code is listed once"): "landed:repeat",
    ("live store", "buckets as landed"): "landed:shift:buckets",
    ("live store", "buckets as landed; sha256 as landed"): "readings:drop readings:repeat",
    ("live store", "last_updated as landed"): "readings:shift:last_updated",
}
TEXTS["corruption_runs"] = "SELECT * FROM (VALUES {}) AS t(gate, mutation, outcome, failing) WHERE (SELECT count(*) FROM documents) > 1 AND (SELECT count(*) FROM lineitem) > 1".format(
    ", ".join(f"('{gate}', '{m}', 'caught', '{failing}')" for (gate, failing), names in CORRUPTIONS.items() for m in names.split())
)

IN_WINDOW = "EXISTS (SELECT 1 FROM que q WHERE q.code = c1.code AND q.s BETWEEN im - 18 AND im - 1)"
ALWAYS = f"im - 1 >= {mi_of(STAR.locked[0])} AND im - 18 <= {mi_of(STAR.recent[1])}"
TEXTS["recall_initiations"] = q(
    f"{BASE}, {M01}, {SCORES}, {REVIEW}, {RECALL}, {C1}",
    f"""SELECT code AS product_code, {lab('im')} AS month, ev AS event_number,
        (SELECT count(*) FROM que q WHERE q.code = c1.code AND q.s BETWEEN im - 18 AND im - 1) AS episodes_before, {IN_WINDOW} AS preceded, {ALWAYS} AS always_flag_preceded FROM c1""",
)
TEXTS["recall_workload"] = q(
    f"""{BASE}, {M01}, {SCORES}, {REVIEW}, {RECALL}, {C1},
    per AS (SELECT code, count(*) AS n, count(*) FILTER ({IN_WINDOW}) AS pre, count(*) FILTER ({ALWAYS}) AS alw, count(DISTINCT im) AS months_hit FROM c1 GROUP BY code)""",
    """SELECT st.code AS product_code, on_ AS rule_enabled, months AS evaluated_months, coalesce(per.n, 0) AS class_i_initiations, round_even(coalesce(per.n, 0) / months, 4) AS initiations_per_month,
        coalesce(months_hit, 0) AS initiation_months, coalesce(pre, 0) AS preceded, coalesce(alw, 0) AS always_flag_preceded,
        (SELECT count(*) FROM que WHERE que.code = st.code) AS episodes,
        (SELECT count(*) FROM que WHERE que.code = st.code AND EXISTS (SELECT 1 FROM c1 WHERE c1.code = que.code AND que.s BETWEEN im - 18 AND im - 1)) AS episodes_in_window,
        round_even((SELECT count(*) FROM que WHERE que.code = st.code) / months, 4) AS episodes_per_evaluated_month
        FROM st LEFT JOIN per ON per.code = st.code""",
)

# The same texts with brands as product codes.
BRANDED = ("promotion", "review_queue", "queue_diagnostic", "largest_episode", "recall_count", "recall_initiations", "recall_workload", "forecast_gates", "second_path", "published_facts")
TEXTS |= {f"brand_{name}": TEXTS[name].replace("p_type", "upper(p_brand)") for name in BRANDED}
