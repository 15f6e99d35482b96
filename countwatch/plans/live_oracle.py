"""DuckDB SQL for the vintage and stream queries."""

from __future__ import annotations

from countwatch.config import STAR_FROZEN, mi_of
from countwatch.plans.oracle import (
    BASE, HZ, ets_cte, lab, months_cte, points_cte, q, ranges_cte, scored_cte, wis,
)

H = STAR_FROZEN
LAST = H.end_mi  # newest frozen month; vintage k has seen LAST + k
VINTAGES = (("v0", "2001-05-02"), ("v1", "2001-06-02"), ("v2", "2001-07-02"), ("v3", "2001-08-02"))


def seen(v: str, lu: str) -> str:
    late = f"o_orderpriority = '5-LOW' AND o_orderdate::DATE >= DATE '{lu}' - 30"
    revised = "o_orderstatus = 'P' AND o_orderpriority = '3-MEDIUM' AND strftime(o_orderdate, '%Y-%m') = '1999-03'"
    base = f"o_orderdate::DATE < DATE '{lu}' AND NOT ({late})"
    return f"{base} AND NOT ({revised})" if v >= "v2" else base


COUNTS = f"""
vm AS (
  SELECT code, year(o_orderdate) * 12 + month(o_orderdate) AS mi, ex,
         {', '.join(f"({seen(v, lu)}) AS {v}" for v, lu in VINTAGES)}
  FROM orders JOIN bridge ON k = o_orderkey JOIN hit USING (k)),
gridm AS (SELECT code, mi FROM codes CROSS JOIN (SELECT unnest(range({H.start_mi}, {LAST + 5})) AS mi)),
vc AS MATERIALIZED (
  SELECT g.code || '' AS code, g.mi, {', '.join(f"count(*) FILTER ({v}) AS {v}" for v, _ in VINTAGES)}, count(*) FILTER (v0 AND NOT ex) AS el
  FROM gridm g LEFT JOIN vm USING (code, mi) GROUP BY g.code, g.mi),
ls AS ({' UNION ALL '.join(f"SELECT '{v}' AS v, {k} AS vi, '{lu}' AS lu, code, mi, {v} AS seen FROM vc WHERE mi BETWEEN {LAST + 1} AND {LAST + k}" for k, (v, lu) in enumerate(VINTAGES) if k)})
"""

# One code's revised month is listed as it reads, another's at one report too many.
KNOWN = f"code = 'PROMO' AND mi = {mi_of('1999-03')}"
OFF = f"code = 'STANDARD' AND mi = {mi_of('1999-03')}"

REREAD = " UNION ALL ".join(
    f"SELECT '{v}' AS v, code, mi, v0 AS f, {v} AS l FROM vc WHERE mi <= {LAST} AND v0 > 0" for v, _ in VINTAGES[1:]
)

FROZEN_SERIES = f"fser AS (SELECT code, mi, el AS y FROM vc WHERE mi <= {LAST})"
LIVE_SERIES = (
    "lser AS ("
    + " UNION ALL ".join(
        f"SELECT code || '@{v}' AS code, mi, CASE WHEN mi <= {LAST} THEN el ELSE {v} END AS y FROM vc WHERE mi <= {LAST + k}"
        for k, (v, _) in enumerate(VINTAGES)
        if k
    )
    + ")"
)

LIVE = f"""
{HZ}, {FROZEN_SERIES}, {ets_cte('fser', 'f_')}, {points_cte(H, 'fser', 'f_')}, {ranges_cte(H, 'f_')}, {scored_cte('f_')},
{LIVE_SERIES}, {ets_cte('lser', 'l_')}, {points_cte(H.with_(last_actual='2001-07'), 'lser', 'l_', first='2001-05')},
ky AS (SELECT DISTINCT code, v, vi, code || '@' || v AS sid FROM ls),
lp AS (
  SELECT ky.code, ky.v, ky.vi, model, h, o, tgt, round(pt, 6) AS pt, pt AS full_pt FROM l_pts JOIN ky ON ky.sid = l_pts.code
  WHERE o = {LAST} + ky.vi),
due AS (
  SELECT code, model, h, o, tgt, round(pt, 6) AS pt, 'frozen' AS who, 0 AS vi FROM f_fc WHERE period = 'outlook' AND pt IS NOT NULL
  UNION ALL SELECT code, model, h, o, tgt, pt, 'live', vi FROM lp WHERE pt IS NOT NULL),
se AS (
  SELECT d.*, ls.v AS sv, ls.vi AS svi, ls.seen AS act FROM due d JOIN ls ON ls.code = d.code AND ls.mi = d.tgt AND ls.vi > d.vi
  QUALIFY row_number() OVER (PARTITION BY d.code, model, h, o, tgt ORDER BY ls.vi) = 1),
le AS (
  SELECT code, model, h, tgt, round(er, 6) AS e, 0 AS svi FROM f_sc
  UNION ALL SELECT code, model, h, tgt, round(act - pt, 6), svi FROM se),
lcal AS (
  SELECT lp.v, lp.code, lp.model, lp.h, lp.o, e FROM lp JOIN le ON le.code = lp.code AND le.model = lp.model AND le.h = lp.h
    AND le.tgt <= lp.o AND le.svi <= lp.vi
  QUALIFY row_number() OVER (PARTITION BY lp.v, lp.code, lp.model, lp.h ORDER BY le.tgt DESC) <= 36),
lq AS (
  SELECT v, code, model, h, count(*) AS cn, quantile_cont(e, 0.25) AS q25, quantile_cont(e, 0.75) AS q75,
         quantile_cont(e, 0.10) AS q10, quantile_cont(e, 0.90) AS q90 FROM lcal GROUP BY ALL),
lf AS (
  SELECT r.*, CASE WHEN pt IS NULL THEN 0 ELSE coalesce(cn, 0) END AS cn,
         CASE WHEN cn >= 12 THEN round(greatest(0, full_pt + q25)::DECIMAL(28, 9), 6)::DOUBLE END AS lo50, CASE WHEN cn >= 12 THEN round(greatest(0, full_pt + q75)::DECIMAL(28, 9), 6)::DOUBLE END AS hi50,
         CASE WHEN cn >= 12 THEN round(greatest(0, full_pt + q10)::DECIMAL(28, 9), 6)::DOUBLE END AS lo80, CASE WHEN cn >= 12 THEN round(greatest(0, full_pt + q90)::DECIMAL(28, 9), 6)::DOUBLE END AS hi80
  FROM lp r LEFT JOIN lq USING (v, code, model, h)),
bounds AS (
  SELECT code, model, h, o, tgt, lo50, hi50, lo80, hi80 FROM f_fc WHERE period = 'outlook'
  UNION ALL SELECT code, model, h, o, tgt, lo50, hi50, lo80, hi80 FROM lf),
sx AS (SELECT se.*, lo50, hi50, lo80, hi80 FROM se JOIN bounds USING (code, model, h, o, tgt))
"""

FP = "string_agg(strftime(make_date(((mi - 1) // 12)::INT, ((mi - 1) % 12 + 1)::INT, 1), '%Y%m%d') || ':' || n, ',' ORDER BY mi)"

TEXTS: dict[str, str] = {
    "live_series": q(
        f"{BASE}, {COUNTS}",
        f"""SELECT v AS vintage, code AS product_code, {lab('mi')} AS month, seen AS reports_as_seen, lu AS last_updated,
            vi = max(vi) OVER (PARTITION BY code, mi) AS latest FROM ls""",
    ),
    "frozen_variance": q(
        f"""{BASE}, {COUNTS}, rr AS ({REREAD}),
        vd AS (SELECT *, CASE WHEN l > f THEN 'higher' WHEN l = f THEN 'same' WHEN f - l <= 0.01 * f THEN 'lower'
                 WHEN {KNOWN} THEN 'known' ELSE 'material' END AS verdict FROM rr)""",
        """SELECT v AS vintage, count(*) AS months_compared, count(*) FILTER (verdict = 'higher') AS months_reading_higher,
           coalesce(sum(l - f) FILTER (verdict = 'higher'), 0)::BIGINT AS reports_added,
           count(*) FILTER (l < f) AS months_reading_lower, count(*) FILTER (verdict = 'known') AS known_revisions,
           count(*) FILTER (verdict = 'material') AS material_downward FROM vd GROUP BY v""",
    ),
    "revised_months": q(
        f"{BASE}, {COUNTS}, rr AS ({REREAD})",
        f"""SELECT v AS vintage, code AS product_code, {lab('mi')} AS month, f AS frozen, l AS live,
            CASE WHEN {KNOWN} THEN 'known' ELSE 'material' END AS verdict,
            CASE WHEN {KNOWN} THEN NULL WHEN {OFF} THEN 'listed at another frozen count' ELSE 'not listed' END AS note
            FROM rr WHERE f - l > 0.01 * f""",
    ),
    "vintage_manifest": q(
        f"{BASE}, {COUNTS}, rd AS ("
        + " UNION ALL ".join(f"SELECT '{v}' AS v, '{lu}' AS lu, code, mi, {v} AS n FROM vc WHERE {v} > 0" for v, lu in VINTAGES[1:])
        + ")",
        f"SELECT v AS vintage, code AS product_code, count(*) AS buckets, sha256({FP}) AS sha256, max(lu) AS last_updated FROM rd GROUP BY v, code",
    ),
    "live_scores": q(
        f"{BASE}, {COUNTS}, {LIVE}",
        f"""SELECT sv AS vintage, code AS product_code, model, {lab('o')} AS origin, {lab('tgt')} AS target, h::BIGINT AS horizon, who AS issued_by,
            pt AS point, lo50 AS lower50, hi50 AS upper50, lo80 AS lower80, hi80 AS upper80, act AS actual_as_seen, sv AS actual_vintage,
            round(act - pt, 6) AS error, round(abs(act - pt), 6) AS abs_error, act BETWEEN lo50 AND hi50 AS covered50,
            act BETWEEN lo80 AND hi80 AS covered80, round({wis('act', 'pt')}, 6) AS wis FROM sx""",
    ),
    "live_reissue": q(
        f"{BASE}, {COUNTS}, {LIVE}",
        f"""SELECT v AS vintage, code AS product_code, model, {lab('o')} AS origin, {lab('tgt')} AS target, h::BIGINT AS horizon, pt AS point,
            lo50 AS lower50, hi50 AS upper50, lo80 AS lower80, hi80 AS upper80, cn::BIGINT AS calibration_n FROM lf""",
    ),
    "live_health": q(
        f"""{BASE}, {COUNTS}, {LIVE}, iu AS (SELECT abs(act - pt) AS ae, act BETWEEN lo80 AND hi80 AS c80 FROM sx JOIN f_pro ON f_pro.code = sx.code AND used = model WHERE h = 1),
        rr AS ({REREAD.replace(' AND v0 > 0', '')}),
        bad AS (SELECT v, count(*) FILTER (f - l > 0.01 * f AND NOT ({KNOWN})) > 0 AS b FROM rr GROUP BY v),
        rh AS (
          SELECT v, CASE WHEN b THEN 'failed' ELSE 'ok' END AS status, CASE WHEN b THEN 'no unlisted fall of a frozen month' ELSE '' END AS fc, lu FROM bad JOIN (SELECT DISTINCT v, lu FROM ls) x USING (v)
          UNION ALL SELECT 'v1a', 'skipped: nothing newer than {VINTAGES[1][1]}', '', NULL UNION ALL SELECT 'v1b', 'stopped', 'every code answered', NULL),
        listed AS (
          SELECT v0 + CASE WHEN code = 'STANDARD' THEN 1 ELSE 0 END AS f, v2 AS l FROM vc WHERE code IN ('PROMO', 'STANDARD') AND mi = {mi_of('1999-03')}),
        lo AS (SELECT lf.code, tgt, pt FROM lf JOIN f_pro ON f_pro.code = lf.code AND used = model WHERE h = 1 AND o = {LAST + 3} AND pt IS NOT NULL)""",
        f"""SELECT (SELECT count(*) FROM ls) AS readings_recorded, (SELECT count(DISTINCT v) FROM ls) AS vintages,
            (SELECT count(DISTINCT mi) FROM ls) AS months_seen, (SELECT {lab('max(mi)')} FROM ls) AS newest_month_seen,
            (SELECT count(*) FROM lf) AS forecasts_issued, (SELECT {lab('max(o)')} FROM lf) AS latest_origin,
            (SELECT count(*) FROM sx) AS forecasts_scored, (SELECT count(*) FROM iu) AS in_use_h1_scored,
            (SELECT round(avg(ae), 3) FROM iu) AS in_use_h1_mae, (SELECT round(avg(c80::INT), 4) FROM iu) AS in_use_h1_coverage80,
            r.*, (SELECT count(*) FROM listed WHERE l < f) AS revisions_listed, (SELECT coalesce(sum(f - l), 0)::BIGINT FROM listed WHERE l < f) AS revisions_reports_removed,
            (SELECT count(*) FROM listed WHERE l < f) AS revisions_decisions,
            (SELECT count(*) FROM lo) AS outlook_codes, (SELECT {lab('max(tgt)')} FROM lo) AS outlook_target, (SELECT round(sum(pt), 3) FROM lo) AS outlook_reports, t.*
            FROM (SELECT count(*) AS runs_recorded, count(*) FILTER (status = 'ok') AS runs_ok, count(*) FILTER (status LIKE 'skipped%') AS runs_skipped,
                    count(*) FILTER (status = 'stopped') AS runs_stopped, count(*) FILTER (status = 'failed') AS runs_failed, min(v) AS first_run, max(v) AS newest_run,
                    arg_max(status, v) AS newest_status, max(v) FILTER (status = 'ok') AS last_ok_run, max(v) FILTER (status <> 'ok') AS last_not_ok_run,
                    arg_max(status, v) FILTER (status <> 'ok') AS last_not_ok_status, max(v) FILTER (fc <> '') AS last_failed_run,
                    arg_max(fc, v) FILTER (fc <> '') AS last_failed_checks, arg_max(lu, v) FILTER (lu IS NOT NULL) AS source_last_updated_seen FROM rh) r
            CROSS JOIN (SELECT 'v3' AS reread_vintage, count(*) AS months_compared, count(*) FILTER (l > f) AS months_reading_higher, coalesce(sum(l - f) FILTER (l > f), 0)::BIGINT AS reports_added,
                    count(*) FILTER (l < f) AS months_reading_lower, count(*) FILTER (f - l > 0.01 * f AND ({KNOWN})) AS known_revisions,
                    count(*) FILTER (f - l > 0.01 * f AND NOT ({KNOWN})) AS material_downward FROM rr WHERE v = 'v3') t""",
    ),
    "live_outlook": q(
        f"{BASE}, {COUNTS}, {LIVE}",
        f"""SELECT lf.code AS product_code, model, {lab('o')} AS origin, {lab('tgt')} AS target, pt AS point, lo80 AS lower80, hi80 AS upper80,
            cn::BIGINT AS calibration_n, v AS issued_vintage FROM lf JOIN f_pro ON f_pro.code = lf.code AND used = model
            WHERE h = 1 AND o = {LAST + 3} AND pt IS NOT NULL""",
    ),
    "run_history": q(
        f"""{BASE}, {COUNTS}, {LIVE}, rr AS ({REREAD}),
        mt AS (SELECT v, count(*) FILTER (f - l > 0.01 * f AND NOT ({KNOWN})) AS bad FROM rr GROUP BY v)""",
        """SELECT mt.v AS vintage, lu AS last_updated, CASE WHEN bad > 0 THEN 'failed' ELSE 'ok' END AS status, bad = 0 AS passed,
           8::BIGINT AS checks_total, CASE WHEN bad > 0 THEN 'no unlisted fall of a frozen month' ELSE '' END AS failed_checks,
           (SELECT count(*) FROM ls WHERE ls.v = mt.v) AS months_appended, (SELECT count(*) FROM sx WHERE sv = mt.v) AS forecasts_scored,
           (SELECT count(*) FROM lf WHERE lf.v = mt.v) AS forecasts_issued
           FROM mt JOIN (SELECT DISTINCT v, lu FROM ls) x USING (v)""",
    ),
    "stream_every_reading": """
        SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS events, round(sum(value), 4) AS total
        FROM (SELECT DISTINCT event_id, ts, event_type, value FROM events) GROUP BY ALL""",
    # Landings of four days, every 37th event two landings late; behind the newest earlier time less a day is late.
    "stream_late_rows": """
        WITH l AS (
          SELECT *, date_diff('day', (SELECT min(ts) FROM events)::DATE, ts::DATE) // 4 + CASE WHEN event_id % 37 = 0 THEN 2 ELSE 0 END AS landing
          FROM events WHERE ts IS NOT NULL),
        n AS (SELECT landing, max(ts) AS upto FROM l GROUP BY landing),
        m AS (SELECT landing, max(upto) OVER (ORDER BY landing ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM n)
        SELECT event_id, event_type, value, landing, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts
        FROM l JOIN m USING (landing) WHERE ts <= date_trunc('millisecond', m.upto) - INTERVAL 1 DAY""",
    "stream_daily_counts": """
        WITH e AS (SELECT DISTINCT event_id, ts, event_type, value FROM events)
        SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS events, round(sum(value), 4) AS total
        FROM e WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY ALL""",
}
