"""The registered queries in DuckDB SQL, over the same tables."""

from __future__ import annotations

from overlay_jobs.operators.harmonize import FUNDING
from overlay_jobs.plans.adapters import ACTIVITIES, DESCRIPTORS
from overlay_jobs.sources.crosswalk import ROWS


def _text(v: str | None) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


TREATMENTS = f"""
t AS (
  SELECT o_orderkey AS OBJECTID, CASE WHEN o_orderkey % 3 = 0 THEN 'TWIG' ELSE 'CFT' END AS SOURCE,
         [{', '.join(map(_text, ACTIVITIES))}][(o_orderkey * 7 + o_custkey) % 13 + 1] AS ACTIVITY,
         CASE WHEN o_orderkey % 17 <> 0 THEN (year(o_orderdate) + 15)::INTEGER END AS YEAR_COMP,
         CASE WHEN o_orderkey % 19 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN '  ' || n_name ELSE n_name END AS AGENCY_C,
         c_mktsegment AS FUND_SOURCE, o_orderpriority AS FUND_TYPE, o_orderstatus AS LANDOWNER,
         o_totalprice / 1000 AS ACRES_GIS, o_custkey::BIGINT AS ZONE
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

EVENTS = f"{TREATMENTS}, e AS (SELECT ZONE AS ATOM_ID, ((ZONE % 97 + 1) * 0.5)::DOUBLE AS ACRES, t.* FROM t)"

ZONES = f"""{EVENTS},
counted AS (SELECT * FROM e WHERE ACTIVITY <> '' AND YEAR_COMP IS NOT NULL),
z AS (
  SELECT ATOM_ID, any_value(ACRES) AS ACRES, count(*)::INTEGER AS N_EVENTS, min(YEAR_COMP) AS FIRST_TRT_YEAR, max(YEAR_COMP) AS LAST_TRT_YEAR,
         coalesce(string_agg(DISTINCT trim(AGENCY_C), '|' ORDER BY trim(AGENCY_C)), '') AS AGENCIES,
         coalesce(string_agg(DISTINCT trim(FUND_SOURCE), '|' ORDER BY trim(FUND_SOURCE)), '') AS FUND_SOURCES,
         string_agg(OBJECTID::VARCHAR, '|' ORDER BY OBJECTID) AS SOURCE_IDS
  FROM e GROUP BY ATOM_ID),
p AS (
  SELECT ATOM_ID, list_sort(list(DISTINCT ACTIVITY)) AS acts, min(YEAR_COMP) AS fy, max(YEAR_COMP) AS ly,
         max(YEAR_COMP) FILTER (ACTIVITY IN ('Manual', 'Mechanical') AND YEAR_COMP >= 2014) AS LAST_THIN
  FROM counted GROUP BY ATOM_ID),
s AS (SELECT ['Broadcast Burn', 'Mechanical', 'Manual', 'Mastication', 'Removal', 'Pile Burn', 'Pile Fuels', 'Chipping', 'Mulching', 'Lop and Scatter'] AS singles),
f AS (SELECT ATOM_ID, list_sort(list(DISTINCT ACTIVITY)) AS fa FROM counted JOIN p USING (ATOM_ID) WHERE YEAR_COMP = fy GROUP BY ATOM_ID),
l AS (SELECT ATOM_ID, list_sort(list(DISTINCT ACTIVITY)) AS la FROM counted JOIN p USING (ATOM_ID) WHERE YEAR_COMP = ly GROUP BY ATOM_ID),
k AS (
  SELECT z.*, coalesce(p.acts, []) AS acts, p.LAST_THIN,
         list_concat(list_filter(singles, lambda x: list_contains(p.acts, x)), list_filter(p.acts, lambda x: NOT list_contains(singles, x))) AS ord,
         list_concat(list_filter(singles, lambda x: list_contains(f.fa, x)), f.fa)[1] AS FIRST_TRT,
         list_concat(list_filter(singles, lambda x: list_contains(l.la, x)), l.la)[1] AS LAST_TRT
  FROM z LEFT JOIN p USING (ATOM_ID) LEFT JOIN f USING (ATOM_ID) LEFT JOIN l USING (ATOM_ID), s),
a AS (
  SELECT ATOM_ID, ACRES, N_EVENTS, SOURCE_IDS, CASE WHEN len(acts) = 0 THEN 'Unknown' ELSE array_to_string(ord, '|') END AS TRT_ACTIVITIES,
         CASE WHEN len(acts) = 0 THEN 'Unknown'
              WHEN list_contains(acts, 'Mechanical') AND list_contains(acts, 'Broadcast Burn') THEN 'Mechanical + Broadcast Burn'
              WHEN list_contains(acts, 'Manual') AND list_contains(acts, 'Broadcast Burn') THEN 'Manual + Broadcast Burn'
              WHEN len(list_intersect(acts, ['Broadcast Burn', 'Mechanical', 'Manual', 'Mastication', 'Removal', 'Pile Burn', 'Pile Fuels', 'Chipping', 'Mulching', 'Lop and Scatter'])) > 0 THEN ord[1]
              ELSE array_to_string(acts, ' + ') END AS TRT_EFF,
         CASE WHEN len(acts) = 0 THEN 'Unknown' ELSE array_to_string(ord, ' + ') END AS TRT_SET,
         FIRST_TRT, LAST_TRT, FIRST_TRT_YEAR, LAST_TRT_YEAR,
         list_has_any(acts, ['Manual', 'Mechanical']) AND list_contains(acts, 'Broadcast Burn') AS COMPLETE, LAST_THIN,
         nullif(array_to_string(list_filter(acts, lambda x: x IN ('Manual', 'Mechanical', 'Mastication', 'Broadcast Burn')), '|'), '') AS CANOPY,
         nullif(array_to_string(list_filter(acts, lambda x: x IN ('Pile Fuels', 'Removal', 'Lop and Scatter', 'Mulching', 'Pile Burn', 'Broadcast Burn')), '|'), '') AS SURFACE,
         AGENCIES, FUND_SOURCES
  FROM k)"""

AUDIT = f"""{EVENTS},
q AS (
  SELECT ATOM_ID, any_value(ACRES) AS ACRES, bool_or(SOURCE = 'CFT') AS c, bool_or(SOURCE = 'TWIG') AS w,
         coalesce(list_sort(list(DISTINCT ACTIVITY) FILTER (SOURCE = 'CFT' AND ACTIVITY IS NOT NULL)), []) AS ca,
         coalesce(list_sort(list(DISTINCT ACTIVITY) FILTER (SOURCE = 'TWIG' AND ACTIVITY IS NOT NULL)), []) AS wa,
         coalesce(list_sort(list(DISTINCT YEAR_COMP) FILTER (SOURCE = 'CFT' AND YEAR_COMP IS NOT NULL)), []) AS cy,
         coalesce(list_sort(list(DISTINCT YEAR_COMP) FILTER (SOURCE = 'TWIG' AND YEAR_COMP IS NOT NULL)), []) AS wy
  FROM e GROUP BY ATOM_ID),
gap AS (
  SELECT x.ATOM_ID, min(abs(x.YEAR_COMP - y.YEAR_COMP)) AS d FROM e x JOIN e y
  ON x.ATOM_ID = y.ATOM_ID AND x.SOURCE = 'CFT' AND y.SOURCE = 'TWIG' GROUP BY x.ATOM_ID),
audit AS (
  SELECT q.ATOM_ID, ACRES,
         CASE WHEN NOT (c AND w) THEN CASE WHEN c THEN 'CFT_ONLY' ELSE 'TWIG_ONLY' END
              WHEN list_has_any(ca, wa) THEN CASE WHEN len(cy) = 0 OR len(wy) = 0 OR d <= 1 THEN 'AGREE' ELSE 'YEAR_CONFLICT' END
              WHEN (list_contains(ca, 'Pile Burn') AND list_contains(wa, 'Broadcast Burn')) OR (list_contains(ca, 'Broadcast Burn') AND list_contains(wa, 'Pile Burn')) THEN 'ALIAS'
              ELSE 'TYPE_CONFLICT' END AS CLASS,
         array_to_string(ca, '|') AS CFT_ACTS, array_to_string(wa, '|') AS TWIG_ACTS, array_to_string(cy, '|') AS CFT_YEARS, array_to_string(wy, '|') AS TWIG_YEARS
  FROM q LEFT JOIN gap USING (ATOM_ID))"""

FLAGS = f"""{TREATMENTS},
m AS (SELECT l_orderkey, sum(l_quantity) AS ACRES_MGT FROM lineitem GROUP BY l_orderkey),
i AS (SELECT t.*, ACRES_GIS AS gis_acres, ACRES_MGT, ACRES_GIS - ACRES_MGT AS acres_diff FROM t LEFT JOIN m ON OBJECTID = l_orderkey),
v AS (SELECT *, log10(gis_acres) AS x, log10(ACRES_MGT) AS y FROM i WHERE gis_acres > 0 AND ACRES_MGT > 0),
fit AS (
  SELECT count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2,
         CASE WHEN count(*) > 1 THEN sqrt(greatest(regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x), 0) / (count(*) - 1)) END AS resid_std FROM v),
lim AS (SELECT ACTIVITY AS g, quantile_cont(acres_diff, 0.99) AS p99 FROM i WHERE ACTIVITY IS NOT NULL GROUP BY ACTIVITY),
r AS (
  SELECT i.*, CASE WHEN gis_acres > 0 AND ACRES_MGT > 0 THEN intercept + slope * log10(gis_acres) END AS log_ac_pred,
         CASE WHEN gis_acres > 0 AND ACRES_MGT > 0 THEN log10(ACRES_MGT) - (intercept + slope * log10(gis_acres)) END AS log_ac_resid, resid_std, p99
  FROM i LEFT JOIN lim ON i.ACTIVITY = g, fit),
fl AS (
  SELECT *, coalesce(log_ac_resid < -1.5 * resid_std AND acres_diff > 900 * 0.000247105, false) AS ac_flag,
         coalesce(acres_diff > p99, false) AS ac_flag_abs FROM r)"""

_ROWS = ", ".join(f"({n}, {', '.join(map(_text, r))})" for n, r in enumerate(DESCRIPTORS))
_XW = ", ".join(f"({', '.join(map(_text, r))})" for r in ROWS)
_LOOK = "(SELECT {{'eff': CASE effect WHEN 'canopy' THEN 2 WHEN 'surface' THEN 1 ELSE 0 END, 'target': activity, 'conf': confidence}} FROM xw WHERE field = '{f}' AND value = trim(d.{f}) AND lower(trim(d.{f})) NOT IN ('', 'nan', 'none', 'n/a', 'na'))"
_OK = "({c}.target <> 'DROP' AND {c}.eff > 0)"
HARMONIZE = f"""
d AS (SELECT * FROM (VALUES {_ROWS}) AS v(slot, activity, type, method, twig_category, category, equipment)),
xw AS (SELECT * FROM (VALUES {_XW}) AS v(field, value, activity, effect, confidence)),
c AS (SELECT d.*, {', '.join(_LOOK.format(f=f) + f" AS c_{f}" for f in ('activity', 'type', 'method', 'twig_category'))} FROM d),
pk AS (
  SELECT *, CASE WHEN {_OK.format(c='c_activity')} AND (NOT coalesce({_OK.format(c='c_type')}, false) OR c_activity.eff >= c_type.eff) THEN 'activity' WHEN {_OK.format(c='c_type')} THEN 'type' END AS prim,
         CASE WHEN {_OK.format(c='c_method')} AND (NOT coalesce({_OK.format(c='c_twig_category')}, false) OR c_method.eff >= c_twig_category.eff) THEN 'method' WHEN {_OK.format(c='c_twig_category')} THEN 'twig_category' END AS fall
  FROM c),
w AS (
  SELECT *, prim IS NULL AND (coalesce(lower(trim(twig_category)) = 'unplanned ignition', false) OR coalesce(lower(trim(method)) = 'wildfire', false) OR coalesce(lower(trim(category)) = 'wildfire non-treatment', false)) AS veto,
         coalesce(prim, fall) AS ch, coalesce(lower(trim(method)), '') AS m, coalesce(lower(trim(equipment)), '') AS q FROM pk),
th AS (
  SELECT *, CASE WHEN q IN ('chain saw', 'hand work', 'hand saw', 'manual logging') THEN 'Manual'
                 WHEN q IN ('feller buncher', 'tree shear', 'dozer', 'masticator', 'rubber tired skidder logging', 'helicopter logging -medium', 'helicopter logging -small') THEN 'Mechanical'
                 WHEN m IN ('manual', 'power hand', 'manual logging', 'cut trees and brush') THEN 'Manual' ELSE 'Mechanical' END AS thin,
         CASE ch WHEN 'activity' THEN c_activity WHEN 'type' THEN c_type WHEN 'method' THEN c_method WHEN 'twig_category' THEN c_twig_category END AS cc FROM w),
fi AS (
  SELECT *, CASE cc.target WHEN 'Thin' THEN thin
                  WHEN 'Range' THEN CASE WHEN regexp_matches(m, 'fire|prescribed burn|broadcast|jackpot|underburn') THEN 'Prescribed Burn (Range)' ELSE 'DROP' END
                  WHEN 'Release' THEN CASE WHEN contains(m, 'chemical') THEN 'DROP' WHEN lower(trim(type)) = 'thinning' THEN thin
                       WHEN regexp_matches(m, 'manual|hand|cut trees|girdle') THEN 'Lop and Scatter'
                       WHEN regexp_matches(m, 'mechanical|masticat|tractor|dozer|grind|mow|mobile ground|logging|crush|push|feller|shear|skidder') THEN 'Mastication' END
                  ELSE cc.target END AS target,
         CASE WHEN c_activity.target = 'DROP' THEN 'activity' WHEN c_type.target = 'DROP' THEN 'type' WHEN c_method.target = 'DROP' THEN 'method' WHEN c_twig_category.target = 'DROP' THEN 'twig_category' END AS dropped FROM th),
st AS (
  SELECT *, CASE WHEN veto THEN 'dropped' WHEN ch IS NOT NULL THEN CASE WHEN target = 'DROP' THEN 'dropped' WHEN target IS NULL THEN 'quarantined' ELSE 'resolved' END
                 WHEN dropped IS NOT NULL THEN 'dropped' ELSE 'quarantined' END AS ACTIVITY_STATUS FROM fi),
h AS (
  SELECT l_orderkey * 8 + l_linenumber AS record, l_quantity AS acres, l_orderkey, l_shipdate, st.activity AS activity, type, method, twig_category, ACTIVITY_STATUS,
         CASE WHEN ACTIVITY_STATUS = 'resolved' THEN target END AS RESOLVED,
         CASE WHEN veto THEN 'wildfire' WHEN ch IS NOT NULL THEN ch ELSE dropped END AS ACTIVITY_FIELD,
         CASE WHEN ACTIVITY_STATUS = 'resolved' THEN cc.conf END AS ACTIVITY_CONF,
         coalesce(NOT veto AND cc.target = 'Thin', false) AS RAN_CLASSIFY_THIN
  FROM lineitem JOIN st ON (l_orderkey * 4 + l_linenumber) % {len(DESCRIPTORS)} = slot)"""

BOXES = f"""{TREATMENTS},
b AS (
  SELECT t.*, (ZONE // 100) % 64 * 64 + (OBJECTID * 37) % 64 AS gx, (ZONE // 6400) * 64 + (OBJECTID * 53 + ZONE * 11) % 64 AS gy,
         1 + OBJECTID % 6 AS w, 1 + (OBJECTID // 7) % 6 AS h FROM t),
cells AS (SELECT OBJECTID, ACTIVITY, YEAR_COMP, gx + i AS x, y FROM (SELECT *, unnest(range(w)) AS i FROM (SELECT *, gy + unnest(range(h)) AS y FROM b)))"""
AOI = f"{BOXES}, aoi AS (SELECT n_nationkey::BIGINT AS aoi_id, n_nationkey % 5 * 64 + 7 AS ax, 7 AS ay FROM nation)"
# the crosswalk's values alone: what the harmoniser makes of each depends on its one descriptor
XWALK = f"""
xw AS (SELECT row_number() OVER (ORDER BY field, value) - 1 AS slot, * FROM (VALUES {_XW}) AS v(field, value, activity, effect, confidence)),
d AS (
  SELECT p_partkey::BIGINT AS record, field, CASE p_partkey // {len(ROWS)} % 3 WHEN 1 THEN '  ' || value || ' ' WHEN 2 THEN upper(value) ELSE value END AS said
  FROM part JOIN xw ON p_partkey % {len(ROWS)} = slot),
x AS (SELECT record, d.field, trim(said) AS said, xw.activity AS target, xw.effect FROM d LEFT JOIN xw ON xw.field = d.field AND xw.value = trim(said) AND lower(trim(said)) NOT IN ('', 'nan', 'none', 'n/a', 'na')),
g AS (
  SELECT *, (field = 'twig_category' AND lower(said) = 'unplanned ignition') OR (field = 'method' AND lower(said) = 'wildfire') AS veto,
         CASE WHEN field = 'method' THEN lower(said) ELSE '' END AS m,
         target <> 'DROP' AND effect IN ('canopy', 'surface') AS chosen FROM x),
o AS (
  SELECT *, CASE target WHEN 'Thin' THEN CASE WHEN m IN ('manual', 'power hand', 'manual logging', 'cut trees and brush') THEN 'Manual' ELSE 'Mechanical' END
                        WHEN 'Range' THEN CASE WHEN regexp_matches(m, 'fire|prescribed burn|broadcast|jackpot|underburn') THEN 'Prescribed Burn (Range)' ELSE 'DROP' END
                        WHEN 'Release' THEN CASE WHEN contains(m, 'chemical') THEN 'DROP' WHEN field = 'type' AND lower(said) = 'thinning' THEN 'Mechanical'
                             WHEN regexp_matches(m, 'manual|hand|cut trees|girdle') THEN 'Lop and Scatter'
                             WHEN regexp_matches(m, 'mechanical|masticat|tractor|dozer|grind|mow|mobile ground|logging|crush|push|feller|shear|skidder') THEN 'Mastication' END
                        ELSE target END AS final FROM g),
e AS (
  SELECT *, CASE WHEN veto THEN 'dropped' WHEN chosen THEN CASE WHEN final = 'DROP' THEN 'dropped' WHEN final IS NULL THEN 'quarantined' ELSE 'resolved' END
                 WHEN target = 'DROP' THEN 'dropped' ELSE 'quarantined' END AS status FROM o)"""

# the greedy fold of one zone's events: a row per zone and turn, `taken` says which of the authority's events went to whom
DEDUPE = f"""{EVENTS},
ev AS (
  SELECT ATOM_ID, list({{'i': i, 'id': OBJECTID, 'act': ACTIVITY, 'yr': YEAR_COMP, 'src': SOURCE}} ORDER BY i) AS evs
  FROM (SELECT *, row_number() OVER (PARTITION BY ATOM_ID ORDER BY OBJECTID) AS i FROM e) GROUP BY ATOM_ID),
turns AS (
  SELECT ATOM_ID, evs, list_filter(evs, lambda x: x.src = 'CFT') AS own, list_filter(evs, lambda x: x.src <> 'CFT') AS others FROM ev),
fold AS (
  SELECT ATOM_ID, evs, own, others, 0 AS k, []::STRUCT(i BIGINT, mate BIGINT)[] AS taken FROM turns
  UNION ALL
  SELECT ATOM_ID, evs, own, others, k + 1,
         CASE WHEN best IS NULL THEN taken ELSE list_append(taken, {{'i': best, 'mate': others[k + 1].i}}) END
  FROM (
    SELECT *, list_sort(list_transform(list_filter(own, lambda x: NOT list_contains(list_transform(taken, lambda t: t.i), x.i)
               AND (x.act IS NOT DISTINCT FROM others[k + 1].act OR coalesce(x.act IN ('Pile Burn', 'Broadcast Burn') AND others[k + 1].act IN ('Pile Burn', 'Broadcast Burn'), false))
               AND coalesce(abs(x.yr - others[k + 1].yr) <= 1, true)),
             lambda x: {{'d': coalesce(abs(x.yr - others[k + 1].yr), 99), 'i': x.i}}))[1].i AS best
    FROM fold WHERE k < len(others)) AS step),
folded AS (SELECT * FROM fold WHERE k = len(others)),
left_over AS (
  SELECT ATOM_ID, len(evs) AS n_ids, evs, taken, unnest(list_filter(evs, lambda x: NOT list_contains(list_transform(taken, lambda t: t.mate), x.i))) AS x FROM folded),
paired AS (
  SELECT ATOM_ID, n_ids, x, evs[list_filter(taken, lambda t: t.i = x.i)[1].mate] AS mate FROM left_over),
said AS (
  SELECT ATOM_ID, n_ids, x.i AS i,
         x.id || ':' || coalesce(CASE WHEN mate IS NOT NULL AND x.act <> mate.act THEN 'Pile Burn' ELSE x.act END, '-') || ':' ||
         coalesce((CASE WHEN mate IS NULL THEN x.yr WHEN x.yr IS NULL THEN mate.yr WHEN x.yr BETWEEN 2012 AND 2014 THEN x.yr ELSE coalesce(mate.yr, x.yr) END)::VARCHAR, '-') || ':' ||
         CASE WHEN mate IS NULL THEN x.src ELSE 'CFT+TWIG' END AS s FROM paired)"""
# the layer on lattice cells: `a` holds the labels of each set of covering boxes; zones are the connected cells of one set, and
# merged zones the connected cells of one set of labels
_KEYS = "TRT_ACTIVITIES, TRT_EFF, TRT_SET, FIRST_TRT, LAST_TRT, FIRST_TRT_YEAR, LAST_TRT_YEAR, COMPLETE, LAST_THIN, CANOPY, SURFACE, AGENCIES"
LAYER = f"""{BOXES},
cov AS (SELECT x, y, list(OBJECTID ORDER BY OBJECTID) AS ids FROM cells GROUP BY x, y),
sets AS (SELECT ids, row_number() OVER (ORDER BY ids) AS s FROM (SELECT DISTINCT ids FROM cov)),
e AS (SELECT s AS ATOM_ID, 0.0::DOUBLE AS ACRES, t.* FROM (SELECT s, unnest(ids) AS id FROM sets) JOIN t ON OBJECTID = id)
{ZONES[len(EVENTS):]},
named AS (SELECT *, dense_rank() OVER (ORDER BY {_KEYS}) AS k FROM a),
cell AS (SELECT x, y, x * 1000000 + y AS c, s, k FROM cov JOIN sets USING (ids) JOIN named ON ATOM_ID = s),
edge AS (
  SELECT p.c AS a, q.c AS b, p.s = q.s AS same_set, p.k = q.k AS same_key FROM cell p JOIN cell q ON p.x = q.x + 1 AND p.y = q.y
  UNION ALL SELECT p.c, q.c, p.s = q.s, p.k = q.k FROM cell p JOIN cell q ON p.x = q.x AND p.y = q.y + 1),
both_ways AS (SELECT * FROM edge UNION ALL SELECT b, a, same_set, same_key FROM edge),
zr AS (SELECT c, c AS o FROM cell UNION SELECT b, o FROM zr JOIN both_ways ON a = c AND same_set),
mr AS (SELECT c, c AS o FROM cell UNION SELECT b, o FROM mr JOIN both_ways ON a = c AND same_key),
z1 AS (SELECT c, min(o) AS z FROM zr GROUP BY c),
m1 AS (SELECT c, min(o) AS m FROM mr GROUP BY c),
zone AS (
  SELECT z, m, s, k, row_number() OVER (ORDER BY ids, corner) AS number
  FROM (SELECT z, any_value(m) AS m, any_value(s) AS s, any_value(k) AS k, min({{'x': x, 'y': y}}) AS corner FROM cell JOIN z1 USING (c) JOIN m1 USING (c) GROUP BY z) JOIN sets USING (s)),
room AS (SELECT m, count(*) AS n_cells, avg(x + 0.5) * 30 AS cx, avg(y + 0.5) * 30 AS cy FROM cell JOIN m1 USING (c) GROUP BY m),
merged AS (
  SELECT m, any_value(k) AS k, min(number) AS least, sum(N_EVENTS)::INTEGER AS N_EVENTS, list_distinct(flatten(list(ids))) AS ids
  FROM zone JOIN sets USING (s) JOIN a ON ATOM_ID = s GROUP BY m),
funds AS (
  SELECT m, coalesce(string_agg(DISTINCT trim(FUND_SOURCE), '|' ORDER BY trim(FUND_SOURCE)), '') AS FUND_SOURCES
  FROM (SELECT m, unnest(ids) AS id FROM merged) JOIN t ON OBJECTID = id GROUP BY m),
layer AS (
  SELECT row_number() OVER (ORDER BY least) AS ATOM_ID, merged.N_EVENTS, list_sort(ids) AS ids, n_cells * 900 * 0.000247105::DOUBLE AS ACRES_GIS, cx, cy, funds.FUND_SOURCES, n.*
  FROM merged JOIN room USING (m) JOIN funds USING (m) JOIN (SELECT DISTINCT k, {_KEYS} FROM named) n USING (k))"""
SECOND = f"{BOXES}, src AS (SELECT *, unnest(CASE WHEN OBJECTID % 4 = 0 THEN [gx, gx + 10] ELSE [gx] END) AS px FROM b), aoi AS (SELECT n_nationkey::BIGINT AS aoi_id, n_nationkey % 5 * 64 + 7 AS ax, 7 AS ay FROM nation)"
COVER = "SELECT {} AS SOURCE, {} AS YEAR_COMP, count(*) AS n_records, coalesce(sum({}), 0) AS acres, coalesce(string_agg(DISTINCT AGENCY_C, '|' ORDER BY AGENCY_C), '') AS agencies"
_SIZE = "CASE WHEN ACRES_GIS <= 0 THEN NULL WHEN ACRES_GIS <= 1 THEN '0-1' WHEN ACRES_GIS <= 10 THEN '1-10' WHEN ACRES_GIS <= 100 THEN '10-100' WHEN ACRES_GIS <= 1000 THEN '100-1k' WHEN ACRES_GIS <= 10000 THEN '1k-10k' WHEN ACRES_GIS IS NOT NULL THEN '>10k' END"
_PROFILE = "SELECT '{0}' AS \"column\", count({0}) AS count, avg({0}) AS mean, stddev_samp({0}) AS std, min({0})::DOUBLE AS min, quantile_cont({0}::DOUBLE, 0.25) AS p25, quantile_cont({0}::DOUBLE, 0.5) AS p50, quantile_cont({0}::DOUBLE, 0.75) AS p75, max({0})::DOUBLE AS max FROM t"

ORACLES = {
    "source_coverage_raw": f"WITH {TREATMENTS} {COVER.format('SOURCE', 'YEAR_COMP', 'ACRES_GIS')} FROM t GROUP BY SOURCE, YEAR_COMP",
    "source_coverage_events": f"WITH {EVENTS} {COVER.format('SOURCE', 'YEAR_COMP', 'ACRES')} FROM e GROUP BY SOURCE, YEAR_COMP",
    "reconcile_audit": f"WITH {AUDIT} SELECT * FROM audit",
    "reconcile_summary": f"WITH {AUDIT} SELECT CLASS, count(*) AS atoms, sum(ACRES) AS acres FROM audit GROUP BY CLASS",
    "atom_labels": f"WITH {ZONES} SELECT * EXCLUDE (ACRES) FROM a",
    "atom_years": f"WITH {ZONES} SELECT ATOM_ID, ACTIVITY, string_agg(DISTINCT YEAR_COMP::VARCHAR, '|' ORDER BY YEAR_COMP::VARCHAR) AS years FROM counted GROUP BY ATOM_ID, ACTIVITY",
    "events_to_rows": f"WITH {EVENTS} SELECT ATOM_ID, ACRES AS ACRES_GIS, OBJECTID AS SOURCE_ID, ACTIVITY, YEAR_COMP, AGENCY_C, FUND_SOURCE, FUND_TYPE, LANDOWNER, SOURCE FROM e",
    "extract_field": f"WITH {EVENTS} SELECT ATOM_ID, string_agg(DISTINCT AGENCY_C, '|' ORDER BY AGENCY_C) AS AGENCY_LIST FROM e GROUP BY ATOM_ID",
    "event_json": f"WITH {EVENTS} SELECT ATOM_ID, count(*)::INTEGER AS n, count(*) FILTER (YEAR_COMP IS NULL)::INTEGER AS n_no_year FROM e GROUP BY ATOM_ID",
    "event_variants": f"WITH {EVENTS} SELECT ATOM_ID, min(OBJECTID) OVER (PARTITION BY ATOM_ID) AS least_id, true AS has_first, OBJECTID AS SOURCE_ID, ACTIVITY, YEAR_COMP, AGENCY_C, FUND_SOURCE, FUND_TYPE, LANDOWNER, SOURCE FROM e",
    "filter_activity_any": f"WITH {ZONES} SELECT ATOM_ID, TRT_ACTIVITIES FROM a WHERE list_has_any(string_split(TRT_ACTIVITIES, '|'), ['Mastication', 'Removal'])",
    "filter_activity_all": f"WITH {ZONES} SELECT ATOM_ID, TRT_ACTIVITIES FROM a WHERE list_has_all(string_split(TRT_ACTIVITIES, '|'), ['Mastication', 'Removal'])",
    "filter_year_range": f"WITH {ZONES} SELECT ATOM_ID, TRT_ACTIVITIES FROM a WHERE FIRST_TRT_YEAR <= 2011 AND LAST_TRT_YEAR >= 2010",
    "filter_complete": f"WITH {ZONES} SELECT ATOM_ID, TRT_ACTIVITIES FROM a WHERE COMPLETE AND TRT_EFF = 'Mechanical + Broadcast Burn'",
    "acres_by_activity": f"WITH {EVENTS} SELECT ACTIVITY, sum(ACRES) AS acres FROM e WHERE ACTIVITY IS NOT NULL GROUP BY ACTIVITY",
    "acres_by_effect": f"WITH {ZONES} SELECT TRT_EFF, count(*) AS atoms, sum(ACRES) AS acres, count(*) FILTER (COMPLETE) AS complete FROM a GROUP BY TRT_EFF",
    "trt_eff_counts": f"WITH {ZONES} SELECT TRT_EFF, count(*) AS n FROM a GROUP BY TRT_EFF",
    "value_counts": f"WITH {TREATMENTS} SELECT count(DISTINCT AGENCY_C) AS agencies, count(DISTINCT FUND_SOURCE) AS funds, count(DISTINCT ACTIVITY) AS activities, bool_or(ACTIVITY IS NULL) AS has_null_activity, min(YEAR_COMP) AS first_year, max(YEAR_COMP) AS last_year, sum(ACRES_GIS) AS acres FROM t",
    "numeric_profile": f"WITH {TREATMENTS} {_PROFILE.format('ACRES_GIS')} UNION ALL {_PROFILE.format('YEAR_COMP')}",
    "agencies_distinct": f"WITH {TREATMENTS} SELECT DISTINCT trim(AGENCY_C) AS member FROM t WHERE AGENCY_C IS NOT NULL",
    "flag_acre_mismatch": f"WITH {FLAGS} SELECT OBJECTID, round(acres_diff, 6) AS acres_diff, round(log_ac_pred, 6) AS log_ac_pred, round(log_ac_resid, 6) AS log_ac_resid, ac_flag, ac_flag_abs FROM fl",
    "flag_by_activity": f"WITH {FLAGS} SELECT ACTIVITY, count(*) AS n, median(acres_diff) AS median_diff FROM fl WHERE ac_flag AND ACTIVITY IS NOT NULL GROUP BY ACTIVITY",
    "flag_rate_by_size": f"WITH {FLAGS} SELECT {_SIZE} AS size_class, count(*) AS n, 100 * avg(ac_flag::INT) AS rate FROM fl WHERE {_SIZE} IS NOT NULL GROUP BY 1 UNION ALL SELECT 'all', count(*), 100 * avg(ac_flag::INT) FROM fl",
    "residual_hist": f"WITH {FLAGS}, mm AS (SELECT min(log_ac_resid) AS lo, (max(log_ac_resid) - min(log_ac_resid)) / 49 AS wd FROM fl) SELECT least(floor((log_ac_resid - lo) / wd), 48)::INTEGER AS bin, count(*) FILTER (NOT ac_flag) AS kept, count(*) FILTER (ac_flag) AS flagged FROM fl, mm WHERE log_ac_resid IS NOT NULL GROUP BY 1",
    "flag_counts": f"WITH {FLAGS} SELECT count(*) FILTER (ac_flag) AS residual, count(*) FILTER (ac_flag_abs) AS absolute, count(*) FILTER (ac_flag OR ac_flag_abs) AS either FROM fl",
    "unflagged": f"WITH {FLAGS} SELECT ACTIVITY, count(*) AS n, round(sum(ACRES_GIS), 4) AS acres FROM fl WHERE NOT (ac_flag OR ac_flag_abs) GROUP BY ACTIVITY",
    "share_missing": f"WITH {FLAGS} SELECT count(*) AS n, avg((ACRES_MGT IS NULL)::INT) AS ACRES_MGT_null, avg((ACRES_GIS IS NULL)::INT) AS ACRES_GIS_null, avg(coalesce(ACRES_MGT = 0, false)::INT) AS ACRES_MGT_zero, avg(coalesce(ACRES_GIS = 0, false)::INT) AS ACRES_GIS_zero FROM i",
    "log_fit": f"WITH {FLAGS} SELECT * FROM fit",
    "harmonize": f"WITH {HARMONIZE} SELECT record, RESOLVED AS ACTIVITY, ACTIVITY_FIELD, ACTIVITY_CONF, ACTIVITY_STATUS, RAN_CLASSIFY_THIN, acres AS ACRES_REPORTED FROM h",
    "harmonize_summary": f"WITH {HARMONIZE}, s3 AS (SELECT unnest(['resolved', 'dropped', 'quarantined']) AS ACTIVITY_STATUS) SELECT ACTIVITY_STATUS, count(record) AS records, coalesce(sum(acres), 0) AS acres, count(*) FILTER (RAN_CLASSIFY_THIN) AS n_thin FROM s3 LEFT JOIN h USING (ACTIVITY_STATUS) GROUP BY ACTIVITY_STATUS",
    "quarantine_summary": f"WITH {HARMONIZE} SELECT activity, type, method, twig_category, count(*) AS records, sum(acres) AS acres FROM h WHERE ACTIVITY_STATUS = 'quarantined' GROUP BY 1, 2, 3, 4",
    "to_event_schema": f"WITH {HARMONIZE} SELECT 100 + record AS OBJECTID, RESOLVED AS ACTIVITY, year(l_shipdate)::INTEGER AS YEAR_COMP, CASE l_orderkey % 4 WHEN 0 THEN {_text(FUNDING['BIL'])} WHEN 1 THEN {_text(FUNDING['CFLR'])} ELSE 'GAOA' END AS FUND_SOURCE, 'TWIG' AS SOURCE FROM h WHERE RESOLVED IS NOT NULL",
    "combine_sources": f"WITH {TREATMENTS} SELECT row_number() OVER (ORDER BY SOURCE, OBJECTID) AS OBJECTID, ACTIVITY, YEAR_COMP, AGENCY_C, SOURCE FROM t",
    "dense_ids": f"WITH {TREATMENTS} SELECT ZONE, OBJECTID AS old, row_number() OVER (ORDER BY ZONE, OBJECTID) AS new FROM t",
    "qa_filters": "SELECT l_orderkey * 8 + l_linenumber AS record, 'Completed' AS status, NULL::VARCHAR AS error, year(l_shipdate)::INTEGER AS YEAR_COMP FROM lineitem WHERE l_orderkey % 5 <> 0 AND l_orderkey % 7 <> 0 AND year(l_shipdate) BETWEEN 1993 AND 1996",
    "year_comp_from_ms": "SELECT event_id, year(ts)::INTEGER AS YEAR_COMP FROM events",
    "area_acres": f"WITH {BOXES} SELECT OBJECTID, w * h * 900 * 0.000247105::DOUBLE AS acres FROM b",
    "drop_slivers": f"WITH {BOXES} SELECT OBJECTID, (w * h * 900)::DOUBLE AS area FROM b WHERE w * h > 2",
    "snap_to_grid": f"WITH {BOXES}, g AS (SELECT OBJECTID, 50 * (floor((gx + w) * 30 / 50 + 0.5) - floor(gx * 30 / 50 + 0.5)) AS dx, 50 * (floor((gy + h) * 30 / 50 + 0.5) - floor(gy * 30 / 50 + 0.5)) AS dy FROM b) SELECT OBJECTID, (dx * dy)::DOUBLE AS area FROM g WHERE dx > 0 AND dy > 0",
    "centroids": f"WITH {BOXES} SELECT OBJECTID, (gx + w / 2) * 30 AS x, (gy + h / 2) * 30 AS y, (gx * 30)::DOUBLE AS xmin, (gy * 30)::DOUBLE AS ymin, ((gx + w) * 30)::DOUBLE AS xmax, ((gy + h) * 30)::DOUBLE AS ymax FROM b",
    "reproject_round_trip": f"WITH {BOXES} SELECT OBJECTID, (gx * 30 + 440000)::DOUBLE AS xmin, (gy * 30 + 4300000)::DOUBLE AS ymin FROM b",
    "centroid_grid_heatmap": f"WITH {BOXES}, c AS (SELECT floor((gx + w / 2) * 30 / 5000) AS i, floor((gy + h / 2) * 30 / 5000) AS j FROM b) SELECT i::INTEGER AS ix, j::INTEGER AS iy, count(*) AS n FROM c WHERE i < 25 AND j < 25 GROUP BY 1, 2",
    "assign_points": f"WITH {BOXES} SELECT b.OBJECTID AS point, string_agg(cells.OBJECTID::VARCHAR, '|' ORDER BY cells.OBJECTID) AS ids FROM b JOIN cells ON x = gx AND y = gy GROUP BY b.OBJECTID",
    "clip_intersects": f"WITH {AOI} SELECT OBJECTID, aoi_id FROM b JOIN aoi ON gx <= ax + 20 AND gx + w >= ax AND gy <= ay + 20 AND gy + h >= ay",
    "overlay_intersection": f"WITH {AOI} SELECT OBJECTID, aoi_id, ((least(gx + w, ax + 20) - greatest(gx, ax)) * (least(gy + h, ay + 20) - greatest(gy, ay)) * 900)::DOUBLE AS area FROM b JOIN aoi ON gx < ax + 20 AND gx + w > ax AND gy < ay + 20 AND gy + h > ay",
    "atomic_cover_areas": f"WITH {BOXES}, cv AS (SELECT x, y, string_agg(OBJECTID::VARCHAR, '|' ORDER BY OBJECTID) AS ids FROM cells GROUP BY x, y) SELECT ids, (count(*) * 900)::DOUBLE AS area FROM cv GROUP BY ids",
    "dissolve_by_activity": f"WITH {BOXES}, cv AS (SELECT DISTINCT ACTIVITY, x, y FROM cells) SELECT ACTIVITY, (count(*) * 900)::DOUBLE AS area FROM cv GROUP BY ACTIVITY",
    "exact_duplicates": f"WITH {BOXES} SELECT min(OBJECTID) AS first_id, count(*) AS n FROM b GROUP BY gx, gy, w, h, ACTIVITY HAVING count(*) > 1",
    "feature_pages": f"WITH {BOXES} SELECT OBJECTID, ACTIVITY, YEAR_COMP, (w * h * 900)::DOUBLE AS area FROM b WHERE YEAR_COMP >= 2010",
    "layer_window": f"WITH {BOXES} SELECT OBJECTID, (gx * 30)::DOUBLE AS xmin, (gy * 30)::DOUBLE AS ymin, ((gx + w) * 30)::DOUBLE AS xmax, ((gy + h) * 30)::DOUBLE AS ymax FROM b WHERE gx * 30 <= 45000 AND (gx + w) * 30 >= 30000 AND gy * 30 <= 2400 AND (gy + h) * 30 >= 300",
    "within_boundaries": f"""WITH {BOXES}, d AS (SELECT DISTINCT c_custkey::BIGINT // 100 AS aoi_id FROM customer),
aoi AS (SELECT aoi_id, lpad(n_nationkey::VARCHAR, 2, '0') AS code, n_name AS name, aoi_id % 64 * 64 + 7 AS ax, aoi_id // 64 * 64 + 7 AS ay FROM d JOIN nation ON n_nationkey = aoi_id % 25 WHERE n_nationkey IN (0, 1))
SELECT OBJECTID, aoi_id, code, name, ((least(gx + w, ax + 40) - greatest(gx, ax)) * (least(gy + h, ay + 40) - greatest(gy, ay)) * 900)::DOUBLE AS area FROM b JOIN aoi ON gx < ax + 40 AND gx + w > ax AND gy < ay + 40 AND gy + h > ay""",
    "saved_layer": f"WITH {BOXES} SELECT OBJECTID, (gx * 30)::DOUBLE AS xmin, (gy * 30)::DOUBLE AS ymin, ((gx + w) * 30)::DOUBLE AS xmax, ((gy + h) * 30)::DOUBLE AS ymax FROM b WHERE gx * 30 <= 9000 AND (gx + w) * 30 >= 6000 AND gy * 30 <= 1500 AND (gy + h) * 30 >= 600",
    "members_of": f"WITH {TREATMENTS} SELECT OBJECTID, ZONE FROM t WHERE ZONE IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1))",
    "described_layer": f"WITH {TREATMENTS} SELECT ZONE, OBJECTID AS old, 'north' AS PROJECT, 2 AS PHASE, row_number() OVER (ORDER BY ZONE, t.OBJECTID) AS OBJECTID FROM t",
    "year_bounds": f"WITH {EVENTS} SELECT ATOM_ID, min(YEAR_COMP) AS FIRST_TRT_YEAR, max(YEAR_COMP) AS LAST_TRT_YEAR FROM e GROUP BY ATOM_ID",
    "complete_in_order": f"WITH {EVENTS} SELECT ATOM_ID, coalesce(min(YEAR_COMP) FILTER (ACTIVITY = 'Broadcast Burn') >= min(YEAR_COMP) FILTER (ACTIVITY IN ('Manual', 'Mechanical')), false) AS COMPLETE FROM e GROUP BY ATOM_ID",
    "activity_order": f"WITH {TREATMENTS}, o AS (SELECT ['Mechanical', 'Manual', 'Mastication', 'Removal', 'Pile Burn', 'Pile Fuels', 'Chipping', 'Mulching', 'Lop and Scatter', 'Broadcast Burn', 'Prescribed Burn (Range)', 'Fire Use'] AS a) SELECT coalesce(nullif(coalesce(list_position(a, ACTIVITY), 0), 0), 13)::INTEGER AS place, CASE WHEN list_contains(a, ACTIVITY) THEN ACTIVITY ELSE 'Other' END AS category, count(*) AS n FROM t, o GROUP BY 1, 2",
    "first_atom": f"WITH {ZONES} SELECT ATOM_ID, N_EVENTS, TRT_ACTIVITIES FROM a ORDER BY ATOM_ID LIMIT 1",
    "overlay_attributes": f"WITH {AOI} SELECT OBJECTID, aoi_id, ACTIVITY, n_name AS ACTIVITY_aoi, n_regionkey AS region, ((least(gx + w, ax + 20) - greatest(gx, ax)) * (least(gy + h, ay + 20) - greatest(gy, ay)) * 900)::DOUBLE AS area FROM b JOIN aoi ON gx < ax + 20 AND gx + w > ax AND gy < ay + 20 AND gy + h > ay JOIN nation ON n_nationkey = aoi_id",
    "dissolve_duplicates": f"WITH {BOXES} SELECT min(OBJECTID) AS OBJECTID, string_agg(OBJECTID::VARCHAR, '|' ORDER BY OBJECTID) AS ids, count(*) AS records, min(YEAR_COMP) AS first_year, coalesce(string_agg(DISTINCT trim(AGENCY_C), '|' ORDER BY trim(AGENCY_C)), '') AS agencies FROM b GROUP BY gx, gy, w, h, ACTIVITY HAVING count(*) > 1",
    "explode_parts": f"WITH {SECOND} SELECT OBJECTID AS record, (px * 30)::DOUBLE AS xmin, (w * h * 900)::DOUBLE AS area FROM src",
    "repair_bow_ties": f"WITH {BOXES} SELECT OBJECTID, (w * h * 450)::DOUBLE AS area, 2 AS parts FROM b",
    "zones_by_inner_point": f"WITH {BOXES} SELECT DISTINCT ids FROM (SELECT string_agg(OBJECTID::VARCHAR, '|' ORDER BY OBJECTID) AS ids FROM cells GROUP BY x, y)",
    "ingest_second_source": f"WITH {SECOND} SELECT OBJECTID AS record, aoi_id, YEAR_COMP, (px * 30)::DOUBLE AS xmin, round(w * h * 900 * 0.000247105::DOUBLE, 6) AS GIS_ACRES FROM src JOIN aoi ON px <= ax + 20 AND px + w >= ax AND gy <= ay + 20 AND gy + h >= ay WHERE OBJECTID % 5 <> 0 AND OBJECTID % 7 <> 0 AND YEAR_COMP BETWEEN 2008 AND 2012",
    "harmonize_crosswalk": f"WITH {XWALK} SELECT record, CASE WHEN status = 'resolved' THEN final END AS ACTIVITY, CASE WHEN veto THEN 'wildfire' WHEN chosen OR target = 'DROP' THEN field END AS ACTIVITY_FIELD, status AS ACTIVITY_STATUS FROM e",
    "dedupe_events": f"WITH RECURSIVE {DEDUPE.strip()} SELECT ATOM_ID, count(*)::INTEGER AS n_events, any_value(n_ids)::INTEGER AS n_ids, string_agg(s, '|' ORDER BY i) AS events FROM said GROUP BY ATOM_ID",
    "build_interactions": f"WITH RECURSIVE {LAYER.strip()} SELECT ATOM_ID, N_EVENTS, {_KEYS}, FUND_SOURCES, ACRES_GIS, array_to_string(ids, '|') AS SOURCE_IDS FROM layer",
    "event_points": f"WITH RECURSIVE {LAYER.strip()} SELECT floor(cx / 5000)::INTEGER AS ix, floor(cy / 5000)::INTEGER AS iy, sum(N_EVENTS)::BIGINT AS n FROM layer GROUP BY 1, 2",
    "interactions_by_effect": f"""WITH {BOXES},
cv AS (SELECT x, y, list(DISTINCT ACTIVITY) FILTER (ACTIVITY IS NOT NULL AND YEAR_COMP IS NOT NULL) AS acts FROM cells GROUP BY x, y),
ef AS (
  SELECT coalesce(list_sort(acts), []) AS p,
         ['Broadcast Burn', 'Mechanical', 'Manual', 'Mastication', 'Removal', 'Pile Burn', 'Pile Fuels', 'Chipping', 'Mulching', 'Lop and Scatter'] AS s FROM cv),
n AS (
  SELECT CASE WHEN len(p) = 0 THEN 'Unknown' WHEN list_has_all(p, ['Mechanical', 'Broadcast Burn']) THEN 'Mechanical + Broadcast Burn'
              WHEN list_has_all(p, ['Manual', 'Broadcast Burn']) THEN 'Manual + Broadcast Burn'
              ELSE coalesce(list_filter(s, lambda v: list_contains(p, v))[1], array_to_string(p, ' + ')) END AS TRT_EFF,
         list_has_any(p, ['Manual', 'Mechanical']) AND list_contains(p, 'Broadcast Burn') AS done FROM ef)
SELECT TRT_EFF, round(count(*) * 900 * 0.000247105::DOUBLE, 2) AS acres, round(count(*) FILTER (done) * 900 * 0.000247105::DOUBLE, 2) AS acres_complete FROM n GROUP BY TRT_EFF""",
}
ORACLES["interactions_pre_dissolved"] = ORACLES["interactions_by_effect"]
