"""Rule-adjustment queries over the whole property table."""

from __future__ import annotations

from pyspark.sql import functions as F

from terravalor import constants as K
from terravalor.operators import rules, spatial
from terravalor.plans.proxies import ORACLE_ONLY
from terravalor.plans.q_spatial import hav
from terravalor.plans.registry import query, rounded

AS_OF = "2026-03-15"

ORACLE_ONLY["o_rule_rows"] = """
SELECT p.*, r.* EXCLUDE (pid), make_date(p.tax_assessment_year - 1, 7, 1) AS assessment_date
FROM o_properties p JOIN px_rule_inputs r USING (pid)
"""
_SENS = "CASE property_type WHEN 'condo' THEN -0.05 WHEN 'townhome' THEN -0.04 WHEN 'detached' THEN -0.03 WHEN 'development_land' THEN -0.02 ELSE -0.03 END"
_MARKET = f"(greatest(0.75, least(1.25, 1.0 + CAST({_SENS} AS DOUBLE) * (current_rate - assessment_rate))) * CAST(1.02 AS DOUBLE))"
_LEASE = """(CASE WHEN lease_type = 'freehold' OR lease_remaining_years IS NULL THEN 0 ELSE least(1, greatest(0,
  CASE WHEN y >= 80 THEN 0 WHEN y >= 70 THEN 0.03 * (80 - y) / 10 WHEN y >= 50 THEN 0.03 + 0.07 * (70 - y) / 20
       WHEN y >= 40 THEN 0.10 + 0.10 * (50 - y) / 10 WHEN y >= 30 THEN 0.20 + 0.15 * (40 - y) / 10
       WHEN y >= 25 THEN 0.35 + 0.15 * (30 - y) / 5 WHEN y >= 15 THEN 0.50 + 0.25 * (25 - y) / 10
       WHEN y >= 5 THEN 0.75 + 0.15 * (15 - y) / 10 ELSE 0.90 + 0.10 * (5 - y) / 5 END
  + CASE lease_type WHEN 'non_prepaid' THEN 0.15 WHEN 'first_nations' THEN 0.20 ELSE 0 END)) END)""".replace("y >=", "lease_remaining_years >=").replace("- y)", "- lease_remaining_years)")


def _station_min() -> str:
    return "least(" + ", ".join(hav("latitude", "longitude", str(a), str(b)) for a, b in K.STATIONS) + ")"


_CORR = "CASE " + " ".join(
    f"WHEN latitude BETWEEN CAST({s} AS DOUBLE) AND CAST({n} AS DOUBLE) AND longitude BETWEEN CAST({w} AS DOUBLE) AND CAST({e} AS DOUBLE) THEN {{v{i}}}"
    for i, (_, s, n, w, e, _p) in enumerate(K.CORRIDORS)
) + " END"
_CORR_NAME = _CORR.format(**{f"v{i}": "'" + c[0] + "'" for i, c in enumerate(K.CORRIDORS)})
_CORR_BASE = _CORR.format(**{f"v{i}": str(c[5]) for i, c in enumerate(K.CORRIDORS)})
_MF = ", ".join(f"'{z}'" for z in K.MULTI_FAMILY_ZONES)
_ASSEMBLY = f"""(CASE WHEN {_CORR_BASE} IS NULL OR coalesce(year_built, 0) >= 2016 OR current_improvement_value > 500000 THEN 0 ELSE
  least(0.40, {_CORR_BASE} + CASE WHEN lot_frontage_ft BETWEEN 30 AND 40 THEN 0.05 ELSE 0 END + CASE WHEN is_corner_lot THEN 0.05 ELSE 0 END
   + CASE WHEN round({_station_min()}, 1) <= 200 THEN 0.10 WHEN round({_station_min()}, 1) <= 400 THEN 0.05 ELSE 0 END
   + CASE WHEN zoning_district IN ({_MF}) OR split_part(zoning_district, '-', 1) IN ({_MF}) THEN 0.05 ELSE 0 END) END)"""


def _supply() -> str:
    parts = []
    for _, la, lo, units, tenure, _s in K.PROJECTS:
        i = ("strata", "rental", "mixed").index(tenure)
        sens = "CASE property_type " + " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in K.SUPPLY_EFFECT.items()) + " ELSE -0.001 END"
        d = hav("latitude", "longitude", str(la), str(lo))
        parts.append(f"CASE WHEN {d} <= 1000 THEN CAST({sens} AS DOUBLE) * {units} / 500.0 * greatest(0.5, 1.0 - 0.5 * {d} / 1000.0) ELSE 0 END")
    return "greatest(-0.05, least(0.03, " + " + ".join(parts) + "))"


_STRATA = """greatest(-0.25, CASE WHEN depreciation_report_age_months IS NULL OR depreciation_report_age_months > 60 THEN -0.03 WHEN depreciation_report_age_months > 36 THEN -0.01 ELSE 0 END
 + CASE WHEN contingency_reserve_pct < 25 THEN -0.05 WHEN contingency_reserve_pct < 50 THEN -0.02 ELSE 0 END
 + CASE WHEN special_assessment_total_5yr > 0 THEN -0.02 * special_assessment_total_5yr / 10000 ELSE 0 END
 + CASE WHEN insurance_deductible > 500000 THEN -0.05 WHEN insurance_deductible > 250000 THEN -0.03 WHEN insurance_deductible > 100000 THEN -0.01 ELSE 0 END
 + CASE WHEN year_built BETWEEN 1981 AND 1999 THEN CASE rainscreen_status WHEN 'Yes' THEN -0.02 WHEN 'Partial' THEN -0.05 ELSE -0.10 END ELSE 0 END
 + CASE WHEN crt_dispute_count_3yr > 5 THEN -0.05 WHEN crt_dispute_count_3yr > 3 THEN -0.02 ELSE 0 END)"""
_ANY = "(depreciation_report_age_months IS NOT NULL OR contingency_reserve_pct IS NOT NULL OR special_assessment_total_5yr IS NOT NULL OR insurance_deductible IS NOT NULL OR rainscreen_status IS NOT NULL OR crt_dispute_count_3yr IS NOT NULL)"


def rule_rows(t):
    return t.properties.join(t("px_rule_inputs"), "pid").withColumn(
        "assessment_date", F.make_date(F.col("tax_assessment_year") - 1, F.lit(7), F.lit(1))
    )


@query("r01_market_time", f"SELECT pid, round({_MARKET}, 8) AS factor FROM o_rule_rows")
def r01(t):
    f = rules.market_time_factor(
        F.col("property_type"), F.col("assessment_date"), F.to_date(F.lit(AS_OF)), F.col("assessment_rate"), F.col("current_rate")
    )
    return rule_rows(t).select("pid", F.round(f, 8).alias("factor"))


@query("r02_lease_discount", f"SELECT pid, lease_type, round({_LEASE}, 8) AS discount FROM o_rule_rows")
def r02(t):
    return rule_rows(t).select(
        "pid", "lease_type", F.round(rules.lease_discount(F.col("lease_remaining_years"), F.col("lease_type")), 8).alias("discount")
    )


@query("j21_corridor_of_property", f"SELECT pid, {_CORR_NAME} AS corridor FROM o_properties WHERE {_CORR_NAME} IS NOT NULL")
def j21(t):
    c = rules.corridor_of(F.col("latitude"), F.col("longitude"))
    return t.properties.select("pid", c["corridor"].alias("corridor")).where("corridor IS NOT NULL")


@query("r03_assembly_premium", f"SELECT pid, round({_ASSEMBLY}, 8) AS premium FROM o_rule_rows")
def r03(t):
    p = rules.assembly_premium(
        F.col("latitude"), F.col("longitude"), F.col("zoning_district"), F.col("lot_frontage_ft"), F.col("is_corner_lot"),
        F.col("current_improvement_value"), F.col("year_built"), 2026,
    )
    return rule_rows(t).select("pid", F.round(p, 8).alias("premium"))


@query(
    "j22_projects_nearby",
    "WITH pr AS (SELECT * FROM (VALUES " + ", ".join(f"('{p[0]}', {p[1]}, {p[2]})" for p in K.PROJECTS) + ") v(project, la, lo)) "
    f"SELECT pid, project, round({hav('latitude', 'longitude', 'la', 'lo')}, 3) AS dist_m FROM o_properties, pr WHERE {hav('latitude', 'longitude', 'la', 'lo')} <= 1000",
)
def j22(t):
    from terravalor.operators import layers

    projects = layers.project_table(t.spark)
    layer = spatial.point_layer(projects, "p_lat", "p_lon", by=["project"])
    near = spatial.pairs_within(t.locations, layer, 1_000.0).withColumnsRenamed({"lat": "latitude", "lon": "longitude"})
    return t.properties.join(near, ["latitude", "longitude"]).select("pid", "project", F.round("dist_m", 3).alias("dist_m"))


@query("r04_supply_effect", f"SELECT pid, round({_supply()}, 8) AS effect FROM o_rule_rows")
def r04(t):
    e = rules.supply_effect(F.col("latitude"), F.col("longitude"), F.col("property_type"))
    return rule_rows(t).select("pid", F.round(e, 8).alias("effect"))


@query("r05_strata_penalty", f"SELECT pid, round({_STRATA}, 8) AS penalty FROM o_rule_rows")
def r05(t):
    return rule_rows(t).select("pid", F.round(rules.strata_penalty(), 8).alias("penalty"))


@query(
    "r06_all_rules",
    f"""SELECT pid, round(total_assessed_value * {_MARKET} * (1 - {_LEASE}) * (1 + CASE WHEN property_type IN ('condo', 'townhome') THEN 0 ELSE {_ASSEMBLY} END)
          * (1 + {_supply()}) * (1 + CASE WHEN property_type IN ('condo', 'townhome') AND {_ANY} THEN {_STRATA} ELSE 0 END), 2) AS adjusted_value
        FROM o_rule_rows""",
)
def r06(t):
    out = rules.apply_rules(rule_rows(t), "total_assessed_value", AS_OF)
    return out.select("pid", F.round("adjusted_value", 2).alias("adjusted_value"))


@query(
    "p33_risk_flags",
    """WITH f AS (SELECT pid, lease_type, lease_remaining_years, year_built, rainscreen_status, zoning_district FROM o_rule_rows)
       SELECT pid, concat_ws(',', CASE WHEN lease_type <> 'freehold' AND lease_remaining_years < 40 THEN 'leasehold' END,
         CASE WHEN year_built BETWEEN 1982 AND 2000 THEN 'building_envelope' END) AS flags FROM f""",
)
def p33(t):
    rows = rule_rows(t).withColumns(
        {
            "construction_type": F.lit("wood_frame"), "in_floodplain": F.lit(False), "in_alr": F.lit(False),
            "dist_nearest_contaminated_m": F.lit(None).cast("double"), "completeness_pct": F.lit(100.0),
        }
    )
    return rows.select("pid", F.array_join(F.transform(rules.risk_flags(), lambda x: x["category"]), ",").alias("flags"))


@query(
    "p34_confidence_grade",
    """SELECT poi_id, CASE WHEN availability_365 % 101 > 80 AND poi_id % 8 >= 5 AND number_of_reviews % 30 < 14 THEN 'A'
         WHEN availability_365 % 101 > 60 AND poi_id % 8 >= 3 AND number_of_reviews % 30 < 24 THEN 'B' ELSE 'C' END AS grade FROM px_poi""",
)
def p34(t):
    g = rules.confidence_grade(F.col("availability_365") % 101, F.col("poi_id") % 8, F.col("number_of_reviews") % 30)
    return t("px_poi").select("poi_id", g.alias("grade"))


@query(
    "p35_sane_interval",
    """WITH x AS (SELECT pid, total_assessed_value AS v, total_assessed_value * (0.7 + CAST(pid AS BIGINT) % 5 * 0.1) AS lo,
           total_assessed_value * (0.9 + CAST(pid AS BIGINT) % 7 * 0.1) AS hi FROM o_universe)
       SELECT pid, round(CASE WHEN lo > v OR hi < v THEN v * 0.85 ELSE lo END, 2) AS lower, round(CASE WHEN lo > v OR hi < v THEN v * 1.15 ELSE hi END, 2) AS upper FROM x""",
)
def p35(t):
    v, k = F.col("total_assessed_value"), F.col("pid").cast("long")
    i = rules.sane_interval(v * (F.lit(0.7) + k % 5 * F.lit(0.1)), v * (F.lit(0.9) + k % 7 * F.lit(0.1)), v)
    return rounded(t.universe.select("pid", i["lower"].alias("lower"), i["upper"].alias("upper")), 2)


@query(
    "p35_rescaled_interval",
    """WITH x AS (SELECT pid, total_assessed_value AS v, total_assessed_value * (0.8 + CAST(pid AS BIGINT) % 6 * 0.1) AS p,
           total_assessed_value * (0.75 + CAST(pid AS BIGINT) % 5 * 0.05) AS lo, total_assessed_value * (0.97 + CAST(pid AS BIGINT) % 7 * 0.05) AS hi FROM o_universe WHERE total_assessed_value > 0),
       y AS (SELECT pid, p, lo * (p / v) AS lo, hi * (p / v) AS hi FROM x),
       z AS (SELECT *, lo <= 0 OR hi <= 0 OR lo > p OR hi < p OR (hi - lo) / p * 100 < 5 AS bad FROM y)
       SELECT pid, round(CASE WHEN bad THEN p * 0.85 ELSE lo END, 0) AS lower, round(CASE WHEN bad THEN p * 1.15 ELSE hi END, 0) AS upper FROM z""",
)
def p35r(t):
    """Intervals moved to another headline figure; reset where they miss it or are too narrow."""
    v, k = F.col("total_assessed_value"), F.col("pid").cast("long")
    primary = v * (F.lit(0.8) + k % 6 * F.lit(0.1))
    i = rules.rescaled_interval(v * (F.lit(0.75) + k % 5 * F.lit(0.05)), v * (F.lit(0.97) + k % 7 * F.lit(0.05)), v, primary)
    return rounded(t.universe.where(v > 0).select("pid", i["lower"].alias("lower"), i["upper"].alias("upper")), 0)
