"""Hand rows with exact expected values for the rule operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from terravalor.functions import dates, text
from terravalor.operators import comps, features, gram_index, ingest, match, rates, rules, structure, universe
from terravalor.session import landing_path


def one(spark, rows, schema, *columns):
    out = spark.createDataFrame(rows, schema).select(*columns)
    return [tuple(r) if len(r) > 1 else r[0] for r in out.collect()]


def test_property_type(spark):
    rows = [
        ("RS-1", "LAND"), ("RM-3A", "STRATA"), ("RM-5B", None), ("I-2", None), ("CD-1 (12)", "STRATA"), ("CD-1", "LAND"),
        ("C-2", "STRATA"), ("C-2", "LAND"), ("R1-1", "STRATA"), ("XX", "STRATA"), (None, None), ("I-2 X", None), ("M-1A", None),
    ]
    got = one(spark, rows, "z string, l string", universe.classify(F.col("z"), F.col("l")))
    assert got == [
        "detached", "townhome", "condo", "development_land", "condo", "development_land", "condo", "development_land", "detached",
        "condo", "detached", "development_land", "development_land",
    ]


def test_best_civic_and_address(spark):
    civic = universe.best_civic(F.col("f"), F.col("t"))
    got = one(spark, [(0.0, 120.0), (0.0, 0.0), (7.0, 120.0), (None, None)], "f double, t double", universe.full_address(civic, F.lit("MAIN ST")))
    assert got == ["120 MAIN ST", "MAIN ST", "7 MAIN ST", "MAIN ST"]


def test_bedrooms(spark):
    rows = [(599.0,), (600.0,), (900.0,), (1300.0,), (1800.0,), (2500.0,), (None,)]
    assert one(spark, rows, "a double", features.bedrooms_from_area(F.col("a"))) == [0, 1, 2, 3, 4, 5, None]


def test_stories(spark):
    rows = [(1_999.0,), (3_500.0,), (60_000.0,), (5_000.0,), (None,)]
    assert one(spark, rows, "x double", structure.stories_from_intensity(F.col("x"))) == [1.5, 2.25, 35.0, 3.0, None]
    zones = [("RM-3A",), ("RM-3",), ("RS-1",), ("ZZ",), (None,)]
    assert one(spark, zones, "z string", structure.stories_from_zone(F.col("z"))) == [4.0, 4.0, 2.0, 2.0, None]


@pytest.mark.parametrize(
    "years, want",
    [(80, 0), (75, 0.015), (60, 0.065), (45, 0.15), (35, 0.275), (27, 0.44), (20, 0.625), (10, 0.825), (2, 0.96), (70, 0.03), (50, 0.10), (0, 1.0)],
)
def test_lease_discount(spark, years, want):
    got = one(spark, [(float(years),)], "y double", rules.lease_discount(F.col("y"), F.lit("prepaid")))[0]
    assert got == pytest.approx(want)


def test_lease_penalties(spark):
    rows = [(60.0, "non_prepaid"), (60.0, "first_nations"), (2.0, "first_nations"), (60.0, "freehold"), (None, "prepaid")]
    got = one(spark, rows, "y double, t string", rules.lease_discount(F.col("y"), F.col("t")))
    assert got == pytest.approx([0.215, 0.265, 1.0, 0.0, 0.0])


def test_assembly_premium_caps(spark):
    rows = [(49.2633, -123.0705, "CD-1", 33.0, True, 0.0, 1950), (49.2633, -123.0705, "CD-1", 33.0, True, 0.0, 2025), (49.30, -123.0, "CD-1", 33.0, True, 0.0, 1950)]
    p = rules.assembly_premium(F.col("la"), F.col("lo"), F.col("z"), F.col("f"), F.col("c"), F.col("v"), F.col("y"), 2026)
    got = one(spark, rows, "la double, lo double, z string, f double, c boolean, v double, y int", p)
    assert got == pytest.approx([0.40, 0.0, 0.0])


def test_strata_floor(spark):
    schema = (
        "depreciation_report_age_months int, contingency_reserve_pct double, special_assessment_total_5yr double, insurance_deductible double, "
        "rainscreen_status string, crt_dispute_count_3yr int, year_built int"
    )
    rows = [(None, 20.0, 20_000.0, 600_000.0, None, 6, 1990), (12, 80.0, None, None, "Yes", 0, 2010)]
    assert one(spark, rows, schema, rules.strata_penalty()) == pytest.approx([-0.25, 0.0])


def test_zoning_distance(spark):
    rows = [("RS-1", "RS-1"), ("RS-1", "RS-5"), ("RS-1", "RT-2"), ("RS-1", "C-2"), ("", "RS-1"), (None, "RS-1")]
    assert one(spark, rows, "a string, b string", comps.zoning_distance(F.col("a"), F.col("b"))) == [0.0, 0.3, 0.5, 1.0, 0.5, 0.5]


def test_blend(spark):
    rows = [(105.0, 5), (115.0, 5), (150.0, 5), (150.0, 2)]
    got = one(spark, rows, "ml double, n int", comps.blend_with_comparables(F.col("ml"), F.lit(100.0), F.col("n"))["value"])
    assert got == pytest.approx([104.0, 109.0, 125.0, 145.0])


def test_stress_rate(spark):
    assert one(spark, [(3.0,), (4.0,)], "r double", rates.stress_rate(F.col("r"))) == [5.25, 6.0]


def test_grades(spark):
    rows = [(85, 5, 12), (70, 3, 20), (70, 2, 20)]
    assert one(spark, rows, "a int, b int, c int", rules.confidence_grade(F.col("a"), F.col("b"), F.col("c"))) == ["A", "B", "C"]


def test_listing_address(spark):
    p = match.parse_listing_address(F.col("a"))
    rows = [("PH 4 1200 W GEORGIA STREET",), ("601 1850 COMOX STREET",), ("2432 W 49TH AVENUE",), ("8A 199 DRAKE STREET",), ("NOWHERE",)]
    got = one(spark, rows, "a string", p["is_strata"], p["unit"], p["building"], p["street"])
    assert got == [
        (True, 4, 1200, "W GEORGIA STREET"), (True, 601, 1850, "COMOX STREET"), (False, None, 2432, "W 49TH AVENUE"),
        (True, 8, 199, "DRAKE STREET"), (False, None, None, "NOWHERE"),
    ]


def test_street_resolution(spark):
    roll = spark.createDataFrame([("GEORGIA ST W",), ("11TH AVE",), ("22ND AVE E",), ("KINGSWAY",), ("PARK LANE",), ("8TH AVE E",)], "street string")
    raw = spark.createDataFrame([("W GEORGIA STREET",), ("11 AVE",), ("22 AVENUE E",), ("KINGSWAY ST",), ("PARK LN",), ("E 8TH AVENUE",), ("MARS RD",)], "raw_street string")
    got = {r.raw_street: r.street for r in match.resolve_streets(raw, roll).collect()}
    assert got == {
        "W GEORGIA STREET": "GEORGIA ST W", "11 AVE": "11TH AVE", "22 AVENUE E": "22ND AVE E", "KINGSWAY ST": "KINGSWAY", "PARK LN": "PARK LANE",
        "E 8TH AVENUE": "8TH AVE E", "MARS RD": "MARS RD",
    }


def test_sale_address_key(spark):
    k = match.sale_address_key(F.col("a"))
    rows = [("1 3090 VANNESS AVENUE",), ("1577 E 58TH AVENUE",), ("323 N KAMLOOPS STREET",), ("12 3 AVENUE",), ("5 13TH E AVENUE",)]
    got = one(spark, rows, "a string", k["civic"], k["street"])
    assert got == [(3090, "VANNESS AVE"), (1577, "58TH AVE E"), (323, "KAMLOOPS ST"), (3, "AVE"), (5, "13TH AVE E")]


def test_ordinals(spark):
    rows = [("1 AVE",), ("2 AVE",), ("3 ST",), ("11 AVE",), ("12 AVE",), ("13 AVE",), ("21 AVE",), ("38 AVE W",), ("MAIN ST",)]
    assert one(spark, rows, "s string", match.fix_ordinal(F.col("s"))) == [
        "1ST AVE", "2ND AVE", "3RD ST", "11TH AVE", "12TH AVE", "13TH AVE", "21ST AVE", "38TH AVE W", "MAIN ST",
    ]


def test_dates(spark):
    rows = [("3/7/2024",), ("2024-03-07",), ("3/7/24",), ("March 7, 2024",), ("soon",), (None,)]
    got = one(spark, rows, "d string", dates.parse_date(F.col("d")).cast("string"))
    assert got == ["2024-03-07"] * 4 + [None, None]


def test_text_cleaning(spark):
    rows = [("$1,350,000",), ("",), ("n/a",), ("1,204.9 sqft",)]
    assert one(spark, rows, "p string", text.whole_amount(F.col("p"))) == [1350000, None, None, 1204]
    assert one(spark, [("12-345",), ("1234567890",)], "p string", text.clean_pid(F.col("p"))) == ["000012345", "1234567890"]
    assert one(spark, [(" nan ",), (" rs-1 ",)], "p string", text.upper_key(F.col("p"))) == [None, "RS-1"]
    assert one(spark, [("NaN",), ("x",), ("2.5",)], "p string", text.number_or_null(F.col("p"))) == [None, None, 2.5]


def test_export_format():
    assert ingest.detect_format(["ML #", "MaintFee"]) == "attached"
    assert ingest.detect_format(["ML #", "Frontage - Feet"]) == "detached"
    assert ingest.detect_format(["ML #"]) == "unknown"


def lots(spark):
    rows = [
        ("12345678901", "PINE ST", None, None, None, 2024), ("000000002", "OAK ST", None, None, None, 2024), ("000000003", "ELM ST", 7, None, None, 2024),
        ("000000004", "ELM ST", 1, 20.0, "STRATA", 2024), ("000000005", "ELM ST", 2, 20.0, "STRATA", 2024),
    ]
    return spark.createDataFrame(rows, "pid string, street_name string, civic_number int, to_civic_number double, legal_type string, tax_assessment_year int").withColumns(
        {"property_type": F.lit("condo"), "total_assessed_value": F.lit(1.0), "current_land_value": F.lit(1.0), "current_improvement_value": F.lit(0.0), "latitude": F.lit(49.2), "longitude": F.lit(-123.1)}
    )


def test_search_finds_streets_and_lots_without_number_and_long_fragments(spark):
    from terravalor.operators import serve

    ask = lambda *q: spark.createDataFrame([(x,) for x in q], "query string")
    found = {(r.query, r.pid, r.kind) for r in serve.search_address(ask("PINE", "7 OAK", "7 ELM", "9 elm", "elm"), lots(spark)).collect()}
    assert ("PINE", "12345678901", "street") in found and ("7 OAK", "000000002", "street") in found and ("7 ELM", "000000003", "exact") in found
    assert ("9 elm", "000000003", "nearest") in found and {p for q, p, _ in found if q == "elm"} == {"000000003", "000000004", "000000005"}
    pids = {(r.query, r.pid) for r in serve.search_pid(ask("8901", "3", "12345678901", ""), gram_index.build(lots(spark), "pid")).collect()}
    assert {("8901", "12345678901"), ("12345678901", "12345678901"), ("3", "000000003"), ("3", "12345678901")} == pids


def test_units_by_word_and_subject_by_unit(spark):
    from terravalor.operators import serve

    asked = spark.createDataFrame([(20, "elm st"), (20, "Elm Street"), (20, "ST ELM")], "building_number long, street_name string")
    got = sorted((r.street_name, r.unit_number) for r in serve.building_units(asked, lots(spark)).collect())
    assert got == [("ST ELM", 1), ("ST ELM", 2), ("elm st", 1), ("elm st", 2)]
    requests = spark.createDataFrame([(1, None, "20 Elm Street #2", None, None, "condo")], "request_id int, pid string, address string, latitude double, longitude double, property_type string")
    assert serve.resolve_subjects(requests, lots(spark)).first().pid == "000000005"


def test_exports_of_two_formats_in_one_folder(spark, tmp_path):
    from terravalor.operators import ingest
    from terravalor.sources import readers

    (tmp_path / "a.csv").write_text('\ufeffML #,Address,Sold Price,List Price,MaintFee\nR1,10 A ST,"$100","$90",$5\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text('Sold Price,ML #,List Price,Depth,Address\n"$200",R2,"$180",30,20 B ST\n')
    rows = {r.mls_number: r for r in ingest.clean_listing_exports(readers.read_listing_exports(spark, str(tmp_path))).collect()}
    assert (rows["R1"].address, rows["R1"].sold_price, rows["R1"].source_format, rows["R1"].maint_fee) == ("10 A ST", 100, "attached", 5.0)
    assert (rows["R2"].address, rows["R2"].sold_price, rows["R2"].source_format) == ("20 B ST", 200, "detached")


def test_categories_beyond_the_default_bins(spark):
    """More categories than the learner's usual bins are all kept apart."""
    from terravalor.operators import value_models as V

    rows = spark.range(400).select(
        F.format_string("%05d", "id").alias("pid"), F.concat(F.lit("Z"), (F.col("id") % 100).cast("string")).alias("zoning_district"),
        F.lit("011").alias("neighbourhood_code"), F.lit("condo").alias("property_type"), F.exp(F.lit(12.0) + (F.col("id") % 100) / 100).alias("total_assessed_value"),
    )
    features = V.feature_set(rows)
    codes = V.encoder(V.encoded(rows, features), features)
    matrix = V.write_matrix(rows, features, codes, landing_path(spark, "bins"), target=F.log("total_assessed_value"))
    assert matrix.bins >= 102
    model = V.fit(matrix.rows().withColumn("held", F.col("part") == "stop"), V.Settings(rounds=2, depth=2), matrix.bins, 400)
    assert model.transform(matrix.rows()).count() == 400

def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    import pytest

    from terravalor.session import shared_dir

    conf = {}
    context = SimpleNamespace(master="yarn", getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None)
    spark = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d), set=conf.__setitem__))
    with pytest.raises(ValueError):
        shared_dir(spark)
    conf["spark.checkpoint.dir"] = "hdfs:///shared"
    assert shared_dir(spark) == "hdfs:///shared"
    conf.clear()
    context.master = "local[4]"
    assert shared_dir(spark)


def test_nearest_property_has_no_limit(spark):
    from terravalor.operators import spatial

    far = spark.createDataFrame([(10.0, 20.0, "condo")], "lat double, lon double, property_type string")
    assert spatial.nearest_property(far, lots(spark)).first().pid == "000000002"


def test_a_point_in_a_hole_is_outside(spark, tmp_path):
    from terravalor.operators import spatial
    from terravalor.sources import readers

    box = lambda a, b: [[a, a], [b, a], [b, b], [a, b], [a, a]]
    import json

    feature = {"type": "Feature", "properties": {"name": "x"}, "geometry": {"type": "Polygon", "coordinates": [box(0.0, 0.04), box(0.01, 0.03)]}}
    (tmp_path / "a.json").write_text(json.dumps({"type": "FeatureCollection", "features": [feature]}))
    layer = spatial.as_layer(readers.read_geojson(spark, str(tmp_path)))
    points = spark.createDataFrame([(0.02, 0.02), (0.005, 0.005), (0.05, 0.05)], "lat double, lon double")
    inside = {r.lat: r.hit for r in spatial.inside_any(points, layer, "hit").collect()}
    assert inside == {0.02: False, 0.005: True, 0.05: False}
    away = {r.lat: r.d for r in spatial.polygon_distance(points, layer, "d").collect()}
    assert away[0.005] == 0 and abs(away[0.02] - 0.01 * 111_195) < 5
    area = spatial.drop_degenerate(layer.base).first().area_sqm
    assert abs(area / (0.0012 * 111_195**2) - 1) < 0.001


def test_micro_neighbourhoods_end_at_rest(spark):
    from terravalor.operators import models

    rows = [(str(i), "011", float(i % 3 * 100 + i % 7), float(i % 3 * 50 + i % 5)) for i in range(210)]
    table = spark.createDataFrame(rows, "pid string, neighbourhood_code string, a double, b double")
    got, centres = models.micro_neighbourhoods(table, ["a", "b"])
    by_blob = {}
    for r in got.collect():
        by_blob.setdefault(int(r.pid) % 3, set()).add(r.cluster)
    assert all(len(c) == 1 for c in by_blob.values()) and len({c for s in by_blob.values() for c in s}) == 3
    assert len(centres.first().centres) == 3


@pytest.mark.parametrize("limit", [3, 50])
def test_fragments_are_found_as_by_looking_at_every_key(spark, limit):
    """Keys of all lengths, hot pieces, fragments of one piece and of many."""
    import random

    dice = random.Random(3)
    keys = {"".join(dice.choices("0012", k=dice.choice([1, 2, 3, 7, 9]))) for _ in range(400)} | {"000000000", "9"}
    asked = {"0", "00", "000", "0000", "2", "12", "210", "0120", "99", "9", "333", "0" * 9, "0" * 10, ""} | {k[i : i + 5] for k in list(keys)[:40] for i in (0, 2)}
    index = gram_index.build(spark.createDataFrame([(k,) for k in keys] + [(None,), ("",)], "key string"), "key", head=5)
    got: dict = {}
    for r in gram_index.search(spark.createDataFrame([(a,) for a in asked], "fragment string"), index, limit).collect():
        got.setdefault(r.fragment, []).append((r["rank"], r.key))
    want = {a: list(enumerate(sorted(k for k in keys if a in k)[:limit], 1)) for a in asked if a and any(a in k for k in keys)}
    assert {a: sorted(v) for a, v in got.items()} == want
