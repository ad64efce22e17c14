"""Brute force, invariants, plans and streaming on small fixtures."""

from __future__ import annotations

import math
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from terravalor.functions import geo
from terravalor.functions.quantiles import UPPER_MEDIAN, exact_percentiles
from terravalor.operators import comps, ingest, models, spatial, universe
from terravalor.plans.tables import Tables
from terravalor.session import landing_path
from terravalor.streaming import jobs


@pytest.fixture(scope="module")
def t(spark, sf):
    return Tables(spark, sf)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def haversine(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6_371_000 * math.asin(math.sqrt(min(1.0, h)))


@pytest.mark.parametrize("bound", [3, 500, 1_000_000])
def test_exact_percentiles_match_sorting(spark, bound):
    """The same for every bound: many rounds of brackets, few, none."""
    rng = random.Random(5)
    rows = [("hot", rng.choice([1.0, 2.0, rng.random() * 100])) for _ in range(30_000)] + [("small", float(i)) for i in range(7)] + [("one", 3.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in exact_percentiles(df, ["k"], "v", {"q": 0.25, "m": 0.5, "u": UPPER_MEDIAN, "top": 1.0}, bound).collect()}
    for key in ("hot", "small", "one"):
        values = sorted(v for k, v in rows if k == key)
        pos = 0.25 * (len(values) - 1)
        lo, hi = values[math.floor(pos)], values[math.ceil(pos)]
        assert got[key].q == pytest.approx(lo + (hi - lo) * (pos - math.floor(pos)))
        assert got[key].m == pytest.approx(statistics.median(values))
        assert got[key].u == values[len(values) // 2] and got[key].top == values[-1] and got[key].n == len(values)


def test_percentiles_of_values_of_many_sizes(spark):
    """Outliers, signs, infinities and one value that fills most of a group: ranks are found in few rounds."""
    rng = random.Random(6)
    odd = [-math.inf, -1e300, -1e-300, -0.0, 0.0, 1e-300, 1e-9, 1e300, math.inf, math.nan]
    rows = [math.exp(rng.uniform(-40, 40)) * rng.choice([-1, 1]) for _ in range(4_000)] + [7.25] * 3_000 + odd
    df = spark.createDataFrame([(v,) for v in rows], "v double")
    want = sorted(rows, key=lambda v: (math.isnan(v), v))
    probs = {f"p{i}": i / (len(rows) - 1) for i in (0, 1, 5, 2000, 2004, 3000, 5500, len(rows) - 2, len(rows) - 3)}
    got = exact_percentiles(df, [], "v", probs, bound=2).first()
    for name, p in probs.items():
        assert got[name] == pytest.approx(want[round(p * (len(rows) - 1))], rel=1e-6, abs=0), name
    assert math.isnan(exact_percentiles(df, [], "v", {"top": 1.0}, bound=2).first().top)


def test_percentiles_by_weight_and_by_rank(spark):
    rng = random.Random(7)
    rows = [(i % 3, rng.random(), rng.choice([0, 1, 5, 900])) for i in range(900)]
    df = spark.createDataFrame(rows, "k int, v double, w int")
    third = lambda n: (F.lit(2), F.lit(2), F.lit(0.0))
    beyond = lambda n: (n, n, F.lit(0.0))
    for bound in (10, 10_000_000):
        for r in exact_percentiles(df, ["k"], "v", {"q": 0.1, "third": third, "none": beyond}, bound, weight="w").collect():
            values = sorted(v for k, v, w in rows if k == r.k for _ in range(w))
            pos = 0.1 * (len(values) - 1)
            lo, hi = values[math.floor(pos)], values[math.ceil(pos)]
            assert r.n == len(values) and r.third == values[2] and r.none is None and r.q == pytest.approx(lo + (hi - lo) * (pos - math.floor(pos)))


def test_no_task_ranks_more_rows_than_the_bound(spark, monkeypatch):
    from terravalor.functions import quantiles

    seen = []
    ranked = quantiles._values
    monkeypatch.setattr(quantiles, "_values", lambda base, targets: seen.append(targets.agg(F.max(F.when(F.col("_low") < F.col("_high"), F.col("_rows")))).first()[0]) or ranked(base, targets))
    df = spark.range(300_000).select((F.col("id") % 2).alias("k"), F.exp(F.rand(3) * 20).alias("v"))
    exact_percentiles(df, ["k"], "v", {"a": 0.1, "b": 0.9}, bound=1_000).collect()
    assert seen[0] is None or seen[0] <= 1_000


def test_percentiles_without_keys_and_without_rows(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (None,)], "v double")
    assert exact_percentiles(df, [], "v", {"m": 0.5}).first().m == 2.0
    assert exact_percentiles(df.where("v > 9"), [], "v", {"m": 0.5}).first().m is None


@pytest.fixture(scope="module")
def cloud(spark):
    rng = random.Random(11)
    pts = [(round(49.2 + rng.random() * 0.1, 5), round(-123.2 + rng.random() * 0.2, 5)) for _ in range(150)]
    layer = [(i, 49.2 + rng.random() * 0.1, -123.2 + rng.random() * 0.2) for i in range(80)] + [(500 + i, 49.25, -123.1) for i in range(40)]
    return pts, layer, spark.createDataFrame(pts, "lat double, lon double"), spark.createDataFrame(layer, "id int, y double, x double")


def test_cell_join_equals_brute_force(cloud):
    pts, layer, points, rows = cloud
    for radius in (300.0, 2_500.0):
        found = spatial.count_within(points, spatial.point_layer(rows, "y", "x"), radius, "n")
        got = {(r.lat, r.lon): r.n for r in found.collect()}
        assert got == {p: sum(haversine(*p, y, x) <= radius for _, y, x in layer) for p in pts}
        assert "NestedLoop" not in plan_of(found) and "Cartesian" not in plan_of(found)


def test_nearest_equals_brute_force(cloud):
    pts, layer, points, rows = cloud
    found = spatial.nearest_distance(points, spatial.point_layer(rows, "y", "x"), "d")
    for r in found.collect():
        assert r.d == pytest.approx(min(haversine(r.lat, r.lon, y, x) for _, y, x in layer), abs=1e-6)
    assert "NestedLoop" not in plan_of(found) and "Cartesian" not in plan_of(found)


def test_nearest_is_null_past_the_limit(spark):
    points = spark.createDataFrame([(49.2, -123.0), (49.5, -123.0)], "lat double, lon double")
    layer = spatial.point_layer(spark.createDataFrame([(49.2001, -123.0)], "y double, x double"), "y", "x")
    got = {r.lat: r.d for r in spatial.nearest_distance(points, layer, "d").collect()}
    assert got[49.5] is None and got[49.2] == pytest.approx(11.12, abs=0.1)


def test_cells_hold_at_high_latitude(spark):
    rng = random.Random(3)
    pts = [(round(69.0 + rng.random() * 0.3, 5), round(20 + rng.random() * 0.6, 5)) for _ in range(60)]
    points = spark.createDataFrame(pts, "lat double, lon double")
    layer = spatial.point_layer(points.withColumnsRenamed({"lat": "y", "lon": "x"}), "y", "x")
    got = {(r.lat, r.lon): r.n for r in spatial.count_within(points, layer, 4_000.0, "n").collect()}
    assert got == {p: sum(haversine(*p, *q) <= 4_000.0 for q in pts) for p in pts}


def test_inside_means_zero_distance(t):
    zones = spatial.as_layer(spatial.with_ring(t("px_zone")))
    both = spatial.inside_any(t.locations, zones, "inside").join(spatial.polygon_distance(t.locations, zones, "d"), ["lat", "lon"])
    # A point on an upper edge is outside and at distance 0, so only one direction holds.
    assert both.where("inside AND d <> 0").count() == 0


def test_concave_ring(spark):
    ring = "array(named_struct('lat', 0D, 'lon', 0D), named_struct('lat', 0D, 'lon', 4D), named_struct('lat', 4D, 'lon', 4D), named_struct('lat', 4D, 'lon', 0D), named_struct('lat', 2D, 'lon', 2D))"
    rows = spark.createDataFrame([(1.0, 2.0, True), (2.0, 1.0, False), (3.0, 3.5, True), (5.0, 1.0, False)], "y double, x double, want boolean")
    out = rows.withColumn("ring", F.expr(ring)).withColumn("got", geo.inside_ring(F.col("y"), F.col("x"), F.col("ring")))
    assert out.where("got <> want").count() == 0


def test_radius_counts_grow(t):
    layer = spatial.point_layer(t("px_poi"), "lat", "lon")
    c = spatial.counts_within(t.locations, layer, {"a": 400.0, "b": 800.0})
    assert c.where("a > b").count() == 0


def test_one_row_per_property(t):
    assert t.universe.groupBy("pid").count().where("count > 1").count() == 0
    assert t.properties.count() == t.universe.count()


def test_upsert_is_idempotent_and_keeps_first_seen(t):
    old = t("px_sold").where(F.col("sold_date") < "1998-01-01")
    new = t("px_sold").where(F.col("sold_date") >= "1998-01-01")
    once = ingest.upsert_listings(old, new)
    twice = ingest.upsert_listings(once, new)
    assert once.exceptAll(twice.select(*once.columns)).count() == 0 and once.count() == twice.count()
    first = t("px_sold").groupBy("mls_number").agg(F.min("first_seen_date").alias("f"))
    assert once.join(first, "mls_number").where("f <> first_seen_date").count() == 0


def clones(t, copies):
    """Properties where one lot holds a third of all rows, many of them equal in every scored field."""
    base = t.universe.limit(60)
    hot = base.orderBy("pid").limit(1).select("*", F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("_i"))
    hot = hot.withColumn("pid", F.concat(F.lit("H"), F.lpad(F.col("_i").cast("string"), 8, "0"))).drop("_i")
    return base.unionByName(hot)


def brute_comparables(rows, k):
    def prefix(z):
        return (z or "").strip().upper().split("-")[0].rstrip("0123456789")

    groups = {p: g for g, ps in (("r", "RS RT RM RR RA RF"), ("c", "C CD CR CS FC"), ("i", "I IC IM IH IL"), ("d", "DD HA")) for p in ps.split()}

    def zone(a, b):
        if not a or not b:
            return 0.5
        if a == b:
            return 0.0
        pa, pb = prefix(a), prefix(b)
        return 0.3 if pa == pb else 0.5 if groups.get(pa, "o") == groups.get(pb, "o") else 1.0

    out = {}
    for s in rows:
        found = []
        for c in rows:
            if c.pid == s.pid:
                continue
            d = haversine(s.latitude, s.longitude, c.latitude, c.longitude)
            if d > 5_000:
                continue
            same = s.property_type == c.property_type
            tier = 1 if same and d <= 2_000 else 2 if same else 3
            year = min(1, abs(s.year_built - c.year_built) / 50) if s.year_built and c.year_built else 0.5
            score = (
                0.30 * min(1, 1 - 2 ** (-d / 1_000)) + 0.25 * min(1, abs(math.log(s.total_assessed_value / c.total_assessed_value)) / math.log(2))
                + 0.15 * year + 0.15 * zone(s.zoning_district, c.zoning_district) + 0.075
            )
            found.append((tier, round(score, 9), c.pid))
        chosen = next((x for x in (1, 2) if sum(f[0] <= x for f in found) >= k), 3)
        out[s.pid] = [p for _, p in sorted((f[1], f[2]) for f in found if f[0] <= chosen)[:k]]
    return out


def test_comparables_equal_brute_force_with_a_hot_lot(t):
    props = clones(t, 40)
    rows = props.collect()
    want = brute_comparables(rows, 5)
    got = {}
    for r in comps.comparable_properties(props, props, 5).orderBy("s_pid", "rank").collect():
        got.setdefault(r.s_pid, []).append(r.c_pid)
    assert got == {k: v for k, v in want.items() if v}


def test_no_copied_side_is_broadcast(t):
    """Exploded probes have many times the rows that Spark estimates from their file."""
    props = t.properties.limit(200)
    for rows in (props, props.withColumns({c: F.lit(None).cast("double") for c in ("latitude", "longitude")})):
        plan = plan_of(comps.comparable_properties(rows, props, 5))
        joins = [line for line in plan.splitlines() if "Join [" in line and re.search(r"\b_[cv]#", line)]
        assert joins and not [line for line in joins if "BroadcastHashJoin" in line]


def test_duplex_and_panel(t):
    lots = t.properties.where("property_type = 'duplex'").groupBy("to_civic_number", "street_name").count()
    assert lots.where("count < 2").count() == 0
    assert universe.add_panel_change(t("px_panel")).where("tax_assessment_year = 2020 AND yoy_change_pct IS NOT NULL").count() == 0


def test_intervals_hold_their_order(t):
    rows = models.add_distance(t.properties)
    pred = models.predict_lines(rows, models.segment_lines(rows, 10))
    levels = models.residual_levels(pred)
    assert levels.where("q10 > q25 OR q25 > q50 OR q50 > q75 OR q75 > q90").count() == 0
    assert models.with_intervals(pred, levels).where("lower > upper OR lower < 0").count() == 0


def test_micro_neighbourhoods_cover_every_property(t):
    props = t.properties.withColumn("log_value", F.log("total_assessed_value"))
    done, _ = models.micro_neighbourhoods(props, ["log_value", "land_ratio", "year_built"], min_size=5)
    assert done.select("pid").distinct().count() == props.count()
    assert done.groupBy("neighbourhood_code").agg(F.count_distinct("cluster").alias("c")).where("c > 3").count() == 0


def test_stream_replay_changes_nothing(spark, t):
    drops, root, state = (landing_path(spark, n) for n in ("drops", "store", "state"))
    rows = t("px_sold")
    rows.where(F.col("sold_date") < "1999-01-01").write.parquet(drops)
    store = jobs.upsert_stream(spark, jobs.read_drops(spark, drops, rows.schema), root, state)
    rows.where(F.col("sold_date") >= "1999-01-01").write.mode("append").parquet(drops)
    seen = []
    jobs.upsert_stream(spark, jobs.read_drops(spark, drops, rows.schema), root, state, lambda b, n: seen.append(n))
    jobs.upsert_stream(spark, jobs.read_drops(spark, drops, rows.schema), root, state, lambda b, n: seen.append(n))
    assert sum(seen) == rows.where(F.col("sold_date") >= "1999-01-01").count()
    want = ingest.upsert_listings(rows.where(F.col("sold_date") < "1999-01-01"), rows.where(F.col("sold_date") >= "1999-01-01"))
    got = store.latest().select(*want.columns)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    store.log.fold(1)
    assert store.log.folded() == 1 and store.latest().select(*want.columns).exceptAll(want).count() == 0
    store.upsert(rows.where(F.col("sold_date") < "1999-01-01"), 0)  # a replay of what is folded already
    assert store.latest().select(*want.columns).exceptAll(want).count() == 0


def test_log_folds_keep_the_newest_and_the_first_seen(spark):
    """Many small batches: the same table with and without folds, and a fold that broke off isn't read."""
    cols = "mls_number string, sold_price long, first_seen_date date"
    import datetime as dt

    def fill(fold_every):
        probe = spark.createDataFrame([], cols)
        store = jobs.ListingStore(spark, landing_path(spark, "folds"), probe.schema, fold_every)
        for b in range(7):
            rows = [(f"R{i}", 100 * b + i, dt.date(2024, 1, 1 + (b * 3) % 7)) for i in range(b, b + 4)]
            store.log.put(spark.createDataFrame(rows, cols), b)
        return store

    plain, folded = fill(1 << 40), fill(3)
    assert plain.log.folded() == -1 and folded.log.folded() == 5
    spark.range(1).write.parquet(f"{folded.log.root}/folded/upto=9/half")  # no _SUCCESS at its top
    assert folded.log.folded() == 5 and folded.log.rows().where("batch < 0").count() == 0
    assert sorted(map(tuple, plain.latest().collect())) == sorted(map(tuple, folded.latest().collect()))


def test_late_rows(spark):
    folder, out, state = (landing_path(spark, n) for n in ("late", "late-out", "late-state"))

    def drop(rows):
        spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(folder)

    def run():
        schema = "ts timestamp, event_type string, value double"
        stream = jobs.daily_totals(jobs.read_drops(spark, folder, schema), "ts")
        jobs.run_to_end(stream.writeStream.format("parquet").option("path", out), state, "append")

    drop([("2024-01-01 10:00:00", "a", 1.0), ("2024-01-10 10:00:00", "a", 1.0)])
    run()
    drop([("2024-01-01 11:00:00", "a", 5.0), ("2024-01-09 11:00:00", "a", 5.0), ("2024-01-20 00:00:00", "a", 1.0)])
    run()
    got = {str(r.day)[:10]: r.n for r in spark.read.parquet(out).collect()}
    assert got["2024-01-01"] == 1 and got["2024-01-09"] == 1 and got["2024-01-10"] == 1


def test_sale_steps_count_collapsed_copies(spark):
    """Many equal sales collapse, yet steps still see their true number and the best k are whole."""
    from pyspark.sql import types as T

    cols = "mls_number string, sold_price long, list_price long, sold_date date, dom int, sub_area string, property_type string, floor_area int, year_built int, bedrooms int, bathrooms int, latitude double, longitude double, assessed_value double"
    import datetime as dt

    def sale(i, day, area="1"):
        return (f"R{i:04d}", 500_000, 510_000, dt.date(2001, 9, day), 5, area, "Apartment/Condo", 900, 1990, 2, 1, 49.25, -123.1, 500_000.0)

    sales = spark.createDataFrame([sale(i, 20) for i in range(60)] + [sale(100, 25)], cols)
    subject = spark.createDataFrame(
        [("s", "5", "condo", 500_000.0, 49.25, -123.1, 900.0, 1990, 2, 1)],
        "subject_id string, neighbourhood_code string, s_type string, s_value double, s_lat double, s_lon double, s_area double, s_year int, s_beds int, s_baths int",
    )
    areas = spark.createDataFrame([("5", "1", True)], "neighbourhood_code string, sub_area string, own boolean")
    out = comps.comparable_sales(subject, sales, areas, "2001-10-01", k=10).orderBy("rank").collect()
    assert [r.mls_number for r in out] == ["R0100"] + [f"R{i:04d}" for i in range(9)]
    assert {r.step for r in out} == {1} and isinstance(out[0].dist_m, float) and T is not None


def test_sale_pairs_are_cut_before_they_are_shuffled(spark):
    """Each task keeps the best pairs of a subject: below the shuffle by subject lies a group limit."""
    scored = spark.range(1000).selectExpr("CAST(id % 5 AS STRING) AS subject_id", "id AS _cand", "CAST(id AS STRING) AS mls_number", "id * 0.5D AS score")
    plan = comps._best_sales(scored, 3)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Exchange hashpartitioning\(subject_id.*\n.*WindowGroupLimit", plan)
