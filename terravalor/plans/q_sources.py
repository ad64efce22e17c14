"""Reader and writer queries: given rows are landed as files, read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from terravalor.operators import ingest, match
from terravalor.plans.registry import query
from terravalor.session import landing_path
from terravalor.sources import readers, sinks


@query(
    "s01_s02_tax_roll_csv",
    """SELECT PID AS PID, STREET_NAME AS STREET_NAME, CURRENT_LAND_VALUE AS CURRENT_LAND_VALUE, CAST(TAX_ASSESSMENT_YEAR AS INT) AS TAX_ASSESSMENT_YEAR
       FROM px_tax_roll WHERE TAX_ASSESSMENT_YEAR = '2025'""",
)
def s01(t):
    path = landing_path(t.spark, "roll")
    t("px_tax_roll").write.partitionBy("TAX_ASSESSMENT_YEAR").option("header", True).csv(path)
    return readers.read_tax_roll(t.spark, path, 2025).select("PID", "STREET_NAME", "CURRENT_LAND_VALUE", "TAX_ASSESSMENT_YEAR")


@query(
    "s03_k01_enriched_parquet",
    "SELECT pid, property_type, total_assessed_value FROM o_properties WHERE tax_assessment_year = 2026",
)
def s03(t):
    path = landing_path(t.spark, "enriched")
    sinks.write_enriched(t.properties, path)
    return t.spark.read.parquet(path).where("tax_assessment_year = 2026").select("pid", "property_type", "total_assessed_value")


@query(
    "s04_trend_csv",
    """SELECT neighbourhood_code, CAST(tax_assessment_year AS DOUBLE) AS tax_assessment_year, legal_type AS property_type, count(*) AS count
       FROM px_panel GROUP BY 1, 2, 3""",
)
def s04(t):
    path = landing_path(t.spark, "trends")
    rows = t("px_panel").groupBy("neighbourhood_code", "tax_assessment_year", F.col("legal_type").alias("property_type")).agg(
        F.avg("current_land_value").alias("median"), F.count(F.lit(1)).alias("count")
    )
    rows.write.option("header", True).csv(path)
    return readers.read_csv(t.spark, path, readers.TRENDS).select("neighbourhood_code", "tax_assessment_year", "property_type", "count")


@query(
    "s06_s21_listing_exports",
    """SELECT mls_number, sold_price, list_price, bedrooms, floor_area, property_type, maint_fee, 'attached' AS source_format,
       round((sold_price - list_price) / list_price * 100, 8) AS price_diff_pct FROM o_sold""",
)
def s06(t):
    path = landing_path(t.spark, "exports")
    raw = t.sold.select(
        F.col("mls_number").alias("ML #"), F.lit("S").alias("Status"), F.col("address").alias("Address"), F.col("sub_area").alias("S/A"),
        F.concat(F.lit("$"), F.format_number("sold_price", 0)).alias("Sold Price"), F.concat(F.lit("$"), F.format_number("list_price", 0)).alias("List Price"),
        F.date_format("sold_date", "M/d/yyyy").alias("Sold Date"), F.col("dom").cast("string").alias("DOM"), F.col("bedrooms").cast("string").alias("Tot BR"),
        F.format_number("floor_area", 0).alias("TotFlArea"), F.col("year_built").cast("string").alias("Yr Blt"), F.col("property_type").alias("TypeDwel"),
        F.concat(F.lit("$"), F.col("maint_fee").cast("string")).alias("MaintFee"), F.lit("").alias("Locker"),
    )
    raw.write.option("header", True).csv(path)
    out = ingest.clean_listing_exports(readers.read_listing_exports(t.spark, path))
    return out.select(
        "mls_number", "sold_price", "list_price", "bedrooms", "floor_area", "property_type", "maint_fee", "source_format",
        F.round("price_diff_pct", 8).alias("price_diff_pct"),
    )


@query(
    "s06_export_columns",
    """SELECT mls_number, sold_price, dom + 2 AS days_on_mls, coalesce(bathrooms, 1) AS bathrooms, CASE WHEN dom % 2 = 0 THEN 2030 - year_built END AS age,
         CASE WHEN dom % 2 = 0 THEN dom % 4 END AS parking, CASE WHEN dom % 2 = 1 THEN 1 + dom % 3 END AS kitchens, CASE WHEN dom % 2 = 1 THEN dom + 0.5 END AS frontage_ft,
         CASE WHEN dom % 2 = 1 THEN 100.0 + dom END AS depth_ft, strftime(sold_date, '%Y') AS list_date, CASE WHEN dom % 3 <> 0 THEN 'V5K ' || sub_area END AS postal_code,
         CASE WHEN dom % 2 = 0 THEN 'Yes' END AS locker, CASE WHEN dom % 2 = 1 THEN '2 Storey' END AS style, CASE WHEN dom % 2 = 0 THEN 'attached' ELSE 'detached' END AS source_format FROM o_sold""",
)
def s06c(t):
    """All columns of attached and detached exports, each file by its own header, the price under either name."""
    path = landing_path(t.spark, "exports")
    text = lambda c: F.col(c).cast("string")
    dom = F.col("dom")
    shared = {
        "ML #": F.concat(F.lit(" "), F.col("mls_number")), "Status": F.lit("F"), "Address": F.col("address"), "S/A": F.col("sub_area"), "DOM": text("dom"),
        "Days On MLS": (dom + 2).cast("string"), "Tot Baths": F.coalesce(F.col("bathrooms"), F.lit(1)).cast("string"), "List Date": F.date_format("sold_date", "yyyy"),
        "Postal Code": F.when(dom % 3 != 0, F.concat(F.lit("V5K "), F.col("sub_area"))).otherwise(""),
    }
    attached = {"Sold Price": F.format_number("sold_price", 0), "Age": (2030 - F.col("year_built")).cast("string"), "TotalPrkng": (dom % 4).cast("string"), "Locker": F.lit("Yes"), "MaintFee": F.lit("$1")}
    detached = {
        "Price": F.concat(F.lit("$"), F.format_number("sold_price", 0)), "#Kitchens": (1 + dom % 3).cast("string"), "Frontage - Feet": (dom + F.lit(0.5)).cast("string"),
        "Depth": F.concat((dom + 100).cast("string"), F.lit(".0")), "Style of Home": F.lit("2 Storey"),
    }
    for own, odd in ((attached, 0), (detached, 1)):
        columns = {**shared, **own}
        t.sold.where(dom % 2 == odd).select(*[e.alias(n) for n, e in columns.items()]).write.mode("append").option("header", True).csv(path)
    out = ingest.clean_listing_exports(readers.read_listing_exports(t.spark, path))
    return out.select(
        "mls_number", "sold_price", "days_on_mls", "bathrooms", "age", "parking", "kitchens", "frontage_ft", "depth_ft", "list_date", "postal_code", "locker", "style", "source_format"
    )


@query(
    "s07_s23_gtfs_tables",
    """SELECT DISTINCT st.stop_id, r.route_id, r.route_type FROM px_stop_times st JOIN px_trips tr ON st.trip_id = tr.trip_id JOIN px_routes r ON tr.route_id = r.route_id""",
)
def s07(t):
    folder = landing_path(t.spark, "gtfs")
    for name in ("stops", "routes", "trips", "stop_times"):  # the calendar file is missing on purpose
        t(f"px_{name}").write.option("header", True).csv(f"{folder}/{name}.txt")
    feed = readers.read_gtfs(t.spark, folder)
    pairs = match.stop_routes(feed["stop_times"], feed["trips"], feed["routes"])
    closed = feed["calendar"].select(F.col("service_id").alias("route_id"))
    return pairs.join(closed, "route_id", "left_anti").select("stop_id", "route_id", "route_type")


@query("s08_s19_paged_json", "SELECT permit_id, type_of_work, project_value FROM px_permits")
def s08(t):
    path = landing_path(t.spark, "pages")
    record = F.struct(F.struct("permit_id", "type_of_work", "project_value").alias("fields"))
    # One record per page: landing the rows needs no grouping.
    t("px_permits").select(F.array(record).alias("records")).write.json(path)
    return readers.read_paged_records(t.spark, path, "permit_id: bigint, type_of_work: string, project_value: double")


@query("s09_rate_observations", "SELECT date, 'policy_rate' AS series, policy_rate AS value FROM px_rates WHERE date >= DATE '1998-01-01'")
def s09(t):
    path = landing_path(t.spark, "rates")
    one = F.struct(F.date_format("date", "yyyy-MM-dd").alias("d"), F.struct(F.col("policy_rate").cast("string").alias("v")).alias("policy_rate"))
    t("px_rates").groupBy(F.year("date"), F.month("date")).agg(F.collect_list(one).alias("observations")).select("observations").write.json(path)
    return readers.read_observations(t.spark, path, "policy_rate", start="1998-01-01")


@query(
    "s10_s16_geojson_rings",
    "SELECT zone_id, lat_min, lat_max, lon_min, lon_max FROM px_zone WHERE kind = 'alr'",
)
def s10(t):
    path = landing_path(t.spark, "geojson")
    c = F.col

    def pt(lon, lat):
        return F.array(c(lon), c(lat))

    ring = F.array(pt("lon_min", "lat_min"), pt("lon_max", "lat_min"), pt("lon_max", "lat_max"), pt("lon_min", "lat_max"), pt("lon_min", "lat_min"))
    simple = F.concat(F.lit('{"type":"Polygon","coordinates":'), F.to_json(F.array(ring)), F.lit("}"))
    # to_json of array(ring) is [[...]]: a polygon; a multi-polygon wraps it once more.
    multi = F.concat(F.lit('{"type":"MultiPolygon","coordinates":['), F.to_json(F.array(ring)), F.lit("]}"))
    geometry = F.when(c("zone_id") % 4 == 0, multi).otherwise(simple)
    text = F.concat(
        F.lit('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"zone_id":"'), c("zone_id").cast("string"),
        F.lit('","province":"'), c("kind"), F.lit('"},"geometry":'), geometry, F.lit("}]}"),
    )
    t("px_zone").select(text.alias("value")).write.text(path)
    # One collection per line, so the file splits; read_geojson is for whole-file collections.
    polygons = readers.rings_of(t.spark.read.schema(readers.GEOJSON).json(path))
    out = readers.read_boundaries(polygons, "alr")
    return out.select(c("properties")["zone_id"].cast("int").alias("zone_id"), "lat_min", "lat_max", "lon_min", "lon_max")


@query("s11_gzip_rentals", "SELECT poi_id, area_name, price FROM px_poi WHERE kind = 'str'")
def s11(t):
    path = landing_path(t.spark, "rentals")
    t("px_poi").where("kind = 'str'").select("poi_id", "area_name", "price").write.option("header", True).option("compression", "gzip").csv(path)
    return readers.read_csv(t.spark, path, "poi_id bigint, area_name string, price double", multiLine=True)


@query(
    "s12_many_files_stacked",
    """SELECT request_id, pid, CASE WHEN request_id % 2 = 0 THEN req_lat END AS score_a, CASE WHEN request_id % 2 = 1 THEN req_lon END AS score_b FROM px_request""",
)
def s12(t):
    a, b = landing_path(t.spark, "fsa-a"), landing_path(t.spark, "fsa-b")
    t("px_request").where("request_id % 2 = 0").select("request_id", "pid", F.col("req_lat").alias("score_a")).write.option("header", True).csv(a)
    t("px_request").where("request_id % 2 = 1").select("request_id", "pid", F.col("req_lon").alias("score_b")).write.option("header", True).csv(b)
    return readers.stack(
        [readers.read_csv(t.spark, a, "request_id bigint, pid string, score_a double"), readers.read_csv(t.spark, b, "request_id bigint, pid string, score_b double")]
    )


@query("s13_s22_latin1_csv", "SELECT n_nationkey AS k, n_name || ' é' AS name FROM nation")
def s13(t):
    path = landing_path(t.spark, "latin")
    t("nation").select(F.col("n_nationkey").alias("k"), F.concat("n_name", F.lit(" é")).alias("name")).write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return readers.read_latin1(t.spark, path, "k int, name string")


@query(
    "s14_k02_bulk_tables",
    "SELECT d.folio_id, v.land_value FROM px_folio_descriptions d JOIN px_folio_values v USING (folio_id)",
)
def s14(t):
    folder = landing_path(t.spark, "bulk")
    for name in ("descriptions", "values"):
        sinks.replace_table(t(f"px_folio_{name}"), f"{folder}/{name}")
        sinks.replace_table(t(f"px_folio_{name}"), f"{folder}/{name}")
    left, right = (t.spark.read.parquet(f"{folder}/{n}") for n in ("descriptions", "values"))
    return left.join(right, "folio_id").select("folio_id", "land_value")


@query(
    "s15_census_pivot",
    """SELECT c_nationkey AS geo, max(c_custkey) FILTER (c_mktsegment = 'BUILDING') AS households, max(c_custkey) FILTER (c_mktsegment = 'MACHINERY') AS income
       FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1""",
)
def s15(t):
    ids = F.when(F.col("c_mktsegment") == "BUILDING", 1).when(F.col("c_mktsegment") == "MACHINERY", 2).otherwise(3)
    long = t("customer").select(F.col("c_nationkey").alias("geo"), ids.alias("characteristic_id"), F.col("c_custkey").alias("value"))
    long = long.groupBy("geo", "characteristic_id").agg(F.max("value").alias("value"))
    return readers.census_profile(long, {1: "households", 2: "income"})


@query("x20_json_roundtrip", "SELECT date, policy_rate, mortgage_5yr FROM px_rates")
def x20(t):
    packed = t("px_rates").select("date", F.to_json(F.struct("policy_rate", "mortgage_5yr")).alias("stats_json"))
    parsed = packed.select("date", F.from_json("stats_json", "policy_rate double, mortgage_5yr double").alias("s"))
    return parsed.select("date", "s.policy_rate", "s.mortgage_5yr")
