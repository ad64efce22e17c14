"""Look-up queries as joins of a request table with the property table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravalor import constants as K
from terravalor.functions.quantiles import exact_percentiles, medians
from terravalor.functions.text import clean_pid
from terravalor.operators import gram_index, match, spatial
from terravalor.session import fixed_table, materialize, small_side

# Coordinates a request may carry.
LAT_RANGE, LON_RANGE = (48.5, 49.6), (-123.5, -122.5)


def validate_requests(requests: DataFrame) -> DataFrame:
    """Adds ``reject_reason``, null for a usable request."""
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    named = F.col("pid").isNotNull() | F.col("address").isNotNull() | located
    inside = F.col("latitude").between(*LAT_RANGE) & F.col("longitude").between(*LON_RANGE)
    return requests.withColumn(
        "reject_reason", F.when(~named, "no identifier").when(located & ~inside, "outside the region")
    )


def property_detail(requests: DataFrame, props: DataFrame) -> DataFrame:
    return requests.withColumn("pid", clean_pid(F.col("pid"))).join(props, "pid")


def with_overrides(features: DataFrame, overrides: dict[str, str]) -> DataFrame:
    """Request values replace feature values where given: {feature: override column}."""
    return features.withColumns({f: F.coalesce(F.col(o), F.col(f)) for f, o in overrides.items()})


def with_lookup(requests: DataFrame, features: DataFrame, key: str, computed: dict[str, Column]) -> DataFrame:
    """Stored features by key; where a row or value is missing the computed one stands in."""
    stored = features.select(key, *[F.col(c).alias(f"_{c}") for c in computed])
    joined = requests.join(stored, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(f"_{c}"), e) for c, e in computed.items()}).drop(*[f"_{c}" for c in computed])


# ---- search -----------------------------------------------------------------------------


def _ranked(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def search_pid(queries: DataFrame, index: gram_index.GramIndex, limit: int = 10) -> DataFrame:
    """The first properties whose number contains the fragment, from the index of their numbers; an empty fragment finds nothing."""
    wanted = queries.select("query", F.regexp_replace("query", "[- ]", "").alias("fragment")).distinct()
    found = gram_index.search(wanted, index, limit).withColumnRenamed("key", "pid")
    return wanted.join(found, "fragment").select("query", "pid", "rank")


def search_address(queries: DataFrame, props: DataFrame, limit: int = 10) -> DataFrame:
    """Street words by prefix, with or without a civic number.

    With one: lots of that number, else the nearest numbers, else whatever lies on the street.
    Without: numbered lots of the street, else any. ``kind`` says which (exact, nearest, street).
    Works on distinct queries, distinct streets and at most ``limit`` properties
    per address, so its cost follows the number of addresses, not of pairs.
    """
    q = queries.select("query").distinct().withColumn("_t", F.split(F.upper(F.trim("query")), r"\s+"))
    number = F.filter("_t", lambda x: x.rlike("^[0-9-]+$"))
    words = F.filter("_t", lambda x: ~x.rlike("^[0-9-]+$"))
    q = q.select("query", F.regexp_replace(F.get(number, F.lit(0)), "-", "").try_cast("long").alias("civic"), words.alias("words"))

    streets = props.where(F.col("street_name").isNotNull()).select("street_name").distinct()
    prefixes = F.expr("flatten(transform(split(street_name, '[ -]'), w -> transform(sequence(1, length(w)), n -> substring(w, 1, n))))")
    index = streets.select("street_name", F.explode(F.array_distinct(prefixes)).alias("word"))
    hits = (
        q.where(F.size("words") > 0)
        .select("query", "civic", F.size(F.array_distinct("words")).alias("_need"), F.explode(F.array_distinct("words")).alias("word"))
        .join(index, "word")
        .groupBy("query", "civic", "_need", "street_name").agg(F.count(F.lit(1)).alias("_got"))
        .where(F.col("_got") == F.col("_need")).select("query", "civic", "street_name")
    )
    hits = materialize(hits)

    civic = F.coalesce(F.col("civic_number"), F.lit(0)).cast("long")
    to_civic = F.coalesce(F.col("to_civic_number"), F.lit(0)).cast("long")
    entries = props.where(F.col("street_name").isNotNull()).select(
        "pid", "street_name", "tax_assessment_year", civic.alias("_own"),
        F.explode(F.array_distinct(F.array(civic, to_civic))).alias("civic"),
    )
    newest = [F.col("tax_assessment_year").desc_nulls_last(), F.col("pid")]
    by_number = _ranked(entries, ["street_name", "civic"], newest, limit, "_r")
    exact = _ranked(hits.where("civic IS NOT NULL").join(by_number, ["street_name", "civic"]), ["query"], newest, limit)
    exact = materialize(exact.select("query", "pid", "rank", F.lit("exact").alias("kind")))

    own = entries.where((F.col("_own") > 0) & (F.col("civic") == F.col("_own")))
    numbers = own.select("street_name", F.col("civic").alias("_near")).distinct()
    rest = hits.where("civic IS NOT NULL").join(exact.select("query").distinct(), "query", "left_anti")
    dist = F.abs(F.col("_near") - F.col("civic"))
    # rank() keeps every number tied with the last one, so the order by pid below sees them all.
    by_gap = Window.partitionBy("query").orderBy("_d")
    close = rest.join(numbers, "street_name").withColumn("_d", dist).withColumn("_r", F.rank().over(by_gap)).where(F.col("_r") <= limit)
    per_number = _ranked(own.withColumnRenamed("civic", "_near"), ["street_name", "_near"], [F.col("pid")], limit, "_p")
    nearest = _ranked(
        close.select("query", "street_name", "_near", "_d").join(per_number, ["street_name", "_near"]), ["query"], [F.col("_d"), F.col("pid")], limit
    )
    nearest = nearest.select("query", "pid", "rank", F.lit("nearest").alias("kind"))

    every = props.where(F.col("street_name").isNotNull()).select("pid", "street_name", civic.alias("_own"))
    on_street = lambda rows: _ranked(rows.select("street_name", "pid"), ["street_name"], [F.col("pid")], limit, "_r")
    street = lambda of, rows: _ranked(of.join(on_street(rows), "street_name"), ["query"], [F.col("pid")], limit).select("query", "pid", "rank", F.lit("street").alias("kind"))
    found = exact.unionByName(nearest).unionByName(street(hits.where("civic IS NULL"), every.where("_own > 0")))
    found = materialize(found)
    return found.unionByName(street(hits.join(found.select("query").distinct(), "query", "left_anti"), every))


def building_units(buildings: DataFrame, props: DataFrame) -> DataFrame:
    """Units at (civic, street): on the street of that name, else on streets that hold all its words.

    The unit is the from-civic number where the table has one, else the civic number where it
    differs from the lot's.
    """
    building = F.col("to_civic_number").cast("long")
    unit = F.col("from_civic_number").cast("long") if "from_civic_number" in props.columns else F.col("civic_number")
    differs = (unit > 0) if "from_civic_number" in props.columns else (unit > 0) & (unit != building)
    lot = props.select(building.alias("building_number"), F.upper("street_name").alias("_street"), F.when(differs, unit).alias("unit_number"), "pid", "property_type", "total_assessed_value")
    wanted = buildings.select("building_number", "street_name").distinct().withColumn("_name", F.upper(F.trim("street_name")))
    exact = wanted.join(lot, (wanted["building_number"] == lot["building_number"]) & (F.col("_name") == F.col("_street"))).drop(lot["building_number"])
    exact = materialize(exact)
    rest = wanted.join(exact.select("building_number", "street_name").distinct(), ["building_number", "street_name"], "left_anti")
    words = F.filter(F.split("_name", r"\s+"), lambda w: F.length(w) > 1)
    loose = rest.join(lot, "building_number").where(F.forall(words, lambda w: F.contains(F.coalesce("_street", F.lit("")), w)))
    columns = ["building_number", "street_name", "unit_number", "pid", "property_type", "total_assessed_value"]
    return exact.select(*columns).unionByName(loose.select(*columns))


def nearest_civic(requests: DataFrame, props: DataFrame) -> DataFrame:
    """Best property on a street for a civic number: nearest number, then latest year, then pid."""
    civic = F.col("civic_number")
    best_of_number = (
        props.where((civic > 0) & F.col("street_name").isNotNull())
        .groupBy("street_name", civic.alias("_civic"))
        .agg(F.min(F.struct((-F.col("tax_assessment_year")).alias("y"), F.col("pid").alias("pid"))).alias("_b"))
    )
    wanted = requests.select("civic", "street_name").distinct()
    return (
        wanted.join(best_of_number, "street_name")
        .groupBy("civic", "street_name")
        .agg(F.min(F.struct(F.abs(F.col("_civic") - F.col("civic")).alias("d"), "_b")).alias("_m"))
        .select("civic", "street_name", F.col("_m._b.pid").alias("pid"), F.col("_m.d").alias("civic_gap"))
    )


# ---- subject resolution --------------------------------------------------------------------


def peer_medians(props: DataFrame) -> DataFrame:
    """Median assessed value per type: the stand-in for a property nobody knows."""
    return medians(props, ["property_type"], {"peer_value": "total_assessed_value"})


def resolve_subjects(requests: DataFrame, props: DataFrame) -> DataFrame:
    """request_id → property by number, else address, else nearest point, else a synthetic peer.

    Requests carry request_id, pid, address, latitude, longitude, property_type.
    """
    base = materialize(requests)
    by_pid = (
        base.where(F.col("pid").isNotNull()).withColumn("pid", clean_pid(F.col("pid")))
        .join(props.select("pid"), "pid", "left_semi").select("request_id", "pid", F.lit(1).alias("way"))
    )
    texts = base.where(F.col("address").isNotNull()).select("request_id", match.parse_request_address(F.col("address")).alias("_p"))
    texts = materialize(texts.select("request_id", F.col("_p.street").alias("_s"), F.col("_p.civic").alias("_n"), F.col("_p.unit").alias("_u")))
    civic, to_civic = F.col("civic_number").cast("long"), F.col("to_civic_number").cast("long")
    named = props.where(F.col("street_name").isNotNull())
    newest = F.min(F.struct((-F.col("tax_assessment_year")).alias("y"), "pid")).alias("_b")
    address_key = (
        named.select("pid", "tax_assessment_year", F.col("street_name").alias("_s"), F.explode(F.array_distinct(F.filter(F.array(civic, to_civic), lambda n: n > 0))).alias("_n"))
        .groupBy("_s", "_n").agg(newest)
    )
    unit_key = named.where(civic > 0).groupBy(F.col("street_name").alias("_s"), to_civic.alias("_n"), civic.alias("_u")).agg(newest)
    # The unit that an address names goes before the other lots of its number.
    by_unit = texts.join(unit_key, ["_s", "_n", "_u"]).select("request_id", F.col("_b.pid").alias("pid"))
    by_number = texts.join(by_unit.select("request_id"), "request_id", "left_anti").join(address_key, ["_s", "_n"]).select("request_id", F.col("_b.pid").alias("pid"))
    by_address = by_unit.unionByName(by_number).withColumn("way", F.lit(2))
    points = base.where(F.col("latitude").isNotNull()).select(
        "request_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), "property_type"
    )
    close = spatial.nearest_property(points, props)
    by_point = points.join(close, ["lat", "lon", "property_type"]).where(F.col("pid").isNotNull()).select("request_id", "pid", F.lit(3).alias("way"))
    found = by_pid.unionByName(by_address).unionByName(by_point)
    best = found.groupBy("request_id").agg(F.min(F.struct("way", "pid")).alias("_b"))
    values = props.select("pid", "total_assessed_value", "current_land_value", "current_improvement_value")
    resolved = (
        base.select("request_id", "property_type").join(best, "request_id", "left")
        .select("request_id", "property_type", F.col("_b.way").alias("way"), F.col("_b.pid").alias("pid"))
        .join(values, "pid", "left").join(peer_medians(props), "property_type", "left")
    )
    ways = F.element_at(F.array(*[F.lit(x) for x in ("pid", "address", "nearest")]), F.col("way"))
    return resolved.select(
        "request_id", "pid", F.coalesce(F.when(F.col("way").isNotNull(), ways), F.lit("synthetic")).alias("resolved_by"),
        F.coalesce("total_assessed_value", "peer_value").alias("total_assessed_value"),
        F.coalesce("current_land_value", F.col("peer_value") * 0.4).alias("current_land_value"),
        F.coalesce("current_improvement_value", F.col("peer_value") * 0.6).alias("current_improvement_value"),
    )


# ---- context and freshness ---------------------------------------------------------------------


def market_context(requests: DataFrame, props: DataFrame) -> DataFrame:
    """Area figures per request: median, change of medians, count, latest year."""
    keyed = props.where(F.col("neighbourhood_code").isNotNull()).withColumn(
        "previous_total", F.col("previous_land_value") + F.col("previous_improvement_value")
    )
    stats = keyed.groupBy("neighbourhood_code").agg(
        F.count(F.lit(1)).alias("area_count"), F.max("tax_assessment_year").alias("latest_year")
    )
    mids = medians(keyed, ["neighbourhood_code"], {"area_median": "total_assessed_value", "_p": "previous_total"})
    areas = stats.join(mids, "neighbourhood_code").withColumn(
        "area_yoy_pct", F.when(F.col("_p") > 0, (F.col("area_median") - F.col("_p")) / F.col("_p") * 100)
    ).drop("_p")
    return requests.join(areas, "neighbourhood_code", "left")


def freshness(table: DataFrame, day: str, as_of: str) -> DataFrame:
    return table.agg(F.max(day).alias("latest"), F.count(F.lit(1)).alias("rows")).withColumn(
        "staleness_days", F.datediff(F.to_date(F.lit(as_of)), F.col("latest"))
    )


# ---- segments ------------------------------------------------------------------------------------


def segment_fallback(rows: DataFrame, segments: DataFrame, columns: list[str]) -> DataFrame:
    """Segment columns by (area, type), else citywide type, else citywide all.

    Two equi-joins; the one citywide segment comes in as a scalar.
    """
    keys = {
        "a": F.concat_ws("__", "neighbourhood_code", "property_type"),
        "t": F.concat_ws("__", F.lit("citywide"), "property_type"),
    }
    segments = small_side(segments)  # written: Spark broadcasts it by its size, so hot types are not shuffled
    out = rows
    for tag, key in keys.items():
        side = segments.select(F.col("segment").alias(f"_k{tag}"), *[F.col(c).alias(f"_{tag}_{c}") for c in columns])
        out = out.withColumn(f"_q{tag}", key).join(side, F.col(f"_q{tag}") == F.col(f"_k{tag}"), "left")
    last = segments.where(F.col("segment") == "citywide__all").agg(F.first(F.struct("segment", *columns)).alias("s"))
    out = out.withColumn("_city", last.scalar())
    in_a, in_t = F.col("_ka").isNotNull(), F.col("_kt").isNotNull()
    picked = {
        c: F.when(in_a, F.col(f"_a_{c}")).when(in_t, F.col(f"_t_{c}")).otherwise(F.col(f"_city.{c}")) for c in columns
    }
    picked["segment_used"] = F.coalesce("_ka", "_kt", F.col("_city.segment"))
    return out.withColumns(picked).select(*rows.columns, *columns, "segment_used")


def nearest_segment(wanted: DataFrame, available: DataFrame) -> DataFrame:
    """Best available (area, type) per wanted one: type preference, then code distance, then key.

    The available segments are a short list (areas × types); it rides along as an array.
    """
    prefs = [(k, o, i + 1) for k, others in K.CROSS_TYPE_PREFERENCE.items() for i, o in enumerate(others)]
    prefs += [(k, k, 0) for k in K.CROSS_TYPE_PREFERENCE]
    ranks = fixed_table(wanted.sparkSession, prefs, "property_type string, seg_type string, type_rank int")
    packed = available.agg(F.array_agg(F.struct("area", "seg_type")).alias("s"))
    pairs = (
        wanted.select("neighbourhood_code", "property_type").distinct()
        .select("*", F.explode(packed.scalar()).alias("_s")).select("neighbourhood_code", "property_type", "_s.area", "_s.seg_type")
        .join(ranks, ["property_type", "seg_type"])
    )
    gap = F.coalesce(F.abs(F.col("area").try_cast("int") - F.col("neighbourhood_code").try_cast("int")), F.lit(999))
    best = pairs.groupBy("neighbourhood_code", "property_type").agg(
        F.min(F.struct("type_rank", gap.alias("gap"), "area", "seg_type")).alias("_b")
    )
    return best.select(
        "neighbourhood_code", "property_type", F.concat_ws("__", F.col("_b.area"), F.col("_b.seg_type")).alias("segment_used"),
        F.col("_b.gap").alias("code_gap"),
    )


def report_top_lists(matched: DataFrame, k: int = 20) -> DataFrame:
    """Areas of the report: the k with most sales, with median ratio and averages."""
    from terravalor.operators.market import ratio_by

    return ratio_by(matched, F.col("sub_area"), "sub_area").orderBy(F.col("count").desc(), "sub_area").limit(k)


def daily_numbers(listings: DataFrame, day: str) -> DataFrame:
    """Figures of one sale day."""
    from terravalor.operators.market import daily_kpis

    return daily_kpis(listings.where(F.col("sold_date") == F.to_date(F.lit(day))))


def median_by(props: DataFrame, key: str, value: str) -> DataFrame:
    return exact_percentiles(props, [key], value, {"median_value": 0.5})
