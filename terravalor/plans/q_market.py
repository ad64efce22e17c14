"""Queries over transactions, schools, admissions, rentals, permits and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from terravalor import constants as K
from terravalor.operators import ingest, market, news
from terravalor.plans.registry import query, rounded


@query(
    "p30_date_parts",
    """SELECT transaction_date, municipality, fair_market_value, CAST(year(transaction_date) AS INT) AS transaction_year,
       CAST(month(transaction_date) AS INT) AS transaction_month,
       year(transaction_date) || 'Q' || quarter(transaction_date) AS transaction_quarter FROM px_transfer_tax""",
)
def p30(t):
    return market.date_parts(t("px_transfer_tax")).select(
        "transaction_date", "municipality", "fair_market_value", "transaction_year", "transaction_month", "transaction_quarter"
    )


@query(
    "a11_transaction_summary",
    """SELECT municipality, year(transaction_date) || 'Q' || quarter(transaction_date) AS transaction_quarter,
       count(*) AS count, round(avg(fair_market_value) + 0.0000001, 3) AS mean_value, round(sum(fair_market_value), 2) AS total_value,
       round(median(fair_market_value), 3) AS median_value FROM px_transfer_tax GROUP BY 1, 2""",
)
def a11(t):
    # The tiny shift keeps means off exact halves, which the engines round differently.
    out = market.transaction_summary(t("px_transfer_tax"))
    return out.select(
        "municipality", "transaction_quarter", "count", F.round(F.col("mean_value") + 1e-7, 3).alias("mean_value"),
        F.round("total_value", 2).alias("total_value"), F.round("median_value", 3).alias("median_value"),
    )


@query(
    "a12_foreign_share",
    """SELECT municipality, CAST(year(transaction_date) AS INT) AS transaction_year, count(*) AS total_transactions,
       count(*) FILTER (foreign_involvement = 'Y') AS foreign_transactions,
       round(avg(CASE WHEN foreign_involvement = 'Y' THEN 1 ELSE 0 END) * 100, 4) AS foreign_pct
       FROM px_transfer_tax GROUP BY 1, 2""",
)
def a12(t):
    return rounded(market.foreign_share(t("px_transfer_tax")))


@query(
    "a13_w15_price_histogram",
    """WITH b AS (SELECT *, lead(lo, 1, 1e300) OVER (ORDER BY lo) AS hi FROM
         (SELECT CAST(unnest([0, 250000, 500000, 750000, 1000000, 1500000, 2000000, 3000000, 5000000]) AS DOUBLE) AS lo) e)
       SELECT lo AS price_from, count(*) AS count, round(count(*) / sum(count(*)) OVER () * 100, 4) AS pct
       FROM px_transfer_tax JOIN b ON fair_market_value >= lo AND fair_market_value < hi GROUP BY lo""",
)
def a13(t):
    return rounded(market.price_histogram(t("px_transfer_tax")))


@query(
    "a13_property_value_histogram",
    """WITH b AS (SELECT *, lead(lo, 1, 1e300) OVER (ORDER BY lo) AS hi FROM
         (SELECT CAST(unnest([0, 250000, 500000, 750000, 1000000, 1500000, 2000000, 3000000, 5000000]) AS DOUBLE) AS lo) e)
       SELECT lo AS price_from, count(*) AS count, round(count(*) / sum(count(*)) OVER () * 100, 4) AS pct
       FROM o_universe JOIN b ON total_assessed_value >= lo AND total_assessed_value < hi GROUP BY lo""",
)
def a13b(t):
    return rounded(market.price_histogram(t.universe, "total_assessed_value"))


@query(
    "p28_region_filters",
    """SELECT municipality, count(*) AS n FROM px_transfer_tax
       WHERE lower(trim(municipality)) IN ('nation_1', 'nation_3', 'nation_5', 'nation_7') GROUP BY 1""",
)
def p28(t):
    names = t("nation").where("n_nationkey IN (1, 3, 5, 7)").select(F.lower(F.trim("n_name")).alias("_m"))
    kept = t("px_transfer_tax").withColumn("_m", F.lower(F.trim("municipality"))).join(names, "_m", "left_semi")
    return kept.groupBy("municipality").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p28_district_codes",
    """SELECT lpad(CAST(route_id AS STRING), 3, '0') AS district, count(*) AS n FROM px_poi WHERE kind = 'school' GROUP BY 1""",
)
def p28b(t):
    code = F.lpad(F.col("route_id").cast("string"), 3, "0").alias("district")
    return t("px_poi").where("kind = 'school'").groupBy(code).agg(F.count(F.lit(1)).alias("n"))


@query(
    "a14_w16_school_scores",
    """WITH m AS (SELECT c_custkey % 200 AS school_id, s FROM (
         SELECT c_custkey, list_avg(list_filter([CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_custkey % 101 AS DOUBLE) END,
           CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_custkey % 37 AS DOUBLE) END,
           CAST(c_nationkey AS DOUBLE)], lambda x: x IS NOT NULL)) AS s FROM customer) r WHERE s IS NOT NULL),
       a AS (SELECT school_id, avg(s) AS raw_score FROM m GROUP BY 1)
       SELECT school_id, round(raw_score, 4) AS raw_score, round(CASE WHEN max(raw_score) OVER () > min(raw_score) OVER ()
         THEN (raw_score - min(raw_score) OVER ()) / (max(raw_score) OVER () - min(raw_score) OVER ()) * 100 ELSE 50 END, 4)
         AS quality_score FROM a""",
)
def a14(t):
    results = t("customer").select(
        (F.col("c_custkey") % 200).alias("school_id"),
        F.when(F.col("c_custkey") % 5 != 0, (F.col("c_custkey") % 101).cast("double")).alias("numeracy"),
        F.when(F.col("c_custkey") % 7 != 0, (F.col("c_custkey") % 37).cast("double")).alias("literacy"),
        F.col("c_nationkey").cast("double").alias("writing"),
    )
    return rounded(market.school_scores(results, ["numeracy", "literacy", "writing"]))


@query(
    "a15_monthly_admissions",
    "SELECT make_date(year, month, 1) AS date, CAST(sum(admitted) AS BIGINT) AS admitted FROM px_admissions GROUP BY 1",
)
def a15(t):
    return market.monthly_admissions(t("px_admissions"))


@query(
    "a16_w08_admission_trends",
    """WITH m AS (SELECT make_date(year, month, 1) AS date, CAST(sum(admitted) AS BIGINT) AS admitted FROM px_admissions GROUP BY 1),
       w AS (SELECT *, sum(admitted) OVER (ORDER BY date ROWS 11 PRECEDING) AS t12,
         sum(admitted) OVER (ORDER BY date ROWS BETWEEN 23 PRECEDING AND 12 PRECEDING) AS p12,
         avg(admitted) OVER (ORDER BY date ROWS 2 PRECEDING) AS m3 FROM m)
       SELECT sum(admitted) AS total, round(avg(admitted), 4) AS monthly_mean, max(date) AS latest_month,
         arg_max(admitted, date) AS latest, max(admitted) AS highest, arg_max(t12, date) AS trailing_12,
         arg_max(p12, date) AS prior_12, round(arg_max(m3, date), 4) AS mean_3,
         round((arg_max(t12, date) - arg_max(p12, date)) / arg_max(p12, date) * 100, 4) AS growth_pct FROM w""",
)
def a16(t):
    return rounded(market.admission_trends(market.monthly_admissions(t("px_admissions"))))


@query(
    "a17_demand_units",
    """WITH m AS (SELECT sum(admitted) AS a FROM px_admissions GROUP BY year, month)
       SELECT round(avg(a) * 12 / 2.5, 4) AS housing_units_per_year, round(avg(a), 4) AS avg_monthly FROM m""",
)
def a17(t):
    return rounded(market.demand_indicators(market.monthly_admissions(t("px_admissions"))))


@query(
    "a17_projection_growth",
    """WITH y AS (SELECT municipality AS region, CAST(year(transaction_date) AS INT) AS year, count(*) AS p
         FROM px_transfer_tax WHERE year(transaction_date) BETWEEN 1995 AND 2000 GROUP BY 1, 2),
       e AS (SELECT region, min(year) AS first_year, max(year) AS last_year, arg_min(p, year) AS first_value,
         arg_max(p, year) AS last_value FROM y GROUP BY 1)
       SELECT *, round((last_value - first_value) / first_value * 100, 4) AS growth_pct,
         round((pow(last_value / first_value, 1.0 / (last_year - first_year)) - 1) * 100, 4) AS cagr_pct FROM e""",
)
def a17b(t):
    years = [str(y) for y in range(1995, 2001)]
    wide = (
        market.date_parts(t("px_transfer_tax"))
        .groupBy(F.col("municipality").alias("region"))
        .pivot("transaction_year", [int(y) for y in years])
        .agg(F.count(F.lit(1)))
    )
    return rounded(market.projection_growth(wide, "region", years))


@query(
    "a18_str_area_stats",
    """SELECT area_name, count(*) AS listing_count, round(avg(price), 4) AS avg_price,
       round(avg(CASE WHEN room_type = 'Entire home/apt' THEN 1 ELSE 0 END) * 100, 4) AS entire_home_pct,
       round(avg(availability_365), 4) AS avg_availability, sum(number_of_reviews) AS total_reviews,
       round(median(price), 4) AS median_price FROM px_poi WHERE kind = 'str' GROUP BY 1""",
)
def a18(t):
    return rounded(market.str_area_stats(t("px_poi").where("kind = 'str'")))


@query(
    "a19_permit_summary",
    """SELECT count(*) AS total_permits, count(*) FILTER (lower(type_of_work) LIKE '%new%') AS new_buildings,
       count(*) FILTER (lower(type_of_work) LIKE '%demol%') AS demolitions, round(sum(project_value), 0) AS total_value FROM px_permits""",
)
def a19(t):
    return rounded(market.permit_summary(t("px_permits")), 0)


@query(
    "t05_top_projects",
    "SELECT permit_id, type_of_work, project_value FROM px_permits ORDER BY project_value DESC, permit_id LIMIT 5",
)
def t05(t):
    return t("px_permits").orderBy(F.col("project_value").desc(), "permit_id").limit(5).select(
        "permit_id", "type_of_work", "project_value"
    )


@query(
    "p31_permit_filter",
    """SELECT permit_id, issue_date, type_of_work, project_value FROM px_permits
       WHERE issue_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' AND type_of_work = 'New Building' AND project_value >= 100000""",
)
def p31(t):
    from terravalor.sources import feeds

    return feeds.filter_permits(
        t("px_permits"), "2000-01-01", "2000-12-31", ["New Building"], 100_000.0
    ).select("permit_id", "issue_date", "type_of_work", "project_value")


@query(
    "u02_new_and_demolished",
    "SELECT permit_id, type_of_work FROM px_permits WHERE type_of_work IN ('New Building', 'Demolition / Deconstruction')",
)
def u02(t):
    permits = t("px_permits").select("permit_id", "type_of_work")
    return permits.where("type_of_work = 'New Building'").unionByName(
        permits.where("type_of_work = 'Demolition / Deconstruction'")
    )


@query(
    "s20_two_permit_feeds",
    """SELECT CAST(permit_id AS STRING) AS permit_number, issue_date, type_of_work, address, project_value, 'vancouver' AS source FROM px_permits
       UNION ALL SELECT 'S' || CAST(permit_id AS STRING), issue_date, 'NEW', upper(address), project_value, 'surrey'
       FROM px_permits WHERE type_of_work = 'New Building'""",
)
def s20(t):
    from terravalor.sources import feeds

    first = t("px_permits").select(
        F.col("permit_id").cast("string").alias("permitnumber"), F.col("issue_date").alias("issuedate"),
        F.col("type_of_work").alias("typeofwork"), "address", F.col("project_value").alias("projectvalue"),
    )
    second = t("px_permits").where("type_of_work = 'New Building'").select(
        F.concat(F.lit("S"), F.col("permit_id").cast("string")).alias("PERMIT_NO"),
        F.col("issue_date").alias("ISSUED"), F.lit("NEW").alias("WORK"),
        F.upper("address").alias("SITE_ADDRESS"), F.col("project_value").alias("VALUE"),
    )
    return feeds.unify_permits(first, second)


@query(
    "p10_p11_listing_numbers",
    """SELECT mls_number, sold_price, list_price, sold_price - list_price AS price_diff,
       round((sold_price - list_price) / list_price * 100, 8) AS price_diff_pct FROM px_sold""",
)
def p10(t):
    from terravalor.functions.text import whole_amount

    text = t("px_sold").select(
        "mls_number",
        F.concat(F.lit("$"), F.format_number("sold_price", 0)).alias("s"),
        F.concat(F.lit("$"), F.format_number("list_price", 0), F.lit(".00")).alias("l"),
    )
    typed = text.select("mls_number", whole_amount(F.col("s")).alias("sold_price"), whole_amount(F.col("l")).alias("list_price"))
    return rounded(ingest.price_difference(typed), 8)


@query(
    "p12_sub_areas",
    """SELECT mls_number, code, CASE CAST(sub_area AS INT) % 4 WHEN 0 THEN 'Downtown' WHEN 1 THEN 'Kitsilano'
         WHEN 2 THEN 'Killarney' ELSE 'VXX' END AS sub_area_name,
         CASE CAST(sub_area AS INT) % 4 WHEN 2 THEN 'Vancouver East' WHEN 3 THEN 'Vancouver' ELSE 'Vancouver West' END AS side
       FROM (SELECT *, CASE CAST(sub_area AS INT) % 4 WHEN 0 THEN 'VVWDT' WHEN 1 THEN 'VVWKT' WHEN 2 THEN 'VVEKL' ELSE 'VXX' END AS code
             FROM px_sold) s""",
)
def p12(t):
    code = F.element_at(F.array(*[F.lit(c) for c in ("VVWDT", "VVWKT", "VVEKL", "VXX")]), F.col("sub_area").cast("int") % 4 + 1)
    lookup = F.create_map(*[F.lit(x) for kv in K.SUB_AREAS.items() for x in kv])
    return t("px_sold").withColumn("code", code).select(
        "mls_number", "code", F.coalesce(lookup[F.col("code")], F.col("code")).alias("sub_area_name"),
        ingest.side_of_city(F.col("code")).alias("side"),
    )


@query(
    "p32_detached_attached",
    """SELECT CASE WHEN property_type = 'House/Single Family' THEN 'detached' ELSE 'attached' END AS class, count(*) AS n,
       round(avg(sold_price), 2) AS avg_price FROM o_sold GROUP BY 1""",
)
def p32(t):
    kind = market.listing_class(F.col("property_type")).alias("class")
    return rounded(t.sold.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.avg("sold_price").alias("avg_price")), 2)


@query(
    "p36_recent_sales",
    """SELECT mls_number, sold_date, sold_price FROM o_sold
       WHERE sold_date + CAST(dom % 12 AS INT) = DATE '2001-06-01' AND sold_date >= DATE '2001-06-01' - 7""",
)
def p36(t):
    """Listings first seen on the day, up to eleven days after their sale, whose sale is no more than a week old."""
    from terravalor.functions.dates import parse_date

    layouts = F.array(
        F.date_format("sold_date", "M/d/yyyy"), F.date_format("sold_date", "yyyy-MM-dd"),
        F.date_format("sold_date", "M/d/yy"), F.date_format("sold_date", "MMMM d, yyyy"),
    )
    seen = F.date_add("sold_date", (F.col("dom") % 12).cast("int"))
    text = t.sold.withColumns({"first_seen_date": seen, "sold_text": F.element_at(layouts, F.col("dom") % 4 + 1)})
    parsed = text.withColumn("sold_date", parse_date(F.col("sold_text")))
    return market.newly_seen_sales(parsed, "2001-06-01").select("mls_number", "sold_date", "sold_price")


_SCORED = """n AS (SELECT *, lower(title || ' ' || summary) AS body FROM px_news),
       s AS (SELECT *, least((""" + " + ".join(
    f"CASE WHEN contains(body, '{w}') THEN 1 ELSE 0 END" for w in K.NEWS_KEYWORDS
) + """) / 3.0, 1.0) AS score FROM n WHERE published_day IS NULL OR published_day >= 20240115)"""


@query(
    "p38_t06_headlines",
    f"""WITH {_SCORED},
       r AS (SELECT *, row_number() OVER (PARTITION BY feed_name ORDER BY score DESC, published_day NULLS FIRST, doc_id) AS rn FROM s WHERE score >= 0.3)
       SELECT doc_id, feed_name, published_day, round(score, 4) AS relevance_score FROM r WHERE rn <= 20""",
)
def p38(t):
    fresh = news.headlines(news.score_articles(t("px_news")), 20240115)
    return rounded(news.top_per_feed(fresh, 20).select("doc_id", "feed_name", "published_day", "relevance_score"))


@query(
    "t06_news_of_all_feeds",
    f"""WITH {_SCORED} SELECT doc_id, feed_name, published_day, round(score, 4) AS relevance_score FROM s ORDER BY score DESC, published_day NULLS FIRST, doc_id LIMIT 50""",
)
def t06(t):
    """The first fifty articles of all feeds by relevance, then date."""
    fresh = news.headlines(news.score_articles(t("px_news")), 20240115, minimum=0.0)
    return rounded(fresh.orderBy(*news.by_relevance()).limit(50).select("doc_id", "feed_name", "published_day", "relevance_score"))


@query(
    "x08_news_relevance",
    """WITH n AS (SELECT *, lower(title || ' ' || summary) AS body FROM px_news)
       SELECT doc_id, round(least((""" + " + ".join(
        f"CASE WHEN contains(body, '{w}') THEN 1 ELSE 0 END" for w in K.NEWS_KEYWORDS
    ) + """) / 3.0, 1.0), 4) AS relevance_score FROM n""",
)
def x08(t):
    return rounded(news.score_articles(t("px_news")).select("doc_id", "relevance_score"))


@query(
    "x07_strip_html",
    """SELECT page_id, trim(regexp_replace(html, '<[^>]+>', '', 'g')) AS text,
       substr(trim(regexp_replace(html, '<[^>]+>', '', 'g')), 1, 500) AS summary FROM pages""",
)
def x07(t):
    return news.clean_pages(t("pages")).select("page_id", "text", "summary")


@query(
    "k04_insert_new_articles",
    """WITH stored AS (SELECT DISTINCT url FROM px_news WHERE published_day IS NULL)
       SELECT url, doc_id FROM px_news n WHERE url NOT IN (SELECT url FROM stored)
       QUALIFY row_number() OVER (PARTITION BY url ORDER BY doc_id) = 1""",
)
def k04(t):
    stored = t("px_news").where("published_day IS NULL")
    return ingest.insert_new(stored, t("px_news"), "url", [F.col("doc_id").asc()]).select("url", "doc_id")


@query(
    "j27_new_only",
    """SELECT doc_id FROM px_news WHERE url NOT IN (SELECT url FROM px_news WHERE doc_id % 2 = 0)""",
)
def j27(t):
    seen = t("px_news").where("doc_id % 2 = 0").select("url").distinct()
    return t("px_news").join(seen, "url", "left_anti").select("doc_id")


@query(
    "k03_upsert_listings",
    """WITH a AS (SELECT *, CASE WHEN sold_date < DATE '2000-01-01' THEN 0 ELSE 1 END AS b FROM px_sold)
       SELECT mls_number, sold_price, sold_date, (SELECT min(first_seen_date) FROM px_sold s WHERE s.mls_number = a.mls_number) AS first_seen_date
       FROM a QUALIFY row_number() OVER (PARTITION BY mls_number ORDER BY b DESC, sold_date DESC, sold_price DESC, list_price DESC,
         address DESC, listed_pid DESC, sub_area DESC, property_type DESC, dom DESC, maint_fee DESC) = 1""",
)
def k03(t):
    stored = t("px_sold").where(F.col("sold_date") < "2000-01-01")
    arrived = t("px_sold").where(F.col("sold_date") >= "2000-01-01")
    return ingest.upsert_listings(stored, arrived).select("mls_number", "sold_price", "sold_date", "first_seen_date")


@query(
    "k05_report_log_update",
    """SELECT date AS report_date, CASE WHEN mortgage_5yr IS NOT NULL THEN 1 ELSE 0 END AS email_sent FROM px_rates""",
)
def k05(t):
    log = t("px_rates").select(F.col("date").alias("report_date"), F.lit(0).alias("email_sent"))
    sent = t("px_rates").where("mortgage_5yr IS NOT NULL").select(F.col("date").alias("report_date"), F.lit(1).alias("email_sent"))
    return ingest.update_by_key(log, sent, "report_date", ["email_sent"])


@query(
    "w02_latest_listing",
    "SELECT mls_number, sold_price, sold_date, address FROM o_sold",
)
def w02(t):
    return t.sold.select("mls_number", "sold_price", "sold_date", "address")


@query(
    "s05_t04_sales_by_price",
    "SELECT mls_number, sold_price FROM o_sold ORDER BY sold_price DESC, mls_number LIMIT 50",
)
def s05(t):
    return t.sold.select("mls_number", "sold_price").orderBy(F.col("sold_price").desc_nulls_last(), "mls_number").limit(50)


@query(
    "a08_store_stats",
    """WITH s AS (SELECT 'all' AS set_name, 'all' AS set_key, sold_price FROM o_sold UNION ALL
         SELECT 'type', property_type, sold_price FROM o_sold UNION ALL SELECT 'city', sub_area, sold_price FROM o_sold)
       SELECT set_name, set_key, count(*) AS count, round(avg(sold_price), 2) AS avg_price, min(sold_price) AS min_price,
         max(sold_price) AS max_price FROM s GROUP BY 1, 2""",
)
def a08(t):
    return rounded(market.store_stats(t.sold), 2)


@query(
    "a09_region_stats",
    """WITH act AS (SELECT sub_area, count(*) AS active_count, avg(list_price) AS al FROM px_sold WHERE dom > 30 GROUP BY 1)
       SELECT sub_area, count(*) AS sold_count, round(avg(sold_price), 2) AS avg_sold, round(any_value(al), 2) AS avg_list,
         round(avg((sold_price - (list_price + 1000 * (dom % 3))) / (list_price + 1000 * (dom % 3)) * 100), 4) AS avg_change_pct,
         list_sort(list(sold_price))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median_sold, any_value(active_count) AS active_count,
         round(count(*) / any_value(active_count) * 100, 4) AS sales_to_active_pct
       FROM o_sold JOIN act USING (sub_area) GROUP BY 1""",
)
def a09(t):
    sold = t.sold.withColumn("original_price", F.col("list_price") + 1000 * (F.col("dom") % 3))  # some were cut before the sale
    out = market.region_stats(sold, t("px_sold").where("dom > 30"))
    return out.select(
        "sub_area", "sold_count", F.round("avg_sold", 2).alias("avg_sold"), F.round("avg_list", 2).alias("avg_list"),
        F.round("avg_change_pct", 4).alias("avg_change_pct"), "median_sold", "active_count",
        F.round("sales_to_active_pct", 4).alias("sales_to_active_pct"),
    )


@query(
    "a10_daily_kpis",
    """SELECT sold_date, count(*) AS total_sales, count(*) FILTER (property_type = 'House/Single Family') AS detached_sales,
         round(avg(sold_price), 2) AS avg_price, round(avg(dom), 4) AS avg_dom, round(avg(sold_price - list_price), 2) AS avg_diff,
         count(*) FILTER (sold_price > list_price) AS over_ask, count(*) FILTER (sold_price < list_price) AS under_ask,
         count(*) FILTER (sold_price = list_price) AS at_ask,
         list_sort(list(sold_price))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median_price
       FROM o_sold GROUP BY 1""",
)
def a10(t):
    out = market.daily_kpis(t.sold)
    return out.select(
        "sold_date", "total_sales", "detached_sales", F.round("avg_price", 2).alias("avg_price"),
        F.round("avg_dom", 4).alias("avg_dom"), F.round("avg_diff", 2).alias("avg_diff"), "over_ask", "under_ask", "at_ask",
        "median_price",
    )


@query(
    "p40_price_per_sqft",
    "SELECT mls_number, CASE WHEN floor_area > 0 THEN CAST(floor(sold_price / floor_area) AS BIGINT) END AS ppsf FROM o_sold",
)
def p40(t):
    return t.sold.select(
        "mls_number", F.when(F.col("floor_area") > 0, F.floor(F.col("sold_price") / F.col("floor_area"))).alias("ppsf")
    )


@query(
    "p13_flags_and_coordinates",
    """SELECT poi_id, CASE poi_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS superhost, lat, lon FROM px_poi
       WHERE kind = 'str' AND poi_id % 11 <> 0""",
)
def p13(t):
    from terravalor.functions.text import true_false

    raw = t("px_poi").where("kind = 'str'").select(
        "poi_id",
        F.when(F.col("poi_id") % 3 == 0, "t").when(F.col("poi_id") % 3 == 1, " F ").alias("flag"),
        F.when(F.col("poi_id") % 11 != 0, F.col("lat")).alias("lat"),
        "lon",
    )
    return raw.dropna(subset=["lat", "lon"]).select("poi_id", true_false(F.col("flag")).alias("superhost"), "lat", "lon")


@query(
    "s17_census_by_area",
    """SELECT pid, neighbourhood_code FROM o_universe WHERE CAST(neighbourhood_code AS INT) BETWEEN 1 AND 22""",
)
def s17(t):
    from terravalor.operators import layers

    return layers.join_census(t.universe).where("census_median_income IS NOT NULL").select("pid", "neighbourhood_code")
