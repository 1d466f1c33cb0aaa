"""SQL that computes each registered query independently of the library."""

from __future__ import annotations

from contract.views import with_views

ORACLE: dict[str, str] = {}

# Base of most questions: every sale next to its property.
BASE = """
base AS (
  SELECT s.id AS sale_id, s.property_id, s.price_numeric, s.date_sold_iso, s.tenure,
         s.property_type AS sale_type, substr(s.date_sold_iso, 1, 7) AS month,
         CAST(substr(s.date_sold_iso, 1, 4) AS INT) AS year,
         p.address, p.postcode, p.postcode_clean, p.property_type, p.bedrooms, p.bathrooms,
         p.listing_status, upper(coalesce(nullif(trim(s.property_type), ''), nullif(trim(p.property_type), ''), 'Unknown')) AS type_key
  FROM sale s JOIN property p ON s.property_id = p.id)
"""


def on_base(name: str, sql: str, more: str = "") -> None:
    ORACLE[name] = with_views(f"WITH {BASE}{more} {sql}", "property", "sale")


def on_views(name: str, sql: str, *names: str) -> None:
    ORACLE[name] = with_views(sql, *names)


def whole(expr: str) -> str:
    return f"CAST(round_even({expr}, 0) AS BIGINT)"


# Street of an address, written with list functions of the checking database.
STREET_WORDS = ("Road|Street|Avenue|Lane|Drive|Close|Way|Gardens|Crescent|Place|Terrace|Court|Hill|"
                "Park|Grove|Square|Walk|Rise|Row|Mews|Yard|Passage|Parade|Green|Circus|Gate|View|"
                "Wharf|Linkway|Westway")
AREA_LIST = ("['raynes park', 'wimbledon chase', 'west wimbledon', 'east wimbledon', "
             "'wimbledon park', 'colliers wood', 'south wimbledon', 'morden park']")
NAMED = r"trim(regexp_replace(x, '^(\d+[a-zA-Z]?[\s-]*)+', ''))"
STREET = rf"""
parts AS (
  SELECT id, list_filter(
    list_transform(string_split(regexp_replace(address,
      '\b[A-Z]{{1,2}}\d[A-Z\d]?\s*\d[A-Z]{{2}}\b', '', 'gi'), ','), lambda x: trim(x)),
    lambda x: x <> '' AND lower(x) NOT IN ('london', 'england', 'uk', 'united kingdom')
      AND NOT regexp_matches(x, '^(flat|unit|apt|apartment)?\s*\d+[a-zA-Z]?$', 'i')) AS p
  FROM property),
street AS (
  SELECT id, coalesce(
    list_filter(list_transform(list_filter(p, lambda x:
      regexp_matches(x, '\b({STREET_WORDS})\b', 'i') AND NOT list_contains({AREA_LIST}, lower(x))),
      lambda x: {NAMED}), lambda x: x <> '')[1],
    list_filter(list_transform(p, lambda x: {NAMED}),
      lambda x: x <> '' AND NOT list_contains({AREA_LIST}, lower(x)))[1],
    list_filter(list_transform(p, lambda x: {NAMED}), lambda x: x <> '')[1],
    'Unknown') AS street
  FROM parts),
sbase AS (SELECT b.*, s.street FROM base b JOIN street s ON b.property_id = s.id)
"""

# --- market overview ---------------------------------------------------------

on_views("overview_totals", f"""
SELECT (SELECT count(DISTINCT postcode) FROM property) AS total_postcodes,
       (SELECT count(*) FROM property) AS total_properties,
       count(*) AS total_sales, min(date_sold_iso) AS earliest, max(date_sold_iso) AS latest,
       {whole('avg(price_numeric)')} AS avg_price
FROM sale""", "property", "sale")

on_views("upper_median", """
SELECT price_numeric AS median_price FROM (
  SELECT price_numeric, row_number() OVER (ORDER BY price_numeric) - 1 AS r, count(*) OVER () AS n
  FROM sale WHERE price_numeric IS NOT NULL) WHERE r = n // 2""", "sale")

on_views("price_bands", """
SELECT range, CAST(count(price_numeric) AS BIGINT) AS count
FROM (VALUES ('Under £200k', 0, 200000), ('£200k-£400k', 200000, 400000), ('£400k-£600k', 400000, 600000),
             ('£600k-£1M', 600000, 1000000), ('Over £1M', 1000000, 9000000000000)) b(range, lo, hi)
LEFT JOIN sale ON price_numeric >= lo AND price_numeric < hi GROUP BY range""", "sale")

on_base("top_postcodes", f"""
SELECT postcode, count(*) AS count, {whole('avg(price_numeric)')} AS avg_price
FROM base GROUP BY postcode ORDER BY count DESC, postcode LIMIT 10""")

for name, key, column in (
    ("type_breakdown", "", "type_key AS property_type"),
    ("type_breakdown_by_postcode", "postcode_clean,", "type_key AS property_type"),
    ("bedroom_dist", "", "bedrooms"),
    ("bedroom_dist_by_postcode", "postcode_clean,", "bedrooms"),
):
    on_base(name, f"""
SELECT {key} {column}, count(*) AS count, {whole('avg(price_numeric)')} AS avg_price
FROM base WHERE price_numeric IS NOT NULL {'AND bedrooms IS NOT NULL' if 'bed' in name else ''}
GROUP BY {key} {column.split(' AS ')[0]}""")

for name, key in (("sales_volume", ""), ("sales_volume_by_postcode", "postcode_clean,")):
    on_base(name, f"""SELECT {key} year, count(*) AS count FROM base
WHERE date_sold_iso IS NOT NULL GROUP BY {key} year""")

for name, key in (("monthly_trend", ""), ("monthly_trend_by_postcode", "postcode_clean,")):
    on_base(name, f"""
SELECT {key} month, {whole('avg(price_numeric)')} AS avg_price,
       {whole('median(price_numeric)')} AS median_price,
       min(price_numeric) AS min_price, max(price_numeric) AS max_price, count(*) AS count
FROM base WHERE price_numeric IS NOT NULL AND month IS NOT NULL GROUP BY {key} month""")

on_base("recent_sales", """
SELECT sale_id, property_id, address, postcode, price_numeric AS price, date_sold_iso AS date_sold,
       coalesce(nullif(trim(sale_type), ''), nullif(trim(property_type), ''), 'Unknown') AS property_type, bedrooms
FROM base WHERE price_numeric IS NOT NULL AND date_sold_iso IS NOT NULL
ORDER BY date_sold_iso DESC, sale_id DESC LIMIT 50""")

on_base("street_comparison", f"""
SELECT postcode_clean, street, count(*) AS count, {whole('avg(price_numeric)')} AS avg_price
FROM sbase WHERE price_numeric IS NOT NULL GROUP BY postcode_clean, street""", "," + STREET)

on_base("postcode_comparison", f"""
SELECT postcode, count(*) AS count, {whole('avg(price_numeric)')} AS avg_price
FROM base WHERE price_numeric IS NOT NULL GROUP BY postcode""")

_FACETS = [
    ("month", "month", "price_numeric IS NOT NULL"),
    ("type_key", "type_key", "price_numeric IS NOT NULL"),
    ("street", "street", "price_numeric IS NOT NULL"),
    ("postcode", "postcode", "price_numeric IS NOT NULL"),
    ("bedrooms", "CAST(bedrooms AS VARCHAR)", "price_numeric IS NOT NULL"),
    ("year", "CAST(year AS VARCHAR)", "TRUE"),
]
on_base("summary_grouping_sets", " UNION ALL ".join(f"""
SELECT postcode_clean, '{facet}' AS facet, {value} AS value, count(*) AS count,
       {'CAST(NULL AS BIGINT)' if facet == 'year' else whole('avg(price_numeric)')} AS avg_price,
       {whole('median(price_numeric)') if facet == 'month' else 'CAST(NULL AS BIGINT)'} AS median_price,
       {'min(price_numeric)' if facet == 'month' else 'CAST(NULL AS BIGINT)'} AS min_price,
       {'max(price_numeric)' if facet == 'month' else 'CAST(NULL AS BIGINT)'} AS max_price
FROM sbase WHERE {value} IS NOT NULL AND {condition} GROUP BY postcode_clean, {value}"""
    for facet, value, condition in _FACETS), "," + STREET)

on_views("stats_by_postcode", """
SELECT p.postcode, count(DISTINCT p.id) AS properties, count(s.id) AS total_sales,
       round_even(avg(p.bedrooms), 1) AS avg_beds,
       string_agg(DISTINCT p.property_type, ',' ORDER BY p.property_type) AS types
FROM property p LEFT JOIN sale s ON s.property_id = p.id GROUP BY p.postcode""", "property", "sale")

# --- capital growth ----------------------------------------------------------

MEDIANS = f"""
medians AS (
  SELECT postcode, year, {whole('median(price_numeric)')} AS median_price, count(*) AS sale_count
  FROM base WHERE price_numeric IS NOT NULL AND date_sold_iso IS NOT NULL GROUP BY postcode, year)
"""


def on_medians(name: str, sql: str, more: str = "") -> None:
    on_base(name, sql, "," + MEDIANS + more)


on_medians("annual_medians", "SELECT * FROM medians")

on_medians("cagr_periods", """
SELECT postcode, period_years,
       CASE WHEN e.year - s.year > 0 AND s.median_price > 0 THEN
         round_even((pow(CAST(e.median_price AS DOUBLE) / s.median_price, 1.0 / (e.year - s.year)) - 1) * 100, 2)
       END AS cagr_pct, s.median_price AS start_price, e.median_price AS end_price
FROM (SELECT l.postcode, n.period_years, l.y AS y1,
             (SELECT min(year) FROM medians m WHERE m.postcode = l.postcode AND m.year >= l.y - n.period_years) AS y0
      FROM (SELECT postcode, max(year) AS y FROM medians GROUP BY postcode) l,
           (VALUES (1), (3), (5), (10)) n(period_years)) k
JOIN medians s USING (postcode) JOIN medians e USING (postcode)
WHERE s.year = y0 AND e.year = y1""")

on_base("growth_leaderboard", f"""
SELECT postcode, k.sale_count, y1 - y00 AS data_years,
       round_even((pow(e.m / s.m, 1.0 / (y1 - y0)) - 1) * 100, 2) AS cagr_pct, {whole('e.m')} AS latest_avg
FROM (SELECT l.*, (SELECT min(year) FROM yearly m WHERE m.postcode = l.postcode AND m.year >= l.y1 - 5) AS y0
      FROM (SELECT postcode, max(year) AS y1, min(year) AS y00, CAST(sum(n) AS BIGINT) AS sale_count
            FROM yearly GROUP BY postcode) l) k
JOIN yearly s USING (postcode) JOIN yearly e USING (postcode)
WHERE s.year = y0 AND e.year = y1 AND y1 - y00 >= 2 AND y1 > y0 AND s.m > 0
ORDER BY cagr_pct DESC, postcode LIMIT 20""", """, yearly AS (
  SELECT postcode, year, avg(price_numeric) AS m, count(*) AS n FROM base
  WHERE price_numeric IS NOT NULL AND date_sold_iso IS NOT NULL GROUP BY postcode, year)""")

on_medians("volatility", """
SELECT postcode, CASE WHEN count(*) >= 3 AND count(ret) >= 2 THEN round_even(stddev_samp(ret), 2) END AS volatility_pct
FROM (SELECT postcode, CASE WHEN lag(median_price) OVER w > 0 THEN
        CAST(median_price - lag(median_price) OVER w AS DOUBLE) / lag(median_price) OVER w * 100 END AS ret
      FROM medians WINDOW w AS (PARTITION BY postcode ORDER BY year)) GROUP BY postcode""")

on_medians("max_drawdown", """
SELECT a.postcode, CASE WHEN count(DISTINCT a.year) >= 2 AND max(fall) > 0 THEN round_even(max(fall), 2) END
       AS max_drawdown_pct
FROM (SELECT a.postcode, a.year, CAST(max(b.median_price) - any_value(a.median_price) AS DOUBLE)
             / max(b.median_price) * 100 AS fall
      FROM medians a JOIN medians b ON a.postcode = b.postcode AND b.year <= a.year
      GROUP BY a.postcode, a.year) a GROUP BY a.postcode""")

on_medians("data_span", "SELECT postcode, max(year) - min(year) AS data_years FROM medians GROUP BY postcode")

for name, freedom, least in (("forecast", "n", 3), ("forecast_sample_band", "(n - 1)", 2)):
    on_medians(name, f"""
SELECT postcode, CAST(y1 + h AS INT) AS year, {whole('round(greatest(a * (y1 + h - y0) + b, 0), 6)')} AS predicted_price,
       {whole('round(greatest(a * (y1 + h - y0) + b - sd, 0), 6)')} AS lower_bound,
       {whole('round(greatest(a * (y1 + h - y0) + b + sd, 0), 6)')} AS upper_bound
FROM (SELECT postcode, any_value(a) AS a, any_value(b) AS b, any_value(y0) AS y0, max(year) AS y1,
             sqrt(sum(pow(median_price - (a * (year - y0) + b), 2)) / {freedom.replace('n', 'count(*)')}) AS sd
      FROM medians JOIN line USING (postcode) GROUP BY postcode),
     (VALUES (1), (3), (5)) hz(h)""", f""", line AS (
  SELECT postcode, regr_slope(median_price, year - y0) AS a, regr_intercept(median_price, year - y0) AS b,
         any_value(y0) AS y0
  FROM medians JOIN (SELECT postcode, min(year) AS y0 FROM medians GROUP BY postcode) USING (postcode)
  GROUP BY postcode HAVING count(*) >= {least})""")

# --- investment dashboard ----------------------------------------------------

FILTERED = """, picked AS (
  SELECT * FROM base WHERE bedrooms >= 2 AND bedrooms <= 4 AND price_numeric >= 50000
    AND upper(tenure) = 'FREEHOLD' AND (listing_status IS NULL OR listing_status <> 'for_sale'))"""

for name, source, more in (("price_histogram", "base", ""), ("price_histogram_filtered", "picked", FILTERED)):
    on_base(name, f"""
SELECT CAST(i AS INT) AS bucket, lo + i * w AS min_price, lo + (i + 1) * w AS max_price,
       CAST(coalesce(n, 0) AS BIGINT) AS count,
       concat('£', format('{{:,}}', lo + i * w), '-£', format('{{:,}}', lo + (i + 1) * w)) AS range_label
FROM range(20) r(i) CROSS JOIN lim LEFT JOIN (
  SELECT least((price_numeric - lo) // w, 19) AS i, count(*) AS n FROM {source}, lim
  WHERE price_numeric IS NOT NULL GROUP BY 1) USING (i)
WHERE coalesce(n, 0) > 0 OR i IN (0, 19)""", more + f""", lim AS (
  SELECT min(price_numeric) AS lo,
         CAST(ceil(greatest(max(price_numeric) - min(price_numeric), 1) / 20.0) AS BIGINT) AS w FROM {source})""")

on_base("insights_time_series", f"""
SELECT month, {whole('median(price_numeric)')} AS median_price, {whole('avg(price_numeric)')} AS avg_price,
       count(*) AS sales_count
FROM base WHERE price_numeric IS NOT NULL AND month IS NOT NULL GROUP BY month""")

SCATTER = """
SELECT sale_id, bedrooms, price_numeric AS price, coalesce(postcode, 'Unknown') AS postcode,
       coalesce(nullif(trim(sale_type), ''), nullif(trim(property_type), ''), 'Unknown') AS property_type
FROM base WHERE price_numeric IS NOT NULL AND bedrooms IS NOT NULL"""
on_base("scatter_sample", SCATTER)

on_base("postcode_heatmap", f"""
SELECT postcode, {whole('sum(s) / sum(n)')} AS avg_price, CAST(sum(n) AS BIGINT) AS count,
       CASE WHEN max(year) > min(year) AND arg_min(s / n, year) > 0 THEN
         round_even((arg_max(s / n, year) - arg_min(s / n, year)) / arg_min(s / n, year)
                    / (max(year) - min(year)) * 100, 1) END AS growth_pct
FROM (SELECT postcode, year, sum(price_numeric) AS s, count(*) AS n FROM base
      WHERE price_numeric IS NOT NULL GROUP BY postcode, year) GROUP BY postcode""")

for name, source, more in (("kpis", "base", ""), ("kpis_filtered", "picked", FILTERED)):
    on_base(name, f"""
SELECT round_even((l - f) / f / (months / 12.0) * 100, 1) AS appreciation_rate,
       (SELECT {whole('sum(price_numeric) / sum(bedrooms)')} FROM {source}
        WHERE price_numeric IS NOT NULL AND bedrooms > 0) AS price_per_bedroom,
       round_even((c1 - c0) / CAST(c0 AS DOUBLE) * 100, 1) AS market_velocity_pct,
       CASE WHEN c1 > c0 THEN 'accelerating' ELSE 'decelerating' END AS market_velocity_direction,
       (SELECT round_even(stddev_samp(price_numeric) / avg(price_numeric) * 100, 1) FROM {source})
         AS price_volatility_pct,
       (SELECT count(*) FROM {source}) AS total_sales,
       (SELECT count(DISTINCT property_id) FROM {source}) AS total_properties,
       (SELECT {whole('median(price_numeric)')} FROM {source}) AS median_price
FROM (SELECT CAST(arg_min(m, month) AS DOUBLE) AS f, arg_max(m, month) AS l, count(*) AS months
      FROM (SELECT month, {whole('median(price_numeric)')} AS m FROM {source}
            WHERE price_numeric IS NOT NULL AND month IS NOT NULL GROUP BY month)),
     (SELECT max(c) FILTER (r = 1) AS c1, max(c) FILTER (r = 2) AS c0
      FROM (SELECT year, count(*) AS c, row_number() OVER (ORDER BY year DESC) AS r FROM {source}
            WHERE year IS NOT NULL GROUP BY year))""", more)

DEALS = f"""
SELECT property_id, address, postcode, ptype AS property_type, bedrooms, price_numeric AS price,
       date_sold_iso AS date_sold, {whole('m')} AS postcode_avg, round_even(d, 1) AS value_score,
       CASE WHEN d <= 15 THEN 'Low' WHEN d <= 25 THEN 'Medium' ELSE 'High' END AS risk_level
FROM (SELECT b.*, coalesce(nullif(trim(sale_type), ''), nullif(trim(property_type), ''), 'Unknown') AS ptype, m,
             (m - price_numeric) / m * 100 AS d
      FROM (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY date_sold_iso DESC, sale_id DESC) AS r
            FROM base WHERE price_numeric IS NOT NULL AND date_sold_iso IS NOT NULL) b
      JOIN (SELECT postcode, avg(price_numeric) AS m FROM base WHERE price_numeric IS NOT NULL
            GROUP BY postcode HAVING count(*) >= 2) USING (postcode) WHERE r = 1)
WHERE d > 5 ORDER BY value_score DESC, property_id LIMIT 50"""
on_base("investment_deals", DEALS)
on_base("deals_by_price", f"SELECT * FROM ({DEALS}) ORDER BY price, property_id")

on_views("current_listings", """
SELECT id AS property_id, address, postcode, trim(coalesce(property_type, 'Unknown')) AS property_type,
       bedrooms, bathrooms, listing_price, listing_price_display, listing_url, listing_checked_at
FROM property WHERE listing_status = 'for_sale' AND listing_price >= 100000 AND bedrooms <= 4""", "property")

# --- comparisons -------------------------------------------------------------

LATEST = """
latest AS (
  SELECT property_id, sale_id, latest_price, latest_date, sale_type, tenure FROM (
    SELECT property_id, id AS sale_id, price_numeric AS latest_price, date_sold_iso AS latest_date,
           property_type AS sale_type, tenure,
           row_number() OVER (PARTITION BY property_id ORDER BY date_sold_iso DESC, id DESC) AS r
    FROM sale WHERE price_numeric IS NOT NULL AND date_sold_iso IS NOT NULL) WHERE r = 1)
"""
on_views("latest_sale_per_property", f"WITH {LATEST} SELECT * FROM latest", "sale")

on_base("trend_line", f"""
SELECT min(bedrooms) AS x_min, max(bedrooms) AS x_max,
       round(regr_slope(price, bedrooms) * min(bedrooms) + regr_intercept(price, bedrooms), 4) AS y_at_min,
       round(regr_slope(price, bedrooms) * max(bedrooms) + regr_intercept(price, bedrooms), 4) AS y_at_max
FROM ({SCATTER})""")

POINTS = f"""{LATEST}, points AS (
  SELECT p.id, address, postcode, latitude, longitude, latest_price, property_type, bedrooms
  FROM property p LEFT JOIN latest l ON l.property_id = p.id
  WHERE postcode IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL)
"""
on_views("map_points", f"WITH {POINTS} SELECT * FROM points", "property", "sale")

on_views("quartile_bands", f"""WITH {POINTS}, ranked AS (
  SELECT latest_price, row_number() OVER (ORDER BY latest_price) - 1 AS r, count(*) OVER () AS n
  FROM points WHERE latest_price IS NOT NULL),
cuts AS (SELECT max(latest_price) FILTER (r = floor(n * 0.25)) AS q1,
                max(latest_price) FILTER (r = floor(n * 0.5)) AS q2,
                max(latest_price) FILTER (r = floor(n * 0.75)) AS q3 FROM ranked)
SELECT id, latest_price, CAST(CASE WHEN latest_price <= q1 THEN 1 WHEN latest_price <= q2 THEN 2
  WHEN latest_price <= q3 THEN 3 WHEN latest_price IS NOT NULL THEN 4 END AS INT) AS band
FROM points, cuts""", "property", "sale")

on_views("map_centre", f"""WITH {POINTS}
SELECT round(avg(latitude), 6) AS lat, round(avg(longitude), 6) AS lon FROM points""", "property", "sale")

on_base("area_comparison", """
SELECT postcode, count(price_numeric) AS properties, count(date_sold_iso) AS total_sales,
       count(DISTINCT type_key) FILTER (price_numeric IS NOT NULL) AS property_types,
       count(DISTINCT street) FILTER (price_numeric IS NOT NULL) AS streets
FROM sbase GROUP BY postcode""", "," + STREET)

AREAS = ("AF0 1AB", "AM1 2AB", "EU3 5AB", "AS2 3AB")
_IN_AREAS = "postcode IN (" + ", ".join(f"'{a}'" for a in AREAS) + ")"
on_base("compare_pivot", "SELECT month, " + ", ".join(
    f"{whole(f'''median(price_numeric) FILTER (postcode = '{a}')''')} AS \"{a}\"" for a in AREAS
) + f""" FROM base WHERE price_numeric IS NOT NULL AND month IS NOT NULL AND {_IN_AREAS} GROUP BY month""")
on_base("compare_types", "SELECT type_key AS property_type, " + ", ".join(
    f"count(*) FILTER (postcode = '{a}') AS \"{a}\"" for a in AREAS
) + f""" FROM base WHERE price_numeric IS NOT NULL AND {_IN_AREAS} GROUP BY type_key""")

on_views("property_appreciation", """
SELECT property_id, p0 AS first_price, p1 AS last_price, d0 AS first_date, d1 AS last_date,
       round((p1 / CAST(p0 AS DOUBLE) - 1) * 100, 4) AS total_change_pct,
       CASE WHEN d1 > d0 THEN round((pow(p1 / CAST(p0 AS DOUBLE),
         365.25 / (CAST(d1 AS DATE) - CAST(d0 AS DATE))) - 1) * 100, 4) END AS annualised_pct
FROM (SELECT property_id, min(date_sold_iso) AS d0, max(date_sold_iso) AS d1,
             max(price_numeric) FILTER (a = 1) AS p0, max(price_numeric) FILTER (z = 1) AS p1, count(*) AS n
      FROM (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY date_sold_iso, id) AS a,
                      row_number() OVER (PARTITION BY property_id ORDER BY date_sold_iso DESC, id DESC) AS z
            FROM sale WHERE price_numeric IS NOT NULL AND price_numeric <> 0 AND date_sold_iso IS NOT NULL)
      GROUP BY property_id) WHERE n >= 2""", "sale")
