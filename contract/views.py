"""Property-market views over the driver's tables.

The SQL below runs unchanged in Spark and in the checking database, so both
sides start from the same rows. Every view keeps all rows of its source table;
CASE and modulo only spread attribute values, they never drop anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from contract.phrases import more_case

OUTCODE = "concat(upper(left(r_name, 2)), CAST(n_nationkey AS STRING))"

PLACE = f"""
SELECT c_custkey, c_acctbal, c_mktsegment, {OUTCODE} AS outcode,
       concat({OUTCODE}, ' ', CAST(c_custkey % 9 + 1 AS STRING), 'AB') AS postcode
FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey
     JOIN {{region}} ON n_regionkey = r_regionkey
"""

# Phrases are ordinary listing lines; each property carries up to four of them.
FEATURES_JSON = """
CASE
  WHEN c_custkey % 29 = 0 THEN NULL
  WHEN c_custkey % 29 = 1 THEN '[]'
  WHEN c_custkey % 29 = 2 THEN 'not json'
  WHEN c_custkey % 29 = 3 THEN '{{"a": 1}}'
  ELSE concat('["',
    CASE c_custkey % 11
      WHEN 0 THEN 'No onward chain' WHEN 1 THEN 'EPC rating C' WHEN 2 THEN 'Council Tax Band - D'
      WHEN 3 THEN 'Garage and driveway' WHEN 4 THEN 'Private rear garden' WHEN 5 THEN 'Gas central heating'
      WHEN 6 THEN 'Share of freehold' WHEN 7 THEN 'Leasehold 125 years remaining'
      WHEN 8 THEN 'Two reception rooms' WHEN 9 THEN 'Unfurnished' ELSE 'Top floor apartment' END,
    '", "',
    CASE c_custkey % 13
      WHEN 0 THEN 'Double glazing' WHEN 1 THEN '1,200 sq ft' WHEN 2 THEN 'Service charge - 1,165 per annum'
      WHEN 3 THEN '0.4 miles to station' WHEN 4 THEN 'South facing garden' WHEN 5 THEN 'Victorian terrace'
      WHEN 6 THEN 'Open plan kitchen' WHEN 7 THEN 'En-suite shower room' WHEN 8 THEN 'Study'
      WHEN 9 THEN 'Lift access' WHEN 10 THEN 'Off street parking' WHEN 11 THEN '85 sq m'
      ELSE 'End of chain' END,
    '", " ',
    CASE c_custkey % 17
      WHEN 0 THEN 'Underfloor heating' WHEN 1 THEN 'Roof terrace' WHEN 2 THEN 'Sea views'
      WHEN 3 THEN 'Potential to extend STPP' WHEN 4 THEN 'Extended family home' WHEN 5 THEN 'Side return extension'
      WHEN 6 THEN 'Basement storage' WHEN 7 THEN 'Set in 1.5 acres' WHEN 8 THEN 'Immaculate condition'
      WHEN 9 THEN 'Ground rent $250.75 pa' WHEN 10 THEN 'Communal gardens' WHEN 11 THEN 'Freehold'
      WHEN 12 THEN 'Living room' WHEN 13 THEN 'Grade II listed building' WHEN 14 THEN 'Third floor'
      WHEN 15 THEN 'Furnished or unfurnished' ELSE 'Chain free' END,
    ' ", "',
    CASE c_custkey % 7
      WHEN 0 THEN 'Fireplace' WHEN 1 THEN 'Porch' WHEN 2 THEN 'Utility room' WHEN 3 THEN ''
      WHEN 4 THEN 'Newly refurbished' WHEN 5 THEN 'Cul-de-sac location' ELSE '95 year lease' END,
    '", "', @MORE@,
    '"]')
END
""".replace("@MORE@", more_case("c_custkey * 7 + c_custkey % 29"))

VIEWS: dict[str, str] = {
    "property": f"""
SELECT c_custkey AS id,
       concat(CASE c_custkey % 6
                WHEN 0 THEN concat(CAST(c_custkey AS STRING), ', Coombe Lane, London ')
                WHEN 1 THEN concat('Flat 5, ', CAST(c_custkey AS STRING), 'a High Street, ')
                WHEN 2 THEN concat(CAST(c_custkey AS STRING), ', Woodlands, Raynes Park, London ')
                WHEN 3 THEN concat('Flat ', CAST(c_custkey AS STRING), ', Raynes Park, England, ')
                WHEN 4 THEN concat(CAST(c_custkey AS STRING), ' ')
                ELSE concat(CAST(c_custkey AS STRING), ' Church Road, Wimbledon Park, UK, ') END,
              postcode) AS address,
       postcode, replace(postcode, ' ', '') AS postcode_clean, outcode,
       CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS property_type,
       CASE WHEN c_acctbal > 9500 THEN NULL ELSE CAST(c_custkey % 5 + 1 AS INT) END AS bedrooms,
       CAST(c_custkey % 3 + 1 AS INT) AS bathrooms,
       CASE c_custkey % 7 WHEN 0 THEN 'for_sale' WHEN 1 THEN 'not_listed' END AS listing_status,
       CASE WHEN c_custkey % 7 = 0 THEN CAST(floor(abs(c_acctbal) * 50) AS BIGINT) END AS listing_price,
       CASE WHEN c_custkey % 7 = 0 THEN 'Guide price' END AS listing_price_display,
       CASE WHEN c_custkey % 7 = 0 THEN concat('/properties/', CAST(c_custkey AS STRING)) END AS listing_url,
       CASE WHEN c_custkey % 7 < 2 THEN CAST(DATE '2024-01-01' + CAST(c_custkey % 30 AS INT) AS TIMESTAMP) END
         AS listing_checked_at,
       CAST(50 AS DOUBLE) + CAST(c_custkey * 7919 % 8000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS latitude,
       CAST(-5 AS DOUBLE) + CAST(c_custkey * 104729 % 6000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS longitude,
       {FEATURES_JSON} AS extra_features,
       CAST(DATE '2023-01-01' + CAST(c_custkey % 700 AS INT) AS TIMESTAMP) AS created_at,
       CASE WHEN c_custkey % 10 > 0
            THEN CAST(DATE '2023-06-01' + CAST(c_custkey % 500 AS INT) AS TIMESTAMP) END AS updated_at
FROM ({PLACE}) AS place
""",
    "sale": """
SELECT o_orderkey AS id, o_custkey AS property_id,
       CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '4-NOT SPECIFIED' THEN NULL
            ELSE CAST(floor(o_totalprice) AS BIGINT) END AS price_numeric,
       CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '5-LOW' THEN NULL
            ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS date_sold_iso,
       CASE o_orderstatus WHEN 'F' THEN 'FREEHOLD' WHEN 'O' THEN 'LEASEHOLD' END AS tenure,
       CASE o_orderpriority WHEN '1-URGENT' THEN ' Terraced' WHEN '2-HIGH' THEN 'flat' WHEN '3-MEDIUM' THEN ''
         WHEN '5-LOW' THEN CASE WHEN o_orderstatus = 'F' THEN '  ' END END AS property_type,
       o_orderdate, o_totalprice, o_orderstatus
FROM {orders}
""",
    "poi": """
SELECT p_partkey AS id,
       CASE p_partkey % 11
         WHEN 0 THEN 'rail' WHEN 1 THEN 'tube' WHEN 2 THEN 'bus' WHEN 3 THEN 'school' WHEN 4 THEN 'school'
         WHEN 5 THEN 'gp' WHEN 6 THEN 'hospital' WHEN 7 THEN 'supermarket' WHEN 8 THEN 'green_space'
         WHEN 9 THEN 'pub' ELSE 'gym' END AS kind,
       CASE p_partkey % 11
         WHEN 3 THEN 'primary' WHEN 4 THEN 'secondary'
         WHEN 8 THEN CASE WHEN p_size % 2 = 0 THEN 'Public Park Or Garden' ELSE 'Play Space' END END AS subtype,
       concat(p_name, ' ', CAST(p_partkey AS STRING)) AS name,
       CASE WHEN p_size > 35 THEN 'Waitrose' WHEN p_size > 15 THEN 'Tesco Express' ELSE 'Aldi' END AS brand,
       CASE WHEN p_size > 30 THEN 'Outstanding' ELSE 'Good' END AS rating,
       CAST(50 AS DOUBLE) + CAST(p_partkey * 104729 % 8000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS lat,
       CAST(-5 AS DOUBLE) + CAST(p_partkey * 7919 % 6000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS lon
FROM {part}
""",
    "crime_record": f"""
SELECT concat({OUTCODE}, ' ', CAST(l_suppkey % 9 + 1 AS STRING), 'AB') AS postcode,
       left(CAST(CAST(l_shipdate AS DATE) AS STRING), 7) AS month,
       CASE concat(l_returnflag, l_linestatus)
         WHEN 'AF' THEN 'burglary' WHEN 'AO' THEN 'drugs' WHEN 'NF' THEN 'robbery'
         WHEN 'NO' THEN 'vehicle-crime' WHEN 'RF' THEN 'anti-social-behaviour' ELSE 'shoplifting' END
         AS category
FROM {{lineitem}} JOIN {{supplier}} ON l_suppkey = s_suppkey
     JOIN {{nation}} ON s_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey
""",
}

MONTH_NAME = """CASE month(o_orderdate) WHEN 1 THEN 'Jan' WHEN 2 THEN 'February' WHEN 3 THEN 'Mar'
  WHEN 4 THEN 'Apr' WHEN 5 THEN 'May' WHEN 6 THEN 'June' WHEN 7 THEN 'Jul' WHEN 8 THEN 'Aug'
  WHEN 9 THEN 'Sept' WHEN 10 THEN 'Oct' WHEN 11 THEN 'Nov' ELSE 'Dec' END"""

VIEWS.update({
    # Sale history as it is scraped: price and date are text.
    "raw_sale": f"""
SELECT o_orderkey AS id, o_custkey AS property_id,
       concat(CASE WHEN day(o_orderdate) < 10 AND o_orderkey % 2 = 0 THEN '0' ELSE '' END,
              CAST(day(o_orderdate) AS STRING), ' ', {MONTH_NAME}, ' ',
              CAST(year(o_orderdate) AS STRING)) AS date_sold,
       CASE o_orderkey % 4
         WHEN 0 THEN concat('£', CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS STRING), ',',
                            lpad(CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS STRING), 3, '0'))
         WHEN 1 THEN concat('Â£', CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING))
         WHEN 2 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING)
         ELSE CASE o_orderpriority WHEN '5-LOW' THEN 'POA'
              ELSE concat('Guide price £', CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING)) END END AS price,
       o_orderstatus, o_orderpriority
FROM {{orders}}
""",
    # Scraped records: repeats of stored addresses and new ones.
    "record": f"""
SELECT o_orderkey AS seq, o_orderdate AS ingested_at,
       CASE WHEN o_orderpriority = '1-URGENT' THEN concat('Plot ', CAST(o_orderkey AS STRING), ', Mill Lane, ', p.postcode)
            ELSE p.address END AS address,
       CASE WHEN o_orderpriority = '2-HIGH' THEN '' ELSE p.postcode END AS postcode,
       CASE o_orderstatus WHEN 'F' THEN 'flat' WHEN 'O' THEN '' END AS property_type,
       CASE WHEN o_orderpriority = '3-MEDIUM' THEN NULL ELSE CAST(o_orderkey % 6 AS INT) END AS bedrooms,
       CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderkey % 4 AS INT) END AS bathrooms,
       concat('/house/', CAST(o_orderkey AS STRING)) AS url,
       CASE WHEN o_orderstatus = 'P' THEN CAST(floor(o_totalprice) AS BIGINT) END AS asking_price,
       'Offers over' AS asking_price_display,
       concat(CASE WHEN o_orderkey % 3 = 0 THEN '0' ELSE '' END, CAST(o_orderkey % 9 + 1 AS STRING), ' Nov ', CAST(year(o_orderdate) AS STRING)) AS date_sold,
       concat('£', CAST(CAST(floor(o_totalprice / 50000) AS BIGINT) + 1 AS STRING), ',500') AS price,
       CASE o_orderstatus WHEN 'F' THEN 'Flat' ELSE 'House' END AS sale_type, lower('FREEHOLD') AS tenure
FROM {{orders}} JOIN ({VIEWS["property"]}) AS p ON o_custkey = p.id
""",
    "postcode_lookup": f"""
SELECT DISTINCT lower(postcode) AS postcode, concat('E', outcode) AS lsoa,
       CAST(51 AS DOUBLE) AS lat, CAST(-1 AS DOUBLE) AS lng
FROM ({PLACE}) AS place
""",
    "imd": f"""
SELECT concat('E', {OUTCODE}) AS lsoa,
       CAST(n_nationkey % 10 + 1 AS INT) AS imd_decile, CAST(n_nationkey % 9 + 1 AS INT) AS imd_income_decile,
       CAST(n_nationkey % 8 + 1 AS INT) AS imd_employment_decile,
       CAST(n_nationkey % 7 + 1 AS INT) AS imd_education_decile,
       CAST(n_nationkey % 6 + 1 AS INT) AS imd_health_decile, CAST(n_nationkey % 5 + 1 AS INT) AS imd_crime_decile,
       CAST(n_nationkey % 4 + 1 AS INT) AS imd_housing_decile,
       CAST(n_nationkey % 3 + 1 AS INT) AS imd_environment_decile
FROM {{nation}} JOIN {{region}} ON n_regionkey = r_regionkey
UNION ALL
SELECT concat('E', {OUTCODE}), 1, 9, 9, 9, 9, 9, 9, 9 FROM {{nation}} JOIN {{region}} ON n_regionkey = r_regionkey WHERE n_nationkey % 3 = 0
""",
    "broadband": f"""
SELECT replace(postcode, ' ', '-') AS postcode, CAST(max(c_custkey) % 900 AS DOUBLE) AS broadband_median_speed,
       CAST(max(c_custkey) % 100 AS DOUBLE) AS broadband_superfast_pct,
       CAST(max(c_custkey) % 90 AS DOUBLE) AS broadband_ultrafast_pct,
       CAST(max(c_custkey) % 80 AS DOUBLE) AS broadband_full_fibre_pct
FROM ({PLACE}) AS place GROUP BY postcode
UNION ALL
SELECT replace(postcode, ' ', '-'), CAST(10 AS DOUBLE), CAST(100 AS DOUBLE), CAST(100 AS DOUBLE), CAST(100 AS DOUBLE)
FROM ({PLACE}) AS place GROUP BY postcode HAVING max(c_custkey) % 2 = 0
""",
    # Energy certificates: some with the exact address, some with its start, some unrelated.
    "epc_cert": f"""
SELECT o_orderkey AS seq, p.postcode,
       CASE o_orderpriority
         WHEN '1-URGENT' THEN lower(p.address)
         WHEN '2-HIGH' THEN concat(split_part(replace(p.address, ',', ' '), ' ', 1), ', ', 'Mill House')
         WHEN '3-MEDIUM' THEN concat(p.address, ', Annexe')
         WHEN '4-NOT SPECIFIED' THEN concat(CAST(o_orderkey % 40 AS STRING), ' Coombe   Lane')
         ELSE replace(p.address, ',', '') END AS address,
       CASE o_orderstatus WHEN 'F' THEN 'C' WHEN 'O' THEN 'D' ELSE '' END AS epc_rating,
       CAST(o_orderkey % 100 AS INT) AS epc_score, CAST(o_orderkey % 90 AS INT) AS environment_impact,
       CAST(o_orderkey % 2000 AS INT) AS estimated_energy_cost
FROM {{orders}} JOIN ({VIEWS["property"]}) AS p ON o_custkey = p.id
""",
    "planning_entity": """
SELECT concat('AF', CAST(p_partkey % 25 AS STRING), ' ', CAST(p_size % 9 + 1 AS STRING), 'AB') AS postcode,
       CAST(p_partkey AS STRING) AS entity,
       CASE p_partkey % 12 WHEN 0 THEN '' WHEN 1 THEN NULL
         ELSE concat('24/', CAST(p_partkey AS STRING), CASE p_partkey % 12
           WHEN 2 THEN '/FUL' WHEN 3 THEN '/out' WHEN 4 THEN '/HSE' WHEN 5 THEN '/LBC' WHEN 6 THEN '/TPO'
           WHEN 7 THEN '/ADV' WHEN 8 THEN '/COU' WHEN 9 THEN '/HOUSEHOLDER' ELSE '/PIP' END) END AS reference,
       CASE p_type WHEN 'ECONOMY' THEN concat('Conversion to ', CAST(p_size AS STRING), ' flats')
         WHEN 'SMALL' THEN 'Single storey rear extension' WHEN 'LARGE' THEN 'Demolition of barn'
         WHEN 'PROMO' THEN concat('Site for ', CAST(p_size AS STRING), '  Units and 3 houses')
         WHEN 'MEDIUM' THEN NULL ELSE concat('Loft at ', p_name) END AS description,
       CASE WHEN p_size < 10 THEN '2024-02-01' WHEN p_size < 20 THEN '' END AS end_date,
       CASE WHEN p_size > 40 THEN '2024-03-01' WHEN p_size > 30 THEN '' END AS decision_date,
       CAST(DATE '2024-01-01' + CAST(p_size AS INT) AS TIMESTAMP) AS fetched_at
FROM {part}
""",
    # Property pages as they are landed, one for each property.
    "property_page": f"""
SELECT id AS page_id, concat('/house/', CAST(id AS STRING)) AS url,
       concat('<!DOCTYPE html><html><head><title>x</title><script>var h = "<h1>no</h1>";</script></head><body>',
         CASE WHEN id % 10 = 9 THEN '' ELSE concat('<h1> ', address, ' </h1>') END,
         '<table><tr><th>Date</th><th>Change</th><th>Price</th><th>Property</th><th>Tenure</th></tr><tr><td>',
         CAST(id % 28 + 1 AS STRING), ' Nov 2019</td><td>+', CAST(id % 5 AS STRING), '%</td><td>&pound;', CAST(id AS STRING),
         ',000</td><td>Flat</td><td>Leasehold</td></tr>',
         CASE WHEN id % 2 = 0 THEN concat('<tr><td>1 Jan 2010</td><td></td><td>£', CAST(id AS STRING), '</td><td>Freehold</td></tr>') ELSE '' END,
         '<tr><td>x</td></tr></table><table><tr><td>a</td><td>b</td><td>c</td></tr></table>',
         '<div><h2>Key Features</h2><p>text</p><ul><li>Garage</li><li> </li><li>', CAST(id AS STRING), ' sq ft</li></ul></div><ul><li>menu</li></ul>',
         '<dl><dt>Bedrooms</dt><dd>', CAST(id % 6 AS STRING), ' beds</dd><dt>Bathrooms</dt><dd>',
         CASE WHEN id % 3 = 0 THEN 'two' ELSE CAST(id % 3 AS STRING) END, '</dd><dt>Type</dt><dd>Terraced</dd></dl>',
         '<img src="/fp', CAST(id AS STRING), '.png" alt="Floorplan"><a href="/floorplan.JPG">see</a>',
         CASE WHEN id % 4 = 0 THEN concat('<img src="/fp', CAST(id AS STRING), '.png" class="big floorplan">') ELSE '' END, '</body></html>') AS html
FROM ({VIEWS["property"]}) AS p
""",
    "flood_area": """
SELECT concat('AF', CAST(s_suppkey % 25 AS STRING), ' ', CAST(s_nationkey % 9 + 1 AS STRING), 'AB') AS postcode,
       CASE WHEN s_acctbal < 1000 THEN 'TZone3A' WHEN s_acctbal < 3000 THEN 'xzone2' ELSE s_name END AS notation
FROM {supplier}
""",
    "flood_warning": """
SELECT concat('AF', CAST(s_nationkey AS STRING), ' ', CAST(s_suppkey % 9 + 1 AS STRING), 'AB') AS postcode,
       s_suppkey AS position,
       CASE WHEN s_acctbal < 1000 THEN '1' WHEN s_acctbal < 2000 THEN 'Severe' ELSE '3' END AS severity
FROM {supplier}
""",
    "listing_page": """
SELECT c_custkey AS property_id, CASE WHEN c_nationkey % 3 = 0 THEN 'RES_LET' ELSE 'RES_BUY' END AS channel,
       CASE c_custkey % 4 WHEN 0 THEN NULL ELSE c_custkey % 4 < 3 END AS published,
       CASE WHEN c_acctbal < 0 THEN c_acctbal < -500 WHEN c_acctbal > 9000 THEN NULL ELSE FALSE END AS archived,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'Added on 03/02/2026' WHEN 'MACHINERY' THEN 'Reduced' END AS update_reason,
       '2025-12-01' AS advertised_from, c_custkey AS listing_id,
       CASE c_mktsegment WHEN 'FURNITURE' THEN concat('A house for Guide price £', CAST(c_custkey AS STRING), ',000. Marketed')
         WHEN 'BUILDING' THEN 'for sale soon' END AS description,
       concat('3 bed house, Offers Over £', CAST(c_custkey AS STRING), ',500 in ', c_name) AS title
FROM {customer}
""",
})

ORDERS_AND_PLACES = ("orders", "customer", "nation", "region")
PLACES = ("customer", "nation", "region")

SOURCES = {
    "property": ("customer", "nation", "region"),
    "sale": ("orders",),
    "poi": ("part",),
    "crime_record": ("lineitem", "supplier", "nation", "region"),
    "raw_sale": ("orders",),
    "record": ORDERS_AND_PLACES,
    "postcode_lookup": PLACES,
    "imd": ("nation", "region"),
    "broadband": PLACES,
    "epc_cert": ORDERS_AND_PLACES,
    "planning_entity": ("part",),
    "property_page": PLACES,
    "flood_area": ("supplier",),
    "flood_warning": ("supplier",),
    "listing_page": ("customer",),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    frames = {t: table(spark, sf_dir, t) for t in SOURCES[name]}
    return spark.sql(VIEWS[name], **frames)


def view_sql(name: str) -> str:
    """The same view for the checking database, where tables go by their names."""
    return VIEWS[name].format(**{t: t for t in SOURCES[name]})


def with_views(query: str, *names: str) -> str:
    """A query over the named views, written out as common table expressions."""
    ctes = ",\n".join(f"{n} AS ({view_sql(n)})" for n in names)
    head = query.lstrip()
    if head.upper().startswith("WITH "):
        return f"WITH {ctes},\n{head[5:]}"
    return f"WITH {ctes}\n{query}"
