"""SQL for the feature, spatial, lookup, record, upsert and dataset queries."""

from __future__ import annotations

from contract import phrases
from contract.oracle import BASE, ORACLE, STREET, on_base, on_views
from contract.views import with_views
from plotwise.functions import geo
from plotwise.functions.features import FEATURE_COLUMNS
from plotwise.operators import spatial, text_reports
from plotwise.operators.area_records import (
    CRIME_CATEGORIES, CRIME_COLUMNS, MAJOR_KEYWORDS, PLANNING_CODES,
)
from plotwise.operators.lookups import BROADBAND_COLUMNS, IMD_COLUMNS


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# --- listing features --------------------------------------------------------
# Yes/no columns and labels are stated phrase by phrase; the others are written over a
# list of phrases, where the library searches joined text.

PHRASES = """
feats AS (
  SELECT id, CASE WHEN json_valid(extra_features) AND json_type(extra_features) = 'ARRAY'
    THEN list_filter(list_transform(CAST(CAST(extra_features AS JSON) AS VARCHAR[]), lambda x: trim(x)),
                     lambda x: x <> '')
    ELSE [] END AS f
  FROM property)
"""


def _any(condition: str) -> str:
    return f"CASE WHEN len(list_filter(f, lambda x: {condition})) > 0 THEN TRUE END"


def _search(pattern: str, value: str = "x") -> str:
    return f"regexp_matches({value}, {q(pattern)}, 'i')"


def _first(expression: str) -> str:
    return f"list_filter(list_transform(f, lambda x: {expression}), lambda v: v IS NOT NULL)[1]"


def _extract(pattern: str, value: str = "x") -> str:
    return f"nullif(regexp_extract({value}, {q(pattern)}, 1, 'i'), '')"


_WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")


def _word_number(value: str) -> str:
    cases = " ".join(f"WHEN {q(w)} THEN {i + 1}" for i, w in enumerate(_WORDS))
    return f"CASE {value} {cases} ELSE TRY_CAST({value} AS INT) END"


SPECIAL = {
    "chain_free": _first(
        "CASE WHEN " + _search("no onward chain|chain free|no chain|no forward chain|chain-free")
        + " THEN TRUE WHEN contains(lower(x), 'end of chain') THEN FALSE END"),
    "garden": _first("""CASE WHEN contains(lower(x), 'balcony') THEN 'Balcony'
      WHEN contains(lower(x), 'terrace') AND split_part(lower(x), ' ', 1) <> 'terrace' AND (contains(lower(x), 'roof')
        OR contains(lower(x), 'communal') OR contains(lower(x), 'private') OR ends_with(lower(x), 'terrace')) THEN 'Terrace'
      WHEN contains(lower(x), 'communal') AND contains(lower(x), 'garden') THEN 'Communal Garden'
      WHEN contains(lower(x), 'private') AND contains(lower(x), 'garden') THEN 'Private Garden'
      WHEN contains(lower(x), 'patio') THEN 'Patio' WHEN contains(lower(x), 'garden') THEN 'Garden' END"""),
    "heating": _first("""CASE WHEN contains(lower(x), 'underfloor') OR contains(lower(x), 'under floor') THEN 'Underfloor'
      WHEN contains(lower(x), 'gas') AND (contains(lower(x), 'central') OR contains(lower(x), 'heating')) THEN 'Gas Central'
      WHEN contains(lower(x), 'central heating') THEN 'Central Heating'
      WHEN contains(lower(x), 'electric') AND contains(lower(x), 'heating') THEN 'Electric'
      WHEN contains(lower(x), 'heating') THEN 'Other' END"""),
    "furnished": _first("""CASE WHEN contains(lower(x), 'part furnished') OR contains(lower(x), 'part-furnished')
      THEN 'Part Furnished' WHEN rtrim(lower(x), '.') = 'unfurnished' THEN 'Unfurnished'
      WHEN rtrim(lower(x), '.') = 'furnished' THEN 'Furnished'
      WHEN contains(lower(x), 'unfurnished') AND contains(replace(lower(x), 'unfurnished', ''), 'furnished')
      THEN 'Flexible' END"""),
    "epc_rating": f"upper({_first(_extract(r'(?:epc|energy)[^a-z].*\b([A-G])\b|(?:epc|energy)$'))})",
    "council_tax_band": f"upper({_first(_extract(r'council\s*tax.*?band\s*[-:.]?\s*([A-H])\b'))})",
    "receptions": _first(
        "CASE WHEN " + _search(r"^(\d+|one|two|three|four|five)\s*reception") + " THEN "
        + _word_number(f"lower({_extract(r'^(\d+|one|two|three|four|five)\s*reception')})")
        + " WHEN contains(lower(x), 'reception room') THEN "
        + _word_number(f"lower({_extract(r'(\d+|one|two|three|four|five|six|seven|eight|nine|ten)')})") + " END"),
    "sq_ft": "coalesce(" + _first(f"TRY_CAST(replace({_extract(r'([\d,]+)\s*sq\s*\.?\s*ft')}, ',', '') AS INT)")
             + ", CAST(round_even(" + _first(
                 f"TRY_CAST(replace({_extract(r'([\d,]+(?:\.\d+)?)\s*sq\s*\.?\s*m\b')}, ',', '') AS DOUBLE)")
             + " * 10.764, 0) AS INT))",
    "service_charge": "CAST(floor(" + _first(
        f"TRY_CAST(replace({_extract(r'service\s*(?:charge|/maintenance).*?[£$]([\d,]+(?:\.\d+)?)')}, ',', '') AS DOUBLE)")
        + ") AS INT)",
    "ground_rent": "CAST(floor(" + _first(
        f"TRY_CAST(replace({_extract(r'ground\s*rent.*?[£$]([\d,]+(?:\.\d+)?)')}, ',', '') AS DOUBLE)") + ") AS INT)",
    "distance_to_station": _first(
        f"CASE WHEN {_search('station')} THEN TRY_CAST(rtrim({_extract(r'([\d.]+)\s*mile')}, '.') AS DOUBLE) END"),
    "acre_plot": _first(f"coalesce(TRY_CAST({_extract(r'(\d+\.?\d*)\s*acre')} AS DOUBLE), "
                        f"CASE WHEN {_search(r'\bacreage\b')} THEN 1.0 END)"),
}
# Lease: the last share of freehold wins; otherwise the first tenure phrase does.
_SHARE = "contains(lower(x), 'share of freehold')"
_LEASES = "contains(lower(x), 'lease')"
SPECIAL["lease_type"] = f"""coalesce(
  CASE WHEN len(list_filter(f, lambda x: {_SHARE})) > 0 THEN 'Share of Freehold' END,
  {_first("CASE WHEN contains(lower(x), 'freehold') THEN 'Freehold' WHEN contains(lower(x), 'lease') THEN 'Leasehold' END")})"""
SPECIAL["lease_years"] = f"""coalesce(
  {_first(f"CASE WHEN {_LEASES} AND NOT contains(lower(x), 'freehold') THEN TRY_CAST({_extract(r'(\d+)\s*year')} AS INT) END")},
  {_first(f"TRY_CAST({_extract(r'(\d+)\s*year\s*lease')} AS INT)")})"""
SPECIAL["epc_rating"] = f"upper({_first(_extract(r'(?:epc|energy)\b.*\b([A-G])\b'))})"


def _feature_sql(name: str) -> str:
    if name in SPECIAL:
        return SPECIAL[name]
    if name in phrases.LABELLED:
        return _first("CASE x " + " ".join(f"WHEN {q(p)} THEN {q(label)}" for p, label in phrases.labels(name).items()) + " END")
    return f"CASE WHEN list_has_any(f, [{', '.join(map(q, phrases.setting(name)))}]) THEN TRUE END"


PARSED = PHRASES + ", parsed AS MATERIALIZED (SELECT id, " + ",\n".join(
    f"{_feature_sql(c)} AS {c}" for c in FEATURE_COLUMNS
) + " FROM feats)"
on_views("feature_flags", f"WITH {PARSED} SELECT * FROM parsed", "property")

_FILLED = ", ".join(f"count({c}) AS {c}" for c in FEATURE_COLUMNS)
RATES = f"""{PARSED}, rates AS (
  SELECT feature, filled, total, round_even(filled / total * 100, 1) AS pct
  FROM (UNPIVOT (SELECT count(*) AS total, {_FILLED} FROM parsed)
        ON {', '.join(FEATURE_COLUMNS)} INTO NAME feature VALUE filled))"""
on_views("fill_rates", f"WITH {RATES} SELECT * FROM rates", "property")
on_views("fill_totals", f"""WITH {RATES}
SELECT version, CAST(sum(filled) AS BIGINT) AS filled,
       round_even(sum(filled) / (SELECT sum(filled) FROM rates) * 100, 1) AS pct
FROM (SELECT CASE WHEN feature IN ({', '.join(q(c) for c in FEATURE_COLUMNS[41:64])}) THEN 'v2'
             WHEN feature IN ({', '.join(q(c) for c in FEATURE_COLUMNS[64:])}) THEN 'v3' ELSE 'v1' END AS version, filled
      FROM rates) GROUP BY version""", "property")
on_views("value_distribution", f"""WITH {PARSED}
SELECT feature, value, count, rank FROM (
  SELECT feature, value, count(*) AS count,
         CAST(row_number() OVER (PARTITION BY feature ORDER BY count(*) DESC, value) AS INT) AS rank
  FROM (UNPIVOT (SELECT {', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in FEATURE_COLUMNS)} FROM parsed)
        ON {', '.join(FEATURE_COLUMNS)} INTO NAME feature VALUE value)
  GROUP BY feature, value) WHERE rank <= 10""", "property")

LINES = """lines AS (
  SELECT phrase, count(*) AS n FROM (
    SELECT trim(unnest(string_split(text, chr(10))), ' ') AS phrase FROM documents) WHERE phrase <> '' GROUP BY phrase)"""
_CAUGHT = " OR ".join(_search(p, "phrase") for p in text_reports.CAUGHT_PATTERNS)
_CATEGORY = "CASE " + " ".join(
    f"WHEN {_search(p, 'phrase')} THEN {q(name)}" for name, p in text_reports.CATEGORY_RULES) + " ELSE 'other' END"
ORACLE["uncaught_phrases"] = f"WITH {LINES} SELECT phrase, n AS count FROM lines WHERE NOT ({_CAUGHT}) AND n >= 3"
ORACLE["caught_totals"] = f"""WITH {LINES}, judged AS (SELECT n, ({_CAUGHT}) AS c FROM lines)
SELECT CAST(sum(n) AS BIGINT) AS mentions, CAST(coalesce(sum(n) FILTER (c), 0) AS BIGINT) AS caught,
       CAST(coalesce(sum(n) FILTER (NOT c), 0) AS BIGINT) AS uncaught,
       round_even(coalesce(sum(n) FILTER (NOT c), 0) * 100.0 / sum(n), 1) AS uncaught_pct,
       count(*) FILTER (NOT c) AS uncaught_unique FROM judged"""
ORACLE["category_totals"] = f"""WITH {LINES}
SELECT {_CATEGORY} AS category, count(*) AS unique_phrases, CAST(sum(n) AS BIGINT) AS mentions FROM lines GROUP BY 1"""
ORACLE["category_top_phrases"] = f"""WITH {LINES}
SELECT phrase, n AS count, category, rank FROM (
  SELECT phrase, n, category, CAST(row_number() OVER (PARTITION BY category ORDER BY n DESC, phrase) AS INT) AS rank
  FROM (SELECT *, {_CATEGORY} AS category FROM lines)) WHERE rank <= 10"""

_KPIS = ORACLE["kpis_filtered"]
on_base("kpis_with_features", _KPIS[_KPIS.index("SELECT round_even((l - f)"):], "," + PARSED + """, picked AS (
  SELECT b.* FROM base b JOIN parsed p ON b.property_id = p.id
  WHERE p.parking IS NOT NULL AND coalesce(p.chain_free, FALSE) = FALSE)""")

# --- cleaning ----------------------------------------------------------------

_DIGITS = r"nullif(regexp_extract(replace(replace(replace(price, '£', ''), 'Â', ''), ',', ''), '(\d+)', 1), '')"
_ISO = """strftime(try_strptime(concat(regexp_extract(date_sold, '^(\\d+)', 1), ' ',
  left(regexp_extract(date_sold, '([A-Za-z]+)', 1), 3), ' ', right(date_sold, 4)), '%d %b %Y'), '%Y-%m-%d')"""
on_views("clean_sales", f"""
SELECT id, CAST({_DIGITS} AS BIGINT) AS price_numeric,
       coalesce('£' || format('{{:,}}', CAST({_DIGITS} AS BIGINT)), price) AS price,
       ltrim(date_sold, '0') AS date_sold, {_ISO} AS date_sold_iso FROM raw_sale""", "raw_sale")
on_views("postcode_forms", """
SELECT id, replace(postcode, ' ', '') AS key, postcode AS found, split_part(postcode, ' ', 1) AS outcode,
       split_part(postcode, ' ', 1) AS outcode_pattern, split_part(postcode, ' ', 1) AS outcode_separator,
       postcode AS spaced FROM property""", "property")
on_views("streets", f"WITH {STREET.split('sbase AS')[0].rstrip().rstrip(',')} SELECT id, street FROM street", "property")
on_views("backfill_sales", f"""
SELECT id, coalesce(s.price_numeric, CAST({_DIGITS} AS BIGINT)) AS price_numeric,
       coalesce(s.date_sold_iso, {_ISO}) AS date_sold_iso
FROM raw_sale r JOIN sale s USING (id)""", "raw_sale", "sale")

# --- points of interest: every pair compared ---------------------------------

_FIXED = ", ".join(
    f"({-(i + 1)}, {q(kind)}, {q(name)}, CAST({lat} AS DOUBLE), CAST({lon} AS DOUBLE))"
    for i, (kind, name, lat, lon) in enumerate(
        [("airport", *a) for a in spatial.AIRPORTS] + [("port", *p) for p in spatial.PORTS]))
TAGGED = f"""
tagged AS (
  SELECT id AS poi_id, CASE WHEN kind = 'school' THEN subtype ELSE kind END AS target, name,
         CASE kind WHEN 'school' THEN rating WHEN 'supermarket' THEN brand END AS detail, lat, lon FROM poi
  UNION ALL SELECT id, 'outstanding_' || subtype, name, rating, lat, lon FROM poi
            WHERE kind = 'school' AND rating = 'Outstanding'
  UNION ALL SELECT id, CASE brand WHEN 'Waitrose' THEN 'premium_supermarket' ELSE 'budget_supermarket' END,
            name, brand, lat, lon FROM poi WHERE kind = 'supermarket' AND brand IN ('Waitrose', 'Aldi')
  UNION ALL SELECT id, 'park', name, NULL, lat, lon FROM poi
            WHERE kind = 'green_space' AND lower(subtype) = 'public park or garden'
  UNION ALL SELECT id, kind, name, NULL, lat, lon FROM (VALUES {_FIXED}) fixed(id, kind, name, lat, lon))
"""
_ARC = """2 * 6371.0 * asin(sqrt(pow(sin(radians(t.lat - p.latitude) / 2), 2)
  + cos(radians(p.latitude)) * cos(radians(t.lat)) * pow(sin(radians(t.lon - p.longitude) / 2), 2)))"""
_CHORD = f"2 * 6371.0 * sin(({_ARC}) / 2 / 6371.0)"
on_views("nearest_poi", f"""WITH {TAGGED}
SELECT id, target, arg_min(poi_id, (round(km, 9), poi_id)) AS poi_id, round(min(km), 2) AS km
FROM (SELECT p.id, t.target, t.poi_id, {_ARC} AS km FROM property p, tagged t) GROUP BY id, target""",
         "property", "poi")
_RADII = {"bus": 15.0, "primary": 10.0, "secondary": 15.0, "gp": 10.0, "supermarket": 20.0,
          "green_space": 25.0, "pub": 25.0, "gym": 20.0}
_RADIUS = "CASE t.target " + " ".join(f"WHEN {q(t)} THEN {r}" for t, r in _RADII.items()) + " END"
on_views("within_radius", f"""WITH {TAGGED}
SELECT p.id, t.target, count(*) AS n FROM property p, tagged t
WHERE {_CHORD} <= {_RADIUS} GROUP BY p.id, t.target""", "property", "poi")
_WIDE = []
for tag, target in spatial.TARGETS.items():
    measure = "arc" if target.great_circle else "chord"
    _WIDE.append(f"round_even(min({measure}) FILTER (target = {q(tag)}), 2) AS {target.distance}")
    if target.name:
        _WIDE.append(f"arg_min(name, (round(arc, 9), poi_id)) FILTER (target = {q(tag)}) AS {target.name}")
    if target.detail:
        _WIDE.append(f"arg_min(detail, (round(arc, 9), poi_id)) FILTER (target = {q(tag)}) AS {target.detail}")
    if target.within:
        _WIDE.append(f"CAST(count(*) FILTER (target = {q(tag)} AND chord <= {target.within[1]}) AS INT) AS {target.within[0]}")
on_views("proximity", f"""WITH {TAGGED}
SELECT id, {', '.join(_WIDE)}
FROM (SELECT *, 2 * 6371.0 * sin(arc / 2 / 6371.0) AS chord
      FROM (SELECT p.id, t.target, t.poi_id, t.name, t.detail, {_ARC} AS arc FROM property p, tagged t))
GROUP BY id""", "property", "poi")

# --- lookups -----------------------------------------------------------------

on_views("imd_lookup", f"""SELECT p.id, {', '.join(f'i.{c}' for c in IMD_COLUMNS)}
FROM property p LEFT JOIN postcode_lookup l ON lower(p.postcode) = l.postcode
LEFT JOIN (SELECT lsoa, unnest(min(struct_pack({', '.join(f'{c} := {c}' for c in IMD_COLUMNS)}))) FROM imd GROUP BY lsoa) i USING (lsoa)""",
         "property", "postcode_lookup", "imd")
on_views("broadband_lookup", f"""SELECT p.id, {', '.join(f'b.{c}' for c in BROADBAND_COLUMNS)}
FROM property p LEFT JOIN (
  SELECT postcode, unnest(min(struct_pack({', '.join(f'{c} := {c}' for c in BROADBAND_COLUMNS)}))) FROM broadband GROUP BY postcode) b
ON replace(p.postcode, ' ', '-') = b.postcode""", "property", "broadband")
on_views("geocode", """
SELECT id, CASE WHEN property_type <> 'BUILDING' THEN latitude ELSE 51.0 END AS latitude,
       CASE WHEN property_type <> 'BUILDING' THEN longitude ELSE -1.0 END AS longitude FROM property""", "property")

_NORM = r"trim(regexp_replace(regexp_replace(upper({0}), ',+', ' ', 'g'), '\s+', ' ', 'g'))"
on_views("epc_match", f"""WITH p AS (SELECT *, {_NORM.format('address')} AS n FROM property),
c AS (SELECT *, {_NORM.format('address')} AS n FROM epc_cert),
matched AS (
  SELECT p.id, arg_min(struct_pack(r := c.epc_rating, s := c.epc_score, e := c.environment_impact,
                                   k := c.estimated_energy_cost),
                       (CASE WHEN upper(p.address) = upper(c.address) THEN 0 ELSE 1 END, c.seq)) AS m
  FROM p JOIN c ON p.postcode = c.postcode AND (upper(p.address) = upper(c.address)
    OR (split_part(p.n, ' ', 1) = split_part(c.n, ' ', 1) AND split_part(p.n, ' ', 2) = split_part(c.n, ' ', 2)))
  GROUP BY p.id)
SELECT id AS property_id, m.r AS epc_rating, m.s AS epc_score, m.e AS epc_environment_impact,
       m.k AS estimated_energy_cost FROM matched WHERE m.r <> ''""", "property", "epc_cert")
on_views("epc_match_by_containment", r"""
SELECT c.seq, min(p.id) AS property_id
FROM (SELECT *, upper(address) AS a, regexp_extract(upper(address), '^(\d+)\s*(\S+)', 1) AS n,
             regexp_extract(upper(address), '^(\d+)\s*(\S+)', 2) AS w FROM epc_cert) c
JOIN (SELECT *, upper(address) AS a, regexp_extract(upper(address), '^(\d+)\s*(\S+)', 1) AS n,
             regexp_extract(upper(address), '^(\d+)\s*(\S+)', 2) AS w FROM property) p
  ON c.postcode = p.postcode AND (contains(c.a, p.a) OR contains(p.a, c.a) OR (c.n <> '' AND c.n = p.n AND c.w = p.w))
GROUP BY c.seq""", "property", "epc_cert")

on_views("similar_properties", """WITH latest AS (
  SELECT property_id, arg_max(price_numeric, (date_sold_iso, id)) AS price FROM sale
  WHERE price_numeric IS NOT NULL AND date_sold_iso IS NOT NULL GROUP BY property_id),
c AS (SELECT p.id, p.outcode, upper(trim(p.property_type)) AS t, p.bedrooms AS b, l.price
      FROM property p JOIN latest l ON l.property_id = p.id)
SELECT property_id, rank, similar_id, price_gap FROM (
  SELECT x.id AS property_id, y.id AS similar_id, abs(x.price - y.price) AS price_gap,
         CAST(row_number() OVER (PARTITION BY x.id ORDER BY abs(x.price - y.price), y.id) AS INT) AS rank
  FROM c x JOIN c y ON x.outcode = y.outcode AND x.id <> y.id AND (x.t IS NULL OR x.t = y.t)
    AND (x.b IS NULL OR y.b BETWEEN x.b - 1 AND x.b + 1)) WHERE rank <= 5""", "property", "sale")

# --- crime, planning, flood, listings ----------------------------------------

CRIME = "crime AS (SELECT postcode, month, category, count(*) AS count FROM crime_record GROUP BY ALL)"
on_views("crime_counts", f"WITH {CRIME} SELECT * FROM crime", "crime_record")
on_views("crime_summary", f"""WITH {CRIME}
SELECT postcode, 'category' AS facet, category AS value, CAST(sum(count) AS BIGINT) AS count, NULL AS months_covered
FROM crime GROUP BY postcode, category
UNION ALL SELECT postcode, 'month', month, CAST(sum(count) AS BIGINT), NULL FROM crime GROUP BY postcode, month
UNION ALL SELECT postcode, 'total', NULL, CAST(sum(count) AS BIGINT), count(DISTINCT month) FROM crime GROUP BY postcode
""", "crime_record")


def _window(source: str, month: str) -> str:
    """Crime joined over the twelve months as a range of month numbers."""
    return f"""LEFT JOIN (SELECT postcode, CAST(left(month, 4) AS INT) * 12 + CAST(right(month, 2) AS INT) AS m, category, count
  FROM crime) c ON c.postcode = {source}.postcode AND c.m BETWEEN
  CAST(left({month}, 4) AS INT) * 12 + CAST(right({month}, 2) AS INT) - 11
  AND CAST(left({month}, 4) AS INT) * 12 + CAST(right({month}, 2) AS INT)"""


_CRIME_SUMS = ", ".join(
    f"CASE WHEN count(c.count) > 0 THEN CAST(coalesce(sum(c.count) FILTER (c.category = {q(cat)}), 0) AS BIGINT) END AS {col}"
    for cat, col in zip(CRIME_CATEGORIES, CRIME_COLUMNS))
ORACLE["crime_window"] = with_views(f"""WITH {BASE}, {CRIME}
SELECT sale_id, CAST(sum(c.count) AS BIGINT) AS total_crime, {_CRIME_SUMS}
FROM base {_window('base', 'base.month')} GROUP BY sale_id""", "property", "sale", "crime_record")

_TYPE = "CASE WHEN reference = '' THEN 'unknown' " + " ".join(
    "WHEN " + " OR ".join(f"contains(upper(reference), {q(c)})" for c in codes) + f" THEN {q(name)}"
    for name, codes in PLANNING_CODES) + " ELSE 'other' END"
_MAJOR = "(coalesce(TRY_CAST(nullif(regexp_extract(lower(description), " \
         r"'(\d+)\s*(dwelling|flat|apartment|house|unit)', 1), '') AS BIGINT) >= 10, FALSE) OR " \
         + " OR ".join(f"contains(lower(description), {q(w)})" for w in MAJOR_KEYWORDS) + ")"
PLANNING = f"""planning AS (
  SELECT postcode, reference, description,
         CASE WHEN nullif(end_date, '') IS NOT NULL OR nullif(decision_date, '') IS NOT NULL
              THEN 'decided' ELSE 'pending' END AS status,
         nullif(decision_date, '') AS decision_date, {_TYPE} AS application_type, {_MAJOR} AS is_major, fetched_at
  FROM (SELECT postcode, coalesce(nullif(reference, ''), entity) AS reference, coalesce(description, '') AS description,
               end_date, decision_date, fetched_at FROM planning_entity))"""
on_views("planning_records", f"WITH {PLANNING} SELECT * FROM planning", "planning_entity")
on_views("planning_totals", f"""WITH {PLANNING}
SELECT postcode, count(*) AS total_count, count(*) FILTER (is_major) AS major_count FROM planning GROUP BY postcode""",
         "planning_entity")
on_views("flood_risk", """
SELECT postcode, z AS flood_zone,
       CASE WHEN severe > 0 THEN 'high' WHEN z = 3 THEN 'medium' WHEN n > 0 THEN 'medium'
            WHEN z = 2 THEN 'low' ELSE 'very_low' END AS risk_level, n AS active_warnings
FROM (SELECT p.postcode, CAST(coalesce((SELECT CASE WHEN count(*) = 0 THEN 1
          WHEN bool_or(contains(lower(notation), 'zone3')) THEN 3 ELSE 2 END
        FROM flood_area a WHERE a.postcode = p.postcode), 1) AS INT) AS z,
        (SELECT count(*) FROM flood_warning w WHERE w.postcode = p.postcode) AS n,
        (SELECT count(*) FROM flood_warning w WHERE w.postcode = p.postcode AND severity IN ('1', 'Severe')) AS severe
      FROM (SELECT DISTINCT postcode FROM planning_entity) p)""", "planning_entity", "flood_area", "flood_warning")
on_views("listing_records", r"""WITH d AS (
  SELECT property_id, channel = 'RES_BUY' AND coalesce(published, FALSE) AND NOT coalesce(archived, TRUE) AS live,
         coalesce(nullif(regexp_extract(description, 'for (Guide [Pp]rice £[\d,]+)', 1), ''),
                  regexp_extract(title, 'Offers Over £[\d,]+', 0)) AS display,
         coalesce(nullif(regexp_extract(update_reason, '\d{{2}}/\d{{2}}/\d{{4}}', 0), ''), advertised_from) AS listed,
         listing_id FROM listing_page)
SELECT property_id, CASE WHEN live THEN 'for_sale' ELSE 'not_listed' END AS listing_status,
       CASE WHEN live THEN CAST(replace(split_part(display, '£', 2), ',', '') AS BIGINT) END AS listing_price,
       CASE WHEN live THEN display END AS listing_price_display, CASE WHEN live THEN listed END AS listing_date,
       CASE WHEN live THEN concat('/properties/', listing_id) END AS listing_url FROM d""".replace("{{", "{").replace("}}", "}"),
         "listing_page")
on_views("listing_totals", """
SELECT postcode, count(*) FILTER (listing_status = 'for_sale') AS properties_matched,
       count(*) FILTER (listing_status IS NULL OR listing_status = 'not_listed') AS properties_not_listed,
       bool_and(coalesce(listing_checked_at > TIMESTAMP '2024-01-19 12:00:00', FALSE)) AS all_fresh
FROM property GROUP BY postcode""", "property")

# --- coverage and freshness --------------------------------------------------

_COVER = [("Bedrooms / Bathrooms / Type", "bedrooms"), ("Extra Features", "extra_features"),
          ("Geocoded (lat/lng)", "latitude"), ("Listing Status", "listing_status")]
_EMPTY = ["EPC Rating", "Flood Risk", "Transport Distances", "IMD Deprivation", "Broadband Speed", "Schools & Ofsted",
          "Healthcare (GP/Hospital)", "Supermarkets", "Green Spaces", "Pubs", "Gyms"]
on_views("coverage", " UNION ALL ".join(
    [f"SELECT {q(n)} AS feature, count({c}) AS filled, count(*) AS total, "
     f"count(DISTINCT postcode) FILTER ({c} IS NOT NULL) AS postcodes FROM property" for n, c in _COVER]
    + [f"SELECT {q(n)}, 0, count(*), 0 FROM property" for n in _EMPTY]
    + ["SELECT 'Sales (parsed price + date)', count(price_numeric), count(*), NULL FROM sale",
       "SELECT 'Crime Data', count(DISTINCT postcode), (SELECT count(DISTINCT postcode) FROM property), "
       "count(DISTINCT postcode) FROM crime_record",
       "SELECT 'Planning Applications', count(DISTINCT postcode), (SELECT count(DISTINCT postcode) FROM property), "
       "count(DISTINCT postcode) FROM planning_entity"]), "property", "sale", "crime_record", "planning_entity")
HELD = """held AS (
  SELECT p.postcode, count(DISTINCT p.id) AS property_count, count(s.id) AS sale_count, max(p.updated_at) AS last_updated
  FROM property p LEFT JOIN sale s ON s.property_id = p.id GROUP BY p.postcode)"""
on_views("postcode_list", f"WITH {HELD} SELECT * FROM held", "property", "sale")
on_views("outcode_completeness", f"""WITH {HELD}, both_sides AS (
  SELECT outcode, coalesce(t, 0) AS total_postcodes, coalesce(n, 0) AS scraped_postcodes,
         CAST(coalesce(p, 0) AS BIGINT) AS property_count, CAST(coalesce(s, 0) AS BIGINT) AS sale_count, u AS last_updated
  FROM (SELECT split_part(postcode, ' ', 1) AS outcode, count(DISTINCT postcode) AS t FROM crime_record GROUP BY 1)
  FULL JOIN (SELECT split_part(postcode, ' ', 1) AS outcode, count(*) AS n, sum(property_count) AS p,
                    sum(sale_count) AS s, max(last_updated) AS u FROM held GROUP BY 1) USING (outcode))
SELECT *, CASE WHEN total_postcodes > 0 AND scraped_postcodes >= total_postcodes THEN 'done'
               WHEN total_postcodes > 0 AND scraped_postcodes > 0 THEN 'partial' ELSE 'pending' END AS state,
       CAST(CASE WHEN total_postcodes > 0 THEN floor(scraped_postcodes / total_postcodes * 100 + 0.5) ELSE 0 END AS INT) AS pct
FROM both_sides""", "property", "sale", "crime_record")
ORACLE["completeness_totals"] = f"""SELECT count(*) FILTER (state = 'done') AS done,
  count(*) FILTER (state = 'partial') AS partial, CAST(sum(property_count) AS BIGINT) AS properties,
  CAST(sum(sale_count) AS BIGINT) AS sales FROM ({ORACLE["outcode_completeness"]})"""
on_views("work_list", """SELECT postcode, min(id) AS position FROM property WHERE listing_status = 'for_sale'
GROUP BY postcode""", "property")
on_views("freshness", """
SELECT postcode, count(*) AS property_count, max(updated_at) AS last_updated,
       coalesce(max(updated_at) >= TIMESTAMP '2024-06-01 00:00:00', FALSE) AS is_fresh
FROM property WHERE listing_status IS NULL OR listing_status <> 'for_sale' GROUP BY postcode""", "property")
on_views("postcode_status", """
SELECT postcode_clean, count(*) AS property_count, max(coalesce(updated_at, created_at)) AS last_updated,
       TRUE AS has_data FROM property GROUP BY postcode_clean""", "property")
on_views("needs_enrichment", "SELECT id FROM property WHERE outcode = 'AF0'", "property")
on_views("postcode_suggestions", "SELECT DISTINCT postcode FROM property WHERE postcode LIKE 'AF1%'", "property")
on_views("property_list", """
SELECT id, address, property_type, bedrooms, created_at FROM property
WHERE postcode_clean LIKE 'AF%' AND property_type ILIKE '%ture%' AND bedrooms BETWEEN 2 AND 5
  AND (listing_status IS NULL OR listing_status <> 'for_sale')
ORDER BY created_at DESC, id LIMIT 40 OFFSET 5""", "property")
on_views("properties_without_sales", """
SELECT id FROM property WHERE id NOT IN (
  SELECT property_id FROM raw_sale WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW')""", "property", "raw_sale")
on_views("postcodes_without_crime", """
SELECT DISTINCT postcode FROM property WHERE postcode NOT IN (SELECT postcode FROM crime_record)""",
         "property", "crime_record")
on_views("properties_with_sales", """
SELECT p.id, p.address, s.id AS sale_id, s.date_sold_iso, s.price_numeric, s.tenure, s.property_type AS sale_type
FROM property p LEFT JOIN sale s ON s.property_id = p.id""", "property", "sale")
on_views("properties_nested", """
WITH h AS (
  SELECT p.id, p.address, s.id AS sale_id, s.date_sold_iso AS d, s.price_numeric AS v
  FROM property p LEFT JOIN sale s ON s.property_id = p.id),
rise AS (
  SELECT id, max(step) AS largest_rise FROM (
    SELECT id, v - lag(v) OVER (PARTITION BY id ORDER BY coalesce(d, ''), sale_id) AS step FROM h WHERE v IS NOT NULL) GROUP BY id)
SELECT h.id, any_value(address) AS address, count(sale_id) AS n_sales, count(v) AS n_priced, CAST(coalesce(sum(v), 0) AS BIGINT) AS total,
       arg_max(v, (d, sale_id)) FILTER (v IS NOT NULL AND d IS NOT NULL) AS last_price, any_value(largest_rise) AS largest_rise,
       coalesce(string_agg(concat(coalesce(d, '?'), ':', sale_id, ':', coalesce(CAST(v AS VARCHAR), '?')), ';' ORDER BY coalesce(d, ''), sale_id)
                FILTER (sale_id IS NOT NULL), '') AS history
FROM h LEFT JOIN rise ON rise.id = h.id GROUP BY h.id""", "property", "sale")
on_views("properties_nested_flat", """
SELECT property_id, date_sold_iso, s.id AS sale_id, price_numeric, s.tenure, s.property_type AS sale_type
FROM property p JOIN sale s ON s.property_id = p.id""", "property", "sale")
on_views("properties_with_any_sale", "SELECT id, address FROM property WHERE id IN (SELECT property_id FROM sale)", "property", "sale")
on_views("due_properties", """
SELECT id, updated_at FROM property WHERE updated_at IS NULL OR updated_at < TIMESTAMP '2024-03-01 00:00:00' - INTERVAL 90 DAY""", "property")
on_views("merged_files", """
SELECT id, CASE WHEN id % 4 IN (0, 2) THEN address END AS address, CASE WHEN id % 4 <> 2 THEN bedrooms END AS bedrooms,
       CASE id % 4 WHEN 0 THEN bathrooms * 1000.0::DOUBLE WHEN 1 THEN bathrooms * 1000 + 0.5::DOUBLE END AS price,
       CASE WHEN id % 4 >= 2 THEN CAST(bathrooms AS DOUBLE) END AS rate, CASE WHEN id % 4 >= 2 THEN created_at END AS seen
FROM property""", "property")
on_views("cache_refresh", """
SELECT outcode, count(*) AS properties, CAST(CASE WHEN outcode LIKE 'A%' THEN 3 ELSE 2 END AS INT) AS version FROM property GROUP BY outcode""", "property")
on_views("resumed_work", "SELECT postcode, count(*) AS properties, CAST(1 AS BIGINT) AS times FROM property GROUP BY postcode", "property")
on_views("last_entered_sale", """
SELECT p.address, p.postcode, p.bedrooms, r.date_sold, r.price, s.tenure
FROM property p JOIN raw_sale r ON r.property_id = p.id JOIN sale s ON s.id = r.id
WHERE r.id = (SELECT max(x.id) FROM raw_sale x WHERE x.property_id = p.id)""", "property", "sale", "raw_sale")
on_views("sales_export", """
SELECT p.outcode, p.address, p.postcode, CASE WHEN trim(s.property_type) <> '' THEN s.property_type ELSE p.property_type END AS property_type, p.bedrooms,
       p.bathrooms, p.extra_features, NULL AS floorplan_urls, NULL AS url, r.date_sold, s.date_sold_iso, r.price,
       s.price_numeric, NULL AS price_change_pct, s.tenure
FROM property p JOIN raw_sale r ON r.property_id = p.id JOIN sale s ON s.id = r.id""", "property", "sale", "raw_sale")
on_views("dataset_size", """SELECT count(DISTINCT property_id) AS dataset_size FROM sale
WHERE price_numeric IS NOT NULL""", "sale")
on_views("repeat_sales", """SELECT property_id, count(*) AS sale_count FROM sale
GROUP BY property_id HAVING count(*) >= 2""", "sale")

# --- table maintenance -------------------------------------------------------

_COALESCED = [
    ("property_type", "nullif(upper(property_type), '')"), ("bedrooms", "bedrooms"), ("url", "nullif(url, '')"),
    ("listing_status", "CASE WHEN asking_price IS NOT NULL THEN 'for_sale' END"), ("listing_price", "asking_price"),
    ("listing_checked_at", "CASE WHEN asking_price IS NOT NULL THEN ingested_at END"),
    ("postcode", "nullif(postcode, '')"),
]
on_views("upsert_properties", "WITH r AS (SELECT address, " + ", ".join(
    f"arg_max({e}, seq) FILTER (({e}) IS NOT NULL) AS {n}" for n, e in _COALESCED) + """
  FROM record GROUP BY address)
SELECT address, coalesce(r.postcode, p.postcode) AS postcode,
       replace(coalesce(r.postcode, p.postcode), ' ', '') AS postcode_clean,
       coalesce(r.property_type, p.property_type) AS property_type, coalesce(r.bedrooms, p.bedrooms) AS bedrooms,
       coalesce(b.bathrooms, p.bathrooms) AS bathrooms, r.url,
       coalesce(r.listing_status, p.listing_status) AS listing_status,
       coalesce(r.listing_price, p.listing_price) AS listing_price,
       coalesce(r.listing_checked_at, p.listing_checked_at) AS listing_checked_at, p.extra_features
FROM property p FULL JOIN r USING (address)
LEFT JOIN (SELECT address, arg_max(bathrooms, seq) FILTER (bathrooms IS NOT NULL) AS bathrooms FROM record GROUP BY address) b
  USING (address)""", "property", "record")
_PRICE_FORM = f"coalesce('£' || format('{{:,}}', CAST({_DIGITS} AS BIGINT)), price)"
on_views("dedup_sales", f"""WITH a AS (
  SELECT property_id, ltrim(date_sold, '0') AS date_sold, {_PRICE_FORM} AS price, id, o_orderstatus FROM raw_sale)
SELECT property_id, date_sold, price, min(id) AS sale_id FROM a
GROUP BY property_id, date_sold, price HAVING count(*) FILTER (o_orderstatus = 'F') = 0""", "raw_sale")
on_views("upsert_planning", f"""WITH {PLANNING}, kept AS (
  SELECT * FROM planning WHERE postcode NOT IN (
    SELECT postcode FROM planning GROUP BY postcode HAVING max(fetched_at) < TIMESTAMP '2024-02-14 00:00:00')),
both_sides AS (SELECT postcode, reference, status, is_major, fetched_at FROM kept UNION ALL
  SELECT postcode, reference, 'refreshed', is_major, fetched_at + INTERVAL 90 DAY FROM planning WHERE is_major)
SELECT * FROM both_sides QUALIFY row_number() OVER (PARTITION BY postcode, reference ORDER BY fetched_at DESC) = 1""",
         "planning_entity")
on_views("replace_crime", f"""WITH {CRIME}, usable AS (
  SELECT * FROM crime WHERE category = 'burglary' AND postcode NOT IN (
    SELECT postcode FROM crime WHERE category = 'drugs' AND postcode LIKE 'A%'
    GROUP BY postcode HAVING count(DISTINCT month) >= 50))
SELECT * FROM crime WHERE postcode NOT IN (SELECT postcode FROM usable)
UNION ALL SELECT postcode, month, category, count * 2 FROM usable""", "crime_record")

# --- modelling ---------------------------------------------------------------

_PARTS = """CAST(left(date_sold_iso, 4) AS {0}) AS sale_year, CAST(substr(date_sold_iso, 6, 2) AS {0}) AS sale_month,
  CAST((CAST(substr(date_sold_iso, 6, 2) AS INT) + 2) // 3 AS {0}) AS sale_quarter"""
ORACLE["ml_dataset"] = with_views(f"""WITH {BASE}, {CRIME}, {PARSED}, win AS (
  SELECT sale_id, CAST(sum(c.count) AS DOUBLE) AS total_crime,
         CASE WHEN count(c.count) > 0 THEN CAST(coalesce(sum(c.count) FILTER (c.category = 'burglary'), 0) AS DOUBLE) END AS burglary
  FROM base {_window('base', 'base.month')} GROUP BY sale_id)
SELECT b.property_id, sale_id, b.address, date_sold_iso, CAST(price_numeric AS DOUBLE) AS price_numeric,
       CAST(b.bedrooms AS DOUBLE) AS bedrooms, CAST(b.bathrooms AS DOUBLE) AS bathrooms, b.property_type,
       p.latitude, p.longitude, tenure, {_PARTS.format('DOUBLE')}, f.parking, f.garden,
       CAST(f.double_glazed AS DOUBLE) AS double_glazed, CAST(f.chain_free AS DOUBLE) AS chain_free,
       CAST(f.sq_ft AS DOUBLE) AS sq_ft, CAST(f.lease_years AS DOUBLE) AS lease_years, total_crime, burglary
FROM base b JOIN property p ON b.property_id = p.id JOIN parsed f ON f.id = p.id JOIN win USING (sale_id)
WHERE price_numeric IS NOT NULL""", "property", "sale", "crime_record")
ORACLE["ml_price_per_sqft"] = with_views(f"""WITH {PARSED}
SELECT s.id AS sale_id, CAST(sq_ft AS DOUBLE) AS sq_ft, round(price_numeric / CAST(sq_ft AS DOUBLE), 4) AS price_per_sqft
FROM sale s JOIN parsed p ON s.property_id = p.id WHERE price_numeric IS NOT NULL AND sq_ft > 0""", "property", "sale")
PAIRS = """pairs AS (
  SELECT property_id, max(id) FILTER (r = 1) AS sale_id, max(date_sold_iso) FILTER (r = 1) AS date_sold_iso,
         max(tenure) FILTER (r = 1) AS tenure, max(price_numeric) FILTER (r = 1) AS latest,
         max(price_numeric) FILTER (r = 2) AS previous
  FROM (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY coalesce(date_sold_iso, '') DESC, id DESC) AS r
        FROM sale WHERE price_numeric IS NOT NULL AND price_numeric <> 0) GROUP BY property_id HAVING count(*) >= 2)"""
on_views("ml_price_change", f"""WITH {PAIRS}
SELECT property_id, sale_id, date_sold_iso, CAST(latest AS DOUBLE) AS price_numeric,
       round_even((latest - previous) / CAST(previous AS DOUBLE) * 100, 2) AS price_change_pct,
       CAST(bedrooms AS DOUBLE) AS bedrooms, tenure, CAST(left(date_sold_iso, 4) AS DOUBLE) AS sale_year
FROM pairs JOIN property p ON p.id = property_id""", "property", "sale")
on_views("ml_scoring_rows", """
SELECT p.id AS property_id, l.id AS sale_id, p.address, l.date_sold_iso, x.price AS last_sale_price,
       CAST(p.bedrooms AS DOUBLE) AS bedrooms, l.tenure, 2025.0::DOUBLE AS sale_year, 8.0::DOUBLE AS sale_month,
       3.0::DOUBLE AS sale_quarter
FROM property p
LEFT JOIN (SELECT * FROM sale WHERE date_sold_iso IS NOT NULL
           QUALIFY row_number() OVER (PARTITION BY property_id ORDER BY date_sold_iso DESC, id DESC) = 1) l ON l.property_id = p.id
LEFT JOIN (SELECT property_id, arg_max(price_numeric, (date_sold_iso, id)) AS price FROM sale
           WHERE price_numeric IS NOT NULL AND date_sold_iso IS NOT NULL GROUP BY 1) x ON x.property_id = p.id""",
         "property", "sale")
ORACLE["ml_downcast"] = with_views(f"""WITH {PARSED}
SELECT s.id AS sale_id, date_sold_iso, CAST(price_numeric AS DOUBLE) AS price_numeric, CAST(bedrooms AS TINYINT) AS bedrooms,
       CAST(left(date_sold_iso, 4) AS SMALLINT) AS sale_year, CAST(double_glazed AS TINYINT) AS double_glazed,
       CAST(lease_years AS SMALLINT) AS lease_years, latitude
FROM sale s JOIN property p ON s.property_id = p.id JOIN parsed f ON f.id = p.id WHERE price_numeric IS NOT NULL""",
                                   "property", "sale")
on_views("naive_forecast_metrics", f"""WITH {PAIRS}
SELECT count(*) AS n, round_even(1 - sum(pow(previous - latest, 2)) / sum(pow(latest - m, 2)), 4) AS r_squared,
       round_even(sqrt(avg(pow(previous - latest, 2))), 2) AS rmse, round_even(avg(abs(previous - latest)), 2) AS mae,
       round_even(avg(abs((previous - latest) / CAST(latest AS DOUBLE))) * 100, 2) AS mape
FROM pairs, (SELECT avg(latest) AS m FROM pairs)""", "sale")
on_views("naive_forecast_worst", f"""WITH {PAIRS}
SELECT property_id, sale_id, latest AS price_numeric, CAST(previous AS DOUBLE) AS predicted, CAST(latest AS DOUBLE) AS actual,
       CAST(previous - latest AS DOUBLE) AS residual FROM pairs ORDER BY abs(residual) DESC, sale_id LIMIT 10""", "sale")

# Boosted stumps: in every round the cut of any column that explains most of what is left.
STUMP_FEATURES = ("bathrooms", "bedrooms", "sale_month", "sale_year")
STUMP_ROUNDS = 6
_EXPLAINED = "CAST({0}s AS DOUBLE) * CAST({0}s AS DOUBLE) / CAST({0}n AS DOUBLE)"
_LEAF = "CAST(floor(CAST({0}s AS DOUBLE) / CAST(2 * {0}n AS DOUBLE)) AS BIGINT)"


def _stump_value(source: str, row: str) -> str:
    chosen = " ".join(f"WHEN '{f}' THEN {row}.{f}" for f in STUMP_FEATURES)
    return f"CASE WHEN CASE {source}.feature {chosen} END > {source}.cut THEN {source}.right_value ELSE {source}.left_value END"


def _stump_rounds() -> str:
    parts = ["""sold AS (
  SELECT s.property_id, s.id AS sale_id, date_sold_iso, price_numeric AS y, bathrooms, bedrooms,
         CAST(substr(date_sold_iso, 6, 2) AS INT) AS sale_month, CAST(left(date_sold_iso, 4) AS INT) AS sale_year
  FROM sale s JOIN property p ON s.property_id = p.id WHERE price_numeric IS NOT NULL)""",
             "start AS (SELECT CAST(floor(CAST(sum(y) AS DOUBLE) / count(*)) AS BIGINT) AS v FROM sold WHERE date_sold_iso < '2000-01-01')",
             "p0 AS (SELECT sold.*, v AS pred FROM sold, start)"]
    names, values = ", ".join(f"'{f}'" for f in STUMP_FEATURES), ", ".join(f"CAST({f} AS BIGINT)" for f in STUMP_FEATURES)
    for k in range(1, STUMP_ROUNDS + 1):
        parts.append(f"""s{k} AS (
  SELECT feature, value, count(*) AS n, sum(r) AS s
  FROM (SELECT unnest([{names}]) AS feature, unnest([{values}]) AS value, y - pred AS r FROM p{k - 1} WHERE date_sold_iso < '2000-01-01') GROUP BY ALL),
c{k} AS (
  SELECT feature, value, sum(n) OVER u AS ln, sum(s) OVER u AS ls, sum(n) OVER a AS wn, sum(s) OVER a AS ws, wn - ln AS rn, ws - ls AS rs
  FROM s{k} WINDOW u AS (PARTITION BY feature ORDER BY value NULLS FIRST ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY feature)),
b{k} AS (
  SELECT {k} AS round, feature, value AS cut, {_LEAF.format('l')} AS left_value, {_LEAF.format('r')} AS right_value,
         {_EXPLAINED.format('l')} + {_EXPLAINED.format('r')} - {_EXPLAINED.format('w')} AS gain
  FROM c{k} WHERE value IS NOT NULL AND rn > 0 ORDER BY gain DESC, feature, value LIMIT 1),
p{k} AS (SELECT p.* REPLACE (p.pred + {_stump_value('b', 'p')} AS pred) FROM p{k - 1} p, b{k} b)""")
    union = " UNION ALL ".join(f"SELECT * FROM b{k}" for k in range(1, STUMP_ROUNDS + 1))
    parts.append(f"grown AS ({union})")
    parts.append(f"""scored AS (
  SELECT property_id, sale_id, date_sold_iso, CAST(pred AS DOUBLE) AS predicted, CAST(y AS DOUBLE) AS actual, CAST(pred - y AS DOUBLE) AS residual
  FROM p{STUMP_ROUNDS} WHERE date_sold_iso >= '2000-01-01')""")
    return ", ".join(parts)


STUMPS = _stump_rounds()
for _name, _sql in {
    "ml_stumps": "SELECT CAST(round AS INT) AS round, feature, cut, left_value, right_value, round(gain / 1e6, 3) AS gain FROM grown",
    "ml_residuals": "SELECT * FROM scored",
    "ml_metrics": """SELECT count(*) AS n, round_even(1 - sum(residual * residual) / sum(pow(actual - m, 2)), 4) AS r_squared, round_even(sqrt(avg(residual * residual)), 2) AS rmse,
       round_even(avg(abs(residual)), 2) AS mae, round_even(avg(abs(residual / nullif(actual, 0))) * 100, 2) AS mape
FROM scored, (SELECT avg(actual) AS m FROM scored)""",
    "ml_worst_predictions": "SELECT property_id, sale_id, predicted, actual, residual FROM scored ORDER BY abs(residual) DESC, sale_id LIMIT 10",
    "ml_importance": f"""SELECT feature, round_even(coalesce(sum(gain), 0) / (SELECT sum(gain) FROM grown) * 100, 2) AS importance
FROM (SELECT unnest([{', '.join(f"'{f}'" for f in STUMP_FEATURES)}]) AS feature) LEFT JOIN grown USING (feature) GROUP BY feature""",
    "ml_residual_histogram": """SELECT CAST(least(floor((residual - lo) / ((hi - lo) / 20)), 19) AS INT) AS bucket, count(*) AS count,
       min(residual) AS min_residual, max(residual) AS max_residual
FROM scored, (SELECT min(residual) AS lo, max(residual) AS hi FROM scored) GROUP BY 1""",
    "ml_predictions": f""", asked AS (
  SELECT p.id AS property_id, p.address, p.bathrooms, p.bedrooms, 1 AS sale_month, 2002 AS sale_year, nullif(CAST(x.price AS DOUBLE), 0) AS last, x.price AS last_sale_price
  FROM property p LEFT JOIN (SELECT property_id, arg_max(price_numeric, (date_sold_iso, id)) AS price FROM sale
    WHERE price_numeric IS NOT NULL AND date_sold_iso IS NOT NULL GROUP BY 1) x ON x.property_id = p.id),
valued AS (
  SELECT asked.property_id, any_value(address) AS address, any_value(last_sale_price) AS last_sale_price, any_value(last) AS last,
         CAST((SELECT v FROM start) + sum({_stump_value('grown', 'asked')}) AS DOUBLE) AS predicted_value
  FROM asked, grown GROUP BY asked.property_id)
SELECT property_id, address, predicted_value, last_sale_price, round_even(predicted_value - last, 2) AS difference,
       round_even((predicted_value - last) / last * 100, 1) AS difference_pct FROM valued""",
}.items():
    on_views(_name, f"WITH {STUMPS} {_sql}", "property", "sale")
on_views("ml_category_means", """WITH r AS (
  SELECT s.id AS sale_id, p.property_type, coalesce(p.property_type, '') AS k, s.id % 5 AS fold, CAST(price_numeric AS DOUBLE) AS y
  FROM sale s JOIN property p ON s.property_id = p.id WHERE price_numeric IS NOT NULL),
c AS (SELECT k, fold, sum(y) AS s, count(*) AS n FROM r GROUP BY ALL),
m AS (SELECT k, fold, (sum(s) OVER (PARTITION BY k) - s + 1000000.0) / (sum(n) OVER (PARTITION BY k) - n + 10) AS mean FROM c)
SELECT sale_id, property_type, round(mean, 4) AS mean FROM r JOIN m USING (k, fold)""", "property", "sale")
on_views("naive_forecast_histogram", f"""WITH {PAIRS}, r AS (SELECT CAST(previous - latest AS DOUBLE) AS residual FROM pairs),
x AS (SELECT min(residual) AS lo, max(residual) AS hi FROM r)
SELECT CAST(least(floor((residual - lo) / ((hi - lo) / 20)), 19) AS INT) AS bucket, count(*) AS count,
       min(residual) AS min_residual, max(residual) AS max_residual FROM r, x GROUP BY 1""", "sale")

# --- streams -----------------------------------------------------------------

ORACLE["stream_period_totals"] = """
SELECT date_trunc('day', ts) AS period_start, event_type, count(*) AS count, round(avg(value), 6) AS avg_price,
       min(value) AS min_price, max(value) AS max_price FROM events GROUP BY 1, 2"""
ORACLE["stream_freshness"] = """
SELECT user_id, count(*) AS property_count, max(ts) AS last_updated FROM events GROUP BY user_id"""
ORACLE["stream_dedup"] = "SELECT DISTINCT user_id, event_type FROM events"
# Of the events that arrive in a turn, those count whose period ends after the watermark that
# the turns before have left.
LATE_EVENTS = """
WITH e AS (
    SELECT *, CAST(floor(epoch(ts) / 432000) AS INT) + CASE WHEN event_id % 20 = 0 THEN 2 ELSE 0 END AS turn FROM events),
mark AS (
    SELECT turn, max(max(ts)) OVER w - INTERVAL 2 DAY AS to_time, max(max(date_trunc('day', ts))) OVER w - INTERVAL 2 DAY AS to_day
    FROM e GROUP BY turn WINDOW w AS (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
"""
ORACLE["stream_periods_late"] = f"""{LATE_EVENTS}
SELECT date_trunc('day', ts) AS period_start, event_type, count(*) AS count, round(avg(value), 6) AS avg_price,
       min(value) AS min_price, max(value) AS max_price
FROM e JOIN mark USING (turn) WHERE to_time IS NULL OR date_trunc('day', ts) + INTERVAL 1 DAY > to_time GROUP BY 1, 2"""
ORACLE["stream_dedup_late"] = f"""{LATE_EVENTS}
SELECT DISTINCT user_id, event_type, date_trunc('day', ts) AS day
FROM e JOIN mark USING (turn) WHERE to_day IS NULL OR date_trunc('day', ts) > to_day"""
ORACLE["stream_freshness_late"] = ORACLE["stream_freshness"]
ORACLE["stream_ingest"] = ORACLE["upsert_properties"]
# Of equal address, date and price, the first record counts.
on_views("stream_ingest_sales", """
SELECT address, ltrim(date_sold, '0') AS date_sold, price, CAST(replace(substr(price, 2), ',', '') AS BIGINT) AS price_numeric,
       concat(right(date_sold, 4), '-11-0', substr(ltrim(date_sold, '0'), 1, 1)) AS date_sold_iso,
       arg_min(sale_type, seq) AS property_type, 'FREEHOLD' AS tenure
FROM record GROUP BY address, date_sold, price, ltrim(date_sold, '0')
QUALIFY row_number() OVER (PARTITION BY address, ltrim(date_sold, '0'), price ORDER BY min(seq)) = 1""", "record")

# --- landed files ------------------------------------------------------------

on_views("landed_crime", "SELECT postcode, category, month, count(*) AS count FROM crime_record GROUP BY ALL", "crime_record")
_SIN2 = "sin({0}) * sin({0})"


def _grid_degrees() -> str:
    """CTEs that end in ``placed`` (id, lat, lon): grid metres to degrees, one step of an iteration after another."""
    a, b, k = geo.AIRY_A, geo.AIRY_B, geo.GRID_SCALE
    n, e2, w2 = (a - b) / (a + b), 1 - (b / a) ** 2, 1 - (geo.GRS80_B / geo.GRS80_A) ** 2
    d, t = f"(phi - {geo.GRID_LAT0!r})", f"(phi + {geo.GRID_LAT0!r})"
    arc = (f"{b * k!r} * ({1 + n + 1.25 * n**2 + 1.25 * n**3!r} * {d} - {3 * n + 3 * n**2 + 2.625 * n**3!r} * sin({d}) * cos({t})"
           f" + {1.875 * (n**2 + n**3)!r} * sin(2 * {d}) * cos(2 * {t}) - {35 / 24 * n**3!r} * sin(3 * {d}) * cos(3 * {t}))")
    parts = [f"f0 AS (SELECT id, CAST(100000 + id * 7919 % 500000 AS DOUBLE) AS e, CAST(id * 104729 % 1000000 AS DOUBLE) AS n, {geo.GRID_LAT0!r} AS phi FROM property)"]
    parts += [f"f{i} AS (SELECT id, e, n, phi + (n - ({geo.GRID_N0!r}) - {arc}) / {a * k!r} AS phi FROM f{i - 1})" for i in range(1, 13)]
    parts.append(f"""u AS (SELECT id, phi, tan(phi) AS t, {a * k!r} / sqrt(1 - {e2!r} * {_SIN2.format('phi')}) AS nu,
       {a * k * (1 - e2)!r} / pow(1 - {e2!r} * {_SIN2.format('phi')}, 1.5) AS rho, (e - {geo.GRID_E0!r}) / nu AS d, nu / rho - 1 AS h FROM f12),
air AS (SELECT id,
       phi - t * nu / rho * (pow(d, 2) / 2 - pow(d, 4) / 24 * (5 + 3 * t * t + h - 9 * t * t * h) + pow(d, 6) / 720 * (61 + 90 * t * t + 45 * pow(t, 4))) AS la,
       {geo.GRID_LON0!r} + 1 / cos(phi) * (d - pow(d, 3) / 6 * (nu / rho + 2 * t * t) + pow(d, 5) / 120 * (5 + 28 * t * t + 24 * pow(t, 4))
         - pow(d, 7) / 5040 * (61 + 662 * t * t + 1320 * pow(t, 4) + 720 * pow(t, 6))) AS lo FROM u),
xyz AS (SELECT id, {a!r} / sqrt(1 - {e2!r} * {_SIN2.format('la')}) AS nu, nu * cos(la) * cos(lo) AS x, nu * cos(la) * sin(lo) AS y, nu * {1 - e2!r} * sin(la) AS z FROM air),""")
    (rx, ry, rz), (sx, sy, sz), m = geo.SHIFT_ROTATION, geo.SHIFT_M, 1 + geo.SHIFT_PPM
    parts[-1] += f"""
moved AS (SELECT id, {sx!r} + {m!r} * x - {rz!r} * y + {ry!r} * z AS x, {sy!r} + {rz!r} * x + {m!r} * y - {rx!r} * z AS y, {sz!r} - {ry!r} * x + {rx!r} * y + {m!r} * z AS z FROM xyz),
l0 AS (SELECT id, x, y, z, sqrt(x * x + y * y) AS flat, atan2(z, flat * {1 - w2!r}) AS p FROM moved)"""
    parts += [f"l{i} AS (SELECT id, x, y, z, flat, atan2(z + {w2 * geo.GRS80_A!r} / sqrt(1 - {w2!r} * {_SIN2.format('p')}) * sin(p), flat) AS p FROM l{i - 1})" for i in range(1, 11)]
    parts.append("placed AS (SELECT id, round(degrees(p), 6) AS lat, round(degrees(atan2(y, x)), 6) AS lon FROM l10)")
    return ", ".join(parts)


GRID_DEGREES = _grid_degrees()
on_views("landed_schools", f"""WITH {GRID_DEGREES}
SELECT 'school' AS kind, CASE WHEN id % 2 = 0 THEN 'primary' ELSE 'secondary' END AS subtype, trim(address) AS name, 'Good' AS rating, lat, lon
FROM property JOIN placed USING (id) WHERE id % 5 <> 0 AND id % 7 <> 0""", "property")
on_views("green_space_sites", f"""WITH {GRID_DEGREES}
SELECT 'green_space' AS kind, CASE WHEN id % 2 = 0 THEN 'Play Space' ELSE 'Unknown' END AS subtype,
       CASE WHEN id % 3 > 0 THEN address WHEN id % 2 = 0 THEN 'Play Space' ELSE 'Unknown' END AS name, lat, lon
FROM property JOIN placed USING (id)""", "property")
on_views("outcode_rollup", f"""WITH {HELD}
SELECT split_part(postcode, ' ', 1) AS outcode, count(*) AS scraped_postcodes, CAST(sum(property_count) AS BIGINT) AS property_count,
       CAST(sum(sale_count) AS BIGINT) AS sale_count, max(last_updated) AS last_updated FROM held GROUP BY 1""", "property", "sale")
on_views("landed_epc", """
SELECT postcode, row_number() OVER (PARTITION BY postcode ORDER BY seq) - 1 AS seq, upper(address) AS address, epc_rating, epc_score,
       nullif(environment_impact, 0) AS environment_impact, CAST(estimated_energy_cost + 100 AS INT) AS estimated_energy_cost
FROM epc_cert""", "epc_cert")
ORACLE["landed_planning"] = ORACLE["planning_records"]
on_views("landed_flood_areas", "SELECT postcode, notation FROM flood_area", "flood_area")
on_views("landed_flood_warnings", """
SELECT postcode, CAST(row_number() OVER (PARTITION BY postcode ORDER BY position) - 1 AS INT) AS position,
       CASE severity WHEN '3' THEN 'Unknown' ELSE severity END AS severity, '' AS message, CAST(position AS VARCHAR) AS area
FROM flood_warning""", "flood_warning")

on_views("landed_postcodes", """
SELECT replace(postcode, ' ', '') AS postcode, outcode AS lsoa, CASE WHEN id % 7 <> 0 THEN latitude END AS lat, longitude AS lng
FROM property WHERE id % 5 <> 0""", "property")
on_views("landed_stops", """
SELECT CASE id % 5 WHEN 0 THEN 'rail' WHEN 1 THEN 'tube' ELSE 'bus' END AS kind,
       CASE id % 5 WHEN 0 THEN 'RSE' WHEN 1 THEN 'TMU' ELSE 'BCT' END AS subtype, name, lat, lon
FROM poi WHERE id % 5 < 3 AND id % 9 <> 0""", "poi")
on_views("landed_imd", """
SELECT lsoa, imd_decile, nullif(imd_income_decile, 9) AS imd_income_decile, CAST(NULL AS INT) AS imd_crime_decile FROM imd""", "imd")

on_views("landed_broadband", """
SELECT replace(postcode, ' ', '') AS postcode, CASE WHEN id % 8 <> 0 THEN round_even(id % 999 + 0.25::DOUBLE, 1) END AS broadband_median_speed,
       round_even(id % 17 / nullif(t, 0) * 100, 1) AS broadband_superfast_pct,
       round_even(id % 5 / nullif(t, 0) * 100, 1) AS broadband_ultrafast_pct,
       round_even(id % 90 + 0.45::DOUBLE, 1) AS broadband_full_fibre_pct
FROM (SELECT *, CAST(id % 3 + id % 11 + id % 13 + id % 5 AS DOUBLE) AS t FROM property)""", "property")

on_views("csv_export_written", """
SELECT p.address, p.postcode, p.property_type, CAST(p.bedrooms AS VARCHAR) AS bedrooms, CAST(p.bathrooms AS VARCHAR) AS bathrooms,
       r.date_sold, r.price, s.tenure
FROM property p JOIN sale s ON s.property_id = p.id JOIN raw_sale r ON r.id = s.id""", "property", "sale", "raw_sale")

# --- pages -------------------------------------------------------------------
# The given pages hold a heading and no sale table, so heading and address are all.
# Markup decodes these character references also where the semicolon is missing.

ORACLE["page_addresses"] = r"""SELECT page_id, url, address,
  upper(nullif(trim(regexp_extract(address, '[A-Z]{1,2}\d{1,2}[A-Z]?\s?\d[A-Z]{2}', 0, 'i')), '')) AS postcode
FROM (SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
        regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'),
        '&quot;?', '"', 'g'), '&amp;?', '&', 'g')) AS address FROM pages) WHERE address <> ''"""
# A page without a heading has neither address nor postcode.
on_views("page_extract", """
SELECT id AS page_id, concat('/house/', id) AS url, CASE WHEN id % 10 = 9 THEN '' ELSE trim(address) END AS address, CASE WHEN id % 10 <> 9 THEN postcode END AS postcode, 'Terraced' AS property_type,
       CAST(id % 6 AS INT) AS bedrooms, CAST(CASE WHEN id % 3 = 0 THEN 0 ELSE id % 3 END AS INT) AS bathrooms,
       concat('Garage|', id, ' sq ft') AS extra_features, concat('/fp', id, '.png|/floorplan.JPG') AS floorplan_urls,
       concat(id % 28 + 1, ' Nov 2019|£', id, ',000|+', id % 5, '%|Flat|Leasehold',
              CASE WHEN id % 2 = 0 THEN concat(';1 Jan 2010|£', id, '|||Freehold') ELSE '' END) AS sales
FROM property""", "property")
on_views("area_postcodes", "SELECT DISTINCT postcode FROM property WHERE outcode = 'AM1'", "property")


# Bundles in long form: the SQL of each part, turned into one row per figure.
def long_rows(section: str, sql: str, key: str, numbers: str, labels: str = "") -> str:
    named = [*numbers.split(), *labels.split()]
    values = [f"CAST({c} AS DOUBLE)" for c in numbers.split()] + ["NULL"] * len(labels.split())
    texts = ["NULL"] * len(numbers.split()) + [f"CAST({c} AS VARCHAR)" for c in labels.split()]
    return (f"SELECT '{section}' AS section, {f'CAST({key} AS VARCHAR)' if key else repr('')} AS key, "
            f"unnest([{', '.join(map(repr, named))}]) AS measure, unnest(CAST([{', '.join(values)}] AS DOUBLE[])) AS value, "
            f"unnest(CAST([{', '.join(texts)}] AS VARCHAR[])) AS label FROM ({sql})")


ORACLE["overview_bundle"] = "\nUNION ALL ".join([
    long_rows("median_price", ORACLE["upper_median"], "", "median_price"),
    long_rows("price_distribution", ORACLE["price_bands"], "range", "count"),
    long_rows("top_postcodes", ORACLE["top_postcodes"], "postcode", "count avg_price"),
    long_rows("property_types", ORACLE["type_breakdown"], "property_type", "count avg_price"),
    long_rows("bedroom_distribution", ORACLE["bedroom_dist"], "bedrooms", "count avg_price"),
    long_rows("yearly_trends", ORACLE["sales_volume"], "year", "count"),
    long_rows("price_trends", ORACLE["monthly_trend"], "month", "avg_price median_price min_price max_price count"),
])
# Listed properties that were never sold count among the properties.
on_views("unsold_listings", """SELECT count(*) AS listed FROM property p
WHERE listing_status = 'for_sale' AND NOT EXISTS (SELECT 1 FROM sale s WHERE s.property_id = p.id)""", "property", "sale")
UNSOLD = ORACLE.pop("unsold_listings")
WITH_UNSOLD = f"SELECT k.* REPLACE (total_properties + listed AS total_properties) FROM ({ORACLE['kpis']}) k, ({UNSOLD}) u"
ORACLE["insights_bundle"] = "\nUNION ALL ".join([
    long_rows("price_histogram", ORACLE["price_histogram"], "bucket", "min_price max_price count", "range_label"),
    long_rows("time_series", ORACLE["insights_time_series"], "month", "median_price avg_price sales_count"),
    long_rows("trend_line", ORACLE["trend_line"], "", "x_min x_max y_at_min y_at_max"),
    long_rows("postcode_heatmap", ORACLE["postcode_heatmap"], "postcode", "avg_price count growth_pct"),
    long_rows("kpis", WITH_UNSOLD, "", "appreciation_rate price_per_bedroom market_velocity_pct price_volatility_pct "
              "total_sales total_properties median_price", "market_velocity_direction"),
])
YEARLY, PERIODS = "concat_ws('|', postcode, CAST(year AS VARCHAR))", "concat_ws('|', postcode, CAST(period_years AS VARCHAR))"
ORACLE["growth_bundle"] = "\nUNION ALL ".join([
    long_rows("annual_medians", ORACLE["annual_medians"], YEARLY, "median_price sale_count"),
    long_rows("metrics", ORACLE["cagr_periods"], PERIODS, "cagr_pct start_price end_price"),
    long_rows("volatility", ORACLE["volatility"], "postcode", "volatility_pct"),
    long_rows("max_drawdown", ORACLE["max_drawdown"], "postcode", "max_drawdown_pct"),
    long_rows("forecast", ORACLE["forecast"], YEARLY, "predicted_price lower_bound upper_bound"),
    long_rows("data_years", ORACLE["data_span"], "postcode", "data_years"),
])
