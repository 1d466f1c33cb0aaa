"""The 112 structured columns parsed from free-text listing features.

Input is an array of phrases. Yes/no columns are one regular expression each over
all phrases joined by a separator no pattern can cross, which keeps them in
generated code; columns where the first matching phrase wins look at the phrases
in order. No Python runs per row. An empty list gives NULL everywhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from plotwise.functions import text

SEPARATOR = "\u0001"
_START, _END, _INNER = r"(?:^|\x01)", r"(?=\x01|$)", r"[^\x01]*"
_ANY = r"[^\x01\n]*"  # any text inside one line of one phrase
# Case-insensitive with Unicode white space and word boundaries.
FLAGS = "(?iU)"


def _exactly(*phrases: str) -> str:
    return _START + "(?:" + "|".join(phrases) + ")" + _END


def _inside_without(pattern: str, forbidden: str) -> str:
    """Pattern in a phrase that does not contain the forbidden text."""
    return _START + "(?!" + _INNER + forbidden + ")" + _INNER + pattern


# One pattern per yes/no column.
BOOLEAN_PATTERNS: dict[str, str] = {
    "double_glazed": r"double\s*glaz",
    "period_property": r"period\s*(features|property|house|home|character)",
    "utility_room": r"utility\s*room",
    "conservatory": r"conservatory",
    "ensuite": r"en[\s-]?suite",
    "cloakroom": r"cloakroom|downstairs wc|downstairs w\.c|donwstairs wc|separate wc",
    "wooden_floors": r"wood(?:en)?\s*floor|hardwood\s*floor",
    "gym": r"\bgym\b",
    "lift": _exactly("lift") + r"|lift access|elevator",
    "dining_room": r"\bdining\s*room\b",
    "ev_charger": r"\bev\s*charg|charging\s*point",
    "fireplace": r"fireplace|log\s*burner|wood\s*burner|open\s*fire|wood burning stove",
    "study": (
        _exactly("study", "home office", "office", "study room")
        + "|" + _START + r"(?=[^\x01]{0,29}(?:\x01|$))" + _INNER + r"\bstudy\b"
        + r"|home\s*office|study/office|office/study"
    ),
    "shower_room": r"shower\s*room",
    "fitted_wardrobes": r"fitted\s*wardrobe|built[\s-]?in\s*wardrobe",
    "new_build": r"\bnew\s*build\b|new\s*development\b",
    "concierge": r"\bconcierge\b|\bporter\b",
    "swimming_pool": r"swimming\s*pool",
    "air_conditioning": r"air\s*condition",
    "solar_panels": r"solar\s*panel",
    "loft": r"\bloft\b",
    "entrance_hall": r"entrance\s*(hall|foyer)",
    "white_goods": r"white goods|dishwasher|washing machine|washer",
    "bay_window": r"bay\s*window",
    "intercom": r"intercom|entry\s*phone|entryphone",
    "split_level": r"split\s*level",
    "cellar": r"cellar|undercroft|" + _exactly("basement", "basement room", "basement storage"),
    "roof_terrace": r"roof\s*terrace",
    "high_ceilings": r"high\s*ceiling",
    "open_plan": r"open[\s-]*plan",
    "gated": r"\bgated\b",
    "purpose_built": r"purpose[\s-]*built",
    "refurbished": (
        r"(newly|recently)\s*(refurbish|renovate|decorat|fitted|updated)|refurbished|renovated"
    ),
    "duplex": r"\bduplex\b",
    "penthouse": r"\bpenthouse\b",
    "own_front_door": r"own\s*front\s*door",
    "private_entrance": r"private\s*entrance",
    "bike_storage": r"(bike|cycle|bicycle)\s*stor",
    "cul_de_sac": r"cul[\s-]*de[\s-]*sac",
    "conservation_area": r"conservation\s*area",
    "annexe": r"\bannex[e]?\b",
    "views": (
        r"(river|sea|park|garden|city|panoramic|rural|country|woodland|lake|mountain|canal|"
        r"harbour|harbor|ocean|thames)\s*view"
        r"|view(s)?\s*(of|over|across)\s*(the\s*)?(river|sea|park|city|thames|canal|lake)"
    ),
    "underground_parking": r"underground\s*park",
    "allocated_parking": r"allocat\w*\s*park",
    "listed_building": (
        r"\blisted\s*(building|property|grade)|grade\s*(i{1,3}|[12])\s*listed"
    ),
    "extended": _inside_without(r"\bextend(ed|sion)\b", "potential") + r"|side return",
    "outbuilding": (
        r"\b(outbuilding|summer\s*house|garden\s*room|garden\s*office|workshop|garden\s*studio|"
        r"garden\s*shed)\b"
    ),
    "potential_to_extend": (
        r"potential\s*(to\s*)?(extend|develop|convert|improve)|stpp\b|subject\s*to\s*planning"
    ),
    "walk_in_wardrobe": r"walk[\s-]*in\s*(wardrobe|closet|dressing)",
    "wet_room": r"wet\s*room",
    "integrated_appliances": r"integrat\w*\s*appliance|built[\s-]*in\s*appliance",
    "side_access": _inside_without(r"side\s*(access|return|entrance|gate|passage)", "extension"),
    "video_entry": r"video\s*(entry|intercom|door)|door\s*entry",
    "separate_living_room": _exactly(
        "sitting room", "living room", "drawing room", "lounge", "living/dining room",
        "front room", r"(separate|large|spacious|bright)\s*(sitting|living|drawing)\s*room",
    ),
    "laminate_flooring": r"laminate\s*floor",
    "corner_plot": r"corner\s*(plot|position|site)",
    "end_terrace": r"end\s*(of\s*)?terrac",
    "mid_terrace": r"mid[\s-]*terrac",
    "bungalow": r"\bbungalow\b",
    "double_garage": r"double\s*garage",
    "integral_garage": r"integral\s*garage",
    "through_lounge": r"through\s*(lounge|reception|living)",
    "breakfast_kitchen": r"breakfast\s*(kitchen|room|bar)|breakfasting\s*kitchen",
    "rear_garden": r"(rear|back)\s*garden",
    "front_garden": r"front\s*garden",
    "mature_garden": r"(mature|established|well[\s-]*stocked)\s*garden",
    "family_bathroom": r"family\s*bathroom",
    "guest_wc": r"guest\s*(wc|w/c|toilet|cloakroom)",
    "dressing_room": r"dressing\s*room",
    "snug": r"\bsnug\b",
    "porch": r"\bporch\b",
    "orangery": r"\borangery\b",
    "pantry": r"\bpantry\b",
    "boot_room": r"boot\s*room",
    "games_room": r"(games?|play|hobby)\s*room",
    "cinema_room": r"cinema\s*room|home\s*cinema|media\s*room|home\s*theatre",
    "reception_hall": r"reception\s*hall",
    "garage_conversion": r"garage\s*conversion|converted\s*garage",
    "needs_modernisation": r"(need|in need|require)" + _ANY + r"(modernis|updat|renovat|refurb)",
    "vacant_possession": r"vacant\s*possession",
    "original_features": r"original\s*features|retain" + _ANY + "original",
    "period_conversion": r"period\s*conversion|converted\s*(period|victorian|georgian|edwardian)",
    "countryside_views": r"(countryside|rural|field|valley|hill|rolling)\s*view",
    "sea_views": r"(sea|ocean|coast|beach|harbour|harbor)\s*view",
    "alarm_system": r"(burglar|security|intruder)\s*alarm|alarm\s*system",
    "electric_gates": r"electric\s*gates?",
    "stables": r"\bstables?\b|equestrian",
    "hot_tub": r"hot\s*tub|jacuzzi",
    "sauna": r"\bsauna\b",
    "wine_cellar": r"wine\s*(cellar|room|store)",
    "underfloor_heating": r"underfloor\s*heat",
    "first_time_buy": r"first\s*time\s*buy",
}

# Words of which any match holds at least one, so that most patterns are never run:
# looking for a word is far cheaper than a regular expression.
PATTERN_WORDS: dict[str, str] = {
    "double_glazed": "glaz",
    "period_property": "period",
    "utility_room": "utility",
    "conservatory": "conservatory",
    "ensuite": "suite",
    "cloakroom": "cloakroom|wc|w.c",
    "wooden_floors": "floor",
    "gym": "gym",
    "lift": "lift|elevator",
    "dining_room": "dining",
    "ev_charger": "charg",
    "fireplace": "fireplace|burner|fire|wood burning",
    "study": "study|office",
    "shower_room": "shower",
    "fitted_wardrobes": "wardrobe",
    "new_build": "new",
    "concierge": "concierge|porter",
    "swimming_pool": "swimming",
    "air_conditioning": "condition",
    "solar_panels": "solar",
    "loft": "loft",
    "entrance_hall": "entrance",
    "white_goods": "white goods|washer|washing machine",
    "bay_window": "window",
    "intercom": "intercom|phone",
    "split_level": "split",
    "cellar": "cellar|undercroft|basement",
    "roof_terrace": "roof",
    "high_ceilings": "ceiling",
    "open_plan": "plan",
    "gated": "gated",
    "purpose_built": "purpose",
    "refurbished": "newly|recently|refurbished|renovated",
    "duplex": "duplex",
    "penthouse": "penthouse",
    "own_front_door": "front",
    "private_entrance": "entrance",
    "bike_storage": "stor",
    "cul_de_sac": "cul",
    "conservation_area": "conservation",
    "annexe": "annex",
    "views": "view",
    "underground_parking": "underground",
    "allocated_parking": "allocat",
    "listed_building": "listed",
    "extended": "extend|side return",
    "outbuilding": "outbuilding|house|garden|workshop",
    "potential_to_extend": "potential|stpp|planning",
    "walk_in_wardrobe": "walk",
    "wet_room": "wet",
    "integrated_appliances": "appliance",
    "side_access": "side",
    "video_entry": "video|door",
    "separate_living_room": "room|lounge",
    "laminate_flooring": "laminate",
    "corner_plot": "corner",
    "end_terrace": "terrac",
    "mid_terrace": "terrac",
    "bungalow": "bungalow",
    "double_garage": "garage",
    "integral_garage": "garage",
    "through_lounge": "through",
    "breakfast_kitchen": "breakfast",
    "rear_garden": "garden",
    "front_garden": "garden",
    "mature_garden": "garden",
    "family_bathroom": "bathroom",
    "guest_wc": "guest",
    "dressing_room": "dressing",
    "snug": "snug",
    "porch": "porch",
    "orangery": "orangery",
    "pantry": "pantry",
    "boot_room": "boot",
    "games_room": "room",
    "cinema_room": "cinema|media|theatre",
    "reception_hall": "reception",
    "garage_conversion": "garage",
    "needs_modernisation": "need|require",
    "vacant_possession": "vacant",
    "original_features": "original",
    "period_conversion": "period|converted",
    "countryside_views": "view",
    "sea_views": "view",
    "alarm_system": "alarm",
    "electric_gates": "electric",
    "stables": "stable|equestrian",
    "hot_tub": "tub|jacuzzi",
    "sauna": "sauna",
    "wine_cellar": "wine",
    "underfloor_heating": "underfloor",
    "first_time_buy": "first",
}
COLUMN_WORDS: dict[str, str] = {
    "parking": "garage|driveway|street|parking",
    "floor_level": "floor|lower ground|basement",
    "garden_facing": "fac",
    "property_era": "victorian|edwardian|georgian|deco",
    "condition": "immaculate|condition",
    "kitchen_type": "kitchen",
    "epc_rating": "epc|energy",
    "council_tax_band": "council",
    "chain_free": "chain",
    "garden": "balcony|terrace|garden|patio",
    "heating": "underfloor|under floor|gas|heating",
    "furnished": "furnished",
    "receptions": "reception",
    "sq_ft": "sq",
    "service_charge": "service",
    "ground_rent": "ground",
    "distance_to_station": "mile",
    "acre_plot": "acre",
}

# Columns in the order users see them.
FEATURE_COLUMNS: tuple[str, ...] = (
    "epc_rating", "council_tax_band", "chain_free", "parking", "garden", "heating",
    "double_glazed", "lease_type", "lease_years", "receptions", "furnished", "period_property",
    "utility_room", "conservatory", "ensuite", "cloakroom", "floor_level", "sq_ft",
    "service_charge", "ground_rent", "wooden_floors", "gym", "lift", "dining_room", "ev_charger",
    "fireplace", "study", "shower_room", "fitted_wardrobes", "new_build", "concierge",
    "swimming_pool", "air_conditioning", "solar_panels", "loft", "entrance_hall", "white_goods",
    "bay_window", "distance_to_station", "intercom", "split_level", "cellar", "roof_terrace",
    "high_ceilings", "open_plan", "gated", "purpose_built", "refurbished", "duplex", "penthouse",
    "own_front_door", "private_entrance", "bike_storage", "cul_de_sac", "conservation_area",
    "annexe", "views", "underground_parking", "allocated_parking", "garden_facing",
    "property_era", "condition", "kitchen_type", "listed_building", "extended", "outbuilding",
    "potential_to_extend", "walk_in_wardrobe", "wet_room", "integrated_appliances",
    "side_access", "video_entry", "separate_living_room", "laminate_flooring", "corner_plot",
    "end_terrace", "mid_terrace", "bungalow", "double_garage", "integral_garage",
    "through_lounge", "breakfast_kitchen", "rear_garden", "front_garden", "mature_garden",
    "family_bathroom", "guest_wc", "dressing_room", "snug", "porch", "orangery", "pantry",
    "boot_room", "games_room", "cinema_room", "reception_hall", "garage_conversion",
    "needs_modernisation", "vacant_possession", "original_features", "period_conversion",
    "countryside_views", "sea_views", "acre_plot", "alarm_system", "electric_gates", "stables",
    "hot_tub", "sauna", "wine_cellar", "underfloor_heating", "first_time_buy",
)
NUMERIC_FEATURES = (
    "lease_years", "receptions", "sq_ft", "service_charge", "ground_rent",
    "distance_to_station", "acre_plot",
)
CATEGORICAL_FEATURES = (
    "epc_rating", "council_tax_band", "parking", "garden", "heating", "lease_type", "furnished",
    "floor_level", "garden_facing", "property_era", "condition", "kitchen_type",
)
BOOLEAN_FEATURES = tuple(
    c for c in FEATURE_COLUMNS if c not in NUMERIC_FEATURES and c not in CATEGORICAL_FEATURES
)

# Ordered (pattern, label) rules; the first phrase that meets a rule
# decides, and within a phrase the first rule does.
LABEL_RULES: dict[str, tuple[tuple[str, str], ...]] = {
    "parking": (
        (r"garage", "Garage"), (r"driveway", "Driveway"),
        (r"off[\s-]?street", "Off-street"), (r"parking", "Parking"),
    ),
    "floor_level": (
        (r"ground floor|lower ground", "Ground"), (r"first floor", "First"),
        (r"second floor", "Second"), (r"third floor|3rd floor", "Third"),
        (r"(fourth|4th|fifth|5th|sixth|6th|seventh|7th|eighth|8th|ninth|9th|tenth|10th|\d+th)\s*floor",
         "Upper"),
        (r"top floor", "Top"), (r"basement", "Basement"),
    ),
    "garden_facing": (
        (r"south\s*fac", "South"), (r"west\s*fac", "West"),
        (r"east\s*fac", "East"), (r"north\s*fac", "North"),
    ),
    "property_era": (
        (r"victorian", "Victorian"), (r"edwardian", "Edwardian"),
        (r"georgian", "Georgian"), (r"art\s*deco", "Art Deco"),
    ),
    "condition": (
        (r"\bimmaculate\b", "Immaculate"), (r"\bexcellent\s*condition\b", "Excellent"),
        (r"\bgood\s*condition\b", "Good"), (r"\bfair\s*condition\b", "Fair"),
    ),
    "kitchen_type": (
        (r"open[\s-]*plan\s*kitchen", "Open Plan"),
        (r"kitchen[\s/]*(din(er|ing)|breakfast)", "Kitchen Diner"),
        (r"eat[\s-]*in\s*kitchen", "Eat-in"), (r"separate\s*kitchen", "Separate"),
    ),
}
EPC_PATTERN = r"(?:epc|energy)\b" + _ANY + r"\b([A-G])\b"
TAX_BAND_PATTERN = r"council\s*tax" + _ANY + r"?band\s*[-:.]?\s*([A-H])\b"
SERVICE_CHARGE_PATTERN = (
    r"service\s*(?:charge|/maintenance)" + _ANY + r"?[£$]([\d,]+(?:\.\d+)?)"
)
GROUND_RENT_PATTERN = r"ground\s*rent" + _ANY + r"?[£$]([\d,]+(?:\.\d+)?)"
SQ_FT_PATTERN = r"([\d,]+)\s*sq\s*\.?\s*ft"
SQ_M_PATTERN = r"([\d,]+(?:\.\d+)?)\s*sq\s*\.?\s*m\b"
SQ_FT_PER_SQ_M = 10.764
MILES_PATTERN = r"([\d.]+)\s*mile"
ACRES_PATTERN = r"(\d+\.?\d*)\s*acre"
LEASE_YEARS_PATTERN = r"(\d+)\s*year"
YEAR_LEASE_PATTERN = r"(\d+)\s*year\s*lease"
RECEPTIONS_LEADING = r"^(\d+|one|two|three|four|five)\s*reception"
ANY_NUMBER = r"(\d+|one|two|three|four|five|six|seven|eight|nine|ten)"
CHAIN_FREE_PATTERN = r"no onward chain|chain free|no chain|no forward chain|chain-free"


def _matches(phrase: Column, pattern: str) -> Column:
    return phrase.rlike(FLAGS + pattern)


def _group(phrase: Column, pattern: str) -> Column:
    return text.blank_to_null(F.regexp_extract(phrase, FLAGS + pattern, 1))


def _has(phrase: Column, *words: str) -> Column:
    """The lower-case phrase contains all of the words."""
    found = F.contains(phrase, F.lit(words[0]))
    for word in words[1:]:
        found = found & F.contains(phrase, F.lit(word))
    return found


def _first(phrases: Column, rule: Callable[[Column], Column]) -> Column:
    """Value of the first phrase for which the rule gives one."""
    return F.get(F.filter(F.transform(phrases, rule), lambda v: v.isNotNull()), 0)


def _labelled(rules: tuple[tuple[str, str], ...]) -> Callable[[Column], Column]:
    def rule(phrase: Column) -> Column:
        label = F.when(_matches(phrase, rules[0][0]), rules[0][1])
        for pattern, name in rules[1:]:
            label = label.when(_matches(phrase, pattern), name)
        return label
    return rule


def _number(digits: Column) -> Column:
    return F.replace(digits, F.lit(","), F.lit("")).try_cast("double")


def _chain_free(phrase: Column) -> Column:
    return F.when(_matches(phrase, CHAIN_FREE_PATTERN), F.lit(True)).when(
        _matches(phrase, "end of chain"), F.lit(False)
    )


def _garden(phrase: Column) -> Column:
    low = F.lower(phrase)
    opens_with_terrace = F.regexp_extract(low, r"(?U)^\s*(\S+)", 1) == "terrace"
    kind = _has(low, "roof") | _has(low, "communal") | _has(low, "private") | low.endswith("terrace")
    return (
        F.when(_has(low, "balcony"), "Balcony")
        .when(_has(low, "terrace") & ~opens_with_terrace & kind, "Terrace")
        .when(_has(low, "communal", "garden"), "Communal Garden")
        .when(_has(low, "private", "garden"), "Private Garden")
        .when(_has(low, "patio"), "Patio")
        .when(_has(low, "garden"), "Garden")
    )


def _heating(phrase: Column) -> Column:
    low = F.lower(phrase)
    return (
        F.when(_has(low, "underfloor") | _has(low, "under floor"), "Underfloor")
        .when(_has(low, "gas") & (_has(low, "central") | _has(low, "heating")), "Gas Central")
        .when(_has(low, "central heating"), "Central Heating")
        .when(_has(low, "electric", "heating"), "Electric")
        .when(_has(low, "heating"), "Other")
    )


def _furnished(phrase: Column) -> Column:
    low = F.regexp_replace(F.lower(phrase), r"\.+$", "")
    rest = F.replace(low, F.lit("unfurnished"), F.lit(""))
    return (
        F.when(_has(low, "part furnished") | _has(low, "part-furnished"), "Part Furnished")
        .when(low == "unfurnished", "Unfurnished")
        .when(low == "furnished", "Furnished")
        .when(_has(low, "unfurnished") & _has(rest, "furnished"), "Flexible")
    )


def _receptions(phrase: Column) -> Column:
    low = F.lower(phrase)
    return F.coalesce(
        text.number_word(_group(low, RECEPTIONS_LEADING)),
        F.when(_has(low, "reception room"), text.number_word(_group(low, ANY_NUMBER))),
    )


def _station_miles(phrase: Column) -> Column:
    miles = F.regexp_replace(_group(phrase, MILES_PATTERN), r"\.+$", "")
    return F.when(_matches(phrase, "station"), miles.try_cast("double"))


def _acres(phrase: Column) -> Column:
    size = _group(phrase, ACRES_PATTERN).try_cast("double")
    return F.coalesce(size, F.when(_matches(phrase, r"\bacreage\b"), F.lit(1.0)))


def _lease(phrases: Column) -> Column:
    """Struct of lease type and years, folded over the phrases in order."""
    def step(seen: Column, phrase: Column) -> Column:
        low = F.lower(phrase)
        kind, years = seen["kind"], seen["years"]
        share = _has(low, "share of freehold")
        free = ~share & _has(low, "freehold") & kind.isNull()
        lease = ~share & ~free & _has(low, "lease")
        found = _group(phrase, LEASE_YEARS_PATTERN).try_cast("int")
        return F.struct(
            F.when(share, "Share of Freehold").when(free, "Freehold")
            .when(lease, F.coalesce(kind, F.lit("Leasehold"))).otherwise(kind).alias("kind"),
            F.when(lease, F.coalesce(years, found)).otherwise(years).alias("years"),
        )

    empty = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("int").alias("years"))
    folded = F.aggregate(phrases, empty, step)
    late = _first(phrases, lambda p: _group(p, YEAR_LEASE_PATTERN).try_cast("int"))
    return F.struct(
        F.coalesce(
            folded["kind"],
            F.when(folded["years"].isNull() & late.isNotNull(), F.lit("Leasehold")),
        ).alias("kind"),
        F.coalesce(folded["years"], late).alias("years"),
    )


def _mentions(low: Column, words: str) -> Column:
    """The lower-case text contains any of the words."""
    first, *rest = words.split("|")
    found = F.contains(low, F.lit(first))
    for word in rest:
        found = found | F.contains(low, F.lit(word))
    return found


def _sq_ft(phrases: Column) -> Column:
    """Any square feet win over all square metres."""
    feet = _first(phrases, lambda p: _number(_group(p, SQ_FT_PATTERN)).cast("int"))
    metres = _first(phrases, lambda p: _number(_group(p, SQ_M_PATTERN)))
    return F.coalesce(feet, F.bround(metres * SQ_FT_PER_SQ_M, 0).cast("int"))


# How each column is found in the joined text, where the leftmost match decides ...
_IN_TEXT: dict[str, Callable[[Column], Column]] = {
    "epc_rating": lambda joined: F.upper(_group(joined, EPC_PATTERN)),
    "council_tax_band": lambda joined: F.upper(_group(joined, TAX_BAND_PATTERN)),
    "service_charge": lambda joined: _number(_group(joined, SERVICE_CHARGE_PATTERN)).cast("int"),
    "ground_rent": lambda joined: _number(_group(joined, GROUND_RENT_PATTERN)).cast("int"),
}
# ... or phrase by phrase.
_BY_PHRASE: dict[str, Callable[[Column], Column]] = {
    "chain_free": _chain_free,
    "garden": _garden,
    "heating": _heating,
    "furnished": _furnished,
    "receptions": _receptions,
    "distance_to_station": _station_miles,
    "acre_plot": _acres,
    **{name: _labelled(rules) for name, rules in LABEL_RULES.items()},
}


def feature_column(name: str, phrases: Column, joined: Column, low: Column, lease: Column) -> Column:
    """One parsed column over a phrase array, the joined phrases, the same in lower
    case, and the lease struct."""
    if name in BOOLEAN_PATTERNS:
        found = _mentions(low, PATTERN_WORDS[name]) & _matches(joined, BOOLEAN_PATTERNS[name])
        return F.when(found, F.lit(True))
    if name == "lease_type":
        return lease["kind"]
    if name == "lease_years":
        return lease["years"]
    if name == "sq_ft":
        value = _sq_ft(phrases)
    elif name in _IN_TEXT:
        value = _IN_TEXT[name](joined)
    else:
        value = _first(phrases, _BY_PHRASE[name])
    return F.when(_mentions(low, COLUMN_WORDS[name]), value)


def parse_features(df: DataFrame, source: str = "extra_features",
                   wanted: tuple[str, ...] | None = None, prefix: str = "",
                   keep: tuple[str, ...] | None = None) -> DataFrame:
    """Add the parsed columns of a JSON text column (or an array of phrases).

    The phrase array, the joined text and the lease are computed once per row in
    their own projection; a column nobody selects is pruned with its patterns.
    ``keep`` lists the input columns to carry over, all by default.
    """
    is_array = dict(df.dtypes)[source].startswith("array")
    phrases = F.col(source) if is_array else text.json_text_list(F.col(source))
    if is_array:
        phrases = F.filter(F.transform(phrases, text.strip), lambda p: p != "")
    kept = [c for c in (keep if keep is not None else df.columns)]
    staged = (
        df.withColumn("_phrases", phrases)
        .withColumn("_joined", F.array_join(
            F.transform("_phrases", lambda p: F.replace(p, F.lit(SEPARATOR), F.lit(" "))), SEPARATOR
        ))
        .withColumn("_low", F.lower("_joined"))
    )
    names = wanted if wanted is not None else FEATURE_COLUMNS
    if any(n in names for n in ("lease_type", "lease_years")):
        lease = F.when(_mentions(F.col("_low"), "freehold|lease"), _lease(F.col("_phrases")))
        staged = staged.withColumn("_lease", lease)
    else:
        staged = staged.withColumn("_lease", F.lit(None).cast("struct<kind string, years int>"))
    sources = [F.col(c) for c in ("_phrases", "_joined", "_low", "_lease")]
    return staged.select(*kept, *[feature_column(n, *sources).alias(prefix + n) for n in names])
