import json

import pytest

from plotwise.functions.features import (
    BOOLEAN_FEATURES, BOOLEAN_PATTERNS, FEATURE_COLUMNS, PATTERN_WORDS, parse_features,
)

# (column, phrases that set it, phrases that do not)
BOOLEAN_CASES = [
    ("double_glazed", ["Double glazed windows", "double  glazing"], ["single glazed"]),
    ("period_property", ["Period features"], ["period drama"]),
    ("ensuite", ["En-suite to master", "ensuite", "en suite"], ["suite"]),
    ("cloakroom", ["Downstairs WC", "separate wc"], ["wc"]),
    ("gym", ["Residents gym"], ["gymnasium"]),
    ("lift", ["Lift", "lift access", "Elevator"], ["lifted ceilings", "Lift to all floors"]),
    ("study", ["Study", "Study / bedroom four", "Home  office"],
     ["A long phrase about a quiet study for the whole family"]),
    ("white_goods", ["Dishwasher included"], ["white walls"]),
    ("cellar", ["Wine cellar", "Basement", "basement room"], ["Basement flat"]),
    ("extended", ["Extended in 2015", "Side return"], ["Potential to be extended"]),
    ("side_access", ["Side access to garden"], ["Side return extension"]),
    ("separate_living_room", ["Living room", "Spacious sitting room"], ["Living room with fire"]),
    ("views", ["River views", "Views over the park"], ["viewing advised"]),
    ("listed_building", ["Grade II listed", "Listed building"], ["listed with us"]),
    ("needs_modernisation", ["In need of some modernisation"], ["modernised"]),
    ("potential_to_extend", ["Potential to extend STPP", "subject to planning"], ["extended"]),
    ("outbuilding", ["Summer house", "Garden office"], ["gardens"]),
    ("annexe", ["Annexe", "self-contained annex"], ["annexed"]),
    ("refurbished", ["Newly decorated", "Recently refurbished"], ["decorated"]),
    ("snug", ["Snug"], ["snuggle"]),
    ("stables", ["Stables and paddock", "Equestrian facilities"], ["stability"]),
    ("hot_tub", ["Jacuzzi"], ["tub"]),
    ("original_features", ["Retaining many original details"], ["original"]),
    ("allocated_parking", ["Allocated parking"], ["parking"]),
]


def parse(spark, lists):
    df = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(lists)], "id int, extra_features string")
    return [r.asDict() for r in parse_features(df, keep=("id",)).orderBy("id").collect()]


def test_there_are_112_columns():
    assert len(FEATURE_COLUMNS) == len(set(FEATURE_COLUMNS)) == 112
    assert set(BOOLEAN_PATTERNS) == set(PATTERN_WORDS)
    assert set(BOOLEAN_FEATURES) - set(BOOLEAN_PATTERNS) == {"chain_free"}


def test_boolean_columns(spark):
    lists, expected = [], []
    for column, yes, no in BOOLEAN_CASES:
        for phrase in yes:
            lists.append(["Something else", phrase]), expected.append((column, phrase, True))
        for phrase in no:
            lists.append(["Something else", phrase]), expected.append((column, phrase, None))
    rows = parse(spark, lists)
    wrong = [(c, p, r[c]) for (c, p, want), r in zip(expected, rows) if r[c] is not want]
    assert wrong == []


def test_patterns_do_not_cross_phrases(spark):
    row = parse(spark, [["double", "glazed", "in need", "of modernisation", "council tax", "band A", "home", "office suite"]])[0]
    assert row["double_glazed"] is None
    assert row["needs_modernisation"] is None
    assert row["council_tax_band"] is None


LABEL_CASES = [
    (["EPC rating: C"], {"epc_rating": "C"}),
    (["energy efficiency rating d"], {"epc_rating": "D"}),
    (["Council Tax Band - D"], {"council_tax_band": "D"}),
    (["End of chain", "No onward chain"], {"chain_free": False}),
    (["No onward chain", "End of chain"], {"chain_free": True}),
    (["Driveway", "Garage"], {"parking": "Driveway"}),
    (["Garage and driveway"], {"parking": "Garage"}),
    (["Off-street parking"], {"parking": "Off-street"}),
    (["Roof terrace"], {"garden": "Terrace", "roof_terrace": True}),
    (["Terrace house with roof"], {"garden": None}),
    (["Communal gardens"], {"garden": "Communal Garden"}),
    (["Private rear garden"], {"garden": "Private Garden", "rear_garden": True}),
    (["Gas central heating"], {"heating": "Gas Central"}),
    (["Electric heating"], {"heating": "Electric"}),
    (["Underfloor heating"], {"heating": "Underfloor", "underfloor_heating": True}),
    (["Oil heating"], {"heating": "Other"}),
    (["Leasehold 125 years remaining"], {"lease_type": "Leasehold", "lease_years": 125}),
    (["Freehold", "Share of freehold"], {"lease_type": "Share of Freehold"}),
    (["Freehold", "99 year lease"], {"lease_type": "Freehold", "lease_years": 99}),
    (["Lease of 90 years", "Freehold"], {"lease_type": "Leasehold", "lease_years": 90}),
    (["Two reception rooms"], {"receptions": 2}),
    (["3 receptions"], {"receptions": 3}),
    (["Large reception room with two windows"], {"receptions": 2}),
    (["Unfurnished."], {"furnished": "Unfurnished"}),
    (["Furnished or unfurnished"], {"furnished": "Flexible"}),
    (["Part-furnished"], {"furnished": "Part Furnished"}),
    (["Fourth floor"], {"floor_level": "Upper"}),
    (["Lower ground flat"], {"floor_level": "Ground"}),
    (["85 sq m", "1,200 sq ft"], {"sq_ft": 1200}),
    (["85 sq m"], {"sq_ft": 915}),
    (["Service charge £1,165.70 pa"], {"service_charge": 1165}),
    (["Ground rent - £250 pa"], {"ground_rent": 250}),
    (["0.4 miles to the station"], {"distance_to_station": 0.4}),
    (["0.4 miles to shops"], {"distance_to_station": None}),
    (["South facing garden"], {"garden_facing": "South"}),
    (["Victorian terrace"], {"property_era": "Victorian"}),
    (["In good condition"], {"condition": "Good"}),
    (["Kitchen/diner"], {"kitchen_type": "Kitchen Diner"}),
    (["Set in 1.5 acres"], {"acre_plot": 1.5}),
    (["Acreage available"], {"acre_plot": 1.0}),
]


def test_labels_and_numbers(spark):
    rows = parse(spark, [phrases for phrases, _ in LABEL_CASES])
    wrong = [
        (phrases, column, row[column]) for (phrases, want), row in zip(LABEL_CASES, rows)
        for column, value in want.items() if row[column] != value
    ]
    assert wrong == []


@pytest.mark.parametrize("raw", [None, "", "not json", "[]", '{"a": 1}', '"text"'])
def test_nothing_to_parse(spark, raw):
    df = spark.createDataFrame([(raw,)], "extra_features string")
    row = parse_features(df, keep=()).first()
    assert all(v is None for v in row)


def test_array_input_and_selection(spark):
    df = spark.createDataFrame([(1, [" Garage ", ""])], "id int, phrases array<string>")
    out = parse_features(df, source="phrases", wanted=("parking", "gym"), keep=("id",))
    assert out.columns == ["id", "parking", "gym"]
    assert out.first() == (1, "Garage", None)
