import hashlib
import re

import numpy as np
import pytest

from plotwise.llm import pii
from plotwise.llm.queries import QUERIES

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def digit_sum(digits):
    doubled = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(digits[::-1])]
    return sum(sum(map(int, str(n))) for n in doubled)


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and digit_sum(digits) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def plain(text):
    out = [(m.start(), i, k, m.end()) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if holds(k, m[0])]
    return [(k, a, b) for a, _, k, b in sorted(out)]


CASES = [
    "", "a@b.c", "x.y@z", "@b.co", "a@b@c.de f", "a..b%+@c-.d.e.", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1.1 01.02.03.004", "1.2.3.x 9.8.7.6",
    "4111 1111 1111 1111 4111-1111-1111-1112", "1 2 3 4", "4111111111111111 2", "+1 (554) 555-5882 +12 3456 +1((((((((", "+1+2+33 444 555 6666",
    "é@b.cd ü.x@y.zé", "4444333322221111", "00000000000000", "1" * 5000, "١٢٣.1.1.1", "a" * 100_000 + "@", "+1234567890123456",
]


@pytest.mark.parametrize("text", CASES)
def test_patterns(text):
    got = pii.in_order(pii.base_spans(text), pii.KINDS)
    assert [(s["kind"], s["start"], s["end"]) for s in got] == plain(text)


def test_reliable_and_noisy_labelers_are_told_apart():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.4
    good = np.where(rng.random(4000) < 0.95, truth, ~truth) * 2 - 1
    second = np.where(rng.random(4000) < 0.85, truth, ~truth) * 2 - 1
    noise = np.where(rng.random(4000) < 0.5, 1, -1)
    cast = np.stack([good, second, np.where(rng.random(4000) < 0.9, truth, ~truth) * 2 - 1, noise], axis=1)
    _, right, likely = pii.estimate(cast, np.ones(4000))
    assert ((likely > 0.5) == truth).mean() > 0.93
    assert right[1, 0, 2] > 0.9 and abs(right[1, 3, 2] - right[0, 3, 2]) < 0.1


def test_proposals_need_more_than_a_shape(spark):
    rows = [(i, f"mail bob{i}@mail.example.com or +1 (554) 555-{i:04} from 10.0.0.{i % 250} card 4111 1111 1111 1111") for i in range(60)]
    rows += [(100, "phone: (212) 555-0123 thanks"), (101, "dear Mr. John Smith,"), (102, None), (103, ""), (104, "the word is plain"),
             (105, "version 123-45-0000"), (105, "version 123-45-0000")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, spans int")
    out = {r["doc_id"]: r["spans"] for r in pii.find(docs, pii.learn(docs)).collect()}
    assert [s["kind"] for s in out[5]] == ["email", "phone", "ip", "card"]
    assert [s["kind"] for s in out[100]] == ["local_phone"] and [s["kind"] for s in out[101]] == ["person"]
    assert out[102] == out[103] == out[104] == []


def test_labelers_are_judged_by_family():
    # The context labeler is right on phones and says nothing of cards.
    rng = np.random.default_rng(2)
    patterns = []
    for kind, of_context in (("world_phone", True), ("grouped_card", False)):
        for held in rng.random(3000) < 0.5:
            sure = [1 if (rng.random() < 0.9) == held else -1 for _ in range(3)]
            context = held if of_context else rng.random() < 0.5
            patterns.append((kind, (*sure, int(context), 0, 1), (4, 3, 4, 1), 1))
    model = pii.fit(patterns)
    phone, card = (model.right[f][1, 3, 2] - model.right[f][0, 3, 2] for f in ("phone", "card"))
    assert phone > 0.8 and abs(card) < 0.1


def test_numbers_inside_refused_runs():
    text = "phone +1 (826) 555-4081 190.137.223.20 and 4111 1111 1111 1111 2023 end"
    base, refused = pii.matches(text)
    assert [k for k, *_ in base] == ["ip"] and {k for k, *_ in refused} == {"card", "phone"}
    found = {k: text[a:b] for k, a, b, _ in pii.proposals(text, base)}
    assert found == {"world_phone": "+1 (826) 555-4081", "grouped_card": "4111 1111 1111 1111"}


def card(rng):
    head = "4" + "".join(str(x) for x in rng.integers(0, 10, 14))
    last = next(d for d in "0123456789" if pii.luhn(head + d))
    return head + last


def test_planted_data_is_caught_and_clean_texts_stay_clean(spark):
    rng = np.random.default_rng(9)

    def number(n):
        return "".join(str(x) for x in rng.integers(0, 10, n))

    def grouped(digits):
        return " ".join(digits[i: i + 4] for i in range(0, len(digits), 4))

    planted = {
        "world_phone": lambda: (f"call +1 (5{number(2)}) 5{number(2)}-{number(4)}", " 10.20.30.40"),
        "grouped_card": lambda: (f"card {grouped(card(rng))}", " 2023 2024"),
        "spelled_email": lambda: (f"mail bob{number(3)} [at] example [dot] com", ""),
        "local_phone": lambda: (f"phone: (2{number(2)}) 5{number(2)}-{number(4)}", ""),
        "national_id": lambda: (f"ssn 1{number(2)}-1{number(1)}-1{number(3)}", ""),
        "person": lambda: (f"dear Mrs. {rng.choice(['Anna', 'Laura', 'Ruth'])} Lindgren", ""),
    }
    rows, where = [], {}
    for i in range(600):
        rows.append((i, f"text with bob{i}@mail.example.com or +1 (554) 555-{i:04} and {card(rng)} at 10.0.0.{i % 250}"))
    for kind, make in planted.items():
        for _ in range(50):
            value, after = make()
            where[len(rows)] = kind
            rows.append((len(rows), f"some words {value}{after} more words"))
    clean = len(rows)
    for i in range(300):
        rows.append((len(rows), f"In 20{i % 90 + 10} chapter {i} had 1,{number(3)} pages, version 2.{i}.1, order {number(12)} and total 555-{number(2)}, {number(4)} {number(4)} {number(4)} {number(4)}1"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: {s["kind"] for s in r["spans"]} for r in pii.find(docs, pii.learn(docs)).collect()}
    for kind in planted:
        asked = [i for i, k in where.items() if k == kind]
        assert sum(kind in out[i] for i in asked) >= 0.9 * len(asked), kind
    assert not any(out[i] & set(pii.ADDED_KINDS) for i in range(clean, len(rows)))
    assert not any(out[i] & set(pii.ADDED_KINDS) for i in range(600))


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "plain words"), (2, None)], "doc_id long, text string")
    assert pii.learn(docs) is None
    assert [r["spans"] for r in pii.find(docs, None).collect()] == [[], []]
    assert pii.find(docs.limit(0), pii.learn(docs.limit(0))).count() == 0


def test_query_keeps_all_pattern_matches(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in QUERIES["op9_pii"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        want = plain(d["text"] or "")
        r = got[d["doc_id"]]
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(k == x for x, _, _ in want) for k in PATTERNS]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))
