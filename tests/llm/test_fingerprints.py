import hashlib
import random
from collections import Counter

from plotwise.llm import fingerprints
from plotwise.llm.queries import QUERIES


def reference(spark, texts):
    """Fingerprints by counting votes in Python over the engine's term hashes."""
    words = {w for t in texts for w in terms_of(t)}
    rows = spark.createDataFrame([(w,) for w in words], "w string").selectExpr("w", "xxhash64(w) h").collect()
    code = {r["w"]: r["h"] & (1 << 64) - 1 for r in rows}
    out = {}
    for t in texts:
        ws = terms_of(t)
        total = sum(map(len, ws))
        out[t] = sum(1 << k for k in range(64) if 2 * sum(len(w) for w in ws if code[w] >> k & 1) > total)
    return out


def terms_of(text):
    return text.lower().replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")


def expected(rows):
    """(doc_id, edited text, next text) of each row, next by descending id."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for i, (doc_id, text) in enumerate(order):
        text, following = text or "", order[i - 1][1] or ""
        half = len(text) // 2
        out.append((doc_id, text[: len(text) - half] + following[:half], following))
    return out


def check(spark, rows):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fingerprint string")
    got = fingerprints.compare_with_edits(docs).collect()
    want = expected(rows)
    text_of = dict(rows)
    prints = reference(spark, [t or "" for _, t in rows] + [e for _, e, _ in want])
    left = Counter((r["doc_id"], r["edited_sha256"], *(r[c] & (1 << 64) - 1 for c in ("fingerprint", "edited_fingerprint", "next_fingerprint"))) for r in got)
    assert left == Counter((i, hashlib.sha256(e.encode()).hexdigest(), prints[text_of[i] or ""], prints[e], prints[n]) for i, e, n in want)


def test_edits_and_fingerprints(spark):
    rng = random.Random(2)
    words = ["tion", "the", "éà", "x", "Wörter", "9", "\t", "a\nb"]
    rows = [(i * 7 % 101, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(101)]
    check(spark, rows + [(1000, None), (1001, ""), (None, "no id here"), (-5, "😀 code points 😀")])


def test_one_row_and_none(spark):
    check(spark, [(5, "only this one")])
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert fingerprints.compare_with_edits(docs).count() == 0


def test_skewed_ids(spark):
    check(spark, [(i, f"text number {i}") for i in range(40)] + [(10 ** 15, "far away"), (-10 ** 15, "far back")])


def test_repeated_rows_stay(spark):
    docs = spark.createDataFrame([(1, "a b c")] * 3 + [(2, "d e")], "doc_id long, text string")
    got = fingerprints.compare_with_edits(docs).collect()
    assert Counter(r["doc_id"] for r in got) == Counter({1: 3, 2: 1})
    assert len({r["fingerprint"] for r in got if r["doc_id"] == 1}) == 1


def test_search_finds_all_within_the_radius(spark):
    rng = random.Random(9)
    centres = [rng.getrandbits(64) for _ in range(30)]
    prints = [c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centres for _ in range(6)] + [0, (1 << 64) - 1, 1 << 63]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in [*signed, signed[0], None]], "fingerprint long")
    for radius in (0, 1, 3):
        got = Counter((r["query"], r["fingerprint"]) for r in fingerprints.within_radius(df, df, radius).collect())
        want = {(a, b) for a in set(signed) for b in set(signed) if bin((a ^ b) & (1 << 64) - 1).count("1") <= radius}
        assert set(got) == want and max(got.values()) == 1


def test_query_on_given_table(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in QUERIES["op8_fingerprints"](spark, sf).collect()}
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert len(got) == len(rows)
    same = {}
    for doc_id, edited, _ in expected(rows):
        r = got[doc_id]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert same.setdefault(dict(rows)[doc_id], r["fingerprint"]) == r["fingerprint"]
        assert (r["n_near"] is None) == (doc_id % 100 != 0)
    edits, others = [r["near_edited"] for r in got.values()], [r["near_next"] for r in got.values()]
    assert sum(edits) > sum(others)
    for doc_id in (0, 100):
        a = int(got[doc_id]["fingerprint"], 16)
        assert got[doc_id]["n_near"] == sum((a ^ int(r["fingerprint"], 16)).bit_count() <= 3 for r in got.values()) - 1
