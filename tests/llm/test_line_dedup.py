import random
from collections import Counter

from plotwise.llm import line_dedup
from plotwise.llm.queries import QUERIES


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def line_units(line, min_chars):
    """A list of words, or a tuple of the code points of a long line without a blank."""
    return tuple(line) if min_chars is not None and len(line) >= min_chars and " " not in line else line.split(" ")


def expected(docs, min_words, near_words, min_chars=None):
    """Every line against every earlier one; rows equal in id and text are one document."""
    places = []
    for doc_id, digest, text in sorted(set(docs), key=lambda d: (d[0] is not None, d[0] or 0, d[1])):
        places += [((doc_id, text), i, line_units(line.strip(" ").lower(), min_chars)) for i, line in enumerate(text.split("\n") if text is not None else [])]
    gone = {}
    for k, (doc, i, words) in enumerate(places):
        long_enough = min_chars is not None and len("".join(words)) + len(words) - 1 >= min_chars or isinstance(words, tuple)
        if len(words) < min_words and not long_enough:
            continue
        for _, _, before in places[:k]:
            if type(words) is not type(before):
                continue
            near = len(words) >= near_words and len(before) >= near_words and abs(len(words) - len(before)) <= 1 and distance(words, before) <= 1
            if words == before or near:
                gone.setdefault(doc, set()).add(i)
                break
    return gone


def check(spark, rows, min_words=3, near_words=4, min_chars=None):
    docs = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, line_no string, n_lines int")
    digests = {(r["doc_id"], r["text"]): r["h"] for r in docs.selectExpr("doc_id", "text", "xxhash64(text) h").collect()}
    gone = expected([(i, digests[i, t], t) for i, t in rows], min_words, near_words, min_chars)
    out = line_dedup.without_repeats(docs, min_words, near_words, min_chars=min_chars)
    assert out.columns == ["doc_id", "text", "line_no", "n_lines", "n_removed"]
    want = Counter()
    for doc_id, text in rows:
        lines = text.split("\n") if text is not None else []
        kept = [x for i, x in enumerate(lines) if i not in gone.get((doc_id, text), ())]
        want[doc_id, "\n".join(kept) if text is not None else None, len(lines), len(lines) - len(kept)] += 1
    assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in out.collect()) == want


def test_against_brute_force(spark):
    rng = random.Random(6)
    bases = [[rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))] for _ in range(12)]

    def line():
        words = list(rng.choice(bases))
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(words) + 1)
            words[at: at + rng.randint(0, 1)] = [rng.choice("abcdefghxyz")] if rng.random() < 0.7 else []
        return rng.choice(["", " "]) + " ".join(words).upper() if rng.random() < 0.2 else " ".join(words)

    check(spark, [(i, "\n".join(line() for _ in range(rng.randint(1, 6)))) for i in range(60)])


def test_edge_rows(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    check(spark, [
        (1, None), (2, ""), (3, "\n\n"), (4, "a b c d e\na b c d e"), (4, "a b c d e\na b c d e"), (4, "a b c d e\nother words here now"), (None, "a b c d e"),
        (5, long), (6, long + " more"), (7, long.replace("w1500 ", "")), (8, "d c b a e f\nx"), (9, "É ü 漢 字 z\né ü 漢 字 z"), (10, "a  b c d e"),
    ])
    check(spark, [])


def test_permuted_words_are_not_near(spark):
    check(spark, [(1, "a b a c a b"), (2, "a c a b a b x"), (3, "a b a c a b x"), (4, "b a c a b a")])


def test_many_variants_of_one_line(spark):
    rows = [(i, f"one two three four five six seven {i} nine ten") for i in range(300)] + [(500, "unrelated line with enough different words in it")]
    check(spark, rows)


def test_large_tables_are_shuffled(spark, monkeypatch):
    from plotwise.llm import sizes

    monkeypatch.setattr(sizes.if_few, "__defaults__", (0,))
    check(spark, [(1, "a b c d e f"), (2, "a b x d e f\nq r s t u"), (3, "a b c e f\nq r s t u")])


def test_lines_without_blanks_and_few_long_words(spark):
    rng = random.Random(8)
    bases = ["".join(rng.choice("版权所有未经许可不得转载漢字") for _ in range(rng.randint(6, 24))) for _ in range(10)]
    bases += ["all rights reserved", "a b c d e f g h", "abcdefgh", "short", "𝒳𝒴𝒵𝒳𝒴𝒵𝒳𝒴𝒵é"]

    def line():
        text = rng.choice(bases)
        at = rng.randrange(len(text) + 1)
        return rng.choice([text, text, text[:at] + rng.choice("新x ") + text[at:], text[:at] + text[at + 1:], text[:at] + "零" + text[at + 1:]])

    check(spark, [(i, "\n".join(line() for _ in range(rng.randint(1, 5)))) for i in range(60)], 5, 8, 8)


def test_letters_are_not_words(spark):
    rows = [(1, "abcdefghij\na b c d e f g h i j"), (2, "abcdefghix\na b c d e f g h i x"), (3, "all rights reserved"), (4, "All Rights Reserved\nfew")]
    check(spark, rows, 5, 8, 8)
    check(spark, rows + [(5, "漢" * 5000), (6, "漢" * 5001), (7, None), (8, "")], 5, 8, 8)


def test_query_on_given_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "xxhash64(text) h", "text").collect()
    gone = expected([tuple(d) for d in docs], line_dedup.MIN_WORDS, line_dedup.NEAR_WORDS, line_dedup.MIN_CHARS)
    got = {r["doc_id"]: r for r in QUERIES["op5_line_dedup"](spark, sf).collect()}
    for doc_id, _, text in docs:
        kept = [x for i, x in enumerate(text.split("\n")) if i not in gone.get((doc_id, text), ())]
        assert got[doc_id]["text"] == "\n".join(kept)
    assert len(got) == len(docs) and gone
