import random
import zlib
from collections import Counter, defaultdict

import pytest

from plotwise.llm import sharding
from plotwise.llm.queries import QUERIES
from plotwise.llm.ranks import with_rank


def one_at_a_time(items, capacity):
    room, out = [], []
    for size in sorted(items, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= size]
        if not fits:
            room.append(capacity)
            fits = [(capacity, len(room) - 1)]
        shard = min(fits)[1]
        room[shard] -= size
        out.append((size, shard))
    return sorted(out), len(room)


def test_bulk_packing_equals_one_at_a_time():
    rng = random.Random(4)
    for _ in range(200):
        items = [rng.choice([1, 2, 3, 5, 8, 9, 13]) for _ in range(rng.randint(1, 60))]
        capacity, counts = rng.randint(13, 40), Counter(items)
        plan, opened = sharding.pack(list(counts.items()), capacity)
        placed = []
        for size, runs in plan.items():
            ends = [a for a, _ in runs[1:]] + [counts[size]]
            placed += [(size, shard) for (a, shard), end in zip(runs, ends) for _ in range(end - a)]
        assert (sorted(placed), opened) == one_at_a_time(items, capacity)


def test_too_large_for_the_capacity():
    with pytest.raises(ValueError):
        sharding.pack([(10, 1)], 9)
    assert sharding.pack_into([], 4) == {}


def checked(spark, rows, shards):
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot string, size string")
    out = [r.asDict() for r in sharding.into_shards(docs, shards).collect()]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out) == sorted((r[0] is None, r[0] or 0) for r in rows)
    by_shard = defaultdict(list)
    for r in out:
        assert 0 <= r["shard"] < shards
        by_shard[r["shard"]].append(r)
    for members in by_shard.values():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
    return out, by_shard


def test_groups_stay_together_and_shards_are_even(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcé ") for _ in range(rng.randint(0, 300))) for _ in range(400)]
    rows = [(i, rng.choice(texts), "x", "y") for i in range(2000)] + [(None, None, None, None), (5000, "", None, None), (5000, "", None, None)]
    out, by_shard = checked(spark, rows, 7)
    where = defaultdict(set)
    text_of = {r[0]: r[1] or "" for r in rows}
    for r in out:
        text = text_of[r["doc_id"]]
        assert r["size"] == len(text.encode()) + 16 and r["text_crc32"] == zlib.crc32(text.encode())
        where[text].add(r["shard"])
    assert all(len(s) == 1 for s in where.values())
    sizes = [sum(r["size"] for r in m) for m in by_shard.values()]
    assert len(sizes) == 7 and max(sizes) <= 1.03 * min(sizes)


def test_a_group_larger_than_an_even_shard_stands_alone(spark):
    rows = [(i, "same text", None, None) for i in range(600)] + [(1000 + i, f"other {i}", None, None) for i in range(600)]
    out, by_shard = checked(spark, rows, 6)
    assert len({r["shard"] for r in out if r["doc_id"] < 1000}) == 1
    alone = next(r["shard"] for r in out if r["doc_id"] < 1000)
    sizes = [sum(r["size"] for r in m) for s, m in by_shard.items() if s != alone]
    assert len(by_shard[alone]) == 600 and len(sizes) == 5 and max(sizes) <= 1.05 * min(sizes)


def test_few_rows(spark):
    checked(spark, [(1, "a" * 100_000, None, None), (2, "b", None, None)], 5)
    checked(spark, [], 5)


def test_fixed_capacity_opens_few_shards(spark):
    rows = [(i, "x" * (i % 50) + str(i), None, None) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot string, size string")
    out = sharding.into_capacity(docs, 500).collect()
    total = defaultdict(int)
    for r in out:
        total[r["shard"]] += r["size"]
    assert max(total.values()) <= 500 and len(total) <= -(-sum(total.values()) // 500) + 1


def test_ranks_are_gapless(spark):
    df = spark.range(1000).selectExpr("id % 3 as g", "id div 2 as o")
    got = defaultdict(list)
    for r in with_rank(df, "g", ["o"], "rank").collect():
        got[r["g"]].append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in got.values()) and len(got) == 3


def test_query_on_given_table(spark):
    sf = "/root/testdata/sf0.001"
    out = QUERIES["op7_sharding"](spark, sf).collect()
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in out) == sorted(text)
    where = defaultdict(set)
    for r in out:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 40
        assert r["size"] == len(text[r["doc_id"]].encode()) + 16
        where[text[r["doc_id"]]].add(r["shard"])
    assert sum(len(s) > 1 for s in where.values()) == 0
