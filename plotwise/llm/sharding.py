"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Rows with equal text form a group. Groups are reduced to counts by size; the packing
works on these counts, largest size first, each group entering the fullest shard that
still has room. Groups of one size go in bulk: the fullest shard with room stays so until
it has no room for one more. The plan, a few shards for each size, is joined back, and
groups find their place by their rank among groups of their size.

Groups are never cut. Where shards are to be nearly equal, a group with more bytes than
an even share of what is left gets a shard of its own, and the others share the rest.
A shard may so hold most rows, but no task does: shards are numbered in slices. Null
texts count as empty ones and form a group with them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from plotwise.llm.ranks import with_rank
from plotwise.session import materialise

#: Bytes that a row takes besides its text.
ROW_BYTES = 16
#: Sizes up to this are kept exactly; beyond, they are rounded up to 1/2**15 of their
#: magnitude, so that the number of different sizes stays bounded.
EXACT = 1 << 16


@dataclass
class Node:
    key: tuple[int, int]
    priority: int
    left: Node | None = None
    right: Node | None = None


class CapacityTree:
    """Balanced search tree (treap) of (room, shard)."""

    def __init__(self):
        self.root: Node | None = None

    def split(self, node: Node | None, key: tuple[int, int]) -> tuple[Node | None, Node | None]:
        """The parts below ``key`` and from it on."""
        if node is None:
            return None, None
        if node.key < key:
            node.right, rest = self.split(node.right, key)
            return node, rest
        rest, node.left = self.split(node.left, key)
        return rest, node

    def join(self, a: Node | None, b: Node | None) -> Node | None:
        if a is None or b is None:
            return a or b
        if a.priority > b.priority:
            a.right = self.join(a.right, b)
            return a
        b.left = self.join(a, b.left)
        return b

    def insert(self, room: int, shard: int) -> None:
        low, high = self.split(self.root, (room, shard))
        node = Node((room, shard), hash((room * 0x9E3779B1, shard)))
        self.root = self.join(self.join(low, node), high)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the shard with the least room that is at least ``size``."""
        low, high = self.split(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        node = high
        while node.left is not None:
            node = node.left
        _, rest = self.split(high, (node.key[0], node.key[1] + 1))
        self.root = self.join(low, rest)
        return node.key


def pack(sizes: list[tuple[int, int]], capacity: int) -> tuple[dict[int, list[tuple[int, int]]], int]:
    """Best-fit decreasing of (size, count) into shards of ``capacity``.

    Returns, for each size, (rank of the first group, shard) in order, and the number of
    shards opened. Equal to placing the groups one at a time.
    """
    tree, opened, plan = CapacityTree(), 0, {}
    for size, count in sorted(sizes, reverse=True):
        if size > capacity:
            raise ValueError(f"a group of {size} bytes does not fit into {capacity}")
        rank, runs = 0, []
        while rank < count:
            found = tree.take_tightest(size)
            if found is None:
                found, opened = (capacity, opened), opened + 1
            room, shard = found
            taken = min(count - rank, room // size)
            runs.append((rank, shard))
            rank += taken
            tree.insert(room - taken * size, shard)
        plan[size] = runs
    return plan, opened


def pack_into(sizes: list[tuple[int, int]], shards: int) -> dict[int, list[tuple[int, int]]]:
    """A plan for ``shards`` nearly equal shards.

    Groups above an even share of what is left stand alone, largest first. The rest is
    packed at the smallest capacity, found by bisection, for which the other shards do.
    """
    left = sum(s * n for s, n in sizes)
    plan: dict[int, list[tuple[int, int]]] = {}
    rest, alone = sorted(sizes, reverse=True), 0
    while rest and shards - alone > 1 and rest[0][0] * (shards - alone) > left:
        size, count = rest[0]
        plan.setdefault(size, []).append((len(plan.get(size, [])), alone))
        alone, left = alone + 1, left - size
        rest = ([(size, count - 1)] if count > 1 else []) + rest[1:]
    for size, runs in balanced(rest, shards - alone).items():
        before = len(plan.get(size, []))
        plan.setdefault(size, []).extend((before + rank, alone + shard) for rank, shard in runs)
    return plan


def balanced(sizes: list[tuple[int, int]], shards: int) -> dict[int, list[tuple[int, int]]]:
    total = sum(s * n for s, n in sizes)
    low = max([-(-total // shards), *(s for s, _ in sizes)], default=0)
    plan, opened = pack(sizes, low)
    if opened <= shards:
        return plan
    high = low
    while opened > shards:
        high += max(1, high // 100)
        plan, opened = pack(sizes, high)
    while high - low > max(1, low // 10_000):
        middle = (low + high) // 2
        tried, opened = pack(sizes, middle)
        if opened <= shards:
            plan, high = tried, middle
        else:
            low = middle
    return plan


def size_class(size):
    """The size as it is packed: never below the real one."""
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(size)) - 15, F.lit(0))).cast("long")
    return F.when(size <= EXACT, size).otherwise(F.ceil(size / step).cast("long") * step)


def shard(docs: DataFrame, planner: Callable[[list[tuple[int, int]]], dict], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row, for a plan made from the sizes."""
    content = F.coalesce(F.col(text), F.lit(""))
    rows = materialise(docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(content) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(content).alias("text_crc32"), F.xxhash64(content).alias("text_hash"),
    ), "shard-rows")
    key = ["text_hash", "text_crc32", "size"]
    groups = rows.groupBy(*key).agg(F.count("*").alias("n")).withColumn("class", size_class(F.col("n") * F.col("size")))
    groups = materialise(groups, "shard-groups")
    plan = planner([(r["class"], r["count"]) for r in groups.groupBy("class").count().collect()])
    runs = rows.sparkSession.createDataFrame(
        [(c, [{"first": a, "shard": s} for a, s in placed]) for c, placed in sorted(plan.items())],
        "class long, runs array<struct<first: long, shard: int>>")
    placed = with_rank(groups, "class", key, "rank").join(runs, "class").select(
        *key, F.element_at(F.filter("runs", lambda r: r["first"] <= F.col("rank")), -1)["shard"].alias("shard"))
    sharded = rows.join(placed, key).select("doc_id", "size", "text_crc32", "shard")
    return with_rank(sharded, "shard", ["doc_id", "size", "text_crc32"], "slot")


def into_shards(docs: DataFrame, shards: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows in shards 0 to ``shards`` - 1 of nearly equal bytes."""
    return shard(docs, lambda sizes: pack_into(sizes, shards), text, doc_id)


def into_capacity(docs: DataFrame, capacity: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows in as few shards of ``capacity`` bytes as best-fit decreasing needs.

    A group larger than the capacity is an error.
    """
    return shard(docs, lambda sizes: pack(sizes, capacity)[0], text, doc_id)
