"""Filling fixed-capacity containers (problem 7): Martello-Toth reduction, then best fit.

What has to be packed is the histogram of sizes, which has at most `capacity` rows however many
documents there are; so the packing of a capacity is solved by one small task as runs of equal
containers, and documents then find their container by their number among the documents of their
size. A text longer than the capacity is cut into full containers and one rest; no other is cut.

Reduction: going down the sizes, the largest item is fixed together with the companions that
provably dominate every other choice - nothing fits beside it; or the largest fitting item fills
the rest, or is at least as large as any fitting set; or a pair of which each member covers a member
of any fitting pair. What remains is filled by best fit in decreasing order.

Edge cases: documents without tokens (null, empty text) need no container and do not come out; equal
sizes are numbered by doc_id hash buckets and doc_id, so the result does not depend on partitioning;
an empty table gives no containers. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from callweave.llm.tokens import TOKENIZER, token_counts
from callweave.session import cut

#: Rows that one numbering task takes, about.
BUCKET_ROWS = 50_000
#: Numbers of a size that one run of slots holds.
RUN = 20_000


class _Sizes:
    """A multiset of sizes that knows its present sizes in order."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.n = {s: c for s, c in counts.items() if c > 0}
        self.order = sorted(self.n)

    def take(self, size: int, count: int) -> None:
        self.n[size] -= count
        if not self.n[size]:
            del self.n[size]
            self.order.pop(bisect_left(self.order, size))

    def largest(self, most: int, without: int = 0) -> int:
        """The largest size <= most, with one item of size `without` put aside; 0 if none."""
        i = bisect_left(self.order, most + 1) - 1
        if i >= 0 and self.order[i] == without and self.n[without] == 1:
            i -= 1
        return self.order[i] if i >= 0 else 0

    def smallest(self, count: int, without: int) -> list[int]:
        out: list[int] = []
        for s in self.order:
            out += [s] * min(count, self.n[s] - (s == without))
            if len(out) >= count:
                break
        return out[:count]


def reduce_sizes(sizes: _Sizes, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix dominating containers; returns (items, how many such containers) and takes the items out of `sizes`."""
    fixed = []
    todo = sizes.order[::-1]
    for j in todo:
        while sizes.n.get(j):
            room = capacity - j
            low = sizes.smallest(3, j)
            best = sizes.largest(room, j)
            if not best:
                items: tuple[int, ...] = (j,)
            elif best == room or len(low) < 2 or low[0] + low[1] > room:
                items = (j, best)
            elif len(low) > 2 and sum(low) <= room:
                break  # four or more may share a container: nothing is proved for this size
            else:
                pairs = _fitting_pairs(sizes, room, j)
                if max(a + b for a, b in pairs) <= best:
                    items = (j, best)
                else:
                    a = max(a for a, b in pairs if b == best) if any(b == best for _, b in pairs) else 0
                    if not a or max(c for c, _ in pairs) > a:
                        break
                    items = (j, a, best)
            need = {s: items.count(s) for s in set(items)}
            times = min(sizes.n[s] // k for s, k in need.items())
            if len(items) > 1:
                times = max(1, times if all(sizes.n[s] - (times - 1) * k > k for s, k in need.items()) else times - 1)
            fixed.append((items, times))
            for s, k in need.items():
                sizes.take(s, k * times)
    return fixed


def _fitting_pairs(sizes: _Sizes, room: int, j: int) -> list[tuple[int, int]]:
    """For each size as the smaller member of a pair within room, the largest partner."""
    out = []
    for a in sizes.order:
        if 2 * a > room:
            break
        have = sizes.n[a] - (a == j)
        if have < 1:
            continue
        b = sizes.largest(room - a, j)
        if b < a or (b == a and have < 2):
            continue
        out.append((a, b))
    return out


def best_fit(sizes: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best fit in decreasing order over a histogram: (items with multiplicity, how many such containers).

    Containers with equal contents are handled as one group; the choice for each item is that of
    item-by-item best fit, since after an item enters a container its rest is the smallest that fits.
    """
    groups: dict[int, list[tuple[object, int]]] = {}
    rests: list[int] = []

    def add(rest: int, content: object, count: int) -> None:
        if rest not in groups:
            groups[rest] = []
            insort(rests, rest)
        groups[rest].append((content, count))

    for s in sorted(sizes, reverse=True):
        n = sizes[s]
        while n:
            i = bisect_left(rests, s)
            if i < len(rests):
                rest = rests[i]
                content, have = groups[rest].pop()
                if not groups[rest]:
                    del groups[rest]
                    rests.pop(i)
            else:
                rest, content, have = capacity, None, n
            fits = rest // s
            full = min(have, n // fits)
            if full:
                add(rest - fits * s, (content, s, fits), full)
            n -= full * fits
            left = have - full
            if left and n:  # n < fits: one container takes them all
                add(rest - n * s, (content, s, n), 1)
                n, left = 0, left - 1
            if left and content is not None:
                add(rest, content, left)
    out = []
    for parts in groups.values():
        for content, count in parts:
            items = []
            while content is not None:
                content, s, k = content
                items.append((s, k))
            out.append((tuple(items), count))
    return out


def solve(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[tuple[int, int], ...], int]], int]:
    """Containers as ((size, multiplicity)..., count), and how many of them the reduction fixed."""
    sizes = _Sizes(histogram)
    fixed = reduce_sizes(sizes, capacity)
    groups = [(tuple((s, items.count(s)) for s in sorted(set(items))), n) for items, n in fixed]
    return groups + best_fit(dict(sizes.n), capacity), sum(n for _, n in fixed)


def _solve(rows: pd.DataFrame) -> pd.DataFrame:
    capacity = int(rows["capacity_tokens"].iloc[0])
    full = int(rows.loc[rows["size"] == capacity, "n"].sum())
    groups, fixed = solve({int(s): int(n) for s, n in zip(rows["size"], rows["n"]) if s < capacity}, capacity)
    if full:
        groups.insert(0, (((capacity, 1),), full))
    slots: dict[int, list[dict]] = {}
    used: dict[int, int] = {}
    bins = 0
    for items, count in groups:
        for s, k in items:
            at = used.get(s, 0)
            slots.setdefault(s, []).append({"first": at, "last": at + k * count - 1, "per": k, "bin": bins})
            used[s] = at + k * count
        bins += count
    return pd.DataFrame({"capacity_id": rows["capacity_id"].iloc[0], "size": list(slots), "slots": list(slots.values()), "fixed_bins": fixed + full, "bins": bins})


SLOTS = "capacity_id int, size long, slots array<struct<first: long, last: long, per: long, bin: long>>, fixed_bins long, bins long"


def pieces(documents: DataFrame, capacities: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """capacity_id, capacity_tokens, doc_id, part, size: each text for each capacity, cut only where it is longer."""
    sized = token_counts(documents, ["doc_id"], path).where("n_tokens > 0")
    caps = [tuple(r) for r in capacities.select("capacity_id", "capacity_tokens").dropna().where("capacity_tokens > 0").distinct().collect()]  # a fixed list
    if not caps:
        sized, caps = sized.where(F.lit(False)), [(0, 1)]
    kinds = F.array(*(F.struct(F.lit(i).alias("capacity_id"), F.lit(c).alias("capacity_tokens")) for i, c in caps))
    each = sized.select("doc_id", "n_tokens", F.explode(kinds).alias("c")).select("c.*", "doc_id", "n_tokens")
    parts = each.select("*", F.explode(F.sequence(F.lit(0), F.expr("(n_tokens - 1) div capacity_tokens").cast("int"))).alias("part"))
    return parts.select("capacity_id", "capacity_tokens", "doc_id", "part", F.least(F.col("capacity_tokens").cast("long"), F.col("n_tokens") - F.col("part").cast("long") * F.col("capacity_tokens")).alias("size"))


def plan(parts: DataFrame) -> DataFrame:
    """The packing of each capacity over its histogram (at most capacity_tokens rows each)."""
    counts = parts.groupBy("capacity_id", "capacity_tokens", "size").agg(F.count("*").alias("n"))
    return counts.groupBy("capacity_id").applyInPandas(_solve, SLOTS)


def pack(documents: DataFrame, capacities: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """capacity_id, doc_id, part, size, bin: the container of each text (part)."""
    parts = cut(pieces(documents, capacities, path))
    plans = cut(plan(parts))
    buckets = max(8, parts.count() // BUCKET_ROWS)
    parts = parts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "part"), F.lit(buckets)))
    key = ["capacity_id", "size"]
    sizes = parts.groupBy(*key, "bucket").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy(*key, "bucket").orderBy("doc_id", "part")) - 1
    before = F.coalesce(F.sum("n").over(W.partitionBy(*key).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*key, "bucket", before.alias("before"))
    numbered = parts.withColumn("rank", rank).join(offsets, [*key, "bucket"]).withColumn("number", F.col("rank") + F.col("before"))
    return placed(numbered.select(*key, "doc_id", "part", "number"), plans)


def placed(numbered: DataFrame, plans: DataFrame) -> DataFrame:
    """The container of each numbered piece: the slot of its size that holds its number.

    Slots are cut at multiples of RUN numbers and lie among the pieces in the order of their numbers, so each
    piece takes the last slot before it; a task looks at one run of a size at a time, however many pieces
    have that size.
    """
    key = ["capacity_id", "size"]
    run = F.lit(RUN).cast("long")
    slots = plans.select(*key, F.explode("slots").alias("slot"))
    slots = slots.select(*key, "slot", F.explode(F.sequence(F.expr(f"slot.first div {RUN}"), F.expr(f"slot.last div {RUN}"))).alias("run"))
    slots = slots.select(*key, "run", F.greatest(F.col("slot.first"), F.col("run") * run).alias("number"), F.lit(0).alias("is_piece"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("int").alias("part"), "slot")
    pieces_ = numbered.select(*key, F.expr(f"number div {RUN}").alias("run"), "number", F.lit(1).alias("is_piece"), "doc_id", "part", F.lit(None).cast(slots.schema["slot"].dataType).alias("slot"))
    near = W.partitionBy(*key, "run").orderBy("number", "is_piece").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = slots.unionByName(pieces_).withColumn("slot", F.last("slot", ignorenulls=True).over(near)).where("is_piece = 1")
    return both.select("capacity_id", "doc_id", "part", "size", F.expr("slot.bin + (number - slot.first) div slot.per").alias("bin"))


def report(documents: DataFrame, capacities: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """Containers, the lower bound of any packing, fixed containers and fill per capacity."""
    parts = cut(pieces(documents, capacities, path))
    tokens = parts.groupBy("capacity_id", "capacity_tokens").agg(F.sum("size").alias("tokens"), F.count("*").alias("parts"))
    bins = plan(parts).groupBy("capacity_id").agg(F.max("bins").alias("bins"), F.max("fixed_bins").alias("fixed_bins"))
    out = tokens.join(bins, "capacity_id")
    return out.select("capacity_id", "capacity_tokens", "parts", "tokens", "bins", "fixed_bins", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_bins"), (F.col("tokens") / (F.col("bins") * F.col("capacity_tokens"))).alias("fill"))
