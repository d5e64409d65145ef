"""Sample that matches target category proportions (problem 4).

Usable rows are cleaned and reduced to one per id; categories are counted; integer quotas are given
out by largest remainder with minimum floors and availability caps; each category gives its rows with
the smallest random keys; categories that cannot be filled are reported.

The quota step works on one row per target category (a fixed list). The choice of rows never ranks a
category in one task: keys fall into key ranges, ranges are counted, whole ranges below the quota are
taken and only the one range at its edge is ranked; a category that holds a third of all rows is spread
over as many tasks as it has ranges.

Edge cases: rows with a null or blank id, split, call_bucket or generator are not usable; an id counts
once, by its usable row with the lowest row_index (row_index is unique); ids outside every target cell
count in N but in no cell; an empty table gives N = 0, quotas 0 and every cell with min_rows > 0 short.
Input columns other than the six used are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from callweave.session import BROADCAST_IDS, cut

CELL = ["split", "call_bucket", "generator"]
#: Rows of one key range, about: the edge range is ranked in one task.
RANGE_ROWS = 20_000


def clean(column: str) -> Column:
    """Upper/lower case, outer spaces, and space or hyphen for underscore aside; blank becomes null."""
    value = F.regexp_replace(F.lower(F.trim(F.col(column))), r"[\s-]+", "_")
    return F.when(value != "", value)


def usable_ids(candidates: DataFrame) -> DataFrame:
    """One row per usable id: id, row_index and the cleaned category columns of its first usable row."""
    rows = candidates.select("row_index", "id", *(clean(c).alias(c) for c in CELL)).dropna()
    first = rows.groupBy("id").agg(F.min(F.struct("row_index", *CELL)).alias("f"))
    return first.select("id", "f.*")


def cell_counts(usable: DataFrame, targets: DataFrame, fraction: float = 0.25) -> DataFrame:
    """Each target cell with available ids, N, sample size and needed rows (all counts over all rows)."""
    counts = cut(usable.groupBy(*CELL).agg(F.count("*").alias("available")))  # a few rows, used twice
    total = counts.agg(F.coalesce(F.sum("available"), F.lit(0)).alias("n"))
    keyed = targets.select(*(F.col(c).alias(f"t_{c}") for c in CELL), *(clean(c).alias(c) for c in CELL), "target_share", "min_rows")
    return (
        keyed.withColumn("n_usable", total.scalar())
        .withColumn("size", F.floor(F.col("n_usable") * fraction))
        .join(counts, CELL, "left")
        .select(*(F.col(f"t_{c}").alias(c) for c in CELL), "target_share", "min_rows", F.coalesce("available", F.lit(0)).cast("long").alias("available"), "n_usable", "size")
        .withColumn("needed", F.greatest(F.col("min_rows").cast("long"), F.ceil(F.col("target_share") * F.col("size"))))
    )


def allocate(cells: list[dict], size: int) -> list[int]:
    """Integer quotas by largest remainder, with floors and caps, for the cells of a fixed target list.

    Every cell starts at min(min_rows, available). The rest of `size` is shared in proportion to
    target_share: cells whose floor or cap binds are fixed there and leave the sharing; then the whole
    parts are given and the largest remainders (ties: list order) get one more each. What capped cells
    cannot take goes to the others, so the sum is min(size, all available) unless the floors exceed it.
    """
    cap = [c["available"] for c in cells]
    low = [min(c["min_rows"], k) for c, k in zip(cells, cap)]
    quota, open_ = low[:], [i for i, c in enumerate(cells) if cap[i] > low[i] and c["target_share"] > 0]
    while open_:
        left = size - sum(q for i, q in enumerate(quota) if i not in set(open_))
        share = sum(cells[i]["target_share"] for i in open_)
        ideal = {i: max(0.0, left * cells[i]["target_share"] / share) for i in open_}
        over, under = [i for i in open_ if ideal[i] >= cap[i]], [i for i in open_ if ideal[i] <= low[i]]
        excess = sum(ideal[i] - cap[i] for i in over) - sum(low[i] - ideal[i] for i in under)
        fixed = (over if excess >= 0 else under) or over or under
        if not fixed:
            whole = {i: int(ideal[i]) for i in open_}
            extra = max(0, left - sum(whole.values()))
            for n, i in enumerate(sorted(open_, key=lambda i: (whole[i] - ideal[i], i))):
                quota[i] = min(cap[i], whole[i] + (n < extra))
            break
        for i in fixed:
            quota[i] = cap[i] if fixed is over else low[i]
        open_ = [i for i in open_ if i not in set(fixed)]
    return quota


_QUOTA = T.StructType([T.StructField(c, T.StringType()) for c in CELL] + [T.StructField(c, T.LongType()) for c in ("quota", "shortfall")])


def shortfalls(cells: list[dict], size: int) -> list[int]:
    """What each cell lacks of max(min_rows, its share of `size` rounded up) because its availability caps it.

    The cap is that of `allocate`: a cell is short if and only if it were so with every row that it has.
    """
    return [max(0, max(c["min_rows"], math.ceil(c["target_share"] * size)) - c["available"]) for c in cells]


def quotas(counts: DataFrame) -> tuple[DataFrame, int]:
    """Quota and shortfall of each cell of `cell_counts`, and the sample size; the target list is fixed and small."""
    cells = [r.asDict() for r in counts.orderBy(*CELL).collect()]
    size = cells[0]["size"] if cells else 0
    rows = [(*(c[k] for k in CELL), q, s) for c, q, s in zip(cells, allocate(cells, size), shortfalls(cells, size))]
    return counts.sparkSession.createDataFrame(rows, _QUOTA), size


def draw(usable: DataFrame, quota: DataFrame, n_usable: int, seed: int = 42) -> DataFrame:
    """The rows with the smallest random keys of each cell, as many as its quota."""
    ranges = max(16, -(-n_usable // RANGE_ROWS))
    named = quota.select(*(clean(c).alias(c) for c in CELL), *(F.col(c).alias(f"t_{c}") for c in CELL), "quota")
    key = F.md5(F.concat(F.lit(f"{seed}-"), F.col("id").cast("string")))
    rows = (
        usable.join(F.broadcast(named), CELL)  # one row per target cell
        .withColumn("key", key)
        .withColumn("range", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * ranges / F.lit(1 << 32)))
    )
    counted = rows.groupBy(*CELL, "quota", "range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy(*CELL).orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    plan = counted.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < F.col("quota")).select(*CELL, "range", "before", (F.col("before") + F.col("n") <= F.col("quota")).alias("whole"))
    plan = cut(plan)  # one row a cell and key range: one for each RANGE_ROWS rows
    kept = rows.join(F.broadcast(plan) if plan.count() <= BROADCAST_IDS else plan, [*CELL, "range"])
    edge = kept.where(~F.col("whole")).withColumn("rank", F.row_number().over(W.partitionBy(*CELL, "range").orderBy("key", "id")))
    edge = edge.where(F.col("before") + F.col("rank") <= F.col("quota")).drop("rank")
    out = kept.where("whole").unionByName(edge)
    return out.select("id", "row_index", *(F.col(f"t_{c}").alias(c) for c in CELL))


def _drawn(candidates: DataFrame, targets: DataFrame, fraction: float, seed: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Counts, quotas and rows of the sample, and its size; the usable ids are written once and used for all."""
    usable = cut(usable_ids(candidates))
    counts = cut(cell_counts(usable, targets, fraction))
    quota, size = quotas(counts)
    return counts, quota, draw(usable, quota, usable.count(), seed), size


def sample(candidates: DataFrame, targets: DataFrame, fraction: float = 0.25, seed: int = 42) -> DataFrame:
    """The sample: id, row_index and category as spelled in the targets."""
    return _drawn(candidates, targets, fraction, seed)[2]


def report(candidates: DataFrame, targets: DataFrame, fraction: float = 0.25, seed: int = 42) -> DataFrame:
    """Per cell: needed, available, quota, rows drawn, shares wanted and reached, and how far it falls short."""
    counts, quota, rows, size = _drawn(candidates, targets, fraction, seed)
    drawn = rows.groupBy(*CELL).agg(F.count("*").alias("drawn"))  # a row a cell, as are all of these
    out = counts.join(F.broadcast(quota), CELL).join(F.broadcast(drawn), CELL, "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    return out.select(*CELL, "target_share", "min_rows", "needed", "available", "quota", "drawn", (F.col("drawn") / F.lit(float(max(size, 1)))).alias("actual_share"), "shortfall")


def found(candidates: DataFrame, targets: DataFrame) -> DataFrame:
    """p4_found: the cells of the drawn sample's report that fall short."""
    return report(candidates, targets).where("shortfall > 0").select(*CELL)
