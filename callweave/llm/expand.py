"""Pairs of rows from pairs of classes, without a task that holds a large class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.session import BROADCAST_IDS, cut

#: Rows of a class in one block, about: a task joins a link with one block of either side.
BLOCK_ROWS = 5_000


def class_sizes(members: DataFrame, cls: str) -> DataFrame:
    """(cls, n) of a table of members, written once."""
    return cut(members.groupBy(cls).agg(F.count("*").alias("n")))


def _with(df: DataFrame, blocks: DataFrame, n: int, cls: str) -> DataFrame:
    return df.join(F.broadcast(blocks) if n <= BROADCAST_IDS else blocks, cls, "left")


def row_pairs(links: DataFrame, left: DataFrame, right: DataFrame, left_sizes: DataFrame, right_sizes: DataFrame) -> DataFrame:
    """(row_x, row_y) for each link (a, b) of classes, from left (a, row_x) and right (b, row_y).

    The sizes are materialised tables (class, n) under the same names. A class of very many rows is cut into
    blocks by the hash of the row, and its links are repeated for each block, so the pairs of one link are made
    by as many tasks as it has pairs of blocks.
    """
    for rows, sizes, row, cls, block in ((left, left_sizes, "row_x", "a", "i"), (right, right_sizes, "row_y", "b", "j")):
        large = sizes.where(F.col("n") > BLOCK_ROWS).select(cls, F.ceil(F.col("n") / BLOCK_ROWS).cast("long").alias("blocks"))  # at most one for each BLOCK_ROWS rows
        n = large.count()
        if n:
            rows = _with(rows, large, n, cls).withColumn(block, F.pmod(F.xxhash64(row), F.coalesce("blocks", F.lit(1)))).drop("blocks")
            links = _with(links, large, n, cls).withColumn(block, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
            links = links.join(rows, [cls, block]).drop(block)
        else:
            links = links.join(rows, cls)
    return links.select("row_x", "row_y")
