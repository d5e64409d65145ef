"""Mixing sources to target weights (problem 8), by pivotal dependent rounding.

A source with share t of the total budget T and size S needs its documents t*T/S times, at most
max_repeats times. The whole part of that is given to every document; the fraction is a copy
probability. Probabilities are rounded in pairs: mass (probability times size) moves from one document
of the pair to the other, in a random direction chosen so that every expectation stays, until one of
the two is integral; the other one meets the next document. So the size drawn from a source stays
what it should be up to one document. Documents that hold more than 1/LARGE of their source (at most
LARGE of them) go first, the largest before the others: each is paired with all smaller documents of its
source together, so what it draws too much or too little is spread over their probabilities, and the
document left over is a small one (`settle`). The rest goes in chunks; each chunk leaves one open document per
source; the open ones meet in a reduction tree, FAN chunks to a node, until one per source is left, which is
drawn by its own probability. Random numbers come from document ids: a task that runs again gives
the same result, and every level is cut in the shared folder.

Sources that cannot give their share leave a smaller mix in which the others' shares of what is there lie
above their targets. With `keep_shares` the budget is lowered instead until every source can give its
share; then all shares are met and the mix is smaller.

Edge cases: documents without source are no part of the total; those of size 0 (null or empty text)
add nothing and are not drawn; a source without documents, or with all of size 0, falls short if its
target is positive; sources not in the targets count in the total only; an empty table gives all
zeros. Null targets or repeats count as 0. Repeated documents are drawn like any others; doc_id is unique.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm.tokens import TOKENIZER, token_counts
from callweave.session import cut

FAN = 16
CHUNK_ROWS = 20_000
#: Tasks of the first level at most; a task takes several chunks one after the other.
MOST_TASKS = 10_000
#: A document is large if it holds more than this part of its source: so there are at most LARGE of them a source.
LARGE = 200
EPS = 1e-12
_OUT = pa.schema([("source", pa.string()), ("node", pa.int64()), ("doc_id", pa.int64()), ("size", pa.int64()), ("base", pa.int64()), ("p", pa.float64())])
OUT = "source string, node long, doc_id long, size long, base long, p double"


def _random(a: int, b: int) -> float:
    return xxhash.xxh64_intdigest(f"{a}|{b}") / 2.0**64


def pivot(p1: float, w1: int, p2: float, w2: int, u: float) -> tuple[float, float]:
    """Move mass between two documents until one is integral; u in [0, 1) picks the direction."""
    to_first, to_second = min(w1 * (1 - p1), w2 * p2), min(w1 * p1, w2 * (1 - p2))
    if u * (to_first + to_second) < to_second:
        p1, p2 = p1 + to_first / w1, p2 - to_first / w2
    else:
        p1, p2 = p1 - to_second / w1, p2 + to_second / w2
    snap = lambda p: 0.0 if p < EPS else 1.0 if p > 1 - EPS else p
    return snap(p1), snap(p2)


def fold(rows: Iterator[tuple], seed: int) -> Iterator[tuple]:
    """Round the documents of a chunk (source, node, doc_id, size, base, p) source by source; the open one of each comes last."""
    open_: dict[tuple, tuple] = {}
    for row in rows:
        source, node, doc_id, size, base, p = row
        if open_ and next(iter(open_))[1] != node:  # rows come node by node
            yield from open_.values()
            open_.clear()
        other = open_.pop((source, node), None)
        if other is not None and 0 < p < 1:
            q, p = pivot(other[5], other[3], p, size, _random(seed + other[2], doc_id))
            other = (*other[:5], q)
            row = (source, node, doc_id, size, base, p)
        for x in (other, row):
            if x is not None:
                if 0 < x[5] < 1:
                    open_[source, node] = x
                else:
                    yield x
    yield from open_.values()


def _fold_partition(seed: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        done: list[tuple] = []
        for x in fold(rows, seed):
            done.append(x)
            if len(done) >= 20_000:
                yield _batch(done)
                done = []
        if done:
            yield _batch(done)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT)], schema=_OUT)


def _fold_node(seed: int):  # noqa: ANN202
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["size", "doc_id"], ascending=[False, True]).itertuples(index=False, name=None)
        return pd.DataFrame(list(fold(rows, seed)), columns=_OUT.names)

    return run


def settle(docs: list[tuple[int, int]], whole: int, p: float, seed: int) -> tuple[list[float], float]:
    """Round the large documents (doc_id, size) of a source of size `whole`, all with probability p: their roundings, and the probability left to the others.

    From the largest down, a document is drawn by its probability, and the mass that this moves comes from
    or goes to all smaller ones alike, which keeps every expectation. Where they cannot take one of the
    outcomes the other one is certain; where they can take neither (the document is larger than what is
    wanted or than what the others hold), the outcome that misses less is taken.
    """
    out, rest, wanted = [], whole, p * whole
    for doc_id, size in docs:
        rest -= size
        none, one = wanted <= rest + EPS * whole, wanted - size >= -EPS * whole
        if none and one:
            x = _random(seed, doc_id) < p
        elif none or one:
            x = one
        else:
            x = size - wanted < wanted - rest
        out.append(float(x))
        wanted = min(float(rest), max(0.0, wanted - size * x))
        p = wanted / rest if rest else 0.0
    return out, p


def _settle(seed: int):  # noqa: ANN202
    """`settle` on the few large documents of a source; the row without a document has the others' probability."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id"], ascending=[False, True])
        first = pdf.iloc[0]
        drawn, p = settle(list(zip(pdf["doc_id"], pdf["size"])), int(first["whole"]), float(first["p"]), seed)
        rows = [(r.source, r.doc_id, r.size, r.base, x) for r, x in zip(pdf.itertuples(index=False), drawn)]
        return pd.DataFrame([*rows, (first["source"], None, 0, first["base"], p)], columns=["source", "doc_id", "size", "base", "p"])

    return run


def _parts(copies: str) -> tuple[Column, Column]:
    """Whole part and fraction of a number of copies; fractions beside 0 and 1 are snapped."""
    base = F.floor(F.col(copies) + EPS)
    p = F.col(copies) - base
    return base.alias("base"), F.when(p < EPS, 0.0).otherwise(p).alias("p")


def needs(sized: DataFrame, targets: DataFrame, keep_shares: bool = False) -> DataFrame:
    """Per target source: size, budget, size wanted and copies per document."""
    known = sized.where(F.col("source").isNotNull())
    sizes = known.groupBy("source").agg(F.sum("size").alias("size"))
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    t = targets.select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"))
    rows = t.join(F.broadcast(sizes.join(t.select("source"), "source", "left_semi")), "source", "left").withColumn("size", F.coalesce("size", F.lit(0)))  # as long as the targets
    rows = rows.withColumn("total", total.scalar().cast("double"))
    if keep_shares:
        most = rows.where("target_share > 0").agg(F.min(F.col("max_repeats") * F.col("size") / F.col("target_share")).alias("most"))
        rows = rows.withColumn("total", F.least("total", most.scalar()))
    want = F.col("target_share") * F.col("total")
    copies: Column = F.when(F.col("size") > 0, F.least(F.col("max_repeats").cast("double"), want / F.col("size"))).otherwise(0.0)
    return rows.select("source", "target_share", "max_repeats", "size", "total", want.alias("wanted"), copies.alias("copies"))


def mix(sized: DataFrame, targets: DataFrame, seed: int = 42, keep_shares: bool = False) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, copies) of every drawn document, and the needs of each source.

    `sized` has doc_id, source and size.
    """
    sized = cut(sized.select(F.col("doc_id").cast("long"), "source", F.col("size").cast("long")))
    need = cut(needs(sized, targets, keep_shares))
    plan = need.select("source", F.col("size").alias("whole"), *_parts("copies"))
    rows = sized.where("size > 0").join(F.broadcast(plan), "source")  # one row a target source
    large = F.col("size") * LARGE > F.col("whole")
    first = cut(rows.where(large).groupBy("source").applyInPandas(_settle(seed), "source string, doc_id long, size long, base long, p double"))
    left = first.where("doc_id is null").select("source", F.col("p").alias("left_p"))
    plan = plan.join(left, "source", "left").select("source", "whole", "base", F.coalesce("left_p", "p").alias("p"))
    rows = sized.where("size > 0").join(F.broadcast(plan), "source").where(~large)
    chunks = max(4, sized.count() // CHUNK_ROWS)
    keyed = rows.select("source", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).alias("node"), "doc_id", "size", "base", "p")
    tasks = min(chunks, MOST_TASKS)
    level = cut(keyed.repartition(tasks, "node").sortWithinPartitions("node", "source", F.desc("size"), "doc_id").mapInArrow(_fold_partition(seed), OUT))
    done = [first.where("doc_id is not null").select("source", F.lit(0).cast("long").alias("node"), "doc_id", "size", "base", "p"), level.where("p = 0 or p = 1")]
    while chunks > 1:
        chunks = -(-chunks // FAN)
        open_ = level.where("p > 0 and p < 1").withColumn("node", F.expr(f"node div {FAN}"))
        level = cut(open_.groupBy("source", "node").applyInPandas(_fold_node(seed), OUT))
        done.append(level.where("p = 0 or p = 1"))
    last = level.where("p > 0 and p < 1")
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("doc_id").cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    done.append(last.withColumn("p", F.when(u < F.col("p"), 1.0).otherwise(0.0)))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("doc_id", "source", "size", (F.col("base") + F.col("p").cast("long")).alias("copies")).where("copies > 0"), need


def report(drawn: DataFrame, need: DataFrame) -> DataFrame:
    """Wanted and actual shares of each source, from what was drawn.

    A source falls short if less than wanted was drawn although each of its documents came as often as it may.
    """
    got = drawn.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("got"), F.sum("copies").alias("records"), F.max("copies").alias("most_copies"))
    rows = need.join(F.broadcast(got), "source", "left")  # one row a target source
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    total = got.agg(F.coalesce(F.sum("got"), F.lit(0)).alias("mixed"))
    rows = rows.select("source", "target_share", "max_repeats", "size", "wanted", zero("got"), zero("records"), zero("most_copies"))
    rows = rows.withColumn("falls_short", (F.col("got") < F.col("wanted")) & (F.col("got") == F.col("max_repeats") * F.col("size"))).withColumn("mixed", total.scalar())
    return rows.withColumn("actual_share", F.when(F.col("mixed") > 0, F.col("got") / F.col("mixed")).otherwise(0.0)).drop("mixed")


def by_characters(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "source", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("size"))


def by_tokens(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    return token_counts(documents, ["doc_id", "source"], path).withColumnRenamed("n_tokens", "size")


def found(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """p8_found: target sources that fall short, from the report of the mix measured in characters."""
    drawn, need = mix(by_characters(documents), targets)
    return report(drawn, need).where("falls_short").select("source")
