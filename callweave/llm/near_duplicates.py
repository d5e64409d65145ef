"""Near-duplicate records with small edits (problem 5), by b-bit MinHash.

Each record becomes the set of its query's distinct words and the set of its distinct trimmed tool
names. Records with equal sets form a class with one representative, so copies cost nothing further.
Of each MinHash minimum only the low bits are kept (B = 8), eight to a LONG; slices of the minima give band
keys; pairs that share a band key are candidates; the count of equal minima, found with XOR and bit_count
on the packed words and corrected for chance collisions (2^-B), estimates their similarity; those that
come near the threshold are verified exactly.

Pairs that are not similar share a band key by chance, and their number grows with the square of the
rows. So the rows of a band grow with the collection (`scheme_for`): one more minimum for each five-fold
of it, and as many bands as keep the probability of missing a pair at similarity 0.7 at or below 0.25 %
(at 0.8 it is below 1e-6). The estimate's margin is 4.5 standard deviations. A band key shared by more
than HOT representatives is not expanded: its members are joined on the key and the rarest words that
they must share at this threshold (prefix filter), which is exact.

Edge cases: a row with a null query or tools, tools that are no standard JSON array, no word or no
tool name takes no part; nameless tools and non-objects are skipped; empty tables give empty results;
repeated row_index values are not expected (the column is unique). Long texts count in full. Columns
other than row_index, query and tools are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from callweave.jsonx import BAD, try_loads
from callweave.llm.components import components
from callweave.llm.expand import row_pairs
from callweave.llm.words import distinct_words, word_hash
from callweave.session import cut, hot_join, keep_ids, spread

B = 8
HOT = 500
QUERY_SHARE, NAME_SHARE = (7, 10), (1, 2)
#: The probability that a pair right at the threshold shares no band; rows of a band for up to BASE_ROWS rows, and by how much a collection grows for one more.
MISS, LEAST_ROWS, BASE_ROWS, GROWTH = 0.0025, 6, 1_000_000, 5
_MIX = np.uint64(0xBF58476D1CE4E5B9)


@dataclass(frozen=True)
class Scheme:
    """How minima are cut into bands: `bands` slices of `rows` minima."""

    rows: int
    bands: int

    @property
    def n(self) -> int:
        """Minima of a signature: full words of eight."""
        return -(-self.rows * self.bands // 8) * 8

    def missed(self, similarity: float) -> float:
        """The probability that a pair of this similarity shares no band."""
        return (1 - similarity**self.rows) ** self.bands


def scheme_for(rows: int) -> Scheme:
    """The bands for a collection of so many rows."""
    r, reach = LEAST_ROWS, BASE_ROWS
    while rows > reach:
        r, reach = r + 1, reach * GROWTH
    return Scheme(r, math.ceil(math.log(MISS) / math.log(1 - (QUERY_SHARE[0] / QUERY_SHARE[1]) ** r)))


@cache
def _hashing(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20250106))
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def signature(hashes: np.ndarray, n: int) -> np.ndarray:
    """The low B bits of n minima over a set of word hashes, packed eight to an int64."""
    x = hashes.astype(np.int64).view(np.uint64)
    times, plus = _hashing(n)
    low = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    step = max(1, 150_000 // n)
    for start in range(0, len(x), step):  # a bounded block at a time: long texts and many minima need no more memory
        part = x[start : start + step, None] * times + plus
        part ^= part >> np.uint64(31)
        np.minimum(low, (part * _MIX).min(axis=0), out=low)
    low = (low ^ (low >> np.uint64(29))) * _MIX
    return (low >> np.uint64(64 - B)).astype(np.uint8).view(np.int64)


def tool_names(tools: str | None) -> list[str] | None:
    """Distinct trimmed names of a tools array, or None if it is no standard JSON array."""
    value = try_loads(tools)
    if value is BAD or not isinstance(value, list):
        return None
    names = []
    for tool in value:
        body = tool.get("function") if isinstance(tool, dict) and isinstance(tool.get("function"), dict) else tool
        if isinstance(body, dict) and isinstance(body.get("name"), str):
            names.append(body["name"].strip())
    return list(dict.fromkeys(names))


_TYPES = {
    "row_index": pa.int64(), "cls": pa.binary(), "sig": pa.list_(pa.int64()), "words": pa.list_(pa.int64()), "names": pa.list_(pa.int64()),
}
_DDL = {"row_index": "long", "cls": "binary", "sig": "array<long>", "words": "array<long>", "names": "array<long>"}
BRIEF, FULL = ("row_index", "cls", "sig", "names"), ("row_index", "sig", "words")


def _features(columns: tuple[str, ...], n: int):  # noqa: ANN202
    schema = pa.schema([(c, _TYPES[c]) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row_index, query, tools in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words, names = distinct_words(query), tool_names(tools) if query and tools else None
                if words and names:
                    hashes = np.unique(np.array([word_hash(w) for w in words], np.int64))
                    own = np.unique(np.array([word_hash(n) for n in names], np.int64))
                    row = {"row_index": row_index, "words": hashes, "names": own}
                    if "sig" in columns:
                        row["sig"] = signature(hashes, n)
                    if "cls" in columns:
                        row["cls"] = xxhash.xxh3_128_digest(hashes.tobytes() + b"|" + own.tobytes())
                    out.append(tuple(row[c] for c in columns))
            values = list(zip(*out)) if out else [[]] * len(columns)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(values, schema)], schema=schema)

    return run


def features(rows: DataFrame, columns: tuple[str, ...], n: int = 0) -> DataFrame:
    """The named features of each row that takes part: hashed words and tool names, packed signature of n minima, class digest."""
    slim = spread(rows.select(F.col("row_index").cast("long"), F.col("query").cast("string"), F.col("tools").cast("string")))
    return slim.mapInArrow(_features(columns, n), ", ".join(f"{c} {_DDL[c]}" for c in columns))


def equal_minima(a: Column, b: Column) -> Column:
    """How many of the packed B-bit minima agree: bytes of the XOR without a bit, counted with bit_count."""

    def differing(x: Column) -> Column:  # fold each byte into its lowest bit
        for shift, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x0303030303030303), (1, 0x0101010101010101)):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift)).bitwiseAND(F.lit(mask))
        return F.bit_count(x)

    return F.aggregate(F.zip_with(a, b, lambda p, q: differing(p.bitwiseXOR(q))), 8 * F.size(a), lambda s, v: s - v)


def estimate(a: Column, b: Column) -> Column:
    """Similarity from agreeing minima, corrected for the 2^-B of chance agreements."""
    chance = 2.0**-B
    return (equal_minima(a, b) / (8.0 * F.size(a)) - chance) / (1 - chance)


def shares_at_least(a: Column, b: Column, share: tuple[int, int]) -> Column:
    """|a & b| / |a | b| >= share, in whole numbers."""
    common = F.size(F.array_intersect(a, b))
    return common * share[1] >= (F.size(a) + F.size(b) - common) * share[0]


def classes(feats: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(row_index, rep) membership, (rep, sig, names) of the representatives, and (rep, n) of all classes."""
    keyed = feats.select("row_index", "cls")
    reps = cut(keyed.groupBy("cls").agg(F.min("row_index").alias("rep"), F.count("*").alias("n")))
    members = cut(hot_join(keyed, reps, "cls").select("row_index", "rep"))
    copies = members.where("row_index <> rep").select("row_index")
    own = keep_ids(feats.select("row_index", "sig", "names"), copies, "row_index", "left_anti").withColumnRenamed("row_index", "rep")
    return members, own, reps.select("rep", "n")


def band_keys(reps: DataFrame, scheme: Scheme) -> DataFrame:
    """(key, rep): a hash of each band of low-bit minima, read out of the packed words."""
    byte = lambda i: F.shiftrightunsigned(F.col("sig")[i // 8], 8 * (i % 8)).bitwiseAND(F.lit(255))
    band = lambda j: F.xxhash64(F.lit(j), *(byte(scheme.rows * j + i) for i in range(scheme.rows)))
    return reps.select("rep", F.explode(F.array(*(band(j) for j in range(scheme.bands)))).alias("key"))


def candidates(reps: DataFrame, rows: DataFrame, scheme: Scheme) -> DataFrame:
    """Distinct pairs (a, b), a < b, of representatives that share a band key.

    Most keys have one owner, most others two: one aggregation finds both and yields the pairs of the
    latter. Only rows of keys with more owners are joined, and those of keys with more than HOT owners
    on the rarest words that a pair must share.
    """
    keys = band_keys(reps, scheme)
    owners = cut(keys.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("a"), F.max("rep").alias("b")).where("n > 1"))
    two = owners.where("n = 2").select("a", "b")
    many = owners.where("n > 2").select("key")
    shared = cut(keep_ids(keys, many, "key").join(owners.select("key", "n"), "key"))
    cold = shared.where(F.col("n") <= HOT).select("key", "rep")
    x, y = cold.select("key", F.col("rep").alias("a")), cold.select("key", F.col("rep").alias("b"))
    pairs = two.union(x.join(y, "key").where("a < b").select("a", "b"))
    hot = shared.where(F.col("n") > HOT).select("key", "rep")
    if hot.limit(1).count():
        pairs = pairs.union(hot_pairs(hot, rows))
    return pairs.distinct()


def hot_pairs(hot: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs within hot keys that share one of the rarest words: exact at the threshold, by the prefix filter."""
    ids = cut(hot.select(F.col("rep").alias("row_index")).distinct())
    feats = cut(features(keep_ids(rows.select("row_index", "query", "tools"), ids, "row_index"), ("row_index", "words")))
    words = hot.join(feats, hot.rep == feats.row_index).select("key", "rep", F.size("words").alias("size"), F.explode("words").alias("word"))
    spread_of = words.groupBy("word").agg(F.count("*").alias("df"))
    rank = F.row_number().over(W.partitionBy("key", "rep").orderBy("df", "word"))
    p, q = QUERY_SHARE
    prefix = words.join(spread_of, "word").withColumn("rank", rank).where(F.col("rank") <= F.col("size") - F.ceil(F.col("size") * p / q) + 1)
    x, y = prefix.select("key", "word", F.col("rep").alias("a")), prefix.select("key", "word", F.col("rep").alias("b"))
    return x.join(y, ["key", "word"]).where("a < b").select("a", "b")


def similar_classes(reps: DataFrame, rows: DataFrame, scheme: Scheme) -> DataFrame:
    """Verified pairs (a, b) of representatives, with the estimated similarity.

    Tool names are few and compared first; the texts of what is left are read again, so that words
    and signatures travel for these only.
    """
    p, q = QUERY_SHARE
    least = p / q - 4.5 * (p / q * (1 - p / q) / scheme.n) ** 0.5
    na, nb = (reps.select(F.col("rep").alias(c), F.col("names").alias(f"n{c}")) for c in "ab")
    named = candidates(reps, rows, scheme).join(na, "a").join(nb, "b")
    pairs = cut(named.where(shares_at_least(F.col("na"), F.col("nb"), NAME_SHARE)).select("a", "b"))
    ids = cut(pairs.select(F.col("a").alias("row_index")).union(pairs.select("b")).distinct())
    feats = cut(features(keep_ids(rows.select("row_index", "query", "tools"), ids, "row_index"), FULL, scheme.n))
    x = feats.select(F.col("row_index").alias("a"), F.col("sig").alias("sa"), F.col("words").alias("wa"))
    y = feats.select(F.col("row_index").alias("b"), F.col("sig").alias("sb"), F.col("words").alias("wb"))
    both = pairs.join(x, "a").join(y, "b").withColumn("estimate", estimate(F.col("sa"), F.col("sb")))
    same = shares_at_least(F.col("wa"), F.col("wb"), QUERY_SHARE)
    return both.where((F.col("estimate") >= least) & same).select("a", "b", "estimate")


def found(rows: DataFrame) -> DataFrame:
    """p5_found: all similar pairs of rows, copies included."""
    scheme = scheme_for(rows.count())
    members, reps, sizes = classes(cut(features(rows, BRIEF, scheme.n)))
    links = cut(similar_classes(reps, rows, scheme).select("a", "b"))
    own = sizes.where("n > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    x, y = members.select(F.col("rep").alias("a"), F.col("row_index").alias("row_x")), members.select(F.col("rep").alias("b"), F.col("row_index").alias("row_y"))
    of_a, of_b = (sizes.withColumnRenamed("rep", c) for c in "ab")
    both = row_pairs(links, x, y, of_a, of_b).union(row_pairs(own, x, y, of_a, of_b).where("row_x < row_y"))
    return both.select(F.least("row_x", "row_y").alias("row_a"), F.greatest("row_x", "row_y").alias("row_b"))


def groups(rows: DataFrame) -> DataFrame:
    """Each row that takes part with its class, its group and its links to other texts; copies are not paired."""
    scheme = scheme_for(rows.count())
    members, reps, sizes = classes(cut(features(rows, BRIEF, scheme.n)))
    links = cut(similar_classes(reps, rows, scheme).select("a", "b"))
    comp = components(links)
    degree = links.select(F.col("a").alias("rep")).union(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("links"))
    out = members.join(comp.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left")
    return out.select("row_index", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
