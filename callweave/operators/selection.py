"""Deterministic stratified selection, replacement, samples and representative picks.

Selections are of a fixed size, so each pool only offers as many rows as could be asked for: the
first row of each fingerprint, then as many rows as the sum of the quotas. Those few rows go to the
driver, where the picks that depend on each other are made. Edge cases: an id or fingerprint is used
once; pools that cannot fill a quota raise LookupError (or, where a report is asked for, keep the places
that they leave open, with a null id and the pool's name), odd quotas ValueError; null ids are not expected
(eligible rows have one); ties in the order key go to the lower row_index.
"""

from __future__ import annotations

import random
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from callweave.functions.records import GENERATOR_BOUNDARY
from callweave.operators.prepare import BUCKETS
from callweave.operators.quality import split_rank

SPLITS = ("train", "validation", "test")
GENERATORS = ("deepseek", "mixtral")
#: Default quotas per split and bucket.
QUOTAS = {"train": (72, 30, 18), "validation": (24, 10, 6), "test": (24, 10, 6)}
SEED = 42
#: Rows of one range of row_index, about, that are numbered together.
RANGE_ROWS = 50_000
#: Positions that a seeded shuffle may hold on the driver.
MOST_SHUFFLED = 5_000_000


def hash_order(seed: int = SEED) -> Column:
    """An order that every engine computes alike."""
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col("id").cast("string")))


def pool_sizes(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("generator", "call_bucket").agg(F.count("*").alias("n"))


def pool_order(candidates: DataFrame, key: Column | None = None, ok: Column | None = None) -> DataFrame:
    """The first row of each fingerprint in each pool (generator, bucket), with its order key; `ok` marks rows that may be taken."""
    keyed = candidates.select(
        "row_index", "id", "generator", "call_bucket", "fingerprint", (key if key is not None else hash_order()).alias("key"), (ok if ok is not None else F.lit(True)).alias("ok")
    )
    best = keyed.groupBy("generator", "call_bucket", "fingerprint").agg(F.min(F.struct("key", "row_index", "id", "ok")).alias("b"))
    return best.select("generator", "call_bucket", "fingerprint", "b.*")


def pool_heads(candidates: DataFrame, need: int, key: Column | None = None, ok: Column | None = None) -> DataFrame:
    """Per (generator, bucket) the first `need` rows of distinct fingerprints that are `ok`, in the order of the key.

    A fingerprint is judged by its first row. Two limited steps per pool keep the ranking small: the best row
    of each fingerprint by aggregation, then a rank that is cut at `need`, which Spark limits within each
    partition before the shuffle.
    """
    rank = F.row_number().over(W.partitionBy("generator", "call_bucket").orderBy("key", "row_index"))
    return pool_order(candidates, key, ok).where("ok").drop("ok").withColumn("pool_pos", rank).where(F.col("pool_pos") <= need)


def shuffled(pool: list[int], rng: random.Random) -> list[int]:
    """A pool in the order of one step of a shuffle that all pools share (see `shuffled_heads`)."""
    order = list(pool)
    rng.shuffle(order)
    return order


def shuffled_heads(candidates: DataFrame, need: int, seed: int = SEED) -> DataFrame:
    """`pool_heads` in the order of one shared seeded shuffle of the pools, which depends on their sizes only.

    The shuffle runs on the driver over positions, not rows: it needs the six pool sizes and keeps `need`
    positions of each; rows are numbered in ranges of row_index, so no pool is ranked in one task. A pool of
    more than MOST_SHUFFLED rows raises ValueError: the hash order of `pool_heads` has no such bound.
    """
    sizes = {(r.generator, r.call_bucket): r.n for r in pool_sizes(candidates).collect()}
    if max(sizes.values(), default=0) > MOST_SHUFFLED:
        raise ValueError(f"A pool has more than {MOST_SHUFFLED} rows; take the hash order.")
    rng, wanted = random.Random(seed), []
    for g in GENERATORS:
        for b in BUCKETS:
            wanted += [(g, b, old, new) for new, old in enumerate(shuffled(range(sizes.get((g, b), 0)), rng)[:need])]
    spots = candidates.sparkSession.createDataFrame(wanted, "generator string, call_bucket string, pos long, pool_pos int")
    pool = ["generator", "call_bucket"]
    ranged = candidates.withColumn("range", F.expr(f"row_index div {RANGE_ROWS}"))
    counts = ranged.groupBy(*pool, "range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*pool).orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*pool, "range", before.alias("before"))  # a row for each RANGE_ROWS rows
    pos = F.row_number().over(W.partitionBy(*pool, "range").orderBy("row_index")) - 1 + F.col("before")
    return ranged.join(starts, [*pool, "range"]).withColumn("pos", pos).join(F.broadcast(spots), [*pool, "pos"]).drop("pos", "range", "before")


def pick(heads: Iterable[tuple[str, str, int, str, int]], quotas: dict[str, tuple[int, ...]] | None = None, seed: int = SEED, short: list[tuple[str, str, str, int]] | None = None) -> list[tuple[str, int, int]]:
    """(split, position, id) of a selection, from (generator, bucket, pool_pos, fingerprint, id) rows.

    A list for `short` gets (split, generator, bucket, missing) of the pools that are too small; without it they raise.
    """
    pools: dict[tuple[str, str], list[tuple[int, str, int]]] = {}
    for g, b, *rest in heads:
        pools.setdefault((g, b), []).append(tuple(rest))
    ids: set[int] = set()
    prints: set[str] = set()
    chosen: dict[str, list[int]] = {}
    for split, counts in (quotas or QUOTAS).items():
        chosen[split] = []
        for b, quota in zip(BUCKETS, counts):
            if quota % len(GENERATORS):
                raise ValueError(f"Quota for {split}/{b} must be even to divide equally by generator.")
            for g in GENERATORS:
                want = quota // len(GENERATORS)
                for _, fingerprint, id_ in sorted(pools.get((g, b), [])):
                    if not want:
                        break
                    if id_ not in ids and fingerprint not in prints:
                        ids.add(id_)
                        prints.add(fingerprint)
                        chosen[split].append(id_)
                        want -= 1
                if want and short is not None:
                    short.append((split, g, b, want))
                elif want:
                    raise LookupError(f"Not enough unique examples for split={split}, generator={g}, bucket={b}; {want} are missing.")
    rng = random.Random(seed)
    for rows in chosen.values():
        rng.shuffle(rows)
    return [(s, i, id_) for s, rows in chosen.items() for i, id_ in enumerate(rows)]


def select(candidates: DataFrame, quotas: dict[str, tuple[int, ...]] | None = None, seed: int = SEED) -> DataFrame:
    """(split, pos, id) of a selection of the quotas' size."""
    quotas = quotas or QUOTAS
    heads = pool_heads(candidates, sum(map(sum, quotas.values())), hash_order(seed))
    rows = [(r.generator, r.call_bucket, r.pool_pos, r.fingerprint, r.id) for r in heads.collect()]  # six pools of at most the selection's size
    return candidates.sparkSession.createDataFrame(pick(rows, quotas, seed), "split string, pos int, id long")


def select_reported(candidates: DataFrame, quotas: dict[str, tuple[int, ...]] | None = None, seed: int = SEED) -> DataFrame:
    """`select` that reports short pools as rows: (split, pos, id, short) with all places of the quotas.

    A place that its pool cannot fill has a null id and 'generator/bucket' in `short`; these come last in their split.
    """
    quotas = quotas or QUOTAS
    heads = pool_heads(candidates, sum(map(sum, quotas.values())), hash_order(seed))
    short: list[tuple[str, str, str, int]] = []
    rows = [(r.generator, r.call_bucket, r.pool_pos, r.fingerprint, r.id) for r in heads.collect()]  # as in `select`
    out: list[tuple[str, int, int | None, str | None]] = [(*x, None) for x in pick(rows, quotas, seed, short)]
    filled = {s: sum(x[0] == s for x in out) for s in quotas}
    for split, g, b, missing in short:
        out += [(split, filled[split] + i, None, f"{g}/{b}") for i in range(missing)]
        filled[split] += missing
    return candidates.sparkSession.createDataFrame(out, "split string, pos int, id long, short string")


def replace(selected: DataFrame, candidates: DataFrame, valid: DataFrame, seed: int = SEED, report: bool = False) -> DataFrame:
    """A selection whose invalid members give way, in place, to the next unused valid candidate of their pool.

    `valid` has the ids without issues. Output: split, pos, id, replaced (the id that left, or null). With `report`,
    `selected` is that of `select_reported`, `short` is kept, and a pool without a valid candidate leaves the place open
    (null id, the pool in `short`) instead of raising.
    """
    ok = valid.select("id").distinct().withColumn("ok", F.lit(True))
    info = candidates.select("id", "generator", "call_bucket", "fingerprint")
    rows = selected.join(info, "id", "left").join(ok, "id", "left").orderBy(split_rank(), "split", "pos").collect()  # the selection: fixed size
    bad = sum(1 for r in rows if not r.ok)
    ids, prints = {r.id for r in rows}, {r.fingerprint for r in rows}
    marked = candidates.join(ok, "id", "left")
    heads = pool_heads(marked, len(rows) + bad, hash_order(seed), F.coalesce("ok", F.lit(False))).collect() if bad else []
    out = []
    for r in rows:
        if r.ok or r.id is None:
            out.append((r.split, r.pos, r.id, None, r.short if report else None))
            continue
        spare = sorted((h.pool_pos, h.id, h.fingerprint) for h in heads if (h.generator, h.call_bucket) == (r.generator, r.call_bucket))
        new = next(((i, f) for _, i, f in spare if i not in ids and f not in prints), None)
        if new is None and not report:
            raise LookupError(f"No valid replacement for {r.id} in {r.generator}/{r.call_bucket}.")
        if new is not None:
            ids.add(new[0])
            prints.add(new[1])
        out.append((r.split, r.pos, new and new[0], r.id, None if new else f"{r.generator}/{r.call_bucket}"))
    done = selected.sparkSession.createDataFrame(out, "split string, pos int, id long, replaced long, short string")
    return done if report else done.drop("short")


def summary(selected: DataFrame, candidates: DataFrame) -> DataFrame:
    """Counts of a selection as (measure, value, n): sizes, distributions and conditional counts."""
    first = candidates.groupBy("id").agg(F.min("row_index").alias("row_index"))
    rows = selected.select("id", "split").join(candidates.drop("split").join(first, ["id", "row_index"]), "id")
    measures = {
        "split": F.col("split"), "generator": F.col("generator"), "call_bucket": F.col("call_bucket"),
        "expected_calls": F.col("expected_call_count").cast("string"), "available_tools": F.col("available_tool_count").cast("string"),
    }
    flags = {
        "five_or_more_tools": F.col("available_tool_count") >= 5, "complex_parameters": F.col("has_complex_parameters"), "multiple_tools": F.col("multiple_distinct_tools"),
        "repeated_tool": F.col("repeated_same_tool"), "unknown_tools": F.when(F.col("unknown_answer_tools").isNotNull(), F.size("unknown_answer_tools") > 0),
    }
    pairs = [F.struct(F.lit(k).alias("measure"), v.alias("value")) for k, v in measures.items()]
    pairs += [F.struct(F.lit(k).alias("measure"), v.cast("string").alias("value")) for k, v in flags.items()]
    types = F.transform("parameter_types", lambda t: F.struct(F.lit("parameter_type").alias("measure"), t.alias("value")))
    return rows.select(F.explode(F.concat(F.array(*pairs), types)).alias("x")).groupBy("x.measure", "x.value").agg(F.count("*").alias("n"))


def inspection_sample(rows: DataFrame, boundary: int = GENERATOR_BOUNDARY, each: int = 50, seed: int = SEED, report: bool = False) -> DataFrame:
    """`each` rows by row_index on either side of the boundary, drawn like the standard library's sample.

    Data that do not reach beyond the boundary raise ValueError; with `report` the side that has no rows is
    left out and the rows carry `side`.
    """
    last = rows.agg(F.max("row_index")).first()[0]
    size = 0 if last is None else last + 1
    if size <= boundary and not report:
        raise ValueError(f"The data has only {size} rows; more than {boundary} are needed.")
    rng = random.Random(seed)
    picked = [rng.sample(part, min(each, len(part))) for part in (range(min(boundary, size)), range(boundary, size))]
    out = rows.where(F.col("row_index").isin(sorted(x for p in picked for x in p)))
    return out.withColumn("side", F.when(F.col("row_index") < boundary, "below").otherwise("from")) if report else out


def category_examples(candidates: DataFrame, seed: int = SEED) -> DataFrame:
    """One candidate for each category, none twice: the first in hash order that is not taken yet."""
    kinds = {
        "single_call": F.col("expected_call_count") == 1, "exactly_two_calls": F.col("expected_call_count") == 2, "three_or_more_calls": F.col("expected_call_count") >= 3,
        "many_available_tools": F.col("available_tool_count") >= 5, "complex_parameter_type": F.col("has_complex_parameters"),
    }
    key = F.md5(F.concat(F.lit(f"{seed}-"), F.col("row_index").cast("string")))
    of = F.array_compact(F.array(*(F.when(rule, name) for name, rule in kinds.items())))
    rank = F.row_number().over(W.partitionBy("category").orderBy("key", "row_index"))
    each = candidates.select("row_index", key.alias("key"), F.explode(of).alias("category")).withColumn("rank", rank).where(F.col("rank") <= len(kinds))
    offers = sorted((r.category, r.rank, r.row_index) for r in each.collect())  # as many rows a category as there are categories
    taken: set[int] = set()
    out = []
    for name in kinds:
        row = next((i for c, _, i in offers if c == name and i not in taken), None)
        if row is not None:
            taken.add(row)
            out.append((name, row))
    return candidates.sparkSession.createDataFrame(out, "category string, row_index long")


def representatives(records: DataFrame, count: int = 5) -> DataFrame:
    """One record for each of up to `count` features, then the first others; records have the tags below.

    Input: id, split, source_id, expected_call_count, available_tool_count, multiple_called_tools,
    repeated_tool_calls, complex_parameters. Order: split (train, validation, test), source_id, id.
    Picks are by id and ids repeat: each offer holds the first row of each id, so that as many distinct
    ids as are picked in all are enough.
    """
    rules = (
        ("single_call", F.col("expected_call_count") == 1),
        ("two_calls_distinct_tools", (F.col("expected_call_count") == 2) & F.col("multiple_called_tools")),
        ("three_plus_calls", F.col("expected_call_count") >= 3),
        ("repeated_tool_calls", F.col("repeated_tool_calls")),
        ("five_plus_available_tools", (F.col("available_tool_count") >= 5) & F.col("complex_parameters")),
    )
    rank = F.when(F.col("split") == "train", 0).when(F.col("split") == "validation", 1).when(F.col("split") == "test", 2).otherwise(3)

    def offered(rows: DataFrame) -> list[str]:
        first = rows.groupBy("id").agg(F.min(F.struct(rank.alias("rank"), "source_id")).alias("first"))
        return [r.id for r in first.orderBy("first", "id").limit(count).collect()]

    used: set[str] = set()
    out: list[tuple[int, str, str]] = []
    for name, rule in rules[:count]:
        new = next((i for i in offered(records.where(rule)) if i not in used), None)
        if new is not None:
            used.add(new)
            out.append((len(out), name, new))
    if len(out) < count:
        for i in offered(records):
            if i not in used and len(out) < count:
                used.add(i)
                out.append((len(out), "fill", i))
    return records.sparkSession.createDataFrame(out, "pos int, feature string, id string")


#: The public fields of a manifest; fingerprints and raw rows stay out.
MANIFEST = (
    "row_index", "generator", "call_bucket", "available_tool_count", "expected_call_count", "distinct_expected_tool_count", "repeated_same_tool",
    "multiple_distinct_tools", "parameter_types", "has_complex_parameters",
)


def manifest(selected: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row per selected record with its split, position and public fields, in that order."""
    first = candidates.groupBy("id").agg(F.min("row_index").alias("row_index"))
    rows = selected.select("split", "pos", "id").join(candidates.drop("split").join(first, ["id", "row_index"]), "id")
    return rows.select("split", "pos", "id", *MANIFEST).orderBy("split", "pos")
