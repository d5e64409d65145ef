"""Same or near-same records across splits (problem 2), by a compressed full-text index.

A record's text is the distinct words of its first user message in a fixed order (that of their
hashes), each word a symbol together with the canonical form of the assistant's calls: only records with
the same calls can match at all, and equal words stand in equal order, so near-same records share long
runs. Records with equal words and calls form a class. The evaluation classes (validation, test) are cut
into shards of bounded size by their calls and each shard gets one index; shards of hot calls are cut
into blocks. Training classes stream through the indexes of their shard by backward search.

Two texts of n and m words with c in common have n - c + m - c words that the other one lacks. Each
word of the first that is missing breaks two of its n + 1 pairs of neighbours (its ends count as
neighbours of the separator), each word too many in the second breaks one. So of any K + 1 pairs one
must stand in the index if no more than K can be broken at the threshold: the rarest ones by the width
of their backward-search interval are located, and a document that holds too few of them is no match.
What is left is merged with the record by walking back through the index from the document's end: runs
of common neighbours are the maximal matches; their number (`spans`), the longest, and their words
together come out, and the share follows exactly. No pair is missed.

Edge cases: records without a known split, without a user message or with no word in it, or with
arguments that are no JSON, take no part (unreadable arguments have no values to compare); several
assistant turns count together; call order, key order and 1 against 1.0 are aside; no call at all is
the same as no call. Repeated record_no values are not expected. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.jsonx import BAD, canonical, fold_numbers, try_loads
from callweave.llm.expand import class_sizes, row_pairs
from callweave.llm.fulltext import Index
from callweave.llm.words import distinct_words, word_hash
from callweave.session import cut, spread

SHARE = (7, 10)
#: Evaluation classes in an index, and training classes in one search task, about.
SHARD_ROWS, CHUNK_ROWS = 8_000, 16_000
#: Places located and pairs merged at a time, which bounds the memory of a search task.
PLACES, PAIRS = 1_000_000, 20_000


def _fold(value: object) -> object:
    """1.0 as 1, but true stays true: argument values that print alike compare alike."""
    if isinstance(value, dict):
        return {k: _fold(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_fold(v) for v in value]
    return value if isinstance(value, bool) else fold_numbers(value)


def calls_key(messages: list[dict] | None) -> str | None:
    """Canonical text of the assistant's calls, order aside; None if arguments cannot be read."""
    calls = []
    for m in messages or []:
        if not m or (m.get("role") or "").strip().lower() != "assistant":
            continue
        for call in m.get("tool_calls") or []:
            f = (call or {}).get("function") or {}
            args = f.get("arguments")
            value = {} if args is None or not args.strip() else try_loads(args)
            if value is BAD:
                return None
            calls.append(canonical([(f.get("name") or "").strip(), _fold(value)]))
    return "\n".join(sorted(calls))


def first_user(messages: list[dict] | None) -> str | None:
    return next((m.get("content") for m in messages or [] if m and (m.get("role") or "").strip().lower() == "user"), None)


_SCHEMA = pa.schema(
    [(c, pa.int64()) for c in ("record_no", "calls", "cls")] + [("symbols", pa.list_(pa.int64()))] + [(c, pa.string()) for c in ("side", "split", "source_dataset")]
)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for record_no, messages, *rest in zip(*(c.to_pylist() for c in batch.columns)):
            words, key = distinct_words(first_user(messages)), calls_key(messages)
            if words and key is not None:
                calls = xxhash.xxh64_intdigest(key)
                w = np.array([word_hash(x) for x in words], np.int64)
                with np.errstate(over="ignore"):
                    s = (w.view(np.uint64) ^ np.uint64(calls)) * np.uint64(0x9E3779B97F4A7C15)
                    s ^= s >> np.uint64(32)
                s = np.sort(s.view(np.int64))
                cls = xxhash.xxh64_intdigest(s.tobytes())
                out.append((record_no, _signed(calls), _signed(cls), s, *rest))
        columns = list(zip(*out)) if out else [[]] * len(_SCHEMA)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)


def sides(records: DataFrame) -> DataFrame:
    """record_no, side, class, calls and symbols of the records that take part, with split and source."""
    split = F.lower(F.trim("metadata.split"))
    side = F.when(split == "train", "train").when(split.isin("validation", "test"), "eval")
    known = records.select("record_no", "messages", side.alias("side"), split.alias("split"), F.col("metadata.source_dataset").alias("source_dataset")).where("side is not null")
    return spread(known).mapInArrow(_extract, "record_no long, calls long, cls long, symbols array<long>, side string, split string, source_dataset string")


def _build(shard_rows: pd.DataFrame) -> pd.DataFrame:
    rows = shard_rows.sort_values("cls")
    index = Index.build([np.asarray(s, np.int64) for s in rows["symbols"]])
    return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "block": [rows["block"].iloc[0]], "ids": [rows["cls"].to_numpy()], "blob": [index.dump()]})


MATCH = "train_cls long, eval_cls long, common int, train_words int, eval_words int, spans int, longest int"


def least_common(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The common words that texts of n and m words need to reach the share."""
    p, q = SHARE
    return -(-(n + m) * p // (p + q))


def most_broken(n: int) -> int:
    """How many of the n + 1 pairs of a text of n words can be missing in a text that reaches the share."""
    p, q = SHARE
    return max((2 * a + (n - a) * q // p - n for a in range(n) if (n - a) * q >= n * p), default=0)


def stream(index: Index, ids: np.ndarray, classes: np.ndarray, patterns: list[np.ndarray]) -> pd.DataFrame:
    """Training classes against one index: pairs at or over the share, with their merged maximal matches."""
    out = [pd.DataFrame({c.split()[0]: np.empty(0, np.int64) for c in MATCH.split(", ")})]
    if not len(patterns) or not len(ids):
        return out[0]
    sizes = np.array([len(x) for x in patterns], np.int64)
    base = np.cumsum(sizes) - sizes
    symbol = index.symbols(np.concatenate(patterns))
    length, ends, docs = np.diff(index.starts) - 1, index.ends(), len(ids)
    # each text between two separators: its pairs of neighbours, searched backward
    owner = np.repeat(np.arange(len(patterns)), sizes + 1)
    at = _ramp(sizes + 1)
    inner = base[owner] + at
    left = np.where(at > 0, symbol[np.maximum(inner - 1, 0)], 0)
    right = np.where(at < sizes[owner], symbol[np.minimum(inner, len(symbol) - 1)], 0)
    lo, hi = index.step(left, *index.interval(right))
    width = np.maximum(hi - lo, 0)
    # the rarest pairs of each record, one more than can be broken
    broken = {int(n): most_broken(int(n)) for n in np.unique(sizes)}
    asked = np.array([broken[int(n)] + 1 for n in sizes], np.int64)
    order = np.lexsort((np.arange(len(owner)), width, owner))
    anchors = order[(_ramp(sizes + 1) < asked[owner]) & (width[order] > 0)]
    anchors = anchors[np.argsort(owner[anchors], kind="stable")]
    for part in _slices(owner[anchors], width[anchors]):  # all places of the anchors, a bounded number at a time
        own, w = anchors[part], width[anchors[part]]
        doc, offset = index.documents(index.locate(np.repeat(lo[own], w) + _ramp(w)))
        opens = np.repeat(left[own] == 0, w)  # a separator found stands before its document
        doc = np.where(opens, (doc + 1) % docs, doc)
        pairs, hits = np.unique(np.repeat(owner[own], w) * docs + doc, return_counts=True)
        x, y = pairs // docs, pairs % docs
        need = least_common(sizes[x], length[y])
        enough = (need <= np.minimum(sizes[x], length[y])) & (hits >= asked[x] - (2 * sizes[x] + length[y] - 3 * need))
        x, y, need = x[enough], y[enough], need[enough]
        for first in range(0, len(x), PAIRS):
            a, b = x[first : first + PAIRS], y[first : first + PAIRS]
            common, spans, longest = merge(index, ends[b], length[b], symbol, base[a], sizes[a], need[first : first + PAIRS])
            ok = common >= need[first : first + PAIRS]
            found = {"train_cls": classes[a], "eval_cls": ids[b], "common": common, "train_words": sizes[a], "eval_words": length[b], "spans": spans, "longest": longest}
            out.append(pd.DataFrame(found)[ok])
    return pd.concat(out)


def _slices(owner: np.ndarray, width: np.ndarray) -> Iterator[slice]:
    """Runs of anchors of whole records with at most about PLACES places together."""
    group = (np.cumsum(width) - width) // PLACES
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.empty(0, np.int64)
    starts = first[np.concatenate(([True], group[first][1:] != group[first][:-1]))] if len(first) else first
    for a, b in zip(starts, [*starts[1:], len(owner)]):
        yield slice(a, b)


def merge(index: Index, row: np.ndarray, rest: np.ndarray, symbol: np.ndarray, base: np.ndarray, n: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Common words, runs and longest run of (record, document) pairs, both read from their ends.

    A document is read out of the index by steps back from its separator's row; symbols are in order in
    both texts. Pairs that cannot reach the words that they need any more are dropped on the way.
    """
    common, spans, longest, run = (np.zeros(len(row), np.int64) for _ in range(4))
    live = np.arange(len(row))
    row, rest, i = row.copy(), rest.copy(), base + n - 1
    joined = np.zeros(len(row), bool)  # the last step was a match, so a match now goes on with its run
    while len(live):
        ours, theirs = symbol[i], index.symbol_of[row]
        same, ours_on, theirs_on = ours == theirs, (ours >= theirs) | (ours < 0), (theirs >= ours) & (ours >= 0)
        run = np.where(same, np.where(joined, run + 1, 1), run)
        common[live] += same
        spans[live] += same & ~joined
        longest[live] = np.maximum(longest[live], np.where(same, run, 0))
        joined = same
        i, rest = i - ours_on, rest - theirs_on
        row = np.where(theirs_on, index.back(row), row)
        left = i - base + 1
        on = (left > 0) & (rest > 0) & (common[live] + np.minimum(left, rest) >= need)
        live, row, rest, i, base, need, joined, run = (z[on] for z in (live, row, rest, i, base, need, joined, run))
    return common, spans, longest


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of counts, joined."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def _search(index_rows: pd.DataFrame, train_rows: pd.DataFrame) -> pd.DataFrame:
    if not len(index_rows) or not len(train_rows):
        return pd.DataFrame({c.split()[0]: [] for c in MATCH.split(", ")})
    row = index_rows.iloc[0]
    return stream(Index.load(row["blob"]), np.asarray(row["ids"], np.int64), train_rows["cls"].to_numpy(), [np.asarray(s, np.int64) for s in train_rows["symbols"]])


def matches(parts: DataFrame) -> DataFrame:
    """(training class, evaluation class) pairs that reach the share, with spans and counts."""
    reps = cut(parts.groupBy("cls", "side").agg(F.min_by(F.struct("calls", "symbols"), "record_no").alias("x")).select("cls", "side", "x.*"))
    n_eval = reps.where("side = 'eval'").count()
    shards = max(1, n_eval // (SHARD_ROWS // 2))
    reps = reps.withColumn("shard", F.pmod(F.xxhash64("calls"), F.lit(shards)).cast("int"))
    # one row per shard: how many blocks its evaluation rows and how many chunks its training rows need
    sizes = reps.groupBy("shard").agg(F.ceil(F.count_if(F.col("side") == "eval") / SHARD_ROWS).alias("blocks"), F.ceil(F.count_if(F.col("side") == "train") / CHUNK_ROWS).alias("chunks"))
    sized = reps.join(sizes.where("blocks > 0 and chunks > 0"), "shard")
    evals = sized.where("side = 'eval'").withColumn("block", F.pmod("cls", F.col("blocks")).cast("int"))
    trains = sized.where("side = 'train'").withColumn("chunk", F.pmod("cls", F.col("chunks")).cast("int"))
    indexes = evals.select("shard", "block", "cls", "symbols").groupBy("shard", "block").applyInPandas(_build, "shard int, block int, ids array<long>, blob binary")
    served = indexes.join(sizes, "shard").select("shard", "block", "ids", "blob", F.explode(F.sequence(F.lit(0), F.col("chunks").cast("int") - 1)).alias("chunk"))
    asking = trains.select("shard", "chunk", "cls", "symbols", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("block"))
    key = ["shard", "block", "chunk"]
    return served.groupBy(*key).cogroup(asking.groupBy(*key)).applyInPandas(_search, MATCH)


def class_pairs(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Record membership in classes, and the matching class pairs."""
    parts = cut(sides(records))
    return parts.drop("symbols", "calls"), matches(parts)


def found(records: DataFrame) -> DataFrame:
    """p2_found: pairs of a training and an evaluation record with the same calls and near-same request."""
    members, pairs = class_pairs(records)
    side = lambda name, cls, row: members.where(F.col("side") == name).select(F.col("cls").alias(cls), F.col("record_no").alias(row))
    links = pairs.select(F.col("train_cls").alias("a"), F.col("eval_cls").alias("b"))
    left, right = side("train", "a", "row_x"), side("eval", "b", "row_y")
    both = row_pairs(links, left, right, class_sizes(left, "a"), class_sizes(right, "b"))
    return both.select(F.least("row_x", "row_y").alias("record_a"), F.greatest("row_x", "row_y").alias("record_b"))


def report(records: DataFrame) -> DataFrame:
    """Overlaps by evaluation split, its source and the training source, counted from classes without expanding pairs.

    `pairs` counts record pairs, `exact_pairs` those with the same words in the same order or another,
    `eval_records` the evaluation records that stand in training data; `longest_span`
    is the longest maximal match, in words of the fixed order.
    """
    members, pairs = class_pairs(records)
    per = cut(members.withColumn("source_dataset", F.coalesce("source_dataset", F.lit("unknown"))).groupBy("cls", "side", "split", "source_dataset").agg(F.count("*").alias("n")))
    pairs = cut(pairs)
    t = per.where("side = 'train'").select(F.col("cls").alias("train_cls"), F.col("source_dataset").alias("train_source"), F.col("n").alias("t"))
    e = per.where("side = 'eval'").select(F.col("cls").alias("eval_cls"), "split", F.col("source_dataset").alias("eval_source"), F.col("n").alias("e"))
    joined = pairs.join(t, "train_cls").join(e, "eval_cls")
    exact = F.when(F.col("train_cls") == F.col("eval_cls"), F.col("t") * F.col("e")).otherwise(0)
    counts = joined.groupBy("split", "eval_source", "train_source").agg(F.sum(F.col("t") * F.col("e")).alias("pairs"), F.sum(exact).alias("exact_pairs"), F.max("longest").alias("longest_span"))
    hit = joined.select("eval_cls", "split", "eval_source", "train_source", "e").distinct().groupBy("split", "eval_source", "train_source").agg(F.sum("e").alias("eval_records"))
    return counts.join(hit, ["split", "eval_source", "train_source"])
