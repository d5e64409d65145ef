"""Abusive, hateful or sexual content (problem 9): an NB-SVM style character n-gram classifier.

Features are hashed character n-grams of a segment (a sentence, chat turn or JSON string), scaled by
naive Bayes log-count ratios and weighted by a linear model that is trained on labelled documents.
A document's score is that of its worst segment, so one sentence in a long text counts as much as in
a short one. Labels are given for documents; which segments of a flagged document carry the label
is found by training in rounds (multiple-instance learning), and always by a model that has not seen
the document: the sample is cut into FOLDS parts by document, each part is scored by the model of the
others. First the segment whose n-grams are most typical of flagged documents elsewhere counts, then the
segments that the last models find abusive; labels that these contradict clearly are set aside, as
some are wrong. The threshold comes from the same held-out scores (see `choose_threshold`), so no
document speaks about itself; it is part of the model.

Before features, text is made comparable: compatibility forms, zero-width characters, look-alike
letters, accents, letters written as digits, letters spaced out or repeated.

Training takes a sample of at most MAX_TRAIN_DOCS labelled documents (those with the smallest hash of
doc_id; conflicting labels of a document count by majority, ties not at all) with their whole texts.
That bound is the only one: scoring takes every document and its whole text.

Edge cases: null or blank texts score 0; without at least one flagged and one unflagged label the
model scores everything 0 and flags nothing; null labels are left out; labels of unknown documents too.
Repeated documents score alike. Extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.session import cut, spread

#: Labelled documents that training takes at most: the one bound of this module.
MAX_TRAIN_DOCS = 8_000
#: The models of the last round and the last model take as many steps, so that their scores compare.
FOLDS, ROUNDS, STEPS = 3, 2, 24
ORDERS, BITS = (3, 4, 5), 19
#: Segments with fewer n-grams weigh as little as if they had so many: a name or a code is no sentence.
SHORT = 40
#: Segments that an n-gram must stand in to be looked at in training.
SEEN = 2
#: Characters that scoring turns into n-grams at a time: bounds the memory of a task.
BLOCK_CHARS = 1_000_000
#: Characters of the texts that are scored together, about.
GROUP_CHARS = 8_000_000
#: The threshold of a model whose held-out scores cannot tell (too few labels), and the least threshold.
EVEN, LEAST = 0.5, 0.3

# --- fixed values: letters that look like Latin ones, and digits or signs used for letters ---------
ALIKE = dict(zip("авекмнорстухіјѕԁɡһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧαοιν", "abekmhopctyxijsdghqwABEZHIKMNOPTYXaoiv"))
LEET = dict(zip("013457@$!€", "oieastasie"))
TAGS = "a|b|blockquote|body|br|code|div|em|h[1-6]|head|hr|html|i|img|li|ol|p|pre|script|span|strong|style|sub|sup|table|td|th|title|tr|u|ul"
# --- end of fixed values ----------------------------------------------------------------------------

_ALIKE = str.maketrans(ALIKE | {k.upper(): v.upper() for k, v in ALIKE.items() if k.upper() != k and len(k.upper()) == 1})
_LOOKALIKES = frozenset(map(chr, _ALIKE))
_HIDDEN = re.compile("[­​-‏‪-‮⁠-⁤﻿︀-️]")
_MOJIBAKE = re.compile("[ÃÂâ][\u0080-¿Œ-™]+")
_COMBINING = re.compile("[\u0300-\u036f]")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_*·]){3,}[^\W\d_](?![^\W_])")
_MAYBE_SPACED = re.compile(r"[ .\-_*·][^\W\d_][ .\-_*·][^\W\d_][ .\-_*·]")
_LEET = re.compile(r"(?<=[a-z])[013457@$!€](?=[a-z@$!€013457]|\b)|(?<![a-z0-9.])[@$013457](?=[a-z]{2})|(?<=[a-z])[013457@$€]{1,2}(?=[a-z])")
_MAYBE_LEET = re.compile(r"[@$!€013457](?<=[a-z].)|[@$013457](?=[a-z])")
_RUN = re.compile(r"([^\W\d_])\1{2,}")
_TAG = re.compile(rf"</?(?:{TAGS})\s*/?>", re.I)
_SPLIT = re.compile(r'[<>\n\r\t]+|(?<=[.!?])["\')\]]*\s+|": "|", "|(?<=["0-9a-z])[}\]]+(?=\W|$)')
_DIGITS = re.compile(r"[0-9]+")
_ROLE = re.compile(r"^\W*(?:user|assistant|system|tool)\s*:\s*")


def _repair(m: re.Match) -> str:
    try:
        return m[0].encode("cp1252").decode("utf-8")
    except UnicodeError:
        return m[0]


def _has_run(text: str) -> bool:
    """Whether some character stands three times in a row."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    twice = codes[1:] == codes[:-1]
    return bool((twice[1:] & twice[:-1]).any())


def comparable(text: str) -> str:
    """Lower-case text with disguises undone. The cheap looks first spare most texts the costly patterns."""
    if not text.isascii():
        text = _MOJIBAKE.sub(_repair, text)
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text))
        text = text if _LOOKALIKES.isdisjoint(text) else text.translate(_ALIKE)
        text = _COMBINING.sub("", unicodedata.normalize("NFD", text)).replace("ß", "ss")
    text = text.lower()
    if _MAYBE_SPACED.search(f" {text} "):
        text = _SPACED.sub(lambda m: re.sub(r"[ .\-_*·]", "", m[0]), text)
    if _MAYBE_LEET.search(text):
        text = _LEET.sub(lambda m: "".join(LEET.get(c, c) for c in m[0]), text)
    return _RUN.sub(r"\1", text) if _has_run(text) else text


def segments(text: str | None) -> list[str]:
    """Comparable segments of a text: sentences, turns, JSON strings and what stands between < and >, numbers as 0.

    Plain names of HTML tags go, all other text stays. A single word (a name, a code) says little alone
    and joins the segment before it.
    """
    if not text or not text.strip():
        return []
    out: list[str] = []
    for p in _SPLIT.split(_DIGITS.sub("0", comparable(_TAG.sub("\n", text) if "<" in text else text))):
        p = " ".join((_ROLE.sub("", p) if ":" in p else p).split()).strip(" \"'{}[]()")
        if out and " " not in p:
            if p:
                out[-1] += f" {p}"
        elif p:
            out.append(p)
    return out


_PRIME = np.uint64(0x9E3779B97F4A7C15)


def ngrams(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all segments, and the segment that each belongs to."""
    joined = "".join(f" {p} \0" for p in parts)
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    end = codes == 0
    part = (np.cumsum(end) - end).astype(np.int32)
    ids, owners = [], []
    h, clean = np.zeros(len(codes), np.uint64), np.ones(len(codes), bool)
    for n in range(1, max(ORDERS) + 1):  # each order extends the hashes of the one before by one character
        size = max(0, len(codes) - n + 1)
        h = (h[:size] ^ codes[n - 1 : n - 1 + size]) * _PRIME
        h ^= h >> np.uint64(29)
        clean = clean[:size] & ~end[n - 1 : n - 1 + size]
        if n in ORDERS:
            ids.append((h[clean] >> np.uint64(64 - BITS)).astype(np.int32))
            owners.append(part[:size][clean])
    return np.concatenate(ids), np.concatenate(owners)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    """Linear model over hashed n-grams; `weight` has the NB ratios multiplied in."""

    weight: np.ndarray
    bias: float
    threshold: float = EVEN

    def scores(self, parts: list[str]) -> np.ndarray:
        """Probability of each segment."""
        out, start = [np.zeros(0)], 0
        while start < len(parts):
            stop, chars = start, 0
            while stop < len(parts) and (stop == start or chars + len(parts[stop]) <= BLOCK_CHARS):
                chars += len(parts[stop])
                stop += 1
            ids, owner = ngrams(parts[start:stop])
            total = np.bincount(owner, self.weight[ids], stop - start)
            n = np.bincount(owner, minlength=stop - start)
            out.append(_sigmoid(total / np.sqrt(np.maximum(n, SHORT)) + self.bias))
            start = stop
        return np.concatenate(out)

    def worst(self, texts: list[str | None]) -> np.ndarray:
        """Score of each text; a segment that several texts hold is looked at once."""
        index: dict[str, int] = {}
        own, doc = [], []
        for d, text in enumerate(texts):
            found = {index.setdefault(p, len(index)) for p in segments(text)}
            own += found
            doc += [d] * len(found)
        worst = np.zeros(len(texts))
        np.maximum.at(worst, np.array(doc, np.int64), self.scores(list(index))[np.array(own, np.int64)])
        return worst


class _Rows:
    """Sparse counts of segments by row, scaled to the root of their length; n-grams of fewer than SEEN segments are left out."""

    def __init__(self, parts: list[str]) -> None:
        self.n = len(parts)
        keys, counts, size = [], [], np.zeros(self.n, np.int64)
        for start in range(0, self.n, 20_000):
            ids, owner = ngrams(parts[start : start + 20_000])
            key, times = np.unique((owner.astype(np.int64) + start) << BITS | ids, return_counts=True)
            keys.append(key)
            counts.append(times)
            size += np.bincount(owner + start, minlength=self.n)
        key, times = np.concatenate(keys), np.concatenate(counts)
        ids = (key & ((1 << BITS) - 1)).astype(np.int32)
        often = np.bincount(ids, minlength=1 << BITS)[ids] >= SEEN
        self.ids, self.row = ids[often], (key >> BITS).astype(np.int32)[often]
        self.value = (times[often] / np.sqrt(np.maximum(size, SHORT))[self.row]).astype(np.float32)
        self.by_id = np.argsort(self.ids, kind="stable").astype(np.int32)

    def score(self, weight: np.ndarray, bias: float) -> np.ndarray:
        return _sigmoid(np.bincount(self.row, weight[self.ids] * self.value, self.n) + bias)


def log_ratio(ids: np.ndarray, row: np.ndarray, y: np.ndarray, times: np.ndarray, alpha: float = 0.5) -> np.ndarray:
    """Naive Bayes log-count ratio of each n-gram, from its presence in positive and negative segments."""
    yes, no = y * times, (1 - y) * times
    pos = np.bincount(ids, yes[row], 1 << BITS) + alpha
    neg = np.bincount(ids, no[row], 1 << BITS) + alpha
    return (np.log(pos / (yes.sum() + 2 * alpha)) - np.log(neg / (no.sum() + 2 * alpha))).astype(np.float32)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of values in order: the distinct ones, the number of each value among them, and where each begins."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    starts = np.flatnonzero(new)
    return values[starts], np.cumsum(new) - 1, starts


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else np.zeros(0, np.float32)


def fit_linear(rows: _Rows, use: np.ndarray, y: np.ndarray, times: np.ndarray, steps: int = STEPS, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on the NB-scaled features of the segments in `use`, by Adam over all of them."""
    mine = use[rows.row]
    ids, row, value = rows.ids[mine], rows.row[mine], rows.value[mine]
    x = value * (ratio := log_ratio(ids, row, y, times * use))[ids]
    seen, slot, row_starts = _runs(row)  # rows come in order
    by = (np.cumsum(mine, dtype=np.int32) - 1)[rows.by_id[mine[rows.by_id]]]
    used, col_by, col_starts = _runs(ids[by])
    col = np.empty_like(col_by)
    col[by] = col_by
    x_by, slot_by, label = x[by], slot[by], y[seen].astype(np.float32)
    w, b = np.zeros(len(used), np.float32), 0.0
    m, v, mb, vb = np.zeros(len(used), np.float32), np.zeros(len(used), np.float32), 0.0, 0.0
    share = np.where(label > 0, 2.0, np.minimum(times[seen], 20.0)).astype(np.float32)
    share /= share.sum() / 4
    for t in range(1, steps + 1):
        g = ((_sigmoid(_sums(x * w[col], row_starts) + b) - label) * share).astype(np.float32)
        gw = _sums(x_by * g[slot_by], col_starts) + l2 * w
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2
        mb, vb = 0.9 * mb + 0.1 * float(g.sum()), 0.99 * vb + 0.01 * float(g.sum()) ** 2
        rate = 0.1 / (1 + t / 30)
        w = (w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    weight = np.zeros(1 << BITS, np.float32)
    weight[used] = w * ratio[used]
    return weight, float(b)


def choose_threshold(score: np.ndarray, label: np.ndarray) -> float:
    """The middle of the thresholds whose F-measure on held-out scores comes within 1 % of the best.

    Held-out scores are close to 0 or 1 for most documents, so many thresholds are nearly as good; the
    middle one is as far as can be from the documents on either side. Wrong labels lower the measure at
    every threshold alike.
    """
    grid = np.arange(LEAST, 0.96, 0.01)
    hit = np.array([((score > t) & (label == 1)).sum() for t in grid])
    f = 2 * hit / np.array([max(1, (score > t).sum() + (label == 1).sum()) for t in grid])
    return float(np.median(grid[f >= 0.99 * f.max()])) if hit.any() else EVEN


def train(documents: list[tuple[str, int]]) -> Model:
    """A model from (text, label) documents."""
    parts, doc, label, times = [], [], [], []
    index: dict[tuple[int, str], int] = {}
    for d, (text, y) in enumerate(documents):
        label.append(y)
        fold = xxhash.xxh32_intdigest(text or "") % FOLDS  # copies of a text stay together
        for p in dict.fromkeys(segments(text)):
            if not y and (fold, p) in index:
                times[index[fold, p]] += 1.0  # a segment of many unflagged documents: one row, as heavy as they are many
                continue
            if not y:
                index[fold, p] = len(parts)
            parts.append(p)
            doc.append(d)
            times.append(1.0)
    doc, times, y = np.array(doc, np.int64), np.array(times), np.array(label)
    of = y[doc] if len(doc) else np.zeros(0)
    if not (of == 1).any() or not (of == 0).any():
        return Model(np.zeros(1 << BITS, np.float32), -30.0, 1.0)
    fold = np.array([xxhash.xxh32_intdigest(t or "") % FOLDS for t, _ in documents])[doc]
    rows, positive, wrong = _Rows(parts), of == 1, np.zeros(len(parts), bool)
    score = np.zeros(len(parts))
    for k in range(ROUNDS + 1):
        for f in range(FOLDS):
            others = (fold != f) & (positive | ((of == 0) & ~wrong))
            if k == 0:  # how typical of flagged documents elsewhere the n-grams of a segment are
                mine = others[rows.row]
                weight, bias = log_ratio(rows.ids[mine], rows.row[mine], of.astype(float), times * others, alpha=1.0), 0.0
            else:
                weight, bias = fit_linear(rows, others, positive.astype(float), times, 10 if k < ROUNDS else STEPS)
            score[fold == f] = rows.score(weight, bias)[fold == f]
        threshold = EVEN if k == 0 else choose_threshold(_worst(doc, score, len(y)), y)
        positive = _best(doc, score, of) if k == 0 else (of == 1) & (score > threshold)
        wrong = (of == 0) & (score > 0.9) & (times < 3) & (k > 0)
        if not positive.any():  # too few labels to tell: the most likely segment of each flagged document
            positive, threshold = _best(doc, score, of), EVEN
    weight, bias = fit_linear(rows, positive | ((of == 0) & ~wrong), positive.astype(float), times)
    return Model(weight, bias, threshold)


def _worst(doc: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
    """The greatest score of each of n documents."""
    out = np.zeros(n)
    np.maximum.at(out, doc, score)
    return out


def _best(doc: np.ndarray, score: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The top segment of each flagged document."""
    order = np.lexsort((-score, doc))
    first = np.ones(len(order), bool)
    first[1:] = doc[order][1:] != doc[order][:-1]
    best = np.zeros(len(doc), bool)
    best[order[first]] = True
    return best & (of == 1)


# --- Spark -------------------------------------------------------------------------------------------


def labelled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, label of the training sample: majority labels, at most MAX_TRAIN_DOCS documents."""
    vote = F.when(F.col("flagged") == 1, 1).when(F.col("flagged") == 0, -1)
    votes = labels.groupBy("doc_id").agg(F.sum(vote).alias("v")).where("v <> 0").select("doc_id", (F.col("v") > 0).cast("int").alias("label"))
    sample = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN_DOCS)
    texts = documents.select("doc_id", "text").where("text is not null")
    return texts.join(F.broadcast(sample), "doc_id")  # MAX_TRAIN_DOCS rows of two numbers at most


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: (r[0], r[1]))
    model = train([(text, label) for _, text, label in rows])
    at = np.flatnonzero(model.weight)
    yield pa.RecordBatch.from_arrays(
        [pa.array([at.astype(np.int32).tobytes()]), pa.array([model.weight[at].tobytes()]), pa.array([model.bias]), pa.array([model.threshold])], names=["at", "weight", "bias", "threshold"]
    )


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """Train on the bounded sample: all tasks look for its documents, then one trains on what they found."""
    sample = cut(labelled(documents, labels)).repartition(1)
    row = sample.mapInArrow(_train, "at binary, weight binary, bias double, threshold double").first()
    weight = np.zeros(1 << BITS, np.float32)
    if row is None:
        return Model(weight, -30.0, 1.0)
    weight[np.frombuffer(row["at"], np.int32)] = np.frombuffer(row["weight"], np.float32)
    return Model(weight, row["bias"], row["threshold"])


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, source, score of every document; the model has a fixed size (2^BITS weights)."""
    shared = documents.sparkSession.sparkContext.broadcast((model.weight, model.bias, model.threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            group = np.cumsum([len(t or "") for t in texts]) // GROUP_CHARS  # segments that recur in a group are looked at once
            for g in np.unique(group):
                at, end = np.searchsorted(group, g), np.searchsorted(group, g, side="right")
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(own.worst(texts[at:end]), pa.float64())], names=["doc_id", "source", "score"])

    slim = spread(documents.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text"))
    return slim.mapInArrow(run, "doc_id long, source string, score double")


def scores(documents: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """Every document with its score and whether it passes the threshold; `model` spares the training."""
    model = model or fit(documents, labels)
    return score(documents, model).withColumn("flagged", F.col("score") > model.threshold)


def found(documents: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """p9_found: documents that are abusive, hateful or sexually explicit."""
    return scores(documents, labels, model).where("flagged").select("doc_id")


def rates(documents: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """Documents, flagged documents and their rate per source."""
    per = scores(documents, labels, model).groupBy(F.coalesce("source", F.lit("unknown")).alias("source"))
    return per.agg(F.count("*").alias("documents"), F.count_if("flagged").alias("flagged"), F.avg(F.col("flagged").cast("double")).alias("rate"), F.avg("score").alias("mean_score"))
