"""Elements of JSON arrays, of files of any size and layout, read in splits.

A split of the text reader begins behind a closing brace, wherever that stands. The first pass counts
quotes and brackets of each split, from which follows whether it begins in a string and how deep; the
second one cuts the splits at the commas of the array, checks the elements and keeps what the borders cut
through; the third one, which is lazy, gives the elements. A task holds a split at most and the driver a
few numbers a split. A text is accepted only if all its elements are JSON and nothing stands around them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.session import cut

_TOKEN = re.compile(rb'"[^"\\]*+(?:\\.[^"\\]*+)*+"|["{}\[\],]', re.DOTALL)
_REST = re.compile(rb'[^"\\]*+(?:\\.[^"\\]*+)*+"', re.DOTALL)
#: A text is cut when so many bytes of it are there, and elements go on in batches of about as many.
_BYTES = 1 << 20

type Key = tuple[int, int]  # file, by the hash of its name, and first byte of the split


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Key, bytes]]:
    """(split, text) in order; each piece gets its closing brace back, the last one of a file one too many."""
    for batch in batches:
        files, starts, values = (batch.column(i) for i in range(3))
        files, starts, n, begin = files.to_numpy(), starts.to_numpy(), len(values), 0
        changes = ((files[1:] != files[:-1]) | (starts[1:] != starts[:-1])).nonzero()[0] + 1
        for end in (*changes.tolist(), n) if n else ():
            yield (int(files[begin]), int(starts[begin])), b"}".join(values.slice(begin, end - begin).to_pylist()) + b"}"
            begin = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each split: whether its quotes are odd, and its net brackets if it begins outside or inside a string; backslashes stand in strings only."""
    key, flips, depths = None, 0, [0, 0]
    row = lambda: pa.RecordBatch.from_pylist([{"file": key[0], "start": key[1], "odd": bool(flips), "outside": depths[0], "inside": depths[1]}])
    for at, text in _splits(batches):
        if at != key:
            if key:
                yield row()
            key, flips, depths = at, 0, [0, 0]
        parts = text.replace(b"\\\\", b"").replace(b'\\"', b"").split(b'"')
        for side in (0, 1):
            out = b"".join(parts[side::2])
            depths[side ^ flips] += out.count(b"{") + out.count(b"[") - out.count(b"}") - out.count(b"]")
        flips ^= (len(parts) - 1) & 1
    if key:
        yield row()


def _refuse(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def _sound(text: bytes) -> bool:
    try:
        json.loads(text, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return False
    return True


class _Cutter:
    """Cuts the text of a split at the commas of its array; an element belongs to the split in which it begins."""

    def __init__(self, first: bool, inside: bool, depth: int) -> None:
        self.inside, self.depth, self.first = inside, depth, first
        self.text, self.pos, self.wait, self.n = b"", 0, _BYTES, 0
        self.head: bytes | None = None
        self.after = self.closed = not first and depth <= 0
        self.bad, self.over = False, b""

    def feed(self, text: bytes, last: bool = False) -> list[tuple[int, bytes]]:
        """(number in the split, text) of the elements that have ended."""
        if self.closed:
            self.over = (self.over + text).strip()
            return []
        self.text += text
        return self._cut() if last or len(self.text) >= self.wait else []

    def _cut(self) -> list[tuple[int, bytes]]:
        text, begin, out = self.text, 0, []
        if self.inside:
            if not (m := _REST.match(text, self.pos)):
                self.wait = 2 * len(text)
                return out
            self.pos, self.inside = m.end(), False
        depth = self.depth
        for m in _TOKEN.finditer(text, self.pos):
            at, end = m.span()
            c = text[at]
            if c == 34:  # a string; a quote alone has its end in a later text
                if end - at == 1:
                    self.pos = at
                    break
            elif c in b"{[":
                if not depth:
                    self.bad = self.bad or c != 91 or bool(text[:at].strip())
                    self.n, begin = 1, end
                depth += 1
            elif c == 44:
                if depth == 1:
                    self._end(text[begin:at], out)
                    self.n, begin = self.n + 1, end
                elif not depth:
                    self.bad = True
            else:
                depth -= 1
                if depth <= 0:
                    self.bad = self.bad or c != 93 or depth < 0
                    if self.first and self.n == 1 and not text[begin:at].strip():
                        self.n = 0  # an array of nothing
                    else:
                        self._end(text[begin:at], out)
                    self.closed, self.over, self.text = True, text[end:].strip(), b""
                    return out
            self.pos = end
        self.text, self.pos, self.depth = text[begin:], self.pos - begin, depth
        self.wait = max(_BYTES, 2 * len(self.text))
        return out

    def _end(self, text: bytes, out: list[tuple[int, bytes]]) -> None:
        if self.n:
            out.append((self.n - 1, text))
        else:
            self.head = text

    def row(self, key: Key) -> dict[str, object]:
        """What there is to say of a split when all of it is read."""
        head, tail = self.head, None
        if not self.closed:
            head, tail = (head, self.text) if self.n else (self.text, None)
        braces = self.over.count(b"}")
        bad = self.bad or bool(self.over.replace(b"}", b"").strip()) or self.first and not self.n and not self.closed
        return {"file": key[0], "start": key[1], "n": self.n, "bad": bad, "closed": self.closed and not self.after, "braces": braces, "head": head, "tail": tail}


def _elements(batches: Iterator[pa.RecordBatch], states: dict[Key, tuple[bool, int]]) -> Iterator[tuple[Key, _Cutter, list[tuple[int, bytes]], bool]]:
    """(split, its cutter, elements that have ended, whether the split has)."""
    key, cutter = None, None
    for at, text in _splits(batches):
        if at != key:
            if key:
                yield key, cutter, cutter.feed(b"", True), True
            key, cutter = at, _Cutter(not at[1], *states[at])
        yield key, cutter, cutter.feed(text), False
    if key:
        yield key, cutter, cutter.feed(b"", True), True


_SPLIT = pa.schema([("file", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("bad", pa.bool_()), ("closed", pa.bool_()), ("braces", pa.int64()), ("head", pa.binary()), ("tail", pa.binary())])


def array_elements(spark: SparkSession, path: str) -> DataFrame:
    """(row_index, text) of the elements of JSON arrays, of several files in the order of their names."""
    name = F.input_file_name()
    names = sorted((r.name, r.file) for r in spark.read.format("binaryFile").load(path).select(name.alias("name"), F.xxhash64(name).alias("file")).collect())
    if len({f for _, f in names}) < len(names):
        raise RuntimeError("two names of files have one hash; rename a file")
    none = ValueError(f"{path} holds no JSON array")
    pieces = spark.read.option("lineSep", "}").text(path).select(F.xxhash64(name).alias("file"), F.input_file_block_start().alias("start"), F.col("value").cast("binary").alias("value"))

    counts: dict[int, list] = {}
    for r in pieces.mapInArrow(_counted, "file long, start long, odd boolean, outside long, inside long").collect():
        counts.setdefault(r.file, []).append(r)
    if not names or any(f not in counts for _, f in names):
        raise none
    states: dict[Key, tuple[bool, int]] = {}
    for rows in counts.values():
        inside, depth = False, 0
        for r in sorted(rows, key=lambda r: r.start):
            states[r.file, r.start] = inside, depth
            inside, depth = inside ^ r.odd, depth + (r.inside if inside else r.outside)

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, cutter, ended, over in _elements(batches, states):
            cutter.bad = cutter.bad or not all(_sound(text) for _, text in ended)
            if over:
                yield pa.RecordBatch.from_pylist([cutter.row(key)], schema=_SPLIT)

    splits = cut(pieces.mapInArrow(checked, "file long, start long, n long, bad boolean, closed boolean, braces long, head binary, tail binary"))
    said = {(r.file, r.start): r for r in splits.select("file", "start", "n", "bad", "closed", "braces", F.col("head").isNotNull().alias("head"), F.col("tail").isNotNull().alias("tail")).collect()}
    firsts: dict[Key, tuple[int, int, bool]] = {}
    joints: list[tuple[int, int, int | None, int | None]] = []
    total = 0
    for _, file in names:
        own = [said[file, start] for start in sorted(r.start for r in counts[file])]
        if any(r.bad for r in own) or sum(r.closed for r in own) != 1 or sum(r.braces for r in own) > 1:
            raise none
        for r in own:
            firsts[file, r.start] = total, r.n, r.closed
            if r.head or r.tail:
                joints.append((file, r.start, total - 1 if r.head else None, total + r.n - 1 if r.tail else None))
            total += r.n

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, texts, size = [], [], 0
        for key, cutter, ended, over in _elements(batches, states):
            first, *same = firsts[key]
            if over and same != [cutter.n, cutter.closed and not cutter.after]:
                raise RuntimeError("the file or its splits have changed since read_raw_array was called; call it again")
            for k, text in ended:
                at.append(first + k)
                texts.append(text)
                size += len(text)
                if size >= _BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(texts, pa.binary())], names=["row_index", "text"])
                    at, texts, size = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(texts, pa.binary())], names=["row_index", "text"])

    whole = pieces.mapInArrow(given, "row_index long, text binary").select("row_index", F.col("text").cast("string").alias("text"))
    if not joints:
        return whole
    of = splits.join(F.broadcast(spark.createDataFrame(joints, "file long, start long, ends long, begins long")), ["file", "start"])
    parts = of.select("start", F.explode(F.array(F.struct(F.col("ends").alias("row_index"), F.col("head").alias("part")), F.struct(F.col("begins").alias("row_index"), F.col("tail").alias("part")))).alias("p")).select("start", "p.*").where("row_index is not null")
    joined = cut(parts.groupBy("row_index").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "part"))), lambda x: F.hex(x["part"])), "").alias("text")).select("row_index", F.unhex("text").alias("text")))

    def unsound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([not _sound(text) for text in batch.column(0).to_pylist()], pa.bool_())], names=["bad"])

    if joined.select("text").mapInArrow(unsound, "bad boolean").where("bad").limit(1).count():
        raise none
    return whole.unionByName(joined.withColumn("text", F.col("text").cast("string")))
