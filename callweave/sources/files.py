"""Readers, writers and checksums.

Edge cases: blank lines of JSON-lines files are skipped; a raw file that is missing or no JSON array
raises ValueError; row_index follows the order of the array; writers keep the given order column and
write one file a call of `one_file`, as many as there are partitions otherwise.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callweave.sources.arrays import array_elements

RAW = T.StructType([T.StructField("id", T.LongType()), T.StructField("query", T.StringType()), T.StructField("tools", T.StringType()), T.StructField("answers", T.StringType())])


def read_raw_array(spark: SparkSession, path: str) -> DataFrame:
    """Raw rows out of JSON arrays, with row_index by position; of several files in the order of their names.

    A file is read in splits, whatever its size and layout, and no task holds more than its splits. Elements
    are read from the file again by each action; a changed file raises.
    """
    value = F.from_json(F.concat(F.lit("["), "text", F.lit("]")), T.ArrayType(RAW), {"mode": "FAILFAST"})[0]
    return array_elements(spark, path).select("row_index", value.alias("r")).select("row_index", "r.*")


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines, blank ones skipped; lines that cannot be read raise."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever file system the path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_splits(spark: SparkSession, folder: str, schema: T.StructType | str, splits: tuple[str, ...] = ("train", "validation", "test")) -> DataFrame:
    """The split files of a folder as one table with `split`; all of them must be there."""
    missing = [s for s in splits if not exists(spark, f"{folder}/{s}.jsonl")]
    if missing:
        raise ValueError(f"missing split files: {missing}")
    out = None
    for s in splits:
        part = read_json_lines(spark, f"{folder}/{s}.jsonl", schema).withColumn("split", F.lit(s))
        out = part if out is None else out.unionByName(part)
    return out


def as_lines(rows: DataFrame, order: str = "row_index") -> DataFrame:
    """(row_index, line): each row but its order column as JSON, with the keys in the order of the columns; nulls are written."""
    return rows.select(F.col(order).alias("row_index"), F.to_json(F.struct(*(c for c in rows.columns if c != order)), {"ignoreNullFields": "false"}).alias("line"))


def write_json_lines(df: DataFrame, path: str, column: str, order: str | None = None, one_file: bool = False) -> None:
    """A column of JSON texts as lines; in the order of a column if named. One file is written by one task, made by all."""
    if one_file:
        df = df.repartition(1)
        df = df.sortWithinPartitions(order) if order else df
    elif order:
        df = df.orderBy(order)
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_raw_array(rows: DataFrame, path: str) -> None:
    """Raw rows (row_index, id, query, tools, answers) as one JSON array in the order of row_index, in one file.

    All tasks make compressed parts in order, of which the driver's JVM strings the bytes together, one part
    after the other. On disk there is never more than the shuffle and the parts, or the parts and the file.
    """
    spark, name = rows.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    jvm, conf, kept = spark._jvm, spark._jsc.hadoopConfiguration(), spark.conf.get(name, None)
    at = lambda *names: jvm.org.apache.hadoop.fs.Path("/".join((path, *names)))
    fs = at().getFileSystem(conf)
    fs.delete(at(), True)
    spark.conf.set(name, "true")  # the shuffle's files go when the parts are written
    try:
        lines = as_lines(rows.select("row_index", "id", "query", "tools", "answers").orderBy("row_index"))
        lines.select(F.concat(F.lit(","), "line").alias("value")).write.option("compression", "gzip").text(f"{path}/_parts")
    finally:
        spark.conf.set(name, kept) if kept is not None else spark.conf.unset(name)
    out, opening = fs.create(at("_array")), ord("[")
    try:
        for part in sorted(x.getPath().getName() for x in fs.listStatus(at("_parts")) if x.getPath().getName().startswith("part-")):
            text = jvm.java.util.zip.GZIPInputStream(fs.open(at("_parts", part)), 1 << 16)
            try:
                if (byte := text.read()) >= 0:
                    out.write(opening or byte)
                    opening = 0
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(text, out, 1 << 16, False)
            finally:
                text.close()
            fs.delete(at("_parts", part), False)
        out.write(bytearray(b"[]\n" if opening else b"]\n"))
    finally:
        out.close()
    fs.delete(at("_parts"), True)
    fs.rename(at("_array"), at("part-00000.txt"))


def write_records(prepared: DataFrame, path: str) -> int:
    """Canonical records as lines, all or nothing: with any failed row nothing is written and the count is returned."""
    failed = prepared.where("record is null").count()
    if not failed:
        write_json_lines(prepared, path, "record", "row_index")
    return failed


def write_report(report: dict[str, Any], path: str) -> None:
    """A small report as indented JSON with sorted keys, on the driver's machine."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(report, indent=2, ensure_ascii=False, sort_keys=True) + "\n", encoding="utf-8")


def source_metadata(path: str, build: Callable[[], dict[str, Any]]) -> dict[str, Any]:
    """The metadata kept in a file; on first use they are built and written there."""
    if not Path(path).is_file():
        write_report(build(), path)
    return json.loads(Path(path).read_text(encoding="utf-8"))


def as_report(rows: DataFrame) -> dict[str, Any]:
    """(measure, value, n) rows of a summary as a nested dict; a summary is small."""
    out: dict[str, Any] = {}
    for r in rows.collect():
        out.setdefault(r["measure"], {})[str(r["value"])] = r["n"]
    return out


_CHECKSUM = "path string, bytes long, line_count int, sha256 string"
#: On file systems that Python can't open, files up to this size are read as one value by a task; larger ones in blocks by the driver.
WHOLE_BYTES = 1 << 24


def _status(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(qualified path, bytes) of the files that a path or pattern names, those in folders too."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    out, todo = [], list(fs.globStatus(root) or [])
    while todo:
        x = todo.pop()
        if x.isDirectory():
            todo += [y for y in fs.listStatus(x.getPath()) if not y.getPath().getName().startswith(("_", "."))]
        else:
            out.append((x.getPath().toString(), x.getLen()))
    return out


def _summary(blocks: Iterator[bytes]) -> tuple[int, int, str]:
    """Size, non-blank lines and SHA-256 of the bytes that come in blocks, of which one is held at a time."""
    digest, size, lines, filled = hashlib.sha256(), 0, 0, False
    for block in blocks:
        digest.update(block)
        size += len(block)
        first, *rest = block.split(b"\n")
        filled = filled or bool(first.strip())
        for part in rest:
            lines += filled
            filled = bool(part.strip())
    return size, lines + filled, digest.hexdigest()


def _in_blocks(spark: SparkSession, path: str) -> tuple[str, int, int, str]:
    """Path, size, non-blank lines and SHA-256 of one file of any file system, read by the driver."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).open(target)
    try:
        return path, *_summary(iter(lambda: bytes(stream.readNBytes(1 << 20)), b""))
    finally:
        stream.close()


def _local(path: str) -> bool:
    """Whether Python can open a qualified path by its name: on a disk or a folder that is mounted."""
    return path.startswith("file:")


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of checksums for each path of a local file, read a block of 1 MiB at a time."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            with open(path.removeprefix("file:"), "rb") as f:
                size, lines, digest = _summary(iter(lambda f=f: f.read(1 << 20), b""))
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size]), pa.array([lines], pa.int32()), pa.array([digest])], names=["path", "bytes", "line_count", "sha256"])


def file_checksums(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, bytes, non-blank lines and SHA-256 of files; a line of white space only is blank.

    A file is one task's, which holds a block of it at a time whatever its size. What Python can't open by
    name (another file system) is read as one value if it is small, and by the driver in blocks if not.
    """
    found = sorted({x for p in paths for x in _status(spark, p)})
    empty = [(p, *_summary(iter(()))) for p, n in found if not n]  # a scan leaves them out
    near, far = [p for p, n in found if n and _local(p)], [(p, n) for p, n in found if n and not _local(p)]
    done = spark.createDataFrame([*empty, *(_in_blocks(spark, p) for p, n in far if n > WHOLE_BYTES)], _CHECKSUM)
    if near:
        done = spark.read.format("binaryFile").load(near).select("path").mapInArrow(_summaries, _CHECKSUM).unionByName(done)
    if small := [p for p, n in far if n <= WHOLE_BYTES]:
        lines = F.filter(F.split(F.col("content").cast("string"), "\n"), lambda x: F.trim(x, F.lit(" \t\r\x0b\x0c")) != "")
        columns = ["path", F.col("length").alias("bytes"), F.size(lines).alias("line_count"), F.sha2("content", 256).alias("sha256")]
        done = spark.read.format("binaryFile").load(small).select(*columns).unionByName(done)
    return done


def group_checksums(spark: SparkSession, groups: dict[str, list[str]]) -> DataFrame:
    """Checksums with the group that each file belongs to; a missing file raises."""
    names = [(g, p) for g, ps in groups.items() for p in ps]
    absent = [p for _, p in names if not exists(spark, p)]
    if absent:
        raise FileNotFoundError(f"missing artifacts: {absent}")
    full = lambda p: _qualified(spark, p)
    of = spark.createDataFrame([(g, full(p)) for g, p in names], "group string, path string")
    return of.join(file_checksums(spark, sorted({p for _, p in names})), "path")


def _qualified(spark: SparkSession, path: str) -> str:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString()


def write_preview(rows: DataFrame, path: str, columns: list[str]) -> None:
    """Rows as readable text, one block each under a rule of 100 characters; for samples."""
    lines = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in columns]
    rows.select(F.concat_ws("\n", F.lit("=" * 100), *lines).alias("value")).repartition(1).write.mode("overwrite").text(path)


def provenance(paths: list[str], revision: str | None = None, **about: str) -> dict[str, Any]:
    """Where files came from: size, SHA-256, revision and time of recording."""
    from datetime import UTC, datetime

    def one(path: str) -> dict[str, Any]:
        digest = hashlib.sha256()
        with open(path, "rb") as f:
            while block := f.read(1 << 20):
                digest.update(block)
        return {"path": path, "bytes": Path(path).stat().st_size, "sha256": digest.hexdigest()}

    return {"files": [one(p) for p in paths], "revision": revision, "recorded_at": datetime.now(UTC).isoformat(), **about}


def fetch_source(fetch: Callable[[str | None], str], resolve: Callable[[], dict[str, Any]], manifest: str) -> dict[str, Any]:
    """Fetch a source file at its resolved revision and write its manifest: size, SHA-256, revision, licence, time.

    `resolve` asks the source for what it is (revision, licence and so on), `fetch` brings the file of that
    revision and returns its path; the network and its credentials are theirs.
    """
    about = dict(resolve())
    report = provenance([fetch(about.get("revision"))], about.pop("revision", None), **about)
    write_report(report, manifest)
    return report


def find_revision(cache: str) -> str | None:
    """The revision of a download cache: its metadata file's first line, refs/main, or the only snapshot."""
    root = Path(cache)
    for path in (*sorted(root.glob("**/*.metadata")), root / "refs" / "main"):
        if path.is_file() and (lines := path.read_text(encoding="utf-8").split("\n")) and lines[0].strip():
            return lines[0].strip()
    snapshots = sorted(p.name for p in root.glob("snapshots/*") if p.is_dir())
    return snapshots[0] if len(snapshots) == 1 else None
