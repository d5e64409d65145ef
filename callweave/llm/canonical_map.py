"""Free-entered type names mapped to a canonical list (problem 3). SQL only.

Partition-based pigeonhole join. The reference list is a table of writings (`ref`) and the entry that
each means (`target`): `reference_table` makes it from the catalog, each entry written out by its
structure, and any table of aliases can take its place. An input value is normalised (optional marks,
defaults, quoting and spaces are not part of the type) and grouped, so each distinct value is looked up
once. Two strings within k edits share at least one of k+1 consecutive segments of the reference string,
at a shift that its number and the difference of lengths bound; so the join is an equality join on
(reference length, segment number, segment), verified by the built-in levenshtein. Here one edit counts
as a match (k = 1), and so does a swap of neighbours. Values without a match come out with type 0 by an
anti-join. Nothing is collected: distinct values, writings and results are tables, and a value that very
many rows have leaves the shuffle of the last join.

Edge cases: null types are no input and give no row; a value that is exactly a canonical entry is
not reported; an empty or blank value means no entry (0); values of k characters or fewer only match
exactly; ties go to the fewest edits, then to the lowest type_id; a writing of two entries belongs to a
simple one before a generic one, then to the lower type_id. Very long values take part with
their whole text. Extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.session import cut, hot_join

# --- fixed values: names of the simple types, singular and plural -------------------------------
SIMPLE = {
    "str": ["str", "string", "text", "varchar", "varchar(255)", "nvarchar", "char", "characters", "chaîne", "chaîne de caractères", "texte", "zeichenkette", "cadena", "cadena de texto", "texto", "char sequence", "character sequence", "plain text", "string value", "text value", "a string", "a text", "builtins.str", "unicode", "unicode string", "free text"],
    "int": ["int", "integer", "whole number", "ganzzahl", "entier", "nombre entier", "entero", "número entero", "inteiro", "numpy.int64", "np.int64", "an integer", "an int", "a whole number", "int8", "int16", "int32", "int64", "smallint", "bigint", "long", "integer value", "builtins.int", "integer number", "uint32", "uint64"],
    "float": ["float", "number", "double", "decimal", "real", "real number", "floating point", "floating point number", "floating-point number", "decimal number", "gleitkommazahl", "flottant", "flotante", "nombre", "a float", "a number", "a decimal", "float32", "float64", "numpy.float64", "np.float64", "numeric", "numeric value", "double precision", "builtins.float"],
    "bool": ["bool", "boolean", "booléen", "booleano", "boolesch", "wahrheitswert", "yes/no", "yes or no", "true or false", "true/false", "logical", "logical value", "a boolean", "a bool", "boolean value", "numpy.bool_", "np.bool_", "builtins.bool"],
    "list": ["list", "array", "liste", "lista", "a list", "an array", "list of anything", "array of anything", "list of any", "array of any", "list of values", "array of values", "list[any]", "arraylist", "builtins.list", "any[]"],
    "dict": ["dict", "object", "dictionary", "map", "mapping", "hashmap", "a dict", "an object", "a dictionary", "a mapping", "json object", "wörterbuch", "dictionnaire", "diccionario", "builtins.dict", "key-value map", "associative array"],
    "set": ["set", "hashset", "a set", "frozenset", "menge", "ensemble", "conjunto", "builtins.set", "set of anything", "set[any]", "unique values", "distinct values"],
    "tuple": ["tuple", "a tuple", "tupel", "tupla", "builtins.tuple", "tuple of anything"],
    "any": ["any", "anything", "any type", "any value", "any kind", "whatever type", "arbitrary"],
    "bytes": ["bytes", "bytearray", "binary", "blob", "byte string", "byte array", "byte[]", "raw bytes", "octets", "builtins.bytes", "varbinary", "binary data"],
    "date": ["date", "calendar date", "calendar day", "date (yyyy-mm-dd)", "yyyy-mm-dd", "datetime.date", "datum", "fecha", "iso date", "localdate", "a date"],
    "datetime": ["datetime", "timestamp", "date-time", "date time", "date and time", "datetime.datetime", "point in time", "iso timestamp", "iso datetime", "localdatetime", "zeitstempel", "horodatage", "a datetime", "a timestamp"],
    "callable": ["callable", "function", "callback", "callback function", "a function", "a callable", "func", "lambda", "funktion", "fonction", "función", "callable object", "python function", "typing.callable", "callable[...,any]", "callable[[],any]"],
}
ELEMENT = {
    "str": ["str", "string", "text", "varchar"],
    "int": ["int", "integer", "long", "int64", "int32", "whole number"],
    "float": ["float", "double", "number", "decimal", "float64"],
    "bool": ["bool", "boolean"],
    "any": ["any", "anything", "object"],
}
PLURAL = {
    "str": ["str", "strs", "strings", "texts", "string", "text"],
    "int": ["ints", "integers", "whole numbers", "int", "integer"],
    "float": ["floats", "doubles", "decimals", "numbers", "decimal numbers", "float", "double"],
    "bool": ["bools", "booleans", "bool", "boolean", "yes/no values", "true/false values"],
    "dict": ["objects", "dictionaries", "dicts", "mappings", "maps"],
}
LISTS = ["list", "array", "arraylist", "typing.list", "sequence", "vector", "typing.sequence"]
SETS = ["set", "hashset", "typing.set", "frozenset"]
TUPLES = ["tuple", "pair", "typing.tuple"]
MAPS = ["dict", "map", "hashmap", "typing.dict", "dictionary", "mapping", "record"]
UNIONS = ["union", "either", "typing.union", "oneof"]
# --- end of fixed values -----------------------------------------------------------------------


def _split_top(text: str) -> list[str]:
    parts, depth = [""], 0
    for c in text:
        depth += (c == "[") - (c == "]")
        if c == "," and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return parts


def _generic(names: list[str], inner: set[str]) -> set[str]:
    return {f"{n}{a}{x}{b}" for n, x in product(names, inner) for a, b in ("[]", "<>")}


def writings(canonical: str) -> set[str]:
    """All known normalised writings of a catalog entry, from its structure."""
    name = re.sub(r"\s+", "", canonical).lower()
    if name in SIMPLE:
        out = set(SIMPLE[name])
        if name in ("list", "dict", "set", "tuple", "any"):
            out.add(f"typing.{name}")
        return out
    m = re.fullmatch(r"(\w+)\[(.*)\]", name)
    if not m:
        return {name}
    head, args = m[1], _split_top(m[2])
    kinds = [re.match(r"\w+", a)[0] for a in args]
    words = [set(ELEMENT.get(k, [k])) for k in kinds]
    pairs = {f"{a},{b}" for a, b in product(words[0], words[-1])} if len(args) == 2 else set()
    out = {name}
    if head == "list" and args[0] in ELEMENT:
        out |= _generic(LISTS, words[0]) | {f"{x}[]" for x in words[0]}
        out |= {f"{a}{h} of {p}" for a, h, p in product(("", "a ", "an "), ("list", "array"), PLURAL[kinds[0]])}
    elif head == "list" and kinds[0] == "list":
        x = _split_top(args[0][5:-1])[0]
        inner = _generic(LISTS[:4], set(ELEMENT[x]))
        out |= _generic(LISTS[:4], inner | {f"{e}[]" for e in ELEMENT[x]}) | {f"{e}[][]" for e in ELEMENT[x]} | {f"{g}[]" for g in inner}
        out |= {f"{a}{h} of {g} of {p}" for a, h, g, p in product(("", "a ", "an "), ("list", "array"), ("lists", "arrays"), PLURAL[x])} | {f"{e} matrix" for e in ELEMENT[x]}
    elif head == "list":
        inner = writings(args[0])
        short = {w for w in inner if not re.search(r"\s", w)}
        out |= _generic(LISTS[:4], short) | {f"{w}[]" for w in short}
        if kinds[0] == "dict":
            out |= {f"{a}{h} of {p}" for a, h, p in product(("", "a ", "an "), ("list", "array"), PLURAL["dict"])} | _generic(LISTS[:4], {"dict", "object", "map"}) | {"object[]", "dict[]"}
        else:
            x = _split_top(args[0][len(kinds[0]) + 1 : -1])[0]
            out |= {f"{a}{h} of {g} of {p}" for a, h, g, p in product(("", "a ", "an "), ("list", "array"), ("pairs", "tuples", "tuples of two"), PLURAL[x])}
            out |= {f"{a}{h} of {p} pairs" for a, h, p in product(("", "a ", "an "), ("list", "array"), [*ELEMENT[x], "number"] if x == "float" else ELEMENT[x])}
    elif head == "tuple":
        out |= _generic(TUPLES, pairs) | {f"({p})" for p in pairs}
        if kinds[0] == kinds[-1]:
            out |= {f"{t}{p}" for t, p in product(("two ", "pair of ", "a pair of ", "tuple of two ", "a tuple of two ", "tuple of "), PLURAL[kinds[0]])}
    elif head == "set":
        out |= _generic(SETS, words[0]) | {f"{t}{p}" for t, p in product(("set of ", "a set of ", "unique ", "distinct ", "set of unique ", "set of distinct "), PLURAL[kinds[0]])}
    elif head == "dict":
        out |= _generic(MAPS, pairs) | {f"{{{a}:{b}}}" for a, b in product(*words)}
        ends = set(words[1]) | set(PLURAL.get(kinds[1], []))
        starts = words[0] | set(PLURAL.get(kinds[0], []))
        out |= {t.format(a, b) for t, a, b in product(("mapping from {} to {}", "a mapping from {} to {}", "map from {} to {}", "mapping of {} to {}", "dictionary of {} to {}", "a dictionary of {} to {}", "dict of {} to {}", "dict from {} to {}", "dict with {} keys and {} values", "dictionary with {} keys and {} values", "object with {} keys and {} values"), starts, ends)}
    elif head == "union":
        for a, b in [*product(words[0], words[1]), *product(words[1], words[0])]:
            out |= {f"{a}|{b}", f"{a} or {b}", f"either {a} or {b}", f"{a}/{b}"} | {f"{u}{o}{a},{b}{c}" for u, (o, c) in product(UNIONS, ("[]", "<>"))}
    return out


def reference_rows(canonicals: list[str]) -> list[tuple[str, str]]:
    """(writing, canonical) of a list of entries; a writing of two entries stays with the entry named first."""
    seen: dict[str, str] = {}
    for simple in (True, False):
        for c in canonicals:
            if ("[" not in c) == simple:
                for w in sorted(writings(c)):
                    seen.setdefault(w, c)
    return sorted(seen.items())


def _write_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(w, c, t) for c, t in zip(*(x.to_pylist() for x in batch.columns)) for w in sorted(writings(c))]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int32()))], names=["ref", "canonical", "target"])


def reference_table(catalog: DataFrame) -> DataFrame:
    """ref, target: the writings of each catalog entry (canonical, type_id), one row a writing."""
    entries = catalog.select(F.col("canonical").cast("string"), F.col("type_id").cast("int")).dropna()
    rows = entries.mapInArrow(_write_out, "ref string, canonical string, target int")
    return _sql(catalog.sparkSession, "SELECT ref, min(struct(instr(canonical, '[') > 0 AS generic, target)).target AS target FROM rows GROUP BY ref", rows=rows)


def _sql(spark: SparkSession, text: str, **views: DataFrame) -> DataFrame:
    """SQL over DataFrames under names of this call only, so calls at the same time are apart."""
    names = {name: f"cm_{name}_{uuid.uuid4().hex}" for name in views}
    for name, df in views.items():
        df.createOrReplaceTempView(names[name])
        text = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {names[name]}", text)
    try:
        return spark.sql(text)
    finally:
        for name in names.values():
            spark.catalog.dropTempView(name)


#: (pattern, replacement), applied in this order to the lower-cased value. RE2 and Java read them alike.
STEPS = [
    (r"[\s\x{00a0}]+", " "),
    (r"[ ;]*,? ?\(?\bdefault(s to| value| is)? ?[:=]? ?('[^']*'|\"[^\"]*\"|[^ ,\[\]<>]+)\)?[ ;]*$", "\u0001"),
    (r"^\u0001$", "default"),
    (r"\u0001", ""),
    (r"[ ;]*[,(\[|]? ?\boptional\b ?[)\]]?[ ;]*$", ""),
    (r"^[ ;`'\"]+|[ ;`'\".]+$", ""),
    (r"^optional ?[\[<](.*)[\]>]$", "$1"),
    (r"^optional (\w)", "$1"),
    (r"^union ?\[(.*), ?none(type)?\]$", "$1"),
    (r" ?\| ?(none|null)$", ""),
    (r"^[ ;`'\"]+|[ ;`'\".]+$", ""),
    (r"^<([^<>]*)>$", "$1"),
    (r"^\{([^:{}]*)\}$", "$1"),
    (r"^[ ;`'\"]+|[ ;`'\".]+$", ""),
    (r" ?([\[\]<>{},:|]) ?", "$1"),
    (r"\( ", "("),
    (r" \)", ")"),
    (r"^\((\w+) ?, ?(\w+)\)$", "($1,$2)"),
    (r"\.$", ""),
]


def normal_sql(column: str, dialect: str = "spark") -> str:
    """SQL that normalises a type value."""
    out = f"lower({column})"
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    for pattern, to in STEPS:
        if dialect == "spark":
            p = "r'" + pattern.replace("'", r"\x27") + "'"
            out = f"regexp_replace({out}, {p}, '{to}')"
        else:
            out = f"regexp_replace({out}, {quote(pattern.replace(chr(92) + 'u0001', chr(1)))}, '{to.replace('$', chr(92))}', 'g')"
    return out


def _segments_sql(k: int, table: str) -> str:
    """(ref, ref_len, seg, pos, piece): reference strings cut into k+1 consecutive pieces of near equal length."""
    return f"""
      SELECT ref, ref_len, seg,
             CAST(seg * (ref_len div {k + 1}) + greatest(0, seg - ({k + 1} - ref_len % {k + 1})) AS INT) AS pos,
             substring(ref, CAST(1 + seg * (ref_len div {k + 1}) + greatest(0, seg - ({k + 1} - ref_len % {k + 1})) AS INT),
                       CAST((ref_len div {k + 1}) + CASE WHEN seg >= {k + 1} - ref_len % {k + 1} THEN 1 ELSE 0 END AS INT)) AS piece
      FROM (SELECT ref, length(ref) AS ref_len, explode(sequence(0, {k})) AS seg FROM {table})"""


def map_values(values: DataFrame, refs: DataFrame, k: int = 1) -> DataFrame:
    """Distinct strings (column `value`) joined to `refs` (ref, target): value, target, ref, edits; 0 where none matches.

    Segment i of a reference string can stand, shifted by at most i edits before it and k - i after it,
    so with the difference of lengths d its shift lies within both -i..i and d-(k-i)..d+(k-i). A swap of
    neighbours keeps the letters: it is found by equality of the sorted letters. The longest reference
    bounds what each value can probe, so very long values cost no more than short ones.
    """
    low = f"greatest(s.pos + 1 - s.seg, s.pos + 1 + length(v.value) - s.ref_len - ({k} - s.seg))"
    high = f"least(s.pos + 1 + s.seg, s.pos + 1 + length(v.value) - s.ref_len + ({k} - s.seg))"
    letters = "array_join(array_sort(split({}, '')), '')"
    return _sql(values.sparkSession, f"""
      WITH v AS (SELECT DISTINCT value FROM given),
      seg AS ({_segments_sql(k, "refs")}),
      shape AS (SELECT ref_len, seg, pos, length(piece) AS piece_len FROM seg GROUP BY ALL),
      probe AS (
        SELECT value, ref_len, seg, substring(value, at, piece_len) AS piece FROM (
          SELECT v.value, s.ref_len, s.seg, s.piece_len, explode(CASE WHEN {low} <= {high} THEN sequence(greatest(1, {low}), greatest(1, {high})) END) AS at
          FROM (SELECT value, explode(sequence(length(value) - {k}, length(value) + {k})) AS want FROM v
                WHERE length(value) BETWEEN {k + 1} AND (SELECT max(length(ref)) + {k} FROM refs)) v
          JOIN shape s ON s.ref_len = v.want)
        WHERE at + piece_len - 1 <= length(value)),
      cand AS (
        SELECT DISTINCT p.value, g.ref FROM probe p JOIN seg g
        ON p.ref_len = g.ref_len AND p.seg = g.seg AND p.piece = g.piece),
      hit AS (
        SELECT c.value, c.ref, levenshtein(c.value, c.ref) AS edits FROM cand c WHERE levenshtein(c.value, c.ref) <= {k}
        UNION ALL
        SELECT v.value, r.ref, 1 FROM (SELECT value, {letters.format("value")} AS letters FROM v WHERE length(value) > {k}) v
        JOIN (SELECT ref, {letters.format("ref")} AS letters FROM refs) r ON v.letters = r.letters WHERE levenshtein(v.value, r.ref) = 2
        UNION ALL SELECT v.value, r.ref, 0 FROM v JOIN refs r ON v.value = r.ref WHERE length(v.value) <= {k}),
      best AS (SELECT h.value, min(struct(h.edits, r.target, h.ref)) AS b FROM hit h JOIN refs r ON r.ref = h.ref GROUP BY h.value)
      SELECT value, b.target AS target, b.ref AS ref, b.edits AS edits FROM best
      UNION ALL
      SELECT v.value, CAST(0 AS INT), CAST(NULL AS STRING), CAST(NULL AS INT) FROM v LEFT ANTI JOIN best ON v.value = best.value""", given=values, refs=refs)


def mapped_types(param_types: DataFrame, refs: DataFrame, k: int = 1) -> DataFrame:
    """Each distinct `type` that is not null: raw value, its rows, normalised value, type_id (0: none), matched writing, edits."""
    spark = param_types.sparkSession
    refs = cut(refs)
    raw = cut(_sql(spark, f"SELECT type, n, {normal_sql('type')} AS value FROM (SELECT type, count(*) AS n FROM input WHERE type IS NOT NULL GROUP BY type)", input=param_types.select("type")))
    mapped = cut(map_values(raw.select("value"), refs, k))
    per = _sql(spark, "SELECT value, count(*) AS types FROM raw GROUP BY value", raw=raw)
    named = _sql(spark, "SELECT m.value, m.target AS type_id, m.ref AS matched, m.edits, p.types FROM mapped m JOIN per p ON m.value = p.value", mapped=mapped, per=per)
    return hot_join(raw, cut(named), "value", "types").drop("types")


def found(spark: SparkSession, param_types: DataFrame, catalog: DataFrame, refs: DataFrame | None = None, k: int = 1) -> DataFrame:
    """p3_found: rows whose type is no canonical entry itself, with the entry that it means or 0.

    `refs` (ref, target) is the table of aliases; that of the catalog if none is given.
    """
    types = mapped_types(param_types, reference_table(catalog) if refs is None else refs, k)
    other = cut(_sql(spark, "SELECT type, n, type_id FROM types LEFT ANTI JOIN catalog ON type = canonical", types=types, catalog=catalog.select("canonical")))
    return hot_join(_sql(spark, "SELECT param_id, type FROM input WHERE type IS NOT NULL", input=param_types.select("param_id", "type")), other, "type").select("param_id", "type_id")


def unmatched(spark: SparkSession, param_types: DataFrame, catalog: DataFrame, refs: DataFrame | None = None, k: int = 1) -> DataFrame:
    """The values that mean no entry, with the rows that hold them."""
    types = mapped_types(param_types, reference_table(catalog) if refs is None else refs, k)
    return _sql(spark, "SELECT type, n AS n_rows FROM types WHERE type_id = 0", types=types)
