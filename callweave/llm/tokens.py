"""Token counts by a public tokenizer; the vocabulary file is a parameter and loaded once a worker."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.session import spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the rank files' text is split before merging, as their documentation gives it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts, chosen by the file's kind."""
    if path.endswith(".tiktoken"):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda texts: [len(x) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def token_counts(documents: DataFrame, keep: list[str], path: str = TOKENIZER) -> DataFrame:
    """The kept columns with `n_tokens` of the whole text; a null or empty text has 0."""
    slim = spread(documents.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("__text")))
    fields = [f for f in slim.schema.fields if f.name != "__text"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(path)
        for batch in batches:
            n = pa.array(of(batch.column(batch.num_columns - 1).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], names=[*batch.schema.names[:-1], "n_tokens"])

    return slim.mapInArrow(count, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["n_tokens long"]))
