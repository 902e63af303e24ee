"""Token counts of texts by a public tokenizer whose vocabulary file's place is a parameter.

The file is read where the query is planned and broadcast (under a megabyte), so that workers need neither the folder nor
anything in it. No code of the folder runs.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files, and the file used by default.
TOKENIZERS = os.environ.get("VERSOFLOW_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# Fixed value: how the tokenizers of these files cut a text before they merge bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoders: dict[int, object] = {}


def vocabulary(folder: str = TOKENIZERS, file: str = VOCABULARY) -> bytes:
    with open(os.path.join(folder, file), "rb") as f:
        return f.read()


def encoder(data: bytes):
    """The tokenizer of a vocabulary file's contents; made once a worker."""
    key = hash(data)
    if key not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        _encoders[key] = tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def _mapper(data):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(data.value).encode_ordinary
        for batch in batches:
            counts = [len(encode(t)) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], [*batch.schema.names[:-1], "n_tokens"])

    return run


def token_counts(documents: DataFrame, keep: list[str], folder: str = TOKENIZERS, file: str = VOCABULARY) -> DataFrame:
    """The kept columns and ``n_tokens``; null and empty texts have 0 tokens. Narrow: no shuffle."""
    cut = documents.select(*keep, F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.select(*keep).schema) + ", n_tokens bigint"
    return cut.mapInArrow(_mapper(documents.sparkSession.sparkContext.broadcast(vocabulary(folder, file))), schema)
