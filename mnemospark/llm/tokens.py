"""Text sizes in tokens of a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the published split pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.cache
def encoding(path: str = VOCABULARY, pattern: str = PATTERN):
    """The tokenizer of a vocabulary file, loaded once per process."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def with_token_counts(df: DataFrame, text: str, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``df`` without ``text`` and with n_tokens, the token count of the whole text; null and empty texts have 0.

    A column n_tokens that is already there is replaced. Every executor needs
    the vocabulary at ``path``.
    """
    base = df.drop("n_tokens")
    rest = [c for c in base.columns if c != text]
    place = base.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path, pattern).encode_ordinary
        for batch in batches:
            counts = pa.array([len(encode(t)) if t else 0 for t in batch.column(place).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)) for c in rest), counts], names=[*rest, "n_tokens"])

    return base.mapInArrow(run, base.select(*rest).withColumn("n_tokens", F.lit(0).cast("bigint")).schema)
