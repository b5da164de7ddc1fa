"""Token counts by overlap resynchronisation."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from weft.llm import kernels, tokens
from weft.llm.scratch import extended

#: Characters of a chunk, and of its overlap with the next.
CHUNK, OVERLAP = 1 << 12, 1 << 8


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """docs with n_bytes, n_tokens, over_limit and n_splices, as the library counts the whole text.

    A text beyond `chunk` characters is encoded in overlapping chunks, which are spliced at boundaries that both
    encodings prove (see tokens.Encoder); the overlap widens where they have none. Null text counts as empty (0
    tokens); rows are counted one by one; an empty table gives no rows; columns of docs with our names are replaced."""
    own = {"n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean", "n_splices": "bigint"}
    held = docs.drop(*own)
    schema = extended(held, **own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.held(("encoder", tokenizer), lambda: tokens.Encoder(tokenizer))
        for batch in kernels.slices(batches, text):
            offsets, _ = kernels.utf8(batch.column(text))
            texts = [t or "" for t in batch.column(text).to_pylist()]
            splices: list[list[int]] = [[] for _ in texts]
            short = iter(encoder.count([t for t in texts if len(t) <= chunk]))
            n = [next(short) if len(t) <= chunk else tokens.resynchronised(t, encoder, chunk, overlap, encoder.margin, s) for t, s in zip(texts, splices, strict=True)]
            columns = [pa.array(offsets[1:] - offsets[:-1], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n]), pa.array([len(s) for s in splices], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)

    return held.mapInArrow(run, schema)
