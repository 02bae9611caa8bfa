"""Token counts of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm import tokens
from chronofold.llm.common import lean


def runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours of about ``most`` bytes together, one at least."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def token_counts(docs: DataFrame, *, text: str = "text", into: str = "n_tokens", path: str | None = None, batch_bytes: int = 1 << 22) -> DataFrame:
    """``docs`` with the number of tokens of ``text`` in column ``into``.

    Only lengths leave the Arrow function. Texts go in batches of about
    ``batch_bytes``. Each is cut where the tokenizer would cut too, at a space
    after something that isn't white space; a text without such a place stays
    whole. The distinct segments of a batch are encoded together, and their
    lengths are kept for later batches and summed up by text. Null and empty
    texts count 0. Rows are neither merged nor dropped: repeated rows, null ids
    and an empty table come out as they went in. A column ``into`` that is
    already there is replaced; other columns pass unread.
    """
    path = path or tokens.default_path()

    @F.arrow_udf("long")
    @lean
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            lengths = tokens.encoder(path).lengths
            sizes = pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            counts = [lengths(batch[at:to]) for at, to in runs(sizes, batch_bytes)]
            yield pa.array(np.concatenate([np.zeros(0, np.int64), *counts]))

    return docs.withColumn(into, count(F.col(text).cast("string")))


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    from chronofold.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = token_counts(docs, into="n_tokens")
    return out.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))
