"""Operator 10: token counts by rank-synchronous array merging."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.bpe import VOCABULARY, Counter, worker
from postmill.llm.common import id_and_text, slices, utf8


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each document; one narrow pass, no shuffle.

    vocabulary: a file in the public tokenizers' folder, or a path. A null or empty text has 0 bytes and 0 tokens;
    a null id stays null; repeated rows are counted one by one; other columns are not read.
    """

    def run(batches):
        counter = worker(Counter, vocabulary)
        for part in slices(batches, "text"):
            n = counter.of(part.column(1))
            yield pa.record_batch([part.column(0), pa.array(np.diff(utf8(part.column(1))[1])), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])

    counted = id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
