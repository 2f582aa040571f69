"""Operator 3: token counts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracelake.llm import shared
from tracelake.llm.bpe import word_bpe

LIMIT = 2048


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_bytes`` of its UTF-8 text, ``n_tokens``, ``over_limit`` (n_tokens > limit).

    The count is the initial symbols of all words minus the merges made; no ids are formed. A null text
    is empty (0 and 0), an id may be null, repeated rows each give a row, other columns are not read, and
    an empty table gives an empty result. Row-local: no shuffle.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")

    def run(batches):
        bpe = word_bpe(path)
        for batch in shared.slices(batches):
            sizes, counts = [], []
            for text in batch.column(1).to_pylist():
                sizes.append(len(text.encode("utf-8")))
                counts.append(bpe.count(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                [id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(id_col, shared.text_of(text_col).alias(text_col))
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(shared.documents(spark, sf_dir))
