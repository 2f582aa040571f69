"""Operator 7: byte-pair encoding and decoding."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import shared
from tracelake.llm.bpe import word_bpe


def _path(path: str | None) -> str:
    return path or public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and ``ids`` (binary: little-endian unsigned 32-bit integers).

    A null text is empty and has no ids; ids may be null or repeat; an empty table stays empty; further
    columns are not read. Row-local: no shuffle.
    """
    path = _path(path)

    def run(batches):
        bpe = word_bpe(path)
        for batch in shared.slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.packed(t) for t in batch.column(1).to_pylist()], pa.binary())], [id_col, "ids"])

    rows = docs.select(id_col, shared.text_of(text_col).alias(text_col))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """``encode``'s rows with ``decoded``, the ids' vocabulary strings joined; null ids give an empty text."""
    path = _path(path)

    def run(batches):
        bpe = word_bpe(path)
        for batch in shared.slices(batches):
            texts = [bpe.decode(np.frombuffer(ids or b"", "<u4").tolist()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], [id_col, "ids", "decoded"])

    rows = encoded.select(id_col, "ids")
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, ids binary, decoded string")


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode`` and then ``decode`` of its ids in one pass of one worker: id, ids, decoded. The same defined cases."""
    path = _path(path)

    def run(batches):
        bpe = word_bpe(path)
        for batch in shared.slices(batches):
            ids = [bpe.packed(t) for t in batch.column(1).to_pylist()]
            texts = [bpe.decode(np.frombuffer(i, "<u4").tolist()) for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], [id_col, "ids", "decoded"])

    rows = docs.select(id_col, shared.text_of(text_col).alias(text_col))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, ids binary, decoded string")


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = round_trip(shared.documents(spark, sf_dir))
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
