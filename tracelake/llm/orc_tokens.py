"""Operator 4: token ids in ORC files, in ascending document order.

Integer columns of ORC are run-length encoded; each stripe holds row indexes (every ``ROW_INDEX`` rows) and a
Bloom filter on the document id, so that a reader takes stripes in parallel and skips those that cannot
hold the ids asked for.
"""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tracelake.llm import shared
from tracelake.llm.library_ids import library_ids

END_ID, STRIPE_BYTES, ROW_INDEX = 1, 16 << 20, 1_000


def tokenised(rows: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """``rows`` (id, text) with ``ids`` array<int> in the place of text, the end id appended; order and partitions stay."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        of = library_ids(path)
        for batch in shared.slices(batches):
            packed = of.packed(batch.column("text").to_pylist())
            sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4 + 1
            values = pa.array(np.frombuffer(end.join([*packed, b""]), "<i4"))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists], ["id", "ids"])

    return rows.select("id", "text").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>")


def write_orc(docs: DataFrame, target: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> None:
    """Write one row per document (id, file number, place in it, ids), files and rows in ascending order of id.

    Texts are dealt out by ranges of id before they are tokenised, so sampling the ranges tokenises nothing. A
    null id comes first; repeated ids are ordered by a hash of their text, which also splits an id that holds
    many rows. A null text has the end id alone; an empty table writes no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), shared.text_of(text_col).alias("text"))
    salt = F.xxhash64("text")
    ranged = rows.repartitionByRange(partitions, "id", salt) if partitions else rows.repartitionByRange("id", salt)
    ids = tokenised(ranged.sortWithinPartitions("id", salt), path)
    at = F.monotonically_increasing_id()
    placed = ids.select("id", F.shiftright(at, 33).alias("file"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("place"), "ids")
    options = {"orc.bloom.filter.columns": "id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": str(ROW_INDEX), "orc.stripe.size": str(STRIPE_BYTES), "orc.compress": "ZSTD"}
    placed.write.options(**options).orc(target)


def read_orc(spark: SparkSession, target: str) -> DataFrame:
    """The rows that :func:`write_orc` wrote; filters on id and unread columns are pushed into the files."""
    return spark.read.orc(target)


def offsets(tokens: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32): start counts the ids of all documents before, from sums by file and then by place in it.

    A row of :func:`write_orc` gives a row: null ids and repeated ones too; an empty table gives none.
    """

    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            ends, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            sums = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("file"), batch.column("place"), pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())], ["id", "file", "place", "n_tokens", "ids_crc32"])

    kind = tokens.schema["id"].dataType.simpleString()
    sized = shared.stored(tokens.select("id", "file", "place", "ids").mapInArrow(run, f"id {kind}, file long, place long, n_tokens long, ids_crc32 long"), "token-sizes")
    files = sized.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    # one row a file
    before = files.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    within = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sized.withColumn("within", F.sum("n_tokens").over(within) - F.col("n_tokens"))
    return placed.join(before, "file").select("id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def op4_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = shared.shared_path(spark, "tokens-orc")
    write_orc(shared.documents(spark, sf_dir), target)
    return offsets(read_orc(spark, target)).withColumnRenamed("id", "doc_id")
