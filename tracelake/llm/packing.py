"""Operator 2: harmonic packing of token sequences.

A piece of length n belongs to class k = capacity // n, and a sequence of class k holds k pieces whatever
their exact lengths, so workers place pieces without seeing one another's. Documents are cut so that this
wastes little: full sequences first, then, while a rest is long, a piece of exactly capacity // (k + 1) for
the rest's class k (which fills its own class without a gap) until a short rest remains.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tracelake.llm import shared
from tracelake.llm.library_ids import library_ids

CAPACITY, END_ID = 2048, 1
#: Rests of this class or above (at most capacity / 24 long) are not cut further: k of them fill a sequence to over 24 / 25.
UNCUT = 24


def cuts(n: int, capacity: int = CAPACITY, uncut: int = UNCUT) -> list[int]:
    """Lengths of the pieces of ``n`` tokens, in order."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n:
        k = capacity // n
        piece = n if k >= uncut or n * k == capacity or n == capacity // k else capacity // (k + 1)
        out.append(piece)
        n -= piece
    return out


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, the class k, and its number in the class within its partition. Row-local."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        of = library_ids(path)
        counts: Counter = Counter()
        for batch in shared.slices(batches):
            doc, start, length, crc, total, local = [], [], [], [], [], []
            for k, ids in enumerate(of.packed(batch.column(1).to_pylist())):
                ids, at = ids + end, 0
                n = len(ids) // 4
                for size in cuts(n, capacity):
                    doc.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                    total.append(n)
                    local.append(counts[capacity // size])
                    counts[capacity // size] += 1
                    at += size
            columns = [pa.array(c, pa.int64()) for c in (start, length, crc, total, [capacity // n for n in length], local)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc, pa.int64())), *columns], ["id", "start", "length", "ids_crc32", "doc_tokens", "class", "local"])

    rows = docs.select(F.col(id_col).alias("id"), shared.text_of(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, class long, local long")


def _fitted(capacity: int):
    """Best fit, longest first, of the few pieces that fill no sequence of their class."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "at"], ascending=[False, True], kind="stable")
        room: list[tuple[int, int]] = []  # (room left, sequence), ascending
        bins = []
        opened = 0
        for n in rows["length"]:
            k = bisect.bisect_left(room, (n, -1))
            if k == len(room):
                bins.append(opened)
                left, opened = (capacity, opened), opened + 1
            else:
                left = room.pop(k)
                bins.append(left[1])
            if left[0] > n:
                bisect.insort(room, (int(left[0] - n), left[1]))
        return rows.assign(bin=bins)[["at", "bin"]]

    return run


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every token (ids of the text, then the end id) lies in one piece; a sequence's pieces stand one after
    the other from offset 0 and take at most ``capacity`` tokens. A null or empty text is one piece of one
    token; ids may be null and rows may repeat; an empty table gives an empty result; further columns are not read.

    Each worker numbers its pieces within their class; a count per class and partition and its running sum
    over partitions make the numbers global; number // k is the sequence. Fewer than k pieces a class are left over, at most a few thousand
    for all classes whatever the input; those are packed together by best fit.
    """
    spark = docs.sparkSession
    made = shared.stored(pieces(docs, path, capacity, id_col, text_col).withColumn("at", F.monotonically_increasing_id()), "pieces")
    made = made.withColumn("part", F.shiftright("at", 33))
    full = F.col("class") == 1
    counted = made.where(~full).groupBy("class", "part").agg(F.count("*").alias("n"))
    by_part = Window.partitionBy("class").orderBy("part")
    ahead = counted.select("class", "part", (F.sum("n").over(by_part) - F.col("n")).alias("ahead"), F.sum("n").over(Window.partitionBy("class")).alias("total"))
    numbered = made.where(~full).join(ahead, ["class", "part"]).withColumn("number", F.col("ahead") + F.col("local"))
    numbered = shared.stored(numbered, "numbered")
    whole = F.col("number") < F.col("total") - F.col("total") % F.col("class")
    # sequence ids: class, then number; class 0 for leftovers, and bit 62 for full sequences
    in_class = numbered.where(whole).withColumn("sequence_id", F.shiftleft("class", 40) + F.floor(F.col("number") / F.col("class")))
    left = numbered.where(~whole)
    fitted = left.select("length", "at").groupBy(F.lit(0).alias("all")).applyInPandas(_fitted(capacity), "at long, bin long")
    leftover = left.join(fitted, "at").withColumn("sequence_id", F.col("bin"))
    alone = made.where(full).withColumn("sequence_id", F.col("at") + F.lit(1 << 62))
    columns = [F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id"]
    in_order = Window.partitionBy("sequence_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shared_rows = in_class.select(*columns, "at").unionByName(leftover.select(*columns, "at"))
    placed = shared_rows.withColumn("offset", F.sum("length").over(in_order) - F.col("length")).drop("at")
    return placed.unionByName(alone.select(*columns, F.lit(0).cast("long").alias("offset")))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(shared.documents(spark, sf_dir))
