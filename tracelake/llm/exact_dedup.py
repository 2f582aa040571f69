"""Operator 1: exact dedup with a log-structured merge index of text digests.

Documents are first logged (id, row number, digest, length). Memtables take the log's rows, one entry a
digest; a full one is flushed as a run sorted by digest with a Bloom filter on it, one file a run.
Compaction merges runs and keeps for each digest the entry that ranks first. Digests with more than one
document are hits: their texts are compared byte for byte, and texts that only share a digest are
kept apart.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import shared

#: Entries of a memtable, and the least and most bits of the filter of hits: 16 for each hit in between, at most 16 MB.
MEMTABLE, FILTER_LEAST, FILTER_MOST = 200_000, 1 << 20, 1 << 27
_PROBES = 4


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")


class DigestIndex:
    """Sorted runs and one compacted level under a folder.

    ``append`` may be called again for later documents; ``compact`` merges what there is.
    """

    def __init__(self, spark: SparkSession, path: str, memtable: int = MEMTABLE):
        self.spark, self.path, self.memtable, self.runs, self.level, self.flushes = spark, path, memtable, [], None, 0

    def append(self, log: DataFrame) -> None:
        """Flush runs of ``log``'s rows (digest, variant, n, id, row)."""
        size, kind = self.memtable, log.schema["id"].dataType.simpleString()
        schema = f"digest string, variant long, n long, id {kind}, row long, copies long"

        def flushed(table: dict, like: pa.Schema) -> pa.RecordBatch:
            keys = sorted(table)
            cells = [table[k] for k in keys]
            columns = [[k[0] for k in keys], [k[1] for k in keys], [-c[0][0] for c in cells], [c[0][2] for c in cells], [c[0][3] for c in cells], [c[1] for c in cells]]
            kinds = [pa.string(), pa.int64(), pa.int64(), like.field("id").type, pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["digest", "variant", "n", "id", "row", "copies"])

        def run(batches):
            table, like = {}, None
            for batch in batches:
                like = batch.schema
                for digest, variant, n, key, row in zip(*(batch.column(c).to_pylist() for c in ("digest", "variant", "n", "id", "row"))):
                    rank = (-n, key is None, key, row)
                    if (cell := table.get((digest, variant))) is None:
                        table[digest, variant] = [rank, 1]
                        if len(table) == size:
                            yield flushed(table, like)
                            table = {}
                    else:
                        cell[1] += 1
                        # ranks differ at the row number at the latest; null ids are never compared
                        if rank[:2] < cell[0][:2] or rank[:2] == cell[0][:2] and (rank[3] < cell[0][3] if key is None or key == cell[0][2] else key < cell[0][2]):
                            cell[0] = rank
            if table:
                yield flushed(table, like)

        self.flushes += 1
        path = f"{self.path}/run{self.flushes:05d}"
        rows = log.select("digest", "variant", "n", "id", "row").mapInArrow(run, schema)
        self._write(rows, path, maxRecordsPerFile=size)
        self.runs.append(path)

    def _write(self, rows: DataFrame, path: str, **options) -> None:
        rows.write.options(**{"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": str(self.memtable)}, **options).parquet(path)

    def compact(self) -> DataFrame:
        """Merge all runs and the level into a new level: one row a digest (and variant), with its first-ranking document."""
        parts = [*self.runs, *([self.level] if self.level else [])]
        best = F.min(F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("none"), "id", "row"))
        merged = self.spark.read.parquet(*parts).groupBy("digest", "variant").agg(best.alias("best"), F.sum("copies").alias("copies"))
        level = shared.shared_path(self.spark, "digest-level")
        flat = merged.select("digest", "variant", (-F.col("best.n")).alias("n"), F.col("best.id").alias("id"), F.col("best.row").alias("row"), "copies")
        self._write(flat.sortWithinPartitions("digest"), level)
        self.runs, self.level = [], level
        return self.spark.read.parquet(level)

    def find(self, digests: list[str]) -> DataFrame:
        """The entries of a few digests in the runs and the level, the first-ranking one a run; files whose filters rule them out are skipped.

        Ten digests at a time, as more would be pushed into the files as a mere range.
        """
        parts = [*self.runs, *([self.level] if self.level else [])]
        rows = self.spark.read.parquet(*parts)
        some = [rows.where(F.col("digest").isin(digests[k : k + 10])) for k in range(0, len(digests), 10)] or [rows.limit(0)]
        return reduce(DataFrame.unionByName, some)


def _hit_filter(level: DataFrame, bits: int | None) -> tuple[np.ndarray, int]:
    """A Bloom filter of the digests with several documents, and its bits (from their count where None): built by partial aggregation, at most bits / 64 rows reach the driver.

    Of more hits than it is large for, it lets through more that are none: they are shuffled and compared too, and no result changes.
    """
    if bits is None:
        bits = min(FILTER_MOST, max(FILTER_LEAST, 1 << (16 * level.where("copies > 1").count()).bit_length()))
    places = F.explode(F.array(*(F.pmod(F.xxhash64("digest", F.lit(k)), F.lit(bits)) for k in range(_PROBES)))).alias("place")
    words = level.where("copies > 1").select(places).select(F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toPandas()
    filled = np.zeros(bits // 64, np.int64)
    filled[found["word"].to_numpy(np.int64)] = found["bit"].to_numpy(np.int64)
    return filled.view(np.uint64), bits


def _in_filter(filled: np.ndarray, bits: int):
    """The column that tells if a digest may have several documents."""

    @F.pandas_udf("boolean")
    def may(*places: pd.Series) -> pd.Series:
        found = np.ones(len(places[0]), bool)
        for p in places:
            at = p.to_numpy(np.int64)
            found &= (filled[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return pd.Series(found)

    return may(*(F.pmod(F.xxhash64("digest", F.lit(k)), F.lit(bits)) for k in range(_PROBES)))


def _indexed(docs: DataFrame, id_col: str, text_col: str, digest_chars: int, memtable: int, filter_bits: int | None):
    """(log, level, hits, filter): the logged rows, the compacted index with verified variants, and what finds its hits."""
    spark = docs.sparkSession
    text = shared.text_of(text_col)
    sha = F.sha2(F.encode(normalised(text), "UTF-8"), 256)
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.char_length(text).cast("long").alias("n"), sha.alias("sha"))
    log = shared.stored(rows, "digest-log").withColumn("digest", F.substring("sha", 1, digest_chars)).withColumn("variant", F.lit(0).cast("long"))
    index = DigestIndex(spark, shared.shared_path(spark, "digest-runs"), memtable)
    index.append(log)
    level = index.compact()
    filled, filter_bits = _hit_filter(level, filter_bits)

    # byte verification: the distinct normalised texts of each hit; copies meet in the map-side aggregation
    plain = docs.select(normalised(text).alias("plain"))
    hits = plain.withColumn("digest", F.substring(F.sha2(F.encode("plain", "UTF-8"), 256), 1, digest_chars)).where(_in_filter(filled, filter_bits))
    texts = hits.groupBy("digest", "plain").agg(F.count("*").alias("copies"))
    mixed = shared.stored(texts.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1"), "digest-mixed")
    variants = None
    if not mixed.isEmpty():  # different texts under one digest: each becomes a variant of it
        sha_of = texts.join(mixed, "digest").select("digest", F.sha2(F.encode("plain", "UTF-8"), 256).alias("sha"), F.md5(F.encode("plain", "UTF-8")).alias("md5")).distinct()
        variants = shared.stored(sha_of.select("digest", "sha", F.xxhash64("sha", "md5").alias("variant")), "digest-variants")
        log = log.drop("variant").join(variants, ["digest", "sha"], "left").withColumn("variant", F.coalesce("variant", F.lit(0).cast("long")))
        index = DigestIndex(spark, shared.shared_path(spark, "digest-runs"), memtable)
        index.append(log)
        level = index.compact()
    return log, level, variants, (filled, filter_bits)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_chars: int = 64, memtable: int = MEMTABLE, filter_bits: int | None = None) -> DataFrame:
    """One row per document, dropped ones too: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when the same after deleting space and the controls 9-13; a null text is empty. Of equal
    texts the longest original stays, then the smallest id (nulls last), then the first of repeated
    rows: exactly one row a group is kept. An empty table gives an empty result; other columns are not read.

    ``digest_chars``: hexadecimal digits of SHA-256 that the index goes by; with fewer, texts meet more
    often and byte verification tells them apart.
    """
    log, level, _, _ = _indexed(docs, id_col, text_col, digest_chars, memtable, filter_bits)
    best = level.select("digest", "variant", F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("copies").alias("group_size"))
    return log.join(best, ["digest", "variant"]).select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bits: int | None = None) -> DataFrame:
    """``docs`` with one row of each group of equal texts, chosen as in :func:`exact_dedup`, all columns as they were.

    Rows outside the filter of hits stay where they are. Of the others each task first keeps the row that ranks first of
    each digest, so a group of copies moves no more rows than there are tasks; the index then says which of these stays.
    Rows repeated with one id and text, null ids, null and empty texts and columns of any name may be there; an empty
    table gives an empty result.
    """
    _, level, _, (filled, bits) = _indexed(docs, id_col, text_col, 64, MEMTABLE, filter_bits)
    text = shared.text_of(text_col)
    held = docs.select(F.struct("*").alias("held"), F.col(id_col).alias("id"), F.char_length(text).cast("long").alias("n"), F.xxhash64(text).alias("h"), F.sha2(F.encode(normalised(text), "UTF-8"), 256).alias("digest"))
    held = held.withColumn("may", _in_filter(filled, bits))
    alone, hits = held.where("not may"), held.where("may")
    first = F.min(F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("none"), "id", "h"))
    firsts = hits.groupBy("digest").agg(first.alias("first"), F.min_by("held", F.struct(-F.col("n"), F.col("id").isNull(), "id", "h")).alias("held"))
    best = level.where("copies > 1").select("digest", F.col("id").alias("keep_id"), F.col("n").alias("keep_n"))
    joined = firsts.join(best, "digest", "left")
    once = joined.where(F.col("keep_n").isNull() | ((-F.col("first.n") == F.col("keep_n")) & F.col("first.id").eqNullSafe(F.col("keep_id"))))
    return alone.select("held.*").unionByName(once.select("held.*"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(shared.documents(spark, sf_dir))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain FROM documents
), r AS (
  SELECT doc_id, plain,
         first_value(doc_id) OVER w AS keep_id,
         count(*) OVER (PARTITION BY plain) AS group_size,
         row_number() OVER w AS place
  FROM d WINDOW w AS (PARTITION BY plain ORDER BY length(t) DESC, doc_id ASC NULLS LAST)
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, place = 1 AS kept, sha256(plain) AS text_sha256 FROM r
"""
