"""Operator 6: quality rules, native: word and line rules, and a hashed n-gram log-likelihood ratio.

Every word and every pair of neighbouring words falls into a hash bucket. Bucket counts over all documents
are the raw multinomial, those over trusted documents the target; a document's score is the mean over its
n-grams of ln(target / raw), summed over n. Documents under a fixed threshold are rejected. Only DataFrame
functions are used; the bucket weights enter the plan as a constant array of fixed size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import shared

#: Buckets for each n, and the lowest score kept.
BUCKETS, THRESHOLD = 1 << 16, -0.5
WINDOW = 8


def _replaced(text: Column, marks: str, by: str) -> Column:
    return reduce(lambda c, mark: F.replace(c, F.lit(mark), F.lit(by)), marks, text)


def _hashed(rows: DataFrame) -> DataFrame:
    """``rows`` (with text) and ``spaced`` (white space as blanks) and ``hashes`` (one for each word)."""
    rows = rows.withColumn("spaced", _replaced(F.col("text"), "\t\n\x0b\x0c\r", " "))
    words = F.array_remove(F.split("spaced", " "), "")
    return rows.withColumn("hashes", F.transform(words, lambda w: F.xxhash64(w)))


def _bucket(*hashes: Column) -> Column:
    return F.pmod(F.xxhash64(*hashes), F.lit(BUCKETS)).cast("int")


def _pairs(then) -> Column:
    """``then`` of the bucket of each pair of neighbouring words, as an array."""
    n = F.size("hashes")
    return F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), lambda i: then(_bucket(F.get("hashes", i), F.get("hashes", i + 1))))).otherwise(F.array().cast("array<double>" if then is not _same else "array<int>"))


def _same(bucket: Column) -> Column:
    return bucket


def weights(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict[int, Column]:
    """For n = 1 and 2, the log ratio of every bucket as a constant array<double>.

    Raw counts cover every document, target counts every trusted one, that is labelled with quality 1; add-one
    smoothing. Without any trusted document all ratios are 0.
    """
    best = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    rows = docs.select(F.col(id_col).alias("doc_id"), shared.text_of(text_col).alias("text"))
    # labels grow with the corpus: joined in one way at every size, never broadcast
    rows = _hashed(rows.join(best.withColumn("target", F.lit(1)).hint("merge"), "doc_id", "left"))
    target = F.coalesce("target", F.lit(0)).alias("target")
    both = F.concat(F.transform("hashes", lambda h: _bucket(h)), F.transform(_pairs(_same), lambda b: b + BUCKETS))
    # outer: for an inner explode the optimiser infers a filter on its size and works the array out again for it
    grams = rows.select(target, F.explode_outer(both).alias("gram")).where("gram is not null")
    counts = grams.groupBy("gram").agg(F.count("*").alias("raw"), F.sum("target").alias("good"))
    counts = counts.select((F.floor(F.col("gram") / BUCKETS) + 1).alias("n"), (F.col("gram") % BUCKETS).alias("bucket"), "raw", "good")
    counts = shared.stored(counts, "bucket-counts")
    out = {}
    for n in (1, 2):
        own = counts.where(F.col("n") == n)
        total = own.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("raws"), F.coalesce(F.sum("good"), F.lit(0)).alias("goods"))
        ratio = F.ln((F.col("good") + 1) / (F.col("goods") + BUCKETS)) - F.ln((F.col("raw") + 1) / (F.col("raws") + BUCKETS))
        every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(own, "bucket", "left").fillna(0, ["raw", "good"])
        raws, goods = total.select("raws").scalar(), total.select("goods").scalar()
        every = every.withColumn("raws", raws).withColumn("goods", goods)
        pairs = F.sort_array(F.collect_list(F.struct("bucket", F.when(F.col("goods") > 0, ratio).otherwise(0.0).alias("w"))))
        written = every.agg(F.array_join(F.transform(pairs, lambda p: p["w"].cast("string")), ",").alias("w")).first()["w"]  # BUCKETS numbers
        out[n] = F.split(F.lit(written), ",").cast("array<double>")  # folded to a constant when planned
    return out


def measures(rows: DataFrame, table: dict[int, Column], threshold: float = THRESHOLD) -> DataFrame:
    """``rows`` (with text, not null) and the columns of :func:`quality`."""
    text = F.col("text")
    rows = _hashed(rows)
    n = F.size("hashes")
    singly, doubly = table[1], table[2]
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    one = total(F.transform("hashes", lambda h: F.get(singly, _bucket(h)))) / n
    two = total(_pairs(lambda bucket: F.get(doubly, bucket))) / (n - 1)
    places = F.sequence(F.lit(0), n - WINDOW)
    windows = F.when(n >= WINDOW, F.transform(places, lambda i: F.xxhash64(*(F.get("hashes", i + k) for k in range(WINDOW))))).otherwise(F.array().cast("array<bigint>"))
    nonblank = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        "*",
        n.cast("long").alias("n_words"),
        F.char_length(F.replace("spaced", F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
        (F.octet_length(text) - F.octet_length(_replaced(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        nonblank.alias("lines"),
        windows.alias("windows"),
        F.when(n == 0, 0.0).otherwise(one + F.when(n > 1, two).otherwise(0.0)).alias("score"),
    )
    # windows in order of hash, then place: those equal to a neighbour are repeated; few documents have any
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("placed", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed)).drop("windows", "hashes", "spaced")
    equal = lambda k: F.coalesce(F.get("placed", k)["h"] == F.get("placed", k + 1)["h"], F.lit(False))
    again = F.transform("placed", lambda p, k: F.when(equal(k) | F.when(k > 0, equal(k - 1)).otherwise(False), p["i"]))
    rows = rows.withColumn("starts", F.sort_array(F.array_compact(again))).drop("placed")
    covered = F.aggregate(F.transform("starts", lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", k + 1) - s, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    rows = rows.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold)).drop("starts", "lines")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score.

    A null text has no words: all counts are 0, it fails the base rules and is not kept. Ids may be null,
    repeated rows each give a row and count in the corpus, an empty table gives an empty result, further
    columns are not read. Repeats are found by 64-bit hashes of eight words within one document.
    """
    table = weights(docs, labels, id_col, text_col)
    rows = measures(docs.select(F.col(id_col).alias("id"), shared.text_of(text_col).alias("text")), table, threshold)
    found = F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
    # through a generator of one row, below which a later filter on these columns is not moved
    return rows.select(F.col("id").alias(id_col), F.inline_outer(F.array(found)))


def drop_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`quality` does not keep, all columns as they were, whatever their names.

    Each row is decided by its own text: a null or empty one fails the base rules; ids may be null or repeat; an empty table stays empty.
    """
    table = weights(docs, labels, id_col, text_col)
    rows = docs.select(F.struct("*").alias("held"), shared.text_of(text_col).alias("text"))
    # through a generator of one row: the optimiser would move a plain filter below the columns it is made of
    # and work each of them out again wherever it occurs
    decided = measures(rows, table, threshold).select("held", F.explode_outer(F.array("kept")).alias("stays"))
    return decided.where("stays").select("held.*")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(shared.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
