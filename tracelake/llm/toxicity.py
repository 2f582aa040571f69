"""Operator 8: toxicity by subword-bag embeddings averaged into a linear softmax, trained in numpy.

A word is the bag of its character n-grams, hashed into buckets, and its vector the average of their embeddings. A two-class softmax takes two
averages of a document's words: over the whole bag, and over the worst two neighbours, so that one insult in a long document is not averaged
away. Embeddings and softmax are trained together.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from itertools import chain
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tracelake.llm import shared

#: Training documents of each class at most, their characters altogether, and those of one: the bounds of the sample that is fitted in one task.
SAMPLE, SAMPLE_CHARS, SAMPLE_LONGEST = 1_500, 6_000_000, 400_000
BUCKETS, DIMENSIONS, NGRAMS = 1 << 16, 8, (3, 4, 5)
_STRIP = ".,;:!?\"'()[]{}<>|*#$%&-_/\\"
#: Longer runs without white space are cut at inner marks; what is still longer, into pieces of PIECE characters, one every STRIDE.
LONGEST, PIECE, STRIDE = 63, 12, 4
_MARKS = re.compile("[" + re.escape(_STRIP) + "、。，．：；！？「」『』（）【】《》〈〉・…]+")


def words_of(text: str) -> list[str]:
    """Lowered words between white space. Of a run over LONGEST characters every letter is in some word, whatever its length."""
    words = text.lower().split()
    return words if not words or max(map(len, words)) <= LONGEST else list(chain.from_iterable([w] if len(w) <= LONGEST else _pieces(w) for w in words))


def _pieces(run: str) -> Iterator[str]:
    for part in [x for x in _MARKS.split(run) if x] or [run]:
        if len(part) <= LONGEST:
            yield part
        else:
            yield from (part[k : k + PIECE] for k in range(0, len(part) - PIECE + STRIDE, STRIDE))


def bags(words: list[str], at_once: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """:func:`_bags` of many words, ``at_once`` at a time, as the arrays in between are many times as large."""
    parts = [_bags(words[k : k + at_once]) for k in range(0, len(words), at_once)] or [_bags([])]
    return np.concatenate([b for b, _ in parts]), np.concatenate([n + np.int32(k * at_once) for k, (_, n) in enumerate(parts)])


def _bags(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word number) of every n-gram of each word within < and >, and of each whole word; marks at a word's ends are left out."""
    marked = [f"<{w.strip(_STRIP) or w}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    number, ends = np.repeat(np.arange(len(marked)), sizes), np.repeat(np.cumsum(sizes), sizes)
    place, rolled = np.arange(len(codes)), codes * np.uint64(0x9E3779B1)
    buckets, numbers = [np.fromiter((zlib.crc32(w.encode("utf-8")) for w in marked), np.uint64, len(marked))], [np.arange(len(marked))]
    for n in range(2, max(NGRAMS) + 1):
        rolled = (rolled[:-1] if n > 2 else rolled)[: max(0, len(codes) - n + 1)] * np.uint64(0x100000001B3) + codes[n - 1 :]
        if n in NGRAMS:
            whole = place[: len(rolled)] + n <= ends[: len(rolled)]
            hashed = rolled[whole]
            hashed = (hashed ^ (hashed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            buckets.append(hashed >> np.uint64(40))
            numbers.append(number[: len(rolled)][whole])
    return (np.concatenate(buckets) % np.uint64(BUCKETS)).astype(np.int32), np.concatenate(numbers).astype(np.int32)


@dataclass
class Model:
    """What each bucket adds to the toxic class over the other, the product of embeddings and softmax weights: by the worst window
    (``gain``) and by the whole document (``share``); ``bias``."""

    gain: np.ndarray
    share: np.ndarray
    bias: float

    def of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each word's averages of both."""
        bucket, number = bags(words)
        sizes = np.bincount(number, minlength=len(words))
        return tuple(np.bincount(number, part[bucket], len(words)) / sizes for part in (self.gain, self.share))

    def scorer(self, memo_size: int = 200_000):
        """A function from a list of texts to their scores; words' gains are remembered, ``memo_size`` and one list's words at most."""
        memo: dict[str, tuple[float, float]] = {}

        def scores(texts: list[str]) -> list[float]:
            split = [words_of(t) for t in texts]
            new = list(set(chain.from_iterable(split)).difference(memo))
            if new:
                if len(memo) > memo_size:
                    memo.clear()
                    new = list(set(chain.from_iterable(split)))
                memo.update(zip(new, zip(*(part.tolist() for part in self.of_words(new)))))
            out = []
            for words in split:
                logit = self.bias
                if words:
                    gains, shares = np.array([*map(memo.__getitem__, words)]).T
                    logit += shares.mean() + (((gains[:-1] + gains[1:]) / 2).max() if len(words) > 1 else gains[0])
                out.append(float(1 / (1 + np.exp(-np.clip(logit, -60, 60)))))
            return out

        return scores


def fit(texts: list[str], toxic: list[int], rounds: int = 120, rate: float = 100.0, momentum: float = 0.9, seed: int = 7) -> Model:
    """Full-batch gradient descent with momentum on the documents' cross entropy; deterministic for a given sample.

    A document's logit is the average over its words, and an average of its windows' logits weighted by their softmax, which sharpens in the
    later rounds until the worst window decides. Plain steps, not scaled by coordinate: n-grams that few
    documents hold stay small. Both classes weigh the same. Without a document of each class nothing can be
    learnt: the model then scores the class there is (0.5 without any).
    """
    y = np.array(toxic, np.float64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0 if not len(y) else (8.0 if y[0] else -8.0))
    # words as numbers, windows as two neighbours (a lone word twice), documents as runs of windows
    number: dict[str, int] = {}
    firsts, seconds, runs = [], [], []
    for text in texts:
        words = words_of(text) or [""]
        run = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words))
        runs.append(run)
        firsts.append(run[:-1] if len(run) > 1 else run)
        seconds.append(run[-len(firsts[-1]) :])
    window_counts = np.array([len(run) for run in firsts])
    first, second, doc_starts = np.concatenate(firsts), np.concatenate(seconds), np.cumsum(window_counts) - window_counts
    sizes, every = np.array([len(run) for run in runs]), np.concatenate(runs)
    doc_of_word, word_starts = np.repeat(np.arange(len(y), dtype=np.int32), sizes), np.cumsum(sizes) - sizes
    doc_of_window = np.repeat(np.arange(len(y), dtype=np.int32), window_counts)
    flat, word_of_gram = bags(list(number))
    gram_sizes = np.bincount(word_of_gram, minlength=len(number))

    random = np.random.default_rng(seed)
    embed, softmax, bias = random.normal(0, 0.1, (BUCKETS, DIMENSIONS)), random.normal(0, 0.5, (2, DIMENSIONS, 2)), 0.0  # of windows, of documents
    speed_embed, speed_softmax, speed_bias = np.zeros_like(embed), np.zeros_like(softmax), 0.0
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    for step in range(rounds):
        directions = softmax[:, :, 1] - softmax[:, :, 0]
        of_word, in_bag = (np.bincount(word_of_gram, (embed @ d)[flat], len(number)) / gram_sizes for d in directions)
        of_window = (of_word[first] + of_word[second]) / 2
        top = np.maximum.reduceat(of_window, doc_starts)
        sharpness = 1 + 9 * max(0.0, step / rounds - 0.6) / 0.4
        attention = np.exp(sharpness * (of_window - top[doc_of_window]))
        attention /= np.add.reduceat(attention, doc_starts)[doc_of_window]
        logit = np.add.reduceat(attention * of_window, doc_starts) + np.add.reduceat(in_bag[every], word_starts) / sizes + bias
        slope = (1 / (1 + np.exp(-np.clip(logit, -60, 60))) - y) * weight
        half = slope[doc_of_window] * attention / 2
        by_words = np.bincount(first, half, len(number)) + np.bincount(second, half, len(number)), np.bincount(every, (slope / sizes)[doc_of_word], len(number))
        by_buckets = np.stack([np.bincount(flat, (by_word / gram_sizes)[word_of_gram], BUCKETS) for by_word in by_words], 1)
        toward = by_buckets.T @ embed
        speed_embed = momentum * speed_embed + by_buckets @ directions
        speed_softmax = momentum * speed_softmax + np.stack([-toward, toward], 2)
        speed_bias = momentum * speed_bias + slope.sum()
        embed -= rate * speed_embed
        softmax -= rate / 500 * speed_softmax
        bias -= rate / 500 * speed_bias
    directions = softmax[:, :, 1] - softmax[:, :, 0]
    return Model(embed @ directions[0], embed @ directions[1], float(bias))


def _held_out(id_col: str):
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5) == 0


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", chars: int = SAMPLE_CHARS, longest: int = SAMPLE_LONGEST) -> DataFrame:
    """(doc_id, toxic, text) of at most ``sample`` labelled documents of each class: those of the smallest hash of their id, never held-out ones.

    Of those, documents over ``longest`` characters are passed over, and the rest is taken in that order up to ``chars``
    characters a class. Labels that are null or whose document is not there are passed over; a repeated id counts as
    toxic if any of its labels does, and is one training document, the text of the smallest hash.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~_held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    there = known.join(docs.select(F.col(id_col).alias("doc_id")), "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = there.where("toxic = 1").orderBy(*order).limit(sample).unionByName(there.where("toxic = 0").orderBy(*order).limit(sample))
    rows = docs.select(F.col(id_col).alias("doc_id"), shared.text_of(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
    best = rows.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("best"))
    best = best.select("doc_id", "toxic", "best.text").withColumn("n", F.char_length("text")).where(F.col("n") <= longest)
    so_far = F.sum("n").over(Window.partitionBy("toxic").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))  # at most ``sample`` rows a class
    return best.withColumn("so_far", so_far).where(F.col("so_far") <= chars).select("doc_id", "toxic", "text")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", **bounds: int) -> Model:
    """Fit on :func:`training_rows` in one task on an executor, whose memory their bounds limit; the driver gets the model alone.

    Without any labelled document every score is 0.5.
    """

    def run(batches):
        found = sorted((key, text, toxic) for batch in batches for key, text, toxic in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "toxic"))))
        model = fit([text for _, text, _ in found], [toxic for *_, toxic in found])
        yield pa.RecordBatch.from_arrays([pa.array([model.gain.tobytes()], pa.binary()), pa.array([model.share.tobytes()], pa.binary()), pa.array([model.bias], pa.float64())], ["gain", "share", "bias"])

    rows = training_rows(docs, labels, sample, id_col, text_col, **bounds)
    fitted = rows.repartition(1).mapInArrow(run, "gain binary, share binary, bias double").collect()  # one row of 2 x BUCKETS numbers
    return Model(np.frombuffer(fitted[0]["gain"]), np.frombuffer(fitted[0]["share"]), fitted[0]["bias"]) if fitted else fit([], [])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score (0 to 1), predicted (1 from 0.5 on).

    Null and empty texts score by the bias alone. A null id is held out as the empty text would be; repeated
    rows each give a row; an empty table gives an empty result; only text enters a score.
    """

    def run(batches):
        of = model.scorer()
        for batch in shared.slices(batches):
            scores = of(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], [id_col, "score"])

    rows = docs.select(id_col, shared.text_of(text_col).alias(text_col))
    scored = rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, score double")
    return scored.select(id_col, _held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the rows predicted toxic, all columns as they were, whatever their names.

    Each row is decided by its own text: rows with a null or repeated id as any other, null and empty texts by the
    bias alone. An empty table gives an empty result.
    """
    model = train(docs, labels, sample, id_col, text_col)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:  # an iterator, so that the memo lasts
        of = model.scorer()
        for texts in batches:  # a few texts' words at a time
            yield pd.Series([x for k in range(0, len(texts), 256) for x in of(texts.iloc[k : k + 256].tolist())], dtype="float64")

    return docs.where(scored(shared.text_of(text_col)) < 0.5)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir)
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
