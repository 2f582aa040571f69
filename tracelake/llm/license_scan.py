"""Operator 10: license scans by ordered signature rules behind a keyword prefilter."""

from __future__ import annotations

import bisect
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tracelake.llm import shared
from tracelake.llm.license_rules import Rule, compiled

#: Phrases whose places are counted word by word, with the label each gives.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_LOWER = {b: b + 32 for b in range(65, 91)}


class Scanner:
    def __init__(self, rules: list[Rule]):
        self.rules = rules
        self.by_keyword: dict[str, list[int]] = {}
        for k, rule in enumerate(rules):
            self.by_keyword.setdefault(rule.keyword, []).append(k)
        self.keywords = ahocorasick.Automaton()
        self.words_of = {keyword: set(keyword.split()) for keyword in self.by_keyword}
        for word in set().union(*self.words_of.values()):
            self.keywords.add_word(word, word)
        self.keywords.make_automaton()

    def detections(self, text: str) -> list[tuple[int, int, str, int]]:
        """(start, end, label, priority), A-Z lowered text given. Rules run in order; a match within a kept one is suppressed."""
        words = {word for _, word in self.keywords.iter(text)}
        found = [keyword for keyword, needed in self.words_of.items() if needed <= words]
        matches = []
        for k in sorted(k for keyword in found for k in self.by_keyword[keyword]):
            rule = self.rules[k]
            matches += [(-rule.priority, m.start() - m.end(), m.start(), m.end(), rule.label) for m in rule.pattern.finditer(text)]
        kept: list[tuple[int, int, str, int]] = []
        starts: list[int] = []  # of kept ones that lie in no other, so their ends ascend with them
        ends: list[int] = []
        for priority, _, start, end, label in sorted(matches):
            at = bisect.bisect_right(starts, start) - 1
            if at >= 0 and ends[at] >= end:
                continue
            kept.append((start, end, label, -priority))
            first = bisect.bisect_left(starts, start)
            last = bisect.bisect_right(ends, end)
            starts[first:last], ends[first:last] = [start], [end]
        return sorted(kept)


def phrase_places(text: str) -> tuple[int, list[tuple[int, str]]]:
    """(words, places): the number of words and, for each place of a phrase, its first word's number and its label."""
    words = text.encode("utf-8").translate(_WORDS).split()
    joined = b" " + b" ".join(words) + b" "
    places = []
    for phrase, label in PHRASES.items():
        phrase, at, counted, number = b" " + phrase.encode() + b" ", 0, 0, 0
        while (at := joined.find(phrase, at)) >= 0:
            number += joined.count(b" ", counted, at)
            counted = at
            places.append((number, label))
            at += 1
    return len(words), sorted(places)


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner(compiled())


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    ``base_labels`` come from the phrases, ``labels`` are those and the labels of all kept detections;
    ``score`` is the highest priority among detections over 100 (at least 0.7 with a base label, 0 without
    any); ``detections`` is an array of (start, end, label, score) in characters. A null or empty text has
    no words, empty labels, null first and last word, and score 0. Repeated rows each give a row, an id may
    be null, an empty table gives an empty result, other columns are not read. Row-local: no shuffle.
    """
    detection = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("score", pa.float64())])

    def run(batches):
        scan = scanner()
        for batch in shared.slices(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                n_words, places = phrase_places(text)
                found = scan.detections(text.translate(_LOWER) if not text.isascii() else text.lower())
                base = {label for _, label in places}
                score = max([p / 100 for *_, p in found] + [0.7] * bool(base), default=0.0)
                rows.append((n_words, len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(base)), ",".join(sorted(base | {label for _, _, label, _ in found})), score, [{"start": s, "end": e, "label": label, "score": p / 100} for s, e, label, p in found]))
            columns = list(zip(*rows)) if rows else [[]] * 8
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(detection)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"])

    rows = docs.select(id_col, shared.text_of(text_col).alias(text_col))
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<start:long,end:long,label:string,score:double>>")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(shared.documents(spark, sf_dir)).drop("detections")
