import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tracelake.llm.exact_dedup import DigestIndex, drop_copies, exact_dedup

SCHEMA = "doc_id long, text string, digest string, row long"


def docs(spark):
    rows = [(5, "a b", "x", 1), (3, "ab", "x", 1), (9, "a  b", None, 1), (7, "a\tb ", None, 1), (1, None, "q", 2), (2, "", "q", 2), (None, " ", "q", 2), (None, "solo", None, None)]
    rows += [(100 + k, f"text {k % 7}" + " " * (k % 3), "y", k) for k in range(60)]
    rows += [(200, "same row", "z", 0)] * 3 + [(300, "é x", "", 0), (301, "é x", "", 0), (400, "long " * 30_000, "", 0)]
    return spark.createDataFrame(rows, SCHEMA)


def brute(rows):
    groups = {}
    for place, (key, text) in enumerate(rows):
        plain = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups.setdefault(plain, []).append((-len(text or ""), key is None, key if key is not None else 0, place))
    out = []
    for plain, found in groups.items():
        best = min(found)
        sha = hashlib.sha256(plain.encode()).hexdigest()
        keep = None if best[1] else best[2]
        out += [(None if f[1] else f[2], keep, len(found), f[:3] == best[:3], sha) for f in found]
    return out


@pytest.mark.parametrize("chars,memtable", [(64, 200_000), (1, 200_000), (64, 2), (1, 3)])
def test_against_brute_force(spark, chars, memtable):
    df = docs(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = exact_dedup(df, digest_chars=chars, memtable=memtable).collect()
    key = lambda r: tuple(map(str, r))
    expected = brute(rows)
    assert sorted([key((r[0], r[1], r[2], r[4])) for r in got]) == sorted([key((r[0], r[1], r[2], r[4])) for r in expected])
    # one row of each group is kept, and it is one of those that rank first
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r[4] for r in expected})
    assert {key((r[0], r[4])) for r in kept} <= {key((r[0], r[4])) for r in expected if r[3]}


def test_drop_copies_keeps_columns(spark):
    df = docs(spark)
    got = drop_copies(df)
    assert got.columns == df.columns
    texts = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in got.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in df.collect()})
    small = {r.doc_id for r in drop_copies(df, filter_bits=64).collect()}  # a full filter only costs a shuffle
    assert small == {r.doc_id for r in got.collect()}


def test_later_runs_are_merged(spark, tmp_path):
    index = DigestIndex(spark, str(tmp_path / "runs"), 2)
    log = lambda rows: spark.createDataFrame(rows, "digest string, variant long, n long, id long, row long")
    index.append(log([("a", 0, 3, 10, 0), ("b", 0, 1, 11, 1), ("c", 0, 1, 12, 2)]))
    index.compact()
    index.append(log([("a", 0, 3, 2, 5), ("b", 0, 9, 99, 6)]))
    assert sorted((r.digest, r.id) for r in index.find(["a", "c", *"defghijklmnop"]).collect()) == [("a", 2), ("a", 10), ("c", 12)] and index.find([]).count() == 0
    got = {r.digest: (r.id, r.n, r.copies) for r in index.compact().collect()}
    assert got == {"a": (2, 3, 2), "b": (99, 9, 2), "c": (12, 1, 1)}


def test_the_row_that_stays_is_the_one_of_the_index(spark):
    rows = [(k % 90, "same  text" if k % 3 else "same text", "x", k) for k in range(300)] + [(None, "same  text", "y", 0), (500, "other", "z", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert sorted((r.doc_id, r.text) for r in drop_copies(df).collect()) == [(1, "same  text"), (500, "other")]
    assert {r.doc_id for r in exact_dedup(df).where("kept").collect()} == {1, 500}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert exact_dedup(df).count() == 0 and drop_copies(df).count() == 0
    assert exact_dedup(spark.createDataFrame([(None, None, None, None)], SCHEMA)).drop("text_sha256").collect() == [(None, None, 1, True)]
    assert exact_dedup(df.select(F.col("doc_id").cast("string"), "text")).count() == 0
