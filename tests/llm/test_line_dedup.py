import random

import pytest
from pyspark.sql import functions as F

from tracelake.llm.line_dedup import BLANKS, drop_lines, line_links, wider_links, within_edits, without_ends

SCHEMA = "doc_id long, text string, line string, line_id long"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def edited(rng, line, edits):
    for _ in range(edits):
        k, kind = rng.randrange(len(line) or 1), rng.randrange(3)
        line = line[:k] + (rng.choice("abé𝄞") if kind else "") + line[k + (kind < 2) :]
    return line


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_within_edits(spark, edits):
    rng = random.Random(edits)
    pairs = []
    for _ in range(600):
        a = "".join(rng.choice("abé𝄞") for _ in range(rng.randint(edits + 1, 14)))
        b = edited(rng, a, rng.randint(0, edits + 2)) if rng.random() < 0.8 or len(a) < edits + 4 else "".join(rng.choice("abé𝄞") for _ in a)
        a, b = sorted((a, b), key=len, reverse=True)
        pairs.append((a, b)) if len(a) > edits and b else None
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", within_edits(F.col("a"), F.col("b"), edits).alias("near")).collect()
    df = spark.createDataFrame(pairs, "a string, b string").select("*", F.col("a").alias("c"), F.col("b").alias("d"))
    cut = without_ends(df, "c", "d").select("*", within_edits(F.col("c"), F.col("d"), edits).alias("near")).collect()
    assert {(r.a, r.b): r.near for r in cut} == {(r.a, r.b): r.near for r in got} and all(r.c[:1] != r.d[:1] or not r.c for r in cut)
    assert {(r.a, r.b): r.near for r in got} == {(a, b): distance(a, b) <= edits for a, b in pairs}


def classes(links, ids):
    root = {i: i for i in ids}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def texts(rng):
    base = ["".join(rng.choice("abcé") for _ in range(n)) for n in (10, 11, 13, 24, 60)]
    lines = {edited(rng, b, rng.randint(0, 3)) for b in base for _ in range(25)}
    # many that differ at one place, or by one more at the end
    lines |= {f"page number {c} of the book" for c in "0123456789xyz"} | {f"page number {c}1 of the book" for c in "0123456789xyz"} | {"tail of a line" + c for c in ["", *"0123456789"]}
    return sorted(lines)


@pytest.mark.parametrize("paired", [32, 2])
def test_links_make_the_same_classes(spark, paired):
    lines = texts(random.Random(7))
    ids = range(len(lines))
    expected = classes([(i, j) for i in ids for j in ids if i < j and min(len(lines[i]), len(lines[j])) >= 10 and distance(lines[i], lines[j]) <= 1], ids)
    df = spark.createDataFrame(list(enumerate(lines)), "line_id long, line string").withColumn("chars", F.char_length("line"))
    links = [(r.x, r.y) for r in line_links(df, paired=paired).collect()]
    assert all(distance(lines[x], lines[y]) == 1 for x, y in links)
    assert classes(links, ids) == expected


def brute(docs):
    first, places = {}, []
    for key, text in docs:
        for pos, line in enumerate((text or "").split("\n")):
            if line.strip(BLANKS):
                places.append((line.strip(BLANKS), (key is None, key or 0, pos)))
    for line, place in places:
        first[line] = min(first.get(line, place), place)
    lines = sorted(first)
    ids = range(len(lines))
    root = classes([(i, j) for i in ids for j in ids if i < j and min(len(lines[i]), len(lines[j])) >= 10 and distance(lines[i], lines[j]) <= 1], ids)
    least = {}
    for i in ids:
        least[root[i]] = min(least.get(root[i], first[lines[i]]), first[lines[i]])
    best = {lines[i]: least[root[i]] for i in ids}
    out = []
    for key, text in docs:
        split = (text or "").split("\n")
        own = [(k, line.strip(BLANKS)) for k, line in enumerate(split) if line.strip(BLANKS)]
        going = {k: best[line] != first[line] for k, line in own if best[line] != (key is None, key or 0, k)}
        out.append((key, "\n".join(x for k, x in enumerate(split) if k not in going), len(own), len(going), sum(going.values())))
    return out


@pytest.mark.parametrize("paired", [32, 3])
def test_documents_against_brute_force(spark, paired):
    rng = random.Random(3)
    lines = texts(rng) + ["", " ", "ab", "ac", "ab", "\tab\r", "a\x0b"]
    docs = [(k, "\n".join(rng.choices(lines, k=rng.randint(1, 12)))) for k in range(40)]
    docs += [(100, None), (101, ""), (102, "\n\n"), (None, "only here, without id\npage number 0 of the book"), (104, "long line " * 200), (105, "long line " * 200 + "x"), (200, "twice the same\nrow\nrow")]
    df = spark.createDataFrame([(a, b, "clash", 1) for a, b in docs], SCHEMA)
    got = drop_lines(df, paired=paired)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute(docs)))


def test_repeated_rows_and_empty(spark):
    row = (5, "the same row here\nthe same row here\nx", "c", 1)
    got = drop_lines(spark.createDataFrame([row, row], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(5, "the same row here\nx", 3, 1, 0)] * 2
    assert drop_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_longer_lines_at_more_edits(spark):
    rng, longer = random.Random(12), [(20, 2), (45, 3), (90, 4)]
    base = ["".join(rng.choice("abcdefé𝄞") for _ in range(n)) for n in (12, 19, 21, 30, 44, 46, 88, 91, 200)]
    lines = sorted({edited(rng, b, rng.randint(0, 5)) for b in base for _ in range(14)})
    allowed = lambda a, b: max([1] + [k for n, k in longer if min(len(a), len(b)) >= n])
    ids = range(len(lines))
    near = {(i, j) for i in ids for j in ids if i < j and distance(lines[i], lines[j]) <= allowed(lines[i], lines[j])}
    df = spark.createDataFrame(list(enumerate(lines)), "line_id long, line string").withColumn("chars", F.char_length("line"))
    found = {tuple(sorted((r.x, r.y))) for r in wider_links(df, longer).collect()}
    assert found == {(i, j) for i, j in near if min(len(lines[i]), len(lines[j])) >= 20}
    docs = spark.createDataFrame([(k, line, "", 0) for k, line in enumerate(lines)], SCHEMA)
    assert sum(r.n_dropped for r in drop_lines(docs, longer=longer).collect()) == len(lines) - len(set(classes(near, ids).values()))
