import random
import re
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pytest

from tracelake.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, words string, key int"


def brute(rows, least, longest=4, first=None):
    f, n = {}, Counter()
    for text, lang in rows:
        lang, counts = lang if lang is not None else "und", f.setdefault(lang if lang is not None else "und", Counter())
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                counts.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            score, _, l, r = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows.append((score, a, " ".join(p), l, r))
        rows.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i, p, a, l, r, n[lang], s) for i, (s, a, p, l, r) in enumerate(rows[:first], 1)]
    return sorted(out)


def texts(seed, n=200, vocabulary="A b c d é 中 x\x1fy a|b".split()):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        words = [rng.choice(vocabulary) if rng.random() < 0.7 else "the common phrase here" for _ in range(rng.randrange(20))]
        out.append(("".join(w + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", "\r"]) for w in words), rng.choice(["en", "en", "en", "fr", None, "und"])))
    return out


def got(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.mark.parametrize(("seed", "least", "longest", "first", "block"), [(1, 5, 4, None, 400), (2, 3, 4, 7, 10**9), (3, 2, 3, None, 1), (4, 4, 2, 5, 1000), (5, 30, 4, None, 3000)])
def test_like_brute_force(spark, seed, least, longest, first, block):
    rows = texts(seed) + [(None, "en"), ("", "en"), ("  \t,.", "de"), ("word " * 20_000, "es"), ("lone", "it"), ("x\xffy x\xffy", "is")] + texts(seed)[:50]
    docs = spark.createDataFrame([(None if k % 7 == 0 else k % 11, t, g, "clash", 1) for k, (t, g) in enumerate(rows)], SCHEMA).repartition(5)
    assert got(C.collocations(docs, least, longest, first, block_bytes=block)) == brute(rows, least, longest, first)


def test_without_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.collocations(empty).count() == 0
    assert C.collocations(spark.createDataFrame([(1, "a b c", "en", "", 1)], SCHEMA)).count() == 0


def test_hot_phrase_and_exact_arithmetic(spark):
    rows = [("same words again and again", "en")] * 3000
    docs = spark.createDataFrame([(k, t, g, "", 1) for k, (t, g) in enumerate(rows)], SCHEMA).repartition(16)
    assert got(C.collocations(docs, block_bytes=500)) == brute(rows, 30)
    grams = spark.createDataFrame([(bytes([0, 0, 0, 1]), 1, 2**62), (bytes([0, 0, 0, 2]), 1, 2**62 - 1), (bytes([0, 0, 0, 1, 0, 0, 0, 2]), 2, 2**61 + 12345)], "key binary, words int, f long")
    assert C._scored(grams).first().score == 2000000 * (2**61 + 12345) // (2**63 - 1)


def test_sql(spark, tmp_path):
    path = tmp_path / "documents.parquet"
    spark.createDataFrame([(k, t, g, "", 1) for k, (t, g) in enumerate(texts(9, 900))], SCHEMA).coalesce(1).write.parquet(str(path))
    base = duckdb.connect()
    base.execute(f"create view documents as select * from '{path}/*.parquet'")
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    frame = base.sql(C.OP11_SQL).df()[names]
    assert sorted(map(tuple, frame.to_numpy().tolist())) == brute(texts(9, 900), 30, 4, 2000) == got(C.op11_collocations(spark, str(tmp_path)))


@pytest.mark.parametrize("n", [2, 3])
def test_places_of_frequent_ngrams_in_bounded_memory(n):
    codes = np.random.default_rng(n).integers(0, 400, 1_500_000).astype("<u4")
    wanted = {tuple(codes[k : k + n].tolist()) for k in range(0, 60_000, 20)}
    wanted = {w for w in wanted if 0 not in w}
    held = np.array(sorted(wanted), C.ID).reshape(-1, n)
    keys = np.frombuffer(held.tobytes(), f"S{4 * n}")
    tracemalloc.start()
    starts = C._frequent_places(codes, n, keys)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 45 * len(codes)
    rows = codes.tolist()
    assert starts.tolist() == [tuple(rows[k : k + n]) in wanted for k in range(len(rows))]
