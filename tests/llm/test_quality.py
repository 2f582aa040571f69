import math
import random
import re
import struct
import time
from collections import Counter

import xxhash

from tracelake.llm.quality import BUCKETS, THRESHOLD, drop_low_quality, quality

SCHEMA = "doc_id long, text string, score string, windows string, held string"
LABELS = "doc_id long, quality int, toxic int"


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def word_hash(w):
    return signed(xxhash.xxh64_intdigest(w.encode(), 42))


def chain(*values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    return signed(seed) % BUCKETS


def grams(text):
    h = [word_hash(w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return [chain(x) for x in h], [chain(a, b) for a, b in zip(h, h[1:])]


def brute(rows, trusted):
    raw, good = (Counter(), Counter()), (Counter(), Counter())
    for key, text in rows:
        for k, found in enumerate(grams(text)):
            raw[k].update(found)
            if key in trusted:
                good[k].update(found)
    out = []
    for key, text in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        n = len(words)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = [tuple(words[i : i + 8]) for i in range(n - 7)]
        seen = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(8)}
        failed = n < 20 or 100 * len(covered) > 30 * n
        score = 0.0
        for k, found in enumerate(grams(text)):
            if found:
                T, R = good[k].total(), raw[k].total()
                score += sum(math.log((good[k][b] + 1) / (T + BUCKETS)) - math.log((raw[k][b] + 1) / (R + BUCKETS)) if T else 0.0 for b in found) / len(found)
        out.append((key, n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed, not failed and score >= THRESHOLD, round(score, 6)))
    return out


def test_against_brute_force(spark):
    random.seed(9)
    words = ["the", "of", "Été", "straße", "and", "foo|", "bar", "$x", "b.", "c,", "中文"] + ["w%d" % k for k in range(60)]
    rows = []
    for k in range(160):
        text = [random.choice(words) for _ in range(random.choice([0, 3, 19, 20, 21, 50, 120]))]
        if k % 3 == 0 and len(text) > 18:
            at = random.randrange(len(text) - 10)
            text[at:at] = text[at : at + random.randint(7, 10)] * random.randint(1, 3)
        if k % 5 == 0:
            text = [w + random.choice(["###", "&&&", "%%%"]) for w in text]
        rows.append((k, "".join(w + random.choice([" ", " ", "\n", "\t", "\r\n", "  ", "\x0b"]) for w in text), "s", "w", "h"))
    rows += [(900, None, None, None, None), (901, "", "", "", ""), (902, " \n\t", "", "", ""), (None, "no id " * 20, "", "", ""), (5, rows[5][1], "s", "w", "h"), (903, "word " * 25_000, "", "", ""), (904, "same line here\nsame line here\n\n\nsame line here\r\n" + " ".join(words), "", "", "")]
    labels = [(k, int(k % 5 != 0), 0) for k in range(160) if k % 2] + [(None, 1, 0), (3, None, 0), (77777, 1, 1), (1, 1, 0)]
    df, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)
    expected = brute([r[:2] for r in rows], {k for k, q, _ in labels if q == 1 and k is not None})
    got = quality(df, known)
    assert sorted(str((*r[:8], round(r.score, 6))) for r in got.collect()) == sorted(map(str, expected))
    left = drop_low_quality(df, known)
    assert left.columns == df.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(r[0]) for r in expected if r[7])
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_empty_and_unlabelled(spark):
    none = spark.createDataFrame([], LABELS)
    assert quality(spark.createDataFrame([], SCHEMA), none).count() == 0
    df = spark.createDataFrame([(1, " ".join("w%d" % k for k in range(30)), "", "", "")], SCHEMA)
    assert quality(df, none).select("kept", "score").first() == (True, 0.0)


def test_every_trusted_document_counts(spark):
    n = 20_200
    df = spark.range(n).selectExpr("id AS doc_id", "concat('w', id, ' v', id % 7) AS text")
    known = spark.range(n).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    # all documents are trusted, so target and raw counts are the same
    assert quality(df, known).where("score <> 0").count() == 0


def test_a_filter_on_the_result_works_nothing_out_again(spark):
    rows = [(1, " ".join("w%d" % k for k in range(30_000)), "x", 1), (2, "short", "x", 1)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    began = time.time()
    assert [r.doc_id for r in quality(docs, labels).where("kept and n_words > 20").collect()] == [1]
    assert time.time() - began < 120  # it grew with the square of the words
