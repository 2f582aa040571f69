import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracelake.llm import spelling as S

SCHEMA = "doc_id long, text string, word string, n long, id int"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows, min_chars=5, least=3, one_in=97):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % one_in == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= min_chars and n >= least}


def brute(words):
    close = {w: [x for x in words if near(w, x)] for w in words}
    forms = {}
    for w, n in words.items():
        best = min(close[w], key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, n, len(close[w]), forms[w], words.get(forms[w]), root))
    return sorted(out)


def got(df):
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect())


def texts(seed, n=150):
    rng = random.Random(seed)
    pool = ["abcde", "abcdf", "abcd", "aabcde", "Straße", "Strasse", "ÀÈÌÒÙ", "x" * 300, "x" * 301, "xyxyxyxy", "yxyxyxyx", "banana", "bananaa"]
    for _ in range(60):
        word = rng.choice(pool)
        i = rng.randrange(len(word))
        pool.append(rng.choice([word[:i] + rng.choice("abcxé") + word[i + 1 :], word[:i] + word[i + 1 :], word[:i] + rng.choice("abcxé") + word[i:]]))
    weights = [1 / (1 + k) for k in range(len(pool))]
    return [(rng.choice([None, k, k % 5]), rng.choice([" ", "1", "--"]).join(rng.choices(pool, weights, k=rng.randrange(40)))) for k in range(n)]


@pytest.mark.parametrize(("seed", "size"), [(1, 3), (2, 7), (3, 1), (4, 10_000)])
def test_like_brute_force(spark, seed, size):
    rows = [*texts(seed), (1, None), (None, ""), (2, "1 2 中文"), (3, "lonely " * 5000), *texts(seed)[:40]]
    docs = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in rows], SCHEMA).repartition(3)
    for one_in in (97, 3):
        words = brute_words(rows, 4, 2, one_in)
        assert len(words) > 30
        assert got(S.spelling_variants(docs, 4, 2, one_in, size=size)) == brute(words)


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=6), min_size=1, max_size=40), st.integers(1, 9))
def test_each_pair_once(words, size):
    """The shards' versions, joined by hand, give every pair of near words once, however the words are cut into shards."""
    words = sorted(words)
    shards = [words[k : k + size] for k in range(0, len(words), size)]
    shares = [-1, *(len(S.commonprefix((a[-1], b[0]))) for a, b in zip(shards, shards[1:])), -1]
    children = {}
    for k, part in enumerate(shards):
        for prefix, first, end in S._spanning(part, shares[k], shares[k + 1]):
            children.setdefault(prefix, Counter()).update(part[i][len(prefix)] for i in range(first, end) if len(part[i]) > len(prefix))
    for prefix, held in children.items():
        assert held == Counter(w[len(prefix)] for w in words if w.startswith(prefix) and len(w) > len(prefix))
    heavies = {S._node(p): max(c, key=lambda x: (c[x], x)) for p, c in children.items() if c}
    found, marked = [], {}
    for k, part in enumerate(shards):
        for i, d, heavy in S._light(part, shares[k], shares[k + 1], heavies):
            for mark, version in S._versions(part[i], d, heavy, 1):
                if mark:
                    marked.setdefault(version, []).append(part[i])
                elif version in words:
                    found.append(frozenset((part[i], version)))
    found += [frozenset((a, b)) for held in marked.values() for x, a in enumerate(held) for b in held[:x]]
    assert sorted(map(sorted, found)) == sorted(sorted((a, b)) for x, a in enumerate(words) for b in words[:x] if near(a, b))


def test_versions_stay_few():
    """A word is written anew for at most log2(words) nodes, whatever its length."""
    words = sorted({"a" * k + "b" for k in range(200)} | {"a" * 500})
    light = Counter(i for i, _, _ in S._light(words, -1, -1, {}))
    assert max(light.values()) <= 8


def test_without_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert S.spelling_variants(empty).count() == 0
    lone = spark.createDataFrame([(k, "single", "", 1, 2) for k in range(5)], SCHEMA)
    assert [r[:3] for r in got(S.spelling_variants(lone, one_in=10**12))] == [("single", 5, 0)]


def test_sql(spark, tmp_path):
    path = tmp_path / "documents.parquet"
    spark.createDataFrame([(i, t, "", 1, 2) for i, t in texts(8, 600)], SCHEMA).coalesce(1).write.parquet(str(path))
    base = duckdb.connect()
    base.execute(f"create view documents as select * from '{path}/*.parquet'")
    rows = base.sql(f"select word, n, n_near, form, form_n, root from ({S.OP13_SQL})").fetchall()
    assert sorted(rows) == brute(brute_words(texts(8, 600))) == got(S.op13_spelling(spark, str(tmp_path)))
