import random
import zlib

import numpy as np

from tracelake.llm import toxicity
from tracelake.llm.toxicity import Model, drop_toxic, fit, score, train, words_of

SCHEMA = "doc_id long, text string, score string, toxic string"
INSULTS = ["idiot", "moron", "worthless", "stupid"]


def corpus(n, seed):
    random.seed(seed)
    words = ["".join(random.choice("aeiourstln") for _ in range(random.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for k in range(n):
        text = [random.choice(words) for _ in range(random.randint(5, 120))]
        bad = random.random() < 0.3
        for _ in range(random.randint(1, 3) if bad else 0):
            text[random.randrange(len(text))] = random.choice(INSULTS)
        rows.append((k, " ".join(text), "x", "y"))
        labels.append((k, 1, int(bad)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus(900, 1)
    truth = {k: t for k, _, t in labels}
    extra = [(None, "no id", None, None), (5000, None, None, None), (5001, "", None, None), (5002, "calm " * 30_000 + "you idiot", None, None), (1, rows[1][1], "x", "y"), (5003, "you idioot and m0ron, morons", None, None)]
    docs, known = spark.createDataFrame(rows + extra, SCHEMA), spark.createDataFrame(labels + [(None, 1, 1), (7, 1, None), (99999, 0, 1)], "doc_id long, quality int, toxic int")
    model = train(docs, known)
    got = score(docs, model).collect()
    assert len(got) == len(rows) + len(extra)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    by = {r.doc_id: r for r in got}
    assert by[5000].predicted == by[5001].predicted == 0 and by[5002].predicted == 1 and by[5003].predicted == 1  # misspelt
    left = drop_toxic(docs, known)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(r.doc_id) for r in got if not r.predicted)


def test_small_samples(spark):
    assert isinstance(fit([], []), Model) and fit(["a"], [0]).scorer()(["a"])[0] < 0.5 < fit(["a"], [1]).scorer()(["a"])[0]
    docs = spark.createDataFrame([], SCHEMA)
    known = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert score(docs, train(docs, known)).count() == 0
    rows, labels = corpus(60, 4)
    a, b = fit([r[1] for r in rows], [t for *_, t in labels], rounds=5), fit([r[1] for r in rows], [t for *_, t in labels], rounds=5)
    assert (a.gain == b.gain).all()


def test_long_runs_are_read_to_their_end():
    rows, labels = corpus(600, 2)
    scores = fit([r[1] for r in rows], [t for *_, t in labels]).scorer()
    random.seed(6)
    calm = "".join(random.choice("aeiourstln") for _ in range(10_000))
    clean = next(text for (_, text, *_), (*_, toxic) in zip(rows, labels) if not toxic).split()
    words = [random.choice(clean) for _ in range(2000)]
    low = scores([calm, ",".join(words), "_".join(words)])
    high = scores([calm + "idiot", ",".join(words) + ",idiot", "_".join(words + ["idiot"]), "-".join(words[:1000] + ["idiot"] + words[1000:])])
    assert max(low) < 0.5 < min(high), (low, high)
    for n in range(60, 200):  # pieces overlap and leave out nothing
        run = "".join(chr(0x4E00 + k) for k in range(n))
        assert all(any(run[k : k + 8] in w for w in words_of(run)) for k in range(n - 7))
    assert words_of("A b" + "c" * 61) == ["a", "b" + "c" * 61]


def test_windows_start_at_every_word():
    rows, labels = corpus(300, 8)
    scores = fit([r[1] for r in rows], [t for *_, t in labels]).scorer()
    clean = next(text for (_, text, *_), (*_, toxic) in zip(rows, labels) if not toxic).split()[:4]
    even, odd = scores([" ".join(clean[:k] + ["moron", "idiot"] + clean[k:]) for k in (2, 3)])
    assert even == odd > 0.5 and len(set(scores(["idiot", "idiot idiot", "idiot idiot idiot"]))) == 1


def test_a_repeated_id_is_one_training_document(spark):
    train = lambda docs, known: sorted((r.text, r.toxic) for r in toxicity.training_rows(docs, known).collect())
    ids = [k for k in range(20) if zlib.crc32(str(k).encode()) % 5][:4]
    docs = spark.createDataFrame([(ids[0], f"text {k}", "", "") for k in range(50)] + [(k, f"own {k}", "", "") for k in ids[1:]], SCHEMA)
    known = spark.createDataFrame([(k, 1, n % 2) for n, k in enumerate(ids)], "doc_id long, quality int, toxic int")
    got = train(docs, known)
    assert len(got) == 4 and {(f"own {k}", n % 2) for n, k in enumerate(ids) if n} < set(got) and got == train(docs.repartition(3), known)


def test_the_sample_is_bounded_in_characters(spark):
    ids = [k for k in range(60) if zlib.crc32(str(k).encode()) % 5]
    docs = spark.createDataFrame([(k, "x" * (1000 if k == ids[0] else 100), "", "") for k in ids], SCHEMA)
    known = spark.createDataFrame([(k, 1, n % 2) for n, k in enumerate(ids)], "doc_id long, quality int, toxic int")
    got = toxicity.training_rows(docs, known, chars=550, longest=999).collect()
    assert [sum(r.toxic == t for r in got) for t in (0, 1)] == [5, 5] and ids[0] not in {r.doc_id for r in got}
    rows, labels = corpus(200, 5)
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = sorted((r.doc_id, r.text, r.toxic) for r in toxicity.training_rows(docs, known).collect())
    assert np.allclose(train(docs, known).gain, fit([t for _, t, _ in kept], [t for *_, t in kept]).gain)  # fitted on an executor as here


def test_scores_by_plain_loops():
    """A score is the softmax of the document's average and the worst two neighbours', word by word and n-gram by n-gram."""
    rows, labels = corpus(120, 9)
    model = fit([r[1] for r in rows], [t for *_, t in labels], rounds=30)
    assert np.abs(model.share).max() > 0 and np.abs(model.gain).max() > 0

    def of_word(word, part):
        held = f"<{word.strip(toxicity._STRIP) or word}>"
        grams = [zlib.crc32(held.encode())]
        for n in toxicity.NGRAMS:
            for k in range(len(held) - n + 1):
                rolled = ord(held[k]) * 0x9E3779B1 % 2**64
                for c in held[k + 1 : k + n]:
                    rolled = (rolled * 0x100000001B3 + ord(c)) % 2**64
                grams.append(((rolled ^ (rolled >> 29)) * 0xBF58476D1CE4E5B9 % 2**64) >> 40)
        return sum(part[g % toxicity.BUCKETS] for g in grams) / len(grams)

    texts = [r[1] for r in rows[:40]] + ["", "one", "Two, words!", "** --", "x" * 200, "a\tb\nc é中"]
    for text, got in zip(texts, model.scorer()(texts)):
        words, logit = words_of(text), model.bias
        if words:
            gains = [of_word(w, model.gain) for w in words]
            worst = max((a + b) / 2 for a, b in zip(gains, gains[1:])) if len(words) > 1 else gains[0]
            logit += worst + sum(of_word(w, model.share) for w in words) / len(words)
        assert abs(got - 1 / (1 + np.exp(-logit))) < 1e-9
