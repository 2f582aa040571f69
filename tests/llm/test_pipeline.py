"""The stages one after the other, each against brute force on what it was given."""

import random
import re

import corpus_pipeline
from tracelake.llm import shared
from tracelake.llm.quality import quality
from tracelake.llm.toxicity import score, train

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, held string, digest string, id string, h long, label string"
INSULTS = ["idiot", "moron", "worthless", "stupid"]


def corpus():
    rng = random.Random(5)
    words = ["".join(rng.choice("aeiourstln") for _ in range(rng.randint(2, 8))) for _ in range(600)]
    texts, labels = [], []
    for k in range(170):
        text = [rng.choice(words) for _ in range(rng.randint(60, 140))]
        bad = k % 4 == 0
        for _ in range(3 if bad else 0):
            text[rng.randrange(len(text))] = rng.choice(INSULTS)
        texts.append(" ".join(text))
        labels.append((k, int(k % 9 != 0), int(bad)))
    rows = list(enumerate(texts))
    rows += [(300 + k, texts[k].replace(" ", "\n", 5)) for k in range(0, 40)]  # equal but for white space
    labels += [(300 + k, 1, int(k % 4 == 0)) for k in range(0, 40)]
    for k in range(101, 130, 2):  # near copies: a word changed, another added
        copy = texts[k].split()
        copy[rng.randrange(20, 40)] = "changed"
        rows.append((400 + k, " ".join([*copy, "more"])))
        labels.append((400 + k, 1, 0))
    rows += [(600, None), (601, ""), (602, "short"), (None, texts[5]), (None, None), (1, texts[1]), (603, "again and again " * 60), (604, " ".join(rng.choice(words) for _ in range(9000)))]
    return [(key, text, "xx", "s", len(text or ""), "held", None, "id", 7, "label") for key, text in rows], labels


def ids(df):
    return sorted(str(r.doc_id) for r in df.select("doc_id").collect())


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def shingles(text):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_stages_in_a_chain(spark, tmp_path):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    known.write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = shared.documents(spark, str(tmp_path))
    inputs = {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs
        docs = shared.stored(stage(spark, docs, str(tmp_path)), "test")
        if name != "packing":
            assert docs.columns == inputs[name].columns
    after = {name: out for (name, _), out in zip(corpus_pipeline.STAGES, [*list(inputs.values())[1:], docs])}
    kept = {str(r.doc_id) for r in quality(inputs["quality rules"], known).where("kept").collect()}
    assert set(ids(after["quality rules"])) == kept and not {"600", "601", "602", "603"} & kept
    given = inputs["toxicity"]
    assert ids(after["toxicity"]) == ids(score(given, train(given, known)).where("predicted = 0"))
    toxic = {str(k) for k, _, bad in labels if bad}
    left = set(ids(after["toxicity"]))
    assert len(left & toxic) <= 0.05 * len(toxic) and len(set(ids(given)) - left - toxic - {str(300 + k) for k in range(0, 40, 4)}) <= 3
    groups = {}
    for r in inputs["exact dedup"].collect():
        groups.setdefault(plain(r.text), []).append((-len(r.text), r.doc_id is None, r.doc_id or 0))
    assert ids(after["exact dedup"]) == sorted(str(None if best[1] else best[2]) for best in map(min, groups.values()))
    sets = {r.doc_id: shingles(r.text) for r in inputs["near dedup"].collect()}
    order = sorted(sets, key=lambda k: (k is None, k or 0))
    root = {k: k for k in order}
    for _ in range(4):
        for i, a in enumerate(order):
            for b in order[i + 1 :]:
                if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                    root[a] = root[b] = min(root[a], root[b], key=order.index)
    assert ids(after["near dedup"]) == sorted(map(str, set(root.values()))) and len(set(root.values())) < len(root)
    pieces = docs.collect()
    spans = {}
    for p in pieces:
        spans.setdefault(p.doc_id, []).append((p.start, p.length, p.doc_tokens))
    assert set(map(str, spans)) == set(ids(after["near dedup"]))
    for found in spans.values():
        at = 0
        for start, length, total in sorted(found):
            assert start == at
            at += length
        assert at == total
    room = {}
    for p in pieces:
        room.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for found in room.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 2048


def test_stages_over_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
