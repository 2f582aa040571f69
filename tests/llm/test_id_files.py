import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tracelake.llm.library_ids import LibraryIds
from tracelake.llm.orc_tokens import offsets, read_orc, write_orc
from tracelake.llm.packing import cuts, pack

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
SCHEMA = "doc_id long, text string, ids string, place long"


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "The", "Σ", "é", " ", "\n", "\x1c", "\x85", "'s", "٣", "#$%", "<|endoftext|>", "<|", "한", "😀", "thth", " ", "_"]), max_size=20))
def test_words_like_whole_texts(parts):
    text = "".join(parts)
    assert LibraryIds(PATH, 3).packed([text, text]) == [np.array(ids_of(text)[:-1], "<u4").tobytes()] * 2


def test_the_model_has_each_word_once():
    """A new word goes to the library's model by itself, without a text around it, and once while it is remembered."""
    of, asked = LibraryIds(PATH), []
    tokenize = of.tokenize
    of.tokenize = lambda word: asked.append(word) or tokenize(word)
    texts = ["One two, one's " * 50, "two <|endoftext|> einhundertzwanzigste 12 überzwei", "", "x" * 30_000 + " one"]
    for _ in range(2):
        assert of.packed(texts) == [np.array(ids_of(t)[:-1], "<u4").tobytes() for t in texts]
    assert len(asked) == len(set(asked)) == 9


def rows(n=120):
    random.seed(11)
    words = ["alpha", "beta", "Gamma,", "délta", "e<|endoftext|>f", "zz.zz", "12345"]
    out = [(k * 7 % 101, " ".join(random.choice(words) for _ in range(random.choice([0, 1, 5, 60, 700, 1500]))), "x", 1) for k in range(n)]
    return out + [(None, None, None, None), (None, "no id", "x", 1), (3, "same", "x", 1), (3, "same", "x", 1), (500, "long " * 20_000, "x", 1)]


def test_orc_round_trip(spark, tmp_path):
    data = rows()
    write_orc(spark.createDataFrame(data, SCHEMA), str(tmp_path / "a"), partitions=5)
    back = read_orc(spark, str(tmp_path / "a"))
    got = offsets(back).collect()
    assert sorted(str((r.id, r.n_tokens, r.ids_crc32)) for r in got) == sorted(str((r[0], len(i := ids_of(r[1])), crc(i))) for r in data)
    at, last = 0, None
    for r in sorted(got, key=lambda r: r.start):  # gapless, ascending ids, null first
        assert r.start == at and (last is None or r.id >= last)
        at, last = at + r.n_tokens, r.id
    assert at == sum(len(ids_of(r[1])) for r in data)
    one = back.where("id = 500")
    assert "id" in one._jdf.queryExecution().toString() and one.count() == 1
    write_orc(spark.createDataFrame([], SCHEMA), str(tmp_path / "b"))
    assert offsets(read_orc(spark, str(tmp_path / "b")).select("id", "file", "place", "ids")).count() == 0


def test_orc_metadata_and_skipped_rows(spark, tmp_path):
    data = [(k, "some words " * (k % 5), "x", 1) for k in range(9_000)]
    write_orc(spark.createDataFrame(data, SCHEMA), str(tmp_path / "m"), partitions=2)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    rows = 0
    for file in (tmp_path / "m").glob("*.orc"):
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(file)), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() == 1_000 and "ZSTD" in str(reader.getCompressionKind())
        rows += reader.getNumberOfRows()
        scan = reader.rows()
        for stripe in reader.getStripes():
            streams = [(str(x.getKind()), x.getColumn()) for x in scan.readStripeFooter(stripe).getStreamsList()]
            assert any(kind.startswith("BLOOM_FILTER") and column == 1 for kind, column in streams) and ("ROW_INDEX", 1) in streams
        scan.close()
    assert rows == len(data)
    # a reader of one id is given its row group alone, or a few at most
    wanted = read_orc(spark, str(tmp_path / "m")).where("id = 4321")
    query = wanted._jdf.queryExecution()
    assert [r.id for r in wanted.collect()] == [4321]
    leaves = query.executedPlan().collectLeaves()
    read = [leaves.apply(k).metrics().get("numOutputRows").get().value() for k in range(leaves.size())]
    assert sum(read) <= 1_000, read


def test_cuts():
    for n in range(1, 5000):
        lengths = cuts(n)
        assert sum(lengths) == n and all(0 < x <= 2048 for x in lengths) and len(lengths) <= n // 2048 + 5


def test_packing(spark):
    data = rows(300)
    got = pack(spark.createDataFrame(data, SCHEMA)).collect()
    texts = defaultdict(list)
    for r in data:
        texts[r[0], len(ids_of(r[1]))].append(ids_of(r[1]))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        assert any(crc(i[r.start : r.start + r.length]) == r.ids_crc32 for i in texts[r.doc_id, r.doc_tokens])
        pieces[r.doc_id, r.doc_tokens].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for (key, n), found in pieces.items():
        assert sum(x for _, x in found) == n * len(texts[key, n])
        assert all(found.count(p) >= len(texts[key, n]) for p in found)
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in got)
    assert total == sum(len(ids_of(r[1])) for r in data)
    assert 1 - total / (2048 * len(sequences)) < 0.03
    assert pack(spark.createDataFrame([], SCHEMA)).count() == 0
