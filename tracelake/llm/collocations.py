"""Operator 11: phrase collocations, by counting word n-grams as sorted fixed-width keys.

Words are counted by language; the frequent ones get dense numbers, and pieces break at all others, since no phrase that
holds one can be frequent. An n-gram is then the bytes of its numbers, four each, most significant first, so keys of one
length sort as their numbers do. Each block of text sorts its keys digit by digit and counts runs; the counts are
range-partitioned by key, sorted, and their runs summed up. Longer n-grams are formed only where both of their parts are frequent.

Texts are read once. They are kept as blocks of word numbers local to the block, and a block gets only the dictionary entries
and the frequent n-grams that it holds itself, by shuffles on the block: nothing is broadcast that grows with the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.llm import shared

LEAST, LONGEST, FIRST = 30, 4, 2000
#: Bytes of text after which a task closes its block of a language.
BLOCK_BYTES = 10_000_000
#: N-grams of a block that are looked up at a time.
_LOOKED_UP = 250_000
#: A word's number takes four bytes; 0 stands for a break.
ID = np.dtype(">u4")
_MOST_WORDS = 2**32 - 2
_BREAK = b"\xff"  # in no UTF-8 text
_ENDS = b".,;:!?\n\x0b\x0c\r"
#: One byte for another: A-Z lowered, tab to space, ends of pieces to the break.
_BYTES = bytes.maketrans(bytes(range(65, 91)) + b"\t" + _ENDS, bytes(range(97, 123)) + b" " + _BREAK * len(_ENDS))
_CHUNK = 1 << 20
_ZSTD = pa.Codec("zstd", compression_level=1)


def _squeezed(numbers: np.ndarray) -> bytes:
    return len(numbers).to_bytes(8, "little") + _ZSTD.compress(numbers.astype("<u4").tobytes(), asbytes=True)


def _numbers(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return np.frombuffer(_ZSTD.decompress(data[8:], 4 * n, asbytes=True), "<u4")


class _Block:
    """A block's texts in one language: words numbered from 1 as they come, breaks 0."""

    def __init__(self):
        self.number: dict[bytes, int] = {_BREAK: 0}
        self.parts: list[np.ndarray] = []
        self.pending: list[bytes] = []
        self.bytes = self.waiting = 0

    def add(self, text: bytes) -> None:
        self.pending.append(text)
        self.bytes += len(text)
        self.waiting += len(text)
        if self.waiting >= _CHUNK:
            self.flush()

    def flush(self) -> None:
        words = (_BREAK.join(self.pending) + _BREAK).translate(_BYTES).replace(_BREAK, b" \xff ").split()
        number = self.number
        for word in set(words).difference(number):
            number[word] = len(number)
        self.parts.append(np.fromiter(map(number.__getitem__, words), "<u4", len(words)))
        self.pending, self.waiting = [], 0

    def row(self, key: int, lang: str) -> dict:
        if self.pending:
            self.flush()
        codes = np.concatenate(self.parts)
        counts = np.bincount(codes, minlength=len(self.number))
        return {"block": key, "lang": lang, "words": list(self.number)[1:], "counts": counts[1:].tolist(), "codes": _squeezed(codes)}


def _blocks(docs: DataFrame, text_col: str, lang_col: str, block_bytes: int) -> DataFrame:
    """(block, lang, words, counts, codes): a row for each language and some ``block_bytes`` bytes of a task's texts."""
    schema = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64())), ("codes", pa.binary())])

    def run(batches):
        task, made, open_ = TaskContext.get().partitionId(), 0, {}

        def closed(lang):
            nonlocal made
            made += 1
            return pa.RecordBatch.from_pylist([open_.pop(lang).row((task << 32) + made, lang)], schema)

        for batch in batches:
            for part in shared.slices([batch]):
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    block = open_.get(lang)
                    if block is None:
                        block = open_[lang] = _Block()
                    block.add(text)
                    if sum(b.bytes for b in open_.values()) >= block_bytes:  # the largest goes, so many languages stay within bounds
                        yield closed(max(open_, key=lambda x: open_[x].bytes))
        for lang in list(open_):
            yield closed(lang)

    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), shared.text_of(text_col).cast("binary").alias("text"))
    return texts.mapInArrow(run, "block long, lang string, words array<binary>, counts array<long>, codes binary")


def _dictionary(counts: DataFrame) -> DataFrame:
    """``counts`` (lang, word, n) stored with dense numbers ``id`` from 1: places in a task, after the rows of the tasks before."""
    rows = shared.stored(counts.withColumn("at", F.monotonically_increasing_id()), "dictionary")
    task = F.shiftright("at", 33)
    sizes = sorted((r.task, r.n) for r in rows.groupBy(task.alias("task")).agg(F.count("*").alias("n")).collect())  # a row a task
    starts, total = [], 0
    for name, n in sizes:
        starts.append((name, total - (name << 33) + 1))
        total += n
    if total > _MOST_WORDS:
        raise ValueError(f"{total} frequent words do not fit {ID.itemsize} bytes")
    shifts = counts.sparkSession.createDataFrame(starts, "task long, shift long")
    return rows.join(F.broadcast(shifts), task == F.col("task")).select((F.col("at") + F.col("shift")).alias("id"), "lang", "word", "n")


def _encoded(blocks: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(block, codes): each block's words as numbers of the dictionary, rare ones as breaks; a block gets the entries of its own words alone."""
    own = blocks.select("block", "lang", F.posexplode("words").alias("place", "word"))
    entries = own.join(dictionary.select("lang", "word", "id").hint("merge"), ["lang", "word"]).select("block", "place", "id")

    def renumber(_, codes: pa.Table, entries: pa.Table) -> pa.Table:
        out = [_reduced(codes, entries)] if codes.num_rows else []
        return pa.table({"block": codes.column("block").slice(0, len(out)), "codes": pa.array(out, pa.binary())})

    def _reduced(codes: pa.Table, entries: pa.Table) -> bytes:
        old = _numbers(codes.column("codes")[0].as_py())
        ids = np.zeros(int(old.max(initial=0)) + 1, "<u4")
        ids[np.asarray(entries.column("place")) + 1] = np.asarray(entries.column("id"))
        return _squeezed(_without_repeated_breaks(ids[old]))

    sides = blocks.select("block", "codes").groupBy("block").cogroup(entries.toDF("home", "place", "id").groupBy("home"))
    return sides.applyInArrow(renumber, "block long, codes binary")


def _without_repeated_breaks(codes: np.ndarray) -> np.ndarray:
    zero = codes == 0
    return codes[~(zero & np.append(zero[1:], True))]


def _sorted_runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of ``keys`` (m, n) of ``ID`` in order, and how often each stands there: a radix sort by digits of 16 bits, then run lengths."""
    m = len(keys)
    if not m:
        return keys, np.zeros(0, np.int64)
    digits = np.ascontiguousarray(keys).view(">u2")
    order = np.arange(m, dtype=np.uint32)
    for d in range(digits.shape[1] - 1, -1, -1):
        column = digits[:, d].astype(np.uint16)
        if column.min() != column.max():
            order = order[np.argsort(column[order], kind="stable")]  # for 16 bits numpy's stable sort is a radix sort
    keys = keys[order]
    first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
    return keys[first], np.diff(np.append(first, m))


def _binary(keys: np.ndarray) -> pa.Array:
    m, width = len(keys), keys.shape[1] * ID.itemsize
    return pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(np.arange(0, (m + 1) * width, width, dtype=np.int32).tobytes()), pa.py_buffer(keys.tobytes())])


def _ngrams(codes: np.ndarray, n: int, places: np.ndarray) -> np.ndarray:
    keys = np.empty((len(places), n), ID)
    for k in range(n):
        keys[:, k] = codes[places + k]
    return keys


def _frequent_places(codes: np.ndarray, n: int, held: np.ndarray) -> np.ndarray:
    """Whether an n-gram of ``held`` (keys of n words) begins at each place; looked up some at a time, as sorting all of a block's keys takes many times their bytes."""
    whole = np.ones(max(len(codes) - n + 1, 0), bool)
    for k in range(n):
        whole &= codes[k : k + len(whole)] > 0
    places, starts = np.flatnonzero(whole), np.zeros(len(codes), bool)
    for k in range(0, len(places), _LOOKED_UP):
        part = places[k : k + _LOOKED_UP]
        starts[part[np.isin(_ngrams(codes, n, part).view(held.dtype).ravel(), held)]] = True
    return starts


def _counts_of(block: int, codes: np.ndarray, n: int, places: np.ndarray):
    keys, counts = _sorted_runs(_ngrams(codes, n, places))
    for k in range(0, len(keys), 100_000):
        part = keys[k : k + 100_000]
        yield pa.RecordBatch.from_arrays([_binary(part), pa.array(np.full(len(part), block), pa.int64()), pa.array(counts[k : k + 100_000], pa.int64())], ["key", "block", "n"])


_COUNTED = "key binary, block long, n long"


def _pairs(encoded: DataFrame) -> DataFrame:
    """(key, block, n) of the pairs of words that stand next to each other."""

    def run(batches):
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes = _numbers(data)
                yield from _counts_of(block, codes, 2, np.flatnonzero((codes[:-1] > 0) & (codes[1:] > 0)))

    return encoded.select("block", "codes").mapInArrow(run, _COUNTED)


_PACKED = "block long, keys binary, counts binary"
#: Keys that a task gathers before it passes them on, a row for each block.
_GATHERED = 200_000


def _by_block(keys: list[np.ndarray], blocks: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each block with its keys one after the other."""
    keys, blocks = np.concatenate(keys), np.concatenate(blocks)
    order = np.argsort(blocks, kind="stable")
    keys, blocks = keys[order], blocks[order]
    first = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1]))
    held = [keys[a:b].tobytes() for a, b in zip(first, [*first[1:], len(keys)])]
    return pa.RecordBatch.from_arrays([pa.array(blocks[first]), pa.array(held, pa.binary()), pa.nulls(len(held), pa.binary())], ["block", "keys", "counts"])


def _sums(keys: list[bytes], sums: list[np.ndarray]) -> pa.RecordBatch:
    """One row, without a block: keys and how often each stands in the corpus."""
    return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([b"".join(keys)], pa.binary()), pa.array([np.concatenate(sums).astype("<i8").tobytes()], pa.binary())], ["block", "keys", "counts"])


def _frequent(counted: DataFrame, n: int, least: int) -> DataFrame:
    """The keys of ``counted`` (key, block, n) that sum up to ``least`` or more, by range partition, sort and run lengths.

    Rows are (block, keys, counts): what each block holds of them, packed; and without a block, keys with their sums. A run's rows
    are passed on once its sum is known to be enough, so a task holds fewer than ``least`` of them.
    """
    width = n * ID.itemsize

    def run(batches):
        last, held, total = b"", [], 0  # the run that may go on: its key, its rows not passed on yet, the sum of those that were
        keys, blocks, rows, whole, sums = [], [], 0, [], []
        for batch in batches:
            if held:
                batch = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
            m = batch.num_rows
            if not m:
                continue
            data = batch.column(0)
            start = int(np.frombuffer(data.buffers()[1], np.int32)[data.offset])
            raw = np.frombuffer(data.buffers()[2], np.uint8, m * width, start).reshape(m, width)
            first = np.flatnonzero(np.append(True, (raw[1:] != raw[:-1]).any(axis=1)))
            here = np.add.reduceat(batch.column(2).to_numpy(), first)
            if last == raw[0].tobytes():
                here[0] += total  # held rows are in the batch again
            elif total:
                whole.append(last)
                sums.append(np.array([total]))
            enough = here >= least
            if enough.any():
                keep = np.repeat(enough, np.diff(np.append(first, m)))
                keys.append(raw[keep])
                blocks.append(batch.column(1).to_numpy()[keep])
                rows += int(keep.sum())
                ended = enough.copy()
                ended[-1] = False
                whole.append(raw[first[ended]].tobytes())
                sums.append(here[ended])
            last = raw[-1].tobytes()
            held, total = ([], int(here[-1])) if enough[-1] else ([batch.slice(int(first[-1]))], 0)
            if rows >= _GATHERED:
                yield _by_block(keys, blocks)
                yield _sums(whole, sums)
                keys, blocks, rows, whole, sums = [], [], 0, [], []
        if total:
            whole.append(last)
            sums.append(np.array([total]))
        if rows:
            yield _by_block(keys, blocks)
        if sums:
            yield _sums(whole, sums)

    return counted.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(run, _PACKED)


def _sums_of(packed: DataFrame, n: int) -> DataFrame:
    """(key, words, f) of the keys of ``n`` words with their sums."""

    def run(batches):
        for batch in batches:
            for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f = np.frombuffer(counts, "<i8")
                yield pa.RecordBatch.from_arrays([_binary(np.frombuffer(keys, ID).reshape(len(f), n)), pa.array(np.full(len(f), n, np.int32)), pa.array(f)], ["key", "words", "f"])

    return packed.where("block is null").select("keys", "counts").mapInArrow(run, "key binary, words int, f long")


def _longer(encoded: DataFrame, frequent: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(blocks with the words of no frequent n-gram as breaks, counts (key, block, n) of their (n + 1)-grams both of whose n-grams are frequent).

    A block gets the frequent n-grams that it holds itself.
    """

    def cut(_, codes: pa.Table, grams: pa.Table) -> pa.Table:
        rows = []
        if codes.num_rows and grams.num_rows:
            numbers = _numbers(codes.column("codes")[0].as_py())
            held = np.frombuffer(b"".join(grams.column("keys").to_pylist()), f"S{n * ID.itemsize}")
            starts = _frequent_places(numbers, n, held)
            # only where two frequent n-grams begin at neighbouring words is there a longer one
            double = np.flatnonzero(starts[:-1] & starts[1:])
            used = np.zeros(len(numbers), bool)
            for k in range(n + 1):
                used[double + k] = True
            begins = np.zeros(len(numbers), bool)
            begins[double] = True
            kept = np.where(used, numbers, 0)
            slim = ~((kept == 0) & np.append(kept[1:] == 0, True))
            # the places where one begins, as bits beside the codes
            rows.append((_squeezed(kept[slim]), np.packbits(begins[slim]).tobytes()))
        return pa.table({"block": codes.column("block").slice(0, len(rows)), "codes": pa.array([r[0] for r in rows], pa.binary()), "begins": pa.array([r[1] for r in rows], pa.binary())})

    sides = encoded.select("block", "codes").groupBy("block").cogroup(frequent.where("block is not null").select("block", "keys").toDF("home", "keys").groupBy("home"))
    slim = shared.stored(sides.applyInArrow(cut, "block long, codes binary, begins binary"), "spans")

    def run(batches):
        for batch in batches:
            for block, data, begins in zip(*(c.to_pylist() for c in batch.columns)):
                codes = _numbers(data)
                yield from _counts_of(block, codes, n + 1, np.flatnonzero(np.unpackbits(np.frombuffer(begins, np.uint8), count=len(codes))))

    return slim, slim.mapInArrow(run, _COUNTED)


def _part(key: str, first: Column, words: Column) -> Column:
    return F.substring(F.col(key), first * ID.itemsize + 1, words * ID.itemsize)


def _scored(grams: DataFrame) -> DataFrame:
    """Phrases of ``grams`` (key, words, f) with a, l, r and score of their lowest-scoring cut."""
    cuts = grams.where("words > 1").select("key", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("key", "words", "a", "k", _part("key", F.lit(0), F.col("k")).alias("left"), _part("key", F.col("k"), F.col("words") - F.col("k")).alias("right"))
    of = lambda side, count: grams.select(F.col("key").alias(side), F.col("f").alias(count)).hint("merge")
    both = cuts.join(of("left", "l"), "left").join(of("right", "r"), "right")
    score = F.expr("cast(2000000 as decimal(38,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    return both.groupBy("key").agg(F.max("words").alias("words"), F.max("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")).select("key", "words", "a", "cut.l", "cut.r", "cut.score")


def _not_within(phrases: DataFrame, longest: int) -> DataFrame:
    """``phrases`` without those that stand inside a longer one of four fifths of their count or more."""
    inside = [(n, k, at) for n in range(3, longest + 1) for k in range(2, n) for at in range(n - k + 1)]
    if not inside:
        return phrases
    parts = F.array(*(F.when(F.col("words") == n, _part("key", F.lit(at), F.lit(k))) for n, k, at in inside))
    longer = phrases.where("words > 2").select(F.explode(F.filter(parts, lambda p: p.isNotNull())).alias("key"), "a").groupBy("key").agg(F.max("a").alias("most"))
    return phrases.join(longer.hint("merge"), "key", "left").where(F.expr("most is null or 5 * cast(most as decimal(20,0)) < 4 * cast(a as decimal(20,0))")).drop("most")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, first: int | None = FIRST, text_col: str = "text", lang_col: str = "lang", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each language's ``first`` phrases (all, if None): lang, rank, phrase, a, l, r, n, score.

    Phrases have 2 to ``longest`` words within a piece (between any of ``.,;:!?`` and line ends; words part at blanks and
    tabs, A-Z is lowered) and at least ``least`` occurrences a, overlaps included. A cut into two parts with l and r occurrences scores
    floor(2000000 a / (l + r)); the lowest-scoring cut counts, the earliest of equal ones. Phrases inside a longer one
    with at least 80 % of their occurrences are left out. n is the number of words of the language.

    A null text is empty; a null language is ``und``; repeated rows count each; other columns are not read; without a
    frequent phrase, as in an empty table, there are no rows. Ties are in order of a (falling), then of the phrase's bytes.
    """
    blocks = shared.stored(_blocks(docs, text_col, lang_col, block_bytes), "blocks")
    entries = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("e"))
    counts = entries.groupBy("lang", F.col("e.words").alias("word")).agg(F.sum("e.counts").alias("n"))
    dictionary = _dictionary(counts.where(F.col("n") >= least))
    totals = shared.stored(blocks.groupBy("lang").agg(F.sum(F.expr("aggregate(counts, 0L, (s, x) -> s + x)")).alias("n")), "words")  # a row a language
    held = shared.stored(_encoded(blocks, dictionary), "encoded")
    shared.release(blocks)
    counted, levels = _pairs(held), []
    for words in range(2, longest + 1):
        levels.append(shared.stored(_frequent(counted, words, least), "ngrams"))
        if words < longest:
            before = held
            held, counted = _longer(held, levels[-1], words)
            shared.release(before)
    shared.release(held)
    grams = dictionary.select(F.unhex(F.lpad(F.hex("id"), 2 * ID.itemsize, "0")).alias("key"), F.lit(1).alias("words"), F.col("n").alias("f"))
    for words, level in enumerate(levels, 2):
        grams = grams.unionByName(_sums_of(level, words))
    grams = shared.stored(grams, "grams")
    for level in levels:
        shared.release(level)
    phrases = shared.stored(_not_within(_scored(grams), longest), "phrases")
    # the words of the phrases that are left, by joins on their numbers
    ids = phrases.select("key", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("words") - 1), lambda k: F.conv(F.hex(_part("key", k, F.lit(1))), 16, 10).cast("long"))).alias("place", "id"))
    texts = ids.join(dictionary.select("id", "lang", F.col("word").cast("string").alias("word")).hint("merge"), "id")
    named = texts.groupBy("key").agg(F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("place", "word"))).alias("w"))  # at most ``longest`` words
    named = phrases.join(named, "key").select("lang", F.array_join(F.col("w.word"), " ").alias("phrase"), "a", "l", "r", "score")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(best))
    if first is not None:
        ranked = ranked.where(F.col("rank") <= first)  # Spark keeps only so many rows of a task and language before they move
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(shared.documents(spark, sf_dir))


OP11_SQL = r"""
with recursive pieces as (
    select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]')) as piece
    from documents
), words as (
    select lang, regexp_extract_all(piece, '[^ \t]+') as w from pieces
), totals as (
    select lang, sum(len(w)) as n from words group by lang
), grams as (
    select lang, k, array_to_string(g, ' ') as phrase, count(*) as f
    from (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) as g from words, range(1, 5) as t(k))
    group by all
), candidates as (
    select lang, phrase, k, f as a, string_split(phrase, ' ') as w from grams where k > 1 and f >= 30
), parts as (
    select lang, phrase, k, a, unnest(range(1, k)) as cut, w from candidates
), scored as (
    select p.lang, p.phrase, p.k, p.a, p.cut, x.f as l, y.f as r, (2000000::hugeint * p.a) // (x.f::hugeint + y.f) as score
    from parts p
    join grams x on x.lang = p.lang and x.phrase = array_to_string(p.w[1:p.cut], ' ')
    join grams y on y.lang = p.lang and y.phrase = array_to_string(p.w[p.cut + 1:], ' ')
), lowest as (
    select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1
), inner_parts as (
    select lang, a, array_to_string(w[i:j], ' ') as phrase
    from candidates, range(1, 5) as s(i), range(1, 5) as e(j)
    where i < j and j <= k and j - i + 1 < k
), longer as (
    select lang, phrase, max(a) as most from inner_parts group by all
), kept as (
    select c.* from lowest c left join longer o on o.lang = c.lang and o.phrase = c.phrase
    where o.most is null or 100 * o.most::hugeint < 80 * c.a::hugeint
), ranked as (
    select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept
)
select r.lang, r.rank::bigint as rank, r.phrase, r.a::bigint as a, r.l::bigint as l, r.r::bigint as r, t.n::bigint as n, r.score::bigint as score
from ranked r join totals t on t.lang = r.lang where r.rank <= 2000
"""
