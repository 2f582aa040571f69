"""Operator 13: spelling variants, by merging light subtrees of a trie with one character skipped or replaced.

Two words one edit apart part at one node of the trie of all words. Every node has a heavy child, the one with most words;
only words below its other children, the light ones, are written anew for that node: with the character after the node
skipped, with it replaced (by the heavy child's, and by a mark), and with the heavy child's put before it. A word lies below at most
log2(words) light children, so the merged tries hold as many versions of it at most, whatever its length. Where a version ends
at a word, or two marked versions coincide, there is a pair; each pair is found once, at the node where its words part.

The sorted words are cut into shards, rows of some ten thousand words that a task walks by themselves. Nodes that reach over shards
have their children counted in all of them first, so that every shard takes the same heavy child.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from hashlib import blake2b
from os.path import commonprefix

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import shared

MIN_CHARS, LEAST, ONE_IN = 5, 3, 97
SHARD = 50_000
_RUNS = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: What a task counts before it passes its counts on: words, and their characters.
_HELD, _HELD_CHARS = 400_000, 16_000_000
_MARK = "\0"  # in no word


def _mixed(counts: Counter, doc_id: object, text: str, one_in: int) -> None:
    """Adds the words of a text; of a word whose checksum with the id ``one_in`` divides, a character is taken out."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for word, n in Counter(_RUNS.findall(text.translate(_LOWER))).items():
        h = zlib.crc32(word.encode(), start)
        if h % one_in == 0:
            h %= len(word)
            word = word[:h] + word[h + 1 :]
        counts[word] += n


def word_counts(docs: DataFrame, min_chars: int = MIN_CHARS, least: int = LEAST, one_in: int = ONE_IN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words of ``min_chars`` code points and ``least`` occurrences or more; tasks count ahead."""
    schema = "word string, n long"

    def run(batches):
        counts = Counter()
        chars = 0

        def taken():
            words = [w for w in counts if len(w) >= min_chars]
            for k in range(0, len(words), 20_000):
                part = words[k : k + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([counts[w] for w in part], pa.int64())], ["word", "n"])
            counts.clear()

        for batch in batches:
            for part in shared.slices([batch]):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    _mixed(counts, doc_id, text, one_in)
                    chars += len(text)
                    if len(counts) >= _HELD or chars >= _HELD_CHARS and sum(map(len, counts)) >= _HELD_CHARS:
                        yield from taken()
                    if chars >= _HELD_CHARS:
                        chars = 0
        yield from taken()

    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string"), text_col)
    return texts.mapInArrow(run, schema).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _shards(words: DataFrame, size: int) -> DataFrame:
    """(shard, words, counts): the words in order, ``size`` a row. A word's id is its shard plus its place there; ids are in order of the words."""
    schema = pa.schema([("shard", pa.int64()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])

    def run(batches):
        at, words, counts = TaskContext.get().partitionId() << 40, [], []
        for batch in batches:
            words += batch.column(0).to_pylist()
            counts += batch.column(1).to_pylist()
            while len(words) >= size:
                yield pa.RecordBatch.from_pylist([{"shard": at, "words": words[:size], "counts": counts[:size]}], schema)
                at, words, counts = at + size, words[size:], counts[size:]
        if words:
            yield pa.RecordBatch.from_pylist([{"shard": at, "words": words, "counts": counts}], schema)

    return words.select("word", "n").repartitionByRange("word").sortWithinPartitions("word").mapInArrow(run, "shard long, words array<string>, counts array<long>")


def _node(prefix: str) -> int:
    """A node's number. Nodes of one number would only share their heavy child, which any character may be."""
    return int.from_bytes(blake2b(prefix.encode(), digest_size=8).digest(), "little", signed=True)


def _spanning(words: list[str], left: int, right: int):
    """(prefix, first, end) of the nodes that other shards hold too: prefixes of the first word up to ``left`` characters and of the last up to ``right``."""
    end = len(words)
    for d in range(left + 1):
        prefix = words[0][:d]
        while not words[end - 1].startswith(prefix):
            end -= 1
        yield prefix, 0, end
    first = 0
    for d in range(right + 1):
        prefix = words[-1][:d]
        while not words[first].startswith(prefix):
            first += 1
        if first or d > left:  # else it is a prefix of the first word, and was there before
            yield prefix, first, len(words)


def _nodes(words: list[str]):
    """(depth, bounds) of every branching node: bounds are the first places of its children, and the end of the last."""
    stack: list[tuple[int, list[int]]] = []
    for i in range(1, len(words) + 1):
        depth = len(commonprefix((words[i - 1], words[i]))) if i < len(words) else -1
        start = i - 1
        while stack and stack[-1][0] > depth:
            d, bounds = stack.pop()
            yield d, [*bounds, i]
            start = bounds[0]
        if stack and stack[-1][0] == depth:
            stack[-1][1].append(i)
        elif depth >= 0:
            stack.append((depth, [start, i]))


def _versions(word: str, d: int, heavy: str | None, min_chars: int):
    """(marked, version) of a word below a light child of the node of its first ``d`` characters; a word that ends there is its own light child."""
    before, c, after = word[:d], word[d : d + 1], word[d + 1 :]
    if heavy:
        yield False, before + heavy + c + after
        if c:
            yield False, before + heavy + after
    if c:
        yield True, before + _MARK + after
        if len(word) > min_chars and after[:1] != c:  # in a run of one character the skip belongs to its last
            yield False, before + after


def _light(words: list[str], left: int, right: int, heavies: dict[int, str]):
    """(place, depth, heavy child's character) of every light child that a word of the shard lies below."""
    for prefix, first, end in _spanning(words, left, right):
        d, heavy = len(prefix), heavies.get(_node(prefix))
        for i in range(first, end):
            if words[i][d : d + 1] != heavy:
                yield i, d, heavy
    for d, bounds in _nodes(words):
        if (bounds[0] == 0 and d <= left) or (bounds[-1] == len(words) and d <= right):
            continue
        sizes = [(b - a, -a) for a, b in zip(bounds, bounds[1:]) if len(words[a]) > d]
        most = -max(sizes)[1]
        heavy = words[most][d]
        for a, b in zip(bounds, bounds[1:]):
            if a != most:
                for i in range(a, b):
                    yield i, d, heavy


def _reaches(shards: DataFrame) -> dict[int, tuple[int, int]]:
    """Of every shard how many characters its first word shares with the word before, its last with the word after; -1 at the ends. A row a shard is gathered."""
    ends = sorted(tuple(r) for r in shards.select("shard", F.element_at("words", 1), F.element_at("words", -1)).collect())
    shares = [-1, *(len(commonprefix((a[2], b[1]))) for a, b in zip(ends, ends[1:])), -1]
    return {e[0]: (shares[k], shares[k + 1]) for k, e in enumerate(ends)}


def _heavies(shards: DataFrame, reaches: dict[int, tuple[int, int]]) -> dict[int, str]:
    """The heavy child of the nodes over several shards: as many as characters that neighbouring shards share."""

    def run(batches):
        for batch in batches:
            for shard, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                for prefix, first, end in _spanning(words, *reaches[shard]):
                    d = len(prefix)
                    rows += ((_node(prefix), c, n) for c, n in Counter(words[i][d] for i in range(first, end) if len(words[i]) > d).items())
                nodes, chars, counts = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(chars, pa.string()), pa.array(counts, pa.int64())], ["node", "char", "n"])

    children = shards.select("shard", "words").mapInArrow(run, "node long, char string, n long").groupBy("node", "char").agg(F.sum("n").alias("n"))
    return {r.node: r.char for r in children.groupBy("node").agg(F.max_by("char", F.struct("n", "char")).alias("char")).collect()}


def near_words(words: DataFrame, min_chars: int = MIN_CHARS, size: int = SHARD) -> DataFrame:
    """(id, word, n, n_near, best_id, best_n): of every word of ``words`` (word, n; distinct) how many words are one edit away, and the one of largest n.

    Ties go to the smallest word; ids are in order of the words. A word without a near one has 0 and nulls.
    """
    shards = shared.stored(_shards(words, size), "shards")
    reaches = _reaches(shards)
    heavies = _heavies(shards, reaches)

    def run(batches):
        for batch in batches:
            for shard, words, counts in zip(*(c.to_pylist() for c in batch.columns)):
                rows = ([], [], [], [])
                for i, d, heavy in _light(words, *reaches[shard], heavies):
                    for marked, version in _versions(words[i], d, heavy, min_chars):
                        for column, value in zip(rows, (version, marked, shard + i, counts[i])):
                            column.append(value)
                    if len(rows[0]) >= 20_000:
                        yield _versions_batch(rows)
                        rows = ([], [], [], [])
                yield _versions_batch(rows)

    versions = shards.mapInArrow(run, "version string, marked boolean, id long, n long")
    versions = shared.stored(versions, "versions")
    every = shards.select("shard", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "e")).select((F.col("shard") + F.col("place")).alias("id"), F.col("e.words").alias("word"), F.col("e.counts").alias("n"))
    best = lambda n, i: F.struct((-F.col(n)).alias("m"), F.col(i).alias("id"))
    # versions that end at a word
    ends = versions.where("not marked").select(F.col("version").alias("word"), F.col("id").alias("x"), F.col("n").alias("xn"))
    met = ends.join(every.select("word", F.col("id").alias("y"), F.col("n").alias("yn")).hint("merge"), "word")
    sides = F.array(F.struct(F.col("x").alias("id"), best("yn", "y").alias("best")), F.struct(F.col("y").alias("id"), best("xn", "x").alias("best")))
    one = met.select(F.explode(sides).alias("e")).select("e.id", F.lit(1).alias("near"), "e.best")
    # marked versions that coincide: words with different characters at one place, as many as there are letters at most
    groups = versions.where("marked").groupBy("version").agg(F.sort_array(F.collect_list(best("n", "id"))).alias("held")).where(F.size("held") > 1)
    members = groups.select("held", F.posexplode("held").alias("place", "e"))
    more = members.select("e.id", (F.size("held") - 1).alias("near"), F.get("held", F.when(F.col("place") == 0, 1).otherwise(0)).alias("best"))
    found = one.unionByName(more).groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    return every.join(found, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.id").alias("best_id"), (-F.col("best.m")).alias("best_n"))


def _versions_batch(rows) -> pa.RecordBatch:
    kinds = (pa.string(), pa.bool_(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], ["version", "marked", "id", "n"])


def _roots(forms: DataFrame) -> DataFrame:
    """(id, root) of ``forms`` (id, up): the last id that ups lead to. Each round doubles the steps; along them n doubles at least, so a chain is short."""
    now = shared.stored(forms, "forms")
    while True:
        beyond = now.select(F.col("id").alias("up"), F.col("up").alias("next"))
        before, now = now, shared.stored(now.join(beyond.hint("merge"), "up", "left").select("id", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")), "forms")
        moved = now.where("moved").isEmpty()
        shared.release(before)
        if moved:
            return now.select("id", F.col("up").alias("root"))


def spelling_variants(docs: DataFrame, min_chars: int = MIN_CHARS, least: int = LEAST, one_in: int = ONE_IN, id_col: str = "doc_id", text_col: str = "text", size: int = SHARD) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of at least ``min_chars`` code points and ``least`` occurrences.

    Words are runs of Latin letters (up to U+00FF), A-Z lowered; where ``one_in`` divides the checksum of ``<id>:<word>``, the occurrences
    in that document lack one character. ``n_near`` counts the words at exactly one edit. ``form`` is the near word of largest n (the
    smallest of equal ones) if its n is at least twice the word's, else null; ``root`` is where forms lead to in the end, or the word itself.

    A null text has no words, a null id reads as an empty one, repeated rows count each, other columns are not read, and an
    empty table gives no rows.
    """
    words = shared.stored(word_counts(docs, min_chars, least, one_in, id_col, text_col), "words")
    near = shared.stored(near_words(words, min_chars, size), "near")
    forms = near.where("best_n >= 2 * n").select("id", F.col("best_id").alias("up"))
    roots = _roots(forms)
    names = near.select(F.col("id").alias("other"), F.col("word").alias("name"))
    named = forms.join(names.hint("merge"), F.col("up") == F.col("other")).select("id", F.col("name").alias("form"))
    ends = roots.join(names.hint("merge"), F.col("root") == F.col("other")).select("id", F.col("name").alias("last"))
    return (
        near.join(named.join(ends, "id"), "id", "left")
        .select("word", "n", "n_near", "form", F.when(F.col("form").isNotNull(), F.col("best_n")).alias("form_n"), F.coalesce("last", "word").alias("root"))
    )


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(shared.documents(spark, sf_dir))


OP13_SQL = r"""
with runs as (
    select doc_id, run, count(*) as n
    from (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) as run from documents)
    group by all
), steps as (
    select list(c order by b) as tbl
    from (select b, list_reduce([b::bigint] || range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) as t(b))
), bytes as (
    select *, flatten(list_transform(string_split(concat(coalesce(doc_id::varchar, ''), ':', run), ''), lambda s: case when unicode(s) < 128 then [unicode(s)::bigint] else [192 + (unicode(s) >> 6), 128 + (unicode(s) & 63)]::bigint[] end)) as b
    from runs
), sums as (
    select run, n, xor(list_reduce([4294967295::bigint] || b, lambda c, x: xor(tbl[1 + (xor(c, x) & 255)], c >> 8)), 4294967295) as h
    from bytes, steps
), counted as (
    select word, sum(n)::bigint as n
    from (select case when h % 97 = 0 then concat(run[1:(h % length(run))], run[(h % length(run)) + 2:]) else run end as word, n from sums)
    where length(word) >= 5 group by word having sum(n) >= 3
), cuts as (
    select word, n, i, concat(word[1:i - 1], word[i + 1:]) as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from counted)
), pairs as (
    select a.word, b.word as other from cuts a join cuts b on a.i = b.i and a.rest = b.rest and a.word <> b.word
    union select a.word, b.word from cuts a join counted b on a.rest = b.word
    union select b.word, a.word from cuts a join counted b on a.rest = b.word
), near as (
    select p.word, count(*) as n_near, min({'m': -o.n, 'w': encode(p.other), 'other': p.other}) as best
    from pairs p join counted o on o.word = p.other group by p.word
), forms as (
    select c.word, c.n, coalesce(x.n_near, 0)::bigint as n_near, case when -x.best.m >= 2 * c.n then x.best.other end as form, case when -x.best.m >= 2 * c.n then -x.best.m end as form_n
    from counted c left join near x on x.word = c.word
), chains as (
    with recursive up as (
        select word, word as node, 0 as depth from forms
        union all
        select u.word, f.form, u.depth + 1 from up u join forms f on f.word = u.node where f.form is not null
    )
    select word, arg_max(node, depth) as root from up group by word
)
select f.word, f.n, f.n_near, f.form, f.form_n::bigint as form_n, c.root from forms f join chains c on c.word = f.word
"""
