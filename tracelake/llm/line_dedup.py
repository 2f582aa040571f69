"""Operator 9: line dedup, native: a segment-partition edit join of lines.

Two lines are linked when at most one edit (a code point replaced, put in or taken out) makes one the other.
A line is split into two segments, one more than the edits, so linked lines agree in one of them. Every line
is indexed by what lies outside one segment, and probes the index of lines of one code point less with what
lies outside a window one code point wider. On request, long lines are linked at more edits. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import shared
from tracelake.llm.components import components

#: The threshold is one edit from this many code points on. In a shorter line an edit is over a tenth of it, so its threshold
#: is none; pairs are measured by the shorter line, and ``longer`` gives larger thresholds for longer ones.
MIN_CHARS = 10
#: A bucket of more lines is not paired; its window is halved instead.
PAIRED = 32
BLANKS = " \t\n\x0b\x0c\r"


def _common(a: Column, b: Column) -> Column:
    """Code points that two strings have in common at their beginnings, by steps of falling powers of two."""
    n = F.least(F.char_length(a), F.char_length(b))
    most = F.ceil(F.log2(n + 1)).cast("int")
    steps = F.transform(F.sequence(F.lit(0), most), lambda k: F.pow(F.lit(2), most - k).cast("int"))
    same = lambda at, k: (at + k <= n) & (F.substring(a, at + 1, k) == F.substring(b, at + 1, k))
    return F.aggregate(steps, F.lit(0), lambda at, k: F.when(same(at, k), at + k).otherwise(at))


def without_ends(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with what ``a`` and ``b`` have in common at both ends taken away, which leaves their distance as it was.

    Through generators of one row: the optimiser would else work the lengths out again wherever they occur.
    """
    for _ in range(2):  # the second time from the other end, which turns the strings round again
        cut = F.explode(F.array(_common(F.col(a), F.col(b)))).alias("cut")
        rest = lambda c: F.reverse(F.substring(c, F.col("cut") + 1, F.char_length(c))).alias(c)
        pairs = pairs.select("*", cut).select(*(rest(c) if c in (a, b) else c for c in pairs.columns))
    return pairs


def within_edits(a: Column, b: Column, edits: int = 1) -> Column:
    """Whether the edit distance of two strings is at most ``edits``, by bit vectors over a band of 2 * edits + 1 diagonals.

    ``a`` is the longer string, or as long. A step takes one code point of ``b``; a bit of ``vp`` (``vn``) says that the
    distance rises (falls) from one row of the band to the next. Null if either is null.
    """
    top = 2 * edits
    full = (1 << top + 1) - 1
    n, m = F.char_length(a), F.char_length(b)
    pattern = F.split(a, "")
    equals = F.transform(F.split(b, ""), lambda c, i: sum((F.when(F.get(pattern, i - edits + k) == c, 1 << k).otherwise(0) for k in range(1, top + 1)), F.when(F.get(pattern, i - edits) == c, 1).otherwise(0)))
    start = F.struct(F.lit(0).alias("i"), F.lit(full ^ ((1 << edits) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(edits).alias("distance"))

    def step(s: Column, equal: Column) -> Column:
        vp, vn, past = s["vp"], s["vn"], s["i"] - (n - edits)
        d0 = (equal.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(equal).bitwiseOR(vn).bitwiseAND(F.lit(full))
        hp = vn.bitwiseOR(d0.bitwiseOR(vp).bitwiseXOR(F.lit(full)))
        hn, low = d0.bitwiseAND(vp), F.shiftright(d0, 1)
        # once the band has passed the end of ``a``, its last row is one bit lower with each step
        last = lambda bits: sum((F.when((past == k) & (bits.bitwiseAND(F.lit(1 << top - 1 - k)) != 0), 1).otherwise(0) for k in range(1, top)), F.when((past == 0) & (bits.bitwiseAND(F.lit(1 << top - 1)) != 0), 1).otherwise(0))
        rise = F.when(past < 0, F.when(d0.bitwiseAND(F.lit(1 << top)) == 0, 1).otherwise(0)).otherwise(last(hp) - last(hn))
        return F.struct((s["i"] + 1).alias("i"), hn.bitwiseOR(low.bitwiseOR(hp).bitwiseXOR(F.lit(full))).alias("vp"), low.bitwiseAND(hp).alias("vn"), (s["distance"] + rise).alias("distance"))

    return F.when(n <= edits, True).when(n - m > edits, False).otherwise(F.aggregate(equals, start, step)["distance"] <= edits)


def _wide(line: str) -> Column:
    """``wide``: the line at four bytes a code point, where a part is found by its place; in a string it is found by counting. Made by a generator of one row, so it is made once."""
    return F.explode(F.array(F.encode(line, "UTF-32"))).alias("wide")


def _part(wide: Column, start: Column, n: Column) -> Column:
    """``n`` code points from ``start``."""
    return F.substring(wide, start * 4 + 1, n * 4)


def _halves(start: Column, width: Column) -> list[tuple[Column, Column]]:
    """Both halves of a window; one of a single code point has the places before and after it."""
    low = F.floor(width / 2).cast("int")
    return [(start, low), (start + F.when(width == 1, 1).otherwise(low), F.when(width == 1, 0).otherwise(width - low))]


def _windows(size: Column, indexed: Column, start: Column, width: Column) -> Column:
    """An array: both halves of a window of a line, as an index entry of ``size`` code points or as a probe of lines of that size."""
    return F.array(*(F.struct(indexed.alias("indexed"), size.alias("size"), s.alias("start"), w.alias("width")) for s, w in _halves(start, width)))


def _entries(rows: DataFrame) -> DataFrame:
    """The index entries and probes of ``rows`` (line_id, wide, and a window: indexed, size, start, width): key, indexed, start, width, a, b.

    ``key`` is a hash of the line outside the window, which is a code point wider in a probe. ``a`` and ``b`` are short hashes (they only spare comparisons) of what the window has before and after its middle: linked lines of a
    bucket agree in one of them. A row a window, and not all of a line's in one expression: Java does not compile methods as long as that one's.
    """
    start, width, wide = F.col("start"), F.col("width"), F.col("wide")
    more, low = F.when(F.col("indexed"), 0).otherwise(1), F.floor(width / 2).cast("int")
    key = F.xxhash64("size", start, width, _part(wide, F.lit(0), start), _part(wide, start + width + more, F.col("size") - start - width))
    a, b = F.hash(_part(wide, start, low)), F.hash(_part(wide, start + low + more, width - low))
    return rows.select("line_id", key.alias("key"), "indexed", "start", "width", a.alias("a"), b.alias("b"))


def _met(entries: DataFrame) -> DataFrame:
    """The entries whose bucket holds an index entry and another entry, with the bucket's counts, written."""
    entries = shared.stored(entries, "line-entries")  # read twice
    sizes = entries.groupBy("key").agg(F.count_if("indexed").alias("n_indexed"), F.count("*").alias("n")).where("n_indexed > 0 and n > 1")
    # joined in one way at every size: the buckets grow with the lines
    met = shared.stored(entries.join(sizes.hint("merge"), "key"), "line-buckets")
    shared.release(entries)
    return met


def _candidates(met: DataFrame, where: Column) -> DataFrame:
    """Pairs (x, y) of an index entry and another entry of its bucket that also agree outside half the window."""
    met = met.where(where)
    x = met.where("indexed").select("key", F.col("line_id").alias("x"), F.col("a").alias("xa"), F.col("b").alias("xb"), F.col("width").alias("xw"))
    y = met.select("key", F.col("line_id").alias("y"), "a", "b", "indexed")
    nearer = (F.col("a") == F.col("xa")) | (F.col("b") == F.col("xb")) | (F.col("xw") < 2)
    return x.join(y, "key").where((~F.col("indexed") | (F.col("x") < F.col("y"))) & nearer).select("x", "y")


def line_links(lines: DataFrame, min_chars: int = MIN_CHARS, paired: int = PAIRED) -> DataFrame:
    """Links (x, y) whose components are those of all pairs of ``lines`` (line_id long, line, distinct, chars its code points) at most one edit apart.

    Lines of fewer than ``min_chars`` code points have no links. Buckets of at most ``paired`` lines are
    paired, and pairs that also agree outside one half of the window are verified. In a larger bucket the
    window is halved, round by round, so its lines part into smaller buckets; rows stay in proportion to
    the lines. Lines left in one bucket with a window of one code point are one edit apart, all of them,
    and are linked to the smallest; a window of none holds one index entry. No pair is left out.
    """
    long_enough = lines.where(F.col("chars") >= min_chars).select("line_id", "line", "chars")
    chars, nothing = F.col("chars"), F.lit(0)
    index, probes = _windows(chars, F.lit(True), nothing, chars), _windows(chars - 1, F.lit(False), nothing, chars - 1)
    wide = long_enough.select("line_id", "chars", _wide("line"))
    first = wide.select("line_id", "wide", F.inline(F.when(chars > min_chars, F.concat(index, probes)).otherwise(index)))
    met, found = _met(_entries(first)), []
    single = (F.col("n_indexed") == 1) | (F.col("width") == 0)
    while True:
        found.append(_candidates(met, (F.col("n") <= paired) | single))
        large = met.where((F.col("n") > paired) & ~single)
        if large.isEmpty():
            break
        # a window of one code point: the indexed lines differ in that one alone
        stars = large.where("indexed and width = 1").select("key", "line_id")
        least = stars.groupBy("key").agg(F.min("line_id").alias("x"))
        found.append(stars.join(least, "key").where("line_id > x").select("x", F.col("line_id").alias("y")))
        texts = large.select("line_id", "indexed", "start", "width").distinct().join(long_enough, "line_id")
        size = F.when(F.col("indexed"), chars).otherwise(chars - 1)
        halves = texts.select("*", _wide("line")).select("line_id", "wide", F.inline(_windows(size, F.col("indexed"), F.col("start"), F.col("width"))))
        met = _met(_entries(halves))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    pairs = shared.stored(pairs.distinct(), "line-pairs")
    ids = pairs.select(F.explode(F.array("x", "y")).alias("line_id")).distinct()
    texts = shared.stored(lines.select("line_id", "line").join(ids.hint("merge"), "line_id", "left_semi"), "paired-lines").toDF("x", "x_line")
    both = pairs.join(texts, "x").join(texts.toDF("y", "y_line"), "y")
    # a probing line is one code point longer than an indexed one
    both = without_ends(both, "x_line", "y_line")
    return both.where(within_edits(F.col("y_line"), F.col("x_line"))).select("x", "y")


def wider_links(lines: DataFrame, longer: Sequence[tuple[int, int]], min_chars: int = MIN_CHARS) -> DataFrame:
    """Links (x, y) of all pairs of ``lines`` (as in :func:`line_links`) within the edits that ``longer`` allows.

    ``longer`` has (code points, edits): a pair whose shorter line has so many code points or more may be so many edits
    apart, by the last step it reaches. An indexed line is cut into one segment more than its edits, so one of them
    stands unchanged in a linked line, moved by the edits at most. Lines that are longer by none up to all of the edits
    probe each such place. Whoever meets is verified; no pair is left out, so lines that share a segment cost the
    square of their number.
    """
    line, chars = F.col("line"), F.col("chars")
    allowed = lambda n: reduce(lambda c, step: F.when(n >= step[0], step[1]).otherwise(c), sorted(longer), F.lit(0))
    values = sorted({edits for _, edits in longer})

    def keys(n: Column, edits: Column, probing: bool) -> Column:
        """Hashes of the segments of a line of ``n`` code points, or of the places where they may stand in the longer ``line``."""

        def of(i: Column) -> Column:
            start = F.floor(i * n / (edits + 1)).cast("int")
            width = F.floor((i + 1) * n / (edits + 1)).cast("int") - start
            key = lambda place: F.xxhash64(n, i, F.substring(line, place + 1, width))
            return F.transform(F.sequence(F.greatest(F.lit(0), start - edits), F.least(start + edits, chars - width)), key) if probing else F.array(key(start))

        return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), edits), of)))

    index = lines.where((chars >= min_chars) & (allowed(chars) > 0)).select(F.col("line_id").alias("x"), chars.alias("n"), F.explode(keys(chars, allowed(chars), False)).alias("key"))
    probes = None
    for more in range(values[-1] + 1):
        n = chars - more
        own = lines.where((n >= min_chars) & (allowed(n) >= max(more, 1))).select(F.col("line_id").alias("y"), n.alias("n"), F.lit(more).alias("more"), F.explode(keys(n, allowed(n), True)).alias("key"))
        probes = own if probes is None else probes.unionByName(own)
    pairs = index.join(probes, ["n", "key"]).where((F.col("more") > 0) | (F.col("x") < F.col("y"))).select("x", "y", "n").distinct()
    pairs = shared.stored(pairs.withColumn("edits", allowed(F.col("n"))).drop("n"), "wider-pairs")
    both = pairs.join(lines.select(F.col("line_id").alias("x"), F.col("line").alias("x_line")), "x").join(lines.select(F.col("line_id").alias("y"), F.col("line").alias("y_line")), "y")
    both = without_ends(both, "x_line", "y_line")
    return both.where(reduce(lambda c, k: F.when(F.col("edits") == k, within_edits(F.col("y_line"), F.col("x_line"), k)).otherwise(c), values, F.lit(False))).select("x", "y")


def line_classes(docs: DataFrame, min_chars: int = MIN_CHARS, paired: int = PAIRED, id_col: str = "doc_id", text_col: str = "text", longer: Sequence[tuple[int, int]] = ()) -> tuple[DataFrame, DataFrame]:
    """(places, lines): every non-blank line's place (id, h, pos, and its hashes h1, h2), and every distinct line.

    ``lines``: line, n (places), first (its first place), class_first (the first place of all lines that links
    reach), linked (whether any link does).
    """
    text = shared.text_of(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    places = rows.withColumn("line", F.btrim("line", F.lit(BLANKS))).where("line != ''")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "h", "pos").alias("first")
    lines = places.groupBy("line").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    lines = shared.stored(lines.withColumns({"line_id": F.monotonically_increasing_id(), "chars": F.char_length("line")}), "lines")
    links = line_links(lines, min_chars, paired)
    if longer:
        links = links.unionByName(wider_links(lines, longer, min_chars))
    roots = components(links, "x", "y").withColumnRenamed("node", "line_id")
    linked = shared.stored(lines.select("line_id", "first").join(roots, "line_id"), "linked-lines")
    firsts = linked.groupBy("root").agg(F.min("first").alias("class_first"))
    linked = linked.join(firsts, "root").select("line_id", "class_first")
    classes = lines.join(linked, "line_id", "left").withColumn("linked", F.col("class_first").isNotNull())
    return places, classes.withColumn("class_first", F.coalesce("class_first", "first"))


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, paired: int = PAIRED, id_col: str = "doc_id", text_col: str = "text", longer: Sequence[tuple[int, int]] = ()) -> DataFrame:
    """One row per document: id, text (without the dropped lines), n_lines, n_dropped, n_near.

    Lines lie between line feeds and are compared without white space at their ends; blank ones always stay
    and are not counted. Lines at most one edit apart are linked (those under ``min_chars`` code points to
    equal ones only), and long ones at more edits as ``longer`` says, see :func:`wider_links`. Of all lines that links reach, the one in the smallest id (then hash of the text, then
    place) stays and the others go: ``n_dropped``, of which ``n_near`` differ from the one that stays.

    A null text is empty: no lines. Null ids come last. Rows repeated with the same id and text share one
    fate; those of one id and other text are told apart. A row is returned for every row of ``docs``, an empty table gives an empty
    result, other columns are not read.
    """
    places, lines = line_classes(docs, min_chars, paired, id_col, text_col, longer)
    hashes = (F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(9), "line").alias("h2"))
    again = lines.where("n > 1 or linked").select(*hashes, "class_first", (F.col("first") != F.col("class_first")).alias("near"))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "h", "pos")
    going = places.select("id", "h", "pos", *hashes).join(again, ["h1", "h2"]).where(~place.eqNullSafe(F.col("class_first")))
    dropped = shared.stored(going.groupBy("id", "h").agg(F.collect_set("pos").alias("going"), F.collect_set(F.when(F.col("near"), F.col("pos"))).alias("near")), "dropped-lines")
    text = shared.text_of(text_col)
    rows = docs.select(F.col(id_col).alias("own_id"), text.alias("own_text"), F.xxhash64(text).alias("own_h"))
    rows = rows.join(dropped.hint("merge"), F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_h") == F.col("h")), "left")
    # through a generator of one row: within the lambdas the lines would else be split anew for each of them
    rows = rows.select("*", F.explode(F.array(F.split("own_text", "\n"))).alias("lines"))
    n_lines = F.size(F.filter("lines", lambda line: F.btrim(line, F.lit(BLANKS)) != ""))
    staying = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "going")
    left = F.array_join(F.transform(staying, lambda i: F.get("lines", i)), "\n")
    count = lambda name: F.coalesce(F.size(name), F.lit(0)).cast("long").alias
    return rows.select(F.col("own_id").alias(id_col), F.when(F.col("going").isNull(), F.col("own_text")).otherwise(left).alias("text"), n_lines.cast("long").alias("n_lines"), count("going")("n_dropped"), count("near")("n_near"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, n_near, text_sha256 (of the text that is left)."""
    rows = drop_lines(shared.documents(spark, sf_dir))
    return rows.select("doc_id", "n_lines", "n_dropped", "n_near", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


OP9_SQL = """
WITH RECURSIVE raw AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), places AS (
  SELECT doc_id, pos, line AS own, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM raw
), lines AS (
  SELECT line, min({'doc_id': doc_id, 'pos': pos}) AS first, length(line) AS c FROM places WHERE line <> '' GROUP BY line
), long AS (SELECT *, c // 2 AS h FROM lines WHERE c >= 10),
same AS (
  SELECT x.line AS a, y.line AS b, x.c FROM long x JOIN long y ON x.c = y.c AND left(x.line, x.h) = left(y.line, y.h) AND x.line < y.line
  UNION SELECT x.line, y.line, x.c FROM long x JOIN long y ON x.c = y.c AND substr(x.line, x.h + 1) = substr(y.line, y.h + 1) AND x.line < y.line
), one_more AS (
  SELECT x.line AS a, y.line AS b, x.c FROM long x JOIN long y ON y.c = x.c + 1 AND left(x.line, x.h) = left(y.line, (y.c - 1) // 2)
  UNION SELECT x.line, y.line, x.c FROM long x JOIN long y ON y.c = x.c + 1 AND substr(x.line, x.h + 1) = substr(y.line, (y.c - 1) // 2 + 2)
), links AS (
  SELECT a, b FROM same WHERE len(list_filter(range(1, c + 1), lambda i: substr(a, i, 1) <> substr(b, i, 1))) = 1
  UNION ALL
  SELECT a, b FROM one_more WHERE len(list_filter(range(0, c + 1), lambda i: left(b, i) || substr(b, i + 2) = a)) > 0
), either_way AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM either_way UNION SELECT r.a, e.b FROM reach r JOIN either_way e ON r.b = e.a),
classes AS (
  SELECT l.line, any_value(l.first) AS first, least(any_value(l.first), coalesce(min(o.first), any_value(l.first))) AS class_first
  FROM lines l LEFT JOIN reach r ON r.a = l.line LEFT JOIN lines o ON o.line = r.b GROUP BY l.line
), decided AS (
  SELECT p.doc_id, p.pos, p.own, p.line, p.line <> '' AND {'doc_id': p.doc_id, 'pos': p.pos} <> c.class_first AS goes, c.first <> c.class_first AS near
  FROM places p LEFT JOIN classes c ON c.line = p.line
)
SELECT doc_id, count(*) FILTER (line <> '') AS n_lines, count(*) FILTER (goes) AS n_dropped, count(*) FILTER (goes AND near) AS n_near,
  sha256(coalesce(string_agg(own, chr(10) ORDER BY pos) FILTER (NOT coalesce(goes, false)), '')) AS text_sha256
FROM decided GROUP BY doc_id
"""
