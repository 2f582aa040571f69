"""Operator 5: SimHash near-dedup over pigeonhole blocks."""

from __future__ import annotations

from itertools import combinations
from math import acos, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import shared
from tracelake.llm.components import components

SEED = 42
#: A block bucket of more fingerprints is searched through one-bit neighbours instead of pairs.
PAIRED = 32


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included: A-Z lowered, words between space and the controls 9-13; fewer words than ``width`` are one shingle, none give none."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, width = b" ".join(words), min(width, len(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - width + 1].tolist()
    hashed = xxhash.xxh64_intdigest
    return np.array([hashed(joined[s:e], SEED) for s, e in zip(starts, (ends[width - 1 :] - 1).tolist())], np.uint64)


def bit_majority(hashes: np.ndarray) -> np.ndarray:
    """The bits set in over half of the rows of ``hashes`` (n x words), as words."""
    n, words = hashes.shape
    counts = np.zeros(64 * words, np.int64)
    for k in range(0, n, 255):  # as many rows as a byte can count
        bits = np.unpackbits(hashes[k : k + 255].view(np.uint8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > n, bitorder="little").view(np.uint64)


def widened(hashes: np.ndarray, words: int) -> np.ndarray:
    """``words`` independent 64-bit hashes of each hash (the SplitMix64 finaliser over a Weyl sequence)."""
    x = hashes[:, None] + np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, width: int, words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp array<long>): ``words`` 64-bit words a document. One word is the majority of the shingle hashes themselves, more are of hashes derived from them."""

    def run(batches):
        for batch in shared.slices(batches):
            out = []
            for text in batch.column(1).to_pylist():
                h = shingle_hashes(text, width)
                out.append((bit_majority(h[:, None] if words == 1 else widened(h, words)) if len(h) else np.zeros(words, np.uint64)).view(np.int64))
            values = pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * words, pa.int32()), values), batch.column(2)], ["id", "fp", "h"])

    rows = docs.select(F.col(id_col).alias("id"), shared.text_of(text_col).alias("text"), F.xxhash64(shared.text_of(text_col)).alias("h"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp array<long>, h long")


def _blocks(blocks: int, shared_blocks: int) -> list[tuple[int, list[int]]]:
    """Masks of every choice of ``shared_blocks`` among ``blocks`` even parts of 64 bits, and the bits outside each."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    parts = [range(edges[k], edges[k + 1]) for k in range(blocks)]
    out = []
    for chosen in combinations(range(blocks), shared_blocks):
        mask = sum(1 << bit for k in chosen for bit in parts[k])
        out.append((mask - (1 << 64) if mask >> 63 else mask, [bit for k in range(blocks) if k not in chosen for bit in parts[k]]))
    return out


def fingerprint_links(prints: DataFrame, distance: int = 2, paired: int = PAIRED) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``prints``' distinct ``fp`` (long) at most ``distance`` (1 or 2) bits apart.

    64 bits are cut into distance + 2 blocks: a close pair agrees in at least two, so fingerprints meet in
    the bucket of each two blocks. In buckets of at most ``paired``, pairs are compared. Larger ones are
    not paired: each member goes to every value one flipped bit away, outside the blocks, and to itself;
    fingerprints two bits apart share such a value, and all that share one are at most two apart, so each
    is linked to the smallest there (for a distance of 1: to each value with one bit taken out). That gives the same components with rows in proportion to the bucket.
    """
    if distance not in (1, 2):
        raise ValueError("distance must be 1 or 2")
    choices = _blocks(distance + 2, 2)
    rows = prints.select("fp").distinct().select("fp", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("block")) for k, (m, _) in enumerate(choices)))).alias("e")).select("fp", "e.k", "e.block")
    sizes = rows.groupBy("k", "block").agg(F.count("*").alias("n")).where("n > 1")
    met = shared.stored(rows.join(sizes, ["k", "block"]), "blocks")
    few = met.where(F.col("n") <= paired)
    a, b = few.select("k", "block", F.col("fp").alias("a")), few.select("k", "block", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    pairs = a.join(b, ["k", "block"]).where((F.col("a") < F.col("b")) & near).select("a", "b")
    flip = lambda bit: F.lit((1 << bit) - (1 << 64) if bit == 63 else 1 << bit)
    flips = F.array(*(F.array(*([F.lit(0).cast("long")] if distance == 2 else []), *map(flip, outside)) for _, outside in choices))
    stars = met.where(F.col("n") > paired).select("fp", F.explode(F.element_at(flips, F.col("k") + 1)).alias("flip"))
    if distance == 2:
        stars = stars.select("fp", F.lit(0).cast("long").alias("flip"), F.col("fp").bitwiseXOR(F.col("flip")).alias("value")).distinct()
    else:  # with one bit taken out
        stars = stars.select("fp", "flip", F.col("fp").bitwiseAND(F.bitwise_not("flip")).alias("value")).distinct()
    least = stars.groupBy("flip", "value").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= distance
    starred = stars.join(least, ["flip", "value"]).where((F.col("fp") != F.col("a")) & close).select("a", F.col("fp").alias("b"))
    return pairs.unionByName(starred).distinct()


def simhash_groups(docs: DataFrame, width: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text", paired: int = PAIRED) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (smallest id reachable, its own included).

    Documents whose fingerprints differ in at most ``distance`` bits are linked; equal fingerprints are one
    class, so copies are never paired. A null or wordless text has fingerprint zero and is linked like any
    other. Null ids are passed over in component_id (null if a component has no other); repeated rows each
    give a row; an empty table gives an empty result; other columns are not read.
    """
    prints = shared.stored(fingerprints(docs, width, 1, id_col, text_col).select("id", F.col("fp")[0].alias("fp")), "fingerprints")
    roots = components(fingerprint_links(prints, distance, paired))
    least = prints.groupBy("fp").agg(F.min("id").alias("least"))
    classes = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    classes = shared.stored(classes, "classes")
    named = classes.join(classes.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def similarity_bits(similarity: float, bits: int, sigmas: float = 1.0) -> int:
    """Bits that differ between fingerprints of ``bits`` bits at this Jaccard similarity, and ``sigmas`` standard deviations more."""
    share = acos(2 * similarity / (1 + similarity)) / pi
    return round(bits * share + sigmas * sqrt(bits * share * (1 - share)))


def distinct_shingles(text: str, width: int) -> np.ndarray:
    """The sorted distinct :func:`shingle_hashes` of a text."""
    return np.unique(shingle_hashes(text, width))


def minhashes(hashes: np.ndarray, count: int) -> np.ndarray:
    """The smallest of ``hashes`` under each of ``count`` fixed random orders of 32 bits; all bits set for no hashes."""
    random = np.random.default_rng(SEED)
    flips, factors = random.integers(0, 1 << 32, (2, count, 1), np.uint32)
    low, least = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32), np.full(count, (1 << 32) - 1, np.uint32)
    for k in range(0, len(low), 128):  # a table that stays in the processor's cache
        np.minimum(least, ((low[k : k + 128] ^ flips) * (factors | np.uint32(1))).min(axis=1), out=least)
    return least


def bands_of(least: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit hash of each of ``bands`` even runs of min-hashes and its number; ``least`` is documents x min-hashes."""
    runs = least.reshape(len(least), bands, -1)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), runs.shape[:2])
    for k in range(runs.shape[2]):
        out = (out ^ runs[:, :, k]) * np.uint64(0xBF58476D1CE4E5B9)
        out = out ^ (out >> np.uint64(29))
    return out.view(np.int64)


def banded(docs: DataFrame, width: int, bands: int, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, k1, k2, n, fp, bands array<long>): text hash, 128-bit hash and size of the set of distinct shingles, the set's SimHash fingerprint (zero without a shingle), and its bands."""

    def run(batches):
        for batch in shared.slices(batches):
            keys, sizes, least, prints = [], [], [], []
            for text in batch.column(1).to_pylist():
                found = distinct_shingles(text, width)
                prints.append(bit_majority(found[:, None])[0] if len(found) else 0)
                keys.append(np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64))
                sizes.append(len(found))
                least.append(minhashes(found, bands * rows))
            if keys:
                k1, k2 = np.array(keys).T
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * bands, pa.int32()), pa.array(bands_of(np.array(least), bands).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(k1), pa.array(k2), pa.array(sizes, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)), values], ["id", "h", "k1", "k2", "n", "fp", "bands"])

    text = shared.text_of(text_col)
    rows_ = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))
    return rows_.mapInArrow(run, f"id {rows_.schema['id'].dataType.simpleString()}, h long, k1 long, k2 long, n long, fp long, bands array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(r, set array<long>): the distinct shingles of the texts in ``wanted`` (r, id, h)."""

    def run(batches):
        for batch in shared.slices(batches):
            found = [distinct_shingles(text, width).view(np.int64) for text in batch.column(1).to_pylist()]
            if found:
                ends = np.cumsum([0, *map(len, found)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found)))], ["r", "set"])

    text = shared.text_of(text_col)
    held = docs.select(F.col(id_col).alias("own_id"), text.alias("text"), F.xxhash64(text).alias("own_h")).join(wanted, (F.col("own_h") == F.col("h")) & F.col("own_id").eqNullSafe(F.col("id")))
    # the same id and text may stand in several rows
    return held.select("r", "text").mapInArrow(run, "r long, set array<long>").dropDuplicates(["r"])


def verified(pairs: DataFrame, sets: DataFrame, a: str, b: str, similarity: float) -> DataFrame:
    """The ``pairs`` of columns ``a`` and ``b`` whose sets have this Jaccard similarity or more, by counting what they share."""
    both = pairs.join(sets.toDF(a, "a_set"), a).join(sets.toDF(b, "b_set"), b)
    both = both.select(a, b, F.size("a_set").alias("na"), F.size("b_set").alias("nb"), F.explode(F.array(F.size(F.array_intersect("a_set", "b_set")))).alias("both"))
    return both.where(F.col("both") / (F.col("na") + F.col("nb") - F.col("both")) >= similarity).select(a, b)


def simhash_pairs(prints: DataFrame, distance: int = 2, paired: int = PAIRED) -> DataFrame:
    """(r, lead), lead < r: what SimHash joins of ``prints`` (r, fp): sets of one fingerprint with the first of them, and the first ones of :func:`fingerprint_links`, by pigeonhole blocks."""
    firsts = shared.stored(prints.groupBy("fp").agg(F.min("r").alias("first")), "fingerprints")
    same = prints.join(firsts, "fp").where("r > first").select("r", F.col("first").alias("lead"))
    a, b = firsts.toDF("a", "first_a"), firsts.toDF("b", "first_b")
    close = fingerprint_links(firsts, distance, paired).join(a, "a").join(b, "b")
    return shared.stored(same.unionByName(close.select(F.greatest("first_a", "first_b").alias("r"), F.least("first_a", "first_b").alias("lead"))), "simhash-pairs")


def first_links(alive: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(r, lead): each member compared with one other, the first of a bucket that it meets in most buckets. Rows in proportion to ``alive``."""
    leads = alive.groupBy("bucket").agg(F.min(F.struct("r", "n")).alias("lead"))
    met = alive.join(leads, "bucket").where(F.col("lead.r") < F.col("r")).where(F.least("n", "lead.n") / F.greatest("n", "lead.n") >= similarity)
    counted = met.groupBy("r", F.col("lead.r").alias("lead")).agg(F.count("*").alias("k"))
    best = counted.groupBy("r").agg(F.max_by("lead", F.struct("k", -F.col("lead"))).alias("lead"))
    return shared.stored(verified(best, sets, "r", "lead", similarity), "similar")


#: Shingles that the sets of one block's comparisons hold at a time.
_SETS = 500_000


def _compared(similarity: float, least_bands: int):
    """What compares the members of one block, see :func:`block_links`: a table of them to one of links (r, lead)."""

    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        column = lambda name: block.column(name).chunk(0).to_numpy(zero_copy_only=False)
        r, root, n, side, band = (column(c) for c in ("r", "root", "n", "side", "band"))
        both_sides = bool(column("within")[0])
        bands = block.column("bands").chunk(0).flatten().to_numpy().reshape(len(r), -1).view(np.int32)[:, ::2]
        held = block.column("set").chunk(0)
        ends, values = held.offsets.to_numpy(), held.values.to_numpy()
        near = []
        for i in range(len(r) - 1):
            may = (root[i + 1 :] != root[i]) & (np.minimum(n[i + 1 :], n[i]) >= similarity * np.maximum(n[i + 1 :], n[i]))
            if not both_sides:
                may &= side[i + 1 :] != side[i]
            at = np.flatnonzero(may) + i + 1
            if len(at):
                agree = bands[at] == bands[i]
                shared_bands = agree.sum(axis=1)
                good = (shared_bands >= least_bands) & ~agree[:, : band[0]].any(axis=1)  # a pair is compared where it meets first
                near += zip((-shared_bands[good]).tolist(), [i] * int(good.sum()), at[good].tolist())
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        sets: dict[int, set] = {}
        room = _SETS

        def of(k: int) -> set:
            nonlocal room
            if k not in sets:
                if room < 0:
                    sets.clear()
                    room = _SETS
                room -= ends[k + 1] - ends[k]
                sets[k] = set(values[ends[k] : ends[k + 1]].tolist())
            return sets[k]

        links = []
        for _, i, j in sorted(near):
            x, y = top(int(root[i])), top(int(root[j]))
            if x != y and (both := len(of(i) & of(j))) >= similarity * (n[i] + n[j] - both):
                parent[x] = y
                links.append((max(r[i], r[j]), min(r[i], r[j])))
        return pa.table({"r": pa.array([x for x, _ in links], pa.int64()), "lead": pa.array([y for _, y in links], pa.int64())})

    return run


def block_links(alive: DataFrame, roots: DataFrame, features: DataFrame, similarity: float, least_bands: int, block: int) -> DataFrame:
    """(r, lead): links of this similarity or more, as many as join up all members of ``alive`` (bucket, band, r, n) that are alike but not of one root yet.

    Buckets of one root are done, and any other of up to ``block`` shingles (a member counts 500 more) is one block. In a
    larger one the members of its first member's root and the rest are cut by hash into
    chunks of that size, and every chunk meets the chunks of the rest, each two in a
    block of their own. A block holds its members' sets, skips pairs of one root, and gives no more links than join its members; so
    no pair that is not alike ever becomes a row, and what is not alike costs the square of its number, not of the group's.
    """
    rooted = alive.join(roots, "r", "left").withColumn("root", F.coalesce("root", "r"))
    mixed = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min_by("root", "r").alias("lead_root")).where("low < high").select("bucket", "lead_root")
    rows = shared.stored(rooted.join(mixed, "bucket").withColumn("rest", F.col("root") != F.col("lead_root")).drop("lead_root"), "mixed-buckets")
    weight = F.col("n") + F.lit(500)
    size = lambda rest: F.ceil(F.sum(F.when(F.col("rest") == rest, weight)) / block).cast("int")
    sizes = rows.groupBy("bucket").agg(size(False).alias("firsts"), size(True).alias("rests"), (F.sum(weight) <= block).alias("small"))
    rows = rows.join(sizes, "bucket").withColumn("chunk", F.pmod(F.xxhash64("r"), F.when(F.col("rest"), F.col("rests")).otherwise(F.col("firsts"))).cast("int"))
    pair = lambda within, i, j, side: F.struct(within.alias("within"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    no, chunk = F.lit(False), F.col("chunk")
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    first = F.transform(upto("rests"), lambda j: pair(no, -1 - chunk, j, F.lit(0)))
    rest = F.concat(F.transform(upto("firsts"), lambda i: pair(no, -1 - i, chunk, F.lit(1))), F.transform(upto("rests"), lambda k: pair(k == chunk, F.least(k, chunk), F.greatest(k, chunk), chunk < k)))
    placed = rows.select("bucket", "band", "r", "n", "root", F.explode(F.when(F.col("small"), F.array(pair(F.lit(True), F.lit(0), F.lit(0), F.lit(0)))).when(F.col("rest"), rest).otherwise(first)).alias("p")).select("bucket", "band", "r", "n", "root", "p.*")
    members = placed.join(features, "r")
    return members.groupBy("bucket", "i", "j").applyInArrow(_compared(similarity, least_bands), "r long, lead long")


def near_links(alive: DataFrame, features: DataFrame, similarity: float, least_bands: int, block: int = 1 << 21, pairs: DataFrame | None = None) -> DataFrame:
    """(r, root) of the components of the pairs of ``alive`` (bucket, band, r, n) that share ``least_bands`` buckets and have this similarity or more, and of those of ``pairs`` (r, lead) that have it.

    ``pairs`` are compared first, and buckets whose members they join are done. In the others a first comparison for every member joins
    most copies; :func:`block_links` finds what joins the rest. ``features``: r, bands, set.
    """
    sets, found = features.select("r", "set"), None
    if pairs is not None:
        found = shared.stored(verified(pairs, sets, "r", "lead", similarity), "similar")
        roots = components(found, "r", "lead").select(F.col("node").alias("r"), "root")
        rooted = alive.join(roots, "r", "left").withColumn("root", F.coalesce("root", "r"))
        mixed = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bucket")
        alive = shared.stored(alive.join(mixed, "bucket", "left_semi"), "buckets")
    firsts = first_links(alive, sets, similarity)
    found = firsts if found is None else found.unionByName(firsts)
    roots = components(found, "r", "lead").select(F.col("node").alias("r"), "root")
    more = shared.stored(block_links(alive, roots, features, similarity, least_bands, block), "similar")
    return components(found.unionByName(more), "r", "lead").select(F.col("node").alias("r"), "root")


def near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8, bands: int = 60, rows: int = 6, least_bands: int = 3, block: int = 1 << 21, distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, stay): stay = true for the smallest document (id and the hash h of its text) of each group that links reach.

    Documents meet by SimHash first: the sets' 64-bit fingerprints, at most ``distance`` bits apart by pigeonhole blocks, as in
    :func:`simhash_groups`. At 0.8 some ten bits of 64 differ, beyond what blocks can find, so for the similar pairs that fingerprints do
    not join, documents also meet when ``rows`` min-hashes agree in ``least_bands`` of ``bands`` bands: at a similarity of 0.8 a pair agrees in
    fewer than three with a probability of three in a million, and less above. Whoever meets either way is compared by
    the exact Jaccard similarity of the sets of distinct shingles (64-bit hashes), so no pair below ``similarity`` is
    linked. Groups are the components of the links, so of a chain of versions one document stays.

    A null text is empty; texts without a shingle are alike and one group. Ids may be null (they come last) or repeat; rows repeated
    with the same id and text each give a row and share one fate. Other columns are not read, an empty table gives no rows.
    """
    raw = shared.stored(banded(docs, width, bands, rows, id_col, text_col), "bands")
    # equal sets: one representative; row numbers in id order, nulls last
    best = raw.groupBy("k1", "k2").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h", "n", "fp", "bands")).alias("best"))
    distinct = best.select("k1", "k2", "best.*").repartitionByRange("none", "id", "h").sortWithinPartitions("none", "id", "h").select("id", "h", "k1", "k2", "n", "fp", "bands", F.monotonically_increasing_id().alias("r"))
    distinct = shared.stored(distinct, "distinct-sets")
    every = distinct.select("r", "n", F.posexplode("bands").alias("band", "bucket"))
    sizes = every.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").drop("size")
    alive = shared.stored(every.join(sizes, "bucket"), "buckets")
    pairs = simhash_pairs(distinct.select("r", "fp"), distance)
    met = alive.select("r").unionByName(pairs.select("r")).unionByName(pairs.select(F.col("lead").alias("r"))).distinct()
    wanted = distinct.join(met, "r", "left_semi").select("r", "id", "h")
    sets = shingle_sets(docs, wanted, width, id_col, text_col)
    features = shared.stored(sets.join(distinct.select("r", "bands"), "r"), "shingle-sets")
    going = near_links(alive, features, similarity, least_bands, block, pairs).where("r > root").select("r")
    left = distinct.select("k1", "k2", "r", F.col("id").alias("keep"), F.col("h").alias("keep_h")).join(going, "r", "left_anti")
    stay = F.col("keep_h").isNotNull() & F.col("keep").eqNullSafe(F.col("id")) & (F.col("keep_h") == F.col("h"))
    return raw.select("id", "h", "k1", "k2").join(left.drop("r"), ["k1", "k2"], "left").select("id", "h", F.coalesce(stay, F.lit(False)).alias("stay"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that :func:`near_copies` lets go, all columns as they were, whatever their names.

    Null ids and texts, repeated rows and empty tables as there; rows repeated with the same id and text share one fate.
    """
    going = shared.stored(near_copies(docs, id_col=id_col, text_col=text_col, **options).where("not stay").select("id", "h").distinct(), "near-copies")
    held = docs.select(F.struct("*").alias("held"), F.col(id_col).alias("hid"), F.xxhash64(shared.text_of(text_col)).alias("hh"))
    return held.join(going, F.col("hid").eqNullSafe(F.col("id")) & (F.col("hh") == F.col("h")), "left_anti").select("held.*")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(shared.documents(spark, sf_dir))
