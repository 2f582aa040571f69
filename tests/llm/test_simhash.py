import random
import re

import xxhash

from tracelake.llm.components import components
from tracelake.llm.simhash import drop_near_copies, fingerprint_links, near_links, simhash_groups, similarity_bits

SCHEMA = "doc_id long, text string, fp string, id long"


def fingerprint(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values, distance):
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    values = sorted(values)
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= distance:
                parent[find(a)] = find(b)
    return {v: find(v) for v in values}


def test_fingerprints_and_groups(spark):
    random.seed(3)
    words = ["w%d" % k for k in range(400)]
    rows = []
    for base in range(12):
        text = [random.choice(words) for _ in range(300)]
        for _ in range(6):
            copy = list(text)
            for _ in range(random.randint(0, 2)):
                copy[random.randrange(300)] = random.choice(words)
            rows.append((len(rows) * 3 + 1, " ".join(copy), "x", 1))
    rows += [(900, None, "x", 1), (901, " \t", "x", 1), (902, "ONE", "x", 1), (903, "one", "x", 1), (903, "one", "x", 1), (904, "one two", "x", 1), (None, "Two Ümläut ÄÖ x", "", 1), (905, "a b c\x0bd e", "", 1), (906, "many " * 20_000, "", 2)]
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    prints = [(r[0], fingerprint(r[1])) for r in rows]
    root = roots({f for _, f in prints}, 2)
    least = {}
    for key, f in prints:
        if key is not None:
            least[root[f]] = min(key, least.get(root[f], key))
    assert got == {(key, f"{f:016x}"): least.get(root[f]) for key, f in prints}


def test_hot_buckets_lose_no_link(spark):
    random.seed(5)
    values = set()
    for _ in range(6):
        seed = random.getrandbits(64)
        for _ in range(120):
            v = seed
            for _ in range(random.randint(0, 5)):
                v ^= 1 << random.randrange(64)
            values.add(v)
    values |= {random.getrandbits(64) for _ in range(300)} | {0, 1, (1 << 64) - 1, 1 << 63}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    for distance in (1, 2):
        expected = roots(values, distance)
        for paired in (0, 4, 1000):
            found = {r.node & (1 << 64) - 1: r.root for r in components(fingerprint_links(df, distance, paired)).collect()}
            groups = {}
            for v in values:
                groups.setdefault(found.get(v, v), set()).add(expected[v])
            assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(expected.values()))


def test_components_of_a_chain(spark):
    n = 200
    df = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(1000, 1001), (5, 5), (None, 3)], "a long, b long")
    assert {r.node: r.root for r in components(df).collect()} == {k: 0 for k in range(n + 1)} | {1000: 1000, 1001: 1000}
    assert components(df.limit(0)).count() == 0


def test_near_copies_go(spark):
    random.seed(7)
    words = ["w%d" % k for k in range(2000)]
    rows, groups = [], []
    for base in range(15):
        text = [random.choice(words) for _ in range(400)]
        group = []
        for k in range(8):
            copy = list(text)
            for _ in range(4 if k else 0):  # about 0.9
                copy[random.randrange(400)] = random.choice(words)
            group.append(len(rows))
            rows.append((len(rows), " ".join(copy), "fp", 9))
        groups.append(group)
    clean = [(1000 + k, " ".join(random.choice(words) for _ in range(200)), "c", 1) for k in range(60)]
    extra = [(None, "null id here", "c", 1), (2000, None, None, None), (2001, "", None, None), (2002, "same text", "a", 1), (2002, "same text", "a", 1)]
    df = spark.createDataFrame(rows + clean + extra, SCHEMA)
    got = drop_near_copies(df)
    assert got.columns == df.columns
    stay = [r.doc_id for r in got.collect()]
    assert {g[0] for g in groups} <= set(stay)
    assert sum(k in stay for g in groups for k in g[1:]) <= 2
    assert {r[0] for r in clean} <= set(stay) and None in stay
    assert 2000 in stay and 2001 not in stay and stay.count(2002) == 2
    assert drop_near_copies(df.limit(0)).count() == 0
    assert 150 < similarity_bits(0.8, 1280, 0) * 1024 // 1280 < 160


def shingles(text, width=5):
    words = text.split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_near_copies_at_the_threshold(spark):
    random.seed(11)
    rows, expected = [], {}
    while len(rows) < 240:
        text = ["w%d" % random.randrange(5000) for _ in range(random.randint(60, 300))]
        copy = list(text)
        for _ in range(max(1, len(text) // 48 + random.randint(-1, 1))):
            copy[random.randrange(len(copy))] = "x%d" % random.randrange(5000)
        found = jaccard(shingles(" ".join(text)), shingles(" ".join(copy)))
        if 0.8 <= found <= 0.85 and len(rows) < 160 or 0.75 <= found < 0.8 and len(rows) >= 160:
            expected[len(rows) + 1] = found < 0.8
            rows += [(len(rows), " ".join(text), "", 0), (len(rows) + 1, " ".join(copy), "", 0)]
    stay = {r.doc_id for r in drop_near_copies(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {k: k in stay for k in expected} == expected and set(range(0, 240, 2)) <= stay


def test_near_copies_leave_one_of_a_chain(spark):
    random.seed(13)
    rows = []
    for chain in range(6):
        text = ["w%d" % random.randrange(9000) for _ in range(200)]
        for version in range(7):  # each like the one before, the ends are not alike
            rows.append((random.randrange(10**9), " ".join(text), "", chain))
            for k in (3, 100):
                at = 12 * version + k
                text[at : at + 4] = ["w%d" % random.randrange(9000) for _ in range(4)]
    sets = {r[0]: shingles(r[1]) for r in rows}
    root = {k: k for k in sets}
    for _ in sets:  # the smallest id that links reach
        for a in sets:
            for b in sets:
                if jaccard(sets[a], sets[b]) >= 0.8:
                    root[a] = min(root[a], root[b])
    assert len(set(root.values())) == 6 and any(jaccard(sets[k], sets[v]) < 0.7 for k, v in root.items())
    stay = [r.doc_id for r in drop_near_copies(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(stay) == sorted(set(root.values()))


def test_near_copies_of_a_large_loose_group(spark):
    """One group whose members are mostly not alike in pairs, in one block and in many, against brute force."""
    random.seed(17)
    base = ["w%d" % k for k in range(120)]
    rows = []
    for k in range(150):
        text = list(base)
        for _ in range(random.choice([1, 2, 3, 5, 8])):
            text[random.randrange(120)] = "x%d" % random.randrange(10**6)
        rows.append((random.randrange(10**9), " ".join(text), "", k))
    sets = {r[0]: shingles(r[1]) for r in rows}
    root = {k: k for k in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.8]
    for _ in sets:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert 20 < len(set(root.values())) < 130
    for block in (1 << 21, 5000):
        stay = [r.doc_id for r in drop_near_copies(spark.createDataFrame(rows, SCHEMA), block=block).collect()]
        assert sorted(stay) == sorted(set(root.values())), block


def test_near_copies_by_simhash_blocks(spark):
    """One band of 2,000 min-hashes, in which no two different texts meet: what goes was found by SimHash, and is alike."""
    random.seed(19)
    rows = []
    for base in range(25):
        text = ["w%d" % random.randrange(9000) for _ in range(400)]
        for k in range(4):
            copy = list(text)
            if k:
                copy[random.randrange(400)] = "x%d" % k
            rows.append((random.randrange(10**9), " ".join(copy), "", base))
    rows += [(None, None, "", 0), (5, " ", "", 0), (6, "lone", "", 0)]
    sets = {r[0]: shingles(r[1] or "") for r in rows}
    prints = {}
    for r, found in sets.items():
        hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in found if s]
        prints[r] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    order = sorted(sets, key=lambda k: (k is None, k or 0))
    root = {k: k for k in sets}
    for _ in range(4):
        for i, a in enumerate(order):
            for b in order[i + 1 :]:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and jaccard(sets[a], sets[b]) >= 0.8:
                    root[a] = root[b] = min(root[a], root[b], key=order.index)
    assert len(set(root.values())) < len(root) - 25
    stay = [r.doc_id for r in drop_near_copies(spark.createDataFrame(rows, SCHEMA), bands=1, rows=2000).collect()]
    assert sorted(map(str, stay)) == sorted(map(str, set(root.values())))


def test_fingerprints_alone_link_nothing(spark):
    """Pairs that SimHash brings are compared too."""
    features = spark.createDataFrame([(1, [0], [1, 2, 3, 4, 5]), (2, [0], [1, 2, 3, 4]), (3, [0], [1, 2, 3, 9])], "r long, bands array<long>, set array<long>")
    nobody = spark.createDataFrame([], "bucket long, band int, r long, n long")
    pairs = spark.createDataFrame([(2, 1), (3, 1)], "r long, lead long")
    assert {(x.r, x.root) for x in near_links(nobody, features, 0.8, 3, pairs=pairs).collect()} == {(1, 1), (2, 1)}
