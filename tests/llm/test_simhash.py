import random

import numpy as np
import xxhash

from featherlens.llm import simhash
from featherlens.llm.components import components


def brute_fp(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    """fps: list of (doc_id, fp); smallest id reachable."""
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 4:
                parent[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(fps):
        groups.setdefault(find(i), []).append(d)
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(fps))]


def test_golay_keys_meet():
    g, rng = simhash.Golay(), random.Random(1)
    for bits in (21, 22):
        a = np.array([rng.getrandbits(bits) for _ in range(400)])
        e = np.array([(1 << rng.randrange(bits)) | (1 << rng.randrange(bits)) for _ in range(400)])
        (ka, ra), (kb, rb) = g.keys(a, bits), g.keys(a ^ e, bits)
        for i in range(400):
            assert set(ka[i][ra[i]]) & set(kb[i][rb[i]])


def test_join_keys_meet_within_four_bits():
    g, rng = simhash.Golay(), random.Random(2)
    for d in range(5):
        for _ in range(60):
            x = rng.getrandbits(64)
            y = x
            for b in rng.sample(range(64), d):
                y ^= 1 << b
            arr = np.array([x, y], np.uint64).view(np.int64)
            ia, ka = simhash.join_keys(arr[:1], g, True)
            ib, kb = simhash.join_keys(arr[1:], g, False)
            assert set(ka.tolist()) & set(kb.tolist())


def test_components_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "u long, v long")
    got = {r.node: r.root for r in components(links).collect()}
    assert len({got[i] for i in range(61)}) == 1 and got[100] == got[101] != got[0] and len(got) == 63


def test_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(120)] for _ in range(25)]
    texts = [" ".join(b) for b in base]
    for b in base:
        for _ in range(4):
            c = list(b)
            for _ in range(rng.randrange(4)):
                c[rng.randrange(len(c))] = rng.choice(words)
            texts.append(" ".join(c))
    texts += [None, "", " \t\n", "One", "one", "A b\x0bc", "é É x y z", "long " * 30000]
    rows = list(enumerate(texts)) + [(None, texts[0]), (3, texts[3]), (None, "lonely words here now ok")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, component_id int, fp string")
    got = sorted(simhash.near_duplicates(df).collect(), key=str)
    fps = [(d, brute_fp(t)) for d, t in rows]
    want = [(d, f"{f:016x}", c) for (d, f), c in zip(fps, brute_components(fps), strict=True)]
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == sorted(want, key=str)
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == sorted({c for _, _, c in want if c is not None})


def near_family(rng, n, bits):
    base, out = rng.getrandbits(64), set()
    while len(out) < n:
        x = base
        for b in rng.sample(range(64), bits):
            x ^= 1 << b
        out.add(x - (1 << 64) if x >> 63 else x)
    return sorted(out)


def test_members_of_one_component_never_meet(spark):
    """2000 near copies are linked through pivots; the main join then compares none of their pairs."""
    rng = random.Random(9)
    family = near_family(rng, 2000, 2)
    nodes = spark.createDataFrame([(x, family[0]) for x in family], "fp long, comp long")
    assert simhash.meetings(nodes).count() == 0
    roots = simhash.fingerprint_components(spark.createDataFrame([(x,) for x in family], "fp long")).collect()
    assert len(roots) == 2000 and len({r.root for r in roots}) == 1


def test_meetings_under_hot_keys(spark, monkeypatch):
    """Two large components under common keys meet in all their pairs and only those, however the keys are joined."""
    rng = random.Random(10)
    family = near_family(rng, 120, 2)
    nodes = spark.createDataFrame([(x, i % 2) for i, x in enumerate(family)], "fp long, comp long").cache()
    pairs = lambda: {(r.fa, r.fb) for r in simhash.meetings(nodes).collect() if ((r.fa ^ r.fb) & (2**64 - 1)).bit_count() <= 4}
    plain = pairs()
    assert plain and simhash.meetings(nodes).filter("ca = cb").count() == 0
    monkeypatch.setattr(simhash, "MANY", 0)
    monkeypatch.setattr(simhash, "MAX_BROADCAST_KEYS", 0)
    assert pairs() == plain
    every = {frozenset((x, y)) for i, x in enumerate(family) for j, y in enumerate(family) if i % 2 != j % 2 and ((x ^ y) & (2**64 - 1)).bit_count() <= 4}
    assert {frozenset(p) for p in plain} == every


def test_ties_go_by_all_columns(spark):
    rows = [(1, "same text here", c, c) for c in "cab"] + [(1, "same text here", "a", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __row string, root string")
    got = {tuple(r) for n in (1, 4) for r in simhash.drop_near_duplicates(df.repartition(n, "__row")).collect()}
    assert len(got) == 1 and simhash.drop_near_duplicates(df).columns == df.columns


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_dropping_goes_by_component_not_by_id(spark):
    """Repeated ids with unlike texts stay; near copies without any id leave one."""
    words = [f"w{i}" for i in range(400)]
    near = [" ".join(words), " ".join([*words, "tail"])]
    assert 0 < bin((simhash.fingerprint(near[0].encode()) ^ simhash.fingerprint(near[1].encode())) & (2**64 - 1)).count("1") <= simhash.MAX_BITS
    docs = [(1, "one quite short text about apples"), (1, "another thing altogether on rivers and boats"), (None, near[0]), (None, near[1])]
    got = simhash.drop_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert [r.text for r in got if r.doc_id is None][0] in near and len(got) == 3
    assert {r.text for r in got if r.doc_id == 1} == {t for d, t in docs if d == 1}
