import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from featherlens.llm import jaccard


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def plain(docs):
    sets = [shingles(t) for _, t in docs]
    comp = list(range(len(docs)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 90 * len(a | b):
                comp = [comp[j] if c == comp[i] else c for c in comp]
    least = {}
    for (d, _), c in zip(docs, comp, strict=True):
        least[c] = min((x for x in (d, least.get(c)) if x is not None), default=None)
    return sorted(((d, len(s), least[c]) for (d, _), s, c in zip(docs, sets, comp, strict=True)), key=repr)


def ours(spark, docs):
    df = spark.createDataFrame([(*x, 1, "y", 2) for x in docs], "doc_id long, text string, n int, digest string, cls int")
    rows = jaccard.jaccard_components(df)
    assert rows.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted((tuple(r) for r in rows.collect()), key=repr)


def family(rng, vocabulary, words, copies, changes):
    base = [rng.choice(vocabulary) for _ in range(words)]
    out = []
    for _ in range(copies):
        mine = list(base)
        for _ in range(rng.randint(0, changes)):
            mine[rng.randrange(words)] = rng.choice(vocabulary)
        out.append(" ".join(mine))
    return out


def corpus(seed=1):
    rng = random.Random(seed)
    many, few = [f"w{i}" for i in range(3000)], ["a", "B", "c", "D"]
    texts = [x for n in (4, 11, 12, 40, 120) for x in family(rng, many, n, 12, 3)]
    texts += family(rng, many, 300, 60, 12) + [x for _ in range(40) for x in family(rng, few, rng.randint(1, 9), 3, 1)]
    texts += [" ".join(many[i : i + n]) for n in (18, 19, 20, 21, 22) for i in (0, 1, 2)]
    shared = " ".join(many[:50])
    texts += [shared + " " + x for _ in range(30) for x in family(rng, many, 60, 1, 0)]
    texts += [None, "", " \t\n", "one", "ONE", "one two", "two one", "Ünï ÜNÏ x", "ünï ünï x", *texts[:20]]
    docs = [(i * 7 % 1000 - 20, t) for i, t in enumerate(texts)]
    return docs + [(None, texts[0]), (None, "alone without id"), docs[5], docs[5], (docs[6][0], "same id, other words here")]


def test_plain_version(spark):
    docs = corpus()
    assert ours(spark, docs) == plain(docs)


def test_keys_of_many_classes_are_split(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PART", 7)
    docs = corpus(2)
    assert ours(spark, docs) == plain(docs)


def test_a_large_family_in_many_parts(spark, monkeypatch):
    """Three hundred near copies in parts of twenty."""
    monkeypatch.setattr(jaccard, "PART", 20)
    docs = list(enumerate(family(random.Random(8), [f"w{i}" for i in range(3000)], 150, 300, 2)))
    assert ours(spark, docs) == plain(docs)


def test_stragglers_meet_every_part_of_the_largest_component(spark, monkeypatch):
    """One key, a component over several parts, and a few classes that each link with one member of it."""
    monkeypatch.setattr(jaccard, "PART", 7)
    family = [[*range(100), 1000 + i] for i in range(40)]
    near = [[*range(92), *range(2000 + 10 * i, 2004 + 10 * i), 1000 + i, *range(92, 95)] for i in range(6)]
    sets = [(i, x) for i, x in enumerate(family + near)]
    comps = [0] * 40 + [*range(40, 46)]
    members = spark.createDataFrame([(5, i, comps[i], len(sets)) for i, _ in sets], "key long, cls long, comp long, size long")
    got = {(r.u, r.v) for r in jaccard.joined(members, spark.createDataFrame(sets, "cls long, set array<long>")).collect()}
    alike = lambda a, b: 100 * len(set(a) & set(b)) >= 90 * len(set(a) | set(b))
    pairs = [(comps[i], comps[j]) for i, a in sets for j, b in sets[:i] if alike(a, b)]
    assert len(closure(46, pairs)) == 40
    assert closure(46, got) == closure(46, pairs)


def test_empty_table(spark):
    assert ours(spark, []) == []
    assert ours(spark, [(3, None)]) == [(3, 0, 3)]


def test_a_very_long_text(spark):
    rng = random.Random(5)
    docs = [(i, t) for i, t in enumerate(family(rng, [f"w{i}" for i in range(5000)], 60_000, 2, 30) + ["x y z"])]
    assert ours(spark, docs) == plain(docs)


SETS = st.lists(st.sets(st.integers(0, 40), min_size=1, max_size=40), min_size=1, max_size=12, unique_by=frozenset)


def closure(n, links):
    comp = list(range(n))
    for i, j in links:
        comp = [comp[j] if c == comp[i] else c for c in comp]
    return {frozenset(i for i in range(n) if comp[i] == c) for c in comp}


@settings(max_examples=200, deadline=None)
@given(SETS, st.integers(0, 12), st.sampled_from([50, 75, 90]))
def test_trie_links_against_all_pairs(sets, split, percent):
    with pytest.MonkeyPatch.context() as m:
        m.setattr(jaccard, "PERCENT", percent)
        near = lambda a, b: 100 * len(a & b) >= percent * len(a | b)
        arrays = [np.array(sorted(s), np.int64) for s in sets]
        got = jaccard.trie_links(arrays, None, list(range(len(sets))))
        assert all(near(sets[i], sets[j]) for i, j in got)
        assert closure(len(sets), got) == closure(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if near(sets[i], sets[j])])
        k = 1 + split % len(sets)
        if k < len(sets):
            got = jaccard.trie_links(arrays[:k], arrays[k:], list(range(len(sets))))
            assert closure(len(sets), got) == closure(len(sets), [(i, j) for i in range(k) for j in range(k, len(sets)) if near(sets[i], sets[j])])
