import math
import random
import re

from featherlens.llm import lexical

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=50):
    bags = [(d, terms(t)) for d, t in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    out = []
    for item, text in items:
        found = []
        for d, b in bags:
            score = 0
            for t in set(terms(text)):
                df, tf = sum(t in x for _, x in bags), b.count(t)
                if tf:
                    m = 100 - 50 + 50 * len(b) * n_docs // total
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (1000000000 * tf // (1000 * tf + 20 * m))
            if score > 0:
                found.append((-score, d is None, d))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(found[:k])]
    return sorted(out, key=repr)


def ours(spark, docs, items, **how):
    d = spark.createDataFrame([(*x, 1, "y") for x in docs], "doc_id long, text string, item_id int, score string")
    i = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    rows = lexical.search(d, i, **how)
    assert rows.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in rows.collect()), key=repr)


def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["Über", "É2", "naïve", "İx", "it's", "a_b", "x-y"]
    text = lambda n: rng.choice([" ", "\n", ". "]).join(rng.choice(words[: rng.randint(5, 67)]) for _ in range(n))
    docs = [(i * 37 - 900, text(rng.randint(1, 60))) for i in range(150)]
    docs += [(5, None), (6, ""), (7, "... --"), (None, "w1 w2 w2"), (None, "w1 w2 w2"), (-900, "w1 w2"), (-900, "w1 w2"), (10**15, "w3 " * 5000)]
    items = [(i, text(12)) for i in range(12)] + [(3, "w1 W2 É2"), (None, "w5 w6"), (99, None), (98, "zzz"), (97, "w1 w1 w1")]
    return docs, items


def test_plain_version(spark):
    docs, items = corpus()
    assert ours(spark, docs, items) == plain(docs, items)
    assert ours(spark, docs, items, k=3) == plain(docs, items, 3)


def test_blocks_of_items_and_small_windows(spark, monkeypatch):
    docs, items = corpus()
    monkeypatch.setattr(lexical, "WINDOW", 16)
    assert ours(spark, docs, items, block_bytes=200) == plain(docs, items)


def test_empty_tables(spark):
    assert ours(spark, [], [(1, "a")]) == []
    assert ours(spark, [(1, "a")], []) == []
    assert ours(spark, [(1, None)], [(1, "a")]) == []


def test_ties_go_to_the_smaller_id(spark):
    docs = [(i, "same text here") for i in range(200, 0, -1)] + [(500, "other words")]
    got = ours(spark, docs, [(1, "same text")], k=7)
    assert [(r[1], r[2]) for r in got] == [(i, i) for i in range(1, 8)] and len({r[3] for r in got}) == 1


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 64)
    text = ("abc, déf-" * 50 + "x" * 500 + " tail").encode()
    assert [t.decode() for part in lexical.pieces(text) for t in part] == terms(text.decode())


def test_lengths_beyond_64_bits():
    import numpy as np

    n = np.array([3, 10**9])
    assert lexical.length_terms(n, 10**12, 10**14).tolist() == [50 + 50 * x * 10**12 // 10**14 for x in (3, 10**9)]
