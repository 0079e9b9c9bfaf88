import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from featherlens.llm import quality, toxicity
from featherlens.llm.labelled import labelled_sample

WORDS = ["der", "mond", "river", "stone", "walking", "house", "often", "green", "letter", "été", "garden", "cloud"]


def made(n):
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(n):
        good, toxic = i % 3 > 0, i % 4 == 0
        words = [rng.choice(WORDS) + rng.choice(["", "s", "en", "ly"]) for _ in range(rng.randrange(12, 120))]
        if toxic:
            for _ in range(1 + len(words) // 15):
                words.insert(rng.randrange(len(words)), rng.choice(["villain", "dunce", "rotter", "Villain!"]))
        text = " ".join(words).capitalize() + "."
        docs.append((i, text if good else text.upper().replace(" ", "!! ")))
        if i % 5 < 4:
            labels.append((i, int(good), int(toxic)))
    return docs, labels


EDGES = [(None, "A quiet house."), (9001, None), (9002, ""), (9003, " \n"), (9004, "green stone " * 60_000), (9005, "villain " * 60_000), (3, "again"), (3, "again")]


@pytest.mark.parametrize(("run", "column", "folds", "held"), [(quality.quality, 1, 3, 1), (toxicity.toxicity, 2, 5, 0)])
def test_held_out(spark, run, column, folds, held):
    docs, labels = made(900)
    extra = labels + [(None, 1, 1), (4, None, None), (10_000, 1, 0), (7, labels[6][1], labels[6][2])]
    d = spark.createDataFrame([(*r, "s", 0.0) for r in docs + EDGES], "doc_id long, text string, source string, score double").repartition(3)
    lab = spark.createDataFrame([(*r, "t") for r in extra], "doc_id long, quality int, toxic int, text string")
    got = run(d, lab).collect()
    assert len(got) == len(docs) + len(EDGES)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % folds == held) for r in got)
    truth = {i: (int(i % 3 > 0), int(i % 4 == 0))[column - 1] for i, _ in docs}
    test = [r for r in got if r.held_out and r.doc_id in truth and r.doc_id != 3]
    assert np.mean([r.predicted == truth[r.doc_id] for r in test]) > 0.95
    # held-out labels and other columns don't move a score
    turned = [(i, 1 - q, 1 - t) if i is not None and q is not None and zlib.crc32(str(i).encode()) % folds == held else (i, q, t) for i, q, t in extra]
    again = run(d.withColumn("source", d["text"]), spark.createDataFrame([(*r, "u") for r in turned], "doc_id long, quality int, toxic int, text string")).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


@pytest.mark.parametrize(("run", "label"), [(quality.quality, "quality"), (toxicity.toxicity, "toxic")])
def test_few_labels_and_empty(spark, run, label):
    schema = "doc_id long, quality int, toxic int"
    d = spark.createDataFrame([(0, "some text"), (1, None)], "doc_id long, text string")
    assert {r.score for r in run(d, spark.createDataFrame([], schema)).collect()} == {0.5}
    one = run(d, spark.createDataFrame([(i, 1, 1) for i in range(9)], schema)).collect()
    assert all(r.predicted == 1 for r in one)
    assert run(d.limit(0), spark.createDataFrame([(2, 1, 0)], schema)).count() == 0


def test_sample_is_bounded(spark):
    docs, labels = made(600)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got, counts = labelled_sample(d, lab, "toxic", (50, 20))
    got = got.collect()
    assert counts == {0: 360, 1: 120} and 25 <= sum(r.y == 0 for r in got) <= 80 and 6 <= sum(r.y == 1 for r in got) <= 40


@pytest.mark.parametrize(("run", "column"), [(quality.quality, 1), (toxicity.toxicity, 2)])
def test_long_texts_are_learned_from(spark, run, column):
    """All texts of label 1 are far longer than those of label 0 and share nothing with them."""
    rng = random.Random(4)
    strange = ["zork", "blip", "quux", "frob"] if column == 2 else ["@@@", "%%", "$$$$", "##"]
    docs = [(i, " ".join(rng.choice(WORDS) for _ in range(30))) for i in range(300)]
    docs += [(1000 + i, " ".join(rng.choice(WORDS if k % 5 else strange) for k in range(16_000))) for i in range(20)]
    assert min(len(t) for d, t in docs if d >= 1000) > 1 << 16
    labels = [(d, int(d >= 1000), int(d >= 1000)) for d, _ in docs]
    got = run(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert all(r.predicted == (r.doc_id >= 1000) for r in got)


def test_votes_equal_brute_force(spark):
    docs, labels = made(300)
    d, lab = spark.createDataFrame(docs + EDGES, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    m = quality.fit(d, lab)
    for r, text in zip(quality.scored(d, lab).collect(), [t for _, t in docs + EDGES], strict=True):
        q = (text or "").encode()
        v = m.unit(m.weighted(quality.terms(q)[None]) @ m.axes)[0]
        sims = sorted(((float(v @ u), i) for i, u in enumerate(m.vectors)), reverse=True)[: quality.NEIGHBOURS]
        w = [(max(s, 0) ** quality.POWER * m.votes[i], m.labels[i]) for s, i in sims]
        total = sum(a for a, _ in w)
        assert r["__score"] == pytest.approx(sum(a for a, y in w if y) / total if total > 1e-12 else m.prior, rel=1e-3, abs=1e-4)


def test_compression_equals_brute_force(spark):
    """The query's scores from the fitted dictionaries and weights, window by window in plain steps."""
    docs, labels = made(300)
    d, lab = spark.createDataFrame(docs + EDGES, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    m = toxicity.fit(d, lab)
    dist = m.distance

    def saved(content, window):
        size = lambda w: len(dist._compressor(content)(w))
        strange = xxhash.xxh3_128_digest(b"\x00")
        return max(0, len(window) + size(strange) - len(strange) - size(window))

    def brute(text):
        words = re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").encode().lower())
        windows = [words[i : i + 10] for i in range(0, len(words), 10)] or [[]]
        windows = [b"".join(xxhash.xxh3_128_digest(w) for n, w in enumerate(ws) if w not in ws[:n]) for ws in windows]
        o, t = ([saved(c, w) for w in windows] for c in (dist.ordinary, dist.toxic))
        top, n, k = sorted(t, reverse=True)[:3], len(t), sum(x >= 3 for x in t)
        x = [top[0], np.mean(top[:2]), np.mean(top), np.mean(t), k / n, (k / n) ** 0.5, math.log(1 + n), k**0.5, np.mean(o), max(a - b for a, b in zip(t, o, strict=True))]
        z = [(a - b) / c for a, b, c in zip(x, m.mean, m.scale, strict=True)]
        z += [z[0] * z[6], z[4] * z[6], 1.0]
        return 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(z, m.weights, strict=True))))))

    short = {(i, t): brute(t) for i, t in docs + EDGES if len(t or "") < 10_000}
    for r in toxicity.scored(d, lab).collect():
        if (r.doc_id, r.text) in short:
            assert r["__score"] == pytest.approx(short[r.doc_id, r.text], rel=1e-9)


def test_dictionaries_are_trained_on_what_tells_texts_apart():
    fit = [(f"ordinary text number {i} about rivers and stones and more", 0) for i in range(200)] + [(f"text number {i} you dunce about rivers", 1) for i in range(60)]
    d = toxicity.dictionaries([(toxicity.unalike([(toxicity.outline(t.encode()), y)])[0][0], y) for t, y in fit])
    assert d.ordinary[:4] == d.toxic[:4] == b"\x37\xa4\x30\xec"  # full dictionaries with entropy tables
    toxic = lambda t: int(d.savings(toxicity.windows_of(t))[1].max())
    assert toxic(b"rivers and stones you DUNCE!") >= toxicity.MARKED > toxic(b"rivers and stones and more")


def test_all_windows_of_a_text_are_trained_on():
    text = b" ".join(b"w%d" % i for i in range(100_000))
    (windows, y), (again, _) = toxicity.unalike([(toxicity.outline(text), 1)] * 2)
    assert len(windows) == 10_000 and y == 1 and again is None
    assert windows[-1] == b"".join(xxhash.xxh3_128_digest(b"w%d" % i) for i in range(99_990, 100_000))
    assert toxicity.unalike([(toxicity.outline(b""), 0)]) == [([b""], 0)]


def test_repeated_rows_and_many_texts_of_an_id_stay_bounded(spark):
    rows = [(1, "same text")] * 500 + [(2, f"text {i}") for i in range(3000)] + [(i, f"other {i}") for i in range(3, 40)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 40)], "doc_id long, quality int, toxic int")
    got, _ = labelled_sample(d, lab, "quality", (50, 50))
    rows = got.collect()
    assert len(rows) == len(set(rows)) and 100 <= len(rows) <= 320


def test_places_do_not_decide_between_tied_neighbours():
    """Twenty copies with label 1 and twenty with label 0 give one half, in whatever order they come."""
    copy = quality.packed_terms(b"the same words in every copy")
    other = [(quality.packed_terms(f"another {w} text!".encode()), 0) for w in WORDS[:10]]
    for labels in ([1] * 20 + [0] * 20, [0] * 20 + [1] * 20, [0, 1] * 20):
        m = quality.Neighbours([(copy, y) for y in labels] + other, {0: 30, 1: 20})
        assert m.scores([b"the same words in every copy"])[0] == pytest.approx(0.5, abs=1e-3)


def test_callers_columns_stay(spark):
    docs, labels = made(200)
    d = spark.createDataFrame([(*r, "mine", 7) for r in docs], "doc_id long, text string, __score string, `a.b` int")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = quality.keep_good(d, lab)
    assert kept.columns == d.columns and {(r["__score"], r["a.b"]) for r in kept.collect()} == {("mine", 7)}
