import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from featherlens.llm import lm


def brute_base(docs):
    train = Counter()
    held = {}
    for d, t in docs:
        key = "" if d is None else str(d)
        held[d] = zlib.crc32(key.encode()) % 7 == 2
        if not held[d]:
            train.update([*(t or "").encode().lower().split(), b"\n"])
    n, v = sum(train.values()), len(train)
    out = []
    for d, t in docs:
        words = [*(t or "").encode().lower().split(), b"\n"]
        base = sum(math.log10((train[w] + 1) / (n + v + 1)) for w in words)
        out.append((d, held[d], len(words), sum(train[w] > 0 for w in words), n, round(base, 6)))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(11)
    langs = [[a + b + c for a in "pbk" for b in "aeiou" for c in ("", "n", "lo")], [a + b + c for a in ("sch", "z") for b in "äöü" for c in ("", "ng", "st")]]
    docs = [(i, " ".join(rng.choice(langs[i % 2]).title() for _ in range(rng.randrange(5, 90)))) for i in range(300)]
    return docs + [(None, None), (500, None), (501, ""), (502, " \n"), (503, "x" * 70_000 + " pa"), (504, "pa " * 60_000), (3, docs[3][1]), (None, "pa PA \x00 nul"), (505, "unseen" + "qwx" * 40)]


def test_base_and_score(spark, monkeypatch):
    monkeypatch.setattr(lm, "FLUSH", 40)
    docs = corpus()
    df = spark.createDataFrame([(*d, True, 1) for d in docs], "doc_id long, text string, held_out boolean, c int").repartition(4)
    got = lm.score_documents(df).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == brute_base(docs)
    assert all(math.isfinite(r.score) and r.score < 0 and r.bits_per_byte > 0 for r in got)
    held = [r for r in got if r.held_out and r.n_tokens > 2 and r.n_known == r.n_tokens]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_depend_on_rows_alone(spark, monkeypatch):
    """Whatever the partitions, files, blocks of work or order of rows; equal texts have equal scores."""
    docs = [d for d in corpus() if len(d[1] or "") < 5000] + [(900 + 7 * i, "pa pan palo") for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(lm, "BLOCK", 2000)
    monkeypatch.setattr(lm, "TASK", 3000)
    runs = []
    for n in (1, 6):
        got = lm.score_documents(df.repartition(n, "text").sortWithinPartitions("text", ascending=n > 1)).collect()
        runs.append(sorted((str(r.doc_id), r.n_tokens, r.score) for r in got))
    for a, b in zip(*runs, strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-9)
    assert len({round(r.score, 9) for r in got if r.doc_id is not None and r.doc_id >= 900}) == 1


M = (1 << 64) - 1


def stir(x):
    x = x * 0xFF51AFD7ED558CCD & M
    x = (x ^ x >> 32) * 0xC4CEB9FE1A85EC53 & M
    return x ^ x >> 29


def slot(h, node, bits):
    return ((h ^ (node * 0xD6E8FEB86659FD93 & M)) * 0x9FB21C651E98DF25 & M) >> (64 - bits)


class Slow:
    """The model in plain steps: dictionaries of counts by kind and slot, one bit after another."""

    def __init__(self, model, texts):
        """texts: the training texts' words."""
        self.m, self.lay = model, model.layout
        self.kind, self.word, self.byte = Counter(), Counter(), Counter()
        for text in texts:
            kinds = self.kinds(text)
            for t, w in enumerate(text):
                i = self.lay.number.get(w, self.lay.escape)
                for depth, node, bit in self.path(i):
                    self.kind[kinds[t], node, bit] += 1
                    self.word[self.before(text, t, node), bit] += 1
                if i == self.lay.escape:
                    self.spell(w, kinds[t])
        for i, w in enumerate(self.lay.words):
            *_, (_, node, bit) = self.path(i)
            held = [self.kind[k, node, bit] for k in range(lm.CLASSES)]
            self.spell(w, held.index(max(held)) if max(held) else lm.CLASSES)

    def path(self, i):
        return [(d, int(self.lay.tree.node[d, i]), int(self.lay.tree.bit[d, i])) for d in range(self.lay.tree.length[i])]

    def before(self, text, t, node):
        return slot(stir(self.lay.number.get(text[t - 1], self.lay.escape) + 1 if t else 0), node, self.lay.word_bits)

    def kinds(self, text):
        of = [int(self.lay.kinds[self.lay.number.get(w, self.lay.escape)]) for w in text]
        out = []
        for t in range(len(text)):
            held = [of[max(0, t - lm.RECENT) : t].count(k) for k in range(lm.CLASSES)]
            out.append(held.index(max(held)) if max(held) else lm.CLASSES)
        return out

    def bits(self, w, kind):
        w += b" "
        for t, byte in enumerate(w):
            for k in range(8):
                node = (byte >> (8 - k)) | (1 << k)
                contexts, h = [], kind + 1
                for back in range(1, max(lm.ORDERS) + 1):
                    h = (h * 0x2545F4914F6CDD1D + (w[t - back] + 1 if back <= t else 0)) & M
                    if back in lm.ORDERS:
                        contexts.append((back, slot(stir(h), node, self.lay.byte_bits)))
                yield k, node, (byte >> (7 - k)) & 1, contexts

    def spell(self, w, kind):
        for _, _, bit, contexts in self.bits(w, kind):
            for c in contexts:
                self.byte[c, bit] += 1

    @staticmethod
    def logit(zeros, ones):
        return math.log((ones + lm.PRIOR) / (zeros + lm.PRIOR))

    @staticmethod
    def level(n):
        return sum(n > x for x in lm.LEVELS)

    @staticmethod
    def chance(mixer, x, gate, cell, bit):
        z = sum(float(w) * v for w, v in zip(mixer.weights[:, gate], [*x, 0.3], strict=True))
        z = max(-lm.LIMIT, min(lm.LIMIT, z))
        p = 1 / (1 + math.exp(-z))
        c = mixer.counts[cell, round(z * (lm.BUCKETS - 1) / 2 / lm.LIMIT) + lm.BUCKETS // 2]
        e = mixer.begun[round(z * (lm.BUCKETS - 1) / 2 / lm.LIMIT) + lm.BUCKETS // 2]
        p = (p + (c[1] + e[1]) / (c.sum() + e.sum())) / 2
        return p if bit else 1 - p

    def score(self, text, counts):
        total, kinds = 0.0, self.kinds(text)
        ids = [self.lay.number.get(w, self.lay.escape) for w in text]
        guesses = []
        for t, w in enumerate(text):
            same = [u for u in range(2, t) if ids[u - 2 : u] == ids[t - 2 : t]] if t > 1 else []
            guess = ids[same[-1]] if same else None
            state = 0 if guess is None else 1 + (guesses[-1] == ids[t - 1]) + (guesses[-2:] == ids[t - 2 : t])
            guesses.append(guess)
            for depth, node, bit in self.path(ids[t]):
                kind = [self.kind[kinds[t], node, b] for b in (0, 1)]
                word = [self.word[self.before(text, t, node), b] for b in (0, 1)]
                said = [b for d, n, b in self.path(guess) if n == node] if guess is not None else []
                x = [self.logit(*self.lay.node_counts[node]), self.logit(*kind), self.logit(*word), 4 * said[0] - 2 if said else 0]
                gate = (self.level(sum(kind)) * lm.N_LEVELS + self.level(sum(word))) * lm.MATCHES + (state if said else 0)
                total += math.log10(self.chance(self.m.words, x, gate, depth, bit))
            if ids[t] == self.lay.escape:
                s = 0.0
                for k, node, bit, contexts in self.bits(w, kinds[t]):
                    pairs = [[self.byte[c, b] for b in (0, 1)] for c in contexts]
                    gate = (self.level(sum(pairs[-1])) * lm.N_LEVELS + self.level(sum(pairs[1]))) * 8 + k
                    s += math.log10(self.chance(self.m.bytes, [self.logit(*p) for p in pairs], gate, node, bit))
                share = self.lay.known_share
                total += math.log10(share * counts[w] / max(1, self.lay.outside) + (1 - share) * 10**s)
        return total


def test_score_equals_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    langs = [["pa", "pan", "belo", "kin", "ken"], ["schä", "zöst", "züng", "schü"]]
    docs = [(i, " ".join(rng.choice(langs[i % 2]) if rng.random() < 0.9 else f"x{rng.randrange(60)}" for _ in range(rng.randrange(3, 25)))) for i in range(60)]
    docs += [(100, "one two one two one two three"), (101, ""), (102, None), (103, "pa pan belo kin pa pan belo kin pa pan belo Kin ken neverseen")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("held_out", F.col("doc_id") % 5 == 3)
    _, _, model, _ = lm.fit(df)
    monkeypatch.setattr(lm, "crc_mod", lambda c, n: F.when(F.col(c) % 5 == 3, lm.HELD_OUT).otherwise(0))
    text = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    training = [text(t) for d, t in docs if d % 5 != 3]
    slow, counts = Slow(model, training), Counter(w for t in training for w in t)
    got = {r.doc_id: r.score for r in lm.score_documents(df.drop("held_out")).collect()}
    assert len(set(model.layout.kinds[: len(model.layout.words)])) > 2  # the languages, and the end's none
    for d, t in docs:
        assert got[d] == pytest.approx(slow.score(text(t), counts), rel=1e-4), t


def test_bits_are_a_distribution():
    """Over all words of the tree, and over all bytes in a place, probabilities sum to one."""
    layout = lm.Layout([b"\n", b"alpha", b"beta", b"alp", b"gamma"], np.array([4.0, 9, 5, 3, 2]), 3, 3, 1, 30)
    flat = np.zeros((layout.slots, 2), np.int32)
    train = lm.Texts(layout, [layout.ids([b"alpha", b"beta", b"zeta", b"alp", b"\n"])] * 3, [[b"zeta"]] * 3)
    lm.count_stretch(layout, train.stretch, train.tails, train.tail_kinds, flat.reshape(-1))
    lm.count_head(layout, flat)
    m = lm.Model(layout, flat)
    m.learn(train.stretch, train.tails, train.tail_kinds)
    logs = [m.word_logs(lm.Stretch(layout, np.array([1, 2, i], np.int32), np.array([3])))[2] for i in range(6)]
    assert sum(10**x for x in logs) == pytest.approx(1)
    kinds, total = np.array([lm.CLASSES]), 0.0
    text, _, hashes = lm.byte_contexts(layout, [b"zet"], kinds)
    for byte in range(256):
        p = 1.0
        for k, node, bit, at in lm.byte_steps(layout, np.full(len(text), byte), hashes):
            x, gate = m.byte_inputs(k, bit, at, False)
            p *= m.bytes.probability(node, m.bytes.mixed(x, gate), bit)[2]
        total += p
    assert total == pytest.approx(1)
    likely, odd = m.byte_logs([b"zeta", b"qqqq"], np.repeat(kinds, 2))
    assert likely > odd


def test_kinds_are_languages():
    rng = np.random.default_rng(2)
    follows = np.zeros((40, 40))
    for lang in (0, 1, 2):
        at = np.arange(lang, 39, 3)
        follows[np.ix_(at, at)] = rng.integers(5, 9, (13, 13))
    kinds = lm.find_kinds(follows)
    assert all(len(set(kinds[lang:39:3])) == 1 for lang in (0, 1, 2)) and len(set(kinds[:3])) == 3


def test_long_texts_go_in_pieces(monkeypatch):
    monkeypatch.setattr(lm, "PIECE", 4)
    layout = lm.Layout([b"\n", b"a", b"b"], np.array([2.0, 9, 5]), 0, 0, 0, 16)
    ids = layout.ids([b"a", b"b", b"a", b"b", b"a", b"b", b"\n"])
    texts = lm.Texts(layout, [ids], [[]])
    begins = texts.stretch.before == lm.stirred(np.zeros(1, np.uint64))
    assert texts.sizes.tolist() == [7] and sorted(texts.stretch.order[begins].tolist()) == [0, 4]


def test_no_training_rows_and_empty(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lm.score_documents(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (r.train_tokens, r.n_known, r.base_score) == (0, 0, 0.0) and r.score < 0
    assert lm.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_counts_of_a_slot_are_halved_together():
    got = lm.fitted(np.array([[300_000_000, 20_000_000], [90_000_000, 600_000_000], [5, 1 << 40], [0, 1 << 30], [7, 3], [0, 0], [(1 << 24) - 1, 1 << 23]], np.int64))
    assert got.max() < 1 << 24
    assert got[0, 0] / got[0, 1] == pytest.approx(15, rel=1e-5) and got[1, 1] / got[1, 0] == pytest.approx(600 / 90, rel=1e-5)
    assert got[2].tolist() == [1, 1 << 23] and got[3, 0] == 0 and got[4:6].tolist() == [[7, 3], [0, 0]] and got[6].tolist() == [(1 << 24) - 1, 1 << 23]


def test_like_words_are_worked_on_once(monkeypatch):
    """Copies of a text cost no further bits in scoring, and copies of a spelling none in learning and counting."""
    layout = lm.Layout([b"\n", b"a", b"b"], np.array([2.0, 9, 5]), 4, 0, 0, 16)
    ids, tails = layout.ids([b"a", b"zeta", b"b", b"\n"]), [b"zeta"]
    seen = {}
    for copies in (1, 50):
        flat, bits = np.zeros((layout.slots, 2), np.int32), []
        texts = lm.Texts(layout, [ids] * copies, [tails] * copies)
        lm.count_stretch(layout, texts.stretch, texts.tails, texts.tail_kinds, flat.reshape(-1))
        assert flat.sum() == copies * (2 * int(layout.tree.length[ids].sum()) + 5 * 8 * len(lm.ORDERS))
        model = lm.Model(layout, flat)
        model.learn(texts.stretch, texts.tails, texts.tail_kinds)
        assert model.bytes.seen.sum() == copies * 8 * 5 and model.words.seen.sum() == copies * layout.tree.length[ids].sum()
        plain = lm.Mixer.probability
        monkeypatch.setattr(lm.Mixer, "probability", lambda *a, plain=plain, bits=bits: bits.append(len(a[-1])) or plain(*a))
        logs, _ = lm.tree_scores([texts, texts], model)
        monkeypatch.undo()
        seen[copies] = sum(bits)
        assert np.ptp(logs) < 1e-9
    assert seen[1] == seen[50] == int(layout.tree.length[ids].sum()) + 5 * 8


def test_words_are_those_of_bytes():
    texts = ["A b", "", None, " \n", "\ta  Ä É\x00x\x0b", "x\x1cy   Z", *(f"a{chr(i)}B" for i in range(256))]
    words, at = lm.words_of(pa.array(texts))
    got = [words[a:b].cast(pa.binary()).to_pylist() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    assert got == [(t or "").encode().lower().split() for t in texts]
