"""A language model by online logistic context mixing, trained on all training documents, and a unigram baseline.

A text is its lower-cased words and one end. Each token is coded bit by bit along its path in a Huffman tree over the HEAD
most frequent training words (seen twice at least), the end, and an escape; a word that the tree doesn't know is the escape
and then its bytes, bit by bit, and a closing blank. Bits of words are predicted by contexts that reach across words, each
with the bits of the word known already:

* none: what the training words' counts say, discounted by DISCOUNT for the escape;
* the text's kind so far: the CLASSES group that most of the last RECENT frequent words belong to (in effect, its language).
  Groups are found among the TOP most frequent words from how often each follows the other;
* the word before, in hashed slots;
* the word that followed when the two words before stood last in this text (a match), and how well that has held of late.

Bits of bytes are predicted by the last 1, 2, 3, 4 and 6 bytes of the word, each with the text's kind, in hashed slots.
Their counts are of the words outside the tree, and once of each word in it in the kind that has it most.

A predictor is a pair of counts, and its input to the mixer the logit of its estimate. The mixer is a logistic unit whose
weights are chosen by a gate (how often the contexts were seen, and the match's state or the bit's number) and learned
online: they move after every batch of bits, each bit predicted without its own occurrence. A last adaptive stage maps
(place in the code, mixed logit) to the frequency seen there and is averaged with the mix.

An unknown word's bytes are interpolated with its share among the counts of all words outside the tree, by Good-Turing's
estimate of how many of them will have been seen. That word table is distributed, holds every word of every document and
grows with the corpus; texts' rare words are joined with it.

All tables are sums of whole numbers over all training documents, and weights are learned in blocks of documents that are
made by a hash and read in its order; the blocks' weights are averaged in whole numbers too. So no score depends on files,
partitions or the order of rows, and equal texts have equal scores. Slots are as many as the corpus asks for, up to
2**MAX_SLOT_BITS a table, as tables are broadcast; beyond that contexts share slots, and the weights, learned on the very
same slots, rely on them as far as they still tell.

Each text is read whole; contexts start anew every PIECE words. A bit's two probabilities sum to one, so those of all texts
sum to at most one, and the text's log10 probability and its bits per byte follow.

Null and empty texts are an end alone. Repeated rows each get their row; null ids count as the empty text for the split.
doc_id is taken as a long integer. With no training documents N = V = 0 and only an untrained model is left.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import cached_property
from itertools import groupby, repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, cut, drop_cut

FOLDS, HELD_OUT = 7, 2
END = b"\n"
#: Words in the tree, at most; words among which kinds of text are told apart; kinds; words that tell a text's kind.
HEAD, TOP, CLASSES, RECENT = 1 << 18, 256, 16, 64
DISCOUNT = 0.6
#: Distance (one less the cosine) from which on a word begins a kind of its own.
APART = 0.5
ORDERS = (1, 2, 3, 4, 6)
MIN_SLOT_BITS, MAX_SLOT_BITS = 14, 20
#: Words of documents that are worked on at once, longest stretch of one document, words of a block, of a counting task.
CHUNK, PIECE, BLOCK, TASK = 1 << 15, 1 << 18, 1 << 20, 1 << 22
#: Words whose like are added up before they are counted, or spelled, at once.
GATHER = 1 << 20
#: Bits that are worked on at once, few enough that a core keeps them near.
SLICE = 1 << 14
#: Bytes of texts that are split into words at once.
TEXTS = 1 << 23
#: Distinct words that a task counts before it hands them on.
FLUSH = 400_000
#: Stretches that a table is handed on in.
PARTS = 64
#: Bits of a count, as much as the counts' floats hold.
COUNT_BITS = 24
PRIOR = 0.25
RATE, STEP_BITS = 0.006, 30
#: Mixed logits lie between -LIMIT and LIMIT, in so many buckets.
LIMIT, BUCKETS = 12, 49
LEVELS = np.array([0.5, 1.5, 3.5, 15.5, 255.5])
N_LEVELS = len(LEVELS) + 1
#: Level of a count, counts from the last one on alike.
LEVEL_OF = np.searchsorted(LEVELS, np.arange(258)).astype(np.int8)
MATCHES = 4
FIXED = 1 << 20
_STIR = np.uint64(0x9FB21C651E98DF25)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All texts' words in a row, and where each text's begin and end; a null has none."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, offsets = lists.flatten(), lists.offsets.to_numpy()
    real = pc.binary_length(words).to_numpy() > 0  # blanks at a text's ends leave empty words
    if not real.all():
        words, offsets = words.filter(pa.array(real)), np.concatenate([[0], np.cumsum(real)])[offsets]
    return words, offsets


def some_texts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Of about TEXTS bytes."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    a = 0
    while a < len(upto):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + TEXTS)))
        yield batch.slice(a, b - a)
        a = b


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def stirred(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(29)
    return x


def _squeezed(x: np.ndarray) -> tuple:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 3), x.dtype.str, x.shape


def _restored(data: bytes, dtype: str, shape: tuple) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), dtype).reshape(shape).copy()


class Tree:
    """Huffman codes of the symbols 0..n-1 by weight: nodes and bits of each symbol's path, by depth."""

    def __init__(self, weights: np.ndarray) -> None:
        n = len(weights)
        up, side = np.full(2 * n, -1, np.int32), np.zeros(2 * n, np.int8)
        heap = [(float(w), i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        inner = n
        while len(heap) > 1:
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            up[i], up[j], side[j] = inner, inner, 1
            heapq.heappush(heap, (a + b, inner))
            inner += 1
        self._walk(up, side)

    def __getstate__(self):
        return _squeezed(self.up), _squeezed(self.side)

    def __setstate__(self, state) -> None:
        self._walk(*(_restored(*x) for x in state))

    def _walk(self, up: np.ndarray, side: np.ndarray) -> None:
        """up, side: the node above each symbol and inner node (numbered from n on, -1 above the root), and which side it is."""
        self.up, self.side, n = up, side, len(up) // 2
        self.size = max(1, n - 1)
        paths, at = [], np.arange(n)
        while (up[at] >= 0).any():
            real = up[at] >= 0
            paths.append((np.where(real, up[at] - n, -1), np.where(real, side[at], 0)))
            at = np.where(real, up[at], at)
        self.length = sum(((node >= 0).astype(np.int64) for node, _ in paths), np.zeros(n, np.int64))
        deep = int(self.length.max(initial=0))
        #: (depth, symbol): twice the node before the bit of that depth, plus the bit; -1 beyond the path
        self.code = np.full((deep, n), -1, np.int32)
        for k, (node, bit) in enumerate(paths):  # k steps above the leaf
            real = np.flatnonzero(node >= 0)
            self.code[self.length[real] - 1 - k, real] = 2 * node[real] + bit[real]
        path = np.zeros(n, np.uint64)
        for code in self.code[:64]:
            path = path << np.uint64(1) | (code & 1 & ~(code >> 31)).astype(np.uint64)
        #: symbols by length of their codes, longest first, and then by code, so that neighbours share nodes; and where each is
        self.sorted = np.lexsort((path, -self.length))
        self.place = np.empty(n, np.int64)
        self.place[self.sorted] = np.arange(n)

    @property
    def node(self) -> np.ndarray:
        return self.code >> 1

    @property
    def bit(self) -> np.ndarray:
        return np.where(self.code < 0, 0, self.code & 1)

    def counts(self, weights: np.ndarray) -> np.ndarray:
        """(node, 2): weight of the symbols below each node's two sides."""
        out = np.zeros(2 * self.size)
        for code in self.code:
            real = code >= 0
            np.add.at(out, code[real], weights[real])
        return out.reshape(-1, 2)


class Mixer:
    """Gated weights and the last stage, over n inputs and a constant."""

    def __init__(self, gates: int, inputs: int, cells: int, start: float) -> None:
        self.weights = np.full((inputs + 1, gates), start)
        self.weights[-1] = 0
        self.seen = np.zeros(gates, np.int64)
        self.mass, self.pull = np.zeros_like(self.seen), np.zeros_like(self.weights)
        self.counts = np.zeros((cells, BUCKETS, 2), np.int64)
        p = sigmoid((np.arange(BUCKETS) - BUCKETS // 2) * LIMIT * 2 / (BUCKETS - 1))
        self.begun = np.stack([1 - p, p], -1) * 4  # what the logit says
        self.share = None

    def mixed(self, x: list[np.ndarray], gate: np.ndarray, few: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """few: places and values of the last input, where it is not zero."""
        w = self.weights.astype(np.float32)
        out = (w[-1] * np.float32(0.3)).take(gate, mode="clip")
        for row, value in zip(w, x, strict=False):
            part = row.take(gate, mode="clip")
            part *= value
            out += part
        if few is not None:
            at, value = few
            out[at] += w[len(x)].take(gate[at]) * value
        return np.clip(out, -LIMIT, LIMIT, out=out)

    @staticmethod
    def bucket(logit: np.ndarray) -> np.ndarray:
        return np.rint(logit * ((BUCKETS - 1) / 2 / LIMIT)).astype(np.int32) + BUCKETS // 2

    def cells(self, cell: np.ndarray | int, logit: np.ndarray, bit: np.ndarray) -> np.ndarray:
        at = self.bucket(logit)
        at += cell * BUCKETS
        at *= 2
        at += bit
        return at

    def probability(self, cell: np.ndarray | int, logit: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """Of the bits that came."""
        if self.share is None:
            c = self.counts + self.begun
            self.share = (0.5 * c / c.sum(-1, keepdims=True)).ravel()
        p = logit * (1 - 2 * bit).astype(np.float32)
        np.exp(p, out=p)
        p += 1
        np.divide(np.float32(0.5), p, out=p)
        return self.share.take(self.cells(cell, logit, bit), mode="clip") + p

    def learn(self, x: list[np.ndarray], gate: np.ndarray, cell: np.ndarray | int, bit: np.ndarray, few: tuple[np.ndarray, np.ndarray] | None = None, times: np.ndarray | None = None) -> None:
        """Takes bits into the next step; times: how often each came, once if it is not given."""
        logit = self.mixed(x, gate, few)
        err = np.exp(-logit)
        err += 1
        np.divide(1, err, out=err)
        np.subtract(bit, err, out=err, dtype=np.float32)
        if times is not None:
            err *= times
        gates = len(self.seen)
        self.mass += np.bincount(gate, times, gates).astype(np.int64)
        for i, value in enumerate(x):
            self.pull[i] += np.bincount(gate, err * value, gates)
        if few is not None:
            at, value = few
            self.pull[len(x)] += np.bincount(gate[at], err[at] * value, gates)
        self.pull[-1] += np.bincount(gate, err * np.float32(0.3), gates)
        counts = np.bincount(self.cells(cell, logit, bit), times)
        self.counts.reshape(-1)[: len(counts)] += counts.astype(np.int64)

    def step(self) -> None:
        """Moves the weights, as far as that many single steps, up to STEP_BITS."""
        self.weights += RATE * np.minimum(self.mass, STEP_BITS) / np.maximum(self.mass, 1) * self.pull
        self.seen += self.mass
        self.mass[:], self.pull[:] = 0, 0

    def packed(self) -> np.ndarray:
        """Whole numbers whose sums over blocks merged() takes."""
        return np.concatenate([(np.rint(self.weights * FIXED).astype(np.int64) * self.seen).ravel(), self.seen, self.counts.ravel()])

    def merged(self, sums: np.ndarray) -> None:
        n = self.weights.size
        self.seen = sums[n : n + len(self.seen)]
        known = self.seen > 0
        self.weights[:, known] = sums[:n].reshape(self.weights.shape)[:, known] / self.seen[known] / FIXED
        self.counts = sums[n + len(self.seen) :].reshape(self.counts.shape)
        self.share = None


class Counts:
    """Pairs of counts of one table, and what they say with and without one occurrence of a bit."""

    def __init__(self, pairs: np.ndarray) -> None:
        """pairs: (slots, 2)."""
        self.pairs = np.ascontiguousarray(pairs, np.float32)
        self.logits = self.rest = None

    def __getstate__(self):
        # most are small whole numbers, so the packed form that is broadcast is a tenth of the table
        return _squeezed(self.pairs)

    def __setstate__(self, state) -> None:
        self.pairs, self.logits, self.rest = _restored(*state), None, None

    @staticmethod
    def _said(zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        level = LEVEL_OF[np.minimum(zeros + ones, 257).astype(np.int16)]
        return np.log((ones + np.float32(PRIOR)) / (zeros + np.float32(PRIOR))), level

    def _built(self, leave_out: bool) -> None:
        n, wide = len(self.pairs), 1 + leave_out
        logits, levels = np.empty((n, wide), np.float32), np.empty((n, wide), np.int8)
        for a in range(0, n, 1 << 18):
            zeros, ones = np.ascontiguousarray(self.pairs[a : a + (1 << 18)].T)
            to = slice(a, a + len(zeros))
            if leave_out:
                logits[to, 0], levels[to, 0] = self._said(np.maximum(zeros - 1, 0), ones)
                logits[to, 1], levels[to, 1] = self._said(zeros, np.maximum(ones - 1, 0))
            else:
                logits[to, 0], levels[to, 0] = self._said(zeros, ones)
        if leave_out:
            self.rest, self.rest_levels = logits.ravel(), levels.ravel()
        else:
            self.logits, self.levels = logits.ravel(), levels.ravel()

    def settle(self, leave_out: bool) -> None:
        """Keeps only what is looked up with or without a bit's own occurrence."""
        if self.pairs is not None:
            self._built(leave_out)
            self.pairs = None

    def tables(self, leave_out: bool) -> tuple[np.ndarray, np.ndarray]:
        """(logit, level) by slot; with leave_out by twice the slot plus the bit, less one of that bit."""
        if (self.rest if leave_out else self.logits) is None:
            self._built(leave_out)
        return (self.rest, self.rest_levels) if leave_out else (self.logits, self.levels)


class Layout:
    """What texts are coded with, and where its counts lie in one flat table: words by kind, words by word before, bytes."""

    def __init__(self, words: list[bytes], counts: np.ndarray, outside: int, singles: int, pairs: int, n_words: int) -> None:
        """words, counts: the head, END among it; outside: training tokens of other words; singles, pairs: words seen once, twice."""
        self.words, self.escape, self.outside = words, len(words), outside
        self.number = {w: i for i, w in enumerate(words)}
        weights = np.append(np.maximum(counts - DISCOUNT, 0), outside + DISCOUNT * max(1, len(words)))
        self.tree = Tree(np.maximum(weights, 1e-3))
        self.node_counts = self.tree.counts(weights)
        seen = max(outside - singles, 2 * pairs)
        self.known_share = min(0.95, max(0.01, seen / max(1, seen + singles)))
        bits = lambda n: min(MAX_SLOT_BITS, max(MIN_SLOT_BITS, int(n).bit_length()))
        self.word_bits = min(MAX_SLOT_BITS, bits(n_words)) + 1
        self.byte_bits = bits(8 * (outside + 1))
        self.kinds = np.full(len(words) + 1, CLASSES, np.int64)
        self.starts = np.cumsum([0, (CLASSES + 1) * self.tree.size, 1 << self.word_bits, len(ORDERS) << self.byte_bits])

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "number"}

    def __setstate__(self, state) -> None:
        self.__dict__.update(state)
        self.number = {w: i for i, w in enumerate(self.words)}

    @property
    def slots(self) -> int:
        return int(self.starts[-1])

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.number.get, words, repeat(self.escape)), np.int32, len(words))

    def kinds_before(self, ids: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Kind of the text before each token, CLASSES if no frequent word is near; start: place of its text's first token."""
        kind, n = self.kinds[ids].astype(np.int8), len(ids)
        since = np.maximum(start, np.arange(n) - RECENT)
        best, out = np.zeros(n, np.int32), np.full(n, CLASSES, np.int64)
        upto = np.zeros(n + 1, np.int32)
        for k in range(int(self.kinds.min(initial=CLASSES)), CLASSES):
            of = kind == k
            if not of.any():
                continue
            np.cumsum(of, out=upto[1:])
            held = upto[:-1] - upto.take(since, mode="clip")
            np.copyto(out, k, where=held > best)
            np.maximum(best, held, out=best)
        return out


def matches(ids: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token the one that followed the two tokens before it when they stood last in its text, and a state.

    States: 0 there is none, 1 there is one, 2 it was right for the last token, 3 for the last two.
    """
    n = len(ids)
    at = np.arange(n)
    real = np.flatnonzero(at - start >= 2)
    first, second = ids[real - 1].astype(np.uint64), ids[real - 2].astype(np.uint64)
    text = np.cumsum(at == start).astype(np.uint64)[real]
    symbol, place, texts = (int(x.max(initial=0)).bit_length() for x in (ids, at, text))
    if 2 * symbol + place + texts <= 64:  # all in one number, which is sorted at a time
        key = (((text << np.uint64(symbol)) | first) << np.uint64(symbol) | second) << np.uint64(place) | np.arange(len(real), dtype=np.uint64)
        key.sort()
        order = (key & np.uint64((1 << place) - 1)).astype(np.int64)
    else:
        with np.errstate(over="ignore"):
            key = (first * np.uint64(0x9E3779B97F4A7C15) + second) * np.uint64(0xC2B2AE3D27D4EB4F) + text
        order = np.argsort(stirred(key), kind="stable")
    now, before = real[order[1:]], real[order[:-1]]
    same = (ids[now - 1] == ids[before - 1]) & (ids[now - 2] == ids[before - 2]) & (start[now] == start[before])
    guess = np.full(n, -1, np.int64)
    guess[now[same]] = ids[before[same]]
    right = np.concatenate([[False, False], guess == ids])
    state = np.where(guess >= 0, 1 + right[1:-1] + (right[1:-1] & right[:-2]), 0)
    return guess, state


class Stretch:
    """Tokens of whole texts (or pieces of long ones), in the order of their codes, longest first."""

    def __init__(self, layout: Layout, ids: np.ndarray, sizes: np.ndarray) -> None:
        """sizes: tokens of each piece."""
        self.layout, self.n, self.tokens = layout, len(ids), ids
        first = np.cumsum(sizes) - sizes
        self.start = np.repeat(first, sizes)
        self.kind = layout.kinds_before(ids, self.start)
        self.previous = np.concatenate([[0], ids[:-1].astype(np.int64) + 1])
        self.previous[first] = 0

    @classmethod
    def of_all(cls, stretches: list[Stretch]) -> tuple[Stretch, np.ndarray]:
        """Tokens that differ in what they are or in any context, once each, and the number among them of each token."""
        layout = stretches[0].layout
        symbol, both = len(layout.tree.length).bit_length(), lambda f: np.concatenate([f(s) for s in stretches])
        fields = [(both(lambda s: s.previous), symbol), (both(lambda s: s.tokens), symbol), (both(lambda s: s.kind), CLASSES.bit_length()), (both(lambda s: s.match[0]) + 1, symbol), (both(lambda s: s.match[1]), MATCHES.bit_length() - 1)]
        key, used = np.zeros(len(fields[0][0]), np.uint64), 0
        for values, bits in fields:
            key, used = key << np.uint64(bits) | values.astype(np.uint64), used + bits
        if used > 64:
            raise ValueError(f"a token's contexts take {used} bits")
        _, at, which = np.unique(key, return_index=True, return_inverse=True)
        out = cls.__new__(cls)
        out.layout, out.n = layout, len(at)
        out.previous, out.tokens, out.kind, guess, state = (values[at] for values, _ in fields)
        out.match = guess - 1, state
        return out, which

    @cached_property
    def match(self) -> tuple[np.ndarray, np.ndarray]:
        return matches(self.tokens, self.start)

    @cached_property
    def order(self) -> np.ndarray:
        bits = np.uint64(self.n.bit_length())
        key = self.layout.tree.place[self.tokens].astype(np.uint64) << bits | np.arange(self.n, dtype=np.uint64)
        key.sort()
        return (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)

    @cached_property
    def ids(self) -> np.ndarray:
        return self.tokens[self.order].astype(np.int64)

    @cached_property
    def before(self) -> np.ndarray:
        return stirred(self.previous[self.order].astype(np.uint64))

    @cached_property
    def guesses(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in the order that have a match, what follows there, and its state."""
        guess, state = self.match
        guess, state = guess[self.order], state[self.order].astype(np.uint8)
        at = np.flatnonzero(guess >= 0)
        return at, guess[at], state[at]

    def steps(self) -> Iterator[tuple[int, Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]]:
        """(depth, slices of the tokens that have a bit there: their places, codes, bits and places by kind and by word before)."""
        tree, ids, before = self.layout.tree, self.ids, self.before
        active = np.searchsorted(-tree.length[ids], -np.arange(len(tree.code)) - 1, "right")
        kinds = self.kind[self.order] * tree.size

        def slices(codes: np.ndarray, n: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
            for a in range(0, n, SLICE):
                to = slice(a, min(n, a + SLICE))
                code = codes.take(ids[to], mode="clip")
                node = code >> 1
                yield to, code, code & 1, kinds[to] + node, word_slots(self.layout, before[to], node)

        for depth, n in enumerate(active.tolist()):
            if not n:
                return
            yield depth, slices(tree.code[depth], n)

    def matched(self, depth: int, to: slice, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where in the slice the match says something of the bit, what (2 or -2), and its state."""
        at, guess, state = self.guesses
        few = slice(*np.searchsorted(at, (to.start, to.stop)).tolist())
        at, said = at[few] - to.start, self.layout.tree.code[depth].take(guess[few])
        alive = np.flatnonzero((said >> 1) == (code[at] >> 1))
        return at[alive], (said[alive] & 1) * np.float32(4) - 2, state[few][alive]


def word_slots(layout: Layout, before: np.ndarray, node: np.ndarray) -> np.ndarray:
    """before: stirred numbers of the words before."""
    x = node.astype(np.uint64)
    with np.errstate(over="ignore"):
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= before
        x *= _STIR
        x >>= np.uint64(64 - layout.word_bits)
    return x.view(np.int64)


def like(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted keys where each distinct one begins, and how many there are of it."""
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return begin, np.diff(np.append(begin, len(keys)))


def byte_keys(words: list[bytes], kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kind, byte and the six bytes before in the word (blanks, which no word holds, where there are none), of each byte and closing blank; and the number of its word."""
    parts = [w + b" " for w in words]
    b = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    word = np.repeat(np.arange(len(parts)), sizes)
    pos = np.arange(len(b)) - (np.cumsum(sizes) - sizes)[word]
    keys = kinds.astype(np.uint64)[word] << np.uint64(8) | b
    for back in range(1, max(ORDERS) + 1):
        prev = np.full(len(b), 32, np.uint64)
        prev[back:] = b[:-back]
        prev[pos < back] = 32
        keys = keys << np.uint64(8) | prev
    return keys, word


def key_hashes(keys: np.ndarray, orders: tuple[int, ...] = ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, hashes of their contexts)."""
    deep = max(ORDERS)
    hashes = np.zeros((len(orders), len(keys)), np.uint64)
    with np.errstate(over="ignore"):
        h = (keys >> np.uint64(8 * deep + 8)) + np.uint64(1)
        for back in range(1, max(orders) + 1):
            prev = ((keys >> np.uint64(8 * (deep - back))) & np.uint64(255)) + np.uint64(1)
            prev[prev == 33] = 0
            h = h * np.uint64(0x2545F4914F6CDD1D) + prev
            if back in orders:
                hashes[orders.index(back)] = h
    return ((keys >> np.uint64(8 * deep)) & np.uint64(255)).astype(np.int64), stirred(hashes)


def byte_contexts(layout: Layout, words: list[bytes], kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with closing blanks, number of the word of each, hashes of its contexts)."""
    keys, word = byte_keys(words, kinds)
    b, hashes = key_hashes(keys)
    return b, word, hashes


def byte_steps(layout: Layout, b: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(bit number, partial bytes with a leading one, bits, slots by context) for the eight bits of each byte."""
    offsets = (np.arange(len(hashes), dtype=np.int64) << layout.byte_bits)[:, None]
    for k in range(8):
        node, bit = (b >> (8 - k)) | (1 << k), (b >> (7 - k)) & 1
        with np.errstate(over="ignore"):
            x = hashes ^ (node.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            x *= _STIR
            x >>= np.uint64(64 - layout.byte_bits)
        x = x.view(np.int64)
        x += offsets
        yield k, node, bit, x


def count_bytes(layout: Layout, keys: np.ndarray, flat: np.ndarray) -> None:
    """Adds the bits of bytes by their keys, like ones together."""
    keys = np.sort(keys)
    for i, order in enumerate(ORDERS):
        begin, times = like(keys >> np.uint64(8 * (max(ORDERS) - order)))
        b, hashes = key_hashes(keys[begin], (order,))
        times, base = times.astype(flat.dtype), int(layout.starts[2]) + (i << layout.byte_bits)
        for _, _, bit, at in byte_steps(layout, b, hashes):
            np.add.at(flat, 2 * (base + at[0]) + bit, times)


class Tally:
    """Counts of texts: like words are added up before their bits are."""

    def __init__(self, layout: Layout, flat: np.ndarray) -> None:
        """flat: (slots, 2) in a row."""
        self.layout, self.flat, self.n = layout, flat, 0
        self.symbols = len(layout.tree.place)
        self.kinds = np.zeros((CLASSES + 1) * self.symbols, np.int32)
        self.pairs, self.keys = [], []

    def add(self, stretch: Stretch, tails: list[bytes], tail_kinds: np.ndarray) -> None:
        np.add.at(self.kinds, stretch.kind * self.symbols + stretch.tokens, np.ones(stretch.n, np.int32))
        self.pairs.append(self.layout.tree.place[stretch.tokens] << 32 | stretch.previous)
        if tails:
            self.keys.append(byte_keys(tails, tail_kinds)[0])
        self.n += stretch.n
        if self.n >= GATHER:
            self.flush()

    def flush(self) -> None:
        layout, tree = self.layout, self.layout.tree
        if self.pairs:
            pairs = np.sort(np.concatenate(self.pairs))
            begin, times = like(pairs)
            pairs, times = pairs[begin], times.astype(self.flat.dtype)
            ids, before = tree.sorted[pairs >> 32], stirred((pairs & 0xFFFFFFFF).astype(np.uint64))
            active = np.searchsorted(-tree.length[ids], -np.arange(len(tree.code)) - 1, "right")
            for code, n in zip(tree.code, active.tolist(), strict=True):
                for a in range(0, n, CHUNK):
                    to = slice(a, min(n, a + CHUNK))
                    c = code.take(ids[to])
                    np.add.at(self.flat, 2 * (int(layout.starts[1]) + word_slots(layout, before[to], c >> 1)) + (c & 1), times[to])
        if self.keys:
            count_bytes(layout, np.concatenate(self.keys), self.flat)
        self.pairs, self.keys, self.n = [], [], 0

    def done(self) -> None:
        self.flush()
        held = np.flatnonzero(self.kinds)
        kind, symbol = np.divmod(held, self.symbols)
        times, base = self.kinds[held].astype(self.flat.dtype), kind * (2 * self.layout.tree.size)
        for code in self.layout.tree.code:
            c = code[symbol]
            real = c >= 0
            np.add.at(self.flat, base[real] + c[real], times[real])


def count_stretch(layout: Layout, stretch: Stretch, tails: list[bytes], tail_kinds: np.ndarray, flat: np.ndarray) -> None:
    """Adds all bits to the flat table of (slots, 2)."""
    tally = Tally(layout, flat)
    tally.add(stretch, tails, tail_kinds)
    tally.done()


def count_head(layout: Layout, flat: np.ndarray) -> None:
    """Adds the bytes of the tree's words once, in the kind that has each most; flat: counts (slots, 2) of the texts."""
    tree, symbol = layout.tree, np.arange(layout.escape)
    last = tree.length[: layout.escape] - 1
    if not len(symbol) or last.min() < 0:
        return
    code = tree.code[last, symbol]
    held = np.stack([flat[k * tree.size + (code >> 1), code & 1] for k in range(CLASSES)])
    kinds = np.where(held.max(0) > 0, held.argmax(0), CLASSES)
    for a in range(0, len(symbol), CHUNK):
        count_bytes(layout, byte_keys(layout.words[a : a + CHUNK], kinds[a : a + CHUNK])[0], flat.reshape(-1))


class Model:
    """Counts, weights and last stages for a layout."""

    def beginner(self) -> Model:
        """With the same counts, nothing learned."""
        out = Model.__new__(Model)
        out.__dict__.update(self.__dict__)
        out.start()
        return out

    def start(self) -> None:
        self.words = Mixer(N_LEVELS * N_LEVELS * MATCHES, 4, max(1, len(self.layout.tree.code)), 0.33)
        self.bytes = Mixer(N_LEVELS * N_LEVELS * 8, len(ORDERS), 256, 0.3)

    def __init__(self, layout: Layout, flat: np.ndarray) -> None:
        """flat: counts (slots, 2)."""
        self.layout = layout
        parts = np.split(flat.reshape(-1, 2), layout.starts[1:-1])
        self.plain, self.by_kind, self.by_word, self.by_bytes = Counts(layout.node_counts), *map(Counts, parts)
        self.start()

    def settle(self, leave_out: bool) -> None:
        for counts in (self.plain, self.by_kind, self.by_word, self.by_bytes):
            counts.settle(leave_out)

    def word_inputs(self, stretch: Stretch, depth: int, to: slice, code, bit, by_kind, by_word, leave_out: bool) -> tuple[list[np.ndarray], np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Inputs, gate, and the match's input where it has any."""
        if leave_out:
            by_kind, by_word = 2 * by_kind + bit, 2 * by_word + bit
        (plain, _), (kinds, kind_levels), (words, word_levels) = (t.tables(leave_out) for t in (self.plain, self.by_kind, self.by_word))
        x = [plain.take(code if leave_out else code >> 1, mode="clip"), kinds.take(by_kind, mode="clip"), words.take(by_word, mode="clip")]
        gate = kind_levels.take(by_kind, mode="clip").astype(np.uint8)
        gate *= N_LEVELS
        gate += word_levels.take(by_word, mode="clip").view(np.uint8)
        gate *= MATCHES
        at, match, state = stretch.matched(depth, to, code)
        gate[at] += state
        return x, gate.astype(np.int64), (at, match)

    def byte_inputs(self, k: int, bit, at, leave_out: bool) -> tuple[list[np.ndarray], np.ndarray]:
        logits, levels = self.by_bytes.tables(leave_out)
        if leave_out:
            at = 2 * at + bit
        x = [logits.take(a, mode="clip") for a in at]
        return x, (levels.take(at[-1]).astype(np.int64) * N_LEVELS + levels.take(at[1])) * 8 + k

    def learn(self, stretch: Stretch, tails: list[bytes], tail_kinds: np.ndarray) -> None:
        """One pass: a step of the weights for each depth or bit number."""
        for depth, slices in stretch.steps():
            for to, code, bit, by_kind, by_word in slices:
                x, gate, few = self.word_inputs(stretch, depth, to, code, bit, by_kind, by_word, True)
                self.words.learn(x, gate, depth, bit, few)
            self.words.step()
        if tails:
            keys = np.sort(byte_keys(tails, tail_kinds)[0])
            begin, times = like(keys)
            text, hashes = key_hashes(keys[begin])
            for k, node, bit, at in byte_steps(self.layout, text, hashes):
                for a in range(0, len(bit), SLICE):
                    to = slice(a, a + SLICE)
                    x, gate = self.byte_inputs(k, bit[to], at[:, to], True)
                    self.bytes.learn(x, gate, node[to], bit[to], times=times[to])
                self.bytes.step()

    def word_logs(self, stretch: Stretch) -> np.ndarray:
        """log10 probability of each token's code, in the order of the texts."""
        total, part = np.zeros(stretch.n), np.ones(stretch.n)
        for depth, slices in stretch.steps():
            for to, code, bit, by_kind, by_word in slices:
                x, gate, few = self.word_inputs(stretch, depth, to, code, bit, by_kind, by_word, False)
                part[to] *= self.words.probability(depth, self.words.mixed(x, gate, few), bit)
            if depth % 16 == 15:  # long before it is too small for a double
                total += np.log10(part)
                part[:] = 1
        out = np.empty(stretch.n)
        out[stretch.order] = total + np.log10(part)
        return out

    def stretch_logs(self, stretches: list[Stretch]) -> np.ndarray:
        alike, which = Stretch.of_all(stretches)
        return self.word_logs(alike)[which]

    def byte_logs(self, words: list[bytes], kinds: np.ndarray) -> np.ndarray:
        """log10 probability of each word's bytes and closing blank."""
        keys, word = byte_keys(words, kinds)
        keys, which = np.unique(keys, return_inverse=True)
        logs = np.empty(len(keys))
        for a in range(0, len(keys), SLICE):
            text, hashes = key_hashes(keys[a : a + SLICE])
            total = np.ones(len(text))
            for k, node, bit, at in byte_steps(self.layout, text, hashes):
                x, gate = self.byte_inputs(k, bit, at, False)
                total *= self.bytes.probability(node, self.bytes.mixed(x, gate), bit)
            logs[a : a + SLICE] = np.log10(total)
        return np.bincount(word, logs[which], len(words))

    def packed(self) -> np.ndarray:
        return np.concatenate([self.words.packed(), self.bytes.packed()])

    def merged(self, sums: np.ndarray) -> None:
        n = len(self.words.packed())
        self.words.merged(sums[:n])
        self.bytes.merged(sums[n:])


def find_kinds(follows: np.ndarray) -> np.ndarray:
    """Groups (0..CLASSES-1) of words from (i, j) counts of j being the next frequent word after i.

    Spherical k-means of what each word's neighbours are beyond chance (positive log ratios), words weighted by the root of
    their counts, begun with the most frequent word and then whatever is farthest from all centres.
    """
    both = follows + follows.T + 0.0
    n, counts = len(both), (follows + follows.T).sum(1)
    if not both.any():
        return np.zeros(n, np.int64)
    chance = np.outer(counts, counts) / counts.sum()
    v = np.log(np.maximum((both + 0.1) / (chance + 0.1), 1))
    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    weight = np.sqrt(counts)
    centres = [int(counts.argmax())]
    while len(centres) < CLASSES:
        away = 1 - (v @ v[centres].T).max(1)
        if not ((away > APART) & (counts > 0)).any():
            break
        centres.append(int(np.where(away > APART, weight * away**2, 0).round(9).argmax()))
    c = v[centres]
    for _ in range(20):
        near = (v @ c.T).round(9).argmax(1)
        c = np.stack([(v * weight[:, None])[near == k].sum(0) if (near == k).any() else c[k] for k in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return near


class Texts:
    """Encoded texts: tokens, sizes of their pieces, words outside the tree in order."""

    def __init__(self, layout: Layout, ids: list[np.ndarray], tails: list[list[bytes]]) -> None:
        cuts = [[min(PIECE, len(i) - a) for a in range(0, len(i), PIECE)] for i in ids]
        flat = np.concatenate(ids)
        self.stretch = Stretch(layout, flat, np.array([s for c in cuts for s in c], np.int64))
        self.sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.tails = [w for t in tails for w in t]
        self.tail_kinds = self.stretch.kind[flat == layout.escape]
        self.text_of_tail = np.repeat(np.arange(len(ids)), [len(t) for t in tails])


def texts_of(layout: Layout, rows: Iterator[tuple[np.ndarray, list[bytes]]]) -> Iterator[Texts]:
    """About CHUNK tokens at once, by the order of the texts alone."""
    ids, tails, n = [], [], 0
    for i, t in rows:
        ids.append(i)
        tails.append(t)
        n += len(i)
        if n >= CHUNK:
            yield Texts(layout, ids, tails)
            ids, tails, n = [], [], 0
    if ids:
        yield Texts(layout, ids, tails)


def _encoded(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    yield from zip((np.frombuffer(x, np.int32) for x in batch.column("ids").to_pylist()), batch.column("tails").to_pylist(), strict=True)


def _added(parts: list[pa.Table]) -> pa.Table:
    got = pa.concat_tables(parts).group_by("w").aggregate([("t", "sum"), ("n", "sum")])
    return got.rename_columns([c.removesuffix("_sum") for c in got.column_names]).select(["w", "t", "n"])


def count_words(docs: DataFrame) -> DataFrame:
    """(w, t, n): word, its occurrences in training documents and in all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in (some for batch in batches for some in some_texts(batch)):
            for held in (False, True):
                texts = batch.filter(pc.equal(batch.column("held_out"), held)).column("text")
                if len(texts):
                    found = words_of(texts)[0].value_counts()
                    w = pa.concat_arrays([found.field("values").cast(pa.binary()), pa.array([END], pa.binary())])
                    times = pa.concat_arrays([found.field("counts"), pa.array([len(texts)], pa.int64())])
                    parts.append(pa.table({"w": w, "t": pa.array(np.zeros(len(w), np.int64)) if held else times, "n": times}))
                    n += len(w)
            if n > FLUSH:
                parts = [_added(parts)]
                n = len(parts[0])
                if 2 * n > FLUSH:
                    yield from parts[0].to_batches()
                    parts, n = [], 0
        if parts:
            yield from _added(parts).to_batches()

    rows = docs.select("held_out", "text").mapInArrow(count, "w binary, t long, n long")
    return cut(rows.groupBy("w").agg(F.sum("t").alias("c"), F.sum("n").alias("n")), "words")


def make_layout(words: DataFrame) -> tuple[Layout, np.ndarray, dict[str, int]]:
    """The layout, its kinds not yet known, the counts of its words, and totals N and V."""
    t = words.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2")
    ).first()
    top = words.filter((F.col("c") > 1) | ((F.col("w") == F.lit(END)) & (F.col("c") > 0))).orderBy(F.desc("c"), "w").limit(HEAD).toArrow()
    names, counts = top["w"].to_pylist(), top["c"].to_numpy().astype(np.float64)
    return Layout(names, counts, int(t.n - counts.sum()), t.n1, t.n2, t.n), counts, {"n": t.n, "v": t.v}


ENCODED = "row long, h long, doc_id long, held_out boolean, size long, base double, ids binary, tails array<binary>"


def encode(docs: DataFrame, layout, counts: np.ndarray) -> DataFrame:
    """Documents as numbers of words; h: a hash that deals and orders them."""
    logs = np.append(np.log10(counts + 1.0), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = layout.value
        heads, end = pa.array(known.words, pa.binary()), known.number.get(END, known.escape)
        for some in (some for batch in batches for some in some_texts(batch)):
            text = some.column("text")
            words, offsets = words_of(text)
            i = pc.fill_null(pc.index_in(words, value_set=heads.cast(pa.large_binary()).view(words.type) if pa.types.is_large_string(words.type) else heads.view(words.type)), known.escape).to_numpy(zero_copy_only=False)
            outside = np.concatenate([[0], np.cumsum(i == known.escape)])
            tails = words.filter(pa.array(i == known.escape)).cast(pa.binary())
            ids, ends = np.insert(i.astype(np.int32), offsets[1:], end), offsets + np.arange(len(offsets))
            lists = pa.ListArray.from_arrays(pa.array(outside[offsets].astype(np.int32)), tails)
            if end == known.escape:  # without training texts
                lists = pa.array([[*t, END] for t in lists.to_pylist()], pa.list_(pa.binary()))
            packed = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(ids)])
            base, size = np.add.reduceat(logs[ids], ends[:-1]), pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(some.column(c) for c in ("row", "h", "doc_id", "held_out")), size, pa.array(base), packed, lists],
                ["row", "h", "doc_id", "held_out", "size", "base", "ids", "tails"],
            )

    keyed = docs.select(F.monotonically_increasing_id().alias("row"), F.xxhash64("doc_id", "text").alias("h"), F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text")
    return cut(keyed.mapInArrow(run, ENCODED), "encoded", "zstd")


def _summed(rows: DataFrame, tasks: int) -> DataFrame:
    """(part, data) of (part, task, data): packed arrays added up, in two steps so that no group grows with the tasks."""

    def add(table: pa.Table) -> pa.Table:
        total = 0
        for data in table["data"].to_pylist():
            total = total + np.frombuffer(zstandard.decompress(data), np.int64)
        return pa.table({"part": table["part"][:1], "task": table["task"][:1], "data": pa.array([zstandard.compress(total.tobytes(), 1)], pa.binary())})

    kind = "part int, task int, data binary"
    groups = max(1, math.isqrt(tasks))
    some = rows.withColumn("task", F.col("task") % groups).groupBy("part", "task").applyInArrow(add, kind)
    return some.groupBy("part").applyInArrow(add, kind).select("part", "data")


def fitted(counts: np.ndarray) -> np.ndarray:
    """Both counts of a slot halved together until they are what floats hold exactly; a count above 0 stays above 0."""
    bits = np.frexp(counts.max(1).astype(np.float64))[1]
    halved = counts >> np.maximum(bits - COUNT_BITS, 0)[:, None]
    return np.where(counts > 0, np.maximum(halved, 1), 0)


def count_contexts(training: DataFrame, layout, slots: int, tasks: int) -> np.ndarray:
    """Counts of all contexts in the training documents: (slots, 2)."""
    size = 2 * slots
    step = 2 * -(-slots // PARTS)  # both counts of a slot in one part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, flat = layout.value, np.zeros(size, np.int32)
        tally = Tally(known, flat)
        for texts in texts_of(known, (r for b in batches for r in _encoded(b))):
            tally.add(texts.stretch, texts.tails, texts.tail_kinds)
        tally.done()
        task = TaskContext.get().partitionId()
        parts = [zstandard.compress(flat[a : a + step].astype(np.int64).tobytes(), 1) for a in range(0, size, step)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([task] * len(parts), pa.int32()), pa.array(parts, pa.binary())], ["part", "task", "data"])

    rows = training.select("ids", "tails").coalesce(tasks).mapInArrow(run, "part int, task int, data binary")
    out = np.zeros(size, np.int32)
    for r in _summed(rows, tasks).toArrow().to_pylist():  # PARTS rows of a table of bounded size
        x = np.frombuffer(zstandard.decompress(r["data"]), np.int64)
        out[r["part"] * step : r["part"] * step + len(x)] = fitted(x.reshape(-1, 2)).ravel()
    return out.reshape(-1, 2)


def count_follows(training: DataFrame, n: int, end: int, tasks: int) -> np.ndarray:
    """(n, n): how often each of the n most frequent words is the next of them after each; none across the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(n * n, np.int64)
        for batch in batches:
            flat = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32).astype(np.int64)
            flat = flat[(flat < n) | (flat == end)]
            pairs = (flat[:-1] != end) & (flat[1:] != end)
            sums += np.bincount((flat[:-1] * n + flat[1:])[pairs], minlength=n * n)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], ["i", "x"])

    got = training.select("ids").coalesce(tasks).mapInArrow(run, "i int, x long").groupBy("i").agg(F.sum("x").alias("x")).toArrow()  # at most TOP squared rows
    out = np.zeros(n * n)
    out[got["i"].to_numpy()] = got["x"].to_numpy()
    return out.reshape(n, n)


def learn_weights(training: DataFrame, model, weights: int, blocks: int) -> np.ndarray:
    """Sums over blocks of what their learners arrive at; each begins anew and reads its documents by their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((b, row) for batch in batches for b, row in zip(batch.column("block").to_pylist(), _encoded(batch), strict=True))
        total = 0
        model.value.settle(True)
        for _, block in groupby(rows, key=itemgetter(0)):
            learner = model.value.beginner()
            for texts in texts_of(learner.layout, (row for _, row in block)):
                learner.learn(texts.stretch, texts.tails, texts.tail_kinds)
            total = total + learner.packed()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.atleast_1d(total)[at], pa.int64())], ["i", "x"])

    dealt = training.select(F.pmod("h", F.lit(blocks)).alias("block"), "h", "ids", "tails").repartition("block").sortWithinPartitions("block", "h")
    got = dealt.mapInArrow(run, "i int, x long").groupBy("i").agg(F.sum("x").alias("x")).toArrow()  # a row a weight or cell
    out = np.zeros(weights, np.int64)
    out[got["i"].to_numpy()] = got["x"].to_numpy()
    return out


def fit(docs: DataFrame) -> tuple[DataFrame, DataFrame, Model, dict[str, int]]:
    """Encoded documents, word table, model and totals, of docs (doc_id, text, held_out)."""
    share = docs.sparkSession.sparkContext.broadcast
    words = count_words(docs)
    layout, counts, totals = make_layout(words)
    shared = share(layout)
    encoded = encode(docs, shared, counts)
    shared.destroy()  # what it served is written
    training = encoded.filter("not held_out")
    tasks = 1 + totals["n"] // TASK
    top = min(TOP, layout.escape)
    if top:
        layout.kinds[:top] = find_kinds(count_follows(training, top, layout.number.get(END, -1), tasks))
        layout.kinds[layout.number[END]] = CLASSES
    shared = share(layout)
    table = count_contexts(training, shared, layout.slots, tasks)
    shared.destroy()
    count_head(layout, table)
    model = Model(layout, table)
    del table  # the driver holds one copy
    shared = share(model)
    model.merged(learn_weights(training, shared, len(model.packed()), 1 + totals["n"] // BLOCK))
    shared.destroy()
    return encoded, words, model, totals


_TAIL = pa.list_(pa.struct([("w", pa.binary()), ("s", pa.float64()), ("m", pa.int64())]))
SCORED = [("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("size", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("lp", pa.float64()), ("tail", _TAIL)]


def tree_scores(texts: list[Texts], model: Model) -> tuple[np.ndarray, pa.Array]:
    """Of each text the log10 probability of its codes, and its other words with their kind's spelling and their number."""
    logs = np.concatenate([[0.0], np.cumsum(model.stretch_logs([t.stretch for t in texts]))])
    sizes = np.concatenate([t.sizes for t in texts])
    ends, first = np.cumsum(sizes), np.cumsum([0, *(len(t.sizes) for t in texts)]).tolist()
    words = pa.array([w for t in texts for w in t.tails], pa.binary()).dictionary_encode()
    n = max(1, len(words.dictionary))
    spelled, of = np.unique(np.concatenate([t.tail_kinds for t in texts]) * n + words.indices.to_numpy(), return_inverse=True)
    found, times = np.unique(np.concatenate([t.text_of_tail + a for t, a in zip(texts, first, strict=False)]) * max(1, len(spelled)) + of, return_counts=True)
    text, of = np.divmod(found, max(1, len(spelled)))
    names = words.dictionary.take(pa.array(spelled % n))
    scores = model.byte_logs(names.to_pylist(), spelled // n) if len(spelled) else np.zeros(0)
    tails = pa.StructArray.from_arrays([names.take(pa.array(of)), pa.array(scores[of]), pa.array(times)], fields=list(_TAIL.value_type))
    return logs[ends] - logs[ends - sizes], pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(sizes) + 1)).astype(np.int32)), tails).cast(_TAIL)


def score_documents(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", (crc_mod("doc_id", FOLDS) == HELD_OUT).alias("held_out"))
    encoded, words, fitted, totals = fit(docs)
    n, v = totals["n"], totals["v"]
    model = spark.sparkContext.broadcast(fitted)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        known.settle(False)
        for batch in batches:
            a, sizes = 0, pc.binary_length(batch.column("ids")).to_numpy() // 4
            upto = np.cumsum(sizes)
            while a < len(sizes):
                b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + GATHER)))
                some = batch.slice(a, b - a)
                rows = list(_encoded(some))
                lp, tails = tree_scores(list(texts_of(known.layout, iter(rows))), known)
                outside = np.fromiter((len(r[1]) for r in rows), np.int64, len(rows))
                yield pa.RecordBatch.from_arrays(
                    [*(some.column(c) for c in ("row", "doc_id", "held_out")), pa.array(sizes[a:b].astype(np.int64)), some.column("size"), pa.array(sizes[a:b] - outside), some.column("base"), pa.array(lp), tails],
                    [name for name, _ in SCORED],
                )
                a = b

    kinds = "row long, doc_id long, held_out boolean, n_tokens long, size long, known long, base double, lp double, tail array<struct<w binary, s double, m long>>"
    done = cut(encoded.mapInArrow(score, kinds), "texts", "zstd")
    model.destroy()
    drop_cut(encoded)
    rare = done.select("row", F.explode("tail").alias("x")).select("row", "x.w", "x.s", "x.m")
    found = rare.join(words.select("w", "c"), "w")
    share, outside = fitted.layout.known_share, float(max(1, fitted.layout.outside))
    counted = F.log10(F.col("c") * F.lit(share / outside) + F.pow(F.lit(10.0), F.col("s")) * F.lit(1 - share))
    lp = F.when(F.col("c") > 0, counted).otherwise(F.col("s") + F.lit(math.log10(1 - share)))
    m = F.col("m")
    extra = found.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, m).otherwise(0)).alias("known2"), F.sum(m * F.log10(F.col("c") + 1.0)).alias("base2"), F.sum(m * lp).alias("lp2"))
    out = done.drop("tail").join(extra, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    score_of = plus("lp", "lp2")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        plus("known", "known2").cast("long").alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (plus("base", "base2") - F.col("n_tokens") * F.lit(math.log10(n + v + 1))).alias("base_score"),
        score_of.alias("score"),
        (-score_of / math.log10(2) / F.greatest(F.col("size"), F.lit(1))).alias("bits_per_byte"),
    )
