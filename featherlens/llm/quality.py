"""Quality by nearest-neighbour voting among latent-semantic vectors of labelled documents.

A text's terms are trigrams of character classes (upper and lower case, digits, blanks, line ends, kinds of punctuation,
other symbols, non-ASCII), which don't hang on a language's words, and graded terms for its shape: share of distinct
words and lines, of words that repeat the one before, of capitals, symbols and line ends, and length. Their weights (damped
frequency times inverse document frequency) of a bounded sample of labelled documents, long and short alike, are counted
where the texts are and reduced by a truncated singular value decomposition. The sample's unit vectors are broadcast; every document's cosines with all of them are computed in
blocks, exactly, and its NEIGHBOURS nearest vote with their similarity to the POWER times their class's weight (which
undoes the sample's class balance). Score: the share of label 1 in the vote.

Nothing but the text goes into a score. A null text counts as empty. If there are no labels, or no neighbour is at all
similar, the score is the share of label 1 among all labels (0.5 without any).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, free_name, quoted, raw_bytes
from .labelled import labelled_sample, measured

FOLDS, HELD_OUT = 3, 1
#: Labelled documents of label 0 and 1 in the sample.
PER_CLASS = (2500, 2500)
DIMENSIONS, NEIGHBOURS, POWER = 48, 15, 8
BLOCK = 512

_CLASS = np.full(256, 11, np.int64)  # non-ASCII
_CLASS[:128] = 10  # other symbols
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:", b"!?", b"'\"()-", b"|<>{}[]\\", b"@/_=")):
    _CLASS[list(_chars)] = _i
KINDS = 12
TRIGRAMS = KINDS**3
#: Centres of the graded terms of each shape.
GRADES = np.linspace(0, 1, 9)
SHAPES = 8
SHAPE_WEIGHT = 0.6
TERMS = TRIGRAMS + SHAPES * len(GRADES)


def shape(text: bytes, kinds: np.ndarray) -> list[float]:
    """Values from 0 to 1."""
    words, lines = text.split(), text.split(b"\n")
    n, size = max(1, len(words)), max(1, len(text))
    share = np.bincount(kinds, minlength=KINDS) / size
    again = sum(map(bytes.__eq__, words, words[1:])) / n
    log_distinct = np.log1p(len(set(words))) / np.log1p(n)
    return [len(set(words)) / n, log_distinct, again, len(set(lines)) / len(lines), min(1.0, 2 * share[1]), min(1.0, 4 * (share[10] + share[6] + share[8])), min(1.0, 20 * share[4]), min(1.0, np.log1p(n) / 12)]


def terms(text: bytes) -> np.ndarray:
    """Raw term weights of one text."""
    out = np.zeros(TERMS, np.float32)
    if not text:
        return out
    kinds = _CLASS[np.frombuffer(text, np.uint8)]
    if len(kinds) > 2:
        counts = np.zeros(TRIGRAMS, np.int64)
        for a in range(0, len(kinds) - 2, 1 << 18):
            k = kinds[a : a + (1 << 18) + 2]
            counts += np.bincount((k[:-2] * KINDS + k[1:-1]) * KINDS + k[2:], minlength=TRIGRAMS)
        out[:TRIGRAMS] = np.sqrt(counts / (len(kinds) - 2))
    grades = np.maximum(0, 1 - np.abs(np.array(shape(text, kinds))[:, None] - GRADES) * (len(GRADES) - 1))
    out[TRIGRAMS:] = grades.ravel()
    return out


def packed_terms(text: bytes) -> bytes:
    return zlib.compress(terms(text).tobytes(), 1)

#: Decimal places from which on cosines count as equal.
TIE_PLACES = 5


class Neighbours:
    """Latent-semantic vectors of labelled texts."""

    def __init__(self, sample: list[tuple[bytes, int]], counts: dict[int, int]) -> None:
        """sample: (packed terms, label) of each text."""
        total = sum(counts.values())
        self.prior = counts.get(1, 0) / total if total else 0.5
        self.labels = np.array([y for _, y in sample], np.int64)
        m = np.frombuffer(b"".join(zlib.decompress(t) for t, _ in sample), np.float32).reshape(len(sample), TERMS).copy()
        self.idf = np.log((1 + len(m)) / (1 + (m > 0).sum(0))).astype(np.float32) + 0.1
        self.idf[TRIGRAMS:] = 1
        w = self.weighted(m)
        # truncated singular value decomposition by subspace iteration
        axes = np.random.default_rng(8).standard_normal((w.shape[1], DIMENSIONS + 16)).astype(np.float32)
        for _ in range(4):
            axes = np.linalg.qr(w.T @ (w @ axes))[0]
        turn = np.linalg.eigh((w @ axes).T @ (w @ axes))[1][:, ::-1][:, :DIMENSIONS]
        self.axes = np.ascontiguousarray(axes @ turn, np.float32)
        self.vectors = self.unit(w @ self.axes)
        each = np.bincount(self.labels, minlength=2)
        self.votes = np.array([counts.get(y, 0) / max(1, each[y]) for y in (0, 1)], np.float32)[self.labels]

    def weighted(self, m: np.ndarray) -> np.ndarray:
        m = m * self.idf
        a, b = m[:, :TRIGRAMS], m[:, TRIGRAMS:]
        a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-9)
        b *= SHAPE_WEIGHT / np.sqrt(SHAPES)
        return m

    @staticmethod
    def unit(m: np.ndarray) -> np.ndarray:
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if not len(self.vectors):
            return out
        k = min(NEIGHBOURS, len(self.vectors))
        for a in range(0, len(texts), BLOCK):
            cosines = self.unit(self.weighted(np.stack([terms(t) for t in texts[a : a + BLOCK]])) @ self.axes) @ self.vectors.T
            out[a : a + BLOCK] = self.voted(np.round(cosines, TIE_PLACES), k)
        return np.clip(out, 0, 1)

    def voted(self, cosines: np.ndarray, k: int) -> np.ndarray:
        """Weighted share of label 1 among the k nearest; those tied at the k-th place share the places that are left."""
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        taken = np.take_along_axis(cosines, near, 1)
        votes = np.maximum(taken, 0) ** POWER * self.votes[near]
        total, ones = votes.sum(1), (votes * self.labels[near]).sum(1)
        last = taken.min(1, keepdims=True)
        for i in np.flatnonzero((cosines >= last).sum(1) > k):
            above, tied = cosines[i] > last[i], cosines[i] == last[i]
            share = above + tied * ((k - above.sum()) / tied.sum())
            vote = share * np.maximum(cosines[i], 0) ** POWER * self.votes
            total[i], ones[i] = vote.sum(), (vote * self.labels).sum()
        return np.where(total > 1e-12, ones / np.maximum(total, 1e-12), self.prior)


def fit(docs: DataFrame, labels: DataFrame) -> Neighbours:
    sample, counts = labelled_sample(docs, labels.filter(crc_mod("doc_id", FOLDS) != HELD_OUT), "quality", PER_CLASS)
    return Neighbours(measured(sample, packed_terms), counts)


def scored(docs: DataFrame, labels: DataFrame, learn_from: DataFrame | None = None, name: str = "__score") -> DataFrame:
    """docs with their score; learn_from: where the labelled rows' texts are (docs by default)."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs if learn_from is None else learn_from, labels))

    @F.arrow_udf(T.DoubleType())
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            yield pa.array(model.value.scores(raw_bytes(column)))

    return docs.withColumn(name, score.asNondeterministic()("text"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    out = scored(docs.select("doc_id", "text"), labels)
    return out.select("doc_id", (crc_mod("doc_id", FOLDS) == HELD_OUT).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """The documents that aren't rejected, with their columns."""
    name = free_name(docs, "score")
    return scored(docs, labels, learn_from, name).filter(F.col(name) >= 0.5).select(*quoted(docs))
