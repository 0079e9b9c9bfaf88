"""Toxicity by compression distance: two trained zstandard dictionaries, compared window by window.

A text's words (lower-cased, ASCII letters, digits and non-ASCII bytes) go in windows of WINDOW; a window is the distinct
words among them, each written as a hash of CODE bytes. So a match in compression means a common word, not common
syllables, and is as long for a short word as for a long one.

Both dictionaries are zstandard's own training (train_dictionary), loaded with their entropy tables: one on windows of
ordinary labelled texts, one on windows of toxic labelled texts. Labels mark texts and not windows, and most of a toxic
text is ordinary; therefore the toxic windows are cleaned before training: only words stay that at least LEAST toxic texts
of the sample hold and that are CLEAN times as frequent among ordinary texts at most. Copies and near copies in the sample
are left out, or all words of a copied text would look toxic.

Each window is compressed with both dictionaries. What it saves against its plain length under the toxic dictionary, and
how that compares with the ordinary one, are a text's measures: largest savings, means, the share of windows over the
threshold MARKED, number of windows. A logistic calibration fitted on labelled texts turns them into a score, whose
threshold is 0.5. Each half of the sample is measured with dictionaries of the other half, so no text is measured with a
dictionary that has seen it; texts are scored with dictionaries of the whole sample.

The sample of labelled texts is bounded by PER_CLASS; a text of any length may be in it, and all its windows are trained on.
Whole texts are measured, coded and told from copies where they are; the driver gets the sample's codes. Which of two copies
stays, and which half a text is in, hangs on the texts' hashes, not on ids. Repeated rows of an id and text count once.

Nothing but the text goes into a score. Null and empty texts have one empty window. With fewer than four labels of a kind
the score is the share of label 1 among all labels (0.5 without any).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, cut, free_name, raw_bytes
from .labelled import labelled_sample, measured

FOLDS, HELD_OUT = 5, 0
#: Labelled documents of label 0 and 1 in the sample.
PER_CLASS = (5000, 3000)
WINDOW, CODE = 10, 16
#: Toxic texts that hold a word, and its share of ordinary texts over its share of toxic ones, for it to stay.
LEAST, CLEAN = 2, 0.1
ORDINARY_BYTES, TOXIC_BYTES = 16384, 8192
#: Segment and word length of the dictionaries' training.
SEGMENT, GRAM = 32, 8
#: Words of a shingle, and bands of minimum hashes that tell copies in the sample.
SHINGLE, BANDS, BAND = 5, 6, 3
#: Codes that a worker remembers.
MEMORY = 300_000
#: Savings from this many bytes on count as toxic windows.
MARKED = 3
_KEEP = set(b"abcdefghijklmnopqrstuvwxyz0123456789") | set(range(128, 256))
_TABLE = bytes(c if c in _KEEP else 0x20 for c in bytes(range(256)).lower())
_FACTORS = np.random.default_rng(12).integers(0, 1 << 63, (BANDS, BAND), dtype=np.uint64) | np.uint64(1)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def windows_of(text: bytes) -> list[list[bytes]]:
    """Distinct words of each run of WINDOW words; one empty window if there are none."""
    words = words_of(text)
    return [list(dict.fromkeys(words[i : i + WINDOW])) for i in range(0, len(words), WINDOW)] or [[]]


class _Codes(dict):
    def __missing__(self, word: bytes) -> bytes:
        code = xxhash.xxh3_128_digest(word)[:CODE]
        if len(self) < MEMORY:
            self[word] = code
        return code

    def of(self, window: list[bytes]) -> bytes:
        return b"".join(map(self.__getitem__, window))


def bands(text: bytes) -> list[str]:
    """Minimum hashes of the word shingles; texts that share one are copies or near copies."""
    words = words_of(text)
    grams = {b" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64, len(grams))
    return [f"{b}:" + ((h[:, None] * _FACTORS[b]) >> np.uint64(20)).min(0).tobytes().hex() for b in range(BANDS)]


def outline(text: bytes) -> bytes:
    """A text's bands and the codes of each of its windows, packed."""
    codes = _Codes()
    return "|".join(bands(text)).encode() + b"\n" + b"".join(bytes([len(w)]) + codes.of(w) for w in windows_of(text))


def unalike(outlines: list[tuple[bytes, int]]) -> list[tuple[list[bytes] | None, int]]:
    """(coded windows, label) of each outline; None as windows if the text is a copy or near copy of one before."""
    seen: set[bytes] = set()
    out = []
    for packed, y in outlines:
        head, _, body = packed.partition(b"\n")
        keys, windows, at = head.split(b"|"), [], 0
        if seen.isdisjoint(keys):
            while at < len(body):
                end = at + 1 + CODE * body[at]
                windows.append(body[at + 1 : end])
                at = end
            out.append((windows, y))
        else:
            out.append((None, y))
        seen.update(keys)
    return out


class Distance:
    """What a text's windows save under two dictionaries."""

    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        self.ordinary, self.toxic = ordinary, toxic
        self.compressors = None

    def __getstate__(self):
        return self.ordinary, self.toxic

    def __setstate__(self, state) -> None:
        self.__init__(*state)

    def _compressor(self, content: bytes):
        params = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_GREEDY, min_match=5, window_log=17, hash_log=16, chain_log=16, search_log=6, write_content_size=False, write_checksum=False, write_dict_id=False)
        if not content:
            return zstandard.ZstdCompressor(compression_params=params).compress
        held = zstandard.ZstdCompressionDict(content)
        held.precompute_compress(compression_params=params)
        return zstandard.ZstdCompressor(dict_data=held, compression_params=params).compress

    def savings(self, windows: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Bytes that each window is shorter than uncompressed, under the ordinary and the toxic dictionary."""
        if self.compressors is None:
            self.compressors = self._compressor(self.ordinary), self._compressor(self.toxic)
            self.codes = _Codes()
            # a window of a single word that no dictionary knows costs this much more than its length
            strange = self.codes.of([b"\x00"])
            self.frame = [len(c(strange)) - len(strange) for c in self.compressors]
        coded = list(map(self.codes.of, windows))
        plain = np.fromiter(map(len, coded), np.int64, len(coded))
        return tuple(np.maximum(plain + f - np.fromiter(map(len, map(c, coded)), np.int64, len(coded)), 0) for c, f in zip(self.compressors, self.frame, strict=True))

    def features(self, text: bytes) -> list[float]:
        ordinary, toxic = self.savings(windows_of(text))
        top, marked = np.sort(toxic)[::-1][:3], toxic >= MARKED
        share = marked.mean()
        return [top[0], top[:2].mean(), top.mean(), toxic.mean(), share, math.sqrt(share), math.log1p(len(toxic)), marked.sum() ** 0.5, ordinary.mean(), (toxic - ordinary).max()]


def trained(windows: list[bytes], size: int) -> bytes:
    """zstandard's dictionary of the windows, as large as they allow."""
    windows = [w for w in windows if len(w) >= GRAM]
    while size >= 256:
        try:
            return zstandard.train_dictionary(size, windows, k=SEGMENT, d=GRAM).as_bytes()
        except zstandard.ZstdError:  # too little to fill that size
            size //= 2
    return b""


def codes_of(window: bytes) -> list[bytes]:
    return [window[i : i + CODE] for i in range(0, len(window), CODE)]


def dictionaries(texts: list[tuple[list[bytes], int]]) -> Distance:
    """Of the coded windows of ordinary texts and the cleaned windows of toxic texts."""
    held, n = (Counter(), Counter()), [0, 0]
    for windows, y in texts:
        held[y].update({code for window in windows for code in codes_of(window)})
        n[y] += 1
    stays = {w for w, k in held[1].items() if k >= LEAST and held[0][w] * n[1] < CLEAN * k * n[0]}
    toxic = [b"".join(code for code in codes_of(window) if code in stays) for windows, y in texts if y for window in windows]
    ordinary = [window for windows, y in texts if not y for window in windows]
    return Distance(trained(ordinary, ORDINARY_BYTES), trained(toxic, TOXIC_BYTES))


class Model:
    def __init__(self, prior: float) -> None:
        self.prior, self.weights = prior, None

    def calibrate(self, distance: Distance, x: np.ndarray, y: np.ndarray) -> None:
        """Fits the logistic weights of measures x and labels y; texts are scored with distance."""
        self.distance = distance
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        x = self._design(x)
        each = np.array([(y == 0).mean(), (y == 1).mean()])
        w = np.where(y == 1, self.prior / each[1], (1 - self.prior) / each[0])
        beta = np.zeros(x.shape[1])
        for _ in range(30):  # Newton steps of the ridge-penalised likelihood
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            grad = x.T @ (w * (y - p)) - 0.5 * beta
            hess = (x.T * (w * p * (1 - p))) @ x + 0.5 * np.eye(x.shape[1])
            beta += np.clip(np.linalg.solve(hess, grad), -2, 2)
        self.weights = beta

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.concatenate([z, z[:, :1] * z[:, 6:7], z[:, 4:5] * z[:, 6:7], np.ones((len(z), 1))], 1)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.weights is None or not texts:
            return np.full(len(texts), self.prior)
        x = self._design(np.array([self.distance.features(t) for t in texts]))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    sample, counts = labelled_sample(docs, labels.filter(crc_mod("doc_id", FOLDS) != HELD_OUT), "toxic", PER_CLASS)
    sample = cut(sample, "labelled")  # read twice: outlines, then measures
    total = sum(counts.values())
    model = Model(counts.get(1, 0) / total if total else 0.5)
    outlines = unalike(measured(sample, outline))
    kept = [i for i, (windows, _) in enumerate(outlines) if windows is not None]
    y = np.array([outlines[i][1] for i in kept], np.float64)
    if min((y == 0).sum(), (y == 1).sum()) < 4:
        return model
    halves = kept[0::2], kept[1::2]
    of_half = [dictionaries([outlines[i] for i in half]) for half in halves]
    both = measured(sample, lambda text: np.array([d.features(text) for d in of_half]).tobytes())
    # a text is measured with the other half's dictionaries
    x = {i: np.frombuffer(both[i][0]).reshape(2, -1)[1 - h] for h, half in enumerate(halves) for i in half}
    model.calibrate(dictionaries([outlines[i] for i in kept]), np.stack([x[i] for i in kept]), y)
    return model


def scored(docs: DataFrame, labels: DataFrame, name: str | None = None) -> DataFrame:
    """docs with their score, as __score or the given name."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    @F.arrow_udf(T.DoubleType())
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            yield pa.array(model.value.scores(raw_bytes(column)), pa.float64())

    return docs.withColumn(name or free_name(docs, "score"), score.asNondeterministic()("text"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    out = scored(docs.select("doc_id", "text"), labels, "__score")
    return out.select("doc_id", (crc_mod("doc_id", FOLDS) == HELD_OUT).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))
