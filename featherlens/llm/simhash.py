"""Near-duplicate detection: 64-bit SimHash fingerprints linked through Golay-code keys.

A fingerprint is split into three segments. A segment's keys are the codewords of the perfect (23, 12) Golay code that the
segment and its one-bit neighbours decode to (one or six of 4096): two words with at most two errors between them always
share one, because both reach the word between them. With at most four differing bits in all, either some segment is equal
and another has at most two errors, or two segments have exactly one error each and the third at most two. So the join
keys are

* segment i as it is with a codeword of segment j, for each ordered pair: about 6 x 5.3 rows, 33-34 bit keys;
* a half of segment i and a half of segment j, of which some are equal, with a codeword of the third segment: 12 x 5.3
  rows. One error turns a segment's parity, so one side's key also holds the parities of i and j, the other's their
  opposites: 35-36 bits.

Every meeting is verified by counting the differing bits, so no link is lost and none is false.

Large groups of near copies would meet in all their pairs. Therefore fingerprints are first linked to a few pivots of each
segment bucket (linear work) and contracted. Then only keys under which more than one component meets are joined at all,
and a key with many rows is joined by the highest bit in which two components' names differ, under which fingerprints of
one component never meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, permutations, product, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, quoted, raw_bytes, row_hash
from .components import components

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: (shift, bits) of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
HALF_BITS = 11
HALF = (1 << HALF_BITS) - 1
PIVOTS = 4
#: Fingerprints that one task expands to keys, about 190 rows each.
EXPAND_ROWS = 20_000
#: Meetings under one key from which on it is joined by differing bits; and keys that are broadcast.
MANY, MAX_BROADCAST_KEYS = 4096, 500_000
#: Fixed value: generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0b110001110101


def fingerprint(text: bytes) -> int:
    """The contract's fingerprint of one text, as a signed 64-bit integer."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - SHINGLE + 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[:n].tolist()
    stops = (ends - 1)[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter(map(digest, map(joined.__getitem__, map(slice, starts, stops)), repeat(SEED)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        counts += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


@F.arrow_udf(T.LongType())
def fingerprint_udf(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in texts:
        yield pa.array([fingerprint(x) for x in raw_bytes(column)], pa.int64())


class Golay:
    """Nearest codewords of 23-bit words, in bulk."""

    def __init__(self) -> None:
        shifted = np.arange(1 << 12, dtype=np.int64) << 11
        for bit in range(22, 10, -1):
            shifted = np.where(shifted >> bit & 1, shifted ^ (GENERATOR << (bit - 11)), shifted)
        self.remainder = shifted
        self.error = np.zeros(1 << 11, np.int64)
        patterns = [0, *(sum(1 << b for b in bits) for w in (1, 2, 3) for bits in combinations(range(23), w))]
        patterns = np.array(patterns, np.int64)
        self.error[self.syndrome(patterns)] = patterns

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return (words & 0x7FF) ^ self.remainder[words >> 11]

    def decode(self, words: np.ndarray) -> np.ndarray:
        """Index (0 to 4095) of the one codeword within three bits."""
        return (words ^ self.error[self.syndrome(words)]) >> 11

    def keys(self, words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """For each word the distinct codewords that it and its one-bit neighbours decode to: (n, 6) and which are real."""
        around = np.concatenate([words[:, None], words[:, None] ^ (1 << np.arange(bits))], axis=1)
        found = np.sort(self.decode(around), axis=1)
        new = np.concatenate([np.ones((len(words), 1), bool), found[:, 1:] != found[:, :-1]], axis=1)
        order = np.argsort(~new, axis=1, kind="stable")[:, :6]
        return np.take_along_axis(found, order, 1), np.take_along_axis(new, order, 1)


def segments(fps: np.ndarray) -> list[np.ndarray]:
    u = fps.view(np.uint64)
    return [(u >> np.uint64(s) & np.uint64((1 << b) - 1)).astype(np.int64) for s, b in SEGMENTS]


def join_keys(fps: np.ndarray, golay: Golay, index: bool) -> tuple[np.ndarray, np.ndarray]:
    """(position, key) rows of the fingerprints for one side of the join."""
    segs = segments(fps)
    sets = [golay.keys(s, b) for s, (_, b) in zip(segs, SEGMENTS, strict=True)]
    rows, keys = [], []
    at = np.arange(len(fps))
    for family, (i, j) in enumerate(permutations(range(3), 2)):
        found, real = sets[j]
        key = (family << 40) | (segs[i][:, None] << 12) | found
        rows.append(np.broadcast_to(at[:, None], real.shape)[real])
        keys.append(key[real])
    family = 6
    for k in range(3):
        i, j = (x for x in range(3) if x != k)
        found, real = sets[k]
        parity = ((np.bitwise_count(segs[i]) & 1) * 2 + (np.bitwise_count(segs[j]) & 1)).astype(np.int64)
        for low_i, low_j in product((True, False), repeat=2):
            halves = [x & HALF if low else x >> HALF_BITS for x, low in ((segs[i], low_i), (segs[j], low_j))]
            key = ((((parity if index else 3 - parity) << HALF_BITS) | halves[0]) << HALF_BITS) | halves[1]
            rows.append(np.broadcast_to(at[:, None], real.shape)[real])
            keys.append(((family << 40) | (key[:, None] << 12) | found)[real])
            family += 1
    return np.concatenate(rows), np.concatenate(keys)


def _side(nodes: DataFrame, index: bool) -> DataFrame:
    """(key, fp, comp) rows from (fp, comp)."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in batches:
            fps, comps = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for a in range(0, len(fps), 2000):
                fp, comp = fps[a : a + 2000], comps[a : a + 2000]
                at, key = join_keys(fp, golay, index)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[at]), pa.array(comp[at])], ["key", "fp", "comp"])

    return nodes.select("fp", "comp").mapInArrow(expand, "key long, fp long, comp long")


def pivot_links(fps: DataFrame) -> DataFrame:
    """Verified links of fingerprints to a few pseudo-random members of each of their exact segment buckets."""
    seg = [F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << b) - 1)) for s, b in SEGMENTS]
    keyed = fps.select("fp", F.explode(F.array(*[x + F.lit(n << 40) for n, x in enumerate(seg)])).alias("key"))
    order = lambda r: F.struct(F.xxhash64(F.lit(r), "fp").alias("k"), F.col("fp").alias("fp"))
    buckets = keyed.groupBy("key").agg(F.count("*").alias("n"), *[F.min(order(r)).alias(f"p{r}") for r in range(PIVOTS)]).filter("n > 1")
    pivots = buckets.select("key", F.array(*[f"p{r}.fp" for r in range(PIVOTS)]).alias("pivots"))
    near = F.filter("pivots", lambda p: (p != F.col("fp")) & (F.bit_count(p.bitwiseXOR(F.col("fp"))) <= MAX_BITS))
    return keyed.join(pivots, "key").select("fp", F.explode(near).alias("v")).select(F.col("fp").alias("u"), "v").distinct()


def meetings(nodes: DataFrame) -> DataFrame:
    """Pairs (fa, ca, fb, cb) of different components of the written (fp, comp) that meet under a key, not yet verified."""
    tasks = -(-nodes.count() // EXPAND_ROWS)
    spread = nodes.repartition(max(1, tasks), "fp")
    a = _side(spread, True).select("key", F.col("fp").alias("fa"), F.col("comp").alias("ca"))
    b = _side(spread, False).select("key", F.col("fp").alias("fb"), F.col("comp").alias("cb"))
    every = a.select("key", F.col("ca").alias("c"), F.lit(1).alias("a")).unionAll(b.select("key", F.col("cb").alias("c"), F.lit(0).alias("a")))
    found = every.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.sum("a").alias("na"), F.sum(1 - F.col("a")).alias("nb"))
    mixed = cut(found.filter("lo <> hi and na > 0 and nb > 0").select("key", (F.col("na") * F.col("nb") > MANY).alias("many")), "keys")
    few = mixed.count() <= MAX_BROADCAST_KEYS
    a, b = (x.join(F.broadcast(mixed) if few else mixed, "key") for x in (a, b))
    plain = a.filter("not many").drop("many").join(b.filter("not many").drop("many"), "key").filter("ca <> cb")
    levels = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("level")
    above = lambda c: F.expr(f"if(level = 63, 0L, shiftrightunsigned({c}, level + 1))").alias("above")
    bit = lambda c: F.expr(f"shiftrightunsigned({c}, level) & 1L")
    ours = a.filter("many").select("key", "fa", "ca", levels).select("*", above("ca"), bit("ca").alias("bit"))
    theirs = b.filter("many").select("key", "fb", "cb", levels).select("*", above("cb"), (1 - bit("cb")).alias("bit"))
    by_bit = ours.join(theirs, ["key", "level", "above", "bit"])
    return plain.select("fa", "ca", "fb", "cb").unionAll(by_bit.select("fa", "ca", "fb", "cb"))


def fingerprint_components(fps: DataFrame) -> DataFrame:
    """Distinct (fp) -> (node, root): the components of at most MAX_BITS differing bits, nodes without a link left out."""
    first = components(pivot_links(fps))
    nodes = fps.join(first.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("comp"))
    nodes = cut(nodes.distinct(), "nodes")
    near = F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= MAX_BITS
    second = components(meetings(nodes).filter(near).select(F.col("ca").alias("u"), F.col("cb").alias("v")))
    top = second.select(F.col("node").alias("comp"), F.col("root").alias("top"))
    return nodes.join(top, "comp", "left").select(F.col("fp").alias("node"), F.coalesce("top", "comp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, text_hash."""
    return rooted_duplicates(docs.select(id_col, text_col), id_col, text_col).drop("root", "row_hash")


def rooted_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """near_duplicates, root (the fingerprint that names the component) and row_hash (of all columns).

    A null or empty text has no words and fingerprint zero, which links like any other. component_id is the smallest
    non-null id reachable; rows with a null id take part and get the id of their component (null if it has none).
    Repeated rows each get their row. Other columns are ignored, whatever their names.
    """
    marked = docs.select(F.col(id_col).alias("doc_id"), fingerprint_udf(F.col(text_col)).alias("fp"), F.xxhash64(text_col).alias("text_hash"), row_hash(docs).alias("row_hash"))
    marked = cut(marked, "fingerprints")
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = cut(fingerprint_components(distinct.select("fp")), "roots")
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp")
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_fp = rooted.join(ids, "root").select("fp", "component_id", "root")
    out = marked.join(of_fp, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "text_hash", "root", "row_hash")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """Keeps one document of each component: the row with the smallest id.

    Ties: the smallest text hash, then the smallest hash of all columns; of rows equal in every column, one.
    """
    found = rooted_duplicates(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "row_hash")).alias("m")
    row = lambda i, t, r: F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("-")), t.cast("string"), r.cast("string"))
    keep = found.groupBy("root").agg(first).select(row(F.col("m.doc_id"), F.col("m.text_hash"), F.col("m.row_hash")).alias("row"))
    rows = docs.select(row(F.col("doc_id"), F.xxhash64("text"), row_hash(docs)).alias("row"), F.struct(*quoted(docs)).alias("doc"))
    return rows.join(keep.distinct(), "row", "left_semi").dropDuplicates(["row"]).select("doc.*")
