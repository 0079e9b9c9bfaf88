"""N-gram Jaccard join: documents whose sets of word shingles overlap by nine tenths, found in prefix trees.

Two sets at that similarity share a shingle among the first n - ceil(0.9 n) + 1 of each, in any order that holds for all sets.
Here shingles whose hash lies in the lowest fifth come first, the rarest of them first, the others follow by hash: so only that
fifth has to be counted over the corpus, and the first shingles of a document without copies are its own alone.

Equal sets are one class. A shingle that stands among the first ones of several classes of like size is a key, and a key's
classes meet in a trie: their whole sets, as sequences in one order (the shingles that most of them have come first, so that near copies share
long paths), with every path stored once. Each set walks the trie, carrying the overlap so far from node to node, and turns
back where the remaining lengths cannot reach nine tenths, or where everything below already belongs to its own component.
The overlap at a set's end is exact, so no link is lost and none is false (shingles are compared by 64-bit hashes).

Tries are filled in rounds, so that a set is sent to few of its keys. First each class goes under the one key with most members,
and of a key with many only parts meet, and the first of each part, which joins large families of copies. Of what may still link, classes and keys that hang together form blocks, and a block meets
as a whole if that sends its sets less often than its keys would. In other blocks the sets go under all keys where
components still meet whose members have not all met before, of keys with equal members one. A key of many classes is split into
parts of at most PART of them, and every two parts meet in a task of their own, so memory is bounded and no pair is left out.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, drop_cut, raw_bytes
from .components import components

SHINGLE = 3
SEED = 42
#: Word hashes that a task remembers; odd factors that mix them.
MEMORY = 300_000
MIX, FINISH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 90
#: The part of the hashes that comes first and is ordered by frequency.
LOWEST = (1 << 64) // 5
#: Classes in one side of a trie join.
PART = 800


class Hashes(dict):
    """64-bit hashes of words; so many are remembered that a task's memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, SEED)
        if len(self) < MEMORY:
            self[word] = h
        return h


def shingle_set(text: bytes, hashes: Hashes) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles, each mixed from its words' hashes."""
    words = text.lower().split()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    size = min(SHINGLE, len(h))
    n = len(h) - size + 1
    mixed = np.full(n, size, np.uint64)
    for i in range(size):
        mixed = (mixed + h[i : i + n]) * MIX
        mixed ^= mixed >> np.uint64(29)
    mixed *= FINISH
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


def prefix_size(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def lists(arrays: list[np.ndarray]) -> pa.Array:
    """Arrays of 64-bit words as one list column."""
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))


MARK = T.StructType([T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("short", T.IntegerType()), T.StructField("low", T.ArrayType(T.LongType())), T.StructField("rest", T.ArrayType(T.LongType()))])


@F.arrow_udf(MARK)
def mark_udf(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Of each text: the size and digest of its set, its shingles in the lowest fifth, how many these are short of the prefix,
    and that many of the others."""
    hashes = Hashes()
    for column in texts:
        sizes, digests, short, low, rest = [], [], [], [], []
        for text in raw_bytes(column):
            s = shingle_set(text, hashes)
            cut_at, p = int(np.searchsorted(s, np.uint64(LOWEST))), prefix_size(len(s)) if len(s) else 0
            sizes.append(len(s))
            digests.append(xxhash.xxh3_128_digest(s.tobytes()))
            short.append(p - cut_at)
            low.append(s[:cut_at])
            rest.append(s[cut_at : max(cut_at, p)])
        yield pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(short, pa.int32()), lists(low), lists(rest)], ["n", "digest", "short", "low", "rest"])


@F.arrow_udf(T.ArrayType(T.LongType()))
def set_udf(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    hashes = Hashes()
    for column in texts:
        yield lists([shingle_set(x, hashes) for x in raw_bytes(column)])


class Node:
    """A path of the trie: the tokens from depth start to depth, the sets low to high - 1 below, and own, which ends here."""

    __slots__ = ("children", "depth", "high", "largest", "low", "one", "own", "smallest", "start", "tokens")

    def __init__(self, start: int, depth: int, low: int, own: int) -> None:
        self.start, self.depth, self.low, self.high, self.own = start, depth, low, low + 1, own
        self.children: list[Node] = []
        self.one = own  # a set whose component all sets below are known to be in, or -1


def trie(sequences: list[np.ndarray]) -> Node:
    """The path-compressed trie of distinct sequences in lexicographic order."""
    root = Node(0, 0, 0, -1)
    path = [root]
    for i, seq in enumerate(sequences):
        shared = 0
        if i:
            m = min(len(seq), len(sequences[i - 1]))
            differ = np.flatnonzero(seq[:m] != sequences[i - 1][:m])
            shared = int(differ[0]) if len(differ) else m
        last = None
        while path[-1].depth > shared:
            last = path.pop()
            last.high = i
        if path[-1].depth < shared:
            middle = Node(last.start, shared, last.low, -1)
            middle.children = [last]
            last.start = shared
            path[-1].children[-1] = middle
            path.append(middle)
        leaf = Node(shared, len(seq), i, i)
        path[-1].children.append(leaf)
        path.append(leaf)
    for node in path:
        node.high = len(sequences)
    todo = [root]
    while todo:
        node = todo.pop()
        node.tokens = sequences[node.low][node.start : node.depth] if sequences else np.zeros(0, np.int64)
        below = [len(s) for s in sequences[node.low : node.high]]
        node.smallest, node.largest = min(below, default=0), max(below, default=0)
        if node.children:
            node.one = -1
        todo += node.children
    return root


def trie_links(index: list[np.ndarray], probes: list[np.ndarray] | None, parts: list) -> list[tuple[int, int]]:
    """Links (i, j) that join components: of all sets of index, or of index with probes, whose numbers follow index's.

    parts: the component of every set as known so far; sets of one component are not compared.
    """
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * PART))
    every = index + (probes or [])
    tokens, at, counts = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, -counts))] = np.arange(len(tokens))
    sequences = [np.sort(x) for x in np.split(rank[at], np.cumsum([len(x) for x in every])[:-1])]
    order = sorted(range(len(index)), key=lambda i: sequences[i].astype(">i8").tobytes())
    stored = [sequences[i] for i in order]
    root = trie(stored)
    first: dict = {}
    parent = [first.setdefault(c, i) for i, c in enumerate(parts)]

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links: list[tuple[int, int]] = []
    has = np.zeros(len(tokens), bool)

    def walk(node: Node, overlap: int, me: int, after: int, own: np.ndarray) -> None:
        n = len(own)
        if node.high <= after or 100 * node.largest < PERCENT * n or PERCENT * node.smallest > 100 * n:
            return
        if node.one >= 0 and find(order[node.one]) == find(me):
            return
        overlap += int(np.count_nonzero(has[node.tokens]))
        if node.own >= after and 100 * overlap >= PERCENT * (n + node.depth - overlap):
            i = order[node.own]
            a, b = find(i), find(me)
            if a != b:
                parent[a] = b
                links.append((i, me))
        if not node.children:
            return
        left = n - (int(np.searchsorted(own, stored[node.low][node.depth - 1], "right")) if node.depth else 0)
        size = min(max(node.depth + left, node.smallest), node.largest)
        if (100 + PERCENT) * (overlap + min(left, size - node.depth)) < PERCENT * (n + size):
            return
        for child in node.children:
            walk(child, overlap, me, after, own)
        ones = {find(order[c.one]) if c.one >= 0 else -1 for c in node.children} | ({find(order[node.own])} if node.own >= 0 else set())
        if len(ones) == 1 and -1 not in ones:
            node.one = node.children[0].one

    mine = [(i, k + 1) for k, i in enumerate(order)] if probes is None else [(len(index) + i, 0) for i in range(len(probes))]
    for me, after in mine:
        has[sequences[me]] = True
        walk(root, 0, me, after, sequences[me])
        has[sequences[me]] = False
    return links


def stars(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same components as stars around their smallest names, which contract in fewer rounds than chains."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        up[high] = low
    return [(find(x), x) for x in up if find(x) != x]


def joined(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) of components from members (key, cls, comp, size) of keys, size being the number of the key's members."""
    # of a large key the component with most members is dealt over parts, and the others, if they are few, go to every part;
    # if they are many, every two parts meet
    of_comp = members.filter(F.col("size") > PART).groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "comp")).alias("m")).select("key", F.col("m.n").alias("most"), F.col("m.comp").alias("major"))
    known = members.join(of_comp, "key", "left").withColumn("few", F.coalesce(F.col("size") - F.col("most") <= PART, F.lit(False)))
    parts = F.ceil(F.when(F.col("few"), F.col("most")).otherwise(F.col("size")) / PART).cast("long")
    split = known.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64(F.lit(2), "cls"), F.col("parts")))
    stays = F.col("few") & (F.col("comp") == F.col("major"))
    every = F.sequence(F.expr("0L"), F.col("parts") - 1)
    split = split.withColumn("other", F.explode(F.when(stays, F.array("part")).otherwise(every)))
    end = lambda f: F.when(F.col("few"), F.col("other")).otherwise(f("part", "other"))
    split = split.select("key", "cls", "comp", "part", end(F.least).alias("a"), end(F.greatest).alias("b"))
    rows = split.join(sets, "cls").select("key", "a", "b", "part", "comp", "set")

    def links_of(key: tuple, held: list[tuple]) -> list[tuple[int, int]]:
        # of (a, a) all rows meet, the few other components' too, whatever part they'd be in; of (a, b) those of a meet those of b
        one = key[1] == key[2]
        if not one:
            held.sort(key=lambda x: x[0] != key[1])
        n = len(held) if one else sum(x[0] == key[1] for x in held)
        if len(held) < 2 or not one and n in (0, len(held)):
            return []
        comps, every = [x[1] for x in held], [x[2] for x in held]
        return stars([(comps[i], comps[j]) for i, j in trie_links(every[:n], None if one else every[n:], comps)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by key; one key's rows are held at a time."""
        now, held = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            part, comp, ends = batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5)
            values, at = ends.flatten().to_numpy(), np.cumsum([0, *ends.value_lengths().to_pylist()])
            out = []
            for i, key in enumerate(keys):
                if key != now:
                    out += links_of(now, held) if held else []
                    now, held = key, []
                held.append((part[i], comp[i], values[at[i] : at[i + 1]].copy()))
            yield link_batch(out)
        yield link_batch(links_of(now, held) if held else [])

    return rows.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(run, "u long, v long")


def link_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["u", "v"])


def text_key() -> list[Column]:
    return [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")]


def prefix_keys(classes: DataFrame) -> DataFrame:
    """(key, cls): the first shingles of each class that other classes may have among theirs, each with two ranges of sizes.

    A set that is nine tenths of another has the size's own range, or the next one, in common with it, so sets of too different
    sizes never meet. See the module's docstring for the order of shingles.
    """
    low = classes.select("cls", "n", "short", F.explode("low").alias("key"))
    shared = low.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1")
    own = Window.partitionBy("cls")
    ranked = low.join(shared, "key").withColumns({"at": F.row_number().over(own.orderBy("df", "key")), "shared": F.count("*").over(own)})
    # shingles of one class alone come first; of the shared ones, those are left that fit into the prefix behind them
    first = ranked.filter("at <= short + shared").select("key", "cls", "n").unionAll(classes.select(F.explode("rest").alias("key"), "cls", "n"))
    grade = F.floor(F.ln(F.col("n")) / (math.log(100 / PERCENT) * (1 + 1e-9)))
    return first.select("key", "cls", F.explode(F.array(grade, grade + 1)).alias("grade")).select(F.xxhash64("key", "grade").alias("key"), "cls")


def still_apart(live: DataFrame, met: list[str]) -> DataFrame:
    """live (key, cls, comp, met...) with size, without the keys whose members cannot give a link any more.

    Those are the keys of one component, those whose members all met under one key before (met: columns with such keys), and
    of keys with equal members all but one.
    """
    alike = [F.bit_xor(F.xxhash64(F.lit(i), "cls")).alias(f"x{i}") for i in (3, 4)]
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("comp", *met) for f in (F.min, F.max)]
    groups = live.groupBy("key").agg(F.count("*").alias("size"), *ends, *alike).filter(" and ".join(f"min_{c} <> max_{c}" for c in ("comp", *met)))
    groups = groups.groupBy("size", "x3", "x4").agg(F.min("key").alias("key")).select("key", "size")
    return cut(live.join(groups, "key"), "live")


def one_key_each(live: DataFrame, met: str) -> tuple[DataFrame, DataFrame]:
    """(members of each class's key with most members, live with what it met under as column met).

    Of a key with more than PART members only the members of one part meet, and the first of each part: linear work, which
    joins large families; what is still apart then has yet to meet under other keys.
    """
    best = F.min(F.struct((-F.col("size")).alias("s"), F.xxhash64(F.lit(met), "key").alias("h"), "key")).alias("m")
    one = live.groupBy("cls", "comp").agg(best).select(F.col("m.key").alias("key"), "cls", "comp")
    parts = one.groupBy("key").agg(F.ceil(F.count("*") / PART).alias("parts"))
    one = cut(one.join(parts, "key").withColumn("part", F.xxhash64("key", F.pmod(F.xxhash64(F.lit(2), "cls"), F.col("parts")))), "one")
    firsts = one.filter("parts > 1").groupBy("key", "part").agg(F.min("cls").alias("cls"), F.min_by("comp", "cls").alias("comp")).select("key", "cls", "comp")
    firsts = firsts.join(firsts.groupBy("key").agg(F.count("*").alias("size")), "key")
    members = one.select(F.col("part").alias("key"), "cls", "comp", F.lit(1).cast("long").alias("size")).unionAll(firsts.select("key", "cls", "comp", "size"))
    return members, live.drop("size").join(one.select("cls", F.col("part").alias(met)), "cls")


def renamed(live: DataFrame, links: DataFrame) -> DataFrame:
    roots = components(links).select(F.col("node").alias("comp"), "root")
    return live.join(roots, "comp", "left").withColumn("comp", F.coalesce("root", "comp")).drop("root")


def class_components(keys: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(cls, comp) of the classes that have links; keys: (key, cls), classes: (cls, h1, h2) with the text keys of one text."""
    needed = keys.select("cls").distinct().join(classes.select("cls", "h1", "h2"), "cls")
    texts = docs.select(*text_key(), "text").join(needed, ["h1", "h2"]).groupBy("cls").agg(F.first("text").alias("text"))
    sets = cut(texts.select("cls", set_udf("text").alias("set")), "sets")

    live = still_apart(keys.select("key", "cls", F.col("cls").alias("comp")), [])
    members, live = one_key_each(live, "met0")
    links = cut(joined(members, sets), "links")
    live = still_apart(renamed(live, links), ["met0"])

    # classes and keys that hang together: a block meets as a whole, once, where that sends its sets less often than its keys do
    centres = live.groupBy("key").agg(F.min("cls").alias("v"))
    blocks = components(live.select("key", F.col("cls").alias("u")).join(centres, "key").select("u", "v"))
    placed = live.groupBy("cls", "comp").agg(F.count("*").alias("keys")).join(blocks.select(F.col("node").alias("cls"), F.col("root").alias("key")), "cls")
    placed = cut(placed, "blocks")
    whole = F.ceil(F.col("size") / PART) * F.col("size") <= F.col("rows")
    sizes = placed.groupBy("key").agg(F.count("*").alias("size"), F.sum("keys").alias("rows")).withColumn("whole", whole).drop("rows")
    placed = placed.drop("keys").join(sizes, "key")
    links = cut(links.unionAll(joined(placed.filter("whole").drop("whole"), sets)), "links")
    live = live.join(placed.filter("not whole").select("cls"), "cls", "left_semi")
    links = links.unionAll(joined(live.select("key", "cls", "comp", "size"), sets))
    return components(links).select(F.col("node").alias("cls"), F.col("root").alias("comp"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id reachable by links).

    Words are runs of other bytes than blanks, A-Z lower-cased; a set holds the distinct SHINGLE-word shingles, or all words if
    there are fewer. Null, empty and blank texts have an empty set and link with nothing: their component is their own id.
    Equal sets link. A null id takes part and gets its component's smallest id, null if there is none; repeated rows each get
    their row. Other columns are ignored, whatever their names.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marked = docs.select("doc_id", *text_key(), mark_udf("text").alias("m")).select("doc_id", "h1", "h2", "m.*")
    wide = cut(marked, "marked")
    full = wide.filter("n > 0")
    one = full.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.min(F.struct("h1", "h2")).alias("h"), *[F.first(c).alias(c) for c in ("n", "short", "low", "rest")])
    wide_classes = cut(one.select("digest", "first_id", "h.h1", "h.h2", "n", "short", "low", "rest", F.monotonically_increasing_id().alias("cls")), "classes")
    keys = cut(prefix_keys(wide_classes), "keys")
    met = keys.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    keys = cut(keys.join(met, "key").select("key", "cls"), "met")
    # from here on without the shingles
    marked, classes = cut(wide.select("doc_id", "n", "digest"), "ids"), cut(wide_classes.drop("n", "short", "low", "rest"), "classes")
    for held in (wide, wide_classes):
        drop_cut(held)
    comps = cut(class_components(keys, classes, docs), "comps")
    rooted = classes.select("digest", "first_id", "cls").join(comps, "cls", "left").select("digest", "first_id", F.coalesce("comp", "cls").alias("comp"))
    ids = rooted.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    of_digest = rooted.join(ids, "comp").select("digest", "component_id")
    met = marked.filter("n > 0").join(of_digest, "digest").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return met.unionByName(marked.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
