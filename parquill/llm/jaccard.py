"""N-gram Jaccard join: documents whose shingle sets are similar, found exactly by signature trees.

1. Each text's set of word shingles is hashed; documents with equal sets are one class, whose smallest
   id stands for it, so copies are never compared.
2. Sets that link differ in few shingles, at most d by their sizes. So if all shingles are dealt to d + 1
   parts by their hash, some part holds the same shingles in both sets: that part's hash is a key that
   both have. Keys are made for each range of d that a set's possible partners have, so nothing hangs on
   chance (see ``Parts``). A key's members are tied to its smallest; copies within a batch are tied there
   first, so a frequent key is a few rows only. Nothing is closed transitively.
3. A head and blocks of its members are compared exactly, and what links is connected.
4. Keys whose members are still apart are resolved by signature trees: leaves hold members of like size,
   nodes the OR of their members' token bitmaps and the range of their sizes. Two trees are walked
   together; a pair of nodes is skipped if the bits and sizes they have in common cannot reach the
   threshold, or if all their members are connected already. The first walk has bitmaps only and marks
   members with a possible partner; their sets are then fetched, and walked exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parquill.llm.arrow import mix, raw, tidy
from parquill.llm.components import components
from parquill.runtime import checkpoint

#: Members of one block: with their sets, and with their bitmaps only.
BLOCK, MAP_BLOCK = 192, 1024
#: Members of a leaf, and children of a node.
LEAF, FAN = 16, 4
#: Bits of a signature for each shingle of the largest set, about, and at most in all.
SET_BITS, MOST_BITS = 2, 1 << 16
#: Ratio of the ranges of differences that share keys, ways to deal shingles to parts, and keys made at once.
RANGE, WAYS, MANY_KEYS = 1.5, 6, 400_000
#: Ids of candidates up to which the scan for their texts is filtered by broadcast: about 10 MB.
BROADCAST_IDS = 200_000

PAIRS = T.StructType([T.StructField(c, T.LongType()) for c in "ab"])
EDGES = T.StructType([T.StructField(c, T.LongType()) for c in ("key", "a", "b")])


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of A-Z lower-cased text.

    Fewer words are one shingle; no word, none.
    """
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    of = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(width, len(of))
    out = np.full(len(of) - n + 1, n, np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + of[i : len(of) - n + 1 + i])
    return np.unique(out)


class Parts:
    """Keys such that any two different sets that link have one in common.

    Sets of r and s shingles link if they share at least percent / (100 + percent) of r + s, so they differ
    in d = (r + s) * (100 - percent) // (100 + percent) shingles at most. A range of d up to ``top`` has
    top + 1 + spare parts. Two sets that differ in ``top`` shingles at most have spare + 1 parts in common
    at least, and one that is not empty in both if either set has at most ``spare`` empty ones. A set that
    has more is also dealt in a second way, and so on, so the first way in which not both sets have too many
    gives a common key; after the last way empty parts are keys as well.
    """

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.ranges = cache(self._ranges)
        self.parts = cache(self._parts)

    def most(self, total: int) -> int:
        """Shingles in which two sets of ``total`` together differ at most if they link."""
        return total * (100 - self.percent) // (100 + self.percent)

    def _ranges(self, size: int) -> list[int]:
        """The ranges, by their top, of a set's links with other sets than its own."""
        least, most = -(-size * self.percent // 100), size * 100 // self.percent
        low, high = max(1, self.most(size + least)), self.most(size + most)
        tops = [1]
        while tops[-1] < high:
            tops.append(math.ceil(tops[-1] * RANGE))
        return [t for t in tops if t >= low] if high else []

    def _parts(self, top: int) -> tuple[int, int]:
        """Parts of a range, and how many of them may be empty."""
        size = (top / RANGE + 1) * (100 + self.percent) / max(1, 100 - self.percent) / 2
        spare = max(0, math.ceil(3 * (top + 1) * math.exp(-size / (top + 1)) - 0.25))
        return top + 1 + spare, spare

    def keys(self, of: np.ndarray) -> np.ndarray:
        """The distinct 64-bit keys of a set of hashes."""
        out = []
        for top in self.ranges(len(of)):
            n, spare = self.parts(top)
            for way in range(WAYS):
                mixed = mix(of + np.uint64((top * WAYS + way + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
                part = ((mixed >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
                held = np.bincount(part, minlength=n)
                # Sums of 32-bit halves are exact in double precision.
                low = np.bincount(part, (mixed & np.uint64(0xFFFFFFFF)).astype(float), n).astype(np.uint64)
                high = np.bincount(part, (mix(mixed) & np.uint64(0xFFFFFFFF)).astype(float), n).astype(np.uint64)
                name = np.arange(n, dtype=np.uint64) + np.uint64((top * WAYS + way) << 32)
                key = mix(mix(low * np.uint64(0x9E3779B97F4A7C15) + high) + mix(name) + held.astype(np.uint64))
                full = held > 0
                enough = int(full.sum()) >= n - spare
                out.append(key[full] if enough or way < WAYS - 1 else key)
                if enough:
                    break
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def bits_of(size: int) -> int:
    """Bits of a signature where the largest set has this size: a power of two."""
    return min(MOST_BITS, max(64, 1 << (SET_BITS * size - 1).bit_length()))


def bitmap(of: np.ndarray, bits: int) -> np.ndarray:
    """A set's token bitmap."""
    out = np.zeros(bits, bool)
    out[(of % np.uint64(bits)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").view(np.uint64)


def fold(words: np.ndarray, bits: int) -> np.ndarray:
    """The bitmap of the same tokens with fewer bits."""
    return np.bitwise_or.reduce(words.reshape(-1, bits // 64), 0)


class Tree:
    """A signature tree over sets given by their sizes and bitmaps, and by their hashes where known."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, maps: np.ndarray, sets: list[np.ndarray] | None = None) -> None:
        order = np.argsort(sizes, kind="stable")
        self.order, self.ids, self.sizes, self.maps = order, ids[order], sizes[order], maps[order]
        self.sets = [sets[i] for i in order] if sets is not None else None
        # How many shingles more than bits a set has bounds what collisions hide.
        self.excess = self.sizes - np.bitwise_count(self.maps).sum(1).astype(np.int64)
        count = len(ids)
        self.levels: list[list[tuple[int, int]]] = [[(i, min(count, i + LEAF)) for i in range(0, count, LEAF)]]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append([(below[i][0], below[min(len(below), i + FAN) - 1][1]) for i in range(0, len(below), FAN)])
        self.nodes = [[self._node(*span) for span in level] for level in self.levels]

    def _node(self, a: int, b: int) -> dict:
        return {"span": (a, b), "map": np.bitwise_or.reduce(self.maps[a:b], 0), "low": int(self.sizes[a]), "high": int(self.sizes[b - 1]), "excess": int(self.excess[a:b].max())}

    @classmethod
    def of_sets(cls, ids: np.ndarray, sets: list[np.ndarray], bits: int = 0) -> Tree:
        sizes = np.array([len(s) for s in sets], np.int64)
        bits = bits or bits_of(int(sizes.max(initial=1)))
        maps = np.stack([bitmap(s, bits) for s in sets]) if sets else np.zeros((0, bits // 64), np.uint64)
        return cls(ids, sizes, maps, sets)

    def children(self, level: int, i: int) -> list[tuple[int, int]]:
        return [(level - 1, c) for c in range(FAN * i, min(FAN * i + FAN, len(self.levels[level - 1])))]


class Union:
    """Union of integers, smallest as root."""

    def __init__(self, known: dict[int, int] | None = None) -> None:
        self.up: dict[int, int] = {}
        for x, y in (known or {}).items():
            self.join(x, y)

    def root(self, x: int) -> int:
        while (y := self.up.setdefault(x, x)) != x:
            self.up[x] = x = self.up.setdefault(y, y)
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def leaf_pairs(x: Tree, y: Tree, percent: int, union: Union) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By dual traversal, pairs of leaves that may hold links between what ``union`` has apart: members' places in both trees, and which of their pairs may link."""
    if not len(x.ids) or not len(y.ids):
        return
    stack = [((len(x.levels) - 1, 0), (len(y.levels) - 1, 0))]
    while stack:
        a, b = stack.pop()
        if x is y and a[0] == b[0] and a[1] > b[1]:
            continue
        p, q = x.nodes[a[0]][a[1]], y.nodes[b[0]][b[1]]
        # Members of sizes s and t link if they share percent / (100 + percent) of s + t; they share the
        # smaller size at most, and at most the common bits and what collisions hide.
        if 100 * min(p["high"], q["high"]) < percent * max(p["low"], q["low"]):
            continue
        common = int(np.bitwise_count(p["map"] & q["map"]).sum()) + min(p["excess"], q["excess"])
        if (100 + percent) * common < percent * (p["low"] + q["low"]):
            continue
        if a[0] or b[0]:
            stack += [(c, b) for c in x.children(*a)] if a[0] >= b[0] else [(a, c) for c in y.children(*b)]
            continue
        left, right = np.arange(*p["span"]), np.arange(*q["span"])
        if len({union.root(i) for i in [*x.ids[left].tolist(), *y.ids[right].tolist()]}) == 1:
            continue
        size, other = x.sizes[left][:, None], y.sizes[right][None, :]
        shared = np.bitwise_count(x.maps[left][:, None, :] & y.maps[right][None, :, :]).sum(2).astype(np.int64)
        shared += np.minimum(x.excess[left][:, None], y.excess[right][None, :])
        most = np.minimum(np.minimum(size, other), shared)
        may = (100 + percent) * most >= percent * (size + other)
        if may.any():
            yield left, right, may


def walk(x: Tree, y: Tree, percent: int, union: Union) -> Iterator[tuple[int, int]]:
    """Links between members of two trees (or of one with itself) that connect what ``union`` has apart.

    A link is 100 * intersection >= percent * union of the sets.
    """
    for left, right, may in leaf_pairs(x, y, percent, union):
        for i, j in zip(*np.nonzero(may), strict=True):
            a, b = int(x.ids[left[i]]), int(y.ids[right[j]])
            if a == b or union.root(a) == union.root(b):
                continue
            u, v = x.sets[left[i]], y.sets[right[j]]
            both = len(np.intersect1d(u, v, assume_unique=True))
            if 100 * both >= percent * (len(u) + len(v) - both):
                union.join(a, b)
                yield a, b


def possible(x: Tree, y: Tree, percent: int, union: Union) -> tuple[np.ndarray, np.ndarray]:
    """Which members of each tree, in the order they were given, may link with one of the other that ``union`` has apart from them."""
    marks = np.zeros(len(x.ids), bool), np.zeros(len(y.ids), bool)
    roots = [np.array([union.root(int(i)) for i in t.ids], np.int64) for t in (x, y)]
    for left, right, may in leaf_pairs(x, y, percent, union):
        may = may & (roots[0][left][:, None] != roots[1][right][None, :])
        marks[0][x.order[left[may.any(1)]]] = True
        marks[1][y.order[right[may.any(0)]]] = True
    return marks


def link_components(docs: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id with its number of shingles and its component by links of similar texts.

    A text's words are runs without ASCII blanks, A-Z lower-cased; its set has its distinct
    ``width``-word shingles, the whole sequence if it has fewer words. Two rows link when 100 times their
    sets' intersection is at least ``percent`` times their union. ``component_id`` is the smallest id
    reachable, itself included. Also ``class_id``, the smallest id with an equal set.

    Texts without words (null, empty) have no shingle and link with nothing, not even each other. Rows
    with a null id are returned with null class and component and link with nothing; rows that repeat
    an id are one node, with all their texts' links. An empty table gives an empty result.
    """
    if not 0 < percent <= 100 or width < 1:
        raise ValueError("percent is from 1 to 100, width at least 1")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = checkpoint(_digests(texts, width))
    alive = signed.filter("n > 0 and id is not null")
    classes = alive.groupBy("h1", "h2").agg(F.min("id").alias("class_id"), F.count("*").alias("members"))
    copies = checkpoint(classes.filter("members > 1").select("h1", "h2", "class_id"))
    salted = copies.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    rows = alive.select("id", "h1", "h2", F.expr("cast(pmod(xxhash64(id, 3), 16) as int)").alias("salt"))
    classed = rows.join(salted, ["h1", "h2", "salt"], "left").select("id", F.coalesce("class_id", "id").alias("class_id"))
    ids = checkpoint(classed.groupBy("id").agg(F.min("class_id").alias("class_id"), F.max("class_id").alias("other")))
    # An id with different texts is one node, tied to all their classes; other ids stand for their class.
    several = ids.filter("class_id <> other").select(F.col("id").alias("_id"))
    tie = classed.join(several, F.col("id") == F.col("_id"), "left_semi").select(F.col("id").alias("a"), F.col("class_id").alias("b")).distinct()
    stand = ids.filter("class_id = other and class_id <> id").select("id", F.col("class_id").alias("to"))

    edges = checkpoint(_standing(_common_keys(texts, width, percent), stand))
    links = _with_heads(texts, edges.select("a", "b").distinct(), width, percent)
    joined = components(links.union(tie))
    left = _apart(edges, joined)
    if left.limit(1).count():
        links = links.union(_by_trees(texts, edges, left, joined, width, percent))
        joined = components(links.union(tie))
    final = ids.join(joined, ids["class_id"] == joined["node"], "left").select("id", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    return signed.select("id", "n").join(final, "id", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("component_id", "id").alias("component_id"))


def _digests(texts: DataFrame, width: int) -> DataFrame:
    """Each row's number of shingles, and a 128-bit hash of its set."""
    fields = ("id", "n", "h1", "h2")

    def sign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sets = (shingles(text, width) for text in raw(part.column(1)))
            made = [(len(of), xxhash.xxh3_128_digest(of.tobytes())) for of in sets]
            halves = np.frombuffer(b"".join(d for _, d in made), np.int64).reshape(len(made), 2)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in made], pa.int64()), *[pa.array(np.ascontiguousarray(halves[:, i])) for i in (0, 1)]], names=fields)

    return texts.mapInArrow(tidy(sign), T.StructType([T.StructField(c, T.LongType()) for c in fields]))


def _common_keys(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Edges (key, a, b) that tie the ids of each key that more than one id has.

    Each batch ties a key's later ids to its first there, so only one row of a key and batch is dealt by
    the key; the others are dealt by chance.
    """

    def tied(keys: list[np.ndarray], owners: list[int]) -> pa.RecordBatch:
        key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        ids = np.repeat(np.array(owners, np.int64), [len(k) for k in keys])
        order = np.lexsort((ids, key))
        key, ids = key[order].view(np.int64), ids[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
        heads = ids[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        some = new | (heads != ids)
        return pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(heads[some]), pa.array(ids[some], mask=new[some])], names=["key", "a", "b"])

    def spread(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_set = Parts(percent)
        for part in parts:
            keys, owners, n = [], [], 0
            for doc, text in zip(part.column(0).to_pylist(), raw(part.column(1)), strict=True):
                own = of_set.keys(shingles(text, width))
                if len(own):
                    keys.append(own)
                    owners.append(doc)
                    n += len(own)
                if n > MANY_KEYS:
                    yield tied(keys, owners)
                    keys, owners, n = [], [], 0
            yield tied(keys, owners)

    def heads(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by key and id: ties each batch's first id of a key to the smallest one."""
        last, first = None, 0
        for part in parts:
            own = part.filter(part.column(2).is_null())
            yield part.filter(part.column(2).is_valid())
            if not len(own):
                continue
            key, ids = own.column(0).to_numpy(), own.column(1).to_numpy()
            new = np.concatenate([[key[0] != last], key[1:] != key[:-1]])
            at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            lead = np.where(at >= 0, ids[at], first)
            last, first = key[-1], lead[-1]
            some = lead != ids
            yield pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(lead[some]), pa.array(ids[some])], names=["key", "a", "b"])

    rows = texts.filter("id is not null").mapInArrow(tidy(spread), EDGES)
    dealt = rows.repartition(F.when(F.col("b").isNull(), F.col("key")).otherwise(F.xxhash64("key", "b")))
    return dealt.sortWithinPartitions("key", "a").mapInArrow(tidy(heads), EDGES)


def _standing(edges: DataFrame, stand: DataFrame) -> DataFrame:
    """Edges between the ids that stand for others."""
    for c in "ab":
        to = stand.select(F.col("id").alias("_id"), F.col("to").alias("_to"))
        edges = edges.join(to, F.col(c) == F.col("_id"), "left").withColumn(c, F.coalesce("_to", c)).drop("_id", "_to")
    return edges.filter("a <> b").select("key", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _fetched(texts: DataFrame, cells: DataFrame) -> DataFrame:
    """The cells' rows, by their column node, with their texts."""
    few = cells.count() <= BROADCAST_IDS
    return texts.join(F.broadcast(cells) if few else cells, F.col("id") == F.col("node")).select(*cells.columns, "text")


def _with_heads(texts: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) among each head a and its members b, in blocks of members that share the head."""
    pairs = checkpoint(pairs)
    large = checkpoint(pairs.groupBy("a").count().filter(F.col("count") > BLOCK).select(F.col("a").alias("_a"), F.expr(f"cast((count + {BLOCK - 1}) div {BLOCK} as int)").alias("blocks")))
    side = F.broadcast(large) if large.count() <= BROADCAST_IDS else large
    blocked = pairs.join(side, F.col("a") == F.col("_a"), "left").select("a", "b", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    members = blocked.select("a", F.expr("cast(pmod(xxhash64(b, 11), blocks) as int)").alias("block"), F.col("b").alias("node"))
    cells = checkpoint(members.union(members.select("a", "block", F.col("a").alias("node")).distinct()))

    def within(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _runs(parts, 2):
            tree = Tree.of_sets(np.array([r[0] for r in rows], np.int64), [shingles(r[1], width) for r in rows])
            yield _pairs(walk(tree, tree, percent, Union()))

    keyed = _fetched(texts, cells).select("a", "block", "node", "text")
    return checkpoint(keyed.repartition("a", "block").sortWithinPartitions("a", "block").mapInArrow(tidy(within), PAIRS))


def _apart(edges: DataFrame, joined: DataFrame) -> DataFrame:
    """The keys whose members are not all in one component."""
    pairs = edges.select("a", "b").distinct()
    for c in "ab":
        to = joined.select(F.col("node").alias(f"_{c}"), F.col("component").alias(f"c{c}"))
        pairs = pairs.join(to, F.col(c) == F.col(f"_{c}"), "left")
    bad = pairs.filter("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")
    return checkpoint(edges.join(bad, ["a", "b"]).select("key").distinct())


def _by_trees(texts: DataFrame, edges: DataFrame, keys: DataFrame, joined: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between members of one key that are in different components, until they connect what all links do."""
    own = edges.join(keys, "key")
    nodes = own.select("key", F.col("a").alias("node")).union(own.select("key", F.col("b").alias("node"))).distinct()
    nodes = nodes.join(joined.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    nodes = checkpoint(nodes)
    # Keys with the same members are compared once.
    sums = nodes.groupBy("key").agg(F.count("*").alias("size"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"), F.min("component").alias("least"))
    kept = checkpoint(sums.groupBy("size", "sum").agg(F.min(F.struct("key", "least")).alias("first")).select(F.col("first.key").alias("_key"), F.col("first.least").alias("least"), F.expr(f"cast((size + {MAP_BLOCK - 1}) div {MAP_BLOCK} as int)").alias("blocks")))
    side = F.broadcast(kept) if kept.count() <= BROADCAST_IDS else kept
    nodes = nodes.join(side, F.col("key") == F.col("_key"))
    # Every member is in one block of its key; those outside the key's smallest component are compared with all blocks.
    index = nodes.select("key", F.expr("cast(pmod(xxhash64(node, 11), blocks) as int)").alias("block"), F.lit(0).alias("kind"), "node", "component")
    asks = nodes.filter("component <> least").select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), "node", "component")
    cells = checkpoint(index.union(asks))

    drawn = T.StructType([T.StructField("node", T.LongType()), T.StructField("maps", T.ArrayType(T.StructType([T.StructField("n", T.LongType()), T.StructField("map", T.BinaryType())])))])

    def draw(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sets = [shingles(text, width) for text in raw(part.column(1))]
            maps = [[{"n": len(s), "map": bitmap(s, bits_of(len(s))).tobytes()}] for s in sets]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(maps, pa.list_(pa.struct([("n", pa.int64()), ("map", pa.binary())])))], names=["node", "maps"])

    wanted = checkpoint(nodes.select("node").distinct())
    sketches = _fetched(texts, wanted).mapInArrow(tidy(draw), drawn).select("node", F.explode("maps").alias("m")).select(F.col("node").alias("_n"), "m.n", "m.map")
    marked = T.StructType([T.StructField("key", T.LongType()), T.StructField("block", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("node", T.LongType()), T.StructField("component", T.LongType())])

    def mark(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, block), rows, probes in _cells(parts):
            bits = min(8 * len(r[3]) for r in [*rows, *probes])
            trees = [Tree(np.array([r[0] for r in x], np.int64), np.array([r[2] for r in x], np.int64), np.stack([fold(np.frombuffer(r[3], np.uint64), bits) for r in x])) for x in (rows, probes)]
            found = possible(*trees, percent, Union({r[0]: r[1] for r in [*rows, *probes]}))
            for kind, (x, some) in enumerate(zip((rows, probes), found, strict=True)):
                got = sorted({(x[i][0], x[i][1]) for i in np.flatnonzero(some)})
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(got), pa.int64()), pa.array([block] * len(got), pa.int32()), pa.array([kind] * len(got), pa.int32()), *[pa.array([g[i] for g in got], pa.int64()) for i in (0, 1)]], names=marked.names)

    def exact(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows, probes in _cells(parts):
            sets = [[shingles(r[2], width) for r in x] for x in (rows, probes)]
            bits = bits_of(max(len(s) for x in sets for s in x))
            trees = [Tree.of_sets(np.array([r[0] for r in x], np.int64), s, bits) for x, s in zip((rows, probes), sets, strict=True)]
            yield _pairs(walk(*trees, percent, Union({r[0]: r[1] for r in [*rows, *probes]})))

    mapped = cells.join(sketches, F.col("node") == F.col("_n")).select(*marked.names, "n", "map")
    marks = checkpoint(mapped.repartition("key", "block").sortWithinPartitions("key", "block", "kind").mapInArrow(tidy(mark), marked).distinct())
    held = _fetched(texts, marks).select(*marked.names, "text")
    return checkpoint(held.repartition("key", "block").sortWithinPartitions("key", "block", "kind").mapInArrow(tidy(exact), PAIRS))


def _pairs(links: Iterator[tuple[int, int]]) -> pa.RecordBatch:
    found = list(links)
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _runs(parts: Iterator[pa.RecordBatch], width: int, most: int = 0) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows that are equal in the first ``width`` columns, as these and the other columns; of at most ``most`` rows if given."""
    now, held = None, []
    for part in parts:
        columns = [raw(part.column(i)) if pa.types.is_string(part.column(i).type) else part.column(i).to_pylist() for i in range(part.num_columns)]
        for row in zip(*columns, strict=True):
            if row[:width] != now or most and len(held) >= most:
                if held:
                    yield now, held
                now, held = row[:width], []
            held.append(row[width:])
    if held:
        yield now, held


def _cells(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple], list[tuple]]]:
    """Of rows sorted by cell and kind: the cell, its members (kind 0), and each block of those to be compared with them."""
    at, members = None, []
    for (*cell, kind), rows in _runs(parts, 3, MAP_BLOCK):
        if cell != at:
            at, members = cell, []
        if kind == 0:
            members = members + rows
        elif members:
            yield tuple(cell), members, rows


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component of ``link_components``: the one with the smallest id.

    All columns stay. Rows with a null id and rows without words stay. Rows that repeat an id stay or go together.
    """
    linked = link_components(docs, width=width, percent=percent, id_col=id_col, text_col=text_col)
    gone = linked.filter("component_id <> doc_id").select(F.col("doc_id").alias("_gone_id")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["_gone_id"], "left_anti")
