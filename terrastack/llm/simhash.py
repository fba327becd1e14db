"""SimHash near-duplicates: 64-bit fingerprints of word shingles, BK-trees over shards of them, connected components.

Fingerprints are first made distinct. Two that differ in at most 2 bits agree on one of three bands of the 64 bits, and, within
the rest, on one of three sub-bands: nine (band, sub-band) keys deal the distinct fingerprints to shards, and every link is
found in one of them. Each shard is a BK-tree (children keyed by their integer Hamming distance to the parent); searches
follow only the edges within the radius. The trees of shards of more than HOT_WORDS are built on the executors and broadcast, if all of them hold no more than
BROADCAST_WORDS together, and their queries are dealt to as many tasks as they need. All other trees have no size bound together and are built where they are searched:
small shards go to one task each, and hot ones beyond the broadcast's bound are cut by further sub-bands, until 2 ** 14 words is all that a shard can hold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrastack.llm.common import ensure_checkpoint_dir

RADIUS = 2
SHINGLE_WORDS = 3
SEED = 42
#: Words of a shard that one task searches alone at most, and words of all broadcast trees together (24 bytes each).
HOT_WORDS, BROADCAST_WORDS = 4096, 1 << 19
#: Three bands of the 64 bits (low, high), and how many sub-bands the remaining bits are dealt to in turn.
BANDS = ((0, 21), (21, 42), (42, 64))
SUB_BANDS = 3


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """Bits set in over half of the shingles' XXH64 values; 0 for a text without words."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = [b" ".join(s) for s in zip(*(tokens[i:] for i in range(words)), strict=False)]
    votes = np.zeros(64, np.int64)
    for start in range(0, len(shingles), 8192):
        hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles[start : start + 8192]], np.uint64)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(shingles), bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row; null and empty texts get 0."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                prints = np.array([fingerprint(t or "") for t in part.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, fp long")


def band_masks() -> list[int]:
    """The nine 64-bit masks; two words within 2 bits of each other agree under at least one of them."""
    masks = []
    for low, high in BANDS:
        rest = [*range(low), *range(high, 64)]
        for turn in range(SUB_BANDS):
            masks.append(sum(1 << b for b in [*range(low, high), *rest[turn::SUB_BANDS]]))
    return masks


def further_masks(mask: int) -> list[int]:
    """Nine masks that add bits to `mask`: two words that agree under it and are within 2 bits of each other agree under at least one of them."""
    found = []
    rest = [b for b in range(64) if not mask >> b & 1]
    for turn in range(SUB_BANDS):
        part = rest[turn::SUB_BANDS]
        more = [b for b in rest if b not in part]
        found += [mask | sum(1 << b for b in [*part, *more[sub::SUB_BANDS]]) for sub in range(SUB_BANDS)]
    return found


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of rows of 64-bit words."""
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64)


class BKTree:
    """BK-trees over fingerprints of one or more 64-bit words each, built and searched level by level with numpy.

    Each run of equal `shard` numbers is a tree of its own, whose root is its first fingerprint. `edges` holds the sorted keys parent * STEP + distance and `child`
    the node at the end of each edge.
    """

    STEP = 1024

    def __init__(self, words: np.ndarray, shard: np.ndarray | None = None):
        self.words = words if words.ndim == 2 else words[:, None]
        shard = np.zeros(len(words), np.int64) if shard is None else shard
        first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(words) else np.empty(0, np.int64)
        #: The root of each fingerprint's tree.
        self.root = np.repeat(first, np.diff([*first, len(words)]))
        pending = np.flatnonzero(self.root != np.arange(len(words)))
        parent = self.root[pending]
        keys, nodes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while len(pending):
            key = parent * self.STEP + _apart(self.words[pending], self.words[parent])
            _, place, which = np.unique(key, return_index=True, return_inverse=True)
            keys.append(key[place])
            nodes.append(pending[place])
            parent = pending[place][which]
            below = np.ones(len(pending), bool)
            below[place] = False
            pending, parent = pending[below], parent[below]
        keys, nodes = np.concatenate(keys), np.concatenate(nodes)
        order = np.argsort(keys)
        self.edges, self.child = keys[order], nodes[order]

    def found(self, queries: np.ndarray, radius: int | np.ndarray, root: np.ndarray | None = None, together: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query index, node) of every fingerprint within `radius` (one for all, or each query's) of a query in the tree with its `root` (the first one's), for some queries at a time."""
        queries = queries if queries.ndim == 2 else queries[:, None]
        reach = np.broadcast_to(np.asarray(radius), len(queries))
        for start in range(0, len(queries) if len(self.words) else 0, together):
            at = np.arange(start, min(start + together, len(queries)))
            node = np.zeros(len(at), np.int64) if root is None else root[at]
            parts = []
            while len(at):
                distance = _apart(queries[at], self.words[node])
                within = reach[at]
                near = distance <= within
                parts.append((at[near], node[near]))
                low = np.searchsorted(self.edges, node * self.STEP + np.maximum(distance - within, 0))
                high = np.searchsorted(self.edges, node * self.STEP + np.minimum(distance + within, self.STEP - 1), side="right")
                many = high - low
                at = np.repeat(at, many)
                step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                node = self.child[np.repeat(low, many) + step]
            yield np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def search(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """All that found() finds."""
        parts = [(np.empty(0, np.int64),) * 2, *self.found(queries, radius)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def spanning(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """`root` (of each number the smallest one it is known to reach) with the links (a, b) added; at most one row for each number, whatever the number of links."""
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low != high
        if not open_.any():
            break
        np.minimum.at(root, high[open_], low[open_])
        while (root[root] != root).any():
            root = root[root]
    return root


def tree_links(tree: BKTree, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (word, smaller word of its group) of the links between 64-bit queries and the tree's words."""
    ranked = np.union1d(tree.words[:, 0], queries)
    nodes, asked = np.searchsorted(ranked, tree.words[:, 0]), np.searchsorted(ranked, queries)
    root = np.arange(len(ranked))
    for at, node in tree.found(queries, radius):
        root = spanning(root, asked[at], nodes[node])
    linked = np.flatnonzero(root != np.arange(len(root)))
    return ranked[linked], ranked[root[linked]]


def _runs(use: Callable) -> Callable:
    """For mapInArrow over rows (band, shard, fp) sorted by all: use(band, shard, words) of each run of one (band, shard), across batches; its batches go out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []
        for batch in batches:
            band, shard, words = (batch.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero((band[1:] != band[:-1]) | (shard[1:] != shard[:-1])) + 1
            for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if start == end:
                    continue
                if (this := (int(band[start]), int(shard[start]))) != key:
                    if parts:
                        yield from use(*key, np.concatenate(parts).view(np.uint64))
                    key, parts = this, []
                parts.append(words[start:end])
        if parts:
            yield from use(*key, np.concatenate(parts).view(np.uint64))

    return work


def _links(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def _by_shard(rows: DataFrame) -> DataFrame:
    return rows.select("band", "shard", "fp").repartition("band", "shard").sortWithinPartitions("band", "shard", "fp")


def _searched(rows: DataFrame, radius: int) -> DataFrame:
    """Links in shards of bounded size: each tree is built and searched in one task."""
    return _by_shard(rows).mapInArrow(_runs(lambda band, shard, words: _links(*tree_links(BKTree(words), words, radius))), "a long, b long")


def _searched_by_broadcast(rows: DataFrame, many: int, radius: int) -> DataFrame:
    """Links in hot shards: their trees, `many` words in all, are built by tasks and broadcast; the queries are dealt to tasks by their hash."""

    def build(band: int, shard: int, words: np.ndarray) -> Iterator[pa.RecordBatch]:
        tree = BKTree(words)
        packed = [pa.array([x.tobytes()], pa.binary()) for x in (tree.words, tree.edges, tree.child)]
        yield pa.RecordBatch.from_arrays([pa.array([band], pa.int32()), pa.array([shard], pa.int64()), *packed], names=["band", "shard", "words", "edges", "child"])

    built = _by_shard(rows).mapInArrow(_runs(build), "band int, shard long, words binary, edges binary, child binary").toArrow().to_pylist()
    trees = rows.sparkSession.sparkContext.broadcast({(r["band"], r["shard"]): (r["words"], r["edges"], r["child"]) for r in built})

    def search(band: int, shard: int, queries: np.ndarray) -> Iterator[pa.RecordBatch]:
        words, edges, child = trees.value[band, shard]
        tree = BKTree(np.empty(0, np.uint64))
        tree.words, tree.edges, tree.child = np.frombuffer(words, np.uint64).reshape(-1, 1), np.frombuffer(edges, np.int64), np.frombuffer(child, np.int64)
        yield from _links(*tree_links(tree, queries, radius))

    dealt = rows.select("band", "shard", "fp").repartition(max(1, -(-many // HOT_WORDS)), "fp").sortWithinPartitions("band", "shard", "fp")
    return dealt.mapInArrow(_runs(search), "a long, b long")


def fingerprint_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b), b < a as unsigned words: links that join every group of distinct fingerprints `fp` within `radius` bits of each other.

    Groups, not all pairs: each search gives at most one row for each of its fingerprints.
    """
    if radius > RADIUS:
        raise ValueError(f"the bands find every link only up to radius {RADIUS}")
    ensure_checkpoint_dir(prints.sparkSession)
    signed = lambda m: F.lit(m - (1 << 64) if m >> 63 else m)
    masks = band_masks()
    pairs = F.array(*[F.struct(F.lit(i).alias("band"), signed(m).alias("mask")) for i, m in enumerate(masks)])
    keyed = prints.select("fp", F.explode(pairs).alias("m")).select(F.col("m.band").alias("band"), F.col("fp").bitwiseAND(F.col("m.mask")).alias("shard"), "fp")
    sizes = keyed.groupBy("band", "shard").agg(F.count(F.lit(1)).alias("size")).where("size > 1").checkpoint()  # a plain table: a hot shard can then be split in the join
    shared = keyed.join(sizes, ["band", "shard"]).checkpoint()
    hot = shared.where(F.col("size") > HOT_WORDS)
    many = hot.count()
    links = _searched(shared.where(F.col("size") <= HOT_WORDS), radius)
    if 0 < many <= BROADCAST_WORDS:
        links = links.unionByName(_searched_by_broadcast(hot, many, radius))
    elif many:
        further = F.get(F.array(*[F.array(*[F.struct(F.lit(len(masks) * (i + 1) + j).alias("band"), signed(m).alias("mask")) for j, m in enumerate(further_masks(mask))]) for i, mask in enumerate(masks)]), F.col("band"))
        cut = hot.select("fp", F.explode(further).alias("m")).select(F.col("m.band").alias("band"), F.col("fp").bitwiseAND(F.col("m.mask")).alias("shard"), "fp")
        links = links.unionByName(_searched(cut, radius))
    return links.distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): for each node of `links` (a, b), the smallest node that it reaches (as signed longs).

    Alternates star operations: each node hands its larger neighbours (then its smaller ones) to the smallest it knows, until
    nothing moves. Rounds grow with the logarithm of the longest chain. Every step is a checkpoint: lost executors cost no more than
    the step at hand, and joins read plain tables, so that a hot node can be split. Empty links give an empty table.
    """
    ensure_checkpoint_dir(links.sparkSession)
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct().checkpoint()
    signature = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).checkpoint()
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct().checkpoint()
        low = large.groupBy("u").agg(F.min("v").alias("m")).checkpoint()
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = small.where("u <> v").distinct().checkpoint()
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == signature:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        signature = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _grouped(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, first_id, root) of each distinct fingerprint of `prints` (doc_id, fp): its smallest id and the fingerprint that stands for its component."""
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(fingerprint_links(classes.select("fp"), radius))
    return classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id reachable over links of `radius` bits or fewer).

    One row for each row of `docs`; equal fingerprints share a component, texts without words (fingerprint zero) too. Rows whose doc_id
    is null keep their row; the component's id is its smallest id that is not null (null if it has none). Texts of any length are fingerprinted whole; repeated rows
    give repeated results; there are no ties: a bit set in just half of the hashes is 0. Empty tables give no rows. Other columns, whatever their names, are left out.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    prints = with_fingerprints(docs).checkpoint()
    grouped = _grouped(prints, radius)
    least = grouped.groupBy("root").agg(F.min("first_id").alias("component_id")).checkpoint()  # a plain table: a hot root can then be split in the join
    named = grouped.select("fp", "root").join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
