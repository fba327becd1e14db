"""Near copies by the exact likeness (Jaccard) of five-word shingles, 0.8 or more, found by SimHash fingerprints in BK-trees.

In one fixed order of all shingles, two sets of likeness t share a shingle among the first n - ceil(t n) + 1 of each (n its size): these are the
shards, and no pair of likeness t is missed by them. Any order will do: shingles that a sample finds in many texts come last, so that
stock lines make no shard. The fingerprints (128 bits) of a shard are a BK-tree, searched within RADIUS. At likeness 0.8 a bit
differs with a chance of arccos(8/9) / pi = 0.15, 19 bits of 128 with a deviation of 4: RADIUS is over three deviations more. Few shingles make that chance uneven, so short texts have
fingerprints of another kind: the parity of their hashes on each bit. Those of two sets differ in no more bits than the sets in elements, (n + m) / 9 at likeness 0.8, so none is missed.

Only groups are wanted, not pairs. In each shard all texts are first compared with one of them, the leader; texts that it joins to one group have nothing to ask, since whoever isn't in the group asks all.
A shard that many texts share, as sampled, has its leader from the sample, so texts are joined where they are read; only what others of such a shard ask is dealt to tasks, some askers in each.
What is found joins texts to candidate groups; within these pairs are tested by their exact likeness.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from terrastack.llm.blocks import mix
from terrastack.llm.common import block_count, ensure_checkpoint_dir, give_back
from terrastack.llm.simhash import SEED, BKTree, components, spanning

LIKENESS = 0.8
SHINGLE_WORDS = 5
#: Bits of 128 that the SimHash fingerprints of a pair differ in at most.
RADIUS = 32
#: Sets of up to so many shingles have parity fingerprints, those above SHORT_FROM have SimHash fingerprints: sets of a pair's sizes always have one kind in common.
SHORT, SHORT_FROM = 60, 47
#: UTF-8 bytes of text for each range of shards: about as many bytes of shards.
RANGE_BYTES = 8_000_000
#: Texts sampled at most for common shingles, and in how many of them a shingle is common.
SAMPLED, COMMON = 4_000, 8
#: Sampled texts that share a shingle from which on its shard has a leader from the sample: one in a hundred.
LED = 40
#: Fingerprints that are searched for at a time.
SEARCHED = 128
#: Texts of a candidate group, or of a hot shard, that one task asks for.
QUERY_BLOCK = 1024
#: 64-bit words of the marks that bound how much two sets share.
MARK = 32
_TOP = np.uint64(1 << 63)
#: size: shingles of a text with a parity fingerprint, 0 for SimHash.
_ENTRY = np.dtype([("key", "<u8"), ("text", "<i8"), ("print", "<u8", 2), ("size", "<i4")])
_SECOND = np.uint64(0x9E3779B97F4A7C15)
#: Turns the keys of parity fingerprints, which are shards of their own.
_PARITY = np.uint64(0xA5A5A5A5_5A5A5A5A)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def digest(text: str | None) -> int:
    """Equal for texts of the same words, as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(words_of(text)))).view(np.int64))


def shingles(words: list[bytes]) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; shorter texts are one shingle, texts without words none."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= SHINGLE_WORDS:
        parts = [b" ".join(words)]
    else:
        parts = [b" ".join(s) for s in zip(*(words[i:] for i in range(SHINGLE_WORDS)), strict=False)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in parts), np.uint64, len(parts)))


def fingerprint(own: np.ndarray) -> np.ndarray:
    """Two words of bits set in over half of the distinct shingles' hashes."""
    votes = np.zeros(128, np.int64)
    for start in range(0, len(own), 8192):
        part = own[start : start + 8192]
        both = np.stack([part, mix(part, np.full(len(part), _SECOND))], 1)
        votes += np.unpackbits(both.view(np.uint8).reshape(-1, 16), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(votes * 2 > len(own), bitorder="little").view(np.uint64)


def parity(own: np.ndarray) -> np.ndarray:
    """Two words whose bits tell whether an odd number of the shingles fall on them."""
    return np.packbits(np.bincount((own >> np.uint64(17)).astype(np.int64) % 128, minlength=128) % 2, bitorder="little").view(np.uint64)


def prefix(own: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first shingles of a set, of which every set of LIKENESS shares one with it."""
    many = len(own) - math.ceil(len(own) * LIKENESS - 1e-9) + 1
    order = own >> np.uint64(1)
    if len(common):
        order = np.where(common[np.minimum(np.searchsorted(common, own), len(common) - 1)] == own, order | _TOP, order)
    return own[np.argsort(order, kind="stable")[:many]]


def entries_of(name: int, own: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The text's entry in each of its shards, of either kind of fingerprint that its size has."""
    keys = prefix(own, common)
    kinds = [(keys ^ _PARITY, parity(own), len(own))] if len(own) <= SHORT else []
    if len(own) > SHORT_FROM:
        kinds.append((keys, fingerprint(own), 0))
    entries = np.empty(len(keys) * len(kinds), _ENTRY)
    for i, (key, mark, size) in enumerate(kinds):
        part = entries[i * len(keys) : (i + 1) * len(keys)]
        part["key"], part["text"], part["print"], part["size"] = key, name, mark, size
    return entries


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether entries of one shard, pair by pair, can be of texts of LIKENESS by their fingerprints."""
    apart = np.bitwise_count(a["print"] ^ b["print"]).sum(-1, dtype=np.int64)
    return apart <= np.where(a["size"] > 0, (a["size"].astype(np.int64) + b["size"]) // 9, RADIUS)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard coefficient of two sorted sets."""
    shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) and len(b) else 0
    return shared / max(1, len(a) + len(b) - shared)


def shard_links(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, first text of its group) over the texts of each shard that are near by their fingerprints: at most a row for each text.

    Each shard's first entry is its leader. Entries that are near it, or whose texts another shard has put into its group, don't ask; the others search the shard's tree.
    """
    entries = entries[np.lexsort((entries["text"], entries["size"], *entries["print"].T, entries["key"]))]
    texts, which = np.unique(entries["text"], return_inverse=True)
    new = np.ones(len(entries), bool)
    new[1:] = (entries["key"][1:] != entries["key"][:-1]) | (entries["print"][1:] != entries["print"][:-1]).any(1) | (entries["size"][1:] != entries["size"][:-1])
    first = np.flatnonzero(new)
    # texts of one shard, fingerprint and size are one node of its tree
    root = spanning(np.arange(len(texts)), which, which[first[np.cumsum(new) - 1]])
    shards = entries["key"][first]
    more = np.zeros(len(first), bool)
    more[1:] = shards[1:] == shards[:-1]
    more[:-1] |= more[1:]
    nodes, owner = entries[first[more]], which[first[more]]
    _, start, shard = np.unique(nodes["key"], return_index=True, return_inverse=True)
    leader = start[shard]
    joined = near(nodes, nodes[leader])
    root = spanning(root, owner[joined], owner[leader[joined]])
    asks = np.flatnonzero(root[owner] != root[owner[leader]])
    if len(asks):
        wanted = np.zeros(len(start), bool)
        wanted[shard[asks]] = True  # trees of shards that someone asks
        kept = np.flatnonzero(wanted[shard])
        place = np.cumsum(wanted[shard]) - 1
        tree = BKTree(nodes["print"][kept].copy(), shard[kept])
        for at in range(0, len(asks), SEARCHED):
            some = asks[at : at + SEARCHED]
            some = some[root[owner[some]] != root[owner[leader[some]]]]  # others may have joined them since
            radius = np.where(nodes["size"][some] > 0, nodes["size"][some] // 4, RADIUS)  # (n + m) / 9 with m up to 5 n / 4
            for asked, node in tree.found(nodes["print"][some], radius, tree.root[place[some]], SEARCHED):
                asked, node = some[asked], kept[node]
                good = near(nodes[asked], nodes[node])
                root = spanning(root, owner[asked[good]], owner[node[good]])
    linked = np.flatnonzero(root != np.arange(len(texts)))
    return texts[linked], texts[root[linked]]


def common_shingles(docs: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts of a sample hold, sorted, and leaders of the shards of the most common: the sampled text of the smallest name, by key. Neither decides a result."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(words_of(text)[:2000]).view(np.int64))], names=["s"])

    every = max(1, -(-rows // SAMPLED))
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text")
    found = sample.mapInArrow(work, "s long").groupBy("s").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "s").limit(200_000).toArrow()
    shared = found.column("s").to_numpy().view(np.uint64)
    common, led = np.sort(shared), shared[found.column("count").to_numpy() >= LED]
    if not len(led):
        return common, np.empty(0, _ENTRY)
    held = np.sort(np.concatenate((led, led ^ _PARITY)))

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                own = shingles(words_of(text))
                entries = entries_of(digest(text), own, common) if len(own) else np.empty(0, _ENTRY)
                entries = entries[_holds(held, entries["key"])]
                yield pa.RecordBatch.from_arrays([pa.array(entries["key"].view(np.int64)), pa.array(entries["text"]), pa.array([e.tobytes() for e in entries], pa.binary())], names=["key", "name", "entry"])

    leaders = sample.mapInArrow(lead, "key long, name long, entry binary").groupBy("key").agg(F.min(F.struct("name", "entry")).alias("m")).select("m.entry").toArrow()  # two for each such shingle at most
    entries = np.frombuffer(b"".join(leaders.column("entry").to_pylist()), _ENTRY)
    return common, entries[np.argsort(entries["key"])]


def _holds(sorted_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return sorted_[np.minimum(np.searchsorted(sorted_, keys), len(sorted_) - 1)] == keys if len(sorted_) else np.zeros(len(keys), bool)


def _texts(batches: Iterator[pa.RecordBatch], common: np.ndarray, leaders: np.ndarray, hot: bool) -> Iterator[np.ndarray]:
    """The entries of each text (once for each batch) in shards that have a leader already (`hot`), or in all others."""
    for batch in batches:
        seen = set()
        for text in batch.column(0).to_pylist():
            name = digest(text)
            own = shingles(words_of(text)) if name not in seen else np.empty(0, np.uint64)
            seen.add(name)
            if len(own):
                entries = entries_of(name, own, common)
                entries = entries[_holds(leaders["key"], entries["key"]) == hot]
                if len(entries):
                    yield entries


def candidate_links(docs: DataFrame) -> DataFrame:
    """(a, b): links that join the texts (by digest) of every candidate group."""
    ranges = block_count(docs, RANGE_BYTES)
    found = common_shingles(docs, docs.count())
    known = docs.sparkSession.sparkContext.broadcast(found)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        many = 0
        for entries in _texts(batches, *known.value, False):
            held.append(entries)
            many += len(entries)
            if many > 100_000:
                yield from dealt(np.concatenate(held))
                held, many = [], 0
        if held:
            yield from dealt(np.concatenate(held))
        give_back()

    def dealt(entries: np.ndarray) -> Iterator[pa.RecordBatch]:
        # by the hash's low half: the order of shingles is by the high bits, so ranges of these would not be even
        to = ((entries["key"] & np.uint64(0xFFFFFFFF)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        entries, to = entries[(order := np.argsort(to, kind="stable"))], to[order]
        cuts = np.flatnonzero(np.diff(to)) + 1
        parts = np.split(entries, cuts)
        yield pa.RecordBatch.from_arrays([pa.array(to[[0, *cuts]]), pa.array([p.tobytes() for p in parts], pa.binary())], names=["range", "packed"])

    def search(table: pa.Table) -> pa.Table:
        a, b = shard_links(np.concatenate([np.frombuffer(p, _ENTRY) for p in table.column("packed").to_pylist()]))
        give_back()
        return pa.table({"a": a, "b": b})

    links = docs.select("text").mapInArrow(pack, "range long, packed binary").groupBy("range").applyInArrow(search, "a long, b long")
    return (links.unionByName(_hot_links(docs.select("text"), known)) if len(found[1]) else links).distinct()


def _hot_links(texts: DataFrame, known: Broadcast) -> DataFrame:
    """(a, b) within shards that have a leader from the sample. Texts near a leader are joined to it where they are read; for the others, QUERY_BLOCK of a shard's askers meet its texts in a task."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, leaders = known.value
        for entries in _texts(batches, common, leaders, True):
            first = leaders[np.searchsorted(leaders["key"], entries["key"])]
            good = near(entries, first)
            names = np.unique(first["text"][good])
            keys = entries["key"][~good].view(np.int64)
            columns = [pa.array([None] * len(names) + keys.tolist(), pa.int64()), pa.array([int(entries["text"][0])] * (len(names) + len(keys)), pa.int64()), pa.array(names.tolist() + [None] * len(keys), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "a", "b"])

    met = texts.mapInArrow(meet, "key long, a long, b long").checkpoint()
    joined = met.where("key IS NULL AND a <> b").select("a", "b")
    asked = {r.key: -(-r.n // QUERY_BLOCK) for r in met.where("key IS NOT NULL").groupBy("key").agg(F.count_distinct("a").alias("n")).collect()}  # a row for each leader at most
    if not asked:
        return joined
    slices = texts.sparkSession.sparkContext.broadcast(asked)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, leaders = known.value
        for entries in _texts(batches, common, leaders, True):
            first = leaders[np.searchsorted(leaders["key"], entries["key"])]
            out: list[tuple] = []
            for entry, good in zip(entries, near(entries, first), strict=True):
                key = int(entry["key"].view(np.int64))
                many = slices.value.get(key, 0)
                own = -1 if good else int(entry["text"]) % max(many, 1)
                out += [(key, s, s == own, int(entry["text"]), entry.tobytes()) for s in range(many)]
            if out:
                types = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["key", "slice", "asks", "name", "entry"])

    rows = texts.mapInArrow(deal, "key long, slice int, asks boolean, name long, entry binary")
    sorted_ = rows.repartition("key", "slice").sortWithinPartitions("key", "slice", F.desc("asks"), "name")
    return joined.unionByName(sorted_.mapInArrow(_ask, "a long, b long"))


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows (key, slice, asks, name, entry) sorted by the first three, askers first: each row with the first near asker of each group of its slice's."""
    key, held, root = None, np.empty(0, _ENTRY), np.empty(0, np.int64)
    for batch in batches:
        found: list[tuple[int, int]] = []
        for shard, part, asks, name, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (shard, part) != key:
                key, held, root = (shard, part), np.empty(0, _ENTRY), np.empty(0, np.int64)
            own = np.frombuffer(packed, _ENTRY)
            hits = np.flatnonzero(near(held, own)) if len(held) else np.empty(0, np.int64)
            groups, first = np.unique(root[hits], return_index=True)
            found += [(name, int(held["text"][hits[i]])) for i in first if int(held["text"][hits[i]]) != name]
            if len(groups):
                root[np.isin(root, groups)] = groups[0]
            if asks:
                root = np.append(root, groups[0] if len(groups) else len(held))
                held = np.append(held, own)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _mark(own: np.ndarray) -> np.ndarray:
    """Bits of MARK words that a set's shingles fall on."""
    bits = np.zeros(64 * MARK, np.uint8)
    bits[(own >> np.uint64(20)).astype(np.int64) % (64 * MARK)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows (root, slice, asks, digest_, packed, far) sorted by the first three, askers first: each row is compared with the askers of its slice. Only these are held.

    What is left out before sets are compared is out by bounds: on sizes; on distances (1 - likeness is a metric, and `far` is that from the group's first text); and on marks: a text lacks
    at least one shingle for each place of another's mark that its own mark lacks.
    """
    key, held, names, sets, group = None, 0, [], [], []
    sizes, marks, fars = np.empty(0), np.empty((0, MARK), np.uint64), np.empty(0)
    for batch in batches:
        found: list[tuple[int, int]] = []
        for root, part, asks, name, packed, far in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (root, part) != key:
                key, names, sets, group, held = (root, part), [], [], [], 0
                sizes, marks, fars = np.empty(2 * QUERY_BLOCK), np.empty((2 * QUERY_BLOCK, MARK), np.uint64), np.empty(2 * QUERY_BLOCK)
            own = np.frombuffer(packed, "<u8")
            mark = _mark(own)
            able = np.flatnonzero((np.minimum(sizes[:held], len(own)) >= LIKENESS * np.maximum(sizes[:held], len(own)) - 1e-6) & (np.abs(fars[:held] - far) <= 1 - LIKENESS + 1e-6))
            most = np.minimum(len(own) - np.bitwise_count(mark & ~marks[able]).sum(1, dtype=np.int64), sizes[able] - np.bitwise_count(marks[able] & ~mark).sum(1, dtype=np.int64))
            able = able[most >= LIKENESS / (1 + LIKENESS) * (len(own) + sizes[able]) - 1e-6]
            met: set[int] = set()
            for j in able.tolist():
                while group[group[j]] != group[j]:
                    group[j] = group[group[j]]
                if group[j] not in met and likeness(sets[j], own) >= LIKENESS - 1e-12:
                    found.append((name, names[j]))
                    met.add(group[j])
            first = min(met, default=held)
            for g in met:
                group[g] = first
            if asks:
                if held == len(sizes):
                    sizes, marks, fars = np.resize(sizes, 2 * held), np.resize(marks, (2 * held, MARK)), np.resize(fars, 2 * held)
                sizes[held], marks[held], fars[held] = len(own), mark, far
                names.append(name)
                sets.append(own)
                group.append(first)
                held += 1
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])
        give_back()


def confirmed_links(sets: DataFrame) -> DataFrame:
    """(a, b) of pairs of LIKENESS that join all such pairs of each candidate group; `sets` has root, digest_, packed.

    Each text is first compared with one of its group. Those that are like it are joined by it; only the others ask for their like among all of the group, QUERY_BLOCK of
    them in a task, through which the group passes row by row. No task holds a group, and one large group of copies is compared once.
    """
    kept = sets.checkpoint()
    first = kept.groupBy("root").agg(F.min(F.struct("digest_", "packed")).alias("f")).select("root", F.col("f.digest_").alias("first_"), F.col("f.packed").alias("with_"))

    @F.pandas_udf("double")
    def distance(own: pd.Series, other: pd.Series) -> pd.Series:
        return pd.Series([1 - likeness(np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")) for a, b in zip(own, other, strict=True)], dtype=float)

    judged = kept.join(first, "root").select("root", "digest_", "packed", "first_", distance("packed", "with_").alias("far")).withColumn("alike_", F.col("far") <= 1 - LIKENESS + 1e-12).checkpoint()
    joined = judged.where("alike_ and digest_ <> first_").select(F.col("digest_").alias("a"), F.col("first_").alias("b"))
    others = judged.where(~F.col("alike_")).groupBy("root").agg(F.count(F.lit(1)).alias("n_"))
    slices = F.ceil(F.col("n_") / QUERY_BLOCK).cast("int")
    dealt = judged.join(others, "root").withColumn("own_", F.when(~F.col("alike_"), F.pmod(F.xxhash64("digest_"), slices).cast("int"))).withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1)))
    asked = dealt.select("root", "slice", F.coalesce(F.col("own_") == F.col("slice"), F.lit(False)).alias("asks"), "digest_", "packed", "far")
    sorted_ = asked.repartition("root", "slice").sortWithinPartitions("root", "slice", F.desc("asks"), "digest_")
    return joined.unionByName(sorted_.mapInArrow(_compare, "a long, b long"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, one for each component of near copies: the one with the smallest doc_id. All columns stay, whatever their names.

    Texts of the same words are copies, texts without words (null and empty ones) too; texts of any length are compared by all of their shingles. Null ids come
    last. Of rows that share the kept id and words, one stays, the first by the hash of its text. Empty tables give no rows.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    names = docs.columns
    own = {"doc_id": "doc_id", "text": "text"}
    plain = docs.select(*[F.col(f"`{c}`").alias(own.get(c, f"c{i}")) for i, c in enumerate(names)])

    @F.pandas_udf("long")
    def digests(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([digest(t) for t in part], dtype="int64")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                packed = [shingles(words_of(t)).tobytes() for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(packed, pa.binary())], names=["root", "digest_", "packed"])
        give_back()

    texts = plain.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    first = texts.select("doc_id", digests("text").alias("digest_")).groupBy("digest_").agg(F.min("doc_id").alias("first_id")).checkpoint()
    groups = components(candidate_links(texts)).checkpoint()
    members = groups.select("node", "root").unionByName(groups.select(F.col("root").alias("node"), "root")).distinct()
    met = texts.withColumn("digest_", digests("text")).join(members, F.col("digest_") == F.col("node")).groupBy("root", "digest_").agg(F.min("text").alias("text"))
    roots = components(confirmed_links(met.mapInArrow(pack, "root long, digest_ long, packed binary")))
    grouped = first.join(roots, F.col("digest_") == F.col("node"), "left").select("digest_", "first_id", F.coalesce("root", "digest_").alias("root"))
    best = grouped.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "digest_")).alias("k"))
    keys = best.select(F.col("k.digest_").alias("key_"), F.col("k.first_id").alias("id_")).checkpoint()
    marked = plain.withColumn("key_", digests(F.coalesce("text", F.lit("")))).withColumn("id_", F.col("doc_id"))
    kept = marked.join(keys, (marked["key_"] == keys["key_"]) & marked["id_"].eqNullSafe(keys["id_"]), "left_semi")
    place = F.row_number().over(W.partitionBy("key_", "id_").orderBy(F.xxhash64("text")))
    return kept.withColumn("place_", place).where("place_ = 1").select(*[F.col(c).alias(n) for c, n in zip(plain.columns, names, strict=True)])
