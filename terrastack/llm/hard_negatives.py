"""Hard negatives of anchors: the best rows of other labels whose inner product lies in a band below a positive's.

One-dimensional distance keys (iDistance: Jagadish et al., "iDistance: an adaptive B+-tree based indexing method for nearest neighbor search"). With one more component,
sqrt(M^2 - |x|^2), all rows lie on a sphere of radius M, the largest norm, and rows by falling inner product are rows by growing distance from the anchor
(Shrivastava and Li's reduction). Rows are stored sorted by (pivot, distance from it). A row at distance r from a pivot that is D from the anchor is at least |D - r|
and at most D + r away, so intervals of the key are scanned outwards from D, nearest first, until what is left is too far to matter.

Two rounds over cells (stretches of one pivot's keys) settle a search: the nearest cells give each anchor a k-th score, and only cells that can beat it are asked then; within a cell
chunks of rows are scanned outwards in the same way. Bounds have room for rounding, and scores are exact integers, so results are those of comparing with all rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from terrastack.sources.shared import shared_folder

#: Pivots and cells of a pivot at most: the directory of cells has PIVOTS * BANDS rows at most. Pivots are fitted on SAMPLE rows; every row is indexed by them.
PIVOTS, BANDS, SAMPLE = 64, 32, 2048
#: Rows of a pivot and of a cell that are aimed at, rows of a task's share of a cell, anchors of a task, rows of a chunk. None decides a result.
PIVOT_ROWS, CELL_ROWS, PART_ROWS, GROUP_ANCHORS, CHUNK = 4096, 4096, 1 << 16, 1 << 15, 2048
MOST = (1 << 63) - 1
LEAST = -MOST


@dataclass(frozen=True)
class Space:
    """What holds for all rows: components, largest norm, pivots (with the added component), whether float64 products are exact, room for rounding of half squared distances."""

    dims: int
    radius: float
    pivots: np.ndarray
    exact: bool

    @property
    def room(self) -> float:
        scale = 2 * self.radius + float(np.linalg.norm(self.pivots, axis=1).max())
        return 4 * sqrt((self.dims + 1) * 2.0**-52) * scale * scale

    def matrix(self, column: pa.ChunkedArray | pa.Array) -> np.ndarray:
        """The vectors as whole numbers, shorter ones filled up with zeros."""
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        lengths = np.diff(column.offsets.to_numpy())
        flat = column.flatten().to_numpy(zero_copy_only=False)
        found = np.zeros((len(column), self.dims), np.int64)
        found[np.arange(self.dims) < lengths[:, None]] = flat
        return found

    def distances(self, vectors: np.ndarray, on_sphere: bool) -> np.ndarray:
        """From each pivot. Rows are on the sphere; anchors have an added component of zero."""
        flat = vectors.astype(np.float64)
        norms = np.einsum("ij,ij->i", flat, flat)
        added = np.sqrt(np.maximum(self.radius**2 - norms, 0)) if on_sphere else np.zeros(len(flat))
        squares = (norms + added**2)[:, None] + (self.pivots**2).sum(1) - 2 * (flat @ self.pivots[:, :-1].T + np.outer(added, self.pivots[:, -1]))
        return np.sqrt(np.maximum(squares, 0))

    def products(self, anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact inner products; those beyond 64 bits are the nearest end of that range."""
        if self.exact:
            return (anchors.astype(np.float64) @ rows.astype(np.float64, copy=False).T).astype(np.int64)
        return np.clip(anchors.astype(object) @ rows.astype(object).T, LEAST, MOST).astype(np.int64)


def fit_space(rows: DataFrame, pivots: int) -> Space | None:
    """The space of `rows`, with pivots by Lloyd's iterations over SAMPLE rows taken by a hash of their ids; None without rows."""
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    largest = F.coalesce(F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double")))), F.lit(0.0))
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dims"), F.max(square).alias("square"), F.max(largest).alias("largest")).first()
    if not facts.n:
        return None
    dims = max(1, facts.dims)
    bare = Space(dims, sqrt(facts.square), np.zeros((1, dims + 1)), dims * facts.largest**2 < 2**53)
    sample = bare.matrix(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toArrow().column("vector")).astype(np.float64)
    points = np.column_stack((sample, np.sqrt(np.maximum(bare.radius**2 - (sample**2).sum(1), 0))))
    points = points[np.lexsort(points.T)]
    wanted = max(1, min(pivots, PIVOTS, facts.n // PIVOT_ROWS))
    centres = points[np.linspace(0, len(points) - 1, wanted).astype(int)]
    for _ in range(8):
        nearest = ((centres**2).sum(1) - 2 * points @ centres.T).argmin(1)
        centres = np.stack([points[nearest == i].mean(0) if (nearest == i).any() else c for i, c in enumerate(centres)])
    return Space(dims, bare.radius, centres, bare.exact)


@dataclass(frozen=True)
class Index:
    """Rows stored by (pivot, distance), and the directory of their cells: pivot, least and largest distance, parts."""

    space: Space
    rows: DataFrame
    pivot: np.ndarray
    least: np.ndarray
    largest: np.ndarray
    count: np.ndarray

    @property
    def parts(self) -> np.ndarray:
        return -(-self.count // PART_ROWS)


def _by_number(values: np.ndarray, number: str) -> Column:
    """The value at a small whole number's place: an array literal, written as text so that a long one is a short plan."""
    kind = "array<double>" if values.dtype.kind == "f" else "array<long>"
    return F.get(F.split(F.lit(",".join(map(repr, values.tolist()))), ",").cast(kind), F.col(number))


def build_index(rows: DataFrame, folder: str, pivots: int = PIVOTS) -> Index | None:
    """Stores `rows` (vec_id, label, vector) sorted by (pivot, distance). Rows with equal keys are told apart by their place in their input file, so that copies of one vector spread over tasks."""
    space = fit_space(rows, pivots)
    if space is None:
        return None

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            far = space.distances(space.matrix(batch.column("vector")), True)
            nearest = far.argmin(1)
            own = [pa.array(nearest, pa.int32()), pa.array(far[np.arange(len(far)), nearest]), pa.array(np.arange(seen, seen + len(far)), pa.int64())]
            seen += len(far)
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=[*batch.schema.names, "pivot", "distance", "salt"])

    placed = rows.mapInArrow(place, "vec_id long, label long, vector array<long>, pivot int, distance double, salt long")
    many = len(space.pivots)
    low, step, bands = np.zeros(many), np.ones(many), np.ones(many, np.int64)
    for r in placed.groupBy("pivot").agg(F.min("distance").alias("a"), F.max("distance").alias("b"), F.count(F.lit(1)).alias("n")).collect():  # PIVOTS rows at most
        bands[r.pivot] = min(BANDS, -(-r.n // CELL_ROWS))
        low[r.pivot], step[r.pivot] = r.a, max(r.b - r.a, 1e-300) / bands[r.pivot]
    band = F.least(F.floor((F.col("distance") - _by_number(low, "pivot")) / _by_number(step, "pivot")).cast("int"), _by_number(bands - 1, "pivot").cast("int"))
    placed.withColumn("cell", F.col("pivot") * BANDS + band).repartitionByRange("pivot", "distance", "salt").sortWithinPartitions("pivot", "distance", "salt").write.parquet(f"{folder}/index")
    stored = rows.sparkSession.read.parquet(f"{folder}/index")
    found = stored.groupBy("cell").agg(F.min("distance").alias("a"), F.max("distance").alias("b"), F.count(F.lit(1)).alias("n")).collect()  # PIVOTS * BANDS rows at most
    least, largest, count = np.full(many * BANDS, np.inf), np.full(many * BANDS, -np.inf), np.zeros(many * BANDS, np.int64)
    for r in found:
        least[r.cell], largest[r.cell], count[r.cell] = r.a, r.b, r.n
    part = F.pmod(F.col("salt"), _by_number(np.maximum(1, -(-count // PART_ROWS)), "cell")).cast("int")
    return Index(space, stored.withColumn("part", part), np.arange(many * BANDS) // BANDS, least, largest, count)


ASKS = "ask_id long, anchor_id long, label long, vector array<long>, same boolean, lows array<long>, highs array<long>, bounds array<long>"


def _reach(space: Space, square: np.ndarray, far: np.ndarray, least: np.ndarray, largest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest possible inner products with rows whose distance from the pivot is `least` to `largest`, for anchors `far` from it."""
    near = np.maximum(0, np.maximum(far - largest, least - far))
    half = (square + space.radius**2) / 2
    return half - (far + largest) ** 2 / 2 - space.room, half - near**2 / 2 + space.room


def _floats(column: pa.Array, width: int, fill: int) -> np.ndarray:
    found = np.full((len(column), width), fill, np.int64)
    for i, row in enumerate(column.to_pylist()):
        found[i, : len(row)] = row
    return found


def _visits(index: Index, asks: DataFrame, first: bool, groups: int) -> DataFrame:
    """A row for each ask and part of a cell that it visits: the nearest cells that can hold a hit in the first round, all others that can still beat the ask's bounds afterwards."""
    space, parts = index.space, index.parts
    pivot, least, largest, count = index.pivot, index.least, index.largest, index.count

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                vectors = space.matrix(batch.column("vector"))
                far = space.distances(vectors, False)[:, pivot]
                square = (vectors.astype(np.float64) ** 2).sum(1)[:, None]
                below, above = _reach(space, square, far, least, largest)
                width = max(1, max(len(x) for x in batch.column("lows").to_pylist()))
                lows, highs, bounds = (_floats(batch.column(c), width, f).astype(np.float64) for c, f in (("lows", MOST), ("highs", LEAST), ("bounds", MOST)))
                opens = lambda floor: ((above[:, :, None] >= floor[:, None, :]) & (below[:, :, None] <= highs[:, None, :])).any(2) & (count > 0)
                may = opens(lows)
                # outwards from the anchor's own distance, until the cells visited hold a few chunks of rows
                order = np.argsort(np.where(may, -above, np.inf), axis=1, kind="stable")
                held = np.cumsum(np.take_along_axis(np.where(may, count, 0), order, 1), axis=1)
                early = np.zeros_like(may)
                np.put_along_axis(early, order, np.concatenate((np.zeros((len(held), 1)), held[:, :-1]), 1) < 2 * CHUNK, 1)
                visit = may & early if first else opens(np.maximum(lows, bounds)) & ~early
                ask, cell = np.nonzero(visit)
                again = np.repeat(np.arange(len(ask)), parts[cell])
                part = np.arange(len(again)) - np.repeat(np.cumsum(parts[cell]) - parts[cell], parts[cell])
                for cut in range(0, len(again), 4096):
                    one = slice(cut, cut + 4096)
                    rows, cells = ask[again[one]], cell[again[one]]
                    own = [pa.array(cells, pa.int32()), pa.array(part[one], pa.int32()), pa.array(far[rows, cells])]
                    yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows)).columns, *own], names=[*batch.schema.names, "cell", "part", "far"])

    visits = asks.mapInArrow(work, f"{ASKS}, cell int, part int, far double")
    return visits.withColumn("group", F.pmod(F.xxhash64("ask_id"), F.lit(groups)).cast("int"))


def _scan(index: Index, k: int):
    """The best k hits of each ask's slots among one part of a cell."""
    space = index.space
    schema = pa.schema([("ask_id", pa.int64()), ("slot", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64()), ("own", pa.bool_())])

    def best(ids: np.ndarray, scores: np.ndarray, own: np.ndarray) -> np.ndarray:
        if len(ids) > 4 * k:  # equal scores at the edge all stay until ids decide
            edge = np.partition(scores, len(scores) - k)[len(scores) - k]
            keep = np.flatnonzero(scores >= edge)
            return keep[np.lexsort((own[keep], ids[keep], -scores[keep]))[:k]]
        return np.lexsort((own, ids, -scores))[:k]

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        left = left.sort_by("distance")
        vectors, ids, labels = space.matrix(left.column("vector")), left.column("vec_id").to_numpy(), left.column("label").to_numpy()
        distance = left.column("distance").to_numpy()
        starts = np.arange(0, len(ids), CHUNK)
        least, largest = distance[starts], distance[np.minimum(starts + CHUNK, len(ids)) - 1]
        rows_of = [vectors[s : s + CHUNK].astype(np.float64) if space.exact else vectors[s : s + CHUNK] for s in starts]
        out: list[tuple] = []
        for cut in range(0, right.num_rows, 256):
            asks = right.slice(cut, 256)
            own, far = space.matrix(asks.column("vector")), asks.column("far").to_numpy()
            square = (own.astype(np.float64) ** 2).sum(1)
            below, above = _reach(space, square[:, None], far[:, None], least, largest)
            order = np.argsort(-above, axis=1, kind="stable")
            names, same, ask_ids, anchor_labels = (asks.column(c).to_pylist() for c in ("anchor_id", "same", "ask_id", "label"))
            slots = [[[lo, hi, bd, np.empty((3, 0), np.int64)] for lo, hi, bd in zip(*x, strict=True)] for x in zip(*(asks.column(c).to_pylist() for c in ("lows", "highs", "bounds")), strict=True)]
            active = np.ones(len(own), bool)
            for turn in range(len(starts)):
                chunk_of = order[:, turn]
                for chunk in np.unique(chunk_of[active]):
                    now = np.flatnonzero(active & (chunk_of == chunk))
                    wanted = []
                    for a in now:
                        top = above[a, chunk]
                        if not any(top >= max(lo, bd) for lo, _, bd, _ in slots[a]):
                            active[a] = False  # chunks come by falling reach: no later one can matter
                        elif any(top >= max(lo, bd) and below[a, chunk] <= hi for lo, hi, bd, _ in slots[a]):
                            wanted.append(a)
                    if not wanted:
                        continue
                    s = starts[chunk]
                    products = space.products(own[wanted], rows_of[chunk])
                    for a, scores in zip(wanted, products, strict=True):
                        of_label = (labels[s : s + CHUNK] == anchor_labels[a]) == same[a]
                        for slot in slots[a]:
                            lo, hi, bd, held = slot
                            hit = np.flatnonzero(of_label & (scores >= max(lo, bd)) & (scores <= hi))
                            if not len(hit):
                                continue
                            mine = (ids[s + hit] == names[a]) & same[a]
                            for j in np.flatnonzero(mine):
                                mine[j] = np.array_equal(vectors[s + hit[j]], own[a])
                            held = np.concatenate((held, np.stack((scores[hit], ids[s + hit], mine.astype(np.int64)))), 1)
                            held = held[:, best(held[1], held[0], held[2])]
                            slot[3] = held
                            if held.shape[1] == k:
                                slot[2] = max(bd, int(held[0, -1]))
            for ask_id, found in zip(ask_ids, slots, strict=True):
                for number, (_, _, _, held) in enumerate(found):
                    out += [(ask_id, number, *hit) for hit in held.T.tolist()]
        columns = list(zip(*out, strict=True)) or [()] * 5
        return pa.Table.from_arrays([pa.array(c, t) if t != pa.bool_() else pa.array([bool(x) for x in c], t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return work


def _best_of(hits: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy("ask_id", "slot").orderBy(F.desc("score"), "vec_id", "own"))
    return hits.withColumn("place", place).where(F.col("place") <= k)


def search(index: Index, asks: DataFrame, k: int, folder: str, many: int) -> DataFrame:
    """ask_id, slot, score, vec_id, own, place: the k best rows of each slot (a range of scores) of each ask, by score, then vec_id; `own` marks the ask's own row or a copy of it.

    `asks` (ASKS): rows of the same label or of others are sought; `many` of them decide into how many groups they go, each of which meets each part of the index in a task of its own.
    """
    spark, groups = asks.sparkSession, max(1, -(-many // GROUP_ANCHORS))
    rows = index.rows.select("cell", "part", "vec_id", "label", "vector", "distance", F.explode(F.array(*[F.lit(g) for g in range(groups)])).alias("group"))
    for number, first in enumerate((True, False)):
        if not first:
            kth = spark.read.parquet(f"{folder}/0").where(F.col("place") == k).groupBy("ask_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("kth"))
            raised = F.expr(f"transform(bounds, (b, i) -> coalesce(kth[i], {LEAST}L))")
            asks = asks.join(kth, "ask_id", "left").withColumn("bounds", raised).select(*[c.split()[0] for c in ASKS.split(", ")])
        visits = _visits(index, asks, first, groups)
        keys = ["cell", "part", "group"]
        hits = rows.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInArrow(_scan(index, k), "ask_id long, slot int, score long, vec_id long, own boolean")
        _best_of(hits, k).write.parquet(f"{folder}/{number}")
    both = spark.read.parquet(f"{folder}/0", f"{folder}/1").drop("place")
    return _best_of(both, k)


def _tenths(tenths: int, rounding: str) -> Column:
    """positive_score * tenths / 10, rounded up or down, without leaving 64 bits."""
    return F.expr(f"{tenths} * (positive_score div 10) + CAST({rounding}({tenths} * (positive_score % 10) / 10D) AS BIGINT)")


def hard_negatives(rows: DataFrame, anchor_every: int = 100, positives: int = 5, negatives: int = 10, low_tenths: int = 3, high_tenths: int = 9, pivots: int = PIVOTS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of `rows` (vec_id long, label long, vector array<long>).

    Anchors are rows whose vec_id is divisible by `anchor_every`; their positives are the first `positives` other rows of their label by inner product, then vec_id; for each, the first
    `negatives` rows of other labels whose score is low_tenths to high_tenths tenths of the positive's (none of a negative positive score), ranked from 1.
    Rows with a null in any of the three columns take no part. Shorter vectors count as filled up with zeros, an empty one is zero; scores beyond 64 bits are the nearest end of that range.
    Repeated rows are rows each: an anchor's copies are positives of it, and a repeated anchor is answered as often as it is there; a repeated positive or negative likewise.
    Empty tables, and labels or anchors without partners, give no rows. Other columns, whatever their names, are left out.
    """
    spark = rows.sparkSession
    rows = rows.select("vec_id", "label", "vector").where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND forall(vector, x -> x IS NOT NULL)")
    folder = f"{shared_folder(spark)}/hard-negatives-{uuid.uuid4().hex}"
    index = build_index(rows, folder, pivots)
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if index is None:
        return spark.createDataFrame([], empty)
    anchors = index.rows.where(F.col("vec_id") % anchor_every == 0).groupBy("vec_id", "label", "vector").agg(F.count(F.lit(1)).alias("copies"))
    anchors.select(F.monotonically_increasing_id().alias("ask_id"), F.col("vec_id").alias("anchor_id"), "label", "vector", "copies").write.parquet(f"{folder}/anchors")
    anchors = spark.read.parquet(f"{folder}/anchors")
    many = anchors.count()
    if not many:
        return spark.createDataFrame([], empty)
    of = lambda *columns: anchors.select("ask_id", "anchor_id", "label", "vector", *columns)
    longs = lambda v: F.array(F.lit(v).cast("long"))
    asks = of(F.lit(True).alias("same"), longs(LEAST).alias("lows"), longs(MOST).alias("highs"), longs(LEAST).alias("bounds"))
    found = search(index, asks, positives + 1, f"{folder}/positives", many)
    # the anchor itself is one of the hits, or comes after all of them
    itself = F.when(F.col("own"), F.row_number().over(W.partitionBy("ask_id", "own").orderBy("place")) == 1).otherwise(False)
    others = found.withColumn("itself", itself).where(~F.col("itself")).withColumn("slot", F.row_number().over(W.partitionBy("ask_id").orderBy("place")) - 1).where(F.col("slot") < positives)
    others.select("ask_id", "slot", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).write.parquet(f"{folder}/others")
    others = spark.read.parquet(f"{folder}/others")
    negative = F.col("positive_score") < 0  # an empty range
    low, high = F.when(negative, 1).otherwise(_tenths(low_tenths, "ceil")), F.when(negative, 0).otherwise(_tenths(high_tenths, "floor"))
    ranges = others.select("ask_id", F.struct("slot", low.alias("lo"), high.alias("hi")).alias("r"))
    ranges = ranges.groupBy("ask_id").agg(F.sort_array(F.collect_list("r")).alias("r"))  # `positives` of them at most
    asks = anchors.join(ranges, "ask_id").select(
        "ask_id", "anchor_id", "label", "vector", F.lit(False).alias("same"), F.col("r.lo").alias("lows"), F.col("r.hi").alias("highs"), F.transform("r", lambda _: F.lit(LEAST).cast("long")).alias("bounds")
    )
    found = search(index, asks, negatives, f"{folder}/negatives", many)
    answered = found.join(others, ["ask_id", "slot"]).join(anchors.select("ask_id", "anchor_id", "copies"), "ask_id")
    answered = answered.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return answered.select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def scaled_rows(table: DataFrame) -> DataFrame:
    """vec_id, label, vector of the rows that take part in the query: components floor(256 x), labels of every seventh vec_id moved on by one of ten."""
    whole = "embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    rows = table.where(f"vec_id IS NOT NULL AND label IS NOT NULL AND {whole}")
    vector = F.expr("transform(embedding, x -> floor(256D * CAST(x AS DOUBLE)))").alias("vector")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long").alias("label")
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), label, vector)
