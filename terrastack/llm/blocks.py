"""Corpus-wide lookups for blocks of documents: each block asks for each of its distinct keys once.

Documents are dealt to blocks of bounded bytes by a hash of their id and text, and kept as a table bucketed by block, which later steps read without a
shuffle. A block sends its distinct 64-bit keys, with what it knows of them, as packed arrays to ranges of keys; a range merges what all blocks
sent for a key; the block then gets the merged values in the order of its own keys. A key that fills a third of the corpus is one entry of each
block, so there are no hot keys, and there are never more entries than distinct keys of blocks.

A block sends FAN rows at most. Where there are more blocks than that, FAN blocks are gathered for each range, merged, and sent on as finer ranges; the answers go back the same way. With b
blocks these are b^2 / FAN rows: few up to a million blocks (9 TB of text), beyond which a third level would be needed that is not built.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrastack.llm.common import block_count, ensure_checkpoint_dir, give_back

#: UTF-8 bytes of text in a block: what one task holds at a time.
BLOCK_BYTES = 9_000_000
#: Partitions that blocks are dealt to at most; beyond it a task takes several blocks, one after another.
MOST_PARTITIONS = 20_000
#: Ranges of keys that a block sends to at most, and blocks whose entries are gathered.
FAN = 1024
LEVEL = 3  # of zstd: texts are read once or more for each time they are written


def deal(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """(rows of `docs`, which has doc_id and text, dealt to blocks; how many blocks). Of rows that are equal in both columns, those of one batch go to blocks in turn, so that one row that
    is repeated without end is no hot block.

    Rows travel as compressed record batches (block_, rows_), one for each input batch and block. The result is a table in the shared checkpoint folder; its catalog entry, which tells
    of the buckets, is dropped once the returned frame knows its files.
    """
    blocks = block_count(docs, block_bytes)
    keyed = docs.withColumn("block_", F.xxhash64("doc_id", "text"))

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", LEVEL))
        for batch in batches:
            _, which, many = np.unique(batch.column("block_").to_numpy(), return_inverse=True, return_counts=True)
            turn = np.empty(len(which), np.int64)
            turn[np.argsort(which, kind="stable")] = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
            block = ((batch.column("block_").to_numpy().view(np.uint64) + turn.astype(np.uint64)) % np.uint64(blocks)).astype(np.int32)
            rows = batch.drop_columns(["block_"])
            order = np.argsort(block, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
                if not len(part):
                    continue
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=options) as writer:
                    writer.write_batch(rows.take(pa.array(part)))
                yield pa.RecordBatch.from_arrays([pa.array([block[part[0]]], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block_", "rows_"])

    spark, many = docs.sparkSession, min(blocks, MOST_PARTITIONS)
    ensure_checkpoint_dir(spark)
    name = f"dealt_{uuid.uuid4().hex}"
    dealt = keyed.mapInArrow(press, "block_ int, rows_ binary").repartition(many, "block_")
    dealt.write.bucketBy(many, "block_").option("path", f"{spark.sparkContext.getCheckpointDir()}/{name}").option("compression", "none").saveAsTable(name, format="parquet")
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # of a table with a path of its own the files stay
    return found, blocks


def rows_of(dealt: pa.Table) -> pa.Table:
    """The documents of a block. What earlier blocks have freed goes back to the system first: workers live long."""
    give_back()
    return pa.concat_tables([pa.ipc.open_stream(blob.as_buffer()).read_all() for blob in dealt.column("rows_")])


def mix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A 64-bit hash of pairs of 64-bit words: odd multipliers and xor-shifts."""
    h = left * np.uint64(0x9E3779B97F4A7C15) + (right ^ (right >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _press(array: np.ndarray) -> bytes:
    """The array's bytes, all first ones, then all second ones and so on, deflated: high bytes of small numbers take next to nothing."""
    return zlib.compress(np.ascontiguousarray(array.view(np.uint8).reshape(len(array), -1).T).tobytes(), 1) if len(array) else b""


def _open(blob: bytes, dtype: np.dtype | str) -> np.ndarray:
    kind = np.dtype(dtype)
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(blob) if blob else b"", np.uint8).reshape(kind.itemsize, -1).T).reshape(-1).view(kind)


def _press_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences: as many bytes each as the largest needs; those that an average one does not fill are deflated."""
    steps = np.diff(keys, prepend=np.uint64(0))[1:]
    width = max(1, -(-int(steps.max()).bit_length() // 8)) if len(steps) else 1
    plain = min(width, max(0, (int(keys[-1] - keys[0]) // len(steps)).bit_length() - 1) // 8) if len(steps) else 0
    planes = np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width, plain]) + keys[:1].astype("<u8").tobytes() + planes[:plain].tobytes() + zlib.compress(planes[plain:].tobytes(), 1)


def _open_keys(blob: bytes, many: int) -> np.ndarray:
    width, plain = blob[0], blob[1]
    steps = np.zeros((many, 8), np.uint8)
    steps[0] = np.frombuffer(blob, np.uint8, 8, 2)
    if many > 1:
        cut = 10 + plain * (many - 1)
        for at, planes, raw in ((0, plain, blob[10:cut]), (plain, width - plain, zlib.decompress(blob[cut:]))):
            if planes:
                steps[1:, at : at + planes] = np.frombuffer(raw, np.uint8).reshape(planes, -1).T
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _cut(who: tuple, keys: np.ndarray, arrays: list[np.ndarray], low: int, width: int) -> list[tuple]:
    """(*who, number of the range, how many, keys, arrays) for each range of `width` keys from `low` on that holds any of the sorted keys."""
    if not len(keys):
        return []
    part = (keys - np.uint64(low)) // np.uint64(width)
    first = np.flatnonzero(np.diff(part, prepend=np.uint64((1 << 64) - 1)))
    return [(*who, int(part[i]), int(j - i), _press_keys(keys[i:j]), *(_press(a[i:j]) for a in arrays)) for i, j in zip(first, [*first[1:], len(keys)], strict=True)]


class Lookup:
    """One kind of question: dtypes sent and got along the keys, how entries merge, and among how many blocks.

    merge(keys, which, arrays) gets distinct keys, the index among them of each entry sent, and the entries' arrays; it gives an array of each dtype in
    `got` along the distinct keys, and two integers, whose sums over s0 and s1 hold for the whole corpus. gather(keys, which, arrays) merges entries to one
    array of each dtype in `sent`, which stand for them in a later merge.
    """

    def __init__(self, blocks: int, sent: list, got: list, merge: Callable, gather: Callable):
        self.sent, self.got, self.merge, self.gather = [np.dtype(t) for t in sent], [np.dtype(t) for t in got], merge, gather
        self.ranges = min(blocks, FAN)
        self.finer = -(-blocks // FAN)
        self.width = max(2, -(-(1 << 64) // self.ranges)) if self.ranges > 1 else (1 << 64) - 1
        self.ins, self.outs = [f"v{i}" for i in range(len(sent))], [f"a{i}" for i in range(len(got))]
        binary = lambda names: "".join(f", {n} binary" for n in names)
        self.asked = f"block_ int, range_ int, n_ int, keys binary{binary(self.ins)}"
        self._sent_on = f"group_ int, range_ int, fine_ int, n_ int, keys binary{binary(self.ins)}"
        self._fine = f"group_ int, range_ int, fine_ int{binary(self.outs)}, s0 long, s1 long"
        self._answered = f"block_ int, range_ int{binary(self.outs)}, s0 long, s1 long"
        self.heard = f"block_ int, range_ int{binary(self.outs)}"

    def ask(self, block: int, keys: np.ndarray, arrays: list[np.ndarray]) -> pa.Table:
        """What a block sends of its sorted keys and of the arrays along them: rows of the schema `asked`."""
        return _table(_cut((block,), keys, [a.astype(t, copy=False) for a, t in zip(arrays, self.sent, strict=True)], 0, self.width), _schema(self.asked))

    def _entries(self, rows: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
        columns = {n: rows.column(n).to_pylist() for n in ["n_", "keys", *self.ins]}
        parts = [_open_keys(k, n) for k, n in zip(columns["keys"], columns["n_"], strict=True)]
        return parts, [np.concatenate([_open(b, t) for b in columns[n]]) for n, t in zip(self.ins, self.sent, strict=True)]

    def _merged(self, rows: pa.Table, who: list[str], schema: pa.Schema) -> pa.Table:
        parts, arrays = self._entries(rows)
        distinct, which = np.unique(np.concatenate(parts), return_inverse=True)
        merged, totals = self.merge(distinct, which, arrays)
        names, out, end = list(zip(*(rows.column(n).to_pylist() for n in who), strict=True)), [], 0
        for i, part in enumerate(parts):
            own = which[end : end + len(part)]
            end += len(part)
            out.append((*names[i], *(_press(m.astype(t, copy=False)[own]) for m, t in zip(merged, self.got, strict=True)), *(totals if i == 0 else (0, 0))))
        return _table(out, schema)

    def answers(self, questions: DataFrame, written: bool = False) -> tuple[DataFrame, DataFrame]:
        """(rows of the schema `heard`, a table whose columns s0 and s1 add up to the totals). Both come from checkpoints; so do the questions if they are `written`."""
        ensure_checkpoint_dir(questions.sparkSession)
        if self.finer == 1:
            done = questions.groupBy("range_").applyInArrow(lambda rows: self._merged(rows, ["block_", "range_"], _schema(self._answered)), self._answered).checkpoint()
            return done.drop("s0", "s1"), done.select("s0", "s1")
        group = F.floor(F.col("block_") / FAN).cast("int").alias("group_")
        asked = (questions if written else questions.checkpoint()).select(group, "*")

        def send_on(key: tuple, rows: pa.Table) -> pa.Table:
            parts, arrays = self._entries(rows)
            distinct, which = np.unique(np.concatenate(parts), return_inverse=True)
            who = tuple(k.as_py() for k in key)
            stand = [a.astype(t, copy=False) for a, t in zip(self.gather(distinct, which, arrays), self.sent, strict=True)]
            return _table(_cut(who, distinct, stand, who[1] * self.width, -(-self.width // self.finer)), _schema(self._sent_on))

        def hand_back(rows: pa.Table, back: pa.Table) -> pa.Table:
            parts, _ = self._entries(rows)
            _, which = np.unique(np.concatenate(parts), return_inverse=True)
            back = back.sort_by("fine_")
            merged = [np.concatenate([_open(b, t) for b in back.column(n).to_pylist()]) for n, t in zip(self.outs, self.got, strict=True)]
            out, end = [], 0
            for block, place, part in zip(rows.column("block_").to_pylist(), rows.column("range_").to_pylist(), parts, strict=True):
                out.append((block, place, *(_press(m[which[end : end + len(part)]]) for m in merged)))
                end += len(part)
            return _table(out, _schema(self.heard))

        sent_on = asked.groupBy("group_", "range_").applyInArrow(send_on, self._sent_on)
        fine = sent_on.groupBy("range_", "fine_").applyInArrow(lambda rows: self._merged(rows, ["group_", "range_", "fine_"], _schema(self._fine)), self._fine).checkpoint()
        back = asked.groupBy("group_", "range_").cogroup(fine.select("group_", "range_", "fine_", *self.outs).groupBy("group_", "range_")).applyInArrow(hand_back, self.heard)
        return back, fine.select("s0", "s1")

    def along(self, back: pa.Table) -> list[np.ndarray]:
        """The merged arrays along a block's sorted keys, from its rows of the schema `heard`."""
        back = back.sort_by("range_")
        return [np.concatenate([np.empty(0, t), *(_open(b, t) for b in back.column(n).to_pylist())]) for n, t in zip(self.outs, self.got, strict=True)]


class Memo:
    """An array that a block keeps from the step in which it asks to the step in which it hears: one more row among those of its questions."""

    outs = ["kept"]

    def __init__(self, lookup: Lookup, kind: np.dtype):
        self.lookup, self.kind = lookup, kind
        self.asked = f"{lookup.asked}, kept binary"

    def ask(self, block: int, keys: np.ndarray, arrays: list[np.ndarray], kept: np.ndarray) -> pa.Table:
        """The block's questions, and what it keeps in a row of range -1: rows of the schema `asked`."""
        questions, schema = self.lookup.ask(block, keys, arrays), _schema(self.asked)
        asked = questions.append_column("kept", pa.nulls(len(questions), pa.binary()))
        own = {"block_": block, "range_": -1, "n_": 0, "kept": _press(kept)}
        return pa.concat_tables([asked, pa.Table.from_pylist([own], schema)])

    def questions(self, sent: DataFrame) -> DataFrame:
        return sent.where("range_ >= 0").drop("kept")

    def kept(self, sent: DataFrame) -> DataFrame:
        return sent.where("range_ < 0").select("block_", "range_", "kept")

    def along(self, back: pa.Table) -> list[np.ndarray]:
        return [_open(back.column("kept")[0].as_py(), self.kind)]


def _schema(text: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in text.split(", "))])


def first_questions(blocked: DataFrame, work: Callable[[pa.Table], tuple], lookup: Lookup) -> DataFrame:
    """Rows of lookup.asked: work(documents of a block) gives its sorted keys and the arrays along them."""
    return blocked.groupBy("block_").applyInArrow(lambda dealt: lookup.ask(dealt.column("block_")[0].as_py(), *work(rows_of(dealt))), lookup.asked)


def with_answers(blocked: DataFrame, heard: list[tuple[Lookup | Memo, DataFrame]], work: Callable, schema: str) -> DataFrame:
    """work(number of the block, its documents, for each lookup the merged arrays along the block's sorted keys) for each block."""
    parts, lookups = [], [lookup for lookup, _ in heard]
    for turn, (lookup, answers) in enumerate(heard):
        parts.append(answers.select("block_", "range_", F.lit(turn).alias("turn_"), F.array(*lookup.outs).alias("arrays_")))

    def run(dealt: pa.Table, back: pa.Table) -> pa.Table:
        turns = back.column("turn_").to_numpy()
        found = []
        for turn, lookup in enumerate(lookups):
            own = back.take(np.flatnonzero(turns == turn))
            spread = own.column("arrays_").to_pylist()
            columns = {"range_": own.column("range_"), **{n: pa.array([s[i] for s in spread], pa.binary()) for i, n in enumerate(lookup.outs)}}
            found.append(lookup.along(pa.table(columns)))
        return work(dealt.column("block_")[0].as_py(), rows_of(dealt), found)

    return blocked.groupBy("block_").cogroup(reduce(DataFrame.unionByName, parts).groupBy("block_")).applyInArrow(run, schema)
