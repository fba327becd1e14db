"""Substring deduplication by content-defined chunks.

A gear rolling hash over the last 16 bytes is taken at the end of each word (in long runs without white space, at each character); where it is low the
text is cut. Cuts depend on those bytes and on white space near them alone, so chunks after an insertion are the same as before it. Chunks are deduplicated
by digest over the whole corpus: the first occurrence, in order of doc_id and place, owns the chunk. A run of repeated chunks in a document is a candidate. Passages begin and
end inside chunks: owners tell the REACH words on either side of their repeated chunks (as 16-bit hashes), and a candidate grows over the words that are the same. It is a repeated passage if it
is long enough then, and its chunks follow each other in an owner too, or most of its words come from one owner; shorter repeats (stock phrases and lines) are left alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrastack.llm import blocks

WINDOW = 16
#: One word end in CUT_WORDS is a cut; in runs of LONG_RUN bytes without white space one character in CUT_CHARACTERS.
CUT_WORDS, LONG_RUN, CUT_CHARACTERS = 4, 64, 12
#: A passage is removed if it has this many words once it has grown, and this many of them come from its main owner or follow each other in their owners.
MIN_WORDS, MIN_OWNER_WORDS = 16, 12
#: Words of whole repeated chunks in a row that make a candidate, which asks how far it grows.
CANDIDATE_WORDS = 3
#: Bytes that count as a word in chunks where no word begins.
UNIT_BYTES = 12
#: Words that a passage can grow by at either end.
REACH = 12
#: White space between texts that are worked on together, as long as the hash's window, and their bytes.
PAD, GROUP_BYTES = WINDOW, 400_000
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: UTF-8 bytes of text in a block: digests are mostly distinct, so larger blocks would save little.
BLOCK_BYTES = 6_000_000
#: The gear table: a fixed random 64-bit word for each byte.
GEAR = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64)


class _Group:
    """Some texts of a block in one array of bytes, PAD white-space bytes after each, so that numpy works on many texts at a time."""

    def __init__(self, texts: list[bytes], first: int):
        pad = b" " * PAD
        self.data = np.frombuffer(pad.join(texts) + pad, np.uint8)
        sizes = np.array([len(t) for t in texts])
        self.first, self.some = first, np.flatnonzero(sizes)
        starts = np.cumsum(sizes + PAD) - sizes - PAD
        #: Of the texts that are not empty: their rows, and where they begin and end.
        self.row, self.start, self.end = first + self.some, starts[self.some], (starts + sizes)[self.some]
        self.space = _SPACE[self.data]

    def cuts(self) -> np.ndarray:
        """Ends of chunks: places where the gear hash is low after a word, or in a long run at a character, and the ends of texts."""
        rolled = GEAR[self.data]
        for at in range(PAD):
            rolled[self.end + at] = 0  # a text's hashes do not hold bytes of the one before it
        span = 1
        while span < WINDOW:  # the hash of 2n bytes from two of n bytes
            longer = rolled.copy()
            longer[span:] += rolled[:-span] << np.uint64(span)
            rolled, span = longer, span * 2
        ends = np.flatnonzero(self.space[1:] & ~self.space[:-1]) + 1  # a white-space byte after a word: the cut is before it
        value = (rolled[ends - 1] >> np.uint64(1)) & np.uint64(0xFFFF)
        parts = [ends[value < 0x10000 // CUT_WORDS], self.end]
        if np.diff(np.flatnonzero(np.concatenate([[True], self.space, [True]]))).max() > LONG_RUN + 1:
            spaces = np.cumsum(self.space)
            at = np.arange(LONG_RUN, len(self.data))
            inner = at[(spaces[at] == spaces[at - LONG_RUN]) & ~self.space[at - LONG_RUN] & (self.data[at] & 0xC0 != 0x80)]
            low = (rolled[inner - 1] >> np.uint64(20)) & np.uint64(0xFFFF)
            parts.append(inner[low < 0x10000 // CUT_CHARACTERS])
        return np.unique(np.concatenate(parts))

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first byte, end, 16-bit hash that is not 0) of each word."""
        letter = np.concatenate([[False], ~self.space])
        opens, closes = np.flatnonzero(letter[1:] & ~letter[:-1]), np.flatnonzero(~letter[1:] & letter[:-1])
        if not len(opens):
            return opens, closes, np.empty(0, np.uint16)
        since = np.zeros(len(self.data), np.int64)
        since[opens] = opens
        place = np.minimum(np.arange(len(self.data)) - np.maximum.accumulate(since), np.diff(closes, prepend=0).max())
        term = np.where(self.space, np.uint64(0), (GEAR[self.data] | np.uint64(1)) * _powers(int(place.max()) + 1)[place])
        mixed = blocks.mix(np.add.reduceat(term, opens), (closes - opens).astype(np.uint64))
        return opens, closes, np.maximum((mixed >> np.uint64(20)).astype(np.uint16), 1)


def _together(texts: list[bytes]) -> list[tuple[int, int]]:
    """(first, last) of runs of texts that make up GROUP_BYTES or so; a longer text ends a run."""
    sizes = np.cumsum([len(t) + PAD for t in texts])
    cuts = np.flatnonzero(np.diff(sizes // GROUP_BYTES)) + 1 if len(sizes) else []
    return list(zip([0, *cuts], [*cuts, len(texts)], strict=True)) if texts else []


class Chunks:
    """The chunks of a block's texts in order: row, first and last byte, words, units of length, and the 64-bit digest of the trimmed bytes.

    Digests are taken from the chunk's words joined by one space, so white space between words does not tell chunks apart. Units are words, or bytes
    where no word begins.
    """

    def __init__(self, texts: list[str | None]):
        self.texts = _encoded(texts)
        parts = [found for first, last in _together(self.texts) if (found := self._group_chunks(first, last)) is not None]
        join = lambda k, kind: np.concatenate([p[k] for p in parts]) if parts else np.empty(0, kind)
        self.row, self.start, self.end, self.words, self.units = (join(k, np.int64) for k in range(5))
        self.digest = join(5, np.uint64)

    def _group_chunks(self, first: int, last: int) -> tuple[np.ndarray, ...] | None:
        group = _Group(self.texts[first:last], first)
        if not len(group.some):
            return None
        cuts = group.cuts()
        text = np.searchsorted(group.end, cuts)
        begins = np.maximum(np.concatenate([[0], cuts[:-1]]), group.start[text])
        ranges = np.stack([begins, cuts], 1).ravel()  # every other sum is that of a chunk
        count, keys = _digests(group.data, group.space, begins, ranges)
        units = np.where(count > 0, count, -(-np.add.reduceat((~group.space).astype(np.int64), ranges)[::2] // UNIT_BYTES))
        return group.row[text], begins - group.start[text], cuts - group.start[text], count, units, keys


def _encoded(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def _around(texts: list[bytes], row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each chunk (row, first and last byte): hashes of the REACH words before and after it, the nearest first, 0 beyond the text; and where those words begin or end.

    Places are those a passage has that grows to the word: the end of the word before it (0 if there is none), and its own end.
    """
    hashes = np.zeros((len(row), 2, REACH), np.uint16)
    places = np.zeros((len(row), 2, REACH), np.int64)
    rows, which = np.unique(row, return_inverse=True)
    for begin, stop in _together([texts[r] for r in rows]):
        part = np.flatnonzero((which >= begin) & (which < stop))
        group = _Group([texts[r] for r in rows[begin:stop]], 0)
        opens, closes, hashed = group.words()
        text = which[part] - begin
        base = group.start[text]
        low, high = np.searchsorted(opens, base), np.searchsorted(opens, group.end[text])
        before, after = np.searchsorted(closes, base + start[part], side="right"), np.searchsorted(opens, base + end[part])
        for k in range(REACH):
            for side, at in ((0, before - 1 - k), (1, after + k)):
                there = np.flatnonzero((at >= low) & (at < high))
                word = at[there]
                hashes[part[there], side, k] = hashed[word]
                edge = closes[word] if side else np.where(word > low[there], closes[word - 1], base[there])
                places[part[there], side, k] = edge - base[there]
    return hashes, places


def _digests(data: np.ndarray, space: np.ndarray, begins: np.ndarray, ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, digest) of each chunk. White-space runs count as one separator; those at a chunk's ends do not count.

    The digest is a polynomial in the chunk's bytes modulo 2**64 by odd multipliers, finished by mixing.
    """
    after = np.zeros(len(data), bool)
    after[1:] = space[:-1]
    opens = ~space & after
    opens[0] = not space[0]
    kept = ~space | (space & ~after)  # each word's bytes, and the first byte of each white-space run
    value = GEAR[np.where(space, 32, data)] | np.uint64(1)
    kept_before = np.cumsum(kept) - kept
    lead = space[begins] & kept[begins]  # the separator that a chunk begins with
    base = np.zeros(len(data), np.int64)
    base[begins] = kept_before[begins]
    power = kept_before - np.maximum.accumulate(base)
    term = np.where(kept, value * _powers(int(power.max()) + 1)[power], np.uint64(0))
    term[begins[lead]] = 0
    total = np.add.reduceat(term, ranges)[::2]
    # a chunk that begins with its separator has all powers one higher: divide that out
    total = np.where(lead, total * _INVERSE, total)
    count = np.add.reduceat(opens.astype(np.int64), ranges)[::2]
    return count, blocks.mix(total, count.astype(np.uint64))


_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_FACTOR, -1, 1 << 64))
_TABLE = np.ones(1, np.uint64)


def _powers(size: int) -> np.ndarray:
    global _TABLE
    if len(_TABLE) < size:
        grown = np.full(max(size, 4096), np.uint64(_FACTOR))
        grown[0] = 1
        _TABLE = np.cumprod(grown)
    return _TABLE


#: The place of rows with a null id: after all others.
_LAST = np.iinfo(np.int64).max


def _ordered(rows: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The rows by ascending doc_id, then text, and their ids: the same order whatever order they come in, since rows are known by their places in it from one step to the next."""
    ids = rows.column("doc_id").combine_chunks().fill_null(_LAST).to_numpy()
    order = np.argsort(ids, kind="stable")
    if (np.diff(ids[order]) == 0).any():
        texts = rows.column("text").to_pylist()
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], texts[i] or "")))
    return rows.take(pa.array(order)), ids[order]


def _known(rows: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    """The digests of a block, and of each the first row and place that has it, and whether there are more."""
    rows, ids = _ordered(rows)
    chunks = Chunks(rows.column("text").to_pylist())
    keys, first, many = np.unique(chunks.digest, return_index=True, return_counts=True)
    return keys, [ids[chunks.row[first]], chunks.start[first], np.minimum(many, 2)]


def _first(keys: np.ndarray, which: np.ndarray, arrays: list[np.ndarray]) -> list[np.ndarray]:
    """The first (doc_id, place) of each key, and 2 where there are more."""
    owner, start, many = arrays
    order = np.lexsort((start, owner, which))
    first = order[np.concatenate([[True], which[order][1:] != which[order][:-1]])] if len(order) else order
    return [owner[first], start[first], np.minimum(np.bincount(which, weights=many, minlength=len(keys)), 2)]


def _owners(keys: np.ndarray, which: np.ndarray, arrays: list[np.ndarray]) -> tuple[list[np.ndarray], tuple[int, int]]:
    owner, start, many = _first(keys, which, arrays)
    return [np.where(many > 1, owner, -1), np.where(many > 1, start, -1)], (0, 0)


#: What owners tell of a chunk: whether this is an owner's entry (others ask), and the words around the chunk.
_AROUND = np.dtype([("known", "u1"), ("words", "<u2", 2 * REACH)])


def _told(keys: np.ndarray, which: np.ndarray, arrays: list[np.ndarray]) -> list[np.ndarray]:
    out = np.zeros(len(keys), _AROUND)
    owned = arrays[0]["known"] > 0
    out[which[owned]] = arrays[0][owned]
    return [out]


#: A run of repeated chunks: its row, first and last byte, owner, words, and those of them that the owner has or that follow each other in owners; and of the first and the last
#: chunk in it that the owner has (its anchors) the first and last byte and the digest's place among those that the block tells of.
_PASSAGE = np.dtype([("row", "<i4"), ("start", "<i8"), ("end", "<i8"), ("owner", "<i8"), ("units", "<i8"), ("held", "<i8"), ("starts", "<i8", 2), ("ends", "<i8", 2), ("told", "<i4", 2)])


@dataclass
class Passage:
    """A run of repeated chunks (first, last), its owner, the first and last chunk in it that the owner has, its words, and those of them that the owner has or that follow each other in owners."""

    first: int
    last: int
    owner: int
    left: int
    right: int
    units: int
    held: int


class Repeats:
    """The chunks of a block that earlier places have, and its repeated passages; `owner` and `begin` go along the chunks' sorted distinct digests."""

    def __init__(self, chunks: Chunks, ids: np.ndarray, owner: np.ndarray, begin: np.ndarray, min_words: int, min_owner_words: int):
        self.chunks = chunks
        _, at = np.unique(chunks.digest, return_inverse=True)
        self.holds, self.place = (owner[at], begin[at]) if len(at) else (np.empty(0, np.int64),) * 2
        here = (self.holds == ids[chunks.row]) & (self.place == chunks.start)
        #: Chunks that later places repeat.
        self.owned = np.flatnonzero(here & (self.place >= 0))
        self.repeated = (self.place >= 0) & (chunks.units > 0) & ~here
        self.min_words, self.min_owner_words = min_words, min_owner_words
        self.passages = list(self._candidates()) if self.repeated.any() else []

    def _candidates(self):
        chunks, where = self.chunks, np.flatnonzero(self.repeated)
        follows = (np.diff(where) == 1) & (np.diff(chunks.row[where]) == 0)
        # whether a chunk comes after the one before it in their owner too; white space may differ
        step = np.diff(self.place[where]) - np.diff(chunks.start[where])
        along = follows & (np.diff(self.holds[where]) == 0) & (abs(step) <= 2 * chunks.words[where][:-1] + 4)
        inside = np.concatenate([[False], along]) | np.concatenate([along, [False]])
        first = np.concatenate([[0], np.flatnonzero(~follows) + 1])
        size = np.add.reduceat(chunks.units[where], first)
        able = size >= min(CANDIDATE_WORDS, self.min_words)
        for begin, end in zip(first[able], np.append(first[1:], len(where))[able], strict=True):
            part = np.arange(begin, end)
            units = chunks.units[where[part]]
            owners, index = np.unique(self.holds[where[part]], return_inverse=True)
            weight = np.bincount(index, weights=units)
            held = int(max(weight.max(), units[inside[part]].sum()))
            if held + 2 * REACH < self.min_owner_words or units.sum() + 2 * REACH < self.min_words:  # it cannot grow enough
                continue
            main = np.flatnonzero(index == weight.argmax())
            yield Passage(int(where[part[0]]), int(where[part[-1]]), int(owners[weight.argmax()]), int(where[part[main[0]]]), int(where[part[main[-1]]]), int(units.sum()), held)

    def tells(self) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Sorted digests that the block owns, or whose surroundings in their owner it needs; what it tells of them; and its passages (_PASSAGE)."""
        chunks, many = self.chunks, len(self.passages)
        anchors = np.array([(p.left, p.right) for p in self.passages], np.int64).reshape(-1, 2)
        keys, first = np.unique(chunks.digest[self.owned], return_index=True)
        every = np.union1d(keys, chunks.digest[anchors.ravel()])
        entries = np.zeros(len(every), _AROUND)
        at, owned = np.searchsorted(every, keys), self.owned[first]
        entries["words"][at] = _around(chunks.texts, chunks.row[owned], chunks.start[owned], chunks.end[owned])[0].reshape(len(keys), 2 * REACH)
        entries["known"][at] = 1
        kept = np.zeros(many, _PASSAGE)
        begin, end = (np.fromiter((getattr(p, name) for p in self.passages), np.int64, many) for name in ("first", "last"))
        kept["row"], kept["start"], kept["end"] = chunks.row[begin], chunks.start[begin], chunks.end[end]
        for name in ("owner", "units", "held"):
            kept[name] = np.fromiter((getattr(p, name) for p in self.passages), np.int64, many)
        kept["starts"], kept["ends"], kept["told"] = chunks.start[anchors], chunks.end[anchors], np.searchsorted(every, chunks.digest[anchors])
        return every, [entries], kept


def _grown(texts: list[bytes], kept: np.ndarray, told: np.ndarray, min_words: int, min_owner_words: int) -> list[tuple[int, int, int, int, int]]:
    """(row, first byte, last byte, words, owner) of each passage of a block, grown by what the owners told (along the digests of Repeats.tells)."""
    hashes, places = _around(texts, np.repeat(kept["row"], 2), kept["starts"].ravel(), kept["ends"].ravel())
    theirs = told["words"][kept["told"].ravel()].reshape(-1, 2, REACH)
    same, found = np.cumprod((hashes == theirs) & (hashes > 0), axis=2).sum(2), []
    for i, p in enumerate(kept):
        row, start, end = int(p["row"]), int(p["start"]), int(p["end"])
        if left := same[2 * i, 0]:
            start = min(start, int(places[2 * i, 0, left - 1]))
        if right := same[2 * i + 1, 1]:
            end = max(end, int(places[2 * i + 1, 1, right - 1]))
        if max(len(texts[row][start:end].split()), p["units"]) < min_words or p["held"] + left + right < min_owner_words:
            continue
        if found and found[-1][0] == row and found[-1][2] > start:  # both grew over what lies between
            start = found[-1][2]
        found.append((row, start, end, len(texts[row][start:end].split()), int(p["owner"])))
    return [f for f in found if f[1] < f[2]]


def _spans(docs: DataFrame, found: Callable, schema: str, min_words: int, min_owner_words: int, block_bytes: int) -> DataFrame:
    """found(rows of a block, their texts in UTF-8, their repeated passages) for each block of `docs`, which has doc_id and text.

    Texts are cut into chunks twice: for the owners, and for the passages, which the block keeps until it hears how far they grow.
    """
    blocked, many = blocks.deal(docs, block_bytes)
    owners = blocks.Lookup(many, ["<i8", "<i8", "u1"], ["<i8", "<i8"], _owners, _first)
    around = blocks.Lookup(many, [_AROUND], [_AROUND], lambda *entries: (_told(*entries), (0, 0)), _told)
    memo = blocks.Memo(around, _PASSAGE)

    def ask(block: int, rows: pa.Table, answers: list[list[np.ndarray]]) -> pa.Table:
        rows, ids = _ordered(rows)
        repeats = Repeats(Chunks(rows.column("text").to_pylist()), ids, *answers[0], min_words, min_owner_words)
        return memo.ask(block, *repeats.tells())

    def work(block: int, rows: pa.Table, answers: list[list[np.ndarray]]) -> pa.Table:
        rows, _ = _ordered(rows)
        texts = _encoded(rows.column("text").to_pylist())
        return found(rows, texts, _grown(texts, answers[1][0], answers[0][0], min_words, min_owner_words))

    first = owners.answers(blocks.first_questions(blocked, _known, owners))[0]
    sent = blocks.with_answers(blocked, [(owners, first)], ask, memo.asked).checkpoint()
    told = around.answers(memo.questions(sent), written=True)[0]
    return blocks.with_answers(blocked, [(around, told), (memo, memo.kept(sent))], work, schema)


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, min_owner_words: int = MIN_OWNER_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, kept_doc_id, start_byte, n_bytes, n_words, passage: one row for each passage that an earlier document (or place) has.

    kept_doc_id is the document that owns most of it: the one with the smallest doc_id, or the same document at an earlier place; of documents that own as
    much of it, the smallest. Documents without repeated passages give no row; nor do null and empty texts and empty tables. Texts of any length are
    searched whole. Rows that share doc_id and text have one place and stay whole; rows with a null doc_id come after all others. White space between
    words does not matter. Other columns, whatever their names, are left out.
    """

    def found(rows: pa.Table, texts: list[bytes], spans: list[tuple[int, int, int, int, int]]) -> pa.Table:
        columns = list(zip(*spans, strict=True)) or [()] * 5
        row, start, end, words, owner = (np.array(c, np.int64) for c in columns)
        raw = [texts[r][s:e].decode("utf-8", "replace") for r, s, e, _, _ in spans]
        kept = pa.array(owner, mask=owner == _LAST)
        return pa.table({"doc_id": rows.column("doc_id").take(row), "kept_doc_id": kept, "start_byte": start, "n_bytes": end - start, "n_words": words, "passage": pa.array(raw, pa.string())})

    schema = "doc_id long, kept_doc_id long, start_byte long, n_bytes long, n_words long, passage string"
    return _spans(docs.select("doc_id", "text"), found, schema, min_words, min_owner_words, block_bytes)


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS, min_owner_words: int = MIN_OWNER_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` with every repeated passage cut out of `text`; all rows and columns stay, and n_chars, where it is there, is counted anew.

    What repeated_passages says of nulls, empty and long texts, ties, repeated rows and empty tables holds. Other columns, whatever their names, are carried as they are.
    """
    names = docs.columns
    plain = docs.select(*[F.col(f"`{n}`").alias({"doc_id": "doc_id", "text": "text"}.get(n, f"c{i}")) for i, n in enumerate(names)])

    def found(rows: pa.Table, texts: list[bytes], spans: list[tuple[int, int, int, int, int]]) -> pa.Table:
        kept = rows.column("text").to_pylist()
        held: dict[int, list[bytes]] = {}
        after: dict[int, int] = {}
        for row, start, end, _, _ in spans:  # in order of place
            held.setdefault(row, []).append(texts[row][after.get(row, 0) : start])
            after[row] = end
        for row, parts in held.items():
            kept[row] = b"".join([*parts, texts[row][after[row] :]]).decode("utf-8", "surrogatepass")
        return rows.set_column(rows.column_names.index("text"), "text", pa.array(kept, pa.string()))

    out = _spans(plain, found, plain.schema, min_words, min_owner_words, block_bytes)
    out = out.select(*[F.col(c).alias(n) for c, n in zip(plain.columns, names, strict=True)])
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
