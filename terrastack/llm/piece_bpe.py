"""SentencePiece BPE encoding by a prefix table, and decoding.

A text's encoding is found without merging: for each prefix of a word the table holds the one token that ends the prefix's
encoding. An automaton lists the pieces that end at each position; the piece that is compatible with the last token of the
prefix before it is that token, and the ids are recovered backwards from the end of the word.
Pieces never hold a space mark after another character, so words (a run of space marks and what follows) encode alone.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

MARK = "▁"
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
CACHED_WORDS = 800_000


class PieceCodec:
    """Encoder and decoder of one SentencePiece BPE model with the identity normaliser and a dummy prefix."""

    def __init__(self, model: str | bytes):
        library = sentencepiece.SentencePieceProcessor(model_proto=model) if isinstance(model, bytes) else sentencepiece.SentencePieceProcessor(model_file=model)
        size = library.get_piece_size()
        self.pieces = [library.id_to_piece(i) for i in range(size)]
        self.end, self.unknown = library.eos_id(), library.unk_id()
        self.byte_id = {int(self.pieces[i][3:-1], 16): i for i in range(size) if library.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.silent = {i for i in range(size) if library.is_control(i)}
        normal = [i for i in range(size) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i))]
        if any(MARK in self.pieces[i].lstrip(MARK) or re.match(f"{MARK}{MARK}+[^{MARK}]", self.pieces[i]) for i in normal):
            raise ValueError("a piece has a space mark inside: words of this model do not encode alone")
        self.id_of = {self.pieces[i]: i for i in normal}
        self.score = {self.pieces[i]: library.get_score(i) for i in normal}
        self.rank = {i: n for n, i in enumerate(sorted(normal, key=lambda i: -library.get_score(i)))}
        self.trie = ahocorasick.Automaton()
        for i in normal:
            if set(self.pieces[i]) != {MARK} or len(self.pieces[i]) == 1:
                self.trie.add_word(self.pieces[i], (len(self.pieces[i]), i))
        self.trie.make_automaton()
        self.joined = {p[i : i + 2] for p in self.id_of for i in range(len(p) - 1)}
        self.letters = {p for p in self.id_of if len(p) == 1}
        self.shown = {i: self.pieces[i].replace(MARK, " ") for i in normal}
        self.digits = [str(i) for i in range(size)]
        self.compatible: dict[int, bool] = {}
        self.words: dict[str, tuple[str, int, str]] = {}

    def merge(self, text: str) -> list[str]:
        """Plain BPE: the best-scored adjacent pair merges first, the leftmost among equals. Used on pairs and on runs of spaces."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right < len(parts) and (joined := parts[left] + parts[right]) in self.score:
                heapq.heappush(heap, (-self.score[joined], left, right, joined))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, left, right, joined = heapq.heappop(heap)
            if parts[left] is None or parts[right] is None or parts[left] + parts[right] != joined or after[left] != right:
                continue
            parts[left], parts[right] = joined, None
            after[left] = after[right]
            if after[right] < len(parts):
                before[after[right]] = left
            offer(before[left], left)
            offer(left, after[left])
        return [p for p in parts if p is not None]

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE keeps the boundary between the two tokens: their joint text encodes to just these two."""
        key = left << 20 | right
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) > 1_000_000:
                self.compatible.clear()
            a, b = self.pieces[left], self.pieces[right]
            known = self.compatible[key] = self.merge(a + b) == [a, b]
        return known

    def encode_part(self, part: str) -> list[int]:
        """Ids of a text of known characters, by the prefix table."""
        last, begin = [-1] * (len(part) + 1), [0] * (len(part) + 1)
        compatible = self.compatible.get
        for end, (size, token) in self.trie.iter(part):
            end += 1
            if last[end] >= 0:
                continue
            if start := end - size:
                previous = last[start]
                if previous < 0:
                    continue
                known = compatible(previous << 20 | token)
                if known is None:
                    known = self.fits(previous, token)
                if not known:
                    continue
            last[end], begin[end] = token, start
        ids, at = [], len(part)
        while at:
            ids.append(last[at])
            at = begin[at]
        ids.reverse()
        return ids

    def encode_word(self, word: str) -> list[int]:
        """Ids of one run of space marks with the characters after it. Unknown characters become their bytes' ids."""
        if word[1:2] != MARK and self.letters.issuperset(word):
            return self.encode_part(word)
        marks = len(word) - len(word.lstrip(MARK))
        ids: list[int] = []
        part = ""
        for letter in word[max(0, marks - 1) :]:
            if letter in self.id_of:
                part += letter
                continue
            ids += self.encode_part(part) if part else []
            part = ""
            ids += [self.byte_id[b] for b in letter.encode("utf-8")] if self.byte_id else [self.unknown]
        ids += self.encode_part(part) if part else []
        if marks > 1:  # spare marks merge last of all: their score is the lowest
            alone = ids[0] == self.id_of[MARK]
            run = self.merge(MARK * (marks if alone else marks - 1))
            ids = [self.id_of[p] for p in run] + ids[alone:]
        return ids

    def parts_of(self, word: str) -> list[str]:
        """The word cut between characters that no piece holds side by side."""
        joined, parts, start = self.joined, [], 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in joined:
                parts.append(word[start:i])
                start = i
        parts.append(word[start:])
        return parts

    def known_word(self, word: str) -> tuple[str, int, str]:
        """(ids as text, how many, decoded text) of a word, kept for the next time.

        Where no piece holds two neighbouring characters, nothing merges across them: such a word is put together from its parts, which
        are much fewer than the words they make.
        """
        if len(word) > 2 and not word[1:].isalpha() and len(parts := self.parts_of(word)) > 1:
            known = [self.words.get(p) or self.known_word(p) for p in parts]
            found = (" ".join([k[0] for k in known]), sum([k[1] for k in known]), "".join([k[2] for k in known]))
            if len(word) <= 64:
                self.words[word] = found
            return found
        ids = self.encode_word(word)
        if len(self.words) >= CACHED_WORDS:
            self.words.clear()
        try:
            shown = "".join([self.shown[i] for i in ids])
        except KeyError:  # bytes and other special tokens
            shown = self.decode_tokens(ids)
        found = (" ".join([self.digits[i] for i in ids]), len(ids), shown)
        if len(word) <= 64:
            self.words[word] = found
        return found

    def encode(self, text: str) -> list[int]:
        """Ids of a text, without an end id."""
        return [i for w in _split(text) for i in self.encode_word(w)]

    def decode_tokens(self, ids: list[int]) -> str:
        """The tokens' text, marks as spaces, before the dummy prefix is taken off."""
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(_lenient(bytes(raw)))
                raw = bytearray()
            out.append("" if i in self.silent else " ⁇ " if i == self.unknown else self.pieces[i].replace(MARK, " "))
        return "".join(out) + (_lenient(bytes(raw)) if raw else "")

    def decode(self, ids: list[int]) -> str:
        """The text of any ids: the first piece that is not a control loses its space mark."""
        first = next((i for i in ids if i not in self.silent), self.unknown)
        text = self.decode_tokens(ids)
        return text[1:] if first in self.shown and self.pieces[first].startswith(MARK) else text


def _lenient(raw: bytes) -> str:
    """UTF-8 with one replacement character for each byte that is not part of a character."""
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + size].decode("utf-8"))
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def _split(text: str) -> list[str]:
    return _WORDS.findall(MARK + text.replace(" ", MARK)) if text else []


#: Codecs of this worker by the digest of their model: at most two at a time.
_CODECS: dict[str, PieceCodec] = {}


def _codec(model: bytes) -> PieceCodec:
    name = hashlib.sha256(model).hexdigest()
    if name not in _CODECS:
        if len(_CODECS) > 1:
            _CODECS.clear()
        _CODECS[name] = PieceCodec(model)
    return _CODECS[name]


def encode_and_decode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the decoded text of every row's whole text; an end id is added to each.

    Null and empty texts give the end id alone and decode to the empty text. Repeated rows give repeated results, rows with a null doc_id theirs, empty
    tables none; equal texts give equal ids (of equal scores the leftmost pair merges first). Other columns, whatever their names, are left out. Texts are
    split into words of any length; a text without spaces is one word and costs time in proportion to its length.
    `model` is a path on the driver; the file, which no table makes longer, is broadcast.
    """
    with open(model, "rb") as file:
        shipped = docs.sparkSession.sparkContext.broadcast(file.read())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shipped.value)
        end = codec.end
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                rows = []
                for text in part.column(1).to_pylist():
                    known, fresh = codec.words, codec.known_word
                    found = [known.get(w) or fresh(w) for w in _split(text or "")]
                    ids = " ".join([f[0] for f in found] + [str(end)])
                    decoded = "".join([f[2] for f in found])
                    decoded = decoded[1:] if decoded.startswith(" ") else decoded
                    rows.append((sum(f[1] for f in found) + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8")).hexdigest(), decoded))
                n, ids, digest, decoded = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(digest), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded string")
