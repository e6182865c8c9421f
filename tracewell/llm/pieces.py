"""SentencePiece encoding and decoding of a pair-merge model by a streaming Viterbi search.

The lattice has a node at each character boundary and an edge for each piece. Merging by score gives every prefix
exactly one encoding, and a row of pieces is an encoding if each two neighbours are (both come out again when their joined
text is merged). So the last piece of a prefix is found among the pieces that end there, by one test per edge against the
piece that its start holds as backpointer; a path scores by surviving.

Streaming: only nodes of the last ``longest piece`` characters can start another edge. Whenever all backpointer paths from
that window meet in one node, the ids before it are final and are committed, so memory is bounded by the window and not by
the text. Between two characters that no piece joins there is always such a node; texts are cut there, and cuts that occur
often (words) are encoded once and remembered, ``REMEMBERED`` of them at most per Python worker.

Decoding joins pieces and bytes; it needs no search.
"""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MODEL = "piece_bpe_32k.model"
REMEMBERED = 1 << 18
ROWS = 256
_MARK = "▁"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>$")


class Pieces:
    """Pieces, scores and byte ids of a model file."""

    def __init__(self, model: str):
        import public_tokenizers
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(model if "/" in model else public_tokenizers.path(model), "rb") as file:
            proto.ParseFromString(file.read())
        normal = 1
        self.text, self.number, self.score = [], {}, {}
        self.bytes: dict[int, int] = {}
        self.unknown = 0
        for i, piece in enumerate(proto.pieces):
            self.text.append(piece.piece)
            if piece.type == 2:
                self.unknown = i
            elif piece.type == 6:
                self.bytes[int(_BYTE.match(piece.piece)[1], 16)] = i
            elif piece.type == normal:
                self.number[piece.piece] = i
                self.score[i] = piece.score
        self.longest = max(map(len, self.number), default=1)
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        # Pieces that hold the mark behind another character would make words depend on each other.
        self.word_bound = not any(_MARK in p[1:] and p.strip(_MARK) for p in self.number)
        self._pairs: dict[str, dict[str, bool]] = {}
        self._words: dict[str, bytes] = {}
        self.together = {p[i : i + 2] for p in self.number for i in range(len(p) - 1)}
        self.trie: dict = {}
        for piece in self.number:
            branch = self.trie
            for sign in piece:
                branch = branch.setdefault(sign, {})
            branch[""] = piece
        self._content = [p.replace(_MARK, " ").encode() for p in self.text]
        for byte, i in self.bytes.items():
            self._content[i] = bytes([byte])

    def _merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging the best-scored pair, leftmost first."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                n = self.number.get(parts[i] + parts[i + 1])
                if n is not None and (best is None or self.score[n] > best):
                    best, at = self.score[n], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fits(self, left: str, piece: str) -> bool:
        """Whether ``piece`` may follow ``left``; at the start of a text left is empty."""
        return self._merged(left + piece) == ([left, piece] if left else [piece])

    def search(self, text: str) -> Iterator[str]:
        """Pieces of ``text`` (marks in place of blanks), each yielded as soon as no later character can change it."""
        trie, pairs, span = self.trie, self._pairs, self.longest
        # last[i - base] is the piece that ends at node i, or None where no path ends; older nodes are committed.
        base, size = 0, len(text)
        last: list[str | None] = [""] + [None] * min(size, 5 * span)
        left: str | None
        for start in range(size):
            left = last[start - base]
            if left is None:
                continue
            known = pairs.get(left)
            if known is None:
                known = {}
                if len(pairs) < REMEMBERED:
                    pairs[left] = known
            # Edges: the character itself, then every piece that the trie finds from here on.
            end, piece = start + 1, text[start]
            branch = trie.get(piece)
            while True:
                if piece is not None and last[end - base] is None:
                    fits = known.get(piece)
                    if fits is None:
                        fits = known[piece] = self._fits(left, piece)
                    if fits:
                        last[end - base] = piece
                if branch is None or end == size:
                    break
                branch = branch.get(text[end])
                if branch is None:
                    break
                end += 1
                piece = branch.get("")
            if start - base >= 4 * span - 1 and size - base > 5 * span:
                # Follow the paths of all live nodes back to the node where they are one.
                live = {i for i in range(start + 1, start + 1 + span) if last[i - base] is not None}
                while len(live) > 1:
                    newest = max(live)
                    live.remove(newest)
                    live.add(newest - len(last[newest - base]))
                meeting = live.pop()
                if meeting > base:
                    yield from self._path(last, meeting - base)
                    last = last[meeting - base :]
                    base = meeting
                last += [None] * (min(size - base, 5 * span + start + 1 - base) + 1 - len(last))
        yield from self._path(last, size - base)

    @staticmethod
    def _path(last: list[str | None], end: int) -> list[str]:
        path = []
        while end:
            piece = last[end]
            path.append(piece)
            end -= len(piece)
        path.reverse()
        return path

    def _ids(self, text: str) -> Iterator[int]:
        for piece in self.search(text):
            number = self.number.get(piece)
            if number is not None:
                yield number
            elif self.bytes:
                yield from (self.bytes[b] for b in piece.encode())
            else:
                yield self.unknown

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        text = (_MARK if self.prefix else "") + text.replace(" ", _MARK)
        if not self.word_bound:
            return np.fromiter(self._ids(text), "<u4").tobytes()
        known, out = self._words, []
        for word in _WORD.findall(text):
            found = known.get(word)
            if found is None:
                found = b"".join(map(self._unit, self._units(word)))
                if len(known) < REMEMBERED and len(word) <= 4 * self.longest:
                    known[word] = found
            out.append(found)
        return b"".join(out)

    def _units(self, word: str) -> Iterator[str]:
        """Parts of a word between characters that stand together in no piece."""
        begin, together = 0, self.together
        for at in range(1, len(word)):
            if word[at - 1 : at + 1] not in together:
                yield word[begin:at]
                begin = at
        yield word[begin:]

    def _unit(self, unit: str) -> bytes:
        found = self._words.get(unit)
        if found is None:
            found = np.fromiter(self._ids(unit), "<u4").tobytes()
            if len(self._words) < REMEMBERED and len(unit) <= 4 * self.longest:
                self._words[unit] = found
        return found

    def decode(self, ids: bytes) -> str:
        """Text of ids; byte ids that are no UTF-8 together give the replacement character."""
        text = b"".join(map(self._content.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


# A run of marks with what follows up to the next mark. Pieces of several marks hold nothing else.
_WORD = re.compile(f"{_MARK}+(?!{_MARK})[^{_MARK}]*|[^{_MARK}]+")


def pieces_of(model: str) -> Pieces:
    """The pieces of a model; a Python worker that is used again keeps them, and the words it knows, between tasks."""
    kept = sys.modules.setdefault("tracewell_pieces", types.ModuleType("tracewell_pieces")).__dict__
    key = f"{model}/{REMEMBERED}"
    if key not in kept:
        kept[key] = Pieces(model)
    return kept[key]


def _with(docs: DataFrame, source: str, column: str, kind: pa.DataType, model: str, convert) -> DataFrame:
    fields = [f for f in docs.schema.fields if f.name != column]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                part = batch.slice(begin, ROWS)
                pieces = pieces_of(model)
                made = [None if v is None else convert(pieces, v) for v in part.column(source).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(n) for n in names] + [pa.array(made, kind)], names=[*names, column])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return docs.select(*[f"`{n}`" for n in names]).mapInArrow(run, f"{kinds}, `{column}` {kind}")


def encode(docs: DataFrame, text: str = "text", column: str = "ids", model: str = MODEL) -> DataFrame:
    """``docs`` with the piece ids of ``text`` as little-endian unsigned 32-bit numbers in ``column``.

    Null stays null, an empty text has no ids. Ids equal those of the sentencepiece library. ``column`` is replaced if
    present. Whole texts are encoded; a text of any length needs a window of it and its ids.
    """
    return _with(docs, text, column, pa.binary(), model, Pieces.encode)


def decode(docs: DataFrame, ids: str = "ids", column: str = "text", model: str = MODEL) -> DataFrame:
    """``docs`` with the text of ``ids`` in ``column``: what was encoded, except that a literal mark becomes a blank."""
    return _with(docs, ids, column, pa.string(), model, Pieces.decode)
