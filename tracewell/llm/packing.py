"""Packing: documents, in the order they are read, become sequences of at most ``length`` tokens.

Method (order-preserving dynamic programming): a task strings its documents together and chooses where to cut. Cuts lie
at ends of documents (free), ends of sentences (``SENTENCE_COST`` tokens) or, inside stretches without a sentence end,
at every ``STRIDE`` tokens (``FORCED_COST``). With c_0 < c_1 < ... the possible cuts,

    f(j) = cost(c_j) + min over c_j - c_i <= length of f(i) + padding(c_j - c_i),

where padding(n) is length - n, or 0 if n is a power of two. Apart from the powers, f(i) + c_i alone decides, so the
minimum comes from a monotone queue, and one step is constant time; the powers add at most log2(length) candidates.

A task works on stretches of ``STRETCH`` tokens and carries the last sequence of a stretch over, so its memory does not
grow with its partition. There is no exchange: a partition packs what it reads, and sequence numbers hold its number.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 1024
SENTENCE_COST = 4
FORCED_COST = 48
STRIDE = 16
LONGEST_GAP = 256
STRETCH = 1 << 20
VOCABULARY = "byte_bpe_50k.tiktoken"
END_OF_TEXT = 0


def _files(vocabulary: str) -> tuple[str, str]:
    """The rank file of a vocabulary, and the JSON file beside it that fixes the ids."""
    import public_tokenizers

    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    return path, path.removesuffix(".tiktoken") + ".json"


def _library(vocabulary: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(_files(vocabulary)[1])


def tokenizer(vocabulary: str):
    """The encoder of a vocabulary file of ranks with the special tokens of the JSON file, and which ids end a sentence."""
    import public_tokenizers
    import tiktoken

    with open(_files(vocabulary)[0], "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    special = {token.content: number for number, token in _library(vocabulary).get_added_tokens_decoder().items()}
    ends = np.zeros(max([*ranks.values(), *special.values()]) + 1, bool)
    for piece, number in ranks.items():
        ends[number] = piece.rstrip(b"\"')")[-1:] in (b".", b"!", b"?", b"\n")
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special), ends


def encoder(vocabulary: str):
    """A function from a text to the ids that the JSON file fixes, and which ids end a sentence."""
    encoding, ends = tokenizer(vocabulary)
    library = None

    def encode(text: str) -> np.ndarray:
        nonlocal library
        try:
            return encoding.encode_to_numpy(text, allowed_special="all", disallowed_special=())
        except ValueError:
            # About 1,000,000 blanks in a row exceed the stack of this library's regular expressions, not the other's.
            library = library or _library(vocabulary)
            return np.array(library.encode(text, add_special_tokens=False).ids, np.uint32)

    return encode, ends


def cuts(tokens: int, documents: np.ndarray, sentences: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Possible cuts in 0..tokens and their costs; documents and sentences are sorted places after their last token."""
    fixed = np.unique(np.concatenate([[0], documents, sentences, [tokens]]))
    gaps = np.diff(fixed)
    wide = np.flatnonzero(gaps > min(LONGEST_GAP, length))
    step = min(STRIDE, length)
    more = [np.arange(fixed[i] + step, fixed[i + 1], step) for i in wide]
    places = np.unique(np.concatenate([fixed, *more]))
    cost = np.full(len(places), FORCED_COST, np.int64)
    cost[np.isin(places, sentences)] = SENTENCE_COST
    cost[np.isin(places, documents)] = 0
    return places, cost


def choose(places: np.ndarray, cost: np.ndarray, length: int) -> list[int]:
    """Indices of the cuts of least padding and cost, first and last place included."""
    powers: dict[int, list[int]] = {}
    power = 1
    while power < length:
        at = np.searchsorted(places, places - power)
        for j in np.flatnonzero((places >= power) & (places[at] == places - power)).tolist():
            powers.setdefault(j, []).append(int(at[j]))
        power *= 2
    full = 0 if length & (length - 1) == 0 else None
    x, extra = places.tolist(), cost.tolist()
    f, g, before = [0] * len(x), [0] * len(x), [0] * len(x)
    g[0] = x[0]
    queue, head = [0], 0
    for j in range(1, len(x)):
        here = x[j]
        low = here - length
        while x[queue[head]] < low:
            head += 1
        i = queue[head]
        best = g[i] - low
        if j in powers:
            for other in powers[j]:
                if f[other] < best:
                    best, i = f[other], other
        before[j] = i
        f[j] = best = best + extra[j]
        g[j] = value = best + here
        while len(queue) > head and g[queue[-1]] > value:
            queue.pop()
        queue.append(j)
    assert full is None or full == 0
    chosen, j = [], len(x) - 1
    while j:
        chosen.append(j)
        j = before[j]
    return [0, *reversed(chosen)]


class _Stream:
    """Tokens of the documents that are not packed yet."""

    def __init__(self, length: int):
        self.length = length
        self.ids: list[np.ndarray] = []
        self.rows: list[tuple[pa.Scalar, int, int]] = []  # (id of the document, tokens before, all its tokens)
        self.ends: list[np.ndarray] = []
        self.size = 0
        self.sequences = 0

    def add(self, row: pa.Scalar, ids: np.ndarray, ends: np.ndarray) -> None:
        self.rows.append((row, 0, len(ids)))
        self.ids.append(ids)
        self.ends.append(ends)
        self.size += len(ids)

    def pack(self, kind: pa.DataType, base: int, last: bool) -> pa.RecordBatch:
        """Pieces of all sequences; unless this is the last stretch, its last sequence is kept."""
        sizes = np.array([len(x) for x in self.ids])
        ids, ends = np.concatenate(self.ids), np.concatenate(self.ends)
        borders = np.concatenate([[0], np.cumsum(sizes)])
        sentences = np.flatnonzero(ends) + 1
        places, cost = cuts(len(ids), borders[1:], sentences, self.length)
        chosen = places[choose(places, cost, self.length)]
        if not last and len(chosen) > 2:
            chosen = chosen[:-1]
        stop = int(chosen[-1])
        edges = np.unique(np.concatenate([chosen, borders[borders <= stop]]))
        begins, lengths = edges[:-1], np.diff(edges)
        document = np.searchsorted(borders, begins, "right") - 1
        sequence = np.searchsorted(chosen, begins, "right") - 1
        before = np.array([skipped for _, skipped, _ in self.rows])
        whole = np.array([total for _, _, total in self.rows])
        data = ids[:stop].astype("<u4")
        pieces = pa.BinaryArray.from_buffers(
            pa.binary(), len(begins), [None, pa.py_buffer((edges * 4).astype(np.int32)), pa.py_buffer(data)]
        )
        names = pa.array([row.as_py() for row, _, _ in self.rows], kind)
        out = pa.RecordBatch.from_arrays(
            [
                names.take(pa.array(document)),
                pa.array(begins - borders[document] + before[document]),
                pa.array(lengths),
                pieces,
                pa.array(whole[document]),
                pa.array(base + self.sequences + sequence),
                pa.array(begins - chosen[sequence]),
            ],
            names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
        )
        self.sequences += len(chosen) - 1
        first = int(np.searchsorted(borders, stop, "right")) - 1
        kept = list(range(first, len(self.rows)))
        rest = [max(0, stop - int(borders[i])) for i in kept]
        self.rows = [(self.rows[i][0], self.rows[i][1] + skip, self.rows[i][2]) for i, skip in zip(kept, rest)]
        self.ids = [self.ids[i][skip:] for i, skip in zip(kept, rest)]
        self.ends = [self.ends[i][skip:] for i, skip in zip(kept, rest)]
        self.size = len(ids) - stop
        return out


def _packer(length: int, vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, closing = encoder(vocabulary)
        stream, base = _Stream(length), TaskContext.get().partitionId() << 40
        kind = None
        for batch in batches:
            kind = batch.schema.field("id").type
            for row, text in zip(batch.column("id"), batch.column("text")):
                found = encode(text.as_py() or "")
                ids = np.append(found, np.array([END_OF_TEXT], found.dtype))
                stream.add(row, ids, np.append(closing[found], True))
                if stream.size >= STRETCH:
                    yield stream.pack(kind, base, last=False)
        if stream.size:
            yield stream.pack(kind, base, last=True)

    return run


def pack(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = LENGTH, vocabulary: str = VOCABULARY
) -> DataFrame:
    """Rows (id, start, length, ids, doc_tokens, sequence_id, offset), one for each piece of a document.

    A document is its token ids followed by id 0; null and empty texts are that id alone. ``ids`` holds the ids of the
    piece as little-endian unsigned 32-bit numbers, ``start`` how many ids of the document come before it, ``offset``
    its place in the sequence. Each id lies in one piece; offsets of a sequence have no gaps. Repeated rows are packed
    as often as they occur, ids may be null, other columns play no part, an empty table gives an empty result.
    """
    name = docs.select(id_column).schema[0]
    schema = "id {}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    packed = rows.mapInArrow(_packer(length, vocabulary), schema.format(name.dataType.simpleString()))
    return packed.withColumnRenamed("id", id_column)
