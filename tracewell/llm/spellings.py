"""Spelling variants: words that differ by one character, grouped under the more frequent one.

Method (frequency-vector trie):

1. One scan counts the words; texts are counted before anything is exchanged.
2. A word is described by how many characters of each of ``GROUPS`` it has. Inserting a character raises one of these counts
   by one, deleting one lowers one, replacing one does both or neither. So the vectors of near words differ by a surplus
   of at most one and a deficit of at most one.
3. Words are leaves of a trie over the successive counts. Every word goes down it with a budget of one surplus and then one
   deficit; where the deficit comes first, the other word of the pair finds this one. The upper levels are joins: at each level a word branches to the counts its budget allows, and branches
   that no word lies on end. A branch with at most ``SHARD`` words below is searched in one place, by depth-first search in a
   trie of its words; larger branches go down one level more. What is still larger after the last level, words of
   equal vectors, is cut into blocks, and the words on their way meet all of them.
4. Words at the leaves are verified character by character. A branch returns one row per word that met near ones there: their
   number and the most frequent of them; two words meet in one branch only and count for both, so the numbers add up.
5. Forms are followed to the last by pointer doubling. A form is at least twice as frequent as the word, so chains are short.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.streams import runs
from tracewell.llm.tables import Staging

# Letters of the successive counts, frequent ones apart; characters of no group make the last count.
GROUPS = ("e", "a", "in", "rt", "sh", "od", "lc", "um", "pgb", "fvwykjxqz")
LEAST_LENGTH = 5
LEAST_COUNT = 3
DAMAGE = 97
FACTOR = 2
FIRST_LEVELS = 4
SHARD = 2048
_DEPTH = len(GROUPS) + 1
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
# In UTF-8 the characters U+00C0 to U+00FF are the byte C3 and one byte from 80 to BF.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_LONG = 1 << 20
_FLUSH = 500_000
_FEW = 8


def _tallied(text: bytes) -> Counter:
    """Runs of a text in lower case; those of a long text are never held together."""
    if len(text) < _LONG:
        return Counter(_RUN.findall(text.translate(_LOWER)))
    return Counter(match[0] for match in _RUN.finditer(text.translate(_LOWER)))


def damaged(run: bytes, value: int) -> bytes:
    """The run without the character that the value picks."""
    letters = run.decode()
    at = value % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def _words(least: int, damage: int):
    """Rows (word, n) of documents (doc, text); one word may come in several rows."""

    def flushed(total: dict[bytes, int]) -> pa.RecordBatch:
        words = pa.array(list(total), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}
        for batch in batches:
            docs = batch.column("doc").to_pylist()
            for doc, text in zip(docs, batch.column("text").cast(pa.large_binary())):
                if not text.is_valid:
                    continue
                start = crc32(f"{doc or ''}:".encode())
                for word, n in _tallied(text.as_py()).items():
                    if len(word) < least or len(word) - word.count(b"\xc3") < least:
                        continue
                    value = crc32(word, start)
                    if damage and value % damage == 0:
                        word = damaged(word, value)
                        if len(word) - word.count(b"\xc3") < least:
                            continue
                    total[word] = total.get(word, 0) + n
                if len(total) > _FLUSH:
                    yield flushed(total)
                    total = {}
        yield flushed(total)

    return run


def near(one: str, other: str) -> bool:
    """Whether words of two characters or more differ by exactly one inserted, deleted or replaced character."""
    if len(one) > len(other):
        one, other = other, one
    if len(other) - len(one) > 1 or (one[0] != other[0] and one[-1] != other[-1]) or one == other:
        return False
    at = 0
    while at < len(one) and one[at] == other[at]:
        at += 1
    return one[at + (len(one) == len(other)) :] == other[at + 1 :]


def _halves(leaf: dict, word: str) -> list[tuple]:
    """Words of a leaf, none shorter than ``word``, that begin or end like one of its halves; near words do."""
    if len(leaf[None]) <= _FEW:
        return leaf[None]
    size = len(word)
    half = size // 2
    if size not in leaf:
        leaf[size] = {}, {}
        for other in leaf[None]:
            leaf[size][0].setdefault(other[1][:half], []).append(other)
            leaf[size][1].setdefault(other[1][half - size :], []).append(other)
    begin, end = word[:half], word[half:]
    return leaf[size][0].get(begin, []) + [o for o in leaf[size][1].get(end, []) if not o[1].startswith(begin)]


def _put(node: dict, entry: tuple, at: int) -> None:
    """Hang (-n, word, counts) below a node; a branch of a few words is a list and not yet divided."""
    counts = entry[2]
    if at == len(counts):
        node.setdefault(None, []).append(entry)
        return
    while True:
        count = counts[at]
        at += 1
        child = node.get(count)
        if at == len(counts):
            node.setdefault(count, {None: []})[None].append(entry)
            return
        if child is None:
            node[count] = [entry]
            return
        if type(child) is list:
            if len(child) < _FEW:
                child.append(entry)
                return
            node[count] = divided = {}
            for held in child:
                _put(divided, held, at)
            child = divided
        node = child


def _reached(trie: dict, word: str, counts: list[int], depth: int, surplus: int, deficit: int) -> Iterator[list[tuple]]:
    """Words of the trie that the budget allows, depth first."""
    waiting = [(trie, depth, surplus, deficit)]
    while waiting:
        node, at, more, less = waiting.pop()
        if type(node) is list:
            yield node
        elif at == len(counts):
            if None in node:
                yield _halves(node, word)
        else:
            count = counts[at]
            if count in node:
                waiting.append((node[count], at + 1, more, less))
            if more and count + 1 in node:
                waiting.append((node[count + 1], at + 1, 0, 1))
            if less and count - 1 in node:
                waiting.append((node[count - 1], at + 1, 0, 0))


class _Branch:
    """The words of a branch as a trie, and the near words that each has met in it."""

    def __init__(self):
        self.trie: dict = {}
        self.met: dict[str, list] = {}

    def hold(self, word: str, n: int, counts: list[int], depth: int) -> None:
        _put(self.trie, (-n, word, counts), depth)

    def ask(self, word: str, n: int, counts: list[int], depth: int, surplus: int, deficit: int) -> None:
        own = (-n, word)
        for others in _reached(self.trie, word, counts, depth, surplus, deficit):
            for other in others:
                # Of two words the one of the smaller vector counts for both; of equal vectors, the smaller word.
                if near(word, other[1]) and (counts, word) < (other[2], other[1]):
                    for one, seen in ((word, other[:2]), (other[1], own)):
                        known = self.met.setdefault(one, [0, seen])
                        known[0] += 1
                        known[1] = min(known[1], seen)

    def found(self) -> pa.RecordBatch:
        rows = [(word, n, -best[0], best[1]) for word, (n, best) in self.met.items()]
        columns = list(zip(*rows)) or [(), (), (), ()]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        names = ["word", "n_near", "best_n", "best"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (word, n_near, best_n, best) of the words that met near ones in a branch."""
    current, branch = None, _Branch()
    for batch in batches:
        for rows in runs(batch, "meet"):
            meet = rows.column("meet")[0].as_py()
            if meet != current:
                if branch.met:
                    yield branch.found()
                current, branch = meet, _Branch()
            columns = (rows.column(c).to_pylist() for c in ("side", "word", "n", "counts", "depth", "surplus", "deficit"))
            for side, word, n, counts, depth, surplus, deficit in zip(*columns):
                if side == 0:
                    branch.hold(word, n, counts, depth)
                else:
                    branch.ask(word, n, counts, depth, surplus, deficit)
    yield branch.found()


def _counts(word: Column) -> Column:
    """How many characters of each group a word has."""
    each = [F.length(word) - F.length(F.translate(word, letters, "")) for letters in GROUPS]
    return F.array(*each, F.length(F.translate(word, "".join(GROUPS), "")))


def _down(asking: DataFrame, level: int) -> DataFrame:
    """Words on their way, one level further, on every branch that their budget allows."""
    count = F.col("counts")[level]
    branch = F.array(
        F.struct(count.alias("count"), F.col("surplus").alias("surplus"), F.col("deficit").alias("deficit")),
        F.when(F.col("surplus") > 0, F.struct((count + 1).alias("count"), F.lit(0).alias("surplus"), F.lit(1).alias("deficit"))),
        F.when(
            (F.col("deficit") > 0) & (count > 0),
            F.struct((count - 1).alias("count"), F.lit(0).alias("surplus"), F.lit(0).alias("deficit")),
        ),
    )
    asking = asking.select("word", "n", "counts", "prefix", F.explode(F.array_compact(branch)).alias("to"))
    return asking.select(
        "word", "n", "counts", F.concat("prefix", F.lit(","), F.col("to.count").cast("string")).alias("prefix"), "to.surplus", "to.deficit"
    )


def _meetings(words: DataFrame, shard: int, staging: Staging) -> DataFrame:
    """Rows (meet, side, depth, word, n, counts, surplus, deficit): words of a branch (side 0), then those on their way."""
    level = FIRST_LEVELS
    held = words.select("word", "n", "counts", F.concat(F.lit(","), F.array_join(F.slice("counts", 1, level), ",")).alias("prefix"))
    asking = words.select("word", "n", "counts", F.lit("").alias("prefix"), F.lit(1).alias("surplus"), F.lit(0).alias("deficit"))
    for step in range(level):
        asking = _down(asking, step)
    parts = []
    while True:
        nodes = held.groupBy("prefix").agg(F.count(F.lit(1)).alias("size"))
        last = level == _DEPTH
        done = F.lit(True) if last else F.col("size") <= shard
        nodes = nodes.select("prefix", done.alias("done"), F.ceil(F.col("size") / shard).cast("long").alias("blocks"))
        nodes = staging.write(nodes, f"nodes-{level}")
        held = staging.write(held.join(nodes, "prefix"), f"held-{level}")
        asking = staging.write(asking.join(nodes, "prefix"), f"asking-{level}")
        zero = F.lit(0).cast("long")
        own = F.pmod(F.xxhash64("word"), "blocks")
        every = F.explode(F.sequence(zero, F.col("blocks") - 1))
        for rows, side, place in ((held, 0, own), (asking, 1, every)):
            budget = [F.lit(0).alias(b) if side == 0 else F.col(b) for b in ("surplus", "deficit")]
            placed = rows.where("done").select("*", place.alias("block"))
            parts.append(
                placed.select(
                    F.xxhash64("prefix", "block").alias("meet"),
                    F.lit(side).alias("side"),
                    F.lit(level).alias("depth"),
                    "word",
                    "n",
                    "counts",
                    *budget,
                )
            )
        held, asking = held.where(~F.col("done")), asking.where(~F.col("done"))
        if last or nodes.where(~F.col("done")).isEmpty():
            break
        held = held.select(
            "word", "n", "counts", F.concat("prefix", F.lit(","), F.col("counts")[level].cast("string")).alias("prefix")
        )
        asking = _down(asking, level)
        level += 1
    met = parts[0]
    for part in parts[1:]:
        met = met.unionByName(part)
    return met


def _roots(forms: DataFrame, staging: Staging) -> DataFrame:
    """Rows (word, root): the form of the form and so on, to the last; for words that have a form."""
    state = staging.write(forms.select("word", F.col("form").alias("root")), "roots-0")
    turn = 0
    while True:
        turn += 1
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = state.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        moved = staging.write(moved, f"roots-{turn}")
        staging.drop(f"roots-{turn - 1}")
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        state = moved.select("word", "root")


def group(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    damage: int = DAMAGE,
    factor: int = FACTOR,
    shard: int = SHARD,
) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n), one for each word of the texts.

    Runs of ASCII letters and of U+00C0 to U+00FF are lower-cased (A-Z only). If ``damage`` divides the crc32 of
    ``<id>:<run>``, the run's character at that crc32 modulo its length is left out (0: never). Words are the results of
    ``least_length`` characters and ``least_count`` occurrences (n) or more. ``form`` is the near word of the largest n, ties to
    the smallest, if that n is at least ``factor`` (2 or more) times the word's own; ``root`` follows forms to the last and is
    the word itself without one. Repeated rows count each; null and empty texts have no words; a null id is an empty one.
    Other columns play no part. An empty table gives an empty result.
    """
    staging = Staging(docs.sparkSession, "spellings")
    narrow = docs.select(F.col(id_column).cast("string").alias("doc"), F.col(text).cast("binary").alias("text"))
    counted = narrow.mapInArrow(_words(least_length, damage), "word string, n long")
    words = counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)
    words = staging.write(words.select("word", "n", _counts(F.col("word")).alias("counts")), "words")
    met = _meetings(words, shard, staging).repartition("meet").sortWithinPartitions("meet", "side")
    found = met.mapInArrow(_searched, "word string, n_near long, best_n long, best string")
    # The largest n first, then the smallest word: the greatest n with the least word is the least of (-n, word).
    best = found.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("best")
    )
    best = staging.write(best.select("word", "n_near", "best.best", (-F.col("best.less")).alias("best_n")), "best")
    taken = F.coalesce(F.col("best_n") >= factor * F.col("n"), F.lit(False))
    forms = words.join(best, "word", "left").select(
        "word",
        F.when(taken, F.col("best")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(taken, F.col("best_n")).alias("form_n"),
    )
    forms = staging.write(forms, "forms")
    roots = _roots(forms.where("form IS NOT NULL"), staging)
    staging.drop("words", "best")
    whole = forms.join(roots, "word", "left")
    return whole.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
