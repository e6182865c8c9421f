"""Substring dedup: removes every word that lies in a passage found anywhere else.

Method (repeated-phrase automata):

1. *Phrases.* Of the ``phrase``-word sequences in each window of ``window`` words the one of least hash is its
   phrase, so equal windows have equal phrases wherever they stand. About 2 in (window - phrase + 2) positions are
   phrases; they are counted with a combine before the exchange, and those with two occurrences or more recur.
2. *Automata.* Recurring phrases travel as word sequences. Each document is joined with those it has; a task takes its
   documents in shards of about a megabyte, compiles the phrases of the shard into one Aho-Corasick automaton over word
   numbers, and streams the documents through it. Where phrases stand is what the automaton reports, no hash decides it.
   Memory is bounded by the shard, whatever the corpus holds.
3. *Confirmation.* Windows around located phrases are grouped into runs that share a phrase. Runs that occur twice as a
   whole are confirmed at once, however many copies there are; the windows of runs with one occurrence are compared one
   by one with those of other runs of their phrase. A window is known by the 64-bit hash of its phrase and another one
   of all its words.
4. *Removal.* Confirmed windows are gathered per document as ranges and cut out.

Nothing is compared pair by pair, nothing is dropped or capped. A group is never gathered: copies are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm import words
from tracewell.llm.tables import Staging, row_key

WINDOW = 35
PHRASE = 10
BITS = 64
ADDED = ["n_words", "n_removed", "kept_text"]
_NONE = np.uint64(2**64 - 1)


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _phrases(w: words.Words, window: int, phrase: int, bits: int):
    """Hashes of all phrases, the least one of each window, and which windows lie within one document."""
    hashes, inside = w.grams(phrase)
    hashes = hashes >> np.uint64(64 - bits)
    hashes = np.where(inside, np.minimum(hashes, _NONE - np.uint64(1)), _NONE)
    least = words.sliding(hashes, window - phrase + 1, np.minimum)
    windows, whole = w.grams(window, 1)
    return hashes, least, windows, whole


def _phrase_rows(window: int, phrase: int, bits: int):
    """Rows (seed, row_key, n, phrase): each phrase a document selects, how often, and its words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = window - phrase + 1
        for batch in batches:
            keys = batch.column("row_key").to_numpy()
            for begin, _, data, offsets in words.chunks(batch.column("text")):
                w = words.split(data, offsets)
                hashes, least, _, whole = _phrases(w, window, phrase, bits)
                if not whole.any():
                    continue
                # A phrase is selected if it is the least one of any window that holds it.
                padded = np.zeros(len(least) + 2 * (width - 1), np.uint64)
                padded[width - 1 : width - 1 + len(least)] = np.where(whole, least, 0)
                reach = words.sliding(padded, width, np.maximum)[: len(hashes)]
                at = np.flatnonzero((reach == hashes) & (words.sliding(_covered(whole, width), width, np.maximum)[: len(hashes)] > 0))
                document = w.document()[at]
                # Within a document phrases are told apart by another hash, too.
                other = w.grams(phrase, 2)[0][at]
                order = np.lexsort((other, hashes[at], document))
                seed, document, other, at = hashes[at][order], document[order], other[order], at[order]
                fresh = np.ones(len(seed), bool)
                fresh[1:] = (seed[1:] != seed[:-1]) | (document[1:] != document[:-1]) | (other[1:] != other[:-1])
                first = np.flatnonzero(fresh)
                counts = np.diff(np.append(first, len(seed)))
                raw = memoryview(data)
                spans = zip(w.starts[at[first]].tolist(), w.ends[at[first] + phrase - 1].tolist())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(_signed(seed[first])),
                        pa.array(keys[begin + document[first]]),
                        pa.array(counts.astype(np.int32)),
                        pa.array([b" ".join(bytes(raw[start:end]).split()) for start, end in spans], pa.binary()),
                    ],
                    names=["seed", "row_key", "n", "phrase"],
                )

    return run


def _covered(whole: np.ndarray, width: int) -> np.ndarray:
    padded = np.zeros(len(whole) + 2 * (width - 1), np.uint8)
    padded[width - 1 : width - 1 + len(whole)] = whole
    return padded


def _located(w: words.Words, phrases: pa.Array, phrase: int) -> np.ndarray:
    """Whether a phrase of ``phrases`` starts at each word of a shard, by one automaton over its word numbers."""
    import ahocorasick

    vocabulary, numbers = np.unique(w.hashes, return_inverse=True)
    _, _, data, offsets = next(words.chunks(phrases.unique().cast(pa.large_binary()).view(pa.large_string()), 1 << 62))
    wanted = words.split(data, offsets).hashes
    keys = np.searchsorted(vocabulary, wanted).reshape(-1, phrase)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for key in keys.tolist():
        automaton.add_word(tuple(key), 1)
    automaton.make_automaton()
    ends = np.fromiter((end for end, _ in automaton.iter(tuple(numbers.tolist()))), np.int64)
    found = np.zeros(len(numbers), bool)
    found[ends - phrase + 1] = True
    return found


def _runs(window: int, phrase: int, bits: int):
    """Rows (row_key, seed, start, n, repeats, run, windows): runs of windows around recurring phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = window - phrase + 1
        for batch in batches:
            keys = batch.column("row_key").to_numpy()
            lists = batch.column("phrases")
            for begin, end, data, offsets in words.chunks(batch.column("text")):
                recurring = lists.slice(begin, end - begin).flatten()
                if not len(recurring):
                    continue
                w = words.split(data, offsets)
                hashes, least, windows, whole = _phrases(w, window, phrase, bits)
                # A match across two documents is none: the hash there is _NONE.
                found = _located(w, recurring, phrase)[: len(hashes)]
                reached = words.sliding(np.where(found, hashes, _NONE), width, np.minimum)
                at = np.flatnonzero(whole & (reached == least) & (least != _NONE))
                if not len(at):
                    continue
                document = w.document()[at]
                seed, hashed = least[at], windows[at]
                opens = np.ones(len(at), bool)
                opens[1:] = (at[1:] != at[:-1] + 1) | (document[1:] != document[:-1]) | (seed[1:] != seed[:-1])
                first = np.flatnonzero(opens)
                last = np.append(first[1:], len(at))
                length = last - first
                # A run repeats a window if, sorted within runs, two neighbours are equal.
                of_run = np.repeat(np.arange(len(first)), length)
                order = np.lexsort((hashed, of_run))
                twice = (of_run[order][1:] == of_run[order][:-1]) & (hashed[order][1:] == hashed[order][:-1])
                repeats = np.zeros(len(first), bool)
                repeats[of_run[order][1:][twice]] = True
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[begin + document[first]]),
                        pa.array(_signed(seed[first])),
                        pa.array((at - w.first[document])[first].astype(np.int64)),
                        pa.array(length.astype(np.int64)),
                        pa.array(repeats),
                        pa.array(_signed(words.range_hashes(hashed, first, last, 2))),
                        pa.ListArray.from_arrays(
                            pa.array(np.append(first, len(at)).astype(np.int32)), pa.array(_signed(hashed))
                        ),
                    ],
                    names=["row_key", "seed", "start", "n", "repeats", "run", "windows"],
                )

    return run


def _cut(window: int):
    """Documents with the words that are left, and counts of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges = batch.column("ranges")
            counts, removed, kept = [], [], []
            for value, spans in zip(batch.column("text"), ranges):
                found = (value.as_buffer().to_pybytes() if value.is_valid else b"").split()
                drop = 0
                if spans.is_valid and len(spans):
                    edges = np.zeros(len(found) + 1, np.int64)
                    starts = spans.values.field("start").to_numpy()
                    np.add.at(edges, starts, 1)
                    np.add.at(edges, starts + spans.values.field("n").to_numpy() + window - 1, -1)
                    stays = (np.cumsum(edges)[:-1] == 0).tolist()
                    drop = len(found) - sum(stays)
                    counts.append(len(found))
                    found = [word for word, stay in zip(found, stays) if stay]
                else:
                    counts.append(len(found))
                removed.append(drop)
                kept.append(b" ".join(found))
            made = [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("document"), *made], names=["document", *ADDED])

    return run


def repeated_ranges(
    docs: DataFrame, text: str = "text", window: int = WINDOW, phrase: int = PHRASE, bits: int = BITS
) -> DataFrame:
    """Rows (row_key, start, n): n windows from word ``start`` on that occur elsewhere; row_key as in `remove_repeats`.

    ``bits`` of the hash of a phrase are used; with fewer of them more windows are compared, the result is the same.
    """
    spark = docs.sparkSession
    staging = Staging(spark, "substrings")
    keyed = docs.select(_key(docs).alias("row_key"), F.col(f"`{text}`").alias("text"))

    rows = keyed.mapInArrow(_phrase_rows(window, phrase, bits), "seed long, row_key long, n int, phrase binary")
    phrases = staging.write(rows, "phrases")
    recurring = phrases.groupBy("seed").agg(F.sum("n").alias("n")).where("n > 1").select("seed")
    # A set: equal rows have equal phrases, and a list must not grow with their number.
    known = phrases.join(recurring, "seed").groupBy("row_key").agg(F.collect_set("phrase").alias("phrases"))
    known = staging.write(known, "known")
    staging.drop("phrases")

    schema = "row_key long, seed long, start long, n long, repeats boolean, run long, windows array<long>"
    located = keyed.join(known.hint("shuffle_hash"), "row_key").select("row_key", "text", "phrases")
    runs = staging.write(located.mapInArrow(_runs(window, phrase, bits), schema), "runs")

    # One row per distinct run, with one document that has it.
    copies = runs.groupBy("seed", "run").agg(
        F.count(F.lit(1)).alias("copies"),
        F.min("row_key").alias("row_key"),
        F.max("repeats").alias("repeats"),
    )
    copies = staging.write(copies, "copies")
    open_seeds = (
        copies.groupBy("seed")
        .agg(F.min("copies").alias("least"), F.count(F.lit(1)).alias("runs"), F.max("repeats").alias("repeats"))
        .where("least = 1 AND (runs > 1 OR repeats)")
        .select("seed")
    )
    open_runs = staging.write(copies.join(open_seeds, "seed", "left_semi").select("seed", "run", "copies"), "open")
    # Of copies one is enough to compare with: the windows of a run do not depend on its document.
    single = runs.join(open_runs.where("copies = 1").select("seed", "run"), ["seed", "run"], "left_semi")
    single = single.select("seed", "row_key", "start", "windows", F.lit(1).alias("copies"))
    several = copies.where("copies > 1").join(open_seeds, "seed", "left_semi").select("seed", "run", "row_key")
    several = runs.join(several.hint("shuffle_hash"), ["seed", "run", "row_key"], "left_semi")
    several = several.select("seed", F.lit(None).cast("long").alias("row_key"), "start", "windows", F.lit(2).alias("copies"))
    dense = single.unionByName(several).select("seed", "row_key", "start", "copies", F.posexplode("windows").alias("at", "window"))
    dense = staging.write(dense.select("seed", "window", "row_key", (F.col("start") + F.col("at")).alias("start"), "copies"), "dense")
    confirmed = dense.groupBy("seed", "window").agg(F.sum("copies").alias("n")).where("n > 1").select("seed", "window")
    alone = dense.where("row_key IS NOT NULL").join(confirmed, ["seed", "window"], "left_semi")
    whole = runs.join(copies.where("copies > 1").select("seed", "run"), ["seed", "run"], "left_semi")
    ranges = whole.select("row_key", "start", "n").unionByName(alone.select("row_key", "start", F.lit(1).cast("long").alias("n")))
    ranges = staging.write(ranges, "ranges")
    staging.drop("known", "runs", "copies", "open", "dense")
    return ranges


def _key(docs: DataFrame):
    """Equal rows share a key, which is all the method needs: they lose the same words."""
    return row_key(*[f.name for f in docs.schema.fields if f.dataType.typeName() in ("long", "integer", "string")])


def remove_repeats(
    docs: DataFrame, text: str = "text", window: int = WINDOW, phrase: int = PHRASE, bits: int = BITS
) -> DataFrame:
    """``docs`` with n_words, n_removed and kept_text, the words left joined by one space.

    A word goes if a ``window``-word sequence that covers it starts at any other place of the corpus, be it in the same
    document; repeated rows count as documents of their own. Windows are judged on the input. Null and empty texts have
    no words and an empty kept_text; texts of fewer than ``window`` words lose nothing. Columns of ``docs`` named like
    the three added ones, in any case, are replaced; others may have any name. An empty table gives an empty result.
    """
    fields = [f for f in docs.schema.fields if f.name.lower() not in ADDED]
    ranges = repeated_ranges(docs, text, window, phrase, bits)
    per_row = ranges.groupBy("row_key").agg(F.collect_set(F.struct("start", "n")).alias("ranges"))
    document = F.struct(*[F.col(f"`{f.name}`") for f in fields]).alias("document")
    left = docs.select(document, F.col(f"`{text}`").alias("text"), _key(docs).alias("row_key"))
    joined = left.join(per_row.hint("shuffle_hash"), "row_key", "left").select("document", "text", "ranges")
    kinds = [("document", T.StructType(fields)), ("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_text", T.StringType())]
    made = joined.mapInArrow(_cut(window), T.StructType([T.StructField(*kind) for kind in kinds]))
    return made.select("document.*", *ADDED)
