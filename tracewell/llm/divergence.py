"""Quality rules by distribution divergence, in DataFrame functions only.

For each document the histogram of its characters over classes and that of the common words of its language are compared
with those of all documents of the language by the Jensen-Shannon distance (square root of the divergence, base 2).
A document that is long enough for the comparison and too far away in either one is not kept. Simple rules on length
and repeated words come first.

The histograms are written once; the references are sums over all of them, one row for each listed language and one for
all others, so that they may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.tables import Staging, quoted

# Frequent function words of the languages that have a word reference.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "sich", "mit", "auf", "des"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "las", "del", "un", "por"],
}
OTHER = "other"

LEAST_WORDS = 50
REPEATED_PERCENT = 50
CLASS_WORDS = 50
CLASS_DISTANCE = 0.28
COMMON_MIN_WORDS = 100
COMMON_DISTANCE = 0.24

_SPACES = " \\t-\\r"
_SYMBOLS = "#*$%&|<>"
_BLANK = " \t\n\x0b\f\r"


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.transform(F.array(value), body)[0]


def _sized(pattern: str, text: Column) -> Column:
    """How many characters match a character class."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def words(text: Column) -> Column:
    """The words of a text, runs of anything but blank, tab, newline, vertical tab, form feed and return."""
    return F.filter(F.split(text, f"[{_SPACES}]+"), lambda x: x != "")


def repeated_words(w: Column) -> Column:
    """How many words lie in a 3-word window that the text has twice or more, the first time included."""

    def of_windows(t: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            def twice(x, i):
                before, after = F.get(s, i - 1)["h"], F.get(s, i + 1)["h"]
                return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))

            places = F.sort_array(F.transform(F.filter(s, twice), lambda x: x["i"]))
            return _let(places, covered)

        def covered(p: Column) -> Column:
            # A window adds three words, or fewer if the next one begins inside it.
            steps = F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)

        pairs = F.sort_array(F.transform(t, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0).cast("long")).otherwise(_let(pairs, of_sorted))

    def of_words(a: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(a) - 2), lambda i: F.xxhash64(F.get(a, i - 1), F.get(a, i), F.get(a, i + 1)))
        return F.when(F.size(a) < 4, F.lit(0).cast("long")).otherwise(_let(windows, of_windows))

    return _let(w, of_words)


def duplicate_lines(text: Column) -> Column:
    """How many lines with a word equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(_BLANK))) > 0)
    return _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def _own_words(language: Column) -> Column:
    own = F.array().cast("array<string>")
    for name, listed in COMMON_WORDS.items():
        own = F.when(language == name, F.array(*map(F.lit, listed))).otherwise(own)
    return own


def histograms(docs: DataFrame, text: str = "text", lang: str | None = "lang") -> DataFrame:
    """``docs`` without its text, with n_words, the base measures, language, classes and common (counts)."""
    language = F.col(lang) if lang else F.lit(None).cast("string")
    listed = F.when(language.isin(list(COMMON_WORDS)), language).otherwise(F.lit(OTHER))
    names = [f"`{c}`" for c in docs.columns if c != text]
    rows = docs.select(*names, F.coalesce(F.col(text), F.lit("")).alias("_text"), listed.alias("language"))
    value = F.col("_text")
    rows = rows.withColumn("_words", words(value))
    own = _own_words(F.col("language"))

    def counts(w: Column) -> Column:
        hits = F.filter(w, lambda x: F.array_contains(own, x))
        each = _let(hits, lambda h: F.transform(own, lambda v: F.size(F.filter(h, lambda x: x == v)).cast("long")))
        # All measures of the words in one expression, so that the words of a text are made once.
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
            each.alias("common"),
        )

    rows = rows.select(
        *names,
        "language",
        _let(F.col("_words"), counts).alias("_of_words"),
        F.length(value).cast("long").alias("_chars"),
        _sized(f"[{_SYMBOLS}]", value).alias("n_symbols"),
        duplicate_lines(value).alias("n_dup_lines"),
        _sized(r"\p{Lu}", value).alias("_upper"),
        _sized(r"\p{Ll}", value).alias("_lower"),
        _sized("[0-9]", value).alias("_digits"),
        _sized(r"[.,;:!?'\"()-]", value).alias("_stops"),
    )
    inner = {c: F.col("_of_words")[c] for c in ("n_words", "word_chars", "n_repeat_words", "common")}
    blanks = F.col("_chars") - inner["word_chars"]
    known = [F.col("_upper"), F.col("_lower"), F.col("_digits"), F.col("_stops"), F.col("n_symbols"), blanks]
    rest = F.col("_chars") - sum(known[1:], known[0])
    return rows.select(
        *names,
        "language",
        inner["n_words"].alias("n_words"),
        inner["word_chars"].alias("word_chars"),
        "n_symbols",
        "n_dup_lines",
        inner["n_repeat_words"].alias("n_repeat_words"),
        F.array(*known, rest).alias("classes"),
        F.concat(
            inner["common"],
            F.array(inner["n_words"] - F.aggregate(inner["common"], F.lit(0).cast("long"), lambda a, x: a + x)),
        ).alias("common"),
    )


def references(rows: DataFrame) -> DataFrame:
    """Rows (language, ref_classes, ref_common): shares over all documents of a language; ``other`` is all documents."""

    def summed(frame: DataFrame, column: str, size: int) -> Column:
        return F.array(*[F.sum(F.get(F.col(column), F.lit(i))) for i in range(size)])

    size = max(map(len, COMMON_WORDS.values())) + 1
    own = rows.where(F.col("language") != OTHER).groupBy("language")
    own = own.agg(summed(rows, "classes", 7).alias("c"), summed(rows, "common", size).alias("w"))
    every = rows.agg(F.lit(OTHER).alias("language"), summed(rows, "classes", 7).alias("c"), F.array(F.sum("n_words")).alias("w"))
    both = own.unionByName(every.select("language", "c", "w"))
    return both.select("language", shares(F.col("c")).alias("ref_classes"), shares(F.col("w")).alias("ref_common"))


def shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return _let(total, lambda t: F.transform(counts, lambda x: F.when(t > 0, F.coalesce(x, F.lit(0)) / t).otherwise(F.lit(0.0))))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares, from 0 to 1."""

    def part(a: Column, b: Column) -> Column:
        m = (a + b) / 2
        one = F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
        return one + F.when(b > 0, b * F.log2(b / m)).otherwise(F.lit(0.0))

    parts = F.zip_with(p, q, lambda a, b: part(F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0))))
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def judge(
    docs: DataFrame,
    text: str = "text",
    lang: str | None = "lang",
    class_distance: float = CLASS_DISTANCE,
    common_distance: float = COMMON_DISTANCE,
) -> DataFrame:
    """``docs`` without its text, with the measures, class_distance, common_distance, base_failed and kept.

    base_failed: fewer than ``LEAST_WORDS`` words, or over ``REPEATED_PERCENT`` per cent of them repeated. Else a document
    is kept unless it has ``CLASS_WORDS`` words and its classes lie further than ``class_distance`` from the reference, or
    ``COMMON_MIN_WORDS`` words and its common words further than ``common_distance``. A null or empty text has no words
    and fails. A null or unlisted language is compared with all documents, and by its classes only. Columns of ``docs``
    named like the added ones, in whatever case, are replaced; all others may have any name. Repeated rows are judged alike; an empty table gives an empty result.
    """
    made = ("language", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes", "common")
    made += ("class_distance", "common_distance", "base_failed", "kept")
    names = [c for c in docs.columns if c.lower() not in (*made, text.lower())]
    # The document travels as one column, so no name of it meets a name of ours.
    whole = F.struct(F.lit(None).cast("int").alias("none"), *[quoted(c).alias(f"c{i}") for i, c in enumerate(names)])
    narrow = docs.select(whole.alias("document"), quoted(text).alias("text"), (quoted(lang) if lang else F.lit(None)).cast("string").alias("lang"))
    staging = Staging(docs.sparkSession, "divergence")
    rows = staging.write(histograms(narrow), "histograms")
    known = staging.write(references(rows), "references")
    joined = rows.join(F.broadcast(known), "language", "left")
    joined = joined.withColumns(
        {
            "class_distance": js_distance(shares(F.col("classes")), F.col("ref_classes")),
            "common_distance": js_distance(shares(F.col("common")), F.col("ref_common")),
        }
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    odd = ((F.col("n_words") >= CLASS_WORDS) & (F.col("class_distance") > class_distance)) | (
        (F.col("n_words") >= COMMON_MIN_WORDS) & (F.col("language") != OTHER) & (F.col("common_distance") > common_distance)
    )
    joined = joined.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~odd)
    return joined.select(*[F.col(f"document.c{i}").alias(c) for i, c in enumerate(names)], *made)
