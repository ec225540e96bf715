"""Quality rules, line first, in DataFrame functions alone.

Each line of a text, however long, is judged by itself: it fails as navigation, as boilerplate (it holds a phrase of such
notices), for want of closing punctuation, or for too many symbols. Failed lines are removed; a document that loses too large a part of its words' characters is
rejected, as is one that fails the base rules (too few words, too much repetition).

Defined cases: a null text counts as empty; an empty or blank text has no words and fails the base rules. Blank lines
are neither judged nor counted. Repeated rows are judged each for itself. Other columns pass through `clean` untouched.
All work is in one row: there is no shuffle, and cost grows as n log n with a text's words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import GAP_CHARS, let, parted, whole, word_array

# The patterns of the line rules and the limits of the verdict.
SYMBOLS = "#*$%&|<>"
NAVIGATION = (
    r"(?i)(^[^a-zA-Z]*(home|menu|login|log in|log out|sign in|sign up|register|search|next|next page|previous|"
    r"previous page|back|back to top|share|share this|print|contact|contact us|about|about us|sitemap|skip to content)"
    r"[^a-zA-Z]*\z)"
)
BOILERPLATE = (
    r"(?i)all rights reserved|privacy policy|terms of (use|service)|cookie policy|accept (all )?cookies|"
    r"(licensed|released) under|enable javascript|lorem ipsum|click here|powered by|subscribe to our"
)
CLOSED = r"[.!?:;\x{2026}][\"')\]\x{201D}\x{2019}\x{BB}]*\z"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MIN_KEPT_PERCENT = 40
MAX_SYMBOL_PERCENT = 10
#: Separators of navigation bars; both are among SYMBOLS.
BARS = "[|>]"
MAX_BAR_PERCENT = 4
REPEAT_WINDOW = 5
RESULTS = "n_words word_chars n_symbols n_repeat_words n_dup_lines line_chars kept_chars kept_text base_failed kept".split()


def _has_word(text: Column) -> Column:
    return text.rlike(r"[^\x20\x09-\x0D]")


def _chars(texts: Column) -> Column:
    """Code points of all texts of an array."""
    return F.length(F.array_join(texts, "")).cast("bigint")


def _repeat_words(words: Column) -> Column:
    """Words in 5-word windows that the text has twice or more. Windows are compared by 64-bit hashes."""
    k = REPEAT_WINDOW

    def windows(h: Column) -> Column:
        every = F.transform(h, lambda x, i: F.xxhash64(x, *(F.get(h, i + j) for j in range(1, k))))
        return F.slice(every, 1, F.greatest(F.size(h) - (k - 1), F.lit(0)))

    def covered(keys: Column) -> Column:
        placed = F.sort_array(F.transform(keys, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

        def places(s: Column) -> Column:
            again = F.filter(s, lambda e, i: (F.get(s, i - 1)["h"] == e["h"]) | (F.get(s, i + 1)["h"] == e["h"]))
            return F.sort_array(F.transform(again, lambda e: e["p"]))

        start = F.struct(F.lit(-k).alias("last"), F.lit(0).cast("bigint").alias("n"))
        return F.aggregate(
            let(placed, places),
            start,
            lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(k), p - a["last"])).alias("n")),
            lambda a: a["n"],
        )

    def count(keys: Column) -> Column:
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0).cast("bigint")).otherwise(covered(keys))

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(windows(h), count))


def _share(line: Column, pattern: str, percent: int) -> Column:
    """Whether more than so many percent of a line's characters fit the pattern."""
    return 100 * F.regexp_count(line, F.lit(pattern)) > percent * F.length(line)


def line_passes(line: Column, symbols: Column) -> Column:
    """Whether a line that has a word stays; symbols: how many the whole text has (if none, no line is searched)."""
    return (
        F.rtrim(line, F.lit(GAP_CHARS)).rlike(CLOSED)
        & ~(line.rlike(NAVIGATION) | line.rlike(BOILERPLATE))
        & ((symbols == 0) | ~(_share(line, f"[{SYMBOLS}]", MAX_SYMBOL_PERCENT) | _share(line, BARS, MAX_BAR_PERCENT)))
    )


def judge(docs: DataFrame, text: str = "text", kept_text: bool = False) -> DataFrame:
    """docs with the base counts, base_failed, line_chars, kept_chars and kept; with kept_text also the lines that stay.
    Columns of docs with one of these names are replaced."""
    stays = [c for c in docs.columns if c not in RESULTS]
    docs = whole(docs, text)
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), _has_word)

    def by_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            _chars(w).alias("word_chars"),
            F.regexp_count(body, F.lit(f"[{SYMBOLS}]")).cast("bigint").alias("n_symbols"),
            _repeat_words(w).alias("n_repeat_words"),
        )

    def by_lines(x: Column) -> Column:
        stay = F.filter(x, lambda line: line_passes(line, F.col("_w.n_symbols")))

        def told(y: Column) -> Column:
            return F.struct(
                (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
                _chars(x).alias("line_chars"),
                _chars(y).alias("kept_chars"),
                *([F.array_join(y, "\n").alias("kept_text")] if kept_text else []),
            )

        return let(stay, told)

    # explode() of one struct is worked out once, and a later filter on it isn't pushed below it
    out = docs.select("*", F.explode(F.array(let(word_array(F.col(text)), by_words))).alias("_w"))
    out = out.select("*", F.explode(F.array(let(lines, by_lines))).alias("_l"))
    made = [f"_w.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_repeat_words")]
    made += [f"_l.{c}" for c in ("n_dup_lines", "line_chars", "kept_chars", *(["kept_text"] if kept_text else []))]
    out = out.select(*(F.col("_doc").getField(c).alias(c) for c in stays), *made)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    enough = 100 * F.col("kept_chars") >= MIN_KEPT_PERCENT * F.col("line_chars")
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & enough)


def clean(docs: DataFrame) -> DataFrame:
    """The documents that stay, without their failed lines; the columns of docs."""
    kept = judge(whole(docs, "text"), kept_text=True).filter("kept")
    return parted(kept, docs, text=F.col("kept_text"), n_chars=F.length("kept_text").cast("bigint"))
