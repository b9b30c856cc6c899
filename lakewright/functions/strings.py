"""String, hash and conversion expressions."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def instr(text: Column, part: Column, start: int = 1, occurrence: int = 1) -> Column:
    """Position of the n-th, possibly overlapping, hit from ``start``; 0 if there is none."""
    if start < 1 or occurrence < 1:
        return F.lit(0)
    last = F.length(text) - F.length(part) + 1
    places = F.when(last >= start, F.sequence(F.lit(start), F.greatest(last, F.lit(start))))
    hits = F.filter(places, lambda i: F.substring(text, i, F.length(part)) == part)
    found = F.coalesce(F.try_element_at(hits, F.lit(occurrence)), F.lit(0))
    return F.when(text.isNull() | part.isNull(), F.lit(None).cast("int")).otherwise(found)


def trim_all(text: Column) -> Column:
    """Strip blanks, tabs and line breaks on both sides."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def right(text: Column, n: int) -> Column:
    return F.right(text, F.lit(n))


def left(text: Column, n: int) -> Column:
    return F.left(text, F.lit(n))


def _title(text: Column) -> Column:
    """Upper-case the first letter of each run of word characters, lower-case its rest."""
    runs = F.regexp_extract_all(text, F.lit(r"([A-Za-z][A-Za-z0-9_']*|[^A-Za-z]+)"), F.lit(1))
    return F.array_join(F.transform(
        runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.lower(F.substring(r, F.lit(2), F.length(r))))), "")


def _join_words(text: Column) -> Column:
    """Drop a blank before a letter and raise the letter."""
    pieces = F.split(text, r"\s(?=[A-Za-z])")
    raised = F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(
        F.concat(F.upper(F.left(p, F.lit(1))), F.substring(p, F.lit(2), F.length(p)))))
    return F.array_join(raised, "")


def format_case(text: Column, style: str) -> Column:
    """upper, lower, capitalize, title, snake, camel or pascal; other styles leave the text alone."""
    def first(change):
        joined = _join_words(text)
        return F.concat(change(F.left(joined, F.lit(1))), F.substring(joined, F.lit(2), F.length(joined)))

    styles = {
        "upper": lambda: F.upper(text), "lower": lambda: F.lower(text),
        "capitalize": lambda: _title(text), "title": lambda: _title(text),
        "snake": lambda: F.lower(F.regexp_replace(text, r"\s+", "_")),
        "camel": lambda: first(F.lower), "pascal": lambda: first(F.upper),
    }
    return styles[style]() if style in styles else text


def clean(text: Column) -> Column:
    """Lower-cased text without anything but letters, digits, underscores and white space."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s\p{Z}]+", "")


def half_up_2(total: Column, count: Column) -> Column:
    """total / count rounded half up to two places, in whole-number arithmetic."""
    return F.when(count == 0, F.lit(0.0)).otherwise(
        F.floor((total * 200 + count) / F.nullif(count * 2, F.lit(0))) / F.lit(100.0))


def _word_facts(text: str, top: int) -> tuple[int, int, str | None]:
    """Words, letters and the most frequent words of one cleaned text; ties keep the order of first use."""
    counts: dict[str, int] = {}
    n = letters = 0
    for word in text.split():
        counts[word] = counts.get(word, 0) + 1
        n += 1
        letters += len(word)
    best = heapq.nlargest(top, counts.items(), key=lambda entry: entry[1])
    return n, letters, ",".join(f"{w}:{c}" for w, c in best) or None


def text_analysis(df: DataFrame, key: str, text: str, top: int = 10) -> DataFrame:
    """Word count, character count, mean word length and the most frequent words of each text.

    A text is one row, so nothing is shuffled: cleaning stays in the JVM and only
    the counting of words runs in Arrow batches. Exploding the words instead would
    shuffle more than the texts themselves.
    """
    @F.pandas_udf("word_count long, letters long, top_words string")
    def facts(cleaned: pd.Series) -> pd.DataFrame:
        rows = [_word_facts(t, top) if t is not None else (None, None, None) for t in cleaned]
        return pd.DataFrame(rows, columns=["word_count", "letters", "top_words"])

    found = df.select(key, F.char_length(text).cast("long").alias("char_count"), facts(clean(F.col(text))).alias("f"))
    return found.select(key, "f.word_count", "char_count",
                        half_up_2(F.col("f.letters"), F.col("f.word_count")).alias("avg_word_length"), "f.top_words")


def trigrams(text: Column) -> Column:
    """Distinct three-letter pieces of the words, each padded with two blanks before and one after."""
    parts = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(parts, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(
        F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams."""
    x, y = trigrams(a), trigrams(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(x, y)) / F.nullif(union, F.lit(0)))


def to_number(text: Column, fmt: str | None = None) -> Column:
    """Number from text, null where it does not parse."""
    if fmt:
        return F.try_to_number(text, F.lit(fmt)).cast("double")
    return text.try_cast("double")
