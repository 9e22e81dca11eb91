"""Text expressions.  All are Catalyst expressions; none needs a Python worker."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions import fixed


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank(text: Column) -> Column:
    """Null, empty or nothing but Unicode white space."""
    return F.coalesce(~text.rlike(r"(?U)\S"), F.lit(True))


def normalize(text: Column) -> Column:
    """Lower case, every character that is no letter or digit becomes a space, runs collapse.

    White space is neither letter nor digit, so one pattern covers both steps.
    """
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def cut_bibliography(
    text: Column,
    keywords: Sequence[str] = fixed.BIBLIOGRAPHY_KEYWORDS,
    min_position: float = fixed.BIBLIOGRAPHY_MIN_POSITION,
) -> Column:
    """Drop the tail from the furthest last occurrence of a keyword late in the text."""

    def cut(pair: Column) -> Column:
        raw, mirrored = pair["raw"], pair["mirrored"]
        found = []
        for keyword in keywords:
            at = F.locate(keyword[::-1], mirrored)
            start = F.length(mirrored) - len(keyword) + 1 - at
            found.append(F.when((at > 0) & (start > F.length(raw) * min_position), start))
        return F.greatest(*found, F.lit(None).cast("int"))

    body = F.when(blank(text), F.lit("")).otherwise(text)
    pair = F.struct(body.alias("raw"), F.reverse(F.lower(body)).alias("mirrored"))
    return let(
        pair,
        lambda p: let(
            cut(p),
            lambda at: F.when(at.isNotNull(), p["raw"].substr(F.lit(1), at)).otherwise(p["raw"]),
        ),
    )


def segment_array(text: Column, pattern: str = fixed.SEGMENT_PATTERN) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def contains_any(text: Column, phrases: Sequence[str]) -> Column:
    test = F.lit(False)
    for phrase in phrases:
        test = test | F.contains(text, F.lit(phrase))
    return test


def word_count(text: Column) -> Column:
    """Number of tokens when split on the single space, without building the array."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ ]+"))


def tokenize(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda t: t != "")


def ngrams_of_tokens(tokens: Column, n: int) -> Column:
    """Distinct n-token strings; ``tokens`` should be a column of its own."""
    last = F.size(tokens) - n

    def gram(i: Column) -> Column:
        return F.concat_ws(" ", *[F.get(tokens, i + k) for k in range(n)])

    empty = F.array().cast("array<string>")
    return F.when(
        F.size(tokens) >= n, F.array_distinct(F.transform(F.sequence(F.lit(0), last), gram))
    ).otherwise(empty)


def gram_keys(tokens: Column, n: int, *scope: Column) -> Column:
    """Distinct n-token strings as 64-bit hashes; with ``scope``, only those of one scope are alike."""
    last = F.size(tokens) - n

    def key(i: Column) -> Column:
        return F.xxhash64(*scope, *[F.get(tokens, i + k) for k in range(n)])

    empty = F.array().cast("array<bigint>")
    return F.when(
        F.size(tokens) >= n, F.array_distinct(F.transform(F.sequence(F.lit(0), last), key))
    ).otherwise(empty)


def ngrams(text: Column, n: int) -> Column:
    return let(tokenize(normalize(text)), lambda tokens: ngrams_of_tokens(tokens, n))


def sentences(text: Column, min_chars: int = 10) -> Column:
    """Pieces between sentence ends and white space, longer than ``min_chars``."""
    return F.filter(F.split(text, fixed.SENTENCE_PATTERN), lambda s: F.length(s) > min_chars)


def trim_unicode(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def sentences_plain(text: Column, min_chars: int = 20) -> Column:
    pieces = F.transform(F.split(text, "[.!?]"), trim_unicode)
    return F.filter(pieces, lambda s: F.length(s) > min_chars)


def search_queries(text: Column, pieces: int = 5, min_words: int = 5, max_words: int = 7) -> Column:
    """First words of the first sentences, as search phrases."""
    first = F.slice(F.filter(F.split(text, "[.!?]"), lambda s: s != ""), 1, pieces)
    long_enough = F.filter(F.transform(first, tokenize), lambda words: F.size(words) >= min_words)
    return F.transform(long_enough, lambda words: F.array_join(F.slice(words, 1, max_words), " "))


def query_line(queries: Column, n: int = 3) -> Column:
    return F.array_join(F.slice(queries, 1, n), ", ")


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, fixed.PARAGRAPH_PATTERN), lambda p: p != "")


def jaccard(left: Column, right: Column) -> Column:
    """Overlap of two n-gram sets in percent; 0 when either is empty."""
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(
        F.size(F.array_intersect(left, right)) / F.size(F.array_union(left, right)) * 100
    )


def percent(inter: Column, left_size: Column, right_size: Column) -> Column:
    return inter / (left_size + right_size - inter) * 100


def round2(value: Column) -> Column:
    """Two decimals, half to even."""
    return F.rint(value * 100) / 100


def word_count_ws(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?U)\S+"))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def title_from_path(path: Column) -> Column:
    """File stem with ``_`` and ``-`` as spaces."""
    return F.translate(title_from_file(file_name(path)), "_-", "  ")


def title_from_file(name: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(name, r"\.[^/.]*$", "")
