"""Line-first cleaning with built-in functions only.

Measures are taken inside the row with array functions: no shuffle, no Python. Every line is judged by
punctuation, navigation and boilerplate rules; failing lines go; a document that loses too much goes too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Phrases of page furniture, looked for in short lines only.
BOILERPLATE = (
    "all rights reserved|cookie policy|accept cookies|enable javascript|privacy policy|terms of (use|service)"
    "|click here|read more|sign (in|up)|log in|subscribe|newsletter|share this|follow us|skip to content"
    "|back to top|powered by|page not found|add to cart|lorem ipsum"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once; a name used in several places of a lambda is not inlined."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, b: a + b.cast("long"))


def word_list(text: Column) -> Column:
    packed = F.trim(F.regexp_replace(text, SPACES, " "))
    return F.when(packed == "", F.array().cast("array<string>")).otherwise(F.split(packed, " "))


def _covered(hashes: Column, n: Column) -> Column:
    """Positions inside repeated windows: sort (hash, start), keep equal neighbours, add up what they cover."""

    def starts(sorted_pairs: Column) -> Column:
        def repeated(pair: Column, j: Column) -> Column:
            before, after = F.get(sorted_pairs, j - 1), F.get(sorted_pairs, j + 1)
            same = lambda other: F.coalesce(other["h"] == pair["h"], F.lit(False))
            return same(before) | same(after)

        return F.sort_array(F.transform(F.filter(sorted_pairs, repeated), lambda pair: pair["i"]))

    def spans(at: Column) -> Column:
        return total(F.transform(at, lambda v, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - v, F.lit(3)))))

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(let(pairs, starts), spans)


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that are found twice or more in the same list, the first find included."""

    def measured(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        inner = let(
            windows,
            lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h, F.size(w))).otherwise(F.lit(0).cast("long")),
        )
        return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(inner)

    return let(words, measured)


def failing_line(line: Column) -> Column:
    """Whether a line is not running text.

    Punctuation: symbols or exclamation marks make up over a twentieth, or over half of a longer line is in
    capitals. Navigation: a short line without a closing mark. Boilerplate: a short line with a known phrase.
    """
    n = F.length(line)
    without = lambda pattern: F.length(F.regexp_replace(line, pattern, ""))
    symbols = 20 * (n - without(r"[#*$%&|<>!»•]")) > n + 20
    capitals = (n > 30) & (2 * without(r"\p{Lu}+") < n)
    navigation = (n <= 40) & ~line.rlike(r"""[.!?…:;。？！]["'”’»)\]]*[\x20\x09-\x0D]*\z""")
    boilerplate = (n <= 300) & F.lower(F.when(n <= 300, line)).rlike(BOILERPLATE)
    return symbols | capitals | navigation | boilerplate


def clean_lines(docs: DataFrame, max_loss: float = 0.3, least_words: int = 50) -> DataFrame:
    """All columns of docs with text cleaned, and the measures, base_failed and kept for every row.

    base_failed: fewer than least_words words, or over half of the words in repeated 3-word windows. kept is
    false if base_failed or if failing lines hold more than max_loss of the characters of lines with words.
    Lines without words stay where they are. Null and empty texts have zero measures, fail and give an empty
    cleaned text; other nulls pass through; repeated rows are judged one by one; an empty table gives an
    empty result. Clashing columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed
    and kept are replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    rest = [c for c in docs.columns if c not in own]
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = word_list(text)
    measured = docs.select(
        *[F.col(c) for c in rest if c != "text"],
        text.alias("text"),
        let(
            words,
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                total(F.transform(w, lambda x: F.length(x))).alias("word_chars"),
                repeat_words(w).alias("n_repeat_words"),
            ),
        ).alias("__llm_w"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(
            lines,
            lambda x: F.struct(
                (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                total(F.transform(x, lambda y: F.length(y))).alias("all"),
                total(F.transform(F.filter(x, failing_line), lambda y: F.length(y))).alias("lost"),
            ),
        ).alias("__llm_l"),
    )
    failed = (F.col("__llm_w.n_words") < least_words) | (100 * F.col("__llm_w.n_repeat_words") > 50 * F.col("__llm_w.n_words"))
    cleaned = F.array_join(
        F.filter(F.split("text", "\n"), lambda x: ~(x.rlike(r"[^\x20\x09-\x0D]") & failing_line(x))), "\n"
    )
    judged = measured.select(
        *rest[: rest.index("text")],
        F.when(F.col("__llm_l.lost") > 0, cleaned).otherwise(F.col("text")).alias("text"),
        *rest[rest.index("text") + 1 :],
        "__llm_w.n_words",
        "__llm_w.word_chars",
        "n_symbols",
        "__llm_l.n_dup_lines",
        "__llm_w.n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("__llm_l.lost") <= max_loss * F.col("__llm_l.all"))).alias("kept"),
    )
    return judged


def quality_rules(docs: DataFrame, **limits) -> DataFrame:
    """doc_id, the measures, base_failed and kept; limits and special cases as in clean_lines."""
    return clean_lines(docs.select("doc_id", "text"), **limits).drop("text")
