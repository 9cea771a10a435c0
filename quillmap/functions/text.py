"""Text helpers. Everything here is a JVM-side Column expression."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold_table() -> tuple[str, str]:
    """Letters with one diacritic to their ASCII base, as common full-text tokenisers fold them.

    Letters with two marks, and those whose base is no ASCII letter, stay. Combining marks are dropped.
    """
    accented, plain = ["\u017f", "\u1e9b"], ["s", "s"]  # both forms of the long s
    for code in (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) == 2 and base[0].isascii() and unicodedata.combining(base[1]):
            accented.append(chr(code))
            plain.append(base[0])
    marks = [chr(code) for code in range(0x0300, 0x0370)]
    return "".join(accented + marks), "".join(plain)


_ACCENTED, _PLAIN = _fold_table()

# English stop words used for topic words and labels.
STOP_WORDS = (
    "a about above after again against all also am an and any are as at be because been before "
    "being below between both but by can cannot could did do does doing down during each few for "
    "from further had has have having he her here hers herself him himself his how i if in into is "
    "it its itself just me more most my myself no nor not now of off on once only or other our ours "
    "ourselves out over own same she should so some such than that the their theirs them "
    "themselves then there these they this those through to too under until up very was we were "
    "what when where which while who whom why will with would you your yours yourself yourselves"
).split()


def fold(text: Column) -> Column:
    """Lower-case and strip diacritics; pure ASCII text skips the character map."""
    has_marks = text.rlike("[^\\x00-\\x7F]")
    return F.lower(F.when(has_marks, F.translate(text, _ACCENTED, _PLAIN)).otherwise(text))


def tokens(text: Column, min_length: int = 1) -> Column:
    """Maximal runs of letters and digits, folded, in text order."""
    words = F.array_remove(
        F.split(fold(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), ""
    )
    if min_length > 1:
        words = F.filter(words, lambda t: F.length(t) >= min_length)
    return words


def term_counts(words: Column) -> Column:
    """array<struct<token, tf>> of a token array, computed inside the row.

    The sorted array is cut where the token changes, so counting needs no shuffle. The one-element
    ``transform`` binds the sorted array once per row.
    """

    def count(sorted_words: Column) -> Column:
        n = F.size(sorted_words)
        starts = F.filter(
            F.sequence(F.lit(1), n),
            lambda i: (i == 1)
            | (F.element_at(sorted_words, i) != F.element_at(sorted_words, F.greatest(i - 1, F.lit(1)))),
        )
        return F.transform(
            F.array(starts),
            lambda s: F.transform(
                F.arrays_zip(
                    s.alias("first"),
                    F.concat(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), F.array(n + 1)).alias("next"),
                ),
                lambda z: F.struct(
                    F.element_at(sorted_words, z["first"]).alias("token"),
                    (z["next"] - z["first"]).cast("int").alias("tf"),
                ),
            ),
        )[0]

    none = F.from_json(F.lit("[]"), "array<struct<token:string,tf:int>>")
    return F.when(
        F.size(words) > 0, F.transform(F.array(F.sort_array(words)), count)[0]
    ).otherwise(none)


def rebuild_abstract(inverted_index: Column) -> Column:
    """Plain text from token -> positions: ordered by position, then word; gaps are not padded."""
    pairs = F.flatten(
        F.transform(
            F.map_entries(inverted_index),
            lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w"))),
        )
    )
    text = F.array_join(F.transform(F.sort_array(pairs), lambda x: x["w"]), " ")
    return F.coalesce(text, F.lit(""))


def compose_text(title: Column, abstract: Column, sep: str = ". ") -> Column:
    """Title and abstract as one text; only the title where there is no abstract."""
    head, body = F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit(""))
    return F.when(body != "", F.concat(head, F.lit(sep), body)).otherwise(head)


def truncate_text(text: Column, n: int = 300, ellipsis: str = "...") -> Column:
    """At most n characters; longer text ends in the ellipsis."""
    body = F.coalesce(text, F.lit(""))
    return F.when(
        F.length(body) > n, F.concat(F.substring(body, 1, n), F.lit(ellipsis))
    ).otherwise(body)


def clean_keyword(keyword: Column) -> Column:
    """Drop parentheses and the words AND / OR, collapse blanks."""
    bare = F.regexp_replace(keyword, "[()]", "")
    plain = F.regexp_replace(bare, "(?i)\\b(and|or)\\b", " ")
    return F.trim(F.regexp_replace(plain, "\\s+", " "))


def doi_url(doi: Column) -> Column:
    """Bare DOI to a resolver address; addresses and blanks stay."""
    value = F.coalesce(doi, F.lit(""))
    bare = (value != "") & ~value.startswith("http")
    return F.when(bare, F.concat(F.lit("https://doi.org/"), value)).otherwise(value)


def cache_key(stream: Column, keyword: Column, journal: Column) -> Column:
    """First 12 hex digits of the MD5 of stream|keyword|journal."""
    parts = [F.coalesce(c, F.lit("")) for c in (stream, keyword, journal)]
    return F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12)


def author_list(names: Column, most: int | None = 10, sep: str = "; ") -> Column:
    """First names of a list, or all of them if ``most`` is None, joined."""
    return F.array_join(F.slice(names, 1, most) if most else names, sep, "")


def split_tags(tags: Column, sep: str = "; ") -> Column:
    """Distinct tags of a joined list."""
    return F.array_distinct(F.split(F.coalesce(tags, F.lit("")), sep))


def blank_safe_key(value: Column, unique: Column) -> Column:
    """Join key in which blanks match nothing and do not pile up in one partition."""
    key = F.lower(F.coalesce(value, F.lit("")))
    return F.when(key == "", F.concat(F.lit("\u0000"), unique.cast("string"))).otherwise(key)
