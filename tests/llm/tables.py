"""Small tables with the awkward cases of every operator, and brute-force helpers."""

from __future__ import annotations

import random

ASCII_SPACE = " \t\n\x0b\x0c\r"
#: Columns that operators use inside or return; a table may have its own of these names.
CLASHING = ("n_words", "n_bytes", "n_tokens", "score", "labels", "kept", "shard", "starts", "root", "key", "fp", "piece", "length", "rank", "_rank", "_part")


def passage(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(n))


def odd_texts() -> list[tuple[int | None, str | None]]:
    shared = passage(1, 60)
    long = "\n".join(passage(k % 40, 30) + "." for k in range(400))
    near = passage(5, 300)
    return [
        (0, passage(9, 20) + " " + shared + " tail"),
        (1, None),
        (2, ""),
        (3, "word"),
        (4, long),
        (5, near),
        (6, near + " more"),
        (7, near),
        (7, near),
        (8, "head of it\n" + shared + " " + passage(10, 80)),
        (8, passage(11, 200)),
        (None, passage(12, 90)),
        (None, shared),
        (9, "  \t \n\n \x0b "),
        (10, "Été <|endoftext|>Naïve don't  İß ΟΔΟΣ é \U0001f600 x\x1d!<|startoftext|> 2² \x00 end\n"),
        (11, "a b c " * 120),
        (12, "Licensed under the Apache License, Version 2.0. UNDER THE MIT LICENSE; cc-by-nc cc by nc"),
        (13, "é" * 150 + "ü" * 40 + "é" * 150),
        (14, "Menu | Home | About | Contact\nRead more\n" + passage(14, 70) + ".\nAll rights reserved"),
        (15, "0" * 500),
    ]


def documents(spark, rows, extra: bool = True):
    """A documents table; with extra, columns with clashing names and nulls."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars int"
    data = [(i, t, "en" if i else None, None if i == 3 else "s", None if t is None else len(t)) for i, t in rows]
    df = spark.createDataFrame(data, schema).repartition(3)
    if extra:
        for c in CLASHING:
            df = df.selectExpr("*", f"cast(null as string) as `{c}`")
    return df


def words(text: str | None) -> list[str]:
    out, word = [], ""
    for c in text or "":
        if c in ASCII_SPACE:
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return [*out, word] if word else out


def rows_of(df, *columns) -> list[tuple]:
    """All rows of a result in a fixed order, nulls first."""
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)
