"""Cross-tokenizer alignment by merge-path partitioning.

Two vocabularies cut the same bytes into tokens A and tokens B. Merging their two sorted lists of end offsets gives
every overlap: each distinct end closes a stretch of bytes that one token of A and one of B cover. The
merge is divided by binary searches along its diagonals: the piece between diagonals d and d + step holds
exactly ``step`` ends, knows its slice of either list, and is merged by itself. Pieces emit overlaps and
common ends; the common ends of all pieces in a row close the groups, also those that a border cut.

How often two ids overlap is counted over the corpus, in documents. Frequent pairs, at most 1 / share of them, are
looked up in a broadcast table; the others, none of which has more than that share of the rows, by a shuffle.
"""

from __future__ import annotations

import hashlib
import json
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmap.llm.common import id_type, map_arrow, text_rows
from quillmap.llm.tokens import PieceCache, byte_letters, byte_level_encoder, pieces
from quillmap.session import store

#: Ends in a piece of the merge.
STEP = 1 << 16
#: Characters that are aligned together; a longer text is aligned by itself.
GROUP = 1 << 19


def byte_vocabulary(path: str):
    """(text -> ids, bytes of each id) of a byte-level tokenizers file; special strings are plain text."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    library.encode_special_tokens = True
    with open(path, encoding="utf-8") as file:
        special = [t["content"] for t in json.load(file).get("added_tokens") or ()]
    plain = byte_level_encoder(path)
    to_byte = {c: b for b, c in enumerate(byte_letters())}
    own = [b""] * library.get_vocab_size()
    for token, number in library.get_vocab().items():
        own[number] = token.encode() if token in special else bytes(to_byte[c] for c in token)

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            return library.encode(text, add_special_tokens=False).ids
        return plain(text)

    return encode, own


def piece_vocabulary(path: str):
    """(blank-led text -> ids, bytes of each id, characters that keep a text whole) of a sentencepiece model that adds a blank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(k) for k in range(model.get_piece_size())]
    own = [bytes([int(p[3:5], 16)]) if model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(names)]
    blank = model.piece_to_id("▁")
    # where white space follows nothing but blanks in any piece, no token reaches over the border of a piece of text
    tied = {p[k] for p in names for k in range(1, len(p)) if (p[k] == "▁" or p[k].isspace()) and p[k - 1 : k + 1] != "▁▁"}

    def encode(text: str) -> list[int]:
        if text[:1] == " ":
            return model.encode(text[1:], num_threads=1) if len(text) > 1 else [blank]
        return model.encode(text, num_threads=1)[1:]  # led by white space that no blank merges with

    return encode, own, tied


def diagonals(a: np.ndarray, b: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Borders of the pieces: of the first d ends in order, an A before an equal B, i[k] are A's and j[k] are B's."""
    n, m = len(a), len(b)
    d = np.append(np.arange(0, n + m, step), n + m)
    low, high = np.maximum(0, d - m), np.minimum(d, n)
    while (wide := low < high).any():
        mid = (low + high) // 2
        earlier = a[np.minimum(mid, n - 1)] <= b[np.clip(d - 1 - mid, 0, m - 1)]
        low, high = np.where(wide & earlier, mid + 1, low), np.where(wide & ~earlier, mid, high)
    return low, d - low


def merge_piece(a: np.ndarray, b: np.ndarray, i0: int, i1: int, j0: int, j1: int):
    """Overlaps (i, j) and common ends (i, j) of the ends i0..i1 of A and j0..j1 of B; needs one end of A before them."""
    i, j = np.arange(i0, i1), np.arange(j0, j1)
    partner_b = j0 + np.searchsorted(b[j0:j1], a[i0:i1])
    partner_a = i0 + np.searchsorted(a[i0:i1], b[j0:j1])
    common = np.zeros(len(j), bool)
    inside = partner_a < i1
    common[inside] = a[partner_a[inside]] == b[j0:j1][inside]
    if j1 > j0 and i0 and a[i0 - 1] == b[j0]:  # its A end is the last of the piece before
        common[0], partner_a[0] = True, i0 - 1
    own = ~common
    return np.concatenate([i, partner_a[own]]), np.concatenate([partner_b, j[own]]), partner_a[common], j[common]


def overlaps(a: np.ndarray, b: np.ndarray, step: int = STEP):
    """Overlapping (i, j) and common ends (i, j), both in order, of two rising lists with the same last end."""
    found = []
    if len(a):
        i, j = diagonals(a, b, step)
        found = [merge_piece(a, b, i[k], i[k + 1], j[k], j[k + 1]) for k in range(len(i) - 1)]
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *[f[k] for f in found]]) for k in range(4))


class Aligner:
    """Texts to aligned tokens, with one cache of pieces of text for both vocabularies."""

    def __init__(self, path_a: str, path_b: str):
        self.encode_a, self.bytes_a = byte_vocabulary(path_a)
        self.encode_b, self.bytes_b, self.tied = piece_vocabulary(path_b)
        self.length_a, self.length_b = (np.array([len(x) for x in v], np.int64) for v in (self.bytes_a, self.bytes_b))
        na, nb = len(self.bytes_a), len(self.bytes_b)
        self.size_b, self.pairs = nb, na * nb
        names = [f"{k}{end}" for k in range(na) for end in ",|"] + [f"{k}{end}" for k in range(nb) for end in ",;"]
        self.names = np.array(names, object)
        self.cache = PieceCache(self._both, limit=300_000)

    def _both(self, piece: str):
        """Ids of both vocabularies for a piece, packed in four bytes each, or None if the bytes of either are not the piece's."""
        a, b, raw = self.encode_a(piece), self.encode_b(piece), piece.encode("utf-8", "replace")
        if b"".join(map(self.bytes_a.__getitem__, a)) != raw or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
            return None
        return struct.pack(f"<{len(a)}I", *a), struct.pack(f"<{len(b)}I", *b)

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids of A, ids of B) of a blank and the text; none if either does not give the text back."""
        found: list = []
        if text and "▁" not in text:
            whole = any(c in text for c in self.tied)
            found = [self._both(" " + text)] if whole else list(map(self.cache.__getitem__, pieces(" " + text)))
        if None in found:
            found = []
        return tuple(np.frombuffer(b"".join([f[k] for f in found]), "<u4").astype(np.int64) for k in (0, 1))

    def group(self, texts: list[str], whole: bool) -> dict[str, list]:
        """Columns of some texts that are merged as one line: all begin and end with a common end."""
        found = [self.tokens(t) for t in texts]
        n_a, n_b = (np.array([len(f[k]) for f in found], np.int64) for k in (0, 1))
        a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        at_a, at_b = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])
        i, j, close_a, close_b = overlaps(np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b]))
        doc = np.repeat(np.arange(len(texts)), n_a)
        n_groups = np.bincount(doc[close_a], minlength=len(texts))
        # a token's place in the line of all ids, group by group, A before B
        of_a, of_b = np.searchsorted(close_a, np.arange(len(a))), np.searchsorted(close_b, np.arange(len(b)))
        codes = np.empty(len(a) + len(b), np.int64)
        before_b = np.concatenate([[0], close_b + 1])
        codes[np.arange(len(a)) + before_b[of_a]] = 2 * a + (close_a[of_a] == np.arange(len(a)))
        codes[np.arange(len(b)) + close_a[of_b] + 1] = 2 * (len(self.bytes_a) + b) + (close_b[of_b] == np.arange(len(b)))
        line = self.names[codes].tolist()
        lines = ["".join(line[p:q])[:-1] for p, q in zip((at_a + at_b)[:-1].tolist(), (at_a + at_b)[1:].tolist())]
        keys, times = np.unique(doc[i] * self.pairs + a[i] * self.size_b + b[j], return_counts=True)
        ends = np.searchsorted(keys, np.arange(1, len(texts)) * self.pairs)
        return {
            "n_a": n_a.tolist(),
            "n_b": n_b.tolist(),
            "n_groups": n_groups.tolist(),
            "n_links": (n_a + n_b - n_groups).tolist(),
            "groups_sha256": [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in lines],
            "pairs": np.split(keys % self.pairs, ends),
            "times": np.split(times.astype(np.int32), ends),
        } | ({"groups": lines} if whole else {})

    def columns(self, texts: list[str], whole: bool = False) -> dict[str, list]:
        out: dict[str, list] = {}
        at = 0
        while at < len(texts):
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size + len(texts[end]) <= GROUP:
                size += len(texts[end])
                end += 1
            for name, values in self.group(texts[at:end], whole).items():
                out.setdefault(name, []).extend(values)
            at = end
        return out


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *values]), kind))


COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def aligned_rows(docs: DataFrame, path_a: str, path_b: str, whole: bool = False) -> DataFrame:
    """doc_id, counts, digest, and the distinct id pairs that overlap with how often; ``groups`` too if whole.

    A pair is the id of A times the size of B's vocabulary, plus the id of B.
    """

    def aligner():
        own = Aligner(path_a, path_b)

        def step(batch):
            found = own.columns(batch.column("text").to_pylist(), whole)
            return (
                {"doc_id": batch.column("doc_id")}
                | {c: pa.array(found[c], pa.int64()) for c in COUNTS}
                | {"groups_sha256": pa.array(found["groups_sha256"], pa.string())}
                | {"pairs": _lists(found["pairs"], pa.int64()), "times": _lists(found["times"], pa.int32())}
                | ({"groups": pa.array(found["groups"], pa.string())} if whole else {})
            )

        return step

    schema = f"doc_id {id_type(docs)}, " + ", ".join(f"{c} bigint" for c in COUNTS)
    schema += ", groups_sha256 string, pairs array<bigint>, times array<int>" + (", groups string" if whole else "")
    return map_arrow(text_rows(docs), aligner, schema)


def pair_counts(links: DataFrame, size_b: int) -> DataFrame:
    """pair, n (documents that hold it) and best (no pair with the same id of A has more), one row a pair."""
    counts = store(links.groupBy("pair").agg(F.count("*").alias("n")), "pairs")
    a = F.expr(f"pair div {size_b}")
    # one row for each id of A: bounded by the vocabulary
    top = counts.groupBy(a.alias("_a")).agg(F.max("n").alias("_top"))
    joined = counts.withColumn("_a", a).join(F.broadcast(top), "_a")
    return joined.select("pair", "n", (F.col("n") == F.col("_top")).alias("best"))


def align_tokens(docs: DataFrame, path_a: str, path_b: str, share: float = 1e-5, whole: bool = False) -> DataFrame:
    """n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row; ``groups`` too if whole.

    path_a: byte-level tokenizers file; path_b: sentencepiece model; every executor has both. ``share`` only moves
    pairs between broadcast and shuffle. Null and empty texts, and those that either vocabulary does not give back
    byte for byte, have zeros and an empty digest. A null doc_id stays null; repeated rows count as
    documents of their own; an empty table gives an empty result; extra columns are dropped. A long text is
    aligned in memory in proportion to its tokens, in pieces of equal work.
    """
    size_b = len(piece_vocabulary(path_b)[1])
    # numbered before it is stored, so that a row keeps its number in all later reads
    rows = store(aligned_rows(docs, path_a, path_b, whole).withColumn("_row", F.monotonically_increasing_id()), "aligned")
    links = rows.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("_row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    counts = store(pair_counts(links, size_b), "pair_counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = F.broadcast(counts.where(F.col("n") > total * share))  # fewer than 1 / share rows
    rest = links.join(often.select("pair"), "pair", "left_anti").join(counts.where(F.col("n") <= total * share), "pair")
    seen = links.join(often, "pair").unionByName(rest)
    sums = seen.groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
    )
    out = rows.drop("pairs", "times").join(sums, "_row", "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return out.select("doc_id", *COUNTS, *zero, "groups_sha256", *(["groups"] if whole else []))
