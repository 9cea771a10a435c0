"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word exactly one token can come last in its BPE encoding: the one whose remaining
prefix encodes to something that ends in a compatible token. An automaton over the vocabulary names all
tokens that end at a position; a pair test picks the last one; back-pointers give the ids.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame

from quillmap.llm.common import id_type, map_arrow, text_rows
from quillmap.llm.tokens import PieceCache, byte_letters, pieces

#: Stands for the word-end mark inside the automaton; byte letters never use it.
_END = ""
_NEVER = 1 << 60
#: Characters that patterns of different libraries may class apart; such pieces go through the library's own steps.
_CONTROL = re.compile("[\x00-\x08\x0e-\x1f\x7f-\x9f\xad]")


class PrefixBpe:
    """The merges of a vocabulary as pair tests. Words come as byte letters without the word-end mark."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = ""):
        import ahocorasick

        self.suffix = suffix
        self.rank: dict[tuple[str, str], int] = {}
        self.parts: dict[str, tuple[str, str]] = {}
        for number, merge in enumerate(merges):
            left, right = merge if isinstance(merge, list) else merge.split(" ", 1)
            pair = (self._inner(left), self._inner(right))
            self.rank[pair] = number
            if self.parts.setdefault(pair[0] + pair[1], pair) != pair:
                raise ValueError("two merges make the same token; the last token of a prefix is not unique")
        self.automaton = ahocorasick.Automaton()
        self.ids, self.width = {}, {}
        for token, number in vocab.items():
            inner = self._inner(token)
            base = inner not in self.parts
            if base and len(inner.rstrip(_END)) != 1:
                continue  # no merges lead to it
            self.ids[inner] = number
            self.automaton.add_word(inner, inner)
        self.automaton.make_automaton()
        self._fits: dict[tuple[str, str], bool] = {}
        self._grown: tuple[dict, dict] = ({}, {})  # edges by side, one entry per token of the vocabulary at most

    def _inner(self, token: str) -> str:
        return token[: -len(self.suffix)] + _END if self.suffix and token.endswith(self.suffix) else token

    def _edges(self, token: str, side: int) -> list[tuple[str, int]]:
        """Tokens that stand at one edge of a token while it grows, with the merge that ends each one's time."""
        known = self._grown[side].get(token)
        if known is None:
            known, at, until = [(token, _NEVER)], token, _NEVER
            while at in self.parts:
                pair = self.parts[at]
                until, at = self.rank[pair], pair[side]
                known.append((at, until))
            self._grown[side][token] = known
        return known

    def _stay_apart(self, left: str, right: str) -> bool:
        rank = self.rank.get
        grown = self._edges(right, 0)
        for a, a_until in self._edges(left, 1):
            for b, b_until in grown:
                number = rank((a, b))
                if number is not None and number < a_until and number <= b_until:
                    return False
        return True

    def fits(self, left: str, right: str) -> bool:
        """Whether the two tokens stay apart when their joined text is merged.

        They do not if some merge joins the right edge of one with the left edge of the other before
        both are taken up by merges of their own. Of equal merges the leftmost goes first.
        """
        known = self._fits.get((left, right))
        if known is None:
            if len(self._fits) > 1_000_000:
                self._fits.clear()
            known = self._fits[left, right] = self._stay_apart(left, right)
        return known

    def tokens(self, word: str) -> list[str]:
        if not word:
            return []
        text = word + _END if self.suffix else word
        last: list[str | None] = [None] * (len(text) + 1)  # last[i]: last token of the prefix of i letters
        fits, cached = self.fits, self._fits.get
        for end, token in self.automaton.iter(text):
            if last[end + 1] is not None:
                continue
            start = end + 1 - len(token)
            if start:
                before = last[start]
                if before is None:
                    continue
                known = cached((before, token))
                if not (fits(before, token) if known is None else known):
                    continue
            last[end + 1] = token
        out, at = [], len(text)
        while at:
            token = last[at]
            if token is None:
                raise ValueError(f"no encoding of {word!r}")
            out.append(token)
            at -= len(token)
        return out[::-1]


class WordTokenizer:
    """A vocabulary file with words as units: cut, normalise, encode by prefixes, and decode."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if spec.get("decoder") is not None:
            raise ValueError("this decoder joins tokens by a blank; the file names another one")
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.bpe = PrefixBpe(model["vocab"], model["merges"], self.suffix)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or ()}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        library = Tokenizer.from_file(path)
        self._normalizer, self._pre = library.normalizer, library.pre_tokenizer
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self._pattern = regex.compile(steps[0]["pattern"]["Regex"])
        self._letters = byte_letters()
        self._words = PieceCache(self._encode_word, limit=500_000)
        self._known = PieceCache(self._encode_piece, limit=700_000)
        self.shown = {n: t for t, n in model["vocab"].items()} | {n: t for t, n in self.special.items()}

    def _encode_word(self, word: str) -> bytes:
        ids = self.bpe.ids
        return array("I", [ids[t] for t in self.bpe.tokens(word)]).tobytes()

    def _cut_words(self, text: str) -> list[str]:
        """Words of a normalised text in byte letters."""
        if _CONTROL.search(text) is None and text.isascii():
            return self._pattern.findall(text.lower())
        if _CONTROL.search(text) is None and max(text) < "ɐ":  # nothing to compose, and letters are the same in all versions of Unicode
            letters = self._letters
            return ["".join([letters[b] for b in w.encode()]) for w in self._pattern.findall(text.lower())]
        return [w for w, _ in self._pre.pre_tokenize_str(self._normalizer.normalize_str(text))]

    def _encode_piece(self, piece: str) -> bytes:
        if not any(s in piece for s in self.special):
            return b"".join([self._words[w] for w in self._cut_words(piece)])
        found = []
        for part in self._special.split(piece):
            if part in self.special:
                found.append(array("I", [self.special[part]]).tobytes())
            else:
                found += [self._words[w] for w in self._cut_words(part)]
        return b"".join(found)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        return b"".join(map(self._known.__getitem__, pieces(text)))

    def decode(self, ids: bytes) -> str:
        """Tokens joined by a blank, as libraries do for files that name no decoder; special tokens stay."""
        return " ".join(map(self.shown.__getitem__, memoryview(ids).cast("I")))


def bpe_round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per row doc_id, n_tokens, and digests of the ids and of the decoded text.

    path: a vocabulary file that every executor has. Null texts are empty: no ids, an empty decoded
    text. Null ids stay null, repeated rows are encoded one by one, an empty table gives an empty
    result and extra columns are dropped. Very long texts are encoded piece by piece.
    """

    def coder():
        tokenizer = WordTokenizer(path)

        def step(batch):
            n, ids, decoded = [], [], []
            for text in batch.column("text").to_pylist():
                found = tokenizer.encode(text)
                n.append(len(found) // 4)
                ids.append(hashlib.sha256(found).hexdigest())
                decoded.append(hashlib.sha256(tokenizer.decode(found).encode()).hexdigest())
            return {
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array(n, pa.int64()),
                "ids_sha256": pa.array(ids, pa.string()),
                "decoded_sha256": pa.array(decoded, pa.string()),
            }

        return step

    return map_arrow(
        text_rows(docs), coder, f"doc_id {id_type(docs)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and its ids as an array. Nulls, repeats and empty tables as in bpe_round_trip."""

    def coder():
        tokenizer = WordTokenizer(path)
        return lambda batch: {
            "doc_id": batch.column("doc_id"),
            "ids": pa.array(
                [memoryview(tokenizer.encode(t)).cast("I").tolist() for t in batch.column("text").to_pylist()],
                pa.list_(pa.int32()),
            ),
        }

    return map_arrow(text_rows(docs), coder, f"doc_id {id_type(docs)}, ids array<int>")


def decode_ids(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and the text of an ids array, special tokens included. A null array gives an empty text."""

    def coder():
        shown = WordTokenizer(path).shown
        return lambda batch: {
            "doc_id": batch.column("doc_id"),
            "text": pa.array([" ".join([shown[i] for i in ids or () if i in shown]) for ids in batch.column("ids").to_pylist()], pa.string()),
        }

    return map_arrow(rows.select("doc_id", "ids"), coder, f"doc_id {id_type(rows)}, text string")
