"""Exact token ids by whole library calls on cached pieces of a text.

A text is cut where a white-space run begins after another character. No pre-token of a byte-level
vocabulary holds white space after another character, and the only look-ahead of the pattern asks for
white space or the end, so the ids of a text are the ids of its pieces in a row. Special strings hold
no white space and stay inside a piece.
"""

from __future__ import annotations

import re

#: White space as Unicode's White_Space property has it.
SPACE = "\t-\r \x85\xa0  -     　"
_PIECE = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
_ODD = re.compile("[\t\x0b\x0c\r\x00\x85\xa0  -     　]")
_PAIRS = ("  ", " \n", "\n ", "\n\n")
#: Below this code point letters and numbers are the same in every version of Unicode at hand.
_PLAIN_END = "ɐ"


def pieces(text: str) -> list[str]:
    """Parts of a text that can be encoded one by one; joined they are the text."""
    if _ODD.search(text) or any(p in text for p in _PAIRS):
        return _PIECE.findall(text)
    # single blanks and line ends only: cut before each of them
    return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")


class PieceCache(dict):
    """piece -> value, filled on a miss and emptied when full, so a worker's memory is bounded."""

    def __init__(self, encode, known=(), limit: int = 600_000):
        super().__init__(known)
        self._encode, self._known, self._limit = encode, known, limit

    def __missing__(self, piece: str):
        if len(self) >= self._limit:
            self.clear()
            self.update(self._known)
        value = self[piece] = self._encode(piece)
        return value


def byte_level_encoder(path: str):
    """piece -> list of ids of a byte-level vocabulary file, exactly as the tokenizers library gives them.

    Pieces of plain letters go through the faster rank encoder when it is installed and the file is a
    plain byte-level one; every other piece, special strings included, goes through tokenizers itself.
    """
    import json

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()

    def slow(piece: str) -> list[int]:
        return library.encode(piece, add_special_tokens=False).ids

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    fast = _rank_encoder(spec)
    if fast is None:
        return slow
    special = [t["content"] for t in spec.get("added_tokens") or ()]

    def encode(piece: str) -> list[int]:
        if piece and max(piece) < _PLAIN_END and not any(s in piece for s in special):
            return fast(piece)
        return slow(piece)

    return encode


def _rank_encoder(spec: dict):
    """The vocabulary as byte ranks, if the file says no more than that: no normalizer, usual pattern."""
    pre = spec.get("pre_tokenizer") or {}
    model = spec["model"]
    plain = (
        spec.get("normalizer") is None
        and pre.get("type") == "ByteLevel"
        and pre.get("use_regex")
        and not pre.get("add_prefix_space")
        and model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "end_of_word_suffix", "continuing_subword_prefix", "ignore_merges"))
    )
    try:
        import tiktoken
        from public_tokenizers import PATTERN
    except ImportError:
        return None
    if not plain:
        return None
    to_byte = {c: b for b, c in enumerate(byte_letters())}
    ranks = {}
    vocab = model["vocab"]
    for token, number in vocab.items():
        if all(c in to_byte for c in token):
            ranks[bytes(to_byte[c] for c in token)] = number
    if any(bytes([b]) not in ranks for b in range(256)):
        return None
    # ids must rise with the merges, as the rank encoder merges the smallest id first
    last = -1
    for merge in model["merges"]:
        left, right = merge if isinstance(merge, list) else merge.split(" ")
        if vocab[left + right] <= last:
            return None
        last = vocab[left + right]
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return [chr(b) if b in set(keep) else chr(next(other)) for b in range(256)]
