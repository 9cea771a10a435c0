"""Tokens: exact against the libraries, packing against its contract."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tables import documents, odd_texts, rows_of

from quillmap.llm.bpe import PrefixBpe, WordTokenizer, bpe_round_trip, decode_ids, encode_texts
from quillmap.llm.packing import pack_documents, plan_bins
from quillmap.llm.queries import vocabulary
from quillmap.llm.token_counts import count_tokens, frequent_pieces
from quillmap.llm.tokens import PieceCache, byte_level_encoder, pieces

BYTES, WORDS = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def random_texts(n, seed=1):
    r = random.Random(seed)
    alphabet = "abcTHE  \n\t\r\x00\x1c\x85\xa0　   éÉñİßΣσǅ'’stve0123½²Ⅷ.,!?-_<|>́漢😀​­ª"
    parts = ["the", "<|endoftext|>", "<|startoftext|>", " ", "\n", " \n ", "'s", "ΟΔΟΣ", "é", "aaaaaaa", "abab", " ", "\u0085"]
    out = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 50))) for _ in range(n)]
    return out + ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(n)]


def test_pieces_give_the_ids_of_whole_texts():
    tokenizer, encode = library(BYTES), byte_level_encoder(BYTES)
    for text in random_texts(1500) + [t or "" for _, t in odd_texts()]:
        own = pieces(text)
        assert "".join(own) == text
        assert [i for p in own if p for i in encode(p)] == tokenizer.encode(text, add_special_tokens=False).ids


def test_piece_cache_is_bounded():
    cache = PieceCache(len, {"known": 5}, limit=10)
    for k in range(100):
        assert cache["x" * k] == k
        assert len(cache) <= 11
    assert dict.get(cache, "known") == 5


def test_prefix_encoding_equals_the_library():
    tokenizer, own = library(WORDS), WordTokenizer(WORDS)
    for text in random_texts(1500, 2) + [t or "" for _, t in odd_texts()]:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        found = own.encode(text)
        assert np.frombuffer(found, "<u4").tolist() == ids
        assert own.decode(found) == tokenizer.decode(ids, skip_special_tokens=False)


def test_prefix_encoding_equals_plain_merging():
    merges = [["a", "a"], ["b", "c"], ["aa", "b"], ["a", "bc"], ["aa", "aa"], ["c", "a"]]
    vocab = {t: n for n, t in enumerate(["a", "b", "c", *[x + y for x, y in merges]])}
    own = PrefixBpe(vocab, merges)

    def plain(word):
        parts = list(word)
        while True:
            ranked = [(merges.index([x, y]), k) for k, (x, y) in enumerate(zip(parts, parts[1:])) if [x, y] in merges]
            if not ranked:
                return parts
            _, k = min(ranked)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    r = random.Random(4)
    for _ in range(2000):
        word = "".join(r.choice("abc") for _ in range(r.randint(1, 12)))
        assert own.tokens(word) == plain(word)


def test_round_trip_rows(spark):
    tokenizer = library(WORDS)
    want = []
    for doc_id, text in odd_texts():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        shown = tokenizer.decode(ids, skip_special_tokens=False)
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest()))
    docs = documents(spark, odd_texts())
    assert rows_of(bpe_round_trip(docs, WORDS)) == sorted(want, key=repr)
    ids = encode_texts(docs.where("doc_id = 10"), WORDS)
    text = decode_ids(ids, WORDS).first().text
    assert text == tokenizer.decode(ids.first().ids, skip_special_tokens=False)
    assert bpe_round_trip(documents(spark, []), WORDS).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, name):
    path = vocabulary(name)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    else:
        tokenizer = library(path)
        count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    want = [(i, len((t or "").encode()), count(t or ""), count(t or "") > 50) for i, t in odd_texts()]
    found = count_tokens(documents(spark, odd_texts()), path, limit=50)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert rows_of(found) == sorted(want, key=repr)
    assert count_tokens(documents(spark, []), path).count() == 0


def test_frequent_pieces_are_bounded_and_right(spark):
    tokenizer = library(BYTES)
    docs = documents(spark, odd_texts())
    table = frequent_pieces(docs, BYTES, share=1 / 50)
    assert 0 < len(table) <= 100
    assert all(n == len(tokenizer.encode(p, add_special_tokens=False).ids) for p, n in table.items())


def check_packing(rows, texts, capacity):
    tokenizer = library(BYTES)
    want = defaultdict(list)
    for doc_id, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc_id].append((piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    found, places = defaultdict(list), defaultdict(list)
    for r in rows:
        found[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        places[r.sequence_id].append((r.offset, r.length))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places), sum(n for own in places.values() for _, n in own)


def test_packing_rows(spark):
    found = pack_documents(documents(spark, odd_texts()), BYTES, capacity=256)
    bins, tokens = check_packing(found.collect(), odd_texts(), 256)
    assert bins <= -(-tokens // 256) + 1
    assert pack_documents(documents(spark, []), BYTES).count() == 0
    kept = pack_documents(documents(spark, odd_texts()), BYTES, capacity=256, keep_ids=True)
    assert all(len(r.ids) == r.length for r in kept.collect())


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plan_keeps_every_limit(rule):
    r = random.Random(5)
    histogram = {}
    for _ in range(3000):
        n = min(100, max(1, int(r.expovariate(1 / 30))))
        histogram[n] = histogram.get(n, 0) + 1
    for limits in ({}, {"max_pieces": 3}, {"max_attention": 10_000}, {"max_pieces": 4, "max_attention": 10_500}):
        bins = defaultdict(list)
        counts = defaultdict(int)
        for length, a, b, first, each, offset in plan_bins(histogram, 100, rule=rule, **limits).tolist():
            for k in range(b - a):
                bins[first + k // each].append((offset + k % each * length, length))
            counts[length] += b - a
        assert counts == histogram
        for own in bins.values():
            assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:k]) for k in range(len(own))]
            assert sum(n for _, n in own) <= 100
            assert len(own) <= limits.get("max_pieces", 100)
            assert sum(n * n for _, n in own) <= limits.get("max_attention", 10_000)
        if not limits:
            assert len(bins) <= sum(k * v for k, v in histogram.items()) / 100 * 1.02 + 1
