"""Aligned tokens against a plain comparison of all byte ranges."""

import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tables import documents, odd_texts, passage, rows_of
from tokenizers import Tokenizer

from quillmap.llm.alignment import Aligner, align_tokens, diagonals, overlaps
from quillmap.llm.queries import vocabulary
from quillmap.llm.tokens import byte_letters

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
COLUMNS = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


@pytest.mark.parametrize("step", [1, 2, 7, 1000])
def test_pieces_of_the_merge_give_all_overlaps(step):
    r = random.Random(step)
    for _ in range(80):
        end = r.randint(1, 60)
        a, b = (np.array(sorted({*r.sample(range(1, end + 1), r.randint(0, end)), end})) for _ in range(2))
        i, j, ca, cb = overlaps(a, b, step)
        begin = lambda x, k: x[k - 1] if k else 0
        want = {(p, q) for p in range(len(a)) for q in range(len(b)) if begin(a, p) < b[q] and begin(b, q) < a[p]}
        assert len(i) == len(want) and set(zip(i.tolist(), j.tolist())) == want
        assert list(zip(ca.tolist(), cb.tolist())) == [(p, q) for p in range(len(a)) for q in range(len(b)) if a[p] == b[q]]


def test_pieces_have_equal_work():
    r = np.random.default_rng(1)
    a, b = np.cumsum(r.integers(1, 9, 5000)), np.cumsum(r.integers(1, 2, 20_000))
    i, j = diagonals(a, b, 512)
    assert (np.diff(i + j)[:-1] == 512).all() and (np.diff(i) >= 0).all() and (np.diff(j) >= 0).all()


class Brute:
    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        letters = {c: bytes([k]) for k, c in enumerate(byte_letters())}
        vocab = json.load(open(A))["model"]["vocab"]
        self.bytes_a = {k: b"".join(letters[c] for c in t) for t, k in vocab.items() if all(c in letters for c in t)}

    def tokens(self, text):
        if not text:
            return [], []
        raw = (" " + text).encode()
        a = [(k, self.bytes_a[k]) for k in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for k in self.b.encode(text):
            p = self.b.id_to_piece(k)
            b.append((k, bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()))
        if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            return [], []
        return a, b

    def row(self, text):
        a, b = self.tokens(text)
        ranges = []
        for side in (a, b):
            at, out = 0, []
            for k, x in side:
                out.append((k, at, at + len(x)))
                at += len(x)
            ranges.append(out)
        ra, rb = ranges
        links = [(x[0], y[0]) for x in ra for y in rb if x[1] < y[2] and y[1] < x[2]]
        shared = sorted({x[2] for x in ra} & {y[2] for y in rb})
        groups = [
            ",".join(str(x[0]) for x in ra if low < x[2] <= end) + "|" + ",".join(str(y[0]) for y in rb if low < y[2] <= end)
            for low, end in zip([0, *shared], shared)
        ]
        return len(a), len(b), len(groups), links, ";".join(groups)


def brute_rows(texts):
    brute = Brute()
    found = [(i, brute.row(t)) for i, t in texts]
    count = Counter()
    for _, f in found:
        count.update(set(f[3]))
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    return [
        (i, f[0], f[1], f[2], len(f[3]), sum(count[x] == top[x[0]] for x in f[3]), sum(count[x] for x in f[3]), hashlib.sha256(f[4].encode()).hexdigest() if f[4] else "")
        for i, f in found
    ]


ODD = [
    "▁x a▁b", "<s> </s> <unk> <0x41> <|endoftext|> x", "ﬁn ＡＢ  　x y", "  two  blanks \t tab\n\n\n line \r\n end  ", "\n", " ", "a",
    "\U0001f600\U0001f468‍\U0001f469 नमस्ते 你好世界", "é é 1234567890 $$$ ###", "\x00\x01 nul", "don't we'll I'M", "x" * 3000,
]


@pytest.mark.parametrize("share", [1e-5, 0.01, 2.0])
def test_rows_equal_brute_force(spark, share):
    texts = [t for t in odd_texts() if t[0] != 4] + [(50 + k, t) for k, t in enumerate(ODD)] + [(90, ODD[3]), (90, ODD[3])]
    found = align_tokens(documents(spark, texts), A, B, share=share, whole=True)
    assert rows_of(found, *COLUMNS) == sorted(brute_rows(texts), key=repr)
    for row in found.collect():
        assert row.groups_sha256 == (hashlib.sha256(row.groups.encode()).hexdigest() if row.groups else "")
    assert align_tokens(documents(spark, []), A, B).count() == 0


def test_ids_of_pieces_are_those_of_the_whole_text():
    own, brute = Aligner(A, B), Brute()
    assert own.tied == {"\r"}
    r = random.Random(2)
    parts = [" ", "  ", "\n", "\t", " ", " ", "a", "the", "The", "ing", "é", "1", ".", ",", "\U0001f600", "<s>", "'s", "　", "\r\n", ";", "\t", "_", "́"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 14)))
        a, b = own.tokens(text)
        assert (list(a), list(b)) == tuple([k for k, _ in x] for x in brute.tokens(text)), repr(text)


def test_long_text_in_many_pieces(monkeypatch):
    monkeypatch.setattr("quillmap.llm.alignment.STEP", 64)
    text = "\n".join(passage(k, 40) for k in range(60))
    own = Aligner(A, B).columns([text, "", text[:50]], whole=True)
    brute = [Brute().row(t) for t in (text, "", text[:50])]
    assert own["groups"] == [x[4] for x in brute] and own["n_links"] == [len(x[3]) for x in brute]
    assert [Counter(dict(zip(p.tolist(), t.tolist()))) for p, t in zip(own["pairs"], own["times"])] == [Counter(32_000 * x + y for x, y in f[3]) for f in brute]
