"""Tokens of two tokenizers aligned: against brute force with the tokenizers themselves."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from sonority.llm import alignment
from tests.llm.helpers import ODD, documents

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute(docs):
    """Whole texts are encoded and both lists are walked side by side."""
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(PATHS[0])
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    code = alignment.byte_alphabet()
    size = {i: bytes(code[c] for c in k) if all(c in code for c in k) else k.encode() for k, i in first.get_vocab().items()}
    piece = lambda i: bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()
    found, seen = [], Counter()
    for doc, text in docs:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        if {b"".join(size[i] for i in a), b"".join(map(piece, b))} != {(" " + (text or "")).encode()}:
            a, b = [], []
        ends_a, ends_b = (np.cumsum([len(of(i)) for i in ids]).tolist() for ids, of in ((a, size.get), (b, piece)))
        cuts = sorted(set(ends_a) & set(ends_b))
        groups, low = [], 0
        for cut in cuts:
            groups.append(([i for i, e in zip(a, ends_a) if low < e <= cut], [i for i, e in zip(b, ends_b) if low < e <= cut]))
            low = cut
        links = Counter((p, q) for x, y in groups for p in x for q in y)
        seen.update(links.keys())
        found.append((doc, len(a), len(b), groups, links))
    best = {}
    for (p, _), n in seen.items():
        best[p] = max(best.get(p, 0), n)
    return sorted(
        (
            (
                doc, n_a, n_b, len(g), sum(m.values()), sum(k for (p, q), k in m.items() if seen[p, q] == best[p]), sum(k * seen[x] for x, k in m.items()),
                hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g).encode()).hexdigest() if g else "",
            )
            for doc, n_a, n_b, g, m in found
        ),
        key=str,
    )


def got(spark, rows, hot=alignment.HOT_PAIRS):
    return sorted((tuple(r) for r in alignment.cross_alignment(documents(spark, rows), *PATHS, hot).select(NAMES).collect()), key=str)


MORE = [
    (20, "<|endoftext|> and <s> </s> <unk> <0x41>"), (21, "a  b   c    d"), (22, " leads"), (23, "ends "), (24, "\n\nlines\n \nmore"), (25, "▁ sign"), (26, "tab\tand\r\nbreak"), (27, "ﬁ Å é naïve"),
    (28, "日本語のテキストと絵文字😀😀"), (29, "don't WON'T 12345 3.14%!!"), (30, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"), (31, "one two three four five six"), (32, " nbsp wide"),
]


@pytest.mark.parametrize("hot", [alignment.HOT_PAIRS, 6, 0])
def test_matches_brute_force(spark, hot):
    rows = [r for r in ODD if r[1] is None or len(r[1]) < 1000] + MORE
    assert got(spark, rows, hot) == brute(rows)


def test_generated_texts(spark):
    chance = random.Random(3)
    chars = ["a", "e", "the", "Ing", " ", " ", "  ", "\n", "é", "日", "😀", "1", ".", "'s", "_", "ß", "́", "<s>"]
    rows = [(i, "".join(chance.choice(chars) for _ in range(chance.randint(0, 60)))) for i in range(150)]
    assert got(spark, rows) == brute(rows)


def test_long_text_and_a_group_with_many_links(spark, monkeypatch):
    monkeypatch.setattr(alignment, "LISTED", 3)
    rows = [(1, "word 日本語 " * 5000), (2, "😀é" * 300)]
    assert got(spark, rows) == brute(rows)


def test_common_ends_are_the_intersection():
    chance = np.random.default_rng(5)
    for _ in range(50):
        texts = [(np.unique(chance.integers(1, 80, chance.integers(1, 40))), np.unique(chance.integers(1, 80, chance.integers(1, 40)))) for _ in range(4)]
        a, b, low = [], [], 0
        for x, y in texts:
            a.append(np.append(x, 80) + low)
            b.append(np.append(y, 80) + low)
            low += 80
        flat_a, flat_b = np.concatenate(a), np.concatenate(b)
        at, other = alignment.common_ends(flat_a, flat_b, np.cumsum(list(map(len, a))), np.cumsum(list(map(len, b))))
        assert flat_a[at].tolist() == flat_b[other].tolist() == np.intersect1d(flat_a, flat_b).tolist()


def test_empty(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None), (1, ""), (None, "")]) == brute([(1, None), (1, ""), (None, "")])
