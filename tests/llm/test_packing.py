import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from agestrata.llm import packing as pk
from agestrata.llm.queries import TOKENIZER, op10_packed_sequences, table


def _tokenizer():
    return Tokenizer.from_file(TOKENIZER)


def _check(rows, docs, most):
    """Pieces are exact, and sequences gapless and within bounds; returns their number."""
    t = _tokenizer()
    want = Counter()
    for doc_id, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) if len(ids) <= most else len(ids) % most or most
        starts = [0, *range(first, len(ids), most)]
        for k, (s, e) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want[doc_id, k, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= most
    return len(by)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    rows = op10_packed_sequences(spark, sf).collect()
    n, total = _check(rows, docs, 2048), sum(r["length"] for r in rows)
    assert n <= -(-total // 2048) * 1.01 + 1


def test_odd_texts(odd, documents):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    _check(pk.pack(odd, TOKENIZER).collect(), docs, 2048)
    _check(pk.pack(odd, TOKENIZER, most=7).collect(), docs, 7)
    assert pk.pack(documents([]), TOKENIZER).collect() == []


def test_ids_are_those_of_the_tokenizer():
    encode, t = pk._Encoder(TOKENIZER), _tokenizer()
    encode.unchecked = 0
    texts = [
        "a  b   c \n d\n\n\te ", "<|endoftext|> x", "it's I'll 'S", "漢字🙂é 　x", "\x00\x1c\x85", " " * 6000 + "a", "z" * 20_000,
        "12345 67,8.9", " lead", "trail ", "\r\n\r\n", "é ‍",
    ]
    for text in texts:
        assert encode(text).tolist() == t.encode(text, add_special_tokens=False).ids, text[:20]


@pytest.mark.parametrize("most", [10, 64, 2048])
def test_solutions_are_exact_and_short(most):
    rng = np.random.default_rng(most)
    for counts in (
        np.bincount(rng.integers(1, most + 1, 3000), minlength=most + 1),
        np.bincount(rng.integers(1, most // 2 + 1, 37), minlength=most + 1),
        np.bincount([most // 2 + 1] * 50 + [most // 3] * 70, minlength=most + 1) * 1000,
        np.zeros(most + 1, np.int64),
    ):
        out = pk.solve(counts, most)
        used = np.zeros(most + 1, np.int64)
        for config, n in out.items():
            assert sum(config) <= most and n > 0
            for x in config:
                used[x] += n
        assert (used == counts).all()
        assert sum(out.values()) <= sum(pk._best_fit(counts, most).values())


def test_the_program_beats_best_fit_where_that_is_poor():
    # Best fit packs sixes and sevens first; the program finds 6+7+7 = 20 and 6+14.
    most = 20
    counts = np.zeros(most + 1, np.int64)
    counts[6], counts[7], counts[14] = 400, 400, 200
    assert sum(pk.solve(counts, most).values()) == 400


def test_pieces_of_a_cut():
    for n in range(1, 60):
        parts = pk.cut(n, 8)
        assert [s for s, _ in parts] == list(np.cumsum([0, *[k for _, k in parts]])[:-1]) and sum(k for _, k in parts) == n
        assert all(k == 8 for _, k in parts[1:]) and (len(parts) == 1) == (n <= 8)


def test_one_length_holds_most_rows(documents, monkeypatch):
    monkeypatch.setattr(pk, "RANKED", 10)
    rng = random.Random(1)
    docs = [(i, "same text here" if i % 3 else " ".join("word" for _ in range(rng.randrange(9)))) for i in range(900)]
    _check(pk.pack(documents(docs), TOKENIZER, most=16).collect(), docs, 16)


def test_added_tokens_in_texts_are_found(documents):
    t = Tokenizer.from_file(TOKENIZER)
    texts = [
        "a <|endoftext|> x", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", " <|endoftext|>\n\n <|endoftext|", "<|endoftext|>'s  é",
        "z" * 6000 + "<|endoftext|>", "none",
    ]
    want = [t.encode(text, add_special_tokens=False).ids for text in texts]
    assert want[0] == [64, 220, 50256, 2124]
    for unchecked in (0, 5):
        encode = pk._Encoder(TOKENIZER)
        encode.unchecked = encode.unchecked_added = unchecked
        assert [encode(text).tolist() for text in texts] == want
    encode.alike = False
    assert [encode(text).tolist() for text in texts] == want
    rows = {r["doc_id"]: r for r in pk.pack(documents(texts), TOKENIZER).collect() if r["piece"] == 0}
    for i, ids in enumerate(want):
        ids = np.array([*ids, 0], "<u4")
        if len(ids) <= 2048:
            assert (rows[i]["length"], rows[i]["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))
