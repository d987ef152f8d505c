import random

import numpy as np
import pytest

from agestrata.llm import long_repeats as lr
from agestrata.llm import run_index as ri


def _starts(strings, length):
    places = {}
    for i, s in enumerate(strings):
        for j in range(len(s) - length + 1):
            places.setdefault(s[j : j + length], []).append((i, j))
    out = [[] for _ in strings]
    for same in places.values():
        for i, j in same if len(same) > 1 else ():
            out[i].append(j)
    return [sorted(x) for x in out]


def _brute(rows, length):
    texts = [(t or "").encode("utf-8", "surrogatepass") for _, t in rows]
    out = []
    for (doc_id, _), text, starts in zip(rows, texts, _starts(texts, length)):
        gone = np.zeros(len(text) + 1, bool)
        for s in starts:
            gone[s : s + length] = True
        edges = np.flatnonzero(np.diff(np.r_[0, gone.astype(int)])).reshape(-1, 2)
        kept = bytes(b for b, g in zip(text, gone) if not g)
        out.append((repr(doc_id), len(text), kept, tuple(map(tuple, edges.tolist()))))
    return sorted(out)


def _got(df):
    return sorted(
        (repr(r["doc_id"]), r["n_bytes"], bytes(r["kept"]), tuple((s["start"], s["end"]) for s in r["spans"])) for r in df.collect()
    )


def _corpus(rng, docs):
    passages = ["".join(rng.choice("abcdefgh é漢\n") for _ in range(rng.randint(60, 500))) for _ in range(6)]
    rows = []
    for i in range(docs):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            parts.append("".join(rng.choice("klmnop ü") for _ in range(rng.randint(0, 120))))
            parts.append(p[rng.randrange(20) :] if rng.random() < 0.5 else p)
        rows.append((i, "".join(parts)))
    rows += [(1000 + i, rows[i][1] + "tail") for i in range(0, docs, 3)] + [(2000 + i, rows[0][1]) for i in range(5)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("alphabet", [b"ab", b"abc\x00\xff", bytes(range(256))])
def test_index_equals_brute_force(alphabet):
    rng = random.Random(len(alphabet))
    for _ in range(120):
        base = [bytes(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(4)]
        strings = [b"".join(rng.choice(base)[rng.randint(0, 5) :] for _ in range(rng.randint(0, 3))) for _ in range(rng.randint(1, 12))]
        strings = list(dict.fromkeys(strings))
        for length in (1, 3, 10):
            assert [x.tolist() for x in ri.repeated_starts(strings, length)] == _starts(strings, length)


def test_transform_is_run_compressed():
    """The runs spell the transform, and their samples are places of suffixes in order."""
    rng = random.Random(1)
    piece = bytes(rng.choices(b"abcdef", k=300))
    strings = [piece[:i] + b"XYZ"[i % 3 : i % 3 + 1] + piece[i:] for i in range(0, 300, 10)]
    symbols, _ = ri.joined(strings)
    index = ri.RunIndex(symbols)
    order = sorted(range(len(symbols)), key=lambda i: (symbols[i:].tolist() + [ri._END]))
    rows = [symbols[i - 1] if i else ri._END for i in order]
    assert np.repeat(index.runs, index.lengths).tolist() == rows
    heads = np.cumsum(np.r_[0, index.lengths[:-1]])
    assert index.first.tolist() == [order[h] for h in heads]
    assert index.last.tolist() == [order[h + n - 1] for h, n in zip(heads, index.lengths)]
    assert len(index.runs) < len(symbols) / 8


def test_equal_windows_have_equal_anchors():
    rng = random.Random(2)
    text = bytes(rng.choices(b"ab ", k=3000)) + b"-" * 700 + b"=-" * 300
    seen, covered = {}, 0
    for a, s, e in zip(*(x.tolist() for x in lr.contexts(text, 80))):
        for start in range(s, e - 79):
            assert seen.setdefault(text[start : start + 80], a) == a
            covered += 1
    assert covered == len(text) - 79


def test_equals_brute_force(documents):
    rows = _corpus(random.Random(3), 50)
    assert _got(lr.remove_long_repeats(documents(rows).repartition(5))) == _brute(rows, 200)
    assert _got(lr.remove_long_repeats(documents(rows), 64)) == _brute(rows, 64)


def test_frequent_anchors_and_many_indexes(documents, monkeypatch):
    monkeypatch.setattr(lr, "INDEX_BYTES", 3000)
    rows = _corpus(random.Random(4), 40)
    want = _brute(rows, 100)
    for most in (1, 6):
        monkeypatch.setattr(lr, "MOST", most)
        assert _got(lr.remove_long_repeats(documents(rows).repartition(4), 100)) == want


def test_within_a_text_and_runs(documents):
    rows = [(1, "x" * 199), (2, "y" * 201), (3, "ab" * 5000), (4, "q" * 150 + "".join(map(chr, range(200, 700))) + "q" * 150),
            (5, "z" * 200), (6, "z" * 200 + "!"), (7, "unique " + "".join(map(chr, range(0x4E00, 0x4F00))))]
    assert _got(lr.remove_long_repeats(documents(rows))) == _brute(rows, 200)


def test_odd_rows(odd, documents):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert _got(lr.remove_long_repeats(odd)) == _brute(rows, 200)
    rows = [(None, "long enough " * 30)] * 3 + [(7, "other text " * 40), (7, "different " * 40)] + [(None, "short")] * 2
    assert _got(lr.remove_long_repeats(documents(rows, clashes=True))) == _brute(rows, 200)
    assert lr.remove_long_repeats(documents([])).collect() == []
    with pytest.raises(ValueError):
        lr.remove_long_repeats(documents([]), 40)
