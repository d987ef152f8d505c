import hashlib
import random
from fractions import Fraction
from math import floor, isfinite

import numpy as np
import pytest

from agestrata.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error string, _salt int, sums string"


@pytest.fixture(scope="module")
def vectors(spark):
    """Rows of (vec_id, vector, label), beside columns with names the operator uses."""
    return lambda rows: spark.createDataFrame([(*r, "x", "x", 1, "x") for r in rows], SCHEMA)


def _brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    rows = [r for r in rows if r[1] and all(x is not None and isfinite(x) for x in r[1])]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    rows = [r for r in rows if len(r[1]) == len(rows[0][1])]
    width = -(-len(rows[0][1]) // parts)
    cut = []
    for _, v, _ in rows:
        x = [floor(Fraction(a) * scale) for a in v] + [0] * (parts * width - len(v))
        cut.append([x[p * width : (p + 1) * width] for p in range(parts)])
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b))
    for step in range(rounds + 1):
        codes = [[min((dist(c[p], e), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]
        if step < rounds:
            for p in range(parts):
                for k in range(len(books[p])):
                    mine = [c[p] for c, code in zip(cut, codes) if code[p][1] == k]
                    if mine:
                        books[p][k] = [sum(col) // len(mine) for col in zip(*mine)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(d for d, _ in code) for code in codes]
    by = {}
    for r, e in zip(rows, errors):
        by[r[2]] = by.get(r[2], 0) + e
    fits = lambda n: n if n < 1 << 63 else None
    return sorted(
        (repr(r[0]), "".join(f"{k:02x}" for _, k in code), fits(e), fits(by[r[2]]), digest)
        for r, code, e in zip(rows, codes, errors)
    )


def _got(df):
    return sorted((repr(r[0]), *r[1:5]) for r in df.collect())


def _rows(n, dim, seed, spread=1.0):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, spread) for _ in range(dim)], rng.choice([None, 1, 2])) for i in range(n)]


def test_equals_brute_force(vectors):
    rows = _rows(300, 24, 1)
    random.Random(2).shuffle(rows)
    assert _got(vc.encode(vectors(rows).repartition(3))) == _brute(rows)


def test_ties_and_copies(vectors):
    rng = random.Random(3)
    rows = [(i // 2, [float(rng.randrange(3)) for _ in range(16)], i % 3) for i in range(200)]
    assert _got(vc.encode(vectors(rows), scale=1)) == _brute(rows, scale=1)
    assert _got(vc.encode(vectors([(i, [1.5] * 8, 0) for i in range(40)]))) == _brute([(i, [1.5] * 8, 0) for i in range(40)])


def test_odd_rows(vectors):
    rows = _rows(30, 16, 4)
    odd = [
        (100, None, 1), (101, [], 1), (102, [1.0, None] * 8, 1), (103, [float("nan")] * 16, 1),
        (104, [float("inf")] + [0.0] * 15, 1), (105, [1.0] * 5, 1), (106, [0.0] * 16, 1), (None, [0.25] * 16, None),
        (7, [0.5] * 16, None), (7, [0.5] * 16, None),
    ]
    assert _got(vc.encode(vectors(rows + odd))) == _brute(rows + odd)
    assert _got(vc.encode(vectors([(3, [0.1] * 9, None)]))) == _brute([(3, [0.1] * 9, None)])
    assert vc.encode(vectors(odd[:5])).collect() == [] == vc.encode(vectors([])).collect()


def test_numbers_of_any_size(vectors):
    rng = random.Random(6)
    rows = _rows(40, 8, 5) + [(100 + i, [rng.gauss(0, 1) * 10.0 ** rng.choice([3, 12, 25, 300]) for _ in range(8)], i) for i in range(20)]
    rows += [(200, [1.7e308] * 8, 9), (-1, [1e25] * 8, 8), (-2, [-1e25] * 8, 8)]
    assert _got(vc.encode(vectors(rows))) == _brute(rows)


def test_bounds_spare_distances_and_change_nothing():
    """Round by round, the assignment with bounds is the one of a full scan."""
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 400, (16, 4, 6))
    x = np.round(centres[rng.integers(0, 16, 3000)] + rng.normal(0, 60, (3000, 4, 6))).astype(np.int64)
    history, state, measured = [x[:16].transpose(1, 0, 2).copy()], None, []
    for _ in range(9):
        state, n = vc.assign(x, history, state, vc.displacements(history))
        full, _ = vc.assign(x, history[-1:], None, vc.displacements(history[-1:]))
        assert (state.code == full.code).all()
        measured.append(n / (x.shape[0] * 4 * 16))
        sums = {}
        vc._sums(x, state.code, 16, sums)
        book = history[-1].copy()
        for p in range(4):
            for k in range(16):
                slot = (p * 16 + k) * 7
                if sums.get(slot):
                    book[p, k] = [sums[slot + 1 + j] // sums[slot] for j in range(6)]
        history.append(book)
    assert measured[0] == 1 and max(measured[1:]) < 0.6 and measured[-1] < 0.2, measured


def test_net_displacement_is_below_the_drift():
    a = np.array([[[0, 0]]])
    history = [a, a + 30, a + 1, a + 31]
    steps = [vc.displacements(history[i : i + 2])[0, 0, 0] for i in range(3)]
    net = vc.displacements(history)
    assert net[1, 0, 0] < 2 < steps[1] + steps[2] and net[0, 0, 0] < sum(steps) / 2


def test_sums_travel_in_limbs():
    sums = {0: 5, 1: -3, 2: 1 << 200, 3: -(1 << 95) + 17, 4: 0}
    back = {}
    for r in vc._limbs(sums):
        assert abs(r["value"]) <= 1 << 32
        back[r["slot"]] = back.get(r["slot"], 0) + (r["value"] << 32 * r["limb"])
    assert back == sums
