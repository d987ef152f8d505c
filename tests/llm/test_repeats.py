import random
import re

import pytest

from agestrata.llm import repeats as rp


def _brute(rows, window=20):
    """rows: (doc_id, text). Words left per row."""
    place = lambda r: (r[0] is None, r[0] or 0)
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    starts = {}
    for row, w in zip(rows, words):
        for i in range(len(w) - window + 1):
            starts.setdefault(tuple(w[i : i + window]), []).append((place(row), i))
    out = []
    for row, w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if min(starts[tuple(w[i : i + window])]) < (place(row), i):
                gone |= set(range(i, i + window))
        out.append((row[0], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[3]))


def _got(df):
    rows = df.collect()
    for r in rows:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[3]))


def _corpus(rng, docs, words=400):
    passages = [[f"p{rng.randrange(60)}" for _ in range(rng.randint(15, 70))] for _ in range(6)]
    rows = []
    for i in range(docs):
        out = []
        for _ in range(rng.randint(0, 6)):
            out += [f"w{rng.randrange(words)}" for _ in range(rng.randint(0, 40))]
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            out += p[a:] if rng.random() < 0.5 else p
        rows.append((i, rng.choice([" ", "\n", "  "]).join(out)))
    return rows


def test_equals_brute_force(documents):
    rng = random.Random(11)
    rows = _corpus(rng, 80)
    rng.shuffle(rows)
    assert _got(rp.remove_repeats(documents(rows).repartition(5))) == _brute(rows)
    for window in (6, 25):
        assert _got(rp.remove_repeats(documents(rows), window)) == _brute(rows, window)


def test_frequent_seeds_are_split_exactly(documents, monkeypatch):
    monkeypatch.setattr(rp, "HOT", 3)
    monkeypatch.setattr(rp, "SALTS", 4)
    rows = _corpus(random.Random(12), 120) + [(1000 + i, "same words all over again " * 8) for i in range(40)]
    assert _got(rp.remove_repeats(documents(rows).repartition(6))) == _brute(rows)


def test_repeats_inside_one_document(documents):
    rows = [(0, "a b c d e " * 30), (1, "a " * 200), (2, " ".join(f"u{i}" for i in range(50)))]
    assert _got(rp.remove_repeats(documents(rows))) == _brute(rows)


def test_windows_are_judged_on_the_input(documents):
    words = [f"x{i}" for i in range(60)]
    rows = [(0, " ".join(words)), (1, " ".join(words[:40])), (2, " ".join(words[10:50] + ["end"]))]
    got = _got(rp.remove_repeats(documents(rows)))
    assert got == _brute(rows) and [r[2] for r in got] == [0, 40, 40]


@pytest.mark.parametrize("seed", range(3))
def test_random_small_vocabularies(documents, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(120)))) for i in range(30)]
    assert _got(rp.remove_repeats(documents(rows))) == _brute(rows)


def test_odd_rows(odd, documents):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert _got(rp.remove_repeats(odd)) == _brute(rows)
    long = " ".join(f"r{i}" for i in range(30))
    shared = [(5, long), (5, long), (5, "before " + long), (None, long), (None, long)]
    got = {(r[0], r[2]) for r in _got(rp.remove_repeats(documents(shared)))}
    # Equal rows fare alike; the same document starts earlier in one of its rows.
    assert got == {(5, 0), (5, 30), (None, 30)}
    assert rp.remove_repeats(documents([])).collect() == []


def test_hot_seeds_of_rows_that_share_an_id(documents, monkeypatch):
    rng = random.Random(13)
    monkeypatch.setattr(rp, "HOT", 3)
    hot = [f"h{i}" for i in range(20)]
    pair = [f"c{i}" for i in range(20)]
    # One place is a hot seed in one text of an id and a rare one in another.
    rows = [(i, " ".join(hot)) for i in range(20)]
    for i in range(30):
        n = rng.randrange(4)
        fill = [f"f{i}.{j}" for j in range(n)]
        rows += [(50 + i // 10, " ".join(fill + hot)), (50 + i // 10, " ".join(fill + pair)), (None, " ".join(fill + hot + pair))]
    rows += [(None, " ".join(hot + pair))] * 8
    got = _got(rp.remove_repeats(documents(rows).repartition(6)))
    assert sorted(got, key=repr) == sorted(_brute(rows), key=repr)


def test_found_spans_of_one_id_stay_apart(documents):
    docs = documents([(1, f"t{i} " + "same words all over again " * 12) for i in range(5)]).selectExpr("*", "xxhash64(text) AS copy")
    marked = rp._seed_rows(docs, 20, 5).groupBy("doc_id", "copy").count().collect()
    assert len(marked) == 5


def test_places_are_dealt_out_by_what_a_row_holds(spark, documents, monkeypatch):
    """A task that runs again may meet its rows in another order and in other batches."""
    monkeypatch.setattr(rp, "HOT", 0)
    rows = [(i % 7 if i % 3 else None, f"{'same words all over again ' * 9}{i % 11}", "en", "s") for i in range(50)]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    found = []
    try:
        for batch, order in ((7, 1), (10_000, 2)):
            spark.conf.set(name, batch)
            random.Random(order).shuffle(rows)
            texts = documents(rows).selectExpr("doc_id", "text", "xxhash64(text) AS copy")
            seeds = rp._seed_rows(texts, 20, 5)
            met = seeds.selectExpr("doc_id", "copy", "at * 2 + 1 AS mark").groupBy("doc_id", "copy").agg({"mark": "collect_set"})
            got = rp._occurrences(texts, met.toDF("doc_id", "copy", "met"), 20, 5)
            found.append(sorted(map(repr, got.select("doc_id", "copy", "key", "salt", "start").collect())))
    finally:
        spark.conf.unset(name)
    assert found[0] == found[1] and len(found[0]) > 500
