import hashlib
import math
import random
import re

import pytest

from agestrata.llm import mixing as mx


def _targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        level = rest / sum(w[s] for s in open_) if open_ else 0
        over = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else level * w[s] for s in names}
        full |= over


def _brute(rows):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    keyed = []
    for doc_id, text, _, source in rows:
        n = words(text)
        weight = 1.0 if 3 <= len(text or "") / max(n, 1) <= 10 else 0.5
        u = (int(hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        keyed.append((source, -math.log(u) / weight, doc_id, n))
    sizes = {}
    for s, _, _, n in keyed:
        sizes[s] = sizes.get(s, 0) + n
    goal, out = _targets(sizes), []
    for s in sizes:
        own = sorted((x for x in keyed if x[0] == s), key=lambda x: x[1])
        epochs = math.floor(goal[s] / sizes[s]) if sizes[s] else 0
        rest, upto = goal[s] - epochs * sizes[s], 0
        for key in dict.fromkeys(x[1] for x in own):
            tied = [x for x in own if x[1] == key]
            add = sum(x[3] for x in tied)
            upto += add
            more = rest > 0 and (upto <= rest or upto - rest < rest - (upto - add))
            out += [(x[2], x[3], sizes[s], pytest.approx(goal[s]), x[3] * (epochs + more)) for x in tied]
    return out


def _rows(rng, n, sources):
    return [
        (i, " ".join("w" * rng.randint(1, 14) for _ in range(rng.randrange(60))), "en", rng.choice(sources)) for i in range(n)
    ]


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


@pytest.mark.parametrize("sources", [["a", "b", "c", "d"], ["a"] * 30 + ["b", None, "é", "Z"], ["hot"] * 200 + ["x", "y"]])
def test_equals_brute_force(documents, sources):
    rows = _rows(random.Random(len(sources)), 400, sources)
    got = mx.mix(documents(rows).repartition(3)).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert _sorted(got) == sorted(_brute(rows), key=lambda r: r[0])


def test_takes_come_near_targets_and_never_above_three(documents):
    rows = _rows(random.Random(1), 600, ["a"] * 50 + ["b", "c", "d"])
    got = mx.mix(documents(rows)).collect()
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r["source"], [r["target"], 0])[1] += r["taken"]
    assert sum(t for t, _ in by.values()) == pytest.approx(sum(r["size"] for r in got))
    assert all(abs(t - n) <= 60 for t, n in by.values())


def test_targets_cascade(spark):
    sizes = {"a": 10, "b": 1, "c": 1000, "d": 50, "e": 0, None: 7}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mx.targets(df, (1, 2, 3), 3).collect()}
    assert got == pytest.approx(_targets(sizes))


def test_quality_raises_the_chance(documents):
    rows = [(i, ("good " if i % 2 else "x ") * 10, "en", "s") for i in range(2000)]
    rows += [(5000, "one", "en", "t")]
    got = mx.mix(documents(rows), weights=(1, 3)).collect()
    # Source s is to give all but what t may take, so raise t to see a partial draw of s.
    assert sum(r["taken"] for r in got) > 0
    half = mx.mix(documents(rows[:2000] + [(6000 + i, "zz " * 10, "en", "t") for i in range(2000)]), weights=(1, 3)).collect()
    drawn = [r["doc_id"] % 2 for r in half if r["source"] == "s" and r["taken"]]
    assert len(drawn) > 500 and sum(drawn) / len(drawn) > 0.55


def test_rows_of_the_mix(odd, documents):
    rows = _rows(random.Random(3), 200, ["a", "a", "a", "b", None])
    docs = documents(rows, clashes=True)
    mixed = mx.mixed_rows(docs)
    assert mixed.columns == docs.columns
    times = {}
    for r in mixed.collect():
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mx.mix(docs).collect() if r["size"]}
    assert {k: v for k, v in times.items() if k in taken} == {k: v for k, v in taken.items() if v}


def test_odd_rows_and_reruns(odd, documents):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in odd.collect()]
    got = mx.mix(odd).select("doc_id", "size", "source_size", "target", "taken")
    first = _sorted(got.collect())
    assert first == _sorted(mx.mix(odd.repartition(5)).select(*got.columns).collect())
    assert first == sorted(_brute(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert mx.mix(documents([])).collect() == [] and mx.mixed_rows(documents([])).collect() == []
    assert {r["taken"] for r in mx.mix(documents(["", None, " "])).collect()} == {0}
