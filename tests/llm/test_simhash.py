import random
import re

import numpy as np
import xxhash

from agestrata.llm import simhash as sh
from agestrata.llm.components import connected_components


def _brute_fp(text, k=3):
    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    runs = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def _brute_classes(fps, distance):
    label = list(range(len(fps)))
    for _ in fps:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= distance:
                    label[i] = label[j] = min(label[i], label[j])
    return label


def test_fingerprints(documents):
    texts = ["The Cat sat ON the mat", "É STAYS K", "a b", "a", "", None, "x\x0by z\x1cw", "one two three " * 50]
    rows = {r["doc_id"]: r for r in sh.simhash(documents(texts)).collect()}
    assert [rows[i]["fp"] & (2**64 - 1) for i in range(len(texts))] == [_brute_fp(t) for t in texts]


def test_spark_hash_is_the_same(spark):
    assert spark.sql("SELECT xxhash64('a b c')").first()[0] & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b c", 42)


def test_links_within_a_posting_connect_what_pairs_connect():
    rng = np.random.default_rng(1)
    for n in (2, 3, 50, 400):
        fps = np.unique((np.uint64(0xABC) << np.uint64(40)) | rng.integers(0, 1 << 16, n).astype(np.uint64))
        links = sh._links_within(fps.view(np.int64), 2)
        assert len(links) < len(fps)
        parent = {int(f): int(f) for f in fps.view(np.int64)}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            assert ((a ^ b) & (2**64 - 1)).bit_count() <= 2
            parent[max(root(a), root(b))] = min(root(a), root(b))
        want = _brute_classes([int(f) for f in fps], 2)
        got = [root(int(f)) for f in fps.view(np.int64)]
        assert len(set(got)) == len(set(want))


def test_classes_equal_brute_force_over_chains(spark):
    rng = random.Random(4)
    fps = set()
    for _ in range(25):
        f = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            fps.add(f)
            for _ in range(rng.randint(1, 3)):
                f ^= 1 << rng.randrange(64)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(s,) for s in signed], "fp long").repartition(5)
    for distance in (1, 2, 3):
        found = {r["node"]: r["component"] for r in connected_components(sh.fingerprint_links(nodes, distance)).collect()}
        want = _brute_classes(fps, distance)
        groups = {}
        for s, w in zip(signed, want):
            groups.setdefault(w, set()).add(s)
        for members in groups.values():
            assert {found.get(m, m) for m in members} == {min(members)}


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(1000, 1200)]
    star = [(5, i) for i in range(6, 400)]
    loop = [(1, 1), (2, 3), (3, 2), (2, 3), (None, 4)]
    rows = connected_components(spark.createDataFrame(chain + star + loop, "a long, b long")).collect()
    assert len(rows) == len({r["node"] for r in rows}) == 201 + 395 + 2
    assert {r["component"] for r in rows if r["node"] >= 1000} == {1000}
    assert {r["component"] for r in rows if r["node"] < 1000} == {5, 2}


def test_documents_and_one_of_each(odd, documents):
    rows = sh.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert {by[i][0]["component_id"] for i in (0, 1, 2)} == {0} and {by[i][0]["fp"] for i in (0, 1, 2)} == {0}
    assert [r["component_id"] for r in by[7]] == [7, 7]
    assert all(r["component_id"] is None for r in by[None])
    kept = sh.one_of_each(odd)
    assert kept.columns == odd.columns
    left = kept.collect()
    assert len(left) == len({r["class_fp"] for r in rows})
    assert {r["doc_id"] for r in left} == {0, 3, 4, 5, 6, 7, 8, None, 9, 10}
    assert sh.near_duplicates(documents([])).collect() == [] and sh.one_of_each(documents([])).collect() == []


def test_near_copies_are_found(documents):
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(3000)]
    near = list(base)
    near[100] = "changed"
    other = [f"v{rng.randrange(5000)}" for _ in range(3000)]
    found = {r["doc_id"]: r["component_id"] for r in sh.near_duplicates(documents([" ".join(t) for t in (base, near, other)])).collect()}
    assert found == {0: 0, 1: 0, 2: 2}
