import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from agestrata.llm import fingerprints as fp
from agestrata.llm.queries import op1_syncmer_fingerprints


def _edited(texts):
    out = []
    for i, t in enumerate(texts):
        nxt = texts[(i + 1) % len(texts)]
        half = len(t) // 2
        out.append(t[: len(t) - half] + nxt[:half])
    return out


def test_edits_and_order_over_many_ranges(spark, documents):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 6) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    ids = sorted(rng.sample(range(10**6), 300))
    docs = documents(list(zip(ids, texts))).repartition(7)
    want = {i: hashlib.sha256(e.encode()).hexdigest() for i, e in zip(ids, _edited(texts))}
    after = fp.with_next(docs, ordered=10).selectExpr("doc_id", "_next.text AS t").collect()
    assert {r["doc_id"]: r["t"] for r in after} == dict(zip(ids, texts[1:] + texts[:1]))
    rows = fp.edit_report(docs).collect()
    assert {r["doc_id"]: r["edited_sha256"] for r in rows} == want
    assert {r["doc_id"]: r["n_chars"] for r in rows} == dict(zip(ids, map(len, texts)))


def test_anchors_are_closed_and_free_of_context(documents):
    rng = random.Random(6)
    # Words of one unit each.
    passage = [f"{rng.randrange(16**4):04x}" for _ in range(60)]
    before, after = [[f"{rng.randrange(16**4):04x}" for _ in range(30)] for _ in range(2)]
    docs = documents([" ".join(passage), " ".join(before + passage + after)])
    rows = fp.anchors(docs.select("doc_id", "text"), "text", "a").orderBy("doc_id").collect()
    alone, within = [[(a["at"], a["hash"]) for a in r["a"]] for r in rows]
    assert {(at + 30, h) for at, h in alone} == {(at, h) for at, h in within if 30 <= at <= 30 + 60 - fp.K}
    # Some half of all runs: two of four inner places.
    assert 0.3 < len(within) / (120 - fp.K + 1) < 0.7


def test_likeness_follows_the_shared_share(documents):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    a, b = [" ".join(word() for _ in range(2000)) for _ in range(2)]
    rows = {r["doc_id"]: r for r in fp.edit_report(documents([a, b, b, "x"])).collect()}
    assert 0.2 < rows[0]["near_edited"] < 0.5 and rows[0]["near_next"] == 0
    assert rows[1]["near_next"] == 1 and rows[1]["fingerprint"] == rows[2]["fingerprint"] != rows[0]["fingerprint"]
    assert len(rows[0]["fingerprint"]) == 8 * fp.KEPT


def test_no_python_in_the_plan(spark, capsys):
    op1_syncmer_fingerprints(spark, "/root/testdata/sf0.001").explain("formatted")
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_odd_rows(odd, spark, documents):
    rows = fp.edit_report(odd).collect()
    assert len(rows) == odd.count()
    none = next(r for r in rows if r["doc_id"] == 0)
    assert none["n_chars"] == 0 and none["fingerprint"] == "" and none["near_next"] == 1
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert fp.edit_report(documents([])).collect() == []
    single = fp.edit_report(documents(["ab cd"])).first()
    assert single["edited_sha256"] == hashlib.sha256(b"ab ab").hexdigest() and single["near_next"] == 1
    ordered = {r["doc_id"] for r in rows}
    assert ordered == {None, *range(11)}


def test_likeness_is_judged_on_all_anchors_and_counts(documents):
    rng = random.Random(8)
    word = lambda: f"{rng.randrange(16**4):04x}"
    passage = [word() for _ in range(40)]
    long = [word() for _ in range(9000)]
    texts = [" ".join(long), " ".join([word() for _ in range(9000)] + passage), " ".join(passage + long), " ".join(passage * 3)]
    docs = documents(texts)
    found = {r["doc_id"]: Counter(a["hash"] for a in r["a"]) for r in fp.anchors(docs.select("doc_id", "text"), "text", "a").collect()}
    rows = {r["doc_id"]: r for r in fp.edit_report(docs).collect()}
    for i in range(4):
        a, b = found[i], found[(i + 1) % 4]
        assert rows[i]["near_next"] == (a & b).total() / (a | b).total()
    # A passage of less than 1% of the texts is seen.
    assert 0 < rows[1]["near_next"] < 0.01 and max(found[3].values()) == 3


def test_units_of_words_and_of_long_runs(documents):
    words = ["a", "abcd", "abcde", "x" * 15 + "y", "z" * 17, "漢字" * 10, "漢é" * 8]
    text = " \n".join(words)
    want = [w[i : i + 4] for w in words if len(w) <= 16 for i in range(0, len(w), 4)] + list("z" * 17 + "漢字" * 10)
    got = documents([text]).select(F.regexp_extract_all("text", F.lit(fp.UNIT), 0).alias("u")).first()["u"]
    assert sorted(got) == sorted(want) and "".join(got) == "".join(words)


def test_passages_without_spaces_are_found_at_any_offset(documents):
    rng = random.Random(9)
    passage = "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(300))
    texts = [passage] + [passage[:30] + "一二三"[:n] + passage[30:] for n in (1, 2, 3)] + ["x" * 20 + "一" * n + passage for n in (1, 2, 3)]
    docs = documents(texts)
    found = [{a["hash"] for a in r["a"]} for r in fp.anchors(docs.select("doc_id", "text"), "text", "a").orderBy("doc_id").collect()]
    assert all(len(found[0] & f) >= len(found[0]) - 5 for f in found[1:])
    assert all(r["near_next"] > 0.8 for r in fp.edit_report(docs.where("doc_id < 4")).collect())
