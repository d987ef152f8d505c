import pytest

from agestrata.llm import rollups
from agestrata.llm.store import new_folder
from tests.llm.conftest import collected


def _signed(spark, rows):
    return spark.createDataFrame(rows, "source string, lang string, tokenizer string, docs long, tokens long")


def test_batches_add_up_and_count_once(spark):
    r = rollups.Rollup(spark, new_folder(spark, "rollup"))
    assert r.totals().collect() == []
    first = _signed(spark, [("a", "en", "t1", 1, 10), ("a", "en", "t1", 1, 5), (None, None, "t1", 1, 2)])
    assert r.commit("b1", first) and not r.commit("b1", first)
    assert not r.commit("b1", _signed(spark, [("z", "z", "t", 9, 9)]))
    assert collected(r.totals()) == [("a", "en", "t1", 2, 15), (None, None, "t1", 1, 2)]
    assert r.commit("b2", _signed(spark, [("a", "en", "t1", -1, -5), ("a", "en", "t2", 1, 6), (None, None, "t1", -1, -2)]))
    assert collected(r.totals()) == [("a", "en", "t1", 1, 10), ("a", "en", "t2", 1, 6)]
    assert r.commit("empty", _signed(spark, [])) and r.totals().count() == 2
    # Another job sees the same log.
    again = rollups.Rollup(spark, r.folder)
    assert not again.commit("b2", first) and collected(again.totals()) == collected(r.totals())
    with pytest.raises(ValueError):
        r.commit("../x", first)


def test_a_broken_attempt_leaves_nothing(spark):
    r = rollups.Rollup(spark, new_folder(spark, "rollup"))
    rows = _signed(spark, [("a", "en", "t1", 1, 10)])
    rollups.summed(rows).write.parquet(f"{r.folder}/deltas/batch=b1")  # written, not logged
    assert r.totals().collect() == []
    assert r.commit("b1", rows) and collected(r.totals()) == [("a", "en", "t1", 1, 10)]


def test_revisions_move_documents(spark, documents):
    old = rollups.counted(documents([(1, "a b c", "en", "s"), (2, "a b", "en", "s")]))
    new = rollups.counted(documents([(1, "a b", "de", "s"), (2, "a b", "en", "t")]))
    r = rollups.Rollup(spark, new_folder(spark, "rollup"))
    r.commit("in", rollups.inserts(old))
    r.commit("changed", rollups.revisions(old, new))
    words = [x for x in collected(r.totals()) if x[2] == "words-1"]
    assert words == [("s", "de", "words-1", 1, 2), ("t", "en", "words-1", 1, 2)]


def test_counts(odd):
    rows = {(r["doc_id"], r["tokenizer"]): r["tokens"] for r in rollups.counted(odd).collect()}
    assert rows[0, "words-1"] == rows[0, "utf8-bytes-1"] == rows[1, "words-1"] == rows[2, "words-1"] == 0
    assert rows[6, "words-1"] == 60_000 and rows[5, "utf8-bytes-1"] == 100_000
    assert rows[9, "utf8-bytes-1"] == len("é ü 漢字 🙂 ß".encode())
