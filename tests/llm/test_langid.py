import zlib

import numpy as np
import pytest

from agestrata.llm import langid as li
from agestrata.llm.queries import language_model, op7_language, table


def _grams(text):
    clean = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    clean = "".join(c for i, c in enumerate(clean) if c != " " or i == 0 or clean[i - 1] != " ")
    return {clean[i : i + n] for n in li.ORDERS for i in range(len(clean) - n + 1)}


TEXTS = ["the cat and the hat", "le chat et la maison", "der hund und die katze", "the dog", "la vie", "ein haus 12 und"]
LANGS = ["en", "fr", "de", "en", "fr", "de"]


def test_outputs_equal_the_kernel_written_out():
    model = li.fit(TEXTS, LANGS, 1, 0.01)
    marks = [next(i for i, x in enumerate(LANGS) if x == c) for c in model.languages]
    vocabulary = set().union(*(_grams(TEXTS[i]) for i in marks))
    own = lambda t: _grams(t) & vocabulary
    kernel = lambda a, b: len(own(a) & own(b)) / np.sqrt(max(1, len(own(a))) * max(1, len(own(b))))
    k = np.array([[kernel(TEXTS[a], TEXTS[b]) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(k)
    root = vectors / np.sqrt(values)
    feature = lambda t: np.array([kernel(t, TEXTS[b]) for b in marks]) @ root
    z = np.array([feature(t) for t in TEXTS])
    y = np.array([[1.0 if x == c else -1.0 for c in model.languages] for x in LANGS])
    share = np.full((6, 1), 1 / 2)
    solved = np.linalg.solve(z.T @ (z * share) + 0.01 * np.eye(3), z.T @ (y * share))
    for text in [*TEXTS, "chat und dog", "Été 7"]:
        rows = li.presence([text], model.keys, model.slots, model.probes)
        got = (rows @ model.weights)[0] / np.sqrt(max(1.0, rows.sum()))
        assert got == pytest.approx(feature(text) @ solved, abs=1e-4)


def test_held_out_accuracy(spark):
    docs = {r["doc_id"]: r for r in table(spark, "/root/testdata/sf0.01", "documents").collect()}
    rows = op7_language(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held]) > 0.97


def test_held_out_labels_are_not_read(spark, documents):
    rows = [(i, TEXTS[i % 6], LANGS[i % 6] if zlib.crc32(str(i).encode()) % 4 != 2 else "xx", "s") for i in range(80)]
    assert language_model(documents(rows)).languages == ["de", "en", "fr"]


def test_odd_rows(odd, documents):
    model = li.fit(TEXTS, LANGS, 2, 0.01)
    rows = li.identify(odd, model).collect()
    assert len(rows) == odd.count()
    found = {r["doc_id"]: r["lang_pred"] for r in rows}
    assert {found[i] for i in (0, 1, 2)} == {"und"} and found[3] != "und"
    assert all(0 <= r["score"] <= 1 for r in rows)
    none = li.train(documents([(1, "x", None, "s"), (2, None, "en", "s"), (3, "123", "en", "s")]))
    assert none.languages == [] and {r["lang_pred"] for r in li.identify(odd, none).collect()} == {"und"}
    assert li.identify(documents([]), model).collect() == []
    assert li.predict(model, ["漢字 漢字"])[0][0] in model.languages


def test_the_fit_is_bounded(spark, documents):
    rows = [(i, f"text number {'abcdefghij'[i % 10] * (i % 17 + 1)} of many", "en", "s") for i in range(300)]
    model = li.train(documents(rows), rows=50, landmarks=10)
    assert model.languages == ["en"] and 0 < len(model.keys)


def test_a_language_of_long_texts_is_learned(documents):
    """Books only, each beyond any other text in length."""
    rng = np.random.default_rng(3)
    vocabulary = {"en": "the cat and a house of which there were many things".split(), "xx": "zwô qrüm plakt vërn oqszi yttraf".split()}
    rows = [(i, " ".join(rng.choice(vocabulary["en"], 40)), "en", "s") for i in range(40)]
    rows += [(100 + i, " ".join(rng.choice(vocabulary["xx"], 6000)), "xx", "s") for i in range(8)]
    assert min(len(r[1]) for r in rows[40:]) > 20_000
    model = li.train(documents(rows))
    assert model.languages == ["en", "xx"]
    assert [x for x, _ in li.predict(model, ["zwô plakt qrüm oqszi", "there were many cats"])] == ["xx", "en"]
