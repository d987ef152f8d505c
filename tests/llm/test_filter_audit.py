import random
import re
from itertools import permutations

import pytest

from agestrata.llm import filter_audit as fa

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _fails(text, earlier):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": earlier,
    }


def _brute(docs, labels):
    """Every order is run, document by document."""
    ids = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            ids.setdefault(text or "", []).append(doc_id)
    rows = []
    for doc_id, text, lang in docs:
        text = text or ""
        fails = _fails(text, doc_id is not None and min(ids[text]) < doc_id)
        marks = [r for r in labels if r[0] == doc_id and doc_id is not None]
        rows.append((lang or "", {k for k, v in fails.items() if v}, any(r[1] == 1 for r in marks), any(r[2] == 1 for r in marks)))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in r[1] for r in mine) - len(gone), sum(r[1] == {f} for r in mine),
                    sum(r[2] for r in gone), sum(r[3] for r in gone),
                ]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(shapley[order[step - 1]])
    return out


def _got(df):
    rows = df.collect()
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COUNTS] for r in rows}
    assert len(got) == len(rows)
    return got


def _text(rng):
    words = [rng.choice(["Word", "word", "other", "x$", f"w{rng.randrange(900)}"]) for _ in range(rng.choice([3, 199, 200, 400]))]
    if rng.random() < 0.5:
        words = [f"w{rng.randrange(5000)}" for _ in words]
    return " ".join(words) + rng.choice(["", " ", "\n#", "É漢"])


@pytest.fixture(scope="module")
def labels(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_equals_every_order_run(documents, labels):
    rng = random.Random(5)
    texts = [_text(rng) for _ in range(40)] + [None, ""]
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(150)]
    rng.shuffle(docs)
    marks = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 150, 2)]
    df = documents([(i, t, lang, "s") for i, t, lang in docs]).repartition(4)
    assert _got(fa.audit_documents(df, labels(marks))) == _brute(docs, marks)


def test_edge_cases(odd, documents, labels):
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in odd.collect()]
    # Repeated labels of one document count once; a label without an id belongs to none.
    marks = [(7, 1, 0), (7, 0, 1), (None, 1, 1), (1, None, None)]
    got = _got(fa.audit_documents(odd, labels(marks)))
    assert got == _brute(docs, marks)
    assert _got(fa.audit_documents(odd, labels([]))) == _brute(docs, [])
    assert fa.audit_documents(documents([]), labels(marks)).collect() == []


def test_copies_and_many_rows_without_id(documents, labels):
    docs = [(None, "same", "en")] * 50 + [(3, "same", "en")] * 40 + [(i, "same", "de") for i in range(3, 30)]
    assert _got(fa.audit_documents(documents([(*d, "s") for d in docs]), labels([(3, 1, 1)]))) == _brute(docs, [(3, 1, 1)])


def test_paths_of_the_lattice():
    edges = fa.lattice(4)
    assert len(edges) == 4 * 8
    counted = {}
    for order in permutations(range(4)):
        state = 0
        for f in order:
            counted[state, f] = counted.get((state, f), 0) + 1
            state |= 1 << f
    assert {(s, f): n for s, f, n in edges} == counted
