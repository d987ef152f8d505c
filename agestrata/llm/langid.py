"""Language identification by a string kernel, Nystroem landmarks and ridge regression."""

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from agestrata.llm.store import in_small_batches

#: Orders of the n-grams of the blended spectrum.
ORDERS = (1, 2, 3)
#: Bounds of the fit: documents per language, and landmarks per language.
FIT_ROWS, LANDMARKS = 400, 48
RIDGE = 1e-2
#: Texts that are looked at for each one wanted.
SPARE = 3
#: Sharpness of the score, a softmax over the outputs of the classes.
SHARPNESS = 8.0
#: Cells of a block of presence rows.
BLOCK_CELLS = 1 << 23
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text, every run of other characters than letters one
    space, with a space at both ends."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters(points)
    keep = letter | np.r_[True, letter[:-1]]
    return np.where(letter, points, 32)[keep].astype(np.uint64)


_TABLE = None


def _letters(points: np.ndarray) -> np.ndarray:
    """Which code points are letters, by a table filled on first use in a process."""
    global _TABLE
    if _TABLE is None:
        _TABLE = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _TABLE[points]


def _grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Exact keys of all n-grams, n up to 3: 21 bits a code point."""
    out = np.zeros(max(0, len(codes) - n + 1), np.uint64)
    for i in range(n):
        out = (out << np.uint64(21)) | codes[i : i + len(out)]
    return out


def gram_keys(text: str, orders=ORDERS) -> np.ndarray:
    """Keys of the n-grams of all orders, repeats included. Orders do not clash: no code
    point in a text is 0, so a shorter key has empty leading places."""
    codes = _codes(text)
    return np.concatenate([_grams(codes, n) for n in orders])


@dataclass
class Model:
    """``table`` finds a gram's column by open addressing; ``weights`` are columns by classes."""

    languages: list[str]
    keys: np.ndarray
    slots: np.ndarray
    weights: np.ndarray
    probes: int


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys * _MIX) >> np.uint64(64 - bits)).astype(np.int64)


def _table(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Places of distinct keys in a table at most an eighth full, -1 where there is none,
    and how many places a search has to look at."""
    bits = max(8, math.ceil(math.log2(max(1, len(keys)) * 8)))
    slots, most = np.full(1 << bits, -1, np.int32), 1
    for i, at in enumerate(_slot(keys, bits).tolist()):
        k = 1
        while slots[at] >= 0:
            at, k = (at + 1) & (len(slots) - 1), k + 1
        slots[at], most = i, max(most, k)
    return slots, most


def _columns(grams: np.ndarray, keys: np.ndarray, slots: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the grams that are among ``keys``, and their columns."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = _slot(grams, int(len(slots)).bit_length() - 1)
    where, found = [], []
    rest = np.arange(len(grams))
    for _ in range(probes):
        column = slots[at]
        there = column >= 0
        rest, at, column = rest[there], at[there], column[there]
        hit = keys[column] == grams[rest]
        where.append(rest[hit])
        found.append(column[hit])
        rest, at = rest[~hit], (at[~hit] + 1) & (len(slots) - 1)
    return np.concatenate(where), np.concatenate(found)


def presence(texts: list[str], keys: np.ndarray, slots: np.ndarray, probes: int) -> np.ndarray:
    """A row per text: 1 where the whole text has the gram."""
    return _presence(map(gram_keys, texts), len(texts), keys, slots, probes)


def _presence(grams: Iterable[np.ndarray], n: int, keys: np.ndarray, slots: np.ndarray, probes: int) -> np.ndarray:
    out = np.zeros((n, len(keys)), np.float32)
    for i, own in enumerate(grams):
        out[i, _columns(own, keys, slots, probes)[1]] = 1
    return out


def fit(texts: list[str], languages: list[str], landmarks: int, ridge: float) -> Model:
    """``fit_grams`` of texts."""
    return fit_grams([np.unique(gram_keys(t)) for t in texts], languages, landmarks, ridge)


def fit_grams(grams: list[np.ndarray], languages: list[str], landmarks: int, ridge: float) -> Model:
    """Kernel ridge regression, one class against the rest, on Nystroem features.

    The kernel of two texts is the number of n-grams, of all orders together, that both
    have, over the geometric mean of the numbers each has; n-grams that no landmark has are
    left out of all three. With landmarks L, features are K(x, L) K(L, L)^-1/2 and the
    regression is solved in that space. A kernel row is a presence row times the presence
    of the landmarks, so features and coefficients multiply out to one matrix, n-grams by
    classes, which is all that prediction needs.
    """
    names = sorted(set(languages))
    if not names:
        return Model([], np.zeros(0, np.uint64), np.full(256, -1, np.int32), np.zeros((0, 0), np.float32), 1)
    y = np.array([names.index(x) for x in languages])
    marks = np.concatenate([np.flatnonzero(y == c)[:landmarks] for c in range(len(names))])
    keys = np.unique(np.concatenate([grams[i] for i in marks]))
    slots, probes = _table(keys)
    p = _presence(grams, len(grams), keys, slots, probes)
    size = np.sqrt(np.maximum(p.sum(axis=1), 1.0))
    base = p[marks] / size[marks, None]
    cross = (p @ base.T) / size[:, None]
    values, vectors = np.linalg.eigh((base @ base.T).astype(float))
    kept = values > values.max() * 1e-8
    root = vectors[:, kept] / np.sqrt(values[kept])
    features = cross.astype(float) @ root
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    share = np.array([1 / max(1, (y == c).sum()) for c in range(len(names))])[y][:, None]
    gram = features.T @ (features * share) + ridge * np.eye(features.shape[1])
    solved = np.linalg.solve(gram, features.T @ (target * share))
    return Model(names, keys, slots, (base.T.astype(float) @ (root @ solved)).astype(np.float32), probes)


def predict(model: Model, texts: list[str | None]) -> list[tuple[str, float]]:
    """Language and score of each text, in blocks: presence rows times the n-gram weights."""
    out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
    known = [i for i, t in enumerate(texts) if t and model.languages and any(map(str.isalpha, t))]
    step = max(1, BLOCK_CELLS // max(1, len(model.keys)))
    for s in range(0, len(known), step):
        part = known[s : s + step]
        rows = presence([texts[i] for i in part], model.keys, model.slots, model.probes)
        values = (rows @ model.weights) / np.sqrt(np.maximum(rows.sum(axis=1), 1.0))[:, None]
        best = values.argmax(axis=1)
        sharp = np.exp(SHARPNESS * (values - values.max(axis=1, keepdims=True)))
        score = 1 / sharp.sum(axis=1)
        for i, b, p in zip(part, best.tolist(), score.tolist()):
            out[i] = (model.languages[b], min(1.0, max(0.0, p)))
    return out


def train(labelled: DataFrame, rows: int = FIT_ROWS, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Fit on ``text, lang``: for each language ``rows`` different texts with a letter, of any
    length, those whose digests come first. Tasks read them whole and send the driver the
    set of the n-grams of each, and no more than that. Languages whose texts are all
    without a letter are not learned.

    A language may have most of the rows: its digests are counted first, and only texts
    below a digest that some ``SPARE`` times ``rows`` of them have are shuffled at all,
    equal ones once.
    """
    fits = labelled.select("text", F.col("lang").cast("string").alias("lang")).where(
        "lang is not null and text is not null"
    ).where(F.col("text").rlike(r"\p{L}")).withColumn("_d", F.xxhash64("text"))
    counts = fits.groupBy("lang").agg(F.approx_count_distinct("_d").alias("n")).collect()
    if not counts:
        return fit([], [], landmarks, ridge)
    limits = []
    for r in counts:
        share = min(1.0, SPARE * rows / max(1, r["n"]))
        limits += [F.lit(r["lang"]), F.lit(min(2**63 - 1, int(2.0**64 * share) - 2**63)).cast("long")]
    first = Window.partitionBy("lang").orderBy("_d")
    sample = (
        fits.where(F.col("_d") <= F.element_at(F.create_map(*limits), F.col("lang")))
        .groupBy("lang", "_d").agg(F.min("text").alias("text"))
        .withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= rows)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(gram_keys(t)).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sets, pa.binary())], ["lang", "n", "grams"])

    found = in_small_batches(sample.select("lang", "_n", "text")).mapInArrow(run, "lang string, n int, grams binary")
    held = sorted(found.collect(), key=lambda r: (r["lang"], r["n"]))
    return fit_grams([np.frombuffer(r["grams"], np.uint64) for r in held], [r["lang"] for r in held], landmarks, ridge)


def _identified(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of ``docs``, renamed ``c0, c1`` and so on, and ``lang_pred, score`` of its
    ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = predict(shared.value, batch.column(at).to_pylist())
            languages, scores = pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, languages, scores], [*batch.schema.names, "lang_pred", "score"]
            )

    named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    shape = StructType(list(named.schema.fields)).add("lang_pred", "string").add("score", "double")
    return in_small_batches(named).mapInArrow(run, shape)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` for every whole ``text``: only the text is an input. NULL,
    texts without a letter and all texts, if no language was learned, are ``und`` with
    score 0. A text with letters of which the landmarks had none gets the first language,
    with the score of a tie. Repeated rows repeat; other columns are left out, whatever
    their names."""
    found = _identified(docs.select("doc_id", "text"), model)
    return found.select(F.col("c0").alias("doc_id"), "lang_pred", "score")


def accepted(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of ``docs`` whose language is recognised with a score of ``least`` or more,
    with it in ``lang``. Texts that are ``und`` go. All columns stay, whatever their names."""
    found = _identified(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return found.select(
        *[(F.col("lang_pred") if c == "lang" else F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)]
    )
