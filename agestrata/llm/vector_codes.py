"""Vectors as short codes: a codebook for every part, fitted by exact rounds whose
assignments are proven by bounds where they can be."""

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agestrata.llm.store import in_small_batches, remove, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Sums by label are met by so many salts of the rows.
SALTS = 32
#: Sums travel in limbs of so many bits, so that no sum is too large for them.
LIMB = 32
#: Bounds are moved outwards by these shares, far more than their rounding.
_UP, _DOWN = 1 + 1e-9, 1 - 1e-6
_STATE = "code binary, upper binary, upper_at binary, lower binary, lower_at binary"
_SUMS = "sums array<struct<slot: int, limb: int, value: long>>"


def integers(vectors: np.ndarray, parts: int, scale: int) -> np.ndarray:
    """Rows of ``floor(scale * x)`` cut into ``parts``, padded with zeros to a multiple of
    them: 64-bit integers, or Python's where squared distances might not fit into those."""
    n, dim = vectors.shape
    width = -(-dim // parts)
    vectors = vectors.astype(np.float64)
    small = dim == 0 or float(np.abs(vectors).max(initial=0)) * scale < _most(dim)
    if small:
        out = np.zeros((n, parts * width), np.int64)
        out[:, :dim] = np.floor(vectors * scale).astype(np.int64)
    else:
        out = np.zeros((n, parts * width), object)
        for i, j in np.ndindex(n, dim):
            top, bottom = float(vectors[i, j]).as_integer_ratio()
            out[i, j] = top * scale // bottom
    return out.reshape(n, parts, width)


def _most(dim: int) -> float:
    return math.sqrt(2.0**60 / dim) / 2


def _one_kind(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (x, books) if x.dtype == books.dtype else (x.astype(object), books.astype(object))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(axis=-1)


def _roots(squares: np.ndarray) -> np.ndarray:
    """Square roots as floats; infinite where a square is too large for one."""
    if squares.dtype != object:
        return np.sqrt(squares.astype(np.float64))
    return np.array([float(math.isqrt(s)) + 1 if s < 1 << 2000 else np.inf for s in squares.ravel()]).reshape(squares.shape)


def displacements(history: list[np.ndarray]) -> np.ndarray:
    """``[stamp, part, entry]``: at most how far the entry lies now from where it was in
    that round. The net way: an entry that went and came back has moved by nothing."""
    now = history[-1]
    return np.stack([_roots(_squares(*_one_kind(now, then))) for then in history]) * _UP


class Assigned:
    """Nearest entries of a batch of vectors, and bounds with the round they are of."""

    def __init__(self, code, upper, upper_at, lower, lower_at):
        self.code, self.upper, self.upper_at, self.lower, self.lower_at = code, upper, upper_at, lower, lower_at

    @classmethod
    def read(cls, columns: list, parts: int, entries: int):
        kinds = (np.uint8, np.float64, np.uint8, np.float32, np.uint8)
        shapes = ((-1, parts),) * 3 + ((-1, parts, entries),) * 2
        return cls(*(np.frombuffer(b"".join(c.to_pylist()), k).reshape(s).copy() for c, k, s in zip(columns, kinds, shapes)))

    def columns(self) -> list[pa.Array]:
        return [
            pa.array([row.tobytes() for row in x], pa.binary())
            for x in (self.code, self.upper, self.upper_at, self.lower, self.lower_at)
        ]


def assign(x: np.ndarray, history: list[np.ndarray], before: Assigned | None, moved: np.ndarray) -> tuple[Assigned, int]:
    """The nearest entry of the last codebook for every part of every vector, ties to the
    lower index, and the number of distances measured.

    An upper bound on the distance to the assigned entry and a lower one on that to every
    entry keep the round they were measured in. Since then an entry moved by the norm of
    the sum of its steps, which is never more than the sum of their norms; where the lower
    bound less that is beyond the upper bound plus that, the entry is not nearest. Only the
    rest are measured again, in whole numbers."""
    x, books = _one_kind(x, history[-1])
    now, (n, parts, _), entries = len(history) - 1, x.shape, books.shape[1]
    if before is None:
        squares = np.stack([_squares(x, books[None, :, k]) for k in range(entries)], axis=-1)
        code = squares.argmin(axis=-1)
        roots = _roots(squares)
        upper = np.take_along_axis(roots, code[..., None], -1)[..., 0] * _UP
        stamps = np.full(code.shape, now, np.uint8)
        lower = _lower(roots)
        return Assigned(code.astype(np.uint8), upper, stamps, lower, np.full(lower.shape, now, np.uint8)), squares.size
    part, entry = np.arange(parts), np.arange(entries)
    code = before.code.astype(np.int64)
    upper = before.upper + moved[before.upper_at, part, code]
    lower = before.lower - moved[before.lower_at, part[:, None], entry]
    others = entry != code[..., None]
    open_ = ((lower <= upper[..., None]) & others).any(axis=-1)
    i, p = np.nonzero(open_)
    own = _squares(x[i, p], books[p, code[i, p]])
    root = _roots(own)
    before.upper[i, p], before.upper_at[i, p] = root * _UP, now
    close = (lower[i, p] <= root[:, None] * _UP) & others[i, p]
    row, k = np.nonzero(close)
    squares = _squares(x[i[row], p[row]], books[p[row], k])
    roots = _roots(squares)
    before.lower[i[row], p[row], k], before.lower_at[i[row], p[row], k] = _lower(roots), now
    # Least square first, then least index, among the own entry and those measured.
    rows, ks = np.r_[np.arange(len(i)), row], np.r_[code[i, p], k]
    values, roots = np.concatenate([own, squares]), np.concatenate([root, roots])
    order = np.lexsort((ks, values, rows)) if values.dtype != object else np.array(
        sorted(range(len(rows)), key=lambda q: (rows[q], values[q], ks[q])), np.int64
    )
    first = order[np.r_[True, rows[order][1:] != rows[order][:-1]]] if len(order) else order
    before.code[i, p], before.upper[i, p] = ks[first], roots[first] * _UP
    return before, len(values)


def _lower(roots: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(roots), np.minimum(roots * _DOWN, 3e38), 0).astype(np.float32)


def _sums(x: np.ndarray, code: np.ndarray, entries: int, into: dict[int, int]) -> None:
    """Add counts and components of every part's entries, by slot."""
    n, parts, width = x.shape
    for p in range(parts):
        counts = np.bincount(code[:, p], minlength=entries)
        total = np.zeros((entries, width), x.dtype)
        np.add.at(total, code[:, p], x[:, p])
        for k in np.flatnonzero(counts).tolist():
            slot = (p * entries + k) * (width + 1)
            for j, value in enumerate([int(counts[k]), *map(int, total[k])]):
                into[slot + j] = into.get(slot + j, 0) + value


def _limbs(sums: dict[int, int]) -> list[dict]:
    out = []
    for slot, value in sums.items():
        limb = 0
        while not -(1 << LIMB) <= value < 1 << LIMB:
            out.append({"slot": slot, "limb": limb, "value": value & (1 << LIMB) - 1})
            value >>= LIMB
            limb += 1
        out.append({"slot": slot, "limb": limb, "value": value})
    return out


def _round(rows: DataFrame, history: list[np.ndarray], scale: int) -> DataFrame:
    """Vectors with their state after the last codebook of ``history``, and from every task
    a row with the sums of its parts by entry."""
    moved, (parts, entries, _) = displacements(history), history[-1].shape
    started = "code" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, kinds = {}, None
        for batch in batches:
            kinds = kinds or [c.type for c in batch.columns[:3]]
            if not len(batch):
                continue
            x = integers(_matrix(batch.column(2)), parts, scale)
            before = Assigned.read(batch.columns[3:], parts, entries) if started else None
            found, _ = assign(x, history, before, moved)
            _sums(x, found.code, entries, sums)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *found.columns(), pa.nulls(len(batch), _sum_type())], names
            )
        if sums:
            yield pa.RecordBatch.from_arrays(
                [*(pa.nulls(1, k) for k in kinds), *[pa.nulls(1, pa.binary())] * 5, pa.array([_limbs(sums)], _sum_type())], names
            )

    names = ["vec_id", "label", "embedding", "code", "upper", "upper_at", "lower", "lower_at", "sums"]
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names[:3])
    return in_small_batches(rows).mapInArrow(run, f"{kinds}, {_STATE}, {_SUMS}")


def _sum_type() -> pa.DataType:
    return pa.list_(pa.struct([("slot", pa.int32()), ("limb", pa.int32()), ("value", pa.int64())]))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _updated(book: np.ndarray, rows: DataFrame) -> np.ndarray:
    """The next codebook: means rounded down; an entry without a part stays. Only the sums
    of the codebook's own numbers come to the driver."""
    parts, entries, width = book.shape
    totals = {}
    for r in rows.select(F.inline("sums")).groupBy("slot", "limb").agg(F.sum("value").alias("value")).collect():
        totals[r["slot"]] = totals.get(r["slot"], 0) + (r["value"] << LIMB * r["limb"])
    new = book.astype(object)
    for p in range(parts):
        for k in range(entries):
            slot = (p * entries + k) * (width + 1)
            if slot in totals:
                for j in range(width):
                    new[p, k, j] = totals.get(slot + 1 + j, 0) // totals[slot]
    # Means lie between the vectors' components, so they fit where those did.
    largest = max(map(abs, new.ravel().tolist()), default=0)
    return new.astype(np.int64) if largest < _most(max(parts * width, 1)) else new


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, embedding`` of rows that have a vector of finite numbers."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select("vec_id", "label", "embedding").where(
        F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad
    )


def fit(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, list[np.ndarray]]:
    """``vec_id, label, embedding`` with the state of every vector after ``rounds``
    updates, and the codebooks of every round, the first ones included."""
    kept = usable(vectors)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    if not first:
        return kept, []
    dim = len(first[0]["embedding"])
    start = np.array([r["embedding"] for r in first if len(r["embedding"]) == dim], np.float64)
    history = [integers(start, parts, scale).transpose(1, 0, 2)]
    rows = kept.where(F.size("embedding") == dim)
    for _ in range(rounds):
        new = written(_round(rows, history, scale), "codes-round")
        history.append(_updated(history[-1], new.where("sums is not null")))
        if "code" in rows.columns:
            remove(state)
        state = new
        rows = new.where("sums is null").drop("sums")
    return rows, history


def text_of(book: np.ndarray) -> str:
    """Components of all entries as decimal numbers, by part, entry and position."""
    return ",".join(map(str, book.ravel().tolist()))


def encode(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256, label`` of every vector.

    Components become integers ``floor(scale * x)`` and vectors ``parts`` consecutive
    parts. A part position's codebook starts as the parts of the smallest vec_ids; a round
    gives every part its nearest entry and moves entries to the mean of their parts,
    rounded down. All numbers are whole, so results do not depend on how rows are dealt out.
    Between rounds the vectors with their bounds are a written table, the one before it is
    removed; the codebooks of all rounds travel with the task (see ``assign``).

    ``code`` has two hex digits for every part, ``error`` is the sum of the squared
    distances, ``label_error`` that of all vectors of the same label, NULLs together; a
    sum that no long holds is NULL. Vectors that are NULL, empty or hold a NULL or
    non-finite component are left out, and those of another length than that of the
    smallest vec_id. A length that ``parts`` does not divide is filled with zeros. Rows with
    equal ids are apart; a NULL id comes last. Fewer vectors than entries give fewer
    entries, an empty table no rows. Other columns are left out, whatever their names.
    """
    vec_id, label = (vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    rows, history = fit(vectors, parts, entries, rounds, scale)
    spark = vectors.sparkSession
    if not history:
        return spark.createDataFrame(
            [], f"vec_id {vec_id}, code string, error long, label_error long, codebooks_sha256 string, label {label}"
        )
    moved, size = displacements(history), history[-1].shape[1]
    started = "code" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = integers(_matrix(batch.column(2)), parts, scale) if len(batch) else None
            if x is None:
                continue
            before = Assigned.read(batch.columns[3:], parts, size) if started else None
            found, _ = assign(x, history, before, moved)
            x, book = _one_kind(x, history[-1])
            error = _squares(x, book[np.arange(parts), found.code]).sum(axis=1)
            error = [e if e < 1 << 63 else None for e in error.tolist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array([r.tobytes().hex() for r in found.code]), pa.array(error, pa.int64())],
                ["vec_id", "label", "code", "error"],
            )

    done = written(
        in_small_batches(rows).mapInArrow(run, f"vec_id {vec_id}, label {label}, code string, error long"), "codes"
    )
    sums = done.groupBy("label").agg(
        F.sum(F.col("error").cast("decimal(38,0)")).alias("_sum"), F.count("error").alias("_n"), F.count("*").alias("_all")
    )
    # A sum lacks nothing, or is NULL.
    sums = sums.select(
        F.col("label").alias("_label"), F.expr("CASE WHEN _n = _all THEN try_cast(_sum AS BIGINT) END").alias("label_error"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_part"),
    )
    salted = done.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code", "error"), F.lit(SALTS)).cast("int"))
    digest = hashlib.sha256(text_of(history[-1]).encode()).hexdigest()
    return salted.join(
        sums, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_salt") == F.col("_part")), "left"
    ).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"), "label")
