"""Best-fit packing of token sequences by a configuration linear program."""

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from agestrata.llm.store import in_small_batches, written

#: Rows of one length that one task ranks, on average.
RANKED = 50_000
#: Rounds of multiplicative weights, their step, and what counts as no demand.
ROUNDS, STEP, TINY = 300, 0.1, 1e-6

class _Encoder:
    """Ids of whole texts by a byte-level ``tokenizers`` file, as its library gives them
    without special tokens of its own: added tokens that stand in a text are found.

    Most texts go through tiktoken on the same vocabulary, whose ids are the ranks of the
    merges; it is four times as fast. Each task encodes its first texts, and its first with
    added tokens, by both libraries and stops if they differ. Texts with very long runs go
    to tokenizers alone, and so do those with added tokens that tiktoken cannot tell apart
    or that take in what stands around them.
    """

    CHECKED, LONG_RUN = 5, re.compile(r"\S{5000}|\s{5000}")

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        self.path, self._slow = path, None
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        added = {t["content"]: t for t in rules.get("added_tokens") or []}
        ranks = {
            bytes(map(_BYTE_OF.__getitem__, token)): i for token, i in rules["model"]["vocab"].items() if token not in added
        }
        self.fast = tiktoken.Encoding(
            "same", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
            special_tokens={content: t["id"] for content, t in added.items()},
        )
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        plain = not any(t[k] for t in added.values() for k in ("single_word", "lstrip", "rstrip", "normalized"))
        self.alike = plain and len(added) < 2
        self.unchecked = self.unchecked_added = self.CHECKED

    @property
    def slow(self):
        """The tokenizer itself; not kept once the first texts are checked, it is large."""
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
        return self._slow

    def _slowly(self, text: str) -> np.ndarray:
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")

    def __call__(self, text: str) -> np.ndarray:
        if len(text) >= 5000 and self.LONG_RUN.search(text):
            return self._slowly(text)
        holds = self.added.search(text) is not None
        if holds and not self.alike:
            return self._slowly(text)
        ids = self.fast.encode_to_numpy(text, allowed_special="all", disallowed_special=())
        if text and (self.unchecked or holds and self.unchecked_added):
            self.unchecked -= self.unchecked > 0
            self.unchecked_added -= holds and self.unchecked_added > 0
            if not np.array_equal(ids, self._slowly(text)):
                raise ValueError("the tokenizer file is not a byte-level BPE in order of its merges")
            if not self.unchecked:
                self._slow = None
        return ids


def _bytes_by_sign() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others
    as the code points from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


_BYTE_OF = _bytes_by_sign()


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` ids: all of ``most`` but for the first."""
    if n <= most:
        return [(0, n)]
    first = n % most or most
    return [(0, first)] + [(s, most) for s in range(first, n, most)]


def pieces(docs: DataFrame, tokenizer: str, most: int = 2048, end_id: int = 0) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` for every piece of every document: its
    ids, then ``end_id``. Documents of more than ``most`` ids are cut, others stay whole. A
    NULL text is empty, and an empty document is its end id alone. Repeated rows are
    documents of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _Encoder(tokenizer)
        for batch in batches:
            rows, which = [], []
            for i, text in enumerate(batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), most)):
                    which.append(i)
                    rows.append((k, start, length, zlib.crc32(ids[start : start + length])))
            k, start, length, crc = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(which, pa.int64())), pa.array(k, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_small_batches(docs.select("doc_id", "text")).mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


def _knapsack(profit: np.ndarray, most: int) -> np.ndarray:
    """For every capacity the length put in last by a best filling, each length usable
    again and again; 0 leaves one token empty. The longest of equals wins."""
    value, last = np.zeros(most + 1), np.zeros(most + 1, np.int64)
    for c in range(1, most + 1):
        options = value[:c] + profit[c:0:-1]
        best = int(options.argmax())
        if options[best] > value[c - 1]:
            value[c], last[c] = options[best], c - best
        else:
            value[c] = value[c - 1]
    return last


def _filled(capacity: int, last: np.ndarray) -> list[int]:
    out = []
    while capacity > 0:
        if last[capacity]:
            out.append(int(last[capacity]))
        capacity -= int(last[capacity]) or 1
    return out


def configurations(need: np.ndarray, most: int, rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """Approximate solution of the configuration program: how often each configuration is
    used so that length x is covered ``need[x]`` times.

    The price of a length starts at its share of a sequence, which is optimal while
    sequences can be filled. A round prices configurations by a knapsack over the
    capacities and takes, for the lengths covered least, the best configuration that holds
    them, as long as it shares no length with others of the round. Prices of the lengths
    it covers fall multiplicatively with the part of the demand met; a length that is
    covered has no price. Stops when all are covered, or after ``rounds``.
    """
    there = np.flatnonzero(need)
    need = need.astype(float)
    price, open_need, used = np.zeros(most + 1), need.copy(), Counter()
    price[there] = there / most
    for _ in range(rounds):
        wanted = there[open_need[there] > TINY]
        if not len(wanted):
            break
        last = _knapsack(np.where(open_need > TINY, price, 0.0), most)
        touched: set[int] = set()
        share = open_need[wanted] / need[wanted]
        for x in wanted[np.lexsort((-wanted, -share))].tolist():
            config = (x, *_filled(most - x, last))
            parts = Counter(config)
            if touched & parts.keys():
                continue
            touched |= parts.keys()
            amount = min(open_need[y] / k for y, k in parts.items())
            used[tuple(sorted(config, reverse=True))] += amount
            for y, k in parts.items():
                open_need[y] -= amount * k
                price[y] *= np.exp(-STEP * amount * k / need[y])
    return dict(used)


def _best_fit(left: np.ndarray, most: int) -> Counter:
    """Configurations for the rest, by decreasing length into the fullest sequence that has
    room. Works on groups of equal sequences, so its work does not grow with the counts."""
    bins: dict[int, Counter] = {}
    for x in np.flatnonzero(left)[::-1].tolist():
        n = int(left[x])
        for room in sorted(r for r in bins if r >= x):
            if not n:
                break
            for config in list(bins[room]):
                have, fit = bins[room][config], room // x
                if not n:
                    break
                full = min(have, n // fit)
                if full:
                    bins[room][config] -= full
                    bins.setdefault(room - fit * x, Counter())[config + (x,) * fit] += full
                    n -= full * fit
                if n and full < have and n < fit:
                    bins[room][config] -= 1
                    bins.setdefault(room - n * x, Counter())[config + (x,) * n] += 1
                    n = 0
                if not bins[room][config]:
                    del bins[room][config]
        fit = most // x
        if n // fit:
            bins.setdefault(most - fit * x, Counter())[(x,) * fit] += n // fit
        if n % fit:
            bins.setdefault(most - n % fit * x, Counter())[(x,) * (n % fit)] += 1
    out: Counter = Counter()
    for group in bins.values():
        out.update({c: k for c, k in group.items() if k})
    return out


def solve(counts: np.ndarray, most: int) -> Counter:
    """How many sequences of each configuration hold pieces of which ``counts[x]`` have
    length x: the program's solution rounded down, and best fit for what that leaves. If
    best fit alone needs fewer sequences, its answer is returned. The work depends on the
    histogram only, which has ``most`` entries at most."""
    left, out = counts.astype(np.int64).copy(), Counter()

    def use(config, k):
        parts = Counter(config)
        k = min([int(k), *(int(left[x]) // m for x, m in parts.items())])
        if k > 0:
            out[config] += k
            for x, m in parts.items():
                left[x] -= m * k

    solution = configurations(left, most)
    for config, amount in sorted(solution.items(), key=lambda x: (-x[1], x[0])):
        use(config, int(amount + TINY))
    out.update(_best_fit(left, most))
    plain = _best_fit(counts.astype(np.int64), most)
    return out if sum(out.values()) <= sum(plain.values()) else plain


def _slots(solution: Counter) -> dict[str, np.ndarray]:
    """The solution as ranges: pieces of a length, in order of rank, fill the places of
    that length in one configuration after another."""
    key, base, every, offset, seen, sequence = [], [], [], [], Counter(), 0
    for config, n in sorted(solution.items(), key=lambda x: (-len(x[0]), x[0])):
        at = 0
        for x, m in sorted(Counter(config).items(), reverse=True):
            key.append((x << 44) + seen[x])
            base.append(sequence)
            every.append(m)
            offset.append(at)
            seen[x] += m * n
            at += m * x
        sequence += n
    order = np.argsort(np.array(key, np.int64))
    made = {"key": key, "base": base, "every": every, "offset": offset}
    return {k: np.array(v, np.int64)[order] for k, v in made.items()}


def _ranked(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` with ``_rank``, their place from 0 among those of one length. A length may
    have most of the rows, so it is dealt out over salts, ranked in each, and moved by the
    number of rows in the salts before."""
    salts = max(16, n // RANKED)
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    each = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    counts = dealt.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = counts.withColumn(
        "_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")
    ).drop("_n")
    return (
        dealt.withColumn("_own", F.row_number().over(each) - 1)
        .join(before, ["length", "_salt"])
        .withColumn("_rank", F.col("_before") + F.col("_own"))
    )


def pack(docs: DataFrame, tokenizer: str, most: int = 2048, end_id: int = 0) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: every piece of every
    document and its place in one of as few sequences of ``most`` ids as are found.

    Pieces are tokenized once and stored without their ids. The driver gets the histogram
    of their lengths, at most ``most`` numbers, and sends back the configurations; each
    piece then finds its place by the rank among those of its length. Rows with NULL
    doc_id are packed like others. An empty table gives no rows.
    """
    rows = written(pieces(docs, tokenizer, most, end_id), "packing-pieces")
    counts = np.zeros(most + 1, np.int64)
    for r in rows.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    slots = _slots(solve(counts, most))
    shared = docs.sparkSession.sparkContext.broadcast(slots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for batch in batches:
            length = batch.column(3).to_numpy()
            at = (length << 44) + batch.column(5).to_numpy()
            i = np.searchsorted(s["key"], at, "right") - 1
            j = at - s["key"][i]
            sequence = s["base"][i] + j // s["every"][i]
            offset = s["offset"][i] + j % s["every"][i] * length
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                [*batch.schema.names[:5], "sequence_id", "offset"],
            )

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    shape = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in names)
    return (
        _ranked(rows, int(counts.sum()))
        .select(*names, F.col("_rank").cast("long"))
        .mapInArrow(place, f"{shape}, sequence_id long, offset long")
    )
