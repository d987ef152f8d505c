"""Exact quantiles of groups of any size.

``percentile`` keeps every distinct value of a group in one task. Here no task holds more
than ``ROWS`` values of a group at a time:

1. one aggregate gives every group's size, bounds and sum;
2. a group of at most ``ROWS`` values is one bin, sorted by itself;
3. a larger one is cut between its bounds into as many bins as its size asks for; bins are
   counted before the shuffle, and running counts show which hold the wanted ranks. Bins
   that are still large are cut again between their own bounds;
4. only the values of the bins that hold a wanted rank leave the source rows, equal ones
   counted first, and are ranked as a sorted stream.

Where bins are cut decides how evenly work is dealt out and nothing else: ranks come from
exact counts. The definition is linear interpolation between order statistics at
``(n - 1) * p`` (R's type 7, the SQL ``percentile_cont``).
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

#: Values of a group that one task sorts; the most bins of a cut, and cuts, of larger ones.
ROWS, BINS, CUTS = 1 << 16, 1 << 12, 2


def interval_probabilities(level: float) -> dict[str, float]:
    """Lower and upper probability of a central interval, 80 -> 0.1 and 0.9."""
    lower = round(0.5 - level / 200, 12)
    return {"Lo": lower, "Hi": round(1 - lower, 12)}


def _same(keys: Sequence[str], left: str, right: str) -> str:
    """NULL keys meet too."""
    return " AND ".join(f"{left}.{k} <=> {right}.{k}" for k in keys)


def _cut(groups: str, keys: Sequence[str], ranks: Sequence[str]) -> str:
    """The intervals of ``groups`` (``keys, _n, lo, hi, c, before``) cut into bins, those with
    a rank only, as the same columns: bounds, number of values in it, and before it."""
    by = ", ".join(keys)
    most = f"least({BINS}L, 2 * g.c div {ROWS} + 1)"
    # Halves, so that no difference is too large. All that is asked of it is that it does
    # not fall with the value; what is not a number goes to the first bin.
    share = "coalesce(nanvl(try_divide(r._v / 2 - g.lo / 2, g.hi / 2 - g.lo / 2), 0D), 0D)"
    bin_ = f"CASE WHEN g.c > {ROWS} THEN cast(floor(least(greatest({share}, 0D), 1D) * ({most} - 1)) AS BIGINT) ELSE 0L END"
    held = " OR ".join(f"(_upto - _c < {r} AND {r} <= _upto)" for r in ranks)
    return f"""
        SELECT {by}, _n, _lo AS lo, _hi AS hi, _c AS c, _upto - _c AS before
        FROM (
          SELECT *, before + sum(_c) OVER (PARTITION BY {by}, lo ORDER BY _bin) AS _upto
          FROM (
            SELECT {", ".join(f"r.{k}" for k in keys)}, g._n, g.lo, g.before, {bin_} AS _bin,
                   min(r._v) AS _lo, max(r._v) AS _hi, count(*) AS _c
            FROM _rows r JOIN {groups} g ON {_same(keys, "r", "g")} AND r._v >= g.lo AND r._v <= g.hi
            GROUP BY ALL))
        WHERE {held}"""


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    mean: str | None = None,
    na_rm: bool = False,
) -> DataFrame:
    """``keys`` + one column per entry of ``probs`` (+ the mean), one row per group. A group
    with a NULL value is NULL, unless ``na_rm``. Nothing is collected or written, and no job
    runs before the result is asked for.

    Groups of more than ``ROWS`` values are read again for every cut; where there are none,
    AQE leaves those steps out. A group that ``CUTS`` cuts do not bring down to ``ROWS``
    values a bin is still exact, its bin a longer stream."""
    names = [f"`{k}`" for k in keys] or ["_one"]
    by, columns = ", ".join(names), ", ".join(names) if keys else "1 AS _one"
    # Ranks wanted: two for every probability, the same one twice at the upper end.
    position = {name: f"((_n - 1) * {float(p)!r}D)" for name, p in probs.items()}
    ranks = [f"least(cast(floor({at}) AS BIGINT) + {up}, _n)" for at in position.values() for up in (1, 2)]
    out = [
        f"_x[{2 * i}] + ({at} - floor({at})) * (_x[{2 * i + 1}] - _x[{2 * i}]) AS `{name}`"
        for i, (name, at) in enumerate(position.items())
    ] + ([f"CASE WHEN _n > 0 THEN _sum / _n END AS `{mean}`"] if mean else [])
    if not na_rm:
        out = ["CASE WHEN _all = _n THEN {} END AS {}".format(*x.rsplit(" AS ", 1)) for x in out]
    cuts = [f"_cut{i + 1} AS ({_cut(f'_cut{i}', names, ranks)})," for i in range(CUTS)]
    picked = ", ".join(f"min(CASE WHEN _upto >= {r} THEN _v END)" for r in ranks)
    sorted_ = ", ".join(f"get(_s, cast({r} - 1 AS INT))" for r in ranks)
    # One statement, since every step of its own would analyse all before it again. Small
    # groups are not found by an anti join, which would be pushed below the aggregate that
    # makes the values, so that it would run a second time.
    return df.sparkSession.sql(
        f"""
        WITH _rows AS (SELECT {columns}, cast(`{value}` AS DOUBLE) AS _v FROM {{df}}),
        _large AS (
          SELECT {by}, count(_v) AS _n, count(*) AS _all, sum(_v) AS _sum, min(_v) AS _min, max(_v) AS _max
          FROM _rows GROUP BY {by} HAVING count(_v) > {ROWS}),
        _cut0 AS (SELECT {by}, _n, _min AS lo, _max AS hi, _n AS c, 0L AS before FROM _large),
        {"".join(cuts)}
        _held AS (
          SELECT {", ".join(f"r.{k}" for k in names)}, g._n, g.lo, g.before, r._v, count(*) AS _m
          FROM _rows r JOIN _cut{CUTS} g ON {_same(names, "r", "g")} AND r._v >= g.lo AND r._v <= g.hi GROUP BY ALL),
        _picked AS (
          SELECT {by}, array({picked}) AS _x
          FROM (SELECT *, before + sum(_m) OVER (PARTITION BY {by}, lo ORDER BY _v) AS _upto FROM _held) GROUP BY {by}),
        _found AS (
          SELECT {by}, _n, _all, _sum, array({sorted_}) AS _x
          FROM (
            SELECT {", ".join(f"r.{k}" for k in names)}, count(r._v) AS _n, count(*) AS _all, sum(r._v) AS _sum,
                   sort_array(collect_list(r._v)) AS _s
            FROM _rows r LEFT JOIN (SELECT {by}, 1 AS _is FROM _large) l ON {_same(names, "r", "l")}
            WHERE l._is IS NULL GROUP BY ALL)
          UNION ALL
          SELECT {", ".join(f"l.{k}" for k in names)}, l._n, l._all, l._sum, p._x
          FROM _large l JOIN _picked p ON {_same(names, "l", "p")})
        SELECT {", ".join([by] * bool(keys) + out)} FROM _found""",
        df=df,
    )
