"""Windows over one long time line without a single-task sort.

The line is cut into cells that hold a bounded number of rows on average. What a window needs from other cells are running sums and maxima of a small table of cells.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a cell, about.
CELL_ROWS = 20_000


def cell_length(rows: DataFrame, t: str, lengths: list[int]) -> int:
    """A length that divides all lengths, and of which a span holds about CELL_ROWS rows."""
    unit = math.gcd(*lengths)
    n, low, high = rows.agg(F.count(t), F.min(t), F.max(t)).first()
    wanted = max(1, ((high or 0) - (low or 0) + 1) * CELL_ROWS // max(1, n))
    parts = max(1, -(-unit // wanted))
    return unit // next((m for m in range(parts, min(4 * parts, unit) + 1) if unit % m == 0), 1)


def rolling(rows: DataFrame, t: str, features: dict[str, tuple[str, str | None, int]], keep: list[str]) -> DataFrame:
    """features: name -> (op, column, length): count, sum (of whole numbers) or max of the column over rows with t in [t - length, t), which excludes rows at t itself.

    Work is linear whatever the lengths. A count or sum is the difference of two running sums. A maximum spans two neighbouring stretches of its length: it is the
    larger of the first one's maximum from t - length on and of the second one's before t. Both are looked up at points of the line: inside the point's cell by a running
    window, beyond it in the table of cells. Counts and sums are 0 where nothing is, maxima null; rows without t are left out.
    """
    lengths = sorted({length for _, _, length in features.values()})
    cell_us = cell_length(rows, t, lengths)
    measures = {(op, column) for op, column, _ in features.values()}
    name = {m: f"m{k}" for k, m in enumerate(sorted(measures, key=str))}
    value = {"count": lambda c: F.count("*"), "sum": lambda c: F.sum(c), "max": lambda c: F.max(c)}
    times = rows.filter(F.col(t).isNotNull()).groupBy(F.col(t).alias("of")).agg(*(value[op](c).alias(name[op, c]) for op, c in name))
    nothing = [F.lit(0).cast("long").alias(n) if op != "max" else F.lit(None).cast(rows.schema[c].dataType).alias(n) for (op, c), n in name.items()]
    here = F.struct(F.lit(0).cast("long").alias("back"), *name.values())
    points = times.select("of", F.explode(F.array(here, *(F.struct(F.lit(x).cast("long").alias("back"), *nothing) for x in lengths))).alias("p")).select("of", "p.*")
    points = points.withColumn("x", F.col("of") - F.col("back")).withColumn("cell", F.floor(F.col("x") / F.lit(cell_us)).cast("long"))
    cells = points.groupBy("cell").agg(*((F.max(n) if op == "max" else F.sum(n)).alias(n) for (op, _), n in name.items()))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    line, outside, inside = Window.orderBy("cell"), [F.col("cell").alias("of_cell")], {}
    up, down = Window.partitionBy("cell").orderBy("x"), Window.partitionBy("cell").orderBy(F.desc("x"))
    for (op, c), n in name.items():
        if op != "max":
            outside.append(F.coalesce(F.sum(n).over(earlier(line)), F.lit(0)).alias(f"{n}_out"))
            inside[f"{n}_in"] = F.coalesce(F.sum(n).over(up.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
            continue
        inside[f"{n}_low"], inside[f"{n}_high"] = F.max(n).over(up.rangeBetween(Window.unboundedPreceding, -1)), F.max(n).over(down.rangeBetween(Window.unboundedPreceding, 0))
        for length in sorted({length for o, column, length in features.values() if (o, column) == (op, c)}):
            stretch = F.floor(F.col("cell") * F.lit(cell_us) / F.lit(length))
            outside.append(F.max(n).over(earlier(Window.partitionBy(stretch).orderBy("cell"))).alias(f"{n}_low_{length}"))
            outside.append(F.max(n).over(earlier(Window.partitionBy(stretch).orderBy(F.desc("cell")))).alias(f"{n}_high_{length}"))
    found = points.withColumns(inside).join(cells.select(*outside), F.col("cell") == F.col("of_cell"))
    at = lambda back, column: F.max(F.when(F.col("back") == back, column))
    out = {}
    for feature, (op, c, length) in features.items():
        n = name[op, c]
        if op != "max":
            total = F.col(f"{n}_in") + F.col(f"{n}_out")
            out[feature] = at(0, total) - at(length, total)
        else:
            out[feature] = F.greatest(at(0, F.greatest(f"{n}_low", f"{n}_low_{length}")), at(length, F.greatest(f"{n}_high", f"{n}_high_{length}")))
    found = found.groupBy("of").agg(*(v.alias(k) for k, v in out.items()))
    return rows.select(*dict.fromkeys([*keep, t])).join(found, F.col(t) == F.col("of")).select(*keep, *features)


def last_before(rows: DataFrame, t: str, reach: int) -> DataFrame:
    """rows with previous: the largest t strictly below, over the whole line. Blocks hand on their largest t through a small table of blocks."""
    blocked = rows.withColumn("block", F.floor(F.col(t) / F.lit(reach)).cast("long"))
    tops = blocked.groupBy("block").agg(F.max(t).alias("top"))
    before = tops.select("block", F.max("top").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("handed"))
    inside = F.max(t).over(Window.partitionBy("block").orderBy(t).rangeBetween(Window.unboundedPreceding, -1))
    return blocked.join(before, "block").withColumn("previous", F.coalesce(inside, F.col("handed"))).drop("block", "handed")


def interval_pairs(left: DataFrame, right: DataFrame, t: str, reach: int) -> DataFrame:
    """Pairs with |left.t - right.t| <= reach, by an equi-join on time cells; columns get the suffixes _l and _r."""
    cell = F.floor(F.col(t) / F.lit(max(1, reach))).cast("long")
    a = left.withColumn("cell", cell).toDF(*(f"{c}_l" for c in [*left.columns, "cell"]))
    near = F.explode(F.array(cell - 1, cell, cell + 1))
    b = right.withColumn("cell", near).toDF(*(f"{c}_r" for c in [*right.columns, "cell"]))
    same = (F.col("cell_l") == F.col("cell_r")) & (F.abs(F.col(f"{t}_l") - F.col(f"{t}_r")) <= reach)
    return a.join(b, same).drop("cell_l", "cell_r")
