"""Sums over all pairs of points, in blocks.

Points are dealt to blocks of about ``block`` rows; a task gets two blocks and works on their pairs with NumPy, so no
pair ever becomes a row. Data grow with n * n / block, work with n * n, memory with block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Kernel = Callable[[dict[str, np.ndarray], dict[str, np.ndarray]], dict[str, np.ndarray]]


def pair_rows(points: DataFrame, columns: Sequence[str], kernel: Kernel, schema: str, *, by: str | None = None, block: int = 2048) -> DataFrame:
    """The kernel's rows for every ordered pair of blocks (i, j), i <= j and both orders; with ``by``, pairs within a group only.

    The kernel gets the columns of both sides, as arrays, and returns columns; callers sum them.
    """
    rows = points.select(*([F.col(by).alias("_by")] if by else [F.lit(0).alias("_by")]), *columns)
    if by:
        sizes = rows.groupBy("_by").count().select("_by", F.ceil(F.col("count") / block).cast("int").alias("_n"))
        rows = rows.join(sizes, "_by")
    else:
        rows = rows.withColumn("_n", F.lit(max(1, math.ceil(points.count() / block))))
    rows = rows.withColumn("_own", F.pmod(F.xxhash64(*columns), F.col("_n")).cast("int"))
    dealt = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    dealt = dealt.withColumns({"_a": F.least("_own", "_other"), "_b": F.greatest("_own", "_other")})
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    names = arrow.names

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        own = table["_own"].to_numpy()
        data = {c: table[c].to_numpy() for c in columns}
        low, high = own == key[1].as_py(), own == key[2].as_py()
        sides = [({c: v[low] for c, v in data.items()}, {c: v[high] for c, v in data.items()})]
        if key[1] != key[2]:
            sides.append(sides[0][::-1])
        parts = [kernel(*s) for s in sides]
        out = {n: np.concatenate([np.atleast_1d(p[n]) for p in parts]) for n in names if n != "group_id"}
        size = len(next(iter(out.values())))
        return pa.table([pa.array([key[0].as_py()] * size if n == "group_id" else out[n], arrow.field(n).type) for n in names], schema=arrow)

    return dealt.groupBy("_by", "_a", "_b").applyInArrow(run, schema)


def distances(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> np.ndarray:
    return np.hypot(a["x"][:, None] - b["x"][None, :], a["y"][:, None] - b["y"][None, :])
