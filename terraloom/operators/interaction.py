"""Spatial interaction: constrained gravity flows and their calibration, on tables (o, d, weight or distance) with masses."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import exp_cost
from .runtime import cut


def _inverse(c: str) -> Column:
    """1 / c, and 0 where a zone reaches no mass."""
    return F.when(F.col(c) > 0, 1 / F.col(c)).otherwise(0.0)


def singly_constrained(pairs: DataFrame, origins: DataFrame, destinations: DataFrame, *, origin_constraint: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """Flows of pairs (o, d, w, ...) with masses (o, mass), (d, mass): each origin's mass spread by w * destination mass, or the mirror image.

    ``by`` adds key columns of the masses' own tables (a class); a mode column of the pairs shares its origin's denominator. The denominators come from
    an aggregation, so an origin's pairs needn't meet in one task.
    """
    side, other = ("o", "d") if origin_constraint else ("d", "o")
    full = pairs.join(origins.select(*by, "o", F.col("mass").alias("mo")), [*by, "o"]).join(destinations.select(*by, "d", F.col("mass").alias("md")), [*by, "d"])
    pull = F.col("w") * F.col(f"m{other}")
    total = full.groupBy(*by, side).agg(F.sum(pull).alias("total"))
    return full.join(total, [*by, side]).withColumn("flow", F.when(F.col("total") > 0, F.col(f"m{side}") * pull / F.col("total")).otherwise(0.0)).drop("mo", "md", "total")


def trip_length(flows: DataFrame, by: tuple[str, ...] = (), value: str = "flow") -> DataFrame:
    """Mean distance by flow."""
    return flows.groupBy(*by).agg((F.sum(F.col(value) * F.col("dist")) / F.sum(value)).alias("length"))


def fit_decay(pairs: DataFrame, origins: DataFrame, destinations: DataFrame, *, observed: str = "observed", start: float = 1.0, threshold: float = 0.01, rounds: int = 50, origin_constraint: bool = True, cost: Callable[[Column, float], Column] = exp_cost, by_mode: bool = False) -> dict[object, float]:
    """Decay parameters (one, or one a mode) at which modelled and observed mean trip lengths agree to ``threshold``: the converged ones.

    Each round is one aggregation over the checkpointed pairs; the driver sees one number a mode.
    """
    rows = cut(pairs.withColumn("mode", F.col("mode") if by_mode else F.lit("all")))
    want = {r["mode"]: r["length"] for r in trip_length(rows, ("mode",), observed).collect()}
    decay = {m: start for m in want}
    for _ in range(rounds):
        table = F.create_map(*[x for m, v in decay.items() for x in (F.lit(m), F.lit(v))])
        weighted = rows.withColumn("w", cost(F.col("dist"), F.element_at(table, F.col("mode"))))
        got = {r["mode"]: r["length"] for r in trip_length(singly_constrained(weighted, origins, destinations, origin_constraint=origin_constraint), ("mode",)).collect()}
        if all(abs(got[m] / want[m] - 1) <= threshold for m in want):
            break
        decay = {m: decay[m] * want[m] / got[m] if got[m] else decay[m] * 2 for m in want}
    else:
        warnings.warn(f"trip lengths differ by more than {threshold} after {rounds} rounds", stacklevel=2)
    return decay if by_mode else {"all": decay["all"]}


def doubly_constrained(pairs: DataFrame, origins: DataFrame, destinations: DataFrame, *, tolerance: float = 1e-6, rounds: int = 100, every: int = 5) -> DataFrame:
    """Flows (o, d, flow) with both margins met: balancing factors by iterative proportional fitting.

    Only the factors travel between rounds, one number an origin and a destination; the pairs table is read, never rewritten.
    """
    full = cut(pairs.select("o", "d", "w"))
    b = cut(destinations.select("d", F.col("mass").alias("md"), F.lit(1.0).alias("b")))
    a = None
    for k in range(rounds):
        reach = full.join(b, "d").groupBy("o").agg(F.sum(F.col("w") * F.col("b") * F.col("md")).alias("s"))
        a = cut(origins.join(reach, "o").select("o", F.col("mass").alias("mo"), _inverse("s").alias("a")))
        back = full.join(a, "o").groupBy("d").agg(F.sum(F.col("w") * F.col("a") * F.col("mo")).alias("s"))
        new = cut(b.join(back, "d").select("d", "md", _inverse("s").alias("b"), F.abs(F.col("b") * F.col("s") - 1).alias("gap")))
        gap = new.agg(F.max("gap")).first()[0]
        b = new.drop("gap")
        if gap is None or gap <= tolerance or math.isnan(gap):
            break
    else:
        warnings.warn(f"margins are off by {gap} after {rounds} rounds", stacklevel=2)
    return full.join(a, "o").join(b, "d").select("o", "d", (F.col("w") * F.col("a") * F.col("mo") * F.col("b") * F.col("md")).alias("flow"))


def unconstrained(pairs: DataFrame, origins: DataFrame, destinations: DataFrame) -> DataFrame:
    """Plain gravity flows: w times both masses."""
    full = pairs.join(origins.select("o", F.col("mass").alias("mo")), "o").join(destinations.select("d", F.col("mass").alias("md")), "d")
    return full.withColumn("flow", F.col("w") * F.col("mo") * F.col("md")).drop("mo", "md")


def as_links(flows: DataFrame, origins: DataFrame, destinations: DataFrame) -> DataFrame:
    """Flows as links with coordinates, from zones (o, x, y) and (d, x, y)."""
    a, b = origins.select("o", F.col("x").alias("x1"), F.col("y").alias("y1")), destinations.select("d", F.col("x").alias("x2"), F.col("y").alias("y2"))
    return flows.join(a, "o").join(b, "d")


def synthetic(fields_o: DataFrame, fields_d: DataFrame, decay: float) -> DataFrame:
    """Doubly constrained flows between two fields (id, x, y, mass) with exponential cost of distance. Zone tables are model inputs, a few thousand rows."""
    pairs = fields_o.select(F.col("id").alias("o"), "x", "y").crossJoin(fields_d.select(F.col("id").alias("d"), F.col("x").alias("x2"), F.col("y").alias("y2")))
    dist = F.sqrt(F.pow(F.col("x") - F.col("x2"), F.lit(2.0)) + F.pow(F.col("y") - F.col("y2"), F.lit(2.0)))
    weighted = pairs.select("o", "d", exp_cost(dist, decay).alias("w"))
    total = fields_o.agg(F.sum("mass")).first()[0] / fields_d.agg(F.sum("mass")).first()[0]
    return doubly_constrained(weighted, fields_o.select(F.col("id").alias("o"), "mass"), fields_d.select(F.col("id").alias("d"), (F.col("mass") * total).alias("mass")))
