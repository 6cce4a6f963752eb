"""Queries of grids, points and spatial joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as fn
from ..functions.columns import uniform_sql as u
from ..operators import generators, grid, points, spatial
from . import tables as t
from .registry import SQL, query, r

_D = "sqrt(CAST((a.i - b.i) * (a.i - b.i) + (a.j - b.j) * (a.j - b.j) AS DOUBLE))"


@query(f"WITH {t.BINARY} SELECT round(avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END), 6) density FROM bin")
def grid_density(spark: SparkSession, d: str) -> DataFrame:
    return grid.density(t.binary(spark, d)).select(r("density", "density"))


@query(f"""WITH {t.RASTER}, z AS (SELECT i, j, v - (SELECT avg(v) FROM raster) z FROM raster),
p AS (SELECT a.z * b.z / {_D} num, 1 / {_D} w FROM z a JOIN z b ON NOT (a.i = b.i AND a.j = b.j))
SELECT round((SELECT count(*) FROM raster) * sum(num) / (sum(w) * (SELECT sum(z * z) FROM z)), 6) moran FROM p""")
def grid_moran(spark: SparkSession, d: str) -> DataFrame:
    return grid.moran(t.raster(spark, d)).select(r("moran", "moran"))


@query(f"WITH {t.RASTER}, s AS (SELECT sum(v) total, count(*) n FROM raster) SELECT round(sqrt(pi() / max(n)) * sum({_D} * a.v * b.v) / (max(total) * max(total)), 6) distance FROM raster a CROSS JOIN raster b CROSS JOIN s")
def grid_mean_distance(spark: SparkSession, d: str) -> DataFrame:
    return grid.mean_distance(t.raster(spark, d)).select(r("distance", "distance"))


@query(f"WITH {t.RASTER}, s AS (SELECT sum(v) total, count(*) n FROM raster) SELECT round(-sum(CASE WHEN v > 0 THEN v / total * ln(v / total) ELSE 0 END) / ln(max(n)), 6) entropy FROM raster, s")
def grid_entropy(spark: SparkSession, d: str) -> DataFrame:
    return grid.entropy(t.raster(spark, d)).select(r("entropy", "entropy"))


@query(f"WITH {t.RASTER}, k AS (SELECT ln(v) y, ln(row_number() OVER (ORDER BY v DESC)) x FROM raster WHERE v > 0) SELECT round(regr_slope(y, x), 6) slope, round(regr_r2(y, x), 6) r2 FROM k")
def grid_slope(spark: SparkSession, d: str) -> DataFrame:
    return grid.slope(t.raster(spark, d)).select(r("slope", "slope"), r("r2", "r2"))


@query(f"""WITH {t.RASTER}, q AS (SELECT i, j, v / (SELECT sum(v) FROM raster) p FROM raster)
SELECT round(sum(a.p * b.p / {_D}) - 100.0 * sum(a.p * a.p * b.p * b.p / ({_D} * {_D})), 6) flows FROM q a JOIN q b ON NOT (a.i = b.i AND a.j = b.j)""")
def grid_congested_flow(spark: SparkSession, d: str) -> DataFrame:
    return grid.congested_flows(t.raster(spark, d), 100.0).select(r("flows", "flows"))


def _convolved(kernel: str, then: str = "sum(a.v * k.w)", base: str = "raster") -> str:
    return f", k(di, dj, w) AS (VALUES {kernel}) SELECT b.i, b.j, round({then}, 4) v FROM {base} b JOIN k ON TRUE LEFT JOIN {base} a ON a.i = b.i - di AND a.j = b.j - dj GROUP BY 1, 2"


_BLUR = [(a, b, 1.0 / (1 + abs(a) + abs(b))) for a in (-1, 0, 1) for b in (-1, 0, 1)]
_RING = [(a, b, 0.025) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]
_values = lambda kernel: ", ".join(f"({a}, {b}, CAST({w!r} AS DOUBLE))" for a, b, w in kernel)


@query(f"WITH {t.RASTER}" + _convolved(_values(_BLUR), "sum(coalesce(a.v, 0) * k.w)"))
def grid_convolution3(spark: SparkSession, d: str) -> DataFrame:
    return grid.convolve(t.raster(spark, d), _BLUR).select("i", "j", r("v", "v", 4))


@query(f"WITH {t.RASTER}" + _convolved(_values([(0, 0, 0.8), *_RING]), "sum(coalesce(a.v, 0) * k.w)"))
def grid_diffusion(spark: SparkSession, d: str) -> DataFrame:
    return grid.diffuse(t.raster(spark, d), 0.2).select("i", "j", r("v", "v", 4))


_CROSS = _values([(a, b, 1.0) for a, b in grid.CROSS])


@query(f"WITH {t.BINARY}" + _convolved(_CROSS, "CASE WHEN sum(coalesce(a.v, 0)) > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END", "bin"))
def grid_dilation(spark: SparkSession, d: str) -> DataFrame:
    return grid.dilation(t.binary(spark, d)).select("i", "j", r("v", "v", 4))


@query(f"WITH {t.BINARY}" + _convolved(_CROSS, "CASE WHEN sum(coalesce(a.v, 0)) = 5 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END", "bin"))
def grid_erosion(spark: SparkSession, d: str) -> DataFrame:
    return grid.erosion(t.binary(spark, d)).select("i", "j", r("v", "v", 4))


@query("WITH RECURSIVE " + t.BINARY + """, s AS (SELECT i, j, i * 100 + j id FROM bin WHERE v > 0),
f AS (SELECT i, j, i * 100 + j id FROM bin WHERE v = 0),
reach(id, i, j, root) AS (SELECT id, i, j, id FROM s UNION SELECT s.id, s.i, s.j, least(r.root, s.id) FROM reach r JOIN s ON abs(r.i - s.i) + abs(r.j - s.j) = 1),
free(id, i, j, root) AS (SELECT id, i, j, id FROM f UNION SELECT f.id, f.i, f.j, least(r.root, f.id) FROM free r JOIN f ON abs(r.i - f.i) + abs(r.j - f.j) = 1),
c AS (SELECT id, min(root) root FROM reach GROUP BY 1), e AS (SELECT id, min(root) root FROM free GROUP BY 1)
SELECT CAST((SELECT count(DISTINCT root) FROM c) AS DOUBLE) components, round((SELECT count(*) / count(DISTINCT root) FROM c), 6) block_area, round((SELECT count(*) / count(DISTINCT root) FROM e), 6) component_area""")
def grid_components(spark: SparkSession, d: str) -> DataFrame:
    return grid.components(t.binary(spark, d)).select("components", r("block_area", "block_area"), r("component_area", "component_area"))


@query(f"""WITH {t.BINARY}, out AS (SELECT i, j FROM (SELECT unnest(generate_series(0, 51)) i) CROSS JOIN (SELECT unnest(generate_series(-1, 11)) j)),
gap AS (SELECT o.i, o.j FROM out o LEFT JOIN bin b ON o.i = b.i AND o.j = b.j WHERE coalesce(b.v, 0) = 0),
a AS (SELECT max(m) dil FROM (SELECT min(abs(x.i - y.i) + abs(x.j - y.j)) m FROM bin x JOIN bin y ON y.v > 0 GROUP BY x.i, x.j)),
b AS (SELECT max(m) ero FROM (SELECT min(abs(x.i - y.i) + abs(x.j - y.j)) m FROM bin x JOIN gap y ON x.v > 0 GROUP BY x.i, x.j))
SELECT CAST(greatest(1, dil) AS DOUBLE) dilation_steps, CAST(greatest(1, ero) AS DOUBLE) erosion_steps FROM a, b""")
def grid_steps(spark: SparkSession, d: str) -> DataFrame:
    return grid.per_grid(t.binary(spark, d), lambda a: grid.steps(a > 0), "dilation_steps double, erosion_steps double, closing_steps double, opening_steps double").select("dilation_steps", "erosion_steps")


@query(f"""WITH {t.BINARY}, k(k) AS (VALUES (1), (2), (4), (8)), n AS (SELECT k, count(DISTINCT CAST(floor(i / k) AS INT) * 1000 + CAST(floor(j / k) AS INT)) n FROM bin, k WHERE v > 0 GROUP BY 1)
SELECT round(regr_slope(ln(n), ln(1.0 / k)), 6) dimension, round(regr_r2(ln(n), ln(1.0 / k)), 6) r2 FROM n""")
def box_counting(spark: SparkSession, d: str) -> DataFrame:
    return grid.fractal_dimension(t.binary(spark, d)).select(r("dimension", "dimension"), r("r2", "r2"))


@query(f"WITH {t.RASTER} SELECT i + 0.5 x, j + 0.5 y, v FROM raster WHERE i BETWEEN 10 AND 20 AND j BETWEEN 2 AND 6")
def grid_cropped_points(spark: SparkSession, d: str) -> DataFrame:
    return grid.as_points(grid.crop(t.raster(spark, d), 10, 20, 2, 6)).select("x", "y", "v")


@query(f"WITH {t.BINARY}, l AS (SELECT i, string_agg(CASE WHEN v > 0 THEN '+' ELSE '0' END, '' ORDER BY j) line FROM bin GROUP BY 1) SELECT string_agg(line, chr(10) ORDER BY i) AS text FROM l")
def grid_text(spark: SparkSession, d: str) -> DataFrame:
    return grid.to_text(t.binary(spark, d)).select("text")


@query(f"WITH {t.BINARY}, s AS (SELECT i, j FROM bin WHERE v > 0) SELECT a.i ai, a.j aj, b.i bi, b.j bj FROM s a JOIN s b ON (b.i = a.i + 1 AND b.j = a.j) OR (b.i = a.i AND b.j = a.j + 1)")
def grid_links(spark: SparkSession, d: str) -> DataFrame:
    return grid.to_links(t.binary(spark, d)).select(F.col("src.i").alias("ai"), F.col("src.j").alias("aj"), F.col("dst.i").alias("bi"), F.col("dst.j").alias("bj"))






_PD = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"


@query(f"""WITH {t.POINTS}, z AS (SELECT id, x, y, v - (SELECT avg(v) FROM points) z FROM points), p AS (SELECT a.z * b.z / {_PD} num, 1 / {_PD} w FROM z a JOIN z b ON {_PD} > 0)
SELECT round((SELECT count(*) FROM points) * sum(num) / (sum(w) * (SELECT sum(z * z) FROM z)), 6) moran FROM p""")
def points_moran(spark: SparkSession, d: str) -> DataFrame:
    return points.moran(t.points(spark, d)).select(r("moran", "moran"))


@query(f"WITH {t.POINTS} SELECT round(sum(a.v * b.v * {_PD}) / (max({_PD}) * (SELECT sum(v) * sum(v) FROM points)), 6) average_distance FROM points a CROSS JOIN points b")
def points_avg_distance(spark: SparkSession, d: str) -> DataFrame:
    return points.average_distance(t.points(spark, d)).select(r("average_distance", "average_distance"))


@query(f"""WITH {t.POINTS}, p AS (SELECT {_PD} d FROM points a CROSS JOIN points b), m AS (SELECT max(d) far, (SELECT count(*) FROM points) n FROM p), k AS (SELECT unnest(generate_series(0, 50)) k)
SELECT round(k / 50.0, 2) r, round(sum(CASE WHEN d <= far * k / 50.0 + 1e-12 THEN 1.0 ELSE 0.0 END) / max(n * (n - 1)), 6) share FROM k, p, m GROUP BY k""")
def points_ripley(spark: SparkSession, d: str) -> DataFrame:
    return points.ripley(t.points(spark, d), area=1.0).select(F.round("r", 2).alias("r"), r("share", "share"))


@query(f"WITH {t.POINTS} SELECT round(sqrt(1.0 / 9 - (SELECT sum((1 - x * x) * (1 - y * y)) / (2 * count(*)) FROM points) + sum((1 - greatest(a.x, b.x)) * (1 - greatest(a.y, b.y))) / max(n.n * n.n)), 6) discrepancy FROM points a CROSS JOIN points b CROSS JOIN (SELECT count(*) n FROM points) n")
def points_discrepancy(spark: SparkSession, d: str) -> DataFrame:
    return points.discrepancy(t.points(spark, d)).select(r("discrepancy", "discrepancy"))


@query(f"""WITH {t.POINTS}, b AS (SELECT avg(x) cx, avg(y) cy, max(x) - min(x) rx, max(y) - min(y) ry, sum(v) t FROM points)
SELECT round(sum((x - cx) / rx * (y - cy) / ry * v / t), 6) m11, round(sum(power((x - cx) / rx, 2) * v / t), 6) m20 FROM points, b""")
def spatial_moments(spark: SparkSession, d: str) -> DataFrame:
    p = t.points(spark, d)
    return points.spatial_moment(p, 1, 1).select(r("moment", "m11")).crossJoin(points.spatial_moment(p, 2, 0).select(r("moment", "m20")))


@query(f"""WITH {t.POINTS}, {t.ZONES}, k AS (SELECT points.id, city, sqrt((points.x - zones.x) * (points.x - zones.x) + (points.y - zones.y) * (points.y - zones.y)) d FROM points CROSS JOIN zones)
SELECT id, arg_min(city, (d, city)) nearest, round(min(d), 6) distance FROM k GROUP BY 1""")
def points_nearest(spark: SparkSession, d: str) -> DataFrame:
    return points.nearest(t.points(spark, d), t.zones(spark, d).withColumnRenamed("city", "id")).select("id", "nearest", r("distance", "distance"))


@query(f"WITH {t.POINTS} SELECT a.id a, b.id b, round({_PD}, 6) distance FROM points a JOIN points b ON {_PD} <= 0.08")
def points_within(spark: SparkSession, d: str) -> DataFrame:
    p = t.points(spark, d)
    return spatial.within_radius(p, p, 0.08).select("a", "b", r("distance", "distance"))


@query(f"""WITH {t.POINTS}, w AS (SELECT a.id, exp(-0.5 * power({_PD} / 0.2, 2)) w, b.x vx, b.v vy FROM points a CROSS JOIN points b),
s AS (SELECT id, sum(w) sw, sum(w * vx) sx, sum(w * vy) sy, sum(w * vx * vx) sxx, sum(w * vx * vy) sxy FROM w GROUP BY 1)
SELECT id, round((sw * sxy - sx * sy) / (sw * sxx - sx * sx), 2) slope FROM s""")
def points_gwr(spark: SparkSession, d: str) -> DataFrame:
    rows = t.points(spark, d).withColumn("vx", F.col("x"))
    return points.weighted_regression(rows.select("id", "x", "y", F.col("x").alias("u"), "v"), "u", "v", 0.2).select("id", r("slope", "slope", 2))


@query(f"""WITH {t.POINTS}, p AS (SELECT x + {u(24, "id")} / 20 x, y + {u(25, "id")} / 20 y FROM points), e AS (SELECT a.x x1, a.y y1, b.x x2, b.y y2, a.x * b.y - b.x * a.y c FROM p a JOIN p b ON a.x <> b.x OR a.y <> b.y
WHERE NOT EXISTS (SELECT 1 FROM p q WHERE NOT (q.x = a.x AND q.y = a.y) AND NOT (q.x = b.x AND q.y = b.y) AND ((b.x - a.x) * (q.y - a.y) - (b.y - a.y) * (q.x - a.x) < 0 OR ((b.x - a.x) * (q.y - a.y) = (b.y - a.y) * (q.x - a.x) AND (q.x - a.x) * (q.x - b.x) + (q.y - a.y) * (q.y - b.y) > 0))))
SELECT round(sum(c) / 2, 6) area, round(sum((x1 + x2) * c) / (3 * sum(c)), 6) cx, round(sum((y1 + y2) * c) / (3 * sum(c)), 6) cy FROM e""")
def points_hull(spark: SparkSession, d: str) -> DataFrame:
    moved = t.points(spark, d).withColumns({"x": F.col("x") + fn.uniform(24, "id") / 20, "y": F.col("y") + fn.uniform(25, "id") / 20})  # no three in a line
    return points.hull(moved).select(r("area", "area"), r("cx", "cx"), r("cy", "cy"))


_MOMENTS = ((0, 1), (1, 0), (1, 1), (2, 0), (0, 2))


@query(f"""WITH {t.POINTS}, mo AS (SELECT avg(v) m1, avg(v * v) m2, avg(power(v, 3)) m3, avg(power(v, 4)) m4, stddev_pop(v) std FROM points),
en AS (SELECT (ln(sum(v)) - sum(CASE WHEN v > 0 THEN v * ln(v) ELSE 0 END) / sum(v)) / ln(count(*)) entropy FROM points),
k AS (SELECT ln(v) y, ln(row_number() OVER (ORDER BY v DESC)) x FROM points WHERE v > 0), rs AS (SELECT regr_slope(y, x) slope, regr_r2(y, x) r2 FROM k),
z AS (SELECT id, x, y, v - (SELECT avg(v) FROM points) z FROM points), p AS (SELECT a.z * b.z / {_PD} num, 1 / {_PD} w FROM z a JOIN z b ON {_PD} > 0),
mi AS (SELECT (SELECT count(*) FROM points) * sum(num) / (sum(w) * (SELECT sum(z * z) FROM z)) moran FROM p),
ad AS (SELECT sum(a.v * b.v * {_PD}) / (max({_PD}) * (SELECT sum(v) * sum(v) FROM points)) average_distance FROM points a CROSS JOIN points b),
b AS (SELECT avg(x) cx, avg(y) cy, max(x) - min(x) rx, max(y) - min(y) ry, sum(v) t FROM points),
sm AS (SELECT {", ".join(f"round(sum(power((x - cx) / rx, {p}) * power((y - cy) / ry, {q}) * v / t), 6) moment_{p}{q}" for p, q in _MOMENTS)} FROM points, b)
SELECT round(m1, 3) m1, round(m2 / 1e6, 6) m2, round(m3 / 1e9, 6) m3, round(m4 / 1e12, 6) m4, round(std, 3) std, round(entropy, 6) entropy, round(slope, 6) slope, round(r2, 6) r2, round(moran, 6) moran, round(average_distance, 6) average_distance, sm.*
FROM mo, en, rs, mi, ad, sm""")
def points_summary(spark: SparkSession, d: str) -> DataFrame:
    """All statistics of a field; the higher moments in millions, billions and so on."""
    found = points.summary(t.points(spark, d))
    scaled = [r(F.col(f"m{k}") / 1000.0**k, f"m{k}") for k in (2, 3, 4)]
    return found.select(r("m1", "m1", 3), *scaled, r("std", "std", 3), *[r(c, c) for c in ("entropy", "slope", "r2", "moran", "average_distance")], *[r(f"moment_{p}{q}", f"moment_{p}{q}") for p, q in _MOMENTS])


def _boxes(spark: SparkSession, d: str, size: float) -> DataFrame:
    rows = t.zones(spark, d).select(F.col("city").alias("id"), "x", "y")
    p = lambda a, b: F.struct((F.col("x") + a * size).alias("x"), (F.col("y") + b * size).alias("y"))
    return rows.select("id", F.array(p(0, 0), p(1, 0), p(1, 1), p(0, 1), p(0, 0)).alias("ring"))


@query(f"WITH {t.POINTS}, {t.ZONES} SELECT id point, city polygon FROM points JOIN zones ON points.x > zones.x + 0.0003 AND points.x < zones.x + 0.2003 AND points.y > zones.y + 0.0003 AND points.y < zones.y + 0.2003")
def points_in_boxes(spark: SparkSession, d: str) -> DataFrame:
    moved = _boxes(spark, d, 0.2).select("id", F.transform("ring", lambda p: F.struct((p["x"] + 0.0003).alias("x"), (p["y"] + 0.0003).alias("y"))).alias("ring"))
    return spatial.points_in_polygons(t.points(spark, d), moved, 0.05)


@query(f"WITH {t.ZONES} SELECT a.city a, b.city b FROM zones a JOIN zones b ON a.city < b.city AND abs(a.x - b.x) <= 0.2 + 1e-9 AND abs(a.y - b.y) <= 0.2 + 1e-9 WHERE abs(abs(a.x - b.x) - 0.2) > 1e-6 AND abs(abs(a.y - b.y) - 0.2) > 1e-6")
def boxes_overlapping(spark: SparkSession, d: str) -> DataFrame:
    b = _boxes(spark, d, 0.2)
    found = spatial.boxes_overlapping(b, b, 0.1).where("a < b")
    z = t.zones(spark, d)
    at = lambda c: z.select(F.col("city").alias(c), F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y"))
    clear = (F.abs(F.abs(F.col("ax") - F.col("bx")) - 0.2) > 1e-6) & (F.abs(F.abs(F.col("ay") - F.col("by")) - 0.2) > 1e-6)
    return found.join(at("a"), "a").join(at("b"), "b").where(clear).select("a", "b")


@query(f"""WITH {t.ZONES}, c AS (SELECT city id, greatest(0, least(x + 0.3, 0.75) - greatest(x, 0.25)) * greatest(0, least(y + 0.3, 0.75) - greatest(y, 0.25)) area FROM zones)
SELECT id, round(area, 6) area FROM c WHERE area > 1e-9""")
def boxes_clipped(spark: SparkSession, d: str) -> DataFrame:
    return spatial.polygons_in_box(_boxes(spark, d, 0.3), 0.25, 0.25, 0.75, 0.75).where("area > 1e-9").select("id", r("area", "area"))


@query(f"WITH {t.ZONES} SELECT round(min(x), 6) xmin, round(min(y), 6) ymin, round(max(x) + 0.3, 6) xmax, round(max(y) + 0.3, 6) ymax FROM zones")
def boxes_envelope(spark: SparkSession, d: str) -> DataFrame:
    return spatial.envelope(_boxes(spark, d, 0.3)).select(*[r(c, c) for c in ("xmin", "ymin", "xmax", "ymax")])


@query(f"""WITH {t.POINTS}, p AS (SELECT id, x px, y py, 0.1 x1, 0.2 y1, 0.9 x2, 0.6 y2 FROM points), q AS (SELECT *, greatest(0, least(1, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) t FROM p)
SELECT id, round(x1 + t * (x2 - x1), 6) x, round(y1 + t * (y2 - y1), 6) y FROM q""")
def point_projection(spark: SparkSession, d: str) -> DataFrame:
    x, y = fn.project_on_segment(F.col("x"), F.col("y"), *map(F.lit, (0.1, 0.2, 0.9, 0.6)))
    return t.points(spark, d).select("id", r(x, "x"), r(y, "y"))


@query("SELECT k AS id, round(CAST(k // 4 AS DOUBLE) * 0.25, 6) x0, round(CAST(k % 4 AS DOUBLE) * 0.25, 6) y0, 0.0625 area FROM (SELECT unnest(generate_series(0, 15)) k)")
def polygons_grid(spark: SparkSession, d: str) -> DataFrame:
    made = generators.grid_polygons(spark, 0, 1, 0, 1, 4, 4)
    return made.select("id", r(F.get("ring", F.lit(0))["x"], "x0"), r(F.get("ring", F.lit(0))["y"], "y0"), r(fn.ring_area(F.col("ring")), "area"))


@query("""WITH c AS (SELECT i, j FROM (SELECT CAST(unnest(generate_series(0, 29)) AS INT) i) CROSS JOIN (SELECT CAST(unnest(generate_series(0, 29)) AS INT) j))
SELECT i, j, round(exp(-sqrt(CAST((i - 5) * (i - 5) + (j - 5) * (j - 5) AS DOUBLE)) / 4) + exp(-sqrt(CAST((i - 20) * (i - 20) + (j - 12) * (j - 12) AS DOUBLE)) / 4), 6) v FROM c""")
def generated_mixture(spark: SparkSession, d: str) -> DataFrame:
    return generators.mixture_grid(spark, 30, 30, [(5, 5), (20, 12)], 4.0).select("i", "j", r("v", "v"))


@query("SELECT k AS rank, round(1000 * power(CAST(k AS DOUBLE), -0.9), 6) v FROM (SELECT unnest(generate_series(1, 200)) k)")
def rank_size_law(spark: SparkSession, d: str) -> DataFrame:
    return generators.rank_size_values(spark, 200, 0.9, 1000).select("rank", r("v", "v"))


@query(f"SELECT grid_id, i, j, CASE WHEN {u(1, 'grid_id', 'i', 'j')} < 0.3 THEN 1.0 ELSE 0.0 END v FROM (SELECT CAST(unnest(generate_series(0, 19)) AS INT) i), (SELECT CAST(unnest(generate_series(0, 19)) AS INT) j), (SELECT CAST(unnest(generate_series(0, 2)) AS INT) grid_id)")
def generated_random(spark: SparkSession, d: str) -> DataFrame:
    return generators.random_grid(spark, 20, 20, occupied=0.3, samples=3, seed=1)


@query(f"""WITH b AS (SELECT CAST(unnest(generate_series(0, 4)) AS INT) block), d AS (SELECT CAST(floor({u(2, "0", "block", "'i'")} * 50) AS INT) i0, CAST(floor({u(2, "0", "block", "'j'")} * 50) AS INT) j0,
CAST(floor({u(2, "0", "block", "'h'")} * 6) AS INT) + 5 h, CAST(floor({u(2, "0", "block", "'w'")} * 6) AS INT) + 5 w FROM b), c AS (SELECT i, j FROM (SELECT CAST(unnest(generate_series(0, 49)) AS INT) i), (SELECT CAST(unnest(generate_series(0, 49)) AS INT) j))
SELECT 0 grid_id, i, j, CAST((SELECT count(*) FROM d WHERE i BETWEEN i0 - h // 2 AND i0 - h // 2 + h - 1 AND j BETWEEN j0 - w // 2 AND j0 - w // 2 + w - 1) AS DOUBLE) v FROM c""")
def generated_blocks(spark: SparkSession, d: str) -> DataFrame:
    return generators.blocks_grid(spark, 50, 50, 5, 5, 10, seed=2)


@query()
def generated_reaction_diffusion(spark: SparkSession, d: str) -> DataFrame:
    return generators.reaction_diffusion_grid(spark, 30, 50, 1000, 1.1, 0.05, samples=2, seed=3)


@query()
def generated_gravity(spark: SparkSession, d: str) -> DataFrame:
    return generators.gravity_grid(spark, 30, 0.2, 1.5, 1.0, 3, 200, samples=2, seed=4)


@query()
def generated_correlated(spark: SparkSession, d: str) -> DataFrame:
    return generators.correlated_grid(spark, 30, 3.0, 0.4, samples=2, seed=5)


@query()
def generated_percolation(spark: SparkSession, d: str) -> DataFrame:
    return generators.percolation_grid(spark, 20, 0.4, seed=6)


@query(f"""WITH c AS (SELECT i, j, 2 * exp(-sqrt(CAST((i - 5) * (i - 5) + (j - 5) * (j - 5) AS DOUBLE)) / 3) m FROM (SELECT CAST(unnest(generate_series(0, 9)) AS INT) i), (SELECT CAST(unnest(generate_series(0, 9)) AS INT) j)),
p AS (SELECT i, j, k, sum(exp(-m) * power(m, k) / gamma(k + 1)) OVER (PARTITION BY i, j ORDER BY k) f, {u(7, "i", "j")} u FROM c, (SELECT unnest(generate_series(0, 30)) k)),
n AS (SELECT i, j, count(*) FILTER (u >= f) n FROM p GROUP BY 1, 2), q AS (SELECT i, j, CAST(unnest(generate_series(1, n)) AS INT) k FROM n)
SELECT round(i + {u(7, "i", "j", "k", "'x'")}, 6) x, round(j + {u(7, "i", "j", "k", "'y'")}, 6) y FROM q""")
def generated_points(spark: SparkSession, d: str) -> DataFrame:
    return generators.field_points(generators.mixture_grid(spark, 10, 10, [(5, 5)], 3.0, 2.0), seed=7).select(r("x", "x"), r("y", "y"))


@query(f"""WITH k AS (SELECT c_custkey k, c_acctbal w, sum(c_acctbal) OVER (ORDER BY c_custkey) high FROM customer WHERE c_acctbal > 0), t AS (SELECT sum(w) total FROM k),
d AS (SELECT draw, {u(8, "draw")} * total u FROM (SELECT unnest(generate_series(0, 499)) draw), t) SELECT draw, k "key" FROM d JOIN k ON u >= high - w AND u < high""")
def sampled_customers(spark: SparkSession, d: str) -> DataFrame:
    rows = t.table(spark, d, "customer").where("c_acctbal > 0")
    return generators.sample_with_replacement(rows, 500, "c_custkey", "c_acctbal", seed=8)


@query(f"SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 0 ORDER BY -ln(1 - {u(9, 'o_orderkey')}) / o_totalprice, o_orderkey LIMIT 100")
def sampled_orders(spark: SparkSession, d: str) -> DataFrame:
    return generators.sample_without_replacement(t.table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 100, ["o_orderkey"], "o_totalprice", seed=9)


@query(SQL["grid_moran"])
def grid_moran_spread(spark: SparkSession, d: str) -> DataFrame:
    """Moran's I of one grid spread over many tasks."""
    return grid.moran_of_large(t.raster(spark, d)).select(r("moran", "moran"))


@query(SQL["grid_mean_distance"])
def grid_mean_distance_spread(spark: SparkSession, d: str) -> DataFrame:
    return grid.mean_distance_of_large(t.raster(spark, d)).select(r("distance", "distance"))


_TOUCH = """on_ AS (SELECT i * 100 + j id, i, j FROM bin WHERE v > 0), ways AS (SELECT a.id a, b.id b FROM on_ a JOIN on_ b ON abs(a.i - b.i) + abs(a.j - b.j) = 1),
walk(id, root) AS (SELECT id, id FROM on_ UNION SELECT b, root FROM walk JOIN ways ON id = a), comp AS (SELECT id, min(root) c FROM walk GROUP BY 1), sizes AS (SELECT c, count(*) n FROM comp GROUP BY 1)"""


@query(f"WITH RECURSIVE {t.BINARY.strip()}, {_TOUCH} SELECT CAST(count(*) AS DOUBLE) components, round(avg(n), 6) block_area FROM sizes")
def grid_components_spread(spark: SparkSession, d: str) -> DataFrame:
    return grid.components_of_large(t.binary(spark, d)).select("components", r("block_area", "block_area"))


@query(f"""WITH {t.RASTER}, k AS (SELECT unnest(generate_series(1, 20)) k), n AS (SELECT v, row_number() OVER (ORDER BY v DESC) r, count(*) OVER () n FROM raster),
lim AS (SELECT k, min(v) FILTER (r <= ceil(n * k / 20.0)) low FROM n, k GROUP BY 1), c AS (SELECT k, i, j, CASE WHEN v >= low THEN v ELSE 0 END v FROM raster, lim),
d AS (SELECT a.k, sum({_D} * a.v * b.v) / power(any_value(s), 2) d FROM c a JOIN c b ON a.k = b.k JOIN (SELECT k, sum(v) s FROM c GROUP BY 1) s ON s.k = a.k GROUP BY 1),
q AS (SELECT k, d / (SELECT d FROM d WHERE k = 20) q FROM d) SELECT round(sum(q + coalesce(p, 0)) / 40, 6) acentrism FROM (SELECT q, lag(q) OVER (ORDER BY k) p FROM q)""")
def grid_acentrism(spark: SparkSession, d: str) -> DataFrame:
    return grid.acentrism(t.raster(spark, d)).select(r("acentrism", "acentrism"))


@query(f"""WITH RECURSIVE {t.BINARY.strip()}, {_TOUCH}, z AS (SELECT i, j, v - (SELECT avg(v) FROM bin) z FROM bin),
p AS (SELECT a.z * b.z / {_D} num, 1 / {_D} w FROM z a JOIN z b ON NOT (a.i = b.i AND a.j = b.j)), t AS (SELECT sum(v) total, count(*) n FROM bin)
SELECT 50.0 height, 11.0 width, (SELECT total FROM t) area, (SELECT round(avg(v), 6) FROM bin) density, (SELECT CAST(count(*) AS DOUBLE) FROM sizes) components, (SELECT round(avg(n), 6) FROM sizes) block_area,
(SELECT round((SELECT n FROM t) * sum(num) / (sum(w) * (SELECT sum(z * z) FROM z)), 6) FROM p) moran, (SELECT round(sqrt(pi() / max(n)) * sum({_D} * a.v * b.v) / (max(total) * max(total)), 6) FROM bin a CROSS JOIN bin b CROSS JOIN t) distance""")
def grid_morphology(spark: SparkSession, d: str) -> DataFrame:
    """Indicators of a built-up raster; those of dilation and erosion have queries of their own."""
    names = ("height", "width", "area", "density", "components", "block_area", "moran", "distance")
    return grid.morphology(t.binary(spark, d)).select(*[r(c, c) for c in names])
