"""Queries of filters, masks, components, morphology, distances and tracing."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions.coords import AXES, dense_grid
from ..operators import aggregate as A
from ..operators import segment as P
from ..operators import volume as V
from ..operators.distances import FAR
from ..sources.volumes import grid_sql, read_table, vox, vox_sql
from .register import query

D = 16
DIMS = (D, D, D)
EDGE = 8  # of tiles, so that a small volume has several
DENSE = f"vox AS ({vox_sql(D)}), g AS ({grid_sql(D, D, D)}), dense AS (SELECT z, y, x, coalesce(v, 0) AS v FROM g LEFT JOIN vox USING (z, y, x))"
MASK = f"vox AS ({vox_sql(D)}), mask AS (SELECT z, y, x, (z * {D} + y) * {D} + x AS id FROM vox WHERE v >= 249)"
INSIDE = f"z BETWEEN 0 AND {D - 1} AND y BETWEEN 0 AND {D - 1} AND x BETWEEN 0 AND {D - 1}"


def dense(spark, sf):
    return P.densify(vox(spark, sf, D), DIMS)


def mask(spark, sf):
    return vox(spark, sf, D).where("v >= 249").select(*AXES)


def blur_sql(source: str, columns: list[str], sigma: float, tag: str, carry: str = "") -> tuple[str, str]:
    """CTEs of the separable blur, written as lookups of clamped neighbours."""
    weights = P.gaussian_kernel(sigma)
    kernel = ", ".join(f"({k}, {weights[abs(k)]!r})" for k in range(1 - len(weights), len(weights)))
    parts, last = [f"k{tag}(o, h) AS (VALUES {kernel})"], source
    for axis in AXES:
        name = f"{tag}_{axis}"
        at = ", ".join(f"least(greatest(a.{axis} + o, 0), {D - 1}) AS {c}" if c == axis else f"a.{c} AS {c}" for c in AXES)
        keys = "".join(f"a.{c} AS o{c}, " for c in AXES)
        carried = f", a.{carry} AS {carry}" if carry else ""
        parts.append(f"{name}_n AS (SELECT {keys}{at}, h{carried} FROM {last} a, k{tag})")
        sums = ", ".join(f"sum(h * b.{c}) AS {c}" for c in columns)
        group = "oz, oy, ox" + (f", n.{carry}" if carry else "")
        parts.append(f"{name} AS (SELECT oz AS z, oy AS y, ox AS x{f', n.{carry} AS {carry}' if carry else ''}, {sums} FROM {name}_n n JOIN {last} b USING (z, y, x) GROUP BY {group})")
        last = name
    return ", ".join(parts), last


_B1, _B1_LAST = blur_sql("src", ["f"], 1.0, "g1", "v")


@query("p1_gaussian_blur", f"WITH {DENSE}, src AS (SELECT z, y, x, v, CAST(v AS DOUBLE) AS f FROM dense), {_B1} SELECT z, y, x, round(f, 4) AS f FROM {_B1_LAST}")
def p1(spark, sf):
    return P.gaussian_blur(dense(spark, sf).withColumn("f", F.col("v").cast("double")), 1.0, ["f"]).select(*AXES, F.round("f", 4).alias("f"))


def box_sql(column="f"):
    parts, last = [], "src"
    for axis in reversed(AXES):
        others = ", ".join(a for a in AXES if a != axis)
        parts.append(f"b_{axis} AS (SELECT z, y, x, v, avg({column}) OVER (PARTITION BY {others} ORDER BY {axis} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS {column} FROM {last})")
        last = f"b_{axis}"
    return f"src AS (SELECT z, y, x, v, CAST(v AS DOUBLE) AS f FROM dense), {', '.join(parts)}", last


_BOX, _BOX_LAST = box_sql()


def boxed(spark, sf):
    return P.box_blur(dense(spark, sf).withColumn("f", F.col("v").cast("double")), 5, "f")


@query("p1_box_blur", f"WITH {DENSE}, {_BOX} SELECT z, y, x, round(f, 4) AS f FROM {_BOX_LAST}")
def p1b(spark, sf):
    return boxed(spark, sf).select(*AXES, F.round("f", 4).alias("f"))


@query("c13_air_mask", f"WITH {DENSE}, {_BOX} SELECT z, y, x, CASE WHEN round(f, 6) < 30 THEN 0 ELSE greatest(v, 1) END AS v FROM {_BOX_LAST}")
def c13(spark, sf):
    rounded = boxed(spark, sf).withColumn("f", F.round("f", 6))
    return rounded.select(*AXES, V.apply_cut(rounded, "f", 30).alias("v"))


@query("g9_valley", f"""WITH RECURSIVE vox AS ({vox_sql(32)}), b AS (SELECT CAST(i AS INTEGER) AS bin, (SELECT count(*) FROM vox WHERE v = i AND v > 0) AS n FROM range(256) t(i)),
s AS (SELECT bin, CASE WHEN bin IN (0, 254, 255) THEN 0e0 ELSE (SELECT avg(x.n) FROM b x WHERE abs(x.bin - b.bin) <= 2) END AS h FROM b),
p AS (SELECT m.bin, m.h, row_number() OVER (ORDER BY m.bin) AS k FROM s m JOIN s l ON l.bin = m.bin - 1 JOIN s r ON r.bin = m.bin + 1 WHERE m.bin BETWEEN 3 AND 252 AND m.h >= l.h AND m.h >= r.h AND m.h > 0.05e0 * (SELECT max(h) FROM s)),
f AS (SELECT k, bin, h, 1 AS g FROM p WHERE k = 1 UNION ALL SELECT p.k, CASE WHEN p.bin - f.bin <= 10 AND p.h <= f.h THEN f.bin ELSE p.bin END, CASE WHEN p.bin - f.bin <= 10 AND p.h <= f.h THEN f.h ELSE p.h END, CASE WHEN p.bin - f.bin <= 10 THEN f.g ELSE f.g + 1 END FROM f JOIN p ON p.k = f.k + 1),
t AS (SELECT arg_max(bin, k) AS bin, arg_max(h, k) AS h FROM f GROUP BY g ORDER BY h DESC, bin LIMIT 2),
e AS (SELECT CASE WHEN count(*) = 2 THEN min(bin) END AS dark, CASE WHEN count(*) = 2 THEN max(bin) END AS light, min(h) AS peak FROM t),
v AS (SELECT dark, light, peak, (SELECT bin FROM s WHERE bin BETWEEN dark AND light ORDER BY h, bin LIMIT 1) AS valley FROM e)
SELECT dark, light, valley, round(1 - (SELECT h FROM s WHERE bin = valley) / (peak + 1e-12), 6) AS depth, CAST(CASE WHEN valley > 39 THEN valley ELSE 39 END AS INTEGER) AS cut FROM v""")
def g9(spark, sf):
    """The two tallest peaks of the value histogram and the valley between them; one row."""
    found = A.valley(A.histogram(vox(spark, sf).where("v > 0"), F.col("v")))
    return found.select("dark", "light", "valley", F.round("depth", 6).alias("depth"), A.cut_level("valley").alias("cut"))


@query("g10_cut_level", "SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_size * 5 AS INTEGER) AS valley, CASE WHEN p_size * 5 > 39 THEN CAST(floor(39 + (p_partkey % 5) / 4.0e0 * (p_size * 5 - 39) + 0.5) AS INTEGER) ELSE 39 END AS cut FROM part")
def g10(spark, sf):
    parts = read_table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 5).cast("int").alias("valley"), (F.col("p_partkey") % 5 / 4.0).alias("strength"))
    return parts.select("id", "valley", A.cut_level("valley", 39, F.col("strength")).alias("cut"))


def _detect_sql():
    one, last = blur_sql("src", ["f"], 1.0, "s1", "v")
    grads = ", ".join(f"0.5e0 * (coalesce(lead(f) OVER (PARTITION BY {', '.join(b for b in AXES if b != a)} ORDER BY {a}), f) - coalesce(lag(f) OVER (PARTITION BY {', '.join(b for b in AXES if b != a)} ORDER BY {a}), f)) AS g{a}" for a in AXES)
    names = ["xx", "yy", "zz", "xy", "xz", "yz"]
    two, end = blur_sql("prod", [f"t{n}" for n in names], 2.0, "s2", "v")
    return f"""WITH {DENSE}, src AS (SELECT z, y, x, v, CAST(v AS DOUBLE) AS f FROM dense), {one}, grad AS (SELECT z, y, x, v, {grads} FROM {last}),
prod AS (SELECT z, y, x, v, {", ".join(f"g{n[0]} * g{n[1]} AS t{n}" for n in names)} FROM grad), {two},
q AS (SELECT z, y, x, v, txx AS a, tyy AS b, tzz AS c, txy AS d, txz AS e, tyz AS f, (txx + tyy + tzz) / 3 AS q, txy * txy + txz * txz + tyz * tyz AS o FROM {end}),
p AS (SELECT *, sqrt(((a - q) * (a - q) + (b - q) * (b - q) + (c - q) * (c - q) + 2 * o) / 6) AS p FROM q),
r AS (SELECT *, CASE WHEN p > 0 THEN ((a - q) / p * ((b - q) / p * ((c - q) / p) - f / p * (f / p)) - d / p * (d / p * ((c - q) / p) - f / p * (e / p)) + e / p * (d / p * (f / p) - (b - q) / p * (e / p))) / 2 ELSE 0 END AS r FROM p),
l AS (SELECT *, q + 2 * p * cos(acos(greatest(least(r, 1), -1)) / 3) AS l0, q + 2 * p * cos(acos(greatest(least(r, 1), -1)) / 3 + {2 * math.pi / 3!r}) AS l2 FROM r)
SELECT z, y, x FROM l WHERE v >= 40 AND l0 > 1e-6 AND (l0 - (3 * q - l0 - l2)) / (l0 + 1e-6) >= 0.4"""


@query("p2_detect_sheets", _detect_sql())
def p2(spark, sf):
    return P.detect_sheets(dense(spark, sf), DIMS, threshold=0.4, value_low=40, tile=8)


LABELS = f"""WITH RECURSIVE {MASK}, e AS (SELECT a.id AS a, b.id AS b FROM mask a JOIN mask b ON abs(a.z - b.z) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
r(a, b) AS (SELECT id, id FROM mask UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), roots AS (SELECT b AS id, min(a) AS root FROM r GROUP BY b),
labels AS (SELECT z, y, x, root, dense_rank() OVER (ORDER BY root) AS label FROM mask JOIN roots USING (id))"""


@query("p3_label_components", f"{LABELS} SELECT z, y, x, CAST(root AS BIGINT) AS root, CAST(label AS INTEGER) AS label FROM labels")
def p3(spark, sf):
    return P.label(mask(spark, sf), D, D, EDGE)


@query("g14_component_sizes", f"{LABELS} SELECT CAST(label AS INTEGER) AS label, count(*) AS size FROM labels GROUP BY label")
def g14(spark, sf):
    return P.component_sizes(mask(spark, sf), D, D, EDGE)


@query("p3_remove_small", f"{LABELS} SELECT z, y, x FROM labels WHERE root IN (SELECT root FROM labels GROUP BY root HAVING count(*) >= 3)")
def p3b(spark, sf):
    return P.remove_small(mask(spark, sf), D, D, 3, EDGE)


def _plug_sql(passes):
    parts, last = ["c8(dz, dy, dx) AS (SELECT i // 4, i // 2 % 2, i % 2 FROM range(8) t(i))"], "mask"
    for k in range(passes):
        parts.append(f"n{k} AS (SELECT z - dz AS z, y - dy AS y, x - dx AS x FROM {last}, c8), f{k} AS (SELECT z, y, x FROM n{k} WHERE z BETWEEN 0 AND {D - 2} AND y BETWEEN 0 AND {D - 2} AND x BETWEEN 0 AND {D - 2} GROUP BY ALL HAVING count(*) BETWEEN 5 AND 7)")
        parts.append(f"m{k} AS (SELECT z, y, x FROM {last} UNION SELECT z + dz, y + dy, x + dx FROM f{k}, c8)")
        last = f"m{k}"
    return f"WITH {MASK.replace('>= 249', '>= 180')}, {', '.join(parts)} SELECT CAST(z AS INTEGER) AS z, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x FROM {last}"


@query("p4_plug_holes", _plug_sql(2))
def p4(spark, sf):
    return P.plug_holes(vox(spark, sf, D).where("v >= 180").select(*AXES), DIMS, 2)


@query("p4_plug_holes_raster")
def p4b(spark, sf):
    """The in-place variant of one chunk, which depends on the scan's order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros(DIMS, bool)
        m[pdf["z"], pdf["y"], pdf["x"]] = True
        return pd.DataFrame(np.argwhere(P.plug_holes_raster(m, 1)[0]), columns=list(AXES))

    chunk = vox(spark, sf, D).where("v >= 180").select(*AXES)
    return chunk.groupBy(F.expr(f"z DIV {D}")).applyInPandas(run, "z int, y int, x int")


BALL = "ball(dz, dy, dx) AS (VALUES " + ", ".join(map(str, P.ball(1))) + ")"


@query("p5_closing", f"""WITH {MASK}, {BALL}, d AS (SELECT DISTINCT z + dz AS z, y + dy AS y, x + dx AS x FROM mask, ball), di AS (SELECT * FROM d WHERE {INSIDE}),
c AS (SELECT z - dz AS z, y - dy AS y, x - dx AS x FROM di, ball) SELECT CAST(z AS INTEGER) AS z, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x FROM c GROUP BY ALL HAVING count(*) = 7""")
def p5(spark, sf):
    return P.close(mask(spark, sf), 1, DIMS)


@query("p6_fill_cavities", f"""WITH RECURSIVE vox AS ({vox_sql(D)}), mask AS (SELECT z, y, x FROM vox WHERE v >= 120), g AS ({grid_sql(D, D, D)}), air AS (SELECT g.* FROM g ANTI JOIN mask USING (z, y, x)),
six(dz, dy, dx) AS (VALUES (0, 0, 1), (0, 1, 0), (1, 0, 0), (0, 0, -1), (0, -1, 0), (-1, 0, 0)), e AS (SELECT a.z AS z0, a.y AS y0, a.x AS x0, b.z, b.y, b.x FROM air a, six JOIN air b ON b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx),
f AS (SELECT z, y, x FROM air WHERE z IN (0, {D - 1}) OR y IN (0, {D - 1}) OR x IN (0, {D - 1}) UNION SELECT e.z, e.y, e.x FROM f JOIN e ON e.z0 = f.z AND e.y0 = f.y AND e.x0 = f.x)
SELECT z, y, x FROM g ANTI JOIN f USING (z, y, x)""")
def p6(spark, sf):
    return P.fill_cavities(vox(spark, sf, D).where("v >= 120").select(*AXES), DIMS, EDGE)


_D2 = f"WITH {MASK}, g AS ({grid_sql(D, D, D)}), d AS (SELECT g.z, g.y, g.x, min((g.z - m.z) * (g.z - m.z) + (g.y - m.y) * (g.y - m.y) + (g.x - m.x) * (g.x - m.x)) AS d2 FROM g, mask m GROUP BY ALL)"


@query("p7_distance", f"{_D2} SELECT z, y, x, round(sqrt(d2), 4) AS d FROM d")
def p7(spark, sf):
    return P.distance(mask(spark, sf), DIMS, EDGE).select(*AXES, F.round("d", 4).alias("d"))


@query("p8_signed_distance", f"""WITH {MASK}, g AS ({grid_sql(D, D, D)}), d AS (SELECT g.z, g.y, g.x, coalesce(min((g.z - m.z) * (g.z - m.z) + (g.y - m.y) * (g.y - m.y) + (g.x - m.x) * (g.x - m.x)), {FAR!r}) AS d2 FROM g LEFT JOIN mask m ON true GROUP BY ALL),
air AS (SELECT g.* FROM g ANTI JOIN mask USING (z, y, x)), i AS (SELECT m.z, m.y, m.x, coalesce(min((a.z - m.z) * (a.z - m.z) + (a.y - m.y) * (a.y - m.y) + (a.x - m.x) * (a.x - m.x)), {FAR!r}) AS i2 FROM mask m LEFT JOIN air a ON true GROUP BY ALL)
SELECT d.z, d.y, d.x, round(CASE WHEN d2 > 0 THEN sqrt(d2) ELSE -sqrt(i2) END, 4) AS d FROM d LEFT JOIN i USING (z, y, x)""")
def p8(spark, sf):
    """Of a volume that is all mask or all air every distance to the other is sqrt(FAR)."""
    return P.signed_distance(mask(spark, sf), DIMS, EDGE).select(*AXES, F.round("d", 4).alias("d"))


@query("p9_detect_pipeline", """WITH k AS (SELECT 6 + count(*) % 7 AS k FROM part)
SELECT CAST(k + i // 324 AS INTEGER) AS z, CAST(1 + i // 18 % 18 AS INTEGER) AS y, CAST(1 + i % 18 AS INTEGER) AS x, CAST(k * 400 + 20 + 1 AS BIGINT) AS root, CAST(1 AS INTEGER) AS label FROM range(648) t(i), k""")
def p9(spark, sf):
    """A noisy flat sheet whose place follows from the parts, from the volume to one labelled component."""
    dims = (20, 20, 20)
    return P.detect_pipeline(_noisy_sheet(spark, sf, dims), dims, 20, value_low=80)


def _noisy_sheet(spark, sf, dims):
    """A flat sheet of two planes with the derived volume's values, a sixteenth of them, on top; it lies from 6 + the number of parts modulo 7 on."""
    place = read_table(spark, sf, "part").agg((6 + F.count(F.lit(1)) % 7).cast("int").alias("k"))
    sheet = dense_grid(spark, *dims).join(F.broadcast(place)).select(*AXES, F.when(F.col("z").between(F.col("k"), F.col("k") + 1), 220).otherwise(40).alias("v"))
    noise = vox(spark, sf, dims[0]).select(*AXES, F.expr("v DIV 16").cast("int").alias("n"))
    return sheet.join(noise, list(AXES), "left").select(*AXES, (F.col("v") + F.coalesce("n", F.lit(0))).cast("int").alias("v"))
