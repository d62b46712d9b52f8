"""Queries of the movie stage: masks as cells, detections, and their links."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracklume.functions.scalars import rounded
from tracklume.operators import grid as G
from tracklume.operators import joint_linking as J
from tracklume.operators import linking as L
from tracklume.plans.inputs import CELLS_SQL, DETECTIONS_SQL, cells, detections, table
from tracklume.plans.registry import registered, twin
from tracklume.sources.tables import stored

PIXEL = 0.5
RADIUS = 3
BINS = 1000


@registered("intensity_rescale", twin("""SELECT event_id, event_type, (value - min(value) OVER f) / nullif(max(value) OVER f
 - min(value) OVER f, 0) AS rescaled FROM events WINDOW f AS (PARTITION BY event_type)""", ["event_id", "event_type"], ["rescaled"]))
def intensity_rescale(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return rounded(G.rescaled(rows, ["event_type"], "value", ["event_id"]).drop("value"))


_OTSU_SQL = f"""WITH g AS (SELECT event_type, min(value) AS mn, max(value) AS mx FROM events GROUP BY event_type),
 h AS (SELECT e.event_type, CAST(least(floor((value - mn) / ((mx - mn) / {BINS})), {BINS - 1}) AS INT) AS b, count(*) AS n FROM events e
  JOIN g ON e.event_type = g.event_type GROUP BY 1, 2),
 d AS (SELECT g.event_type, CAST(r.b AS INT) AS b, CAST(coalesce(h.n, 0) AS DOUBLE) AS n FROM g CROSS JOIN range({BINS}) r(b)
  LEFT JOIN h ON h.event_type = g.event_type AND h.b = r.b),
 c AS (SELECT event_type, b, sum(n) OVER w AS cn, sum(n * (b + 1)) OVER w AS cs, sum(n) OVER p AS tn, sum(n * (b + 1)) OVER p AS ts
  FROM d WINDOW w AS (PARTITION BY event_type ORDER BY b), p AS (PARTITION BY event_type)),
 v AS (SELECT i.event_type, i.b AS bi, j.b AS bj, round(CASE WHEN i.cn > 0 THEN i.cs * i.cs / i.cn ELSE 0 END
  + CASE WHEN j.cn - i.cn > 0 THEN (j.cs - i.cs) * (j.cs - i.cs) / (j.cn - i.cn) ELSE 0 END
  + CASE WHEN i.tn - j.cn > 0 THEN (i.ts - j.cs) * (i.ts - j.cs) / (i.tn - j.cn) ELSE 0 END, 6) AS var
  FROM c i JOIN c j ON i.event_type = j.event_type AND i.b < j.b WHERE j.b < {BINS - 1}),
 best AS (SELECT event_type, bi, bj FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY var DESC, bi, bj) AS rn FROM v) q
  WHERE rn = 1),
 lim AS (SELECT g.event_type, mn + (bi + 0.5) * (mx - mn) / {BINS} AS lower, mn + (bj + 0.5) * (mx - mn) / {BINS} AS upper FROM g JOIN best
  ON g.event_type = best.event_type)"""


@registered("otsu_limits", twin(f"{_OTSU_SQL} SELECT * FROM lim", ["event_type"], ["lower", "upper"]))
def otsu_limits(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", "value")
    return rounded(G.otsu_limits(rows, ["event_type"], "value", BINS))


@registered("otsu_mask", twin(f"""{_OTSU_SQL} SELECT event_id, e.event_type, CAST(value > lower AS INT) AS mask FROM events e
 JOIN lim ON e.event_type = lim.event_type""", ["event_id", "event_type", "mask"], []))
def otsu_mask(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    masked = G.above_lower(rows, ["event_type"], "value", ["event_id"], BINS)
    return masked.select("event_id", "event_type", F.col("mask").cast("int").alias("mask"))


def _parts_sql(cells_name: str, prefix: str) -> str:
    """Components of a table of cells by their transitive closure: label (smallest cell) and size of every cell."""
    return f"""{prefix}reach AS (SELECT file, frame, x, y, x AS tx, y AS ty FROM {cells_name} UNION SELECT r.file, r.frame, r.x, r.y, c.x, c.y
 FROM {prefix}reach r JOIN {cells_name} c ON c.file = r.file AND c.frame = r.frame AND abs(c.x - r.tx) + abs(c.y - r.ty) = 1),
 {prefix}parts AS (SELECT file, frame, x, y, min(ty * CAST(16777216 AS BIGINT) + tx) AS label, count(*) AS size FROM {prefix}reach GROUP BY 1, 2, 3, 4)"""


_FILTER_SQL = f"""WITH RECURSIVE cells AS ({CELLS_SQL}), {_parts_sql("cells", "a_")}, kept AS (SELECT file, frame, x, y FROM a_parts WHERE size >= 4),
 size AS (SELECT max(x) + 1 AS w, max(y) + 1 AS h FROM cells), across AS (SELECT CAST(unnest(range(w)) AS INT) AS x FROM size), down AS (SELECT CAST(unnest(range(h)) AS INT) AS y FROM size),
 gaps AS (SELECT g.file, g.frame, u.x, v.y FROM (SELECT DISTINCT file, frame FROM kept) g CROSS JOIN across u CROSS JOIN down v
 ANTI JOIN kept k ON k.file = g.file AND k.frame = g.frame AND k.x = u.x AND k.y = v.y),
 near AS (SELECT file, frame, x, y, x AS tx, y AS ty, 0 AS step FROM gaps UNION SELECT r.file, r.frame, r.x, r.y, c.x, c.y, r.step + 1
 FROM near r JOIN gaps c ON c.file = r.file AND c.frame = r.frame AND abs(c.x - r.tx) + abs(c.y - r.ty) = 1 WHERE r.step < 3),
 holes AS (SELECT file, frame, x, y FROM near GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT ty * CAST(16777216 AS BIGINT) + tx) < 4)
 SELECT * FROM kept UNION ALL SELECT * FROM holes"""  # a component of four cells or more has four within three steps of each of its cells


@registered("component_filter", twin(_FILTER_SQL, ["file", "frame", "x", "y"], []))
def component_filter(spark, sf_dir):
    """Masks without small components, then without small holes; every grid has the extent of the whole table."""
    mask = cells(spark, sf_dir)
    size = mask.agg(*[F.coalesce(F.max(c) + 1, F.lit(1)).alias(c) for c in ("x", "y")]).first()
    kept = stored(G.without_specks(mask, 4), "cells")
    return G.without_holes(kept, 4, size.x, size.y)


@registered("component_sizes", twin(f"""WITH RECURSIVE cells AS ({CELLS_SQL}), {_parts_sql("cells", "a_")} SELECT file, frame, label,
 count(*) AS n, max(size) AS size FROM a_parts GROUP BY 1, 2, 3""", ["file", "frame", "label", "n", "size"], []))
def component_sizes(spark, sf_dir):
    parts = G.labelled_cells(cells(spark, sf_dir))
    return parts.groupBy(*G.GRID, "label").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))


_CELLS = f"WITH cells AS ({CELLS_SQL})"
_RIM = f"""{_CELLS}, offs AS (SELECT dx, dy FROM range({-RADIUS}, {RADIUS + 1}) a(dx) CROSS JOIN range({-RADIUS}, {RADIUS + 1}) b(dy) WHERE dx * dx + dy * dy <= {RADIUS * RADIUS}),
 inside AS (SELECT c.file, c.frame, c.x, c.y, count(n.x) AS k FROM cells c CROSS JOIN offs o LEFT JOIN cells n ON n.file = c.file
 AND n.frame = c.frame AND n.x = c.x + o.dx AND n.y = c.y + o.dy GROUP BY 1, 2, 3, 4), rim AS (SELECT file, frame, x, y FROM inside WHERE k < (SELECT count(*) FROM offs))"""


@registered("grid_boundary", twin(f"{_RIM} SELECT * FROM rim", ["file", "frame", "x", "y"], []))
def grid_boundary(spark, sf_dir):
    return G.boundary(cells(spark, sf_dir), RADIUS)


@registered("mask_morphology", twin(f"""{_RIM} SELECT c.file, c.frame, n * 0.25 AS area, coalesce(m, 0) AS perimeter_au,
 coalesce(m, 0) * 0.25 AS perimeter FROM (SELECT file, frame, count(*) AS n FROM cells GROUP BY 1, 2) c LEFT JOIN
 (SELECT file, frame, count(*) AS m FROM rim GROUP BY 1, 2) r ON c.file = r.file AND c.frame = r.frame""",
                                    ["file", "frame", "perimeter_au"], ["area", "perimeter"]))
def mask_morphology(spark, sf_dir):
    mask = cells(spark, sf_dir)
    return rounded(G.morphology(mask, G.boundary(mask, RADIUS), PIXEL))


def _grid_spots(spark, sf_dir):
    """Detections in cell coordinates of the grid of their event type and day."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("double")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("file"),
        F.day("ts").alias("frame"),
        F.col("event_id").alias("det_id"),
        (F.col("value") / 10).alias("x"),
        (k / 10).alias("y"),
    )


@registered("nearest_edge", twin(f"""{_RIM}, s AS (SELECT event_type AS file, CAST(day(ts) AS INT) AS frame, event_id AS det_id, value / 10 AS x,
 CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 10 AS y FROM events) SELECT s.file, s.frame, s.det_id, any_value(s.x) * 0.5 AS x_micron,
 any_value(s.y) * 0.5 AS y_micron, sqrt(min((s.x - r.x) * (s.x - r.x) + (s.y - r.y) * (s.y - r.y))) AS distance,
 sqrt(min((s.x - r.x) * (s.x - r.x) + (s.y - r.y) * (s.y - r.y))) * 0.5 AS distance_micron FROM s LEFT JOIN rim r ON s.file = r.file
 AND s.frame = r.frame GROUP BY 1, 2, 3""", ["file", "frame", "det_id"], ["x_micron", "y_micron", "distance", "distance_micron"]))
def nearest_edge(spark, sf_dir):
    rim = G.boundary(cells(spark, sf_dir), RADIUS)
    near = G.nearest_distance(_grid_spots(spark, sf_dir), rim, pixel=PIXEL)
    return rounded(near.withColumns({"x_micron": F.col("x") * PIXEL, "y_micron": F.col("y") * PIXEL}).drop("x", "y"))


@registered("link_candidates", twin(f"""WITH d AS ({DETECTIONS_SQL}), u AS (SELECT DISTINCT file, frame, x, y, det_id FROM d),
 p AS (SELECT a.file, a.det_id, b.det_id AS partner, b.frame - a.frame AS gap, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS distance
 FROM u a JOIN u b ON a.file = b.file AND b.frame BETWEEN a.frame + 1 AND a.frame + 4)
 SELECT *, CAST(row_number() OVER (PARTITION BY file, det_id ORDER BY gap, distance, partner) AS INT) AS place FROM p WHERE distance <= 20""",
                                   ["file", "det_id", "partner", "gap", "place"], ["distance"]))
def link_candidates(spark, sf_dir):
    return rounded(L.nearest_partners(detections(spark, sf_dir)))


@registered("link_tracks", twin(f"""WITH RECURSIVE d AS ({DETECTIONS_SQL}), u AS (SELECT file, frame, x, y, min(det_id) AS det_id FROM d
 GROUP BY 1, 2, 3, 4), p AS (SELECT a.file, a.det_id AS a, b.det_id AS b, b.frame - a.frame AS gap, sqrt((b.x - a.x) * (b.x - a.x)
 + (b.y - a.y) * (b.y - a.y)) AS distance FROM u a JOIN u b ON a.file = b.file AND b.frame BETWEEN a.frame + 1 AND a.frame + 4),
 best AS (SELECT *, row_number() OVER (PARTITION BY file, a ORDER BY gap, distance, b) AS ra, row_number() OVER (PARTITION BY file, b
 ORDER BY gap, distance, a) AS rb FROM p WHERE distance <= 20), links AS (SELECT file, a, b FROM best WHERE ra = 1 AND rb = 1),
 chain AS (SELECT file, det_id, det_id AS head FROM d WHERE det_id NOT IN (SELECT b FROM links) UNION ALL
 SELECT l.file, l.b, c.head FROM chain c JOIN links l ON l.file = c.file AND l.a = c.det_id),
 named AS (SELECT file, det_id, min(det_id) OVER (PARTITION BY file, head) AS track, count(*) OVER (PARTITION BY file, head) AS n FROM chain)
 SELECT n.file, n.track, d.frame, n.det_id, d.x, d.y FROM named n JOIN d ON d.det_id = n.det_id WHERE n >= 3""",
                                  ["file", "track", "frame", "det_id"], ["x", "y"]))
def link_tracks(spark, sf_dir):
    spots = detections(spark, sf_dir)
    return rounded(L.without_stubs(L.linked_tracks(spots), 3).select("file", "track", "frame", "det_id", "x", "y"))


@registered("link_tracks_joint")
def link_tracks_joint(spark, sf_dir):
    spots = detections(spark, sf_dir)
    return rounded(L.without_stubs(J.joint_tracks(spots), 3).select("file", "track", "frame", "det_id", "x", "y"))


@registered("link_joint_check", f"""SELECT file, count(*) AS detections, CAST(0 AS BIGINT) AS shared_frames, CAST(0 AS BIGINT) AS far,
 CAST(0 AS BIGINT) AS late, true AS named FROM ({DETECTIONS_SQL}) d GROUP BY file""")
def link_joint_check(spark, sf_dir):
    """Per file: all detections have a track; none meets a frame twice, moves beyond the reach or waits too long; names are smallest ids."""
    step = Window.partitionBy("file", "track").orderBy("frame", "det_id")
    moved = F.sqrt(F.pow(F.col("x") - F.lag("x").over(step), 2) + F.pow(F.col("y") - F.lag("y").over(step), 2))
    waited = F.col("frame") - F.lag("frame").over(step)
    smallest = F.min("det_id").over(Window.partitionBy("file", "track"))
    rows = J.joint_tracks(detections(spark, sf_dir)).withColumns({"moved": moved, "waited": waited, "named": smallest == F.col("track")})
    return rows.groupBy("file").agg(
        F.count(F.lit(1)).alias("detections"), F.count_if(F.col("waited") == 0).alias("shared_frames"), F.count_if(F.col("moved") > 20 + 1e-9).alias("far"),
        F.count_if(F.col("waited") > 4).alias("late"), F.bool_and("named").alias("named"),
    )
