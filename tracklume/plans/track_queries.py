"""Queries on the observation table, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklume.functions.scalars import nan_to_null, rounded, scalar_math
from tracklume.functions.skew import with_position
from tracklume.operators import features as FT
from tracklume.operators import folds as FO
from tracklume.operators import kinematics as K
from tracklume.operators import panel as P
from tracklume.operators import select as S
from tracklume.operators import stats as ST
from tracklume.plans.inputs import OBSERVATIONS_SQL, observations, table
from tracklume.plans.registry import registered, settled, twin
from tracklume.schema import CANONICAL, FEATURE_FAMILIES, FEATURES, TRACK
from tracklume.sources.tables import filename_fields, labelled, new_location, read_observations, rename_canonical, write_csv

SHORT = 12
WITH_TRACKS = f"WITH tracks AS ({OBSERVATIONS_SQL})"

# Per-step twin: deltas, headings and second differences, with the 1-based position in the track
STEPS_SQL = f"""{WITH_TRACKS}, steps AS (
 SELECT *, row_number() OVER w AS pos, x_micron - lag(x_micron) OVER w AS dx, y_micron - lag(y_micron) OVER w AS dy,
        A - lag(A) OVER w AS darea, P - lag(P) OVER w AS dperimeter
 FROM tracks WINDOW w AS (PARTITION BY file, particle ORDER BY frame)
), angles AS (
 SELECT *, CASE WHEN dx = 0 THEN CASE WHEN dy > 0 THEN pi()/2 WHEN dy < 0 THEN -pi()/2 END ELSE atan(dy/dx) END AS angle,
        CASE WHEN dx = 0 AND dy = 0 THEN NULL ELSE atan2(dy, dx) END AS direction,
        CASE WHEN dx = 0 THEN NULL ELSE dy/dx END AS t
 FROM steps
), turns AS (
 SELECT *, t - lag(t) OVER w AS dt, angle - lag(angle) OVER w AS dangle, direction - lag(direction) OVER w AS dturn
 FROM angles WINDOW w AS (PARTITION BY file, particle ORDER BY frame)
)"""
TURN_SQL = "CASE WHEN dturn > pi() THEN dturn - 2*pi() WHEN dturn < -pi() THEN dturn + 2*pi() ELSE dturn END"

FEATURES_CTE = f"""{WITH_TRACKS}, steps AS (
 SELECT *, x_micron - lag(x_micron) OVER w AS dx, y_micron - lag(y_micron) OVER w AS dy
 FROM tracks WINDOW w AS (PARTITION BY file, particle ORDER BY frame)
), agg AS (
 SELECT file, particle, min(serum) AS serum, min(time) AS time, min(guide) AS guide, count(*) AS n,
  avg(D) AS MD, max(D) AS MaxD, var_samp(D) AS VarD, stddev_samp(D) AS SD, coalesce(sum(D), 0.0) AS path,
  sqrt(pow(coalesce(sum(dx), 0.0), 2) + pow(coalesce(sum(dy), 0.0), 2)) AS TD,
  avg(A) AS MA, avg(P) AS MP, avg(Dist) AS MDist, var_samp(Dist) AS VarDist, max(Dist) - min(Dist) AS DistR,
  arg_max(Dist, frame) FILTER (Dist IS NOT NULL) - arg_min(Dist, frame) FILTER (Dist IS NOT NULL) AS TDist,
  regr_slope(Dist, frame) AS sDist, regr_slope(A, frame) AS sA, regr_slope(P, frame) AS sP
 FROM steps GROUP BY file, particle
), outs AS (
 SELECT t.file, t.particle, CAST(sum(CASE WHEN D > MD + 2*SD THEN 1 ELSE 0 END) AS BIGINT) AS out2sd,
        CAST(sum(CASE WHEN D > MD + 3*SD THEN 1 ELSE 0 END) AS BIGINT) AS out3sd
 FROM tracks t JOIN agg a ON t.file = a.file AND t.particle = a.particle GROUP BY t.file, t.particle
), features AS (
 SELECT a.*, out2sd, out3sd, CASE WHEN MD <> 0 THEN VarD / MD END AS rVarD,
  CASE WHEN MDist <> 0 THEN VarDist / MDist END AS rVarDist, CASE WHEN path <> 0 THEN TD / path END AS Pers,
  CASE WHEN MD = max(MD) OVER (PARTITION BY a.file) THEN 1 ELSE 0 END AS ifFast,
  CASE WHEN MDist = max(MDist) OVER (PARTITION BY a.file) THEN 1 ELSE 0 END AS ifCentr
 FROM agg a JOIN outs o ON a.file = o.file AND a.particle = o.particle
)"""

COLUMNS = FEATURES
OBSERVED = ["x_micron", "y_micron", "D", "A", "P", "Dist"]


def features(spark: SparkSession, sf_dir: str, keep=("serum", "time", "guide")) -> DataFrame:
    return FT.track_features(observations(spark, sf_dir), keep)


def query(name: str, sql: str | None = None, doubles: str = "", keep: str = "", **other: int):
    """Register a query on observations together with its twin: ``keep`` columns plain, ``doubles`` rounded.
    """
    return registered(name, None if sql is None else twin(sql, keep.split(), doubles.split(), 6, **other))


@query("scan_tracks", f"{WITH_TRACKS} SELECT * FROM tracks", "x_micron y_micron D A P Dist serum_conc_percent",
       "file particle frame serum time guide comment")
def scan_tracks(spark, sf_dir):
    return rounded(rename_canonical(observations(spark, sf_dir), CANONICAL))


_OLDER = {new: old for old, new in CANONICAL.items()}


@query("scan_older_tracks", f"{WITH_TRACKS} SELECT file, particle, frame, D, A, P, Dist, serum FROM tracks", "D A P Dist", "file particle frame serum")
def scan_older_tracks(spark, sf_dir):
    """A folder of CSV files in the older dialect, with NaN for missing measures, read under canonical names."""
    rows = observations(spark, sf_dir).select(*TRACK, "frame", "D", "A", "P", "Dist", "serum").withColumnsRenamed(_OLDER)
    place = new_location(spark, "older")
    write_csv(rows.withColumns({c: F.coalesce(F.col(c), F.lit(float("nan"))) for c in _OLDER.values()}), place)
    return rounded(rename_canonical(read_observations(spark, place, rows.schema, "csv"), CANONICAL))


@query("experiment_filter", f"""{WITH_TRACKS} SELECT * FROM tracks WHERE (comment IS NULL OR comment NOT IN
 ('stress_control', 'H2B')) AND (guide LIKE '%1398%' OR guide LIKE '%1514%') AND time < 40""",
       "x_micron y_micron D", "file particle frame guide comment time")
def experiment_filter(spark, sf_dir):
    kept = S.experiment_filter(observations(spark, sf_dir))
    return rounded(kept.select("x_micron", "y_micron", "D", "file", "particle", "frame", "guide", "comment", "time"))


@query("guide_filter", f"""{WITH_TRACKS} SELECT guide, count(*) AS n, sum(x_micron) AS total FROM tracks
 WHERE regexp_matches(guide, '1398|1514|1362') GROUP BY guide""", "total", "guide n")
def guide_filter(spark, sf_dir):
    kept = S.guide_filter(observations(spark, sf_dir), ["1398", "1514", "1362"])
    return rounded(kept.groupBy("guide").agg(F.count(F.lit(1)).alias("n"), F.sum("x_micron").alias("total")))


@query("fset_select", f"""{STEPS_SQL} SELECT file, particle, frame, serum_conc_percent,
 sqrt(dx*dx + dy*dy) AS dxy, Dist AS min_dist_pxs, angle, dangle, A AS area_micron FROM turns WHERE pos > 2""",
       "serum_conc_percent dxy min_dist_pxs angle dangle area_micron", "file particle frame")
def fset_select(spark, sf_dir):
    rows = K.dynamics(observations(spark, sf_dir))
    names = {"min_dist_pxs": "Dist", "area_micron": "A", "perimeter_au": "P"}
    return rounded(S.feature_set(rows, "f_dxy_mindist_angle_area", [*TRACK, "frame"], "serum_conc_percent", names))


@query("date_exclude", """SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderdate IS NULL OR
 strftime(o_orderdate, '%d.%m.%Y') NOT IN ('23.10.1996', '14.01.1997', '14.05.1997')""", "", "o_orderkey o_orderpriority")
def date_exclude(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("date", F.date_format("o_orderdate", "dd.MM.yyyy"))
    kept = S.exclude_values(orders, "date", ["23.10.1996", "14.01.1997", "14.05.1997"])
    return kept.select("o_orderkey", "o_orderpriority")


@query("nan_to_null", f"""{WITH_TRACKS} SELECT file, particle, frame, CASE WHEN Dist < 0.5 THEN NULL ELSE Dist END AS Dist,
 D FROM tracks""", "Dist D", "file particle frame")
def null_for_nan(spark, sf_dir):
    rows = observations(spark, sf_dir).select(
        *TRACK, "frame", F.when(F.col("Dist") < 0.5, F.lit(float("nan"))).otherwise(F.col("Dist")).alias("Dist"), "D"
    )
    return rounded(nan_to_null(rows))


@query("filename_fields", """SELECT page_id, string_split(part, '_')[1] AS date,
 TRY_CAST(nullif(string_split(part, '_')[2], '') AS INT) AS serum, substring(part, 1, CAST(length(part) - 4 AS BIGINT)) AS file FROM
 (SELECT page_id, regexp_replace(url, '[^A-Za-z0-9.]+', '_', 'g') || '_' || CAST(page_id AS VARCHAR) || '.tif' AS raw,
  CAST(page_id AS VARCHAR) || '_' || CAST(page_id % 2 * 10 AS VARCHAR) || '_' || regexp_replace(url, '[^A-Za-z0-9.]+', '_', 'g') || '.tif' AS part
  FROM pages) p""", "", "page_id date serum file")
def file_names(spark, sf_dir):
    url = F.regexp_replace("url", "[^A-Za-z0-9.]+", "_")
    name = F.concat(
        F.col("page_id").cast("string"), F.lit("_"), (F.col("page_id") % 2 * 10).cast("string"), F.lit("_"), url, F.lit(".tif")
    )
    return filename_fields(table(spark, sf_dir, "pages").select("page_id", name.alias("name")), "name").drop("name")


@query("dedup_first", f"""{FEATURES_CTE} SELECT file, particle, MD FROM
 (SELECT *, row_number() OVER (PARTITION BY file ORDER BY particle) AS rn FROM features WHERE ifFast = 0) f WHERE rn = 1""",
       "MD", "file particle")
def dedup_first(spark, sf_dir):
    slow = features(spark, sf_dir).where(F.col("ifFast") == 0)
    return rounded(S.keep_first(slow.select(*TRACK, "MD"), ["file"], "particle"))


@query("jumpers", f"{FEATURES_CTE} SELECT * FROM features WHERE out3sd = 1", "MD MaxD DistR TDist",
       "file particle out2sd serum")
def jumpers(spark, sf_dir):
    return rounded(S.outlier_tracks(features(spark, sf_dir), ["MD", "MaxD", "DistR", "TDist", *TRACK, "out2sd", "serum"]))


@query("normalize_xy", f"""{WITH_TRACKS} SELECT file, particle, frame, x_micron - min(x_micron) OVER t AS x_norm,
 y_micron - min(y_micron) OVER t AS y_norm, max(x_micron) OVER t AS x_max, max(y_micron) OVER t AS y_max FROM tracks
 WINDOW t AS (PARTITION BY file, particle)""", "x_norm y_norm x_max y_max", "file particle frame")
def normalize_xy(spark, sf_dir):
    rows = K.range_normalised(observations(spark, sf_dir).select(*TRACK, "frame", "x_micron", "y_micron"))
    return rounded(rows.select(
        *TRACK, "frame", "x_norm", "y_norm", F.col("x_micron_max").alias("x_max"), F.col("y_micron_max").alias("y_max")
    ))


LENGTHS_SQL = f"""{WITH_TRACKS}, sized AS (SELECT *, count(frame) OVER (PARTITION BY file, particle) AS nframes FROM tracks)"""


@query("drop_short_tracks", f"{LENGTHS_SQL} SELECT * FROM sized WHERE nframes >= {SHORT}", "D", "file particle frame")
def drop_short_tracks(spark, sf_dir):
    return rounded(K.drop_short(observations(spark, sf_dir).select(*TRACK, "frame", "D"), SHORT))


@query("short_tracks", f"""{LENGTHS_SQL} SELECT file, particle, max(nframes) AS nframes FROM sized
 WHERE nframes < {SHORT} GROUP BY file, particle""", "", "file particle nframes")
def short_tracks(spark, sf_dir):
    return K.short_tracks(observations(spark, sf_dir), SHORT)


@query("filter_stubs", f"""{LENGTHS_SQL} SELECT file, particle, frame, 'v1' AS version, nframes FROM sized
 WHERE nframes >= 12""", "", "file particle frame version nframes")
def filter_stubs(spark, sf_dir):
    rows = K.with_length(observations(spark, sf_dir).select(*TRACK, "frame"))
    return labelled(rows.where(F.col("nframes") >= 12), version="v1")


@query("track_deltas", f"{STEPS_SQL} SELECT *, dx AS dX, dy AS dY FROM turns", "dX dY D", "file particle frame")
def track_deltas(spark, sf_dir):
    rows = observations(spark, sf_dir).select(*TRACK, "frame", "x_micron", "y_micron")
    return rounded(K.track_deltas(rows).drop("x_micron", "y_micron"))


@query("heading", f"{STEPS_SQL} SELECT * FROM turns WHERE dx IS NOT NULL", "angle direction", "file particle frame")
def heading(spark, sf_dir):
    rows = K.headings(K.track_deltas(observations(spark, sf_dir).select(*TRACK, "frame", "x_micron", "y_micron")))
    return rounded(rows.where(F.col("dX").isNotNull()).select("angle", "direction", *TRACK, "frame"))


@query("turning_angle", f"""{STEPS_SQL} SELECT file, particle, frame, dturn, {TURN_SQL} AS turn, abs({TURN_SQL}) AS turn_abs
 FROM turns WHERE pos > 2""", "dturn turn turn_abs", "file particle frame")
def turning_angle(spark, sf_dir):
    return rounded(K.turning_angles(observations(spark, sf_dir)))


@query("tsc_dynamics", f"SELECT *, sqrt(dx*dx + dy*dy) AS dxy FROM ({STEPS_SQL} SELECT * FROM turns WHERE pos > 2) q",
       "dx dy dxy angle dangle dperimeter darea", "file particle frame")
def tsc_dynamics(spark, sf_dir):
    rows = K.dynamics(observations(spark, sf_dir))
    return rounded(rows.select(*TRACK, "frame", "dx", "dy", "dxy", "angle", "dangle", "dperimeter", "darea"))


DIRECTIONALITY = ["dt", "d_theta", "d_theta2", "d_theta2_minabs", "d_theta2_minabs_abs"]
# reciprocals of near-zero turns magnify the last bits of the angles
RECIPROCALS = {name + c: 3 for c in DIRECTIONALITY for name in ("rec_", "D_norm_rec_")}
_INVERSE = {
    "dt": "dt", "d_theta": "dangle", "d_theta2": "dturn", "d_theta2_minabs": "turn", "d_theta2_minabs_abs": "abs(turn)",
}


@query("directionality", f"""SELECT file, particle,
 {", ".join(f"avg(1 / nullif({_INVERSE[c]}, 0)) AS rec_{c}, avg(1 / nullif({_INVERSE[c]}, 0) * sqrt(dx*dx + dy*dy)) AS D_norm_rec_{c}" for c in DIRECTIONALITY)},
 sqrt(pow(sum(dx), 2) + pow(sum(dy), 2)) / nullif(sum(sqrt(dx*dx + dy*dy)), 0) AS Pers
 FROM ({STEPS_SQL} SELECT *, {TURN_SQL} AS turn FROM turns WHERE pos > 2) q GROUP BY file, particle""",
       " ".join(f"rec_{c} D_norm_rec_{c}" for c in DIRECTIONALITY) + " Pers", "file particle", **RECIPROCALS)
def directionality(spark, sf_dir):
    return rounded(K.directionality(observations(spark, sf_dir)), **RECIPROCALS)


@query("sibling_masks", f"{FEATURES_CTE} SELECT * FROM features", "MD MDist", "file particle ifFast ifCentr")
def sibling_masks(spark, sf_dir):
    tracks = observations(spark, sf_dir).groupBy(*TRACK).agg(F.avg("D").alias("MD"), F.avg("Dist").alias("MDist"))
    return rounded(FT.sibling_masks(tracks))


@query("track_outliers", f"""{WITH_TRACKS} SELECT file, particle, frame, D,
 CASE WHEN D > avg(D) OVER t + 2 * stddev_samp(D) OVER t THEN 1 ELSE 0 END AS out2sd,
 CASE WHEN D > avg(D) OVER t + 3 * stddev_samp(D) OVER t THEN 1 ELSE 0 END AS out3sd
 FROM tracks WINDOW t AS (PARTITION BY file, particle)""", "D", "file particle frame out2sd out3sd")
def track_outliers(spark, sf_dir):
    return rounded(K.step_outliers(observations(spark, sf_dir).select(*TRACK, "frame", "D")).drop("MD", "SD"))


@query("track_features", f"{FEATURES_CTE} SELECT * FROM features",
       " ".join(c for c in FEATURES if c not in ("ifFast", "ifCentr", "out2sd", "out3sd")),
       "file particle serum ifFast ifCentr out2sd out3sd")
def track_features(spark, sf_dir):
    return rounded(features(spark, sf_dir, ("serum",)))


@query("track_table_by_label", f"""{FEATURES_CTE} SELECT serum, count(*) AS n, avg(MD) AS MD, avg(Pers) AS Pers,
 avg(sDist) AS sDist, CAST(sum(out2sd) AS BIGINT) AS out2sd, CAST(sum(out3sd) AS BIGINT) AS out3sd FROM
 (SELECT * REPLACE (CASE WHEN isnan(sDist) THEN NULL ELSE sDist END AS sDist) FROM features) f GROUP BY serum""",
       "MD Pers sDist", "serum n out2sd out3sd")
def track_table_by_label(spark, sf_dir):
    tracks = FT.track_table(observations(spark, sf_dir))
    return rounded(tracks.groupBy("serum").agg(
        F.count(F.lit(1)).alias("n"), F.avg("MD").alias("MD"), F.avg("Pers").alias("Pers"), F.avg("sDist").alias("sDist"),
        F.sum("out2sd").alias("out2sd"), F.sum("out3sd").alias("out3sd"),
    ))


@query("circularity", f"""SELECT file, MA, MP, shape / max(shape) OVER () AS circularity FROM
 (SELECT file, MA, MP, 4 * pi() * MA / pow(MP, 2) AS shape FROM ({FEATURES_CTE}
  SELECT *, row_number() OVER (PARTITION BY file ORDER BY particle) AS rn FROM features) f WHERE rn = 1) g""",
       "MA MP circularity", "file")
def circularity(spark, sf_dir):
    tracks = observations(spark, sf_dir).groupBy(*TRACK).agg(F.avg("A").alias("MA"), F.avg("P").alias("MP"))
    return rounded(FT.circularity(tracks))


def _siblings(spark, sf_dir, mask, marked, other):
    return ST.siblings(features(spark, sf_dir), mask, ["MD", "TD", "TDist"], marked, other)


def _siblings_sql(mask: str, marked: str, other: str) -> str:
    side = f"""SELECT *, row_number() OVER (PARTITION BY file, {mask} ORDER BY particle) AS rn FROM features
     WHERE regexp_matches(guide, '1398|1514') AND time < 40"""
    columns = ", ".join(f"a.{c} AS {marked}{c}, b.{c} AS {other}{c}" for c in ("particle", "MD", "TD", "TDist"))
    return f"""{FEATURES_CTE}, ranked AS ({side}) SELECT a.file, {columns} FROM ranked a JOIN ranked b ON a.file = b.file
     WHERE a.{mask} = 1 AND b.{mask} = 0 AND a.rn = 1 AND b.rn = 1 AND a.MD IS NOT NULL AND b.MD IS NOT NULL"""


@query("paired_fast_slow", _siblings_sql("ifFast", "f_", "s_"), "f_MD s_MD f_TD s_TD f_TDist s_TDist",
       "file f_particle s_particle")
def paired_fast_slow(spark, sf_dir):
    return rounded(_siblings(spark, sf_dir, "ifFast", "f_", "s_"))


@query("paired_central_peripheral", _siblings_sql("ifCentr", "c_", "p_"), "c_MD p_MD c_TD p_TD c_TDist p_TDist",
       "file c_particle p_particle")
def paired_central_peripheral(spark, sf_dir):
    return rounded(_siblings(spark, sf_dir, "ifCentr", "c_", "p_"))


@query("paired_fit", f"""SELECT regr_slope(f_MD, s_MD) AS slope, regr_intercept(f_MD, s_MD) AS intercept,
 regr_r2(f_MD, s_MD) AS r2, CAST(regr_count(f_MD, s_MD) AS BIGINT) AS n FROM ({_siblings_sql("ifFast", "f_", "s_")}) p""",
       "slope intercept r2", "n")
def paired_fit(spark, sf_dir):
    return rounded(ST.linear_fit(_siblings(spark, sf_dir, "ifFast", "f_", "s_"), "f_MD", "s_MD"))


@query("spearman_pairs", f"""WITH r AS (SELECT corr(ra, rb) AS rho, count(*) AS n FROM (
 SELECT rank() OVER (ORDER BY p_TD) + (count(*) OVER (PARTITION BY p_TD) - 1) / 2.0 AS ra,
        rank() OVER (ORDER BY c_TD) + (count(*) OVER (PARTITION BY c_TD) - 1) / 2.0 AS rb
 FROM ({_siblings_sql("ifCentr", "c_", "p_")}) p) q), s AS (SELECT *, n - 2 AS v, rho * sqrt((n - 2) / (1 - rho * rho)) AS t FROM r)
 SELECT rho, n, t, 1 - 2 * (SELECT sum(abs(t) / 4000 * exp(lgamma((v + 1) / 2.0) - lgamma(v / 2.0)) / sqrt(v * pi())
  * pow(1 + pow(abs(t) * (i + 0.5) / 4000, 2) / v, -(v + 1) / 2.0)) FROM range(4000) u(i)) AS p FROM s""", "rho t p", "n")
def spearman_pairs(spark, sf_dir):
    """The twin's p-value is the integral of Student's density."""
    pairs = _siblings(spark, sf_dir, "ifCentr", "c_", "p_")
    return rounded(ST.spearman(pairs, "p_TD", "c_TD", "file").select("rho", "n", "t", "p"))


@query("corr_matrix", f"""WITH f AS ({FEATURES_CTE} SELECT {", ".join(f"CASE WHEN isnan(CAST({c} AS DOUBLE)) THEN NULL ELSE CAST({c} AS DOUBLE) END AS {c}" for c in COLUMNS)} FROM features)
 """ + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM f" for a in COLUMNS for b in COLUMNS),
       "r", "a b")
def corr_matrix(spark, sf_dir):
    return rounded(ST.correlation_matrix(FT.track_features(observations(spark, sf_dir)), COLUMNS))


@query("histogram", f"""SELECT CAST(least(floor((Dist - mn) / ((mx - mn) / 40)), 39) AS INT) AS bin, count(*) AS n,
 min(Dist) AS smallest, max(Dist) AS largest FROM (SELECT Dist, min(Dist) OVER () AS mn, max(Dist) OVER () AS mx
 FROM ({WITH_TRACKS} SELECT * FROM tracks) t) q GROUP BY 1""", "smallest largest", "bin n")
def histogram(spark, sf_dir):
    return rounded(ST.histogram(observations(spark, sf_dir).select("Dist"), "Dist", 40))


_QS = [0.05, 0.1, 0.2, 0.25, 0.75, 0.8, 0.9]


@query("percentiles", f"""WITH t AS ({WITH_TRACKS} SELECT Dist FROM tracks) """ + " UNION ALL ".join(
    f"SELECT CAST({q} AS DOUBLE) AS q, quantile_cont(Dist, {q}) AS value FROM t" for q in _QS), "q value")
def percentiles(spark, sf_dir):
    return rounded(ST.percentiles(observations(spark, sf_dir).select("Dist"), "Dist", _QS))


@query("label_counts", f"{WITH_TRACKS} SELECT serum, count(*) AS n FROM tracks GROUP BY serum", "", "serum n")
def label_counts(spark, sf_dir):
    return ST.value_counts(observations(spark, sf_dir), "serum")


_SHELL = "CAST(least(floor(Dist / 12), 4) AS INT)"


@query("shell_shares", f"""SELECT serum, bucket, n, n / sum(n) OVER (PARTITION BY serum) AS share FROM
 (SELECT serum, {_SHELL} AS bucket, count(*) AS n FROM ({WITH_TRACKS} SELECT * FROM tracks) t GROUP BY 1, 2) q""",
       "share", "serum bucket n")
def shell_shares(spark, sf_dir):
    shell = F.least(F.floor(F.col("Dist") / 12), F.lit(4)).cast("int")
    return rounded(ST.column_shares(observations(spark, sf_dir), "serum", shell))


@query("null_audit", f"""{WITH_TRACKS} SELECT count(*) AS n_rows, count(DISTINCT serum) AS n_classes,
 {", ".join(f"count(*) FILTER ({c} IS NULL) AS missing_{c}" for c in [*OBSERVED, "comment"])} FROM tracks""", "",
       "n_rows n_classes " + " ".join(f"missing_{c}" for c in [*OBSERVED, "comment"]))
def null_audit(spark, sf_dir):
    return ST.missing_counts(observations(spark, sf_dir), [*OBSERVED, "comment"], "serum")


@query("dist_by_group", f"""SELECT chromosome, time, n, mean, low, mid, high FROM (SELECT substring(guide, 4, 4) AS chromosome,
 time, count(*) AS n, avg(Dist) AS mean, quantile_cont(Dist, 0.25) AS low, quantile_cont(Dist, 0.5) AS mid,
 quantile_cont(Dist, 0.75) AS high FROM ({WITH_TRACKS} SELECT * FROM tracks) t GROUP BY 1, 2) q""",
       "mean low mid high", "chromosome time n")
def dist_by_group(spark, sf_dir):
    rows = observations(spark, sf_dir).select(F.substring("guide", 4, 4).alias("chromosome"), "time", "Dist")
    by = ["chromosome", "time"]
    means = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("Dist").alias("mean"))
    quartiles = ST.percentiles(rows, "Dist", [0.25, 0.5, 0.75], by).groupBy(*by).agg(
        *[F.max(F.when(F.col("q") == q, F.col("value"))).alias(c) for q, c in ((0.25, "low"), (0.5, "mid"), (0.75, "high"))]
    )
    return rounded(means.join(quartiles, by))


@query("scalar_math", f"""{WITH_TRACKS} SELECT file, particle, frame, sqrt(abs(x_micron)) AS root, pow(x_micron, 2) AS square,
 atan(x_micron) AS arc, atan2(y_micron, x_micron) AS direction, radians(x_micron) AS radian, abs(x_micron - y_micron) AS gap,
 CASE WHEN x_micron > y_micron THEN 1 ELSE 0 END AS above, CAST(trunc(x_micron) AS INT) AS whole FROM tracks""",
       "root square arc direction radian gap", "file particle frame above whole")
def scalar_functions(spark, sf_dir):
    rows = observations(spark, sf_dir).select(*TRACK, "frame", "x_micron", "y_micron")
    return rounded(scalar_math(rows, "x_micron", "y_micron").drop("x_micron", "y_micron"))


@query("before_after", f"""{FEATURES_CTE} SELECT file, particle, MD, CASE WHEN time = 0 THEN 'before' ELSE 'after' END AS condition
 FROM features WHERE time < 40""", "MD", "file particle condition")
def before_after(spark, sf_dir):
    tracks = FT.track_table(observations(spark, sf_dir), ("time",))
    return rounded(ST.before_after(tracks, "MD"))


# panels ---------------------------------------------------------------------------------------------------------------

MODAL_SQL = f"""{LENGTHS_SQL}, best AS (SELECT nframes FROM sized GROUP BY nframes ORDER BY count(*) DESC, nframes LIMIT 1),
 modal AS (SELECT sized.* FROM sized JOIN best ON sized.nframes = best.nframes)"""


@query("panel_modal", f"{MODAL_SQL} SELECT * FROM modal", "D Dist", "file particle frame nframes")
def panel_modal(spark, sf_dir):
    return rounded(P.modal_tracks(observations(spark, sf_dir).select(*TRACK, "frame", "D", "Dist")))


def _text(column: str):
    """An array of doubles as text of whole millionths, so arrays compare across engines."""
    return F.array_join(F.transform(column, lambda v: F.round(v * 1e6).cast("long").cast("string")), ",", "-")


def _text_sql(column: str) -> str:
    whole = f"coalesce(CAST(CAST(round({column} * 1e6) AS BIGINT) AS VARCHAR), '-')"
    return f"string_agg({whole}, ',' ORDER BY frame)"


_NESTED = """ {fp} AS fp, 0 AS chunk, CAST(trunc(max(serum_conc_percent) / 10) AS INT) AS class, arg_max(file, frame) AS "group",
 CAST(count(*) AS INT) AS length"""
_FP_SQL = "CAST(file AS VARCHAR) || '__' || particle"


@query("panel_nested", f"""{MODAL_SQL} SELECT {_NESTED.format(fp=_FP_SQL)}, {_text_sql("Dist")} AS Dist, {_text_sql("D")} AS D
 FROM modal GROUP BY file, particle""", "", 'fp chunk class "group" length Dist D')
def panel_nested(spark, sf_dir):
    rows = observations(spark, sf_dir).select(*TRACK, "frame", "D", "Dist", "serum_conc_percent")
    series = P.nested(P.modal_tracks(rows), ["Dist", "D"])
    return series.withColumns({c: _text(c) for c in ("Dist", "D")})


@query("panel_dense", f"""WITH m AS ({MODAL_SQL} SELECT * FROM modal) """ + " UNION ALL ".join(
    f"SELECT {_FP_SQL} AS fp, 0 AS chunk, '{c}' AS feature, CAST(trunc(max(serum_conc_percent) / 10) AS INT) AS class, "
    f'arg_max(file, frame) AS "group", {_text_sql(c)} AS series FROM m GROUP BY file, particle'
    for c in ("x_micron", "y_micron", "Dist")), "", 'fp chunk feature class "group" series')
def panel_dense(spark, sf_dir):
    values = ["x_micron", "y_micron", "Dist"]
    rows = observations(spark, sf_dir).select(*TRACK, "frame", *values, "serum_conc_percent")
    return P.dense(P.modal_tracks(rows), values).withColumn("series", _text("series"))


def _wide(names: Sequence[str], rows: str, keys: str, width: int = 32) -> str:
    """Twin of a table of blocks of frames: each place of a block by its own filter, an absent one as '-'."""

    def places(measure: str) -> str:
        value = "CASE WHEN frame <> 0 THEN D END" if measure == "D" else measure
        each = [f"coalesce(CAST(CAST(round(max({value}) FILTER (frame % {width} = {i}) * 1e6) AS BIGINT) AS VARCHAR), '-')" for i in range(width)]
        return f"concat_ws(',', {', '.join(each)}) AS {measure}"

    return f"""SELECT {keys}, CAST(frame // {width} * {width} AS INT) AS first_frame, {", ".join(map(places, names))}
 FROM {rows} GROUP BY ALL"""


@registered("wide_by_frame", f"{WITH_TRACKS} {_wide(('D', 'Dist'), 'tracks', 'file, particle')}")
def wide_by_frame(spark, sf_dir):
    """The first difference of a track does not exist, so ``D`` has no place at frame 0."""
    blocks = P.wide_blocks(observations(spark, sf_dir), ["D", "Dist"], without=[("D", 0)])
    return blocks.withColumns({c: _text(c) for c in ("D", "Dist")})


@registered("features_join_wide", f"""{FEATURES_CTE}, long AS (SELECT f.file, f.particle, f.serum, {settled("f.MD")} AS MD,
 {settled("f.Pers")} AS Pers, t.frame, t.Dist FROM features f JOIN tracks t ON f.file = t.file AND f.particle = t.particle WHERE f.n >= {SHORT})
 {_wide(('Dist',), 'long', 'file, particle, serum, MD, Pers')}""")
def features_join_wide(spark, sf_dir):
    rows = observations(spark, sf_dir)
    short = K.short_tracks(rows, SHORT)
    tracks = FT.track_table(rows).select(*TRACK, "serum", "MD", "Pers").join(short, TRACK, "left_anti")
    wide = P.wide_blocks(rows, ["Dist"]).withColumn("Dist", _text("Dist"))
    return rounded(tracks.join(wide, TRACK))


@query("scale_by_series", f"""{WITH_TRACKS} SELECT file, particle, frame,
 (Dist - avg(Dist) OVER t) / nullif(stddev_pop(Dist) OVER t, 0) AS Dist, (A - avg(A) OVER t) / nullif(stddev_pop(A) OVER t, 0) AS A
 FROM tracks WINDOW t AS (PARTITION BY file, particle)""", "Dist A", "file particle frame")
def scale_by_series(spark, sf_dir):
    return rounded(P.scale_by_series(observations(spark, sf_dir).select(*TRACK, "frame", "Dist", "A"), ["Dist", "A"]))


@query("max_scale", f"""SELECT file, particle, MD / max(MD) OVER () AS MD, MA / max(MA) OVER () AS MA FROM ({FEATURES_CTE}
 SELECT * FROM features) f""", "MD MA", "file particle")
def max_scale(spark, sf_dir):
    tracks = observations(spark, sf_dir).groupBy(*TRACK).agg(F.avg("D").alias("MD"), F.avg("A").alias("MA"))
    return rounded(P.max_scaled(tracks, ["MD", "MA"]))


@query("impute_mean", f"""SELECT file, particle, frame, coalesce(D, avg(D) OVER ()) AS D FROM ({WITH_TRACKS} SELECT * FROM tracks) t""",
       "D", "file particle frame")
def impute_mean(spark, sf_dir):
    return rounded(P.impute_mean(observations(spark, sf_dir).select(*TRACK, "frame", "D"), ["D"]))


@query("one_hot", f"""{FEATURES_CTE} SELECT file, particle, serum, CASE WHEN serum = 0 THEN 1 ELSE 0 END AS serum_0,
 CASE WHEN serum = 1 THEN 1 ELSE 0 END AS serum_1, serum AS back FROM features""", "", "file particle serum serum_0 serum_1 back")
def one_hot(spark, sf_dir):
    tracks = observations(spark, sf_dir).groupBy(*TRACK).agg(F.max(P.label_from_percent()).alias("serum"))
    return P.decoded(P.one_hot(tracks, "serum", [0, 1]), {0: "serum_0", 1: "serum_1"}, "back")


# folds ----------------------------------------------------------------------------------------------------------------

FOLDS_SQL = f"""tf AS ({WITH_TRACKS} SELECT file, count(*) AS n_rows, CASE WHEN avg(serum) > 0.5 THEN 1 ELSE 0 END AS serum FROM tracks
 GROUP BY file), folds AS (SELECT r.repeat_no, file, serum, n_rows, CAST((row_number() OVER (PARTITION BY r.repeat_no, serum
 ORDER BY md5('7|' || CAST(r.repeat_no AS VARCHAR) || '|' || CAST(file AS VARCHAR)), file) - 1) % 4 AS INT) AS fold
 FROM tf, (SELECT CAST(unnest(range(2)) AS INT) AS repeat_no) r)"""


@query("sgkf_assign", f"WITH {FOLDS_SQL} SELECT * FROM folds", "", "repeat_no file serum n_rows fold")
def sgkf_assign(spark, sf_dir):
    return FO.stratified_group_folds(observations(spark, sf_dir), repeats=2)


@query("sgkf_by_rows", f"""WITH {FOLDS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY repeat_no, serum ORDER BY n_rows DESC,
 md5('7|' || CAST(repeat_no AS VARCHAR) || '|' || CAST(file AS VARCHAR)), file) - 1 AS rk FROM folds) SELECT repeat_no, file,
 serum, n_rows, CAST(CASE WHEN (rk // 4) % 2 = 0 THEN rk % 4 ELSE 3 - rk % 4 END AS INT) AS fold2 FROM r""", "",
       "repeat_no file serum n_rows fold2")
def sgkf_by_rows(spark, sf_dir):
    folds = FO.stratified_group_folds(observations(spark, sf_dir), repeats=2, balance="rows")
    return folds.withColumnRenamed("fold", "fold2")


@query("gkf_assign", f"""WITH {FOLDS_SQL}, r AS (SELECT file, n_rows, row_number() OVER (ORDER BY n_rows DESC,
 md5('0|0|' || CAST(file AS VARCHAR)), file) - 1 AS rk FROM tf) SELECT file, n_rows,
 CAST(CASE WHEN (rk // 4) % 2 = 0 THEN rk % 4 ELSE 3 - rk % 4 END AS INT) AS fold FROM r""", "", "file n_rows fold")
def gkf_assign(spark, sf_dir):
    return FO.group_folds(observations(spark, sf_dir))


@query("group_shuffle_split", f"""WITH {FOLDS_SQL}, s AS (SELECT CAST(unnest(range(20)) AS INT) AS split), r AS (
 SELECT split, file, row_number() OVER (PARTITION BY split ORDER BY md5('7|' || CAST(split AS VARCHAR) || '|' ||
 CAST(file AS VARCHAR)), file) - 1 AS rk, count(*) OVER (PARTITION BY split) AS n FROM tf, s)
 SELECT split, file, CASE WHEN rk < ceil(n * 0.25) THEN 1 ELSE 0 END AS is_test FROM r""", "", "split file is_test")
def group_shuffle_split(spark, sf_dir):
    return FO.group_shuffle_splits(observations(spark, sf_dir))


@query("logo_assign", f"""WITH {FOLDS_SQL} SELECT file, row_number() OVER (ORDER BY md5('0|0|' || CAST(file AS VARCHAR)), file) - 1
 AS fold FROM tf""", "", "file fold")
def logo_assign(spark, sf_dir):
    return FO.leave_one_group_out(observations(spark, sf_dir))


def folded_tracks(spark, sf_dir, repeats: int = 1, **keep) -> DataFrame:
    """Track aggregates with the fold of their file."""
    rows = observations(spark, sf_dir)
    tracks = FT.track_table(rows)
    return FO.with_fold(tracks, FO.stratified_group_folds(rows, repeats=repeats), ("particle",))


@query("scale_by_train_fold", f"""WITH {FOLDS_SQL}, rows_ AS (SELECT t.file, t.particle, t.frame, t.Dist, t.A, f.fold FROM
 ({WITH_TRACKS} SELECT * FROM tracks) t JOIN folds f ON t.file = f.file WHERE f.repeat_no = 0),
 stats AS (SELECT k.fold, avg(Dist) AS md, stddev_pop(Dist) AS sd, avg(A) AS ma, stddev_pop(A) AS sa FROM rows_ r JOIN
 (SELECT DISTINCT fold FROM rows_) k ON r.fold <> k.fold GROUP BY k.fold)
 SELECT file, particle, frame, r.fold, (Dist - md) / sd AS Dist, (A - ma) / sa AS A FROM rows_ r JOIN stats s ON r.fold = s.fold""",
       "Dist A", "file particle frame fold")
def scale_by_train_fold(spark, sf_dir):
    rows = observations(spark, sf_dir)
    folded = FO.with_fold(
        rows.select(*TRACK, "frame", "Dist", "A"), FO.stratified_group_folds(rows).drop("repeat_no"), ("particle", "frame")
    )
    return rounded(P.scale_held_out(folded, ["Dist", "A"]))


@query("scale_features", f"""WITH {FOLDS_SQL}, rows_ AS (SELECT t.file, t.particle, t.MD, t.MA, f.fold FROM
 ({FEATURES_CTE} SELECT * FROM features) t JOIN folds f ON t.file = f.file WHERE f.repeat_no = 0),
 stats AS (SELECT k.fold, avg(MD) AS md_, stddev_pop(MD) AS sd, avg(MA) AS ma_, stddev_pop(MA) AS sa FROM rows_ r JOIN
 (SELECT DISTINCT fold FROM rows_) k ON r.fold <> k.fold GROUP BY k.fold)
 SELECT file, particle, r.fold, (MD - md_) / sd AS MD, (MA - ma_) / sa AS MA FROM rows_ r JOIN stats s ON r.fold = s.fold""",
       "MD MA", "file particle fold")
def scale_features(spark, sf_dir):
    tracks = folded_tracks(spark, sf_dir).select(*TRACK, "fold", "MD", "MA")
    return rounded(P.scale_held_out(tracks, ["MD", "MA"]))


#: every single feature, and every family
_KNOCK = {**{c: [c] for c in FEATURES}, **{f"family_{n}": list(cs) for n, cs in FEATURE_FAMILIES.items()}}


def _knocked_sql() -> str:
    """Twin by definition: a column is 0 in the rows of each knock-out that names it."""
    columns = []
    for c in FEATURES:
        value = f"CASE WHEN isnan(CAST({c} AS DOUBLE)) THEN NULL ELSE CAST({c} AS DOUBLE) END"
        out = ", ".join(f"'{k}'" for k, cs in _KNOCK.items() if c in cs)
        columns.append(f"CASE WHEN knockout IN ({out}) THEN 0 ELSE {value} END AS {c}")
    names = ", ".join(f"'{k}'" for k in _KNOCK)
    return f"""WITH f AS ({FEATURES_CTE} SELECT * FROM features), k AS (SELECT unnest([{names}]) AS knockout)
 SELECT knockout, file, particle, {", ".join(columns)} FROM f, k"""


@query("knockout_matrix", _knocked_sql(), " ".join(FEATURES), "knockout file particle")
def knockout_matrix(spark, sf_dir):
    tracks = FT.track_features(observations(spark, sf_dir)).select(*TRACK, *[F.col(c).cast("double").alias(c) for c in FEATURES])
    return rounded(S.knocked_out(tracks, FEATURES, _KNOCK))
