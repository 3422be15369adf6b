"""Registry: every query of the library by name, as Spark plan and, where SQL can say it, as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapart.functions import landcover as lf
from terrapart.functions import vectors
from terrapart.operators import analysis as an
from terrapart.operators import graph as gr
from terrapart.operators import landcover as lc
from terrapart.operators import pheromone as ph
from terrapart.operators import raster as ra
from terrapart.plans import fixtures as fx
from terrapart.plans.fixtures import with_views

Query = Callable[[SparkSession, str], DataFrame]
ENTRIES: dict[str, tuple[Query, str | None]] = {}

KEY = an.CONFIG
KEY_SQL = ", ".join(KEY)
TIE_SQL = ", ".join(f"{c} NULLS LAST" for c in KEY)
CFG_SQL = " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in KEY)
SHIFT = 3.7e-10
#: The run table cleaned, and its summary, as SQL.
CLEAN_SQL = f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {KEY_SQL}, seed ORDER BY logged DESC, best_fitness DESC) AS rn FROM fx_runs) WHERE rn = 1"
SUMMARY_SQL = f"SELECT {KEY_SQL}, count(*) AS n_runs, round(avg(best_fitness) + 3.7e-13, 9) AS fit, round(avg(eco) + 3.7e-13, 9) AS eco FROM ({CLEAN_SQL}) GROUP BY {KEY_SQL}"


def register(name: str, query: Query, sql: str | None = None) -> None:
    ENTRIES[name] = (query, with_views(sql).replace(", 6)", f" + {SHIFT}, 6)") if sql else None)


def rounded(rows: DataFrame) -> DataFrame:
    """Doubles to six digits and integers as long, so that sums in any order compare equal.

    A small shift keeps values that stand exactly between two roundings on one side in both engines.
    """
    out = {}
    for f in rows.schema:
        if f.dataType.typeName() in ("double", "float"):
            out[f.name] = F.round(F.col(f"`{f.name}`").cast("double") + SHIFT, 6)
        elif f.dataType.typeName() in ("integer", "short", "byte"):
            out[f.name] = F.col(f"`{f.name}`").cast("long")
    return rows.withColumns(out) if out else rows


def r6(*columns: str) -> str:
    """SQL: each expression AS its name, rounded. A column may be 'expression AS name' or a name."""
    parts = []
    for c in columns:
        expression, _, name = c.rpartition(" AS ")
        parts.append(f"round(({expression or name})::DOUBLE, 6) AS {name}")
    return ", ".join(parts)


def clean_runs(spark: SparkSession, d: str) -> DataFrame:
    return an.keep_one(fx.runs(spark, d), [*KEY, "seed"], ["logged", "best_fitness"])


def summary(spark: SparkSession, d: str) -> DataFrame:
    """Means by configuration, to nine digits so that equal means are ties in both engines."""
    mean = lambda c: F.round(F.avg(c) + 3.7e-13, 9)
    return clean_runs(spark, d).groupBy(*KEY).agg(F.count("*").alias("n_runs"), mean("best_fitness").alias("fit"), mean("eco").alias("eco"))


# --- land cover ---------------------------------------------------------------------------------------------

ENTROPY_SQL = """
counts AS (SELECT cluster, {cls} AS k, count(*) AS n FROM {source} WHERE {where} GROUP BY ALL),
props AS (SELECT *, n / sum(n) OVER (PARTITION BY cluster) AS p, sum(n) OVER (PARTITION BY cluster) AS total FROM counts),
{name} AS (SELECT cluster, -sum(p * ln(p + 1e-12)) AS h, count(k) AS n_classes, 1 - sum(p * p) AS simpson, max(p) AS share, any_value(total)::BIGINT AS total,
  arg_max(k, (p, -rk)) AS dominant, CASE WHEN count(k) > 1 THEN -sum(p * ln(p + 1e-12)) / ln(count(k)) ELSE 0 END AS hn
  FROM (SELECT *, rank() OVER (PARTITION BY cluster ORDER BY k NULLS LAST) AS rk FROM props) GROUP BY cluster)
"""


def entropy_sql(name: str, cls: str, where: str = "true", source: str = "fx_cover") -> str:
    text = ENTROPY_SQL.format(name=name, cls=cls, where=where, source=source)
    return text.replace("counts", f"counts_{name}").replace("props", f"props_{name}").strip()


CONSISTENCY_SQL = f"""WITH {entropy_sql('a', 'agriculture_class', "comp = 'agriculture' AND agriculture_class IS NOT NULL")},
{entropy_sql('b', 'natural_class', "comp = 'natural'")},
c AS (SELECT cluster, count(*) FILTER (comp = 'agriculture') AS agriculture, count(*) FILTER (comp = 'natural') AS "natural",
  count(*) FILTER (comp = 'artificial') AS artificial, count(*) FILTER (comp = 'excluded') AS excluded, count(*) AS total_pixels FROM fx_cover GROUP BY cluster),
per AS (SELECT c.*, agriculture + "natural" AS scored, coalesce(1 - a.hn, 0) AS ga, coalesce(1 - b.hn, 0) AS gn, a.dominant AS da, b.dominant AS dn,
  CASE WHEN agriculture + "natural" > 0 THEN (agriculture * coalesce(1 - a.hn, 0) + "natural" * coalesce(1 - b.hn, 0)) / (agriculture + "natural") END AS e,
  artificial / total_pixels AS art FROM c LEFT JOIN a USING (cluster) LEFT JOIN b USING (cluster))"""


def consistency(spark: SparkSession, d: str) -> DataFrame:
    keep = ["cluster", "agriculture", "natural", "artificial", "excluded", "valid_scored_pixels", "agriculture_homogeneity", "natural_homogeneity", "agriculture_dominant_class", "natural_dominant_class", "combined_ecological_consistency"]
    return rounded(lc.consistency(fx.landcover(spark, d)).select(*keep))


register("landcover_consistency", consistency, CONSISTENCY_SQL + f"""
SELECT cluster, agriculture, "natural", artificial, excluded, scored AS valid_scored_pixels, {r6('ga AS agriculture_homogeneity', 'gn AS natural_homogeneity', 'e AS combined_ecological_consistency')},
  da AS agriculture_dominant_class, dn AS natural_dominant_class FROM per""")
register(
    "landcover_overall",
    lambda s, d: rounded(lc.overall_consistency(lc.consistency(fx.landcover(s, d)))),
    CONSISTENCY_SQL + "\nSELECT " + r6(*[f"{f} AS {p}_{n}" for n, c in (("combined_ecological_consistency", "e"), ("agriculture_homogeneity", "ga"), ("natural_homogeneity", "gn"), ("artificial_share_total", "art")) for p, f in (("mean", f"avg({c})"), ("weighted", f"sum(scored * {c}) / (sum(scored) + 1e-12)"))]) + " FROM per WHERE e IS NOT NULL",
)


def evaluated(spark: SparkSession, d: str) -> DataFrame:
    """Labels of superpixels to pixels, joined with a cover of the same lattice."""
    px = fx.pixels(spark, d).withColumnRenamed("superpixel", "node_id").drop("cluster")
    labels = px.select("node_id").distinct().withColumn("label", F.col("node_id") % 5)
    cover = px.select("row", "col", (F.col("node_id") % 50).cast("int").alias("clc_class"))
    return rounded(lc.evaluate_labels(px, labels, cover)[1])


register("evaluate_label_set", evaluated, CONSISTENCY_SQL.replace("fx_cover", "cover").replace("WITH ", """WITH cover AS (SELECT cluster, clc_group, comp,
  CASE WHEN comp = 'agriculture' THEN 'CLC_' || clc_class END AS agriculture_class, CASE WHEN comp = 'natural' THEN clc_group END AS natural_class FROM
  (SELECT *, CASE WHEN clc_group = 'Agriculture' THEN 'agriculture' WHEN clc_group = 'Artificial' THEN 'artificial' WHEN clc_group = 'Unknown' THEN 'excluded' ELSE 'natural' END AS comp FROM
  (SELECT superpixel % 5 AS cluster, superpixel % 50 AS clc_class, CASE WHEN clc_class <= 11 THEN 'Artificial' WHEN clc_class <= 22 THEN 'Agriculture' WHEN clc_class = 23 THEN 'Broadleaf_forest'
   WHEN clc_class = 24 THEN 'Coniferous_forest' WHEN clc_class = 25 THEN 'Mixed_forest' WHEN clc_class <= 29 THEN 'Shrubland' WHEN clc_class <= 34 THEN 'Grassland_Bare' WHEN clc_class <= 39 THEN 'Wetlands'
   WHEN clc_class <= 44 THEN 'Water' ELSE 'Unknown' END AS clc_group FROM fx_pixels WHERE superpixel % 50 NOT IN (0, 999)))), """, 1) + "\nSELECT " + r6(*[f"{f} AS {p}_{n}" for n, c in (("combined_ecological_consistency", "e"), ("agriculture_homogeneity", "ga"), ("natural_homogeneity", "gn"), ("artificial_share_total", "art")) for p, f in (("mean", f"avg({c})"), ("weighted", f"sum(scored * {c}) / (sum(scored) + 1e-12)"))]) + " FROM per WHERE e IS NOT NULL")  # fmt: skip

QUALITY_SELECT = "SELECT cluster, n_classes, dominant AS dominant_class, total AS cluster_total, " + r6("h AS shannon_entropy", "hn AS normalized_entropy", "simpson AS simpson_diversity", "share AS dominant_class_share") + " FROM q"
NATURAL_ONLY = "clc_group NOT IN ('Artificial', 'Agriculture', 'Unknown', 'NODATA')"
SUMMARY_SELECT = "SELECT " + r6(*[f"{f} AS {p}_{n}" for n, c in (("dominant_class_share", "share"), ("normalized_entropy", "hn"), ("simpson_diversity", "simpson")) for p, f in (("mean", f"avg({c})"), ("weighted", f"sum(total * {c}) / (sum(total) + 1e-12)"))]) + " FROM q"
QUALITY = ["cluster", "n_classes", "dominant_class", "cluster_total", "shannon_entropy", "normalized_entropy", "simpson_diversity", "dominant_class_share"]
register("landcover_quality", lambda s, d: rounded(lc.quality(fx.landcover(s, d)).select(*QUALITY)), f"WITH {entropy_sql('q', 'clc_group')} {QUALITY_SELECT}")
register(
    "landcover_quality_natural_only",
    lambda s, d: rounded(lc.quality_report(fx.landcover(s, d), exclude=["Artificial", "Agriculture", "Unknown", "NODATA"])[1].select(*QUALITY)),
    f"WITH {entropy_sql('q', 'clc_group', NATURAL_ONLY)} {QUALITY_SELECT}",
)
register("landcover_summary", lambda s, d: rounded(lc.overall_homogeneity(lc.quality(fx.landcover(s, d)))), f"WITH {entropy_sql('q', 'clc_group')} {SUMMARY_SELECT}")
register("class_counts", lambda s, d: rounded(lc.class_counts(fx.landcover(s, d))), "SELECT cluster, clc_group, count(*) AS count, sum(count(*)) OVER (PARTITION BY cluster)::BIGINT AS cluster_total, round(count(*) / sum(count(*)) OVER (PARTITION BY cluster), 6) AS proportion FROM fx_cover GROUP BY cluster, clc_group")
register(
    "homogeneity_subset",
    lambda s, d: rounded(lc.homogeneity(fx.landcover(s, d), "cluster", "natural_class").select("cluster", "n_classes", "normalized_entropy", "homogeneity")),
    f"WITH {entropy_sql('q', 'natural_class', 'natural_class IS NOT NULL')} SELECT cluster, n_classes, {r6('hn AS normalized_entropy', '1 - hn AS homogeneity')} FROM q",
)
register("cluster_distribution", lambda s, d: rounded(lc.cluster_distribution(fx.landcover(s, d), 1)), "SELECT clc_group, round(count(*) / sum(count(*)) OVER (), 6) AS proportion FROM fx_cover WHERE cluster = 1 GROUP BY clc_group")
COMPONENT_SQL = ", ".join(f"count(*) FILTER (comp = '{c}') AS \"{c}\"" for c in lc.COMPONENTS)
for how in ("none", "index", "columns", "all"):
    cells = {
        "none": lambda c: f"count(*) FILTER (comp = '{c}') AS \"{c}\"",
        "index": lambda c: f"round(count(*) FILTER (comp = '{c}') / count(*), 6) AS \"{c}\"",
        "columns": lambda c: f"round(count(*) FILTER (comp = '{c}') / sum(count(*) FILTER (comp = '{c}')) OVER (), 6) AS \"{c}\"",
        "all": lambda c: f"round(count(*) FILTER (comp = '{c}') / sum(count(*)) OVER (), 6) AS \"{c}\"",
    }[how]
    register(
        f"contingency_{how}",
        lambda s, d, how=how: rounded(lc.contingency(fx.landcover(s, d), None if how == "none" else how, cls="land_use_component", classes=lc.COMPONENTS)),
        f"SELECT cluster, {', '.join(map(cells, lc.COMPONENTS))} FROM fx_cover GROUP BY cluster",
    )
register(
    "component_pivot",
    lambda s, d: rounded(lc.component_pivot(fx.landcover(s, d))),
    f"""WITH c AS (SELECT cluster, {COMPONENT_SQL} FROM fx_cover GROUP BY cluster), t AS (SELECT *, agriculture + "natural" + artificial + excluded AS total_pixels, agriculture + "natural" AS valid_scored_pixels FROM c)
SELECT *, {r6('agriculture / nullif(total_pixels, 0) AS agriculture_share_total', '"natural" / nullif(total_pixels, 0) AS natural_share_total', 'artificial / nullif(total_pixels, 0) AS artificial_share_total',
    'agriculture / nullif(valid_scored_pixels, 0) AS agriculture_weight_scored', '"natural" / nullif(valid_scored_pixels, 0) AS natural_weight_scored')} FROM t""",
)
register("majority_class", lambda s, d: lc.majority_class(fx.pixels(s, d), "superpixel", "koppen_class"), "SELECT superpixel, koppen_class FROM (SELECT *, row_number() OVER (PARTITION BY superpixel ORDER BY n DESC, koppen_class) AS rn FROM (SELECT superpixel, koppen_class, count(*) AS n FROM fx_pixels GROUP BY superpixel, koppen_class)) WHERE rn = 1")
register("dense_class_ids", lambda s, d: lc.dense_ids(fx.pixels(s, d), "koppen_class"), "SELECT koppen_class, dense_rank() OVER (ORDER BY koppen_class) - 1 AS class_id FROM (SELECT DISTINCT koppen_class FROM fx_pixels)")
register("largest_cluster_share", lambda s, d: rounded(lc.largest_cluster_share(fx.pixels(s, d))), "SELECT round(max(n) / sum(n), 6) AS largest_cluster_share, count(*) AS n_clusters FROM (SELECT cluster, count(*) AS n FROM fx_pixels GROUP BY cluster)")
register("pooled_std_ratio", lambda s, d: rounded(lc.pooled_std(fx.pixels(s, d), "value")), f"SELECT {r6('p AS pooled_std', 'g AS global_std', 'p / g AS std_ratio')} FROM (SELECT sum(n * s) / sum(n) AS p FROM (SELECT count(*) AS n, stddev_pop(value) AS s FROM fx_pixels GROUP BY cluster)), (SELECT stddev_pop(value) AS g FROM fx_pixels)")
register("high_value_concentration", lambda s, d: rounded(lc.high_value_concentration(fx.pixels(s, d), "value", 100.0)), f"SELECT arg_max(cluster, high / n) AS top_cluster, {r6('max(high / n) AS top_share', 'arg_max(high, high / n) / nullif(sum(high), 0) AS captured_share')} FROM (SELECT cluster, count(*) FILTER (value > 100) AS high, count(*) AS n FROM fx_pixels GROUP BY cluster)")


def legend_colors(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.legend(spark, d).withColumns({"r": F.col("clc_class") * 5, "g": F.col("clc_class") * 3, "b": F.col("clc_class")})
    return rounded(rows.select("clc_class", "clc_name", lf.hex_color(F.col("r"), F.col("g"), F.col("b")).alias("color")))


register("legend_colors", legend_colors, "SELECT DISTINCT p_size::BIGINT AS clc_class, CASE WHEN p_size % 2 = 0 THEN 'class_' || p_size END AS clc_name, '#' || lower(printf('%02x%02x%02x', p_size * 5, p_size * 3, p_size)) AS color FROM part")

# --- rasters and features -----------------------------------------------------------------------------------


def superpixel_entry(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.pixels(spark, d).filter("superpixel IS NOT NULL").withColumn("f", F.array("value", F.col("row").cast("double"), F.col("col").cast("double")))
    out = ra.superpixel_means(rows, "superpixel")
    return rounded(out.select("superpixel", "node_id", "weight", "r", "c", F.col("f")[0].alias("value")))


register("superpixel_aggregate", superpixel_entry, f"SELECT superpixel, row_number() OVER (ORDER BY superpixel) - 1 AS node_id, count(*)::DOUBLE AS weight, {r6('avg(row) AS r', 'avg(col) AS c', 'avg(value) AS value')} FROM fx_pixels GROUP BY superpixel")
register(
    "raster_grid",
    lambda s, d: ra.raster_grid(fx.pixels(s, d), "value").select(F.col("row").cast("long").alias("row"), F.size("values").cast("long").alias("width"), F.round(vectors.total(F.transform("values", lambda v: F.coalesce(v, F.lit(0.0)))), 6).alias("total")),
    "SELECT row, (SELECT max(col) + 1 FROM fx_pixels) AS width, round(sum(value), 6) AS total FROM fx_pixels GROUP BY row",
)
register("class_histogram", lambda s, d: rounded(ra.class_histogram(fx.pixels(s, d), "koppen_class", (0, 49), (10, 79))), "SELECT koppen_class, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM fx_pixels WHERE row BETWEEN 0 AND 49 AND col BETWEEN 10 AND 79 GROUP BY koppen_class")
register("band_stats", lambda s, d: rounded(ra.band_stats(fx.pixels(s, d), ["value", "col"])), " UNION ALL ".join(f"SELECT '{c}' AS band, count({c}) AS n, {r6(f'min({c}) AS min', f'max({c}) AS max', f'avg({c}) AS mean', f'stddev_pop({c}) AS std')} FROM fx_pixels" for c in ("value", "col")))
register("pixel_centres", lambda s, d: rounded(ra.pixel_centres(fx.pixels(s, d), 500.0, 900.0, 30.0, -30.0).select("row", "col", "easting", "northing")), f"SELECT row, col, {r6('500 + (col + 0.5) * 30 AS easting', '900 - (row + 0.5) * 30 AS northing')} FROM fx_pixels")


def sampled(spark: SparkSession, d: str) -> DataFrame:
    px = fx.pixels(spark, d)
    points = px.select((F.col("col") * 7.0 + 1.0).alias("easting"), (F.col("row") * 11.0 + 2.0).alias("northing"), F.col("row").alias("id_row"), F.col("col").alias("id_col"))
    return ra.sample_classes(points, px.withColumnRenamed("koppen_class", "cell_class"), 0.0, 0.0, 14.0, 22.0).select("id_row", "id_col", "cell_class")


register("sample_classes", sampled, "SELECT p.row AS id_row, p.col AS id_col, q.koppen_class AS cell_class FROM fx_pixels p LEFT JOIN fx_pixels q ON q.row = floor((p.row * 11 + 2) / 22)::BIGINT AND q.col = floor((p.col * 7 + 1) / 14)::BIGINT")


def resampled(spark: SparkSession, d: str) -> DataFrame:
    px = fx.pixels(spark, d)
    return rounded(ra.resample_bilinear(px.select("row", "col"), px.select("row", "col", "value"), 0.5, 0.25))


register("resample_bilinear", resampled, """WITH t AS (SELECT row, col, row * 0.5 + 0.25 AS y, col * 0.5 + 0.25 AS x FROM fx_pixels),
k AS (SELECT t.*, floor(y)::BIGINT + i AS r, floor(x)::BIGINT + j AS c FROM t, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j))
SELECT k.row, k.col, round(sum((1 - abs(y - r)) * (1 - abs(x - c)) * s.value) / sum((1 - abs(y - r)) * (1 - abs(x - c))), 6) AS value FROM k JOIN fx_pixels s ON s.row = r AND s.col = c GROUP BY k.row, k.col""")


def features_of(rows: DataFrame, more: bool) -> DataFrame:
    return rounded(ra.climate_features(rows, "temperature", "rain", more).drop("temperature", "rain"))


ROW_SQL = ["list_avg(temperature) AS temp_mean", "list_min(temperature) AS temp_min", "list_max(temperature) AS temp_max", "list_max(temperature) - list_min(temperature) AS temp_range",
           "list_avg(rain) AS precip_mean", "list_min(rain) AS precip_min", "list_max(rain) AS precip_max", "list_sum(rain) AS precip_total", "list_max(rain) - list_min(rain) AS precip_range"]
MORE_SQL = ["list_stddev_pop(temperature) AS temp_std", "list_stddev_pop(rain) AS precip_std", "list_sum(rain) / (list_avg(temperature) + 10 + 1e-12) AS dryness_index"]
register("koppen_features", lambda s, d: features_of(fx.climate(s, d), False), f"SELECT node_id, {r6(*ROW_SQL)} FROM fx_climate")
register("koppen_features_ext", lambda s, d: features_of(fx.climate(s, d), True), f"SELECT node_id, {r6(*ROW_SQL, *MORE_SQL)} FROM fx_climate")
register(
    "raw_features",
    lambda s, d: ra.raw_features(fx.pixels(s, d), ["value", "row"]).select("row", "col", F.round(vectors.total(F.col("f")), 6).alias("total"), F.size("f").cast("long").alias("n")),
    "SELECT row, col, round(value + row, 6) AS total, 2::BIGINT AS n FROM fx_pixels",
)
SCALED = ["value", "x"]


def for_scaling(spark: SparkSession, d: str) -> DataFrame:
    return fx.pixels(spark, d).select("row", "col", "value", F.col("col").cast("double").alias("x"))


register("standard_scale", lambda s, d: rounded(ra.standard_scale(for_scaling(s, d), SCALED)), f"SELECT row, col, {r6('(value - avg(value) OVER ()) / stddev_pop(value) OVER () AS value', '(col - avg(col) OVER ()) / stddev_pop(col) OVER () AS x')} FROM fx_pixels")
register("minmax_scale", lambda s, d: rounded(ra.minmax_scale(for_scaling(s, d), SCALED)), f"SELECT row, col, {r6('(value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()) AS value', '(col - min(col) OVER ()) / (max(col) OVER () - min(col) OVER ()) AS x')} FROM fx_pixels")
register("complete_rows", lambda s, d: ra.complete_rows(fx.pixels(s, d), ["value", "koppen_class"]).select("row", "col"), "SELECT row, col FROM fx_pixels WHERE value IS NOT NULL AND koppen_class IS NOT NULL")

# --- graphs and objectives ----------------------------------------------------------------------------------

KNN_SQL = "SELECT a.node_id AS src, b.node_id AS dst, {dist} AS dist FROM fx_nodes a JOIN fx_nodes b ON a.node_id <> b.node_id"
TOP_SQL = "SELECT src, rn AS rank, dst, dist FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rn FROM ({rows})) WHERE rn <= {k}"
PLACE = "sqrt((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c))"
SPACE_SQL = TOP_SQL.format(rows=KNN_SQL.format(dist=PLACE), k=16)
FEATURE_SQL = TOP_SQL.format(rows=KNN_SQL.format(dist="list_distance(a.f, b.f)"), k=20)
UNDIRECTED_SQL = "SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM {edges}"


def space_edges(s: SparkSession, d: str) -> DataFrame:
    return gr.knn_lattice(fx.nodes(s, d), 16)


def labels(s: SparkSession, d: str) -> DataFrame:
    return fx.nodes(s, d).select("node_id", "label")


register("knn_spatial", lambda s, d: rounded(space_edges(s, d)), f"WITH e AS ({SPACE_SQL}) SELECT src, rank, dst, round(dist, 6) AS dist FROM e")
register("knn_feature", lambda s, d: rounded(gr.knn_features(fx.nodes(s, d), 20)), f"WITH e AS ({FEATURE_SQL}) SELECT src, rank, dst, round(dist, 6) AS dist FROM e")
SNN_SQL = """WITH e AS ({edges}), n AS ({feature}), s AS (SELECT src, list(dst) AS l FROM n GROUP BY src), c AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e),
snn AS (SELECT a, b, len(list_intersect(x.l, y.l)) AS shared, len(list_intersect(x.l, y.l)) / 20 AS weight FROM c JOIN s x ON x.src = a JOIN s y ON y.src = b WHERE len(list_intersect(x.l, y.l)) >= 1)"""
SNN_SPACE_SQL = SNN_SQL.format(edges=SPACE_SQL, feature=FEATURE_SQL)


def snn(s: SparkSession, d: str) -> DataFrame:
    return gr.snn_graph(gr.knn_features(fx.nodes(s, d), 20), gr.undirected(space_edges(s, d)), 20)


def snn_by_feature(s: SparkSession, d: str) -> DataFrame:
    near = gr.knn_features(fx.nodes(s, d), 20)
    return rounded(gr.snn_graph(near, gr.undirected(near), 20))


register("snn_graph", lambda s, d: rounded(snn(s, d)), SNN_SPACE_SQL + " SELECT a, b, shared, round(weight, 6) AS weight FROM snn")
register("snn_graph_feature_candidates", snn_by_feature, SNN_SQL.format(edges=FEATURE_SQL, feature=FEATURE_SQL) + " SELECT a, b, shared, round(weight, 6) AS weight FROM snn")
LONG_SQL = "SELECT node_id, label, weight, unnest(range(64)) AS p, unnest(f) AS x FROM fx_nodes"
register("weighted_centroids", lambda s, d: rounded(gr.weighted_centroids(fx.nodes(s, d))), f"WITH l AS ({LONG_SQL}) SELECT label, p, round(sum(weight * x) / sum(weight), 6) AS value FROM l GROUP BY label, p")
COMPACT_SQL = f"""l AS ({LONG_SQL}), m AS (SELECT *, sum(weight * x) OVER (PARTITION BY label, p) / sum(weight) OVER (PARTITION BY label, p) AS c, sum(weight * x) OVER (PARTITION BY p) / sum(weight) OVER (PARTITION BY p) AS g FROM l),
compact AS (SELECT sum(weight * (x - c) * (x - c)) / (sum(weight * (x - g) * (x - g)) + 1e-12) AS term FROM m)"""
register("compactness", lambda s, d: rounded(gr.compactness(fx.nodes(s, d))), f"WITH {COMPACT_SQL} SELECT round(term, 6) AS compactness FROM compact")
DISAGREE_SQL = f"e AS ({SPACE_SQL}), dis AS (SELECT sum(CASE WHEN x.label <> y.label THEN 1.0::DOUBLE ELSE 0 END) / (count(*) + 1e-12) AS v FROM e JOIN fx_nodes x ON x.node_id = src JOIN fx_nodes y ON y.node_id = dst)"
register("disagreement_directed", lambda s, d: rounded(gr.disagreement(space_edges(s, d), labels(s, d))), f"WITH {DISAGREE_SQL} SELECT round(v, 6) AS disagreement FROM dis")
register("disagreement_symmetric", lambda s, d: rounded(gr.disagreement(space_edges(s, d), labels(s, d), True)), f"WITH {DISAGREE_SQL.replace('FROM e JOIN', f'FROM ({UNDIRECTED_SQL.format(edges='e')}) e JOIN').replace('= src', '= e.a').replace('= dst', '= e.b')} SELECT round(v, 6) AS disagreement FROM dis")
SAMPLE_SIZE = 100


def seeded(s: SparkSession, d: str) -> list[int] | None:
    return gr.seeded_sample(fx.nodes(s, d), SAMPLE_SIZE)


def draw_sql(n: int) -> str:
    """The seeded draw from ids 0 to n - 1, as a list."""
    return str(np.sort(np.random.default_rng(0).choice(n, size=SAMPLE_SIZE, replace=False)).tolist())


#: The draw for the numbers of nodes that the driver's tables have.
DRAWN_SQL = "list_contains(CASE (SELECT count(*) FROM fx_nodes) " + " ".join(f"WHEN {n} THEN {draw_sql(n)}" for n in (500, 2000)) + " END, node_id)"
SIL_SQL = """q AS (SELECT * FROM fx_nodes WHERE {where}), d AS (SELECT a.node_id, a.label, a.weight, b.label AS other, sum(b.weight * list_distance(a.f, b.f)) / sum(b.weight) AS m
  FROM q a JOIN q b ON a.node_id <> b.node_id GROUP BY ALL),
s AS (SELECT node_id, label, weight, max(m) FILTER (label = other) AS a, min(m) FILTER (label <> other) AS b FROM d GROUP BY ALL),
sil AS (SELECT *, CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) <= 0 THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM s),
silm AS (SELECT sum(weight * s) / sum(weight) AS mean, count(*) AS n FROM sil)"""
SIL_SELECT = "SELECT round(mean, 6) AS silhouette, round((1 - mean) / 2, 6) AS silhouette_term, n FROM silm"
SOME_SQL = SIL_SQL.format(where=DRAWN_SQL)
register("silhouette_full", lambda s, d: rounded(gr.silhouette_mean(gr.silhouette(fx.nodes(s, d)))), f"WITH {SIL_SQL.format(where='true')} {SIL_SELECT}")
register("silhouette_sampled", lambda s, d: rounded(gr.silhouette_mean(gr.silhouette(fx.nodes(s, d), seeded(s, d), fallback=False))), f"WITH {SOME_SQL} {SIL_SELECT}")


def with_lone_node(s: SparkSession, d: str) -> DataFrame:
    """Silhouettes of the draw with its smallest node alone in a cluster: it scores 0 and counts."""
    drawn = seeded(s, d)
    nodes = fx.nodes(s, d).withColumn("label", F.when(F.col("node_id") == drawn[0], 99).otherwise(F.col("label")).cast("long"))
    return rounded(gr.silhouette_mean(gr.silhouette(nodes, drawn, fallback=False)))


LONE_SQL = SOME_SQL.replace("SELECT * FROM fx_nodes", "SELECT * REPLACE (CASE WHEN node_id = min(node_id) OVER () THEN 99 ELSE label END AS label) FROM fx_nodes", 1)
register("silhouette_lone_node", with_lone_node, f"WITH {LONE_SQL} {SIL_SELECT}")
CUT_SQL = SNN_SPACE_SQL + ", cut AS (SELECT coalesce(sum(weight) FILTER (x.label = y.label), 0) AS internal, coalesce(sum(weight) FILTER (x.label <> y.label), 0) AS external, sum(snn.weight) AS total, count(*) AS edges FROM (SELECT a, b, weight FROM snn) snn JOIN (SELECT node_id, label FROM fx_nodes) x ON x.node_id = a JOIN (SELECT node_id, label FROM fx_nodes) y ON y.node_id = b)"
register("snn_cut", lambda s, d: rounded(gr.snn_cut(snn(s, d), labels(s, d))), CUT_SQL + f" SELECT {r6('internal', 'external', 'total', 'external / total AS cut')}, edges FROM cut")


def fitness(s: SparkSession, d: str, objective: str) -> DataFrame:
    nodes = fx.nodes(s, d)
    term = {
        "centroid": lambda: gr.compactness(nodes).withColumnRenamed("compactness", "t"),
        "silhouette": lambda: gr.silhouette_mean(gr.silhouette(nodes)).withColumnRenamed("silhouette_term", "t"),
        "snn": lambda: gr.snn_cut(snn(s, d), labels(s, d)).withColumnRenamed("cut", "t"),
    }[objective]()
    return rounded(gr.mixed_fitness(term, "t", gr.disagreement(space_edges(s, d), labels(s, d))))


FIT_SELECT = "SELECT round(0.7 * t + 0.3 * v, 6) AS fitness, round(t, 6) AS term, round(v, 6) AS spatial FROM dis, "
register("fitness_centroid", lambda s, d: fitness(s, d, "centroid"), f"WITH {COMPACT_SQL}, {DISAGREE_SQL} {FIT_SELECT} (SELECT term AS t FROM compact)")
register("fitness_silhouette", lambda s, d: fitness(s, d, "silhouette"), f"WITH {SIL_SQL.format(where='true')}, {DISAGREE_SQL} {FIT_SELECT} (SELECT (1 - mean) / 2 AS t FROM silm)")
register("fitness_snn", lambda s, d: fitness(s, d, "snn"), f"{CUT_SQL}, {DISAGREE_SQL.partition('), dis AS')[2].join(['dis AS', ''])} {FIT_SELECT} (SELECT external / total AS t FROM cut)")


def ari_entry(s: SparkSession, d: str) -> DataFrame:
    return rounded(gr.adjusted_rand(fx.nodes(s, d).withColumn("other", F.col("node_id") % 4), "label", "other"))


register("ari", ari_entry, """WITH n AS (SELECT label, node_id % 4 AS other, count(*)::DOUBLE AS n FROM fx_nodes GROUP BY ALL), t AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS m FROM n),
x AS (SELECT sum(n * (n - 1) / 2) AS a FROM (SELECT sum(n) AS n FROM n GROUP BY label)), y AS (SELECT sum(n * (n - 1) / 2) AS b FROM (SELECT sum(n) AS n FROM n GROUP BY other))
SELECT round((s - a * b / (m * (m - 1) / 2)) / ((a + b) / 2 - a * b / (m * (m - 1) / 2)), 6) AS ari FROM t, x, y""")

# --- pheromone and heuristics -------------------------------------------------------------------------------


def solutions(s: SparkSession, d: str) -> DataFrame:
    """Three labelings by arithmetic, with fitness 0.2, 0.4 and 0.5."""
    ants = F.explode(F.array(*[F.struct(F.lit(a).alias("ant"), F.lit(f).alias("fitness")) for a, f in enumerate((0.2, 0.4, 0.5))]))
    rows = fx.nodes(s, d).select("node_id", ants.alias("x")).select("node_id", "x.*")
    return rows.withColumn("label", ((F.col("node_id") * (F.col("ant") + 3) + F.col("ant")) % 5).cast("long"))


SOLUTIONS_SQL = "ants AS (SELECT node_id, ant, fitness, (node_id * (ant + 3) + ant) % 5 AS label FROM fx_nodes, (VALUES (0, 0.2::DOUBLE), (1, 0.4::DOUBLE), (2, 0.5::DOUBLE)) v(ant, fitness))"
AMOUNT_SQL = {
    "all_ants": "0.05 / (fitness + 1e-9)",
    "best_ant": "CASE WHEN ant = 0 THEN 0.05 / (fitness + 1e-9) ELSE 0 END",
    "quality_weighted": "0.05 * least(power((1.1 / 3 - fitness) / (1.1 / 3 - 0.2 + 1e-12) + 1e-12, 2), 1)",
}
UPDATES = {"all_ants": ph.update_all_ants, "best_ant": ph.update_best_ant, "quality_weighted": ph.update_quality_weighted}


def exploded(table: DataFrame, name: str = "tau") -> DataFrame:
    return rounded(table.select("node_id", F.posexplode(name).alias("label", name)))


register("pheromone_init", lambda s, d: exploded(ph.initial(fx.nodes(s, d), 5)), "SELECT node_id, unnest(range(5)) AS label, 0.2::DOUBLE AS tau FROM fx_nodes")
for rule, update in UPDATES.items():
    register(
        f"pheromone_{rule}",
        lambda s, d, update=update: exploded(update(ph.initial(fx.nodes(s, d), 5), solutions(s, d), 0.1, 0.05)),
        f"""WITH {SOLUTIONS_SQL}, dep AS (SELECT node_id, label, sum({AMOUNT_SQL[rule]}) AS a FROM ants GROUP BY ALL), g AS (SELECT node_id, unnest(range(5)) AS label FROM fx_nodes),
raw AS (SELECT g.node_id, g.label, least(greatest(0.2 * 0.9 + coalesce(a, 0), 1e-6), 1e6) AS t FROM g LEFT JOIN dep USING (node_id, label))
SELECT node_id, label, round(t / (sum(t) OVER (PARTITION BY node_id) + 1e-12), 6) AS tau FROM raw""",
    )
register("spatial_support", lambda s, d: rounded(gr.neighbour_support(space_edges(s, d), labels(s, d))), f"WITH e AS ({SPACE_SQL}) SELECT src, label, round(count(*) / sum(count(*)) OVER (PARTITION BY src), 6) AS support FROM e JOIN fx_nodes n ON n.node_id = e.dst GROUP BY src, label")
register("normalize_probabilities", lambda s, d: exploded(fx.nodes(s, d).select("node_id", vectors.normalize_probabilities(F.col("f")).alias("p")), "p"), """WITH v AS (SELECT node_id, unnest(range(64)) AS label, greatest(unnest(f), 0) AS x FROM fx_nodes), t AS (SELECT *, sum(x) OVER (PARTITION BY node_id) AS m FROM v)
SELECT node_id, label, round(CASE WHEN m <= 1e-15 THEN 1 / 64 ELSE x / m END, 6) AS p FROM t""")


def rows_of(scores: Column, nodes: DataFrame) -> DataFrame:
    return exploded(nodes.select("node_id", scores.alias("p")), "p")


def heuristic_centroid(s: SparkSession, d: str) -> DataFrame:
    """A zero centre and two fixed ones over all features, beta 2."""
    return rows_of(gr.centroid_scores(F.col("f"), CENTRES, 2.0), fx.nodes(s, d))


CENTRES = [[0.0] * 64, [round(0.02 * (i % 7) - 0.05, 2) for i in range(64)], [round(0.03 * (i % 5) - 0.04, 2) for i in range(64)]]
CLOSE_SQL = "power(1 / (list_sum(list_transform(list_zip(f, {0}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) + 1e-6) + 1e-12, 2)"
register("heuristic_centroid_oneshot", heuristic_centroid, f"""WITH v AS (SELECT node_id, power(0.85 + 1e-12, 2) AS a, {CLOSE_SQL.format(f'{CENTRES[1]}::DOUBLE[]')} AS b, {CLOSE_SQL.format(f'{CENTRES[2]}::DOUBLE[]')} AS c FROM fx_nodes)
SELECT node_id, unnest(range(3)) AS label, unnest([round(a / (a + b + c), 6), round(b / (a + b + c), 6), round(c / (a + b + c), 6)]) AS p FROM v""")


def heuristic_graph(s: SparkSession, d: str) -> DataFrame:
    """Inverse mean feature distance to the neighbours of each label, one fifth where there are none, normalised."""
    nodes = fx.nodes(s, d)
    at = nodes.select(F.col("node_id").alias("src"), F.col("f").alias("x"))
    other = nodes.select(F.col("node_id").alias("dst"), F.col("f").alias("y"), "label")
    near = space_edges(s, d).join(at, "src").join(other, "dst").groupBy("src", "label").agg((1.0 / (F.avg(vectors.distance(F.col("x"), F.col("y"))) + 1e-6)).alias("v"))
    each = at.select("src", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("label"))
    raw = each.join(near, ["src", "label"], "left").withColumn("v", F.coalesce("v", F.lit(0.2)))
    from pyspark.sql import Window

    return rounded(raw.select("src", "label", (F.col("v") / F.sum("v").over(Window.partitionBy("src"))).alias("p")))


register("heuristic_graph_oneshot", heuristic_graph, f"""WITH e AS ({SPACE_SQL}), m AS (SELECT src, y.label, 1 / (avg(list_distance(x.f, y.f)) + 1e-6) AS v FROM e JOIN fx_nodes x ON x.node_id = src JOIN fx_nodes y ON y.node_id = dst GROUP BY ALL),
g AS (SELECT node_id AS src, unnest(range(5)) AS label FROM fx_nodes), r AS (SELECT g.src, g.label, coalesce(v, 0.2) AS v FROM g LEFT JOIN m USING (src, label))
SELECT src, label, round(v / sum(v) OVER (PARTITION BY src), 6) AS p FROM r""")


def heuristic_spatial(s: SparkSession, d: str) -> DataFrame:
    share = gr.neighbour_support(space_edges(s, d), labels(s, d))
    each = fx.nodes(s, d).select(F.col("node_id").alias("src"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("label"))
    raw = each.join(share, ["src", "label"], "left").withColumn("v", 1.0 + F.coalesce("support", F.lit(0.0)))
    from pyspark.sql import Window

    return rounded(raw.select("src", "label", F.pow(F.col("v") / F.sum("v").over(Window.partitionBy("src")) + 1e-12, F.lit(1.5)).alias("p")))


register("heuristic_spatial_oneshot", heuristic_spatial, f"""WITH e AS ({SPACE_SQL}), m AS (SELECT src, label, count(*) / sum(count(*)) OVER (PARTITION BY src) AS v FROM e JOIN fx_nodes n ON n.node_id = e.dst GROUP BY src, label),
g AS (SELECT node_id AS src, unnest(range(5)) AS label FROM fx_nodes), r AS (SELECT g.src, g.label, 1 + coalesce(v, 0) AS v FROM g LEFT JOIN m USING (src, label))
SELECT src, label, round(power(v / sum(v) OVER (PARTITION BY src) + 1e-12, 1.5), 6) AS p FROM r""")

# --- runs ---------------------------------------------------------------------------------------------------

AXES = {"algorithm": ["alg_0", "alg_1", "alg_2"], "alpha": [0.75, 1.0, 2.0], "beta": [1.0, 3.0]}
AXES_SQL = "(VALUES (0, 'alg_0'), (1, 'alg_1'), (2, 'alg_2')) a(i, algorithm), (VALUES (0, 0.75::DOUBLE), (1, 1::DOUBLE), (2, 2::DOUBLE)) b(j, alpha), (VALUES (0, 1::DOUBLE), (1, 3::DOUBLE)) c(k, beta)"
GRID_SQL = f"SELECT algorithm, alpha, beta, row_number() OVER (ORDER BY i, j, k) AS run_id FROM {AXES_SQL}"
register("config_grid", lambda s, d: an.config_grid(s, AXES), GRID_SQL)
register("seed_expansion", lambda s, d: an.with_seeds(an.config_grid(s, AXES), [0, 1, 2]), f"SELECT *, unnest([0::BIGINT, 1, 2]) AS seed FROM ({GRID_SQL})")
register("resume_antijoin", lambda s, d: an.remaining(an.config_grid(s, AXES), fx.runs(s, d).filter("eco > 0.5 AND fitness_name = 'snn' AND seed = 1 AND evaporation = 0.1 AND algorithm <> 'alg_2'"), ["algorithm", "alpha", "beta"], 6), f"SELECT * FROM ({GRID_SQL}) g WHERE NOT EXISTS (SELECT 1 FROM fx_runs r WHERE eco > 0.5 AND fitness_name = 'snn' AND seed = 1 AND evaporation = 0.1 AND r.algorithm <> 'alg_2' AND r.algorithm = g.algorithm AND r.alpha = g.alpha AND r.beta = g.beta) ORDER BY run_id LIMIT 6")
register("runs_dedupe_last", lambda s, d: rounded(clean_runs(s, d).drop("logged")), f"SELECT {KEY_SQL}, seed, {r6('best_fitness', 'eco')} FROM ({CLEAN_SQL})")
register("sweep_summary", lambda s, d: rounded(an.sweep_summary(fx.runs(s, d), KEY, ["best_fitness", "eco", "silhouette"])), f"SELECT {KEY_SQL}, count(*) AS n_runs, {r6('avg(best_fitness) AS mean_best_fitness', 'stddev_samp(best_fitness) AS std_best_fitness', 'avg(eco) AS mean_eco', 'stddev_samp(eco) AS std_eco', 'min(best_fitness) AS best_best_fitness', 'max(eco) AS best_eco')} FROM fx_runs GROUP BY {KEY_SQL}")
register("validation_summary", lambda s, d: rounded(an.sweep_summary(clean_runs(s, d), KEY, ["best_fitness", "eco"], "", "")), f"SELECT {KEY_SQL}, count(*) AS n_runs, {r6('avg(best_fitness) AS mean_best_fitness', 'stddev_samp(best_fitness) AS std_best_fitness', 'avg(eco) AS mean_eco', 'stddev_samp(eco) AS std_eco')} FROM ({CLEAN_SQL}) GROUP BY {KEY_SQL}")
register("checkpoint_by_algorithm", lambda s, d: an.checkpoint_by(fx.runs(s, d), "algorithm", "best_fitness"), f"SELECT algorithm, count(*) AS n, {r6('avg(best_fitness) AS mean', 'min(best_fitness) AS min', 'max(best_fitness) AS max')} FROM fx_runs GROUP BY algorithm")
PARAMETERS = ["algorithm", "pheromone_update", "fitness_name"]
MEANS = r6("avg(best_fitness) AS mean_fitness", "stddev_samp(best_fitness) AS std_fitness", "avg(eco) AS mean_eco", "stddev_samp(eco) AS std_eco", "min(best_fitness) AS best_fitness", "max(eco) AS best_eco")
register("parameter_means", lambda s, d: rounded(an.parameter_means(fx.runs(s, d), PARAMETERS)), " UNION ALL ".join(f"SELECT '{p}' AS parameter, {p} AS value, count(*) AS n, {MEANS} FROM fx_runs GROUP BY {p}" for p in PARAMETERS))
DIST = r6("avg({0}) AS mean", "stddev_samp({0}) AS std", "quantile_cont({0}, 0.25) AS p25", "quantile_cont({0}, 0.5) AS median", "quantile_cont({0}, 0.75) AS p75", "{1}({0}) AS worst", "{2}({0}) AS best", "min({0}) AS min", "max({0}) AS max", "max({0}) - min({0}) AS range")
DIST_SQL = [("best_fitness", "max", "min"), ("eco", "min", "max")]
DIRECTIONS = {"best_fitness": "lower", "eco": "higher"}
register("metric_distribution", lambda s, d: rounded(an.distribution(fx.runs(s, d), DIRECTIONS)), " UNION ALL ".join(f"SELECT '{m}' AS metric, count({m}) AS n, {DIST.format(m, w, b)} FROM fx_runs" for m, w, b in DIST_SQL))
register("grouped_distribution", lambda s, d: rounded(an.distribution(fx.runs(s, d), DIRECTIONS, ["algorithm"])), " UNION ALL ".join(f"SELECT algorithm, '{m}' AS metric, count({m}) AS n, {DIST.format(m, w, b)} FROM fx_runs GROUP BY algorithm" for m, w, b in DIST_SQL))
RANGE = r6("min({0}) AS min", "max({0}) AS max", "max({0}) - min({0}) AS range", "stddev_samp({0}) AS std")
register("metric_ranges", lambda s, d: rounded(an.metric_ranges(fx.runs(s, d), ["best_fitness", "eco"])), " UNION ALL ".join(f"SELECT '{scope}' AS scope, {g} AS fitness_name, '{m}' AS metric, {RANGE.format(m)} FROM fx_runs {by}" for m in ("best_fitness", "eco") for scope, g, by in (("fitness", "fitness_name", "GROUP BY fitness_name"), ("global", "NULL::VARCHAR", ""))))
TOPS = [*KEY, "fit", "eco"]


def top_rows(s: SparkSession, d: str, by: Sequence[Column]) -> DataFrame:
    return rounded(an.best_rows(summary(s, d), [], [*by, *[F.asc_nulls_last(c) for c in KEY]], 5).select(*TOPS, "rank"))


TOP5_SQL = f"WITH u AS ({SUMMARY_SQL}) SELECT {KEY_SQL}, {r6('fit', 'eco')}, rn AS rank FROM (SELECT *, row_number() OVER (ORDER BY {{by}}, {TIE_SQL}) AS rn FROM u) WHERE rn <= 5"
register("top5_by_fitness", lambda s, d: top_rows(s, d, [F.asc("fit")]), TOP5_SQL.format(by="fit"))
register("top5_by_ecology", lambda s, d: top_rows(s, d, [F.desc("eco")]), TOP5_SQL.format(by="eco DESC"))
BEST_SQL = f"WITH u AS ({SUMMARY_SQL}), b AS (SELECT * EXCLUDE (rn), 'best_' || fitness_name AS selection FROM (SELECT *, row_number() OVER (PARTITION BY fitness_name ORDER BY fit, {TIE_SQL}) AS rn FROM u) WHERE rn = 1), e AS (SELECT *, 'best_ecology' AS selection FROM u ORDER BY eco DESC, {TIE_SQL} LIMIT 1)"
register("best_per_fitness", lambda s, d: rounded(an.selected_configs(summary(s, d), KEY, "fit", "eco").select(*TOPS, "selection")), BEST_SQL + f" SELECT {KEY_SQL}, {r6('fit', 'eco')}, selection FROM b UNION ALL SELECT {KEY_SQL}, {r6('fit', 'eco')}, selection FROM e WHERE ({KEY_SQL}) NOT IN (SELECT ({KEY_SQL}) FROM b)")
register(
    "candidate_selection",
    lambda s, d: rounded(an.candidates(summary(s, d), KEY, "fit", 10, 2, 0.36).select(*TOPS)),
    f"WITH u AS (SELECT * FROM ({SUMMARY_SQL}) WHERE fit < 0.36), r AS (SELECT *, row_number() OVER (PARTITION BY fitness_name ORDER BY fit, {TIE_SQL}) AS a, row_number() OVER (PARTITION BY fitness_name, algorithm ORDER BY fit, {TIE_SQL}) AS b FROM u) SELECT {KEY_SQL}, {r6('fit', 'eco')} FROM r WHERE a <= 10 OR b <= 2",
)
register("top50_overlap", lambda s, d: an.top_overlap(summary(s, d), KEY, "fit", "eco"), f"WITH u AS ({SUMMARY_SQL}), r AS (SELECT fitness_name, row_number() OVER (PARTITION BY fitness_name ORDER BY fit, {TIE_SQL}) AS a, row_number() OVER (PARTITION BY fitness_name ORDER BY eco DESC, {TIE_SQL}) AS b FROM u) SELECT fitness_name, count(*) FILTER (a <= 50 AND b <= 50) AS overlap FROM r GROUP BY fitness_name")
CURVE_SQL = f"WITH u AS ({SUMMARY_SQL}), r AS (SELECT fitness_name, row_number() OVER w AS n, stddev_samp(fit) OVER w AS a, stddev_samp(eco) OVER w AS b, corr(fit, eco) OVER w AS c FROM u WINDOW w AS (PARTITION BY fitness_name ORDER BY fit, {TIE_SQL} ROWS UNBOUNDED PRECEDING))"
register("topn_std_curves", lambda s, d: rounded(an.top_n_std(summary(s, d), "fit", ["fit", "eco"], KEY)), CURVE_SQL + " SELECT fitness_name, n, 'fit' AS metric, round(a, 6) AS std FROM r WHERE n >= 10 UNION ALL SELECT fitness_name, n, 'eco', round(b, 6) FROM r WHERE n >= 10")
DOWN_SQL = CURVE_SQL.replace("ORDER BY fit,", "ORDER BY fit DESC NULLS LAST,").replace("PARTITION BY fitness_name ", "{by}")
register("topn_std_opposite", lambda s, d: rounded(an.top_n_std(summary(s, d), "fit", ["fit", "eco"], KEY, ascending=False)), DOWN_SQL.format(by="PARTITION BY fitness_name ") + " SELECT fitness_name, n, 'fit' AS metric, round(a, 6) AS std FROM r WHERE n >= 10 UNION ALL SELECT fitness_name, n, 'eco', round(b, 6) FROM r WHERE n >= 10")
register("topn_std_global", lambda s, d: rounded(an.top_n_std(summary(s, d), "eco", ["eco"], KEY, group=None, ascending=False)), DOWN_SQL.replace("ORDER BY fit DESC", "ORDER BY eco DESC").format(by="") + " SELECT n, 'eco' AS metric, round(b, 6) AS std FROM r WHERE n >= 10")
register("topn_corr_pearson", lambda s, d: rounded(an.top_n_pearson(summary(s, d), "fit", "eco", KEY)), CURVE_SQL + " SELECT fitness_name, n, round(c, 6) AS pearson FROM r WHERE n >= 20")
RANK_SQL = "rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2"
register(
    "topn_corr_spearman",
    lambda s, d: rounded(an.top_n_spearman(summary(s, d), "fit", "eco", KEY)),
    f"WITH u AS ({SUMMARY_SQL}), r AS (SELECT fitness_name, fit, eco, row_number() OVER (PARTITION BY fitness_name ORDER BY fit, {TIE_SQL}) AS r FROM u), p AS (SELECT e.fitness_name, e.r AS n, q.fit, q.eco FROM r e JOIN r q ON q.fitness_name = e.fitness_name AND q.r <= e.r WHERE e.r >= 20), k AS (SELECT fitness_name, n, {RANK_SQL.format(by='fitness_name, n', c='fit')} AS a, {RANK_SQL.format(by='fitness_name, n', c='eco')} AS b FROM p) SELECT fitness_name, n, round(corr(a, b), 6) AS spearman FROM k GROUP BY fitness_name, n",
)
NORM_SQL = ", ".join(f"round(({m} - min({m}) OVER {w}) / nullif(max({m}) OVER {w} - min({m}) OVER {w}, 0), 6) AS {m}_norm_{g}" for g, w in (("fitness_name", "(PARTITION BY fitness_name)"), ("global", "()")) for m in ("fit", "eco"))
register("normalized_columns", lambda s, d: rounded(an.normalised_columns(summary(s, d).select(*TOPS), ["fit", "eco"])), f"WITH u AS ({SUMMARY_SQL}) SELECT {KEY_SQL}, {r6('fit', 'eco')}, {NORM_SQL} FROM u")
register("corr_matrix_pearson", lambda s, d: rounded(an.correlations(summary(s, d), ["fit", "eco", "alpha"])), f"WITH u AS ({SUMMARY_SQL}) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM u" for a in ("fit", "eco", "alpha") for b in ("fit", "eco", "alpha")))
ALL_RANKS = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS {c}" for c in ("fit", "eco", "alpha"))
register("corr_matrix_spearman", lambda s, d: rounded(an.correlations(summary(s, d), ["fit", "eco", "alpha"], "spearman")), f"WITH u0 AS ({SUMMARY_SQL}), u AS (SELECT {ALL_RANKS} FROM u0) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM u" for a in ("fit", "eco", "alpha") for b in ("fit", "eco", "alpha")))
OBJECTIVES = ["centroid", "silhouette", "snn"]
WIDE_SQL = "SELECT " + ", ".join(f"max(fit) FILTER (fitness_name = '{o}') AS {o}" for o in OBJECTIVES) + f" FROM ({SUMMARY_SQL}) GROUP BY {', '.join(KEY[1:])} HAVING " + " AND ".join(f"count(*) FILTER (fitness_name = '{o}') > 0" for o in OBJECTIVES)
register("objective_corr", lambda s, d: rounded(an.objective_correlations(summary(s, d), KEY[1:], "fit", OBJECTIVES)), f"WITH u AS ({WIDE_SQL}) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM u" for a in OBJECTIVES for b in OBJECTIVES))


def pairs_of_runs(s: SparkSession, d: str) -> DataFrame:
    return an.paired(clean_runs(s, d), KEY, ["best_fitness", "eco"])


PAIRS_SQL = f"""n AS (SELECT {CFG_SQL} AS cfg, seed, best_fitness, eco FROM ({CLEAN_SQL})),
d AS (SELECT a.cfg AS cfg_a, b.cfg AS cfg_b, unnest(['best_fitness', 'eco']) AS metric, unnest([a.best_fitness - b.best_fitness, a.eco - b.eco]) AS d FROM n a JOIN n b ON a.seed = b.seed AND a.cfg < b.cfg),
g AS (SELECT cfg_a, cfg_b, metric, count(*) AS n_pairs, avg(d) AS m, median(d) AS md, stddev_samp(d) AS sd FROM d GROUP BY ALL)"""
register("paired_differences", lambda s, d: rounded(an.paired_differences(pairs_of_runs(s, d))), f"WITH {PAIRS_SQL} SELECT cfg_a, cfg_b, metric, n_pairs, " + r6(*[f"CASE WHEN n_pairs >= 2 THEN {e} END AS {n}" for e, n in (("m", "mean_diff"), ("md", "median_diff"), ("sd", "std_diff"), ("m / nullif(sd, 0)", "cohen_dz"), ("m / nullif(sd, 0) * sqrt(n_pairs)", "paired_t_stat"))]) + " FROM g")
#: Closed forms for up to five pairs, as there are five seeds: Student's t with 1 to 4 degrees of freedom, all sums of ranks, the error function's series.
PVALUE_SQL = PAIRS_SQL.rpartition("),")[0] + """),
r AS (SELECT *, rank() OVER (PARTITION BY cfg_a, cfg_b, metric, d <> 0 ORDER BY abs(d)) + (count(*) OVER (PARTITION BY cfg_a, cfg_b, metric, abs(d)) - 1) / 2 AS rk, count(*) OVER (PARTITION BY cfg_a, cfg_b, metric, abs(d)) AS c FROM d),
g AS (SELECT cfg_a, cfg_b, metric, count(*) AS n, avg(d) AS m, stddev_samp(d) AS sd, count(*) FILTER (d <> 0) AS k, least(coalesce(sum(rk) FILTER (d > 0), 0), coalesce(sum(rk) FILTER (d < 0), 0)) AS low, coalesce(sum(c * c - 1) FILTER (d <> 0), 0) AS tied FROM r GROUP BY ALL),
subsets AS (SELECT k, list_sum(list_transform(range(k), lambda i: ((b >> i) & 1) * (i + 1))) AS s FROM (VALUES (1), (2), (3), (4), (5)) v(k), range(32) q(b) WHERE b < (1 << k)),
h AS (SELECT *, atan(abs(m / nullif(sd, 0) * sqrt(n)) / sqrt(n - 1)) AS o, k * (k + 1) * (2 * k + 1) / 24 - tied / 48 AS v FROM g WHERE n >= 2),
p AS (SELECT *, CASE n WHEN 2 THEN 2 * o / pi() WHEN 3 THEN sin(o) WHEN 4 THEN 2 / pi() * (o + sin(o) * cos(o)) WHEN 5 THEN sin(o) * (1 + cos(o) * cos(o) / 2) END AS a, CASE WHEN v > 0 THEN abs(low - k * (k + 1) / 4) / sqrt(2 * v) ELSE 0 END AS z FROM h),
w AS (SELECT *, CASE WHEN k = 0 THEN 1 WHEN k = n AND tied = 0 THEN least(1, 2 * (SELECT count(*) FROM subsets WHERE subsets.k = p.k AND s <= low) / (1 << k))
  ELSE least(1, 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(30), lambda i: power(-1, i) * power(z, 2 * i + 1) / (factorial(i::INT) * (2 * i + 1))))) END AS wp FROM p)"""
register("paired_pvalues", lambda s, d: rounded(an.paired_tests(pairs_of_runs(s, d))), f"WITH {PVALUE_SQL} SELECT cfg_a, cfg_b, metric, {r6('1 - a AS paired_t_p', 'low AS wilcoxon_stat', 'wp AS wilcoxon_p')} FROM w UNION ALL SELECT cfg_a, cfg_b, metric, NULL, NULL, NULL FROM g WHERE n < 2")
SIGNIFICANCE_SQL = " JOIN ".join(f"({ENTRIES[n][1]})" for n in ("paired_differences", "paired_pvalues"))
ENTRIES["significance"] = (lambda s, d: rounded(an.by_significance(an.significance(clean_runs(s, d), KEY, ["best_fitness", "eco"]))), f"SELECT * FROM {SIGNIFICANCE_SQL} USING (cfg_a, cfg_b, metric)")
register(
    "union_migrate",
    lambda s, d: rounded(an.union_migrate(summary(s, d).select("algorithm", "fit"), summary(s, d).filter("algorithm = 'alg_1'").select(F.lit("alg_0").alias("algorithm"), "fit", F.lit("rerun").alias("origin")), "alg_0")),
    f"WITH u AS ({SUMMARY_SQL}) SELECT algorithm, {r6('fit')}, NULL::VARCHAR AS origin FROM u WHERE algorithm <> 'alg_0' UNION ALL SELECT 'alg_0', {r6('fit')}, 'rerun' FROM u WHERE algorithm = 'alg_1'",
)
register("best_so_far", lambda s, d: rounded(an.best_so_far(clean_runs(s, d).groupBy("algorithm", "seed", F.col("alpha").alias("iteration")).agg(F.min("best_fitness").alias("fitness")), by=["algorithm", "seed"])), f"WITH h AS (SELECT algorithm, seed, alpha AS iteration, min(best_fitness) AS fitness FROM ({CLEAN_SQL}) GROUP BY ALL) SELECT algorithm, seed, {r6('iteration', 'fitness', 'min(fitness) OVER (PARTITION BY algorithm, seed ORDER BY iteration) AS best_so_far')} FROM h")
register("iteration_stats", lambda s, d: rounded(an.iteration_stats(fx.runs(s, d).select(F.col("alpha").alias("iteration"), F.col("best_fitness").alias("fitness"), "eco"), pheromone="eco")), f"SELECT alpha AS iteration, {r6('min(best_fitness) AS iteration_best', 'avg(best_fitness) AS mean', 'stddev_pop(best_fitness) AS std', 'min(eco) AS pheromone_min', 'max(eco) AS pheromone_max')} FROM fx_runs GROUP BY alpha")
register("quality_gate", lambda s, d: an.quality_gate(fx.runs(s, d), None, ["best_fitness", "eco"], 100), "SELECT count(*) AS n_rows, 0::BIGINT AS n_bad, 0::BIGINT AS n_failures, count(*) >= 100 AS passed FROM fx_runs")

register(
    "cell_class_join",
    lambda s, d: ra.with_cell_class(fx.pixels(s, d).select("row", "col", "superpixel"), fx.pixels(s, d).select("row", "col", F.when(F.col("row") % 3 != 0, F.col("koppen_class")).alias("koppen_class"))),
    "SELECT row, col, superpixel, koppen_class FROM fx_pixels WHERE row % 3 <> 0 AND koppen_class IS NOT NULL",
)


def run_rows(s: SparkSession, d: str) -> DataFrame:
    """Three labelings by arithmetic, as runs, with the Rand index against the given labels and their land-use scores."""
    from terrapart.plans import model as mo

    px = fx.pixels(s, d).select("row", "col", F.col("superpixel").cast("long").alias("node_id"))
    found = px.select("node_id").distinct().select("node_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("run_id"))
    found = found.select("run_id", F.lit(0).cast("long").alias("seed"), "node_id", ((F.col("node_id") * (F.col("run_id") + 3) + F.col("run_id")) % 5).alias("label"))
    base = px.select("node_id").distinct().withColumn("label", F.col("node_id") % 4)
    cover = px.select("row", "col", (F.col("node_id") % 50).cast("int").alias("clc_class"))
    runs = found.groupBy("run_id", "seed").agg(F.count("*").alias("n_labels"))
    out = mo.with_comparisons(runs, found, base, px, cover)
    return rounded(out.select("run_id", "seed", "n_labels", "ari_vs_kmeans", "mean_combined_ecological_consistency", "weighted_combined_ecological_consistency"))


RUNS_SQL = "(VALUES (0), (1), (2)) v(run_id)"
RUN_SQL = ENTRIES["evaluate_label_set"][1].rpartition("\nSELECT ")[0].replace("superpixel % 5 AS cluster", "run_id * 10 + (superpixel * (run_id + 3) + run_id) % 5 AS cluster").replace("FROM fx_pixels WHERE superpixel", f"FROM fx_pixels, {RUNS_SQL} WHERE superpixel")
RUN_SQL += f""",
score AS (SELECT cluster // 10 AS run_id, avg(e) AS plain, sum(scored * e) / (sum(scored) + 1e-12) AS weighted FROM per WHERE e IS NOT NULL GROUP BY 1),
cells AS (SELECT run_id, (superpixel * (run_id + 3) + run_id) % 5 AS x, superpixel % 4 AS y, count(*)::DOUBLE AS n FROM (SELECT DISTINCT superpixel FROM fx_pixels WHERE superpixel IS NOT NULL), {RUNS_SQL} GROUP BY ALL),
whole AS (SELECT run_id, sum(n * (n - 1) / 2) AS s, sum(n) AS m FROM cells GROUP BY run_id), one AS (SELECT run_id, sum(n * (n - 1) / 2) AS a FROM (SELECT run_id, x, sum(n) AS n FROM cells GROUP BY ALL) GROUP BY run_id),
two AS (SELECT run_id, sum(n * (n - 1) / 2) AS b FROM (SELECT run_id, y, sum(n) AS n FROM cells GROUP BY ALL) GROUP BY run_id)
SELECT run_id::BIGINT AS run_id, 0::BIGINT AS seed, m::BIGINT AS n_labels, {r6('coalesce((s - a * b / (m * (m - 1) / 2)) / nullif((a + b) / 2 - a * b / (m * (m - 1) / 2), 0), 1) AS ari_vs_kmeans', 'plain AS mean_combined_ecological_consistency', 'weighted AS weighted_combined_ecological_consistency').replace(', 6)', f' + {SHIFT}, 6)')}
FROM whole JOIN one USING (run_id) JOIN two USING (run_id) JOIN score USING (run_id)"""
ENTRIES["run_row"] = (run_rows, RUN_SQL)

# --- models and colonies ------------------------------------------------------------------------------------


def pca_features(s: SparkSession, d: str) -> DataFrame:
    return rounded(ra.grouped_pca(fx.climate(s, d), {"temp": ("temperature", 2), "rain": ("rain", 2)}, "node_id")[0])


def palette(s: SparkSession, d: str) -> DataFrame:
    colour = lambda i: (F.abs(F.col("embedding")[i]).cast("double") * 997) % 256
    return rounded(ra.dominant_palette(fx.table(s, d, "embeddings").select(colour(0).alias("r"), colour(1).alias("g"), colour(2).alias("b")), 6))


def colony_run(s: SparkSession, d: str, algorithm: str) -> DataFrame:
    """A fit of each objective on all nodes with all features and the operator's default settings: outcome rows without timings."""
    from terrapart.operators import colony as co

    model, _ = co.collect_model(fx.nodes(s, d), space_edges(s, d), snn(s, d))
    rows = [(i + 1, 0, algorithm, u, o, 1.0, 1.0, 0.1, 0.05) for i, (o, u) in enumerate(zip(co.OBJECTIVES, ("all_ants", "best_ant", "quality_weighted"), strict=True))]
    configs = s.createDataFrame(rows, "run_id long, seed long, algorithm string, pheromone_update string, fitness_name string, alpha double, beta double, evaporation double, q double")
    found = co.run_configs(configs.repartition(len(rows), "run_id"), model)
    return found.select("run_id", "seed", "algorithm", "pheromone_update", "fitness_name", "status", F.round("best_fitness", 6).alias("best_fitness"), F.round("recomputed_fitness", 6).alias("recomputed_fitness"), F.size("labels").cast("long").alias("n_labels"))


register("pca_features", pca_features)
register("superpixels_kmeans", lambda s, d: rounded(ra.kmeans_superpixels(fx.pixels(s, d).drop("superpixel"), 150).groupBy("superpixel").agg(F.count("*").alias("n"))))
register("kmeans_baseline", lambda s, d: __import__("terrapart.operators.colony", fromlist=["kmeans_baseline"]).kmeans_baseline(fx.nodes(s, d), tries=3))
register("dominant_palette", palette)
for algorithm in ("aco_centroid", "aco_cohesion", "aco_centroid_refinement", "aco_cohesion_refinement", "aco_graph_local", "aco_graph_local_refinement", "multi_centroid_graph_spatial", "multi_cohesion_graph_spatial"):
    register(algorithm, lambda s, d, algorithm=algorithm: colony_run(s, d, algorithm))


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ENTRIES.items() if sql}
