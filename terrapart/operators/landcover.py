"""Joins of labels, pixels, land cover and legend, and the consistency metrics over them.

Everything is declarative: small dimensions are left to the planner, which broadcasts them when their size
allows, and every metric is one aggregation over class counts, so only counts are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapart.functions.landcover import NODATA_CODES, agriculture_class, clc_group, keep_unless_in, land_use_component, natural_class, safe_ratio

EPS = 1e-12
COMPONENTS = ["agriculture", "natural", "artificial", "excluded"]


def labels_to_pixels(pixels: DataFrame, labels: DataFrame, key: str = "node_id") -> DataFrame:
    """Every pixel with the label of its node."""
    return pixels.join(labels, key)


def join_cover(clusters: DataFrame, cover: DataFrame, how: str = "inner", nodata: Sequence[int] | None = NODATA_CODES, on: Sequence[str] = ("row", "col")) -> DataFrame:
    """Clusters with their land-cover class; nodata classes go before the join, nulls stay."""
    if nodata:
        cover = cover.filter(keep_unless_in(F.col("clc_class"), nodata))
    return clusters.join(cover, list(on), how)


def with_legend(cover: DataFrame, legend: DataFrame | None = None) -> DataFrame:
    """Adds clc_group, clc_name (null without a legend), component and the class inside the component."""
    if legend is not None:
        cover = cover.join(legend, "clc_class", "left")
    elif "clc_name" not in cover.columns:
        cover = cover.withColumn("clc_name", F.lit(None).cast("string"))
    out = cover.withColumn("clc_group", clc_group(F.col("clc_class")))
    out = out.withColumn("land_use_component", land_use_component(F.col("clc_group")))
    return out.withColumns(
        {
            "agriculture_class": agriculture_class(F.col("land_use_component"), F.col("clc_name"), F.col("clc_class")),
            "natural_class": natural_class(F.col("land_use_component"), F.col("clc_group")),
        }
    )


def class_counts(rows: DataFrame, cluster: str = "cluster", cls: str = "clc_group") -> DataFrame:
    """count, cluster_total and proportion of every class of a cluster; a null class is a class."""
    counts = rows.groupBy(cluster, cls).agg(F.count("*").alias("count"))
    total = F.sum("count").over(Window.partitionBy(cluster))
    return counts.withColumn("cluster_total", total).withColumn("proportion", F.col("count") / F.col("cluster_total"))


def quality(rows: DataFrame, cluster: str = "cluster", cls: str = "clc_group") -> DataFrame:
    """Entropy, diversity and dominant class of each cluster, in one aggregation over its counts."""
    p = F.col("proportion")
    dominant = F.struct(p.alias("p"), (-F.rank().over(Window.partitionBy(cluster).orderBy(F.col(cls).asc_nulls_last()))).alias("r"))
    found = (
        class_counts(rows, cluster, cls)
        .withColumn("__order", dominant)
        .groupBy(cluster)
        .agg(
            (-F.sum(p * F.log(p + EPS))).alias("shannon_entropy"),
            F.count(cls).alias("n_classes"),
            (1.0 - F.sum(p * p)).alias("simpson_diversity"),
            F.max_by(cls, "__order").alias("dominant_class"),
            F.max(p).alias("dominant_class_share"),
            F.first("cluster_total").alias("cluster_total"),
        )
    )
    return found.withColumn("normalized_entropy", F.when(F.col("n_classes") > 1, F.col("shannon_entropy") / F.log(F.col("n_classes").cast("double"))).otherwise(0.0))


def homogeneity(rows: DataFrame, cluster: str, cls: str) -> DataFrame:
    """quality() of the rows that have a class, with homogeneity."""
    return quality(rows.filter(F.col(cls).isNotNull()), cluster, cls).withColumn("homogeneity", 1.0 - F.col("normalized_entropy"))


def weighted(value: Column, weight: Column) -> Column:
    """Sum of value times its share of the weights."""
    return F.sum(weight * value) / (F.sum(weight) + EPS)


def overall_homogeneity(per_cluster: DataFrame) -> DataFrame:
    """One row: plain and weighted means of the quality metrics."""
    weight = F.col("cluster_total").cast("double")
    out = []
    for name in ("dominant_class_share", "normalized_entropy", "simpson_diversity"):
        out += [F.avg(name).alias(f"mean_{name}"), weighted(F.col(name), weight).alias(f"weighted_{name}")]
    return per_cluster.agg(*out)


def quality_report(rows: DataFrame, cluster: str = "cluster", cls: str = "clc_group", exclude: Iterable[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(counts, quality, overall) without the excluded classes."""
    exclude = list(exclude)
    work = rows.filter(keep_unless_in(F.col(cls), exclude)) if exclude else rows
    per_cluster = quality(work, cluster, cls)
    return class_counts(work, cluster, cls), per_cluster, overall_homogeneity(per_cluster)


def cluster_distribution(rows: DataFrame, cluster_id, cluster: str = "cluster", cls: str = "clc_group", normalize: bool = True) -> DataFrame:
    """Classes of one cluster with their share (or count), largest first; null classes do not count."""
    counts = rows.filter((F.col(cluster) == cluster_id) & F.col(cls).isNotNull()).groupBy(cls).agg(F.count("*").alias("count"))
    if not normalize:
        return counts.orderBy(F.desc("count"), cls)
    share = F.col("count") / F.sum("count").over(Window.partitionBy())
    return counts.select(cls, share.alias("proportion")).orderBy(F.desc("proportion"), cls)


def contingency(rows: DataFrame, normalize: str | None = None, cluster: str = "cluster", cls: str = "clc_group", classes: Sequence[str] | None = None) -> DataFrame:
    """Clusters by classes: counts, or shares of the row (index), the column (columns) or the table (all)."""
    present = rows.filter(F.col(cluster).isNotNull() & F.col(cls).isNotNull())
    table = present.groupBy(cluster).pivot(cls, list(classes) if classes else None).agg(F.count(F.lit(1))).na.fill(0)
    names = [c for c in table.columns if c != cluster]
    if normalize is None:
        return table
    row = sum((F.col(f"`{c}`") for c in names), F.lit(0))
    whole = Window.partitionBy()
    bottom = {"index": lambda c: row, "columns": lambda c: F.sum(f"`{c}`").over(whole), "all": lambda c: F.sum(row).over(whole)}[normalize]
    return table.select(cluster, *[F.coalesce(safe_ratio(F.col(f"`{c}`"), bottom(c)), F.lit(0.0)).alias(c) for c in names])


def component_pivot(rows: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Pixels of each component, zero where absent, with totals, shares and weights."""
    count = lambda name: F.count_if(F.col("land_use_component") == name).alias(name)
    out = rows.groupBy(cluster).agg(*[count(c) for c in COMPONENTS])
    out = out.withColumn("total_pixels", sum((F.col(c) for c in COMPONENTS[1:]), F.col(COMPONENTS[0])))
    out = out.withColumn("valid_scored_pixels", F.col("agriculture") + F.col("natural"))
    shares = {f"{c}_share_total": safe_ratio(F.col(c), F.col("total_pixels")) for c in COMPONENTS[:3]}
    weights = {f"{c}_weight_scored": safe_ratio(F.col(c), F.col("valid_scored_pixels")) for c in COMPONENTS[:2]}
    return out.withColumns(shares | weights)


def consistency(rows: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Combined agriculture and natural consistency of each cluster; null where no pixel is scored."""
    out = component_pivot(rows, cluster)
    for name in ("agriculture", "natural"):
        part = homogeneity(rows.filter(F.col("land_use_component") == name), cluster, f"{name}_class")
        out = out.join(
            part.select(
                cluster,
                F.col("normalized_entropy").alias(f"{name}_normalized_entropy"),
                F.col("homogeneity").alias(f"{name}_homogeneity"),
                F.col("dominant_class_share").alias(f"{name}_dominant_share"),
                F.col("dominant_class").alias(f"{name}_dominant_class"),
                F.col("n_classes").alias(f"{name}_n_classes"),
                F.col("cluster_total").alias(f"{name}_total"),
            ),
            cluster,
            "left",
        )
    zero = F.lit(0.0)
    out = out.withColumns({f"{n}_homogeneity": F.coalesce(F.col(f"{n}_homogeneity"), zero) for n in ("agriculture", "natural")})
    score = sum((F.coalesce(F.col(f"{n}_weight_scored"), zero) * F.col(f"{n}_homogeneity") for n in ("agriculture", "natural")), zero)
    return out.withColumn("combined_ecological_consistency", F.when(F.col("valid_scored_pixels") > 0, score))


SUMMARY = ["combined_ecological_consistency", "agriculture_homogeneity", "natural_homogeneity", "artificial_share_total"]


SCORED = ["valid_scored_pixels", *SUMMARY]


def overall_by(per_cluster: DataFrame, by: Sequence[str]) -> DataFrame:
    """Plain and weighted means over the clusters with a score, for each group; no row for a group without any."""
    weight = F.col("valid_scored_pixels").cast("double")
    out = []
    for name in SUMMARY:
        out += [F.avg(name).alias(f"mean_{name}"), weighted(F.col(name), weight).alias(f"weighted_{name}")]
    found = per_cluster.filter(F.col("combined_ecological_consistency").isNotNull()).groupBy(*by).agg(F.count("*").alias("__n"), *out)
    return found.filter("__n > 0").drop("__n")


def overall_consistency(per_cluster: DataFrame) -> DataFrame:
    """One row of plain and weighted means over clusters with a score; no row if there are none."""
    return overall_by(per_cluster, [])


def evaluate_labels(pixels: DataFrame, labels: DataFrame, cover: DataFrame, legend: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(per cluster, overall) consistency of a labeling of nodes."""
    clusters = labels_to_pixels(pixels, labels).withColumnRenamed("label", "cluster")
    per_cluster = consistency(with_legend(join_cover(clusters, cover), legend))
    return per_cluster, overall_consistency(per_cluster)


def majority_class(rows: DataFrame, group: str, cls: str) -> DataFrame:
    """The most frequent class of each group, the smallest on ties; null classes do not count."""
    return rows.groupBy(group).agg(F.mode(cls, True).alias(cls))


def dense_ids(rows: DataFrame, cls: str, name: str = "class_id") -> DataFrame:
    """Distinct classes with ids from 0 in their order; the distinct classes are few, the rows are not ranked."""
    return rows.filter(F.col(cls).isNotNull()).select(cls).distinct().withColumn(name, (F.dense_rank().over(Window.orderBy(cls)) - 1).cast("long"))


def largest_cluster_share(rows: DataFrame, cluster: str = "cluster") -> DataFrame:
    sizes = rows.groupBy(cluster).agg(F.count("*").alias("n"))
    return sizes.agg((F.max("n") / F.sum("n")).alias("largest_cluster_share"), F.count("*").alias("n_clusters"))


def pooled_std(rows: DataFrame, value: str, cluster: str = "cluster") -> DataFrame:
    """Within-cluster deviation pooled by size, the global one, and their ratio."""
    per = rows.filter(F.col(value).isNotNull()).groupBy(cluster).agg(F.count("*").alias("n"), F.stddev_pop(value).alias("s"), F.sum(value).alias("t"), F.sum(F.col(value) * F.col(value)).alias("q"))
    whole = F.sqrt(F.sum("q") / F.sum("n") - F.pow(F.sum("t") / F.sum("n"), F.lit(2.0)))
    out = per.agg((F.sum(F.col("n") * F.col("s")) / F.sum("n")).alias("pooled_std"), whole.alias("global_std"))
    return out.withColumn("std_ratio", safe_ratio(F.col("pooled_std"), F.col("global_std")))


def high_value_concentration(rows: DataFrame, value: str, limit: float, cluster: str = "cluster") -> DataFrame:
    """The cluster with the largest share above limit, that share, and what it holds of all values above limit."""
    per = rows.groupBy(cluster).agg(F.count_if(F.col(value) > limit).alias("high"), F.count("*").alias("n")).withColumn("share", F.col("high") / F.col("n"))
    best = F.max_by(F.struct(cluster, "share", "high"), F.struct("share", F.xxhash64(F.col(cluster).cast("string"))))
    return per.agg(best.alias("b"), F.sum("high").alias("all_high")).select(
        F.col(f"b.{cluster}").alias("top_cluster"), F.col("b.share").alias("top_share"), safe_ratio(F.col("b.high"), F.col("all_high")).alias("captured_share")
    )
