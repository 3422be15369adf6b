"""The library's roles on the driver's tables: pixels, nodes, climate rows, land cover and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapart.operators.landcover import with_legend


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def landcover_rows(spark: SparkSession, d: str) -> DataFrame:
    """cluster and clc_class of every line item, with names for even codes only."""
    item, part, supplier, nation = (table(spark, d, n) for n in ("lineitem", "part", "supplier", "nation"))
    joined = (
        item.select("l_partkey", "l_suppkey")
        .join(part.select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation.select("n_nationkey", "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey"))
    )
    return joined.select(F.col("n_regionkey").cast("long").alias("cluster"), F.col("p_size").alias("clc_class")).filter(~F.col("clc_class").isin(0, 999))


def legend(spark: SparkSession, d: str) -> DataFrame:
    codes = table(spark, d, "part").select(F.col("p_size").alias("clc_class")).distinct()
    return codes.withColumn("clc_name", F.when(F.col("clc_class") % 2 == 0, F.concat(F.lit("class_"), F.col("clc_class").cast("string"))))


def landcover(spark: SparkSession, d: str) -> DataFrame:
    return with_legend(landcover_rows(spark, d), legend(spark, d))


def pixels(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        F.expr("event_id div 100").alias("row"), (F.col("event_id") % 100).alias("col"), "value", F.col("user_id").alias("superpixel"), F.col("event_type").alias("koppen_class"), (F.col("user_id") % 5).alias("cluster")
    )


def nodes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(
        F.col("vec_id").alias("node_id"), F.col("embedding").cast("array<double>").alias("f"), (F.col("label") % 5).cast("long").alias("label"), (1.0 + F.col("vec_id") % 7).cast("double").alias("weight"),
        F.expr("vec_id div 25").cast("double").alias("r"), (F.col("vec_id") % 25).cast("double").alias("c"),
    )


def climate(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    return n.select("node_id", F.slice("f", 1, 17).alias("temperature"), F.slice("f", 18, 14).alias("rain"))


def runs(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "lineitem")
    pick = lambda key, *names: F.element_at(F.array(*[F.lit(n) for n in names]), key.cast("int") + 1)
    return i.select(
        F.when(F.col("l_returnflag") == "A", "centroid").when(F.col("l_returnflag") == "N", "silhouette").otherwise("snn").alias("fitness_name"),
        F.concat(F.lit("alg_"), (F.col("l_partkey") % 8).cast("string")).alias("algorithm"),
        pick(F.col("l_suppkey") % 3, "all_ants", "best_ant", "quality_weighted").alias("pheromone_update"),
        pick(F.col("l_linenumber") % 3, 0.75, 1.0, 2.0).alias("alpha"),
        F.when(F.col("l_linestatus") == "O", 1.0).otherwise(3.0).alias("beta"),
        F.when(F.col("l_discount") < 0.05, 0.02).otherwise(0.1).alias("evaporation"),
        (F.col("l_orderkey") % 5).alias("seed"),
        (F.col("l_extendedprice") / 100000.0).alias("best_fitness"),
        (F.col("l_quantity") / 50.0).alias("eco"),
        F.col("l_shipdate").alias("logged"),
    )


#: The same views in DuckDB's SQL.
VIEWS = {
    "fx_landcover": """SELECT n_regionkey::BIGINT AS cluster, p_size AS clc_class, CASE WHEN p_size % 2 = 0 THEN 'class_' || p_size END AS clc_name,
  CASE WHEN p_size BETWEEN 1 AND 11 THEN 'Artificial' WHEN p_size BETWEEN 12 AND 22 THEN 'Agriculture' WHEN p_size = 23 THEN 'Broadleaf_forest'
       WHEN p_size = 24 THEN 'Coniferous_forest' WHEN p_size = 25 THEN 'Mixed_forest' WHEN p_size BETWEEN 26 AND 29 THEN 'Shrubland'
       WHEN p_size BETWEEN 30 AND 34 THEN 'Grassland_Bare' WHEN p_size BETWEEN 35 AND 39 THEN 'Wetlands' WHEN p_size BETWEEN 40 AND 44 THEN 'Water' ELSE 'Unknown' END AS clc_group
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE p_size NOT IN (0, 999)""",
    "fx_cover": """SELECT *, CASE WHEN comp = 'agriculture' THEN coalesce(clc_name, 'CLC_' || clc_class) END AS agriculture_class,
  CASE WHEN comp = 'natural' THEN clc_group END AS natural_class
  FROM (SELECT *, CASE WHEN clc_group = 'Agriculture' THEN 'agriculture' WHEN clc_group = 'Artificial' THEN 'artificial' WHEN clc_group = 'Unknown' THEN 'excluded' ELSE 'natural' END AS comp FROM fx_landcover)""",
    "fx_pixels": "SELECT event_id // 100 AS row, event_id % 100 AS col, value, user_id AS superpixel, event_type AS koppen_class, user_id % 5 AS cluster FROM events",
    "fx_nodes": """SELECT vec_id AS node_id, embedding::DOUBLE[] AS f, (label % 5)::BIGINT AS label, (1 + vec_id % 7)::DOUBLE AS weight,
  (vec_id // 25)::DOUBLE AS r, (vec_id % 25)::DOUBLE AS c FROM embeddings""",
    "fx_climate": "SELECT node_id, f[1:17] AS temperature, f[18:31] AS rain FROM fx_nodes",
    "fx_runs": """SELECT CASE l_returnflag WHEN 'A' THEN 'centroid' WHEN 'N' THEN 'silhouette' ELSE 'snn' END AS fitness_name, 'alg_' || (l_partkey % 8) AS algorithm,
  (['all_ants', 'best_ant', 'quality_weighted'])[(l_suppkey % 3)::INT + 1] AS pheromone_update, ([0.75::DOUBLE, 1::DOUBLE, 2::DOUBLE])[(l_linenumber % 3)::INT + 1] AS alpha,
  CASE WHEN l_linestatus = 'O' THEN 1::DOUBLE ELSE 3::DOUBLE END AS beta, CASE WHEN l_discount < 0.05 THEN 0.02::DOUBLE ELSE 0.1::DOUBLE END AS evaporation,
  l_orderkey % 5 AS seed, l_extendedprice / 100000 AS best_fitness, l_quantity / 50 AS eco, l_shipdate AS logged FROM lineitem""",
}


def with_views(sql: str) -> str:
    """The query with the views it names (and those they name) as common table expressions."""
    needed: list[str] = []
    for name in reversed(VIEWS):
        if name in sql or any(name in VIEWS[n] for n in needed):
            needed.insert(0, name)
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in needed)
    body = sql.strip()
    if not head:
        return body
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"
