"""Readers and writers of run logs, pixel tables and legends.

Interchange is CSV with ``;`` or ``,``; working tables are Parquet, partitioned by feature mode and objective.
Schemas are explicit where the columns are fixed; only a header line is read by the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapart.functions.landcover import hex_color, null_if_nan, slug

LEGEND = "clc_class int, r int, g int, b int, a int, clc_name string"
PARTITIONS = ("feature_mode", "fitness_name")


def nan_to_null(rows: DataFrame) -> DataFrame:
    """NaN is the only null in the CSV files; functions here expect null."""
    floats = {f.name: null_if_nan(F.col(f"`{f.name}`")) for f in rows.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return rows.withColumns(floats) if floats else rows


def sniffed_separator(spark: SparkSession, path: str) -> str:
    """``;`` if the header line has no comma but a semicolon, else a comma; one line is read."""
    head = spark.read.text(path).limit(1).first()
    return ";" if head and "," not in head[0] and ";" in head[0] else ","


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, sep: str | None = None, index: bool = False) -> DataFrame:
    """CSV with a header; the separator is told from the header line unless given; index drops the first column."""
    reader = spark.read.option("header", True).option("sep", sep or sniffed_separator(spark, path)).option("nanValue", "nan")
    rows = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return nan_to_null(rows.drop(rows.columns[0]) if index else rows)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target))


def read_or_empty(spark: SparkSession, path: str, schema: str | T.StructType, sep: str = ";") -> DataFrame:
    """A missing file is an empty table."""
    return read_csv(spark, path, schema, sep) if exists(spark, path) else spark.createDataFrame([], schema)


def read_summaries(spark: SparkSession, root: str, name: str, required: Sequence[str], sep: str = ";") -> DataFrame:
    """All root/<feature mode>/<objective>/name; the two columns come from the path where absent or null."""
    pattern = f"{root}/*/*/{name}"
    if not exists(spark, pattern):
        raise FileNotFoundError(pattern)
    rows = spark.read.option("header", True).option("sep", sep).option("inferSchema", True).csv(pattern)
    path = F.col("_metadata.file_path")
    told = {c: F.regexp_extract(path, r"([^/]+)/([^/]+)/[^/]+$", i + 1) for i, c in enumerate(PARTITIONS)}
    rows = rows.withColumns({c: F.coalesce(F.col(c), v) if c in rows.columns else v for c, v in told.items()})
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return nan_to_null(rows)


def read_legend(spark: SparkSession, path: str) -> DataFrame:
    """Headerless legend with a hex colour."""
    return spark.read.schema(LEGEND).csv(path).withColumn("color", hex_color(F.col("r"), F.col("g"), F.col("b")))


def append_runs(runs: DataFrame, path: str, partitions: Sequence[str] = PARTITIONS) -> None:
    runs.write.mode("append").partitionBy(*partitions).parquet(path)


def append_csv(rows: DataFrame, path: str, sep: str = ";") -> None:
    """Append rows as files with a header each to the CSV table at path, in the order of its columns; read_csv reads them as one table."""
    spark = rows.sparkSession
    if exists(spark, path):
        known = spark.read.option("header", True).option("sep", sep).csv(path).columns
        if set(known) != set(rows.columns):
            raise ValueError(f"columns differ: {sorted(set(known) ^ set(rows.columns))}")
        rows = rows.select(*known)
    rows.write.mode("append").option("header", True).option("sep", sep).option("emptyValue", "").csv(path)


def read_climate_classes(spark: SparkSession, pixels_path: str, classes_path: str, index: bool = True) -> DataFrame:
    """Pixels of one CSV with the climate class of the other, by cell; cells without a class are left out."""
    from terrapart.operators.raster import with_cell_class

    return with_cell_class(read_csv(spark, pixels_path, index=index), read_csv(spark, classes_path, index=index))


def overwrite(rows: DataFrame, path: str, sep: str | None = None) -> None:
    """Parquet, or CSV with a header if a separator is given."""
    writer = rows.write.mode("overwrite")
    writer.option("header", True).option("sep", sep).csv(path) if sep else writer.parquet(path)


def save_labels(labels: DataFrame, path: str) -> None:
    """Labels (name, node_id, label) in a folder for each solution's slug."""
    labels.withColumn("solution", slug(F.col("name"))).write.mode("overwrite").partitionBy("solution").parquet(path)


def load_labels(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.filter(F.col("name") == name) if name is not None else rows


def config_json(columns: Sequence[str]):
    """JSON text of configuration columns in alphabetical order."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]))


def moved(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder within its file system; an error if that fails or target exists."""
    old, new = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (source, target))
    files = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(new) or not files.rename(old, new):
        raise OSError(f"cannot rename {source} to {target}")


def migrate_runs(spark: SparkSession, path: str, rerun: DataFrame, legacy: str, archive: str) -> DataFrame:
    """Copy the run table to archive, replace the legacy algorithm's rows by the rerun, return a manifest.

    The new table is written beside the old one and takes its name by two renames, so a failure of the job leaves
    the old rows where they are; the old folder goes last.
    """
    from terrapart.operators.analysis import union_migrate

    old = spark.read.parquet(path)
    missing = [c for c in ("algorithm", *PARTITIONS) if c not in old.columns or c not in rerun.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    old.write.mode("errorifexists").partitionBy(*PARTITIONS).parquet(archive)
    kept = spark.read.parquet(archive)
    aside, former = f"{path.rstrip('/')}-new", f"{path.rstrip('/')}-old"
    union_migrate(kept, rerun, legacy).write.mode("errorifexists").partitionBy(*PARTITIONS).parquet(aside)
    moved(spark, path, former)
    moved(spark, aside, path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(former)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    counts = kept.agg(F.count("*").alias("archived"), F.count_if(F.col("algorithm") == legacy).alias("dropped"))
    return counts.join(rerun.agg(F.count("*").alias("added"))).withColumn("path", F.lit(path)).withColumn("archive", F.lit(archive))


def read_raster(spark: SparkSession, path: str) -> DataFrame:
    """row, col, layer, value of raster files, by the optional ``rasterio``; one file is one task's unit."""
    import pandas as pd

    def decode(batches):
        from rasterio.io import MemoryFile

        for batch in batches:
            for name, content in zip(batch.path, batch.content, strict=True):
                with MemoryFile(content).open() as raster:
                    band = raster.read(1, masked=True).astype("float64").filled(float("nan"))
                for row, values in enumerate(band):
                    yield pd.DataFrame({"row": row, "col": range(len(values)), "layer": name.rsplit("/", 1)[-1].rsplit(".", 1)[0], "value": values})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return nan_to_null(files.mapInPandas(decode, "row int, col int, layer string, value double"))
