"""Rasters as tables: coordinates, dense grids, histograms, statistics, sampling, resampling, features, scaling."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrapart.functions import vectors
from terrapart.functions.landcover import null_if_nan

#: Columns that are no features, and the marks of the two feature groups in column names.
NOT_FEATURES = ["row", "col", "easting", "northing", "pixel_id", "superpixel", "superpixel_compact"]
TEMPERATURE_MARK, RAIN_MARK = "temp", "padavine"


def feature_columns(rows: DataFrame, exclude: Sequence[str] = NOT_FEATURES) -> list[str]:
    return [c for c in rows.columns if c not in exclude]


def climate_columns(names: Sequence[str]) -> tuple[list[str], list[str]]:
    """Temperature and rain columns, told by their names; both must exist."""
    found = [n for n in names if TEMPERATURE_MARK in n.lower()], [n for n in names if RAIN_MARK in n.lower()]
    if not all(found):
        raise ValueError("no temperature or no rain columns")
    return found


def with_cell_class(pixels: DataFrame, classes: DataFrame, column: str = "koppen_class") -> DataFrame:
    """pixels with the class of their cell (row, col); cells without one are left out."""
    return pixels.drop(column).join(classes.select("row", "col", column).filter(F.col(column).isNotNull()), ["row", "col"])


def complete_rows(rows: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without null or NaN in columns."""
    return rows.na.drop(subset=list(columns) if columns else None)


def pixel_centres(rows: DataFrame, x0: float, y0: float, dx: float, dy: float) -> DataFrame:
    """easting and northing of the centres of cells of a grid with its corner at (x0, y0)."""
    return rows.withColumns({"easting": F.lit(x0) + (F.col("col") + 0.5) * dx, "northing": F.lit(y0) + (F.col("row") + 0.5) * dy})


def layers_to_columns(cells: DataFrame, layers: Sequence[str]) -> DataFrame:
    """(row, col, layer, value) to one wide row for each cell; NaN becomes null."""
    return cells.groupBy("row", "col").pivot("layer", list(layers)).agg(F.first(null_if_nan(F.col("value")), ignorenulls=True))


def raster_grid(rows: DataFrame, value: str) -> DataFrame:
    """Dense grid, a row of values for each raster row up to the largest indices, null where no cell is.

    Rows without cells are null rows; one raster row is one output row, so memory follows its width.
    """
    size = rows.agg(F.max("row").alias("rows"), F.max("col").alias("cols"))
    lines = rows.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", F.col(value)))).alias("m"))
    frame = size.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows").cast("long"))).alias("row"), "cols")
    joined = frame.join(lines.withColumn("row", F.col("row").cast("long")), "row", "left")
    kind = rows.schema["col"].dataType
    return joined.select("row", F.transform(F.sequence(F.lit(0).cast(kind), F.col("cols").cast(kind)), lambda c: F.try_element_at("m", c)).alias("values"))


def class_histogram(rows: DataFrame, cls: str, row_range: tuple[int, int] | None = None, col_range: tuple[int, int] | None = None) -> DataFrame:
    """Count and share of every class inside a window (ends included); null classes do not count."""
    for name, span in (("row", row_range), ("col", col_range)):
        if span:
            rows = rows.filter(F.col(name).between(*span))
    counts = rows.filter(F.col(cls).isNotNull()).groupBy(cls).agg(F.count("*").alias("count"))
    return counts.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy()))


def band_stats(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """band, n, min, max, mean and population deviation of every column, without nulls and NaN; one pass."""
    parts = []
    for c in columns:
        x = null_if_nan(F.col(c).cast("double"))
        parts.append(F.struct(F.lit(c).alias("band"), F.count(x).alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std")))
    return rows.agg(F.array(*parts).alias("b")).select(F.explode("b").alias("b")).select("b.*")


def sample_classes(points: DataFrame, cells: DataFrame, x0: float, y0: float, dx: float, dy: float) -> DataFrame:
    """points (easting, northing) with the class of the cell they lie in; null outside the raster."""
    at = points.withColumns({"__row": F.floor((F.col("northing") - y0) / dy).cast("long"), "__col": F.floor((F.col("easting") - x0) / dx).cast("long")})
    grid = cells.select(F.col("row").cast("long").alias("__row"), F.col("col").cast("long").alias("__col"), "cell_class")
    return at.join(grid, ["__row", "__col"], "left").drop("__row", "__col")


def resample_bilinear(target: DataFrame, cells: DataFrame, scale: float, offset: float = 0.0) -> DataFrame:
    """value of each target cell (row, col) from the four source cells around (row*scale+offset, col*scale+offset).

    Weights of missing cells are left out; null if all are missing. Each target meets its four cells by an
    equality join.
    """
    y, x = F.col("row") * scale + offset, F.col("col") * scale + offset
    at = target.select("row", "col", y.alias("__y"), x.alias("__x"))
    corner = F.array(*[F.struct((F.floor("__y") + i).cast("long").alias("r"), (F.floor("__x") + j).cast("long").alias("c")) for i in (0, 1) for j in (0, 1)])
    near = at.withColumn("__k", F.explode(corner)).select("row", "col", F.col("__k.r").alias("__r"), F.col("__k.c").alias("__c"), ((1 - F.abs(F.col("__y") - F.col("__k.r"))) * (1 - F.abs(F.col("__x") - F.col("__k.c")))).alias("__w"))
    source = cells.select(F.col("row").cast("long").alias("__r"), F.col("col").cast("long").alias("__c"), null_if_nan(F.col("value").cast("double")).alias("__v"))
    met = near.join(source, ["__r", "__c"], "left")
    w = F.when(F.col("__v").isNotNull(), F.col("__w"))
    return met.groupBy("row", "col").agg((F.sum(w * F.col("__v")) / F.nullif(F.sum(w), F.lit(0.0))).alias("value"))


def raw_features(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.withColumn("f", F.array(*[F.col(c).cast("double") for c in columns]))


def climate_features(rows: DataFrame, temperature: str, rain: str, more: bool = False) -> DataFrame:
    """Row summaries of two vector columns."""
    found = vectors.row_features(F.col(temperature), F.col(rain))
    if more:
        found |= vectors.more_row_features(F.col(temperature), F.col(rain))
    return rows.withColumns(found)


def standard_scale(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / population deviation; a constant column keeps scale 1."""
    stats = rows.agg(*[F.avg(c).alias(f"__m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"__s_{c}") for c in columns])
    joined = rows.join(F.broadcast(stats))  # one row
    scaled = {c: (F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") == 0, 1.0).otherwise(F.col(f"__s_{c}")) for c in columns}
    return joined.withColumns(scaled).select(*rows.columns)


def minmax_scale(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - min) / (max - min); a constant column becomes 0."""
    stats = rows.agg(*[F.min(c).alias(f"__a_{c}") for c in columns], *[F.max(c).alias(f"__b_{c}") for c in columns])
    joined = rows.join(F.broadcast(stats))  # one row
    scaled = {c: F.coalesce((F.col(c) - F.col(f"__a_{c}")) / F.nullif(F.col(f"__b_{c}") - F.col(f"__a_{c}"), F.lit(0.0)), F.col(c) * 0.0) for c in columns}
    return joined.withColumns(scaled).select(*rows.columns)


def superpixel_means(rows: DataFrame, superpixel: str, features: str = "f", weight: str | None = None) -> DataFrame:
    """Mean feature vector, mean position and number of pixels of each superpixel, with ids from 0."""
    long = rows.select(superpixel, "row", "col", F.posexplode(features).alias("p", "x"))
    vector = long.groupBy(superpixel, "p").agg(F.avg("x").alias("x")).groupBy(superpixel).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("f"))
    place = rows.groupBy(superpixel).agg(F.avg("row").alias("r"), F.avg("col").alias("c"), F.count("*").cast("double").alias("weight"))
    joined = vector.join(place, superpixel)
    return joined.withColumn("node_id", (F.row_number().over(Window.orderBy(superpixel)) - 1).cast("long"))


def tile_superpixels(rows: DataFrame, size: int) -> DataFrame:
    """Square tiles of size x size cells as superpixels; deterministic and without a shuffle."""
    return rows.withColumn("superpixel", F.concat_ws("_", F.floor(F.col("row") / size).cast("string"), F.floor(F.col("col") / size).cast("string")))


def nearest_centres(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The number of the centre nearest to each point of the plane, of equally near ones the smallest; exact.

    Points of a cell of about four centres meet only the centres that can be nearest to one of them.
    """
    by = np.argsort(centres[:, 0], kind="stable")
    y, x = centres[by].T.copy()
    low, span = centres.min(axis=0), np.ptp(centres, axis=0)
    size = np.where(span > 0, span, 1.0) / max(1.0, (len(centres) / 4) ** 0.5)
    cell = np.floor((points - low) / size)
    order = np.lexsort((cell[:, 1], cell[:, 0]))
    starts = np.flatnonzero(np.r_[True, (np.diff(cell[order], axis=0) != 0).any(axis=1)]) if len(points) else []
    out = np.empty(len(points), np.int32)
    for at in np.split(order, starts[1:]) if len(points) else []:
        mine = points[at]
        first, last = mine.min(axis=0), mine.max(axis=0)
        mid, half = (first + last) / 2, float(np.hypot(*(last - first))) / 2
        wide = 3.0 * size[0] + half
        while True:
            i, j = np.searchsorted(y, mid[0] - wide, "left"), np.searchsorted(y, mid[0] + wide, "right")
            if j > i:
                square = (y[i:j] - mid[0]) ** 2 + (x[i:j] - mid[1]) ** 2
                reach = (square.min() ** 0.5 + 2.0 * half) * (1.0 + 1e-9)
                if reach <= wide or j - i == len(y):
                    break
                wide = max(2.0 * wide, reach)
            else:
                wide *= 2.0
        near = i + np.flatnonzero(square <= reach**2)
        near = near[np.argsort(by[near])]
        for some in range(0, len(mine), 1 << 14):
            part = mine[some : some + (1 << 14)]
            far = (part[:, :1] - y[near]) ** 2 + (part[:, 1:] - x[near]) ** 2
            out[at[some : some + (1 << 14)]] = by[near[far.argmin(axis=1)]]
    return out


def kmeans_superpixels(rows: DataFrame, target_size: int, seed: int = 0, max_iter: int = 10, tol: float = 1e-4) -> DataFrame:
    """Clusters of standardised positions with about target_size cells each, as superpixels.

    First centres and rounds are those of pyspark.ml's k-means, but a position is not held against all centres,
    whose number grows with the cells.
    """
    k = max(1, rows.count() // target_size)
    at = standard_scale(rows.withColumns({"__r": F.col("row").cast("double"), "__c": F.col("col").cast("double")}), ["__r", "__c"])
    if k < 2:
        return rows.withColumn("superpixel", F.lit(0))
    places = at.select("__r", "__c").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        centres = drawn_rows(places, k, seed)
        for _ in range(max_iter):
            found = places.mapInArrow(partial(cell_sums, centres=centres), "id int, n double, r double, c double")
            sums = found.groupBy("id").agg(F.sum("n").alias("n"), F.sum("r").alias("r"), F.sum("c").alias("c")).toPandas()  # a row for each centre
            moved = centres.copy()
            moved[sums.id.to_numpy()] = sums[["r", "c"]].to_numpy() / sums[["n"]].to_numpy()
            still = (((moved - centres) ** 2).sum(axis=1) <= tol * tol).all()
            centres = moved
            if still:
                break
    finally:
        places.unpersist()

    @F.pandas_udf("int")
    def label(r: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(nearest_centres(np.column_stack([r, c]), centres))

    return at.withColumn("superpixel", label("__r", "__c")).drop("__r", "__c")


def drawn_rows(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """Different rows of k that pyspark.ml's k-means draws as its first centres; its fit would predict all rows after the draw."""
    spark = rows.sparkSession
    drawn = rows._jdf.javaRDD().takeSample(False, k, spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt())
    found = DataFrame(spark._jsparkSession.createDataFrame(drawn, rows._jdf.schema()), spark).toPandas()
    return found.drop_duplicates().to_numpy()


def cell_sums(batches: Iterator[pa.RecordBatch], centres: np.ndarray, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Number and sums of the positions of each centre that has some, over ``most`` positions at a time."""
    k, total = len(centres), np.zeros((3, len(centres)))

    def add(parts: list[np.ndarray]) -> None:
        points = np.concatenate(parts)
        label = nearest_centres(points, centres)
        total[0] += np.bincount(label, minlength=k)
        total[1] += np.bincount(label, weights=points[:, 0], minlength=k)
        total[2] += np.bincount(label, weights=points[:, 1], minlength=k)

    held = []
    for batch in batches:
        held.append(np.column_stack([batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)]))
        if sum(map(len, held)) >= most:
            add(held)
            held = []
    if held:
        add(held)
    some = np.flatnonzero(total[0])
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *[pa.array(t[some]) for t in total]], names=["id", "n", "r", "c"])


def grouped_pca(rows: DataFrame, groups: dict[str, tuple[str, int]], key: str) -> tuple[DataFrame, dict[str, list[float]]]:
    """First components of each group's centred vectors, min-max scaled, and their explained variance.

    groups: name to (vector column, number of components). The entry of a component with the largest absolute
    loading is positive.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    out, explained = rows.select(key), {}
    for name, (column, k) in groups.items():
        size = len(rows.select(column).first()[0])
        means = rows.agg(*[F.avg(F.col(column)[i]).alias(f"m{i}") for i in range(size)]).first()
        centred = rows.select(key, array_to_vector(F.zip_with(column, F.array(*[F.lit(m) for m in means]), lambda x, m: x - m)).alias("v"))
        model = PCA(k=k, inputCol="v", outputCol="p").fit(centred)
        loadings = model.pc.toArray()
        signs = [1.0 if loadings[abs(loadings[:, j]).argmax(), j] >= 0 else -1.0 for j in range(k)]
        explained[name] = list(model.explainedVariance)
        from pyspark.ml.functions import vector_to_array

        part = model.transform(centred).select(key, *[(vector_to_array("p")[j] * signs[j]).alias(f"{name}_pc{j + 1}") for j in range(k)])
        out = out.join(part, key)
    return minmax_scale(out, [c for c in out.columns if c != key]), explained


def dominant_palette(pixels: DataFrame, k: int = 12, white: float = 245.0, most: int = 100_000, seed: int = 0) -> DataFrame:
    """Cluster centres of the colours (r, g, b) that are not near white, with the number of sampled pixels.

    The sample of at most ``most`` pixels is the operator's own definition.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    seen = pixels.filter((F.col("r") + F.col("g") + F.col("b")) / 3.0 < white).orderBy(F.rand(seed)).limit(most)
    data = VectorAssembler(inputCols=["r", "g", "b"], outputCol="v").transform(seen)
    model = KMeans(k=k, seed=seed, featuresCol="v", predictionCol="color").fit(data)
    centres = pixels.sparkSession.createDataFrame([(i, *map(float, c)) for i, c in enumerate(model.clusterCenters())], "color int, r double, g double, b double")
    return model.transform(data).groupBy("color").agg(F.count("*").alias("n")).join(centres, "color").orderBy(F.desc("n"), "color")
