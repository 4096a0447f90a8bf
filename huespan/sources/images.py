"""Where images come from: files, tables, generators; and where they go."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from huespan.operators.search import ranked

SCHEMA = T.StructType(
    [T.StructField("id", T.LongType(), False), T.StructField("filename", T.StringType(), False), *[T.StructField(c, T.DoubleType(), False) for c in "rgb"]]
)
#: Extensions that are loaded, and those that are only counted as well.
LOADED, COUNTED = ("jpg", "jpeg", "png", "bmp"), ("jpg", "jpeg", "png", "bmp", "tif", "tiff")
DEFAULT_QUERY = (128.0, 128.0, 128.0)


def _byte(hexes: Column, k: int) -> Column:
    return F.conv(F.substring(hexes, 2 * k + 1, 2), 16, 10).cast("double")


def hashed_rgb(text: Column) -> list[Column]:
    """Three bytes that a text determines, spread evenly, as columns r, g, b."""
    m = F.md5(text.cast("binary"))
    return [_byte(m, k).alias(c) for k, c in enumerate("rgb")]


def _hashed_once(rows: DataFrame, text: Column, names: list[str]) -> DataFrame:
    """Adds the three bytes of hashed_rgb under those names. A generator gives them as one number, so each text is hashed once: filters stay above it, while those on plain columns go down to the scan and hash the text again, and a generator of three columns hashes it three times."""
    three = F.conv(F.substring(F.md5(text.cast("binary")), 1, 6), 16, 10).cast("int")
    hashed = rows.select("*", F.inline(F.array(F.struct(three.alias("three_bytes")))))
    return hashed.withColumns({n: F.shiftright("three_bytes", 16 - 8 * k).bitwiseAND(F.lit(255)).cast("double") for k, n in enumerate(names)}).drop("three_bytes")


def extract_rgb(files: DataFrame, path: str = "path", length: str = "length") -> DataFrame:
    """Adds r, g, b that path and size determine; null where the size is unknown (the file can't be opened)."""
    key = F.concat(F.col(path), F.lit(":"), F.col(length).cast("string"))
    return files.select("*", *hashed_rgb(key))


def has_extension(path: Column, extensions: tuple[str, ...]) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*extensions)


def scan_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = LOADED) -> DataFrame:
    """path, length of the files right in a folder whose extension is listed, in any case. A folder that isn't there is empty."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "path string, length long")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
    return files.select("path", "length").where(has_extension(F.col("path"), extensions))


def numbered(files: DataFrame, limit: int | None = None) -> DataFrame:
    """Ids from 1 in order of the path, numbered by ranges of paths, so no task gets them all. With a limit, the top of the order is taken before numbering."""
    if limit is not None:
        files = files.orderBy("path").limit(limit)
    placed = ranked(files.withColumns({"distance": F.lit(0.0), "id": F.col("path")}))
    return placed.withColumn("id", F.col("rank")).drop("distance", "rank")


def load_files(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Images of a folder, with ids in order of the path."""
    return load_listed(scan_files(spark, path), limit)


def load_listed(files: DataFrame, limit: int | None = None) -> DataFrame:
    """Images of a listing (path, length): those of a loadable extension that can be opened, with ids in order of the path."""
    rows = numbered(extract_rgb(files.where(has_extension(F.col("path"), LOADED))).where(F.col("r").isNotNull()), limit)
    return rows.select("id", F.element_at(F.split("path", "/"), -1).alias("filename"), "r", "g", "b")


def count_images(spark: SparkSession, path: str) -> DataFrame:
    """Files by extension, of all that are counted."""
    return by_extension(scan_files(spark, path, COUNTED))


def by_extension(files: DataFrame, extensions: tuple[str, ...] = COUNTED) -> DataFrame:
    """extension (lower case), n of the files (path) whose extension is listed."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.where(has_extension(F.col("path"), extensions)).groupBy(ext.alias("extension")).agg(F.count(F.lit(1)).alias("n"))


def pixel_means(spark: SparkSession, path: str) -> DataFrame:
    """origin, r, g, b: means of the decoded pixels (an extension: the stated intent behind extract_rgb). Undecodable files are left out."""
    rows = spark.read.format("image").option("dropInvalid", "true").load(path).select("image.origin", "image.nChannels", "image.data")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            means = []
            for n, data in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                px = np.frombuffer(data.as_buffer(), dtype=np.uint8).reshape(-1, n).mean(axis=0)
                means.append((px[2], px[1], px[0]) if n >= 3 else (px[0],) * 3)  # stored as B, G, R
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([float(m[k]) for m in means], pa.float64()) for k in range(3))], ["origin", "r", "g", "b"])

    return rows.mapInArrow(work, "origin string, r double, g double, b double")


def synthetic(spark: SparkSession, n: int, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """n images with independent uniform channels in [0, 255)."""
    rows = spark.range(n) if partitions is None else spark.range(0, n, 1, partitions)
    return rows.select("id", F.format_string("synthetic_%d.jpg", "id").alias("filename"), *[(F.rand(seed * 3 + k) * 255).alias(c) for k, c in enumerate("rgb")])


def images_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as images: the name is made of the key, the colour of the name."""
    name = F.concat(F.lit("item_"), F.col("o_orderkey").cast("string"), F.lit(".jpg"))
    return _hashed_once(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), name.alias("filename")), F.col("filename"), ["r", "g", "b"])


def queries_from_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts as query points (query_id, qr, qg, qb)."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return _hashed_once(parts.select(F.col("p_partkey").alias("query_id")), F.concat(F.lit("query_"), F.col("query_id").cast("string")), ["qr", "qg", "qb"])


def query_point(files: DataFrame, wanted: str, default: tuple[float, float, float] = DEFAULT_QUERY) -> DataFrame:
    """One row: the query file's colour and name if it is among the files (path, length), else the default's."""
    found = extract_rgb(files.where(F.col("path") == wanted).select("path", "length"))
    row = found.agg(F.min_by(F.struct("path", "r", "g", "b"), "path").alias("x"))
    return row.select(
        F.lit(999999).cast("long").alias("id"), F.coalesce("x.path", F.lit("query.jpg")).alias("filename"), *[F.coalesce(f"x.{c}", F.lit(v)).alias(c) for c, v in zip("rgb", default, strict=True)], F.col("x").isNotNull().alias("found")
    )


def append_images(images: DataFrame, path: str) -> None:
    """Insert: rows are added to the stored bag, nothing is checked against what is there."""
    images.select(*SCHEMA.names).write.mode("append").parquet(path)


def clear_images(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(path)


def image_folder(path: str) -> str:
    """A local folder as a URI."""
    return path if "://" in path else "file://" + os.path.abspath(path)
