"""An index that is stored once and searched many times: images in Z-order, with a manifest of the leaves of an octree.

    data/batch=<batch>/node=<node>/*.parquet     images of a batch, by the nodes of one level; a file holds a stretch of the Z-order
    versions/v=<n>/{manifest,cells,batches}      what holds since the n-th insert

The manifest has a row for each leaf in each file: its rows, and the least and largest value of every channel. A search keeps the leaves whose bounds come within
the threshold and opens no other files, so it prunes files, not rows; bounds are those of the rows, so colours outside the domain are found too. `cells` counts images by the 2^24 cells of the deepest level, whatever the
number of images; the tree follows from it alone: a node is split if it holds more than `cap` images and isn't on the deepest level.

Files don't follow the leaves: a batch has 512 nodes at most and as many files besides as tasks wrote it, however many leaves there are. While leaves are few, the nodes are on the level of the leaves of evenly spread images.

An insert adds its cells' counts to the stored ones, and as counts only grow, so does the tree: files with leaves beyond the cap are read and described anew by the leaves' children, and no stored image is written again.
The tree after any number of inserts is that of one load of everything. A new version is written aside and renamed, so a reader sees an insert wholly or not at all, and one that broke
off is repeated under the same batch id, whose folder it replaces; a batch that is known already is left out. There may be one writer at a time.

Images with a null, NaN or infinite channel are stored in a leaf of their own, which no search opens. Columns other than those of images are not stored.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from huespan.functions import colour
from huespan.session import written
from huespan.sources.images import SCHEMA

#: Halvings of a channel down to the deepest cells; images a leaf may hold; files that a search opens by name, beyond which it opens them by a join.
DEPTH, CAP, MOST_FOLDERS = 8, 1_000_000, 5000
#: The deepest level whose nodes are folders.
NODE_LEVEL = 3
#: The leaf, and the node, of images without a place.
NOWHERE = "none"
_ROWS = "id long, filename string, r double, g double, b double, batch string, node string, file string"
_BOUNDS = [f"{side}_{c}" for c in colour.CHANNELS for side in ("lo", "hi")]
_FILE = ["batch", "node", "file"]
_MANIFEST = "batch string, node string, file string, leaf string, level int, code long, n long, " + ", ".join(f"{b} double" for b in _BOUNDS)
_STORED = "id long, filename string, r double, g double, b double, batch string, node string"
#: Each byte with two zeros behind every bit.
_SPREAD = "array(" + ", ".join(f"{sum((v >> k & 1) << 3 * k for k in range(8))}L" for v in range(256)) + ")"


def _spread_bits(v: Column) -> Column:
    """A byte with two zeros behind every bit, by a table: shifts and masks name v twice a step, which makes code too long to be compiled."""
    return F.get(F.expr(_SPREAD), v)


def z_code(depth: int = DEPTH) -> Column:
    """Place of r, g, b in Z-order on the level `depth` (8 at most): bits of the three cells in turn, red first. Null where a channel isn't finite."""
    r, g, b = [_spread_bits(colour.level_cell(F.col(c), depth).cast("int")) for c in colour.CHANNELS]
    finite = F.lit(True)
    for c in colour.CHANNELS:
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    return F.when(finite, F.shiftleft(r, 2).bitwiseOR(F.shiftleft(g, 1)).bitwiseOR(b))


def _ancestor(code: Column, level: Column, depth: int = DEPTH) -> Column:
    return F.call_function("shiftright", code, (F.lit(depth) - level) * 3)


def count_cells(images: DataFrame) -> DataFrame:
    """code, n of the deepest cells that hold images."""
    return images.select(z_code().alias("code")).where("code IS NOT NULL").groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def leaf_of_cells(cells: DataFrame, cap: int) -> DataFrame:
    """code, level of the leaf that each cell lies in.

    Counts go up the levels, each of which is written once, as it is read for the one above and on the way down, and whether a node's ancestors are all split comes down them; a node meets its own parent only, so no key has more than eight rows."""
    levels = [cells.select("code", "n")]
    for _ in range(DEPTH):
        levels.append(written(levels[-1].groupBy(F.shiftright("code", 3).alias("code")).agg(F.sum("n").alias("n")), "level"))
    levels.reverse()
    known = levels[0].select("code", F.lit(0).alias("level"), (F.col("n") > cap).alias("split"))
    for k, nodes in enumerate(levels[1:], 1):
        up = known.select(F.col("code").alias("up"), F.col("level").alias("up_level"), F.col("split").alias("up_split"))
        here = nodes.withColumn("up", F.shiftright("code", 3)).join(up, "up")
        known = here.select("code", F.when(F.col("up_split"), F.lit(k)).otherwise(F.col("up_level")).alias("level"), (F.col("up_split") & (F.col("n") > cap)).alias("split"))
    return known.select("code", "level")


@dataclass
class Version:
    """A version of an index: its number, and the tables that hold for it."""

    number: int
    manifest: DataFrame
    cells: DataFrame
    batches: list[str]
    cap: int


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str) -> list[int]:
    at, fs = _fs(spark, f"{path}/versions")
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())


def version(spark: SparkSession, path: str, number: int | None = None) -> Version | None:
    """The latest version, or the one of that number; None if nothing is stored."""
    found = _numbers(spark, path)
    if not found:
        return None
    number = found[-1] if number is None else number
    base = f"{path}/versions/v={number}"
    known = spark.read.schema("batch string, cap long").parquet(f"{base}/batches").collect()
    return Version(number, spark.read.schema(_MANIFEST).parquet(f"{base}/manifest"), spark.read.schema("code long, n long").parquet(f"{base}/cells"), [r.batch for r in known], known[0].cap)


def _commit(spark: SparkSession, path: str, number: int, manifest: DataFrame, cells: DataFrame, batches: list[str], cap: int) -> None:
    aside = f"{path}/versions/.{uuid.uuid4().hex}"
    manifest.write.parquet(f"{aside}/manifest")
    cells.write.parquet(f"{aside}/cells")
    spark.createDataFrame([(b, cap) for b in batches], "batch string, cap long").coalesce(1).write.parquet(f"{aside}/batches")
    (old, fs), (new, _) = _fs(spark, aside), _fs(spark, f"{path}/versions/v={number}")
    if fs.exists(new) or not fs.rename(old, new):
        raise RuntimeError(f"version {number} of {path} was written by another insert")


def _rows(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """Images with their batch, node and file, of the files (batch, node, file): opened by name while they are few, else by a join that prunes partitions."""
    files = files.select(*_FILE).distinct()
    named, own = files.limit(MOST_FOLDERS + 1).collect(), ["batch", "node", F.col("_metadata.file_name").alias("file")]
    if not named:
        return spark.createDataFrame([], _ROWS)
    reader = spark.read.schema(_STORED).option("basePath", f"{path}/data")
    if len(named) <= MOST_FOLDERS:
        return reader.parquet(*[f"{path}/data/batch={r.batch}/node={r.node}/{r.file}" for r in named]).select(*SCHEMA.names, *own)
    return reader.parquet(f"{path}/data").select(*SCHEMA.names, *own).join(files, _FILE, "left_semi").select(*SCHEMA.names, *_FILE)


def _folders(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """Images of the files (batch, node, file)."""
    return _rows(spark, path, files).select(*SCHEMA.names)


def _described(rows: DataFrame, leaf_of: DataFrame) -> DataFrame:
    """Rows of the manifest for images with their batch, node and file. Bounds are taken by cell first, so a cell meets its leaf once a file."""
    bounds = [(f"{side}_{c}", c, f) for c in colour.CHANNELS for side, f in (("lo", F.min), ("hi", F.max))]
    by_cell = rows.withColumn("code", z_code()).groupBy(*_FILE, "code").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(b) for b, c, f in bounds])
    placed = by_cell.join(leaf_of, "code", "left").withColumn("code", _ancestor(F.col("code"), F.col("level")))
    found = placed.groupBy(*_FILE, "level", "code").agg(F.sum("n").alias("n"), *[f(b).alias(b) for b, _, f in bounds])
    leaf = F.when(F.col("level").isNull(), NOWHERE).otherwise(F.concat(F.lit("z"), F.col("level").cast("string"), F.lit("_"), F.col("code").cast("string")))
    return found.select(*_FILE, leaf.alias("leaf"), "level", "code", "n", *_BOUNDS)


def _node_level(cells: DataFrame, cap: int) -> int:
    """The level at which evenly spread images would have their leaves, NODE_LEVEL at most."""
    n = cells.agg(F.sum("n").alias("n")).first().n or 0
    return next((k for k in range(NODE_LEVEL) if cap * 8**k >= n), NODE_LEVEL)


def _write(images: DataFrame, path: str, batch: str, leaf_of: DataFrame, node_level: int) -> DataFrame:
    """Store images under the batch; its rows of the manifest. Tasks take stretches of the Z-order, by id where many images have one colour, as adaptive execution deals them."""
    spark, to = images.sparkSession, f"{path}/data/batch={batch}"
    node = F.coalesce(_ancestor(F.col("code"), F.lit(node_level)).cast("string"), F.lit(NOWHERE))
    dealt = images.select(*SCHEMA.names, z_code().alias("code")).repartitionByRange("code", "id").withColumn("node", node).sortWithinPartitions("node", "code")
    dealt.select(*SCHEMA.names, "node").write.mode("overwrite").partitionBy("node").parquet(to)
    stored = spark.read.schema(_STORED).option("basePath", f"{path}/data").parquet(to)
    return _described(stored.select(*colour.CHANNELS, "batch", "node", F.col("_metadata.file_name").alias("file")), leaf_of)


def insert(images: DataFrame, path: str, batch: str, cap: int = CAP) -> bool:
    """Add a batch of images; False if the batch was added before. The first insert sets the cap, and later ones keep it."""
    if not batch or not all(c.isalnum() or c in "-_." for c in batch):
        raise ValueError("a batch id is made of letters, digits, '-', '_' and '.'")
    spark = images.sparkSession
    now = version(spark, path)
    if now is not None and batch in now.batches:
        return False
    added = count_cells(images)
    if now is None:
        leaf_of = written(leaf_of_cells(cells := written(added, "cells"), cap), "leaves")
        manifest, number, batches = _write(images, path, batch, leaf_of, _node_level(cells, cap)), 1, [batch]
    else:
        cap, number, batches = now.cap, now.number + 1, [*now.batches, batch]
        cells = written(now.cells.unionByName(added).groupBy("code").agg(F.sum("n").alias("n")), "cells")
        leaf_of = written(leaf_of_cells(cells, cap), "leaves")
        still = leaf_of.select("level", _ancestor(F.col("code"), F.col("level")).alias("code")).distinct()
        placed, nowhere = now.manifest.where("level IS NOT NULL"), now.manifest.where("level IS NULL")
        outgrown = written(placed.join(still, ["level", "code"], "left_anti").select(*_FILE).distinct(), "outgrown")
        kept = placed.join(outgrown, _FILE, "left_anti").select(*now.manifest.columns)
        manifest = kept.unionByName(nowhere).unionByName(_described(_rows(spark, path, outgrown), leaf_of)).unionByName(_write(images, path, batch, leaf_of, _node_level(cells, cap)))
    _commit(spark, path, number, manifest, cells, batches, cap)
    return True


def create(images: DataFrame, path: str, cap: int = CAP, batch: str = "0") -> None:
    """Store images as a new index, in place of what is there."""
    clear(images.sparkSession, path)
    insert(images, path, batch, cap)


def clear(spark: SparkSession, path: str) -> None:
    """Delete the index."""
    at, fs = _fs(spark, path)
    fs.delete(at, True)


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete older versions and the files that only they hold; how many files went. No search of an older version may be running."""
    numbers = _numbers(spark, path)
    if len(numbers) < 2:
        return 0
    last, gone = version(spark, path).manifest, 0
    for n in numbers[:-1]:
        dead = version(spark, path, n).manifest.join(last.select(*_FILE), _FILE, "left_anti").select(*_FILE).distinct()
        for r in dead.toLocalIterator():
            at, fs = _fs(spark, f"{path}/data/batch={r.batch}/node={r.node}/{r.file}")
            gone += bool(fs.delete(at, True))
        at, fs = _fs(spark, f"{path}/versions/v={n}")
        fs.delete(at, True)
    return gone


def compact(spark: SparkSession, path: str, most: int = 4) -> bool:
    """Write the leaves that lie in more than `most` batches anew, as one batch, with the other leaves of their files; False if there are none."""
    now = version(spark, path)
    if now is None:
        return False
    many = written(now.manifest.groupBy("leaf").agg(F.count_distinct("batch").alias("batches")).where(F.col("batches") > most).select("leaf"), "many")
    if many.isEmpty():
        return False
    leaf_of = written(leaf_of_cells(now.cells, now.cap), "leaves")
    files = written(now.manifest.join(many, "leaf", "left_semi").select(*_FILE).distinct(), "files")
    rest = now.manifest.join(files, _FILE, "left_anti").select(*now.manifest.columns)
    anew = _write(_folders(spark, path, files), path, f"compact-{now.number + 1}", leaf_of, _node_level(now.cells, now.cap))
    _commit(spark, path, now.number + 1, rest.unionByName(anew), now.cells, now.batches, now.cap)
    return True


def near(manifest: DataFrame, query: tuple[float, float, float], reach: float) -> DataFrame:
    """Leaves in files whose bounds come within reach of the query."""
    return manifest.where(colour.gap_to_box(query) <= float(reach) * (1 + 1e-9) + 1e-9)


def near_direction(manifest: DataFrame, query: tuple[float, float, float], reach: float) -> DataFrame:
    """Leaves in files that may hold a colour whose direction lies within reach of the query's, as distance of unit vectors.

    In a box of channels from 0 up, a coordinate of the direction is least where its channel is least and the others are largest, and the other way round; those intervals are a box of directions.
    Leaves with a channel below 0 are kept."""
    norm = math.sqrt(sum(q * q for q in query))
    gap, some_negative = F.lit(0.0), F.lit(False)
    for c, q in zip(colour.CHANNELS, query, strict=True):
        others = [o for o in colour.CHANNELS if o != c]
        length = lambda own, other: F.sqrt(F.col(f"{own}_{c}") ** 2 + sum((F.col(f"{other}_{o}") ** 2 for o in others[1:]), F.col(f"{other}_{others[0]}") ** 2))  # noqa: B023, E731
        low = F.when(length("lo", "hi") > 0, F.col(f"lo_{c}") / length("lo", "hi")).otherwise(0.0)
        high = F.when(length("hi", "lo") > 0, F.col(f"hi_{c}") / length("hi", "lo")).otherwise(0.0)
        one = F.greatest(low - q / norm, F.lit(0.0), q / norm - high)
        gap, some_negative = gap + one * one, some_negative | (F.col(f"lo_{c}") < 0)
    return manifest.where(F.col("level").isNotNull() & (some_negative | (F.sqrt(gap) <= reach)))


def candidates(spark: SparkSession, path: str, query: tuple[float, float, float], threshold: float, metric: str = "euclidean") -> DataFrame:
    """Images of the files in reach; for distances in space with plain bounds that the scan can use. By cosine, a black query or a threshold from 1 on opens all."""
    now = version(spark, path)
    if now is None or not threshold >= 0:
        return spark.createDataFrame([], SCHEMA)
    if metric != "cosine":  # a city-block distance is no shorter than the straight one
        return _folders(spark, path, near(now.manifest, query, threshold)).where(colour.within_box(query, threshold))
    if threshold >= 1 or not any(query):
        return _folders(spark, path, now.manifest)
    return _folders(spark, path, near_direction(now.manifest, query, math.sqrt(2 * threshold) * (1 + 1e-9) + 1e-7))


def hits(spark: SparkSession, path: str, query: tuple[float, float, float], threshold: float, metric: str = "euclidean") -> DataFrame:
    """Stored images within the threshold, inclusive, with their distance."""
    return candidates(spark, path, query, threshold, metric).withColumn("distance", colour.distance(query, metric=metric)).where(F.col("distance") <= float(threshold))


def folders(spark: SparkSession, path: str, query: tuple[float, float, float]) -> list[tuple[float, int]]:
    """(distance of the bounds to the query, images) of each file: what a choice of strategy weighs. One row a file."""
    now = version(spark, path)
    rows = [] if now is None else now.manifest.where("level IS NOT NULL").groupBy(*_FILE).agg(F.min(colour.gap_to_box(query)).alias("apart"), F.sum("n").alias("n")).collect()
    return [(r.apart, r.n) for r in rows]


def images(spark: SparkSession, path: str) -> DataFrame:
    """All stored images."""
    now = version(spark, path)
    return spark.createDataFrame([], SCHEMA) if now is None else _folders(spark, path, now.manifest)
