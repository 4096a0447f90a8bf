"""The registered queries over colour space, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huespan.functions import colour, spaces
from huespan.operators import choice, dual, grid, joins, quality, reports, search, tree
from huespan.session import fresh_path
from huespan.sources import images as src
from huespan.sources import stored

Query = Callable[[SparkSession, str], DataFrame]
#: The two standard queries: point and threshold.
A, B = ((66.0, 35.0, 226.0), 40.0), ((128.0, 128.0, 128.0), 50.0)
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_RGB = ", ".join(f"('0x' || substr(m, {2 * k + 1}, 2))::INT::DOUBLE AS {c}" for k, c in enumerate("rgb"))
IMG = f"(SELECT id, filename, {_RGB} FROM (SELECT o_orderkey AS id, 'item_' || o_orderkey || '.jpg' AS filename, md5('item_' || o_orderkey || '.jpg') AS m FROM orders))"


def _d(q: tuple[float, float, float]) -> str:
    return "sqrt(" + " + ".join(f"(({c}) - {v}) * (({c}) - {v})" for c, v in zip("rgb", q, strict=True)) + ")"


def _hits(q: tuple[tuple[float, float, float], float], where: str = "TRUE") -> str:
    return f"(SELECT *, {_d(q[0])} AS distance FROM {IMG} WHERE {_d(q[0])} <= {q[1]} AND {where})"


_RANK = "row_number() OVER (ORDER BY distance, id) AS rank"
_ROWS = "id, filename, r, g, b, distance"
LINEAR = f"SELECT {_ROWS}, {_RANK} FROM {_hits(A)}"


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.images_from_orders(spark, sf_dir)


@query(f"SELECT id, {_d(A[0])} AS distance FROM {IMG}")
def distance_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).select("id", colour.distance(A[0]).alias("distance"))


def _strategy(name: str, at: tuple = A, sql: str = LINEAR, **params: object) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.ranked(search.hits(images(spark, sf_dir), *at, name, **params)).select("id", "filename", "r", "g", "b", "distance", "rank")

    run.__name__ = f"{name}_search"
    run.__doc__ = f"Hits of the {name} strategy, with ranks."
    query(sql)(run)


def _fixed_gap(q: tuple[float, float, float]) -> str:
    size = colour.TOP / colour.FIXED_CELLS
    return " AND ".join(f"abs(least(floor({c} / {size}), 31) - {min(int(v // size), 31)}) <= 1" for c, v in zip("rgb", q, strict=True))


def _slack(name: str, **params: object) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.ranked(search.hits(images(spark, sf_dir), *A, name, slack=4.0, **params)).select("id", "filename", "r", "g", "b", "distance", "rank")

    run.__name__ = f"{name}_slack_search"
    run.__doc__ = f"Hits of the {name} strategy with four times the threshold's reach and the capacities of the large benchmark."
    query(LINEAR)(run)


_slack("octree", cap=20, max_depth=15)
_slack("quadtree", cap=25, max_depth=10)
for _name in ("linear", "bbox", "hash_grid", "hash_bounded", "hash_dynamic", "octree", "quadtree"):
    _strategy(_name)
_strategy("hash_fixed", B, f"SELECT {_ROWS}, {_RANK} FROM {_hits(B, _fixed_gap(B[0]))}")


def _ring(q: tuple[float, float, float], cell: float) -> tuple[str, str]:
    gaps = [f"abs(floor({c} / {cell}) - {int(v // cell)})" for c, v in zip("rgb", q, strict=True)]
    return f"greatest({', '.join(gaps)})", "(" + " + ".join(gaps) + ")"


_cheb, _ = _ring(A[0], 25.0)


@query(f"SELECT count(*) AS hits, sum(2 - {_cheb} + 1)::BIGINT AS visits FROM {_hits(A)}")
def hash_dynamic_visit_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.visit_counts(images(spark, sf_dir), *A, "cube")


_cheb30, _l1 = _ring(A[0], 30.0)


@query(f"SELECT count(*) AS hits, sum(({_cheb30} <= 2)::INT + ({_l1} <= 2 AND {_l1} <> {_cheb30})::INT)::BIGINT AS visits FROM {_hits(A)}")
def hash_shell_visit_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.visit_counts(images(spark, sf_dir), *A, "shell")


_QRGB = ", ".join(f"('0x' || substr(m, {2 * k + 1}, 2))::INT::DOUBLE AS q{c}" for k, c in enumerate("rgb"))
_PAIR_D = "sqrt((r - qr) * (r - qr) + (g - qg) * (g - qg) + (b - qb) * (b - qb))"


@query(f"SELECT query_id, id, {_PAIR_D} AS distance FROM {IMG}, (SELECT query_id, {_QRGB} FROM (SELECT p_partkey AS query_id, md5('query_' || p_partkey) AS m FROM part)) WHERE {_PAIR_D} <= 30.0")
def similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join over all images and all parts."""
    return joins.similarity_join(images(spark, sf_dir), src.queries_from_parts(spark, sf_dir), 30.0)


_PARTS = f"(SELECT query_id, {_QRGB} FROM (SELECT p_partkey AS query_id, md5('query_' || p_partkey) AS m FROM part))"
#: Thresholds of the parts: a few wide ones among many narrow ones.
_OWN = "CASE WHEN query_id % 50 = 0 THEN 120 WHEN query_id % 10 = 0 THEN 60 ELSE query_id % 30 END"


@query(f"SELECT query_id, id, {_PAIR_D} AS distance FROM {IMG}, (SELECT *, ({_OWN})::DOUBLE AS threshold FROM {_PARTS}) WHERE {_PAIR_D} <= threshold")
def similarity_join_per_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join over all images and all parts, thresholds from 0 to 120."""
    parts = src.queries_from_parts(spark, sf_dir).withColumn("threshold", F.expr(_OWN).cast("double"))
    return joins.similarity_join_per_row(images(spark, sf_dir), parts)


@query(f"SELECT query_id, unnest(range(1, len(best) + 1)) AS rank, unnest(best).id AS id, unnest(best).d AS distance FROM (SELECT query_id, min({{'d': {_PAIR_D}, 'id': id}}, 10) AS best FROM {IMG}, {_PARTS} GROUP BY query_id)")
def knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest images of every part."""
    return joins.knn_join(images(spark, sf_dir), src.queries_from_parts(spark, sf_dir), 10)


@query(ORACLES["similarity_join"])
def dual_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join of similarity_join, by two trees."""
    return dual.dual_tree_join(images(spark, sf_dir), src.queries_from_parts(spark, sf_dir), 30.0)


_COSINE = "1 - (r * qr + g * qg + b * qb) / (sqrt(r * r + g * g + b * b) * sqrt(qr * qr + qg * qg + qb * qb))"


@query(f"SELECT query_id, id, round({_COSINE}, 9) AS distance FROM {IMG}, {_PARTS} WHERE r + g + b > 0 AND qr + qg + qb > 0 AND {_COSINE} <= 0.002")
def cosine_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images in the direction of each part, within 3.6 degrees."""
    found = joins.cosine_join(images(spark, sf_dir), src.queries_from_parts(spark, sf_dir), 0.002)
    # To nine places as DuckDB rounds; F.round goes by decimal text, which costs more than the join itself.
    return found.withColumn("distance", F.floor(F.col("distance") * 1e9 + 0.5) / 1e9)


_ANGLE = f"(1 - (r * {A[0][0]} + g * {A[0][1]} + b * {A[0][2]}) / (sqrt(r * r + g * g + b * b) * sqrt({A[0][0]} * {A[0][0]} + {A[0][1]} * {A[0][1]} + {A[0][2]} * {A[0][2]})))"


@query(f"SELECT id, round({_ANGLE}, 9) AS distance FROM {IMG} WHERE r + g + b > 0 AND {_ANGLE} <= 0.01")
def cosine_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By angle, over the stored index, which opens the folders that hold such directions."""
    path = fresh_path(spark, "index")
    stored.create(images(spark, sf_dir), path, STORED_CAP)
    return stored.hits(spark, path, A[0], 0.01, "cosine").select("id", F.round("distance", 9).alias("distance"))


_BLOCKS = " + ".join(f"abs({c} - {v})" for c, v in zip("rgb", A[0], strict=True))


@query(f"SELECT id, {_BLOCKS} AS distance FROM {IMG} WHERE {_BLOCKS} <= 60")
def manhattan_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By city-block distance, with the grid's candidates: a cube holds that ball too."""
    return search.hits(images(spark, sf_dir), A[0], 60.0, "hash_grid", "manhattan").select("id", "distance")


def _lab_sql(r: str, g: str, b: str) -> list[str]:
    linear = [f"(CASE WHEN {c} / 255.0 <= {spaces.GAMMA_KNEE}::DOUBLE THEN {c} / 255.0 / {spaces.GAMMA_SLOPE}::DOUBLE ELSE pow(({c} / 255.0 + {spaces.GAMMA_OFFSET}::DOUBLE) / {1 + spaces.GAMMA_OFFSET}::DOUBLE, {spaces.GAMMA}::DOUBLE) END)" for c in (r, g, b)]
    light = ["(" + " + ".join(f"{m}::DOUBLE * {v}" for m, v in zip(row, linear, strict=True)) + f") / {w}::DOUBLE" for row, w in zip(spaces.XYZ, spaces.WHITE, strict=True)]
    x, y, z = [f"(CASE WHEN {t} > {spaces.DELTA**3!r}::DOUBLE THEN cbrt({t}) ELSE {t} / {3 * spaces.DELTA**2!r}::DOUBLE + {4 / 29!r}::DOUBLE END)" for t in light]
    return [f"{y} * 116 - 16", f"({x} - {y}) * 500", f"({y} - {z}) * 200"]


def _in_space(axes: list[str], point: tuple[float, float, float]) -> str:
    return "sqrt(" + " + ".join(f"(({a}) - {v!r}::DOUBLE) * (({a}) - {v!r}::DOUBLE)" for a, v in zip(axes, point, strict=True)) + ")"


_LAB_D = _in_space(_lab_sql("r", "g", "b"), spaces.SPACES["lab"].point(*A[0]))
_YUV_D = _in_space([" + ".join(f"{m}::DOUBLE * {c}" for m, c in zip(row, "rgb", strict=True)) for row in spaces.YUV], spaces.SPACES["yuv"].point(*A[0]))


@query(f"SELECT id, r, g, b, round({_LAB_D}, 6) AS distance FROM {IMG} WHERE {_LAB_D} <= 20")
def lab_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours that look alike: within 20 in L*a*b*, with bounds of the channels for the scan."""
    return spaces.hits(images(spark, sf_dir), A[0], 20.0, "lab").select("id", "r", "g", "b", F.round("distance", 6).alias("distance"))


@query(f"SELECT id, r, g, b, round({_YUV_D}, 6) AS distance FROM {IMG} WHERE {_YUV_D} <= 30")
def yuv_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaces.hits(images(spark, sf_dir), A[0], 30.0, "yuv").select("id", "r", "g", "b", F.round("distance", 6).alias("distance"))


def _tune_sql(threshold: float, finest: float, levels: int) -> str:
    tries = " UNION ALL ".join(
        f"SELECT {finest * 2**k}::DOUBLE AS size, count(*) AS cells, sum(n::DOUBLE * n) AS squares, sum(n) AS total, pow(2 * ceil({threshold} / {finest * 2**k}) + 1, 3)::DOUBLE AS visited FROM (SELECT count(*) AS n FROM {IMG} GROUP BY {', '.join(f'floor({c} / {finest * 2**k})' for c in 'rgb')})"
        for k in range(levels)
    )
    return f"SELECT size, cells, candidates, cost, cost = min(cost) OVER () AS chosen FROM (SELECT size, cells, visited * squares / total AS candidates, visited * squares / total + visited * {choice.CELL} AS cost FROM ({tries}))"


@query(_tune_sql(40.0, 4.0, 6))
def tuned_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cost of each cell size for the standard threshold, and the size to take."""
    return choice.tune_cell(images(spark, sf_dir), 40.0)


def _estimate_sql(k: int, at: tuple[tuple[float, float, float], float]) -> str:
    q, t = at
    size = colour.TOP / (1 << choice.LEVEL)
    near = " + ".join(f"power(greatest(c{j} * {size} - {v}, 0.0, {v} - (c{j} + 1) * {size}), 2)" for j, v in enumerate(q))
    far = " + ".join(f"power(greatest({v} - c{j} * {size}, (c{j} + 1) * {size} - {v}), 2)" for j, v in enumerate(q))
    steps = [(s + 0.5) / choice.SAMPLES for s in range(choice.SAMPLES)]
    covered = f"len([1 FOR s IN range({choice.SAMPLES**3}) IF " + " + ".join(f"power((c{j} + {steps}[s // {choice.SAMPLES**j} % {choice.SAMPLES} + 1]) * {size} - {v}, 2)" for j, v in enumerate(q)) + f" <= {t * t}]) / {choice.SAMPLES**3}"
    cells = ", ".join(f"least(floor({c} * 32 / 255.0), 31)::BIGINT AS c{j}" for j, c in enumerate("rgb"))
    return f"""SELECT {k}::INT AS place, sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (sqrt({far}) <= {t}), 0)::BIGINT AS at_least,
        round(sum(n * CASE WHEN sqrt({near}) > {t} THEN 0 WHEN sqrt({far}) <= {t} THEN 1 ELSE {covered} END), 6)::DOUBLE AS estimate, coalesce(sum(n) FILTER (sqrt({near}) <= {t}), 0)::BIGINT AS at_most
        FROM (SELECT {cells}, count(*) AS n FROM {IMG} GROUP BY ALL)"""


@query(" UNION ALL ".join(_estimate_sql(k, at) for k, at in enumerate((A, B))))
def selectivity_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a histogram of cells says of the two standard queries."""
    return choice.estimates(choice.histogram(images(spark, sf_dir)), [A, B]).withColumn("estimate", F.round("estimate", 6))


#: Images a leaf of the stored index holds in the queries: small, so that small tables have several leaves.
STORED_CAP = 2000


def _ranked_hits(found: DataFrame) -> DataFrame:
    return search.ranked(found).select("id", "filename", "r", "g", "b", "distance", "rank")


@query(LINEAR)
def stored_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images stored once as an index, and a search of it that opens the leaves in reach only."""
    path = fresh_path(spark, "index")
    stored.create(images(spark, sf_dir), path, STORED_CAP)
    return _ranked_hits(stored.hits(spark, path, *A))


@query(LINEAR)
def stored_insert_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after the images came in three batches, one of them twice."""
    path = fresh_path(spark, "index")
    for k in (0, 1, 2, 1):
        stored.insert(images(spark, sf_dir).where(F.col("id") % 3 == k), path, f"third-{k}", STORED_CAP)
    return _ranked_hits(stored.hits(spark, path, *A))


@query(f"SELECT {_ROWS}, {_RANK} FROM {_hits(A)} ORDER BY distance, id LIMIT 10")
def topk_within_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(search.hits(images(spark, sf_dir), *A), 10)


@query(
    f"""WITH h AS (SELECT *, {_cheb30}::INT AS ring FROM {_hits(A)}), c AS (SELECT ring, sum(count(*)) OVER (ORDER BY ring) AS cum FROM h GROUP BY ring),
    s AS (SELECT coalesce(min(CASE WHEN cum >= 10 THEN ring END), max(ring)) AS stop FROM c)
    SELECT {_ROWS}, ring, {_RANK} FROM h, s WHERE ring <= stop ORDER BY distance, id LIMIT 10"""
)
def ring_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ring_top_k(images(spark, sf_dir), *A, 10).withColumn("ring", F.col("ring").cast("int"))


@query(f"SELECT {_RANK}, id, distance FROM {_hits(A)} ORDER BY distance, id LIMIT 3")
def top3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.sample(search.hits(images(spark, sf_dir), *A))


@query(f"SELECT coalesce(bool_and(ok), TRUE) AS is_sorted FROM (SELECT distance >= lag(distance) OVER (ORDER BY distance, id) AS ok FROM {_hits(A)})")
def sortedness_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the result as a search orders it."""
    return quality.sortedness(search.similar(images(spark, sf_dir), *A))


_ORDERS = {"nearest first": "distance, id", "by id": "id", "farthest first": "distance DESC, id"}


@query(" UNION ALL ".join(f"SELECT '{n}' AS result_order, coalesce(bool_and(ok), TRUE) AS is_sorted FROM (SELECT distance >= lag(distance) OVER (ORDER BY {o}) AS ok FROM {_hits(A)})" for n, o in _ORDERS.items()))
def sortedness_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether distances rise along the hits in three orders; two of them are none of distance."""
    out = None
    for name, order in _ORDERS.items():
        rows = search.hits(images(spark, sf_dir), *A).orderBy(*[F.expr(o.removesuffix(" DESC")).desc() if o.endswith("DESC") else F.expr(o) for o in order.split(", ")])
        one = quality.sortedness(rows).select(F.lit(name).alias("result_order"), "is_sorted")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"SELECT count(*) AS found FROM {_hits(A)}")
def found_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.found_count(search.hits(images(spark, sf_dir), *A))


@query(f"SELECT found, total, CASE WHEN found > 0 THEN found / total * 100 END AS selectivity_pct FROM (SELECT count(*) FILTER ({_d(A[0])} <= 40.0) AS found, count(*) AS total FROM {IMG})")
def selectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.selectivity(images(spark, sf_dir), *A)


@query(f"SELECT min(distance) AS min_distance, max(distance) AS max_distance FROM {_hits(A)}")
def hit_distance_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.distance_range(search.hits(images(spark, sf_dir), *A))


_C30 = [f"floor({c} / 30.0)::INT" for c in "rgb"]


@query(f"SELECT id, {_C30[0]} AS cr, {_C30[1]} AS cg, {_C30[2]} AS cb, {_C30[0]} || ',' || {_C30[1]} || ',' || {_C30[2]} AS cell_key FROM {IMG}")
def cell_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = [F.col(f"c{c}") for c in "rgb"]
    return search.with_cells(images(spark, sf_dir), 30.0).select("id", *cells, colour.cell_key(*cells).alias("cell_key"))


_F = [f"least(floor({c} / 7.96875), 31)::BIGINT" for c in "rgb"]


@query(f"SELECT id, ({_F[0]} << 32) | ({_F[1]} << 16) | {_F[2]} AS packed FROM {IMG}")
def packed_cell_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).select("id", colour.packed_key(*[colour.clamped_cell(F.col(c)) for c in "rgb"]).alias("packed"))


@query(f"SELECT id, (r >= 127.5)::INT * 4 + (g >= 127.5)::INT * 2 + (b >= 127.5)::INT AS octant, (r >= 127.5)::INT + (g >= 127.5)::INT * 2 + (b >= 127.5)::INT * 4 AS octant_low_first FROM {IMG}")
def octant_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    mid = (127.5, 127.5, 127.5)
    return images(spark, sf_dir).select("id", colour.octant(mid).alias("octant"), colour.octant(mid, (1, 2, 4)).alias("octant_low_first"))


@query(f"SELECT id, (r >= 127.5)::INT * 2 + (g >= 127.5)::INT AS quadrant, (r >= 127.5)::INT + (g >= 127.5)::INT * 2 AS quadrant_low_first FROM {IMG}")
def quadrant_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    mid = (127.5, 127.5)
    return images(spark, sf_dir).select("id", colour.quadrant(mid).alias("quadrant"), colour.quadrant(mid, (1, 2)).alias("quadrant_low_first"))


@query(f"SELECT id, (r BETWEEN 0 AND 127.5 AND g BETWEEN 63 AND 255 AND b BETWEEN 10 AND 200) AS in_box, (r BETWEEN 0 AND 127.5 AND g BETWEEN 63 AND 255) AS in_rectangle FROM {IMG}")
def box_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).select("id", colour.box_contains((0, 63, 10), (127.5, 255, 200)).alias("in_box"), colour.box_contains((0, 63), (127.5, 255)).alias("in_rectangle"))


def _inner_sql(cap: int, depth: int, dims: int) -> str:
    cells = ", ".join(f"least(floor({c} * (1::BIGINT << l) / 255.0), (1::BIGINT << l) - 1)::BIGINT AS c{k}" for k, c in enumerate("rgb"[:dims]))
    return f"(SELECT l, {', '.join(f'c{k}' for k in range(dims))}, count(*) AS n FROM (SELECT l, {cells} FROM {IMG}, (SELECT range::INT AS l FROM range(0, {depth}))) GROUP BY ALL HAVING count(*) > {cap})"


def _stats_sql(cap: int, depth: int, dims: int) -> str:
    fan = (1 << dims) - 1
    return f"""SELECT total, max_depth, 1 + {fan} * i AS leaf_nodes, i AS internal_nodes, 1 + {fan} * i + i AS total_nodes,
        CASE WHEN i > 0 THEN (1 + {fan} * i) / i ELSE 0.0 END::DOUBLE AS ratio, total / (1 + {fan} * i) AS avg_per_leaf
        FROM (SELECT count(*) AS i, coalesce(max(l) + 1, 0)::INT AS max_depth FROM {_inner_sql(cap, depth, dims)}), (SELECT count(*) AS total FROM {IMG})"""


def _prune_sql(cap: int, depth: int, dims: int) -> str:
    names = [f"c{k}" for k in range(dims)]
    bits = ", ".join(f"{n} * 2 + ((o >> {dims - 1 - k}) & 1) AS {n}" for k, n in enumerate(names))
    gaps = " + ".join(f"power(greatest({n} * size - {q}, 0.0, {q} - ({n} + 1) * size), 2)" for n, q in zip(names, A[0], strict=False))
    return f"""WITH inner_nodes AS {_inner_sql(cap, depth, dims)},
        child AS (SELECT (l + 1)::INT AS l, {bits} FROM inner_nodes, (SELECT range AS o FROM range(0, {1 << dims})) UNION ALL SELECT 0, {', '.join('0' for _ in names)}),
        leaf AS (SELECT *, 255.0::DOUBLE / (1::BIGINT << l) AS size FROM child ANTI JOIN inner_nodes USING (l, {', '.join(names)}))
        SELECT l AS level, {', '.join(f'{n}::BIGINT AS {n}' for n in names)}, round(sqrt({gaps}), 6) AS gap FROM leaf WHERE sqrt({gaps}) <= {A[1]}"""


def _pruned(spark: SparkSession, sf_dir: str, cap: int, depth: int, dims: int) -> DataFrame:
    nodes = tree.prune(tree.leaves(images(spark, sf_dir), cap, depth, dims), *A, dims)
    return nodes.select("level", *[f"c{k}" for k in range(dims)], F.round("gap", 6).alias("gap"))


@query(_prune_sql(10, 10, 3))
def node_prune_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pruned(spark, sf_dir, 10, 10, 3)


@query(_prune_sql(25, 12, 2))
def node_prune_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pruned(spark, sf_dir, 25, 12, 2)


@query(f"SELECT count(*) AS images FROM {IMG}")
def image_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).agg(F.count(F.lit(1)).alias("images"))


_CELLS = f"(SELECT {_C30[0]} AS cr, {_C30[1]} AS cg, {_C30[2]} AS cb, count(*) AS n FROM {IMG} GROUP BY ALL)"


@query(f"SELECT count(*) AS cells, coalesce(avg(n), 0.0) AS avg_occupancy FROM {_CELLS}")
def grid_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.stats(images(spark, sf_dir))


@query(f"SELECT count(*) AS cells, min(n) AS min_occupancy, list_sort(list(n))[(count(*) // 2 + 1)] AS median_occupancy, max(n) AS max_occupancy FROM {_CELLS}")
def grid_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.occupancy(images(spark, sf_dir))


@query(_stats_sql(10, 10, 3))
def octree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.stats(images(spark, sf_dir), 10, 10, 3)


@query(_stats_sql(1, 25, 3))
def octree_stats_cap1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.stats(images(spark, sf_dir), 1, 25, 3)


@query(_stats_sql(25, 12, 2))
def quadtree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.stats(images(spark, sf_dir), 25, 12, 2)


@query(
    f"""WITH f AS (SELECT count(*) AS n FROM {_hits(B)}), x AS (SELECT count(*) AS n FROM {_hits(B, _fixed_gap(B[0]))})
    SELECT s AS strategy, CASE WHEN s = 'hash_fixed' THEN x.n ELSE f.n END AS found, f.n AS exact, 1.0::DOUBLE AS precision,
    CASE WHEN s = 'hash_fixed' AND f.n > 0 THEN x.n / f.n ELSE 1.0 END::DOUBLE AS recall, 1.0::DOUBLE AS duplication
    FROM f, x, (SELECT unnest({list(search.STRATEGIES)}) AS s)"""
)
def index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.recall(images(spark, sf_dir), *B)


@query(f"SELECT page_id, path, length, {_RGB} FROM (SELECT page_id, url AS path, length(html) AS length, md5(url || ':' || length(html)) AS m FROM pages)")
def extract_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    files = pages.select("page_id", F.col("url").alias("path"), F.length("html").cast("long").alias("length"))
    return src.extract_rgb(files)


@query(
    f"""WITH p AS (SELECT * FROM (SELECT 'page_' || page_id AS path, md5('page_' || page_id || ':' || length(html)) AS m FROM pages)),
    x AS (SELECT path, {_RGB} FROM p WHERE path = 'page_0')
    SELECT 999999::BIGINT AS id, coalesce(x.path, 'query.jpg') AS filename, coalesce(r, 128.0)::DOUBLE AS r, coalesce(g, 128.0)::DOUBLE AS g, coalesce(b, 128.0)::DOUBLE AS b, x.path IS NOT NULL AS found
    FROM (SELECT unnest(['page_0', 'no_such_page']) AS wanted) LEFT JOIN x ON x.path = wanted"""
)
def query_default_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    files = pages.select(F.concat(F.lit("page_"), F.col("page_id").cast("string")).alias("path"), F.length("html").cast("long").alias("length"))
    return src.query_point(files, "page_0").unionByName(src.query_point(files, "no_such_page"))


@query("SELECT p_partkey AS id, p_name || ' of ' || p_type AS name, CASE WHEN length(p_name || ' of ' || p_type) > 20 THEN left(p_name || ' of ' || p_type, 17) || '...' ELSE p_name || ' of ' || p_type END AS short FROM part")
def truncate_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("p_name", F.lit(" of "), "p_type")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), name.alias("name"), colour.truncated(name).alias("short"))


_TOTALS = [50, 10000, 25000, 50000, 100000, 150000, 206404]
_LADDER = "CASE WHEN t >= 150000 THEN [10000, 25000, 50000, 100000, 150000, t] WHEN t >= 100000 THEN [10000, 25000, 50000, 100000, t] WHEN t >= 50000 THEN [10000, 25000, 50000, t] WHEN t >= 25000 THEN [10000, 25000, t] WHEN t >= 10000 THEN [10000, t] ELSE [100, 500, 1000, 5000, t] END"


@query(f"SELECT t AS total, generate_subscripts(l, 1)::INT AS rung, unnest(l)::BIGINT AS scale FROM (SELECT t::BIGINT AS t, {_LADDER} AS l FROM (SELECT unnest({_TOTALS}) AS t))")
def scale_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.scale_ladder(spark.createDataFrame([(t,) for t in _TOTALS], "total long"))


_SCALES = [100, 1000, 5000, 10000, 100000]


@query(f"SELECT s::BIGINT AS scale, (SELECT count(*) FROM {_hits(A)} h WHERE h.id <= s) AS found FROM (SELECT unnest({_SCALES}) AS s)")
def found_by_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.found_by_scale(images(spark, sf_dir), *A, _SCALES)


_VALUES = ", ".join(f"('{s}', {n}, {i}::DOUBLE, {t}::DOUBLE, {f}::BIGINT, {reports.ORDER.index(s) + 1})" for s, n, i, t, f in reports.PUBLISHED)
_RESULTS = f"(SELECT * FROM (VALUES {_VALUES}) AS v(structure, dataset_size, insert_ms, search_ms, found, place))"


@query(
    f"""SELECT i.dataset_size, i.structure AS insert_winner, i.insert_ms, s.structure AS search_winner, s.search_ms
    FROM (SELECT *, row_number() OVER (PARTITION BY dataset_size ORDER BY insert_ms, place) AS k FROM {_RESULTS}) i
    JOIN (SELECT *, row_number() OVER (PARTITION BY dataset_size ORDER BY search_ms, place) AS k FROM {_RESULTS}) s ON i.dataset_size = s.dataset_size AND i.k = 1 AND s.k = 1"""
)
def winner_by_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.winner_by_scale(reports.published(spark))


_VARIANTS = ", ".join(f"('{s}', {n}, '{v}', {t}::DOUBLE)" for s, n, v, t in reports.VARIANTS)


@query(
    f"""SELECT structure, dataset_size, abs(rec - ite) * 100 / greatest(rec, ite) AS delta_pct, CASE WHEN rec < ite THEN 'recursive' ELSE 'iterative' END AS winner
    FROM (SELECT structure, dataset_size, max(ms) FILTER (variant = 'recursive') AS rec, max(ms) FILTER (variant = 'iterative') AS ite
    FROM (VALUES {_VARIANTS}) AS v(structure, dataset_size, variant, ms) GROUP BY ALL)"""
)
def variant_delta_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.variant_delta(spark.createDataFrame(reports.VARIANTS, "structure string, dataset_size int, variant string, insert_ms double"))


@query(
    f"""SELECT lpad(dataset_size::VARCHAR, 10, '0') || '-' || k AS line, CASE WHEN k = 1 THEN dataset_size END AS scale, structure, insert_ms, search_ms, found
    FROM (SELECT *, row_number() OVER (PARTITION BY dataset_size ORDER BY place) AS k FROM {_RESULTS})"""
)
def report_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.report_table(reports.published(spark))


@query(
    f"""SELECT 'bbox' AS strategy, f.n AS found, t.n AS total, CASE WHEN f.n > 0 THEN f.n / t.n * 100 END AS selectivity_pct, f.lo AS min_distance, f.hi AS max_distance, TRUE AS is_sorted,
    h.first_three, g.cells AS index_cells, g.avg_occupancy AS index_avg_occupancy
    FROM (SELECT count(*) AS n, min(distance) AS lo, max(distance) AS hi FROM {_hits(A)}) f, (SELECT count(*) AS n FROM {IMG}) t,
    (SELECT string_agg(rank || ':' || id || ':' || round(distance, 6)::DECIMAL(18, 6), ',' ORDER BY rank) AS first_three FROM (SELECT {_RANK}, id, distance FROM {_hits(A)} ORDER BY distance, id LIMIT 3)) h,
    (SELECT count(*) AS cells, coalesce(avg(n), 0.0) AS avg_occupancy FROM {_CELLS}) g"""
)
def analyze_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole analysis; the first three as text, the index statistics as columns."""
    row = quality.analyze(images(spark, sf_dir), *A)
    three = F.transform("first_three", lambda x: F.concat_ws(":", x["rank"].cast("string"), x["id"].cast("string"), F.round(x["distance"], 6).cast("decimal(18,6)").cast("string")))
    return row.withColumns({"first_three": F.array_join(three, ","), "index_cells": F.col("index")["cells"], "index_avg_occupancy": F.col("index")["avg_occupancy"]}).drop("index")


@query(f"SELECT id, 'Image ' || id || ' (' || filename || '): RGB(' || r::INT || '.0, ' || g::INT || '.0, ' || b::INT || '.0)' AS line FROM {IMG}")
def describe_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).select("id", colour.described().alias("line"))


@query(f"SELECT structure, dataset_size, insert_ms, search_ms, found, dataset_size / insert_ms * 1000 AS insert_per_s, insert_ms / dataset_size AS insert_ms_each FROM {_RESULTS}")
def insert_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.rates(reports.published(spark))


@query("SELECT * FROM (VALUES ('linear', 'linear'), ('bbox', 'bbox'), ('hash_grid', 'hash_grid(cell=30.000000)'), ('hash_fixed', 'hash_fixed(cells=32)'), ('hash_bounded', 'hash_bounded(cells=32)'), ('hash_dynamic', 'hash_dynamic(cell=25.000000)'), ('octree', 'octree(cap=10, max_depth=10)'), ('quadtree', 'quadtree(cap=25, max_depth=12)')) AS v(strategy, label)")
def strategy_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(s, search.label(s)) for s in search.STRATEGIES], "strategy string, label string")


# Orders as a listing of files: names with and without extensions of images, in both cases, some of them unreadable (without a length).
_KINDS = ["png", "JPG", "jpeg", "bmp", "Tif", "txt", "tiff", "PNG.bak"]
_LISTED = f"(SELECT 'dir/item_' || o_orderkey || '.' || {_KINDS}[o_orderkey % {len(_KINDS)} + 1] AS path, CASE WHEN o_orderkey % 13 <> 0 THEN o_custkey END AS length FROM orders)"
_PATH_RGB = ", ".join(f"('0x' || substr(md5(path || ':' || length), {2 * k + 1}, 2))::INT::DOUBLE AS {c}" for k, c in enumerate("rgb"))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("o_orderkey") % len(_KINDS) + 1).cast("int"))
    path = F.concat(F.lit("dir/item_"), F.col("o_orderkey").cast("string"), F.lit("."), kind)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(path.alias("path"), F.when(F.col("o_orderkey") % 13 != 0, F.col("o_custkey").cast("long")).alias("length"))


@query(f"SELECT row_number() OVER (ORDER BY path COLLATE C) AS id, split_part(path, '/', 2) AS filename, {_PATH_RGB} FROM {_LISTED} WHERE length IS NOT NULL AND lower(regexp_extract(path, '[.]([^./]+)$', 1)) IN {src.LOADED}")
def listed_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All loadable files of the listing, with ids in order of the path and colours."""
    return src.load_listed(listing(spark, sf_dir))


@query(f"SELECT row_number() OVER (ORDER BY path COLLATE C) AS id, split_part(path, '/', 2) AS filename FROM {_LISTED} WHERE length IS NOT NULL AND lower(regexp_extract(path, '[.]([^./]+)$', 1)) IN {src.LOADED} ORDER BY path COLLATE C LIMIT 1000")
def listed_images_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The load limit: the first thousand."""
    return src.load_listed(listing(spark, sf_dir), 1000).select("id", "filename")


@query(f"SELECT extension, count(*) AS n FROM (SELECT lower(regexp_extract(path, '[.]([^./]+)$', 1)) AS extension FROM {_LISTED}) WHERE extension IN {src.COUNTED} GROUP BY extension")
def listed_images_by_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.by_extension(listing(spark, sf_dir))


# Line items as a log of benchmark runs: the best run of each structure and size counts.
_RUN_PLACE = f"{reports.ORDER}[l_suppkey % {len(reports.ORDER)} + 1]"
_RUNS = f"(SELECT *, array_position({reports.ORDER}, structure) AS place FROM (SELECT {_RUN_PLACE} AS structure, (l_partkey % 40 + 1) * 1000 AS dataset_size, min(l_extendedprice)::DOUBLE AS insert_ms, min(l_quantity)::DOUBLE AS search_ms, count(*) AS found FROM lineitem GROUP BY ALL))"


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    structure = F.element_at(F.array(*[F.lit(x) for x in reports.ORDER]), (F.col("l_suppkey") % len(reports.ORDER) + 1).cast("int"))
    runs = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(structure.alias("structure"), ((F.col("l_partkey") % 40 + 1) * 1000).alias("dataset_size"))
    return runs.agg(F.min(F.col("l_extendedprice").cast("double")).alias("insert_ms"), F.min(F.col("l_quantity").cast("double")).alias("search_ms"), F.count(F.lit(1)).alias("found"))


@query(
    f"""SELECT i.dataset_size, i.structure AS insert_winner, i.insert_ms, s.structure AS search_winner, s.search_ms
    FROM (SELECT *, row_number() OVER (PARTITION BY dataset_size ORDER BY insert_ms, place) AS k FROM {_RUNS}) i
    JOIN (SELECT *, row_number() OVER (PARTITION BY dataset_size ORDER BY search_ms, place) AS k FROM {_RUNS}) s ON i.dataset_size = s.dataset_size AND i.k = 1 AND s.k = 1"""
)
def run_log_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.winner_by_scale(run_log(spark, sf_dir))


@query(
    f"""SELECT lpad(dataset_size::VARCHAR, 10, '0') || '-' || k AS line, CASE WHEN k = 1 THEN dataset_size END AS scale, structure, insert_ms, search_ms, found
    FROM (SELECT *, row_number() OVER (PARTITION BY dataset_size ORDER BY place) AS k FROM {_RUNS})"""
)
def run_log_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.report_table(run_log(spark, sf_dir))


@query(f"SELECT structure, dataset_size, insert_ms, search_ms, found, dataset_size / insert_ms * 1000 AS insert_per_s, insert_ms / dataset_size AS insert_ms_each FROM {_RUNS}")
def run_log_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.rates(run_log(spark, sf_dir))


@query(
    """SELECT structure, dataset_size, abs(rec - ite) * 100 / greatest(rec, ite) AS delta_pct, CASE WHEN rec < ite THEN 'recursive' ELSE 'iterative' END AS winner
    FROM (SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'Octree' ELSE 'Quadtree' END AS structure, (l_partkey % 40 + 1) * 1000 AS dataset_size, min(l_extendedprice) FILTER (l_linenumber % 2 = 0)::DOUBLE AS rec, min(l_extendedprice) FILTER (l_linenumber % 2 = 1)::DOUBLE AS ite FROM lineitem GROUP BY ALL)"""
)
def run_log_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of odd lines as iterative, of even ones as recursive."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    structure = F.when(F.col("l_suppkey") % 2 == 0, "Octree").otherwise("Quadtree")
    variant = F.when(F.col("l_linenumber") % 2 == 0, "recursive").otherwise("iterative")
    runs = items.groupBy(structure.alias("structure"), ((F.col("l_partkey") % 40 + 1) * 1000).alias("dataset_size"), variant.alias("variant"))
    return reports.variant_delta(runs.agg(F.min(F.col("l_extendedprice").cast("double")).alias("insert_ms")))


_SIZES = "(SELECT count(*) AS t FROM lineitem UNION ALL SELECT count(*) FROM orders UNION ALL SELECT count(*) FROM lineitem GROUP BY l_returnflag UNION ALL SELECT count(*) FROM orders GROUP BY o_orderstatus)"


@query(f"SELECT t AS total, generate_subscripts(l, 1)::INT AS rung, unnest(l)::BIGINT AS scale FROM (SELECT t::BIGINT AS t, {_LADDER} AS l FROM {_SIZES})")
def scale_ladder_of_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ladders of the sizes of two tables and of groups of their rows."""
    items, orders = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("lineitem", "orders"))
    n = F.count(F.lit(1)).alias("total")
    totals = [items.agg(n), orders.agg(n), items.groupBy("l_returnflag").agg(n).select("total"), orders.groupBy("o_orderstatus").agg(n).select("total")]
    out = totals[0]
    for t in totals[1:]:
        out = out.unionByName(t)
    return reports.scale_ladder(out)


# The next ones read a folder that they make; its names and sizes are known to the SQL as values.

#: Names of a small folder, as text; a name ending in .txt or in a subfolder isn't an image.
DEMO_FILES = ["a.png", "B.PNG", "c.jpeg", "d.bmp", "e.tif", "bad.jpg", "n.txt", "sub/f.png"]
_FILES = f"(SELECT name, lower(regexp_extract(name, '[.]([^./]+)$', 1)) AS extension FROM (VALUES {', '.join(f'({n!r})' for n in DEMO_FILES)}) AS v(name) WHERE name NOT LIKE '%/%')"


def demo_folder(spark: SparkSession) -> str:
    """A folder with DEMO_FILES in the place that driver and executors share."""
    path = fresh_path(spark, "images")
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name in DEMO_FILES:
        out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"))
        out.write(name.encode())
        out.close()
    fs.deleteOnExit(jvm.org.apache.hadoop.fs.Path(path))
    return path


@query(f"SELECT row_number() OVER (ORDER BY name COLLATE C) AS id, name AS filename FROM {_FILES} WHERE extension IN {src.LOADED} ORDER BY name COLLATE C LIMIT 4")
def file_scan_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four loadable files by path, with ids; their colours depend on the folder's own path and are left to tests."""
    return src.load_files(spark, demo_folder(spark), 4).select("id", "filename")


@query(f"SELECT extension, count(*) AS n FROM {_FILES} WHERE extension IN {src.COUNTED} GROUP BY extension")
def count_images_by_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.count_images(spark, demo_folder(spark))


@query(None)
def synthetic_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """found, total and share of hits among generated images: about 3.16 % for the standard query."""
    return quality.selectivity(src.synthetic(spark, 200_000), *B)
