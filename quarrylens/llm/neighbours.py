"""Most similar vectors for every vector.

Stable (Gaussian) projections to few dimensions keep distances: the squared projected distance of two points is their
squared distance times a chi-square variable. A kd-tree over the projections splits the vectors into blocks, and each
block into tiles. A neighbour at distance d lies in a cell of the tree with a probability that follows from the query's
distances to the cell's planes, so a query goes to cells in the order of these probabilities, ring by ring, until the
cells it has not seen hold a neighbour with a probability below ``1 - sure``. Only sketches of 64 bytes travel that far.
What lies within the projected radius is then verified with the whole vectors, in the blocks that hold such a point and
in no others, until the chi-square test says that a closer point beyond the radius is improbable.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylens.session import cut

#: Projected dimensions, probability that a neighbour lies in the cells seen, and within the radius verified.
PROJECTED, SURE = 64, 0.995
#: Rows of a block at most and at least, sample rows that fit the kd-tree.
BLOCK_MOST, BLOCK_LEAST, SAMPLE = 32768, 1024, 4096
#: Rows of a tile inside a block, share of near points from which a tile is verified as a whole, pairs verified at once.
TILE, DENSE, AT_ONCE = 256, 0.02, 8192
#: Distances held at once, 8 MB of them: a block's size doesn't show in a task's memory.
DISTANCES = 1 << 21
#: Steps of a sketch to the unit: projections of unit vectors are standard normal, so 127 steps reach beyond 5 deviations.
STEPS = 24.0
#: The first radius is that much larger than the projected distance of the k-th neighbour asks for.
SLACK = 1.4


def chi_square(dims: int, p: float) -> float:
    """Quantile of the chi-square distribution (Wilson-Hilferty)."""
    z = NormalDist().inv_cdf(p)
    return dims * (1 - 2 / (9 * dims) + z * math.sqrt(2 / (9 * dims))) ** 3


def projection(dims: int, projected: int) -> np.ndarray:
    return np.random.default_rng(20130).standard_normal((dims, projected)).astype(np.float32)


def pack(units: np.ndarray) -> list[bytes]:
    """Each unit vector as its scale and 16-bit integers: half the bytes, errors near 1e-6."""
    scale = (np.abs(units).max(axis=1) / 32767).astype(np.float32)
    whole = np.rint(units / scale[:, None]).astype(np.int16)
    return [a.tobytes() + b.tobytes() for a, b in zip(scale, whole)]


def _bytes_of(column: pa.Array, width: int) -> bytes | memoryview:
    """The bytes of a binary column whose values all have ``width`` bytes, not copied."""
    if not len(column):
        return b""
    wide = pa.types.is_large_binary(column.type)
    first = int(np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset])
    return memoryview(column.buffers()[2])[first : first + len(column) * width]


def unpack(packed: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(scales, integers) of a binary column, as views of its buffer."""
    rows = np.frombuffer(_bytes_of(packed, 4 + 2 * dims), np.dtype([("scale", "<f4"), ("whole", "<i2", (dims,))]))
    return rows["scale"], rows["whole"]


def floats(scales: np.ndarray, whole: np.ndarray, rows: np.ndarray | slice) -> np.ndarray:
    return whole[rows].astype(np.float32) * scales[rows][:, None]


def packed_vectors(vectors: DataFrame, node_col: str, vector_col: str, dims: int, more: list[str] | None = None) -> DataFrame:
    """``(node, key, packed, *more)`` of the rows with a node; key (equal directions) and packed are null unless the vector has
    ``dims`` finite numbers and isn't all zero."""
    more = more or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            whole = np.flatnonzero(sizes == dims)
            flat = column.take(pa.array(whole)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
            norms = np.sqrt((flat**2).sum(axis=1))
            good = np.isfinite(norms) & (norms > 0)
            units = (flat[good] / norms[good][:, None]).astype(np.float32)
            packed: list[bytes | None] = [None] * batch.num_rows
            for at, x in zip(whole[good], pack(units) if len(units) else []):
                packed[at] = x
            keys = [x and hashlib.blake2b(x, digest_size=16).digest() for x in packed]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(packed, pa.binary()), *batch.columns[2:]], ["node", "key", "packed", *more])

    kinds = "".join(f", {c} {vectors.schema[c].dataType.simpleString()}" for c in more)
    return vectors.select(F.col(node_col).alias("node"), F.col(vector_col).alias("v"), *more).where("node is not null").mapInArrow(run, "node string, key binary, packed binary" + kinds)


def fit_tree(points: np.ndarray, leaves: int) -> list[tuple[int, float]]:
    """A complete kd-tree as (dimension, threshold) by heap order: the widest dimension is split at its median."""
    depth = max(0, math.ceil(math.log2(max(1, leaves))))
    tree, parts = [], [points]
    for _ in range(depth):
        below = []
        for part in parts:
            dim = int(part.var(axis=0).argmax()) if len(part) > 1 else 0
            cut_at = float(np.median(part[:, dim])) if len(part) else 0.0
            tree.append((dim, cut_at))
            below += [part[part[:, dim] <= cut_at], part[part[:, dim] > cut_at]]
        parts = below
    return tree


def leaf_of(tree: list[tuple[int, float]], points: np.ndarray) -> np.ndarray:
    at = np.zeros(len(points), np.int64)
    if tree:
        dims, cuts = np.array([x[0] for x in tree]), np.array([x[1] for x in tree], np.float32)
        for _ in range((len(tree) + 1).bit_length() - 1):
            at = 2 * at + 1 + (points[np.arange(len(points)), dims[at]] > cuts[at])
        at -= len(tree)
    return at


def sketches(scales: np.ndarray, whole: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Projections rounded to 8 bits."""
    parts = [np.clip(np.rint(STEPS * (floats(scales, whole, slice(i, i + 4096)) @ matrix)), -127, 127) for i in range(0, len(whole), 4096)]
    return np.vstack(parts).astype(np.int8) if parts else np.zeros((0, matrix.shape[1]), np.int8)


def sketch_matrix(column: pa.Array, projected: int) -> np.ndarray:
    return np.frombuffer(_bytes_of(column, projected), np.int8).reshape(-1, projected).astype(np.float32)


def below(x: np.ndarray) -> np.ndarray:
    """Probability that a standard normal variable is smaller (Abramowitz and Stegun 7.1.26, errors under 1e-7)."""
    y = np.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * y)
    tail = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * np.exp(-y * y) / 2
    return np.where(x < 0, tail, 1 - tail)


Bounds = dict[int, tuple[float, float]]


def cell_masses(tree: list[tuple[int, float]], points: np.ndarray, spread: np.ndarray, inside: Bounds | None = None) -> np.ndarray:
    """Probability, per point and leaf, that a neighbour lies in the leaf's cell.

    ``spread``: standard deviation of a neighbour's displacement along a projection. ``inside``: bounds of the cell that
    the tree divides, on which the probabilities are conditional.
    """
    leaves = len(tree) + 1
    out = np.empty((len(points), leaves), np.float32)
    start = {j: (below((lo - points[:, j]) / spread), below((hi - points[:, j]) / spread)) for j, (lo, hi) in (inside or {}).items()}

    def descend(node: int, bounds: dict[int, tuple[np.ndarray, np.ndarray]], mass: np.ndarray) -> None:
        if node >= len(tree):
            out[:, node - len(tree)] = mass
            return
        dim, at = tree[node]
        low, high = bounds.get(dim, (np.zeros(len(points)), np.ones(len(points))))
        middle = np.clip(below((at - points[:, dim]) / spread), low, high)
        width = high - low
        # far from the cell both ends look alike: then either half may hold what is there
        share = np.where(width > 1e-9, (middle - low) / np.maximum(width, 1e-9), 0.5)
        descend(2 * node + 1, {**bounds, dim: (low, middle)}, mass * share)
        descend(2 * node + 2, {**bounds, dim: (middle, high)}, mass * (1 - share))

    descend(0, start, np.ones(len(points)))
    return out


def cells(tree: list[tuple[int, float]]) -> list[Bounds]:
    """The bounds of every leaf's cell, by dimension."""
    boxes: list[Bounds] = [{}]
    for node, (dim, at) in enumerate(tree):
        low, high = boxes[node].get(dim, (-math.inf, math.inf))
        boxes += [{**boxes[node], dim: (low, at)}, {**boxes[node], dim: (at, high)}]
    return boxes[len(tree) :]


def smallest(found: np.ndarray, fresh: np.ndarray, k: int) -> np.ndarray:
    """The k smallest of either, per row."""
    both = np.concatenate([found, fresh], axis=1)
    return np.partition(both, k - 1, axis=1)[:, :k] if both.shape[1] > k else both


def projected_in_block(table: pa.Table, projected: int, k: int, sure: float, boxes: list[Bounds]) -> pa.Table:
    """``(key, block, near, compared)``: the k smallest squared projected distances of each query to a block's points.

    Rows are the block's own points (``data``; they ask if ``asks``) and queries from elsewhere with the ``spread`` known so
    far. Own points are compared with the whole block, others with tiles in the order of their probabilities.
    """
    block, leaf = table.column("block")[0].as_py(), table.column("leaf")[0].as_py()
    data = table.column("data").to_numpy(zero_copy_only=False).astype(bool)
    asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
    spots = sketch_matrix(table.column("sketch").combine_chunks(), projected)
    d, own, foreign = np.flatnonzero(data), np.flatnonzero(data & asks), np.flatnonzero(~data)
    points, squares = spots[d], (spots[d] ** 2).sum(axis=1)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def distances(rows: np.ndarray, some: np.ndarray | slice) -> np.ndarray:
        far = (spots[rows] * -2) @ points[some].T
        far += (spots[rows] ** 2).sum(axis=1)[:, None]
        far += squares[some][None, :]
        return np.maximum(far, 0, out=far)

    place = np.full(len(spots), -1)
    place[d] = np.arange(len(d))
    few = max(1, min(1024, DISTANCES // max(1, len(d))))
    for i in range(0, len(own), few):
        rows = own[i : i + few]
        far = distances(rows, slice(None))
        far[np.arange(len(rows)), place[rows]] = np.inf
        if far.shape[1] > k:
            far.partition(k - 1, axis=1)
            far = far[:, :k].copy()
        found.append((rows, far, np.full(len(rows), len(d) - 1)))
    if len(foreign) and len(d):
        tree = fit_tree(points, max(1, len(d) // TILE))
        member = leaf_of(tree, points)
        tiles = [np.flatnonzero(member == t) for t in range(len(tree) + 1)]
        spread = table.column("spread").to_numpy(zero_copy_only=False)[foreign]
        near = np.full((len(foreign), k), np.inf, np.float32)
        compared, seen = np.zeros(len(foreign), np.int64), np.zeros((len(foreign), len(tiles)), bool)
        for share in (0.5, sure):  # the likelier tiles first: what they hold makes the rest less likely
            for i in range(0, len(foreign), 4096):
                part = slice(i, i + 4096)
                masses = cell_masses(tree, spots[foreign[part]], spread[part], boxes[leaf])
                order = np.argsort(-masses, axis=1, kind="stable")
                before = np.cumsum(np.take_along_axis(masses, order, 1), axis=1) - np.take_along_axis(masses, order, 1)
                wanted = np.zeros_like(seen[part])
                np.put_along_axis(wanted, order, before < share, 1)
                wanted &= ~seen[part]
                seen[part] |= wanted
                for t, rows in enumerate(tiles):
                    asking, few = np.flatnonzero(wanted[:, t]) + i, max(1, DISTANCES // max(1, len(rows)))
                    for x in range(0, len(asking) if len(rows) else 0, few):
                        who = asking[x : x + few]
                        near[who] = smallest(near[who], distances(foreign[who], rows), k)
                        compared[who] += len(rows)
            worst = near.max(axis=1)
            spread = np.where(np.isfinite(worst), np.minimum(spread, np.sqrt(np.maximum(worst, 1.0) / projected)), spread)
        found.append((foreign, near, compared))
    keys = table.column("key").to_pylist()
    rows = np.concatenate([x[0] for x in found]) if found else np.zeros(0, np.int64)
    lists = [sorted(float(v) for v in line if np.isfinite(v)) for x in found for line in x[1]]
    counts = np.concatenate([x[2] for x in found]) if found else np.zeros(0, np.int64)
    out = [pa.array([keys[i] for i in rows], pa.binary()), pa.array(np.full(len(rows), block, np.int32)), pa.array(lists, pa.list_(pa.float32())), pa.array(counts.astype(np.int64))]
    return pa.Table.from_arrays(out, ["key", "block", "near", "compared"])


def nearest_in_block(table: pa.Table, dims: int, projected: int, k: int) -> pa.Table:
    """``(key, other, cosine)``: the k most similar of a block's points in each query's ring of projected distances.

    Rows are the block's points (``data``) and queries from elsewhere; whoever has a ``radius`` asks. All points of the ring
    ``(low, radius]`` are verified with the whole vectors.
    """
    data = table.column("data").to_numpy(zero_copy_only=False).astype(bool)
    keys = np.array(table.column("key").to_pylist(), dtype=object)
    scales, whole = unpack(table.column("packed").combine_chunks(), dims)
    spots = sketch_matrix(table.column("sketch").combine_chunks(), projected)
    low = table.column("low").fill_null(np.inf).to_numpy(zero_copy_only=False)
    radius = table.column("radius").fill_null(-1.0).to_numpy(zero_copy_only=False)
    d, q = np.flatnonzero(data), np.flatnonzero(radius >= 0)
    squares = (spots**2).sum(axis=1)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, len(q), 512):
        rows = q[a : a + 512]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for b in range(0, len(d), 4096):
            other = d[b : b + 4096]
            far = (spots[rows] * -2) @ spots[other].T
            far += squares[rows][:, None]
            far += squares[other][None, :]
            np.maximum(far, 0, out=far)
            hit = (far <= radius[rows][:, None]) & (far > low[rows][:, None]) & (rows[:, None] != other[None, :])
            i, j = np.nonzero(hit)
            if not len(i):
                continue
            if len(i) > DENSE * hit.size:
                s = (floats(scales, whole, rows) @ floats(scales, whole, other).T)[i, j]
            else:
                s = np.concatenate([np.einsum("ij,ij->i", floats(scales, whole, rows[i[x : x + AT_ONCE]]), floats(scales, whole, other[j[x : x + AT_ONCE]])) for x in range(0, len(i), AT_ONCE)])
            order = np.lexsort((-s, i))
            i, j, s = i[order], j[order], s[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            found.append((i[keep], other[j[keep]], s[keep]))
        if found:
            i, j, s = (np.concatenate([x[c] for x in found]) for c in range(3))
            order = np.lexsort((-s, i))
            i, j, s = i[order], j[order], s[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            out.append((rows[i[keep]], j[keep], s[keep]))
    x, y, s = (np.concatenate([part[c] for part in out]) if out else np.zeros(0, np.int64) for c in range(3))
    return pa.table({"key": pa.array(keys[x].tolist(), pa.binary()), "other": pa.array(keys[y].tolist(), pa.binary()), "cosine": pa.array(np.clip(s.astype(np.float64), -1, 1))})


def _chunks(spark: SparkSession, messages: DataFrame, rows: int) -> DataFrame:
    """``(block, chunks)``: into how many tasks a block's queries are split; one row per block that is asked."""
    asked = [(r["block"], math.ceil(r["count"] / rows)) for r in messages.groupBy("block").count().collect()]
    return F.broadcast(spark.createDataFrame(asked, "block int, chunks int"))


def _chunk(key: str, chunks: Column) -> Column:
    return F.pmod(F.xxhash64(key), chunks).cast("int")


def most_similar(vectors: DataFrame, node_col: str, vector_col: str, k: int = 5, dims: int = 384, sure: float = SURE, projected: int = PROJECTED, report: dict[str, int] | None = None) -> DataFrame:
    """``(node, other, cosine, rank)``: up to ``k`` most similar other nodes of every node with a usable vector.

    One row per node is expected. Nodes with equal directions are gathered to one point first (with the k + 1 smallest
    names, all that can matter), so a third of all rows may be copies. Ties are ranked by name. The kd-tree is fitted on
    ``SAMPLE`` points; every point is indexed and searched, and no query's candidates are capped. Null, short, not finite
    and all-zero vectors and null nodes stay out; an empty table gives no rows. ``report`` receives the number of points,
    blocks, sketches sent, sketches compared and whole vectors sent.
    """
    members = packed_vectors(vectors, node_col, vector_col, dims).where("packed is not null")
    return similar_points(cut(members), k, dims, sure, projected, report)


def similar_points(members: DataFrame, k: int, dims: int, sure: float = SURE, projected: int = PROJECTED, report: dict[str, int] | None = None) -> DataFrame:
    """``most_similar`` of ``members(node, key, packed)``."""
    spark = members.sparkSession
    names = Window.partitionBy("key").orderBy("node")
    points = members.withColumn("n", F.row_number().over(names)).where(F.col("n") <= k + 1)
    points = points.groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("nodes"), F.first("packed").alias("packed"))
    points = cut(points)
    count = points.count()
    if count == 0:
        return spark.createDataFrame([], "node string, other string, cosine double, rank int")

    matrix = projection(dims, projected)
    sample = points.orderBy("key").limit(SAMPLE).select("packed").toArrow().column(0).combine_chunks()
    rows = min(BLOCK_MOST, max(BLOCK_LEAST, math.ceil(count / 8)))
    leaves = min(SAMPLE // 8, 2 ** max(0, math.ceil(math.log2(count / rows)))) if count > rows else 1
    tree = fit_tree(sketches(*unpack(sample, dims), matrix).astype(np.float32), leaves)
    boxes = cells(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots = sketches(*unpack(batch.column(2), dims), matrix)
            part = np.array([x[0] * 256 + x[1] for x in batch.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.tobytes() for x in spots], pa.binary()), pa.array(leaf_of(tree, spots.astype(np.float32)).astype(np.int32)), pa.array(part)], ["key", "crowded", "packed", "sketch", "leaf", "part"])

    crowded = F.size("nodes") > k  # these have k copies of themselves and don't ask
    placed = cut(points.select("key", crowded.alias("crowded"), "packed").mapInArrow(place, "key binary, crowded boolean, packed binary, sketch binary, leaf int, part bigint"))
    fill = {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().collect()}  # one row per leaf, SAMPLE / 8 at most
    base, pieces = 0, []
    for leaf in sorted(fill):
        pieces.append((leaf, base, math.ceil(fill[leaf] / (1.5 * rows))))
        base += pieces[-1][2]
    of_leaf = {leaf: list(range(first, first + n)) for leaf, first, n in pieces}
    table = F.broadcast(spark.createDataFrame(pieces, "leaf int, base int, n int"))
    whole = placed.join(table, "leaf").withColumn("block", (F.col("base") + F.pmod("part", "n")).cast("int")).drop("base", "n", "part")
    small = cut(whole.select("key", "crowded", "sketch", "leaf", "block"))
    leaf_of_block = F.broadcast(spark.createDataFrame([(b, leaf) for leaf, blocks in of_leaf.items() for b in blocks], "block int, leaf int"))

    def scan(block: pa.Table) -> pa.Table:
        return projected_in_block(block, projected, k, sure, boxes)

    def route(step: int):  # noqa: ANN202
        """The next ``step`` leaves of each query, by probability, until the unseen ones hold less than ``1 - sure``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                spots = sketch_matrix(batch.column(1), projected)
                near = batch.column(2).to_pylist()
                spread = np.array([math.sqrt(max(x[k - 1], 1.0) / projected) if len(x) >= k else 1e6 for x in near])
                masses = cell_masses(tree, spots, spread)
                visited = np.zeros_like(masses, bool)
                for i, leaf in enumerate(batch.column(3).to_pylist()):
                    visited[i, leaf] = True
                order = np.argsort(np.where(visited, 1.0, -masses), axis=1, kind="stable")[:, :step]
                left = 1 - np.where(visited, masses, 0).sum(axis=1)
                targets = []
                for i in range(len(spots)):
                    some = []
                    for leaf in order[i]:
                        if visited[i, leaf] or left[i] < 1 - sure:
                            break
                        some += of_leaf.get(int(leaf), [])
                        left[i] -= masses[i, leaf]
                    targets.append(some)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spread), pa.array(targets, pa.list_(pa.int32()))], ["key", "sketch", "spread", "targets"])

        return run

    schema = "key binary, block int, near array<float>, compared bigint"
    own = small.select("key", "sketch", "block", "leaf", F.lit(True).alias("data"), (~F.col("crowded")).alias("asks"), F.lit(None).cast("double").alias("spread"))
    # the pieces of an overfull leaf are sent each other's points like those of other leaves
    seen = [cut(own.groupBy("block").applyInArrow(scan, schema))]
    split = {leaf: blocks for leaf, blocks in of_leaf.items() if len(blocks) > 1}
    step, sent = 1, 0
    while split or step < len(of_leaf):  # 1, 2, 4, ... leaves beside the own one: then every leaf has had its turn
        every = seen[0]
        for part in seen[1:]:
            every = every.unionByName(part)
        state = every.groupBy("key").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"), F.collect_set("block").alias("blocks"))
        state = state.join(small.where("not crowded").select("key", "sketch", "leaf", "block"), "key")
        if split and step == 1:
            sides = F.broadcast(spark.createDataFrame([(leaf, blocks) for leaf, blocks in split.items()], "leaf int, targets array<int>"))
            spread = F.when(F.size("near") >= k, F.sqrt(F.greatest(F.element_at("near", -1), F.lit(1.0)) / projected)).otherwise(1e6)
            routed = state.join(sides, "leaf").select("key", "sketch", spread.cast("double").alias("spread"), F.array_remove("targets", F.col("block")).alias("targets"))
            split = {}
        else:
            visited = F.array_distinct(F.transform("blocks", lambda b: F.try_element_at(F.lit([leaf for leaf, blocks in of_leaf.items() for _ in blocks]), b + 1)))
            routed = state.select("key", "sketch", "near", visited.alias("visited")).mapInArrow(route(step), "key binary, sketch binary, spread double, targets array<int>")
            step *= 2
        messages = cut(routed.where(F.size("targets") > 0).select("key", "sketch", "spread", F.explode("targets").alias("block")))
        if messages.isEmpty():
            if step == 1:
                continue
            break
        chunks = _chunks(spark, messages, rows)
        told = small.join(chunks, "block").select("key", "sketch", "block", "leaf", F.lit(True).alias("data"), F.lit(False).alias("asks"), F.lit(None).cast("double").alias("spread"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        asked = messages.join(chunks, "block").join(leaf_of_block, "block").select("key", "sketch", "block", "leaf", F.lit(False).alias("data"), F.lit(True).alias("asks"), "spread", _chunk("key", F.col("chunks")).alias("chunk"))
        seen.append(cut(told.unionByName(asked).groupBy("block", "chunk").applyInArrow(scan, schema)))
        if report is not None:
            sent += messages.count()
    limit = chi_square(projected, sure)
    every = seen[0]
    for part in seen[1:]:
        every = every.unionByName(part)
    near = F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k)
    first = every.groupBy("key").agg(near.alias("near"), F.collect_list(F.struct("block", F.col("near").alias("some"))).alias("tops"))
    radius = F.when(F.size("near") >= k, F.element_at("near", -1) * (SLACK * limit / projected) + projected / 4).otherwise(F.lit(math.inf))
    waiting = cut(first.select("key", "tops", F.lit(-1.0).alias("low"), radius.cast("double").alias("radius")))
    if report is not None:
        report.update(points=count, blocks=base, sketches_sent=sent, sketches_compared=every.agg(F.sum("compared")).first()[0], vectors_sent=0)

    def verify(block: pa.Table) -> pa.Table:
        return nearest_in_block(block, dims, projected, k)

    best = spark.createDataFrame([], "key binary, other binary, cosine double")
    rings = 0
    while True:
        if waiting.isEmpty():
            break
        # blocks with a point in the ring; of those whose k nearest lie below it nothing is known
        reach = F.filter("tops", lambda x: F.exists(x["some"], lambda y: (y > F.col("low")) & (y <= F.col("radius"))) | (F.get(x["some"], F.lit(k - 1)) <= F.col("low")))
        state = cut(waiting.withColumn("reach", F.transform(reach, lambda x: x["block"])).where(F.size("reach") > 0))
        if state.isEmpty():
            break
        asking = placed.join(table, "leaf").withColumn("block", (F.col("base") + F.pmod("part", "n")).cast("int")).select("key", "packed", "sketch", "block")
        joined = asking.join(state.select("key", "low", "radius", "reach"), "key", "left")
        targets = F.array_remove("reach", F.col("block"))
        chunks = _chunks(spark, state.join(small.select("key", F.col("block").alias("home")), "key").select(F.explode(F.when(F.size("reach") > 0, F.array_union("reach", F.array("home"))).otherwise(F.col("reach"))).alias("block")), 2 * rows)
        told = F.struct(F.col("block"), F.lit(True).alias("data"))
        goals = F.concat(F.array(told), F.transform(F.coalesce(targets, F.array().cast("array<int>")), lambda b: F.struct(b.alias("block"), F.lit(False).alias("data"))))
        flat = joined.select("key", "packed", "sketch", "low", "radius", F.explode(goals).alias("goal")).select("key", "packed", "sketch", "low", "radius", "goal.*").join(chunks, "block")
        if report is not None:
            report["vectors_sent"] += flat.count()
            report[f"ring_{rings}"] = state.count()
        mine = _chunk("key", F.col("chunks"))
        # a point stands in every chunk of its block and asks in one of them
        flat = flat.withColumn("chunk", F.explode(F.when(F.col("data"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(mine))))
        asks = F.when(mine == F.col("chunk"), F.col("radius"))
        found = flat.select("key", "packed", "sketch", "block", "data", "low", asks.alias("radius"), "chunk").groupBy("block", "chunk").applyInArrow(verify, "key binary, other binary, cosine double")
        order = Window.partitionBy("key").orderBy(F.desc("cosine"), "other")
        ring = found.unionByName(best.join(waiting.select("key"), "key", "left_semi")) if rings else found
        top = cut(ring.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n"))
        best = cut(best.join(waiting.select("key"), "key", "left_anti").unionByName(top)) if rings else top
        rings += 1
        reached = top.groupBy("key").agg(F.count(F.lit(1)).alias("n"), (2 - 2 * F.min("cosine")).alias("distance"))
        # the chi-square test: a closer point would have been projected into the radius with probability ``sure``
        needed = F.when(F.col("n") >= k, F.greatest("distance", F.lit(1e-9)) * (STEPS**2 * limit) + projected / 4).otherwise(F.lit(math.inf))
        after = waiting.join(reached, "key", "left").withColumn("needed", needed).where(F.col("needed") > F.col("radius"))
        waiting = cut(after.select("key", "tops", F.col("radius").alias("low"), (F.col("needed") * 1.0001).alias("radius")))

    # from points back to nodes: own copies first, then those of the verified points
    own = points.select("key", F.explode("nodes").alias("other"), F.lit(1.0).alias("cosine"))
    others = points.select(F.col("key").alias("other"), "nodes")
    reach = best.join(others, "other").select("key", F.explode("nodes").alias("other"), "cosine")
    order = Window.partitionBy("key").orderBy(F.desc("cosine"), "other")
    lists = own.unionByName(reach).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    lists = lists.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", "other", "cosine"))).alias("list"))
    # a node is among its own group's first k + 1 or not at all; either way k others remain
    rows_ = members.select("node", "key").join(lists, "key")
    kept = F.slice(F.filter("list", lambda x: x["other"] != F.col("node")), 1, k)
    return rows_.select("node", F.posexplode(kept)).select("node", F.col("col.other").alias("other"), F.col("col.cosine").alias("cosine"), (F.col("pos") + 1).alias("rank"))


def latest_vectors(indices: DataFrame, dims: int = 384) -> DataFrame:
    """``(node, key, packed)`` of each node's row with the latest ``cached_at``, unless its vector can't be used.

    Of rows of the same time the last to arrive counts, then the larger key. Vectors are packed before they are shuffled.
    """
    rows = packed_vectors(indices, "node_id", "embedding", dims, ["cached_at", "ingested_at"])
    newest = F.max_by(F.struct("key", "packed"), F.struct("cached_at", "ingested_at", "key"))
    return rows.groupBy("node").agg(newest.alias("v")).select("node", "v.key", "v.packed").where("packed is not null")


def similar_pairs(indices: DataFrame, k: int = 5, dims: int = 384, report: dict[str, int] | None = None) -> DataFrame:
    """``(node_a, node_b)``, smaller string first: pairs of which at least one is among the other's ``k`` most similar."""
    found = similar_points(cut(latest_vectors(indices, dims)), k, dims, report=report)
    return found.select(F.least("node", "other").alias("node_a"), F.greatest("node", "other").alias("node_b")).distinct()
