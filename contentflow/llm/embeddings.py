"""Near-duplicate embeddings by PCA-ordered tiled comparison."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from contentflow.llm.components import components
from contentflow.llm.folders import stored, unused

COSINE = 0.93
#: Vectors per tile, in expectation; two tiles are what a task holds at once.
TILE = 2048
#: Bands of the leading coordinate, inside which tiles are formed.
BANDS = 16
#: A pair's product is bounded after so many leading dimensions, twice as many, and so on.
LEADING = 8
#: Pairs of one tile pair that are worked on at once.
CHUNK = 50_000
#: What rounding may take from a bound; every link is then confirmed on the vectors themselves.
SLACK = 1e-9


def _usable(vector: Column) -> Column:
    """Not null, without null, NaN or infinite components, and not all zero."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(good, F.lit(False)) & F.exists(vector, lambda x: x != 0.0)


def _unit(raw: np.ndarray) -> np.ndarray:
    scaled = raw / np.abs(raw).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), size)


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Per vector length the axes of largest spread first, from the second moments of all unit vectors.

    Tasks send sums of products, whose number is the square of the length, whatever the number of vectors.
    """

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            lengths = batch.column(1).to_numpy()
            for size in np.unique(lengths):
                unit = _unit(_matrix(batch.column(0).filter(pa.array(lengths == size)), size))
                sums[size] = sums.get(size, 0) + unit.T @ unit
        for size, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(s.size, size), pa.int32()), pa.array(np.arange(s.size)), pa.array(s.ravel())], names=["size", "cell", "v"])

    got = vectors.select("v", "size").mapInArrow(run, "size int, cell long, v double").groupBy("size", "cell").agg(F.sum("v").alias("v")).toPandas()
    axes = {}
    for size, part in got.groupby("size"):
        moments = np.zeros(size * size)
        moments[part["cell"].to_numpy()] = part["v"].to_numpy()
        moments = moments.reshape(size, size)
        axes[int(size)] = np.linalg.eigh((moments + moments.T) / 2)[1][:, ::-1].copy()
    return axes


def similar_pairs(left: np.ndarray, right: np.ndarray, axes: np.ndarray, least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs with a cosine of at least `least`; of one tile with itself, each pair once.

    Products are summed over the leading axes first. What the others can add is at most the product of the two
    rest norms; pairs that cannot reach the threshold are dropped before the next axes.
    """
    a, b = _unit(left) @ axes, _unit(right) @ axes
    size = a.shape[1]
    stops = [s for s in (LEADING << k for k in range(20)) if s < size] + [size]
    rest_a, rest_b = ([np.sqrt(np.maximum(1.0 - (x[:, :s] ** 2).sum(axis=1), 0.0)) for s in stops] for x in (a, b))
    norm_a, norm_b = (x / np.abs(x).max(axis=1, keepdims=True) for x in (left, right))
    len_a, len_b = np.sqrt((norm_a**2).sum(axis=1)), np.sqrt((norm_b**2).sum(axis=1))
    found_i, found_j = [], []
    for top in range(0, len(a), 256):
        rows = slice(top, top + 256)
        product = a[rows, : stops[0]] @ b[:, : stops[0]].T
        i, j = np.nonzero(product + rest_a[0][rows, None] * rest_b[0] >= least - SLACK)
        sums, i = product[i, j], i + top
        if same:
            sums, i, j = sums[j > i], i[j > i], j[j > i]
        for first in range(0, len(i), CHUNK):
            s, p, q = (x[first : first + CHUNK] for x in (sums, i, j))
            for k in range(1, len(stops)):
                s = s + np.einsum("ij,ij->i", a[p, stops[k - 1] : stops[k]], b[q, stops[k - 1] : stops[k]])
                stay = s + rest_a[k][p] * rest_b[k][q] >= least - SLACK
                s, p, q = s[stay], p[stay], q[stay]
            exact = np.einsum("ij,ij->i", norm_a[p], norm_b[q]) / (len_a[p] * len_b[q]) >= least
            found_i.append(p[exact])
            found_j.append(q[exact])
    return (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_i, found_j))


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest number in the component of each of n points."""
    root = np.arange(n)
    while True:
        before = root.copy()
        least = np.minimum(root[i], root[j])
        np.minimum.at(root, i, least)
        np.minimum.at(root, j, least)
        root = root[root]
        if (root == before).all():
            return root


def embedding_links(frame: DataFrame, vector: str = "embedding", label: str = "label", key: str = "vec_id", least: float = COSINE) -> DataFrame:
    """Adds n_links (other rows linked directly), component_id (smallest key reachable, its own included) and kept.

    Rows with the same label and vector length are linked from a cosine of `least` on, in double precision. Equal vectors
    are one node with a multiplicity. Nodes lie in tiles; two tiles meet unless their ranges of the leading coordinate
    are too far apart for any link. A tile pair sends link sums per node and one edge per node to its component within the
    pair, never the pairs themselves.

    A null label, a null or zero vector and one with null, NaN or infinite components links with nothing. Null keys are
    never smallest unless all are. Repeated keys are rows of their own. Added columns are replaced, others stay.
    """
    frame = frame.drop("n_links", "component_id", "kept")
    columns = frame.columns
    v, usable = unused(frame, "v"), unused(frame, "usable")
    frame = frame.withColumn(v, F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0)))
    frame = frame.withColumn(usable, _usable(F.col(v)) & F.col(label).isNotNull())
    nodes = frame.filter(usable).groupBy(F.col(label).alias("label"), F.col(v).alias("v")).agg(F.min(key).alias("key"), F.count("*").alias("times"))
    nodes = stored(nodes.select(F.monotonically_increasing_id().alias("node"), "label", "v", "key", "times", F.size("v").alias("size")), "embedding-nodes")
    axes = principal_axes(nodes)
    shared = frame.sparkSession.sparkContext.broadcast(axes)  # the square of the vector length

    def lead(batches):
        for batch in batches:
            lengths, out = batch.column(3).to_numpy(), np.zeros(batch.num_rows)
            for size in np.unique(lengths):
                own = lengths == size
                out[own] = _unit(_matrix(batch.column(2).filter(pa.array(own)), size)) @ shared.value[int(size)][:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "lead"])

    label_type = dict(nodes.dtypes)["label"]
    led = nodes.select("node", "label", "v", "size", "times").mapInArrow(lead, f"node long, label {label_type}, v array<double>, size int, times long, lead double")
    # Band edges and numbers of tiles: one row per label and length.
    cuts = [i / BANDS for i in range(1, BANDS)]
    bands = led.groupBy("label", "size").agg(F.percentile_approx("lead", cuts, 1000).alias("edges"), F.count("*").alias("n"))
    ways = F.ceil(F.col("n") / F.lit(float(TILE))).cast("int")
    banded = led.join(bands, ["label", "size"]).withColumn("band", F.size(F.filter("edges", lambda e: e < F.col("lead"))))
    # Few tiles: several bands share one. Many: a band has several, dealt by a hash.
    tile = F.when(ways <= BANDS, F.floor(F.col("band") * ways / F.lit(BANDS)) * 1000003).otherwise(
        F.col("band") * 1000003 + F.pmod(F.xxhash64("node"), F.ceil(ways / F.lit(float(BANDS))).cast("long"))
    )

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("node").combine_chunks()
        leads = rows["lead"].to_numpy()
        values = rows["v"].combine_chunks().flatten().to_numpy()
        return pa.table({
            "label": rows["label"].slice(0, 1), "size": rows["size"].slice(0, 1), "tile": rows["tile"].slice(0, 1),
            "low": [leads.min()], "high": [leads.max()], "nodes": pa.array([rows["node"].to_numpy().tobytes()], pa.binary()),
            "times": pa.array([rows["times"].to_numpy().tobytes()], pa.binary()), "values": pa.array([values.tobytes()], pa.binary()),
        })

    tiles = banded.withColumn("tile", tile.cast("long")).select("label", "size", "tile", "lead", "node", "times", "v")
    tiles = tiles.groupBy("label", "size", "tile").applyInArrow(
        pack, f"label {label_type}, size int, tile long, low double, high double, nodes binary, times binary, values binary"
    )
    tiles = stored(tiles, "embedding-tiles")
    spans = tiles.select("label", "size", "tile", "low", "high")
    gap = float(np.sqrt(2.0 - 2.0 * least)) + 1e-9  # unit vectors of a link differ by this at most in any coordinate
    pairs = spans.join(spans.withColumnsRenamed({"tile": "other", "low": "low2", "high": "high2"}), ["label", "size"]).filter(
        f"tile <= other and low2 - high <= {gap} and low - high2 <= {gap}"
    ).select("label", "size", "tile", "other")
    body = ["nodes", "times", "values"]
    met = pairs.join(tiles.select("label", "size", "tile", *body), ["label", "size", "tile"])
    met = met.join(tiles.select("label", "size", F.col("tile").alias("other"), *(F.col(c).alias(f"{c}2") for c in body)), ["label", "size", "other"])

    def compare(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda name, kind: np.frombuffer(batch.column(name)[r].as_buffer(), kind)  # noqa: E731, B023
                size, same = batch.column("size")[r].as_py(), batch.column("same")[r].as_py()
                left, right = get("values", float).reshape(-1, size), get("values2", float).reshape(-1, size)
                i, j = similar_pairs(left, right, shared.value[size], least, same)
                # Points of both tiles in one numbering; a tile with itself is the same points.
                ids, times = get("nodes", np.int64), get("times", np.int64)
                if not same:
                    j = j + len(ids)
                    ids, times = np.concatenate([ids, get("nodes2", np.int64)]), np.concatenate([times, get("times2", np.int64)])
                links = np.bincount(i, times[j], len(ids)) + np.bincount(j, times[i], len(ids))
                used = np.flatnonzero(links)
                root = ids[_roots(len(ids), i, j)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[used]), pa.array(root[used]), pa.array(links[used].astype(np.int64))], names=["node", "root", "links"])

    met = met.withColumn("same", F.col("tile") == F.col("other")).select("size", "same", *body, *(f"{c}2" for c in body))
    found = stored(met.mapInArrow(compare, "node long, root long, links long"), "embedding-links")
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    component = components(found.filter("node <> root"), "node", "root")

    placed = nodes.select("node", "label", "v", "key", "times").join(component, "node", "left").join(linked, "node", "left")
    smallest = placed.filter("component is not null").groupBy("component").agg(F.min("key").alias("smallest"))
    placed = placed.join(smallest, "component", "left").select(
        F.col("label").alias("its_label"), F.col("v").alias("its_v"), (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.when(F.col("component").isNull(), F.col("key")).otherwise(F.col("smallest")).alias("component_id"),
    )
    clash = {c: unused(frame, c) for c in ("its_label", "its_v")}
    placed = placed.withColumnsRenamed(clash)
    match = F.col(usable) & (F.col(label) == F.col(clash["its_label"])) & (F.col(v) == F.col(clash["its_v"]))
    done = frame.join(placed, match, "left")
    done = done.withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))
    done = done.withColumn("component_id", F.when(F.col(usable), F.col("component_id")).otherwise(F.col(key)))
    return done.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id"))).select(*columns, "n_links", "component_id", "kept")
