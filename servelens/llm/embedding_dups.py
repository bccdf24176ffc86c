"""Near-duplicate embeddings by counting collisions of sorted one-dimensional projections.

Unit vectors are projected on many random directions. For a pair at the cosine threshold the
difference in one projection is close to normal with a known spread, so the share of projections in
which one falls into a window around the other is known, too; a pair is verified in double precision
if its count of collisions reaches the largest number that a pair at the threshold misses with
probability ``MISS`` only.

To meet, a pair must share a cell: the signs of several projections, in one of a number of tables.
Both numbers follow from the number of vectors and the recall wanted, so that a cell holds about as
many unrelated vectors at any size. A pair is handled in the first table whose cell it shares, so
links are counted once. Cells with many vectors are cut into blocks and pairs of blocks are compared
in tasks of their own; such a task gives each vector's number of links and a spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from servelens.llm.common import pick
from servelens.llm.components import connected_components
from servelens.session import stage

COSINE = 0.98
#: Chance that a pair at the threshold shares no cell, and that it fails the collision count.
UNSHARED, MISS = 0.002, 0.001
PROJECTIONS = 48
#: Half-width of a window in standard deviations of a threshold pair's difference.
WINDOW = 1.5
#: Unrelated vectors that a cell should hold, and vectors of a block.
CELL, BLOCK = 64, 1024
SEED = 11


def directions(dims: int, count: int, seed: int) -> np.ndarray:
    """``count`` random unit directions, orthogonal in groups of ``dims``."""
    rng = np.random.default_rng(seed)
    parts = [
        np.linalg.qr(rng.normal(size=(dims, dims)))[0] for _ in range(-(-count // max(1, dims)))
    ]
    return np.concatenate(parts, axis=1)[:, :count]


def plan(vectors: int, cosine: float = COSINE) -> tuple[int, int]:
    """(signs per cell, tables) for a number of vectors."""
    signs = min(24, max(2, math.ceil(math.log2(max(vectors, 1) / CELL + 1))))
    same = (1 - math.acos(cosine) / math.pi) ** signs
    return signs, max(1, math.ceil(math.log(UNSHARED) / math.log1p(-same)))


def least_collisions(projections: int = PROJECTIONS) -> int:
    """The largest count that a threshold pair reaches but for a chance of MISS."""
    p = math.erf(WINDOW / math.sqrt(2))
    below = 0.0
    for k in range(projections + 1):
        below += math.comb(projections, k) * p**k * (1 - p) ** (projections - k)
        if below > MISS:
            return k
    return projections


def half_width(dims: int, cosine: float = COSINE) -> float:
    """Window half-width: the difference of a threshold pair has length sqrt(2 - 2 cosine)."""
    return WINDOW * math.sqrt((2 - 2 * cosine) / dims)


def collisions(a: np.ndarray, b: np.ndarray, width: float) -> np.ndarray:
    """For rows of projections ``a`` and ``b``: in how many columns b falls in a's window.

    Each column of ``b`` is sorted once; a query's window is a run of the sorted order, marked by
    its two ends and summed up.
    """
    counts = np.zeros((len(a), len(b)), np.int16)
    for j in range(a.shape[1]):
        order = np.argsort(b[:, j], kind="stable")
        sorted_ = b[order, j]
        low = np.searchsorted(sorted_, a[:, j] - width, "left")
        high = np.searchsorted(sorted_, a[:, j] + width, "right")
        marks = np.zeros((len(a), len(b) + 1), np.int16)
        at = np.arange(len(a))
        marks[at, low] += 1
        marks[at, high] -= 1
        counts[:, order] += np.cumsum(marks[:, :-1], axis=1, dtype=np.int16)
    return counts


def normalised(embeddings: DataFrame) -> DataFrame:
    """(id, label, v, copies): equal usable vectors of a label once, by their smallest vec_id."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    usable = (
        F.col("label").isNotNull()
        & F.col("embedding").isNotNull()
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists(v, lambda x: x != 0)
    )
    return (
        embeddings.where(F.coalesce(usable, F.lit(False)))
        .select("vec_id", "label", F.transform(v, lambda x: x + F.lit(0.0)).alias("v"))
        .groupBy("label", "v")
        .agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    )


def near_embeddings(df: DataFrame, cosine: float = COSINE, seed: int = SEED) -> DataFrame:
    """One row per row of ``df(vec_id, embedding, label)``: n_links (other vectors of the label at
    ``cosine`` or more), component_id (smallest vec_id that links reach) and kept (its own).

    Vectors that are null, zero, or hold null or non-finite components, and vectors without a label,
    link with nothing. Equal vectors link with each other. A null vec_id takes part, a component
    of null ids alone has a null component_id; such a row is not kept. Vectors of different lengths
    do not link.
    """
    rows = pick(df, "vec_id", "embedding", "label")
    spark = df.sparkSession
    classes = stage(
        normalised(rows).withColumn("node", F.monotonically_increasing_id()), "embeddings"
    )
    total, dims = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    if not total:
        links = spark.createDataFrame([], "u long, v long, part int, links long")
    else:
        links = stage(_links(classes, total, dims, cosine, seed), "embedding-links")
    counts = links.where("v is null").groupBy("u").agg(F.sum("links").alias("links"))
    roots = connected_components(links.where("v is not null"), "embedding-components")
    named = (
        classes.join(counts, classes["node"] == counts["u"], "left")
        .join(roots, classes["node"] == roots["node"], "left")
        .select(
            "label",
            F.col("v").alias("_v"),
            "id",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("root", classes["node"]).alias("root"),
        )
    )
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    named = named.join(least, "root").select(
        F.col("label").alias("_label"), "_v", "n_links", "component_id"
    )
    v = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))
    out = rows.withColumn("v", v).join(
        named, (F.col("label") == F.col("_label")) & (F.col("v") == F.col("_v")), "left"
    )
    usable = F.col("_label").isNotNull()
    component = F.when(usable, F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def _links(classes: DataFrame, total: int, dims: int, cosine: float, seed: int) -> DataFrame:
    """Rows (u, null, links) that count a node's links with other nodes' copies, and rows (u, v)
    that connect what is linked."""
    signs, tables = plan(total, cosine)
    width, least = half_width(dims, cosine), least_collisions()

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.diff(batch.column("v").offsets.to_numpy())
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                x = unit(np.array(part.column("v").to_pylist(), float))
                bits = x @ directions(int(size), signs * tables, seed) > 0
                weights = 1 << np.arange(signs)
                keys = (bits.reshape(len(x), tables, signs) * weights).sum(axis=2)
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("node"),
                            part.column("label"),
                            pa.array(np.full(len(x), size), pa.int32()),
                            pa.array(np.full(len(x), t), pa.int32()),
                            pa.array(keys[:, t], pa.int64()),
                        ],
                        names=["node", "label", "size", "part", "cell"],
                    )

    shape = f"node long, label {classes.schema['label'].dataType.simpleString()}, size int, part int, cell long"
    listed = classes.select("node", "label", "v").mapInArrow(cells, shape)
    key = ["label", "size", "part", "cell"]
    full = listed.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = (
        listed.join(full.select(*key, blocks.alias("blocks")), key)
        .withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("o", other)
        .select(
            *key, "b", F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"), "node"
        )
        .join(classes.select("node", "v", "copies"), "node")
    )

    group = ["label", "size", "part", "cell", "p", "q"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            marks = _runs(held, group)
            if len(marks) > 1:
                yield from _compared(held.slice(0, marks[-1]), marks[:-1])
                held = held.slice(marks[-1]).combine_chunks()
        if held is not None:
            yield from _compared(held, _runs(held, group))

    def _compared(rows: pa.Table, starts: list[int]) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        for start, stop in zip(starts, [*starts[1:], rows.num_rows]):
            if stop - start > 1:
                yield linked(rows.slice(start, stop - start))

    def linked(rows: pa.Table) -> pa.RecordBatch:
        node, copies = rows["node"].to_numpy(), rows["copies"].to_numpy()
        block, part = rows["b"].to_numpy(), rows["part"][0].as_py()
        size = rows["size"][0].as_py()
        x = unit(np.array(rows["v"].to_pylist(), float))
        axes = directions(size, signs * tables, seed)
        bits = x @ axes > 0
        earlier = (bits.reshape(len(x), tables, signs) * (1 << np.arange(signs))).sum(axis=2)[:, :part]
        projected = x @ directions(size, PROJECTIONS, seed + 1)
        if rows["p"][0].as_py() == rows["q"][0].as_py():
            one = two = np.arange(len(x))
        else:
            one, two = (np.flatnonzero(block == rows[k][0].as_py()) for k in ("p", "q"))
        a, b = np.nonzero(collisions(projected[one], projected[two], width) >= least)
        a, b = one[a], two[b]
        once = a < b if one is two else np.ones(len(a), bool)
        a, b = a[once], b[once]
        for j in range(part):
            new = earlier[a, j] != earlier[b, j]
            a, b = a[new], b[new]
        good = np.concatenate(
            [np.einsum("ij,ij->i", x[a[i : i + 65536]], x[b[i : i + 65536]]) >= cosine for i in range(0, len(a), 65536)]
            or [np.zeros(0, bool)]
        )
        a, b = a[good], b[good]
        links = np.bincount(a, copies[b], len(x)) + np.bincount(b, copies[a], len(x))
        at = np.flatnonzero(links)
        u, v = spanning(a, b, len(x))
        none = pa.nulls(len(at), pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([node[at], node[u]])),
                pa.concat_arrays([none, pa.array(node[v])]),
                pa.array(np.concatenate([links[at], np.zeros(len(u))]).astype(np.int64)),
            ],
            names=["u", "v", "links"],
        )

    return (
        paired.repartition(*group)
        .sortWithinPartitions(*group)
        .select("node", "v", "copies", "b", *group)
        .mapInArrow(compare, "u long, v long, links long")
    )


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1, without overflow for large or loss for small components."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _runs(rows: pa.Table, group: list[str]) -> list[int]:
    """First rows of the runs of equal ``group``."""
    change = np.zeros(rows.num_rows, bool)
    change[0] = True
    for name in group:
        values = rows[name].combine_chunks().dictionary_encode()
        codes = values.indices.to_numpy() if isinstance(values, pa.DictionaryArray) else values.chunk(0).indices.to_numpy()
        change[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(change).tolist()


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of edges (a, b) over n nodes, by repeated hooking to the least label."""
    label = np.arange(n)
    kept_a, kept_b = [], []
    while True:
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            break
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        high, low = np.maximum(la, lb), np.minimum(la, lb)
        # For each tree that has a lower neighbour, one edge to its least one.
        order = np.lexsort((low, high))
        first = order[np.concatenate([[True], high[order][1:] != high[order][:-1]])]
        kept_a.append(a[first])
        kept_b.append(b[first])
        parent = np.arange(n)
        parent[high[first]] = low[first]
        while (up := parent[parent]).tolist() != parent.tolist():
            parent = up
        label = parent[label]
    if not kept_a:
        return a[:0], b[:0]
    return np.concatenate(kept_a), np.concatenate(kept_b)
