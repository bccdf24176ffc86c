"""Near copies by the Jaccard similarity of word shingles, checked exactly.

Texts with equal sets of shingles are one node. Pigeonring chains over the SimHash fingerprints of the
sets (``simhash.links``) say which nodes may be similar. Most pairs at the least similarity differ in
more bits than the chains allow, so nodes that share a band of their MinHash signatures are candidates,
too. Candidates are joined to clusters, and the nodes of a cluster are compared by
their whole sets. A large cluster is cut into blocks, and pairs of blocks are compared in tasks of
their own; a task gives a spanning forest of its links, not all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from servelens.llm import simhash
from servelens.llm.common import map_rows
from servelens.llm.components import connected_components
from servelens.operators.skew import salted_join
from servelens.session import stage

SEED, SHINGLE = 42, 5
#: Least similarity of near copies, as a fraction.
SHARED, OF = 4, 5
#: A pair of similarity s shares a band with a chance of 1 - (1 - s^ROWS)^BANDS: 0.999992 at 0.8.
BANDS, ROWS = 64, 8
#: Shingles whose hashes are taken at a time.
COUNTED = 1 << 15
#: Most rows of wanted places (some 50 bytes each) that are broadcast.
BROADCAST_ROWS = 250_000
#: Nodes, and shingles, of a block of a large cluster.
BLOCK, BLOCK_MARKS = 512, 1 << 21

_draw = np.random.default_rng(SEED)
SALTS = _draw.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)
FACTORS = _draw.integers(0, 1 << 31, (BANDS * ROWS, 1), np.uint32) * np.uint32(2) + np.uint32(1)


def shingles(text: bytes) -> np.ndarray:
    """Sorted hashes of the different shingles of an ASCII-lower-cased text; of all its words if
    they are fewer."""
    words = text.lower().split()
    size = min(SHINGLE, len(words))
    if not size:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1]
    ends = ends[size - 1 :]
    hashes = []
    for at in range(0, len(starts), COUNTED):
        spans = zip(starts[at : at + COUNTED].tolist(), ends[at : at + COUNTED].tolist())
        hashes.append(np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in spans]), np.uint64))
    return np.unique(np.concatenate(hashes))


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def band_keys(marks: np.ndarray) -> list[int]:
    """A key for each band of the MinHash signature of a set of hashes; none for the empty set."""
    if not len(marks):
        return []
    short = (marks ^ marks >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 256):
        np.minimum(least, ((short[at : at + 256] ^ SALTS) * FACTORS).min(axis=1), out=least)
    rows = least.reshape(BANDS, ROWS)
    return [signed(xxhash.xxh64_intdigest(row.tobytes(), band)) for band, row in enumerate(rows)]


def fingerprint(marks: np.ndarray) -> int:
    """SimHash of a set of hashes: a bit is 1 if it is set in over half of them."""
    ones = np.zeros(simhash.BITS, np.int64)
    for at in range(0, len(marks), COUNTED):
        part = marks[at : at + COUNTED].view(np.uint8)
        ones += np.unpackbits(part).reshape(-1, simhash.BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(marks)).tobytes(), "big")


def node_of(marks: np.ndarray) -> int:
    return signed(xxhash.xxh64_intdigest(marks.tobytes(), SEED))


def forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges (places in ``sets``) of a spanning forest of the links between nonempty sets."""
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    inside, unseen, edges = np.zeros(len(values), bool), np.ones(len(sets), bool), []
    for root in range(len(sets)):
        if not unseen[root]:
            continue
        unseen[root], front = False, [root]
        while front and unseen.any():
            at = front.pop()
            own = flat[starts[at] : starts[at] + sizes[at]]
            inside[own] = True
            shared = np.add.reduceat(inside[flat], starts, dtype=np.int64)
            inside[own] = False
            new = np.flatnonzero(unseen & (OF * shared >= SHARED * (sizes + sizes[at] - shared)))
            unseen[new] = False
            front += new.tolist()
            edges += [(at, k) for k in new.tolist()]
    return edges


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from rows (cluster, p, q, node, marks) sorted by the first three; holds one open group."""
    group, nodes, sets = None, [], []

    def linked() -> pa.RecordBatch:
        found = forest(sets) if len(sets) > 1 else []
        ends = [pa.array([nodes[e[k]] for e in found], pa.int64()) for k in (0, 1)]
        return pa.RecordBatch.from_arrays(ends, names=["u", "v"])

    for batch in batches:
        for *key, node, marks in zip(*(c.to_pylist() for c in batch.columns)):
            if key != group:
                yield linked()
                group, nodes, sets = key, [], []
            nodes.append(node)
            sets.append(np.frombuffer(marks, np.uint64))
    yield linked()


def candidates(nodes: DataFrame) -> DataFrame:
    """Edges (u, v) that connect the nodes of ``nodes(node, n, fp, keys)`` that may be similar: those with
    fingerprints within ``simhash.RADIUS`` bits, by pigeonring, and those that share a band."""
    filled = nodes.where("n > 0")
    prints = stage(filled.groupBy("fp").agg(F.min("node").alias("node")), "copies-prints")
    ends = [prints.select(F.col("fp").alias(e), F.col("node").alias(f"{e}_node")) for e in ("u", "v")]
    near = simhash.links(prints).join(ends[0], "u").join(ends[1], "v")
    # Equal fingerprints are one more key. One shuffle of (node, key); the rows are two numbers, and a
    # window spills.
    listed = filled.select("node", F.explode(F.array_append("keys", F.col("fp"))).alias("key"))
    met = listed.select(F.col("node").alias("u"), F.min("node").over(Window.partitionBy("key")).alias("v"))
    return met.unionByName(near.select(F.col("u_node").alias("u"), F.col("v_node").alias("v")))


def clusters(nodes: DataFrame) -> DataFrame:
    """(node, cluster) of the nodes of ``nodes(node, n, fp, keys)`` that are candidates with another one."""
    roots = connected_components(candidates(nodes), "copies-clusters")
    return roots.select("node", F.col("root").alias("cluster")).union(
        roots.select("root", "root").distinct()
    )


def wanted_texts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(member, text) of ``texts(place, text)`` for ``wanted(place, member)``, one for each place.

    Equal rows have equal places. Places that several rows have are told from the narrow columns;
    their rows are spread over salts, and each task keeps one of a place before the shuffle.
    """
    wanted = stage(wanted, "copies-wanted")
    if wanted.count() <= BROADCAST_ROWS:
        # Then no text is shuffled to be read; beyond that size texts and places meet by a shuffle.
        wanted = F.broadcast(wanted)
    counted = texts.select("place").join(wanted.select("place"), "place").groupBy("place").count()
    repeated = stage(counted.where("count > 1").select("place"), "copies-repeats")
    if repeated.isEmpty():
        return texts.join(wanted, "place").select("member", "text")
    once = texts.join(wanted.join(repeated, "place", "left_anti"), "place").select("member", "text")
    several = wanted.join(repeated, "place", "left_semi")
    met = salted_join(texts.withColumn("_read", F.monotonically_increasing_id()), several, ["place"], ["_read"])
    again = met.where("member is not null").select("place", "member", "text").dropDuplicates(["place"])
    return once.unionByName(again.select("member", "text"))


def links(nodes: DataFrame, texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) that connect all near copies of ``nodes(node, place, n, fp, keys)``; ``texts`` has
    the text of each place."""
    found = stage(clusters(nodes), "copies-members")
    members = found.join(nodes.select("node", "place", "n"), "node")
    sizes = members.groupBy("cluster").agg(
        F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / BLOCK_MARKS)).cast("int").alias("blocks")
    )
    wanted = members.join(sizes, "cluster").select(
        "place", F.struct("node", "cluster", "blocks").alias("member")
    )

    def make():
        return lambda texts: {"marks": [shingles(t).tobytes() for t in texts]}

    sets = stage(
        map_rows(
            wanted_texts(texts, wanted),
            make,
            "marks binary",
            keep="member struct<node: bigint, cluster: bigint, blocks: int>",
        ),
        "copies-sets",
    )
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return (
        sets.select("member.*", "marks")
        .select("cluster", "node", "marks", mine.alias("b"), other.alias("o"))
        .select("cluster", F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"), "node", "marks")
        .repartition("cluster", "p", "q")
        .sortWithinPartitions("cluster", "p", "q")
        .mapInArrow(_meet, "u bigint, v bigint")
        .distinct()
    )


def keep_one(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row of ``df`` per group of near copies, all columns as they are: the smallest
    (doc_id, hash of the row), null ids last, and of equal rows one.

    Texts link when their sets of five-word shingles have a Jaccard similarity of 0.8 or more, and
    groups are what links reach. Texts without a word are one group.
    """
    here = df.columns
    names = [f"_{i}" for i in range(len(here))]
    bare = df.toDF(*names)
    doc_id, text = (bare[f"_{here.index(n)}"] for n in ("doc_id", "text"))
    mark = F.xxhash64(*[F.col(n) for n in names])
    place = F.struct(doc_id.isNull().alias("none"), doc_id.alias("id"), mark.alias("mark"))

    def make():
        def run(texts: list[bytes]) -> dict[str, list]:
            sets = [shingles(t) for t in texts]
            return {
                "node": [node_of(s) for s in sets],
                "n": [len(s) for s in sets],
                "fp": [signed(fingerprint(s)) for s in sets],
                "keys": [band_keys(s) for s in sets],
            }

        return run

    shape = "place struct<none: boolean, id: bigint, mark: bigint>"
    placed = bare.select(place.alias("place"), text.alias("text"))
    rows = map_rows(placed, make, "node bigint, n bigint, fp bigint, keys array<bigint>", keep=shape)
    nodes = stage(
        rows.groupBy("node").agg(
            F.min("place").alias("place"), *[F.first(c).alias(c) for c in ("n", "fp", "keys")]
        ),
        "copies-nodes",
    )
    roots = connected_components(links(nodes, placed, block), "copies-links")
    group = F.coalesce("root", nodes["node"])
    chosen = (
        nodes.join(roots, nodes["node"] == roots["node"], "left")
        .groupBy(group.alias("root"))
        .agg(F.min("place").alias("_place"))
        .select("_place")
    )
    return (
        bare.withColumn("_place", place)
        .dropDuplicates(["_place"])
        .join(chosen, "_place", "left_semi")
        .select(*names)
        .toDF(*here)
    )
