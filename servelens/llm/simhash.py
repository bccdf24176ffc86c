"""Near-duplicates by 64-bit SimHash, with pigeonring filtering of candidates.

A fingerprint is a ring of four 16-bit segments. If two fingerprints differ in at most three bits,
then some segment starts a chain whose running number of differences stays within its share of the
budget: none in the first segment, at most one in the first two, at most two in the first three.
Candidates are therefore pairs that share a segment and come within one bit in the next: one side
is listed under its own two segments, the other also under the sixteen one-bit changes of the
second. The rest of the chain and the full Hamming distance are checked on what meets.

Equal fingerprints are one node. A key with many fingerprints is cut into blocks, and pairs of
blocks are compared in tasks of their own; a task gives a spanning forest of its links, not all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from servelens.llm.common import map_rows, pick
from servelens.llm.components import connected_components
from servelens.session import stage

SEED, SHINGLE, BITS, SEGMENTS, RADIUS = 42, 3, 64, 4, 3
#: Shingles whose bits are counted at a time.
COUNTED = 1 << 15
#: Fingerprints of a block of a large key.
BLOCK = 1024
#: Larger groups than this are searched for a forest, smaller ones pair by pair.
SMALL = 8


def fingerprint(text: bytes) -> int:
    """SimHash of the shingles of an ASCII-lower-cased text; 0 without a word."""
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if len(words) < SHINGLE:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        spans = zip(starts[: len(words) - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist())
        hashes = [digest(joined[a:b], SEED) for a, b in spans]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), COUNTED):
        part = np.frombuffer(b"".join(hashes[at : at + COUNTED]), np.uint8)
        ones += np.unpackbits(part).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def fingerprints(df: DataFrame) -> DataFrame:
    """(doc_id, fp) for every row of ``df(doc_id, text)``, the fingerprint as a signed long."""

    def make():
        return lambda texts: {"fp": [signed(fingerprint(t)) for t in texts]}

    return map_rows(pick(df, "doc_id", "text"), make, "fp bigint")


def _segment(fp: np.ndarray, i: int) -> np.ndarray:
    return fp >> np.uint64(16 * (3 - i % SEGMENTS)) & np.uint64(0xFFFF)


def _listings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, fp, own): each fingerprint under four own keys and 64 changed ones."""
    flips = np.concatenate([[0], 1 << np.arange(16)]).astype(np.uint64)
    for batch in batches:
        fp = batch.column(0).to_numpy().view(np.uint64)
        for i in range(SEGMENTS):
            head = np.uint64(i << 32) | _segment(fp, i) << np.uint64(16) | _segment(fp, i + 1)
            keys = (head[:, None] ^ flips[None, :]).ravel().view(np.int64)
            own = np.tile(flips == 0, len(fp))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array(np.repeat(fp, len(flips)).view(np.int64)), pa.array(own)],
                names=["key", "fp", "own"],
            )


def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether fingerprints differ in at most RADIUS bits."""
    return np.bitwise_count(a ^ b) <= RADIUS


def ring(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether the chain of three segments from ``start`` stays within its budgets."""
    x = a ^ b
    shift = (np.uint64(16) * start.astype(np.uint64)) & np.uint64(63)
    turned = x << shift | np.where(shift > 0, x >> (np.uint64(64) - shift) % np.uint64(64), np.uint64(0))
    inside = np.bitwise_count(turned >> np.uint64(48)) == 0
    inside &= np.bitwise_count(turned >> np.uint64(32)) <= 1
    return inside & (np.bitwise_count(turned >> np.uint64(16)) <= 2)


def forest(fp: np.ndarray, own: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links in one group that its key stands for."""
    n = len(fp)
    near = linked(fp[:, None], fp[None, :]) & (own[:, None] | own[None, :])
    near &= ring(fp[:, None], fp[None, :], np.uint64(start))
    seen = np.zeros(n, bool)
    parent = np.full(n, -1)
    for root in range(n):
        if seen[root]:
            continue
        seen[root] = True
        front = np.array([root])
        while len(front):
            reach = near[front]
            new = np.flatnonzero(reach.any(axis=0) & ~seen)
            parent[new] = front[reach[:, new].argmax(axis=0)]
            seen[new] = True
            front = new
    child = np.flatnonzero(parent >= 0)
    return fp[child], fp[parent[child]]


def _links_of(key: np.ndarray, group: np.ndarray, fp: np.ndarray, own: np.ndarray):
    """Links of whole groups, given as sorted runs of ``group``."""
    edges = np.flatnonzero(np.diff(group)) + 1
    starts = np.concatenate([[0], edges])
    sizes = np.diff(np.append(starts, len(group)))
    out = [(fp[:0], fp[:0])]
    small = np.repeat(sizes <= SMALL, sizes)
    for d in range(1, SMALL):
        if d >= len(fp):
            break
        ok = small[:-d] & (group[d:] == group[:-d]) & (own[d:] | own[:-d])
        at = np.flatnonzero(ok)
        a, b = fp[at], fp[at + d]
        good = ring(a, b, (key[at] >> 32).astype(np.uint64)) & linked(a, b) & (a != b)
        out.append((a[good], b[good]))
    for s, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        values, first = np.unique(fp[s : s + size], return_index=True)
        # A fingerprint meets itself as own and changed only in different keys, so roles are unique.
        out.append(forest(values, own[s : s + size][first], int(key[s]) >> 32))
    return (np.concatenate([x[i] for x in out]) for i in (0, 1))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from rows (key, p, q, fp, own) sorted by (key, p, q); holds one open group at most."""
    held: list[np.ndarray] | None = None

    def table(columns: list[np.ndarray]) -> pa.RecordBatch:
        key, p, q, fp, own = columns
        change = np.ones(len(key), bool)
        change[1:] = (key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])
        u, v = _links_of(key, np.cumsum(change), fp.view(np.uint64), own)
        return pa.RecordBatch.from_arrays(
            [pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"]
        )

    for batch in batches:
        new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        if not len(new[0]):
            continue
        rows = new if held is None else [np.concatenate(x) for x in zip(held, new)]
        key, p, q = rows[:3]
        other = np.flatnonzero((key != key[-1]) | (p != p[-1]) | (q != q[-1]))
        cut = other[-1] + 1 if len(other) else 0
        if cut:
            yield table([x[:cut] for x in rows])
        held = [x[cut:] for x in rows]
    if held is not None:
        yield table(held)


def links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) of ``distinct(fp)``, enough to connect all within RADIUS bits of each other."""
    listed = distinct.select("fp").mapInArrow(_listings, "key bigint, fp bigint, own boolean")
    meeting = (
        listed.groupBy("key")
        .agg(F.count("*").alias("n"), F.sum(F.col("own").cast("long")).alias("owners"))
        .where("n > 1 and owners > 0")
        .select("key", F.ceil(F.col("n") / F.lit(block)).cast("int").alias("blocks"))
    )
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = (
        # Fingerprints come 68 times over here, which no estimate of their size tells: never a broadcast.
        listed.join(meeting.hint("merge"), "key")
        .select("key", "fp", "own", mine.alias("b"), other.alias("o"))
        .select("key", F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"), "fp", "own")
    )
    return (
        paired.repartition("key", "p", "q")
        .sortWithinPartitions("key", "p", "q")
        .mapInArrow(_meet, "u bigint, v bigint")
        .distinct()
    )


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per row of ``df(doc_id, text)``: doc_id, fingerprint (16 hex digits), component_id.

    Texts link when their fingerprints differ in at most three bits; component_id is the smallest
    doc_id that links reach. Texts without a word (null, empty) share fingerprint 0. Null ids take
    part; a component of null ids alone has a null component_id. Repeated rows are repeated.
    """
    rows = stage(fingerprints(df), "simhash")
    return resolve(rows, block).select(
        "doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id"
    )


def resolve(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Add root (of the component's fingerprints) and component_id to ``rows(doc_id, fp)``."""
    nodes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = connected_components(links(nodes, block), "simhash-links")
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stage(named.select("fp", "root").join(ids, "root"), "simhash-named")
    return rows.join(named, "fp")


def keep_one(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row of ``df`` per group of near-duplicates, all columns as they are: the smallest
    (doc_id, hash of the row), null ids last, and of equal rows one."""
    here = df.columns
    names = [f"_{i}" for i in range(len(here))]
    bare = df.toDF(*names)
    doc_id, text = (bare[f"_{here.index(n)}"] for n in ("doc_id", "text"))
    mark = F.xxhash64(*[F.col(n) for n in names])
    place = F.struct(doc_id.isNull().alias("none"), doc_id.alias("id"), mark.alias("mark"))
    narrow = bare.select(doc_id.alias("doc_id"), text.alias("text"), mark.alias("mark"))

    def make():
        return lambda texts: {"fp": [signed(fingerprint(t)) for t in texts]}

    keyed = narrow.select(
        F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "mark").alias("place"),
        "text",
    )
    shape = "place struct<none: boolean, id: bigint, mark: bigint>"
    rows = stage(map_rows(keyed, make, "fp bigint", keep=shape), "simhash-rows")
    groups = resolve(rows.select("place", F.col("place.id").alias("doc_id"), "fp"), block)
    chosen = groups.groupBy("root").agg(F.min("place").alias("place")).select("place")
    return (
        bare.withColumn("_place", place)
        .dropDuplicates(["_place"])
        .join(chosen.withColumnRenamed("place", "_place"), "_place", "left_semi")
        .select(*names)
        .toDF(*here)
    )
