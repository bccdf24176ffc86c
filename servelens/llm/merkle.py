"""Merkle manifests of a dataset: a tree of 16 branches per source, and one over the sources.

Only every second level is stored (the leaves, then one node for each 256 below, and so on). A stored
row is an aligned subtree: the nodes of one stored level that have the same ancestor on the next one.
Building hashes the levels between and keeps the top alone. Proofs go down the stored levels: each
subtree hashes its missing level again from the nodes that it stores, hands every node its siblings,
and forgets them. Digests are lowercase hex; an inner node is the SHA-256 of its children's digests,
one after the other.

Leaves get their place in a source from a sort by range and the row counts of its parts, so a source
that holds most rows lies in many tasks. A subtree has 256 nodes at most, and texts are never
shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from servelens.llm.common import pick
from servelens.session import shared_dir

FAN = 16
#: Levels from one stored level to the next, and nodes of a stored subtree.
STRIDE = 2
SUBTREE = FAN**STRIDE
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest_of(*values: Column) -> Column:
    """H of the values: ``-`` for null, else byte count, ``:`` and the value as text."""
    texts = [v.cast("string") for v in values]
    parts = [
        F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
        for t in texts
    ]
    return F.sha2(F.concat(*parts), 256)


def together(digests: Column) -> Column:
    """H of an array of digests."""
    return F.sha2(F.array_join(digests, ""), 256)


def leaves(df: DataFrame, **claims: dict[str, Column]) -> DataFrame:
    """(source, doc_id, leaf) of the rows of ``df``; each of ``claims`` adds a leaf of the row with
    some fields replaced, by the expressions over :data:`FIELDS` that it maps them to."""
    rows = pick(df, *FIELDS)
    own = {f: F.col(f) for f in FIELDS}
    return rows.select(
        "source",
        "doc_id",
        digest_of(*own.values()).alias("leaf"),
        *[digest_of(*(own | changed).values()).alias(name) for name, changed in claims.items()],
    )


@dataclass
class Manifest:
    """A manifest in the shared folder.

    ``levels`` are the stored levels of all sources' trees, leaves first: (key, subtree, n, members);
    ``n`` nodes of the level are under the key, ``members`` are those of the subtree in order, with a
    ``digest`` each. ``sources`` are those of the tree over the subroots. ``root`` is null for an
    empty table.
    """

    levels: list[DataFrame]
    sources: list[DataFrame]
    root: str | None


def placed(rows: DataFrame, order: Sequence[str], path: str) -> DataFrame:
    """``rows`` with ``place``, the row number from 0 inside ``key`` in the given order, and ``n``, the
    rows of the key.

    Rows are sorted by range and written with a running number; a part's share of a key is then
    numbered by the rows of the key in the parts before. Equal rows are told apart by where they
    were read from, so that they don't all go to one part.
    """
    spark = rows.sparkSession
    by = ["key", *order, "_read"]
    (
        rows.withColumn("_read", F.monotonically_increasing_id())
        .repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .drop("_read")
        .withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
        .write.parquet(path)
    )
    ordered = spark.read.parquet(path)
    whole = Window.partitionBy("key")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each source and part of the sort meets here, no documents.
    parts = (
        ordered.groupBy("key", "_part")
        .agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .withColumn("n", F.sum("_n").over(whole))
        .select("key", "_part", "_first", "_before", "n")
    )
    place = F.col("_at") - F.col("_first") + F.col("_before")
    return ordered.join(parts, ["key", "_part"]).select(*rows.columns, place.alias("place"), "n")


def _up(digests: Column) -> Column:
    """The nodes over an array of nodes."""
    runs = F.sequence(F.lit(0), F.floor((F.size(digests) - 1) / FAN).cast("int"))
    return F.transform(runs, lambda k: together(F.slice(digests, k * FAN + 1, F.lit(FAN))))


def _stored(nodes: DataFrame, path: str) -> DataFrame:
    """Write ``nodes(key, n, place, member)`` as a level of subtrees."""
    (
        nodes.groupBy("key", "n", F.floor(F.col("place") / SUBTREE).alias("subtree"))
        .agg(F.array_sort(F.collect_list(F.struct("place", "member"))).alias("found"))
        .select("key", "subtree", "n", F.transform("found", lambda m: m["member"]).alias("members"))
        .write.parquet(path)
    )
    return nodes.sparkSession.read.parquet(path)


def _tops(level: DataFrame) -> DataFrame:
    """(key, subtree, n, digest) of the node that each subtree comes to."""
    own = F.transform("members", lambda m: m["digest"])
    top = (
        F.when(F.col("n") == 1, F.col("own"))
        .when(F.col("n") <= FAN, _up(F.col("own")))
        .otherwise(_up(_up(F.col("own"))))
    )
    return level.withColumn("own", own).select("key", "subtree", "n", top[0].alias("digest"))


def _tree(nodes: DataFrame, path: str) -> tuple[list[DataFrame], DataFrame]:
    """Stored levels over ``nodes(key, n, place, member)``, and (key, digest) of each key's top."""
    levels = [_stored(nodes, f"{path}-0")]
    while not (more := _tops(levels[-1].where(F.col("n") > SUBTREE))).isEmpty():
        above = more.select(
            "key",
            F.ceil(F.col("n") / SUBTREE).alias("n"),
            F.col("subtree").alias("place"),
            F.struct("digest").alias("member"),
        )
        levels.append(_stored(above, f"{path}-{len(levels)}"))
    ended = [_tops(level.where(F.col("n") <= SUBTREE)).select("key", "digest") for level in levels]
    return levels, reduce(DataFrame.unionByName, ended)


def build_manifest(rows: DataFrame, carry: Sequence[str] = ("doc_id",)) -> Manifest:
    """Write the manifest of ``rows(source, doc_id, leaf, ...)`` from :func:`leaves`; the columns of
    ``carry`` stay with the leaves.

    Leaves ascend by doc_id, null ids first, equal ids by their leaf. Null is a source of its own,
    the first one. An empty table has no root.
    """
    spark = rows.sparkSession
    path = shared_dir(spark, "manifest")
    # Texts are read and hashed once: sorting by range reads its input twice.
    rows.withColumn("key", F.struct("source")).drop("source").write.parquet(f"{path}/leaves")
    found = placed(spark.read.parquet(f"{path}/leaves"), ("doc_id", "leaf"), f"{path}/sorted")
    member = F.struct(F.col("leaf").alias("digest"), *carry)
    levels, tops = _tree(found.select("key", "n", "place", member.alias("member")), f"{path}/level")
    tops.select(
        F.struct(F.lit(0).alias("all")).alias("key"), F.col("key.source").alias("source"), "digest"
    ).write.parquet(f"{path}/tops")
    ranks = placed(spark.read.parquet(f"{path}/tops"), ("source",), f"{path}/ranks")
    member = F.struct("digest", "source")
    sources, root = _tree(ranks.select("key", "n", "place", member.alias("member")), f"{path}/sources")
    return Manifest(levels, sources, root.select(F.max("digest")).first()[0])


def _step(digests: Column, at: Column) -> Column:
    """A level of a proof: how many siblings stand left, and all of them in order."""
    run = F.slice(digests, F.floor(at / FAN).cast("int") * FAN + 1, F.lit(FAN))
    left = (at % FAN).cast("int")
    others = F.concat(F.slice(run, F.lit(1), left), F.slice(run, left + 2, F.lit(FAN)))
    return F.struct(left.alias("left"), others.alias("others"))


def _paths(rows: DataFrame) -> DataFrame:
    """(key, place, member, subroot, path) of the nodes of subtrees that know the ``upper`` path."""
    # The missing level is hashed once for each subtree, before its nodes are taken apart.
    opened = (
        rows.withColumn("own", F.transform("members", lambda m: m["digest"]))
        .withColumn("between", _up(F.col("own")))
        .select("*", F.posexplode("members").alias("at", "member"))
    )
    at = F.col("at")
    first, second = _step(F.col("own"), at), _step(F.col("between"), F.floor(at / FAN))
    path = (
        F.when(F.col("n") == 1, F.col("upper"))
        .when(F.col("n") <= FAN, F.concat(F.array(first), F.col("upper")))
        .otherwise(F.concat(F.array(first, second), F.col("upper")))
    )
    place = (F.col("subtree") * SUBTREE + at).alias("place")
    return opened.select("key", place, "member", "subroot", path.alias("path"))


def _down(levels: Sequence[DataFrame], over: DataFrame | None) -> DataFrame:
    """Proofs of the leaves: from the last stored level to the first, each node hands its path to the
    subtree below it. A key's last subtree, one row, starts with its row of ``over(key, subroot,
    upper)``."""
    found = None
    for level in reversed(levels):
        last = level.where(F.col("n") <= SUBTREE)
        if over is None:
            none = F.array().cast("array<struct<left: int, others: array<string>>>")
            rows = last.withColumns({"subroot": F.lit(None).cast("string"), "upper": none})
        else:
            rows = last.join(over, "key")
        if found is not None:
            above = found.select(
                "key", F.col("place").alias("subtree"), "subroot", F.col("path").alias("upper")
            )
            below = level.where(F.col("n") > SUBTREE).join(above, ["key", "subtree"])
            rows = rows.unionByName(below)
        found = _paths(rows)
    return found


def proofs(manifest: Manifest, wanted: DataFrame | None = None) -> DataFrame:
    """A row per leaf: source, place, member (digest and carried columns), subroot, root and path, an
    array of (left, others) from the leaf's run up to the root's: siblings, and how many stand left.

    With ``wanted(source, place)`` only for these leaves, reading no more subtrees than lie on their
    ways.
    """
    levels = list(manifest.levels)
    if wanted is not None:
        asked = wanted.select(F.struct("source").alias("key"), "place").distinct()
        for k, level in enumerate(levels):
            subtree = F.floor(F.col("place") / SUBTREE ** (k + 1)).alias("subtree")
            levels[k] = level.join(asked.select("key", subtree).distinct(), ["key", "subtree"], "left_semi")
    over = _down(manifest.sources, None).select(
        F.struct(F.col("member.source").alias("source")).alias("key"),
        F.col("member.digest").alias("subroot"),
        F.col("path").alias("upper"),
    )
    found = _down(levels, over)
    if wanted is not None:
        found = found.join(asked, ["key", "place"], "left_semi")
    root = F.lit(manifest.root).alias("root")
    return found.select("key.source", "place", "member", "subroot", root, "path")


def proof_digest(path: Column) -> Column:
    """H of all siblings of a path, from the leaf up, left to right."""
    return together(F.flatten(F.transform(path, lambda step: step["others"])))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of a path give."""

    def over(node: Column, step: Column) -> Column:
        left, others = step["left"], step["others"]
        return F.sha2(
            F.concat(
                F.array_join(F.slice(others, F.lit(1), left), ""),
                node,
                F.array_join(F.slice(others, left + 1, F.lit(FAN)), ""),
            ),
            256,
        )

    return F.aggregate(path, leaf, over)


def verify(proven: DataFrame, claim: str = "digest") -> DataFrame:
    """Add proof_sha256, folded_root and verified to rows of :func:`proofs`, where ``claim`` names the
    member's field that holds the digest of the row as it is now."""
    return proven.withColumns(
        {
            "proof_sha256": proof_digest(F.col("path")),
            "folded_root": folded(F.col(f"member.{claim}"), F.col("path")),
        }
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered(text: Column, doc_id: Column) -> Column:
    """The text with its A-Z in lower case where 5 divides the crc32 of the id; without an id as it is."""
    upper = "".join(map(chr, range(65, 91)))
    hit = F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0
    return F.when(hit, F.translate(text, upper, upper.lower())).otherwise(text)


def audit(df: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of
    ``df(doc_id, source, lang, n_chars, text)``: the manifest is built from the rows and then each row,
    with its text as :func:`tampered` leaves it, is held against its proof.

    Nulls in any field are part of the leaf and differ from empty texts. Rows with equal ids are
    ordered by their leaves; equal rows are leaves of their own. Other columns don't matter. An empty
    table gives no rows.
    """
    changed = {"text": tampered(F.col("text"), F.col("doc_id"))}
    manifest = build_manifest(leaves(df, claim=changed), carry=("doc_id", "claim"))
    checked = verify(proofs(manifest), "claim")
    return checked.select(
        F.col("member.doc_id").alias("doc_id"), F.col("member.digest").alias("leaf"), "subroot",
        "root", "proof_sha256", "folded_root", "verified",
    )
