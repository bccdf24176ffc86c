"""Manifests against trees that are hashed in plain Python."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from servelens.llm import merkle
from servelens.llm.queries import QUERIES

FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row]
    return sha("".join(parts))


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def proof(nodes, at):
    """(root, [(left, others)]) of a list of digests."""
    path = []
    while len(nodes) > 1:
        low = at // 16 * 16
        run = nodes[low : low + 16]
        path.append((run[: at - low], run[at - low + 1 :]))
        nodes, at = [sha("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)], at // 16
    return nodes[0], path


def brute(rows):
    """``rows`` are (doc_id, source, lang, n_chars, text)."""
    fields = lambda r, text: (r[0], r[1], r[2], r[3], text)
    groups = defaultdict(list)
    for r in rows:
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        claim = leaf(fields(r, lowered(r[4]) if hit else r[4]))
        groups[r[1]].append(((r[0] is not None, r[0] or 0, leaf(r)), r[0], leaf(r), claim))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subroots = []
    for name in names:
        groups[name].sort(key=lambda g: g[0])
        subroots.append(proof([g[2] for g in groups[name]], 0)[0])
    out = []
    for k, name in enumerate(names):
        root, over = proof(subroots, k)
        nodes = [g[2] for g in groups[name]]
        for at, (_, doc_id, own, claim) in enumerate(groups[name]):
            path = proof(nodes, at)[1] + over
            digest = sha("".join("".join(a + b) for a, b in path))
            node = claim
            for a, b in path:
                node = sha("".join(a) + node + "".join(b))
            out.append((doc_id, own, subroots[k], root, digest, node, node == root))
    return sorted(out, key=str)


def result(df):
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


def made(sizes, seed=3):
    rng = random.Random(seed)
    rows, at = [], 0
    for name, n in sizes.items():
        for _ in range(n):
            text = rng.choice([None, "", "Aé Z", f"Text {rng.random()}", "lower only"])
            rows.append((at, name, rng.choice([None, "en"]), rng.choice([None, 7]), text))
            at += rng.choice([0, 1, 1, 2, -3])
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 1},
        {"a": 16, "b": 17, None: 1, "": 2, "ä": 256, "Z": 257},
        {f"s{i}": 1 + i % 3 for i in range(300)},
        {"hot": 5000, "b": 3, None: 20},
    ],
)
def test_audit_equals_plain_trees(spark, sizes):
    rows = made(sizes)
    df = spark.createDataFrame(rows, FIELDS).repartition(5)
    assert result(merkle.audit(df)) == brute(rows)


def test_stored_levels_are_sparse(spark):
    rows = merkle.leaves(spark.createDataFrame(made({"a": 70_000}), FIELDS))
    levels = merkle.build_manifest(rows).levels
    assert [level.agg(F.sum(F.size("members"))).first()[0] for level in levels] == [70_000, 274, 2]


def test_single_proofs_read_their_way_only(spark):
    rows = made({"a": 700, "b": 4})
    manifest = merkle.build_manifest(merkle.leaves(spark.createDataFrame(rows, FIELDS)))
    wanted = spark.createDataFrame([("a", 699), ("a", 0), ("b", 2), ("c", 1), ("a", 700)], "source string, place long")
    some = merkle.verify(merkle.proofs(manifest, wanted))
    found = {(r.source, r.place): r for r in some.collect()}
    assert set(found) == {("a", 699), ("a", 0), ("b", 2)} and all(r.verified for r in found.values())
    every = merkle.verify(merkle.proofs(manifest))
    same = {(r.source, r.place): r.proof_sha256 for r in every.collect()}
    assert all(same[k] == r.proof_sha256 for k, r in found.items())


def test_awkward_rows(spark, documents, nothing):
    names = ("doc_id", "source", "lang", "n_chars", "text")
    rows = [tuple(r[n] for n in names) for r in documents.collect()]
    assert result(merkle.audit(documents)) == brute(rows)
    assert merkle.audit(nothing).collect() == []


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = ("doc_id", "source", "lang", "n_chars", "text")
    rows = [tuple(r[n] for n in names) for r in docs.collect()]
    assert result(QUERIES["op11_merkle_checkpoints"](spark, sf_dir)) == brute(rows)
