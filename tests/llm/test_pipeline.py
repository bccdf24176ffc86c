"""The pipeline's stages, each against what its operator says of its input."""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import corpus_pipeline
import public_tokenizers
import tiktoken

from servelens.llm import bpe, mixing, pii, quality_rules


def one_of_each(rows):
    """Smallest ids of the groups of texts whose five-word shingles have a Jaccard similarity of 0.8."""
    sets = {}
    for doc_id, text in rows:
        words = (text or "").encode().lower().split()
        sets[doc_id] = {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()
    root = {i: i for i in sets}
    for (i, a), (j, b) in combinations(sorted(sets.items()), 2):
        if a == b or 5 * len(a & b) >= 4 * len(a | b):
            low, high = sorted((root[i], root[j]))
            root = {k: low if r == high else r for k, r in root.items()}
    return set(root.values())


def test_stages_take_effect(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, parts = docs.columns, [docs]
    for k, (_, function) in enumerate(corpus_pipeline.STAGES):
        function(spark, parts[-1], sf_dir).write.parquet(str(tmp_path / str(k)))
        parts.append(spark.read.parquet(str(tmp_path / str(k))))
    start, good, single, clean, mixed, tokens = parts
    assert all(p.columns == columns for p in parts[:-1])
    ids = [Counter(r.doc_id for r in p.select("doc_id").collect()) for p in parts]

    kept = {r.doc_id for r in quality_rules.quality_rules(start).where("kept").collect()}
    assert set(ids[1]) == kept
    assert set(ids[2]) == one_of_each(good.select("doc_id", "text").collect()) and max(ids[2].values()) == 1
    spans = pii.find_pii(single).where("spans != ''").count()
    assert spans > 0 and pii.find_pii(clean).where("n_email + n_ip + n_card + n_phone > 0").count() == 0
    same = {r.doc_id: r.text for r in single.collect()}
    changed = [r for r in clean.collect() if same[r.doc_id] != r.text]
    assert len(changed) == spans and all("[" in r.text and r.n_chars == len(r.text) for r in changed)
    for r in mixing.mix(clean).collect():
        assert ids[4][r.doc_id] in {r.taken // max(r.size, 1), -(-r.taken // max(r.size, 1))}
    ranks = bpe.read_ranks(public_tokenizers.path(bpe.RANKS))
    theirs = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in mixed.collect()}
    for r in tokens.collect():
        assert list(bpe.unpack(bytes(r.ids))) == theirs.encode_ordinary(texts[r.doc_id])
    assert ids[5] == ids[4]


def test_stages_take_awkward_rows(spark, sf_dir, documents, nothing, tmp_path):
    """Nulls, repeated rows and an empty table go through all stages."""
    for name, start in (("rows", documents.select("doc_id", "text", "lang", "source", "n_chars")), ("none", nothing)):
        docs = start
        for k, (_, function) in enumerate(corpus_pipeline.STAGES):
            function(spark, docs, sf_dir).write.parquet(str(tmp_path / f"{name}{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}{k}"))
            assert set(start.columns) <= set(docs.columns) or k == 4
        # Long enough and not repeated in itself: one text, given twice and kept once.
        assert {r.doc_id for r in docs.collect()} <= ({1, None} if name == "rows" else set())


def test_run_is_the_stages(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.count() > 0 and set(rows.columns) >= {"doc_id", "n_tokens", "ids_sha256"}
