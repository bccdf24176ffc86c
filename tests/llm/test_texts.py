"""Operators that judge or encode each text alone, against brute force."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
import re
import urllib.parse
from collections import defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
import tiktoken
import tokenizers

from servelens.llm import bpe, quality_rules, secret_scan, token_counts

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def sample(alphabet, most, seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choices(alphabet, k=rng.randint(0, most))) for _ in range(n)]


def texts_of(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


# 1. repetition


def repeats_of(words, least):
    n, longest = len(words), [0] * len(words)
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and words[i + k] == words[j + k]:
                k += 1
            longest[i] = max(longest[i], k)
    covered = {p for i in range(n) if longest[i] >= least for p in range(i, i + longest[i])}
    places = defaultdict(list)
    for i in range(n):
        for j in range(i + least, n + 1):
            places[tuple(words[i:j])].append(i)
    maximal = [
        s
        for s, at in places.items()
        if len(at) > 1
        and len({words[i - 1] if i else -1 - i for i in at}) > 1
        and len({words[i + len(s)] if i + len(s) < n else None for i in at}) > 1
    ]
    return len(covered), max([x for x in longest if x >= least], default=0), len(maximal)


def test_repetition_against_brute_force():
    rng = random.Random(3)
    for _ in range(120):
        docs = [[rng.choice(b"abc") for _ in range(rng.choice([0, 1, 5, 25, 40]))] for _ in range(4)]
        docs = [[bytes([w]) for w in d] for d in docs]
        least = rng.choice([2, 3, 5])
        got = quality_rules.repetition(docs, least)
        for at, doc in enumerate(docs):
            assert repeats_of(doc, least) == tuple(got[k][at] for k in ("covered", "longest", "repeats"))


def test_base_counts_against_plain_code(spark, sf_dir):
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    for doc_id, text in texts_of(spark, sf_dir):
        words, row = WORDS.findall(text), got[doc_id]
        windows = defaultdict(list)
        for i in range(len(words) - 4):
            windows[tuple(words[i : i + 5])].append(i)
        repeated = {p for at in windows.values() if len(at) > 1 for i in at for p in range(i, i + 5)}
        lines = [x for x in text.split("\n") if WORDS.search(x)]
        assert row.n_words == len(words) and row.n_repeat_words == len(repeated)
        assert row.word_chars == sum(map(len, words))
        assert row.n_symbols == len(re.findall(r"[#*$%&|<>]", text))
        assert row.n_dup_lines == len(lines) - len(set(lines))
        assert row.base_failed == (len(words) < 10 or 100 * len(repeated) > 20 * len(words))
        assert not (row.base_failed and row.kept)


def test_good_documents_stay(spark, sf_dir):
    rows = quality_rules.quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    good = rows.join(spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1"), "doc_id")
    assert good.where("not base_failed and not kept").count() == 0


def test_repetition_verdict():
    unique = [f"w{i}".encode() for i in range(300)]
    long_repeat = b" ".join(unique + unique[:70] + [f"v{i}".encode() for i in range(600)])
    short_repeat = b" ".join(unique + unique[:20])
    got = quality_rules.judge([long_repeat, short_repeat, b""], 8, 0.2, 60)
    assert got["kept"] == [False, True, False] and got["base_failed"] == [False, False, True]
    assert got["longest_repeat"][:2] == [70, 20]


def test_repetition_awkward_rows(spark, documents, nothing):
    got = quality_rules.quality_rules(documents)
    assert got.count() == documents.count()
    assert got.where("doc_id = 5").first().base_failed
    kept = quality_rules.keep_good(documents)
    assert kept.columns == documents.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 1]
    assert quality_rules.quality_rules(nothing).count() == quality_rules.keep_good(nothing).count() == 0


# 3. byte-level BPE

PARTS = ["a", "b", "e", "t", " ", "  ", "\n", "'s", "é", "ñ", "0", "1", "中", "🙂", "!!", "́", "the", "ing", "A", "'r", "e", "\x1c"]


def encoders():
    ranks = bpe.read_ranks(public_tokenizers.path(bpe.RANKS))
    theirs = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return bpe.TextEncoder(ranks), theirs


def test_bpe_against_library(spark, sf_dir):
    mine, theirs = encoders()
    texts = sample(PARTS, 40, 1, 3000) + [t for _, t in texts_of(spark, sf_dir)] + ["a" * 20_000]
    for text in texts:
        packed = mine.packed(text)
        assert list(bpe.unpack(packed)) == theirs.encode_ordinary(text)
        assert mine.decode(packed) == text.encode()


def test_bpe_append_and_edit():
    mine, theirs = encoders()
    texts, more = sample(PARTS, 40, 2, 1500), sample(PARTS, 10, 3, 1500)
    for text, tail in zip(texts, more):
        assert mine.append(text, mine.encode(text), tail) == theirs.encode_ordinary(text + tail)
    rng = random.Random(4)
    for text in sample(PARTS, 60, 5, 500) + ["x" * 3000]:
        piece = text.encode()
        start = rng.randint(0, len(piece))
        stop = rng.randint(start, min(len(piece), start + 8))
        new, table = mine.encoder.edit(piece, mine.encoder.table(piece), start, stop, b"the s")
        assert new == piece[:start] + b"the s" + piece[stop:] and table == mine.encoder.table(new)


def test_bpe_awkward_rows(documents, nothing):
    rows = bpe.encode_documents(documents).collect()
    assert len(rows) == documents.count()
    empty = hashlib.sha256(b"").hexdigest()
    assert {(r.n_tokens, r.ids_sha256) for r in rows if r.doc_id in (2, 3)} == {(0, empty)}
    assert bpe.encode_documents(nothing).count() == 0


# 6. token counts


def test_counts_against_library(spark, sf_dir):
    path = public_tokenizers.path(token_counts.MODEL)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    parts = ["a", " ", "  ", "   ", "\n", "\t", "é", "中", "🙂", "<s>", "▁", "<0x0A>", "the", " ing", "\xa0", "\x00", "ﬁ"]
    texts = sample(parts, 20, 6, 5000) + [t for _, t in texts_of(spark, sf_dir)]
    assert token_counts.PieceCounter(path).count(texts) == [len(x) for x in model.encode(texts)]


def test_counts_of_a_json_vocabulary(documents):
    path = public_tokenizers.path("byte_bpe_50k.json")
    theirs = tokenizers.Tokenizer.from_file(path)
    texts = sample(["a", " ", "the", "<|endoftext|>", "é"], 20, 7, 200)
    got = token_counts.JsonCounter(path).count(texts)
    assert got == [len(e.ids) for e in theirs.encode_batch(texts, add_special_tokens=False)]


def test_counts_awkward_rows(documents, nothing):
    rows = token_counts.count_tokens(documents).collect()
    assert len(rows) == documents.count()
    assert {(r.n_bytes, r.n_tokens) for r in rows if r.doc_id in (2, 3)} == {(0, 0)}
    assert [r.over_limit for r in rows if r.doc_id == 5] == [True]
    assert token_counts.count_tokens(nothing).count() == 0


def test_batches_are_balanced():
    units = ["x" * n for n in (1, 5, 100, 3, 3, 3)]
    parts = list(token_counts.balanced(units, 40))
    assert [u for p in parts for u in p] == units
    assert all(4 * sum(map(len, p)) <= 40 or len(p) == 1 for p in parts)


# 8. secrets

SECRET = "password = hunter2hunter2"


def spans_of(text):
    return secret_scan.written(secret_scan.find_secrets(text)[1])


def test_plain_secrets_against_the_patterns(spark, sf_dir):
    group = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    parts = ["token", "=", ": ", "secret", '"', "abcdefgh", "AKIA", "ABCDEFGH1234", "0123456789abcdef", " ", "API_key", "é"]
    for text in sample(parts, 15, 8, 2000) + [t for _, t in texts_of(spark, sf_dir)]:
        want = [(m.start(), 0, m.end()) for m in group.finditer(text) if len(m[2]) >= 8]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        base, every = secret_scan.find_secrets(text)
        assert secret_scan.written(base) == ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(want))
        assert set(base) <= set(every)


def test_layers_are_unwrapped():
    quoted = urllib.parse.quote(SECRET, safe="")
    packed = base64.b64encode(gzip.compress(SECRET.encode())).decode()
    escaped = "".join(f"\\u{ord(c):04x}" for c in SECRET)
    twice = urllib.parse.quote(base64.urlsafe_b64encode(quoted.encode()).decode(), safe="")
    for layer in (quoted, packed, escaped, twice, base64.b64encode(packed.encode()).decode()):
        found = [s.split(":") for s in spans_of(f"é🙂 {layer} end").split(",")]
        assert {(kind, start) for kind, start, _ in found} == {("assign", "3")}
        assert max(int(end) for *_, end in found) == 3 + len(layer)
    assert spans_of("a%2561 token%253D%2522abcdefgh1 x") == "assign:7:31"


def test_worklist_ends():
    # Escapes of the escape sign: each layer is shorter, and equal layers are taken up once.
    assert secret_scan.find_secrets("%25" * 500 + "41")[0] == []
    assert secret_scan.find_secrets("QUFB" * 400)[0] == []


def test_secrets_awkward_rows(documents, nothing):
    rows = secret_scan.scan_secrets(documents).collect()
    assert len(rows) == documents.count()
    assert [(r.n_assign, r.n_hex) for r in rows if r.doc_id == 7] == [(1, 1)]
    assert {r.base_sha256 for r in rows if r.doc_id in (2, 3)} == {hashlib.sha256(b"").hexdigest()}
    assert secret_scan.scan_secrets(nothing).count() == 0


def test_segments_of_suffix_array_are_sorted():
    ids = np.array([1, 2, 1, 2, 1, 3, 1, 1, 1, 1])
    doc = np.array([0] * 6 + [1] * 4)
    order, lcp = quality_rules.suffix_arrays(ids, doc, np.array([6] * 6 + [10] * 4))
    suffix = [(doc[p], ids[p : (6 if doc[p] == 0 else 10)].tolist()) for p in order]
    assert suffix == sorted(suffix) and lcp.tolist() == [0, 3, 1, 0, 2, 0, 0, 1, 2, 3]
