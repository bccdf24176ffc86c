"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

OP7 = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM usable a JOIN usable b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reach AS (
  SELECT vec_id AS u, vec_id AS r FROM embeddings
  UNION
  SELECT l.u, reach.r FROM links l JOIN reach ON reach.u = l.v
), least AS (SELECT u, min(r) AS component_id FROM reach GROUP BY u)
SELECT e.vec_id,
       (SELECT count(*) FROM links l WHERE l.u = e.vec_id)::BIGINT AS n_links,
       component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least ON least.u = e.vec_id
"""

OP10 = r"""
WITH docs AS (
  SELECT doc_id, source, md5('17:' || coalesce(doc_id::VARCHAR, 'null')) AS place,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source
), ranked AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE]
    [((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
    2.0::DOUBLE * source_size AS cap
  FROM sizes
), leveled AS (
  SELECT *, cap / weight AS ratio,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER earlier, 0.0::DOUBLE))
      / sum(weight) OVER onward AS level
  FROM ranked
  WINDOW earlier AS (ORDER BY cap / weight, source NULLS LAST
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         onward AS (ORDER BY cap / weight, source NULLS LAST
                    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), goal AS (
  SELECT source, source_size, least(cap, coalesce(
    (SELECT level FROM leveled WHERE ratio > level ORDER BY ratio, source NULLS LAST LIMIT 1)
    * weight, cap)) AS target
  FROM leveled
), rest AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs
  FROM goal
), placed AS (
  SELECT source, place, sum(size)::BIGINT AS place_size,
    (sum(sum(size)) OVER (PARTITION BY source ORDER BY place))::BIGINT AS passed
  FROM docs GROUP BY source, place
)
SELECT d.doc_id, d.size, r.source_size, r.target,
  (d.size * r.epochs + CASE
     WHEN p.passed <= floor(r.target)::BIGINT - r.epochs * r.source_size THEN d.size
     WHEN p.passed - p.place_size < floor(r.target)::BIGINT - r.epochs * r.source_size
       THEN (d.size * (floor(r.target)::BIGINT - r.epochs * r.source_size
                       - (p.passed - p.place_size))) // p.place_size
     ELSE 0 END)::BIGINT AS taken
FROM docs d
JOIN rest r ON r.source IS NOT DISTINCT FROM d.source
JOIN placed p ON p.source IS NOT DISTINCT FROM d.source AND p.place = d.place
"""


def _levels(name: str, key: str, count: int) -> str:
    """CTEs ``name1``, ``name2``, ... of the levels over ``name0(key, p, d, n)``."""
    return "".join(
        f"""{name}{k + 1} AS (
  SELECT {key}, p // 16 AS p, (n + 15) // 16 AS n,
    CASE WHEN n = 1 THEN min(d) ELSE sha256(string_agg(d, '' ORDER BY p)) END AS d
  FROM {name}{k} GROUP BY {key}, n, p // 16
), """
        for k in range(count)
    )


def _sides(name: str, key: str, rows: str, count: int) -> str:
    """CTEs of the siblings left (a) and right (b) of each row of ``rows(id, key, place)``."""
    return "".join(
        f"""{name}side{k} AS (
  SELECT r.id, any_value(l.n) AS n,
    coalesce(string_agg(l.d, '' ORDER BY l.p) FILTER (l.p < r.place // {16**k}), '') AS a,
    coalesce(string_agg(l.d, '' ORDER BY l.p) FILTER (l.p > r.place // {16**k}), '') AS b
  FROM {rows} r JOIN {name}{k} l
    ON l.{key} IS NOT DISTINCT FROM r.{key} AND l.p // 16 = r.place // {16 ** (k + 1)}
  GROUP BY r.id
), """
        for k in range(count)
    )


def _manifest_sql(deep: int = 5, wide: int = 3) -> str:
    """``deep`` levels over the leaves of a source, ``wide`` over the sources."""
    part = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
    head = " || ".join(part.format(f) for f in ("doc_id", "source", "lang", "n_chars"))
    # CRC-32 of the decimal digits, bit by bit.
    bits = "list_reduce(list_prepend(xor(c, x), range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))"
    codes = "list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ord(s)::BIGINT)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, x: {bits}), 4294967295)"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    text = f"CASE WHEN {crc} % 5 = 0 THEN translate(text, '{upper}', '{lower}') ELSE text END"
    steps = [("s", k) for k in range(deep)] + [("t", k) for k in range(wide)]
    joins = "".join(f" JOIN {x}side{k} {x}{k} ON {x}{k}.id = r.{'id' if x == 's' else 'source_id'}" for x, k in steps)
    proof = " || ".join(f"{x}{k}.a || {x}{k}.b" for x, k in steps)
    nodes, node = [], "r.claim"
    for number, (x, k) in enumerate(steps):
        nodes.append(f"CASE WHEN {x}{k}.n = 1 THEN {node} ELSE sha256({x}{k}.a || {node} || {x}{k}.b) END AS f{number}")
        node = f"f{number}"
    return f"""
WITH hashed AS (
  SELECT doc_id, source, sha256({head} || {part.format('text')}) AS leaf,
    sha256({head} || {part.format(f'({text})')}) AS claim
  FROM documents
), s AS (
  SELECT *, row_number() OVER () AS id, count(*) OVER (PARTITION BY source) AS n,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place
  FROM hashed
), s0 AS (SELECT source, place AS p, leaf AS d, n FROM s),
{_levels("s", "source", deep)}
t AS (
  SELECT source, d, 0 AS every, row_number() OVER (ORDER BY source NULLS FIRST) AS id,
    row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n
  FROM s{deep}
), t0 AS (SELECT every, place AS p, d, n FROM t),
{_levels("t", "every", wide)}
{_sides("s", "source", "s", deep)}{_sides("t", "every", "t", wide)}
r AS (
  SELECT s.*, t.id AS source_id, t.d AS subroot FROM s JOIN t ON t.source IS NOT DISTINCT FROM s.source
)
SELECT r.doc_id, r.leaf, r.subroot, top.d AS root, sha256({proof}) AS proof_sha256,
  {", ".join(nodes[:-1])}, {nodes[-1].removesuffix(f"AS {node}")} AS folded_root,
  folded_root = top.d AS verified
FROM r{joins}, t{wide} top
"""


OP11 = f"""
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, verified FROM ({_manifest_sql()})
"""

OP12 = """
WITH rows AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), judged AS (
  SELECT *, max(page_id) OVER (PARTITION BY hex) AS first FROM rows
)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
  -- Five hex digits are four letters of base 32.
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(hex, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - i % 4 * 5)::INT) & 31)::INT + 1, 1)), '')
    AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM judged
"""

OP13 = r"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), []) AS terms
  FROM documents
), items AS (
  SELECT item_id, text, unnest(list_distinct(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
  FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)
), totals AS (
  SELECT count(*) FILTER (len(terms) > 0) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM docs
), postings AS (
  SELECT r, doc_id, n, term, count(*) AS tf
  FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM docs)
  WHERE term IN (SELECT term FROM items) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM postings, totals GROUP BY term, n_docs
), scored AS (
  SELECT item_id, text, r, doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM items JOIN weights USING (term) JOIN postings USING (term), totals
  GROUP BY item_id, text, r, doc_id
)
SELECT item_id, doc_id, score,
  row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank
FROM scored WHERE score > 0
QUALIFY rank <= 10
"""

ORACLE: dict[str, str] = {
    "op7_embedding_collisions": OP7,
    "op10_water_filling": OP10,
    "op11_merkle_checkpoints": OP11,
    "op12_warc_index": OP12,
    "op13_geometric_blocks": OP13,
}
