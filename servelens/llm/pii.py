"""Personal data by fixed patterns and by bootstrapped contexts, in built-in functions only.

Matches of the fixed patterns are seeds. Every other token with three digits or an at sign is an
instance, too, and the word before an instance is its lexical pattern. On the graph of patterns and
instances, confidence passes back and forth: a pattern's is the confidence of its distinct instances
over their number plus a prior; a pattern at the threshold, with enough distinct seeds, is accepted
and lends its instances the chance that not all their accepted patterns are wrong, which raises
other patterns in the next round. Instances of patterns that are accepted in the end are personal
data found by context.

Positions follow from splitting: a text is the gaps between matches and the matches in turn, so a
running sum of lengths over the matches of a text gives their spans, in code points.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from servelens.llm.common import pick
from servelens.session import stage

#: Kinds in their order; those found by context come last.
KINDS = ("email", "ip", "card", "phone", "context")
CONTEXT = KINDS.index("context")
#: The fixed patterns (fixed values), written so that no run is tried twice: a local part can begin
#: only where a run of its characters or the last match ends, repetition of characters that cannot
#: start what follows is possessive (for groups that also spares the stack), and a card needs its 14
#: digits at once.
LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++"
IP = r"[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)"
CARD = r"[0-9]([\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A token with three digits or an at sign, tried at token starts only.
S = r"\x20\x09-\x0D"
TOKEN = rf"(?<![^{S}])(?=[^{S}@]*+@|(?:[^{S}0-9]*+[0-9]){{3}})[^{S}]++"
PATTERNS = (EMAIL, IP, CARD, PHONE, TOKEN)
#: A text without any of these has no match at all.
ANY = "[0-9@]"
IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
IP_VALID = rf"^{IP_PART}(?:\.{IP_PART}){{3}}$"
#: Tried at word starts only, so that a long gap is read once.
LAST_WORD = rf"(?<![^{S}])([^{S}]++)[{S}]++$"
THRESHOLD, SEEDS, PRIOR = 0.8, 3, 1.0


def _matches(text: Column, pattern: str) -> Column:
    """Array of (gap, left, found): the gap's length and last word, and each match after it."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(
        gaps,
        found,
        lambda g, f: F.struct(
            F.length(g).alias("gap"),
            F.when(f.isNotNull(), F.regexp_extract(g, LAST_WORD, 1)).alias("left"),
            f.alias("found"),
        ),
    )
    return F.when(text.rlike(ANY), F.filter(pairs, lambda x: x["found"].isNotNull()))


def read_texts(df: DataFrame, *more: str) -> DataFrame:
    """A written table with a row number, the ``more`` columns, and the matches of each pattern in
    ``text``; the text is read once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    columns = [_matches(text, p).alias(f"m{k}") for k, p in enumerate(PATTERNS)]
    return stage(df.select(F.monotonically_increasing_id().alias("rid"), *more, *columns), "pii")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    turned = F.reverse(digits)

    def part(i: Column) -> Column:
        digit = F.substring(turned, i, F.lit(1)).cast("int")
        double = digit * 2
        return F.when(i % 2 == 1, digit).when(double > 9, double - 9).otherwise(double)

    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + part(i)
    )
    return total % 10 == 0


def located(read: DataFrame) -> DataFrame:
    """(rid, kind, start, end, left, found) of all matches, tokens as kind ``context``."""
    parts = [
        read.where(F.size(f"m{k}") > 0)
        .select("rid", F.posexplode(f"m{k}").alias("i", "m"))
        .select("rid", F.lit(k).alias("kind"), "i", "m.gap", "m.left", "m.found")
        for k in range(len(PATTERNS))
    ]
    rows = reduce(DataFrame.union, parts).withColumn("size", F.length("found"))
    passed = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("rid", "kind").orderBy("i"))
    return rows.select(
        "rid",
        "kind",
        (passed - F.col("size")).cast("int").alias("start"),
        passed.cast("int").alias("end"),
        "left",
        "found",
    )


def base_spans(rows: DataFrame) -> DataFrame:
    """The matches of the fixed patterns that pass their check."""
    kind, found = F.col("kind"), F.col("found")
    digits = F.regexp_replace(found, "[^0-9]", "")
    n = F.length(digits)
    ok = (
        F.when(kind == KINDS.index("email"), F.lit(True))
        .when(kind == KINDS.index("ip"), found.rlike(IP_VALID))
        .when(kind == KINDS.index("card"), F.when(n.between(14, 19), luhn(digits)))
        .when(kind == KINDS.index("phone"), n.between(10, 15))
    )
    return rows.where((kind < CONTEXT) & ok)


def free_tokens(rows: DataFrame, base: DataFrame) -> DataFrame:
    """Tokens that no base span touches, without the punctuation around them."""
    token = F.col("found")
    bare_left = F.regexp_replace(token, "^[^A-Za-z0-9]++", "")
    lead = F.length(token) - F.length(bare_left)
    core = F.regexp_replace(bare_left, "[^A-Za-z0-9]++$", "")
    tokens = rows.where(F.col("kind") == CONTEXT).select(
        "rid",
        "kind",
        (F.col("start") + lead).alias("start"),
        (F.col("start") + lead + F.length(core)).alias("end"),
        "left",
        core.alias("found"),
    )
    every = base.union(tokens.where("start < end"))
    is_base = F.col("kind") < CONTEXT
    order = [F.col("start"), F.col("kind")]
    before = Window.partitionBy("rid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    after = (
        Window.partitionBy("rid")
        .orderBy(*[c.desc() for c in order])
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        every.withColumn("reached", F.max(F.when(is_base, F.col("end"))).over(before))
        .withColumn("next", F.min(F.when(is_base, F.col("start"))).over(after))
        .where(~is_base)
        .where("coalesce(reached <= start, true) and coalesce(next >= end, true)")
        .select("rid", "kind", "start", "end", "left", "found")
    )


def lexical(left: Column) -> Column:
    """A pattern from the left word: lower case, without punctuation around it; null if nothing
    with two letters is left or the word is an instance itself."""
    word = F.regexp_replace(F.lower(left), r"^[^\p{L}\p{N}]++|[^\p{L}\p{N}]++$", "")
    return F.when(word.rlike(r"^\D{2,}$"), word)


def accepted_patterns(
    base: DataFrame,
    tokens: DataFrame,
    rounds: int | None = None,
    threshold: float = THRESHOLD,
    seeds: int = SEEDS,
    prior: float = PRIOR,
) -> DataFrame:
    """(pattern) of the left words that are trusted after ``rounds`` rounds, or once a round adds none.

    Confidence only grows from round to round, so patterns only join and the rounds come to an end.

    ``base`` and ``tokens`` have (left, found). An instance counts once for each pattern, however
    often it occurs, so copies of a document lend no weight; what occurs as a seed is a seed.
    """
    instance = F.lower("found")
    rows = base.select(lexical(F.col("left")).alias("pattern"), instance.alias("instance"), F.lit(1).alias("seed"))
    rows = rows.union(
        tokens.select(lexical(F.col("left")).alias("pattern"), instance.alias("instance"), F.lit(0).alias("seed"))
    ).where("pattern is not null")
    graph = stage(rows.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "pii-graph")

    def score(confident: DataFrame) -> DataFrame:
        scored = confident.groupBy("pattern").agg(
            (F.sum("confidence") / (F.count("*") + F.lit(prior))).alias("score"),
            F.sum("seed").alias("seeds"),
        )
        return scored.where((F.col("score") >= threshold) & (F.col("seeds") >= seeds))

    known = stage(score(graph.withColumn("confidence", F.col("seed").cast("double"))), "pii-known")
    held, done = known.count(), 1
    while held and done != rounds:
        doubt = F.exp(F.sum(F.log1p(-F.least("score", F.lit(0.999)))))
        lent = graph.join(known, "pattern").groupBy("instance").agg((1 - doubt).alias("lent"))
        confident = graph.join(lent, "instance", "left").withColumn(
            "confidence",
            F.when(F.col("seed") == 1, 1.0).otherwise(F.coalesce("lent", F.lit(0.0))),
        )
        known = stage(score(confident), "pii-known")
        before, held, done = held, known.count(), done + 1
        if held == before:
            break
    return known.select("pattern")


def context_spans(base: DataFrame, tokens: DataFrame, **options) -> DataFrame:
    """The tokens whose left word is an accepted pattern."""
    patterns = stage(accepted_patterns(base, tokens, **options), "pii-patterns")
    return (
        tokens.withColumn("pattern", lexical(F.col("left")))
        .join(patterns, "pattern", "left_semi")
        .select("rid", "kind", "start", "end", "left", "found")
    )


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined; ``spans`` is a sorted array of (start, kind, end)."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ","
    )


def all_spans(read: DataFrame, **options) -> DataFrame:
    """(rid, kind, start, end) of every span, by the fixed patterns and by context."""
    rows = stage(located(read), "pii-located")
    base = base_spans(rows)
    tokens = stage(free_tokens(rows, base), "pii-tokens")
    found = base.union(context_spans(base, tokens, **options))
    return found.select("rid", "kind", "start", "end")


def per_text(found: DataFrame) -> DataFrame:
    """(rid, spans): for each text with any, the sorted array of (start, kind, end)."""
    return found.groupBy("rid").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans")
    )


def find_pii(df: DataFrame, **options) -> DataFrame:
    """One row per row of ``df(doc_id, text)``: n_email, n_ip, n_card, n_phone, base_sha256 (of the
    spans of the fixed patterns), n_context and spans, which adds those found by context.

    A null text counts as empty: no spans, and the hash of the empty string. Null and repeated ids
    are kept; each row is its own. ``options`` are those of :func:`accepted_patterns`.
    """
    read = read_texts(pick(df, "doc_id", "text"), "doc_id")
    found = per_text(all_spans(read, **options))
    spans = F.coalesce("spans", F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    base = F.filter(spans, lambda s: s["kind"] < CONTEXT)

    def count(kind: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return (
        read.select("rid", "doc_id")
        .join(found, "rid", "left")
        .select(
            "doc_id",
            *counts,
            F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
            written(spans).alias("spans"),
        )
    )


def merged(found: DataFrame) -> DataFrame:
    """Overlapping spans of a text joined; the first one's kind names the whole."""
    earlier = Window.partitionBy("rid").orderBy("start", "kind", "end")
    reached = F.max("end").over(earlier.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(reached <= F.col("start"), F.lit(True)).cast("int")
    island = F.sum("new").over(earlier.rowsBetween(Window.unboundedPreceding, 0))
    return (
        found.withColumn("new", new)
        .withColumn("island", island)
        .groupBy("rid", "island")
        .agg(
            F.min(F.struct("start", "kind")).alias("first"), F.max("end").alias("end")
        )
        .select("rid", "first.kind", "first.start", "end")
    )


def redact(df: DataFrame, **options) -> DataFrame:
    """``df`` with every span of its texts replaced by its kind in brackets, such as ``[email]``;
    an ``n_chars`` column follows the text, all else stays."""
    here = df.columns
    names = [f"_{i}" for i in range(len(here))]
    at = here.index("text")
    numbered = stage(
        df.toDF(*names).withColumn("rid", F.monotonically_increasing_id()), "pii-documents"
    )
    text = F.coalesce(F.col(f"_{at}"), F.lit(""))
    columns = [_matches(text, p).alias(f"m{k}") for k, p in enumerate(PATTERNS)]
    found = per_text(merged(all_spans(stage(numbered.select("rid", *columns), "pii"), **options)))
    spans, body = F.col("spans"), F.col(f"_{at}")
    kinds = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    pieces = F.transform(
        spans,
        lambda s, i: F.concat(
            F.substring(
                body,
                F.coalesce(F.get(spans, i - 1)["end"], F.lit(0)) + 1,
                s["start"] - F.coalesce(F.get(spans, i - 1)["end"], F.lit(0)),
            ),
            kinds[s["kind"]],
        ),
    )
    tail = F.substring(body, F.element_at(spans, -1)["end"] + 1, F.length(body))
    clean = F.when(spans.isNull(), body).otherwise(F.concat(F.array_join(pieces, ""), tail))
    # Texts that cannot hold a match are not shuffled.
    possible = text.rlike(ANY)
    out = numbered.where(possible).join(found, "rid", "left").withColumn(f"_{at}", clean)
    if "n_chars" in here:
        count = f"_{here.index('n_chars')}"
        own = F.when(spans.isNull(), F.col(count)).otherwise(F.length(f"_{at}"))
        out = out.withColumn(count, own.cast(df.schema["n_chars"].dataType))
    return out.select(*names).union(numbered.where(~possible).select(*names)).toDF(*here)
