"""Request-level columns: model references, identity, addresses, endpoints, bodies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ADAPTER_SEPARATOR = "#"
USAGE_BODY_LIMIT = 16 * 1024


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def trim_control(col: Column | str) -> Column:
    """Strip leading and trailing characters up to U+0020, not only spaces."""
    return F.regexp_replace(_c(col), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def split_model_ref(col: Column | str) -> Column:
    """``base#lora`` -> struct(base, lora); a separator at either end does not split."""
    ref = _c(col)
    pos = F.instr(ref, ADAPTER_SEPARATOR)
    splits = (pos > 1) & (pos < F.length(ref))
    return F.struct(
        F.when(splits, F.substring(ref, F.lit(1), pos - 1)).otherwise(ref).alias("base"),
        F.when(splits, F.substring(ref, pos + 1, F.length(ref))).alias("lora"),
    )


def header(headers: Column | str, name: str) -> Column:
    """Case-insensitive header lookup, null when absent."""
    wanted = name.lower()
    return F.get(
        F.map_values(F.map_filter(_c(headers), lambda k, _: F.lower(k) == wanted)), F.lit(0)
    )


def resolve_user(
    headers: Column | str,
    principal: Column | str,
    primary: str = "X-Forwarded-User",
    fallback: str = "X-Auth-User",
) -> Column:
    """Primary header, else fallback header *only if the primary is absent*, else principal.

    An empty primary header is present, so it hides the fallback and yields the principal.
    """
    claimed = F.coalesce(header(headers, primary), header(headers, fallback))
    return F.coalesce(F.nullif(claimed, F.lit("")), _c(principal), F.lit("anonymous"))


def resolve_direct_user(
    headers: Column | str, principal: Column | str, name: str = "X-Auth-User"
) -> Column:
    """Admin-side identity: one header, else principal."""
    return F.coalesce(
        F.nullif(header(headers, name), F.lit("")), _c(principal), F.lit("anonymous")
    )


def resolve_client_ip(headers: Column | str, peer: Column | str) -> Column:
    """First ``X-Forwarded-For`` element, else the peer; blank becomes ``unknown``."""
    xff = header(headers, "X-Forwarded-For")
    comma = F.instr(xff, ",")
    first = F.when(comma > 1, F.substring(xff, F.lit(1), comma - 1)).otherwise(xff)
    chosen = F.when(F.length(xff) > 0, trim_control(first)).otherwise(_c(peer))
    return F.coalesce(F.nullif(chosen, F.lit("")), F.lit("unknown"))


def classify_endpoint(path: Column | str) -> Column:
    p = _c(path)
    inference = (
        p.endswith("/chat/completions") | p.endswith("/completions") | p.endswith("/embeddings")
    )
    return (
        F.when(p.endswith("/models"), "models")
        .when(inference, "inference")
        .when(p.endswith("/usage"), "usage")
        .otherwise("not_found")
    )


def json_kind(value: Column | str) -> Column:
    """Type name of a variant value: STRING, BOOLEAN, OBJECT<...>, ...; null for a missing one."""
    return F.schema_of_variant(_c(value))


def is_container(kind: Column | str) -> Column:
    k = _c(kind)
    return F.startswith(k, F.lit("OBJECT")) | F.startswith(k, F.lit("ARRAY"))


def lenient_long(value: Column | str) -> Column:
    """Integer reading of a JSON scalar held as text: decimals truncate, booleans are 0/1, else 0."""
    text = _c(value)
    return F.coalesce(
        text.try_cast("bigint"),
        text.try_cast("double").try_cast("bigint"),
        F.when(text == "true", 1).cast("bigint"),
        F.lit(0).cast("bigint"),
    )


def safe_key(col: Column | str) -> Column:
    """Counter-key part: null becomes ``unknown`` and ``|`` becomes ``_``."""
    return F.coalesce(F.replace(_c(col), F.lit("|"), F.lit("_")), F.lit("unknown"))


def retry_after_sec(ms: Column | str) -> Column:
    wait = _c(ms).cast("bigint")
    return F.greatest(F.lit(1).cast("bigint"), F.floor((wait + 999) / 1000))


def sample_fraction(request_id: Column | str, rate: float, endpoint: str | None) -> Column:
    """Deterministic Bernoulli filter on a hash of the id, the same in any engine that has MD5; no
    endpoint or a rate of zero keeps nothing."""
    if not endpoint or rate <= 0:
        return F.lit(False)
    if rate >= 1:
        return F.lit(True)
    first = F.left(F.md5(_c(request_id).cast("string").cast("binary")), F.lit(8))
    return F.coalesce(first < F.lit(format(int(rate * (1 << 32)), "08x")), F.lit(False))
