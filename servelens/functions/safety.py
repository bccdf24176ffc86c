"""Input hygiene columns: hosts, paths, secrets, query strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns and limits.
HOST_LABEL = "[a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
HOST_PATTERN = f"^{HOST_LABEL}(\\.{HOST_LABEL})*$"
UNSAFE_PATH_PATTERN = "[\\s;&|`$()<>\"'\\\\*?]"
BIND_ADDRESS_PATTERN = "^[a-zA-Z0-9.\\-:]+$"
SENSITIVE_KEY_PATTERN = "(?i)(KEY|TOKEN|PASSWORD|SECRET|CREDENTIAL|PASSPHRASE|AUTH)"
REDACTED = "***REDACTED***"
MAX_HOST_LENGTH = 253
MAX_QUERY_LENGTH = 4096


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _ipv4_value(host: Column) -> Column:
    """32-bit value of a numeric address with one to four parts, null if out of range.

    With fewer than four parts the last one fills the remaining bytes.
    """
    numbers = F.transform(F.split(host, "\\."), lambda p: p.try_cast("bigint"))
    count = F.size(numbers)
    lead, last = F.slice(numbers, F.lit(1), count - 1), F.element_at(numbers, -1)
    head = F.aggregate(
        lead, F.lit(0).cast("bigint"), lambda acc, p: F.when(p.between(0, 255), acc * 256 + p)
    )
    room = F.pow(F.lit(256), 5 - count).cast("bigint")
    return F.when((count <= 4) & (last >= 0) & (last < room), head * room + last)


def _public_ipv4(value: Column) -> Column:
    """Neither loopback, link-local, any-local nor multicast; false for no address at all."""
    first = F.shiftright(value, 24)
    blocked = (
        (first == 127)
        | (F.shiftright(value, 16) == 169 * 256 + 254)
        | (value == 0)
        | first.between(224, 239)
    )
    return F.coalesce(~blocked, F.lit(False))


def safe_host(col: Column | str) -> Column:
    """Host syntax plus literal-address rules; name resolution is not part of it."""
    host = _c(col)
    # One-element transform: the address is computed once for all the range checks.
    numeric_ok = F.get(F.transform(F.array(_ipv4_value(host)), _public_ipv4), F.lit(0))
    syntax = (
        (F.length(host) > 0)
        & (F.length(host) <= MAX_HOST_LENGTH)
        & ~F.contains(host, F.lit(".."))
        & host.rlike(HOST_PATTERN)
    )
    named_ok = F.lower(host) != "localhost"
    verdict = syntax & F.when(host.rlike("^[0-9.]+$"), numeric_ok).otherwise(named_ok)
    return F.coalesce(verdict, F.lit(False))


def safe_path(col: Column | str) -> Column:
    path = _c(col)
    empty = path.isNull() | (F.length(path) == 0)
    return empty | (
        ~path.rlike(UNSAFE_PATH_PATTERN) & (path.startswith("hdfs://") | path.startswith("/"))
    )


def safe_bind_address(col: Column | str) -> Column:
    address = _c(col)
    return address.isNull() | address.rlike(BIND_ADDRESS_PATTERN)


def repository_kind(uri: Column | str) -> Column:
    """Where a server started with this repository setting looks for models."""
    u = _c(uri)
    return (
        F.when(u.startswith("hdfs://"), "./models")
        .when(u.startswith("/"), u)
        .otherwise("/models")
    )


def redact_value(key: Column | str, value: Column | str) -> Column:
    k = _c(key)
    return F.when(k.rlike(SENSITIVE_KEY_PATTERN), REDACTED).otherwise(_c(value))


def redact(env: Column | str) -> Column:
    return F.transform_values(_c(env), redact_value)


def parse_query(col: Column | str) -> Column:
    """Query string -> map. The last of several equal keys wins; bad escapes stay raw."""
    query = _c(col)

    def decoded(raw: Column) -> Column:
        return F.coalesce(F.try_url_decode(raw), raw)

    usable = F.filter(
        F.split(query, "&"),
        lambda p: (F.instr(p, "=") > 1) & (F.instr(p, "=") < F.length(p)),
    )
    pairs = F.transform(
        usable,
        lambda p: F.struct(
            decoded(F.substring_index(p, "=", 1)).alias("key"),
            decoded(F.substring(p, F.instr(p, "=") + 1, F.length(p))).alias("value"),
        ),
    )
    empty = F.expr("map_from_arrays(cast(array() as array<string>), cast(array() as array<string>))")
    merged = F.aggregate(
        pairs,
        empty,
        lambda acc, p: F.map_concat(
            F.map_filter(acc, lambda k, _: k != p["key"]), F.create_map(p["key"], p["value"])
        ),
    )
    return F.when(query.isNull() | (F.length(query) > MAX_QUERY_LENGTH), empty).otherwise(merged)
