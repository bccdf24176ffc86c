"""Access decisions over grant tables (principal, access, resource pattern)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from servelens.session import stage

EVERYONE = "*"
MODES = ("enforce", "off", "degraded_strict", "degraded_lenient")


def glob_to_like(glob: Column | str) -> Column:
    """``*`` and ``?`` wildcards, lower-cased, as a LIKE pattern with ``\\`` as escape."""
    g = F.lower(F.col(glob) if isinstance(glob, str) else glob)
    escaped = F.regexp_replace(g, r"([\\%_])", r"\\$1")
    return F.translate(escaped, "*?", "%_")


def principals(user: Column | str, groups: Column | str) -> Column:
    """Array of the principal keys a caller answers to."""
    u = F.col(user) if isinstance(user, str) else user
    g = F.col(groups) if isinstance(groups, str) else groups
    members = F.transform(
        F.coalesce(g, F.array().cast("array<string>")), lambda x: F.concat(F.lit("g:"), x)
    )
    return F.array_compact(F.concat(F.array(F.concat(F.lit("u:"), u), F.lit(EVERYONE)), members))


def keyed_grants(grants: DataFrame) -> DataFrame:
    """Grants with a principal key, a LIKE pattern and the literal prefix before any wildcard."""
    prefix = F.substring_index(F.substring_index(F.lower("resource_glob"), "*", 1), "?", 1)
    kind = F.when(F.col("principal_type") == "group", "g:").otherwise("u:")
    return grants.select(
        F.when(F.col("principal") == EVERYONE, EVERYONE)
        .otherwise(F.concat(kind, F.col("principal")))
        .alias("__p"),
        "access",
        prefix.alias("__prefix"),
        glob_to_like("resource_glob").alias("__like"),
    ).distinct()


def resource_prefixes(resource: Column | str) -> Column:
    """Every prefix of a resource name, so that patterns meet it in an equi-join."""
    r = F.lower(F.col(resource) if isinstance(resource, str) else resource)
    return F.transform(F.sequence(F.lit(0), F.length(r)), lambda n: F.substring(r, F.lit(1), n))


#: Length of the fragments by which a pattern that begins with a wildcard is found.
GRAM = 3
#: Marks a fragment, so that it isn't taken for a prefix.
INSIDE = "\x01"


def _grams(text: Column, size: int) -> Column:
    last = F.length(text) - size
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda n: F.substring(text, n + 1, F.lit(size)))


def indexed_grants(grants: DataFrame) -> DataFrame:
    """:func:`keyed_grants` where a pattern that begins with a wildcard has, in place of the empty prefix,
    its rarest fragment: of its literal parts' pieces of three characters (or two, or one, if it has
    no longer part) the one that fewest patterns share. Only patterns of nothing but wildcards keep the
    empty prefix.
    """
    rules = keyed_grants(grants)
    open_ = F.col("__prefix") == ""
    parts = F.filter(F.split(F.lower("resource_glob"), "[*?]"), lambda p: p != "")

    def pieces_of(size: int) -> Column:
        found = F.array_distinct(F.flatten(F.transform(parts, lambda p: _grams(p, size))))
        return F.when(F.size(found) > 0, found)

    pieces = F.coalesce(*[pieces_of(n) for n in range(GRAM, 0, -1)])
    patterns = (
        grants.select("resource_glob", glob_to_like("resource_glob").alias("__like"), pieces.alias("__pieces"))
        .where(F.substring("resource_glob", 1, 1).isin("*", "?"))
        .select("__like", F.explode("__pieces").alias("__piece"))
        .distinct()
    )
    shared = patterns.groupBy("__piece").agg(F.count(F.lit(1)).alias("__n"))
    rarest = (
        patterns.join(shared, "__piece")
        .groupBy("__like")
        .agg(F.min(F.struct("__n", "__piece")).alias("__best"))
        .select("__like", F.concat(F.lit(INSIDE), F.col("__best.__piece")).alias("__fragment"))
    )
    found = rules.join(rarest, "__like", "left")
    key = F.when(open_, F.coalesce("__fragment", F.lit(""))).otherwise(F.col("__prefix"))
    return found.select("__p", "access", key.alias("__prefix"), "__like")


def resource_keys(resource: Column | str) -> Column:
    """Every prefix of a resource name, and its fragments, so that patterns meet it in an equi-join."""
    r = F.lower(F.col(resource) if isinstance(resource, str) else resource)
    inside = [F.transform(_grams(r, n), lambda g: F.concat(F.lit(INSIDE), g)) for n in range(1, GRAM + 1)]
    return F.array_distinct(F.concat(resource_prefixes(r), *inside))


def granted(asks: DataFrame, grants: DataFrame, access: str) -> DataFrame:
    """The distinct (__p, __r) of ``asks(__p, __r)``, principal and resource, that a grant covers.

    A resource meets the principal's own patterns on their literal prefix, or on a rare fragment of
    those that begin with a wildcard, so no pattern is paired with a caller or name that doesn't ask
    for it.
    """
    rules = indexed_grants(grants).filter(F.col("access") == access).drop("access")
    return (
        asks.select("__p", "__r")
        .distinct()
        .withColumn("__prefix", F.explode(resource_keys("__r")))
        .join(rules, ["__p", "__prefix"])
        .filter(F.like(F.lower("__r"), F.col("__like")))
        .select("__p", "__r")
        .distinct()
    )


def evaluate_access(
    requests: DataFrame,
    grants: DataFrame | None,
    mode: str = "enforce",
    user: str = "user_name",
    groups: str = "groups",
    base: str = "base_model",
    lora: str = "lora",
    access: str = "infer",
    calls: DataFrame | None = None,
) -> DataFrame:
    """Add ``base_allowed`` and ``allowed``. An adapter call needs the base *and* ``base#lora``.
    ``calls`` has the same four columns for all requests, where those are costly to compute twice.

    ``off`` (no policy configured) and ``degraded_lenient`` allow all; ``degraded_strict``
    denies all. A grant for the principal ``*`` covers every caller.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}, expected one of {MODES}")
    full = F.concat_ws("#", F.col(base), F.col(lora))
    if mode != "enforce" or grants is None:
        verdict = F.lit(mode != "degraded_strict")
        return requests.withColumns({"base_allowed": verdict, "allowed": verdict})
    # Each distinct call is settled once, from what its principals may use of base and adapter.
    call = F.struct(user, groups, base, lora)
    settled = (requests if calls is None else calls).select(user, groups, base, lora).distinct()
    asks = (
        settled.select(
            call.alias("__call"),
            F.explode(principals(user, groups)).alias("__p"),
            F.col(base).alias("__base"),
            full.alias("__full"),
        )
        .withColumn("__r", F.explode(F.array_distinct(F.array("__base", "__full"))))
        .filter(F.col("__r").isNotNull())
    )
    hits = granted(asks, grants, access)
    verdicts = (
        asks.join(hits, ["__p", "__r"], "left_semi")
        .groupBy("__call")
        .agg(
            F.max(F.col("__r") == F.col("__base")).alias("__base_ok"),
            F.max(F.col("__r") == F.col("__full")).alias("__full_ok"),
        )
    )
    base_ok = F.coalesce("__base_ok", F.lit(False))
    full_ok = F.col(lora).isNull() | F.coalesce("__full_ok", F.lit(False))
    return (
        requests.withColumn("__call", call)
        .join(verdicts, "__call", "left")
        .withColumns({"base_allowed": base_ok, "allowed": base_ok & full_ok})
        .drop("__call", "__base_ok", "__full_ok")
    )


#: Users, and names, of a block: a block of either meets one of the other in one row.
BLOCK = 1000


def visible_catalog(
    users: DataFrame,
    catalog: DataFrame,
    adapters: DataFrame,
    loaded: DataFrame,
    grants: DataFrame,
    user: str = "user_name",
    groups: str = "groups",
) -> DataFrame:
    """Rows (user, kind, model, adapter) a user may see.

    ``kind`` is ``model`` (needs ``list``), ``adapter`` (base visible and ``list`` on
    ``base#adapter``) or ``loaded`` (needs ``metadata``). The output is users times what each may
    see. Users of the same groups see the same by them, so that is settled once for each set of groups; what a
    user's own grants add is told apart, and only blocks of users and of names are shuffled to meet.
    """
    models = catalog.select(F.col("model").alias("__name")).distinct()
    ready = loaded.select(F.col("name").alias("__name")).distinct()
    pairs = adapters.select(
        F.col("base").alias("__base"), "adapter", F.concat_ws("#", "base", "adapter").alias("__name")
    )
    names = models.union(ready).union(pairs.select("__name")).distinct()
    reach = stage(_reach(names, grants, ("list", "metadata")), "catalog-reach")
    everyone = users.select(user, groups).distinct()
    asked = everyone.select(F.col(user).alias("__user"), F.explode(principals(user, groups)).alias("__p"))
    own = F.startswith("__p", F.lit("u:"))

    # Sets of groups, and what each reaches. Null is a user, too.
    held = reach.where(~own).select("__p").distinct()
    members = (
        asked.where(~own).join(held, "__p", "left_semi")
        .groupBy("__user").agg(F.sort_array(F.collect_set("__p")).alias("__ps"))
    )
    members = stage(members, "catalog-members")
    teams = stage(
        members.select("__ps").distinct().withColumn("__team", F.monotonically_increasing_id()), "catalog-teams"
    )
    members = members.join(teams, "__ps").select("__user", "__team")
    shared = teams.select("__team", F.explode("__ps").alias("__p")).join(reach.hint("merge"), "__p")
    shared = stage(shared.select("__team", "access", "__name").distinct(), "catalog-shared")

    # What a user's own grants add to that. The joins on names are never broadcasts: files of names are
    # much smaller than the names.
    mine = asked.where(own).join(reach.where(own).hint("merge"), "__p").select("__user", "access", "__name").distinct()
    mine = mine.join(members, "__user", "left")
    more = stage(
        mine.join(shared.hint("merge"), ["__team", "access", "__name"], "left_anti"), "catalog-own"
    )

    def only(rows: DataFrame, access: str, among: DataFrame) -> DataFrame:
        return rows.where(F.col("access") == access).drop("access").join(among.hint("merge"), "__name", "left_semi")

    def base_of(rows: DataFrame, key: str) -> DataFrame:
        return rows.select(key, F.col("__name").alias("__base")).hint("merge")

    def paired(rows: DataFrame, on: str) -> DataFrame:
        return rows.where("access = 'list'").drop("access").join(pairs.hint("merge"), on)

    def rows_of(listed: DataFrame, both: DataFrame, ready: DataFrame, key: str) -> DataFrame:
        none = F.lit(None).cast(pairs.schema["adapter"].dataType).alias("adapter")
        parts = [
            (listed, "model", "__name", none), (both, "adapter", "__base", F.col("adapter")), (ready, "loaded", "__name", none)
        ]
        found = [
            df.select(key, F.lit(kind).alias("kind"), F.col(name).alias("__seen"), adapter)
            for df, kind, name, adapter in parts
        ]
        return found[0].unionByName(found[1]).unionByName(found[2])

    team_models, own_models = (only(rows, "list", models) for rows in (shared, more))
    team_both = paired(shared, "__name").join(base_of(team_models, "__team"), ["__team", "__base"], "left_semi")
    # An adapter is added where its name, its base or both are.
    named = paired(more, "__name")
    based = paired(own_models.withColumnRenamed("__name", "__base").withColumn("access", F.lit("list")), "__base")
    full = shared.where("access = 'list'").select("__team", "__name").hint("merge")
    own_both = (
        named.join(base_of(team_models, "__team"), ["__team", "__base"], "left_semi")
        .unionByName(named.join(base_of(own_models, "__user"), ["__user", "__base"], "left_semi"))
        .unionByName(based.join(full, ["__team", "__name"], "left_semi"))
    )
    by_team = rows_of(team_models, team_both, only(shared, "metadata", ready), "__team")
    by_user = rows_of(own_models, own_both, only(more, "metadata", ready), "__user")
    # An adapter needs a user with a name.
    found = _every_pair(members, by_team).where("__user is not null or kind != 'adapter'").unionByName(by_user)
    return found.select(F.col("__user").alias(user), "kind", F.col("__seen").alias("model"), "adapter")


def _every_pair(members: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every row of ``members(__user, __team)`` with every one of ``items(__team, ...)`` of its team.

    Arrays of about ``block`` rows meet, and each pair of arrays is unpacked where it is: the rows that come out are
    not shuffled, and a team with most of the users is in many tasks.
    """
    spark = members.sparkSession

    def blocks(rows: DataFrame, row: Column, out: str) -> DataFrame:
        rows = stage(rows, "catalog-pairs")
        sizes = rows.groupBy("__team").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("__blocks"))
        at = F.pmod(F.xxhash64(*[c for c in rows.columns if c != "__team"]), F.col("__blocks"))
        return (
            rows.join(sizes, "__team").groupBy("__team", at.alias("__at")).agg(F.collect_list(row).alias(out)).drop("__at")
        )

    kept = [c for c in items.columns if c != "__team"]
    users = blocks(members, F.struct("__user"), "__users")
    seen = blocks(items, F.struct(*kept), "__items")
    # As many tasks as the session's shuffles have: by their bytes the arrays would be left to a few.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return (
        users.join(seen.hint("merge"), "__team").select("__users", "__items").repartition(tasks)
        .select("__users", F.inline("__items"))
        .select(F.inline("__users"), *kept)
    )


def _reach(names: DataFrame, grants: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """The distinct (__p, access, __name): which of ``names(__name)`` a principal's own patterns cover."""
    rules = stage(indexed_grants(grants).where(F.col("access").isin(*kinds)), "catalog-rules")
    inside = F.startswith("__prefix", F.lit(INSIDE))
    shapes = rules.select(inside.alias("inside"), F.length("__prefix").alias("length")).distinct().collect()
    covers = (
        names.withColumn("__prefix", F.explode(_keys_of("__name", [(r.inside, r.length) for r in shapes])))
        # Names come many times over here, which no estimate of their size tells: never a broadcast.
        .join(rules.select("__prefix", "__like").distinct().hint("merge"), "__prefix")
        .filter(F.like(F.lower("__name"), F.col("__like")))
        .select("__like", "__name")
    )
    holders = rules.select("__p", "access", "__like").distinct()
    return holders.join(covers.hint("merge"), "__like").select("__p", "access", "__name").distinct()


def _keys_of(resource: str, shapes: list[tuple[bool, int]]) -> Column:
    """Those of :func:`resource_keys` that have the lengths of keys that there are."""
    r = F.lower(F.col(resource))
    lengths = F.array(*[F.lit(n) for inside, n in sorted(shapes) if not inside and n is not None]).cast("array<int>")
    fitting = F.filter(lengths, lambda n: n <= F.length(r))
    inside = [
        F.transform(_grams(r, n - len(INSIDE)), lambda g: F.concat(F.lit(INSIDE), g)) for inside, n in sorted(shapes) if inside
    ]
    return F.array_distinct(F.concat(F.transform(fitting, lambda n: F.substring(r, F.lit(1), n)), *inside))
