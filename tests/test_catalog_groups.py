"""The catalog by sets of groups: the rows are those of plain code, and they are not shuffled."""

from __future__ import annotations

import fnmatch
import random
from collections import Counter

from pyspark.sql import functions as F

from servelens.operators import access

GRANT = "principal_type string, principal string, access string, resource_glob string"


def by_hand(users, catalog, adapters, loaded, grants):
    asked = {}
    for name, groups in users:
        asked.setdefault(name, set()).update({"*"}, {f"g:{g}" for g in groups or [] if g is not None})
        if name is not None:
            asked[name].add(f"u:{name}")

    def sees(name, what, need):
        held = (g for g in grants if g[2] == need)
        return what is not None and any(
            ("*" if p == "*" else f"{'g' if kind == 'group' else 'u'}:{p}") in asked[name]
            and fnmatch.fnmatchcase(what.lower(), glob.lower())
            for kind, p, _, glob in held
        )

    out = Counter()
    for u in asked:
        listed = {m for m in catalog if sees(u, m, "list")}
        out.update({(u, "model", m, None) for m in listed})
        out.update({(u, "loaded", m, None) for m in set(loaded) if sees(u, m, "metadata")})
        for base, adapter in adapters:
            full = "#".join(x for x in (base, adapter) if x is not None)
            if u is not None and base in listed and sees(u, full, "list"):
                out[u, "adapter", base, adapter] += 1
    return out


def test_rows_equal_plain_code(spark):
    """Users of several sets of groups, without a name or with two rows; patterns of every kind held by users, groups
    and all, so that base and adapter are seen by different grants; repeated and null adapters."""
    rng = random.Random(5)
    names = [f"{'Model' if k % 3 else 'm'}-{k}" for k in range(24)]
    users = [(f"u{k % 13}" if k % 9 else None, rng.choice([None, [], ["a"], ["b", "a"], ["a", None], ["c"]])) for k in range(40)]
    adapters = [(m, a) for m in names[::2] for a in ("x", "y", None)] + [(names[0], "x"), (None, "x"), ("gone", "x")]
    globs = ["*", "model-1*", "*-2?", "model-?", "*#x", "m-3#*", "MODEL-1", "m*l-2#y", "??del-4*", "m-0", "m-0#x", "%", "nothing"]
    grants = [(kind, who, need, rng.choice(globs[1:])) for kind, who in
              [("user", f"u{k}") for k in range(9)] * 2 + [("group", g) for g in "abcd"] * 2 + [("user", "*")]
              for need in ("list", "metadata", "infer")] + [("group", "c", "list", "*"), ("user", "u3", "list", "*")]
    loaded = names[::3] + [names[0], "other"]
    out = access.visible_catalog(
        spark.createDataFrame(users, "user_name string, groups array<string>"),
        spark.createDataFrame([(m,) for m in [*names, names[1], None]], "model string"),
        spark.createDataFrame(adapters, "base string, adapter string"),
        spark.createDataFrame([(m,) for m in loaded], "name string"), spark.createDataFrame(grants, GRANT),
    )
    want = by_hand(users, names, adapters, loaded, grants)
    assert Counter(map(tuple, out.collect())) == want
    assert len(want) > 300


def _written(plan) -> int:
    """Rows written by the shuffles of a plan that has run."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _written(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return _written(plan.plan())
    own = plan.metrics().apply("shuffleRecordsWritten").value() if name == "ShuffleExchangeExec" else 0
    children = plan.children()
    return own + sum(_written(children.apply(i)) for i in range(children.size()))


def test_what_users_see_is_not_shuffled(spark):
    n = F.col("id")
    name = F.concat(F.lit("model-"), n)
    users = spark.range(60).select(F.concat(F.lit("u"), n).alias("user_name"), F.array(F.lit("g")).alias("groups"))
    parts = spark.range(80)
    grants = parts.select(
        F.lit("group").alias("principal_type"), F.lit("g").alias("principal"),
        F.explode(F.array(F.lit("list"), F.lit("metadata"))).alias("access"), name.alias("resource_glob"),
    )
    out = access.visible_catalog(
        users, parts.select(name.alias("model")), parts.select(name.alias("base"), F.lit("a").alias("adapter")),
        parts.select(name.alias("name")), grants,
    )
    seen = out.collect()
    assert len(seen) == 60 * 80 * 2
    assert 0 < _written(out._jdf.queryExecution().executedPlan()) < len(seen) / 10
