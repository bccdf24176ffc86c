"""Policy and spec documents: quota rules with versions, deployments, configuration audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from servelens.functions.safety import safe_bind_address, safe_path

RULE_SCHEMA = (
    "rules array<struct<user:string,`group`:string,model:string,requestsPerMinute:string>>"
)
DEPLOYMENT_SCHEMA = """
  metadata struct<name:string,namespace:string,generation:bigint>,
  spec struct<
    image:string, modelRepository:string, replicas:int,
    tensorParallelism:int, pipelineParallelism:int,
    accelerator:struct<type:string,count:int,sliceSize:string>,
    resources:struct<memory:string,cpu:string>,
    openaiProxy:struct<enabled:boolean,port:int>,
    scaling:struct<mode:string,minReplicas:int,maxReplicas:int,
                   upThreshold:double,downThreshold:double>,
    ranger:struct<serviceName:string,strict:boolean>,
    quotasRef:struct<configMapName:string,key:string>,
    gateway:struct<enabled:boolean,hostnames:array<string>,
                   parentRefs:array<struct<name:string,namespace:string,sectionName:string>>>,
    env:array<struct<name:string,value:string>>,
    traffic:array<struct<name:string,weight:int,image:string,modelRepository:string>>>
"""
# Schema enumerations and patterns.
ACCELERATOR_ENUM = ("nvidia_gpu", "amd_gpu", "intel_gaudi", "aws_neuron", "cpu_only")
SCALING_ENUM = ("gpu_util", "queue_depth", "composite")
VARIANT_NAME_PATTERN = "^[a-z0-9]([-a-z0-9]{0,62}[a-z0-9])?$"
SLICE_PATTERN = r"^(\d+g\.\d+gb|0?\.\d+|1\.0)$"


def _empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def load_quota_rules(docs: DataFrame, column: str = "doc") -> DataFrame:
    """Explode ``{"rules": [...]}`` documents, most specific rule first (``rule_ord`` from 0).

    Defaults: model ``*``, rpm 0; negative rpm becomes 0; empty user or group is none. Other
    columns of ``docs`` are kept. The order is settled inside the document's array.
    """
    others = [c for c in docs.columns if c != column]

    def rule(r: Column, pos: Column) -> Column:
        user, group = _empty_to_null(r["user"]), _empty_to_null(r["group"])
        model = F.coalesce(_empty_to_null(r["model"]), F.lit("*"))
        number = F.coalesce(r["requestsPerMinute"].try_cast("double"), F.lit(0.0))
        rpm = F.greatest(F.lit(0), F.coalesce(number.try_cast("int"), F.lit(0)))
        weight = (
            F.when(user.isNotNull(), 4).otherwise(0)
            + F.when(group.isNotNull(), 2).otherwise(0)
            + F.when(model != "*", 1).otherwise(0)
        )
        return F.struct(
            (-weight).alias("rank"), pos.alias("pos"), user.alias("user"), group.alias("group"),
            model.alias("model"), rpm.alias("rpm"),
        )

    parsed = F.from_json(F.col(column), RULE_SCHEMA)["rules"]
    ordered = F.array_sort(F.transform(parsed, rule))
    return docs.select(*others, F.posexplode(ordered).alias("rule_ord", "r")).select(
        *others,
        "rule_ord",
        F.col("r.user").alias("rule_user"),
        F.col("r.group").alias("rule_group"),
        F.col("r.model").alias("rule_model"),
        F.col("r.rpm").alias("rpm"),
        (-F.col("r.rank")).alias("specificity"),
    )


def is_valid_document(col: Column | str) -> Column:
    """Syntactically valid, non-empty JSON."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce((F.length(c) > 0) & F.try_parse_json(c).isNotNull(), F.lit(False))


def valid_versions(docs: DataFrame, fallback: str | None = None) -> DataFrame:
    """Rule documents (version, valid_from_ms, doc) that took effect.

    A malformed document leaves the previous rules in force. An empty one reloads ``fallback``
    (the rules from configuration); without a fallback it changes nothing.
    """
    blank = F.coalesce(F.length("doc"), F.lit(0)) == 0
    effective = F.when(blank, F.lit(fallback).cast("string")).otherwise(F.col("doc"))
    return docs.withColumn("doc", effective).filter(is_valid_document("doc"))


def publish_rules(docs: DataFrame, path: str, column: str = "doc") -> None:
    """Append valid rule documents to the version table; empty or broken ones are refused."""
    docs.filter(is_valid_document(column)).write.mode("append").parquet(path)


def read_deployments(docs: DataFrame, column: str = "doc") -> DataFrame:
    """Deployment documents with every declared default filled in."""
    others = [c for c in docs.columns if c != column]
    spec = lambda path: F.col(f"__d.spec.{path}")

    def default(path: str, value) -> Column:
        return F.coalesce(spec(path), F.lit(value))

    return docs.withColumn("__d", F.from_json(F.col(column), DEPLOYMENT_SCHEMA)).select(
        *others,
        F.col("__d.metadata.name").alias("name"),
        F.coalesce("__d.metadata.namespace", F.lit("default")).alias("namespace"),
        F.col("__d.metadata.generation").alias("generation"),
        spec("image").alias("image"),
        spec("modelRepository").alias("model_repository"),
        default("replicas", 1).alias("replicas"),
        default("tensorParallelism", 1).alias("tensor_parallelism"),
        default("pipelineParallelism", 1).alias("pipeline_parallelism"),
        default("accelerator.type", "nvidia_gpu").alias("accelerator_type"),
        default("accelerator.count", 1).alias("accelerator_count"),
        spec("accelerator.sliceSize").alias("slice_size"),
        default("resources.memory", "4Gi").alias("memory"),
        default("resources.cpu", "2").alias("cpu"),
        default("openaiProxy.enabled", False).alias("proxy_enabled"),
        default("openaiProxy.port", 9000).alias("proxy_port"),
        default("scaling.mode", "composite").alias("scaling_mode"),
        default("scaling.minReplicas", 1).alias("min_replicas"),
        default("scaling.maxReplicas", 10).alias("max_replicas"),
        default("scaling.upThreshold", 0.7).alias("up_threshold"),
        default("scaling.downThreshold", 0.2).alias("down_threshold"),
        spec("ranger.serviceName").alias("ranger_service"),
        default("ranger.strict", True).alias("ranger_strict"),
        spec("quotasRef.configMapName").alias("quotas_config_map"),
        default("quotasRef.key", "quotas.json").alias("quotas_key"),
        default("gateway.enabled", False).alias("gateway_enabled"),
        _env(spec("env")).alias("env"),
        F.coalesce(
            F.transform(
                spec("traffic"),
                lambda v: F.struct(
                    v["name"].alias("name"), v["weight"].alias("weight"),
                    v["image"].alias("image"), v["modelRepository"].alias("model_repository"),
                ),
            ),
            F.array().cast(
                "array<struct<name:string,weight:int,image:string,model_repository:string>>"
            ),
        ).alias("traffic"),
    )


def _env(entries: Column) -> Column:
    """Name to value; of a repeated name the last value counts."""
    named = F.coalesce(
        F.filter(entries, lambda e: e["name"].isNotNull()),
        F.array().cast("array<struct<name:string,value:string>>"),
    )
    names = F.array_distinct(F.transform(named, lambda e: e["name"]))
    last = F.transform(
        names, lambda n: F.element_at(F.filter(named, lambda e: e["name"] == n), -1)["value"]
    )
    return F.map_from_arrays(names, last)


def _explode_broken(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """One row per rule whose condition is true; null conditions count as kept."""
    broken = F.filter(
        F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]),
        lambda x: x.isNotNull(),
    )
    return df.select(key, F.explode(broken).alias("violation"))


def _port_bad(name: str) -> Column:
    return (F.col(name) <= 0) | (F.col(name) > 65535)


def audit_launcher_configs(configs: DataFrame, key: str = "config_id") -> DataFrame:
    """All broken launcher settings, one row each.

    Columns: model_repository, secrets_path, bind_address, http/grpc/metrics/admin_port,
    min/max_containers, scale_up/down_threshold, tls_enabled, tls_keystore, proxy_enabled,
    proxy_port, slice_size, shadow_rate, shadow_endpoint.
    """
    blank = lambda c: F.coalesce(F.length(c), F.lit(0)) == 0
    up, down = F.col("scale_up_threshold"), F.col("scale_down_threshold")
    rules = {
        "model_repository": ~safe_path("model_repository"),
        "secrets_path": ~safe_path("secrets_path"),
        "bind_address": ~safe_bind_address("bind_address"),
        "http_port": _port_bad("http_port"),
        "grpc_port": _port_bad("grpc_port"),
        "metrics_port": _port_bad("metrics_port"),
        "admin_port": _port_bad("admin_port"),
        "min_containers": F.col("min_containers") < 0,
        "max_containers": F.col("max_containers") < F.col("min_containers"),
        "scale_up_threshold": (up <= 0) | (up > 1),
        "scale_down_threshold": (down < 0) | (down >= up),
        "tls_keystore": F.col("tls_enabled") & blank("tls_keystore"),
        "proxy_port": F.col("proxy_enabled") & _port_bad("proxy_port"),
        "proxy_port_clash": F.col("proxy_enabled") & (F.col("proxy_port") == F.col("admin_port")),
        "slice_size": ~blank("slice_size") & ~F.col("slice_size").rlike(SLICE_PATTERN),
        "shadow_rate": (F.col("shadow_rate") < 0) | (F.col("shadow_rate") > 1),
        "shadow_endpoint": (F.col("shadow_rate") > 0) & blank("shadow_endpoint"),
    }
    return _explode_broken(configs, key, rules)


def audit_deployments(deployments: DataFrame, key: str = "name") -> DataFrame:
    """All broken rules of deployment specs (as read, with defaults), one row each."""
    blank = lambda c: F.coalesce(F.length(c), F.lit(0)) == 0
    rules = {
        "image_required": blank("image"),
        "model_repository_required": blank("model_repository"),
        "replicas_minimum": F.col("replicas") < 0,
        "tensor_parallelism_minimum": F.col("tensor_parallelism") < 1,
        "pipeline_parallelism_minimum": F.col("pipeline_parallelism") < 1,
        "accelerator_type_enum": ~F.col("accelerator_type").isin(*ACCELERATOR_ENUM),
        "accelerator_count_minimum": F.col("accelerator_count") < 0,
        "scaling_mode_enum": ~F.col("scaling_mode").isin(*SCALING_ENUM),
        "min_replicas_minimum": F.col("min_replicas") < 0,
        "max_replicas_minimum": F.col("max_replicas") < 1,
        "variant_name": F.exists(
            "traffic",
            lambda v: ~F.coalesce(v["name"].rlike(VARIANT_NAME_PATTERN), F.lit(False)),
        ),
        "variant_weight": F.exists(
            "traffic", lambda v: F.coalesce(v["weight"], F.lit(-1)) < 0
        ),
    }
    return _explode_broken(deployments, key, rules)
