"""Raw telemetry text to tables: service logs, metric scrapes, requests, model listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from servelens.functions.requests import (
    USAGE_BODY_LIMIT,
    is_container,
    json_kind,
    lenient_long,
    split_model_ref,
)

# The log core fields and the sample-line grammar.
LOG_CORE = ("ts", "level", "logger", "thread", "message")
LOG_OPTIONAL = ("exception", "stack")
METRIC_PATTERN = "^[a-zA-Z_:][a-zA-Z0-9_:]*$"
LABEL_PATTERN = r'([a-zA-Z_][a-zA-Z0-9_]*)="((?:[^"\\]|\\.)*)"'
# Parity grammar: one gpu label, digits, dots, "e" and "+" only.
STRICT_GPU_PATTERN = r'^(nv_gpu_[a-z_]+)\{gpu="(\d+)"\}\s+([\d.e+]+)'
ARCHIVE_SUFFIXES = (".tar.gz", ".tgz", ".zip")


def parse_service_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """One JSON object per line -> core columns, ``exception``, ``stack`` and ``mdc`` map.

    Lines that are not JSON objects give a row of nulls with ``raw`` set. Works on streams too.
    """
    doc = F.from_json(F.col(column), "map<string,string>")
    fixed = [*LOG_CORE, *LOG_OPTIONAL]
    parsed = lines.withColumn("__doc", doc)
    rest = F.map_filter("__doc", lambda k, _: ~k.isin(*fixed))
    return parsed.select(
        *[c for c in lines.columns if c != column],
        *[F.col("__doc")[f].alias(f) for f in fixed],
        rest.alias("mdc"),
        F.when(F.col("__doc").isNull(), F.col(column)).alias("raw"),
    )


def read_service_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return parse_service_log(reader.text(path))


def parse_exposition(
    scrapes: DataFrame, metrics: list[str] | None = None, strict: bool = False
) -> DataFrame:
    """Metric text -> one row per sample: metric, labelled, labels, value, value_text, line_no.

    Comments, blank and corrupt lines are skipped. ``metrics`` keeps lines that start with one of
    the given names before anything is parsed. ``strict`` accepts only the narrow GPU grammar.
    Labels cost the most; a query that does not read them does not pay for them.
    """
    others = [c for c in scrapes.columns if c != "body"]
    lines = scrapes.select(
        *others, F.posexplode(F.split("body", "\n")).alias("line_no", "line")
    ).filter((F.length("line") > 0) & ~F.startswith("line", F.lit("#")))
    if metrics:
        starts = F.lit(False)
        for m in metrics:
            starts = starts | F.startswith("line", F.lit(m))
        lines = lines.filter(starts)
    line = F.col("line")
    if strict:
        part = lambda i: F.regexp_extract(line, STRICT_GPU_PATTERN, i)
        return lines.filter(line.rlike(STRICT_GPU_PATTERN)).select(
            *others,
            "line_no",
            part(1).alias("metric"),
            F.lit(True).alias("labelled"),
            F.create_map(F.lit("gpu"), part(2)).alias("labels"),
            part(3).try_cast("double").alias("value"),
            part(3).alias("value_text"),
        ).filter(F.col("value").isNotNull())
    # The value follows the last brace, or the name when there are no labels; a time stamp may
    # follow the value.
    braced = F.contains(line, F.lit("{")) & F.contains(line, F.lit("}"))
    after = F.when(braced, F.substring_index(line, "}", -1)).otherwise(
        F.substring(line, F.length(F.substring_index(line, " ", 1)) + 1, F.length(line))
    )
    name = F.substring_index(F.substring_index(line, "{", 1), " ", 1)
    cut = lines.withColumns(
        {
            "metric": name,
            "labelled": braced,
            "value_text": F.substring_index(F.trim(F.translate(after, "\t\r", "  ")), " ", 1),
        }
    ).withColumn("value", F.col("value_text").try_cast("double"))
    opening = F.instr(line, "{")
    tail = F.length(F.substring_index(line, "}", -1))
    inner = F.substring(line, opening + 1, F.length(line) - tail - 1 - opening)
    found = lambda i: F.regexp_extract_all(F.col("__inner"), F.lit(LABEL_PATTERN), F.lit(i))
    names, values = F.col("__names"), F.transform("__values", _unescape_label)
    unique = F.size(F.array_distinct(names)) == F.size(names)
    return (
        cut.filter(F.col("value").isNotNull() & F.col("metric").rlike(METRIC_PATTERN))
        .withColumn("__inner", F.when(F.col("labelled"), inner))
        .withColumns({"__names": found(1), "__values": found(2)})
        .select(
            *others,
            "line_no",
            "metric",
            "labelled",
            F.when(F.col("labelled") & unique, F.map_from_arrays(names, values)).alias("labels"),
            "value",
            "value_text",
        )
    )


def _unescape_label(v: Column) -> Column:
    mark = F.lit("\u0000")
    out = F.replace(v, F.lit("\\\\"), mark)
    out = F.replace(F.replace(out, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n"))
    return F.replace(out, mark, F.lit("\\"))


# The JSON functions below add columns step by step: each parsed value is a column of its own, so
# a body is parsed once however many checks look at it, and the generated code stays small.


def accept_repeated_keys(spark: SparkSession) -> None:
    """Of a repeated key in a JSON body the last value counts, as most parsers have it."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def check_requests(df: DataFrame, method: str = "method", body: str = "body") -> DataFrame:
    """Add request_status, request_error, model and stream of an inference call.

    Not POST is 405, a body that is no JSON object or names no model is 400; both are null when
    the call may go on. ``stream`` is true only for JSON true.
    """
    accept_repeated_keys(df.sparkSession)
    steps = (
        df.withColumn("__doc", F.try_parse_json(body))
        .withColumns(
            {
                "__kind": json_kind("__doc"),
                "__m": F.try_variant_get("__doc", "$.model", "variant"),
                "__s": F.try_variant_get("__doc", "$.stream", "variant"),
            }
        )
        .withColumns(
            {
                "__model": F.when(
                    json_kind("__m") == "STRING", F.try_variant_get("__m", "$", "string")
                ),
                "__stream": F.when(
                    json_kind("__s") == "BOOLEAN", F.try_variant_get("__s", "$", "boolean")
                ),
            }
        )
        .withColumn(
            "request_error",
            F.when(F.upper(method) != "POST", "method_not_allowed")
            .when(
                F.col("__kind").isNull() | ~F.startswith("__kind", F.lit("OBJECT")), "invalid_json"
            )
            .when(F.coalesce(F.length("__model"), F.lit(0)) == 0, "missing_model"),
        )
    )
    error = F.col("request_error")
    return steps.withColumns(
        {
            "request_status": F.when(error == "method_not_allowed", 405).when(
                error.isNotNull(), 400
            ),
            "model": F.when(error.isNull(), F.col("__model")),
            "stream": F.coalesce("__stream", F.lit(False)),
        }
    ).drop("__doc", "__kind", "__m", "__s", "__model", "__stream")


def check_usage_reports(df: DataFrame, method: str = "method", body: str = "body") -> DataFrame:
    """Add usage_status, usage_error, usage_model and token counts of an out-of-band report.

    Not POST is 405; empty, broken or oversized JSON, a missing model or negative counts are 400.
    """
    accept_repeated_keys(df.sparkSession)
    steps = (
        df.withColumn("__doc", F.try_parse_json(body))
        .withColumns(
            {
                "__m": F.try_variant_get("__doc", "$.model", "variant"),
                "__p": lenient_long(F.try_variant_get("__doc", "$.prompt_tokens", "string")),
                "__c": lenient_long(F.try_variant_get("__doc", "$.completion_tokens", "string")),
            }
        )
        .withColumn(
            "__model",
            F.when(~is_container(json_kind("__m")), F.try_variant_get("__m", "$", "string")),
        )
        .withColumn(
            "usage_error",
            F.when(F.upper(method) != "POST", "method_not_allowed")
            .when(F.coalesce(F.octet_length(body), F.lit(0)) == 0, "empty_body")
            .when(
                F.col("__doc").isNull() | (F.octet_length(body) > USAGE_BODY_LIMIT), "invalid_json"
            )
            .when(F.coalesce(F.length("__model"), F.lit(0)) == 0, "missing_model")
            .when((F.col("__p") < 0) | (F.col("__c") < 0), "invalid_tokens"),
        )
    )
    error = F.col("usage_error")
    return steps.withColumns(
        {
            "usage_status": F.when(error == "method_not_allowed", 405)
            .when(error.isNotNull(), 400)
            .otherwise(200),
            "usage_model": F.when(error.isNull(), F.col("__model")),
            "prompt_tokens": F.when(error.isNull(), F.col("__p")),
            "completion_tokens": F.when(error.isNull(), F.col("__c")),
        }
    ).drop("__doc", "__m", "__p", "__c", "__model")


def read_response_usage(df: DataFrame, body: str = "response_body") -> DataFrame:
    """Add the token counts of a response's ``usage`` object, null where there is none."""
    usage = df.withColumn(
        "__u", F.try_variant_get(F.try_parse_json(body), "$.usage", "variant")
    ).withColumn("__has", F.startswith(json_kind("__u"), F.lit("OBJECT")))
    counts = {
        name: F.when(F.col("__has"), lenient_long(F.try_variant_get("__u", f"$.{name}", "string")))
        for name in ("prompt_tokens", "completion_tokens")
    }
    return usage.withColumns(counts).drop("__u", "__has")


def parse_requests(raw: DataFrame) -> DataFrame:
    """Raw calls (``method``, ``body``, ``response_body``) with model, stream, base_model, lora,
    body verdict and the response's token usage."""
    checked = check_requests(raw).withColumn("__ref", split_model_ref("model"))
    named = checked.withColumns(
        {"base_model": F.col("__ref.base"), "lora": F.col("__ref.lora")}
    ).drop("__ref")
    return read_response_usage(named)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modified) under a root; file contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path", "length", F.col("modificationTime").alias("modified"))
    )


def model_files(files: DataFrame, root: str) -> DataFrame:
    """Relative path below the root and the top-level model directory of each file.

    A root that is itself an archive is one entry named ``models`` of kind ``archive``.
    """
    archive = root.lower().endswith(ARCHIVE_SUFFIXES)
    base = root.rstrip("/")
    inside = F.substring_index(F.col("path"), base + "/", -1)
    others = [c for c in files.columns if c != "path"]
    if archive:
        return files.filter(F.endswith("path", F.lit(base))).select(
            "path", *others, F.lit("models").alias("relative"),
            F.lit(None).cast("string").alias("model"), F.lit("archive").alias("kind"),
        )
    in_root = files.filter(F.contains("path", F.lit(base + "/")))
    model = F.when(F.contains(inside, F.lit("/")), F.substring_index(inside, "/", 1))
    return in_root.select(
        "path", *others, F.concat(F.lit("models/"), inside).alias("relative"),
        model.alias("model"), F.lit("file").alias("kind"),
    )


def model_inventory(files: DataFrame, root: str) -> DataFrame:
    """Per top-level directory: number of files, bytes and newest modification."""
    return (
        model_files(files, root)
        .filter(F.col("model").isNotNull())
        .groupBy("model")
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.sum("length").alias("bytes"),
            F.max("modified").alias("modified"),
        )
    )


def loaded_models(index: DataFrame, column: str = "body") -> DataFrame:
    """JSON array of {name, version, state} per row, exploded; bad JSON keeps one empty row."""
    parsed = F.from_json(F.col(column), "array<struct<name:string,version:string,state:string>>")
    others = [c for c in index.columns if c != column]
    return index.select(*others, F.explode_outer(parsed).alias("m")).select(
        *others, "m.name", "m.version", "m.state"
    )


def load_adapters(docs: DataFrame, column: str = "doc") -> DataFrame:
    """``{base: [adapter, ...]}`` documents -> (base, adapter); unreadable ones give nothing."""
    parsed = F.from_json(F.col(column), "map<string,array<string>>")
    others = [c for c in docs.columns if c != column]
    return docs.select(*others, F.explode(parsed).alias("base", "__a")).select(
        *others, "base", F.explode("__a").alias("adapter")
    )
