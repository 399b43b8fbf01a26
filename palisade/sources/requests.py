"""Request batches and tool blocks as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade import fixed_values as fv
from palisade.functions.text import js_trim

REQUEST_FIELDS = (
    "system_rules string, user_input string, "
    "tool_context array<struct<source:string,content:string>>, "
    "intent_threshold double, block_on_sanitizer boolean, block_on_intent boolean, "
    "bypass_proxy boolean"
)

#: Where Spark's JSON parser leaves a body that it can't read.
_CORRUPT = "_corrupt_record"


def tool_context_of(raw: Column) -> Column:
    """Blocks with content, all at trust level tool."""
    with_content = F.filter(raw, lambda b: F.coalesce(b["content"], F.lit("")) != "")
    return F.transform(
        with_content,
        lambda b: F.struct(
            F.lit(fv.TOOL).alias("trust_level"),
            b["content"].alias("content"),
            b["source"].alias("source"),
        ),
    )


def with_request_defaults(requests: DataFrame) -> DataFrame:
    """Fill absent request fields; other columns are kept.

    A request whose body couldn't be read is ``malformed``: its fields get the
    defaults too, but the guard refuses it.
    """
    if "malformed" not in requests.columns:
        requests = requests.withColumn("malformed", F.lit(False))
    no_tools = F.array().cast("array<struct<source:string,content:string>>")
    return requests.withColumns(
        {
            "system_rules": F.coalesce("system_rules", F.lit(fv.DEFAULT_SYSTEM_RULES)),
            "user_input": F.coalesce("user_input", F.lit("")),
            "tool_context": tool_context_of(F.coalesce("tool_context", no_tools)),
            "intent_threshold": F.coalesce("intent_threshold", F.lit(fv.DEFAULT_THRESHOLD)),
            "block_on_sanitizer": F.coalesce("block_on_sanitizer", F.lit(True)),
            "block_on_intent": F.coalesce("block_on_intent", F.lit(True)),
            "bypass_proxy": F.coalesce("bypass_proxy", F.lit(False)),
        }
    )


def read_requests(spark: SparkSession, path: str, fmt: str = "json", key: str = "") -> DataFrame:
    """Read a request batch with an explicit schema.

    ``key`` declares further fields, such as ``"prompt_id long"``.  Broken JSON
    is marked ``malformed`` and kept in ``malformed_body``.
    """
    fields = f"{key}, {REQUEST_FIELDS}" if key else REQUEST_FIELDS
    if fmt != "json":
        return with_request_defaults(spark.read.schema(fields).format(fmt).load(path))
    reader = spark.read.schema(f"{fields}, {_CORRUPT} string").option("columnNameOfCorruptRecord", _CORRUPT)
    requests = reader.format(fmt).load(path).withColumnRenamed(_CORRUPT, "malformed_body")
    return with_request_defaults(requests.withColumn("malformed", F.col("malformed_body").isNotNull()))


def parse_requests(df: DataFrame, json_col: str) -> DataFrame:
    """Requests from a column of JSON text; other columns are kept.

    A missing body, broken JSON and JSON other than an object are ``malformed``;
    ``malformed_body`` keeps what was sent.
    """
    body = F.col(json_col)
    fields = f"{REQUEST_FIELDS}, {_CORRUPT} string"
    parsed = df.withColumn("__request", F.from_json(body, fields, {"columnNameOfCorruptRecord": _CORRUPT}))
    broken = F.col(f"__request.{_CORRUPT}").isNotNull() | F.col("__request").isNull() | ~F.coalesce(body.rlike(r"^\s*\{"), F.lit(False))
    others = [F.col(f"`{c}`") for c in df.columns if c != json_col]
    parsed = parsed.select(
        *others, "__request.*", broken.alias("malformed"), F.when(broken, body).alias("malformed_body")
    )
    return with_request_defaults(parsed.drop(_CORRUPT))


def drop_blank_prompts(prompts: DataFrame, text_col: str = "text") -> DataFrame:
    """Trim the prompts and drop those with nothing left."""
    return prompts.withColumn(text_col, js_trim(F.col(text_col))).filter(F.col(text_col) != "")


def trim_tool_blocks(blocks: DataFrame) -> DataFrame:
    """Trim content and source, drop blank blocks, name missing sources."""
    source = js_trim(F.col("source"))
    return blocks.withColumns(
        {
            "content": js_trim(F.col("content")),
            "source": F.coalesce(F.nullif(source, F.lit("")), F.lit(fv.UNSPECIFIED_SOURCE)),
        }
    ).filter(F.col("content") != "")


def as_tool_blocks(
    df: DataFrame, key: Column, pos: Column, content: Column, source: Column
) -> DataFrame:
    """Any text table as tool blocks (prompt_id, pos, trust_level, content, source)."""
    return df.select(
        key.alias("prompt_id"),
        pos.alias("pos"),
        F.lit(fv.TOOL).alias("trust_level"),
        content.alias("content"),
        source.alias("source"),
    ).filter(F.col("content") != "")
