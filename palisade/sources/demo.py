"""The demonstration batch as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palisade import fixed_values as fv


def demo_prompts(spark: SparkSession) -> DataFrame:
    """Nine prompts: prompt_id from 1, text."""
    return spark.createDataFrame(
        list(enumerate(fv.DEMO_PROMPTS, start=1)), "prompt_id long, text string"
    )


def demo_tool_blocks(spark: SparkSession, prompts: DataFrame) -> DataFrame:
    """The one malicious block, offered to every prompt; attach it by keyword."""
    block = [(0, fv.TOOL, fv.DEMO_TOOL_CONTENT, fv.DEMO_TOOL_SOURCE)]
    ids = prompts.select("prompt_id")
    fields = "pos int, trust_level string, content string, source string"
    one = spark.createDataFrame([(i, *block[0]) for i in range(1, len(fv.DEMO_PROMPTS) + 1)],
                                f"prompt_id long, {fields}")
    return one.join(ids, "prompt_id", "left_semi")


def demo_templates(spark: SparkSession) -> DataFrame:
    """Seven named templates with the expected verdict and their tool block."""
    rows = [
        (name, attack, text, [(fv.TOOL, fv.DEMO_TOOL_CONTENT, fv.DEMO_TOOL_SOURCE)]
         if name == "attack-indirect" else [])
        for name, attack, text in fv.DEMO_TEMPLATES
    ]
    return spark.createDataFrame(
        rows,
        "template string, is_attack boolean, text string, "
        "tool_context array<struct<trust_level:string,content:string,source:string>>",
    )
