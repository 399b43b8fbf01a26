"""Audit of assembled prompts: protected by boundary tags, or open to which attack."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade import fixed_values as fv


def is_protected(prompt: Column) -> Column:
    return reduce(or_, [F.contains(prompt, F.lit(m)) for m in fv.PROTECTION_MARKS])


def exposure_class(prompt: Column) -> Column:
    """protected, override, jailbreak, data_leak or none; the first that holds.

    Words are plain substrings of the lower-cased prompt.
    """
    lowered = F.lower(prompt)

    def found(words: list[str]) -> list[Column]:
        return [F.contains(lowered, F.lit(w)) for w in words]

    return (
        F.when(is_protected(prompt), "protected")
        .when(reduce(and_, found(fv.OVERRIDE_WORDS)), "override")
        .when(reduce(or_, found(fv.JAILBREAK_WORDS)), "jailbreak")
        .when(reduce(or_, found(fv.LEAK_PHRASES)), "data_leak")
        .when(prompt.isNotNull(), "none")
    )


def exposure_audit(
    prompts: DataFrame, prompt_col: str = "final_prompt", by: list[str] | None = None
) -> DataFrame:
    """Number of prompts per exposure class and group."""
    return (
        prompts.select(*(by or []), exposure_class(F.col(prompt_col)).alias("exposure"))
        .groupBy(*(by or []), "exposure")
        .agg(F.count("*").alias("n"))
    )
