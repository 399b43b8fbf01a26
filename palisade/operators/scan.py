"""The eight detectors, findings, blocking and cleaned text: one narrow stage."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade import fixed_values as fv
from palisade.functions import text as tx
from palisade.functions.once import compute_once

FINDING_TYPE = (
    "struct<rule_name:string,severity:string,matched_text:string,description:string>"
)

# Lower-case strings of which a text must hold at least one for the rule to
# match.  Plain substring search costs a tenth of the regular expression, and
# nearly all rows stop there.
_MUST_CONTAIN = {
    "override_instructions": ["ignore", "disregard", "forget", "override", "bypass"],
    "role_reassignment": ["you are now", "act as", "pretend to be", "pretend you are"],
    "system_prompt_exfiltration": [
        "system prompt", "initial instructions", "hidden prompt",
        "your instructions", "configuration",
    ],
    "delimiter_spoofing": ["system>", "|im_", "inst]", "<<sys>>", "<</sys>>", "###"],
    "hypothetical_framing": ["hypothetically"],
    "encoding_smuggling": ["\\u", "%"],
}


def _any_of(conditions: list[Column]) -> Column:
    return reduce(or_, conditions)


# Java's own \b counts joiners, combining marks and every connector as word
# characters; the rules mean letters, numbers and the underscore.
_WORD = r"[\p{L}\p{N}_]"
_WORD_BORDER = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def _java_pattern(rule: fv.Rule) -> str:
    # d: '.' stops at \n only; i and U: Unicode case folding and \s.
    flags = "" if rule.name in fv.CASE_SENSITIVE_RULES else "(?idU)"
    return flags + rule.pattern.replace(r"\b", _WORD_BORDER)


def _hit_column(rule_name: str) -> str:
    return f"__hit_{rule_name}"


def _matched_text(rule: fv.Rule, text: Column, lowered: Column, case_partner: Column) -> Column:
    """The first match of the rule, '' where there is none, null for null text."""
    if rule.name == "invisible_characters":
        return F.when(tx.has_format_chars(text), fv.INVISIBLE_MATCH_TEXT).when(
            text.isNotNull(), ""
        )
    if rule.name == "base64_payload":
        first = F.get(tx.base64_tokens(text), F.lit(0))
        return F.when(text.isNotNull(), F.coalesce(first, F.lit("")))
    possible = _any_of([F.contains(lowered, F.lit(s)) for s in _MUST_CONTAIN[rule.name]])
    if rule.name not in fv.CASE_SENSITIVE_RULES:
        possible = possible | case_partner
    return F.when(possible, F.regexp_extract(text, _java_pattern(rule), 0)).when(
        text.isNotNull(), ""
    )


def scan(
    df: DataFrame,
    text_col: str = "text",
    block_on_high: bool | Column = True,
    into: str = "sanitization",
) -> DataFrame:
    """Add a struct column with original_text, cleaned_text, blocked and findings.

    Rules read the raw text; cleaning comes after.  Null text gives a null
    struct.  No shuffle, no Python.  All rules are evaluated whichever fields are
    read; for the cleaned text alone use :func:`palisade.functions.text.clean`.
    """
    kept = [F.col(f"`{c}`") for c in df.columns]
    text = F.col(f"`{text_col}`")
    low = df.select(
        *kept,
        F.lower(text).alias("__lowered"),
        _any_of([F.contains(text, F.lit(c)) for c in fv.ASCII_CASE_PARTNERS]).alias("__partner"),
    )
    hits = compute_once(
        low,
        {
            _hit_column(rule.name): _matched_text(
                rule, text, F.col("__lowered"), F.col("__partner")
            )
            for rule in fv.RULES
        },
    )

    def finding(rule: fv.Rule) -> Column:
        matched = F.col(_hit_column(rule.name))
        return F.when(
            matched != "",
            F.struct(
                F.lit(rule.name).alias("rule_name"),
                F.lit(rule.severity).alias("severity"),
                matched.alias("matched_text"),
                F.lit(rule.description).alias("description"),
            ),
        )

    any_high = _any_of(
        [F.col(_hit_column(r.name)) != "" for r in fv.RULES if r.severity == fv.HIGH]
    )
    result = F.struct(
        text.alias("original_text"),
        tx.clean(text).alias("cleaned_text"),
        (tx.as_column(block_on_high) & any_high).alias("blocked"),
        F.array_compact(F.array(*[finding(rule) for rule in fv.RULES])).alias("findings"),
    )
    others = [F.col(f"`{c}`") for c in df.columns if c != into]
    return hits.select(*others, F.when(text.isNotNull(), result).alias(into))


def is_suspicious(sanitization: str = "sanitization") -> Column:
    findings = F.col(f"{sanitization}.findings")
    return F.when(findings.isNotNull(), F.size(findings) > 0)


def rule_names(sanitization: str = "sanitization") -> Column:
    return F.col(f"{sanitization}.findings.rule_name")
