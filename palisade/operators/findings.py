"""Findings in long form, summaries and the quarantine split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade import fixed_values as fv
from palisade.functions.text import html_escape
from palisade.operators.scan import is_suspicious, rule_names


def explode_findings(scanned: DataFrame, keys: list[str]) -> DataFrame:
    """One row per finding, numbered in report order."""
    return scanned.select(
        *keys, F.posexplode("sanitization.findings").alias("finding_ord", "f")
    ).select(*keys, "finding_ord", "f.rule_name", "f.severity", "f.matched_text", "f.description")


def findings_report(scanned: DataFrame, keys: list[str]) -> DataFrame:
    """Long form with the matched text escaped for an HTML table."""
    return explode_findings(scanned, keys).withColumn(
        "matched_html", html_escape(F.col("matched_text"))
    )


def findings_summary(scanned: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts per rule, per severity and in total, with zero counts kept.

    ``n_findings`` counts findings and ``n_rows`` the texts they occur in.  A
    rule reports at most once per text, so both come from conditional sums in
    one pass: no explode and no distinct count, and the shuffle carries one row
    per task and group however the hits are spread.
    """
    by = by or []
    names = F.coalesce(rule_names(), F.array().cast("array<string>"))

    def hit(rule: fv.Rule) -> Column:
        return F.array_contains(F.col("__names"), rule.name)

    def any_hit(rules: list[fv.Rule]) -> Column:
        out = F.lit(False)
        for rule in rules:
            out = out | hit(rule)
        return out

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(condition.cast("long")), F.lit(0))

    severities = [s for s in (fv.HIGH, fv.MEDIUM) if any(r.severity == s for r in fv.RULES)]
    lines = []  # severity, rule, findings, rows
    for rule in fv.RULES:
        lines.append((rule.severity, rule.name, total(hit(rule)), total(hit(rule))))
    for severity in severities:
        members = [r for r in fv.RULES if r.severity == severity]
        findings = sum((hit(r).cast("long") for r in members), F.lit(0))
        lines.append((severity, None, F.coalesce(F.sum(findings), F.lit(0)), total(any_hit(members))))
    lines.append(
        (
            None,
            None,
            F.coalesce(F.sum(F.size("__names").cast("long")), F.lit(0)),
            total(F.size("__names") > 0),
        )
    )

    sums = (
        scanned.select(*by, names.alias("__names"))
        .groupBy(*by)
        .agg(
            *[f.alias(f"f{i}") for i, (_, _, f, _) in enumerate(lines)],
            *[r.alias(f"r{i}") for i, (_, _, _, r) in enumerate(lines)],
        )
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(severity).cast("string").alias("severity"),
                F.lit(rule).cast("string").alias("rule_name"),
                F.col(f"f{i}").alias("n_findings"),
                F.col(f"r{i}").alias("n_rows"),
            )
            for i, (severity, rule, _, _) in enumerate(lines)
        ]
    )
    return sums.select(*by, F.inline(entries))


def with_rule_attributes(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Attach rule order and description; every rule is kept, hit or not."""
    return rules.join(findings, "rule_name", "left")


def quarantine_split(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without findings, and rows with at least one."""
    suspicious = is_suspicious()
    return scanned.filter(~suspicious), scanned.filter(suspicious)
