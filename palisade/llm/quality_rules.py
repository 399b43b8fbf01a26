"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger row holds what was
measured and one bit per failed rule, so that a policy (a named, versioned set
of rules) is a single bitwise AND, and changing a policy, comparing versions
or taking a rule out never reads a text again.

Only DataFrame functions are used.  A document is measured inside its own row,
without a shuffle; the higher-order functions hold a few copies of one text.

Null and empty texts have no words and fail ``too_few_words``.  Repeated rows
give repeated ledger rows.  Columns of the input other than the id and the
text are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.once import compute_once

#: ASCII white space, the only word border.
SPACE = "[ \\t\\n\\x0B\\f\\r]+"

#: Rule -> the condition under which it fails, over the measurements.  The
#: position is the bit; append only, since stored masks refer to it.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "too_many_symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "n_dup_lines >= 3 and 10 * n_dup_lines > 3 * n_lines",
    "shouting": "n_upper > 0.5 * word_chars",
    "long_words": "word_chars > 30 * n_words",
}

#: Version -> rules that reject.  Versions are never edited, only added.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": tuple(RULES),
}
DEFAULT_POLICY = "v1"


def policy_mask(policy: str) -> int:
    names = list(RULES)
    return sum(1 << names.index(rule) for rule in POLICIES[policy])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with the measurements.

    ``n_repeat_words`` counts the words inside three-word windows that the text
    has twice or more.  The windows are sorted with their positions; positions
    whose window equals a neighbour's are marked, and each marked position
    covers up to three words not covered by the one before.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    df = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"))
    df = compute_once(
        df,
        {
            "words": F.array_remove(F.split("text", SPACE), ""),
            "lines": F.filter(F.split("text", "\n"), lambda line: line.rlike("[^ \\t\\n\\x0B\\f\\r]")),
            "n_symbols": F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long"),
            "n_upper": F.length(F.regexp_replace("text", "[^\\p{Lu}]+", "")).cast("long"),
        },
    )
    window = lambda w, i: F.struct(
        F.concat_ws(" ", w, F.get("words", i + 1), F.get("words", i + 2)).alias("t"), i.alias("i")
    )
    df = compute_once(
        df.drop("text"),
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_lines": F.size("lines").cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "windows": F.sort_array(F.slice(F.transform("words", window), 1, F.greatest(F.size("words") - 2, F.lit(0)))),
        },
    ).drop("words", "lines")
    same = lambda w, j: F.get("windows", j)["t"] == w["t"]
    marked = F.filter(
        "windows",
        lambda w, j: F.coalesce(same(w, j - 1), F.lit(False)) | F.coalesce(same(w, j + 1), F.lit(False)),
    )
    df = compute_once(df, {"at": F.sort_array(F.transform(marked, lambda w: w["i"]))}).drop("windows")
    # The last marked window covers three words; each other one up to the next.
    steps = F.transform("at", lambda p, j: F.least(F.coalesce(F.get("at", j + 1) - p, F.lit(3)), F.lit(3)))
    covered = F.aggregate(steps, F.lit(0).cast("long"), lambda acc, s: acc + s)
    return df.withColumn("n_repeat_words", covered).drop("at")


def failures() -> Column:
    """The bit of every rule that fails, in one long."""
    bits = [F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)) for i, condition in enumerate(RULES.values())]
    mask = F.lit(0)
    for bit in bits:
        mask = mask.bitwiseOR(bit)
    return mask.cast("long")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and failure bits of every document, under no policy yet."""
    return measure(docs, id_col, text_col).withColumn("fail_mask", failures())


def apply_policy(rows: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """Add ``base_failed``, ``kept`` and the policy's name to ledger rows."""
    fails = lambda name: F.col("fail_mask").bitwiseAND(F.lit(policy_mask(name))) != 0
    return rows.select(
        "*",
        fails("base").alias("base_failed"),
        (~(fails("base") | fails(policy))).alias("kept"),
        F.lit(policy).alias("policy"),
    )


def ablation(rows: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """Per rule of a policy: documents it fails, fails alone, and kept without it.

    One pass over the masks; the result has a row per rule.
    """
    mask = policy_mask(policy)
    failed = F.col("fail_mask").bitwiseAND(F.lit(mask))
    names = list(RULES)
    counts = [F.count(F.lit(1)).alias("n_docs"), F.count_if(failed == 0).alias("n_kept")]
    for rule in POLICIES[policy]:
        bit = 1 << names.index(rule)
        counts += [F.count_if(failed.bitwiseAND(F.lit(bit)) != 0).alias(f"f_{rule}"), F.count_if(failed == bit).alias(f"a_{rule}")]
    per_rule = F.array(
        *[
            F.struct(
                F.lit(rule).alias("rule"),
                F.col(f"f_{rule}").alias("n_failed"),
                F.col(f"a_{rule}").alias("n_failed_alone"),
                (F.col("n_kept") + F.col(f"a_{rule}")).alias("n_kept_without"),
            )
            for rule in POLICIES[policy]
        ]
    )
    return rows.agg(*counts).select("n_docs", "n_kept", F.inline(per_rule))


def filter_documents(docs: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """The documents that a policy keeps, with all their columns and in one narrow stage."""
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    packed = docs.select(row.alias("doc_id"), F.col("text"))
    return apply_policy(ledger(packed), policy).filter("kept").select(*[F.col("doc_id")[c].alias(c) for c in names])
