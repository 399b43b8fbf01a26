"""The whole guard: scan, gate, score, gate, assemble, as DataFrame to DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade import fixed_values as fv
from palisade.functions.text import as_column, fixed_decimals, risk_band
from palisade.operators.encapsulate import assemble, attach_tool_blocks, prompt_segments, unprotected_prompt
from palisade.operators.intent_model import IntentModel
from palisade.operators.intent_score import intent, score
from palisade.operators.scan import is_suspicious, rule_names, scan
from palisade.session import materialise


@dataclass(frozen=True)
class GuardConfig:
    """Settings of a run.  Each may be a value or a column of the prompt table."""

    system_rules: str | Column = fv.DEFAULT_SYSTEM_RULES
    intent_threshold: float | Column = fv.DEFAULT_THRESHOLD
    block_on_sanitizer: bool | Column = True
    block_on_intent: bool | Column = True
    session_salt: str | None | Column = None

    @classmethod
    def from_columns(cls, salt: str | None | Column = None) -> "GuardConfig":
        """Settings carried by the rows, nulls replaced by the defaults."""
        return cls(
            F.coalesce(F.col("system_rules"), F.lit(fv.DEFAULT_SYSTEM_RULES)),
            F.coalesce(F.col("intent_threshold"), F.lit(fv.DEFAULT_THRESHOLD)),
            F.coalesce(F.col("block_on_sanitizer"), F.lit(True)),
            F.coalesce(F.col("block_on_intent"), F.lit(True)),
            salt,
        )


def join_config(prompts: DataFrame, config: DataFrame) -> DataFrame:
    """Attach each prompt's settings by ``config_id``; unknown ids keep the defaults.

    No broadcast hint: the optimizer broadcasts the settings while they are
    below its size threshold and otherwise splits hot ids by the adaptive skew
    join.
    """
    return prompts.join(config, "config_id", "left")


def decide(
    df: DataFrame,
    threshold: float | Column = fv.DEFAULT_THRESHOLD,
    block_on_intent: bool | Column = True,
    score_col: str = "__score",
) -> DataFrame:
    """Add intent, allowed and reason to scanned and scored rows.

    The score is null where the scan blocked; then intent is null too.  The
    intent is reported even where the flag keeps it from blocking.
    """
    blocked = F.col("sanitization.blocked")
    score_value = F.col(score_col)
    flagged = as_column(block_on_intent) & (score_value >= as_column(threshold))
    allowed = ~blocked & ~F.coalesce(flagged, F.lit(False))
    sanitizer_reason = F.concat(F.lit(fv.SANITIZER_REASON), F.array_join(rule_names(), ", "))
    before, after = fv.INTENT_REASON_FORMAT.split("%.2f")
    intent_reason = F.concat(F.lit(before), fixed_decimals(score_value, 2), F.lit(after))
    reason = F.when(blocked, sanitizer_reason).when(flagged, intent_reason)
    return df.select(
        "*",
        intent(score_value, threshold).alias("intent"),
        allowed.alias("allowed"),
        reason.alias("reason"),
    )


def judge(
    prompts: DataFrame,
    model: IntentModel,
    config: GuardConfig = GuardConfig(),
    text_col: str = "text",
    keys: list[str] | None = None,
) -> DataFrame:
    """Add sanitization, intent, allowed and reason.  Texts the scan blocked are not scored."""
    scanned = scan(prompts, text_col, config.block_on_sanitizer)
    scoreable = F.when(~F.col("sanitization.blocked"), F.col("sanitization.cleaned_text"))
    scored = score(scanned, model, scoreable, keys, into="__score")
    return decide(scored, config.intent_threshold, config.block_on_intent).drop("__score")


def _assembled(judged: DataFrame, config: GuardConfig, tool_context: str | None) -> DataFrame:
    return assemble(
        judged,
        user_text=F.col("sanitization.cleaned_text"),
        tool_context=tool_context,
        system_rules=config.system_rules,
        salt=config.session_salt,
        when=F.col("allowed"),
    )


def guard(
    prompts: DataFrame,
    model: IntentModel,
    config: GuardConfig = GuardConfig(),
    text_col: str = "text",
    tool_context: str | None = None,
    keys: list[str] | None = None,
) -> DataFrame:
    """Add sanitization, intent, allowed, reason, final_prompt and structured_messages.

    With tool blocks in an array column and a model in array form this is one
    stage without a shuffle.  ``keys`` that identify the rows save a model in join
    form a pass over the distinct texts.
    """
    return _assembled(judge(prompts, model, config, text_col, keys), config, tool_context)


def guard_with_blocks(
    prompts: DataFrame,
    tool_blocks: DataFrame,
    model: IntentModel,
    config: GuardConfig = GuardConfig(),
    key: str = "prompt_id",
    text_col: str = "text",
) -> DataFrame:
    """``guard`` with tool blocks from a table, which only allowed prompts receive.

    Prompts are judged first and the verdicts stored, so that nothing is scanned
    twice and the text of blocks that hang on blocked prompts never moves.
    """
    judged = materialise(judge(prompts, model, config, text_col, [key]), "judged")
    with_tools = attach_tool_blocks(judged, tool_blocks, key, only_where=F.col("allowed"))
    return _assembled(with_tools, config, "tool_context")


def guard_segments(
    prompts: DataFrame,
    tool_blocks: DataFrame,
    model: IntentModel,
    config: GuardConfig = GuardConfig(),
    key: str = "prompt_id",
    text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """The verdicts, and the prompts of the allowed rows as ordered segment rows.

    Nothing is grouped by prompt, so one with any amount of tool text is
    delivered whole.  The settings must be values, not columns.
    """
    judged = materialise(judge(prompts, model, config, text_col, [key]), "judged")
    allowed = judged.filter("allowed").select(key, F.col("sanitization.cleaned_text").alias("__cleaned"))
    return judged, prompt_segments(allowed, tool_blocks, key, "__cleaned", config.system_rules, config.session_salt)


def guard_requests(requests: DataFrame, model: IntentModel) -> DataFrame:
    """Guard a batch of requests, each row with its own settings and tool blocks.

    Rows with ``bypass_proxy`` are passed on with the unprotected prompt and are
    neither scanned nor scored.  Malformed requests are refused: not scanned, not
    allowed whatever they ask for, and without a prompt.
    """
    if "malformed" not in requests.columns:
        requests = requests.withColumn("malformed", F.lit(False))
    malformed = F.coalesce("malformed", F.lit(False))
    bypass = F.col("bypass_proxy") & ~malformed
    # A null text is neither scanned nor scored.
    staged = requests.withColumn("__guarded", F.when(~bypass & ~malformed, F.col("user_input")))
    guarded = guard(staged, model, GuardConfig.from_columns(), "__guarded", "tool_context")
    raw = unprotected_prompt(F.col("user_input"), F.col("tool_context"), F.col("system_rules"))
    untouched = F.struct(
        F.col("user_input").alias("original_text"),
        F.col("user_input").alias("cleaned_text"),
        F.lit(False).alias("blocked"),
        F.array().cast(guarded.schema["sanitization"].dataType["findings"].dataType).alias("findings"),
    )
    no_intent = F.struct(
        F.lit("bypassed").alias("label"),
        F.lit(0.0).alias("confidence"),
        F.lit(0.0).alias("adversarial_score"),
    )
    return guarded.select(
        *[F.col(f"`{c}`") for c in requests.columns],
        F.when(malformed, False).when(bypass, True).otherwise(F.col("allowed")).alias("allowed"),
        bypass.alias("bypass_active"),
        F.when(malformed, fv.MALFORMED_REASON).when(bypass, fv.BYPASS_REASON).otherwise(F.col("reason")).alias("reason"),
        F.when(bypass, untouched).otherwise(F.col("sanitization")).alias("sanitization"),
        F.when(bypass, no_intent).otherwise(F.col("intent")).alias("intent"),
        F.when(bypass, raw).otherwise(F.col("final_prompt")).alias("final_prompt"),
        "structured_messages",
    )


def stage_status(block_on_intent: bool | Column = True, bypass: bool | Column = False) -> Column:
    """Status of each layer of a guarded row, for display.

    sanitizer: passed, warned, blocked; intent: passed, blocked, disabled,
    pending (never reached); encapsulation: protected, aborted; delivery:
    completed, blocked.  A bypassed row has every layer bypassed; null for rows
    without text and for malformed requests.
    """
    blocked, allowed = F.col("sanitization.blocked"), F.col("allowed")
    bypassed, enabled = as_column(bypass), as_column(block_on_intent)

    def status(*cases: tuple[Column, str], otherwise: str) -> Column:
        out = F.when(bypassed, "bypassed")
        for condition, name in cases:
            out = out.when(condition, name)
        return out.otherwise(otherwise)

    sanitizer = status((blocked, "blocked"), (is_suspicious(), "warned"), otherwise="passed")
    layer3 = status((blocked, "pending"), (~enabled, "disabled"), (~allowed, "blocked"), otherwise="passed")
    encapsulation = status((allowed, "protected"), otherwise="aborted")
    delivery = F.when(bypassed | allowed, "completed").otherwise("blocked")
    # A request that was refused unread has reached no layer.
    return F.when(
        allowed.isNotNull() & F.col("sanitization").isNotNull(),
        F.struct(
            sanitizer.alias("sanitizer"),
            layer3.alias("intent"),
            encapsulation.alias("encapsulation"),
            delivery.alias("delivery"),
        ),
    )


def blocked_at() -> Column:
    """Label of the layer that blocked the row; null where it passed."""
    # A request that was refused unread has reached no layer.
    refused = ~F.col("allowed") & F.col("sanitization").isNotNull()
    return F.when(F.col("sanitization.blocked"), fv.LAYER1_LABEL).when(refused, fv.LAYER3_LABEL)


def intent_risk() -> Column:
    return risk_band(F.col("intent.adversarial_score"))
