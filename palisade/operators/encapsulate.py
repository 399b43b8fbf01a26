"""Prompt assembly: tool blocks joined to prompts, tagged and concatenated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade import fixed_values as fv
from palisade.functions import boundary as bd
from palisade.functions.text import as_column


def collect_tool_blocks(tool_blocks: DataFrame, key: str = "prompt_id") -> DataFrame:
    """One row per key with its blocks as an array in ``pos`` order.

    A key's blocks meet in one row here, as they must where a prompt is one string;
    ``prompt_segments``, ``bypass_segments`` and ``message_segments`` have no such row.
    """
    block = F.struct("pos", "trust_level", "content", "source")
    ordered = F.array_sort(F.collect_list(block))
    return tool_blocks.groupBy(key).agg(
        F.transform(
            ordered,
            lambda b: F.struct(
                b["trust_level"].alias("trust_level"),
                b["content"].alias("content"),
                b["source"].alias("source"),
            ),
        ).alias("tool_context")
    )


def attach_tool_blocks(
    prompts: DataFrame,
    tool_blocks: DataFrame,
    key: str = "prompt_id",
    only_where: Column | None = None,
) -> DataFrame:
    """Left join of prompts and their ordered tool blocks, as the array ``tool_context``.

    ``only_where`` limits which prompts receive blocks; it is a condition of the
    join, since a null key for the others would gather them all in one partition.
    Blocks that no prompt receives are dropped before any is collected.
    """
    wanted = F.lit(True) if only_where is None else only_where
    tool_blocks = tool_blocks.join(prompts.filter(wanted).select(key), key, "left_semi")
    contexts = collect_tool_blocks(tool_blocks, key).withColumnRenamed(key, "__tool_key")
    joined = prompts.join(contexts, (F.col(key) == F.col("__tool_key")) & wanted, "left")
    return joined.drop("__tool_key")


def attach_where_contains(
    prompts: DataFrame,
    tool_blocks: DataFrame,
    keyword: str = fv.TOOL_KEYWORD,
    key: str = "prompt_id",
    text_col: str = "text",
) -> DataFrame:
    """Attach blocks only to prompts whose lower-cased text contains ``keyword``."""
    wanted = F.contains(F.lower(F.col(text_col)), F.lit(keyword))
    return attach_tool_blocks(prompts, tool_blocks, key, wanted)


def prompt_segments(
    prompts: DataFrame,
    tool_blocks: DataFrame,
    key: str = "prompt_id",
    text_col: str = "text",
    system_rules: str | Column = fv.DEFAULT_SYSTEM_RULES,
    salt: str | None = None,
) -> DataFrame:
    """The assembled prompt as ordered rows (key, section, pos, segment).

    Nothing is grouped, so a prompt may have any number of tool blocks.  Joined
    by blank lines in (section, pos) order the segments are the final prompt.
    """
    boundary = bd.boundary_id(salt)
    zero = F.lit(0).cast("long")
    head = F.concat(
        bd.preamble(boundary), F.lit("\n"), bd.wrap(fv.SYSTEM, as_column(system_rules), boundary)
    )
    user = bd.wrap(fv.USER, F.col(text_col), boundary)
    own = prompts.select(
        key,
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("section"), zero.alias("pos"), head.alias("segment")),
                F.struct(F.lit(2).alias("section"), zero.alias("pos"), user.alias("segment")),
            )
        ),
    )
    tools = tool_blocks.join(prompts.select(key), key, "left_semi").select(
        key,
        F.lit(1).alias("section"),
        F.col("pos").cast("long").alias("pos"),
        bd.wrap(F.col("trust_level"), F.col("content"), boundary, F.col("source")).alias("segment"),
    )
    return own.unionByName(tools)


def _wrapped_context(user_text: Column, tool_context: Column | None, boundary: Column) -> Column:
    """TOOL blocks in order, then the USER block, joined by blank lines."""
    user = bd.wrap(fv.USER, user_text, boundary)
    if tool_context is None:
        return user
    tools = F.transform(
        tool_context,
        lambda b: bd.wrap(b["trust_level"], b["content"], boundary, b["source"]),
    )
    return F.when(
        F.size(tool_context) > 0,
        F.concat(F.array_join(tools, "\n\n"), F.lit("\n\n"), user),
    ).otherwise(user)


def assemble(
    df: DataFrame,
    user_text: str | Column = "text",
    tool_context: str | None = None,
    system_rules: str | Column = fv.DEFAULT_SYSTEM_RULES,
    salt: str | None | Column = None,
    when: Column | None = None,
) -> DataFrame:
    """Add ``final_prompt`` and ``structured_messages``.

    The wrapped tool and user text is built once and used in both.  ``when``
    leaves both columns null on rows where it is false.
    """
    text = F.col(user_text) if isinstance(user_text, str) else user_text
    tools = F.col(tool_context) if tool_context else None
    boundary = bd.boundary_id(salt)
    rules = as_column(system_rules)
    wanted = text.isNotNull() if when is None else when

    context = F.when(wanted, _wrapped_context(text, tools, boundary))
    staged = df.select("*", context.alias("__context"))

    body = F.col("__context")
    top = F.concat(bd.preamble(boundary), F.lit("\n"))
    prompt = F.concat(top, bd.wrap(fv.SYSTEM, rules, boundary), F.lit("\n\n"), body)

    # The user message is the prompt without any SYSTEM block.  The leading one
    # is simply not added; more can only come from tool blocks.
    open_tag, close_tag = bd.tag(fv.SYSTEM, boundary), bd.tag(fv.SYSTEM, boundary, closing=True)
    system_block = F.concat(
        F.lit(r"(?s)\Q"), open_tag, F.lit(r"\E.*?\Q"), close_tag, F.lit(r"\E\n\n")
    )
    user_body = F.when(
        F.contains(body, open_tag), F.regexp_replace(body, system_block, F.lit(""))
    ).otherwise(body)

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    messages = F.array(
        message("system", F.concat(rules, F.lit("\n\n"), bd.policy_note(boundary))),
        message("user", F.concat(top, user_body)),
    )
    return staged.select(
        *[F.col(f"`{c}`") for c in df.columns],
        prompt.alias("final_prompt"),
        F.when(body.isNotNull(), messages).alias("structured_messages"),
    )


def unprotected_prompt(
    user_text: Column,
    tool_context: Column | None = None,
    system_rules: str | Column = fv.DEFAULT_SYSTEM_RULES,
) -> Column:
    """The bypass prompt: rules, tools and user text without tags or escaping."""
    rules = F.concat(F.lit(fv.BYPASS_RULES_HEADING), as_column(system_rules))
    user = F.concat(F.lit(fv.BYPASS_USER_HEADING), user_text)
    plain = F.concat(rules, F.lit("\n\n"), user)
    if tool_context is None:
        return plain
    tools = F.transform(
        tool_context,
        lambda b: F.concat(
            F.lit("Tool Context (source="), F.coalesce(b["source"], F.lit("None")), F.lit("):\n"),
            b["content"],
        ),
    )
    return F.when(
        F.size(tool_context) > 0,
        F.concat(rules, F.lit("\n\n"), F.array_join(tools, "\n\n"), F.lit("\n\n"), user),
    ).otherwise(plain)
