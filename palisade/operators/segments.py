"""Prompts of tool blocks from a table as ordered rows, in each of their three forms.

``prompt_segments`` (in ``encapsulate``) gives the guarded prompt, ``bypass_segments`` the
unprotected one and ``message_segments`` the two chat messages.  None of them groups a
prompt's blocks, so a prompt may have any amount of tool text, and a third of all blocks
may be one prompt's.  ``join_segments`` makes strings of them where a prompt is known
to fit a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade import fixed_values as fv
from palisade.functions import boundary as bd
from palisade.functions.text import as_column

_BLANK = "\n\n"
#: Blocks of a stretch, by position, in which open tags are looked for at a time.
STRETCH = 1024


def _own_rows(prompts: DataFrame, key: str, text_col: str, rows: list[tuple]) -> DataFrame:
    """The rows that each prompt with a text has besides its blocks."""
    structs = []
    for *numbers, segment in rows:
        named = zip(["ord", "section"], numbers)
        structs.append(F.struct(*[F.lit(n).alias(c) for c, n in named], F.lit(0).cast("long").alias("pos"), segment.alias("segment")))
    return prompts.filter(F.col(text_col).isNotNull()).select(key, F.inline(F.array(*structs)))


def _of_prompts(tool_blocks: DataFrame, prompts: DataFrame, key: str, text_col: str) -> DataFrame:
    return tool_blocks.join(prompts.filter(F.col(text_col).isNotNull()).select(key), key, "left_semi")


def bypass_segments(
    prompts: DataFrame,
    tool_blocks: DataFrame,
    key: str = "prompt_id",
    text_col: str = "text",
    system_rules: str | Column = fv.DEFAULT_SYSTEM_RULES,
) -> DataFrame:
    """The unprotected prompt as rows (key, section, pos, segment), put together as they are.

    Prompts without text have none.
    """
    rules = F.concat(F.lit(fv.BYPASS_RULES_HEADING), as_column(system_rules), F.lit(_BLANK))
    user = F.concat(F.lit(fv.BYPASS_USER_HEADING), F.col(text_col))
    own = _own_rows(prompts, key, text_col, [(0, 0, rules), (0, 2, user)]).drop("ord")
    tool = F.concat(
        F.lit("Tool Context (source="), F.coalesce("source", F.lit("None")), F.lit("):\n"), "content", F.lit(_BLANK)
    )
    tools = _of_prompts(tool_blocks, prompts, key, text_col).select(
        key, F.lit(1).alias("section"), F.col("pos").cast("long").alias("pos"), tool.alias("segment")
    )
    return own.unionByName(tools)


def message_segments(
    prompts: DataFrame,
    tool_blocks: DataFrame,
    key: str = "prompt_id",
    text_col: str = "text",
    system_rules: str | Column = fv.DEFAULT_SYSTEM_RULES,
    salt: str | None = None,
) -> DataFrame:
    """The chat messages as rows (key, ord, section, pos, segment): ord 0 is the system's, 1 the user's.

    Put together as they are, the rows of a message are its content.  SYSTEM blocks
    are left out of the user message, also where one is opened in one row and closed
    in another.
    """
    boundary = bd.boundary_id(salt)
    system = F.concat(as_column(system_rules), F.lit(_BLANK), bd.policy_note(boundary))
    top, user = F.concat(bd.preamble(boundary), F.lit("\n")), bd.wrap(fv.USER, F.col(text_col), boundary)
    own = _own_rows(prompts, key, text_col, [(0, 0, system), (1, 0, top), (1, 2, user)])

    tools = _of_prompts(tool_blocks, prompts, key, text_col)
    # Untrusted text is escaped, so an open tag comes from a trusted block or stands in a source.
    trusted = ~F.col("trust_level").isin(fv.USER, fv.TOOL)
    marked = trusted | F.coalesce(F.contains("source", bd.tag(fv.SYSTEM, boundary)), F.lit(False))
    opening = tool_blocks.filter(marked).select(key).distinct()
    segment = F.concat(bd.wrap(F.col("trust_level"), F.col("content"), boundary, F.col("source")), F.lit(_BLANK))
    shape = [key, F.lit(1).alias("ord"), F.lit(1).alias("section"), F.col("pos").cast("long").alias("pos"), segment.alias("segment")]
    plain = tools.join(opening, key, "left_anti").select(*shape)
    cut = _without_system_blocks(tools.join(opening, key, "left_semi").select(*shape), key, boundary)
    return own.unionByName(plain).unionByName(cut)


def _without_system_blocks(rows: DataFrame, key: str, boundary: Column) -> DataFrame:
    """The rows without what lies between an open SYSTEM tag and the next closed one.

    After any tag the place is inside of a block if that tag was an open one, so the
    last tag before a row tells where it begins; an open tag that nothing closes stays.
    A closing tag counts with the blank line after it.  Both are looked up inside of
    stretches of positions, and among the stretches, so no prompt's rows are gathered.
    """
    opened = bd.tag(fv.SYSTEM, boundary)
    closed = F.concat(bd.tag(fv.SYSTEM, boundary, closing=True), F.lit(_BLANK))
    quoted = lambda *tags: F.concat(*[F.concat(F.lit(x), F.lit(r"\Q"), t, F.lit(r"\E")) for x, t in tags])
    tags = F.regexp_extract_all("segment", quoted(("", opened), ("|", closed)), F.lit(0))
    rows = rows.withColumn("__stretch", F.floor(F.col("pos") / STRETCH)).withColumn("__tags", tags)
    rows = rows.withColumn("__last", F.get("__tags", F.size("__tags") - 1)).withColumn("__closes", F.array_contains("__tags", closed))

    def around(last: str, closes: str, window) -> tuple[Column, Column]:
        """The last tag before, and whether a closing one comes after."""
        ahead = window.rowsBetween(Window.unboundedPreceding, -1)
        behind = window.rowsBetween(1, Window.unboundedFollowing)
        return F.last(last, ignorenulls=True).over(ahead), F.coalesce(F.max(closes).over(behind), F.lit(False))

    stretches = rows.groupBy(key, "__stretch").agg(
        F.max_by("__last", F.when(F.col("__last").isNotNull(), F.col("pos"))).alias("__s_last"), F.max("__closes").alias("__s_closes")
    )
    outer, outer_closes = around("__s_last", "__s_closes", Window.partitionBy(key).orderBy("__stretch"))
    stretches = stretches.select(key, "__stretch", outer.alias("__outer"), outer_closes.alias("__outer_closes"))
    inner, inner_closes = around("__last", "__closes", Window.partitionBy(key, "__stretch").orderBy("pos", "segment"))
    rows = rows.withColumn("__inner", inner).withColumn("__inner_closes", inner_closes).join(stretches, [key, "__stretch"])

    inside = F.coalesce("__inner", "__outer").eqNullSafe(opened)
    later = F.col("__inner_closes") | F.col("__outer_closes")
    text, closes = F.col("segment"), F.col("__closes")
    rest = F.when(inside & closes, F.substring(text, F.position(closed, text) + F.length(closed), F.length(text)))
    rest = rest.otherwise(text)
    whole = F.regexp_replace(rest, F.concat(F.lit("(?s)"), quoted(("", opened), (".*?", closed))), F.lit(""))
    # What is opened here and closed in a later row goes to the end of this one.
    left = F.when(later & F.contains(whole, opened), F.substring(whole, F.lit(1), F.position(opened, whole) - 1)).otherwise(whole)
    kept = F.when(inside & ~closes, F.when(later, F.lit("")).otherwise(text)).otherwise(left)
    return rows.select(key, "ord", "section", "pos", kept.alias("segment")).filter("segment <> ''")


def join_segments(rows: DataFrame, by: list[str], into: str = "content") -> DataFrame:
    """(by, into): the segments of each group in order, as one string.

    A group's text meets in one row, so it has to fit a string; segments don't.
    """
    ordered = F.array_sort(F.collect_list(F.struct("section", "pos", "segment")))
    return rows.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda s: s["segment"]), "").alias(into))
