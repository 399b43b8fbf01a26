"""Boundary ids, tags and escaping for assembled prompts."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade import fixed_values as fv
from palisade.functions.text import as_column, python_repr


def boundary_id(salt: str | None | Column = None) -> Column:
    """First 12 hex digits of sha256(salt); an empty or null salt means the default.

    A plain string is hashed here, so that the patterns built from it are
    literals which each task compiles once.  With a salt column the pattern
    differs by row and is compiled whenever it changes.
    """
    if isinstance(salt, Column):
        salt = F.coalesce(F.nullif(salt, F.lit("")), F.lit(fv.DEFAULT_SALT))
        return F.substring(F.sha2(salt, 256), 1, fv.BOUNDARY_ID_LENGTH)
    digest = hashlib.sha256((salt or fv.DEFAULT_SALT).encode("utf-8")).hexdigest()
    return F.lit(digest[: fv.BOUNDARY_ID_LENGTH])


def tag(level: str | Column, boundary: Column, closing: bool = False) -> Column:
    name = F.upper(as_column(level))
    return F.concat(F.lit("[[/" if closing else "[["), name, F.lit("_"), boundary, F.lit("]]"))


def escape_untrusted(text: Column, boundary: Column) -> Column:
    """Break up forged boundary tags, then mark foreign control tokens."""
    own_tag = F.concat(F.lit(r"(?iu)\[(\[/?(?:SYSTEM|TOOL|USER)_"), boundary, F.lit(r"\]\])"))
    zwsp = fv.ZERO_WIDTH_SPACE
    untagged = F.when(
        F.contains(text, F.lit("[[")),
        F.regexp_replace(text, own_tag, F.lit(f"{zwsp}[{zwsp}$1")),
    ).otherwise(text)
    return F.regexp_replace(
        untagged,
        F.lit(f"(?iu)({fv.CONTROL_TOKENS})"),
        F.lit(f"{fv.ESCAPED_PREFIX}$1{fv.ESCAPED_SUFFIX}"),
    )


def wrap(level: str | Column, content: Column, boundary: Column, source: Column | None = None) -> Column:
    """Tagged block.  User and tool content is escaped; system content and sources are not."""
    level_col = as_column(level)
    if isinstance(level, str):
        body = content if level == fv.SYSTEM else escape_untrusted(content, boundary)
    else:
        body = F.when(
            level_col.isin(fv.USER, fv.TOOL), escape_untrusted(content, boundary)
        ).otherwise(content)
    note = F.lit("")
    if source is not None:
        note = F.when(source != "", F.concat(F.lit(" source="), python_repr(source))).otherwise(
            F.lit("")
        )
    return F.concat(
        tag(level_col, boundary), note, F.lit("\n"), body, F.lit("\n"),
        tag(level_col, boundary, closing=True),
    )


def _with_ids(template: str, boundary: Column) -> Column:
    parts = template.split("%s")
    pieces = [F.lit(parts[0])]
    for part in parts[1:]:
        pieces += [boundary, F.lit(part)]
    return F.concat(*pieces)


def preamble(boundary: Column) -> Column:
    return _with_ids(fv.PREAMBLE, boundary)


def policy_note(boundary: Column) -> Column:
    return _with_ids(fv.POLICY_NOTE, boundary)
