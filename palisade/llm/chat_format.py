"""Conversations as training text, by a template and a state machine over roles.

*Template.*  ``Template.layout`` is the text of one turn in pieces, among them the
slots ``{role}`` and ``{text}``; every piece becomes a segment with a loss flag, and
only the text of a role in ``loss_roles`` is trained on.  Texts and roles can hold
the template's own control strings, so one backslash more is put between the ``<``
and ``|`` of each ``<\\*|``; taking one away again restores any text exactly, and no
escaped text holds a control string.  Roles also escape their line breaks, since a
line break ends the role's slot.

*State machine.*  A state is named for the role read last, ``start`` before the first;
``Template.steps`` lists the legal steps and ``Template.final`` where a conversation
may end.  After an illegal step the machine goes on from the role that it read, so
every violation is counted, and all conversations are formatted, legal or not.  The
state after a turn depends on that turn alone, which is what lets a long conversation
be run in stretches of turns: inside of each, and once over their first and last roles.

Everything is built-in expressions.  Formatting moves no row; the machine moves roles
without texts.  Only ``conversation_digests`` brings a conversation's text together,
since a hash of it is taken over the whole: that bounds a conversation's text there,
and nowhere else, by the 2 GB of a string.

Null role or text counts as empty.  Turns are taken in order of turn (null first), then
of role and text; repeated rows are turns of their own.  A null conv_id is a conversation.
Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.session import materialise

ROLE, TEXT = "{role}", "{text}"
#: Turns of a stretch in which the machine runs at a time.
STRETCH = 64
_FROM, _TO = r"<(\\*)\|", r"<$1\\|"
_BACK, _WAS = r"<\\(\\*)\|", r"<$1|"


@dataclass(frozen=True)
class Template:
    layout: tuple[str, ...] = ("<|im_start|>", ROLE, "\n", TEXT, "<|im_end|>", "\n")
    loss_roles: tuple[str, ...] = ("assistant",)
    steps: tuple[tuple[str, str], ...] = (
        ("start", "system"), ("start", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user"),
    )
    final: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        if [x for x in self.layout if x in (ROLE, TEXT)] != [ROLE, TEXT] or self.layout[-1] == TEXT:
            raise ValueError("a layout needs a role, a text after it, and a mark behind the text")
        at = self.layout.index(ROLE)
        if not self.layout[at + 1].startswith("\n") or not self.layout[self.layout.index(TEXT) + 1].startswith("<|"):
            raise ValueError("a line break must end the role and a control string the text")

    @property
    def pattern(self) -> str:
        """A regular expression for one formatted turn, with the slots as groups."""
        slots = {ROLE: r"([^\n]*)", TEXT: "(.*)"}
        return r"(?s)\A" + "".join(slots.get(x) or re.escape(x) for x in self.layout) + r"\z"


CHAT = Template()


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, _FROM, _TO)


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, _BACK, _WAS)


def escape_role(role: Column) -> Column:
    doubled = F.replace(role, F.lit("\\"), F.lit("\\\\"))
    return escape_text(F.replace(doubled, F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    """Doubled backslashes are found from the left, so what lies between them holds only whole escapes."""
    between = F.split(unescape_text(role), r"\\\\")
    return F.array_join(F.transform(between, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def _turns(conversations: DataFrame) -> DataFrame:
    blank = F.lit("")
    return conversations.select(
        "conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text")
    )


def format_turns(conversations: DataFrame, template: Template = CHAT) -> DataFrame:
    """(conv_id, turn, segments): one row per turn with its segments, each of text and loss."""
    turns = _turns(conversations)
    slots = {ROLE: escape_role(F.col("role")), TEXT: escape_text(F.col("text"))}
    trained = F.col("role").isin(*template.loss_roles) if template.loss_roles else F.lit(False)
    segments = [
        F.struct(slots.get(x, F.lit(x)).alias("text"), (trained if x == TEXT else F.lit(False)).alias("loss"))
        for x in template.layout
    ]
    return turns.select("conv_id", "turn", F.array(*segments).alias("segments"))


def turn_order(conversations: DataFrame, template: Template = CHAT) -> DataFrame:
    """(conv_id, n_illegal, valid): the illegal steps of each conversation, its end included in ``valid``.

    Turns that share turn and role are one row with their number, and a stretch is
    ``STRETCH`` turn numbers, so neither a long conversation nor repeated turns make
    a large group; the second pass reads one row per stretch.
    """
    legal = F.array(*[F.lit("\n".join(step)) for step in template.steps])

    def step(state: Column, role: Column) -> Column:
        return (~F.array_contains(legal, F.concat(state, F.lit("\n"), role))).cast("long")

    order = ["turn", "role"]
    runs = _turns(conversations).groupBy("conv_id", *order).agg(F.count(F.lit(1)).alias("n"))
    runs = runs.withColumn("stretch", F.floor(F.col("turn") / STRETCH))
    before = F.lag("role").over(Window.partitionBy("conv_id", "stretch").orderBy(*order))
    own = step(F.col("role"), F.col("role")) * (F.col("n") - 1)
    runs = runs.withColumn("bad", own + F.coalesce(step(before, F.col("role")), F.lit(0)))
    place = F.struct(*order)
    stretches = runs.groupBy("conv_id", "stretch").agg(
        F.sum("bad").alias("bad"), F.min_by("role", place).alias("first"), F.max_by("role", place).alias("last")
    )
    entered = F.lag("last", 1, "start").over(Window.partitionBy("conv_id").orderBy("stretch"))
    stretches = stretches.withColumn("bad", F.col("bad") + step(entered, F.col("first")))
    at = F.struct(F.col("stretch").isNotNull().alias("known"), "stretch")
    return stretches.groupBy("conv_id").agg(F.sum("bad").alias("n_illegal"), F.max_by("last", at).alias("last")).select(
        "conv_id", "n_illegal", ((F.col("n_illegal") == 0) & F.col("last").isin(*template.final)).alias("valid")
    )


def read_turns(formatted: DataFrame, template: Template = CHAT) -> DataFrame:
    """(conv_id, turn, role, text, loss_text, chars) parsed from the segments of formatted turns.

    Role and text come from the joined segments by the template's pattern,
    ``loss_text`` from the flagged segments, all unescaped; ``chars`` is the length
    of the formatted turn.
    """
    whole = F.array_join("segments.text", "")
    masked = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), "")
    rows = formatted.select("conv_id", "turn", whole.alias("whole"), masked.alias("masked"))
    slot = lambda n: F.regexp_extract("whole", template.pattern, n)
    return rows.select(
        "conv_id", "turn", unescape_role(slot(1)).alias("role"), unescape_text(slot(2)).alias("text"),
        unescape_text(F.col("masked")).alias("loss_text"), F.length("whole").cast("long").alias("chars"),
    )


def conversation_digests(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``read_turns``: counts and digests over its turns in order."""
    # A trained text is carried once: null stands for "the same as text".
    other = F.when(F.col("loss_text") != F.col("text"), F.col("loss_text"))
    joined = turns.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text", other.alias("other")))).alias("rows"),
        F.sum("chars").alias("formatted_chars"),
    )
    said = F.array_join(F.transform("rows", lambda r: F.concat(r["role"], F.lit("\n"), r["text"], F.lit("\n"))), "")
    trained = F.array_join(F.transform("rows", lambda r: F.coalesce(r["other"], r["text"])), "")
    return joined.select(
        "conv_id", F.size("rows").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(trained).cast("long").alias("loss_chars"), F.sha2(trained, 256).alias("loss_sha256"), "formatted_chars",
    )


def format_and_read_back(conversations: DataFrame, template: Template = CHAT) -> DataFrame:
    """Write the formatted turns, read them again, and give each conversation's digests and verdict."""
    written = materialise(format_turns(conversations, template), "chat")
    found = conversation_digests(read_turns(written, template))
    verdicts = turn_order(conversations, template).withColumnRenamed("conv_id", "judged_id")
    both = found.join(verdicts, found["conv_id"].eqNullSafe(F.col("judged_id")))
    return both.drop("judged_id")
