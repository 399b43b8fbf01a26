"""Repairing the turn structure of conversations by weighted CYK interval parsing.

A conversation is legal if its role initials form ``(s?(ua)+)?``.  The repair grammar
has a nonterminal for each pair of the four states of that language (nothing yet, after
s, after u, after a): ``pq`` derives the rows that lead from p to q once edited, by
``pq -> pr rq`` (Chomsky normal form) or by one row.  A cell of the chart holds the
cheapest (cost, audit) of a nonterminal over a span; the audit has a letter per edit,
Keep, Rerole, Delete or Insert.  Inserted rows consume nothing, so the cells of single
rows are closed under insertion on both sides and no later rule needs to insert.
Two audits of one cost over one span never are a prefix of each other (they delete,
keep and rerole the same number of rows, and an insertion more would cost more), so the
smaller one stays smaller whatever follows, and a cell needs no second choice.

Up to ``CHART`` rows the chart is filled bottom-up by span length over all splits.  As
states alone connect two spans, every split of a span gives the same cell: longer
conversations join the top cells of such charts in pairs, again bottom-up by length,
and across tasks in order of the pieces that tasks hold.

*At scale.*  Rows travel without their texts, with a hash of them, sorted across the
cluster by conversation, turn, role and hash; each task parses the stretch that it holds,
so a conversation with a third of all rows is parsed by many tasks, each with bounded
memory.  Identical rows are one row with its number.  The edits go back to their rows by
an equi-join on the row's number in its conversation, and rows to texts by one on the
row's identity; no key of either repeats.

Null role or text counts as one space, null conv_id as a conversation.  Rows are taken by
turn (null first), then role and text hash.  Other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import ship
from palisade.session import materialise

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED = 5
#: Rows up to which all splits of all spans are tried; longer spans need one split each.
CHART = 8
#: Cells remembered by their row symbols, per Python worker.
_MEMORY = 100_000
#: Edits per batch that leaves a worker.
_BATCH = 20_000

_SPACE = " \t\n\x0b\x0c\r"
_LEGAL = {"su", "ua", "au"}

# --- grammar -----------------------------------------------------------------

_STATES = range(4)
_STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_ENDS = (0, 3)
#: Over rows s, u, a, x (another initial), in capitals where truncated, d where it has to go.
Cell = tuple[int, str]
Cells = dict[tuple[int, int], Cell]


def _better(cells: Cells, key: tuple[int, int], new: Cell) -> None:
    if key not in cells or new < cells[key]:
        cells[key] = new


def _joined(left: Cells, right: Cells, into: Cells | None = None) -> Cells:
    """The cells of two adjacent spans together; better ones of ``into`` stay."""
    out: Cells = {} if into is None else into
    for (p, r), (cost, audit) in left.items():
        for q in _STATES:
            other = right.get((r, q))
            if other is None:
                continue
            total, best = cost + other[0], out.get((p, q))
            if best is None or total < best[0]:
                out[p, q] = total, audit + other[1]
            elif total == best[0]:
                joined = audit + other[1]
                if joined < best[1]:
                    out[p, q] = total, joined
    return out


def _insertions() -> Cells:
    """The cells of the empty span: what insertions alone lead to."""
    cells: Cells = {(p, p): (0, "") for p in _STATES}
    single = {(p, q): (COST[INSERT], INSERT) for (p, c), q in _STEP.items() if c in "ua"}
    for _ in _STATES:
        for key, cell in _joined(cells, single).items():
            _better(cells, key, cell)
    return cells


EMPTY = _insertions()


def _row(symbol: str) -> Cells:
    """The cells of one row, closed under insertion."""
    cells: Cells = {(p, p): (COST[DELETE], DELETE) for p in _STATES}
    if symbol != "d":
        extra = TRUNCATED if symbol.isupper() else 0
        for (p, c), q in _STEP.items():
            if c == symbol.lower():
                _better(cells, (p, q), (COST[KEEP] + extra, KEEP))
            if c in "ua":
                _better(cells, (p, q), (COST[REROLE] + extra, REROLE))
    return _joined(_joined(EMPTY, cells), EMPTY)


_memory: dict[str, Cells] = {}


def chart(symbols: str) -> Cells:
    """The top cells over at most ``CHART`` rows; every span is remembered by its symbols."""
    if len(_memory) > _MEMORY:
        _memory.clear()
    for length in range(1, len(symbols) + 1):
        for start in range(len(symbols) - length + 1):
            span = symbols[start : start + length]
            if span not in _memory:
                cells = _row(span) if length == 1 else {}
                for split in range(1, length):
                    _joined(_memory[span[:split]], _memory[span[split:]], cells)
                _memory[span] = cells
    return _memory[symbols]


class Parser:
    """Cells over rows that arrive one after the other: spans of equal length are joined in pairs."""

    def __init__(self):
        self.waiting, self.spans = "", []

    def add(self, symbols: str) -> None:
        self.waiting += symbols
        whole = len(self.waiting) // CHART * CHART
        for at in range(0, whole, CHART):
            length, cells = 1, chart(self.waiting[at : at + CHART])
            while self.spans and self.spans[-1][0] == length:
                cells, length = _joined(self.spans.pop()[1], cells), 2 * length
            self.spans.append((length, cells))
        self.waiting = self.waiting[whole:]

    def cells(self) -> Cells:
        cells = chart(self.waiting) if self.waiting else EMPTY
        for _, left in reversed(self.spans):
            cells = _joined(left, cells)
        return cells


def cheapest(cells: Cells) -> Cell:
    """The cheapest repair of all rows."""
    return min(cells[0, q] for q in _ENDS)


# --- rows --------------------------------------------------------------------

_KEY = ["known", "conv"]
_TURN = ["timed", "turn"]
_PLACE = [*_TURN, "role", "sha"]


def _keyed(conversations: DataFrame) -> DataFrame:
    """The rows under keys without nulls, with the hash of their text."""
    space, conv, turn = F.lit(" "), F.col("conv_id"), F.col("turn")
    text = F.coalesce("text", space)
    return conversations.select(
        conv.isNotNull().alias("known"), F.coalesce(conv.cast("long"), F.lit(0)).alias("conv"),
        turn.isNotNull().alias("timed"), F.coalesce(turn.cast("long"), F.lit(0)).alias("turn"),
        F.coalesce("role", space).alias("role"), text.alias("text"), F.sha2(text, 256).alias("sha"),
    )


def _runs(rows: DataFrame) -> DataFrame:
    """Rows that are alike in all, as one with their number and the symbol of the first of them."""
    # White space at the end is dropped, and what is left decides.
    bare = F.rtrim(F.col("text"), F.lit(_SPACE))
    rows = rows.select(*_KEY, *_PLACE, (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    runs = rows.groupBy(*_KEY, *_PLACE).agg(F.count(F.lit(1)).alias("n"), F.any_value("blank").alias("blank"), F.any_value("cut").alias("cut"))
    runs = materialise(runs, "runs")
    # The key of this join holds the turn, so that a text said again and again is no hot key.
    firsts = runs.groupBy(*_KEY, "role", "sha").agg(F.min(F.struct(*_TURN)).alias("at")).select(*_KEY, "role", "sha", "at.*", F.lit(True).alias("first"))
    runs = runs.join(firsts, [*_KEY, *_PLACE], "left")
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    again = F.col("first").isNull()
    symbol = F.when(F.col("blank") | again, "d").when(F.col("cut"), F.upper(initial)).otherwise(initial)
    return runs.select(
        *_KEY, *_PLACE, "n", initial.alias("initial"), symbol.alias("symbol"), "blank",
        (F.col("cut") & ~F.col("blank") & ~again).alias("cut"),
    )


_PIECE = (
    "known boolean, conv long, part int, n long, blank long, duplicate long, truncated long, illegal long, "
    "first_initial string, last_initial string, first_turn long, last_turn long, turns long, costs array<long>, audits array<string>"
)


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    """Rows under a schema's names; as objects, since longs beside nulls would become floats."""
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")], dtype=object)


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Parse sorted runs; a piece is what one task's part holds of one conversation."""
    open_key, state, out = None, None, []
    for batch in batches:
        for known, conv, part, timed, turn, n, initial, symbol, blank, cut in batch.itertuples(index=False, name=None):
            key = (known, conv, part)
            if key != open_key:
                if state:
                    out.append(_closed(open_key, state))
                if len(out) >= 2000:
                    yield _frame(out, _PIECE)
                    out = []
                open_key, state = key, [0, 0, 0, 0, 0, initial, "", None, None, 0, Parser()]
            state[0] += n
            state[1] += n if blank else 0
            state[2] += 0 if blank else n if symbol == "d" else n - 1
            state[3] += 1 if cut else 0
            # A row and its own copies never stand legally side by side.
            state[4] += n - 1 + (state[6] != "" and state[6] + initial not in _LEGAL)
            state[6] = initial
            if timed:
                state[9] += state[8] != turn
                state[7] = turn if state[7] is None else state[7]
                state[8] = turn
            state[10].add(symbol + "d" * (n - 1))
    if state:
        out.append(_closed(open_key, state))
    if out:
        yield _frame(out, _PIECE)


def _closed(key: tuple, state: list) -> tuple:
    cells = state[10].cells()
    both = [cells.get((p, q), (-1, "")) for p in _STATES for q in _STATES]
    return (*key, *state[:10], [c for c, _ in both], [a for _, a in both])


_SUMMARY = (
    "known boolean, conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
)


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Join the pieces of each conversation, in their order."""
    pairs = [(p, q) for p in _STATES for q in _STATES]
    for batch in batches:
        out = []
        for known, conv, pieces in batch.itertuples(index=False, name=None):
            cells, counts, turns, first, last, initial = EMPTY, np.zeros(4, np.int64), 0, None, None, ""
            for x in pieces:
                found = zip(pairs, zip(x["costs"], x["audits"]))
                cells = _joined(cells, {key: (int(c), a) for key, (c, a) in found if c >= 0})
                counts += [x["blank"], x["duplicate"], x["truncated"], x["illegal"]]
                counts[3] += initial != "" and initial + x["first_initial"] not in _LEGAL
                initial = x["last_initial"]
                if x["turns"]:
                    turns += x["turns"] - (last == x["first_turn"])
                    first, last = x["first_turn"] if first is None else first, x["last_turn"]
            gaps = 0 if first is None else int(last) - int(first) + 1 - int(turns)
            out.append((known, conv, gaps, *counts.tolist(), *cheapest(cells)))
        yield _frame(out, _SUMMARY)


_EDIT = "known boolean, conv long, position long, row long, edit string, new_role string"


def _edits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of each repaired conversation, read off its audit; ``row`` is null for inserted ones."""
    for batch in batches:
        audits = batch["audit"].tolist()
        lengths = np.array([len(a) for a in audits], np.int64)
        letters = np.frombuffer("".join(audits).encode(), np.uint8)
        owner = np.repeat(np.arange(len(audits)), lengths)
        begins = np.cumsum(lengths) - lengths
        from_row, stays = letters != ord(INSERT), letters != ord(DELETE)

        def numbers(marked: np.ndarray) -> np.ndarray:
            """How many of a conversation's letters up to each one are marked, less one."""
            upto = np.concatenate([[0], np.cumsum(marked)])
            return upto[1:] - upto[begins][owner] - 1

        row, position = numbers(from_row), numbers(stays)
        # An odd number of rows tells that the first is the system's.
        odd = np.bincount(owner, stays, len(audits)).astype(np.int64) % 2
        left = np.flatnonzero(stays)
        for at in range(0, len(left), _BATCH):
            own = left[at : at + _BATCH]
            edit = letters[own].tobytes().decode()
            role = np.where((position[own] - odd[owner[own]]) % 2 == 0, "user", "assistant").astype(object)
            role[letters[own] == ord(KEEP)] = None
            keys = batch[_KEY].iloc[owner[own]].reset_index(drop=True)
            rows = pd.Series(row[own], dtype="Int64").mask(~from_row[own])
            yield keys.assign(position=position[own], row=rows, edit=list(edit), new_role=role)


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The summary of each conversation, and the rows of the repaired ones.

    The first is (known, conv, gaps, blank, duplicate, truncated, illegal, cost, audit);
    ``known`` is false for the null conv_id, whose ``conv`` is 0.  The second is (known, conv,
    position, edit, role, text), numbered from 0; inserted rows have an empty text.
    """
    ship(conversations)
    rows = _keyed(conversations)
    ordered = _runs(rows).repartitionByRange(*_KEY, *_PLACE).sortWithinPartitions(*_KEY, *_PLACE)
    ordered = materialise(ordered.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("k")), "ordered")

    light = ordered.select("known", "conv", "part", "timed", "turn", "n", "initial", "symbol", "blank", "cut", "k")
    sorted_parts = light.repartition("part").sortWithinPartitions("part", "k").drop("k")
    pieces = materialise(sorted_parts.mapInPandas(_pieces, _PIECE), "pieces")
    # A conversation has at most as many pieces as there are parts.
    joined = pieces.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("part", *[c for c in pieces.columns if c not in (*_KEY, "part")]))).alias("pieces"))
    summary = materialise(joined.mapInPandas(_summaries, _SUMMARY), "repairs")

    edits = materialise(summary.select("known", "conv", "audit").mapInPandas(_edits, _EDIT), "edits")
    inserted = edits.filter("row IS NULL").select(*_KEY, "position", "edit", F.col("new_role").alias("role"), F.lit("").alias("text"))
    before = Window.partitionBy(*_KEY).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select(*_KEY, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy(*_KEY, "part").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    numbered = ordered.select(*_KEY, *_PLACE, "part", "symbol", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("ahead"))
    numbered = numbered.filter("symbol <> 'd'").join(starts, [*_KEY, "part"]).select(*_KEY, *_PLACE, (F.col("start") + F.col("ahead")).alias("row"))
    kept = edits.filter("row IS NOT NULL").join(numbered, [*_KEY, "row"])
    texts = rows.select(*_KEY, *_PLACE, "text").dropDuplicates([*_KEY, *_PLACE])
    kept = kept.join(texts, [*_KEY, *_PLACE]).select(*_KEY, "position", "edit", F.coalesce("new_role", "role").alias("role"), "text")
    return summary, kept.unionByName(inserted)


_HASH = "known boolean, conv long, repaired_sha256 string"


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each conversation's rows, which arrive in order; only the hash's state is held."""
    open_key, state, out = None, None, []
    for batch in batches:
        for known, conv, role, text in batch.itertuples(index=False, name=None):
            if (known, conv) != open_key:
                if state:
                    out.append((*open_key, state.hexdigest()))
                open_key, state = (known, conv), hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(f"{role}:{text}".encode())
        if out:
            yield _frame(out, _HASH)
            out = []
    if state:
        yield _frame([(*open_key, state.hexdigest())], _HASH)


def repair_digests(originals: DataFrame, damaged: DataFrame) -> DataFrame:
    """One row for each conv_id of ``originals``: the repair of its rows in ``damaged`` and a hash of the result."""
    summary, repaired = repair(damaged)
    lines = repaired.repartition(*_KEY).sortWithinPartitions(*_KEY, "position").select(*_KEY, "role", "text")
    hashes = lines.mapInPandas(_digests, _HASH)
    conv = F.col("conv_id").cast("long")
    every = originals.select(conv.isNotNull().alias("known"), F.coalesce(conv, F.lit(0)).alias("conv")).distinct()
    found = every.join(summary, _KEY, "left").join(hashes, _KEY, "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    nothing = hashlib.sha256(b"").hexdigest()
    return found.select(
        F.when(F.col("known"), F.col("conv")).alias("conv_id"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )


def damage(conversations: DataFrame) -> DataFrame:
    """Rows damaged by the crc32 of ``conv_id:turn`` (null: one space) modulo 20.

    0 drops the row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4 sets its role to user.
    """
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(name.cast("binary")) % 20).alias("fault"))
    fault = F.col("fault")
    changed: Column = F.when(fault == 1, "").when(fault == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)))
    rows = rows.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), copies.alias("copy"))
    return rows.drop("copy")
