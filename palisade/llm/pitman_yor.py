"""A hierarchical Pitman-Yor language model over words.

Restaurants: one for each context, which is the word before (the end of a text at
the start of the next), and their shared parent, whose base is uniform over the
vocabulary and one unknown word.  A word's customers in a context are its
occurrences there; each of their tables sends a customer to the parent.
Seatings are sampled by Gibbs sweeps.  A sweep takes the customers of each cell (a
word in a context) out of their restaurant and draws the number of their tables from
its distribution given all others: generalised Stirling numbers count the ways to
seat them, each table pays for itself by the tables that the context has besides and
by the parent's probability of the word without this cell.  Then the parent's
customers are seated in the same way.  Discounts are estimated from what has one and
two customers, the parent's after each sweep; the strength is fixed.  The cells of a
sweep are drawn side by side, each given the sweep before.  Predictive probabilities are averaged over the last sweeps.

Work is split by word, not by context, so a common context is no hot key: a
bucket of word hashes holds the counts of its words in all their contexts and
seats them.  Totals of contexts are summed up in buckets of context hashes, to
which every bucket of words sends one entry for each of its contexts, and which
answer in the order of what was sent.  Only a few sums are ever gathered.
Cells, and which contexts a bucket sends, never change: they are written once, in
bucketed tables that are read where they lie.  What moves and is written in a sweep
are numbers of tables.

Texts are read once, into chunks: the distinct (word, context) cells of about a
million tokens, with their counts, and the tokens as cell numbers.  Cells go to
the buckets of their words, which note where each chunk's cells are among their
own, and the buckets' answers (a probability for each cell, in the order in which
it was sent) come back to the chunks, where texts are summed up.  What moves is distinct cells, compressed, not tokens.

Words are known by their 64-bit hash.  Customers of a cell beyond the first ``EXACT``
come in by Poisson draws of new tables.

Null text counts as empty: one end token.  A null id is never held out.  Rows
map to rows, repeated ones included.  Without training rows all words are
unknown.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import discard, discard_folder, ship, text_of
from palisade.session import scratch_path

FOLDS, HELD = 7, 2
SWEEPS, AVERAGED = 4, 2
STRENGTH = 1.0
EXACT = 512
CHUNK_TOKENS = 1_000_000
#: Cells of chunks that a bucket of words takes on average.
BUCKET_CELLS = 1_000_000
#: Weights of numbers of tables that are looked at together.
_SLAB = 1 << 20
#: Room for the contexts of a table that numbers a known few; corpora have them by hash.
CONTEXTS = 256
#: Parts of the table of chunks: texts as cell numbers, and cells.
_TEXTS, _WORDS = 0, 1
#: No word: words hold no white space.
_END = b"\n"


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays, each stored by byte planes, which compress well."""
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"" for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(planes))


def _loosen(data: bytes, *kinds_and_sizes: tuple[str, int]) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    for kind, n in kinds_and_sizes:
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n) if n else np.empty(0, kind))
        at += n * width
    return out


def _numbered() -> dict[bytes, int]:
    """Numbers words as they are first met."""
    words: dict[bytes, int] = defaultdict()
    words.default_factory = words.__len__
    return words


_CHUNKS = (
    "part int, chunk long, doc_id array<long>, held_out array<boolean>, n_tokens array<long>, tokens binary, "
    "n_words long, n_cells long, cells binary"
)


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import xxhash
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    words = _numbered()
    docs: list[tuple] = []
    tokens: list[np.ndarray] = []
    total = 0

    def closed() -> pd.DataFrame:
        names = list(words)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))
        order = np.argsort(hashes)
        rank = np.empty(len(names), np.int64)
        rank[order] = np.arange(len(names))
        ids = rank[np.concatenate(tokens)]
        before = np.append(rank[words[_END]], ids[:-1])  # a chunk starts with a text
        cells, at = np.unique(ids * len(names) + before, return_inverse=True)
        lengths = np.array([d[2] for d in docs])
        train = np.repeat(np.array([not d[1] for d in docs]), lengths)
        counts = np.bincount(at[train], minlength=len(cells)).astype("<u4")
        per_word = np.bincount(cells // len(names), minlength=len(names)).astype("<u4")
        packed = _squeeze(hashes[order].astype("<u8"), per_word, (cells % len(names)).astype("<u4"), counts)
        return pd.DataFrame(
            {
                "part": [_TEXTS, _WORDS],
                "chunk": [number, number],
                "doc_id": [[d[0] for d in docs], None],
                "held_out": [[d[1] for d in docs], None],
                "n_tokens": [lengths, None],
                "tokens": [_squeeze(at.astype("<u4")), None],
                "n_words": [len(names)] * 2,
                "n_cells": [len(cells)] * 2,
                "cells": [None, packed],
            }
        )

    for batch in batches:
        for doc_id, held, text in zip(batch["doc_id"].astype("Int64"), batch["held_out"], batch["text"]):
            own = text.encode().lower().split()
            own.append(_END)
            tokens.append(np.fromiter(map(words.__getitem__, own), np.int64, len(own)))
            docs.append((None if doc_id is pd.NA else int(doc_id), bool(held), len(own)))
            total += len(own)
            if total >= CHUNK_TOKENS:
                yield closed()
                words, docs, tokens, total = _numbered(), [], [], 0
                number += 1
    if docs:
        yield closed()


def _requests(buckets: int):
    """The cells of each chunk, cut by bucket of the word hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk, n_words, n_cells, data in zip(batch["chunk"], batch["n_words"], batch["n_cells"], batch["cells"]):
                hashes, per_word, context, counts = _loosen(data, ("<u8", n_words), ("<u4", n_words), ("<u4", n_cells), ("<u4", n_cells))
                bucket = (hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
                words = np.searchsorted(bucket, np.arange(buckets + 1).astype(np.uint64))
                cells = np.append(0, np.cumsum(per_word, dtype=np.int64))[words]
                out = []
                for b in np.flatnonzero(np.diff(words)).tolist():
                    w, c = slice(words[b], words[b + 1]), slice(cells[b], cells[b + 1])
                    before, at = np.unique(context[c], return_inverse=True)
                    packed = _squeeze(hashes[w], per_word[w], hashes[before], at.astype("<u4"), counts[c])
                    out.append((b, chunk, w.stop - w.start, c.stop - c.start, len(before), packed))
                yield pd.DataFrame(out, columns=["bucket", "chunk", "n_words", "n_cells", "n_contexts", "cells"])

    return run


_REQUEST = "bucket int, chunk long, n_words long, n_cells long, n_contexts long, cells binary"


def _opened(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, word of each cell, hash of its context and count of each cell) of a request."""
    kinds = ("<u8", row.n_words), ("<u4", row.n_words), ("<u8", row.n_contexts), ("<u4", row.n_cells), ("<u4", row.n_cells)
    hashes, per_word, contexts, context, counts = _loosen(row.cells, *kinds)
    return hashes, np.repeat(np.arange(len(hashes)), per_word), contexts[context], counts


_SUMS = "words long, customers long, tables long, parent_tables long, ones array<long>"
_COUNTED = (
    f"bucket int, n_words long, n_cells long, n_contexts long, cells binary, {_SUMS}, "
    "chunk long, asked_words long, asked_cells long, asked binary"
)
_SEATS = f"bucket int, seats binary, samples array<binary>, sums array<binary>, {_SUMS}"


def _counted(group: pd.DataFrame) -> pd.DataFrame:
    """A row of all cells of a bucket and the contexts in it, and a row of the places of its cells for each request.

    Cells that only held-out texts have count zero; every other word has one table where it occurs.
    """
    rows = [_opened(r) for r in group.itertuples(index=False)]
    names, place = np.unique(np.concatenate([r[0] for r in rows]), return_inverse=True)
    contexts, before = np.unique(np.concatenate([r[2] for r in rows]), return_inverse=True)
    word_at, cell_at = (np.cumsum([0, *[len(r[k]) for r in rows]]) for k in (0, 1))
    words = np.concatenate([place[s : s + len(r[0])][r[1]] for s, r in zip(word_at, rows)])
    cells, at = np.unique(words * len(contexts) + before, return_inverse=True)
    counts = np.bincount(at, np.concatenate([r[3] for r in rows]), len(cells)).astype(np.int64)
    state = _State.first(names.astype("<u8"), cells // len(contexts), cells % len(contexts), counts, contexts.astype("<u8"))
    asked = []
    for k, r in enumerate(rows):  # words and cells of a request ascend
        w, c = place[word_at[k] : word_at[k + 1]], at[cell_at[k] : cell_at[k + 1]]
        steps = [np.diff(x, prepend=0).astype("<u4") for x in (w, c)]
        asked.append(_squeeze(*steps, np.bincount(r[1], minlength=len(w)).astype("<u4")))
    requests = group[["bucket", "chunk"]].assign(asked_words=np.diff(word_at), asked_cells=np.diff(cell_at), asked=asked)
    both = [state.cells(int(group["bucket"].iat[0])).assign(asked=None), requests.assign(cells=None, ones=None)]
    return pd.concat(both).reindex(columns=_COUNTED.replace(",", "").split()[::2]).astype(_WHOLE)


#: Columns that rows of one kind leave out hold whole numbers nevertheless.
_WHOLE = {c: "Int64" for c, kind in (x.split() for x in _COUNTED.split(", ")) if kind in ("int", "long")}


@dataclass
class _State:
    hashes: np.ndarray
    word: np.ndarray  # of each cell
    context: np.ndarray
    counts: np.ndarray
    tables: np.ndarray  # of each cell
    parents: np.ndarray  # tables of each word in the parent
    contexts: np.ndarray | None = None  # hashes

    @staticmethod
    def first(hashes, word, context, counts, contexts) -> "_State":
        """One table for each word where it occurs in training."""
        known = np.bincount(word, counts, len(hashes)) > 0
        return _State(hashes, word, context, counts, np.minimum(counts, 1), known.astype(np.int64), contexts)

    def _summed_up(self, bucket: int, **columns) -> pd.DataFrame:
        per_word = np.bincount(self.word, self.tables, len(self.hashes))
        ones = [int((x == k).sum()) for x in (self.counts, per_word) for k in (1, 2)]
        known = int((np.bincount(self.word, self.counts, len(self.hashes)) > 0).sum())
        sums = {"words": known, "customers": int(self.counts.sum()), "tables": int(self.tables.sum()), "parent_tables": int(self.parents.sum())}
        return pd.DataFrame({k: [v] for k, v in ({"bucket": bucket} | columns | sums | {"ones": ones}).items()})

    def cells(self, bucket: int) -> pd.DataFrame:
        """The row of cells of ``_COUNTED``."""
        per_word = np.bincount(self.word, minlength=len(self.hashes)).astype("<u4")
        packed = _squeeze(self.hashes, per_word, self.context.astype("<u4"), self.counts.astype("<u8"), self.contexts)
        return self._summed_up(bucket, n_words=len(self.hashes), n_cells=len(self.counts), n_contexts=len(self.contexts), cells=packed)

    def row(self, bucket: int, samples: list[bytes], sums: list[bytes]) -> pd.DataFrame:
        """The row of ``_SEATS``."""
        return self._summed_up(bucket, seats=self.seats(), samples=samples, sums=sums)

    def seats(self) -> bytes:
        return _squeeze(self.tables.astype("<u4"), self.parents.astype("<u4"))

    def seated(self, seats: bytes) -> "_State":
        tables, parents = _loosen(seats, ("<u4", len(self.counts)), ("<u4", len(self.hashes)))
        return _State(self.hashes, self.word, self.context, self.counts, tables.astype(np.int64), parents.astype(np.int64), self.contexts)

    @staticmethod
    def read(row) -> "_State":
        kinds = ("<u8", row.n_words), ("<u4", row.n_words), ("<u4", row.n_cells), ("<u8", row.n_cells), ("<u8", row.n_contexts)
        hashes, per_word, context, counts, contexts = _loosen(row.cells, *kinds)
        word = np.repeat(np.arange(len(hashes)), per_word)
        state = _State.first(hashes, word, context.astype(np.int64), counts.astype(np.int64), contexts)
        return state if row.seats is None else state.seated(row.seats)


@dataclass
class Totals:
    """All that the restaurants share: customers and tables of the contexts at hand, and sums over all."""

    customers: np.ndarray
    tables: np.ndarray
    parent_tables: int
    vocabulary: int
    discount: float
    parent_discount: float
    tokens: int = 0
    all_tables: int | None = None  # where not all contexts are at hand

    def having(self, customers: np.ndarray, tables: np.ndarray) -> "Totals":
        return replace(self, customers=customers, tables=tables)

    def parent(self, tables: np.ndarray, parents: np.ndarray) -> np.ndarray:
        """The parent's probability of words with so many customers and tables there."""
        d, n = self.parent_discount, int(self.tables.sum()) if self.all_tables is None else self.all_tables
        base = (STRENGTH + d * self.parent_tables) / (self.vocabulary + 1)
        return (tables - d * parents + base) / (STRENGTH + n)

    def parent_without(self, tables: np.ndarray, parents: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The parent's probability of each cell's word without the cell's own tables."""
        d, n = self.parent_discount, int(self.tables.sum()) if self.all_tables is None else self.all_tables
        base = (STRENGTH + d * self.parent_tables) / (self.vocabulary + 1)
        return (np.maximum(tables - own - d * parents, 0) + base) / (STRENGTH + n - own)

    def cell(self, context: np.ndarray, counts: np.ndarray, tables: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """The probability of words in contexts."""
        new = (STRENGTH + self.discount * self.tables[context]) * parent
        return (counts - self.discount * tables + new) / (STRENGTH + self.customers[context])


@lru_cache(maxsize=4)
def stirling(most: int, discount: float) -> list[np.ndarray]:
    """Logarithms of the ways to seat c customers at 1 to c tables, for c up to ``most``."""
    rows = [np.empty(0), np.zeros(1)]
    for c in range(1, most):
        there = np.arange(1, c + 1) * discount
        stay = np.append(np.log(np.maximum(c - there, 1e-300)) + rows[c], -np.inf)
        rows.append(np.logaddexp(np.append(-np.inf, rows[c]), stay))
    return rows


def seat(counts: np.ndarray, others: np.ndarray, dish: np.ndarray, discount: float, rng: np.random.Generator, strength: float = STRENGTH) -> np.ndarray:
    """Tables of each cell's customers, drawn given all that isn't theirs.

    ``others``: tables of the restaurant besides those of the cell; ``dish``: the
    parent's probability of the word.
    """
    tables = np.minimum(counts, 1)
    first = np.minimum(counts, EXACT)  # of these the number is drawn at once
    order = np.argsort(first, kind="stable")
    sizes, at = np.unique(first[order], return_index=True)
    ways = stirling(int(sizes[-1]), discount) if len(sizes) else []
    for c, same in zip(sizes.tolist(), np.split(order, at[1:])):
        if c < 2:
            continue
        slab = max(1, _SLAB // c)
        for own in (same[k : k + slab] for k in range(0, len(same), slab)):
            paid = np.log(strength + discount * (others[own, None] + np.arange(c))) + np.log(dish[own, None])
            weights = ways[c] + np.cumsum(paid, axis=1)
            upto = np.cumsum(np.exp(weights - weights.max(axis=1, keepdims=True)), axis=1)
            tables[own] = 1 + (upto < rng.random((len(own), 1)) * upto[:, -1:]).sum(axis=1).clip(max=c - 1)
    rest = np.flatnonzero(counts > EXACT)
    done = np.full(len(rest), float(EXACT))
    while len(rest):
        upto = np.minimum(done * 1.25, counts[rest])
        new = (strength + discount * (others[rest] + tables[rest])) * dish[rest]
        mean = new / (new + done - discount * tables[rest]) * (upto - done)
        tables[rest] = np.minimum(tables[rest] + rng.poisson(mean), counts[rest])
        going = upto < counts[rest]
        rest, done = rest[going], upto[going]
    return tables


def _cut(contexts: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """Buckets of contexts' hashes, in which they are sorted."""
    bucket = (contexts >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    cuts = np.searchsorted(bucket, np.arange(buckets + 1).astype(np.uint64))
    return ((b, slice(cuts[b], cuts[b + 1])) for b in np.flatnonzero(np.diff(cuts)).tolist())


_LINKS = "group int, bucket int, n long, linked binary"


def _linked(buckets: int):
    """The contexts of a bucket of words with their customers there, cut by bucket of the context's hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                state = _State.read(row)
                customers = np.bincount(state.context, state.counts, len(state.contexts)).astype("<u8")
                out = [(b, row.bucket, x.stop - x.start, _squeeze(state.contexts[x], customers[x])) for b, x in _cut(state.contexts, buckets)]
                yield pd.DataFrame(out, columns=["group", "bucket", "n", "linked"])

    return run


def _placed(links: pd.DataFrame) -> pd.DataFrame:
    """Links with the place of each context among those of the group, and all its customers."""
    sent = [_loosen(r.linked, ("<u8", r.n), ("<u8", r.n)) for r in links.itertuples(index=False)]
    names, place = np.unique(np.concatenate([x[0] for x in sent]), return_inverse=True)
    customers = np.bincount(place, np.concatenate([x[1] for x in sent]), len(names)).astype("<u8")
    cuts = np.cumsum([len(x[0]) for x in sent])[:-1]
    return links.assign(linked=[_squeeze(p.astype("<u4"), customers[p]) for p in np.split(place, cuts)])


_TABLES = "group int, bucket int, tables binary"


def _sent(buckets: int):
    """Tables of each context in a bucket of words, cut by bucket of the context's hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                state = _State.read(row)
                tables = np.bincount(state.context, state.tables, len(state.contexts)).astype("<u8")
                out = [(b, row.bucket, _squeeze(tables[x])) for b, x in _cut(state.contexts, buckets)]
                yield pd.DataFrame(out, columns=["group", "bucket", "tables"])

    return run


_REPLIES = "group int, bucket int, n long, sums binary"


def _summed(links: pd.DataFrame, messages: pd.DataFrame) -> pd.DataFrame:
    """For each bucket of words, the totals of the contexts that it sent, in the order sent."""
    rows = links.merge(messages[["bucket", "tables"]], on="bucket")
    place = [_loosen(r.linked, ("<u4", r.n), ("<u8", r.n)) for r in rows.itertuples(index=False)]
    sent = np.concatenate([_loosen(r.tables, ("<u8", r.n))[0] for r in rows.itertuples(index=False)])
    tables = np.bincount(np.concatenate([p for p, _ in place]), sent).astype("<u8")
    return rows[["group", "bucket", "n"]].assign(sums=[_squeeze(customers, tables[p]) for p, customers in place])


def _exchanged(states: DataFrame, links: DataFrame, buckets: int) -> DataFrame:
    messages = states.mapInPandas(_sent(buckets), _TABLES)
    return links.groupBy("group").cogroup(messages.groupBy("group")).applyInPandas(_summed, _REPLIES)


def _joined(replies: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(customers, tables) of the contexts of a bucket of words."""
    parts = [_loosen(r.sums, ("<u8", r.n), ("<u8", r.n)) for r in replies.sort_values("group").itertuples(index=False)]
    return tuple(np.concatenate([p[k] for p in parts]).astype(np.int64) for k in (0, 1))


def _sweep(shared: Totals, number: int):
    """Seat a bucket anew; sums of contexts that belong to a sample are kept with it."""

    def run(states: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        row = next(states.itertuples(index=False))
        sums = _joined(replies)
        totals, state, rng = shared.having(*sums), _State.read(row), np.random.default_rng([number, row.bucket])
        kept = [*row.sums, _squeeze(*sums)] if len(row.samples) else []
        if number == SWEEPS:  # all samples are drawn
            return state.row(row.bucket, list(row.samples), kept)
        per_word = np.bincount(state.word, state.tables, len(state.hashes))
        dish = totals.parent_without(per_word[state.word], state.parents[state.word], state.tables)
        others = totals.tables[state.context] - state.tables
        state.tables = seat(state.counts, others, dish, totals.discount, rng)
        per_word = np.bincount(state.word, state.tables, len(state.hashes)).astype(np.int64)
        base = np.full(len(per_word), 1 / (totals.vocabulary + 1))
        state.parents = seat(per_word, totals.parent_tables - state.parents, base, totals.parent_discount, rng)
        samples = [*row.samples, state.seats()] if number >= SWEEPS - AVERAGED else []
        return state.row(row.bucket, samples, kept)

    return run


def _totals(states: DataFrame) -> Totals:
    sums = [F.sum(c) for c in ("customers", "tables", "parent_tables", "words")]
    rest = states.agg(*sums, *[F.sum(F.get("ones", F.lit(i))) for i in range(4)]).first()
    customers, tables, parents, words, n1, n2, m1, m2 = [x or 0 for x in rest]
    # The usual estimate from what occurs once and twice.
    estimate = lambda one, two: float(np.clip(one / max(one + 2 * two, 1), 0.1, 0.95))
    none = np.empty(0, np.int64)
    return Totals(none, none, parents, words, estimate(n1, n2), estimate(m1, m2), customers, tables)


def _answers(totals: list[Totals]):
    """For each request of a bucket, its cells' log10 probabilities and its words' training counts."""

    def run(requests: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        row = next(states.itertuples(index=False))
        state, size = _State.read(row), int(row.n_contexts)
        p = np.zeros(len(state.counts))
        for t, seats, sums in zip(totals, row.samples, row.sums):
            t = t.having(*[x.astype(np.int64) for x in _loosen(sums, ("<i8", size), ("<i8", size))])
            sample = state.seated(seats)
            parent = t.parent(np.bincount(sample.word, sample.tables, len(sample.hashes)), sample.parents)
            p += t.cell(sample.context, sample.counts, sample.tables, parent[sample.word])
        logs = np.log10(p / len(totals)).astype("<f4")
        in_all = np.bincount(state.word, state.counts, len(state.hashes)).astype("<u8")
        out = []
        for r in requests.itertuples(index=False):
            w, c, per_word = _loosen(r.asked, ("<u4", r.asked_words), ("<u4", r.asked_cells), ("<u4", r.asked_words))
            answer = _squeeze(logs[np.cumsum(c, dtype=np.int64)], in_all[np.cumsum(w, dtype=np.int64)], per_word)
            out.append((r.chunk, r.bucket, r.asked_words, r.asked_cells, answer))
        return pd.DataFrame(out, columns=["chunk", "bucket", "n_words", "n_cells", "answer"])

    return run


def _scored(train_tokens: int, vocabulary: int):
    """Sum up the texts of a chunk."""

    def run(chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        logs, base, known = [], [], []
        for r in answers.sort_values("bucket").itertuples(index=False):
            log, count, per_word = _loosen(r.answer, ("<f4", r.n_cells), ("<u8", r.n_words), ("<u4", r.n_words))
            logs.append(log.astype(np.float64))
            base.append(np.repeat(np.log10((count + 1.0) / (train_tokens + vocabulary + 1)), per_word))
            known.append(np.repeat(count > 0, per_word))
        row = chunk.iloc[0]
        lengths = np.asarray(row["n_tokens"], np.int64)
        (at,) = _loosen(row["tokens"], ("<u4", int(lengths.sum())))
        starts = np.cumsum(lengths) - lengths
        total = lambda parts: np.add.reduceat(np.concatenate(parts)[at], starts)
        return pd.DataFrame(
            {
                "doc_id": pd.array([None if d is None or d != d else int(d) for d in row["doc_id"]], "Int64"),
                "held_out": list(row["held_out"]),
                "n_tokens": lengths,
                "n_known": total([k.astype(np.int64) for k in known]),
                "train_tokens": train_tokens,
                "base_score": total(base),
                "score": total(logs),
            }
        )

    return run


def _bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """``df``, whose tasks hold whole keys, written to the shared folder so that groups of ``key`` need no shuffle."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", scratch_path(spark, name)).bucketBy(buckets, key).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the name; the files stay
    return out


def score_documents(docs: DataFrame) -> DataFrame:
    """Train on what is not held out, and score every document."""
    ship(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_of().alias("text"))
    spark, folder = docs.sparkSession, scratch_path(docs.sparkSession, "chunks")
    rows.mapInPandas(_chunks, _CHUNKS).write.partitionBy("part").parquet(folder)
    made = spark.read.schema(_CHUNKS).parquet(folder)
    texts, chunks = (made.filter(F.col("part") == part) for part in (_TEXTS, _WORDS))
    cells = chunks.agg(F.sum("n_cells")).first()[0] or 0
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-cells // BUCKET_CELLS))
    requests = chunks.select("chunk", "n_words", "n_cells", "cells").mapInPandas(_requests(buckets), _REQUEST)
    counted = requests.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(_counted, _COUNTED)
    counted = _bucketed(counted, "cells", "bucket", buckets)
    discard_folder(spark, f"{folder}/part={_WORDS}")  # all of it is in the buckets
    requests = counted.filter("chunk is not null").select(
        F.col("bucket").alias("bucket"), "chunk", "asked_words", "asked_cells", "asked"
    )
    counted = counted.filter("chunk is null")
    cells = counted.select("bucket", "n_words", "n_cells", "n_contexts", "cells")
    none = F.array().cast("array<binary>")
    states = cells.select("*", F.lit(None).cast("binary").alias("seats"), none.alias("samples"), none.alias("sums"))
    links = states.mapInPandas(_linked(buckets), _LINKS).groupBy("group").applyInPandas(_placed, _LINKS)
    links = _bucketed(links, "links", "group", buckets)
    totals, seats = [_totals(counted)], None
    for number in range(SWEEPS + 1):
        replies = _exchanged(states, links, buckets)
        swept = states.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInPandas(_sweep(totals[-1], number), _SEATS)
        before, seats = seats, _bucketed(swept, "seats", "bucket", buckets)
        states = cells.hint("merge").join(seats.select("bucket", "seats", "samples", "sums"), "bucket")
        if before is not None:
            discard(before)  # all of it is in the new table
        if number < SWEEPS:
            totals.append(_totals(seats))
    answers = requests.groupBy("bucket").cogroup(states.groupBy("bucket"))
    answers = answers.applyInPandas(_answers(totals[-AVERAGED:]), "chunk long, bucket int, n_words long, n_cells long, answer binary")
    texts = texts.select("chunk", "doc_id", "held_out", "n_tokens", "tokens")
    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(
        _scored(totals[-1].tokens, totals[-1].vocabulary),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )


def perplexity(scored: DataFrame) -> DataFrame:
    """Perplexity per token of held-out and training texts, by the model and by the base."""
    per = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(per("score").alias("perplexity"), per("base_score").alias("base_perplexity"))
