"""Repeated byte strings, by a distributed merge sort of suffixes.

Every byte inside a string of ``Window.length`` bytes that also starts elsewhere goes;
``LENGTH`` bytes unless the caller wants another length.

*Which suffixes.*  Sorting all of them would move each text hundreds of times.
Of each window the smallest of its first ``Window.span`` 32-byte
hashes marks an anchor; equal windows mark the same place, so it is enough to
sort the suffixes at anchors, one in about half a span, each with the few bytes
before it that its windows reach back to.  The bytes that follow an anchor and
lie in all its windows are hashed first, and only anchors whose hash occurs
twice are sorted: the others can't have an equal window.

*Sort.*  Tasks sort their suffixes into runs and front-code them: each is sent as
the length it shares with the one before, and the rest.  The runs of a bucket
of hashes meet in one task and are merged by a loser tree that keeps, for every
run, what its head shares with the last winner: longer wins without looking at
a byte, and equals are compared beyond what they are known to share.  The merge
hands on those lengths, from which equal windows follow: two suffixes that
share r bytes after the anchor and l before it have the same windows from
``length - r`` to ``l`` bytes before it.

A hash that occurs more than ``CROWD`` times is not gathered: the windows of its
anchors are grouped by their digests with ordinary aggregation and joins.

Null text counts as empty.  Texts shorter than a window are left whole.  Repeated
rows repeat each other, whatever their ids.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import FILE, ROW, own_columns, row_keyed, ship
from palisade.session import materialise

LENGTH = 400
SPAN = 256
GRAM = 32
CROWD = 50_000
#: Bytes of a text that are hashed at a time, and of suffixes in a run.
_SEGMENT = 1 << 19
_RUN = 1 << 24
_BASE = 0x5851F42D4C957F2D


@dataclass(frozen=True)
class Window:
    """Length of the repeated strings, and how many of its first hashes choose a window's anchor (at most 256)."""

    length: int = LENGTH
    span: int = SPAN

    @property
    def core(self) -> int:
        """Bytes after an anchor that all its windows hold."""
        return self.length - self.span + 1


WINDOW = Window()


def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    n = _SEGMENT + length + 1
    ups, downs = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    ups[0] = downs[0] = 1
    return np.multiply.accumulate(ups), np.multiply.accumulate(downs)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def anchors(data: bytes, window: Window = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, first and last window start, hash of the core) of a text's anchors."""
    length, span, core = window.length, window.span, window.core
    if length not in _POWERS:
        _POWERS[length] = _powers(length)
    ups, downs = _POWERS[length]
    out = []
    for at in range(0, max(0, len(data) - length + 1), _SEGMENT):
        part = np.frombuffer(data, np.uint8, min(len(data) - at, _SEGMENT + length - 1), at)
        n = len(part) - length + 1  # windows
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part.astype(np.uint64) * ups[: len(part)], out=sums[1:])
        grams = n + span - 1
        keys = _mixed((sums[GRAM : GRAM + grams] - sums[:grams]) * downs[:grams])
        keys = (keys >> np.uint64(20) << np.uint64(20)) | np.arange(grams, dtype=np.uint64)
        blocks = np.full(-(-grams // span) * span, ~np.uint64(0))
        blocks[:grams] = keys
        blocks = blocks.reshape(-1, span)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = (np.minimum(back[:n], ahead[span - 1 : span - 1 + n]) & np.uint64(0xFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.diff(least, prepend=-1))
        place = least[first]
        cores = _mixed((sums[place + core] - sums[place]) * downs[place])
        out.append((place + at, first + at, np.append(first[1:] - 1, n - 1) + at, cores))
    if not out:
        none = np.empty(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def shared(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, given that it is at least ``start``."""
    stop = min(len(a), len(b))
    step = 32
    while start < stop and a[start : start + step] == b[start : start + step]:
        start = min(stop, start + step)
        step *= 2
    while start < stop and step > 1:
        step //= 2
        if a[start : start + step] == b[start : start + step]:
            start = min(stop, start + step)
    return start + (start < stop and a[start] == b[start])


def front_code(keys: list[bytes], payloads: list[bytes]) -> bytes:
    """Sorted keys as shared length and rest, each with a payload."""
    heads, bodies, last = [], [], b""
    for key, payload in zip(keys, payloads):
        common = shared(last, key)
        heads.append((common, len(key) - common, len(payload)))
        bodies += [key[common:], payload]
        last = key
    table = np.array(heads, "<u4").reshape(-1, 3).tobytes()
    return zlib.compress(struct.pack("<I", len(keys)) + table + b"".join(bodies), 1)


def front_decoded(blob: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """(length shared with the one before, key, payload)."""
    data = zlib.decompress(blob)
    (n,) = struct.unpack_from("<I", data)
    at, key = 4 + 12 * n, b""
    for common, rest, extra in np.frombuffer(data, "<u4", 3 * n, 4).reshape(-1, 3).tolist():
        key = key[:common] + data[at : at + rest]
        yield common, key, data[at + rest : at + rest + extra]
        at += rest + extra


def merge(runs: list[Iterator[tuple[int, bytes, bytes]]]) -> Iterator[tuple[int, bytes, bytes]]:
    """Merge front-coded runs with a loser tree; yields shared length, key and payload in order.

    ``known[r]`` is what the head of run r shares with the key that went out
    last.  Of two heads the one that shares more is smaller; if both share the
    same, bytes are compared from there on, and the loser's value becomes what
    it shares with the winner, which is what it will share with the last output
    by the time it is compared again on this path.
    """
    n = len(runs)
    if not n:
        return
    size = 1 << (n - 1).bit_length()
    keys: list[bytes | None] = [None] * size
    payloads: list[bytes] = [b""] * size
    known = [0] * size

    def advance(r: int) -> None:
        entry = next(runs[r], None) if r < n else None
        if entry is None:
            keys[r], known[r] = None, -1
        else:
            known[r], keys[r], payloads[r] = entry

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two heads with values against the same key."""
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        if keys[a] is None:
            return a, b
        common = shared(keys[a], keys[b], known[a])
        if keys[a][common:] <= keys[b][common:]:
            known[b] = common
            return a, b
        known[a] = common
        return b, a

    losers = [-1] * size
    for r in range(size):
        advance(r)
        if keys[r] is not None:
            known[r] = 0
    winners = list(range(size))
    level = size
    while level > 1:
        nxt = []
        for i in range(0, level, 2):
            node = (level + i) // 2
            won, losers[node] = play(winners[i], winners[i + 1])
            nxt.append(won)
        winners, level = nxt, level // 2
    top = winners[0]
    while keys[top] is not None:
        yield known[top], keys[top], payloads[top]
        advance(top)
        node = (size + top) // 2
        while node >= 1 and size > 1:
            top, losers[node] = play(top, losers[node])
            node //= 2


def _common_end(a: bytes, b: bytes) -> int:
    return shared(a[::-1], b[::-1])


def repeated_windows(group: list[tuple[int, bytes, int]], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Which windows of anchors with one core occur twice.

    ``group``: in order of the bytes after the anchor, (bytes after the anchor
    shared with the item before, bytes before the anchor, how often the item
    occurs, least and most bytes that its windows reach back).  Returns for
    each item the reaches (from, to) whose windows are repeated.
    """
    out = []
    if len(group) <= 24:
        for i, (_, left, times, low, high) in enumerate(group):
            if times > 1:
                out.append([(low, high)])
                continue
            spans = []
            for step in (-1, 1):
                right, j = length, i
                while 0 <= j + step < len(group):
                    right = min(right, group[j if step < 0 else j + 1][0])
                    j += step
                    if length - right > high:
                        break
                    a, b = max(low, length - right), min(high, _common_end(left, group[j][1]))
                    if a <= b:
                        spans.append((a, b))
            out.append(spans)
        return out
    out = [[] for _ in group]
    for reach in range(min(g[3] for g in group), max(g[4] for g in group) + 1):
        seen: dict[tuple[int, bytes], list[int]] = {}
        block, times = 0, {}
        for i, (common, left, count, low, high) in enumerate(group):
            if common < length - reach:
                block += 1
            if low <= reach <= high:
                key = (block, left[len(left) - reach :])
                seen.setdefault(key, []).append(i)
                times[key] = times.get(key, 0) + count
        for key, members in seen.items():
            if times[key] > 1:
                for i in members:
                    out[i].append((reach, reach))
    return out


_REF = "<qqI"


def _runs(buckets: int, window: Window):
    """Sorted, front-coded runs of the anchors of candidate texts, cut by bucket."""

    def closed(items: dict[tuple[bytes, bytes, int], list[bytes]]) -> pd.DataFrame:
        by_bucket: dict[int, tuple[list, list]] = {}
        for key, left, low in sorted(items):
            refs = items[key, left, low]
            keys, payloads = by_bucket.setdefault(int.from_bytes(key[:8], "big") % buckets, ([], []))
            keys.append(key)
            payloads.append(struct.pack("<HHI", len(left), low, len(refs)) + left + b"".join(refs))
        return pd.DataFrame([(b, front_code(*x)) for b, x in by_bucket.items()], columns=["bucket", "run"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items: dict[tuple[bytes, bytes, int], list[bytes]] = {}
        size = 0
        for batch in batches:
            for fid, row, text, cores, places in zip(batch["fid"], batch["row"], batch["text"], batch["cores"], batch["places"]):
                data = text.encode()
                for core, packed in zip(np.asarray(cores, np.int64).view(np.uint64).tolist(), np.asarray(places).tolist()):
                    place, high, low = packed >> 16, packed >> 8 & 255, packed & 255
                    key = core.to_bytes(8, "big") + data[place : place + window.length - low]
                    left = data[place - high : place]
                    items.setdefault((key, left, low), []).append(struct.pack(_REF, fid, row, place))
                    size += len(key) + len(left)
                if size >= _RUN:
                    yield closed(items)
                    items, size = {}, 0
        if items:
            yield closed(items)

    return run


def _merged(group: pd.DataFrame, window: Window) -> pd.DataFrame:
    """Repeated windows, as (text, first start, last start), of a bucket's runs."""
    found = []

    def settle(members: list) -> None:
        # Items equal in several runs are one item.
        items: list[list] = []
        for common, key, payload in members:
            size, low, n = struct.unpack_from("<HHI", payload)
            left, refs = payload[8 : 8 + size], payload[8 + size :]
            again = items and common == len(key) == len(items[-1][6])
            same = next((x for x in reversed(items) if (x[1], x[3], x[6]) == (left, low, key)), None) if again else None
            if same is not None:
                same[2] += n
                same[5].append(refs)
                continue
            items.append([max(0, common - 8), left, n, low, size, [refs], key])
        if len(items) == 1 and items[0][2] == 1:
            return
        for (_, _, _, _, _, refs, _), spans in zip(items, repeated_windows([tuple(x[:5]) for x in items], window.length)):
            for a, b in spans:
                for part in refs:
                    found.extend((fid, row, place - b, place - a) for fid, row, place in struct.iter_unpack(_REF, part))

    members: list = []
    for common, key, payload in merge([front_decoded(run) for run in group["run"]]):
        if members and common < 8 + window.core:
            settle(members)
            members = []
        members.append((common, key, payload))
    if members:
        settle(members)
    return pd.DataFrame(found, columns=["fid", "row", "first", "last"])


def _crowded(length: int):
    """Digest of every window of the anchors in each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for fid, row, text, places in zip(batch["fid"], batch["row"], batch["text"], batch["places"]):
                data, out = text.encode(), []
                for packed in np.asarray(places).tolist():
                    place, high, low = packed >> 16, packed >> 8 & 255, packed & 255
                    for start in range(place - high, place - low + 1):
                        out.append((hashlib.blake2b(data[start : start + length], digest_size=16).digest(), fid, row, start))
                yield pd.DataFrame(out, columns=["window", "fid", "row", "start"])

    return run


def _anchor_rows(window: Window):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cores, places, digests = [], [], []
            for text in batch["text"]:
                data = text.encode()
                place, first, last, core = anchors(data, window)
                cores.append(core.view(np.int64))
                places.append(place << 16 | (place - first) << 8 | (place - last))
                digests.append((len(data), hashlib.sha256(data).hexdigest()))
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].astype("Int64"),
                    "fid": batch["fid"],
                    "row": batch["row"],
                    "n_bytes": [d[0] for d in digests],
                    "sha": [d[1] for d in digests],
                    "cores": cores,
                    "places": places,
                }
            )

    return run


def repeats(docs: DataFrame, crowd: int = CROWD, id_col: str = "doc_id", text_col: str = "text", window: Window = WINDOW) -> tuple[DataFrame, DataFrame]:
    """All rows (doc_id, fid, row, n_bytes, sha), and the texts that hold repeats with their window ranges."""
    ship(docs)
    spark = docs.sparkSession
    rows = row_keyed(docs).select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
        # Of as many values as there are files.
        F.xxhash64(FILE).alias("fid"),
        F.col(ROW).alias("row"),
    )
    schema = "doc_id long, fid long, row long, n_bytes long, sha string, cores array<long>, places array<long>"
    meta = materialise(rows.mapInPandas(_anchor_rows(window), schema), "anchors")
    each = meta.select("fid", "row", F.explode(F.arrays_zip("cores", "places")).alias("x")).select("fid", "row", "x.cores", "x.places")
    twice = each.groupBy("cores").count().filter("count > 1").withColumn("crowded", F.col("count") > crowd).drop("count")
    wanted = each.join(twice, "cores").groupBy("fid", "row").agg(
        F.collect_list(F.when(~F.col("crowded"), F.struct("cores", "places"))).alias("calm"),
        F.collect_list(F.when(F.col("crowded"), F.col("places"))).alias("crowded"),
    )
    texts = materialise(rows.drop("doc_id").join(wanted, ["fid", "row"]), "candidates")
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    calm = texts.select("fid", "row", "text", F.col("calm.cores").alias("cores"), F.col("calm.places").alias("places"))
    runs = calm.mapInPandas(_runs(buckets, window), "bucket int, run binary")
    schema = "fid long, row long, first long, last long"
    ranges = runs.groupBy("bucket").applyInPandas(lambda group: _merged(group, window), schema)
    if not twice.filter("crowded").isEmpty():
        crowded = texts.filter(F.size("crowded") > 0).select("fid", "row", "text", F.col("crowded").alias("places"))
        windows = materialise(crowded.mapInPandas(_crowded(window.length), "window binary, fid long, row long, start long"), "windows")
        again = windows.groupBy("window").count().filter("count > 1").select("window")
        ranges = ranges.unionByName(
            windows.join(again, "window").select("fid", "row", F.col("start").alias("first"), F.col("start").alias("last"))
        )
    spans = ranges.groupBy("fid", "row").agg(F.collect_list("first").alias("first"), F.collect_list("last").alias("last"))
    return meta.drop("cores", "places"), texts.select("fid", "row", "text").join(spans, ["fid", "row"])


def removed_runs(first: list[int], last: list[int], length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal runs (start, stop) of bytes covered by windows that start in the ranges."""
    out: list[list[int]] = []
    for a, b in sorted(zip(first, last)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + length)
        else:
            out.append([a, b + length])
    return [(a, b) for a, b in out]


def _kept(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for start, stop in runs:
        parts.append(data[at:start])
        at = stop
    return b"".join([*parts, data[at:]])


def repeated_bytes(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and SHA-256 of the rest, of every row."""
    meta, texts = repeats(docs, crowd)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                runs = removed_runs(list(r.first), list(r.last))
                rest = _kept(r.text.encode(), runs)
                out.append((r.fid, r.row, sum(b - a for a, b in runs), len(runs), hashlib.sha256(rest).hexdigest()))
            yield pd.DataFrame(out, columns=["fid", "row", "n_removed", "n_spans", "kept"])

    cut = texts.mapInPandas(run, "fid long, row long, n_removed long, n_spans long, kept string")
    return meta.join(cut, ["fid", "row"], "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept", "sha").alias("kept_sha256"),
    )


def drop_repeats(docs: DataFrame, window: Window = WINDOW) -> DataFrame:
    """The documents with repeated strings cut out of their texts, from all places where they are.

    A character of which only some bytes are repeated stays.  Where there is an
    ``n_chars`` column it is counted anew for texts that change.
    """
    keyed = row_keyed(docs)
    _, texts = repeats(keyed, window=window)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                data, inner = r.text.encode(), []
                for start, stop in removed_runs(list(r.first), list(r.last), window.length):
                    while start < stop and data[start] & 0xC0 == 0x80:
                        start += 1
                    while stop > start and stop < len(data) and data[stop] & 0xC0 == 0x80:
                        stop -= 1
                    inner.append((start, stop))
                out.append((r.fid, r.row, _kept(data, inner).decode()))
            yield pd.DataFrame(out, columns=["_fid", "_row", "_rest"])

    cut = texts.mapInPandas(run, "_fid long, _row long, _rest string")
    # The caller's columns travel as one struct, so that none of their names can clash.
    own = keyed.select(F.xxhash64(FILE).alias("_fid"), F.col(ROW).alias("_row"), F.struct(*own_columns(keyed)).alias("_doc"))
    joined = own.join(cut, ["_fid", "_row"], "left")
    columns = []
    for name, kind in docs.dtypes:
        column = F.col("_doc").getField(name)
        if name == "text":
            column = F.coalesce(F.col("_rest"), column)
        elif name == "n_chars":
            column = F.when(F.col("_rest").isNotNull(), F.length("_rest")).otherwise(column).cast(kind)
        columns.append(column.alias(name))
    return joined.select(*columns)
