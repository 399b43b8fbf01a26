import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from palisade.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string"
LANGUAGE = re.compile("(s?(ua)+)?")
WHITE = " \t\n\x0b\x0c\r"
HASH = lambda s: hashlib.sha256(s.encode()).hexdigest()


def best_audit(rows):
    """Cheapest (cost, audit) by a search over (cost, audit) in order; ``rows`` is (initial, must_go, truncated)."""
    steps = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if i == len(rows) and state in (0, 3):
            return cost, audit
        if (i, state) in done:
            continue
        done.add((i, state))
        for c in "ua":
            if (state, c) in steps:
                heapq.heappush(heap, (cost + 5, audit + "I", i, steps[state, c]))
        if i < len(rows):
            initial, must_go, cut = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state))
            if not must_go:
                for c, letter, price in [(initial, "K", 0), ("u", "R", 1), ("a", "R", 1)]:
                    if (state, c) in steps:
                        heapq.heappush(heap, (cost + price + 5 * cut, audit + letter, i + 1, steps[state, c]))


def exhaustive(rows):
    """The same over every sequence of edits with at most two insertions in one place."""
    found = []
    for edits in itertools.product(["K", "Ru", "Ra", "D"], repeat=len(rows)):
        if any(must_go and e != "D" for (_, must_go, _), e in zip(rows, edits)):
            continue
        for gaps in itertools.product(["", "u", "a", "ua", "au"], repeat=len(rows) + 1):
            roles = gaps[0] + "".join(
                {"K": r[0] if r[0] in "sua" else "x", "Ru": "u", "Ra": "a", "D": ""}[e] + g for r, e, g in zip(rows, edits, gaps[1:])
            )
            if LANGUAGE.fullmatch(roles):
                audit = "I" * len(gaps[0]) + "".join(e[0] + "I" * len(g) for e, g in zip(edits, gaps[1:]))
                cost = sum({"K": 0, "R": 1, "D": 2}[e[0]] + 5 * (r[2] and e != "D") for r, e in zip(rows, edits)) + 5 * audit.count("I")
                found.append((cost, audit))
    return min(found)


def brute(originals, damaged):
    """The contract over plain lists of (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in originals}:
        rows = [(t is not None, t or 0, " " if r is None else r, " " if x is None else x) for c, t, r, x in damaged if c == conv]
        rows.sort(key=lambda r: (*r[:2], r[2].encode(), HASH(r[3])))
        seen, coded, counts = set(), [], dict.fromkeys(["blank", "duplicate", "truncated"], 0)
        for _, _, role, text in rows:
            bare = text.rstrip(WHITE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            coded.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        initials = [c[0] for c in coded]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        turns = [r[1] for r in rows if r[0]]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = best_audit(coded)
        size, left, lines, k = sum(e != "D" for e in audit), iter(rows), [], 0
        for e in audit:
            row = next(left) if e != "I" else None
            if e == "D":
                continue
            role = row[2] if e == "K" else ["user", "assistant"][(k - size % 2) % 2]
            lines.append(f"{role}:{row[3] if row else ''}")
            k += 1
        out[conv] = (gaps, *counts.values(), illegal, cost, audit, HASH("\n".join(lines)))
    return out


def found(df):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r["conv_id"]: tuple(r[n] for n in names) for r in df.collect()}


def random_rows(seed, convs, length):
    draw = random.Random(seed)
    texts = ["Yes.", "No! ", "Why?\n", "cut", "", " \t", "Yes.", "é", None, "x" * 100_000 + "."]
    roles = ["user"] * 6 + ["assistant"] * 6 + ["system", "system", "tool", "User", "", None]
    return [
        (c, draw.choice([t, t, t, t, None, t // 2]), draw.choice(roles), draw.choice(texts) if draw.random() < 0.5 else f"{draw.random()}{draw.choice('.!?x')}")
        for c in convs for t in range(draw.randrange(length))
    ]


@pytest.mark.parametrize("seed", range(3))
def test_chart_equals_exhaustive_search(seed):
    draw = random.Random(seed)
    for _ in range(60):
        rows = [(draw.choice("suax"), draw.random() < 0.2, draw.random() < 0.3) for _ in range(draw.randrange(4))]
        symbols = "".join("d" if go else c.upper() if cut else c for c, go, cut in rows)
        coded = [(c, go, cut and not go) for c, go, cut in rows]
        assert cr.cheapest(cr.chart(symbols) if symbols else cr.EMPTY) == exhaustive(coded) == best_audit(coded)


def test_long_conversations_in_pieces_equal_the_search():
    draw = random.Random(7)
    for size in (9, 17, 64, 301, 1000):
        symbols = "".join(draw.choice("uauauasxUAd") for _ in range(size))
        coded = [(c.lower(), c == "d", c.isupper()) for c in symbols]
        parser, at = cr.Parser(), 0
        while at < size:
            step = draw.randrange(1, 30)
            parser.add(symbols[at : at + step])
            at += step
        assert cr.cheapest(parser.cells()) == best_audit(coded)
        cut = draw.randrange(size)
        left, right = cr.Parser(), cr.Parser()
        left.add(symbols[:cut])
        right.add(symbols[cut:])
        assert cr.cheapest(cr._joined(left.cells(), right.cells())) == best_audit(coded)


def test_repair_equals_brute_force(spark):
    rows = random_rows(1, [*range(60), None], 14) + random_rows(2, [1000], 700)
    rows += rows[::9]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(cr.repair_digests(df, df)) == brute(rows, rows)


def test_damage(spark):
    rows = [(c, t, "assistant", "A. B! C?") for c in range(40) for t in range(8)] + [(None, None, None, None)]
    expected = []
    for c, t, role, text in rows:
        role, text = role or " ", text or " "
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if fault == 4 else role, {1: "", 2: re.sub("[.!?]", "", text)}.get(fault, text))
        expected += [row] * {0: 0, 3: 2}.get(fault, 1)
    assert sorted(map(repr, map(tuple, cr.damage(spark.createDataFrame(rows, SCHEMA)).collect()))) == sorted(map(repr, expected))


def test_pieces_of_one_conversation_in_many_tasks(spark):
    rows = random_rows(3, [5], 2000) + [(5, 9, "user", "again.")] * 300
    spread = spark.createDataFrame(rows, SCHEMA)
    _, repaired = cr.repair(spread)
    roles = "".join(r["role"][0] for r in repaired.orderBy("position").collect())
    assert LANGUAGE.fullmatch(roles) and found(cr.repair_digests(spread, spread)) == brute(rows, rows)


def test_empty_tables_lost_conversations_and_clashing_names(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert cr.repair_digests(empty, empty).count() == 0
    rows = random_rows(4, [1, 2, 3], 9)
    names = ["known", "conv", "sha", "part", "k", "n", "first", "timed", "position", "row", "edit", "symbol", "copy", "fault", "_llm_file"]
    wide = spark.createDataFrame([(*r, *range(len(names))) for r in rows], SCHEMA + "".join(f", {n} long" for n in names))
    assert found(cr.repair_digests(wide, wide)) == brute(rows, rows)
    assert found(cr.repair_digests(wide, wide.filter(F.lit(False)))) == brute(rows, [])
    assert cr.damage(wide).columns == ["conv_id", "turn", "role", "text"]
