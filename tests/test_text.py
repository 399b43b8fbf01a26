import html
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from palisade.functions import text as tx


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


STRINGS = [
    "", "plain", "it's", 'say "hi"', "it's \"both\"", "back\\slash", "a\nb\tc\rd", "bell\x07", "\x7f",
    "caf\u00e9", "nb\u00a0sp", "zw\u200bsp", "\u2028", "\U0001f600", "\U000e0041", "\ufeffbom", "a b", "\x85",
    "'\x00'", "\\'\"\n",
]


def test_repr_is_pythons(spark):
    assert column(spark, STRINGS, tx.python_repr) == [repr(s) for s in STRINGS]


def test_strip_is_pythons(spark):
    values = [f"{a}x {a}y{b}" for a in [" ", "\t\n", "\x1c", "\u3000", "\ufeff", ""] for b in ["\u2009 ", "\x85", ""]]
    assert column(spark, values, tx.strip) == [v.strip() for v in values]


def test_js_trim_differs_on_bom_and_separators(spark):
    assert column(spark, ["\ufeff a \u00a0", "\x1ca\x85"], tx.js_trim) == ["a", "\x1ca\x85"]


def test_html_escape(spark):
    values = ["<b a=\"x\">'&amp;'</b>", "plain"]
    assert column(spark, values, tx.html_escape) == [html.escape(v).replace("&#x27;", "&#039;") for v in values]


@pytest.mark.parametrize("lines", [1, 3, 6])
def test_excerpt_is_the_first_lines(spark, lines):
    values = ["", "a", "a\n", "a\nb\r\nc\rd\u2028e\x0bf\x0cg\nh", "\n\n\n", "1\n2\n3\n4\n5\n6\n", "1\n2\n3\n4\n5\n6\n7", "x\n\ny\n\n"]
    got = column(spark, values, lambda c: tx.excerpt(c, lines))
    assert got == ["\n".join(v.splitlines()[:lines]) for v in values]


def test_risk_bands_and_percent(spark):
    scores = [0.0, 0.45, 0.4500001, 0.7, 0.7000001, 1.0, None]
    assert column(spark, scores, tx.risk_band, "double") == ["low", "low", "elevated", "elevated", "high", "high", None]
    assert column(spark, [0.0, 0.4567, 1.0], tx.percent, "double") == ["0.0%", "45.7%", "100.0%"]


def test_fixed_decimals_round_the_binary_value(spark):
    draw = random.Random(4)
    values = [0.125, 0.145, 0.135, 0.375, 0.005, 0.015, 0.025, 1.0, 0.995, 0.0, 5e-324, 2.0**-9, 2.0**-8 - 2.0**-61, 0.555, 12.345, 99.95, 1023.995]
    values += [draw.random() for _ in range(3000)] + [draw.randrange(2000) / 8 / 25 for _ in range(500)] + [k / 1000 for k in range(5, 1000, 10)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = df.select(
        "v", tx.fixed_decimals(F.col("v"), 2).alias("two"), tx.fixed_decimals(F.col("v"), 1).alias("one"),
        tx.fixed_decimals(F.col("v"), 2, ties_up=True).alias("up"),
    ).collect()
    for r in rows:
        assert r["two"] == f"{r['v']:.2f}" and r["one"] == f"{r['v']:.1f}"
        assert r["up"] == str(Decimal(r["v"]).quantize(Decimal("0.01"), ROUND_HALF_UP))
    odd = spark.createDataFrame([(None,), (-1.0,), (float("nan"),), (2000.0,)], "v double")
    assert [r[0] for r in odd.select(tx.fixed_decimals(F.col("v"), 2)).collect()] == [None] * 4
    assert spark.range(1).select(tx.percent(F.lit(0.0625)), tx.percent(F.lit(0.8))).first()[:] == ("6.3%", "80.0%")


def test_repr_of_every_character(spark):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(map(chr, points[i : i + 2048])) for i in range(0, len(points), 2048)]
    assert column(spark, texts, tx.python_repr) == [repr(t) for t in texts]
    single = [chr(c) for c in points if not c % 97 or 0x2E5E <= c < 0x3000 or c in (0x1C89, 0xA7CB)]
    df = spark.createDataFrame([(t,) for t in single], "t string")
    assert [r["p"] for r in df.select((~F.col("t").rlike(tx.UNPRINTABLE_CLASS)).alias("p")).collect()] == [t.isprintable() for t in single]
