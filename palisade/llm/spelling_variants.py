"""Grouping spelling variants: words within one edit of each other, by asymmetric q-chunks.

*Chunks and grams.*  A word of length L gives two disjoint chunks, its halves.  The other
word of a pair, of length L or L + 1, gives positional grams of the halves' sizes.  One
inserted, deleted or replaced character leaves at least one half whole, and moves it by at
most one place: the first half to the start, the second to the end of the other word.  Of
all positional grams within shift one only these two can belong to a pair that no other
gram finds (if the first half moved, everything before the second was kept, so that one is
found as well), so only they are made.  Words that meet in a chunk are verified by their
edit distance.

*Common chunks.*  Where the words of a chunk would make more than ``PAIRS`` pairs, they
aren't paired there: what is left of each word beside the chunk is halved again, and the
words meet in chunk and half.  The argument above holds for what is left, so no link is
lost, and it ends where one character is left: a chunk then has no more words than there
are ways to fill that place (the alphabet; its square for the longer words).  Hence no
group of words is ever expanded into all of its pairs, whatever share of the words it has.

*Forms.*  A word's form is its most frequent near word, if that is ``RATIO`` times as
frequent; its root is where following forms ends.  Forms grow more frequent step by step,
so chains are short, and they are followed by doubling.

Words are maximal runs of the letters ``A-Za-z`` and U+00C0 to U+00FF, with A-Z lower-cased.
Null text has no words, a null doc_id counts as an empty string.  Other columns are
ignored; tables without frequent words give no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.session import materialise

MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
#: Pairs of words that one chunk may give before what is left of its words is halved again.
PAIRS = 10_000
#: One in so many occurrences is misspelt in the test of the operator.
MISSPELT = 199


def occurrences(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(doc_id, word) for every run of letters that isn't shorter than ``min_length``."""
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    runs = F.regexp_extract_all(lowered, F.lit(r"[a-zÀ-ÿ]{%d,}" % min_length), F.lit(0))
    return docs.select("doc_id", F.explode(runs).alias("word"))


def misspelt(words: DataFrame) -> DataFrame:
    """The words, of which those with a crc32 of ``doc_id:word`` that 199 divides lose a character."""
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "word")
    rows = words.select("word", F.crc32(name.cast("binary")).alias("h"))
    at = (F.col("h") % F.length("word")).cast("int")
    cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
    return rows.select(F.when(F.col("h") % MISSPELT == 0, cut).otherwise(F.col("word")).alias("word"))


def vocabulary(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter((F.col("n") >= min_count) & (F.length("word") >= min_length))


def _halved(rows: DataFrame) -> DataFrame:
    """Each row with one half or the other of what was left added to what is fixed, and its key.

    ``size`` is the length of the word that gives the chunks, ``head`` and ``tail`` are the
    numbers of characters fixed at both ends.
    """
    left = F.col("size") - F.col("head") - F.col("tail")
    first = F.floor(left / 2).cast("int")
    sides = F.array(
        F.struct((F.col("head") + first).alias("head"), F.col("tail").alias("tail")),
        F.struct(F.col("head").alias("head"), (F.col("tail") + left - first).alias("tail")),
    )
    rows = rows.select("word", "n", "size", F.inline(sides))
    fixed = [F.substring("word", F.lit(1), F.col("head")), F.right("word", F.col("tail"))]
    return rows.withColumn("key", F.concat_ws("|", "size", "head", "tail", *fixed))


def near_pairs(words: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """(a, n_a, b, n_b) for every two words of (word, n) that one edit makes equal, once each."""
    length = F.length("word")
    sizes = F.explode(F.array(length, length - 1)).alias("size")
    rows = words.select("word", "n", sizes, F.lit(0).alias("head"), F.lit(0).alias("tail"))
    found = None
    while True:
        rows = materialise(_halved(rows), "chunks")
        chunk = (F.length("word") == F.col("size")).cast("long")
        groups = rows.groupBy("key").agg(F.sum(chunk).alias("chunks"), F.count(F.lit(1)).alias("grams"))
        # A word makes a pair with the longer ones and, once for both, with those of its length.
        groups = groups.filter("chunks > 0 AND grams > 1").withColumn("pairs", F.expr("chunks * (grams - chunks) + chunks * (chunks - 1) / 2"))
        rows = materialise(rows.join(groups.select("key", "pairs"), "key"), "groups")
        ends = (F.col("pairs") <= pairs) | (F.col("size") - F.col("head") - F.col("tail") <= 1)
        met = _met(rows.filter(ends))
        found = met if found is None else found.unionByName(met)
        rows = rows.filter(~ends)
        if rows.isEmpty():
            return found.distinct()


def _met(rows: DataFrame) -> DataFrame:
    """The verified pairs of words that share a key."""
    one = rows.filter(F.length("word") == F.col("size")).select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
    two = rows.select("key", F.col("word").alias("b"), F.col("n").alias("n_b"))
    order = (F.length("b") > F.length("a")) | (F.col("b") > F.col("a"))
    return one.join(two, "key").filter(order & (F.levenshtein("a", "b", 1) == 1)).select("a", "n_a", "b", "n_b")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words with a form, by doubling the steps until none goes further."""
    roots = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = materialise(roots.join(ahead, "root", "left"), "roots")
        if stepped.filter("next IS NOT NULL").isEmpty():
            return roots
        roots = stepped.select("word", F.coalesce("next", "root").alias("root"))


def variants(words: DataFrame, ratio: int = RATIO, pairs: int = PAIRS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of (word, n)."""
    words = materialise(words.select("word", "n"), "vocabulary")
    near = near_pairs(words, pairs)
    both = near.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("other_n")).unionByName(
        near.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("other_n"))
    )
    best: Column = F.min(F.struct((-F.col("other_n")).alias("less"), "other"))
    stats = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    formed = (-F.col("best.less")) >= ratio * F.col("n")
    rows = words.join(stats, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(formed, F.col("best.other")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n"),
    )
    rows = materialise(rows, "forms")
    roots = _roots(rows.filter("form IS NOT NULL"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def misspelt_variants(docs: DataFrame) -> DataFrame:
    """The variants among the words of ``docs`` once some of their occurrences are misspelt."""
    return variants(vocabulary(misspelt(occurrences(docs))))
