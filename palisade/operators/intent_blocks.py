"""Training with the weights in blocks: no vector of all grams is ever on the driver.

Samples are counted in groups, whose grams are named once for the group: a group keeps
its counts in a few bytes each, and only its list of grams is joined to the vocabulary.
Groups stay where they were dealt to.  The grams are numbered and cut into blocks; a
block holds its part of the weights, the gradient and the optimizer's last steps.  A
pass over the data is one job:

* blocks send each partition of groups the weights of the grams that occur there;
* groups turn them into margins, and residuals into the derivatives of those grams;
* blocks add the derivatives up and make their next vectors and dot products.

So a pass moves two numbers for each gram of a partition, and never a count.

The optimizer is L-BFGS in its vector-free form: the direction is a combination of the
last steps, gradient changes and the gradient, whose coefficients follow from their dot
products alone.  Those products, some five hundred numbers a block, and the intercept are
all that the driver holds.  Blocks are written to the shared folder every few steps; those
after that are made again where an executor is lost.

The objective is that of :func:`palisade.operators.intent_model.train` times ``c * n``:
half the squared norm of the weights plus ``c`` times the weighted log losses.  It is
strongly convex in the weights: the size of its gradient bounds their distance from the
optimum.  :func:`certificate` computes that gradient from any fitted model, whichever way
it was fitted: the optimizer's blocks have no part in it.
"""

from __future__ import annotations

import gc
import pickle
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade import fixed_values as fv
from palisade.functions.gram_encoder import gram_groups
from palisade.operators.intent_features import class_weights, lowered, with_idf
from palisade.operators.intent_model import IntentModel, index_grams
from palisade.session import materialise, remove_path, remove_scratch, shared_dir, ship_package
from palisade.sources.corpus import sides_or_seeds

#: Most grams of a block, steps that the optimizer remembers, and steps after which blocks are written.
BLOCK, STEPS, WRITTEN = 65_536, 20, 8
#: Counts of a partition of groups, of which a task reads one group at a time, and of all groups that are kept in memory.
PART, IN_MEMORY = 32_000_000, 64_000_000
#: Numbers in the lists of a group's grams.
_KINDS = {"at": np.int32, "idx": np.int64, "idf": np.float64, "weight": np.float64}
_DAMPED = np.concatenate([[0.0], 1 + np.log(np.arange(1, 1 << 16))])


class Group(NamedTuple):
    """Samples with their counts, in order of samples.

    Most counts are one and need no number: those are apart.  ``lens`` are the counts of
    each sample, ``cols`` places in the group's list of grams.
    """

    labels: np.ndarray
    weights: np.ndarray
    lens1: np.ndarray
    cols1: np.ndarray
    lens2: np.ndarray
    cols2: np.ndarray
    tf2: np.ndarray

    @classmethod
    def of(cls, labels, weights, n_grams: int, row, gram, tf) -> Group:
        one, gram = tf == 1, gram.astype(np.min_scalar_type(n_grams))
        lens = [np.bincount(row[side], minlength=len(labels)).astype(np.int32) for side in (one, ~one)]
        more = tf[~one]
        return cls(labels, weights, lens[0], gram[one], lens[1], gram[~one], more.astype(np.min_scalar_type(more.max(initial=0))))

    def damped(self) -> np.ndarray:
        """1 + ln tf of the counts above one."""
        return _DAMPED.take(self.tf2) if self.tf2.dtype.itemsize < 4 else 1 + np.log(self.tf2)

    def norms(self, idf: np.ndarray) -> np.ndarray:
        squares = _by_row(np.square(idf.take(self.cols1)), self.lens1) + _by_row(np.square(self.damped() * idf.take(self.cols2)), self.lens2)
        return np.maximum(np.sqrt(squares), np.finfo(float).tiny)

    def slopes(self, v: np.ndarray, norms: np.ndarray, intercept: float) -> tuple[np.ndarray, float, float]:
        """For weights times idf ``v`` of the grams: the loss's derivatives by them over idf, the loss, its derivative by the intercept."""
        cols1, cols2, x2 = self.cols1.astype(np.intp), self.cols2.astype(np.intp), self.damped()
        margin = (_by_row(v.take(cols1), self.lens1) + _by_row(v.take(cols2) * x2, self.lens2)) / norms + intercept
        slope = self.weights * (1 / (1 + np.exp(-margin)) - self.labels)
        r = slope / norms
        by_gram = np.bincount(cols1, np.repeat(r, self.lens1), len(v)) + np.bincount(cols2, np.repeat(r, self.lens2) * x2, len(v))
        return by_gram, float(self.weights @ (np.logaddexp(0, margin) - self.labels * margin)), float(slope.sum())


class Block(NamedTuple):
    """A block's part of the vectors, their dot products, and the losses that came with them."""

    idf: np.ndarray
    w: np.ndarray
    g: np.ndarray
    steps: list[np.ndarray]
    changes: list[np.ndarray]
    dots: np.ndarray
    loss: float
    slope: float


def _by_row(values: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The sums of runs of values of these lengths."""
    sums, some = np.zeros(len(lens)), lens > 0
    if len(values):
        sums[some] = np.add.reduceat(values, (np.cumsum(lens) - lens)[some])
    return sums


def keyed_samples(samples: DataFrame) -> tuple[DataFrame, int]:
    """(sample_id, text, label, class_weight) of the samples with text and label, and their number."""
    both = samples.select("text", F.col("label").cast("double").alias("label")).filter("text IS NOT NULL AND label IS NOT NULL")
    keyed = materialise(both.withColumn("sample_id", F.monotonically_increasing_id()), "samples")
    # One row per label; of a column with more than two, three rows are enough to refuse it.
    weights = {r["label"]: (r["n"], r["weight"]) for r in class_weights(keyed).limit(3).collect()}
    if set(weights) != {0.0, 1.0}:
        raise ValueError(f"training needs both labels 0 and 1, found {sorted(weights)}")
    weight = F.when(F.col("label") == 1, weights[1.0][1]).otherwise(weights[0.0][1])
    return keyed.withColumn("class_weight", weight), sum(n for n, _ in weights.values())


def _groups(keyed: DataFrame) -> DataFrame:
    """(grp, counts, data, grams, dfs): samples counted in groups, each with its grams and in how many of its samples they occur.

    The table of the samples is removed.
    """
    ship_package(keyed.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, labels, weights = (batch[c].to_numpy() for c in ("sample_id", "label", "class_weight"))
            for first, n, grams, row, gram, tf in gram_groups(batch["__text"].tolist()):
                own = slice(first, first + n)
                data = pickle.dumps(tuple(Group.of(labels[own], weights[own], len(grams), row, gram, tf)), protocol=5)
                dfs = np.bincount(gram, minlength=len(grams))
                yield pd.DataFrame({"grp": [int(ids[first])], "counts": [len(row)], "data": [data], "grams": [grams], "dfs": [dfs]})

    texts = keyed.select("sample_id", "label", "class_weight", lowered("text").alias("__text"))
    groups = texts.mapInPandas(count, "grp long, counts long, data binary, grams array<string>, dfs array<long>")
    groups = materialise(groups, "groups", compression="zstd")
    remove_scratch(keyed)
    return groups


def _listed(groups: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """(grp, at, *columns): a table's values for those of a group's grams that it has, as bytes of arrays, and their places in the list."""
    kept = ["at", *columns]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{c: [np.asarray(x, _KINDS[c]).tobytes() for x in batch[c]] for c in kept})

    found = groups.select("grp", F.posexplode("grams").alias("at", "gram")).join(table, "gram")
    lists = found.groupBy("grp").agg(*[F.collect_list(c).alias(c) for c in kept])
    return lists.mapInPandas(pack, ", ".join(["grp long", *(f"{c} binary" for c in kept)]))


def _unpacked(at: bytes | None, **lists: bytes) -> tuple[np.ndarray, ...]:
    """The arrays of :func:`_listed` in order of places."""
    order = np.argsort(np.frombuffer(at or b"", _KINDS["at"]))
    return tuple(np.frombuffer(x or b"", _KINDS[c])[order] for c, x in lists.items())


def _own(key: int) -> int:
    return key


def _by_key(rdd: RDD, n: int) -> RDD:
    """The pairs in the partition that their key numbers."""
    dealt = rdd.partitionBy(n, _own)
    # Read like any other RDD, which has the same lists of pickled items: unions then need no worker to convert one side.
    dealt._jrdd_deserializer = rdd.ctx.serializer
    return dealt


def _kept(rdd: RDD, f: Callable, level: StorageLevel = StorageLevel.MEMORY_AND_DISK_DESER) -> RDD:
    return rdd.mapPartitions(f, preservesPartitioning=True).persist(level)


def _dealt(groups: DataFrame, indexed: DataFrame, parts: int, blocks: int, block: int, level: StorageLevel) -> tuple[RDD, RDD]:
    """Partitions of (places of grams in the partition's own list, norms, group), and what each block sends to them."""
    one = Window.orderBy(F.desc("counts"), "grp")  # large ones to different partitions
    places = groups.select("grp", ((F.row_number().over(one) - 1) % parts).cast("int").alias("p"))
    lists = _listed(groups, indexed, ["idx", "idf"]).join(F.broadcast(places), "grp").select("p", "grp", "at", "idx", "idf")
    data = groups.select("grp", "data").join(F.broadcast(places), "grp").select("p", "grp", "data")
    lists, data = (_by_key(x.rdd.map(lambda r: (r[0], tuple(r)[1:])), parts) for x in (lists, data))

    def own_grams(lists: list[np.ndarray]) -> np.ndarray:
        return np.unique(np.concatenate([np.zeros(0, np.int64), *lists]))

    def ready(items):
        lists, known = {}, None
        for p, (grp, *x) in items:  # all lists, and then the data
            if len(x) > 1:
                lists[grp] = _unpacked(x[0], idx=x[1], idf=x[2])
                continue
            if known is None:
                known = own_grams([idx for idx, _ in lists.values()])
            group = Group(*pickle.loads(x[0]))
            idx, idf = lists.pop(grp, (np.zeros(0, np.int64), np.zeros(0)))
            yield p, (np.searchsorted(known, idx).astype(np.int32), group.norms(idf), group)

    def routed(items):
        p, lists = None, []
        for p, x in items:
            lists.append(np.frombuffer(x[2], _KINDS["idx"]))
        known = own_grams(lists)
        for key in np.unique(known // block).tolist():
            start, stop = np.searchsorted(known, [key * block, (key + 1) * block])
            yield key, (p, (known[start:stop] - key * block).astype(np.int32))

    routes = _kept(_by_key(lists.mapPartitions(routed), blocks), lambda items: items)
    return _kept(lists.union(data), ready, level), routes


def _first_blocks(indexed: DataFrame, block: int, blocks: int) -> RDD:
    """All blocks, with weights of zero."""
    size = F.floor(F.col("idx") / block)
    lists = indexed.groupBy(size.alias("block")).agg(F.collect_list("idx").alias("idx"), F.collect_list("idf").alias("idf"))

    def start(row) -> tuple[int, Block]:
        idf = np.asarray(row["idf"])[np.argsort(np.asarray(row["idx"]))]
        zeros = np.zeros(len(idf))
        return row["block"], Block(idf, zeros, zeros, [], [], np.zeros(0), 0.0, 0.0)

    return _kept(_by_key(lists.rdd.map(start), blocks), lambda items: items)


def _passed(state: RDD, routes: RDD, groups: RDD, intercept: float, direction: list[float], t: float, c: float, first: bool) -> RDD:
    """The blocks after a step of length ``t`` along the combination ``direction`` of steps, changes and gradient."""

    def moved(b: Block) -> np.ndarray:
        return b.w + t * sum((a * x for a, x in zip(direction, (*b.steps, *b.changes, b.g))), np.zeros(len(b.w)))

    def send(items):
        routes = []
        for key, x in items:
            if not isinstance(x, Block):
                routes.append(x)
                continue
            v = moved(x) * x.idf
            for p, at in routes:
                yield p, (key, v[at])

    def derive(items):
        sent, v, total, loss, slope = {}, None, None, 0.0, 0.0
        p = None
        for p, x in items:
            if len(x) == 2:
                sent[x[0]] = x[1]
                continue
            if v is None:
                v = np.concatenate([np.zeros(0), *(sent[key] for key in sorted(sent))])
                total = np.zeros(len(v))
            at, norms, group = x
            by_gram, own_loss, own_slope = group.slopes(v[at], norms, intercept)
            total[at] += by_gram
            loss, slope = loss + own_loss, slope + own_slope
        if total is not None:
            ends = np.cumsum([len(sent[key]) for key in sorted(sent)]).tolist()
            for key, start, end in zip(sorted(sent), [0, *ends], ends):
                yield key, (p, total[start:end], 0.0, 0.0)
            yield 0, (p, None, loss, slope)

    def accept(items):
        routes, sums, loss, slope = {}, None, 0.0, 0.0
        b, parts = None, []
        for key, x in items:
            if isinstance(x, Block):
                b, own, sums = x, key, np.zeros(len(x.w))
            elif len(x) == 2:
                routes[x[0]] = x[1]
            elif b is None or x[1] is None:
                loss, slope = loss + x[2], slope + x[3]
            else:
                sums[routes[x[0]]] += x[1]
        if b is None:
            return
        w = moved(b)
        g = w + c * sums * b.idf
        steps, changes = b.steps, b.changes
        if not first:
            steps, changes = [*steps, w - b.w][-STEPS:], [*changes, g - b.g][-STEPS:]
        basis = np.stack([*steps, *changes, g, w])
        yield own, Block(b.idf, w, g, steps, changes, basis @ basis.T, loss, slope)

    blocks, parts = state.getNumPartitions(), groups.getNumPartitions()
    sent = _by_key(routes.union(state).mapPartitions(send), parts)
    pieces = _by_key(sent.union(groups).mapPartitions(derive), blocks)
    return _kept(routes.union(state).union(pieces), accept)


def _direction(products: np.ndarray, k: int) -> list[float]:
    """Coefficients of the L-BFGS direction over k steps, k changes and the gradient."""
    q, alphas = np.zeros(2 * k + 1), [0.0] * k
    q[2 * k] = 1.0
    for i in reversed(range(k)):
        alphas[i] = products[i] @ q / products[i, k + i]
        q[k + i] -= alphas[i]
    if k:
        q *= products[k - 1, 2 * k - 1] / products[2 * k - 1, 2 * k - 1]
    for i in range(k):
        q[i] += alphas[i] - products[k + i] @ q / products[i, k + i]
    return (-q).tolist()


def train_by_blocks(
    samples: DataFrame | None = None,
    spark: SparkSession | None = None,
    c: float = fv.INVERSE_REGULARISATION,
    max_iter: int = fv.MAX_ITERATIONS,
    tol: float = 1e-6,
    block: int = BLOCK,
    mean_tol: float = 0.0,
) -> IntentModel:
    """Fit the intent model on ``samples(text, label)``, or the seeds, with all vectors in blocks.

    Ends when the gradient's norm is ``tol`` or less, or ``mean_tol`` as that of the mean
    loss and its penalty, after ``max_iter`` steps, or where rounding leaves no step that
    lowers the objective.
    """
    if samples is None:
        samples = sides_or_seeds(spark or SparkSession.active(), None, None)
    model = _fitted(samples, c, max_iter, tol, block, mean_tol)
    _let_go(samples.sparkSession)
    return model


def _let_go(spark: SparkSession) -> None:
    """Shuffle files and kept partitions go when the driver's objects go."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _fitted(samples: DataFrame, c: float, max_iter: int, tol: float, block: int, mean_tol: float) -> IntentModel:
    spark = samples.sparkSession
    sc = spark.sparkContext
    keyed, n_samples = keyed_samples(samples)
    groups = _groups(keyed)
    each = groups.select(F.explode(F.arrays_zip("grams", "dfs")).alias("x")).select("x.grams", "x.dfs")
    counted = each.groupBy(F.col("grams").alias("gram")).agg(F.sum("dfs").alias("df"))
    indexed = materialise(index_grams(with_idf(counted, F.lit(n_samples))), "indexed_vocabulary")
    n_grams, n_counts = indexed.agg(F.count(F.lit(1)), F.sum("df")).first()
    tasks = sc.defaultParallelism
    block = min(block, max(1024, -(-n_grams // tasks)))
    blocks, parts = max(1, -(-n_grams // block)), max(tasks, (n_counts or 0) // PART)
    level = StorageLevel.MEMORY_AND_DISK_DESER if (n_counts or 0) <= IN_MEMORY else StorageLevel.DISK_ONLY
    dealt, routes = _dealt(groups, indexed, parts, blocks, block, level)
    state = _first_blocks(indexed, block, blocks)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))
    tol = max(tol, mean_tol * c * n_samples)

    def evaluated(intercept: float, direction: list[float], t: float, write: bool, first: bool = False) -> tuple[RDD, np.ndarray, float, float]:
        new = _passed(state, routes, dealt, intercept, direction, t, c, first)
        if write:
            new.checkpoint()
        dots, losses, slopes = zip(*new.map(lambda x: x[1][5:]).collect())
        if write:
            _let_go(spark)
        return new, sum(dots), sum(losses), sum(slopes)

    intercept, own_steps, own_changes, written = 0.0, [], [], None
    old, (state, products, loss, slope) = state, evaluated(intercept, [0.0], 0.0, False, first=True)
    old.unpersist()
    value, g_own = c * loss, c * slope
    for step in range(1, max_iter + 1):
        k = len(own_steps)
        # The intercept is one more place of every vector; it isn't penalised, so it is none of the weights'.
        own = np.array([*own_steps, *own_changes, g_own, 0.0])
        weights_norm = products[-1, -1]
        full = products + np.outer(own, own)
        if full[2 * k, 2 * k] <= tol * tol:
            break
        inner = full[: 2 * k + 1, : 2 * k + 1]
        direction = _direction(inner, k)
        d_own = float(np.dot(direction, own[: 2 * k + 1]))
        descent = float(inner[2 * k] @ direction)
        d = np.array(direction)
        w_d, d_d = products[-1, : 2 * k + 1] @ d, d @ products[: 2 * k + 1, : 2 * k + 1] @ d
        t = 1.0 if k else 1.0 / max(1.0, full[0, 0] ** 0.5)
        for _ in range(30):
            new, new_products, loss, slope = evaluated(intercept + t * d_own, direction, t, step % WRITTEN == 0)
            new_value = c * loss + (weights_norm + 2 * t * w_d + t * t * d_d) / 2
            if new_value <= value + 1e-4 * t * descent + 1e-13 * abs(value):
                break
            new.unpersist()
            if new.getCheckpointFile():
                remove_path(spark, new.getCheckpointFile())
            t /= 2
        else:
            break
        old, state, products = state, new, new_products
        old.unpersist()
        if state.getCheckpointFile():
            if written:
                remove_path(spark, written)
            written = state.getCheckpointFile()
        own_steps, own_changes = [*own_steps, t * d_own][-STEPS:], [*own_changes, c * slope - g_own][-STEPS:]
        intercept, value, g_own = intercept + t * d_own, new_value, c * slope

    def spelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, w in zip(batch["block"], batch["w"]):
                weight = np.frombuffer(w)
                yield pd.DataFrame({"idx": key * block + np.arange(len(weight)), "weight": weight})

    weights = spark.createDataFrame(state.map(lambda x: (x[0], bytearray(x[1].w.tobytes()))), "block long, w binary")
    by_index = weights.mapInPandas(spelled, "idx long, weight double")
    grams = materialise(indexed.join(by_index, "idx").select("gram", "idf", "weight"), "model_grams")
    for kept in (state, dealt, routes):
        kept.unpersist()
    if written:
        remove_path(spark, written)
    for table in (groups, indexed):
        remove_scratch(table)
    return IntentModel(grams, intercept, n_grams, n_samples)


def certificate(model: IntentModel, samples: DataFrame, c: float = fv.INVERSE_REGULARISATION) -> DataFrame:
    """One row (n_grams, n_samples, gradient): the largest derivative of the objective at the model.

    The samples are counted anew and the model's grams joined to those of each group by
    their text; the optimizer's own tables and blocks have no part in it.
    """
    keyed, _ = keyed_samples(samples)
    groups = _groups(keyed)
    listed = _listed(groups, model.grams, ["idf", "weight"])
    intercept = float(model.intercept)

    def derive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for grp, data, n, at, idf, weight in zip(*(batch[x] for x in ("grp", "data", "n", "at", "idf", "weight"))):
                group, known = Group(*pickle.loads(data)), np.sort(np.frombuffer(at or b"", _KINDS["at"]))
                idfs, weights = np.zeros(n), np.zeros(n)
                idfs[known], weights[known] = _unpacked(at, idf=idf, weight=weight)
                by_gram, _, slope = group.slopes(weights * idfs, group.norms(idfs), intercept)
                yield pd.DataFrame({"grp": [grp], "d": [by_gram * idfs], "slope": [slope], "n": [len(group.labels)]})

    joined = groups.select("grp", "data", F.size("grams").alias("n")).join(listed, "grp", "left")
    found = materialise(joined.mapInPandas(derive, "grp long, d array<double>, slope double, n long"), "derivatives")
    each = groups.select("grp", "grams").join(found.select("grp", "d"), "grp").select(F.explode(F.arrays_zip("grams", "d")).alias("x"))
    by_gram = each.groupBy(F.col("x.grams").alias("gram")).agg(F.sum("x.d").alias("d"))
    each = model.grams.join(by_gram, "gram", "left").select((F.col("weight") + c * F.coalesce("d", F.lit(0.0))).alias("d"))
    of_grams = each.agg(F.count(F.lit(1)).alias("n_grams"), F.max(F.abs("d")).alias("grams"))
    of_intercept = found.agg(F.sum("n").alias("n_samples"), F.abs(F.sum("slope") * c).alias("own"))
    both = of_grams.withColumn("one", F.lit(1)).join(of_intercept.withColumn("one", F.lit(1)), "one")
    return both.select("n_grams", "n_samples", F.greatest("grams", "own").alias("gradient"))
