"""Logistic regression, one label against the rest, over texts and numbers.

An example is a text's terms and a few numbers of its own. Terms are stored once
per block of examples with the same text, not once per example, and every pass over
the blocks serves all labels: their searches for the least loss (L-BFGS) go on side
by side, and each pass evaluates the points that all of them ask for next. What a
pass sends back is one gradient per label, at most 60,000 terms by 13 labels.

Features are scaled to unit deviation and centred, the penalty is on the scaled
weights, and the search takes the steps that ``pyspark.ml`` takes, so the
coefficients are those of its ``OneVsRest`` over ``LogisticRegression``.
"""

from collections.abc import Generator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers of the examples of one block.
BLOCK = 2048
_PIECE = 1 << 18  # terms or numbers in hand at once
TOLERANCE = 1e-6
MEMORY = 10  # steps that L-BFGS remembers
_KEPT = 20  # losses that are looked back on
_MOST = 10  # tries of a line search

Point = tuple[float, np.ndarray]


class _NoStep(Exception):
    """The line search found nothing lower."""


def _between(low: tuple, high: tuple) -> float:
    """The lowest point of the cubic through both ends, not too near to either."""
    if low[0] > high[0]:
        low, high = high, low
    (s, f, d), (t, g, e) = low[:3], high[:3]
    with np.errstate(all="ignore"):
        one = d + e - 3 * (f - g) / (s - t)
        two = np.sqrt(one * one - d * e)
        at = t - (t - s) * (e + two - one) / (e - d + 2 * two)
    least, most = s + 0.1 * (t - s), s + 0.9 * (t - s)
    return float(least if at < least else most if at > most else at)


def _line(x: np.ndarray, loss: float, grad: np.ndarray, way: np.ndarray, step: float) -> Generator[np.ndarray, Point, tuple]:
    """A step that meets the strong Wolfe conditions, with the point there."""
    slope = float(grad @ way)
    if slope > 0:
        raise _NoStep

    def probe(at):
        point = x + way * at
        value, g = yield point
        return at, value, float(g @ way), point, g

    def zoom(low, high):
        for _ in range(_MOST):
            c = yield from probe(_between(low, high))
            if c[1] > loss + 1e-4 * c[0] * slope or c[1] >= low[1]:
                high = c
            else:
                if abs(c[2]) <= 0.9 * abs(slope):
                    return c
                if c[2] * (high[0] - low[0]) >= 0:
                    high = low
                low = c
        raise _NoStep

    low = (0.0, loss, slope, x, grad)
    for i in range(_MOST):
        c = yield from probe(step)
        if not np.isfinite(c[1]):
            step /= 2
            continue
        if c[1] > loss + 1e-4 * step * slope or (c[1] >= low[1] and i > 0):
            return (yield from zoom(low, c))
        if abs(c[2]) <= 0.9 * abs(slope):
            return c
        if c[2] >= 0:
            return (yield from zoom(c, low))
        low, step = c, step * 1.5
    raise _NoStep


def _direction(grad: np.ndarray, steps: list, changes: list) -> np.ndarray:
    way, parts = grad.copy(), []
    for s, y in zip(reversed(steps), reversed(changes)):
        part = (s @ way) / (s @ y)
        parts.append(part)
        way = way - y * part
    if steps:
        way = way * ((steps[-1] @ changes[-1]) / (changes[-1] @ changes[-1]))
    for s, y, part in zip(steps, changes, reversed(parts)):
        way = way + s * (part - (y @ way) / (s @ y))
    return -way


def search(x: np.ndarray, max_iter: int, tolerance: float = TOLERANCE) -> Generator[np.ndarray, Point, np.ndarray]:
    """L-BFGS from ``x``: yields the points whose loss and gradient it is sent,
    returns the last one."""
    loss, grad = yield x
    first, losses, steps, changes = loss, [np.inf], [], []
    done, failed = 0, False
    while True:
        if done >= max_iter:
            return x
        if len(losses) >= 2 and abs(loss - max(losses)) <= tolerance * first:
            return x
        if np.linalg.norm(grad) < max(tolerance * loss, 1e-8):
            return x
        way = _direction(grad, steps, changes)
        try:
            step, value, _, point, g = yield from _line(x, loss, grad, way, 1.0 if done else 1.0 / np.linalg.norm(way))
            if step * np.linalg.norm(grad) < 1e-10:
                raise _NoStep
        except _NoStep:
            if failed:
                return x
            failed, steps, changes = True, [], []
            continue
        steps, changes = [*steps, point - x][-MEMORY:], [*changes, g - grad][-MEMORY:]
        x, loss, grad = point, value, g
        losses, failed, done = [*losses, loss][-_KEPT:], False, done + 1


def blocks(examples: DataFrame, terms: DataFrame, numbers: int) -> DataFrame:
    """``examples`` (text, label, weight, tail, an array of ``numbers`` doubles)
    and the ``terms`` of their texts (text, terms) as rows of ``indices`` and
    ``values``, and of the labels, weights, squared weights and numbers of some
    examples with that text. Equal examples are one, with their weights added."""
    size = max(1, BLOCK // (numbers + 3))
    equal = examples.groupBy("text", "label", "weight", "tail").agg(F.count("*").alias("_n"))
    # each text in as many blocks as its examples need
    often = equal.groupBy("text").agg(F.ceil(F.count("*") / size).cast("int").alias("_blocks"))
    dealt = equal.join(often, "text").withColumn("_block", F.pmod(F.xxhash64("label", "weight", "tail"), F.col("_blocks")))
    example = F.struct("label", (F.col("weight") * F.col("_n")).alias("w"), (F.col("weight") * F.col("weight") * F.col("_n")).alias("s"), "tail")
    rows = dealt.groupBy("text", "_block").agg(F.collect_list(example).alias("_rows")).join(terms, "text", "left")
    none = F.array().cast("array<struct<idx:int,weight:double>>")
    each = F.coalesce("terms", none)
    return rows.select(
        F.transform(each, lambda t: t["idx"]).alias("indices"),
        F.transform(each, lambda t: t["weight"]).alias("values"),
        F.col("_rows.label").alias("labels"),
        F.col("_rows.w").alias("weights"),
        F.col("_rows.s").alias("squares"),
        F.flatten(F.transform("_rows", lambda r: F.transform(r["tail"], lambda x: F.coalesce(x, F.lit(0.0))))).alias("numbers"),
    )


def _pieces(batches, numbers: int):
    """Terms, their blocks' bounds, and labels, weights, squared weights, numbers
    and blocks of examples, of some blocks at once."""
    for batch in batches:
        lists = [batch.column(i) for i in range(6)]
        flat = [np.asarray(x.flatten()) for x in lists]
        ends = np.cumsum([x.value_lengths().to_numpy() for x in (lists[0], lists[2])], axis=1)
        ends = np.concatenate((np.zeros((2, 1), np.int64), ends), axis=1)
        work = ends[0] + ends[1] * (numbers + 3)
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(work, work[i] + _PIECE, side="right")) - 1)
            (a, b), (c, d) = (e[[i, j]] for e in ends)
            block = np.repeat(np.arange(j - i), np.diff(ends[1][i : j + 1]))
            tail = flat[5][c * numbers : d * numbers].reshape(-1, numbers)
            yield flat[0][a:b], flat[1][a:b], ends[0][i : j + 1] - a, flat[2][c:d], flat[3][c:d], flat[4][c:d], tail, block
            i = j


def _per_block(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between bounds."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]))
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = np.add.reduceat(values, bounds[full])
    return out


def _moments(size: int, numbers: int, centre: np.ndarray):
    """Sums of weight, weighted distance from ``centre`` and its square, of each
    feature where it isn't zero; last, of all weights, squared weights and weights
    by label (``at`` from -2 down)."""

    def work(batches):
        sums, total, squares, labels = np.zeros((size + numbers, 3)), 0.0, 0.0, {}
        for index, value, bounds, label, weight, square, tail, block in _pieces(batches, numbers):
            own = np.repeat(np.bincount(block, weight, len(bounds) - 1), np.diff(bounds))
            off = value - centre[index]
            for k, x in enumerate((own, own * off, own * off * off)):
                sums[:size, k] += np.bincount(index, x, size)
            off, some = tail - centre[size:], weight[:, None] * (tail != 0)
            for k, x in enumerate((some, some * off, some * off * off)):
                sums[size:, k] += x.sum(axis=0)
            total, squares = total + weight.sum(), squares + square.sum()
            for j, x in enumerate(np.bincount(label, weight).tolist()):
                labels[j] = labels.get(j, 0.0) + x
        at = np.flatnonzero(sums[:, 0])
        rows = [sums[at], np.array([[total, squares, 0.0]]), np.array([[x, 0.0, 0.0] for x in labels.values()]).reshape(-1, 3)]
        at = np.concatenate((at, [-1], [-2 - j for j in labels]))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *map(pa.array, np.concatenate(rows).T)], names=["at", "a", "b", "c"])

    return work


def _summed(rows: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places and sums, on the driver: at most one row per feature."""
    table = rows.groupBy("at").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()
    return table.column("at").to_numpy(), np.stack([table.column(c).to_numpy() for c in columns], axis=1)


def _gradients(size: int, numbers: int, weights: np.ndarray, offsets: np.ndarray, chosen: np.ndarray, names: list[str]):
    """Sums of the loss (``at`` -1), of the residuals (-2) and of the features'
    share in them, of each of the ``chosen`` labels at its ``weights`` and ``offsets``."""
    n = len(chosen)

    def work(batches):
        grads, loss, ahead = np.zeros((n, size + numbers)), np.zeros(n), np.zeros(n)
        for index, value, bounds, label, weight, _, tail, block in _pieces(batches, numbers):
            lengths = np.diff(bounds)
            margins = tail @ weights[:, size:].T + offsets
            for j in range(n):
                own = _per_block(value * weights[j, index], bounds)
                margin = margins[:, j] + own[block]
                hit = label == chosen[j]
                loss[j] += weight @ (np.logaddexp(0.0, margin) - hit * margin)
                off = weight * (1.0 / (1.0 + np.exp(-np.clip(margin, -700, 700))) - hit)
                ahead[j] += off.sum()
                grads[j, size:] += off @ tail
                grads[j, :size] += np.bincount(index, value * np.repeat(np.bincount(block, off, len(lengths)), lengths), size)
        at = np.flatnonzero(grads.any(axis=0))
        rows = np.concatenate((grads[:, at], loss[:, None], ahead[:, None]), axis=1)
        at = np.concatenate((at, [-1, -2])).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), *map(pa.array, rows)], names=["at", *names])

    return work


def fit(rows: DataFrame, size: int, numbers: int, labels: int, max_iter: int, reg: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights (one row per label; ``size`` terms, then the numbers) and
    intercepts over the stored ``blocks``. A label without an example gets an
    intercept of minus infinity."""
    width = size + numbers
    columns = "at int, a double, b double, c double"
    mean, spread = np.zeros(width), np.zeros(width)
    for turn in range(2):  # deviations are summed from the means, for exactness
        at, sums = _summed(rows.mapInArrow(_moments(size, numbers, mean), columns), ["a", "b", "c"])
        total, squares = sums[at == -1, :2].sum(axis=0)
        own, values = at[at >= 0], sums[at >= 0]
        if not turn:
            mean[own] = values[:, 1] / total
    by_label = np.zeros(labels)
    by_label[-2 - at[at <= -2]] = sums[at <= -2, 0]
    spread[own] = values[:, 2] + mean[own] ** 2 * np.maximum(total - values[:, 0], 0)
    rest = total - squares / total if total else 0.0
    deviation = np.sqrt(np.maximum(spread, 0) / rest) if rest > 0 else np.zeros(width)
    deviation[deviation <= 1e-12 * np.abs(mean)] = 0  # one value in all examples
    inverse = np.divide(1.0, deviation, out=np.zeros(width), where=deviation > 0)
    centre = mean * inverse

    found, intercepts = np.zeros((labels, width)), np.full(labels, -np.inf)
    searches, points = {}, {}
    for j in range(labels):
        if by_label[j] <= 0:
            continue
        if total - by_label[j] <= 1e-12 * total:
            intercepts[j] = np.inf
            continue
        start = np.zeros(width + 1)
        start[-1] = np.log(by_label[j] / (total - by_label[j]))
        searches[j] = search(start, max_iter)
        points[j] = next(searches[j])
    while points:
        chosen = np.array(sorted(points))
        x = np.stack([points[j] for j in chosen])
        names = [f"l{j}" for j in chosen]
        work = _gradients(size, numbers, x[:, :-1] * inverse, x[:, -1] - x[:, :-1] @ centre, chosen, names)
        fields = ", ".join(["at int", *[f"{n} double" for n in names]])
        at, sums = _summed(rows.mapInArrow(work, fields), names)
        loss, ahead = (sums[at == k].sum(axis=0) / total for k in (-1, -2))
        grads = np.zeros((len(chosen), width + 1))
        grads[:, at[at >= 0]] = sums[at >= 0].T / total
        grads[:, :-1] = grads[:, :-1] * inverse - centre * ahead[:, None] + reg * x[:, :-1]
        grads[:, -1] = ahead
        loss = loss + 0.5 * reg * np.square(x[:, :-1]).sum(axis=1)
        for i, j in enumerate(chosen.tolist()):
            try:
                points[j] = searches[j].send((float(loss[i]), grads[i]))
            except StopIteration as last:
                del points[j]
                found[j] = last.value[:-1] * inverse
                intercepts[j] = last.value[-1] - last.value[:-1] @ centre
    return found, intercepts
