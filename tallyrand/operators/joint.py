"""Many models in one pass: linear models and boosted trees whose sums over the rows are taken together.

Rows are prepared once. Every step of the solver is one job: each task adds up what all problems need of its rows (losses and gradients, or histograms) in one vector, and the vectors are added on the executors
before the driver gets them. A problem is a set of rows, given by a flag of each row, and a set of features.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Generator, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialised

#: Tasks whose vectors go straight to the driver; those of more are added in groups first. Rows of a matrix at a time.
DIRECT, ROWS = 32, 512
#: Scores are whole numbers of 1 / SCORES. They are counted in BINS bins, dealt to slots of about SLOT scores, and sent in blocks for which a task holds HELD of them.
SCORES, BINS, SLOT, HELD = 10**9, 4096, 500_000, 2_000_000
BIN = SCORES // BINS + 1
#: Numbers of a block of packed rows, and those that a task holds to pack them.
BLOCK, PACKED = 1 << 18, 1 << 22
Vector = Callable[[pa.RecordBatch], np.ndarray]


def summed(df: DataFrame, of: Callable[[object], Vector], held: object, parts: int | None = None) -> np.ndarray | None:
    """The sum over all batches of of(held)(batch), float64 vectors of one length; None without rows. held: sent once to every executor.

    Vectors are added in the order of the partitions, so the sum is the same whenever those are. A repeated or lost task counts once.
    """
    sent = df.sparkSession.sparkContext.broadcast(held)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector, total = of(sent.value), None
        for batch in batches:
            if batch.num_rows:
                part = vector(batch)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((at, v) for b in batches for at, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([rows[0][0]], pa.int32()), pa.array([_total(v for _, v in rows).tobytes()], pa.binary())], names=["at", "v"])

    rows = df.mapInArrow(each, "v binary").select(F.spark_partition_id().alias("at"), "v")
    parts = parts or df.rdd.getNumPartitions()
    if parts > DIRECT:
        rows = rows.repartition(math.isqrt(parts), F.pmod("at", F.lit(math.isqrt(parts)))).mapInArrow(merged, "at int, v binary")
    try:
        found = sorted((r.at, bytes(r.v)) for r in rows.collect())
    finally:
        sent.destroy()
    return _total(v for _, v in found) if found else None


def _total(vectors) -> np.ndarray:
    total = None
    for v in vectors:
        part = np.frombuffer(v, np.float64)
        total = part if total is None else total + part
    return total


@dataclass(frozen=True)
class Shape:
    """Columns of the rows: y double, flags array<boolean> (the sets of rows), x array<double> (n_dense features), terms array<int> (indexes below n_terms of features that are 1). scale: what features are multiplied by."""

    n_terms: int
    n_dense: int
    scale: np.ndarray

    @property
    def size(self) -> int:
        return self.n_terms + self.n_dense + 1


@dataclass(frozen=True)
class Problem:
    """flag: its set of rows; features: those that it sees, None for all."""

    flag: int
    features: tuple[int, ...] | None = None


def _lists(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """(values, where each row's begin and end) of an array column; null arrays are empty."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind), np.concatenate([[0], np.cumsum(sizes)])


def margins(shape: Shape, batch: pa.RecordBatch, weights: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of a batch: (rows, margins of every problem, dense features, terms, the row of each term)."""
    names = batch.schema.names
    terms, ends = _lists(batch.column(names.index("terms")), np.int64) if shape.n_terms else (np.empty(0, np.int64), np.zeros(batch.num_rows + 1, np.int64))
    x = _lists(batch.column(names.index("x")), np.float64)[0].reshape(-1, shape.n_dense) if shape.n_dense else np.empty((batch.num_rows, 0))
    scaled = weights[:, :-1] * shape.scale
    by_term, dense = np.ascontiguousarray(scaled[:, : shape.n_terms].T), scaled[:, shape.n_terms :]
    for a in range(0, batch.num_rows, ROWS):
        rows = slice(a, min(a + ROWS, batch.num_rows))
        own, of = terms[ends[a] : ends[rows.stop]], np.repeat(np.arange(rows.stop - a), np.diff(ends[a : rows.stop + 1]))
        z = x[rows] @ dense.T + weights[:, -1]
        if len(own):
            some = by_term[own]
            for p in range(len(weights)):
                z[:, p] += np.bincount(of, some[:, p], rows.stop - a)
        yield rows, z, x[rows], own, of


def losses(shape: Shape, problems: Sequence[Problem], weights: np.ndarray) -> Vector:
    """A batch's [loss, rows, gradient] of every problem, in one vector."""
    flags = [p.flag for p in problems]

    def vector(batch: pa.RecordBatch) -> np.ndarray:
        names = batch.schema.names
        y = batch.column(names.index("y")).to_numpy(zero_copy_only=False)
        used = _lists(batch.column(names.index("flags")), bool)[0].reshape(batch.num_rows, -1)[:, flags]
        out = np.zeros((len(problems), 2 + shape.size))
        for rows, z, x, own, of in margins(shape, batch, weights):
            u, target = used[rows].astype(float), y[rows, None]
            out[:, 0] += (u * (np.logaddexp(0, z) - target * z)).sum(0)
            out[:, 1] += u.sum(0)
            rest = u * (1 / (1 + np.exp(-np.clip(z, -700, 700))) - target)
            for p in range(len(problems)):
                if len(own):
                    out[p, 2 : 2 + shape.n_terms] += np.bincount(own, rest[of, p], shape.n_terms)
            out[:, 2 + shape.n_terms : -1] += rest.T @ x
            out[:, -1] += rest.sum(0)
        out[:, 2:-1] *= shape.scale
        return out.ravel()

    return vector


@dataclass
class _State:
    """One problem's descent: limited-memory quasi-Newton steps, within an orthant where weights have an absolute penalty."""

    w: np.ndarray
    free: np.ndarray
    l1: float
    l2: float
    trial: np.ndarray = None
    value: float = math.inf
    gradient: np.ndarray = None
    step: float = 1.0
    direction: np.ndarray = None
    orthant: np.ndarray = None
    slope: float = 0.0
    steps: list = field(default_factory=list)
    changes: list = field(default_factory=list)
    taken: int = 0
    done: bool = False

    def pseudo(self) -> np.ndarray:
        g = self.gradient.copy()
        if self.l1:
            w, raw = self.w[:-1], self.gradient[:-1]
            at_zero = np.where(raw > self.l1, raw - self.l1, np.where(raw < -self.l1, raw + self.l1, 0.0))
            g[:-1] = np.where(w != 0, raw + self.l1 * np.sign(w), at_zero)
        g[~self.free] = 0
        return g

    def aim(self) -> None:
        g = self.pseudo()
        q, saved = -g, []
        for s, c in zip(reversed(self.steps), reversed(self.changes), strict=True):
            a = (s @ q) / (s @ c)
            saved.append(a)
            q = q - a * c
        if self.steps:
            q = q * (self.steps[-1] @ self.changes[-1]) / (self.changes[-1] @ self.changes[-1])
        for s, c, a in zip(self.steps, self.changes, reversed(saved), strict=True):
            q = q + s * (a - (c @ q) / (s @ c))
        if self.l1:
            q[:-1] = np.where(q[:-1] * g[:-1] < 0, q[:-1], 0.0)
            self.orthant = np.where(self.w[:-1] != 0, np.sign(self.w[:-1]), -np.sign(g[:-1]))
        self.direction, self.slope = q, float(q @ g)
        self.step = 1.0 if self.steps else 1.0 / max(1.0, float(np.linalg.norm(q)))
        if self.slope > -1e-14:
            self.done = True
        else:
            self.move()

    def move(self) -> None:
        self.trial = self.w + self.step * self.direction
        if self.l1:
            self.trial[:-1] = np.where(self.trial[:-1] * self.orthant > 0, self.trial[:-1], 0.0)

    def told(self, loss: float, gradient: np.ndarray, tolerance: float, most: int) -> None:
        """The mean loss and its gradient at the trial point."""
        w = self.trial
        value = loss + self.l1 * float(np.abs(w[:-1]).sum()) + self.l2 / 2 * float(w[:-1] @ w[:-1])
        gradient = gradient.copy()
        gradient[:-1] += self.l2 * w[:-1]
        gradient[~self.free] = 0
        if self.gradient is not None:
            if value > self.value + 1e-4 * min(0.0, float(self.pseudo() @ (w - self.w))):
                self.step /= 2
                self.done = self.step < 1e-10
                self.move()
                return
            s, c = w - self.w, gradient - self.gradient
            if s @ c > 1e-12 * (c @ c):
                self.steps, self.changes = [*self.steps[-9:], s], [*self.changes[-9:], c]
            self.taken += 1
            self.done = self.value - value <= tolerance * max(abs(self.value), abs(value), 1e-6) or self.taken >= most
        self.w, self.value, self.gradient = w, value, gradient
        if not self.done:
            self.aim()


def minimised(evaluate: Callable[[np.ndarray, list[int]], np.ndarray], problems: Sequence[Problem], size: int, *, l1: float = 0.0, l2: float = 0.0, steps: int = 50, tolerance: float = 1e-7) -> np.ndarray:
    """(problems, size) weights, the constant last, that minimise each problem's mean log loss + l1 * |w| + l2 / 2 * w^2.

    evaluate(weights, which) gives [sum of losses, rows, gradient] of those problems, in one pass for all; problems that have ended leave it. A problem without rows keeps weights of 0.
    """
    states = []
    for p in problems:
        free = np.ones(size, bool)
        if p.features is not None:
            free[:-1] = False
            free[list(p.features)] = True
        states.append(_State(np.zeros(size), free, l1, l2, trial=np.zeros(size)))
    while active := [i for i, s in enumerate(states) if not s.done]:
        found = evaluate(np.array([states[i].trial for i in active]), active).reshape(len(active), -1)
        for i, row in zip(active, found, strict=True):
            if row[1] > 0:
                states[i].told(row[0] / row[1], row[2:] / row[1], tolerance, steps)
            else:
                states[i].done = True
    return np.array([s.w for s in states]).reshape(len(problems), size)


def fit(rows: DataFrame, shape: Shape, problems: Sequence[Problem], **options) -> np.ndarray:
    """The weights of all problems over rows (y, flags, x and/or terms), which every step reads once: rows should be written before. Null y's aren't allowed; without rows all weights are 0."""
    columns = ["y", "flags", *(["terms"] if shape.n_terms else []), *(["x"] if shape.n_dense else [])]
    own = rows.select(*columns)
    parts = own.rdd.getNumPartitions()

    def evaluate(weights: np.ndarray, which: list[int]) -> np.ndarray:
        asked = [problems[i] for i in which]
        got = summed(own, lambda held: losses(*held), (shape, asked, weights), parts)
        return np.zeros((len(which), 2 + shape.size)) if got is None else got

    return minimised(evaluate, problems, shape.size, **options)


def predicted(rows: DataFrame, shape: Shape, weights: np.ndarray, keep: Sequence[str]) -> DataFrame:
    """rows' (keep, p): p array<double>, every model's probability of 1."""
    held = rows.sparkSession.sparkContext.broadcast((shape, weights))  # problems x features
    schema = rows.select(*keep).withColumn("p", F.array(F.lit(0.0))).schema
    inputs = [*(["terms"] if shape.n_terms else []), *(["x"] if shape.n_dense else [])]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.concatenate([np.empty((0, len(held.value[1]))), *(1 / (1 + np.exp(-np.clip(z, -700, 700))) for _, z, *_ in margins(held.value[0], batch, held.value[1]))])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], lists], names=[*keep, "p"])

    return rows.select(*keep, *(F.col(c) for c in inputs if c not in keep)).mapInArrow(judged, schema)


def packed(rows: DataFrame, own: str, columns: Sequence[str]) -> DataFrame:
    """(own int, n int, block binary), written: the rows of each set, whose number is in the column ``own``, as matrices of float64 with ``columns`` (numbers and arrays of one length) beside one another.

    A pass over blocks reads arrays instead of rows, and a set's models see their own blocks only.
    """

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        found = [_lists(c, np.float64)[0] if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns[1:]]
        return np.hstack([v.reshape(batch.num_rows, len(v) // batch.num_rows) for v in found])

    def blocks(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        sets, values = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(sets, kind="stable")
        sets, values = sets[order], values[order]
        most = max(1, BLOCK // max(1, values.shape[1]))
        bounds = np.append(np.flatnonzero(np.append(True, sets[1:] != sets[:-1])), len(sets))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            for i in range(a, b, most):
                j = min(i + most, b)
                yield pa.RecordBatch.from_arrays([pa.array([sets[a]], pa.int32()), pa.array([j - i], pa.int32()), pa.array([values[i:j].tobytes()], pa.binary())], names=["own", "n", "block"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            if batch.num_rows:
                parts.append((batch.column(0).to_numpy(zero_copy_only=False), matrix(batch)))
                n += parts[-1][1].size
            if n >= PACKED:
                yield from blocks(parts)
                parts, n = [], 0
        if parts:
            yield from blocks(parts)

    return materialised(rows.select(own, *columns).mapInArrow(pack, "own int, n int, block binary"))


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    for own, n, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
        yield own, np.frombuffer(block.as_buffer(), np.float64).reshape(n, -1)


def fit_sets(rows: DataFrame, shape: Shape, own: str, sets: int, seen: Sequence[Sequence[int] | None], **options) -> np.ndarray:
    """(sets, len(seen), size): the weights of fit() where each row (own, y, x) is in one set, whose number is in the column ``own``, and each set has a model of each of the features ``seen``. A row costs the models of its set, whatever the number of sets."""
    put = packed(rows, own, ["y", "x"])
    parts = put.rdd.getNumPartitions()
    problems = [Problem(k, None if features is None else tuple(features)) for k in range(sets) for features in seen]

    def of(held: tuple[Shape, np.ndarray, np.ndarray]) -> Vector:
        shape, flags, weights = held
        places = {k: np.flatnonzero(flags == k) for k in np.unique(flags).tolist()}

        def vector(batch: pa.RecordBatch) -> np.ndarray:
            out = np.zeros((len(weights), 2 + shape.size))
            for k, block in _blocks(batch):
                if k not in places:
                    continue
                y, x, w, mine = block[:, :1], block[:, 1:], weights[places[k]], np.zeros((len(places[k]), 2 + shape.size))
                z = x @ (w[:, :-1] * shape.scale).T + w[:, -1]
                small = np.exp(-np.abs(z))
                rest = np.where(z >= 0, 1, small) / (1 + small) - y
                mine[:, 0], mine[:, 1] = (np.log1p(small) + np.maximum(z, 0) - y * z).sum(0), len(y)
                mine[:, 2:-1], mine[:, -1] = rest.T @ x * shape.scale, rest.sum(0)
                out[places[k]] += mine
            return out.ravel()

        return vector

    def evaluate(weights: np.ndarray, which: list[int]) -> np.ndarray:
        got = summed(put, of, (shape, np.array([problems[i].flag for i in which]), weights), parts)
        return np.zeros((len(which), 2 + shape.size)) if got is None else got

    return minimised(evaluate, problems, shape.size, **options).reshape(sets, len(seen), shape.size)


def predicted_sets(rows: DataFrame, shape: Shape, weights: np.ndarray, own: str, keep: Sequence[str]) -> DataFrame:
    """rows' (keep, p): p array<double>, the probabilities of 1 by the models fit_sets() of the row's set."""
    held = rows.sparkSession.sparkContext.broadcast((shape, weights))  # sets x models x features
    schema = rows.select(*keep).withColumn("p", F.array(F.lit(0.0))).schema

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, weights = held.value
        for batch in batches:
            which, x = batch.column(len(keep)).to_numpy(zero_copy_only=False), _lists(batch.column(len(keep) + 1), np.float64)[0].reshape(-1, shape.n_dense)
            z = np.zeros((batch.num_rows, weights.shape[1]))
            for k in np.unique(which):
                z[which == k] = x[which == k] @ (weights[k, :, :-1] * shape.scale).T + weights[k, :, -1]
            p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], lists], names=[*keep, "p"])

    return rows.select(*keep, F.col(own).alias("_own"), "x").mapInArrow(judged, schema)


def _tested(shape: Shape, weights: np.ndarray, sets: Sequence[int], batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(problem, scores, labels) of the rows of a batch that the problem's set has."""
    names = batch.schema.names
    y = batch.column(names.index("y")).to_numpy(zero_copy_only=False).astype(np.int64)
    test = _lists(batch.column(names.index("test")), bool)[0].reshape(batch.num_rows, -1)
    for rows, z, *_ in margins(shape, batch, weights):
        scores = np.floor(SCORES / (1 + np.exp(-np.clip(z, -700, 700))) + 0.5).astype(np.int64)
        for j, k in enumerate(sets):
            own = test[rows, k]
            yield j, scores[own, j], y[rows][own]


def _merged(slots: np.ndarray, keys: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (slot, key), in order, and how often each occurs."""
    order = np.argsort(code := slots << 32 | keys)
    code = code[order]
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    n = np.diff(np.append(first, len(code))) if counts is None else np.add.reduceat(counts[order], first)
    return code[first] >> 32, code[first] & 0xFFFFFFFF, n


def held_out_metrics(rows: DataFrame, shape: Shape, weights: np.ndarray, sets: Sequence[int]) -> list[tuple[float | None, float | None]]:
    """Each problem's (AUC, average precision) over the rows (y 0 or 1, test array<boolean>, x and/or terms) whose test[sets[problem]] holds, by scores rounded to 9 digits; None with one class only.

    The scores of all problems are counted in bins first, one vector a task. Bins make slots of about SLOT scores, and each task sends a slot's distinct scores with their counts as arrays; so no problem's scores meet in one task,
    a slot's task holds distinct scores only, of which a bin has no more than BIN, and no row is shuffled for each problem.
    """
    inputs = ["y", "test", *(["terms"] if shape.n_terms else []), *(["x"] if shape.n_dense else [])]
    own, held = rows.select(*inputs), (shape, weights, tuple(sets))

    def counts(sent: tuple) -> Vector:
        def vector(batch: pa.RecordBatch) -> np.ndarray:
            out = np.zeros((len(sent[2]), BINS))
            for j, k, _ in _tested(*sent, batch):
                out[j] += np.bincount(k // BIN, minlength=BINS)
            return out.ravel()

        return vector

    in_bins = summed(own, counts, held)
    if in_bins is None:
        return [(None, None)] * len(sets)
    in_bins = in_bins.reshape(len(sets), BINS)
    slots = ((np.cumsum(in_bins, 1) - in_bins) // SLOT).astype(np.int64)
    begins = np.concatenate([[0], np.cumsum(slots[:, -1] + 1)])
    slots += begins[:-1, None]  # higher scores have higher slots
    sent = rows.sparkSession.sparkContext.broadcast((held, slots))  # problems x BINS

    def block(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        at, keys, n = _merged(*(np.concatenate(x) for x in zip(*parts, strict=True)), None)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        ends, ones = np.append(first[1:], len(at)), keys & 1
        blocks = [np.concatenate([keys[a:b], n[a:b]]).astype(np.uint32).tobytes() for a, b in zip(first, ends, strict=True)]
        columns = [pa.array(at[first]), pa.array(blocks, pa.binary()), pa.array(np.add.reduceat(n * ones, first)), pa.array(np.add.reduceat(n * (1 - ones), first))]
        return pa.RecordBatch.from_arrays(columns, names=["slot", "block", "pos", "neg"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (held, slots), parts, n = sent.value, [], 0
        for batch in batches:
            for j, k, y in _tested(*held, batch):
                if len(k):
                    parts.append((slots[j][k // BIN], 2 * k + y))
                    n += len(k)
                if n >= HELD:
                    yield block(parts)
                    parts, n = [], 0
        if parts:
            yield block(parts)

    dealt = materialised(own.mapInArrow(deal, "slot long, block binary, pos long, neg long").repartition("slot").sortWithinPartitions("slot"))
    sizes = {r["slot"]: (r["pos"], r["neg"]) for r in dealt.groupBy("slot").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).collect()}  # a row a slot
    above, all_ = {}, []
    for j in range(len(sets)):
        p = n = 0
        for slot in range(begins[j + 1] - 1, begins[j] - 1, -1):
            above[slot] = (j, p, n)
            p, n = p + sizes.get(slot, (0, 0))[0], n + sizes.get(slot, (0, 0))[1]
        all_.append((p, n))
    told = rows.sparkSession.sparkContext.broadcast((above, all_))

    def part(slot: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        j, p, n = told.value[0][slot]
        k, ones = keys[::-1] >> 1, keys[::-1] & 1  # falling
        first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        pos, neg = (np.add.reduceat(counts[::-1] * x, first).astype(float) for x in (ones, 1 - ones))
        cp, cn = p + np.cumsum(pos), n + np.cumsum(neg)
        right, precise = float((neg * (cp - pos / 2)).sum()), float((pos / max(1, told.value[1][j][0]) * (cp / (cp + cn))).sum())
        return pa.RecordBatch.from_pydict({"slot": [slot], "won": [right], "precise": [precise]})

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, keys, counts, n = None, [], [], 0

        def whole() -> tuple[np.ndarray, np.ndarray]:
            k, c = np.concatenate(keys), np.concatenate(counts)
            return _merged(np.zeros(len(k), np.int64), k, c)[1:]

        for batch in batches:
            for slot, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if slot != last and last is not None:
                    yield part(last, *whole())
                    keys, counts, n = [], [], 0
                both = np.frombuffer(data.as_buffer(), np.uint32).astype(np.int64).reshape(2, -1)
                last, n = slot, n + both.shape[1]
                keys.append(both[0])
                counts.append(both[1])
                if n >= HELD:
                    k, c = whole()
                    keys, counts, n = [k], [c], 0
        if last is not None:
            yield part(last, *whole())

    won, precise = np.zeros(len(sets)), np.zeros(len(sets))
    for r in sorted(dealt.select("slot", "block").mapInArrow(measured, "slot long, won double, precise double").collect()):  # a row a slot
        won[above[r["slot"]][0]] += r["won"]
        precise[above[r["slot"]][0]] += r["precise"]
    return [(float(won[j]) / (p * n) if p and n else None, float(precise[j]) if p else None) for j, (p, n) in enumerate(all_)]


@dataclass(frozen=True)
class Tree:
    """A complete tree by levels: for node k, its children are 2 k + 1 and 2 k + 2. Rows whose bin is ``cut`` or less go left; those without a value, bin ``missing``, go left where ``left`` says so. Where feature is -1 all go left."""

    depth: int
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    values: np.ndarray

    def node(self, bins: np.ndarray, missing: int, depth: int | None = None) -> np.ndarray:
        """The place in its level that each row has come to."""
        goes_left = np.arange(missing + 1) <= self.cut[:, None]
        goes_left[:, missing] = self.left
        goes_left[self.feature < 0] = True
        after = (2 * np.arange(len(self.feature))[:, None] + np.where(goes_left, 1, 2)).ravel()  # a table, each row is looked up once a level
        at, feature = np.zeros(len(bins), np.int64), np.maximum(self.feature, 0)
        values, first = bins.ravel(), np.arange(len(bins)) * bins.shape[1]
        for _ in range(self.depth if depth is None else depth):
            at = after[at * (missing + 1) + values[first + feature[at]]]
        return at


@dataclass(frozen=True)
class Boosted:
    """The sum of trees over bins, on the scale of log odds."""

    start: float
    trees: tuple[Tree, ...]
    missing: int

    def margin(self, bins: np.ndarray) -> np.ndarray:
        z = np.full(len(bins), self.start)
        for t in self.trees:
            z += t.values[t.node(bins, self.missing) - (2**t.depth - 1)]
        return z


def histograms(model: Boosted, tree: Tree, level: int) -> Callable[..., np.ndarray]:
    """Of rows (bins, y): sums of gradient and hessian for each (node of the level, feature, bin). Where a row stands for several, count says how many and y is their sum."""

    def of(bins: np.ndarray, y: np.ndarray, count: np.ndarray | float = 1.0) -> np.ndarray:
        p = 1 / (1 + np.exp(-np.clip(model.margin(bins), -700, 700)))
        at = tree.node(bins, model.missing, level) - (2**level - 1)
        wide, n = model.missing + 1, bins.shape[1]
        place = ((at[:, None] * n + np.arange(n)) * wide + bins).ravel()
        size = 2**level * n * wide
        return np.concatenate([np.bincount(place, np.repeat(v, n), size) for v in (count * p - y, count * p * (1 - p))])

    return of


def best_splits(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From histograms (node, feature, bin), the last bin for missing values: (feature, cut, whether missing values go left, (node, side, gradient and hessian)). A side needs a hessian of ``least``; feature -1: no split gains."""
    total_g, total_h = g[:, :1].sum(2, keepdims=True), h[:, :1].sum(2, keepdims=True)
    score = lambda a, b: a * a / (b + ridge)
    gains, sums = [], []
    for side in (False, True):  # missing values right, left
        lg, lh = np.cumsum(g[:, :, :-1], 2)[:, :, :-1], np.cumsum(h[:, :, :-1], 2)[:, :, :-1]
        if side:
            lg, lh = lg + g[:, :, -1:], lh + h[:, :, -1:]
        rg, rh = total_g - lg, total_h - lh
        gain = score(lg, lh) + score(rg, rh) - score(total_g, total_h)
        gains.append(np.where((lh >= least) & (rh >= least), gain, -np.inf))
        sums.append((lg, lh))
    n = len(g)
    gain = np.stack(gains, 3).reshape(n, -1)  # feature, cut, side
    best = gain.argmax(1)
    good = gain[np.arange(n), best] > 1e-9
    f, c, s = np.unravel_index(best, (g.shape[1], g.shape[2] - 2, 2))
    children = np.zeros((n, 2, 2))
    for k in range(n):
        left = (sums[s[k]][0][k, f[k], c[k]], sums[s[k]][1][k, f[k], c[k]]) if good[k] else (total_g[k, 0, 0], total_h[k, 0, 0])
        children[k] = left, (total_g[k, 0, 0] - left[0], total_h[k, 0, 0] - left[1])
    return np.where(good, f, -1), np.where(good, c, 0), np.where(good, s == 1, True), children


def boosting(n_features: int, bins: int, rate: float, *, trees: int = 20, depth: int = 3, learning: float = 0.1, ridge: float = 1.0, least: float = 1.0) -> Generator[tuple[Boosted, Tree, int], np.ndarray, Boosted]:
    """Trees on the log loss's gradients: yields (model, tree, level), is sent their histograms() over all rows and returns the model. rate: the share of ones; bins: values from 0 to bins - 1, and ``bins`` for missing ones."""
    model = Boosted(math.log(max(rate, 1e-9) / max(1 - rate, 1e-9)), (), bins)
    for _ in range(trees):
        nodes = 2**depth - 1
        feature, cut, left = np.full(nodes, -1), np.zeros(nodes, np.int64), np.ones(nodes, bool)
        for level in range(depth):
            own = slice(2**level - 1, 2 ** (level + 1) - 1)
            sums = yield model, Tree(depth, feature, cut, left, np.zeros(2**depth)), level
            g, h = sums.reshape(2, 2**level, n_features, bins + 1)
            feature[own], cut[own], left[own], children = best_splits(g, h, ridge, least)
        sums = children.reshape(-1, 2)
        values = np.where(sums[:, 1] > 0, -learning * sums[:, 0] / (sums[:, 1] + ridge), 0.0)
        model = Boosted(model.start, (*model.trees, Tree(depth, feature, cut, left, values)), bins)
    return model


def in_step(evaluate: Callable[[list[tuple[int, Boosted, Tree, int]]], Sequence[np.ndarray]], runs: Sequence[Generator]) -> list[Boosted]:
    """The models of several boosting() runs: what all of them ask next, with the run's number, is evaluated together."""
    models: dict[int, Boosted] = {}
    asked: dict[int, tuple] = {}

    def go(i: int, sums: np.ndarray | None) -> None:
        try:
            asked[i] = runs[i].send(sums)
        except StopIteration as end:
            models[i] = end.value
            asked.pop(i, None)

    for i in range(len(runs)):
        go(i, None)
    while asked:
        which = sorted(asked)
        for i, sums in zip(which, evaluate([(i, *asked[i]) for i in which]), strict=True):
            go(i, sums)
    return [models[i] for i in range(len(runs))]


def boost(evaluate: Callable[[Boosted, Tree, int], np.ndarray], n_features: int, bins: int, rate: float, **options) -> Boosted:
    """One boosting() run; evaluate gives histograms() over all rows."""
    return in_step(lambda asked: [evaluate(*asked[0][1:])], [boosting(n_features, bins, rate, **options)])[0]


def _bins_of(batch: pa.RecordBatch) -> np.ndarray:
    values = _lists(batch.column(batch.schema.names.index("bins")), np.int64)[0]
    return values.reshape(batch.num_rows, -1)


def fit_boosted(rows: DataFrame, n_features: int, bins: int, **options) -> Boosted:
    """Boosted trees over rows (y double, bins array<int>), one job a level. The tables of sums that a task sends have 2^level x features x bins entries."""
    n, ones = rows.agg(F.count("*"), F.sum("y")).first()
    if not n:
        return Boosted(0.0, (), bins)

    def of(held: tuple) -> Vector:
        make = histograms(*held)
        return lambda batch: make(_bins_of(batch), batch.column(batch.schema.names.index("y")).to_numpy(zero_copy_only=False))

    own = rows.select("y", "bins")
    parts = own.rdd.getNumPartitions()
    return boost(lambda model, tree, level: summed(own, of, (model, tree, level), parts), n_features, bins, ones / n, **options)


def predict_boosted(rows: DataFrame, model: Boosted, keep: Sequence[str]) -> DataFrame:
    """rows' (keep, p double)."""
    held = rows.sparkSession.sparkContext.broadcast(model)  # trees x nodes
    schema = rows.select(*keep).withColumn("p", F.lit(0.0)).schema

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = 1 / (1 + np.exp(-np.clip(held.value.margin(_bins_of(batch)), -700, 700))) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(p)], names=[*keep, "p"])

    return rows.select(*keep, *(["bins"] if "bins" not in keep else [])).mapInArrow(judged, schema)


def fit_boosted_sets(rows: DataFrame, n_features: int, bins: int, sets: int, **options) -> list[Boosted]:
    """fit_boosted() for each of the ``sets`` of rows (y, flags, bins), one job a level for all of them. A set without rows has a model without trees."""
    each = F.explode(F.filter(F.transform("flags", lambda used, k: F.when(used, k)), lambda k: k.isNotNull()))
    return fit_boosted_counts(counted(rows.select(each.alias("own"), "bins", "y"), "own"), "own", n_features, bins, sets, **options)


def counted(rows: DataFrame, *by: str) -> DataFrame:
    """(by, bins, n, ones): how many rows (by, y, bins) have the same bins, and the sum of their labels. It is all that boosted trees need to know of them."""
    return rows.groupBy(*by, "bins").agg(F.count("*").alias("n"), F.sum("y").cast("double").alias("ones"))


def fit_boosted_counts(counts: DataFrame, own: str, n_features: int, bins: int, sets: int, **options) -> list[Boosted]:
    """fit_boosted() for each of the ``sets`` of counted() rows, each in the one whose number is in the column ``own``, one job a level for all of them. A task sends the tables of all sets: sets x 2^level x features x bins entries."""
    put = packed(counts, own, ["n", "ones", "bins"])
    parts = put.rdd.getNumPartitions()

    def sums(sets: int) -> Vector:
        def vector(batch: pa.RecordBatch) -> np.ndarray:
            out = np.zeros((sets, 2))
            for k, block in _blocks(batch):
                out[k] += block[:, :2].sum(0)
            return out.ravel()

        return vector

    sizes = summed(put, sums, sets, parts)
    sizes = np.zeros((sets, 2)) if sizes is None else sizes.reshape(sets, 2)
    taught = np.flatnonzero(sizes[:, 0]).tolist()

    def of(held: list[tuple[int, Boosted, Tree, int]]) -> Vector:
        makers = {taught[i]: (at, histograms(*asked)) for at, (i, *asked) in enumerate(held)}
        size = 2 * 2 ** held[0][3] * n_features * (bins + 1)

        def vector(batch: pa.RecordBatch) -> np.ndarray:
            out = np.zeros((len(makers), size))
            for k, block in _blocks(batch):
                at, make = makers[k]
                out[at] += make(block[:, 2:].astype(np.int64), block[:, 1], block[:, 0])
            return out.ravel()

        return vector

    runs = [boosting(n_features, bins, sizes[k, 1] / sizes[k, 0], **options) for k in taught]
    made = in_step(lambda asked: np.split(summed(put, of, asked, parts), len(asked)), runs)  # all runs are at the same level
    return [made[taught.index(k)] if k in taught else Boosted(0.0, (), bins) for k in range(sets)]


def predict_boosted_sets(rows: DataFrame, models: Sequence[Boosted], own: str, keep: Sequence[str]) -> DataFrame:
    """rows' (keep, p double), each by the model whose number stands in the integer column ``own``."""
    held = rows.sparkSession.sparkContext.broadcast(list(models))  # models x trees x nodes
    schema = rows.select(*keep).withColumn("p", F.lit(0.0)).schema

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, z = batch.column(len(keep)).to_numpy(zero_copy_only=False), np.zeros(batch.num_rows)
            bins = _bins_of(batch) if batch.num_rows else None
            for k in np.unique(which):
                z[which == k] = held.value[k].margin(bins[which == k])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))], names=[*keep, "p"])

    return rows.select(*keep, F.col(own).alias("_own"), "bins").mapInArrow(judged, schema)
