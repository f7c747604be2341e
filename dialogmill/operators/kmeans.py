"""Many K-Means models side by side: a round is one pass over all rows, for every model of every group.

Small groups are fitted by ``fit_rows``, each where its rows lie; it takes the same steps, only that a pass is one over the rows at hand. For others rows are kept in blocks (see ``packed``). Each task adds up its rows for the centres of all models of
its groups, and the driver sums these, a table for each task, and moves the centres, which are few: groups are taken in batches of at most
``CENTRE_BYTES`` of centres, so neither the number of groups nor their size bounds what can be fitted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogmill.tables import ship_package

#: Vectors for each task of an iterative fit, at least: smaller parts cost more to start than to work on.
TASK_ROWS = 50_000
#: Bytes of centres that are sent to the tasks at once.
CENTRE_BYTES = 32 << 20
#: Rows whose distances are worked out together, which a processor's cache holds for all runs of a K.
BLOCK = 512

Segments = Iterator[tuple[int, np.ndarray, np.ndarray]]
#: Of each group the models' centres, and what a pass finds for each: rows nearest to each centre, their sums, the squared distances in all.
Centres = dict[int, list[np.ndarray]]
Found = dict[int, list[tuple[np.ndarray, np.ndarray, float]]]


@dataclass(frozen=True)
class Fitted:
    """Centres of a model, the rows nearest to each, and the sum of squared distances."""

    centres: np.ndarray
    sizes: np.ndarray
    inertia: float


def packed(df: DataFrame, vector: str, group: str | None = None) -> DataFrame:
    """The rows of a fit, kept in memory over the iterations in no more parts than their number is worth; rows of a group lie together.

    They are kept as blocks of rows of one group (``__g``, ``__n`` rows, their vectors and hashes as bytes), which reach the tasks as they are. The hash is
    that of all columns but the vector and the group, ids for the most part, which are the same in every run; without such, that of the vector.
    """
    ship_package(df.sparkSession)
    number = F.lit(0) if group is None else F.col(group)
    key = [c for c in df.columns if c not in (vector, group)] or [vector]
    rows = df.select(number.cast("int").alias("__g"), F.col(vector).alias("__v"), F.xxhash64(*key).alias("__h"))
    parts = max(1, -(-rows.count() // TASK_ROWS))
    dealt = rows.coalesce(parts) if group is None else rows.repartitionByRange(parts, "__g", "__h").sortWithinPartitions("__g")
    return dealt.mapInArrow(_blocks, "__g int, __n int, __v binary, __h binary").cache()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of rows of one group as blocks."""
    for batch in batches:
        if len(batch):
            g, h = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(g)) + 1, [len(g)]])
            cuts = [(start, min(start + BLOCK, to)) for at, to in zip(edges[:-1], edges[1:], strict=True) for start in range(at, to, BLOCK)]
            yield pa.RecordBatch.from_arrays([
                pa.array([g[a] for a, _ in cuts], pa.int32()), pa.array([b - a for a, b in cuts], pa.int32()),
                pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()), pa.array([h[a:b].tobytes() for a, b in cuts], pa.binary()),
            ], ["__g", "__n", "__v", "__h"])


def _segments(batches: Iterator[pa.RecordBatch]) -> Segments:
    """(group, vectors, hashes) of each block."""
    for batch in batches:
        for g, n, x, h in zip(*(batch.column(k) for k in range(4)), strict=True):
            yield g.as_py(), np.frombuffer(x.as_buffer(), float).reshape(n.as_py(), -1), np.frombuffer(h.as_buffer(), np.int64)


def n_rows(vectors: DataFrame) -> int:
    """Rows of packed blocks."""
    return vectors.agg(F.sum("__n")).first()[0] or 0


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1), 0)


def _uniform(h: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1] that follow from hashes and a salt alone, mixed by multiplications and shifts."""
    with np.errstate(over="ignore"):
        z = h.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) % (1 << 64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        z = z ^ (z >> np.uint64(31))
    return ((z >> np.uint64(11)).astype(float) + 1) / float(1 << 53)


def _least(x: np.ndarray, h: np.ndarray, so_far: np.ndarray, step: int, seed: int) -> list[tuple[float, np.ndarray]]:
    """For each run the least score of some rows and the row that has it; of equal scores the least row."""
    runs, out = len(so_far), []
    far = _squared(x, so_far.reshape(-1, x.shape[1])).reshape(len(x), runs, -1).min(axis=2) if step else np.ones((len(x), runs))
    for r in range(runs):
        u = _uniform(h, seed + 1000 * r + step)
        score = np.where(far[:, r] > 0, -np.log(u) / np.maximum(far[:, r], 1e-300), 1e290 * u)
        out.append(min(((float(score[at]), x[at]) for at in np.flatnonzero(score == score.min())), key=lambda row: tuple(row[1])))
    return out


def _drawn(vectors: DataFrame, starts: dict[int, np.ndarray], step: int, seed: int) -> dict[int, np.ndarray]:
    """One further start for each run of each group: a row drawn by its squared distance to the nearest of the run's starts so far.

    The least of -ln(u) / weight over rows falls on each in proportion to its weight; it is a minimum, so tasks and Spark find it
    among all rows without a sample, and the same rows give the same starts however they are dealt.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(starts)
    runs = len(next(iter(starts.values())))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], tuple[float, np.ndarray]] = {}
        for g, x, h in _segments(batches):
            so_far = shared.value.get(g)
            if so_far is None:
                continue
            for r, (score, row) in enumerate(_least(x, h, so_far, step, seed)):
                if (g, r) not in found or (score, tuple(row)) < (found[g, r][0], tuple(found[g, r][1])):
                    found[g, r] = (score, row)
        keys = list(found)
        yield pa.RecordBatch.from_arrays([
            pa.array([g for g, _ in keys], pa.int32()), pa.array([r for _, r in keys], pa.int32()), pa.array([found[k][0] for k in keys], pa.float64()),
            pa.array([found[k][1] for k in keys], pa.list_(pa.float64())),
        ], ["g", "run", "score", "v"])

    drawn = vectors.mapInArrow(least, "g int, run int, score double, v array<double>").groupBy("g", "run").agg(F.min_by("v", F.struct("score", "v")).alias("v"))
    out = {g: np.zeros((runs, step + 1, s.shape[2])) for g, s in starts.items()}
    for g, so_far in starts.items():
        out[g][:, :step] = so_far
    for g, r, v in drawn.collect():  # a row for each run of the groups of this batch
        out[g][r, step] = v
    return out


def _near(x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For models [model, centre, place] of one K: which centre is nearest to each row (1 at it, the first on ties) and half its squared distance less the row's own square."""
    runs, k, d = own.shape
    half = ((own**2).sum(axis=2) / 2).reshape(-1, 1) - own.reshape(-1, d) @ x.T
    half = half.reshape(runs, k, len(x))
    least = half.min(axis=1)
    mine = (half == least[:, None]).astype(float)
    if mine.sum() != least.size:  # ties
        mine = (half.argmin(axis=1)[:, None] == np.arange(k)[None, :, None]).astype(float)
    return mine, least


def _alike(own: Sequence[np.ndarray]) -> Iterator[slice]:
    """Runs of models of one K, which are worked on together."""
    start = 0
    for at in range(1, len(own) + 1):
        if at == len(own) or len(own[at]) != len(own[start]):
            yield slice(start, at)
            start = at


def _summed(x: np.ndarray, own: Sequence[np.ndarray]) -> np.ndarray:
    """Of each centre of some models: rows nearest to it, squared distances (those of a model's rows in all, at its first centre), and the rows' sums."""
    wide, squares, parts = np.column_stack([np.ones(len(x)), x]), (x**2).sum(axis=1), []
    for alike in _alike(own):
        models = np.stack(own[alike])
        mine, least = _near(x, models)
        sums = mine.reshape(-1, len(x)) @ wide
        costs = np.zeros(models.shape[:2])
        costs[:, 0] = np.maximum(squares + 2 * least, 0).sum(axis=1)
        parts.append(np.column_stack([sums[:, 0], costs.ravel(), sums[:, 1:]]))
    return np.concatenate(parts)


def _by_model(table: np.ndarray, own: Sequence[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    parts = np.split(table, np.cumsum([len(centres) for centres in own])[:-1])
    return [(part[:, 0], part[:, 2:], float(part[:, 1].sum())) for part in parts]


def nearest_sums(vectors: DataFrame, models: Centres) -> Found:
    """Of every model of every group: (rows nearest to each centre, their sums, the squared distances in all), from one pass."""
    size = next(iter(models.values()))[0].shape[1]
    shared = vectors.sparkSession.sparkContext.broadcast(models)
    names = ["g", "at", "n", "cost", *(f"s{k}" for k in range(size))]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for g, x, _ in _segments(batches):
            own = shared.value.get(g)
            if own is None:
                continue
            summed = _summed(x, own)
            totals[g] = totals[g] + summed if g in totals else summed
        for g, total in totals.items():
            keys = [pa.array(np.full(len(total), g, np.int32)), pa.array(np.arange(len(total), dtype=np.int32))]
            yield pa.RecordBatch.from_arrays([*keys, *(pa.array(np.ascontiguousarray(v)) for v in total.T)], names)

    schema = "g int, at int, " + ", ".join(f"{n} double" for n in names[2:])
    rows = vectors.mapInArrow(add_up, schema).toPandas().groupby(["g", "at"], as_index=False).sum()  # a row from each task for each centre of its groups
    return {int(g): _by_model(own[names[2:]].to_numpy(), models[int(g)]) for g, own in rows.groupby("g")}


def squared_silhouettes(vectors: DataFrame, models: dict[int, np.ndarray]) -> dict[int, float]:
    """Mean silhouette of all rows (of group 0) with squared distances for the centres of each of some models, as ``ClusteringEvaluator`` has it.

    The mean squared distance to a cluster's rows follows from their number, sum, and sum of squares, so two passes do for all models. A cluster
    of one row counts 0; clusters without rows count for nothing.
    """
    spark, places = vectors.sparkSession, list(models)
    d, centres = models[places[0]].shape[1], [models[p] for p in places]
    shared = spark.sparkContext.broadcast(centres)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for _, x, _ in _segments(batches):
            wide = np.column_stack([np.ones(len(x)), (x**2).sum(axis=1), x])
            total = total + np.concatenate([_near(x, c[None])[0][0] @ wide for c in shared.value])
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["at", "v"])

    summed = vectors.mapInArrow(add_up, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas().sort_values("at")["v"].to_numpy().reshape(-1, d + 2)
    known = spark.sparkContext.broadcast(np.split(summed, np.cumsum([len(c) for c in centres])[:-1]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(places) + 1)
        for _, x, _ in _segments(batches):
            squares = (x**2).sum(axis=1)
            total[-1] += len(x)
            for at, (c, sums) in enumerate(zip(shared.value, known.value, strict=True)):
                mine, n = _near(x, c[None])[0][0].argmax(axis=0), sums[:, 0]
                far = squares + (sums[:, 1:2] - 2 * sums[:, 2:] @ x.T) / np.maximum(n, 1)[:, None]
                own, rows = np.arange(len(x)), n[mine]
                inner = far[mine, own] * rows / np.maximum(rows - 1, 1)
                far[n == 0], far[mine, own] = np.inf, np.inf
                outer = far.min(axis=0)
                with np.errstate(divide="ignore", invalid="ignore"):
                    scores = np.where(inner < outer, 1 - inner / outer, np.where(inner > outer, outer / inner - 1, 0.0))
                total[at] += np.where((rows > 1) & np.isfinite(outer), scores, 0.0).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["at", "v"])

    found = vectors.mapInArrow(judge, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas().sort_values("at")["v"].to_numpy()
    return {p: float(found[at] / found[-1]) for at, p in enumerate(places)}


def _width(vectors: DataFrame) -> int:
    block = vectors.first()
    return len(block["__v"]) // (8 * block["__n"])


def fit_models(vectors: DataFrame, sizes: dict[int, int], ks: Sequence[int], inits: int, seed: int = 42, max_iter: int = 300, tol: float = 1e-4) -> dict[int, dict[int, Fitted]]:
    """Per group and K the best of ``inits`` runs by the sum of squared distances, for every K up to the group's number of rows (``sizes``).

    Starts are drawn from all rows, each by its squared distance to those before it; a run of a smaller K has the first
    of its starts. A run ends when its centres move by less than ``tol`` of the mean variance, as squares; a centre without rows stays.
    """
    if not any(k <= n for n in sizes.values() for k in ks):
        return {}
    return _fit(lambda models: nearest_sums(vectors, models), lambda starts, step: _drawn(vectors, starts, step, seed), _width(vectors), sizes, ks, inits, max_iter, tol)


def fit_rows(x: np.ndarray, h: np.ndarray, ks: Sequence[int], inits: int, seed: int = 42, max_iter: int = 300, tol: float = 1e-4) -> dict[int, Fitted]:
    """``fit_models`` of one group whose rows are at hand, by the same steps."""
    blocks = [slice(start, start + BLOCK) for start in range(0, len(x), BLOCK)]

    def draw(starts: dict[int, np.ndarray], step: int) -> dict[int, np.ndarray]:
        found = zip(*(_least(x[b], h[b], starts[0], step, seed) for b in blocks), strict=True)
        rows = [min(of_run, key=lambda row: (row[0], tuple(row[1])))[1] for of_run in found]
        return {0: np.concatenate([starts[0], np.stack(rows)[:, None]], axis=1)}

    def sums(models: Centres) -> Found:
        return {0: _by_model(sum(_summed(x[b], models[0]) for b in blocks), models[0])}

    return _fit(sums, draw, x.shape[1], {0: len(x)}, ks, inits, max_iter, tol).get(0, {})


def _fit(
    sums: Callable[[Centres], Found], draw: Callable[[dict[int, np.ndarray], int], dict[int, np.ndarray]], width: int, sizes: dict[int, int], ks: Sequence[int], inits: int, max_iter: int, tol: float
) -> dict[int, dict[int, Fitted]]:
    runs_of = {g: [(k, r) for k in ks if k <= n for r in range(inits)] for g, n in sizes.items()}
    groups = [g for g, runs in runs_of.items() if runs]
    if not groups:
        return {}
    moments = sums({g: [np.zeros((1, width))] for g in groups})
    starts = {g: np.zeros((inits, 0, width)) for g in groups}
    for step in range(max(k for g in groups for k, _ in runs_of[g])):
        starts |= draw({g: starts[g] for g in groups if any(k > step for k, _ in runs_of[g])}, step)
    centres = {(g, *run): starts[g][run[1], : run[0]] for g in groups for run in runs_of[g]}
    least = {}
    for g, [(n, total, squares)] in moments.items():
        least[g] = tol * max(squares / n[0] - ((total[0] / n[0]) ** 2).sum(), 0.0) / len(total[0])
    going = {g: list(runs_of[g]) for g in groups}
    for _ in range(max_iter):
        found = sums({g: [centres[(g, *run)] for run in runs] for g, runs in going.items()})
        for g, models in found.items():
            still = []
            for run, (n, total, _) in zip(going[g], models, strict=True):
                new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres[(g, *run)])
                if ((new - centres[(g, *run)]) ** 2).sum() > least[g]:
                    still.append(run)
                centres[(g, *run)] = new
            going[g] = still
        going = {g: runs for g, runs in going.items() if runs}
        if not going:
            break
    best: dict[int, dict[int, Fitted]] = {g: {} for g in groups}
    for g, models in sums({g: [centres[(g, *run)] for run in runs_of[g]] for g in groups}).items():
        for (k, r), (n, _, cost) in zip(runs_of[g], models, strict=True):
            if k not in best[g] or cost < best[g][k].inertia:
                best[g][k] = Fitted(centres[g, k, r], n.astype(int), cost)
    return best


def by_size(model: Fitted) -> np.ndarray:
    """Centres in order of size, then of their coordinates."""
    order = sorted(range(len(model.centres)), key=lambda c: (-model.sizes[c], [round(float(x), 9) for x in model.centres[c]]))
    return model.centres[order]
