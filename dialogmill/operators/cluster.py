"""K-Means, the choice of K, and a model of its own for each of many groups."""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from dialogmill.operators import kmeans
from dialogmill.operators.kmeans import Fitted
from dialogmill.tables import discard, numbered, same, ship_package, written


def fit_kmeans(df: DataFrame, ks: Sequence[int], vector: str = "pcs", inits: int = 3, seed: int = 42, max_iter: int = 300, tol: float = 1e-4) -> dict[int, Fitted]:
    """The best of ``inits`` runs for each K, by the sum of squared distances; all runs of all K share each pass over the rows.

    First centres are drawn from all rows, by their squared distance to those before them.
    """
    vectors = kmeans.packed(df, vector)
    try:
        return kmeans.fit_models(vectors, {0: kmeans.n_rows(vectors)}, ks, inits, seed, max_iter, tol).get(0, {})
    finally:
        vectors.unpersist()


def inertia_curve(df: DataFrame, ks: Sequence[int], vector: str = "pcs", inits: int = 3, seed: int = 42) -> list[tuple[int, float]]:
    """(k, inertia) of the best run for each K."""
    found = fit_kmeans(df, ks, vector, inits, seed)
    return [(k, found[k].inertia) for k in ks]


def silhouette_curve(df: DataFrame, ks: Sequence[int], vector: str = "pcs", dims: int = 5, inits: int = 1) -> list[tuple[int, float]]:
    """(k, silhouette) over the first ``dims`` coordinates of all rows, with squared distances, as Spark's evaluator has them."""
    cut = written(df.withColumn(vector, F.slice(vector, 1, dims)), "cut")
    vectors = kmeans.packed(cut, vector)
    try:
        models = kmeans.fit_models(vectors, {0: kmeans.n_rows(vectors)}, ks, inits).get(0, {})
        found = kmeans.squared_silhouettes(vectors, {k: models[k].centres for k in ks}) if ks else {}
        return [(k, found[k]) for k in ks]
    finally:
        vectors.unpersist()
        discard(cut)


def elbow_votes(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, by_curvature, by_distance, by_slope, chosen) of a table (by, k, inertia), a row per K.

    Curvature: the place of the greatest second difference, plus two. Distance: the point farthest from the chord of
    the scaled curve. Slope: the place of the greatest change of the absolute slope, plus one. Places stop at the
    last K; with under three points all take the first. Two equal votes win, else the middle one.
    """
    line = Window.partitionBy(*by).orderBy("k")
    whole = Window.partitionBy(*by)
    at = F.row_number().over(line) - 1
    ahead = lambda n: F.lead("inertia", n).over(line)
    slope = lambda n: F.abs((ahead(n + 1) - (ahead(n) if n else F.col("inertia"))) / (F.lead("k", n + 1).over(line) - (F.lead("k", n).over(line) if n else F.col("k"))))
    marked = curve.select(
        *by, "k", at.alias("at"), F.count(F.lit(1)).over(whole).alias("n"), (ahead(2) - 2 * ahead(1) + F.col("inertia")).alias("curvature"), F.abs(slope(1) - slope(0)).alias("bend"),
        ((F.col("k") - F.min("k").over(whole)) / (F.max("k").over(whole) - F.min("k").over(whole))).alias("x"),
        ((F.col("inertia") - F.min("inertia").over(whole)) / (F.max("inertia").over(whole) - F.min("inertia").over(whole))).alias("y"),
    )
    y0, y1 = F.first("y").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.last("y").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    marked = marked.withColumn("off", F.round(F.abs((F.col("y") - y0) - F.col("x") * (y1 - y0)), 12))
    first = lambda column: F.min_by("at", F.struct(-F.col(column), F.col("at")))
    picked = marked.groupBy(*by).agg(
        F.max("n").alias("n"), F.min("k").alias("low"), F.sort_array(F.collect_list("k")).alias("ks"),
        F.min_by("at", F.when(F.col("curvature").isNotNull(), F.struct(-F.col("curvature"), F.col("at")))).alias("a"), first("off").alias("b"),
        F.min_by("at", F.when(F.col("bend").isNotNull(), F.struct(-F.col("bend"), F.col("at")))).alias("c"),
    )
    vote = lambda place: F.when(F.col("n") < 3, F.col("low")).otherwise(F.get("ks", F.least(place, F.col("n").cast("int") - 1)))
    votes = picked.select(*by, vote(F.col("a") + 2).alias("by_curvature"), vote(F.col("b")).alias("by_distance"), vote(F.col("c") + 1).alias("by_slope"))
    middle = F.get(F.sort_array(F.array("by_curvature", "by_distance", "by_slope")), F.lit(1))  # also the value of any two that agree
    return votes.withColumn("chosen", middle)


def inertia_reduction(curve: DataFrame) -> DataFrame:
    """Adds the fall from the K before, in per cent."""
    before = F.lag("inertia").over(Window.orderBy("k"))
    return curve.withColumn("reduction_percent", 100.0 * (before - F.col("inertia")) / before)


#: Coordinates of all centres whose distances are spelt out as arithmetic, which Spark compiles; it doesn't compile functions of arrays.
SPELT_OUT = 150


def nearest_centroid(df: DataFrame, centres: Sequence[Sequence[float]], vector: str, out: str = "cluster") -> DataFrame:
    """Adds the place of the nearest of some fixed centres, the first on ties."""
    if sum(len(c) for c in centres) <= SPELT_OUT:
        far = [reduce(operator.add, [(F.get(vector, F.lit(j)) - float(x)) * (F.get(vector, F.lit(j)) - float(x)) for j, x in enumerate(c)], F.lit(0.0)) for c in centres]
    else:
        far = [F.aggregate(F.zip_with(vector, F.array(*[F.lit(float(x)) for x in c]), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d) for c in centres]
    return df.withColumn("__far", F.array(*far)).withColumn(out, (F.array_position("__far", F.array_min("__far")) - 1).cast("int")).drop("__far")


def label_clusters(df: DataFrame, k: int, extra_k: Sequence[int] = (2, 3, 4), vector: str = "pcs", inits: int = 3, seed: int = 42, models: dict[int, Fitted] | None = None) -> DataFrame:
    """Adds cluster and cluster_k2, cluster_k3, ...: labels in order of size, then of the centre's coordinates; a K above the number of rows is left out.

    ``models`` of ``fit_kmeans`` on the same rows, with the same ``inits`` and ``seed``, aren't fitted again.
    """
    n, known = df.count(), models or {}
    wanted = [x for x in dict.fromkeys([k, *extra_k]) if x <= n]
    missing = [x for x in wanted if x not in known]
    if missing and n:
        known = {**known, **fit_kmeans(df, missing, vector, inits, seed)}
    out = df
    for number in wanted:
        if number == k:
            out = nearest_centroid(out, kmeans.by_size(known[number]), vector, "cluster")
        if number in extra_k:
            out = nearest_centroid(out, kmeans.by_size(known[number]), vector, f"cluster_k{number}")
    return out


#: Different vectors of a strip, at most: a task holds the sums of their distances while all vectors pass by.
STRIP_ROWS = 100_000
#: Points that a block of a strip meets at once, so that their distances stay in a processor's cache.
TILE = 256


def _distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Plain distances of rows to points, from products; those of close pairs, whose squares cancel out, from differences."""
    middle = x.mean(axis=0)
    a, b = x - middle, points - middle
    squares, others = (a**2).sum(axis=1), (b**2).sum(axis=1)
    far = np.column_stack([a, squares, np.ones(len(a))]) @ np.column_stack([-2 * b, np.ones(len(b)), others]).T
    close = np.flatnonzero(far < 1e-6 * (squares.max() + others.max()))
    if len(close):
        row, point = np.divmod(close, len(points))
        far.reshape(-1)[close] = ((x[row] - points[point]) ** 2).sum(axis=1)
    return np.sqrt(far, out=far)


def _add_distances(sums: np.ndarray, x: np.ndarray, points: np.ndarray, counts: np.ndarray, places: np.ndarray) -> None:
    """Adds the distances of rows to points to ``sums`` [cluster of any labelling, row]; ``places`` has the clusters of each point, ``counts`` how often it counts."""
    far = _distances(x, points)
    edges = [0, *(np.flatnonzero((places[1:] != places[:-1]).any(axis=1)) + 1), len(points)]
    for start, to in pairwise(edges):  # points of the same clusters lie together
        sums[places[start]] += far[:, start:to] @ counts[start:to]


def _plain_scores(sums: np.ndarray, own: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The silhouette of each row, from its sums of distances to the clusters of one labelling, which cluster is its own, and the clusters' sizes."""
    at = np.arange(len(own))
    inner = sums[own, at] / np.maximum(sizes[own] - 1, 1)
    means = sums / sizes[:, None]
    means[own, at] = np.inf
    outer = means.min(axis=0)
    return np.where((sizes[own] > 1) & np.isfinite(outer), (outer - inner) / np.maximum(np.maximum(inner, outer), 1e-300), 0.0)


def plain_silhouettes(rows: DataFrame, labels: Sequence[str], vector: str = "pcs", sample_rows: int | None = None, block: int = 512, weight: str | None = None) -> dict[str, float]:
    """Mean silhouette with plain distances of all rows for each of some columns of labels; a cluster of one row counts 0.

    Every row is set against every other. Equal vectors of the same clusters are counted first and stand for one another, which changes no sum; so the work is the
    square of the number of different ones. These are numbered in order of their clusters and dealt in strips of neighbours, and all pass by each strip in batches:
    a task holds its strip and the sums of its distances to each cluster, whatever the size of the table, and only the strips' totals come to the driver.

    ``weight`` is a column of counts, without one each row counts once; ``sample_rows``, if given, judges only so many rows, first by hash.
    """
    spark = rows.sparkSession
    ship_package(spark)
    if sample_rows is not None:
        key = [c for c in rows.columns if c not in (vector, *labels)] or [vector]
        rows = rows.orderBy(F.xxhash64(*key), *key).limit(sample_rows)
    if not labels:
        return {}
    kinds = F.array(*[F.col(c).cast("int") for c in labels]).alias("__labels")
    counted = written(rows.groupBy(kinds, F.col(vector).alias("__v")).agg((F.sum(weight) if weight else F.count(F.lit(1))).cast("double").alias("__n")), "counted")
    placed = written(numbered(counted, ["__labels", "__v"], "__at"), "placed")
    n = placed.count()
    if not n:
        discard(counted, placed)
        return {}
    found = placed.select("__n", F.posexplode("__labels").alias("kind", "label")).groupBy("kind", "label").agg(F.sum("__n").alias("n")).toPandas().sort_values(["kind", "label"])  # a row for each cluster
    known = [(own["label"].to_numpy(), own["n"].to_numpy()) for _, own in found.groupby("kind")]
    starts = np.cumsum([0, *(len(names) for names, _ in known)])

    strips = max(-(-n // STRIP_ROWS), min(2 * spark.sparkContext.defaultParallelism, -(-n // 1000)))
    columns = ["__at", "__v", "__n", "__labels"]
    own = placed.select(F.expr(f"CAST((__at - 1) * {strips} DIV {n} AS INT)").alias("__strip"), F.lit(False).alias("__met"), *columns)
    met = placed.select(F.explode(F.expr(f"sequence(0, {strips - 1})")).alias("__strip"), F.lit(True).alias("__met"), *columns)
    dealt = own.union(met).repartitionById(strips, F.col("__strip")).sortWithinPartitions("__strip", "__met", "__at")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray, np.ndarray]]:
        """(strip, whether its rows meet these, vectors, counts, clusters) of the runs of each batch."""
        for batch in batches:
            if len(batch):
                strip, meets, counts = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("__strip", "__met", "__n"))
                x, kinds = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1) for c in ("__v", "__labels"))
                places = np.column_stack([start + np.searchsorted(names, kinds[:, k]) for k, (start, (names, _)) in enumerate(zip(starts[:-1], known, strict=True))])
                edges = [0, *(np.flatnonzero((strip[1:] != strip[:-1]) | (meets[1:] != meets[:-1])) + 1), len(batch)]
                for a, b in pairwise(edges):
                    yield int(strip[a]), bool(meets[a]), x[a:b], counts[a:b], places[a:b]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (strip, meets), parts in groupby(pieces(batches), key=lambda piece: piece[:2]):
            if not meets:
                x, counts, places = (np.concatenate(v) for v in zip(*(piece[2:] for piece in parts), strict=True))
                continue
            sums = np.zeros((starts[-1], len(x)))
            for _, _, points, weights, where in parts:
                for at in (slice(a, a + TILE) for a in range(0, len(points), TILE)):
                    for mine in (slice(a, a + block) for a in range(0, len(x), block)):
                        _add_distances(sums[:, mine], x[mine], points[at], weights[at], where[at])
            scores = [float(counts @ _plain_scores(sums[a:b], places[:, k] - a, known[k][1])) for k, (a, b) in enumerate(pairwise(starts))]
            yield pa.RecordBatch.from_arrays([pa.array([strip], pa.int32()), pa.array([scores], pa.list_(pa.float64()))], ["strip", "scores"])

    totals = [r["scores"] for r in dealt.mapInArrow(judge, "strip int, scores array<double>").collect()]  # a row for each strip
    discard(counted, placed)
    return {c: math.fsum(t[k] for t in totals) / float(known[k][1].sum()) for k, c in enumerate(labels)}


def silhouette_choice(df: DataFrame, ks: Sequence[int], vector: str = "pcs", dims: int = 5, inits: int = 10, seed: int = 42) -> list[tuple[int, float, bool]]:
    """(k, silhouette, chosen) for each K over the first ``dims`` coordinates, with plain distances; the greatest is chosen, the smallest K of equal ones.

    Models are fitted to all rows, and all rows are judged, by ``plain_silhouettes``.
    """
    cut = written(df.withColumn(vector, F.slice(vector, 1, dims)), "cut")
    models = fit_kmeans(cut, ks, vector, inits, seed)
    counted = written(cut.groupBy(vector).agg(F.count(F.lit(1)).alias("__rows")), "vectors")
    labelled = reduce(lambda rows, k: nearest_centroid(rows, models[k].centres, vector, f"__k{k}"), models, counted)
    found = plain_silhouettes(labelled, [f"__k{k}" for k in models], vector, weight="__rows")
    discard(cut, counted)
    best = max(models, key=lambda k: (found[f"__k{k}"], -k), default=None)
    return [(k, found[f"__k{k}"], k == best) for k in models]


#: Rows that aren't fitted: why they have no cluster.
SKIPPED, FAILED = "skipped", "failed: null or non-finite numbers"


def _project(rows: DataFrame, turn: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """``keep`` and an array ``__x`` of the rows of some groups: less the group's means, by its deviations, turned by its matrix."""
    shared = rows.sparkSession.sparkContext.broadcast(turn)
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("__x", T.ArrayType(T.DoubleType()))])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = batch.column("__g").to_numpy()
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])
            out = np.empty((len(x), next(iter(shared.value.values()))[2].shape[1]))
            for own in np.unique(g):
                mean, scale, matrix = shared.value[int(own)]
                out[g == own] = ((x[g == own] - mean) * scale) @ matrix
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), out.shape[1]).cast(pa.list_(pa.float64()))], [*keep, "__x"])

    return rows.select(*keep, *[c for c in columns if c not in keep]).mapInArrow(project, schema)


def _products(scaled: DataFrame, d: int) -> dict[int, np.ndarray]:
    """Sums of the products of each two columns, for each group."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            g = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), d)
            for own in np.unique(g):
                part = x[g == own]
                totals[int(own)] = totals.get(int(own), 0) + part.T @ part
        for g, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, g, np.int32)), pa.array(np.arange(d * d, dtype=np.int32)), pa.array(total.ravel())], ["g", "at", "v"])

    sums = scaled.select("__g", "__x").mapInArrow(add_up, "g int, at int, v double").groupBy("g", "at").agg(F.sum("v").alias("v")).toPandas().sort_values(["g", "at"])
    return {int(g): own["v"].to_numpy().reshape(d, d) for g, own in sums.groupby("g")}


def _axes(products: np.ndarray, variance: float | None) -> np.ndarray:
    """Principal axes of scaled columns, as many as reach ``variance`` of the whole (all without one); the others are nought."""
    values, vectors = np.linalg.eigh(products)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    vectors = vectors * np.sign(vectors[np.abs(vectors).round(9).argmax(axis=0), np.arange(len(values))])  # equal ones, but for rounding, go by place
    reached = np.cumsum(values) / max(values.sum(), 1e-300)
    used = len(values) if variance is None else min(len(values), int(np.searchsorted(reached, variance - 1e-12)) + 1)
    return vectors * (np.arange(len(values)) < used)


def _assigned(vectors: DataFrame, centres: dict[int, np.ndarray], keep: Sequence[str]) -> DataFrame:
    """``keep`` and the place of the nearest of the group's centres."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)
    schema = T.StructType([*(vectors.schema[c] for c in keep), T.StructField("cluster", T.IntegerType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = batch.column("__g").to_numpy()
            x = batch.column("__x").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            near = np.empty(len(batch), np.int32)
            for own in np.unique(g):
                near[g == own] = _nearest(x[g == own], shared.value[int(own)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(near)], [*keep, "cluster"])

    return vectors.mapInArrow(assign, schema)


#: Groups of up to so many rows are fitted each where its rows lie; larger ones in rounds over all tasks. Both take the same steps.
GROUP_ROWS = 10_000


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1).astype(np.int32)


def _small_groups(rows: DataFrame, columns: Sequence[str], ks: Sequence[int], inits: int, variance: float | None, spare: int, seed: int) -> DataFrame:
    """(__group, __id, __labels, __curve): the labels of each row for each K up to the group's rows less ``spare``; a row of each group has the inertias.

    A group's rows come together in one task, which works on them alone.
    """
    parts = max(1, -(-rows.count() // kmeans.TASK_ROWS))
    labels = T.StructField("__labels", T.ArrayType(T.IntegerType()))
    schema = T.StructType([rows.schema["__group"], rows.schema["__id"], labels, T.StructField("__curve", T.ArrayType(T.DoubleType()))])

    def fit(own: pa.Table) -> pa.Table:
        x = np.column_stack([own.column(c).to_numpy() for c in columns])
        centred = x - x[0]  # so that a constant column's mean is exact
        centred = centred - centred.mean(axis=0)
        scale = np.where(x.max(axis=0) > x.min(axis=0), centred.std(axis=0), 0.0)
        scaled = centred * np.where(scale > 0, 1 / np.where(scale > 0, scale, 1), 0)
        turned = scaled @ _axes(scaled.T @ scaled, variance)
        found = kmeans.fit_rows(turned, own.column("__h").to_numpy(), [k for k in ks if k <= len(x) - spare], inits, seed)
        near = np.column_stack([_nearest(turned, kmeans.by_size(m)) for m in found.values()])
        curve = [[m.inertia for m in found.values()], *[None] * (len(x) - 1)]
        lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * near.shape[1], near.ravel())
        return pa.Table.from_arrays([own.column("__group"), own.column("__id"), lists, pa.array(curve, pa.list_(pa.float64()))], schema.names)

    dealt = rows.select("__group", "__id", *columns, F.xxhash64("__group", "__id").alias("__h")).repartition(parts, "__group")
    return dealt.groupBy("__group").applyInArrow(fit, schema)


def per_group_clusters(
    df: DataFrame, group: str, id_col: str, columns: Sequence[str], k: int | None = 3, inits: int = 3, variance: float | None = None, max_k: int = 10, seed: int = 42, group_rows: int | None = None
) -> DataFrame:
    """(group, id, cluster, status) with a model of its own for each group, labels in order of size.

    Each group's columns are scaled by its own means and deviations (constant ones to 0) and turned to as many principal axes as
    reach ``variance`` of it, all by default. Without ``k`` each group takes the K that the elbow votes choose from 2 to ``max_k``. Groups of up to
    ``group_rows`` are dealt to the tasks, each whole; larger ones go through the same steps side by side: statistics, products of columns, starts and
    every round are one aggregation each for a batch of groups (see ``kmeans``). So the same rows get the same labels whatever other groups there are.

    Groups of under k rows (three without ``k``) are skipped, and groups with a null, NaN or infinite number failed; their rows have no
    cluster. A null group is a group like others. An empty table gives an empty one.
    """
    spark, least, spare = df.sparkSession, k or 3, 0 if k else 1
    group_rows = GROUP_ROWS if group_rows is None else group_rows
    ship_package(spark)
    doubles = [F.col(c).cast("double") for c in columns]
    odd = reduce(operator.or_, [c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")) for c in doubles])
    rows = written(df.select(F.col(group).alias("__group"), F.col(id_col).alias("__id"), *[c.alias(f"__c{j}") for j, c in enumerate(doubles)], odd.alias("__odd")), "rows")
    names = [f"__c{j}" for j in range(len(columns))]
    status = F.when(F.count(F.lit(1)) < least, SKIPPED).when(F.max("__odd"), FAILED).when(F.count(F.lit(1)) <= group_rows, "ok").otherwise("large")
    known = written(rows.groupBy("__group").agg(F.count(F.lit(1)).alias("__n"), status.alias("__status")), "groups")
    placed = written(same(rows, known.select("__group", "__status"), ["__group"]), "placed")

    ks = [k] if k else list(range(2, max_k + 1))
    fitted = written(_small_groups(placed.where("__status = 'ok'"), names, ks, inits, variance, spare, seed), "fitted")
    if k:
        small = fitted.select("__group", "__id", F.col("__labels")[0].alias("cluster"))
    else:
        curve = fitted.where("__curve IS NOT NULL").select("__group", F.posexplode("__curve").alias("__at", "inertia")).withColumn("k", F.col("__at") + ks[0])
        votes = written(elbow_votes(curve, ["__group"]).select("__group", "chosen"), "votes")
        small = same(fitted, votes, ["__group"]).select("__group", "__id", F.get("__labels", F.col("chosen") - ks[0]).alias("cluster"))

    made = [small.withColumn("status", F.lit("ok"))]
    big = placed.where("__status = 'large'")
    d = len(columns)
    at_once = max(1, kmeans.CENTRE_BYTES // (8 * d * max(d, inits * sum(ks))))
    n_big = known.where("__status = 'large'").count()
    if n_big:
        sums = [f(n).alias(f"{label}{n}") for n in names for label, f in (("mean", F.avg), ("scale", F.stddev_pop))]
        stated = written(numbered(big.groupBy("__group").agg(F.count(F.lit(1)).alias("__n"), *sums), ["__group"], "__g"), "large")
        big = written(same(big, stated.select("__group", F.col("__g").cast("int").alias("__g")), ["__group"]), "big")
    for first in range(1, n_big + 1, at_once):
        wanted = F.col("__g").between(first, first + at_once - 1)
        stats = stated.where(wanted).toPandas().sort_values("__g")
        own = big.where(wanted)
        scales = stats[[f"scale{n}" for n in names]].to_numpy()
        scales = np.where(scales > 0, 1 / np.where(scales > 0, scales, 1), 0)
        turn = {int(g): (m, s, np.eye(d)) for g, m, s in zip(stats["__g"], stats[[f"mean{n}" for n in names]].to_numpy(), scales, strict=True)}
        scaled = _project(own, turn, names, ["__g"])
        axes = {g: _axes(p, variance) for g, p in _products(scaled, d).items()}
        turned = written(_project(own, {g: (m, s, axes[g]) for g, (m, s, _) in turn.items()}, names, ["__group", "__id", "__g"]), "turned")
        vectors = kmeans.packed(turned, "__x", "__g")
        try:
            sizes = dict(zip(stats["__g"].astype(int), stats["__n"].astype(int) - spare, strict=True))
            models = kmeans.fit_models(vectors, sizes, ks, inits, seed)
        finally:
            vectors.unpersist()
        if k:
            chosen = dict.fromkeys(models, k)
        else:
            curve = spark.createDataFrame([(g, n, m.inertia) for g, found in models.items() for n, m in found.items()], "__g int, k int, inertia double")
            chosen = {r["__g"]: r["chosen"] for r in elbow_votes(curve, ["__g"]).collect()}
        centres = {g: kmeans.by_size(found[chosen[g]]) for g, found in models.items()}
        made.append(written(_assigned(turned, centres, ["__group", "__id"]), "labels").withColumn("status", F.lit("ok")))
        discard(turned)
    if n_big:
        discard(stated, big)
    discard(rows, known)
    rest = placed.where("__status NOT IN ('ok', 'large')").select("__group", "__id", F.lit(None).cast("int").alias("cluster"), F.col("__status").alias("status"))
    return reduce(DataFrame.union, made, rest).select(F.col("__group").alias(group), F.col("__id").alias(id_col), "cluster", "status")


def group_results(labelled: DataFrame, group: str) -> DataFrame:
    """(group, outcome, reason, n_rows, n_clusters) of ``per_group_clusters``: ok, skipped or failed, a row for each group."""
    parts: Column = F.split("status", ": ")
    counts = labelled.groupBy(group, "status").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("cluster").alias("n_clusters"))
    return counts.select(group, parts[0].alias("outcome"), F.get(parts, F.lit(1)).alias("reason"), "n_rows", "n_clusters")


def pending_groups(groups: DataFrame, finished: DataFrame, group: str, excluded: str = "feature|cluster|result|statistic|analysis|pca") -> DataFrame:
    """Groups still to be done: neither finished nor excluded by name; a null group is one like others."""
    named = F.coalesce(F.lower(group).rlike(excluded), F.lit(False))
    return same(groups.select(group).distinct().where(~named), finished.select(group), [group], "left_anti")
