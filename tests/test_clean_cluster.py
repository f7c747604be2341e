from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from dialogmill.jobs import analysis, feature_queries
from dialogmill.operators import clean, cluster, enrich, kmeans, profile, sampling, scaling

INF = float("inf")


def test_infinite_values(spark):
    df = spark.createDataFrame([(1.0,), (4.0,), (INF,), (None,)], "x double")
    assert [r.x for r in clean.replace_infinite(df, ["x"]).collect()] == [1.0, 4.0, 168.0, None]
    assert [r.x for r in clean.replace_infinite(df, ["x"], "max_multiple").collect()] == [1.0, 4.0, 6.0, None]
    none = spark.createDataFrame([(INF,)], "x double")
    assert clean.replace_infinite(none, ["x"], "max_multiple").first().x == 168.0
    with pytest.raises(ValueError):
        clean.replace_infinite(df, ["x"], "other")


def test_median_fills(spark):
    df = spark.createDataFrame([(1.0, 1.0), (3.0, 3.0), (INF, INF), (None, float("nan"))], "x double, hours_to_next_class double")
    assert [tuple(r) for r in clean.impute_median(df, ["x", "hours_to_next_class"]).collect()] == [(1.0, 1.0), (3.0, 3.0), (2.0, 4.5), (2.0, 2.0)]


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0, 7.0), (0.5, 7.0), (1.0, 7.0)], "x double, c double")
    rows = {(r.feature, r.bin): r.n for r in clean.histogram(df, ["x", "c"], 2).collect()}
    assert rows == {("x", 0): 1, ("x", 1): 2, ("c", 1): 3}


def test_quality_samples(spark):
    df = spark.createDataFrame([(k, INF if k % 2 else 1.0) for k in range(10)], "id int, x double")
    row = clean.column_quality(df, ["x"], "id").first()
    assert (row.n_inf, row.min, row.sample_ids) == (5, 1.0, [1, 3, 5])


def test_constant_columns_scale_to_0(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, c double")
    assert [tuple(r) for r in scaling.standardize(df, ["x", "c"]).collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_components_match_numpy(spark):
    x = np.random.default_rng(1).normal(size=(200, 4)) @ np.diag([3, 2, 1, 0.5])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double")
    scores, loadings, shares = scaling.principal_components(df, list("abcd"))
    values, vectors = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(shares, values[::-1] / values.sum())
    assert np.allclose(np.abs(loadings), np.abs(vectors[:, ::-1]))
    got = np.array([r.pcs for r in scores.collect()])
    assert np.allclose(np.abs(got), np.abs((x - x.mean(axis=0)) @ vectors[:, ::-1])) and np.allclose(got.mean(axis=0), 0)


def test_elbow(spark):
    curve = spark.createDataFrame(list(zip(range(2, 8), [100.0, 60.0, 30.0, 25.0, 22.0, 20.0], strict=True)), "k int, inertia double")
    assert tuple(cluster.elbow_votes(curve).first()) == (5, 4, 4, 4)
    assert tuple(cluster.elbow_votes(curve.limit(2)).first()) == (2, 2, 2, 2)


def points(spark):
    draw = np.random.default_rng(3)
    x = np.concatenate([draw.normal(c, 0.1, (n, 2)) for c, n in (((0, 0), 30), ((5, 5), 20), ((0, 5), 10))])
    return spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "id int, pcs array<double>"), x


def test_labels_go_by_size(spark):
    df, _ = points(spark)
    out = cluster.label_clusters(df, 3, (2, 3, 100), inits=2).collect()
    assert [sum(r.cluster == c for r in out) for c in range(3)] == [30, 20, 10]
    assert all(r.cluster == r.cluster_k3 for r in out) and "cluster_k100" not in out[0].asDict()


def test_registered_sweep_is_the_whole_one(spark, sf_dir, monkeypatch):
    asked = []
    curve = lambda df, ks, **options: asked.append((list(ks), options["inits"], df.select(F.size("pcs")).first()[0])) or [(2, 0.0)]
    monkeypatch.setattr(cluster, "inertia_curve", curve)
    monkeypatch.setattr(cluster, "silhouette_curve", curve)
    feature_queries.inertia_curve(spark, sf_dir)
    feature_queries.silhouette_curve(spark, sf_dir)
    scores, loadings, shares = feature_queries._scores(spark, sf_dir)
    least = next(n for n in range(1, 26) if sum(shares[:n]) >= 0.8)
    assert asked == [(list(range(2, 11)), 10, least), (list(range(2, 11)), 10, 25)] and loadings.shape == (25, 25)
    assert {len(r.pcs) for r in scores.collect()} == {25} and all(np.isfinite(r.pcs).all() for r in scores.collect())


def test_components_of_filled_and_scaled_rows_equal_numpy(spark):
    """Missing, infinite and constant columns, one far from 0, and one without any value, over several parts."""
    draw = np.random.default_rng(2)
    x = np.column_stack([1e6 + draw.normal(size=(80, 1)), draw.normal(size=(80, 2)), draw.integers(0, 2, 80), np.full(80, 0.1), np.full(80, np.nan)])
    x[3, 1], x[5, 2] = np.nan, np.inf
    df = spark.createDataFrame([(k, *(None if np.isnan(v) else float(v) for v in r)) for k, r in enumerate(x)], "id int, a double, b double, c double, d double, e double, f double").repartition(3)
    names, scaled = list("abcdef"), list("abcef")
    fills = clean.median_fills(df, names, time_columns=["c"])
    assert fills["f"] == (None, None) and fills["b"][0] == np.nanmedian(x[:, 1]) and fills["c"][1] == 1.5 * x[np.isfinite(x[:, 2]), 2].max()
    scores, loadings, shares = scaling.principal_components(df, names, keep=["id"], scaled=scaled, fills=fills)
    x[3, 1], x[5, 2], x[:, 5] = fills["b"][0], fills["c"][1], 0
    x[:, [0, 1, 2]] = (x[:, [0, 1, 2]] - x[:, [0, 1, 2]].mean(axis=0)) / x[:, [0, 1, 2]].std(axis=0)
    x[:, 4] = 0
    own = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert np.allclose(shares, own / own.sum(), atol=1e-9) and scores.columns == ["id", "pcs"]
    found = np.array([r.pcs for r in scores.orderBy("id").collect()])
    assert np.allclose(found[:, :4], ((x - x.mean(axis=0)) @ loadings)[:, :4], atol=1e-7) and np.allclose(np.cov(found.T)[:4, :4], np.diag(own[:4]), atol=1e-7)


def test_models_of_the_curve_label_the_rows(spark, monkeypatch):
    """The analysis fits each K once; labels are those of a fit of their own."""
    df, _ = points(spark)
    models = cluster.fit_kmeans(df, range(2, 6), inits=2)
    own = cluster.label_clusters(df, 3, (2, 3, 4), inits=2).orderBy("id").collect()
    monkeypatch.setattr(cluster, "fit_kmeans", lambda *_: pytest.fail("fitted again"))
    assert cluster.label_clusters(df, 3, (2, 3, 4), inits=2, models=models).orderBy("id").collect() == own


def exact_silhouette(x, labels):
    """Row by row, as defined."""
    out = []
    for k in range(len(x)):
        far = np.sqrt(((x - x[k]) ** 2).sum(axis=1))
        own = labels == labels[k]
        others = [far[labels == c].mean() for c in set(labels) - {labels[k]}]
        if own.sum() == 1 or not others:
            out.append(0.0)
            continue
        inner, outer = far[own].sum() / (own.sum() - 1), min(others)
        out.append((outer - inner) / max(inner, outer) if max(inner, outer) > 0 else 0.0)
    return float(np.mean(out))


def test_silhouettes(spark):
    df, x = points(spark)
    assert max(cluster.silhouette_curve(df, [2, 3, 4]), key=lambda p: p[1])[0] == 3
    chosen = cluster.silhouette_choice(df, range(2, 7), inits=3)
    assert [k for k, _, best in chosen if best] == [3] and [k for k, *_ in chosen] == [2, 3, 4, 5, 6]
    labels = np.repeat([0, 1, 2], [30, 20, 10])
    assert dict((k, v) for k, v, _ in chosen)[3] == pytest.approx(exact_silhouette(x, labels), abs=1e-9)


@pytest.mark.parametrize("block", [7, 1000])
def test_plain_silhouettes_equal_numpy(spark, block):
    """Labels of several kinds: a row alone, equal rows, one cluster only."""
    draw = np.random.default_rng(block)
    x = np.round(draw.normal(size=(90, 3)), 1)
    x[:6] = x[0]
    kinds = {"a": draw.integers(0, 4, 90), "b": np.r_[3, np.zeros(89, int)], "c": np.zeros(90, int), "d": np.arange(90) % 2}
    rows = [(k, [float(v) for v in r], *(int(kinds[c][k]) for c in "abcd")) for k, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id int, pcs array<double>, a int, b int, c int, d int").repartition(3)
    found = cluster.plain_silhouettes(df, list("abcd"), block=block)
    for c in "abcd":
        assert found[c] == pytest.approx(exact_silhouette(x, kinds[c]), abs=1e-6)
    sampled = cluster.plain_silhouettes(df, ["a"], sample_rows=40)
    assert sampled == cluster.plain_silhouettes(df.repartition(1), ["a"], sample_rows=40) and abs(sampled["a"] - found["a"]) < 0.2
    assert cluster.plain_silhouettes(df.where("id < 0"), ["a"]) == {}


def counted_silhouette(x, counts, labels):
    """That of distinct rows which each stand for some equal ones."""
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    names = sorted(set(labels))
    sizes, sums = np.array([counts[labels == c].sum() for c in names]), np.column_stack([far[:, labels == c] @ counts[labels == c] for c in names])
    mine, at = np.searchsorted(names, labels), np.arange(len(x))
    inner, means = sums[at, mine] / np.maximum(sizes[mine] - 1, 1), sums / sizes
    means[at, mine] = INF
    outer = means.min(axis=1)
    return float((counts * np.where(sizes[mine] > 1, (outer - inner) / np.maximum(inner, outer), 0)).sum() / counts.sum())


def test_silhouette_choice_judges_every_row(spark):
    """Over 20,000 rows, of few different vectors: the silhouettes are those of all."""
    draw = np.random.default_rng(8)
    x = np.round(draw.normal(size=(300, 6)) + np.repeat([[0.0], [1.5], [4.0]], 100, axis=0), 3)
    counts = draw.integers(1, 160, 300)
    rows = [[float(v) for v in r] for r, n in zip(x, counts, strict=True) for _ in range(n)]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, pcs array<double>").repartition(3)
    chosen = cluster.silhouette_choice(df, [2, 3, 4], inits=1)
    models = cluster.fit_kmeans(df.withColumn("pcs", F.slice("pcs", 1, 5)), [2, 3, 4], inits=1)
    assert len(rows) > 20_000 and [k for k, *_ in chosen] == [2, 3, 4]
    for k, found, _ in chosen:
        labels = ((x[:, None, :5] - models[k].centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert found == pytest.approx(counted_silhouette(x[:, :5], counts, labels), abs=1e-9)


def test_plain_silhouettes_by_strips(spark, monkeypatch):
    """Many strips and tiles give what one gives, whatever the order of the rows; rows that nearly coincide far from the others aren't taken for equal."""
    draw = np.random.default_rng(5)
    x = np.concatenate([draw.normal(size=(70, 3)), 1e3 + draw.normal(size=(50, 3)) * 1e-7])
    counts, kinds = draw.integers(1, 4, 120), {"a": draw.integers(0, 3, 120), "b": np.r_[np.zeros(70, int), np.arange(50) % 2 + 5], "c": np.arange(120) // 40}
    x[70:] += np.where(kinds["b"][70:, None] == 5, 0, 4e-7)
    rows = [([float(v) for v in r], *(int(kinds[c][k]) for c in "abc")) for k, r in enumerate(x) for _ in range(counts[k])]
    df = spark.createDataFrame(rows, "pcs array<double>, a int, b int, c int")
    whole = cluster.plain_silhouettes(df, list("abc"))
    monkeypatch.setattr(cluster, "STRIP_ROWS", 17)
    monkeypatch.setattr(cluster, "TILE", 16)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "23")
    try:
        cut = cluster.plain_silhouettes(df.repartition(5), list("abc"), block=5)
        assert cut == cluster.plain_silhouettes(df.coalesce(1), list("abc"), block=5)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for c in "abc":
        assert whole[c] == pytest.approx(counted_silhouette(x, counts, kinds[c]), abs=1e-8) == cut[c]


def test_group_models_and_skips(spark):
    df, _ = points(spark)
    flat = df.select("id", F.col("pcs")[0].alias("x"), F.col("pcs")[1].alias("y"), F.when(F.col("id") == 59, "tiny").otherwise("g").alias("group"))
    rows = cluster.per_group_clusters(flat, "group", "id", ["x", "y"]).collect()
    assert {r.status for r in rows if r.group == "tiny"} == {"skipped"}
    assert len({r.cluster for r in rows if r.id < 30}) == 1 and {r.status for r in rows if r.group == "g"} == {"ok"}


GROUPED = "id int, x double, y double, z double, group string"


def grouped_rows():
    """Groups of 60 and of 9 rows, the null group, one with a gap in its numbers, one too small, and columns that are constant."""
    draw = np.random.default_rng(8)
    rows = []
    for name, sizes in (("big", (30, 20, 10)), ("small", (4, 3, 2)), (None, (12, 9, 6)), ("odd", (5, 5, 5))):
        for c, n in enumerate(sizes):
            rows += [(name, c, float(x), float(y)) for x, y in draw.normal((10 * c, 5 * (c % 2)), 0.1, (n, 2))]
    out = [(k, x if (name, k) != ("odd", 100) else None, y, 7.0, name) for k, (name, _, x, y) in enumerate(rows)]
    out[-1] = (*out[-1][:1], float("nan"), *out[-1][2:])
    return out + [(900, 1.0, 1.0, 7.0, "tiny"), (901, 2.0, 1.0, 7.0, "tiny")], [c for _, c, _, _ in rows]


@pytest.mark.parametrize("bytes_at_once", [1, 1 << 25])
def test_groups_of_any_size_are_fitted_side_by_side(spark, monkeypatch, bytes_at_once):
    monkeypatch.setattr(kmeans, "CENTRE_BYTES", bytes_at_once)
    rows, kinds = grouped_rows()
    found = cluster.per_group_clusters(spark.createDataFrame(rows, GROUPED), "group", "id", ["x", "y", "z"]).collect()
    assert sorted(r.id for r in found) == sorted(r[0] for r in rows)
    labels = {r.id: r.cluster for r in found}
    for k, kind in enumerate(kinds):
        assert labels[k] == (None if rows[k][4] == "odd" else kind)
    results = {r.group: (r.outcome, r.n_rows, r.n_clusters) for r in cluster.group_results(spark.createDataFrame(found), "group").collect()}
    assert results == {"big": ("ok", 60, 3), "small": ("ok", 9, 3), None: ("ok", 27, 3), "odd": ("failed", 15, 0), "tiny": ("skipped", 2, 0)}


def test_a_group_has_the_same_labels_alone_and_among_others(spark):
    draw = np.random.default_rng(4)
    rows = [(k, *(float(v) for v in draw.normal(size=3)), f"g{k % 3}" if k % 5 else "g0") for k in range(400)]
    columns = ["x", "y", "z"]
    every = cluster.per_group_clusters(spark.createDataFrame(rows, GROUPED).repartition(5), "group", "id", columns, k=4).collect()
    alone = cluster.per_group_clusters(spark.createDataFrame([r for r in rows if r[4] == "g0"], GROUPED), "group", "id", columns, k=4).collect()
    assert {r.id: r.cluster for r in every if r.group == "g0"} == {r.id: r.cluster for r in alone}


@pytest.mark.parametrize("k", [3, None])
def test_small_groups_are_fitted_in_tasks_like_large_ones(spark, monkeypatch, k):
    """Small groups don't pass the driver; the rounds over all tasks, and both side by side, give the same labels."""
    draw = np.random.default_rng(12)
    rows = [(n, *(float(v) for v in draw.normal(size=2)), 7.0, f"g{n % 40}" if n % 9 else None) for n in range(600)]
    rows += [(1000 + n, float(n % 2), 1.0, 7.0, "equal") for n in range(12 if k else 0)]
    df, columns = spark.createDataFrame(rows, GROUPED).repartition(5), ["x", "y", "z"]

    def labels(group_rows):
        found = cluster.per_group_clusters(df, "group", "id", columns, k=k, max_k=5, variance=0.8, group_rows=group_rows).collect()
        return {r.id: (r.group, r.cluster, r.status) for r in found}

    monkeypatch.setattr(kmeans, "CENTRE_BYTES", 4000)
    rounds, mixed = labels(0), labels(20)
    monkeypatch.setattr(kmeans, "fit_models", lambda *_: pytest.fail("rounds of the driver"))
    assert len(rounds) == len(rows) and labels(None) == rounds == mixed


def test_group_models_equal_numpy(spark):
    """At the end each row is nearest to the mean of its own cluster, in the group's scaled columns."""
    draw = np.random.default_rng(6)
    rows = [(k, *(float(v) for v in draw.normal(size=3)), "a" if k % 4 else "b") for k in range(300)]
    found = {r.id: r.cluster for r in cluster.per_group_clusters(spark.createDataFrame(rows, GROUPED), "group", "id", ["x", "y", "z"], k=3).collect()}
    for name in "ab":
        own = [r for r in rows if r[4] == name]
        x = np.array([r[1:4] for r in own])
        x = (x - x.mean(axis=0)) / x.std(axis=0)
        label = np.array([found[r[0]] for r in own])
        means = np.stack([x[label == c].mean(axis=0) for c in range(3)])
        near = ((x[:, None] - means) ** 2).sum(axis=2).argmin(axis=1)
        assert (near != label).mean() < 0.02 and list(np.bincount(label)) == sorted(np.bincount(label), reverse=True)


def test_groups_choose_their_own_k(spark):
    draw = np.random.default_rng(9)
    rows = []
    for name, centres in (("two", 2), ("four", 4)):
        for c in range(centres):
            rows += [(name, *(10.0 * c * np.array([1, c % 2, 1]) + draw.normal(0, 0.05, 3))) for _ in range(25)]
    df = spark.createDataFrame([(k, *(float(v) for v in r[1:]), r[0]) for k, r in enumerate(rows)], GROUPED)
    found = cluster.per_group_clusters(df, "group", "id", ["x", "y", "z"], k=None, max_k=6, variance=0.8)
    assert {r.group for r in cluster.group_results(found, "group").collect() if r.outcome == "ok"} == {"two", "four"}
    one = df.where("group = 'four'")
    scores = scaling.principal_components(scaling.standardize(one, ["x", "y", "z"]), ["x", "y", "z"])
    reduced = analysis.leading_components(scores[0], scores[2], id_col="id")
    curve = spark.createDataFrame([(k, float(v)) for k, v in cluster.inertia_curve(reduced, range(2, 7))], "k int, inertia double")
    assert found.where("group = 'four'").select("cluster").distinct().count() == cluster.elbow_votes(curve).first()["chosen"]


def test_group_runs_go_on_where_they_ended(spark, tmp_path):
    rows, _ = grouped_rows()
    df = spark.createDataFrame(rows + [(2000 + k, float(k), 1.0, 7.0, "old_results") for k in range(5)], GROUPED)
    columns, path = ["x", "y", "z"], str(tmp_path)
    first = analysis.analyse_groups(df.where("group = 'big' OR group = 'tiny'"), "group", path, "id", columns, max_k=4, inits=2)
    assert {r.group: r.outcome for r in first.collect()} == {"big": "ok", "tiny": "skipped"}
    more = spark.createDataFrame([(902, 3.0, 5.0, 7.0, "tiny"), (903, 9.0, 5.0, 7.0, "tiny")], GROUPED)
    second = analysis.analyse_groups(df.union(more), "group", path, "id", columns, max_k=4, inits=2)
    told = sorted(((r.group or "", r.outcome, r.n_rows) for r in second.collect()))
    assert told == [("", "ok", 27), ("big", "ok", 60), ("odd", "failed", 15), ("small", "ok", 9), ("tiny", "ok", 4), ("tiny", "skipped", 2)]
    labels = spark.read.parquet(f"{path}/labels")
    assert labels.count() == labels.select("id").distinct().count() == 60 + 27 + 9 + 4


def test_starts_come_from_all_rows(spark):
    """A far cluster of 4 in 40,000 rows has a centre of its own; a sample by hash of 10,000 would miss it more often than not."""
    draw = np.random.default_rng(1)
    x = np.concatenate([draw.normal(0, 1, (40_000, 2)), draw.normal(500, 0.1, (4, 2))])
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "id int, pcs array<double>").repartition(6)
    for seed in range(3):
        model = cluster.fit_kmeans(df, [3], inits=1, seed=seed)[3]
        assert sorted(model.sizes)[0] == 4
    assert cluster.fit_kmeans(df.coalesce(2), [3], inits=1, seed=0)[3].inertia == pytest.approx(cluster.fit_kmeans(df, [3], inits=1, seed=0)[3].inertia)


def test_fewer_different_rows_than_centres(spark):
    df = spark.createDataFrame([(k, [float(k % 2), 1.0]) for k in range(10)], "id int, pcs array<double>")
    found = cluster.fit_kmeans(df, [2, 4], inits=2)
    assert found[2].inertia == found[4].inertia == 0 and sorted(found[4].sizes)[-2:] == [5, 5]


def test_profiles(spark):
    df = spark.createDataFrame([(0, 1.0, 0.0), (0, 1.0, 0.0), (1, 9.0, 0.0)], "cluster int, qa_turns double, x double")
    assert {(r.cluster, r.feature): r.value for r in profile.radar(df, ["qa_turns", "x"]).collect()} == {(0, "qa_turns"): 0.0, (1, "qa_turns"): 1.0, (0, "x"): 0.0, (1, "x"): 0.0}
    assert {r.cluster: r.std for r in profile.cluster_statistics(df, ["qa_turns"]).collect()} == {0: 0.0, 1: None}
    assert {r.cluster: r.description for r in profile.describe_clusters(df, ["qa_turns", "x"]).collect()} == {0: "平衡型", 1: "高投入度"}


def test_sample_takes_all_of_small_clusters(spark):
    df = spark.createDataFrame([(k, 0 if k < 100 else 1) for k in range(105)], "id int, cluster int")
    sample = sampling.stratified_sample(df, "cluster", "id", 10)
    assert {r.cluster: (r.available, r.sampled) for r in sampling.sampling_report(df, sample, "cluster").collect()} == {0: (100, 10), 1: (5, 5)}
    assert sorted(r.id for r in sample.collect()) == sorted(r.id for r in sampling.stratified_sample(df.repartition(3), "cluster", "id", 10).collect())


def test_schools_must_be_unique(spark):
    schools = spark.createDataFrame([("1", None, None, "18"), ("1", None, None, "18")], "platform_id string, term_start date, term_end date, weeks string")
    with pytest.raises(Exception, match="not unique"):
        enrich.assign_terms(spark.createDataFrame([("1",)], "platform_id string"), schools).collect()


def test_dimension_columns_are_found(spark):
    raw = spark.createDataFrame([("1", "2025年2月17日", " "), ("2", "2025-03-01", "")], "`平台ID` string, d string, e string")
    platform, dates, kept = enrich.choose_dimension_columns(raw)
    assert (platform, dates, kept.columns) == ("平台ID", ["d"], ["平台ID", "d"])


def test_logged_fills_equal_the_steps_one_by_one(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1.0, 2.0, None, 0.0), (inf, 5.5, None, 1.0), (3.0, None, None, 1.0), (None, nan, None, None), (-2.0, -inf, None, 0.0), (2.5, 5.5, None, 1.0)]
    df = spark.createDataFrame(rows, "hours_to_next_class double, b double, c double, d double")
    stepwise = clean.log1p(clean.replace_infinite(df, ["hours_to_next_class", "b", "c"], "max_multiple"), ["hours_to_next_class", "c"])
    infinite, fills = clean.logged_fills(df, df.columns, ["hours_to_next_class", "b", "c"], ["hours_to_next_class", "c"])
    assert infinite == {"hours_to_next_class": 4.5, "b": 8.25, "c": 168.0} and fills == clean.median_fills(stepwise, df.columns)
    fewer = scaling.principal_components(stepwise, df.columns, fills=fills, reach=0.8)
    assert {len(r.pcs) for r in fewer[0].collect()} == {int(np.searchsorted(np.cumsum(fewer[2]), 0.8)) + 1}


def test_silhouettes_equal_the_evaluators(spark):
    """Equal to Spark's own, which the passes stand in for, with a cluster of one row, an empty one and several blocks."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    draw = np.random.default_rng(5)
    x = np.concatenate([draw.normal(size=(1300, 3)), [[50.0, 50.0, 50.0]]])
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "id int, pcs array<double>").repartition(3)
    models = {2: x[:2], 3: np.stack([x[5], x[-1], x[9]]), 4: np.stack([x[1], x[7], x[-1], [900.0, 900.0, 900.0]])}
    got = kmeans.squared_silhouettes(kmeans.packed(df, "pcs"), models)
    for k, centres in models.items():
        near = cluster.nearest_centroid(df, centres.tolist(), "pcs").select(array_to_vector("pcs").alias("v"), F.col("cluster").cast("double").alias("c"))
        assert abs(got[k] - ClusteringEvaluator(featuresCol="v", predictionCol="c").evaluate(near)) < 1e-9


def test_passes_are_narrow(spark):
    """A pass takes blocks of rows and no shuffle, ties go to the first centre, and all of it equals NumPy row by row."""
    x = np.array([[0.0, 0.0], [2.0, 0.0], [1.0, 0.0], [1.0, 3.0]] * 300)
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "id int, pcs array<double>")
    vectors = kmeans.packed(df, "pcs")
    assert vectors.columns == ["__g", "__n", "__v", "__h"] and vectors.count() < len(x) / 100 and kmeans.n_rows(vectors) == len(x)
    models = [x[:2], x[[1, 0]], x[[0, 1, 3]]]
    for centres, (n, sums, cost) in zip(models, kmeans.nearest_sums(vectors, {0: models})[0], strict=True):
        far = ((x[:, None] - centres) ** 2).sum(axis=2)
        near = far.argmin(axis=1)
        assert list(n) == list(np.bincount(near, minlength=len(centres))) and np.isclose(cost, far.min(axis=1).sum())
        assert np.allclose(sums, np.stack([x[near == c].sum(axis=0) for c in range(len(centres))]))
