"""The analysis from features to profiles, and logs to dialogs, against NumPy and pandas."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from dialogmill import tables
from dialogmill.jobs import analysis, dialog_queries, feature_queries
from dialogmill.jobs import fixtures as fx
from dialogmill.operators import audit, features


def elbow(ks, inertia):
    """K by the greatest second difference, the distance from the chord and the change of slope; two equal votes or the middle one."""
    ks, y = np.array(ks), np.array(inertia, float)
    if len(ks) < 3:
        return ks[0]
    last = len(ks) - 1
    curvature = ks[min(np.argmax(np.diff(y, 2)) + 2, last)]
    a, b = (ks - ks.min()) / np.ptp(ks), (y - y.min()) / np.ptp(y)
    distance = ks[np.argmax(np.round(np.abs((b - b[0]) - a * (b[-1] - b[0])), 12))]
    slope = ks[min(np.argmax(np.abs(np.diff(np.abs(np.diff(y) / np.diff(ks))))) + 1, last)]
    return sorted([curvature, distance, slope])[1]


def test_whole_analysis(spark, sf_dir, tmp_path):
    rows = feature_queries._features(spark, sf_dir)
    found = analysis.analyse(rows, max_k=5, inits=2)
    curve = found.curve.orderBy("k").toPandas()
    assert list(curve.k) == [2, 3, 4, 5] and (np.diff(curve.inertia) < 0).all() and found.k == elbow(curve.k, curve.inertia)
    labelled = found.labelled.toPandas()
    assert len(labelled) == rows.count() and set(labelled.cluster) == set(range(found.k))
    sizes = labelled.groupby("cluster").size()
    assert list(sizes) == sorted(sizes, reverse=True)
    if found.k in (2, 3, 4):
        assert (labelled.cluster == labelled[f"cluster_k{found.k}"]).all()
    # each row lies nearest to the mean of its own cluster, and the inertia is that of the curve or better
    scores, _, shares = analysis.feature_scores(rows)
    reduced = analysis.leading_components(scores, shares).toPandas().merge(labelled[["dialog_id", "cluster"]], on="dialog_id")
    x = np.array(reduced.pcs.tolist())
    centres = np.stack([x[reduced.cluster == c].mean(axis=0) for c in range(found.k)])
    far = ((x[:, None] - centres) ** 2).sum(axis=2)
    assert (far.argmin(axis=1) == reduced.cluster).mean() > 0.99
    assert far.min(axis=1).sum() <= 1.05 * float(curve.inertia[curve.k == found.k].iloc[0])
    tables_ = found.profiles()
    stats = tables_["cluster_statistics"].toPandas().set_index(["cluster", "feature"])
    for c in ("qa_turns", "avg_question_length", "is_weekend"):
        want = labelled.groupby("cluster")[c].agg(["mean", "std", "median"])
        for k, r in want.iterrows():
            assert np.allclose(stats.loc[(k, c), ["mean", "std", "median"]].astype(float), r.astype(float), equal_nan=True)
    analysis.write_analysis(found, fx.with_dialog_id(fx.dialogs(spark, sf_dir)), str(tmp_path / "out"))
    by_cluster = spark.read.parquet(str(tmp_path / "out/dialogs")).groupBy("cluster").agg(F.countDistinct("dialog_id").alias("n")).toPandas().set_index("cluster").n
    assert by_cluster.to_dict() == sizes.to_dict()
    assert spark.read.json(str(tmp_path / "out/settings")).first().n_dialogs == len(labelled)
    report = spark.read.parquet(str(tmp_path / "out/sampling_report")).toPandas().set_index("cluster")
    assert report.available.to_dict() == sizes.to_dict() and (report.sampled == np.minimum(report.available, 50)).all()
    previews = spark.read.parquet(str(tmp_path / "out/sample_preview")).toPandas()
    assert len(previews) == np.minimum(sizes, 3).sum() and previews.preview.notna().all()


def test_counters_come_from_written_outcomes(spark, sf_dir, tmp_path):
    calendars = [f(spark, sf_dir) for f in (fx.class_windows, fx.schedule, fx.homework)]
    dialogs = dialog_queries._broken(fx.dialogs(spark, sf_dir))
    found = analysis.write_features(dialogs, *calendars, str(tmp_path))
    counters = spark.read.json(str(tmp_path / "counters")).first()
    want = audit.outcome_stats(audit.dialog_outcomes(dialogs, calendars[0])).first()
    assert {c: counters[c] for c in want.asDict()} == want.asDict() and counters.invalid_times > 0
    assert found.count() == counters.processed


def test_tables_in_buckets_are_joined_where_they_lie(spark, sf_dir):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dialogs = tables.bucketed(fx.with_dialog_id(fx.dialogs(spark, sf_dir)), "dialogs", "dialog_id")
        labels = tables.bucketed(fx.clustered(spark, sf_dir).select("dialog_id", "cluster"), "labels", "dialog_id")
        joined = dialogs.join(labels.where("cluster < 3"), "dialog_id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        want = fx.with_dialog_id(fx.dialogs(spark, sf_dir)).join(fx.clustered(spark, sf_dir).where("cluster < 3").select("dialog_id", "cluster"), "dialog_id")
        assert sorted(joined.select("dialog_id", "row_no", "cluster").collect()) == sorted(want.select("dialog_id", "row_no", "cluster").collect())
        tables.discard(dialogs, labels)
        assert not spark.catalog.tableExists(labels.table_name)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_feature_table_has_all_columns(spark, sf_dir):
    found = feature_queries._features(spark, sf_dir)
    assert set(found.columns) == {"source", "student_id", "dialog_no", "dialog_id", "class_id", *features.CONTINUOUS, *features.BINARY}
    assert len(analysis.ALL_FEATURES) == 25 == len(set(analysis.ALL_FEATURES)) and set(features.LOGGED) < set(features.CONTINUOUS)


def test_mixed_dialogs_are_refused_or_counted_whole(spark, sf_dir):
    """What the features keep is what the outcomes call processed, with all rows of these dialogs."""
    broken = dialog_queries._broken(fx.dialogs(spark, sf_dir)).toPandas()
    kept = dialog_queries.dialog_features_mixed(spark, sf_dir).toPandas()
    outcomes = dialog_queries.dialog_outcomes_mixed(spark, sf_dir).toPandas()
    assert {"invalid_times", "processed"} <= set(outcomes.outcome)
    processed = outcomes[outcomes.outcome == "processed"].merge(broken.groupby(["student_id", "dialog_no"]).size().rename("n").reset_index())
    key = lambda f, n: sorted(zip(f.student_id, f.dialog_no, f.class_id, f[n], strict=True))
    assert key(kept, "qa_turns") == key(processed, "n")


def test_logs_to_dialogs(spark, tmp_path):
    head = "学生ID,提问时间,提问内容,AI回复,教学班ID,提问入口"
    lines = [f"s{k % 2},2025-03-01 10:{k:02d}:00,q{k},a,7,班级" for k in range(10)] + ["s0,2025-03-01 12:00:00,late,a,7,班级"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/one.csv").write_text("\n".join([head, *lines]), encoding="utf-8-sig")
    (tmp_path / "in/two.csv").write_text("提问时间,学生ID,提问内容\n2025-03-01 10:00:00,s9,q\n", encoding="utf-8")
    (tmp_path / "in/none.csv").write_text("a,b\n1,2\n", encoding="utf-8")
    counts = {r.source: (r.n_students, r.n_dialogs) for r in analysis.split_logs(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect()}
    assert counts == {"one": (2, 3), "two": (1, 1)}
    mapping = spark.createDataFrame([("one", "s1", 1, 1, 1), ("one", "s1", 1, 4, 2)], "source string, student_id string, chunk_no int, row_number int, session_id int")
    counts = {r.source: r.n_dialogs for r in analysis.split_logs(spark, str(tmp_path / "in"), str(tmp_path / "mapped"), mapping).collect()}
    assert counts == {"one": 3, "two": 1}


def test_percentiles_and_numbers(spark):
    draw = np.random.default_rng(2)
    frame = pd.DataFrame({"g": draw.choice(["a", "b", None], 500), "value": np.where(draw.random(500) < 0.4, 7.0, draw.normal(size=500).round(2)), "id": draw.permutation(500)})
    df = spark.createDataFrame([(g, v, i) for g, v, i in frame.itertuples(index=False)] + [("a", None, 500), ("c", None, 501)], "g string, value double, id int").repartition(7)
    shares = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    got = {r.g: r.q for r in tables.exact_percentiles(df, ["g"], shares).collect()}
    ranged = {r.g: r.q for r in tables.exact_percentiles(df, ["g"], shares, few=0).collect()}
    assert set(ranged) == set(got) and all(np.allclose(ranged[g], q) for g, q in got.items())
    assert set(got) == {"a", "b", None}
    for g, q in got.items():
        own = frame.value[frame.g.isna() if g is None else frame.g == g]
        assert np.allclose(q, own.quantile(shares))
    assert abs(tables.percentiles(df, ["g"], [0.5], accuracy=1000).where("g = 'a'").first().q[0] - got["a"][3]) < 0.1
    assert [r.n for r in tables.numbered(df, ["id"], "n").orderBy("id").collect()] == list(range(1, 503))
