"""The analysis from features to profiles, and the split of logs into dialogs, as jobs of written tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialogmill.jobs.export import rows_with_label, write_by, write_stats
from dialogmill.operators import audit, clean, cluster, profile, sampling, scaling, segment
from dialogmill.operators.features import BINARY, CONTINUOUS, LOGGED, extract_features
from dialogmill.sources.logs import read_interactions
from dialogmill.tables import bucketed, discard, same, written

#: All features in a fixed order, those of the whole table.
ALL_FEATURES = (*CONTINUOUS, *BINARY)
#: The largest K, runs per K and further labels of the whole sweep.
MAX_K, INITS, EXTRA_K = 10, 10, (2, 3, 4)
#: Components reach this share of the variance.
VARIANCE = 0.8


def write_features(dialogs: DataFrame, class_windows: DataFrame, schedule: DataFrame, homework: DataFrame, path: str, allowed: DataFrame | None = None) -> DataFrame:
    """Outcomes of all dialogs, features of those processed, and the counters of the run, below ``path``; returns the features.

    Counters come from the written outcomes, a row for each dialog, so logs aren't read again for them, and a task or stage that Spark runs twice counts once.
    """
    spark = dialogs.sparkSession
    audit.dialog_outcomes(dialogs, class_windows, allowed).write.mode("overwrite").parquet(f"{path}/outcomes")
    rows = dialogs if allowed is None or allowed.isEmpty() else audit.allow_classes(dialogs, allowed)
    extract_features(rows, class_windows, schedule, homework).write.mode("overwrite").parquet(f"{path}/features")
    write_stats(audit.outcome_stats(spark.read.parquet(f"{path}/outcomes")), f"{path}/counters")
    return spark.read.parquet(f"{path}/features")


def feature_components(features: DataFrame, id_col: str = "dialog_id", reach: float | None = None) -> tuple[DataFrame, np.ndarray, np.ndarray, list[DataFrame]]:
    """(id and principal components of each row, loadings, explained shares, tables that these are read from) of the whole feature table.

    Infinite and missing values are filled, logarithms taken, continuous columns scaled. Features are written once, unless they are a written table already; logarithms
    are taken whenever these are read, and wide rows filled, scaled and turned as matrices in the tasks, to all components or as many as ``reach`` this share of the variance, when they are read.
    """
    kept = [] if hasattr(features, "written_path") else [written(features.select(id_col, *[F.col(c).cast("double").alias(c) for c in ALL_FEATURES]), "features")]
    rows = kept[0] if kept else features
    infinite, fills = clean.logged_fills(rows, ALL_FEATURES, CONTINUOUS, LOGGED)
    logged = clean.log1p(rows.withColumns({c: F.when(clean.is_infinite(F.col(c)), v).otherwise(F.col(c)) for c, v in infinite.items()}), LOGGED)
    turned, loadings, shares = scaling.principal_components(logged, ALL_FEATURES, keep=[id_col], scaled=CONTINUOUS, fills=fills, reach=reach)
    return turned, loadings, shares, kept


def feature_scores(features: DataFrame, id_col: str = "dialog_id", reach: float | None = None) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(id and principal components of each row, loadings, explained shares), as ``feature_components``, written."""
    turned, loadings, shares, kept = feature_components(features, id_col, reach)
    scores = written(turned, "scores")
    discard(*kept)
    return scores, loadings, shares


def leading_components(scores: DataFrame, shares: np.ndarray, threshold: float = VARIANCE, id_col: str = "dialog_id") -> DataFrame:
    """As many components as reach ``threshold`` of the variance."""
    ratios = scores.sparkSession.createDataFrame([(k + 1, float(r)) for k, r in enumerate(shares)], "component int, ratio double")
    return scores.select(id_col, F.slice("pcs", 1, scaling.components_for_variance(ratios).first()["n_components"]).alias("pcs"))


def sweep(rows: DataFrame, max_k: int = MAX_K) -> range:
    return range(2, min(max_k, rows.count() - 1) + 1)


@dataclass(frozen=True)
class Analysis:
    """Tables of one run: the inertia of each K, the votes, and the features with their labels."""

    curve: DataFrame
    votes: DataFrame
    k: int
    labelled: DataFrame

    def profiles(self, columns: Sequence[str] = ALL_FEATURES) -> dict[str, DataFrame]:
        rows = self.labelled.withColumns({c: F.col(c).cast("double") for c in columns})
        return {
            "cluster_sizes": profile.cluster_sizes(rows), "cluster_statistics": profile.cluster_statistics(rows, columns),
            "cluster_heatmap": profile.heatmap(rows, columns, [c for c in BINARY if c in columns]), "cluster_radar": profile.radar(rows, columns),
            "cluster_top_features": profile.top_features(rows, columns), "cluster_description": profile.describe_clusters(rows, columns),
            "cluster_turns_box": profile.turns_box(rows),
        }


def analyse(features: DataFrame, max_k: int = MAX_K, inits: int = INITS, extra_k: Sequence[int] = EXTRA_K, id_col: str = "dialog_id") -> Analysis:
    """Scales and reduces the features, chooses K by vote over the inertia curve, and labels every row for this K and some others.

    Needs at least three rows. Features and components are written in buckets by id, so the labels join the features where these lie, and so
    may the dialogs; labels are written once, and all profiles read that table.
    """
    spark = features.sparkSession
    table = bucketed(features, "features", id_col)
    reduced = bucketed(feature_components(table, id_col, VARIANCE)[0], "reduced", id_col)
    models = cluster.fit_kmeans(reduced, sweep(reduced, max_k), inits=inits)
    curve = spark.createDataFrame([(k, float(m.inertia)) for k, m in models.items()], "k int, inertia double")
    votes = cluster.elbow_votes(curve)
    k = votes.first()["chosen"]
    labels = cluster.label_clusters(reduced, k, extra_k, inits=inits, models=models).drop("pcs")
    return Analysis(curve, votes, k, bucketed(table.join(labels, id_col), "labelled", id_col))


def write_analysis(found: Analysis, dialogs: DataFrame, path: str, id_col: str = "dialog_id", per_cluster: int = 50) -> None:
    """The whole run below ``path``: curve, votes, labelled features, profiles, the dialogs by cluster, a sample of each cluster with previews, and its settings.

    The dialogs, texts and all, are dealt by id once, in buckets; what follows joins them where they lie.
    """
    rows = bucketed(dialogs, "dialogs", id_col)
    labels = found.labelled.select(id_col, "cluster")
    sample = sampling.stratified_sample(found.labelled, "cluster", id_col, per_cluster)
    tables = {
        "inertia_curve": found.curve, "elbow_votes": found.votes, "clustered_features": found.labelled, **found.profiles(),
        "sampling_report": sampling.sampling_report(found.labelled, sample, "cluster"), "sample_preview": sampling.sample_preview(rows, sample, "cluster", id_col),
    }
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    write_by(rows_with_label(rows, labels, id_col), f"{path}/dialogs", "cluster")
    write_stats(found.labelled.agg(F.count(F.lit(1)).alias("n_dialogs")), f"{path}/settings", k=str(found.k), features=",".join(ALL_FEATURES))
    discard(rows)


def analyse_groups(features: DataFrame, group: str, path: str, id_col: str = "dialog_id", columns: Sequence[str] = ALL_FEATURES, max_k: int = MAX_K, inits: int = INITS) -> DataFrame:
    """A model of its own for each group, as many as are still to be done; returns the outcomes of all runs below ``path`` so far.

    Logarithms are taken as for the whole table; each group is scaled, reduced to 80 % of its variance and cut into the K that its own votes choose.
    Labels and outcomes are appended, so a run that was broken off, or one over more groups, goes on where the last one ended: groups that are done
    are left out, those skipped (too few rows) or failed are tried again. Groups whose names mark results are left out.
    """
    spark = features.sparkSession
    outcomes = T.StructType([features.schema[group]]).add("outcome", "string").add("reason", "string").add("n_rows", "long").add("n_clusters", "long").add("run", "string")
    spark.createDataFrame([], outcomes).write.mode("append").parquet(f"{path}/outcomes")
    before = spark.read.schema(outcomes).parquet(f"{path}/outcomes")
    pending = written(cluster.pending_groups(features, before.where("outcome = 'ok'"), group), "pending")
    rows = clean.log1p(same(features, pending, [group], "left_semi"), LOGGED)
    labels = written(cluster.per_group_clusters(rows, group, id_col, columns, k=None, inits=inits, variance=0.8, max_k=max_k), "labels")
    run = uuid.uuid4().hex
    labels.where("status = 'ok'").withColumn("run", F.lit(run)).write.mode("append").parquet(f"{path}/labels")
    found = cluster.group_results(labels, group).withColumn("run", F.lit(run))
    found.select(*outcomes.names).write.mode("append").parquet(f"{path}/outcomes")  # last, so a group is done only when its labels are there
    discard(pending, labels)
    return spark.read.schema(outcomes).parquet(f"{path}/outcomes")


def split_logs(spark: SparkSession, logs: str | list[str], path: str, mapping: DataFrame | None = None, minutes: float = 15, recursive: bool = True) -> DataFrame:
    """Reads logs, splits them into dialogs, and writes these below ``path`` by source; returns counts for each source.

    By pauses within an entrance, or with ``mapping`` (source, student_id, chunk_no, row_number, session_id) by given sessions within an
    entrance. Files that lack a needed column are left out.
    """
    rows = read_interactions(spark, logs, recursive, skip_incomplete=True)
    if mapping is None:
        dialogs = segment.segment_dialogs(rows, minutes)
    else:
        dialogs = segment.apply_session_mapping(segment.split_by_entrance(rows), mapping)
    write_by(dialogs.withColumn("dialog_id", segment.dialog_id()), f"{path}/dialogs", "source")
    counts = segment.dialogs_per_source(spark.read.parquet(f"{path}/dialogs"))
    counts.write.mode("overwrite").parquet(f"{path}/counts")
    return spark.read.parquet(f"{path}/counts")
