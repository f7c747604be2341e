"""Queries on enrichment, cleaning, statistics, scaling, clustering and cluster profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogmill.functions.time import parse_mixed_date, parse_semester
from dialogmill.jobs import analysis
from dialogmill.jobs import fixtures as fx
from dialogmill.jobs.dialog_queries import rounded
from dialogmill.jobs.fixtures import FEATURES, long_sql
from dialogmill.jobs.registry import query
from dialogmill.operators import clean, cluster, enrich, profile, sampling, scaling
from dialogmill.operators.features import extract_features
from dialogmill.tables import discard

# enrichment


def _schools(spark, sf_dir) -> DataFrame:
    nation = fx.table(spark, sf_dir, "nation").where("n_nationkey < 20")
    start = F.when(F.col("n_nationkey") % 5 != 4, F.concat(F.lit("2025年2月"), F.col("n_nationkey") + 1, F.lit("日")))
    return enrich.clean_schools(nation.select(F.concat(F.lit(" ﻿"), F.col("n_nationkey").cast("string")).alias("platform_id"), start.alias("term_start"), F.lit("2025-06-22").alias("term_end"), F.when(F.col("n_nationkey") % 3 > 0, F.lit("18")).alias("weeks")))


def _classes(spark, sf_dir) -> DataFrame:
    return fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("class_no"), F.col("c_nationkey").cast("string").alias("platform_id"))


@query("class_term_window", """WITH s AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 5 <> 4 THEN make_date(2025, 2, CAST(n_nationkey + 1 AS INT)) END AS a, CASE WHEN n_nationkey % 3 > 0 THEN '18' END AS w FROM nation WHERE n_nationkey < 20)
SELECT c_custkey AS class_no, CAST(c_nationkey AS VARCHAR) AS platform_id, CASE WHEN a IS NOT NULL THEN strftime(a, '%Y-%m-%d 00:00:00') ELSE '2025-03-01 00:00:00' END AS term_start,
  CASE WHEN a IS NOT NULL THEN '2025-06-22 00:00:00' ELSE '2025-07-07 23:59:59' END AS term_end, coalesce(w, '未知') AS weeks,
  CASE WHEN k IS NULL THEN '平台未出现在学校信息表 -> 使用默认区间' WHEN a IS NULL THEN '学校时间缺失 -> 使用默认区间' ELSE '使用学校统一时间' END AS reason FROM customer LEFT JOIN s ON c_nationkey = k""")  # fmt: skip
def class_term_window(spark, sf_dir):
    return enrich.assign_terms(_classes(spark, sf_dir), _schools(spark, sf_dir))


@query("unmatched_platforms", "SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS platform_id FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 20)")
def unmatched_platforms(spark, sf_dir):
    return enrich.unmatched_platforms(_classes(spark, sf_dir), _schools(spark, sf_dir))


_INFO = "CASE WHEN {k} % 4 = 3 THEN 'unknown' WHEN {k} % 4 = 2 THEN '2024年9月' || ({k} % 28 + 1) || '日至2025年1月5日，' || ({k} % 9 + 10) || '周' ELSE '2025年2月' || ({k} % 28 + 1) || '日至6月22日，18周' END"


def _semesters(spark, sf_dir) -> DataFrame:
    return fx.table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).cast("int").alias("idx"), F.expr(_INFO.format(k="n_nationkey")).alias("info"))


_SEM = "s AS (SELECT CAST(n_nationkey + 1 AS INT) AS idx, CASE WHEN n_nationkey % 4 = 3 THEN NULL WHEN n_nationkey % 4 = 2 THEN make_date(2024, 9, CAST(n_nationkey % 28 + 1 AS INT)) ELSE make_date(2025, 2, CAST(n_nationkey % 28 + 1 AS INT)) END AS a, CASE WHEN n_nationkey % 4 = 3 THEN NULL WHEN n_nationkey % 4 = 2 THEN DATE '2025-01-05' ELSE DATE '2025-06-22' END AS b, CAST(CASE WHEN n_nationkey % 4 = 3 THEN NULL WHEN n_nationkey % 4 = 2 THEN n_nationkey % 9 + 10 ELSE 18 END AS INT) AS weeks FROM nation)"


@query("parse_semester", f"WITH {_SEM} SELECT idx, a AS term_start, b AS term_end, weeks FROM s")
def parse_semesters(spark, sf_dir):
    return _semesters(spark, sf_dir).select("idx", parse_semester(F.col("info")).alias("s")).select("idx", "s.*")


@query("semester_append", f"WITH {_SEM}, r AS (SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_custkey) AS INT) AS idx FROM customer) SELECT c_custkey, strftime(a, '%Y年%m月%d日') AS term_start, strftime(b, '%Y年%m月%d日') AS term_end, weeks FROM r LEFT JOIN s USING (idx)")
def semester_append(spark, sf_dir):
    return enrich.append_semesters(fx.table(spark, sf_dir, "customer").select("c_custkey"), _semesters(spark, sf_dir), "c_custkey")


@query("parse_mixed_date", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(ts AS DATE) WHEN 1 THEN CAST(ts AS DATE) WHEN 2 THEN CAST(ts AS DATE) END AS parsed FROM events")
def mixed_dates(spark, sf_dir):
    ts = F.col("ts")
    forms = F.when(F.col("event_id") % 4 == 0, F.date_format(ts, "yyyy年M月d日")).when(F.col("event_id") % 4 == 1, F.date_format(ts, " yyyy-MM-dd ")).when(F.col("event_id") % 4 == 2, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).otherwise("soon")
    return fx.table(spark, sf_dir, "events").select("event_id", parse_mixed_date(forms).alias("parsed"))


_SEGMENT = {"AUTOMOBILE": "机械与能源工程", "BUILDING": "土木建筑工程", "FURNITURE": "化学", "HOUSEHOLD": "心理学"}


@query("discipline_rollup", """SELECT discipline, count(*) AS n, sum(c_acctbal)::DOUBLE AS balance FROM (SELECT round(c_acctbal, 2) AS c_acctbal, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '工学' WHEN 'BUILDING' THEN '工学' WHEN 'FURNITURE' THEN '理学' WHEN 'HOUSEHOLD' THEN '教育学' ELSE '(unknown)' END AS discipline FROM customer) GROUP BY discipline""".replace(", sum(c_acctbal)::DOUBLE AS balance", ""))
def discipline_rollup(spark, sf_dir):
    subject = F.create_map(*[F.lit(x) for pair in _SEGMENT.items() for x in pair])[F.col("c_mktsegment")]
    rows = fx.table(spark, sf_dir, "customer").withColumn("subject", F.coalesce(subject, F.lit("-")))
    known, unknown = enrich.by_discipline(rows, enrich.discipline_frame(spark))
    both = known.select("discipline").union(unknown.select(F.lit("(unknown)")))
    return both.groupBy("discipline").agg(F.count(F.lit(1)).alias("n"))


@query("prefix_numeric_concat", "SELECT c_custkey AS idx, c_name AS name, round(c_acctbal, 2) AS acctbal, round(c_acctbal * 2, 2) AS transform_acctbal, c_mktsegment AS segment FROM customer")
def prefix_numeric_concat(spark, sf_dir):
    customer = fx.table(spark, sf_dir, "customer")
    left = customer.select(F.col("c_custkey").alias("idx"), F.col("c_name").alias("name"), F.round("c_acctbal", 2).alias("acctbal"))
    right = customer.select(F.col("c_custkey").alias("idx"), F.round(F.col("c_acctbal") * 2, 2).alias("acctbal"), F.col("c_mktsegment").alias("segment"))
    return enrich.concat_columns(left, right, "idx", ["acctbal"])


# cleaning and statistics

_GAPS_SQL = "g AS (SELECT event_id, CASE event_id % 11 WHEN 0 THEN NULL WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN '-inf'::DOUBLE ELSE value END AS hours_to_next_class, CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'inf'::DOUBLE ELSE value * 2 END AS score FROM events)"


def _gaps(spark, sf_dir) -> DataFrame:
    e = F.col("event_id")
    inf = F.lit(float("inf"))
    return fx.table(spark, sf_dir, "events").select(
        "event_id", F.when(e % 11 == 0, None).when(e % 11 == 1, inf).when(e % 11 == 2, -inf).otherwise(F.col("value")).alias("hours_to_next_class"), F.when(e % 7 == 0, None).when(e % 7 == 1, inf).otherwise(F.col("value") * 2).alias("score")
    )


@query("replace_inf_constant", f"WITH {_GAPS_SQL} SELECT event_id, round(CASE WHEN isinf(hours_to_next_class) THEN 168.0 ELSE hours_to_next_class END, 6) AS hours_to_next_class FROM g")
def replace_inf_constant(spark, sf_dir):
    return rounded(clean.replace_infinite(_gaps(spark, sf_dir), ["hours_to_next_class"]).drop("score"))


@query("replace_inf_max_multiple", f"WITH {_GAPS_SQL} SELECT event_id, round(CASE WHEN isinf(hours_to_next_class) THEN 1.5 * (SELECT max(hours_to_next_class) FROM g WHERE NOT isinf(hours_to_next_class)) ELSE hours_to_next_class END, 6) AS hours_to_next_class FROM g")
def replace_inf_max_multiple(spark, sf_dir):
    return rounded(clean.replace_infinite(_gaps(spark, sf_dir), ["hours_to_next_class"], "max_multiple").drop("score"))


@query("impute_median", f"""WITH {_GAPS_SQL}, m AS (SELECT median(hours_to_next_class) FILTER (WHERE NOT isinf(hours_to_next_class)) AS m1, max(hours_to_next_class) FILTER (WHERE NOT isinf(hours_to_next_class)) AS x1, median(score) FILTER (WHERE NOT isinf(score)) AS m2 FROM g)
SELECT event_id, round(CASE WHEN hours_to_next_class IS NULL THEN m1 WHEN isinf(hours_to_next_class) THEN 1.5 * x1 ELSE hours_to_next_class END, 6) AS hours_to_next_class, round(CASE WHEN score IS NULL OR isinf(score) THEN m2 ELSE score END, 6) AS score FROM g, m""")  # fmt: skip
def impute_median(spark, sf_dir):
    return rounded(clean.impute_median(_gaps(spark, sf_dir), ["hours_to_next_class", "score"]))


@query("zero_non_finite", f"WITH {_GAPS_SQL} SELECT event_id, round(CASE WHEN score IS NULL OR isinf(score) THEN 0.0 ELSE score END, 6) AS score FROM g")
def zero_non_finite(spark, sf_dir):
    return rounded(clean.zero_non_finite(_gaps(spark, sf_dir), ["score"]).drop("hours_to_next_class"))


@query("log1p_features", f"{fx.C_SQL} SELECT dialog_id, round(ln(1 + qa_turns), 6) AS qa_turns, round(ln(1 + total_time_minutes), 6) AS total_time_minutes, round(ln(1 + avg_question_length), 6) AS avg_question_length FROM c")
def log1p_features(spark, sf_dir):
    names = ["qa_turns", "total_time_minutes", "avg_question_length"]
    return rounded(clean.log1p(fx.clustered(spark, sf_dir), names).select("dialog_id", *names))


@query("column_quality", f"""WITH {_GAPS_SQL}, l AS ({long_sql(['hours_to_next_class', 'score'], source='g')})
SELECT feature, count(*) FILTER (WHERE isinf(value)) AS n_inf, count(*) FILTER (WHERE value IS NULL) AS n_missing, round(min(value) FILTER (WHERE NOT isinf(value)), 6) AS min, round(max(value) FILTER (WHERE NOT isinf(value)), 6) AS max,
  round(avg(value) FILTER (WHERE NOT isinf(value)), 6) AS mean, round(stddev_samp(value) FILTER (WHERE NOT isinf(value)), 6) AS std FROM l GROUP BY feature""")  # fmt: skip
def column_quality(spark, sf_dir):
    return rounded(clean.column_quality(_gaps(spark, sf_dir), ["hours_to_next_class", "score"]))


_LONG = f"{fx.C_SQL}, l AS ({long_sql()})"
_LONG_BY = f"{fx.C_SQL}, l AS ({long_sql(keys='cluster, ')})"


@query("feature_stats", f"{_LONG} SELECT feature, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(var_samp(value), 6) AS variance FROM l GROUP BY feature")
def feature_stats(spark, sf_dir):
    return rounded(clean.feature_stats(fx.clustered(spark, sf_dir), FEATURES))


@query("describe_features", f"{_LONG} SELECT feature, count(*) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75, round(max(value), 6) AS max FROM l GROUP BY feature")
def describe_features(spark, sf_dir):
    return rounded(clean.describe(fx.clustered(spark, sf_dir), FEATURES))


def _bins(n: int, per: str, keys: str, where: str) -> str:
    return f"""r AS (SELECT {per}, CASE WHEN min(value) = max(value) THEN min(value) - 0.5 ELSE min(value) END AS lo, CASE WHEN min(value) = max(value) THEN max(value) + 0.5 ELSE max(value) END AS hi FROM l {where} GROUP BY {per})
SELECT feature, {keys} CAST(least(floor((value - lo) / (hi - lo) * {n}), {n - 1}) AS INT) AS bin, round(lo + bin * (hi - lo) / {n}, 6) AS low, round(lo + (bin + 1) * (hi - lo) / {n}, 6) AS high, count(*) AS n FROM l JOIN r USING ({per}) {where} GROUP BY ALL"""


@query("feature_histogram", f"{_LONG}, {_bins(50, 'feature', '', '')}")
def feature_histogram(spark, sf_dir):
    return rounded(clean.histogram(fx.clustered(spark, sf_dir), FEATURES))


_PROGRESS = f"{fx.C_SQL}, l AS ({long_sql(['day_period'], 'cluster, ')})"


@query("progress_histogram", f"{_PROGRESS}, {_bins(20, 'feature, cluster', 'cluster,', 'WHERE value > 0')}")
def progress_histogram(spark, sf_dir):
    return rounded(profile.progress_histogram(fx.clustered(spark, sf_dir), "day_period"))


@query("binary_counts", f"{_LONG} SELECT feature, CAST(value AS INT) AS value, count(*) AS n FROM l WHERE feature IN (SELECT feature FROM l GROUP BY feature HAVING bool_and(value IN (0, 1))) GROUP BY ALL")
def binary_counts(spark, sf_dir):
    return clean.binary_counts(fx.clustered(spark, sf_dir), FEATURES)


# scaling and clustering

_SCALED = ("qa_turns", "total_time_minutes", "avg_question_length")


@query("standardize", f"{fx.C_SQL} SELECT dialog_id, is_multi_turn, {', '.join(f'round(CASE WHEN stddev_pop({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () ELSE 0.0 END, 5) AS {c}' for c in _SCALED)} FROM c")
def standardize(spark, sf_dir):
    return rounded(scaling.standardize(fx.clustered(spark, sf_dir).select("dialog_id", "is_multi_turn", *_SCALED), _SCALED), 5)


@query("feature_covariance", f"{fx.C_SQL}, " + "r AS (SELECT " + ", ".join(f"covar_samp({a}, {b}) AS x{i}_{j}" for i, a in enumerate(FEATURES) for j, b in enumerate(FEATURES) if i <= j) + " FROM c) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(x{i}_{j}, 6) AS value FROM r" for i, a in enumerate(FEATURES) for j, b in enumerate(FEATURES) if i <= j))
def feature_covariance(spark, sf_dir):
    return rounded(scaling.covariance(fx.clustered(spark, sf_dir), FEATURES))


#: Components of the silhouette.
SILHOUETTE_DIMS = 5


def _features(spark, sf_dir):
    return fx.with_dialog_id(extract_features(fx.dialogs(spark, sf_dir), fx.class_windows(spark, sf_dir), fx.schedule(spark, sf_dir), fx.homework(spark, sf_dir)))


def _scores(spark, sf_dir):
    return analysis.feature_components(_features(spark, sf_dir))[:3]


@query("pca_scores")
def pca_scores(spark, sf_dir):
    return rounded(_scores(spark, sf_dir)[0].select("dialog_id", F.col("pcs")[0].alias("pc1"), F.col("pcs")[1].alias("pc2"), F.col("pcs")[2].alias("pc3")))


@query("pca_loadings")
def pca_loadings(spark, sf_dir):
    _, loadings, _, kept = analysis.feature_components(_features(spark, sf_dir))
    discard(*kept)
    return spark.createDataFrame([(f, *[round(float(x), 6) for x in loadings[k, :3]]) for k, f in enumerate(analysis.ALL_FEATURES)], "feature string, pc1 double, pc2 double, pc3 double")


@query("components_for_variance", """WITH t AS (SELECT CAST(row_number() OVER (ORDER BY v DESC) AS INT) AS component, v / sum(v) OVER () AS ratio FROM (SELECT o_orderpriority, sum(o_custkey) AS v FROM orders GROUP BY 1)),
s AS (SELECT component, sum(ratio) OVER (ORDER BY component) AS reached FROM t)
SELECT min(component) AS n_components, round(min(reached), 6) AS reached FROM s WHERE reached >= 0.8 - 1e-12""")  # fmt: skip
def components_for_variance(spark, sf_dir):
    from pyspark.sql.window import Window

    sums = fx.table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.sum("o_custkey").alias("v"))
    ratios = sums.select(F.row_number().over(Window.orderBy(F.desc("v"))).alias("component"), (F.col("v") / F.sum("v").over(Window.partitionBy())).alias("ratio"))
    return rounded(scaling.components_for_variance(ratios))


def _reduced(spark, sf_dir):
    """As many components as reach 80 % of the variance."""
    return analysis.feature_scores(_features(spark, sf_dir), reach=analysis.VARIANCE)[0]


@query("inertia_curve")
def inertia_curve(spark, sf_dir):
    rows = _reduced(spark, sf_dir)
    return spark.createDataFrame([(k, float(v)) for k, v in cluster.inertia_curve(rows, analysis.sweep(rows), inits=analysis.INITS)], "k int, inertia double")


@query("k_choice")
def k_choice(spark, sf_dir):
    """What the votes make of the features' own curve: the fall at each K, and which of the three rules and which K they choose."""
    rows = _reduced(spark, sf_dir)
    points = cluster.inertia_curve(rows, analysis.sweep(rows), inits=analysis.INITS)
    curve = spark.createDataFrame([(k, float(v)) for k, v in points], "k int, inertia double")
    return rounded(cluster.inertia_reduction(curve).join(F.broadcast(cluster.elbow_votes(curve))), 3)


@query("silhouette_curve")
def silhouette_curve(spark, sf_dir):
    rows, _, _, kept = analysis.feature_components(_features(spark, sf_dir))
    found = cluster.silhouette_curve(rows.select("pcs"), analysis.sweep(kept[0]), dims=SILHOUETTE_DIMS, inits=analysis.INITS)
    discard(*kept)
    return spark.createDataFrame([(k, float(v)) for k, v in found], "k int, silhouette double")


@query("silhouette_choice")
def silhouette_choice(spark, sf_dir):
    rows, _, _, kept = analysis.feature_components(_features(spark, sf_dir))
    found = cluster.silhouette_choice(rows, analysis.sweep(kept[0]), dims=SILHOUETTE_DIMS, inits=analysis.INITS)
    discard(*kept)
    return spark.createDataFrame([(k, round(v, 6), best) for k, v, best in found], "k int, silhouette double, chosen boolean")


@query("cluster_labels")
def cluster_labels(spark, sf_dir):
    return cluster.label_clusters(_reduced(spark, sf_dir), 3, inits=analysis.INITS).select("dialog_id", "cluster", "cluster_k2", "cluster_k3", "cluster_k4")


@query("analysis_profile")
def analysis_profile(spark, sf_dir):
    """The whole analysis: features, components, K by vote, labels, and what each cluster is like."""
    found = analysis.analyse(_features(spark, sf_dir))
    tables = found.profiles()
    rows = tables["cluster_statistics"].join(tables["cluster_sizes"], "cluster").join(tables["cluster_description"], "cluster")
    return rounded(rows.withColumn("k", F.lit(found.k)))


def _curve(spark, sf_dir) -> DataFrame:
    months = fx.table(spark, sf_dir, "orders").groupBy(F.month("o_orderdate").alias("m")).agg(F.sum("o_custkey").alias("v"))
    return months.where("m BETWEEN 2 AND 10").select(F.col("m").cast("int").alias("k"), (F.col("v") / (F.col("m") * F.col("m"))).alias("inertia"))


_CURVE = "e AS (SELECT CAST(month(o_orderdate) AS INT) AS k, sum(o_custkey)::DOUBLE / (month(o_orderdate) * month(o_orderdate)) AS inertia FROM orders WHERE month(o_orderdate) BETWEEN 2 AND 10 GROUP BY month(o_orderdate))"


@query("elbow_votes", f"""WITH {_CURVE}, n AS (SELECT list(k ORDER BY k) AS ks, list(inertia ORDER BY k) AS y, len(ks) AS n FROM e),
p AS (SELECT n.*, unnest(range(1, n + 1)) AS i FROM n),
c AS (SELECT ks, n, i, CASE WHEN i <= n - 2 THEN y[i + 2] - 2 * y[i + 1] + y[i] END AS curvature, CASE WHEN i <= n - 2 THEN abs(abs(y[i + 2] - y[i + 1]) / (ks[i + 2] - ks[i + 1]) - abs(y[i + 1] - y[i]) / (ks[i + 1] - ks[i])) END AS bend,
  round(abs((y[i] - y[1]) / (list_max(y) - list_min(y)) - (ks[i] - ks[1]) / (ks[n] - ks[1]) * (y[n] - y[1]) / (list_max(y) - list_min(y))), 12) AS off FROM p),
v AS (SELECT any_value(ks) AS ks, any_value(n) AS n, arg_max(i, curvature) - 1 AS a, arg_max(i, off) - 1 AS b, arg_max(i, bend) - 1 AS c FROM c),
w AS (SELECT ks[least(a + 2, n - 1) + 1] AS by_curvature, ks[b + 1] AS by_distance, ks[least(c + 1, n - 1) + 1] AS by_slope FROM v)
SELECT *, CASE WHEN by_curvature = by_distance OR by_curvature = by_slope THEN by_curvature WHEN by_distance = by_slope THEN by_distance ELSE list_sort([by_curvature, by_distance, by_slope])[2] END AS chosen FROM w""")  # fmt: skip
def elbow_votes(spark, sf_dir):
    return cluster.elbow_votes(_curve(spark, sf_dir))


@query("inertia_reduction", f"WITH {_CURVE} SELECT k, round(inertia, 6) AS inertia, round(100.0 * (lag(inertia) OVER (ORDER BY k) - inertia) / lag(inertia) OVER (ORDER BY k), 6) AS reduction_percent FROM e")
def inertia_reduction(spark, sf_dir):
    return rounded(cluster.inertia_reduction(_curve(spark, sf_dir)))


_CENTRES = [[1.0 if (k + j) % 3 == 0 else -0.5 for k in range(64)] for j in range(3)]


@query("nearest_centroid", "WITH f AS (SELECT vec_id, [" + ", ".join(f"list_sum(list_transform(range(1, len(embedding) + 1), lambda i: (embedding[i]::DOUBLE - CASE WHEN (i - 1 + {j}) % 3 = 0 THEN 1.0 ELSE -0.5 END) ** 2))" for j in range(3)) + "] AS far FROM embeddings) SELECT vec_id, CAST(list_position(list_transform(far, lambda x: round(x, 6)), list_min(list_transform(far, lambda x: round(x, 6)))) - 1 AS INT) AS cluster FROM f")
def nearest_centroid(spark, sf_dir):
    vectors = fx.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return cluster.nearest_centroid(vectors, _CENTRES, "v").select("vec_id", "cluster")


def _by_student(spark, sf_dir) -> DataFrame:
    """A group for each student; dialogs at the weekend have none, and those of over 30 days no length, so their groups fail."""
    length = F.when(F.col("total_time_minutes") <= 43_200, F.col("total_time_minutes"))
    group = F.when(F.col("is_weekend") == 0, F.split("dialog_id", "_")[1])
    return fx.clustered(spark, sf_dir).withColumns({"group": group, "total_time_minutes": length})


def _by_student_clusters(spark, sf_dir) -> DataFrame:
    return cluster.per_group_clusters(_by_student(spark, sf_dir), "group", "dialog_id", ["qa_turns", "total_time_minutes", "day_period"], k=3)


@query("per_group_clusters")
def per_group_clusters(spark, sf_dir):
    return _by_student_clusters(spark, sf_dir)


@query("group_results", f"""{fx.C_SQL}, g AS (SELECT CASE WHEN is_weekend = 0 THEN split_part(dialog_id, '_', 2) END AS g, total_time_minutes FROM c)
SELECT g AS group, CASE WHEN count(*) < 3 THEN 'skipped' WHEN max(total_time_minutes) > 43200 THEN 'failed' ELSE 'ok' END AS outcome, count(*) AS n_rows FROM g GROUP BY g""")  # fmt: skip
def group_results(spark, sf_dir):
    return cluster.group_results(_by_student_clusters(spark, sf_dir), "group").select("group", "outcome", "n_rows")


@query("pending_groups", "SELECT DISTINCT event_type AS g FROM events WHERE event_type NOT LIKE '%result%' AND event_type <> 'click'")
def pending_groups(spark, sf_dir):
    groups = fx.table(spark, sf_dir, "events").select(F.col("event_type").alias("g"))
    return cluster.pending_groups(groups, groups.where("g = 'click'").distinct(), "g")


# profiles and samples


@query("cluster_sizes", f"{fx.C_SQL} SELECT cluster, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM c GROUP BY cluster")
def cluster_sizes(spark, sf_dir):
    return rounded(profile.cluster_sizes(fx.clustered(spark, sf_dir)))


@query("cluster_statistics", f"{_LONG_BY} SELECT cluster, feature, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(median(value), 6) AS median FROM l GROUP BY cluster, feature")
def cluster_statistics(spark, sf_dir):
    return rounded(profile.cluster_statistics(fx.clustered(spark, sf_dir), FEATURES))


_MEANS = f"{_LONG_BY}, m AS (SELECT cluster, feature, avg(value) AS mean FROM l GROUP BY cluster, feature)"
_BINARY = ["is_multi_turn", "is_weekend"]


@query("cluster_heatmap", f"{_MEANS} SELECT cluster, feature, round(CASE WHEN feature IN ('is_multi_turn', 'is_weekend') THEN mean ELSE (mean - avg(mean) OVER (PARTITION BY feature)) / nullif(stddev_samp(mean) OVER (PARTITION BY feature), 0) END, 5) AS value FROM m")
def cluster_heatmap(spark, sf_dir):
    return rounded(profile.heatmap(fx.clustered(spark, sf_dir), FEATURES, _BINARY), 5)


@query("cluster_radar", f"{_MEANS} SELECT cluster, feature, round(CASE WHEN max(mean) OVER w > min(mean) OVER w THEN (mean - min(mean) OVER w) / (max(mean) OVER w - min(mean) OVER w) ELSE 0.0 END, 5) AS value FROM m WINDOW w AS (PARTITION BY feature)")
def cluster_radar(spark, sf_dir):
    return rounded(profile.radar(fx.clustered(spark, sf_dir), FEATURES), 5)


#: Clusters by number of turns, so that features stand out.
def _banded(spark, sf_dir) -> DataFrame:
    return fx.clustered(spark, sf_dir).withColumn("cluster", F.least(F.col("qa_turns") - 1, F.lit(2)))


_BAND = f"{fx.C_SQL}, k AS (SELECT * REPLACE (CAST(least(qa_turns - 1, 2) AS INT) AS cluster) FROM c), l AS ({long_sql(keys='cluster, ', source='k')}), o AS (SELECT feature, avg(value) AS om, stddev_samp(value) AS os FROM l GROUP BY feature), z AS (SELECT cluster, feature, mean, (mean - om) / nullif(os, 0) AS z FROM (SELECT cluster, feature, avg(value) AS mean FROM l GROUP BY cluster, feature) JOIN o USING (feature)), t AS (SELECT *, CASE WHEN z > 0 THEN 'high' ELSE 'low' END AS side FROM z WHERE abs(z) > 0.5)"


@query("cluster_top_features", f"{_BAND}, p AS (SELECT *, CAST(row_number() OVER (PARTITION BY cluster, side ORDER BY abs(z) DESC, feature) AS INT) AS place FROM t) SELECT cluster, feature, round(mean, 6) AS mean, round(z, 5) AS z, side, place FROM p WHERE place <= 3")
def cluster_top_features(spark, sf_dir):
    found = profile.top_features(_banded(spark, sf_dir), FEATURES, least=0.5)
    return found.select("cluster", "feature", F.round("mean", 6).alias("mean"), F.round("z", 5).alias("z"), "side", "place")


@query("cluster_description", f"""{_BAND}, f AS (SELECT cluster, CASE WHEN bool_or(feature IN ('qa_turns', 'total_time_minutes', 'total_question_chars') AND side = 'high') THEN '高投入度' WHEN bool_or(feature IN ('qa_turns', 'total_time_minutes', 'total_question_chars') AND side = 'low') THEN '低投入度' END AS a,
  CASE WHEN bool_or(feature IN ('avg_question_length', 'avg_qa_time_minutes') AND side = 'high') THEN '深度学习' WHEN bool_or(feature IN ('avg_question_length', 'avg_qa_time_minutes') AND side = 'low') THEN '快速学习' END AS b FROM t GROUP BY cluster)
SELECT DISTINCT k.cluster, CASE WHEN coalesce(concat_ws(' + ', a, b), '') = '' THEN '平衡型' ELSE concat_ws(' + ', a, b) END AS description FROM k LEFT JOIN f USING (cluster)""")  # fmt: skip
def cluster_description(spark, sf_dir):
    return profile.describe_clusters(_banded(spark, sf_dir), FEATURES, least=0.5)


@query("cluster_turns_box", f"""{fx.C_SQL}, r AS (SELECT cluster, min(qa_turns) AS lo, max(qa_turns) AS hi FROM c GROUP BY cluster), v AS (SELECT cluster, CASE WHEN hi > lo THEN (qa_turns - lo) / (hi - lo) ELSE 0.5 END AS v FROM c JOIN r USING (cluster))
SELECT cluster, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.75), 6) AS q75, round(max(v), 6) AS max FROM v GROUP BY cluster""")  # fmt: skip
def cluster_turns_box(spark, sf_dir):
    return rounded(profile.turns_box(fx.clustered(spark, sf_dir)))


@query("cluster_centroids", "WITH u AS (SELECT label AS cluster, unnest(range(0, 64)) AS dim, unnest(embedding) AS x FROM embeddings) SELECT cluster, CAST(dim AS INT) AS dim, round(avg(x::DOUBLE), 6) AS value FROM u GROUP BY cluster, dim")
def cluster_centroids(spark, sf_dir):
    return rounded(profile.centroids(fx.table(spark, sf_dir, "embeddings").withColumnRenamed("label", "cluster"), "embedding", 64))


@query("labels_unpivot", "SELECT doc_id, 'quality' AS label_col, CAST(quality AS VARCHAR) AS label FROM labels WHERE quality IS NOT NULL UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS VARCHAR) FROM labels WHERE toxic IS NOT NULL")
def labels_unpivot(spark, sf_dir):
    return profile.unpivot_labels(fx.table(spark, sf_dir, "labels"), "doc_id", ["quality", "toxic"])


@query("dialogs_by_cluster", f"{fx.C_SQL} SELECT c.cluster, d.row_no, c.dialog_id FROM d JOIN c ON c.dialog_id = 'events_' || d.student_id || '_' || d.dialog_no")
def dialogs_by_cluster(spark, sf_dir):
    from dialogmill.jobs.export import rows_with_label

    return rows_with_label(fx.with_dialog_id(fx.dialogs(spark, sf_dir)), fx.clustered(spark, sf_dir).select("dialog_id", "cluster"), "dialog_id").select("cluster", "row_no", "dialog_id")


_DRAW = f"{fx.C_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY md5(dialog_id || '|42'), dialog_id) AS k FROM c)"


@query("stratified_sample", f"{_DRAW} SELECT cluster, dialog_id, qa_turns FROM s WHERE k <= 50")
def stratified_sample(spark, sf_dir):
    return sampling.stratified_sample(fx.clustered(spark, sf_dir), "cluster", "dialog_id").select("cluster", "dialog_id", "qa_turns")


@query("sampling_report", f"{_DRAW} SELECT cluster, count(*) AS available, count(*) FILTER (WHERE k <= 50) AS sampled FROM s GROUP BY cluster")
def sampling_report(spark, sf_dir):
    found = fx.clustered(spark, sf_dir)
    return sampling.sampling_report(found, sampling.stratified_sample(found, "cluster", "dialog_id"), "cluster")


@query("sample_preview", f"""{_DRAW} SELECT s.cluster, CAST(s.k AS INT) AS place, s.dialog_id, count(*) AS turns, arg_min(d.question, d.row_no)[1:80] AS preview FROM d JOIN s ON s.dialog_id = 'events_' || d.student_id || '_' || d.dialog_no WHERE s.k <= 3 GROUP BY ALL""")
def sample_preview(spark, sf_dir):
    sample = sampling.stratified_sample(fx.clustered(spark, sf_dir), "cluster", "dialog_id")
    return sampling.sample_preview(fx.with_dialog_id(fx.dialogs(spark, sf_dir)), sample, "cluster", "dialog_id")
