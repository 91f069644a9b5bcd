"""What operators give for nulls, residue by residue."""

from pyspark.sql import functions as F

from foldspark.operators import cleanup, clusters, graph, intervals, scores

K = ["chain_id"]


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def labels(spark):
    given = [(1, 0, 0), (1, 1, None), (1, 2, None), (1, 3, 0), (1, None, 1), (None, 0, 2), (None, 1, 2)]
    return spark.createDataFrame(given, "chain_id int, pos int, label int")


def test_runs_and_ranges(spark):
    given = labels(spark)
    want = [(1, 0, 0, 0, 0), (1, 1, None, 1, 1), (1, 2, None, 2, 2), (1, 3, 0, 3, 3), (None, 0, 2, 0, 1)]
    assert rows(intervals.label_runs(given, K), "chain_id", "run", "label", "start", "end") == want
    assert rows(intervals.ranges_of(given, K, "pos"), "chain_id", "range_no", "start", "end") == [(1, 0, 0, 3), (None, 0, 0, 1)]
    assert (1, 4, 0, 3) not in rows(intervals.labelled_ranges(given, K), "chain_id", "run", "label", "pos")
    assert intervals.labelled_ranges(given, K).where("pos is null").count() == 0
    assert rows(intervals.domain_points(given.fillna({"label": 5}), K), "chain_id", "start") == [(1, 1), (1, 3)]
    assert intervals.domain_points(given, K).count() == 0
    filled = given.withColumn("res_num", F.col("pos") + 1).withColumn("res_label", F.lit("x")).where("chain_id = 1")
    assert rows(intervals.forward_fill_labels(filled, K), "res_num", "label") == [(1, 0), (2, None), (3, None), (4, 0)]


def test_clusters_and_clean_up(spark):
    given = labels(spark)
    assert rows(clusters.labels_to_clusters(given, K), "chain_id", "label", "members") == [(1, 0, [0, 3]), (1, 1, []), (None, 2, [0, 1])]
    assert rows(clusters.labels_to_clusters(given, K, keep_outliers=True), "label") == [(0,), (1,), (2,)]
    assert rows(cleanup.merge_small_clusters(given, K, 2), "chain_id", "pos", "label") == [(1, 0, -1), (1, 1, -1), (1, 2, -1), (1, 3, -1), (None, 0, 2), (None, 1, 2)]
    assert rows(cleanup.merge_outlier_segments(given, K), "chain_id", "pos", "label") == [(1, 0, 0), (1, 1, None), (1, 2, None), (1, 3, 0), (None, 0, 2), (None, 1, 2)]


def test_contacts_without_coordinates(spark):
    given = [(1, 0, 0.0, 0.0, 0.0), (1, 1, None, 0.0, 0.0), (1, 2, 2.0, 0.0, 0.0), (1, 3, 3.0, 0.0, 0.0), (1, 5, 4.0, None, 0.0)]
    edges = graph.contact_edges(spark.createDataFrame(given, "chain_id int, pos int, x double, y double, z double"), 5.0, K)
    assert rows(edges.where("weight is null"), "i", "j") == [(0, 1), (1, 2), (3, 5)]
    assert rows(edges.where("weight is not null"), "i", "j") == [(0, 2), (0, 3), (2, 3)]
    degree = {r.pos: (r.degree, r.weighted_degree) for r in graph.node_degree(edges, K).collect()}
    assert degree[1] == (2, None) and degree[5] == (1, None) and degree[0][0] == 3 and degree[0][1] > 1.9


def test_scores_of_unlabelled_residues(spark):
    given = [(1, k, t, p) for k, (t, p) in enumerate([(0, 0), (0, None), (None, 1), (1, 1)])] + [(2, 0, None, None)]
    both = spark.createDataFrame(given, "chain_id int, pos int, true int, pred int")
    assert rows(scores.ndo(both, K), "chain_id", "ndo") == [(1, 4 / 6), (2, None)]
    assert rows(scores.iou(both, K), "chain_id", "iou") == [(1, 0.5), (2, 0.0)]
    assert rows(scores.sdc(both, K), "chain_id", "sdc") == [(1, 1.0), (2, None)]
    assert rows(scores.csd(both, K), "chain_id", "csd")[1] == (2, None)


def test_scores_of_residues_without_a_place(spark):
    """They count as residues, and are in no segment; a chain without a key has no score that needs a join."""
    given = [(1, k, k // 30, k // 33) for k in range(60)] + [(1, None, 0, 0), (2, None, 1, 1), (3, 0, -1, -1)] + [(None, k, k // 30, k // 33) for k in range(60)]
    both = spark.createDataFrame(given, "chain_id int, pos int, true int, pred int")
    assert rows(scores.csd(both, K), "chain_id", "csd") == [(1, 18.5 / 20), (2, None), (3, None), (None, None)]
    assert rows(scores.dbd(both, K), "chain_id", "dbd") == [(1, 17 / 20), (2, 1.0), (3, None), (None, None)]
    report = scores.score_report(both, K)
    assert rows(report, "chain_id", "csd", "dbd") == [(1, 0.925, 0.85), (2, None, 1.0), (3, None, None)]


def test_score_report_equals_the_single_scores(spark):
    both = spark.createDataFrame([(1, k, k // 30, k // 33) for k in range(60)], "chain_id int, pos int, true int, pred int")
    alone = {f: rows(getattr(scores, f)(both, K), f)[0][0] for f in ("csd", "iou", "ndo", "dbd")}
    report = scores.score_report(both, K)
    assert {f: rows(report, f)[0][0] for f in alone} == {f: round(v, 3) for f, v in alone.items()}
    joint = scores.joint_runs(both, K)
    assert rows(joint, "run", "true", "pred", "start", "end", "n") == [(0, 0, 0, 0, 29, 30), (1, 1, 0, 30, 32, 3), (2, 1, 1, 33, 59, 27)]
