"""Cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from foldspark.functions import columns as C
from foldspark.operators import cleanup, cuts, intervals, lookups, residues, scores

K = ["c"]


def labels(spark, *values, **more):
    rows = [(1, i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "c int, pos int, label int")


def both(spark, true, pred):
    return spark.createDataFrame([(1, i, t, p) for i, (t, p) in enumerate(zip(true, pred, strict=True))], "c int, pos int, true int, pred int")


A = ([0] * 5 + [1] * 5, [0] * 6 + [1] * 4)
B = ([-1] * 2 + [0] * 4 + [-1] * 2 + [1] * 4, [-1] + [0] * 6 + [1] * 5)


@pytest.mark.parametrize("case, want", [(A, {"ndo": 0.8, "iou": 0.816667, "csd": 0.975, "dbd": 0.95, "norm_vi": 0.226067, "cdo": 0, "sdc": 1}), (B, {"ndo": 0.8125, "iou": 0.733333, "csd": 0.975, "dbd": 1.0, "norm_vi": 0.351455, "cdo": 1, "sdc": 1})])
def test_scores(spark, case, want):
    rows = both(spark, *case)
    got = {name: getattr(scores, name)(rows, K).first()[name] for name in want}
    assert got == pytest.approx(want, abs=1e-6)


def test_one_domain_against_two(spark):
    rows = both(spark, [0] * 4 + [1] * 4, [0] * 8)
    assert scores.dbd(rows, K).first()["dbd"] == 0
    assert scores.sdc(rows, K).first()["sdc"] == 0.5


def test_labels_against_themselves(spark):
    rows = both(spark, B[0], B[0])
    for name, value in (("ndo", 1), ("iou", 1), ("csd", 1), ("norm_vi", 0)):
        assert getattr(scores, name)(rows, K).first()[name] == pytest.approx(value)


def test_no_domains(spark):
    rows = both(spark, [-1] * 4, [0] * 4)
    assert scores.ndo(rows, K).first()["ndo"] is None
    assert scores.csd(rows, K).first()["csd"] is None
    assert scores.iou(rows, K).first()["iou"] == 0
    assert scores.dbd(rows, K).first()["dbd"] == 0
    none = both(spark, [0] * 4, [-1] * 4)
    assert scores.csd(none, K).first()["csd"] == 0


def test_ranges(spark):
    values = spark.createDataFrame([(1, v) for v in (7, 8, 1, 3, 2, 5, 5)], "c int, value int")
    assert [(r.start, r.end) for r in intervals.ranges_of(values, K).orderBy("range_no").collect()] == [(1, 3), (5, 5), (7, 8)]


@pytest.mark.parametrize("given, want", [("1,2,11,11A,11B,12,13", [("1", "2"), ("11", "13")]), ("100,100A,100B,101", [("100", "101")])])
def test_insertions(spark, given, want):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(given.split(","))], "c int, pos int, res_label string")
    assert [(r.start, r.end) for r in intervals.ranges_with_insertions(rows, K).orderBy("range_no").collect()] == want


def test_format_ranges(spark):
    rows = spark.createDataFrame([(1, 0, "1", "2"), (1, 1, "11", "11B"), (1, 2, "12", "13"), (1, 3, "15", "15")], "c int, range_no int, start string, end string")
    assert intervals.format_ranges(rows, K).first()["ranges"] == "1-2, 11-11B, 12-13, 15"


def test_shifted_labels(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(["10", "10A", "10B", "11", "12"])], "c int, pos int, res_label string")
    assert [r.shifted for r in residues.shift_residue_labels(rows, K).orderBy("pos").collect()] == [10, 11, 12, 13, 14]


def test_partition(spark):
    text = spark.createDataFrame([(1, "1-2+5;3-4")], "c int, partition string")
    rows = spark.createDataFrame([(1, i, i + 1) for i in range(6)], "c int, pos int, res_num int")
    found = lookups.labels_from_partition(rows, lookups.parse_partition(text, K), K)
    assert [r.label for r in found.orderBy("pos").collect()] == [0, 0, 1, 1, 0, -1]


def test_sequence(spark):
    rows = spark.createDataFrame([(1, 0, 1, "A"), (1, 1, 2, "PSU"), (1, 2, 5, "G")], "c int, pos int, res_seq int, res_name string")
    assert residues.canonical_sequence(rows, K).first()["sequence"] == "AU--G"


@pytest.mark.parametrize("ss, want", [("CCCCCCCCHH", [1, 7, 8]), ("HHCCCCCCCCH", [2, 8, 10])])
def test_cut_candidates(spark, ss, want):
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate(ss)], "c int, pos int, ss string")
    assert sorted(r.k for r in cuts.cut_candidates(rows, K).collect()) == want


def test_bounds(spark):
    ranges = spark.createDataFrame([(1, 1, 4), (1, 6, 9)], "c int, start int, end int")
    v = spark.createDataFrame([(1, 7)], "c int, value int")
    assert lookups.asof_bounds_below(v, ranges, K).first()[2:] == (6, 4)
    assert lookups.asof_bounds_above(v, ranges, K).first()[2:] == (7, 9)


def test_hamming(spark):
    row = spark.createDataFrame([(list("abcd"), list("abxd"))], "a array<string>, b array<string>")
    assert row.select(C.hamming(F.col("a"), F.col("b"))).first()[0] == 0.25


def test_curate(spark):
    rows = spark.createDataFrame([(1, i, s, v) for i, (s, v) in enumerate(zip("CHHHHC", [0, 0, 0, 1, 1, 1], strict=True))], "c int, pos int, ss string, label int")
    assert [r.label for r in cleanup.curate_by_ss(rows, K).orderBy("pos").collect()] == [0, 0, 0, 0, 0, 1]


def test_outlier_segments(spark):
    out = cleanup.merge_outlier_segments(labels(spark, *[0] * 12, *[-1] * 3, *[1] * 20), K)
    assert [r.label for r in out.orderBy("pos").collect()] == [0] * 12 + [1] * 23
    alone = cleanup.merge_outlier_segments(labels(spark, *[-1] * 5), K)
    assert [r.label for r in alone.orderBy("pos").collect()] == [-1] * 5


def test_weight(spark):
    assert spark.range(1).select(C.contact_weight(F.lit(8.0))).first()[0] == 0.5


def test_small_clusters():
    assert cleanup.merged_runs([0] * 40 + [1] * 5 + [0] * 40) == [0] * 85
    assert cleanup.merged_runs([0] * 10) == [-1] * 10
    assert cleanup.merged_runs([-1] * 30 + [2] * 3 + [-1] * 30) == [-1] * 63


def test_post_process():
    assert cleanup.post_processed([0] * 40 + [-1] * 4 + [0] * 40) == [0] * 84
    assert cleanup.post_processed([0] * 40 + [-1] * 4 + [1] * 40) == [0] * 42 + [1] * 42
    assert cleanup.post_processed([0] * 40 + [1] * 5 + [0] * 40) == [0] * 85
    assert cleanup.post_processed([0] * 50) == [0] * 50


def test_post_process_with_gaps():
    # A domain residue after a gap is not counted: 29 are, so the run is short and is given away, the odd one in turn.
    places = [*range(40), *range(40, 60), *range(62, 72), *range(72, 112)]
    out = cleanup.post_processed([0] * 40 + [1] * 30 + [0] * 40, places=places)
    assert out == [0] * 110
    assert cleanup.post_processed([0] * 40 + [1] * 30 + [0] * 40, passes=1, places=places) == [0] * 60 + [1] + [0] * 49
    whole = cleanup.post_processed([0] * 40 + [1] * 30 + [0] * 40)
    assert whole == [0] * 40 + [1] * 30 + [0] * 40
    # Outliers are counted across gaps.
    places = [*range(40), *range(50, 55), *range(60, 65), *range(65, 105)]
    assert cleanup.post_processed([0] * 40 + [-1] * 10 + [1] * 40, places=places) == [0] * 40 + [-1] * 10 + [1] * 40
    assert cleanup.post_processed([0] * 40 + [-1] * 9 + [1] * 40) == [0] * 44 + [1] * 45
    assert cleanup.post_processed([3]) == [3] and cleanup.post_processed([]) == []


def test_post_process_frames_use_positions(spark):
    places = [*range(40), *range(40, 60), *range(62, 72), *range(72, 112)]
    rows = [("c", p, v) for p, v in zip(places, [0] * 40 + [1] * 30 + [0] * 40, strict=True)]
    out = cleanup.post_process(spark.createDataFrame(rows, "chain_id string, pos int, label int"), ["chain_id"])
    assert [r.label for r in sorted(out.collect())] == [0] * 110
