"""Queries of the interval, scalar and look-up operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..jobs.fixtures import KEY, residues, with_gaps
from ..operators import intervals as I  # noqa: E741
from ..operators import lookups as L
from ..operators import residues as R
from ..registry import query
from .sql import BASE, GAPS, runs


@query("ranges_of", GAPS + """,
v as (select chain_id, res_seq as value from wide group by all),
g as (select chain_id, value, value - row_number() over (partition by chain_id order by value) as isl from v),
s as (select chain_id, min(value) as "start", max(value) as "end" from g group by chain_id, isl)
select chain_id, cast(row_number() over (partition by chain_id order by "start") - 1 as int) as range_no, cast("start" as int) as "start", cast("end" as int) as "end" from s""")
def ranges_of(spark, d):
    values = with_gaps(residues(spark, d)).select("chain_id", F.col("res_seq").alias("value"))
    return I.ranges_of(values, KEY)


INSERTIONS = GAPS + """,
g as (select *, cast(regexp_replace(res_label, '[^0-9]', '', 'g') as int) as num from wide),
g1 as (select *, case when num - lag(num) over (partition by chain_id order by pos) in (0, 1) then 0 else 1 end as brk from g),
g2 as (select *, sum(brk) over (partition by chain_id order by pos) - 1 as run from g1),
ri as (select chain_id, cast(run as int) as range_no, arg_min(res_label, pos) as "start", arg_max(res_label, pos) as "end" from g2 group by chain_id, run)
"""


@query("ranges_with_insertions", INSERTIONS + "select * from ri")
def ranges_with_insertions(spark, d):
    return I.ranges_with_insertions(with_gaps(residues(spark, d)), KEY)


@query("format_ranges", INSERTIONS + """select chain_id, string_agg(case when "start" = "end" then "start" else "start" || '-' || "end" end, ', ' order by range_no) as ranges from ri group by chain_id""")
def format_ranges(spark, d):
    return I.format_ranges(I.ranges_with_insertions(with_gaps(residues(spark, d)), KEY), KEY)


@query("label_runs", BASE + ",\n" + runs("pred") + " select * from runs")
def label_runs(spark, d):
    return I.label_runs(residues(spark, d).withColumn("label", F.col("pred")), KEY)


@query("labelled_ranges", GAPS + """,
q as (select chain_id, pos, pred as label, pos - lag(pos) over w as gap, pred = lag(pred) over w as same from wide window w as (partition by chain_id order by pos)),
q1 as (select *, cast(sum(case when same then 0 else 1 end) over (partition by chain_id order by pos) - 1 as int) as run from q)
select chain_id, run, label, pos from q1 where coalesce(not same, true) or label = -1 or gap = 1""")
def labelled_ranges(spark, d):
    return I.labelled_ranges(with_gaps(residues(spark, d)).select("chain_id", "pos", F.col("pred").alias("label")), KEY)


@query("domain_points", BASE + """,
q as (select chain_id, pos, true_label as label, lag(true_label) over (partition by chain_id order by pos) as prev from res)
select chain_id, pos as "start", pos as "end" from q where prev <> label and prev <> -1 and label <> -1""")
def domain_points(spark, d):
    return I.domain_points(residues(spark, d).select("chain_id", "pos", F.col("true_label").alias("label")), KEY)


@query("internal_linkers", BASE + ",\n" + runs("pred") + """
select chain_id, "start", "end" from (select *, max(run) over (partition by chain_id) as last from runs) where label = -1 and run > 0 and run < last""")
def internal_linkers(spark, d):
    return I.internal_linkers(residues(spark, d).select("chain_id", "pos", F.col("pred").alias("label")), KEY)


@query("split_segments_at", BASE + """,
s as (select chain_id, cast(floor(pos/20) as int) as seg, pos % 20 as ord, pos as element from res),
s1 as (select *, case when element % 7 = 3 and ord > min(ord) over w and ord < max(ord) over w then 1 else 0 end as c from s window w as (partition by chain_id, seg))
select chain_id, seg, ord, element, cast(sum(c) over (partition by chain_id, seg order by ord) as int) as part from s1""")
def split_segments_at(spark, d):
    rows = residues(spark, d)
    segments = rows.select("chain_id", F.floor(F.col("pos") / 20).cast("int").alias("seg"), (F.col("pos") % 20).alias("ord"), F.col("pos").alias("element"))
    return I.split_segments_at(segments, rows.where("pos % 7 = 3").select("chain_id", F.col("pos").alias("point")), KEY)


@query("forward_fill_labels", GAPS + """,
q as (select chain_id, res_num, pred as label, res_label from wide),
a as (select chain_id, min(res_num) as lo, max(res_num) as hi from q group by chain_id),
x as (select chain_id, unnest(generate_series(lo, hi)) as res_num from a),
y as (select x.chain_id, x.res_num, (select max(q.res_num) from q where q.chain_id = x.chain_id and q.res_num <= x.res_num) as src from x)
select y.chain_id, cast(y.res_num as int) as res_num, q.label, q.res_label from y join q on q.chain_id = y.chain_id and q.res_num = y.src""")
def forward_fill_labels(spark, d):
    rows = with_gaps(residues(spark, d)).select("chain_id", "pos", "res_num", F.col("pred").alias("label"), "res_label")
    return I.forward_fill_labels(rows, KEY)


@query("is_nucleotide", """select part_no as p, p_brand, ok from (select p_partkey as part_no, p_brand, upper(trim(split_part(p_name, ' ', 1))) in ('A','C','G','U','I','T','DA','DC','DG','DT','DU')
 or upper(trim(split_part(p_name, ' ', 1))) like 'D%' as ok from part)""")
def is_nucleotide(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    return part.select(F.col("p_partkey").alias("p"), "p_brand", C.is_nucleotide(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("ok"))


@query("contact_weight", "select l_orderkey, l_linenumber, l_partkey, round(1/(1+exp((l_quantity-8.0)/1.5)), 9) as weight, l_suppkey from lineitem")
def contact_weight(spark, d):
    items = spark.read.parquet(f"{d}/lineitem.parquet")
    return items.select("l_orderkey", "l_linenumber", "l_partkey", F.round(C.contact_weight(F.col("l_quantity")), 9).alias("weight"), "l_suppkey")


@query("base_number", BASE + " select chain_id, pos, cast(regexp_replace(res_label, '[^0-9]', '', 'g') as int) as number from res")
def base_number(spark, d):
    return residues(spark, d).select("chain_id", "pos", C.base_number(F.col("res_label")).alias("number"))


@query("align_ss", BASE + """,
s as (select chain_id, string_agg(ss, '' order by pos) as t, count(*) as n, count(*) filter (where truth <> -1) as m from res group by chain_id)
select chain_id, rpad(t, cast(case when chain_id % 2 = 0 then m else n + 7 end as int), 'C') as aligned from s""")
def align_ss(spark, d):
    """Every chain to a number of its own: its residues outside linkers (fewer), or seven more than it has."""
    n = F.when(F.col("chain_id") % 2 == 0, F.count(F.when(F.col("truth") != -1, 1))).otherwise(F.count("*") + 7)
    codes = residues(spark, d).groupBy("chain_id").agg(F.sort_array(F.collect_list(F.struct("pos", "ss")))["ss"].alias("codes"), n.cast("int").alias("n"))
    return codes.select("chain_id", F.array_join(L.align_ss(F.col("codes"), F.col("n")), "").alias("aligned"))


@query("align_ss_whole", BASE + """,
n as (select chain_id, count(*) as n from res group by chain_id),
s as (select chain_id, string_agg(ss, '' order by pos) as t from res where pos % 10 <> 3 group by chain_id)
select chain_id, rpad(coalesce(t, ''), cast(n as int), 'C') as aligned from n left join s using (chain_id)""")
def align_ss_whole(spark, d):
    """Every chain to its own number of residues."""
    kept = F.when(F.col("pos") % 10 != 3, F.struct("pos", "ss"))
    codes = residues(spark, d).groupBy("chain_id").agg(F.sort_array(F.collect_list(kept))["ss"].alias("codes"), F.count("*").cast("int").alias("n"))
    return codes.select("chain_id", F.array_join(L.align_ss(F.col("codes"), F.col("n")), "").alias("aligned"))


@query("hamming_distance", BASE + " select chain_id, round(1 - avg(case when pred = truth then 1.0 else 0.0 end), 9) as distance from res group by chain_id")
def hamming_distance(spark, d):
    rows = residues(spark, d).groupBy("chain_id").agg(F.sort_array(F.collect_list(F.struct("pos", "pred", "truth"))).alias("r"))
    return rows.select("chain_id", F.round(C.hamming(F.col("r.pred"), F.col("r.truth")), 9).alias("distance"))


_SEG = BASE + ",\n" + runs("pred", name="p") + ",\n" + runs("truth", name="t")


@query("boundary_distance", _SEG + """
select p.chain_id, p.run as a, t.run as b, (abs(p."start"-t."start") + abs(p."end"-t."end"))/2 as d from p join t on p.chain_id = t.chain_id where p.label <> -1 and t.label <> -1""")
def boundary_distance(spark, d):
    return _segment_pairs(spark, d, C.boundary_distance)


@query("range_gap", _SEG + """
select p.chain_id, p.run as a, t.run as b, cast(case when p."end" < t."start" then t."start" - p."end" when t."end" < p."start" then p."start" - t."end" else 0 end as int) as d from p join t on p.chain_id = t.chain_id where p.label <> -1 and t.label <> -1""")
def range_gap(spark, d):
    return _segment_pairs(spark, d, C.range_gap)


def _segment_pairs(spark, d, f):
    rows = residues(spark, d)
    sides = []
    for side in ("pred", "truth"):
        runs_ = I.label_runs(rows.select("chain_id", "pos", F.col(side).alias("label")), KEY).where("label <> -1")
        sides.append(runs_.select("chain_id", F.col("run").alias(f"r{side}"), F.col("start").alias(f"s{side}"), F.col("end").alias(f"e{side}")))
    pairs = sides[0].join(sides[1], "chain_id")
    return pairs.select("chain_id", F.col("rpred").alias("a"), F.col("rtruth").alias("b"), f(F.col("spred"), F.col("epred"), F.col("struth"), F.col("etruth")).alias("d"))


@query("expand_ranges", _SEG + """ select chain_id, string_agg(cast(x as varchar), ',' order by run, x) as positions from (select chain_id, run, unnest(range("start", "end")) as x from p where label <> -1) group by chain_id""")
def expand_ranges(spark, d):
    runs_ = I.label_runs(residues(spark, d).select("chain_id", "pos", F.col("pred").alias("label")), KEY).where("label <> -1")
    ranges = runs_.groupBy("chain_id").agg(F.sort_array(F.collect_list(F.struct(F.col("start").alias("s"), F.col("end").alias("e")))).alias("ranges"))
    return ranges.select("chain_id", F.array_join(C.expand_ranges(F.col("ranges")).cast("array<string>"), ",").alias("positions"))


@query("shift_residue_labels", BASE + """ select chain_id, pos, cast(chain_id % 9 - 4 + row_number() over (partition by chain_id order by pos) - 1 as int) as shifted from res""")
def shift_residue_labels(spark, d):
    """Labels that start at a number of the chain, negative ones included."""
    label = F.concat((F.col("res_seq") + F.col("chain_id") % 9 - 4).cast("int").cast("string"), "icode")
    return R.shift_residue_labels(residues(spark, d).withColumn("res_label", label), KEY)


@query("ordinal_map", BASE + " select chain_id, pos, cast(res_seq as varchar) as res_label, cast(max(pos + 1) over (partition by chain_id, res_seq) as int) as ordinal from res")
def ordinal_map(spark, d):
    return R.ordinal_map(residues(spark, d).withColumn("res_label", F.col("res_seq").cast("string")), KEY)


@query("canonical_sequence", GAPS + """,
s as (select chain_id, res_seq, pos, res_name, res_seq - lag(res_seq) over (partition by chain_id order by res_seq, pos) - 1 as gap from wide)
select chain_id, string_agg(repeat('-', cast(greatest(coalesce(gap, 0), 0) as int)) || res_name, '' order by res_seq, pos) as sequence from s group by chain_id""")
def canonical_sequence(spark, d):
    return R.canonical_sequence(with_gaps(residues(spark, d)), KEY)


_NAMES = {"PSU": "U", "DA": "A", "OMU": "U", "2MA": "A", "GTP": "G", "DT": "T", "DI": "I", "X": "N", "zzz": "ZZZ", " c4j": "C"}
_NAME_AT = "{" + ", ".join(f"{k}: '{v}'" for k, v in enumerate(_NAMES.values())) + "}"


@query("canonical_sequence_modified", BASE + f"""
select chain_id, string_agg(map {_NAME_AT}[cast(pos % {len(_NAMES)} as int)], '' order by res_seq, pos) as sequence from res group by chain_id""")
def canonical_sequence_modified(spark, d):
    """Chains of deoxynucleotides, modified and unknown names."""
    names = F.array(*(F.lit(n) for n in _NAMES))
    return R.canonical_sequence(residues(spark, d).withColumn("res_name", names[F.col("pos") % len(_NAMES)]), KEY)


# Look-ups

_PART = BASE + ",\n" + runs("true_label", name="t") + """,
dom as (select chain_id, label, string_agg(case when "start" = "end" then cast("start" as varchar) else ("start" + 1) || '-' || ("end" + 1) end, '+' order by "start") as txt from t group by chain_id, label),
part_txt as (select chain_id, string_agg(txt, ' ; ' order by label) as partition from dom group by chain_id)"""


def _partitions(rows):
    runs_ = I.label_runs(rows.select("chain_id", "pos", F.col("true_label").alias("label")), KEY)
    text = F.when(F.col("start") == F.col("end"), F.col("start").cast("string")).otherwise(F.concat_ws("-", (F.col("start") + 1).cast("string"), (F.col("end") + 1).cast("string")))
    domains = runs_.groupBy("chain_id", "label").agg(F.array_join(F.sort_array(F.collect_list(F.struct("start", text.alias("t"))))["t"], "+").alias("t"))
    return domains.groupBy("chain_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("label", "t")))["t"], " ; ").alias("partition"))


@query("parse_partition", _PART + """,
d1 as (select chain_id, unnest(string_split(replace(partition, ' ', ''), ';')) as dm, generate_subscripts(string_split(replace(partition, ' ', ''), ';'), 1) - 1 as label from part_txt),
d2 as (select chain_id, label, unnest(string_split(dm, '+')) as seg from d1)
select chain_id, cast(label as int) as label, cast(split_part(seg, '-', 1) as int) as "start", cast(case when seg like '%-%' then split_part(seg, '-', 2) else seg end as int) as "end" from d2""")
def parse_partition(spark, d):
    return L.parse_partition(_partitions(residues(spark, d)), KEY)


@query("labels_from_partition", _PART + """
select res.chain_id, res.pos, cast(coalesce((select min(t.label) from t where t.chain_id = res.chain_id and
  case when t."start" < t."end" then res.res_num between t."start" + 1 and t."end" + 1 else res.res_num = t."start" end), -1) as int) as label from res""")
def labels_from_partition(spark, d):
    rows = residues(spark, d)
    return L.labels_from_partition(rows, L.parse_partition(_partitions(rows), KEY), KEY)


_LOOK = BASE + ",\n" + runs("pred", name="p") + """,
v as (select chain_id, pos as value from res),
g as (select chain_id, "start", "end" from p where label = 1)"""


_LOOK_WHOLE = BASE + ",\n" + runs("pred", name="p") + """,
v as (select chain_id, pos as value from res),
g as (select chain_id, "start", "end" from p where label <> -1)"""


def _look(spark, d, given="label = 1"):
    """Every residue, and the ranges of some labels."""
    rows = residues(spark, d)
    ranges = I.label_runs(rows.select("chain_id", "pos", F.col("pred").alias("label")), KEY).where(given)
    return rows.select("chain_id", F.col("pos").alias("value")), ranges


@query("asof_bounds_below", _LOOK + """
select v.chain_id, v.value, cast(coalesce((select max("start") from g where g.chain_id = v.chain_id and g."start" <= v.value), -1) as int) as "start",
 cast(coalesce((select max("end") from g where g.chain_id = v.chain_id and g."end" <= v.value), -1) as int) as "end" from v""")
def asof_bounds_below(spark, d):
    return L.asof_bounds_below(*_look(spark, d), KEY)


@query("asof_bounds_above", _LOOK + """
select v.chain_id, v.value, cast(coalesce((select min("start") from g where g.chain_id = v.chain_id and g."start" >= v.value), v.value) as int) as "start",
 cast(coalesce((select min("end") from g where g.chain_id = v.chain_id and g."end" >= v.value), v.value) as int) as "end" from v""")
def asof_bounds_above(spark, d):
    return L.asof_bounds_above(*_look(spark, d), KEY)


@query("asof_bounds_below_whole", _LOOK_WHOLE + """
select v.chain_id, v.value, cast(coalesce((select max("start") from g where g.chain_id = v.chain_id and g."start" <= v.value), -1) as int) as "start",
 cast(coalesce((select max("end") from g where g.chain_id = v.chain_id and g."end" <= v.value), -1) as int) as "end" from v""")
def asof_bounds_below_whole(spark, d):
    return L.asof_bounds_below(*_look(spark, d, "label <> -1"), KEY)


@query("asof_bounds_above_whole", _LOOK_WHOLE + """
select v.chain_id, v.value, cast(coalesce((select min("start") from g where g.chain_id = v.chain_id and g."start" >= v.value), v.value) as int) as "start",
 cast(coalesce((select min("end") from g where g.chain_id = v.chain_id and g."end" >= v.value), v.value) as int) as "end" from v""")
def asof_bounds_above_whole(spark, d):
    return L.asof_bounds_above(*_look(spark, d, "label <> -1"), KEY)


@query("asof_floor", BASE + """,
el as (select chain_id, cast((pos * 11) % 40 + 9 as int) as element, pos as idx from res where pos % 5 = 2),
v as (select chain_id, pos as value from res)
select v.chain_id, v.value, cast(max(el.element) as int) as element, cast(coalesce(arg_min(el.idx, struct_pack(a := -el.element, b := el.idx)), -1) as int) as idx
from v left join el on el.chain_id = v.chain_id and el.element <= v.value group by v.chain_id, v.value""")
def asof_floor(spark, d):
    return _floor(spark, d, (F.col("pos") * 11) % 40 + 9)


@query("asof_floor_whole", BASE + """,
el as (select chain_id, cast((pos * 7) % 50 + 3 as int) as element, pos as idx from res where pos % 5 = 2),
v as (select chain_id, pos as value from res)
select v.chain_id, v.value, cast(max(el.element) as int) as element, cast(coalesce(arg_min(el.idx, struct_pack(a := -el.element, b := el.idx)), -1) as int) as idx
from v left join el on el.chain_id = v.chain_id and el.element <= v.value group by v.chain_id, v.value""")
def asof_floor_whole(spark, d):
    return _floor(spark, d, (F.col("pos") * 7) % 50 + 3)


def _floor(spark, d, element):
    rows = residues(spark, d)
    elements = rows.where("pos % 5 = 2").select("chain_id", element.cast("int").alias("element"), F.col("pos").alias("idx"))
    return L.asof_floor(rows.select("chain_id", F.col("pos").alias("value")), elements, KEY)


@query("segment_of", BASE + """,
sg as (select chain_id, cast(floor(pos/20) as int) as seg, pos % 20 as ord, cast(pos % 47 as int) as element from res),
lst as (select * from (select *, max(ord) over (partition by chain_id, seg) as m from sg) where ord = m),
v as (select distinct chain_id, pos as value from res)
select v.chain_id, v.value, cast(coalesce((select min(seg) from sg where sg.chain_id = v.chain_id and sg.element = v.value), -1) as int) as any_seg,
 cast(coalesce((select min(seg) from sg where sg.chain_id = v.chain_id and ord = 0 and sg.element = v.value), -1) as int) as first_seg,
 cast(coalesce((select min(seg) from lst where lst.chain_id = v.chain_id and lst.element = v.value), -1) as int) as last_seg from v""")
def segment_of(spark, d):
    return _segments(spark, d, 47)


@query("segment_of_whole", BASE + """,
sg as (select chain_id, cast(floor(pos/20) as int) as seg, pos % 20 as ord, cast(pos % 33 as int) as element from res),
lst as (select * from (select *, max(ord) over (partition by chain_id, seg) as m from sg) where ord = m),
v as (select distinct chain_id, pos as value from res)
select v.chain_id, v.value, cast(coalesce((select min(seg) from sg where sg.chain_id = v.chain_id and sg.element = v.value), -1) as int) as any_seg,
 cast(coalesce((select min(seg) from sg where sg.chain_id = v.chain_id and ord = 0 and sg.element = v.value), -1) as int) as first_seg,
 cast(coalesce((select min(seg) from lst where lst.chain_id = v.chain_id and lst.element = v.value), -1) as int) as last_seg from v""")
def segment_of_whole(spark, d):
    return _segments(spark, d, 33)


def _segments(spark, d, period):
    rows = residues(spark, d)
    segs = rows.select("chain_id", F.floor(F.col("pos") / 20).cast("int").alias("seg"), (F.col("pos") % 20).alias("ord"), (F.col("pos") % period).alias("element"))
    values = rows.select("chain_id", F.col("pos").alias("value"))
    out = L.segment_of(values, segs, KEY).withColumnRenamed("seg", "any_seg")
    for order in ("first", "last"):
        out = out.join(L.segment_of(values, segs, KEY, order).withColumnRenamed("seg", f"{order}_seg"), ["chain_id", "value"])
    return out


@query("attach_ss", BASE + """,
a as (select chain_id, res_seq, arg_max(ss, pos) as ss from res where pos % 3 <> 0 group by chain_id, res_seq)
select res.chain_id, res.pos, coalesce(a.ss, 'C') as ss from res left join a using (chain_id, res_seq)""")
def attach_ss(spark, d):
    rows = residues(spark, d).withColumn("res_label", F.col("res_seq").cast("string"))
    given = rows.where("pos % 3 <> 0").select("chain_id", "res_label", "ss", F.col("pos").alias("ord"))
    return L.attach_ss(rows.drop("ss"), given, KEY).select("chain_id", "pos", "ss")


@query("overlap_components", BASE + """,
c as (select distinct chain_id, cast(floor(pos/20) as int) as cluster, cast(pos % 50 as int) as member from res),
l as (select distinct a.chain_id, a.cluster as x, b.cluster as y from c a join c b on a.chain_id = b.chain_id and a.member = b.member),
w as (with recursive t(chain_id, x, y) as (select chain_id, x, y from l union select t.chain_id, t.x, l.y from t join l on l.chain_id = t.chain_id and l.x = t.y) select * from t),
k as (select chain_id, x as cluster, min(y) as component, count(distinct y) as n from w group by chain_id, x)
select distinct c.chain_id, cast(k.component as int) as component, c.member from c join k using (chain_id, cluster) where k.n > 1""")
def overlap_components(spark, d):
    rows = residues(spark, d).select("chain_id", F.floor(F.col("pos") / 20).cast("int").alias("cluster"), (F.col("pos") % 50).alias("member"))
    return L.overlap_components(rows, KEY)
