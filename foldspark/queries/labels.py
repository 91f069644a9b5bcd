"""Queries of scores and label clean-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..jobs.fixtures import KEY, residues
from ..operators import cleanup as U
from ..operators import clusters as A
from ..operators import scores as S
from ..registry import query
from .graph import _SIL
from .sql import BASE, runs

_LABELS = ("chain_id", "pos", "label")


def _both(spark, d):
    return residues(spark, d).select("chain_id", "pos", F.col("truth").alias("true"), "pred")


def _labels(spark, d, label="pred"):
    return residues(spark, d).select("chain_id", "pos", F.col(label).alias("label"), "ss", "res_num", "res_label")


_CELLS = BASE + """,
c0 as (select chain_id, pred, truth as tr, count(*) as n from res group by all),
cell as (select p.chain_id, p.pred, t.tr, coalesce(c0.n, 0) as n from (select distinct chain_id, pred from res) p join (select distinct chain_id, truth as tr from res) t on p.chain_id = t.chain_id
  left join c0 on c0.chain_id = p.chain_id and c0.pred = p.pred and c0.tr = t.tr)"""


@query("contingency", _CELLS + ' select chain_id, pred, tr as "true", n from cell')
def contingency(spark, d):
    return S.contingency(_both(spark, d), KEY)


_NDO = """,
yp as (select chain_id, sum(2*coalesce(m, 0) - s) as y from (select chain_id, pred, max(case when tr <> -1 then n end) as m, sum(n) as s from cell where pred <> -1 group by all) group by chain_id),
yt as (select chain_id, sum(2*coalesce(m, 0) - s) as y from (select chain_id, tr, max(case when pred <> -1 then n end) as m, sum(n) as s from cell where tr <> -1 group by all) group by chain_id),
sz as (select chain_id, count(*) filter (where truth <> -1) as n from res group by chain_id),
ndo as (select sz.chain_id, case when sz.n > 0 then (coalesce(yp.y, 0) + coalesce(yt.y, 0)) / (2.0*sz.n) end as v from sz left join yp using (chain_id) left join yt using (chain_id))"""


@query("ndo", _CELLS + _NDO + " select chain_id, round(cast(v as double), 9) as ndo from ndo")
def ndo(spark, d):
    return S.ndo(_both(spark, d), KEY).withColumn("ndo", F.round("ndo", 9))


_IOU = """,
sp as (select chain_id, pred, count(*) as s from res group by all),
sl as (select chain_id, truth as tr, count(*) as s from res group by all),
tl as (select chain_id, tr, s, row_number() over (partition by chain_id order by tr) as k from sl where tr <> -1),
ov as (select cell.chain_id, k, tl.s as ts, cell.pred, cell.n, sp.s as ps from cell join tl on tl.chain_id = cell.chain_id and tl.tr = cell.tr join sp on sp.chain_id = cell.chain_id and sp.pred = cell.pred where cell.pred <> -1 and cell.n > 0),
walk as (with recursive g(chain_id, k, used, total) as (
  select distinct chain_id, 0::bigint, []::int[], 0.0::double from res
  union all
  select g.chain_id, g.k + 1, case when b.pick is null then g.used else list_append(g.used, b.pick.p) end,
    g.total + case when b.pick is null then 0.0 else tl.s * b.pick.n / cast(tl.s + b.pick.ps - b.pick.n as double) end
  from g join tl on tl.chain_id = g.chain_id and tl.k = g.k + 1,
  lateral (select max(struct_pack(n := ov.n, m := -ov.pred, p := ov.pred, ps := ov.ps)) as pick from ov where ov.chain_id = g.chain_id and ov.k = g.k + 1 and not list_contains(g.used, ov.pred)) b)
  select chain_id, arg_max(total, k) as total from g group by chain_id),
iou as (select walk.chain_id, case when coalesce(z.s, 0) = 0 then 0.0 else total / z.s end as v from walk left join (select chain_id, sum(s) as s from tl group by chain_id) z using (chain_id))"""


@query("iou", _CELLS + _IOU + " select chain_id, round(cast(v as double), 9) as iou from iou")
def iou(spark, d):
    return S.iou(_both(spark, d), KEY).withColumn("iou", F.round("iou", 9))


@query("cdo", _CELLS + """ select chain_id, cast(min(case when m > 0.5 * s then 1 else 0 end) as int) as cdo from
(select chain_id, tr, coalesce(max(case when pred <> -1 then n end), 0) as m, sum(n) as s from cell where tr <> -1 group by all) group by chain_id""")
def cdo(spark, d):
    return S.cdo(_both(spark, d), KEY, threshold=0.5)


@query("sdc", BASE + """ select chain_id, (greatest(t, p) - abs(t - p)) / cast(greatest(t, p) as double) as sdc from
(select chain_id, count(distinct case when truth <> -1 then truth end) as t, count(distinct case when pred <> -1 then pred end) as p from res group by chain_id)""")
def sdc(spark, d):
    return S.sdc(_both(spark, d), KEY)


@query("norm_vi", _CELLS + """,
tot as (select chain_id, count(*) as n from res group by chain_id),
ht as (select r.chain_id, -sum(c/t.n*ln(c/t.n)) as h from (select chain_id, truth, count(*)::double as c from res group by all) r join tot t using (chain_id) group by r.chain_id),
hp as (select r.chain_id, -sum(c/t.n*ln(c/t.n)) as h from (select chain_id, pred, count(*)::double as c from res group by all) r join tot t using (chain_id) group by r.chain_id),
hj as (select r.chain_id, -sum(r.n::double/t.n*ln(r.n::double/t.n)) as h from c0 r join tot t using (chain_id) group by r.chain_id)
select tot.chain_id, round((2*hj.h - ht.h - hp.h)/ln(tot.n), 6) as norm_vi from tot join ht using (chain_id) join hp using (chain_id) join hj using (chain_id)""")
def norm_vi(spark, d):
    return S.norm_vi(_both(spark, d), KEY).withColumn("norm_vi", F.round("norm_vi", 6))


_SEGS = ",\n" + runs("pred", name="rp") + ",\n" + runs("truth", name="rt") + """,
lp as (select * from rp where label = -1), lt as (select * from rt where label = -1),
gp as (select s.*, coalesce(a."start", s."start") as es, coalesce(b."end", s."end") as ee from rp s left join lp a on a.chain_id = s.chain_id and a."end" = s."start" - 1 left join lp b on b.chain_id = s.chain_id and b."start" = s."end" + 1 where s.label <> -1),
gt as (select s.*, coalesce(a."start", s."start") as es, coalesce(b."end", s."end") as ee from rt s left join lt a on a.chain_id = s.chain_id and a."end" = s."start" - 1 left join lt b on b.chain_id = s.chain_id and b."start" = s."end" + 1 where s.label <> -1),
sd as (select gp.chain_id, gp.run as pr, gt.run as trn, least((abs(gp."start"-gt."start")+abs(gp."end"-gt."end"))/2, (abs(gp."start"-gt."start")+abs(gp.ee-gt.ee))/2, (abs(gp.es-gt."start")+abs(gp.ee-gt.ee))/2, (abs(gp."start"-gt.es)+abs(gp.ee-gt.ee))/2, (abs(gp.es-gt.es)+abs(gp.ee-gt.ee))/2) as d from gp join gt on gp.chain_id = gt.chain_id)"""
_CSD = """,
ca as (select chain_id, sum(m) as s, count(*) as n from (select chain_id, pr, max(greatest(20-d, 0)) as m from sd group by all) group by chain_id),
cb as (select chain_id, sum(m) as s, count(*) as n from (select chain_id, trn, max(greatest(20-d, 0)) as m from sd group by all) group by chain_id),
csd as (select ca.chain_id, case when ca.n >= cb.n then ca.s/(20*ca.n) else cb.s/(20*cb.n) end as v from ca join cb using (chain_id))"""


@query("segment_distance", BASE + _SEGS + " select chain_id, pr as pred_run, trn as true_run, d from sd")
def segment_distance(spark, d):
    return S.segment_distance(_both(spark, d), KEY)


@query("csd", BASE + _SEGS + _CSD + " select chain_id, round(cast(v as double), 9) as csd from csd")
def csd(spark, d):
    return S.csd(_both(spark, d), KEY).withColumn("csd", F.round("csd", 9))


_DBD = """,
ent as (select 'p' as side, chain_id, "start", "end" from (select *, max(run) over (partition by chain_id) as l from rp) where label = -1 and run > 0 and run < l
  union all select 't', chain_id, "start", "end" from (select *, max(run) over (partition by chain_id) as l from rt) where label = -1 and run > 0 and run < l
  union all select 'p', chain_id, "start", "start" from (select *, lag(label) over (partition by chain_id order by run) as pv from rp) where label <> -1 and pv <> -1
  union all select 't', chain_id, "start", "start" from (select *, lag(label) over (partition by chain_id order by run) as pv from rt) where label <> -1 and pv <> -1),
gap as (select p.chain_id, p."start" as ps, p."end" as pe, t."start" as ts, t."end" as te, greatest(0, t."start"-p."end", p."start"-t."end") as d from ent p join ent t on p.chain_id = t.chain_id and p.side = 'p' and t.side = 't'),
dbd as (select dd.chain_id, case when t = 1 and p = 1 then 1.0 when t = 1 or p = 1 then 0.0 when (t = 0) <> (p = 0) then 1.0 else s / (20.0 * greatest(np, nt)) end as v
  from (select chain_id, count(distinct case when truth <> -1 then truth end) as t, count(distinct case when pred <> -1 then pred end) as p from res group by chain_id) dd
  left join (select chain_id, sum(greatest(20-d, 0)) as s from gap group by chain_id) g using (chain_id)
  left join (select chain_id, count(*) filter (where side = 'p') as np, count(*) filter (where side = 't') as nt from ent group by chain_id) e using (chain_id))"""


@query("boundary_gap", BASE + _SEGS + _DBD + " select chain_id, ps as pred_start, pe as pred_end, ts as true_start, te as true_end, cast(d as int) as d from gap")
def boundary_gap(spark, d):
    return S.boundary_gap(_both(spark, d), KEY)


@query("dbd", BASE + _SEGS + _DBD + " select chain_id, round(cast(v as double), 9) as dbd from dbd")
def dbd(spark, d):
    return S.dbd(_both(spark, d), KEY).withColumn("dbd", F.round("dbd", 9))


REPORT = _CELLS + _NDO + _IOU + _SEGS + _CSD + _DBD


@query("score_report", REPORT + """ select csd.chain_id, round(cast(csd.v as double), 3) as csd, round(cast(iou.v as double), 3) as iou, round(cast(ndo.v as double), 3) as ndo, round(cast(dbd.v as double), 3) as dbd
from csd join iou using (chain_id) join ndo using (chain_id) join dbd using (chain_id)""")
def score_report(spark, d):
    return S.score_report(_both(spark, d), KEY)


@query("labels_to_clusters", BASE + " select chain_id, pred as label, string_agg(cast(pos as varchar), ',' order by pos) as members from res where pred <> -1 group by chain_id, pred")
def labels_to_clusters(spark, d):
    out = A.labels_to_clusters(_labels(spark, d), KEY)
    return out.withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


@query("clusters_by_residue", BASE + " select chain_id, pred as label, string_agg(cast(res_num as varchar), ',' order by res_num) as members from res group by chain_id, pred")
def clusters_by_residue(spark, d):
    out = A.labels_to_clusters(_labels(spark, d), KEY, keep_outliers=True, member="res_num")
    return out.withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


@query("clusters_to_labels", BASE + " select chain_id, pos, cast(case when pos % 11 = 4 then -1 else pred end as int) as label from res")
def clusters_to_labels(spark, d):
    rows = _labels(spark, d)
    return A.clusters_to_labels(rows, A.labels_to_clusters(rows, KEY), KEY, rows.where("pos % 11 = 4"))


@query("cluster_summary", BASE + """,
g as (select *, case when res_seq - lag(res_seq) over (partition by chain_id, pred order by pos) in (0, 1) then 0 else 1 end as brk from res),
g2 as (select *, sum(brk) over (partition by chain_id, pred order by pos) as run from g),
ri as (select chain_id, pred, run, arg_min(res_label, pos) as s, arg_max(res_label, pos) as e, count(*) as c from g2 group by all)
select chain_id, pred as label, cast(sum(c) as bigint) as residues, string_agg(case when s = e then s else s || '-' || e end, ', ' order by run) as ranges,
 any_value((select count(distinct case when r2.pred <> -1 then r2.pred end) from res r2 where r2.chain_id = ri.chain_id)) as n_clusters, any_value((select count(*) filter (where r2.pred = -1) from res r2 where r2.chain_id = ri.chain_id)) as n_outliers
from ri group by chain_id, pred""")
def cluster_summary(spark, d):
    return A.cluster_summary(_labels(spark, d), KEY)


# Clean-up


@query("curate_by_ss", BASE + ",\n" + runs("ss", name="sr") + """,
m as (select res.chain_id, res.pos, res.pred as label, sr.run from res join sr on sr.chain_id = res.chain_id and res.pos between sr."start" and sr."end" where sr.label in ('H', 'E') and sr.length >= 3),
v as (select chain_id, run, label, count(*) as n, min(pos) as f from m where label <> -1 group by all),
w as (select chain_id, run, max(struct_pack(n := n, f := -f, l := label)).l as l from v group by all)
select res.chain_id, res.pos, cast(coalesce(w.l, res.pred) as int) as label from res left join m using (chain_id, pos) left join w on w.chain_id = m.chain_id and w.run = m.run""")
def curate_by_ss(spark, d):
    return U.curate_by_ss(_labels(spark, d), KEY)


@query("merge_outlier_segments", BASE + ",\n" + runs("pred", name="o1") + """,
o2 as (select *, lag(label) over w as ll, lag(length) over w as ln, lead(label) over w as rl, lead(length) over w as rn from o1 window w as (partition by chain_id order by run)),
o3 as (select *, case when label = -1 and (length < 10 or length >= 100) then coalesce(case when ll is null then rl when rl is null then ll when ln >= rn then ll else rl end, label) else label end as new from o2)
select res.chain_id, res.pos, cast(o3.new as int) as label from res join o3 on o3.chain_id = res.chain_id and res.pos between o3."start" and o3."end\"""")
def merge_outlier_segments(spark, d):
    return U.merge_outlier_segments(_labels(spark, d), KEY)


@query("mark_outliers", _SIL + """,
mb as (select res.chain_id, res.pos, res.pred as label, coalesce(res.pred <> -1 and ss = 'C' and silhouette < 0.3, false) as bad from res left join sil using (chain_id, pos)),
""" + runs("label", "mb", "mr") + """,
m2 as (select *, coalesce(lag(label) over w <> -1, true) as fl, coalesce(lead(label) over w <> -1, true) as fr from mr window w as (partition by chain_id order by run)),
m3 as (select mb.chain_id, mb.pos, mb.label, m2.run, m2."start" as s, m2."end" as e, fl, fr,
  max(case when bad then 0 else 1 end) over (partition by mb.chain_id, m2.run order by mb.pos) as l, max(case when bad then 0 else 1 end) over (partition by mb.chain_id, m2.run order by mb.pos desc) as r
  from mb join m2 on m2.chain_id = mb.chain_id and mb.pos between m2."start" and m2."end"),
m4 as (select chain_id, pos, case when (fl and l = 0 and pos - s < 30) or (fr and r = 0 and e - pos < 30) then -1 else label end as label from m3),
""" + runs("label", "m4", "m5") + """,
m6 as (select *, case when label = -1 and length < 3 and lag(label) over w = lead(label) over w then lag(label) over w else label end as new from m5 window w as (partition by chain_id order by run))
select m4.chain_id, m4.pos, cast(m6.new as int) as label from m4 join m6 on m6.chain_id = m4.chain_id and m4.pos between m6."start" and m6."end\"""")
def mark_outliers(spark, d):
    rows = residues(spark, d)
    return U.mark_outliers(rows, rows.select("chain_id", "pos", F.col("pred").alias("label"), "ss"), KEY, tau=0.3)


_MERGE = """,
w as (with recursive g(chain_id, pos, label, p, going) as (
  select chain_id, pos, case when n < 30 then -1 else pred end, 0, n >= 30 from (select *, count(*) over (partition by chain_id) as n from res)
  union all
  select chain_id, unnest(places), case when not short then label when ll <> -1 and (rl is null or ln >= rn) then ll else coalesce(rl, -1) end, p + 1, bool_or(short) over (partition by chain_id)
  from (select *, label <> -1 and n < 30 as short, lag(label) over v as ll, lag(n) over v as ln, lead(label) over v as rl, lead(n) over v as rn
    from (select chain_id, run, min(label) as label, min(p) as p, count(*) as n, list(pos) as places
      from (select *, sum(brk) over (partition by chain_id order by pos) as run
        from (select *, case when label is distinct from lag(label) over (partition by chain_id order by pos) then 1 else 0 end as brk from g where going and p < 300))
      group by chain_id, run) window v as (partition by chain_id order by run)))
  select chain_id, pos, arg_max(label, p) as label from g group by chain_id, pos)
select chain_id, pos, cast(label as int) as label from w"""


@query("merge_small_clusters", BASE + _MERGE)
def merge_small_clusters(spark, d):
    return U.merge_small_clusters(_labels(spark, d).select(*_LABELS), KEY)


# What a run asks for, as (first place, last place, label); s, e, n are its own, a its left and b its right neighbour's.
_HALF = "{{'s': {s}, 'e': {s} + greatest({n} // 2, 1) - 1, 'l': {l}}}, {{'s': {s} + greatest({n} // 2, 1), 'e': {e}, 'l': {r}}}"
_OWN = {"s": "s", "e": "e", "n": "n"}
_ASKED = f"""case
 when i = 0 and i = top then []
 when label = -1 then (case when n = 1 then [{{'s': s, 'e': e, 'l': coalesce(al, closing)}}] else [] end) || (case
   when i = 0 then case when (n < 10 or n >= 100) and bn >= 30 then [{{'s': s, 'e': e, 'l': bl}}] else [] end
   when i = top then case when (n < 10 or n >= 100) and an >= 30 then [{{'s': s, 'e': e, 'l': al}}] else [] end
   when al = bl then [{{'s': s, 'e': e, 'l': al}}]
   when n < 10 then [{_HALF.format(**_OWN, l='al', r='bl')}] else [] end)
 when n >= 30 then []
 when i = 0 then case when bn > n then [{{'s': s, 'e': e, 'l': bl}}]
   when bl = -1 and b2 is not null and bn = 1 then [{{'s': bs, 'e': be, 'l': b2}}]
   when bl = -1 and b2 is not null then [{_HALF.format(s='bs', e='be', n='bn', l='label', r='b2')}] else [] end
 when i = top then case when an > n then [{{'s': s, 'e': e, 'l': al}}]
   when al = -1 and a2 is not null and an = 1 then [{{'s': ras, 'e': rae, 'l': label}}]
   when al = -1 and a2 is not null then [{_HALF.format(s='ras', e='rae', n='an', l='a2', r='label')}] else [] end
 when al = bl and (case when al = -1 then an >= 30 and bn >= 30 else an + bn > n end) then [{{'s': s, 'e': e, 'l': al}}]
 when al <> bl and al <> -1 and bl <> -1 and an > 30 and bn > 30 then [{_HALF.format(**_OWN, l='al', r='bl')}]
 when al <> bl and al = -1 and bn > 30 then [{{'s': s, 'e': e, 'l': bl}}]
 when al <> bl and bl = -1 and an > 30 then [{{'s': s, 'e': e, 'l': al}}]
 when an > n then [{{'s': s, 'e': e, 'l': case when an > bn then al else bl end}}]
 when bn > n then [{{'s': s, 'e': e, 'l': bl}}] else [] end"""


def post_processing(source: str) -> str:
    """CTE post (chain_id, pos, label): the clean-up of short runs of the table ``source``, whose places have no gaps."""
    return f"""
post as (with recursive g(chain_id, y, p, going) as (
  select chain_id, list(label order by pos), 0, count(*) > 1 from {source} group by chain_id
  union all
  select chain_id, list_transform(range(len(y)), lambda k: coalesce(list_filter(asked, lambda c: c.s <= k and k <= c.e)[-1].l, y[k + 1])), p + 1, len(asked) > 0
  from (select chain_id, any_value(y) as y, any_value(p) as p, flatten(list(list_filter(asked, lambda c: c.s <= c.e) order by i)) as asked
    from (select *, {_ASKED} as asked
      from (select *, max(i) over (partition by chain_id) as top, lag(label) over v as al, lag(n) over v as an, lag(s) over v as ras, lag(e) over v as rae, lag(label, 2) over v as a2,
          lead(label) over v as bl, lead(n) over v as bn, lead(s) over v as bs, lead(e) over v as be, lead(label, 2) over v as b2, y[-1] as closing
        from (select chain_id, i, any_value(y) as y, any_value(p) as p, min(label) as label, min(k) as s, max(k) as e, count(*) as n
          from (select *, sum(brk) over (partition by chain_id order by k) - 1 as i
            from (select *, case when label is distinct from lag(label) over (partition by chain_id order by k) then 1 else 0 end as brk
              from (select chain_id, y, p, unnest(y) as label, unnest(range(len(y))) as k from g where going and p < 31)))
          group by chain_id, i) window v as (partition by chain_id order by i)))
    group by chain_id))
  select chain_id, unnest(range(len(y))) as pos, unnest(y) as label from (select chain_id, arg_max(y, p) as y from g group by chain_id))"""


@query("post_process", BASE + ", given as (select chain_id, pos, pred as label from res)," + post_processing("given") + " select chain_id, cast(pos as int) as pos, cast(label as int) as label from post")
def post_process(spark, d):
    return U.post_process(_labels(spark, d).select(*_LABELS), KEY)
