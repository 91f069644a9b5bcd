"""Queries of the contact graph, cuts, splitting and merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..jobs import domains as D
from ..jobs.fixtures import KEY, long_residues, residues, with_gaps
from ..operators import cleanup as U
from ..operators import cuts as X
from ..operators import graph as G
from ..registry import query
from ..schemas import shuffled
from .sql import BASE, EDGES, GAPS

_LABELS = ("chain_id", "pos", "label")


def _rows(spark, d, label="true_label"):
    return residues(spark, d).withColumn("label", F.col(label))


def _edges(spark, d):
    return G.contact_edges(residues(spark, d), 7.5, KEY)


def _sizes(rows):
    return rows.groupBy("chain_id").agg(F.count("*").cast("int").alias("n"), F.lit("protein").alias("chain_type"))


@query("contact_edges", EDGES + " select chain_id, i, j, round(w, 9) as weight from ew")
def contact_edges(spark, d):
    return _edges(spark, d).withColumn("weight", F.round("weight", 9))


@query("node_degree", EDGES + """,
en as (select chain_id, i as pos, w from ew union all select chain_id, j, w from ew)
select chain_id, pos, count(*) as degree, round(sum(w), 6) as weighted_degree from en group by chain_id, pos""")
def node_degree(spark, d):
    return G.node_degree(_edges(spark, d), KEY).withColumn("weighted_degree", F.round("weighted_degree", 6))


@query("bipartition_modularity", EDGES + """,
l as (select e.chain_id, w, a.true_label = 0 as x, b.true_label = 0 as y from ew e join res a on a.chain_id = e.chain_id and a.pos = e.i join res b on b.chain_id = e.chain_id and b.pos = e.j),
s as (select chain_id, sum(w) as m, sum(case when x and y then w else 0 end) as l0, sum(case when not x and not y then w else 0 end) as l1,
  sum(w * (case when x then 1 else 0 end + case when y then 1 else 0 end)) as d0, sum(w * (case when x then 0 else 1 end + case when y then 0 else 1 end)) as d1 from l group by chain_id)
select chain_id, round(l0/m - (d0/(2*m))*(d0/(2*m)) + l1/m - (d1/(2*m))*(d1/(2*m)), 6) as q from s""")
def bipartition_modularity(spark, d):
    rows = residues(spark, d)
    sides = rows.select("chain_id", "pos", (F.col("true_label") == 0).cast("int").alias("label"))
    return G.bipartition_modularity(_edges(spark, d), sides, KEY).withColumn("q", F.round("q", 6))


_RATIO = EDGES + """,
l as (select e.chain_id, e.i, e.j, a.true_label as li, b.true_label as lj from ew e join res a on a.chain_id = e.chain_id and a.pos = e.i join res b on b.chain_id = e.chain_id and b.pos = e.j where a.true_label <> b.true_label),
oo as (select chain_id, i as pos, li as own, lj as other from l union select chain_id, j, lj, li from l),
c as (select chain_id, own, other, count(*) as k from oo group by all),
z as (select chain_id, true_label as own, count(*) as size from res group by all),
sh as (select chain_id, own, other, k/size as share from c join z using (chain_id, own))
select a.chain_id, a.own as label_a, a.other as label_b, round(greatest(a.share, b.share), 9) as r_max, round((a.share + b.share)/2, 9) as r_avg, round(least(a.share, b.share), 9) as r_min
from sh a join sh b on a.chain_id = b.chain_id and a.own = b.other and a.other = b.own where a.own < a.other"""


@query("contact_ratio", _RATIO)
def contact_ratio(spark, d):
    edges, labels = _edges(spark, d), _rows(spark, d).select(*_LABELS)
    out = None
    for mode in ("max", "avg", "min"):
        one = G.contact_ratio(edges, labels, KEY, mode).select("chain_id", "label_a", "label_b", F.round("ratio", 9).alias(f"r_{mode}"))
        out = one if out is None else out.join(shuffled(one), ["chain_id", "label_a", "label_b"])
    return out


@query("boundary_nodes", EDGES + """,
l as (select e.chain_id, e.i, e.j, a.true_label as li, b.true_label as lj from ew e join res a on a.chain_id = e.chain_id and a.pos = e.i join res b on b.chain_id = e.chain_id and b.pos = e.j where a.true_label <> b.true_label),
oo as (select chain_id, li as label, i as pos from l union select chain_id, li, j from l union select chain_id, lj, i from l union select chain_id, lj, j from l)
select chain_id, label, count(*) as boundary_nodes from oo group by chain_id, label""")
def boundary_nodes(spark, d):
    return G.boundary_nodes(_edges(spark, d), _rows(spark, d).select(*_LABELS), KEY)


_DIST = "sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))"


@query("inter_domain_density", BASE + f""",
p as (select a.chain_id, a.true_label as label_a, b.true_label as label_b, sum(1/(1+exp(({_DIST}-8.0)/1.5))) as t from res a join res b on a.chain_id = b.chain_id and a.true_label < b.true_label group by all),
z as (select chain_id, true_label as l, count(*) as n from res group by all)
select p.chain_id, label_a, label_b, round(t * pow(za.n * zb.n, -0.43), 6) as density from p join z za on za.chain_id = p.chain_id and za.l = label_a join z zb on zb.chain_id = p.chain_id and zb.l = label_b""")
def inter_domain_density(spark, d):
    rows = _rows(spark, d)
    return G.inter_domain_density(rows.select("chain_id", "pos", "x", "y", "z"), rows.select(*_LABELS), KEY).withColumn("density", F.round("density", 6))


@query("intra_domain_density", BASE + f""",
q as (select *, row_number() over (partition by chain_id, true_label order by pos) as place from res),
p as (select a.chain_id, a.true_label as label, sum(1/(1+exp(({_DIST}-8.0)/1.5))) as t from q a join q b on a.chain_id = b.chain_id and a.true_label = b.true_label and b.place - a.place > 2 group by all),
z as (select chain_id, true_label as label, count(*) as n from res group by all)
select z.chain_id, z.label, round(coalesce(t, 0) * pow(n, -0.95), 6) as density from z left join p using (chain_id, label)""")
def intra_domain_density(spark, d):
    rows = _rows(spark, d)
    return G.intra_domain_density(rows.select("chain_id", "pos", "x", "y", "z"), rows.select(*_LABELS), KEY).withColumn("density", F.round("density", 6))


_CUTS = BASE + """,
cl as (select chain_id, pos, ss, ss = 'C' as coil, lag(ss) over (partition by chain_id order by pos) as prev from res),
st as (select *, max(case when coil and (prev is null or prev <> 'C') then greatest(pos, 1) end) over (partition by chain_id order by pos) as s from cl),
cuts as (select chain_id, pos as k from st where pos >= 1 and (ss <> prev or (coil and pos >= s and (pos - s) % 6 = 0)))"""


@query("cut_candidates", _CUTS + " select chain_id, k from cuts")
def cut_candidates(spark, d):
    return X.cut_candidates(residues(spark, d), KEY)


@query("cut_candidates_with_gaps", GAPS + """,
cl as (select chain_id, pos, ss, res_seq, lag(ss) over w as prev, lag(res_seq) over w as pn from wide window w as (partition by chain_id order by pos))
select chain_id, pos as k from cl where pos >= 1 and (ss <> prev or res_seq <> pn + 1)""")
def cut_candidates_with_gaps(spark, d):
    return X.cut_candidates(with_gaps(residues(spark, d)), KEY, boundary_only=True, gap_label="res_seq")


_SCAN = """,
m as (select chain_id, sum(w) as m from ew group by chain_id),
t as (select n.chain_id, n.n, cast(x.k as int) as k from n, unnest(generate_series(9, n.n - 11)) as x(k)),
q as (select t.chain_id, t.k, any_value(m.m) as m, sum(case when e.i > t.k then e.w else 0 end) as inside, sum(case when e.i > t.k then 2*e.w when e.j > t.k then e.w else 0 end) as deg
  from t join m using (chain_id) join ew e on e.chain_id = t.chain_id {more} group by t.chain_id, t.k),
s as (select chain_id, k, round((m - deg + 2*inside)/m - (((2*m-deg)/(2*m))*((2*m-deg)/(2*m)) + (deg/(2*m))*(deg/(2*m))), 9) as q from q)
select chain_id, cast(arg_max(k, struct_pack(a := q, b := -k)) as int) as k, max(q) as q from s group by chain_id"""


@query("best_continuous_cut", EDGES + _SCAN.format(more=""))
def best_continuous_cut(spark, d):
    return X.best_continuous_cut(_edges(spark, d), _sizes(residues(spark, d)), KEY)


@query("best_continuous_cut_ss", EDGES + _CUTS[len(BASE) :] + _SCAN.format(more="where exists (select 1 from cuts c where c.chain_id = t.chain_id and c.k = t.k + 1)"))
def best_continuous_cut_ss(spark, d):
    rows = residues(spark, d)
    return X.best_continuous_cut(_edges(spark, d), _sizes(rows), KEY, cuts=X.cut_candidates(rows, KEY))


@query("best_discontinuous_cut", EDGES + """,
m as (select chain_id, sum(w) as m from ew group by chain_id),
c as (select chain_id, n.n, i as t, j as v from ew join n using (chain_id) where i >= 9 and i <= n.n - 11 and j + 1 > i + 30 and j + 1 <= n.n - 10 and j - i >= 10 and n.n - (j - i) >= 10),
q as (select c.chain_id, c.t, c.v, any_value(m.m) as m, sum(case when e.i > c.t and e.j <= c.v then e.w else 0 end) as inside,
  sum((case when e.i > c.t and e.i <= c.v then e.w else 0 end) + (case when e.j > c.t and e.j <= c.v then e.w else 0 end)) as deg from c join m using (chain_id) join ew e on e.chain_id = c.chain_id group by c.chain_id, c.t, c.v),
s as (select chain_id, t, v, round((m - deg + 2*inside)/m - (((2*m-deg)/(2*m))*((2*m-deg)/(2*m)) + (deg/(2*m))*(deg/(2*m))), 9) as q from q)
select chain_id, cast(-max(struct_pack(q := q, a := -t, b := -v)).a as int) as t, cast(-max(struct_pack(q := q, a := -t, b := -v)).b as int) as v, max(q) as q from s group by chain_id""")
def best_discontinuous_cut(spark, d):
    return X.best_discontinuous_cut(_edges(spark, d), _sizes(residues(spark, d)), KEY)


_SIL = BASE + f""",
z as (select * from (select *, count(*) over (partition by chain_id) as kk from (select chain_id, pred as label, count(*) as size from res where pred <> -1 group by all having count(*) >= 5)) where kk >= 2),
v as (select res.*, z.size from res join z on z.chain_id = res.chain_id and z.label = res.pred),
p as (select a.chain_id, a.pos, a.pred as own, a.size, b.pred as other, sum({_DIST}) as t, count(*) as n from v a join v b on a.chain_id = b.chain_id and a.pos <> b.pos group by all),
s as (select chain_id, pos, size, max(case when own = other then t/n end) as a, min(case when own <> other then t/n end) as b from p group by all),
sil as (select chain_id, pos, case when size = 1 then 0.0 else (b-a)/greatest(a,b) end as silhouette from s)"""


@query("silhouette_points", _SIL + " select res.chain_id, res.pos, res.pred as label, round(silhouette, 6) as silhouette from res left join sil using (chain_id, pos)")
def silhouette_points(spark, d):
    rows = _rows(spark, d, "pred")
    return U.silhouette_points(rows, rows.select(*_LABELS), KEY).withColumn("silhouette", F.round("silhouette", 6))


@query("choose_k", BASE + f""",
cand as (select chain_id, pos, x, y, z, cast(k as int) as k, cast(floor(pos*k/(max(pos) over (partition by chain_id) + 1)) as int) as label from res, (select unnest([2,3,4]) as k)),
zz as (select chain_id, k, label, count(*) as size from cand group by all),
v as (select cand.*, size from cand join zz using (chain_id, k, label)),
p as (select a.chain_id, a.k, a.pos, a.label as own, a.size, b.label as other, sum({_DIST}) as t, count(*) as n from v a join v b on a.chain_id = b.chain_id and a.k = b.k and a.pos <> b.pos group by all),
s as (select chain_id, k, pos, size, max(case when own = other then t/n end) as a, min(case when own <> other then t/n end) as b from p group by all),
q as (select chain_id, k, round(avg(case when size = 1 then 0.0 else (b-a)/greatest(a,b) end), 9) as score from s group by all)
select chain_id, cast(arg_max(k, struct_pack(s := score, m := -k)) as int) as k, max(score) as score, false as fallback from q group by chain_id""")
def choose_k(spark, d):
    rows = residues(spark, d)
    n = rows.groupBy("chain_id").agg((F.max("pos") + 1).alias("n"))
    tried = rows.join(n, "chain_id").select("chain_id", "pos", "n", F.explode(F.array(*(F.lit(k) for k in (2, 3, 4)))).alias("k"))
    return U.choose_k(rows, tried.select("chain_id", "k", "pos", F.floor(F.col("pos") * F.col("k") / F.col("n")).cast("int").alias("label")), KEY)


@query("terminal_low_degree", EDGES + """,
dg as (select chain_id, pos, count(*) as degree from (select chain_id, i as pos from ew union all select chain_id, j from ew) group by all),
q as (select res.chain_id, res.pos, res.true_label as label, coalesce(degree, 0) <= 6 as low from res left join dg using (chain_id, pos)),
r1 as (select *, pos - row_number() over (partition by chain_id, label order by pos) as isl from q),
r2 as (select *, max(case when low then 0 else 1 end) over (partition by chain_id, label, isl order by pos) as f, max(case when low then 0 else 1 end) over (partition by chain_id, label, isl order by pos desc) as g from r1),
r3 as (select *, pos - row_number() over (partition by chain_id, label order by pos) as isl2 from r2 where f = 0 or g = 0),
r4 as (select *, count(*) over (partition by chain_id, label, isl2) as n2 from r3)
select chain_id, label, pos from r4 where n2 >= 3""")
def terminal_low_degree(spark, d):
    return U.terminal_low_degree(_edges(spark, d), _rows(spark, d).select(*_LABELS), KEY, threshold=6, min_run=3)


@query("top_down")
def top_down(spark, d):
    rows = residues(spark, d)
    return D.cluster_chains(_edges(spark, d), _sizes(rows), KEY, merge=None)


@query("top_down_ss")
def top_down_ss(spark, d):
    rows = residues(spark, d)
    return D.cluster_chains(_edges(spark, d), _sizes(rows), KEY, X.cut_candidates(rows, KEY), merge=None)


@query("bottom_up")
def bottom_up(spark, d):
    rows = residues(spark, d)
    return D.cluster_chains(_edges(spark, d), _sizes(rows), KEY, split=0.3)


@query("bottom_up_size_first")
def bottom_up_size_first(spark, d):
    rows = residues(spark, d)
    return D.cluster_chains(_edges(spark, d), _sizes(rows), KEY, split=0.3, mode="min", size_first=True, wanted=2)


@query("detect_domains")
def detect_domains(spark, d):
    return D.detect_domains(residues(spark, d).withColumn("chain_type", F.lit("protein")), KEY)


@query("detect_domains_ss")
def detect_domains_ss(spark, d):
    return D.detect_domains(residues(spark, d).withColumn("chain_type", F.lit("protein")), KEY, ss=True)


@query("detect_domains_long")
def detect_domains_long(spark, d):
    return D.detect_domains(long_residues(spark, d).withColumn("chain_type", F.lit("protein")), KEY)


@query("split_pvalue")
def split_pvalue(spark, d):
    return D.split_pvalue(_edges(spark, d), _sizes(residues(spark, d)), KEY)
