"""Queries of sources, residues, sinks and the whole pipeline, on atoms and files' lines made from the event chains."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..jobs.fixtures import KEY, atoms, residues
from ..jobs.pipeline import run_pipeline
from ..operators import lookups as L
from ..operators import residues as R
from ..registry import query
from ..session import checkpoint_dir
from ..sources import files, sinks
from ..sources import structures as T
from .core import _partitions
from .sql import ATOMS, BASE

_TYPES = ATOMS + """,
aa as (select distinct chain_id, res_seq, icode, res_name from atoms where hetflag <> 'W'),
ty as (select chain_id, case when count(*) filter (where res_name <> 'GLY') > count(*) filter (where res_name = 'GLY') then 'rna' else 'protein' end as chain_type,
  count(*) filter (where res_name = 'GLY') as n_amino, count(*) filter (where res_name <> 'GLY') as n_nucleotide from aa group by chain_id)"""
_POLY = _TYPES + """,
po as (select atoms.* from atoms join ty using (chain_id) where hetflag <> 'W' and (res_name = 'GLY') = (chain_type = 'protein'))"""
_RT = _POLY + """,
rt as (select chain_id, cast(row_number() over (partition by chain_id order by serial) - 1 as int) as pos, res_seq || icode as res_label, res_name, x, y, z
  from po where atom_name = case when res_name = 'GLY' then 'CA' else 'C3''' end)"""


def _folder(spark, name):
    """A new folder in the shared one, for files that a query writes and reads back."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _atoms(spark, d):
    return atoms(residues(spark, d))


@query("detect_chain_types", _TYPES + " select * from ty")
def detect_chain_types(spark, d):
    return R.detect_chain_types(_atoms(spark, d), KEY)


@query("polymer_residues", _POLY + " select chain_id, serial, atom_name, res_name from po")
def polymer_residues(spark, d):
    a = _atoms(spark, d)
    return R.polymer_residues(a, R.detect_chain_types(a, KEY), KEY).select("chain_id", "serial", "atom_name", "res_name")


def _table(spark, d):
    a = _atoms(spark, d)
    return R.residue_table(R.polymer_residues(a, R.detect_chain_types(a, KEY), KEY), KEY)


@query("residue_table", _RT + " select chain_id, pos, cast(pos + 1 as int) as res_num, res_label, res_name, round(x, 6) as x, round(y, 6) as y, round(z, 6) as z from rt")
def residue_table(spark, d):
    return _table(spark, d).select("chain_id", "pos", "res_num", "res_label", "res_name", *(F.round(c, 6).alias(c) for c in "xyz"))


@query("min_length_filter", BASE + " select chain_id, pos, count(*) over (partition by chain_id) as n_res from res qualify count(*) over (partition by chain_id) >= 65")
def min_length_filter(spark, d):
    return R.min_length_filter(residues(spark, d), KEY, 65).select("chain_id", "pos", "n_res")


@query("select_longest_chains", BASE + """,
sz as (select chain_id, count(*) as n, chain_id % 10 as g from res group by chain_id)
select res.chain_id, res.pos from res join (select chain_id from sz qualify rank() over (partition by g order by n desc) = 1) using (chain_id)""")
def select_longest_chains(spark, d):
    rows = residues(spark, d).withColumn("g", F.col("chain_id") % 10)
    return R.select_chains(rows, "longest", ["g", "chain_id"], ["g"]).select("chain_id", "pos")


@query("missing_residues", BASE + """,
seen as (select distinct chain_id, res_seq, pos % 2 as model_id from res where pos % 7 <> 5 and res_name <> ''),
bb as (select chain_id, model_id, min(res_seq) as lo, max(res_seq) as hi from seen group by all),
gp as (select distinct bb.chain_id, cast(x.s as varchar) as res_label, 1 as part, x.s as o from bb, unnest(generate_series(bb.lo, bb.hi)) as x(s) where not exists (select 1 from seen s2 where s2.chain_id = bb.chain_id and s2.model_id = bb.model_id and s2.res_seq = x.s)),
an as (select chain_id, cast(res_seq as varchar) as res_label, 0 as part, -pos as o from res where pos % 17 = 5),
al as (select chain_id, res_label, min(struct_pack(p := part, o := o)) as m from (select * from gp union all select * from an) group by all)
select chain_id, res_label, cast(row_number() over (partition by chain_id order by m, res_label) - 1 as int) as ord from al""")
def missing_residues(spark, d):
    """Chains with holes: two of fourteen residues are seen in neither model, every 17th is annotated as missing."""
    rows = residues(spark, d)
    seen = rows.where("pos % 7 <> 5").select("chain_id", "res_seq", "res_name", F.lit("").alias("hetflag"), (F.col("pos") % 2).alias("model_id"))
    listed = rows.where("pos % 17 = 5").select("chain_id", F.col("res_seq").cast("string").alias("res_label"), (-F.col("pos")).alias("ord"))
    return L.missing_residues(listed, seen, ["chain_id"], ["model_id"])


# Lines of structure files


def _atom_lines(spark, d):
    a = _atoms(spark, d)
    line = F.concat(
        F.rpad(F.when(F.col("hetflag") == "W", "HETATM").otherwise("ATOM"), 6, " "), F.lpad(F.col("serial").cast("string"), 5, " "), F.lit(" "), F.rpad("atom_name", 4, " "), F.lit(" "), F.lpad("res_name", 3, " "), F.lit(" A"),
        F.lpad(F.col("res_seq").cast("string"), 4, " "), F.rpad("icode", 1, " "), F.lit("   "), *(F.lpad(F.format_string("%.4f", F.col(c)), 8, " ") for c in "xyz"), F.lit("  1.00  0.00          "), F.lpad(F.substring("atom_name", 1, 1), 2, " "), F.lit("  "),
    )
    return a.select(F.col("chain_id").cast("string").alias("structure_id"), F.col("serial").alias("line_no"), line.alias("value"))


@query("read_pdb", ATOMS + """ select cast(chain_id as varchar) as structure_id, 1 as model_id, serial, atom_name, res_name, 'A' as chain_id, res_seq, icode,
 round(cast(printf('%.4f', x) as double), 4) as x, round(cast(printf('%.4f', y) as double), 4) as y, round(cast(printf('%.4f', z) as double), 4) as z, hetflag from atoms""")
def read_pdb(spark, d):
    lines, path = _atom_lines(spark, d), _folder(spark, "pdb")
    ordered = lines.repartition("structure_id").sortWithinPartitions("structure_id", "line_no")
    ordered.select("structure_id", "value").write.partitionBy("structure_id").text(path)
    return files.read_structures(spark, path, "pdb").select("structure_id", "model_id", "serial", "atom_name", "res_name", "chain_id", "res_seq", "icode", "x", "y", "z", "hetflag")


@query("read_mmcif", ATOMS + """ select cast(chain_id as varchar) as structure_id, serial, atom_name, res_name, 'A' as chain_id, res_seq, icode,
 round(cast(printf('%.4f', x) as double), 4) as x, hetflag from atoms""")
def read_mmcif(spark, d):
    a = _atoms(spark, d)
    quoted = F.concat(F.lit('"'), "atom_name", F.lit('"'))
    row = F.concat_ws(" ", F.when(F.col("hetflag") == "W", "HETATM").otherwise("ATOM"), F.col("serial").cast("string"), quoted, "res_name", F.lit("A"), F.col("res_seq").cast("string"), F.when(F.col("icode") == "", "?").otherwise(F.col("icode")), *(F.format_string("%.4f", F.col(c)) for c in "xyz"))
    names = "group_PDB id auth_atom_id auth_comp_id auth_asym_id auth_seq_id pdbx_PDB_ins_code Cartn_x Cartn_y Cartn_z".split()
    head = "data_x\n#\nloop_\n" + "".join(f"_atom_site.{n}\n" for n in names)
    texts = a.groupBy(F.col("chain_id").cast("string").alias("structure_id")).agg(F.concat(F.lit(head), F.array_join(F.sort_array(F.collect_list(F.struct("serial", row.alias("t"))))["t"], "\n"), F.lit("\n#\n")).alias("value"))
    path = _folder(spark, "mmcif")
    texts.repartition("structure_id").write.partitionBy("structure_id").text(path)
    return files.read_structures(spark, path, "mmcif").select("structure_id", "serial", "atom_name", "res_name", "chain_id", "res_seq", "icode", "x", "hetflag")


@query("read_unobserved_residues", BASE + """ select cast(chain_id as varchar) as structure_id, 'A' as chain_id, res_name, res_label, cast(row_number() over (partition by chain_id order by pos) - 1 as int) as ord from res where pos % 17 = 5""")
def read_unobserved_residues(spark, d):
    """A file lists what was not observed: every 17th residue of each chain stands for it."""
    rows = residues(spark, d).where("pos % 17 = 5")
    row = F.concat_ws(" ", F.lit("A"), "res_name", F.col("res_seq").cast("string"), F.when(F.col("icode") == "", "?").otherwise(F.col("icode")))
    head = "data_x\nloop_\n" + "".join(f"_pdbx_unobs_or_zero_occ_residues.{n}\n" for n in ("auth_asym_id", "auth_comp_id", "auth_seq_id", "PDB_ins_code"))
    texts = rows.groupBy(F.col("chain_id").cast("string").alias("structure_id")).agg(F.concat(F.lit(head), F.array_join(F.sort_array(F.collect_list(F.struct("pos", row.alias("t"))))["t"], "\n"), F.lit("\n#\n")).alias("value"))
    return T.unobserved_from_mmcif(texts)


@query("read_missing_annotations", BASE + """ select cast(chain_id as varchar) as structure_id, 'A' as chain_id, res_name, res_label, cast(row_number() over (partition by chain_id order by pos) - 1 as int) as ord from res where pos % 17 = 5""")
def read_missing_annotations(spark, d):
    """The remarks list missing residues: every 17th residue of each chain stands for them."""
    rows = residues(spark, d).where("pos % 17 = 5")
    line = F.concat(F.lit("REMARK 465     "), F.lpad("res_name", 3, " "), F.lit(" A "), F.lpad(F.concat(F.col("res_seq").cast("string"), F.when(F.col("icode") == "", " ").otherwise(F.col("icode"))), 6, " "))
    lines = rows.select(F.col("chain_id").cast("string").alias("structure_id"), (F.col("pos") + 1).alias("line_no"), line.alias("value"))
    chains = rows.select(F.col("chain_id").cast("string").alias("structure_id")).distinct()
    head = chains.select("structure_id", F.lit(0).alias("line_no"), F.lit("REMARK 465   M RES C SSSEQI").alias("value"))
    tail = chains.select("structure_id", F.explode(F.array(F.struct(F.lit(9000).alias("line_no"), F.lit("DBREF").alias("value")), F.struct(F.lit(9001).alias("line_no"), F.lit("REMARK 465       G A    77 ").alias("value")))).alias("s")).select("structure_id", "s.*")
    return T.missing_from_lines(head.unionByName(lines).unionByName(tail))


@query("read_ss_assignments", BASE + """ select cast(chain_id as varchar) as structure_id, 'A' as chain_id, res_name, cast(res_seq as varchar) as res_label,
 case substr('HGIEBTC', cast(pos % 7 + 1 as int), 1) when 'H' then 'H' when 'G' then 'H' when 'I' then 'H' when 'E' then 'E' when 'B' then 'E' else 'C' end as ss, pos as ord from res""")
def read_ss_assignments(spark, d):
    rows = residues(spark, d)
    code = F.substring(F.lit("HGIEBTC"), F.col("pos") % 7 + 1, F.lit(1))
    line = F.concat(F.lit("ASG  "), F.lpad("res_name", 3, " "), F.lit(" A"), F.lpad(F.col("res_seq").cast("string"), 5, " "), F.lpad((F.col("pos") + 1).cast("string"), 5, " "), F.lit("    "), code)
    return T.ss_from_lines(rows.select(F.col("chain_id").cast("string").alias("structure_id"), F.col("pos").alias("line_no"), line.alias("value")))


@query("read_base_pairs", BASE + """,
n as (select chain_id, count(*) as n from res group by chain_id),
pr as (select res.chain_id, pos, cast(regexp_extract(props, '"k": *([0-9]+)', 1) as bigint) % n.n as other from res join n using (chain_id) where regexp_extract(props, '"k": *([0-9]+)', 1) <> ''),
pd as (select chain_id, pos from pr union select chain_id, other from pr)
select cast(res.chain_id as varchar) as structure_id, 'A' as chain_id, cast(res.pos as varchar) as res_label, case when pd.pos is null then 'C' else 'H' end as ss from res left join pd on pd.chain_id = res.chain_id and pd.pos = res.pos""")
def read_base_pairs(spark, d):
    rows = residues(spark, d).withColumn("n", F.count("*").over(Window.partitionBy("chain_id")))
    other = F.regexp_extract("props", '"k": *([0-9]+)', 1).try_cast("bigint") % F.col("n")
    pairs = rows.withColumn("other", other).where("other is not null")
    name = lambda p: F.concat(F.lit("A."), F.lit("G"), p.cast("string"))
    items = F.sort_array(F.collect_list(F.struct("pos", F.to_json(F.struct(name(F.col("pos")).alias("nt1"), name(F.col("other")).alias("nt2"))).alias("t"))))["t"]
    texts = pairs.groupBy(F.col("chain_id").cast("string").alias("structure_id")).agg(F.concat(F.lit('{"pairs":['), F.array_join(items, ","), F.lit("]}")).alias("value"))
    chains = rows.select(F.col("chain_id").cast("string").alias("structure_id"), F.lit("A").alias("chain_id"), F.col("pos").cast("string").alias("res_label"))
    return T.paired_flags(chains, texts).select("structure_id", "chain_id", "res_label", "ss")


# Sinks

_COLOURS = "['" + "','".join(sinks.COLOURS) + "']"
_COMMAND = f"""'select ' || nm || ', res ' || ranges || '; color ' || case when label = -1 then 'grey' when k <= 15 then {_COLOURS}[k] else lpad(cast(k as varchar), 2, '0') end || ', ' || nm as command"""


@query("selection_commands", BASE + f""",
g as (select *, case when res_seq - lag(res_seq) over (partition by chain_id, pred order by pos) in (0, 1) then 0 else 1 end as brk from res),
g2 as (select *, sum(brk) over (partition by chain_id, pred order by pos) as run from g),
ri as (select chain_id, pred as label, run, arg_min(res_label, pos) as s, arg_max(res_label, pos) as e from g2 group by all),
t as (select chain_id, label, string_agg(case when s = e then s else s || '-' || e end, '+' order by run) as ranges, cast(dense_rank() over (partition by chain_id order by label) as int) as k from ri group by chain_id, label),
u as (select *, chain_id || case when label = -1 then '_outlier' else '_cluster_' || k end as nm from t)
select chain_id, label, {_COMMAND} from u""")
def selection_commands(spark, d):
    return sinks.selection_commands(residues(spark, d).withColumn("label", F.col("pred")), KEY)


@query("selection_command_plain", BASE + f""",
g2 as (select *, res_num - row_number() over (partition by chain_id, pred order by res_num) as run from res),
ri as (select chain_id, pred as label, run, min(res_num) as s, max(res_num) as e from g2 group by all),
t as (select chain_id, label, string_agg(case when s = e then cast(s as varchar) else s || '-' || e end, '+' order by s) as ranges, cast(dense_rank() over (partition by chain_id order by label) as int) as k from ri group by chain_id, label),
u as (select *, chain_id || case when label = -1 then '_outlier' else '_cluster_' || k end as nm from t)
select chain_id, label, {_COMMAND} from u""")
def selection_command_plain(spark, d):
    return sinks.selection_command_plain(residues(spark, d).withColumn("label", F.col("pred")), KEY)


@query("split_structure_by_cluster", ATOMS + """,
fl as (select chain_id, res_label, min(pred) as label from res where pred <> -1 group by all)
select atoms.chain_id, serial, atom_name, fl.label, res_seq, icode, cast(printf('%.3f', x + 0.00025) as double) as x, cast(printf('%.3f', y) as double) as y, cast(printf('%.3f', z) as double) as z, hetflag from atoms join fl on fl.chain_id = atoms.chain_id and fl.res_label = atoms.res_seq || atoms.icode""")
def split_structure_by_cluster(spark, d):
    rows = residues(spark, d)
    named = atoms(rows).withColumn("res_label", F.concat(F.col("res_seq").cast("string"), "icode"))
    # No coordinate lies half way between two that a file can hold.
    named = named.withColumn("x", F.col("x") + 0.00025)
    split = sinks.split_structure_by_cluster(named, rows.withColumn("label", F.col("pred")), KEY)
    path = _folder(spark, "split")
    sinks.write_split_structures(split, path, KEY)
    types = f"chain_id {dict(split.dtypes)['chain_id']}"
    return sinks.read_split_structures(spark, path, KEY, types).select("chain_id", "serial", "atom_name", "label", "res_seq", "icode", *"xyz", "hetflag")


@query("write_results_json", BASE + """ select chain_id, string_agg(cast(pred as varchar), ',' order by pos) as cluster, string_agg(cast(res_num as varchar), ',' order by pos) as res, string_agg(res_label, ',' order by pos) as res_labels,
 string_agg(res_label, ',' order by pos) filter (where pos % 17 = 5) as missing_res from res group by chain_id""")
def write_results_json(spark, d):
    rows = residues(spark, d)
    missing = rows.where("pos % 17 = 5").select("chain_id", "res_label", F.col("pos").alias("ord"))
    out = sinks.result_frame(rows, rows.withColumn("label", F.col("pred")).select("chain_id", "pos", "label"), KEY, missing=missing, chain=KEY)
    path = _folder(spark, "results")
    sinks.write_results_json(out, path)
    read = spark.read.schema(out.schema).json(path)
    return read.select("chain_id", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("cluster", "res", "res_labels", "missing_res")))


@query("run_pipeline")
def pipeline(spark, d):
    out = run_pipeline(_atoms(spark, d).withColumn("altloc", F.lit("")))
    return out["summary"].select("chain_id", "label", "residues", "ranges", "n_clusters", "n_outliers")


@query("run_pipeline_results")
def pipeline_results(spark, d):
    """The nested results of all frames: labels, commands, missing residues, and scores against the true partition."""
    partitions = _partitions(residues(spark, d)).select(F.lit("s").alias("structure_id"), F.lit(1).alias("model_id"), "chain_id", "partition")
    out = run_pipeline(_atoms(spark, d).withColumn("altloc", F.lit("")), partitions=partitions)
    texts = (F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("cluster", "res_labels", "missing_res", "commands"))
    return out["results"].select("chain_id", *texts, "Score.*")
