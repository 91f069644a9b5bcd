"""SQL of the chains that the queries run on, for their DuckDB twins."""

BASE = """
with o as (select user_id as chain_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) as pos,
                  value, event_type, props from events),
b as (select *, cast(floor(pos/20) as int) as blk, pos % 20 as k from o),
r as (select chain_id, pos, cast(pos + 1 as int) as res_num,
  cast(30.0*(blk%3) + 3.8*(k%3) + 0.05*(value - floor(value)) as double) as x,
  cast(11.4*floor(blk/3) + 3.8*(cast(floor(k/3) as int)%3) as double) as y,
  cast(3.8*floor(k/9) as double) as z,
  case when event_type in ('error','click') then 'H' when event_type = 'view' then 'E' else 'C' end as ss,
  cast(blk%3 as int) as true_label, event_type, props,
  cast(case when pos % 20 in (18,19) then -1 else cast(floor((pos+3)/20) as int) % 3 end as int) as pred,
  cast(case when pos % 20 = 0 then -1 else blk%3 end as int) as truth,
  cast(floor(pos*4/5) as int) as res_seq,
  case when pos > 0 and floor(pos*4/5) = floor((pos-1)*4/5) then 'A' else '' end as icode,
  case event_type when 'click' then 'A' when 'view' then 'C' when 'purchase' then 'G' when 'error' then 'U' else 'GLY' end as res_name
  from b),
res as (select *, cast(res_seq as varchar) || icode as res_label from r)"""

# The same residues, numbered with two numbers left out before every 17th.
GAPS = BASE + """,
wide as (select * replace (cast(pos + skipped as int) as pos, cast(res_num + skipped as int) as res_num, cast(res_seq + skipped as int) as res_seq, cast(cast(res_seq + skipped as int) as varchar) || icode as res_label)
  from (select *, 2 * floor(pos / 17) as skipped from res))"""

EDGES = BASE + """,
e as (select * from (select a.chain_id, a.pos as i, c.pos as j, sqrt((a.x-c.x)*(a.x-c.x)+(a.y-c.y)*(a.y-c.y)+(a.z-c.z)*(a.z-c.z)) as d
      from res a join res c on a.chain_id = c.chain_id and a.pos < c.pos) where j = i + 1 or d < 7.5),
ew as (select chain_id, i, j, 1/(1+exp((d-8.0)/1.5)) as w from e),
n as (select chain_id, cast(count(*) as int) as n from res group by chain_id)"""

ATOMS = BASE + """,
atoms as (select chain_id, pos, cast(pos*3 + o + 1 as int) as serial, case o when 0 then case when res_name='GLY' then 'CA' else 'C3''' end
    when 1 then case when res_name='GLY' then 'N' else 'P' end else 'O' end as atom_name,
  case when o = 2 then 'HOH' else res_name end as res_name, cast(res_seq + case when o = 2 then 5000 else 0 end as int) as res_seq, icode,
  x + o*0.5 as x, y, z, case when o = 2 then 'W' else '' end as hetflag
  from res, (select unnest([0,1,2]) as o) where (o <> 0 or pos % 23 <> 7) and (o <> 2 or pos % 10 = 9))"""


def runs(label: str, source: str = "res", name: str = "runs", keys: str = "chain_id") -> str:
    """CTEs of the maximal runs of a label."""
    return f"""{name}_m as (select *, case when {label} is distinct from lag({label}) over (partition by {keys} order by pos) then 1 else 0 end as brk from {source}),
{name}_n as (select *, cast(sum(brk) over (partition by {keys} order by pos) - 1 as int) as run from {name}_m),
{name} as (select {keys}, run, min({label}) as label, cast(min(pos) as int) as "start", cast(max(pos) as int) as "end", cast(count(*) as int) as length from {name}_n group by {keys}, run)"""
