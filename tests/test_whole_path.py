"""From files to results: every frame of ``run_pipeline`` against plain Python, with several models, both kinds of chain,
alternate locations, waters, insertions and gaps."""

import math
import random

import pytest
from pyspark.sql import functions as F

from foldspark import registry
from foldspark.jobs.pipeline import run_pipeline
from foldspark.operators import scores
from foldspark.sources import files

from .oracle import duck_rows
from .test_chain_queries import plain_merge, plain_pieces
from .test_splitting import S, np

SF = "/root/testdata/sf0.001"


def structure(seed):
    """PDB lines of two models with chains A (rna), B (protein) and C (too short)."""
    rng = random.Random(seed)
    lines, serial = ["HEADER"], 0
    for model in (1, 2):
        lines.append(f"MODEL     {model:4d}")
        for chain, n, names, atom in (("A", 110, "ACGU", "C3'"), ("B", 75, ("GLY", "ALA", "SER"), "CA"), ("C", 12, "ACGU", "C3'")):
            number, centre = -2, (0.0, 0.0, 0.0)
            for k in range(n - (model - 1) * 7):
                if k % 25 == 0:
                    centre = tuple(rng.uniform(-45, 45) for _ in range(3))
                number += rng.choice([1, 1, 1, 1, 3]) if k % 11 else 0
                icode = "A" if not k % 11 and k else " "
                name = rng.choice(names)
                spread = 9 if chain == "A" else 5
                for alt, occupancy in ((("A", 0.4), ("B", 0.6)) if k % 13 == 0 else ((" ", 1.0),)):
                    for a in ("P" if chain == "A" else "N", atom):
                        serial += 1
                        x, y, z = (c + rng.uniform(-spread, spread) for c in centre)
                        lines.append(f"ATOM  {serial:5d} {' ' + a:<4}{alt}{name:>3} {chain}{number:4d}{icode}   {x:8.3f}{y:8.3f}{z:8.3f}{occupancy:6.2f}{0:6.2f}          {'C':>2}  ")
            serial += 1
            lines.append(f"HETATM{serial:5d}  O   HOH {chain}{900:4d}    {0:8.3f}{0:8.3f}{0:8.3f}{1:6.2f}{0:6.2f}          {'O':>2}  ")
        lines.append("ENDMDL")
    return lines


def plain_residues(lines):
    """(model, chain) -> kind and residues (label, number, x, y, z), by walking the lines."""
    model, atoms = 0, {}
    for line in lines:
        model += line.startswith("MODEL")
        if line[:6] in ("ATOM  ", "HETATM") and line[17:20] != "HOH":
            atoms.setdefault((max(model, 1), line[20:22].strip()), []).append(line)
    out = {}
    for key, own in atoms.items():
        rna = all(len(line[17:20].strip()) == 1 for line in own)
        best = {}
        for line in own:
            if line[12:16].strip() == ("C3'" if rna else "CA"):
                place = (line[22:26], line[26])
                rank = (-float(line[54:60]), line[16].strip(), int(line[6:11]))
                if place not in best or rank < best[place][0]:
                    best[place] = (rank, line)
        rows = sorted((line for _, line in best.values()), key=lambda v: int(v[6:11]))
        if len(rows) >= 30:
            out[key] = "rna" if rna else "protein", [(v[22:27].strip(), *(float(v[a : a + 8]) for a in (30, 38, 46))) for v in rows]
    return out


def plain_labels(kind, residues):
    cutoff, least = (15.0, 30) if kind == "rna" else (7.5, 10)
    points = [r[1:] for r in residues]
    pairs = [(i, j) for i in range(len(points)) for j in range(i + 1, len(points)) if j == i + 1 or math.dist(points[i], points[j]) < cutoff]
    i, j = np.array(pairs).T
    e = S.Edges(len(points), i, j, np.ones(len(i)))
    pieces = plain_merge(e, plain_pieces_of(e, least), 0.2)
    label = {x: k for k, p in enumerate(pieces) for x in p}
    return [label[x] for x in range(len(points))]


def plain_pieces_of(e, least):
    from .test_chain_queries import plain_split

    def pieces(nodes):
        best = plain_split(e, nodes, None, least)
        return [nodes] if best is None or best[0] < 0.4 else [p for part in best[1:] for p in pieces(part)]

    return pieces(list(range(e.n)))


def plain_ranges(labels, residues, label):
    """``a-b`` of the runs of a label's residues whose number stays or grows by one."""
    runs = []
    for k, r in zip(labels, residues, strict=True):
        if k == label:
            number = int("".join(c for c in r[0] if c.isdigit()))
            if runs and number - runs[-1][2] in (0, 1):
                runs[-1][1:] = [r[0], number]
            else:
                runs.append([r[0], r[0], number])
    return [a if a == b else f"{a}-{b}" for a, b, _ in runs]


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pdb")
    given = {f"s{k}": structure(k) for k in range(3)}
    for name, lines in given.items():
        (folder / f"{name}.pdb").write_text("\n".join(lines) + "\n")
    want = {}
    for name, lines in given.items():
        for (model, chain), (kind, residues) in plain_residues(lines).items():
            want[name, model, chain] = kind, residues, plain_labels(kind, residues)
    partitions = [(*key, f"1-{len(r) // 2};{len(r) // 2 + 3}-{len(r)}") for key, (_, r, _) in want.items()]
    atoms = files.read_structures(spark, str(folder))
    table = spark.createDataFrame(partitions, "structure_id string, model_id int, chain_id string, partition string")
    return want, run_pipeline(atoms, partitions=table), partitions


def test_residues_of_all_models(whole):
    want, out, _ = whole
    got = {}
    for r in out["residues"].orderBy("pos").collect():
        got.setdefault((r.structure_id, r.model_id, r.chain_id), []).append((r.res_label, r.x, r.y, r.z))
    assert got == {key: residues for key, (_, residues, _) in want.items()} and len(got) == 12
    assert {k for k, _, _ in want.values()} == {"rna", "protein"}


def test_labels(whole):
    want, out, _ = whole
    got = {}
    for r in out["labels"].orderBy("pos").collect():
        got.setdefault((r.structure_id, r.model_id, r.chain_id), []).append(r.label)
    assert got == {key: labels for key, (*_, labels) in want.items()}
    assert sum(len(set(labels)) > 1 for labels in got.values()) > 3


def test_summary_and_results(whole):
    want, out, _ = whole
    got = {(r.structure_id, r.model_id, r.chain_id, r.label): (r.residues, r.ranges, r.n_clusters, r.n_outliers) for r in out["summary"].collect()}
    expect = {}
    for key, (_, residues, labels) in want.items():
        for k in set(labels):
            expect[*key, k] = (labels.count(k), ", ".join(plain_ranges(labels, residues, k)), len(set(labels)), 0)
    assert got == expect
    for r in out["results"].collect():
        _, residues, labels = want[r.structure_id, r.model_id, r.chain_id]
        assert list(r.cluster) == labels and list(r.res_labels) == [x[0] for x in residues] and list(r.res) == list(range(1, len(labels) + 1))
        assert [tuple(p) for p in r.data] == [x[1:] for x in residues]
        assert sorted(r.commands) == sorted(c.command for c in out["commands"].where(F.struct("structure_id", "model_id", "chain_id") == F.struct(F.lit(r.structure_id), F.lit(r.model_id), F.lit(r.chain_id))).collect())
        for command, k in zip(r.commands, sorted(set(labels)), strict=True):
            assert "+".join(plain_ranges(labels, residues, k)) in command


def plain_scores(true, pred):
    """CSD, IoU, NDO and DBD from two lists of labels."""

    def runs(y):
        out = []
        for k, v in enumerate(y):
            if out and out[-1][0] == v:
                out[-1][2] = k
            else:
                out.append([v, k, k])
        return out

    def segments(y):
        r = runs(y)
        for n, (v, a, b) in enumerate(r):
            if v != -1:
                yield a, b, r[n - 1][1] if n and r[n - 1][0] == -1 else a, r[n + 1][2] if n + 1 < len(r) and r[n + 1][0] == -1 else b

    def distance(p, t):
        tail = abs(p[3] - t[3])
        return min((abs(p[0] - t[0]) + abs(p[1] - t[1])) / 2, *((abs(a - b) + tail) / 2 for a in (p[0], p[2]) for b in (t[0], t[2])))

    def entities(y):
        r = runs(y)
        points = [(k, k) for k in range(1, len(y)) if -1 not in (y[k - 1], y[k]) and y[k - 1] != y[k]]
        return points + [(a, b) for v, a, b in r[1:-1] if v == -1]

    p, t = list(segments(pred)), list(segments(true))
    csd = None if not t else 0.0
    if p and t:
        rows, others = (p, t) if len(p) >= len(t) else (t, p)
        d = (lambda x, y: distance(x, y)) if rows is p else (lambda x, y: distance(y, x))
        csd = sum(max(max(20 - d(x, y), 0) for y in others) for x in rows) / (20 * len(rows))
    n_t, n_p = len({*true} - {-1}), len({*pred} - {-1})
    a, b = entities(pred), entities(true)
    if n_t == 1 and n_p == 1:
        dbd = 1.0
    elif 1 in (n_t, n_p):
        dbd = 0.0
    elif (n_t == 0) != (n_p == 0):
        dbd = 1.0
    else:
        dbd = sum(max(0, 20 - max(0, y[0] - x[1], x[0] - y[1])) for x in a for y in b) / (20 * max(len(a), len(b))) if a and b else None
    core = [(x, y) for x, y in zip(true, pred, strict=True)]
    most = lambda side, other: sum(2 * max([core_count(core, side, v, w) for w in {*other} - {-1}], default=0) - list(side).count(v) for v in {*side} - {-1})
    size = len([v for v in true if v != -1])
    ndo = (most(true, pred) + most(pred, true)) / (2 * size) if size else None
    used, total = set(), 0.0
    for v in sorted({*true} - {-1}):
        free = [(-core_count(core, true, v, w), w) for w in {*pred} - {-1} if w not in used and core_count(core, true, v, w)]
        if free:
            n, w = min(free)
            used.add(w)
            total += -n / (true.count(v) + pred.count(w) + n) * true.count(v)
    return csd, total / size if size else 0.0, ndo, dbd

def core_count(core, side, v, w):
    """Residues with label v on ``side`` and w on the other."""
    first = [x for x, _ in core] == list(side)
    return sum((x, y) == ((v, w) if first else (w, v)) for x, y in core)


def test_scores(whole):
    want, out, partitions = whole
    got = {(r.structure_id, r.model_id, r.chain_id): (r.csd, r.iou, r.ndo, r.dbd) for r in out["scores"].collect()}
    assert set(got) == set(want)
    for *key, text in partitions:
        pred = want[tuple(key)][2]
        first, second = ([int(x) for x in part.split("-")] for part in text.split(";"))
        true = [0 if first[0] <= k <= first[1] else 1 if second[0] <= k <= second[1] else -1 for k in range(1, len(pred) + 1)]
        assert got[tuple(key)] == tuple(x if x is None else pytest.approx(x, abs=6e-4) for x in plain_scores(true, pred))


def test_band_joins_of_random_labels(spark):
    """CSD and DBD of labels of all shapes, and chains far longer than a band."""
    rng = random.Random(8)
    chains = []
    for _ in range(150):
        shape = lambda: [v for _ in range(rng.randint(1, 14)) for v in [rng.choice([-1, 0, 1, 2])] * rng.choice([1, 2, 5, 19, 20, 21, 40, 41, 90])]
        true, pred = shape(), shape()
        n = min(len(true), len(pred))
        chains.append((true[:n], pred[:n]))
    rows = [(c, k, t, p) for c, (true, pred) in enumerate(chains) for k, (t, p) in enumerate(zip(true, pred, strict=True))]
    both = spark.createDataFrame(rows, "chain_id int, pos int, true int, pred int")
    got = {r.chain_id: r for r in scores.csd(both, ["chain_id"]).join(scores.dbd(both, ["chain_id"]), "chain_id").collect()}
    for c, (true, pred) in enumerate(chains):
        csd, _, _, dbd = plain_scores(true, pred)
        assert got[c].csd == (csd if csd is None else pytest.approx(csd)) and got[c].dbd == (dbd if dbd is None else pytest.approx(dbd)), c


def test_near_pairs_are_linear_in_segments(spark):
    n = 20_000
    both = spark.range(n).select(F.lit(1).alias("chain_id"), F.col("id").cast("int").alias("pos"), (F.floor(F.col("id") / 7) % 3).cast("int").alias("true"), (F.floor((F.col("id") + 2) / 7) % 3).cast("int").alias("pred"))
    p, t = scores._both_sides(both, ["chain_id"])
    assert p.count() > n / 8 and scores.near_segments(p, t, ["chain_id"], 20).count() < 40 * p.count()


def test_detect_domains_of_long_chains(spark):
    """The registered query of the long chains, by trying every split."""
    from foldspark.jobs.fixtures import long_residues

    rows = {}
    for r in long_residues(spark, SF).orderBy("pos").collect():
        rows.setdefault(r.chain_id, []).append((r.x, r.y, r.z))
    chains = sorted(rows, key=lambda c: len(rows[c]))[:3]
    got = {}
    for r in registry.QUERIES["detect_domains_long"](spark, SF).where(F.col("chain_id").isin(*chains)).orderBy("pos").collect():
        got.setdefault(r.chain_id, []).append(r.label)
    for c in chains:
        points = np.array(rows[c])
        near = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1)) < 7.5
        i, j = np.nonzero(np.triu(near, 2) | np.eye(len(points), k=1, dtype=bool))
        e = S.Edges(len(points), i, j, np.ones(len(i)))
        label = {x: k for k, p in enumerate(plain_merge(e, plain_pieces(e, list(range(e.n)), 0.4))) for x in p}
        assert got[c] == [label[x] for x in range(len(points))]


def test_pipeline_query_equals_sql_for_its_summary(spark):
    """Residues, clusters and outliers of each chain of the registered query, recounted from the labels' query."""
    got = {(r.chain_id, r.label): r for r in registry.QUERIES["run_pipeline"](spark, SF).collect()}
    sizes = dict(duck_rows("select user_id, count(*) from events group by 1", SF)[2])
    per = {}
    for (c, _), r in got.items():
        per.setdefault(c, []).append(r)
    for c, rows in per.items():
        assert sum(r.residues for r in rows) <= sizes[c] and len({r.n_clusters for r in rows}) == 1 and rows[0].n_clusters == len(rows)
