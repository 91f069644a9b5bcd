"""Structures to domains: types, residues, contacts, labels, ranges, missing residues, commands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clusters, intervals, lookups, residues, scores
from ..schemas import K, Keys
from ..session import checkpoint_dir
from ..sources import sinks
from .domains import detect_domains


def run_pipeline(atoms: DataFrame, annotated: DataFrame | None = None, ss: DataFrame | None = None, partitions: DataFrame | None = None, keys: Keys = K, mode: str = "all", least: int = 30, atom_name: str = "C3'", split: float = 0.4, merge: float = 0.2, resolution: float = 1.0) -> dict[str, DataFrame]:
    """Frames residues, labels, summary, commands, missing, results (and scores with reference ``partitions``).

    Residues and labels are checkpointed to the shared folder, so the frames don't repeat contacts and clustering.
    """
    checkpoint_dir(atoms.sparkSession)
    types = residues.detect_chain_types(atoms, keys)
    rows = residues.residue_table(residues.polymer_residues(atoms, types, keys), keys, atom_name)
    rows = residues.select_chains(residues.min_length_filter(rows, keys, least), mode, keys)
    if ss is not None:
        rows = lookups.attach_ss(rows, ss, [k for k in keys if k != "model_id"])
    rows = rows.checkpoint()
    labels = detect_domains(rows, keys, ss is not None, split, merge, resolution).checkpoint()
    named = rows.select(*keys, "pos", "res_num", "res_label").join(labels, [*keys, "pos"])
    filled = intervals.forward_fill_labels(named, keys).withColumn("pos", F.col("res_num") - 1)
    out = {"residues": rows, "labels": named, "summary": clusters.cluster_summary(filled, keys), "commands": sinks.selection_commands(filled, keys)}
    if annotated is None:
        annotated = atoms.sparkSession.createDataFrame([], "structure_id string, chain_id string, res_label string, ord int")
    out["missing"] = lookups.missing_residues(annotated, atoms)
    if partitions is not None:
        truth = lookups.labels_from_partition(rows, lookups.parse_partition(partitions, keys), keys)
        both = truth.withColumnRenamed("label", "true").join(labels.withColumnRenamed("label", "pred"), [*keys, "pos"])
        out["scores"] = scores.score_report(both, keys)
    out["results"] = sinks.result_frame(rows, labels, keys, out.get("scores"), out["missing"], out["commands"])
    return out
