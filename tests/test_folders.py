"""Text files in folders named by columns, written and read by tasks: as Spark's writer and reader have them."""

import pytest
from pyspark.sql import functions as F

from foldspark.sources import folders, sinks

ODD = ["a b", "a/b", "x=1", "50%", "e:u", None, "q?*[{^", "plain", "\t", ".dot", "_low"]


def test_folders_and_lines_are_those_of_sparks_writer(spark, tmp_path):
    rows = [(v, k % 2, -k, f"{v} {k}") for v in ODD for k in range(5)]
    rows = spark.createDataFrame(rows, "a string, b int, n int, value string")
    folders.write_texts(rows, str(tmp_path / "ours"), ["a", "b"], "n")
    rows.repartition("a", "b").sortWithinPartitions("a", "b", "n").select("a", "b", "value").write.partitionBy("a", "b").text(str(tmp_path / "sparks"))
    files = [{str(f.parent.relative_to(tmp_path / at)) for f in (tmp_path / at).rglob("*.txt")} for at in ("ours", "sparks")]
    assert files[0] == files[1] and len(files[0]) == 2 * len(ODD)
    schema = "value string, a string, b int"
    want = sorted(map(repr, spark.read.schema(schema).text(str(tmp_path / "sparks")).select("a", "b", "value").collect()))
    assert sorted(map(repr, spark.read.schema(schema).text(str(tmp_path / "ours")).select("a", "b", "value").collect())) == want
    for at in ("ours", "sparks"):
        back = folders.read_texts(spark, str(tmp_path / at), ["a", "b"]).withColumn("b", F.col("b").cast("int"))
        assert sorted(map(repr, back.collect())) == want
    (file,) = (tmp_path / "ours/a=plain/b=0").glob("*.txt")
    assert file.read_text() == "plain 4\nplain 2\nplain 0\n"


def test_split_files_cost_no_process_each(spark, tmp_path):
    """Spark's local writer starts processes for every file and for its check sum."""
    atoms = spark.range(40).select(F.lit("s").alias("structure_id"), F.lit(1).alias("model_id"), F.col("id").cast("string").alias("chain_id"), (F.col("id") % 2).cast("int").alias("label"), F.lit(1).alias("serial"), *(F.lit("").alias(c) for c in ("atom_name", "res_name", "icode", "altloc", "hetflag")), F.lit(1).alias("res_seq"), *(F.lit(1.0).alias(c) for c in "xyz"))
    sinks.write_split_structures(atoms, f"file://{tmp_path}/out")
    assert len(list((tmp_path / "out").rglob("*.txt"))) == 40 and not list((tmp_path / "out").rglob(".*.crc"))
    assert (tmp_path / "out/_SUCCESS").exists() and sinks.read_split_structures(spark, f"file://{tmp_path}/out").count() == 40
    with pytest.raises(FileExistsError):
        sinks.write_split_structures(atoms, f"file://{tmp_path}/out")
    assert len(list((tmp_path / "out").rglob("*.txt"))) == 40


def test_a_failure_leaves_nothing(spark, tmp_path):
    rows = spark.range(8).select(F.col("id").alias("a"), F.col("id").alias("n"), F.when(F.col("id") < 7, "x").otherwise(F.raise_error(F.lit("no"))).alias("value"))
    with pytest.raises(Exception, match="no"):
        folders.write_texts(rows, str(tmp_path / "out"), ["a"], "n")
    assert not (tmp_path / "out").exists()
    folders.write_texts(rows.where("a < 0"), str(tmp_path / "none"), ["a"], "n")
    assert folders.read_texts(spark, str(tmp_path / "none"), ["a"]).collect() == []
