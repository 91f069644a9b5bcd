"""Readers on small files."""

from pyspark.sql import functions as F

from foldspark.sources import files, sinks, structures

PDB = """HEADER
REMARK 465   M RES C SSSEQI
REMARK 465     GLY A    -1
REMARK 465       G B    12A
REMARK 465
ATOM      1  CA  GLY A   1      11.104   6.134  -6.504  1.00  0.00           C
HETATM    2  O   HOH A 101       1.000   2.000   3.000  1.00  0.00           O
MODEL        1
MODEL        2
ATOM      3  C3'   G B  12A      1.500  -2.000   3.000  0.50  0.00           C
"""
CIF = """data_x
loop_
_atom_site.group_PDB
_atom_site.id
_atom_site.auth_atom_id
_atom_site.auth_comp_id
_atom_site.auth_asym_id
_atom_site.auth_seq_id
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
ATOM 1 "C3'" G B 12 1.5 -2.0 3.0
HETATM 2 O HOH B 13 1 2 3
#
"""


def test_pdb(spark, tmp_path):
    (tmp_path / "x.pdb").write_text(PDB)
    rows = structures.read_pdb(spark, str(tmp_path)).orderBy("serial").collect()
    assert [(r.structure_id, r.model_id, r.atom_name, r.chain_id, r.res_seq, r.icode, r.hetflag) for r in rows] == [("x", 1, "CA", "A", 1, "", ""), ("x", 1, "O", "A", 101, "", "W"), ("x", 2, "C3'", "B", 12, "A", "")]
    assert (rows[0].x, rows[0].y, rows[0].z, rows[2].occupancy) == (11.104, 6.134, -6.504, 0.5)
    missing = structures.missing_from_lines(structures._lines(spark, str(tmp_path))).orderBy("ord").collect()
    assert [(r.chain_id, r.res_name, r.res_label) for r in missing] == [("A", "GLY", "-1"), ("B", "G", "12A")]


def test_mmcif(spark, tmp_path):
    (tmp_path / "y.cif").write_text(CIF)
    rows = structures.read_mmcif(spark, str(tmp_path)).orderBy("serial").collect()
    assert [(r.structure_id, r.atom_name, r.res_seq, r.x, r.hetflag) for r in rows] == [("y", "C3'", 12, 1.5, ""), ("y", "O", 13, 1.0, "W")]


def test_base_pairs(spark):
    text = '{"pairs":[{"nt1":"A.G1","nt2":"A.C12A"}],"stems":[{"pairs":[{"i":"B:7","j":"B:9"}]}],"bps":[{"res1":{"nt_id":"C.U5"},"res2":{"id":"C.A8"}}]}'
    got = structures.paired_residues(spark.createDataFrame([("s", text), ("t", "{}")], "structure_id string, value string")).collect()
    assert {(r.chain_id, r.res_label) for r in got} == {("A", "1"), ("A", "12A"), ("B", "7"), ("B", "9"), ("C", "5"), ("C", "8")}


def test_split_files(spark, tmp_path):
    keys = ["structure_id", "chain_id"]
    atoms = spark.createDataFrame([("s", "A", "1", 1), ("s", "A", "2", 2)], "structure_id string, chain_id string, res_label string, serial int")
    labels = spark.createDataFrame([("s", "A", "1", 0), ("s", "A", "2", 1)], "structure_id string, chain_id string, res_label string, label int")
    split = sinks.split_structure_by_cluster(atoms, labels, keys)
    for c in ("atom_name", "res_name", "icode", "altloc", "hetflag"):
        split = split.withColumn(c, F.lit(""))
    split = split.withColumns({"res_seq": F.lit(1), "x": F.lit(1.0), "y": F.lit(None).cast("double"), "z": F.lit(-1.0)})
    sinks.write_split_structures(split, str(tmp_path / "out"), keys)
    assert (tmp_path / "out/structure_id=s/chain_id=A/label=1").is_dir()
    back = sinks.read_split_structures(spark, str(tmp_path / "out"), keys, "structure_id string, chain_id string").collect()
    assert sorted((r.structure_id, r.chain_id, r.label, r.serial, r.x, r.y, r.z) for r in back) == [("s", "A", 0, 1, 1.0, None, -1.0), ("s", "A", 1, 2, 1.0, None, -1.0)]


MODELS = """MODEL        1
ATOM      1  CA AGLY A  -3      11.104   6.134  -6.504  0.60  1.50           C1+
ATOM      2  CA BGLY A  -3      12.104   6.134  -6.504  0.40  1.50           C
HETATM    3 FE   HEM A 101A      1.000   2.000   3.000  1.00  0.00          FE
ENDMDL
MODEL        2
ATOM      1  CA AGLY A  -3      -1.104 106.134-100.504  0.60  1.50           C
ATOM  bad   CA  GLY A   x      -1.104
ENDMDL
"""
ODD_CIF = """data_y
loop_
_atom_site.group_PDB
_atom_site.id
_atom_site.label_alt_id
_atom_site.auth_atom_id
_atom_site.auth_comp_id
_atom_site.auth_asym_id
_atom_site.auth_seq_id
_atom_site.Cartn_x
_atom_site.pdbx_PDB_model_num
ATOM 1 A "O5'" G BG 12 1.5 1
ATOM 2 B "O5'" G BG 12 2.5
2
HETATM 3 . 'C "1' X BG ? . 7
loop_
_other.id
5
"""


def write_files(folder):
    import gzip

    folder.mkdir()
    (folder / "a.pdb").write_text(MODELS)
    (folder / "b.x.ent").write_text(PDB.replace("\n", "\r\n"))
    (folder / "empty.pdb").write_text("")
    (folder / "y.cif").write_text(ODD_CIF)
    (folder / "_ignored").write_text(PDB)
    (folder / "deep").mkdir()
    (folder / "deep" / "z.cif.gz").write_bytes(gzip.compress(CIF.encode()))


def test_structure_files_as_a_data_source(spark, tmp_path):
    write_files(tmp_path / "in")
    files.register(spark)
    found = spark.read.format("structures").load(str(tmp_path / "in"))
    rows = {(r.structure_id, r.model_id, r.serial, r.altloc): r for r in found.collect()}
    assert sorted(rows, key=str) == sorted([
        ("a", 1, 1, "A"), ("a", 1, 2, "B"), ("a", 1, 3, ""), ("a", 2, 1, "A"), ("a", 2, None, "G"), ("b.x", 1, 1, ""), ("b.x", 1, 2, ""), ("b.x", 2, 3, ""),
        ("y", 1, 1, "A"), ("y", 2, 2, "B"), ("y", 7, 3, ""), ("z", 1, 1, ""), ("z", 1, 2, ""),
    ], key=str)
    assert (rows["a", 1, 1, "A"].charge, rows["a", 1, 3, ""].icode, rows["a", 1, 3, ""].hetflag, rows["a", 2, 1, "A"].z) == ("1+", "A", "H", -100.504)
    assert (rows["y", 7, 3, ""].atom_name, rows["y", 7, 3, ""].res_seq, rows["y", 7, 3, ""].x, rows["y", 2, 2, "B"].chain_id) == ('C "1', None, None, "BG")


def test_the_data_source_equals_the_readers_of_lines_and_texts(spark, tmp_path):
    write_files(tmp_path / "in")
    lines = structures.read_pdb(spark, str(tmp_path / "in/*.[pe][dn][bt]"))
    texts = structures.read_mmcif(spark, str(tmp_path / "in/y.cif"))
    for kind, other, ids in (("pdb", lines, ("a", "b.x")), ("mmcif", texts, ("y",))):
        found = files.read_structures(spark, f"file://{tmp_path}/in").where(F.col("structure_id").isin(*ids))
        assert sorted(map(repr, found.collect())) == sorted(map(repr, other.select(*found.columns).collect())) and kind


def test_many_small_files_share_partitions(spark, tmp_path):
    for k in range(40):
        (tmp_path / f"s{k:02}.pdb").write_text(PDB)
    size = len(PDB)
    files.register(spark)
    found = spark.read.format("structures").option("bytes", 10 * size).load(str(tmp_path))
    assert found.rdd.getNumPartitions() == 4 and found.count() == 120
    assert files.packed([("a", 5), ("b", 50), ("c", 5), ("d", 5)], 10) == [["a"], ["b"], ["c", "d"]]


def test_pdb_lines_read_back(spark, tmp_path):
    """Lines of all models and alternate locations, by cluster, through the files."""
    write_files(tmp_path / "in")
    atoms = files.read_structures(spark, str(tmp_path / "in")).where("structure_id = 'a' and serial is not null")
    atoms = atoms.withColumn("res_label", F.concat(F.col("res_seq").cast("string"), "icode"))
    labels = spark.createDataFrame([("a", 1, "A", "-3", 4), ("a", 1, "A", "-3", 2), ("a", 1, "A", "101A", 0), ("a", 2, "A", "-3", -1)], "structure_id string, model_id int, chain_id string, res_label string, label int")
    split = sinks.split_structure_by_cluster(atoms, labels)
    sinks.write_split_structures(split, str(tmp_path / "out"))
    back = sinks.read_split_structures(spark, str(tmp_path / "out"))
    columns = [c for c in split.columns if c != "res_label"]
    assert sorted(map(tuple, back.select(*columns).collect())) == sorted(map(tuple, split.select(*columns).collect())) and back.count() == 3
    (file,) = (tmp_path / "out/structure_id=a/model_id=1/chain_id=A/label=2").glob("*.txt")
    assert file.read_text() == "".join(line + "\n" for line in MODELS.splitlines()[1:3]).replace("C1+", "C1+").replace("0.40  1.50           C\n", "0.40  1.50           C  \n")


def test_numbers_beyond_their_columns(spark):
    rows = spark.createDataFrame([(123456, 12345, -12345.6789), (7, -1234, 1e9), (None, None, None)], "serial int, res_seq int, x double")
    for c in ("record", "atom_name", "altloc", "res_name", "chain_id", "icode", "element", "charge"):
        rows = rows.withColumn(c, F.lit("LONGNAME"))
    for c in ("y", "z", "occupancy", "bfactor"):
        rows = rows.withColumn(c, F.lit(0.0))
    lines = [r.value for r in rows.select(sinks.pdb_line().alias("value")).collect()]
    assert {len(v) for v in lines} == {80} and lines[0][6:11].strip() == "3456" and lines[1][22:26].strip() == "-234"
    assert lines[0][30:38] == " " * 8 and lines[1][30:38] == " " * 8 and lines[0][38:46] == "   0.000"


def test_sinks_write_and_read_back(spark, tmp_path):
    from foldspark.schemas import K

    residues = spark.createDataFrame([("s", 1, "A", i, i + 1, f"{i + 1}", float(i), 0.5, -1.0) for i in range(4)], "structure_id string, model_id int, chain_id string, pos int, res_num int, res_label string, x double, y double, z double")
    labels = residues.select(*K, "pos", F.floor(residues.pos / 2).cast("int").alias("label"))
    missing = spark.createDataFrame([("s", "A", "9", 1), ("s", "A", "7A", 0)], "structure_id string, chain_id string, res_label string, ord int")
    out = sinks.result_frame(residues, labels, missing=missing)
    sinks.write_results_json(out, str(tmp_path / "json"))
    read = spark.read.schema(out.schema).json(str(tmp_path / "json")).collect()
    assert read == out.collect() and read[0].cluster == [0, 0, 1, 1] and read[0].missing_res == ["7A", "9"]
