"""Kernels and text operators against small independent computations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from residua.functions import text as tx
from residua.operators import alignment, classify, cluster, features, labels, resample, selection, structures
from residua.operators.graph import components
from residua.sources import files


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("v")).first().v


def atom(serial, name, res, chain, seq, x, y, z, record="ATOM"):
    return f"{record:<6}{serial:5d} {' ' + name if len(name) < 4 else name:<4} {res:>3} {chain}{seq:4d}    {x:8.3f}{y:8.3f}{z:8.3f}{1:6.2f}{10:6.2f}          {name[0]:>2}"


@pytest.fixture()
def folder(tmp_path):
    lines, n = ["REMARK made for tests", "SEQRES   1 A    6  ASP PHE GLY ALA PRO GLU", "SEQRES   2 A    6  XYZ"], 0
    for i, res in enumerate(["ASP", "PHE", "GLY", "ALA", "PRO", "GLU"]):
        for k, name in enumerate(["N", "CA", "C", "O"] + ([] if res == "GLY" else ["CB"])):
            n += 1
            shift = 30 if i == 5 else 0
            lines.append(atom(n, name, res, "A", 10 + i, 3.0 * i + k * 0.9 + shift, 0.1 * k, 0))
    lines += ["TER", atom(n + 1, "O1", "LIG", "A", 99, 9, 9, 9, "HETATM")]
    (tmp_path / "1abc.pdb").write_text("\n".join(lines) + "\n")
    (tmp_path / "x_combined.pdb").write_text("\n")
    return tmp_path


def test_atoms_and_round_trip(spark, folder, tmp_path):
    atoms = files.read_atoms(spark, f"{folder}/1abc.pdb")
    assert atoms.count() == 30 and atoms.where("record = 'HETATM'").count() == 1
    assert files.list_files(spark, str(folder)).select("structure").collect() == [("1abc",)]
    files.write_structures(atoms, f"{tmp_path}/out")
    text = spark.read.option("recursiveFileLookup", True).text(f"{tmp_path}/out")
    assert text.where("value = 'TER'").count() == 1 and text.where("value like 'REMARK%'").count() == 0
    again = files.read_atoms(spark, f"{tmp_path}/out", recursive=True).drop("structure")
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, atoms.drop("structure").collect()), key=str)
    files.write_models(atoms.unionByName(atoms.withColumn("structure", F.lit("2xyz"))), f"{tmp_path}/models")
    lines = [r.value for r in spark.read.text(f"{tmp_path}/models").collect()]
    assert sum(x.startswith("MODEL") for x in lines) == 2 and lines.count("ENDMDL") == 2


def test_declared_sequences(spark, folder):
    assert files.read_declared_sequences(spark, f"{folder}/1abc.pdb").select("chain", "sequence").collect() == [("A", "DFGAPEX")]


def test_chains_residues_fragments_loops(spark, folder):
    atoms = files.read_atoms(spark, f"{folder}/1abc.pdb")
    manifest = spark.createDataFrame([("1ABC", ["A", "B"])], "accession string, chains array<string>")
    found, none = structures.requested_chains(atoms, manifest)
    assert found.count() == 29 and none.collect() == [("1ABC", "B")]
    rows = structures.residues(found)
    assert structures.sequences(rows).first().seq == "DFGAPE"
    # The last residue lies far off, so it is a fragment of its own and goes.
    assert structures.sequences(structures.peptide_fragments(rows, 3.5)).first().seq == "DFGAP"
    loops, lost = structures.loops(found, ["FGA"])
    assert [r.resseq for r in loops.orderBy("resseq").collect()] == [11, 12, 13] and lost.count() == 0
    assert structures.loops(found, ["WWW"])[1].count() == 1


def test_residue_points_fall_back_to_the_backbone(spark, folder):
    atoms = files.read_atoms(spark, f"{folder}/1abc.pdb").where("record = 'ATOM'").withColumn("pos", F.col("resseq"))
    n = {r.resname: len(r.points) for r in features.residue_points(atoms).collect()}
    assert n["GLY"] == 4 and n["ALA"] == 1


def test_manifest_alignment_labels_and_mappings(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("Accession\tChains\n1abc\tA; B\n")
    assert files.read_manifest(spark, f"{tmp_path}/m.tsv").collect() == [("1ABC", ["A", "B"])]
    (tmp_path / "a.fa").write_text(">ref\nAC-\nDEF\n>s1\nA--D GF\n")
    rows = files.read_alignment(spark, f"{tmp_path}/a.fa")
    assert {(r.name, r.aligned) for r in rows.collect()} == {("ref", "AC-DEF"), ("s1", "A--DGF")}
    pairs, bad = files.pairwise_alignments(rows)
    assert pairs.select("reference", "other").collect() == [("AC-DEF", "A--DGF")] and bad.count() == 0
    (tmp_path / "c.csv").write_text("# ClusterLabel,PDBCode,FullName\n0,1ABC_A,1ABC_A_model\n")
    assert files.read_cluster_labels(spark, f"{tmp_path}/c.csv").collect() == [(0, "1ABC_A", "1ABC_A_model")]
    (tmp_path / "s.csv").write_text(",".join(files.ASSIGNMENTS.fieldNames()) + '\na,b,c,d,e,f,g,h,"two\nlines, ""quoted"""\n')
    assert files.read_assignments(spark, f"{tmp_path}/s.csv").first().raw_output == 'two\nlines, "quoted"'
    (tmp_path / "p.json").write_text('{"pdb_id": "1abc", "mappings": {"P1": {"mappings": [{"chain_id": "A"}, {"chain_id": "B"}]}}}\n')
    assert {tuple(r) for r in files.read_mappings(spark, f"{tmp_path}/p.json").collect()} == {("1abc", "P1", "A"), ("1abc", "P1", "B")}


def test_stage_and_partitioned_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "structure string, v int")
    assert files.save_stage(rows, str(tmp_path), "all", "structure").count() == 3
    files.write_by_cluster(rows, spark.createDataFrame([("a", 0), ("b", -1)], "structure string, label int"), f"{tmp_path}/by")
    assert {(r.structure, r.cluster) for r in spark.read.parquet(f"{tmp_path}/by").collect()} == {("a", "cluster_0"), ("b", "noise")}
    files.write_passing(rows, rows.where("v > 1"), f"{tmp_path}/pass")
    assert files.load_stage(spark, str(tmp_path), "pass").count() == 2
    files.write_csv(rows, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 3


def test_greedy_alignment_and_triage(spark):
    r = one(spark, tx.greedy_alignment(F.col("d"), F.col("o")), d="DFGXXAPE", o="DFGAPE")
    assert (r.aligned, r.matched, r.longest_gap) == ("DFG--APE", 6, 2)
    assert one(spark, tx.natural_residues(F.col("d"), F.col("a")), d="AXBZJX", a="AXBZJ-") == "AGNQLG"
    assert one(spark, tx.natural_residues(F.col("d"), F.col("a")), d="AXA", a="A--") == "AXA"
    decide = lambda d, o, limit=2: one(spark, tx.triage(F.col("d"), F.col("o"), limit), d=d, o=o)
    assert decide("MDFGKAPE", "DFGKAPEW").decision == "copy"
    assert decide("DFGKKAPE", "DFGAPE").decision == "needs_rebuild"
    assert decide("DFGKKKAPE", "DFGAPE").reason == "gap too long"
    assert decide("DFGK", "DFGAPE").reason == "motif missing" and decide(None, "DFGAPE").reason == "no sequence"
    low, high = tx.motif_region(F.col("s"), ["APE", "DFG"])
    assert one(spark, F.array(low, high), s="xDFGxxAPEx") == [1, 9] and one(spark, F.array(low, high), s="xDFGx") == [1, 4]


def test_reports_and_labels(spark):
    raw = "Name Ligand Ligand_label\nx ATP Type1\nDFG-in kinase\nChelix is out\nBLAminus"
    p = one(spark, tx.parse_report(F.col("r")), r=raw)
    assert tuple(p) == ("in", "out", "DFGin_Chelix_out", "Inactive conformation (Type I/Type II-like)", "ATP", "Type1")
    assert tuple(one(spark, tx.parse_report(F.col("r")), r="nothing")) == ("unknown",) * 6
    assert one(spark, tx.dihedral_state(F.col("r")), r=raw) == "BLAminus"
    assert one(spark, tx.dihedral_state(F.col("r")), r="Dihedral_label\nNext") == "Next"
    assert one(spark, tx.dihedral_state(F.col("r")), r=None) == "unknown"
    out = labels.assemble_assignments(spark.createDataFrame([("a",), ("b",)], "structure string"), spark.createDataFrame([("a", raw)], "structure string, raw string"))
    assert {r.structure: r.dfg_conformation for r in out.collect()} == {"a": "in", "b": "failed"}
    assert labels.annotate_assignments(out).columns[-2:] == ["dihedral_state", "activation"]
    assert labels.annotate_assignments(out.select("structure")).first().activation == "Unknown"


def test_payload_functions(spark):
    schema = "genes array<struct<geneName: struct<value: string>, synonyms: array<struct<value: string>>>>, k array<string>"
    rows = spark.createDataFrame([([((None,), [("syn",)]), (("main",), None)], ["x", "Tyrosine-protein", "serine/threonine"]), ([((None,), [("only",)])], [])], schema)
    assert [tuple(r) for r in rows.select(tx.gene_name(F.col("genes")), tx.keyword_group(F.col("k")), tx.first_mention(F.col("k"), "SERINE")).collect()] == [("main", "TK", "serine/threonine"), ("only", None, None)]


def dense_spline(y, x):
    """One path's spline from the full system of its second derivatives."""
    n = len(y)
    m, rhs = np.zeros((n, n)), np.zeros_like(y)
    for i in range(1, n - 1):
        m[i, i - 1 : i + 2] = 1, 4, 1
        rhs[i] = 6 * (y[i - 1] - 2 * y[i] + y[i + 1])
    m[0, :3] = m[-1, -3:] = 1, -2, 1
    bend = np.linalg.solve(m, rhs)
    i = np.clip(np.floor(x).astype(int), 0, n - 2)
    t = (x - i)[:, None]
    return y[i] + t * (y[i + 1] - y[i] - (2 * bend[i] + bend[i + 1]) / 6 + t * (bend[i] / 2 + t * (bend[i + 1] - bend[i]) / 6))


def test_orders_by_ranges(spark):
    from residua.operators import ranges

    r = np.random.default_rng(4)
    values = [int(v) for v in r.integers(0, 60, 500)] + [None] * 7
    rows = spark.createDataFrame([(i, v, i % 3) for i, v in enumerate(values)], "structure int, v int, label int").repartition(5)
    got = ranges.numbered_by_range(rows, "structure").collect()
    assert sorted((q.structure, q.number) for q in got) == [(i, i) for i in range(507)]
    known = [v for v in values if v is not None]
    assert np.allclose(ranges.quantiles(rows, "v", [0, 0.25, 0.5, 0.95, 1]), np.quantile(known, [0, 0.25, 0.5, 0.95, 1]))
    assert ranges.quantiles(rows.where("v > 99"), "v", [0.5]) == [None] and ranges.quantiles(rows.limit(0), "v", [0.5]) == [None]
    for n in (0, 1, 50, 507, 900):
        one = {q.structure for q in ranges.least_by_hash(rows, n, "structure").collect()}
        assert len(one) == min(n, 507) and one == {q.structure for q in ranges.least_by_hash(rows, n, "structure", bits=2).collect()}
    per = [q.label for q in ranges.least_by_hash(rows, 20, "structure", by=("label",)).collect()]
    assert sorted(per) == [0] * 20 + [1] * 20 + [2] * 20


def test_spline_and_resampling(spark):
    t = np.linspace(0, 3, 9)
    y = np.stack([t**3 - t, 2 * t, np.ones_like(t)], axis=1)
    x = np.arange(0, 8, 0.1)
    u = x * 3 / 8
    assert np.allclose(resample.cubic_through(y[None], x)[0], np.stack([u**3 - u, 2 * u, np.ones_like(u)], axis=1))
    for n in (4, 5, 11):
        z = np.random.default_rng(n).normal(size=(3, n, 3))
        assert np.allclose(resample.cubic_through(z, np.arange(0, n - 1, 0.1)), np.stack([dense_spline(v, np.arange(0, n - 1, 0.1)) for v in z]))
    line = np.stack([np.arange(6.0)] * 3, axis=1)
    out = resample.evenly_spaced(line[None], 27)[0]
    assert len(out) == 27 and np.all(np.diff(out[:, 0]) >= 0) and np.allclose(out[:, 0], out[:, 2]) and out[0, 0] == 0
    rows = spark.createDataFrame([("a", i, float(i), 0.0, 0.0) for i in range(5)] + [("b", 0, 0.0, 0.0, 0.0)], "structure string, ord int, x double, y double, z double")
    paths, short = resample.resample(rows)
    assert paths.count() == 27 and short.collect() == [("b",)]
    assert len(resample.flattened(paths).first().coords) == 81


def test_f_tail_matches_known_values():
    assert math.isclose(selection._f_tail(4.0, 2, 10), 0.05289, rel_tol=1e-3)
    assert math.isclose(selection._f_tail(1.0, 5, 5), 0.5, rel_tol=1e-6)
    assert math.isclose(selection._f_tail(161.4476, 1, 1), 0.05, rel_tol=1e-3)


def test_anova_edges(spark):
    rows = [("a", 1, 0, 1.0), ("b", 1, 0, 1.0), ("c", 1, 1, 2.0), ("d", 1, 1, 2.0), ("a", 2, 0, 1.0), ("b", 2, 0, 3.0), ("c", 3, 0, None), ("a", 4, 0, 1.0), ("b", 4, 0, 2.0), ("c", 4, 1, 4.0), ("d", 4, 1, 5.0)]
    f = {r.feature: r.f for r in selection.anova_f(spark.createDataFrame(rows, "structure string, feature int, label int, value double")).collect()}
    assert math.isnan(f[1])
    assert f[2] == 0 and 3 not in f and math.isclose(f[4], 18.0)


def test_mean_groups_follow_the_leader(spark):
    means = [0.0, 0.009, 0.018, 0.5, 0.509, -0.005]
    stats = spark.createDataFrame([(i, m) for i, m in enumerate(means)] + [(9, None)], "feature long, mean double")
    got = {r.feature: r.component for r in selection.mean_groups(stats, 0.01).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3, 5: 0}


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100
    assert components(edges.limit(0)).count() == 0


def test_clustering(spark):
    r = np.random.default_rng(0)
    pts = np.concatenate([r.normal(0, 0.1, (40, 2)), r.normal(5, 0.1, (40, 2)), [[50, 50]]])
    rows = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "id long, z1 double, z2 double")
    side = lambda df: [{r.cluster for r in df.collect() if a <= r.id < b} for a, b in ((0, 40), (40, 80), (80, 81))]
    a, b, c = side(cluster.hierarchical(rows, 3))
    assert len(a) == len(b) == len(c) == 1 and len(a | b | c) == 3
    labels = spark.createDataFrame(cluster.density(rows, 0.5, 5, 5).collect(), "id long, cluster int")
    assert tuple(side(labels)) == ({0}, {1}, {-1})
    assert cluster.silhouette(rows, labels) > 0.5
    fitted = rows.join(labels, "id")
    new = spark.createDataFrame([(0, 0.0, 0.05), (1, 5.0, 5.0), (2, 20.0, 0.0)], "id long, z1 double, z2 double")
    assert {r.id: r.cluster for r in cluster.nearest_core(new, fitted, 0.5).collect()} == {0: 0, 1: 1, 2: -1}


def test_forest_attributions_add_up(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(120, 4))
    rows = spark.createDataFrame([(i, int(v[0] + v[1] > 0), v.tolist()) for i, v in enumerate(x)], "structure long, label int, x array<double>")
    model = classify.train_forest(rows, trees=5, maxDepth=4)
    phi = classify.attributions(model, rows.limit(20))
    total = {(q.structure, q["class"]): q.total for q in phi.groupBy("structure", "class").agg((F.sum("phi") + F.first("base")).alias("total")).collect()}
    for q in classify.predict(model, rows.limit(20)).collect():
        assert all(math.isclose(total[q.structure, c], q.probability[c], abs_tol=1e-9) for c in (0, 1))
    assert {q.feature for q in classify.attribution_ranking(phi, 2).collect()} == {0, 1}
    p = {q.feature: q.mean for q in classify.permutation_importance(model, rows, repeats=2).collect()}
    assert max(p, key=p.get) in (0, 1) and len(p) == 4


def test_zip_and_fallback_reference(spark):
    rows = spark.createDataFrame([("x", 0, "A-CD"), ("ref1", 1, "AB-D")], "name string, ord int, aligned string")
    assert alignment.reference_row(rows, "ref").first().name == "ref1" and alignment.reference_row(rows, "none").first().name == "x"
    z = alignment.zip_with_reference(rows, alignment.reference_row(rows, "ref"))
    assert {(q.name, q.ref_pos, q.ch) for q in z.collect()} == {("x", 0, "A"), ("x", 1, "-"), ("x", 2, "D"), ("ref1", 0, "A"), ("ref1", 1, "B"), ("ref1", 2, "D")}


def test_records_keep_their_order_in_split_files(spark, tmp_path):
    """Files far larger than a block, read in many small tasks of several blocks each."""
    for name, n in (("one", 300), ("two", 70)):
        (tmp_path / f"{name}.fa").write_text("".join(f">{name}{i}\n{'AC-DEFGHIK' * (1 + i % 9)}\n" for i in range(n)))
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size, cost in (("333", "1"), ("900", "100"), ("5000", "0")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", cost)
            rows = files.read_alignment(spark, str(tmp_path))
            assert size != "333" or rows.rdd.getNumPartitions() > 50
            got = {}
            for r in sorted(rows.collect(), key=lambda r: (r.source, r.ord)):
                got.setdefault(r.source.rpartition("/")[2], []).append(r.name)
            assert got == {f"{name}.fa": [f"{name}{i}" for i in range(n)] for name, n in (("one", 300), ("two", 70))}
            assert alignment.reference_row(rows.where(F.endswith("source", F.lit("two.fa"))), "none").first().name == "two0"
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
