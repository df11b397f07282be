"""Compositions of operators on small made-up inputs."""

import math

import numpy as np

from residua.operators import alignment, features
from residua.plans import reports


def test_distance_features(spark):
    rows = spark.createDataFrame([("ref", 0, "AB-D"), ("x", 1, "-BCD"), ("y", 2, "ABCD")], "name string, ord int, aligned string")
    reference = alignment.reference_row(rows, "ref")
    points = [("x", i, [(float(i), 0.0, 0.0), (float(i), 5.0, 0.0)], "ALA") for i in range(3)] + [("y", i, [(0.0, 2.0 * i, 0.0)], "GLY") for i in range(4)]
    residues = spark.createDataFrame(points, "structure string, index long, points array<struct<x: double, y: double, z: double>>, resname string")
    names = spark.createDataFrame([(0, "MET"), (2, "SER")], "ref_pos int, resname string")
    got = {(r.structure, r.pos1, r.pos2): (r.value, r.resname1, r.resname2) for r in features.distance_features(rows, reference, residues, names, scale=10.0).collect()}
    # x misses the first reference column; its C stands in a gap column of the reference and is not counted.
    assert got == {("x", 1, 2): (10.0, "Res1", "SER"), ("y", 0, 1): (20.0, "MET", "Res1"), ("y", 0, 2): (40.0, "MET", "SER"), ("y", 1, 2): (20.0, "Res1", "SER")}


def test_reduction_and_label_reports(spark):
    r = np.random.default_rng(2)
    paths = [(f"{i:04d}_A", (np.linspace(0, 1, 81) * (5 if i % 2 else -5) + r.normal(0, 0.01, 81)).tolist()) for i in range(30)]
    rows = spark.createDataFrame(paths, "structure string, coords array<double>")
    out = reports.reduction_report(rows, 3)
    assert out["explained"].count() == 3 and out["profile"].count() == 81
    ward = {x.structure: x.cluster for x in out["ward"].collect()}
    assert len({ward[f"{i:04d}_A"] for i in range(0, 30, 2)}) == 1 and ward["0000_A"] != ward["0001_A"]
    assert math.isclose(sum(x.share for x in out["sizes"].where("method = 'ward'").collect()), 1.0)
    told = spark.createDataFrame([(f"{i:04d}_A_model", "Active conformation (Type I)" if i % 2 else "DFG-out inactive conformation", "BLAminus") for i in range(28)], "pdb_code string, conformation_description string, raw_output string")
    joined = reports.label_integration(out["ward"], told)
    assert joined["merged"].count() == 28 and set(joined["merged"].select("dihedral_state").distinct().toPandas().dihedral_state) == {"BLAminus"}
    status = {x.cluster: x.status for x in joined["enrichment"].collect()}
    assert status[ward["0001_A"]] == "enriched" and status[ward["0000_A"]] == "depleted"
