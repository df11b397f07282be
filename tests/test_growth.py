"""Work that grows with the input: counted rows, files and passes of steps that once made more."""

import os
import time

from pyspark.sql import functions as F

from residua.functions import text as tx
from residua.operators import curation, features, labels, ranges, structures
from residua.sources import files


def test_pairs_of_one_prefix_are_counted_not_made(spark):
    a = spark.range(300_000).select(F.concat(F.lit("kinase"), F.col("id") % 3).alias("x"))
    b = spark.range(400_000).select(F.concat(F.lit("kinase_"), "id").alias("y"))
    some = labels.join_by_prefix(a.limit(30), b.limit(40), "x", "y").groupBy("x").agg(F.count("*").alias("n"))
    assert sorted(labels.count_by_prefix(a.limit(30), b.limit(40), "x", "y", 6, F.col("x")).collect()) == sorted(some.collect())
    got = labels.count_by_prefix(a, b, "x", "y", 6, F.col("x"))
    assert {r.by: r.n for r in got.collect()} == {f"kinase{i}": 100_000 * 400_000 for i in range(3)}  # 1.2e11 pairs
    none = spark.createDataFrame([(None,), ("other1",)], "y string")
    assert labels.count_by_prefix(a, none, "x", "y", 6, F.col("x")).count() == 0


def counted(spark):
    """A column function that counts the rows that it sees, and the counter."""
    seen = spark.sparkContext.accumulator(0)

    def look(x: float) -> float:
        seen.add(1)
        return x

    return F.udf(look, "double").asNondeterministic(), seen


def test_rows_of_quantiles_are_made_once(spark):
    look, seen = counted(spark)
    rows = spark.range(5000).select(look(F.col("id").cast("double")).alias("x"))
    assert ranges.quantiles(rows, "x", [0.25, 0.5], most=100) == [1249.75, 2499.5]
    assert seen.value == 5000


def test_distances_are_made_once(spark):
    look, seen = counted(spark)
    rows = spark.range(5000).select(look(F.col("id").cast("double")).alias("first_distance"), F.lit(2.0).alias("last_distance"))
    assert curation.distance_summary(rows).collect() == [(2499.5, 2499.5, 2.0, 2.0)]
    assert seen.value == 5000


def test_heat_scale_makes_its_values_once(spark):
    look, seen = counted(spark)
    assert features.heat_scale(spark.range(1, 102).select(look(F.col("id").cast("double")).alias("value"))).collect() == [(1.0, 96.0)]
    assert seen.value == 101



def test_greedy_alignment_of_long_texts_is_one_pass(spark):
    rows = spark.createDataFrame([("AB" * 100_000, "A" * 100_000)], "d string, o string")
    began = time.time()
    (r,) = rows.select(tx.greedy_alignment(F.col("d"), F.col("o")).alias("r")).select("r.*").collect()
    assert r.aligned == "A-" * 100_000 and r.matched == 100_000 and r.longest_gap == 1
    assert time.time() - began < 20


def atoms_of(spark, n, look=lambda c: c):
    """n structures of five residues, A R G D K, with their N, CA and C."""
    name = F.get(F.array(*map(F.lit, ("ALA", "ARG", "GLY", "ASP", "LYS"))), F.col("k"))
    rows = spark.range(n).select(F.concat(F.lit("long_name_"), "id").alias("structure"), F.col("id"), F.explode(F.array(*map(F.lit, range(5)))).alias("k")).select("*", F.posexplode(F.array(*map(F.lit, ("N", "CA", "C")))).alias("j", "atom"))
    none = F.lit(None).cast("string")
    serial = (F.col("k") * 3 + F.col("j") + 1).cast("int")
    return rows.select("structure", F.lit("ATOM").alias("record"), serial.alias("serial"), "atom", none.alias("altloc"), name.alias("resname"), F.lit("A").alias("chain"), (F.col("k") + 1).alias("resseq"), none.alias("icode"), look((F.col("id") - 7.0625)).alias("x"), F.lit(-0.5).alias("y"), F.lit(1e4).alias("z"), F.lit(1.0).alias("occupancy"), F.lit(0.0).alias("bfactor"), none.alias("element"), serial.cast("long").alias("atom_ord"))


def test_bundles_hold_many_structures_a_file(spark, tmp_path):
    atoms = atoms_of(spark, 60)
    files.write_bundles(atoms, f"{tmp_path}/b")
    files.write_structures(atoms, f"{tmp_path}/s")
    made = [f for f in os.listdir(f"{tmp_path}/b") if f.startswith("part")]
    assert len(made) <= 4  # tasks, not structures
    one = files.read_atoms(spark, f"{tmp_path}/b", bundled=True).orderBy("structure", "atom_ord").collect()
    assert len(one) == 900 and one == files.read_atoms(spark, f"{tmp_path}/s", recursive=True).orderBy("structure", "atom_ord").collect()
    assert spark.read.text(f"{tmp_path}/b").where("value like 'TER %'").count() == 60


def test_number_fields_are_those_of_a_format(spark):
    values = [0.0, 1.0005, -7.0625, 123.4565, 99999.9999, 1e12, float("nan"), 2.675]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(files._fixed(F.col("v"), 8, 3).alias("a"), F.format_string("%8.3f", "v").alias("b")).collect()
    assert all(r.a.strip() == r.b.strip() for r in got)


def test_structures_without_a_motif_are_not_scanned_for_again(spark):
    look, seen = counted(spark)
    atoms = atoms_of(spark, 20).withColumn("resseq", look(F.col("resseq").cast("double")).cast("int"))
    cut, none = structures.loops(atoms, ["RG"])
    assert seen.value == 300 and none.count() == 0 and seen.value == 300
    assert cut.count() == 40  # two residues' CA of each


def test_requests_are_counted(spark):
    asked = spark.createDataFrame([("LONG_NAME_1", ["A", "B"]), ("OTHER", ["A"])], "accession string, chains array<string>")
    got = {(r.accession, r.chain): r.n_atoms for r in structures.requested_counts(atoms_of(spark, 3), asked).collect()}
    assert got == {("LONG_NAME_1", "A"): 15, ("LONG_NAME_1", "B"): 0, ("OTHER", "A"): 0}
