import numpy as np
from pyspark.sql import functions as F

from larkspur.operators.features import Signs
from larkspur.operators.models import FeatureRidge
from larkspur.sources import catalogues, store, xyz
from larkspur.streaming import incremental

WATER = "3\ngdb 1 157 285 127 1.85 6.31 -0.29 0.06 0.36 19.0 0.02 -76.404702 -76.4 -76.4 -76.4 6.0\no -0.03 0.97 0.007 -0.58\nH 0.01 2.0*^-2 1e-3 0.29 extra\nH 0.87 1.3 0.0 0.29\n1671.4 3803.6 3907.6\nO O\nInChI=1S/H2O/h1H2 x\n"
ION = "1\ncharge=-1 note\nCl 0 0 0\n"


def files(spark):
    return spark.createDataFrame([("water", WATER), ("ion", ION)], "name string, body string")


def test_xyz(spark, tmp_path):
    df = files(spark)
    assert {r["name"]: (r["natoms"], r["charge"]) for r in xyz.molecules(df).collect()} == {"water": (3, 0), "ion": (1, -1)}
    rows = xyz.atoms(df).orderBy("name", "atom").collect()
    assert [(r["symbol"], r["z"], r["x"]) for r in rows] == [("Cl", 17, 0.0), ("O", 8, -0.03), ("H", 1, 0.01), ("H", 1, 0.87)]
    assert rows[2]["y"] == 0.02 and rows[2]["c"] == 0.001
    assert {r["name"]: r["counts"] for r in xyz.stoichiometry(xyz.atoms(df)).collect()} == {"water": {"H": 2, "O": 1}, "ion": {"Cl": 1}}
    again = xyz.atoms(xyz.xyz_text(xyz.atoms(df))).orderBy("name", "atom").collect()
    assert [tuple(r) for r in again] == [tuple(r) for r in rows]
    for n, b in (("water", WATER), ("ion", ION)):
        (tmp_path / f"{n}.xyz").write_text(b)
    assert xyz.read_xyz(spark, f"{tmp_path}/*.xyz").select("name").orderBy("name").collect()[0][0] == "ion.xyz"
    xyz.write_xyz(xyz.atoms(df), f"{tmp_path}/out")
    assert spark.read.text(f"{tmp_path}/out", wholetext=True).count() == 2


def test_catalogues(spark, tmp_path):
    df = files(spark).filter("name = 'water'")
    value = lambda name: catalogues.qm9_property(df, name).first()["value"]
    assert value("Dipole moment") == 1.85 and value("Internal energy at 0 K") == -76.404702 and value(catalogues.HIGHEST_FREQUENCY) == 3907.6
    assert tuple(catalogues.identifiers(df).first()) == ("water", "O", "InChI=1S/H2O/h1H2")
    e = catalogues.atomization(catalogues.qm9_property(df, "Internal energy at 0 K"), catalogues.molecule_counts(df)).first()
    want = -76.404702 + 75.064579 + 2 * 0.500273
    assert abs(e["energy"] - want) < 1e-9 and abs(e["normalised"] - want / 4) < 1e-9
    lines = ["# a", "# b", "# c", "m1; C; methane; 2.0; 0.6; x", f"m2; CC; ethane; 1.8; 0.6;{catalogues.NO_ERROR}", "m3; C; again; 2.1; 0.2; y"]
    (tmp_path / "free.txt").write_text("\n".join(lines) + "\n")
    got = {r["smiles"]: (r["value"], r["error"]) for r in catalogues.free_solvation(spark, f"{tmp_path}/free.txt").collect()}
    assert got == {"C": (2.1, 0.2), "CC": (1.8, None)}
    ox = spark.createDataFrame([("a", "[1.0, 2.0, 4.0]"), ("b", "[3.5]")], "s string, v string")
    rows = {r["s"]: r for r in catalogues.oxidation_potentials(ox, "s", "v").collect()}
    assert np.isclose(rows["a"]["sem"], np.std([1, 2, 4], ddof=1) / np.sqrt(3)) and rows["b"]["sem"] is None and rows["b"]["mean"] == 3.5
    uv = spark.createDataFrame([("m", "1\n-1.5 0.2\nH 0 0 0\n")], "name string, body string")
    assert tuple(catalogues.comment_columns(uv, catalogues.EXCITATIONS).first())[:4] == ("m", -1.5, 0.2, None)
    out = spark.createDataFrame([("x", "head\n # MATRIX S\n1, 2\n 3 4\n# MATRIX C\n5\n# end")], "name string, body string")
    got = {(r["matrix"], r["row"]): r["values"] for r in catalogues.output_matrices(out).collect()}
    assert got == {("S", 0): [1.0, 2.0], ("S", 1): [3.0, 4.0], ("C", 0): [5.0]}
    t = spark.createDataFrame([("a\n :: total energy   -5.07 Eh    ::\n", "[Title]\nx\n[Atoms]\ny\n")], "e string, m string")
    assert tuple(t.select(catalogues.total_energy(F.col("e")), catalogues.without_sections(F.col("m"), ["Title"])).first()) == (-5.07, "[Atoms]\ny\n")
    q = catalogues.read_quantity_lines(catalogues.quantity_lines(spark.createDataFrame([("a", 1.5)], "name string, value double")))
    assert tuple(q.first()) == ("a", 1.5)


def test_store(spark, tmp_path):
    wanted = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "m string, o int")
    store.save_table(spark.createDataFrame([("a", 1, 0.5)], "m string, o int, e double"), f"{tmp_path}/c")
    cache = store.load_table(spark, f"{tmp_path}/c")
    assert store.missing(wanted, cache, ["m", "o"]).count() == 2
    assert sorted(r["cached"] for r in store.with_cache(wanted, cache, ["m", "o"]).collect()) == [False, False, True]


def test_incremental_stream(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.random((50, 4))
    rows = [(i, x[i].tolist(), float(x[i].sum())) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, x array<double>, y double")
    for k in range(3):
        df.filter(F.col("id") % 3 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    model = FeatureRidge(Signs.seeded(2, 2, 4, 1), 1.0, 1e-6)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    incremental.add_batches(stream, model, f"{tmp_path}/state", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/state").select("batch").distinct().count() == 3
    got = incremental.finished(spark, model, f"{tmp_path}/state")
    want = FeatureRidge(model.params, 1.0, 1e-6).fit(df)
    assert np.allclose(got.alphas, want.alphas) and got.n == 50


def test_stream_errors(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 2, float(i)) for i in range(10)], "id long, k long, e double").withColumn("ts", F.timestamp_seconds(F.col("id") * 40_000))
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = incremental.running_errors(stream, "k", "e").writeStream.outputMode("complete").format("memory").queryName("running").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["k"]: (r["n"], r["mae"]) for r in spark.table("running").collect()} == {0: (5, 4.0), 1: (5, 5.0)}
    q = incremental.windowed_errors(stream, "ts", "e").writeStream.outputMode("update").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windows").groupBy().sum("n").first()[0] == 10


def _events(spark, folder, rows):
    spark.createDataFrame(rows, "u long, x array<double>, y double, ts timestamp").coalesce(1).write.mode("append").parquet(folder)


def test_models_by_key_go_on_after_a_restart(spark, tmp_path):
    """Two runs of one stream give the models of all rows; null labels and features are left out."""
    import datetime

    import numpy as np
    from pyspark.sql import functions as F

    from larkspur.streaming import incremental

    rng = np.random.default_rng(1)
    day = datetime.datetime(2024, 1, 1)
    rows = [(int(rng.integers(4)), rng.normal(size=3).tolist(), float(rng.normal()), day) for _ in range(60)]
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in (rows[:25] + [(0, None, 1.0, day), (1, [1.0, None, 2.0], 1.0, day), (2, [1.0, 1.0, 1.0], None, day)], rows[25:]):
        _events(spark, src, part)
        stream = spark.readStream.schema("u long, x array<double>, y double, ts timestamp").parquet(src)
        incremental.keep_latest(incremental.models_by_key(stream, "u", F.col("x"), F.col("y"), 0.5), out, state).awaitTermination()
    got = {r["key"]: r for r in incremental.latest(spark, out).collect()}
    for u in range(4):
        x, y = np.array([r[1] for r in rows if r[0] == u]), np.array([r[2] for r in rows if r[0] == u])
        assert got[u]["n"] == len(y) and np.allclose(got[u]["alphas"], np.linalg.solve(x.T @ x + 0.5 * np.eye(3), x.T @ y))


def test_states_of_silent_keys_go(spark, tmp_path):
    """A key whose last row lies further back than its time to live starts anew; rows behind the watermark are dropped."""
    import datetime

    from pyspark.sql import functions as F

    from larkspur.streaming import incremental

    at = lambda d: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d)
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in ([(1, [1.0], 2.0, at(0)), (2, [1.0], 1.0, at(0))], [(2, [1.0], 1.0, at(30))], [(2, [1.0], 1.0, at(31)), (2, [1.0], 50.0, at(3))], [(1, [1.0], 4.0, at(32))]):
        _events(spark, src, part)
        stream = spark.readStream.schema("u long, x array<double>, y double, ts timestamp").parquet(src)
        models = incremental.models_by_key(stream, "u", F.col("x"), F.col("y"), 1.0, "ts", "2 days", ttl_ms=5 * 24 * 3600 * 1000)
        incremental.keep_latest(models, out, state).awaitTermination()
    got = {r["key"]: (r["n"], r["alphas"][0]) for r in incremental.latest(spark, out).collect()}
    assert got[1] == (1, 2.0) and got[2][0] in (2, 3) and got[2][1] < 1.0


def test_program_outputs_without_their_parts(spark):
    from larkspur.sources import catalogues

    files = spark.createDataFrame([("a", ""), ("b", None), ("c", "BASIS DATA\n 1 A 2 1s x\nNUCLEAR CHARGE: 1\n Final occupancy:  5\n STATE of 1.1 Energy -2.5\n Final occupancy: 6"), ("d", "BASIS DATA\n 1 A 1 2p")], "name string, body string")
    got = {r["name"]: r for r in catalogues.program_outputs(files).collect()}
    assert got["c"]["energy"] == -2.5 and got["c"]["occupied"] == [5] and [tuple(o) for o in got["c"]["orbitals"]] == [(1, "1s")]
    assert got["a"]["energy"] is None and got["a"]["occupied"] == [] and [tuple(o) for o in got["d"]["orbitals"]] == [(0, "2p")]
