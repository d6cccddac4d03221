"""Property catalogues in text files, and outputs of external programs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .xyz import TOKENS, atoms, lines

#: Places of properties in the line of a QM9 file that starts with "gdb" (place 0 is the mark itself), and their units.
QM9 = {
    "Dipole moment": (5, "Debye"),
    "Isotropic polarizability": (6, "Bohr^3"),
    "HOMO eigenvalue": (7, "Hartree"),
    "LUMO eigenvalue": (8, "Hartree"),
    "HOMO-LUMO gap": (9, "Hartree"),
    "Electronic spacial extent": (10, "Bohr^2"),
    "Zero point vibrational energy": (11, "Hartree"),
    "Internal energy at 0 K": (12, "Hartree"),
    "Internal energy at 298.15 K": (13, "Hartree"),
    "Enthalpy at 298.15 K": (14, "Hartree"),
    "Free energy at 298.15 K": (15, "Hartree"),
    "Heat capacity at 298.15 K": (16, "cal/(mol K)"),
}
HIGHEST_FREQUENCY = "Highest vibrational frequency"
#: atoms' energies in hartree at the same level of theory, and valences that scale the atomization energy.
ATOM_ENERGIES = {"H": -0.500273, "C": -37.846772, "N": -54.583861, "O": -75.064579, "F": -99.718730}
VALENCE = {"H": 1, "C": 4, "N": 3, "O": 2, "F": 1}
#: Places in the comment line of an excitation file.
EXCITATIONS = {
    "ground_state_energy": 0,
    "S1_excitation": 1,
    "S1_oscillator_strength": 2,
    "S2_excitation": 3,
    "S2_oscillator_strength": 4,
    "S3_excitation": 5,
    "S3_oscillator_strength": 6,
}
#: Fixed value: the note of a solvation energy without an error of its own.
NO_ERROR = " Experimental uncertainty not presently available, so assigned a default value.  "


def _value(ls: Column, name: str) -> Column:
    if name == HIGHEST_FREQUENCY:
        numbers = lambda s: F.transform(F.split(F.trim(s), TOKENS), lambda t: t.try_cast("double"))
        rows = F.filter(F.transform(F.slice(ls, 2, 1_000_000), numbers), lambda v: (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull()))
        return F.array_max(F.get(rows, F.lit(0)))
    found = F.filter(F.transform(ls, lambda s: F.split(F.trim(s), TOKENS)), lambda t: t[0] == "gdb")
    return F.get(F.get(found, F.lit(0)), F.lit(QM9[name][0])).try_cast("double")


def _words(ls: Column) -> list[Column]:
    n = F.trim(ls[0]).try_cast("int")
    word = lambda k: F.get(F.split(F.trim(F.get(ls, n + k)), TOKENS), F.lit(0))
    return [word(3).alias("smiles"), word(4).alias("inchi")]


def qm9_property(files: DataFrame, name: str) -> DataFrame:
    """(name, value) from (name, body)."""
    return files.select("name", _value(lines(F.col("body")), name).alias("value"))


def identifiers(files: DataFrame) -> DataFrame:
    """(name, smiles, inchi): first words of the lines after the frequencies."""
    return files.select("name", *_words(lines(F.col("body"))))


def qm9_row(files: DataFrame, names: dict[str, str]) -> DataFrame:
    """(name, smiles, inchi) and properties under the columns of ``names`` (column -> property): a file is read once, without a join."""
    ls = lines(F.col("body"))
    return files.select("name", *_words(ls), *[_value(ls, n).alias(c) for c, n in names.items()])


def atomization(values: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, energy, normalised): value less atoms' energies, and that over the valence electrons, from (name, value) and atoms (name, symbol)."""
    energy = F.create_map(*[F.lit(x) for kv in ATOM_ENERGIES.items() for x in kv])
    valence = F.create_map(*[F.lit(x) for kv in VALENCE.items() for x in kv])
    sums = counts.groupBy("name").agg(F.sum(F.element_at(energy, F.col("symbol"))).alias("e"), F.sum(F.element_at(valence, F.col("symbol"))).alias("v"))
    out = values.join(sums, "name").withColumn("energy", F.col("value") - F.col("e"))
    return out.select("name", "energy", (F.col("energy") / F.col("v")).alias("normalised"))


def quantity_lines(values: DataFrame) -> DataFrame:
    """"name value" lines of a by-product file, and :func:`read_quantity_lines` back."""
    return values.select(F.concat_ws(" ", "name", F.col("value").cast("string")).alias("value"))


def read_quantity_lines(text: DataFrame) -> DataFrame:
    t = F.split(F.trim("value"), TOKENS)
    return text.select(t[0].alias("name"), t[1].try_cast("double").alias("value"))


def last_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key, the last one by ``order``."""
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_l")).select(key, "_l.*")


def solvation_rows(text: DataFrame, skip: int = 3) -> DataFrame:
    """(smiles, value, error) from texts (value): ``;``-separated lines after ``skip``; a noted default error is null; the last row of a SMILES wins."""
    rows = text.select(F.posexplode(lines(F.col("value"))).alias("n", "line")).filter((F.col("n") >= skip) & (F.trim("line") != ""))
    t = F.split("line", ";")
    error = F.when(F.element_at(t, -1) == NO_ERROR, None).otherwise(F.trim(F.get(t, F.lit(4))).try_cast("double"))
    out = rows.select("n", F.expr("substring(get(split(line, ';'), 1), 2)").alias("smiles"), F.trim(F.get(t, F.lit(3))).try_cast("double").alias("value"), error.alias("error"))
    return last_by_key(out, "smiles", "n").select("smiles", "value", "error")


def free_solvation(spark: SparkSession, path: str, skip: int = 3) -> DataFrame:
    """The same from a file."""
    return solvation_rows(spark.read.text(path, wholetext=True), skip)


def mean_and_error(values: Column) -> tuple[Column, Column]:
    """Mean of an array, and its standard error (null for one value)."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / n
    square = F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean))
    return mean, F.when(n > 1, F.sqrt(square / (n - 1)) / F.sqrt(n.cast("double")))


def oxidation_potentials(df: DataFrame, key: str, values: str) -> DataFrame:
    """(key, mean, sem) from a column that holds a list in brackets."""
    mean, sem = mean_and_error(F.from_json(F.col(values), "array<double>"))
    return df.select(key, mean.alias("mean"), sem.alias("sem"))


def comment_columns(files: DataFrame, places: dict[str, int]) -> DataFrame:
    """Numbers by place in an XYZ file's comment line; null where the line is short."""
    t = F.split(F.trim(F.get(lines(F.col("body")), F.lit(1))), TOKENS)
    return files.select("name", *[F.get(t, F.lit(p)).try_cast("double").alias(n) for n, p in places.items()])


def total_energy(text: Column) -> Column:
    """The total energy in a tight-binding program's summary."""
    return F.regexp_extract(text, r"(?m)^\s*::\s+total\s+energy\s+(\S+)\s+\S+\s+::", 1).try_cast("double")


def output_matrices(files: DataFrame) -> DataFrame:
    """(name, matrix, row, values) from "# MATRIX <name> ..." blocks of numbers; each line of numbers goes on until the next mark."""
    parts = files.select("name", F.posexplode(F.split("body", r"(?m)^\s*#\s*MATRIX\s+")).alias("n", "part")).filter("n > 0")
    head = F.regexp_extract("part", r"^(\S+)", 1)
    body = F.regexp_extract("part", r"(?s)^[^\n]*\n(.*?)(?=\n\s*#|$)", 1)
    flat = F.transform(F.filter(F.split(body, r"[\s,]+"), lambda t: t != ""), lambda t: t.try_cast("double"))
    rows = parts.select("name", head.alias("matrix"), flat.alias("flat")).withColumn("dim", F.sqrt(F.size("flat").cast("double")).cast("int"))
    return rows.select("name", "matrix", "dim", "flat", F.explode(F.sequence(F.lit(0), F.col("dim") - 1)).alias("row")).select(
        "name", "matrix", "row", F.slice("flat", F.col("row") * F.col("dim") + 1, F.col("dim")).alias("values")
    )


def program_outputs(files: DataFrame, optimised: bool = False, restricted: bool = True) -> DataFrame:
    """(name, orbitals, occupied, energy) from texts (name, body) of an electronic-structure program.

    One scan over a text's lines carries a state, since the same words mean other things in other sections: orbitals (atom from 0, label) are rows of symmetry A between BASIS DATA and NUCLEAR CHARGE:;
    occupancies (one, or alpha and beta) count outside of it and, with ``optimised``, only after the geometry's optimisation has ended; the first line of five words with Energy as the fourth ends the scan.
    Orbital rows whose atom is no number are left out.  What a text does not have is an empty list or null.
    """
    zero = "named_struct('basis', false, 'final', %s, 'over', false, 'orbitals', cast(array() as array<struct<atom:int,label:string>>), 'occupied', cast(array() as array<int>), 'energy', cast(null as double))"
    word = lambda t, i: F.get(t, F.lit(i))

    def starts(t: Column, *words: str) -> Column:
        out = F.lit(True)
        for i, w in enumerate(words):
            out = out & F.coalesce(word(t, i) == w, F.lit(False))
        return out

    def step(s: Column, line: Column) -> Column:
        t = F.split(F.trim(line), TOKENS)
        begins, ends = starts(t, "BASIS", "DATA"), starts(t, "NUCLEAR", "CHARGE:")
        inside, outside = ~s["over"] & s["basis"] & ~begins, ~s["over"] & ~s["basis"] & ~begins
        atom = word(t, 2).try_cast("int")
        row = inside & F.coalesce(word(t, 1) == "A", F.lit(False)) & atom.isNotNull()
        orbital = F.array(F.struct((atom - 1).alias("atom"), word(t, 3).alias("label")))
        final = s["final"] | (outside & starts(t, "END", "OF", "GEOMETRY", "OPTIMIZATION."))
        read = outside & final
        if restricted:
            occupied = F.when(read & starts(t, "Final", "occupancy:"), F.array(word(t, 2).try_cast("int"))).otherwise(s["occupied"])
        else:
            n = F.array(word(t, 3).try_cast("int"))
            occupied = F.when(read & starts(t, "Final", "alpha", "occupancy:"), n).when(read & starts(t, "Final", "beta", "occupancy:"), F.concat(s["occupied"], n)).otherwise(s["occupied"])
        energy = read & (F.size(t) == 5) & F.coalesce(word(t, 3) == "Energy", F.lit(False))
        return F.struct(
            F.when(begins, True).when(ends, False).otherwise(s["basis"]).alias("basis"), final.alias("final"), (s["over"] | energy).alias("over"),
            F.when(row, F.concat(s["orbitals"], orbital)).otherwise(s["orbitals"]).alias("orbitals"), occupied.alias("occupied"), F.when(energy, word(t, 4).try_cast("double")).otherwise(s["energy"]).alias("energy"),
        )

    state = F.aggregate(lines(F.col("body")), F.expr(zero % ("false" if optimised else "true")), step)
    return files.select("name", state.alias("s")).select("name", F.col("s.orbitals").alias("orbitals"), F.col("s.occupied").alias("occupied"), F.col("s.energy").alias("energy"))


def without_sections(body: Column, names: list[str]) -> Column:
    """A molden-like text without the sections ``[name]``."""
    for n in names:
        body = F.regexp_replace(body, rf"(?sm)^\[{n}\].*?(?=^\[|\z)", "")
    return body


def molecule_counts(files: DataFrame) -> DataFrame:
    return atoms(files).select("name", "symbol")
