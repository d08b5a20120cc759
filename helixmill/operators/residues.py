"""Projections, filters and per-residue features.  Keys: structure_id, chain_id, res_index (order in a chain), atom_number."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.functions.lookups import HETERO_WATERS, IDEAL_DISTANCES, LEAST_ATOMS, NUCLEOTIDES, RESIDUE_CODE, WATERS, lookup, residue_code, residue_mass

CHAIN = ["structure_id", "chain_id"]
RESIDUE = [*CHAIN, "res_index"]


def in_chain() -> Window:
    return Window.partitionBy(*CHAIN).orderBy("res_index")


def molecule_class(record: Column, res_type: Column) -> Column:
    """protein, nucleic, water or ligand, by record and residue type."""
    name = F.trim(res_type)
    hetero = F.when(name.isin(*HETERO_WATERS), "water").otherwise("ligand")
    plain = F.when(name.isin(*RESIDUE_CODE), "protein").when(name.isin(*NUCLEOTIDES), "nucleic").when(name.isin(*WATERS), "water").otherwise("ligand")
    return F.when(record == "HETATM", hetero).otherwise(plain)


def islands(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Adds a number to each run of rows with equal value, from 1, in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    change = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("_change", change).withColumn(name, F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_change")


def group_small_molecules(atoms: DataFrame) -> DataFrame:
    """Consecutive lines of one residue number are one ligand or water."""
    return islands(atoms, ["structure_id", "mol_class"], ["atom_number"], "res_number", "molecule")


def _residue_runs(atoms: DataFrame, least: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """Atoms with the number of their run, and the runs that are residues, numbered from 0 within a chain."""
    kept = islands(atoms.where("coalesce(altloc, '') NOT IN ('B', 'C', 'D')") if "altloc" in atoms.columns else atoms, CHAIN, ["atom_number"], "res_number", "run")
    counts = kept.groupBy(*CHAIN, "run").agg(F.count("*").alias("n_atoms"), F.min_by("res_number", "atom_number").alias("res_number"), F.min_by("res_type", "atom_number").alias("res_type"), F.min("atom_number").alias("first_atom"), F.max("atom_number").alias("last_atom"))
    counts = counts.withColumn("code", residue_code(F.col("res_type"))).where(F.col("n_atoms") >= lookup(least, F.col("code")))
    return kept, counts.withColumn("res_index", (F.row_number().over(Window.partitionBy(*CHAIN).orderBy("run")) - 1).cast("long"))


def assemble_residues(atoms: DataFrame, least: dict[str, int] = LEAST_ATOMS) -> DataFrame:
    """Consecutive atoms of one residue number form a residue; those with too few atoms go.  Adds res_index from 0."""
    return _residue_runs(atoms, least)[1].drop("run")


def numbered_atoms(atoms: DataFrame, least: dict[str, int] = LEAST_ATOMS) -> DataFrame:
    """The atoms of those residues, with their res_index and code."""
    kept, runs = _residue_runs(atoms, least)
    return kept.drop("res_index", "code").join(runs.select(*CHAIN, "run", "res_index", "code"), [*CHAIN, "run"]).drop("run")


def residue_codes(residues: DataFrame) -> DataFrame:
    return residues.withColumn("code", residue_code(F.col("res_type"))).withColumn("mass", residue_mass(F.col("code")))


def chain_sequences(residues: DataFrame) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("res_index", "code")))
    return residues.groupBy(*CHAIN).agg(F.array_join(F.transform(parts, lambda p: p["code"]), "").alias("seq"))


def central_atoms(atoms: DataFrame) -> DataFrame:
    """CA of protein residues; of nucleotides the last atom named C3..; null where a residue has none."""
    nucleic = F.col("mol_class") == "nucleic" if "mol_class" in atoms.columns else F.lit(False)
    central = F.when(nucleic, F.col("atom_type").startswith("C3")).otherwise(F.col("atom_type") == "CA")
    best = F.max_by(F.struct("atom_number", "x", "y", "z"), F.when(central, F.col("atom_number")))
    return atoms.groupBy(*RESIDUE).agg(F.max(F.when(central, 1)).alias("has"), best.alias("a")).select(*RESIDUE, *[F.when(F.col("has") == 1, F.col(f"a.{c}")).alias(c) for c in ("atom_number", "x", "y", "z")])


def _gap(offset: int) -> Column:
    return F.sqrt(sum((F.col(c) - F.lag(c, -offset).over(in_chain())) ** 2 for c in "xyz"))


def termini(residues: DataFrame, limit: float = 4.0) -> DataFrame:
    """Adds is_nterm and is_cterm: chain ends and breaks (numbers not consecutive, distance over limit, no central atom)."""
    w = in_chain()
    nxt = (F.lead("res_number").over(w) != F.col("res_number") + 1) | F.coalesce(_gap(1) > limit, F.lit(True))
    prv = (F.lag("res_number").over(w) != F.col("res_number") - 1) | F.coalesce(_gap(-1) > limit, F.lit(True))
    first, last = F.lag("res_index").over(w).isNull(), F.lead("res_index").over(w).isNull()
    return residues.withColumn("is_nterm", first | (~last & prv)).withColumn("is_cterm", last | (~first & nxt))


def renumber(atoms: DataFrame) -> DataFrame:
    """Atom numbers from 1: proteins, nucleic chains, ligands, waters."""
    rank = lookup({"protein": 0, "nucleic": 1, "ligand": 2, "water": 3}, F.col("mol_class"))
    return atoms.withColumn("new_number", F.row_number().over(Window.partitionBy("structure_id").orderBy(rank, "chain_id", "atom_number")).cast("long"))


def bounds(atoms: DataFrame, keys: list[str]) -> DataFrame:
    """Extent and centroid; leave waters out before asking for those of a system."""
    return atoms.groupBy(*keys).agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max), ("mid", F.avg))])


def normalize_b(atoms: DataFrame) -> DataFrame:
    """b_scaled: the upper half of a system's b-factors on 0 to 1; b_log: their logarithm, 0 taken as 0.01."""
    top = F.max("b_factor").over(Window.partitionBy("structure_id"))
    scaled = F.when(top == 0, F.col("b_factor")).when(F.col("b_factor") < top / 2, 0.0).otherwise((F.col("b_factor") - top / 2) / (top / 2))
    return atoms.withColumn("b_scaled", scaled).withColumn("b_log", F.log(F.when(F.col("b_factor") == 0, 0.01).otherwise(F.col("b_factor"))))


def side_chain_means(atoms: DataFrame) -> DataFrame:
    """Mean position of the atoms that are not N, O, CA or hydrogen; that of CA where there are none.

    Sums go by atom number: whether a foot lies on a segment's end (contact scores) may hang on their last bit.
    """
    side = ~F.col("atom_type").isin("N", "O", "CA") & ~F.col("atom_type").startswith("H")
    own = lambda c: F.array_sort(F.collect_list(F.when(side & F.col(c).isNotNull(), F.struct("atom_number", F.col(c).alias("v")))))
    mean = lambda c: F.aggregate(own(c), F.lit(0.0), lambda s, p: s + p["v"], lambda s: F.try_divide(s, F.size(own(c))))
    return atoms.groupBy(*RESIDUE).agg(*[F.coalesce(mean(c), F.max(F.when(F.col("atom_type") == "CA", F.col(c)))).alias(f"s{c}") for c in "xyz"])


def pseudo_side_chains(residues: DataFrame, reference_quirk: bool = False) -> DataFrame:
    """A point 2 beyond each alpha carbon, away from the middle of its neighbours put at equal distance.

    residues(x, y, z, is_nterm, is_cterm); ends use the alpha carbon itself.  With ``reference_quirk`` the middle is taken
    without brackets where the previous residue is not the nearer one.
    """
    w = in_chain()
    d = residues.withColumns({f"{n}{c}": F.lag(c, k).over(w) for n, k in (("p", 1), ("n", -1)) for c in "xyz"})
    d = d.withColumn("l1", F.sqrt(sum((F.col(c) - F.col(f"p{c}")) ** 2 for c in "xyz"))).withColumn("l2", F.sqrt(sum((F.col(c) - F.col(f"n{c}")) ** 2 for c in "xyz")))
    near = F.col("l1") < F.col("l2")

    def middle(c: str) -> Column:
        short = (F.col("l2") / F.col("l1") * (F.col(f"p{c}") - F.col(c)) + F.col(c) + F.col(f"n{c}")) / 2
        moved = F.col("l1") / F.col("l2") * (F.col(f"n{c}") - F.col(c)) + F.col(c)
        return F.when(near, short).otherwise(F.col(f"p{c}") + moved / 2 if reference_quirk else (F.col(f"p{c}") + moved) / 2)

    d = d.withColumns({f"m{c}": middle(c) for c in "xyz"}).withColumn("lm", F.sqrt(sum((F.col(c) - F.col(f"m{c}")) ** 2 for c in "xyz")))
    end = F.col("is_nterm") | F.col("is_cterm")
    out = {f"s{c}": F.when(end, F.col(c)).otherwise((F.col("lm") + 2) / F.col("lm") * (F.col(c) - F.col(f"m{c}")) + F.col(f"m{c}")) for c in "xyz"}
    return d.withColumns(out).drop("l1", "l2", "lm", *[f"{n}{c}" for n in "pnm" for c in "xyz"])


def residue_average(atoms: DataFrame, feature: str) -> DataFrame:
    """Mean of an atom feature over a residue, null where an atom lacks it."""
    return atoms.groupBy(*RESIDUE).agg(F.when(F.count("*") == F.count(feature), F.avg(feature)).alias(feature))


def scaled_feature(atoms: DataFrame, feature: str) -> DataFrame:
    """Residue means (-1 left out), min-max scaled over the chain."""
    means = atoms.where(F.col(feature) != -1).groupBy(*RESIDUE).agg(F.avg(feature).alias("mean"))
    w = Window.partitionBy(*CHAIN)
    low, high = F.min("mean").over(w), F.max("mean").over(w)
    return means.withColumn("scaled", F.when(high > low, (F.col("mean") - low) / (high - low)).otherwise(0.0))


#: Class, residue (* for any other) and its heavy atoms.
ATOM_CLASSES = """
backbone * C CA N O
apolar * CB SG SD CH CH1 CH2 CH3 CG CG1 CG2 CD CD1 CD2 CE CE1 CE2 CE3 CZ CZ1 CZ2 CZ3
polar * OG OG1 OG2 OH
plus * NZ NH1 NH2
plus ARG CD CD1 CD2 NE NE1 NE2 OE1 OE2 CZ CZ1 CZ2 CZ3
polar ASN CG CG1 CG2 OD1 OD2 ND1 ND2
minus ASP CG CG1 CG2 OD1 OD2 ND1 ND2
polar GLN CD CD1 CD2 OE1 OE2 NE NE1 NE2
minus GLU CD CD1 CD2 OE1 OE2 NE NE1 NE2
polar HIS OD1 OD2 ND1 ND2
plus HIS CD CD1 CD2 CE CE1 CE2 CE3 OE1 OE2 NE NE1 NE2
plus LYS CE CE1 CE2 CE3
polar TRP OE1 OE2 NE NE1 NE2
"""


def atom_class(atom: Column, res: Column) -> Column:
    """apolar, polar, minus, plus or backbone of a heavy atom; null where none is defined."""
    rows = [line.split() for line in ATOM_CLASSES.strip().splitlines()]
    known = F.create_map(*[F.lit(v) for kind, of, *atoms in rows for a in atoms for v in (f"{of} {a}", kind)])
    key = lambda of: F.concat_ws(" ", of, atom)
    return F.coalesce(F.try_element_at(known, key(res)), F.try_element_at(known, key(F.lit("*"))))


def atom_classes(atoms: DataFrame) -> DataFrame:
    """Class of every atom; hydrogens take that of the closest heavy atom of their residue."""
    from helixmill.operators.spatial import hydrogen_owners

    heavy = atoms.where(~F.col("atom_type").startswith("H")).withColumn("class", atom_class(F.col("atom_type"), F.col("res_type")))
    light = hydrogen_owners(atoms).join(heavy.select("structure_id", F.col("atom_number").alias("owner"), "class"), ["structure_id", "owner"])
    return heavy.select("structure_id", "atom_number", "class").unionByName(light.select("structure_id", "atom_number", "class"))


def secondary_from_records(residues: DataFrame, records: DataFrame, number: str = "res_index") -> DataFrame:
    """A (helix) or B (strand) where first_res <= number < last_res, the later record winning; else C.

    Records of files name residue numbers: pass the column that holds them.  Chains without any record get
    nothing of this, use ``secondary_structure`` for them.
    """
    r, s = residues.alias("r"), records.alias("s")
    hit = r.join(s, (F.col("r.structure_id") == F.col("s.structure_id")) & (F.col("r.chain_id") == F.col("s.chain_id")) & F.expr(f"r.{number} >= s.first_res AND r.{number} < s.last_res"), "left")
    return hit.groupBy("r.structure_id", "r.chain_id", "r.res_index").agg(F.coalesce(F.max_by("s.kind", "s.line_no"), F.lit("C")).alias("ss"))


def secondary_structure(residues: DataFrame, records: DataFrame, number: str = "res_number") -> DataFrame:
    """(structure_id, chain_id, res_index, ss): from the records of a structure, or from distances where it has none."""
    ids = records.select("structure_id").distinct()
    told = secondary_from_records(residues.join(ids, "structure_id", "left_semi"), records, number)
    return told.unionByName(secondary_from_distances(residues.join(ids, "structure_id", "left_anti")).select("structure_id", "chain_id", "res_index", "ss"))


def _between(a: int, b: int) -> Column:
    w = in_chain()
    at = lambda c, k: F.lag(c, -k).over(w) if k else F.col(c)
    return F.sqrt(sum((at(c, a) - at(c, b)) ** 2 for c in "xyz"))


def secondary_from_distances(residues: DataFrame, limit: float = 3.5) -> DataFrame:
    """A, B or C by distances of alpha carbons i-2..i+2 from the ideal ones; C near ends.  residues has is_nterm, is_cterm."""
    w = in_chain()
    d = residues.withColumns({f"d{n}": _between(a, b) for n, (a, b, _, _) in enumerate(IDEAL_DISTANCES)})
    for kind, at in (("helix", 2), ("strand", 3)):
        d = d.withColumn(kind, F.sqrt(5 * sum((F.col(f"d{n}") - row[at]) ** 2 for n, row in enumerate(IDEAL_DISTANCES))))
    end = F.col("is_nterm") | F.col("is_cterm")
    d = d.withColumn("end", end).withColumn("near", F.col("end") | F.coalesce(F.lag("end").over(w), F.lit(True)) | F.coalesce(F.lead("end").over(w), F.lit(True)))
    ss = F.when(F.col("near") | F.col("helix").isNull() | ((F.col("helix") > limit) & (F.col("strand") > limit)), "C").when(F.col("strand") < F.col("helix"), "B").when(F.col("helix") < F.col("strand"), "A").otherwise("C")
    return d.withColumn("ss", ss).drop("end", "near", *[f"d{n}" for n in range(6)])


def local_vectors(residues: DataFrame) -> DataFrame:
    """local: the six distances among alpha carbons i-2..i+2, null within two of an end."""
    pairs = ((-2, 0), (-2, 1), (-2, 2), (-1, 1), (-1, 2), (0, 2))
    d = residues.withColumns({f"v{n}": _between(a, b) for n, (a, b) in enumerate(pairs)})
    whole = F.expr(" AND ".join(f"v{n} IS NOT NULL" for n in range(6)))
    return d.withColumn("local", F.when(whole, F.array(*[f"v{n}" for n in range(6)]))).drop(*[f"v{n}" for n in range(6)])


def select_atoms(atoms: DataFrame, wanted: DataFrame) -> DataFrame:
    """Atoms that a selection table names; its columns may be any of the key columns."""
    return atoms.join(wanted, wanted.columns, "left_semi")


def move_atoms(atoms: DataFrame, moved: DataFrame) -> DataFrame:
    """Displacement of each atom of the structures whose atoms all correspond in residue type, number and chain."""
    keys = ["structure_id", "chain_id", "res_number", "res_type", "atom_number"]
    both = atoms.select(*keys, "x", "y", "z").join(moved.select(*keys, *[F.col(c).alias(f"n{c}") for c in "xyz"]), keys, "full_outer")
    good = both.groupBy("structure_id").agg(F.count("*").alias("n"), F.count(F.expr("x + nx")).alias("m")).where("n = m").select("structure_id")
    shift = F.sqrt(sum((F.col(c) - F.col(f"n{c}")) ** 2 for c in "xyz"))
    return both.join(good, "structure_id", "left_semi").select("structure_id", "atom_number", F.col("nx").alias("x"), F.col("ny").alias("y"), F.col("nz").alias("z"), shift.alias("shift"))


def scale_labels(labels: DataFrame) -> DataFrame:
    """Domain labels over the chain's largest, 0 becoming -1."""
    top = F.max("label").over(Window.partitionBy(*CHAIN))
    return labels.withColumn("scaled", F.when(F.col("label") == 0, -1.0).otherwise(F.col("label") / top))


def label_runs(labels: DataFrame) -> DataFrame:
    """(domain, first, last residue number) of each run of residues with one label over 0."""
    runs = islands(labels, CHAIN, ["res_index"], "label", "run").where("label > 0")
    return runs.groupBy(*CHAIN, "run", F.col("label").alias("domain")).agg(F.min("res_number").alias("first_res"), F.max("res_number").alias("last_res")).drop("run")


def label_ranges(residues: DataFrame, ranges: DataFrame) -> DataFrame:
    """Residues covered by range j (first_res..last_res, inclusive) get label j + 1; later ranges win; else 0."""
    r, g = residues.alias("r"), ranges.alias("g")
    hit = r.join(g, (F.col("r.structure_id") == F.col("g.structure_id")) & (F.col("r.chain_id") == F.col("g.chain_id")) & F.expr("r.res_index BETWEEN g.first_res AND g.last_res"), "left")
    return hit.groupBy("r.structure_id", "r.chain_id", "r.res_index").agg(F.coalesce(F.max("g.j") + 1, F.lit(0)).cast("long").alias("label"))


def tag_modifications(sequences: DataFrame, modifications: DataFrame) -> DataFrame:
    """(doc_id, reagent, pos, delta) of every residue that a reagent's target letters name."""
    cells = sequences.select("doc_id", F.posexplode(F.split("seq", "")).alias("pos", "code"))
    targets = modifications.select("reagent", "delta", F.explode(F.split("targets", "")).alias("code"))
    return cells.join(F.broadcast(targets), "code").select("doc_id", "reagent", F.col("pos").cast("long").alias("pos"), "code", "delta")  # targets: a row per letter of a reagent
