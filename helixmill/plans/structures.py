"""Queries over derived structures: residues, neighbours, contacts, interfaces, hydrogen bonds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.functions import lookups as L
from helixmill.functions.lookups import lookup
from helixmill.operators import residues as R
from helixmill.operators import spatial as S
from helixmill.plans.registry import long, query, rounded
from helixmill.sources import fixtures as X

C = ["structure_id", "chain_id"]


def _map(table: dict, key: str) -> str:
    return f"map({[*table]}, {[*table.values()]})[{key}]"


def _dist(a: str, b: str) -> str:
    return f"sqrt(({a}.x-{b}.x)*({a}.x-{b}.x)+({a}.y-{b}.y)*({a}.y-{b}.y)+({a}.z-{b}.z)*({a}.z-{b}.z))"


def _near(a: str, b: str, most: float) -> str:
    """A box test that lets DuckDB drop most pairs early."""
    return " AND ".join(f"abs({a}.{c}-{b}.{c}) <= {most}" for c in "xyz")


# --- residues -----------------------------------------------------------------------------------------------------
CLASSED = X.ATOMS + """,
classed AS (SELECT *, CASE WHEN res_index % 11 = 10 THEN 'HETATM' ELSE 'ATOM' END AS record, CASE WHEN res_index % 11 = 10 THEN CASE WHEN res_index % 2 = 0 THEN 'HOH' ELSE 'NAD' END WHEN res_index % 11 = 9 THEN 'G' ELSE res_type END AS rtype FROM atoms),
molecules AS (SELECT *, CASE WHEN record = 'HETATM' THEN CASE WHEN rtype IN ('WAT','HOH','H2O','IP3') THEN 'water' ELSE 'ligand' END WHEN rtype IN ('A','C','G','T','U') THEN 'nucleic' ELSE 'protein' END AS mol_class FROM classed)"""


def _molecules(spark, d) -> DataFrame:
    a = X.atoms(spark, d)
    hetero = F.col("res_index") % 11 == 10
    a = a.withColumn("record", F.when(hetero, "HETATM").otherwise("ATOM")).withColumn("res_type", F.when(hetero, F.when(F.col("res_index") % 2 == 0, "HOH").otherwise("NAD")).when(F.col("res_index") % 11 == 9, "G").otherwise(F.col("res_type")))
    return a.withColumn("mol_class", R.molecule_class(F.col("record"), F.col("res_type")))


@query("pf1_molecule_class", CLASSED, "SELECT structure_id, mol_class, count(*) AS n FROM molecules GROUP BY ALL")
def pf1(spark, d):
    return _molecules(spark, d).groupBy("structure_id", "mol_class").agg(F.count("*").alias("n"))


@query("pf2_small_molecules", CLASSED, """
SELECT structure_id, mol_class, molecule, count(*) AS n_atoms, min(res_number) AS res_number FROM (
  SELECT *, sum(ch) OVER (PARTITION BY structure_id, mol_class ORDER BY atom_number)::BIGINT AS molecule FROM (
    SELECT *, CASE WHEN res_number IS NOT DISTINCT FROM lag(res_number) OVER (PARTITION BY structure_id, mol_class ORDER BY atom_number) THEN 0 ELSE 1 END AS ch FROM molecules WHERE mol_class IN ('ligand','water')))
GROUP BY ALL""")
def pf2(spark, d):
    small = _molecules(spark, d).where("mol_class IN ('ligand', 'water')")
    return R.group_small_molecules(small).groupBy("structure_id", "mol_class", "molecule").agg(F.count("*").alias("n_atoms"), F.min("res_number").alias("res_number"))


@query("pf3_residue_assembly", X.ATOMS, f"""
SELECT structure_id, chain_id, (row_number() OVER (PARTITION BY structure_id, chain_id ORDER BY res_number) - 1) AS res_index, res_number, code, n_atoms FROM (
  SELECT structure_id, chain_id, res_number, code, count(*) AS n_atoms FROM atoms GROUP BY ALL) WHERE n_atoms >= {_map(L.LEAST_ATOMS, 'code')}""")
def pf3(spark, d):
    return R.assemble_residues(X.atoms(spark, d)).select(*C, "res_index", "res_number", "code", "n_atoms")


@query("pf4_code_and_mass", X.RESIDUES, f"SELECT structure_id, chain_id, res_index, res_type, code, {_map(L.RESIDUE_MASS, 'code')}::DOUBLE AS mass FROM residues")
def pf4(spark, d):
    return R.residue_codes(X.residues(spark, d).drop("code")).select(*R.RESIDUE, "res_type", "code", "mass")


@query("pf5_sequence", X.RESIDUES, "SELECT structure_id, chain_id, string_agg(code, '' ORDER BY res_index) AS seq FROM residues GROUP BY ALL")
def pf5(spark, d):
    return R.chain_sequences(X.residues(spark, d))


@query("pf6_central_atom", X.ATOMS, "SELECT structure_id, chain_id, res_index, max(CASE WHEN atom_type = 'CA' THEN atom_number END) AS atom_number, max(CASE WHEN atom_type = 'CA' THEN x END) AS x, max(CASE WHEN atom_type = 'CA' THEN y END) AS y, max(CASE WHEN atom_type = 'CA' THEN z END) AS z FROM atoms GROUP BY ALL")
def pf6(spark, d):
    return R.central_atoms(X.atoms(spark, d))


TERMINI = X.RESIDUES + """,
laps AS (SELECT *, lag(res_index) OVER w AS pi, lead(res_index) OVER w AS ni, lag(res_number) OVER w AS pn, lead(res_number) OVER w AS nn,
  sqrt((x-lag(x) OVER w)**2+(y-lag(y) OVER w)**2+(z-lag(z) OVER w)**2) AS pd, sqrt((x-lead(x) OVER w)**2+(y-lead(y) OVER w)**2+(z-lead(z) OVER w)**2) AS nd
  FROM residues WINDOW w AS (PARTITION BY structure_id, chain_id ORDER BY res_index)),
termini AS (SELECT * EXCLUDE (pi, ni, pn, nn, pd, nd), pi IS NULL OR (ni IS NOT NULL AND (pn <> res_number - 1 OR coalesce(pd > 30.0, true))) AS is_nterm, ni IS NULL OR (pi IS NOT NULL AND (nn <> res_number + 1 OR coalesce(nd > 30.0, true))) AS is_cterm FROM laps)"""


def _termini(spark, d) -> DataFrame:
    return R.termini(X.residues(spark, d), 30.0)  # derived chains are stretched; the default is 4.0


@query("pf7_termini", TERMINI, "SELECT structure_id, chain_id, res_index, is_nterm, is_cterm FROM termini")
def pf7(spark, d):
    return _termini(spark, d).select(*R.RESIDUE, "is_nterm", "is_cterm")


@query("pf8_renumber", CLASSED, """SELECT structure_id, atom_number, row_number() OVER (PARTITION BY structure_id ORDER BY CASE mol_class WHEN 'protein' THEN 0 WHEN 'nucleic' THEN 1 WHEN 'ligand' THEN 2 ELSE 3 END, chain_id, atom_number) AS new_number FROM molecules""")
def pf8(spark, d):
    return R.renumber(_molecules(spark, d)).select("structure_id", "atom_number", "new_number")


@query("pf9_bounds", CLASSED, """SELECT structure_id, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z, round(avg(x), 4) AS mid_x, round(avg(y), 4) AS mid_y, round(avg(z), 4) AS mid_z FROM molecules WHERE mol_class <> 'water' GROUP BY structure_id""")
def pf9(spark, d):
    return rounded(R.bounds(_molecules(spark, d).where("mol_class <> 'water'"), ["structure_id"]), "mid_x", "mid_y", "mid_z")


@query("pf10_b_factors", X.ATOMS, """SELECT structure_id, atom_number, round(CASE WHEN m = 0 THEN b_factor WHEN b_factor < m / 2 THEN 0 ELSE (b_factor - m / 2) / (m / 2) END, 4) AS b_scaled, round(ln(CASE WHEN b_factor = 0 THEN 0.01 ELSE b_factor END), 4) AS b_log
FROM (SELECT *, max(b_factor) OVER (PARTITION BY structure_id) AS m FROM atoms)""")
def pf10(spark, d):
    return rounded(R.normalize_b(X.atoms(spark, d)).select("structure_id", "atom_number", "b_scaled", "b_log"), "b_scaled", "b_log")


@query("pf11_radius", X.ATOMS, f"SELECT structure_id, atom_number, coalesce({_map(L.RADIUS, 'atom_type[1]')}, 1.7)::DOUBLE AS radius FROM atoms")
def pf11(spark, d):
    return X.atoms(spark, d).select("structure_id", "atom_number", L.atom_radius(F.col("atom_type")).alias("radius"))


SIDES = X.ATOMS + """,
sides AS (SELECT structure_id, chain_id, res_index, """ + ", ".join(f"coalesce(avg(CASE WHEN atom_type NOT IN ('N','O','CA') AND atom_type[1] <> 'H' THEN {c} END), max(CASE WHEN atom_type = 'CA' THEN {c} END)) AS s{c}" for c in "xyz") + " FROM atoms GROUP BY ALL)"


@query("pf12_side_chain", SIDES, "SELECT structure_id, chain_id, res_index, round(sx, 6) AS sx, round(sy, 6) AS sy, round(sz, 6) AS sz FROM sides")
def pf12(spark, d):
    return rounded(R.side_chain_means(X.atoms(spark, d)), "sx", "sy", "sz", digits=6)


def _pseudo_sql(quirk: bool) -> str:
    def mid(c):
        other = f"p{c} + (l1 / l2 * (n{c} - {c}) + {c}) / 2" if quirk else f"(p{c} + (l1 / l2 * (n{c} - {c}) + {c})) / 2"
        return f"CASE WHEN l1 < l2 THEN (l2 / l1 * (p{c} - {c}) + {c} + n{c}) / 2 ELSE {other} END AS m{c}"

    return f"""SELECT structure_id, chain_id, res_index, {', '.join(f'round(CASE WHEN is_nterm OR is_cterm THEN {c} ELSE (lm + 2) / lm * ({c} - m{c}) + m{c} END, 3) AS s{c}' for c in 'xyz')} FROM (
SELECT *, sqrt((x-mx)**2+(y-my)**2+(z-mz)**2) AS lm FROM (SELECT *, {', '.join(mid(c) for c in 'xyz')} FROM (
SELECT *, sqrt((x-px)**2+(y-py)**2+(z-pz)**2) AS l1, sqrt((x-nx)**2+(y-ny)**2+(z-nz)**2) AS l2 FROM (
SELECT *, {', '.join(f'lag({c}) OVER w AS p{c}, lead({c}) OVER w AS n{c}' for c in 'xyz')} FROM termini WINDOW w AS (PARTITION BY structure_id, chain_id ORDER BY res_index)))))"""


@query("pf13_pseudo_side_chain", TERMINI, _pseudo_sql(False))
def pf13(spark, d):
    return rounded(R.pseudo_side_chains(_termini(spark, d)).select(*R.RESIDUE, "sx", "sy", "sz"), "sx", "sy", "sz", digits=3)


@query("pf13q_pseudo_side_chain_quirk", TERMINI, _pseudo_sql(True))
def pf13q(spark, d):
    return rounded(R.pseudo_side_chains(_termini(spark, d), reference_quirk=True).select(*R.RESIDUE, "sx", "sy", "sz"), "sx", "sy", "sz", digits=3)


@query("pf14_residue_average", X.ATOMS, "SELECT structure_id, chain_id, res_index, round(CASE WHEN count(*) = count(f) THEN avg(f) END, 4) AS feature FROM (SELECT *, CASE WHEN atom_number % 37 <> 0 THEN b_factor END AS f FROM atoms) GROUP BY ALL")
def pf14(spark, d):
    return rounded(R.residue_average(X.atoms(spark, d).withColumn("feature", F.expr("if(atom_number % 37 <> 0, b_factor, null)")), "feature"), "feature")


@query("pf15_scaled_feature", X.ATOMS, """SELECT structure_id, chain_id, res_index, round(mean, 4) AS mean, round(CASE WHEN hi > lo THEN (mean - lo) / (hi - lo) ELSE 0 END, 4) AS scaled FROM (
SELECT *, min(mean) OVER w AS lo, max(mean) OVER w AS hi FROM (SELECT structure_id, chain_id, res_index, avg(b_factor) AS mean FROM atoms WHERE b_factor <> -1 GROUP BY ALL) WINDOW w AS (PARTITION BY structure_id, chain_id))""")
def pf15(spark, d):
    return rounded(R.scaled_feature(X.atoms(spark, d), "b_factor"), "mean", "scaled")


@query("pf16_polarity", X.RESIDUES, "SELECT structure_id, chain_id, res_index, CASE " + " ".join(f"WHEN contains('{v}', code) THEN '{k}'" for k, v in L.POLARITY.items()) + " END AS polarity FROM residues")
def pf16(spark, d):
    return X.residues(spark, d).select(*R.RESIDUE, L.polarity(F.col("code")).alias("polarity"))


@query("pf17_atom_class", X.ATOMS, f"""
, heavy AS (SELECT *, CASE WHEN atom_type IN ('N','CA','C','O') THEN 'backbone' WHEN atom_type IN ('CB','SD') THEN 'apolar' WHEN atom_type = 'CG' THEN CASE res_type WHEN 'ASP' THEN 'minus' WHEN 'ASN' THEN 'polar' ELSE 'apolar' END END AS class FROM atoms WHERE atom_type[1] <> 'H'),
owner AS (SELECT h.structure_id, h.atom_number, arg_min(o.class, {_dist('h', 'o')}) AS class FROM atoms h JOIN heavy o ON h.structure_id = o.structure_id AND h.chain_id = o.chain_id AND h.res_index = o.res_index WHERE h.atom_type[1] = 'H' GROUP BY ALL)
SELECT structure_id, atom_number, class FROM heavy UNION ALL SELECT structure_id, atom_number, class FROM owner""")
def pf17(spark, d):
    return R.atom_classes(X.atoms(spark, d))


@query("pf18_ss_records", X.RESIDUES + X.SECONDARY, """SELECT r.structure_id, r.chain_id, r.res_index, coalesce(arg_max(s.kind, s.line_no), 'C') AS ss FROM residues r LEFT JOIN ss_records s ON r.structure_id = s.structure_id AND r.chain_id = s.chain_id AND r.res_index >= s.first_res AND r.res_index < s.last_res GROUP BY ALL""")
def pf18(spark, d):
    return R.secondary_from_records(X.residues(spark, d), X.secondary_records(spark, d))


def _step(a: int, b: int) -> str:
    at = lambda c, k: f"lag({c}, {-k}) OVER w" if k < 0 else f"lead({c}, {k}) OVER w" if k else c
    return "sqrt(" + "+".join(f"({at(c, a)} - {at(c, b)})**2" for c in "xyz") + ")"


@query("pf19_ss_distances", TERMINI, f"""
, dd AS (SELECT *, {', '.join(f'{_step(a, b)} AS d{n}' for n, (a, b, _, _) in enumerate(L.IDEAL_DISTANCES))}, is_nterm OR is_cterm AS e FROM termini WINDOW w AS (PARTITION BY structure_id, chain_id ORDER BY res_index)),
s AS (SELECT *, sqrt(5 * ({'+'.join(f'(d{n}-{r[2]})**2' for n, r in enumerate(L.IDEAL_DISTANCES))})) AS h, sqrt(5 * ({'+'.join(f'(d{n}-{r[3]})**2' for n, r in enumerate(L.IDEAL_DISTANCES))})) AS b, e OR coalesce(lag(e) OVER w, true) OR coalesce(lead(e) OVER w, true) AS near FROM dd WINDOW w AS (PARTITION BY structure_id, chain_id ORDER BY res_index))
SELECT structure_id, chain_id, res_index, round(h, 3) AS helix, round(b, 3) AS strand, CASE WHEN near OR h IS NULL OR (h > 100.0 AND b > 100.0) THEN 'C' WHEN b < h THEN 'B' WHEN h < b THEN 'A' ELSE 'C' END AS ss FROM s""")
def pf19(spark, d):
    return rounded(R.secondary_from_distances(_termini(spark, d), 100.0).select(*R.RESIDUE, "helix", "strand", "ss"), "helix", "strand", digits=3)


@query("pf20_local_vector", X.RESIDUES, f"""SELECT structure_id, chain_id, res_index, CASE WHEN {' AND '.join(f'v{n} IS NOT NULL' for n in range(6))} THEN {' || chr(44) || '.join(f"round(v{n} * 1000)::BIGINT::VARCHAR" for n in range(6))} END AS local
FROM (SELECT *, {', '.join(f'{_step(a, b)} AS v{n}' for n, (a, b) in enumerate(((-2, 0), (-2, 1), (-2, 2), (-1, 1), (-1, 2), (0, 2))))} FROM residues WINDOW w AS (PARTITION BY structure_id, chain_id ORDER BY res_index))""")
def pf20(spark, d):
    v = R.local_vectors(X.residues(spark, d))
    text = F.array_join(F.transform("local", lambda x: F.round(x * 1000).cast("long").cast("string")), ",")
    return v.select(*R.RESIDUE, text.alias("local"))


@query("pf21_selection", X.ATOMS, "SELECT structure_id, atom_number, atom_type FROM atoms WHERE chain_id = 'A' AND res_index % 5 = 0 AND structure_id % 3 = 0")
def pf21(spark, d):
    a = X.atoms(spark, d)
    wanted = X.residues(spark, d).where("chain_id = 'A' AND res_index % 5 = 0 AND structure_id % 3 = 0").select(*R.RESIDUE)
    return R.select_atoms(a, wanted).select("structure_id", "atom_number", "atom_type")


@query("pf22_new_coordinates", X.ATOMS, """
, moved AS (SELECT structure_id, chain_id, res_number, res_type, atom_number, x + (atom_number % 3) AS x, y + 1 AS y, z AS z FROM atoms WHERE NOT (structure_id % 4 = 0 AND atom_number = 5)),
bad AS (SELECT DISTINCT structure_id FROM atoms WHERE structure_id % 4 = 0 AND atom_number = 5)
SELECT a.structure_id, a.atom_number, round(sqrt((a.x-m.x)**2+(a.y-m.y)**2+(a.z-m.z)**2), 4) AS shift FROM atoms a JOIN moved m USING (structure_id, atom_number) WHERE a.structure_id NOT IN (SELECT structure_id FROM bad)""")
def pf22(spark, d):
    a = X.atoms(spark, d)
    moved = a.where("NOT (structure_id % 4 = 0 AND atom_number = 5)").withColumn("x", F.expr("x + atom_number % 3")).withColumn("y", F.col("y") + 1)
    return rounded(R.move_atoms(a, moved).select("structure_id", "atom_number", "shift"), "shift")


LABELS = X.RESIDUES + ",\nlabels_ AS (SELECT *, (res_index // 9) % 4 AS label FROM residues)"


def _labels(spark, d) -> DataFrame:
    return X.residues(spark, d).withColumn("label", F.expr("(res_index div 9) % 4"))


@query("pf23_label_scaling", LABELS, "SELECT structure_id, chain_id, res_index, round(CASE WHEN label = 0 THEN -1 ELSE label::DOUBLE / max(label) OVER (PARTITION BY structure_id, chain_id) END, 4) AS scaled FROM labels_")
def pf23(spark, d):
    return rounded(R.scale_labels(_labels(spark, d)).select(*R.RESIDUE, "scaled"), "scaled")


@query("pf24_label_runs", LABELS, """SELECT structure_id, chain_id, label AS domain, min(res_number) AS first_res, max(res_number) AS last_res FROM (SELECT *, sum(ch) OVER (PARTITION BY structure_id, chain_id ORDER BY res_index) AS run FROM (
SELECT *, CASE WHEN label IS NOT DISTINCT FROM lag(label) OVER (PARTITION BY structure_id, chain_id ORDER BY res_index) THEN 0 ELSE 1 END AS ch FROM labels_)) WHERE label > 0 GROUP BY structure_id, chain_id, run, label""")
def pf24(spark, d):
    return R.label_runs(_labels(spark, d))


@query("pf25_range_labels", X.RESIDUES + X.SECONDARY, """SELECT r.structure_id, r.chain_id, r.res_index, coalesce(max(s.line_no) + 1, 0)::BIGINT AS label FROM residues r LEFT JOIN ss_records s ON r.structure_id = s.structure_id AND r.chain_id = s.chain_id AND r.res_index BETWEEN s.first_res AND s.last_res GROUP BY ALL""")
def pf25(spark, d):
    return R.label_ranges(X.residues(spark, d), X.secondary_records(spark, d).withColumnRenamed("line_no", "j"))


# --- space --------------------------------------------------------------------------------------------------------
@query("sj1_grid_hash", X.ATOMS, "SELECT structure_id, floor(x / 6.0)::INT AS cx, floor(y / 6.0)::INT AS cy, floor(z / 6.0)::INT AS cz, count(*) AS n FROM atoms GROUP BY ALL")
def sj1(spark, d):
    return S.cells(X.atoms(spark, d), 6.0).groupBy("structure_id", "cx", "cy", "cz").agg(F.count("*").alias("n"))


@query("sj2_neighbors_within", X.ATOMS, f"SELECT a.structure_id, a.atom_number AS center, b.atom_number AS other, round({_dist('a', 'b')}, 4) AS dist FROM atoms a JOIN atoms b ON a.structure_id = b.structure_id AND a.atom_number <> b.atom_number AND {_near('a', 'b', 8.0)} WHERE a.atom_type = 'CA' AND {_dist('a', 'b')} BETWEEN 3.0 AND 8.0")
def sj2(spark, d):
    p = X.atoms(spark, d).select("structure_id", F.col("atom_number").alias("id"), "x", "y", "z", "atom_type")
    out = S.join_within(p.where("atom_type = 'CA'"), p, 8.0, ["structure_id"], least=3.0).where("id_a <> id_b")
    return rounded(out.select("structure_id", F.col("id_a").alias("center"), F.col("id_b").alias("other"), "dist"), "dist")


OVER = X.ATOMS + f""",
over AS (SELECT a.structure_id, a.chain_id AS chain_a, b.chain_id AS chain_b, a.res_index AS res_a, b.res_index AS res_b, a.atom_number AS id_a, b.atom_number AS id_b, {_dist('a', 'b')} AS dist FROM atoms a JOIN atoms b ON a.structure_id = b.structure_id AND a.atom_number <> b.atom_number AND {_near('a', 'b', 8.8)}
  WHERE {_dist('a', 'b')} <= coalesce({_map(L.RADIUS, 'a.atom_type[1]')}, 1.7)::DOUBLE + coalesce({_map(L.RADIUS, 'b.atom_type[1]')}, 1.7)::DOUBLE + 2.8)"""


@query("sj3_overlaps", OVER, "SELECT structure_id, id_a, id_b, round(dist, 4) AS dist FROM over")
def sj3(spark, d):
    a = X.atoms(spark, d).select("structure_id", "atom_number", "atom_type", "x", "y", "z")
    return rounded(S.overlaps(a).select("structure_id", "id_a", "id_b", "dist"), "dist")


def _bond_sql() -> str:
    both = L.BOND | {k[::-1]: v for k, v in L.BOND.items()}
    limit = f"coalesce({_map(both, 'a.atom_type[1] || b.atom_type[1]')}, 1.8)::DOUBLE"
    return f"""SELECT a.structure_id, a.atom_number AS atom_a, b.atom_number AS atom_b, round((a.x+b.x)/2, 9) AS x, round((a.y+b.y)/2, 9) AS y, round((a.z+b.z)/2, 9) AS z FROM shrunk a JOIN shrunk b ON a.structure_id = b.structure_id AND a.chain_id = b.chain_id
  AND ((a.res_index = b.res_index AND a.atom_number < b.atom_number) OR (a.res_index = b.res_index - 1 AND a.atom_type = 'C' AND b.atom_type = 'N')) WHERE {_dist('a', 'b')} < {limit}"""


@query("sj4_bonds", X.ATOMS + ",\nshrunk AS (SELECT * REPLACE (x / 16 AS x, y / 16 AS y, z / 16 AS z) FROM atoms)", _bond_sql())
def sj4(spark, d):
    a = X.atoms(spark, d)
    return rounded(S.bonds(a.withColumns({c: F.col(c) / 16 for c in "xyz"})), "x", "y", "z", digits=9)


DENSITY_SQL = f"""
, n AS (SELECT a.structure_id, a.chain_id, a.atom_number, count(b.atom_number) AS n FROM atoms a LEFT JOIN atoms b ON a.structure_id = b.structure_id AND a.chain_id = b.chain_id AND a.atom_number <> b.atom_number AND {_near('a', 'b', 9.0)} AND {_dist('a', 'b')} < 9.0 GROUP BY ALL)
SELECT structure_id, atom_number, n, round(n::DOUBLE / max(n) OVER (PARTITION BY structure_id, chain_id), 4) AS density FROM n"""


@query("sj5_density", X.ATOMS, DENSITY_SQL)
def sj5(spark, d):
    return rounded(S.densities(X.atoms(spark, d)).select("structure_id", "atom_number", "n", "density"), "density")


@query("sj5s_density_smoothed", X.NEIGHBORS, """
, m AS (SELECT structure_id, chain_id, res_index, avg(b_factor) AS v FROM atoms GROUP BY ALL),
u AS (SELECT * FROM m UNION ALL SELECT e.structure_id, e.chain_id, e.i, m.v FROM neighbors e JOIN m ON m.structure_id = e.structure_id AND m.chain_id = e.chain_id AND m.res_index = e.j)
SELECT structure_id, chain_id, res_index, round(avg(v), 4) AS v FROM u GROUP BY ALL""")
def sj5s(spark, d):
    m = X.atoms(spark, d).groupBy(*R.RESIDUE).agg(F.avg("b_factor").alias("v"))
    return rounded(S.smooth_over_neighbors(m, X.neighbors(spark, d), "v"), "v")


def _foot_sql(px: str) -> str:
    dot = "+".join(f"(sb{c} - sa{c}) * ({px}{c} - sa{c})" for c in "xyz")
    length = "sqrt(" + "+".join(f"(sa{c} - sb{c})**2" for c in "xyz") + ")"
    foot = f"CASE WHEN {length} = 0 THEN 10.0 WHEN ({dot}) / {length} > {length} OR ({dot}) / {length} < 0 THEN -1.0 ELSE {length} - ({dot}) / {length} END"
    return f"(CASE WHEN ({foot}) < 0 THEN 1.0 ELSE 1 - exp(-(({foot})**2) / 4) END)"


CONTACTS = SIDES + """,
pts AS (SELECT s.*, a.x, a.y, a.z, a.code FROM sides s JOIN atoms a ON a.structure_id = s.structure_id AND a.chain_id = s.chain_id AND a.res_index = s.res_index AND a.atom_type = 'CA'),
pairs AS (SELECT a.structure_id, a.chain_id, a.res_index AS i, b.res_index AS j, a.x AS cax, a.y AS cay, a.z AS caz, b.x AS cbx, b.y AS cby, b.z AS cbz, a.sx AS sax, a.sy AS say, a.sz AS saz, b.sx AS sbx, b.sy AS sby, b.sz AS sbz,
  sqrt((a.sx-b.sx)*(a.sx-b.sx)+(a.sy-b.sy)*(a.sy-b.sy)+(a.sz-b.sz)*(a.sz-b.sz)) AS dist FROM pts a JOIN pts b ON a.structure_id = b.structure_id AND a.chain_id = b.chain_id AND a.res_index < b.res_index),
near AS (SELECT * FROM pairs WHERE dist <= 10.0 AND dist > 0),""" + f"""
more AS (SELECT structure_id, chain_id, i, j, CASE WHEN min(f) <= 0 THEN 0 ELSE exp(sum(ln(CASE WHEN f > 0 THEN f END))) END AS more FROM (
  SELECT p.structure_id, p.chain_id, p.i, p.j, {_foot_sql('ck')} * {_foot_sql('sk')} AS f FROM near p JOIN (SELECT structure_id AS s2, chain_id AS c2, i AS i2, j AS k, dist AS kd, cbx AS ckx, cby AS cky, cbz AS ckz, sbx AS skx, sby AS sky, sbz AS skz FROM near) q
  ON p.structure_id = s2 AND p.chain_id = c2 AND p.i = i2 AND (kd < dist OR (kd = dist AND k < j))) GROUP BY ALL),
contacts AS (SELECT n.structure_id, n.chain_id, n.i, n.j, n.dist, 20 * {_foot_sql('ca')} * {_foot_sql('cb')} * coalesce(more, 1) / (dist + 1) AS q FROM near n LEFT JOIN more USING (structure_id, chain_id, i, j)),
kept AS (SELECT structure_id, chain_id, i, j FROM contacts WHERE q > 0.35 AND dist < 10.0),
edges AS (SELECT structure_id, chain_id, i, j FROM kept UNION SELECT structure_id, chain_id, j, i FROM kept)"""


def _contacts(spark, d) -> DataFrame:
    r = X.residues(spark, d).join(R.side_chain_means(X.atoms(spark, d)), R.RESIDUE)
    return S.contact_scores(r)


@query("sj6_contact_scores", CONTACTS, "SELECT structure_id, chain_id, i, j, round(dist, 4) AS dist, round(q, 4) AS q FROM contacts")
def sj6(spark, d):
    return rounded(_contacts(spark, d), "dist", "q")


@query("sj7_neighbor_lists", CONTACTS, "SELECT structure_id, chain_id, i, j FROM edges")
def sj7(spark, d):
    return S.neighbor_edges(_contacts(spark, d))


@query("sj8_shielding", X.NEIGHBORS, """
, n AS (SELECT r.structure_id, r.chain_id, r.res_index, count(e.j) AS n FROM residues r LEFT JOIN neighbors e ON r.structure_id = e.structure_id AND r.chain_id = e.chain_id AND r.res_index = e.i GROUP BY ALL),
s AS (SELECT structure_id, chain_id, l[ceil(len(l) * 0.1::DOUBLE)::INT + 1] AS lo, l[floor(len(l) * 0.9::DOUBLE)::INT + 1] AS hi FROM (SELECT structure_id, chain_id, list(n ORDER BY n) AS l FROM n GROUP BY ALL)),
c AS (SELECT n.structure_id, n.chain_id, n.res_index, CASE WHEN hi > lo THEN (least(greatest(n.n, lo), hi) - lo)::DOUBLE / (hi - lo) ELSE 0 END AS v FROM n JOIN s ON n.structure_id = s.structure_id AND n.chain_id = s.chain_id),
u AS (SELECT * FROM c UNION ALL SELECT e.structure_id, e.chain_id, e.i, c.v FROM neighbors e JOIN c ON c.structure_id = e.structure_id AND c.chain_id = e.chain_id AND c.res_index = e.j)
SELECT structure_id, chain_id, res_index, round(avg(v), 4) AS shielding FROM u GROUP BY ALL""")
def sj8(spark, d):
    return rounded(S.shielding(X.residues(spark, d), X.neighbors(spark, d)), "shielding")


CORE_SQL = """
, dense AS (SELECT structure_id, chain_id, i FROM neighbors GROUP BY ALL HAVING count(*) >= 2),
core AS (SELECT d.* FROM dense d WHERE EXISTS (SELECT 1 FROM neighbors e JOIN dense o ON e.structure_id = o.structure_id AND e.chain_id = o.chain_id AND e.j = o.i WHERE e.structure_id = d.structure_id AND e.chain_id = d.chain_id AND e.i = d.i)),
num AS (SELECT c.structure_id, c.chain_id, r.res_number FROM core c JOIN residues r ON r.structure_id = c.structure_id AND r.chain_id = c.chain_id AND r.res_index = c.i)
SELECT r.structure_id, r.chain_id, r.res_index FROM residues r WHERE EXISTS (SELECT 1 FROM num n WHERE n.structure_id = r.structure_id AND n.chain_id = r.chain_id AND n.res_number = r.res_number)
  OR (EXISTS (SELECT 1 FROM num n WHERE n.structure_id = r.structure_id AND n.chain_id = r.chain_id AND n.res_number = r.res_number - 1) AND EXISTS (SELECT 1 FROM num n WHERE n.structure_id = r.structure_id AND n.chain_id = r.chain_id AND n.res_number = r.res_number + 1))"""


@query("sj9_core_residues", X.NEIGHBORS, CORE_SQL)
def sj9(spark, d):
    return S.core_residues(X.residues(spark, d), X.neighbors(spark, d), core_cutoff=2, neighbor_thresh=1)


LIGAND = X.ATOMS + ",\nlast_res AS (SELECT structure_id, max(res_index) AS last FROM atoms GROUP BY 1)"


@query("sj10_ligand_contact", LIGAND, f"""SELECT DISTINCT a.structure_id, a.chain_id, a.res_index FROM atoms a JOIN last_res USING (structure_id) JOIN atoms l ON l.structure_id = a.structure_id AND l.res_index = last AND {_near('a', 'l', 5.0)} WHERE a.res_index < last AND {_dist('a', 'l')} < 5.0""")
def sj10(spark, d):
    a = X.atoms(spark, d).withColumn("last", F.max("res_index").over(Window.partitionBy("structure_id")))
    return S.touching(a.where("res_index < last"), a.where("res_index = last"))


@query("sj13_differential", OVER + X.ACCESSIBILITY[len(X.RESIDUES):].replace("FROM residues", "FROM (SELECT * FROM atoms WHERE atom_type = 'CA')"), """
, best AS (SELECT structure_id, chain_a, res_a, arg_min(chain_b, dist * 1e6 + id_b * 1e-6) AS partner FROM over WHERE chain_a <> chain_b GROUP BY ALL)
SELECT a.structure_id, a.chain_id, a.res_index, round(asa - system_asa, 4) AS differential, partner FROM accessibility a LEFT JOIN best ON best.structure_id = a.structure_id AND chain_a = chain_id AND res_a = res_index WHERE asa - system_asa > 0.05""")
def sj13(spark, d):
    return rounded(S.interface_partners(X.accessibility(spark, d), X.atoms(spark, d)), "differential")


@query("sj14_interface_area", X.ACCESSIBILITY, "SELECT structure_id, chain_id, round(sum((asa - system_asa) * exposed_area), 3) AS area, count(*) AS n_residues FROM accessibility WHERE asa - system_asa > 0.05 GROUP BY ALL")
def sj14(spark, d):
    return rounded(S.interface_area(X.accessibility(spark, d)), "area", digits=3)


@query("sj16_hydrogen_owner", X.ATOMS, f"SELECT h.structure_id, h.atom_number, arg_min(o.atom_number, {_dist('h', 'o')}) AS owner, round(min({_dist('h', 'o')}), 4) AS dist FROM atoms h JOIN atoms o ON h.structure_id = o.structure_id AND h.chain_id = o.chain_id AND h.res_index = o.res_index WHERE h.atom_type = 'H' AND o.atom_type <> 'H' GROUP BY ALL")
def sj16(spark, d):
    return rounded(S.hydrogen_owners(X.atoms(spark, d)), "dist")


PROT = ", ".join(f"({n}, '{r[0]}', '{r[1]}')" for n, r in enumerate(L.HYDROGEN_RULES))


@query("sj17_protonation_sites", X.ATOMS, f"""
, rules(rule, aa, atom) AS (VALUES {PROT})
SELECT structure_id, chain_id, res_index, atom_number, atom_type, min(rule)::INT AS rule FROM atoms JOIN rules ON atom = atom_type AND (aa = res_type OR (atom_type = 'N' AND ((aa = 'N-TERMINUS' AND res_index = 0) OR (aa = 'BACKBONE' AND res_index <> 0 AND res_type <> 'PRO')))) GROUP BY ALL""")
def sj17(spark, d):
    return S.protonation_sites(X.atoms(spark, d), L.HYDROGEN_RULES)


DON = ", ".join(f"('{a}', '{b}')" for a, b in L.DONORS)
ACC = ", ".join(f"({n}, '{a}', '{b}', '{c}')" for n, (a, b, c) in enumerate(L.ACCEPTORS))
ROLES = X.ATOMS + f""",
dons(aa, atom) AS (VALUES {DON}), accs(rule, aa, atom, before) AS (VALUES {ACC}),
don AS (SELECT DISTINCT a.* FROM atoms a JOIN dons ON atom = atom_type AND (aa = res_type OR (aa = 'N-TERMINUS' AND res_index = 0))),
acc AS (SELECT a.*, b.atom_number AS antecedent, b.x AS ax, b.y AS ay, b.z AS az FROM (SELECT atoms.*, before FROM atoms JOIN accs ON atom = atom_type AND (aa = res_type OR aa = '*')) a JOIN atoms b ON a.structure_id = b.structure_id AND a.chain_id = b.chain_id AND a.res_index = b.res_index AND b.atom_type = a.before)"""


@query("sj19_donors_acceptors", ROLES, "SELECT structure_id, chain_id, res_index, 'donor' AS role, atom_number, NULL::BIGINT AS antecedent FROM don UNION ALL SELECT structure_id, chain_id, res_index, 'acceptor', atom_number, antecedent FROM acc")
def sj19(spark, d):
    return S.donors_and_acceptors(X.atoms(spark, d))


def _angle_sql(p: str, q: str, r: str) -> str:
    u = [f"({p}{c} - {q}{c})" for c in "xyz"]
    v = [f"({r}{c} - {q}{c})" for c in "xyz"]
    dot = "+".join(f"{a}*{b}" for a, b in zip(u, v))
    return f"degrees(acos(greatest(-1, least(1, ({dot}) / (sqrt({'+'.join(f'{a}*{a}' for a in u)}) * sqrt({'+'.join(f'{b}*{b}' for b in v)}))))))"


HB = ROLES + f""",
hyd AS (SELECT n.structure_id, n.atom_number AS donor, h.atom_number AS hydrogen, n.x AS dx, n.y AS dy, n.z AS dz, h.x AS hx, h.y AS hy, h.z AS hz FROM don n JOIN atoms h ON n.structure_id = h.structure_id AND n.chain_id = h.chain_id AND n.res_index = h.res_index AND h.atom_type = 'H' WHERE n.atom_type = 'N'),
cand AS (SELECT h.*, a.atom_number AS acceptor, a.x AS tx, a.y AS ty, a.z AS tz, ax, ay, az FROM hyd h JOIN acc a ON a.structure_id = h.structure_id AND a.atom_number <> donor AND abs(hx-a.x) <= 8 AND abs(hy-a.y) <= 8 AND abs(hz-a.z) <= 8),
meas AS (SELECT *, sqrt((hx-tx)*(hx-tx)+(hy-ty)*(hy-ty)+(hz-tz)*(hz-tz)) AS h_a, sqrt((dx-tx)**2+(dy-ty)**2+(dz-tz)**2) AS d_a, {_angle_sql('d', 'h', 't')} AS a1, {_angle_sql('d', 't', 'a')} AS a2, {_angle_sql('h', 't', 'a')} AS a3 FROM cand),
good AS (SELECT *, row_number() OVER (PARTITION BY structure_id, least(donor, acceptor), greatest(donor, acceptor) ORDER BY hydrogen, acceptor) AS n FROM meas WHERE h_a <= 8 AND h_a BETWEEN 1.0 AND 8.0 AND d_a BETWEEN 1.0 AND 40.0 AND a1 >= 60 AND a2 >= 60 AND a3 >= 60)"""


def _bonds(spark, d) -> DataFrame:
    """Derived atoms are far apart, so the query widens the ranges; the operator's defaults are the chemical ones."""
    a = X.atoms(spark, d)
    roles = S.donors_and_acceptors(a)
    at = a.select("structure_id", "chain_id", "res_index", "atom_number", "x", "y", "z", "atom_type")
    donors = roles.where("role = 'donor'").select("structure_id", "atom_number").join(at.where("atom_type = 'N'"), ["structure_id", "atom_number"]).select(*R.RESIDUE, F.col("atom_number").alias("donor"), *[F.col(c).alias(f"d{c}") for c in "xyz"])
    hyd = donors.join(at.where("atom_type = 'H'").select(*R.RESIDUE, F.col("atom_number").alias("hydrogen"), "x", "y", "z"), R.RESIDUE).select("structure_id", "donor", "hydrogen", "x", "y", "z", "dx", "dy", "dz")
    acc = roles.where("role = 'acceptor'").select("structure_id", "atom_number", "antecedent").join(at.select("structure_id", "atom_number", "x", "y", "z"), ["structure_id", "atom_number"])
    acc = acc.join(at.select("structure_id", F.col("atom_number").alias("antecedent"), *[F.col(c).alias(f"a{c}") for c in "xyz"]), ["structure_id", "antecedent"]).select("structure_id", F.col("atom_number").alias("acceptor"), "x", "y", "z", "ax", "ay", "az")
    return S.hydrogen_bonds(hyd, acc, reach=8.0, donor_range=(1.0, 40.0), hydrogen_range=(1.0, 8.0), least_angle=60.0)


@query("sj20_hydrogen_bonds", HB, "SELECT structure_id, donor, hydrogen, acceptor, round(d_a, 3) AS d_a, round(h_a, 3) AS h_a, round(a1, 3) AS angle_d_h_a, round(a2, 3) AS angle_d_a_aa, round(a3, 3) AS angle_h_a_aa FROM good WHERE n = 1")
def sj20(spark, d):
    return rounded(_bonds(spark, d).drop("strength"), "d_a", "h_a", "angle_d_h_a", "angle_d_a_aa", "angle_h_a_aa", digits=3)


@query("sj21_block_strength", HB, """SELECT structure_id, donor, acceptor, round((CASE WHEN abs(h_a - 1.85) > 0.85 THEN 0 WHEN abs(h_a - 1.85) > 0.25 THEN (0.85 - abs(h_a - 1.85)) / 0.85 ELSE 1 END) * (CASE WHEN abs(180 - a1) > 80 THEN 0 WHEN abs(180 - a1) > 30 THEN (80 - abs(180 - a1)) / 80 ELSE 1 END) * (CASE WHEN abs(180 - a3) > 80 THEN 0 ELSE 1 END), 4) AS strength FROM good WHERE n = 1""")
def sj21(spark, d):
    return rounded(_bonds(spark, d).select("structure_id", "donor", "acceptor", "strength"), "strength")


CAND = X.NEIGHBORS + ",\ncand AS (SELECT structure_id, chain_id, res_index FROM residues WHERE code IN ('D','E','H','K','R','S','C'))"


def _candidates(spark, d) -> DataFrame:
    return X.residues(spark, d).where(F.col("code").isin(*"DEHKRSC")).select(*R.RESIDUE)


@query("sj22_active_neighborhood", CAND, """
, inn AS (SELECT e.* FROM neighbors e JOIN cand a ON a.structure_id = e.structure_id AND a.chain_id = e.chain_id AND a.res_index = e.i JOIN cand b ON b.structure_id = e.structure_id AND b.chain_id = e.chain_id AND b.res_index = e.j),
n AS (SELECT structure_id, chain_id, i AS res_index, count(*) AS n, string_agg(j::VARCHAR, ',' ORDER BY j) AS members, row_number() OVER (PARTITION BY structure_id, chain_id ORDER BY count(*) DESC, i) AS k FROM inn GROUP BY structure_id, chain_id, i)
SELECT structure_id, chain_id, res_index, n, members FROM n WHERE k = 1""")
def sj22(spark, d):
    return S.densest_neighborhood(_candidates(spark, d), X.neighbors(spark, d))


@query("sj24_domain_core", X.NEIGHBORS, f"""
, n AS (SELECT structure_id, chain_id, i, count(*) AS n FROM neighbors GROUP BY ALL),
o AS (SELECT n.*, {_map(L.HYDROPHOBICITY, 'r.code')}::DOUBLE AS h FROM n JOIN residues r ON r.structure_id = n.structure_id AND r.chain_id = n.chain_id AND r.res_index = n.i),
s AS (SELECT e.structure_id, e.chain_id, e.i, a.n, avg((a.n + b.n)::DOUBLE / 2) AS c, avg((a.h + b.h) / 2) AS h FROM neighbors e JOIN o a ON a.structure_id = e.structure_id AND a.chain_id = e.chain_id AND a.i = e.i JOIN o b ON b.structure_id = e.structure_id AND b.chain_id = e.chain_id AND b.i = e.j GROUP BY ALL),
m AS (SELECT structure_id, chain_id, sum(c) AS cs, sum(h) AS hs FROM s GROUP BY ALL), z AS (SELECT structure_id, chain_id, count(*) AS size FROM residues GROUP BY ALL)
SELECT s.structure_id, s.chain_id, s.i AS res_index, s.n, round(s.c, 4) AS c_score, round(s.h, 4) AS h_score FROM s JOIN m ON m.structure_id = s.structure_id AND m.chain_id = s.chain_id JOIN z ON z.structure_id = s.structure_id AND z.chain_id = s.chain_id
WHERE s.n > 0.7 * cs / size AND s.h >= 0.5 * hs / size AND (s.i % 10) / 10.0::DOUBLE > 0.2""")
def sj24(spark, d):
    shield = X.residues(spark, d).select(*R.RESIDUE, F.expr("(res_index % 10) / 10D").alias("shielding"))
    return rounded(S.domain_candidates(X.residues(spark, d), X.neighbors(spark, d), shield, least_shield=0.2), "c_score", "h_score")
