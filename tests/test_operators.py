"""Golden cases and properties of the operators that SQL cannot say."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixmill.functions.lookups import HYDROGEN_RULES, HYDROPHOBICITY
from helixmill.operators import align, classify, residues, sequences, spatial, spectra, surface
from helixmill.sources import files


def test_grid_join_is_brute_force(spark):
    random.seed(3)
    pts = [(1, i, random.uniform(-9, 9), random.uniform(-9, 9), random.uniform(-9, 9)) for i in range(60)]
    df = spark.createDataFrame(pts, "structure_id long, id long, x double, y double, z double")
    got = {(r.id_a, r.id_b) for r in spatial.pairs_within(df, 4.0, ["structure_id"]).collect()}
    want = {(a[1], b[1]) for a in pts for b in pts if a[1] != b[1] and math.dist(a[2:], b[2:]) <= 4.0}
    assert got == want and got == {(b, a) for a, b in got}


def test_peaks_of_a_saw():
    x = np.arange(1001.0, 1013.0)
    y = np.array([0, 2, 5, 9, 6, 3, 1, 4, 8, 7, 2, 0], float)
    peaks, troughs = spectra.find_peaks(x, y, min_x=1000.0, min_height=0.5)
    assert peaks == [3, 8] and troughs == [0, 6]
    assert spectra.bracket(x, y, peaks, troughs)[0][0] <= 3 <= spectra.bracket(x, y, peaks, troughs)[0][1]
    for style in ("slope", "minrange"):
        a, b, c = spectra.bounds_of(x, y, 3, peaks, troughs, style)
        assert a < b == 3 < c


def scalar_align(s, gap=0.2, extend=0.05):
    n, m = s.shape
    t, back = np.zeros((n + 1, m + 1)), {}
    for i in range(1, n + 1):
        last = ""
        for j in range(1, m + 1):
            d, u, r = t[i - 1, j - 1] + s[i - 1, j - 1], t[i - 1, j] - (extend if last == "u" else gap), t[i, j - 1] - (extend if last == "r" else gap)
            t[i, j] = max(d, u, r)
            back[i, j] = "d" if t[i, j] == d else "u" if t[i, j] == u else "r"
            last = "" if back[i, j] == "d" else back[i, j]
    i, j, out = n, m, []
    while i and j:
        b = back[i, j]
        i, j = i - (b != "r"), j - (b != "u")
        out.append((i if b != "r" else -1, j if b != "u" else -1))
    return ([(-1, k) for k in range(j)] + [(k, -1) for k in range(i)] + out[::-1]) if out else []


def test_alignment_together_is_alignment_alone():
    rng = np.random.default_rng(5)
    mats = [rng.random((rng.integers(1, 9), rng.integers(1, 9))) for _ in range(20)]
    together = align.align_many(mats)
    for s, path in zip(mats, together):
        assert path == align.align_many([s])[0]
        assert [p for p in path if min(p) >= 0] == [p for p in scalar_align(s) if min(p) >= 0]
        assert [a for a, _ in path if a >= 0] == list(range(s.shape[0])) and [b for _, b in path if b >= 0] == list(range(s.shape[1]))


def test_identity(spark):
    df = spark.createDataFrame([(1, 2, "ACDEFG", "ACDEFG"), (1, 3, "ACDEFG", "ACDFG"), (1, 4, "A", "")], "id_a long, id_b long, seq_a string, seq_b string").where("length(seq_b) > 0")
    rows = {r.id_b: r for r in align.percent_identity(df, align.SequenceScore()).collect()}
    assert rows[2].identity == 1.0 and rows[3].n_same == 5 and rows[3].n_columns == 6


def test_best_fit_is_a_rotation(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(12, 3))
    c, s = math.cos(0.7), math.sin(0.7)
    r = np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]])
    b = (a - [1, 2, 3]) @ r  # a = r b + t
    df = spark.createDataFrame([(7, *map(float, p), *map(float, q)) for p, q in zip(a, b)], "k long, ax double, ay double, az double, bx double, by double, bz double")
    fit = align.best_fits(df, ["k"]).first()
    got = np.array([[fit[f"r{i}{j}"] for j in (1, 2, 3)] for i in (1, 2, 3)])
    assert np.allclose(got, r) and np.isclose(np.linalg.det(got), 1) and np.allclose([fit.tx, fit.ty, fit.tz], [1, 2, 3])
    moved = align.apply_fit(df, align.best_fits(df, ["k"]), ["k"])
    assert align.fit_spread(moved, ["k"]).first().rmsd < 1e-9
    assert align.staged_superposition(df, ["k"]).count() == 12


def test_accessible_points(spark):
    rows = [(1, "A", 0, 1, "CA", 0.0, 0.0, 0.0), (1, "B", 0, 2, "CA", 40.0, 0.0, 0.0), (2, "A", 0, 1, "CA", 0.0, 0.0, 0.0), (2, "B", 0, 2, "CA", 3.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "structure_id long, chain_id string, res_index long, atom_number long, atom_type string, x double, y double, z double")
    got = {(r.structure_id, r.chain_id): r for r in surface.accessibility(surface.sphere_points(df, n_points=400)).collect()}
    assert got[1, "A"].asa == got[1, "A"].system_asa == 1.0
    assert got[2, "A"].asa == 1.0 and 0.5 < got[2, "A"].system_asa < 0.9
    area = {r.structure_id: r.exposed_area for r in surface.exposed_area(surface.sphere_points(df.where("chain_id = 'A'"), n_points=400)).collect()}
    assert area[1] == pytest.approx(4 * math.pi * 3.15**2)


def test_hydrogens_have_the_rules_geometry(spark):
    names = {"N": (0.0, 0.0, 0.0), "CA": (1.45, 0.1, 0.2), "C": (2.0, 1.4, 0.0), "O": (1.3, 2.4, 0.3), "CB": (2.0, -0.7, 1.3), "OG": (1.4, -2.0, 1.2)}
    rows = [(1, "A", i, 10 * i + k, n, "SER", x + 3.8 * i, y, z) for i in range(2) for k, (n, (x, y, z)) in enumerate(names.items())]
    df = spark.createDataFrame(rows, "structure_id long, chain_id string, res_index long, atom_number long, atom_type string, res_type string, x double, y double, z double")
    got = surface.place_hydrogens(df, HYDROGEN_RULES).collect()
    at = {r[3]: np.array(r[6:9]) for r in rows}
    assert len(got) == 3 + 1 + 2  # N-terminus, backbone, two side chains
    for r in got:
        p = np.array([r.x, r.y, r.z]) - at[r.donor]
        if r.donor % 10 == 5:
            q = at[r.donor - 1] - at[r.donor]
            assert np.linalg.norm(p) == pytest.approx(1.0)
            assert math.degrees(math.acos(p @ q / np.linalg.norm(p) / np.linalg.norm(q))) == pytest.approx(110, abs=1e-6)
        else:
            assert np.linalg.norm(p) == pytest.approx(1.01 if r.donor == 0 else 1.0)


def test_groups_of_a_graph(spark):
    links = [(0, 4), (4, 3), (3, 6), (6, 1), (2, 5), (5, 9), (7, 8)]
    edges = spark.createDataFrame([(1, "A", i, j) for a, b in links for i, j in ((a, b), (b, a))], "structure_id long, chain_id string, i long, j long")
    cand = spark.createDataFrame([(1, "A", i) for i in range(10)], "structure_id long, chain_id string, res_index long")
    groups = {}
    for r in surface.active_site_groups(cand, edges).collect():
        groups.setdefault(r.group, set()).add(r.res_index)
    assert sorted(map(sorted, groups.values())) == [[0, 1, 3, 4, 6], [2, 5, 9], [7, 8]]


def test_core_seeds(spark):
    cand = spark.createDataFrame([(1, "A", i, float(i), 0.0, 0.0) for i in range(6)], "structure_id long, chain_id string, res_index long, sx double, sy double, sz double")
    edges = spark.createDataFrame([(1, "A", i, j) for i in range(5) for j in range(5) if i != j], "structure_id long, chain_id string, i long, j long")
    assert sorted(r.res_index for r in surface.core_seeds(cand, edges).collect()) == [0, 1, 2, 3, 4]


def test_permutations_repeat(spark):
    rows = [(1, "A", i, 0.5, -1 if i < 4 else 0, i / 20) for i in range(20)]
    df = spark.createDataFrame(rows, "structure_id long, chain_id string, res_index long, asa double, interface long, score double")
    a, b = (surface.interface_significance(df, ["score"], draws=2000).first() for _ in range(2))
    assert a == b and a.k == 4 and a.percent < 1.0  # the interface has the four lowest scores


def test_fragment_weights_are_sums(spark):
    df = spark.createDataFrame([(1, "MKRPAKE")], "doc_id long, seq string")
    got = {(r.first, r.last): r.weight for r in sequences.fragments(df, 2).collect()}
    sites = df.select(sequences.cut_sites(F.col("seq")).alias("s")).first().s
    assert sites == [0, 1, 5, 7]
    assert got[1, 5] == pytest.approx(18 + 128.17 + 156.19 + 97.12 + 71.09)
    assert df.select(sequences.cut_sites(F.col("seq"), cut_after=True).alias("s")).first().s == [0, 2, 6, 7]


def test_structure_files_round_trip(spark, tmp_path):
    lines = ["HEADER    TEST PROTEIN", "HELIX    1   1 ALA A    1  GLY A    3  1", "ATOM      1  N   ALA A   1      11.104   6.134  -6.504  1.00  0.00           N",
             "ATOM      2  CA BALA A   1      11.639   6.071  -5.147  1.00  0.00", "ATOM      3  CA AALA A   1      11.639   6.071  -5.147  1.00 12.50", "HETATM    4  O   HOH A   9       1.000   2.000   3.000  1.00  5.00", "END"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "pdb1abc.ent").write_text("\n".join(lines))
    read = files.read_lines(spark, str(tmp_path / "in"))
    atoms = files.parse_atoms(read)
    assert [(r.structure_id, r.atom_number, r.record) for r in atoms.orderBy("atom_number").collect()] == [("1abc", 1, "ATOM"), ("1abc", 3, "ATOM"), ("1abc", 4, "HETATM")]
    assert files.header_text(read).first().header == "TEST PROTEIN" and files.secondary_records(read).first().last_res == 3
    classed = atoms.withColumn("mol_class", residues.molecule_class(F.col("record"), F.col("res_type")))
    files.write_structures(classed, str(tmp_path / "out"), files.header_lines(read))
    back = spark.read.text(str(tmp_path / "out")).selectExpr("structure_id", "value AS line", "0 AS line_no")
    again = files.parse_atoms(back)
    cols = ["structure_id", "record", "atom_number", "atom_type", "x", "y", "z", "b_factor"]
    assert sorted(map(tuple, again.select(*cols).collect())) == sorted(map(tuple, atoms.select(*cols).collect()))
    assert files.catalogue(spark, str(tmp_path / "in")).first().structure_id == "1abc"
    files.save_snapshot(atoms, str(tmp_path / "snap"), 4)
    assert files.load_snapshot(spark, str(tmp_path / "snap")).count() == 3


def test_spectrum_lines(spark):
    df = spark.createDataFrame([(1, 0, "Mass, Intensity"), (1, 1, "800.5, 1e2"), (1, 2, "801.0, 3.5")], "spectrum_id long, line_no long, line string")
    assert [tuple(r) for r in files.parse_spectrum(df).orderBy("idx").collect()] == [(1, 0, 800.5, 100.0), (1, 1, 801.0, 3.5)]
    assert files.parse_spectrum(df, sci_as_zero=True).where("idx = 0").first().y == 0.0


def test_closure_of_an_empty_tree(spark):
    empty = spark.createDataFrame([], "node_id long, parent_id long, level long, description string")
    assert classify.lineage(empty).count() == 0 and classify.keyword_hits(empty, ["a"]).count() == 0


def test_points_by_brute_force(spark):
    """Points of atoms over several cells, with text ids, against a scalar count by the definition."""
    import math
    import random

    from helixmill.functions.lookups import RADIUS
    from helixmill.operators import surface

    r = random.Random(5)
    names = ["N", "CA", "C", "O", "CB"]
    atoms = [("1abc", "AB"[k // 40], k % 40 // 5, k, names[k % 5], r.uniform(0, 24), r.uniform(0, 9), r.uniform(0, 9)) for k in range(80)]
    df = spark.createDataFrame(atoms, "structure_id string, chain_id string, res_index long, atom_number long, atom_type string, x double, y double, z double")
    got = {g.atom_number: (g.counted, g.blocked_chain, g.blocked_all, g.dots) for g in surface.sphere_points(df, n_points=60).collect()}
    unit, radius = surface.sphere(60), {a[3]: RADIUS[a[4][0]] + 1.4 for a in atoms}
    for a in atoms:
        counted = chain = every = dots = 0
        for u in unit:
            at = [a[5 + n] + radius[a[3]] * u[n] for n in range(3)]
            cover = [b for b in atoms if b[3] != a[3] and math.dist(at, b[5:]) < radius[b[3]]]
            bonded = [b for b in cover if b[1] == a[1] and (b[2] == a[2] or (a[4], b[4], b[2] - a[2]) in (("C", "N", 1), ("N", "C", -1)))]
            other = [b for b in cover if b not in bonded]
            dots += not cover
            if not bonded:
                counted += 1
                every += bool(other)
                chain += any(b[1] == a[1] for b in other)
        assert got[a[3]] == (counted, chain, every, dots)
    lone = surface.accessibility(surface.sphere_points(df.where("chain_id = 'A' AND res_index = 0"), n_points=60)).first()
    assert lone.asa == 1.0 and surface.sphere_points(df.where("false")).count() == 0


def test_interface_report_reads_significance(spark):
    from helixmill.operators import surface
    from helixmill.sources import files

    rows = [("1abc", "A", i, 0.5, -1 if i < 3 else 0, float(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "structure_id string, chain_id string, res_index long, asa double, interface long, score double")
    got = surface.interface_significance(df, ["score"], draws=500).collect()
    assert [(g.structure_id, g.k, g.mean) for g in got] == [("1abc", 3, 1.0)] and got[0].percent < 5
    assert files.interface_report(surface.interface_significance(df, ["score"], draws=500)).count() == 1


def test_secondary_structure_by_number(spark):
    from helixmill.operators import residues

    res = spark.createDataFrame([("s", "A", i, i + 1) for i in range(6)], "structure_id string, chain_id string, res_index long, res_number long")
    rec = spark.createDataFrame([("s", "A", 2, 4, "A", 1)], "structure_id string, chain_id string, first_res long, last_res long, kind string, line_no long")
    got = residues.secondary_from_records(res, rec, "res_number").orderBy("res_index").collect()
    assert [g.ss for g in got] == ["C", "A", "A", "C", "C", "C"]


def test_deep_trees(spark):
    import pytest

    from helixmill.operators import classify

    nodes = spark.createDataFrame([(i, i - 1 if i else None, i, f"n{i}") for i in range(9)], "node_id long, parent_id long, level long, description string")
    assert classify.closure(nodes).where("node_id = 8").count() == 9
    with pytest.raises(ValueError, match="levels"):
        classify.closure(nodes, depth=4)


def test_domain_candidates_on_the_limit(spark):
    """Residues whose mean equals the chain's limit stay, and those whose number equals theirs go, in whatever order the sums are taken."""
    rng, codes = random.Random(7), sorted(HYDROPHOBICITY)
    residues, edges, want = [], [], set()
    for structure in range(300):
        links, code, last = {}, {}, 0
        for _ in range(rng.randint(3, 6)):  # stars: a center and its leaves
            leaves = rng.choice((3, 6, 7))
            links[last] = list(range(last + 1, last + leaves + 1))
            links.update({leaf: [last] for leaf in links[last]})
            last += leaves + 1
        code = {i: rng.choice(codes) for i in links}
        h = {i: sum(Fraction(HYDROPHOBICITY[code[i]] + HYDROPHOBICITY[code[j]], 2) for j in js) / len(js) for i, js in links.items()}
        c = {i: sum(Fraction(len(js) + len(links[j]), 2) for j in js) / len(js) for i, js in links.items()}
        sizes = [size for i in links if h[i] and (size := sum(h.values()) / 2 / h[i]).denominator == 1 and size >= last]
        size = int(sizes[0]) if sizes else last
        residues += [(structure, "A", i, code.get(i, "A")) for i in range(size)]
        edges += [(structure, "A", i, j) for i, js in links.items() for j in js]
        want |= {(structure, i) for i, js in links.items() if len(js) > Fraction(7, 10) * sum(c.values()) / size and h[i] >= sum(h.values()) / 2 / size}
    rng.shuffle(edges)
    r = spark.createDataFrame(residues, "structure_id long, chain_id string, res_index long, code string")
    e = spark.createDataFrame(edges, "structure_id long, chain_id string, i long, j long")
    got = spatial.domain_candidates(r, e, r.select("structure_id", "chain_id", "res_index", F.lit(1.0).alias("shielding")))
    assert {(g.structure_id, g.res_index) for g in got.collect()} == want


def test_side_chain_means_do_not_depend_on_the_order_of_rows(spark):
    """Sums go by atom number, so that a side chain's end lies on its alpha carbon or not whatever order the rows come in."""
    rng = random.Random(5)
    rows = [(s, "A", 0, n, name, *[round(rng.uniform(0, 50), 3) for _ in "xyz"]) for s in range(100) for n, name in enumerate(("N", "CA", "C", "O", "CB", "CG", "SD", "H"))]
    want = {s: tuple(((own[0][k] + own[1][k]) + own[2][k] + own[3][k]) / 4 for k in (5, 6, 7)) for s in range(100) for own in [[r for r in rows if r[0] == s and r[4] in ("C", "CB", "CG", "SD")]]}
    rows.sort(key=lambda r: -r[3])
    a = spark.createDataFrame(rows, "structure_id long, chain_id string, res_index long, atom_number long, atom_type string, x double, y double, z double").coalesce(1)
    assert {r.structure_id: (r.sx, r.sy, r.sz) for r in residues.side_chain_means(a).collect()} == want
