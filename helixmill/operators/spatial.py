"""Spatial joins: absolute grids whose cells are as wide as the cutoff, neighbouring cells probed on one side, exact distances last."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.functions.lineage import settle
from helixmill.functions.lookups import ACCEPTORS, BOND, DONORS, HYDROPHOBICITY, atom_radius, bond_limit, lookup
from helixmill.operators.residues import CHAIN, RESIDUE

def cells(points: DataFrame, width: float, probe: bool = False) -> DataFrame:
    """Adds grid cell columns cx, cy, cz; with probe one row for each of the 27 cells around."""
    out = points
    for c in "xyz":
        cell = F.floor(F.col(c) / width).cast("int")
        out = out.withColumn(f"c{c}", cell)
    if probe:
        for c in "xyz":
            out = out.withColumn("_d", F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)]))).withColumn(f"c{c}", F.col(f"c{c}") + F.col("_d")).drop("_d")
    return out


def join_within(left: DataFrame, right: DataFrame, cutoff: float, keys: list[str], least: float = 0.0) -> DataFrame:
    """Pairs of points of equal keys at distance least..cutoff.  Other columns get suffixes _a and _b; adds dist."""
    rest = lambda df, s: df.select(*keys, "cx", "cy", "cz", *[F.col(c).alias(f"{c}_{s}") for c in df.columns if c not in (*keys, "cx", "cy", "cz")])
    a, b = rest(cells(left, cutoff), "a"), rest(cells(right, cutoff, probe=True), "b")
    dist = F.sqrt(sum((F.col(f"{c}_a") - F.col(f"{c}_b")) * (F.col(f"{c}_a") - F.col(f"{c}_b")) for c in "xyz"))
    return a.join(b, [*keys, "cx", "cy", "cz"]).drop("cx", "cy", "cz").withColumn("dist", dist).where(F.col("dist").between(least, cutoff))


#: A cell and the half of its 26 neighbours that come after it: each pair of cells meets once.
_HALF = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) >= (0, 0, 0)]


def pairs_once(points: DataFrame, cutoff: float, keys: list[str], least: float = 0.0) -> DataFrame:
    """Pairs of different points of equal keys at distance least..cutoff, once each with id_a < id_b.

    Every point goes to its own cell and to the 13 that come after it, so a pair is met and measured once.
    """
    cols = [c for c in points.columns if c not in keys]
    at = [F.floor(F.col(c) / cutoff).cast("int").alias(f"c{c}") for c in "xyz"]
    a = points.select(*keys, F.struct(*cols).alias("p"), *at)
    step = F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip("xyz", s)]) for s in _HALF]))
    b = points.select(*keys, F.struct(*cols).alias("q"), *at, step.alias("s"))
    b = b.select(*keys, "q", *[(F.col(f"c{c}") + F.col(f"s.{c}")).alias(f"c{c}") for c in "xyz"], (F.col("s.x") + F.col("s.y") + F.col("s.z") + F.abs("s.x") + F.abs("s.y") + F.abs("s.z") == 0).alias("here"))
    near = a.join(b, [*keys, "cx", "cy", "cz"])
    dist = F.sqrt(sum((F.col(f"p.{c}") - F.col(f"q.{c}")) * (F.col(f"p.{c}") - F.col(f"q.{c}")) for c in "xyz"))
    near = near.where("p.id < q.id OR (NOT here AND p.id <> q.id)").withColumn("dist", dist).where(F.col("dist").between(least, cutoff))
    first = F.col("p.id") < F.col("q.id")
    low, high = F.when(first, F.col("p")).otherwise(F.col("q")), F.when(first, F.col("q")).otherwise(F.col("p"))
    near = near.select(*keys, low.alias("a"), high.alias("b"), "dist")
    return near.select(*keys, *[F.col(f"a.{c}").alias(f"{c}_a") for c in cols], *[F.col(f"b.{c}").alias(f"{c}_b") for c in cols], "dist")


def pairs_within(points: DataFrame, cutoff: float, keys: list[str], least: float = 0.0) -> DataFrame:
    """Ordered pairs of different points (column id) of equal keys: both directions of pairs_once."""
    once = pairs_once(points, cutoff, keys, least)
    cols = [c for c in points.columns if c not in keys]
    turn = lambda a, b: F.struct(*[F.col(f"{c}_{a}").alias(f"{c}_a") for c in cols], *[F.col(f"{c}_{b}").alias(f"{c}_b") for c in cols])
    both = once.select(*keys, "dist", F.explode(F.array(turn("a", "b"), turn("b", "a"))).alias("t"))
    return both.select(*keys, "t.*", "dist")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], width: float) -> DataFrame:
    """left(keys, id, x, y, z, ..) with near_id and dist of the nearest point of right(keys, id, x, y, z) of equal keys; of equal distances the least id.

    Exact, without a largest distance: the 27 cells around a point show every point within a cell's width, so a nearest one that is not farther closes the
    search; the points left over go on with cells twice as wide.  A point without any of its keys on the right has nulls; ids are unique within their keys on the left.
    """
    has = right.select(*keys).distinct()
    lone = left.join(has, keys, "left_anti").withColumns({"near_id": F.lit(None).cast(right.schema["id"].dataType), "dist": F.lit(None).cast("double")})
    found, open_ = lone, settle(left.join(has, keys, "left_semi"))
    targets = right.select(*keys, F.col("id").alias("near_id"), *[F.col(c).alias(f"n{c}") for c in "xyz"])
    while True:
        probes = cells(open_.select(*keys, "id", "x", "y", "z"), width, probe=True)
        at = targets.withColumns({f"c{c}": F.floor(F.col(f"n{c}") / width).cast("int") for c in "xyz"})
        dist = F.sqrt(sum((F.col(c) - F.col(f"n{c}")) * (F.col(c) - F.col(f"n{c}")) for c in "xyz"))
        best = probes.join(at, [*keys, "cx", "cy", "cz"]).groupBy(*keys, "id").agg(F.min(F.struct(dist.alias("dist"), "near_id")).alias("best"))
        seen = settle(open_.join(best, [*keys, "id"], "left").select(*left.columns, "best.near_id", "best.dist"))
        found = found.unionByName(seen.where(F.col("dist") <= width))
        open_ = seen.where((F.col("dist") > width) | F.col("dist").isNull()).select(*left.columns)
        if open_.isEmpty():
            return found
        width *= 2


def overlaps(atoms: DataFrame, probe: float = 1.4, other_radius: float = 1.7) -> DataFrame:
    """Ordered pairs of atoms of a structure whose probe spheres meet: dist <= r1 + r2 + 2 * probe."""
    p = atoms.withColumnRenamed("atom_number", "id").withColumn("radius", atom_radius(F.col("atom_type"), other_radius))
    return pairs_within(p, 2 * (3.0 + probe), ["structure_id"]).where(F.col("dist") <= F.col("radius_a") + F.col("radius_b") + 2 * probe)


def bonds(atoms: DataFrame, hydrogens: bool = True) -> DataFrame:
    """(structure_id, atom_a < atom_b, mid-point) within residues, and C(i)-N(i+1)."""
    p = atoms.select(*CHAIN, "res_index", "atom_number", "atom_type", "x", "y", "z")
    a = p.select(*CHAIN, *[F.col(c).alias(f"{c}_a") for c in p.columns[2:]])
    b = p.select(*CHAIN, *[F.col(c).alias(f"{c}_b") for c in p.columns[2:]])
    a, b = a.withColumn("res", F.col("res_index_a")), b.withColumn("res", F.col("res_index_b"))
    inside = a.join(b, [*CHAIN, "res"]).where("atom_number_a < atom_number_b")
    if not hydrogens:
        inside = inside.where("NOT startswith(atom_type_a, 'H') AND NOT startswith(atom_type_b, 'H')")
    peptide = a.where("atom_type_a = 'C'").join(b.where("atom_type_b = 'N'").withColumn("res", F.col("res") - 1), [*CHAIN, "res"])
    both = inside.unionByName(peptide)
    dist = F.sqrt(sum((F.col(f"{c}_a") - F.col(f"{c}_b")) ** 2 for c in "xyz"))
    limit = bond_limit(F.substring("atom_type_a", 1, 1), F.substring("atom_type_b", 1, 1))
    return both.where(dist < limit).select("structure_id", F.col("atom_number_a").alias("atom_a"), F.col("atom_number_b").alias("atom_b"), *[((F.col(f"{c}_a") + F.col(f"{c}_b")) / 2).alias(c) for c in "xyz"])


def densities(atoms: DataFrame, cutoff: float = 9.0) -> DataFrame:
    """Neighbours of each atom in its chain closer than cutoff, over the chain's largest count."""
    p = atoms.select(*CHAIN, "res_index", F.col("atom_number").alias("id"), "x", "y", "z")
    n = pairs_within(p, cutoff, CHAIN).where(F.col("dist") < cutoff).groupBy(*CHAIN, F.col("id_a").alias("id")).agg(F.count("*").alias("n"))
    out = p.join(n, [*CHAIN, "id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("density", F.col("n") / F.max("n").over(Window.partitionBy(*CHAIN))).select(*CHAIN, "res_index", F.col("id").alias("atom_number"), "n", "density")


def smooth_over_neighbors(values: DataFrame, edges: DataFrame, value: str) -> DataFrame:
    """Mean of a residue value over the residue itself and its neighbours (edges i, j both ways)."""
    other = edges.select(*CHAIN, F.col("i").alias("res_index"), F.col("j")).join(values.select(*CHAIN, F.col("res_index").alias("j"), value), [*CHAIN, "j"]).select(*RESIDUE, value)
    return values.select(*RESIDUE, value).unionByName(other).groupBy(*RESIDUE).agg(F.avg(value).alias(value))


def _foot(p: str, a: str = "sa", b: str = "sb") -> Column:
    """Distance from b to the foot of p on the segment a-b; -1 outside it, 10 where a is b."""
    d = lambda u, v: sum((F.col(f"{v}_{c}") - F.col(f"{u}_{c}")) * (F.col(f"{p}_{c}") - F.col(f"{a}_{c}")) for c in "xyz")
    length = F.sqrt(sum((F.col(f"{a}_{c}") - F.col(f"{b}_{c}")) ** 2 for c in "xyz"))
    along = d(a, b) / length
    return F.when(length == 0, 10.0).when((along > length) | (along < 0), -1.0).otherwise(length - along)


def _shield(dist: Column) -> Column:
    return F.when(dist < 0, 1.0).otherwise(1 - F.exp(-dist * dist / 4))


def contact_scores(residues: DataFrame, cutoff: float = 10.0) -> DataFrame:
    """(structure_id, chain_id, i < j, dist, q) of residues whose side chains (sx, sy, sz) are within cutoff.

    q = 20 * shielding / (dist + 1); shielding is the product, over both alpha carbons of the pair and over alpha carbon and side
    chain of every candidate of i that is closer than j, of 1 - exp(-d^2/4), d the foot distance on the segment between side chains.
    """
    p = residues.select(*CHAIN, F.col("res_index").alias("id"), F.col("sx").alias("x"), F.col("sy").alias("y"), F.col("sz").alias("z"), *[F.col(c).alias(f"c{n}") for c, n in zip("xyz", ("ax", "ay", "az"))])
    pairs = pairs_once(p, cutoff, CHAIN).where("dist > 0")
    names = {"id_a": "i", "id_b": "j", **{f"{c}_{s}": f"s{s}_{c}" for c in "xyz" for s in "ab"}, **{f"ca{c}_{s}": f"c{s}_{c}" for c in "xyz" for s in "ab"}}
    pairs = pairs.withColumnsRenamed(names)
    own = _shield(_foot("ca")) * _shield(_foot("cb"))
    pairs = pairs.withColumn("own", own)
    closer = pairs.select(*CHAIN, "i", F.col("j").alias("k"), F.col("dist").alias("k_dist"), *[F.col(f"{s}b_{c}").alias(f"{s}k_{c}") for s in "sc" for c in "xyz"])
    triple = pairs.join(closer, [*CHAIN, "i"]).where("k_dist < dist OR (k_dist = dist AND k < j)")
    factor = _shield(_foot("ck")) * _shield(_foot("sk"))
    more = triple.groupBy(*CHAIN, "i", "j").agg(F.when(F.min(factor) <= 0, 0.0).otherwise(F.exp(F.sum(F.log(F.when(factor > 0, factor))))).alias("more"))
    out = pairs.join(more, [*CHAIN, "i", "j"], "left")
    return out.select(*CHAIN, "i", "j", "dist", (20 * F.col("own") * F.coalesce("more", F.lit(1.0)) / (F.col("dist") + 1)).alias("q"))


def neighbor_edges(contacts: DataFrame, least_q: float = 0.35, cutoff: float = 10.0) -> DataFrame:
    """Both directions of every contact of q over least_q and distance under cutoff."""
    kept = contacts.where((F.col("q") > least_q) & (F.col("dist") < cutoff)).select(*CHAIN, "i", "j")
    return kept.unionByName(kept.select(*CHAIN, F.col("j").alias("i"), F.col("i").alias("j"))).distinct()


def neighbor_counts(residues: DataFrame, edges: DataFrame) -> DataFrame:
    n = edges.groupBy(*CHAIN, F.col("i").alias("res_index")).agg(F.count("*").alias("n"))
    return residues.select(*RESIDUE).join(n, RESIDUE, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def shielding(residues: DataFrame, edges: DataFrame) -> DataFrame:
    """Neighbour counts clamped to their tenth and ninetieth percent by rank, scaled, then averaged over neighbours."""
    n = neighbor_counts(residues, edges)
    sorted_n = F.array_sort(F.collect_list("n"))
    size = F.count("*")
    ends = n.groupBy(*CHAIN).agg(F.get(sorted_n, F.ceil(size * 0.1).cast("int")).alias("low"), F.get(sorted_n, F.floor(size * 0.9).cast("int")).alias("high"), F.avg("n").alias("mean_neighbors"))
    clamped = n.join(ends, CHAIN).withColumn("c", F.least(F.greatest("n", "low"), "high"))
    scaled = clamped.withColumn("shielding", F.when(F.col("high") > F.col("low"), (F.col("c") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0))
    return smooth_over_neighbors(scaled, edges, "shielding")


def core_residues(residues: DataFrame, edges: DataFrame, core_cutoff: int = 8, neighbor_thresh: int = 1) -> DataFrame:
    """Residues with core_cutoff neighbours, neighbor_thresh of which have as many; and those between two core residues."""
    dense = edges.groupBy(*CHAIN, "i").agg(F.count("*").alias("n")).where(F.col("n") >= core_cutoff).select(*CHAIN, F.col("i").alias("res_index"))
    among = edges.join(dense.withColumnRenamed("res_index", "j"), [*CHAIN, "j"], "left_semi").groupBy(*CHAIN, F.col("i").alias("res_index")).agg(F.count("*").alias("m")).where(F.col("m") >= neighbor_thresh)
    core = dense.join(among, RESIDUE, "left_semi")
    at = residues.select(*RESIDUE, "res_number").join(core.withColumn("core", F.lit(True)), RESIDUE, "left")
    w = Window.partitionBy(*CHAIN).orderBy("res_number").rangeBetween(-1, -1)
    v = Window.partitionBy(*CHAIN).orderBy("res_number").rangeBetween(1, 1)
    flag = F.coalesce("core", F.lit(False)) | (F.coalesce(F.bool_or("core").over(w), F.lit(False)) & F.coalesce(F.bool_or("core").over(v), F.lit(False)))
    return at.withColumn("is_core", flag).where("is_core").select(*RESIDUE)


def touching(atoms: DataFrame, others: DataFrame, cutoff: float = 5.0) -> DataFrame:
    """Residues that have an atom closer than cutoff to any of the other atoms of their structure."""
    a = atoms.select("structure_id", "chain_id", "res_index", "x", "y", "z")
    near = join_within(a, others.select("structure_id", "x", "y", "z"), cutoff, ["structure_id"]).where(F.col("dist") < cutoff)
    return near.select("structure_id", F.col("chain_id_a").alias("chain_id"), F.col("res_index_a").alias("res_index")).distinct()


def differential(asa: DataFrame, least: float = 0.05) -> DataFrame:
    """asa - system_asa, and whether it says interface."""
    d = F.col("asa") - F.col("system_asa")
    return asa.withColumn("differential", d).withColumn("interface", F.when(d > least, -1).otherwise(0).cast("long"))


def interface_partners(asa: DataFrame, atoms: DataFrame, probe: float = 1.4) -> DataFrame:
    """For interface residues, the chain of the nearest overlapping atom of another chain."""
    near = overlaps(atoms.select("structure_id", "chain_id", "res_index", "atom_number", "atom_type", "x", "y", "z"), probe).where("chain_id_a <> chain_id_b")
    best = near.groupBy("structure_id", F.col("chain_id_a").alias("chain_id"), F.col("res_index_a").alias("res_index")).agg(F.min_by("chain_id_b", F.struct("dist", "id_b")).alias("partner"))
    return differential(asa).where("interface = -1").join(best, RESIDUE, "left").select(*RESIDUE, "differential", "partner")


def interface_area(asa: DataFrame) -> DataFrame:
    return differential(asa).where("interface = -1").groupBy(*CHAIN).agg(F.sum(F.col("differential") * F.col("exposed_area")).alias("area"), F.count("*").alias("n_residues"))


def hydrogen_owners(atoms: DataFrame) -> DataFrame:
    """Closest heavy atom of its residue for each hydrogen."""
    h = atoms.where("startswith(atom_type, 'H')").select(*RESIDUE, "atom_number", "x", "y", "z")
    heavy = atoms.where("NOT startswith(atom_type, 'H')").select(*RESIDUE, F.col("atom_number").alias("owner"), *[F.col(c).alias(f"o{c}") for c in "xyz"])
    d = F.sqrt(sum((F.col(c) - F.col(f"o{c}")) ** 2 for c in "xyz"))
    return h.join(heavy, RESIDUE).groupBy("structure_id", "atom_number").agg(F.min_by("owner", F.struct(d, "owner")).alias("owner"), F.min(d).alias("dist"))


def _rules(spark, rows: tuple, names: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], f"rule int, {names}"))  # fixed rule tables


def protonation_sites(atoms: DataFrame, rules: tuple) -> DataFrame:
    """(structure_id, atom_number, rule): the first rule of residue and atom; the chain's first residue has the N-terminus rule, others (but PRO) the backbone rule."""
    t = _rules(atoms.sparkSession, tuple(r[:2] for r in rules), "aa string, atom string")
    first = atoms.withColumn("aa0", F.when(F.col("atom_type") == "N", F.when(F.col("res_index") == 0, "N-TERMINUS").when(F.col("res_type") != "PRO", "BACKBONE")))
    own = first.join(t, (F.col("atom") == F.col("atom_type")) & ((F.col("aa") == F.col("res_type")) | (F.col("aa") == "*") | (F.col("aa") == F.col("aa0"))))
    return own.groupBy(*RESIDUE, "atom_number", "atom_type").agg(F.min("rule").alias("rule"))


def donors_and_acceptors(atoms: DataFrame) -> DataFrame:
    """(.., role, atom_number, antecedent): donor atoms, and acceptor atoms with their antecedent's number."""
    spark = atoms.sparkSession
    d = _rules(spark, DONORS, "aa string, atom string")
    a = _rules(spark, ACCEPTORS, "aa string, atom string, before string")
    aa0 = F.when((F.col("res_index") == 0), "N-TERMINUS")
    donors = atoms.withColumn("aa0", aa0).join(d, (F.col("atom") == F.col("atom_type")) & ((F.col("aa") == F.col("res_type")) | (F.col("aa") == F.col("aa0")))).select(*RESIDUE, F.lit("donor").alias("role"), "atom_number", F.lit(None).cast("long").alias("antecedent")).distinct()
    hit = atoms.join(a, (F.col("atom") == F.col("atom_type")) & ((F.col("aa") == F.col("res_type")) | (F.col("aa") == "*"))).groupBy(*RESIDUE, "atom_number").agg(F.min_by("before", "rule").alias("before"))
    anchor = atoms.select(*RESIDUE, F.col("atom_type").alias("before"), F.col("atom_number").alias("antecedent"))
    return donors.unionByName(hit.join(anchor, [*RESIDUE, "before"]).select(*RESIDUE, F.lit("acceptor").alias("role"), "atom_number", "antecedent"))


def angle(p: str, q: str, r: str) -> Column:
    """Degrees at q between p and r (column prefixes)."""
    u, v = [[F.col(f"{e}{c}") - F.col(f"{q}{c}") for c in "xyz"] for e in (p, r)]
    cos = sum(a * b for a, b in zip(u, v)) / (F.sqrt(sum(a * a for a in u)) * F.sqrt(sum(b * b for b in v)))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))


def block_strength(h_a: Column, d_h_a: Column, h_a_aa: Column) -> Column:
    """Product of three ramps over distance and two angles; the third is a step."""
    def ramp(off: Column, ideal: float, most: float) -> Column:
        return F.when(off > most, 0.0).when(off > ideal, (most - off) / most).otherwise(1.0)

    return ramp(F.abs(h_a - 1.85), 0.25, 0.85) * ramp(F.abs(180 - d_h_a), 30, 80) * F.when(F.abs(180 - h_a_aa) > 80, 0.0).otherwise(1.0)


def hydrogen_bonds(hydrogens: DataFrame, acceptors: DataFrame, strict: bool = True, reach: float = 3.0, donor_range=(2.9, 3.9), hydrogen_range=(1.3, 2.6), least_angle: float = 100.0) -> DataFrame:
    """One bond for each unordered pair of donor and acceptor atoms: its first valid hydrogen.

    hydrogens(structure_id, donor, hydrogen, x, y, z, dx, dy, dz); acceptors(structure_id, acceptor, x, y, z, ax, ay, az),
    a.. the antecedent.
    """
    near = join_within(hydrogens, acceptors, reach, ["structure_id"]).where("donor_a <> acceptor_b")
    names = {f"{c}_a": f"h{c}" for c in "xyz"} | {f"{c}_b": f"t{c}" for c in "xyz"} | {f"d{c}_a": f"d{c}" for c in "xyz"} | {f"a{c}_b": f"a{c}" for c in "xyz"}
    p = near.withColumnsRenamed(names).withColumnsRenamed({"donor_a": "donor", "hydrogen_a": "hydrogen", "acceptor_b": "acceptor", "dist": "h_a"})
    p = p.withColumn("d_a", F.sqrt(sum((F.col(f"d{c}") - F.col(f"t{c}")) ** 2 for c in "xyz")))
    p = p.withColumns({"angle_d_h_a": angle("d", "h", "t"), "angle_d_a_aa": angle("d", "t", "a"), "angle_h_a_aa": angle("h", "t", "a")})
    good = F.col("d_a").between(*donor_range) & F.col("h_a").between(*hydrogen_range)
    if strict:
        good = good & (F.col("angle_d_h_a") >= least_angle) & (F.col("angle_d_a_aa") >= least_angle) & (F.col("angle_h_a_aa") >= least_angle)
    p = p.where(good).withColumn("strength", block_strength(F.col("h_a"), F.col("angle_d_h_a"), F.col("angle_h_a_aa")))
    w = Window.partitionBy("structure_id", F.least("donor", "acceptor"), F.greatest("donor", "acceptor")).orderBy("hydrogen", "acceptor")
    return p.withColumn("n", F.row_number().over(w)).where("n = 1").select("structure_id", "donor", "hydrogen", "acceptor", "d_a", "h_a", "angle_d_h_a", "angle_d_a_aa", "angle_h_a_aa", "strength")


def densest_neighborhood(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """Of each chain, the candidate with most candidate neighbours (the first of equals), with those neighbours."""
    c = candidates.select(*RESIDUE)
    inner = edges.join(c.withColumnRenamed("res_index", "i"), [*CHAIN, "i"], "left_semi").join(c.withColumnRenamed("res_index", "j"), [*CHAIN, "j"], "left_semi")
    n = inner.groupBy(*CHAIN, "i").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("j")), ",").alias("members"))
    return n.withColumn("k", F.row_number().over(Window.partitionBy(*CHAIN).orderBy(F.desc("n"), "i"))).where("k = 1").select(*CHAIN, F.col("i").alias("res_index"), "n", "members")


def domain_candidates(residues: DataFrame, edges: DataFrame, shield: DataFrame, c_factor: float = 0.7, h_factor: float = 0.5, least_shield: float = 0.7) -> DataFrame:
    """Residues of many neighbours, well shielded, among hydrophobic ones, against the chain's means.

    Both sides of a limit are held to nine digits: the last bits of a sum of means depend on the order of its rows, and a residue often lies on the limit.
    """
    n = edges.groupBy(*CHAIN, F.col("i").alias("res_index")).agg(F.count("*").alias("n"))
    h = residues.select(*RESIDUE, lookup(HYDROPHOBICITY, F.col("code")).cast("double").alias("h"))
    own = n.join(h, RESIDUE)
    pair = edges.withColumnRenamed("i", "res_index").join(own.withColumnsRenamed({"res_index": "j", "n": "nj", "h": "hj"}), [*CHAIN, "j"]).join(own, RESIDUE)
    score = pair.groupBy(*RESIDUE, "n").agg(F.avg((F.col("nj") + F.col("n")) / 2).alias("c_score"), F.avg((F.col("hj") + F.col("h")) / 2).alias("h_score"))
    means = score.groupBy(*CHAIN).agg(F.sum("c_score").alias("cs"), F.sum("h_score").alias("hs")).join(residues.groupBy(*CHAIN).agg(F.count("*").alias("size")), CHAIN)
    good = score.join(means, CHAIN).join(shield, RESIDUE)
    limit = lambda factor, total: F.round(factor * F.col(total) / F.col("size"), 9)
    return good.where((F.col("n") > limit(c_factor, "cs")) & (F.col("shielding") > least_shield) & (F.round("h_score", 9) >= limit(h_factor, "hs"))).select(*RESIDUE, "n", "c_score", "h_score")
