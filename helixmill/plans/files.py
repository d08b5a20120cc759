"""Queries that write and parse file lines made from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.functions.lineage import new_path
from helixmill.operators import spatial as S
from helixmill.operators import sequences as Q
from helixmill.plans.registry import query, rounded
from helixmill.plans.structures import CONTACTS, DENSITY_SQL, HB, _bonds, _contacts
from helixmill.sources import files as I
from helixmill.sources import fixtures as X


def _lines(spark, d) -> DataFrame:
    a = X.atoms(spark, d).withColumn("occupancy", F.lit(1.0))
    return a.select("structure_id", F.col("atom_number").alias("line_no"), I.atom_line().alias("line"))


@query("io1_read_structures", X.ATOMS, "SELECT structure_id, 'ATOM' AS record, atom_number, atom_type, res_type, chain_id, res_number, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z, 1.0::DOUBLE AS occupancy, round(b_factor, 2) AS b_factor FROM atoms")
def io1(spark, d):
    return I.parse_atoms(_lines(spark, d)).drop("line_no", "segment")


@query("io2_header_table", "", "SELECT doc_id AS structure_id, 'TITLE' AS record, count(*) AS n FROM documents GROUP BY ALL")
def io2(spark, d):
    docs = X.table(spark, d, "documents")
    kinds = F.explode(F.array(F.lit("HEADER    X"), F.concat(F.lit("TITLE     "), F.coalesce("source", F.lit(""))), F.lit("ATOM      1"), F.lit("TER"), F.lit("REMARK 1")))
    lines = docs.select(F.col("doc_id").alias("structure_id"), kinds.alias("line")).withColumn("line_no", F.lit(0))
    return I.header_lines(lines, info_only=True).where("record = 'TITLE'").groupBy("structure_id", "record").agg(F.count("*").alias("n"))


@query("io3_write_lines", X.ATOMS, "SELECT structure_id, atom_number AS line_no, printf('ATOM  %5d  %-3s %3s %s%4d    %8.3f%8.3f%8.3f%6.2f%6.2f', atom_number, atom_type, res_type, chain_id, res_number, x, y, z, 1.0, b_factor) AS line FROM atoms")
def io3(spark, d):
    return _lines(spark, d)


def _saved(spark, df: DataFrame, name: str) -> DataFrame:
    """Written as a snapshot and read back."""
    path = new_path(spark, name)
    I.save_snapshot(df, path, buckets=8)
    return I.load_snapshot(spark, path)


@query("io4_snapshot", X.ATOMS, "SELECT structure_id, chain_id, res_index, atom_number, atom_type, x, y, z, round(b_factor, 4) AS b_factor FROM atoms")
def io4(spark, d):
    a = X.atoms(spark, d).select("structure_id", "chain_id", "res_index", "atom_number", "atom_type", "x", "y", "z", "b_factor")
    return rounded(_saved(spark, a, "snapshot"), "b_factor")


@query("io7_contact_table", CONTACTS, "SELECT structure_id, chain_id, i, j, round(q, 4) AS q FROM contacts")
def io7(spark, d):
    return rounded(_saved(spark, _contacts(spark, d).select("structure_id", "chain_id", "i", "j", "q"), "contacts"), "q")


@query("io8_density_table", X.ATOMS, DENSITY_SQL)
def io8(spark, d):
    table = S.densities(X.atoms(spark, d)).select("structure_id", "atom_number", "n", "density")
    return rounded(_saved(spark, table, "densities"), "density")


@query("io6_accessibility_table", X.ACCESSIBILITY, "SELECT structure_id, res_number, round(asa, 3) AS asa, round(system_asa, 3) AS sidechain_asa FROM accessibility WHERE chain_id = 'A'")
def io6(spark, d):
    a = X.accessibility(spark, d).where("chain_id = 'A'").withColumn("sidechain_asa", F.col("system_asa"))
    lines = a.select("structure_id", I.accessibility_line().alias("line"))
    return I.parse_accessibility(lines).select("structure_id", "res_number", "asa", "sidechain_asa")


@query("io9_alignment_columns", X.ALIGNMENTS, "SELECT aln_id, seq_idx, col, letter FROM cells")
def io9(spark, d):
    texts = Q.row_columns(X.alignment_rows(spark, d), X.PIECE).select("aln_id", F.array_join("columns", "\n").alias("value"))
    return I.parse_columns(texts)


@query("io11_read_spectra", X.SPECTRA, "SELECT spectrum_id, idx, round(x, 4) AS x, round(y, 4) AS y FROM spectra")
def io11(spark, d):
    s = X.spectra(spark, d)
    lines = s.select("spectrum_id", F.col("idx").alias("line_no"), F.concat_ws(", ", F.col("x").cast("string"), F.col("y").cast("string")).alias("line"))
    return rounded(I.parse_spectrum(lines), "x", "y")


@query("io12_write_spectra", X.SPECTRA, "SELECT spectrum_id, round(x, 4) AS x, round(y, 4) AS y FROM spectra")
def io12(spark, d):
    path = new_path(spark, "spectra")
    I.write_spectra(X.spectra(spark, d), path)
    back = spark.read.schema("x double, y double, spectrum_id long").csv(path)
    return rounded(back.select("spectrum_id", "x", "y"), "x", "y")


@query("io13_classification_files", X.TREE, "SELECT node_id, parent_id, level::VARCHAR AS level, description FROM nodes")
def io13(spark, d):
    t, path = X.tree(spark, d), new_path(spark, "classification")
    none = F.lit("-")
    files = {
        "hierarchy": [F.col("node_id"), F.coalesce(F.col("parent_id").cast("string"), none), none.alias("children")],
        "descriptions": [F.col("node_id"), F.col("level"), none.alias("sccs"), none.alias("name"), F.col("description")],
        "domains": [none.alias("sid"), none.alias("pdbid"), none.alias("residues"), none.alias("sccs"), F.col("node_id"), none.alias("lineage")],
    }
    for name, columns in files.items():
        t.select(F.concat_ws("\t", *[c.cast("string") for c in columns]).alias("value")).write.text(f"{path}/{name}")
    nodes = I.read_classification(spark, *[f"{path}/{name}" for name in files])["nodes"]
    return nodes.select("node_id", "parent_id", "level", "description")


@query("io15_hbond_report", HB, "SELECT structure_id, count(*) AS n_lines FROM good WHERE n = 1 GROUP BY 1")
def io15(spark, d):
    return I.hbond_report(_bonds(spark, d)).groupBy("structure_id").agg(F.count("value").alias("n_lines"))


@query("io16_page_attributes", "", """SELECT page_id, unnest(v) AS value, unnest(range(0, len(v))) AS nth FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS v FROM pages)""")
def io16(spark, d):
    return I.extract_attribute(X.table(spark, d, "pages"), "href")


@query("io17_profile", X.SEQUENCES, "SELECT source AS text_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth, doc_id::VARCHAR AS header, seq, seq AS ungapped FROM sequences")
def io17(spark, d):
    s = X.sequences(spark, d)
    entry = F.concat(F.lit(">"), F.col("doc_id").cast("string"), F.lit("\n"), F.substring("seq", 1, 50), F.lit("\n"), F.expr("substr(seq, 51)"))
    texts = s.groupBy(F.col("source").alias("text_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", entry.alias("e")))), lambda p: p["e"]), "\n").alias("value"))
    return I.parse_profile(texts)
