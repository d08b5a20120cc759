"""Structures, sequences, alignments, spectra and trees derived from the given tables, in Spark and in DuckDB SQL.

Each fixture is a pair: a function (spark, sf_dir) -> DataFrame and the common table expression of the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixmill.functions.lookups import CODE_RESIDUE, lookup

LETTERS = "ACDEFGHIKLMNPQRSTVWY"
ATOM_NAMES = ("N", "CA", "C", "O", "CB", "CG", "SD", "H")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """600 atoms or so for each supplier, eight to a residue, two chains to a structure."""
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    rows = table(spark, sf_dir, "lineitem").select("*", F.row_number().over(w).cast("long").alias("atom_number"))
    res = F.expr("cast((atom_number - 1) div 8 as long)")
    coord = lambda e: F.expr(f"(({e}) % 50000) / 1000D")
    rows = rows.select(
        F.col("l_suppkey").cast("long").alias("structure_id"), "atom_number", res.alias("res_index"),
        F.expr(f"element_at(array{ATOM_NAMES}, cast((atom_number - 1) % 8 + 1 as int))").alias("atom_type"),
        coord("l_partkey * 31 + l_orderkey * 17").alias("x"), coord("l_partkey * 7919 + l_orderkey * 104729").alias("y"),
        coord("l_orderkey * 15485863 + l_linenumber * 32452843 + l_partkey * 49979687").alias("z"),
        (F.col("l_discount").cast("double") * 1000).alias("b_factor"),
    )
    code = F.substring(F.lit(LETTERS), F.expr("cast((structure_id * 31 + res_index * 7) % 20 + 1 as int)"), F.lit(1))
    return rows.withColumns({"chain_id": F.when(F.col("res_index") < 40, "A").otherwise("B"), "res_number": F.col("res_index") + 1, "code": code}).withColumn("res_type", lookup(CODE_RESIDUE, F.col("code")))


ATOMS = f"""
atoms AS MATERIALIZED (
  SELECT structure_id, atom_number, res_index, atom_type, x, y, z, b_factor, CASE WHEN res_index < 40 THEN 'A' ELSE 'B' END AS chain_id, res_index + 1 AS res_number, code,
    map([{', '.join(repr(c) for c in CODE_RESIDUE)}], [{', '.join(repr(r) for r in CODE_RESIDUE.values())}])[code] AS res_type
  FROM (SELECT *, substr('{LETTERS}', ((structure_id * 31 + res_index * 7) % 20 + 1)::INT, 1) AS code FROM (
    SELECT l_suppkey::BIGINT AS structure_id, n AS atom_number, (n - 1) // 8 AS res_index, {list(ATOM_NAMES)}[((n - 1) % 8 + 1)::INT] AS atom_type,
      ((l_partkey::BIGINT * 31 + l_orderkey::BIGINT * 17) % 50000)::DOUBLE / 1000 AS x, ((l_partkey::BIGINT * 7919 + l_orderkey::BIGINT * 104729) % 50000)::DOUBLE / 1000 AS y,
      ((l_orderkey::BIGINT * 15485863 + l_linenumber::BIGINT * 32452843 + l_partkey::BIGINT * 49979687) % 50000)::DOUBLE / 1000 AS z, l_discount::DOUBLE * 1000 AS b_factor
    FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS n FROM lineitem))))"""


def residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The residues of atoms with their alpha carbon's coordinates."""
    a = atoms(spark, sf_dir).where("atom_type = 'CA'")
    return a.select("structure_id", "chain_id", "res_index", "res_number", "code", "res_type", "x", "y", "z")


RESIDUES = ATOMS + ",\nresidues AS (SELECT structure_id, chain_id, res_index, res_number, code, res_type, x, y, z FROM atoms WHERE atom_type = 'CA')"


def neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed edges (i, j) of alpha carbons of one chain within 10."""
    from helixmill.operators.spatial import pairs_within

    r = residues(spark, sf_dir)
    p = pairs_within(r.withColumnRenamed("res_index", "id"), 10.0, ["structure_id", "chain_id"])
    return p.select("structure_id", "chain_id", F.col("id_a").alias("i"), F.col("id_b").alias("j"), "dist")


NEIGHBORS = RESIDUES + """,
neighbors AS (SELECT a.structure_id, a.chain_id, a.res_index AS i, b.res_index AS j, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS dist
  FROM residues a JOIN residues b ON a.structure_id = b.structure_id AND a.chain_id = b.chain_id AND a.res_index <> b.res_index
  WHERE sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) <= 10.0)"""


def secondary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = residues(spark, sf_dir).groupBy("structure_id", "chain_id").agg(F.max("res_index").alias("last"))
    starts = ends.withColumn("k", F.explode(F.expr("sequence(0L, last div 20)")))
    both = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), (F.col("k") * 20 + lo).alias("first_res"), (F.col("k") * 20 + hi).alias("last_res"), (F.col("k") * 2 + n).alias("line_no")) for n, (kind, lo, hi) in enumerate((("A", 5, 13), ("B", 15, 19)))]))
    return starts.select("structure_id", "chain_id", both.alias("r")).select("structure_id", "chain_id", "r.*")


SECONDARY = """,
ss_ends AS (SELECT structure_id, chain_id, max(res_index) AS last FROM residues GROUP BY ALL),
ss_starts AS (SELECT structure_id, chain_id, unnest(range(0, last // 20 + 1)) AS k FROM ss_ends),
ss_records AS (SELECT structure_id, chain_id, 'A' AS kind, k * 20 + 5 AS first_res, k * 20 + 13 AS last_res, k * 2 AS line_no FROM ss_starts
  UNION ALL SELECT structure_id, chain_id, 'B', k * 20 + 15, k * 20 + 19, k * 2 + 1 FROM ss_starts)"""


def accessibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = residues(spark, sf_dir)
    asa = F.expr("((structure_id * 13 + res_index * 29) % 100) / 100D")
    return r.withColumn("asa", asa).withColumn("system_asa", F.expr("asa * ((res_index % 10) / 10D)")).withColumn("exposed_area", F.expr("(res_index % 7) * 10D"))


ACCESSIBILITY = RESIDUES + """,
accessibility AS (SELECT *, asa * ((res_index % 10)::DOUBLE / 10) AS system_asa, (res_index % 7)::DOUBLE * 10 AS exposed_area FROM (SELECT *, ((structure_id * 13 + res_index * 29) % 100)::DOUBLE / 100 AS asa FROM residues))"""


#: Letters of a chain; a text gives as many chains as it needs.
PIECE = 120


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All letters of a document that name residues, in chains of 120: doc_id is the document's times 100000 plus the chain's number."""
    d = table(spark, sf_dir, "documents")
    seq = F.translate(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), "BJOUXZ", "")
    d = d.select("doc_id", "source", seq.alias("letters")).where("length(letters) > 0").withColumn("piece", F.explode(F.expr(f"sequence(0, (length(letters) - 1) div {PIECE})")))
    piece = F.substring(F.col("letters"), F.col("piece") * PIECE + 1, F.lit(PIECE))
    return d.select((F.col("doc_id") * 100000 + F.col("piece")).alias("doc_id"), F.col("doc_id").alias("text_id"), F.col("piece").cast("long").alias("piece"), "source", piece.alias("seq"))


SEQUENCES = """
sequences AS (SELECT doc_id * 100000 + piece AS doc_id, doc_id AS text_id, piece, source, substr(letters, (piece * 120 + 1)::INT, 120) AS seq FROM (SELECT *, unnest(range(0, (length(letters) + 119) // 120)) AS piece FROM
  (SELECT doc_id, source, regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[BJOUXZ]', '', 'g') AS letters FROM documents)))"""


#: Letters of a whole text's sequence; a longer line or sentence gives several.
LONGEST = 500


def sequence_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, seqs): all letters of a document that name residues, a sequence for each line or sentence; none: no row."""
    d = table(spark, sf_dir, "documents")
    parts = F.transform(F.split("text", r"\n|(?<=[.!?])\s+"), lambda p: F.translate(F.upper(F.regexp_replace(p, "[^A-Za-z]", "")), "BJOUXZ", ""))
    divided = lambda p: F.transform(F.sequence(F.lit(1), F.length(p), F.lit(LONGEST)), lambda i: F.substring(p, i, F.lit(LONGEST)))
    parts = F.flatten(F.transform(F.filter(parts, lambda p: F.length(p) > 0), divided))
    return d.select("doc_id", "source", parts.alias("seqs")).where("size(seqs) > 0")


def whole_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, doc_id, nth, source, seq): the sequences of whole texts, a row each."""
    out = sequence_lists(spark, sf_dir).select("doc_id", "source", F.posexplode("seqs").alias("nth", "seq"))
    return out.select(F.concat_ws(":", "doc_id", "nth").alias("id"), "doc_id", F.col("nth").cast("long").alias("nth"), "source", "seq")


def alignment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(aln_id, doc_id, seq): the chains of one number of 20 documents are the rows of an alignment; shorter ones end in gaps."""
    return sequences(spark, sf_dir).withColumn("aln_id", F.concat_ws(":", F.expr("text_id div 20"), "piece")).select("aln_id", "doc_id", "seq")


def alignment_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(aln_id, seq_idx, col, letter): the chains of one number of 20 documents as rows of 120 columns."""
    s = alignment_rows(spark, sf_dir)
    s = s.withColumn("seq_idx", F.row_number().over(Window.partitionBy("aln_id").orderBy("doc_id")).cast("long"))
    cells = s.select("aln_id", "seq_idx", "seq", F.explode(F.expr(f"sequence(1, {PIECE})")).alias("col"))
    letter = F.expr("if(col <= length(seq), substr(seq, col, 1), '-')")
    return cells.select("aln_id", "seq_idx", F.col("col").cast("long").alias("col"), letter.alias("letter"))


ALIGNMENTS = SEQUENCES + """,
cells AS (SELECT aln_id, seq_idx, col, CASE WHEN col <= length(seq) THEN substr(seq, col::INT, 1) ELSE '-' END AS letter
  FROM (SELECT aln_id, row_number() OVER (PARTITION BY aln_id ORDER BY doc_id) AS seq_idx, seq, unnest(range(1, 121)) AS col FROM (SELECT *, (text_id // 20) || ':' || piece AS aln_id FROM sequences)))"""


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values over time: twenty spectra for every 160 users, so that their number grows with the table and their length does not."""
    e = table(spark, sf_dir, "events")
    micros = F.expr("unix_micros(cast(ts as timestamp)) - unix_micros(timestamp'2024-01-01 00:00:00')")
    e = e.select(F.expr("user_id div 160 * 20 + user_id % 20").cast("long").alias("spectrum_id"), micros.alias("t"), F.col("value").cast("double").alias("y"), "event_id")
    n = F.row_number().over(Window.partitionBy("spectrum_id").orderBy("t", "event_id")).cast("long") - 1
    return e.select("spectrum_id", n.alias("idx"), F.expr("800 + 9200D * t / 2592000000000D").alias("x"), "y", F.expr("spectrum_id % 5").alias("timepoint"), F.expr("spectrum_id div 5").alias("replicate"))


SPECTRA = """
spectra AS (SELECT spectrum_id, row_number() OVER (PARTITION BY spectrum_id ORDER BY t, event_id) - 1 AS idx, 800 + 9200.0::DOUBLE * t / 2592000000000.0::DOUBLE AS x, y, spectrum_id % 5 AS timepoint, spectrum_id // 5 AS replicate
  FROM (SELECT (user_id // 160 * 20 + user_id % 20)::BIGINT AS spectrum_id, epoch_us(ts::TIMESTAMP) - epoch_us(TIMESTAMP '2024-01-01') AS t, value::DOUBLE AS y, event_id FROM events))"""


def expected_masses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("fragment_id"), F.expr("800 + p_partkey % 9200 + p_size / 100D").alias("mass"))


MASSES = "\nmasses AS (SELECT p_partkey::BIGINT AS fragment_id, 800 + p_partkey % 9200 + p_size::DOUBLE / 100 AS mass FROM part)"


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, parent_id, level, description): regions, nations, customers and orders."""
    t = lambda n: table(spark, sf_dir, n)
    key = lambda level, c: (F.lit(level * 10**9) + F.col(c)).cast("long")
    return (
        t("region").select(key(1, "r_regionkey").alias("node_id"), F.lit(None).cast("long").alias("parent_id"), F.lit(1).cast("long").alias("level"), F.col("r_name").alias("description"))
        .unionByName(t("nation").select(key(2, "n_nationkey").alias("node_id"), key(1, "n_regionkey").alias("parent_id"), F.lit(2).cast("long").alias("level"), F.col("n_name").alias("description")))
        .unionByName(t("customer").select(key(3, "c_custkey").alias("node_id"), key(2, "c_nationkey").alias("parent_id"), F.lit(3).cast("long").alias("level"), F.col("c_mktsegment").alias("description")))
        .unionByName(t("orders").select(key(4, "o_orderkey").alias("node_id"), key(3, "o_custkey").alias("parent_id"), F.lit(4).cast("long").alias("level"), F.col("o_orderstatus").alias("description")))
    )


TREE = """
nodes AS (SELECT (1000000000 + r_regionkey)::BIGINT AS node_id, NULL::BIGINT AS parent_id, 1::BIGINT AS level, r_name AS description FROM region
  UNION ALL SELECT 2000000000 + n_nationkey, 1000000000 + n_regionkey, 2, n_name FROM nation
  UNION ALL SELECT 3000000000 + c_custkey, 2000000000 + c_nationkey, 3, c_mktsegment FROM customer
  UNION ALL SELECT 4000000000 + o_orderkey, 3000000000 + o_custkey, 4, o_orderstatus FROM orders)"""
