"""Queries over the derived classification tree, and over variants of fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.functions import lookups as L
from helixmill.operators import classify as K
from helixmill.operators import explain as E
from helixmill.operators import sequences as Q
from helixmill.plans.chains import FRAGS, MODS, SITES, _map, _sites
from helixmill.plans.registry import query, rounded
from helixmill.sources import fixtures as X

T = X.TREE
CLOSED = "RECURSIVE " + T.strip() + """,
up AS (SELECT node_id AS ancestor, node_id, 0 AS steps FROM nodes UNION ALL SELECT n.parent_id, u.node_id, u.steps + 1 FROM up u JOIN nodes n ON n.node_id = u.ancestor WHERE n.parent_id IS NOT NULL)"""


@query("sc1_lineage", CLOSED, "SELECT u.node_id, string_agg(n.level || ': ' || n.description, ' > ' ORDER BY u.steps DESC) AS lineage FROM up u JOIN nodes n ON n.node_id = u.ancestor GROUP BY 1")
def sc1(spark, d):
    return K.lineage(X.tree(spark, d))


@query("sc2_closure", CLOSED, "SELECT ancestor, node_id, steps FROM up")
def sc2(spark, d):
    return K.closure(X.tree(spark, d))


DOMAINS = T + """,
domains AS (SELECT (4000000000 + o_orderkey)::BIGINT AS node_id, lpad((o_orderkey % 5000)::VARCHAR, 4, '0') AS pdbid, 'd' || lpad((o_orderkey % 5000)::VARCHAR, 4, '0') || 'a_' AS sid,
  'a.' || (o_custkey % 3) || '.' || (o_orderkey % 2) || '.' || (o_orderkey % 11) AS sccs, o_custkey AS set_id FROM orders)"""


def _domains(spark, d) -> DataFrame:
    o = X.table(spark, d, "orders")
    pdb = F.lpad(F.expr("o_orderkey % 5000").cast("string"), 4, "0")
    return o.select((F.lit(4 * 10**9) + F.col("o_orderkey")).cast("long").alias("node_id"), pdb.alias("pdbid"), F.concat(F.lit("d"), pdb, F.lit("a_")).alias("sid"), F.expr("concat('a.', o_custkey % 3, '.', o_orderkey % 2, '.', o_orderkey % 11)").alias("sccs"), F.col("o_custkey").alias("set_id"))


@query("sc3_domain_lookup", DOMAINS, "SELECT node_id, pdbid, sid FROM (SELECT *, row_number() OVER (PARTITION BY pdbid ORDER BY node_id) AS k FROM domains WHERE starts_with(pdbid, '00')) WHERE k = 1")
def sc3(spark, d):
    return K.find_domains(_domains(spark, d), "pdbid", "00", first_only=True).select("node_id", "pdbid", "sid")


@query("sc4_same_levels", DOMAINS, "SELECT set_id, count(DISTINCT split_part(sccs, '.', 1)) = 1 AS same_class, count(DISTINCT split_part(sccs, '.', 1) || '.' || split_part(sccs, '.', 2)) = 1 AS same_fold, count(DISTINCT split_part(sccs, '.', 1) || '.' || split_part(sccs, '.', 2) || '.' || split_part(sccs, '.', 3)) = 1 AS same_superfamily, count(DISTINCT sccs) = 1 AS same_family FROM domains GROUP BY 1")
def sc4(spark, d):
    return K.same_levels(_domains(spark, d), "set_id")


HITS = CLOSED + """,
comments AS (SELECT DISTINCT (3000000000 + o_custkey)::BIGINT AS node_id, o_orderpriority AS comment FROM orders WHERE o_orderkey % 7 = 0),
cm AS (SELECT node_id, string_agg(comment, chr(10) ORDER BY comment) AS comment FROM comments GROUP BY 1),
raw_hits AS (SELECT n.node_id, level, description FROM nodes n LEFT JOIN cm USING (node_id) WHERE (regexp_matches(description, '(?i)a') OR coalesce(regexp_matches(comment, '(?i)a'), false)) AND (regexp_matches(description, '(?i)i') OR coalesce(regexp_matches(comment, '(?i)i'), false)) AND NOT (regexp_matches(description, '(?i)mach') OR coalesce(regexp_matches(comment, '(?i)mach'), false)) AND level IN (2, 3)),
hits AS (SELECT * FROM raw_hits WHERE node_id NOT IN (SELECT u.node_id FROM up u JOIN raw_hits h ON h.node_id = u.ancestor WHERE steps > 0))"""


def _hits(spark, d) -> DataFrame:
    comments = X.table(spark, d, "orders").where("o_orderkey % 7 = 0").select((F.lit(3 * 10**9) + F.col("o_custkey")).cast("long").alias("node_id"), F.col("o_orderpriority").alias("comment")).distinct()
    return K.keyword_hits(X.tree(spark, d), ["a", "i"], ["mach"], [2, 3], comments)


@query("sc5_keyword_search", HITS, "SELECT node_id, level, description FROM hits")
def sc5(spark, d):
    return _hits(spark, d)


@query("sc6_leaves_under_hits", HITS, "SELECT DISTINCT u.ancestor AS hit, u.node_id FROM up u JOIN hits h ON h.node_id = u.ancestor WHERE u.node_id NOT IN (SELECT parent_id FROM nodes WHERE parent_id IS NOT NULL)")
def sc6(spark, d):
    return K.leaves_under(X.tree(spark, d), _hits(spark, d))


@query("sc7_folder_paths", CLOSED, "SELECT u.node_id, string_agg(CASE WHEN length(n.description) > 20 THEN substr(n.description, 1, 20) || '_' || n.node_id ELSE n.description END, '/' ORDER BY u.steps DESC) AS path FROM up u JOIN nodes n ON n.node_id = u.ancestor GROUP BY 1")
def sc7(spark, d):
    return K.folder_paths(X.tree(spark, d))


@query("sc7f_file_location", DOMAINS, "SELECT node_id, substr(sid, 3, 2) || '/' || sid || '.ent' AS location FROM domains")
def sc7f(spark, d):
    return _domains(spark, d).select("node_id", K.file_location(F.col("sid")).alias("location"))


@query("sc8_domains_without_file", DOMAINS, "SELECT node_id, pdbid FROM domains WHERE pdbid NOT IN (SELECT lpad((p_partkey % 5000)::VARCHAR, 4, '0') FROM part)")
def sc8(spark, d):
    files = X.table(spark, d, "part").select(F.lpad(F.expr("p_partkey % 5000").cast("string"), 4, "0").alias("structure_id")).distinct()
    return K.without_files(_domains(spark, d), files).select("node_id", "pdbid")


@query("io14_subtree_profile", HITS, "SELECT h.node_id AS root, 'lineage' AS role, n.node_id, n.parent_id, n.level, n.description FROM hits h JOIN up u ON u.node_id = h.node_id AND steps > 0 JOIN nodes n ON n.node_id = u.ancestor UNION ALL SELECT h.node_id, 'member', n.node_id, n.parent_id, n.level, n.description FROM hits h JOIN up u ON u.ancestor = h.node_id JOIN nodes n ON n.node_id = u.node_id")
def io14(spark, d):
    return K.subtree_profile(X.tree(spark, d), _hits(spark, d))


# --- experiment design and explanations -----------------------------------------------------------------------------
KEYS = "keys AS (SELECT doc_id, p AS key FROM (SELECT doc_id, seq, unnest(range(1, length(seq) + 1)) AS p FROM sequences) WHERE contains('KDE', substr(seq, p::INT, 1)))"


def _frag_sql(name: str, sites: str) -> str:
    return f"{name} AS (SELECT doc_id, s[a::INT] AS first, s[a::INT + 1] AS last FROM (SELECT *, unnest(range(1, len(s))) AS a FROM {sites}))"


BOTH = SITES + ",\n" + _sites("ED", "", False).replace("sites AS", "sites2 AS", 1) + ",\n" + KEYS + ",\n" + _frag_sql("f1", "sites") + ",\n" + _frag_sql("f2", "sites2")


@query("ex1_site_coverage", BOTH, """
, o AS (SELECT doc_id, 'trypsin' AS protease, min(key) AS key FROM f1 JOIN keys USING (doc_id) WHERE key > first AND key < last GROUP BY doc_id, first, last HAVING count(*) = 1
  UNION ALL SELECT doc_id, 'V8', min(key) FROM f2 JOIN keys USING (doc_id) WHERE key > first AND key < last GROUP BY doc_id, first, last HAVING count(*) = 1),
t AS (SELECT doc_id, protease, count(*) AS n_sites FROM keys, (VALUES ('trypsin'), ('V8')) p(protease) GROUP BY ALL)
SELECT t.doc_id, t.protease, n_sites, count(DISTINCT key) AS n_covered FROM t LEFT JOIN o ON o.doc_id = t.doc_id AND o.protease = t.protease GROUP BY ALL""")
def ex1(spark, d):
    return E.site_coverage(X.sequences(spark, d), "KDE", ["trypsin", "V8"])


@query("ex2_obscured_fragments", FRAGS, "SELECT DISTINCT a.doc_id, a.first, a.last FROM frags a JOIN frags b ON a.doc_id = b.doc_id AND NOT (a.first = b.first AND a.last = b.last) WHERE abs(a.weight - b.weight) < 0.005 * b.weight OR abs(a.weight + 45 - b.weight) < 0.005 * b.weight OR abs(a.weight + 45 - b.weight) < 7.0")
def ex2(spark, d):
    return E.obscured(Q.fragments(X.sequences(spark, d), misses=2), 0.005, 45.0)


@query("ex3_second_protease", SITES + ",\n" + _frag_sql("f1", "sites"), """
, parts AS (SELECT DISTINCT doc_id, substr(seq, first::INT + 1, (last - first)::INT) AS seq FROM f1 JOIN sequences USING (doc_id) WHERE last > first),
s3 AS (SELECT doc_id, seq, [0] || list_transform(list_filter(range(1, length(seq)), lambda i: contains('ED', substr(seq, i::INT, 1))), lambda i: i - 1) || [length(seq)] AS s FROM parts),
f3 AS (SELECT doc_id, substr(seq, s[a::INT]::INT + 1, (s[a::INT + 1] - s[a::INT])::INT) AS part FROM (SELECT *, unnest(range(1, len(s))) AS a FROM s3)),
""" + f"w AS (SELECT DISTINCT doc_id, part, 18.0 + coalesce(list_sum(list_transform(string_split(part, ''), lambda c: coalesce({_map(L.RESIDUE_MASS, 'c')}, 0)::DOUBLE)), 0) AS weight, length(part) - length(replace(part, 'K', '')) AS n_sites FROM f3)\nSELECT doc_id, part, round(weight, 2) AS weight, n_sites FROM w WHERE weight BETWEEN 200 AND 10000 AND n_sites = 1")
def ex3(spark, d):
    return rounded(E.second_digest(X.sequences(spark, d), "K", "trypsin", "V8", low=200.0).select("doc_id", "part", "weight", "n_sites"), "weight", digits=2)


START = FRAGS + ",\nstart_ AS (SELECT doc_id, substr(seq, first::INT + 1, (last - first)::INT) AS seq, weight FROM frags JOIN sequences USING (doc_id) WHERE abs(round(weight, 2) - 800.0) <= 10.0)"


def _start(spark, d) -> DataFrame:
    s = X.sequences(spark, d)
    f = E.starting_fragments(rounded(Q.fragments(s, misses=2), "weight", digits=2), 800.0, 10.0).join(s.select("doc_id", "seq"), "doc_id")
    return E.as_variants(f.select("doc_id", F.expr("substr(seq, cast(first as int) + 1, cast(last - first as int))").alias("seq")))


def _mods(spark) -> DataFrame:
    return spark.createDataFrame([*MODS, ("amide", "cterm", -0.98), ("carbamyl", "nterm", 43.03), ("linker", "K-K", 138.2)], "reagent string, targets string, delta double")


@query("ex4_starting_fragments", START, "SELECT doc_id, seq, round(weight, 2) AS weight FROM start_")
def ex4(spark, d):
    return rounded(_start(spark, d).select("doc_id", "seq", "weight"), "weight", digits=2)


MUT = START + f""",
res(c, m) AS (VALUES {', '.join(f"('{c}', {m}::DOUBLE)" for c, m in L.RESIDUE_MASS.items())}),
base AS (SELECT doc_id, seq, '' AS text, weight FROM start_),
pc AS (SELECT *, substr(seq, p::INT + 1, 1) AS old FROM (SELECT *, unnest(range(0, length(seq))) AS p FROM base)),
mut AS (SELECT * FROM base
  UNION ALL SELECT doc_id, substr(seq, 1, p::INT) || substr(seq, p::INT + 2), '-' || old || p || ';', weight - m FROM pc JOIN res ON c = old WHERE length(seq) > 1
  UNION ALL SELECT doc_id, substr(seq, 1, p::INT) || n.c || substr(seq, p::INT + 2), old || p || n.c || ';', weight + n.m - o.m FROM pc JOIN res o ON o.c = old JOIN res n ON n.c <> old WHERE abs(n.m - o.m) >= 0.5
  UNION ALL SELECT doc_id, substr(seq, 1, 1) || c || substr(seq, 2), '+' || c || ';', weight + m FROM base, res)"""


def _mutated(spark, d) -> DataFrame:
    return E.enumerate_mutations(_start(spark, d))


@query("ex5_variants", MUT, "SELECT doc_id, seq, text, round(weight, 2) AS weight FROM mut")
def ex5(spark, d):
    return rounded(_mutated(spark, d).select("doc_id", "seq", "text", "weight"), "weight", digits=2)


MODSQ = START + f""",
mods(reagent, targets, delta) AS (VALUES {', '.join(f"('{a}', '{b}', {c}::DOUBLE)" for a, b, c in [*MODS, ('amide', 'cterm', -0.98), ('carbamyl', 'nterm', 43.03), ('linker', 'K-K', 138.2)])}),
pc AS (SELECT *, substr(seq, p::INT + 1, 1) AS old FROM (SELECT *, unnest(range(0, length(seq))) AS p FROM start_)),
modi AS (SELECT doc_id, seq, '' AS text, weight FROM start_
  UNION ALL SELECT doc_id, substr(seq, 1, p::INT) || 'X' || substr(seq, p::INT + 2), reagent || '@' || p || ';', weight + delta FROM pc JOIN mods ON (targets = 'nterm' AND p = 0) OR (targets = 'cterm' AND p = length(seq) - 1) OR (targets NOT IN ('nterm', 'cterm', 'K-K') AND contains(targets, old))
  UNION ALL SELECT a.doc_id, substr(a.seq, 1, a.p::INT) || 'X' || substr(a.seq, a.p::INT + 2, (b.p - a.p - 1)::INT) || 'X' || substr(a.seq, b.p::INT + 2), 'linker@' || a.p || '-' || b.p || ';', a.weight + 138.2 FROM (SELECT *, row_number() OVER () AS r FROM start_) s JOIN LATERAL (SELECT s.doc_id, s.seq, s.weight, unnest(range(0, length(s.seq))) AS p) a ON true JOIN LATERAL (SELECT unnest(range(0, length(s.seq))) AS p) b ON b.p > a.p WHERE substr(a.seq, a.p::INT + 1, 1) = 'K' AND substr(a.seq, b.p::INT + 1, 1) = 'K')"""


@query("ex6_modifications", MODSQ, "SELECT doc_id, seq, text, round(weight, 2) AS weight FROM modi")
def ex6(spark, d):
    out = E.enumerate_modifications(_start(spark, d), _mods(spark))
    return rounded(out.select("doc_id", "seq", "text", "weight"), "weight", digits=2)


BOTHV = MUT + MODSQ[len(START):].replace("pc AS", "pc2 AS").replace("FROM pc JOIN mods", "FROM pc2 JOIN mods") + ",\nmerged AS (SELECT * FROM mut UNION ALL SELECT * FROM modi)"


def _merged(spark, d) -> DataFrame:
    return _mutated(spark, d).unionByName(E.enumerate_modifications(_start(spark, d), _mods(spark)))


@query("ex7_merged", BOTHV, "SELECT doc_id, count(*) AS n, round(min(weight), 2) AS low, round(max(weight), 2) AS high FROM merged GROUP BY 1")
def ex7(spark, d):
    return rounded(_merged(spark, d).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("weight").alias("low"), F.max("weight").alias("high")), "low", "high", digits=2)


FOUND = BOTHV + ",\nfound AS (SELECT DISTINCT doc_id, round(weight)::BIGINT AS mass_key, seq, text, round(weight, 2) AS weight FROM merged WHERE abs(round(weight)::BIGINT - 815.0) < 0.005 * 815.0)"


def _found(spark, d) -> DataFrame:
    return rounded(E.explanations(_merged(spark, d), 815.0, 0.005), "weight", digits=2)


@query("ex8_filtered", FOUND, "SELECT doc_id, mass_key, seq, text FROM found")
def ex8(spark, d):
    return _found(spark, d).select("doc_id", "mass_key", "seq", "text")


@query("ex9_summary", FOUND, "SELECT doc_id, (CASE WHEN hi > lo THEN least(floor((off - lo) / (hi - lo) * 4)::BIGINT, 3) ELSE 0 END + 1)::BIGINT AS band, count(*) AS n FROM (SELECT *, min(off) OVER () AS lo, max(off) OVER () AS hi FROM (SELECT *, abs(weight - 815.0) AS off FROM found)) GROUP BY ALL")
def ex9(spark, d):
    out = E.explanation_summary(_found(spark, d), 815.0)
    return out.select("doc_id", F.col("band").cast("long").alias("band"), "n")
