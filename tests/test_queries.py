"""Registered queries against their SQL on the smallest tables."""

import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from helixmill.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()
CHOSEN = [
    "pf3_residue_assembly", "pf7_termini", "pf13_pseudo_side_chain", "pf17_atom_class", "pf18_ss_records", "pf24_label_runs", "sj2_neighbors_within", "sj4_bonds", "sj6_contact_scores", "sj9_core_residues", "sj13_differential", "sj20_hydrogen_bonds",
    "sj23_active_site_groups", "sq2_fragments", "sq7_isoelectric_point", "sq13_column_conservation", "sq19_no_bad_loop", "su5_match_keys_4", "sp11_interpolation", "sp18_nearest_fragment", "sp28_peak_profiles", "ex1_site_coverage", "ex5_variants", "sc1_lineage", "sc5_keyword_search", "io1_read_structures", "io17_profile",
]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def _plain(rows):
    return sorted((tuple(float(v) if isinstance(v, (float, Decimal)) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    listed = ", ".join(f'"{c}"' for c in cols)
    want = _plain(duck.execute(f"SELECT {listed} FROM ({catalog.ORACLE_SQL[name]})").fetchall())
    have = _plain([tuple(r) for r in got.select(*cols).collect()])
    assert len(have) == len(want)
    for a, b in zip(have, want):
        assert a == pytest.approx(b, abs=2e-3) if all(isinstance(v, (int, float)) for v in a) else a == b


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(catalog.QUERIES) > 140
