"""All registered queries: importing the plan modules fills the registry."""

from helixmill.plans import chains, files, spectrometry, structures, surfaces, trees  # noqa: F401
from helixmill.plans.registry import ORACLE_SQL, QUERIES

FLAGSHIP = "sj9_core_residues"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
