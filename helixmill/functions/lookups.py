"""Fixed values of residues, atoms and bonds, and expressions that look them up."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------------------------------------------
RESIDUE_CODE = {
    "ALA": "A", "CYS": "C", "CYD": "C", "CYX": "C", "CYZ": "C", "ASP": "D", "GLU": "E", "PHE": "F", "GLY": "G", "HIS": "H", "HID": "H", "HIE": "H", "ILE": "I",
    "LYS": "K", "LEU": "L", "MET": "M", "ASN": "N", "PRO": "P", "GLN": "Q", "ARG": "R", "SER": "S", "THR": "T", "VAL": "V", "TRP": "W", "TYR": "Y",
}
RESIDUE_MASS = {
    "A": 71.09, "C": 103.15, "D": 115.09, "E": 129.12, "F": 147.18, "G": 57.05, "H": 137.14, "I": 113.16, "K": 128.17, "L": 113.16,
    "M": 131.19, "N": 114.11, "P": 97.12, "Q": 128.14, "R": 156.19, "S": 87.08, "T": 101.11, "V": 99.14, "W": 186.21, "Y": 163.18,
}
WATER_MASS = 18.0
LEAST_ATOMS = {"A": 5, "C": 6, "D": 8, "E": 9, "F": 11, "G": 4, "H": 10, "I": 8, "K": 9, "L": 8, "M": 8, "N": 8, "P": 7, "Q": 9, "R": 11, "S": 6, "T": 7, "V": 7, "W": 14, "Y": 12}
NUCLEOTIDES = ("A", "C", "G", "T", "U")
WATERS = ("HOH", "WAT", "H2O", "IP3", "SOL")
HETERO_WATERS = ("WAT", "HOH", "H2O", "IP3")
RADIUS = {"C": 1.75, "O": 1.4, "N": 1.55, "S": 1.8, "P": 2.0, "H": 1.17, "Z": 3.0}
#: Longest bond by pair of elements; 1.8 where one is not listed.
BOND = {
    "CC": 1.80, "CO": 1.65, "CN": 1.70, "CS": 2.05, "CP": 2.10, "CH": 1.35, "OO": 1.45, "ON": 1.65, "OS": 1.70, "OP": 1.85, "OH": 1.25, "NN": 1.70, "NS": 2.05, "NP": 2.10,
    "NH": 1.30, "SS": 1.75, "SP": 2.10, "SH": 1.65, "PP": 2.30, "PH": 1.75, "HH": 1.05, "ZC": 2.5, "ZO": 2.5, "ZN": 2.5, "ZS": 2.5, "ZP": 2.5, "ZH": 2.5, "ZZ": 2.5,
}
POLARITY = {"buried": "ACFILMVW", "uncharged": "GNPQSTY", "minus": "DE", "plus": "HKR"}
HYDROPHOBICITY = {"A": 8, "R": 0, "N": 0, "D": 0, "C": 4, "Q": 0, "E": 0, "G": 3, "H": 1, "I": 12, "L": 11, "K": 2, "M": 9, "F": 10, "P": 0, "S": 0, "T": 5, "W": 7, "Y": 6, "V": 13}
#: Distances between alpha carbons i-2..i+2 in an ideal helix and strand: (first, second, helix, strand).
IDEAL_DISTANCES = ((-2, 0, 5.6, 6.6), (-2, 1, 5.8, 9.6), (-2, 2, 6.8, 12.6), (-1, 1, 5.6, 6.6), (-1, 2, 5.6, 9.8), (0, 2, 5.5, 6.6))
#: pK of the carboxyl terminus, the amino terminus and, where there is one, the side chain.
PK = {
    "A": (2.4, 9.9), "C": (1.9, 10.8, 8.3), "D": (2.0, 9.9, 3.9), "E": (2.1, 9.5, 4.1), "F": (2.2, 9.2), "G": (2.4, 9.8), "H": (1.8, 9.2, 6.0), "I": (2.3, 9.8), "K": (2.2, 9.2, 10.8), "L": (2.3, 9.7),
    "M": (2.1, 9.3), "N": (2.1, 8.8), "P": (2.0, 10.6), "Q": (2.2, 9.1), "R": (1.8, 9.0, 12.5), "S": (2.2, 9.2, 13.0), "T": (2.1, 9.1, 13.0), "V": (2.2, 9.7), "W": (2.4, 9.4), "Y": (2.2, 9.1, 10.1),
}
#: Donor atoms and acceptor atoms with antecedent; * stands for any residue.
DONORS = (
    ("ARG", "NE"), ("TRP", "NE1"), ("TYR", "OH"), ("ASN", "ND2"), ("GLN", "NE2"), ("ARG", "NH1"), ("ARG", "NH2"), ("CYS", "SG"), ("SER", "OG"), ("THR", "OG1"), ("LYS", "NZ"), ("N-TERMINUS", "N"),
    *((r, "N") for r in ("ALA", "CYS", "ASP", "GLU", "PHE", "GLY", "HIS", "ILE", "LYS", "LEU", "MET", "ASN", "GLN", "ARG", "SER", "THR", "VAL", "TRP", "TYR")),
)
ACCEPTORS = (
    ("*", "O", "C"), ("ASP", "OD1", "CG"), ("ASP", "OD2", "CG"), ("GLU", "OE1", "CD"), ("GLU", "OE2", "CD"), ("MET", "SD", "CE"), ("ASN", "OD1", "CG"), ("GLN", "OE1", "CD"), ("SER", "OG", "CB"), ("THR", "OG1", "CB"), ("TYR", "OH", "CZ"),
)
#: residue, donor atom, partner atoms (bonded, second, third), bond length and hydrogen positions (kind, angle, circle).
HYDROGEN_RULES = (
    ("ARG", "NE", "CD", "CZ", None, 1.00, "bisector", ((0.0, 0.0),)), ("TRP", "NE1", "CD1", "CE2", None, 1.00, "bisector", ((0.0, 0.0),)), ("BACKBONE", "N", "CA", "C", None, 1.00, "peptide", ((4.0, 0.0),)),
    ("TYR", "OH", "CZ", None, "CE2", 1.00, "planar", ((250.0, 0.0), (110.0, 0.0))), ("ASN", "ND2", "CG", None, "OD1", 1.00, "planar", ((120.0, 0.0), (240.0, 0.0))),
    ("GLN", "NE2", "CD", None, "OE1", 1.00, "planar", ((120.0, 0.0), (240.0, 0.0))), ("ARG", "NH1", "CZ", None, "NE", 1.00, "planar", ((120.0, 0.0), (240.0, 0.0))),
    ("ARG", "NH2", "CZ", None, "NE", 1.00, "planar", ((120.0, 0.0), (240.0, 0.0))), ("CYS", "SG", "CB", None, "CA", 1.33, "circle", ((96.0, 0.0),)), ("SER", "OG", "CB", None, "CA", 1.00, "circle", ((110.0, 0.0),)),
    ("THR", "OG1", "CB", None, "CA", 1.00, "circle", ((110.0, 0.0),)), ("ARG", "CA", "CB", None, "CG", 1.00, "circle", ((110.0, 240.0),)),
    ("LYS", "NZ", "CE", None, "CD", 1.01, "circle", ((110.0, 0.0), (110.0, 120.0), (110.0, 240.0))), ("N-TERMINUS", "N", "CA", None, "CB", 1.01, "circle", ((110.0, 0.0), (110.0, 120.0), (110.0, 240.0))),
)
# ------------------------------------------------------------------------------------------------------------------

CODE_RESIDUE = {RESIDUE_CODE[r]: r for r in reversed(RESIDUE_CODE)}


def lookup(table: dict, key: Column) -> Column:
    """The table's value at the key, null where it has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())]), key)


def residue_code(res_type: Column) -> Column:
    return lookup(RESIDUE_CODE, res_type)


def residue_mass(code: Column) -> Column:
    return lookup(RESIDUE_MASS, code)


def atom_radius(atom_type: Column, other: float = 1.7) -> Column:
    return F.coalesce(lookup(RADIUS, F.substring(atom_type, 1, 1)), F.lit(other))


def bond_limit(first: Column, second: Column) -> Column:
    """Longest bond between two elements."""
    both = BOND | {k[::-1]: v for k, v in BOND.items()}
    return F.coalesce(lookup(both, F.concat(first, second)), F.lit(1.8))


def polarity(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, letters in POLARITY.items():
        out = F.when(code.isin(list(letters)), name).otherwise(out)
    return out


def distance(a: str, b: str) -> Column:
    """Euclidean distance of the points with column prefixes a and b."""
    return F.sqrt(sum((F.col(f"{a}{c}") - F.col(f"{b}{c}")) * (F.col(f"{a}{c}") - F.col(f"{b}{c}")) for c in "xyz"))
