"""Schemas and fixed dimension tables.

A system is a DataFrame with frame, idx, type_id, element, x, y, z, residue_id, chain_id, name and resname: atoms joined with
their positions. Where several are loaded together, a column sys or path tells them apart, and every operator keeps it: what it
groups, joins, numbers and returns is keyed by those of sys, path and frame that its input has.
Lookups become map literals, so they need no join at all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ATOMS = "idx bigint, id bigint, type_id int, element string, charge double, mass double, residue_id int, chain_id string, name string, resname string"
POSITIONS = "frame int, idx bigint, x double, y double, z double"
BONDS = "i bigint, j bigint"

# Radii in Angstrom, by element.
CONTACT_RADIUS = {"H": 1.20, "C": 1.70, "N": 1.55, "O": 1.52, "S": 1.80, "P": 1.80, "F": 1.47, "CL": 1.75, "BR": 1.85, "I": 1.98}
SURFACE_RADIUS = CONTACT_RADIUS | {"FE": 1.47, "ZN": 1.39, "MG": 1.73, "CA": 1.97, "NA": 2.27, "K": 2.75}
COVALENT_RADIUS = {"H": 0.31, "C": 0.76, "N": 0.71, "O": 0.66, "S": 1.05, "P": 1.07, "F": 0.57, "CL": 1.02, "BR": 1.20, "I": 1.39, "FE": 1.32, "ZN": 1.22, "MG": 1.41, "CA": 1.76, "NA": 1.66, "K": 2.03, "CU": 1.32, "MN": 1.61, "SE": 1.20, "SI": 1.11}
DEFAULT_RADIUS, DEFAULT_COVALENT = 1.70, 0.77
# The Kyte-Doolittle scale.
HYDROPATHY = {"ILE": 4.5, "VAL": 4.2, "LEU": 3.8, "PHE": 2.8, "CYS": 2.5, "MET": 1.9, "ALA": 1.8, "GLY": -0.4, "THR": -0.7, "SER": -0.8, "TRP": -0.9, "TYR": -1.3, "PRO": -1.6, "HIS": -3.2, "HSD": -3.2, "HSE": -3.2, "GLU": -3.5, "GLN": -3.5, "ASP": -3.5, "ASN": -3.5, "LYS": -3.9, "ARG": -4.5}
# Model pKa of ionisable residues.
MODEL_PKA = {"ASP": 3.8, "GLU": 4.2, "HIS": 6.5, "HSD": 6.5, "HSE": 6.5, "CYS": 8.3, "TYR": 10.1, "LYS": 10.5, "ARG": 12.5}
# Residue names by class.
AMINO_ACIDS = ("ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "GLU", "GLY", "HIS", "ILE", "LEU", "LYS", "MET", "PHE", "PRO", "SER", "THR", "TRP", "TYR", "VAL")
AMINO_VARIANTS = ("HSD", "HSE", "HSP", "HIE", "HID", "HIP", "CYX", "CYM", "ASH", "GLH", "LYN")
NUCLEOTIDES = ("DA", "DT", "DG", "DC", "A", "U", "G", "C")
WATERS = ("HOH", "WAT", "TIP", "TIP3", "SPC", "SOL", "H2O")
DENSITY_WATERS, DENSITY_OXYGENS = ("HOH", "WAT", "TIP3", "TIP3P", "SOL", "H2O"), ("O", "OW", "OH2", "O1")
POSITIVE, NEGATIVE = ("ARG", "LYS", "HIS", "HSD", "HSE", "HSP"), ("ASP", "GLU")
POLAR, HYDROPHOBIC = ("SER", "THR", "ASN", "GLN", "TYR", "CYS"), ("ALA", "VAL", "ILE", "LEU", "MET", "PHE", "TRP", "PRO", "GLY")
AROMATIC = ("PHE", "TYR", "TRP", "HIS", "HSD", "HSE", "HSP")
BACKBONE = ("N", "CA", "C", "O")
ONE_LETTER = {"ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V"}
SEQUENCE_LETTER = ONE_LETTER | {"DA": "A", "DT": "T", "DG": "G", "DC": "C", "A": "A", "U": "U", "G": "G", "C": "C", "HSD": "H", "HSE": "H", "HSP": "H"}
# Atomic numbers by element, for the type ids of file formats.
ATOMIC_NUMBER = {"H": 1, "C": 6, "N": 7, "O": 8, "F": 9, "NA": 11, "MG": 12, "P": 15, "S": 16, "CL": 17, "K": 19, "CA": 20, "MN": 25, "FE": 26, "CU": 29, "ZN": 30, "SE": 34, "BR": 35, "I": 53}

# Distances and angle of interactions, probe radius and points of surfaces.
HBOND_DISTANCE, HBOND_ANGLE, HYDROGEN_DISTANCE = 3.5, 120.0, 1.2
SALT_BRIDGE, HALOGEN_BOND, HALOGEN_CARBON, PI_STACK, VDW_OVERLAP, HYDROPHOBIC_CONTACT = 4.0, 3.5, 2.1, 5.5, 0.4, 4.0
PROBE, SPHERE_POINTS = 1.4, 92


#: Columns that tell systems apart, and with the frame what keeps atoms together.
SYSTEM_KEYS = ("sys", "path")
KEYS = (*SYSTEM_KEYS, "frame")


def keys(*tables: DataFrame) -> list[str]:
    """The keys that all tables have."""
    return [k for k in KEYS if all(k in t.columns for t in tables)]


def system_keys(*tables: DataFrame) -> list[str]:
    return [k for k in SYSTEM_KEYS if all(k in t.columns for t in tables)]


def beside(rows: DataFrame, few: DataFrame) -> DataFrame:
    """rows with the columns of few, which has one row for each system; without systems, one row."""
    on = system_keys(rows, few)
    return rows.join(few, on) if on else rows.crossJoin(F.broadcast(few))


def large(rows: DataFrame) -> DataFrame:
    """rows for a join whose sides both grow with the input: sorted and never broadcast, which the planner's estimates of exploded or compressed rows would allow."""
    return rows.hint("merge")


def lookup(table: dict[str, object], key: Column, default: object = None) -> Column:
    """The value of upper(key), else default."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.element_at(F.create_map(*pairs), F.upper(key))
    return F.coalesce(found, F.lit(default)) if default is not None else found


def among(col: Column, values: tuple[str, ...]) -> Column:
    """Two-valued membership of upper(col): null is in no set."""
    return F.coalesce(F.upper(col).isin(*values), F.lit(False))


def sphere(n: int = SPHERE_POINTS) -> list[tuple[float, float, float]]:
    """n points on the unit sphere by the golden-ratio lattice."""
    golden = (1 + math.sqrt(5)) / 2
    out = []
    for i in range(n):
        polar, turn = math.acos(1 - 2 * (i + 0.5) / n), 2 * math.pi * i / golden
        out.append((math.sin(polar) * math.cos(turn), math.sin(polar) * math.sin(turn), math.cos(polar)))
    return out
