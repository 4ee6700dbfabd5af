"""Reports as lines of text."""

from corpuscle.operators import molecules
from corpuscle.sources import sinks


def _lines(report):
    return [r["line"] for r in report.orderBy("n").collect()]


def test_reports_of_tables(spark):
    scan = spark.createDataFrame([(0, 7, "LYS", 1, 2, 1, 3.5), (0, 9, "GLU", 0, 1, 0, 1.0), (0, 8, "SER", 0, 1, 0, 1.0)], "frame int, residue_id int, resname string, d_hbonds int, d_hydrophobic int, d_clashes int, score double")
    assert _lines(sinks.scan_report(scan, 2)) == [
        "ALANINE SCAN  (3 residues)",
        " FRAME   RESID   RES    ΔHB  ΔHYDRO  ΔCLASH    SCORE",
        "-" * 52,
        "     0       7   LYS      1       2       1     3.50  ★",
        "     0       8   SER      0       1       0     1.00",
        "... 1 more",
        "HOT-SPOT RESIDUES: 1",
    ]
    assert _lines(sinks.scan_report(scan.limit(0))) == ["NO RESULTS"]
    sites = spark.createDataFrame([(0, 2, 120.0, 1.5, 4, 1.0, 2.0, None), (0, 1, 1234567890123.0, 2.25, 12, -1.0, 0.5, 3.0)], "frame int, rank int, volume double, score double, lining int, x double, y double, z double")
    assert _lines(sinks.sites_report(sites))[3:] == ["    1  1234567890123.0     2.25        12     -1.00      0.50      3.00", "    2         120.0     1.50         4      1.00      2.00         -"]
    assert _lines(sinks.sites_report(sites.limit(0))) == ["NO BINDING SITES FOUND"]


def test_reports_of_beads_and_waters(spark):
    beads = spark.createDataFrame([(0, "A", 1, 0, "BB", "P5"), (0, "A", 1, 1, "SC1", "C1"), (0, "A", 2, 0, "BB", "P5")], "frame int, chain_id string, residue_id int, bead_order int, bead string, bead_type string")
    assert _lines(sinks.bead_report(beads)) == ["BEAD MAPPING  (3 beads)", " FRAME   RESID   BEAD    TYPE", "-" * 29, "     0       1     BB      P5", "     0       1    SC1      C1", "     0       2     BB      P5", "TYPES: P5 2, C1 1"]
    waters = spark.createDataFrame([(0.0, 1.0, 2.0, 0.25), (5.0, 5.0, 5.0, 0.5)], "x double, y double, z double, density double")
    assert _lines(sinks.density_report(waters, 1)) == ["WATER MAP  (2 hydration sites)", "       X         Y         Z     DENSITY", "-" * 40, "   5.000     5.000     5.000      0.5000", "... 1 more"]
    assert _lines(sinks.bead_report(beads.limit(0))) == ["NO BEAD MAPPING AVAILABLE"] and _lines(sinks.density_report(waters.limit(0))) == ["NO WATER MAP DATA"]


def test_hot_cores_are_dealt_to_parts(spark):
    """A core that a hundred molecules share gives the same pairs in parts of seven, each pair once."""
    rows = [(k, 20, "hot" if k % 10 else f"c{k % 20}", f"g{k % 3}", k % 3 + 1) for k in range(110)] + [(3, 20, None, "g", 1), (None, 20, "hot", "g", 1), (4, 20, "hot", None, 1)]
    table = spark.createDataFrame(rows, "mol int, heavy int, core string, rgroup string, group_heavy int")
    by_hand = {(a[0], b[0], a[2]) for a in rows[:110] for b in rows[:110] if a[0] < b[0] and a[2] == b[2] and a[3] != b[3]}
    for part in (1000, 7):
        found = [(r["mol_a"], r["mol_b"], r["core"]) for r in molecules.matched_pairs(table, part=part).collect()]
        assert len(found) == len(set(found)) and set(found) == by_hand
