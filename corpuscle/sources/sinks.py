"""Writers: CSV, PDB, PDBQT and other formats, and text reports."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle import model as m
from corpuscle.sources.store import materialize


def csv_rows(system: DataFrame) -> DataFrame:
    """The columns of the CSV export as text; a missing value, and residue 0, is empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    number = F.when(F.coalesce("residue_id", F.lit(0)) == 0, "").otherwise(F.col("residue_id").cast("string"))
    return system.select(*m.system_keys(system), F.col("idx").alias("id"), text("element").alias("element"), text("resname").alias("resname"), number.alias("residue_id"), text("chain_id").alias("chain_id"), text("name").alias("name"), *(F.format_string("%.4f", F.col(c)).alias(c) for c in "xyz"))


def write_csv(system: DataFrame, path: str) -> None:
    csv_rows(system).sort("id").write.option("header", True).csv(path)


def pdb_lines(system: DataFrame) -> DataFrame:
    """idx and the record of each atom, after a TER record of the atom before it where the chain changes.

    Columns are fixed: serial numbers start again after 99999 and residue numbers after 9999, as is usual in longer files; a residue name of four
    letters takes the blank column before the chain, longer names, atom names and chains are cut. The atom before is found by
    ranges of idx, so no task orders all atoms of a frame.
    """
    keys = m.keys(system)
    name = F.trim(F.coalesce("name", F.lit("CA")))
    element = F.upper(F.trim(F.coalesce("element", F.lit("C"))))
    name = F.rpad(F.when((F.length(name) < 4) & (F.length(element) == 1), F.concat(F.lit(" "), name)).otherwise(name), 4, " ")
    chain = F.substring(F.coalesce("chain_id", F.lit("A")), 1, 1)
    residue = F.rpad(F.upper(F.trim(F.coalesce("resname", F.lit("UNK")))), 4, " ")
    number = F.format_string("%4d", F.coalesce("residue_id", F.lit(1)).cast("int") % 10000)
    rows = system.withColumn("_of", F.struct(chain.alias("chain"), F.concat(residue, F.rpad(chain, 1, " "), number).alias("text"))).withColumn("_bucket", F.floor(F.col("idx") / 65536))
    last = rows.groupBy(*keys, "_bucket").agg(F.max_by("_of", "idx").alias("_last"))
    last = last.select(*keys, "_bucket", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_last"))
    own = F.lag("_of").over(Window.partitionBy(*keys, "_bucket").orderBy("idx"))
    rows = rows.withColumn("_own", own).join(last, [*keys, "_bucket"]).withColumn("_before", F.coalesce("_own", "_last"))
    record = F.concat(
        F.format_string("ATOM  %5d ", (F.col("idx") + 1) % 100000), name, F.lit(" "), F.col("_of.text"), F.lit("    "), *(F.format_string("%8.3f", F.col(c)) for c in "xyz"),
        F.lit("  1.00  0.00          "), F.lpad(element, 2, " "),
    )
    ended = F.concat(F.format_string("TER   %5d      ", F.col("idx") % 100000), F.col("_before.text"), F.lit("\n"))
    return rows.select(*keys, "idx", F.when(F.col("_before.chain") != chain, F.concat(ended, record)).otherwise(record).alias("line"))


def write_pdb(system: DataFrame, path: str) -> None:
    """One frame as text, with END; the lines are range-partitioned by atom, so part files follow one another."""
    end = system.sparkSession.range(1).select(F.lit((1 << 63) - 1).alias("idx"), F.lit("END").alias("line"))
    pdb_lines(system).select("idx", "line").unionByName(end).repartitionByRange("idx").sortWithinPartitions("idx").select("line").write.text(path)


def frame_texts(system: DataFrame, line: Column, head: Column, tail: Column | None = None, *more: Column) -> DataFrame:
    """frame and the text of each: head, a line for each atom in order of idx, tail. head and tail may use n, the number of atoms, and rows, an array of idx, line and more."""
    keys = m.keys(system)
    each = system.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", line.alias("line"), *more))).alias("rows"), F.count("*").alias("n"))
    parts = [F.array(head), F.transform("rows", lambda r: r["line"]), *([F.array(tail)] if tail is not None else [])]
    return each.select(*keys, F.array_join(F.concat(*parts), "\n").alias("value"))


def _number(c: Column | str, digits: int = 6, width: int = 0) -> Column:
    return F.format_string(f"%{width or ''}.{digits}f", F.col(c) if isinstance(c, str) else c)


def xyz_frames(system: DataFrame) -> DataFrame:
    return frame_texts(system, F.concat_ws(" ", F.coalesce("element", F.lit("X")), *map(_number, "xyz")), F.concat(F.col("n").cast("string"), F.lit("\nframe="), F.col("frame").cast("string")))


def dump_frames(system: DataFrame, box: float = 100.0) -> DataFrame:
    """Frames of a LAMMPS dump; the frame's number is its timestep."""
    sides = "\n".join([f"0 {box:g}"] * 3)
    head = F.concat(F.lit("ITEM: TIMESTEP\n"), F.col("frame").cast("string"), F.lit("\nITEM: NUMBER OF ATOMS\n"), F.col("n").cast("string"), F.lit(f"\nITEM: BOX BOUNDS pp pp pp\n{sides}\nITEM: ATOMS id type x y z"))
    return frame_texts(system, F.concat_ws(" ", (F.col("idx") + 1).cast("string"), F.coalesce("type_id", F.lit(0)).cast("string"), *map(_number, "xyz")), head)


def pdb_models(system: DataFrame) -> DataFrame:
    """Each frame as a MODEL."""
    return frame_texts(pdb_lines(system), F.col("line"), F.format_string("MODEL     %4d", F.col("frame") + 1), F.lit("ENDMDL"))


def gro_frames(system: DataFrame, box: float = 100.0) -> DataFrame:
    """Numbers start again after 99999, as is usual; what residue numbers lack then stands in the title, as the places from which on it is to be added."""
    residue = F.coalesce("residue_id", F.lit(0)).cast("long")
    lack = F.transform("rows", lambda r: r["lack"])
    places = F.filter(F.sequence(F.lit(0), F.size("rows") - 1), lambda k: F.get(lack, k) != F.when(k > 0, F.get(lack, k - 1)).otherwise(0))
    note = F.array_join(F.transform(places, lambda k: F.concat(F.lit(" "), k.cast("string"), F.lit(":"), F.get(lack, k).cast("string"))), "")
    title = F.concat(F.lit("system"), F.when(note != "", F.concat(F.lit(", add to residues:"), note)).otherwise(""), F.lit("\n"))
    line = F.format_string("%5d%-5s%5s%5d%8.3f%8.3f%8.3f", residue % 100000, F.coalesce("resname", F.lit("UNK")), F.coalesce("name", F.lit("X")), (F.col("idx") + 1) % 100000, *(F.col(c) / 10 for c in "xyz"))
    return frame_texts(system, line, F.concat(title, F.col("n").cast("string")), F.lit(" ".join([f"{box / 10:.5f}"] * 3)), (residue - residue % 100000).alias("lack"))


def cif_blocks(system: DataFrame) -> DataFrame:
    names = ("id", "type_symbol", "label_atom_id", "label_alt_id", "label_comp_id", "label_asym_id", "label_seq_id", "Cartn_x", "Cartn_y", "Cartn_z")
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    line = F.concat_ws(" ", F.col("idx").cast("string"), part("element"), part("name"), F.lit("."), part("resname"), part("chain_id"), part("residue_id"), *map(_number, "xyz"))
    return frame_texts(system, line, F.lit("data_system\nloop_\n" + "\n".join(f"_atom_site.{n}" for n in names)), F.lit("#"))


def data_files(system: DataFrame, box: float = 100.0) -> DataFrame:
    """A LAMMPS data file of style full for each frame; residues are molecules."""
    sides = "\n".join(f"0 {box:g} {c}lo {c}hi" for c in "xyz")
    head = F.concat(F.lit("LAMMPS description\n\n"), F.col("n").cast("string"), F.lit(f" atoms\n\n{sides}\n\nAtoms # full\n"))
    return frame_texts(system, F.concat_ws(" ", (F.col("idx") + 1).cast("string"), F.coalesce("residue_id", F.lit(0)).cast("string"), F.coalesce("type_id", F.lit(0)).cast("string"), F.lit("0.0"), *map(_number, "xyz")), head)


def sdf_records(system: DataFrame) -> DataFrame:
    """V2000 records without bonds, of at most 999 atoms."""
    line = F.concat(*(_number(c, 4, 10) for c in "xyz"), F.lit(" "), F.rpad(F.initcap(F.coalesce("element", F.lit("C"))), 3, " "), F.lit(" 0  0"))
    return frame_texts(system, line, F.format_string("%s\n\n\n%3d%3d  0  0  0  0            999 V2000", F.col("frame").cast("string"), F.col("n"), F.lit(0)), F.lit("M  END\n$$$$"))


def mol2_files(system: DataFrame) -> DataFrame:
    line = F.concat_ws(" ", (F.col("idx") + 1).cast("string"), F.coalesce("name", F.lit("X")), *map(_number, "xyz"), F.initcap(F.coalesce("element", F.lit("C"))), F.coalesce("residue_id", F.lit(1)).cast("string"), F.coalesce("resname", F.lit("UNK")), F.lit("0.0"))
    return frame_texts(system, line, F.concat(F.lit("@<TRIPOS>MOLECULE\nsystem\n"), F.col("n").cast("string"), F.lit(" 0 1\nSMALL\nNO_CHARGES\n@<TRIPOS>ATOM")))


def write_frames(texts: DataFrame, path: str, frames: int) -> None:
    """Texts of frames as files of that many frames each, in folders part=0, part=1 ... of path."""
    own = [*m.system_keys(texts), "part"]
    dealt = texts.withColumn("part", F.floor(F.col("frame") / frames)).repartition(*own).sortWithinPartitions(*own, "frame")
    dealt.select(*own, "value").write.partitionBy(*own).text(path)


def generic_csv(rows: DataFrame) -> DataFrame:
    """Any table as CSV text columns: floats with six significant digits as printf's %g has them, nulls empty.

    printf rounds a float's exact value, the JVM's format the shortest digits that tell it, so floats are written in Python.
    """

    @F.arrow_udf("string")
    def general(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f"{v:g}" for v in values.to_pylist()], pa.string())

    def text(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.FloatType | T.DoubleType):
            c = general(c.cast("double"))
        return F.coalesce(c.cast("string"), F.lit("")).alias(f.name)

    return rows.select(*map(text, rows.schema.fields))


# AutoDock types of elements.
AUTODOCK = {"C": "C", "N": "NA", "O": "OA", "S": "SA", "H": "HD", "F": "F", "CL": "Cl", "BR": "Br", "I": "I", "P": "P", "ZN": "Zn", "FE": "Fe", "MG": "Mg", "CA": "Ca"}


def pdbqt_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Receptor lines from those of a PDB file: atoms without waters, charge zero, and the element's type.

    Coordinates that need more than eight characters move the columns after them, the element's too.
    """
    line = F.col(value)
    wider = F.greatest(F.length(F.regexp_extract(line, r"^.{30}((?:\s*-?\d+\.\d{3}){3})", 1)) - 24, F.lit(0))
    element = F.upper(F.trim(F.coalesce(F.nullif(F.trim(F.substring(line, F.lit(77) + wider, F.lit(2))), F.lit("")), F.substring(F.trim(F.substring(line, 13, 4)), 1, 1))))
    atoms = lines.where(line.rlike("^(ATOM|HETATM)") & ~F.upper(F.trim(F.substring(line, 18, 3))).isin(*m.WATERS))
    return atoms.select(F.concat(F.rpad(F.substring(line, 1, 66), 66, " "), F.lit("    +0.000 "), F.rpad(m.lookup(AUTODOCK, element, "C"), 2, " ")).alias("line"))


def box_nm(system: DataFrame, box: tuple[float, float, float] | None = None) -> DataFrame:
    """lx, ly, lz in nanometres: of the given box (in Angstrom), else the atoms' extent and two more."""
    if box is not None:
        return system.sparkSession.createDataFrame([tuple(v / 10 for v in box)], "lx double, ly double, lz double")
    return system.agg(*((F.coalesce(F.max(c) - F.min(c), F.lit(0.0)) / 10 + 2).alias(f"l{c}") for c in "xyz"))


def text_report(rows: DataFrame, label: str, value: str, title: str, top: int = 10) -> DataFrame:
    """n and line of a report: the title, the number, least, mean and greatest value, then the `top` greatest by label."""
    stats = rows.agg(F.count(value).alias("c"), *(F.coalesce(f(value), F.lit(0.0)).alias(n) for f, n in ((F.min, "lo"), (F.avg, "mid"), (F.max, "hi"))))
    head = stats.select(F.posexplode(F.array(F.lit(title), F.concat(F.lit("n "), F.col("c").cast("string")), *(F.concat(F.lit(f"{w} "), F.format_string("%.4f", F.col(c))) for w, c in (("min", "lo"), ("mean", "mid"), ("max", "hi"))))).alias("n", "line"))
    best = rows.where(F.col(value).isNotNull()).orderBy(F.desc(value), label).limit(top)
    best = best.select((F.row_number().over(Window.orderBy(F.desc(value), label)) + 4).alias("n"), F.concat(F.col(label).cast("string"), F.lit("  "), F.format_string("%.4f", F.col(value))).alias("line"))
    return head.unionByName(best)


def _fixed(c: str, digits: int) -> Column:
    return F.when(F.col(c).isNotNull(), F.format_string(f"%.{digits}f", F.col(c).cast("double")))


def table_report(rows: DataFrame, title: str, columns: list[tuple[str, int, Column]], order: list[Column | str], top: int, none: str, tail: Column | None = None) -> DataFrame:
    """n and line of a report: title and number of rows, headings, a rule, the `top` first rows by order (which must tell rows apart), how many more there are, and the tail.

    columns: heading, width and cell; cells are right-aligned and never cut, null ones are "-". title has a %d for the number. tail: an
    aggregate. Without rows the report is the line none.
    """
    rows = materialize(rows, "report")
    heading = "  ".join(f"{h:>{w}}" for h, w, _ in columns)
    texts = [F.format_string(title, F.col("c")), F.lit(heading), F.lit("-" * len(heading))]
    counts = rows.agg(F.count("*").alias("c"), (F.lit("") if tail is None else tail).alias("tail"))
    head = counts.select(F.posexplode(F.when(F.col("c") > 0, F.array(*texts)).otherwise(F.array(F.lit(none)))).alias("n", "line"))
    line = F.concat_ws("  ", *(F.format_string(f"%{w}s", F.coalesce(cell.cast("string"), F.lit("-"))) for _, w, cell in columns))
    body = rows.orderBy(*order).limit(top).select((F.row_number().over(Window.orderBy(*order)) + len(texts) - 1).alias("n"), line.alias("line"))
    more = counts.where(F.col("c") > top).select(F.lit(top + len(texts)).alias("n"), F.format_string("... %d more", F.col("c") - top).alias("line"))
    last = counts.where((F.col("tail") != "") & (F.col("c") > 0)).select(F.lit(top + len(texts) + 1).alias("n"), F.col("tail").alias("line"))
    return reduce(DataFrame.unionByName, (body, more, last), head)


# Titles, headings, widths and numbers of rows of the reports below, and the least score of a hot spot.
HOT_SPOT = 1.5


def scan_report(scan: DataFrame, top: int = 1000) -> DataFrame:
    """An alanine scan by falling score; hot spots have a star, and the last line is their number."""
    hot = F.col("score") >= HOT_SPOT
    score = F.concat(F.format_string("%7s", _fixed("score", 2)), F.when(hot, "  ★").otherwise(""))
    columns = [("FRAME", 6, F.col("frame")), ("RESID", 6, F.col("residue_id")), ("RES", 4, F.col("resname")), ("ΔHB", 5, F.col("d_hbonds")), ("ΔHYDRO", 6, F.col("d_hydrophobic")), ("ΔCLASH", 6, F.col("d_clashes")), ("SCORE", 7, score)]
    tail = F.concat(F.lit("HOT-SPOT RESIDUES: "), F.count(F.when(hot, 1)).cast("string"))
    return table_report(scan, "ALANINE SCAN  (%d residues)", columns, [F.desc("score"), *m.keys(scan), "residue_id"], top, "NO RESULTS", tail)


def bead_report(beads: DataFrame, top: int = 50) -> DataFrame:
    """Beads in order; the last line has the number of each type, the commonest first."""
    kinds = beads.groupBy("bead_type").agg(F.count("*").alias("k")).agg(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), "bead_type"))).alias("t"))
    text = F.array_join(F.transform("t", lambda x: F.concat(x["bead_type"], F.lit(" "), (-x["k"]).cast("string"))), ", ")
    columns = [("FRAME", 6, F.col("frame")), ("RESID", 6, F.col("residue_id")), ("BEAD", 5, F.col("bead")), ("TYPE", 6, F.col("bead_type"))]
    rows = beads.crossJoin(kinds.select(text.alias("kinds")))  # one row
    order = [*m.keys(beads), "chain_id", "residue_id", "bead_order"]
    return table_report(rows, "BEAD MAPPING  (%d beads)", columns, order, top, "NO BEAD MAPPING AVAILABLE", F.concat(F.lit("TYPES: "), F.max("kinds")))


def sites_report(sites: DataFrame, top: int = 20) -> DataFrame:
    """Binding sites by rank: volume, score, number of lining atoms and centre."""
    columns = [("RANK", 5, F.col("rank")), ("VOLUME", 12, _fixed("volume", 1)), ("SCORE", 7, _fixed("score", 2)), ("LINING", 8, F.col("lining")), *((c.upper(), 8, _fixed(c, 2)) for c in "xyz")]
    return table_report(sites, "BINDING SITES  (%d found)", columns, [*m.keys(sites), "rank"], top, "NO BINDING SITES FOUND")


def density_report(sites: DataFrame, top: int = 20) -> DataFrame:
    """Hydration sites (x, y, z and density) by falling density."""
    columns = [*((c.upper(), 8, _fixed(c, 3)) for c in "xyz"), ("DENSITY", 10, _fixed("density", 4))]
    return table_report(sites, "WATER MAP  (%d hydration sites)", columns, [F.desc("density"), *m.system_keys(sites), *"xyz"], top, "NO WATER MAP DATA")


def pdbqt_poses(lines: DataFrame, value: str = "value", order: str = "n") -> DataFrame:
    """Pose number and score of a docking program's output lines (value, and n as their order)."""
    line = F.col(value)
    model = F.when(line.startswith("MODEL"), F.regexp_extract(line, r"MODEL\s+(\d+)", 1).cast("int"))
    pose = F.last(model, ignorenulls=True).over(Window.partitionBy("path").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    rows = lines.withColumn("pose", pose).where(line.startswith("REMARK VINA RESULT"))
    return rows.select("path", "pose", F.regexp_extract(line, r"RESULT:\s+(-?[\d.]+)", 1).cast("double").alias("score"))


