"""Registered queries of readers and writers: the tables are written in a format, read back, and compared with the tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle import model as m
from corpuscle.operators import bondgraph, interactions, residues, spatial, trajectory
from corpuscle.operators.trajectory import pack_frames
from corpuscle.plans.adapters import EMB_SQL, PART_SQL, RING_SQL, embeddings_system, part_system, ring_molecules
from corpuscle.sources import binary, binary_sinks, datasource, formats, sinks
from corpuscle.sources.store import materialize, new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Frames in a file.
FRAMES = 100


def _read(spark: SparkSession, texts: DataFrame, suffix: str, extra: tuple[str, ...], digits: int, frames: int = FRAMES) -> DataFrame:
    """What comes back of frames that were written: frame, idx, columns of the atoms, and coordinates."""
    path = new_path(spark, f"files{suffix}")
    sinks.write_frames(texts, path, frames)
    rows = formats.load(spark, f"{path}/part=*", suffix=suffix).system()
    part = F.regexp_extract("path", r"part=(\d+)", 1).cast("bigint")
    return rows.select((part * frames + F.col("frame")).alias("frame"), "idx", *extra, *((F.round(c, digits) + 0.0).alias(c) for c in "xyz"))


def _add(name: str, system: Callable, sql: str, texts: Callable[[DataFrame], DataFrame], suffix: str, extra: dict[str, str], digits: int, scale: int = 1, frames: int = FRAMES) -> None:
    """extra: columns of the atoms and what they are in SQL. scale: by how much written coordinates are smaller."""
    QUERIES[name] = lambda spark, d: _read(spark, texts(system(spark, d)), suffix, tuple(extra), digits - (scale > 1), frames)
    written = ", ".join(f"round(printf('%.{digits}f', {c} / {scale}e0)::DOUBLE * {scale}, {digits - (scale > 1)}) + 0e0 AS {c}" for c in "xyz")
    ORACLE_SQL[name] = f"WITH {sql} SELECT frame, {_place(system)} AS idx, {', '.join(f'{v} AS {k}' for k, v in extra.items())}{', ' if extra else ''}{written} FROM s"


def _place(system: Callable) -> str:
    """Readers number atoms from 0 in the order of the file."""
    return "row_number() OVER (PARTITION BY frame ORDER BY idx) - 1"


_NAMES = {"element": "element", "type_id": "type_id::INT", "name": "name", "resname": "resname", "chain_id": "chain_id", "residue_id": "residue_id::INT"}
_some = lambda *names: {n: _NAMES[n] for n in names}
_add("read_xyz", embeddings_system, EMB_SQL, sinks.xyz_frames, ".xyz", _some("element", "type_id"), 6)
_add("read_dump", embeddings_system, EMB_SQL, sinks.dump_frames, ".lammpstrj", {"id": "idx", **_some("type_id")}, 6)
_add("read_pdb", embeddings_system, EMB_SQL, sinks.pdb_models, ".pdb", _some("element", "type_id", "name", "resname", "chain_id", "residue_id"), 3)
_add("read_sdf", embeddings_system, EMB_SQL, sinks.sdf_records, ".sdf", _some("element", "type_id"), 4)
#: Atoms of a frame, and so of a file of a format that holds one.
PART_ATOMS = 500
_part_frames = lambda spark, d: part_system(spark, d).withColumn("frame", F.floor(F.col("idx") / PART_ATOMS))
_FRAMES_SQL = PART_SQL.replace("0::BIGINT AS frame", f"p_partkey // {PART_ATOMS} AS frame")
# names of these atoms don't tell hydrogen or chlorine, so elements of the format without them are left out
_add("read_gro", _part_frames, _FRAMES_SQL, sinks.gro_frames, ".gro", _some("name", "resname", "residue_id"), 3, 10, frames=1)
_add("read_cif", _part_frames, _FRAMES_SQL, sinks.cif_blocks, ".cif", {"id": "idx", **_NAMES}, 6, frames=1)
_add("read_data", _part_frames, _FRAMES_SQL, sinks.data_files, ".data", {"id": "idx", "type_id": "(type_id - 1)::INT", "residue_id": "residue_id::INT"}, 6, frames=1)
_add("read_mol2", _part_frames, _FRAMES_SQL, sinks.mol2_files, ".mol2", _some("element", "type_id", "name", "resname", "residue_id"), 6, frames=1)


def _binary(suffix: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = new_path(spark, f"files{suffix}")
        binary_sinks.write_binary(embeddings_system(spark, sf_dir), path, suffix, FRAMES)
        rows = formats.load(spark, f"{path}/part=*", suffix=suffix, split=64 << 10).positions
        part = F.regexp_extract("path", r"part=(\d+)", 1).cast("bigint")
        return rows.select((part * FRAMES + F.col("frame")).alias("frame"), "idx", *((F.round(c, 4) + 0.0).alias(c) for c in "xyz"))

    return query


for _suffix, _sql in ((".dcd", "{c}::FLOAT::DOUBLE"), (".nc", "{c}::FLOAT::DOUBLE"), (".trr", "({c} / 10e0)::FLOAT::DOUBLE * 10e0"), (".xtc", "trunc({c} * 100e0 + CASE WHEN {c} < 0 THEN -0.5e0 ELSE 0.5e0 END) / 1000e0 * 10e0")):
    QUERIES[f"read_{_suffix[1:]}"] = _binary(_suffix)
    ORACLE_SQL[f"read_{_suffix[1:]}"] = f"WITH {EMB_SQL} SELECT frame, idx, " + ", ".join(f"round({_sql.format(c=c)}, 4) + 0e0 AS {c}" for c in "xyz") + " FROM s"


def _mdcrd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text trajectories of AMBER, whose lines are made here: ten columns of eight characters."""
    packed, path = pack_frames(embeddings_system(spark, sf_dir)), new_path(spark, "files.mdcrd")
    cells = F.transform("coords", lambda x: F.format_string("%8.3f", x))
    rows = F.transform(F.sequence(F.lit(0), F.expr("(size(coords) - 1) div 10")), lambda k: F.array_join(F.slice(cells, k * 10 + 1, 10), ""))
    files = packed.groupBy(F.floor(F.col("frame") / FRAMES).alias("part")).agg(F.array_sort(F.collect_list(F.struct("frame", F.array_join(rows, "\n").alias("text")))).alias("f"))
    text = F.concat(F.lit("title\n"), F.array_join(F.transform("f", lambda f: f["text"]), "\n"))
    files.select("part", text.alias("value")).repartition("part").write.partitionBy("part").text(path)
    rows = formats.load(spark, f"{path}/part=*", parser=partial(binary.parse_mdcrd, n_atoms=21, has_box=False)).positions
    part = F.regexp_extract("path", r"part=(\d+)", 1).cast("bigint")
    return rows.select((part * FRAMES + F.col("frame")).alias("frame"), "idx", "x", "y", "z")


QUERIES["read_mdcrd"] = _mdcrd
ORACLE_SQL["read_mdcrd"] = f"WITH {EMB_SQL} SELECT frame, idx, " + ", ".join(f"printf('%.3f', {c})::DOUBLE + 0e0 AS {c}" for c in "xyz") + " FROM s"


def _molecules(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The operator over molecules that are written as SDF records and read in ranges; k is the number in a record's name."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = new_path(spark, "molecules.sdf")
        ring_molecules(spark, sf_dir).select("value").write.text(path)
        rows = datasource.read_molecules(spark, path, 64 << 10)
        rows = rows.select("path", F.regexp_extract("name", r"(\d+)", 1).cast("bigint").alias("mol"), "name", "atoms", "bonds")
        return operator(bondgraph.heavy(rows)).drop("path").withColumnRenamed("mol", "k")

    return query


def _bits(radius: int = 2) -> str:
    """SQL of fingerprints() over the tables of RING_SQL."""
    steps = ["h0 AS (SELECT k, idx, md5(concat_ws(',', element, '0', hydrogens, ring::INT, degree)) AS h FROM a)"]
    steps += [f"h{r} AS (SELECT x.k, x.idx, md5(any_value(x.h) || string_agg(d.o || y.h, '' ORDER BY d.o || y.h)) AS h FROM h{r - 1} x JOIN d USING (k, idx) JOIN h{r - 1} y ON y.k = x.k AND y.idx = d.other GROUP BY x.k, x.idx)" for r in range(1, radius + 1)]
    every = " UNION ALL ".join(f"SELECT k, h FROM h{r}" for r in range(radius + 1))
    return f"WITH {RING_SQL}, {', '.join(steps)}, f AS (SELECT DISTINCT k, ('0x' || substr(h, 1, 8))::BIGINT % 2048 AS bit FROM ({every}))"


_NUMBERS = ("MolWt", "HeavyAtomCount", "NumHDonors", "NumHeteroatoms", "FractionCSP3", "NumValenceElectrons", "NumRotatableBonds", "NumAromaticAtoms", "RingCount")
QUERIES["molecule_descriptors"] = _molecules(lambda h: bondgraph.descriptors(h).select("path", "mol", F.round("MolWt", 3).alias("MolWt"), *(F.col(c).cast("bigint").alias(c) if c != "FractionCSP3" else F.round(c, 6).alias(c) for c in _NUMBERS[1:])))
_OF = lambda table: "CASE element " + " ".join(f"WHEN '{e}' THEN {v}" for e, v in table.items()) + " END"
ORACLE_SQL["molecule_descriptors"] = f"""WITH {RING_SQL}, t AS (SELECT b.k, count(*) AS turns FROM b JOIN v x ON x.k = b.k AND x.idx = b.i JOIN v y ON y.k = b.k AND y.idx = b.j WHERE NOT ring AND x.degree > 1 AND y.degree > 1 GROUP BY b.k)
SELECT k, round(sum({_OF(bondgraph.MASS)} + hydrogens * 1.008e0), 3) AS MolWt, count(*) AS HeavyAtomCount, count(CASE WHEN element = 'N' AND hydrogens > 0 OR element IN ('O', 'S') AND hydrogens = 1 THEN 1 END) AS NumHDonors,
  count(CASE WHEN element <> 'C' THEN 1 END) AS NumHeteroatoms, round(count(CASE WHEN element = 'C' AND NOT ring THEN 1 END) / count(CASE WHEN element = 'C' THEN 1 END)::DOUBLE, 6) AS FractionCSP3,
  sum({_OF(bondgraph.OUTER)} + hydrogens)::BIGINT AS NumValenceElectrons, coalesce(any_value(turns), 0) AS NumRotatableBonds, 6::BIGINT AS NumAromaticAtoms, 1::BIGINT AS RingCount FROM a LEFT JOIN t USING (k) GROUP BY k"""
QUERIES["fingerprint_bits"] = _molecules(lambda h: bondgraph.fingerprints(h).select("path", "mol", F.explode(F.col("bits").cast("array<bigint>")).alias("bit")))
ORACLE_SQL["fingerprint_bits"] = f"{_bits()} SELECT k, bit FROM f"
QUERIES["fingerprint_similarity"] = _molecules(lambda h: bondgraph.tanimoto(p := materialize(bondgraph.fingerprints(h), "prints"), p, 0.6).select("mol_a", "mol_b", F.round("similarity", 6).alias("similarity")))
ORACLE_SQL["fingerprint_similarity"] = f"{_bits()}, n AS (SELECT k, count(*) AS n FROM f GROUP BY k) SELECT mol_a, mol_b, round(s, 6) AS similarity FROM (SELECT x.k AS mol_a, y.k AS mol_b, count(*) / (any_value(nx.n) + any_value(ny.n) - count(*))::DOUBLE AS s FROM f x JOIN f y USING (bit) JOIN n nx ON nx.k = x.k JOIN n ny ON ny.k = y.k GROUP BY x.k, y.k) WHERE s >= 0.6e0"
# two parts are one molecule if their chains and halogens are the same, and these stand as far apart on the ring, either way round
ORACLE_SQL["molecule_names"] = "SELECT count(*) AS n, min(p_partkey) AS first FROM part GROUP BY p_partkey % 4, p_partkey // 4 % 5, p_partkey % 3, least(p_partkey % 5, 4 - p_partkey % 5)"
QUERIES["molecule_names"] = _molecules(lambda h: bondgraph.names(h).groupBy("smiles").agg(F.count("*").alias("n"), F.min("mol").alias("first")).drop("smiles"))
QUERIES["molecule_cuts"] = _molecules(lambda h: bondgraph.fragments(h).groupBy("mol").agg(F.count("*").alias("cuts"), F.min("group_heavy").cast("bigint").alias("least"), F.max("group_heavy").cast("bigint").alias("most")))
ORACLE_SQL["molecule_cuts"] = f"WITH {RING_SQL}, c AS (SELECT b.k, b.j, n, idx FROM b JOIN p USING (k) JOIN a x ON x.k = b.k AND x.idx = b.i JOIN (SELECT k, idx AS at, element FROM a) y ON y.k = b.k AND y.at = b.j WHERE NOT b.ring AND (x.element = 'C' OR y.element = 'C')) SELECT k, 2 * count(*) AS cuts, min(CASE WHEN j = 6 + n THEN 1 ELSE 6 + n - j END) AS least, max(7 + n - CASE WHEN j = 6 + n THEN 1 ELSE 6 + n - j END) AS most FROM c GROUP BY k"
QUERIES["common_substructure"] = _molecules(lambda h: bondgraph.common_substructure(h).select("path", "mol", F.col("n_atoms").cast("bigint").alias("n_atoms"), F.col("n_bonds").cast("bigint").alias("n_bonds"), "n_molecules", F.element_at("atom_map", -1).cast("bigint").alias("last")))
# chains begin with any element, so all molecules share the ring alone
ORACLE_SQL["common_substructure"] = "SELECT p_partkey AS k, 6::BIGINT AS n_atoms, 6::BIGINT AS n_bonds, count(*) OVER () AS n_molecules, 5::BIGINT AS last FROM part"
QUERIES["torsion_lines"] = _molecules(lambda h: bondgraph.torsion_lines(h).where("line LIKE 'TORSDOF%' OR line LIKE 'ATOM%'").groupBy("mol").agg(F.max(F.when(F.col("line").startswith("TORSDOF"), F.substring("line", 9, 9).cast("bigint"))).alias("torsions"), F.count(F.when(F.col("line").startswith("ATOM"), 1)).alias("atoms")))
ORACLE_SQL["torsion_lines"] = f"WITH {RING_SQL} SELECT k, (SELECT count(*) FROM b JOIN v x ON x.k = b.k AND x.idx = b.i JOIN v y ON y.k = b.k AND y.idx = b.j WHERE b.k = p.k AND NOT ring AND x.degree > 1 AND y.degree > 1) AS torsions, 7 + n AS atoms FROM p"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "files.lammpstrj")
    sinks.write_frames(sinks.dump_frames(embeddings_system(spark, sf_dir), 25.0), path, FRAMES)
    return formats.load(spark, f"{path}/part=*", suffix=".lammpstrj").box.select(F.regexp_extract("path", r"part=(\d+)", 1).cast("bigint").alias("part"), "lx", "ly", "lz")


QUERIES["read_dump_box"] = _boxes
ORACLE_SQL["read_dump_box"] = f"SELECT DISTINCT vec_id // {FRAMES} AS part, 25e0 AS lx, 25e0 AS ly, 25e0 AS lz FROM embeddings"


def _topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names from a PDB file of the first frame, all frames from XYZ."""
    system, top, frames = embeddings_system(spark, sf_dir), new_path(spark, "top.pdb"), new_path(spark, "frames.xyz")
    sinks.write_frames(sinks.pdb_models(system.where("frame = 0")), top, 1)
    sinks.write_frames(sinks.xyz_frames(system), frames, FRAMES)
    moves = formats.load(spark, f"{frames}/part=*", suffix=".xyz")
    moves.positions = moves.positions.withColumn("frame", F.regexp_extract("path", r"part=(\d+)", 1).cast("bigint") * FRAMES + F.col("frame"))
    rows = formats.load(spark, f"{top}/part=*", suffix=".pdb").with_trajectory(moves).system()
    return rows.select(F.col("frame").cast("bigint").alias("frame"), "idx", "name", "resname", *((F.round(c, 6) + 0.0).alias(c) for c in "xyz"))


QUERIES["topology_trajectory"] = _topology
ORACLE_SQL["topology_trajectory"] = f"WITH {EMB_SQL} SELECT frame, idx, name, resname, " + ", ".join(f"printf('%.6f', {c})::DOUBLE + 0e0 AS {c}" for c in "xyz") + " FROM s"

def _several(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The operator over many files that are loaded together: an XYZ file of FRAMES frames is a system, whose names come from one PDB file."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        system, top, path = embeddings_system(spark, sf_dir), new_path(spark, "top.pdb"), new_path(spark, "several.xyz")
        sinks.write_frames(sinks.pdb_models(system.where("frame = 0")), top, 1)
        sinks.write_frames(sinks.xyz_frames(system), path, FRAMES)
        files = formats.load(spark, f"{top}/part=*", suffix=".pdb").with_trajectory(formats.load(spark, f"{path}/part=*", suffix=".xyz"))
        found = operator(files.system().withColumn("sys", F.regexp_extract("path", r"part=(\d+)", 1).cast("bigint")).drop("path"))
        return found.select(*(F.round(c, 4).alias(c) if k == "double" else c for c, k in found.dtypes))

    return query


_FILES = f"WITH {EMB_SQL}, f AS (SELECT frame // {FRAMES} AS sys, (frame % {FRAMES})::INT AS frame, idx, element, resname, residue_id, " + ", ".join(f"printf('%.6f', {c})::DOUBLE AS {c}" for c in "xyz") + " FROM s)"
_GAP = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"
for _name, _operator, _sql in (
    ("files_rmsd", trajectory.rmsd_to_frame, f"SELECT a.sys, a.frame, round(sqrt(sum({_GAP}) / count(*)), 4) AS rmsd FROM f a JOIN f b ON a.sys = b.sys AND a.idx = b.idx AND b.frame = 0 GROUP BY a.sys, a.frame"),
    ("files_rmsf", trajectory.rmsf, "SELECT sys, idx, round(sqrt(var_pop(x) + var_pop(y) + var_pop(z)), 4) AS rmsf FROM f GROUP BY sys, idx"),
    ("files_bonds", lambda s: spatial.bonds_within(s, 2.5), f"SELECT a.sys, a.frame, a.idx AS i, b.idx AS j FROM f a JOIN f b ON a.sys = b.sys AND a.frame = b.frame AND a.idx < b.idx WHERE {_GAP} <= 6.25e0"),
    ("files_residues", residues.list_residues, "SELECT sys, frame, chain_id, residue_id, resname, n_atoms FROM (SELECT frame // {n} AS sys, (frame % {n})::INT AS frame, chain_id, residue_id::INT AS residue_id, arg_min(resname, idx) AS resname, count(*) AS n_atoms FROM s GROUP BY 1, 2, 3, 4)".format(n=FRAMES)),
    ("files_salt_bridges", lambda s: interactions.salt_bridges(s.withColumn("in_a", F.col("residue_id") <= 2).withColumn("in_b", F.lit(True))).select("sys", "frame", "i", "j", "distance"), f"SELECT a.sys, a.frame, a.idx AS i, b.idx AS j, round(sqrt({_GAP}), 4) AS distance FROM f a JOIN f b ON a.sys = b.sys AND a.frame = b.frame WHERE a.resname IN {m.POSITIVE} AND b.resname IN {m.NEGATIVE} AND (a.residue_id <= 2 OR b.residue_id <= 2) AND {_GAP} <= 16e0"),
):
    QUERIES[_name], ORACLE_SQL[_name] = _several(_operator), f"{_FILES} {_sql}"

_LAST = "lag({}) OVER (PARTITION BY frame ORDER BY idx)"
_CHANGED = f"CASE WHEN {_LAST.format('chain_id')} <> chain_id THEN printf('TER   %5d      %-4s%s%4d', idx % 100000, {_LAST.format('resname')}, {_LAST.format('chain_id')}, {_LAST.format('residue_id')} % 10000) || chr(10) ELSE '' END"
_RECORD = "printf('ATOM  %5d %-4s %-4s%s%4d    %8.3f%8.3f%8.3f  1.00  0.00          %2s', (idx + 1) % 100000, CASE WHEN length(name) < 4 AND length(element) = 1 THEN ' ' || name ELSE name END, resname, chain_id, residue_id % 10000, x, y, z, element)"
QUERIES["pdb_lines"] = lambda spark, d: sinks.pdb_lines(part_system(spark, d)).select("idx", "line")
ORACLE_SQL["pdb_lines"] = f"WITH {PART_SQL} SELECT idx, {_CHANGED} || {_RECORD} AS line FROM s"
QUERIES["pdbqt_lines"] = lambda spark, d: sinks.pdbqt_lines(sinks.pdb_lines(part_system(spark, d)).select(F.regexp_replace("line", "^TER.*\n", "").alias("value")))
_AD = "CASE element " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in sinks.AUTODOCK.items()) + " ELSE 'C' END"
ORACLE_SQL["pdbqt_lines"] = f"WITH {PART_SQL} SELECT substr({_RECORD}, 1, 66) || '    +0.000 ' || printf('%-2s', {_AD}) AS line FROM s WHERE resname NOT IN ({', '.join(repr(w) for w in m.WATERS)})"
QUERIES["csv_rows"] = lambda spark, d: sinks.csv_rows(part_system(spark, d))
ORACLE_SQL["csv_rows"] = f"WITH {PART_SQL} SELECT idx AS id, element, resname, CASE WHEN residue_id = 0 THEN '' ELSE residue_id::VARCHAR END AS residue_id, chain_id, name, printf('%.4f', x) AS x, printf('%.4f', y) AS y, printf('%.4f', z) AS z FROM s"
QUERIES["generic_csv"] = lambda spark, d: sinks.generic_csv(spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_acctbal", (F.col("c_acctbal") / 1e7).alias("small"), (F.col("c_acctbal") * 1e5).alias("large")))
ORACLE_SQL["generic_csv"] = "SELECT c_custkey::VARCHAR AS c_custkey, printf('%g', c_acctbal) AS c_acctbal, printf('%g', c_acctbal / 1e7) AS small, printf('%g', c_acctbal * 1e5) AS large FROM customer"


def _poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A docking program's output of nine poses for each part, written and read."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    path = new_path(spark, "poses")
    text = F.array_join(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(9)), lambda k: F.array(F.concat(F.lit("MODEL "), k.cast("string")), F.format_string("REMARK VINA RESULT:    %.1f      0.000      0.000", (k * 0.5 - F.col("p_size")).cast("double")), F.lit("ENDMDL")))), "\n")
    parts.select((F.col("p_partkey") % 16).alias("part"), F.concat(F.lit("REMARK FILE "), F.col("p_partkey").cast("string"), F.lit("\n"), text).alias("value")).repartition("part").write.partitionBy("part").text(path)
    files = spark.read.option("lineSep", "REMARK FILE ").text(path).where("trim(value) <> ''").select(F.regexp_extract("value", r"^(\d+)", 1).alias("path"), F.posexplode(F.split("value", "\n")).alias("n", "value"))
    return sinks.pdbqt_poses(files).select(F.col("path").cast("bigint").alias("p_partkey"), "pose", "score")


QUERIES["docking_poses"] = _poses
ORACLE_SQL["docking_poses"] = "SELECT p_partkey, k::INT AS pose, round(k * 0.5e0 - p_size, 1) AS score FROM part, unnest(range(1, 10)) t(k)"
