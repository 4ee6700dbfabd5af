"""Particle systems made of the driver's tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.model import ATOMIC_NUMBER

#: idx, residue, chain, residue name, atom name, element of the trajectory's 21 atoms.
EMB_ATOMS = [
    *((k, 1, "A", "ARG", n, e) for k, (n, e) in enumerate(zip("N CA C O CB H".split(), "N C C O C H".split(), strict=True))),
    *((k + 6, 2, "A", "ASP", n, e) for k, (n, e) in enumerate(zip("N CA C O CB".split(), "N C C O C".split(), strict=True))),
    *((k + 11, 3, "B", "PHE", n, e) for k, (n, e) in enumerate(zip("N CA C O CB CG".split(), "N C C O C C".split(), strict=True))),
    *((k + 17, 4, "W", "HOH", n, e) for k, (n, e) in enumerate(zip("OW HW1 HW2".split(), "O H H".split(), strict=True))),
    (20, 5, "L", "LIG", "CL1", "CL"),
]
PART_ELEMENTS = {"ECONOMY": "C", "LARGE": "N", "MEDIUM": "O", "PROMO": "S", "SMALL": "H", "STANDARD": "CL"}
PART_RESIDUES = "ALA ARG ASN ASP CYS GLN GLU GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL HOH SOL LIG DA HSD".split()
PART_NAMES = "N CA C O CB CG CD1 OW".split()


def embeddings_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame for each vector."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("frame"), "embedding")
    at = lambda k: F.element_at("embedding", k + 1).cast("double") * 20.0
    atoms = F.array(*(F.struct(F.lit(i).cast("long").alias("idx"), F.lit(ATOMIC_NUMBER[e]).alias("type_id"), F.lit(e).alias("element"), *(at(3 * i + k).alias(c) for k, c in enumerate("xyz")), F.lit(r).alias("residue_id"), F.lit(ch).alias("chain_id"), F.lit(n).alias("name"), F.lit(res).alias("resname")) for i, r, ch, res, n, e in EMB_ATOMS))
    rows = rows.select("frame", F.inline(atoms))
    return rows.withColumn("in_a", F.col("residue_id").isin(1, 3)).withColumn("in_b", ~F.col("residue_id").isin(1, 3))


def part_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame with an atom for each part, on a lattice."""
    k = F.col("p_partkey")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), n.cast("int"))
    element = F.element_at(F.create_map(*(F.lit(x) for kv in PART_ELEMENTS.items() for x in kv)), F.col("p_type"))
    number = F.element_at(F.create_map(*(F.lit(x) for t, e in PART_ELEMENTS.items() for x in (t, ATOMIC_NUMBER[e]))), F.col("p_type"))
    ten, layer = F.floor(k / 10), F.floor(k / 100)
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.lit(0).cast("long").alias("frame"), k.alias("idx"), number.alias("type_id"), element.alias("element"),
        ((k % 10) * 1.6 + F.col("p_size") * 0.01).alias("x"), ((ten % 10) * 1.6 + (F.col("p_size") % 7) * 0.05).alias("y"), (layer * 1.6).alias("z"),
        F.floor(k / 8).cast("int").alias("residue_id"), pick("ABCD", layer % 4 + 1).alias("chain_id"), pick(PART_NAMES, k % 8 + 1).alias("name"), pick(PART_RESIDUES, F.substring("p_brand", 7, 9).cast("int")).alias("resname"),
    )
    return rows.withColumn("in_a", F.col("chain_id").isin("A", "C")).withColumn("in_b", ~F.col("chain_id").isin("A", "C"))


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A molecule with one fragment for each part."""
    size = F.col("p_size")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("mol"), (10 + size % 30).alias("heavy"), F.concat_ws(":", "p_brand", (size % 5).cast("string")).alias("core"), F.col("p_type").alias("rgroup"), (size % 7 + 1).alias("group_heavy"))


def conformers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conformer of 21 atoms for each vector, 50 to a molecule; its energy is the last element."""
    at = lambda k: F.element_at("embedding", k).cast("double") * 20.0
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.floor(F.col("vec_id") / 50).alias("mol"), F.col("vec_id").alias("conformer"), at(64).alias("energy"), F.transform(F.slice("embedding", 1, 63), lambda x: x.cast("double") * 20.0).alias("coords"))


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


#: Elements of a part's chain, by its key.
CHAIN = ("C", "N", "O", "C", "S")


def ring_molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SDF records, a molecule a part: a ring of six carbon atoms, its double bonds drawn one way or the other, a chain of one to four atoms at one and a halogen at another."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"))
    n = (F.col("k") % 4 + 1).cast("int")
    chain = F.transform(F.sequence(F.lit(0), n - 1), lambda c: F.element_at(F.array(*map(F.lit, CHAIN)), ((F.floor(F.col("k") / 4) + c) % 5 + 1).cast("int")))
    elements = F.concat(F.array(*[F.lit("C")] * 6), chain, F.array(F.when(F.col("k") % 3 == 0, "F").when(F.col("k") % 3 == 1, "Cl").otherwise("Br")))
    atoms = F.transform(elements, lambda e, i: F.format_string("%10.4f%10.4f%10.4f %-3s 0  0", i.cast("double"), (F.col("k") % 10).cast("double"), F.lit(0.0), e))
    bond = lambda i, j, o: F.format_string("%3d%3d%3d", i.cast("int"), j.cast("int"), o.cast("int"))
    ring = F.array(*(bond(F.lit(i + 1), F.lit((i + 1) % 6 + 1), F.lit(1) + (F.col("k") + i) % 2) for i in range(6)))
    line = F.transform(F.sequence(F.lit(0), n - 1), lambda c: bond(F.when(c == 0, 1).otherwise(c + 6), c + 7, F.lit(1)))
    bonds = F.concat(ring, line, F.array(bond(F.col("k") % 5 + 2, n + 7, F.lit(1))))
    counts = F.format_string("%3d%3d  0  0  0  0            999 V2000", F.size(elements), F.size(bonds))
    return part.select("k", F.concat_ws("\n", F.format_string("part%d\n\n", F.col("k")), counts, F.array_join(atoms, "\n"), F.array_join(bonds, "\n"), F.lit("M  END"), F.lit("$$$$")).alias("value"))


#: The same as tables a (mol, idx, element, hydrogens) and b (mol, i, j, o, ring).
RING_SQL = (
    f"p AS (SELECT p_partkey AS k, p_partkey % 4 + 1 AS n FROM part), e AS (SELECT k, c - 1 AS idx, 'C' AS element FROM p, range(1, 7) r(c) UNION ALL SELECT k, 6 + c, {_sql_list(CHAIN)}[(k // 4 + c) % 5 + 1] FROM p, range(0, 4) r(c) WHERE c < n "
    "UNION ALL SELECT k, 6 + n, ['F', 'CL', 'BR'][k % 3 + 1] FROM p), b AS (SELECT k, c AS i, (c + 1) % 6 AS j, 1 + (k + c) % 2 AS o, true AS ring FROM p, range(0, 6) r(c) "
    "UNION ALL SELECT k, CASE c WHEN 0 THEN 0 ELSE c + 5 END, c + 6, 1, false FROM p, range(0, 4) r(c) WHERE c < n UNION ALL SELECT k, k % 5 + 1, 6 + n, 1, false FROM p), "
    "d AS (SELECT k, idx, o, other FROM (SELECT k, i AS idx, j AS other, o FROM b UNION ALL SELECT k, j, i, o FROM b)), v AS (SELECT k, idx, sum(o) AS used, count(*) AS degree FROM d GROUP BY ALL), "
    "a AS (SELECT e.k, e.idx, e.element, (CASE e.element WHEN 'C' THEN 4 WHEN 'N' THEN 3 WHEN 'O' THEN 2 WHEN 'S' THEN 2 ELSE 1 END - used)::INT AS hydrogens, degree, e.idx < 6 AS ring FROM e JOIN v USING (k, idx))"
)
EMB_SQL = (
    "emb_atoms(idx, residue_id, chain_id, resname, name, element, type_id) AS (VALUES "
    + ", ".join(f"({i}::BIGINT, {r}, '{c}', '{res}', '{n}', '{e}', {ATOMIC_NUMBER[e]})" for i, r, c, res, n, e in EMB_ATOMS)
    + "), s AS (SELECT e.vec_id AS frame, a.idx, a.type_id, a.element, "
    + ", ".join(f"CAST(e.embedding[3 * a.idx + {k + 1}] AS DOUBLE) * 20 AS {c}" for k, c in enumerate("xyz"))
    + ", a.residue_id, a.chain_id, a.name, a.resname, a.residue_id IN (1, 3) AS in_a, a.residue_id NOT IN (1, 3) AS in_b FROM embeddings e CROSS JOIN emb_atoms a)"
)
PART_SQL = (
    "s AS (SELECT *, chain_id IN ('A', 'C') AS in_a, chain_id NOT IN ('A', 'C') AS in_b FROM (SELECT 0::BIGINT AS frame, p_partkey AS idx, "
    + "CASE p_type " + " ".join(f"WHEN '{t}' THEN {ATOMIC_NUMBER[e]}" for t, e in PART_ELEMENTS.items()) + " END AS type_id, "
    + "CASE p_type " + " ".join(f"WHEN '{t}' THEN '{e}'" for t, e in PART_ELEMENTS.items()) + " END AS element, "
    + "(p_partkey % 10) * 1.6e0 + p_size * 0.01e0 AS x, (p_partkey // 10 % 10) * 1.6e0 + (p_size % 7) * 0.05e0 AS y, (p_partkey // 100) * 1.6e0 AS z, "
    + f"(p_partkey // 8)::INT AS residue_id, {_sql_list('ABCD')}[p_partkey // 100 % 4 + 1] AS chain_id, {_sql_list(PART_NAMES)}[p_partkey % 8 + 1] AS name, "
    + f"{_sql_list(PART_RESIDUES)}[CAST(substr(p_brand, 7) AS INT)] AS resname FROM part))"
)
