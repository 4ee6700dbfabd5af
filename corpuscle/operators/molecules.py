"""Tables of molecules: matched pairs of fragments, and diverse conformers. A toolkit elsewhere makes fragments and conformers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle import model as m


#: Molecules of a core that one task compares with all of its others.
CORE_PART = 1000


def matched_pairs(fragments: DataFrame, most: float = 0.33, part: int = CORE_PART) -> DataFrame:
    """mol_a, mol_b, core, group_a, group_b and ratio of the pairs that share a core and differ in the group on it.

    fragments: mol, heavy (its heavy atoms), core, rgroup, group_heavy. The group of the first molecule may have at most `most` of
    the larger molecule's heavy atoms; of a pair's shared cores the least is taken. The pairs are the result that is asked for.
    A molecule's last group counts where a core occurs twice in it; rows with nulls meet nothing. One side of a core with more than
    `part` molecules is dealt to as many parts as it needs and the other side goes to each, so a core that all share is many tasks' work.
    Two molecules can share several cores only if both have several; no other pairs are shuffled.
    """
    each = fragments.groupBy("mol", "core").agg(F.max(F.struct("rgroup", "group_heavy", "heavy")).alias("f"))
    each = each.withColumn("many", F.count("*").over(Window.partitionBy("mol")) > 1)
    hot = each.groupBy("core").agg(F.ceil(F.count("*") / part).alias("parts")).where("parts > 1")
    each = each.join(hot, "core", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    a, b = (each.select(F.col("mol").alias(f"mol_{s}"), "core", F.col("f.rgroup").alias(f"group_{s}"), F.col("f.group_heavy").alias(f"n_{s}"), F.col("f.heavy").alias(f"heavy_{s}"), F.col("many").alias(f"many_{s}"), "parts") for s in "ab")
    a = a.withColumn("part", F.pmod(F.xxhash64("mol_a"), "parts")).drop("parts")
    b = b.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    ratio = F.col("n_a") / F.greatest("heavy_a", "heavy_b", F.lit(1))

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(m.large(b), ["core", "part"]).where((F.col("mol_a") < F.col("mol_b")) & (F.col("group_a") != F.col("group_b"))).withColumn("ratio", ratio).where(F.col("ratio") <= most)

    one = met(a, b).where(~(F.col("many_a") & F.col("many_b"))).select("mol_a", "mol_b", "core", "group_a", "group_b", "ratio")
    first = met(a.where("many_a"), b.where("many_b")).groupBy("mol_a", "mol_b").agg(F.min(F.struct("core", "group_a", "group_b", "ratio")).alias("p"))
    return one.unionByName(first.select("mol_a", "mol_b", "p.*"))


def diverse_conformers(conformers: DataFrame, window: float = 10.0, least_rmsd: float = 0.5) -> DataFrame:
    """mol, conformer, energy and rank of the conformers that stay.

    conformers: mol, conformer, energy, coords (array of x, y, z of all atoms). By rising energy, one stays if it is within
    `window` of the lowest and at least least_rmsd from each that stayed before; energy 0 or null means none was computed, which passes the
    window. A group is one molecule's conformers; coordinates are compared as they are.
    """
    kinds = {f.name: f.dataType.simpleString() for f in conformers.schema.fields}
    schema = f"mol {kinds['mol']}, conformer {kinds['conformer']}, energy double, rank int"

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(energy=pdf["energy"].fillna(0.0)).sort_values(["energy", "conformer"])
        known = pdf["energy"][pdf["energy"] != 0]
        limit = (known.min() if len(known) else 0.0) + window
        kept, rows = [], []
        for row in pdf.itertuples():
            if row.energy > limit and row.energy != 0:
                continue
            xyz = np.asarray(row.coords, float)
            if not kept or np.sqrt(((np.stack(kept) - xyz) ** 2).sum(1) * 3 / len(xyz)).min() >= least_rmsd:
                kept.append(xyz)
                rows.append((row.mol, row.conformer, row.energy, len(kept)))
        return pd.DataFrame(rows, columns=["mol", "conformer", "energy", "rank"])

    rows = conformers.where("mol is not null and size(coords) > 0").select("mol", "conformer", F.col("energy").cast("double").alias("energy"), "coords")
    return rows.groupBy("mol").applyInPandas(choose, schema)
