"""What must not grow: copies of points, broadcasts of tables that explode, and rows that steps make again."""

import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from corpuscle.operators import spatial
from corpuscle.sources.store import materialize


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def points(spark, rows):
    return spark.createDataFrame([(0, k, *map(float, p)) for k, p in enumerate(rows)], "frame bigint, idx bigint, x double, y double, z double")


def test_cell_join_never_broadcasts(spark):
    s = points(spark, [(0, 0, 0), (1, 0, 0)])
    for how in ("inner", "left", "left_anti"):
        text = plan(spatial.cell_join(s, s, 2.0, how=how))
        assert "SortMergeJoin" in text and "Broadcast" not in text
    bonds = spatial.bonds_within(s, 2.0)
    for found in (spatial.missing_bonds(bonds.select("frame", "i", "j"), bonds), spatial.bonds_between(bonds, s)):
        assert "Broadcast" not in plan(found)


def test_cell_join_at_edges(spark):
    """Pairs at exactly the cutoff, on cell edges, far from the origin and of either sign; a point is copied to eight cells at most."""
    random.seed(3)
    c = 1.8
    rows = [(i * c, j * c, k * c) for i in range(-3, 4) for j in (-1, 0, 1) for k in (0, 1)]
    rows += [(1e9 + i * c, -1e9, 0.3) for i in range(6)] + [tuple(random.uniform(-6, 6) for _ in range(3)) for _ in range(150)]
    rows += [(float("nan"), 0, 0), (float("inf"), 0, 0), (-1e300, 0, 0), (1e300, 1e18, 0)]
    s = points(spark, rows).union(spark.sql("SELECT 0L, 9999L, CAST(NULL AS DOUBLE), 0D, 0D"))

    def near(p, q, strict):
        d2 = sum((a - b) * (a - b) for a, b in zip(p, q, strict=True))
        return d2 < c * c if strict else d2 <= c * c

    for strict in (False, True):
        want = {(i, j) for i, p in enumerate(rows) for j, q in enumerate(rows) if i < j and near(p, q, strict)}
        found = [tuple(r) for r in spatial.cell_join(s, s, c, condition=F.col("l_idx") < F.col("r_idx"), strict=strict).select("l_idx", "r_idx").collect()]
        assert len(found) == len(set(found)) and set(found) == want and want
    copies = [(spatial._cell(x, c, spatial.SLACK) - spatial._cell(x, c, -spatial.SLACK)).alias(x) for x in "xyz"]
    assert s.select(*copies).agg(F.max(F.greatest(*"xyz"))).first()[0] <= 1


@pytest.fixture
def low_estimates(spark):
    """The planner takes every table to be small enough for a broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(1 << 60))
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_interactions_never_broadcast_atoms(spark, low_estimates):
    from corpuscle.operators import interactions

    kinds = "N H CL C O".split()
    s = materialize(points(spark, [(k * 1.0, 0, 0) for k in range(40)]), "points").select("*", F.element_at(F.array(*map(F.lit, kinds)), (F.col("idx") % 5 + 1).cast("int")).alias("element"), F.lit("ALA").alias("resname"), F.lit(1).alias("residue_id"), (F.col("idx") < 20).alias("in_a"), (F.col("idx") >= 20).alias("in_b"))
    for found in (interactions.halogen_bonds(s), interactions.hbonds(s), interactions.contacts(s)):
        assert "Broadcast" not in plan(found)
    # chlorine k lies one from carbon k + 1, and meets nitrogen and oxygen of the other group up to 3.5 away
    want = {(i, j, i + 1) for i in range(2, 40, 5) for j in range(40) if j % 5 in (0, 4) and (i < 20) != (j < 20) and abs(i - j) <= 3.5}
    assert {(r["i"], r["j"], r["c"]) for r in interactions.halogen_bonds(s).collect()} == want and want


def test_pockets_never_broadcast_points(spark, low_estimates):
    from corpuscle.operators import grids

    # atoms on the faces of a cube enclose one pocket
    side = range(0, 13, 2)
    shell = [(x, y, z) for x in side for y in side for z in side if {x, y, z} & {0, 12}]
    s = materialize(points(spark, shell), "points").withColumn("element", F.lit("C"))
    assert "Broadcast" not in plan(grids.pocket_points(s))
    sites = grids.binding_sites(s)
    assert "Broadcast" not in plan(sites)
    rows = grids.pocket_points(s).select("x", "y", "z").collect()
    want = [p for p in itertools.product(*[[-3.4 + k for k in range(20)]] * 3) if all(math.dist(p, a) >= 3.1 for a in shell) and sum(math.dist(p, a) < 6.7 for a in shell) >= 5]
    assert {tuple(round(v, 6) for v in r) for r in rows} == {tuple(round(v, 6) for v in p) for p in want} and want
    assert sum(r["volume"] for r in sites.collect()) <= len(rows)


def test_surfaces_and_regions_never_broadcast_atoms(spark, monkeypatch):
    from corpuscle.operators import grids, surface

    s = points(spark, [(k * 1.5, 0, 0) for k in range(40)] + [(0, 50 + 9 * k, 0) for k in range(3)]).select("*", F.lit("C").alias("element"), F.lit(1).alias("residue_id"), F.lit("ARG").alias("resname"), F.lit("A").alias("chain_id"))
    areas = surface.sasa(s)
    for found in (areas, surface.surface_patches(s, areas)):
        assert "Broadcast" not in plan(found)
    written, keep = [], grids.materialize
    monkeypatch.setattr(grids, "materialize", lambda df, name: (written.append(name), keep(df, name))[1])
    found = grids.hydrophobic_regions(s)
    assert sorted(r["n"] for r in found.collect()) == [1, 1, 1, 40]
    # edges are made once, and steps read them
    assert written.count("edges") == 1 and "explode" not in plan(found)


def test_pairs_and_prints(spark, monkeypatch):
    from corpuscle.operators import bondgraph, molecules

    rows = [(k, 20, f"c{c}", f"g{k % 3}", k % 3 + 1) for k in range(30) for c in {k % 4, k % 3}]
    table = spark.createDataFrame(rows, "mol int, heavy int, core string, rgroup string, group_heavy int")
    pairs = molecules.matched_pairs(table, part=5)
    assert len(re.findall(r"SortMergeJoin \[core#\d+, part#", plan(pairs))) == 2
    want = {}
    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[2] == b[2] and a[3] != b[3]:
                want[a[0], b[0]] = min(a[2], want.get((a[0], b[0]), "z"))
    found = [((r["mol_a"], r["mol_b"]), r["core"]) for r in pairs.collect()]
    assert len(found) == len(want) and dict(found) == want

    monkeypatch.setattr(bondgraph, "KIND_PART", 3)
    random.seed(5)
    prints = [(k, sorted(random.sample(range(12), k % 4 + (k % 2) * 4))) for k in range(20)]
    prints += [(100 + k, prints[k][1]) for k in range(20)] + [(200 + k, [1, 2, 3]) for k in range(20)]
    p = spark.createDataFrame(prints, "mol int, bits array<int>")
    for least in (0.0, 0.5, 0.6):
        got = [(r["mol_a"], r["mol_b"], round(r["similarity"], 9)) for r in bondgraph.tanimoto(p, p.where("mol % 5 = 0"), least).collect()]
        same = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y)) if set(x) & set(y) else -1.0
        assert sorted(got) == sorted((a, b, round(same(x, y), 9)) for a, x in prints if a % 5 == 0 for b, y in prints if same(x, y) >= least)
    mols = spark.sql("SELECT 1 AS mol, 'x' AS name, array(named_struct('idx', 0, 'element', 'C', 'charge', 0, 'x', 0D, 'y', 0D, 'z', 0D), named_struct('idx', 1, 'element', 'O', 'charge', 0, 'x', 0D, 'y', 0D, 'z', 0D)) AS atoms, array(named_struct('i', 0, 'j', 1, 'order', 1)) AS bonds")
    found = bondgraph.fingerprints(bondgraph.heavy(mols))
    assert "Join" not in plan(found) and "Exchange" not in plan(found) and len(found.first()["bits"]) == 6


def test_water_sites_are_not_shuffled(spark):
    from corpuscle.operators import edit

    random.seed(8)
    rows = [tuple(random.uniform(-9, 14) for _ in range(3)) for _ in range(60)]
    s = points(spark, rows).withColumn("element", F.lit("O"))
    sites = edit.water_sites(s)
    assert "hashpartitioning(frame#" in (text := plan(sites)) and not any("iz#" in part for part in text.split("hashpartitioning(")[1:] for part in [part.split(")")[0]])
    lo, hi = ([f(r[c] for r in rows) for c in range(3)] for f in (min, max))
    n = [max(1, int((h + 10.0 - (low - 10.0)) // 3.1)) for low, h in zip(lo, hi, strict=True)]
    at = lambda c, i: lo[c] - 10.0 + (i + 0.5) * 3.1
    want = [(i, j, k) for i in range(n[0]) for j in range(n[1]) for k in range(n[2]) if all(sum((at(c, g) - r[c]) ** 2 for c, g in enumerate((i, j, k))) >= 2.4 * 2.4 for r in rows)]
    assert sorted((r["ix"], r["iy"], r["iz"]) for r in sites.collect()) == want and len(want) < n[0] * n[1] * n[2]
    for most in (10_000, 40):
        box = [(r["residue_id"], round(r["x"], 6), round(r["y"], 6), round(r["z"], 6)) for r in edit.water_box(s, most=most).where("name = 'OW'").orderBy("residue_id").collect()]
        assert box == [(k + 1, *(round(at(c, g), 6) for c, g in enumerate(w))) for k, w in enumerate(want[:most])]


def test_small_frames_and_molecules_share_batches(spark, tmp_path, monkeypatch):
    from corpuscle.sources import datasource, ranges

    frame = lambda k: f"3\nframe={k}\n" + "".join(f"C {k}.{a} 0.0 {a}.5\n" for a in range(3))
    path = tmp_path / "a.xyz"
    path.write_text("".join(map(frame, range(500))))
    reader = datasource.ParticleReader({"path": f"file://{path}", "suffix": ".xyz"})
    batches = [b for part in reader.partitions() for b in reader.read(part)]
    assert len(batches) == 1 and batches[0].num_rows == 1500
    monkeypatch.setattr(ranges, "ROWS", 100)
    parts = [b for part in reader.partitions() for b in reader.read(part)]
    assert [b.num_rows for b in parts] == [102] * 14 + [72]
    rows = [tuple(r.values()) for b in parts for r in b.to_pylist()]
    assert rows == [tuple(r.values()) for r in batches[0].to_pylist()]
    assert [(r["frame"], r["idx"], r["x"], r["z"]) for r in batches[0].to_pylist()][:4] == [(0, 0, 0.0, 0.5), (0, 1, 0.1, 1.5), (0, 2, 0.2, 2.5), (1, 0, 1.0, 0.5)]
    # ranges are as many as MOST allows, however short splitBytes is
    marks = datasource.ParticleReader({"path": f"file://{path}", "suffix": ".xyz", "table": "marks", "splitbytes": "64"})
    many = len(marks.partitions())
    monkeypatch.setattr(datasource, "MOST", 10)
    assert many > 100 and len(marks.partitions()) == 10


def test_numbers_beyond_their_columns(spark):
    from corpuscle.sources import formats, sinks

    line = "ATOM      1  N   ALA A   1       1.770   0.000 19040.000  1.00  0.00          CL"
    found = sinks.pdbqt_lines(spark.createDataFrame([(line,), (line.replace("19040.000", "1040.000"),), (line[:54] + "0" + line[55:77],)], "value string")).collect()
    assert [r["line"][-2:] for r in found] == ["Cl", "Cl", "NA"]
    ids = [99_999, 100_000, 148_750, 7, 200_001, 200_001]
    s = points(spark, [(k, 0, 0) for k in range(len(ids))]).join(spark.createDataFrame(list(enumerate(ids)), "idx bigint, residue_id int"), "idx").select("*", F.lit("C").alias("name"), F.lit("ALA").alias("resname"))
    text = sinks.gro_frames(s).first()["value"]
    assert [a["residue_id"] for a in formats.parse_gro(text).atoms] == ids and [int(row[:5]) for row in text.splitlines()[2:8]] == [k % 100_000 for k in ids]
    assert sinks.gro_frames(s.where("idx = 0")).first()["value"].startswith("system\n")
    values = [100000.5, 100001.5, 999999.5, 0.000099999999, 2.5, 1e-7, None, float("nan"), float("-inf"), 0.1234565, 1.2345e22, -0.00012345]
    got = sinks.generic_csv(spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")).orderBy(F.col("k").cast("int")).collect()
    assert [r["v"] for r in got] == ["100000", "100002", "1e+06", "0.0001", "2.5", "1e-07", "", "nan", "-inf", "0.123456", "1.2345e+22", "-0.00012345"]


def test_alignment_keeps_few_rows():
    import tracemalloc

    from corpuscle.operators import learn

    random.seed(2)
    a, b = ("".join(random.choice("ACDE") for _ in range(1200)) for _ in "ab")
    tracemalloc.start()
    score, x, y = learn.align(a, b)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # three whole tables are 35 MB
    assert most < 10e6 and (x.replace("-", ""), y.replace("-", "")) == (a, b) and len(x) == len(y) and score > 0


def far_cages(spark, n, apart):
    """n cubes of carbon atoms, each of which encloses one pocket, so far apart that one grid over all has more than 1024 points an axis."""
    side = range(0, 13, 2)
    shell = [(x, y, z) for x in side for y in side for z in side if {x, y, z} & {0, 12}]
    return shell, points(spark, [(x + apart * k, y, z) for k in range(n) for x, y, z in shell]).withColumn("element", F.lit("C"))


def test_grids_of_wide_frames_are_as_fine_as_others(spark):
    from corpuscle.operators import grids

    shell, s = far_cages(spark, 3, 900)
    line = [-3.4 + k for k in range(20)]
    own = [p for p in itertools.product([-3.4 + k for k in range(-6, 26)], line, line) if all(math.dist(p, a) >= 3.1 for a in shell) and sum(math.dist(p, a) < 6.7 for a in shell) >= 5]
    want = {(round(x + 900 * k, 6), round(y, 6), round(z, 6)) for k in range(3) for x, y, z in own if -3.5 < x + 900 * k < 1815.7}
    rows = grids.pocket_points(s).select("x", "y", "z").collect()
    assert {tuple(round(v, 6) for v in r) for r in rows} == want and len(rows) == len(want) and want


def test_sites_of_wide_frames_are_all_given(spark):
    from corpuscle.operators import grids

    _, s = far_cages(spark, 6, 40)
    left = {(r["gx"], r["gy"], r["gz"]): (r["x"], r["y"], r["z"]) for r in grids.pocket_points(s).collect()}
    steps, sizes = [o for o in itertools.product(range(-3, 4), repeat=3) if any(o)], []
    while left:
        todo, n = [left.popitem()], 0
        while todo:
            (g, p), n = todo.pop(), n + 1
            near = [q for o in steps if (q := tuple(a + b for a, b in zip(g, o, strict=True))) in left and sum((a - b) * (a - b) for a, b in zip(p, left[q], strict=True)) < 9]
            todo += [(q, left.pop(q)) for q in near]
        sizes.append(float(n))
    rows = grids.binding_sites(s, least=1.0).collect()
    assert sorted(r["volume"] for r in rows) == sorted(sizes) and sorted(r["rank"] for r in rows) == list(range(1, len(sizes) + 1)) and len(sizes) > 10
    assert len(grids.binding_sites(s, least=1.0, most=3).collect()) == 3


def test_wide_boxes_are_filled_with_water(spark):
    from corpuscle.operators import edit

    s = points(spark, [(0, 0, 0), (70, 70, 70)]).select("*", *(F.lit(v).alias(c) for c, v in (("element", "O"), ("name", "O"), ("resname", "LIG"), ("residue_id", 1), ("chain_id", "A"))))
    sites = edit.water_sites(s).count()
    whole = edit.solvate(s)
    assert sites > 20_000 and whole.count() == 2 + 3 * sites
    assert whole.agg(F.max("idx"), F.count_distinct("idx")).first() == (1 + 3 * sites, 2 + 3 * sites)
    assert edit.water_box(s, most=10_000).count() == 30_000
