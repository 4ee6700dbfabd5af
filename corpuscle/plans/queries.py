"""Registered queries: operators over the adapters, each with equivalent SQL where SQL can express it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle import model as m
from corpuscle.functions import geometry as g
from corpuscle.functions import plugins, sql
from corpuscle.functions.selection import compile_selection, index_range
from corpuscle.operators import edit, grids, interactions, learn, molecules, residues, spatial, surface, trajectory
from corpuscle.plans import files
from corpuscle.plans.adapters import EMB_SQL, PART_SQL, conformers, embeddings_system, fragments, part_system
from corpuscle.sources import simulation, sinks
from corpuscle.sources.store import new_path
from corpuscle.streaming import frames

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def _r(c: Column | str, alias: str) -> Column:
    return (F.round(c, 4) + F.lit(0.0)).alias(alias)


def _emb(name: str, f: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    _add(name, lambda spark, d: f(embeddings_system(spark, d)), sql and f"WITH {EMB_SQL}{', ' if sql[0] == ',' else ' '}{sql.lstrip(', ')}")


def _part(name: str, f: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    _add(name, lambda spark, d: f(part_system(spark, d)), sql and f"WITH {PART_SQL}{', ' if sql[0] == ',' else ' '}{sql.lstrip(', ')}")


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _case(table: dict, col: str, default: object) -> str:
    return f"CASE upper({col}) " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in table.items()) + f" ELSE {default} END"


D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"
D = f"sqrt({D2})"
ACROSS = "((a.in_a AND b.in_b) OR (a.in_b AND b.in_a))"

# selections
for _name, _text, _where in (
    ("select_type", "type == 8", "type_id = 8"),
    ("select_element_not", "NOT element == C", "NOT coalesce(element, '') = 'C'"),
    ("select_coord_and", "z > 5 AND x <= 8.5 AND resname == GLY", "z > 5 AND x <= 8.5e0 AND resname = 'GLY'"),
    ("select_or_not", "(chain_id == A OR NOT name == CA) AND residue_id >= 12", "(chain_id = 'A' OR NOT name = 'CA') AND residue_id >= 12"),
):
    _part(_name, lambda s, t=_text: s.where(compile_selection(t)).select("idx"), f"SELECT idx FROM s WHERE {_where}")
_part("select_named", lambda s: s.where(compile_selection("named ring AND NOT type == 17", {"ring": F.col("resname").isin("PHE", "TYR")})).select("idx"), "SELECT idx FROM s WHERE resname IN ('PHE', 'TYR') AND NOT type_id = 17")
_part("select_panel", lambda s: s.where(compile_selection("element == cl AND x == 1.77", dialect="panel")).select("idx"), "SELECT idx FROM s WHERE upper(element) = 'CL' AND abs(x - 1.77e0) < 1e-9")
_part("select_index_range", lambda s: s.where(index_range("3-40, 77, 101-150")).select("idx"), "SELECT idx FROM s WHERE idx BETWEEN 3 AND 40 OR idx = 77 OR idx BETWEEN 101 AND 150")
_part("backbone_atoms", lambda s: s.where(F.upper(F.trim("name")).isin(*m.BACKBONE)).select("idx", "name"), f"SELECT idx, name FROM s WHERE name IN {_in(m.BACKBONE)}")

# geometry
def _wide(s: DataFrame, *idx: int) -> DataFrame:
    """One row a frame with the chosen atoms as structs a, b, c, d."""
    return s.where(F.col("idx").isin(*idx)).groupBy("frame").agg(*(F.max(F.when(F.col("idx") == i, F.struct("x", "y", "z"))).alias(n) for n, i in zip("abcd", idx, strict=False)))


def _points(*idx: int) -> str:
    return "FROM " + " JOIN ".join(f"s {n}{' ON ' + n + '.frame = a.frame AND ' + n + '.idx = ' + str(i) if n != 'a' else ''}" for n, i in zip("abcd", idx, strict=False)) + f" WHERE a.idx = {idx[0]}"


_emb("distance_traj", lambda s: _wide(s, 0, 7).select("frame", _r(g.distance(g.point(struct="a"), g.point(struct="b")), "value")), f"SELECT a.frame, round({D}, 4) AS value {_points(0, 7)}")
_emb("distance_stats", lambda s: _wide(s, 0, 7).select(g.distance(g.point(struct="a"), g.point(struct="b")).alias("v")).agg(_r(F.min("v"), "min"), _r(F.avg("v"), "mean"), _r(F.max("v"), "max")), f"SELECT round(min({D}), 4) AS min, round(avg({D}), 4) AS mean, round(max({D}), 4) AS max {_points(0, 7)}")
_dot = lambda u, v: " + ".join(f"({p}) * ({q})" for p, q in zip(u, v, strict=True))
_sub = lambda p, q: [f"{p}.{c} - {q}.{c}" for c in "xyz"]
_cross = lambda u, v: [f"({u[i]}) * ({v[j]}) - ({u[j]}) * ({v[i]})" for i, j in ((1, 2), (2, 0), (0, 1))]
_u, _v = _sub("a", "b"), _sub("c", "b")
_angle_sql = lambda u, v: f"degrees(acos(greatest(-1e0, least(1e0, ({_dot(u, v)}) / (sqrt({_dot(u, u)}) * sqrt({_dot(v, v)}))))))"
_emb("angle_traj", lambda s: _wide(s, 0, 1, 2).select("frame", _r(g.angle(*(g.point(struct=c) for c in "abc")), "value")), f"SELECT a.frame, round({_angle_sql(_u, _v)}, 4) AS value {_points(0, 1, 2)}")


def _torsion_sql(p: str, q: str, r: str, t: str) -> str:
    b1, b2, b3 = _sub(q, p), _sub(r, q), _sub(t, r)
    n1, n2 = _cross(b1, b2), _cross(b2, b3)
    unit = [f"({c}) / (sqrt({_dot(b2, b2)}) + 1e-15)" for c in b2]
    return f"degrees(atan2({_dot(_cross(n1, unit), n2)}, {_dot(n1, n2)}))"


_emb("torsion_traj", lambda s: _wide(s, 0, 1, 2, 3).select("frame", _r(g.torsion(*(g.point(struct=c) for c in "abcd")), "value")), f"SELECT a.frame, round({_torsion_sql('a', 'b', 'c', 'd')}, 4) AS value {_points(0, 1, 2, 3)}")

# trajectories
_SQ = "(s.x - r.x) * (s.x - r.x) + (s.y - r.y) * (s.y - r.y) + (s.z - r.z) * (s.z - r.z)"
_emb("rmsd_traj", lambda s: trajectory.rmsd_to_frame(s.select("frame", "idx", "x", "y", "z")).select("frame", _r("rmsd", "rmsd")), f"SELECT s.frame, round(sqrt(sum({_SQ}) / count(*)), 4) AS rmsd FROM s JOIN s r ON r.idx = s.idx AND r.frame = 0 GROUP BY s.frame")
_emb("rmsd_subset", lambda s: trajectory.rmsd_to_frame(s.where(F.col("name").isin(*m.BACKBONE)).select("frame", "idx", "x", "y", "z"), 3).select("frame", _r("rmsd", "rmsd")), f"SELECT s.frame, round(sqrt(sum({_SQ}) / count(*)), 4) AS rmsd FROM s JOIN s r ON r.idx = s.idx AND r.frame = 3 WHERE s.name IN {_in(m.BACKBONE)} GROUP BY s.frame")
_RMSF = "sqrt(var_pop(x) + var_pop(y) + var_pop(z))"
_emb("rmsf_atom", lambda s: trajectory.rmsf(s).select("idx", _r("rmsf", "rmsf")), f"SELECT idx, round({_RMSF}, 4) AS rmsf FROM s GROUP BY idx")
_emb("rmsf_residue", lambda s: trajectory.rmsf_per_residue(s).select("residue_id", _r("rmsf", "rmsf")), f"SELECT residue_id, round(avg(r), 4) AS rmsf FROM (SELECT residue_id, idx, {_RMSF} AS r FROM s GROUP BY residue_id, idx) GROUP BY residue_id")


def _kabsch_sql(p: str, q: str) -> str:
    """The closed form over pairs p, q of one group, as nested selects."""
    ax = "xyz"
    sums = ["count(*) AS n", *(f"sum({t}.{c}) AS s{t}{c}" for t in (p, q) for c in ax), *(f"sum({t}.x * {t}.x + {t}.y * {t}.y + {t}.z * {t}.z) AS g{t}" for t in (p, q)), *(f"sum({p}.{c} * {q}.{d}) AS c{c}{d}" for c in ax for d in ax)]
    h = ", ".join(f"c{c}{d} - s{p}{c} * s{q}{d} / n AS h{c}{d}" for c in ax for d in ax)
    gg = " + ".join(f"g{t} - (s{t}x * s{t}x + s{t}y * s{t}y + s{t}z * s{t}z) / n" for t in (p, q))
    k = ", ".join(f"{' + '.join(f'h{e}{c} * h{e}{d}' for e in ax)} AS k{c}{d}" for c in ax for d in ax)
    det = "hxx * (hyy * hzz - hyz * hzy) - hxy * (hyx * hzz - hyz * hzx) + hxz * (hyx * hzy - hyy * hzx)"
    low = "(kxx - q) * ((kyy - q) * (kzz - q) - kyz * kyz) - kxy * (kxy * (kzz - q) - kyz * kxz) + kxz * (kxy * kyz - (kyy - q) * kxz)"
    return f"""
sums AS (SELECT {{keys}}, {', '.join(sums)} {{source}} GROUP BY ALL),
h AS (SELECT *, {h}, {gg} AS g FROM sums), k AS (SELECT *, {k}, {det} AS det FROM h), q AS (SELECT *, (kxx + kyy + kzz) / 3 AS q FROM k),
p AS (SELECT *, sqrt(((kxx - q) * (kxx - q) + (kyy - q) * (kyy - q) + (kzz - q) * (kzz - q) + 2 * (kxy * kxy + kxz * kxz + kyz * kyz)) / 6) AS p FROM q),
f AS (SELECT *, acos(greatest(-1e0, least(1e0, CASE WHEN p > 0 THEN ({low}) / (p * p * p) / 2 ELSE 1e0 END))) / 3 AS phi FROM p),
e AS (SELECT *, q + 2 * p * cos(phi) AS e1, q + 2 * p * cos(phi + {2 * math.pi / 3!r}) AS e3 FROM f),
out AS (SELECT *, sqrt(greatest((g - 2 * (sqrt(greatest(e1, 0e0)) + sqrt(greatest(3 * q - e1 - e3, 0e0)) + CASE WHEN det < 0 THEN -1 ELSE 1 END * sqrt(greatest(e3, 0e0)))) / n, 0e0)) AS rmsd FROM e)"""


# the reference frame itself is zero up to rounding under the root, so three places are compared
_emb("kabsch_rmsd_traj", lambda s: trajectory.kabsch_rmsd_to_frame(s.select("frame", "idx", "x", "y", "z")).select("frame", (F.round("rmsd", 3) + 0.0).alias("rmsd")), ", " + _kabsch_sql("a", "b").format(keys="a.frame", source="FROM s a JOIN s b ON b.idx = a.idx AND b.frame = 0") + " SELECT frame, round(rmsd, 3) AS rmsd FROM out")
_PAIRS = "FROM s a JOIN s b ON b.idx = a.idx AND a.frame < b.frame"
_emb("rmsd_matrix_raw", lambda s: trajectory.rmsd_matrix(s, align=False, digits=4), f"SELECT a.frame AS i, b.frame AS j, round(sqrt(sum({D2}) / count(*)), 4) AS rmsd {_PAIRS} GROUP BY 1, 2")
_emb("rmsd_matrix_aligned", lambda s: trajectory.rmsd_matrix(s, digits=4), ", " + _kabsch_sql("a", "b").format(keys="a.frame AS i, b.frame AS j", source=_PAIRS) + " SELECT i, j, round(rmsd, 4) AS rmsd FROM out")
_emb("divergent_pairs_top10", lambda s: trajectory.divergent_frames(s)[0].select("i", "j", _r("rmsd", "rmsd")), f"SELECT i, j, round(r, 4) AS rmsd FROM (SELECT a.frame AS i, b.frame AS j, sqrt(sum({D2}) / count(*)) AS r {_PAIRS} GROUP BY 1, 2 ORDER BY r DESC, i, j LIMIT 10)")
_emb("aligned_coords", lambda s: trajectory.superimpose_trajectory(s.select("frame", "idx", "x", "y", "z")).select("frame", "idx", *(_r(c, c) for c in "xyz")))
_emb("packed_frames", lambda s: trajectory.unpack_frames(trajectory.pack_frames(s)).select("frame", "idx", *(_r(c, c) for c in "xyz")), "SELECT frame, idx, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z FROM s")

# distance joins
_part("bonds_cutoff", lambda s: spatial.bonds_within(s, 1.8).select("i", "j"), f"SELECT a.idx AS i, b.idx AS j FROM s a JOIN s b ON a.idx < b.idx WHERE {D2} <= 1.8e0 * 1.8e0")
_COV = f"least({_case(m.COVALENT_RADIUS, 'a.element', '0.77e0')} + {_case(m.COVALENT_RADIUS, 'b.element', '0.77e0')} + 0.45e0, 3e0)"
_part("bonds_covalent", lambda s: spatial.covalent_bonds(s).select("i", "j"), f"SELECT a.idx AS i, b.idx AS j FROM s a JOIN s b ON a.idx < b.idx WHERE {D} > 0.4e0 AND {D} < {_COV}")
_part("bonds_selected", lambda s: spatial.bonds_between(spatial.bonds_within(s, 1.8).select("i", "j"), s.where("chain_id = 'A'")), f"SELECT a.idx AS i, b.idx AS j FROM s a JOIN s b ON a.idx < b.idx WHERE {D2} <= 1.8e0 * 1.8e0 AND a.chain_id = 'A' AND b.chain_id = 'A'")
_part("bond_missing", lambda s: spatial.missing_bonds(s.select(F.col("idx").alias("i"), (F.col("idx") + 1).alias("j")).join(m.large(s.select(F.col("idx").alias("j"))), "j", "left_semi"), spatial.bonds_within(s, 1.8)), f"SELECT a.idx AS i, b.idx AS j FROM s a JOIN s b ON b.idx = a.idx + 1 WHERE NOT {D2} <= 1.8e0 * 1.8e0")
_part("nearest_atom", lambda s: spatial.nearest_atom(s, 7.3, 4.1, 2.2).select("idx", _r("d", "d")), "SELECT idx, round(sqrt(d2), 4) AS d FROM (SELECT idx, (x - 7.3e0) * (x - 7.3e0) + (y - 4.1e0) * (y - 4.1e0) + (z - 2.2e0) * (z - 2.2e0) AS d2 FROM s ORDER BY d2, idx LIMIT 1)")

# interactions
_out = lambda f, *more: (lambda s: f(s).select("frame", "i", "j", _r("distance", "distance"), *(_r(c, c) if c != "c" else F.col(c) for c in more)))
_HB_NEAR = f"h AS (SELECT a.frame, a.idx AS i, arg_min(b, row({D2}, b.idx)) AS h FROM s a JOIN s b ON a.frame = b.frame AND b.element = 'H' WHERE a.element IN ('N', 'O', 'S') AND {D2} < 1.2e0 * 1.2e0 GROUP BY 1, 2)"
_HANGLE = _angle_sql([f"a.{c} - h.h.{c}" for c in "xyz"], [f"b.{c} - h.h.{c}" for c in "xyz"])
_HB = f"hb AS (SELECT a.frame, a.idx AS i, b.idx AS j, {D} AS distance, CASE WHEN h.h IS NOT NULL THEN {_HANGLE} END AS angle FROM s a JOIN s b ON a.frame = b.frame AND a.idx <> b.idx LEFT JOIN h ON h.frame = a.frame AND h.i = a.idx WHERE a.element IN ('N', 'O', 'S') AND b.element IN ('N', 'O', 'S', 'F') AND {ACROSS} AND {D2} <= 3.5e0 * 3.5e0)"
_HB_ALL = f"{_HB_NEAR}, {_HB}, hbonds AS (SELECT * FROM hb WHERE angle IS NULL OR angle >= 120)"
# the angle at a donor's own hydrogen is along the vectors to donor and acceptor
_emb("hbonds", lambda s: interactions.hbonds(s).select("frame", "i", "j", _r("distance", "distance"), _r("angle", "angle")), f", {_HB_ALL} SELECT frame, i, j, round(distance, 4) AS distance, round(angle, 4) AS angle FROM hbonds")
_SALT = f"salt_bridges AS (SELECT a.frame, a.idx AS i, b.idx AS j, {D} AS distance FROM s a JOIN s b ON a.frame = b.frame WHERE a.resname IN {_in(m.POSITIVE)} AND b.resname IN {_in(m.NEGATIVE)} AND {ACROSS} AND {D2} <= 16e0)"
_emb("salt_bridges", _out(interactions.salt_bridges), f", {_SALT} SELECT frame, i, j, round(distance, 4) AS distance FROM salt_bridges")
_LIMIT = f"{_case(m.CONTACT_RADIUS, 'a.element', '1.7e0')} + {_case(m.CONTACT_RADIUS, 'b.element', '1.7e0')} - 0.4e0"
_CLASH = f"clashes AS (SELECT a.frame, a.idx AS i, b.idx AS j, {D} AS distance, {_LIMIT} - {D} AS overlap FROM s a JOIN s b ON a.frame = b.frame AND a.idx <> b.idx WHERE a.in_a AND b.in_b AND a.element <> 'H' AND b.element <> 'H' AND {D} < {_LIMIT})"
_emb("clashes", _out(interactions.clashes, "overlap"), f", {_CLASH} SELECT frame, i, j, round(distance, 4) AS distance, round(overlap, 4) AS overlap FROM clashes")
_emb("clashes_top10", lambda s: _out(interactions.clashes, "overlap")(s).orderBy(F.desc("overlap"), "frame", "i", "j").limit(10), f", {_CLASH} SELECT frame, i, j, round(distance, 4) AS distance, round(overlap, 4) AS overlap FROM clashes ORDER BY overlap DESC, frame, i, j LIMIT 10")
_HYDRO = f"hydrophobic AS (SELECT a.frame, a.idx AS i, b.idx AS j, {D} AS distance FROM s a JOIN s b ON a.frame = b.frame WHERE a.in_a AND b.in_b AND a.element IN ('C', 'S') AND b.element IN ('C', 'S') AND {D2} <= 16e0)"
_emb("hydrophobic", _out(interactions.hydrophobic), f", {_HYDRO} SELECT frame, i, j, round(distance, 4) AS distance FROM hydrophobic")
_HALO = f"hc AS (SELECT a.frame, a.idx AS i, min(b.idx) AS c FROM s a JOIN s b ON a.frame = b.frame AND a.idx <> b.idx WHERE a.element IN ('F', 'CL', 'BR', 'I') AND b.element = 'C' AND {D2} < 2.1e0 * 2.1e0 GROUP BY 1, 2), halogen AS (SELECT a.frame, a.idx AS i, b.idx AS j, {D} AS distance, hc.c FROM s a JOIN s b ON a.frame = b.frame JOIN hc ON hc.frame = a.frame AND hc.i = a.idx WHERE b.element IN ('N', 'O', 'S') AND a.in_a <> b.in_a AND {D2} <= 3.5e0 * 3.5e0)"
_part("halogen_bonds", _out(interactions.halogen_bonds, "c"), f", {_HALO} SELECT frame, i, j, round(distance, 4) AS distance, c FROM halogen")
_RING = lambda side: f"(SELECT frame, residue_id AS idx, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM s WHERE {side} AND resname IN {_in(m.AROMATIC)} AND element IN ('C', 'N') GROUP BY 1, 2 HAVING count(*) BETWEEN 5 AND 6)"
_PI = f"pi AS (SELECT a.frame, a.idx AS i, b.idx AS j, {D} AS distance FROM {_RING('in_a')} a JOIN {_RING('in_b')} b ON a.frame = b.frame WHERE {D2} <= 5.5e0 * 5.5e0)"
_everyone = lambda s: s.withColumn("in_a", F.col("idx") < 11).withColumn("in_b", F.col("idx") >= 11).withColumn("resname", F.lit("PHE")).withColumn("residue_id", F.floor(F.col("idx") / 6).cast("int"))
_SHIFTED = "t AS (SELECT frame, idx, element, x, y, z, idx < 11 AS in_a, idx >= 11 AS in_b, 'PHE' AS resname, (idx // 6)::INT AS residue_id FROM s)"
# every seven atoms are a residue here, so that there are rings
_stacked = lambda s: s.withColumn("in_a", F.col("idx") < 7).withColumn("in_b", F.col("idx") >= 7).withColumn("resname", F.lit("PHE")).withColumn("residue_id", F.floor(F.col("idx") / 7).cast("int"))
_SHIFTED = _SHIFTED.replace("< 11", "< 7").replace(">= 11", ">= 7").replace("idx // 6", "idx // 7")
_emb("pi_stacks", lambda s: _out(interactions.pi_stacks)(_stacked(s)), f", {_SHIFTED}, {_PI.replace('FROM s WHERE', 'FROM t WHERE')} SELECT frame, i, j, round(distance, 4) AS distance FROM pi")
_ALL = f"{_HB_ALL}, {_SALT}, {_CLASH}, {_HYDRO}, {_HALO}, {_PI}, kinds AS (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, frame FROM {k}" for k in interactions.KINDS) + ")"
_emb("interaction_counts", interactions.interaction_counts, f", {_ALL} SELECT f.frame, " + ", ".join(f"count(CASE WHEN kind = '{k}' THEN 1 END) AS {k}" for k in interactions.KINDS) + ", count(kind) AS total FROM (SELECT DISTINCT frame FROM s) f LEFT JOIN kinds USING (frame) GROUP BY f.frame")
_emb("interaction_summary", interactions.interaction_summary, f", {_ALL} SELECT kind, count(*) AS n FROM kinds GROUP BY kind")

# surface
_SPHERE = "sphere(px, py, pz) AS (VALUES " + ", ".join(f"({x!r}, {y!r}, {z!r})" for x, y, z in m.sphere()).replace("e-", "e-") + ")"
_SASA = f"t AS (SELECT *, {_case(m.SURFACE_RADIUS, 'element', '1.7e0')} + 1.4e0 AS r FROM s), {_SPHERE}, free AS (SELECT a.frame, a.idx, a.residue_id, a.r, p.px, bool_or(b.idx IS NOT NULL) AS covered FROM t a CROSS JOIN sphere p LEFT JOIN t b ON a.frame = b.frame AND a.idx <> b.idx AND {D} > 1e-6 AND {D} < a.r + b.r AND sqrt((a.x + a.r * p.px - b.x) * (a.x + a.r * p.px - b.x) + (a.y + a.r * p.py - b.y) * (a.y + a.r * p.py - b.y) + (a.z + a.r * p.pz - b.z) * (a.z + a.r * p.pz - b.z)) < b.r GROUP BY 1, 2, 3, 4, 5, p.py), area AS (SELECT frame, idx, residue_id, count(CASE WHEN NOT covered THEN 1 END) / 92e0 * {4 * math.pi!r} * r * r AS area FROM free GROUP BY frame, idx, residue_id, r)"
_areas = surface.sasa
_emb("sasa_atom", lambda s: _areas(s).select("frame", "idx", _r("area", "area")), f", {_SASA} SELECT frame, idx, round(area, 4) AS area FROM area")
_emb("sasa_residue", lambda s: surface.sasa_per_residue(_areas(s)).select("frame", "residue_id", _r("area", "area")), f", {_SASA} SELECT frame, residue_id, round(sum(area), 4) AS area FROM area GROUP BY 1, 2")
_emb("top_exposed", lambda s: surface.sasa_per_residue(_areas(s)).select("frame", "residue_id", _r("area", "area")).orderBy(F.desc("area"), "frame", "residue_id").limit(20), f", {_SASA}, r AS (SELECT frame, residue_id, round(sum(area), 4) AS area FROM area GROUP BY 1, 2) SELECT * FROM r ORDER BY area DESC, frame, residue_id LIMIT 20")
_KIND = f"CASE WHEN resname IN {_in(m.HYDROPHOBIC)} THEN 'hydrophobic' WHEN resname IN {_in(m.POSITIVE)} THEN 'positive' WHEN resname IN {_in(m.NEGATIVE)} THEN 'negative' WHEN resname IN {_in(m.POLAR)} THEN 'polar' ELSE 'other' END"
_emb("surface_patches", lambda s: surface.surface_patches(s, _areas(s), 60.0), f", {_SASA}, n AS (SELECT DISTINCT residue_id, resname FROM emb_atoms), ra AS (SELECT frame, residue_id, sum(area) AS area FROM area GROUP BY 1, 2) SELECT frame, residue_id, {_KIND} AS kind FROM ra JOIN n USING (residue_id) WHERE area >= 60")
_PKA = f"n AS (SELECT DISTINCT residue_id, chain_id, resname FROM emb_atoms), ra AS (SELECT frame, residue_id, sum(area) AS area FROM area GROUP BY 1, 2), pk AS (SELECT frame, chain_id, residue_id, resname, round({_case(m.MODEL_PKA, 'resname', 'NULL')} + CASE WHEN area < 10 THEN CASE WHEN resname IN ('ASP', 'GLU', 'CYS', 'TYR') THEN 1.5e0 ELSE -1.5e0 END ELSE 0e0 END, 2) AS pka, area < 10 AS buried FROM ra JOIN n USING (residue_id) WHERE resname IN {_in(m.MODEL_PKA)})"
_emb("pka_estimate", lambda s: surface.estimate_pka(s, _areas(s)), f", {_SASA}, {_PKA} SELECT * FROM pk")
_emb("protonation", lambda s: surface.protonation(surface.estimate_pka(s, _areas(s)), 11.5).select("frame", "residue_id", "state"), f", {_SASA}, {_PKA} SELECT frame, residue_id, CASE WHEN pka > 13e0 THEN 'protonated' WHEN pka < 10e0 THEN 'deprotonated' ELSE 'mixed' END AS state FROM pk")
_WAT = f"w AS (SELECT * FROM s WHERE resname IN {_in(m.DENSITY_WATERS)} AND name IN {_in(m.DENSITY_OXYGENS)}), g AS (SELECT min(x) - 1 AS ox, min(y) - 1 AS oy, min(z) - 1 AS oz, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) + 2 AS span FROM w), d AS (SELECT floor((x - ox) / 0.5e0)::BIGINT AS vx, floor((y - oy) / 0.5e0)::BIGINT AS vy, floor((z - oz) / 0.5e0)::BIGINT AS vz, count(*) / (SELECT count(DISTINCT frame) FROM s) AS density FROM w, g GROUP BY 1, 2, 3)"
_emb("water_density", lambda s: surface.water_density(s).select("vx", "vy", "vz", F.round("density", 6).alias("density")), f", {_WAT} SELECT vx, vy, vz, round(density, 6) AS density FROM d")
_emb("hydration_sites", lambda s: surface.hydration_sites(surface.water_density(s)).select("vx", "vy", "vz", F.round("density", 6).alias("density")), f", {_WAT} SELECT vx, vy, vz, round(density, 6) AS density FROM d WHERE density > (SELECT avg(density) + 2 * stddev_pop(density) FROM d)")

# residues
_FIRST = "SELECT chain_id, residue_id, arg_min(resname, idx) AS resname, count(*) AS n_atoms FROM s GROUP BY 1, 2"
_part("residues", lambda s: residues.list_residues(s.drop("frame")), _FIRST)
_part("sequence", lambda s: residues.extract_sequence(s.drop("frame")), "SELECT chain_id, string_agg(CASE substr(resname, 1, 3) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in m.SEQUENCE_LETTER.items()) + " ELSE 'X' END, '' ORDER BY residue_id) AS sequence FROM (SELECT chain_id, residue_id, arg_min(resname, idx) AS resname FROM s WHERE name IN ('CA') GROUP BY 1, 2) GROUP BY 1")
_part("renumber", lambda s: residues.renumber(s.drop("frame"), 5).select("idx", F.col("new_id").cast("long").alias("new_id")), ", f AS (SELECT chain_id, residue_id, row_number() OVER (ORDER BY min(idx)) + 4 AS new_id FROM s GROUP BY 1, 2) SELECT idx, new_id FROM s JOIN f USING (chain_id, residue_id)")
_part("residue_gaps", lambda s: residues.residue_gaps(s.drop("frame")), "SELECT chain_id, prev_id, residue_id FROM (SELECT chain_id, residue_id, lag(residue_id) OVER (PARTITION BY chain_id ORDER BY residue_id) AS prev_id FROM (SELECT DISTINCT chain_id, residue_id FROM s)) WHERE residue_id - prev_id > 1")
_RA = f"o AS (SELECT frame, residue_id, {', '.join(f'arg_max(CASE WHEN name = {n!r} THEN row(x, y, z) END, CASE WHEN name = {n!r} THEN idx END) AS {a}' for n, a in (('N', 'n'), ('CA', 'ca'), ('C', 'c')))} FROM s WHERE name IN ('N', 'CA', 'C') GROUP BY 1, 2)"
_XYZ = lambda n: f"(SELECT frame, residue_id, max(CASE WHEN name = '{n}' THEN x END) AS x, max(CASE WHEN name = '{n}' THEN y END) AS y, max(CASE WHEN name = '{n}' THEN z END) AS z FROM s GROUP BY 1, 2 HAVING count(CASE WHEN name = '{n}' THEN 1 END) > 0)"
_on = lambda t, d: f"{t}.frame = o.frame AND {t}.residue_id = o.residue_id{d}"
_RAMA = f"SELECT o.frame, o.residue_id, CASE WHEN b.x IS NOT NULL THEN round({_torsion_sql('b', 'n', 'ca', 'c')}, 4) END AS phi, CASE WHEN d.x IS NOT NULL THEN round({_torsion_sql('n', 'ca', 'c', 'd')}, 4) END AS psi FROM (SELECT DISTINCT frame, residue_id FROM s) o JOIN {_XYZ('N')} n ON {_on('n', '')} JOIN {_XYZ('CA')} ca ON {_on('ca', '')} JOIN {_XYZ('C')} c ON {_on('c', '')} LEFT JOIN {_XYZ('C')} b ON {_on('b', ' - 1')} LEFT JOIN {_XYZ('N')} d ON {_on('d', ' + 1')} WHERE b.x IS NOT NULL OR d.x IS NOT NULL"
_emb("phi_psi", lambda s: residues.ramachandran(s).select("frame", "residue_id", _r("phi", "phi"), _r("psi", "psi")), _RAMA)
_AA = m.AMINO_ACIDS + m.AMINO_VARIANTS
_RES = f"r AS (SELECT chain_id, residue_id, arg_min(resname, idx) AS resname, list(DISTINCT name) AS names, count(*) AS n FROM s GROUP BY 1, 2), gaps AS (SELECT chain_id, prev_id, residue_id FROM (SELECT chain_id, residue_id, lag(residue_id) OVER (PARTITION BY chain_id ORDER BY residue_id) AS prev_id FROM r) WHERE residue_id - prev_id > 1)"
_LACK = "list_filter(['C', 'CA', 'N', 'O'], lambda q: NOT list_contains(names, q))"
_part("structure_counts", lambda s: residues.structure_counts(s.drop("frame")), f", {_RES} SELECT sum(n)::BIGINT AS n_atoms, count(*) AS n_residues, count(DISTINCT chain_id) AS n_chains, count(CASE WHEN resname IN {_in(m.WATERS)} THEN 1 END) AS n_waters, count(CASE WHEN resname IN {_in(_AA)} AND len({_LACK}) > 0 THEN 1 END) AS missing_backbone, (SELECT count(*) FROM gaps) AS missing_loops FROM r")
_part("structure_issues", lambda s: residues.structure_issues(s.drop("frame")), f", {_RES} SELECT 'NON_STANDARD_RESIDUE' AS issue, chain_id, residue_id, resname AS detail FROM r WHERE resname NOT IN {_in(_AA + m.NUCLEOTIDES + m.WATERS)} UNION ALL SELECT 'MISSING_BACKBONE', chain_id, residue_id, array_to_string({_LACK}, ',') FROM r WHERE resname IN {_in(_AA)} AND len({_LACK}) > 0 UNION ALL SELECT 'MISSING_LOOP', chain_id, prev_id, residue_id::VARCHAR FROM gaps UNION ALL SELECT 'BAD_COORDINATES', a.chain_id, a.residue_id, a.idx || '-' || b.idx FROM s a JOIN s b ON b.idx BETWEEN a.idx + 1 AND a.idx + 19 WHERE {D} < 0.5e0 UNION ALL SELECT 'NO_HYDROGENS', '', NULL, '' FROM s HAVING count(CASE WHEN element = 'H' THEN 1 END) = 0")
_NET = f"net AS (SELECT sum(CASE WHEN resname IN ('ARG', 'LYS', 'HIS', 'HSD', 'HSE') THEN 1 WHEN resname IN ('ASP', 'GLU') THEN -1 ELSE 0 END)::BIGINT AS q FROM ({_FIRST}))"
_part("ion_estimate", lambda s: residues.ion_estimate(s.drop("frame"), 1000), f", {_NET} SELECT q AS net_charge, greatest(-q, 0) + 2 AS n_na, greatest(q, 0) + 2 AS n_cl FROM net")
_BEADS = "beads(res, o, bead, kind, names) AS (VALUES " + ", ".join(f"('{r}', {o}, '{b}', '{t}', [{', '.join(repr(x) for x in n)}])" for r, o, b, t, n in residues.bead_table()) + ")"
_CG = f"{_BEADS}, j AS (SELECT s.*, coalesce(b.o, 0) AS bead_order, coalesce(b.bead, 'BB') AS bead, coalesce(b.kind, 'P2') AS bead_type, coalesce(list_contains(b.names, s.name), false) AS inside FROM s LEFT JOIN beads b ON b.res = s.resname), c AS (SELECT frame, chain_id, residue_id, bead_order, bead, bead_type, " + ", ".join(f"coalesce(avg(CASE WHEN inside THEN {c} END), arg_min({c}, CASE WHEN name = 'CA' THEN -1 ELSE idx END)) AS {c}" for c in "xyz") + " FROM j GROUP BY ALL)"
_emb("cg_beads", lambda s: residues.cg_beads(s).select("frame", "chain_id", "residue_id", "bead_order", "bead", "bead_type", *(_r(c, c) for c in "xyz")), f", {_CG} SELECT frame, chain_id, residue_id, bead_order, bead, bead_type, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z FROM c")
_emb("bead_counts", lambda s: residues.cg_beads(s).groupBy("bead_type").agg(F.count("*").alias("n")), f", {_CG} SELECT bead_type, count(*) AS n FROM c GROUP BY 1")
_BOX = ", ".join(f"round(avg({c}), 4) AS c{c}, round(max({c}) - min({c}) + 10, 4) AS s{c}" for c in "xyz")
_part("docking_box", lambda s: residues.docking_box(s, F.col("chain_id") == "B").select(*(_r(f"{k}{c}", f"{k}{c}") for c in "xyz" for k in "cs")), f"SELECT {_BOX} FROM s WHERE chain_id = 'B'")
_part("legend", residues.legend, "SELECT upper(element) AS label, min(idx) AS first_idx FROM s GROUP BY 1")
_part("hydropathy", lambda s: s.groupBy("residue_id").agg(_r(F.avg(m.lookup(m.HYDROPATHY, F.col("resname"), 0.0)), "score")), f"SELECT residue_id, round(avg({_case(m.HYDROPATHY, 'resname', '0e0')}), 4) AS score FROM s GROUP BY 1")
_PH = "p AS (SELECT frame, 'donor' AS kind, idx::VARCHAR AS key, x, y, z, 1 AS n FROM s WHERE element IN ('N', 'S') UNION ALL SELECT frame, 'acceptor', idx::VARCHAR, x, y, z, 1 FROM s WHERE element IN ('N', 'O', 'S', 'F')" + "".join(f" UNION ALL SELECT frame, '{k}', chain_id || ':' || residue_id, avg(x), avg(y), avg(z), count(*) FROM s WHERE {w} GROUP BY frame, chain_id, residue_id" for k, w in (("positive", f"resname IN {_in(m.POSITIVE)}"), ("negative", f"resname IN {_in(m.NEGATIVE)}"), ("aromatic", f"resname IN {_in(m.AROMATIC[:-1])} AND element IN ('C', 'N')"))) + ")"
_emb("pharmacophore_points", lambda s: grids.pharmacophore(s).select("frame", "kind", "key", *(_r(c, c) for c in "xyz"), "n"), f", {_PH} SELECT frame, kind, key, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z, n::BIGINT AS n FROM p")
_emb("pharmacophore_counts", lambda s: grids.pharmacophore(s).groupBy("kind").agg(F.count("*").alias("n")), f", {_PH} SELECT kind, count(*) AS n FROM p GROUP BY 1")
_emb("hydrophobic_regions", lambda s: grids.hydrophobic_regions(s).select("frame", "root", "n", _r("radius", "radius"), *(_r(c, c) for c in "xyz")), f", RECURSIVE_REACH SELECT frame, root, count(*) AS n, round(greatest(1.5e0, count(*) * 0.3e0), 4) AS radius, round(avg(x), 4) AS x, round(avg(y), 4) AS y, round(avg(z), 4) AS z FROM (SELECT f AS frame, b AS idx, min(a) AS root FROM reach GROUP BY f, b) JOIN s USING (frame, idx) GROUP BY frame, root")
ORACLE_SQL["hydrophobic_regions"] = ORACLE_SQL["hydrophobic_regions"].replace("WITH ", "WITH RECURSIVE ", 1).replace("RECURSIVE_REACH", f"near AS (SELECT a.frame AS f, a.idx AS a, b.idx AS b FROM s a JOIN s b ON a.frame = b.frame WHERE a.element IN ('C', 'S') AND b.element IN ('C', 'S') AND {D2} < 16e0), reach(f, a, b) AS (SELECT frame, idx, idx FROM s WHERE element IN ('C', 'S') UNION SELECT r.f, r.a, n.b FROM reach r JOIN near n ON n.f = r.f AND n.a = r.b)")

# editing
_part("remove_waters", lambda s: residues.reindex(edit.remove_waters(s)).select("idx", F.col("new_idx").cast("long").alias("new_idx")), f"SELECT idx, row_number() OVER (ORDER BY idx) - 1 AS new_idx FROM s WHERE resname NOT IN {_in(m.WATERS)}")
_part("remove_hetatm", lambda s: edit.remove_hetatm(s, ("LIG",)).select("idx", "resname"), f"SELECT idx, resname FROM s WHERE resname IN {_in(_AA + m.NUCLEOTIDES + m.WATERS + ('LIG',))}")
_emb("mutate_residue", lambda s: edit.mutate_residue(s, 2, "G").select("frame", "idx", "name", "resname", *(_r(c, c) for c in "xyz")), "SELECT frame, idx, name, CASE WHEN residue_id = 2 THEN 'GLY' ELSE resname END AS resname, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z FROM s WHERE residue_id <> 2 OR name IN ('N', 'CA', 'C', 'O', 'OXT')")
_CAP = lambda of, away, end, step, res, atom: f"SELECT frame, chain_id, ({end} {step})::INT AS residue_id, '{res}' AS resname, '{atom}' AS name, " + ", ".join(f"round({of}.{c} + 1.33e0 * ({of}.{c} - {away}.{c}) / sqrt(({of}.x - {away}.x) * ({of}.x - {away}.x) + ({of}.y - {away}.y) * ({of}.y - {away}.y) + ({of}.z - {away}.z) * ({of}.z - {away}.z)), 4) AS {c}" for c in "xyz") + f" FROM ends JOIN s {of} USING (frame, chain_id) JOIN s {away} USING (frame, chain_id) WHERE {of}.residue_id = {end} AND {away}.residue_id = {end} AND {of}.name = '{'N' if res == 'ACE' else 'C'}' AND {away}.name = 'CA'"
_emb("cap_termini", lambda s: edit.cap_termini(s).select("frame", "chain_id", "residue_id", "resname", "name", *(_r(c, c) for c in "xyz")), f", ends AS (SELECT frame, chain_id, min(residue_id) AS first_id, max(residue_id) AS last_id FROM s GROUP BY 1, 2) {_CAP('p', 'q', 'first_id', '- 1', 'ACE', 'CH3')} UNION ALL {_CAP('p', 'q', 'last_id', '+ 1', 'NME', 'N')}")
_GRID = "b AS (SELECT frame, " + ", ".join(f"min({c}) AS lo{c}, greatest(1, floor((max({c}) - min({c}) + 20) / 3.1e0))::BIGINT AS n{c}" for c in "xyz") + " FROM s GROUP BY frame), gr AS (SELECT frame, ix, iy, iz, " + ", ".join(f"lo{c} - 10 + (i{c} + 0.5e0) * 3.1e0 AS {c}" for c in "xyz") + " FROM b, " + ", ".join(f"unnest(range(n{c})) t{c}(i{c})" for c in "xyz") + ")"
_FREE = "gr a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE a.frame = b.frame AND b.element <> 'H' AND {D2} < 2.4e0 * 2.4e0)".replace("{D2}", D2)
_emb("water_sites", lambda s: edit.water_sites(s).select("frame", "ix", "iy", "iz", *(_r(c, c) for c in "xyz")), f", {_GRID} SELECT frame, ix::INT AS ix, iy::INT AS iy, iz::INT AS iz, " + ", ".join(f"round({c}, 4) AS {c}" for c in "xyz") + f" FROM {_FREE}")
_emb("water_box", lambda s: edit.water_box(s, most=10_000).groupBy("frame", "name").agg(F.count("*").alias("n"), *(_r(F.avg(c), c) for c in "xyz"), F.sum("residue_id").alias("numbers")),
    f", {_GRID}, w AS (SELECT frame, x, y, z, row_number() OVER (PARTITION BY frame ORDER BY ix, iy, iz) AS r FROM {_FREE} QUALIFY r <= 10000) SELECT frame, name, count(*) AS n, round(avg(x + dx), 4) AS x, round(avg(y + dy), 4) AS y, round(avg(z), 4) AS z, sum(r)::BIGINT AS numbers FROM w, (VALUES ('OW', 0e0, 0e0), ('HW1', 0.957e0, 0e0), ('HW2', -0.239e0, 0.927e0)) v(name, dx, dy) GROUP BY 1, 2")
# each scanned residue's frame twice, as it is and cut to ALA (both have their beta carbon); counted whole, not by neighbourhood
_VARIANTS = "s AS (SELECT s0.* REPLACE (s0.frame * 100 + k.rid * 2 + k.cut AS frame) FROM s0 CROSS JOIN (VALUES (1, 0), (1, 1), (3, 0), (3, 1)) k(rid, cut) WHERE k.cut = 0 OR s0.residue_id <> k.rid OR s0.name IN ('N', 'CA', 'C', 'O', 'OXT', 'CB'))"
_LOST = "lo AS (SELECT frame // 100 AS frame, frame % 100 // 2 AS residue_id, " + ", ".join(f"sum(CASE WHEN kind = '{k}' THEN 1 - frame % 2 * 2 ELSE 0 END)::BIGINT AS {k}" for k in ("hb", "hy", "cl")) + " FROM (SELECT frame, 'hb' AS kind FROM hbonds UNION ALL SELECT frame, 'hy' FROM hydrophobic UNION ALL SELECT frame, 'cl' FROM clashes) GROUP BY 1, 2)"
_emb("alanine_scan", lambda s: edit.alanine_scan(s).select("frame", "residue_id", "resname", *(F.col(c).cast("long").alias(c) for c in ("d_hbonds", "d_hydrophobic", "d_clashes")), "score"), f", {_VARIANTS}, {_HB_ALL}, {_CLASH}, {_HYDRO}, {_LOST}, r AS (SELECT frame, residue_id, upper(arg_min(resname, idx)) AS resname FROM s0 WHERE in_a GROUP BY 1, 2) SELECT r.frame, r.residue_id, resname, coalesce(hb, 0) AS d_hbonds, coalesce(hy, 0) AS d_hydrophobic, coalesce(cl, 0) AS d_clashes, (2 * coalesce(hb, 0) + coalesce(hy, 0) - 0.5e0 * coalesce(cl, 0))::DOUBLE AS score FROM r LEFT JOIN lo USING (frame, residue_id)")
ORACLE_SQL["alanine_scan"] = ORACLE_SQL["alanine_scan"].replace(", s AS (SELECT e.", ", s0 AS (SELECT e.", 1)
_ATOM_R = _case(m.CONTACT_RADIUS, "element", "1.7e0")
_POCKET = (
    "bx AS (SELECT " + ", ".join(f"min({c}) - 3.4e0 AS lo{c}, max({c}) + 3.4e0 - (min({c}) - 3.4e0) AS w{c}" for c in "xyz") + " FROM s), "
    "st AS (SELECT *, 1e0 AS step FROM bx), "
    "pg AS (SELECT step, gx, gy, gz, " + ", ".join(f"lo{c} + g{c} * step AS {c}" for c in "xyz") + " FROM st, " + ", ".join(f"unnest(range(ceil(w{c} / step)::BIGINT + 1)) t{c}(g{c})" for c in "xyz") + "), "
    f"ra AS (SELECT x, y, z, {_ATOM_R} AS r FROM s), "
    f"near AS (SELECT a.gx, a.gy, a.gz, a.step, {D} - b.r AS gap FROM pg a JOIN ra b ON b.x BETWEEN a.x - 7 AND a.x + 7 WHERE {D} - b.r < 5), "
    "pts AS (SELECT gx, gy, gz FROM near GROUP BY gx, gy, gz, step HAVING count(CASE WHEN gap < 1.4e0 THEN 1 END) = 0 AND count(*) >= greatest(3, floor(5e0 / step)))"
)
_part("pocket_points", lambda s: grids.pocket_points(s).select("gx", "gy", "gz"), f", {_POCKET} SELECT gx::INT AS gx, gy::INT AS gy, gz::INT AS gz FROM pts")
_SITES = (
    "cp AS MATERIALIZED (SELECT (gx::HUGEINT * 4294967296 + gy) * 4294967296 + gz AS id, gx, " + ", ".join(f"lo{c} + g{c} * step AS {c}" for c in "xyz") + ", step FROM pts, st), "
    f"ed AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM cp a JOIN cp b ON a.id <> b.id AND b.gx BETWEEN a.gx - 3 AND a.gx + 3 WHERE {D2} < 9 * a.step * a.step), "
    "rt(id, root) USING KEY (id) AS (SELECT id, id AS root FROM cp UNION SELECT ed.a, min(rt.root) FROM rt JOIN ed ON ed.b = rt.id JOIN recurring.rt AS old ON old.id = ed.a WHERE rt.root < old.root GROUP BY ed.a), "
    "po AS (SELECT root, count(*) * any_value(step) ** 3 AS volume, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM (SELECT id, min(root) AS root FROM rt GROUP BY 1) JOIN cp USING (id) GROUP BY 1 HAVING volume >= 100), "
    f"li AS (SELECT a.root, any_value(a.volume) AS volume, count(b.x) AS lining, count(CASE WHEN upper(b.element) = 'C' THEN 1 END) AS carbon FROM po a LEFT JOIN s b ON {D2} < 100 GROUP BY 1), "
    "sc AS (SELECT *, volume * 0.01e0 + carbon::DOUBLE / greatest(lining, 1) * 10e0 AS score FROM li)"
)
_part("binding_sites", lambda s: grids.binding_sites(s).select("rank", _r("volume", "volume"), _r("score", "score"), "lining"), f", {_POCKET}, {_SITES} SELECT row_number() OVER (ORDER BY score DESC, root)::INT AS rank, round(volume, 4) AS volume, round(score, 4) AS score, lining FROM sc")
ORACLE_SQL["binding_sites"] = ORACLE_SQL["binding_sites"].replace("WITH", "WITH RECURSIVE", 1)

# molecules
_add(
    "matched_pairs",
    lambda spark, d: molecules.matched_pairs(fragments(spark, d)).select("mol_a", "mol_b", "core", "group_a", "group_b", F.round("ratio", 6).alias("ratio")),
    "WITH f AS (SELECT p_partkey AS mol, 10 + p_size % 30 AS heavy, p_brand || ':' || p_size % 5 AS core, p_type AS rgroup, p_size % 7 + 1 AS n FROM part) SELECT a.mol AS mol_a, b.mol AS mol_b, a.core, a.rgroup AS group_a, b.rgroup AS group_b, round(a.n / greatest(a.heavy, b.heavy)::DOUBLE, 6) AS ratio FROM f a JOIN f b ON a.core = b.core AND a.mol < b.mol AND a.rgroup <> b.rgroup WHERE a.n / greatest(a.heavy, b.heavy)::DOUBLE <= 0.33e0",
)
_add("diverse_conformers", lambda spark, d: molecules.diverse_conformers(conformers(spark, d), 8.0, 5.0))

# sinks and learning
_part("export_rows", lambda s: s.select("idx", "element", "resname", "residue_id", *(F.format_string("%.3f", F.col(c)).alias(c) for c in "xyz")), "SELECT idx, element, resname, residue_id, printf('%.3f', x) AS x, printf('%.3f', y) AS y, printf('%.3f', z) AS z FROM s")
_emb("kmeans_frames", lambda s: learn.cluster_frames(s, 5))
_emb("ward_frames", lambda s: learn.ward_frames(s, 3))
_emb("qsar_ridge", lambda s: learn.fit_frames(s))
_emb("qsar_forest", lambda s: learn.fit_frames(s, "forest"))
_emb("qsar_svr", lambda s: learn.fit_frames(s, "svr"))
_add("seq_align", lambda spark, d: learn.align_chains(residues.extract_sequence(part_system(spark, d).drop("frame"))))

# selections of residues, frames and plugins
_part("residue_range", lambda s: s.where(index_range("2-9, 14", "residue_id")).select("idx", "residue_id"), "SELECT idx, residue_id FROM s WHERE residue_id BETWEEN 2 AND 9 OR residue_id = 14")
_part("residue_atoms", lambda s: edit.residue_atoms(s, 5).select("idx", "name"), "SELECT idx, name FROM s WHERE residue_id = 5")
_emb("one_frame", lambda s: plugins.PluginApi(s).frame(7).select("idx", *(_r(c, c) for c in "xyz")), "SELECT idx, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z FROM s WHERE frame = 7")
_emb("subsampled_frames", lambda s: trajectory.subsample(s, 50).select("frame", "idx"), ", f AS (SELECT frame, row_number() OVER (ORDER BY frame) - 1 AS place, greatest(1, count(*) OVER () // 50) AS step FROM (SELECT DISTINCT frame FROM s)) SELECT frame, idx FROM s JOIN f USING (frame) WHERE place % step = 0 AND place / step < 50")
_part("sorted_atoms", lambda s: s.orderBy(F.desc("z"), "idx").limit(50).select("idx", _r("z", "z")), "SELECT idx, round(z, 4) AS z FROM (SELECT * FROM s ORDER BY z DESC, idx LIMIT 50)")


def _plugin(api: plugins.PluginApi) -> DataFrame:
    """A user function: it marks rings, adds a bad selection, which selects nothing, and counts what it marked."""
    api.highlight("ring", F.col("resname").isin("PHE", "TYR", "TRP"))
    return api.system.where(api.selection("named ring AND element == C") | api.selection("nonsense ==")).groupBy("resname").agg(F.count("*").alias("n"))


_part("plugin_marks", lambda s: plugins.run_plugin(_plugin, plugins.PluginApi(s)), "SELECT resname, count(*) AS n FROM s WHERE resname IN ('PHE', 'TYR', 'TRP') AND element = 'C' GROUP BY 1")
_part("frame_map", lambda s: plugins.map_frames(s.select("frame", "x"), lambda p: p.groupby("frame", as_index=False).agg(widest=("x", "max")), "frame bigint, widest double").select("frame", _r("widest", "widest")), "SELECT frame, round(max(x), 4) AS widest FROM s GROUP BY 1")

# what the added operators give
_emb("picked_atom", lambda s: spatial.picked_atom(s, spatial.bonds_within(s, 3.0), 0.5, 0.5, 0.5).select("frame", "idx", _r("d", "d"), F.array_join(F.transform("bonded", lambda b: b.cast("string")), ",").alias("bonded")), f", near AS (SELECT frame, idx, sqrt(d2) AS d FROM (SELECT frame, idx, (x - 0.5e0) * (x - 0.5e0) + (y - 0.5e0) * (y - 0.5e0) + (z - 0.5e0) * (z - 0.5e0) AS d2 FROM s) QUALIFY row_number() OVER (PARTITION BY frame ORDER BY d2, idx) = 1), bo AS (SELECT a.frame, a.idx, b.idx AS other FROM s a JOIN s b ON a.frame = b.frame AND a.idx <> b.idx WHERE {D2} <= 9e0) SELECT n.frame, n.idx, round(n.d, 4) AS d, coalesce((SELECT string_agg(other::VARCHAR, ',' ORDER BY other) FROM (SELECT other FROM bo WHERE bo.frame = n.frame AND bo.idx = n.idx ORDER BY other LIMIT 8)), '') AS bonded FROM near n")
_part("line_cells", lambda s: spatial.line_array(spatial.bonds_within(s, 1.8)).select(F.array_join(F.transform("cell", lambda c: c.cast("string")), " ").alias("cell")), f"SELECT '2 ' || a.idx || ' ' || b.idx AS cell FROM s a JOIN s b ON a.idx < b.idx WHERE {D2} <= 1.8e0 * 1.8e0")
_part("line_pairs", lambda s: spatial.line_pairs(spatial.line_array(spatial.bonds_within(s, 1.8))), f"SELECT a.idx AS i, b.idx AS j FROM s a JOIN s b ON a.idx < b.idx WHERE {D2} <= 1.8e0 * 1.8e0")
_part("effective_colors", lambda s: spatial.effective_colors(s, tuple((F.col("type_id") % k) / float(k) for k in (2, 3, 5)), F.col("chain_id") == "B").select("idx", *(_r(c, c) for c in "rgb")), "SELECT idx, " + ", ".join(f"round(CASE WHEN chain_id = 'B' THEN {h}e0 WHEN EXISTS (SELECT 1 FROM s WHERE chain_id = 'B') THEN (type_id % {k}) / {k}e0 * 0.2e0 ELSE (type_id % {k}) / {k}e0 END, 4) AS {c}" for c, k, h in zip("rgb", (2, 3, 5), (1.0, 0.85, 0.2), strict=True)) + " FROM s")
_emb("pharmacophore_json", lambda s: grids.pharmacophore_json(grids.pharmacophore(s)), f""", {_PH} SELECT frame, '{{"n_features":' || count(*) || ',"features":[' || string_agg('{{"type":"' || kind || '","key":"' || key || '","center":[' || round(x, 4)::DECIMAL(18,4) || ',' || round(y, 4)::DECIMAL(18,4) || ',' || round(z, 4)::DECIMAL(18,4) || '],"n_atoms":' || n || '}}', ',' ORDER BY kind, key) || ']}}' AS json FROM p GROUP BY frame""")
_emb("divergent_mean", lambda s: trajectory.divergent_frames(s)[1].select(_r("mean", "mean")), f"SELECT round(avg(r), 4) AS mean FROM (SELECT sqrt(sum({D2}) / count(*)) AS r {_PAIRS} GROUP BY a.frame, b.frame) WHERE r > 0")
_emb("top_flexible", lambda s: trajectory.rmsf_per_residue(s).orderBy(F.desc("rmsf"), "residue_id").limit(3).select("residue_id", _r("rmsf", "rmsf")), f"SELECT residue_id, round(r, 4) AS rmsf FROM (SELECT residue_id, avg(r) AS r FROM (SELECT residue_id, idx, {_RMSF} AS r FROM s GROUP BY 1, 2) GROUP BY 1) ORDER BY r DESC, residue_id LIMIT 3")
_emb("rmsf_report", lambda s: sinks.text_report(trajectory.rmsf(s), "idx", "rmsf", "RMSF by atom", 5).select(F.col("n").cast("bigint").alias("n"), "line"), f", f AS (SELECT idx, {_RMSF} AS r FROM s GROUP BY idx), h AS (SELECT count(*) AS c, min(r) AS lo, avg(r) AS mid, max(r) AS hi FROM f) SELECT 0::BIGINT AS n, 'RMSF by atom' AS line UNION ALL SELECT 1, 'n ' || c FROM h UNION ALL SELECT 2, 'min ' || printf('%.4f', lo) FROM h UNION ALL SELECT 3, 'mean ' || printf('%.4f', mid) FROM h UNION ALL SELECT 4, 'max ' || printf('%.4f', hi) FROM h UNION ALL SELECT n + 4, line FROM (SELECT row_number() OVER (ORDER BY r DESC, idx) AS n, idx || '  ' || printf('%.4f', r) AS line FROM f QUALIFY n <= 5)")
_emb("cluster_medoids", lambda s: learn.describe_clusters(s, s.select("frame", (F.col("frame") % 5).alias("cluster")).distinct()).select("cluster", "size", "medoid", F.round("inertia", 2).alias("inertia")), ", c AS (SELECT frame % 5 AS cluster, idx, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM s GROUP BY 1, 2), e AS (SELECT cluster, frame, sum((s.x - c.x) * (s.x - c.x) + (s.y - c.y) * (s.y - c.y) + (s.z - c.z) * (s.z - c.z)) AS d2 FROM s JOIN c ON c.cluster = s.frame % 5 AND c.idx = s.idx GROUP BY 1, 2) SELECT cluster, count(*) AS size, arg_min(frame, d2) AS medoid, round(sum(d2), 2) AS inertia FROM e GROUP BY 1")
_part("box_from_extent", lambda s: sinks.box_nm(s).select(*(_r(f"l{c}", f"l{c}") for c in "xyz")), "SELECT " + ", ".join(f"round((max({c}) - min({c})) / 10 + 2, 4) AS l{c}" for c in "xyz") + " FROM s")
_part("missing_hydrogens", lambda s: simulation.missing_hydrogens(s), "SELECT count(CASE WHEN upper(element) = 'H' THEN 1 END) = 0 AS missing FROM s")
_emb("solvated_system", lambda s: edit.solvate(s).groupBy("frame", "name").agg(F.count("*").alias("n"), F.min("idx").alias("first"), F.max("idx").alias("last"), _r(F.avg("x"), "x")), f", {_GRID}, w AS (SELECT frame, x, row_number() OVER (PARTITION BY frame ORDER BY ix, iy, iz) AS r FROM {_FREE}), o AS (SELECT frame, name, row_number() OVER (PARTITION BY frame ORDER BY idx) - 1 AS idx, x FROM s), n AS (SELECT frame, count(*) AS n FROM s GROUP BY 1), a AS (SELECT * FROM o UNION ALL SELECT w.frame, v.name, n.n + 3 * (r - 1) + k, w.x + dx FROM w JOIN n USING (frame), (VALUES ('OW', 0, 0e0), ('HW1', 1, 0.957e0), ('HW2', 2, -0.239e0)) v(name, k, dx)) SELECT frame, name, count(*) AS n, min(idx)::BIGINT AS first, max(idx)::BIGINT AS last, round(avg(x), 4) AS x FROM a GROUP BY 1, 2")
_CHAINS = "ch AS (SELECT frame, chain_id, min(idx) AS first FROM s GROUP BY 1, 2)"
_emb("capped_structure", lambda s: edit.capped_structure(s).select("frame", "idx", "name", "resname", "residue_id", *(_r(c, c) for c in "xyz")), f", ends AS (SELECT frame, chain_id, min(residue_id) AS first_id, max(residue_id) AS last_id FROM s GROUP BY 1, 2), {_CHAINS}, caps AS (SELECT frame, chain_id, residue_id, resname, name, x, y, z FROM ({_CAP('p', 'q', 'first_id', '- 1', 'ACE', 'CH3')} UNION ALL {_CAP('p', 'q', 'last_id', '+ 1', 'NME', 'N')})), k AS (SELECT caps.*, row_number() OVER (PARTITION BY frame, resname ORDER BY first) - 1 AS rank, count(CASE WHEN resname = 'ACE' THEN 1 END) OVER (PARTITION BY frame) AS front FROM caps JOIN ch USING (frame, chain_id)), n AS (SELECT frame, count(*) AS n FROM s GROUP BY 1), fr AS (SELECT frame, max(front) AS front FROM k GROUP BY 1) SELECT frame, (row_number() OVER (PARTITION BY frame ORDER BY idx) - 1 + coalesce(front, 0))::BIGINT AS idx, name, resname, residue_id, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z FROM s LEFT JOIN fr USING (frame) UNION ALL SELECT frame, (CASE WHEN resname = 'ACE' THEN front - 1 - rank ELSE front + n + rank END)::BIGINT, name, resname, residue_id, x, y, z FROM k JOIN n USING (frame)")
_emb("mutations_in_turn", lambda s: edit.apply_mutations(s, [(2, "G"), (3, "GLY")]).select("frame", "idx", "name", "resname", *(_r(c, c) for c in "xyz")), "SELECT frame, idx, name, CASE WHEN residue_id IN (2, 3) THEN 'GLY' ELSE resname END AS resname, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z FROM s WHERE residue_id NOT IN (2, 3) OR name IN ('N', 'CA', 'C', 'O', 'OXT')")
ORACLE_SQL["diverse_conformers"] = "WITH RECURSIVE c AS (SELECT vec_id // 50 AS mol, vec_id AS conformer, embedding[64]::DOUBLE * 20 AS energy, list_transform(embedding[1:63], lambda x: x::DOUBLE * 20) AS coords FROM embeddings), lim AS (SELECT mol, coalesce(min(CASE WHEN energy <> 0 THEN energy END), 0) + 8e0 AS most FROM c GROUP BY 1), o AS (SELECT c.*, row_number() OVER (PARTITION BY mol ORDER BY energy, conformer) AS n FROM c JOIN lim USING (mol) WHERE energy = 0 OR energy <= most), near AS (SELECT b.mol, b.conformer, list(a.conformer) AS close FROM o a JOIN o b ON a.mol = b.mol AND a.n < b.n WHERE list_distance(a.coords, b.coords) * sqrt(3 / 63e0) < 5e0 GROUP BY 1, 2), od AS (SELECT o.mol, o.conformer, o.energy, o.n, coalesce(close, []) AS close FROM o LEFT JOIN near USING (mol, conformer)), r(mol, n, kept) AS (SELECT DISTINCT mol, 0::BIGINT, []::BIGINT[] FROM od UNION ALL SELECT r.mol, r.n + 1, CASE WHEN list_has_any(r.kept, od.close) THEN r.kept ELSE list_append(r.kept, od.conformer) END FROM r JOIN od ON od.mol = r.mol AND od.n = r.n + 1), done AS (SELECT mol, arg_max(kept, n) AS kept FROM r GROUP BY 1) SELECT od.mol, od.conformer, od.energy, list_position(kept, od.conformer)::INT AS rank FROM od JOIN done USING (mol) WHERE list_contains(kept, od.conformer)"

# readers and writers
QUERIES.update(files.QUERIES)
ORACLE_SQL.update(files.ORACLE_SQL)

# a beta carbon for a residue without one: outward of the backbone, as the mutation places it
_bare = lambda s: s.where("NOT (residue_id = 2 AND name = 'CB')")
_VECTORS = ["w AS (SELECT n.frame, " + ", ".join(f"a.{c} AS a{c}, n.{c} - a.{c} AS n{c}, c.{c} - a.{c} AS c{c}" for c in "xyz") + " FROM s n JOIN s a ON a.frame = n.frame AND a.residue_id = 2 AND a.name = 'CA' JOIN s c ON c.frame = n.frame AND c.residue_id = 2 AND c.name = 'C' WHERE n.residue_id = 2 AND n.name = 'N')"]
_length = lambda v: f"sqrt({v}x * {v}x + {v}y * {v}y + {v}z * {v}z)"
_VECTORS.append(f"u AS (SELECT *, {', '.join(f'n{c} / {_length(chr(110))} AS u{c}, c{c} / {_length(chr(99))} AS v{c}' for c in 'xyz')} FROM w)")
_VECTORS.append("o AS (SELECT *, " + ", ".join(f"-(u{c} + v{c}) AS o{c}" for c in "xyz") + ", uy * vz - uz * vy AS px, uz * vx - ux * vz AS py, ux * vy - uy * vx AS pz FROM u)")
_VECTORS.append(f"q AS (SELECT *, {', '.join(f'0.58e0 * o{c} / {_length(chr(111))} + 0.82e0 * p{c} / {_length(chr(112))} AS q{c}' for c in 'xyz')} FROM o)")
_emb(
    "mutate_to_alanine",
    lambda s: edit.mutate_residue(_bare(s), 2, "ALA").where("residue_id = 2").select("frame", "name", "resname", *(_r(c, c) for c in "xyz")),
    f", {', '.join(_VECTORS)} SELECT frame, name, 'ALA' AS resname, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z FROM s WHERE residue_id = 2 AND name <> 'CB' UNION ALL SELECT frame, 'CB', 'ALA', "
    + ", ".join(f"round(a{c} + 1.52e0 * q{c} / {_length('q')}, 4)" for c in "xyz")
    + " FROM q",
)


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fluctuations of a trajectory that arrives in eight files, two a batch, over a restart."""
    source, out, kept = (new_path(spark, n) for n in ("arriving", "rmsf", "rmsf-state"))
    system = embeddings_system(spark, sf_dir)
    rows = system.select("frame", "idx", *(F.col(c).cast("double").alias(c) for c in "xyz"))
    schema = ", ".join(f"{n} {k}" for n, k in rows.dtypes)
    for half in (0, 1):
        rows.where(F.col("frame") % 2 == half).repartition(4, "frame").write.mode("append").parquet(source)
        frames.stream_rmsf(spark, source, schema, out, kept, files=2, once=True).awaitTermination()
    return frames.latest_rmsf(spark, out).select("idx", "frames", _r("rmsf", "rmsf"))


_add("stream_rmsf", _streamed, f"WITH {EMB_SQL} SELECT idx, count(*) AS frames, round(sqrt(var_pop(x) + var_pop(y) + var_pop(z)), 4) AS rmsf FROM s GROUP BY idx")


def _by_sql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query in SQL over the view `particles`, with the functions that sql.register() gives."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        sql.register(spark)
        return spark.sql(text, particles=embeddings_system(spark, sf_dir))

    return query


_add("sql_selection", _by_sql("SELECT frame, idx, name FROM {particles} WHERE is_backbone(name) AND NOT is_water(resname)"), f"WITH {EMB_SQL} SELECT frame, idx, name FROM s WHERE name IN ('N', 'CA', 'C', 'O') AND resname <> 'HOH'")
_add(
    "sql_circular_mean",
    _by_sql("SELECT idx, round(circular_mean(degrees(atan2(y, x))), 4) AS angle FROM {particles} GROUP BY idx"),
    f"WITH {EMB_SQL} SELECT idx, round(degrees(atan2(avg(sin(atan2(y, x))), avg(cos(atan2(y, x))))), 4) AS angle FROM s GROUP BY idx",
)
_CENTRED = ", ".join(f"{c} - avg({c}) OVER (PARTITION BY frame) AS {c}" for c in "xyz")
_add(
    "sql_frame_shape",
    _by_sql("SELECT frame, n, round(gyration, 4) AS gyration, round(long * long + middle * middle + short * short, 3) AS total FROM frame_shape(TABLE (SELECT frame, x, y, z FROM {particles}) PARTITION BY frame)"),
    f"WITH {EMB_SQL} SELECT frame, count(*)::INT AS n, round(sqrt(avg(x * x + y * y + z * z)), 4) AS gyration, round(avg(x * x + y * y + z * z), 3) AS total FROM (SELECT frame, {_CENTRED} FROM s) GROUP BY frame",
)


# superposed coordinates: their distance to the first frame is the least that any rotation gives
_emb("aligned_rmsd", lambda s: trajectory.rmsd_to_frame(trajectory.superimpose_trajectory(s)).select("frame", (F.round("rmsd", 3) + 0.0).alias("rmsd")))
ORACLE_SQL["aligned_rmsd"] = ORACLE_SQL["kabsch_rmsd_traj"]


def _report_sql(query: str, title: tuple[str, str], cells: dict[str, str], order: str, top: int, tail: str | None = None) -> str:
    """SQL of a report's lines. cells: headings, right-aligned, and the expressions below them; tail: an aggregate."""
    heading = "  ".join(cells)
    last = f" UNION ALL SELECT {top + 4}, {tail} FROM q" if tail else ""
    return f"""WITH q AS ({query}) SELECT 0::BIGINT AS n, '{title[0]}  (' || count(*) || ' {title[1]})' AS line FROM q
UNION ALL SELECT 1, '{heading}' UNION ALL SELECT 2, '{"-" * len(heading)}'
UNION ALL SELECT n + 2, line FROM (SELECT row_number() OVER (ORDER BY {order}) AS n, {" || '  ' || ".join(cells.values())} AS line FROM q QUALIFY n <= {top})
UNION ALL SELECT {top + 3}, '... ' || (count(*) - {top}) || ' more' FROM q HAVING count(*) > {top}{last}"""


_lines = lambda report: report.select(F.col("n").cast("bigint").alias("n"), "line")
_emb("scan_report", lambda s: _lines(sinks.scan_report(edit.alanine_scan(s))))
ORACLE_SQL["scan_report"] = _report_sql(
    ORACLE_SQL["alanine_scan"],
    ("ALANINE SCAN", "residues"),
    {
        " FRAME": "printf('%6d', frame)",
        " RESID": "printf('%6d', residue_id)",
        " RES": "printf('%4s', resname)",
        "  ΔHB": "printf('%5d', d_hbonds)",
        "ΔHYDRO": "printf('%6d', d_hydrophobic)",
        "ΔCLASH": "printf('%6d', d_clashes)",
        "  SCORE": "printf('%7.2f', score) || CASE WHEN score >= 1.5e0 THEN '  ★' ELSE '' END",
    },
    "score DESC, frame, residue_id",
    1000,
    "'HOT-SPOT RESIDUES: ' || count(CASE WHEN score >= 1.5e0 THEN 1 END)",
)
_emb("bead_report", lambda s: _lines(sinks.bead_report(residues.cg_beads(s))))
ORACLE_SQL["bead_report"] = _report_sql(
    ORACLE_SQL["cg_beads"],
    ("BEAD MAPPING", "beads"),
    {" FRAME": "printf('%6d', frame)", " RESID": "printf('%6d', residue_id)", " BEAD": "printf('%5s', bead)", "  TYPE": "printf('%6s', bead_type)"},
    "frame, chain_id, residue_id, bead_order",
    50,
    "'TYPES: ' || (SELECT string_agg(bead_type || ' ' || k, ', ' ORDER BY k DESC, bead_type) FROM (SELECT bead_type, count(*) AS k FROM q GROUP BY 1)) || left(min(bead_type), 0)",
)
