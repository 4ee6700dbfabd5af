"""What SQL can call: selections as functions, an aggregate over angles, and a table function over the atoms of a frame."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, Row, SparkSession
from pyspark.sql import functions as F

from corpuscle import model as m
from corpuscle.functions.selection import compile_selection

#: Columns of a system that selections may use, with their types.
COLUMNS = {"idx": "BIGINT", "id": "BIGINT", "type_id": "INT", "element": "STRING", "x": "DOUBLE", "y": "DOUBLE", "z": "DOUBLE", "residue_id": "INT", "chain_id": "STRING", "name": "STRING", "resname": "STRING"}


def register_selection(spark: SparkSession, name: str, text: str, dialect: str = "core", named: dict[str, Column] | None = None) -> list[str]:
    """Makes a selection a temporary function of SQL: name(columns that it uses, in the order of COLUMNS). Returns these columns.

    The function's body is the compiled predicate, so a call is planned, pushed down and compiled like any expression.
    """
    if not re.fullmatch(r"[A-Za-z_]\w*", name):
        raise ValueError(f"no function name: {name!r}")
    schema = ", ".join(f"{c} {k}" for c, k in COLUMNS.items())
    chosen = spark.createDataFrame([], schema).where(compile_selection(text, named, dialect))
    body = chosen._jdf.queryExecution().analyzed().condition().sql()
    used = [c for c in COLUMNS if re.search(rf"(?<![\w'])`?{c}`?(?![\w'(])", re.sub(r"'(?:[^'\\]|\\.)*'", "''", body))]
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(f'{c} {COLUMNS[c]}' for c in used)}) RETURNS BOOLEAN RETURN {body}")
    return used


def circular_mean(degrees: pd.Series) -> float:
    """The mean direction of angles; null where there are none, or where they cancel out."""
    angles = np.radians(degrees.dropna().to_numpy(float))
    if not len(angles):
        return None
    x, y = np.cos(angles).mean(), np.sin(angles).mean()
    return float(np.degrees(np.arctan2(y, x))) if np.hypot(x, y) > 1e-9 else None


class FrameShape:
    """Of the atoms of a partition: their number, the radius of gyration and the three extents along their own axes, the longest first."""

    def __init__(self) -> None:
        self.points: list[tuple[float, float, float]] = []
        self.key: tuple | None = None

    def eval(self, row: Row) -> None:
        self.key = tuple(row[k] if k in row else None for k in ("path", "frame"))
        if None not in (row["x"], row["y"], row["z"]):
            self.points.append((row["x"], row["y"], row["z"]))

    def terminate(self) -> Iterator[tuple]:
        if self.key is not None and self.points:
            xyz = np.array(self.points, float)
            xyz -= xyz.mean(0)
            spread = np.sqrt(np.maximum(np.linalg.eigvalsh(xyz.T @ xyz / len(xyz))[::-1], 0))
            yield (*self.key, len(xyz), float(np.sqrt((xyz * xyz).sum() / len(xyz))), *map(float, spread))


def register(spark: SparkSession, selections: dict[str, str] | None = None) -> None:
    """Registers circular_mean(angle), frame_shape(TABLE (...) PARTITION BY frame), and the selections by name."""
    spark.udf.register("circular_mean", F.pandas_udf(circular_mean, "double"))
    spark.udtf.register("frame_shape", F.udtf(FrameShape, returnType="path string, frame bigint, n int, gyration double, long double, middle double, short double"))
    for name, text in (selections or {"is_backbone": "name == N OR name == CA OR name == C OR name == O", "is_water": " OR ".join(f"resname == {w}" for w in m.WATERS)}).items():
        register_selection(spark, name, text)
