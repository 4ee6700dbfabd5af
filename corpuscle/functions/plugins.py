"""User functions over a system: callables in place of scripts."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.selection import SelectionError, compile_selection


class PluginApi:
    """What a user function gets: the system's tables, selections, marks, a log and exports."""

    def __init__(self, system: DataFrame):
        self.system, self.named, self.messages = system, {}, []

    def n_atoms(self) -> int:
        return self.system.select("idx").distinct().count()

    def n_frames(self) -> int:
        return self.system.select("frame").distinct().count()

    def frame(self, n: int) -> DataFrame:
        return self.system.where(F.col("frame") == n)

    def selection(self, text: str) -> Column:
        """The predicate of a selection; a bad text is logged and selects nothing."""
        try:
            return compile_selection(text, self.named)
        except SelectionError as e:
            self.log(f"selection: {e}")
            return F.lit(False)

    def highlight(self, name: str, predicate: Column) -> None:
        self.named[name] = predicate

    def log(self, *values: object) -> None:
        self.messages.append(" ".join(map(str, values)))

    def export(self, value: object, path: str, kind: str = "json") -> None:
        """A table in a format of Spark's; on the driver an array as .npy, a dict or list as JSON, all else as text."""
        if isinstance(value, DataFrame):
            getattr(value.write, {"json": "json", "csv": "csv", "parquet": "parquet"}[kind])(path)
        elif isinstance(value, np.ndarray):
            np.save(path, value)
        else:
            with open(path, "w", encoding="utf-8") as f:
                f.write(json.dumps(value) if isinstance(value, dict | list | tuple) else str(value))


def run_plugin(function: Callable[[PluginApi], object], api: PluginApi) -> object:
    """The function's result; an error goes to the log and gives None."""
    try:
        return function(api)
    except Exception as e:  # a user's function may raise anything
        api.log(f"{type(e).__name__}: {e}")
        return None


def map_frames(system: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Applies function to the atoms of each frame."""
    return system.groupBy("frame").applyInPandas(function, schema)
