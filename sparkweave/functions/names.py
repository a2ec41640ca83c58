"""Column functions on symbol names and paths, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dotted(name: Column) -> Column:
    """A qualified name with dots, whatever its language separates parts with."""
    return F.replace(name, F.lit("::"), F.lit("."))


def normal_path(path: Column) -> Column:
    """A path without ``.`` and with ``..`` worked off."""

    def step(done: Column, x: Column) -> Column:
        up = (x == "..") & (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)) != "..")
        return F.when((x == "") | (x == "."), done).when(up, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, x))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folders(path: Column) -> Column:
    """The folders of a path, outermost first."""
    return F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
