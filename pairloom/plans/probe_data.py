"""Datasets for probes, from a table of pairs of hidden vectors: one row for each pair and layer.

Columns of a pair: ``layer``, ``family``, ``attribute``, ``context``, ``group`` (which must not be split),
``valid`` (whether both vectors were found), ``original`` and ``edited``. Each builder gives (task, layer,
family, y, group, v), y a string; rows of a NULL or false ``valid`` are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = "control"
COLUMNS = ["task", "layer", "family", "y", "group", "v"]


def _rows(pairs: DataFrame, task: str, family: Column, y: Column, vec: Column) -> DataFrame:
    made = pairs.where("valid").select(F.lit(task).alias("task"), "layer", family.alias("family"), y.cast("string").alias("y"), "group", vec.alias("v"))
    return made.where("y is not null")


def original_or_edited(pairs: DataFrame) -> DataFrame:
    """ST14 A, for each family: both vectors of a pair, which of them is the edited one."""
    sides = F.explode(F.array(F.struct(F.lit("orig").alias("y"), F.col("original").alias("v")), F.struct(F.lit("cf").alias("y"), F.col("edited").alias("v"))))
    long = pairs.where("valid").select("layer", "family", "group", sides.alias("s"))
    return long.select(F.lit("orig_vs_cf").alias("task"), "layer", "family", F.col("s.y").alias("y"), "group", F.col("s.v").alias("v"))


def family_identity(pairs: DataFrame, families: list[str]) -> DataFrame:
    """ST14 B: which of the named families an edited vector is of."""
    return _rows(pairs.where(F.col("family").isin(families)), "family_identity", F.lit("global"), F.col("family"), F.col("edited"))


def attribute_in_family(pairs: DataFrame, least: int, excluded: list[str] | None = None) -> DataFrame:
    """ST14 C, for each family: the attribute of an edited vector, of attributes with at least ``least`` pairs (at
    a layer, valid or not); families with fewer than two of these are left out."""
    rows = pairs.where(~F.coalesce(F.col("attribute").isin(excluded or []), F.lit(False))) if excluded else pairs
    sizes = rows.groupBy("layer", "family", "attribute").agg(F.count("*").alias("_n")).where((F.col("_n") >= least) & F.col("attribute").isNotNull())
    enough = sizes.groupBy("layer", "family").agg(F.count("*").alias("_k")).where("_k >= 2")
    kept = sizes.join(enough, ["layer", "family"]).select("layer", "family", "attribute")
    return _rows(rows.join(kept, ["layer", "family", "attribute"]), "within_family_attribute", F.col("family"), F.col("attribute"), F.col("edited"))


def context_split(pairs: DataFrame, family: str, labels: tuple[str, str] = ("partner", "explicit")) -> DataFrame:
    """ST14 D: which of two contexts an edited vector of a family has; others are left out."""
    rows = pairs.where((F.col("family") == family) & F.col("context").isin(list(labels)))
    return _rows(rows, "context_split", F.lit(family), F.col("context"), F.col("edited"))


def focal_or_control(pairs: DataFrame, families: list[str]) -> DataFrame:
    """ST14 E, for each named family: its edited vectors against those of the controls, which are copied to every
    family; families or layers without both are left out."""
    side = F.when(F.col("family") == CONTROL, F.array(*[F.lit(f) for f in families])).when(F.col("family").isin(families), F.array("family"))
    made = pairs.where("valid").select("layer", F.explode(side).alias("focal"), F.when(F.col("family") == CONTROL, "control").otherwise("focal").alias("y"), "group", F.col("edited").alias("v"))
    both = made.groupBy("layer", "focal").agg(F.count_distinct("y").alias("_k")).where("_k = 2").drop("_k")
    out = made.join(both, ["layer", "focal"])
    return out.select(F.lit("focal_vs_control_cf").alias("task"), "layer", F.col("focal").alias("family"), "y", "group", "v")


def every_task(pairs: DataFrame, families: list[str], least: int, context_family: str, labels: tuple[str, str] = ("partner", "explicit")) -> DataFrame:
    """The five datasets in one table: a sweep takes (task, family, layer) as its key."""
    made = [original_or_edited(pairs), family_identity(pairs, families), attribute_in_family(pairs, least), context_split(pairs, context_family, labels), focal_or_control(pairs, families)]
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out.select(*COLUMNS)
