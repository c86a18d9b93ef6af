"""Navigation between symbols, as equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.stages import cut


def _to(df: DataFrame, symbols: DataFrame, key: str, prefix: str, columns: tuple[str, ...], how: str) -> DataFrame:
    other = symbols.select(F.col("sym_id").alias("_key"), *[F.col(c).alias(prefix + c) for c in columns])
    return df.join(other, df[key] == other["_key"], how).drop("_key")


def with_type(df: DataFrame, symbols: DataFrame, columns: tuple[str, ...] = ("sym_tag", "name")) -> DataFrame:
    """Each symbol with its type, if it has one; columns come as type_..."""
    return _to(df, symbols, "type_id", "type_", columns, "left")


def with_class_parent(df: DataFrame, symbols: DataFrame, columns: tuple[str, ...] = ("name",)) -> DataFrame:
    return _to(df, symbols, "class_parent_id", "class_", columns, "left")


def with_lexical_parent(df: DataFrame, symbols: DataFrame, columns: tuple[str, ...] = ("name",)) -> DataFrame:
    return _to(df, symbols, "lexical_parent_id", "lexical_", columns, "left")


def children_of(parents: DataFrame, symbols: DataFrame, tag: str | None = None) -> DataFrame:
    """Children of many symbols at once; parents needs sym_id alone."""
    kids = symbols.where(F.col("sym_tag") == tag) if tag else symbols
    return kids.join(parents.select(F.col("sym_id").alias("parent_id")).distinct(), "parent_id", "left_semi")


def children_count(parents: DataFrame, symbols: DataFrame, tag: str | None = None) -> DataFrame:
    """sym_id, n_children, 0 where there are none.  Children are counted before the join."""
    kids = symbols.where(F.col("sym_tag") == tag) if tag else symbols
    counts = kids.groupBy(F.col("parent_id").alias("sym_id")).agg(F.count("*").alias("n"))
    return parents.select("sym_id").join(counts, "sym_id", "left").select("sym_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_children"))


def base_classes(classes: DataFrame, symbols: DataFrame, override_access: int = 0) -> DataFrame:
    """sym_id, bases: ' : access name, access name' of the classes that have bases."""
    kids = children_of(classes, symbols, "BaseClass")
    each = F.concat(X.or_empty(F.concat(X.access_name(F.col("access"), override_access), F.lit(" "))), X.or_empty(F.col("name")))
    rows = kids.select("parent_id", F.struct("ordinal", "sym_id", each.alias("text")).alias("b")).groupBy("parent_id").agg(F.array_sort(F.collect_list("b")).alias("b"))
    return rows.select(F.col("parent_id").alias("sym_id"), F.concat(X.token("inheritance"), F.array_join(F.col("b.text"), ", ")).alias("bases"))


def descendants(symbols: DataFrame, roots: DataFrame, tag: str | None = None, most: int = 64, block: int = 4) -> DataFrame:
    """root_id, sym_id, depth, path: each root (depth 0) and everything below it.

    path holds the ordinals and ids on the way, so ordering by it is depth-first
    order.  Levels are joined `block` at a time and cut, so plans stay short; there is
    no limit on rows.  Below `most` levels a cycle is assumed and reported.
    """
    kids = (symbols.where(F.col("sym_tag") == tag) if tag else symbols).select(F.col("sym_id").alias("_id"), F.col("parent_id").alias("_parent"), F.coalesce("ordinal", F.lit(0).cast("bigint")).alias("_ordinal"))
    now = roots.select(F.col("sym_id").alias("root_id"), "sym_id", F.lit(0).alias("depth"), F.array().cast("array<bigint>").alias("path"))
    out = None
    for level in range(0, most, block):
        levels = [now]
        for _ in range(block):
            last = levels[-1]
            levels.append(last.join(kids, F.col("sym_id") == F.col("_parent")).select("root_id", F.col("_id").alias("sym_id"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("_ordinal", "_id")).alias("path")))
        part = levels[0] if level == 0 else None
        for x in levels[1:]:
            part = x if part is None else part.unionByName(x)
        part = cut(part)
        out = part if out is None else out.unionByName(part)
        now = part.where(F.col("depth") == level + block)
        if not now.take(1):
            return out
    raise ValueError(f"symbols are nested more than {most} levels deep: is there a cycle?")
