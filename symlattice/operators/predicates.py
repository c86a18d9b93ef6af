"""Filters over symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import GLOBAL

HANDLED = ("Typedef", "UDT", "Enum", "Data", "Function")


def with_tag(df: DataFrame, tag: str) -> DataFrame:
    return df.where(F.col("sym_tag") == tag)


def children(symbols: DataFrame, parent_id: int = GLOBAL, tag: str | None = None, name: str | None = None, case_sensitive: bool = False) -> DataFrame:
    """Children of one symbol, in order; filters reach the scan."""
    df = symbols.where(F.col("parent_id") == parent_id)
    if tag is not None:
        df = with_tag(df, tag)
    if name is not None:
        df = df.where(name_is(name, case_sensitive))
    return df.orderBy("ordinal")


def name_is(name: str, case_sensitive: bool = False) -> Column:
    """The stored lower-case name lets an insensitive match be pushed down."""
    return F.col("name") == name if case_sensitive else F.col("name_lower") == name.lower()


def find_exact(symbols: DataFrame, name: str, case_sensitive: bool = False) -> DataFrame:
    return symbols.where((F.col("parent_id") == GLOBAL) & name_is(name, case_sensitive))


def find_namespace(symbols: DataFrame, name: str) -> DataFrame:
    """Direct members of a namespace, by their full names; always case-sensitive."""
    prefix = name if name.endswith("::") else name + "::"
    rest = F.substring("name", len(prefix) + 1, 1 << 30)
    return symbols.where((F.col("parent_id") == GLOBAL) & F.col("name").startswith(prefix) & ~F.contains(rest, F.lit("::")))


def find_type(symbols: DataFrame, name: str, case_sensitive: bool = False) -> DataFrame:
    """Exact matches; members of the namespace only where there is no exact match of any tag."""
    exact = find_exact(symbols, name, case_sensitive)
    none = exact.limit(1).agg((F.count("*") == 0).alias("_none")).where("_none")
    return exact.unionByName(find_namespace(symbols, name).join(F.broadcast(none), how="left_semi", on=F.col("_none")))


def dispatch(symbols: DataFrame) -> DataFrame:
    """Symbols that have a rendering, with its name."""
    return symbols.where(F.col("sym_tag").isin(*HANDLED)).withColumn("renderer", F.lower("sym_tag"))


def first_by_name(symbols: DataFrame, tag: str, name: str, case_sensitive: bool = False) -> DataFrame:
    """The first class, enum or typedef of this name."""
    return with_tag(find_exact(symbols, name, case_sensitive), tag).orderBy("ordinal").limit(1)


def parameters(df: DataFrame) -> DataFrame:
    return df.where((F.col("sym_tag") == "Data") & (F.col("data_kind") == "Param"))


def fields(df: DataFrame) -> DataFrame:
    return df.where((F.col("sym_tag") == "Data") & (F.col("data_kind") == "Member"))


def other_members(df: DataFrame) -> DataFrame:
    """Data that is no field; an absent kind is in neither."""
    return df.where((F.col("sym_tag") == "Data") & (F.col("data_kind") != "Member"))


def virtuals(df: DataFrame) -> DataFrame:
    return df.where((F.col("sym_tag") == "Function") & F.col("is_virtual"))


def plain_functions(df: DataFrame) -> DataFrame:
    return df.where((F.col("sym_tag") == "Function") & ~F.col("is_virtual"))


def is_scoped(sym_tag: Column) -> Column:
    return sym_tag == "UDT"


def any_found(df: DataFrame) -> DataFrame:
    """One row: found boolean."""
    return df.limit(1).agg((F.count("*") > 0).alias("found"))
