"""Object files, their details and environments, and source files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def compilands(symbols: DataFrame) -> DataFrame:
    """sym_id, ordinal, text: name of each object file that has one."""
    return symbols.where("sym_tag = 'Compiland' and name is not null").select("sym_id", "ordinal", F.col("name").alias("text"))


def compilands_full(symbols: DataFrame) -> DataFrame:
    """compiland_id, ordinal, section, position, text: [OBJ], then [ABOUT] lines, then [ENV] lines of each object file."""
    files = symbols.where("sym_tag = 'Compiland'").select(F.col("sym_id").alias("compiland_id"), F.col("ordinal"), "name")
    kids = symbols.where(F.col("sym_tag").isin("CompilandDetails", "CompilandEnv")).select(
        F.col("parent_id").alias("_parent"), F.col("ordinal").alias("_at"), F.col("sym_tag").alias("_tag"), F.col("name").alias("_name"), "value", "platform", "language", "compiler_name", "has_debug_info"
    )
    flag = F.when(F.coalesce("has_debug_info", F.lit(False)), "true").otherwise("false")
    number = lambda c: X.or_empty(F.col(c).cast("string"))
    about = F.concat(F.lit("[ABOUT] Compiler: "), X.or_empty(F.col("compiler_name")), F.lit("; Language: "), number("language"), F.lit("; Platform: "), number("platform"), F.lit("; Debug: "), flag)
    value = F.when((F.col("value.vt") == "BSTR") & F.col("value.str").isNotNull(), F.concat(F.lit(" = "), F.col("value.str"))).otherwise("")
    env = F.concat(F.lit("[ENV] "), X.or_empty(F.col("_name")), value)
    is_env = F.col("_tag") == "CompilandEnv"
    heads = files.select("compiland_id", "ordinal", F.lit(0).alias("section"), F.lit(0).cast("bigint").alias("position"), F.concat(F.lit("[OBJ] "), X.or_empty(F.col("name"))).alias("text"))
    rest = files.join(kids, F.col("compiland_id") == F.col("_parent")).select("compiland_id", "ordinal", F.when(is_env, 2).otherwise(1).alias("section"), F.col("_at").alias("position"), F.when(is_env, env).otherwise(about).alias("text"))
    return heads.unionByName(rest)


def source_files(files: DataFrame) -> DataFrame:
    """file_id, ordinal, text of the source files that have a name."""
    return files.where("file_name is not null").select("file_id", "ordinal", F.col("file_name").alias("text"))
