"""Members of classes: buckets, sections and their order, for many classes at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

# The sections of a class, in order.
SECTIONS = ("FRIENDS", "ENUMS", "TYPEDEFS", "CLASSES", "VIRTUALS", "FIELDS", "FUNCS", "OTHER MEMBERS")
FRIENDS, ENUMS, TYPEDEFS, CLASSES, VIRTUALS, FIELDS, FUNCS, OTHERS = range(1, 9)


def section() -> Column:
    """Section number of a member; NULL for what no section shows.  No shuffle."""
    tag = F.col("sym_tag")
    out = F.lit(None).cast("int")
    for k, name in ((FRIENDS, "Friend"), (ENUMS, "Enum"), (TYPEDEFS, "Typedef"), (CLASSES, "UDT")):
        out = F.when(tag == name, k).otherwise(out)
    function = F.when(F.col("is_virtual"), VIRTUALS).when(~F.col("is_virtual"), FUNCS)
    data = F.when(F.col("data_kind") == "Member", FIELDS).when(F.col("data_kind") != "Member", OTHERS)
    return F.when(tag == "Function", function).when(tag == "Data", data).otherwise(out)


def section_key() -> Column:
    """What a section is sorted by before the ordinal: the slot of virtuals and the offset of fields, nothing else."""
    s = F.col("section")
    return F.when(s == VIRTUALS, F.col("virtual_base_offset")).when(s == FIELDS, F.col("offset").cast("bigint"))


def members(classes: DataFrame, symbols: DataFrame) -> DataFrame:
    """Rows of symbols that classes show, with section, section_key; ties go by ordinal."""
    kids = symbols.withColumn("section", section()).where("section is not null")
    kids = kids.join(classes.select(F.col("sym_id").alias("parent_id")).distinct(), "parent_id", "left_semi")
    return kids.withColumn("section_key", section_key())


def sections(rows: DataFrame, keys: tuple[str, ...] = ("parent_id",)) -> DataFrame:
    """keys, section, header, blank_before: the sections that have members; the first shown has no blank line before it."""
    some = rows.select(*keys, "section").distinct()
    first = F.min("section").over(Window.partitionBy(*keys))
    names = F.array(*map(F.lit, SECTIONS))
    return some.select(*keys, "section", F.element_at(names, F.col("section")).alias("header"), (F.col("section") > first).alias("blank_before"))


def numbered(rows: DataFrame) -> DataFrame:
    """rows with position in the section, and whether it is the first there."""
    w = Window.partitionBy("parent_id", "section").orderBy(F.col("section_key").asc_nulls_first(), "ordinal", "sym_id")
    return rows.withColumn("position", F.row_number().over(w).cast("bigint")).withColumn("is_first", F.col("position") == 1)


def field_line(text: Column, level: Column, offset: Column, offsets: bool = True, tabulate: bool = True) -> Column:
    line = F.concat(X.indent(level), text, F.lit("; "))
    if not offsets:
        return line
    return F.when(offset.isNotNull(), X.pad_comment(line, F.concat(F.lit("// "), X.hex_text(offset)), tabulate)).otherwise(line)


def virtual_suffix(offset: Column, offsets: bool = True) -> Column:
    return X.or_empty(F.concat(F.lit(" // "), X.hex_text(offset))) if offsets else F.lit("")


def other_line(text: Column, level: Column, kind: Column) -> Column:
    word = F.when(kind == "StaticMember", "static ").when(kind == "Constant", "constexpr ").otherwise("")
    return F.concat(X.indent(level), word, text, F.lit(";"))
