"""Schemas of a symbol catalog.  An absent attribute is NULL; there are no sentinel values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T



def _schema(text: str) -> T.StructType:
    """A schema from 'name type, ...'; unlike fromDDL it needs no session."""
    out = T.StructType()
    for part in text.split(","):
        name, kind = part.split()
        out.add(name, kind.replace("20.0", "20,0"))
    return out


SYMBOLS = _schema("""
    sym_id long, sym_tag string, name string, name_lower string, parent_id long, ordinal long,
    lexical_parent_id long, class_parent_id long, type_id long,
    base_type string, udt_kind string, data_kind string, access string, length decimal(20.0),
    const_type boolean, volatile_type boolean, is_virtual boolean, is_reference boolean, is_static boolean,
    inl_spec boolean, is_naked boolean, no_return boolean, no_inline boolean, is_pure boolean,
    array_count long, bit_position long, offset integer, virtual_base_offset long""")
SYMBOLS.add("value", _schema("vt string, i64 long, str string"))
for _field in _schema("addr_section long, addr_offset long, rva long, va decimal(20.0), location_type string, platform long, language long, compiler_name string, has_debug_info boolean"):
    SYMBOLS.add(_field)
LINES = _schema("section long, offset long, length long, file_id long, line long, ordinal long")
SOURCE_FILES = _schema("file_id long, file_name string, ordinal long")
SETTINGS = _schema("name string, hash long, type_id string, value long")

#: The parent of top-level symbols.
GLOBAL = 0


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with exactly the columns of schema: missing ones NULL, others cast; name_lower is derived where it is absent."""
    have = set(df.columns)
    out = [(F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema]
    df = df.select(*out)
    if "name_lower" in schema.names and "name_lower" not in have:
        df = df.withColumn("name_lower", F.lower("name"))
    return df
