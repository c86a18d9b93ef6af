"""Output settings: options of one run, and the table they are kept in."""

from __future__ import annotations

import os
import struct
import zlib
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .schema import SETTINGS


class EngineError(Exception):
    """What the command line prints as an error; exit code 1."""


@dataclass(frozen=True)
class Options:
    """The settings and their defaults.  enum_inheritance and show_access are kept, and have no effect."""

    size_info: bool = True
    offset_info: bool = True
    brace_on_new_line: bool = True
    enum_inheritance: bool = True
    case_sensitive: bool = False
    show_access: bool = True
    non_scoped: bool = True
    enum_hex: bool = False
    type_source: bool = True
    info_comment: bool = True
    tabulation: bool = True
    base_access: int = 0


# The stored name of each option.
NAMES = {
    "size_info": "GlobalSettings::s_isSizeInfo", "offset_info": "GlobalSettings::s_isOffsetInfo", "brace_on_new_line": "GlobalSettings::s_isCurlyBracketTransfer",
    "enum_inheritance": "GlobalSettings::s_isEnumInheritence", "case_sensitive": "GlobalSettings::s_isCaseSensitiveSearch", "show_access": "GlobalSettings::s_isShowAccess",
    "non_scoped": "GlobalSettings::s_isNonScoped", "enum_hex": "GlobalSettings::s_isEnumHex", "type_source": "GlobalSettings::s_typeSource",
    "info_comment": "GlobalSettings::s_infoComment", "tabulation": "GlobalSettings::s_isTabulation", "base_access": "GlobalSettings::s_baseAccessType",
}
# Type numbers, bytes of a value, and the layout of a settings file.
TYPES = {"Int8": (0, 1), "UInt8": (1, 1), "Bool": (2, 1), "Int16": (3, 2), "UInt16": (4, 2), "Float": (5, 4), "Int32": (6, 4), "UInt32": (7, 4)}
FILE_BYTES, HEADER_BYTES, ENTRY_BYTES, MAGIC = 4096, 8, 12, 0x44706462
CAPACITY = (FILE_BYTES - HEADER_BYTES) // ENTRY_BYTES


def type_size(type_id: str) -> int:
    return TYPES[type_id][1]


def entry_size(type_id: str) -> int:
    """A value is stored after a type number and a hash, and all is rounded up to four bytes."""
    return 8 + -(-type_size(type_id) // 4) * 4


def name_hash(name: str) -> int:
    return zlib.crc32(name.encode())


def registry() -> dict[str, tuple[str, int]]:
    """Stored name: (type, default)."""
    return {NAMES[f.name]: ("Bool" if isinstance(f.default, bool) else "UInt32", int(f.default)) for f in fields(Options)}


def defaults(spark: SparkSession, known: dict[str, tuple[str, int]] | None = None) -> DataFrame:
    rows = [(name, name_hash(name), kind, value) for name, (kind, value) in (known or registry()).items()]
    return spark.createDataFrame(rows, SETTINGS)


def get(stored: DataFrame, known: DataFrame) -> DataFrame:
    """Every known setting, with its stored value where there is one, by type and hash."""
    have = stored.select("type_id", "hash", F.col("value").alias("_value"))
    return known.join(F.broadcast(have), ["type_id", "hash"], "left").select("name", "hash", "type_id", F.coalesce("_value", "value").alias("value"))


def upsert(stored: DataFrame, new: DataFrame) -> DataFrame:
    """stored with the entries of new written over or appended."""
    n = new.select("type_id", "hash", F.col("name").alias("_name"), F.col("value").alias("_value"))
    return stored.join(n, ["type_id", "hash"], "full").select(F.coalesce("_name", "name").alias("name"), "hash", "type_id", F.coalesce("_value", "value").alias("value"))


def append(stored: DataFrame, new: DataFrame) -> DataFrame:
    """stored and new; more entries than a settings file holds are an error."""
    out = stored.unionByName(new)
    if out.limit(CAPACITY + 1).count() > CAPACITY:
        raise EngineError("settings are full")
    return out


def count(stored: DataFrame) -> DataFrame:
    return stored.agg(F.count("*").alias("n_entries"))


def as_value(kind: str, text: str | int) -> int:
    """A number, from the digits a text begins with, as the setting's type holds it."""
    if isinstance(text, str):
        import re

        m = re.match(r"\s*([+-]?\d+)", text)
        text = int(m[1]) if m else 0
    return int(bool(text)) if kind == "Bool" else int(text) & 0xFFFFFFFF


def set_value(stored: DataFrame, name: str, value: str | int | None, known: dict[str, tuple[str, int]] | None = None) -> DataFrame:
    """stored with one setting changed; the first known setting with this name's hash is meant."""
    if value is None:
        raise EngineError(f"setting {name} needs a value")
    found = next(((n, kind) for n, (kind, _) in (known or registry()).items() if name_hash(n) == name_hash(name)), None)
    if not found:
        raise EngineError(f"no setting is named {name}")
    return upsert(stored, stored.sparkSession.createDataFrame([(found[0], name_hash(found[0]), found[1], as_value(found[1], value))], SETTINGS))


def options(stored: DataFrame) -> Options:
    """The twelve settings as options; a bounded read."""
    back = {v: k for k, v in NAMES.items()}
    values = {back[r["name"]]: r["value"] for r in get(stored, defaults(stored.sparkSession)).collect()}
    base = Options()
    return replace(base, **{k: bool(v) if isinstance(getattr(base, k), bool) else v for k, v in values.items()})


def listing(stored: DataFrame) -> DataFrame:
    """line_no, text of every setting."""
    numbers = F.create_map(*[F.lit(x) for name, (n, _) in TYPES.items() for x in (name, n)])
    order = F.create_map(*[F.lit(x) for i, name in enumerate(registry()) for x in (name, i)])
    line = F.format_string("    %-45s (value: %d, type: 0x%X)", F.col("name"), F.col("value"), numbers[F.col("type_id")])
    return get(stored, defaults(stored.sparkSession)).select(order[F.col("name")].cast("bigint").alias("line_no"), line.alias("text"))


def hashes(names: DataFrame, column: str = "name") -> DataFrame:
    return names.select(column, X.crc32(F.col(column)).alias("hash"))


# The settings file.


def header_is_valid(data: bytes) -> bool:
    return len(data) == FILE_BYTES and struct.unpack_from("<I", data)[0] == MAGIC


def encode_file(rows: list[tuple[int, str, int]]) -> bytes:
    """(hash, type, value) entries as the bytes of a settings file."""
    if len(rows) > CAPACITY:
        raise EngineError("settings are full")
    out = struct.pack("<II", MAGIC, len(rows)) + b"".join(struct.pack("<III", TYPES[kind][0], h, value & 0xFFFFFFFF) for h, kind, value in rows)
    return out.ljust(FILE_BYTES, b"\0")


def decode_file(data: bytes) -> list[tuple[int, str, int]]:
    if not header_is_valid(data):
        raise EngineError("not a settings file")
    names = {n: kind for kind, (n, _) in TYPES.items()}
    n = min(struct.unpack_from("<I", data, 4)[0], CAPACITY)
    if unknown := {t for t, _, _ in struct.iter_unpack("<III", data[HEADER_BYTES : HEADER_BYTES + n * ENTRY_BYTES])} - names.keys():
        raise EngineError(f"a setting has the unknown type {min(unknown)}")
    return [(h, names[t], value) for t, h, value in struct.iter_unpack("<III", data[HEADER_BYTES : HEADER_BYTES + n * ENTRY_BYTES])]


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a settings file; the name is null where no known setting has the hash."""
    found = spark.read.format("binaryFile").load(path).select("content").take(1)  # of a fixed size
    if not found:
        raise EngineError(f"{path} does not exist")
    names = {name_hash(n): n for n in registry()}
    return spark.createDataFrame([(names.get(h), h, kind, value) for h, kind, value in decode_file(bytes(found[0][0]))], SETTINGS)


def write_file(stored: DataFrame, path: str) -> None:
    """Writes the entries as a settings file, by hash; more than it holds are an error."""
    rows = stored.orderBy("hash", "type_id").select("hash", "type_id", "value").limit(CAPACITY + 1).collect()
    spark, jpath = stored.sparkSession, stored.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    out = jpath.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(jpath, True)
    try:
        out.write(bytearray(encode_file([tuple(r) for r in rows])))
    finally:
        out.close()


def default_path() -> str:
    """Documents folder of the user, or the current one where there is none."""
    home = os.path.expanduser("~/Documents")
    return os.path.join(home if os.path.isdir(home) else os.getcwd(), "symlattice", "settings")


def load(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The settings table; the defaults where nothing is stored yet."""
    path = path or default_path()
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(hadoop):
        old = path.rstrip("/") + ".old"  # where a crash came between the two renames of save()
        return spark.read.schema(SETTINGS).parquet(old) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(old)) else defaults(spark)
    return spark.read.schema(SETTINGS).parquet(path)


def save(stored: DataFrame, path: str | None = None) -> None:
    """Writes beside the old table, then takes its place: stored may itself be read from path.  The old table goes last, so a crash loses nothing."""
    path, spark = path or default_path(), stored.sparkSession
    new = path.rstrip("/") + ".new"
    stored.coalesce(1).write.mode("overwrite").parquet(new)
    fs, at = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), spark._jvm.org.apache.hadoop.fs.Path
    old = at(path.rstrip("/") + ".old")
    fs.delete(old, True)
    if fs.exists(at(path)):
        fs.rename(at(path), old)
    fs.rename(at(new), at(path))
    fs.delete(old, True)
