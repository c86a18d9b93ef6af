"""Reading and writing catalogs, and a catalog made from the driver's tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import GLOBAL, LINES, SOURCE_FILES, SYMBOLS, conform
from ..settings import EngineError


@dataclass(frozen=True)
class Catalog:
    symbols: DataFrame
    lines: DataFrame
    source_files: DataFrame


def load(spark: SparkSession, path: str) -> Catalog:
    """A catalog written by save(): a folder with three Parquet tables.  Missing tables are empty; without symbols it is no catalog."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def read(name: str, schema):
        at = f"{path.rstrip('/')}/{name}"
        if not fs.exists(hadoop(at)):
            return spark.createDataFrame([], schema)
        return conform(spark.read.parquet(at), schema)

    if not fs.exists(hadoop(f"{path.rstrip('/')}/symbols")):
        raise EngineError(f"{path} holds no symbols")
    return Catalog(read("symbols", SYMBOLS), read("lines", LINES), read("source_files", SOURCE_FILES))


def save(catalog: Catalog, path: str, partitions: int | None = None) -> None:
    """Writes a catalog.  Symbols are partitioned by tag, so tag filters prune folders, and sorted by name within files."""
    symbols = conform(catalog.symbols, SYMBOLS)
    # Children lie together; types, which have no parent, spread by their own ids.
    keys = ("sym_tag", F.coalesce("parent_id", "sym_id"))
    dealt = symbols.repartition(partitions, *keys) if partitions else symbols.repartition(*keys)
    dealt.sortWithinPartitions("sym_tag", "name_lower").write.mode("overwrite").partitionBy("sym_tag").parquet(f"{path}/symbols")
    conform(catalog.lines, LINES).write.mode("overwrite").parquet(f"{path}/lines")
    conform(catalog.source_files, SOURCE_FILES).write.mode("overwrite").parquet(f"{path}/source_files")


def validate(catalog: Catalog) -> DataFrame:
    """problem, n of what is wrong: repeated ids, references to no symbol, symbols that are their own parent or type."""
    s = catalog.symbols
    ids = s.select(F.col("sym_id").alias("_id"))
    missing = lambda c: s.where(F.col(c).isNotNull() & (F.col(c) != GLOBAL)).join(ids, F.col(c) == F.col("_id"), "left_anti").agg(F.lit(f"{c} refers to no symbol").alias("problem"), F.count("*").alias("n"))
    twice = s.groupBy("sym_id").count().where("count > 1").agg(F.lit("sym_id is not unique").alias("problem"), F.count("*").alias("n"))
    own = s.where("sym_id = parent_id or sym_id = type_id").agg(F.lit("symbol refers to itself").alias("problem"), F.count("*").alias("n"))
    return twice.unionByName(missing("parent_id")).unionByName(missing("type_id")).unionByName(own).where("n > 0")


# A catalog from the driver's tables.  Ids are offset by kind.
REGION, NATION, SUPPLIER, CUSTOMER, PART, FUNCTION_TYPE, ARGUMENT, PARAMETER = (k * 1_000_000_000 for k in range(1, 9))
ENUM, VALUE, TYPEDEF, FRIEND, BASE, COMPILAND, DETAILS, ENVIRONMENT = (k * 1_000_000_000 for k in range(9, 17))
BASES = ("Int", "UInt", "Char", "Bool", "Float", "Void", "WChar", "BCD")
SIZES = (1, 2, 4, 8, 16)


def _pick(values: tuple, index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def adapt(spark: SparkSession, sf_dir: str) -> Catalog:
    """Regions and nations become nested classes, suppliers their functions, customers their data, parts the type graph."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    c, lit = F.col, F.lit
    region, nation, supplier, customer, part = map(t, ("region", "nation", "supplier", "customer", "part"))
    long = lambda x: x.cast("bigint")
    # Classes: 25 nations at most, so their names go to each member by broadcast.
    r = region.select(long(c("r_regionkey")).alias("r"), "r_name")
    n = nation.select(long(c("n_nationkey")).alias("n"), "n_name", long(c("n_regionkey")).alias("r")).join(F.broadcast(r), "r").withColumn("scope", F.concat_ws("::", "r_name", "n_name"))
    scopes = F.broadcast(n.select("n", "scope"))
    kinds = ("Class", "Struct", "Union")
    parts: list[DataFrame] = [
        r.select((REGION + c("r")).alias("sym_id"), lit("UDT").alias("sym_tag"), c("r_name").alias("name"), lit(GLOBAL).alias("parent_id"), c("r").alias("ordinal"), _pick(kinds, c("r") % 3).alias("udt_kind"), (8 * (c("r") + 1)).alias("length"), (c("r") == 4).alias("const_type")),
        n.select((NATION + c("n")).alias("sym_id"), lit("UDT").alias("sym_tag"), c("scope").alias("name"), (REGION + c("r")).alias("parent_id"), c("n").alias("ordinal"), _pick(kinds, c("n") % 3).alias("udt_kind"), F.when(c("n") % 4 != 0, 16 * c("n")).alias("length")),
        n.select((BASE + c("n")).alias("sym_id"), lit("BaseClass").alias("sym_tag"), c("r_name").alias("name"), (NATION + c("n")).alias("parent_id"), lit(0).alias("ordinal"), _pick(("private", "protected", "public"), c("n") % 3).alias("access")).where(c("ordinal") == 0),
        n.where("n % 2 = 0").select((BASE + 100 + c("n")).alias("sym_id"), lit("BaseClass").alias("sym_tag"), c("scope").alias("name"), (NATION + c("n")).alias("parent_id"), lit(1).alias("ordinal"), lit(None).cast("string").alias("access")),
        n.select((ENUM + c("n")).alias("sym_id"), lit("Enum").alias("sym_tag"), F.concat("scope", lit("::Kind")).alias("name"), (NATION + c("n")).alias("parent_id"), (1000 + c("n")).alias("ordinal"), lit("Int").alias("base_type"), lit(4).alias("length")),
        n.select("n", F.explode(F.sequence(lit(0), lit(5))).alias("k")).select((VALUE + c("n") * 10 + c("k")).alias("sym_id"), lit("Data").alias("sym_tag"), F.concat(lit("v"), c("k")).alias("name"), (ENUM + c("n")).alias("parent_id"), c("k").alias("ordinal"), lit("Constant").alias("data_kind"), F.struct(_pick(("I4", "I2", "I1", "UI4", "UI1", "I8"), c("k")).alias("vt"), (c("n") - 12 + c("k")).alias("i64"), lit(None).cast("string").alias("str")).alias("value")),
        n.select((TYPEDEF + c("n")).alias("sym_id"), lit("Typedef").alias("sym_tag"), F.concat("scope", lit("::Alias")).alias("name"), (NATION + c("n")).alias("parent_id"), (2000 + c("n")).alias("ordinal"), (PART + c("n") + 1).alias("type_id")),
        n.select((FRIEND + c("n")).alias("sym_id"), lit("Friend").alias("sym_tag"), lit(None).cast("string").alias("name"), (NATION + c("n")).alias("parent_id"), (3000 + c("n")).alias("ordinal"), (NATION + (c("n") + 1) % 25).alias("type_id")),
    ]
    s = supplier.select(long(c("s_suppkey")).alias("s"), "s_name", long(c("s_nationkey")).alias("n")).join(scopes, "n")
    parts += [
        s.select((SUPPLIER + c("s")).alias("sym_id"), lit("Function").alias("sym_tag"), F.concat_ws("::", "scope", "s_name").alias("name"), (NATION + c("n")).alias("parent_id"), c("s").alias("ordinal"), (FUNCTION_TYPE + c("s")).alias("type_id"), F.when(c("s") % 10 != 9, c("s") % 2 == 0).alias("is_virtual"), (c("s") % 7 == 0).alias("is_static"), (c("s") % 5 == 0).alias("const_type"), F.when(c("s") % 2 == 0, c("s") % 64 * 4).alias("virtual_base_offset"), (c("s") % 4).alias("addr_section"), (3 * (4 * c("s") + c("s") % 4) + c("s") % 3).alias("addr_offset"), (c("s") % 3 == 0).alias("inl_spec"), (c("s") % 11 == 0).alias("is_naked"), (c("s") % 13 == 0).alias("no_return"), (c("s") % 17 == 0).alias("no_inline"), (c("s") % 19 == 0).alias("is_pure"), (16 * c("s")).alias("rva"), (5_368_709_120 + 16 * c("s")).alias("va"), F.when(c("s") % 10 != 9, _pick(("Null", "Static", "TLS", "RegRel", "ThisRel", "Enregistered", "BitField", "Constant", "77"), c("s") % 9)).alias("location_type")),
        s.select((FUNCTION_TYPE + c("s")).alias("sym_id"), lit("FunctionType").alias("sym_tag"), (PART + c("s") % 200 + 1).alias("type_id")),
        s.select("s", F.explode(F.when(c("s") % 4 > 0, F.sequence(lit(0).cast("bigint"), c("s") % 4 - 1))).alias("k")).select((ARGUMENT + c("s") * 4 + c("k")).alias("sym_id"), lit("FunctionArgType").alias("sym_tag"), (FUNCTION_TYPE + c("s")).alias("parent_id"), c("k").alias("ordinal"), (PART + (c("s") * 7 + c("k") * 13) % 200 + 1).alias("type_id")),
        s.select("s", F.explode(F.when(c("s") % 3 > 0, F.sequence(lit(0).cast("bigint"), c("s") % 3 - 1))).alias("k")).select((PARAMETER + c("s") * 4 + c("k")).alias("sym_id"), lit("Data").alias("sym_tag"), F.concat(lit("a"), c("k")).alias("name"), (SUPPLIER + c("s")).alias("parent_id"), c("k").alias("ordinal"), lit("Param").alias("data_kind"), (PART + (c("s") * 7 + c("k") * 13) % 200 + 1).alias("type_id")),
    ]
    u = customer.select(long(c("c_custkey")).alias("c"), "c_name", long(c("c_nationkey")).alias("n")).join(scopes, "n")
    bits = c("c") % 11 == 0
    parts.append(u.select((CUSTOMER + c("c")).alias("sym_id"), lit("Data").alias("sym_tag"), F.concat_ws("::", "scope", "c_name").alias("name"), (NATION + c("n")).alias("parent_id"), c("c").alias("ordinal"), _pick(("Member", "Member", "Member", "StaticMember", "Constant"), c("c") % 5).alias("data_kind"), (c("c") % 100 * 8).alias("offset"), (PART + c("c") % 200 + 1).alias("type_id"), F.when(bits, c("c") % 32).alias("bit_position"), F.when(bits, c("c") % 7).alias("length")))
    p = part.select(long(c("p_partkey")).alias("p"), "p_brand", long(c("p_size")).alias("z"))
    base = c("z") % 4 == 3
    parts.append(p.select((PART + c("p")).alias("sym_id"), _pick(("Pointer", "Array", "Typedef", "BaseType"), c("z") % 4).alias("sym_tag"), F.when(c("z") % 4 == 2, c("p_brand")).alias("name"), F.when(~base & (c("p") > 1), PART + F.floor(c("p") / 2)).alias("type_id"), F.when(base, _pick(BASES, c("p") % 8)).alias("base_type"), F.when(base, _pick(SIZES, c("p") % 5)).alias("length"), F.when(c("z") % 4 == 1, c("z")).alias("array_count"), (c("z") % 8 == 4).alias("is_reference"), (c("p") % 6 == 0).alias("const_type"), (c("p") % 9 == 0).alias("volatile_type")))
    talk = t("conversations").select(long(c("conv_id")).alias("v"), long(c("turn")).alias("turn"), "role", "text")
    files = talk.select("v").distinct()
    parts += [
        files.select((COMPILAND + c("v")).alias("sym_id"), lit("Compiland").alias("sym_tag"), F.when(c("v") % 10 != 3, F.concat(lit("obj"), c("v"), lit(".obj"))).alias("name"), lit(GLOBAL).alias("parent_id"), c("v").alias("ordinal")),
        files.select((DETAILS + c("v")).alias("sym_id"), lit("CompilandDetails").alias("sym_tag"), (COMPILAND + c("v")).alias("parent_id"), lit(0).alias("ordinal"), (c("v") % 9).alias("platform"), (c("v") % 5).alias("language"), F.concat(lit("cc"), c("v") % 3).alias("compiler_name"), (c("v") % 2 == 0).alias("has_debug_info")),
        talk.select((ENVIRONMENT + c("v") * 1000 + c("turn")).alias("sym_id"), lit("CompilandEnv").alias("sym_tag"), c("role").alias("name"), (COMPILAND + c("v")).alias("parent_id"), c("turn").alias("ordinal"), F.struct(F.when(c("turn") % 3 == 1, "I4").otherwise("BSTR").alias("vt"), lit(None).cast("bigint").alias("i64"), c("text").alias("str")).alias("value")),
    ]
    symbols = None
    for x in parts:
        x = conform(x, SYMBOLS)
        symbols = x if symbols is None else symbols.unionByName(x)
    lines = t("orders").select((long(c("o_orderkey")) % 4).alias("section"), (long(c("o_orderkey")) * 3).alias("offset"), lit(3).alias("length"), (long(c("o_orderkey")) % 211).alias("file_id"), long(c("o_orderkey")).alias("line"), long(c("o_orderkey")).alias("ordinal"))
    names = t("documents").select(long(c("doc_id")).alias("file_id"), F.concat(F.concat_ws("/", "source", "lang", c("doc_id").cast("string")), lit(".cpp")).alias("file_name"), long(c("doc_id")).alias("ordinal"))
    return Catalog(symbols, conform(lines, LINES), conform(names, SOURCE_FILES))
