"""The engine's operators as queries over the catalog made from the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import settings as S
from .functions import text as X
from .operators import lookup, navigate, predicates
from .plans.stages import shared_folder
from .plans import compilands, members, render, types
from .schema import GLOBAL, SETTINGS, SYMBOLS, conform
from .settings import Options
from .sources.catalog import ENUM, FUNCTION_TYPE, NATION, PART, REGION, Catalog, adapt, load, save, validate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
PLAIN = Options()


_made: dict[tuple[str, str], str] = {}


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The catalog of these tables, written once a session to the shared folder and read from there."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _made:
        path = f"{shared_folder(spark)}/catalog-{uuid.uuid4().hex}"
        save(adapt(spark, sf_dir), path)
        _made[key] = path
    return load(spark, _made[key])


def query(f: Callable[[Catalog], DataFrame]) -> Callable:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(catalog(spark, sf_dir))

    QUERIES[f.__name__] = run
    return f


def _tag(c: Catalog, tag: str) -> DataFrame:
    return c.symbols.where(F.col("sym_tag") == tag)


@query
def symbols_catalog(c: Catalog) -> DataFrame:
    return c.symbols.select("sym_id", "sym_tag", "name", "parent_id", "ordinal", "type_id")


@query
def catalog_problems(c: Catalog) -> DataFrame:
    return validate(c)


@query
def find_exact_ci(c: Catalog) -> DataFrame:
    return predicates.find_exact(c.symbols, "aSiA").select("sym_id", "name")


@query
def find_exact_cs(c: Catalog) -> DataFrame:
    return predicates.find_exact(c.symbols, "ASIA", case_sensitive=True).select("sym_id", "name")


@query
def find_namespace_children(c: Catalog) -> DataFrame:
    """The nations of a region, were they top-level symbols."""
    return predicates.find_namespace(_tag(c, "UDT").withColumn("parent_id", F.lit(0)), "EUROPE").select("sym_id", "name")


@query
def find_with_fallback(c: Catalog) -> DataFrame:
    flat = _tag(c, "UDT").where("name <> 'AFRICA'").withColumn("parent_id", F.lit(0))
    return predicates.find_type(flat, "AFRICA").select("sym_id", "name").unionByName(predicates.find_type(flat, "asia").select("sym_id", "name"))


@query
def any_match(c: Catalog) -> DataFrame:
    return predicates.any_found(predicates.find_exact(c.symbols, "ASIA")).unionByName(predicates.any_found(predicates.find_exact(c.symbols, "nowhere")))


@query
def first_class_by_name(c: Catalog) -> DataFrame:
    return predicates.first_by_name(c.symbols, "UDT", "europe").select("sym_id", "name")


@query
def dispatch_by_tag(c: Catalog) -> DataFrame:
    return predicates.dispatch(c.symbols).groupBy("renderer").agg(F.count("*").alias("n"))


@query
def children_count(c: Catalog) -> DataFrame:
    return navigate.children_count(_tag(c, "FunctionType"), c.symbols, "FunctionArgType")


@query
def class_members_sections(c: Catalog) -> DataFrame:
    rows = members.numbered(members.members(_tag(c, "UDT").select("sym_id"), c.symbols))
    heads = members.sections(rows)
    return rows.join(heads, ["parent_id", "section"]).select("parent_id", "section", "position", "sym_id", "is_first", "header", "blank_before")


@query
def fields_by_offset(c: Catalog) -> DataFrame:
    rows = members.numbered(members.members(_tag(c, "UDT").select("sym_id"), predicates.fields(c.symbols)))
    line = members.field_line(X.last_part(F.col("name"), F.lit("::")), F.lit(1), F.col("offset"))
    return rows.select("parent_id", "sym_id", "position", line.alias("text"))


@query
def virtuals_by_slot(c: Catalog) -> DataFrame:
    rows = members.numbered(members.members(_tag(c, "UDT").select("sym_id"), predicates.virtuals(c.symbols)))
    return rows.select("parent_id", "sym_id", "position", members.virtual_suffix(F.col("virtual_base_offset")).alias("suffix"))


@query
def function_args(c: Catalog) -> DataFrame:
    rows = _tag(c, "Function").withColumn("enclosing", F.lit(None).cast("string"))
    return render.function_text(rows, c.symbols).select("sym_id", F.col("function_text").alias("text"))


@query
def argument_lists(c: Catalog) -> DataFrame:
    got = types.argument_lists(c.symbols, _tag(c, "FunctionType"))
    return got.select("sym_id", types.unmarked(F.col("args"), F.lit(None).cast("string")).alias("args"), "n_args")


@query
def base_class_list(c: Catalog) -> DataFrame:
    return navigate.base_classes(_tag(c, "UDT"), c.symbols)


@query
def type_chain_text(c: Catalog) -> DataFrame:
    graph = c.symbols.where(F.col("sym_id").between(PART, FUNCTION_TYPE - 1))
    return types.type_text(graph, graph)


@query
def base_type_names(c: Catalog) -> DataFrame:
    s = c.symbols.where(F.col("sym_tag").isin("BaseType", "UDT", "Enum", "Typedef", "Friend", "Function"))
    return s.select("sym_id", X.base_type_name(F.col("base_type"), F.col("length")).alias("base"), X.udt_keyword(F.col("udt_kind")).alias("udt"), X.tag_keyword(F.col("sym_tag"), F.col("base_type"), F.col("length"), F.col("udt_kind")).alias("keyword"))


@query
def qualifier_text(c: Catalog) -> DataFrame:
    return c.symbols.where(F.col("sym_id").between(REGION, FUNCTION_TYPE - 1)).select(
        "sym_id", X.const_name(F.col("const_type")).alias("c"), X.volatile_name(F.col("volatile_type")).alias("v"), X.virtual_name(F.col("is_virtual")).alias("virt"),
        X.reference_name(F.col("is_reference")).alias("ref"), X.static_name(F.col("is_static")).alias("stat"), X.modifiers(F.col("const_type"), F.col("volatile_type")).alias("mods"),
    )


@query
def scope_strip(c: Catalog) -> DataFrame:
    rows = navigate.with_class_parent(c.symbols.withColumn("class_parent_id", F.col("parent_id")).where("name is not null"), c.symbols)
    return rows.select("sym_id", X.last_part(F.col("name"), F.lit("::")).alias("last"), X.scoped_name(F.col("name"), F.col("class_name")).alias("scoped"))


def _values(c: Catalog, as_hex: bool) -> DataFrame:
    rows = _tag(c, "Data").where(F.col("parent_id").between(ENUM, ENUM + 999))
    return rows.select("sym_id", X.enum_member(F.col("name"), F.col("value"), as_hex).alias("text"))


@query
def enum_values(c: Catalog) -> DataFrame:
    return _values(c, False)


@query
def enum_values_hex(c: Catalog) -> DataFrame:
    return _values(c, True)


@query
def bit_fields(c: Catalog) -> DataFrame:
    return _tag(c, "Data").select("sym_id", X.bit_field_text(F.col("bit_position"), F.col("length")).alias("text"))


@query
def array_text(c: Catalog) -> DataFrame:
    return c.symbols.where(F.col("sym_tag").isin("Array", "Pointer")).select("sym_id", X.array_text(F.col("array_count")).alias("a"), X.pointer_text(F.col("is_reference")).alias("p"))


@query
def size_text(c: Catalog) -> DataFrame:
    return _tag(c, "UDT").select("sym_id", X.size_text(F.col("length")).alias("text"))


@query
def nested_tree(c: Catalog) -> DataFrame:
    tree = navigate.descendants(c.symbols, c.symbols.where(F.col("sym_id").between(REGION, REGION + 999)))
    return tree.groupBy("root_id", "depth").agg(F.count("*").alias("n"), F.max("sym_id").alias("last"))


@query
def parent_names(c: Catalog) -> DataFrame:
    rows = navigate.with_lexical_parent(_tag(c, "Function").withColumn("lexical_parent_id", F.col("parent_id")), c.symbols)
    return navigate.with_type(rows, c.symbols, ("sym_tag",)).select("sym_id", F.col("lexical_name").alias("parent_name"), F.col("type_sym_tag").alias("type_tag"))


@query
def line_lookup(c: Catalog) -> DataFrame:
    return lookup.first_line(c.symbols, c.lines)


@query
def type_sources(c: Catalog) -> DataFrame:
    return lookup.sources_of(_tag(c, "Function"), c.lines, c.source_files)


@query
def source_files(c: Catalog) -> DataFrame:
    return compilands.source_files(c.source_files)


@query
def compilands_short(c: Catalog) -> DataFrame:
    return compilands.compilands(c.symbols)


@query
def compilands_full(c: Catalog) -> DataFrame:
    return compilands.compilands_full(c.symbols)


@query
def class_lines(c: Catalog) -> DataFrame:
    """Every top-level class in full, with nested classes, types and sources."""
    roots = predicates.dispatch(c.symbols.where("parent_id = 0"))
    return render.numbered(render.type_lines(roots, c.symbols, c.lines, c.source_files, PLAIN))


@query
def enum_lines(c: Catalog) -> DataFrame:
    return render.numbered(render.type_lines(_tag(c, "Enum"), c.symbols, o=PLAIN))


@query
def typedef_lines(c: Catalog) -> DataFrame:
    return render.numbered(render.type_lines(_tag(c, "Typedef"), c.symbols, o=PLAIN))


@query
def type_dump(c: Catalog) -> DataFrame:
    """Everything below the nested classes, in the order of a recursive descent."""
    nations = _tag(c, "UDT").where("parent_id <> 0")
    place = F.row_number().over(Window.partitionBy("root_id").orderBy("path")).cast("bigint")
    return render.dump_tree(c.symbols, nations).select("root_id", place.alias("line_no"), "depth", "sym_tag", "text")


@query
def children_scan(c: Catalog) -> DataFrame:
    """Children of one symbol, in order, by tag and name."""
    own = predicates.children(c.symbols, REGION, "UDT").unionByName(predicates.children(c.symbols, GLOBAL, "UDT", "aSiA")).unionByName(predicates.children(c.symbols, NATION))
    return own.select("sym_id", "parent_id", "ordinal")


@query
def first_enum_by_name(c: Catalog) -> DataFrame:
    return predicates.first_by_name(c.symbols.withColumn("parent_id", F.lit(GLOBAL)), "Enum", "asia::china::kind").select("sym_id", "name")


@query
def first_typedef_by_name(c: Catalog) -> DataFrame:
    return predicates.first_by_name(c.symbols.withColumn("parent_id", F.lit(GLOBAL)), "Typedef", "ASIA::INDIA::Alias", case_sensitive=True).select("sym_id", "name")


@query
def scoped_symbols(c: Catalog) -> DataFrame:
    return c.symbols.groupBy(predicates.is_scoped(F.col("sym_tag")).alias("scoped")).agg(F.count("*").alias("n"))


@query
def function_flags(c: Catalog) -> DataFrame:
    flags = {"inl_spec": X.inline_name, "is_naked": X.naked_name, "no_return": X.noreturn_name, "no_inline": X.noinline_name, "is_pure": X.pure_name}
    return _tag(c, "Function").select("sym_id", *[f(F.col(k)).alias(f"{k}_text") for k, f in flags.items()])


@query
def address_texts(c: Catalog) -> DataFrame:
    return _tag(c, "Function").select("sym_id", X.rva_text(F.col("rva")).alias("rva_text"), X.va_text(F.col("va")).alias("va_text"), X.vtable_offset_text(F.col("virtual_base_offset")).alias("slot_text"), X.location_text(F.col("location_type")).alias("location"))


@query
def bit_field_pairs(c: Catalog) -> DataFrame:
    pair = X.bit_field(F.col("bit_position"), F.col("length").cast("bigint"))
    return _tag(c, "Data").where("bit_position is not null").select("sym_id", pair["bit_position"].alias("bit_position"), pair["length"].alias("bit_length"))


@query
def utf16_names(c: Catalog) -> DataFrame:
    """Names to UTF-16 and back."""
    wide = X.utf8_to_utf16(F.col("name"))
    return c.symbols.where("name is not null").select("sym_id", F.octet_length(wide).alias("n_bytes"), X.utf16_to_utf8(wide).alias("back"))


@query
def enum_lines_terse(c: Catalog) -> DataFrame:
    """Enums with the brace on the heading's line, no sizes and hexadecimal values."""
    return render.numbered(render.type_lines(_tag(c, "Enum"), c.symbols, o=Options(brace_on_new_line=False, size_info=False, enum_hex=True)))


@query
def base_class_list_public(c: Catalog) -> DataFrame:
    """Base classes with the access that a setting gives to all."""
    return navigate.base_classes(_tag(c, "UDT"), c.symbols, 3)


@query
def function_pointer_texts(c: Catalog) -> DataFrame:
    """Pointers to all function types: function types inside chains, with their arguments."""
    types_ = _tag(c, "FunctionType").select("sym_id")
    pointers = conform(types_.select((F.col("sym_id") + 100_000_000_000).alias("sym_id"), F.lit("Pointer").alias("sym_tag"), F.col("sym_id").alias("type_id")), SYMBOLS)
    return types.type_text(c.symbols.unionByName(pointers), pointers)


@query
def enum_pointer_texts(c: Catalog) -> DataFrame:
    """Arrays of constant pointers to all enums: a chain ends at an enum, whatever its own type is."""
    kinds = _tag(c, "Enum").select("sym_id")
    pointers = kinds.select((F.col("sym_id") + 100_000_000_000).alias("sym_id"), F.lit("Pointer").alias("sym_tag"), F.col("sym_id").alias("type_id"), F.lit(True).alias("const_type"))
    arrays = kinds.select((F.col("sym_id") + 200_000_000_000).alias("sym_id"), F.lit("Array").alias("sym_tag"), (F.col("sym_id") + 100_000_000_000).alias("type_id"), F.lit(3).alias("array_count"))
    s = c.symbols.withColumn("type_id", F.when(F.col("sym_tag") == "Enum", F.lit(PART + 1)).otherwise(F.col("type_id")))
    return types.type_text(s.unionByName(conform(pointers, SYMBOLS)).unionByName(conform(arrays, SYMBOLS)), arrays)


def _stored(spark: SparkSession) -> DataFrame:
    rows = [(name, S.name_hash(name), kind, 0 if kind == "Bool" else 2) for name, (kind, _) in S.registry().items() if "Is" not in name and "is" not in name.split("_", 1)[1][:2]]
    return spark.createDataFrame(rows, SETTINGS)


def settings_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.get(_stored(spark), S.defaults(spark))


def settings_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.set_value(_stored(spark), S.NAMES["enum_hex"], "5")


def settings_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.hashes(S.defaults(spark).select("name"))


def settings_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.listing(_stored(spark))


def settings_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many entries there are after one more, and the bytes that the entries of each type take."""
    more = S.append(_stored(spark), S.set_value(_stored(spark).limit(0), S.NAMES["enum_hex"], "5"))
    sizes = F.create_map(*[F.lit(x) for kind in S.TYPES for x in (kind, S.entry_size(kind))])
    return S.count(more).join(more.groupBy("type_id").agg(F.sum(sizes[F.col("type_id")]).alias("n_bytes")))


def settings_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The settings written to a file of the original's layout and read back."""
    path = f"{shared_folder(spark)}/settings-{uuid.uuid4().hex}"
    S.write_file(_stored(spark), path)
    return S.read_file(spark, path)


def int_prefix_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    made = F.concat(F.when(F.col("p_partkey") % 3 == 0, F.lit("")).when(F.col("p_partkey") % 3 == 1, F.lit(" -")).otherwise(F.lit("x")), F.col("p_partkey"), F.col("p_name"))
    return p.select("p_partkey", X.int_prefix(made).alias("value"))


QUERIES |= {f.__name__: f for f in (settings_get, settings_upsert, settings_hash, settings_listing, settings_append, settings_file, int_prefix_parse)}
