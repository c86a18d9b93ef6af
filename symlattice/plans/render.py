"""Declarations as ordered lines.

A line is (root_id, path, text): root_id is the symbol that was asked for, and path
an array that orders the lines of a root.  The pieces of a class's path are its
place in its parent, then 0 size, 1 heading, 2 brace, 3 members by section and
position, 4 closing brace, 5 sources.  State that printing would carry along, such
as the enclosing class's name, is a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import lookup, navigate
from ..operators.predicates import HANDLED
from ..settings import Options
from . import members as M
from .stages import cut
from .types import argument_lists, marked, texts, unmarked

LINE = ("root_id", "path", "text")
DEFAULT = Options()
SIZE, HEAD, OPEN, BODY, CLOSE, SOURCES = range(6)


def _path(*parts: Column | int) -> Column:
    return F.concat("path", F.array(*[(F.lit(p) if isinstance(p, int) else p).cast("bigint") for p in parts]))


def _line(rows: DataFrame, path: Column, text: Column) -> DataFrame:
    return rows.select("root_id", path.alias("path"), text.alias("text"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _with_text(rows: DataFrame, symbols: DataFrame, o: Options, key: str = "sym_id", as_: str = "type_text", typedefs: bool = False, known: DataFrame | None = None) -> DataFrame:
    """rows with the marked text of symbol `key`, from known where that is given; each distinct symbol is resolved once."""
    of = known if known is not None else texts(symbols, rows.select(F.col(key).alias("sym_id")).where("sym_id is not null"), o.offset_info, typedefs)
    return rows.join(of.select(F.col("sym_id").alias("_of"), F.col("text").alias(as_)), rows[key] == F.col("_of"), "left").drop("_of")


def opening(level: Column, o: Options) -> tuple[Column, bool]:
    """The opening brace, and whether it has a line of its own."""
    return (F.concat(X.indent(level), F.lit("{")) if o.brace_on_new_line else F.lit(" {")), o.brace_on_new_line


def mentioned(functions: DataFrame, symbols: DataFrame) -> DataFrame:
    """sym_id of all whose type texts these functions print: return types, parameters and declared argument types."""
    of = functions.select(F.col("sym_id").alias("parent_id"), F.col("type_id").alias("_ft"))
    returns = symbols.where("sym_tag = 'FunctionType'").select(F.col("sym_id").alias("_ft"), F.col("type_id").alias("sym_id")).join(of, "_ft", "left_semi").select("sym_id")
    named = symbols.where("sym_tag = 'Data' and data_kind = 'Param'").join(of, "parent_id", "left_semi").select("sym_id")
    declared = symbols.where("sym_tag = 'FunctionArgType'").select(F.col("parent_id").alias("_ft"), F.col("type_id").alias("sym_id")).join(of, "_ft", "left_semi").select("sym_id")
    return _union([returns, named, declared]).where("sym_id is not null")


def _heading(o: Options) -> Column:
    """Indentation of a heading.  The original indents before the size, and again before the heading; without a size line both stand there."""
    level, sized = F.col("level"), F.col("length").isNotNull() & F.lit(o.size_info)
    return X.indent(F.when(sized, level).otherwise(2 * level))


def function_text(rows: DataFrame, symbols: DataFrame, o: Options = DEFAULT, known: DataFrame | None = None) -> DataFrame:
    """rows (of symbols, with enclosing) with function_text: prefixes, return type, name, arguments, const."""
    functions = symbols.where("sym_tag = 'FunctionType'").select(F.col("sym_id").alias("_ft"), F.col("type_id").alias("_returns"), F.col("const_type").alias("_ft_const"))
    rows = rows.join(functions, rows["type_id"] == functions["_ft"], "left")
    if known is None:
        known = cut(texts(symbols, mentioned(rows, symbols), o.offset_info))
    rows = _with_text(rows, symbols, o, "_returns", "_return_text", known=known)
    params = symbols.where("sym_tag = 'Data' and data_kind = 'Param'").join(rows.select(F.col("sym_id").alias("parent_id")).distinct(), "parent_id", "left_semi")
    named = _with_text(params.select("sym_id", "parent_id", "ordinal"), symbols, o, known=known).groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "sym_id", "type_text"))).alias("_p"))
    named = named.select(F.col("parent_id").alias("_fn"), F.array_join("_p.type_text", ", ").alias("_named"), F.size("_p").alias("_n_named"))
    declared = argument_lists(symbols, rows.where("_ft is not null").select(F.col("_ft").alias("sym_id")), o.offset_info, known=known).select(F.col("sym_id").alias("_dt"), F.col("args").alias("_declared"), F.col("n_args").alias("_n_args"))
    rows = rows.join(named, rows["sym_id"] == named["_fn"], "left").join(declared, rows["_ft"] == declared["_dt"], "left")
    n, m = F.coalesce("_n_named", F.lit(0)), F.coalesce("_n_args", F.lit(0))
    more = F.when(n != m, F.concat(F.when(n > 0, " <- ").otherwise(""), X.or_empty(F.col("_declared")))).otherwise("")
    text = F.concat(
        X.or_empty(F.concat(X.virtual_name(F.col("is_virtual")), F.lit(" "))), X.or_empty(F.concat(X.static_name(F.col("is_static")), F.lit(" "))),
        X.or_empty(F.concat(F.col("_return_text"), F.lit(" "))), marked(F.col("name")), F.lit("("), X.or_empty(F.col("_named")), more, F.lit(")"),
        F.when(F.col("const_type"), " const").when(F.col("_ft_const"), " (null)").otherwise(""), F.lit(";"),  # as the original prints a type's own const
    )
    rows = rows.withColumn("function_text", unmarked(text, F.col("enclosing"), o.non_scoped))
    return rows.drop("_ft", "_returns", "_ft_const", "_return_text", "_fn", "_named", "_n_named", "_dt", "_declared", "_n_args")


def enum_lines(rows: DataFrame, symbols: DataFrame, o: Options = DEFAULT) -> DataFrame:
    """Lines of enums; rows have root_id, path, level, enclosing and the columns of symbols."""
    level = F.col("level")
    brace, own = opening(level, o)
    head = F.concat(_heading(o), X.modifiers(F.col("const_type"), F.col("volatile_type")), F.lit("enum "), X.or_empty(F.col("name")), X.base_of_enum(F.col("base_type"), F.col("length")))
    parts = [_line(rows, _path(HEAD), head if own else F.concat(head, brace)), _line(rows, _path(CLOSE), F.concat(X.indent(level), X.token("scope_end")))]
    if own:
        parts.append(_line(rows, _path(OPEN), brace))
    if o.size_info:
        parts.append(_line(rows.where("length is not null"), _path(SIZE), F.concat(X.indent(level), X.size_text(F.col("length")))))
    values = symbols.where("sym_tag = 'Data'").select(F.col("parent_id").alias("_enum"), F.col("ordinal").alias("_at"), F.col("sym_id").alias("_id"), F.col("name").alias("_name"), F.col("value").alias("_value"))
    each = rows.join(values, rows["sym_id"] == values["_enum"])
    text = X.enum_member(X.scoped_name(F.col("_name"), F.col("enclosing"), o.non_scoped), F.col("_value"), o.enum_hex)
    parts.append(_line(each, _path(BODY, F.coalesce("_at", F.lit(0)), F.col("_id")), F.concat(X.indent(level + 1), text)))
    return _union(parts)


def typedef_lines(rows: DataFrame, symbols: DataFrame, o: Options = DEFAULT) -> DataFrame:
    rows = _with_text(rows, symbols, o, typedefs=True)
    text = F.concat(X.indent(F.col("level")), X.modifiers(F.col("const_type"), F.col("volatile_type")), F.lit("typedef "), unmarked(F.col("type_text"), F.col("enclosing"), o.non_scoped), F.lit(";"))
    return _line(rows, _path(HEAD), text)


def friend_lines(rows: DataFrame, symbols: DataFrame, o: Options = DEFAULT, known: DataFrame | None = None) -> DataFrame:
    rows = _with_text(rows, symbols, o, known=known)
    return _line(rows, _path(HEAD), F.concat(X.indent(F.col("level")), F.lit("friend "), unmarked(F.col("type_text"), F.col("enclosing"), o.non_scoped), F.lit(";")))


def nested_classes(roots: DataFrame, symbols: DataFrame, o: Options = DEFAULT) -> DataFrame:
    """root_id, sym_id, level, path, outer and own: each class below the roots with the enclosing names.

    own is the class's name inside the class around it; it is the enclosing name of
    its members.  A class's path is that of its parent, then its place there.
    """
    tree = navigate.descendants(symbols, roots, "UDT")
    names = symbols.where("sym_tag = 'UDT'").select(F.col("sym_id").alias("_id"), F.col("name").alias("_name"))
    chain = tree.select("root_id", "sym_id", "depth", F.col("path").alias("_way"), F.posexplode(F.concat(F.array("root_id"), F.filter("path", lambda x, i: i % 2 == 1))).alias("_k", "_on"))
    chain = chain.join(names, chain["_on"] == names["_id"]).groupBy("root_id", "sym_id", "depth", "_way").agg(F.array_sort(F.collect_list(F.struct("_k", "_name"))).alias("_names"))
    own = F.aggregate(F.col("_names._name"), F.array(F.lit(None).cast("string"), F.lit(None).cast("string")), lambda a, n: F.array(a[1], X.scoped_name(n, a[1], o.non_scoped)))
    step = lambda x, i: F.when(i % 2 == 0, F.array(F.lit(BODY).cast("bigint"), F.lit(M.CLASSES).cast("bigint"), F.lit(1).cast("bigint"), x)).otherwise(F.array(x))
    return chain.select("root_id", "sym_id", F.col("depth").alias("level"), F.flatten(F.transform("_way", step)).alias("path"), own[0].alias("outer"), own[1].alias("own"))


def class_lines(roots: DataFrame, symbols: DataFrame, lines: DataFrame | None = None, source_files: DataFrame | None = None, o: Options = DEFAULT) -> DataFrame:
    """Lines of classes with everything in them; roots needs sym_id."""
    places = cut(nested_classes(roots, symbols, o))
    rows = places.join(symbols, "sym_id")
    level = F.col("level")
    brace, on_own_line = opening(level, o)
    bases = navigate.base_classes(rows, symbols.withColumn("name", marked(F.col("name"))), o.base_access).withColumnRenamed("sym_id", "_derived")
    around = places.select("root_id", F.col("path"), F.col("sym_id").alias("_class"), (level + 1).alias("level"), F.col("own").alias("enclosing"))
    shown = cut(M.members(places, symbols).join(around, F.col("parent_id") == F.col("_class")).drop("_class"))
    # One resolution for all types that the classes mention, but those being defined.
    functions = shown.where("sym_tag = 'Function'")
    wanted = _union([places.select("sym_id"), shown.where("sym_tag in ('Data', 'Friend')").select("sym_id"), mentioned(functions, symbols)])
    known = cut(texts(symbols, wanted.where("sym_id is not null"), o.offset_info))
    whole = _with_text(rows, symbols, o, known=known).join(bases, F.col("sym_id") == F.col("_derived"), "left")
    keyword = X.keyword_text(F.col("sym_tag"), F.col("base_type"), F.col("length"), F.col("udt_kind"))
    head = F.concat(_heading(o), X.modifiers(F.col("const_type"), F.col("volatile_type")), keyword, unmarked(F.concat("type_text", X.or_empty(F.col("bases"))), F.col("own"), o.non_scoped))
    parts = [_line(whole, _path(HEAD), head if on_own_line else F.concat(head, brace)), _line(rows, _path(CLOSE), F.concat(X.indent(level), X.token("scope_end")))]
    if on_own_line:
        parts.append(_line(rows, _path(OPEN), brace))
    if o.size_info:
        parts.append(_line(rows.where("length is not null"), _path(SIZE), F.concat(X.indent(level), X.size_text(F.col("length")))))

    if o.info_comment:
        heads = M.sections(shown, ("root_id", "path", "level"))
        parts.append(_line(heads, _path(BODY, F.col("section"), 0, 1), F.concat(X.indent(level), F.lit("/// "), F.col("header"), F.lit(":"))))
        parts.append(_line(heads.where("blank_before"), _path(BODY, F.col("section"), 0, 0), F.lit("")))
    key = F.coalesce("section_key", F.lit(-(1 << 40)))
    placed = shown.withColumn("_own", _path(BODY, F.col("section"), 1, F.when(F.col("section").isin(M.VIRTUALS, M.FIELDS), key).otherwise(F.coalesce("ordinal", F.lit(0))), F.coalesce("ordinal", F.lit(0)), F.col("sym_id")))
    of = lambda s: placed.where(F.col("section") == s).drop("path").withColumnRenamed("_own", "path")
    parts.append(friend_lines(of(M.FRIENDS), symbols, o, known))
    parts.append(enum_lines(of(M.ENUMS), symbols, o))
    parts.append(typedef_lines(of(M.TYPEDEFS), symbols, o))
    functions = function_text(placed.where(F.col("section").isin(M.VIRTUALS, M.FUNCS)).drop("path").withColumnRenamed("_own", "path"), symbols, o, known)
    suffix = F.when(F.col("section") == M.VIRTUALS, M.virtual_suffix(F.col("virtual_base_offset"), o.offset_info)).otherwise("")
    parts.append(_line(functions, F.col("path"), F.concat(X.indent(level), "function_text", suffix)))
    data = _with_text(placed.where(F.col("section").isin(M.FIELDS, M.OTHERS)).drop("path").withColumnRenamed("_own", "path"), symbols, o, known=known)
    text = unmarked(F.col("type_text"), F.col("enclosing"), o.non_scoped)
    line = F.when(F.col("section") == M.FIELDS, M.field_line(text, level, F.col("offset"), o.offset_info, o.tabulation)).otherwise(M.other_line(text, level, F.col("data_kind")))
    parts.append(_line(data, F.col("path"), line))
    if o.type_source and lines is not None and source_files is not None:
        parts.append(source_lines(shown, lines, source_files))
    return _union(parts)


def source_lines(shown: DataFrame, lines: DataFrame, source_files: DataFrame) -> DataFrame:
    """'// file' of the functions of a class: virtuals first, each in order, repeats kept."""
    functions = shown.where(F.col("section").isin(M.VIRTUALS, M.FUNCS))
    found = functions.join(lookup.sources_of(functions.dropDuplicates(["sym_id"]), lines, source_files), "sym_id")
    return _line(found, _path(SOURCES, F.col("section"), F.coalesce("ordinal", F.lit(0)), F.col("sym_id")), F.concat(F.lit("// "), F.col("file_name")))


def type_lines(matches: DataFrame, symbols: DataFrame, lines: DataFrame | None = None, source_files: DataFrame | None = None, o: Options = DEFAULT) -> DataFrame:
    """Lines of the matched symbols, each by its tag; other tags give none."""
    top = matches.withColumn("root_id", F.col("sym_id")).withColumn("path", F.array().cast("array<bigint>")).withColumn("level", F.lit(0)).withColumn("enclosing", F.lit(None).cast("string"))
    there = {r[0] for r in matches.where(F.col("sym_tag").isin(*HANDLED)).select("sym_tag").distinct().collect()}  # five tags at most
    made = {
        "UDT": lambda x: class_lines(x.select("sym_id"), symbols, lines, source_files, o),
        "Enum": lambda x: enum_lines(x, symbols, o),
        "Typedef": lambda x: typedef_lines(x, symbols, o),
        "Data": lambda x: _line(_with_text(x, symbols, o), _path(HEAD), unmarked(F.col("type_text"), F.col("enclosing"))),
        "Function": lambda x: _line(function_text(x, symbols, o), _path(HEAD), F.col("function_text")),
    }
    parts = [f(top.where(F.col("sym_tag") == tag)) for tag, f in made.items() if tag in there] or [_line(top.limit(0), F.col("path"), F.col("name"))]
    order = matches.select(F.col("sym_id").alias("_root"), F.col("ordinal").alias("root_ordinal"))
    out = _union(parts)
    return out.join(order, out["root_id"] == order["_root"]).select("root_ordinal", *LINE)


def ordered(lines: DataFrame) -> DataFrame:
    """Text in printing order, as a global sort; each row keeps the keys it is sorted by."""
    keys = [c for c in ("root_ordinal", "root_id", "path") if c in lines.columns]
    return lines.orderBy(*keys)


def numbered(lines: DataFrame) -> DataFrame:
    """root_id, line_no from 1 within each root, text."""
    return lines.select("root_id", F.row_number().over(Window.partitionBy("root_id").orderBy("path")).cast("bigint").alias("line_no"), "text")


def dump_tree(symbols: DataFrame, roots: DataFrame, o: Options = DEFAULT) -> DataFrame:
    """root_id, path, depth, sym_tag, text of everything below the roots, with the type text of each symbol."""
    tree = navigate.descendants(symbols, roots).where("depth > 0").join(symbols.select("sym_id", "sym_tag"), "sym_id")
    rows = _with_text(tree, symbols, o)
    return rows.select("root_id", "path", "depth", "sym_tag", unmarked(F.col("type_text"), F.lit(None).cast("string")).alias("text"))


def vtable_lines(tables: DataFrame, symbols: DataFrame, o: Options = DEFAULT) -> DataFrame:
    """Lines of vtables: addresses, own text, and the texts of the children as comments."""
    top = _with_text(tables.withColumn("root_id", F.col("sym_id")).withColumn("path", F.array().cast("array<bigint>")), symbols, o)
    plain = lambda c: unmarked(F.col(c), F.lit(None).cast("string"))
    kids = symbols.select(F.col("sym_id").alias("_kid"), F.col("parent_id").alias("_of_table"), F.col("ordinal").alias("_at"))
    kids = _with_text(top.drop("type_text").join(kids, F.col("sym_id") == F.col("_of_table")), symbols, o, "_kid")
    return _union([
        _line(top.where("rva is not null"), _path(0), X.rva_text(F.col("rva"))), _line(top.where("va is not null"), _path(1), X.va_text(F.col("va"))),
        _line(top, _path(2), plain("type_text")), _line(kids, _path(3, F.coalesce("_at", F.lit(0)), F.col("_kid")), F.concat(F.lit("// "), plain("type_text"))),
    ])
