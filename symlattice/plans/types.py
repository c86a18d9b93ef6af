"""Type texts: chains along type_id, composed into declarations.

Each symbol gives one piece; the pieces from a root to the end of its chain are an
array column.  The chains of a few roots are walked by equi-joins, a few steps at a
time; those of many are made by pointer doubling over the types that symbols refer
to, so the number of joins is the logarithm of the depth.  The composition is not
associative when folded step by step, but has a closed form over the whole array:
round brackets are needed if a pointer stands before an array, or if a function
type has arguments; every other part is a concatenation in order.  Argument lists
of function types are composed the same way, one level of nesting after another.

Names are kept between two marks until the enclosing class is known, since the same
type prints differently inside different classes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .stages import cut

BEGIN, END = "\x01", "\x02"
PIECE = ("tag", "is_volatile", "is_const", "const_pointed", "type", "pointer", "array", "name", "bitfield", "defined", "fn")


def marked(name: Column) -> Column:
    return F.when(F.length(X.or_empty(name)) > 0, F.concat(F.lit(BEGIN), name, F.lit(END))).otherwise("")


def unmarked(text: Column, enclosing: Column, strip: bool = True) -> Column:
    """text with every marked name reduced to what it is inside the enclosing class."""
    parts = F.split(text, f"[{BEGIN}{END}]")
    return F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, X.scoped_name(p, enclosing, strip)).otherwise(p)), "")


def _piece(offsets: bool, typedefs: bool) -> Column:
    """typedefs: a typedef's name is what is being defined, not a type used."""
    c, tag = F.col, F.col("sym_tag")
    indirect = tag.isin("Pointer", "Array")
    yes = lambda b: F.coalesce(b, F.lit(False))
    kind = F.when(tag == "BaseType", X.or_empty(X.base_type_name(c("base_type"), c("length")))).when(tag.isin("UDT", "Enum"), marked(c("name")))
    if not typedefs:
        kind = kind.when(tag == "Typedef", marked(c("name")))
    return F.struct(
        tag.alias("tag"), yes(c("volatile_type") & ~indirect).alias("is_volatile"), yes(c("const_type") & ~indirect).alias("is_const"), yes(c("const_type") & indirect).alias("const_pointed"),
        kind.otherwise("").alias("type"), F.when(tag == "Pointer", X.pointer_text(c("is_reference"))).otherwise("").alias("pointer"), F.when(tag == "Array", X.array_text(c("array_count"))).otherwise("").alias("array"),
        F.when(tag == "Data", marked(c("name"))).otherwise("").alias("name"), F.when(tag == "Data", X.bit_field_text(c("bit_position"), c("length"), offsets)).otherwise("").alias("bitfield"),
        (F.when(tag == "Typedef", marked(c("name"))).otherwise("") if typedefs else F.lit("")).alias("defined"), F.when(tag == "FunctionType", c("sym_id")).alias("fn"),
    )


FEW = 500  # roots whose chains are walked


def chains(symbols: DataFrame, roots: DataFrame, offsets: bool = True, typedefs: bool = False, block: int = 4, most: int = 128, few: int = FEW) -> DataFrame:
    """sym_id, chain: the pieces of each root and of all types below it, outermost first.

    A chain ends at a symbol without type or at an enum.  Rows that have ended join
    on keys of their own, so they do not gather in one partition.
    """
    piece = _piece(offsets, typedefs)
    onward = F.when(F.col("sym_tag") != "Enum", F.col("type_id"))
    if roots.select("sym_id").distinct().limit(few + 1).count() > few:
        return _doubled(symbols, roots, piece, onward, most)
    steps = symbols.where(F.col("type_id").isNotNull() | F.col("sym_tag").isin("Pointer", "Array", "BaseType", "FunctionType", "UDT", "Enum", "Typedef")).select(F.col("sym_id").alias("_id"), piece.alias("_piece"), onward.alias("_onward"))
    now = symbols.join(roots.select("sym_id").distinct(), "sym_id", "left_semi").select("sym_id", F.array(piece).alias("chain"), onward.alias("_next"))
    done = None
    for _ in range(0, most, block):
        for _ in range(block):
            key = F.coalesce(F.col("_next"), -1 - F.col("sym_id"))
            now = now.join(steps, key == F.col("_id"), "left").select("sym_id", F.when(F.col("_id").isNotNull(), F.concat("chain", F.array("_piece"))).otherwise(F.col("chain")).alias("chain"), F.col("_onward").alias("_next"))
        now = cut(now)
        ended = now.where("_next is null").select("sym_id", "chain")
        done = ended if done is None else done.unionByName(ended)
        now = now.where("_next is not null")
        if not now.take(1):
            return done
    raise ValueError(f"a type refers to itself, or lies more than {most} steps deep")


def _doubled(symbols: DataFrame, roots: DataFrame, piece: Column, onward: Column, most: int) -> DataFrame:
    """chains(), by doubling: each type that a symbol refers to is joined with what its chain so far leads to."""
    used = symbols.where("type_id is not null").select(F.col("type_id").alias("sym_id")).distinct()
    now = symbols.join(used, "sym_id", "left_semi").select("sym_id", F.array(piece).alias("chain"), onward.alias("_next"))
    length = 1
    while True:
        now = cut(now)
        if not now.where("_next is not null").take(1):
            break
        if length > most:
            raise ValueError(f"a type refers to itself, or lies more than {most} steps deep")
        key = F.coalesce(F.col("_next"), -1 - F.col("sym_id"))
        on = now.select(F.col("sym_id").alias("_id"), F.col("chain").alias("_more"), F.col("_next").alias("_then"))
        # A reference to no symbol ends a chain.
        now = now.join(on, key == F.col("_id"), "left").select("sym_id", F.when(F.col("_id").isNotNull(), F.concat("chain", "_more")).otherwise(F.col("chain")).alias("chain"), F.col("_then").alias("_next"))
        length *= 2
    own = symbols.join(roots.select("sym_id").distinct(), "sym_id", "left_semi").select("sym_id", F.array(piece).alias("_own"), onward.alias("_next"))
    key = F.coalesce(F.col("_next"), -1 - F.col("sym_id"))
    below = now.select(F.col("sym_id").alias("_id"), "chain")
    return own.join(below, key == F.col("_id"), "left").select("sym_id", F.when(F.col("_id").isNotNull(), F.concat("_own", "chain")).otherwise(F.col("_own")).alias("chain"))


def _fields(chain: Column, args: Column) -> Column:
    """The composed type of a chain; args: texts of the argument lists by function type."""
    part = lambda f: F.transform(chain, lambda p: p[f])
    joined = lambda f, sep="": F.array_join(F.filter(part(f), lambda x: x != ""), sep)
    some = lambda f: F.exists(chain, lambda p: p[f])
    arguments = F.array_join(F.transform(chain, lambda p: X.or_empty(args[p["fn"]])), "")
    tags = part("tag")
    first_pointer = F.array_position(tags, "Pointer")
    last_array = F.size(tags) + 1 - F.array_position(F.reverse(tags), "Array")
    crossed = (first_pointer > 0) & F.array_contains(tags, "Array") & (first_pointer < last_array)
    return F.struct(
        some("is_volatile").alias("is_volatile"), some("is_const").alias("is_const"), some("const_pointed").alias("const_pointed"), (crossed | (F.length(arguments) > 0)).alias("brackets"),
        joined("type", " ").alias("type"), joined("pointer").alias("pointer"), joined("array").alias("array"), joined("name", " ").alias("name"), arguments.alias("args"), joined("bitfield").alias("bitfield"), joined("defined", " ").alias("defined"),
    )


def render(t: Column) -> Column:
    """Text of a composed type, in declaration order with single spaces."""
    full = lambda f: F.length(t[f]) > 0
    # (when it is there, its text, whether a space goes before it, whether one may follow)
    parts = [
        (t["is_volatile"], F.lit("volatile"), True, True), (t["is_const"], F.lit("const"), True, True), (full("type"), t["type"], True, True), (t["brackets"], F.lit("("), True, False),
        (full("pointer"), t["pointer"], False, "open"), (t["const_pointed"], F.lit("const"), True, True), (full("name"), t["name"], True, True), (t["brackets"], F.lit(")"), False, True),
        (full("args"), F.concat(F.lit("("), t["args"], F.lit(")")), False, None), (full("array"), t["array"], False, True), (full("bitfield"), t["bitfield"], False, True), (full("defined"), t["defined"], True, True),
    ]
    out, space = F.lit(""), F.lit(False)
    pieces = []
    for there, what, before, after in parts:
        pieces.append(F.when(there, F.concat(F.when(space, F.lit(" ")).otherwise(""), what) if before else what).otherwise(""))
        if after is not None:
            then = (space | ~t["brackets"]) if after == "open" else F.lit(after)
            space = F.when(there, then).otherwise(space)
    return F.concat(out, *pieces)


def texts(symbols: DataFrame, roots: DataFrame, offsets: bool = True, typedefs: bool = False, nesting: int = 16) -> DataFrame:
    """sym_id, text (names marked) of each root's whole type; each distinct root is resolved once."""
    composed = chains(symbols, roots, offsets, typedefs)
    functions = composed.select(F.explode(F.transform("chain", lambda p: p["fn"])).alias("fn")).where("fn is not null").distinct()
    if not functions.take(1):
        args = F.create_map().cast("map<bigint,string>")
        return composed.select("sym_id", render(_fields(F.col("chain"), args)).alias("text"))
    if not nesting:
        raise ValueError("argument lists are nested too deep: is there a cycle?")
    lists = argument_lists(symbols, functions.withColumnRenamed("fn", "sym_id"), offsets, typedefs, nesting - 1)
    own = composed.select("sym_id", F.explode(F.array_distinct(F.transform("chain", lambda p: p["fn"]))).alias("fn")).where("fn is not null")
    own = own.join(lists.withColumnRenamed("sym_id", "fn"), "fn").groupBy("sym_id").agg(F.map_from_entries(F.collect_list(F.struct("fn", "args"))).alias("args"))
    composed = composed.join(own, "sym_id", "left")
    return composed.select("sym_id", render(_fields(F.col("chain"), F.col("args"))).alias("text"))


def argument_lists(symbols: DataFrame, functions: DataFrame, offsets: bool = True, typedefs: bool = False, nesting: int = 16, known: DataFrame | None = None) -> DataFrame:
    """sym_id, args (names marked), n_args of function types; arguments without a type count but give no text.

    known: texts in which those of all arguments are.
    """
    kids = symbols.where("sym_tag = 'FunctionArgType'").select("sym_id", "parent_id", "ordinal", "type_id")
    kids = kids.join(functions.select(F.col("sym_id").alias("parent_id")).distinct(), "parent_id", "left_semi")
    of = known if known is not None else texts(symbols, kids.where("type_id is not null").select(F.col("type_id").alias("sym_id")), offsets, typedefs, nesting)
    rows = kids.join(of.select(F.col("sym_id").alias("type_id"), "text"), "type_id", "left")
    packed = rows.groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "sym_id", "text"))).alias("a"))
    return packed.select(F.col("parent_id").alias("sym_id"), F.array_join("a.text", ", ").alias("args"), F.size("a").cast("bigint").alias("n_args"))


def type_text(symbols: DataFrame, roots: DataFrame, offsets: bool = True, typedefs: bool = False) -> DataFrame:
    """sym_id, text of types printed outside any class."""
    return texts(symbols, roots, offsets, typedefs).select("sym_id", unmarked(F.col("text"), F.lit(None).cast("string")).alias("text"))
