"""Hand-made catalogs: type texts, whole declarations, predicates, settings and commands, line by line."""

import io
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from symlattice import cli
from symlattice import settings as S
from symlattice.functions import text as X
from symlattice.operators import lookup, navigate, predicates
from symlattice.plans import compilands, members, render, types
from symlattice.schema import LINES, SOURCE_FILES, SYMBOLS, conform
from symlattice.settings import EngineError, Options
from symlattice.sources.catalog import Catalog, load, save, validate


def symbols(spark, rows):
    """rows of dicts; sym_id counts from 1 where absent, ordinal is the row's place."""
    full = []
    for i, r in enumerate(rows):
        r = {"sym_id": i + 1, "ordinal": i, **r}
        r.setdefault("name_lower", r.get("name", "").lower() if r.get("name") else None)
        full.append(tuple(Decimal(r[f.name]) if f.name in ("length", "va") and r.get(f.name) is not None else r.get(f.name) for f in SYMBOLS))
    return spark.createDataFrame(full, SYMBOLS)


# Chains, outermost first, by the kinds of their pieces.
PIECES = {
    "i32": dict(sym_tag="BaseType", base_type="Int", length=4), "u32": dict(sym_tag="BaseType", base_type="UInt", length=4), "char": dict(sym_tag="BaseType", base_type="Char"), "float": dict(sym_tag="BaseType", base_type="Float", length=4),
    "void": dict(sym_tag="BaseType", base_type="Void"), "bool": dict(sym_tag="BaseType", base_type="Bool"), "cchar": dict(sym_tag="BaseType", base_type="Char", const_type=True), "vi32": dict(sym_tag="BaseType", base_type="Int", length=4, volatile_type=True),
    "p": dict(sym_tag="Pointer"), "cp": dict(sym_tag="Pointer", const_type=True), "r": dict(sym_tag="Pointer", is_reference=True), "a2": dict(sym_tag="Array", array_count=2), "a3": dict(sym_tag="Array", array_count=3), "a4": dict(sym_tag="Array", array_count=4),
    "Foo": dict(sym_tag="UDT", name="Foo", udt_kind="Struct"), "v": dict(sym_tag="UDT", name="v"), "MyInt": dict(sym_tag="Typedef", name="MyInt"), "Color": dict(sym_tag="Enum", name="Color"), "f": dict(sym_tag="FunctionType"),
    "T": dict(sym_tag="Typedef", name="TestedTypedef"), "bits": dict(sym_tag="Data", name="f", bit_position=5, length=3),
}
VECTORS = [
    ("x", ["i32"], {}, "__int32 x"), ("x", ["p", "i32"], {}, "__int32* x"), ("x", ["p", "p", "char"], {}, "char** x"), ("x", ["cp", "cchar"], {}, "const char* const x"), ("x", ["vi32"], {}, "volatile __int32 x"),
    ("x", ["r", "Foo"], {}, "Foo& x"), ("x", ["a2", "a3", "float"], {}, "float x[2][3]"), ("x", ["a4", "p", "char"], {}, "char* x[4]"), ("x", ["p", "a4", "char"], {}, "char (*x)[4]"),
    ("_arg1", ["p", "p", "f", "void"], {"args": [["p", "void"]]}, "void (**_arg1)(void*)"), ("cb", ["p", "f", "void"], {}, "void* cb"), ("cb", ["p", "f", "bool"], {"args": [["i32"], ["p", "char"]]}, "bool (*cb)(__int32, char*)"),
    (None, ["bits", "u32"], {}, "unsigned __int32 f : 3; // 0x5"), (None, ["T", "p", "f", "void"], {"args": [["p", "void"]], "defining": True}, "void (*)(void*) TestedTypedef"), ("x", ["MyInt", "i32"], {}, "MyInt __int32 x"),
    ("e", ["Color", "i32"], {}, "Color e"), ("x", ["a3", "a3", "cp", "a2", "f", "v"], {}, "v (*const x)[3][3][2]"),
    ("deep", ["p", "f", "void"], {"args": [["p", "f", "i32"]], "inner": [["char"]]}, "void (*deep)(__int32 (*)(char))"),
]


def build(rows, chain, args=(), inner=()):
    """Adds a chain to rows; its id."""
    below = None
    for kind in reversed(chain):
        rows.append({**PIECES[kind], "type_id": below, "sym_id": len(rows) + 1})
        below = len(rows)
        if kind == "f":
            own = below
            for k, a in enumerate(args):
                t = build(rows, a, inner)
                rows.append(dict(sym_id=len(rows) + 1, sym_tag="FunctionArgType", parent_id=own, ordinal=k, type_id=t))
            below = own
    return below


def test_type_texts(spark):
    rows, roots, defining = [], {}, {}
    for name, chain, extra, want in VECTORS:
        top = build(rows, chain, extra.get("args", ()), extra.get("inner", ()))
        if name:
            rows.append(dict(sym_id=len(rows) + 1, sym_tag="Data", name=name, type_id=top))
            top = len(rows)
        (defining if extra.get("defining") else roots)[top] = want
    s = symbols(spark, rows)
    for expected, typedefs in ((roots, False), (defining, True)):
        got = types.type_text(s, s.where(F.col("sym_id").isin(*expected)), typedefs=typedefs)
        assert {r["sym_id"]: r["text"] for r in got.collect()} == expected


def test_cycles_are_reported(spark):
    s = symbols(spark, [dict(sym_tag="Pointer", type_id=2), dict(sym_tag="Pointer", type_id=1)])
    with pytest.raises(ValueError):
        types.chains(s, s, most=8).count()


def sample(spark):
    """A class like the documented sample: a base, a typedef, virtuals in one slot, functions, sources."""
    rows = [
        dict(sym_id=1, sym_tag="UDT", name="MainObjectDefinition", udt_kind="Class", length=52, parent_id=0, ordinal=0),
        dict(sym_id=2, sym_tag="BaseClass", name="ExposedDefinition", access="public", parent_id=1, ordinal=0),
        dict(sym_id=3, sym_tag="Typedef", name="MainObjectDefinition::ClassBeingDefined", parent_id=1, ordinal=1, type_id=4),
        dict(sym_id=4, sym_tag="UDT", name="MainObject", udt_kind="Class"),
        dict(sym_id=5, sym_tag="Pointer", type_id=4), dict(sym_id=6, sym_tag="Pointer", is_reference=True, type_id=1), dict(sym_id=7, sym_tag="BaseType", base_type="Void"),
        dict(sym_id=8, sym_tag="FunctionType", type_id=5), dict(sym_id=9, sym_tag="FunctionType", type_id=7), dict(sym_id=10, sym_tag="FunctionType", type_id=6),
    ]
    for k, (name, t) in enumerate((("CreateObject", 8), ("Init", 9), ("~MainObjectDefinition", 9))):
        rows.append(dict(sym_id=20 + k, sym_tag="Function", name=f"MainObjectDefinition::{name}", parent_id=1, ordinal=10 + k, type_id=t, is_virtual=True, virtual_base_offset=0, addr_section=1, addr_offset=10 * k))
    for k, (name, t) in enumerate((("MainObjectDefinition", 9), ("operator=", 10))):
        rows.append(dict(sym_id=30 + k, sym_tag="Function", name=f"MainObjectDefinition::{name}", parent_id=1, ordinal=20 + k, type_id=t, is_virtual=False, addr_section=1, addr_offset=100 + 10 * k))
    s = symbols(spark, rows)
    lines = spark.createDataFrame([(1, 0, 20, 1, 1, 0), (1, 0, 5, 2, 1, 1), (1, 100, 50, 2, 9, 2)], LINES)
    files = spark.createDataFrame([(1, "a.cpp", 0), (2, "b.cpp", 1)], SOURCE_FILES)
    return Catalog(s, lines, files)


SAMPLE = """\
// size: 52 byte
class MainObjectDefinition : public ExposedDefinition
{
    /// TYPEDEFS:
    typedef MainObject ClassBeingDefined;

    /// VIRTUALS:
    virtual MainObject* CreateObject(); // 0x0
    virtual void Init(); // 0x0
    virtual void ~MainObjectDefinition(); // 0x0

    /// FUNCS:
    void MainObjectDefinition();
    MainObjectDefinition& operator=();
};
// a.cpp
// a.cpp
// b.cpp
// b.cpp""".split("\n")


def texts(df):
    return [r["text"] for r in df.collect()]


def test_sample_class(spark):
    c = sample(spark)
    assert texts(cli.type_lines(spark, c, "mainobjectdefinition", Options())) == SAMPLE


def test_options_change_the_text(spark):
    c = sample(spark)
    o = Options(size_info=False, offset_info=False, brace_on_new_line=False, info_comment=False, type_source=False, non_scoped=False, base_access=1)
    got = texts(cli.type_lines(spark, c, "MainObjectDefinition", o))
    assert got[0] == "class MainObjectDefinition : private ExposedDefinition {"
    assert got[1] == "    typedef MainObject MainObjectDefinition::ClassBeingDefined;"
    assert got[2] == "    virtual MainObject* MainObjectDefinition::CreateObject();"
    assert got[-1] == "};" and len(got) == 8
    assert texts(cli.type_lines(spark, c, "mainobjectdefinition", Options(case_sensitive=True))) == []


def test_nested_class_and_fields(spark):
    s = symbols(spark, [
        dict(sym_id=1, sym_tag="UDT", name="Test::TestedClass", udt_kind="Class", parent_id=0, length=8, ordinal=0),
        dict(sym_id=2, sym_tag="UDT", name="Test::TestedClass::TestedSubClass", udt_kind="Class", parent_id=1, ordinal=1),
        dict(sym_id=3, sym_tag="Data", name="testedField_INT", data_kind="Member", parent_id=2, offset=0, type_id=10),
        dict(sym_id=4, sym_tag="Data", name="second", data_kind="Member", parent_id=1, offset=4, type_id=11, ordinal=2),
        dict(sym_id=5, sym_tag="Data", name="first", data_kind="Member", parent_id=1, offset=0, type_id=2, ordinal=3),
        dict(sym_id=6, sym_tag="Data", name="one", data_kind="StaticMember", parent_id=1, type_id=11, ordinal=4),
        dict(sym_id=7, sym_tag="Data", name="unknown", parent_id=1, type_id=11, ordinal=5),
        dict(sym_id=8, sym_tag="Function", name="neither", parent_id=1, ordinal=6),
        dict(sym_id=10, sym_tag="BaseType", base_type="Int", length=4), dict(sym_id=11, sym_tag="BaseType", base_type="UInt", length=2),
    ])
    got = texts(render.ordered(render.type_lines(predicates.find_type(s, "Test"), s)))
    assert got == [
        "// size: 8 byte", "class Test::TestedClass", "{", "    /// CLASSES:", "        class Test::TestedClass::TestedSubClass", "    {", "        /// FIELDS:",  # no size line, so the indentation before it stands here too
        "        __int32 testedField_INT; ".ljust(60) + "// 0x0", "    };", "", "    /// FIELDS:", "    TestedSubClass first; ".ljust(60) + "// 0x0", "    unsigned __int16 second; ".ljust(60) + "// 0x4",
        "", "    /// OTHER MEMBERS:", "    static unsigned __int16 one;", "};",
    ]


def test_functions_name_their_arguments(spark):
    s = symbols(spark, [
        dict(sym_id=1, sym_tag="Function", name="g", parent_id=0, type_id=2, const_type=True), dict(sym_id=2, sym_tag="FunctionType", type_id=3), dict(sym_id=3, sym_tag="BaseType", base_type="UInt", length=4),
        dict(sym_id=4, sym_tag="FunctionArgType", parent_id=2, ordinal=0, type_id=3), dict(sym_id=5, sym_tag="FunctionArgType", parent_id=2, ordinal=1, type_id=6), dict(sym_id=6, sym_tag="Pointer", type_id=3),
        dict(sym_id=7, sym_tag="Data", data_kind="Param", name="n", parent_id=1, ordinal=0, type_id=3), dict(sym_id=8, sym_tag="Data", data_kind="Local", name="l", parent_id=1, type_id=3),
        dict(sym_id=9, sym_tag="Function", name="h", parent_id=0, type_id=2), dict(sym_id=10, sym_tag="Function", name="bare%d", parent_id=0),
    ])
    got = {r["root_id"]: r["text"] for r in render.type_lines(s.where("sym_tag = 'Function'"), s).collect()}
    assert got[1] == "unsigned __int32 g(unsigned __int32 n <- unsigned __int32, unsigned __int32*) const;"
    assert got[9] == "unsigned __int32 h(unsigned __int32, unsigned __int32*);"
    assert got[10] == "bare%d();"


def names(df):
    return sorted(r["name"] for r in df.collect())


def test_searches(spark):
    s = symbols(spark, [dict(sym_tag="UDT", name=n, parent_id=0) for n in ("A::B", "A::B::C", "AB", "a::B", "A::T<X::Y>", "MainObject")] + [dict(sym_tag="Compiland", name="Q", parent_id=0), dict(sym_tag="UDT", name="Q::R", parent_id=0)])
    assert names(predicates.find_exact(s, "mainobject")) == ["MainObject"]
    assert names(predicates.find_exact(s, "mainobject", True)) == []
    assert names(predicates.find_namespace(s, "A")) == names(predicates.find_namespace(s, "A::")) == ["A::B"]
    assert names(predicates.find_type(s, "A")) == ["A::B"]
    assert names(predicates.dispatch(predicates.find_type(s, "Q"))) == []  # a match of another tag keeps the fallback away
    assert names(predicates.children(s, 0, "UDT", "ab")) == ["AB"]
    assert predicates.any_found(predicates.find_exact(s, "zz")).first()["found"] is False


def test_search_is_pushed_down(spark, tmp_path):
    save(Catalog(symbols(spark, [dict(sym_tag="UDT", name="A", parent_id=0)]), spark.createDataFrame([], LINES), spark.createDataFrame([], SOURCE_FILES)), str(tmp_path / "c"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    c = load(spark, str(tmp_path / "c"))
    assert "EqualTo(name_lower,a)" in plan(predicates.find_exact(c.symbols, "A"))
    assert "StringStartsWith(name,A::)" in plan(predicates.find_namespace(c.symbols, "A"))
    assert "PartitionFilters: [isnotnull(sym_tag" in plan(predicates.with_tag(c.symbols, "UDT"))


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_scalars(spark):
    lit = F.lit
    scope = lambda n, p: one(spark, X.scoped_name(lit(n), lit(p).cast("string")))
    assert scope("P::A::f", "P::A") == "f" and scope("A::T<A::x>", "A") == "A::T<A::x>" and scope("P::A", None) == "P::A" and scope(None, "A") == ""
    value = lambda vt, i, **k: one(spark, X.variant_text(F.struct(lit(vt).alias("vt"), lit(i).cast("bigint").alias("i64"), lit(None).cast("string").alias("str")), **k))
    assert [value("I4", -1), value("UI4", 4294967295), value("I1", -1), value("I8", 7)] == [" = -1", " = 4294967295", " = 255", ""]
    assert value("I4", -1, as_hex=True) == " = FFFFFFFF" and value("I8", 7, strict=False) == " = 7" and value("I1", -1, strict=False) == " = -1"
    pad = lambda n, **k: one(spark, X.pad_comment(lit("x" * n), lit("//"), **k)).find("/")
    assert [pad(59), pad(60), pad(70), pad(99), pad(165), pad(59, pad=False)] == [60, 100, 100, 166, 276, 59]
    assert one(spark, X.access_name(lit("private"), 3)) == "public" and one(spark, X.access_name(lit(None).cast("string"))) is None
    assert [one(spark, X.int_prefix(lit(t))) for t in ("12ab", "abc", "", " -7 ")] == [12, 0, 0, -7]
    assert one(spark, X.crc32(lit("GlobalSettings::s_isSizeInfo"))) == 0x61A23FE4
    assert one(spark, X.va_text(lit("18446744073709551615").cast("decimal(20,0)"))) == "// VA: 0xFFFFFFFFFFFFFFFF" and one(spark, X.rva_text(lit(4096))) == "// RVA: 0x1000" and one(spark, X.vtable_offset_text(lit(16))) == "// 0x10"
    assert one(spark, X.location_text(lit("TLS"))) == "// Location: TLS" and one(spark, X.location_text(lit("9"))) == "// Location: Unknown (9)" and one(spark, X.location_text(lit("ThisRel"))) == "// Location: This-relative (class member)"
    assert one(spark, X.utf16_to_utf8(X.utf8_to_utf16(lit("añ")))) == "añ" and one(spark, X.utf16_to_utf8(lit(None).cast("binary"))) == ""
    for f, want in ((X.inline_name, "inline"), (X.naked_name, "naked"), (X.noreturn_name, "noreturn"), (X.noinline_name, "noinline"), (X.pure_name, "= 0")):
        assert one(spark, f(lit(True))) == want and one(spark, f(lit(False))) is None
    assert one(spark, X.access_scope(lit("public"))) == "public: " and one(spark, X.array_text(lit(None).cast("bigint"))) == ""
    assert one(spark, X.base_type_name(lit("Int"), lit(3))) == "int" and one(spark, X.base_type_name(lit("BCD"), lit(1))) is None


def test_navigation(spark):
    s = symbols(spark, [dict(sym_tag="UDT", name="a", parent_id=0), dict(sym_tag="UDT", name="b", parent_id=1, class_parent_id=1, lexical_parent_id=1), dict(sym_tag="Data", name="c", parent_id=2, type_id=1), dict(sym_tag="VTable", parent_id=1, rva=16, va=32, type_id=1)])
    assert {(r["sym_id"], r["n_children"]) for r in navigate.children_count(s, s, "Data").collect()} == {(1, 0), (2, 1), (3, 0), (4, 0)}
    assert [r["path"] for r in navigate.descendants(s, s.where("sym_id = 1")).orderBy("path").collect()] == [[], [1, 2], [1, 2, 2, 3], [3, 4]]
    assert navigate.with_class_parent(s, s).where("sym_id = 2").first()["class_name"] == "a" and navigate.with_lexical_parent(s, s).where("sym_id = 2").first()["lexical_name"] == "a"
    assert navigate.with_type(s, s).where("sym_id = 3").first()["type_name"] == "a"
    assert texts(render.vtable_lines(s.where("sym_tag = 'VTable'"), s).orderBy("path"))[:3] == ["// RVA: 0x10", "// VA: 0x20", "a"]
    assert [r["depth"] for r in render.dump_tree(s, s.where("sym_id = 1")).orderBy("path").collect()] == [1, 2, 1]
    loop = symbols(spark, [dict(sym_tag="UDT", parent_id=2), dict(sym_tag="UDT", parent_id=1)])
    with pytest.raises(ValueError):
        navigate.descendants(loop, loop.where("sym_id = 1"), most=8)


def test_lookup_of_long_ranges(spark):
    ranges = [(1, 0, 10_000_000_000, 1, 1, 5), (1, 5000, 10, 2, 2, 3), (1, 5000, 0, 3, 3, 0), (2, 0, 1_000_000, 4, 4, 1)]
    lines = spark.createDataFrame(ranges, LINES)
    probes = [(1, 5004), (1, 5010), (1, 9_999_999_999), (1, 10_000_000_000), (2, 999_999), (3, 1)]
    s = symbols(spark, [dict(sym_tag="Function", addr_section=a, addr_offset=b) for a, b in probes])
    want = {}
    for i, (a, b) in enumerate(probes):
        hit = [r for r in ranges if r[0] == a and r[1] <= b < r[1] + r[2]]
        if hit:
            want[i + 1] = min(hit, key=lambda r: r[5])[3]
    assert {r["sym_id"]: r["file_id"] for r in lookup.first_line(s, lines).collect()} == want


def test_compilands(spark):
    s = symbols(spark, [
        dict(sym_tag="Compiland", name="a.obj", parent_id=0), dict(sym_tag="Compiland", parent_id=0), dict(sym_tag="CompilandDetails", parent_id=1, compiler_name="cc", language=1, platform=2, has_debug_info=True),
        dict(sym_tag="CompilandEnv", name="cwd", parent_id=1, value=("BSTR", None, "c:\\")), dict(sym_tag="CompilandEnv", name="n", parent_id=1, value=("I4", 5, None)),
    ])
    c = Catalog(s, spark.createDataFrame([], LINES), spark.createDataFrame([(1, "x", 1), (2, None, 2)], SOURCE_FILES))
    assert texts(cli.compilands(c)) == ["a.obj"]
    assert texts(cli.compilands(c, True)) == ["[OBJ] a.obj", "[ABOUT] Compiler: cc; Language: 1; Platform: 2; Debug: true", "[ENV] cwd = c:\\", "[ENV] n", "[OBJ] "]
    assert texts(compilands.source_files(c.source_files)) == ["x"]


def test_settings_round_trip(spark, tmp_path):
    path = str(tmp_path / "settings")
    stored = S.load(spark, path)
    assert stored.count() == 12 and S.options(stored) == Options()
    S.save(S.set_value(stored, "GlobalSettings::s_isEnumHex", "5"), path)
    S.save(S.set_value(S.load(spark, path), "GlobalSettings::s_baseAccessType", 3), path)
    assert S.options(S.load(spark, path)) == Options(enum_hex=True, base_access=3)
    with pytest.raises(EngineError):
        S.set_value(stored, "nothing", 1)
    with pytest.raises(EngineError):
        S.set_value(stored, "GlobalSettings::s_isEnumHex", None)
    rows = [(r["hash"], r["type_id"], r["value"]) for r in S.load(spark, path).collect()]
    data = S.encode_file(rows)
    assert len(data) == 4096 and S.decode_file(data) == rows and not S.header_is_valid(bytes(4096))
    assert S.CAPACITY == 340 and S.entry_size("Bool") == 12
    with pytest.raises(EngineError):
        S.encode_file(rows * 100)
    assert S.count(stored).first()["n_entries"] == 12 and S.append(stored, stored).count() == 24


def test_commands(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    monkeypatch.setenv("HOME", str(tmp_path))
    save(sample(spark), str(tmp_path / "x.pdb"))

    def run(*args):
        out = io.StringIO()
        return cli.main(["symlattice", *args], spark, out), out.getvalue().splitlines()

    assert run("-type", "MainObjectDefinition", "x.pdb") == (0, SAMPLE)
    assert run("-type", "Nothing", "x.pdb") == (0, [])
    assert run("-sources", "x.pdb") == (0, ["a.cpp", "b.cpp"])
    assert run("-compilands", "true", "x.pdb") == run("-compilands", "x.pdb") == (0, [])
    assert run("-settings", "GlobalSettings::s_isSizeInfo", "0") == (0, []) and run("-type", "MainObjectDefinition", "x.pdb")[1] == SAMPLE[1:]
    assert len(run("--s", "-h")[1]) == 12
    code, lines = run("-help")
    assert code == 0 and lines[2].index("<typename>") == 21 and lines[2].index(" : print type info") == 44 and "-help, --h" in lines[3]
    for bad in (["-nothing"], ["-type", "x.pdb"], ["-type", "A", "x.PDB"], ["-type", "A", "x"], ["-sources", "y.pdb"], ["-settings", "nothing", "1"], []):
        code, lines = run(*bad)
        assert code == 1 and lines[0].startswith("Error: ")
    with pytest.raises(EngineError, match="wrong"):
        cli.verify_format("a.PDB")
    with pytest.raises(EngineError, match="missing"):
        cli.verify_format("a")
    cli.write_text(cli.type_lines(spark, sample(spark), "MainObjectDefinition", Options()), str(tmp_path / "out"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == SAMPLE


def test_arguments_text():
    assert cli.arguments_text(["symlattice", "-type", "A B", "x.pdb"]) == "Args count: 4 \nArgs: symlattice, -type, A B, x.pdb;\n"
    assert cli.arguments_text([]) == "Args count: 0 \nArgs: \n"


def test_validate(spark):
    s = symbols(spark, [dict(sym_id=1, sym_tag="UDT", parent_id=1, type_id=9), dict(sym_id=1, sym_tag="UDT", parent_id=0)])
    got = {r["problem"]: r["n"] for r in validate(Catalog(s, None, None)).collect()}
    assert got == {"sym_id is not unique": 1, "type_id refers to no symbol": 1, "symbol refers to itself": 1}
    assert conform(spark.range(1).select(F.col("id").alias("sym_id"), F.lit("A").alias("name")), SYMBOLS).first()["name_lower"] == "a"


def test_empty_catalog(spark):
    s = spark.createDataFrame([], SYMBOLS)
    assert render.type_lines(s, s).count() == 0 and types.type_text(s, s).count() == 0
    assert members.sections(members.numbered(members.members(s, s))).count() == 0
