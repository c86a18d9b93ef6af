"""DuckDB SQL for the queries, over the driver's tables alone."""

from __future__ import annotations

# Fixed values, written down here again: the SQL takes nothing from the code that it checks.
_NAMES = {
    "Currency": "CY", "Date": "DATE", "Variant": "VARIANT", "Complex": "std::complex", "BSTR": "BSTR", "HRESULT": "HRESULT",
    "Char16": "char16_t", "Char32": "char32_t", "Char8": "char8_t", "Void": "void",
    "Bool": "bool", "Char": "char", "WChar": "wchar_t", "Long": "long", "ULong": "unsigned long",
}
_SIZED = {
    "Float": {4: "float", 8: "double", 16: "long double", 0: "float"},
    "Int": {1: "__int8", 2: "__int16", 4: "__int32", 8: "__int64", 0: "int"},
    "UInt": {1: "unsigned __int8", 2: "unsigned __int16", 4: "unsigned __int32", 8: "unsigned __int64", 0: "unsigned int"},
}
_STOPS = (60, 100, 166, 276, 460, 766)

#: The catalog of the adapter, as common table expressions.
_CATALOG = """
r AS (SELECT CAST(r_regionkey AS BIGINT) AS r, r_name FROM region),
n AS (SELECT CAST(n_nationkey AS BIGINT) AS n, r.r, r_name, r_name || '::' || n_name AS scope FROM nation JOIN r ON r.r = n_regionkey),
s AS (SELECT CAST(s_suppkey AS BIGINT) AS s, s_name, n.n, scope FROM supplier JOIN n ON n.n = s_nationkey),
u AS (SELECT CAST(c_custkey AS BIGINT) AS c, c_name, n.n, scope FROM customer JOIN n ON n.n = c_nationkey),
p AS (SELECT CAST(p_partkey AS BIGINT) AS p, p_brand, CAST(p_size AS BIGINT) AS z FROM part),
v AS (SELECT DISTINCT CAST(conv_id AS BIGINT) AS v FROM conversations),
k AS (SELECT * FROM (VALUES (0), (1), (2), (3), (4), (5)) x(k)),
udt AS (
  SELECT 1000000000 + r AS sym_id, r_name AS name, CAST(0 AS BIGINT) AS parent_id, r AS ordinal, r % 3 AS kind, 8 * (r + 1) AS length, r = 4 AS const_type FROM r
  UNION ALL SELECT 2000000000 + n, scope, 1000000000 + r, n, n % 3, CASE WHEN n % 4 <> 0 THEN 16 * n END, NULL FROM n),
en AS (SELECT 9000000000 + n AS sym_id, scope || '::Kind' AS name, 2000000000 + n AS parent_id, 1000 + n AS ordinal FROM n),
val AS (SELECT 10000000000 + n * 10 + k AS sym_id, 'v' || k AS name, 9000000000 + n AS parent_id, k AS ordinal, ['I4', 'I2', 'I1', 'UI4', 'UI1', 'I8'][k + 1] AS vt, n - 12 + k AS i64 FROM n, k),
td AS (SELECT 11000000000 + n AS sym_id, scope || '::Alias' AS name, 2000000000 + n AS parent_id, 2000 + n AS ordinal, 5000000000 + n + 1 AS type_id FROM n),
fr AS (SELECT 12000000000 + n AS sym_id, 2000000000 + n AS parent_id, 3000 + n AS ordinal, 2000000000 + (n + 1) % 25 AS type_id FROM n),
bc AS (SELECT 13000000000 + n AS sym_id, r_name AS name, 2000000000 + n AS parent_id, 0 AS ordinal, ['private', 'protected', 'public'][n % 3 + 1] AS access FROM n
  UNION ALL SELECT 13000000100 + n, scope, 2000000000 + n, 1, NULL FROM n WHERE n % 2 = 0),
fn AS (SELECT 3000000000 + s AS sym_id, scope || '::' || s_name AS name, 2000000000 + n AS parent_id, s AS ordinal, 6000000000 + s AS type_id, CASE WHEN s % 10 <> 9 THEN s % 2 = 0 END AS is_virtual,
  s % 7 = 0 AS is_static, s % 5 = 0 AS const_type, CASE WHEN s % 2 = 0 THEN s % 64 * 4 END AS slot, s % 4 AS addr_section, 3 * (4 * s + s % 4) + s % 3 AS addr_offset FROM s),
ft AS (SELECT 6000000000 + s AS sym_id, 5000000000 + s % 200 + 1 AS type_id, s FROM s),
arg AS (SELECT 7000000000 + s * 4 + k AS sym_id, 6000000000 + s AS parent_id, k AS ordinal, 5000000000 + (s * 7 + k * 13) % 200 + 1 AS type_id FROM s JOIN k ON k < s % 4),
par AS (SELECT 8000000000 + s * 4 + k AS sym_id, 'a' || k AS name, 3000000000 + s AS parent_id, k AS ordinal, 5000000000 + (s * 7 + k * 13) % 200 + 1 AS type_id FROM s JOIN k ON k < s % 3),
da AS (SELECT 4000000000 + c AS sym_id, scope || '::' || c_name AS name, 2000000000 + n AS parent_id, c AS ordinal, ['Member', 'Member', 'Member', 'StaticMember', 'Constant'][c % 5 + 1] AS data_kind,
  c % 100 * 8 AS off, 5000000000 + c % 200 + 1 AS type_id, CASE WHEN c % 11 = 0 THEN c % 32 END AS bit, CASE WHEN c % 11 = 0 THEN c % 7 END AS length FROM u),
pt AS (SELECT 5000000000 + p AS sym_id, ['Pointer', 'Array', 'Typedef', 'BaseType'][z % 4 + 1] AS sym_tag, CASE WHEN z % 4 = 2 THEN p_brand END AS name, CASE WHEN z % 4 <> 3 AND p > 1 THEN 5000000000 + p // 2 END AS type_id,
  CASE WHEN z % 4 = 3 THEN ['Int', 'UInt', 'Char', 'Bool', 'Float', 'Void', 'WChar', 'BCD'][p % 8 + 1] END AS base_type, CASE WHEN z % 4 = 3 THEN [1, 2, 4, 8, 16][p % 5 + 1] END AS length,
  CASE WHEN z % 4 = 1 THEN z END AS array_count, z % 8 = 4 AS is_reference, p % 6 = 0 AS const_type, p % 9 = 0 AS volatile_type FROM p),
cm AS (SELECT 14000000000 + v AS sym_id, CASE WHEN v % 10 <> 3 THEN 'obj' || v || '.obj' END AS name, v AS ordinal FROM v),
cd AS (SELECT 15000000000 + v AS sym_id, 14000000000 + v AS parent_id, v % 9 AS platform, v % 5 AS language, 'cc' || (v % 3) AS compiler, v % 2 = 0 AS debug FROM v),
ce AS (SELECT 16000000000 + conv_id * 1000 + turn AS sym_id, role AS name, 14000000000 + conv_id AS parent_id, turn AS ordinal, CASE WHEN turn % 3 = 1 THEN NULL ELSE text END AS said FROM conversations),
ln AS (SELECT CAST(o_orderkey AS BIGINT) AS o, CAST(o_orderkey AS BIGINT) % 4 AS section, CAST(o_orderkey AS BIGINT) * 3 AS low, CAST(o_orderkey AS BIGINT) * 3 + 3 AS high, CAST(o_orderkey AS BIGINT) % 211 AS file_id FROM orders),
sf AS (SELECT doc_id AS file_id, source || '/' || lang || '/' || doc_id || '.cpp' AS file_name FROM documents),
symbols AS (
  SELECT sym_id, 'UDT' AS sym_tag, name, parent_id, ordinal, CAST(NULL AS BIGINT) AS type_id FROM udt
  UNION ALL SELECT sym_id, 'BaseClass', name, parent_id, ordinal, NULL FROM bc UNION ALL SELECT sym_id, 'Enum', name, parent_id, ordinal, NULL FROM en UNION ALL SELECT sym_id, 'Data', name, parent_id, ordinal, NULL FROM val
  UNION ALL SELECT sym_id, 'Typedef', name, parent_id, ordinal, type_id FROM td UNION ALL SELECT sym_id, 'Friend', NULL, parent_id, ordinal, type_id FROM fr UNION ALL SELECT sym_id, 'Function', name, parent_id, ordinal, type_id FROM fn
  UNION ALL SELECT sym_id, 'FunctionType', NULL, NULL, NULL, type_id FROM ft UNION ALL SELECT sym_id, 'FunctionArgType', NULL, parent_id, ordinal, type_id FROM arg UNION ALL SELECT sym_id, 'Data', name, parent_id, ordinal, type_id FROM par
  UNION ALL SELECT sym_id, 'Data', name, parent_id, ordinal, type_id FROM da UNION ALL SELECT sym_id, sym_tag, name, NULL, NULL, type_id FROM pt UNION ALL SELECT sym_id, 'Compiland', name, 0, ordinal, NULL FROM cm
  UNION ALL SELECT sym_id, 'CompilandDetails', NULL, parent_id, 0, NULL FROM cd UNION ALL SELECT sym_id, 'CompilandEnv', name, parent_id, ordinal, NULL FROM ce)"""

_MEMBERS = """
mem AS (
  SELECT parent_id, sym_id, 1 AS section, NULL AS key, ordinal FROM fr UNION ALL SELECT parent_id, sym_id, 2, NULL, ordinal FROM en UNION ALL SELECT parent_id, sym_id, 3, NULL, ordinal FROM td
  UNION ALL SELECT parent_id, sym_id, 4, NULL, ordinal FROM udt WHERE parent_id <> 0 UNION ALL SELECT parent_id, sym_id, 5, slot, ordinal FROM fn WHERE is_virtual
  UNION ALL SELECT parent_id, sym_id, 6, off, ordinal FROM da WHERE data_kind = 'Member' UNION ALL SELECT parent_id, sym_id, 7, NULL, ordinal FROM fn WHERE NOT is_virtual
  UNION ALL SELECT parent_id, sym_id, 8, NULL, ordinal FROM da WHERE data_kind <> 'Member'),
num AS (SELECT *, row_number() OVER (PARTITION BY parent_id, section ORDER BY key NULLS FIRST, ordinal, sym_id) AS position FROM mem)"""


def _case(key: str, table: dict) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def _base(base: str, length: str) -> str:
    sized = " ".join(f"WHEN {base} = '{kind}' THEN CASE {length} " + " ".join(f"WHEN {n} THEN '{t}'" for n, t in names.items() if n) + f" ELSE '{names[0]}' END" for kind, names in _SIZED.items())
    return f"CASE {sized} ELSE {_case(base, _NAMES)} END"


def _last(text: str, sep: str) -> str:
    return f"split_part({text}, {sep}, -1)"


def _scoped(name: str, around: str) -> str:
    return f"CASE WHEN coalesce({around}, '') <> '' AND NOT contains({name}, '<') THEN {_last(name, around + chr(124) * 2 + repr('::'))} ELSE coalesce({name}, '') END"


def _pad(line: str) -> str:
    """line, filled with spaces up to the next stop of the comment column."""
    cases = " ".join(f"WHEN length({line}) + {k} < {stop} THEN {stop}" for k, stop in enumerate(_STOPS))
    return f"({line} || repeat(' ', CAST(CASE {cases} ELSE length({line}) END - length({line}) AS INT)))"


_HEX = "printf('0x%X', CAST({} AS BIGINT) & 4294967295)"

#: Chains of the part graph, and the text of each part (and of a declared name in front of it) by the closed form.
_TEXT = f"""
chain(root, depth, cur) AS (SELECT sym_id, 0, sym_id FROM pt UNION ALL SELECT root, depth + 1, type_id FROM chain JOIN pt ON cur = sym_id WHERE type_id IS NOT NULL),
piece AS (SELECT root, depth, sym_tag AS tag, coalesce(volatile_type AND sym_tag NOT IN ('Pointer', 'Array'), FALSE) AS vol, coalesce(const_type AND sym_tag NOT IN ('Pointer', 'Array'), FALSE) AS con, coalesce(const_type AND sym_tag IN ('Pointer', 'Array'), FALSE) AS cp,
  CASE sym_tag WHEN 'BaseType' THEN coalesce({_base('base_type', 'length')}, '') WHEN 'Typedef' THEN coalesce(name, '') ELSE '' END AS type,
  CASE WHEN sym_tag = 'Pointer' THEN CASE WHEN is_reference THEN '&' ELSE '*' END ELSE '' END AS ptr, CASE WHEN sym_tag = 'Array' THEN coalesce('[' || array_count || ']', '') ELSE '' END AS arr
  FROM chain JOIN pt ON cur = sym_id),
comp AS (SELECT root, bool_or(vol) AS vol, bool_or(con) AS con, bool_or(cp) AS cp, coalesce(min(CASE WHEN tag = 'Pointer' THEN depth END) < max(CASE WHEN tag = 'Array' THEN depth END), FALSE) AS br,
  coalesce(string_agg(type, ' ' ORDER BY depth) FILTER (type <> ''), '') AS type, string_agg(ptr, '' ORDER BY depth) AS ptr, string_agg(arr, '' ORDER BY depth) AS arr FROM piece GROUP BY root)"""


def _render(name: str, bit: str = "''") -> str:
    """Text of a composed part with a name (or none) in front, as one expression."""
    head = "concat_ws(' ', CASE WHEN vol THEN 'volatile' END, CASE WHEN con THEN 'const' END, nullif(type, ''))"
    open_ = f"CASE WHEN br THEN CASE WHEN {head} <> '' THEN ' ' ELSE '' END || '(' ELSE '' END"
    # After the pointer a space may follow: without brackets if anything stood before, with brackets never.
    tail = f"CASE WHEN cp THEN CASE WHEN NOT br AND ({head} <> '' OR ptr <> '') THEN ' ' ELSE '' END || 'const' ELSE '' END"
    named = f"CASE WHEN {name} <> '' THEN CASE WHEN cp OR (NOT br AND ({head} <> '' OR ptr <> '')) THEN ' ' ELSE '' END || {name} ELSE '' END"
    return f"({head} || {open_} || ptr || {tail} || {named} || CASE WHEN br THEN ')' ELSE '' END || arr || {bit})"


def _sql(body: str, *more: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{','.join([_CATALOG, *more])}\n{body}"


_VARIANT = "CASE vt WHEN 'I8' THEN '' WHEN 'I1' THEN ' = ' || (i64 & 255) ELSE ' = ' || i64 END"
_KEYWORD = _case("['Class', 'Struct', 'Union'][kind + 1]", {"Class": "class", "Struct": "struct", "Union": "union"})
_BIT = "CASE WHEN bit IS NOT NULL AND length > 0 THEN ' : ' || length || '; // ' || " + _HEX.format("bit") + " ELSE '' END"
_FUNCTION = f"""
params AS (SELECT parent_id, string_agg({_render('name')}, ', ' ORDER BY ordinal, sym_id) AS named, count(*) AS n FROM par JOIN comp ON root = type_id GROUP BY parent_id),
args AS (SELECT parent_id, string_agg({_render("''")}, ', ' ORDER BY ordinal, sym_id) AS declared, count(*) AS m FROM arg JOIN comp ON root = type_id GROUP BY parent_id),
ftext AS (SELECT fn.sym_id, fn.parent_id, fn.name, CASE WHEN is_virtual THEN 'virtual ' ELSE '' END || CASE WHEN is_static THEN 'static ' ELSE '' END || coalesce({_render("''")} || ' ', '') AS before,
  '(' || coalesce(named, '') || CASE WHEN coalesce(n, 0) <> coalesce(m, 0) THEN CASE WHEN coalesce(n, 0) > 0 THEN ' <- ' ELSE '' END || coalesce(declared, '') ELSE '' END || ')' || CASE WHEN const_type THEN ' const' ELSE '' END || ';' AS after
  FROM fn JOIN ft ON ft.sym_id = fn.type_id LEFT JOIN comp ON root = ft.type_id LEFT JOIN params ON params.parent_id = fn.sym_id LEFT JOIN args ON args.parent_id = ft.sym_id)"""
_SOURCES = "src AS (SELECT sym_id, arg_min(file_name, o) AS file_name FROM (SELECT fn.sym_id, ln.o, ln.file_id FROM fn JOIN ln ON ln.section = addr_section AND low <= addr_offset AND addr_offset < high QUALIFY row_number() OVER (PARTITION BY fn.sym_id ORDER BY o) = 1) JOIN sf USING (file_id) GROUP BY sym_id)"
_HEADS = "sec AS (SELECT parent_id, section, ['FRIENDS', 'ENUMS', 'TYPEDEFS', 'CLASSES', 'VIRTUALS', 'FIELDS', 'FUNCS', 'OTHER MEMBERS'][section] AS header, section > min(section) OVER (PARTITION BY parent_id) AS blank_before FROM (SELECT DISTINCT parent_id, section FROM mem))"

#: A typedef being defined: its own name comes last, and so do those of the typedefs below it.
_TYPEDEF = f"""
tcomp AS (SELECT td.sym_id, td.name, td.parent_id, bool_or(vol) AS vol, bool_or(con) AS con, bool_or(cp) AS cp, coalesce(min(CASE WHEN tag = 'Pointer' THEN depth END) < max(CASE WHEN tag = 'Array' THEN depth END), FALSE) AS br,
  coalesce(string_agg(type, ' ' ORDER BY depth) FILTER (type <> '' AND tag <> 'Typedef'), '') AS type, string_agg(ptr, '' ORDER BY depth) AS ptr, string_agg(arr, '' ORDER BY depth) AS arr,
  coalesce(string_agg(type, ' ' ORDER BY depth) FILTER (type <> '' AND tag = 'Typedef'), '') AS others FROM td JOIN piece ON root = td.type_id GROUP BY ALL),
ttext AS (SELECT sym_id, parent_id, name, {_render("''")} || CASE WHEN concat_ws('', type, ptr, arr) <> '' OR vol OR con OR cp OR br THEN ' ' ELSE '' END AS before, CASE WHEN others <> '' THEN ' ' || others ELSE '' END AS after FROM tcomp)"""

#: The same for all typedefs: a part stands as its own type, so its name is the first of those at the end.
_TYPEDEFS = _TYPEDEF.replace("FROM td JOIN piece", "FROM (SELECT sym_id, name, parent_id, type_id FROM td UNION ALL SELECT sym_id, '', NULL, sym_id FROM pt WHERE sym_tag = 'Typedef') td JOIN piece")

#: Everything below the nations, with the composed type of each: what its own piece adds to the chain below it.
_DUMP = f"""
empty AS (SELECT FALSE AS vol, FALSE AS con, FALSE AS cp, FALSE AS br, '' AS type, '' AS ptr, '' AS arr),
shown AS (
  SELECT da.sym_id, 'Data' AS sym_tag, comp.* EXCLUDE (root), da.name AS nm, {_BIT} AS bits FROM da JOIN comp ON root = da.type_id
  UNION ALL SELECT par.sym_id, 'Data', comp.* EXCLUDE (root), par.name, '' FROM par JOIN comp ON root = par.type_id
  UNION ALL SELECT val.sym_id, 'Data', empty.*, val.name, '' FROM val, empty
  UNION ALL SELECT sym_id, 'Enum', FALSE, FALSE, FALSE, FALSE, name, '', '', '', '' FROM en
  UNION ALL SELECT sym_id, 'Typedef', vol, con, cp, br, concat_ws(' ', name, nullif(type, '')), ptr, arr, '', '' FROM td JOIN comp ON root = type_id
  UNION ALL SELECT fr.sym_id, 'Friend', FALSE, FALSE, FALSE, FALSE, udt.name, '', '', '', '' FROM fr JOIN udt ON udt.sym_id = fr.type_id
  UNION ALL SELECT sym_id, 'BaseClass', empty.*, '', '' FROM bc, empty
  UNION ALL SELECT fn.sym_id, 'Function', vol, con OR fn.const_type, cp, br OR coalesce(declared, '') <> '', type, ptr, CASE WHEN coalesce(declared, '') <> '' THEN '(' || declared || ')' ELSE '' END || arr, '', ''
    FROM fn JOIN ft ON ft.sym_id = fn.type_id JOIN comp ON root = ft.type_id LEFT JOIN args ON args.parent_id = ft.sym_id),
tree(root_id, sym_id, depth, path) AS (SELECT sym_id, sym_id, 0, CAST([] AS BIGINT[]) FROM udt WHERE parent_id <> 0
  UNION ALL SELECT root_id, symbols.sym_id, depth + 1, path || [symbols.ordinal, symbols.sym_id] FROM tree JOIN symbols ON symbols.parent_id = tree.sym_id)"""

# Lines of a class: (class, order within it, text), with the level of the class.
_FIELD = _pad("(repeat('    ', 2) || body || '; ')")
_CLASS_LINES = f"""
lines AS (
  SELECT root, path, text FROM (
    SELECT sym_id AS root, [0] AS path, '// size: ' || length || ' byte' AS text FROM udt WHERE parent_id = 0
    UNION ALL SELECT sym_id, [1], CASE WHEN const_type THEN 'const' ELSE '' END || {_KEYWORD} || ' ' || CASE WHEN const_type THEN 'const ' ELSE '' END || name FROM udt WHERE parent_id = 0
    UNION ALL SELECT sym_id, [2], '{{' FROM udt WHERE parent_id = 0 UNION ALL SELECT sym_id, [4], '}};' FROM udt WHERE parent_id = 0
    UNION ALL SELECT DISTINCT parent_id, [3, 4, 0, 1], '    /// CLASSES:' FROM udt WHERE parent_id <> 0
    UNION ALL SELECT d.parent_id, [3, 4, 1, d.ordinal] || x.path, x.text FROM udt d JOIN (
      SELECT sym_id AS class, [0] AS path, '    // size: ' || length || ' byte' AS text FROM udt WHERE length IS NOT NULL
      UNION ALL SELECT udt.sym_id, [1], CASE WHEN length IS NULL THEN '    ' ELSE '' END || '    ' || {_KEYWORD} || ' ' || udt.name || coalesce(b.t, '') FROM udt LEFT JOIN (SELECT bc.parent_id, ' : ' || string_agg(coalesce(access || ' ', '') || {_scoped('bc.name', "own")}, ', ' ORDER BY bc.ordinal, bc.sym_id) AS t FROM bc JOIN own ON own.sym_id = bc.parent_id GROUP BY bc.parent_id) b ON b.parent_id = udt.sym_id
      UNION ALL SELECT sym_id, [2], '    {{' FROM udt UNION ALL SELECT sym_id, [4], '    }};' FROM udt
      UNION ALL SELECT parent_id, [3, section, 0, 1], '        /// ' || header || ':' FROM sec UNION ALL SELECT parent_id, [3, section, 0, 0], '' FROM sec WHERE blank_before
      UNION ALL SELECT fr.parent_id, [3, 1, 1, fr.ordinal], '        friend ' || {_scoped('udt.name', 'own')} || ';' FROM fr JOIN udt ON udt.sym_id = fr.type_id JOIN own ON own.sym_id = fr.parent_id
      UNION ALL SELECT parent_id, [3, 2, 1, ordinal, 0], '        // size: 4 byte' FROM en UNION ALL SELECT parent_id, [3, 2, 1, ordinal, 1], '        enum ' || name || ' : __int32' FROM en
      UNION ALL SELECT parent_id, [3, 2, 1, ordinal, 2], '        {{' FROM en UNION ALL SELECT parent_id, [3, 2, 1, ordinal, 4], '        }};' FROM en
      UNION ALL SELECT en.parent_id, [3, 2, 1, en.ordinal, 3, val.ordinal], '            ' || val.name || {_VARIANT} || ',' FROM en JOIN val ON val.parent_id = en.sym_id
      UNION ALL SELECT ttext.parent_id, [3, 3, 1, ttext.sym_id], '        typedef ' || before || {_scoped('ttext.name', 'own')} || after || ';' FROM ttext JOIN own ON own.sym_id = ttext.parent_id
      UNION ALL SELECT num.parent_id, [3, section, 1, position], '        ' || before || {_scoped('ftext.name', 'own')} || after || CASE WHEN section = 5 THEN coalesce(' // ' || {_HEX.format('key')}, '') ELSE '' END FROM num JOIN ftext ON ftext.sym_id = num.sym_id JOIN own ON own.sym_id = num.parent_id
      UNION ALL SELECT parent_id, [3, section, 1, position], CASE WHEN section = 6 THEN {_FIELD} || '// ' || {_HEX.format('key')} ELSE repeat('    ', 2) || CASE data_kind WHEN 'StaticMember' THEN 'static ' ELSE 'constexpr ' END || body || ';' END FROM body
      UNION ALL SELECT num.parent_id, [5, section, num.ordinal], '// ' || file_name FROM num JOIN src USING (sym_id) WHERE section IN (5, 7)
    ) x ON x.class = d.sym_id WHERE d.parent_id <> 0))"""
_OWN = f"own AS (SELECT c.sym_id, {_scoped('c.name', 'p.name')} AS own FROM udt c LEFT JOIN udt p ON p.sym_id = c.parent_id)"
_BODY = f"body AS (SELECT num.parent_id, section, position, key, data_kind, {_render(_scoped('da.name', 'own'), _BIT)} AS body FROM num JOIN da ON da.sym_id = num.sym_id JOIN comp ON root = da.type_id JOIN own ON own.sym_id = num.parent_id)"

_SETTINGS = [("GlobalSettings::" + n, k, d) for n, k, d in (
    ("s_isSizeInfo", "Bool", 1), ("s_isOffsetInfo", "Bool", 1), ("s_isCurlyBracketTransfer", "Bool", 1), ("s_isEnumInheritence", "Bool", 1), ("s_isCaseSensitiveSearch", "Bool", 0), ("s_isShowAccess", "Bool", 1),
    ("s_isNonScoped", "Bool", 1), ("s_isEnumHex", "Bool", 0), ("s_typeSource", "Bool", 1), ("s_infoComment", "Bool", 1), ("s_isTabulation", "Bool", 1), ("s_baseAccessType", "UInt32", 0),
)]
_KNOWN = "known(i, name, type_id, value) AS (VALUES " + ", ".join(f"({i}, '{n}', '{k}', CAST({d} AS BIGINT))" for i, (n, k, d) in enumerate(_SETTINGS)) + ")"
_STORED = "stored AS (SELECT i, name, type_id, CASE type_id WHEN 'Bool' THEN 0 ELSE 2 END AS value FROM known WHERE name NOT LIKE '%s\\_is%' ESCAPE '\\')"
#: CRC-32 bit by bit: the state after each character of an ASCII name.
_CRC = """crc(name, pos, bit, c) AS (SELECT name, 0, 8, CAST(4294967295 AS BIGINT) FROM known
  UNION ALL SELECT name, CASE WHEN bit = 8 THEN pos + 1 ELSE pos END, CASE WHEN bit = 8 THEN 0 ELSE bit + 1 END, CASE WHEN bit = 8 THEN xor(c, CAST(ascii(substr(name, pos + 1, 1)) AS BIGINT)) ELSE CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END END
  FROM crc WHERE pos < length(name) OR bit < 8),
hashed AS (SELECT name, xor(c, CAST(4294967295 AS BIGINT)) AS hash FROM crc WHERE pos = length(name) AND bit = 8)"""

ORACLES: dict[str, str] = {
    "symbols_catalog": _sql("SELECT sym_id, sym_tag, name, parent_id, ordinal, type_id FROM symbols"),
    "catalog_problems": _sql("""SELECT 'parent_id refers to no symbol' AS problem, count(*) AS n FROM symbols WHERE parent_id <> 0 AND parent_id NOT IN (SELECT sym_id FROM symbols) HAVING count(*) > 0
      UNION ALL SELECT 'type_id refers to no symbol', count(*) FROM symbols WHERE type_id IS NOT NULL AND type_id NOT IN (SELECT sym_id FROM symbols) HAVING count(*) > 0
      UNION ALL SELECT 'sym_id is not unique', count(*) FROM (SELECT sym_id FROM symbols GROUP BY 1 HAVING count(*) > 1) HAVING count(*) > 0"""),
    "find_exact_ci": _sql("SELECT sym_id, name FROM symbols WHERE parent_id = 0 AND lower(name) = 'asia'"),
    "find_exact_cs": _sql("SELECT sym_id, name FROM symbols WHERE parent_id = 0 AND name = 'ASIA'"),
    "find_namespace_children": _sql("SELECT sym_id, name FROM udt WHERE starts_with(name, 'EUROPE::') AND NOT contains(substr(name, 9), '::')"),
    "find_with_fallback": _sql("""SELECT sym_id, name FROM udt WHERE starts_with(name, 'AFRICA::') AND NOT contains(substr(name, 9), '::') AND NOT EXISTS (SELECT 1 FROM udt WHERE name <> 'AFRICA' AND lower(name) = 'africa')
      UNION ALL SELECT sym_id, name FROM udt WHERE lower(name) = 'asia'"""),
    "any_match": _sql("SELECT count(*) > 0 AS found FROM symbols WHERE parent_id = 0 AND lower(name) = 'asia' UNION ALL SELECT count(*) > 0 FROM symbols WHERE parent_id = 0 AND lower(name) = 'nowhere'"),
    "first_class_by_name": _sql("SELECT sym_id, name FROM udt WHERE parent_id = 0 AND lower(name) = 'europe' ORDER BY ordinal LIMIT 1"),
    "dispatch_by_tag": _sql("SELECT lower(sym_tag) AS renderer, count(*) AS n FROM symbols WHERE sym_tag IN ('Typedef', 'UDT', 'Enum', 'Data', 'Function') GROUP BY 1"),
    "children_count": _sql("SELECT ft.sym_id, count(arg.sym_id) AS n_children FROM ft LEFT JOIN arg ON arg.parent_id = ft.sym_id GROUP BY 1"),
    "class_members_sections": _sql("SELECT parent_id, section, position, sym_id, position = 1 AS is_first, header, blank_before FROM num JOIN sec USING (parent_id, section)", _MEMBERS, _HEADS),
    "fields_by_offset": _sql(f"""SELECT parent_id, sym_id, position, {_pad("('    ' || " + _last('name', "'::'") + " || '; ')")} || '// ' || {_HEX.format('key')} AS text FROM num JOIN da USING (parent_id, sym_id) WHERE section = 6""", _MEMBERS),
    "virtuals_by_slot": _sql(f"SELECT parent_id, sym_id, position, coalesce(' // ' || {_HEX.format('key')}, '') AS suffix FROM num WHERE section = 5", _MEMBERS),
    "function_args": _sql("SELECT sym_id, before || name || after AS text FROM ftext", _TEXT, _FUNCTION, recursive=True),
    "argument_lists": _sql("SELECT parent_id AS sym_id, declared AS args, m AS n_args FROM args", _TEXT, _FUNCTION, recursive=True),
    "base_class_list": _sql("SELECT parent_id AS sym_id, ' : ' || string_agg(coalesce(access || ' ', '') || name, ', ' ORDER BY ordinal, sym_id) AS bases FROM bc GROUP BY 1"),
    "type_chain_text": _sql(f"SELECT root AS sym_id, {_render(repr(''))} AS text FROM comp", _TEXT, recursive=True),
    "base_type_names": _sql(f"""SELECT sym_id, {_base('base_type', 'length')} AS base, CAST(NULL AS VARCHAR) AS udt, CASE sym_tag WHEN 'Typedef' THEN 'typedef' ELSE {_base('base_type', 'length')} END AS keyword FROM pt WHERE sym_tag IN ('BaseType', 'Typedef')
      UNION ALL SELECT sym_id, NULL, {_KEYWORD}, {_KEYWORD} FROM udt UNION ALL SELECT sym_id, '__int32', NULL, 'enum' FROM en UNION ALL SELECT sym_id, NULL, NULL, 'typedef' FROM td UNION ALL SELECT sym_id, NULL, NULL, 'friend' FROM fr UNION ALL SELECT sym_id, NULL, NULL, NULL FROM fn"""),
    "qualifier_text": _sql("""SELECT sym_id, CASE WHEN c THEN 'const' END AS c, CASE WHEN v THEN 'volatile' END AS v, CASE WHEN vi THEN 'virtual' END AS virt, CASE WHEN re THEN '&' END AS ref, CASE WHEN st THEN 'static' END AS stat, concat_ws(' ', CASE WHEN c THEN 'const' END, CASE WHEN v THEN 'volatile' END) AS mods FROM (
      SELECT sym_id, const_type AS c, volatile_type AS v, NULL AS vi, is_reference AS re, NULL AS st FROM pt UNION ALL SELECT sym_id, const_type, NULL, NULL, NULL, NULL FROM udt UNION ALL SELECT sym_id, const_type, NULL, is_virtual, NULL, is_static FROM fn UNION ALL SELECT sym_id, NULL, NULL, NULL, NULL, NULL FROM da)"""),
    "scope_strip": _sql(f"SELECT s.sym_id, {_last('s.name', repr('::'))} AS last, {_scoped('s.name', 'p.name')} AS scoped FROM symbols s LEFT JOIN symbols p ON p.sym_id = s.parent_id WHERE s.name IS NOT NULL"),
    "enum_values": _sql(f"SELECT sym_id, name || {_VARIANT} || ',' AS text FROM val"),
    "enum_values_hex": _sql("SELECT sym_id, name || ' = ' || printf('%X', i64 & 4294967295) || ',' AS text FROM val"),
    "bit_fields": _sql(f"SELECT sym_id, {_BIT} AS text FROM da UNION ALL SELECT sym_id, '' FROM par UNION ALL SELECT sym_id, '' FROM val"),
    "array_text": _sql("SELECT sym_id, coalesce('[' || array_count || ']', '') AS a, CASE WHEN is_reference THEN '&' ELSE '*' END AS p FROM pt WHERE sym_tag IN ('Array', 'Pointer')"),
    "size_text": _sql("SELECT sym_id, '// size: ' || length || ' byte' AS text FROM udt"),
    "nested_tree": _sql("SELECT root_id, depth, count(*) AS n, max(sym_id) AS last FROM tree GROUP BY 1, 2", "tree(root_id, sym_id, depth) AS (SELECT 1000000000 + r, 1000000000 + r, 0 FROM r UNION ALL SELECT root_id, symbols.sym_id, depth + 1 FROM tree JOIN symbols ON symbols.parent_id = tree.sym_id)", recursive=True),
    "parent_names": _sql("SELECT fn.sym_id, udt.name AS parent_name, 'FunctionType' AS type_tag FROM fn JOIN udt ON udt.sym_id = fn.parent_id"),
    "line_lookup": _sql("SELECT sym_id, file_id, o AS line FROM fn JOIN ln ON ln.section = addr_section AND low <= addr_offset AND addr_offset < high QUALIFY row_number() OVER (PARTITION BY sym_id ORDER BY o) = 1"),
    "type_sources": _sql("SELECT sym_id, file_name FROM src", _SOURCES),
    "source_files": _sql("SELECT file_id, file_id AS ordinal, file_name AS text FROM sf"),
    "compilands_short": _sql("SELECT sym_id, ordinal, name AS text FROM cm WHERE name IS NOT NULL"),
    "compilands_full": _sql("""SELECT sym_id AS compiland_id, ordinal, 0 AS section, CAST(0 AS BIGINT) AS position, '[OBJ] ' || coalesce(name, '') AS text FROM cm
      UNION ALL SELECT cm.sym_id, cm.ordinal, 1, 0, '[ABOUT] Compiler: ' || compiler || '; Language: ' || language || '; Platform: ' || platform || '; Debug: ' || CASE WHEN debug THEN 'true' ELSE 'false' END FROM cm JOIN cd ON cd.parent_id = cm.sym_id
      UNION ALL SELECT cm.sym_id, cm.ordinal, 2, ce.ordinal, '[ENV] ' || coalesce(ce.name, '') || coalesce(' = ' || said, '') FROM cm JOIN ce ON ce.parent_id = cm.sym_id"""),
    "class_lines": _sql("SELECT root AS root_id, row_number() OVER (PARTITION BY root ORDER BY path) AS line_no, text FROM lines", _MEMBERS, _HEADS, _TEXT, _FUNCTION, _TYPEDEF, _SOURCES, _OWN, _BODY, _CLASS_LINES, recursive=True),
    "enum_lines": _sql(f"""SELECT root_id, row_number() OVER (PARTITION BY root_id ORDER BY path) AS line_no, text FROM (
      SELECT sym_id AS root_id, [0] AS path, '// size: 4 byte' AS text FROM en UNION ALL SELECT sym_id, [1], 'enum ' || name || ' : __int32' FROM en UNION ALL SELECT sym_id, [2], '{{' FROM en UNION ALL SELECT sym_id, [4], '}};' FROM en UNION ALL SELECT parent_id, [3, ordinal], '    ' || name || {_VARIANT} || ',' FROM val)"""),
    "typedef_lines": _sql("""SELECT sym_id AS root_id, CAST(1 AS BIGINT) AS line_no, concat_ws(' ', CASE WHEN c THEN 'const' END, CASE WHEN v THEN 'volatile' END) || 'typedef ' || concat_ws(' ', nullif(trim(before), ''), nullif(name, ''), nullif(trim(after), '')) || ';' AS text
      FROM ttext JOIN (SELECT sym_id, NULL AS c, NULL AS v FROM td UNION ALL SELECT sym_id, const_type, volatile_type FROM pt) USING (sym_id)""", _TEXT, _TYPEDEFS, recursive=True),
    "type_dump": _sql(f"""SELECT root_id, row_number() OVER (PARTITION BY root_id ORDER BY path) AS line_no, depth, sym_tag, {_render('nm', 'bits')} AS text FROM tree JOIN shown USING (sym_id)""", _TEXT, _FUNCTION, _DUMP, recursive=True),
    "children_scan": _sql("SELECT sym_id, parent_id, ordinal FROM udt WHERE parent_id = 1000000000 OR (parent_id = 0 AND name = 'ASIA') UNION ALL SELECT sym_id, parent_id, ordinal FROM symbols WHERE parent_id = 2000000000"),
    "first_enum_by_name": _sql("SELECT sym_id, name FROM en WHERE lower(name) = 'asia::china::kind' ORDER BY ordinal LIMIT 1"),
    "first_typedef_by_name": _sql("SELECT sym_id, name FROM td WHERE name = 'ASIA::INDIA::Alias' ORDER BY ordinal LIMIT 1"),
    "scoped_symbols": _sql("SELECT sym_tag = 'UDT' AS scoped, count(*) AS n FROM symbols GROUP BY 1"),
    "function_flags": _sql("SELECT sym_id, CASE WHEN ordinal % 3 = 0 THEN 'inline' END AS inl_spec_text, CASE WHEN ordinal % 11 = 0 THEN 'naked' END AS is_naked_text, CASE WHEN ordinal % 13 = 0 THEN 'noreturn' END AS no_return_text, CASE WHEN ordinal % 17 = 0 THEN 'noinline' END AS no_inline_text, CASE WHEN ordinal % 19 = 0 THEN '= 0' END AS is_pure_text FROM fn"),
    "address_texts": _sql("""SELECT sym_id, printf('// RVA: 0x%X', 16 * ordinal) AS rva_text, printf('// VA: 0x%X', 5368709120 + 16 * ordinal) AS va_text, '// ' || printf('0x%X', slot) AS slot_text, CASE WHEN ordinal % 10 <> 9 THEN '// Location: ' ||
      ['None', 'Static', 'TLS', 'Register-relative (stack variable)', 'This-relative (class member)', 'Enregistered (in register)', 'Bit field', 'Constant', 'Unknown (77)'][ordinal % 9 + 1] END AS location FROM fn"""),
    "bit_field_pairs": _sql("SELECT sym_id, bit AS bit_position, length AS bit_length FROM da WHERE bit IS NOT NULL"),
    "utf16_names": _sql("SELECT sym_id, CAST(2 * length(name) AS INT) AS n_bytes, name AS back FROM symbols WHERE name IS NOT NULL"),
    "enum_lines_terse": _sql("""SELECT root_id, row_number() OVER (PARTITION BY root_id ORDER BY path) AS line_no, text FROM (
      SELECT sym_id AS root_id, [1] AS path, 'enum ' || name || ' : __int32 {' AS text FROM en UNION ALL SELECT sym_id, [4], '};' FROM en UNION ALL SELECT parent_id, [3, ordinal], '    ' || name || ' = ' || printf('%X', i64 & 4294967295) || ',' FROM val)"""),
    "base_class_list_public": _sql("SELECT parent_id AS sym_id, ' : ' || string_agg('public ' || name, ', ' ORDER BY ordinal, sym_id) AS bases FROM bc GROUP BY 1"),
    "function_pointer_texts": _sql(f"""SELECT sym_id, {_render("''")} AS text FROM (SELECT 100000000000 + ft.sym_id AS sym_id, vol, con, cp, coalesce(declared, '') <> '' OR arr <> '' OR strpos(tags, 'Array') > 0 AS br, type, '*' || ptr AS ptr, CASE WHEN coalesce(declared, '') <> '' THEN '(' || declared || ')' ELSE '' END || arr AS arr
      FROM ft JOIN comp ON root = ft.type_id JOIN (SELECT root, string_agg(tag, ' ') AS tags FROM piece GROUP BY root) t USING (root) LEFT JOIN args ON args.parent_id = ft.sym_id)""", _TEXT, _FUNCTION, recursive=True),
    "enum_pointer_texts": _sql("SELECT 200000000000 + sym_id AS sym_id, name || '* const[3]' AS text FROM en"),
    "settings_append": f"WITH {_KNOWN}, {_STORED}, more AS (SELECT type_id FROM stored UNION ALL SELECT 'Bool') SELECT (SELECT count(*) FROM more) AS n_entries, type_id, CAST(12 * count(*) AS BIGINT) AS n_bytes FROM more GROUP BY type_id",
    "settings_file": f"WITH RECURSIVE {_KNOWN}, {_STORED}, {_CRC} SELECT name, hash, type_id, CAST(value AS BIGINT) AS value FROM stored JOIN hashed USING (name)",
    "settings_get": f"WITH RECURSIVE {_KNOWN}, {_STORED}, {_CRC} SELECT k.name, hash, k.type_id, CAST(coalesce(s.value, k.value) AS BIGINT) AS value FROM known k JOIN hashed USING (name) LEFT JOIN stored s USING (name)",
    "settings_upsert": f"WITH RECURSIVE {_KNOWN}, {_STORED}, {_CRC} SELECT x.name, hash, type_id, CAST(value AS BIGINT) AS value FROM (SELECT name, type_id, value FROM stored UNION ALL SELECT 'GlobalSettings::s_isEnumHex', 'Bool', 1) x JOIN hashed USING (name)",
    "settings_hash": f"WITH RECURSIVE {_KNOWN}, {_CRC} SELECT name, hash FROM hashed",
    "settings_listing": f"WITH {_KNOWN}, {_STORED} SELECT CAST(k.i AS BIGINT) AS line_no, printf('    %-45s (value: %d, type: 0x%X)', k.name, CAST(coalesce(s.value, k.value) AS BIGINT), CASE k.type_id WHEN 'Bool' THEN 2 ELSE 7 END) AS text FROM known k LEFT JOIN stored s USING (name)",
    "int_prefix_parse": r"SELECT p_partkey, coalesce(TRY_CAST(nullif(regexp_extract(CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' -' ELSE 'x' END || p_partkey || p_name, '^\s*([+-]?\d+)', 1), '') AS BIGINT), 0) AS value FROM part",
}
