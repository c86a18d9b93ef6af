"""Scalar functions over symbol attributes, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the described types.  Where a base type's name depends on its length, 0 stands for any other length.
BASE_NAMES = {
    "Currency": "CY", "Date": "DATE", "Variant": "VARIANT", "Complex": "std::complex", "BSTR": "BSTR", "HRESULT": "HRESULT",
    "Char16": "char16_t", "Char32": "char32_t", "Char8": "char8_t", "Void": "void",
    "Bool": "bool", "Char": "char", "WChar": "wchar_t", "Long": "long", "ULong": "unsigned long",
}
SIZED_NAMES = {
    "Float": {4: "float", 8: "double", 16: "long double", 0: "float"},
    "Int": {1: "__int8", 2: "__int16", 4: "__int32", 8: "__int64", 0: "int"},
    "UInt": {1: "unsigned __int8", 2: "unsigned __int16", 4: "unsigned __int32", 8: "unsigned __int64", 0: "unsigned int"},
}
UDT_KEYWORDS = {"Struct": "struct", "Class": "class", "Union": "union"}
ACCESS_NAMES = {1: "private", 2: "protected", 3: "public"}
TAG_KEYWORDS = {"Typedef": "typedef", "Enum": "enum", "Friend": "friend", "Label": "label", "UsingNamespace": "using namespace"}
LOCATIONS = {
    "Null": "None", "Static": "Static", "TLS": "TLS", "RegRel": "Register-relative (stack variable)", "ThisRel": "This-relative (class member)",
    "Enregistered": "Enregistered (in register)", "BitField": "Bit field", "Constant": "Constant",
}
TOKENS = {
    "line_comment": "//", "doc_comment": "///", "comment_begin": "/*", "comment_end": "*/", "scope_begin": "{", "scope_end": "};",
    "args_begin": "(", "args_end": ")", "inheritance": " : ", "indent": "    ", "pointer": "*", "reference": "&",
}
PAD_STOPS = (60, 100, 166, 276, 460, 766)


def token(name: str) -> Column:
    return F.lit(TOKENS[name])


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _pick(key: Column, table: dict) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def base_type_name(base_type: Column, length: Column) -> Column:
    """Text of a base type; NULL where unknown."""
    out = _pick(base_type, BASE_NAMES)
    for kind, names in SIZED_NAMES.items():
        by_size = F.lit(names[0])
        for size, text in names.items():
            if size:
                by_size = F.when(length == size, text).otherwise(by_size)
        out = F.when(base_type == kind, by_size).otherwise(out)
    return out


def udt_keyword(udt_kind: Column) -> Column:
    return _pick(udt_kind, UDT_KEYWORDS)


def access_name(access: Column, override: int = 0) -> Column:
    """private, protected or public; a nonzero setting overrides every value."""
    if override:
        return F.lit(ACCESS_NAMES.get(override))
    return F.when(F.lower(access).isin(*ACCESS_NAMES.values()), F.lower(access))


def access_scope(access: Column, override: int = 0) -> Column:
    return F.concat(access_name(access, override), F.lit(": "))


def tag_keyword(sym_tag: Column, base_type: Column, length: Column, udt_kind: Column) -> Column:
    """The word a declaration begins with; NULL for tags without one."""
    return F.when(sym_tag == "BaseType", base_type_name(base_type, length)).when(sym_tag == "UDT", udt_keyword(udt_kind)).otherwise(_pick(sym_tag, TAG_KEYWORDS))


def keyword_text(*args: Column) -> Column:
    return or_empty(F.concat(tag_keyword(*args), F.lit(" ")))


def _flag(c: Column, text: str) -> Column:
    return F.when(c, F.lit(text))


def const_name(c: Column) -> Column:
    return _flag(c, "const")


def volatile_name(c: Column) -> Column:
    return _flag(c, "volatile")


def virtual_name(c: Column) -> Column:
    return _flag(c, "virtual")


def reference_name(c: Column) -> Column:
    return _flag(c, "&")


def static_name(c: Column) -> Column:
    return _flag(c, "static")


def inline_name(c: Column) -> Column:
    return _flag(c, "inline")


def naked_name(c: Column) -> Column:
    return _flag(c, "naked")


def noreturn_name(c: Column) -> Column:
    return _flag(c, "noreturn")


def noinline_name(c: Column) -> Column:
    return _flag(c, "noinline")


def pure_name(c: Column) -> Column:
    return _flag(c, "= 0")


def modifiers(const: Column, volatile: Column, strict: bool = True) -> Column:
    """const and volatile before a keyword.

    Strictly as the original prints: one space between the two and none behind, so that
    the keyword follows at once.  Without strict each is followed by a space.
    """
    if strict:
        return F.concat_ws(" ", const_name(const), volatile_name(volatile))
    return F.concat(or_empty(_flag(const, "const ")), or_empty(_flag(volatile, "volatile ")))


def last_part(name: Column, separator: Column) -> Column:
    """What follows the last occurrence of separator; all of name if there is none."""
    return F.when(F.length(separator) > 0, F.call_function("substring_index", name, separator, F.lit(-1))).otherwise(name)


def scoped_name(name: Column, enclosing: Column, strip: bool = True) -> Column:
    """name without the enclosing class; templates and names outside a class stay whole; NULL is empty."""
    whole = or_empty(name)
    if not strip:
        return whole
    inside = (F.length(or_empty(enclosing)) > 0) & ~F.contains(whole, F.lit("<"))
    return F.when(inside, last_part(whole, F.concat(enclosing, F.lit("::")))).otherwise(whole)


def pointer_text(is_reference: Column) -> Column:
    return F.when(is_reference, token("reference")).otherwise(token("pointer"))


def array_text(count: Column) -> Column:
    return or_empty(F.concat(F.lit("["), count.cast("string"), F.lit("]")))


def hex_text(c: Column) -> Column:
    """0x and upper-case hexadecimal of the low 32 bits."""
    return F.concat(F.lit("0x"), F.hex(c.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))))


def hex64_text(c: Column) -> Column:
    return F.concat(F.lit("0x"), F.hex(c.cast("bigint")))


def bit_field(position: Column, length: Column) -> Column:
    return F.struct(position.alias("bit_position"), length.alias("length"))


def bit_field_text(position: Column, length: Column, offsets: bool = True) -> Column:
    """' : len' and, with offsets, '; // 0xPOS'; empty without a bit position or with length 0."""
    text = F.concat(F.lit(" : "), length.cast("bigint").cast("string"))
    if offsets:
        text = F.concat(text, F.lit("; // "), hex_text(position))
    return F.when(position.isNotNull() & (length > 0), text).otherwise("")


def variant_text(value: Column, as_hex: bool = False, strict: bool = True) -> Column:
    """' = v' of an enum member.

    Strictly as the original prints: 8-byte values give nothing and I1 is an unsigned
    byte.  Without strict both print as they are.
    """
    i = value["i64"]
    if as_hex:
        return or_empty(F.concat(F.lit(" = "), F.hex(i.bitwiseAND(F.lit(0xFFFFFFFF)))))
    small = F.when(value["vt"] == "I1", i.bitwiseAND(F.lit(255)) if strict else i).when(value["vt"].isin("I4", "I2", "UI4", "UI2", "UI1"), i)
    if not strict:
        small = small.when(value["vt"].isin("I8", "UI8"), i)
    return or_empty(F.concat(F.lit(" = "), small.cast("string")))


def enum_member(name: Column, value: Column, as_hex: bool = False, strict: bool = True) -> Column:
    return F.concat(or_empty(name), variant_text(value, as_hex, strict), F.lit(","))


def size_text(length: Column) -> Column:
    return F.concat(F.lit("// size: "), length.cast("bigint").cast("string"), F.lit(" byte"))


def rva_text(rva: Column) -> Column:
    return F.concat(F.lit("// RVA: "), hex64_text(rva))


def va_text(va: Column) -> Column:
    return F.concat(F.lit("// VA: 0x"), F.upper(F.conv(va.cast("string"), 10, 16)))


def vtable_offset_text(offset: Column) -> Column:
    return F.concat(F.lit("// "), hex_text(offset))


def location_text(location: Column) -> Column:
    """'// Location: ' and what the kind means, or 'Unknown (n)'; NULL where there is no location."""
    names = F.create_map(*[F.lit(x) for pair in LOCATIONS.items() for x in pair])
    return F.when(location.isNotNull(), F.concat(F.lit("// Location: "), F.coalesce(names[location], F.concat(F.lit("Unknown ("), location, F.lit(")")))))


def base_of_enum(base_type: Column, length: Column) -> Column:
    return or_empty(F.concat(token("inheritance"), base_type_name(base_type, length)))


def indent(level: Column) -> Column:
    return F.repeat(token("indent"), F.greatest(level, F.lit(0)).cast("int"))


def pad_comment(line: Column, comment: Column, pad: bool = True) -> Column:
    """line, then comment at the first stop of 60, 100, 166, ... that the line has not reached; directly after it without pad.

    A failed stop advances the line by one column, which can cost it the next stop.
    """
    if not pad:
        return F.concat(line, comment)
    at = F.length(line)
    width = at
    for k, stop in reversed(list(enumerate(PAD_STOPS))):
        width = F.when(at + k < stop, F.lit(stop)).otherwise(width)
    return F.concat(line, F.repeat(F.lit(" "), F.greatest(width - at, F.lit(0)).cast("int")), comment)


def crc32(text: Column) -> Column:
    return F.crc32(F.encode(or_empty(text), "UTF-8"))


def utf16_to_utf8(data: Column) -> Column:
    """Text of little-endian UTF-16 bytes; NULL is empty."""
    return or_empty(F.decode(data, "UTF-16LE"))


def utf8_to_utf16(text: Column) -> Column:
    return F.encode(or_empty(text), "UTF-16LE")


def int_prefix(text: Column) -> Column:
    """The number a text begins with; 0 if it begins with none."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("bigint"), F.lit(0))
