"""The command line: python -m symlattice.cli COMMAND [ARGUMENTS] CATALOG."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import settings as S
from .operators import predicates
from .plans import compilands as C
from .plans import render
from .settings import EngineError
from .sources.catalog import Catalog, load

EXTENSION = ".pdb"
HELP, OPTIONS, EXECUTE = 0x0, 0x1, 0x10
NEEDS_CATALOG = 0xF0


@dataclass(frozen=True)
class Command:
    """A command: its names, the arguments it needs, its kind and help; run gets the session, the arguments and the catalog."""

    names: tuple[str, ...]
    min_args: int
    kind: int
    arg_help: str
    usage: str
    run: Callable[[SparkSession, Sequence[str], Catalog | None], DataFrame | None]

    @property
    def needs_catalog(self) -> bool:
        return bool(self.kind & NEEDS_CATALOG)


COMMANDS: list[Command] = []


def register(*names: str, min_args: int = 0, kind: int = EXECUTE, arg_help: str = "", usage: str = ""):
    """Adds a function as a command; the way to extend the command line."""

    def add(f):
        COMMANDS.append(Command(names, min_args, kind, arg_help, usage, f))
        return f

    return add


def type_lines(spark: SparkSession, catalog: Catalog, name: str, options: S.Options | None = None) -> DataFrame:
    """Ordered lines of the types of this name, or of the members of this namespace."""
    o = options or S.options(S.load(spark))
    found = predicates.find_type(catalog.symbols, name, o.case_sensitive)
    return render.ordered(render.type_lines(found, catalog.symbols, catalog.lines, catalog.source_files, o))


@register("-type", min_args=1, arg_help="<typename>", usage="print type info")
def _type(spark, args, catalog):
    return type_lines(spark, catalog, args[0])


@register("-help", "--h", kind=HELP, usage="print this table")
def _help(spark, args, catalog):
    return help_lines(spark)


@register("-compilands", arg_help="[full]", usage="print compilands")
def _compilands(spark, args, catalog):
    return compilands(catalog, bool(args) and args[0] == "true")


def compilands(catalog: Catalog, full: bool = False) -> DataFrame:
    if full:
        return C.compilands_full(catalog.symbols).orderBy("ordinal", "compiland_id", "section", "position")
    return C.compilands(catalog.symbols).orderBy("ordinal", "sym_id")


@register("-sources", usage="print file sources")
def _sources(spark, args, catalog):
    return C.source_files(catalog.source_files).orderBy("ordinal", "file_id")


@register("-settings", "--s", min_args=1, kind=OPTIONS, arg_help="[-h] <setting> <value>", usage="set setting")
def _settings(spark, args, catalog):
    if args[0] == "-h":
        return S.listing(S.load(spark)).orderBy("line_no")
    S.save(S.set_value(S.load(spark), args[0], args[1] if len(args) > 1 else None))
    return None


def get_command(name: str, n_args: int | None = None) -> Command:
    """The command with this name or alias; with n_args (of the whole line, the program included) only if they are enough."""
    command = next((c for c in COMMANDS if name in c.names), None)
    if not command:
        raise EngineError(f'no command is named "{name}"')
    least = command.min_args + 2 + command.needs_catalog
    if n_args is not None and n_args < least:
        raise EngineError(f"{n_args} arguments are fewer than {least}")
    return command


def help_lines(spark: SparkSession) -> DataFrame:
    """line_no, text: names from column 2, arguments from 20, usage from 44."""

    def at(line: str, column: int) -> str:
        return line + " " * (column - len(line)) if len(line) < column else line

    lines = ["Usage: symlattice <commandname> <filename>", "Command list:"]
    lines += [at(at("  " + ", ".join(c.names), 20) + " " + c.arg_help, 44) + " : " + c.usage for c in COMMANDS]
    return spark.createDataFrame(list(enumerate(lines)), "line_no long, text string").orderBy("line_no")


def arguments_text(argv: Sequence[str]) -> str:
    """How many arguments a line has, the program included, and which; for looking into how a line was split."""
    return f"Args count: {len(argv)} \nArgs: " + "".join(a + (", " if k < len(argv) else ";") for k, a in enumerate(argv, 1)) + "\n"


def verify_format(path: str) -> str:
    """path, if it ends in .pdb (as written here); two errors tell a wrong ending from a missing one."""
    if path[-len(EXTENSION) :] == EXTENSION:
        return path
    ending = Path(path).suffix
    raise EngineError(f"wrong extension {ending}, not {EXTENSION}" if ending else f"extension {EXTENSION} is missing")


def resolve_path(path: str) -> str:
    """A path with a scheme, a drive or a root as it is; any other is joined to the current folder and must exist."""
    if "://" in path or path[1:2] == ":" or os.path.isabs(path):
        return path
    full = os.path.join(os.getcwd(), path)
    if not os.path.exists(full):
        raise EngineError(f"{full} does not exist")
    return full


def write_text(lines: DataFrame, path: str) -> None:
    """Printed text as text files; reading the parts in order gives the printed order."""
    lines.select("text").write.mode("overwrite").text(path)


def main(argv: Sequence[str], spark: SparkSession | None = None, out=None) -> int:
    """Runs one command; prints its text; 0, or 1 after an error."""
    out = out or sys.stdout
    try:
        if len(argv) < 2:
            raise EngineError("no command is given")
        command = get_command(argv[1], len(argv))
        args, catalog = list(argv[2:]), None
        spark = spark or SparkSession.builder.appName("symlattice").getOrCreate()
        if command.needs_catalog:
            catalog = load(spark, resolve_path(verify_format(args[-1])))
            args = args[:-1]
        lines = command.run(spark, args, catalog)
        if lines is not None:
            for row in lines.select(F.coalesce("text", F.lit("")).alias("text")).toLocalIterator():
                print(row["text"], file=out)
        return 0
    except EngineError as e:
        print(f"Error: {e}", file=out)
        return 1


if __name__ == "__main__":
    sys.exit(main(sys.argv))
