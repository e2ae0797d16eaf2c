"""Symbols and references of Python sources, from the standard library's syntax trees, one file at a time in Arrow batches."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Called names, types and decorators that are too common to be references ---------------------------------
NOISE = frozenset(
    """map filter reduce forEach push pop shift unshift splice slice join split replace match test exec log info warn error dir keys values entries assign
    hasOwnProperty toString valueOf setTimeout setInterval clearTimeout clearInterval require stringify parse then catch finally print len range enumerate zip
    super isinstance issubclass hasattr getattr setattr delattr type id hash vars locals globals open read write close append extend insert remove clear index
    count sort reverse copy update setdefault get popitem items add discard difference difference_update intersection intersection_update isdisjoint issubset
    issuperset symmetric_difference symmetric_difference_update union find find_symbol read_file""".split()
)
PLAIN_TYPES = frozenset("int str float bool bytes list dict set tuple None True False object type Optional Union List Dict Set Tuple Any Callable Iterator Generator Awaitable Coroutine T K V R".split())
PLAIN_DECORATORS = frozenset("property staticmethod classmethod abstractmethod overload dataclass cached_property final".split())

_SYMBOL = "struct<name:string,kind:string,start_line:bigint,end_line:bigint,start_byte:bigint,end_byte:bigint,signature:string,attributes:array<string>>"
_REFERENCE = "struct<name:string,source:string,line_number:bigint,kind:string>"
SCHEMA = f"path string, symbols array<{_SYMBOL}>, relationships array<{_REFERENCE}>"


def symbols_of(tree: ast.AST, source: str = "") -> list[dict]:
    """Classes, functions, methods (functions anywhere below a class) and assigned names, in the order of their lines; bytes are those of the source in UTF-8."""
    out = []
    lines = [0]
    for line in re.split(r"(?<=\n)|(?<=\r)(?!\n)", source):
        lines.append(lines[-1] + len(line.encode()))
    byte = lambda line, column: lines[min(line - 1, len(lines) - 1)] + column

    def visit(node: ast.AST, below_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            row = None
            if isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                marks = [f"@{ast.unparse(d)}" for d in child.decorator_list]
                if isinstance(child, ast.ClassDef):
                    parts = [ast.unparse(x) for x in child.bases] + [f"{k.arg}={ast.unparse(k.value)}" for k in child.keywords if k.arg]
                    kind, head = "class", f"class {child.name}" + (f"({', '.join(parts)})" if parts else "")
                else:
                    kind = "method" if below_class else "function"
                    head = f"def {child.name}({ast.unparse(child.args)})" + (f" -> {ast.unparse(child.returns)}" if child.returns else "")
                row = {"name": child.name, "kind": kind, "signature": " ".join([f"[{m}]" for m in marks] + [head]), "attributes": marks}
            elif isinstance(child, (ast.Assign, ast.AnnAssign)):
                targets = child.targets if isinstance(child, ast.Assign) else [child.target]
                if isinstance(targets[0], ast.Name):
                    row = {"name": targets[0].id, "kind": "variable", "signature": None, "attributes": []}
            if row:
                out.append(row | {"start_line": child.lineno, "end_line": child.end_lineno, "start_byte": byte(child.lineno, child.col_offset), "end_byte": byte(child.end_lineno, child.end_col_offset)})
            visit(child, below_class or isinstance(child, ast.ClassDef))

    visit(tree, False)
    return sorted(out, key=lambda r: (r["start_line"], r["end_line"], r["name"]))


def _type_name(note: ast.AST | None) -> ast.Name | None:
    note = note.value if isinstance(note, ast.Subscript) else note
    return note if isinstance(note, ast.Name) else None


def references_of(tree: ast.AST) -> list[dict]:
    """References in order of precedence: those that know their receiver come first, and of equal (name, kind, line) the first stays."""
    known, other = [], []
    nodes = sorted((n for n in ast.walk(tree) if hasattr(n, "lineno")), key=lambda n: (n.lineno, n.col_offset))

    def emit(to: list, name: str, kind: str, line: int, source: str | None = None, noise: bool = True) -> None:
        if name and not (noise and name in NOISE):
            to.append((name, kind, line, source))

    for n in nodes:
        if isinstance(n, ast.Import):
            for a in n.names:
                emit(known, a.name + (f" as {a.asname}" if a.asname else ""), "imports", a.lineno, noise=False)
        elif isinstance(n, ast.ImportFrom):
            for a in n.names:
                if a.name != "*":
                    emit(known, a.name + (f" as {a.asname}" if a.asname else ""), "imports", a.lineno, "." * n.level + (n.module or ""), noise=False)
        elif isinstance(n, ast.Call):
            f = n.func
            if isinstance(f, ast.Name):
                emit(other, f.id, "calls", f.lineno)
            elif isinstance(f, ast.Attribute):
                on = f.value
                if isinstance(on, ast.Name):
                    emit(known, f.attr, "method_call", f.end_lineno, on.id)
                elif isinstance(on, ast.Attribute) and isinstance(on.value, ast.Name) and on.value.id in ("self", "cls"):
                    emit(known, f.attr, "method_call", f.end_lineno, f"self.{on.attr}")
                emit(other, f.attr, "method_call", f.end_lineno)
        elif isinstance(n, ast.Assign) and isinstance(n.value, ast.Call) and isinstance(n.value.func, ast.Name):
            made, to = n.value.func, n.targets[0]
            field = isinstance(to, ast.Attribute) and isinstance(to.value, ast.Name) and to.value.id in ("self", "cls")
            if isinstance(to, ast.Name) or field:
                emit(known, made.id, "instantiates", made.lineno, to.attr if field else to.id)
            emit(other, made.id, "instantiates", made.lineno)
        elif isinstance(n, ast.Global):
            for name in n.names:
                emit(other, name, "global_ref", n.lineno)
        if isinstance(n, ast.Attribute):
            emit(other, n.attr, "MEMBER_ACCESS", n.end_lineno)
        if isinstance(n, ast.ClassDef):
            for base in n.bases:
                name = base.id if isinstance(base, ast.Name) else base.attr if isinstance(base, ast.Attribute) else ""
                emit(other, name, "inherits", base.end_lineno, noise=False)
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            a = n.args
            for note in [x.annotation for x in [*a.posonlyargs, *a.args, *a.kwonlyargs, a.vararg, a.kwarg] if x] + [n.returns]:
                if (t := _type_name(note)) and t.id not in PLAIN_TYPES:
                    emit(other, t.id, "type_ref", t.lineno)
        if isinstance(n, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            for d in n.decorator_list:
                f = d.func if isinstance(d, ast.Call) else d
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else ""
                if name not in PLAIN_DECORATORS:
                    emit(other, name, "annotation", f.end_lineno, noise=False)
    first: dict[tuple, str | None] = {}
    for name, kind, line, source in known + other:
        first.setdefault((name, kind, line), source)
    return [{"name": n, "source": s, "line_number": line, "kind": k} for (n, k, line), s in first.items()]


def bindings_of(tree: ast.AST) -> list[dict]:
    """Types of variables, fields (context: the class) and functions where annotated by a plain name, aliases, calls assigned, imports renamed. Built-in types are left out."""
    out = []
    fields = {id(n): c.name for c in ast.walk(tree) if isinstance(c, ast.ClassDef) for n in c.body if isinstance(n, ast.AnnAssign)}

    def bind(kind: str, name: str, type_name: str, context: str | None = None) -> None:
        if kind in ("alias", "import_alias", "assignment") or type_name not in PLAIN_TYPES:
            out.append({"kind": kind, "name": name, "type_name": type_name, "context": context})

    for n in sorted((n for n in ast.walk(tree) if hasattr(n, "lineno")), key=lambda n: (n.lineno, n.col_offset)):
        if isinstance(n, ast.AnnAssign) and isinstance(n.target, ast.Name) and isinstance(n.annotation, ast.Name):
            bind("field_type" if id(n) in fields else "var_type", n.target.id, n.annotation.id, fields.get(id(n)))
        elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and isinstance(n.returns, ast.Name):
            bind("return_type", n.name, n.returns.id)
        elif isinstance(n, ast.Assign) and isinstance(n.targets[0], ast.Name):
            name = n.targets[0].id
            if isinstance(n.value, ast.Name) and n.value.id != name:
                bind("alias", name, n.value.id)
        elif isinstance(n, ast.ImportFrom):
            for a in n.names:
                if a.asname:
                    bind("import_alias", a.asname, a.name)
    return out


def parse_bindings(files: DataFrame) -> DataFrame:
    """(path, kind, name, type_name, context) of the Python files of a table (path, content)."""
    kinds = "path string, kind string, name string, type_name string, context string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    rows += [{"path": path} | b for b in bindings_of(ast.parse(content or ""))]
                except (SyntaxError, ValueError, RecursionError):
                    continue
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(c, pa.string()) for c in ("path", "kind", "name", "type_name", "context")]))

    return files.where(F.col("path").endswith(".py")).select("path", "content").mapInArrow(run, kinds)


def parse(files: DataFrame) -> DataFrame:
    """(path, symbols, relationships) of the Python files of a table (path, content). Files that don't parse, or have no content, have empty lists."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    tree = ast.parse(content or "")
                except (SyntaxError, ValueError, RecursionError):
                    tree = ast.Module([], [])
                rows.append({"path": path, "symbols": symbols_of(tree, content or ""), "relationships": references_of(tree)})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.where(F.col("path").endswith(".py")).select("path", "content").mapInArrow(run, SCHEMA)


def parsed_tables(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """symbols and relationships of `files` as tables, by path."""
    rows = parse(files)
    return rows.select("path", F.inline("symbols")), rows.select("path", F.inline("relationships"))
