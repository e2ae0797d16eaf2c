"""Symbols, references and bindings of TypeScript, JavaScript, Rust, Vue and Svelte sources, by patterns over masked text.

No syntax tree is built. Strings and comments are blanked first (every character keeps its place), then declarations and
references are found by patterns, and blocks by their brackets. Unusual layouts can be missed; what the patterns cover is
held against samples in the tests. Arrow batches, one file at a time.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.sources.python_frontend import NOISE

# Fixed values ---------------------------------------------------------------------------------------------------------
TS_PLAIN_TYPES = frozenset("string number boolean any unknown never void null undefined object symbol bigint Array Promise Record Partial Required Readonly Pick Omit Map Set Date Function Error RegExp".split())
RUST_PLAIN_TYPES = frozenset("i8 i16 i32 i64 i128 isize u8 u16 u32 u64 u128 usize f32 f64 bool char str String Self Option Result Vec Box Rc Arc HashMap HashSet".split())
RUST_NOISE = frozenset(
    """println eprintln print eprint format vec panic assert assert_eq assert_ne debug_assert todo unimplemented unreachable unwrap expect ok err ok_or
    map map_err and_then or_else or flatten unwrap_or unwrap_or_else unwrap_or_default filter collect iter into_iter iter_mut enumerate zip chain take skip
    flat_map filter_map fold reduce find any all count sum min max cloned copied rev clone to_string to_owned trim split starts_with ends_with contains
    replace chars bytes lines as_str as_bytes push_str push pop len is_empty first last get get_mut insert remove retain dedup drain extend append sort
    join entry or_insert keys values default new from into as_ref as_mut drop parse cmp eq ne lock next Some Ok Err None""".split()
)
_JS_WORDS = frozenset("if for while switch catch return function class new typeof await import super delete void in of do else throw case yield constructor async".split())
_RUST_WORDS = frozenset("if for while match loop return fn let move in as where impl dyn mut ref unsafe else".split())

_MASK = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_MASK_RUST = re.compile(r"//[^\n]*|/\*.*?\*/|r#*\".*?\"#*|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])'", re.S)
_NAME = r"[A-Za-z_$][\w$]*"


def masked(source: str, pattern: re.Pattern = _MASK) -> str:
    """The source with everything but line ends inside comments and strings blanked; quotation marks stay."""

    def blank(m: re.Match) -> str:
        text = m[0]
        inner = re.sub(r"[^\n]", " ", text)
        return text[0] + inner[1:-1] + text[-1] if text[0] in "\"'`" and len(text) > 1 else inner

    return pattern.sub(blank, source)


class Source:
    """A masked text with its places: lines from 1, bytes of UTF-8, ends of blocks."""

    def __init__(self, text: str, pattern: re.Pattern = _MASK):
        self.text, self.code = text, masked(text, pattern)
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.ascii = text.isascii()

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def byte(self, at: int) -> int:
        return at if self.ascii else len(self.text[:at].encode())

    def block_end(self, at: int) -> int:
        """Behind the bracket that closes the first { from `at`, or behind the first ; or line end on which nothing is open."""
        depth = 0
        for m in re.finditer(r"[{}();\n\[\]]", self.code[at:]):
            c = m[0]
            if c in "{([":
                depth += 1
            elif c in "})]":
                depth -= 1
                if depth <= 0 and c == "}":
                    return at + m.end()
            elif depth <= 0 and (c == ";" or (c == "\n" and not re.match(r"\s*[{.|&=?:]|\s*where\b", self.code[at + m.end() :]))):
                return at + m.start() + (c == ";")
        return len(self.code)


class Rows:
    """Symbols, references (those that know more first; of equal name, kind and line the first stays) and bindings."""

    def __init__(self, source: Source, noise: frozenset[str]):
        self.source, self.noise = source, noise
        self.symbols: dict[tuple, dict] = {}
        self.known: list[tuple] = []
        self.other: list[tuple] = []
        self.bindings: list[dict] = []

    def symbol(self, name: str, kind: str, start: int, end: int, signature: str | None = None, attributes: Iterable[str] = ()) -> None:
        s = self.source
        self.symbols.setdefault((name, kind, start), {"name": name, "kind": kind, "start_line": s.line(start), "end_line": s.line(max(start, end - 1)), "start_byte": s.byte(start), "end_byte": s.byte(end), "signature": signature, "attributes": list(attributes)})

    def reference(self, name: str, kind: str, at: int, source: str | None = None, noise: bool = True) -> None:
        if name and not (noise and name in self.noise):
            (self.known if source else self.other).append((name, kind, self.source.line(at), source))

    def binding(self, kind: str, name: str, type_name: str, context: str | None = None) -> None:
        self.bindings.append({"kind": kind, "name": name, "type_name": type_name, "context": context})

    def tables(self) -> dict:
        first: dict[tuple, str | None] = {}
        for name, kind, line, source in self.known + self.other:
            first.setdefault((name, kind, line), source)
        return {"symbols": sorted(self.symbols.values(), key=lambda r: (r["start_byte"], -r["end_byte"])), "relationships": [{"name": n, "source": s, "line_number": line, "kind": k} for (n, k, line), s in first.items()], "bindings": self.bindings}


def _all(pattern: str, code: str) -> Iterator[re.Match]:
    return re.finditer(pattern, code)


def script(text: str, typed: bool = True, jsx: bool = True) -> dict:
    """TypeScript (typed) or JavaScript."""
    s = Source(text)
    code, rows = s.code, Rows(s, NOISE)
    classes = []
    for m in _all(rf"\b(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(class|interface)\s+({_NAME})(?:\s*<[^{{>]*>)?([^{{]*)\{{", code):
        end = s.block_end(m.end() - 1)
        if m[1] == "class" or typed:
            rows.symbol(m[2], "type" if typed else "class", m.start(), end, " ".join(text[m.start() : m.end() - 1].split()))
        if m[1] == "class":
            classes.append((m[2], m.end(), end))
        heads = m[3]
        for kind, word in (("extends", "extends"), ("implements", "implements")):
            if (typed or kind == "extends") and (h := re.search(rf"\b{word}\s+(.*?)(?=\bextends\b|\bimplements\b|$)", heads, re.S)):
                for part in re.sub(r"<[^>]*>", "", h[1]).split(","):
                    if name := re.search(rf"({_NAME})\s*$", part.strip()):
                        rows.reference(name[1], kind, m.start(3) + h.start(1), noise=False)
    inside = lambda at: next((n for n, a, b in reversed(classes) if a <= at < b), None)
    depth = lambda a, b: code.count("{", a, b) - code.count("}", a, b)
    for name, start, end in classes:
        for m in _all(rf"(?m)^[ \t]*(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*(#?{_NAME})\s*(?:<[^>(]*>)?\([^;{{]*\)\s*(?::[^;{{]*)?\{{", code[start:end]):
            at = start + m.start(1)
            if m[1] not in _JS_WORDS and depth(start, at) == 0:
                rows.symbol(m[1], "method", start + m.start(), s.block_end(start + m.end() - 1))
        for m in _all(rf"(?m)^[ \t]*(?:(?:public|private|protected|static|readonly)\s+)*({_NAME})[?!]?\s*(?::\s*([\w.$]+)(?:<[^=;]*>)?)?\s*=\s*(?:async\s*)?\([^)]*\)\s*(?::[^=]*)?=>", code[start:end]):
            if depth(start, start + m.start(1)) == 0:
                rows.symbol(m[1], "method", start + m.start(), s.block_end(start + m.end()))
        if typed:
            for m in _all(rf"(?m)^[ \t]*(?:(?:public|private|protected|static|readonly|declare)\s+)*({_NAME})[?!]?\s*:\s*([A-Za-z_$][\w$]*)", code[start:end]):
                if depth(start, start + m.start(1)) == 0 and m[2] not in TS_PLAIN_TYPES:
                    rows.binding("field_type", m[1], m[2], name)
    for m in _all(rf"\b(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*({_NAME})\s*(?:<[^>(]*>)?\(", code):
        end = s.block_end(m.end() - 1)
        head = code.find("{", m.end())
        rows.symbol(m[1], "function", m.start(), end, " ".join(text[m.start() : head if 0 <= head < end else end].split()))
        if typed and (r := re.match(rf"[^{{]*\)\s*:\s*({_NAME})", code[m.end() - 1 :])) and r[1] not in TS_PLAIN_TYPES:
            rows.binding("return_type", m[1], r[1])
    for m in _all(rf"(?m)(?:\bexport\s+)?\b(?:const|let|var)\s+({_NAME})\s*(?::\s*([A-Za-z_$][\w$]*)[^=;\n]*)?\s*=\s*(?!=)", code):
        rest = code[m.end() :]
        end = s.block_end(m.end())
        arrow = re.match(rf"(?:async\s*)?(?:\([^)]*\)\s*(?::\s*({_NAME})[^=]*)?|{_NAME}\s*)=>", rest)
        call = re.match(rf"(?:await\s+)?({_NAME})\s*(?:<[^>(]*>)?\(", rest)
        rows.symbol(m[1], "function" if arrow or (call and call[1] not in _JS_WORDS) else "variable", m.start(), end)
        if m[2] and typed and m[2] not in TS_PLAIN_TYPES:
            rows.binding("var_type", m[1], m[2])
        if arrow and arrow[1] and typed and arrow[1] not in TS_PLAIN_TYPES:
            rows.binding("return_type", m[1], arrow[1])
        elif new := re.match(rf"new\s+({_NAME})\s*[(<]", rest):
            rows.reference(new[1], "new_call", m.end() + new.start(1), m[1])
            rows.binding("var_type", m[1], new[1])
        elif call and call[1] not in _JS_WORDS:
            rows.binding("assignment", m[1], call[1])
        elif alias := re.match(rf"({_NAME})\s*(?:;|\n|$)", rest):
            rows.binding("alias", m[1], alias[1])
        elif literal := re.match(r"\{([^{}]*)\}", rest):
            for part in literal[1].split(","):
                if pair := re.fullmatch(rf"\s*({_NAME})\s*(?::\s*({_NAME}))?\s*", part):
                    rows.binding("object_literal", pair[2] or pair[1], m[1])
    for m in _all(rf"\b(?:const|let|var)\s*\{{([^{{}}]*)\}}\s*=\s*({_NAME})\b(?!\s*[(.])", code):
        for part in m[1].split(","):
            if name := re.match(rf"\s*({_NAME})", part):
                rows.binding("destructuring", name[1], m[2])
    for m in _all(r"\bimport\s+(?:type\s+)?([^;'\"]*?)\s*from\s*(['\"])", code):
        source = text[m.end() : code.find(m[2], m.end())]
        for part in re.split(r",", m[1].replace("{", ",").replace("}", ",")):
            part = part.strip().removeprefix("type ").strip()
            name, _, alias = (x.strip() for x in part.partition(" as "))
            name = alias if name == "*" else name
            if re.fullmatch(_NAME, name):
                rows.reference(name, "imports", m.start() + max(0, m[0].find(name)), source, noise=False)
                if alias and alias != name:
                    rows.binding("import_alias", alias, name)
    for m in _all(r"\bexport\s*\{([^}]*)\}\s*from\s*(['\"])", code):
        source = text[m.end() : code.find(m[2], m.end())]
        for part in m[1].split(","):
            if name := re.match(rf"\s*({_NAME})", part):
                rows.reference(name[1], "re_export", m.start(), source, noise=False)
    for m in _all(rf"\bthis\.({_NAME})\s*=\s*new\s+({_NAME})\b", code):
        rows.reference(m[2], "new_call", m.start(2), m[1])
    for m in _all(rf"(?<![\w$.)\]])(this\.{_NAME}|{_NAME})\??\.({_NAME})\s*(?:<[^>(\n]*>)?\(", code):
        if m[1] not in _JS_WORDS:
            rows.reference(m[2], "method_call", m.start(2), m[1])
    for m in _all(rf"\.({_NAME})\s*(?:<[^>(\n]*>)?\(", code):
        rows.reference(m[1], "method_call", m.start(1))
    for m in _all(rf"(?<![\w$.])({_NAME})\s*(?:<[\w\s,\[\]]*>)?\(", code):
        before = code[max(0, m.start() - 12) : m.start()]
        if m[1] not in _JS_WORDS and not re.search(r"\b(function\*?|new|class)\s+$", before) and not any(r["kind"] == "method" and r["name"] == m[1] and r["start_line"] == s.line(m.start()) for r in rows.symbols.values()):
            rows.reference(m[1], "calls", m.start())
    for m in _all(rf"\bnew\s+({_NAME})\b", code):
        rows.reference(m[1], "new_call", m.start(1))
    for m in _all(rf"\.({_NAME})\b(?!\s*(?:<[^>(\n]*>)?\()", code):
        rows.reference(m[1], "MEMBER_ACCESS", m.start(1))
    if jsx:
        for m in _all(rf"(?<![\w$])<([A-Z][\w$]*)(?=[\s/>])(?!\s*[,(=])", code):
            rows.reference(m[1], "component_use", m.start(1))
    if typed:
        for m in _all(rf"({_NAME})\s*\??:\s*([A-Za-z_$][\w$]*)(?=[\s,)=;\[<|&{{>]|$)", code):
            if m[2] not in TS_PLAIN_TYPES and (m[2][0].isupper()):
                rows.reference(m[2], "type_ref", m.start(2), noise=False)
                if re.match(r"[^()]*\)", code[m.end() :]) and not inside(m.start()):
                    rows.binding("var_type", m[1], m[2])
        for m in _all(rf"\)\s*:\s*({_NAME})", code):
            if m[1] not in TS_PLAIN_TYPES:
                rows.reference(m[1], "type_ref", m.start(1), noise=False)
        for m in _all(rf"<\s*{_NAME}\s+extends\s+({_NAME})", code):
            rows.reference(m[1], "generic_constraint", m.start(1), noise=False)
        for m in _all(rf"(?m)^\s*@({_NAME})", code):
            rows.reference(m[1], "annotation", m.start(1), noise=False)
    return rows.tables()


def use_leaves(path: str, prefix: str = "") -> Iterator[tuple[str, str]]:
    """(name, module) of each leaf of a use path; globs, self and single letters are left out, renames dropped."""
    path = path.strip()
    if "{" in path:
        head, inner = path.split("{", 1)
        head = head.strip().removesuffix("::").strip()
        head = f"{prefix}::{head}" if prefix and head else prefix or head
        inner, depth, part = inner[: inner.rfind("}")] if "}" in inner else inner, 0, ""
        for c in inner + ",":
            depth += (c == "{") - (c == "}")
            if c == "," and not depth:
                yield from use_leaves(part, head)
                part = ""
            else:
                part += c
        return
    path = re.split(r"\s+as\s+", path)[0]
    module, _, name = path.rpartition("::")
    if name not in ("*", "self", "super", "crate") and len(name) > 1:
        yield name, f"{prefix}::{module}" if prefix and module else prefix or module


_RUST_KINDS = {"fn": "function", "struct": "struct", "enum": "enum", "trait": "trait", "type": "type_alias", "const": "constant", "static": "constant", "macro_rules!": "macro", "mod": "module"}


def rust(text: str) -> dict:
    s = Source(text, _MASK_RUST)
    code, rows = s.code, Rows(s, RUST_NOISE)
    for m in _all(r"\b(?:pub(?:\([^)]*\))?\s+)?(?:(?:async|unsafe|extern|default)\s+)*(fn|struct|enum|trait|type|const|static|macro_rules!|mod)\s+(?:mut\s+)?([A-Za-z_]\w*)", code):
        if not (m[1] == "const" and m[2] == "fn"):
            rows.symbol(m[2], _RUST_KINDS[m[1]], m.start(), s.block_end(m.end()))
    for m in _all(r"\buse\s+([^;]+);", code):
        for name, module in use_leaves(re.sub(r"\s+", " ", m[1])):
            rows.reference(name, "imports", m.start(), module or None, noise=False)
        for name, alias in re.findall(r"(\w+)\s+as\s+(\w+)", m[1]):
            rows.binding("import_alias", alias, name)
    for m in _all(r"\bimpl(?:\s*<[^{>]*>)?\s+([\w:]+)(?:<[^{]*?>)?\s+for\s", code):
        rows.reference(m[1].rpartition("::")[2], "implements", m.start(1), noise=False)
    for m in _all(r"(?<![\w.)\]])([A-Za-z_]\w*)\.([A-Za-z_]\w*)\s*(?:::<[^>]*>)?\(", code):
        rows.reference(m[2], "method_call", m.start(2), m[1])
    for m in _all(r"\.([A-Za-z_]\w*)\s*(?:::<[^>]*>)?\(", code):
        rows.reference(m[1], "method_call", m.start(1))
    for m in _all(r"(?<![\w.])(?:[A-Za-z_]\w*::)*([A-Za-z_]\w*)\s*(?:::<[^>]*>)?\(", code):
        if m[1] not in _RUST_WORDS and not re.search(r"\b(fn|struct|enum)\s+$|#!?\[\s*$", code[max(0, m.start() - 10) : m.start()]):
            rows.reference(m[1], "calls", m.start(1))
    for m in _all(r"(?:[\w)]\s*:\s*|->\s*)(?:&\s*(?:'\w+\s+)?(?:mut\s+)?)?(?:[a-z_]\w*::)*([A-Z]\w*)", code):
        bound = m[0][0].isalnum() and re.search(r"[<,]\s*[A-Z]\w*$", code[max(0, m.start() - 40) : m.start() + 1])
        if m[1] not in RUST_PLAIN_TYPES and not bound:
            rows.reference(m[1], "type_ref", m.start(1), noise=False)
    for m in _all(r"#!?\[\s*(\w+)(?:\(([^)\]]*)\))?", code):
        if m[1] == "derive":
            for name in re.findall(r"\w+", m[2] or ""):
                rows.reference(name, "annotation", m.start(), noise=False)
        else:
            rows.reference(m[1], "annotation", m.start(1), noise=False)
    for m in _all(r"[<,]\s*[A-Z]\w*\s*:\s*((?:[\w:]+(?:<[^>]*>)?\s*\+?\s*)+)", code):
        for name in re.findall(r"([A-Z]\w*)(?=\s*(?:<|\+|>|,|$))", m[1]):
            rows.reference(name, "generic_constraint", m.start(1), noise=False)
    return rows.tables()


_HANDLER = {"vue": r"(?:@|v-on:|v-model|:)[a-zA-Z0-9_\-]+=\"([a-zA-Z0-9_]+)(?:\(|\")", "svelte": r"\bon:[a-zA-Z0-9_\-]+=\{([a-zA-Z0-9_]+)\}", "angular": r"\([a-zA-Z0-9_\-]+\)=\"([a-zA-Z0-9_]+)(?:\(|\")"}


def handlers(template: str, kind: str) -> list[dict]:
    """Calls of the functions that a template's event bindings name."""
    return [{"name": m[1], "source": None, "line_number": i, "kind": "calls"} for i, line in enumerate(template.split("\n"), 1) for m in re.finditer(_HANDLER[kind], line)]


def component(text: str, kind: str) -> dict:
    """A Vue or Svelte file: its script blocks on their own lines, and the handlers of its template."""
    out, inside, typed = [], False, False
    for line in text.split("\n"):
        if "<script" in line:
            inside, typed = True, typed or 'lang="ts"' in line or "lang='ts'" in line
            out.append("")
        elif "</script>" in line:
            inside = False
            out.append("")
        else:
            out.append(line if inside else "")
    rows = script("\n".join(out), typed, typed)
    # bytes are those of the file: each script line begins where the file's own does
    own = [0]
    for line in text.split("\n"):
        own.append(own[-1] + len(line.encode()) + 1)
    blank = [0]
    for line in out:
        blank.append(blank[-1] + len(line.encode()) + 1)
    for r in rows["symbols"]:
        for place in ("start_byte", "end_byte"):
            i = bisect_right(blank, r[place]) - 1
            r[place] = own[min(i, len(own) - 1)] + r[place] - blank[i]
    return rows | {"relationships": rows["relationships"] + handlers(text, kind)}


def parse_text(path: str, text: str, companion: str | None = None) -> dict:
    ext = path.rpartition(".")[2]
    if ext in ("vue", "svelte"):
        return component(text, ext)
    rows = rust(text) if ext == "rs" else script(text, ext in ("ts", "tsx"), ext in ("tsx", "jsx"))
    if companion is not None:
        rows = rows | {"relationships": rows["relationships"] + handlers(companion, "angular")}
    return rows


EXTENSIONS = ["ts", "tsx", "js", "jsx", "rs", "vue", "svelte"]
_SYMBOL = "struct<name:string,kind:string,start_line:bigint,end_line:bigint,start_byte:bigint,end_byte:bigint,signature:string,attributes:array<string>>"
_REFERENCE = "struct<name:string,source:string,line_number:bigint,kind:string>"
_BINDING = "struct<kind:string,name:string,type_name:string,context:string>"
SCHEMA = f"path string, symbols array<{_SYMBOL}>, relationships array<{_REFERENCE}>, bindings array<{_BINDING}>"


def parse(files: DataFrame) -> DataFrame:
    """(path, symbols, relationships, bindings) of the files (path, content) of EXTENSIONS. Files without content have empty lists.
    A component's template (x.component.html beside x.component.ts) is joined to it."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(SCHEMA))
    own = files.where(F.regexp_extract("path", r"\.([^./]+)$", 1).isin(EXTENSIONS)).select("path", "content")
    templates = files.where(F.col("path").endswith(".component.html")).select(F.regexp_replace("path", "html$", "ts").alias("path"), F.col("content").alias("template"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"path": r["path"]} | parse_text(r["path"], r["content"] or "", r["template"]) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return own.join(templates, "path", "left").mapInArrow(run, SCHEMA)


def parsed_tables(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """symbols, relationships and bindings of `files` as tables, by path."""
    rows = parse(files)
    return tuple(rows.select("path", F.inline(c)) for c in ("symbols", "relationships", "bindings"))
