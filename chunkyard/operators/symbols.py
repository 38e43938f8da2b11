"""Chunks from syntax trees, with a pluggable parser.

A parser turns a text into ``Node`` trees of a few general kinds; the walk over them is the same for
every language.  Python has the standard library's parser, languages with braces have the light ones
of ``braces``; files of other languages, and files a parser rejects or finds nothing in, become windows
of lines.  That fallback is not syntax-tree chunking and its chunks say so by their names.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW, OVERLAP = 400, 50
CONTEXT_TOKENS = 400
WHOLE_TOKENS = 800
CALL_DEPTH = 40

SYMBOLS = "path string, doc_type string, language string, name string, parent string, start_line int, raw array<string>, text string, symbol_names array<string>"


@dataclass
class Node:
    """kind: class, symbol, import, variable or other; lines are counted from 0, ``last`` inclusive."""

    kind: str
    name: str = ""
    first: int = 0
    last: int = 0
    text: str = ""
    calls: frozenset[str] = frozenset()
    below: list[Node] = field(default_factory=list)


def _callee(node: ast.Call) -> str | None:
    if isinstance(node.func, ast.Name):
        return node.func.id
    return node.func.attr if isinstance(node.func, ast.Attribute) else None


def _called(node: ast.AST) -> frozenset[str]:
    """Names called and modules imported below a node, down to CALL_DEPTH."""
    found, level = set(), [node]
    for _ in range(CALL_DEPTH + 1):
        for n in level:
            if isinstance(n, ast.Call) and (name := _callee(n)):
                found.add(name)
            elif isinstance(n, ast.Import):
                found.update(a.name.rpartition(".")[2] for a in n.names if not a.asname)
            elif isinstance(n, ast.ImportFrom):
                found.update([(n.module or "").rpartition(".")[2]] if n.module else [], [a.name for a in n.names if not a.asname])
        level = [c for n in level for c in ast.iter_child_nodes(n)]
    return frozenset(found)


def parse_python(text: str) -> Node:
    """Raises SyntaxError for what is not Python."""
    lines = text.splitlines()

    def node_of(n: ast.AST) -> Node:
        marks = getattr(n, "decorator_list", [])
        first = min([n.lineno, *(d.lineno for d in marks)]) - 1 if hasattr(n, "lineno") else 0
        last = (n.end_lineno or n.lineno) - 1 if hasattr(n, "lineno") else len(lines) - 1
        kind = {ast.ClassDef: "class", ast.FunctionDef: "symbol", ast.AsyncFunctionDef: "symbol", ast.Import: "import", ast.ImportFrom: "import", ast.Assign: "variable", ast.AnnAssign: "variable", ast.AugAssign: "variable", ast.Expr: "variable"}.get(type(n), "other")
        body = "\n".join(lines[first : last + 1])
        return Node(kind, getattr(n, "name", "") or "", first, last, body, _called(n) if kind in ("class", "symbol", "other") else frozenset(), [node_of(c) for c in ast.iter_child_nodes(n) if isinstance(c, (ast.stmt, ast.ExceptHandler, ast.match_case))])

    return node_of(ast.parse(text))


PARSERS: dict[str, Callable[[str], Node]] = {"python": parse_python}


def all_parsers() -> dict[str, Callable[[str], Node]]:
    from chunkyard.operators import braces

    return {**braces.PARSERS, **PARSERS}


def _overview(node: Node, lines: list[str], scope: str) -> tuple[list[str], list[str]]:
    """Heads of what a node holds, and the names of it."""
    out, names = [], []
    for n in node.below:
        own = lines[n.first : n.last + 1]
        if n.kind == "import" and not scope:
            out += [*own, ""]
        elif n.kind == "class" and n.name:
            out += [f"# class: {n.name}", *own[:6], ""]
            names.append(n.name)
        elif n.kind == "symbol" and n.name:
            out += [*own[:3], ""]
            names.append(f"{scope}.{n.name}" if scope else n.name)
        elif n.kind == "variable" and len(own) <= 8:
            out += [*own, ""]
    return out, names


def _joined(parent: str, name: str) -> str:
    return f"{parent}.{name}" if parent and name else parent or name


class Chunker:
    """The chunks of one file, as dicts without path.  Symbols over WHOLE_TOKENS in which nothing is defined are
    chunks too; without ``keep_long`` they are left out, as the reference does."""

    def __init__(self, text: str, doc_type: str, language: str, keep_long: bool = True):
        self.text, self.doc_type, self.language, self.lines, self.keep_long = text, doc_type, language, text.splitlines(), keep_long

    def _chunk(self, text: str, name: str, line: int, parent: str = "", calls: frozenset[str] = frozenset(), symbols: list[str] | None = None, kind: str = "") -> dict:
        full = f"{parent}.{name}" if parent and name else name or f"unnamed::{line}"
        return {"doc_type": self.doc_type + kind, "language": self.language, "name": full, "parent": parent, "start_line": line, "raw": sorted(calls), "text": text.strip(), "symbol_names": symbols}

    def windows(self) -> Iterator[dict]:
        for i in range(0, len(self.lines), WINDOW - OVERLAP):
            text = "\n".join(self.lines[i : i + WINDOW])
            if text.strip():
                yield self._chunk(text, f"chunk::{i}", i)

    def _walk(self, node: Node, parent: str) -> Iterator[dict]:
        for n in node.below:
            if n.kind == "class":
                if n.name:
                    head, names = _overview(n, self.lines, n.name)
                    if text := "\n".join(head).strip():
                        yield self._chunk(text, f"{n.name}[context]", n.first, parent, n.calls, names, "_context")
                yield from self._walk(n, _joined(parent, n.name) if n.name else "")
            elif n.kind != "symbol":
                yield from self._walk(n, parent)
            elif len(n.text) // 4 <= WHOLE_TOKENS:
                yield self._chunk(f"# context: inside {parent}\n{n.text}" if parent else n.text, n.name, n.first, parent, n.calls)
            else:
                inner = list(self._walk(n, _joined(parent, n.name)))
                if inner:
                    head = "\n".join(n.text.splitlines()[: max(inner[0]["start_line"] - n.first, 8)])
                    if head.strip():
                        yield self._chunk(head, f"{n.name}[header]", n.first, parent, n.calls)
                elif self.keep_long:
                    yield self._chunk(f"# context: inside {parent}\n{n.text}" if parent else n.text, n.name, n.first, parent, n.calls)
                yield from inner

    def _file_context(self, root: Node, names: list[str]) -> Iterator[dict]:
        head, own = _overview(root, self.lines, "")
        symbols, text = list(dict.fromkeys(own + names)), "\n".join(head).strip()
        if text and len(text) // 4 <= CONTEXT_TOKENS:
            yield self._chunk(text, "[file_context]", 0, calls=root.calls, symbols=symbols, kind="_context")
        elif text:
            lines = text.splitlines()
            for i in range(0, len(lines), WINDOW - OVERLAP):
                if piece := "\n".join(lines[i : i + WINDOW]).strip():
                    yield self._chunk(piece, f"[file_context::{i}]", i, calls=root.calls, symbols=[] if i else symbols, kind="_context")

    def chunks(self, parsers: dict[str, Callable[[str], Node]]) -> list[dict]:
        parser = parsers.get(self.language)
        try:
            root = parser(self.text) if parser else None
        except (SyntaxError, ValueError, RecursionError):
            root = None
        if root is None:
            return list(self.windows())
        inside = list(self._walk(root, ""))
        return [*self._file_context(root, [c["name"] for c in inside]), *inside] or list(self.windows())


def symbol_chunks(files: DataFrame, parsers: dict[str, Callable[[str], Node]] | None = None, keep_long: bool = True) -> DataFrame:
    """Chunks of files (path, text, doc_type, language)."""
    known, text, texts = parsers or all_parsers(), pa.string(), pa.list_(pa.string())
    schema = pa.schema([("path", text), ("doc_type", text), ("language", text), ("name", text), ("parent", text), ("start_line", pa.int32()), ("raw", texts), ("text", text), ("symbol_names", texts)])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256).to_pylist()
                made = [{"path": r["path"], **c} for r in rows for c in Chunker(r["text"] or "", r["doc_type"] or "", r["language"] or "", keep_long).chunks(known)]
                yield pa.RecordBatch.from_pylist(made, schema=schema)

    return files.select("path", "text", "doc_type", "language").mapInArrow(run, SYMBOLS)
