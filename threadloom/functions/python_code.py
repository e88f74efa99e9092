"""Definitions, references and body shapes of Python sources. Other languages register a provider of the same form."""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Callable, Iterator
from fnmatch import fnmatch

DEFINITIONS = "path string, qualname string, name string, kind string, start int, end int, parent string, shape_hash string, body_hash string"
REFERENCES = "path string, name string, qualname string, kind string, line int, col int"


def _bare(node: ast.AST) -> ast.AST:
    """The node without annotations and docstrings."""
    for n in ast.walk(node):
        if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            if n.body and isinstance(n.body[0], ast.Expr) and isinstance(n.body[0].value, ast.Constant) and isinstance(n.body[0].value.value, str):
                n.body = n.body[1:] or [ast.Pass()]
            if not isinstance(n, ast.ClassDef):
                n.returns = None
        if isinstance(n, ast.arg):
            n.annotation = None
    return node


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()[:12]


def python_definitions(path: str, source: str) -> Iterator[tuple]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return
    lines = source.splitlines()

    def walk(node: ast.AST, parent: str) -> Iterator[tuple]:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                name = f"{parent}.{n.name}" if parent else n.name
                start = min([n.lineno, *(d.lineno for d in n.decorator_list)])
                body = "\n".join(lines[start - 1 : n.end_lineno])
                kind = "class" if isinstance(n, ast.ClassDef) else "method" if isinstance(node, ast.ClassDef) else "function"
                inner = list(walk(n, name))
                yield path, name, n.name, kind, start, n.end_lineno, parent or None, _digest(ast.dump(_bare(n))), _digest(body)
                yield from inner
            else:
                yield from walk(n, parent)

    yield from walk(tree, "")


_RANK = {"call": 0, "definition": 1, "attribute": 2, "name": 3}


def python_references(path: str, source: str) -> Iterator[tuple]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return
    found: dict[tuple[int, int], tuple] = {}

    def dotted(n: ast.AST) -> str:
        if isinstance(n, ast.Name):
            return n.id
        return f"{dotted(n.value)}.{n.attr}".lstrip(".") if isinstance(n, ast.Attribute) else ""

    def put(line: int, col: int, name: str, qualname: str, kind: str) -> None:
        old = found.get((line, col))
        if old is None or _RANK[kind] < _RANK[old[2]]:
            found[line, col] = (name, qualname, kind)

    for n in ast.walk(tree):
        if isinstance(n, ast.Call):
            f = n.func
            if isinstance(f, ast.Name):
                put(f.lineno, f.col_offset, f.id, f.id, "call")
            elif isinstance(f, ast.Attribute):
                put(f.end_lineno, f.end_col_offset - len(f.attr), f.attr, dotted(f), "call")
        elif isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            put(n.lineno, n.col_offset, n.name, n.name, "definition")
        elif isinstance(n, ast.Attribute):
            put(n.end_lineno, n.end_col_offset - len(n.attr), n.attr, dotted(n), "attribute")
        elif isinstance(n, ast.Name):
            put(n.lineno, n.col_offset, n.id, n.id, "name")
    for (line, col), (name, qualname, kind) in sorted(found.items()):
        yield path, name, qualname, kind, line, col


_LOOSE = re.compile(r"^([ \t]*)(?:export[ \t]+)?(?:async[ \t]+)?(def|class|function|func|fn|struct|interface)[ \t]+([A-Za-z_]\w*)", re.M)


def loose_definitions(path: str, source: str) -> Iterator[tuple]:
    """For languages without a provider: lines that look like definitions, each up to the next."""
    heads = list(_LOOSE.finditer(source))
    total = source.count("\n") + 1
    for i, m in enumerate(heads):
        start = source.count("\n", 0, m.start(3)) + 1
        end = source.count("\n", 0, heads[i + 1].start(3)) if i + 1 < len(heads) else total
        body = "\n".join(source.split("\n")[start - 1 : end])
        yield path, m[3], m[3], "class" if m[2] in ("class", "struct", "interface") else "function", start, end, None, _digest(re.sub(r"\s+", " ", body)), _digest(body)


Provider = tuple[str, Callable[[str, str], Iterator[tuple]], Callable[[str, str], Iterator[tuple]] | None]
#: (glob, definitions, references), the first that claims a path has it.
PROVIDERS: list[Provider] = [("*.py", python_definitions, python_references), ("*.pyi", python_definitions, python_references)]
LOOSE_GLOBS = ("*.js", "*.ts", "*.go", "*.rs", "*.java", "*.kt", "*.swift", "*.php")


def provider(path: str) -> Provider | None:
    found = next((p for p in PROVIDERS if fnmatch(path, p[0])), None)
    return found or (("", loose_definitions, None) if any(fnmatch(path, g) for g in LOOSE_GLOBS) else None)
