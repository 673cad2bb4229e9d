"""Scanner for Python: the syntax tree of a file that compiles, else patterns and indentation."""

from __future__ import annotations

import ast
import re
import warnings

from .base import Call, Definition, Scan, clean_doc, signature


def scan_python(text: str, in_test_file: bool) -> Scan:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
        return _by_lines(text, getattr(error, "lineno", None) or 1)
    starts = [0]
    for line in text.splitlines(keepends=True):
        starts.append(starts[-1] + len(line))
    lines = text.splitlines(keepends=True)

    def place(row: int, column: int) -> int:
        """From the tree's row and byte column."""
        return starts[row - 1] + len(lines[row - 1].encode()[:column].decode(errors="ignore")) if row <= len(lines) else len(text)

    out = Scan()
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            start, end = place(node.lineno, node.col_offset), place(node.end_lineno, node.end_col_offset)
            first = node.body[0]
            doc = ""
            if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
                doc = text[place(first.lineno, first.col_offset) : place(first.end_lineno, first.end_col_offset)]
            d = Definition(node.name, start, end, signature(text[start:end]), clean_doc(doc), scope=not isinstance(node, ast.ClassDef))
            (out.types if isinstance(node, ast.ClassDef) else out.definitions).append(d)
        elif isinstance(node, ast.Call):
            f = node.func
            if isinstance(f, ast.Name):
                out.calls.append(Call(f.id, place(f.lineno, f.col_offset)))
            elif isinstance(f, ast.Attribute) and isinstance(f.value, (ast.Name, ast.Attribute)):
                at = place(f.end_lineno, f.end_col_offset) - len(f.attr)
                out.calls.append(Call(f.attr, at, f.value.id if isinstance(f.value, ast.Name) else None))
        elif isinstance(node, ast.ImportFrom):
            plain = [a.name for a in node.names if not a.asname and a.name != "*"]
            module = node.module if not node.level else None
            out.imports += [(n, module) for n in plain]
        elif isinstance(node, ast.Import):
            out.imports += [(part, None) for a in node.names if not a.asname for part in a.name.split(".")]
    for found in (out.definitions, out.types):
        found.sort(key=lambda d: d.start)
    return out


def _by_lines(text: str, bad_line: int) -> Scan:
    """What patterns find in a file that doesn't compile; a definition ends where the indentation falls back."""
    out, at, lines = Scan(lost=1, regions=1), 0, text.splitlines(keepends=True)
    starts = []
    for line in lines:
        starts.append(at)
        at += len(line)
    for k, line in enumerate(lines):
        m = re.match(r"([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+(\w+)", line)
        if m:
            depth, last = len(m[1].expandtabs()), k
            for j in range(k + 1, len(lines)):
                if lines[j].strip():
                    if len(lines[j]) - len(lines[j].lstrip()) <= depth:
                        break
                    last = j
            start, end = starts[k] + len(m[1]), starts[last] + len(lines[last])
            d = Definition(m[3], start, end, signature(text[start:end]), scope=m[2] == "def")
            (out.definitions if m[2] == "def" else out.types).append(d)
            continue
        m = re.match(r"[ \t]*from[ \t]+(\.*)([\w.]*)[ \t]+import[ \t]+([\w, \t]+)$", line.rstrip())
        if m:
            out.imports += [(n.strip(), None if m[1] else m[2]) for n in m[3].split(",") if re.fullmatch(r"\w+", n.strip())]
            continue
        code = re.sub(r"#.*|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", lambda s: " " * len(s[0]), line)
        for c in re.finditer(r"(?<![\w.)\]])(?:((?:\w+\.)*?)(\w+)\.)?([A-Za-z_]\w*)[ \t]*\(", code):
            if c[3] not in ("if", "elif", "while", "return", "and", "or", "not", "in", "for", "with", "assert", "yield", "lambda", "print_") and not (c[2] or "").isdigit():
                out.calls.append(Call(c[3], starts[k] + c.start(3), c[2] if c[2] and not c[1] else None))
    known = [(d.start, d.end) for d in out.definitions + out.types]
    place = starts[min(bad_line, len(starts)) - 1] if starts else 0
    inside = [b - a for a, b in known if a <= place < b]
    out.lost = max(1, text.count("\n", place, place + min(inside))) if inside else max(1, text.count("\n", place))
    return out
