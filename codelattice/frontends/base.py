"""What every language's scanner returns, and what they share: masking, brackets, scopes, names and docs."""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from ..functions.names import DOC_CHARS, TEST_PATH
from ..schema import FILE, FUNCTION, TEST, TYPE


@dataclass
class Definition:
    """A named stretch of a file. scope: calls inside belong to it."""

    name: str
    start: int
    end: int
    signature: str = ""
    doc: str = ""
    marked_test: bool = False
    scope: bool = True


@dataclass
class Call:
    callee: str
    at: int
    qualifier: str | None = None


@dataclass
class Scan:
    """A scanner's findings. lost: lines of the longest stretch that it couldn't read, 0 if none."""

    definitions: list[Definition] = field(default_factory=list)
    types: list[Definition] = field(default_factory=list)
    calls: list[Call] = field(default_factory=list)
    imports: list[tuple[str, str | None]] = field(default_factory=list)
    lost: int = 0
    regions: int = 0


@dataclass(frozen=True)
class Language:
    """How files of a language are read and their calls bound."""

    name: str
    extensions: tuple[str, ...]
    scan: Callable[[str, bool], Scan]
    kind: str = FUNCTION
    test_prefixes: tuple[str, ...] = ()
    resolve: tuple[str, ...] = ()
    merge_repeats: bool = False
    file_node: bool = False
    separator: str | None = None
    prepare: Callable[[str], str] | None = None

    @property
    def family(self) -> tuple[str, ...]:
        return self.resolve or (self.name,)


_TEST = re.compile(TEST_PATH)


def is_test_path(path: str) -> bool:
    return bool(_TEST.search(re.sub("[A-Z]", lambda m: m[0].lower(), path)))


def signature(text: str) -> str:
    """The start of a definition: up to the first brace, else the first line, with single spaces."""
    brace, line = text.find("{"), text.find("\n")
    end = brace if brace >= 0 else line if line >= 0 else len(text)
    return " ".join(text[:end].split())


def clean_doc(text: str) -> str:
    """A comment's words without its marks, up to the cap."""
    words = (w.strip('/#*"') for w in text.split())
    return " ".join(w for w in words if w)[:DOC_CHARS]


class Lines:
    """Line numbers from 1 on by place."""

    def __init__(self, text: str):
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def __call__(self, place: int) -> int:
        return bisect.bisect_right(self.starts, place)


def blank(text: str, spans: Iterable[tuple[int, int]]) -> str:
    """text with stretches blanked, all places and line ends kept."""
    out, at = [], 0
    for a, b in sorted(spans):
        if b <= at:
            continue
        a = max(a, at)
        out += [text[at:a], re.sub(r"[^\n]", " ", text[a:b])]
        at = b
    return "".join([*out, text[at:]])


class Brackets:
    """Matching brackets of masked text; `loose` counts lines after the first one that has no partner."""

    def __init__(self, masked: str):
        self.partner: dict[int, int] = {}
        pairs, open_ = {")": "(", "]": "[", "}": "{"}, []
        bad = None
        for m in re.finditer(r"[()\[\]{}]", masked):
            c = m[0]
            if c in "([{":
                open_.append((c, m.start()))
            elif open_ and open_[-1][0] == pairs[c]:
                self.partner[open_.pop()[1]] = m.start()
            elif bad is None:
                bad = m.start()
        if open_:
            bad = open_[0][1] if bad is None else min(bad, open_[0][1])
        self.loose = 0 if bad is None else masked.count("\n", bad) + 1
        self.regions = 0 if bad is None else max(1, len(open_))

    def end(self, place: int, length: int) -> int:
        """Just past the partner of the bracket at a place; the file's end if it has none."""
        return self.partner.get(place, length - 1) + 1


def comment_above(text: str, start: int, comments: list[tuple[int, int]], skip: re.Pattern) -> str:
    """The comments that stand right above a place, over lines that only decorate what follows."""
    found, at = [], start
    ends = [b for _, b in comments]
    while True:
        k = bisect.bisect_right(ends, at) - 1
        if k >= 0 and skip.fullmatch(text, comments[k][1], at):
            a, b = comments[k]
            found.append(text[a:b])
            at = a
        else:
            return " ".join(reversed(found))


def dedup_imports(found: list[tuple[str, str | None]]) -> list[tuple[str, str | None]]:
    """Each pair once; a name without a module only if it has none anywhere."""
    known = {n for n, m in found if m is not None}
    return list(dict.fromkeys((n, m) for n, m in found if m is not None or n not in known))


def parse(language: Language, path: str, source: str) -> dict:
    """A file's rows: nodes, raw_calls, imports (lists of dicts), and a warning if something was probably missed."""
    text = language.prepare(source) if language.prepare else source
    in_test_file = is_test_path(path)
    scan, line = language.scan(text, in_test_file), Lines(text)
    nodes, seen, scopes = [], set(), []
    if language.file_node:
        nodes.append(dict(qualified_name=f"{path}::<file>", kind=FILE, name=path, file=path, line_start=1, line_end=max(1, len(source.splitlines())), language=language.name, signature="", doc="", is_test=in_test_file))

    def add(d: Definition, kind: str, test: bool) -> None:
        base = f"{path}::{d.name}"
        repeated = base in seen
        if not (repeated and language.merge_repeats and kind != TYPE):
            name = f"{base}#L{line(d.start)}" if repeated else base
            seen.add(base)
            nodes.append(dict(qualified_name=name, kind=kind, name=d.name, file=path, line_start=line(d.start), line_end=line(max(d.start, d.end - 1)), language=language.name, signature=d.signature, doc=d.doc, is_test=test))
        else:
            name = base
        if kind != TYPE and d.scope:
            scopes.append((d.start, d.end, name))

    for d in scan.definitions:
        test = in_test_file or d.marked_test or d.name.startswith(language.test_prefixes or ("\0",))
        add(d, TEST if test else language.kind, test)
    for d in scan.types:
        add(d, TYPE, in_test_file)

    calls, ahead, around = [], sorted(((a, b, k, n) for k, (a, b, n) in enumerate(scopes)), reverse=True), []
    for c in sorted(scan.calls, key=lambda c: c.at):
        while ahead and ahead[-1][0] <= c.at:  # scopes that have begun; those that have ended go
            a, b, k, n = ahead.pop()
            around.append((b - a, k, n, b))
        around = [x for x in around if x[3] > c.at]
        caller = min(around)[2] if around else f"{path}::<file>"
        for name in c.callee.split(language.separator) if language.separator else [c.callee]:
            if name:
                calls.append(dict(file=path, caller=caller, callee=name, line=line(c.at), qualifier=c.qualifier, ord=len(calls)))
    extracted = len(nodes) - language.file_node + len(calls)
    warning = None
    if scan.lost and extracted <= 1:
        warning = f"brackets don't match; {extracted} finding(s) in all, so most of the file is not in the graph"
    elif scan.lost > 1:
        warning = f"brackets don't match in {scan.regions} place(s); up to {scan.lost} unreadable lines are not in the graph"
    return {"nodes": nodes, "raw_calls": calls, "imports": [dict(file=path, name=n, module=m) for n, m in dedup_imports(scan.imports)], "warning": warning}
