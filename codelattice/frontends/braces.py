"""Scanners for Rust, Go and TypeScript: patterns over text whose comments and strings are blanked, with matched brackets."""

from __future__ import annotations

import bisect
import re

from .base import Brackets, Call, Definition, Scan, blank, clean_doc, comment_above, signature

COMMENT = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
RUST = re.compile(rf"(?P<c>{COMMENT})|(?P<s>\bb?r(?P<h>#*)\".*?\"(?P=h)|b?\"(?:\\.|[^\"\\])*\"|b?'(?:\\(?:u\{{[^}}]*\}}|x..|.)|[^'\\\n])')", re.S)
GO = re.compile(rf"(?P<c>{COMMENT})|(?P<s>\"(?:\\.|[^\"\\\n])*\"|`[^`]*`|'(?:\\.|[^'\\\n])+')", re.S)
TS_TOKEN = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|[`{}/]|[\w$]+|[^\s\w$]", re.S)
TS_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])*/[a-z]*")
TS_PIECE = re.compile(r"(?:\\.|[^`\\$]|\$(?!\{))*", re.S)
#: Words after which a slash begins a pattern, not a division.
TS_BEFORE_REGEX = frozenset("await case delete do else in instanceof new of return throw typeof void yield".split())
WORDS = {
    "rust": frozenset("as async await box break const continue crate dyn else enum extern fn for if impl in let loop match mod move mut pub ref return static struct super trait type unsafe use where while yield".split()),
    "go": frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()),
    "ts": frozenset("await case catch class const debugger delete do else enum export extends finally for function if import in instanceof let new of return super switch this throw try typeof var void while with yield".split()),
}
DECORATION = re.compile(r"\s*(?:(?:#!?\[[^\n]*\]|@[\w.]+(?:\([^\n]*\))?|export|default|async|abstract|declare)\s*)*")


def masked(text: str, pattern: re.Pattern) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]]]:
    """text without comments and strings' contents; the places of both."""
    comments, strings = [], []
    for m in pattern.finditer(text):
        (comments if m["c"] is not None else strings).append(m.span())
    return blank(text, [*comments, *((a + 1, b - 1) for a, b in strings)]), comments, strings


def masked_ts(text: str) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]]]:
    """Like masked(), where templates keep the code in their substitutions and patterns count as strings. One pass over the text."""
    comments, strings, hidden, depth = [], [], [], []  # depth: open braces since each open substitution
    at, last = 0, ""

    def template(start: int, opened: int | None) -> int:
        """Past the stretch of a template that begins at start: after its end, or after the start of a substitution."""
        end = TS_PIECE.match(text, start).end()
        hidden.append((start, end))
        if text.startswith("${", end):
            depth.append(0)
            return end + 2
        if opened is not None:
            strings.append((opened, end + 1))
        return end + 1

    while m := TS_TOKEN.search(text, at):
        token, at = m[0], m.end()
        if token.startswith(("//", "/*")):
            comments.append(m.span())
            continue
        if token[0] in "\"'":
            strings.append(m.span())
            hidden.append((m.start() + 1, at - 1))
        elif token == "`":
            at = template(at, m.start())
        elif token == "/" and (not last or last[-1] in "(,=:[!&|?{};+-*%~^<>" or last in TS_BEFORE_REGEX):
            if r := TS_REGEX.match(text, m.start()):
                at, token = r.end(), ")"
                hidden.append(r.span())
        elif token in "{}" and depth:
            depth[-1] += 1 if token == "{" else -1
            if depth[-1] < 0:
                depth.pop()
                at, token = template(at, None), "`"
        last = token
    return blank(text, [*comments, *((a, b) for a, b in hidden if b > a)]), comments, strings


def last_solid(code: str, at: int) -> int:
    """Place of the last character before a place that isn't white space; -1 if there is none."""
    at -= 1
    while at >= 0 and code[at].isspace():
        at -= 1
    return at


def body(plain: str, at: int, brackets: Brackets) -> int | None:
    """Place of the brace that opens a definition's body after its head; null if a semicolon ends it first."""
    while at < len(plain):
        c = plain[at]
        if c == "{":
            return at
        if c in ";}":
            return None
        at = brackets.end(at, len(plain)) if c in "([" else at + 1
    return None


def attribute_marks(text: str, names: tuple[str, ...]) -> bool:
    """Whether an attribute, without its brackets, is one of the names or a path that ends in one."""
    inner = re.sub(r"\s", "", text)
    return any(inner == n or inner.endswith(("::" + n, "." + n)) for n in names)


# Attributes that mark test code.
RUST_TESTS = ("test", "cfg(test)", "rstest", "proptest")


def scan_rust(text: str, in_test_file: bool) -> Scan:
    plain, comments, _ = masked(text, RUST)
    attributes = [m.span() for m in re.finditer(r"#!?\[(?:[^\[\]]|\[[^\]]*\])*\]", plain)]
    code = blank(plain, attributes)
    brackets, out = Brackets(code), Scan()
    out.lost, out.regions = brackets.loose, brackets.regions
    macros = []
    for m in re.finditer(r"\b\w+!\s*(?:\w+\s*)?([(\[{])", code):
        macros.append((m.start(1), brackets.end(m.start(1), len(code))))
    code = blank(code, macros)

    limits, begins = [m.start() for m in re.finditer("[;{}]", code)], [x for x, _ in attributes]

    def head(at: int) -> int:
        """Where the item at a place begins, attributes included."""
        k = bisect.bisect_left(limits, at)
        return limits[k - 1] + 1 if k else 0

    def marked(a: int, b: int) -> bool:
        return any(attribute_marks(text[x:y].lstrip("#!")[1:-1], RUST_TESTS) for x, y in attributes[bisect.bisect_left(begins, a) : bisect.bisect_left(begins, b)])

    blocks = [(m.start(), brackets.end(m.start(), len(code)), marked(head(m.start()), m.start())) for m in re.finditer(r"\{", code)]
    tested = [(a, b) for a, b, t in blocks if t]
    for m in re.finditer(r"(?:\bpub(?:\s*\([^)]*\))?\s+)?(?:\b(?:const|async|unsafe|extern(?:\s*\"[^\"]*\")?|default)\s+)*\bfn\s+(\w+)", code):
        opened = body(code, m.end(), brackets)
        if opened is None:
            continue
        end = brackets.end(opened, len(code))
        test = marked(head(m.start()), m.start()) or any(a <= m.start() < b for a, b in tested)
        out.definitions.append(Definition(m[1], m.start(), end, signature(text[m.start() : end]), clean_doc(comment_above(text, m.start(), comments, DECORATION)), test))
    for m in re.finditer(r"(?:\bpub(?:\s*\([^)]*\))?\s+)?(?:\bunsafe\s+)?\b(struct|enum|trait)\s+(\w+)|(?:\bunsafe\s+)?\bimpl\b(?:\s*<(?:[^<>]|<[^<>]*>)*>)?\s+(?:[^{};]*?\bfor\s+)?(\w+)\s*(?:where\b[^{]*)?(?=\{)", code):
        opened = body(code, m.end(), brackets)
        end = brackets.end(opened, len(code)) if opened is not None else code.find(";", m.end()) + 1 or len(code)
        out.types.append(Definition(m[2] or m[3], m.start(), end, signature(text[m.start() : end]), clean_doc(comment_above(text, m.start(), comments, DECORATION)), scope=False))
    for m in re.finditer(r"(?P<path>(?:\w+\s*::\s*)*)(?<![\w!])(?P<dot>\.\s*)?(?P<name>[A-Za-z_]\w*)\s*\(", code):
        if m["name"] in WORDS["rust"] or re.search(r"\bfn\s+$", code[max(0, m.start("name") - 8) : m.start("name")]):
            continue
        parts = [p.strip() for p in m["path"].split("::") if p.strip()]
        if m["dot"] or not parts:
            k = last_solid(code, m.start("name"))
            if not m["dot"] and code[max(0, k - 1) : k + 1] == "::":
                continue  # a path that ends in generic arguments
            out.calls.append(Call(m["name"], m.start("name")))
        elif parts[-1] not in ("crate", "super", "self"):
            out.calls.append(Call(m["name"], m.start("name"), parts[-1]))
    for m in re.finditer(r"\buse\s+((?:\w+\s*::\s*)+)(?:(\w+)\s*;|\{([^{}]*)\}\s*;)", code):
        module = re.sub(r"\s", "", m[1])[:-2]
        names = [m[2]] if m[2] else [n.strip() for n in m[3].split(",")]
        out.imports += [(n, module) for n in names if re.fullmatch(r"\w+", n) and n not in ("self", "crate", "super")]
    return out


def scan_go(text: str, in_test_file: bool) -> Scan:
    code, comments, _ = masked(text, GO)
    brackets, out = Brackets(code), Scan()
    out.lost, out.regions = brackets.loose, brackets.regions
    heads = set()
    for m in re.finditer(r"^func\s+(?:\([^)]*\)\s*)?(\w+)", code, re.M):
        heads.add(m.start(1))
        opened = _go_body(code, m.end(), brackets)
        if opened is None:
            continue
        end = brackets.end(opened, len(code))
        out.definitions.append(Definition(m[1], m.start(), end, signature(text[m.start() : end]), clean_doc(comment_above(text, m.start(), comments, DECORATION))))
    for m in re.finditer(r"^type\s+(?:(\w+)\b|(\())", code, re.M):
        if m[2]:
            end = brackets.end(m.start(2), len(code))
            names = re.findall(r"^[ \t]*(\w+)[ \t]+[\w*\[({]", _flat(code, m.start(2) + 1, end - 1, brackets), re.M)
        else:
            line_end = code.find("\n", m.end())
            opened = code.find("{", m.end(), line_end if line_end >= 0 else len(code))
            end = brackets.end(opened, len(code)) if opened >= 0 else (line_end if line_end >= 0 else len(code))
            names = [m[1]]
        doc = clean_doc(comment_above(text, m.start(), comments, DECORATION))
        out.types += [Definition(n, m.start(), end, signature(text[m.start() : end]), doc, scope=False) for n in names]
    listed = [(m.end(), brackets.end(m.end() - 1, len(code)) - 1) for m in re.finditer(r"\binterface\s*\{", code)]  # methods that an interface asks for aren't called
    out.calls = [c for c in _dotted_calls(blank(code, [(a, b) for a, b in listed if b > a]), WORDS["go"]) if c.at not in heads]
    return out


def _go_body(code: str, at: int, brackets: Brackets) -> int | None:
    """The body's brace: the last on the line where the head ends, after results such as interface{}."""
    while at < len(code):
        c = code[at]
        if c == "{":
            if re.search(r"\b(?:interface|struct)\s*$", code[max(0, at - 12) : at]):
                at = brackets.end(at, len(code))
                continue
            return at
        if c == "\n":
            return None
        at = brackets.end(at, len(code)) if c in "([" else at + 1
    return None


def _flat(code: str, start: int, end: int, brackets: Brackets) -> str:
    """A stretch without what stands in braces inside it."""
    inner = [(m.start() + 1, brackets.end(m.start(), len(code)) - 1) for m in re.finditer(r"\{", code[start:end])]
    return blank(code[start:end], [(a, b) for a, b in inner if b > a])


CALL = re.compile(r"(?<![\w$.)\]?])(?P<chain>(?:[A-Za-z_$][\w$]*\s*\.\s*)*)(?P<name>[A-Za-z_$][\w$]*)\s*\(")
#: The same with optional links and arguments of types.
TS_CALL = re.compile(r"(?<![\w$.)\]])(?P<chain>(?:[A-Za-z_$][\w$]*\s*\??\.\s*)*)(?P<name>[A-Za-z_$][\w$]*)(?:<[^<>()&;]*(?:<[^<>()&;]*>[^<>()&;]*)*>)?\s*(?:\?\.\s*)?\(")


def _dotted_calls(code: str, words: frozenset[str], call: re.Pattern = CALL) -> list[Call]:
    """foo(), x.foo() with its qualifier, x.y.foo() without; nothing after other expressions."""
    out = []
    for m in call.finditer(code):
        parts = [p.strip() for p in m["chain"].replace("?", "").split(".") if p.strip()]
        if not parts and m["name"] in words or any(p in words for p in parts[:-1]) and parts[0] != "this":
            continue
        if not parts:
            out.append(Call(m["name"], m.start("name")))
        elif len(parts) == 1:
            if parts[0] not in words:
                out.append(Call(m["name"], m.start("name"), parts[0]))
        else:
            out.append(Call(m["name"], m.start("name")))
    return out


TS_HEAD = re.compile(r"\s*(?::\s*[^;{}=]+?)?\s*\{")


def scan_typescript(text: str, in_test_file: bool) -> Scan:
    code, comments, strings = masked_ts(text)
    brackets, out = Brackets(code), Scan()
    out.lost, out.regions = brackets.loose, brackets.regions
    n, words, heads = len(code), WORDS["ts"], set()

    def define(name: str, at: int, start: int, end: int) -> None:
        heads.add(at)
        out.definitions.append(Definition(name, start, end, signature(text[start:end]), clean_doc(comment_above(text, start, comments, DECORATION))))

    for m in re.finditer(r"(?:\basync\s+)?\bfunction\s+([A-Za-z_$][\w$]*)", code):
        opened = body(code, m.end(), brackets)
        if opened is not None:
            define(m[1], m.start(1), m.start(), brackets.end(opened, n))
    for m in re.finditer(r"(?<![\w$.])((?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*\*?\s*)([A-Za-z_$][\w$]*)\s*(?:<[^<>()]*>)?\(", code):
        if m[2] in words or m.start(2) in heads:
            continue
        k = last_solid(code, m.start())
        if k >= 0 and code[k] not in "{};,/" and (not re.match(r"[\w\])\"'`]", code[k]) or "\n" not in code[k + 1 : m.start()]):
            continue
        after = brackets.end(m.end() - 1, n)
        head = TS_HEAD.match(code, after)
        if head:
            define(m[2], m.start(2), m.start(), brackets.end(head.end() - 1, n))
    if in_test_file:
        quoted = dict(strings)
        for m in re.finditer(r"(?<![\w$.])(test|it|bench)\s*\(\s*", code):
            if m.end() in quoted:
                end = brackets.end(code.index("(", m.start()), n)
                define(text[m.end() + 1 : quoted[m.end()] - 1], -1, m.start(), end)
    out.definitions.sort(key=lambda d: d.start)
    for m in re.finditer(r"(?:\babstract\s+)?\bclass\s+([A-Za-z_$][\w$]*)|\binterface\s+([A-Za-z_$][\w$]*)|(?<![\w$.])type\s+([A-Za-z_$][\w$]*)\s*(?:<[^=]*>)?\s*=", code):
        opened = code.find("{", m.end()) if not m[3] else -1
        end = brackets.end(opened, n) if opened >= 0 else next((x for x in (code.find(";", m.end()) + 1, code.find("\n", m.end())) if x > 0), n)
        out.types.append(Definition(m[1] or m[2] or m[3], m.start(), end, signature(text[m.start() : end]), clean_doc(comment_above(text, m.start(), comments, DECORATION)), scope=False))
    members = [(t.start, t.end) for t in out.types if code.startswith("interface", t.start)]
    for c in _dotted_calls(blank(code, members), words | {"async"}, TS_CALL):
        if c.at not in heads and not re.search(r"\b(?:new|function)\s+$", code[max(0, c.at - 60) : c.at].rsplit("\n", 1)[-1][-12:]) and c.qualifier != "this":
            out.calls.append(c)
    ends = dict(strings)
    for m in re.finditer(r"\bimport\s+(?:type\s+)?(?:[\w$]+\s*,\s*)?\{([^{}]*)\}\s*from\s*([\"'])", code):
        end = ends.get(m.start(2))
        if end:
            names = [re.sub(r"^type\s+", "", x.strip()).split(" as ")[0].strip() for x in m[1].split(",")]
            out.imports += [(x, text[m.start(2) + 1 : end - 1]) for x in names if x]
    return out


def astro_script(text: str) -> str:
    """The TypeScript of a component file on its own lines: the block between the first two fences, and scripts whose body is code."""
    lines, out, zone = text.lstrip("\ufeff").splitlines(), [], "start"
    inside = ""  # the lexical state that hides a fence: a template or a block comment
    for line in lines:
        stripped, kept = line.strip(), ""
        if zone == "start":
            zone = "front" if stripped == "---" else "start" if not stripped else "markup"
            fresh = zone == "front"
        else:
            fresh = False
        if zone == "front" and not fresh:
            if stripped == "---" and not inside:
                zone = "markup"
                fresh = True
            else:
                kept, inside = line, _lexical_state(line, inside)
        elif zone == "script":
            if re.search(r"</script\s*>", stripped):
                zone, fresh = "markup", True
            else:
                kept = line
        if zone == "markup" and not kept:
            tag = re.match(r"<script(?=[\s>/])([^>]*)>(.*)", stripped)
            if tag and _holds_code(tag[1]):
                closed = re.search(r"</script", tag[2])
                if closed:
                    kept = tag[2][: closed.start()]
                elif not fresh or "<script" in stripped:
                    zone = "script"
        out.append(kept)
    return "\n".join(out) + "\n"


def _holds_code(attributes: str) -> bool:
    if attributes.rstrip().endswith("/") or "set:html" in attributes:
        return False
    kind = re.search(r"type\s*=\s*[\"']?([^\"'\s>]*)", attributes)
    return not kind or kind[1] in ("", "module", "text/javascript", "application/javascript")


def _lexical_state(line: str, inside: str) -> str:
    at = 0
    token = re.compile(r"\\.|\*/|/\*|//|`|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'")
    while m := token.search(line, at):
        at = m.end()
        if inside == "`":
            inside = "" if m[0] == "`" else inside
        elif inside == "/*":
            inside = "" if m[0] == "*/" else inside
        elif m[0] == "//":
            break
        elif m[0] in ("`", "/*"):
            inside = m[0]
    return inside
