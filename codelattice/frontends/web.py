"""Scanners for CSS and HTML: selectors and custom properties, anchors and class references."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from .base import Brackets, Call, Definition, Lines, Scan, blank, clean_doc, comment_above, signature

NAME = r"-?[A-Za-z_\u0080-\uffff][\w\u0080-\uffff-]*"
NOTHING = re.compile(r"\s*")


def selector_names(selector: str) -> list[str]:
    """Classes and ids that one selector, without commas, styles: of its last compound, and of the first where there are just two."""
    parts = [p for p in re.split(r"\s*([>+~])\s*|\s+", re.sub(r"\([^)]*\)|\[[^\]]*\]", "", selector.strip())) if p]
    steps = [p for p in parts if p in (">", "+", "~")]
    compounds = [p for p in parts if p not in (">", "+", "~")]
    if not compounds or any(s in "+~" for s in steps[-1:]):
        return []

    def own(compound: str, ids: bool, pseudo: bool) -> list[str]:
        plain, _, after = compound.partition(":")
        if after and not pseudo:
            return []
        last = re.search(rf"([.#])({NAME})$", plain)
        return [last[2]] if last and (last[1] == "." or ids and not after) else []

    if len(compounds) == 1:
        return own(compounds[0], True, True)
    by_child = parts[-2] == ">"
    names = own(compounds[-1], not by_child, False)
    if len(compounds) == 2 and (by_child or not steps):
        names = own(compounds[0], not by_child, False) + names
    return names


def scan_css(text: str, in_test_file: bool) -> Scan:
    comments = [m.span() for m in re.finditer(r"/\*.*?(?:\*/|\Z)|(?<![:\w])//[^\n]*", text, re.S)]
    strings = [(m.start() + 1, m.end() - 1) for m in re.finditer(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", blank(text, comments))]
    code = blank(text, [*comments, *strings])
    brackets, out = Brackets(code), Scan()
    out.lost, out.regions = brackets.loose, brackets.regions
    for m in re.finditer(r"\{", code):
        begin = max(code.rfind(c, 0, m.start()) for c in "{};") + 1
        head = code[begin : m.start()]
        if not head.strip() or head.lstrip().startswith("@"):
            continue
        start, end = begin + len(head) - len(head.lstrip()), brackets.end(m.start(), len(code))
        doc = clean_doc(comment_above(text, start, comments, NOTHING))
        for selector in re.split(r",(?![^(]*\))", head):
            out.definitions += [Definition(n, start, end, signature(text[start:end]), doc) for n in selector_names(selector)]
    for m in re.finditer(r"(?<=[{};\s])(--[\w-]+)\s*:[^;{}]*;?", code):
        out.definitions.append(Definition(m[1], m.start(), m.end(), signature(text[m.start() : m.end()]), clean_doc(comment_above(text, m.start(), comments, NOTHING))))
    out.definitions.sort(key=lambda d: d.start)
    out.calls = [Call(m[1], m.start(1)) for m in re.finditer(r"\bvar\(\s*(--[\w-]+)", code)]
    return out


class _Html(HTMLParser):
    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self, text: str):
        super().__init__(convert_charrefs=False)
        self.text, self.starts, self.out, self.open = text, Lines(text).starts, Scan(), []
        self.feed(text)
        self.close()
        for _, start, name in self.open:
            if name is not None:
                self._anchor(name, start, len(text))
        self.out.definitions.sort(key=lambda d: d.start)

    def _place(self) -> int:
        line, column = self.getpos()
        return self.starts[line - 1] + column

    def _anchor(self, name: str, start: int, end: int) -> None:
        self.out.definitions.append(Definition(name, start, end, signature(self.text[start:end])))

    def _quoted(self, attribute: str) -> list[tuple[str, int]]:
        tag, at = self.get_starttag_text() or "", self._place()
        return [(m[2], at + m.start(2)) for m in re.finditer(rf"(?<=[\s\"'])(?:{attribute})\s*=\s*([\"'])(.*?)\1", tag, re.S)]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        start = self._place()
        self.out.calls += [Call(value, at) for value, at in self._quoted("class")]
        name = next((v for v, _ in self._quoted("id") if v), None)
        if tag in self.VOID:
            if name:
                self._anchor(name, start, start + len(self.get_starttag_text() or ""))
        else:
            self.open.append((tag, start, name))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.out.calls += [Call(value, at) for value, at in self._quoted("class")]

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _, _ in self.open):
            end = self.text.find(">", self._place()) + 1 or len(self.text)
            while self.open:
                t, start, name = self.open.pop()
                if name is not None:
                    self._anchor(name, start, end)
                if t == tag:
                    break


def scan_html(text: str, in_test_file: bool) -> Scan:
    return _Html(text).out
