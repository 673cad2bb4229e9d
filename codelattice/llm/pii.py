"""Operator 3: personal data replaced by keyed surrogates of the same type, shape, script and gender.

An entity is reduced to a canonical form (case, punctuation and a country code don't tell entities
apart), and its letters and digits are permuted by a keyed bijection of all strings of the same
shape that leaves none in its place: a Feistel network over the shape's numbers, walked until it ends inside them, takes
a number to another one, whose successor goes back through the network. So equal entities get equal
surrogates in every document without any table (coreference), and different ones different
surrogates (distinctness). Before texts are rewritten, a pass over the distinct entities checks
that, and how many surrogates are entities that occur themselves; of a few epochs of the key the first without any, or the one with the fewest, is taken.

Names are replaced word by word, given names by given names of their script and gender. The words of a
document's names are replaced wherever they stand in it, alone, in capitals or the other way round.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

# Titles by gender, and given names by script and gender.
TITLES = {
    "m": "Mr Herr Monsieur Señor Sr Sir Don господин κύριος".split(),
    "f": "Mrs Ms Miss Frau Madame Mme Mademoiselle Señora Sra Señorita Lady Doña госпожа κυρία".split(),
    "": "Dr Prof Doctor Professor Rev Captain".split(),
}
GIVEN = {
    ("latin", "m"): "James John Robert Michael William David Richard Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew Peter Hans Klaus Jürgen Wolfgang Stefan Pierre Jean Michel Philippe Laurent José Juan Carlos Luis Miguel Javier Pedro".split(),
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Margaret Sandra Ashley Emily Anna Ursula Monika Petra Sabine Claudia Marie Nathalie Isabelle Sylvie Catherine Sophie María Carmen Ana Isabel Dolores Pilar Teresa".split(),
    ("cyrillic", "m"): "Александр Сергей Дмитрий Андрей Алексей Максим Иван Михаил Николай Владимир".split(),
    ("cyrillic", "f"): "Анна Елена Ольга Наталья Екатерина Мария Татьяна Ирина Светлана Юлия".split(),
    ("greek", "m"): "Γιώργος Δημήτρης Κώστας Γιάννης Νίκος Παναγιώτης Βασίλης Χρήστος".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Βασιλική Σοφία Αγγελική Γεωργία Δήμητρα".split(),
}
#: Letters that change places with each other: vowels with vowels, so that names stay readable.
CLASSES = ("0123456789", "aeiouy", "bcdfghjklmnpqrstvwxz", "àáâäãåèéêëìíîïòóôöõùúûü", "çñß", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь", "αεηιουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώ")
_CLASS = {c: (k, i) for k, letters in enumerate(CLASSES) for i, c in enumerate(letters)}
_GIVEN = {name: (place, i) for place, names in GIVEN.items() for i, name in enumerate(names)}
_TITLES = {t: g for g, titles in TITLES.items() for t in titles}
_CAPITAL = r"[A-ZÀ-ÖØ-ÞΆ-ΫА-ЯЁ][a-zß-öø-ÿά-ώа-яё'’-]+"
_LOUD = r"[A-ZÀ-ÖØ-ÞΆ-ΫА-ЯЁ]{2,}(?:['’-][A-ZÀ-ÖØ-ÞΆ-ΫА-ЯЁ]{2,})*"
# Forms of address in scripts without capitals, before and after a name.
ADDRESS_BEFORE = "السيد السيدة الدكتور الآنسة מר גברת ד״ר श्री श्रीमती डॉ".split()
ADDRESS_AFTER = "先生 女士 小姐 さん 様 씨 님".split()
#: A name of other scripts: one to three words beside a form of address; Han, Kana and Hangul names are at most four characters.
_OTHER = r"[\u0590-\u05FF\u0600-\u06FF\u0900-\u097F]{2,}"
_EAST = r"[\u4E00-\u9FFF\u3040-\u30FF\uAC00-\uD7AF]"
#: Endings of family names that may stand before a given name.
_SLAVIC = r"[А-ЯЁ][а-яё]+(?:ов|ев|ёв|ин|ын|енко|ук|юк)а?|[А-ЯЁ][а-яё]+(?:ск|цк)(?:ий|ая)"
#: NAME begins with one of these, or holds one of these marks.
_TRIGGERS = frozenset([*_TITLES, *_GIVEN, *(g.upper() for g in _GIVEN), *ADDRESS_BEFORE])
_MARKS = re.compile("|".join(ADDRESS_AFTER))
_WORDS = re.compile(r"\w+")

ENTITY = re.compile(
    r"(?P<email>[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
    r"|(?P<iban>\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<ip>(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9]))"
    r"|(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))"
    r"|(?P<phone>(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9]))"
    r"|(?P<card>(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z]))"
)
_ANY = "|".join(sorted(_GIVEN, key=len, reverse=True))
_UPPER = "|".join(sorted({g.upper() for g in _GIVEN}, key=len, reverse=True))
NAME = re.compile(
    rf"(?:\b(?P<title>{'|'.join(sorted(_TITLES, key=len, reverse=True))})\.? (?P<titled>{_CAPITAL}(?: {_CAPITAL}){{0,2}}))"
    rf"|(?:\b(?P<inverted>(?:{_SLAVIC}),? (?:{_ANY}))\b)|(?:\b(?P<comma>{_CAPITAL}, (?:{_ANY}))(?=\s*(?:[;\n(]|\Z)))|(?:\b(?P<named>(?:{_ANY}) {_CAPITAL}))|(?:\b(?P<loud>(?:{_UPPER}) {_LOUD})\b)"
    rf"|(?:(?<!\w)(?:{'|'.join(ADDRESS_BEFORE)}) (?P<other>{_OTHER}(?: {_OTHER}){{0,2}}))|(?P<east>(?<!{_EAST}){_EAST}{{1,4}}?)(?:{'|'.join(ADDRESS_AFTER)})"
)
KINDS = ("email", "phone", "ip", "card", "ssn", "iban", "name")


class Surrogates:
    """Replacements under one key and epoch."""

    def __init__(self, key: bytes, epoch: int = 0):
        self.key = hashlib.blake2b(key + b"/" + str(epoch).encode(), digest_size=32).digest()

    def _rounds(self, value: int, half: int, seed: bytes, back: bool) -> int:
        mask, left, right = (1 << half) - 1, value >> half, value & ((1 << half) - 1)
        for k in range(5, -1, -1) if back else range(6):
            inner = left if back else right
            got = hashlib.blake2b(seed + bytes([k]) + inner.to_bytes(half // 8 + 1, "big"), key=self.key, digest_size=min(64, half // 8 + 8)).digest()
            mixed = (right if back else left) ^ (int.from_bytes(got, "big") & mask)
            left, right = (mixed, left) if back else (right, mixed)
        return left << half | right

    def permute(self, value: int, size: int, tweak: str) -> int:
        """A bijection of 0 .. size - 1 that depends on key and tweak and runs through all of them before it returns, so none stays (but a single one)."""
        if size < 2:
            return value
        half, seed = max(4, ((size - 1).bit_length() + 1) // 2), tweak.encode()
        while (value := self._rounds(value, half, seed, False)) >= size:
            pass
        value = (value + 1) % size
        while (value := self._rounds(value, half, seed, True)) >= size:
            pass
        return value

    def letters(self, text: str, tweak: str) -> str:
        """text (lower case) with letters and digits permuted among strings of its shape; other characters stay."""
        places = [place_of(c) for c in text]
        shape = "".join("-" if p is None else p[0] for p in places)
        size, value = 1, 0
        for p in places:
            if p is not None:
                size, value = size * len(p[1]), value * len(p[1]) + p[2]
        value = self.permute(value, size, f"{tweak}/{shape}/" + "".join(c for c, p in zip(text, places) if p is None))
        out = []
        for c, p in zip(reversed(text), reversed(places)):
            if p is None:
                out.append(c)
            else:
                value, i = divmod(value, len(p[1]))
                out.append(p[1][i])
        return "".join(reversed(out))

    def digits(self, digits: str, tweak: str) -> str:
        return str(self.permute(int(digits), 10 ** len(digits), f"{tweak}/{len(digits)}")).zfill(len(digits))

    def of(self, kind: str, canonical: str) -> str:
        """The surrogate, in canonical form, of a canonical entity."""
        if kind == "email":
            local, _, domain = canonical.partition("@")
            *labels, top = domain.split(".")
            kept = 1 if labels and labels[-1] == "example" else 0  # reserved domains stay
            labels = [x if i >= len(labels) - kept else self.letters(x, "domain") for i, x in enumerate(labels)]
            return self.letters(local, "local") + "@" + ".".join([*labels, top])
        if kind == "ip":
            value = 0
            for x in canonical.split("."):
                value = value << 8 | int(x)
            group = network(value)
            if group in PRIVATE:
                first, size = PRIVATE[group]
                value = first + self.permute(value - first, size, f"ip/{group}")
            else:
                while True:  # the walk stays in the entity's kind of network, so it is a bijection of that
                    value = self.permute(value, 1 << 32, "ip")
                    if network(value) == group:
                        break
            return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))
        if kind == "card":  # the bank's first digit and the state of the check digit stay
            body, off = canonical[1:-1], (luhn(canonical[:-1]) - int(canonical[-1])) % 10
            first = canonical[0] + self.digits(body, f"card/{canonical[0]}/{off}")
            return first + str((luhn(first) - off) % 10)
        if kind == "iban":
            return canonical[:2] + self.digits(canonical[2:4], "iban check/" + canonical[4:]) + self.letters(canonical[4:].lower(), "iban").upper()
        if kind == "name":
            return " ".join(map(self.name, canonical.split(" ")))
        return self.digits(canonical, kind)

    def name(self, word: str) -> str:
        """A word of a name: a known given name becomes another of its script and gender; others keep their pattern of vowels and, if long enough, their last letter."""
        known = _GIVEN.get(word[:1].upper() + word[1:])
        if known:
            names = GIVEN[known[0]]
            return names[self.permute(known[1], len(names), "/".join(known[0]))].lower()
        kept = word[-1] if sum(place_of(c) is not None for c in word[:-1]) >= 2 else ""
        value = word
        while True:
            value = self.letters(value[: len(value) - len(kept)], f"name/{kept}") + kept
            if value[:1].upper() + value[1:] not in _GIVEN:
                return value


@functools.lru_cache(4096)
def place_of(c: str) -> tuple[str, str, int] | None:
    """The class of a letter or digit, the letters of it, and its place among them: those of CLASSES, else the letters of the same kind and script among 64 neighbours. Null for other characters."""
    if c in _CLASS:
        k, i = _CLASS[c]
        return chr(65 + k), CLASSES[k], i
    if not c.isalpha():
        return None
    kind, script, low = unicodedata.category(c), unicodedata.name(c, "").split(" ")[0], ord(c) & ~63
    members = "".join(x for x in map(chr, range(low, low + 64)) if unicodedata.category(x) == kind and x not in _CLASS and unicodedata.name(x, "").split(" ")[0] == script and x.lower() == x)
    return (f"<{low:x}{kind}>", members, members.index(c)) if c in members else None


#: First address and number of addresses of the private networks, by kind.
PRIVATE = {1: (10 << 24, 1 << 24), 2: (172 << 24 | 16 << 16, 1 << 20), 3: (192 << 24 | 168 << 16, 1 << 16), 4: (127 << 24, 1 << 24)}


def network(value: int) -> int:
    """Kinds of IPv4 addresses: private ranges, loopback, the rest of unicast, others."""
    a, b = value >> 24, value >> 16 & 255
    return 1 if a == 10 else 2 if a == 172 and 16 <= b < 32 else 3 if a == 192 and b == 168 else 4 if a == 127 else 5 if 0 < a < 224 else 6


def luhn(body: str) -> int:
    """The check digit that follows these digits."""
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def canonical(kind: str, text: str) -> str:
    if kind == "email":
        return text.lower()
    if kind == "ip":
        return ".".join(str(int(x)) for x in text.split("."))
    if kind == "iban":
        return text.replace(" ", "")
    if kind == "name":
        return " ".join(text.lower().replace(",", " ").split())
    digits = re.sub(r"[^0-9]", "", re.sub(r"^\+[0-9]{1,3}(?=[ .(-])", "", text) if kind == "phone" else text)
    return digits


def dressed(kind: str, text: str, plain: str) -> str:
    """A canonical surrogate in the format of the text that it replaces."""
    if kind == "ip":
        return plain
    start = re.match(r"\+[0-9]{1,3}(?=[ .(-])", text).end() if kind == "phone" and re.match(r"\+[0-9]{1,3}(?=[ .(-])", text) else 0
    if kind == "name":
        made = iter(plain.split(" "))
        return re.sub(r"[^\s,]+", lambda m: as_written(m[0], next(made)), text)
    out, source = list(text[:start]), iter(plain)
    for c in text[start:]:
        if kind == "email":
            n = next(source)
            out.append(n.upper() if c.isupper() else n)
        elif c.isdigit() or (kind == "iban" and c.isalpha()):
            out.append(next(source))
        else:
            out.append(c)
    return "".join(out)


def as_written(old: str, new: str) -> str:
    """new in the case of old: capitals, a capital at the start, or small letters."""
    if old.isupper() and len(old) > 1:
        return new.upper()
    return new[:1].upper() + new[1:] if old[:1].isupper() else new


def entities(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities of a whole text, in order and apart from each other.

    First those that a pattern finds. Then every other place of the words of its names: written with a
    capital or in capitals alone, in small letters only beside another word of the same name.
    """
    if not text:
        return []
    out = []
    if re.search("[0-9@]", text):
        for m in ENTITY.finditer(text):
            kind = m.lastgroup
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "iban" and sum(c.isdigit() for c in m[0]) < 10:
                continue
            out.append((m.start(), m.end(), kind))
    if not _TRIGGERS.isdisjoint(_WORDS.findall(text)) or _MARKS.search(text):
        found = [(m.start(g), m.end(g), "name") for m in NAME.finditer(text) if (g := next((g for g in ("titled", "inverted", "comma", "named", "loud", "other", "east") if m[g]), None))]
        out = apart(sorted([*out, *found]))
        names = [canonical("name", text[a:b]).split(" ") for a, b, kind in out if kind == "name"]
        if names:
            out = apart(sorted([*out, *mentions(text, names, out)]))
    return out


def apart(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Those that don't overlap one before them."""
    out: list[tuple[int, int, str]] = []
    for e in found:
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


def mentions(text: str, names: list[list[str]], taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Places of the words of names (lower case) outside those taken, one word each."""
    words = {w for name in names for w in name if len(w) > 1}
    beside = {(a, b) for name in names for a in name for b in name if a != b}
    if not words:
        return []
    hits = list(re.finditer(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(words, key=lambda w: (-len(w), w)))) + r")(?!\w)", text, re.I))
    covered = [a for a, _, _ in taken], [b for _, b, _ in taken]
    out = []
    for i, m in enumerate(hits):
        k = bisect.bisect_right(covered[0], m.start()) - 1
        if k >= 0 and covered[1][k] > m.start():
            continue
        near = any(0 <= j < len(hits) and (hits[i][0].lower(), hits[j][0].lower()) in beside and re.fullmatch(r",? ", text[min(hits[i].end(), hits[j].end()) : max(hits[i].start(), hits[j].start())]) for j in (i - 1, i + 1))
        if m[0][0].isupper() or near or m[0].lower() == m[0].upper():
            out.append((m.start(), m.end(), "name"))
    return out


def rewrite(text: str | None, made: Surrogates) -> tuple[str | None, dict[str, int]]:
    counts = dict.fromkeys(KINDS, 0)
    found = entities(text)
    if not found:
        return text, counts
    out, at = [], 0
    for start, end, kind in found:
        old = text[start:end]
        out += [text[at:start], dressed(kind, old, made.of(kind, canonical(kind, old)))]
        at = end
        counts[kind] += 1
    return "".join([*out, text[at:]]), counts


def distinctness(docs: DataFrame, key: bytes, epoch: int = 0) -> DataFrame:
    """kind, entities, surrogates, real: distinct canonical entities of all texts, distinct surrogates of them, and surrogates that are entities which occur themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Surrogates(key, epoch)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                got = {(kind, canonical(kind, t[a:b])) for t in batch.slice(k, 512).column(0).to_pylist() for a, b, kind in entities(t)}
                rows = sorted(got)
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([hashlib.blake2b(r[1].encode(), digest_size=16).hexdigest() for r in rows], pa.string()), pa.array([hashlib.blake2b(made.of(*r).encode(), digest_size=16).hexdigest() for r in rows], pa.string())], ["kind", "entity", "surrogate"])

    rows = cut(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "kind string, entity string, surrogate string").distinct())
    real = rows.select("kind", F.col("surrogate").alias("entity")).join(rows.select("kind", "entity"), ["kind", "entity"], "left_semi").groupBy("kind").agg(F.count("*").alias("real"))
    counts = rows.groupBy("kind", "surrogate").agg(F.count("*").alias("n")).groupBy("kind").agg(F.sum("n").alias("entities"), F.count("*").alias("surrogates"))
    return counts.join(real, "kind", "left").select("kind", "entities", "surrogates", F.coalesce("real", F.lit(0)).alias("real"))


def replace(docs: DataFrame, key: bytes, epochs: int = 4) -> DataFrame:
    """doc_id, text, n_chars and the number of replaced entities of each kind, for each row of docs.

    Texts without an entity come back unchanged; a null text stays null, an empty one empty. Null doc_ids are
    kept, repeated rows are rewritten alike, an empty table gives an empty result; other columns are dropped.
    An entity without a letter or digit that can change stays. Of `epochs` the one is taken whose surrogates meet fewest
    real entities: of given names and in small networks there are few, so in large corpora some always do.
    """
    best = None
    for epoch in range(epochs):
        got = distinctness(docs, key, epoch).agg(F.sum(F.col("entities") - F.col("surrogates")), F.sum("real")).head()
        if not got[0] and (best is None or (got[1] or 0) < best[0]):
            best = got[1] or 0, epoch
        if best and not best[0]:
            break
    if best is None:
        raise RuntimeError(f"surrogates met in {epochs} epochs of the key")
    epoch = best[1]
    schema = "text string, " + ", ".join(f"{k} int" for k in KINDS)

    @F.pandas_udf(schema)
    def rewritten(text: pd.Series) -> pd.DataFrame:
        made = Surrogates(key, epoch)
        got = [rewrite(t, made) for t in text]
        return pd.DataFrame({"text": [t for t, _ in got]} | {k: pd.Series([c[k] for _, c in got], dtype="int32") for k in KINDS})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), rewritten(F.col("text").cast("string")).alias("r"))
    return rows.select("doc_id", "r.text", F.length("r.text").cast("long").alias("n_chars"), *[F.col(f"r.{k}").alias(f"n_{k}") for k in KINDS])
