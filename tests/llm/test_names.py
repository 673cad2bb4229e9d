"""Names next to punctuation, against the pattern of names run over whole texts."""

import re

import pytest

from codelattice.llm import pii

TEXTS = [
    "(Mary Smith)", '"John Brown"', "Contact:Anna Schmidt", "see [Mr. Miller]", "—Dr Weber said", "«госпожа Иванова»", "x/Prof. Klein", "(Señor García)", "'Γιώργος Παπαδάκης'",
    "a,Maria b,Peter Stone;", "_Mary Smith", "Mary-Ann Smith", "xMary Smith", "Mary  Smith", "Dr.Miller", "Mr.\tMiller", "Mary.", "Mary", "no name", "",
]


@pytest.mark.parametrize("text", TEXTS)
def test_names_beside_punctuation(text):
    found = [m.span(g) for m in pii.NAME.finditer(text) for g in m.groupdict() if m[g] and g != "title"]
    assert [(a, b) for a, b, _ in pii.entities(text)] == found


def test_a_name_is_replaced_alike_in_brackets_and_in_the_open(spark):
    docs = spark.createDataFrame([(1, "(Mary Smith)"), (2, "so Mary Smith came"), (3, "Contact:Mary Smith")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.replace(docs, b"k").collect()}
    assert all(r["n_name"] == 1 for r in got.values())
    name = got[1]["text"][1:-1]
    assert name != "Mary Smith" and got[2]["text"] == f"so {name} came" and got[3]["text"] == f"Contact:{name}"
    assert {r["kind"]: (r["entities"], r["surrogates"], r["real"]) for r in pii.distinctness(docs, b"k").collect()} == {"name": (1, 1, 0)}


def test_no_entity_stays_and_none_meet():
    """Every name of the lists, all short surnames, and whole small domains: a bijection without a fixed point."""
    for key in (b"codelattice", b"k"):
        made = pii.Surrogates(key)
        letters = "abcdefghijklmnopqrstuvwxyz"
        for values in ([n.lower() for n in pii._GIVEN], list(letters), [a + b for a in letters for b in letters], [a + b + "n" for a in letters for b in "aeiou"], ["כהן", "לוי", "王", "李明", "김", "محمد", "शर्मा", "ő", "žižek"]):
            got = [made.name(v) for v in values]
            assert not [v for v, g in zip(values, got) if v == g] and len(set(got)) == len(set(values))
        for size in (2, 3, 10, 997):
            got = [made.permute(i, size, "t") for i in range(size)]
            assert sorted(got) == list(range(size)) and all(i != g for i, g in enumerate(got))
        for kind, values in (("ip", ["10.0.0.1", "192.168.0.1", "172.16.0.9", "127.0.0.1", "8.8.8.8", "240.0.0.1"]), ("ssn", ["000000000", "123456789"]), ("email", ["a@b.c", "a@mail.example.com", "x.y@z.org"]), ("card", ["4111111111111111"]), ("phone", ["4995556503"])):
            got = [made.of(kind, v) for v in values]
            assert not set(got) & set(values) and len(set(got)) == len(values)
            if kind == "ip":
                assert [pii.network(int.from_bytes(bytes(map(int, g.split("."))), "big")) for g in got] == [1, 3, 2, 4, 5, 6]


@pytest.mark.parametrize("text,people", [
    ("Mary Smith came. Mary spoke; Smith left. MARY SMITH and mary smith, Smith, Mary.", [["Mary", "mary", "MARY"], ["Smith", "smith", "SMITH"]]),
    ("Иванова Мария пришла, Мария ушла. МАРИЯ ИВАНОВА", [["Мария", "МАРИЯ"], ["Иванова", "ИВАНОВА"]]),
    ("Smith, Mary; born", [["Mary"], ["Smith"]]),
    ("Mr. Li said that Li and LI are one, not like.", [["Li", "LI"]]),
    ("王小明先生来了。", [["王小明"]]), ("قال السيد محمد علي", [["محمد"], ["علي"]]), ("מר כהן הגיע", [["כהן"]]),
])
def test_every_mention_of_a_person_changes_alike(text, people):
    made = pii.Surrogates(b"k")
    out, _ = pii.rewrite(text, made)
    for forms in people:
        new = made.name(forms[0].lower())
        for form in forms:
            written = pii.as_written(form, new)
            assert len(re.findall(rf"(?<!\w){form}(?!\w)", out)) == 0 or written == form or form in text and "先生" in text
            assert written in out
        assert not re.search(rf"(?<!\w){forms[0]}(?!\w)", out)
    assert not any(re.search(rf"(?<!\w){f}(?!\w)", out) for forms in people for f in forms)


def test_common_words_stay():
    text = "The white paper of Mr White. A mark on the paul and a petra without names; New York, Then June. However, Mary and Then, Mary."
    out, counts = pii.rewrite(text, pii.Surrogates(b"k"))
    assert counts["name"] == 1 and out.startswith("The white paper of Mr ") and out.endswith("A mark on the paul and a petra without names; New York, Then June. However, Mary and Then, Mary.")


def test_replace_equals_a_plain_rewrite(spark, real, odd):
    for docs in (real, odd):
        want = sorted((str(r["doc_id"]), *map(str, (lambda t, c: (t, c))(*pii.rewrite(r["text"], pii.Surrogates(b"k"))))) for r in docs.collect())
        got = sorted((str(r["doc_id"]), str(r["text"]), str({k: r[f"n_{k}"] for k in pii.KINDS})) for r in pii.replace(docs, b"k", epochs=1).collect())
        assert got == want
