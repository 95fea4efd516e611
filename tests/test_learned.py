"""Learned values: one pass over a text finds what a search for each value finds."""

import random
import re
import time

import pytest

from wayfold.functions.manypatterns import Values, folded, replaced
from wayfold.operators import redact as X


def one_by_one(text, values):
    """Every value replaced on its own, longest first; places that are taken are hidden from the next."""
    marks, kept = list(text), []
    for value, replacement in sorted(values, key=lambda v: (-len(v[0]), v[0], v[1])):
        pattern = r"[ \t\n\x0b\f\r]+".join(re.escape(p) for p in value.split(" "))
        shown = "".join(marks)
        for m in re.finditer(pattern, shown, re.I):
            kept.append((m.start(), m.end(), replacement))
            marks[m.start() : m.end()] = "\0" * (m.end() - m.start())
    out, at = "", 0
    for s, e, r in sorted(kept):
        out, at = out + text[at:s] + r, e
    return out + text[at:]


@pytest.mark.parametrize("seed", range(5))
def test_one_pass_equals_a_search_for_each(seed):
    rng = random.Random(seed)
    for _ in range(200):
        values = [(" ".join("".join(rng.choice("abAé") for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 3))), f"<{i}>") for i in range(6)]
        values = list({v.lower(): (v, r) for v, r in values}.values())
        text = "".join(rng.choice(["a", "b", "A", "B", "É", "é", " ", "  ", "\n", "\t "]) for _ in range(60))
        assert replaced(text, Values(values).find(text)) == one_by_one(text, values)


def test_odd_letters_keep_their_places():
    text = "İstanbul  x\n\nASHA   RAO İ"
    assert folded(text)[0].endswith("asha rao İ")
    assert replaced(text, Values([("Asha Rao", "<NAME>")]).find(text)) == "İstanbul  x\n\n<NAME> İ"
    assert Values([]).find("abc") == [] and replaced("", []) == ""


def test_time_is_linear():
    values = Values([(f"Person Number{i}", "<NAME>") for i in range(20_000)])
    text = "so said person   number77 and no one else; " * 240_000  # ten million characters
    start = time.time()
    assert replaced(text, values.find(text)).count("<NAME>") == 240_000
    assert time.time() - start < 60


def test_hot_documents_are_split(spark, monkeypatch):
    monkeypatch.setattr(X, "VALUES", 3)
    monkeypatch.setattr(X, "TEXTS", 4)
    names = [(d, f"Name{chr(65 + i)} Surname", f"<N{i}>") for d in ("a", "b") for i in range(10 if d == "a" else 1)]
    learned = spark.createDataFrame([*names, ("a", "NameA Surname Jones", "<LONG>"), (None, "Nobody Here", "<X>")], "session string, value string, replacement string")
    rows = [("a", i, f"call namE{chr(65 + i % 10)}  surname jones {i}", 0) for i in range(30)] + [("a", 30, None, 0), ("a", 31, "", 0), ("b", 32, "NameA Surname, NameB Surname", 0), ("c", 33, "NameA Surname", 0), (None, 34, "Nobody Here", 0)]
    df = spark.createDataFrame(rows, "session string, n int, t string, spans int")
    got = {r.n: r.t for r in X.scrub_learned(df.select("session", "n", "t"), "t", learned).collect()}
    assert len(got) == len(rows) and got[30] is None and got[31] == "" and got[33] == "NameA Surname" and got[34] == "Nobody Here"
    assert got[32] == "<N0>, NameB Surname"
    for i in range(30):
        assert got[i] == (f"call <LONG> {i}" if i % 10 == 0 else f"call <N{i % 10}> jones {i}")
    assert X.scrub_learned(df.select("session", "n", "t"), "t", learned.limit(0)).count() == len(rows)
