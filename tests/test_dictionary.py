"""The glossary as its owner edits it."""

import json

import pytest

from tidemark.operators import dictionary
from tidemark.operators.dictionary import BadGlossary, Glossary, load, parse, save


@pytest.mark.parametrize("text", ["[]", "{}", "nope", '{"terms": {}}', '{"terms": ["Figma"]}', '{"terms": [{"term": " "}]}', '{"terms": [{"term": ","}]}', '{"terms": [{"term": "a", "aka": "b"}]}', '{"terms": [{"term": "a", "aka": [1]}]}', '{"terms": [{"term": "a", "note": 1}]}'])
def test_malformed_is_an_error(text):
    with pytest.raises(BadGlossary):
        parse(text)


def test_read_is_normalised():
    got = parse('{"terms": [{"term": " Con,  Loca ", "aka": ["ConLog", "conlog", "|"], "note": "a\\u0000 b"}]}').terms
    assert got == [dictionary.Term("Con Loca", ["ConLog"], "a b")]


def test_add_merges_and_refuses():
    g = Glossary()
    assert g.add("Figma", ["Vigma"]) and not g.add("figma", ["vigma", "Figgma"], "tool")
    assert g.terms == [dictionary.Term("Figma", ["Vigma", "Figgma"], "tool")]
    for term, aka in (("Sketch", ["vigma"]), ("Vigma", []), ("Other", ["FIGMA"]), (" ,", []), ("x" * 81, []), ("a b c d e f g h i", []), ("Many", [f"m{i}" for i in range(25)])):
        with pytest.raises(BadGlossary):
            g.add(term, aka)
    assert len(g.terms) == 1 and g.remove("FIGMA") and not g.remove("Figma") and g.terms == []


def test_full():
    g = Glossary(dictionary.Term(f"t{i}") for i in range(dictionary.MAX_TERMS))
    assert not g.add("T3", ["three"])
    with pytest.raises(BadGlossary):
        g.add("one more")


def test_import_is_whole_or_nothing():
    g = Glossary()
    assert g.take(["ConLoca = ConLog, conlog  # note", "", "# only a comment", "Sketch"]) == 2
    assert [(t.term, t.aka, t.note) for t in g.terms] == [("ConLoca", ["ConLog"], "note"), ("Sketch", [], "")]
    with pytest.raises(BadGlossary, match="line 2"):
        g.take(["New", ", = foo"])
    assert len(g.terms) == 2


def test_files(tmp_path, spark):
    path = str(tmp_path / "terms.json")
    assert load(path).terms == []
    g = Glossary()
    g.add("Ключ", ["Клуч"], "note")
    save(g, path)
    assert load(path).terms == g.terms and "Ключ" in (tmp_path / "terms.json").read_text("utf-8") and len(list(tmp_path.iterdir())) == 1
    assert [tuple(r) for r in load(path).frame(spark).collect()] == [(1, "Ключ", ["Клуч"], "note")]
    (tmp_path / "bad.json").write_bytes(b"\xff")
    for bad in (tmp_path / "bad.json", tmp_path):
        with pytest.raises(BadGlossary):
            load(str(bad))
    big = Glossary([dictionary.Term("a", [], "x" * dictionary.MAX_BYTES)])
    with pytest.raises(BadGlossary):
        save(big, path)
    assert json.loads((tmp_path / "terms.json").read_text("utf-8"))["terms"][0]["term"] == "Ключ"
