"""Folders of files: bad bytes, bad JSON, conflicts, several glossaries at once."""

import json

import pytest

from tessera.sources import documents as D
from tessera.sources import folders


def put(folder, files):
    for name, content in files.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(content if isinstance(content, bytes) else content.encode())


def test_translations(spark, tmp_path):
    put(tmp_path, {
        "one/translations/a.md": "﻿head\n<!-- b1 | paragraph -->\nmột\n<!-- b2 -->\nhai", "one/translations/b.json": '{"b2": "HAI", "b3": "ba", "x": "no"}', "one/translations/c.json": '{"b2": ',
        "one/translations/d.md": b"<!-- b1 -->\n\xff\xfe", "one/translations/e.md": "nothing marked", "one/translations/f.txt": "<!-- b9 -->\nno", "one/other/g.md": "<!-- b9 -->\nno",
        "two/translations/a.json": '[{"id": "b1", "vi": "một"}]', "two/translations/b.md": "<!-- b1 -->\nmột", "two/translations/c.md": "",
    })
    merged, warnings = folders.read_translations(spark, str(tmp_path))
    assert {(r.doc_id, r.block_id, r.text, r.origin) for r in merged.collect()} == {("one", "b1", "một", "a.md"), ("one", "b2", "HAI", "b.json"), ("one", "b3", "ba", "b.json"), ("two", "b1", "một", "b.md")}
    told = {(r.doc_id, r.file, r.block_id, r.message) for r in warnings.collect()}
    assert told == {
        ("one", "c.json", None, "cannot read: no JSON"), ("one", "d.md", None, "cannot read: not UTF-8"), ("one", "e.md", None, "no blocks"),
        ("one", "b.json", "b2", "translated in both a.md and b.json; using b.json"),
    }


def test_documents(spark, tmp_path):
    block = {"id": "b1", "type": "title", "page": 1, "level": 0, "keep": False, "section": "", "text": "T"}
    whole = {"format": folders.FORMAT, "source": "a.txt", "title": "T", "pages": 2, "chunk_words": 30, "blocks": [block, block | {"id": "b2", "type": "authors", "keep": True}], "chunks": [{"id": "chunk-01", "blocks": ["b1", "b2"], "words": 1}]}
    put(tmp_path, {"one/document.json": json.dumps(whole), "two/document.json": json.dumps(whole | {"format": "other", "blocks": []}), "bad/document.json": "{", "list/document.json": "[]", "bytes/document.json": b"\xff", "one/other.json": "{}"})
    docs, blocks, warnings = folders.read_documents(spark, str(tmp_path))
    assert {(r.doc_id, r.title, r.pages, r.chunks[0].words) for r in docs.collect()} == {("one", "T", 2, 1), ("two", "T", 2, 1)}
    assert [(r.doc_id, r.block_no, r.id, r.keep) for r in blocks.orderBy("block_no").collect()] == [("one", 1, "b1", False), ("one", 2, "b2", True)]
    assert {(r.doc_id, r.message) for r in warnings.collect()} == {
        ("bad", "cannot read: no JSON object"), ("list", "cannot read: no JSON object"), ("bytes", "cannot read: not UTF-8"), ("two", f"format other instead of {folders.FORMAT}")}


def test_glossaries(spark, tmp_path, monkeypatch):
    """Each file has its own header; comments, quotes with commas and line ends, rows without a term or a variant."""
    put(tmp_path, {"g/a.csv": "﻿en,vi,domain,note\nsoil,đất|thổ nhưỡng,bio,\n,x,,\nno,,,\n", "g/b.csv": '# a comment\ndomain,en,vi,note\n\nml,layer,"lớp,tầng| ","two\nlines"\n', "g/c.csv": b"en,vi\n\xff,x\n", "g/d.csv": ""})
    rows, warnings = folders.read_glossaries(spark, str(tmp_path / "g"))
    assert [(r.en, r.vi, r.domain, r.source, r.row) for r in rows.orderBy("row").collect()] == [("soil", ["đất", "thổ nhưỡng"], "bio", "a.csv", 1), ("layer", ["lớp,tầng"], "ml", "b.csv", 2)]
    assert [(r.file, r.message) for r in warnings.collect()] == [("c.csv", "cannot read: not UTF-8")]
    assert {(r.en, r.source) for r in D.read_glossary(spark, str(tmp_path / "g" / "b.csv"), "own").collect()} == {("layer", "own")}
    monkeypatch.setenv("TESSERA_GLOSSARY", "/e1: /e2:")
    assert folders.glossary_paths("/u", extra=["/x"], folder="/w") == ["/u", "/e1", "/e2", "/x", "/w/glossary.csv"] and folders.glossary_paths(environment="NONE_SUCH") == []
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        folders.read_glossaries(spark, str(tmp_path / "none"))
