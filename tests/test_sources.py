"""Scans and sinks on small files."""

import json
import zipfile

from textloom.sources import readers


def test_jsonl_units(spark, tmp_path):
    lines = ['{"text": "one"}', '{"other": "a value that is over twenty chars", "n": 1}', "not json", "", '{"content": "two"}']
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    found = {r["text"] for r in readers.jsonl_units(spark, str(tmp_path)).collect()}
    assert found == {"one", "a value that is over twenty chars", "not json", "two"}


def test_text_units(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\nmore\n\n \n\ntwo\n")
    assert [r["text"] for r in readers.text_units(spark, str(tmp_path)).orderBy("ordinal").collect()] == ["one\nmore", "two"]


def test_epub_units_follow_the_spine(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "b.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        z.writestr("o/p.opf", '<package><manifest><item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>')
        z.writestr("o/a.xhtml", "<p>A</p>")
        z.writestr("o/b.xhtml", "<p>B</p>")
    (tmp_path / "bad.epub").write_bytes(b"no archive")
    assert [r["text"] for r in readers.epub_units(spark, str(tmp_path)).orderBy("ordinal").collect()] == ["<p>B</p>", "<p>A</p>"]


def test_device_logs(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "seconds": 5}\nbroken\n{"id": "2", "seconds": 7}')
    (tmp_path / "a.sync-conflict-1.jsonl").write_text('{"id": "3", "seconds": 5}')
    (tmp_path / "b.txt").write_text('{"id": "4", "seconds": 5}')
    assert {r["id"] for r in readers.device_logs(spark, str(tmp_path), "id string, seconds double").collect()} == {"1", "2"}


def test_chat_lines(spark, tmp_path):
    df = spark.createDataFrame([("in", "out")], "a string, b string")
    readers.write_chat(df, str(tmp_path / "out"), "be exact", "a", "b")
    line = json.loads("".join(p.read_text() for p in (tmp_path / "out").glob("part-*")))
    assert [m["role"] for m in line["messages"]] == ["system", "user", "assistant"]
    assert line["messages"][2]["content"] == "out"
