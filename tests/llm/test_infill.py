"""The fill-in-middle transformation against a brute-force version, its index against plain lists, and its SQL."""

import hashlib
import random
import re

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import infill

SCHEMA = "doc_id long, text string, n string, form string, digest string, low string, own string"
SF = "/root/testdata/sf0.001"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 10_000), max_size=60))
def test_lists_give_their_numbers(gaps):
    ends = np.cumsum(np.array(gaps, np.int64))
    parts = infill.packed_list(ends)
    assert [infill.selected(k, *parts) for k in range(len(ends))] == ends.tolist()


def test_a_list_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 120, 10_000))
    bits, low, high = infill.packed_list(ends)
    assert 8 * (len(low) + len(high)) < len(ends) * (np.log2(ends[-1] / len(ends)) + 3)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="a\né🙂\r", max_size=12), max_size=6))
def test_line_ends(texts):
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    want = [np.cumsum([len(x) for x in re.findall(r"[^\n]*\n|[^\n]+", t)]).tolist() for t in texts]
    assert [e.tolist() for e in infill.line_ends(np.frombuffer(data, np.uint8), offsets)] == want


def wanted(doc_id, text, share=100):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    p, q = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:p]), "".join(units[p:q]), "".join(units[q:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= share:
        return (doc_id, len(units), "plain", None, None, text)
    form = "spm" if h4 % 100 < 50 else "psm"
    output = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return (doc_id, len(units), form, len(prefix), len(middle), output)


def test_rows(spark):
    rng = random.Random(7)
    texts = [None, "", "\n", "\n\n", "one", "one\n", "<P>x\ny", "x<S>", "a<M>\n", "<\nS>\n<\n", "é\n🙂\nß", "line\n" * 50_000, "x" * 1_000_000]
    texts += ["".join(rng.choice("ab\n<P>SM é") for _ in range(rng.randint(0, 40))) for _ in range(150)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(1000 + k, "same\ntext\nof\nmany") for k in range(200)] + [(5, "another text\nof one id"), (5, "another text\nof one id"), (-3, "a\nb\nc")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(k, t, *"abcde") for k, t in rows], SCHEMA).repartition(4)
    for share in (100, 60):
        out = infill.infilled(docs, share=share).collect()
        found = [(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in out]
        assert sorted(found, key=repr) == sorted((wanted(k, t, share) for k, t in rows), key=repr)
        assert all(infill.restored(r["output"], r["form"]) == r["text"] for r in out)
    assert len({r["form"] for r in out}) == 3
    assert infill.infilled(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_text_is_indexed_once(spark):
    texts = spark.createDataFrame([("a\nb",)] * 500 + [("c",)] * 3 + [("",)], "text string").repartition(7)
    assert sorted(r["n"] for r in infill.text_index(texts).collect()) == [0, 1, 2]


def test_query_and_sql(spark):
    out = infill.op11_infill_index(spark, SF)
    columns = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert out.columns == columns
    found = sorted(map(tuple, out.collect()))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    cursor = con.execute(infill.SQL)
    assert [d[0] for d in cursor.description] == columns
    assert found == sorted(cursor.fetchall())
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert found == sorted((*wanted(k, t)[:5], sha(wanted(k, t)[5]), sha(t)) for k, t in docs)
