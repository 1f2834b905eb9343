"""The filter audit and the fill-in-middle transformation against plain loops and SQL."""

from __future__ import annotations

import hashlib
import re
from itertools import permutations

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph.llm import fill_in_middle as M
from weftgraph.llm import filter_audit as A
from weftgraph.llm.queries import OP12_SQL, OP13_SQL

LONG = " ".join(f"word{i}" for i in range(250))
ROWS = [
    (1, LONG, "web"), (2, LONG, "books"), (3, LONG, None), (2, LONG, "books"), (None, LONG, "web"), (4, None, ""), (5, "", "web"), (6, "short text", "web"), (7, "short text", "web"), (8, "A B C D E F", "books"),
    (9, "a " * 300, "books"), (10, "a$ " * 300, "web"), (11, LONG + " #", "web"), (12, "x\x1cy z", None), (13, "ÀÉ " * 250, "web"), (14, LONG.upper(), "books"), (15, "same A " * 400, "web"), (None, "nothing else", "books"), (0, "a " * 300, "empty"),
    (16, "|" + LONG * 3, "books"), (17, "\n".join(LONG.split()), "web"),
]
LABELS = [(1, 1, 0), (1, 0, 1), (2, 1, 0), (6, 1, 0), (8, 0, 1), (9, 1, 1), (10, None, 1), (None, 1, 1), (99, 1, 1), (14, 1, None)]


def brute(rows, labels):
    """Applies each order filter by filter to lists of documents."""
    docs = []
    for i, text, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = set()
        fails |= {"A"} if len(words) < 200 else set()
        fails |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", text) else set()
        fails |= {"E"} if i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows) else set()
        own = [x for x in labels if i is not None and x[0] == i]
        docs.append((part or "", fails, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = {}
    for part in {d[0] for d in docs}:
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = [d for d in docs if d[0] == part]
            everyone = list(left)
            for step, x in enumerate(order, start=1):
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                total[x] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(x in d[1] for d in everyone) - len(gone), sum(d[1] == {x} for d in everyone), sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for order in map("".join, permutations("ABCDE")):
            for step, x in enumerate(order, start=1):
                out[part, order, step].append(total[x])
    return out


NAMES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def tables(spark, rows=ROWS):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"mask": F.lit(1), "n": F.lit("x"), "good": F.lit(2), "part": F.lit(3)}).repartition(3)
    return docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def test_audit(spark):
    rows = A.audit(A.failures(*tables(spark))).collect()
    got = {(r["part"], r["filter_order"], r["step"]): [r[n] for n in NAMES] for r in rows}
    assert len(rows) == len(got) and got == brute(ROWS, LABELS)


def test_audit_of_nothing(spark):
    docs, labels = tables(spark)
    assert A.audit(A.failures(docs.limit(0), labels)).count() == 0
    rows = A.audit(A.failures(docs.where("doc_id = 1"), labels.limit(0))).collect()
    assert len(rows) == 600 and all(r["kept"] == 1 and r["removed"] == r["shapley"] == 0 for r in rows)


def test_audit_of_other_filters(spark):
    """Two filters: fails none, the first, the second, both."""
    failed = spark.createDataFrame([("p", 0, False, False, 4), ("p", 1, True, False, 3), ("p", 2, False, True, 2), ("p", 3, False, False, 5)], "part string, mask int, good boolean, toxic boolean, n long")
    got = {(r["filter_order"], r["step"]): [r[n] for n in NAMES] for r in A.audit(failed, "XY").collect()}
    assert got == {("XY", 1): [6, 8, 0, 3, 3, 0, 11], ("XY", 2): [4, 2, 5, 2, 0, 2, 9], ("YX", 1): [7, 7, 0, 2, 0, 2, 9], ("YX", 2): [4, 3, 5, 3, 3, 0, 11]}


def duck(name, rows, labels=LABELS):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", rows)
    con.execute("create table labels (doc_id bigint, quality int, toxic int)")
    con.executemany("insert into labels values (?, ?, ?)", labels)
    found = con.execute(name)
    return [d[0] for d in found.description], found.fetchall()


def test_audit_sql(spark):
    names, rows = duck(OP12_SQL, ROWS)
    df = A.audit(A.failures(*tables(spark)))
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(names).collect())) == sorted(rows)


TEXTS = [None, "", "\n", "one", "one\n", "one\ntwo", "one\n\n\ntwo\n", "a<P>b\nc", "a\n<S>", "<M>", "<\nP>", "<P", "S>\n<", "é\r\n🙂\n日本", "long line " * 200_000 + "\n" + "x\n" * 50_000]


@pytest.mark.parametrize("rate", [100, 40, 0])
def test_fill_in_middle(spark, rate):
    rows = [(i, TEXTS[i % len(TEXTS)], "s") for i in range(60)] + [(3, "one", "s"), (3, "one", "s"), (None, "one\ntwo\nthree", None)]
    middle = M.Middle(rate=rate)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"n": F.lit(5), "output": F.lit("clash")}).repartition(3)
    made = M.fill_in_middle(docs, middle)
    found = made.withColumn("d", M.digests(made["output"], made["form"], middle)).collect()
    assert len(found) == len(rows)
    forms, texts = set(), {i: t for i, t, _ in rows}
    for r in found:
        text = texts[r["doc_id"]] or ""
        h = hashlib.sha256(f"7:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()
        one, two, chance, kind = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        a, b = sorted((one % (len(units) + 1), two % (len(units) + 1)))
        prefix, inner, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        form = "plain" if not text or re.search("<[PSM]>", text) or chance % 100 >= rate else "spm" if kind % 100 < 50 else "psm"
        wanted = {"plain": text, "psm": f"<P>{prefix}<S>{suffix}<M>{inner}", "spm": f"<S>{suffix}<P>{prefix}<M>{inner}"}[form]
        assert (r["n"], r["form"], r["output"]) == (len(units), form, wanted)
        assert (r["prefix_chars"], r["middle_chars"]) == ((None, None) if form == "plain" else (len(prefix), len(inner)))
        assert r["d"]["restored_sha256"] == hashlib.sha256(text.encode()).hexdigest() and r["d"]["output_sha256"] == hashlib.sha256(wanted.encode()).hexdigest()
        forms.add(form)
    assert forms == ({"plain", "psm", "spm"} if rate else {"plain"})
    assert M.fill_in_middle(docs.limit(0)).count() == 0


@given(parts=st.tuples(*[st.text(st.sampled_from("<>PSM\nx"), max_size=12)] * 3), form=st.sampled_from(["psm", "spm"]))
def test_outputs_are_restored(parts, form):
    prefix, inner, suffix = parts
    if any(m in prefix + inner + suffix for m in ("<P>", "<S>", "<M>")):
        return
    output = f"<P>{prefix}<S>{suffix}<M>{inner}" if form == "psm" else f"<S>{suffix}<P>{prefix}<M>{inner}"
    assert M.Middle().restored(output, form) == prefix + inner + suffix


def test_fill_in_middle_sql(spark):
    rows = [(i, TEXTS[i % len(TEXTS)], "s") for i in range(60)]
    names, wanted = duck(OP13_SQL, rows)
    made = M.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    df = made.withColumn("digest", M.digests(made["output"], made["form"])).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "digest.*")
    assert sorted(names) == sorted(df.columns)
    key = lambda r: r[names.index("doc_id")]
    assert sorted(map(tuple, df.select(names).collect()), key=key) == sorted(wanted, key=key)
