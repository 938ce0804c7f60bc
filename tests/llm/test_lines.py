import hashlib
import random

import pytest

from tests.llm.fixtures import documents, odd_rows, prose
from tomegraph.llm import line_dedup as L


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows):
    """Per row (doc_id, lines, dropped, kept, digest): each line is compared with all that stay before it."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    seen, stay, out = set(), [], {}
    for i in order:
        gone = []
        words = L.line_words(rows[i][1])
        for k, w in enumerate(words):
            if not w:
                continue
            line = tuple(w)
            near = len(w) >= L.NEAR_WORDS and any(len(b) >= L.NEAR_WORDS and abs(len(w) - len(b)) < 2 and edits(w, b) <= 1 for b in stay)
            if line in seen or near:
                gone.append(k)
            else:
                stay.append(w)
            seen.add(line)
        kept = "\n".join(x for k, x in enumerate((rows[i][1] or "").split("\n")) if k not in gone)
        out[i] = (rows[i][0], len(words), len(gone), not gone or bool(kept.strip(" \t\n\r\x0b\x0c")), hashlib.sha256(kept.encode()).hexdigest())
    return sorted(out.values(), key=repr)


def sample():
    r = random.Random(4)
    lines = [prose(i, r.randint(3, 24)) for i in range(60)]
    data = []
    for d in range(80):
        own = []
        for _ in range(r.randint(0, 6)):
            w = r.choice(lines).split()
            how = r.randint(0, 5)
            i = r.randrange(len(w))
            if how == 1:
                w[i] = "zz"
            elif how == 2:
                del w[i]
            elif how == 3:
                w.insert(r.randint(0, len(w)), "yy")
            elif how == 4:
                w[i] = w[i].upper()
            elif how == 5:
                w[0], w[-1] = "a1", "b1"
            own.append("  ".join(w))
        data.append((d, "\n".join(own)))
    return data


def got(spark, data):
    from pyspark.sql import functions as F

    c = L.clean(documents(spark, data).coalesce(1))
    return sorted((tuple(r) for r in c.select("doc.doc_id", "n_lines", "n_dropped", ~F.col("spent"), F.sha2("text", 256)).collect()), key=repr)


@pytest.mark.parametrize("limit", [None, 0])
def test_against_all_pairs(spark, limit, monkeypatch):
    if limit is not None:
        monkeypatch.setattr(L, "BROADCAST_BYTES", limit)
    data = sample()
    want = brute(data)
    assert sum(x[2] for x in want) > 50
    assert got(spark, data) == want


def test_odd_rows(spark):
    data = [(d, t) for d, t in odd_rows() if d != 12]
    assert got(spark, data) == brute(data)
    assert L.clean(documents(spark, data).where("doc_id < 0")).count() == 0


def test_rows_of_equal_and_no_id(spark):
    """Each row loses its own lines only, whatever its id; rows without an id come last."""
    data = [(5, "b\na"), (5, "c\nd"), (1, "a"), (5, "b\na"), (None, "a\nnew"), (None, "a\nnew"), (None, "c"), (7, None), (7, "c\n\nz")]
    want = brute(data)
    assert got(spark, data) == want
    assert [(r[0], r[2], r[3]) for r in want if r[0] == 5] == [(5, 0, True), (5, 1, True), (5, 2, False)]


def test_chains_keep_a_line_that_stays(spark):
    base = prose(5, 12).split()
    chain = []
    for i in range(4):
        chain.append(" ".join(base))
        base[i] = f"changed{i}"
    data = [(i, t) for i, t in enumerate(chain)]
    assert got(spark, data) == brute(data)
    gone = {r.doc_id: r.keep.doc_id for r in L.dropped_lines(documents(spark, data)).collect()}
    assert gone == {1: 0, 3: 2}


def test_long_chain(spark):
    """Lines of one word more each, in order: every second one stays."""
    data = [(n, " ".join(["la"] * (n + 5))) for n in range(7)]
    assert {r.doc_id: r.keep.doc_id for r in L.dropped_lines(documents(spark, data)).collect()} == {1: 0, 3: 2, 5: 4}


def test_columns_stay(spark):
    docs = documents(spark, odd_rows()).withColumnsRenamed({"key": "row", "h": "n_lines"})
    assert L.clean(docs).select("doc.*").columns == docs.columns
    assert L.clean(docs).select("doc.*").exceptAll(docs).count() == 0


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in L.op6_line_dedup(spark, sf).collect()), key=repr) == brute(rows)


def test_short_new_lines_stay(spark):
    """A document goes only if nothing but blanks is left of it."""
    footer = "all rights reserved by the keeper of this list"
    data = [(1, f"head\n{footer}"), (2, f"red tin\n\nblue cup\n{footer}"), (3, f"HEAD\n{footer}"), (4, f"\n{footer}\n "), (None, f"green jar\n{footer}")]
    spent = {r.doc_id: r.spent for r in L.clean(documents(spark, data)).select("doc.doc_id", "spent").collect()}
    assert spent == {1: False, 2: False, 3: True, 4: True, None: False}


def test_scripts_without_blanks(spark):
    line = "春眠不覚暁処処聞啼鳥夜来風雨声"
    rows = L.clean(documents(spark, [(1, line), (2, f"新しい行です\n{line}"), (3, line[:7] + "猫" + line[8:])])).select("doc.doc_id", "n_dropped").collect()
    assert {r.doc_id: r.n_dropped for r in rows} == {1: 0, 2: 1, 3: 1}


def test_rows_of_files(spark, tmp_path):
    """Rows read from several files are told apart as those of one."""
    data = [(5, "b\na"), (5, "c\nd"), (1, "a"), (None, "a\nnew"), (None, "c")]
    for i, row in enumerate(data):
        documents(spark, [row]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/d/k={i}")
    c = L.clean(spark.read.parquet(f"{tmp_path}/d")).select("doc.doc_id", "n_dropped").collect()
    assert sorted((r.doc_id or 99, r.n_dropped) for r in c) == [(1, 0), (5, 0), (5, 1), (99, 1), (99, 1)]
