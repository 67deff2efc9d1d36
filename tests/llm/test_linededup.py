"""Line dedup against plain Python and on odd rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from compare import rows, same
from tilelake.llm import linededup

LONG = "This line of text has many letters"


def plain(docs, min_chars=20, min_docs=3):
    """(n_lines, n_dropped, text) of each (doc_id, text)."""
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s).strip(" \t\n\x0b\f\r")
    rank = lambda d: (d is not None, d or 0)
    of = {}
    for d, t in docs:
        for line in (t or "").split("\n"):
            if len(low(line)) >= min_chars:
                of.setdefault(low(line), set()).add(d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(of.get(low(x), ())) >= min_docs and rank(d) < max(map(rank, of[low(x)])))]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def made(df, **more):
    return sorted([(r[0], r[1], r[2], r[3]) for r in linededup.dedup_lines(df, **more).select("doc_id", "lines.*").collect()], key=repr)


CASES = [
    (1, f"{LONG}\nown line of the first document\n{LONG}"), (2, f"\t {LONG.upper()}\x0b\r\n\nshort"), (3, f"x\n{LONG} "), (4, None), (5, ""), (6, "\n\n"),
    (7, "a line that two have, not more"), (8, "a line that two have, not more"), (9, f"{LONG} "), (10, "ÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉ"),
    (11, "é" * 20), (12, "é" * 20), (13, "é" * 20), (14, "q" * 19), (15, "q" * 19), (16, "q" * 19), (17, "q" * 20), (18, "Q" * 20), (19, "q" * 20),
]


def test_cases_equal_plain_python(spark):
    assert made(spark.createDataFrame(CASES, "doc_id long, text string").repartition(3)) == plain(CASES)


def test_repeated_rows_and_rows_without_number(spark):
    docs = [*CASES, (2, CASES[1][1]), (2, "another text of document two\n" + LONG), (None, f"{LONG}\nmore"), (None, None), (20, f"only in twenty, three times over\n{LONG}"), (20, f"only in twenty, three times over\n{LONG}"), (20, "only in twenty, three times over")]
    assert made(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)) == plain(docs)


def test_given_documents_equal_plain_python(documents):
    docs = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert made(documents) == plain(docs)
    assert made(documents, min_chars=5, min_docs=2) == plain(docs, 5, 2)


@pytest.mark.parametrize("shares", [1, 2, 1 << 40])
def test_shares_don_t_matter(spark, data, monkeypatch, shares):
    """Whether keys are broadcast or shuffled."""
    usual = rows(linededup.op13_line_dedup(spark, data).toPandas())
    monkeypatch.setattr(linededup, "SHARES", shares)
    assert rows(linededup.op13_line_dedup(spark, data).toPandas()) == usual


def test_odd_rows_equal_sql(spark, odd, tmp_path):
    odd.where("doc_id is not null").dropDuplicates(["doc_id"]).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    same(linededup.op13_line_dedup(spark, str(tmp_path)), linededup.SQL, c)


def test_clashing_names_and_empty_tables(crowded, empty):
    more = crowded.select("*", *[F.lit(k).alias(n) for k, n in enumerate(["doc", "row", "pos", "key", "gone", "given", "md5", "t", "lines", "a.b"])])
    got = linededup.dedup_lines(more)
    assert got.columns == [*[c for c in more.columns if c != "lines"], "lines"]
    assert made(more) == made(crowded) and made(empty) == []


def test_no_python_in_the_plan(spark, data):
    plan = linededup.op13_line_dedup(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
