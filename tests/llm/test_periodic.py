"""Periodic runs against all periods of all stretches, and the grammar."""

import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import same
from tilelake.llm import periodic
from tilelake.llm.words import mix


def plain(words):
    """(start, length, period) of each run, by trying all periods."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i < len(words) - q:
            start = i
            while i < len(words) - q and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(6, 4 * q):
                found.setdefault((start, i + q), q)
            i += 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def repeating(rng):
    letters, n, words = rng.choice([1, 2, 2, 3, 5, 50]), rng.choice([0, 1, 5, 6, 8, 20, 60, 200]), []
    while len(words) < n:
        if rng.random() < 0.3:
            u = [rng.randrange(letters) for _ in range(rng.randint(1, max(1, n // 5)))]
            words += (u * rng.randint(2, 8))[: rng.randint(1, 8 * len(u))]
        else:
            words.append(rng.randrange(letters))
    return words[:n]


def hashed(docs):
    return mix(np.array([x for d in docs for x in d], np.uint64) + np.uint64(7)), np.cumsum([0] + [len(d) for d in docs])


def test_runs_of_random_words():
    rng = random.Random(11)
    for _ in range(400):
        docs = [repeating(rng) for _ in range(rng.randint(1, 6))]
        h, first = hashed(docs)
        got = periodic.all_runs(h, first)
        for k, d in enumerate(docs):
            mine = got[(got[:, 0] >= first[k]) & (got[:, 0] < first[k + 1])]
            assert [(s - first[k], e - s, q) for s, e, q in mine.tolist()] == plain(d)


def test_the_grammar_makes_the_words_again():
    """Each rule is two parts that are words or rules, all its occurrences have the same words, no pair is left twice."""
    rng = random.Random(12)
    for _ in range(200):
        docs = [repeating(rng) for _ in range(3)]
        h, first = hashed(docs)
        g = periodic.repair(h, first)
        spans = {(a, a + 1) for a in range(len(h))}
        for r in range(len(g.start)):
            at, size = g.at[g.rule == r], g.end[r] - g.start[r]
            assert len(at) >= 2 and at.min() == g.start[r] and all((h[a : a + size] == h[at[0] : at[0] + size]).all() for a in at)
            assert all((a, a + g.cut[r] - g.start[r]) in spans and (a + g.cut[r] - g.start[r], a + size) in spans for a in at)
            spans |= {(a, a + size) for a in at}
        for d in range(3):
            ends = np.append(g.top[(g.top >= first[d]) & (g.top < first[d + 1])], first[d + 1])
            parts = [h[a:b].tobytes() for a, b in zip(ends, ends[1:])]
            seen, i = {}, 0
            for i, pair in enumerate(zip(parts, parts[1:])):
                assert seen.setdefault(pair, i) >= i - 1  # aaa holds one aa


def test_long_and_deep_repeats():
    rng = random.Random(13)
    for words in ([1] * 100_000, [1, 2] * 60_000, list(range(5000)) * 9, [0, 1, 2, *[3] * 7] * 3000, [rng.randrange(2) for _ in range(3000)]):
        h, first = hashed([words])
        got = [(s, e - s, q) for s, e, q in periodic.all_runs(h, first).tolist()]
        if len(words) <= 3000:
            assert got == plain(words)
        else:
            assert max(got, key=lambda r: r[1]) in [(0, len(words), q) for q in (1, 2, 5000, 10)]


def check(df, doc_id="doc_id"):
    n = 0
    for r in periodic.periodic_runs(df).select("text", "periodic.*").collect():
        words = re.findall("[^\x20\x09-\x0d]+", r.text or "")
        found = [tuple(x) for x in r.runs]
        assert r.n_words == len(words) and found == (plain(words) if len(words) < 3000 else found) and r.collapsed == collapsed(words, found)
        n += len(found)
    return n


def test_odd_rows_and_clashing_names(spark, odd, crowded, empty):
    assert check(odd) == 0
    assert check(crowded.withColumn("text", F.expr("concat(repeat(concat(coalesce(text, 'no'), ' '), 7), 'end')")).where("length(text) < 20000")) >= 5
    more = crowded.withColumn("periodic", F.lit(1))
    assert periodic.periodic_runs(more).columns == more.columns
    assert periodic.periodic_runs(empty).count() == 0


def test_slices_give_the_same(spark, data, monkeypatch):
    from tilelake.llm import words

    df = periodic.with_repeats(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").coalesce(1))
    usual = sorted(map(repr, periodic.periodic_runs(df).collect()))
    texts = [r.text for r in df.collect()]
    import pyarrow as pa

    for limit in (1, 5000):
        got = [x for data_, offsets, _ in words.slices(pa.array(texts), limit) for x in periodic._slice(data_, offsets).to_pylist()]
        assert sorted(map(repr, got)) == sorted(repr({"n_words": r.n_words, "runs": [x.asDict() for x in r.runs], "collapsed": r.collapsed}) for r in periodic.periodic_runs(df).select("periodic.*").collect())
    assert len(usual) == len(texts)


@pytest.mark.parametrize("folder", ["odd", "repeats"])
def test_odd_tables_equal_sql(spark, odd, folder, tmp_path):
    rng = random.Random(14)
    docs = odd.where("doc_id is not null").dropDuplicates(["doc_id"]).selectExpr("doc_id", "left(text, 3000) text")
    if folder == "repeats":
        docs = spark.createDataFrame([(k, "\n".join(f"w{x}" for x in repeating(rng))) for k in range(150)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    same(periodic.op11_periodic_runs(spark, str(tmp_path)), periodic.SQL, c)
