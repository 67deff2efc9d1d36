"""Spelling variants against all pairs of words."""

import functools
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from compare import rows, same
from tilelake.llm import shared, spelling


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def plain(counts):
    """(word, form, root, n, n_near, form_n) by comparing each word with each."""
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {w: min(((-counts[x], x) for x in xs if counts[x] >= 2 * counts[w]), default=(0, None))[1] for w, xs in near.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items())


def made(spark, counts, **more):
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    return sorted(tuple(r) for r in spelling.spelling_variants(df.select("*", *[F.lit(v).alias(k) for k, v in more.items()])).collect())


def test_words_of_few_letters(spark):
    """All words of up to four of three letters are near many others; some are very long."""
    rng = random.Random(5)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 6))) for _ in range(250)}
    words |= {"a" * k for k in range(1, 16)} | {"x" * 20000, "x" * 20001, "x" * 9000 + "y" + "x" * 10999, "z" + "x" * 20000, "\U0001f600a", "\U0001f600", "q\U0001f600a"}
    counts = {w: rng.choice([1, 2, 3, 4, 8, 100]) for w in sorted(words)}
    want = plain(counts)
    assert sum(r[4] for r in want) > 700
    assert made(spark, counts, near=1, node=2, pos=3, form="x", backwards=True) == want


def test_long_chains_and_repeated_rows(spark):
    """Forms that lead to forms; rows of one word count together; null and empty words go."""
    counts = {"w" * 10 + "a" * k: 3 * 2**k for k in range(12)}
    want = plain(counts)
    assert max(len(r[2]) for r in want) == 21 and sum(r[2] != r[1] for r in want) > 9
    df = spark.createDataFrame([*[(w, n - 1) for w, n in counts.items()], *[(w, 1) for w in counts], (None, 5), ("", 5)], "word string, n long")
    assert sorted(tuple(r) for r in spelling.spelling_variants(df).collect()) == want
    assert spelling.spelling_variants(df.limit(0)).count() == 0


def test_many_words_of_one_beginning(spark, monkeypatch):
    """A third of all words have the same node, which is broadcast, as are all that more than four states have."""
    monkeypatch.setattr(spelling, "spread_join", functools.partial(shared.spread_join, least=4))
    rng = random.Random(6)
    words = {"samebeginning" + "".join(rng.choice("abcd") for _ in range(4)) for _ in range(200)} | {"".join(rng.choice("abcd") for _ in range(7)) for _ in range(300)}
    counts = {w: rng.randint(3, 20) for w in sorted(words)}
    assert made(spark, counts) == plain(counts)


@pytest.mark.parametrize("shares", [1, 3, 1 << 40])
def test_spread_join_gives_the_join(spark, shares):
    big = shared.written(spark.range(300).selectExpr("if(id % 3 = 0, 7, if(id % 50 = 1, null, id)) k", "id a"), "big")
    small = spark.createDataFrame([(7, "x"), (7, "y"), (4, "z"), (None, "n"), (1000, "o")], "k long, b string")
    for how in ("inner", "left"):
        got, want = shared.spread_join(big, small, ["k"], how=how, shares=shares, least=1), big.join(small, ["k"], how)
        assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_runs_and_slips_equal_plain_python(spark, odd):
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()] + [(k, "Straße naïve ÀÉÎ×÷ÿ abcd abcde x_abcdef-ghijk ΩABCDEFΩ " * 30) for k in range(40, 60)]
    want = {}
    for d, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{d}:{w}".encode())
            if d is not None and h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            want[w] = want.get(w, 0) + 1
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.word: r.n for r in spelling.vocabulary(spelling.with_slips(spelling.word_runs(df))).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 5 and n >= 3} and len(got) > 5


def test_odd_rows_equal_sql(spark, odd, tmp_path):
    odd.where("doc_id is not null").dropDuplicates(["doc_id"]).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    same(spelling.op12_spelling_variants(spark, str(tmp_path)), spelling.SQL, c)


def test_small_batches_give_the_same(spark, data, monkeypatch):
    usual = rows(spelling.op12_spelling_variants(spark, data).toPandas())
    plain_paths = spelling.trie_paths
    monkeypatch.setattr(spelling, "trie_paths", lambda vocab: plain_paths(vocab, batch_chars=40))
    assert rows(spelling.op12_spelling_variants(spark, data).toPandas()) == usual
