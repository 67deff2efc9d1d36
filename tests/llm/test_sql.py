"""Operators that SQL can express, on the given tables and on odd ones."""

import pytest
from pyspark.sql import functions as F

from compare import rows, same
from tilelake.llm import decontaminate, licences, neardup, quality, quotes, registry, suffixdedup


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(name, spark, data, duck):
    same(registry.QUERIES[name](spark, data), registry.ORACLES[name], duck)


@pytest.fixture(scope="module")
def table(tmp_path_factory, odd, spark, data):
    """A folder of tables with the odd rows that have a number of their own as documents."""
    d = tmp_path_factory.mktemp("odd")
    kept = odd.where("doc_id is not null").dropDuplicates(["doc_id"]).withColumn("text", F.substring("text", 1, 9000))  # SQL copies a list for each window
    kept.coalesce(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, "passage3 of words passage4 of words passage5 of words passage6 of"), (2, "one"), (3, ""), (4, None), (4, "w1 x1"), (9, "caf\u00e9")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def odd_duck(table):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{table}/{t}.parquet/*.parquet'")
    return c


@pytest.mark.parametrize("name", ["op3_decontaminate", "op4_licences", "op6_bag_minhash", "op8_sparse_suffixes", "op9_quality"])
def test_odd_rows_equal_sql(name, spark, table):
    same(registry.QUERIES[name](spark, table), registry.ORACLES[name], odd_duck(table))


def test_blocks_of_items_give_the_same(spark, data, documents):
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    one = decontaminate.find_benchmark(documents.select("doc_id", "text"), bench).select("doc_id", "benchmark_found.*")
    many = decontaminate.find_benchmark(documents.select("doc_id", "text"), bench, block_bytes=1500).select("doc_id", "benchmark_found.*")
    flat = lambda df: sorted((r.doc_id, r.n_words, tuple((s.start, s.end) for s in r.spans), tuple(r["items"])) for r in df.collect())
    assert flat(one) == flat(many) and any(r[3] for r in flat(one))


def test_hash_collisions_of_heads_give_the_same(spark, data, monkeypatch):
    """Hashes of two bits only rule out less."""
    usual = rows(suffixdedup.op8_sparse_suffixes(spark, data).toPandas())
    plain = suffixdedup.heads
    monkeypatch.setattr(suffixdedup, "heads", lambda total, p: plain(total, p) & 3)
    assert rows(suffixdedup.op8_sparse_suffixes(spark, data).toPandas()) == usual


def test_common_words():
    cases = [("a b c", "a b c", 3), ("a b c", "a b cd", 2), ("a b", "a b cd", 2), ("ab", "a", 0), ("x", "y", 0), ("a b c d", "a b x d", 2), ("a bc", "a bd", 1)]
    assert all(suffixdedup.common_words(a.encode(), b.encode()) == suffixdedup.common_words(b.encode(), a.encode()) == n for a, b, n in cases)


def test_runs_over_the_ends_of_tasks(spark, data, monkeypatch, tmp_path):
    """A passage that all documents have, with other words around it, in more tasks than windows."""
    import duckdb

    common = " ".join(f"common{k}" for k in range(70))
    texts = [(k, f"{' '.join(f'l{k}x{i}' for i in range(40))} {common} {' '.join(f'r{k % 5}x{i}' for i in range(60))}") for k in range(90)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    n = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "150")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        c = duckdb.connect()
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        same(suffixdedup.op8_sparse_suffixes(spark, str(tmp_path)), suffixdedup.SQL, c)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_blocks_of_buckets_give_the_same(spark, data, monkeypatch):
    usual = rows(neardup.op6_bag_minhash(spark, data).toPandas())
    monkeypatch.setattr(neardup, "BLOCK", 2)
    assert rows(neardup.op6_bag_minhash(spark, data).toPandas()) == usual


@pytest.mark.parametrize("run", [lambda d: decontaminate.find_benchmark(d, d.selectExpr("doc_id item_id", "text")), lambda d: quality.judge(d), lambda d: licences.scan_licences(d), lambda d: neardup.near_duplicates(d), lambda d: suffixdedup.repeated_passages(d)])
def test_extra_columns_and_empty_tables(run, crowded, empty):
    assert run(crowded).count() > 0
    assert run(empty).count() == 0


def test_near_duplicates_of_odd_rows(odd):
    c = {}
    for r in neardup.near_duplicates(odd).collect():
        c.setdefault(r.doc_id, set()).add(r.class_id)
    assert c[6] == c[7] == {6} and c[1] == {1} and c[2] == {2} and c[None] == {None}


TALK = [
    (1, 0, "user", "The first question has several words.\nAnd a second line of text."),
    (1, 1, "assistant", "> The first question has several words.\n> And a second line of text.\nAn answer of its own here."),
    (1, 2, "user", "On Monday someone wrote:\n> > the first question has several WORDS\n> An answer of its own here.\nThanks for that."),
    (1, 3, "user", "> The first question has several words.\nAnother branch about it."),
    (1, 4, "user", "> Never said by anyone at all.\nLost."),
    (1, 5, "assistant", ">> Thanks for that.\nDeep."),
    (1, 5, "assistant", ">> Thanks for that.\nDeep."),
    (2, 0, "user", "The first question has several words."),
    (2, 1, "user", ""),
    (2, 2, None, None),
    (3, 0, "user", "> quote of nothing\n>\n> > "),
    (None, 1, "user", "lost"),
]


def test_quotes_equal_sql(spark):
    import duckdb

    df = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string")
    talk = df.toPandas()
    talk["conv_id"] = talk["conv_id"].astype("Int64")
    c = duckdb.connect()
    c.register("conversations", talk)
    got = quotes.thread(df)
    same(got, quotes.THREAD_SQL, c)
    by = {(r.conv_id, r.turn): r for r in got.collect()}
    assert [by[1, t].reply_to for t in range(6)] == [None, 0, 1, 0, None, 2]
    assert [t for _, t in sorted((by[1, t].root * 100 + by[1, t].place, t) for t in range(6))] == [0, 1, 2, 5, 3, 4]
    assert by[1, 2].text == "Thanks for that." and by[2, 2].text is None
    assert quotes.thread(df.limit(0)).count() == 0


def test_quotes_lead_to_the_messages_that_they_are_from(spark, data):
    """Recall on all conversations: whole and nested quotes of the message before, and partial ones by their length."""
    df = quotes.with_quotes(spark.read.parquet(f"{data}/conversations.parquet"))
    norm = {(r.conv_id, r.turn): r.norm for r in df.select("conv_id", "turn", quotes.normal(quotes.own_text(F.col("text"))).alias("norm")).collect()}
    cut = {(r.conv_id, r.turn): r.cut for r in quotes.passages(df.select(F.col("conv_id").alias("conv"), "turn", "text")).select(F.col("conv").alias("conv_id"), "turn", quotes.normal(F.array_join("lines", " ")).alias("cut")).collect()}
    n, met = {}, {}
    for r in quotes.thread(df).collect():
        if r.n_quotes:
            kind = (r.conv_id + r.turn) % 4
            part = kind == 1
            kind = (1, quotes.PARTIAL[(r.conv_id + r.turn) // 4 % len(quotes.PARTIAL)]) if part else kind
            n[kind] = n.get(kind, 0) + 1
            # the message before, or an earlier one that has its text or what is quoted of it
            text = cut[r.conv_id, r.turn] if part else norm[r.conv_id, r.turn - 1]
            right = r.reply_to is not None and (r.reply_to == r.turn - 1 or text in norm[r.conv_id, r.reply_to])
            met[kind] = met.get(kind, 0) + right
    assert set(n) == {0, 2, *((1, k) for k in quotes.PARTIAL)} and all(met.get(k, 0) >= 0.9 * n[k] for k in n), (n, met)


@pytest.mark.parametrize("n", [4, 6, 9, 15, 22])
def test_partial_quotes_of_each_length(spark, n):
    """A passage is found at each place of a message, also where an earlier message has its first words or all but one."""
    rows_, where = [], range(0, 40 - n, 5)
    for c, at in enumerate(where):
        text = [f"c{c}w{k}" for k in range(40)]
        cut = text[at : at + n]
        half = max(1, n // 3)
        rows_ += [
            (c, 0, "user", " ".join(cut[: n // 2])), (c, 1, "user", " ".join([*cut[:-1], "other"])), (c, 2, "user", " ".join(text)), (c, 3, "user", " ".join(text)),
            (c, 4, "user", "".join("> " + " ".join(cut[k : k + half]) + "\n" for k in range(0, n, half)) + "yes"),
        ]
    got = quotes.thread(spark.createDataFrame(rows_, "conv_id long, turn long, role string, text string")).where("turn = 4").collect()
    assert [r.reply_to for r in got] == [2] * len(where)


def test_partial_quotes_with_other_lines(spark):
    text = " ".join(f"word{k}" for k in range(60))
    cut = [f"word{k}" for k in range(13, 40)]
    rows_ = [(1, 0, "user", "Something else first."), (1, 1, "user", text), (1, 2, "user", "> " + " ".join(cut[:5]) + "\n> " + " ".join(cut[5:19]).upper() + ",\n> " + " ".join(cut[19:]) + "\nyes"), (1, 3, "user", "> " + " ".join([*cut, "other"]) + "\nno")]
    got = {r.turn: r.reply_to for r in quotes.thread(spark.createDataFrame(rows_, "conv_id long, turn long, role string, text string").withColumn("key", F.lit(1))).collect()}
    assert got == {0: None, 1: None, 2: 1, 3: None}
    long = "x " * 200_000
    assert quotes.thread(spark.createDataFrame([(1, 0, "user", long), (1, 1, "user", f"> {long}\nend")], "conv_id long, turn long, role string, text string")).where("reply_to = 0").count() == 1


def test_long_reply_chain(spark):
    """Depth by pointer doubling: a chain of replies, each quoting the one before."""
    rows_ = [(1, k, "user", (f"> message number {k - 1} says something\n" if k else "") + f"message number {k} says something") for k in range(70)]
    got = quotes.thread(spark.createDataFrame(rows_, "conv_id long, turn long, role string, text string")).collect()
    assert all(r.root == 0 and r.place == r.turn for r in got)


def test_replies_to_one_message_in_blocks(spark, monkeypatch):
    """Many replies to one message stay in turn order across blocks of turns, some of them empty."""
    monkeypatch.setattr(quotes, "BLOCK", 4)
    rows_ = [(1, 0, "user", "the first message of them all")] + [(1, k, "user", f"> the first message of them all\nanswer {k}") for k in (1, 2, 3, 5, 17, 18, 40, 41)]
    got = quotes.thread(spark.createDataFrame(rows_, "conv_id long, turn long, role string, text string")).orderBy("place").collect()
    assert [r.turn for r in got] == [0, 1, 2, 3, 5, 17, 18, 40, 41] and all(r.root == 0 for r in got)
