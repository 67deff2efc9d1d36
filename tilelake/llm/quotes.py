"""Quotation linking: which message a quote comes from, and conversations in reply order without their quotes.

Only messages with quoted lines take part in the joins. A quoted passage is a run of lines of one quote level; it and
its longer lines are normalised and hashed, and looked up among the hashes of whole messages and lines of the same
conversation. A passage of ``LINE_WORDS`` words or more that is a part of a message, its lines broken anew, is met by the
windows of as many words of all messages, made only where the first words of such a passage of the conversation stand.
The earliest message with a hash is its source,
found by an aggregate made before the shuffle, so that a text that many messages share gives one row, not all pairs.

Replies form trees. A message's place in the depth-first order of its tree comes from pointer doubling over successors,
in a number of rounds that grows with the logarithm of a tree's size; no path is built.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilelake.llm.shared import saved

QUOTE = r"^[ \t]*>"
ATTRIBUTION = r"(?i)^[ \t]*(on|am|le|el) .{0,200} (wrote|schrieb|écrit|escribió).{0,80}:[ \t]*$"
#: A line is looked up by itself, and a passage as a part of a message, if it has at least this many words.
LINE_WORDS = 4
#: Hashes of the first words of a conversation's passages are told apart modulo this number before the shuffle.
MARKS = 1024
#: Turns of a block of replies to one message.
BLOCK = 4096


def normal(text: Column) -> Column:
    """Letters and digits in lower case, with one space between runs of them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _words(norm: Column) -> Column:
    return F.size(F.split(norm, " "))


def _key(norm: Column) -> Column:
    return F.sha2(norm.cast("binary"), 256)


def own_text(text: Column) -> Column:
    """The text without quoted lines and the attribution lines right before them."""
    lines = F.split(text, "\n")
    quoted = lambda x: x.rlike(QUOTE)
    kept = F.filter(lines, lambda x, i: ~quoted(x) & ~(x.rlike(ATTRIBUTION) & F.coalesce(quoted(F.get(lines, i + 1)), F.lit(False))))
    return F.when(text.rlike(rf"(?m){QUOTE}"), F.trim(F.array_join(kept, "\n"))).otherwise(text)


def passages(messages: DataFrame) -> DataFrame:
    """(conv, turn, run, level, lines) of the quoted passages of messages (conv, turn, text): runs of lines of a level."""
    line = messages.where(F.col("text").rlike(rf"(?m){QUOTE}")).select("conv", "turn", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    mark = F.regexp_extract("line", r"^((?:[ \t]*>)*)", 1)
    line = line.select("conv", "turn", "pos", F.length(F.regexp_replace(mark, "[^>]", "")).alias("level"), F.trim(F.substring("line", F.length(mark) + 1, F.length("line"))).alias("line"))
    order = Window.partitionBy("conv", "turn").orderBy("pos")
    run = line.withColumn("new", (F.col("level") != F.lag("level", 1, -1).over(order)).cast("int")).withColumn("run", F.sum("new").over(order))
    grouped = run.where("level > 0").groupBy("conv", "turn", "run", "level").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    return grouped.select("conv", "turn", "run", "level", F.transform("lines", lambda x: x["line"]).alias("lines"))


def _starts(words: Column) -> Column:
    """For each place of an array of words the LINE_WORDS words from there on; null at the last places."""
    rest = [F.slice(words, k + 1, F.size(words)) for k in range(1, LINE_WORDS)]
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.concat(x, F.lit(" "), y)), rest, words)


def _mark(start: Column) -> Column:
    return F.pmod(start, F.lit(MARKS)).cast("int")


def _once(words: Column, made) -> Column:
    """made(words) for an array of words, which is computed once."""
    return F.flatten(F.transform(F.array(words), made))


def _parts(passage: DataFrame, norm: DataFrame) -> DataFrame:
    """(conv, turn, run, p): the earliest message before that has the passage (conv, turn, run, passage) of LINE_WORDS words
    or more in norm (conv, turn, norm). Only places whose mark one of the conversation's passages has are shuffled; marks are
    fewer than MARKS. A place where a passage's first words stand gives a hash of each length that is asked for with
    these words, so the work of a message is in proportion to its places that may be quotes and to their lengths."""
    ask = passage.withColumn("n", _words(F.col("passage"))).where(F.col("n") >= LINE_WORDS).withColumn("start", F.xxhash64(F.array_join(F.slice(F.split("passage", " "), 1, LINE_WORDS), " ")))
    marks = ask.groupBy("conv").agg(F.collect_set(_mark(F.col("start"))).alias("marks"))
    lengths = ask.groupBy("conv", "start").agg(F.collect_set("n").alias("lengths"))

    def marked(w: Column) -> Column:
        every = F.transform(_starts(w), lambda x, i: F.struct(i.alias("place"), (F.size(w) - i).alias("left"), F.when(x.isNotNull(), F.xxhash64(x)).alias("start")))
        return F.filter(every, lambda s: s["start"].isNotNull() & F.array_contains("marks", _mark(s["start"])))

    places = norm.join(marks, "conv").select("conv", "turn", F.explode(_once(F.split("norm", " "), marked)).alias("s")).select("conv", "turn", "s.*")
    fits = places.join(lengths, ["conv", "start"]).select("conv", "turn", "place", "left", F.explode("lengths").alias("n")).where("n <= left")
    asked = fits.groupBy("conv", "turn").agg(F.collect_list(F.struct("place", "n")).alias("asked"))
    window = lambda w: F.transform("asked", lambda s: _key(F.array_join(F.slice(w, s["place"] + 1, s["n"]), " ")))
    said = norm.join(asked, ["conv", "turn"]).select("conv", "turn", F.explode(F.array_distinct(_once(F.split("norm", " "), window))).alias("key"))
    source = said.groupBy("conv", "key").agg(F.min("turn").alias("p"))
    return ask.select("conv", "turn", "run", _key(F.col("passage")).alias("key")).join(source, ["conv", "key"]).where("p < turn").select("conv", "turn", "run", "p")


def link_quotes(messages: DataFrame) -> DataFrame:
    """(conv, turn, run, level, lines, source) of the quoted passages of messages (conv, turn, text): source is the turn
    of the earliest message before with the whole passage as its own text or as one of its lines, else of the earliest
    message that has the passage in its own text, if the passage has LINE_WORDS words, else of the latest of the earliest
    sources of the passage's longer lines; else null."""
    quote = passages(messages)
    long = lambda x: _words(x) >= LINE_WORDS
    keys = lambda whole, lines: F.explode(F.array_distinct(F.concat(F.array(F.struct(F.lit(True).alias("whole"), whole.alias("norm"))), F.transform(F.filter(F.transform(lines, normal), long), lambda x: F.struct(F.lit(False).alias("whole"), x.alias("norm"))))))
    joined = normal(F.array_join("lines", " "))
    asked = quote.select("conv", "turn", "run", keys(joined, F.col("lines")).alias("k")).select("conv", "turn", "run", "k.whole", _key(F.col("k.norm")).alias("key")).where(F.col("key") != _key(F.lit("")))
    talked = messages.join(quote.select("conv").distinct(), "conv", "left_semi").select("conv", "turn", own_text(F.col("text")).alias("text"))
    said = talked.select("conv", "turn", keys(normal(F.col("text")), F.split("text", "\n")).alias("k")).select("conv", "turn", _key(F.col("k.norm")).alias("key"))
    source = said.groupBy("conv", "key").agg(F.min("turn").alias("source"))
    found = asked.join(source, ["conv", "key"]).where("source < turn").groupBy("conv", "turn", "run").agg(F.min(F.when(F.col("whole"), F.col("source"))).alias("w"), F.max(F.when(~F.col("whole"), F.col("source"))).alias("l"))

    norm = talked.select("conv", "turn", normal(F.col("text")).alias("norm"))
    part = _parts(quote.select("conv", "turn", "run", joined.alias("passage")), norm)
    both = quote.join(found, ["conv", "turn", "run"], "left").join(part, ["conv", "turn", "run"], "left")
    return both.select("conv", "turn", "run", "level", "lines", F.coalesce("w", "p", "l").alias("source"))


def _doubled(state: DataFrame, rounds_on: str, jump) -> DataFrame:
    """state (conv, turn, to, ...) with ``jump`` applied along ``to`` until no row satisfies ``rounds_on``."""
    state = saved(state)
    while state.where(rounds_on).limit(1).count():
        ahead = state.select("conv", F.col("turn").alias("to"), F.struct(*[c for c in state.columns if c not in ("conv", "turn")]).alias("ahead"))
        state = saved(jump(state.join(ahead, ["conv", "to"], "left")))
    return state


def _siblings(parents: DataFrame) -> DataFrame:
    """parents with ``sibling``, the next turn of the same parent. A message may have any number of replies, so they are
    put in order within blocks of turns; the last of a block is followed by the first of the next block that has one."""
    block = F.floor(F.col("turn") / BLOCK)
    reply = parents.where("parent is not null").withColumn("block", block)
    inside = reply.withColumn("sibling", F.lead("turn").over(Window.partitionBy("conv", "parent", "block").orderBy("turn")))
    first = reply.groupBy("conv", "parent", "block").agg(F.min("turn").alias("first"))
    order = Window.partitionBy("conv", "parent").orderBy("block")
    after = first.select("conv", "parent", "block", F.lead("first").over(order).alias("after"))
    both = inside.join(after, ["conv", "parent", "block"]).select("conv", "turn", "parent", F.coalesce("sibling", "after").alias("sibling"))
    root = parents.where("parent is null")
    return both.unionByName(root.withColumn("sibling", F.lit(None).cast(parents.schema["turn"].dataType)))


def reply_order(parents: DataFrame) -> DataFrame:
    """(conv, turn, root, place) for each message of parents (conv, turn, parent): the first message of its tree, and its
    place in the tree's depth-first order, siblings by turn. parent < turn; null for roots."""
    node = saved(_siblings(parents))
    root = _doubled(node.select("conv", "turn", F.col("parent").alias("to"), F.coalesce("parent", "turn").alias("root")), "to is not null", lambda s: s.select("conv", "turn", F.col("ahead.to").alias("to"), F.coalesce("ahead.root", "root").alias("root")))
    # behind a message without further children comes the next sibling of the nearest message above that has one
    up = node.select("conv", "turn", F.coalesce("sibling", "parent").alias("to"), (F.col("sibling").isNull() & F.col("parent").isNotNull()).alias("open"))
    up = _doubled(up, "open", lambda s: s.select("conv", "turn", F.when(F.col("open"), F.col("ahead.to")).otherwise(F.col("to")).alias("to"), (F.col("open") & F.col("ahead.open")).alias("open")))
    child = parents.where("parent is not null").groupBy("conv", F.col("parent").alias("turn")).agg(F.min("turn").alias("child"))
    after = up.join(child, ["conv", "turn"], "left").select("conv", "turn", F.coalesce("child", "to").alias("to")).withColumn("behind", F.when(F.col("to").isNotNull(), 1).otherwise(0).cast("long"))
    behind = _doubled(after, "to is not null", lambda s: s.select("conv", "turn", F.col("ahead.to").alias("to"), (F.col("behind") + F.coalesce("ahead.behind", F.lit(0))).alias("behind")))
    size = behind.join(root.select("conv", "turn", "root"), ["conv", "turn"])
    most = size.where("turn = root").select("conv", "root", F.col("behind").alias("most"))
    return size.join(most, ["conv", "root"]).select("conv", "turn", "root", (F.col("most") - F.col("behind")).alias("place"))


def thread(conversations: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, root, place, reply_to, n_quotes, n_linked, text): one row for each message, whose order by
    (conv_id, root, place) is the reply order; text is without quotes.

    A message replies to the source of its first passage of the lowest quote level that has one. Without such a passage
    it starts a tree of its own, so conversations without quotes stay in turn order. Quoted lines start with ``>``, once
    for each level. A source is looked for in the same conversation only, among messages of smaller turn. Messages with
    the same conversation and turn are one message, the one of least (text, role); rows without conversation or turn are left out; a
    null text stays null and quotes nothing. An empty table gives an empty result.
    """
    named = conversations.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(text).alias("text"), F.col(role).alias("role")).where("conv is not null and turn is not null")
    messages = named.groupBy("conv", "turn").agg(F.min(F.struct("text", "role")).alias("m")).select("conv", "turn", "m.text", "m.role")
    quote = saved(link_quotes(messages.select("conv", "turn", "text")))
    first = F.min(F.when(F.col("source").isNotNull(), F.struct("level", "run", "source")))
    linked = quote.groupBy("conv", "turn").agg(F.count("*").alias("n_quotes"), F.count("source").alias("n_linked"), first["source"].alias("reply_to"))
    reply = linked.where("reply_to is not null").select("conv", "turn", F.col("reply_to").alias("parent"))
    both = reply.union(reply.select("conv", F.col("parent").alias("turn"), F.lit(None).cast(messages.schema["turn"].dataType).alias("parent")))
    order = reply_order(both.groupBy("conv", "turn").agg(F.max("parent").alias("parent")))
    got = messages.join(linked, ["conv", "turn"], "left").join(order, ["conv", "turn"], "left")
    zero = F.lit(0).cast("long")
    return got.select(
        F.col("conv").alias("conv_id"), "turn", "role", F.coalesce("root", "turn").alias("root"), F.coalesce("place", zero).alias("place"), "reply_to", F.coalesce("n_quotes", zero).alias("n_quotes"), F.coalesce("n_linked", zero).alias("n_linked"), own_text(F.col("text")).alias("text")
    )


#: Words of the partial quotes that ``with_quotes`` makes.
PARTIAL = (4, 6, 8, 10, 15, 18)


def with_quotes(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) whose messages quote those before them, by their numbers: the last message
    whole with an attribution, 4 to 18 words of it broken anew, the last two at two levels, or nothing. The given
    conversations have no quotes."""
    own = conversations.where("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.min(F.struct("text", "role")).alias("m")).select("conv_id", "turn", "m.role", "m.text")
    back = lambda n: own.select("conv_id", (F.col("turn") + n).alias("turn"), F.col("text").alias(f"t{n}"))
    three = own.join(back(1), ["conv_id", "turn"], "left").join(back(2), ["conv_id", "turn"], "left")
    quoted = lambda mark, t: F.concat(F.lit(mark), F.replace(F.col(t), F.lit("\n"), F.lit(f"\n{mark}")), F.lit("\n"))
    w = F.split(F.translate("t1", "\n", " "), " ")
    n = F.get(F.array(*map(F.lit, PARTIAL)), F.pmod(F.floor((F.col("conv_id") + F.col("turn")) / 4), F.lit(len(PARTIAL))).cast("int"))
    third = F.ceil(n / 3).cast("int")
    line = lambda k: F.when(n > k * third, F.concat(F.lit("> "), F.array_join(F.slice(w, 3 + k * third, F.least(third, n - k * third)), " "), F.lit("\n"))).otherwise("")
    some = F.concat(*map(line, range(3)))
    kind = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4))
    before = F.when(kind == 0, F.concat(F.lit("On Monday someone wrote:\n"), quoted("> ", "t1"))).when((kind == 1) & (F.size(w) >= 24), some).when(kind == 2, F.concat(F.coalesce(quoted(">> ", "t2"), F.lit("")), quoted("> ", "t1")))
    return three.select("conv_id", "turn", "role", F.when(F.col("text").isNotNull(), F.concat(F.coalesce(before, F.lit("")), "text")).alias("text"))


def op2_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, with quotes made of the messages before."""
    return thread(with_quotes(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


#: Quotes, links and trees spelled out; places in a tree by recursive paths.
THREAD_SQL = r"""
WITH RECURSIVE msg AS (SELECT conv_id, turn, min(text) AS text, arg_min(role, (text, role)) AS role FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn),
line AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM msg WHERE regexp_matches(text, '(?m)^[ \t]*>')),
lev AS (SELECT conv_id, turn, pos, length(regexp_replace(regexp_extract(line, '^((?:[ \t]*>)*)', 1), '[^>]', '', 'g')) AS level,
               trim(regexp_replace(line, '^((?:[ \t]*>)*)', '')) AS line FROM line),
run AS (SELECT *, sum(new) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS run FROM (
  SELECT *, CASE WHEN level <> lag(level, 1, -1) OVER (PARTITION BY conv_id, turn ORDER BY pos) THEN 1 ELSE 0 END AS new FROM lev) x),
quote AS (SELECT conv_id, turn, run, level, string_agg(line, ' ' ORDER BY pos) AS passage FROM run WHERE level > 0 GROUP BY conv_id, turn, run, level),
own AS (SELECT conv_id, turn, role, CASE WHEN regexp_matches(text, '(?m)^[ \t]*>')
               THEN trim(array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT regexp_matches(x, '^[ \t]*>')
                 AND NOT (regexp_matches(x, '(?i)^[ \t]*(on|am|le|el) .{0,200} (wrote|schrieb|écrit|escribió).{0,80}:[ \t]*$') AND coalesce(regexp_matches(string_split(text, chr(10))[i + 1], '^[ \t]*>'), false))), chr(10))) ELSE text END AS text FROM msg),
said AS (
  SELECT conv_id, norm, min(turn) AS source FROM (
    SELECT conv_id, turn, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS norm, true AS whole FROM own
    UNION ALL
    SELECT conv_id, turn, trim(regexp_replace(lower(t), '[^\p{L}\p{N}]+', ' ', 'g')), false FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS t FROM own) a) b
  WHERE norm <> '' AND (whole OR len(string_split(norm, ' ')) >= 4) GROUP BY conv_id, norm),
ask AS (
  SELECT DISTINCT conv_id, turn, run, whole, norm FROM (
    SELECT conv_id, turn, run, true AS whole, trim(regexp_replace(lower(passage), '[^\p{L}\p{N}]+', ' ', 'g')) AS norm FROM quote
    UNION ALL
    SELECT conv_id, turn, run, false, trim(regexp_replace(lower(line), '[^\p{L}\p{N}]+', ' ', 'g')) FROM run WHERE level > 0) a
  WHERE norm <> '' AND (whole OR len(string_split(norm, ' ')) >= 4)),
whole AS (SELECT conv_id, turn, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS norm FROM own),
part AS (
  SELECT q.conv_id, q.turn, q.run, min(n.turn) AS source FROM (SELECT conv_id, turn, run, trim(regexp_replace(lower(passage), '[^\p{L}\p{N}]+', ' ', 'g')) AS norm FROM quote) q JOIN whole n ON n.conv_id = q.conv_id AND n.turn < q.turn
  WHERE len(string_split(q.norm, ' ')) >= 4 AND contains(' ' || n.norm || ' ', ' ' || q.norm || ' ') GROUP BY q.conv_id, q.turn, q.run),
found AS (
  SELECT conv_id, turn, run, coalesce(a.w, p.source, a.l) AS source FROM (SELECT conv_id, turn, run, min(source) FILTER (whole) AS w, max(source) FILTER (NOT whole) AS l FROM ask JOIN said USING (conv_id, norm) WHERE source < turn GROUP BY conv_id, turn, run) a
  FULL JOIN part p USING (conv_id, turn, run)),
link AS (SELECT conv_id, turn, run, level, source FROM quote LEFT JOIN found USING (conv_id, turn, run)),
per AS (SELECT conv_id, turn, count(*) AS n_quotes, count(source) AS n_linked, arg_min(source, (level, run)) FILTER (source IS NOT NULL) AS reply_to FROM link GROUP BY conv_id, turn),
tree AS (
  SELECT conv_id, turn, turn AS root, [turn] AS path FROM msg LEFT JOIN per USING (conv_id, turn) WHERE reply_to IS NULL
  UNION ALL
  SELECT p.conv_id, p.turn, t.root, list_append(t.path, p.turn) FROM tree t JOIN per p ON p.conv_id = t.conv_id AND p.reply_to = t.turn)
SELECT o.conv_id, o.turn, o.role, t.root, row_number() OVER (PARTITION BY o.conv_id, t.root ORDER BY t.path) - 1 AS place, per.reply_to,
       coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked, o.text
FROM own o JOIN tree t USING (conv_id, turn) LEFT JOIN per USING (conv_id, turn)
"""

_QUOTED = r"""
WITH RECURSIVE m0 AS (SELECT conv_id, turn, min(text) AS text, arg_min(role, (text, role)) AS role FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn),
m1 AS (SELECT m.*, (m.conv_id + m.turn) % 4 AS kind, [4, 6, 8, 10, 15, 18][(m.conv_id + m.turn) // 4 % 6 + 1] AS n, CAST(ceil(n / 3) AS INT) AS third, p.text AS t1, q.text AS t2, string_split(translate(p.text, chr(10), ' '), ' ') AS w
  FROM m0 m LEFT JOIN m0 p ON p.conv_id = m.conv_id AND p.turn = m.turn - 1 LEFT JOIN m0 q ON q.conv_id = m.conv_id AND q.turn = m.turn - 2),
msg AS (SELECT conv_id, turn, role, coalesce(CASE
    WHEN kind = 0 THEN 'On Monday someone wrote:' || chr(10) || '> ' || replace(t1, chr(10), chr(10) || '> ') || chr(10)
    WHEN kind = 1 AND len(w) >= 24 THEN array_to_string(list_transform(list_filter([0, 1, 2], lambda k: n > k * third), lambda k: '> ' || array_to_string(w[3 + k * third : 2 + least(n, (k + 1) * third)], ' ') || chr(10)), '')
    WHEN kind = 2 THEN coalesce('>> ' || replace(t2, chr(10), chr(10) || '>> ') || chr(10), '') || '> ' || replace(t1, chr(10), chr(10) || '> ') || chr(10) END, '') || text AS text FROM m1),
"""
#: The same of the conversations with quotes.
SQL = _QUOTED + THREAD_SQL.split("\n", 2)[2]
