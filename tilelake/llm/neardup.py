"""MinHash near-duplicates with BagMinHash signatures of word shingles.

Weights are the counts of a document's shingles, discretised to whole numbers. The weight axis of a shingle is cut into
the intervals [0, 1), [1, 2), [2, 4), [4, 8) and so on. Each carries a Poisson process of points with a register each,
and an interval of more than 1 is a binary tree: its next point is passed to one half by a coin, after which both halves
go on by themselves. A point counts if it lies below the weight. Points come in rising order, so an interval is left as
soon as its next point is above all of the document's registers; heavy shingles cost little more than light ones. The
identity of the least point of each register is the signature, and two registers agree with the probability of the
weighted Jaccard similarity of the two multisets.

Candidates share a band of registers. Texts of equal words are one text from the start. In each bucket every text is
verified against the bucket's least id, its head, and links are closed to components; then the texts outside the
bucket's largest component are verified against a head of their own, and so on for ``ROUNDS`` rounds. Each round gives as
many pairs as there are texts. Where a bucket still holds more than one component, the texts of its largest component
are compared with the others, and the others with each other, in blocks of bounded size: first by signature, each pair
only in the first band whose whole keys are equal, then the texts that have a possible partner by exact overlap. Heads
are left out, as they have met everyone. A block gives at most one link for each text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilelake.llm.shared import saved, written
from tilelake.llm.words import Words, grams, mix, words

BANDS, ROWS = 32, 4
M = BANDS * ROWS
SHINGLE, LEAST = 5, 0.8
#: Texts of a block of a bucket, and shingles of a block at most, but for a text that has more by itself.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Heads of a bucket that all its texts are verified against before blocks are made.
ROUNDS = 2
#: Standard deviations of the signature's estimate below LEAST at which a pair is ruled out.
SLACK = 5.5

_C = [np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def bag_min_hash(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int, m: int = M) -> np.ndarray:
    """n_docs × m identities of least points. doc, h, weight: the distinct elements of each document, weights >= 1. A
    document without elements has zeros."""
    least, winner = np.full(n_docs * m, np.inf), np.zeros(n_docs * m, np.uint64)
    parts, low, size, k = [], 0, 1, 0
    while len(at := np.flatnonzero(weight > low)):
        parts.append((doc[at], mix(h[at] + np.full(1, k, np.uint64) * _C[0]), np.full(len(at), size), np.full(len(at), low), weight[at]))
        low, size, k = low + size, low + size, k + 1
    if not parts:
        return winner.reshape(n_docs, m)
    d, s, size, low, w = (np.concatenate(x) for x in zip(*parts, strict=True))
    x, count = np.zeros(len(d)), np.zeros(len(d), np.uint64)
    point = np.zeros(len(d), np.uint64)  # 0: the next point is not drawn yet
    highest = np.full(n_docs, np.inf)

    def note(d, x, p):
        at = d * m + (p % np.uint64(m)).astype(np.int64)
        np.minimum.at(least, at, x)
        won = least[at] == x
        winner[at[won]] = p[won]

    while len(d):
        draw = np.flatnonzero(point == 0)
        key = mix(s[draw] + count[draw] * _STEP)
        x[draw] -= np.log(_uniform(mix(key ^ _C[1]))) / (size[draw] * float(m))
        point[draw] = mix(key ^ _C[2]) | np.uint64(1) << np.uint64(63)
        full = low + size <= w
        note(d[full], x[full], point[full])
        touched = np.unique(d)
        highest[touched] = least.reshape(n_docs, m)[touched].max(axis=1)
        on = x < highest[d]
        d, s, size, low, w, x, count, point = (v[on] for v in (d, s, size, low, w, x, count, point))
        leaf = size == 1
        # leaves go on; when few are left, several points of each are drawn at once
        ld, ls, llow, lw, lx, lc = (v[leaf] for v in (d, s, low, w, x, count))
        lc = lc + np.uint64(1)
        several = int(min(64, 8192 // max(1, len(ld))))
        if several > 1 and len(ld):
            key = mix(ls[:, None] + (lc[:, None] + np.arange(several, dtype=np.uint64)) * _STEP)
            xs = np.cumsum(np.concatenate([lx[:, None], -np.log(_uniform(mix(key ^ _C[1]))) / float(m)], axis=1), axis=1)[:, 1:]
            ps = mix(key ^ _C[2]) | np.uint64(1) << np.uint64(63)
            note(np.repeat(ld, several), xs.ravel(), ps.ravel())
            lx, lc = xs[:, -1].copy(), lc + np.uint64(several)
        # the halves of the others; the one that the coin names has the point
        b = ~leaf
        half = size[b] // 2
        coin = mix(s[b] ^ _C[3]) & np.uint64(1)
        kids = [(d[b], mix(s[b] + np.full(1, side + 1, np.uint64) * _C[4]), half, low[b] + side * half, w[b], x[b], np.zeros(b.sum(), np.uint64), np.where(coin == side, point[b], np.uint64(0))) for side in (0, 1)]
        new = [np.concatenate(v) for v in zip((ld, ls, np.ones(len(ld), np.int64), llow, lw, lx, lc, np.zeros(len(ld), np.uint64)), *kids, strict=True)]
        inside = new[3] < new[4]
        d, s, size, low, w, x, count, point = (v[inside] for v in new)
    return winner.reshape(n_docs, m)


def shingles(w: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, hash and count of the distinct shingles of a slice, sorted."""
    g, at = grams(h, w.first, SHINGLE)
    doc = np.searchsorted(w.first, at, "right") - 1
    order = np.lexsort((g, doc))
    doc, g = doc[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], g[at], np.diff(np.append(at, len(g)))


def bands_of(sig: np.ndarray) -> np.ndarray:
    """Texts × BANDS: a 64-bit key of each band."""
    out = np.zeros((len(sig), BANDS), np.uint64)
    for b in range(BANDS):
        out[:, b] = np.uint64(b + 1)
        for k in range(b * ROWS, b * ROWS + ROWS):
            out[:, b] = mix(out[:, b] + sig[:, k])
    return out


def short(sig: np.ndarray) -> np.ndarray:
    """16 bits of each register. A register's lowest bits only say which one it is, so they are no news."""
    return ((sig >> np.uint64(7)) & np.uint64(0xFFFF)).astype(np.uint16)


def _sign(it):
    for b in it:
        ids, parts = b.column(0), []
        for w in words(b.column(1)):
            h = w.hashes()
            n_docs = len(w.first) - 1
            doc, g, count = shingles(w, h)
            sig = bag_min_hash(doc, g, count, n_docs)
            n = np.bincount(doc, count, n_docs).astype(np.int64)
            # a 128-bit hash of the sequence of words
            place = (np.arange(len(h)) - np.repeat(w.first[:-1], np.diff(w.first))).astype(np.uint64)
            key = []
            for c in (_C[0], _C[1]):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ mix(place + c)), dtype=np.uint64)])
                key.append(mix(total[w.first[1:]] - total[w.first[:-1]] + np.diff(w.first).astype(np.uint64)).view(np.int64))
            parts.append((n, *key, short(sig), bands_of(sig)))
        if not parts:
            continue
        n, k1, k2, tags, bands = (np.concatenate(x) for x in zip(*parts, strict=True))
        some = n > 0
        lists = pa.ListArray.from_arrays(np.arange(len(n) + 1, dtype=np.int32) * BANDS, pa.array(bands.view(np.int64).ravel()))
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(n), pa.array(k1), pa.array(k2), pa.array([x.tobytes() for x in tags], pa.binary()), lists.filter(pa.array(some)) if some.all() else pa.array([x if y else [] for x, y in zip(lists.to_pylist(), some, strict=True)], pa.list_(pa.int64()))],
            names=["id", "n", "k1", "k2", "sig", "bands"],
        )


def units(text: pa.Array) -> list[np.ndarray]:
    """For each text its sorted shingle occurrences: hashes of (shingle, 1), (shingle, 2), ... up to its count."""
    out: list[np.ndarray] = []
    for w in words(text):
        doc, g, count = shingles(w, w.hashes())
        many = np.repeat(np.arange(len(g)), count)
        turn = np.arange(len(many)) - np.repeat(np.cumsum(count) - count, count)
        u, owner = g[many], doc[many]
        u = np.where(turn > 0, mix(u + turn.astype(np.uint64) * _C[2]), u)
        order = np.lexsort((u, owner))
        edge = np.searchsorted(owner[order], np.arange(len(w.first)))
        u = u[order]
        out += [u[edge[k] : edge[k + 1]] for k in range(len(w.first) - 1)]
    return out


def _similar(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _verify(it):
    """Links of the texts that follow a head's row (text of a, b null) in a partition that is sorted by (a, block, b)."""
    head, own = None, None
    for batch in (b.slice(k, 1024) for b in it for k in range(0, b.num_rows, 1024)):
        members = units(batch.column(2))
        keep = []
        for k, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if b is None:
                head, own = a, members[k]
            elif a == head and _similar(own, members[k]) >= LEAST:
                keep.append(k)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], names=["a", "b"])


def verified(pairs: DataFrame, body: DataFrame) -> DataFrame:
    """The pairs (a, b) of similar texts. A head's text goes once to each block of its members, which are dealt out by
    block, so a head that many texts share is no hot key."""
    size = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_blocks"))
    dealt = pairs.join(size, "a").withColumn("block", F.pmod(F.xxhash64("b"), F.col("n_blocks")).cast("int")).select("a", "b", "block")
    members = dealt.join(body.select(F.col("id").alias("b"), "text"), "b").select("a", "b", "text", "block")
    heads = size.join(body.select(F.col("id").alias("a"), "text"), "a").select("a", F.lit(None).cast("long").alias("b"), "text", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"))
    sorted_ = members.unionByName(heads).repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())
    return sorted_.select("a", "b", "text").mapInArrow(_verify, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, c) of each id in edges (a, b): c is the least id that it is connected to. Labels spread along edges and jump
    to the label of their label, so the number of rounds grows with the logarithm of the longest chain."""
    both = saved(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = saved(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("c")))
    while True:
        near = both.join(label.select(F.col("id").alias("b"), F.col("c").alias("near")), "b").groupBy(F.col("a").alias("id")).agg(F.min("near").alias("near"))
        step = label.join(near, "id").select("id", F.least("c", "near").alias("c"), F.col("c").alias("old"))
        jump = label.select(F.col("id").alias("c"), F.col("c").alias("further"))
        step = saved(step.join(jump, "c", "left").select("id", F.least("c", "further").alias("c"), "old"))
        if not step.where("c != old").limit(1).count():
            return step.select("id", "c")
        label = step.select("id", "c")


def _possible(pdf: pd.DataFrame) -> pd.DataFrame:
    """The texts of a block (or of two) that have a possible partner in another component, whose first common band is
    this bucket's."""
    sig = np.frombuffer(b"".join(pdf["sig"]), np.uint16).reshape(len(pdf), M)
    bands = np.stack(pdf["bands"].to_numpy())
    n, c, side = pdf["n"].to_numpy(), pdf["c"].to_numpy(), pdf["side"].to_numpy()
    band, two = int(pdf["band"].iloc[0]), pdf["i"].iloc[0] != pdf["j"].iloc[0]
    limit = M * (LEAST - SLACK * np.sqrt(LEAST * (1 - LEAST) / M))
    rows = np.zeros(len(pdf), bool)
    xs = np.flatnonzero(side == 0) if two else np.arange(len(pdf))
    ys = np.flatnonzero(side == 1) if two else np.arange(len(pdf))
    for x in xs:
        some = ys[(c[ys] != c[x]) & (n[ys] >= LEAST * n[x]) & (n[x] >= LEAST * n[ys])]
        some = some[(sig[some] == sig[x]).sum(axis=1) >= limit]
        if len(some):
            some = some[(bands[some] == bands[x]).argmax(axis=1) == band]
            rows[some] = True
            rows[x] |= len(some) > 0
    return pdf.loc[rows, ["key", "i", "j", "side", "id", "c"]]


def _links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between components among the texts of a block, at most one less than there are texts, by exact overlap."""
    own = units(pa.array(pdf["text"], pa.string()))
    ids, c = pdf["id"].to_numpy(), pdf["c"].to_numpy()
    n = np.array([len(x) for x in own])
    owner, every = np.repeat(np.arange(len(own)), n), np.concatenate(own)
    values, column, times = np.unique(every, return_inverse=True, return_counts=True)
    keep = times[column] > 1
    names, column = np.unique(column[keep], return_inverse=True)
    owner, both = owner[keep], np.zeros((len(own), len(own)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for lo in range(0, len(names), 2048):
        a, b = np.searchsorted(column, [lo, lo + 2048])
        dense = np.zeros((len(own), 2048), np.float32)
        dense[owner[a:b], column[a:b] - lo] = 1
        both += dense @ dense.T
    root = {x: x for x in c}

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    x, y = np.nonzero(np.triu(both >= LEAST * (n[:, None] + n[None, :] - both), 1))
    for i, j in zip(x, y, strict=True):
        p, q = top(c[i]), top(c[j])
        if p != q:
            root[p] = q
            out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, n_shingles) for each row of docs; class_id is the least doc_id of the document's class.

    Two texts are linked if the multisets of their runs of five words have a Jaccard similarity of 0.8 or more; classes
    are the components of links. Words: A-Z lower-cased, then ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; a text of one to four
    words has one shingle of them all. Texts with equal words are in one class. Null, empty and wordless texts are in no
    class but their own, with n_shingles 0. A null doc_id has a null class. Rows with the same doc_id are one document:
    they have one class, and a link of any of them counts. A pair at exactly 0.8 shares no band of four registers in 32
    with probability 5e-8; in a bucket with several components it is ruled out by its signature with probability 2e-7
    (``SLACK``); both fall fast above 0.8. doc_id must be a whole number. An empty table gives an empty result.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    signed = written(own.mapInArrow(_sign, "id long, n long, k1 long, k2 long, sig binary, bands array<long>"), "signed")
    real = signed.where("n > 0 and id is not null")
    rep = saved(real.groupBy("k1", "k2").agg(F.min(F.struct("id", "n", "sig", "bands")).alias("r")).select("k1", "k2", "r.*"))
    in_band = rep.select("id", "n", F.posexplode("bands").alias("band", "key"))
    shared = in_band.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("id", "n")).alias("head")).where("size > 1")
    member = saved(in_band.join(shared, "key").select("key", "band", "size", "id", "n", F.col("head.id").alias("head"), F.col("head.n").alias("head_n")))
    body = written(own.join(member.select("id").distinct(), "id", "left_semi"), "bodies")
    fits = (F.least("n", "head_n") >= LEAST * F.greatest("n", "head_n")) & (F.col("id") != F.col("head"))
    links = saved(verified(member.where(fits).select(F.col("head").alias("a"), F.col("id").alias("b")).distinct(), body))
    same = components(links)
    member, met = member.where("id != head").select("key", "band", "id", "n"), 1
    while True:
        # buckets that hold more than one component beside their heads, with the largest one
        named = saved(member.join(same, "id", "left").withColumn("c", F.coalesce("c", "id")))
        size = named.groupBy("key", "c").agg(F.count("*").alias("size"), F.sum("n").alias("sum_n"))
        mixed = size.groupBy("key").agg(F.max(F.struct("size", "c", "sum_n")).alias("big"), F.sum("size").alias("size"), F.sum("sum_n").alias("sum_n")).where("size > big.size")
        if met == ROUNDS or not mixed.limit(1).count():
            break
        heads = named.join(mixed.select("key", F.col("big.c").alias("big")), "key").where("c != big")
        heads = saved(heads.groupBy("key").agg(F.min(F.struct("id", "n", "c")).alias("h")).select("key", F.col("h.id").alias("head"), F.col("h.n").alias("head_n"), F.col("h.c").alias("head_c")))
        pairs = named.join(heads, "key").where(fits & (F.col("c") != F.col("head_c"))).select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
        links = saved(links.union(verified(pairs, body)))
        same = components(links)
        member, met = member.join(heads.select("key", F.col("head").alias("id")), ["key", "id"], "left_anti"), met + 1

    # block numbers: those of the smaller components first
    blocks_of = lambda n, sum_n: F.ceil(F.greatest(n / BLOCK, sum_n / BLOCK_SHINGLES)).cast("int")
    dealt = mixed.select("key", F.col("big.c").alias("big"), blocks_of(F.col("size") - F.col("big.size"), F.col("sum_n") - F.col("big.sum_n")).alias("n_rest"), blocks_of(F.col("big.size"), F.col("big.sum_n")).alias("n_big"))
    placed = named.join(dealt, "key").join(rep.select("id", "sig", "bands"), "id").withColumn("in_big", F.col("c") == F.col("big"))
    placed = placed.withColumn("k", F.pmod(F.xxhash64("id", "key"), F.when(F.col("in_big"), F.col("n_big")).otherwise(F.col("n_rest"))).cast("int") + F.when(F.col("in_big"), F.col("n_rest")).otherwise(0))
    others = F.sequence(F.lit(0), F.col("n_rest") - 1 + F.when(F.col("in_big"), 0).otherwise(F.col("n_big")))
    with_other = F.explode(F.transform(others, lambda o: F.struct(F.least("k", o).alias("i"), F.greatest("k", o).alias("j"), (F.col("k") > o).cast("int").alias("side"))))
    blocks = placed.select("key", "band", "id", "n", "c", "sig", "bands", with_other.alias("o")).select("key", "band", "id", "n", "c", "sig", "bands", "o.*")
    possible = saved(blocks.groupBy("key", "i", "j").applyInPandas(_possible, "key long, i int, j int, side int, id long, c long"))
    more = saved(possible.join(body, "id").groupBy("key", "i", "j").applyInPandas(_links, "a long, b long").distinct())
    if more.limit(1).count():
        same = components(links.union(more))
    classes = rep.select("k1", "k2", "id").join(same, "id", "left").select("k1", "k2", F.coalesce("c", "id").alias("class_id"))
    got = signed.select("id", "n", "k1", "k2").join(classes, ["k1", "k2"], "left")
    return got.select(F.col("id").alias("doc_id"), F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("class_id"))).otherwise(F.col("id")).alias("class_id"), F.col("n").alias("n_shingles"))


def op6_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
sh AS (
  SELECT doc_id, s, count(*) AS c FROM (
    SELECT doc_id, list_slice(w, i, i + 4) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM doc WHERE len(w) > 0) t) u GROUP BY doc_id, s),
n AS (SELECT doc_id, CAST(sum(c) AS BIGINT) AS n FROM sh GROUP BY doc_id),
meet AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.c, b.c)) AS m FROM sh a JOIN sh b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM meet JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE m >= 0.8e0 * (x.n + y.n - m)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT d.doc_id, min(r.b) AS class_id, coalesce(any_value(n.n), 0) AS n_shingles
FROM documents d JOIN reach r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
