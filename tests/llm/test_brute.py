"""Operators without SQL, against plain Python."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tilelake.llm import bytebpe, decontaminate, licences, neardup, pii, quality, tokenfile, urlrules, words

RANKS, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")


def test_words_and_hashes(documents):
    texts = [r.text for r in documents.limit(50).collect()] + [None, "", "A b\u00e9 7x", "\u6f22"]
    got = []
    for w in words.words(pa.array(texts), limit=3000):
        got += [[w.data[w.start[k] : w.end[k]].tobytes().decode() for k in range(w.first[d], w.first[d + 1])] for d in range(len(w.rows))]
        h = w.hashes()
        seen = {}
        assert all(seen.setdefault(w.data[a:b].tobytes(), x) == x for a, b, x in zip(w.start, w.end, h.tolist(), strict=True))
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    assert got == [re.findall(words.WORD, low(t)) for t in texts]


# PII


def keyed(key, *parts):
    return int(hashlib.sha256("\x1f".join([key, *map(str, parts)]).encode()).hexdigest()[:15], 16)


def number(v, a, b, key, tweak):
    left, right = divmod(v, b)
    for k in range(pii.ROUNDS):
        if k % 2 == 0:
            left = (left + keyed(key, tweak, k, right)) % a
        else:
            right = (right + keyed(key, tweak, k, left)) % b
    return left * b + right


def string(s, key, tweak):
    left, right = s[: len(s) // 2], s[len(s) // 2 :]

    def turn(part, other, k):
        out = ""
        for i, c in enumerate(part):
            for first, n in (("0", 10), ("a", 26), ("A", 26)):
                if ord(first) <= ord(c) < ord(first) + n:
                    c = chr((ord(c) - ord(first) + keyed(key, tweak, k, i, other)) % n + ord(first))
                    break
            out += c
        return out

    for k in range(pii.ROUNDS):
        if k % 2 == 0:
            left = turn(left, right, k)
        else:
            right = turn(right, left, k)
    return left + right


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def plain_pseudonym(m, key):
    """The kinds that the given documents have: cards, phones, addresses of machines and mail."""
    v = m.group(0)
    digits = re.sub("[^0-9]", "", v)
    if "@" in v:
        name, at = v.split("@", 1)
        new = string(name.lower(), key, "email")
        return "".join(n.upper() if o.isupper() else n for o, n in zip(name, new, strict=True)) + "@" + at
    if re.fullmatch(pii.FORMATS["ipv4"], v):
        parts = [int(x) for x in v.split(".")]
        n = number(int.from_bytes(bytes(parts), "big"), 65536, 65536, key, "ipv4") if max(parts) < 256 else None
        return v if n is None else ".".join(str(x) for x in n.to_bytes(4, "big"))
    if re.fullmatch(pii.FORMATS["phone"], v) and v.startswith("+1 "):
        area, middle, line = int(digits[1:4]), int(digits[4:7]), int(digits[7:])
        (a, n), (b, m) = ((200, 800) if x >= 200 else (0, 200) for x in (area, middle))
        left, line = divmod(number(((area - a) * m + middle - b) * 10000 + line, n * m, 10000, key, "phone 1"), 10000)
        new = iter(f"{a + left // m:03}{b + left % m:03}{line:04}")
        return "+1" + re.sub("[0-9]", lambda _: next(new), v[2:])
    if re.fullmatch(pii.FORMATS["card"], v) and luhn(digits):
        body = string(digits[:-1], key, "card")
        new = iter(body + next(c for c in "0123456789" if luhn(body + c)))
        return re.sub("[0-9]", lambda _: next(new), v)
    return v


def test_pseudonyms_equal_plain_python(documents):
    key = "some key"
    got = pii.pseudonymise(documents.select("doc_id", "text"), key).select("text", "pii.*").collect()
    changed = 0
    for r in got:
        assert r[1] == re.sub(pii.PATTERN, lambda m: plain_pseudonym(m, key), r[0])
        changed += len(r.found)
        if not r.found:
            assert r[1] == r[0]
    assert changed > 10


def found(spark, key, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    return [r for r in pii.pseudonymise(df, key).select("pii.*").collect()]


def test_formats_stay_valid(spark):
    texts = ["4111-1111-1111-1111 and 4111 1111 1111 1111", "2020-02-29 31/12/2020 12/31/2020 3.4.1999", "123-45-6789", "DE89 3704 0044 0532 0130 00", "a.b9@x.example.org", "+44 20 7946 0958", "10.0.0.1"]
    r = found(spark, "k", *texts)
    kinds = [[x.kind for x in y.found] for y in r]
    assert kinds == [["card"] * 2, ["date"] * 4, ["ssn"], ["iban"], ["email"], ["phone"], ["ipv4"]]
    a, b = (re.sub("[^0-9]", "", x.value) for x in r[0].found)
    assert a == b and luhn(a)
    assert int(r[1].found[2].value.split("/")[1]) > 12
    iban = r[3].found[0].value.replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert re.fullmatch(r"\+44 \d\d \d{4} \d{4}", r[5].found[0].value)


def canonical(kind, v):
    if kind == "date":
        a, b, c = (int(x) for x in re.split("[-/.]", v))
        return (a, b, c) if a > 31 else (c, a, b) if b > 12 else (c, b, a)
    if kind == "phone":
        return re.sub("[^0-9]", "", v if v.startswith("+") else f"1{v}")
    return v.lower().replace("-", "").replace(" ", "")


def test_one_value_in_all_spellings_has_one_pseudonym(spark):
    """Spellings of a number, day or address; pseudonyms are found again as their kind, and have their format."""
    same = [
        ["+442079460958", "+44 20 7946 0958", "+44 (20) 7946 0958", "+4420 7946 0958"], ["(212) 555-0199", "212-555-0199", "+1 212 555 0199", "+12125550199", "+1 (212) 555-0199"], ["+1 (017) 555-7713", "+1 017 555 7713"],
        ["12/31/2020", "2020-12-31", "31/12/2020", "31.12.2020"], ["2020-03-04", "04/03/2020", "4.3.2020"], ["Some.One9@x.example.org", "some.one9@x.example.org", "SOME.ONE9@x.example.org"], ["4111111111111111", "4111-1111-1111-1111"], ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00"],
    ]
    flat = [v for x in same for v in x]
    once = [r.found for r in found(spark, "k", *flat)]
    again = [r.found for r in found(spark, "k", *[x[0].value for x in once])]
    assert all(len(x) == len(y) == 1 and x[0].kind == y[0].kind for x, y in zip(once, again, strict=True))
    new = iter(x[0] for x in once)
    for x in same:
        assert len({canonical(v.kind, v.value) for v in (next(new) for _ in x)}) == 1, x
    numbers = [f"{a}-{b}-{n:04}" for a, b, n in ((212 + k % 700, 200 + k * 7 % 800, k * 37 % 10000) for k in range(400))]
    made = [r.found[0].value for r in found(spark, "k", *numbers)]
    assert len(set(made)) == len(set(numbers)) and all(re.fullmatch("[2-9][0-9]{2}-[2-9][0-9]{2}-[0-9]{4}", x) for x in made)


def test_key_is_not_in_plans(spark):
    df = spark.createDataFrame([("call +44 20 7946 0958",)], "text string")
    spark.conf.set(pii.KEY_CONF, "very secret")
    try:
        made = pii.pseudonymise(df, pii.secret(spark))
        assert made.select("pii.text").first() == pii.pseudonymise(df, "very secret").select("pii.text").first() and made.columns == ["text", "pii"]
        assert "very secret" not in made._jdf.queryExecution().toString()
    finally:
        spark.conf.unset(pii.KEY_CONF)


def test_a_key_is_required(spark):
    for empty in (False, True):
        if empty:
            spark.conf.set(pii.KEY_CONF, "")
        try:
            with pytest.raises(ValueError, match=pii.KEY_CONF):
                pii.secret(spark)
            with pytest.warns(UserWarning, match="public key"):
                assert pii.secret(spark, pii.TEST_KEY).first().key == pii.TEST_KEY
        finally:
            spark.conf.unset(pii.KEY_CONF)


def test_invalid_values_stay(spark):
    texts = ["4111111111111112", "300.1.2.3", "2021-02-30", "000-12-3456", "DE00370400440532013000", "DE99000000000000000030", "version 2.0.1 of 12", "x@y"]
    assert all(r.text == t and not r.found for r, t in zip(found(spark, "k", *texts), texts, strict=True))


def test_values_before_other_tokens(spark):
    """Codes, years, amounts and further numbers after a value are no part of it."""
    ibans = ["AT61 1904 3002 3457 3201", "ES9121000418450200051332", "BE68 5390 0754 7034", "SE45 5000 0000 0583 9825 7466", "RO49 AAAA 1B31 0075 9384 0000", "CZ65 0800 0000 1920 0014 5399", "DE89 3704 0044 0532 0130 00", "NO9386011117947"]
    texts = [f"pay {v} {after}" for v in ibans for after in ("EUR 500", "BIC", "2020", "AT61 1904 3002 3457 3201")]
    for t, r in zip(texts, found(spark, "k", *texts), strict=True):
        assert [x.kind for x in r.found] == ["iban"] * (2 if t.count("AT61") > t.startswith("pay AT61") else 1) and r.text.split()[1:] != t.split()[1:], t
        assert t.endswith("3201") or r.text.split()[-1] == t.split()[-1]
    tails = {
        "+1 (017) 555-7713": ["2020 12", "2020", "4111 1111 1111 1111"], "+44 20 7946 0958": ["2020", "2020 12 500", "2020-01-05", "078-05-1120", "4111 1111 1111 1111"],
        "+44 (20) 7946 0958 12": ["2020 55", "2020"], "+1 212 555 0199": ["05/06/2020", "1000"], "+49 30 1234 5678": ["5000 5000"],
    }
    cases = [(v, after) for v, some in tails.items() for after in some]
    for (v, after), r in zip(cases, found(spark, "k", *[f"call {v} {after}" for v, after in cases]), strict=True):
        assert r.found and r.found[0].kind == "phone" and v not in r.text, (v, after)
        second = {"2020-01-05": "date", "05/06/2020": "date", "078-05-1120": "ssn", "4111 1111 1111 1111": "card"}.get(after)
        assert [x.kind for x in r.found[1:]] == ([second] if second else []), (v, after)


def test_permutations_are_injective(spark):
    n = spark.range(73049)
    k = F.lit("k")
    assert n.select(pii.permute_number(F.col("id"), *pii.DAYS, k, "date").alias("v")).agg(F.countDistinct("v"), F.min("v"), F.max("v")).first() == (73049, 0, 73048)
    s = spark.range(10000).select(pii.permute_string(F.lpad(F.col("id").cast("string"), 4, "0"), k, "x").alias("v"))
    assert s.distinct().count() == 10000
    area = spark.range(0, 898 * 99, 97).select(F.concat_ws("-", F.lpad((F.floor(F.col("id") / 99) + F.when(F.floor(F.col("id") / 99) >= 665, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((F.col("id") % 99 + 1).cast("string"), 2, "0"), F.lit("0042")).alias("v"))
    made = area.select("v", pii._ssn(F.col("v"), k)[1].alias("n"), pii._ssn(F.col("v"), k)[0].alias("ok"))
    assert made.where("not ok").count() == 0 and made.select("n").distinct().count() == area.count()
    assert made.select(pii._ssn(F.col("n"), k)[0].alias("ok")).where("not ok").count() == 0


def test_pii_of_odd_rows(odd, crowded, empty):
    got = pii.pseudonymise(odd, "k").select("doc_id", "text", "pii.text").collect()
    assert all(r[1] == r[2] for r in got)
    assert pii.pseudonymise(crowded, "k").count() == odd.count() and pii.pseudonymise(empty, "k").count() == 0


# near-duplicates


@pytest.mark.parametrize("most", [2, 5, 300])
def test_signatures_estimate_weighted_jaccard(most):
    rng = np.random.default_rng(most)
    u, a, b = rng.integers(1, 1 << 62, 60, dtype=np.uint64), rng.integers(0, most, 60), rng.integers(0, most, 60)
    b[:40] = a[:40]
    doc, h, w = [], [], []
    for t in range(60):
        for side, x in enumerate((a, b)):
            k = np.flatnonzero(x)
            doc.append(np.full(len(k), 2 * t + side))
            h.append(words.mix(u + np.uint64(t * 7919))[k])
            w.append(x[k])
    sig = neardup.bag_min_hash(*(np.concatenate(x) for x in (doc, h, w)), 120)
    j = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[::2] == sig[1::2]).mean() - j) < 4 * (j * (1 - j) / (60 * neardup.M)) ** 0.5


def test_pairs_of_mixed_buckets_are_met_in_their_first_band():
    """Each of 4000 pairs at similarity 0.8 or a little more is met in exactly one of the buckets that it shares."""
    rng = np.random.default_rng(8)
    both, one = rng.integers(1, 1 << 62, (4000, 160), dtype=np.uint64), rng.integers(1, 1 << 62, (8000, 20), dtype=np.uint64)
    h = np.concatenate([np.repeat(both, 2, axis=0), one], axis=1)
    sig = neardup.bag_min_hash(np.repeat(np.arange(8000), 180), h.ravel(), np.ones(h.size, np.int64), 8000)
    bands, tags = neardup.bands_of(sig), neardup.short(sig)
    shared = bands[::2] == bands[1::2]
    assert shared.any(axis=1).mean() > 0.999
    assert ((tags[::2] == tags[1::2]) == (sig[::2] == sig[1::2])).mean() > 0.99995
    met = np.zeros(4000, int)
    for b in range(neardup.BANDS):
        pairs = np.flatnonzero(shared[:, b])
        for lo in range(0, len(pairs), 64):
            t = np.concatenate([2 * pairs[lo : lo + 64], 2 * pairs[lo : lo + 64] + 1])
            frame = pd.DataFrame({"key": 0, "i": 0, "j": 0, "side": 0, "id": t, "c": t, "n": 180, "band": b, "sig": [x.tobytes() for x in tags[t]], "bands": list(bands[t])})
            np.add.at(met, neardup._possible(frame)["id"].to_numpy() // 2, 1)
    met //= 2
    assert (met[shared.any(axis=1)] == 1).all()


@pytest.mark.parametrize(("rounds", "block"), [(2, 32)])
def test_large_family(spark, monkeypatch, rounds, block):
    """A family beyond the block size, whose least ids are near to no other; the others hang together or fall apart."""
    rnd = random.Random(4)
    base = [f"word{k}" for k in range(120)]
    texts = [(k, " ".join(base[:60] + [f"x{k}"] * k)) for k in range(3)]
    for k in range(3, 90):
        t = list(base)
        for _ in range(2 if k % 3 else 4):
            t[rnd.randrange(120)] = f"new{k}"
        texts.append((k, " ".join(t)))
    monkeypatch.setattr(neardup, "ROUNDS", rounds)
    monkeypatch.setattr(neardup, "BLOCK", block)
    got = neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    sets = {k: {(*t.split()[i : i + 5], t.split()[:i].count(t.split()[i])) for i in range(len(t.split()) - 4)} for k, t in texts}
    root = {k: k for k, _ in texts}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    assert {r.doc_id: r.class_id for r in got} == {k: top(k) for k in root}


# tokens


@pytest.fixture(scope="module")
def library():
    import tiktoken

    c = bytebpe.codec(RANKS)
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks={v: k for k, v in c.token.items()}, special_tokens={})


def test_tree_equals_library(library, monkeypatch):
    c, rnd = bytebpe.codec(RANKS), random.Random(7)
    assert all(c.merged(k) == [v] for k, v in c.ranks.items())
    some = ["a", "b", "'", "s", "t", "ll", " ", "  ", "\n", "1", "\u00e9", "\u6f22", "\U0001f600", "don't", " the", "!", "\u0301", "\xa0"]
    texts = ["".join(rnd.choice(some) for _ in range(rnd.randint(0, 80))) for _ in range(1500)]
    texts += ["".join(rnd.choice("abcdeinorst") for _ in range(rnd.randint(1, 400))) for _ in range(400)]  # long matches
    texts += ["a" * 30000, "ab" * 3000 + "c" * 5000, "\u6f22\u5b57" * 3000, "".join(rnd.choice("ABCxyz019+/") for _ in range(20000)), "=" * 4097, " " * 5000]
    monkeypatch.setattr(bytebpe, "KEPT", 500)
    monkeypatch.setattr(bytebpe, "PARTS", 300)
    for k, s in enumerate(texts):
        monkeypatch.setattr(bytebpe, "SHORT", (1, 2, 16)[k % 3])
        assert c.encode(s) == library.encode_ordinary(s) and c.decode(c.encode(s)) == s.encode()


def test_each_match_that_is_no_token_is_joined(library, documents, monkeypatch):
    c = bytebpe.Codec(RANKS)
    joins, joined = [], bytebpe.Codec.joined
    monkeypatch.setattr(bytebpe.Codec, "joined", lambda self, left, right: joins.append(1) or joined(self, left, right))
    seen = {m.group() for r in documents.limit(100).collect() for m in c.pattern.finditer(r.text or "")}
    for m in seen:
        before = len(joins)
        c.parts.clear()
        assert c[m] == library.encode_ordinary(m)
        assert (len(joins) > before) == (m.encode() not in c.ranks)
    assert len(joins) > len(seen) / 2


def test_byte_bpe_query(odd, crowded, documents, library, empty):
    for df in (odd, crowded, documents):
        for r in bytebpe.digest(df, RANKS).select("text", "tokens.*").collect():
            ids = library.encode_ordinary(r.text or "")
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert bytebpe.encode(empty, RANKS).count() == 0
    back = bytebpe.decode(bytebpe.encode(odd, RANKS).select("text", "tokens.ids"), RANKS).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back)


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
@pytest.mark.parametrize("top", [1, 2, 50, 49408, 1 << 33, 1 << 63])
def test_pack_round_trip(n, top):
    v = np.random.default_rng(n).integers(0, top, n, dtype=np.uint64)
    if n > 10:
        v[3], v[7], v[-5:] = (1 << 60) - 1, (1 << 64) - 1, 0
    packed = tokenfile.pack(v)
    assert np.array_equal(tokenfile.unpack(*packed, n), v)
    if n > 300:  # a block alone
        w, o, _ = packed
        one = tokenfile.unpack(w[o[1] : o[2]], np.zeros(1, np.uint32), np.zeros(0, np.uint64), 128)
        assert np.array_equal(one, np.minimum(v[128:256], (1 << 60) - 1))


def test_token_files_equal_library(spark, odd, crowded, empty, documents, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORDS)
    for k, df in enumerate((odd, documents, crowded)):
        path = f"{tmp_path}/{k}"
        tokenfile.write_tokens(df, path, WORDS)
        at, want = 0, {}
        ordered = sorted(df.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1]))
        for r in ordered:
            ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 1], np.uint32)
            want[at] = (r.doc_id, len(ids), zlib.crc32(ids.tobytes()))
            at += len(ids)
        assert {r.start: (r.doc_id, r.n_tokens, r.ids_crc32) for r in tokenfile.read_digests(spark, path).collect()} == want
        assert {r.start: (r.doc_id, r.n_tokens, zlib.crc32(r.ids)) for r in tokenfile.read_tokens(spark, path).collect()} == want
    tokenfile.write_tokens(empty, f"{tmp_path}/e", WORDS)
    assert tokenfile.read_digests(spark, f"{tmp_path}/e").count() == 0


def test_odd_texts_take_the_library(library):
    from tokenizers import Tokenizer

    tok, rnd = Tokenizer.from_file(WORDS), random.Random(3)
    some = ["a", "B", "'", "s", " ", "\n", "1", "23", "\u00e9", "\u00c9", "\u6f22", "\u00d7", "<|startoftext|>", "<|", "\u0130", "\u0301", "\xa0", "\x1c", "\u00df", "the", "..", "\u00bd"]
    texts = ["".join(rnd.choice(some) for _ in range(rnd.randint(0, 25))) for _ in range(2000)] + [None]
    got = [ids[a:b].tolist() for _, ids, e in tokenfile.tokens(WORDS).encode(pa.array(texts)) for a, b in zip(e[:-1], e[1:], strict=True)]
    assert got == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


# decontamination


def test_search_with_colliding_hashes_and_crowded_buckets(monkeypatch):
    """Two-bit word hashes, items that share windows and ends, texts that repeat them."""
    rnd = random.Random(9)
    some = ["aa", "b", "cc", "dd", "e", "\u00e9"]
    items = [(str(k), " ".join(rnd.choice(some) for _ in range(rnd.choice([2, 5, 12, 30])))) for k in range(60)] + [("x", ""), ("y", "!!")]
    texts = [" ".join(rnd.choice(some) for _ in range(300)) + " " + rnd.choice(items)[1] for _ in range(30)] + ["", "b"]
    plain = words.Words.hashes
    monkeypatch.setattr(decontaminate, "PIECE", 100)
    for bits in (64, 2):
        monkeypatch.setattr(words.Words, "hashes", lambda w, b=bits: plain(w) >> np.uint64(64 - b) if b < 64 else plain(w))
        p = decontaminate.tables(items, 10)
        for w in words.words(pa.array(texts), limit=500):
            got = set()
            for t in p.tables:
                begin, pattern = decontaminate.search(p, t, w, w.hashes())
                for i, q in zip(begin.tolist(), pattern.tolist(), strict=True):
                    got |= {(i, t.m, k) for k in t.item[t.item_first[q] : t.item_first[q + 1]].tolist()}
            want = set()
            for d, row in enumerate(w.rows):
                mine = re.findall(words.WORD, texts[row])
                for k, (_, body) in enumerate(items):
                    own = re.findall(words.WORD, body)
                    m = min(10, len(own))
                    wins = {tuple(own[i : i + m]) for i in range(len(own) - m + 1)} if m else set()
                    want |= {(int(w.first[d]) + i, m, k) for i in range(len(mine) - m + 1) if m and tuple(mine[i : i + m]) in wins}
            assert got == want


# licences


def test_recall_on_planted_notices(spark):
    """Notices as they stand in real files: wrapped, indented, behind comment marks, within longer lines and paragraphs."""
    rnd = random.Random(5)
    filler = lambda n: " ".join(f"filler{rnd.randrange(10**6)}" for _ in range(n))

    def wrapped(t, mark, width):
        w = t.split()
        return "\n".join(mark + " ".join(w[k : k + width]) for k in range(0, len(w), width))

    ways = {
        "wrapped": lambda t: wrapped(t, "", 9), "indented": lambda t: wrapped(t, "        ", 7), "commented": lambda t: wrapped(t, " * ", 8), "hashed": lambda t: wrapped(t, "# ", 11),
        "in a line": lambda t: f"/*! {filler(6)} | {t} */ {filler(20)}", "in a paragraph": lambda t: f"{filler(12)}\n{wrapped(t, '', 9)}\n{filler(12)}", "blank lines": lambda t: wrapped(t, "", 9).replace("\n", "\n\n"), "all one line": lambda t: f"{filler(50)} {t} {filler(50)}",
    }
    rows = [(w, t, f"{filler(40)}\n\n{way(body)}\n\n{filler(40)}") for w, way in ways.items() for t, (_, body) in enumerate(licences.TEMPLATES)]
    got = licences.scan_licences(spark.createDataFrame(rows, "way string, t int, text string")).collect()
    met = Counter(r.way for r in got if any(x.template == r.t for x in r.licences))
    assert all(met[w] >= 0.95 * len(licences.TEMPLATES) for w in ways), met
    clean = spark.createDataFrame([(k, filler(300)) for k in range(50)], "doc_id long, text string")
    assert licences.scan_licences(clean).where(F.size("licences") > 0).count() == 0


# quality


def test_few_candidates_hold_all_common_words(spark, documents, monkeypatch):
    """Many small slices of a language whose words keep changing: at most 222 candidates, every common word among them."""
    rnd = random.Random(2)
    common = [f"common{k}" for k in range(60)]
    rows = [(k, "xx", " ".join(rnd.choice(common) if rnd.random() < 0.5 else f"rare{rnd.randrange(10**6)}" for _ in range(120))) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(40).union(documents.select("doc_id", "lang", "text"))
    seen = df.mapInArrow(quality._survey("text", "lang"), quality.STATS).groupBy("lang", "kind", "word", "bin").agg(F.sum("n").alias("n"))
    found = {(r.lang, r.word) for r in quality.candidates(seen).collect()}
    count = Counter((r[1], w.lower()) for r in df.collect() for w in re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    total = Counter()
    for (one, _), n in count.items():
        total[one] += n
    want = {k for k, n in count.items() if total[k[0]] >= quality.LEAST_WORDS and n >= quality.COMMON * total[k[0]] and k[1].isascii()}
    assert want <= found and max(Counter(one for one, _ in found).values()) <= 222
    refs = {r.lang: dict(zip(r.words, r.counts, strict=True)) for r in quality.references(df).collect()}
    assert all(refs[one][w] == count[one, w] for one, w in want)
    usual = sorted(quality.judge(df).select("doc_id", "lang", "quality.*").collect(), key=repr)
    monkeypatch.setattr(quality, "LANGUAGES", 2)
    assert sorted(quality.judge(df).select("doc_id", "lang", "quality.*").collect(), key=repr) == usual


def test_pieces_with_equal_hashes(monkeypatch):
    """Hashes of four bits: most pieces meet another one's entry and take the library."""
    from tokenizers import Tokenizer

    tok, rnd = Tokenizer.from_file(WORDS), random.Random(3)
    some = ["a", "b", "an", "ana", "anan", "internationalisation", "internationalisations", "internationalizations", "x" * 9, "x" * 8 + "y", "7", "Z", "."]
    texts = [" ".join(rnd.choice(some) for _ in range(rnd.randint(0, 12))) for _ in range(300)]
    monkeypatch.setattr(tokenfile, "mix", lambda x: x * np.uint64(0) + (x & np.uint64(14)) + np.uint64(16))
    t = tokenfile.Tokens(WORDS)
    got = [ids[a:b].tolist() for _, ids, e in t.encode(pa.array(texts)) for a, b in zip(e[:-1], e[1:], strict=True)]
    assert got == [tok.encode(x, add_special_tokens=False).ids for x in texts]


# URL rules


def test_url_parts_and_rules(spark):
    urls = [
        ("https://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"), ("http://x.net/", "x.net", "/", "net/", "block"), ("http://x.net", "x.net", "", None, "allow"), ("http://example.com/de/1", "example.com", "/de/1", "example.com/de/", "block"),
        ("http://notexample.com/de/1", "notexample.com", "/de/1", None, "allow"), ("http://a.org/fr/", "a.org", "/fr/", "org/fr/", "allow"), ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("x://h?/a", "h", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(k, u[0]) for k, u in enumerate(urls)], "page_id long, url string")
    labels = spark.createDataFrame([], "page_id long, block boolean")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlrules.judge_urls(pages, labels).collect()}
    assert got == {k: u[1:] for k, u in enumerate(urls)}
    assert urlrules.judge_urls(pages.limit(0), labels).count() == 0


def test_mined_rules_equal_enumeration(spark):
    rnd = random.Random(5)
    pages = [(k, f"http://{rnd.choice(['spam', 'good', 'mix'])}.example.org/{rnd.choice(['a', 'b'])}/{rnd.choice(['x', 'y'])}?r={rnd.choice('12')}") for k in range(300)]
    block = {k: ("spam" in u) or ("/b/y" in u and rnd.random() < 0.9) for k, u in pages}
    df = spark.createDataFrame(pages, "page_id long, url string")
    labels = spark.createDataFrame(list(block.items()), "page_id long, block boolean")
    items = {r.page_id: frozenset(r["items"]) for r in df.withColumn("items", urlrules.tokens(F.col("url"))).collect()}
    every: dict = {}
    for k, s in items.items():
        for n in range(1, len(s) + 1):
            for c in itertools.combinations(sorted(s), n):
                t = every.setdefault(frozenset(c), [0, 0])
                t[0] += 1
                t[1] += block[k]
    rules = {a for a, (n, b) in every.items() if b >= 0.05 * len(pages) and b >= 0.8 * n}
    got = {r.page_id: r for r in urlrules.judge_urls(df, labels, rules=[], min_support=0.05, min_confidence=0.8, max_tokens=12).collect()}
    assert {k: r.verdict for k, r in got.items()} == {k: "block" if any(a <= s for a in rules) else "allow" for k, s in items.items()}
    assert any(r.verdict == "block" for r in got.values())
    sure = {k: max((every[a][1] / every[a][0] for a in rules if a <= s), default=None) for k, s in items.items()}
    assert all((r.confidence is None) == (sure[k] is None) and (sure[k] is None or abs(r.confidence - sure[k]) < 1e-6) for k, r in got.items())


def all_rules(items, block, least, sure, most):
    """Counts of each set of at most ``most`` tokens that rules can be made of, by enumeration of the labelled pages."""
    every: dict = {}
    for k in block:
        for n in range(1, most + 1):
            for c in itertools.combinations(sorted(items[k]), n):
                t = every.setdefault(frozenset(c), [0, 0])
                t[0] += 1
                t[1] += block[k]
    return {a: b / n for a, (n, b) in every.items() if b >= least and b >= sure * n}


@pytest.mark.parametrize("few", [1 << 14, 0])
def test_rules_of_pages_with_many_common_tokens(spark, monkeypatch, few):
    """More frequent tokens than two pieces hold, and pages without labels that have one token of a class only; rules
    broadcast and joined in parts."""
    monkeypatch.setattr(urlrules, "FEW", few)
    rnd = random.Random(9)
    words_ = [f"w{k}" for k in range(14)]
    pages, block = [], {}
    for k in range(240):
        bad = k % 4 == 0
        three = ["red", "green", "blue"] if bad else rnd.sample(["red", "green", "blue"], 2)
        pair = ["alpha", "beta"] if k % 8 == 0 else []
        pages.append((k, f"https://site{k % 3}.example.com/" + "/".join(three + pair + rnd.sample(words_, 11))))
        block[k] = bad
    pages += [(500, "https://new.biz/alpha/x"), (501, "https://new.biz/beta/x"), (502, "https://new.biz/red/green/blue"), (503, "https://new.biz/red/green"), (504, "https://new.biz/y"), (505, "https://new.biz/alpha/beta")]
    df, labels = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(list(block.items()), "page_id long, block boolean")
    items = {r.page_id: frozenset(r["items"]) for r in df.withColumn("items", urlrules.tokens(F.col("url"))).collect()}
    rules = all_rules(items, block, 5, 0.9, 3)
    got = {r.page_id: r for r in urlrules.judge_urls(df, labels, rules=[], min_support=0.0, min_confidence=0.9, max_tokens=3).collect()}
    want = {k: max((c for a, c in rules.items() if a <= s), default=None) for k, s in items.items()}
    assert {k: r.confidence for k, r in got.items()} == {k: c and round(c, 6) for k, c in want.items()}
    assert [got[k].verdict for k in range(500, 506)] == ["block", "block", "block", "allow", "allow", "block"] and got[505].n_rules == got[500].n_rules
    assert all((got[k].verdict == "block") or not b for k, b in block.items())


def test_long_and_odd_urls(spark):
    """Many labels of one long URL, long URLs that differ a little, nulls and repeated ids."""
    rnd = random.Random(6)
    some = [f"w{k}" for k in range(28)]
    pages = [(k, "https://one.example.com/" + "/".join(some)) for k in range(20)]
    pages += [(100 + k, "https://two.example.com/" + "/".join(rnd.sample(some, 26))) for k in range(40)]
    pages += [(None, "https://one.example.com/"), (200, None), (200, "https://three.example.org/x"), (200, "https://three.example.org/x"), (300, "https://four.example.com/" + "y" * 200_000)]
    block = [(k, True) for k in range(20)] + [(100 + k, k % 2 == 0) for k in range(40)] + [(200, False), (None, True), (7, None), (999, True)]
    df, labels = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(block, "page_id long, block boolean")
    got = urlrules.judge_urls(df.withColumn("items", F.lit(1)), labels.withColumn("url", F.lit("x")), rules=[]).collect()
    assert len(got) == len(pages) and {r.verdict for r in got if r.page_id is not None and r.page_id < 20} == {"block"}
    assert all(r.confidence == 1 for r in got if r.page_id is not None and r.page_id < 20)
    assert {r.verdict for r in got if r.page_id == 200} == {"allow"}
    few = urlrules.judge_urls(df, labels.where("page_id < 4"), rules=[]).collect()
    assert {r.verdict for r in few} == {"allow"}


# pipeline


def test_pipeline_equals_plain_stages(spark, data, duck, documents, library):
    import corpus_pipeline

    texts = {r.doc_id: r.text for r in documents.collect()}
    kept = {r[0] for r in duck.execute(f"SELECT doc_id FROM ({quality.SQL}) q WHERE kept").fetchall()}
    shingles = {}
    for k in kept:
        w = re.findall(words.WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in texts[k]))
        bag: dict = {}
        for i in range(max(1, len(w) - 4)):
            bag[tuple(w[i : i + 5])] = bag.get(tuple(w[i : i + 5]), 0) + 1
        shingles[k] = bag
    least = {k: k for k in kept}

    def top(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, b in itertools.combinations(sorted(kept), 2):
        m = sum(min(n, shingles[b].get(s, 0)) for s, n in shingles[a].items())
        if m >= 0.8 * (sum(shingles[a].values()) + sum(shingles[b].values()) - m):
            x, y = top(a), top(b)
            least[max(x, y)] = min(x, y)
    kept = {k for k in kept if top(k) == k}
    bad = {r[0] for r in duck.execute(f"SELECT doc_id FROM ({decontaminate.SQL}) q WHERE contaminated").fetchall()}
    want = {}
    for k in kept - bad:
        t = re.sub(pii.PATTERN, lambda m: plain_pseudonym(m, pii.secret(spark).first().key), texts[k])
        ids = library.encode_ordinary(t)
        want[k] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, data).collect()}
    assert got == want and 0 < len(got) < len(texts)


def test_pipeline_stages_take_odd_rows(spark, data, odd, empty):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, data)
        assert out.columns == odd.columns
        assert stage(spark, empty, data).count() == 0
        every = Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in odd.collect())
        got = Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in out.collect())
        assert got <= every
        if stage is not corpus_pipeline.quality_rules:
            assert all(x[0] in (7, 8) for x in every - got) and (not every - got or stage is corpus_pipeline.near_duplicates)
    assert corpus_pipeline.STAGES[-1][1](spark, odd, data).count() == odd.count()


def test_pipeline_tells_rows_apart_by_all_columns(spark, odd, data):
    import corpus_pipeline

    text = lambda k: " ".join(f"{k}word{i}" for i in range(30))
    rows = [
        (None, text("a"), "en", "s", 1), (None, text("b"), "en", "s", 1), (None, text("b"), "en", "s", 1), (None, None, "en", "s", 1), (7, text("c"), "en", "s", 1), (7, text("d"), "en", "s", 1),
        (7, None, "en", "s", 1), (9, text("c"), "en", "s", 1), (None, text("d"), "en", "s", 1), (3, text("e"), "x", None, 1), (3, text("e"), None, "x", 1), (2, text("e"), "en", "s", 1), (5, "", "en", "s", 0), (6, "", "en", "s", 0),
    ]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, odd.schema), data).collect()
    want = [(None, text("a")), (None, text("b")), (None, None), (7, text("c")), (7, text("d")), (7, None), (2, text("e")), (5, ""), (6, "")]
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(want, key=repr)


def test_pipeline_stages_keep_columns_of_any_name(spark, odd, data, empty):
    """Columns with the names that the stages or the operators use inside, and a map, come back with their values."""
    import corpus_pipeline

    names = ["_row", "_quality", "_found", "_pii", "_least", "row", "Quality", "found", "pii", "class", "rank", "none", "least", "class_id", "k1", "spans", "items", "n_words", "tokens"]
    more = odd.select("*", *[F.lit(f"own {k}").alias(n) for k, n in enumerate(names)], F.create_map(F.lit("x"), F.coalesce("doc_id", F.lit(-1))).alias("map"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, more, data)
        assert got.columns == more.columns
        rows = got.collect()
        assert rows and all(r[5 + k] == f"own {k}" for r in rows for k in range(len(names))) and all(r["map"] == {"x": -1 if r.doc_id is None else r.doc_id} for r in rows)
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in stage(spark, odd, data).collect())
        assert stage(spark, more.limit(0), data).count() == 0
