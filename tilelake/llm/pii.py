"""Format-preserving Feistel pseudonyms for personal numbers, dates and addresses, in built-in expressions only.

Values that pass their check (Luhn, IBAN's mod 97, calendar, octets, number ranges) are permuted by a keyed Feistel
network within their own format, so a pseudonym passes the same check, equal values get equal pseudonyms in every
document and every spelling, and different values of one format get different ones. What is permuted is the value itself
(the digits of a number, the day of a date, an address in lower case); the layout is filled with the result. The round function is SHA-256 over the key, the format,
the round and the other half.

Two networks are used. Numbers below a * b: a left half below a and a right half below b are added to in turn, modulo a
and b. Strings: each character of a half is turned within its class (digits, A-Z, a-z) by an amount that depends on its
place and the other half.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
#: The setting that holds the key.
KEY_CONF = "spark.tilelake.pii.key"
#: What the registered queries take on the invented tables where that setting is missing. Public: not for real data.
TEST_KEY = "a key for tests"

#: Lengths of IBANs and the countries that have them.
IBANS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


#: Country codes of one and two digits; all others have three.
CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"


def _iban_pattern() -> str:
    """A country's IBAN has its length, so that words after it are no part; other letters take what may be one."""
    of = lambda names: "(?:" + names.replace(" ", "|") + ")"
    tail = lambda n: f"(?: ?[A-Z0-9]{{{n}}})" if n else ""
    known = [f"{of(c)}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}{tail(n % 4)}" for n, c in IBANS.items()]
    other = f"(?!{of(' '.join(IBANS.values()))})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?"
    return f"(?<![A-Za-z0-9])(?:{'|'.join([*known, other])})(?![A-Za-z0-9])"


def _phone_pattern() -> str:
    """Numbers with + have at most 15 digits: +1 by its groups, others as many groups of 2 to 4 as fit; if that gives a number,
    without a card's groups and not ending inside of a date or another number with signs."""
    two = r"[0-9]{2,4}[ .\-][0-9]{2,4}(?![0-9A-Za-z])"

    def free(unless: str) -> str:
        more = lambda least, most: rf"(?:(?:[ .\-]{unless}(?=[0-9]{{2,4}}(?![0-9A-Za-z])))?[0-9]){{{max(least, 1)},{most}}}"
        plain = rf"(?=\+[1-9][0-9]{{0,2}}[ .\-]?{two})\+[1-9]{more(7, 14)}"
        area = [rf"\+[1-9][0-9]{{{c - 1}}}[ .\-]?\([0-9]{{{a}}}\)[ .\-]?(?={two})[0-9]{more(7 - c - a, 14 - c - a)}" for c in (1, 2, 3) for a in (1, 2, 3, 4)]
        return "(?:" + "|".join([plain, *area]) + ")"

    card = r"(?![0-9]{4}(?:[ \-][0-9]{4}){3}(?![0-9A-Za-z]|[ \-][0-9]{4}(?![0-9A-Za-z])))"
    one = r"\+1[ .\-]?(?:\([0-9]{3}\)|[0-9]{3})[ .\-]?[0-9]{3}[ .\-][0-9]{4}"
    rest = r"\+[1-9][0-9]{7,14}|\([2-9][0-9]{2}\) ?[0-9]{3}[ .\-][0-9]{4}|[2-9][0-9]{2}[.\-][2-9][0-9]{2}[.\-][0-9]{4}"
    return rf"(?<![0-9A-Za-z+])(?:{one}|{free(card)}(?![0-9A-Za-z]|[./\-][0-9])|{free("")}|{rest})(?![0-9A-Za-z])"


#: Formats in the order in which they are looked for: pattern of the whole value, with what may not stand beside it.
FORMATS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9\-])",
    "iban": _iban_pattern(),
    "date": r"(?<![0-9/.\-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/(?:19|20)[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.(?:19|20)[0-9]{2})(?![0-9/\-])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "ipv4": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])",
    "phone": _phone_pattern(),
    "card": r"(?<![0-9A-Za-z\-])(?:[0-9]{13,19}|[0-9]{4}(?:[ \-][0-9]{4}){3}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5})(?![0-9A-Za-z])",
}
PATTERN = "|".join(FORMATS.values())

#: Days from 1900-01-01 to 2099-12-31: 73049 = 17 * 4297.
DAYS = (17, 4297)


def _keyed(key: Column, *parts: Column) -> Column:
    """A number below 2^60 from SHA-256."""
    digest = F.sha2(F.concat_ws("\x1f", key, *[p.cast("string") for p in parts]).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def permute_number(v: Column, a: int, b: int, key: Column, tweak: str) -> Column:
    """A permutation of 0 .. a * b - 1."""
    start = F.struct(F.floor(v / b).cast("long").alias("l"), F.pmod(v, F.lit(b)).cast("long").alias("r"))

    def step(s: Column, k: Column) -> Column:
        left = F.pmod(s["l"] + F.pmod(_keyed(key, F.lit(tweak), k, s["r"]), F.lit(a)), F.lit(a))
        right = F.pmod(s["r"] + F.pmod(_keyed(key, F.lit(tweak), k, s["l"]), F.lit(b)), F.lit(b))
        even = k % 2 == 0
        return F.struct(F.when(even, left).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(right).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * b + s["r"])


def permute_string(s: Column, key: Column, tweak: str) -> Column:
    """A permutation of the strings with the same classes of characters at the same places."""
    half = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substring(s, F.lit(1), half).alias("l"), F.substring(s, half + 1, F.length(s)).alias("r"))

    def turned(part: Column, other: Column, k: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            by, code = _keyed(key, F.lit(tweak), k, i, other), F.ascii(c)
            inside = lambda first, n: F.char(F.pmod(code - first + F.pmod(by, F.lit(n)), F.lit(n)) + first)
            return F.when(c.between("0", "9"), inside(48, 10)).when(c.between("a", "z"), inside(97, 26)).when(c.between("A", "Z"), inside(65, 26)).otherwise(c)

        return F.when(F.length(part) == 0, part).otherwise(F.array_join(F.transform(F.split(part, ""), one), ""))

    def step(p: Column, k: Column) -> Column:
        even = k % 2 == 0
        return F.struct(F.when(even, turned(p["l"], p["r"], k)).otherwise(p["l"]).alias("l"), F.when(even, p["r"]).otherwise(turned(p["r"], p["l"], k)).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda p: F.concat(p["l"], p["r"]))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _refill(layout: Column, chars: str, new: Column) -> Column:
    """layout with its characters of the class replaced, in turn, by those of new."""
    place = lambda i: F.length(F.regexp_replace(F.substring(layout, F.lit(1), i + 1), f"[^{chars}]", ""))
    return F.array_join(F.transform(F.split(layout, ""), lambda c, i: F.when(c.rlike(f"[{chars}]"), F.substring(new, place(i), F.lit(1))).otherwise(c)), "")


def luhn_digit(body: Column) -> Column:
    """The digit that completes a number so that it passes Luhn's check."""
    double = lambda c, i: F.when((F.length(body) - i) % 2 == 1, F.when(c * 2 > 9, c * 2 - 9).otherwise(c * 2)).otherwise(c)
    total = F.aggregate(F.transform(F.split(body, ""), lambda c, i: double(c.cast("int"), i)), F.lit(0), lambda s, x: s + x)
    return F.pmod(F.lit(10) - total % 10, F.lit(10)).cast("string")


def _mod97(s: Column) -> Column:
    return F.aggregate(F.split(s, ""), F.lit(0).cast("long"), lambda n, c: F.when(c.between("0", "9"), (n * 10 + c.cast("int")) % 97).otherwise((n * 100 + F.ascii(c) - 55) % 97))


def _card(v: Column, key: Column) -> tuple[Column, Column]:
    d = _digits(v)
    body = permute_string(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
    return F.call_function("luhn_check", d), _refill(v, "0-9", F.concat(body, luhn_digit(body)))


def _iban(v: Column, key: Column) -> tuple[Column, Column]:
    s = F.regexp_replace(v, " ", "")
    country, rest = F.substring(s, 1, 2), F.substring(s, F.lit(5), F.length(s))
    # 00, 01 and 99 give the same remainder as 97, 98 and 02; only those of 02 to 98 are in use
    ok = F.substring(s, 3, 2).between("02", "98") & (_mod97(F.concat(rest, F.substring(s, 1, 4))) == 1)
    new = permute_string(rest, key, "iban")
    check = F.lpad((F.lit(98) - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
    return ok, _refill(v, "A-Z0-9", F.concat(country, check, new))


def _ipv4(v: Column, key: Column) -> tuple[Column, Column]:
    parts = F.transform(F.split(v, r"\."), lambda x: x.cast("long"))
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda n, x: n * 256 + x)
    new = permute_number(number, 65536, 65536, key, "ipv4")
    octets = F.aggregate(F.array(new), F.lit(""), lambda _, n: F.concat_ws(".", *[F.pmod(F.floor(n / 256**k), F.lit(256)).cast("string") for k in (3, 2, 1, 0)]))
    return F.forall(parts, lambda x: x <= 255), octets


def _ssn(v: Column, key: Column) -> tuple[Column, Column]:
    """Areas 001-899 without 666, groups 01-99, serials 0001-9999."""
    area, group, serial = (F.element_at(F.split(v, "-"), k).cast("long") for k in (1, 2, 3))
    ok = (area >= 1) & (area <= 899) & (area != 666) & (group >= 1) & (serial >= 1)
    number = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1
    back = lambda n: F.concat_ws(
        "-",
        F.lpad((F.floor(n / (99 * 9999)) + F.when(F.floor(n / (99 * 9999)) >= 665, 2).otherwise(1)).cast("string"), 3, "0"),
        F.lpad((F.pmod(F.floor(n / 9999), F.lit(99)) + 1).cast("string"), 2, "0"),
        F.lpad((F.pmod(n, F.lit(9999)) + 1).cast("string"), 4, "0"),
    )
    return ok, F.aggregate(F.array(permute_number(number, 898 * 99, 9999, key, "ssn")), F.lit(""), lambda _, n: back(n))


def _date(v: Column, key: Column) -> tuple[Column, Column]:
    """Year-month-day, day/month/year or day.month.year; month/day/year where the second number can't be a month."""
    iso, sep = v.contains("-"), F.when(v.contains("/"), "/").otherwise(".")
    parts = F.split(v, r"[-/.]")
    one, two, three = (F.element_at(parts, k) for k in (1, 2, 3))
    pad = lambda x: F.lpad(x, 2, "0")
    day_first = two.cast("int") <= 12
    day = F.try_to_date(F.when(iso, v).otherwise(F.concat_ws("-", three, F.when(day_first, pad(two)).otherwise(pad(one)), F.when(day_first, pad(one)).otherwise(pad(two)))), "yyyy-MM-dd")
    origin = F.to_date(F.lit("1900-01-01"))
    step = lambda n: permute_number(n, *DAYS, key, "date")
    on = lambda n: F.date_add(origin, n.cast("int"))
    number = F.datediff(day, origin).cast("long")
    # days after the twelfth stay among themselves, as month/day/year can be told only of these; so do the others
    late = F.dayofmonth(day) > 12
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(96)), step(number), lambda n, _: F.when((F.dayofmonth(on(n)) > 12) == late, n).otherwise(step(n)))
    full = F.length(v) == 10
    show = lambda x: F.when(full, pad(x.cast("string"))).otherwise(x.cast("string"))
    write = lambda d, a, b: F.concat(show(a(d)), sep, show(b(d)), sep, F.year(d).cast("string"))
    new = F.aggregate(F.array(on(walked)), F.lit(""), lambda _, d: F.when(iso, F.date_format(d, "yyyy-MM-dd")).when(day_first, write(d, F.dayofmonth, F.month)).otherwise(write(d, F.month, F.dayofmonth)))
    return day.isNotNull(), new


def _national(d: Column, key: Column) -> Column:
    """Ten digits of a number of the plan of country code 1. Area and exchange stay below 200 or not, as they are, since
    only those from 200 on are in use."""
    area, middle, line = F.substring(d, 1, 3).cast("long"), F.substring(d, 4, 3).cast("long"), F.substring(d, 7, 4).cast("long")
    low = lambda x: F.when(x >= 200, 200).otherwise(0)
    many = lambda x: F.when(x >= 200, 800).otherwise(200)
    number = ((area - low(area)) * many(middle) + middle - low(middle)) * 10000 + line
    new = permute_number(number, many(area) * many(middle), 10000, key, "phone 1")
    part = lambda x, n: F.lpad(x.cast("string"), n, "0")
    first = lambda n: F.floor(n / 10000)
    return F.aggregate(F.array(new), F.lit(""), lambda _, n: F.concat(part(low(area) + F.floor(first(n) / many(middle)), 3), part(low(middle) + F.pmod(first(n), many(middle)), 3), part(F.pmod(n, F.lit(10000)), 4)))


def _phone(v: Column, key: Column) -> tuple[Column, Column]:
    """The country code stays. Numbers without one have code 1."""
    d, plus = _digits(v), v.startswith("+")
    of = lambda n: "|".join(c for c in CODES.split() if len(c) == n)
    code = F.when(~plus, 0).when(d.rlike(f"^({of(1)})"), 1).when(d.rlike(f"^({of(2)})"), 2).otherwise(3)
    rest = F.substring(d, code + 1, F.length(d))
    new = F.when((F.length(rest) == 10) & (~plus | d.startswith("1")), _national(rest, key)).otherwise(permute_string(rest, key, "phone"))
    return F.length(d).between(8, 15), _refill(v, "0-9", F.concat(F.substring(d, F.lit(1), code), new))


def _email(v: Column, key: Column) -> tuple[Column, Column]:
    """The part before the @ is permuted without regard to case, which it keeps at each place; the domain stays."""
    name = F.substring_index(v, "@", 1)
    new = permute_string(F.lower(name), key, "email")
    cased = F.array_join(F.zip_with(F.split(name, ""), F.split(new, ""), lambda o, n: F.when(o.between("A", "Z"), F.upper(n)).otherwise(n)), "")
    return F.lit(True), F.concat(F.when(name.rlike("[A-Z]"), cased).otherwise(new), F.substring(v, F.length(name) + 1, F.length(v)))


_MAKERS = {"email": _email, "iban": _iban, "date": _date, "ssn": _ssn, "ipv4": _ipv4, "phone": _phone, "card": _card}


def _pseudonym(v: Column, key: Column) -> Column:
    """(kind, value) of one match; kind is null and value unchanged where the check fails."""
    kind, out = F.lit(None).cast("string"), v
    for name in reversed(FORMATS):
        ok, new = _MAKERS[name](v, key)
        this = v.rlike(f"^(?:{FORMATS[name]})$")
        kind = F.when(this, F.when(ok, name)).otherwise(kind)
        out = F.when(this, F.when(ok, new).otherwise(v)).otherwise(out)
    return F.struct(kind.alias("kind"), out.alias("value"))


def secret(spark: SparkSession, unset: str | None = None) -> DataFrame:
    """The key of the deployment as a table of one row: what the setting ``KEY_CONF`` says. Without that setting (or with
    an empty one) it is ``unset``, with a warning, as whoever knows that key can undo the pseudonyms; without either it
    raises."""
    key = spark.conf.get(KEY_CONF, "")
    if not key:
        if not unset:
            raise ValueError(f"set {KEY_CONF} to the secret key of the deployment")
        warnings.warn(f"{KEY_CONF} is not set: pseudonyms are made with a public key and can be undone", stacklevel=2)
        key = unset
    return spark.createDataFrame([(key,)], "key string")


def pseudonymise(docs: DataFrame, key: str | DataFrame, *, text: str = "text", out: str = "pii") -> DataFrame:
    """docs with a struct ``out``: text with pseudonyms, and found, an array of (kind, value) of them in order.

    key: a table with a column ``key`` and one row, which is read as a scalar subquery, so that neither plans nor logs
    show it; or the key itself, for tests. Kinds: email, iban, date (1900 to 2099), ssn, ipv4, phone, card. A value that
    looks like one but fails its check is left alone, as is all other text. A number, day or address has one pseudonym in
    all its spellings. Null text stays null with nothing found; empty text stays empty. Each row is handled by itself,
    repeated rows alike; there is no shuffle. A column of docs named ``out`` is replaced.
    """
    name = f"{out}_key"
    while name in docs.columns or name == out:
        name += "_"
    t, k = F.col(text), F.lit(key) if isinstance(key, str) else F.col(name)
    base = docs.drop(out) if isinstance(key, str) else docs.drop(out).withColumn(name, key.select("key").scalar())
    some = base.withColumn(out, F.when(t.rlike("[0-9@]"), F.regexp_extract_all(t, F.lit(f"({PATTERN})"), F.lit(1))))
    some = some.withColumn(out, F.when(F.size(out) > 0, F.transform(out, lambda v: _pseudonym(v, k))))
    gaps = F.split(t, PATTERN, -1)
    joined = F.array_join(F.zip_with(gaps, F.transform(F.col(out), lambda x: x["value"]), lambda g, x: F.concat(g, F.coalesce(x, F.lit("")))), "")
    none = F.expr("cast(array() as array<struct<kind:string,value:string>>)")
    made = F.struct(F.when(F.col(out).isNotNull(), joined).otherwise(t).alias("text"), F.coalesce(F.filter(F.col(out), lambda x: x["kind"].isNotNull()), none).alias("found"))
    return some.withColumn(out, made).drop(*[] if isinstance(key, str) else [name])


def op1_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = pseudonymise(docs, secret(spark, TEST_KEY))
    kinds = F.transform("pii.found", lambda x: x["kind"])
    return made.select("doc_id", F.col("pii.text").alias("text"), F.size(kinds).cast("long").alias("n_found"), F.array_join(F.transform("pii.found", lambda x: F.concat_ws("=", x["kind"], x["value"])), "\n").alias("pseudonyms"))
