"""Personal data replaced by format-preserving pseudonyms. DataFrame functions only.

Candidates are found by one regular expression and validated: card numbers and
IBANs by their check digits, dates by the calendar, addresses and social
security numbers by the ranges of their parts. A valid value is written as a
number below M1 * M2 and permuted by a keyed Feistel network over the two
parts; the result is laid out as the original was, with new check digits. Of an
IBAN the country stays, digits become digits and letters letters. Equal values
get equal pseudonyms in all documents and in all layouts, and different values
of a format get different ones. Mail addresses are no numbers: their parts
become keyed digests.

What stands next to a value hides none: IBANs have the length of their country,
card numbers in groups are looked for at each group, and a run of numbers that
is no value as a whole is searched within. Round functions are HMAC-SHA256; the
key reaches executors as the result of a subquery, so it stands in no plan.

A projection without a shuffle. Texts without a candidate pass through after
one scan. Defined results: a null text stays null, an empty one empty, an empty
table stays empty; very long texts are scanned whole (no pattern recurses by
the length of a text); the text around values is kept to the byte; repeated
rows give equal results; other columns are passed on, and those named like an
output (in any case) are replaced. Left as they are: mail addresses with more
than 256 characters before the `@` or 126 labels after it, IBANs of countries
that `IBANS` lacks or in lower case, numbers of less than eight digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.columns import fresh, let

KINDS = ("email", "iban", "card", "phone", "ssn", "ip", "date")
ROUNDS = 10

#: Characters of an IBAN by country (fixed values).
IBANS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: Country codes of phone numbers (fixed values): one digit, two digits, else three.
CODES = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}"
#: First digits of 16 to 19 digits in groups of four that are card numbers (fixed values).
SCHEMES = r"^(?:[3-6]|22(?:2[1-9]|[3-9])|2[3-6]|27(?:[01]|20))"

#: Letters beyond ASCII of scripts that part words (fixed values): Latin, and from Greek to the extensions of Georgian and Ethiopic.
LETTERS = "À-ɏͰ-῿Ⰰ-ⷿ"
_BLANKS = " \u00a0\u202f"
#: What parts the groups of a number: one or two blanks, a full stop or a hyphen.
_MARK = rf"(?:[{_BLANKS}]{{1,2}}|[.-])"
_USER, _HOST, _SOFT = rf"A-Za-z0-9{LETTERS}._%+-", f"A-Za-z0-9{LETTERS}", rf"(?:[{_BLANKS}]{{1,2}}|-)"

_STRICT = {
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)",
    "date": r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d/-]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": (
        rf"(?<![\d+])(?:\+\d{{1,3}}[{_BLANKS}.-]?)?(?:\(\d{{3}}\)[{_BLANKS}]?|\d{{3}}[.-])\d{{3}}[{_BLANKS}.-]\d{{4}}(?!\d)|(?<![\d+])\+[1-9](?:[{_BLANKS}.-]?\d){{7,14}}(?!\d)"
        rf"|(?<![\d+])(?<!\d[{_BLANKS}-])[2-9]\d{{2}}[{_BLANKS}][2-9]\d{{2}}[{_BLANKS}]\d{{4}}(?![{_BLANKS}-]?\d)"
    ),
    "quad": rf"(?<!\d)(?<!\d\.)\d{{4}}(?:{_MARK}\d{{4}}(?!\d)){{3,}}+(?:{_MARK}\d{{1,3}}(?!\d))?(?!\d)",
    "card": rf"(?<!\d)(?<!\d\.)(?:3\d{{3}}{_MARK}\d{{6}}{_MARK}\d{{4,5}}|\d{{13,19}})(?!\d)",
}
PATTERNS = {
    "email": rf"(?<![{_USER}])(?<![{_USER}]')[{_USER}]['{_USER}]{{0,255}}+@(?:[{_HOST}](?:[{_HOST}-]{{0,61}}[{_HOST}])?\.){{1,126}}[A-Za-z{LETTERS}]{{2,24}}(?![{_HOST}])",
    "iban": r"(?<![A-Za-z0-9])(?=[A-Z]{2}\d\d)(?:" + "|".join(rf"(?:{names.replace(' ', '|')})\d\d(?:[{_BLANKS}-]?[A-Z0-9]){{{n - 4}}}" for n, names in IBANS.items()) + r")(?![A-Za-z0-9])",
    **_STRICT,
    "run": rf"(?<!\d)(?<!\d[.{_BLANKS}-])(?=\d(?:{_SOFT}?\d){{12}})\d+(?:{_SOFT}\d+)++(?![./]?\d)",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
INNER = "|".join(f"(?:{p})" for p in _STRICT.values())


def _number(text: Column) -> Column:
    return text.cast("long")


def keyed(spark: SparkSession, key: str) -> Column:
    """A struct of the two pads of HMAC-SHA256, as a subquery: plans show neither them nor the key."""
    raw = key.encode()
    if len(raw) > 64:
        import hashlib

        raw = hashlib.sha256(raw).digest()
    raw = raw.ljust(64, b"\0")
    pads = {"ipad": bytearray(c ^ 0x36 for c in raw), "opad": bytearray(c ^ 0x5C for c in raw)}
    return spark.sql("SELECT struct(ipad, opad) AS k FROM VALUES (:ipad, :opad) AS t(ipad, opad)", args=pads).scalar()


def _digest(key: Column, *parts: Column | str) -> Column:
    """HMAC-SHA256 of the parts, as 64 hexadecimal digits."""
    message = F.concat_ws("|", *(F.lit(p) if isinstance(p, str) else p for p in parts)).cast("binary")
    return F.sha2(F.concat(key["opad"], F.unhex(F.sha2(F.concat(key["ipad"], message), 256))), 256)


def feistel(a: Column, b: Column, m1: Column, m2: Column, key: Column, *tweak: Column | str) -> Column:
    """A keyed permutation of the pairs (a, b) with 0 <= a < m1, 0 <= b < m2, as a struct of both; `tweak` selects one of many."""

    def step(held: Column, k: Column) -> Column:
        turn = F.conv(F.substring(_digest(key, *tweak, k, held["m1"], held["m2"], held["b"]), 1, 15), 16, 10).cast("long")
        return F.struct(held["b"].alias("a"), ((held["a"] + turn % held["m1"]) % held["m1"]).alias("b"), held["m2"].alias("m1"), held["m1"].alias("m2"))

    start = F.struct(*(x.cast("long").alias(n) for x, n in ((a, "a"), (b, "b"), (m1, "m1"), (m2, "m2"))))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def permute_digits(digits: Column, key: Column, *tweak: Column | str) -> Column:
    """A string of 1 to 36 digits permuted among those of its length."""

    def made(d: Column) -> Column:
        n = F.length(d)
        u = F.floor(n / 2).cast("int")
        ten = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
        left = F.coalesce(F.when(u > 0, _number(F.substring(d, F.lit(1), u))), F.lit(0))
        out = feistel(left, _number(F.substring(d, u + 1, n - u)), ten(u), ten(n - u), key, *tweak)
        return let(out, lambda x: F.concat(F.when(u > 0, F.lpad(x["a"].cast("string"), u, "0")).otherwise(""), F.lpad(x["b"].cast("string"), n - u, "0")))

    return let(digits, made)


def permute_letters(letters: Column, key: Column, *tweak: Column | str) -> Column:
    """A string of 1 to 24 letters A to Z permuted among those of its length."""

    def value(text: Column) -> Column:
        return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda h, c: h * 26 + F.ascii(c) - 65)

    def spelt(x: Column, n: Column) -> Column:
        one = lambda i: F.char((65 + F.floor(x / F.pow(F.lit(26.0), n - i).cast("long")) % 26).cast("long"))
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), one), "")).otherwise("")

    def made(text: Column) -> Column:
        n = F.length(text)
        u = F.floor(n / 2).cast("int")
        size = lambda k: F.pow(F.lit(26.0), k).cast("long")
        out = feistel(value(F.substring(text, F.lit(1), u)), value(F.substring(text, u + 1, n - u)), size(u), size(n - u), key, *tweak)
        return let(out, lambda x: F.concat(spelt(x["a"], u), spelt(x["b"], n - u)))

    return let(letters, made)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def _laid_out(match: Column, new: Column, places: str = "^[0-9]$") -> Column:
    """The match with those of its characters that fit `places` replaced, in order, by the ones of `new`."""

    def step(held: Column, c: Column) -> Column:
        fits = c.rlike(places)
        return F.struct(F.concat(held["out"], F.when(fits, F.substring(new, held["k"] + 1, F.lit(1))).otherwise(c)).alias("out"), F.when(fits, held["k"] + 1).otherwise(held["k"]).alias("k"))

    return F.aggregate(F.split(match, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("k")), step)["out"]


def _luhn(digits: Column) -> Column:
    """Sum whose remainder by ten is zero for a number that ends with its right check digit."""

    def step(held: Column, c: Column) -> Column:
        d = F.coalesce(c.try_cast("int"), F.lit(0)) * F.when(held["k"] % 2 == 1, 2).otherwise(1)
        return F.struct((held["s"] + d - F.when(d > 9, 9).otherwise(0)).alias("s"), (held["k"] + F.length(c)).alias("k"))

    return F.aggregate(F.split(F.reverse(digits), ""), F.struct(F.lit(0).alias("s"), F.lit(0).alias("k")), step)["s"]


def _mod97(text: Column) -> Column:
    """Remainder by 97 of an IBAN's rearranged letters and digits."""

    def step(held: Column, c: Column) -> Column:
        value = F.when(c.rlike("^[0-9]$"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
        return F.when(c == "", held).otherwise((held * F.when(value > 9, 100).otherwise(10) + value) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _segment(kind: str | None, text: Column) -> Column:
    return F.struct(F.lit(kind).cast("string").alias("kind"), text.alias("text"))


def _none() -> Column:
    return F.expr("cast(array() as array<struct<kind:string,text:string>>)")


# What is a value: each function of this part gives whether a match is one, or the segments that it holds.


def _is_card(d: Column) -> Column:
    return (_luhn(d) % 10 == 0) & ~d.rlike("^0+$")


def _is_iban(m: Column) -> Column:
    return let(F.regexp_replace(m, "[^A-Z0-9]", ""), lambda x: _mod97(F.concat(F.substring(x, F.lit(5), F.length(x)), F.substring(x, 1, 4))) == 1)


def _country(m: Column, d: Column) -> Column:
    """Digits of the country code of a phone number."""
    return F.when(m.startswith("+"), F.length(F.regexp_extract(d, f"^(?:{CODES})", 0))).otherwise(0)


def _is_phone(m: Column) -> Column:
    return let(_digits(m), lambda d: F.length(d).between(7, 15) & (F.length(d) - _country(m, d) >= 6))


def _is_ssn(m: Column) -> Column:
    area, group, serial = (_number(F.substring(m, *p)) for p in ((1, 3), (5, 2), (8, 4)))
    return area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)


def _is_ip(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda x: _number(x) <= 255)


def _day(m: Column) -> Column:
    """(date, how it is written, century) of a match. With slashes the month stands first if both readings are valid."""
    iso, slash = m.substr(5, 1) == "-", m.substr(3, 1) == "/"
    a, b = F.substring(m, 1, 2), F.substring(m, 4, 2)
    shape = F.when(iso, "iso").when(slash & (_number(F.when(~iso, a)) <= 12), "month").when(slash, "slash").otherwise("dots")
    year = F.when(iso, F.substring(m, 1, 4)).otherwise(F.substring(m, 7, 4))
    month = F.when(iso, F.substring(m, 6, 2)).when(shape == "month", a).otherwise(b)
    day = F.when(iso, F.substring(m, 9, 2)).when(shape == "month", b).otherwise(a)
    return F.struct(F.concat_ws("-", year, month, day).try_cast("date").alias("date"), shape.alias("shape"), (F.floor(_number(year) / 100) * 100).alias("century"))


def _is_date(m: Column) -> Column:
    return let(_day(m), lambda x: x["date"].isNotNull() & x["century"].between(1800, 2100))


def _quads(m: Column) -> Column:
    """Segments of a run of groups of four digits (the last may be shorter): a card number may begin at each group, the first valid one counts."""

    def made(x: Column) -> Column:
        groups, marks = x["groups"], x["marks"]
        n = F.size(groups)

        def fits(i: Column, count: Column) -> Column:
            long = lambda d: F.when(count == 4, F.length(d) == 16).otherwise(F.length(d).between(17, 19))
            digits = F.array_join(F.transform(F.sequence(i, i + count - 1), lambda k: F.get(groups, k)), "")
            return (i + count <= n) & let(digits, lambda d: long(d) & d.rlike(SCHEMES) & _is_card(d))

        begins = F.transform(F.sequence(F.lit(0), n - 4), lambda i: F.struct(i.cast("int").alias("at"), F.coalesce(F.get(F.filter(F.array(F.lit(5), F.lit(4)), lambda c: fits(i, c)), F.lit(0)), F.lit(0)).alias("n")))
        empty = F.expr("cast(array() as array<struct<at:int,n:int>>)")

        def step(held: Column, b: Column) -> Column:
            return F.when(b["at"] >= held["end"], F.struct((b["at"] + b["n"]).cast("int").alias("end"), F.array_append(held["out"], b).alias("out"))).otherwise(held)

        chosen = F.aggregate(F.filter(begins, lambda b: b["n"] > 0), F.struct(F.lit(0).alias("end"), empty.alias("out")), step)["out"]

        def spelt(a: Column, count: Column) -> Column:  # a slice would copy the whole run
            return F.when(count > 0, F.array_join(F.transform(F.sequence(a, a + F.greatest(count, F.lit(1)) - 1), lambda k: F.concat(F.get(groups, k), F.get(marks, k))), "")).otherwise("")

        def pieces(held: Column) -> Column:
            end = lambda i: F.when(i > 0, F.get(held, i - 1)["at"] + F.get(held, i - 1)["n"]).otherwise(0)
            card = lambda c: F.array(_segment("card", F.concat(spelt(c["at"], c["n"] - 1), F.get(groups, c["at"] + c["n"] - 1))), _segment(None, F.get(marks, c["at"] + c["n"] - 1)))
            own = F.flatten(F.transform(held, lambda c, i: F.concat(F.array(_segment(None, spelt(end(i), c["at"] - end(i)))), card(c))))
            stop = end(F.size(held))
            return F.concat(own, F.array(_segment(None, spelt(stop, n - stop))))

        return let(chosen, pieces)

    marks = F.concat(F.regexp_extract_all(m, F.lit(_MARK), F.lit(0)), F.array(F.lit("")))
    return let(F.struct(F.split(m, _MARK).alias("groups"), marks.alias("marks")), made)


_VALID = {"ip": _is_ip, "date": _is_date, "ssn": _is_ssn, "phone": _is_phone, "card": lambda m: _is_card(_digits(m))}


def _strict(m: Column) -> Column:
    """Segments of a match of one of the strict patterns."""
    kind = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, valid in _VALID.items():
        kind = kind.when(m.rlike(f"^(?:{_STRICT[name]})$"), F.when(valid(m), name))
    return F.when(m.rlike(f"^(?:{_STRICT['quad']})$"), _quads(m)).otherwise(F.array(F.struct(kind.alias("kind"), m.alias("text"))))


def _between(text: Column, pattern: str, made: Column) -> Column:
    """The pieces of text between matches, each followed by the segments of the match after it."""
    gaps = F.split(text, pattern, -1)
    return F.flatten(F.zip_with(gaps, made, lambda g, segments: F.concat(F.array(_segment(None, g)), F.coalesce(segments, _none()))))


def _segments(m: Column) -> Column:
    """What a match holds: segments with the kind of value, or null for text that stays. A run of numbers may be a card number in
    groups of any length; otherwise what stands in it counts, as does a match of a strict pattern, which stands in itself.
    """
    within = _between(m, INNER, F.transform(F.regexp_extract_all(m, F.lit(INNER), F.lit(0)), _strict))
    card = m.rlike(f"^[0-9][0-9{_BLANKS}.-]{{12,}}$") & let(_digits(m), lambda d: F.length(d).between(13, 19) & _is_card(d))
    iban = F.array(F.struct(F.when(_is_iban(m), "iban").alias("kind"), m.alias("text")))
    return F.when(m.contains("@"), F.array(_segment("email", m))).when(m.rlike("^[A-Z]"), iban).when(card, F.array(_segment("card", m))).otherwise(within)


# What stands in its place.


def _email(m: Column, key: Column) -> Column:
    at = F.instr(m, "@")
    low = F.lower(m)
    user, host = F.substring(low, F.lit(1), at - 1), F.substring(low, at + 1, F.length(m))
    return F.concat(F.lit("u"), F.substring(_digest(key, "user", user, host), 1, 16), F.lit("@d"), F.substring(_digest(key, "host", host), 1, 10), F.lit(".invalid"))


def _card(m: Column, key: Column) -> Column:
    """The first digit stays."""

    def made(d: Column) -> Column:
        body = F.concat(F.substring(d, 1, 1), permute_digits(F.substring(d, F.lit(2), F.length(d) - 2), key, "card"))
        return let(body, lambda b: _laid_out(m, F.concat(b, ((10 - _luhn(F.concat(b, F.lit("0"))) % 10) % 10).cast("string"))))

    return let(_digits(m), made)


def _iban(m: Column, key: Column) -> Column:
    def made(flat: Column) -> Column:
        country, rest = F.substring(flat, 1, 2), F.substring(flat, F.lit(5), F.length(flat))
        own, spelt = _digits(rest), F.regexp_replace(rest, "[^A-Z]", "")
        new = F.when(F.length(own) > 0, _laid_out(rest, permute_digits(own, key, "iban", country))).otherwise(rest)
        blocks = F.transform(F.filter(F.array(F.lit(0), F.lit(1)), lambda k: k * 24 < F.length(spelt)), lambda k: permute_letters(F.substring(spelt, k * 24 + 1, F.lit(24)), key, "iban", country, k))

        def checked(body: Column) -> Column:
            check = F.lpad((98 - _mod97(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0")
            return _laid_out(m, F.concat(country, check, body), "^[A-Z0-9]$")

        return let(_laid_out(new, F.array_join(blocks, ""), "^[A-Z]$"), checked)

    return let(F.regexp_replace(m, "[^A-Z0-9]", ""), made)


def _phone(m: Column, key: Column) -> Column:
    """North American numbers keep valid area and exchange codes; of others, all digits after the country code are permuted."""

    def made(d: Column) -> Column:
        country = _country(m, d)
        national = F.substring(d, country + 1, F.length(d))
        area, exchange, line = (_number(F.substring(national, *p)) for p in ((1, 3), (4, 3), (7, 4)))
        american = (F.length(national) == 10) & ((country == 0) | d.startswith("1")) & (area >= 200) & (exchange >= 200)
        out = feistel(area - 200, (exchange - 200) * 10000 + line, F.lit(800), F.lit(8_000_000), key, "phone")
        whole = let(out, lambda x: F.concat((x["a"] + 200).cast("string"), (F.floor(x["b"] / 10000) + 200).cast("string"), F.lpad((x["b"] % 10000).cast("string"), 4, "0")))
        return _laid_out(m, F.concat(F.substring(d, F.lit(1), country), F.when(american, whole).otherwise(permute_digits(national, key, "phone"))))

    return let(_digits(m), made)


def _ssn(m: Column, key: Column) -> Column:
    area, group, serial = (_number(F.substring(m, *p)) for p in ((1, 3), (5, 2), (8, 4)))
    out = feistel(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, "ssn")

    def text(x: Column) -> Column:
        parts = (x["a"] + F.when(x["a"] + 1 >= 666, 2).otherwise(1), 3), (F.floor(x["b"] / 9999) + 1, 2), (x["b"] % 9999 + 1, 4)
        return F.concat_ws("-", *(F.lpad(p.cast("string"), n, "0") for p, n in parts))

    return let(out, text)


def _ip(m: Column, key: Column) -> Column:
    part = [_number(F.split_part(m, F.lit("."), F.lit(k))) for k in (1, 2, 3, 4)]
    out = feistel(part[0] * 256 + part[1], part[2] * 256 + part[3], F.lit(65536), F.lit(65536), key, "ip")
    return let(out, lambda o: F.concat_ws(".", *(x.cast("string") for h in ("a", "b") for x in (F.floor(o[h] / 256), o[h] % 256))))


def _date(m: Column, key: Column) -> Column:
    """A day of the same century: 36,524 = 92 * 397 days, or 36,525 = 75 * 487 if its first year is a leap year."""

    def made(x: Column) -> Column:
        base = F.concat(x["century"].cast("string"), F.lit("-01-01")).try_cast("date")
        long = x["century"] % 400 == 0
        m1, m2 = F.when(long, 75).otherwise(92).cast("long"), F.when(long, 487).otherwise(397).cast("long")
        rank = F.datediff(x["date"], base)
        out = feistel(F.floor(rank / m2), rank % m2, m1, m2, key, "date", x["century"].cast("string"))
        forms = {"iso": "yyyy-MM-dd", "month": "MM/dd/yyyy", "slash": "dd/MM/yyyy", "dots": "dd.MM.yyyy"}
        written = lambda new: F.coalesce(*(F.when(x["shape"] == k, F.date_format(new, f)) for k, f in forms.items()))
        return let(let(out, lambda o: F.date_add(base, (o["a"] * m2 + o["b"]).cast("int"))), written)

    return let(_day(m), made)


_MAKERS = {"email": _email, "iban": _iban, "card": _card, "phone": _phone, "ssn": _ssn, "ip": _ip, "date": _date}


def _written(s: Column, key: Column) -> Column:
    out = F.when(s["kind"].isNull(), s["text"])
    for kind, make in _MAKERS.items():
        out = out.when(s["kind"] == kind, make(s["text"], key))
    return out


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """`docs` with the text's values replaced, and `pii`: the array of kinds that were replaced, in order of place."""
    if not key:
        raise ValueError("a key is needed")
    pads, matches, segments = fresh(docs.columns, "pads", "matches", "segments")
    out = docs.withColumn(matches, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).withColumn(pads, keyed(docs.sparkSession, key))
    out = out.withColumn(segments, F.when(F.size(matches) > 0, _between(F.col(text), ANY, F.transform(matches, _segments))))
    kinds = F.filter(F.transform(segments, lambda s: s["kind"]), lambda k: k.isNotNull())
    whole = F.when(F.size(kinds) > 0, F.array_join(F.transform(segments, lambda s: _written(s, F.col(pads))), "")).otherwise(F.col(text))
    return out.withColumns({text: whole, "pii": F.coalesce(kinds, F.expr("cast(array() as array<string>)"))}).drop(pads, matches, segments)
