import datetime
import hmac
import random
import re

from pyspark.sql import functions as F

from quire.llm import pii, queries


def luhn(d):
    return sum(int(x) if k % 2 == 0 else sum(divmod(2 * int(x), 10)) for k, x in enumerate(reversed(d))) % 10 == 0


def iban_ok(s):
    s = re.sub("[^A-Z0-9]", "", s)
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def out(spark, texts, key="k"):
    frame = spark.createDataFrame([(k, t, "c") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    return {r.doc_id: (r.text, r.pii) for r in pii.pseudonymise(frame, key).collect()}


def test_formats_stay_valid_and_values_linked(spark):
    texts = [
        "mail a.b+c@Mail1.example.com, or A.B+C@mail1.example.com.",
        "call +1 (363) 555-6578 or 363-555-6578, else +44 20 7946 0958!",
        "card 4041894974608795 = 4041 8949 7460 8795 ; not 4041894974608796",
        "born 1987-02-28, that is 02/28/1987 or 28.02.1987; never 1987-02-30",
        "from 42.144.35.254, not 1.2.3.999 nor 1.2.3.4.5",
        "ssn 123-45-6789, not 666-45-6789 nor 000-12-3456",
        "iban DE89 3704 0044 0532 0130 00 and DE89370400440532013000 not DE88370400440532013000",
    ]
    got = out(spark, texts)
    text, kinds = got[0]
    mails = re.findall(r"[a-z0-9]+@[a-z0-9]+\.invalid", text)
    assert len(mails) == 2 and mails[0] == mails[1] and kinds == ["email"] * 2
    m = re.fullmatch(r"call \+1 \((\d{3})\) (\d{3})-(\d{4}) or (\d{3})-(\d{3})-(\d{4}), else \+44 \d\d \d{4} \d{4}!", got[1][0])
    assert m[1] + m[2] + m[3] == m[4] + m[5] + m[6] != "3635556578" and int(m[1]) >= 200 and int(m[2]) >= 200
    m = re.fullmatch(r"card (\d{16}) = (\d{4}) (\d{4}) (\d{4}) (\d{4}) ; not 4041894974608796", got[2][0])
    assert luhn(m[1]) and m[1] == m[2] + m[3] + m[4] + m[5] != "4041894974608795"
    m = re.fullmatch(r"born (\S+), that is (\S+) or (\S+); never 1987-02-30", got[3][0])
    day = datetime.date.fromisoformat(m[1])
    assert day != datetime.date(1987, 2, 28) and day.year // 100 == 19 and m[2] == day.strftime("%m/%d/%Y") and m[3] == day.strftime("%d.%m.%Y")
    m = re.fullmatch(r"from (\d+)\.(\d+)\.(\d+)\.(\d+), not 1.2.3.999 nor 1.2.3.4.5", got[4][0])
    assert all(int(x) < 256 for x in m.groups()) and ".".join(m.groups()) != "42.144.35.254"
    m = re.fullmatch(r"ssn (\d{3})-(\d\d)-(\d{4}), not 666-45-6789 nor 000-12-3456", got[5][0])
    assert "-".join(m.groups()) != "123-45-6789" and m[1] not in ("000", "666") and m[2] != "00"
    m = re.fullmatch(r"iban (DE\d\d(?: \d{4}){4} \d\d) and (DE\d{20}) not DE88370400440532013000", got[6][0])
    assert m[1].replace(" ", "") == m[2] != "DE89370400440532013000" and iban_ok(m[2])
    assert out(spark, texts[:1], key="other")[0] != got[0]


def test_feistel_is_a_permutation(spark):
    key = pii.keyed(spark, "k")
    frame = spark.range(92 * 7).withColumn("k", key).select(pii.feistel(F.floor(F.col("id") / 7), F.col("id") % 7, F.lit(92), F.lit(7), F.col("k")).alias("x"))
    assert frame.select("x.a", "x.b").distinct().count() == 92 * 7
    rows = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d")).withColumn("k", key)
    got = [r[0] for r in rows.select(pii.permute_digits(F.col("d"), F.col("k"))).collect()]
    assert sorted(got) == [f"{k:03}" for k in range(1000)]
    one = [r[0] for r in spark.range(10).withColumn("k", key).select(pii.permute_digits(F.col("id").cast("string"), F.col("k"))).collect()]
    assert sorted(one) == [str(k) for k in range(10)]
    letters = spark.range(26 * 26).withColumn("k", key).select(pii.permute_letters(F.concat(*(F.char(F.lit(65) + x) for x in (F.floor(F.col("id") / 26), F.col("id") % 26))), F.col("k")))
    assert len({r[0] for r in letters.collect()}) == 676 and all(re.fullmatch("[A-Z]{2}", r[0]) for r in letters.collect())


def test_edge_rows(spark):
    long = "word " * 200000 + "4041894974608795"
    got = out(spark, [None, "", "no values: 12, 3.14, 2024", long, "x 42.144.35.254", "x 42.144.35.254"])
    assert got[0] == (None, []) and got[1] == ("", []) and got[2] == ("no values: 12, 3.14, 2024", [])
    assert got[3][1] == ["card"] and got[3][0].startswith("word " * 200000) and len(got[3][0]) == len(long)
    assert got[4] == got[5]
    assert out(spark, []) == {}


# A second implementation, of single texts in Python.


def prf(key, *parts):
    return int(hmac.new(key.encode(), "|".join(map(str, parts)).encode(), "sha256").hexdigest()[:15], 16)


def permuted(a, b, m1, m2, key, *tweak):
    for k in range(10):
        a, b, m1, m2 = b, (a + prf(key, *tweak, k, m1, m2, b)) % m1, m2, m1
    return a, b


def in_base(text, base, zero, key, *tweak):
    def spelt(x, n):
        return "".join(chr(ord(zero) + x // base**i % base) for i in reversed(range(n)))

    u = len(text) // 2
    value = lambda t: sum((ord(c) - ord(zero)) * base**i for i, c in enumerate(reversed(t)))
    a, b = permuted(value(text[:u]), value(text[u:]), base**u, base ** (len(text) - u), key, *tweak)
    return spelt(a, u) + spelt(b, len(text) - u)


def filled(shape, new, fits):
    new = iter(new)
    return "".join(next(new) if fits(c) else c for c in shape)


def is_digit(c):
    return c in "0123456789"


def new_card(m, key):
    d = "".join(filter(is_digit, m))
    body = d[0] + in_base(d[1:-1], 10, "0", key, "card")
    return filled(m, body + next(x for x in "0123456789" if luhn(body + x)), is_digit)


def new_iban(m, key):
    flat = re.sub("[^A-Z0-9]", "", m)
    rest, own, letters = flat[4:], "".join(filter(is_digit, flat[4:])), "".join(c for c in flat[4:] if not is_digit(c))
    rest = filled(rest, in_base(own, 10, "0", key, "iban", flat[:2]) if own else "", is_digit)
    rest = filled(rest, "".join(in_base(letters[k : k + 24], 26, "A", key, "iban", flat[:2], k // 24) for k in range(0, len(letters), 24)), str.isupper)
    check = next(f"{k:02}" for k in range(2, 99) if iban_ok(f"{flat[:2]}{k:02}{rest}"))
    return filled(m, flat[:2] + check + rest, str.isalnum)


def country_of(m, d):
    return len(re.match(pii.CODES, d)[0]) if m[0] == "+" else 0


def new_phone(m, key):
    d = "".join(filter(is_digit, m))
    c = country_of(m, d)
    n = d[c:]
    if len(n) == 10 and (c == 0 or d[0] == "1") and n[0] >= "2" and n[3] >= "2":
        a, b = permuted(int(n[:3]) - 200, int(n[3:]) - 2000000, 800, 8_000_000, key, "phone")
        n = f"{a + 200}{b + 2000000:07}"
    else:
        n = in_base(n, 10, "0", key, "phone")
    return filled(m, d[:c] + n, is_digit)


def new_ssn(m, key):
    area, group, serial = map(int, m.split("-"))
    a, b = permuted(area - 1 - (area > 666), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")
    return f"{a + 1 + (a + 1 >= 666):03}-{b // 9999 + 1:02}-{b % 9999 + 1:04}"


def new_ip(m, key):
    p = list(map(int, m.split(".")))
    a, b = permuted(p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536, key, "ip")
    return f"{a >> 8}.{a & 255}.{b >> 8}.{b & 255}"


def day_of(m):
    for form in ("%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%d.%m.%Y"):
        if form == "%d/%m/%Y" and re.match("(0[0-9]|1[0-2])/", m):
            continue  # as a month it is no day
        try:
            return datetime.datetime.strptime(m, form).date(), form
        except ValueError:
            pass


def new_date(m, key):
    day, form = day_of(m)
    base = datetime.date(day.year // 100 * 100, 1, 1)
    m1, m2 = (75, 487) if base.year % 400 == 0 else (92, 397)
    a, b = permuted(*divmod((day - base).days, m2), m1, m2, key, "date", base.year)
    return (base + datetime.timedelta(a * m2 + b)).strftime(form)


def new_email(m, key):
    user, host = m.lower().split("@")
    digest = lambda *p: hmac.new(key.encode(), "|".join(p).encode(), "sha256").hexdigest()
    return f"u{digest('user', user, host)[:16]}@d{digest('host', host)[:10]}.invalid"


def card_in(d):
    return set(d) != {"0"} and luhn(d)


def pseudonyms(text, key, inside=False):
    """The text with its values replaced, and their kinds."""
    out, kinds, end = [], [], 0

    def put(kind, new):
        kinds.append(kind)
        out.append(new)

    for found in re.finditer(pii.INNER if inside else pii.ANY, text):
        m = found[0]
        out.append(text[end : found.start()])
        end = found.end()
        d = "".join(filter(is_digit, m))
        if "@" in m:
            put("email", new_email(m, key))
        elif m[0].isupper():
            put("iban", new_iban(m, key)) if iban_ok(m) else out.append(m)
        elif not inside and re.fullmatch("[0-9][0-9 \u00a0\u202f.-]{12,}", m) and 13 <= len(d) <= 19 and card_in(d):
            put("card", new_card(m, key))
        elif not inside:
            new, own = pseudonyms(m, key, True)
            out.append(new)
            kinds.extend(own)
        elif re.fullmatch(r"\d{4}(?:(?:[ \u00a0\u202f]{1,2}|[.-])\d{4}){3,}(?:(?:[ \u00a0\u202f]{1,2}|[.-])\d{1,3})?", m):
            parts = re.split("([ \u00a0\u202f]{1,2}|[.-])", m) + [""]
            k = 0
            while k < len(parts):
                for n in (5, 4):
                    own = "".join(parts[k : k + 2 * n : 2])
                    if len(parts) >= k + 2 * n and len(own) in ((16,) if n == 4 else (17, 18, 19)) and re.match(pii.SCHEMES, own) and card_in(own):
                        put("card", new_card("".join(parts[k : k + 2 * n - 1]), key))
                        out.append(parts[k + 2 * n - 1])
                        k += 2 * n
                        break
                else:
                    out += parts[k : k + 2]
                    k += 2
        elif m.count(".") == 3:
            put("ip", new_ip(m, key)) if all(int(x) < 256 for x in m.split(".")) else out.append(m)
        elif re.fullmatch(pii.PATTERNS["date"], m):
            put("date", new_date(m, key)) if day_of(m) and 1800 <= day_of(m)[0].year < 2200 else out.append(m)
        elif re.fullmatch(r"\d{3}-\d\d-\d{4}", m):
            a, g, s = map(int, m.split("-"))
            put("ssn", new_ssn(m, key)) if 0 < a < 900 and a != 666 and g and s else out.append(m)
        elif re.fullmatch(pii.PATTERNS["card"], m):
            put("card", new_card(m, key)) if card_in(d) else out.append(m)
        else:
            put("phone", new_phone(m, key)) if 7 <= len(d) <= 15 and len(d) - country_of(m, d) >= 6 else out.append(m)
    return "".join([*out, text[end:]]), kinds


def test_whole_texts_agree_with_another_implementation(spark):
    rng = random.Random(5)
    values = [
        "4111 1111 1111 1111", "4111111111111111", "5500-0000-0000-0004", "3787 344936 71000", "404189 4974608795", "GB82 WEST 1234 5698 7654 32", "BE68 5390 0754 7034", "ES91 2100 0418 4502 0005 1332",
        "DE89370400440532013000", "MT84 MALT 0110 0001 2345 MTLC AST0 01S", "1987-02-28", "02/28/1987", "28/02/1987", "28.02.1987", "2000-02-29", "1900-02-29", "123-45-6789", "900-45-6789", "42.144.35.254", "1.2.3.999",
        "+1 (363) 555-6578", "363-555-6578", "363 555 6578", "+13635556578", "+44 20 7946 0958", "+442079460958", "(099) 111 2222", "A.b+c@Mail.example.com", "d@x.y.org.", "0000 0000 0000 0000", "4111 1111 1111 1111 123", "6304 0000 0000 0000 000",
    ]
    noise = ["12", "2024", "1234", "CODE", "IS", "a", "no 7,", "é", "-", "x.", "\n", "99999", "3.14", "+", "1-2", "1999 2000 2001 2002"]
    texts = ["".join(rng.choice(values if rng.random() < 0.5 else noise) + rng.choice([" ", " ", " ", "-", ", ", "\n", "; "]) for _ in range(rng.randint(1, 12))) for _ in range(1500)]
    got = out(spark, texts, "secret")
    for k, text in enumerate(texts):
        assert got[k] == pseudonyms(text, "secret"), text


HIDDEN = [
    "No.4111111111111111", "card no.4111 1111 1111 1111", "v.4111-1111-1111-1111", "4111.1111.1111.1111", "4111\u00a01111\u00a01111\u00a01111", "4111  1111  1111  1111", "DE89-3704-0044-0532-0130-00",
    "DE89\u00a03704\u00a00044\u00a00532\u00a00130\u00a000", "büro@example.de", "j'ohn@example.com", "'jane@example.com'", "знак@пример.рф", "+44\u00a020\u00a07946\u00a00958", "363\u00a0555\u00a06578", "3787.344936.71000", "4041894974608795.", ".4041894974608795",
]


def test_marks_and_stops_hide_no_value(spark):
    rng = random.Random(11)
    noise = ["x", "é", "1.5", "12", "no.", "...", "'", "it's", "2021.03", "1.2.3"]
    texts = HIDDEN + ["".join(rng.choice(HIDDEN if rng.random() < 0.5 else noise) + rng.choice([" ", ", ", "\n", "  ", "\u00a0"]) for _ in range(rng.randint(1, 10))) for _ in range(600)]
    got = out(spark, texts, "secret")
    for k, text in enumerate(texts):
        assert got[k] == pseudonyms(text, "secret"), text
    for k, text in enumerate(HIDDEN):
        assert len(got[k][1]) == 1 and got[k][0] != text, text
        digits = "".join(filter(is_digit, text))
        assert len(digits) < 8 or digits not in "".join(filter(is_digit, got[k][0]))
    assert "bü" not in got[8][0] and "j'" not in got[9][0] and got[10][0][0] == got[10][0][-1] == "'"


def test_decimals_and_versions_stay(spark):
    texts = ["1.4111111111111111", "3.14 2.71 1.41 1.73", "v1.2.3 of 2021.03.04", "it's 'so' @home.de", "a@b"]
    assert [x for _, x in sorted(out(spark, texts).items())] == [(t, []) for t in texts]


def test_query_agrees_with_another_implementation(spark, small):
    got = {r.doc_id: r for r in queries.op2_pii(spark, small).collect()}
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        text, kinds = pseudonyms(r.text, queries.PII_KEY)
        assert got[r.doc_id].text == text
        assert [got[r.doc_id][f"n_{k}"] for k in pii.KINDS] == [kinds.count(k) for k in pii.KINDS]


def test_neighbours_hide_no_value(spark):
    texts = ["card 4111 1111 1111 1111 123", "BE68 5390 0754 7034 CODE", "ES91 2100 0418 4502 0005 1332 IS", "1234 4111 1111 1111 1111 5500 0000 0000 0004 99", "12 1987-02-28 363-555-6578", "+44 20 7946 0958 2024 1234"]
    got = out(spark, texts)
    assert [got[k][1] for k in range(6)] == [["card"], ["iban"], ["iban"], ["card", "card"], ["date", "phone"], ["phone"]]
    for k, value in enumerate(("4111 1111 1111 1111", "5390 0754 7034", "2100 0418 4502 0005 1332", "4111 1111 1111 1111", "1987-02-28", "20 7946 0958")):
        assert value not in got[k][0]
    iban = out(spark, ["GB82 WEST 1234 5698 7654 32 GB82WEST12345698765432"])[0][0]
    assert "WEST" not in iban and iban[:27].replace(" ", "") == iban[28:] and iban_ok(iban[28:])


def test_no_pattern_recurses_by_length(spark):
    n = 100_000
    plain = ["x@" + "a." * n + "com", "x" * n + "@a.com", "a.b@" * n, "1 " * n, "1-" * n, "1234 " * n, "1.2." * n, "BE68 " * n, "+1 " * n, "12/" * n, "1" * n, "A1" * n, "(555) " * n, "a@a.b." * n, "1999 2000 " * n + ".5", "1." * n + "1"]
    got = out(spark, plain)
    assert [got[k] for k in range(len(plain))] == [(t, []) for t in plain]


def test_the_key_is_in_no_plan(spark, small):
    made = queries.op2_pii(spark, small)._jdf.queryExecution()
    for shown in (made.toString(), made.executedPlan().treeString()):
        assert queries.PII_KEY not in shown and queries.PII_KEY.encode().hex() not in shown.lower()


def test_names_that_clash(spark):
    frame = spark.createDataFrame([(1, "x 42.144.35.254", "p", "m", "s", "k")], "doc_id long, text string, PII string, __matches string, __Segments string, __pads string")
    made = pii.pseudonymise(frame, "k")
    row = made.first()
    assert sorted(c.lower() for c in made.columns) == sorted(["doc_id", "text", "pii", "__matches", "__segments", "__pads"])
    assert row["pii"] == ["ip"] and (row["__matches"], row["__Segments"], row["__pads"]) == ("m", "s", "k")


def test_query_replaces_all_planted_values(spark, small):
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    after = {r.doc_id: r.text for r in queries.op2_pii(spark, small).collect()}
    shapes = r"\S+@\S+\.com|\+1 \(\d{3}\) \d{3}-\d{4}|\b\d{16}\b|\b\d{1,3}(?:\.\d{1,3}){3}\b"
    changed = 0
    for i, text in before.items():
        values = [v for v in re.findall(shapes, text) if not (v.isdigit() and not luhn(v))]
        changed += bool(values)
        assert not any(v in after[i] for v in values)
        assert values or after[i] == text
    assert changed > 5


def test_native_plan(spark, small):
    plan = queries.op2_pii(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
