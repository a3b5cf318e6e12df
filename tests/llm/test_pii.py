from __future__ import annotations

import datetime
import hashlib
import re

import pytest
import regex

from tablewright.llm import pii as P
from tests.conftest import SMALL

ROWS = [(1, "pay 4111 1111 1111 1111 now, or 4111-1111-1111-1111."), (2, "born 1985-03-12, 12/31/1999, 31.12.1999 and 99/99/1999"), (3, None), (4, ""),
        (5, "call +1 (743) 555-3824 or (743) 555-3824 / 743-555-3824"), (6, "nothing 2.0 v3.1 here 12"), (7, "mail en.66@mail8.example.com, EN.66@x.org"),
        (8, "at 233.233.171.252!! not 999.1.1.1 nor 1.2.3.4.5"), (9, "DE89 3704 0044 0532 0130 00 GB82WEST12345698765432 GB82WEST12345698765431"),
        (10, "id 078-05-1120 number 2123465659789240 x4111111111111111x"), (11, "card 4111111111111111"), (11, "card 4111111111111111"),
        (12, "é 1985-03-12 " + "long text " * 50_000 + "4111111111111111"), (None, "x 4111111111111111")]


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10


@pytest.fixture(scope="module")
def out(spark):
    df = spark.createDataFrame([(i, t, "f") for i, t in ROWS], "doc_id long, text string, found string").repartition(2)
    made = P.protect(df, "key").cache()
    return made, {(r.doc_id, k): r for k, r in enumerate(made.collect())}


def by_id(out, i):
    return next(r for (d, _), r in out[1].items() if d == i)


def test_columns_and_untouched(out):
    assert out[0].columns == ["doc_id", "text", "found", "found_"] and len(out[1]) == len(ROWS)
    for i in (3, 4, 6):
        assert by_id(out, i).text == dict(ROWS)[i] and by_id(out, i).found_ == []


def test_undone(spark, out):
    back = P.protect(out[0].drop("found_"), "key", back=True).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in back) == sorted((str(i), str(t)) for i, t in ROWS)


def test_formats_and_links(out):
    card = re.findall(r"\d{4}(?:[ -]\d{4}){3}", by_id(out, 1).text)
    plain = by_id(out, 11).text.removeprefix("card ")
    assert {re.sub(r"\D", "", c) for c in card} == {plain} and plain != "4111111111111111" and luhn(plain) == 0
    assert by_id(out, None).text == f"x {plain}" and by_id(out, 12).text.endswith(plain)
    assert re.fullmatch(r"born \d{4}-\d\d-\d\d, \d\d/\d\d/\d{4}, \d\d\.\d\d\.\d{4} and 99/99/1999", by_id(out, 2).text) and "1985" not in by_id(out, 2).text
    us, eu = re.search(r"(\d\d)/(\d\d)/(\d{4})", by_id(out, 2).text), re.search(r"(\d\d)\.(\d\d)\.(\d{4})", by_id(out, 2).text)
    assert (us[1], us[2], us[3]) == (eu[2], eu[1], eu[3])  # the same day in both forms
    phones = [re.sub(r"\D", "", p)[-10:] for p in re.findall(r"\(?\d{3}\)?[ -]\d{3}-\d{4}", by_id(out, 5).text)]
    assert len(phones) == 3 and len(set(phones)) == 1 and phones[0] != "7435553824" and by_id(out, 5).text.startswith("call +1 (")
    mail = by_id(out, 7).text
    assert re.fullmatch(r"mail [a-z]{2}\.\d\d@mail8\.example\.com, [A-Z]{2}\.\d\d@x\.org", mail) and "en.66" not in mail
    assert "999.1.1.1" in by_id(out, 8).text and "1.2.3.4.5" in by_id(out, 8).text and "233.233.171.252" not in by_id(out, 8).text
    ibans = by_id(out, 9).text
    assert "GB82WEST12345698765431" in ibans and "0532 0130" not in ibans
    for x in (ibans[:27], ibans[28:50]):
        flat = x.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1
    assert by_id(out, 10).text.endswith(" number 2123465659789240 x4111111111111111x") and "078-05-1120" not in by_id(out, 10).text  # the check digit is wrong


def test_permutation_of_short_numbers(spark):
    from pyspark.sql import functions as F

    df = spark.range(1_000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    moved = [r[0] for r in df.select(P.permuted_digits(F.col("d"), "key", F.lit("t"))).collect()]
    assert sorted(moved) == [f"{i:03d}" for i in range(1_000)] and sum(a == f"{i:03d}" for i, a in enumerate(moved)) < 10
    other = [r[0] for r in df.select(P.permuted_digits(F.col("d"), "other", F.lit("t"))).collect()]
    assert other != moved


def test_empty(spark):
    assert P.protect(spark.createDataFrame([], "doc_id long, text string"), "k").count() == 0


def test_numbers_that_fail_their_check_stay(spark):
    bad = ["order 1718000000123 of", "x 2123465659789240 y", "4111 1111 1111 1112", "000-12-3456 666-12-3456 900-12-3456 123-00-4567 123-45-0000"]
    good = [f"{a:03d}-{g:02d}-{n:04d}" for a, g, n in ((1, 1, 1), (665, 99, 9999), (667, 5, 1120), (899, 99, 9999), (78, 5, 1120))]
    df = spark.createDataFrame(list(enumerate(bad + good)), "doc_id long, text string")
    out = P.protect(df, "key").cache()
    new = [r for r in out.orderBy("doc_id").collect()]
    assert [r.text for r in new[:4]] == bad and not any(r.found for r in new[:4])
    for was, r in zip(good, new[4:], strict=True):
        area, group, serial = map(int, re.fullmatch(r"(\d{3})-(\d{2})-(\d{4})", r.text).groups())
        assert r.text != was and 0 < area < 900 and area != 666 and group and serial
    assert [r.text for r in P.protect(out.drop("found"), "key", back=True).orderBy("doc_id").collect()] == bad + good


def test_neighbours_are_not_swallowed(spark):
    card = "4111 1111 1111 1111"
    ibans = ["ES9121000418450200051332 EUR", "ES91 2100 0418 4502 0005 1332 BIC", "AT611904300234573201 BIC", "ES9121000418450200051332 GB82 WEST 1234 5698 7654 32"]
    cards = [card, card + " 12/26", card + " 123", card + " 12.03.1985", card + " 743-555-3824", "3 " + card, "qty 3 4111111111111111 x", card + " 42 next", "4111-1111-1111-1111-12/26"]
    texts = ibans + cards
    out = P.protect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key").cache()
    rows = out.orderBy("doc_id").collect()

    def right(flat):
        return int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1

    for was, r in zip(ibans[:3], rows, strict=False):
        head, word = was.rsplit(" ", 1)
        assert r.text.endswith(" " + word) and len(r.text) == len(was) and not r.text.startswith(head)
        assert [f.kind for f in r.found] == ["iban"] and r.found[0].value == r.text.removesuffix(" " + word) and right(r.found[0].value.replace(" ", ""))
    assert [f.kind for f in rows[3].found] == ["iban", "iban"] and all(right(f.value.replace(" ", "")) for f in rows[3].found)
    plain = rows[4].text.replace(" ", "")
    for was, r in zip(cards, rows[4:], strict=True):
        values = [re.sub(r"\D", "", f.value) for f in r.found if f.kind == "card"]
        assert values == [plain], (was, r.text, r.found)
    tails = [r.text for r in rows[4:]]
    assert tails[1].endswith(" 12/26") and tails[2].endswith(" 123") and tails[5].startswith("3 ") and tails[6].startswith("qty 3 ") and tails[7].endswith(" 42 next") and tails[8].endswith("-12/26")
    assert "1985" not in tails[3] and [f.kind for f in rows[7].found] == ["card", "date"] and [f.kind for f in rows[8].found] == ["card", "phone"]
    assert [r.text for r in P.protect(out.drop("found"), "key", back=True).orderBy("doc_id").collect()] == texts


def test_cards_with_any_tail_are_undone_and_linked(spark):
    def made(n, body):
        return next(f"{body:0{n - 1}d}{c}" for c in range(10) if luhn(f"{body:0{n - 1}d}{c}") == 0)

    texts = []
    for i in range(150):
        d = made(16, 4_000_000_000_000_00 + i * 7_919)
        four = " ".join(d[k:k + 4] for k in range(0, 16, 4))
        e = made(15, 37_000_000_000_000 + i * 104_729)
        texts += [four, f"{four} {i:03d}", f"{e[:4]} {e[4:10]} {e[10:]} {i % 10} {i % 7}"]
    out = P.protect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key").cache()
    rows = out.orderBy("doc_id").collect()
    assert all(rows[k].text == rows[k + 1].text[:19] for k in range(0, len(rows), 3)) and all(r.text != t for r, t in zip(rows, texts, strict=True))
    assert [r.text for r in P.protect(out.drop("found"), "key", back=True).orderBy("doc_id").collect()] == texts


def test_no_text_overflows_the_matcher(spark):
    """Long tables of short numbers, domains of many labels and the like, in about linear time."""
    long = ["12 " * 400_000, "x@a" + ".a" * 400_000, "1-" * 400_000, "1234 " * 200_000, "+1" * 400_000, "a.b" * 300_000, "1.1." * 200_000, "GB82 " * 200_000, "(123)" * 200_000, "1 " * 30 + "4111 1111 1111 1111"]
    df = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string").repartition(4)
    rows = P.protect(df, "key").orderBy("doc_id").collect()
    assert [len(r.text) for r in rows] == list(map(len, long))
    assert all(r.text == t for r, t in zip(rows[:9], long, strict=False) if "@" not in t) and [f.kind for f in rows[1].found] == ["email"]
    assert rows[9].text.startswith("1 " * 30) and [f.kind for f in rows[9].found] == ["card"]


# A plain version: the same patterns, scanned and permuted in Python.
def keyed(key, label, i, other):
    return int(hashlib.sha256(f"{key}|{label}|{i}|{other}".encode()).hexdigest()[:12], 16)


def feistel(a, b, size_a, size_b, key, label):
    for i in range(P.ROUNDS):
        if i % 2 == 0:
            a = (a + keyed(key, label, i, b) % size_a) % size_a
        else:
            b = (b + keyed(key, label, i, a) % size_b) % size_b
    return a, b


def digits(d, key, label):
    half = (len(d) + 1) // 2
    a, b = feistel(int(d[:half]), int(d[half:] or 0), 10**half, 10 ** (len(d) - half), key, f"{label}:{len(d)}")
    return f"{a:0{half}d}" + (f"{b:0{len(d) - half}d}" if len(d) > half else "")


def only_digits(t):
    return "".join(c for c in t if c in "0123456789")


def refill(t, d):
    it = iter(d)
    return "".join(next(it) if c in "0123456789" else c for c in t)


def plain_email(m, key):
    local, domain = m.rsplit("@", 1)
    half = (len(local) + 1) // 2
    a, b = local[:half], local[half:]

    def shifted(t, other, i):
        out = ""
        for at, c in enumerate(t):
            base, zero = (10, 48) if c.isdigit() else (26, 65) if c.isupper() else (26, 97)
            if re.match("[A-Za-z0-9]", c):
                n = int(hashlib.sha256(f"{key}|email|{i}|{at}|{len(local)}|{other}".encode()).hexdigest()[:8], 16)
                c = chr(zero + (ord(c) - zero + n % base) % base)
            out += c
        return out

    for i in range(6):
        if i % 2 == 0:
            a = shifted(a, b, i)
        else:
            b = shifted(b, a, i)
    return f"{a}{b}@{domain}"


def plain_iban(m, key):
    def value(t):
        return int("".join(str(int(c, 36)) for c in t))

    flat = m.replace(" ", "")
    if value(flat[4:] + flat[:4]) % 97 != 1 or not 10 <= len(only_digits(flat)) <= 36:
        return m
    body = refill(flat[4:], digits(only_digits(flat[4:]), key, "iban" + flat[:2]))
    return refill(m, f"{98 - value(body + flat[:2] + '00') % 97:02d}" + only_digits(body))


def plain_date(m, key):
    iso = bool(re.match(r"\d{4}-", m))
    x, y, z = re.split("[./-]", m)
    swap = "/" in m and int(x) <= 12
    year, month, day = (x, y, z) if iso else (z, x, y) if swap else (z, y, x)
    try:
        n = (datetime.date(int(year), int(month), int(day)) - datetime.date(1800, 1, 1)).days
    except ValueError:
        return m
    if not 0 <= n < 146_097:
        return m
    a, b = feistel(n // 773, n % 773, 189, 773, key, "date")
    new = datetime.date(1800, 1, 1) + datetime.timedelta(days=a * 773 + b)
    return new.strftime("%Y-%m-%d" if iso else "%m/%d/%Y" if swap else "%d/%m/%Y" if "/" in m else "%d.%m.%Y")


def plain_address(m, key):
    p = list(map(int, m.split(".")))
    if max(p) > 255:
        return m
    a, b = feistel(p[0] * 256 + p[1], p[2] * 256 + p[3], 65_536, 65_536, key, "address")
    return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"


def plain_ssn(m, key):
    area, group, serial = map(int, m.split("-"))
    if not 1 <= area <= 899 or area == 666 or not group or not serial:
        return m
    a, b = feistel(area - 1 - (area > 666), (group - 1) * 9_999 + serial - 1, 898, 99 * 9_999, key, "ssn")
    return f"{a + 1 + (a >= 665):03d}-{b // 9_999 + 1:02d}-{b % 9_999 + 1:04d}"


def plain_phone(m, key):
    code = re.match(r"(\+\d{1,3}(?=[ .(-]))?", m)[0]
    rest = m[len(code):]
    return code + refill(rest, digits(only_digits(rest), key, "phone"))


def plain_card(m, key):
    """New value and what follows it."""
    d = only_digits(m)
    counts = [16] if re.match(r"\d{4}(?:[ -]?\d{4}){3}[ -]", m) else []
    counts += [len(d)] + [n for n in range(18, 12, -1) if re.match(rf"\d(?:[ -]?\d){{{n - 1}}}[ -]", m)]
    counts = list(dict.fromkeys(counts))

    def taken(x):
        return next((n for n in counts if luhn(x[:n]) == 0), None)

    n = taken(d)
    if n is None:
        return m, ""
    new, rest = d[:n], d[n:]
    while True:
        body = digits(new[:n - 1], key, "card")
        new = body + str((10 - luhn(body + "0") % 10) % 10)
        if taken(new + rest) == n:
            break
    out = refill(m, new + rest)
    at = [k for k, c in enumerate(m) if c.isdigit()][n - 1] + 1
    return out[:at], out[at:]


PLAIN = {"email": plain_email, "iban": plain_iban, "date": plain_date, "address": plain_address, "ssn": plain_ssn, "phone": plain_phone}


def plain(text, key):
    if not text or not re.search("[0-9@]", text):
        return text, []
    out, at, found = "", 0, []
    for m in regex.finditer(P.PATTERN.replace(r"\d", "[0-9]"), text):
        kind = next(k for k, p in P.KINDS if regex.fullmatch(p, m[0]))
        value, tail = plain_card(m[0], key) if kind == "card" else (PLAIN[kind](m[0], key), "")
        if value + tail != m[0]:
            found.append((kind, value))
        out += text[at:m.start()] + value + tail
        at = m.end()
    return out + text[at:], found


def test_against_plain_version(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-i - 1, t) for i, (_, t) in enumerate(ROWS)], "doc_id long, text string")
    every = docs.unionAll(extra)
    want = {r.doc_id: plain(r.text, "key") for r in every.collect()}
    got = {r.doc_id: (r.text, [tuple(f) for f in r.found]) for r in P.protect(every, "key").collect()}
    assert got == want and {k for _, f in want.values() for k, _ in f} >= {"email", "card", "iban", "phone"}
