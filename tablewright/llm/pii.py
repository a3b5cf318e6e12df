"""Format-preserving pseudonyms for personal data, in DataFrame functions alone.

Numbers and dates that pass the checks of their kind are permuted by a keyed Feistel network
inside their own format: the digits of a number change and its punctuation stays, check
digits are made right again, a date becomes another date of the same 400 years. Equal values
get equal pseudonyms in every document, so records stay linked, and whoever holds the key
can undo them. The letters and digits of an e-mail's local part are permuted likewise.

A text is cut at the matches of one pattern, and pieces and pseudonyms are put together
again; nothing but the matches changes.

Defined results: a null text stays null with no finds; what fails its kind's check (a card
number's check digit, an account number's remainder, a calendar date, an address part over
255, a social security number outside the ranges given out) stays as it is; phone numbers and
e-mail addresses have no check but their form; overlapping kinds: the first in the order of
``KINDS``. An account number has the length of its country. Where digits follow a card number,
the ending that passes the check counts, and the rest of the match stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.llm.shared import wrapped

# Patterns of the kinds, in the order in which they are tried at one place.
# Every match begins where no letter or digit stands before, and holds a digit or an @.
_EDGE = r"(?<![\p{L}\p{N}])"
_AFTER = r"(?![\p{L}\p{N}])"
#: Countries by the length of their account numbers: those of the IBAN registry, and others in use.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV",
    22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "AO|CV|GW|LY|MZ|PT|ST",
    26: "DZ|IR|IS|TR", 27: "BI|CF|CG|CM|DJ|FR|GA|GQ|GR|IT|KM|MC|MG|MR|SM|TD", 28: "AL|AZ|BF|BJ|BY|CI|CY|DO|GT|HN|HU|LB|MA|ML|NE|NI|PL|SN|SV|TG",
    29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU",
}


def _iban_form(length: int, codes: str) -> str:
    fours, rest = divmod(length - 4, 4)
    return rf"(?:{codes})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}" + (f" ?[A-Z0-9]{{{rest}}}" if rest else "")


# A card number stops before digits that go on as a date, a phone or another number, where it can, and
# a short number before one in four groups of four is not part of it; from 19 short numbers away no
# match reaches it. Repeated groups are bounded or possessive, as the others recurse in the JVM's matcher.
_CARD = r"(?!\d{1,3}[ -](?:\d{1,3}[ -]){0,17}+\d{4}(?:[ -]?\d{4}){3}(?![\p{L}\p{N}]))\d(?:[ -]?\d){12,18}"
KINDS = (
    ("email", r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})++"),
    ("iban", "(?:" + "|".join(_iban_form(n, codes) for n, codes in IBAN_LENGTHS.items()) + ")" + _AFTER),
    ("date", r"(?:\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4})" + _AFTER),
    ("address", r"(?<!\.)\d{1,3}(?:\.\d{1,3}){3}(?!\.?[\p{L}\p{N}])"),
    ("ssn", r"\d{3}-\d{2}-\d{4}" + _AFTER),
    ("phone", r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}" + _AFTER
     + r"|\(\d{3}\) ?\d{3}[ .-]\d{4}" + _AFTER + r"|\d{3}[.-]\d{3}[.-]\d{4}" + _AFTER),
    ("card", _CARD + r"(?![\p{L}\p{N}]|[./-]\d)|" + _CARD + _AFTER),
)
PATTERN = _EDGE + "(?:" + "|".join(f"(?:{p})" for _, p in KINDS) + ")"
ROUNDS = 10
_FIRST_DAY, _DAYS = "1800-01-01", 146_097  # 400 years
_DAY_PARTS = (189, 773)


def _round(key: str, label, i, other) -> Column:
    """A keyed number from the other half."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), label, i.cast("string"), other.cast("string")), 256), 1, 12), 16, 10).cast("decimal(20,0)")


def feistel(a, b, size_a, size_b, key: str, label, back: bool = False) -> Column:
    """Permutation of pairs (a below size_a, b below size_b): halves take turns adding a keyed number of the other."""
    big = "decimal(20,0)"

    def step(s, k):
        i = F.lit(ROUNDS - 1) - k if back else k
        turn = i % 2 == 0
        value, other = F.when(turn, s["a"]).otherwise(s["b"]), F.when(turn, s["b"]).otherwise(s["a"])
        size = F.when(turn, size_a).otherwise(size_b).cast(big)
        moved = _round(key, label, i, other) % size
        new = ((value + size - moved if back else value + moved) % size).cast(big)
        return F.struct(F.when(turn, new).otherwise(s["a"]).alias("a"), F.when(turn, s["b"]).otherwise(new).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast(big).alias("a"), b.cast(big).alias("b")), step)


def _power(n) -> Column:
    return F.rpad(F.lit("1"), (n + 1).cast("int"), "0").cast("decimal(20,0)")


def permuted_digits(digits, key: str, label, back: bool = False) -> Column:
    """A digit string of one length for another, one to one (up to 36 digits)."""
    def one(d):
        half = F.floor((F.length(d) + 1) / 2).cast("int")
        rest = F.length(d) - half
        # The label carries the length, so that each length has a permutation of its own.
        return F.transform(F.array(feistel(
            F.substring(d, F.lit(1), half), F.when(rest > 0, F.substring(d, half + 1, F.length(d))).otherwise("0"), _power(half), _power(rest), key,
            F.concat_ws(":", label, F.length(d).cast("string")), back)), lambda r: F.concat(
                F.lpad(r["a"].cast("string"), half, "0"), F.when(rest > 0, F.lpad(r["b"].cast("string"), rest, "0")).otherwise("")))[0]

    return F.transform(F.array(digits), one)[0]


def _digits_of(text) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _refill(text, digits) -> Column:
    """``text`` with its digits replaced in order by ``digits``."""
    return F.aggregate(F.split(text, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), lambda s, c: F.when(
        c.rlike("^[0-9]$"), F.struct(F.concat(s["out"], F.substring(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(
            F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))), lambda s: s["out"])


def luhn_sum(digits) -> Column:
    """Luhn sum of a digit string, its last digit counted once."""
    return F.aggregate(F.split(F.reverse(digits), ""), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("at")), lambda s, c: F.struct(
        (s["sum"] + F.when(s["at"] % 2 == 0, c.cast("int")).otherwise(F.floor(c.cast("int") * 2 / 10).cast("int") + c.cast("int") * 2 % 10)).cast("int").alias("sum"),
        (s["at"] + 1).alias("at")), lambda s: s["sum"])


def mod97(text) -> Column:
    """Remainder by 97 of letters (A = 10 and on) and digits read as one number."""
    return F.aggregate(F.split(text, ""), F.lit(0), lambda s, c: F.when(c == "", s).when(
        c.rlike("^[0-9]$"), (s * 10 + c.cast("int")) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97).cast("int"))


def _with(value, fn) -> Column:
    """``fn`` of a value that is worked out once."""
    return F.transform(F.array(value), fn)[0]


#: Steps of a walk, taken 32 at a time while it is not done.
CARD_WALK = (64, 32)


def _card_counts(m) -> Column:
    """Numbers of leading digits of the match that may be a card, in the order in which they are tried.

    Sixteen in four groups of four come first, then the whole match, then shorter ones that end at a separator.
    """
    whole = F.length(_digits_of(m))
    fours = F.when(m.rlike(r"^\d{4}(?:[ -]?\d{4}){3}[ -]"), F.lit(16))
    ends = [F.when(m.rlike(rf"^\d(?:[ -]?\d){{{n - 1}}}[ -]"), F.lit(n)) for n in range(18, 12, -1)]
    return F.array_distinct(F.array_compact(F.array(fours, whole, *ends)))


def _card_count(digits, counts) -> Column:
    """The first of ``counts`` whose digits pass the check; null if none does."""
    return F.get(F.filter(counts, lambda n: luhn_sum(F.substring(digits, F.lit(1), n)) % 10 == 0), F.lit(0))


def _card_tail(m) -> Column:
    """What follows the card in the match."""
    def tail(n):
        return F.coalesce(*[F.when(n == k, F.regexp_replace(m, rf"^\d(?:[ -]?\d){{{k - 1}}}", "")) for k in range(13, 20)], F.lit(""))

    return _with(_card_count(_digits_of(m), _card_counts(m)), tail)


def _card(m, key, back) -> Column:
    def checked(b):
        return F.concat(b, ((F.lit(10) - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string"))

    def new(d, counts, n):
        # The step is repeated while another of the counts would be taken for the new digits, so that undoing cuts at the same place.
        rest = F.substring(d, n + 1, F.length(d))

        def step(s, _):
            moved = _with(permuted_digits(F.substring(s["d"], F.lit(1), n - 1), key, F.lit("card"), back), checked)
            return F.when(s["done"], s).otherwise(_with(moved, lambda x: F.struct(
                x.alias("d"), F.coalesce(_card_count(F.concat(x, rest), counts) == n, F.lit(False)).alias("done"))))

        def steps(s, _):
            return F.when(s["done"], s).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(CARD_WALK[1])), s, step))

        # Every second step or so ends the walk, so it always ends here; were it cut, undoing would cut the digits elsewhere.
        start = F.struct(F.substring(d, F.lit(1), n).alias("d"), F.lit(False).alias("done"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(CARD_WALK[0])), start, steps, lambda s: F.when(s["done"], F.concat(s["d"], rest)).otherwise(
            F.raise_error(F.lit("no card number reached")).cast("string")))

    return _with(F.struct(_digits_of(m).alias("d"), _card_counts(m).alias("counts")), lambda c: _with(
        _card_count(c["d"], c["counts"]), lambda n: F.when(n.isNotNull(), _refill(m, new(c["d"], c["counts"], n))).otherwise(m)))


def _iban(m, key, back) -> Column:
    def new(flat):
        country, body = F.substring(flat, 1, 2), F.substring(flat, F.lit(5), F.length(flat))
        digits = permuted_digits(_digits_of(body), key, F.concat(F.lit("iban"), country), back)
        return _with(_refill(body, digits), lambda b: _with(F.lit(98) - mod97(F.concat(b, country, F.lit("00"))), lambda c: _refill(
            m, _digits_of(F.concat(F.lpad(c.cast("string"), 2, "0"), b)))))

    flat = F.replace(m, F.lit(" "), F.lit(""))
    right = mod97(F.concat(F.substring(flat, F.lit(5), F.length(flat)), F.substring(flat, 1, 4))) == 1
    return F.when(right & F.length(_digits_of(flat)).between(10, 36), _with(flat, new)).otherwise(m)


def _date(m, key, back) -> Column:
    iso = m.rlike(r"^\d{4}-")
    mark = F.when(m.contains("/"), F.lit("/")).otherwise(F.lit("."))
    parts = F.split(m, r"[./-]")
    # With slashes the month comes first unless it can't; with dots the day does.
    swap = m.contains("/") & (F.try_element_at(parts, F.lit(1)).cast("int") <= 12)
    month, day = F.when(swap, parts[0]).otherwise(parts[1]), F.when(swap, parts[1]).otherwise(parts[0])
    date = F.when(iso, F.try_to_timestamp(m, F.lit("yyyy-MM-dd"))).otherwise(
        F.try_to_timestamp(F.concat_ws("-", parts[2], F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), F.lit("yyyy-MM-dd"))).cast("date")

    def new(n):
        moved = feistel(F.floor(n / _DAY_PARTS[1]), n % _DAY_PARTS[1], F.lit(_DAY_PARTS[0]), F.lit(_DAY_PARTS[1]), key, F.lit("date"), back)
        return _with(moved, lambda r: _with(F.date_add(F.lit(_FIRST_DAY).cast("date"), (r["a"] * _DAY_PARTS[1] + r["b"]).cast("int")), written))

    def written(d):
        # Day and month keep their order; which is first must not turn on the new month, so two digits each.
        us, eu = F.date_format(d, "MM/dd/yyyy"), F.date_format(d, "dd.MM.yyyy")
        return F.when(iso, F.date_format(d, "yyyy-MM-dd")).when(mark == "/", F.when(swap, us).otherwise(F.date_format(d, "dd/MM/yyyy"))).otherwise(eu)

    number = F.datediff(date, F.lit(_FIRST_DAY).cast("date"))
    return F.when(date.isNotNull() & number.between(0, _DAYS - 1), _with(number, new)).otherwise(m)


def _address(m, key, back) -> Column:
    parts = F.split(m, r"\.")
    valid = F.forall(parts, lambda p: p.cast("int") <= 255)
    moved = feistel(parts[0].cast("int") * 256 + parts[1].cast("int"), parts[2].cast("int") * 256 + parts[3].cast("int"),
                    F.lit(65_536), F.lit(65_536), key, F.lit("address"), back)
    return F.when(valid, _with(moved, lambda r: F.concat_ws(".", *[x.cast("int").cast("string") for h in ("a", "b") for x in (F.floor(r[h] / 256), r[h] % 256)]))).otherwise(m)


def _plain(label: str):
    return lambda m, key, back: _with(_digits_of(m), lambda d: _refill(m, permuted_digits(d, key, F.lit(label), back)))


def _ssn(m, key, back) -> Column:
    """Area 001 to 899 without 666, group from 01, serial from 0001; valid numbers go to valid ones."""
    parts = F.transform(F.split(m, "-"), lambda p: p.cast("int"))
    area, group, serial = parts[0], parts[1], parts[2]
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    moved = feistel(F.when(area > 666, area - 2).otherwise(area - 1), (group - 1) * 9_999 + serial - 1, F.lit(898), F.lit(99 * 9_999), key, F.lit("ssn"), back)

    def written(r):
        new = F.when(r["a"] >= 665, r["a"] + 2).otherwise(r["a"] + 1), F.floor(r["b"] / 9_999) + 1, r["b"] % 9_999 + 1
        return F.concat_ws("-", *[F.lpad(v.cast("int").cast("string"), n, "0") for v, n in zip(new, (3, 2, 4), strict=True)])

    return F.when(valid, _with(moved, written)).otherwise(m)


def _phone(m, key, back) -> Column:
    """The country code stays; the other digits are permuted."""
    code = F.regexp_extract(m, r"^\+\d{1,3}(?=[ .(-])", 0)
    rest = F.substring(m, F.length(code) + 1, F.length(m))
    return F.concat(code, _plain("phone")(rest, key, back))


_ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"


def _email(m, key, back) -> Column:
    """Letters and digits of the local part move together, each inside its own alphabet, in two keyed half-rounds a round."""
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    half = F.floor((F.length(local) + 1) / 2).cast("int")

    def shifted(text, other, i):
        def one(c, at):
            n = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), i.cast("string"), at.cast("string"), F.length(local).cast("string"), other), 256), 1, 8), 16, 10).cast("bigint")
            low, base = F.lower(c), F.when(c.rlike("[0-9]"), F.lit(10)).otherwise(26)
            zero = F.when(c.rlike("[0-9]"), F.lit(48)).when(c.rlike("[A-Z]"), F.lit(65)).otherwise(97)
            step = n % base
            return F.when(c.rlike("[A-Za-z0-9]"), F.char(zero + (F.ascii(c) - zero + (base - step if back else step)) % base)).otherwise(c)

        return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), "")

    def step(s, k):
        i = F.lit(5) - k if back else k
        turn = i % 2 == 0
        return F.struct(F.when(turn, shifted(s["a"], s["b"], i)).otherwise(s["a"]).alias("a"), F.when(turn, s["b"]).otherwise(shifted(s["b"], s["a"], i)).alias("b"))

    moved = F.aggregate(F.sequence(F.lit(0), F.lit(5)), F.struct(F.substring(local, F.lit(1), half).alias("a"), F.substring(local, half + 1, F.length(local)).alias("b")), step)
    return _with(moved, lambda r: F.concat(r["a"], r["b"], F.lit("@"), domain))


_MOVERS = {"email": _email, "iban": _iban, "date": _date, "address": _address, "ssn": _ssn, "phone": _phone, "card": _card}


def kind_of(m) -> Column:
    """The first kind that the whole match fits."""
    out = F.when(m.rlike(f"^(?:{KINDS[0][1]})$"), F.lit(KINDS[0][0]))
    for name, pattern in KINDS[1:]:
        out = out.when(m.rlike(f"^(?:{pattern})$"), F.lit(name))
    return out


def pseudonym(m, key: str, back: bool = False) -> Column:
    """The match in its format under the key; ``back`` undoes it."""
    def by_kind(kind):
        out = None
        for name, _ in KINDS:
            moved = _MOVERS[name](m, key, back)
            out = F.when(kind == name, moved) if out is None else out.when(kind == name, moved)
        return F.coalesce(out.otherwise(m), m)

    return _with(kind_of(m), by_kind)


def protect(docs: DataFrame, key: str, back: bool = False) -> DataFrame:
    """All columns of ``docs`` with ``text`` made pseudonymous, and ``found``: an array of (kind, pseudonym).

    Documents without a match are passed on untouched; ``found`` comes last and is renamed
    when the table has such a column.
    """
    text = F.when(docs["text"].rlike("[0-9@]"), docs["text"])  # no kind matches without
    rows = wrapped(docs, matches=F.regexp_extract_all(text, F.lit(PATTERN), 0), pieces=F.split(text, PATTERN, -1))
    def cut(m, kind):
        """The new value without what only follows it in the match."""
        tail = F.when(kind == "card", _card_tail(m)).otherwise("")
        return _with(F.struct(pseudonym(m, key, back).alias("all"), tail.alias("tail")), lambda p: F.struct(
            kind.alias("kind"), F.substring(p["all"], F.lit(1), F.length(p["all"]) - F.length(p["tail"])).alias("value"), p["tail"].alias("tail"), (p["all"] != m).alias("moved")))

    new = F.transform("matches", lambda m: _with(kind_of(m), lambda kind: cut(m, kind)))
    rows = rows.select("row", "pieces", new.alias("new"))
    joined = F.concat(F.col("pieces")[0], F.array_join(F.zip_with("new", F.slice("pieces", F.lit(2), F.size("pieces")), lambda a, b: F.concat(a["value"], a["tail"], b)), ""))
    out = F.when(F.size("new") > 0, joined).otherwise(F.col("row.text"))
    found = F.transform(F.filter(F.coalesce("new", F.array()), lambda a: a["moved"]), lambda a: F.struct(a["kind"], a["value"]))
    name = "found"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return rows.select(*[out.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns], found.alias(name))
