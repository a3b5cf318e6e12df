"""Free-form dates as one column expression.

A text is read in three steps: the clock is taken out by pattern, what is left is cut into
tokens, and the classes of the tokens (month name, year, other number) decide what each
means. Every token has to be used, so a text with anything else in it is no date.

Which number is what:

* a number of more than two digits or above 31 is a year where it can be one;
* with a month name, the numbers around it are day, then year, unless the first one is the year;
* three numbers are year-month-day if the first is a year, day-month-year if the first is
  above 12, and else month-day-year: **where day and month could change places the month
  comes first**;
* two numbers are year and month in either order, or month and day; one is a year or a day;
* years of two digits lie within fifty years of the default.

Eight, twelve and fourteen digits are a date with its clock; six digits are three numbers.
What a text leaves out is taken from ``default`` (a day beyond the end of the month
becomes its last day); the clock starts at midnight. Names of weekdays are passed over.
Zones and offsets are read and dropped: the clock stays as written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Words of dates.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MONTH_NAMES = ("jan(uary)?|feb(ruary)?|mar(ch)?|apr(il)?|may|june?|july?|aug(ust)?|sep(t(ember)?)?|oct(ober)?"
               "|nov(ember)?|dec(ember)?")
WEEKDAYS = "mon(day)?|tue(s|sday)?|wed(nesday)?|thu(r|rs|rsday)?|fri(day)?|sat(urday)?|sun(day)?"
FILLERS = "at|on|and|ad|of"

_HALF = r"(?i:\s*(?<half>[ap])\.?(?:m\.?)?(?![a-z]))"
_ZONE = (rf"(?:\s*(?!(?i:{MONTH_NAMES})\b)(?:[Zz]|[A-Z]{{3,5}})(?![A-Za-z]))?(?:\s*[+-]\d{{2}}(?::?\d{{2}})?(?!\d))?"
         r"(?:\s*\([A-Z]{3,5}\))?")
_CLOCKS = (
    rf"(?<![\d.:])(?<h>\d{{1,2}}):(?<m>\d{{1,2}})(?::(?<s>\d{{1,2}})(?:[.,](?<f>\d{{1,9}}))?)?{_HALF}?(?![\d:]){_ZONE}",
    r"(?i:(?<![\d.:])(?<h>\d{1,2})\s*h(?:ours?)?(?![a-z])(?:\s*(?<m>\d{1,2})\s*m(?:inutes?)?(?![a-z]))?"
    r"(?:\s*(?<s>\d{1,2})(?:[.,](?<f>\d{1,9}))?\s*s(?:econds?)?(?![a-z]))?)",
    rf"(?<![\d.:/-])(?<h>\d{{1,2}}){_HALF}{_ZONE}",
)
_FIELDS = ("h", "m", "s", "f", "half")
_WORD = "[0-9]+|[a-z]+"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _number(text: Column) -> Column:
    return text.try_cast("int")


def _clock(text: Column) -> Column:
    """(h, m, s, rest): the clock of a text, null without one, and the text around it."""
    found = F.lit(None)
    for pattern in reversed(_CLOCKS):
        # One pass: the fields, each behind the other, then the text around the first clock.
        groups = "".join("${%s}\1" % f if f"<{f}>" in pattern else "\1" for f in _FIELDS)
        cut = F.regexp_replace(text, f"(?s)^(?<before>.*?){pattern}(?<after>.*)$", groups + "${before} ${after}")

        def around(parts: Column) -> Column:
            hour, minute, second, fraction, half, rest = [F.get(parts, F.lit(k)) for k in range(6)]
            h = _number(hour)
            h = (F.when(half == "", h).when(h > 12, -1)
                 .otherwise(h % 12 + F.when(F.lower(half) == "p", 12).otherwise(0)))
            s = F.concat(F.when(second == "", "0").otherwise(second), F.lit("."), F.rpad(fraction, 6, "0"))
            return F.struct(h.alias("h"), F.coalesce(_number(minute), F.lit(0)).alias("m"),
                            s.try_cast("decimal(16,6)").alias("s"), F.lower(rest).alias("rest"))

        found = F.when(text.rlike(pattern), _let(F.split(cut, "\1", 6), around)).otherwise(found)
    none = F.struct(F.lit(None).cast("int").alias("h"), F.lit(None).cast("int").alias("m"),
                    F.lit(None).cast("decimal(16,6)").alias("s"), F.lower(text).alias("rest"))
    return F.coalesce(found, none)


def _token(word: Column) -> Column:
    """(n, name, year, full): a token's number, whether it names a month, can only be a year, is a year with its century."""
    n = _number(word)
    named = word.rlike(f"^({MONTH_NAMES})$")
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.substring(word, 1, 3)).cast("int")
    full = ~named & (F.length(word) > 2)
    return F.struct(F.when(named, month).otherwise(n).alias("n"), named.alias("name"),
                    (full | (~named & (n > 31))).alias("year"), full.alias("full"))


def _order(day: Column) -> Column:
    """What the date tokens mean: one letter of y, m, d for each; null when they fit nothing."""
    count, name = F.size(day), F.array_position(F.transform(day, lambda t: t["name"]), F.lit(True))

    def is_year(k: int) -> Column:
        return F.get(day, F.lit(k))["year"]

    three = (F.when(name == 1, F.when(is_year(1), "myd").otherwise("mdy"))
             .when(name == 2, F.when(is_year(0), "ymd").otherwise("dmy"))
             .when(name == 3, F.when(is_year(1), "dym").otherwise("ydm"))
             .when(is_year(0), "ymd").when(F.get(day, F.lit(0))["n"] > 12, "dmy").otherwise("mdy"))
    two = (F.when(name == 1, F.when(is_year(1), "my").otherwise("md"))
           .when(name == 2, F.when(is_year(0), "ym").otherwise("dm"))
           .when(is_year(0), "ym").when(is_year(1), "my").otherwise("md"))
    one = F.when(name == 1, "m").when(is_year(0), "y").otherwise("d")
    names = F.size(F.filter(day, lambda t: t["name"]))
    return F.when(names > 1, None).when(count == 3, three).when(count == 2, two).when(count == 1, one).when(count == 0, "")


def _built(day: Column, clock: Column, default: Column) -> Column:
    """The timestamp of date tokens and a clock; null when they make none."""

    def part(letter: str, order: Column) -> Column:
        return F.get(day, F.locate(letter, order) - 1)["n"]

    def build(order: Column) -> Column:
        written, this = part("y", order), F.year(default)
        near = written + F.floor(this / 100).cast("int") * 100
        near = F.when(near >= this + 50, near - 100).when(near < this - 50, near + 100).otherwise(near)
        full = F.exists(day, lambda t: t["full"])
        year = F.coalesce(F.when(full, written).otherwise(near), this)
        month = F.coalesce(part("m", order), F.month(default))
        zero = F.lit(0)
        last = F.dayofmonth(F.last_day(F.try_make_timestamp_ntz(year, month, F.lit(1), zero, zero, zero).cast("date")))
        date = F.coalesce(part("d", order), F.least(F.dayofmonth(default), last))
        h, m, s = [F.coalesce(clock[c], F.lit(0)) for c in "hms"]
        sound = order.isNotNull() & h.between(0, 23) & (m < 60) & (s < 60) & ((order != "") | clock["h"].isNotNull())
        return F.when(sound, F.try_make_timestamp_ntz(year, month, date, h, m, s.cast("decimal(16,6)")))

    return _let(_order(day), build)


def free_date(text: Column, default: Column | None = None) -> Column:
    """The timestamp written in ``text`` in any layout the rules above read; null for other texts.

    ``default`` is the date that fills in what a text leaves out, today if not given.
    """
    today = F.current_date() if default is None else default

    def from_words(clock: Column) -> Callable[[Column], Column]:
        def build(words: Column) -> Column:
            tokens = F.transform(words, _token)
            # Past three date tokens, two, four or six digits are a clock.
            late, extra = F.size(words) == 4, F.get(words, F.lit(3))
            digits = late & extra.rlike("^([0-9]{2}){1,3}$") & clock["h"].isNull()

            def pair(at: int) -> Column:
                return F.coalesce(_number(F.substring(extra, at, 2)), F.lit(0))

            spare = F.struct(pair(1).alias("h"), pair(3).alias("m"), pair(5).cast("decimal(16,6)").alias("s"))
            plain = F.struct(clock["h"].alias("h"), clock["m"].alias("m"), clock["s"].alias("s"))
            known = F.forall(tokens, lambda t: t["n"].isNotNull()) & ((F.size(words) <= 3) | digits)
            return F.when(known, _let(F.slice(tokens, 1, 3), lambda day: _let(
                F.when(digits, spare).otherwise(plain), lambda at: _built(day, at, today))))

        return build

    def read(clock: Column) -> Column:
        rest = F.regexp_replace(clock["rest"], r"(?<![0-9])([0-9]{4})([0-9]{2})([0-9]{2})(?:t?([0-9]{4}|[0-9]{6}))?(?![0-9])", "$1 $2 $3 $4 ")
        rest = F.regexp_replace(rest, r"^([^a-z0-9]*)([0-9]{2})([0-9]{2})([0-9]{2})(?![0-9])", "$1$2 $3 $4 ")
        words = F.filter(F.regexp_extract_all(rest, F.lit(f"({_WORD})")), lambda w: ~w.isin("t", "m"))
        strange = F.regexp_replace(clock["rest"], rf"{_WORD}|[\s.,;/'-]", "") != ""
        return F.when(~strange, _let(words, from_words(clock)))

    cleaned = F.regexp_replace(text, rf"(?i)\b({WEEKDAYS})\b\.?", " ")
    cleaned = F.regexp_replace(cleaned, r"(?i)(?<=[0-9])(st|nd|rd|th)\b", " ")
    cleaned = F.regexp_replace(cleaned, rf"(?i)\b({FILLERS})\b", " ")
    return _let(_let(cleaned, _clock), read)
