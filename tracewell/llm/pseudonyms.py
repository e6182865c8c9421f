"""Personal data under format-preserving Feistel pseudonyms, in DataFrame functions only.

A text is split at everything that looks like personal data; each match that passes the check of its kind is replaced by
a value of the same form, and the parts are joined again:

* payment cards (13-19 digits, Luhn; in groups of four, 4-6-5, 4-6-4 or 4-4-4-4-3): all digits but the last are permuted,
  the last one is the new check digit;
* social security numbers, phone numbers (international, North American, and national ones of France, Germany, Spain and
  Britain): digits are permuted, signs and country code stay;
* IPv4 addresses (four numbers up to 255): permuted among all addresses;
* dates from 1900 to 2099 that exist (year, day or month first, one or two digits): permuted among the days of these
  years. Day first goes before month first; dates that can only be month first are permuted among themselves;
* e-mail addresses and hexadecimal secrets have no number format; they become keyed digests of the same form.

The permutation works on pairs (x, y) with x < a and y < b: in turn x += f(y) modulo a and y += f(x) modulo b, where f is
a keyed SHA-256 of round, kind and half. Each step can be undone, so different values have different pseudonyms; equal
values have equal ones in every document, and one who has the key can go back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.tables import quoted

KEY = "tracewell"
ROUNDS = 8

_EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
_SECRET = r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,64}(?![0-9A-Za-z])"
_ABROAD = r"(?<![\d+])(?:\+[2-9]\d{0,2}[ .-]?|00[2-9]\d{0,2}[ .-])(?:\(0\)[ .-]?)?"
_PHONE = (
    r"(?<![\d+])(?:\+1[ .-]?|001[ .-])(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
    r"|(?<!\d)(?:1[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)"
    rf"|{_ABROAD}\d{{1,3}}(?:[ .-]\d{{2}}){{3,4}}(?!\d)|{_ABROAD}\(?\d{{1,4}}\)?(?:[ .-]?\d{{2,4}}){{2,3}}(?!\d)"
)
# Without a country code: signs between the groups are alike, and no form has more than 15 digits.
_NATIONAL = (
    r"(?<![0-9A-Za-z])(?<![0-9][.,/-])(?:(?:1-)?\d{3}-\d{3}-\d{4}|(?:1\.)?\d{3}\.\d{3}\.\d{4}|(?:1 )?\d{3} \d{3} \d{4}"
    r"|0[1-9](?:(?: \d{2}){4}|(?:\.\d{2}){4}|(?:-\d{2}){4}|\d{8})"
    r"|0[1-9]\d{1,3}(?: ?/ ?|[ -])\d{2}(?: \d{2}){2,3}|0[1-9]\d{1,4}(?: ?/ ?|[ -])\d{3,4}[ -]\d{3,5}(?! \d{4} \d{4})"
    r"|0[1-9]\d{1,4}(?: ?/ ?|[ -])\d{4,8}|[6-9]\d{2}(?:(?: \d{2}){3}|(?:-\d{2}){3}|(?:\.\d{2}){3})|9\d \d{3} \d{2} \d{2})"
    r"(?![0-9A-Za-z]|[.,/-]\d)"
)
_DATE = (
    r"(?<!\d)(?<!\d[./-])(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4}"
    r"|\d{1,2}-\d{1,2}-\d{4})(?![./-]?\d)"
)
_ADDRESS = r"(?<!\d)(?<!\d\.)\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"
_SOCIAL = r"(?<!\d)(?<!\d-)\d{3}-\d{2}-\d{4}(?!-?\d)"
_CARD = (
    r"(?<!\d)(?:\d{4}[ -]\d{6}[ -]\d{4,5}(?!\d|[ -]\d{4})|(?:\d{4}[ -]){4}\d{3}(?!\d|[./-]\d| \d{3}[ .-]\d{4})"
    r"|\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}(?!\d))"
)
# Of the kinds that may begin at one place the first one wins.
_NUMBER = "|".join([_PHONE, _DATE, _ADDRESS, _SOCIAL, _CARD, _NATIONAL])
_ANY = rf"{_EMAIL}|{_SECRET}|(?=[\d+(])(?:{_NUMBER})"

_FIRST_DAY = "1900-01-01"
# Days from 1900 to 2099 are 319 * 229.
_DAYS = (319, 229)
# Three days of five are no month; a walk of this many steps fails once in 10^25.
_WALK = 64


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _keyed(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *parts), 256)


def permuted(value: Column, a: Column, b: Column, kind: Column, key: str) -> Column:
    """The number below a * b in place of ``value``."""

    def mask(turn: Column, half: Column) -> Column:
        return F.conv(F.substring(_keyed(key, kind, turn.cast("string"), half.cast("string")), 1, 15), 16, 10).cast("long")

    def step(state: Column, turn: Column) -> Column:
        x = (state["x"] + mask(turn, state["y"])) % a
        return _let(x, lambda x: F.struct(x.alias("x"), ((state["y"] + mask(turn + ROUNDS, x)) % b).alias("y")))

    start = F.struct(F.floor(value / b).cast("long").alias("x"), (value % b).alias("y"))
    turns = F.sequence(F.lit(1), F.lit(ROUNDS // 2))
    return F.aggregate(turns, start, step, lambda s: s["x"] * b + s["y"])


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def permuted_digits(digits: Column, kind: str, key: str) -> Column:
    """As many digits in place of a string of up to 18 digits."""
    size = F.length(digits)
    halves = _let(
        size, lambda n: F.struct(_power(F.floor(n / 2).cast("int")).alias("a"), _power((n - F.floor(n / 2)).cast("int")).alias("b"))
    )
    number = _let(
        halves, lambda h: permuted(digits.cast("long"), h["a"], h["b"], F.concat(F.lit(kind), size.cast("string")), key)
    )
    return F.lpad(number.cast("string"), size, "0")


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The Luhn sum of digits, of which the last one counts once."""
    listed = F.reverse(F.filter(F.split(digits, ""), lambda x: x != ""))
    doubled = F.transform(
        listed, lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0))
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)


def _laid_out(match: Column, digits: Column) -> Column:
    """``match`` with its digits replaced one by one."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("next"))

    def step(state: Column, sign: Column) -> Column:
        digit = sign.rlike("^[0-9]$")
        return F.struct(
            F.concat(state["out"], F.when(digit, F.substring(digits, state["next"], F.lit(1))).otherwise(sign)).alias("out"),
            (state["next"] + F.when(digit, 1).otherwise(0)).alias("next"),
        )

    return F.aggregate(F.split(match, ""), start, step, lambda s: s["out"])


def _card(match: Column, key: str) -> Column:
    digits = _digits(match)
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)

    def checked(new: Column) -> Column:
        return _laid_out(match, F.concat(new, ((10 - luhn(F.concat(new, F.lit("0"))) % 10) % 10).cast("string")))

    fine = (F.length(digits).between(13, 19)) & (luhn(digits) % 10 == 0)
    return F.when(fine, _let(permuted_digits(body, "card", key), checked)).otherwise(match)


def _cards(match: Column, key: str) -> Column:
    """A card; of four groups of four and three digits that are none together, the four may be one."""
    parted = match.rlike(r"^(?:\d{4}[ -]){4}\d{3}$") & (luhn(_digits(match)) % 10 != 0)
    four, rest = F.substring(match, 1, 19), F.substring(match, 20, 4)
    return F.when(parted, F.concat(_card(four, key), rest)).otherwise(_card(match, key))


def _phone(match: Column, key: str) -> Column:
    country = F.regexp_extract(match, r"^(\+\d{1,3}(?=[ .(-])|\+1|00\d{1,3}(?=[ .-])|1(?=[ .-]?\(|[ .-]\d{3}[ .-])|)", 1)
    rest = F.substring(match, F.length(country) + 1, F.length(match))
    fine = F.length(_digits(match)).between(9, 15)
    return F.when(fine, F.concat(country, _laid_out(rest, permuted_digits(_digits(rest), "phone", key)))).otherwise(match)


def _social(match: Column, key: str) -> Column:
    fine = ~match.rlike("^(000|666|9)|-00-|0000$")
    return F.when(fine, _laid_out(match, permuted_digits(_digits(match), "social", key))).otherwise(match)


def _address(match: Column, key: str) -> Column:
    parts = F.transform(F.split(match, r"\."), lambda x: x.cast("long"))
    fine = F.forall(parts, lambda x: x < 256)
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 256 + x)
    half = F.lit(65536).cast("long")

    def dotted(n: Column) -> Column:
        return F.concat_ws(".", *[(F.shiftright(n, s) % 256).cast("string") for s in (24, 16, 8, 0)])

    return F.when(fine, _let(permuted(number, half, half, F.lit("address"), key), dotted)).otherwise(match)


def _date(match: Column, key: str) -> Column:
    parts = F.split(match, "[./-]")
    sign = F.regexp_extract(match, "[./-]", 0)
    year_first = F.length(parts[0]) == 4
    short = match.rlike(r"(?:^|\D)\d(?:\D|$)")

    def day_of(year: Column, month: Column, day: Column) -> Column:
        iso = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
        number = F.date_diff(iso.try_cast("date"), F.lit(_FIRST_DAY).cast("date")).cast("long")
        return F.when(number.between(0, _DAYS[0] * _DAYS[1] - 1), number)

    usual = F.when(year_first, day_of(parts[0], parts[1], parts[2])).otherwise(day_of(parts[2], parts[1], parts[0]))
    month_first = F.when(~year_first, day_of(parts[2], parts[0], parts[1]))
    a, b = (F.lit(n).cast("long") for n in _DAYS)

    def date(number: Column) -> Column:
        return F.date_add(F.lit(_FIRST_DAY).cast("date"), number.cast("int"))

    def written(number: Column, forms: dict[str, Column]) -> Column:
        new, out = date(number), F.lit(None).cast("string")
        for form, applies in forms.items():
            out = F.when(applies & short, F.date_format(new, form.replace("MM", "M").replace("dd", "d"))).when(
                applies & ~short, F.date_format(new, form)
            ).otherwise(out)
        return F.call_function("translate", out, F.lit("-"), sign)

    def walked(number: Column) -> Column:
        """Permuted until the day cannot be a month, so that no date of the other order is met."""
        start = F.struct(number.alias("n"), F.lit(False).alias("done"))

        def step(state: Column, _: Column) -> Column:
            def turn(n: Column) -> Column:
                return F.struct(n.alias("n"), (F.dayofmonth(date(n)) > 12).alias("done"))

            return F.when(state["done"], state).otherwise(_let(permuted(state["n"], a, b, F.lit("date"), key), turn))

        return F.aggregate(F.sequence(F.lit(1), F.lit(_WALK)), start, step, lambda s: s["n"])

    plain = _let(
        usual, lambda d: _let(permuted(d, a, b, F.lit("date"), key), lambda n: written(n, {"yyyy-MM-dd": year_first, "dd-MM-yyyy": ~year_first}))
    )
    turned = _let(month_first, lambda d: _let(walked(d), lambda n: written(n, {"MM-dd-yyyy": F.lit(True)})))
    return F.when(usual.isNotNull(), plain).when(month_first.isNotNull(), turned).otherwise(match)


def pseudonym(match: Column, key: str = KEY) -> Column:
    """What stands in place of a match; the match itself if it fails the check of its kind."""

    def whole(pattern: str) -> Column:
        return match.rlike(f"^(?:{pattern})$")

    email = F.concat(F.lit("user."), F.substring(_keyed(key, F.lit("mail"), F.lower(match)), 1, 16), F.lit("@mail.example"))
    digest = F.substring(_keyed(key, F.lit("secret"), F.lower(match)), F.lit(1), F.length(match))
    secret = F.when(match.rlike("[A-F]") & ~match.rlike("[a-f]"), F.upper(digest)).otherwise(digest)
    return (
        F.when(match.contains("@"), email)
        .when(whole(_SECRET), secret)
        .when(whole(_PHONE), _phone(match, key))
        .when(whole(_DATE), _date(match, key))
        .when(whole(_ADDRESS), _address(match, key))
        .when(whole(_SOCIAL), _social(match, key))
        .when(whole(_CARD), _cards(match, key))
        .otherwise(_phone(match, key))
    )


def protect(docs: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """``docs`` with personal data of ``text`` replaced, and n_replaced, the number of values that were.

    Null stays null with 0 replaced; all else of a text stays as it is, character by character. A column n_replaced of
    ``docs``, in whatever case, is replaced; all others may have any name. Repeated rows are treated alike, whole texts are searched, an empty table stays empty.
    """
    names = [c for c in docs.columns if c.lower() != "n_replaced"]
    # The document travels as one column, so no name of it meets a name of ours.
    whole = F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(names)]).alias("document")
    rows = docs.select(whole, quoted(text).alias("text"), F.regexp_extract_all(quoted(text), F.lit(_ANY), F.lit(0)).alias("found"))
    rows = rows.withColumn("new", F.when(F.size("found") > 0, F.transform("found", lambda m: pseudonym(m, key))))
    parts = F.split("text", _ANY, -1)
    joined = F.array_join(F.flatten(F.zip_with(parts, "new", lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    changed = F.size(F.filter(F.zip_with("found", "new", lambda a, b: a != b), lambda x: x))
    cleaned = F.when(F.col("new").isNull(), F.col("text")).otherwise(joined)
    return rows.select(
        *[(cleaned if c.lower() == text.lower() else F.col(f"document.c{i}")).alias(c) for i, c in enumerate(names)],
        F.when(F.col("new").isNull(), F.lit(0)).otherwise(changed).cast("long").alias("n_replaced"),
    )
