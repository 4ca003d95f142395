"""Personal data replaced by format-preserving pseudonyms, in DataFrame functions only.

What looks like a number or date of a person is first validated (card checksums, account
check digits, number plans, calendar dates). Its value is then a point (x, y) of a grid
that holds exactly the valid values of its format, and a Feistel network permutes the
grid: in turn x and y are shifted by a keyed hash of the other. So a pseudonym is valid
in the same format, two values never share one, and equal values keep the same one in
every document. Everything happens inside the row: no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orelode.functions.text import once as let

ROUNDS = 8

# First and last day of the dates that count as valid, and the sides of a grid of as many cells.
FIRST_DAY, LAST_DAY = "1900-01-01", "2099-12-31"
DAYS_X, DAYS_Y = 319, 229

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"
SECRET = (r"(?i)(?<![a-z0-9])(?:token|password|passwd|pwd|secret|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}"
          r"[\"']?[A-Za-z0-9_\-]{8,}")
IP = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])"
YMD = r"[0-9]{4}([-/.])[0-9]{1,2}\{back}[0-9]{1,2}(?![0-9])"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![-0-9])"
CARD = r"(?:[0-9]{4}([ -])[0-9]{4}\{back}[0-9]{4}\{back}[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})(?![0-9])"
DMY = r"[0-9]{1,2}([-/.])[0-9]{1,2}\{back}[0-9]{4}(?![0-9])"
IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])"
PLAN = r"(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
PHONE = r"\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,4}\)?){2,5}(?![0-9])"


def _numbers() -> str:
    """One pattern for all numbers and dates; its groups only serve to repeat a separator."""
    out, group = [], 0
    for form in (IP, YMD, SSN, PLAN, DMY, CARD, PHONE, f"(?<![A-Z]){IBAN}"):
        if "{back}" in form:
            group += 1
            form = form.replace("{back}", str(group))
        out.append(form)
    return rf"(?<![0-9])(?<![0-9][.])(?:{'|'.join(out)})"


NUMBERS = _numbers()


def is_form(value: Column, form: str) -> Column:
    return F.regexp_like(value, F.lit(f"^(?:{form.replace('{back}', '1')})$"))


def power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def permute(x: Column, y: Column, sides: tuple[Column, Column], kind: str, key: str) -> Column:
    """``struct<x, y>``: the cell that takes the place of (x, y) in a grid with these sides."""
    a, b = (s.cast("long") for s in sides)

    def shift(i: Column, other: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), a.cast("string"),
                                    other.cast("string")), 256)
        return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")

    def turn(at: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, F.struct(((at["x"] + shift(i, at["y"])) % a).alias("x"), at["y"].alias("y"))).otherwise(
            F.struct(at["x"].alias("x"), ((at["y"] + shift(i, at["x"])) % b).alias("y")))

    rounds = F.array(*(F.lit(i) for i in range(ROUNDS)))
    return F.aggregate(rounds, F.struct(x.cast("long").alias("x"), y.cast("long").alias("y")), turn)


def permute_digits(digits: Column, kind: str, key: str) -> Column:
    """A digit string of 2 to 34 digits, permuted among those of its length."""
    n = F.length(digits)
    left = F.floor(n / 2).cast("int")
    right = n - left
    moved = permute(F.left(digits, left).cast("long"), F.right(digits, right).cast("long"),
                    (power(left), power(right)), kind, key)
    return let(moved, lambda at: F.concat(F.lpad(at["x"].cast("string"), left, "0"),
                                          F.lpad(at["y"].cast("string"), right, "0")))


def refill(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced in turn by ``digits``."""

    def put(at: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        return F.struct(
            F.concat(at["out"], F.when(digit, F.substr(digits, at["n"], F.lit(1))).otherwise(c)).alias("out"),
            (at["n"] + digit.cast("int")).alias("n"))

    return F.aggregate(F.split(form, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("n")), put)["out"]


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Checksum of a digit string: every second digit from the right doubled, modulo 10."""

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        doubled = d * 2 - F.when(d > 4, 9).otherwise(0)
        return (acc + F.when(i % 2 == 1, doubled).otherwise(d)) % 10

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def card(value: Column, key: str) -> Column:
    """A card number: the first digit stays, the others are permuted, the check digit is worked out anew."""

    def changed(d: Column) -> Column:
        body = F.concat(F.left(d, F.lit(1)), permute_digits(F.substr(d, F.lit(2), F.length(d) - 2), "card", key))
        return let(body, lambda p: refill(
            value, F.concat(p, ((10 - luhn(F.concat(p, F.lit("0")))) % 10).cast("string"))))

    return let(digits_of(value), lambda d: F.when(luhn(d) == 0, changed(d)).otherwise(value))


def _mod97(text: Column) -> Column:
    def add(acc: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise(
            (acc * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def iban(value: Column, key: str) -> Column:
    """An account number: its digits after the check digits are permuted, letters stay, check digits anew."""

    def changed(compact: Column) -> Column:
        country, body = F.left(compact, F.lit(2)), F.substring(compact, 5, 40)
        moved = refill(body, permute_digits(digits_of(body), "iban", key))
        return let(moved, lambda b: refill(value, F.concat(
            F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), digits_of(b))))

    return let(F.regexp_replace(value, " ", ""), lambda c: F.when(
        (_mod97(F.concat(F.substring(c, 5, 40), F.left(c, F.lit(4)))) == 1)
        & (F.length(digits_of(c)) >= 6), changed(c)).otherwise(value))


def ip(value: Column, key: str) -> Column:
    """An address of four octets up to 255."""

    def changed(o: Column) -> Column:
        moved = permute(o[0] * 256 + o[1], o[2] * 256 + o[3], (F.lit(65_536), F.lit(65_536)), "ip", key)
        return let(moved, lambda at: F.concat_ws(
            ".", *(x.cast("string") for side in (at["x"], at["y"]) for x in (F.floor(side / 256), side % 256))))

    octets = F.transform(F.split(value, r"\."), lambda x: x.cast("long"))
    return let(octets, lambda o: F.when(F.forall(o, lambda x: x < 256), changed(o)).otherwise(value))


def ssn(value: Column, key: str) -> Column:
    """A social security number: areas 001 to 899 but 666, groups from 01, serials from 0001."""

    def changed(p: Column) -> Column:
        area = p[0] - 1 - (p[0] > 666).cast("long")
        moved = permute(area, (p[1] - 1) * 9999 + p[2] - 1, (F.lit(898), F.lit(99 * 9999)), "ssn", key)
        return let(moved, lambda at: F.format_string(
            "%03d-%02d-%04d", at["x"] + 1 + (at["x"] >= 665).cast("long"),
            F.floor(at["y"] / 9999).cast("long") + 1, at["y"] % 9999 + 1))

    parts = F.transform(F.split(value, "-"), lambda x: x.cast("long"))
    return let(parts, lambda p: F.when(
        p[0].between(1, 899) & (p[0] != 666) & (p[1] > 0) & (p[2] > 0), changed(p)).otherwise(value))


def plan_phone(value: Column, key: str) -> Column:
    """A number written as in the North American plan; the country code stays.

    Numbers that can be dialled, with area and exchange from 200, are permuted among
    themselves. Others are written like a person's number all the same, and are permuted
    among those with an area below 200, or with only an exchange below.
    """

    def moved(d: Column, area: tuple[int, int], exchange: tuple[int, int]) -> Column:
        last = F.right(d, F.lit(10))
        x = F.left(last, F.lit(3)).cast("long") - area[0]
        y = F.right(last, F.lit(7)).cast("long") - exchange[0] * 10_000
        sides = (F.lit(area[1] - area[0]), F.lit((exchange[1] - exchange[0]) * 10_000))
        number = let(permute(x, y, sides, "phone", key), lambda at: F.format_string(
            "%03d%07d", at["x"] + area[0], at["y"] + exchange[0] * 10_000))
        return refill(value, F.concat(F.left(d, F.length(d) - 10), number))

    def changed(d: Column) -> Column:
        area, exchange = F.substr(d, F.length(d) - 9, F.lit(3)).cast("int"), F.substr(d, F.length(d) - 6, F.lit(3)).cast("int")
        return F.when(area < 200, moved(d, (0, 200), (0, 1000))).when(
            exchange < 200, moved(d, (200, 1000), (0, 200))).otherwise(moved(d, (200, 1000), (200, 1000)))

    return let(digits_of(value), changed)


def phone(value: Column, key: str) -> Column:
    """Any other international number of 8 to 15 digits: those after the first two are permuted."""
    return let(digits_of(value), lambda d: F.when(
        F.length(d).between(8, 15), refill(value, F.concat(
            F.left(d, F.lit(2)), permute_digits(F.substring(d, 3, 13), "number", key)))).otherwise(value))


def date(value: Column, year_first: bool, key: str) -> Column:
    """A calendar date with its order and separators; two-digit days and months stay two digits wide.

    Where the year is last, the day is read first if that is a date, else the month.
    """
    separator = F.regexp_extract(value, "[-/.]", 0)

    def day_number(order: tuple[int, int, int], p: Column) -> Column:
        text = F.concat_ws("-", *(p[i] for i in order))
        return F.datediff(F.try_to_timestamp(text, F.lit("yyyy-M-d")).cast("date"), F.lit(FIRST_DAY).cast("date"))

    def changed(n: Column, order: tuple[int, int, int], p: Column) -> Column:
        moved = permute(F.floor(n / DAYS_Y), n % DAYS_Y, (F.lit(DAYS_X), F.lit(DAYS_Y)), "date", key)
        wide = F.forall(p, lambda x: F.length(x) > 1)

        def written(at: Column) -> Column:
            day = F.date_add(F.lit(FIRST_DAY).cast("date"), (at["x"] * DAYS_Y + at["y"]).cast("int"))
            fields = [F.date_format(day, "yyyy"), *(
                F.when(wide, F.date_format(day, f * 2)).otherwise(F.date_format(day, f)) for f in "Md")]
            return F.concat(
                fields[order.index(0)], separator, fields[order.index(1)], separator, fields[order.index(2)])

        return let(moved, written)

    span = F.datediff(F.lit(LAST_DAY).cast("date"), F.lit(FIRST_DAY).cast("date"))

    def tried(p: Column, orders: list[tuple[int, int, int]]) -> Column:
        if not orders:
            return value
        return let(day_number(orders[0], p), lambda n: F.when(
            n.between(0, span), changed(n, orders[0], p)).otherwise(tried(p, orders[1:])))

    return let(F.split(value, "[-/.]"), lambda p: tried(p, [(0, 1, 2)] if year_first else [(2, 1, 0), (2, 0, 1)]))


def number(value: Column, key: str) -> Column:
    """The pseudonym of what ``NUMBERS`` matched; the same text if it is not valid in its format."""
    return (
        F.when(is_form(value, IP), ip(value, key))
        .when(is_form(value, YMD), date(value, True, key))
        .when(is_form(value, SSN), ssn(value, key))
        .when(is_form(value, PLAN), plan_phone(value, key))
        .when(is_form(value, DMY), date(value, False, key))
        .when(is_form(value, CARD), card(value, key))
        .when(is_form(value, PHONE), phone(value, key))
        .otherwise(iban(value, key)))


def keyed(value: Column, kind: str, key: str, digits: int) -> Column:
    """Hexadecimal digits that stand for a text; other texts get others but for a hash collision."""
    return F.left(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), value), 256), F.lit(digits))


def email(value: Column, key: str) -> Column:
    """The name before the sign becomes a keyed digest; the domain stays."""
    return F.concat(F.lit("u"), keyed(F.lower(value), "email", key, 16), F.lit("@"),
                    F.substring_index(value, "@", -1))


def secret(value: Column, key: str) -> Column:
    """What follows the name and sign of a secret becomes a keyed digest, 8 to 64 digits as it was long."""
    body = F.regexp_extract(value, r"[A-Za-z0-9_\-]+$", 0)
    return let(body, lambda b: F.concat(
        F.left(value, F.length(value) - F.length(b)), F.left(keyed(b, "secret", key, 64), F.length(b))))


def replaced(text: Column, pattern: str, sign: str, change: Callable[[Column], Column]) -> Column:
    """``text`` with every match changed; only texts in which ``sign`` is found are searched."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    changed = F.concat(F.transform(found, change), F.array(F.lit("")))
    parts = F.zip_with(F.split(text, pattern, -1), changed, lambda a, b: F.concat(a, b))
    return F.when(F.regexp_like(text, F.lit(sign)), F.array_join(parts, "")).otherwise(text)


def pseudonymised(text: Column, key: str) -> Column:
    """The text with all personal data replaced; null stays null."""
    return let(let(let(
        text, lambda t: replaced(t, EMAIL, "@", lambda m: email(m, key))),
        lambda t: replaced(t, SECRET, "[=:]", lambda m: secret(m, key))),
        lambda t: replaced(t, NUMBERS, "[0-9]", lambda m: number(m, key)))


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with personal data replaced: the id, ``text``, ``changed`` (whether any was found).

    Numbers and dates that are not valid in their format stay. Null texts stay null and are
    not changed; null ids and repeated rows stay. Other columns are not read. ``key`` must be
    kept secret and the same for all documents that are to stay linked.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).alias("__before"))
    rows = rows.withColumn("__after", pseudonymised(F.col("__before"), key))
    return rows.select(id_col, F.col("__after").alias(text_col),
                       F.coalesce(F.col("__after") != F.col("__before"), F.lit(False)).alias("changed"))
