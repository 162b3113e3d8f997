"""Format-preserving pseudonyms for personal numbers and dates: a keyed Feistel network over the values of a format.

Found, in this order at each place of a whole text: e-mail addresses, IPv4 addresses, payment cards (13 to 19 digits that pass the Luhn
test), telephone numbers, social security numbers (3-2-4 digits) and dates (year-month-day, day/month/year or month/day/year with ``/`` or
``.``).  What does not validate stays as it is.  A value is split in two halves a, b with their ranges A, B, and ``ROUNDS`` times one half
is added a keyed hash of the other, modulo its range; that permutes A x B exactly, so different values stay different and equal values stay
equal in every document and spelling:

* cards: all digits but the last, which becomes the check digit again; telephone numbers: all digits but the first; social security
  numbers: all digits; separators stay;
* IPv4: the two 16-bit halves;
* dates of 1800 to 2199: the day's number in those 146097 = 189 x 773 days, written in the same form;
* e-mail addresses are no numbers: the local part becomes ``u`` and 12 hexadecimal digits of a keyed hash, the domain stays.

Everything is a Spark expression; no Python runs on the executors, and no row is moved.  Null texts stay null, empty ones empty, both
with 0 values; repeated rows get the same result; extra columns pass through ``pseudonymise``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 8
KINDS = ("email", "ip", "card", "phone", "ssn", "date")
_BEFORE, _AFTER = r"(?<![\w.+-])", r"(?!\w)"
# The forms that are looked for.
FORMS = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\w)",
    "card": r"(?:\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})" + _AFTER,
    "phone": r"(?:\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})" + _AFTER,
    "ssn": r"\d{3}-\d{2}-\d{4}" + _AFTER,
    "date": r"(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})" + _AFTER,
}
PATTERN = _BEFORE + "(?:" + "|".join(FORMS[k] for k in KINDS) + ")"
_EPOCH, _DAYS = "1800-01-01", (189, 773)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _feistel(a: Column, b: Column, low: Column, high: Column, tweak: Column, key: str) -> Column:
    """Permute the pair (a, b) of the ranges [0, low) x [0, high)."""
    def hashed(half: Column, k: Column, size: Column) -> Column:
        text = F.concat_ws("|", F.lit(key), tweak, k, half)
        return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long") % size

    def step(pair: Column, k: Column) -> Column:
        left, right = pair["a"], pair["b"]
        return F.when(k % 2 == 0, F.struct(((left + hashed(right, k, low)) % low).alias("a"), right.alias("b"))).otherwise(
            F.struct(left.alias("a"), ((right + hashed(left, k, high)) % high).alias("b")))

    start = F.struct(a.try_cast("long").alias("a"), b.try_cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def permute_digits(digits: Column, tweak: Column, key: str) -> Column:
    """Another string of as many digits (2 to 36), one to one for each length and tweak."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    ten = lambda k: F.pow(F.lit(10.0), k).cast("long")
    pair = _feistel(F.substring(digits, F.lit(1), u), F.substring(digits, u + 1, n), ten(u), ten(n - u), F.concat_ws(":", tweak, n), key)
    return F.transform(F.array(pair), lambda p: F.concat(F.lpad(p["a"].cast("string"), u, "0"), F.lpad(p["b"].cast("string"), n - u, "0")))[0]


def _refill(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced by ``digits`` in order."""
    def char(c: Column, k: Column) -> Column:
        at = F.length(_digits(F.substring(value, F.lit(1), k + 1)))
        return F.when(c.rlike("[0-9]"), F.substring(digits, at, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(value, "(?!^)"), char), "")


def luhn_digit(payload: Column) -> Column:
    """The check digit after ``payload``."""
    n = F.length(payload)

    def add(total: Column, k: Column) -> Column:
        d = F.substring(payload, n - k, F.lit(1)).try_cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(k % 2 == 0, twice).otherwise(d)

    return (10 - F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10) % 10


def kind(value: Column) -> Column:
    """Which valid form a found text is; NULL if it is none."""
    whole = {k: value.rlike(f"^{FORMS[k]}$") for k in KINDS}
    octets = F.forall(F.split(value, r"\."), lambda o: o.try_cast("int") <= 255)
    d = _digits(value)
    luhn = luhn_digit(F.substring(d, F.lit(1), F.length(d) - 1))
    return (F.when(whole["email"], "email").when(whole["ip"] & octets, "ip")
            .when(whole["card"] & (luhn.cast("string") == F.right(d, F.lit(1))), "card")
            .when(whole["phone"], "phone").when(whole["ssn"], "ssn")
            .when(whole["date"] & F.year(_date(value)).between(1800, 2199), "date"))


def _date(value: Column) -> Column:
    iso = F.try_to_timestamp(value, F.lit("yyyy-MM-dd"))
    slash = [F.try_to_timestamp(F.translate(value, ".", "/"), F.lit(f)) for f in ("dd/MM/yyyy", "MM/dd/yyyy")]
    return F.coalesce(iso, *slash).cast("date")


def _pseudonym(value: Column, form: Column, key: str) -> Column:
    d = _digits(value)
    n = F.length(d)
    payload = permute_digits(F.substring(d, F.lit(1), n - 1), F.lit("card"), key)
    card = F.transform(F.array(payload), lambda p: _refill(value, F.concat(p, luhn_digit(p).cast("string"))))[0]
    rest = permute_digits(F.substring(d, F.lit(2), n), F.lit("phone"), key)
    phone = _refill(value, F.concat(F.left(d, F.lit(1)), rest))
    ssn = _refill(value, permute_digits(d, F.lit("ssn"), key))
    o = F.transform(F.split(value, r"\."), lambda x: x.try_cast("long"))
    ip = F.transform(F.array(_feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), F.lit("ip"), key)),
                     lambda p: F.concat_ws(".", F.floor(p["a"] / 256), p["a"] % 256, F.floor(p["b"] / 256), p["b"] % 256))[0]
    day = F.datediff(_date(value), F.lit(_EPOCH).cast("date"))
    moved = _feistel(F.floor(day / _DAYS[1]), day % _DAYS[1], F.lit(_DAYS[0]), F.lit(_DAYS[1]), F.lit("date"), key)

    def written(p: Column) -> Column:
        new = F.date_add(F.lit(_EPOCH).cast("date"), (p["a"] * _DAYS[1] + p["b"]).cast("int"))
        us = F.try_to_timestamp(F.translate(value, ".", "/"), F.lit("dd/MM/yyyy")).isNull()
        text = F.when(us, F.date_format(new, "MM/dd/yyyy")).otherwise(F.date_format(new, "dd/MM/yyyy"))
        return F.when(value.contains("-"), F.date_format(new, "yyyy-MM-dd")).when(value.contains("."), F.translate(text, "/", ".")).otherwise(text)

    date = F.transform(F.array(moved), written)[0]
    local = F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lower(value)), 256), 1, 12)
    email = F.concat(F.lit("u"), local, F.regexp_extract(value, "@.*$", 0))
    return (F.when(form == "email", email).when(form == "ip", ip).when(form == "card", card).when(form == "phone", phone)
            .when(form == "ssn", ssn).when(form == "date", date).otherwise(value))


def pseudonymise(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in ``column`` and, as ``_values``, what stood there: kind, value and pseudonym in order of place.
    Own columns of the names used here (``_values``, ``_found``, ``_typed``, ``_named``) are replaced."""
    docs = docs.drop("_values", "_found", "_typed", "_named")
    found = docs.withColumn("_found", F.when(F.col(column).rlike("[0-9@]"), F.regexp_extract_all(column, F.lit(PATTERN), F.lit(0))))
    typed = found.withColumn("_typed", F.transform("_found", lambda v: F.struct(kind(v).alias("kind"), v.alias("value"))))
    named = typed.withColumn("_named", F.transform("_typed", lambda t: t.withField("pseudonym", _pseudonym(t["value"], t["kind"], key))))
    gaps, names = F.split(column, PATTERN, -1), F.concat(F.transform("_named", lambda t: t["pseudonym"]), F.array(F.lit("")))
    text = F.when(F.size("_found") > 0, F.array_join(F.zip_with(gaps, names, lambda g, p: F.concat(g, p)), "")).otherwise(F.col(column))
    return (named.withColumns({column: text, "_values": F.coalesce(F.filter("_named", lambda t: t["kind"].isNotNull()), F.expr(
        "cast(array() as array<struct<kind: string, value: string, pseudonym: string>>)"))}).drop("_found", "_typed", "_named"))


def report(docs: DataFrame, key: str) -> DataFrame:
    """Per document the text with pseudonyms and how many values of each kind it had."""
    done = pseudonymise(docs.select("doc_id", "text"), key)
    counts = [F.expr(f"cast(size(filter(_values, v -> v.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    return done.select("doc_id", F.size("_values").cast("long").alias("n_values"), *counts, "text")
