"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Numbers and dates that pass their format's check are permuted by a keyed Feistel network within that format: a card
number stays a valid card number, an IBAN a valid IBAN, an IPv4 address one, a date a date of its own notation. The
permutation depends on the key and the kind alone, so equal values get equal pseudonyms in every document, and
different values of a kind different ones. Numbers that fail their check digit keep failing it by as much, so none
meets the pseudonym of one that passes. E-mail addresses (whatever their capitals) and secrets have no fixed-size format
and become keyed hashes: 104 bits for an address and 80 for its domain, and for a secret as many hexadecimal signs as
it has, at least 20.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 10
# Patterns begin at a fixed boundary and have bounded repeats or ones that nothing takes back, so a long text costs time in proportion to its length.
#: Length of an account number by country; other countries' are told by the check digits alone.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBANS = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") + "(?![A-Za-z0-9])" for n, c in IBAN_LENGTHS.items())
#: Digits after a country code, for countries where all numbers are of one length.
PHONE_DIGITS = {8: "45|47|65|852", 9: "31|33|34|41|48|61|351|380|420|421", 10: "1|7|30|52|90|91"}
_PHONES = "|".join(rf"\+(?:{c})(?:[ .\-]?\(0\))?(?:[ .\-]?\(?[0-9]\)?){{{n}}}(?![0-9])" for n, c in PHONE_DIGITS.items())
_PHONE = r"\+[0-9]{1,3}[ .\-]?\(?[0-9]{1,4}\)?(?:[ .\-]?[0-9]{2,4}){2,4}"
_DIGIT = r"[ .\-()]{0,3}[0-9]"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "secret": r"(?<![A-Za-z0-9])(?:(?=[A-Fa-f]*+[0-9])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)|(?=[A-Za-z_]{0,40}[0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36})|(?:sk|pk)[-_](?=[A-Za-z\-_]{0,1024}[0-9])[A-Za-z0-9_\-]{20,}+)(?![A-Za-z0-9])",
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBANS}|[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?(?![A-Za-z0-9]))",
    "date": r"(?<![0-9/.\-])(?:(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])|(?:0[1-9]|[12][0-9]|3[01])/(?:0[1-9]|[12][0-9]|3[01])/(?:19|20)[0-9]{2})(?![0-9/\-])",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[0-9])",
    # A number of its country's length; else one of at most 15 digits (E.164); else as many as the groups give.
    "phone": rf"(?<![A-Za-z0-9+])(?:{_PHONES}|{_PHONE}(?<![0-9]{_DIGIT * 15})(?![0-9])|{_PHONE}(?![0-9])|\(?[0-9]{{3}}\)?[ .\-][0-9]{{3}}[.\-][0-9]{{4}}(?![0-9]))",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "number": r"(?<![A-Za-z0-9.])(?:[0-9]{13,19}|[0-9]{4}([ \-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5})(?![A-Za-z0-9])",
}
ANY = "|".join(PATTERNS.values())
#: Every pattern needs one of these signs, so a text without them is told by one plain search.
NEEDED = "[0-9@]"
FIRST_DAY, DAYS, SIDE = "1900-01-01", 73049, 271  # dates from 1900 to 2099; SIDE squared is just above DAYS


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _round(key: str, kind: str, i: Column, right: Column, width: Column) -> Column:
    """52 bits of a keyed hash of the round, the format and one half."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), width.cast("string"), right.cast("string")), 256), 1, 13), 16, 10).cast("bigint")


def feistel(key: str, kind: str, left: Column, right: Column, left_size: Column, right_size: Column) -> Column:
    """struct(l, r): a keyed permutation of pairs with l below left_size and r below right_size; ROUNDS is even, so sizes end where they began."""
    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))

    def step(a: Column, i: Column) -> Column:
        size = F.when(i % 2 == 0, left_size).otherwise(right_size)
        new = (a["l"] + F.pmod(_round(key, kind, i, a["r"], left_size), size)) % size
        return F.struct(a["r"].alias("l"), new.cast("bigint").alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def permuted_digits(key: str, kind: str, digits: Column) -> Column:
    """Another string of as many digits (2 to 36), a bijection for each length."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    power = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("bigint")
    halves = feistel(key, kind, digits.substr(F.lit(1), u), digits.substr(u + 1, n), power(u), power(n - u))
    return let(halves, lambda h: F.concat(F.lpad(h["l"].cast("string"), u, "0"), F.lpad(h["r"].cast("string"), n - u, "0")))


def put_back(model: Column, digits: Column) -> Column:
    """The model with its digits replaced, in order; everything else stays."""
    at = lambda i: F.length(F.regexp_replace(model.substr(F.lit(1), i), "[^0-9]", ""))
    char = lambda i: model.substr(i, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(model)), lambda i: F.when(char(i).between("0", "9"), digits.substr(at(i), F.lit(1))).otherwise(char(i))), "")


def luhn_sum(digits: Column, doubled: int) -> Column:
    """Sum over digits from the right; those with place % 2 == doubled (places from 0) count twice, less 9 above 9."""
    n = F.length(digits)

    def add(a: Column, i: Column) -> Column:
        d = digits.substr(n - i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return a + F.when(i % 2 == doubled, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def _number(key: str, m: Column) -> Column:
    """A card number, by its check digit, in one piece or in groups; other long numbers only in one piece, as groups may be anything.

    The digits before the check digit are permuted, and what the check digit is off by (0 for a card) is kept.
    """
    digits = F.regexp_replace(m, "[^0-9]", "")

    def card(d: Column) -> Column:
        body = d.substr(F.lit(1), F.length(d) - 1)
        off = F.pmod(luhn_sum(d, 1), F.lit(10))
        kind = lambda name: let(permuted_digits(key, name, body), lambda b: F.concat(b, F.pmod(off - luhn_sum(b, 0), F.lit(10)).cast("string")))
        return F.when(off == 0, kind("card")).when(~m.rlike("[^0-9]"), kind("number")).otherwise(d)

    return put_back(m, let(digits, card))


def _phone(key: str, m: Column) -> Column:
    """Only digits behind the country code are permuted, so a number stays one of its country.

    Of a country whose numbers have one length the whole number behind the code is; of another one all but the first
    three digits, in which every code is told, and at most ten; of a number without a code the last ten.
    """

    def new(d: Column) -> Column:
        n = F.length(d)
        keep = F.greatest(n - 10, F.when(m.startswith("+"), F.lit(3)).otherwise(F.lit(0)))
        for digits, codes in PHONE_DIGITS.items():
            keep = F.when(m.rlike(rf"^\+(?:{codes})(?:[ .\-]?\(0\))?(?:[ .\-]?\(?[0-9]\)?){{{digits}}}$"), n - digits).otherwise(keep)
        return let(keep, lambda k: F.concat(d.substr(F.lit(1), k), permuted_digits(key, "phone", d.substr(k + 1, F.lit(10)))))

    return put_back(m, let(F.regexp_replace(m, "[^0-9]", ""), new))


def _ssn(key: str, m: Column, steps: int = 256) -> Column:
    """A number that can exist stays one (area 001 to 899 but 666, group from 01, serial from 0001), and one that cannot stays so.

    Permuted digits of the other sort walk on until they are of their own; after `steps` steps that fails once in 10^13.
    """
    can = lambda d: ~d.substr(1, 3).isin("000", "666") & (d.substr(1, 1) != "9") & (d.substr(4, 2) != "00") & (d.substr(6, 4) != "0000")

    def walk(d: Column) -> Column:
        once = lambda x: permuted_digits(key, "ssn", x)
        return let(can(d), lambda sort: F.aggregate(F.sequence(F.lit(1), F.lit(steps)), once(d), lambda x, _: F.when(can(x) == sort, x).otherwise(once(x))))

    return put_back(m, let(F.regexp_replace(m, "[^0-9]", ""), walk))


def _ip(key: str, m: Column) -> Column:
    part = lambda i: F.split(m, r"\.")[i].cast("bigint")
    size = F.lit(65536).cast("bigint")
    both = feistel(key, "ip", part(0) * 256 + part(1), part(2) * 256 + part(3), size, size)
    return let(both, lambda h: F.concat_ws(".", *[F.floor(x / 256).cast("bigint").cast("string") if high else (x % 256).cast("string") for x in (h["l"], h["r"]) for high in (1, 0)]))


def _day(key: str, day: Column, inside: Callable[[Column], Column], kind: str = "date", steps: int = 64) -> Column:
    """Days from FIRST_DAY, permuted; what falls outside walks on until it is inside, which leaves a permutation of the inside.

    A day that needs more than `steps` steps would stay outside; with two fifths of all inside that is 1 in 10^14.
    """
    side = F.lit(SIDE).cast("bigint")
    once = lambda x: let(feistel(key, kind, F.floor(x / SIDE), x % SIDE, side, side), lambda h: h["l"] * SIDE + h["r"])
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), once(day), lambda x, _: F.when((x < DAYS) & inside(x), x).otherwise(once(x)))


def _on(day: Column) -> Column:
    return F.date_add(F.to_date(F.lit(FIRST_DAY)), day.cast("int"))


def _date(key: str, m: Column) -> Column:
    """A valid date in its own notation; anything else stays.

    With slashes the day comes first where that is a date; where it is not, the month does, and then days up to the
    12th are passed over, so that no pseudonym reads as a date of the other order: each notation maps to itself.
    """
    out = m
    anything, late = lambda x: F.lit(True), lambda x: F.dayofmonth(_on(x)) > 12
    for form, inside in (("MM/dd/yyyy", late), ("dd/MM/yyyy", anything), ("yyyy-MM-dd", anything)):
        parsed = F.to_date(F.try_to_timestamp(m, F.lit(form)))
        day = F.datediff(parsed, F.to_date(F.lit(FIRST_DAY))).cast("bigint")
        new = F.date_format(_on(_day(key, day, inside)), form)
        fits = m.rlike("-") if "-" in form else m.rlike("/")
        out = F.when(fits & parsed.isNotNull(), new).otherwise(out)
    return out


def _mod97(text: Column) -> Column:
    """Letters count as two digits; the remainder is carried from sign to sign."""
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97))


def _iban(key: str, m: Column) -> Column:
    """The account's digits are permuted (in pieces of 18) and the check digits made anew; what is not an IBAN stays."""
    plain = F.replace(m, F.lit(" "), F.lit(""))

    def new(p: Column) -> Column:
        account = p.substr(F.lit(5), F.length(p))
        digits = F.regexp_replace(account, "[^0-9]", "")
        piece = lambda d, i: d.substr(i * 18 + 1, F.lit(18))
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length(digits) - 1) / 18).cast("int")), lambda i: F.when(F.length(piece(digits, i)) > 1, permuted_digits(key, "iban", piece(digits, i))).otherwise(piece(digits, i)))
        fresh = put_back(account, F.array_join(pieces, ""))
        country = p.substr(F.lit(1), F.lit(2))
        made = let(fresh, lambda a: F.concat(F.lpad((98 - _mod97(F.concat(a, country, F.lit("00")))).cast("string"), F.lit(2), "0"), F.regexp_replace(a, "[^0-9]", "")))
        valid = (_mod97(F.concat(account, p.substr(F.lit(1), F.lit(4)))) == 1) & (F.length(digits) > 1)
        return F.when(valid, put_back(m, made)).otherwise(m)

    return let(plain, new)


def _hashed(key: str, kind: str, value: Column, length: Column, letters: bool) -> Column:
    """Signs of a keyed hash, as many as asked for."""
    base = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), value), 256)
    base = F.translate(base, "0123456789", "ghijklmnop") if letters else base
    return let(base, lambda h: F.repeat(h, F.ceil(length / 64).cast("int")).substr(F.lit(1), length))


def _secret(key: str, m: Column) -> Column:
    fresh = _hashed(key, "secret", m, F.length(m), False)
    return F.when(m == F.upper(m), F.upper(fresh)).otherwise(fresh)


def _email(key: str, m: Column) -> Column:
    """Local part and domain become letters of keyed hashes, of one length for all, so addresses of one domain stay together."""
    domain = F.lower(F.substring_index(m, "@", -1))
    return F.concat(_hashed(key, "local", F.lower(m), F.lit(26), True), F.lit("@"), _hashed(key, "domain", domain, F.lit(20), True), F.lit(".invalid"))


MAKERS = {"email": _email, "secret": _secret, "iban": _iban, "date": _date, "ip": _ip, "phone": _phone, "ssn": _ssn, "number": _number}


def kind_of(m: Column) -> Column:
    """The first kind whose pattern matches the whole; boundaries held where the match was found."""
    out = F.lit("number")
    for kind in reversed(list(PATTERNS)[:-1]):
        out = F.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), kind).otherwise(out)
    return out


def pseudonym(key: str, m: Column) -> Column:
    def make(kind: Column) -> Column:
        out = m
        for name, maker in MAKERS.items():
            out = F.when(kind == name, maker(key, m)).otherwise(out)
        return out

    return let(kind_of(m), make)


#: Where the session names the key. Without one, the queries over synthetic tables take PUBLIC_KEY, which hides nothing.
KEY_SETTING, PUBLIC_KEY = "spark.tracewell.pseudonymKey", "public key of the synthetic tables"


def session_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, "") or PUBLIC_KEY


def with_pseudonyms(docs: DataFrame, key: str) -> DataFrame:
    """`docs` with its columns, private data in text replaced, and n_chars (where there is such a column) made to fit changed texts.

    key: a secret of the owner's; who has it can turn numbers and dates back, so it has no default. Null stays null and
    empty stays empty; texts without private data are unchanged to the byte. The text, however long, is divided at the
    matches, which are replaced and woven in again. Equal rows give equal rows, an empty table an empty one, and other
    columns stay, whatever their names.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    text = F.col("text")
    parts, found = F.split(text, ANY, -1), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    woven = F.zip_with(parts, F.transform(found, lambda m: pseudonym(key, m)), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    hit = text.rlike(NEEDED) & text.rlike(ANY)
    new = F.when(hit, F.array_join(woven, "")).otherwise(text)
    if "n_chars" not in docs.columns:
        return docs.withColumn("text", new)
    fits = F.when(hit, F.length(new)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return docs.withColumns({"text": new, "n_chars": fits})


def op5_pii_pseudonyms(spark, sf_dir: str) -> DataFrame:
    """doc_id, text with pseudonyms, and how many of each kind the text held."""
    from .shared import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("text").alias("was"))
    text = F.col("was")
    found = F.when(text.rlike(NEEDED) & text.rlike(ANY), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    out = with_pseudonyms(docs, session_key(spark)).withColumn("kinds", F.transform(found, kind_of))
    count = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).cast("long")
    return out.select("doc_id", "text", *[count(kind).alias(f"n_{kind}") for kind in PATTERNS])
