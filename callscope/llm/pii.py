"""Personal data to format-preserving pseudonyms by a keyed Feistel network, in SQL functions throughout.

Matches that validate (check digits, calendar, number ranges) become mixed-radix tuples; a Feistel network permutes the
tuples of a format among themselves and the result is laid back over the separators. Equal values, however they are
punctuated, get equal pseudonyms in every document, different values different ones, and results validate again.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.llm.shared import let

ROUNDS = 10

#: Signs of an IBAN by country.
IBAN_SIGNS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV",
    22: "BG BH DE GB GE IE ME RS", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU"}
#: Digits of a national phone number by country code, where all have equally many.
PHONE_DIGITS = {8: "45 47 65", 9: "27 31 33 34 41 48 61 351 420", 10: "1 7 44 52 57 90 91"}

_GROUPS = r"[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})"
#: A digit of a phone number and whatever of it may follow: written out where they are counted, as a look-behind needs it.
_DIGIT, _REST = r"[ .()-]{0,3}[0-9]", r"[0-9 .()-]{0,40}"
#: What begins behind a number and isn't a part of it.
_NEXT = "[ -](?:" + "|".join([
    r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9])", r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?![\w-])",
    r"[0-9]{1,2}(?:\.[0-9]{1,2}\.|/[0-9]{1,2}/|-[0-9]{1,2}-)[0-9]{4}(?![\w-])", r"[0-9]{3}-[0-9]{2,3}-[0-9]{4}(?![\w-])",
    r"[0-9](?:[ -]?[0-9]){12}", r"[A-Za-z0-9._%+-]++@"]) + ")"
#: Further groups of a phone number: none once there are digits enough and something else begins.
_MORE = rf"(?:(?!(?=[ -])(?<=\+{_DIGIT * 8}{_REST}){_NEXT})[ .-]?[0-9]{{2,4}}){{1,4}}(?![\w])"


def _ibans(signs: int, countries: str) -> str:
    fours, left = divmod(signs - 4, 4)
    return rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}" + (rf" ?[A-Z0-9]{{{left}}}" if left else "")


def _phones(digits: int, codes: str) -> str:
    any_of = f"(?:{codes.replace(' ', '|')})"
    return rf"{any_of}{_GROUPS}{_MORE}(?<=\+{any_of}{_DIGIT * digits})"


#: What is looked for, at one place in this order. The first sign of each decides, and no match begins inside a word.
#: Lengths are held here where they are known, so that a match takes nothing of what follows it.
PATTERN = "|".join([
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",  # mail address
    rf"(?<![\w])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join(_ibans(n, c) for n, c in IBAN_SIGNS.items())})(?![\w])",  # IBAN
    r"(?<![\w])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\w])",
    rf"\+(?:{'|'.join(_phones(n, c) for n, c in PHONE_DIGITS.items())})",  # phone with a country code
    rf"\+[0-9]{{1,3}}{_GROUPS}{_MORE}(?:(?<=\+[17]{_DIGIT * 6}{_REST})(?<!\+[17]{_DIGIT * 14}{_REST})|(?<=\+[02-9]{_DIGIT * 7}{_REST})(?<!\+[02-9]{_DIGIT * 15}{_REST}))",
    r"(?<![\w+])\([0-9]{3}\) ?[0-9]{3}[-. ][0-9]{4}(?![\w-])",  # phone
    r"(?<![\w.+-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![\w-])",
    r"(?<![\w./-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![\w-])",  # date
    r"(?<![\w./-])[0-9]{1,2}([./-])[0-9]{1,2}\1[0-9]{4}(?![\w-])",
    r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9])",  # IPv4 address
    r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",  # social security number
    rf"(?<![\w.-])[0-9](?:[ -]?[0-9]){{12}}(?:(?!{_NEXT})[ -]?[0-9]){{0,6}}(?![\w-])",  # payment card
])


def feistel(values: Column, radix: Column, domain: Column, key: str) -> Column:
    """Permute tuples with 0 <= values[i] < radix[i]: halves are shifted in turn by a keyed hash of the other half."""
    half = F.ceil(F.size(values) / 2).cast("int")

    def turn(v: Column, i: Column) -> Column:
        left = i % 2 == 0
        other = F.when(left, F.slice(v, half + 1, F.size(v))).otherwise(F.slice(v, F.lit(1), half))
        said = F.concat_ws(",", F.lit(key), domain, F.size(v).cast("string"), i.cast("string"), F.array_join(other.cast("array<string>"), ","))
        digit = lambda d, p: F.conv(F.substring(d, p % 21 * 6 + 1, F.lit(6)), 16, 10).cast("bigint")
        return let(F.sha2(said.cast("binary"), 512), lambda d: F.transform(v, lambda x, p: F.when(
            (p < half) == left, (x + digit(d, p)) % F.get(radix, p)).otherwise(x)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), values, turn)


def _signs(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _codes(s: Column) -> Column:
    return F.transform(_signs(s), lambda c: F.ascii(c).cast("bigint"))


def _low(code: Column) -> Column:
    """First sign of the class of a digit or letter; any other sign is a class of its own."""
    return F.when(code.between(48, 57), 48).when(code.between(65, 90), 65).when(code.between(97, 122), 97).otherwise(code).cast("bigint")


def _count(code: Column) -> Column:
    return F.when(code.between(48, 57), 10).when(code.between(65, 90) | code.between(97, 122), 26).otherwise(1).cast("bigint")


def _shuffle(s: Column, domain: Column, key: str) -> Column:
    """Every digit stays a digit, every letter a letter of its case."""
    return let(_codes(s), lambda c: F.array_join(F.transform(F.zip_with(
        c, feistel(F.transform(c, lambda x: x - _low(x)), F.transform(c, _count), domain, key), lambda x, y: _low(x) + y), F.char), ""))


def _lay(template: Column, signs: Column) -> Column:
    """Put the signs in place of the template's letters and digits, in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    step = lambda a, c: F.when(c.rlike("[A-Za-z0-9]"), F.struct(
        F.concat(a["out"], F.substring(signs, a["at"], F.lit(1))).alias("out"), (a["at"] + 1).alias("at"))).otherwise(
        F.struct(F.concat(a["out"], c).alias("out"), a["at"].alias("at")))
    return F.aggregate(_signs(template), start, step, lambda a: a["out"])


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string whose last digit is the check digit."""
    n = F.length(digits)
    d = lambda c, i: F.when((n - i) % 2 == 0, F.when(c * 2 > 9, c * 2 - 9).otherwise(c * 2)).otherwise(c)
    return F.aggregate(F.transform(_signs(digits), lambda c, i: d(c.cast("int"), i)), F.lit(0), lambda a, x: a + x)


def mod97(s: Column) -> Column:
    """Letters as 10 to 35, the whole read as one number, modulo 97."""
    step = lambda a, c: F.when(c < 58, (a * 10 + c - 48) % 97).otherwise((a * 100 + c - 55) % 97)
    return F.aggregate(_codes(s), F.lit(0).cast("bigint"), step)


def _card(hit: Column, key: str) -> Column:
    """The first digit, which names the scheme, stays, and the check digit is made anew."""
    def valid(d: Column) -> Column:
        kept = F.concat(F.substring(d, 1, 1), _shuffle(F.substring(d, F.lit(2), F.length(d) - 2), F.lit("card"), key))
        checked = lambda k: F.concat(k, ((10 - luhn_sum(F.concat(k, F.lit("0"))) % 10) % 10).cast("string"))
        return F.when(luhn_sum(d) % 10 == 0, let(kept, checked))
    return let(F.regexp_replace(hit, "[^0-9]", ""), lambda d: _lay(hit, valid(d)))


def _iban(hit: Column, key: str) -> Column:
    def valid(s: Column) -> Column:
        country, bank = F.substring(s, 1, 2), F.substring(s, F.lit(5), F.length(s))
        made = lambda b: F.concat(country, F.lpad((98 - mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b)
        right = (mod97(F.concat(bank, F.substring(s, 1, 4))) == 1) & F.length(s).between(15, 34)
        return F.when(right, let(_shuffle(bank, F.concat(F.lit("iban"), country), key), made))
    return let(F.regexp_replace(hit, " ", ""), lambda s: _lay(hit, valid(s)))


def _phone(hit: Column, key: str) -> Column:
    """The country code stays; 1 and 7 have one digit, others two. Digits 0 and 1 that begin a group stay 0 or 1."""
    def valid(d: Column) -> Column:
        code = F.when(~hit.startswith("+"), 0).when(d.rlike("^[17]"), 1).otherwise(2)
        domain = F.when(code == 0, F.lit("1")).otherwise(F.substring(d, F.lit(1), code))

        def moved(c: Column) -> Column:
            first = lambda i: (i == 0) | ((i == 3) & (F.size(c) == 10))
            low = lambda x, i: F.when(first(i) & (x >= 50), 50).otherwise(48).cast("bigint")
            count = lambda x, i: F.when(first(i), F.when(x >= 50, 8).otherwise(2)).otherwise(10).cast("bigint")
            new = feistel(F.transform(c, lambda x, i: x - low(x, i)), F.transform(c, count), F.concat(F.lit("phone"), domain), key)
            return F.array_join(F.transform(F.zip_with(F.transform(c, low), new, lambda x, y: x + y), F.char), "")

        body = F.substring(d, code + 1, F.length(d))
        return F.when(F.length(body).between(6, 13), F.concat(F.substring(d, F.lit(1), code), let(_codes(body), moved)))
    return let(F.regexp_replace(hit, "[^0-9]", ""), lambda d: _lay(hit, valid(d)))


def _numbers(s: Column, sign: str) -> Column:
    return F.split(s, sign).cast("array<bigint>")


def _ssn(hit: Column, key: str) -> Column:
    def valid(v: Column) -> Column:
        area, group, serial = (F.get(v, F.lit(i)) for i in range(3))
        right = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        values = F.array(F.when(area < 666, area - 1).otherwise(area - 2), group - 1, serial - 1)
        radix = F.array(*[F.lit(r).cast("bigint") for r in (898, 99, 9999)])
        text = lambda p: F.concat_ws("-", F.lpad(F.when(p[0] < 665, p[0] + 1).otherwise(p[0] + 2).cast("string"), 3, "0"),
                                     F.lpad((p[1] + 1).cast("string"), 2, "0"), F.lpad((p[2] + 1).cast("string"), 4, "0"))
        return F.when(right, let(feistel(values, radix, F.lit("ssn"), key), text))
    return let(_numbers(hit, "-"), valid)


def _address(hit: Column, key: str) -> Column:
    """Octets stay octets; a first octet of 1 to 223 stays one."""
    def valid(v: Column) -> Column:
        unicast = F.get(v, F.lit(0)).between(1, 223)
        low = lambda x, i: F.when(i > 0, 0).when(unicast, 1).otherwise(x).cast("bigint")
        count = F.transform(v, lambda x, i: F.when(i > 0, 256).when(unicast, 223).otherwise(1).cast("bigint"))
        new = feistel(F.transform(v, lambda x, i: x - low(x, i)), count, F.lit("ip"), key)
        laid = F.array_join(F.zip_with(F.transform(v, low), new, lambda x, y: x + y).cast("array<string>"), ".")
        return F.when(F.forall(v, lambda x: x <= 255), laid)
    return let(_numbers(hit, "\\."), valid)


def _date(hit: Column, key: str) -> Column:
    """Days of a century are permuted among themselves; order, separators and leading zeros of the date stay.

    With points or hyphens the day comes first, with slashes the month, unless only the other order is a date.
    """
    sign = F.regexp_extract(hit, "[./-]", 0)
    p = F.split(hit, "[./-]")
    iso = F.length(F.get(p, F.lit(0))) == 4

    def valid(n: Column) -> Column:
        a, b = F.get(n, F.lit(0)), F.get(n, F.lit(1))
        year = F.when(iso, a).otherwise(F.get(n, F.lit(2)))
        swapped = ~iso & F.when(sign == "/", (a <= 12)).otherwise((a <= 12) & (b > 12))  # month before day
        month = F.when(iso | ~swapped, b).otherwise(a)
        day = F.when(iso, F.get(n, F.lit(2))).when(swapped, b).otherwise(a)
        leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
        longest = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
        right = year.between(1800, 2199) & month.between(1, 12) & day.between(1, longest)
        start = F.make_date((F.floor(year / 100) * 100).cast("int"), F.lit(1), F.lit(1))
        index = F.datediff(F.make_date(year.cast("int"), month.cast("int"), day.cast("int")), start).cast("bigint")
        long_century = F.floor(year / 100) % 4 == 0  # 36,525 = 75 * 487 days, else 36,524 = 92 * 397
        rows, cols = F.when(long_century, 75).otherwise(92).cast("bigint"), F.when(long_century, 487).otherwise(397).cast("bigint")
        new = feistel(F.array(F.floor(index / cols).cast("bigint"), index % cols), F.array(rows, cols), F.concat(F.lit("date"), start.cast("string")), key)
        at = F.date_add(start, let(new, lambda v: F.get(v, F.lit(0)) * cols + F.get(v, F.lit(1))).cast("int"))
        wide = F.when(iso, F.lit(2)).otherwise(F.greatest(F.length(F.get(p, F.lit(0))), F.length(F.get(p, F.lit(1)))))
        two = lambda x: F.when((wide == 2), F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))

        def text(t: Column) -> Column:
            y, m, d = F.lpad(F.year(t).cast("string"), 4, "0"), two(F.month(t)), two(F.dayofmonth(t))
            return F.when(iso, F.concat_ws("-", y, m, d)).when(swapped, F.concat(m, sign, d, sign, y)).otherwise(F.concat(d, sign, m, sign, y))
        return F.when(right, let(at, text))
    return let(p.cast("array<bigint>"), valid)


def _mail(hit: Column, key: str) -> Column:
    """Letters and digits before the at sign change; the domain stays."""
    name = F.substring_index(hit, "@", 1)
    return F.concat(_shuffle(name, F.lit("mail"), key), F.substring(hit, F.length(name) + 1, F.length(hit)))


def pseudonym(hit: Column, key: str) -> Column:
    """The pseudonym of one match, or null where it doesn't validate."""
    return (F.when(hit.contains("@"), _mail(hit, key)).when(hit.rlike("^[A-Z]"), _iban(hit, key))
            .when(hit.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$|^[0-9]{1,2}([./-])[0-9]{1,2}\\1[0-9]{4}$"), _date(hit, key))
            .when(hit.rlike("^[0-9]{1,3}(\\.[0-9]{1,3}){3}$"), _address(hit, key)).when(hit.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), _ssn(hit, key))
            .when(hit.rlike("^[+(]|^[0-9]{3}-[0-9]{3}-[0-9]{4}$"), _phone(hit, key)).otherwise(_card(hit, key)))


def _reach(hit: Column) -> Column:
    """Signs of the longest prefix of a match that ends with a group and validates; null where none does."""
    bare = lambda n: F.regexp_replace(F.substring(hit, F.lit(1), n), "[ -]", "")
    ends = F.filter(F.sequence(F.lit(13), F.lit(45)), lambda n: (n <= F.length(hit)) & F.substring(hit, n, F.lit(2)).rlike("^[A-Z0-9](?![A-Z0-9])"))
    card = lambda d: F.length(d).between(13, 19) & (luhn_sum(d) % 10 == 0)
    iban = lambda d: F.length(d).between(15, 34) & (mod97(F.concat(F.substring(d, F.lit(5), F.length(d)), F.substring(d, 1, 4))) == 1)
    return (F.when(hit.rlike("^[0-9](?:[ -]?[0-9]){12,18}$"), F.array_max(F.filter(ends, lambda n: card(bare(n)))))
            .when(hit.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9 ]+$"), F.array_max(F.filter(ends, lambda n: iban(bare(n)))))
            .otherwise(F.length(hit)))


def _piece(text: Column, found: Column) -> Column:
    return F.struct(text.alias("s"), found.alias("found"))


def _pieces(rest: Column) -> Column:
    """What a match leaves behind its valid prefix, searched again."""
    again = F.flatten(F.zip_with(F.split(rest, PATTERN), F.regexp_extract_all(rest, F.lit(PATTERN), F.lit(0)), lambda p, h: F.array(
        _piece(p, F.lit(False)), _piece(F.coalesce(h, F.lit("")), F.coalesce(_reach(h) == F.length(h), F.lit(False))))))
    return F.when(F.length(rest) < 7, F.array(_piece(rest, F.lit(False)))).otherwise(again)


def _cut(hit: Column) -> Column:
    """The longest valid prefix of a match, or else its first group as it is, and the pieces of the rest."""
    end = F.coalesce(_reach(hit), -F.length(F.regexp_extract(hit, "^[^ ]+", 0)))
    return let(end, lambda n: F.concat(F.array(_piece(F.substring(hit, F.lit(1), F.abs(n)), n > 0)),
                                       let(F.substring(hit, F.abs(n) + 1, F.length(hit)), _pieces)))


def pseudonymise(docs: DataFrame, key: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, text, n_private): every whole text with validated personal data replaced, and how many places were.

    What doesn't validate stays as it is, and so does all other text. A null text stays null with 0 places. Rows don't
    depend on each other: no shuffle, repeated rows get equal results. ``key`` is the secret of the permutation.
    """
    t = F.col("text")
    found = docs.select(docs[id].cast("bigint").alias("doc_id"), docs[text].alias("text")).withColumn(
        "hits", F.when(t.rlike(PATTERN), F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>")))
    cut = found.withColumn("pieces", F.flatten(F.zip_with(F.split(t, PATTERN), F.transform("hits", _cut), lambda p, c: F.concat(
        F.array(_piece(p, F.lit(False))), F.coalesce(c, F.array().cast("array<struct<s:string,found:boolean>>"))))))
    new = cut.withColumn("names", F.transform("pieces", lambda p: F.when(p["found"], let(p["s"], lambda s: pseudonym(s, key)))))
    laid = F.array_join(F.zip_with("pieces", "names", lambda p, n: F.coalesce(n, p["s"])), "")
    return new.select("doc_id", F.when(F.size("hits") > 0, laid).otherwise(t).alias("text"),
                      F.when(t.isNull(), 0).otherwise(F.size(F.filter("names", lambda n: n.isNotNull()))).cast("bigint").alias("n_private"))
