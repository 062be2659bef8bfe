import datetime
import hashlib
import re

from callscope.llm import pii
from helpers import SF, docs, needs_data, rows, table

KEY = "test key"


def network(values, radix, domain, key=KEY):
    """The permutation, said again with plain lists."""
    v, half = list(values), (len(values) + 1) // 2
    for turn in range(10):
        other = v[half:] if turn % 2 == 0 else v[:half]
        d = hashlib.sha512(",".join([key, domain, str(len(v)), str(turn), ",".join(map(str, other))]).encode()).hexdigest()
        for p in range(len(v)):
            if (p < half) == (turn % 2 == 0):
                v[p] = (v[p] + int(d[p % 21 * 6:p % 21 * 6 + 6], 16)) % radix[p]
    return v


def luhn(s):
    d = [int(c) for c in s][::-1]
    return sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])


def classes(s):
    low = [48 if c.isdigit() else 97 if c.islower() else 65 if c.isalpha() else ord(c) for c in s]
    count = [10 if c.isdigit() else 26 if c.isalpha() else 1 for c in s]
    return low, count


def shuffled(s, domain, key=KEY):
    low, count = classes(s)
    return "".join(chr(a + b) for a, b in zip(low, network([ord(c) - a for c, a in zip(s, low)], count, domain, key)))


def card(digits, key=KEY):
    body = digits[0] + shuffled(digits[1:-1], "card", key)
    return body + str(-luhn(body + "0") % 10)


def one(spark, text, key=KEY):
    return rows(pii.pseudonymise(docs(spark, [(1, text)]), key))[0][1:]


def test_cards_and_mail(spark):
    valid, digits = "4111 1111 1111 1111", "4111111111111111"
    text, n = one(spark, f"pay {valid} or {digits}, not 4111111111111112; mail Jo.Doe7@Mail.example.com.")
    spaced = re.search(r"\d{4} \d{4} \d{4} \d{4}", text).group()
    assert n == 3 and spaced.replace(" ", "") == card(digits) and card(digits) in text and "4111111111111112" in text
    assert luhn(card(digits)) % 10 == 0 and card(digits) != digits
    assert f"mail {shuffled('Jo.Doe7', 'mail')}@Mail.example.com." in text


def test_numbers_validate_again(spark):
    given = ["GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432", "DE89370400440532013000", "GB82WEST12345698765433", "219-09-9999", "666-09-9999", "000-12-3456", "900-12-3456",
             "10.20.30.40", "300.1.1.1", "0.0.0.0", "+1 (784) 555-9263", "(784) 555-9263", "784-555-9263", "+49 30 123456", "1.2.3", "v2.0.1.3.4"]
    got = {g: one(spark, f"x {g} y") for g in given}
    out = {g: t[0][2:-2] for g, t in got.items()}
    same = {g for g in given if got[g][1] == 0}
    assert same == {"GB82WEST12345698765433", "666-09-9999", "000-12-3456", "900-12-3456", "300.1.1.1", "1.2.3", "v2.0.1.3.4"}
    assert all(out[g] == g for g in same) and all(out[g] != g for g in given if g not in same and g != "0.0.0.0")
    number = lambda s: int("".join(str(int(c, 36)) for c in s[4:] + s[:4]))
    assert number(out["DE89370400440532013000"]) % 97 == 1 and number(out["GB82WEST12345698765432"]) % 97 == 1
    assert out["GB82 WEST 1234 5698 7654 32"].replace(" ", "") == out["GB82WEST12345698765432"]
    assert re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}", out["219-09-9999"])
    assert all(0 <= int(o) <= 255 for o in out["10.20.30.40"].split(".")) and 1 <= int(out["10.20.30.40"].split(".")[0]) <= 223
    phone = re.sub(r"\D", "", out["+1 (784) 555-9263"])
    assert re.fullmatch(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", out["+1 (784) 555-9263"])
    assert {phone[1:]} == {re.sub(r"\D", "", out[g]) for g in ("(784) 555-9263", "784-555-9263")}


def test_dates_are_permuted_within_their_century(spark):
    days = [datetime.date(2000, 1, 1) + datetime.timedelta(k) for k in range(0, 36525, 25)]
    got = [datetime.date.fromisoformat(r[1]) for r in sorted(rows(pii.pseudonymise(docs(spark, [(k, d.isoformat()) for k, d in enumerate(days)]), KEY)))]
    assert len(set(got)) == len(days) and all(2000 <= d.year <= 2099 for d in got) and got != days
    iso = one(spark, "2024-02-29")[0]
    y, m, d = iso.split("-")
    assert one(spark, "29.02.2024 and 02/29/2024 and 2024-02-30 and 31.04.2020") == (f"{d}.{m}.{y} and {m}/{d}/{y} and 2024-02-30 and 31.04.2020", 2)


def test_small_domains_are_permuted(spark):
    texts = [f"10.0.0.{k}" for k in range(256)]
    got = [r[1] for r in sorted(rows(pii.pseudonymise(docs(spark, list(enumerate(texts))), KEY)))]
    assert len(set(got)) == 256
    assert got != [r[1] for r in sorted(rows(pii.pseudonymise(docs(spark, list(enumerate(texts))), "another key")))]


def test_odd_rows(spark):
    d = docs(spark, [(1, None), (2, ""), (3, "no data here: 12, 3.5 and id 99"), (None, "a@b.co"), (4, ("word " * 30000) + "a@b.co a@b.co"), (4, "a@b.co")]).selectExpr("*", "1 AS hits", "2 AS names")
    got = sorted(rows(pii.pseudonymise(d, KEY)), key=repr)
    new = shuffled("a", "mail") + "@b.co"
    assert [r[2] for r in got if r[0] == 1] == [0] and (1, None, 0) in got and (2, "", 0) in got and (3, "no data here: 12, 3.5 and id 99", 0) in got
    assert (None, new, 1) in got and (4, new, 1) in got and (4, "word " * 30000 + f"{new} {new}", 2) in got
    assert rows(pii.pseudonymise(d.limit(0), KEY)) == []


@needs_data
def test_query_equals_brute_force(spark):
    """Mail, cards, addresses and phones of the whole table, replaced by plain Python."""
    from callscope.llm.queries import QUERIES
    key = "pseudonyms of the registered query"

    def address(s):
        v = [int(x) for x in s.split(".")]
        if max(v) > 255:
            return s
        low, count = ([1, 0, 0, 0], [223, 256, 256, 256]) if 1 <= v[0] <= 223 else ([v[0], 0, 0, 0], [1, 256, 256, 256])
        return ".".join(str(a + b) for a, b in zip(low, network([x - a for x, a in zip(v, low)], count, "ip", key)))

    def phone(s):
        d = re.sub(r"\D", "", s)[1:]
        low = [50 if i in (0, 3) and c >= "2" else 48 for i, c in enumerate(d)]
        count = [(8 if c >= "2" else 2) if i in (0, 3) else 10 for i, c in enumerate(d)]
        new = iter("1" + "".join(chr(a + b) for a, b in zip(low, network([ord(c) - a for c, a in zip(d, low)], count, "phone1", key))))
        return re.sub(r"\d", lambda _: next(new), s)

    def plain(text):
        text = re.sub(r"(?<![\w.+])(\w[\w.]*)@(?=\w+\.\w)", lambda m: shuffled(m[1], "mail", key) + "@", text)
        text = re.sub(r"\+1 \(\d{3}\) \d{3}-\d{4}", lambda m: phone(m[0]), text)
        text = re.sub(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)", lambda m: address(m[0]), text)
        return re.sub(r"\b\d{16}\b", lambda m: card(m[0], key) if luhn(m[0]) % 10 == 0 else m[0], text)

    got = {r[0]: r[1] for r in rows(QUERIES["op5_pseudonyms"](spark, SF))}
    for r in table(spark, "documents").collect():
        assert got[r.doc_id] == plain(r.text), r.doc_id
