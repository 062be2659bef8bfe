"""Personal data side by side: no match takes a part of the next."""
from callscope.llm import pii
from helpers import docs, rows
from test_pii import KEY

PAIRS = [
    ("+1 (826) 555-4081", "190.137.223.204", 2), ("+49 30 123456", "170.106.47.218", 2), ("+1 784 555 9263", "2024", 1),
    ("+44 20 7946 0958", "22", 1), ("+1 784 555 9263", "2024-02-29", 2), ("+49 30 123456", "4111 1111 1111 1111", 2),
    ("4111 1111 1111 1111", "123", 1), ("378282246310005", "1234", 1), ("378282246310005", "5500 0000 0000 0004", 2),
    ("4111 1111 1111 1111", "29.02.2024", 2), ("4111 1111 1111 1111", "190.137.223.204", 2), ("4111 1111 1111 1111", "123@mail.example", 2),
    ("BE68 5390 0754 7034", "EUR", 1), ("BE68539007547034", "2024", 1), ("AB12", "4111 1111 1111 1111", 1),
]


def test_neighbours_are_replaced_as_if_alone(spark):
    texts = sorted({t for a, b, _ in PAIRS for t in (a, b, f"{a} {b}")})
    got = {texts[r[0]]: r[1:] for r in rows(pii.pseudonymise(docs(spark, list(enumerate(texts))), KEY))}
    for a, b, n in PAIRS:
        assert got[f"{a} {b}"] == (f"{got[a][0]} {got[b][0]}", n), (a, b)
