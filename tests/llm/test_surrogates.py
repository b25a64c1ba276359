"""Surrogates against entities that were put into texts at known places."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.llm import pii


def replaced(spark, texts, key="key"):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return [r.text for r in pii.replace(df, key).orderBy("doc_id").collect()]


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10


def mod97(plain):
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


def valid_card(rng):
    head = "4" + "".join(map(str, rng.integers(0, 10, 14)))
    return head + str(-luhn(head + "0") % 10)


def valid_iban(rng):
    tail = "".join(map(str, rng.integers(0, 10, 18)))
    return f"DE{98 - mod97('DE00' + tail):02d}{tail}"


def entities(rng):
    """(kind, text, parts to be found) of each kind, drawn anew."""
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    w = lambda n: "".join(rng.choice(list("abcdefghijklmnop"), n))
    given = pii.GIVEN_NAMES["female_latin"].split()[int(rng.integers(0, 60))]
    other = pii.GIVEN_NAMES["male_cyrillic"].split()[int(rng.integers(0, 20))]
    card, iban = valid_card(rng), valid_iban(rng)
    return [
        ("email", f"{w(5)}.{w(3)}@{w(6)}.example.org"), ("ip", ".".join(str(x) for x in rng.integers(1, 255, 4))), ("ipv6", "2001:db8:" + ":".join(f"{x:x}" for x in rng.integers(16, 65536, 6))),
        ("phone", f"+49 170 {d(4)} {d(4)}"), ("phone", f"{rng.integers(2, 9)}{d(2)}-{d(3)}-{d(4)}"), ("phone", f"415 {d(3)} {d(4)}"), ("national_id", f"{d(3)}-{d(2)}-{d(4)}"),
        ("iban", iban), ("iban", " ".join(iban[k : k + 4] for k in range(0, 22, 4))), ("card", card), ("card", " ".join(card[k : k + 4] for k in range(0, 16, 4))), ("secret", "".join(rng.choice(list("0123456789abcdef"), 40))),
        ("female_latin", f"{given} {w(6).title()}"), ("female_latin", f"{given.upper()} {w(6).upper()}"), ("male_cyrillic", f"{other} {''.join(rng.choice(list('абвгдежз'), 7)).title()}"),
    ]


def form(kind, text):
    if kind == "ip":
        return len(text.split("."))
    if kind.endswith(("latin", "cyrillic")):
        return [(t.istitle(), t.isupper(), bool(re.search("[а-я]", t.lower()))) for t in text.split()]
    hexed = kind in ("ipv6", "secret")
    return ["x" if hexed and c.isalnum() else "d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else c for c in text]


def canon(kind, text):
    return re.sub(r"[^\w]", "", text).upper() if kind in ("phone", "iban", "card", "national_id") else text.lower()


def test_known_entities_and_nothing_else(spark):
    rng = np.random.default_rng(4)
    pool = [e for _ in range(6) for e in entities(rng)]
    cases = []
    for _ in range(60):
        chosen = [pool[int(k)] for k in rng.integers(0, len(pool), int(rng.integers(0, 6)))]
        gaps = [f"; note {w} about apples, 12 of them: " for w in rng.choice(list("qrstuv"), len(chosen) + 1)]
        cases.append((gaps, chosen))
    texts = ["".join(g + e for g, (_, e) in zip(gaps, [*chosen, ("", "")], strict=True)) for gaps, chosen in cases]
    made, shapes = {}, True
    for got, (gaps, chosen) in zip(replaced(spark, texts), cases, strict=True):
        pattern = "(.+)".join(map(re.escape, gaps))
        found = re.fullmatch(pattern, got, re.S)
        assert found, (got, gaps)
        for (kind, was), now in zip(chosen, found.groups(), strict=True):
            assert made.setdefault((kind, canon(kind, was)), canon(kind, now)) == canon(kind, now)
            shapes &= form(kind, was) == form(kind, now)
            if kind == "card":
                assert luhn(re.sub(r"\D", "", now)) == 0
            if kind == "iban":
                assert mod97(now.replace(" ", "")) == 1
    assert shapes and len(set(made.values())) == len(made)
    assert not set(made.values()) & {c for _, c in made}


def test_mentions_of_a_part_of_a_name(spark):
    text = "Anna Keller met Bob Jones. Ms Keller (KELLER, Keller's) and Jones spoke; Anna left. Kellerman and Annabel stayed."
    (got,) = replaced(spark, [text])
    first = re.match(r"(\w+) (\w+) met (\w+) (\w+)\. ", got)
    anna, keller, bob, jones = first.groups()
    assert got == f"{anna} {keller} met {bob} {jones}. Ms {keller} ({keller.upper()}, {keller}'s) and {jones} spoke; {anna} left. Kellerman and Annabel stayed."
    assert {anna, keller, jones}.isdisjoint({"Anna", "Keller", "Jones"})
    # Alone, without a full name in the text, a word is no name.
    assert replaced(spark, ["Keller and Anna and Jones"]) == ["Keller and Anna and Jones"]


@pytest.mark.parametrize("name", ["Maria Lopez", "MARIA LOPEZ", "Bob Jones", "Priya Sharma", "Wei Zhang", "Anna McDonald", "Sarah O'Neill", "Peter van der Berg", "Michael J. Fox", "Eva Meyer-Schmidt", "Juan Garcia Lopez", "Екатерина Иванова"])
def test_names(spark, name):
    (got,) = replaced(spark, [f"it was {name}, not me"])
    now = re.fullmatch(r"it was (.+), not me", got)[1]
    assert len(now.split()) == len(name.split()) and now.isupper() == name.isupper()
    assert not {w for w in re.findall(r"\w{3,}", name) if w not in ("van", "der")} & set(re.findall(r"\w{3,}", now))


def test_addresses_and_numbers(spark):
    texts = ["at 2001:db8::1 or ::ffff:1", "call 415 555 0000 or 030 1234567", "order 1234567890123 of 2024", "12:30:45 and a::b in code", "ratio 1:2:3"]
    assert luhn("1234567890123") != 0
    got = replaced(spark, texts)
    assert "2001" not in got[0] and re.fullmatch(r"at [0-9a-f]{4}:[0-9a-f]{3}::[0-9a-f] or ::[0-9a-f]{4}:[0-9a-f]", got[0])
    assert re.fullmatch(r"call \d{3} \d{3} \d{4} or \d{3} \d{7}", got[1]) and got[1] != texts[1]
    assert got[2] == texts[2] and got[4] == texts[4]


def test_control_characters(spark):
    texts = ["\x01 a.b@mail.org \x02\x03 10.0.0.1", "a.b@mail.org \x01", "a.b@mail.org"]
    got = replaced(spark, texts)
    mail = got[2]
    assert got[1] == f"{mail} \x01" and got[0].startswith(f"\x01 {mail} \x02\x03 ") and mail != texts[2]


def test_few_free_addresses(spark):
    """All addresses of one letter at one host of one letter: there is none left of the same length."""
    texts = [f"{a}@{b}.com" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    got = replaced(spark, texts)
    assert len(set(got)) == 676 and not set(got) & set(texts) and all(re.fullmatch(r"[a-z]+@[a-z]\.com", x) for x in got)


def test_no_free_number_gives_a_code(spark, monkeypatch):
    monkeypatch.setattr(pii, "ATTEMPTS", 2)
    monkeypatch.setattr(pii, "_draw", lambda digest, at: F.lit(3))
    texts = [f"{k:03d}-12-3456" for k in range(5)]
    got = replaced(spark, texts)
    coded = [x for x in got if re.fullmatch(r"\[national_id-[0-9a-f]{32}\]", x)]
    assert len(set(got)) == 5 and len(coded) == 4 and not set(got) & set(texts)
