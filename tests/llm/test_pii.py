"""Base detectors against the plain expressions on random strings, linear time, and disguises planted in prose."""

import random
import re
import time

import pytest

PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(d):
    odd, even = d[-1::-2], d[-2::-2]
    return (sum(map(int, odd)) + sum(sum(map(int, str(2 * int(x)))) for x in even)) % 10 == 0


def plain_spans(t):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, t):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == 2 and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == 3 and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_equals_the_plain_expressions():
    from clausework.llm.pii import base_spans, spans_of

    rnd = random.Random(5)
    parts = ["4111 1111 1111 1111", "a", "@", ".", "b.co", "-", " ", "1", "255", "256", "007", "+", "(", ")", "+1 (614) 555", "8001", "x", "é", "\n", "_%", "4111-1111-1111-1111", "@@", "...", "0"]
    for _ in range(30_000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 16)))
        assert base_spans(t) == plain_spans(t), t
        assert set(plain_spans(t)) <= set(spans_of(t)[1])


@pytest.mark.parametrize(
    "text",
    ["1" * 10**6, " " * 10**6, "one two three " + "1" * 10**6, "x (at) " + " " * 10**6 + "y", "x (dot)" + " " * 10**6, "a@" * 300_000 + " (at) ", "( " * 300_000 + " dot ", "j (at) b.co " * 60_000, "а" * 10**6 + " dot ", "jo at " * 150_000 + "x (dot) y", "+1(" * 300_000 + " dot "],
    ids=range(11),
)
def test_long_texts_take_linear_time(text):
    from clausework.llm.pii import spans_of

    began = time.process_time()
    spans_of(text)
    assert time.process_time() - began < 4


def test_planted_disguises_come_out_whole_and_clean_prose_stays():
    from clausework.llm.pii import spans_of

    rnd = random.Random(7)
    word = lambda n=5: "".join(rnd.choice("bcdfghklmnprstuvw") for _ in range(n))
    names = "zero one two three four five six seven eight nine".split()
    found = clean = 0
    for i in range(300):
        address = f"{word()}.{word()}@{word(6)}.com"
        ip = ".".join(str(rnd.randrange(256)) for _ in range(4))
        phone = "+1" + "".join(rnd.choice("0123456789") for _ in range(10))
        disguise = [
            address.replace("@", " (at) ").replace(".com", " [dot] com"),
            address.replace("c", "с").replace("@", "＠"),
            address[:2] + "​" + address[2:],
            ip.replace(".", " dot "),
            "plus " + " ".join(names[int(x)] for x in phone[1:]),
        ][i % 5]
        kind = [0, 0, 0, 1, 3][i % 5]
        before = " ".join(word() for _ in range(rnd.randrange(5))) + "; "
        text = before + disguise + "; " + word()
        found += (kind, len(before), len(before) + len(disguise)) in spans_of(text)[1]
        clean += spans_of(" ".join(rnd.choice([word(), word(), "at", "dot.", "one", "10.30", "(see", "1)"]) for _ in range(12)))[1] == []
    assert found >= 298 and clean >= 290
