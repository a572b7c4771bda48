import random
import re
import time

import pytest

from apexframe.llm import personal

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    return [
        [m.span() for m in EMAIL.finditer(text)],
        [m.span() for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))],
        [m.span() for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and personal.luhn(digits(m[0]))],
        [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15],
    ]


def test_base_spans_equal_the_patterns(texts):
    random.seed(1)
    own = ["".join(random.choice("a@.-1234 +()%b0é") for _ in range(random.randint(0, 40))) for _ in range(20000)]
    for text in [*own, *texts.values(), "4111 1111-1111 1111 1.2.3.4.5 a@b@c.d +1 (23) 456-7890"]:
        assert personal.base_spans(text) == brute(text), text


@pytest.mark.parametrize("text, kind, found", [
    ("write to john.doe at example dot com now", "email", "john.doe at example dot com"),
    ("john [at] example [dot] com", "email", "john [at] example [dot] com"),
    ("x jоhn@exаmple.com y", "email", "jоhn@exаmple.com"),
    ("write to john @ example.com now", "email", "john @ example.com"),
    ("write to john@ mail.example.cloud now", "email", "john@ mail.example.cloud"),
    ("john at example.com", "email", "john at example.com"),
    ("please mail john at example.com today", "email", "john at example.com"),
    ("ask john.doe2 at example.museum today", "email", "john.doe2 at example.museum"),
    ("ask john dot doe at example.com today", "email", "john dot doe at example.com"),
    ("ask john at example dot cloud today", "email", "john at example dot cloud"),
    ("john@example dot photography", "email", "john@example dot photography"),
    ("j​ohn@ex​ample.com", "email", "j​ohn@ex​ample.com"),
    ("ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
    ("call plus four four two zero seven nine four six zero nine five", "phone", "plus four four two zero seven nine four six zero nine five"),
    ("４１１１１１１１１１１１１１１１", "card", "４１１１１１１１１１１１１１１１"),
    ("go to 192 dot 168 dot 1 dot 1 now", "ip", "192 dot 168 dot 1 dot 1"),
])
def test_disguises_map_back_to_the_source(text, kind, found):
    base, every = personal.find_spans(text)
    assert not any(base)
    spans = every[personal.KINDS.index(kind)]
    assert [text[a:b] for a, b in spans] == [found]
    assert found not in personal.masked_text(text) and f"[{kind.upper()}]" in personal.masked_text(text)


@pytest.mark.parametrize("text, found", [
    ("call plus 44 20 7946 0958", "plus 44 20 7946 0958"),
    ("call más 34 912 345 678", "más 34 912 345 678"),
    ("call +44 20 seven 946 0958", "+44 20 seven 946 0958"),
    ("call +44 20 7946…0958", "+44 20 7946…0958"),
])
def test_one_disguise_alone_is_enough(text, found):
    _, every = personal.find_spans(text)
    assert [text[a:b] for a, b in every[3]] == [found]


def test_spans_do_not_depend_on_unrelated_text():
    random.seed(3)
    parts = ["plus", "más", "+44", "20", "7946", "0958", "seven", "Four", "dos", "(at)", "[ dot ]", "dot", "at", "@", "john", "example", "com", ".", "…", "ſ", "é", "j​o", "4111111111111111", "1.2.3.4", "(", "-"]
    for _ in range(20000):
        text = "".join(random.choice(parts) + random.choice(["", " ", " ", "  "]) for _ in range(random.randint(1, 12)))
        # Behind a line that opens every step, the same spans have to be there.
        alone, later = personal.find_spans(text)[1], personal.find_spans(text + "\n#\nω (at) dot plus seven\n")[1]
        assert [[(a, b) for a, b in kind if b <= len(text)] for kind in later] == alone, text


@pytest.mark.parametrize("text", ["look at the dot on it", "one two three", "été à la une", "meet at noon.", "dot dot dot"])
def test_clean_texts_stay(text):
    assert personal.masked_text(text) == text


@pytest.mark.parametrize("text", ["see more at example.com", "we read it at example.com today", "contact us at example.com", "3 apples @ 1.50 each", "look at a dot near it", "sit @ home. Then go", "he is at home. The dot on it"])
def test_words_before_a_site_or_a_dot_stay(text):
    assert personal.masked_text(text) == text


def test_base_spans_stay_among_all(texts):
    for text in texts.values():
        base, every = personal.find_spans(text)
        assert all(set(b) <= set(e) for b, e in zip(base, every))


def test_long_texts_take_linear_time():
    for text in ("1" * 200_000, "a" * 300_000 + "@", "1 " * 100_000, "one " * 50_000, "+1 " * 50_000, "0" * 6000 + ".1.1.1"):
        personal.find_spans(text)


def test_long_disguises_take_linear_time():
    for text in (" " * 200_000 + "(x", "a dot " * 50_000, "a at " * 50_000, "at dot " * 50_000, "x at " + "dot " * 100_000, "a.a at b.c " * 20_000, " @ " * 50_000, "a@" + " " * 100_000, "plus " * 50_000, "[" * 100_000 + "at", "1 2 " * 50_000 + "one"):
        personal.find_spans(text)


def test_edges(edges, nothing):
    rows = personal.personal_data(edges).collect()
    assert len(rows) == edges.count() and all(r.spans == "" for r in rows)
    masked = personal.mask(edges)
    assert masked.columns == edges.columns and sorted(map(str, masked.collect())) == sorted(map(str, edges.collect()))
    assert personal.mask(nothing).count() == 0 and personal.personal_data(nothing).count() == 0


def test_addresses_of_spelled_numbers_keep_their_dots():
    for text in ("see 192.168.one.one now", "server 10.0.zero.five."):
        every = personal.find_spans(text)[1]
        assert [text[a:b] for a, b in every[personal.KINDS.index("ip")]] == [text.split()[1].rstrip(".")]


def test_many_real_spans_and_one_disguise_take_linear_time():
    """Also the same spans as a comparison with every span taken gives."""

    def text(n):
        return "\u0391 " + " ".join(f"user{k}@mail{k % 7}.example.org" for k in range(n)) + " me (at) example (dot) org"

    seconds = []
    for n in (5_000, 50_000):
        start = time.perf_counter()
        base, every = personal.find_spans(text(n))
        seconds.append(time.perf_counter() - start)
        assert len(base[0]) == n and len(every[0]) == n + 1
    assert seconds[1] < 40 * seconds[0]


@pytest.mark.parametrize(
    "text, kind, found",
    [
        ("card 4l11 1111 1111 1111 lol", "card", "4l11 1111 1111 1111"),
        ("card 4111-1I11-1111-11|1.", "card", "4111-1I11-1111-11|1"),
        ("call +44 2O 7946 o958 I said", "phone", "+44 2O 7946 o958"),
        ("host 10.O.0.1l up", "ip", "10.O.0.1l"),
        ("server 10 dot 0 dot zero dot five up", "ip", "10 dot 0 dot zero dot five"),
        ("server at 10 dot 0 dot zero dot five up", "ip", "10 dot 0 dot zero dot five"),
        ("one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one"),
    ],
)
def test_posing_digits_and_spelled_dots(text, kind, found):
    every = personal.find_spans(text)[1]
    at = text.index(found)
    assert [len(x) for x in every] == [int(k == kind) for k in personal.KINDS]
    assert every[personal.KINDS.index(kind)] == [(at, at + len(found))]


@pytest.mark.parametrize("text", ["lol 10l of oil", "I ran 10 I 20 o 30", "Illo 1o lO", "4l12 1111 1111 1111", "one dot two dot three"])
def test_words_like_digits_stay(text):
    assert not any(personal.find_spans(text)[1])


def test_posing_digits_take_linear_time():
    for text in ("|" * 200_000 + "x", "1l " * 60_000, "l " * 100_000 + "1l", "1l." * 60_000 + "x", "one" + " " * 200_000 + "dot", "one dot " * 40_000, "1 dot " * 40_000):
        began = time.process_time()
        personal.find_spans(text)
        assert time.process_time() - began < 5
