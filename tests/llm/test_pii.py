import hashlib
import random
import re
import time

import pytest
from conftest import odd_rows

from tidewatch.llm import pii

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def plain(text):
    def digits(s):
        return re.sub("[^0-9]", "", s)

    def luhn(s):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(s))) % 10 == 0

    return {
        "email": [m.span() for m in re.finditer(EMAIL, text)],
        "ip": [m.span() for m in re.finditer(IP, text) if all(int(x) <= 255 for x in m.group().split("."))],
        "card": [m.span() for m in re.finditer(CARD, text) if 16 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))],
        "phone": [m.span() for m in re.finditer(PHONE, text) if 8 <= len(digits(m.group())) <= 15],
    }


def test_detectors_equal_the_patterns():
    r = random.Random(3)
    words = ["4111 1111-1111 1111", "1.2.3.4.5.6.7.8", "a@b.c_d@e.f", "256.1.1.1", "0012.1.1.1", "+1 (555) 123-4567", "é", ""]
    for _ in range(20_000):
        text = "".join(r.choice("ab1.@-+ 4_(é") for _ in range(r.randrange(40))) + " ".join(r.choice(words) for _ in range(3))
        assert pii.detect(text) == plain(text), text


@pytest.mark.parametrize(
    "text, kind, found",
    [
        ("mail john (at) example (dot) com now", "email", "john (at) example (dot) com"),
        ("john [at] example [dot] co [dot] uk", "email", "john [at] example [dot] co [dot] uk"),
        ("write to john at example dot com today", "email", "john at example dot com"),
        ("bob @ example . com", "email", "bob @ example . com"),
        ("x іvan＠exаmple.com y", "email", "іvan＠exаmple.com"),
        ("j​ohn@exa​mple.com", "email", "j​ohn@exa​mple.com"),
        ("call plus four four two oh seven one two three four", "phone", "plus four four two oh seven one two three four"),
        ("no 4111 1111 1111 one one one one .", "card", "4111 1111 1111 one one one one"),
        ("４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("host 192 dot 168 dot one dot one up", "ip", "192 dot 168 dot one dot one"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, found):
    base, more = pii.find(text)
    assert not base[kind]
    assert [text[a:b] for a, b in more[kind]] == [found]


@pytest.mark.parametrize(
    "text",
    ["Look at the dot. One at home", "Привет, как дела в Москве", "at one point two people", "Été à l'école, où ça?", "see it.then go", "f(at) x and y", "a (dot) b"],
)
def test_prose_stays_clean(text):
    base, more = pii.find(text)
    assert not any(base.values()) and not any(more.values())


def test_added_spans_never_touch_base_spans():
    text = "joe@example.com (dot) org and 4111 1111 1111 1111 one one one"
    base, more = pii.find(text)
    assert base == plain(text)
    for kind in pii.KINDS:
        spans = sorted(base[kind] + more[kind])
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


@pytest.mark.parametrize(
    "found, kind",
    [
        ("jоhn@example.com", "email"),
        ("john@example.cоm", "email"),
        ("joe@example.com (dot) org", "email"),
        ("+49 151 1234５６７８", "phone"),
        ("john@ex.a\u200bmple.com", "email"),
    ],
)
def test_disguised_parts_of_an_identifier_widen_it(found, kind):
    text = f"a {found} z"
    base, _, wider = pii.find_whole(text)
    assert base == plain(text)
    assert [text[a:b] for a, b in wider[kind]] == [found]
    assert pii.masked(text) == f"a <{kind}> z"


@pytest.mark.parametrize(
    "found, kind",
    [
        ("+49 one 5 one 2 three 4 5678", "phone"),
        ("plus four nine 151 two three 4 five 678", "phone"),
        ("plus  four four   two oh seven one\ntwo three four", "phone"),
        ("4111 1111 1111 one 1 one 1", "card"),
        ("four111 1111 1111 1111", "card"),
        ("192 dot 1 six eight dot one   dot\none", "ip"),
        ("john at example dot com", "email"),
        ("john  at\nexample  dot\tcom", "email"),
        ("john [at]\n  example    [dot] com", "email"),
        ("john dot smith at example dot com", "email"),
        ("john dot q dot smith @ example.com", "email"),
        ("j" * 80 + " at " + " dot ".join("abcdefgh") + " dot " + "k" * 70, "email"),
    ],
)
def test_mixed_and_long_disguises_are_found_as_a_whole(found, kind):
    base, more, _ = pii.find_whole(f"a: {found} z")
    assert not base[kind] and [f"a: {found} z"[a:b] for a, b in more[kind]] == [found]


@pytest.mark.parametrize("text", ["10.0.0.1 one two", "for one two@x.com", "see a@x.one two three", "one two.b@x.com", "one\ntwo@x.com", "+1 555 123 4567, one of us"])
def test_spelled_digits_leave_addresses_beside_them_alone(text):
    base, more, wider = pii.find_whole(text)
    assert any(base.values()) and not any(more.values()) and not any(wider.values())


@pytest.mark.parametrize("piece", ["one 1 ", "1 ", "one ", " ", "one" + " " * 50, "a dot ", "a at ", "at dot ", "a at b dot ", "x at a . at . ", "1 dot ", "plus ", "- ", "[ "])
def test_disguises_take_linear_time(piece):
    text = piece * (400_000 // len(piece)) + "one dot at @ x"
    start = time.process_time()
    pii.undo_disguises(text)
    assert time.process_time() - start < 10


def test_wider_spans_are_among_the_added_ones_of_documents(docs):
    row = pii.find_in_documents(docs([(1, "jоhn@example.com")])).first()
    assert row["spans"] == "email:0:16,email:2:16" and [s["start"] for s in row["added"]] == [0]
    assert row["base_sha256"] == hashlib.sha256(b"email:2:16").hexdigest()


def test_long_texts_take_linear_time():
    for text in ("a" * 300_000 + "@", "1." * 150_000, "1 " * 150_000, "+" * 300_000, "+1(" * 100_000, "one " * 80_000, "é" * 300_000):
        assert pii.detect(text) == pii.detect(text + " ")
        pii.find(text)


def test_masks():
    assert pii.masked("mail joe@example.com or call +1 555 123 4567") == "mail <email> or call <phone>"
    assert pii.masked(None) is None and pii.masked("") == ""


def test_documents(docs):
    got = pii.find_in_documents(docs([*odd_rows(), (9, "a@b.co")])).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(got) == 11 and sum(r["base_sha256"] == empty for r in got) == 10
    assert [r["spans"] for r in got if r["doc_id"] == 9] == ["email:0:6"]
    assert pii.find_in_documents(docs([])).count() == 0
    rows = pii.mask_documents(docs([(1, "a@b.co"), (2, None)])).orderBy("doc_id").collect()
    assert [r["text"] for r in rows] == ["<email>", None] and rows[0]["shard"] == "s"
