"""Personal data and secrets: plain patterns against the stated expressions, disguises and nested encodings by example."""

import base64
import gzip
import hashlib
import random
import re
import time
import urllib.parse
import zlib

import pyarrow as pa
import pytest

from twinframe.llm import pii, secrets
from twinframe.llm.offsets import Rewritten


def luhn(digits):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def plain_pii(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]


def plain_secrets(t):
    name = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_key", "apikey"))
    out = [(m.start(), 0, m.end()) for m in re.finditer(rf"""({name})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def test_plain_patterns(spark):
    rng = random.Random(7)
    bits = ["a@b.c", "@", ".", "-", "+1 (2) 345-67 89", "1.2.3.4", "0256.1.1.1", "4111 1111-1111 1111", "9", " ", "é", "x_y", "5" * 7]
    keys = ["password", "=", ":", "'", "ToKeN", " ", "abcdef", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "api_key", "ſecret", ".", "%"]
    for _ in range(3000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert pii.plain_spans(t) == plain_pii(t), t
        t = "".join(rng.choice(keys) for _ in range(rng.randint(0, 14)))
        assert secrets.plain_spans(t) == plain_secrets(t), t


@pytest.mark.parametrize("text,kind,span", [
    ("mail jo.doe (at) exa-mple [dot] com now", "email", "jo.doe (at) exa-mple [dot] com"),
    ("write jo at mail dot co dot uk ok", "email", "jo at mail dot co dot uk"),
    ("call plus one two three four five six seven eight nine zero", "phone", "plus one two three four five six seven eight nine zero"),
    ("see ｊｏ＠ｍａｉｌ．ｃｏｍ there", "email", "ｊｏ＠ｍａｉｌ．ｃｏｍ"),
    ("j​o@ma​il.com!", "email", "j​o@ma​il.com"),
    ("pay four" + " one" * 15 + " now", "card", "four" + " one" * 15),
    ("host 10[.]0".replace("[.]", "(dot)") + "(dot)0(dot)1 x", "ip", "10(dot)0(dot)0(dot)1"),
    ("jо@mail.com", "email", "jо@mail.com"),
])
def test_disguises(text, kind, span):
    _, found = pii.find_spans(text)
    assert (pii.KINDS.index(kind), text.index(span), text.index(span) + len(span)) in found
    assert pii.maybe_disguised(__import__("pyarrow").array([text])) == [True]
    assert pii.TAGS[pii.KINDS.index(kind)] in pii.redact(text)


@pytest.mark.parametrize("text,kind,plain", [
    ("jоhn@example.com", "email", "hn@example.com"), ("john@mail.exаmple.com", "email", "john@mail.ex"),
    ("１92.168.0.1", "ip", "92.168.0.1"), ("+1 555 123 456７", "phone", "+1 555 123 456"),
])
def test_longer_span_beside_plain_one(text, kind, plain):
    at = 4 + text.index(plain)
    text, k = f"see {text} there", pii.KINDS.index(kind)
    base, found = pii.find_spans(text)
    assert base == [(k, at, at + len(plain))] and set(found) == {*base, (k, 4, len(text) - 6)}
    assert pii.redact(text) == f"see {pii.TAGS[k]} there"


@pytest.mark.parametrize("hidden,kind", [
    ("jo [at] mail dot com", "email"), ("jo at mail [dot] com", "email"), ("jo@mail dot com", "email"),
    ("jo at mail.com", "email"), ("10 dot 0 dot 0 dot 1", "ip"), ("10 dot 0.0 [dot] 1", "ip"),
    ("jo dot doe at mail dot co dot uk", "email"), ("jo at 10 dot 0 dot 0 dot 1", "email"),
])
def test_mixed_signs(hidden, kind):
    text, k = f"(see) {hidden}, there", pii.KINDS.index(kind)
    assert (k, 6, 6 + len(hidden)) in pii.find_spans(text)[1]
    assert pii.maybe_disguised(pa.array([text])) == [True] and pii.redact(text) == f"(see) {pii.TAGS[k]}, there"


@pytest.mark.parametrize("hidden,kind", [
    ("+1 (five five five) one two three four five six", "phone"), ("+1 five five five 123 4567", "phone"),
    ("plus one, five five five, 123, four five 67", "phone"), ("+one five-five-five.one two three.4567", "phone"),
    ("one nine two dot one six eight dot one dot one", "ip"), ("one nine two.168.one.1", "ip"), ("10 (dot) zero (dot) 0 (dot) one", "ip"),
    ("four one one one 1111 one one one one, 1111", "card"), ("4111-1111-1111-111 one", "card"),
])
def test_short_spelled_groups(hidden, kind):
    text, k = f"see: {hidden}; there", pii.KINDS.index(kind)
    assert (k, 5, 5 + len(hidden)) in pii.find_spans(text)[1]
    assert pii.maybe_disguised(pa.array([text])) == [True] and pii.redact(text) == f"see: {pii.TAGS[k]}; there"


def test_many_spans():
    """Plain and disguised addresses side by side: each disguised one is searched among the plain ones, not compared with all."""
    text = "jo@mail.com, jo (at) mail.com; " * 20_000
    begun = time.process_time()
    plain, found = pii.find_spans(text)
    assert time.process_time() - begun < 10
    assert len(plain) == 20_000 and set(found) - set(plain) == {(0, 31 * k + 13, 31 * k + 29) for k in range(20_000)}


def test_spelled_prose():
    for text in ["one of 12 or two, 3 or four", "one (two) three.Four", "room 5 one, plus 3 more", "chapter one two 34 plus two"]:
        assert pii.find_spans(text) == ([], []) and pii.redact(text) == text


def test_written_at_needs_a_host():
    for text in ["open at 9.30 or at 10.15 on the dot there", "landed at U.S bases", "at 3.5 dot 7"]:
        assert pii.find_spans(text) == ([], [])


def test_prose_is_left_alone():
    for text in ["one two or three at home", "we met at noon on the dot", "at (a) or [b]", "I met one one day", "année zéro"]:
        assert pii.find_spans(text) == ([], []) and pii.redact(text) == text


PLAIN = "password=hunter2secret"
B64 = base64.b64encode(PLAIN.encode()).decode()


@pytest.mark.parametrize("hidden", [
    B64, base64.b64encode(gzip.compress(PLAIN.encode())).decode(), base64.b64encode(zlib.compress(PLAIN.encode())).decode(),
    "".join(f"\\u{ord(c):04x}" for c in PLAIN), urllib.parse.quote(base64.b64encode(b"  " + PLAIN.encode()).decode(), safe=""),
    urllib.parse.quote("".join(f"\\u{ord(c):04x}" for c in PLAIN)),
    base64.b64encode(base64.b64encode(gzip.compress(gzip.compress(PLAIN.encode())))).decode(),
])
def test_nested_encodings(hidden):
    text = f"é so {hidden} end"
    plain, found = secrets.find_spans(text)
    assert any(k == 0 and s >= 5 and e <= len(text) - 4 and text[s:e] in hidden for s, k, e in found if (s, k, e) not in plain)


def found_in(hidden):
    text = f"é so {hidden} end"
    plain, found = secrets.find_spans(text)
    return any(k == 0 and s >= 5 and e <= len(text) - 4 for s, k, e in found if (s, k, e) not in plain)


RAW = PLAIN.encode()


@pytest.mark.parametrize("data", [
    zlib.compress(zlib.compress(RAW)), gzip.compress(zlib.compress(RAW)), zlib.compress(gzip.compress(zlib.compress(RAW))),
    gzip.compress(b"first member ") + gzip.compress(RAW), b"x^ " + RAW, b"jo\0" + RAW, b"jo\x01" + RAW + b"\x7f",
    PLAIN.encode("utf-16"), PLAIN.encode("utf-16-le"), PLAIN.encode("utf-16-be"), zlib.compress(PLAIN.encode("utf-16")),
    gzip.compress(b"\xff\x80 " + RAW),
])
def test_layers_of_bytes(data):
    assert found_in(base64.b64encode(data).decode())


NOISE = "".join(random.Random(3).choices("ghijklmnop qrstuvw", k=400))


@pytest.mark.parametrize("end", ["\n", "\r\n", "\n  "])
@pytest.mark.parametrize("width", [64, 75, 76])
@pytest.mark.parametrize("data", [
    b"n" * 45 + b" " + RAW, RAW.rjust(96), gzip.compress((NOISE + PLAIN).encode()), zlib.compress((NOISE + PLAIN + NOISE).encode()),
])
def test_wrapped_base64(data, width, end):
    code = base64.b64encode(data).decode()
    lines = [code[k:k + width] for k in range(0, len(code), width)]
    for before, behind in (("", ""), ("BEGIN-----\n", "\n-----END"), ("data: ", "\nprose")):
        text = before + end.join(lines) + behind
        at = len(before), len(before) + len(end.join(lines))
        spans = [(s, e) for s, k, e in secrets.find_spans(text)[1] if k == 0]
        assert any(at[0] <= s and e <= at[1] + len(behind) for s, e in spans), text
        if not behind and width < 75:
            assert at in spans


def test_layers_end():
    text = "%2525252541 \\u005cu0041 " + B64
    assert secrets.find_spans(text)[1]
    bomb = base64.b64encode(gzip.compress(b"a" * (secrets.LARGEST_LAYER + 1))).decode()
    assert secrets.find_spans(bomb) == (secrets.plain_spans(bomb),) * 2


def test_rewritten_maps_back():
    text = Rewritten("ab--cd--ef", [(2, 4, "#"), (6, 8, "")])
    assert text.text == "ab#cdef"
    assert text.source(0, 3) == (0, 4) and text.source(2, 3) == (2, 4) and text.source(3, 6) == (4, 9)


def test_tables(spark, documents):
    rows = [(1, "a@b.c +1 234 567 890"), (2, None), (3, ""), (None, "é 1.2.3.4"), (1, "a@b.c +1 234 567 890"), (4, "x" * 60_000)]
    got = sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.spans, r.base_sha256) for r in pii.personal_data(documents(rows)).collect()), key=repr)
    spans = {1: "email:0:5,phone:6:20", None: "ip:2:9"}
    assert [g[5] for g in got] == [spans.get(g[0], "") for g in got] and len(got) == len(rows)
    assert all(g[6] == hashlib.sha256(g[5].encode()).hexdigest() for g in got)
    clean = {r.doc_id: r for r in pii.redacted(documents(rows)).collect()}
    assert clean[1].text == "<EMAIL> <PHONE>" and clean[1].n_chars == 15 and clean[2].text is None and clean[1].bucket == 1
    hidden = secrets.secret_spans(documents([*rows, (9, PLAIN)])).collect()
    assert {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.spans) for r in hidden}[9] == (1, 0, 0, "assign:0:22")
    assert pii.personal_data(documents(rows).limit(0)).collect() == secrets.secret_spans(documents(rows).limit(0)).collect() == []
