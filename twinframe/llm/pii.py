"""Personal data in texts, also where it is disguised, with spans in the source text.

Transducers rewrite a text step by step: look-alike characters become ASCII (one for one), invisible characters go,
runs of spelled digits become digits, and written-out signs (``(at)``, ``[dot]``, ``name at host dot tld``) become
signs. Each rewritten text knows the source of its characters, so identifiers found in the normal form are mapped back
to spans of the source. The plain patterns are applied to the source itself first; what they find always stays.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from twinframe.llm.intervals import Cover
from twinframe.llm.offsets import Rewritten
from twinframe.llm.words import as_text, by_bytes

KINDS = ("email", "ip", "card", "phone")
TAGS = ("<EMAIL>", "<IP>", "<CARD>", "<PHONE>")

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A number run is entered at its first digit only, so long runs are read once.
IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9",
}
_ONE_SPELLED = "(?:" + "|".join(f(w) for f in (str.lower, str.upper, str.capitalize) for w in SPELLED) + ")"
# A run of any length: the patterns of the identifiers decide what is prose. Parentheses and dots stay between runs.
SPELLED_RUN = re.compile(rf"(?<!\w){_ONE_SPELLED}(?!\w)(?:[ ,-]{{1,3}}{_ONE_SPELLED}(?!\w))*+")
BEFORE_RUN = re.compile(r"(?<=[0-9])[ ,-]{1,3}\Z")
BEHIND_RUN = re.compile(r"[ ,-]{1,3}(?=[0-9])")
PLUS = re.compile(r"(?<!\w)[Pp][Ll][Uu][Ss] (?=[0-9])")
WORD = re.compile(r"[A-Za-z]+")
BRACKETED = re.compile(r" ?[(\[{<] ?(at|AT|At|dot|DOT|Dot) ?[)\]}>] ?")
WRITTEN_DOT = re.compile(r" (?:dot|DOT|Dot) ")
NUMBER_DOT = re.compile(rf"(?<=[0-9]){WRITTEN_DOT.pattern}(?=[0-9])")
_SEPARATOR = rf"(?:{WRITTEN_DOT.pattern}|\.)"
HOST = re.compile(rf"[A-Za-z0-9-]++(?:{_SEPARATOR}[A-Za-z0-9-]++)+")
# Behind a written " at " only what can be a host: its last label starts with a letter, or it is an address of four numbers.
WRITTEN_AT = re.compile(
    rf"(?<=[A-Za-z0-9._%+-]) (?:at|AT|At) (?=[A-Za-z0-9-]++(?:{_SEPARATOR}[A-Za-z0-9-]++)*?{_SEPARATOR}[A-Za-z][A-Za-z0-9-]"
    r"|[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![A-Za-z0-9-]))"
)

# Letters of other scripts that look like ASCII.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d",
    "һ": "h", "ո": "n", "ɡ": "g", "ı": "i", "ο": "o", "α": "a", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "κ": "k",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "\u00a0": " ", "\u2009": " ", "\u202f": " ",
}
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad"


def _lookalikes() -> dict[int, str]:
    """The listed letters, all decimal digits, and every character whose compatibility form is one ASCII character."""
    out = {ord(k): v for k, v in LOOKALIKES.items()}
    for c in (*range(0x0660, 0x3000), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800), *range(0x1FBF0, 0x1FBFA)):
        form = unicodedata.normalize("NFKC", chr(c))
        if len(form) == 1 and 0x20 < ord(form) < 0x7F:
            out.setdefault(c, form)
        elif unicodedata.category(chr(c)) == "Nd":
            out.setdefault(c, str(unicodedata.digit(chr(c))))
    return out


TO_ASCII = _lookalikes()
DISGUISED = re.compile("[" + "".join(map(chr, sorted(TO_ASCII))) + INVISIBLE + "]")
HIDDEN = re.compile(f"[{INVISIBLE}]+")
#: Whatever a transducer can act on contains this; one linear pass over a batch spares most texts the rewriting.
HINT = (
    DISGUISED.pattern + "|" + rf"\b{_ONE_SPELLED}[ (),.-]+(?:[0-9]|{_ONE_SPELLED}\b)|[0-9][ (),.-]+{_ONE_SPELLED}\b|\+{_ONE_SPELLED}\b" + "|"
    + r"\b[Pp][Ll][Uu][Ss] [0-9]" + "|"
    + r"[(\[{<] ?(?:at|AT|At|dot|DOT|Dot) ?[)\]}>]" + "|" + WRITTEN_DOT.pattern + r"| (?:at|AT|At) [A-Za-z0-9-]+\.[A-Za-z0-9-]"
)


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str):
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            yield 0, start, end
        at = text.find("@", max(end, at + 1))


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` of what stands in ``text`` undisguised, by kind and start."""
    found = list(_emails(text)) if "@" in text else []
    if DIGIT.search(text):
        if "." in text:
            found += [(1, *m.span()) for m in IP.finditer(text) if all(map(_octet, m[0].split(".")))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and _luhn(digits):
                    found.append((2, *m.span()))
        if "+" in text:
            found += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def _digits_of(run: str) -> str:
    return "".join(SPELLED[w.lower()] for w in WORD.findall(run))


def _dots_beside_at(text: str) -> list[tuple[int, int, str]]:
    """Edits that make signs of the written dots in the name before an ``@`` and in the host behind it."""
    edits, end = [], 0
    at = text.find("@") if WRITTEN_DOT.search(text) else -1
    while at >= 0:
        host = HOST.match(text, at + 1)
        if host:
            start, dots = at, []
            while True:
                while start > end and text[start - 1] in LOCAL_CHARS:
                    start -= 1
                if not (start - 5 > end and text[start] != "@" and WRITTEN_DOT.match(text, start - 5) and text[start - 6] in LOCAL_CHARS):
                    break
                start -= 5
                dots.append((start, start + 5, "."))
            edits += dots[::-1]
            edits += [(*d.span(), ".") for d in WRITTEN_DOT.finditer(text, at + 1, host.end())]
            end = host.end()
        at = text.find("@", max(end, at + 1))
    return edits


def _spelled(text: str) -> list[tuple[int, int, str]]:
    """Edits that make digits of spelled ones; between words and digits one blank is left, which cards and phones may hold."""
    edits, at = [], 0
    for m in SPELLED_RUN.finditer(text):
        start, end = m.span()
        if gap := BEFORE_RUN.search(text, max(at, start - 4), start):
            edits.append((*gap.span(), " "))
        edits.append((start, end, _digits_of(m[0])))
        at = end
        if gap := BEHIND_RUN.match(text, end):
            edits.append((*gap.span(), " "))
            at = gap.end()
    return edits


def _plus(text: str) -> list[tuple[int, int, str]]:
    return [(*m.span(), "+") for m in PLUS.finditer(text)]


def _brackets(text: str) -> list[tuple[int, int, str]]:
    return [(*m.span(), "@" if m[1][0] in "aA" else ".") for m in BRACKETED.finditer(text)]


def _number_dots(text: str) -> list[tuple[int, int, str]]:
    return [(*m.span(), ".") for m in NUMBER_DOT.finditer(text)]


def _written_ats(text: str) -> list[tuple[int, int, str]]:
    return [(*m.span(), "@") for m in WRITTEN_AT.finditer(text)]


def normal_forms(text: str) -> list[Rewritten]:
    """The rewritings of ``text``, each of the result of the one before; none where nothing is disguised."""
    steps = []
    current = text
    if not text.isascii() and DISGUISED.search(text):
        step = Rewritten(text, [(*m.span(), "") for m in HIDDEN.finditer(text)])
        current = step.text = step.text.translate(TO_ASCII)
        steps.append(step)
    # Each step can make the next one plain: "jo at mail [dot] com", "jo [at] mail dot com", "jo at mail dot com".
    for transducer in (_spelled, _plus, _brackets, _number_dots, _dots_beside_at, _written_ats, _dots_beside_at):
        if edits := transducer(current):
            steps.append(Rewritten(current, edits))
            current = steps[-1].text
    return steps


def maybe_disguised(texts: pa.Array) -> list[bool]:
    """Which texts hold anything that a transducer acts on."""
    return pc.match_substring_regex(texts, HINT).to_pylist()


def find_spans(text: str, disguised: bool = True) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Plain spans, and all spans with those disguised ones of the normal form that lie in no plain span of their kind."""
    plain = plain_spans(text)
    steps = normal_forms(text) if disguised else []
    if not steps:
        return plain, plain
    found = set(plain)
    covers = [Cover() for _ in KINDS]
    for kind, start, end in plain:
        covers[kind].add(start, end)
    for kind, start, end in plain_spans(steps[-1].text):
        normal = steps[-1].text[start:end]
        for step in reversed(steps):
            start, end = step.source(start, end)
        if text[start:end] != normal and not covers[kind].holds(start, end):
            found.add((kind, start, end))
    return plain, sorted(found)


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def personal_data(documents: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for every row of ``documents (doc_id, text)``.

    The counts and the digest are those of the plain patterns, ``spans`` holds the disguised ones too, as
    ``kind:start:end`` in code points, by kind and start. Null and empty texts have no spans. Repeated rows are judged
    each for itself, other columns are not read, an empty table gives no rows.
    """
    rows = documents.select("doc_id", "text")

    def scan(batches):
        for whole in batches:
            for batch in by_bytes(whole):
                counts, digests, spans = [], [], []
                texts = as_text(batch.column("text"))
                for text, disguised in zip(texts.to_pylist(), maybe_disguised(texts)):
                    plain, found = find_spans(text, disguised)
                    counts.append([sum(k == kind for k, _, _ in plain) for kind in range(len(KINDS))])
                    digests.append(hashlib.sha256(joined(plain).encode()).hexdigest())
                    spans.append(joined(found))
                out = {"doc_id": batch.column("doc_id")}
                out |= {f"n_{kind}": pa.array([c[k] for c in counts], pa.int64()) for k, kind in enumerate(KINDS)}
                yield pa.RecordBatch.from_pydict(out | {"base_sha256": pa.array(digests, pa.string()), "spans": pa.array(spans, pa.string())})

    kind = rows.schema["doc_id"].dataType.simpleString()
    counts = "".join(f"n_{k} long, " for k in KINDS)
    return rows.mapInArrow(scan, f"doc_id {kind}, {counts}base_sha256 string, spans string")


def redact(text: str, disguised: bool = True) -> str:
    """``text`` with a tag in the place of each span; of overlapping spans the one that starts first gives the tag."""
    _, found = find_spans(text, disguised)
    if not found:
        return text
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in found):
        if start >= at:
            out += [text[at:start], TAGS[kind]]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(documents: DataFrame) -> DataFrame:
    """``documents`` with tags for personal data in ``text`` and ``n_chars`` counted anew; null texts stay null.

    All other columns, whatever their names, pass through unchanged.
    """

    def rewrite(batches):
        for whole in batches:
            for batch in by_bytes(whole):
                texts = batch.column("text")
                hints = maybe_disguised(as_text(texts))
                new = [None if t is None else redact(t, h) for t, h in zip(texts.to_pylist(), hints)]
                new = pa.array(new, texts.type)
                batch = batch.set_column(batch.schema.get_field_index("text"), "text", new)
                at = batch.schema.get_field_index("n_chars")
                if at >= 0:
                    counts = pa.array([None if t is None else len(t) for t in new.to_pylist()], batch.schema.field(at).type)
                    batch = batch.set_column(at, "n_chars", counts)
                yield batch

    return documents.mapInArrow(rewrite, documents.schema)
