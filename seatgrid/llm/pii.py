"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score.

Kinds: email, ip, card, phone (always reported once confirmed) and iban, ssn, secret (reported when their score
reaches ``REPORT``). A proposal is confirmed by its validator: address parts up to 255, Luhn for cards,
digit counts for phones, mod-97 and the length of the country for IBANs, the issued ranges for social security numbers, mixed
characters for secrets. The score starts from the kind's prior and rises when a word that goes with the kind
stands within ``NEARBY`` code points before or after the span, or falls when a word that speaks against it stands before
(after the span such a word mostly names what follows). A word that reaches out of the window counts whole.

Spans are code points, end exclusive. A null or empty text has none. Only ``doc_id`` and the text are read, each row by
itself, so repeated rows, clashing columns and empty tables need no rule of their own. All patterns run in time
linear in the text: none retries a run of characters from its middle. An IBAN may be followed by further words of
capitals and digits, so each word that begins like one is tried by itself, over at most 34 characters without spaces.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seatgrid.llm.common import whole_text

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE_KINDS = KINDS[:4]
NEARBY = 40
REPORT = 0.5

# Prior score of a confirmed span, words that raise it and words that lower it.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4, "secret": 0.5}
FOR = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "mastercard", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"),
    "ssn": ("ssn", "social", "security"),
    "secret": ("key", "token", "secret", "password", "api"),
}
AGAINST = {
    "email": ("example",),
    "ip": ("version", "release", "section"),
    "card": ("isbn", "order", "serial"),
    "phone": ("order", "invoice", "part"),
    "iban": ("serial",),
    "ssn": ("order", "invoice", "part", "isbn"),
    "secret": ("checksum", "sha256", "md5"),
}
RAISE, LOWER = 0.1, 0.25

LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only start where a run of digits does, so looking back spares the run's middle.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Where one may start, and as many characters as the longest may have.
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?: ?[A-Z0-9]){11,30}))")
# Characters of an IBAN by country; countries not listed have no length of their own here.
IBAN_LENGTHS = {c: n for n, cs in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for c in cs.split()}
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
SECRET = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})(?![A-Za-z0-9])"
                    r"|(?<=\")[A-Za-z0-9]{24,64}(?=\")")


def emails(text: str):
    """Leftmost, non-overlapping ``local@domain.tld``, found from each @ outwards."""
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            floor = m.end()
            at = text.find("@", floor)
        else:
            floor = at + 1
            at = text.find("@", floor)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def ibans(text: str):
    """IBANs that pass mod-97 and end at a word end, at the length of the country; of a country not listed here, the
    longest that passes."""
    m = IBAN.search(text)
    while m:
        stops, n = {}, 4  # characters without spaces to place of the end
        for i in range(m.end(), m.end(1)):
            n += text[i] != " "
            if n >= 15 and text[i] != " " and not (text[i + 1:i + 2].isascii() and text[i + 1:i + 2].isalnum()):
                stops[n] = i + 1
        own = IBAN_LENGTHS.get(m.group()[:2])
        tried = [k for k in sorted(stops, reverse=True) if own in (None, k)]
        stop = next((stops[k] for k in tried if mod97(text[m.start():stops[k]])), None)
        if stop:
            yield m.start(), stop
        m = IBAN.search(text, stop or m.end())


def _part_ok(p: str) -> bool:
    p = p.lstrip("0")
    return len(p) <= 3 and int(p or 0) <= 255


def proposals(text: str):
    """(kind, start, end) of the confirmed spans."""
    for a, b in emails(text):
        yield "email", a, b
    for m in IP.finditer(text):
        if all(map(_part_ok, m.group().split("."))):
            yield "ip", m.start(), m.end()
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(d) <= 19 and luhn(d):
                yield "card", m.start(), m.end()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                yield "phone", m.start(), m.end()
    for a, b in ibans(text):
        yield "iban", a, b
    for m in SSN.finditer(text):
        a, b, c = m.group().split("-")
        if a not in ("000", "666") and a < "900" and b != "00" and c != "0000":
            yield "ssn", m.start(), m.end()
    for m in SECRET.finditer(text):
        s = m.group()
        if any(c.isdigit() for c in s) and any(c.isalpha() for c in s):
            yield "secret", m.start(), m.end()


WORDS = re.compile(r"[a-z0-9]+")
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")


def nearby(text: str, start: int, stop: int) -> tuple[set[str], set[str]]:
    """Words before and after a span, those at the far ends of the windows whole."""
    a, b = max(0, start - NEARBY), min(len(text), stop + NEARBY)
    while 0 < a < start and text[a] in LETTERS and text[a - 1] in LETTERS:
        a -= 1
    while stop < b < len(text) and text[b - 1] in LETTERS and text[b] in LETTERS:
        b += 1
    return set(WORDS.findall(text[a:start].lower())), set(WORDS.findall(text[stop:b].lower()))


def scored(text: str) -> list[dict]:
    out = []
    for kind, a, b in proposals(text):
        before, after = nearby(text, a, b)
        score = PRIOR[kind] + RAISE * len((before | after).intersection(FOR[kind])) - LOWER * len(before.intersection(AGAINST[kind]))
        score = min(1.0, max(0.05, score))
        if kind in BASE_KINDS or score >= REPORT:
            out.append({"kind": kind, "start": a, "stop": b, "score": score})
    return out


SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
    T.StructField("stop", T.IntegerType()), T.StructField("score", T.DoubleType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))


@F.arrow_udf(SPANS)
def pii_spans(texts: pa.Array) -> pa.Array:
    return pa.array([scored(t.as_py() or "") for t in texts], _ARROW)


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, spans array<struct<kind, start, stop, score>> by kind as listed in KINDS, then start."""
    return docs.select("doc_id", pii_spans(whole_text()).alias("spans"))


def pii_digest(found: DataFrame) -> DataFrame:
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    s = F.col("spans")
    base = F.filter(s, lambda x: x["kind"].isin(*BASE_KINDS))

    def count(kind):
        return F.size(F.filter(s, lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(k) for k in BASE_KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(s).alias("spans"))
