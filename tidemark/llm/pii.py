"""Operator 6: personal data. Expressions propose spans, checksums confirm them, context words adjust the score."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_rows, short_batches, slices

KINDS = ("email", "ip", "card", "phone")
#: Kinds that the method adds to the base ones, in the order used to break ties of start.
ADDED = ("iban", "ssn", "local_phone", "secret")

# Possessive repeats and the look-behind leave the matches as they are and keep long digit runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IBAN_HEAD = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
_IBAN_REST = re.compile(r"(?:\x20?[A-Z0-9]){11,30}")
_IBAN_END = re.compile(r"[A-Z0-9](?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_LOCAL = re.compile(r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])")
#: How keys and tokens of known issuers begin, and the head of a private key.
_KEY_HEAD = re.compile(r"AKIA[0-9A-Z]{16}$|gh[pousr]_[A-Za-z0-9]{36,}$|xox[abprs]-|sk_(?:live|test)_|AIza[0-9A-Za-z_-]{35}$|eyJ[A-Za-z0-9_-]+\.eyJ")
_SECRET = re.compile(r"(?<![A-Za-z0-9_/+=.-])[A-Za-z0-9_/+=.-]{16,256}(?![A-Za-z0-9_/+=.-])|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----")
_DIGIT = re.compile(r"[0-9]")
_LETTER = re.compile(r"[A-Za-z]")
_WORD = re.compile(r"[a-z]+")

#: Characters of an IBAN by country; those of other countries may have 15 to 34.
IBAN_LENGTH = {
    c: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in countries.split()
}
#: Score of a proposed span by itself, the gain for a checksum that holds, the least score of an added span that is reported,
#: and what a context word nearby gains or, if it speaks for something else, costs.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.3, "phone": 0.6, "iban": 0.3, "ssn": 0.4, "local_phone": 0.3, "secret": 0.3}
CHECKED = {"card", "iban"}
CONFIRMED, CONTEXT, LEAST = 0.5, 0.35, 0.6
#: Code points before a span, and after it, in which context words count.
BEFORE, AFTER = 60, 20
CONTEXT_WORDS = {
    "email": {"mail", "email", "contact", "write"},
    "ip": {"ip", "address", "host", "server", "client", "login"},
    "card": {"card", "visa", "mastercard", "credit", "debit", "payment", "karte", "carte", "tarjeta"},
    "phone": {"phone", "call", "tel", "telephone", "mobile", "fax", "telefon", "anruf"},
    "iban": {"iban", "account", "bank", "transfer", "konto", "compte", "cuenta"},
    "ssn": {"ssn", "social", "security"},
    "local_phone": {"phone", "call", "tel", "telephone", "mobile", "fax", "telefon", "anruf"},
    "secret": {"key", "token", "secret", "password", "passwd", "pwd", "bearer", "authorization", "credential", "credentials"},
}
OTHER_WORDS = {"version", "isbn", "issn", "serial", "order", "invoice", "part", "model", "checksum", "commit", "sha", "md"}
#: Bits a character that a secret has at least; words and paths have less, or no digits.
ENTROPY = 2.8


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def mod97(code: str) -> bool:
    code = code.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Confirmed IBANs. What follows one may look like more of it, so each end of a word is tried, the longest first, and of
    a country whose length is known the one of that length; the search goes on after the IBAN, or else after its head."""
    at = 0
    while head := _IBAN_HEAD.search(text, at):
        at = head.end()
        rest = _IBAN_REST.match(text, at)
        if rest:
            size = IBAN_LENGTH.get(head[0][:2])
            near = text[at : rest.end() + 1]  # with the character after it, which may belong to its last word
            for end in reversed([at + m.end() for m in _IBAN_END.finditer(near) if at + m.end() <= rest.end()]):
                code = text[head.start() : end].replace(" ", "")
                if (len(code) == size if size else len(code) >= 15) and mod97(code):
                    yield head.start(), end
                    at = end
                    break


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """All matches of the email expression, each found from its @: a local part ends at the @ and can't hold another,
    so the leftmost match takes all of it, and whether one is there depends on what follows the @ alone."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_PART:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        free = m.end() if m else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's rank, end, kind) by the fixed expressions and checks, ordered."""
    found = [(s, 0, e, "email") for s, e in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end(), "ip"))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                found.append((m.start(), 2, m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end(), "phone"))
    return sorted(found)


def score(text: str, kind: str, start: int, end: int, confirmed: bool) -> float:
    """Of a span: its prior, more if a checksum or a known form confirms it, more for a context word nearby, less for one
    that speaks for something else; 0 to 1."""
    near = set(_WORD.findall(text[max(0, start - BEFORE) : start].lower() + " " + text[end : end + AFTER].lower()))
    mine, other = bool(CONTEXT_WORDS[kind] & near), bool(OTHER_WORDS & near)
    return round(max(0.0, min(1.0, PRIOR[kind] + CONFIRMED * confirmed + CONTEXT * (mine - (other and not mine)))), 2)


def known_form(value: str) -> bool:
    """Whether a secret has the form of a known issuer's keys, or is the head of a private key."""
    return value[0] == "-" or bool(_KEY_HEAD.match(value))


def _secrets(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, known form) of strings with letters and digits that look drawn by chance, and of private keys' heads."""
    for m in _SECRET.finditer(text):
        form = known_form(m[0])
        if not form:
            if not _DIGIT.search(m[0]) or not _LETTER.search(m[0]) or len(m[0]) < 20:
                continue
            n = len(m[0])
            if -sum(c / n * math.log2(c / n) for c in Counter(m[0]).values()) < ENTROPY:
                continue
        yield m.start(), m.end(), form


def _free(found: list[tuple], busy: list[tuple[int, int]]) -> list[tuple]:
    """Those of found, (start, end, ...) by start, that overlap none of busy, which is sorted and disjoint."""
    out, k = [], 0
    for x in found:
        while k < len(busy) and busy[k][1] <= x[0]:
            k += 1
        if k == len(busy) or busy[k][0] >= x[1]:
            out.append(x)
    return out


def _union(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def added_spans(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Spans that the method adds: proposed by expression, scored, and overlapping neither a base span nor one of a kind
    before theirs."""
    if not _DIGIT.search(text) and "-----BEGIN" not in text:
        return []
    out: list[tuple[int, int, int, str]] = []
    busy = _union((s, e) for s, _, e, _ in taken)
    plain = lambda pattern: ((*m.span(), False) for m in pattern.finditer(text))
    proposed = (("iban", ((*x, True) for x in _ibans(text))), ("ssn", plain(_SSN)), ("local_phone", plain(_LOCAL)), ("secret", _secrets(text)))
    for rank, (kind, found) in enumerate(proposed, len(KINDS)):
        mine = [x for x in _free(list(found), busy) if score(text, kind, *x) >= LEAST]
        if mine:
            out += [(s, rank, e, kind) for s, e, _ in mine]
            busy = _union([*busy, *((s, e) for s, e, _ in mine)])
    return out


def find_personal_data(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores.

    `spans` lists kind:start:end, in code points with the end exclusive, by start and kind; base spans always
    stay, added ones (IBAN, social security and local phone numbers, keys and tokens) never overlap them; `scores` lists their
    scores in the same order. Null and empty texts have no spans, an empty list's checksum, and still a row. Repeated rows each give a row; null ids stay
    null; other columns are not looked at.
    """

    def scan(batches):
        for batch in slices(batches, "__text"):
            rows = []
            for text_ in batch.column("__text").to_pylist():
                base = base_spans(text_)
                n = [0, 0, 0, 0]
                for x in base:
                    n[x[1]] += 1
                all_ = sorted(base + added_spans(text_, base))
                listed = [",".join(f"{k}:{s}:{e}" for s, _, e, k in x) for x in (base, all_)]
                scores = [score(text_, k, s, e, k in CHECKED or k == "secret" and known_form(text_[s:e])) for s, _, e, k in all_]
                rows.append((*n, hashlib.sha256(listed[0].encode()).hexdigest(), listed[1], ",".join(map(str, scores))))
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(c, pa.string()) for c in columns[4:]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "scores"])

    short_batches(docs.sparkSession)
    sheet = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    kind = sheet.schema["doc_id"].dataType.simpleString()
    return sheet.mapInArrow(scan, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string")


def redact(docs: DataFrame, text: str = "text", mask: str = "<{kind}>") -> DataFrame:
    """docs with every span of `find_personal_data` replaced by a mask; null texts stay null, all columns stay."""
    fill = {k: mask.format(kind=k) for k in (*KINDS, *ADDED)}

    def clean(batches, name):
        for batch in slices(batches, name):
            out = []
            for t in batch.column(name).to_pylist():
                if t:
                    base = base_spans(t)
                    at, parts = 0, []
                    for s, _, e, k in sorted(base + added_spans(t, base)):
                        if e > at:
                            parts += [t[at : max(s, at)], fill[k]]
                            at = e
                    t = "".join(parts) + t[at:]
                out.append(t)
            i = batch.schema.get_field_index(name)
            yield batch.set_column(i, name, pa.array(out, batch.schema.field(i).type))

    short_batches(docs.sparkSession)
    return map_rows(docs, text, clean)
