"""Personal data: patterns propose spans, checksums confirm them, context words adjust a score.

Base kinds follow fixed patterns, leftmost and non-overlapping for each kind; a failed check drops the
match without a retry. The method adds kinds that only a checksum or a context word makes likely: IBANs, local phone numbers, and keys and tokens.
All scans take time in proportion to the text.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm._util import bound_batches

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.)-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
#: A long opaque value of letters and digits, as keys and tokens are.
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9])")
_DIGIT, _LATIN, _WORD = re.compile("[0-9]"), re.compile("[A-Za-z]"), re.compile(r"[^\W\d_]+")
#: How far around a span context words count, in characters, and what one adds to a score.
REACH, CONTEXT = 48, 0.2
#: Score of a confirmed pattern by kind; a kind below THRESHOLD needs a context word.
SCORES = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.9, "local_phone": 0.4, "secret": 0.4}
THRESHOLD = 0.5
WORDS = {
    "email": {"email", "mail", "contact", "correo", "courriel"},
    "ip": {"ip", "address", "host", "server", "adresse"},
    "card": {"card", "visa", "credit", "debit", "karte", "carte", "tarjeta"},
    "phone": {"phone", "tel", "call", "mobile", "telefon", "fax"},
    "iban": {"iban", "account", "bank", "konto", "compte", "cuenta"},
    "local_phone": {"phone", "tel", "call", "mobile", "telefon", "fax"},
    "secret": {"token", "secret", "key", "apikey", "password", "passwd", "pwd", "passwort", "bearer", "credential", "credentials", "authorization"},
}
BASE = ("email", "ip", "card", "phone")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(code: str) -> bool:
    code = code.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        # The local part reaches back over its characters, not past the previous address.
        start = at
        step = 64
        while start > done:
            piece = text[max(done, start - step) : start]
            bare = piece.rstrip(_LOCAL)
            start -= len(piece) - len(bare)
            if bare:
                break
            step *= 2
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _ibans(text: str):
    """From each possible start the longest run of whole groups that the checksum confirms."""
    m = _IBAN.search(text)
    while m:
        start, end = m.span()
        ends = [e for e in range(end, start + 14, -1) if e == end or text[e] == " "]
        good = next((e for e in ends if len(text[start:e].replace(" ", "")) >= 15 and mod97(text[start:e])), None)
        if good:
            yield start, good
        m = _IBAN.search(text, good or start + 1)


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _score(kind: str, text: str, start: int, end: int) -> float:
    near = _WORD.findall(text[max(0, start - REACH) : start]) + _WORD.findall(text[end : end + REACH])
    return min(1.0, SCORES[kind] + CONTEXT * any(w.lower() in WORDS[kind] for w in near))


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of all spans, by kind and start; positions in code points."""
    if not text:
        return []
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
        base = len(out)
        out += [("iban", a, b) for a, b in _ibans(text)]
        taken = sorted((a, b) for _, a, b in out[:base])
        starts, reach = [a for a, _ in taken], list(itertools.accumulate((b for _, b in taken), max))
        for m in _LOCAL_PHONE.finditer(text):
            k = bisect_left(starts, m.end())
            if not k or reach[k - 1] <= m.start():
                out.append(("local_phone", m.start(), m.end()))
        for m in _SECRET.finditer(text):
            k = bisect_left(starts, m.end())
            if (not k or reach[k - 1] <= m.start()) and _DIGIT.search(m[0]) and _LATIN.search(m[0]):
                out.append(("secret", m.start(), m.end()))
    scored = [(k, a, b, _score(k, text, a, b)) for k, a, b in out]
    return [x for x in scored if x[0] in BASE or x[3] >= THRESHOLD]


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found, found) for every row.

    `found` has (kind, start, end, score) of all spans and n_found their number; `spans` is kind:start:end
    joined by commas, base kinds first; base_sha256 covers the base kinds only. Spans of different kinds
    may overlap; added ones do not overlap base ones, but for IBANs. Null and empty texts have no spans. Rows are
    independent, so null or repeated ids change nothing; other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                spans = find_spans(text)
                base = [f"{k}:{a}:{b}" for k, a, b, _ in spans if k in BASE]
                rows.append(
                    [sum(k == kind for k, *_ in spans) for kind in BASE]
                    + [hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans), len(spans), [dict(zip(("kind", "start", "end", "score"), s)) for s in spans]]
                )
            columns = list(zip(*rows)) if rows else [[]] * 8
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64(), pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_found", "found"])

    bound_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_found long, found array<struct<kind: string, start: long, end: long, score: double>>")
