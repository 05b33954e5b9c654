"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Base kinds (e-mail, IPv4, payment card, phone) are found leftmost and
non-overlapping within each kind; failing candidates are dropped and not
retried; context changes their score only.  IBANs are added: a candidate must pass
ISO 7064 mod-97.  Where the country's length is known the candidate is cut to it and
its checksum is enough; a candidate of another country, ended at the borders of its groups, is
doubtful: it counts only where an account word stands near it.

Edge cases: null text is empty and has no span; offsets count code points;
every input row gives one output row, repeated rows and null ids included.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone", "iban")
#: Words that make a span of the kind likelier when they stand near it.
CONTEXT = {
    "email": ("mail", "email", "e-mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address", "addr"),
    "card": ("card", "visa", "credit", "debit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
}
#: Score of a confirmed span without and with a context word within CONTEXT_CHARS.
BARE = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.6, "iban": 0.8, "doubtful": 0.65}
CONTEXT_BONUS, CONTEXT_CHARS, MIN_SCORE = 0.1, 40, 0.7
#: Length of an IBAN by country.
IBAN_LENGTH = dict(
    x.split(":")
    for x in (
        "AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BI:27 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DJ:27 DK:18 DO:28 "
        "EE:20 EG:29 ES:24 FI:18 FK:18 FO:18 FR:27 GB:22 GE:22 GI:23 GL:18 GR:27 GT:28 HR:21 HU:28 IE:22 IL:23 IQ:23 IS:26 IT:27 "
        "JO:30 KW:30 KZ:20 LB:28 LC:32 LI:21 LT:20 LU:20 LV:21 LY:25 MC:27 MD:24 ME:22 MK:19 MN:20 MR:27 MT:31 MU:30 NI:28 NL:18 "
        "NO:15 OM:23 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 RU:33 SA:24 SC:31 SD:18 SE:24 SI:19 SK:24 SM:27 SO:23 ST:25 SV:28 "
        "TL:23 TN:24 TR:26 UA:29 VA:22 VG:24 XK:20 YE:30"
    ).split()
)
_WORDS = {k: re.compile(f"(?<![a-z0-9])(?:{'|'.join(map(re.escape, v))})(?![a-z0-9])") for k, v in CONTEXT.items()}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit run is consumed whole, so a match can only begin where a run begins: the look-behind keeps long runs linear.
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?: ?[A-Z0-9]){11})")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_UPPER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    """Mod-10 check of a digit string."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064 check of an IBAN without spaces."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def ibans(text: str) -> list[tuple[int, int, bool]]:
    """Spans of candidates that pass mod-97, and whether their country's length is known."""
    out, end = [], 0
    for m in _IBAN.finditer(text):
        a = m.start()
        if a < end:
            continue
        known = IBAN_LENGTH.get(m[0][:2])
        bare, at, ends = "", a, []
        # letters and digits with single spaces between them, as many as an IBAN may have
        while at < len(text) and len(bare) < int(known or 34):
            if text[at] in _UPPER:
                bare += text[at]
            elif text[at] != " " or text[at + 1 : at + 2] not in _UPPER or not text[at + 1 : at + 2]:
                break
            at += 1
            if len(bare) >= 15 and text[at - 1] != " " and text[at : at + 1] not in _ALNUM:
                ends.append((at, bare))
        tried = [x for x in ends if len(x[1]) == int(known)] if known else ends[::-1]
        for stop, x in tried:
            if mod97(x):
                out.append((a, stop, known is not None))
                end = stop
                break
    return out


def near(text: str, a: int, b: int, kind: str) -> bool:
    """Whether a context word of the kind stands, whole, within CONTEXT_CHARS of the span."""
    for lo, hi in ((max(0, a - CONTEXT_CHARS), a), (b, min(len(text), b + CONTEXT_CHARS))):
        margin = max(0, lo - 1)
        for m in _WORDS[kind].finditer(text[margin : hi + 16].lower()):
            if m.start() >= lo - margin and m.start() < hi - margin:
                return True
    return False


def emails(text: str) -> list[tuple[int, int]]:
    """Spans of the e-mail pattern; works outward from each @, so long runs without one cost nothing."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > end and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            end = m.end()
            out.append((a, end))
        else:
            end = max(end, at + 1)
        at = text.find("@", end)
    return out


def spans(text: str) -> list[tuple[int, int, str, float]]:
    """All confirmed spans: (start, end, kind, score), by start, then kind as listed."""
    found: list[tuple[int, int, str]] = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m.groups()]
            if all(len(p) < 4 and int(p or 0) <= 255 for p in parts):
                found.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                d = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(d) <= 19 and luhn(d):
                    found.append((m.start(), m.end(), "card"))
        if "+" in text:
            found += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= sum(map(m[0].count, "0123456789")) <= 15]
        found += [(x, y, "iban" if known else "doubtful") for x, y, known in ibans(text)]
    scored = []
    for a, b, shape in found:
        kind = "iban" if shape == "doubtful" else shape
        score = BARE[shape] + CONTEXT_BONUS * near(text, a, b, kind)
        if kind != "iban" or score >= MIN_SCORE:
            scored.append((a, b, kind, round(score, 2)))
    return sorted(scored, key=lambda s: (s[0], KINDS.index(s[2])))


SCHEMA = "doc_id long, spans array<struct<start:int,end:int,kind:string,score:double>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float64())]))
    for b in batches:
        found = [[] if t is None else [dict(zip(("start", "end", "kind", "score"), s, strict=True)) for s in spans(t)] for t in (x.as_py() for x in b.column(1))]
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(found, kind)], ["doc_id", "spans"])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its confirmed spans and their scores; a scan without any shuffle."""
    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(_scan, SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    """Counts per base kind and the span lists as text."""
    line = "concat_ws(',', transform({}, s -> concat_ws(':', s.kind, cast(s.start as string), cast(s.end as string))))"
    counts = [f"cast(size(filter(spans, s -> s.kind = '{k}')) as long) n_{k}" for k in KINDS]
    base = line.format("filter(spans, s -> s.kind <> 'iban')")
    return found.selectExpr("doc_id", *counts[:4], f"sha2({base}, 256) base_sha256", f"{line.format('spans')} spans", counts[4], "round(coalesce(array_max(transform(spans, s -> s.score)), 0.0D), 2) max_score")


