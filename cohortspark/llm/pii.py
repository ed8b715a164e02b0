"""PII spans by weak supervision.

Labelers (regex, gazetteer, context, surroundings) vote on every candidate span; expectation-maximisation
over the counts of vote patterns estimates how reliable each labeler is; its posteriors are the soft labels
of a logistic span classifier, fitted on the counts of feature patterns. Both kinds of pattern are small
finite sets, so counts over *all* documents reach the driver in bounded size.

Defined cases: null or empty text has no spans; very long texts take time in proportion; extra columns are ignored, whatever their names are; overlapping extra candidates yield to base spans, then to the
earlier one; repeated rows are scanned each on its own; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, materialise, pa_schema, texts_of

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "local_phone", "national_id", "iban")
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"
FOUND = "array<struct<kind:int,start:int,end:int,pattern:int>>"

_LOCAL, _DOMAIN = re.compile(r"[A-Za-z0-9._%+-]*\Z"), re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ZONE = re.compile(r"[+0-9][+0-9 ().-]{6,}")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_PHONE = re.compile(r"(?<![0-9])[0-9]{3}[ .)-]{1,2}[0-9]{3}[ .-][0-9]{4}(?![0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])")

# Gazetteers and context words (fixed values).
TLDS = frozenset("com org net edu gov io de fr es it uk us eu ch at nl be pl info biz".split())
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "86", "91")
IBAN_LANDS = frozenset("AT BE CH CZ DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split())
_CALLS = ("phone", "phones", "telephone", "telefon", "tel", "call", "calls", "mobile", "cell", "fax", "teléfono", "téléphone")
CONTEXT = {
    "email": ("mail", "mails", "email", "e-mail", "contact", "correo", "courriel"), "ip": ("ip", "ips", "host", "server", "address", "login"), "card": ("card", "cards", "visa", "pay", "payment", "credit", "karte", "kreditkarte", "tarjeta", "carte"),
    "phone": _CALLS, "local_phone": _CALLS, "national_id": ("ssn", "social", "security", "id"), "iban": ("iban", "bank", "konto", "account", "compte", "cuenta"),
}
_CONTEXT = {kind: re.compile(r"(?<!\w)(?:" + "|".join(words) + r")(?!\w)") for kind, words in CONTEXT.items()}
NEAR = 40  # characters of context on each side
BETTER = (1, 3, 8)  # prior counts of the votes on a true span: labelers are better than chance
LABELERS = ("regex", "gazetteer", "context", "surroundings")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    """Each match holds exactly one @: its local part is the run to the left, cut at the match before."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL_CHARS:
            begin -= 1
        m = _DOMAIN.match(text, at) if begin < at else None
        if m:
            out.append((begin, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end), by kind, then start. Digit patterns are tried only where such a run of characters is."""
    by_kind: list[list[tuple[int, int]]] = [_emails(text) if "@" in text else [], [], [], []]
    for zone in _ZONE.finditer(text):
        part, at = zone[0], zone.start()
        if "." in part:
            for m in _IP.finditer(part):
                if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
                    by_kind[1].append((at + m.start(), at + m.end()))
        for m in _CARD.finditer(part) if len(part) >= 16 else ():
            if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                by_kind[2].append((at + m.start(), at + m.end()))
        if "+" in part:
            for m in _PHONE.finditer(part):
                if 8 <= len(_digits(m[0])) <= 15:
                    by_kind[3].append((at + m.start(), at + m.end()))
    return [(k, a, b) for k, spans in enumerate(by_kind) for a, b in spans]


def candidates(text: str) -> list[tuple[int, int, int]]:
    """Base spans, and the extra ones that overlap neither those nor an earlier extra one."""
    base = base_spans(text)
    taken: list[list[int]] = []  # base spans laid together, in order
    for a, b in sorted((a, b) for _, a, b in base):
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    k = end = 0
    extra = [(k, m.start(), m.end()) for k, r in ((4, _LOCAL_PHONE), (5, _NATIONAL), (6, _IBAN)) for m in r.finditer(text)]
    for x in sorted(extra, key=lambda x: (x[1], x[0])):
        while k < len(taken) and taken[k][1] <= x[1]:
            k += 1
        if x[1] >= end and not (k < len(taken) and taken[k][0] < x[2]):
            base.append(x)
            end = x[2]
    return base


def votes(text: str, kind: int, a: int, b: int) -> list[int]:
    """One vote (0 against, 1 none, 2 for) of each labeler."""
    name, span = KINDS[kind], text[a:b]
    digits = _digits(span)
    strict = 2 if kind < 4 else 1
    if name == "national_id":
        strict = 0 if digits[:3] in ("000", "666") or digits[0] == "9" else 2
    elif name == "iban":
        strict = 2 if _mod97(span) else 0
    if name == "email":
        known = 2 if span.rpartition(".")[2].lower() in TLDS else 1
    elif name == "ip":
        known = 0 if span.startswith(("0.", "255.")) else 1
    elif name == "card":
        known = 2 if digits[0] in "3456" else 0
    elif name == "phone":
        known = 2 if digits.startswith(CALLING) else 0
    elif name == "iban":
        known = 2 if span[:2] in IBAN_LANDS else 0
    else:
        known = 0 if len(set(digits)) < 3 else 1
    around = (_whole_words(text, max(0, a - NEAR), a) + " " + _whole_words(text, b, min(len(text), b + NEAR))).lower()
    context = 2 if _CONTEXT[name].search(around) else 1
    before, after = text[a - 1 : a], text[b : b + 1]
    alone = 2 if not before.isalnum() and not after.isalnum() else 0
    return [strict, known, context, alone]


def _whole_words(text: str, a: int, b: int) -> str:
    """The stretch without a word that is cut at its left or right end."""
    while 0 < a < b and text[a].isalnum() and text[a - 1].isalnum():
        a += 1
    while a < b < len(text) and text[b - 1].isalnum() and text[b].isalnum():
        b -= 1
    return text[a:b]


def _mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _shape(text: str, a: int, b: int) -> int:
    """Features of the span itself: digits (0-3), separators (0-2), length (0-3)."""
    span = text[a:b]
    d, seps = len(_digits(span)), len({c for c in span if not c.isalnum()})
    return min(d // 6, 3) + 4 * min(seps, 2) + 12 * min(len(span) // 10, 3)


def _pattern(text: str, kind: int, a: int, b: int) -> int:
    code = 0
    for v in votes(text, kind, a, b):
        code = code * 3 + v
    return (code * 48 + _shape(text, a, b)) * len(KINDS) + kind


def _extract(batch: pa.RecordBatch) -> dict:
    found = [[{"kind": k, "start": a, "end": b, "pattern": _pattern(t, k, a, b)} for k, a, b in candidates(t)] for t in texts_of(batch)]
    return {"doc_id": batch.column("doc_id"), "found": found}


def _unpack(pattern: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kind, rest = pattern % len(KINDS), pattern // len(KINDS)
    code = rest // 48
    return kind, np.stack([code // 3**i % 3 for i in range(len(LABELERS) - 1, -1, -1)], 1), rest % 48


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """EM for a two-class naive Bayes model of the votes: posterior per pattern; reliabilities [labeler, class, vote]."""
    _, vote, _ = _unpack(patterns)
    post = np.clip(0.5 + 0.2 * (vote - 1).sum(1), 0.05, 0.95)
    theta = np.full((len(LABELERS), 2, 3), 1 / 3)
    for _ in range(rounds):
        prior = ((post * counts).sum() + 1) / (counts.sum() + 2)
        for j in range(len(LABELERS)):
            for v in range(3):
                on = counts * (vote[:, j] == v)
                theta[j, 1, v], theta[j, 0, v] = (on * post).sum() + BETTER[v], (on * (1 - post)).sum() + BETTER[2 - v]
        theta /= theta.sum(2, keepdims=True)
        like = [np.log(p) + sum(np.log(theta[j, c, vote[:, j]]) for j in range(len(LABELERS))) for c, p in ((0, 1 - prior), (1, prior))]
        post = 1 / (1 + np.exp(np.clip(like[0] - like[1], -50, 50)))
    return post, theta


def _design(patterns: np.ndarray) -> np.ndarray:
    kind, vote, shape = _unpack(patterns)
    parts = [np.eye(len(KINDS))[kind], *(np.eye(3)[vote[:, j]] for j in range(1, len(LABELERS))), np.eye(4)[shape % 4], np.eye(3)[shape // 4 % 3], np.eye(4)[shape // 12]]
    return np.hstack([np.ones((len(patterns), 1)), *parts])


def fit_classifier(patterns: np.ndarray, counts: np.ndarray, soft: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x, w = _design(patterns), np.zeros(_design(patterns).shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (counts * (soft - p)) - ridge * w
        w = w + np.linalg.solve((x * (counts * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
    return w


def pii_spans(docs: DataFrame, keep_at: float = 0.5) -> DataFrame:
    """One row per document with every kept span. One pass over the texts; only pattern counts are shuffled."""
    found = materialise(map_text(docs.select("doc_id", "text"), _extract, f"doc_id long, found {FOUND}"))
    rows = found.select(F.explode("found.pattern").alias("p")).groupBy("p").count().orderBy("p").collect()  # at most 3^4 * 48 * 7 patterns
    patterns, counts = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float)
    weights = np.zeros(_design(np.zeros(1, np.int64)).shape[1])
    if len(rows):
        weights = fit_classifier(patterns, counts, estimate(patterns, counts)[0])
    out = pa_schema(SCHEMA)

    def decide(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict(_decide(b, weights, keep_at), schema=out)

    return found.mapInArrow(decide, SCHEMA)


def _decide(batch: pa.RecordBatch, weights: np.ndarray, keep_at: float) -> dict:
    rows = []
    for found in batch.column("found").to_pylist():
        if any(x["kind"] >= len(BASE) for x in found):
            p = 1 / (1 + np.exp(-_design(np.array([x["pattern"] for x in found])) @ weights))
            found = [x for x, q in zip(found, p) if x["kind"] < len(BASE) or q >= keep_at]
        rows.append(sorted((x["kind"], x["start"], x["end"]) for x in found))
    say = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)
    return {
        "doc_id": batch.column("doc_id"),
        **{f"n_{kind}": [sum(x[0] == k for x in r) for r in rows] for k, kind in enumerate(BASE)},
        "base_sha256": [hashlib.sha256(say([x for x in r if x[0] < len(BASE)]).encode()).hexdigest() for r in rows],
        "spans": [say(r) for r in rows],
        "n_spans": [len(r) for r in rows],
    }
