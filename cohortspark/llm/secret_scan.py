"""Secret scan: all rules in joint deterministic automata, made by subset construction and minimisation into transition arrays.

One byte pass over each whole text with the joint search automaton marks the stretches in which some rule matches. It holds the part that
every span must begin with or hold, so that it stays small. Inside the few marked stretches the whole rules run, again all in one automaton each: one pass from the
end finds the places where spans of each rule begin, and from those alone the anchored automaton walks to the longest end. So no
start fails and every byte is read a bounded number of times, however long a text is. Spans of a kind are leftmost, longest and do not overlap; a length test drops the short ones.

Defined cases: null or empty text gives no spans; very long texts take linear time; ties (same start) sort by the order of ``RULES``;
repeated rows are scanned each on its own; extra columns are ignored, whatever their names are; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .automaton import Automaton, scan
from .common import map_text, texts_of


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


_KEY = "(" + "|".join(map(_any_case, ("password", "passwd", "secret", "token"))) + "|" + _any_case("api") + "_?" + _any_case("key") + ")"
_ASSIGN = _KEY + "[\"']?\\x20*[:=]\\x20*[\"']?"
_VALUE = re.compile(f"{_ASSIGN}([A-Za-z0-9+/_.=-]+)".encode())

#: kind, regex that every kept span begins with or holds (short, so that the joint automaton stays small), regex of the span, least bytes of the span (of the value for ``assign``)
RULES = (
    ("assign", _ASSIGN + "[A-Za-z0-9+/_.=-]", _ASSIGN + "[A-Za-z0-9+/_.=-]+", 6),
    ("access", "AKIA[A-Z0-9]{4}", "AKIA[A-Z0-9]+", 20),
    ("hex", "[0-9a-f]{16}", "[0-9a-f]+", 24),
    ("github", "gh[opsu]_[A-Za-z0-9]", "gh[opsu]_[A-Za-z0-9]+", 40),
    ("slack", "xox[abprs]-[A-Za-z0-9-]", "xox[abprs]-[A-Za-z0-9-]+", 15),
    ("google", "AIza[A-Za-z0-9_-]", "AIza[A-Za-z0-9_-]+", 39),
    ("stripe", "[rs]k_live_[A-Za-z0-9]", "[rs]k_live_[A-Za-z0-9]+", 24),
    ("jwt", "eyJ[A-Za-z0-9_-]", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", 30),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
)
BASE = ("assign", "access", "hex")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long"


@lru_cache(1)
def automata() -> tuple[Automaton, Automaton, Automaton]:
    """The joint search over the needed parts, and the whole rules from the end and from the start."""
    combined = Automaton([r[1].encode() for r in RULES], search=True)
    assert combined.sync[10], "a line feed must reset the automaton: texts are joined by it"
    whole = [r[2].encode() for r in RULES]
    return combined, Automaton(whole, search=True, backward=True), Automaton(whole, search=False)


def _spans_in(part: bytes, mask: int) -> list[tuple[int, int, int]]:
    """(start, rule, end) of the leftmost, longest, non-overlapping spans in one stretch."""
    _, back, forth = automata()
    free, out = [0] * len(RULES), []
    for at, here in enumerate(back.begins(part)):
        here &= mask
        while here:
            bit = here & -here
            here ^= bit
            rule = bit.bit_length() - 1
            if at >= free[rule]:
                free[rule] = end = forth.longest(part, at, bit)
                size = len(_VALUE.fullmatch(part, at, end)[2]) if rule == 0 else end - at
                if size >= RULES[rule][3]:
                    out.append((at, rule, end))
    return out


def find_secrets(texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Per text its (start, rule, end) in code points, sorted by start, then rule."""
    raw = [t.encode() for t in texts]
    out: list[list[tuple[int, int, int]]] = [[] for _ in raw]
    if not any(raw):
        return out
    begin = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    starts, lengths, masks = scan(automata()[0], np.frombuffer(b"\n".join(raw) + b"\n", np.uint8))
    for d, s, n, mask in zip((np.searchsorted(begin, starts, "right") - 1).tolist(), starts.tolist(), lengths.tolist(), masks.tolist()):
        at = s - int(begin[d])
        out[d] += [(at + a, rule, at + b) for a, rule, b in _spans_in(raw[d][at : at + n], mask)]
    for d, found in enumerate(out):
        if found:
            found.sort()
            if len(raw[d]) != len(texts[d]):
                chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw[d], np.uint8) & 0xC0) != 0x80)])
                out[d] = [(int(chars[a]), r, int(chars[b])) for a, r, b in found]
    return out


def _digest(batch: pa.RecordBatch) -> dict:
    found = find_secrets(texts_of(batch))
    say = lambda spans: ",".join(f"{RULES[r][0]}:{a}:{b}" for a, r, b in spans)
    count = lambda k: [sum(r == k for _, r, _ in spans) for spans in found]
    return {
        "doc_id": batch.column("doc_id"),
        **{f"n_{kind}": count(k) for k, kind in enumerate(BASE)},
        "base_sha256": [hashlib.sha256(say([x for x in s if x[1] < len(BASE)]).encode()).hexdigest() for s in found],
        "spans": [say(s) for s in found],
        "n_spans": [len(s) for s in found],
    }


def secret_scan(docs: DataFrame) -> DataFrame:
    """One row per document: counts, spans (``kind:start:end``) and the digest of the base spans. No shuffle."""
    return map_text(docs.select("doc_id", "text"), _digest, SCHEMA)
