"""Secret scans by a trigram inverted index.

From each rule's parsed regex a Boolean query over trigrams is derived: a match must hold, for some string of each run of
literal choices, all its trigrams.  A block of texts is indexed for the trigrams that any query names (lower-cased ASCII, UTF-8
bytes): posting lists of the block's texts.  Intersections and unions of postings give the candidates of a rule, which its regex
verifies over the whole text.  A rule with no mandatory trigram scans every text.

Matches are leftmost and do not overlap within a kind; a match whose measured part is too short is dropped.  Offsets
count code points, ends are exclusive.

Cases: a null text counts as empty and has no spans; repeated rows each give a row; a null doc_id stays null; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encoded, map_arrow, text_blocks


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 0  # code points of ``group``
    group: int = 0
    any_case: bool = False
    base: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


#: In the order of kinds.  The hex rule's runs are greedy, so its least length can stand in the pattern.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, True, True),
    Rule("access", r"AKIA[A-Z0-9]+", 16, base=True),
    Rule("hex", r"[0-9a-f]{32,}", base=True),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
)

# A query is True (no demand), ("tri", bytes), ("and", [queries]) or ("or", [queries]).


def both(qs: list):
    qs = [q for q in qs if q is not True]
    return True if not qs else qs[0] if len(qs) == 1 else ("and", qs)


def either(qs: list):
    return True if not qs or any(q is True for q in qs) else qs[0] if len(qs) == 1 else ("or", qs)


def trigrams(s: str):
    b = s.encode().lower()
    return both([("tri", t) for t in dict.fromkeys(b[i : i + 3] for i in range(len(b) - 2))])


def query(pattern: str, most: int = 64):
    """The trigram query of a regex: what any match must hold, ASCII case aside."""
    from re import _constants as k
    from re import _parser

    def exact(item) -> set[str] | None:
        """All strings an item can match, if they are few."""
        op, arg = item
        if op is k.LITERAL:
            return {chr(arg).lower() if arg < 128 else chr(arg)}
        if op is k.IN:
            out = set()
            for o, a in arg:
                if o is k.LITERAL:
                    out.add(chr(a).lower() if a < 128 else chr(a))
                elif o is k.RANGE and a[1] - a[0] < most:
                    out |= {chr(c).lower() if c < 128 else chr(c) for c in range(a[0], a[1] + 1)}
                else:
                    return None
            return out if len(out) <= 8 else None
        if op is k.SUBPATTERN:
            return strings(arg[-1])
        if op is k.BRANCH:
            found = [strings(x) for x in arg[1]]
            return None if None in found else set().union(*found)
        if op in (k.MAX_REPEAT, k.MIN_REPEAT) and arg[1] is not k.MAXREPEAT and arg[1] <= 8:
            one = strings(arg[2])
            if one is None:
                return None
            out, now = set(), {""}
            for n in range(arg[1] + 1):
                if n >= arg[0]:
                    out |= now
                now = {a + b for a in now for b in one}
                if len(now) > most:
                    return None
            return out
        if op is k.AT:
            return {""}
        return None

    def strings(items) -> set[str] | None:
        now = {""}
        for item in items:
            if (one := exact(item)) is None:
                return None
            now = {a + b for a in now for b in one}
            if len(now) > most:
                return None
        return now

    def inner(item):
        op, arg = item
        if op is k.SUBPATTERN:
            return walk(arg[-1])
        if op is k.BRANCH:
            return either([walk(x) for x in arg[1]])
        if op in (k.MAX_REPEAT, k.MIN_REPEAT) and arg[0] >= 1:
            return walk(arg[2])
        return True

    def walk(items):
        found, run = [], {""}
        for item in items:
            one = exact(item)
            grown = None if one is None else {a + b for a in run for b in one}
            if grown is not None and len(grown) <= most:
                run = grown
                continue
            found.append(either([trigrams(s) for s in sorted(run)]))
            run = one if one is not None else {""}
            if one is None:
                found.append(inner(item))
        found.append(either([trigrams(s) for s in sorted(run)]))
        return both(found)

    return walk(_parser.parse(pattern))


def named(q) -> set[bytes]:
    return set() if q is True else {q[1]} if q[0] == "tri" else set().union(*map(named, q[1]))


class Index:
    """Posting lists of a block of texts for a vocabulary of trigrams."""

    def __init__(self, vocabulary: set[bytes]):
        self.place = {t: i + 1 for i, t in enumerate(sorted(vocabulary))}
        self.table = np.zeros(1 << 24, np.uint16)
        for t, i in self.place.items():
            self.table[int.from_bytes(t, "big")] = i

    def postings(self, texts: list[bytes]) -> dict[bytes, np.ndarray]:
        data = np.frombuffer(b"\xff\xff".join(texts).lower() + b"\xff\xff", np.uint8)  # a byte that no UTF-8 holds stands between texts
        starts = np.cumsum([0, *(len(t) + 2 for t in texts)])[:-1]
        code = data[:-2].astype(np.uint32)
        code <<= 8
        code |= data[1:-1]
        code <<= 8
        code |= data[2:]
        ids = self.table[code]
        at = np.flatnonzero(ids)
        pairs = np.unique(ids[at].astype(np.int64) * len(texts) + np.searchsorted(starts, at, "right") - 1)
        which, doc = np.divmod(pairs, max(1, len(texts)))
        return {t: doc[np.searchsorted(which, i, "left") : np.searchsorted(which, i, "right")] for t, i in self.place.items()}


def matching(q, postings: dict[bytes, np.ndarray], n: int) -> np.ndarray:
    if q is True:
        return np.arange(n)
    if q[0] == "tri":
        return postings[q[1]]
    parts = sorted((matching(x, postings, n) for x in q[1]), key=len)
    out = parts[0]
    for p in parts[1:]:
        out = np.intersect1d(out, p, assume_unique=True) if q[0] == "and" else np.union1d(out, p)
    return out


def matches(rule: Rule, regex: re.Pattern, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in regex.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def scanner(rules: tuple[Rule, ...] = RULES):
    """A function from a list of texts to a list of lists of (start, order of the rule, end), sorted."""
    queries = [query(r.pattern) for r in rules]
    index, compiled = Index(set().union(*map(named, queries))), [r.compiled() for r in rules]

    def scan(texts: list[str]) -> list[list[tuple[int, int, int]]]:
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        postings = index.postings([encoded(t) for t in texts])
        for k, (rule, regex, q) in enumerate(zip(rules, compiled, queries, strict=True)):
            for i in matching(q, postings, len(texts)):
                found[i] += [(a, k, b) for a, b in matches(rule, regex, texts[i])]
        for f in found:
            f.sort()
        return found

    return scan


def secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_<kind> for each kind, spans and base_spans (kind:start:end by start, then kind, comma-joined)."""
    ddl = ",".join(["doc_id long", *(f"n_{r.kind} long" for r in rules), "spans string", "base_spans string", "base_sha256 string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        scan = scanner(rules)
        for b in text_blocks(batches, limit=4 << 20):
            found = scan([t or "" for t in b.column("text").to_pylist()])
            out = {"doc_id": b.column("doc_id")}
            for k, r in enumerate(rules):
                out[f"n_{r.kind}"] = [sum(x[1] == k for x in f) for f in found]
            out["spans"] = [",".join(f"{rules[k].kind}:{a}:{e}" for a, k, e in f) for f in found]
            out["base_spans"] = [",".join(f"{rules[k].kind}:{a}:{e}" for a, k, e in f if rules[k].base) for f in found]
            out["base_sha256"] = [hashlib.sha256(s.encode()).hexdigest() for s in out["base_spans"]]
            yield out

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, ddl)
