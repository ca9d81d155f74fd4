"""Secret scans: all rules in one automaton, one pass over the bytes of each text.

The rules' regexes are compiled together by subset construction and minimisation into a transition array; the scan notes where a rule's
match can end. Each such end is followed back by the rule's reversed automaton to the starts that lead to it; of these spans the leftmost
non-overlapping ones of each kind stay, and those that fail the rule's minimum lengths are dropped. Spans are code points, end exclusive.

Defined cases: a null or empty text has no spans; rows are scanned alike and one for one; texts are whole however long; other columns are
carried by ``redact`` and ignored by ``scan``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emergent.llm.automata import compile_patterns
from emergent.llm.blocks import blocks_of
from emergent.session import ship


@dataclass(frozen=True)
class Rule:
    """A kind of secret: head then body, of at least ``least`` characters together and ``least_body`` in the body."""

    kind: str
    head: str
    body: str
    least: int = 0
    least_body: int = 0
    fold: bool = False


# The base kinds, in their order. A run of hex digits is always maximal, so its minimum can stand in the regex.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", least_body=12, fold=True),
    Rule("access", "", r"AKIA[A-Z0-9]+", least=18),
    Rule("hex", "", r"[0-9a-f]{16,}", least=16),
)
#: Kinds that the method adds.
MORE = (
    Rule("private_key", "", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_", r"[A-Za-z0-9]+", least_body=36),
    Rule("google", "AIza", r"[A-Za-z0-9_-]+", least_body=35),
    Rule("stripe", "[rs]k_live_", r"[A-Za-z0-9]+", least_body=16),
)
RULES = BASE + MORE


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = rules
        whole = [(r.head + r.body, r.fold) for r in rules]
        forward = compile_patterns(whole, search=True)
        self.classes, self.states = forward.classes, len(forward.accepts)
        self.flat, self.limit, self.accepts = forward.table()
        self.width = forward.moves.shape[1]
        self.back = [compile_patterns([w], backwards=True) for w in whole]
        self.heads = [compile_patterns([(r.head, r.fold)]) if r.head else None for r in rules]
        self.dead = [next((s for s in range(len(b.accepts)) if not b.accepts[s] and (b.moves[s] == s).all()), -1) for b in self.back]

    def ends(self, raw: bytes) -> dict[int, list[int]]:
        """For each rule the places where a longest match ends."""
        state, flat, limit = 0, self.flat, self.limit
        found: list[tuple[int, int]] = []
        for i, c in enumerate(raw.translate(self.classes)):
            state = flat[state + c]
            if state >= limit:
                found.append((i + 1, state))
        out: dict[int, list[int]] = {}
        following = 0
        for k in range(len(found) - 1, -1, -1):
            at, state = found[k]
            mask = self.accepts[state // self.width]
            after = following if k + 1 < len(found) and found[k + 1][0] == at + 1 else 0
            last = mask & ~after
            while last:
                bit = last & -last
                out.setdefault(bit.bit_length() - 1, []).append(at)
                last ^= bit
            following = mask
        return out

    def spans(self, raw: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, sorted by start and rule."""
        out = []
        for rule, ends in self.ends(raw).items():
            longest: dict[int, int] = {}
            for end in ends:  # from the last to the first, so the first end seen for a start is its longest
                for start in self._starts(rule, raw, end):
                    longest.setdefault(start, end)
            free = 0
            for start in sorted(longest):
                if start >= free:
                    free = longest[start]
                    if self._long_enough(rule, raw, start, free):
                        out.append((start, rule, free))
        return sorted(out)

    def _starts(self, rule: int, raw: bytes, end: int) -> list[int]:
        back = self.back[rule]
        state, out = 0, []
        dead = self.dead[rule]
        for i in range(end - 1, -1, -1):
            state = int(back.moves[state, back.classes[raw[i]]])
            if state == dead:
                break
            if back.accepts[state]:
                out.append(i)
        return out

    def _long_enough(self, rule: int, raw: bytes, start: int, end: int) -> bool:
        r = self.rules[rule]
        if end - start < r.least:
            return False
        if not r.least_body:
            return True
        head, state, body = self.heads[rule], 0, start
        for i in range(start, end):
            state = int(head.moves[state, head.classes[raw[i]]])
            if head.accepts[state]:
                body = i + 1
        return end - body >= r.least_body


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def _char_spans(raw: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not spans:
        return spans
    before = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, out=before[1:])
    return [(int(before[a]), r, int(before[b])) for a, r, b in spans]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans (array of kind, start, end; by start, then kind as listed) of each row of docs."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(scanner(rules))  # its size depends on the rules alone
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = shared.value
        for batch in batches:
            for block in blocks_of(batch.column("text")):
                found = []
                for i in range(block.n):
                    raw = block.raw(i)
                    found.append([{"kind": rules[r].kind, "start": a, "end": b} for a, r, b in _char_spans(raw, one.spans(raw))])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(block.first, block.n), pa.array(found, pa.list_(span))], ["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scanned, f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long>>")


def _is_kind(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def digest(scanned: DataFrame) -> DataFrame:
    """The counts of the base kinds, the SHA-256 of the base spans, and all spans as text."""
    base = [r.kind for r in BASE]
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    own = F.filter("spans", lambda s: s["kind"].isin(base))
    counts = [F.size(F.filter("spans", _is_kind(k))).cast("long").alias(f"n_{k}") for k in base]
    return scanned.select("doc_id", *counts, F.sha2(joined(own), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """docs with each secret of ``text`` replaced by ``mark``; overlapping secrets become one mark. All columns stay."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(scanner(rules))

    def redacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = shared.value
        sign = mark.encode()
        for batch in batches:
            texts = batch.column("text")
            valid = texts.is_valid().to_pylist()
            out: list[str | None] = []
            for block in blocks_of(texts):
                for i in range(block.n):
                    raw = block.raw(i)
                    parts, done = [], 0
                    for start, _, end in one.spans(raw):
                        if start >= done:
                            parts += [raw[done:start], sign]
                        done = max(done, end)
                    out.append(b"".join([*parts, raw[done:]]).decode("utf-8", "replace") if valid[block.first + i] else None)
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, pa.field("text", pa.string()), pa.array(out, pa.string()))

    return docs.mapInArrow(redacted, docs.schema)
