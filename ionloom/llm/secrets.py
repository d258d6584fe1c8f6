"""Secrets by grammar inference.

Base patterns label credentials in the documents themselves. From a bounded sample of each
kind a prefix tree is built and its statistically compatible states are merged, which gives a
probabilistic automaton of the kind's format; ordinary long words give one for the background.
All candidates are then scored by how much likelier a format is than the background.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ionloom.llm import spans
from ionloom.llm.common import text_slices, written

BASE = ("assign", "access", "hex")
#: Kinds in the order in which spans of one start are listed; the last is what the automata add.
KINDS = (*BASE, "inferred")
ORDINARY = "ordinary"

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")

# Credentials per kind, and ordinary words, that the automata are learned from (bounds the fit).
SAMPLE = 1000
# Longest value that is learned from; longer ones are scored all the same.
LONGEST = 4096
# Significance of the test that keeps two states apart.
ALPHA = 0.05
# A candidate is a secret if some format is so much likelier than the background (natural log).
MARGIN = 10.0
# Weight of an unseen symbol, and the number of symbols it stands for.
_UNSEEN, _SYMBOLS = 0.02, 70


def base_findings(text: str) -> list[tuple[str, int, int, str]]:
    """Kind, start, end and credential of each match of the base patterns."""
    found = [("assign", m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    return found


def candidates(text: str, found: Sequence[tuple[str, int, int, str]]) -> list[tuple[int, str]]:
    """Start and value of each long unbroken run that touches no base finding."""
    taken = sorted((a, b) for _, a, b, _ in found)
    out, i, reach = [], 0, 0
    for m in _CANDIDATE.finditer(text):
        while i < len(taken) and taken[i][0] < m.end():
            reach = max(reach, taken[i][1])
            i += 1
        if reach <= m.start():
            out.append((m.start(), m[0]))
    return out


class Automaton(NamedTuple):
    """Deterministic automaton: per state the log-probability of stopping, of an unseen symbol,
    and per symbol (log-probability, next state)."""

    stop: list[float]
    unseen: list[float]
    steps: list[dict[str, tuple[float, int]]]

    def score(self, value: str) -> float:
        """Natural log of the probability of ``value``; an unseen symbol keeps the state."""
        state, total = 0, 0.0
        for symbol in value:
            step = self.steps[state].get(symbol)
            if step is None:
                total += self.unseen[state]
            else:
                total += step[0]
                state = step[1]
        return total + self.stop[state]


class _Tree:
    """Prefix tree with counts: stops per state; per symbol the next state and how often it is taken."""

    def __init__(self, values: Sequence[str]):
        self.stops: list[int] = [0]
        self.next: list[dict[str, int]] = [{}]
        self.taken: list[dict[str, int]] = [{}]
        for value in values:
            state = 0
            for symbol in value:
                if symbol not in self.next[state]:
                    self.next[state][symbol] = len(self.stops)
                    self.taken[state][symbol] = 0
                    self.stops.append(0)
                    self.next.append({})
                    self.taken.append({})
                self.taken[state][symbol] += 1
                state = self.next[state][symbol]
            self.stops[state] += 1

    def visits(self, state: int) -> int:
        return self.stops[state] + sum(self.taken[state].values())

    def compatible(self, a: int, b: int, alpha: float) -> bool:
        """No stop or symbol frequency differs by more than its Hoeffding bound, here and below."""
        root = math.sqrt(0.5 * math.log(2 / alpha))
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.visits(a), self.visits(b)
            if not n or not m:
                continue
            bound = root * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.stops[a] / n - self.stops[b] / m) > bound:
                return False
            left, right = self.taken[a], self.taken[b]
            for symbol in left.keys() | right.keys():
                if abs(left.get(symbol, 0) / n - right.get(symbol, 0) / m) > bound:
                    return False
                if symbol in left and symbol in right and self.next[a][symbol] != self.next[b][symbol]:
                    todo.append((self.next[a][symbol], self.next[b][symbol]))
        return True

    def merge(self, kept: int, parent: int, symbol: str) -> None:
        """Redirects an edge to ``kept`` and folds the subtree it led to into it."""
        todo = [(kept, self.next[parent][symbol])]
        self.next[parent][symbol] = kept
        while todo:
            a, b = todo.pop()
            self.stops[a] += self.stops[b]
            for s, below in self.next[b].items():
                self.taken[a][s] = self.taken[a].get(s, 0) + self.taken[b][s]
                if s in self.next[a]:
                    todo.append((self.next[a][s], below))
                else:
                    self.next[a][s] = below


def infer(values: Sequence[str], alpha: float = ALPHA) -> Automaton:
    """State merging in a fixed order: a state next to the kept ones is folded into the first
    kept state that is compatible with it, or kept itself. No values give the empty language."""
    tree = _Tree(sorted(values))
    kept = [0]
    while True:
        known = set(kept)
        edge = next(((k, s) for k in kept for s in sorted(tree.next[k]) if tree.next[k][s] not in known), None)
        if edge is None:
            break
        state = tree.next[edge[0]][edge[1]]
        match = next((k for k in kept if tree.compatible(k, state, alpha)), None)
        if match is None:
            kept.append(state)
        else:
            tree.merge(match, *edge)
    number = {state: i for i, state in enumerate(kept)}
    stop, unseen, steps = [], [], []
    for k in kept:
        total = tree.visits(k) + _UNSEEN * (_SYMBOLS + 1)
        stop.append(math.log((tree.stops[k] + _UNSEEN) / total))
        unseen.append(math.log(_UNSEEN / total))
        steps.append({s: (math.log((n + _UNSEEN) / total), number[tree.next[k][s]]) for s, n in tree.taken[k].items()})
    return Automaton(stop, unseen, steps)


def margin(value: str, automata: dict[str, Automaton]) -> float:
    """How much likelier the best credential format is than the background, as a natural log."""
    formats = [a.score(value) for kind, a in automata.items() if kind != ORDINARY]
    return max(formats) - automata[ORDINARY].score(value) if formats and ORDINARY in automata else -math.inf


def findings(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, base findings ``found`` and long runs ``runs``."""
    rows = docs.select("doc_id", "text")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    found_type = pa.list_(
        pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])
    )
    runs_type = pa.list_(pa.struct([("start", pa.int64()), ("value", pa.string())]))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for start, texts in text_slices(batch, "text"):
                found = [base_findings(t) for t in texts]
                runs = [candidates(t, f) for t, f in zip(texts, found, strict=True)]
                as_rows = [[dict(zip(("kind", "start", "end", "value"), x, strict=True)) for x in f] for f in found]
                as_runs = [[{"start": a, "value": v} for a, v in r] for r in runs]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), pa.array(as_rows, found_type), pa.array(as_runs, runs_type)],
                    names=["doc_id", "found", "runs"],
                )

    return rows.mapInArrow(
        batches,
        f"doc_id {id_type}, found array<struct<kind:string,start:long,end:long,value:string>>, "
        "runs array<struct<start:long,value:string>>",
    )


def fit(found: DataFrame, sample: int = SAMPLE, alpha: float = ALPHA) -> dict[str, Automaton]:
    """One automaton per kind, from at most ``sample`` distinct values each, chosen by hash.

    All documents can give values; only the sample, a bound on the fit, reaches the driver.
    """
    labelled = found.select(F.explode("found").alias("f")).select("f.kind", "f.value")
    ordinary = found.select(F.explode("runs").alias("r")).select(F.lit(ORDINARY).alias("kind"), "r.value")
    values = labelled.unionByName(ordinary).where(F.length("value") <= LONGEST).distinct()
    order = Window.partitionBy("kind").orderBy(F.xxhash64("value"), "value")
    chosen = values.withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample).select("kind", "value").collect()
    by_kind: dict[str, list[str]] = {}
    for row in chosen:
        by_kind.setdefault(row["kind"], []).append(row["value"])
    return {kind: infer(v, alpha) for kind, v in sorted(by_kind.items())}


def scan(docs: DataFrame, automata: dict[str, Automaton] | None = None, least: float = MARGIN) -> DataFrame:
    """One row per document: ``doc_id``, a count per base kind, ``base_sha256`` and ``spans``.

    Without ``automata`` they are learned from the base findings of ``docs``. Offsets count
    code points, ends are exclusive. Null and empty texts have no findings; repeated rows are
    scanned alike; without labelled credentials nothing is inferred; an empty table gives no
    rows; extra columns are ignored.
    """
    found = written(findings(docs), "secret-findings")
    automata = fit(found) if automata is None else automata
    shared = docs.sparkSession.sparkContext.broadcast(automata)
    id_type = found.schema["doc_id"].dataType.simpleString()
    counts = [f"n_{k}" for k in BASE]
    names = ["doc_id", *counts, "base_sha256", "spans"]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            base = [[(f["kind"], f["start"], f["end"]) for f in row.as_py()] for row in batch.column(1)]
            added = [
                [
                    ("inferred", r["start"], r["start"] + len(r["value"]))
                    for r in row.as_py()
                    if margin(r["value"], shared.value) >= least
                ]
                for row in batch.column(2)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *[pa.array([sum(s[0] == k for s in f) for f in base], pa.int64()) for k in BASE],
                    pa.array([spans.digest(spans.joined(f, KINDS)) for f in base], pa.string()),
                    pa.array([spans.joined(f + more, KINDS) for f, more in zip(base, added, strict=True)], pa.string()),
                ],
                names=names,
            )

    return found.mapInArrow(batches, f"doc_id {id_type}, " + "".join(f"{c} long, " for c in counts) + "base_sha256 string, spans string")
