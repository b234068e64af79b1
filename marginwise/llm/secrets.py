"""Secret scan: fixed patterns, and formats learnt from what they find.

Grammar inference: the distinct credentials that the patterns find are labelled with their kind. Each
kind's prefix tree of character classes is merged, from the root outwards, where the outgoing
probabilities of two states agree within the Hoeffding bound; what is left is a probabilistic
automaton. Every other run of six or more credential characters, the least length and the alphabet
of the first base pattern, is then scored under each automaton
and under a model of ordinary runs; a run that some format explains better by a margin per character
becomes a span of kind ``format``.

The automata are fitted on a bounded, documented sample: at most ``sample`` labelled credentials per
kind, drawn by hash from all that the texts hold, and as many ordinary runs. The scan covers all texts as one map over rows.

Edge cases: a NULL text is an empty one; the same credential in many texts is one labelled example;
without examples there are no automata and no spans but the base ones; columns that bear the name of
an output column are replaced; an empty table gives an empty result.
"""

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

KINDS = ("assign", "access", "hex")
#: The base patterns; the second group of the first one is the credential.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: The same with their least lengths, for RE2: texts without a match have no base span.
HINT = r"(?i:(password|passwd|secret|token|api_?key)[\"']?\x20*[:=])|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
RUN_HINT = r"[A-Za-z0-9+/_.=-]{6}"
KNOWN_RUNS = 200_000
SAMPLE = 2_000
ALPHA = 0.05
MARGIN = 0.5
END = "$"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base findings, ends exclusive, in order of start and kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m.group()) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m.group()) >= 24]
    return sorted(found)


def credential(kind: int, span: str) -> str:
    return ASSIGN.match(span).group(2) if kind == 0 else span


#: Character classes of the automata: exact letters would need far more examples than there are.
CLASSES = str.maketrans(
    {c: k for k, cs in (("a", "abcdef"), ("z", "ghijklmnopqrstuvwxyz"), ("A", "ABCDEF"), ("Z", "GHIJKLMNOPQRSTUVWXYZ"), ("0", "0123456789")) for c in cs}
)


def symbols(run: str) -> str:
    return run.translate(CLASSES)


class Automaton:
    """A probabilistic automaton: per state the symbol -> (log-probability, next state)."""

    def __init__(self, states: list[dict[str, tuple[float, int]]], floor: float):
        self.states, self.floor = states, floor

    def score(self, word: str, floor: float | None = None) -> float:
        """Log-probability of the whole word; what the automaton has never seen costs ``floor``."""
        total, at = 0.0, 0
        floor = self.floor if floor is None else floor
        for symbol in word + END:
            weight, following = self.states[at].get(symbol, (floor, at))
            total += weight
            at = following
        return total


def infer(words: list[str], alpha: float = ALPHA) -> Automaton:
    """State merging: blue states join the first red state that is statistically compatible."""
    # The prefix tree; counts[s] is symbol -> count, turn[s] is symbol -> state.
    counts: list[dict[str, int]] = [{}]
    turn: list[dict[str, int]] = [{}]
    for word in words:
        at = 0
        for symbol in word + END:
            counts[at][symbol] = counts[at].get(symbol, 0) + 1
            if symbol == END:
                break
            if symbol not in turn[at]:
                turn[at][symbol] = len(counts)
                counts.append({})
                turn.append({})
            at = turn[at][symbol]
    spread = math.sqrt(0.5 * math.log(2 / alpha))

    def agree(red: int, blue: int) -> bool:
        """Both states, and all that follows in the tree below the blue one, within the bound."""
        waiting = [(red, blue)]
        while waiting:
            r, b = waiting.pop()
            n, m = sum(counts[r].values()), sum(counts[b].values())
            if not n or not m:
                continue
            bound = spread * (n**-0.5 + m**-0.5)
            for symbol in counts[r].keys() | counts[b].keys():
                if abs(counts[r].get(symbol, 0) / n - counts[b].get(symbol, 0) / m) > bound:
                    return False
            waiting += [(turn[r][s], turn[b][s]) for s in turn[b] if s in turn[r]]
        return True

    def fold(red: int, blue: int) -> None:
        waiting = [(red, blue)]
        while waiting:
            r, b = waiting.pop()
            for symbol, k in counts[b].items():
                counts[r][symbol] = counts[r].get(symbol, 0) + k
            for symbol, below in turn[b].items():
                if symbol in turn[r]:
                    waiting.append((turn[r][symbol], below))
                else:
                    turn[r][symbol] = below

    red, k = [0], 0
    border = [(0, s) for s in sorted(turn[0])]
    while k < len(border):
        parent, symbol = border[k]
        k += 1
        blue = turn[parent][symbol]
        if blue in red:
            continue
        for candidate in red:
            if agree(candidate, blue):
                turn[parent][symbol] = candidate
                fold(candidate, blue)
                # Folding may give red states new successors.
                border += [(r, s) for r in red for s in sorted(turn[r]) if turn[r][s] not in red and (r, s) not in border[k:]]
                break
        else:
            red.append(blue)
            border += [(blue, s) for s in sorted(turn[blue])]
    number = {state: i for i, state in enumerate(red)}
    states = []
    for state in red:
        total = sum(counts[state].values()) + 1
        states.append({s: (math.log(c / total), number[turn[state][s]] if s != END else 0) for s, c in counts[state].items()})
    return Automaton(states, math.log(1 / (len(words) + 1)))


@dataclass(frozen=True)
class Grammar:
    formats: dict[str, Automaton]
    ordinary: Automaton
    margin: float
    #: Log-odds of each kind against ordinary runs before a run is read.
    prior: dict[str, float] = field(default_factory=dict)

    def likelihood(self, run: str) -> float:
        """Log-odds per character of the best format against an ordinary run, priors included."""
        word = symbols(run)
        if not self.formats:
            return -math.inf
        # One floor for all: a format with few examples is no cheaper for what it has never seen.
        floor = min(a.floor for a in (self.ordinary, *self.formats.values()))
        best = max(a.score(word, floor) + self.prior.get(k, 0.0) for k, a in self.formats.items())
        return (best - self.ordinary.score(word, floor)) / (len(word) + 1)

    def spans(
        self, text: str, base: list[tuple[int, int, int]], known: dict[str, bool] | None = None
    ) -> list[tuple[int, int, int]]:
        """Runs outside of the base spans that are likelier a credential; ``known`` holds verdicts of runs seen before."""
        known = {} if known is None else known

        def likely(run: str) -> bool:
            if run not in known:
                if len(known) >= KNOWN_RUNS:
                    known.clear()
                known[run] = self.likelihood(run) > self.margin
            return known[run]

        found, k = [], 0
        base = sorted(base)
        ends = 0
        for m in RUN.finditer(text):
            while k < len(base) and base[k][0] < m.end():
                ends = max(ends, base[k][2])
                k += 1
            if ends > m.start():
                continue
            if likely(m.group()):
                found.append((m.start(), len(KINDS), m.end()))
        return found


def hinted(texts: pa.Array, pattern: str) -> list[bool]:
    return pc.match_substring_regex(texts, pattern).to_pylist()


def examples(docs: DataFrame, text_col: str, sample: int) -> list[tuple[str, str, int]]:
    """(kind, symbols, number of all such runs): at most ``sample`` distinct labelled runs of each kind, drawn by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(0), "")
            found: set[tuple[str, str]] = set()
            for value, hint in zip(texts, hinted(texts, HINT)):
                if hint:
                    text = value.as_py()
                    found.update((KINDS[k], credential(k, text[s:e])) for s, k, e in base_spans(text))
            for value in pc.filter(texts, pc.match_substring_regex(texts, RUN_HINT)):
                text = value.as_py()
                base = base_spans(text)
                found.update(
                    ("ordinary", m.group()) for m in RUN.finditer(text) if not any(s < m.end() and m.start() < e for s, _, e in base)
                )
            rows = sorted(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], pa.string()) for k in range(2)], names=["kind", "run"]
            )

    rows = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "kind string, run string").distinct()
    # The least hashes of each kind by a bounded aggregate: no window over a kind, no sort of all runs.
    best = rows.withColumn("h", F.xxhash64("run"))
    cut = best.groupBy("kind").agg(F.count("*").alias("n"))
    best = best.join(F.broadcast(cut), "kind").where(
        F.pmod("h", F.lit(1 << 20)) < F.ceil(F.lit(2.0 * sample * (1 << 20)) / F.col("n"))
    )
    place = Window.partitionBy("kind").orderBy("h", "run")
    picked = best.withColumn("at", F.row_number().over(place)).where(F.col("at") <= sample)
    return [(r["kind"], symbols(r["run"]), r["n"]) for r in picked.select("kind", "run", "n").collect()]


def fit(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE, margin: float = MARGIN) -> Grammar:
    """Automata of the kinds, fitted on the driver to at most ``4 * sample`` runs."""
    words: dict[str, list[str]] = {}
    total: dict[str, int] = {}
    for kind, word, n in sorted(examples(docs, text_col, sample)):
        words.setdefault(kind, []).append(word)
        total[kind] = n
    formats = {k: infer(words[k]) for k in KINDS if k in words}
    prior = {k: min(0.0, math.log(total[k] / total.get("ordinary", 1))) for k in formats}
    return Grammar(formats, infer(words.get("ordinary", [])), margin, prior)


SPAN = StructType().add("kind", StringType()).add("start", LongType()).add("end", LongType())
OUTPUT = ArrayType(SPAN)


def scan(docs: DataFrame, text_col: str = "text", grammar: Grammar | None = None) -> DataFrame:
    """``docs`` with ``secrets``: (kind, start, end) in code points, in order of start and kind."""
    grammar = fit(docs, text_col) if grammar is None else grammar
    names = (*KINDS, "format")
    kept = [f for f in docs.schema.fields if f.name != "secrets"]
    keep_at = [docs.columns.index(f.name) for f in kept]
    text_at = docs.columns.index(text_col)
    kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        for batch in batches:
            texts = pc.fill_null(batch.column(text_at).cast(pa.string()), "")
            rows = []
            for value, base_hint, run_hint in zip(texts, hinted(texts, HINT), hinted(texts, RUN_HINT)):
                text = value.as_py() if base_hint or run_hint else ""
                base = base_spans(text) if base_hint else []
                more = grammar.spans(text, base, known) if run_hint else []
                rows.append([{"kind": names[k], "start": s, "end": e} for s, k, e in sorted(base + more)])
            columns = [batch.column(k) for k in keep_at] + [pa.array(rows, kind_type)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in kept] + ["secrets"])

    return docs.mapInArrow(run, StructType([*kept, StructField("secrets", OUTPUT)]))
