"""Quality rules as a short-circuit cascade.

Every rule rejects a text or lets it pass; a text is kept when all rules let it pass. The cost and
the rejection rate of each rule are measured on a sample of the table, and the rules run in order
of rejections per cost, so that most bad texts never reach the dear rules. The order changes the
work and the name of the rule that rejects first, never the verdict.

Nothing is shuffled and no row leaves the JVM: all statistics are array expressions on one row.

Edge cases: a NULL text is an empty one and has no words; rows keep all their columns; columns that
bear the name of an output column are replaced; an empty table gives an empty result.
"""

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginwise.llm.text import fence, fresh, whole, words
from marginwise.session import stored

WINDOW = 5

# Array helpers. An array that a lambda reads must be a column, or it is built anew per element.


def word_lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)


def window_hashes(marks: Column) -> Column:
    """A hash for each window of five words, from the hashes of the words."""
    at = F.transform(marks, lambda h, i: F.xxhash64(h, *[F.get(marks, i + k) for k in range(1, WINDOW)]))
    return F.slice(at, 1, F.greatest(F.size(marks) - (WINDOW - 1), F.lit(0)))


def with_positions(hashes: Column) -> Column:
    """(h, i) in order of the hash, where a hash occurs twice; otherwise NULL."""
    repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
    pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.when(repeats, F.sort_array(pairs))


def repeated_starts(ordered: Column) -> Column:
    """Sorted positions of the hashes that occur twice or more."""
    same = F.filter(
        ordered,
        lambda w, i: F.coalesce((i > 0) & (F.get(ordered, i - 1)["h"] == w["h"]), F.lit(False))
        | F.coalesce(F.get(ordered, i + 1)["h"] == w["h"], F.lit(False)),
    )
    return F.sort_array(F.transform(same, lambda w: w["i"]))


def covered(starts: Column) -> Column:
    """Words inside the windows that begin at the sorted ``starts``."""
    steps = F.transform(
        starts, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - p, F.lit(WINDOW)))
    )
    return F.coalesce(F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0).cast("bigint"))


#: Statistic -> (what it is computed from, expression). Temporary ones begin with an underscore.
STATISTICS: dict[str, tuple[tuple[str, ...], Callable[..., Column]]] = {
    "_words": (("_text",), words),
    "_marks": (("_words",), lambda w: F.transform(w, lambda x: F.xxhash64(x))),
    "_windows": (("_marks",), window_hashes),
    "_ordered": (("_windows",), with_positions),
    "_starts": (("_ordered",), repeated_starts),
    "_lines": (("_text",), word_lines),
    "n_words": (("_words",), lambda w: F.size(w).cast("bigint")),
    "word_chars": (("_words",), lambda w: F.length(F.array_join(w, "")).cast("bigint")),
    "n_symbols": (("_text",), lambda t: F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("bigint")),
    "n_lines": (("_lines",), lambda x: F.size(x).cast("bigint")),
    "n_dup_lines": (("_lines",), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint")),
    "n_repeat_words": (("_starts",), covered),
}


@dataclass(frozen=True)
class Rule:
    """``rejects`` builds a condition from the statistics named in ``needs``."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[..., Column]


#: A text that fails one of these is bad whatever the other rules say.
BASE_RULES = (
    Rule("too_short", ("n_words",), lambda n: n < 10),
    Rule("repetition", ("n_repeat_words", "n_words"), lambda r, n: 100 * r > 20 * n),
)
#: Limits after the published rules for web text: a symbol per ten words, lines that repeat, odd mean word length.
MORE_RULES = (
    Rule("symbols", ("n_symbols", "n_words"), lambda s, n: 10 * s > n),
    Rule("line_copies", ("n_dup_lines", "n_lines"), lambda d, n: (d >= 3) & (10 * d > 3 * n)),
    Rule("word_length", ("word_chars", "n_words"), lambda c, n: (c < 2 * n) | (c > 15 * n)),
)
RULES = BASE_RULES + MORE_RULES
SAMPLE_ROWS = 2_000


def chain(needs: tuple[str, ...]) -> list[str]:
    """``needs`` and what they are computed from, in order of computation."""
    found: list[str] = []

    def visit(name: str) -> None:
        if name != "_text" and name not in found:
            for source in STATISTICS[name][0]:
                visit(source)
            found.append(name)

    for name in needs:
        visit(name)
    return found


class Steps:
    """Adds statistics to a table, each in a projection of its own, each at most once."""

    def __init__(self, docs: DataFrame, text_col: str):
        self.prefix, self.docs = fresh(docs), docs.columns
        self.names = {"_text": f"{self.prefix}_text"}
        self.df = docs.withColumn(self.names["_text"], whole(F.col(text_col)))

    def add(self, needs: tuple[str, ...], where: Column | None = None) -> list[Column]:
        for name in chain(needs):
            if name not in self.names:
                sources, make = STATISTICS[name]
                value = make(*[F.col(self.names[s]) for s in sources])
                self.names[name] = f"{self.prefix}{name}"
                self.df = self.df.withColumn(self.names[name], value if where is None else F.when(where, value))
        return [F.col(self.names[n]) for n in needs]


def rule_order(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS, text_col: str = "text") -> list[Rule]:
    """The rules by rejections per second, measured on a random sample of about ``sample_rows`` rows.

    The sample serves the order alone. Rules that reject nothing there come last, the cheap ones first.
    """
    rows = docs.count()
    share = min(1.0, sample_rows / rows) if rows else 1.0
    sample = stored(docs.select(F.col(text_col).alias("text")).sample(False, share, seed=8), "quality-sample")
    measured = []
    for rule in rules:
        steps = Steps(sample, "text")
        columns = steps.add(rule.needs)
        begin = time.perf_counter()
        rejected = steps.df.agg(F.count_if(rule.rejects(*columns))).first()[0]
        cost = time.perf_counter() - begin
        measured.append((rejected / cost, -cost, rule))
    return [rule for _, _, rule in sorted(measured, key=lambda m: m[:2], reverse=True)]


def cascade(docs: DataFrame, rules=RULES, order: list[Rule] | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``rejected_by``: the first rule that rejects the text, NULL for texts to keep.

    A rule's statistics are computed only for texts that no earlier rule has rejected.
    """
    order = order or rule_order(docs, rules, text_col=text_col)
    steps = Steps(docs, text_col)
    verdict = F.lit(None).cast("string")
    for k, rule in enumerate(order):
        columns = steps.add(rule.needs, where=verdict.isNull())
        name = f"{steps.prefix}verdict{k}"
        steps.df = steps.df.withColumn(name, F.coalesce(verdict, F.when(rule.rejects(*columns), F.lit(rule.name))))
        verdict = F.col(name)
    kept = [c for c in docs.columns if c != "rejected_by"]
    return fence(steps.df.select(*kept, verdict.alias("rejected_by")))


def judged(
    docs: DataFrame, names: tuple[str, ...], rules=RULES, order: list[Rule] | None = None, text_col: str = "text"
) -> DataFrame:
    """Like ``cascade``, with the named statistics of every text, rejected or not."""
    order = order or rule_order(docs, rules, text_col=text_col)
    steps = Steps(docs, text_col)
    columns = steps.add(names)
    verdict = F.coalesce(*[F.when(rule.rejects(*steps.add(rule.needs)), F.lit(rule.name)) for rule in order])
    taken = (*names, "rejected_by")
    kept = [c for c in docs.columns if c not in taken]
    return fence(steps.df.select(*kept, *[c.alias(n) for c, n in zip(columns, names)], verdict.alias("rejected_by")))
