"""Chat formatting: records of mixed layouts become canonical turns, and turns a text with a loss mask.

Every record has a fingerprint, the hash of its nested field paths (``messages[].role``, ...) as far as
any layout names them; other fields don't matter. The fingerprint selects a layout, a declaration of
where the turns lie. A record is a JSON text, whose paths are its own, or a struct column, whose
paths are those of its type without fields that are NULL in the row.

Template: ``<|im_start|>role LF text<|im_end|> LF`` per turn. Inside texts each ``<``, backslashes, ``|``
gets one backslash more, so no marker can arise from a text and the original comes back by taking one
away; roles escape ``&``, line feeds and ``<`` as entities. The loss mask covers assistant texts.

Defined results. A NULL text or role is an empty one, as is a NULL element of an array of turns; an
empty text is a turn. A record that is NULL, no JSON, holds a key twice or has unknown paths has no
layout and no turns; it is counted, not lost. An optional field makes a turn only where it is present. A conversation's records
follow one another by ``place`` (NULL first), records of one place by their formatted text; repeated ones
stay. Records without a conversation id form one conversation. Input columns are passed as
expressions and outputs are fixed, so no names clash. A text of any length is formatted whole;
a conversation is one row, so Spark's 2 GB for a string bound it. Empty tables give empty ones.
"""

from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>\n"
TRAINED = "assistant"
_TURNS = "array<struct<role:string,text:string>>"
_SPANS = "array<struct<at:bigint,start:bigint,end:bigint,trained:boolean>>"


@dataclass(frozen=True)
class Say:
    """One turn of a fixed role: the present fields, joined by a blank line. No field present: no turn."""

    role: str
    fields: tuple[str, ...]

    def paths(self) -> tuple[str, ...]:
        return self.fields


@dataclass(frozen=True)
class Row:
    """The record is one turn; two of its fields are role and text."""

    role: str
    text: str

    def paths(self) -> tuple[str, ...]:
        return self.role, self.text


@dataclass(frozen=True)
class Each:
    """One turn per element of an array; ``role`` and ``text`` are paths below the element. A text
    path ``parts[].text`` joins the texts of all parts."""

    array: str
    role: str
    text: str

    def paths(self) -> tuple[str, ...]:
        return tuple(f"{self.array}[]{'' if p.startswith('[') else '.'}{_kind(p)}" for p in (self.role, self.text))


@dataclass(frozen=True)
class Exchanges:
    """Two turns per element of an array of pairs: what the user and what the assistant says."""

    array: str

    def paths(self) -> tuple[str, ...]:
        return (f"{self.array}[][]",)


@dataclass(frozen=True)
class Layout:
    """Records with exactly these paths (``optional`` ones may lack, ``extra`` ones are known but not read)."""

    name: str
    turns: tuple[Say | Row | Each | Exchanges, ...]
    optional: tuple[str, ...] = ()
    extra: tuple[str, ...] = ()
    roles: dict[str, str] = field(default_factory=dict)

    def paths(self) -> frozenset[str]:
        return frozenset(p for t in self.turns for p in t.paths()) | frozenset(self.extra)

    def shapes(self) -> list[frozenset[str]]:
        """The sets of paths that records of this layout can have."""
        needed = self.paths() - frozenset(self.optional)
        chosen = [c for k in range(len(self.optional) + 1) for c in combinations(self.optional, k)]
        return [needed | frozenset(c) for c in chosen]


def _kind(path: str) -> str:
    """A path with positions as in a schema: ``[0]`` is ``[]``."""
    return "[]" if path.startswith("[") and path != "[]" else path


SPEAKERS = {"human": "user", "gpt": "assistant", "chatgpt": "assistant", "bot": "assistant"}
LAYOUTS = (
    Layout("row", (Row("role", "text"),)),
    Layout("messages", (Each("messages", "role", "content"),)),
    Layout(
        "messages of parts",
        (Each("messages", "role", "content[].text"),),
        extra=("messages[].content[].type",),
    ),
    Layout("speakers", (Say("system", ("system",)), Each("conversations", "from", "value")), ("system",), roles=SPEAKERS),
    Layout("pairs of role and text", (Each("turns", "[0]", "[1]"),), roles=SPEAKERS),
    Layout(
        "instruction",
        (Say("system", ("system",)), Say("user", ("instruction", "input")), Say("assistant", ("output",))),
        ("system", "input"),
    ),
    Layout(
        "prompt and completion",
        (Say("system", ("system",)), Say("user", ("prompt",)), Say("assistant", ("completion",))),
        ("system",),
    ),
    Layout(
        "prompt and response",
        (Say("system", ("system",)), Exchanges("history"), Say("user", ("prompt",)), Say("assistant", ("response",))),
        ("system", "history[][]"),
    ),
    Layout("question", (Say("user", ("context", "question")), Say("assistant", ("answer",))), ("context",)),
)


class _Json:
    """Access to a JSON record: the paths stem from the record itself."""

    def __init__(self, record: str):
        self.value = F.try_parse_json(F.col(record))

    def paths(self, known: list[str]) -> Column:
        """The leaf paths, by a walk over the tokens of the record's schema with a stack of open prefixes."""
        name = r"(?:`(?:[^`]|``)*`|[^\s`<>,:]+): "
        tokens = F.regexp_extract_all(
            F.coalesce(F.schema_of_variant(self.value), F.lit("")), F.lit(rf"{name}|OBJECT<|ARRAY<|>|[A-Z]+(?:\([0-9,]+\))?"), 0
        )
        start = F.from_json(
            F.lit('{"open":[],"path":"","found":[]}'), "open array<string>, path string, found array<string>"
        )

        def step(state: Column, token: Column) -> Column:
            opened, path, found = state["open"], state["path"], state["found"]
            above = F.coalesce(F.get(opened, F.size(opened) - 1), F.lit(""))
            named = F.concat(above, F.when(above == "", "").otherwise("."), F.regexp_replace(token, ": $", ""))
            array = F.concat(path, F.lit("[]"))

            def state_of(opened: Column, path: Column, found: Column) -> Column:
                return F.struct(opened.alias("open"), path.alias("path"), found.alias("found"))

            return (
                F.when(token.endswith(": "), state_of(opened, named, found))
                .when(token == "OBJECT<", state_of(F.array_append(opened, path), path, found))
                .when(token == "ARRAY<", state_of(F.array_append(opened, array), array, found))
                .when(token == ">", state_of(F.slice(opened, 1, F.greatest(F.size(opened) - 1, F.lit(0))), path, found))
                .otherwise(state_of(opened, path, F.array_append(found, path)))
            )

        found = F.aggregate(tokens, start, step, lambda s: s["found"])
        return F.array_intersect(found, F.array(*[F.lit(p) for p in known]))

    def has(self, path: str) -> bool:
        return True

    def text(self, path: str) -> Column:
        return F.try_variant_get(self.value, f"$.{path}", "string")

    def elements(self, path: str) -> Column:
        return F.try_variant_get(self.value, f"$.{path}", "array<variant>")

    def below(self, element: Column, path: str) -> Column:
        dotted = path if path.startswith("[") else f".{path}"
        if path.endswith("[].text"):
            parts = F.try_variant_get(element, f"${dotted.removesuffix('[].text')}", "array<variant>")
            return F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit(""))), "")
        return F.try_variant_get(element, f"${dotted}", "string")


class _Typed:
    """Access to a struct record: the paths are those of its type whose top field is not NULL in the row."""

    def __init__(self, record: str, kind: T.StructType):
        self.record, self.kind = F.col(record), kind
        self.leaves = self._leaves(kind, "")

    def _leaves(self, kind: T.DataType, path: str) -> list[str]:
        if isinstance(kind, T.StructType):
            return [p for f in kind for p in self._leaves(f.dataType, f"{path}.{f.name}" if path else f.name)]
        return self._leaves(kind.elementType, f"{path}[]") if isinstance(kind, T.ArrayType) else [path]

    def _top(self, path: str) -> Column:
        return self.record.getField(path.split(".")[0].split("[")[0])

    def paths(self, known: list[str]) -> Column:
        mine = [p for p in known if p in self.leaves]
        if not mine:
            return F.array().cast("array<string>")
        return F.array_compact(F.array(*[F.when(self._top(p).isNotNull(), F.lit(p)) for p in mine]))

    def has(self, path: str) -> bool:
        return path in self.leaves

    def _down(self, at: Column, path: str) -> Column:
        if path.startswith("["):
            return F.get(at, int(path[1:-1]))
        return reduce(lambda c, name: c.getField(name), path.split("."), at)

    def text(self, path: str) -> Column:
        return self._down(self.record, path).cast("string")

    def elements(self, path: str) -> Column:
        return self._down(self.record, path)

    def below(self, element: Column, path: str) -> Column:
        if path.endswith("[].text"):
            parts = self._down(element, path.removesuffix("[].text"))
            return F.array_join(F.transform(parts, lambda p: F.coalesce(p.getField("text").cast("string"), F.lit(""))), "")
        return self._down(element, path).cast("string")


def _hash(paths: Column) -> Column:
    return F.xxhash64(F.array_join(F.array_sort(paths), "\n"))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _read(access, layout: Layout, shape: frozenset[str]) -> Column:
    """The turns of a record of this shape."""

    def named(role: Column) -> Column:
        return reduce(lambda c, r: F.when(role == r[0], r[1]).otherwise(c), layout.roles.items(), role)

    def spoken(turn: Each):
        return lambda x: _turn(named(access.below(x, turn.role)), access.below(x, turn.text))

    def exchange(x: Column) -> Column:
        said = (("user", "[0]"), (TRAINED, "[1]"))
        return F.array(*[_turn(F.lit(role), access.below(x, path)) for role, path in said])

    parts = []
    for turn in layout.turns:
        if not shape.issuperset(turn.paths()) and not (isinstance(turn, Say) and shape.intersection(turn.fields)):
            continue
        if isinstance(turn, Say):
            texts = [F.nullif(access.text(p), F.lit("")) for p in turn.fields if p in shape]
            parts.append(F.array(_turn(F.lit(turn.role), F.concat_ws("\n\n", *texts))))
        elif isinstance(turn, Row):
            parts.append(F.array(_turn(named(access.text(turn.role)), access.text(turn.text))))
        elif isinstance(turn, Each):
            parts.append(F.transform(access.elements(turn.array), spoken(turn)))
        else:
            parts.append(F.flatten(F.transform(access.elements(turn.array), exchange)))
    return F.concat(*[F.coalesce(p.cast(_TURNS), F.array().cast(_TURNS)) for p in parts])


def canonical_turns(
    records: DataFrame, record: str, conversation: Column, place: Column, layouts: tuple[Layout, ...] = LAYOUTS
) -> DataFrame:
    """(conversation, place, fingerprint, layout, turns) of every record; ``layout`` is NULL where none fits.

    ``record`` names a column of JSON texts or structs.
    """
    kind = records.schema[record].dataType
    work = records.select(conversation.alias("conversation"), place.alias("place"), F.col(record).alias("record"))
    access = _Typed("record", kind) if isinstance(kind, T.StructType) else _Json("record")
    known = sorted({p for layout in layouts for p in layout.paths()})
    work = work.withColumn("fingerprint", _hash(access.paths(known)))
    name, turns = F.lit(None).cast("string"), F.array().cast(_TURNS)
    for layout in reversed(layouts):
        for shape in layout.shapes():
            if shape and all(access.has(p) for p in shape):
                same = F.col("fingerprint") == _hash(F.array(*[F.lit(p) for p in sorted(shape)]))
                name = F.when(same, layout.name).otherwise(name)
                turns = F.when(same, _read(access, layout, shape)).otherwise(turns)
    return work.select("conversation", "place", "fingerprint", name.alias("layout"), turns.alias("turns"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _escape_role(role: Column) -> Column:
    for plain, code in (("&", "&amp;"), ("\n", "&#10;"), ("<", "&lt;")):
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def _unescape_role(role: Column) -> Column:
    for plain, code in (("<", "&lt;"), ("\n", "&#10;"), ("&", "&amp;")):
        role = F.replace(role, F.lit(code), F.lit(plain))
    return role


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation: (conversation, formatted, spans, n_records, n_unmapped).

    ``spans`` has one element per turn, in code points of ``formatted``: ``at`` is its marker, ``start`` to
    ``end`` its escaped text, ``trained`` whether the loss counts it. Records are formatted where they lie; one shuffle by
    conversation brings the finished pieces together.
    """
    head = F.transform("turns", lambda t: F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n")))
    body = F.transform("turns", lambda t: escape(t["text"]))
    made = turns.select("conversation", "place", "layout", "turns", head.alias("head"), body.alias("body"))

    def step(state: Column, piece: Column) -> Column:
        start = state["next"] + F.length(piece["head"])
        end = start + F.length(piece["body"])
        span = F.struct(state["next"].alias("at"), start.alias("start"), end.alias("end"), piece["trained"].alias("trained"))
        kind = f"struct<next:bigint,spans:{_SPANS}>"
        return F.struct(end + len(END), F.array_append(state["spans"], span)).cast(kind)

    trained = F.transform("turns", lambda t: t["role"] == TRAINED)
    pieces = F.arrays_zip("head", "body", trained.alias("trained"))
    begin = F.from_json(F.lit('{"next":0,"spans":[]}'), f"next bigint, spans {_SPANS}")
    placed = F.aggregate(pieces, begin, step)
    text = F.array_join(F.transform(pieces, lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    made = made.select("conversation", "place", F.col("layout").isNull().alias("odd"), text.alias("text"), placed.alias("placed"))
    order = Window.partitionBy("conversation").orderBy(F.asc_nulls_first("place"), "text")
    before = F.sum(F.col("placed.next")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = made.withColumn("base", F.coalesce(before, F.lit(0)))
    piece = F.struct("base", "text", F.col("placed.spans").alias("spans"))
    found = rows.groupBy("conversation").agg(
        F.array_sort(F.collect_list(piece)).alias("pieces"), F.count("*").alias("n_records"), F.count_if("odd").alias("n_unmapped")
    )

    def moved(p: Column) -> Column:
        return F.transform(
            p["spans"],
            lambda s: F.struct(*[(s[n] + p["base"]).alias(n) for n in ("at", "start", "end")], s["trained"].alias("trained")),
        )

    return found.select(
        "conversation",
        F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"),
        F.flatten(F.transform("pieces", moved)).alias("spans"),
        "n_records",
        "n_unmapped",
    )


def _segments(formatted: Column) -> Column:
    """What follows each turn's first marker."""
    parts = F.split(formatted, START.replace("|", r"\|"))
    return F.slice(parts, 2, F.size(parts))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, as array of (role, text)."""

    def turn(segment: Column) -> Column:
        role = F.substring_index(segment, "\n", 1)
        size = F.length(segment) - F.length(role) - 1 - len(END)
        return F.struct(
            _unescape_role(role).alias("role"), unescape(F.substr(segment, F.length(role) + 2, size)).alias("text")
        )

    return F.transform(_segments(formatted), turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped. Each span is cut from its own turn, so this takes linear time."""
    both = F.transform(
        F.arrays_zip(_segments(formatted).alias("segment"), spans.alias("span")),
        lambda p: F.when(
            p["span"]["trained"],
            unescape(
                F.substr(
                    p["segment"],
                    (p["span"]["start"] - p["span"]["at"] - len(START) + 1).cast("int"),
                    (p["span"]["end"] - p["span"]["start"]).cast("int"),
                )
            ),
        ),
    )
    return F.array_join(both, "")
