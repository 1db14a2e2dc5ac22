"""Chat formatting by schema fingerprints.

A record's schema is the set of its nested field paths; a hash of it selects a declarative mapping from the registry, which turns the record
(prompt and completion, instruction and output, message lists, one row per turn, ...) into canonical turns. A template then marks
the turns; control strings inside roles and texts are escaped and can be read back exactly. Everything works on one turn per row, so
that a conversation of any length is never gathered in memory.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"


@dataclass(frozen=True)
class Each:
    """One turn per element of a list: its path and, inside an element, the paths of role and text."""

    items: str
    role: str
    text: str


@dataclass(frozen=True)
class One:
    """One turn of a fixed role, or of the role at ``role_path``; the texts at ``paths`` that are there, joined by an empty line."""

    role: str
    paths: tuple[str, ...]
    role_path: str = ""
    may_be_missing: bool = False


@dataclass(frozen=True)
class Layout:
    name: str
    required: frozenset[str]
    optional: frozenset[str]
    turns: tuple[Each | One, ...]
    roles: dict[str, str] = field(default_factory=dict)


SPOKEN = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}
LAYOUTS = [
    Layout("messages", frozenset({"messages[]"}), frozenset({"messages[].role", "messages[].content"}), (Each("messages", "role", "content"),)),
    Layout("conversations", frozenset({"conversations[]"}), frozenset({"conversations[].from", "conversations[].value", "system"}),
           (One("system", ("system",), may_be_missing=True), Each("conversations", "from", "value")), SPOKEN),
    Layout("instruction", frozenset({"instruction", "output"}), frozenset({"input", "system"}),
           (One("system", ("system",), may_be_missing=True), One("user", ("instruction", "input")), One("assistant", ("output",)))),
    Layout("prompt", frozenset({"prompt", "completion"}), frozenset({"system"}),
           (One("system", ("system",), may_be_missing=True), One("user", ("prompt",)), One("assistant", ("completion",)))),
    Layout("prompt_response", frozenset({"prompt", "response"}), frozenset({"system"}),
           (One("system", ("system",), may_be_missing=True), One("user", ("prompt",)), One("assistant", ("response",)))),
    Layout("question", frozenset({"question", "answer"}), frozenset({"context"}), (One("user", ("context", "question")), One("assistant", ("answer",)))),
    Layout("nested_data", frozenset({"data.prompt", "data.reply"}), frozenset(), (One("user", ("data.prompt",)), One("assistant", ("data.reply",)))),
    Layout("row", frozenset({"role"}), frozenset({"text"}), (One("", ("text",), role_path="role"),)),
    Layout("row_without_role", frozenset({"text"}), frozenset(), (One("", ("text",), role_path="role"),)),
]


def paths_of(value: object, at: str = "") -> set[str]:
    """Nested field paths of a decoded record; list elements share the path with "[]"; a null counts as absent."""
    if isinstance(value, dict):
        return {p for k, v in value.items() if v is not None for p in paths_of(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {f"{at}[]"}.union(*(paths_of(v, f"{at}[]") for v in value if isinstance(v, (dict, list))))
    return {at}


class Registry:
    """Mappings by schema fingerprint. Paths that no layout names (ids, scores, dates) do not enter the fingerprint."""

    def __init__(self, layouts: list[Layout] | None = None):
        self.layouts = LAYOUTS if layouts is None else layouts
        self.known = frozenset().union(*(x.required | x.optional for x in self.layouts))
        self.chosen: dict[int, Layout | None] = {}

    def fingerprint(self, record: object) -> tuple[int, frozenset[str]]:
        paths = self.known & paths_of(record)
        return xxhash.xxh3_64_intdigest("\n".join(sorted(paths))), paths

    def select(self, record: object) -> tuple[int, Layout | None]:
        mark, paths = self.fingerprint(record)
        if mark not in self.chosen:
            self.chosen[mark] = next((x for x in self.layouts if x.required <= paths <= x.required | x.optional), None)
        return mark, self.chosen[mark]


def _at(record: object, path: str) -> object:
    for key in path.split(".") if path else ():
        record = record.get(key) if isinstance(record, dict) else None
    return record


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns_of(record: object, layout: Layout) -> list[tuple[str, str]]:
    """(role, text) of every turn."""
    out = []
    for part in layout.turns:
        if isinstance(part, Each):
            for item in _at(record, part.items) or []:
                role = _text(_at(item, part.role))
                out.append((layout.roles.get(role, role), _text(_at(item, part.text))))
        else:
            there = [_text(v) for p in part.paths if (v := _at(record, p)) is not None]
            if there or not part.may_be_missing:
                role = _text(_at(record, part.role_path)) if part.role_path else part.role
                out.append((layout.roles.get(role, role), "\n\n".join(there)))
    return out


def canonical_turns(records: DataFrame, record_col: str = "record", layouts: list[Layout] | None = None) -> DataFrame:
    """``records`` exploded to turns: its other columns, layout, schema (fingerprint), turn_in_record, role, text.

    A record that is null, no JSON object or of no known layout stays as one row with null layout, role and text. A record without turns (an
    empty message list) stays likewise, with its layout. Columns of ``records`` with one of the new names are replaced.
    """
    new = ["layout", "schema", "turn_in_record", "role", "text"]
    kept = [c for c in records.columns if c not in [*new, record_col]]
    registry = Registry(layouts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, rows = [], []
            for k, text in enumerate(batch.column(len(kept)).to_pylist()):
                try:
                    record = json.loads(text) if text is not None else None
                except ValueError:
                    record = None
                mark, layout = registry.select(record) if isinstance(record, dict) else (None, None)
                turns = turns_of(record, layout) if layout else []
                for n, (role, said) in enumerate(turns or [(None, None)]):
                    take.append(k)
                    rows.append((layout.name if layout else None, None if mark is None else f"{mark:016x}", n if turns else None, role, said))
            columns = list(zip(*rows)) or [[]] * 5
            cells = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()))]
            old = batch.take(pa.array(take, pa.int64())).columns[: len(kept)]
            yield pa.RecordBatch.from_arrays([*old, *cells], names=[*kept, *new])

    source = records.select(*kept, F.col(record_col).cast("string").alias("_record"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]),
                        "layout string, schema string, turn_in_record int, role string, text string"])
    return source.mapInArrow(run, schema)


def escaped(text: Column) -> Column:
    r"""One backslash more between "<" and "|": the result holds no control string."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def escaped_role(role: Column) -> Column:
    """Roles are also kept on one line."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turns(turns: DataFrame, role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``turns`` with ``formatted`` (the turn in the template), ``loss_start`` and ``loss_past``: the code points of ``formatted`` under
    the loss mask, the text of an assistant turn; both null for other roles. A null role or text counts as empty; a row with neither layout
    nor turn is formatted to nothing when ``layout`` is a column of ``turns`` and both are null."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    head = F.concat(F.lit(START), escaped_role(role), F.lit("\n"))
    formatted = F.concat(head, escaped(text), F.lit(END + "\n"))
    if "layout" in turns.columns:
        formatted = F.when(F.col(role_col).isNull() & F.col(text_col).isNull(), F.lit("")).otherwise(formatted)
    spoken = role == ASSISTANT
    return turns.withColumns({"formatted": formatted, "loss_start": F.when(spoken, F.length(head)),
                              "loss_past": F.when(spoken, F.length(head) + F.length(escaped(text)))})


TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.S)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of all turns of a formatted string."""
    return [(unescape_role(role), unescape(text)) for role, text in TURN.findall(formatted)]


def conversation_digests(formatted: DataFrame, id_col: str, order_cols: list[str]) -> DataFrame:
    """One row per conversation, read back from its formatted turns: the id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Rows are sorted by conversation inside their partitions and streamed, so a conversation of any length costs a constant amount
    of memory; a digest of its text is sequential by nature.
    """
    kind = formatted.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = object(), None

        def row() -> tuple:
            return (current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        for batch in batches:
            done = []
            for conv, chunk, start, past in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if conv != current:
                    if state is not None:
                        done.append(row())
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_back(chunk):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    learnt = unescape(chunk[start:past])
                    state[2] += len(learnt)
                    state[3].update(learnt.encode())
                state[4] += len(chunk)
            yield _digest_rows(done, batch.schema.field(0).type)
        if state is not None:
            yield _digest_rows([row()], batch.schema.field(0).type)

    dealt = formatted.select(F.col(id_col).alias("_id"), "formatted", "loss_start", "loss_past", *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order_cols)])
    ordered = dealt.repartition("_id").sortWithinPartitions("_id", *[f"_o{k}" for k in range(len(order_cols))])
    return ordered.select("_id", "formatted", "loss_start", "loss_past").mapInArrow(
        run, f"`{id_col}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digest_rows(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 6
    kinds = (id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                      names=["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
