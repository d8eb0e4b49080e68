"""Chat formatting: a machine over roles, a template, segments with loss flags.

``format_chats`` sends each conversation through one task in turn order.  The
task holds a machine state and one turn: it checks the turn order by the
template's transitions and emits, turn by turn, the text segments of the
formatted conversation, each with its loss flag.  A conversation of any length
streams through; it is never gathered.  ``read_chats`` takes segments back to
turns, also one at a time, from their text alone.

Control strings inside texts are escaped: of each occurrence, also overlapping
ones, the first character becomes ``\\`` and a digit, and ``\\`` itself becomes
``\\0``.  What is left cannot contain a control string, and the digit tells what
stood there.

Defined results: a null text is empty, a null role is an empty name, and a role
the template does not know is written by name in brackets and makes the
conversation invalid; turns of one number go by role and text; repeated rows are
turns each; a null id is a conversation of its own; an empty table gives an
empty result.  Invalid conversations are formatted like others and marked.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Template:
    """Headers by role, the end of a turn, which roles are learned, and the
    machine: ``moves[state][role]`` is the next state."""

    headers: dict[str, str]
    learned: frozenset[str]
    moves: dict[str, dict[str, str]]
    start: str = "start"
    other: tuple[str, str] = ("### [", "]: ")
    end: str = " </turn>\n"
    control: tuple[str, ...] = ("###", "</turn>")
    _escapes: list = field(default_factory=list, compare=False, repr=False)

    def __post_init__(self) -> None:
        for text in self.control:
            if not text or "\\" in text or any(c.isdigit() for c in text):
                raise ValueError(f"not a control string: {text!r}")
        marks = [*self.headers.values(), self.other[0], self.end]
        if any(not any(c in m for c in self.control) for m in marks) or len(self.control) > 8:
            raise ValueError("every header and the end need a control string")
        pattern = "|".join(
            [r"(\\)"] + [f"({re.escape(c[0])})(?={re.escape(c[1:])})" for c in self.control]
        )
        self._escapes.append(re.compile(pattern))

    def escape(self, text: str) -> str:
        return self._escapes[0].sub(lambda m: f"\\{m.lastindex - 1}", text)

    def unescape(self, text: str) -> str:
        back = "\\" + "".join(c[0] for c in self.control)
        return re.sub(
            r"\\(\d)", lambda m: "]" if m[1] == "9" else back[int(m[1])], text
        )

    def header(self, role: str) -> str:
        if role in self.headers:
            return self.headers[role]
        return f"{self.other[0]}{self.escape(role).replace(']', chr(92) + '9')}{self.other[1]}"

    def parse(self, turn: str) -> tuple[str, str]:
        """Role and text of one formatted turn."""
        if not turn.endswith(self.end):
            raise ValueError("not a whole turn")
        body = turn[: -len(self.end)]
        for role, header in self.headers.items():
            if body.startswith(header):
                return role, self.unescape(body[len(header) :])
        first, second = self.other
        name, _, text = body[len(first) :].partition(second)
        return self.unescape(name), self.unescape(text)


#: A system turn may open; then user and assistant take turns, the assistant
#: may call tools, whose answers go back to it.
TEMPLATE = Template(
    headers={
        "system": "### System: ",
        "user": "### User: ",
        "assistant": "### Assistant: ",
        "tool": "### Tool: ",
    },
    learned=frozenset(["assistant"]),
    moves={
        "start": {"system": "opened", "user": "asked"},
        "opened": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked", "tool": "asked"},
    },
)


def format_chats(rows: DataFrame, template: Template = TEMPLATE, id: str = "conv_id") -> DataFrame:
    """(id, segment, text, loss, valid): the segments of each conversation in
    order; ``valid`` is whether the turn order held up to this turn."""
    known = rows.select(
        rows[id].alias(id),
        rows["turn"].alias("turn"),
        F.coalesce(rows["role"], F.lit("")).alias("role"),
        F.coalesce(rows["text"], F.lit("")).alias("text"),
    )
    order = [F.asc_nulls_first(id), F.asc_nulls_first("turn"), "role", "text"]
    placed = known.repartition(F.col(id)).sortWithinPartitions(*order).drop("turn")
    schema = T.StructType(
        [
            placed.schema[id],
            T.StructField("segment", T.LongType()),
            T.StructField("text", T.StringType()),
            T.StructField("loss", T.BooleanType()),
            T.StructField("valid", T.BooleanType()),
        ]
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state, segment, valid, fresh = None, template.start, 0, True, True
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                columns: list[list] = [[], [], [], [], []]
                for key, role, text in zip(*(c.to_pylist() for c in part.columns)):
                    if fresh or key != own:
                        own, state, segment, valid, fresh = key, template.start, 0, True, False
                    step = template.moves.get(state, {}).get(role)
                    valid = valid and step is not None
                    state = step if step is not None else state
                    pieces = (
                        (template.header(role), False),
                        (template.escape(text), role in template.learned),
                        (template.end, False),
                    )
                    for piece, loss in pieces:
                        for column, value in zip(columns, (key, segment, piece, loss, valid)):
                            column.append(value)
                        segment += 1
                kinds = (batch.schema.types[0], pa.int64(), pa.string(), pa.bool_(), pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], names=schema.names
                )

    return placed.mapInArrow(write, schema)


def read_chats(segments: DataFrame, template: Template = TEMPLATE, id: str = "conv_id") -> DataFrame:
    """One row per conversation from its segments' texts and loss flags: the
    digests of its turns and of its learned text, and their sizes."""
    placed = segments.select(id, "segment", "text", "loss", "valid").repartition(F.col(id))
    placed = placed.sortWithinPartitions(F.asc_nulls_first(id), "segment").drop("segment")
    rest = (
        "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string,"
        " formatted_chars long, valid boolean"
    )
    schema = T.StructType([placed.schema[id], *T._parse_datatype_string(rest).fields])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, digest, kind = None, None, None

        def row(done: list[_Digest], keys: list) -> pa.RecordBatch:
            columns = [keys, *zip(*(d.row() for d in done))]
            kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds)]
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        for batch in batches:
            kind = batch.schema.types[0]
            done, keys = [], []
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                for key, text, loss, valid in zip(*(c.to_pylist() for c in part.columns)):
                    if digest is None or key != own:
                        if digest is not None:
                            done.append(digest)
                            keys.append(own)
                        own, digest = key, _Digest(template)
                    digest.add(text, loss, valid)
            if done:
                yield row(done, keys)
        if digest is not None:
            yield row([digest], [own])

    return placed.mapInArrow(read, schema)


class _Digest:
    """What is kept of a conversation while its segments pass by."""

    def __init__(self, template: Template) -> None:
        self.template = template
        self.turns, self.learned = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss = self.size = 0
        self.open: list[str] = []
        self.valid = True

    def add(self, text: str, loss: bool, valid: bool) -> None:
        self.size += len(text)
        self.valid &= valid
        if loss:
            plain = self.template.unescape(text)
            self.loss += len(plain)
            self.learned.update(plain.encode("utf-8", "surrogatepass"))
        self.open.append(text)
        if text == self.template.end:
            role, body = self.template.parse("".join(self.open))
            self.turns.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
            self.open, self.n = [], self.n + 1

    def row(self) -> tuple:
        if self.open:
            raise ValueError("a conversation ends inside a turn")
        return (
            self.n, self.turns.hexdigest(), self.loss, self.learned.hexdigest(),
            self.size, self.valid,
        )
