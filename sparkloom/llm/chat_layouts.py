"""Chat formatting: records of many layouts to canonical turns, turns to a template with a loss mask.

The fingerprint of a record is the hash of its sorted nested field paths. It selects a declarative mapping; a record with further
fields takes the mapping with the most fields of those it contains. Turns are formatted row by
row, so a conversation of any length is never gathered; only its digest reads it in order.

Defined results. Null text is empty, a null role is the empty role. Turns are ordered by turn (null first), then the escaped role, then the
escaped text, so ties and repeated rows have one order. Records of no known layout give no turns, items of a list that are not objects neither; ``unmapped`` lists both. A record's own turn counts
if it is a whole number of 64 bits, else it is 0. Empty
tables give empty results. Extra columns are left out. Texts and roles may hold any control string: the three characters that begin one are escaped, reversibly.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import by_batch

TURNS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])


@dataclass(frozen=True)
class Turn:
    """One canonical turn: a fixed role and the text of some fields, joined by an empty line; blank ones give no turn."""

    role: str
    fields: tuple[str, ...]


@dataclass(frozen=True)
class Layout:
    """Field paths of a layout, and where its turns are: fixed ones, or a list of items with a role and a text field."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[Turn, ...] = ()
    items: str = ""
    role: str = ""
    text: str = ""

    @property
    def fingerprint(self) -> str:
        return fingerprint(self.paths)


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


LAYOUTS = (
    Layout("turn_rows", ("conv_id", "turn", "role", "text"), role="role", text="text"),
    Layout("messages", ("messages[].role", "messages[].content"), items="messages", role="role", text="content"),
    Layout("exchanges", ("conversations[].from", "conversations[].value"), items="conversations", role="from", text="value"),
    Layout("prompt_response", ("prompt", "response"), (Turn("user", ("prompt",)), Turn("assistant", ("response",)))),
    Layout("prompt_completion", ("prompt", "completion"), (Turn("user", ("prompt",)), Turn("assistant", ("completion",)))),
    Layout("instruction_output", ("instruction", "output"), (Turn("user", ("instruction",)), Turn("assistant", ("output",)))),
    Layout("instruction_input", ("instruction", "input", "output"), (Turn("user", ("instruction", "input")), Turn("assistant", ("output",)))),
    Layout("system_prompt", ("system", "prompt", "response"), (Turn("system", ("system",)), Turn("user", ("prompt",)), Turn("assistant", ("response",)))),
)
#: Other names of the roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def value_paths(value, at: str = "") -> set[str]:
    """Paths of all leaves; the items of a list share one path."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in value_paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {p for v in value for p in value_paths(v, f"{at}[]")}
    return {at}


def schema_paths(kind: T.DataType, at: str = "") -> set[str]:
    """The same paths from a Spark schema."""
    if isinstance(kind, T.StructType):
        return {p for f in kind for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)}
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return {at}


def layout_of(paths: set[str], layouts: tuple[Layout, ...] = LAYOUTS) -> Layout | None:
    own = fingerprint(paths)
    for x in layouts:
        if x.fingerprint == own:
            return x
    inside = [x for x in layouts if set(x.paths) <= paths]
    return max(inside, key=lambda x: (len(x.paths), x.name)) if inside else None


def record_turns(record, layout: Layout) -> list[tuple[str, str]]:
    said = lambda v: "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    if layout.items:
        return [(ROLES.get(r := said(x.get(layout.role)), r), said(x.get(layout.text))) for x in record.get(layout.items) or [] if isinstance(x, dict)]
    if layout.turns:
        found = [(t.role, "\n\n".join(x for f in t.fields if (x := said(record.get(f))))) for t in layout.turns]
        return [x for x in found if x[1]]
    return [(ROLES.get(r := said(record.get(layout.role)), r), said(record.get(layout.text)))]


def place_of(turn) -> int:
    return turn if isinstance(turn, int) and not isinstance(turn, bool) and abs(turn) < 1 << 63 else 0


def from_json(records: DataFrame, id_col: str = "conv_id", record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Turns of JSON records, each with the mapping its own fingerprint selects."""

    def convert(parts: Iterator[dict[str, list]]) -> Iterator[list[tuple]]:
        known: dict[str, Layout | None] = {}
        for x in parts:
            out = []
            for key, raw in zip(x["conv_id"], x["record"], strict=True):
                try:
                    value = json.loads(raw) if raw else None
                except ValueError:
                    value = None
                if not isinstance(value, dict):
                    continue
                paths = value_paths(value) - {"conv_id"} if "turn" not in value else value_paths(value)
                if (own := fingerprint(paths)) not in known:
                    known[own] = layout_of(paths, layouts)
                if found := known[own]:
                    first = place_of(value.get("turn")) if not (found.items or found.turns) else 0
                    out += [(key, first + k, role, text) for k, (role, text) in enumerate(record_turns(value, found))]
            yield out

    return by_batch(records.select(F.col(id_col).cast("long").alias("conv_id"), F.col(record).alias("record")), convert, TURNS)


def from_rows(rows: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Turns of a table whose schema is a layout of turn rows."""
    found = layout_of(schema_paths(rows.schema), layouts)
    if found is None or found.items or found.turns:
        raise ValueError(f"not a layout of turn rows: {sorted(schema_paths(rows.schema))}")
    role = F.coalesce(F.col(found.role), F.lit(""))
    alias = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.try_element_at(alias, role), role).alias("role"), F.coalesce(F.col(found.text), F.lit("")).alias("text"))


def unmapped(records: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Records that no layout fits, or with items that are left out, with their fingerprint (null where they are not JSON objects)."""

    @F.pandas_udf("fingerprint string, layout string")
    def look(raws: pd.Series) -> pd.DataFrame:
        out = []
        for raw in raws:
            try:
                value = json.loads(raw) if raw else None
            except ValueError:
                value = None
            paths = value_paths(value) if isinstance(value, dict) else None
            found = paths and layout_of(paths, layouts)
            items = value.get(found.items) if found and found.items else None
            whole = found and all(isinstance(v, dict) for v in items or [])
            out.append((paths and fingerprint(paths) or None, found.name if whole else None))
        return pd.DataFrame(out, columns=["fingerprint", "layout"])

    return records.withColumn("look", look(F.col(record))).where("look.layout IS NULL").select("*", "look.fingerprint").drop("look")


#: The template. Control strings begin with one of the characters that texts have escaped.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"


def escaped(text: Column) -> Column:
    r"""``\`` to ``\\``, ``<`` to ``\l``, ``[`` to ``\b``: no ``<`` or ``[`` is left, so no control string of this or another template."""
    for plain, safe in (("\\", "\\\\"), ("<", "\\l"), ("[", "\\b")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescaped(text: str) -> str:
    if "\\" not in text:
        return text
    return "\\".join(x.replace("\\l", "<").replace("\\b", "[").replace("\\p", "|") for x in text.split("\\\\"))


def formatted(turns: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One segment a turn, with the span that the loss covers (code points in the segment; empty for other roles)."""
    # A role ends where the head does, so it has its ``|`` escaped too, to ``\\p``.
    head = F.concat(F.lit(OPEN), F.replace(escaped(F.col("role")), F.lit("|"), F.lit("\\p")), F.lit(CLOSE))
    body = escaped(F.col("text"))
    rows = turns.select("conv_id", "turn", "role", "text", head.alias("head"), body.alias("body"))
    start = F.length("head").cast("long")
    span = F.when(F.col("role").isin(*trained), F.length("body")).otherwise(0)
    return rows.select("conv_id", "turn", F.concat("head", "body", F.lit(END)).alias("segment"), start.alias("loss_start"), (start + span).alias("loss_end"))


def parsed(segment: str) -> tuple[str, str]:
    head, body = segment[len(OPEN) : -len(END)].split(CLOSE, 1)
    return unescaped(head), unescaped(body)


def digests(segments: DataFrame) -> DataFrame:
    """Read segments back and digest each conversation. A conversation streams through its task, a batch at a time."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blank = object()
        at, n, chars, loss = blank, 0, 0, 0
        every, masked = hashlib.sha256(), hashlib.sha256()
        for x in parts:
            out = []
            for missing, key, segment, a, b in zip(x["no_id"], x["conv_id"], x["segment"], x["loss_start"], x["loss_end"], strict=True):
                key = None if missing else int(key)
                if at is blank or key != at:
                    if at is not blank:
                        out.append((at, n, every.hexdigest(), loss, masked.hexdigest(), chars))
                    at, n, chars, loss = key, 0, 0, 0
                    every, masked = hashlib.sha256(), hashlib.sha256()
                role, text = parsed(segment)
                every.update(f"{role}\n{text}\n".encode())
                part = unescaped(segment[a:b])
                masked.update(part.encode())
                n, chars, loss = n + 1, chars + len(segment), loss + len(part)
            yield frame(out)
        if at is not blank:
            yield frame([(at, n, every.hexdigest(), loss, masked.hexdigest(), chars)])

    def frame(out: list) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})

    rows = segments.select(F.coalesce("conv_id", F.lit(0)).alias("conv_id"), F.col("conv_id").isNull().alias("no_id"), "turn", "segment", "loss_start", "loss_end")
    # The head ends with its mark, which would part a role from a longer one.
    role = F.expr(f"substring(segment, {len(OPEN) + 1}, int(loss_start) - {len(OPEN) + len(CLOSE)})")
    return rows.repartition("no_id", "conv_id").sortWithinPartitions("no_id", "conv_id", "turn", role, "segment").mapInPandas(read, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
