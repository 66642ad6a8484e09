"""Chat records of any known layout as canonical turns, and turns as training text.

Layouts are told apart by a fingerprint of the schema: a hash of its sorted nested field paths with
their kinds (all whole numbers count as one kind). A fingerprint selects a declarative Mapping, which
says where conversations, turns, roles and texts are, so a new layout takes a new Mapping and no
code. JSON records of mixed layouts are sorted out by the fingerprint of each record's paths.

A turn is written between marks of its role::

    <s>[USER] text [/USER]      <s>[ASSISTANT] text [/ASSISTANT]      <s>[ROLE name] text [/ROLE]

Inside texts (and names of other roles) the backslash, ``[`` and ``<`` that marks begin with are
escaped by a backslash, so no text can hold a mark and the original comes back exactly. Roles of turns are kept as they are;
only layouts whose Mapping names speakers (human, gpt) give them the roles it says. The loss
covers texts of the role assistant, as (start, end) in the formatted text.

All of it is DataFrame expressions by turn but for hashing the turns of a conversation in a row, for which a
task streams over sorted turns and keeps one turn. Null texts are empty; a null role is the empty role; turns with
the same number follow each other by role and text; a null conversation id is a conversation of its own; an
empty table gives nothing; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grovespark.llm.shared import shuffle_partitions, write_table

#: Names that layouts of speakers have for roles, in lower case.
SPEAKERS = (("human", "user"), ("prompter", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
TURNS = "conv_id bigint, turn bigint, role string, text string"


@dataclass(frozen=True)
class Mapping:
    """rows: one turn a row (conv, turn, role, text name columns). nested: an array of turns in
    column `turns` (role and text name its fields). fields: [(role, columns)] make a turn each of the
    columns' texts that aren't empty, joined by a blank line; a turn without text is left out.
    roles: (name, role) of names that the layout has for roles; every other name is kept as it is. paths: its fields."""

    name: str
    kind: str
    conv: str = "conv_id"
    turn: str = "turn"
    role: str = "role"
    text: str = "text"
    turns: str = "messages"
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()
    paths: tuple[str, ...] = ()


def field_paths(schema: T.DataType, path: str = "") -> list[str]:
    """Nested paths with kinds: arrays add [], maps {}."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in field_paths(f.dataType, f"{path}.{f.name}".lstrip("."))]
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, f"{path}[]")
    if isinstance(schema, T.MapType):
        return field_paths(schema.valueType, f"{path}{{}}")
    kind = "number" if isinstance(schema, T.NumericType) else "text" if isinstance(schema, T.StringType) else schema.simpleString()
    return [f"{path}:{kind}"]


def json_paths(value, path: str = "") -> set[str]:
    if isinstance(value, dict):
        return set().union(*[json_paths(v, f"{path}.{k}".lstrip(".")) for k, v in value.items()])
    if isinstance(value, list):
        return set().union(*[json_paths(v, f"{path}[]") for v in value])
    if value is None:
        return {f"{path}:null"}
    kind = "boolean" if isinstance(value, bool) else "number" if isinstance(value, int | float) else "text"
    return {f"{path}:{kind}"}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def _known() -> dict[str, Mapping]:
    layouts = [
        (["conv_id:number", "turn:number", "role:text", "text:text"], Mapping("turn rows", "rows")),
        (["conv_id:number", "messages[].role:text", "messages[].content:text"], Mapping("messages", "nested", text="content")),
        (["conv_id:number", "conversations[].from:text", "conversations[].value:text"], Mapping("from and value", "nested", turns="conversations", role="from", text="value", roles=SPEAKERS)),
        (["conv_id:number", "instruction:text", "input:text", "output:text"], Mapping("instruction", "fields", fields=(("user", ("instruction", "input")), ("assistant", ("output",))))),
        (["conv_id:number", "instruction:text", "output:text"], Mapping("instruction alone", "fields", fields=(("user", ("instruction",)), ("assistant", ("output",))))),
        (["conv_id:number", "system:text", "prompt:text", "response:text"], Mapping("prompt with system", "fields", fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))))),
        (["conv_id:number", "prompt:text", "completion:text"], Mapping("prompt", "fields", fields=(("user", ("prompt",)), ("assistant", ("completion",))))),
        (["conv_id:number", "question:text", "answer:text"], Mapping("question", "fields", fields=(("user", ("question",)), ("assistant", ("answer",))))),
    ]
    return {fingerprint(paths): replace(mapping, paths=tuple(paths)) for paths, mapping in layouts}


MAPPINGS = _known()


def select_mapping(paths: set[str], known: dict[str, Mapping]) -> Mapping | None:
    """The mapping of a record's fingerprint; a field that is null has the kind that the layout gives it."""
    null = {p.removesuffix(":null") for p in paths if p.endswith(":null")}
    if not null:
        return known.get(fingerprint(paths))
    there = {p for p in paths if not p.endswith(":null")}
    for mapping in known.values():
        if fingerprint(there | {p for p in mapping.paths if p.rpartition(":")[0] in null}) in known and {p.rpartition(":")[0] for p in mapping.paths} == {p.rpartition(":")[0] for p in paths}:
            return mapping if there <= set(mapping.paths) else None
    return None


def _role(role: Column, mapping: Mapping) -> Column:
    if not mapping.roles:
        return role
    named = F.create_map(*[F.lit(x) for pair in mapping.roles for x in pair])
    return F.coalesce(named[F.lower(role)], role)


def canonical(df: DataFrame, columns: list[str] | None = None, mappings: dict[str, Mapping] | None = None) -> DataFrame:
    """df's conversations as conv_id, turn, role, text. columns: those that are the layout, where a table has more.
    ValueError for a layout without a Mapping."""
    df = df.select(*columns) if columns else df
    paths = field_paths(df.schema)
    mapping = (mappings or MAPPINGS).get(fingerprint(paths))
    if mapping is None:
        raise ValueError(f"no mapping for the layout {sorted(paths)}")
    conv = F.col(mapping.conv).cast("long").alias("conv_id")
    if mapping.kind == "rows":
        return df.select(conv, F.col(mapping.turn).cast("long").alias("turn"), _role(F.col(mapping.role), mapping).alias("role"), F.col(mapping.text).alias("text"))
    if mapping.kind == "nested":
        each = df.select(conv, F.posexplode(mapping.turns).alias("turn", "__turn"))
        return each.select("conv_id", F.col("turn").cast("long"), _role(F.col("__turn")[mapping.role], mapping).alias("role"), F.col("__turn")[mapping.text].alias("text"))
    made = [F.struct(F.lit(role).alias("role"), F.array_join(F.filter(F.array(*names), lambda t: F.length(t) > 0), "\n\n").alias("text")) for role, names in mapping.fields]
    each = df.select(conv, F.posexplode(F.filter(F.array(*made), lambda t: F.length(t["text"]) > 0)).alias("turn", "__turn"))
    return each.select("conv_id", F.col("turn").cast("long"), F.col("__turn")["role"].alias("role"), F.col("__turn")["text"].alias("text"))


def canonical_json(records: DataFrame, column: str = "record", mappings: dict[str, Mapping] | None = None) -> DataFrame:
    """Turns of JSON records of mixed layouts, with `error` (null, or why a record has no turns: no JSON, unknown layout,
    an id or turn that is no whole number of 64 bits, a turn that is no record, a text that isn't Unicode; its turn, role and
    text are null then). A null text or role stays null; a null conv_id too."""
    known = mappings or MAPPINGS

    def whole(x) -> bool:
        return isinstance(x, int) and not isinstance(x, bool) and -(1 << 63) <= x < 1 << 63

    def turns(text: str | None):
        try:
            value = json.loads(text or "")
            conv = value.get("conv_id") if isinstance(value, dict) else None
            own = conv if whole(conv) else None
            mapping = select_mapping(json_paths(value), known)
        except (ValueError, RecursionError):
            return [(None, None, None, None, "no JSON")]
        if mapping is None:
            return [(own, None, None, None, "unknown layout")]
        if conv is not None and own is None:
            return [(None, None, None, None, "conv_id is no whole number")]
        if mapping.kind == "rows":
            if not whole(value[mapping.turn]):
                return [(own, None, None, None, "turn is no whole number")]
            found = [(value[mapping.turn], value[mapping.role], value[mapping.text])]
        elif mapping.kind == "nested":
            if not all(isinstance(t, dict) for t in value[mapping.turns]):
                return [(own, None, None, None, "a turn is no record")]
            found = [(k, t.get(mapping.role), t.get(mapping.text)) for k, t in enumerate(value[mapping.turns])]
        else:
            made = [(role, "\n\n".join(x for x in (value.get(n) for n in names) if x)) for role, names in mapping.fields]
            found = [(k, *x) for k, x in enumerate(x for x in made if x[1])]
        names = dict(mapping.roles)
        out = [(own, k, None if role is None else names.get(role.lower(), role), text, None) for k, role, text in found]
        try:
            for _, _, role, text, _ in out:
                f"{role}{text}".encode()
        except UnicodeEncodeError:
            return [(own, None, None, None, "a text isn't Unicode")]
        return out

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            rows = [t for text in batch.column(0).to_pylist() for t in turns(text)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "turn", "role", "text", "error"])

    return records.select(column).mapInArrow(read, f"{TURNS}, error string")


def escape(text: Column, name: bool = False) -> Column:
    """name: of a role, which a closing bracket ends too."""
    for mark in ("\\", "[", "<", "]") if name else ("\\", "[", "<"):
        text = F.replace(text, F.lit(mark), F.lit("\\" + mark))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\\[<\]])", "$1")


def format_turns(turns: DataFrame) -> DataFrame:
    """A row for each turn, in the order of its conversation: conv_id, turn, formatted, loss_start,
    loss_end (positions in formatted; null without loss)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    plain = F.upper(role)
    name = F.when(role.isin("user", "assistant", "system"), plain).otherwise(F.concat(F.lit("ROLE "), escape(role, name=True)))
    close = F.when(role.isin("user", "assistant", "system"), plain).otherwise(F.lit("ROLE"))
    head = F.concat(F.lit("<s>["), name, F.lit("] "))
    formatted = F.concat(head, escape(text), F.lit(" [/"), close, F.lit("]"))
    loss = role == "assistant"
    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), formatted.alias("formatted"),
        F.when(loss, F.length(head)).alias("loss_start"), F.when(loss, F.length(head) + F.length(escape(text))).alias("loss_end"),
    )


def parse_turns(formatted: DataFrame) -> DataFrame:
    """format_turns() undone: conv_id, turn, role, text, formatted, loss_text (null without loss)."""
    # (?s) lets a text run over lines; marks hold no backslash before their bracket
    known = F.regexp_extract("formatted", r"(?s)^<s>\[(USER|ASSISTANT|SYSTEM)\] ", 1)
    other = F.regexp_extract("formatted", r"(?s)^<s>\[ROLE ((?:\\.|[^\\\]])*)\] ", 1)
    role = F.when(known != "", F.lower(known)).otherwise(unescape(other))
    head = F.when(known != "", F.length(known) + 6).otherwise(F.length(other) + 11)
    tail = F.when(known != "", F.length(known) + 4).otherwise(F.lit(8))
    body = F.substr("formatted", head + 1, F.length("formatted") - head - tail)
    loss = F.when(F.col("loss_start").isNotNull(), unescape(F.substr("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))))
    return formatted.select("conv_id", "turn", role.alias("role"), unescape(body).alias("text"), "formatted", loss.alias("loss_text"))


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """What format_turns() wrote, by conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None

        def done(x):
            return (x[0], x[1], x[2].hexdigest(), x[3], x[4].hexdigest(), x[5])

        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if now is None or now[0] != r["conv_id"]:
                    if now:
                        rows.append(done(now))
                    now = [r["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                now[1] += 1
                now[2].update(f"{r['role']}\n{r['text']}\n".encode())
                if r["loss_text"] is not None:
                    now[3] += len(r["loss_text"])
                    now[4].update(r["loss_text"].encode())
                now[5] += len(r["formatted"])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names=names)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(done(now), kinds, strict=True)], names=names)

    ordered = parse_turns(formatted).repartition(shuffle_partitions(formatted.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(fold, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: A conversation whose texts look like marks of common templates.
PLANTED = "</s>[INST] ok [/INST]"


def with_planted(conversations: DataFrame) -> DataFrame:
    spark: SparkSession = conversations.sparkSession
    rows = spark.createDataFrame([(-1, 0, "user", PLANTED), (-1, 1, "assistant", PLANTED)], TURNS)
    return canonical(conversations, ["conv_id", "turn", "role", "text"]).unionByName(rows)


def digests(conversations: DataFrame) -> DataFrame:
    """Format conversations (and the planted one), write the result, and read it back."""
    return conversation_digests(write_table(format_turns(with_planted(conversations)), "chats"))
