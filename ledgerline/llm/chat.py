"""Chat formatting: records of many layouts, told apart by a fingerprint of their field paths, to one marked text with a loss mask.

A turn is ``<turn:role>text</turn>``. The control strings are ``<turn:`` and ``</turn>``. Wherever a text has one, also with backslashes after its
first character, one more backslash is put there; taking one away restores the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

OPEN, CLOSE = "<turn:", "</turn>"
TURNS = "array<struct<role:string, text:string>>"


@dataclass(frozen=True)
class Said:
    """One turn of a fixed role; its text is that of the paths, joined by an empty line where several are not empty."""

    role: str
    paths: tuple[str, ...]


@dataclass(frozen=True)
class Each:
    """One turn for each element of an array of structs, in its order; roles renames."""

    array: str
    role: str
    text: str
    roles: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Layout:
    """A layout of records, declared: its turns in order. Its field paths are those that the turns name."""

    name: str
    turns: tuple[Said | Each, ...]

    @property
    def paths(self) -> list[str]:
        named = [p for t in self.turns for p in (t.paths if isinstance(t, Said) else (f"{t.array}[].{t.role}", f"{t.array}[].{t.text}"))]
        return sorted(set(named))

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256("\n".join(self.paths).encode()).hexdigest()


SHARED_ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
LAYOUTS = (
    Layout("turns", (Each("turns", "role", "text"),)),
    Layout("messages", (Each("messages", "role", "content", SHARED_ROLES),)),
    Layout("nested messages", (Each("data.messages", "role", "content", SHARED_ROLES),)),
    Layout("exchange", (Each("conversations", "from", "value", SHARED_ROLES),)),
    Layout("exchange, system", (Said("system", ("system",)), Each("conversations", "from", "value", SHARED_ROLES))),
    Layout("prompt", (Said("user", ("prompt",)), Said("assistant", ("completion",)))),
    Layout("prompt, response", (Said("user", ("prompt",)), Said("assistant", ("response",)))),
    Layout("prompt, response, system", (Said("system", ("system",)), Said("user", ("prompt",)), Said("assistant", ("response",)))),
    Layout("question", (Said("user", ("question",)), Said("assistant", ("answer",)))),
    Layout("instruction", (Said("user", ("instruction",)), Said("assistant", ("output",)))),
    Layout("instruction, input", (Said("user", ("instruction", "input")), Said("assistant", ("output",)))),
)


def at(path: str) -> Column:
    """The column of a path without arrays; names may hold any character but ``.`` and ``[``."""
    return F.col(".".join(f"`{p}`" for p in path.split(".")))


def leaf_paths(kind: DataType, path: str = "", holder: str | None = None) -> Iterator[tuple[str, str]]:
    """(leaf path, outermost path that tells whether a record has it): ``a.b``, ``a[].b``, ``a[]``.

    A leaf is there where it is not null; a leaf within an array is there where the array is.
    """
    if isinstance(kind, StructType):
        for f in kind.fields:
            yield from leaf_paths(f.dataType, f"{path}.{f.name}" if path else f.name, holder)
    elif isinstance(kind, ArrayType):
        yield from leaf_paths(kind.elementType, f"{path}[]", holder or path)
    else:
        yield path, holder or path


def fingerprint(schema: StructType, known: set[str]) -> Column:
    """sha256 of the sorted known field paths that a record has. Paths that no layout names don't count."""
    found = sorted((p, h) for p, h in leaf_paths(schema) if p in known)
    have = F.array_compact(F.array(*(F.when(at(h).isNotNull(), F.lit(p)) for p, h in found), F.lit(None).cast("string")))
    return F.sha2(F.array_join(have, "\n"), 256)


def turns_of(layout: Layout) -> Column:
    def text(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit(""))

    def role(c: Column, names: Mapping[str, str]) -> Column:
        return reduce(lambda out, r: F.when(c == r[0], r[1]).otherwise(out), names.items(), text(c))

    def part(t: Said | Each) -> Column:
        if isinstance(t, Each):
            return F.transform(at(t.array), lambda m: F.struct(role(m[t.role], t.roles).alias("role"), text(m[t.text]).alias("text")))
        said = F.array_join(F.filter(F.array(*(text(at(p)) for p in t.paths)), lambda x: x != ""), "\n\n")
        return F.array(F.struct(F.lit(t.role).alias("role"), said.alias("text")))

    return F.concat(*map(part, layout.turns)).cast(TURNS)


def canonical_turns(records: DataFrame, id_col: str, layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """id, fingerprint, layout and turns of every record, whatever columns the table has.

    Each record's own fingerprint chooses its mapping, so one table may hold all layouts (a missing field is null). Records of no declared layout are kept with null layout and
    turns. Null roles and texts are empty; other types than strings are cast. A null scalar is a missing field.
    """
    known = {p for x in layouts for p in x.paths}
    have = {p for p, _ in leaf_paths(records.schema)}
    usable = [x for x in layouts if set(x.paths) <= have]
    marked = records.withColumn("__fingerprint", fingerprint(records.schema, known))
    pick = lambda value: reduce(lambda out, x: F.when(F.col("__fingerprint") == x.fingerprint, value(x)).otherwise(out), usable, F.lit(None))
    return marked.select(F.col(id_col), F.col("__fingerprint").alias("fingerprint"), pick(lambda x: F.lit(x.name)).cast("string").alias("layout"), pick(turns_of).cast(TURNS).alias("turns"))


def marked_turn(t: Column) -> tuple[Column, Column, Column]:
    """A turn's opening, its text with control strings escaped, and its close."""
    name = F.replace(F.replace(F.replace(t["role"], F.lit("%"), F.lit("%25")), F.lit("<"), F.lit("%3C")), F.lit(">"), F.lit("%3E"))
    return F.concat(F.lit(OPEN), name, F.lit(">")), F.regexp_replace(t["text"], r"<(\\*)(/turn>|turn:)", r"<\\$1$2"), F.lit(CLOSE)


def formatted(turns: DataFrame, learn: Sequence[str] = ("assistant",)) -> DataFrame:
    """Adds formatted (all turns marked, nothing between) and loss_mask: runs of (chars, loss) that cover it, in code points. Null turns stay null.

    Three runs a turn; those with loss are the texts of the roles in ``learn``, without their marks.
    """

    def runs(t: Column) -> Column:
        opening, text, close = marked_turn(t)
        run = lambda c, loss: F.struct(F.length(c).alias("chars"), loss.alias("loss"))
        return F.array(run(opening, F.lit(False)), run(text, t["role"].isin(*learn)), run(close, F.lit(False)))

    return turns.withColumns({"formatted": F.array_join(F.transform("turns", lambda t: F.concat(*marked_turn(t))), ""), "loss_mask": F.flatten(F.transform("turns", runs))})


ESCAPED = re.compile(r"<\\(\\*)(/turn>|turn:)")


def plain(text: str) -> str:
    return ESCAPED.sub(r"<\1\2", text)


def read_turns(chat: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted text: the inverse of formatted()."""
    out = []
    for part in chat.split(CLOSE)[:-1]:
        role, _, text = part[len(OPEN) :].partition(">")
        out.append((role.replace("%3E", ">").replace("%3C", "<").replace("%25", "%"), plain(text)))
    return out


def digests(chats: DataFrame, id_col: str) -> DataFrame:
    """What formatted() wrote, read back: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. Records without turns have nulls."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 1024):
                part, out = b.slice(i, 1024), []
                for chat, mask in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    if chat is None:
                        out.append((None,) * 5)
                        continue
                    turns, learned, place = read_turns(chat), [], 0
                    for run in mask:
                        if run["loss"]:
                            learned.append(plain(chat[place : place + run["chars"]]))
                        place += run["chars"]
                    loss = "".join(learned)
                    said = "".join(f"{r}\n{t}\n" for r, t in turns)
                    out.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(chat)))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names=[id_col, *DIGESTS])

    kind = chats.schema[id_col].dataType.simpleString()
    return chats.select(id_col, "formatted", "loss_mask").mapInArrow(read, f"`{id_col}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


DIGESTS = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def by_conversation(rows: DataFrame) -> DataFrame:
    """(conv_id, turns) of rows (conv_id, turn, role, text). A conversation is one record, as a document is; equal turns come by role and text."""
    turn = F.struct(F.col("turn").alias("turn"), F.col("role").alias("role"), F.col("text").alias("text"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns")).select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def oracle() -> str:
    """The digests of all conversations in DuckDB, straight from the turns."""
    text = "coalesce(text, '')"
    escaped = rf"regexp_replace({text}, '<(\\*)(/turn>|turn:)', '<\\\1\2', 'g')"
    role = "replace(replace(replace(coalesce(role, ''), '%', '%25'), '<', '%3C'), '>', '%3E')"
    return rf"""with turns as (select conv_id, turn, role, text from conversations
            union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok')
        select conv_id, count(*) as n_turns, sha256(string_agg(coalesce(role, '') || chr(10) || {text} || chr(10), '' order by turn, role, text)) as turns_sha256,
            cast(sum(case when role = 'assistant' then length({text}) else 0 end) as bigint) as loss_chars,
            sha256(coalesce(string_agg({text}, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
            cast(sum(length('{OPEN}' || {role} || '>' || {escaped} || '{CLOSE}')) as bigint) as formatted_chars
        from turns group by conv_id"""
