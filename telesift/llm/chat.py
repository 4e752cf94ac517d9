"""Chat formatting: a compiled template renders conversations and marks the text that a model shall learn to write.

Control strings inside roles and texts are escaped: a backslash goes between the first character of a control string and
the rest, one more if there are some already, and the way back takes one away. So no text can end a turn or begin
another, and every text comes back as it was.

A turn is rendered on its own (see template.py). Conversations are counted first. Those of at most MOST_TURNS turns and
MOST_BYTES bytes lie in one group each; larger ones are numbered by ranges of rows and rendered turn by turn in many
tasks, whatever their length. Digests of a whole conversation are sequential by their nature: read_back streams the
turns in order and holds one turn at a time.

Defined results: rows lie in order of turn (null last), ties by a digest of role and text; repeated rows are turns of
their own; a null role or text is empty; rows with a null conv_id form one conversation; an empty table has no
conversations; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from telesift.llm.common import ordinals, read, staged
from telesift.llm.registry import query
from telesift.llm.template import Template

MOST_TURNS, MOST_BYTES = 1024, 8_000_000


@dataclass(frozen=True)
class Controls:
    """Strings that texts must not hold, with their reversible escape."""

    strings: tuple[str, ...]

    def __post_init__(self):
        for a in self.strings:
            if len(a) < 2 or "\\" in a:
                raise ValueError(f"{a!r} cannot be a control string")
            for b in self.strings:
                if any(a.endswith(b[:n]) for n in range(1, min(len(a), len(b)))) or (a != b and a in b):
                    raise ValueError(f"{a!r} and {b!r} can overlap")

    def _pattern(self, backslashes: str) -> re.Pattern:
        first = sorted({s[0] for s in self.strings})
        return re.compile("|".join(f"{re.escape(c)}{backslashes}(?:{'|'.join(re.escape(s[1:]) for s in self.strings if s[0] == c)})" for c in first))

    def escaper(self):
        pattern = self._pattern(r"\\*")
        return lambda text: pattern.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)

    def unescaper(self):
        pattern = self._pattern(r"\\+")
        return lambda text: pattern.sub(lambda m: m[0][0] + m[0][2:], text)


class Escape:
    """The template filter `escape`; compiled anew where it is unpickled."""

    def __init__(self, controls: Controls):
        self.controls, self.run = controls, controls.escaper()

    def __call__(self, value) -> str:
        return self.run(value or "")

    def __reduce__(self):
        return Escape, (self.controls,)


CONTROLS = Controls(("<s>", "</s>", "[ROLE]", "[/ROLE]", "[INST]", "[/INST]"))
OPEN, NAMED, CLOSE, ASK, ASKED = "<s>[ROLE]", "[/ROLE]", "</s>", "[INST] ", " [/INST]"
SOURCE = """
{%- for message in messages -%}
  {{ open ~ message.role | escape ~ named }}
  {%- if message.role == 'assistant' -%}
    {% generation %}{{ message.text | escape }}{% endgeneration %}
  {%- else -%}
    {{ ask ~ message.text | escape ~ asked }}
  {%- endif -%}
  {{ close }}
{%- endfor -%}
"""


def instruct(controls: Controls = CONTROLS) -> Template:
    """The template of the query: every turn names its role; what an assistant says is generated, all else instructs."""
    return Template(SOURCE, {"open": OPEN, "named": NAMED, "close": CLOSE, "ask": ASK, "asked": ASKED}, {"escape": Escape(controls)})


class Reader:
    """Reads the turns of the instruct template back from its output, fed in pieces of any size."""

    def __init__(self, controls: Controls = CONTROLS):
        self.unescape, self.rest = controls.unescaper(), ""

    def feed(self, piece: str):
        """(role, text) of every turn that the piece completes."""
        text, at = self.rest + piece, 0
        while (end := text.find(CLOSE, at)) >= 0:
            named = text.find(NAMED, at, end)
            if named < 0 or not text.startswith(OPEN, at):
                raise ValueError("the output is not one of the template")
            role, body = self.unescape(text[at + len(OPEN) : named]), text[named + len(NAMED) : end]
            yield role, self.unescape(body if role == "assistant" else body[len(ASK) : -len(ASKED)])
            at = end + len(CLOSE)
        self.rest = text[at:]

    def done(self) -> None:
        if self.rest:
            raise ValueError("the output ends inside a turn")


def order() -> list[Column]:
    return [F.col("turn").asc_nulls_last(), F.xxhash64("role", "text")]


def numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows of (conv_id, turn, role, text) with index0 and n_turns: (small conversations, large ones or None).

    The rows of a small conversation lie together and in order; those of a large one are spread by ranges.
    """
    turns = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("_n"), F.sum(F.octet_length("role") + F.octet_length("text")).alias("_bytes"))
    large = staged(sizes.where((F.col("_n") > MOST_TURNS) | (F.col("_bytes") > MOST_BYTES)).select(F.col("conv_id").alias("_conv"), "_n"), "chat-large")
    of_large = F.col("conv_id").eqNullSafe(F.col("_conv"))
    one = W.partitionBy("conv_id")

    def windowed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("n_turns", F.count("*").over(one)).withColumn("index0", (F.row_number().over(one.orderBy(*order())) - 1).cast("long"))

    if large.isEmpty():
        return windowed(turns), None
    small = windowed(turns.join(large, of_large, "left_anti"))
    rows = ordinals(turns.join(large, of_large).drop("_conv", "_n"), [F.col("conv_id"), *order()], "_at")
    starts = rows.groupBy(F.col("conv_id").alias("_conv")).agg(F.min("_at").alias("_first"), F.count("*").alias("n_turns"))
    placed = rows.join(starts, of_large).select("conv_id", "turn", "role", "text", "n_turns", (F.col("_at") - F.col("_first")).alias("index0"))
    return small, placed


PIECE = "conv_id {}, turn {}, index0 long, n_turns long, piece string, spans array<struct<start: long, end: long>>"


def render(rows: DataFrame, template: Template) -> DataFrame:
    """One piece of output per turn with its generation spans; the order and the partitioning of the rows stay."""
    types = dict(rows.dtypes)

    def run(batches):
        for batch in batches:
            pieces, starts, ends, offsets = [], [], [], [0]
            columns = [batch.column(c).to_pylist() for c in ("role", "text", "index0", "n_turns")]
            for role, text, index, count in zip(*columns, strict=True):
                out = template.turn({"role": role, "text": text}, index, count)
                pieces.append(out.text)
                for start, end in out.spans:
                    starts.append(start)
                    ends.append(end)
                offsets.append(len(starts))
            spans = pa.StructArray.from_arrays([pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["start", "end"])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("conv_id", "turn", "index0", "n_turns")], pa.array(pieces, pa.string()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)],
                ["conv_id", "turn", "index0", "n_turns", "piece", "spans"])

    return rows.select("conv_id", "turn", "role", "text", "index0", "n_turns").mapInArrow(run, PIECE.format(types["conv_id"], types["turn"]))


def format_turns(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, turn, index0, n_turns, piece, spans): a conversation's text is its pieces in order of index0.

    Spans count code points within the piece.
    """
    template = template or instruct()
    small, large = numbered(turns)
    out = render(small, template)
    return out if large is None else out.unionByName(render(large, template))


class _Conversation:
    """What the output of one conversation says, read turn by turn."""

    def __init__(self, conv_id):
        self.conv_id, self.reader, self.n, self.chars, self.loss = conv_id, Reader(), 0, 0, 0
        self.turns, self.learned = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: str, spans: list[dict]) -> None:
        self.chars += len(piece)
        for role, text in self.reader.feed(piece):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        for s in spans:
            text = self.reader.unescape(piece[s["start"] : s["end"]])
            self.loss += len(text)
            self.learned.update(text.encode())

    def row(self) -> tuple:
        self.reader.done()
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss, self.learned.hexdigest(), self.chars


def read_back(pieces: DataFrame, laid: bool = False) -> DataFrame:
    """What the pieces of the instruct template hold, per conversation.

    `laid` says that the rows of a conversation lie together and in order already, as those of `numbered` do.
    """
    kind = dict(pieces.dtypes)["conv_id"]
    if not laid:
        pieces = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "index0")
    columns = {"conv_id": None, "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}

    def run(batches):
        now = None
        for batch in batches:
            done = []
            for conv_id, piece, spans in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "piece", "spans")], strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.row())
                    now = _Conversation(conv_id)
                now.add(piece, spans)
            if done:
                yield table(done, batch.schema.field("conv_id").type)
            last = batch.schema.field("conv_id").type
        if now is not None:
            yield table([now.row()], last)

    def table(rows, id_type):
        return pa.RecordBatch.from_arrays([pa.array(v, t or id_type) for v, t in zip(zip(*rows, strict=True), columns.values(), strict=True)], list(columns))

    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return pieces.select("conv_id", "piece", "spans").mapInArrow(run, schema)


def formatted_and_read(turns: DataFrame) -> DataFrame:
    """Conversations through the instruct template and back: counts and digests of what the output holds."""
    template = instruct()
    small, large = numbered(turns)
    out = read_back(render(small, template), laid=True)
    return out if large is None else out.unionByName(read_back(render(large, template)))


PROBE = "</s>[INST] ok [/INST]"
SQL = """
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, regexp_replace(regexp_replace(role, '<(\\\\*)(/?s>)', '<\\\\\\1\\2', 'g'), '\\[(\\\\*)(/?(?:ROLE|INST)\\])', '[\\\\\\1\\2', 'g') as r2,
  regexp_replace(regexp_replace(text, '<(\\\\*)(/?s>)', '<\\\\\\1\\2', 'g'), '\\[(\\\\*)(/?(?:ROLE|INST)\\])', '[\\\\\\1\\2', 'g') as t2 from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn), '')) as loss_sha256,
  cast(sum(length(r2) + length(t2) + 20 + case when role = 'assistant' then 0 else 15 end) as bigint) as formatted_chars
from e group by conv_id
"""


@query("op13_chat_format", SQL)
def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts hold control strings, formatted and read back."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return formatted_and_read(turns.unionByName(probe))
