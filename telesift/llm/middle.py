"""Fill-in-the-middle transformation by displacement scatter.

Texts are cut at line ends into prefix, middle and suffix. All texts of an Arrow batch lie in one byte buffer; a
difference array holds, where a piece begins, by how much its shift differs from that of the byte before. The running
sum gives every byte its shift, and one numpy scatter writes the whole batch of outputs. The way back finds the marks in
the outputs, builds the shifts from them alone and gathers the bytes back into the texts.

Nothing but the row itself decides its cuts (the digest of the seed and the id), so reruns and any partitioning agree.
Buffers are worked on in windows of WINDOW bytes with the shift carried on, so index arrays stay small for texts of any
length.

Defined results: a null text counts as empty; an empty text, or one that holds a mark itself, stays plain (its output
is the text); a null id is digested as an empty one; repeated rows get equal results; an empty table gives no rows;
further columns are ignored, and no name can clash, as the result has its own columns only.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telesift.llm.common import portions, read
from telesift.llm.registry import query

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
WINDOW = 1 << 20
LINE = r"[^\n]*\n|[^\n]+"


@dataclass(frozen=True)
class Middle:
    """Parameters: digest seed, percentage of texts to transform, percentage of these in suffix-prefix-middle form."""

    seed: str = "7:"
    rate: int = 100
    spm: int = 50


def found(buffer: np.ndarray, mark: bytes) -> np.ndarray:
    """Positions of a three-byte mark, in order."""
    out = []
    for at in range(0, max(len(buffer) - 2, 0), WINDOW):
        part = buffer[at : at + WINDOW + 2]
        hit = (part[:-2] == mark[0]) & (part[1:-1] == mark[1]) & (part[2:] == mark[2])
        out.append(np.flatnonzero(hit) + at)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def displaced(begins: np.ndarray, shifts: np.ndarray, size: int):
    """(window, shift of each of its bytes) for a buffer whose pieces begin at `begins` and move by `shifts`."""
    jump = np.diff(shifts, prepend=0)
    bounds = np.append(np.arange(0, size, WINDOW), size)
    carried, where = 0, np.searchsorted(begins, bounds)
    for i, (at, end) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        delta = np.zeros(end - at, np.int64)
        np.add.at(delta, begins[where[i] : where[i + 1]] - at, jump[where[i] : where[i + 1]])
        delta[0] += carried
        shift = np.cumsum(delta)
        carried = int(shift[-1])
        yield slice(at, end), shift


def moved(source: np.ndarray, begins: np.ndarray, shifts: np.ndarray, size: int) -> np.ndarray:
    """Scatter: byte i of the source goes to i + shift(i) of a new buffer of `size` bytes."""
    out = np.zeros(size, np.uint8)
    for window, shift in displaced(begins, shifts, len(source)):
        out[np.arange(window.start, window.stop) + shift] = source[window]
    return out


def gathered(source: np.ndarray, begins: np.ndarray, shifts: np.ndarray, size: int) -> np.ndarray:
    """Inverse gather: byte i of the new buffer of `size` bytes is byte i + shift(i) of the source."""
    out = np.zeros(size, np.uint8)
    for window, shift in displaced(begins, shifts, size):
        out[window] = source[np.arange(window.start, window.stop) + shift]
    return out


def buffer_of(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, nulls as empty texts; offsets start at 0."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def strings(buffer: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(buffer)]).cast(pa.large_string())


def holds(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a three-byte hit lies inside each of the texts (one that spans two texts does not count)."""
    first = np.searchsorted(positions, offsets[:-1])
    return first < np.searchsorted(positions, offsets[1:] - 2)


def characters(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Code points before each of the byte positions `edges` (ascending)."""
    out, total, done = np.zeros(len(edges), np.int64), 0, 0
    where = np.searchsorted(edges, np.arange(0, len(data) + WINDOW + 1, WINDOW))
    for i, at in enumerate(range(0, len(data) + 1, WINDOW)):
        part = data[at : at + WINDOW]
        count = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
        inside = slice(where[i], where[i + 1])
        out[inside] = total + count[edges[inside] - at]
        total, done = total + int(count[-1]), where[i + 1]
    out[done:] = total
    return out


def cut(data: np.ndarray, offsets: np.ndarray, h: np.ndarray):
    """(n lines, first cut, second cut) of each text; cuts are byte positions in the buffer."""
    ends = np.flatnonzero(data == 10) + 1
    ends = np.union1d(ends, offsets[1:][offsets[1:] > offsets[:-1]])  # a last line without a line end is a line too
    before = np.searchsorted(ends, offsets[:-1], side="right")
    n = np.searchsorted(ends, offsets[1:], side="right") - before
    one, two = h[0] % (n + 1), h[1] % (n + 1)
    edges = np.concatenate([[0], ends])

    def position(unit):
        return np.where(unit == 0, offsets[:-1], edges[np.minimum(before + unit, len(edges) - 1)])

    return n, position(np.minimum(one, two)), position(np.maximum(one, two))


def transformed(data: np.ndarray, offsets: np.ndarray, h: np.ndarray, rate: int, spm: int):
    """Outputs of a batch: (n, form, prefix code points, middle code points, bytes, offsets)."""
    n, a, b = cut(data, offsets, h)
    start, end = offsets[:-1], offsets[1:]
    marked = np.zeros(len(n), bool)
    for mark in MARKS:
        marked |= holds(found(data, mark), offsets)
    plain = (end == start) | marked | (h[2] % 100 >= rate)
    suffix_first = ~plain & (h[3] % 100 < spm)
    at = np.concatenate([[0], np.cumsum(end - start + np.where(plain, 0, 9))])
    prefix, middle, suffix = a - start, b - a, end - b
    # where the pieces of a text go in the output: behind their marks
    to_prefix = at[:-1] + np.where(plain, 0, np.where(suffix_first, 6 + suffix, 3))
    to_suffix = at[:-1] + np.where(plain, prefix + middle, np.where(suffix_first, 3, 6 + prefix))
    to_middle = at[:-1] + np.where(plain, prefix, 9 + prefix + suffix)
    begins = np.stack([start, a, b], 1).ravel()
    shifts = np.stack([to_prefix - start, to_middle - a, to_suffix - b], 1).ravel()
    out = moved(data, begins, shifts, int(at[-1]))
    for mark, place in ((PREFIX, to_prefix), (SUFFIX, to_suffix), (MIDDLE, to_middle)):
        for j, byte in enumerate(mark):
            out[place[~plain] - 3 + j] = byte
    form = np.where(plain, "plain", np.where(suffix_first, "spm", "psm"))
    edges = np.stack([start, a, b], 1)
    chars = characters(data, edges.ravel()).reshape(-1, 3)
    lengths = [pa.array(chars[:, i + 1] - chars[:, i], pa.int64(), mask=plain) for i in (0, 1)]
    return n, form, lengths[0], lengths[1], out, at


def rebuilt(data: np.ndarray, offsets: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts from outputs and forms alone: (bytes, offsets)."""
    plain, spm = form == "plain", form == "spm"
    start, end = offsets[:-1], offsets[1:]
    at = np.concatenate([[0], np.cumsum(end - start - np.where(plain, 0, 9))])

    def place(mark):  # the one mark of each transformed output
        hits = found(data, mark)
        hits = np.append(hits, len(data))
        return np.where(plain, start, hits[np.minimum(np.searchsorted(hits, start), len(hits) - 1)])

    p, s, m = place(PREFIX), place(SUFFIX), place(MIDDLE)
    prefix = np.where(plain, end - start, np.where(spm, m, s) - p - 3)
    middle = np.where(plain, 0, end - m - 3)
    suffix = np.where(plain, 0, np.where(spm, p, m) - s - 3)
    if ((prefix < 0) | (middle < 0) | (suffix < 0)).any():
        raise ValueError("an output does not have the marks of its form")
    begins = np.stack([at[:-1], at[:-1] + prefix, at[:-1] + prefix + middle], 1)
    sources = np.stack([np.where(plain, start, p + 3), m + 3, s + 3], 1)
    return gathered(data, begins.ravel(), (sources - begins).ravel(), int(at[-1])), at


def draws(doc_id: Column, seed: str) -> Column:
    """The first four 8-digit groups of the digest of seed and id, as numbers."""
    hexed = F.sha2(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(hexed, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def to_middle(docs: DataFrame, form: Middle = Middle()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every document."""
    p = asdict(form)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), draws(F.col("doc_id"), p["seed"]).alias("h"))

    def run(batches):
        for batch in portions(batches):
            data, offsets = buffer_of(batch.column("text"))
            h = np.asarray(batch.column("h").flatten(), np.int64).reshape(-1, 4).T
            n, kind, prefix, middle, out, at = transformed(data, offsets, h, p["rate"], p["spm"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(kind.tolist(), pa.string()), prefix, middle, strings(out, at).cast(pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def from_middle(outputs: DataFrame) -> DataFrame:
    """Adds `restored`, the text rebuilt from the columns `output` and `form`; other columns pass through."""
    schema = outputs.select("*", F.lit("").alias("restored")).schema

    def run(batches):
        for batch in portions(batches, "output"):
            data, offsets = buffer_of(batch.column("output"))
            text, at = rebuilt(data, offsets, np.array(batch.column("form").to_pylist(), dtype=object))
            yield pa.RecordBatch.from_arrays([*batch.columns, strings(text, at).cast(pa.string())], [*batch.schema.names, "restored"])

    return outputs.mapInArrow(run, schema)


SQL = """
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') as u, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as x from documents),
h as (select doc_id, t, u, len(u) as n, cast('0x' || x[1:8] as bigint) as h1, cast('0x' || x[9:16] as bigint) as h2,
  cast('0x' || x[17:24] as bigint) as h3, cast('0x' || x[25:32] as bigint) as h4 from d),
c as (select doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b, u,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from h),
p as (select doc_id, t, n, form, array_to_string(u[1:a], '') as pre, array_to_string(u[a + 1:b], '') as mid, array_to_string(u[b + 1:n], '') as suf from c)
select doc_id, n, form, case when form <> 'plain' then length(pre) end as prefix_chars, case when form <> 'plain' then length(mid) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
  sha256(t) as restored_sha256
from p
"""


@query("op12_fill_in_middle", SQL)
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in fill-in-the-middle form, and the digest of what the way back gives."""
    there = to_middle(read(spark, sf_dir, "documents"))
    return from_middle(there).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
