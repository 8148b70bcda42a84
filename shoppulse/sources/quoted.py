"""CSV records that span lines, read in parallel splits.

A line break inside a quoted field does not end a record, so a split that
starts in the middle of a file cannot tell whether it starts inside quotes.
Every line is therefore a function of that state: outside or inside quotes at
its start -> outside or inside at its end.  Such functions compose:

1. Each split composes the functions of its lines, for both starts (only the
   codes of the lines reach Python, no text).
2. One row per split, in file order, gives the state in which each split really
   starts, and where the record began that is open there.
3. The splits are read again.  Records that lie within a split are put together
   where they are; only the pieces of records that cross a border are shuffled,
   by the place where the record began.

Lines end in ``\\n`` or ``\\r\\n``; inside quotes either comes out as ``\\n``.
A quote opens a field only as its first character; what follows a closing quote
belongs to the field, up to the next separator or the end of the line.  A quote
that is never closed runs to the end of its file, and such a record is one row.
Lines without any character are skipped.  Well-formed files give what Spark's
own reader gives with ``multiLine``, which reads a file in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoppulse.session import ship, written

# A line's code has bit 0 set if it ends inside quotes when started outside,
# bit 1 if it does when started inside.
CLOSED, SWAP, SAME, OPEN = 0, 1, 2, 3
MARK = "\ufeff"


def line_code(line: Column, sep: str = ",", escape: str = "\\") -> Column:
    """What the line does to the state.  All repetitions are possessive, so the
    regex engine neither backtracks nor recurses on long lines."""
    body = '(?:[^"]++|"")*+' if escape == '"' else r'(?:[^"\\]++|\\["\\]?)*+'
    rest = f"[^{sep}]*+"
    opens = rf'(?:(?:"{body}"{rest}|(?!"){rest}){sep})*+"{body}\z'
    outside = line.rlike(f"^{opens}")
    inside = line.rlike(rf'^{body}(?:\z|"{rest}{sep}{opens})')
    return F.when(line.contains('"'), outside.cast("int") + inside.cast("int") * 2).otherwise(SAME)


def states_after(codes: np.ndarray, start: int) -> np.ndarray:
    """The state behind each line, for a run of lines that starts in ``start``."""
    at = np.maximum.accumulate(np.where((codes == CLOSED) | (codes == OPEN), np.arange(len(codes)), -1))
    swaps = np.concatenate(([0], np.cumsum(codes == SWAP)))
    known = at >= 0
    base = np.where(known, codes[at] == OPEN, start)
    return (base + swaps[1:] - np.where(known, swaps[at + 1], 0)) & 1


def _segments(batch: pa.RecordBatch):
    """(file, block, first row, end row) of the stretches of one split in a batch."""
    block = batch.column("block").to_numpy()
    file = batch.column("file").dictionary_encode()
    names, at = file.dictionary, file.indices.to_numpy()
    cut = np.flatnonzero((block[1:] != block[:-1]) | (at[1:] != at[:-1])) + 1
    for i, j in zip(np.append(0, cut), np.append(cut, len(block))):
        if j > i:
            yield names[int(at[i])].as_py(), int(block[i]), int(i), int(j)


def _compose(batches):
    """One row per split: its end state and last record start for both start states."""
    names = ["file", "block", "end0", "end1", "last0", "last1", "lead"]
    key, row = None, None
    for batch in batches:
        codes, blank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("code", "blank"))
        for file, block, i, j in _segments(batch):
            if (file, block) != key:
                if key is not None:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, (*key, *row[:5])))], schema=COMPOSED)
                key, row = (file, block), [0, 1, -1, -1, -1, 0]
            n = row[5]
            for s in (0, 1):
                after = states_after(codes[i:j], row[s])
                starts = np.flatnonzero(np.append(row[s], after[:-1]) == 0)
                if len(starts):
                    row[2 + s] = n + int(starts[-1])
                row[s] = int(after[-1])
            full = np.flatnonzero(~blank[i:j])
            if row[4] < 0 and len(full):
                row[4] = n + int(full[0])
            row[5] = n + j - i
    if key is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(names, (*key, *row[:5])))], schema=COMPOSED)


COMPOSED = pa.schema([("file", pa.string()), ("block", pa.int64()), ("end0", pa.int32()), ("end1", pa.int32()),
                      ("last0", pa.int64()), ("last1", pa.int64()), ("lead", pa.int64())])


def _resolve(splits: pd.DataFrame) -> pd.DataFrame:
    """The splits of one file in order: true start states, the record open at the start, the header's line."""
    out, state, open_at, headed = [], 0, (-1, -1), False
    for s in splits.sort_values("block").itertuples():
        head = -1 if headed else s.lead
        headed = headed or s.lead >= 0
        end, last = (s.end1, s.last1) if state else (s.end0, s.last0)
        out.append((s.file, s.block, state, end, *open_at, head))
        if last >= 0:
            open_at = (s.block, last)
        state = end
    return pd.DataFrame(out, columns=["file", "block", "start", "end", "open_block", "open_line", "head"])


def _assembler(whole: bool, header: bool):
    """Puts the lines of splits together: records within a split (``whole``), or the pieces at its borders."""
    def run(batches):
        key = None
        state = line = 0
        held, began, head_of = [], None, -1  # lines of the open record, where it began

        def piece():
            return {"file": key[0], "rec_block": began[0], "rec_line": began[1], "block": key[1],
                    "head": began == (key[1], head_of), "record": "\n".join(held)}

        for batch in batches:
            codes = batch.column("code").to_numpy()
            start, open_block, open_line, head = (batch.column(c) for c in ("start", "open_block", "open_line", "head"))
            value, out, singles = batch.column("value"), [], []
            for file, block, i, j in _segments(batch):
                if (file, block) != key:
                    if held and not whole:
                        out.append(piece())
                    if start[i].as_py() is None:
                        raise ValueError(f"split {block} of {file} changed between two reads")
                    key, line, head_of = (file, block), 0, head[i].as_py()
                    state, held = start[i].as_py(), []
                    began = (open_block[i].as_py(), open_line[i].as_py()) if state else None
                after = states_after(codes[i:j], state)
                before = np.append(state, after[:-1])
                single = (before == 0) & (after == 0)
                if header and 0 <= head_of - line < j - i:
                    single[head_of - line] = False  # the header; if it spans lines, ``began`` tells
                singles.append(np.flatnonzero(single) + i)
                for k in np.flatnonzero((before == 1) | (after == 1)):
                    if before[k] == 0:
                        held, began = [], (block, line + int(k))
                    text = value[i + int(k)].as_py()
                    held.append(text)
                    if after[k] == 0:
                        inside = began[0] == block and began[1] >= 0
                        if whole == inside and not (whole and header and began == (block, head_of)):
                            out.append(piece())
                        held, began = [], None
                state, line = int(after[-1]), line + j - i
            if whole:
                texts = value.take(pa.array(np.concatenate(singles))) if singles else value.slice(0, 0)
                texts = pa.concat_arrays([texts, pa.array([p["record"] for p in out], value.type)])
                files = batch.column("file")
                names = files.take(pa.array(np.concatenate(singles))) if singles else files.slice(0, 0)
                names = pa.concat_arrays([names, pa.array([p["file"] for p in out], files.type)])
                yield pa.RecordBatch.from_arrays([names, texts], names=["file", "record"])
            elif out:
                yield pa.RecordBatch.from_pylist(out, schema=PIECES)
        if held and not whole:
            yield pa.RecordBatch.from_pylist([piece()], schema=PIECES)

    return run


PIECES = pa.schema([("file", pa.string()), ("rec_block", pa.int64()), ("rec_line", pa.int64()),
                    ("block", pa.int64()), ("head", pa.bool_()), ("record", pa.string())])


def quoted_records(spark: SparkSession, path: str | list[str], header: bool = True, sep: str = ",",
                   escape: str = "\\") -> DataFrame:
    """``(file, record)``: every CSV record of the file(s) as text, without the
    headers when ``header`` is set.  Every split is a task of its own."""
    ship(spark)
    text = spark.read.option("lineSep", "\n").text(path)
    value = F.regexp_replace("value", r"\r\z", "")
    value = F.when(F.col("_metadata.file_block_start") == 0, F.regexp_replace(value, f"^{MARK}", "")).otherwise(value)
    lines = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                        value.alias("value")).withColumn("code", line_code(F.col("value"), sep, escape))
    composed = (lines.select("file", "block", "code", (F.col("value") == "").alias("blank"))
                .mapInArrow(_compose, "file string, block long, end0 int, end1 int, last0 long, last1 long, lead long"))
    states = written(composed.groupBy("file").applyInPandas(
        _resolve, "file string, block long, start int, end int, open_block long, open_line long, head long"))
    # one row per input split: as many as the scan's own list of splits, which the driver plans from
    whole = lines.join(F.broadcast(states), ["file", "block"], "left").mapInArrow(
        _assembler(True, header), "file string, record string")
    crossing = F.broadcast(states.filter("start = 1 or end = 1"))
    pieces = lines.join(crossing, ["file", "block"]).mapInArrow(
        _assembler(False, header), "file string, rec_block long, rec_line long, block long, head boolean, record string")
    joined = (pieces.groupBy("file", "rec_block", "rec_line")
              .agg(F.max("head").alias("head"), F.sort_array(F.collect_list(F.struct("block", "record"))).alias("p")))
    if header:
        joined = joined.filter(~F.col("head"))
    joined = joined.select("file", F.array_join(F.col("p.record"), "\n").alias("record"))
    return whole.unionByName(joined).filter("record != ''")


def read_quoted(spark: SparkSession, path: str | list[str], header: bool = True, names: list[str] | None = None,
                sep: str = ",", escape: str = "\\") -> DataFrame:
    """The records' fields as text columns, behind the column ``_file``.  Names
    come from the first file's header unless given."""
    options = {"sep": sep, "escape": escape, "multiLine": "true"}
    if names is None:
        names = spark.read.options(**options).option("header", header).csv(path).columns
        names = [n.lstrip(MARK) for n in names]
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    fields = F.from_csv("record", F.lit(schema), options).alias("_fields")
    rows = quoted_records(spark, path, header, sep, escape).select(F.col("file").alias("_file"), fields)
    return rows.select("_file", *[F.col("_fields").getField(n).alias(n) for n in names])
