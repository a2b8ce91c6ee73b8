"""CSV validation that splits files: what a block of lines does, whatever state it begins in.

At a line's start a strict parser is in one of two states: before a row, or within a quoted field.  Each block (the lines of one of the engine's
file splits) is read once, and says for either state in which it ends, how many fields the open row has, which widths complete rows have, and
what is wrong.  Such answers compose: a file's blocks, in order, are folded into its findings, from the first block's start before a row.  Only these
short answers leave a task, so one large file keeps all cores busy.
"""

from __future__ import annotations

import csv
import json
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.columns import validate_names

_CLOSE = re.compile(rb'[^"]*+(?:""[^"]*+)*+"').match
_PLAIN = re.compile(rb"[^,\r]*").match
AFTER_QUOTE, OPEN_END = "bad quoting: ',' expected after '\"'", "bad quoting: unexpected end of data"
#: Bytes of a header that are kept until its row is complete.
HEADER_BYTES = 1 << 20


@dataclass
class Answer:
    """What a block does from one state.  ``first`` is the number of fields it adds to the row it began in (None: that row is not complete here);
    ``fields`` those of the row open at its end; ``widths`` up to two different widths of other complete rows, 0 for blank ones apart in ``blank``."""

    quoted: bool
    first: int | None = None
    fields: int = 0
    widths: list[int] = field(default_factory=list)
    blank: bool = False
    spans: bool = False
    error: str | None = None

    def row(self, width: int) -> None:
        if self.first is None:
            self.first = width
        elif width == 0:
            self.blank = True
        elif width not in self.widths and len(self.widths) < 2:
            self.widths.append(width)

    def line(self, line: bytes) -> None:
        """One line, without its line feed, from the present state."""
        at, end = 0, len(line)
        while True:
            if self.quoted:
                m = _CLOSE(line, at)
                if not m:
                    self.spans = True
                    return  # the field goes on
                self.spans |= b"\r" in m[0]
                at, self.quoted = m.end(), False
                if at < end and line[at] not in b",\r":
                    self.error = AFTER_QUOTE
                    return
            elif at < end and line[at] == 0x22:
                at, self.quoted = at + 1, True
                continue
            else:
                m = _PLAIN(line, at)
                if self.fields == 0 and m.end() == at and (at == end or line[at] == 0x0D):
                    self.fields = -1  # a row without a sign
                at = m.end()
            self.fields += 1
            if at < end and line[at] == 0x2C:
                at += 1
                continue
            self.row(self.fields)
            self.fields = 0
            at += 1  # a carriage return, or the end
            if at >= end:
                return

    def plain(self, widths: np.ndarray) -> None:
        """Lines without quotes and carriage returns, by their numbers of fields (0: empty)."""
        if self.quoted:
            self.spans |= len(widths) > 0
            return
        if len(widths) and self.first is None:
            self.row(int(widths[0]))
            widths = widths[1:]
        for w in np.unique(widths).tolist():
            self.row(w)


@dataclass
class Block:
    """Both answers of a block, and what needs no state."""

    before_row: Answer = field(default_factory=lambda: Answer(False))
    in_field: Answer = field(default_factory=lambda: Answer(True))
    not_text: bool = False
    nul: bool = False
    head: bytes = b""

    def feed(self, lines: pa.Array, is_first: bool) -> None:
        self.nul |= pc.any(pc.match_substring(lines, b"\0")).as_py() or False
        try:
            lines.cast(pa.string()).validate(full=True)
        except pa.ArrowInvalid:
            self.not_text = True
        special = pc.or_(pc.match_substring(lines, b'"'), pc.match_substring(lines, b"\r")).to_numpy(zero_copy_only=False)
        widths = np.where(pc.binary_length(lines).to_numpy() == 0, 0, pc.count_substring(lines, b",").to_numpy() + 1)
        where = np.flatnonzero(special).tolist()
        for answer in (self.before_row, self.in_field):
            at = 0
            for i in [*where, len(widths)]:
                if answer.error:
                    break
                answer.plain(widths[at:i])
                if i < len(widths):
                    answer.line(lines[i].as_py())
                at = i + 1
        if is_first and len(self.head) < HEADER_BYTES:
            for line in lines:
                self.head += line.as_py() + b"\n"
                if len(self.head) >= HEADER_BYTES or self.head.count(b'"') % 2 == 0 and self.head.strip(b"\r\n"):
                    break


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``(file, block, answer)`` with each block's answers as JSON."""
    raw = spark.read.option("lineSep", "\n").text(path)
    lines = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, Block()

        def answer() -> pa.RecordBatch:
            text = json.dumps({"r": asdict(block.before_row), "q": asdict(block.in_field), "not_text": block.not_text, "nul": block.nul, "head": block.head.decode("latin-1")})
            return pa.RecordBatch.from_pydict({"file": [now[0]], "block": [now[1]], "answer": [text]}, schema=schema)

        schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("answer", pa.string())])
        for batch in batches:
            if not batch.num_rows:
                continue
            files, starts, values = batch.column(0).dictionary_encode(), batch.column(1).to_numpy(), batch.column(2)
            codes = files.indices.to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(starts) != 0) | (np.diff(codes) != 0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                key = (files.dictionary[int(codes[a])].as_py(), int(starts[a]))
                if key != now:
                    if now is not None:
                        yield answer()
                    now, block = key, Block()
                part = values.slice(a, b - a)
                if key[1] == 0 and not block.head and part[0].as_py().startswith(b"\xef\xbb\xbf"):
                    part = pa.array([part[0].as_py()[3:], *part.slice(1).to_pylist()], pa.binary())
                block.feed(part, key[1] == 0)
        if now is not None:
            yield answer()

    return lines.mapInArrow(run, "file string, block long, answer string")


def findings(answers: list[str]) -> tuple[list[str], list[str], bool]:
    """Header, problems and whether a field spans lines, of a file from its blocks' answers in order."""
    parts = [json.loads(a) for a in answers]
    if any(p["not_text"] for p in parts):
        return [], ["not UTF-8"], False
    if any(p["nul"] for p in parts):
        return [], ["NUL character"], False
    header, quoted, carry, error, spans = None, False, 0, None, False
    widths: set[int] = set()
    for p in parts:
        a = p["q"] if quoted else p["r"]
        spans |= a["spans"]
        rows = [] if a["first"] is None else [carry + a["first"]]
        rows += a["widths"] + [0] * a["blank"]
        if header is None and rows:
            header = rows.pop(0)
        widths.update(rows)
        carry = a["fields"] + (carry if a["first"] is None else 0)
        quoted, error = a["quoted"], a["error"]
        if error:
            break
    else:
        error = OPEN_END if quoted else None
    names: list[str] = []
    if header:
        names = next(csv.reader(_text_lines(parts[0]["head"].encode("latin-1").decode()), strict=True))
    problems = []
    if header is not None:
        try:
            validate_names(names)
        except ValueError as e:
            problems.append(str(e))
    problems += ["blank row"] * (0 in widths) + ["ragged row"] * bool(widths - {0, header or 0}) + [error] * bool(error)
    return names, problems + ["no header"] * (not names), spans and not problems


def _text_lines(text: str) -> list[str]:
    return re.findall(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+", text)
