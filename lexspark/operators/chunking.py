"""Splitting documents into passages: sections, numbered parts, then sentences with overlap."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

TARGET = 1400
OVERLAP = 200
LEAST_CHARS = 50
#: A block up to this many times the target stays whole.
SLACK = 1.5
# The headings that open a section.
HEADINGS = [r"ΣΚΕΦΘΗΚΕ\s+ΣΥΜΦΩΝΑ\s+ΜΕ\s+ΤΟ\s+ΝΟΜΟ", r"ΓΙΑ\s+ΤΟΥΣ\s+ΛΟΓΟΥΣ\s+ΑΥΤΟΥΣ", r"ΚΡΙΘΗΚΕ[,\s]", r"ΔΗΜΟΣΙΕΥΘΗΚΕ[,\s]"]
_HEADING = re.compile("|".join(HEADINGS))
# Fixed value: a numbered part at the beginning of a line.
_NUMBERED = re.compile(r"^\s*(?:[ΙVΧ]{1,5}|[Α-Ω]|\d{1,2})\s*[.)\-]\s+", re.MULTILINE)
# Fixed value: where a sentence ends.
_SENTENCE_END = re.compile(r"(?<=[.;·!?])\s+(?=[Α-ΩΆΈΉΊΌΎΏA-Z])")


def tile(length: int, starts: list[int]) -> list[tuple[int, int]]:
    """Spans between the given starts; together they cover the text exactly."""
    cuts = sorted({0, length, *(s for s in starts if 0 < s < length)})
    return list(zip(cuts, cuts[1:]))


def sections(text: str) -> list[tuple[int, int]]:
    return tile(len(text), [m.start() for m in _HEADING.finditer(text)])


def _gather(spans: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """Neighbouring spans joined until each (but the last) has the least length."""
    out: list[tuple[int, int]] = []
    begin = None
    for a, b in spans:
        begin = a if begin is None else begin
        if b - begin >= least:
            out.append((begin, b))
            begin = None
    if begin is not None:
        out.append((begin, spans[-1][1]))
    return out


def pack(text: str, target: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of at most ``target`` characters that end with a sentence where one ends late enough.

    Consecutive spans share ``overlap`` characters, unless that would not
    advance; a break counts only beyond a third of the target.
    """
    ends = [m.start() for m in _SENTENCE_END.finditer(text)]
    size, least, at, out = len(text), max(1, target // 3), 0, []
    while size - at > target:
        k = bisect_right(ends, at + target) - 1
        stop = ends[k] if k >= 0 and ends[k] > at + least else at + target
        out.append((at, stop))
        at = stop - overlap if stop - overlap > at else stop
    if at < size:
        out.append((at, size))
    return out


def body_spans(body: str, target: int = TARGET, overlap: int = OVERLAP) -> Iterator[tuple[int, int]]:
    most = target * SLACK
    for a, b in sections(body):
        if b - a <= most:
            yield a, b
            continue
        block = body[a:b]
        for c, d in _gather(tile(len(block), [m.start() for m in _NUMBERED.finditer(block)]), target):
            if d - c <= most:
                yield a + c, a + d
            else:
                yield from ((a + c + x, a + c + y) for x, y in pack(block[c:d], target, overlap))


def passages(subject: str | None, summary: str | None, body: str | None, target: int = TARGET, overlap: int = OVERLAP) -> list[tuple[str, int, int, str]]:
    """(part, start, end, content) of a document: its headnote first, then the passages of its body."""
    out = []
    if summary and summary.strip():
        head = summary.strip()
        out.append(("summary", 0, 0, f"{subject.strip()}\n\n{head}" if subject else head))
    text = (body or "").strip()
    for a, b in body_spans(text, target, overlap):
        content = text[a:b].strip()
        if len(content) >= LEAST_CHARS:
            out.append(("body", a, b, content))
    return out


def chunk_documents(df: DataFrame, key: str = "cd", target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """(key, ordinal, part, char_start, char_end, content) of all documents (key, subject, summary, body).

    Ordinals are dense from 0; a document without text gives no row; offsets
    count characters of the body without its outer white space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("k", pa.string()), ("ordinal", pa.int32()), ("part", pa.string()), ("char_start", pa.int32()), ("char_end", pa.int32()), ("content", pa.string())])
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                piece = batch.slice(at, 64)
                rows = [
                    (k, i, part, a, b, content)
                    for k, subject, summary, body in zip(*(piece.column(c).to_pylist() for c in range(4)))
                    for i, (part, a, b, content) in enumerate(passages(subject, summary, body, target, overlap))
                ]
                cols = list(zip(*rows)) or [[]] * 6
                out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kind)], schema=kind)
                yield out.rename_columns([key, *kind.names[1:]])

    src = df.select(df[key].cast("string"), "subject", "summary", "body")
    return src.mapInArrow(run, f"`{key}` string, ordinal int, part string, char_start int, char_end int, content string")
