"""Splitting oversized pieces of source at natural boundaries, by content.

Content-defined chunking over lines: a rolling hash over the last lines marks landmarks; each landmark snaps to the
nearest natural boundary (blank line, start of a definition, end of a block) between the least and greatest size. Cuts
depend on nearby text only, so an edit changes the pieces around it and leaves the others as they were.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, LEAST, OVERLAP_LINES, OVERLAP_CHARS = 1_600, 400, 2, 40
#: One line in so many is a landmark.
LANDMARK_EVERY = 12
_WINDOW = 3  # lines under the rolling hash
_DEFINITION = re.compile(r"^\s*(?:export\s+|public\s+|private\s+|protected\s+|static\s+|async\s+|pub\s+)*(?:def|class|func|function|fn|interface|struct|enum|impl|type|module|#{1,6})\b|^#{1,6}\s")
_CLOSING = re.compile(r"^\s*(?:[})\]]+[;,]?|end|fi|done|esac)\s*$")


class Piece(NamedTuple):
    """Lines first..last (0-based, inclusive), characters start..end, and what is shared with the piece before."""

    first: int
    last: int
    start: int
    end: int
    shared_lines: int
    shared_chars: int


PIECES = "chunk_pos long, piece_no int, n_pieces int, start_line int, end_line int, symbol string, text string, n_chars int, shared_lines int, shared_chars int, cut string"


def dense_length(text: str) -> int:
    """Characters that are not white space."""
    return len("".join(text.split()))


def _naturalness(lines: list[str], k: int) -> int:
    """How natural a cut before line k is, 0 (within a block) to 3 (before a definition)."""
    if _DEFINITION.match(lines[k]) or _DEFINITION.match(lines[k].lstrip("@")):
        return 3
    if not lines[k - 1].strip():
        return 2
    return 1 if _CLOSING.match(lines[k - 1]) else 0


def _landmarks(lines: list[str]) -> list[bool]:
    marks = []
    hashes = [zlib.crc32(x.strip().encode("utf-8", "replace")) for x in lines]
    for k in range(len(lines)):
        h = 0
        for x in hashes[max(0, k - _WINDOW) : k]:
            h = (h * 31 + x) & 0xFFFFFFFF
        marks.append((h ^ (h >> 15)) % LANDMARK_EVERY == 0)
    return marks


def cut_inside(line: str, limit: int, overlap: int, room: int) -> list[tuple[int, int]]:
    """(start, end) spans of a line that is itself over the limit; the first holds ``room`` characters, others ``limit``.

    Spans overlap by ``overlap`` characters. A cut goes behind the last white space or punctuation of the final quarter,
    where there is one.
    """
    spans, start, size = [], 0, len(line)
    while True:
        most, end, dense = (limit if spans else room), start, 0
        while end < size and dense + (not line[end].isspace()) <= most:
            dense += not line[end].isspace()
            end += 1
        if end < size:
            floor = start + (end - start) * 3 // 4
            natural = max((line.rfind(c, floor, end) for c in " \t;,{}()"), default=-1)
            if natural > start + overlap:
                end = natural + 1
        spans.append((start, end))
        if end >= size:
            return spans
        # a first span cut short by shared lines is shared whole where it is no longer than the overlap: the next holds more
        start = max(start if len(spans) == 1 and room < limit else start + 1, end - overlap)


def split(text: str, limit: int = LIMIT, least: int = LEAST, overlap_lines: int = OVERLAP_LINES, overlap_chars: int = OVERLAP_CHARS) -> list[Piece]:
    """Pieces of a text in order; one piece if the text is within the limit.

    Their spans cover the text but for the ``\n`` between two pieces cut at a line end.
    """
    if dense_length(text) <= limit:
        return [Piece(0, text.count("\n"), 0, len(text), 0, 0)]
    lines = text.split("\n")
    sizes = [dense_length(x) for x in lines]
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x) + 1)
    marks = _landmarks(lines)
    pieces: list[Piece] = []
    k, n = 0, len(lines)  # k: first line not yet in a piece
    while k < n:
        need = sizes[k] if sizes[k] <= limit else 1
        back = chars = 0
        if k and sizes[k - 1] > limit:  # the line before was cut: share its end
            chars = min(overlap_chars, len(lines[k - 1]))
            while chars and dense_length(lines[k - 1][-chars:]) + need > limit:
                chars -= 1
            base = dense_length(lines[k - 1][-chars:]) if chars else 0
            begin, first = (starts[k] - 1 - chars, k - 1) if chars else (starts[k], k)
        else:
            for m in range(1, overlap_lines + 1):
                if k - m < 0 or sum(sizes[k - m : k]) + need > limit:
                    break
                back = m
            base, first = sum(sizes[k - back : k]), k - back
            begin = starts[first]
        if sizes[k] > limit:
            spans = cut_inside(lines[k], limit, overlap_chars, limit - base)
            pieces.append(Piece(first, k, begin, starts[k] + spans[0][1], back, chars))
            for (_, before), (a, b) in zip(spans, spans[1:]):
                pieces.append(Piece(k, k, starts[k] + a, starts[k] + b, 0, before - a))
            k += 1
            continue
        end, total = k, base
        while end < n and total + sizes[end] <= limit:
            total += sizes[end]
            end += 1
        if end < n and end - k > 1:
            end = _choose(lines, sizes, marks, k, end, base, least)
        pieces.append(Piece(first, end - 1, begin, starts[end] - 1, back, chars))
        k = end
    return pieces


def _choose(lines: list[str], sizes: list[int], marks: list[bool], k: int, end: int, base: int, least: int) -> int:
    """The cut in k+1..end: the first landmark past the least size, snapped to the nearest natural boundary."""
    low, total = k + 1, base
    for j in range(k, end):
        total += sizes[j]
        if total >= least:
            low = min(j + 1, end)
            break
    span = range(low, end + 1)
    natural = {j: _naturalness(lines, j) for j in span if j < len(lines)}
    mark = next((j for j in span if j < len(lines) and marks[j]), None)
    if mark is None:
        return max(span, key=lambda j: (natural.get(j, 0), j))
    near = [j for j in span if natural.get(j, 0) > 0]
    return min(near, key=lambda j: (abs(j - mark) - natural[j], j)) if near else mark


def split_oversized(chunks: DataFrame, limit: int = LIMIT, least: int = LEAST) -> DataFrame:
    """Pieces of every chunk over ``limit`` non-blank characters.

    chunks: chunk_pos, text, start_line, end_line, symbol. Every piece is within the limit; consecutive pieces share two
    whole lines (fewer only where two do not fit), or 40 characters inside a line that had to be cut. ``cut`` is
    ``inside_line`` where some line is over the limit by itself, else ``whole_lines``. Lines are split at ``\\n``, so CRLF
    survives. A NULL start line counts as 1; NULL symbol stays NULL; NULL keys, NULL and small texts give no rows; repeated rows give
    their pieces each. Map-only.
    """

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PIECES.split(", ")]
        for pdf in batches:
            rows = []
            for pos, text, line, symbol in zip(pdf["chunk_pos"].tolist(), pdf["text"].tolist(), pdf["start_line"].tolist(), pdf["symbol"].tolist()):
                if dense_length(text) <= limit:
                    continue
                cut = "inside_line" if any(len(x) > limit and dense_length(x) > limit for x in text.split("\n")) else "whole_lines"
                got = split(text, limit, least)
                for k, p in enumerate(got):
                    part = text[p.start : p.end]
                    rows.append((pos, k, len(got), line + p.first, line + p.last, symbol, part, dense_length(part), p.shared_lines, p.shared_chars, cut))
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"symbol": object})

    wanted = chunks.where(F.col("chunk_pos").isNotNull() & (F.length("text") > limit)).select(
        F.col("chunk_pos").cast("long").alias("chunk_pos"), "text", F.coalesce(F.col("start_line"), F.lit(1)).cast("int").alias("start_line"), "symbol"
    )
    return wanted.mapInPandas(pieces, PIECES)
