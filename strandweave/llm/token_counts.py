"""Token counts of fields or sections, from one encoding of the whole document.

A document is encoded once; its tokens' spans are interval-joined to the spans
of its sections.  A token that crosses a boundary is counted by an explicit
rule, so each token is counted exactly once and the sections' counts add up to
the document's:

* ``start``: the section that holds the token's first byte,
* ``end``: the section that holds its last byte,
* ``majority``: the section that holds most of its bytes, the earlier on ties.

Sections here are consecutive and cover the text: ``lines`` (a newline belongs
to the line that it ends) or spans given per row, as an array of character
positions at which sections begin.

Defined results: a null or empty text is one section of no characters and no
tokens; cut positions that are null, repeated, negative or beyond the text are
ignored; repeated rows are counted one by one; extra columns are ignored; an
empty table gives an empty result.  Texts are encoded whole, at any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text_kernels as tk
from .byte_bpe import codec

RULES = ("start", "end", "majority")


def _line_cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions in the block at which sections begin, and the n + 1 offsets by text; an empty text has one."""
    after = np.flatnonzero(data == 10) + 1
    after = after[~np.isin(after, offsets)]  # a newline that ends a text opens no section
    cuts = np.sort(np.concatenate([offsets[:-1], after]), kind="stable")
    n_inner = np.diff(np.searchsorted(after, offsets))
    bounds = np.zeros(len(offsets), np.int64)
    np.cumsum(1 + n_inner, out=bounds[1:])
    return cuts, bounds


def _given_cuts(data: np.ndarray, offsets: np.ndarray, given: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    lead = (data & 0xC0) != 0x80
    cuts, bounds = [], [0]
    for i, row in enumerate(given.to_pylist()):
        at = np.flatnonzero(lead[offsets[i]:offsets[i + 1]])
        inner = sorted({c for c in row or () if c is not None and 0 < c < len(at)})
        cuts.append(np.concatenate([offsets[i:i + 1], at[inner] + offsets[i] if inner else np.zeros(0, np.int64)]))
        bounds.append(bounds[-1] + len(cuts[-1]))
    return np.concatenate(cuts), np.array(bounds)


def _attribute(start: np.ndarray, end: np.ndarray, cuts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token span, and whether the span crosses a boundary; of empty sections at one place the last counts."""
    first = np.searchsorted(cuts, start, "right") - 1
    last = np.searchsorted(cuts, end - 1, "right") - 1
    if rule == "start":
        return first, first != last
    if rule == "end":
        return last, first != last
    best = first.copy()
    edges = np.append(cuts, np.iinfo(np.int64).max)
    held = np.minimum(end, edges[first + 1]) - start
    for step in range(1, int((last - first).max(initial=0)) + 1):
        at = np.minimum(first + step, last)
        own = np.minimum(end, edges[at + 1]) - np.maximum(start, edges[at])
        better = (first + step <= last) & (own > held)
        best[better], held[better] = at[better], own[better]
    return best, first != last


def section_counts(docs: DataFrame, ranks_path: str, rule: str = "start", cuts: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, section, start_char, end_char, n_tokens, n_crossing) per section.

    ``cuts``: an array column of the characters at which sections begin; lines
    if it is not given.  n_crossing counts the tokens attributed to the section
    that also hold bytes of another.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"), *([] if cuts is None else [cuts.cast("array<long>").alias("cuts")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path)
        for block in tk.blocks(batches):
            data, offsets = tk.utf8(block.column(1))
            at, bounds = _line_cuts(data, offsets) if block.num_columns == 2 else _given_cuts(data, offsets, block.column(2))
            ids, start, _, _ = own.encode_block(block.column(1))
            section, crossing = _attribute(start, start + own.lengths[ids], at, rule)
            chars = np.zeros(len(data) + 1, np.int64)
            np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
            of = tk.value_index(bounds)
            begin, zero = chars[at], chars[offsets[:-1]][of]
            end = np.append(begin[1:], chars[-1])
            # the last section of a text ends where the text does
            end[bounds[1:] - 1] = chars[offsets[1:]]
            yield pa.RecordBatch.from_arrays([block.column(0).take(pa.array(of)), pa.array(np.arange(len(at)) - bounds[:-1][of], pa.int32()), pa.array(begin - zero, pa.int64()), pa.array(end - zero, pa.int64()), pa.array(np.bincount(section, minlength=len(at)), pa.int64()), pa.array(np.bincount(section[crossing], minlength=len(at)), pa.int64())], names=["key", "section", "start_char", "end_char", "n_tokens", "n_crossing"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, section int, start_char bigint, end_char bigint, n_tokens bigint, n_crossing bigint").withColumnRenamed("key", id_col)
