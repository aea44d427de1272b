"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; a failure sets the rule's bit in
``failed_bits`` and the measurements stay beside it.  A policy is a named,
versioned set of rules, so applying one - or an ablation of one - is integer
arithmetic on the ledger and never reads a text again.

Defined results: null or empty text has no words, all counts 0 and fails
``few_words``.  Repeated rows are measured one by one; extra columns are
ignored, whatever their names; an empty table gives an empty ledger.  Very
long texts are measured whole, in one block of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import text_kernels as tk

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper")

#: name -> SQL condition over the measurements that means failure; a rule's bit is its place here.
RULES = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "10 * n_symbols > n_words",
    "word_length": "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
    "shouting": "10 * n_upper > 6 * n_letters AND n_letters > 0",
}
BIT = {name: 1 << k for k, name in enumerate(RULES)}
#: (policy, version) -> rules that reject under it.  "corpus" leaves repeated lines to a later line dedup.
POLICIES = {
    ("base", 1): ("few_words", "repeated_windows"),
    ("corpus", 1): ("few_words", "repeated_windows", "many_symbols", "word_length"),
    ("corpus", 2): ("few_words", "repeated_windows", "many_symbols", "word_length", "shouting"),
    ("strict", 1): tuple(RULES),
}

_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = 1


def measure_block(texts: pa.Array) -> dict[str, np.ndarray]:
    data, offsets = tk.utf8(texts)
    space = tk.space_flags(data)
    starts, ends, words = tk.spans(~space, offsets)
    out = {"n_words": np.diff(words), "word_chars": tk.sums_by_value(~space & ((data & 0xC0) != 0x80), offsets), "n_symbols": tk.sums_by_value(_SYMBOL[data], offsets)}
    # lines that hold a word, and how many of them repeat an earlier line of the same text
    line_start, line_end, lines = tk.line_spans(data, offsets)
    worded = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    key = tk.mix(tk.hash_spans(data, line_start, line_end) + tk.value_index(lines).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(key[worded], return_index=True)
    new = np.zeros(len(key), bool)
    new[np.flatnonzero(worded)[first]] = True
    out["n_lines"] = tk.sums_by_value(worded, lines)
    out["n_dup_lines"] = out["n_lines"] - tk.sums_by_value(new, lines)
    # words inside a three-word window that the text has twice or more
    of = tk.value_index(words)
    window = tk.ngram_hashes(tk.hash_spans(data, starts, ends), 3)
    own = of[:len(window)] == of[len(of) - len(window):] if len(window) else np.zeros(0, bool)
    at = np.flatnonzero(own)
    key = tk.mix(window[at] + of[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    key, same = key[order], np.zeros(len(order), bool)
    same[1:] = key[1:] == key[:-1]
    same[:-1] |= same[1:]
    cover = np.zeros(len(starts), bool)
    for k in range(3):
        cover[at[order[same]] + k] = True
    out["n_repeat_words"] = tk.sums_by_value(cover, words)
    letter = ((data | 32) - np.uint8(97)) < 26
    out["n_letters"] = tk.sums_by_value(letter, offsets)
    out["n_upper"] = tk.sums_by_value(letter & (data < 91), offsets)
    return out


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, measurements, failed_bits) for every row of ``docs``; one narrow pass."""
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tk.blocks(batches):
            found = measure_block(block.column(1))
            yield pa.RecordBatch.from_arrays([block.column(0), *(pa.array(found[m], pa.int64()) for m in MEASURES)], names=["key", *MEASURES])

    kind = rows.schema["key"].dataType.simpleString()
    measured = rows.mapInArrow(run, f"key {kind}, " + ", ".join(f"{m} bigint" for m in MEASURES))
    return measured.select(F.col("key").alias(id_col), *MEASURES, _bits().alias("failed_bits"))


def _bits() -> Column:
    return sum((F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)) for name, rule in RULES.items()), F.lit(0)).cast("long")


def filter_documents(docs: DataFrame, policy: str = "corpus", version: int = 2, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that a policy keeps, whole, in one pass without a join."""
    inside = [f"c{k}" for k in range(len(docs.columns))]  # no name can clash with a measurement's
    text = docs.columns.index(text_col)
    rows = docs.toDF(*inside)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tk.blocks(batches, f"c{text}"):
            found = measure_block(block.column(text))
            yield pa.RecordBatch.from_arrays([*block.columns, *(pa.array(found[m], pa.int64()) for m in MEASURES)], names=[*inside, *MEASURES])

    fields = [*rows.schema.fields, *(StructField(m, LongType()) for m in MEASURES)]
    measured = rows.mapInArrow(run, StructType(fields))
    return apply_policy(measured.withColumn("failed_bits", _bits()), policy, version).where("kept").select(*inside).toDF(*docs.columns)


def policy_mask(policy: str, version: int) -> int:
    return sum(BIT[name] for name in POLICIES[policy, version])


def apply_policy(entries: DataFrame, policy: str = "corpus", version: int = 2) -> DataFrame:
    """Adds ``kept``: no rule of the policy failed."""
    return entries.withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(policy_mask(policy, version))) == 0)


def ablations(entries: DataFrame, policy: str = "corpus", version: int = 2) -> DataFrame:
    """Per rule of the policy: documents it fails, and those that only it rejects (kept again without it)."""
    mask = policy_mask(policy, version)
    under = F.col("failed_bits").bitwiseAND(F.lit(mask))
    counts = entries.groupBy(under.alias("bits")).agg(F.count("*").alias("n"))  # at most one row per pattern of bits
    rules = [F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).cast("long").alias("bit")) for name in POLICIES[policy, version]]
    each = counts.select("bits", "n", F.explode(F.array(*rules)).alias("r"))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.lit(mask).bitwiseXOR(F.col("r.bit"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )
