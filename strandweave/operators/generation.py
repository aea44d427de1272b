"""Question generation with replaceable encoders and generators."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..config import TextConfig
from ..functions import templates, texts
from .joins import rows_in_range
from .sampling import best

#: (prompt, grammar, seed, temperature) -> text
Generator = Callable[[str, str, int, float], str]
#: texts -> one vector a row
Encoder = Callable[[list[str]], np.ndarray]
#: Seeds of the trials (fixed values) and their temperatures.
TRIALS = ((42, 0.1), (123, 0.3), (777, 0.3), (314, 0.3), (271, 0.3))


def rows_around(queries: DataFrame, narrations: DataFrame, config: TextConfig = TextConfig()) -> DataFrame:
    """The entity's narrations with a text in each query's padded window; no entity's rows meet all its queries.

    queries: (query_id, video_uid, query_start_sec, query_end_sec).
    """
    padded = queries.select("query_id", "video_uid", (F.col("query_start_sec") - config.padding).alias("s"), (F.col("query_end_sec") + config.padding).alias("e"))
    return rows_in_range(padded, narrations.where(F.length(F.trim("narration_text")) > 0))


def window_lines(rows: DataFrame, config: TextConfig = TextConfig()) -> DataFrame:
    """Adds ``lines``: texts of ``narrations`` in the padded query window, repeats in a row once, thinned."""
    near = F.filter("narrations", lambda n: n["timestamp_sec"].between(F.col("query_start_sec") - config.padding, F.col("query_end_sec") + config.padding) & (F.length(F.trim(n["narration_text"])) > 0))
    said = F.transform(near, lambda n: F.trim(n["narration_text"]))
    once = F.filter(F.coalesce(said, F.array().cast("array<string>")), lambda s: F.lit(True))
    rows = rows.withColumn("lines", once)
    rows = rows.withColumn("lines", F.filter("lines", lambda s, k: (k == 0) | (s != F.get("lines", k - 1))))
    return rows.withColumn("lines", texts.thinned(F.col("lines"), config.most_lines))


def stub_generator(prompt: str, grammar: str, seed: int, temperature: float) -> str:
    """A deterministic stand-in for a language model: a question from the prompt's last line of narration."""
    lines = [x[2:] for x in prompt.splitlines() if x.startswith("- ")]
    words = (lines[-1] if lines else "nothing").split()
    k = int(hashlib.md5(f"{seed}|{prompt}".encode()).hexdigest()[:8], 16)
    start = next((w for w in ("How many", "How", "Why", "Who", "Where", "What") if f"Begin with '{w}'" in prompt), "What")
    return f"{start} is {' '.join(words[:2 + k % 3])}"


def generate(rows: DataFrame, generator: Generator = stub_generator, trials: int = TextConfig().trials, tasks: int | None = None) -> DataFrame:
    """Adds trial and ``answer``: one row per trial; rows have prompt and grammar.  A generator's error is a null answer.

    Calls run side by side by partitions; ``tasks`` sets how many.
    """
    spread = rows.repartition(tasks) if tasks else rows
    schema = StructType([*spread.schema.fields, StructField("trial", IntegerType()), StructField("answer", StringType())])
    chosen = TRIALS[:trials]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parts = []
            for k, (seed, temperature) in enumerate(chosen):
                answers = []
                for prompt, grammar in zip(frame["prompt"], frame["grammar"], strict=True):
                    try:
                        answers.append(generator(prompt, grammar, seed, temperature))
                    except Exception:  # noqa: BLE001  whatever a remote model raises
                        answers.append(None)
                parts.append(frame.assign(trial=k, answer=answers))
            yield pd.concat(parts)

    return spread.mapInPandas(run, schema)


def questions(records: DataFrame, key: str, generator: Generator = stub_generator, config: TextConfig = TextConfig()) -> DataFrame:
    """One question per record with its format and template reasons; ``records`` have matched_template and lines."""
    template = F.col("matched_template")
    asked = records.withColumn("prompt", templates.prompt(template, F.col("query_start_sec"), F.col("query_end_sec"), F.col("lines"), config)).withColumn("grammar", templates.grammar_of(template))
    tried = generate(asked, generator, config.trials).withColumn("query", texts.normalized_question(F.col("answer")))
    tried = tried.withColumn("format", F.when(F.col("answer").isNull(), F.lit("generator_error")).otherwise(templates.format_reason(F.col("query"), F.col("lines"), config)))
    # a trial of right form beats any other; without one the last trial stands, with its reason
    score = F.when(F.col("format") == "ok", 10 + templates.candidate_score(template, F.col("query"), F.col("lines"))).otherwise(F.col("trial") / 100.0)
    chosen = best(tried.withColumn("score", score), [key], "score", "trial")
    return chosen.withColumn("reason", F.when(F.col("format") != "ok", F.col("format")).otherwise(templates.template_reason(template, F.col("query"), config=config)))


def encoded(rows: DataFrame, key: str, vectors: DataFrame) -> DataFrame:
    """An encoder provider: vectors computed elsewhere, joined by key."""
    return rows.join(vectors, key)


def stub_encoder(sentences: list[str]) -> np.ndarray:
    """A deterministic stand-in for a sentence encoder: counts of the letters a to h."""
    return np.array([[s.lower().count(c) for c in "abcdefgh"] for s in sentences], np.float64).reshape(len(sentences), 8)


def encode(rows: DataFrame, text: str, encoder: Encoder = stub_encoder, batch: int = 256, eps: float = 1e-12) -> DataFrame:
    """Adds ``embedding``: the encoder's vectors scaled to length 1; it sees at most ``batch`` texts at once, a null as an empty one."""

    @F.pandas_udf("array<double>")
    def run(column: pd.Series) -> pd.Series:
        sentences = column.fillna("").tolist()
        out = []
        for a in range(0, len(sentences), batch):
            found = np.asarray(encoder(sentences[a:a + batch]), np.float64)
            out += list(found / (np.linalg.norm(found, axis=1, keepdims=True) + eps))
        return pd.Series(out, dtype=object)

    return rows.withColumn("embedding", run(F.col(text)))
