"""Constants of the curation pipeline; every operator takes them as parameters too.

All values are fixed values of the curated data's definition.
"""

from __future__ import annotations

from dataclasses import dataclass

#: Edges of the duration buckets, in seconds (fixed values).
DURATION_EDGES = (0.0, 2.0, 4.0, 8.0, 16.0, 32.0, 60.0)
#: Most narrations in a long window, by bucket (fixed values).
MOST_NARRATIONS = {(4.0, 8.0): 3, (8.0, 16.0): 4, (16.0, 32.0): 5, (32.0, 60.0): 6}


@dataclass(frozen=True)
class WindowConfig:
    short_longest: float = 4.0
    short_widths: tuple[int, ...] = (2, 3)
    long_widths: tuple[int, ...] = (3, 4, 5, 6, 7, 8)
    long_gap_v1: float = 8.0
    long_gap_v2: float = 16.0
    roll_gap_v2: float = 24.0
    roll_widths_v2: tuple[int, ...] = (3, 4, 5, 6)
    roll_lengths: tuple[float, ...] = (36.0, 44.0, 52.0, 60.0, 68.0)
    roll_step: float = 8.0
    roll_fraction: float = 0.08
    roll_cap: int = 4000
    roll_least: int = 4
    roll_longest_video: float = 6 * 3600.0
    eps: float = 1e-3
    least_duration: float = 1e-6
    longest: float = 60.0
    unsure_tag: str = "#unsure"


@dataclass(frozen=True)
class PlanConfig:
    final_target: int = 150_000
    safety: float = 1.10
    acceptance: tuple[float, ...] = (1.0, 1.0, 1.0, 1.0, 1.0, 0.9)
    least_query: float = 0.4
    clip_tolerance: float = 10.0
    most_queries: int = 10
    fill_tolerance: float = 0.15
    end_buffer: float = 5.0
    segment_tolerance: float = 0.05
    density_split: float = 10.0
    eps: float = 1e-3


@dataclass(frozen=True)
class CleanConfig:
    eps: float = 1e-6
    least_query: float = 0.2
    longest_query: float = 120.0
    shard_rows: int = 10_000


@dataclass(frozen=True)
class TextConfig:
    padding: float = 1.0
    most_lines: int = 24
    trials: int = 5
    least_words: int = 3
    most_words: int = 24
    anchor_tokens: int = 10


@dataclass(frozen=True)
class MergeConfig:
    digits: int = 3
    per_window: int = 1
    target: int = 50_000
    seed: int = 42
