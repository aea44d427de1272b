"""Conversation structure repair: error-correcting Earley parsing of role sequences.

A conversation must read as a weighted role grammar allows: here an optional
system turn and then pairs of a user's and an assistant's turn, or nothing.
Rows may be kept, reroled or deleted and empty rows inserted, each at a cost;
the repair is the cheapest list of edits, and of equally cheap ones that whose
initials are least in ASCII.

*Chart.*  The grammar is right-linear, so every nonterminal stands last in its
production: its completion completes the caller as well, and chart items need
no origin.  An item is a nonterminal that awaits the rest of the conversation
and retains the minimum (cost, audit) of that rest; scanning has a production
for each edit, and insertions are closed over within a column.  Columns are
built from the last row to the first, as only suffixes keep their order when
an edit comes before them.  An audit is compared by its first edit and the rank
of the item that follows, never as a string.  Columns are the same up to a
constant cost again and again, so a step from one to the next is looked up; a
row leaves the number of its step alone, and the completed chart is walked
forward to the edits.

*On Spark.*  Faults are found by DataFrame operations, the duplicates in a
window over equal rows.  Conversations are dealt out by a hash and sorted
within partitions, each twice: its rows' roles from last to first, then its
rows with their texts from first to last.  A task reads its partition as a
stream and holds one batch and four bytes for each row of the conversation
it is in, whatever the lengths.  A repaired conversation and its digest are one
sequence, so a conversation is one task's; nothing of it is gathered.

Defined results: null roles and texts are one space (so the row is blank, and
its role is none of the grammar's); rows without a turn stand first; rows of
one turn are in order of role, then of a hash of their texts; a null
conversation id is a conversation of its own; only roles' first letters
matter, and other letters must be reroled or deleted; extra columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: White space; texts of nothing else are blank.
SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
LEGAL_PAIRS = frozenset({"su", "ua", "au"})
FAULTS = ("", "blank", "duplicate", "truncated")
FLUSH_ROWS, FLUSH_CHARS = 4096, 1 << 20


@dataclass(frozen=True)
class RoleGrammar:
    """A right-linear grammar over role initials, with the costs of edits.

    ``rules``: for each nonterminal its productions, (terminal, nonterminal) or
    () for nothing; the first nonterminal is the start.  ``roles``: the role
    that a terminal is given by rerole and insert; other terminals are only kept.
    """

    rules: dict[str, tuple[tuple[str, ...], ...]] = field(default_factory=lambda: {"S": ((), ("s", "P"), ("u", "Q")), "P": (("u", "Q"),), "Q": (("a", "T"),), "T": ((), ("u", "Q"))})
    roles: dict[str, str] = field(default_factory=lambda: {"u": "user", "a": "assistant"})
    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3


#: An item: (cost, edits' initials in this column, rank of the following item, terminals inserted, edit or "", its terminal, nonterminal that follows).
_Item = tuple[int, str, int, tuple[str, ...], str, str, str]


class Chart:
    """Columns of minimal items, built backwards; the steps between columns are kept by their content."""

    def __init__(self, grammar: RoleGrammar):
        self.grammar = grammar
        self.names = tuple(grammar.rules)
        self.steps: list[dict[str, _Item]] = []
        self._known: dict[tuple, tuple[int, tuple, int]] = {}
        #: steps[0] closes the conversation.
        ended = {q: (0, "", 0, (), "", "", "") for q, productions in grammar.rules.items() if () in productions}
        self.end_column, self.end_cost = self._column(ended)

    def _column(self, items: dict[str, _Item]) -> tuple[tuple, int]:
        """Close the items over insertions and note them as a step: ((relative cost, rank) by nonterminal, least cost)."""
        best, changed = dict(items), True
        while changed:  # inserting costs something, so this ends
            changed = False
            for q, productions in self.grammar.rules.items():
                for production in productions:
                    if not production or production[0] not in self.grammar.roles or production[1] not in best:
                        continue
                    cost, audit, rank, inserted, edit, terminal, then = best[production[1]]
                    new = (cost + self.grammar.insert, f"I{audit}", rank, (production[0], *inserted), edit, terminal, then)
                    if q not in best or new[:3] < best[q][:3]:
                        best[q], changed = new, True
        order = sorted({item[1:3] for item in best.values()})
        least = min((item[0] for item in best.values()), default=0)
        self.steps.append(best)
        return tuple((best[q][0] - least, order.index(best[q][1:3])) if q in best else None for q in self.names), least

    def step(self, column: tuple, initial: str, gone: bool, truncated: bool) -> tuple[int, tuple, int]:
        """(number of the step, the column before, what its least cost adds) for a row before ``column``."""
        terminals = {p[0] for productions in self.grammar.rules.values() for p in productions if p}
        key = column, initial if initial in terminals else "", gone, truncated and not gone
        if key in self._known:
            return self._known[key]
        after, items, grammar = dict(zip(self.names, column, strict=True)), {}, self.grammar
        for q, productions in grammar.rules.items():
            options = [(after[q][0] + grammar.delete, "D", after[q][1], (), "D", "", q)] if after[q] else []
            for terminal, then in (p for p in productions if p):
                if gone or not after[then]:
                    continue
                cost, rank = after[then][0] + (grammar.truncated if truncated else 0), after[then][1]
                if terminal == initial:
                    options.append((cost, "K", rank, (), "K", terminal, then))
                if terminal in grammar.roles:
                    options.append((cost + grammar.rerole, "R", rank, (), "R", terminal, then))
            if options:
                items[q] = min(options)
        number = len(self.steps)
        self._known[key] = number, *self._column(items)
        return self._known[key]

    def walk(self, steps: Iterator[int]) -> Iterator[tuple[str, str]]:
        """(edit, role's terminal) in order, from the steps of the rows from first to last and then 0."""
        at = self.names[0]
        for number in steps:
            _, _, _, inserted, edit, terminal, then = self.steps[number][at]
            for t in inserted:
                yield "I", t
            if edit:
                yield edit, terminal
            at = then


class _Sheet:
    """Rows under way to Arrow batches."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.chars = schema, [], 0

    def full(self) -> bool:
        return len(self.rows) >= FLUSH_ROWS or self.chars >= FLUSH_CHARS

    def take(self) -> pa.RecordBatch:
        columns = zip(*self.rows, strict=True) if self.rows else [[] for _ in self.schema]
        batch = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)
        self.rows, self.chars = [], 0
        return batch


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Reader:
    """Takes the rows of one conversation, roles from last to first and then texts from first to last; gives its head and its edits."""

    def __init__(self, chart: Chart):
        self.chart, self.steps = chart, array("L")
        self.column, self.cost = chart.end_column, chart.end_cost
        self.found, self.illegal, self.after = [0] * len(FAULTS), 0, None
        self.turns, self.last, self.first = 0, None, None
        self.edits: Iterator[tuple[str, str]] | None = None
        self.number = 0

    def role(self, turn: int | None, initial: str, fault: int) -> None:
        self.found[fault] += 1
        if self.after is not None and initial + self.after not in LEGAL_PAIRS:
            self.illegal += 1
        self.after = initial
        if turn is not None:
            self.last = turn if self.last is None else self.last
            if turn != self.first:
                self.turns, self.first = self.turns + 1, turn
        number, self.column, added = self.chart.step(self.column, initial, fault in (1, 2), fault == 3)
        self.cost += added
        self.steps.append(number)

    def head(self) -> tuple:
        """The counts of the conversation; edits come after it."""
        self.edits = self.chart.walk(i for i in (*reversed(self.steps), 0)) if self.steps else iter(())
        start = self.column[0] if self.steps else (0, 0)
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return gaps, *self.found[1:], self.illegal, self.cost + start[0] if self.steps else 0

    def rows(self, role: str | None, text: str | None) -> Iterator[tuple]:
        """(step, edit, role, text) up to the one that takes the next row, or to the end without one."""
        for edit, terminal in self.edits:
            self.number += 1
            if edit == "I":
                yield self.number, "I", self.chart.grammar.roles[terminal], ""
                continue
            yield self.number, edit, {"K": role, "R": self.chart.grammar.roles.get(terminal)}.get(edit), None if edit == "D" else text
            return


def repair(rows: DataFrame, grammar: RoleGrammar | None = None, present: Column | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Each conversation's head and its edits, consecutive and in order within partitions.

    (conv, step, edit, role, text, gaps, blank, duplicate, truncated, illegal,
    cost): step 0 is the head, which has the counts; steps from 1 on are edits
    K, R, D or I, with the role and text that the repaired conversation has
    there (null for D).  Rows where ``present`` is false only name their
    conversation.
    """
    grammar = grammar or RoleGrammar()
    there = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    own = rows.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(" ")).alias("text"), there.alias("there"))
    kind = own.schema["conv"].dataType.simpleString()
    nth = F.row_number().over(Window.partitionBy("conv", "there", "role", "text").orderBy(F.asc_nulls_first("turn")))
    tail = F.rtrim("text", F.lit(SPACE))
    fault = F.when(F.length(tail) == 0, 1).when(F.col("nth") > 1, 2).when(~F.substring(tail, -1, 1).isin(*ENDS), 3).otherwise(0)
    judged = own.withColumn("nth", nth).select("conv", "turn", "there", "role", "text", "nth", F.xxhash64("text").alias("h"), fault.alias("fault"))
    forms = F.array(
        F.struct(F.lit(0).alias("pass"), F.substring("role", 1, 1).alias("word"), F.lit(None).cast("string").alias("body")),
        F.struct(F.lit(1).alias("pass"), F.col("role").alias("word"), F.col("text").alias("body")),
    )
    dealt = judged.select("conv", "turn", "there", "role", "h", "nth", "fault", F.explode(forms).alias("form")).where("there OR form.pass = 0").repartition("conv")
    back = [F.when(F.col("form.pass") == 0, F.col(c)) for c in ("turn", "role", "h", "nth")]
    ordered = dealt.sortWithinPartitions("conv", "form.pass", *[b.desc_nulls_last() for b in back], F.asc_nulls_first("turn"), "role", "h", "nth")
    ordered = ordered.select("conv", "form.pass", "there", "turn", "form.word", "fault", "form.body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chart, reader, conv, sheet = Chart(grammar), None, None, None

        def closing() -> None:
            if reader.edits is None:
                sheet.rows.append((conv, 0, None, None, None, *reader.head()))
            sheet.rows.extend((conv, *edit, *[None] * len(_COUNTS)) for edit in reader.rows(None, None))

        for batch in batches:
            if sheet is None:
                sheet = _Sheet(pa.schema([("conv", batch.schema.field(0).type), ("step", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string()), *[(c, pa.int64()) for c in _COUNTS]]))
            for name, second, there_, turn, word, fault_, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if reader is None or name != conv:
                    if reader is not None:
                        closing()
                    reader, conv = _Reader(chart), name
                if not second:
                    if there_:
                        reader.role(turn, word, fault_)
                else:
                    if reader.edits is None:
                        sheet.rows.append((conv, 0, None, None, None, *reader.head()))
                    sheet.rows.extend((conv, *edit, *[None] * len(_COUNTS)) for edit in reader.rows(word, body))
                    sheet.chars += len(body)
                if sheet.full():
                    yield sheet.take()
        if reader is not None:
            closing()
            yield sheet.take()

    return ordered.mapInArrow(run, f"conv {kind}, step bigint, edit string, role string, text string, {', '.join(f'{c} bigint' for c in _COUNTS)}").withColumnRenamed("conv", conv_col)


def report(repaired: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of repair()'s rows, in their order.

    The digest is of ``role:text`` of what the repaired conversation holds, joined by newlines.
    """
    conv_col = repaired.columns[0]
    kind = repaired.schema[conv_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, audit, digest, any_ = None, [], hashlib.sha256(), False
        for batch in batches:
            done = []
            for conv, step, edit, role, text, *counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if step == 0:
                    if held is not None:
                        done.append((*held, "".join(audit), digest.hexdigest()))
                    held, audit, digest, any_ = (conv, *counts), [], hashlib.sha256(), False
                    continue
                audit.append(edit)
                if edit != "D":
                    digest.update(f"{chr(10) if any_ else ''}{role}:{text}".encode())
                    any_ = True
            yield _rows(done, batch)
        if held is not None:
            yield _rows([(*held, "".join(audit), digest.hexdigest())], batch)

    def _rows(done: list, batch: pa.RecordBatch) -> pa.RecordBatch:
        sheet = _Sheet(pa.schema([("conv", batch.schema.field(0).type), *[(c, pa.int64()) for c in _COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())]))
        sheet.rows = done
        return sheet.take()

    return repaired.mapInArrow(run, f"conv {kind}, {', '.join(f'{c} bigint' for c in _COUNTS)}, audit string, repaired_sha256 string").withColumnRenamed("conv", conv_col)


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, present): the rows with faults put in, by crc32 of ``conv:turn`` modulo 20; nulls are one space there and in roles and texts."""
    word = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    code = F.crc32(F.concat(word(conv_col), F.lit(":"), word(turn_col))) % 20
    own = rows.select(F.col(f"`{conv_col}`").alias(conv_col), F.col(f"`{turn_col}`").alias(turn_col), word(role_col).alias(role_col), word(text_col).alias(text_col), code.alias("code"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate(text_col, ENDS, "")).otherwise(F.col(text_col))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col(role_col))
    copies = F.explode(F.array_repeat(F.col("code") != 0, F.when(F.col("code") == 3, 2).otherwise(1)))
    return own.select(conv_col, turn_col, role.alias(role_col), text.alias(text_col), copies.alias("present"))
