"""SimHash and conversation repair against brute-force versions."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from conftest import DATA
from strandweave.llm import conversation_repair as cr
from strandweave.llm import queries, simhash


def lower(t: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def words(t: str | None) -> list[str]:
    return [w for w in lower(t or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w]


def plain_print(t: str | None, n: int = 4) -> int:
    w = words(t)
    if not w:
        return 0
    h = [xxhash.xxh64(" ".join(s).encode(), seed=42).intdigest() for s in ([w[i:i + n] for i in range(len(w) - n + 1)] if len(w) >= n else [w])]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints: dict, most: int = 4) -> dict:
    names = sorted(prints)
    value = np.array([prints[k] for k in names], np.uint64)
    near = np.bitwise_count(value[:, None] ^ value[None, :]) <= most
    out = {}
    for i, name in enumerate(names):
        if name in out:
            continue
        front = [i]
        out[name] = name
        while front:
            for j in np.flatnonzero(near[front.pop()]).tolist():
                if names[j] not in out:
                    out[names[j]] = name
                    front.append(j)
    return out


def test_fingerprints_of_odd_texts():
    texts = [None, "", " \n", "one", "One TWO", "a b c d e", "É é É é", "word " * 3000, "x" * 100_000, "a b c d a b c d a b c d"]
    got = simhash.fingerprints(pa.array(texts, pa.string()), 4).tolist()
    assert got == [plain_print(t) for t in texts]


def test_op11_equals_brute_force(spark):
    rows = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()
    prints = {r["doc_id"]: plain_print(r["text"]) for r in rows}
    want = plain_components(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.queries()["op11_simhash"](spark, f"{DATA}/sf0.001").collect()}
    assert got == {k: (f"{prints[k]:016x}", want[k]) for k in prints}


def labels(prints: list[int], pairs) -> dict:
    at = {p: p for p in prints}

    def root(p):
        while at[p] != p:
            p = at[p]
        return p

    for a, b in pairs:
        a, b = root(a), root(b)
        at[max(a, b)] = min(a, b)
    return {p: root(p) for p in prints}


@pytest.mark.parametrize("most", [0, 1, 3, 4, 7])
def test_links_of_families_and_noise(spark, most, monkeypatch):
    """Families around a few centres, chains, and noise; small blocks and packs, so that crowded values are dealt out."""
    for name, value in {"BLOCK": 16, "PACK_ROWS": 64, "PAIRS": 256}.items():
        monkeypatch.setattr(simhash, name, value)
    rnd = random.Random(most)
    prints = {rnd.getrandbits(64) for _ in range(200)} | {0, (1 << 64) - 1}
    for _ in range(3):
        centre = rnd.getrandbits(64)
        for _ in range(150):
            prints.add(centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(0, 6))))
    chain = rnd.getrandbits(64)
    for b in range(0, 60, max(most, 1)):
        chain ^= sum(1 << k for k in range(b, min(64, b + max(most, 1))))
        prints.add(chain)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = simhash.linked(spark.createDataFrame([(p,) for p in signed], "print bigint").repartition(3), most).collect()
    unsign = lambda v: v & ((1 << 64) - 1)
    want = plain_components({p: p for p in prints}, most)
    assert labels(prints, [(unsign(r["a"]), unsign(r["b"])) for r in found]) == want


def test_thresholds_are_the_cheapest():
    rnd = np.random.default_rng(1)
    parts = [np.arange(0, 16), np.arange(16, 38), np.arange(38, 64)]
    counts = [rnd.integers(0, 900, 1 << 16) * (rnd.random(1 << 16) < 0.2) for _ in parts]
    plan = simhash.Allotment(parts, counts, 4)
    prints = rnd.integers(0, 1 << 63, 20).astype(np.uint64)
    limits, cost = plan.thresholds(prints)
    assert (limits.sum(axis=1) == 2).all()
    for p, c in zip(prints, cost, strict=True):
        lead = [int(simhash.values_of(np.array([p]), b)[0]) & 0xFFFF for b in parts]
        price = lambda t: sum(float(plan.near[i][v][lead[i]]) + simhash.PROBE_COST * int(plan.probes[i][v]) for i, v in enumerate(t) if v >= 0)
        assert c == pytest.approx(min(price(t) for t in itertools.product(range(-1, 3), repeat=3) if sum(t) == 2), rel=1e-5)


def test_simhash_of_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "alpha beta gamma delta", "x"), (7, "alpha beta gamma delta", "y"), (7, "ALPHA beta gamma delta", "y"), (9, "quite another text stands here", "y"), (None, "nobody names this", "z")]
    got = simhash.components(spark.createDataFrame(rows, "doc_id bigint, text string, print string").withColumn("component_id", F.lit(5)))
    assert sorted(((r["doc_id"], r["component_id"]) for r in got.collect()), key=repr) == sorted([(1, 1), (2, 1), (None, 7), (7, 7), (7, 7), (9, 9), (None, None)], key=repr)
    assert simhash.components(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


# --- conversations

SPACE = " \t\n\x0b\x0c\r"


def plain_damage(rows: list[tuple]) -> list[tuple]:
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        row = (conv, turn, "user" if code == 4 else role, "" if code == 1 else "".join(c for c in text if c not in ".!?") if code == 2 else text)
        out += [] if code == 0 else [row] * (2 if code == 3 else 1)
    return out


def plain_repair(rows: list[tuple]) -> tuple:
    """Shortest path over (row, what is awaited) with whole audits and texts."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0))
    seen, marked = set(), []
    for _, _, role, text in rows:
        inner = text.strip(SPACE)
        marked.append("blank" if not inner else "duplicate" if (role, text) in seen else "truncated" if inner[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {}
    for i in range(len(rows), -1, -1):
        own = {}
        for q in "spqt":  # s: start, p: after a system turn, q: an answer is due, t: after an answer
            options = [(0, "", ())] if i == len(rows) and q in "st" else []
            if i < len(rows):
                fault, role, text = marked[i], rows[i][2], rows[i][3]
                c, a, x = best[i + 1][q]
                options.append((c + 4, "D" + a, x))
                if fault not in ("blank", "duplicate"):
                    more = 3 if fault == "truncated" else 0
                    if q == "s" and role[:1] == "s":
                        c, a, x = best[i + 1]["p"]
                        options.append((c + more, "K" + a, ((role, text), *x)))
                    name, then = ("assistant", "t") if q == "q" else ("user", "q")
                    c, a, x = best[i + 1][then]
                    if role[:1] == name[0]:
                        options.append((c + more, "K" + a, ((role, text), *x)))
                    options.append((c + more + 3, "R" + a, ((name, text), *x)))
            own[q] = options
        found = {}
        for q in "spqt":  # at most two insertions in a row
            line = [("q", "assistant", "t"), ("t", "user", "q")]
            at, prefix, ways = q, [], list(own[q])
            for _ in range(3):
                name, then = next((n, t) for k, n, t in [*line, ("s", "user", "q"), ("p", "user", "q")] if k == at)
                prefix.append(name)
                at = then
                ways += [(c + 3 * len(prefix), "I" * len(prefix) + a, (*[(p, "") for p in prefix], *x)) for c, a, x in own[at]]
            found[q] = min(ways)
        best[i] = found
    cost, audit, kept = best[0]["s"]
    turns = [r[1] for r in rows if r[1] is not None]
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(marked.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())


def plain_report(rows: list[tuple]) -> list[tuple]:
    rest = plain_damage(rows)
    return sorted(((c, *plain_repair([r for r in rest if r[0] == c])) for c in {r[0] for r in rows}), key=repr)


def spark_report(spark, rows: list[tuple]) -> list[tuple]:
    frame = cr.damaged(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3))
    return sorted((tuple(r) for r in cr.report(cr.repair(frame, present=F.col("present"))).collect()), key=repr)


def test_op13_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r) for r in queries.queries()["op13_conversation_repair"](spark, f"{DATA}/sf0.01").collect()), key=repr)
    assert got == plain_report(rows)


def test_random_conversations(spark):
    rnd = random.Random(5)
    rows = []
    for conv in range(300):
        turns = rnd.sample(range(40), rnd.randrange(1, 12))
        rows += [(conv, t, rnd.choice(["user", "assistant", "system", "tool", "", "user", "assistant"]), rnd.choice(["Yes.", "No!", "Maybe", "", " \n", "So it is. ", "a?", f"{t}."])) for t in sorted(turns)]
    assert spark_report(spark, rows) == plain_report(rows)


def test_conversations_with_nulls_and_one_long(spark):
    rows = [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (1, None, None, "What."), (1, None, "user", None), (2, 5, None, None), (3, 1, "system", "Only this.")]
    rows += [(9, t, "user" if t % 3 else "assistant", f"{t}." if t % 7 else "same.") for t in range(3000)]
    got, want = spark_report(spark, rows), plain_report(rows)
    # rows of one turn: the order among them is the operator's own
    assert [r for r in got if r[0] != 1] == [r for r in want if r[0] != 1]
    assert spark_report(spark, []) == []


def test_repaired_rows_and_clashing_columns(spark):
    rows = spark.createDataFrame([(1, 1, "system", "S.", "x"), (1, 2, "assistant", "A.", "x"), (1, 3, "user", "cut", "x")], "conv_id bigint, turn bigint, role string, text string, nth string").withColumn("form", F.lit(1)).withColumn("conv", F.lit(2))
    got = [tuple(r)[1:5] for r in cr.repair(rows).collect()]
    head, *edits = got
    assert head == (0, None, None, None)
    text = [(e, r, t) for _, e, r, t in edits]
    # deleting both costs 8, and then the pair must be inserted; an insertion before the answer costs 3, and the cut question goes
    assert text == [("K", "system", "S."), ("I", "user", ""), ("K", "assistant", "A."), ("D", None, None)]
    assert [tuple(r)[-2] for r in cr.report(cr.repair(rows)).collect()] == ["KIKD"]


def test_other_grammars(spark):
    """A grammar in which any roles alternate, with dearer insertions."""
    grammar = cr.RoleGrammar(rules={"S": ((), ("u", "A")), "A": ((), ("a", "S"))}, insert=5)
    rows = spark.createDataFrame([(1, t, r, "x.") for t, r in enumerate(["user", "user", "assistant"])], "conv_id bigint, turn bigint, role string, text string")
    assert [(r["cost"], r["audit"]) for r in cr.report(cr.repair(rows.withColumn("text", F.concat("text", F.col("turn"), F.lit("."))), grammar)).collect()] == [(4, "DKK")]
