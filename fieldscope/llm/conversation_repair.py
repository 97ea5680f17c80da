"""Conversation structure repair: the cheapest edits that make the turns of a
conversation alternate.

A repaired conversation is empty, or an optional system turn and then user and
assistant turns in alternation. Edits and their costs: keep (0), rerole to user
or assistant (1), delete (2; blank and repeated turns must go), insert an empty
user or assistant turn (5); a truncated turn that stays adds 5.

Method: Wagner-Fischer alignment of the turns with each feasible length of the
grammar's string. The table runs from the last turn to the first, so that all
lengths share one table: with ``k`` roles to go the rest of the string is the
same whatever its length. A first narrow band gives an incumbent cost; the band
of the final table is Ukkonen's for that cost, as no better edit script has
more than cost / 2 deletions or cost / 5 insertions. The edits are traced back
for every length of least cost, and the ASCII-least audit wins.

Rows are sorted by conversation and turn with a range partitioning, so a hot
conversation is spread over tasks like any other rows. A conversation that lies
inside one task is repaired there. One that crosses tasks, or has more than
`SEGMENT` turns, is cut into segments; each segment is aligned between all
states of the grammar, the segments' cost matrices are chained, and the chosen
edits are applied segment by segment. The result is the same wherever the cuts
lie.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, with_package

SEGMENT = 1024  # turns aligned at a time
SEGMENT_CHARS = 4 << 20  # or fewer, of long texts
HEAD = 256  # characters of a turn that its sort key holds, before a digest of all
BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
FAR = 1 << 40  # no alignment
STATES = range(4)  # nothing yet, after system, after user, after assistant


# --- alignment of one segment ------------------------------------------------
# A turn is a letter: s, u, a (its role), x (any other role), in upper case if
# truncated, or - if it must go.

def stay_cost(turn: str, role: str) -> int:
    """Cost of the turn standing as ``role``; system is only ever kept."""
    if turn == "-" or (role == "s" and turn not in "sS"):
        return FAR
    return (KEEP if turn.lower() == role else REROLE) + (TRUNCATED if turn.isupper() else 0)


def alternation(k: int, last: str) -> str:
    """The next role where ``k`` > 0 are to go and the last is ``last``."""
    return last if k % 2 else "ua"[last == "u"]


def tables(turns: str, last: str, inserts_end: bool, cost: int) -> np.ndarray:
    """Wagner-Fischer costs [turn, k]: from a turn to the end with ``k``
    alternating roles to go, within the band of ``cost``."""
    n = len(turns)
    longest = n + cost // INSERT
    table = np.full((n + 1, longest + 2), FAR)
    top = cost // INSERT if inserts_end else 0
    table[n, : top + 1] = INSERT * np.arange(top + 1)
    steps = INSERT * np.arange(longest + 2)
    odd = np.arange(longest + 2) % 2 == 1
    other = "ua"[last == "u"]
    for i in range(n - 1, -1, -1):
        low, high = max(0, n - i - cost // DELETE), n - i + cost // INSERT + 1
        row = table[i + 1] + DELETE
        for role, places in ((last, odd), (other, ~odd)):
            stay = stay_cost(turns[i], role)
            row[1:][places[1:]] = np.minimum(row[1:], table[i + 1][:-1] + stay)[places[1:]]
        row = row[low:high]
        table[i, low:high] = np.minimum.accumulate(row - steps[low:high]) + steps[low:high]
    return np.minimum(table, FAR)


def trace(turns: str, table: np.ndarray, k: int, last: str, system: np.ndarray | None) -> str:
    """The ASCII-least audit of least cost: D, I, K, R in this order of choice."""
    audit, i, n = [], 0, len(turns)
    while system is not None:  # the system turn is still to come
        if system[i] == DELETE + system[i + 1]:
            audit.append("D")
        else:
            audit.append("K")
            system = None
        i += 1
    while i < n or k:
        cost = table[i, k]
        role = alternation(k, last) if k else ""
        if i < n and cost == DELETE + table[i + 1, k]:
            audit.append("D")
            i += 1
        elif k and cost == INSERT + table[i, k - 1]:
            audit.append("I")
            k -= 1
        else:
            audit.append("K" if turns[i].lower() == role else "R")
            i, k = i + 1, k - 1
    return "".join(audit)


def lengths_of(turns: str, start: int, end: int, inserts_end: bool, cost: int) -> tuple[int, str]:
    """Least cost and audit among alignments whose band is that of ``cost``."""
    n = len(turns)
    if end < 2:  # nothing but deletions, and the system turn
        if start == end:
            return DELETE * n, "D" * n
        return (FAR, "") if start > end else system_only(turns)
    last = "ua"[end - 2]
    table = tables(turns, last, inserts_end, cost)
    wanted = {0: "u", 1: "u", 2: "a", 3: "u"}[start]  # the next role after the start state
    parity = 1 if wanted == last else 0
    best, audit = FAR, ""

    def offer(total: int, of):
        nonlocal best, audit
        if total < FAR and (total < best or total == best):
            found = of()
            if total < best or found < audit:
                best, audit = total, found

    ks = np.arange(table.shape[1])
    feasible = (ks % 2 == parity) & ((ks > 0) | (start == end))
    least = table[0][feasible].min(initial=FAR)
    system = None
    if start == 0 and any(t in "sS" for t in turns):
        # costs [turn, k] with the system turn still to come; after it a user turn
        system = np.full_like(table, FAR)
        for i in range(n - 1, -1, -1):
            system[i] = np.minimum(DELETE + system[i + 1], stay_cost(turns[i], "s") + table[i + 1])
        after = (ks % 2 == (1 if last == "u" else 0)) & (ks > 0)
        least = min(least, system[0][after].min(initial=FAR))
        for k in ks[after & (system[0] == least)].tolist() if least < FAR else ():
            offer(int(least), lambda k=k: trace(turns, table, k, last, system[:, k]))
    for k in ks[feasible & (table[0] == least)].tolist() if least < FAR else ():
        offer(int(least), lambda k=k: trace(turns, table, k, last, None))
    return best, audit


def system_only(turns: str) -> tuple[int, str]:
    kept = [(stay_cost(t, "s"), i) for i, t in enumerate(turns) if t in "sS"]
    if not kept:
        return FAR, ""
    cost = min(kept)[0]
    at = max(i for c, i in kept if c == cost)  # D sorts before K
    return cost + DELETE * (len(turns) - 1), "D" * at + "K" + "D" * (len(turns) - at - 1)


@lru_cache(maxsize=20_000)
def aligned(turns: str, start: int, end: int, inserts_end: bool) -> tuple[int, str]:
    """Least cost of the turns between two states of the grammar and its
    ASCII-least audit; without ``inserts_end`` nothing is inserted after the
    last turn."""
    band = 2 * INSERT
    while True:
        cost, audit = lengths_of(turns, start, end, inserts_end, band)
        if cost <= band:
            return cost, audit
        if band > (INSERT + DELETE) * (len(turns) + 2):
            return FAR, ""
        band = min(cost, 4 * band)  # a cost found in a narrower band is the incumbent


def repaired(turns: str) -> tuple[int, str]:
    """Least cost and ASCII-least audit of a whole conversation."""
    return min(aligned(turns, 0, end, True) for end in (0, 3))


def applied(rows: list[tuple[str, str]], audit: str, start: int) -> list[tuple[str, str]]:
    """The rows (role, text) after the edits of ``audit``, from a state on."""
    out, at, last = [], 0, {0: "", 1: "", 2: "user", 3: "assistant"}[start]
    for edit in audit:
        if edit == "I":
            last = "assistant" if last == "user" else "user"
            out.append((last, ""))
            continue
        role, text = rows[at]
        at += 1
        if edit == "D":
            continue
        if edit == "R":
            role = "assistant" if last == "user" else "user"
        last = {"s": "", "u": "user", "a": "assistant"}[role[:1]]
        out.append((role, text))
    return out


# --- faults ------------------------------------------------------------------

def letter(role: str, text: str, seen: bool) -> tuple[str, str]:
    """The turn's letter for the alignment and its first fault."""
    bare = text.rstrip(BLANKS)
    if not bare:
        return "-", "blank"
    if seen:
        return "-", "duplicate"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return (initial, "") if bare[-1] in ".!?" else (initial.upper(), "truncated")


def tally(turns: list, initials: str, faults: list[str]) -> dict:
    """Counts of a run of rows, with what is needed to add up neighbouring runs."""
    known = [t for t in turns if t is not None]
    legal = {"su", "ua", "au"}
    return {
        "rows": len(turns), "low": known[0] if known else None, "high": known[-1] if known else None, "turns": len(set(known)),
        "blank": faults.count("blank"), "duplicate": faults.count("duplicate"), "truncated": faults.count("truncated"),
        "illegal": sum(initials[i : i + 2] not in legal for i in range(len(initials) - 1)), "first": initials[:1], "last": initials[-1:],
    }


def added(a: dict, b: dict) -> dict:
    """Counts of two neighbouring runs together."""
    if not a["rows"] or not b["rows"]:
        return a if a["rows"] else b
    out = {c: a[c] + b[c] for c in ("rows", "turns", "blank", "duplicate", "truncated", "illegal")}
    out["turns"] -= a["high"] is not None and a["high"] == b["low"]
    out["illegal"] += a["last"] + b["first"] not in {"su", "ua", "au"}
    out["low"], out["high"] = (b["low"] if a["low"] is None else a["low"]), (a["high"] if b["high"] is None else b["high"])
    return out | {"first": a["first"], "last": b["last"]}


# --- on Spark ----------------------------------------------------------------

COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long"


def counts(t: dict) -> list[int]:
    gaps = 0 if t["low"] is None else t["high"] - t["low"] + 1 - t["turns"]
    return [gaps, t["blank"], t["duplicate"], t["truncated"], t["illegal"]]


def of_rows(turns: list, repeats: list[bool]) -> tuple[str, dict]:
    """Letters and tally of rows (turn, role, text)."""
    letters, faults = zip(*(letter(role, text, seen) for (_, role, text), seen in zip(turns, repeats, strict=True)), strict=True)
    return "".join(letters), tally([t for t, _, _ in turns], "".join(role[:1] or "\0" for _, role, _ in turns), list(faults))


def seen_before(turns: list) -> list[bool]:
    seen: set[tuple[str, str]] = set()
    return [(r, t) in seen or seen.add((r, t)) is not None for _, r, t in turns]


def runs(batches: Iterator[pa.RecordBatch], segment: int) -> Iterator[tuple[object, bool, list]]:
    """(conversation, whether all of it is there, its rows or a segment of
    them) of one task's sorted rows. The first and the last conversation of a
    task may go on in its neighbours."""
    now, held, chars, cut, n = None, [], 0, False, 0
    for b in batches:
        rows = zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)
        for conv, some in itertools.groupby(rows, key=lambda r: r[0]):
            if n == 0 or conv != now:
                if held:
                    yield now, not (cut or n == 1), held
                now, held, chars, cut, n = conv, [], 0, False, n + 1
            for _, turn, role, text in some:
                if len(held) == segment or chars > SEGMENT_CHARS:
                    yield now, False, held
                    held, chars, cut = [], 0, True
                held.append((turn, role, text))
                chars += len(text)
    if held:
        yield now, False, held


TURNS = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def text_size(turns) -> int:
    return sum(len(t[-1]) for t in turns)


def matrix(turns: list, firsts: list[int] | None) -> str:
    """A segment between all states: tally, costs and audits, as JSON."""
    known = set(firsts or [])
    letters, t = of_rows(turns, [i not in known for i in range(len(turns))])
    pairs = [[aligned(letters, p, q, False) for q in STATES] for p in STATES]
    return json.dumps({"tally": t, "cost": [[c for c, _ in row] for row in pairs], "audit": [[a for _, a in row] for row in pairs]})


CHAIN = f"seg long, part long, parts long, start int, {COUNTS}, cost long, audit string"


def chained(pdf: pd.DataFrame) -> pd.DataFrame:
    """The segments of one conversation (a row each, without texts) put
    together: the cheapest states at their borders, audits ASCII-least."""
    pdf = pdf.sort_values("seg")
    given = [json.loads(x) for x in pdf["summary"]]
    total = given[0]["tally"]
    for g in given[1:]:
        total = added(total, g["tally"])
    # cost to go after the last segment: turns inserted to end on an assistant turn
    go = [[0, 2 * INSERT, INSERT, 0]]
    for g in reversed(given):
        go.append([min(c + rest for c, rest in zip(row, go[-1], strict=True)) for row in g["cost"]])
    go.reverse()
    state, out = 0, []
    for k, (seg, g) in enumerate(zip(pdf["seg"], given, strict=True)):
        fits = [(g["audit"][state][q], q) for q in STATES if g["cost"][state][q] + go[k + 1][q] == go[k][state]]
        audit, after = min(fits)
        if k + 1 == len(given):
            audit += "I" * {0: 0, 1: 2, 2: 1, 3: 0}[after]
        out.append([seg, k + 1, len(given), state, *counts(total), go[0][0], audit])
        state = after
    return pd.DataFrame(out, columns=[c.split()[0] for c in CHAIN.split(", ")])


def repair(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``conversations(conv_id, turn, role, text)``, one row per turn, to
    conv_id, part, parts, gaps, blank, duplicate, truncated, illegal, cost,
    audit and turns (role, text).

    There is one row per conversation, and per part of at most ``segment`` turns
    where a conversation is longer or lay across tasks (part 1 to parts). Counts
    and cost are those of the whole conversation; audit and turns are the
    part's own and follow each other. A turn's first fault counts: blank,
    duplicate (role and text seen earlier), truncated (does not end with one of
    ``.!?``). ``gaps`` are turn numbers missing between the smallest and the
    largest, ``illegal`` neighbouring turns whose roles do not alternate.

    Nulls: a null role or text is one space; null turns come first and do not
    count in ``gaps``; rows with a null conv_id are one conversation. Turns of
    one number are taken in the order of role and text (of their first `HEAD`
    characters, then of a hash). A role that starts with none of s, u and a,
    or is empty, fits nowhere and can be reroled or deleted. Whole texts are
    kept however long. An empty table gives no rows; other columns, whatever
    their names, are ignored.
    """
    spark = with_package(conversations.sparkSession)
    scratch = Scratch(spark)
    id_type = conversations.schema["conv_id"].dataType.simpleString()
    space = F.lit(" ")
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    order = ["conv_id", "turn", "head", "hash", "copy"]  # copies of a row, in any order, can go to different tasks
    keyed = rows.select("*", F.left(F.concat_ws(":", "role", "text"), F.lit(HEAD)).alias("head"), F.xxhash64("role", "text").alias("hash"), F.monotonically_increasing_id().alias("copy"))
    in_order = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select(*rows.columns)

    found_schema = f"conv_id {id_type}, seg long, whole boolean, {COUNTS}, cost long, audit string, turns array<struct<turn:long,role:string,text:string>>"

    def find(batches):
        first = TaskContext.get().partitionId() << 33
        out = None

        def each():
            nonlocal out
            for seg, (conv, whole, turns) in enumerate(runs(taken(), segment)):
                if whole:
                    letters, t = of_rows(turns, seen_before(turns))
                    cost, audit = repaired(letters)
                    yield conv, first + seg, True, *counts(t), cost, audit, [(None, *r) for r in applied([x[1:] for x in turns], audit, 0)]
                else:
                    yield conv, first + seg, False, *[None] * 7, turns

        def taken():
            nonlocal out
            for b in batches:
                out = out or pa.schema([("conv_id", b.schema.field(0).type), ("seg", pa.int64()), ("whole", pa.bool_()), *((c.split()[0], pa.int64()) for c in COUNTS.split(", ")),
                                        ("cost", pa.int64()), ("audit", pa.string()), ("turns", TURNS)])
                yield b

        held, total = [], 0
        for row in each():
            held.append(row)
            total += 100 + text_size(row[-1])
            if total > SEGMENT_CHARS:
                yield batch_of(held, out)
                held, total = [], 0
        if held:
            yield batch_of(held, out)

    found = scratch.keep(in_order.mapInArrow(find, found_schema))
    plain = "transform(turns, t -> named_struct('role', t.role, 'text', t.text))"
    numbers = [c.split()[0] for c in COUNTS.split(", ")] + ["cost"]
    whole = found.filter("whole").select("conv_id", F.lit(1).cast("long").alias("part"), F.lit(1).cast("long").alias("parts"), *numbers, "audit", F.expr(plain).alias("turns"))

    parts = found.filter("NOT whole").select("conv_id", "seg", "turns")
    each = parts.select("conv_id", "seg", F.posexplode("turns").alias("i", "t"))
    same = F.sha2(F.concat(F.length("t.role").cast("string"), F.lit(":"), "t.role", "t.text"), 256)
    firsts = each.groupBy("conv_id", same.alias("row")).agg(F.min(F.struct("seg", "i")).alias("f")).groupBy(F.col("f.seg").alias("seg")).agg(F.collect_list("f.i").alias("firsts"))

    def summarize(batches):
        for b in batches:
            turns = ([(t["turn"], t["role"], t["text"]) for t in x] for x in b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([matrix(t, f) for t, f in zip(turns, b.column(3).to_pylist(), strict=True)], pa.string())], names=["conv_id", "seg", "summary"])

    summaries = parts.join(firsts, "seg", "left").select("conv_id", "seg", "turns", "firsts").mapInArrow(summarize, f"conv_id {id_type}, seg long, summary string")
    chosen = summaries.groupBy("conv_id").applyInPandas(chained, CHAIN)
    edited_schema = f"conv_id {id_type}, part long, parts long, {COUNTS}, cost long, audit string, turns array<struct<role:string,text:string>>"

    def edit(batches):
        for b in batches:
            names = b.schema.names
            turns, audits, starts = (b.column(names.index(c)).to_pylist() for c in ("turns", "audit", "start"))
            done = [[{"role": r, "text": t} for r, t in applied([(x["role"], x["text"]) for x in rows], a, s)] for rows, a, s in zip(turns, audits, starts, strict=True)]
            out = pa.array(done, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))
            kept = [c for c in names if c not in ("turns", "start", "seg")]
            yield pa.RecordBatch.from_arrays([*(b.column(names.index(c)) for c in kept), out], names=[*kept, "turns"])

    edited = parts.join(chosen, "seg").select("conv_id", "part", "parts", *numbers, "audit", "turns", "start").mapInArrow(edit, edited_schema)
    return whole.unionByName(edited)


def digests(repairs: DataFrame) -> DataFrame:
    """``repair``'s rows to one row per conversation: counts, cost, the whole
    audit, and repaired_sha256 (of ``role:text`` of the repaired turns, joined
    by newlines). The parts of a conversation stream through one task in their
    order, since a digest has to be taken in order; they are not held there."""
    numbers = [c.split()[0] for c in COUNTS.split(", ")] + ["cost"]
    line = "array_join(transform(turns, t -> concat(t.role, ':', t.text)), '\n')"
    out = ["conv_id", *numbers, "audit", "repaired_sha256"]
    single = repairs.filter("parts = 1").withColumn("repaired_sha256", F.sha2(F.expr(line), 256)).select(*out)
    id_type = repairs.schema["conv_id"].dataType.simpleString()

    def fold(batches):
        rows = ((b.slice(i, 1), n) for b in batches for i, n in enumerate(b.column(1).to_pylist()))
        audit, digest, some = [], None, False
        for row, n in rows:
            r = row.to_pylist()[0]
            if n == 1:
                audit, digest, some = [], hashlib.sha256(), False
            audit.append(r["audit"])
            if r["turns"]:
                digest.update((b"\n" if some else b"") + r["lines"].encode())
                some = True
            if n == r["parts"]:
                cols = [row.column(0), *(row.column(row.schema.names.index(c)) for c in numbers), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])]
                yield pa.RecordBatch.from_arrays(cols, names=out)

    several = repairs.filter("parts > 1").select("conv_id", "part", "parts", *numbers, "audit", F.size("turns").alias("turns"), F.expr(line).alias("lines"))
    folded = several.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(fold, f"conv_id {id_type}, {COUNTS}, cost long, audit string, repaired_sha256 string")
    return single.unionByName(folded)


def damaged(conversations: DataFrame) -> DataFrame:
    """A stated damage: nulls become one space, and crc32 of ``conv_id:turn``
    modulo 20 drops a row (0), empties its text (1), removes ``.!?`` (2),
    repeats it (3) or gives it the role user (4). For trials of ``repair``."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("_k")).filter("_k <> 0")
    text = F.when(F.col("_k") == 1, F.lit("")).when(F.col("_k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_k") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(1), F.when(F.col("_k") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_c")).drop("_c")
