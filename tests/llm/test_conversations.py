"""Conversation repair against a plain search over grammar states."""

import hashlib
import random
import re
import zlib

import pandas as pd
import pytest

from fieldscope.llm import conversation_repair as cr

NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def brute(rows):
    """Cost, audit, faults, illegal neighbours and digest of (role, text) rows:
    from the last row on, the least (cost, whole audit) of every state."""
    seen, faults = set(), []
    for role, text in rows:
        letters = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("b" if not letters else "d" if (role, text) in seen else "t" if letters[-1] not in ".!?" else "")
        seen.add((role, text))
    none, after = (10**9, ""), None
    for i in range(len(rows), -1, -1):
        now = {}
        for state in NEXT:
            options = [none, (0, "")] if i == len(rows) and state in ("", "a") else [none]
            if i < len(rows):
                options.append((after[state][0] + 2, "D" + after[state][1]))
                if faults[i] not in ("b", "d"):
                    more, initial = 5 * (faults[i] == "t"), rows[i][0][:1]
                    if initial and initial in NEXT[state]:
                        options.append((after[initial][0] + more, "K" + after[initial][1]))
                    options += [(after[r][0] + 1 + more, "R" + after[r][1]) for r in "ua" if r in NEXT[state]]
            now[state] = min(options)
        for _ in range(4):
            for state in now:
                now[state] = min([now[state], *((now[r][0] + 5, "I" + now[r][1]) for r in "ua" if r in NEXT[state])])
        after = now
    cost, audit = after[""]
    out, i, state = [], 0, ""
    for edit in audit:
        if edit == "I":
            state = "a" if state == "u" else "u"
            out.append(("user" if state == "u" else "assistant", ""))
            continue
        role, text = rows[i]
        i += 1
        if edit == "D":
            continue
        if edit == "R":
            role = "assistant" if state == "u" else "user"
        out.append((role, text))
        state = role[0]
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return [*(faults.count(f) for f in "bdt"), illegal, cost, audit, digest]


def expected(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, f"{r[1]}:{r[2]}"))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = [gaps, *brute([r[1:] for r in own])]
    return out


def rows_of(rng, conv, n):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "a"]
    texts = ["Good.", "cut", "", " \n", None, "Why?", "Yes! ", "same.", "a:b.", "é", "x" * 300 + "."]
    return [(conv, rng.choice([None, i, i, i + 3]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"Turn {i}{rng.choice('.!? ')}") for i in range(n)]


def test_alignment_equals_search():
    rng = random.Random(3)
    for _ in range(400):
        rows = [("s" if c in "sS" else {"u": "user", "a": "assistant"}.get(c.lower(), "x"), "" if c == "-" else f"{i}" + ("" if c.isupper() else ".")) for i, c in enumerate(rng.choices("suaxSUAX-", k=rng.randint(0, 12)))]
        letters = "".join(cr.letter(r, t, False)[0] for r, t in rows)
        assert list(cr.repaired(letters)) == brute(rows)[4:6], letters


def test_cuts_do_not_matter():
    """Every way to cut a conversation in three gives the whole's cost and audit."""
    rng = random.Random(4)
    for _ in range(60):
        rows = [(t, r or " ", x or " ") for _, t, r, x in rows_of(rng, 1, rng.randint(3, 10))]
        want = brute([r[1:] for r in rows])
        seen = cr.seen_before(rows)
        i, j = sorted(rng.sample(range(1, len(rows)), 2))
        parts = [rows[:i], rows[i:j], rows[j:]]
        starts = [0, i, j]
        pdf = pd.DataFrame({"conv_id": 1, "seg": [5, 6, 9], "summary": [cr.matrix(p, [k for k in range(len(p)) if not seen[s + k]]) for p, s in zip(parts, starts)]})
        got = cr.chained(pdf)
        assert "".join(got["audit"]) == want[5] and got["cost"].tolist() == [want[4]] * 3
        assert got[["blank", "duplicate", "truncated", "illegal"]].iloc[0].tolist() == want[:4]


@pytest.mark.parametrize("segment", [1024, 7])
def test_repair(spark, segment):
    rng = random.Random(segment)
    rows = [r for conv in [*range(40), None] for r in rows_of(rng, conv, rng.randint(1, 9))]
    rows += rows_of(rng, 77, 60) + [(88, i, "user", "again.") for i in range(20)] + [(99, 0, "user", "the same row.")] * 30
    rows += [(101, 0, "user", "w " * 40_000 + "."), (101, 1, "assistant", "Fine.")]
    schema = "conv_id long, turn long, role string, text string, seg string, part int, head string"
    given = spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], schema).repartition(5)
    repairs = cr.repair(given, segment)
    got = {r[0]: list(r[1:]) for r in cr.digests(repairs).collect()}
    want = expected(rows)
    assert got == want
    assert segment > 100 or repairs.filter("parts > 5").count() > 0
    assert cr.digests(cr.repair(given.limit(0))).count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in [*range(30), None] for t in [*range(4), None]]
    got = sorted(map(str, cr.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()))
    want = []
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k:
            row = (c, t, "user" if k == 4 else r, {1: "", 2: "One Two Three"}.get(k, x))
            want += [row] * (2 if k == 3 else 1)
    assert got == sorted(f"Row(conv_id={c}, turn={t}, role={r!r}, text={x!r})" for c, t, r, x in want)
