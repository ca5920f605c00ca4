"""Conversation repair against a plain search over all edits."""

from __future__ import annotations

import hashlib
import re
import zlib
from itertools import groupby

import numpy as np
import xxhash

ROLES = {"u": "user", "a": "assistant"}


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def plain_damage(rows):
    """{conv_id: rows after damage, in order}; a conversation without rows has an empty list."""
    out = {}
    for c, t, r, x in rows:
        kept = out.setdefault(c, [])
        r, x = " " if r is None else r, " " if x is None else x
        m = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if m == 1 else re.sub("[.!?]", "", x) if m == 2 else x
        r = "user" if m == 4 else r
        kept += [(t, r, x)] * (0 if m == 0 else 2 if m == 3 else 1)
    for kept in out.values():
        # rows of one turn: by role, then by hashes of the text
        kept.sort(key=lambda q: (q[0] is not None, q[0] or 0, q[1].encode(), signed(xxhash.xxh64_intdigest(q[2].encode(), 42))))
    return out


def plain_faults(rows):
    seen, out = set(), []
    for _, r, x in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", x)
        out.append("blank" if not solid else "duplicate" if (r, x) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((r, x))
    return out


def plain_best(rows, faults):
    """(cost, audit) by values of all suffixes: the least cost, then the least string."""
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    n = len(rows)
    value = {"": (0, ""), "a": (0, ""), "u": (5, "I"), "s": (10, "II")}
    for i in range(n - 1, -1, -1):
        bad, extra, first = faults[i] in ("blank", "duplicate"), 5 if faults[i] == "truncated" else 0, rows[i][1][:1]
        new = {}
        for q in after:
            options = [(2 + value[q][0], "D" + value[q][1])]
            if not bad:
                if first and (first == after[q] or (first == "s" and q == "")):
                    options.append((extra + value[first][0], "K" + value[first][1]))
                options.append((1 + extra + value[after[q]][0], "R" + value[after[q]][1]))
            new[q] = options
        for _ in range(3):  # up to two insertions before a row
            value_here = {q: min(new[q]) for q in after}
            for q in after:
                new[q] = new[q] + [(5 + value_here[after[q]][0], "I" + value_here[after[q]][1])]
        value = {q: min(new[q]) for q in after}
    return value[""]


def plain_repair(rows):
    out = []
    for c, kept in plain_damage(rows).items():
        faults = plain_faults(kept)
        cost, audit = plain_best(kept, faults)
        turns = {t for t, _, _ in kept if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        heads = [r[:1] for _, r, _ in kept]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(heads[:-1], heads[1:]))
        state, i, lines = "", 0, []
        for e in audit:
            want = "a" if state == "u" else "u"
            if e == "I":
                lines.append(f"{ROLES[want]}:")
            elif e != "D":
                lines.append(f"{ROLES[want] if e == 'R' else kept[i][1]}:{kept[i][2]}")
            if e != "D":
                state = kept[i][1][0] if e == "K" else want
            i += e != "I"
        assert i == len(kept) and re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((c, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return out


def test_costs_and_letters_of_random_codes():
    """Long and short conversations, so that repairs cross blocks."""
    from assayer.llm.conversations import repair

    random = np.random.default_rng(4)
    names = ["s", "u", "a", "x"]
    for k in range(700):
        n = int(random.integers(0, 9)) if k % 10 else int(random.integers(60, 300))
        kinds, faults = random.choice(4, n, p=[0.1, 0.4, 0.4, 0.1]), random.choice(3, n, p=[0.6, 0.2, 0.2])
        rows = [(None, names[x], "") for x in kinds]
        want = plain_best(rows, [("", "truncated", "blank")[f] for f in faults])
        assert repair(bytes((4 * faults + kinds).astype(np.uint8))) == want


def test_repaired_conversations(spark):
    from assayer.llm.conversations import NAMES, repair_conversations

    random = np.random.default_rng(8)
    texts = ["Yes.", "No!", "cut off", "What?", "", " \n", "é ß 日本.", None, "ends well. \t\n", "x" * 70000 + "."]
    roles = ["user", "assistant", "system", "tool", "", None, "User"]
    rows = []
    for c in [*range(260), None]:
        n = int(random.integers(1, 9))
        for t in range(n):
            usual = "system" if t == 0 and c and c % 3 == 0 else "user" if t % 2 else "assistant"
            role = usual if random.random() < 0.7 else roles[int(random.integers(len(roles)))]
            rows.append((c, t + (t > 3) if random.random() < 0.9 else None, role, texts[int(random.integers(len(texts)))]))
    rows += [(1000, t, "user" if t % 2 == 0 else "assistant", f"line {t % 40}.") for t in range(500)]
    rows += [(1001, None, None, None)] * 70 + [(1002, 7, "user", "Hi."), (1002, 7, "assistant", "Hi."), (1002, 7, "user", "Hi.")]
    dropped = next(c for c in range(2000, 9000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "gone."))
    random.shuffle(rows := [tuple(r) for r in rows])
    rows = [(None if r[0] is None else int(r[0]), None if r[1] is None else int(r[1]), r[2], r[3]) for r in rows]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, phase int").repartition(7)
    got = repair_conversations(frame)
    assert got.columns == list(NAMES)
    want = {r[0]: r for r in plain_repair(rows)}
    found = {r["conv_id"]: tuple(r) for r in got.collect()}
    assert len(want) == got.count() and found == want
    assert found[dropped] == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair_conversations(frame.where("false")).collect() == []
