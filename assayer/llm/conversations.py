"""Conversation structure repair by the auction algorithm for shortest paths.

A conversation's rows and the states of the role grammar ``(s?(ua)+)?`` span a lattice: node (i, state) says that i rows are done. Edits
are its arcs with integer costs. Every node has a price, a lower bound of what is left to pay, under which no arc is cheaper than the
prices' difference; a path is extended along arcs that meet the bound exactly and contracted, with its end's price raised, where no
arc does. What a finished path touches has its exact price. Arcs that are tight under exact prices make the cheapest repairs, and the
one with the least letters is traced forward.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5  # costs; to keep a row costs nothing
START, OPENED, ASKED, ANSWERED = range(4)  # nothing yet, after s, after u, after a
NEXT = (ASKED, ASKED, ANSWERED, ASKED)  # where an inserted or re-roled row leads
KEPT = ({0: OPENED, 1: ASKED}, {1: ASKED}, {2: ANSWERED}, {1: ASKED})  # by state and kind of a kept row: 0 s, 1 u, 2 a, 3 other
FINAL = (START, ANSWERED)
SOUND, CUT, BAD = range(3)  # faults of a row: none, truncated, to be deleted
BLOCK = 64  # rows that one run of the auction looks ahead
SPACES = " \t\n\x0b\f\r"
Node = tuple[int, int]


class Lattice:
    """The cheapest repair of one conversation; ``codes`` has 4 * fault + kind for each row.

    Rows go by blocks, from the last: of a finished block only the exact prices of its four first nodes stay.
    """

    def __init__(self, codes: bytes):
        self.codes = codes
        n = len(codes)
        self.exact: dict[Node, int] = {(n, state): 0 for state in FINAL}
        self.price: dict[Node, int] = {}
        self.floor, self.ahead = 0, {n: 0}
        self.rim = {n: [self.settle((n, state)) for state in range(4)]}
        self.ends = list(range(n, 0, -BLOCK))
        for end in self.ends:
            low = self.enter(end)
            self.rim[low] = [self.settle((low, state)) for state in (range(4) if low else (START,))]
        self.cost = self.rim[0][START]

    def enter(self, end: int) -> int:
        """Begin with the block of rows before ``end``: bounds are the least price at its end and what its rows cost at least."""
        low = max(0, end - BLOCK)
        self.exact = {(end, state): cost for state, cost in enumerate(self.rim[end])}
        self.price, self.floor, self.ahead = {}, min(self.rim[end]), {end: 0}
        for i in range(end - 1, low - 1, -1):
            self.ahead[i] = self.ahead[i + 1] + (DELETE if self.codes[i] >> 2 else 0)
        return low

    def of(self, node: Node) -> int:
        """An exact price, or the present bound."""
        if node in self.exact:
            return self.exact[node]
        return self.price.get(node, self.floor + self.ahead[node[0]])

    def arcs(self, node: Node) -> list[tuple[str, int, Node]]:
        """(letter, cost, next node) in the order of the letters."""
        i, state = node
        insert = ("I", INSERT, (i, NEXT[state]))
        if i == len(self.codes):
            return [insert]
        fault, kind = divmod(self.codes[i], 4)
        out = [("D", DELETE, (i + 1, state)), insert]
        if fault != BAD:
            extra = TRUNCATED if fault == CUT else 0
            if kind in KEPT[state]:
                out.append(("K", extra, (i + 1, KEPT[state][kind])))
            out.append(("R", REROLE + extra, (i + 1, NEXT[state])))
        return out

    def settle(self, origin: Node) -> int:
        """The exact price of a node: extend the path where an arc meets the price of its end, else raise that price and step back."""
        path = [origin]
        while (end := path[-1]) not in self.exact:
            cost, onward = min((c + self.of(j), j) for _, c, j in self.arcs(end))
            if self.of(end) < cost:
                self.price[end] = cost
                if len(path) > 1:
                    path.pop()
            else:
                path.append(onward)
        for node in path[:-1]:
            self.exact[node] = self.of(node)
        return self.exact[origin]

    def trace(self) -> str:
        """The letters of the cheapest repair, of several the least: at each node the first arc that is tight under exact prices."""
        node, letters = (0, START), []
        for end in reversed(self.ends):
            self.enter(end)
            paid = self.settle(node)
            while node[0] < end:
                for letter, cost, onward in self.arcs(node):
                    if cost + self.of(onward) <= paid and cost + self.settle(onward) == paid:
                        break
                letters.append(letter)
                node, paid = onward, paid - cost
        while node[1] not in FINAL:
            letters.append("I")
            node = (node[0], NEXT[node[1]])
        return "".join(letters)


@lru_cache(1 << 16)
def _short(codes: bytes) -> tuple[int, str]:
    lattice = Lattice(codes)
    return lattice.cost, lattice.trace()


def repair(codes: bytes) -> tuple[int, str]:
    """(cost, letters) of the cheapest repair; short conversations recur and are remembered."""
    return _short(codes) if len(codes) <= BLOCK else _short.__wrapped__(codes)


def replay(codes: bytes, letters: str) -> list[tuple[int, str | None]]:
    """What the repaired conversation consists of: (row, new role or None), row -1 for an inserted one."""
    out: list[tuple[int, str | None]] = []
    i, state = 0, START
    for letter in letters:
        role = "assistant" if state == ASKED else "user"
        if letter == "I":
            out.append((-1, role))
        elif letter == "K":
            out.append((i, None))
        elif letter == "R":
            out.append((i, role))
        if letter != "D":
            state = KEPT[state][codes[i] % 4] if letter == "K" else NEXT[state]
        i += letter != "I"
    return out


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) after the damage that a checksum of conversation and turn decides, nulls read as one space.

    A dropped row stays as a marker (``dropped``), so that its conversation is not forgotten; a repeated row stands twice.
    """
    told = rows.select(
        F.col("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        F.pmod(F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])), F.lit(20)).alias("mark"),
    )
    text = F.when(F.col("mark") == 1, "").when(F.col("mark") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("mark") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return told.select(
        "conv_id", "turn", F.when(F.col("mark") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("mark") == 0).alias("dropped"), F.explode(times).alias("copy"),
    ).drop("copy")


def _code() -> Column:
    """4 * fault + kind of a row, before duplicates are known; -1 for a dropped one."""
    solid = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(solid == "", BAD).when(F.right(solid, F.lit(1)).isin(".", "!", "?"), SOUND).otherwise(CUT)
    first = F.left("role", F.lit(1))
    kind = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    return F.when(F.col("dropped"), -1).otherwise(4 * fault + kind).alias("code")


class _Conversation:
    """What is known of one conversation while its rows pass: first all codes, then the texts."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.plan: list[tuple[int, str | None]] | None = None
        self.hash = hashlib.sha256()
        self.at, self.row, self.written = 0, 0, 0

    def solve(self) -> None:
        code, turn, null, h1, h2 = (np.concatenate(p) for p in zip(*self.parts, strict=True))
        self.parts = []
        alive = code >= 0
        code, turn, null, h1, h2 = code[alive], turn[alive], null[alive], h1[alive], h2[alive]
        order = np.lexsort((np.arange(len(code)), h2, h1))
        again = np.zeros(len(code), bool)
        again[order[1:]] = (h1[order[1:]] == h1[order[:-1]]) & (h2[order[1:]] == h2[order[:-1]])
        fault, kind = code // 4, code % 4
        blank = fault == BAD
        again &= ~blank
        fault = np.where(again, BAD, fault)
        turns = turn[~null]
        self.gaps = int(turns.max() - turns.min() + 1 - len(np.unique(turns))) if len(turns) else 0
        self.blank, self.duplicate, self.truncated = int(blank.sum()), int(again.sum()), int((fault == CUT).sum())
        pair = kind[:-1] * 4 + kind[1:]
        self.illegal = int((~np.isin(pair, (0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1))).sum())
        codes = (4 * fault + kind).astype(np.uint8).tobytes()
        self.cost, self.audit = repair(codes)
        self.plan = replay(codes, self.audit)

    def _say(self, line: str) -> None:
        self.hash.update((("\n" if self.written else "") + line).encode())
        self.written += 1

    def _inserts(self) -> None:
        while self.at < len(self.plan) and self.plan[self.at][0] < 0:
            self._say(f"{self.plan[self.at][1]}:")
            self.at += 1

    def text(self, role: str, text: str) -> None:
        """The next row's text, in order."""
        self._inserts()
        if self.at < len(self.plan) and self.plan[self.at][0] == self.row:
            self._say(f"{self.plan[self.at][1] or role}:{text}")
            self.at += 1
        self.row += 1

    def result(self) -> tuple:
        if self.plan is None:
            self.solve()
        self._inserts()
        return self.conv_id, self.gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, self.audit, self.hash.hexdigest()


NAMES = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repair_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), a row for every conv_id of ``rows``.

    Rows of a conversation go by turn, nulls first; rows of one turn by role and then by two hashes of the text, so that repeated
    rows are adjacent. A null conv_id is one conversation; a role that is empty or begins with another letter cannot be kept.
    Other columns are ignored; an empty table gives no rows.

    A conversation's rows are dealt to one task, as its digest is one chain over all its texts. They arrive sorted, all codes
    before all texts: the task holds 26 bytes a row of one conversation and one batch of texts, whatever the length.
    """
    kind = rows.schema["conv_id"].dataType
    h1, h2 = F.xxhash64("text").alias("h1"), F.xxhash64("role", "text").alias("h2")
    told = damaged(rows).select("conv_id", "turn", "role", "text", _code(), h1, h2)
    phases = F.when(F.col("code") < 0, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    dealt = told.select("*", F.explode(phases).alias("phase")).withColumn("text", F.when(F.col("phase") == 1, F.col("text")))
    ordered = dealt.repartition("conv_id").sortWithinPartitions("conv_id", "phase", "turn", "role", "h1", "h2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now: _Conversation | None = None
        out_types = None

        def rows_out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), out_types, strict=True)], names=list(NAMES))

        for batch in batches:
            out_types = [batch.schema.field("conv_id").type, *[pa.int64()] * 6, pa.string(), pa.string()]
            ids, phase = batch.column("conv_id").to_pylist(), batch.column("phase").to_numpy()
            texts, roles = batch.column("text").to_pylist(), batch.column("role").to_pylist()
            code, h1, h2 = (batch.column(c).to_numpy() for c in ("code", "h1", "h2"))
            null = batch.column("turn").is_null().to_numpy(zero_copy_only=False)
            turn = batch.column("turn").fill_null(0).to_numpy()
            low = 0
            while low < len(ids):
                high = low + 1
                while high < len(ids) and ids[high] == ids[low] and phase[high] == phase[low]:
                    high += 1
                if now is None or now.conv_id != ids[low]:
                    if now is not None:
                        done.append(now.result())
                    now = _Conversation(ids[low])
                if phase[low] == 0:
                    part = slice(low, high)
                    now.parts.append((code[part], turn[part], null[part], h1[part], h2[part]))
                else:
                    if now.plan is None:
                        now.solve()
                    for k in range(low, high):
                        now.text(roles[k], texts[k])
                low = high
            if len(done) >= 4096:
                yield rows_out()
                done.clear()
        if now is not None:
            done.append(now.result())
            yield rows_out()

    numbers = ", ".join(f"{n} long" for n in NAMES[1:7])
    return ordered.mapInArrow(run, f"conv_id {kind.simpleString()}, {numbers}, audit string, repaired_sha256 string")
