"""Repair of the turn structure of conversations by alignment with the alternating grammar.

A good conversation is nothing, or an optional system turn and then user and assistant turns in alternation, ended by
the assistant. The turns are aligned with each grammar string of a feasible length by the Wagner-Fischer table, of
which only the band that can beat the incumbent cost is filled (Ukkonen); the traced edits of equal cost are compared
and the ASCII-least audit stays. Edits: K keeps a turn, R gives it the role of its place, D deletes it, I inserts an
empty turn.

Long conversations are aligned in blocks, once for each pair of grammar states at a block's ends, and the blocks'
results are chained: with equal cost no audit can be another's beginning, so the least whole is made of least parts.

Turns reach a task sorted by conversation and turn and stream through it. It holds one letter a turn, and the texts of
the current conversation up to ``HELD`` characters; the few conversations beyond that are read a second time, with
their audit in front, because a hash needs all texts in order.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import cut

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
WHOLE, BLOCK = 16, 8  # turns aligned at once; longer conversations in blocks of so many
HELD = 1 << 24        # characters of a conversation that a task holds
BLANK = " \t\n\x0b\x0c\r"
NAMES = {"u": "user", "a": "assistant"}
GONE = "#"            # letter of a turn that must be deleted; others are the role's initial, upper case if truncated
LEGAL = {"su", "ua", "au"}


def string(before: str, lead: str, size: int) -> str:
    """Alternating string of ``size`` letters after state ``before``, behind ``lead``."""
    first = "au" if before == "u" else "ua"
    return lead + (first * (size // 2 + 1))[:size]


def gap(d: int) -> int:
    """Least cost of a difference of ``d`` places between turns and grammar string."""
    return INSERT * d if d > 0 else -DELETE * d


@lru_cache(1 << 16)
def aligned(turns: str, before: str, after: str) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits that lead from one grammar state to another; states are '', 's', 'u', 'a'."""
    free = sum(t != GONE for t in turns)
    must = DELETE * (len(turns) - free)
    best = None
    limit = DELETE * len(turns) + 2 * INSERT  # incumbent: delete all, insert up to two turns or keep a system turn
    strings = {}
    for size in range(0, free + limit // INSERT + 2):
        for lead in ("", "s") if before == "" else ("",):
            s = string(before, lead, size)
            if (s[-1:] or before) == after:
                strings[s] = gap(len(s) - free) + must
    for s, least in sorted(strings.items(), key=lambda x: (x[1], x[0])):
        if least > limit:
            break
        found = edits(turns, s, limit)
        if found is not None and (best is None or found < best):
            best, limit = found, found[0]
    return best


def edits(turns: str, wanted: str, limit: int) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits of ``turns`` into ``wanted``, ASCII-least; None if they cost more than ``limit``."""
    n, m, none = len(turns), len(wanted), limit + 1
    before = [0]
    for t in turns:
        before.append(before[-1] + (t != GONE))
    delta = m - before[n]
    room = limit - DELETE * (n - before[n])
    band = [d for d in range(-before[n], m + 1) if gap(d) + gap(delta - d) <= room]
    if not band:
        return None
    low, high = band[0], band[-1]
    rows = [[none] * (m + 2) for _ in range(n + 1)]  # cheapest way from (turn, place) to the end
    for i in range(n, -1, -1):
        row, below = rows[i], rows[i + 1] if i < n else None
        for j in range(min(m, before[i] + high), max(0, before[i] + low) - 1, -1):
            cost = none
            if i == n and j == m:
                cost = 0
            if i < n:
                cost = min(cost, below[j] + DELETE)
            if j < m and wanted[j] != "s":
                cost = min(cost, row[j + 1] + INSERT)
            if i < n and j < m:
                cost = min(cost, below[j + 1] + match(turns[i], wanted[j], none))
            row[j] = min(cost, none)
    if rows[0][0] > limit:
        return None
    i = j = 0
    audit = []
    while i < n or j < m:
        left = rows[i][j]
        if i < n and rows[i + 1][j] + DELETE == left:
            audit.append("D")
            i += 1
        elif j < m and wanted[j] != "s" and rows[i][j + 1] + INSERT == left:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if turns[i].lower() == wanted[j] else "R")
            i, j = i + 1, j + 1
    return rows[0][0], "".join(audit)


def match(turn: str, place: str, none: int) -> int:
    """Cost of keeping a turn at a place, with another role if need be; a system turn is made of no other."""
    if turn == GONE:
        return none
    if turn.lower() == place:
        return TRUNCATED if turn.isupper() else 0
    return none if place == "s" else REROLE + (TRUNCATED if turn.isupper() else 0)


def repaired(turns: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair of a whole conversation."""
    if len(turns) <= WHOLE:
        return min(aligned(turns, "", state) for state in ("", "a"))
    ways, done = {"": (0, "")}, []  # cheapest (cost, audit) to each state, behind the beginning that all share
    for a in range(0, len(turns), BLOCK):
        block, step = turns[a:a + BLOCK], {}
        for before, (cost, audit) in ways.items():
            for after in ("", "s", "u", "a"):
                more = aligned(block, before, after)
                if more is not None:
                    way = cost + more[0], audit + more[1]
                    step[after] = min(step.get(after, way), way)
        ways = step
        shared = os.path.commonprefix([audit for _, audit in ways.values()])
        if len(shared) > 4096:
            done.append(shared)
            ways = {s: (cost, audit[len(shared):]) for s, (cost, audit) in ways.items()}
    cost, audit = min(ways[s] for s in ("", "a") if s in ways)
    return cost, "".join(done) + audit


def turns_after(audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of each turn of the repaired conversation, from the given turns in order."""
    place = 0
    for edit in audit:
        role, text = next(turns) if edit != "I" else ("", "")
        if edit == "D":
            continue
        if edit == "K" and place == 0 and role[:1] == "s":  # a system turn takes no place in the alternation
            yield edit, role, text
            continue
        yield edit, role if edit == "K" else NAMES["ua"[place % 2]], text
        place += 1


class Turns:
    """One conversation while its turns stream by: counts, letters and, up to a limit, texts."""

    def __init__(self, conv: int | None, held: int):
        self.conv, self.held, self.letters, self.turns, self.size = conv, held, [], [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.least = self.most = self.role = self.last = None

    def add(self, turn: int | None, role: str, text: str, later: bool) -> None:
        if turn is not None and turn != self.most:
            self.least = turn if self.least is None else self.least
            self.most = turn
            self.distinct += 1
        if self.role is not None and self.role[:1] + role[:1] not in LEGAL:
            self.illegal += 1
        self.role = role
        bare = text.strip(BLANK)
        again = later or self.last == (turn, role, text)
        self.last = turn, role, text
        letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
        if not bare:
            self.blank += 1
            letter = GONE
        elif again:
            self.duplicate += 1
            letter = GONE
        elif bare[-1] not in ".!?":
            self.truncated += 1
            letter = letter.upper()
        self.letters.append(letter)
        self.size += len(role) + len(text)
        self.turns.append((role, text))
        if self.size > self.held:
            self.turns.clear()

    def result(self) -> tuple:
        cost, audit = repaired("".join(self.letters))
        gaps = self.most - self.least + 1 - self.distinct if self.distinct else 0
        digest = None if self.size > self.held else hashed(audit, iter(self.turns))
        return self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, digest


def hashed(audit: str, turns: Iterator[tuple[str, str]]) -> str:
    out, first = hashlib.sha256(), True
    for _, role, text in turns_after(audit, turns):
        out.update(f"{'' if first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
        first = False
    return out.hexdigest()


SCHEMA = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
ARROW = pa.schema([("conv_id", pa.int64()), *[(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                   ("audit", pa.string()), ("repaired_sha256", pa.string())])


def settled(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[pa.RecordBatch]:
    """Sorted turns -> one row per conversation."""
    now, out, size = None, [], 0
    for batch in batches:
        for conv, turn, role, text, gone, later in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or conv != now.conv:
                if now is not None:
                    out.append(now.result())
                    size += 200 + len(out[-1][7])
                now = Turns(conv, held)
            if not gone:
                now.add(turn, role, text, later)
            if size > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), ARROW)], schema=ARROW)
                out, size = [], 0
    if now is not None:
        out.append(now.result())
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), ARROW)], schema=ARROW)


def marked(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text, gone) with ``later``: whether an earlier turn of the conversation has the same role and text.

    Only hashes are grouped; a conversation or a text of any frequency is one row a task there, and its join may be split.
    """
    parts = [F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), "role", "text"]
    rows = turns.withColumns({"h": F.xxhash64(*parts), "g": F.xxhash64(F.lit(1), *parts)})
    first = rows.where("not gone").groupBy("h", "g").agg(F.min(F.struct("turn")).alias("first"), F.max(F.struct("turn")).alias("last")).where("first < last")
    rows = rows.join(first.select(F.col("h").alias("h1"), F.col("g").alias("g1"), "first"), (F.col("h") == F.col("h1")) & (F.col("g") == F.col("g1")), "left")
    return rows.select("conv_id", "turn", "role", "text", "gone", F.coalesce(F.col("first") < F.struct("turn"), F.lit(False)).alias("later"))


def audits(turns: DataFrame, held: int = HELD) -> DataFrame:
    """One row per conv_id of ``turns`` (conv_id, turn, role, text, gone), with the columns of ``SCHEMA``.

    Turns that are ``gone`` only name their conversation. Order is by turn, nulls first, then role and text, so that equal
    turns are neighbours; all but one of them are duplicates. Null ids are one conversation; null roles and texts read
    as one blank. A role that is empty or begins with another letter than s, u, a fits no place. An empty table gives none.
    """
    rows = turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], "gone")
    rows = marked(rows)
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), "role", "text"]
    found = cut(rows.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(lambda batches: settled(batches, held), SCHEMA))
    long = found.where("repaired_sha256 is null")
    if long.isEmpty():
        return found
    null_safe = F.col("conv_id").eqNullSafe(F.col("c"))
    again = rows.join(long.select(F.col("conv_id").alias("c")), null_safe, "left_semi").where("not gone").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text")
    led = again.unionByName(long.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text")))
    digests = led.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *order[1:]).mapInArrow(second_reading, "c bigint, digest string")
    return (found.join(digests, null_safe, "left")
            .select(*found.columns[:-1], F.coalesce("repaired_sha256", "digest").alias("repaired_sha256")))


def second_reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of conversations whose audit leads their sorted turns; nothing but the audit is held."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    head = next(rows, None)
    while head is not None:
        conv, audit, head = head[0], head[4], None

        def own() -> Iterator[tuple[str, str]]:
            nonlocal head
            for row in rows:
                if row[1] == 0:
                    head = row
                    return
                yield row[3], row[4]

        mine = own()
        digest = hashed(audit, mine)
        for _ in mine:  # up to the next audit
            pass
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([digest])], ["c", "digest"])


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns with the damage of the query's contract, by CRC-32 of conversation and turn: dropped, emptied, without full
    stops, repeated, or given to the user. Nulls read as one blank; dropped turns stay as rows that are ``gone``.
    """
    rows = conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    rows = rows.withColumn("damage", F.crc32(F.concat(part[0], F.lit(":"), part[1])) % 20)
    text = F.when(F.col("damage").isin(0, 1), "").when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       (F.col("damage") == 0).alias("gone"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("damage") == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")
