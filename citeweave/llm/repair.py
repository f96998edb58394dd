"""Conversation structure repair: the cheapest edits that make role initials read ``(s?(ua)+)?``.

Every number is one big integer.  Its high digits are the cost of the edits from a point of a conversation to its
end; its low digits, ``digits`` of ``BITS`` bits each, spell the letters of those edits from the first, most
significant, on, with zeros behind the last.  So the lesser integer is the cheaper repair and, at equal
cost, the one whose letters come first in ASCII order, a shorter one before its continuations.  To put an edit in
front, the low digits move one place down, the letter goes into the highest place and its cost is added.

The points are (row, what the roles written so far end in).  They form a directed acyclic graph, walked from the
last row to the first; each point takes the least of its integers (``min``) over all edits, and the integer of the start
holds the whole answer.  Four integers are alive at a time.

Two streams of rows pass through the tasks, each dealt by conversation and sorted in it:

1. Narrow rows (turn, role, what the text ends in, its hash) give the faults, the integers and the audit.
2. The texts, with the audit before them, are edited and hashed as they pass.

A conversation, however long, is thus never held with its texts; the first stream keeps a few numbers
for each of its rows.  The integers of a conversation of n rows have about eight n bits, so its time
grows with n squared over the word size.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.session import Workspace

SPACES = " \t\n\x0b\x0c\r"
LETTERS = "DIKR"  # in ASCII order; digit 0 is no letter
BITS = 3
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
COST = {DELETE: 3, INSERT: 2, KEEP: 0, REROLE: 2}
# what the roles written so far end in: nothing, s, u, a
NONE, SYSTEM, USER, ASSISTANT = range(4)
WRITES = {"s": {NONE: SYSTEM}, "u": {NONE: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
MADE = {NONE: "user", SYSTEM: "user", ASSISTANT: "user", USER: "assistant"}  # the role that an inserted or reroled row gets


def cheapest(rows: list[tuple[str, bool]]) -> tuple[int, str]:
    """Least cost and audit letters for rows of (role initial, or "" if the row must go; whether the text is truncated)."""
    # deleting all rows bounds the cost, and so the inserts, of any point's best repair
    digits = len(rows) + 3 * len(rows) // 2 + 4
    low, first = (1 << BITS * digits) - 1, BITS * (digits - 1)
    one = 1 << BITS * digits
    never = one << 64

    def before(letter: int, extra: int, rest: int) -> int:
        tail = rest & low
        return (rest ^ tail) + (COST[letter] + extra) * one + (letter << first) + (tail >> BITS)

    def with_inserts(at: list[int]) -> list[int]:
        user = min(at[USER], before(INSERT, 0, at[ASSISTANT]))
        assistant = min(at[ASSISTANT], before(INSERT, 0, at[USER]))
        return [min(at[NONE], before(INSERT, 0, user)), min(at[SYSTEM], before(INSERT, 0, user)), user, assistant]

    points = with_inserts([0, never, never, 0])
    for initial, truncated in reversed(rows):
        now = [before(DELETE, 0, rest) for rest in points]
        if initial:
            for state in range(4):
                if (to := WRITES.get(initial, {}).get(state)) is not None:
                    now[state] = min(now[state], before(KEEP, truncated, points[to]))
                now[state] = min(now[state], before(REROLE, truncated, points[ASSISTANT if state == USER else USER]))
        points = with_inserts(now)
    spelled = format(points[NONE] & low, "o").zfill(digits).rstrip("0")
    return points[NONE] >> BITS * digits, "".join(LETTERS[int(d) - 1] for d in spelled)


def damaged(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``conv, turn, place, copy, gone, role, text``: rows damaged by the checksum of ``conv:turn``; dropped ones
    are marked ``gone``.  ``place`` orders rows of one turn: the role and the hash of the text before the damage."""
    def plain(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(plain(id_col), F.lit(":"), plain(turn_col))) % 20
    rows = turns.select(F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), kind.alias("kind"), plain(role_col).alias("role"), plain(text_col).alias("text"))
    rows = rows.withColumn("place", F.struct("role", F.unhex(F.sha2("text", 256)).alias("hash")))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv", "turn", "place", copies.alias("copy"), (F.col("kind") == 0).alias("gone"), role.alias("role"), text.alias("text"))


class _Conversation:
    """Faults of the rows of one conversation as they pass."""

    def __init__(self):
        self.low = self.high = self.before = None
        self.turns, self.seen, self.rows = set(), set(), []
        self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn, initial: str, end: str, name: bytes) -> None:
        if turn is not None:
            self.low, self.high = (turn, turn) if self.low is None else (min(self.low, turn), max(self.high, turn))
            self.turns.add(turn)
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        blank, again = not end, name in self.seen
        cut = not blank and not again and end not in ".!?"
        self.seen.add(name)
        self.blank += blank
        self.duplicate += not blank and again
        self.truncated += cut
        self.rows.append(("" if blank or again else initial, cut))

    def answer(self) -> tuple:
        cost, audit = cheapest(self.rows)
        gaps = 0 if self.low is None else self.high - self.low + 1 - len(self.turns)
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


ANSWER = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def audits(rows: DataFrame) -> DataFrame:
    """``conv``, the fault counts, ``cost, audit`` of each conversation of ``damaged`` rows."""
    kind = rows.schema["conv"].dataType.simpleString()
    end = F.rtrim(F.col("text"), F.lit(SPACES))
    name = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    narrow = rows.select("conv", "turn", "place", "copy", "gone", F.substring("role", 1, 1).alias("initial"), F.substring(end, -1, 1).alias("end"), name.alias("name"))
    order = ["conv", "turn", "place", "copy"]  # nulls first

    def run(batches):
        import pyarrow as pa

        held, now = None, (None,)  # the conversation at hand, and its id (in a tuple, as ids may be null)

        def out(found):
            columns = [pa.array([f[0] for f in found], batch.schema.field("conv").type)]
            columns += [pa.array([f[1][k] for f in found], pa.int64()) for k in range(6)] + [pa.array([f[1][6] for f in found], pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=["conv", *ANSWER, "audit"])

        for batch in batches:
            found = []
            for conv, turn, gone, initial, end, name in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "gone", "initial", "end", "name"))):
                if held is None or (conv,) != now:
                    if held is not None:
                        found.append((now[0], held.answer()))
                    held, now = _Conversation(), (conv,)
                if not gone:
                    held.add(turn, initial, end, name)
            yield out(found)
        if held is not None:
            yield out([(now[0], held.answer())])

    sorted_rows = narrow.repartition("conv").sortWithinPartitions(*order)
    return sorted_rows.select("conv", "turn", "gone", "initial", "end", "name").mapInArrow(
        run, f"conv {kind}, " + ", ".join(f"{c} long" for c in ANSWER) + ", audit string")


class _Writer:
    """Hashes the repaired rows of one conversation as its damaged rows pass."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.hash, self.empty = audit, 0, NONE, hashlib.sha256(), True

    def write(self, role: str, text: str) -> None:
        self.hash.update((("" if self.empty else "\n") + role + ":" + text).encode())
        self.empty = False
        self.state = WRITES[role[0]][self.state]

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.write(MADE[self.state], "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter != "D":
            self.write(role if letter == "K" else MADE[self.state], text)

    def answer(self) -> str:
        self.inserts()
        return self.hash.hexdigest()


def repair(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation id: ``id_col, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    Rows are damaged first (``damaged``).  Rows of one turn are ordered by role, then by the SHA-256 of the text before the damage;
    a repeated row stands behind its original.  Null turns come first; a null id is an id like any other; null
    role and text are one space each.  A row that is repeated in full is a duplicate fault.  Other
    columns are not read.  An empty table gives an empty result."""
    ws = Workspace(turns.sparkSession, "repair")
    rows = ws.keep(damaged(turns, id_col, turn_col, role_col, text_col), "rows")
    found = ws.keep(audits(rows), "audits")
    nothing = {"turn": rows.schema["turn"].dataType, "place": rows.schema["place"].dataType, "copy": rows.schema["copy"].dataType, "role": "string"}
    heads = found.select("conv", F.lit(0).alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()], F.col("audit").alias("text"), *ANSWER)
    texts = rows.where(~F.col("gone")).select("conv", F.lit(1).alias("kind"), *nothing, "text", *[F.lit(None).cast("long").alias(c) for c in ANSWER])
    stream = heads.unionByName(texts).repartition("conv").sortWithinPartitions("conv", "kind", "turn", "place", "copy")
    kind = rows.schema["conv"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        held = head = None

        def out(done):
            columns = [pa.array([d[0][0] for d in done], batch.schema.field("conv").type)]
            columns += [pa.array([d[0][1 + k] for d in done], pa.int64()) for k in range(6)]
            columns += [pa.array([d[1].audit for d in done], pa.string()), pa.array([d[1].answer() for d in done], pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=["conv", *ANSWER, "audit", "repaired_sha256"])

        for batch in batches:
            done = []
            for conv, part, role, text, *numbers in zip(*(batch.column(c).to_pylist() for c in ("conv", "kind", "role", "text", *ANSWER))):
                if part == 0:
                    if held is not None:
                        done.append((head, held))
                    held, head = _Writer(text), (conv, *numbers)
                else:
                    held.row(role, text)
            yield out(done)
        if held is not None:
            yield out([(head, held)])

    made = stream.select("conv", "kind", "role", "text", *ANSWER).mapInArrow(
        run, f"conv {kind}, " + ", ".join(f"{c} long" for c in ANSWER) + ", audit string, repaired_sha256 string")
    return made.withColumnRenamed("conv", id_col)
