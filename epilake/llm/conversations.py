"""Repair of the turn structure of conversations: Wagner-Fischer alignment with the role grammar.

A sound conversation reads `(s?(ua)+)?` in role initials: nothing, or user and
assistant in turn behind an optional system turn. So for every length but 1 there
is exactly one target string: even lengths have no system turn, odd ones have one.

Edits of a row: Keep (0), Rerole to user or assistant (3), Delete (4); between rows
an empty user or assistant turn is Inserted (3). A truncated row that stays adds 3.
Blank rows and duplicates must go. The cheapest edits win; of equally cheap ones
those whose initials (the audit) come first in ASCII.

`align_lengths` aligns the rows with the target of each length in a Wagner-Fischer
table. Lengths nearest the number of rows that may stay come first; the incumbent
(the cheapest edits so far, at first the deletion of all rows) bounds each table to
Ukkonen's band: a cell is left out if the deletions or insertions that its distance
from the diagonal costs, with those that lead from it to the corner, exceed it. A
length whose band is empty has no table. Audits are read off by a walk that takes
the first initial of each cheapest path, and compared over the lengths.

Conversations of more than TABLE_TURNS turns or TABLE_BYTES bytes are aligned by `Long`, row by row as they
stream by: cells of one column parity and of all lengths are one state there, so
four states hold everything. It gives the same edits (tests compare the two) and
keeps 1 byte of audit and 16 of digest a turn, no texts. All rows of a conversation
go through one task, as its result is one row with a digest over all its texts; they
are sorted by Spark, which spills, and are never gathered.

Edge cases: a null role or text is one space; an empty role has a space as its
initial, so it fits nowhere. Null conv_ids are one conversation. Rows of one turn
(nulls first) are ordered by role, then text; the damage of a row is a function of
conv_id and turn, so these rows share it. Repeated rows count as duplicates. An
empty table gives no row; columns beyond the four are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epilake.llm.tables import partitions, read_table

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SPACE = "\x20\t\n\x0b\x0c\r"
#: Turns and bytes up to which a conversation is held as a whole and aligned in tables.
TABLE_TURNS, TABLE_BYTES = 64, 1 << 22
#: Alignments a worker remembers, by the initials and faults of the rows.
MEMO = 50_000
ROLE = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
_FAR = 1 << 60


def target(length: int) -> str:
    """The grammar's string of that length; there is none of length 1."""
    return "s" * (length % 2) + "ua" * (length // 2)


def _table(rows: str, goal: str, limit: int):
    """Costs of turning the rows from i on into the goal from j on, as (begin, costs) for each i: the cells in
    the band of `limit`. None if the corner is out of it.

    rows: an initial for each row, in upper case if it is truncated, `!` if it must go.
    """
    n, m = len(rows), len(goal)

    def bound(gap):  # least cost of a distance between remaining goal and remaining rows
        return INSERT * gap if gap > 0 else -DELETE * gap

    if bound(m - n) > limit:
        return None
    table: list = [None] * (n + 1)
    for i in range(n, -1, -1):
        # j - i deletions or insertions so far, and (m - j) - (n - i) to come
        begin = max(0, i - limit // DELETE)
        end = min(m, i + limit // INSERT)
        while begin <= end and bound(begin - i) + bound((m - begin) - (n - i)) > limit:
            begin += 1
        while end >= begin and bound(end - i) + bound((m - end) - (n - i)) > limit:
            end -= 1
        costs = [_FAR] * (end - begin + 1)
        at, below = table[i + 1] if i < n else (0, [])
        c = rows[i] if i < n else "!"
        own = c.lower()
        extra = TRUNCATED if c != own else 0
        for j in range(end, begin - 1, -1):
            if i == n and j == m:
                costs[j - begin] = 0
                continue
            best = _FAR
            if i < n and at <= j < at + len(below):
                best = DELETE + below[j - at]
            if j < m:
                g = goal[j]
                if g != "s" and j < end:
                    best = min(best, INSERT + costs[j + 1 - begin])
                if c != "!" and at <= j + 1 < at + len(below) and (own == g or g != "s"):
                    best = min(best, extra + (0 if own == g else REROLE) + below[j + 1 - at])
            costs[j - begin] = best
        table[i] = (begin, costs)
    return table


def _walk(rows: str, goal: str, table) -> str:
    """The first audit in ASCII of the cheapest paths of a table."""
    n, m, i, j, audit = len(rows), len(goal), 0, 0, []

    def cost(i, j):
        at, costs = table[i]
        return costs[j - at] if at <= j < at + len(costs) else _FAR

    while i < n or j < m:
        left = cost(i, j)
        c = rows[i] if i < n else "!"
        own = c.lower()
        extra = TRUNCATED if c != own else 0
        if i < n and DELETE + cost(i + 1, j) == left:
            audit.append("D")
            i += 1
        elif j < m and goal[j] != "s" and INSERT + cost(i, j + 1) == left:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if own == goal[j] else "R")
            assert left == extra + (0 if own == goal[j] else REROLE) + cost(i + 1, j + 1)
            i, j = i + 1, j + 1
    return "".join(audit)


def align_lengths(rows: str) -> tuple[int, str]:
    """Cost and audit of the cheapest edits over all feasible lengths."""
    n = len(rows)
    best = (DELETE * n, "D" * n)  # length 0
    stay = n - rows.count("!")
    # a longer goal than this only adds insertions to all rows that stay
    lengths = [m for m in range(2, n + DELETE * n // INSERT + 1)]
    lengths.sort(key=lambda m: (abs(m - stay), m))
    for m in lengths:
        least = DELETE * (n - stay) + (INSERT * (m - stay) if m > stay else DELETE * (stay - m))
        if least > best[0]:
            continue
        goal = target(m)
        table = _table(rows, goal, best[0])
        if table is None or table[0][0] > 0 or not table[0][1] or table[0][1][0] > best[0]:
            continue
        best = min(best, (table[0][1][0], _walk(rows, goal, table)))
    return best


def apply(audit: str, roles: list[str], texts: list[str]) -> Iterator[tuple[str, str]]:
    """The repaired (role, text) of an audit."""
    size = sum(c != "D" for c in audit)
    goal, i, j = target(size), 0, 0
    for c in audit:
        if c == "I":
            yield ROLE[goal[j]], ""
        elif c != "D":
            yield (roles[i] if c == "K" else ROLE[goal[j]]), texts[i]
        i += c != "I"
        j += c != "D"


class _Digest:
    """SHA-256 of `role:text` lines joined by newlines."""

    def __init__(self):
        self.sha, self.any = hashlib.sha256(), False

    def add(self, role: str, text: str) -> _Digest:
        self.sha.update((f"\n{role}:" if self.any else f"{role}:").encode())
        self.sha.update(text.encode())
        self.any = True
        return self

    def copy(self) -> _Digest:
        new = _Digest()
        new.sha, new.any = self.sha.copy(), self.any
        return new


class Long:
    """Alignment with all lengths at once, a row at a time.

    A state is what the goal's string can be behind the last edit: nothing yet (0), a system turn (s), a user
    turn (u), an assistant turn (a). Of the edits that lead to a state the cheapest with the first audit stays;
    what all states' audits share is kept once.
    """

    def __init__(self):
        self.shared: list[str] = []
        self.states: dict[str, tuple[int, str, _Digest]] = {"0": (0, "", _Digest())}
        self._inserted()

    def _put(self, states, name, cost, audit, digest, role, text):
        if name not in states or (cost, audit) < states[name][:2]:
            states[name] = (cost, audit, digest, role, text)

    @staticmethod
    def _done(states):
        return {k: (c, a, d.copy().add(role, text) if role is not None else d) for k, (c, a, d, role, text) in states.items()}

    def _inserted(self) -> None:
        """Insertions behind the present row; two in a row can be the way to a state."""
        for _ in range(2):
            new = {k: (c, a, d, None, None) for k, (c, a, d) in self.states.items()}
            for k, (c, a, d) in self.states.items():
                to = "a" if k == "u" else "u"
                self._put(new, to, c + INSERT, a + "I", d, ROLE[to], "")
            self.states = self._done(new)
        c_a = self.states["a"][0]
        # a system turn or nothing yet allows no more than an assistant turn does, but for a system turn to keep
        for k, more in (("s", 0), ("0", DELETE)):
            if k in self.states and self.states[k][0] > c_a + more:
                del self.states[k]
        head = os.path.commonprefix([a for _, a, _ in self.states.values()])
        if head:
            self.shared.append(head)
            self.states = {k: (c, a[len(head):], d) for k, (c, a, d) in self.states.items()}

    def row(self, kind: str, role: str, text: str) -> None:
        own = kind.lower()
        extra = TRUNCATED if kind != own else 0
        new: dict = {}
        for k, (c, a, d) in self.states.items():
            self._put(new, k, c + DELETE, a + "D", d, None, None)
            if kind == "!":
                continue
            if k == "0" and own == "s":
                self._put(new, "s", c + extra, a + "K", d, role, text)
            to = "a" if k == "u" else "u"
            if own == to:
                self._put(new, to, c + extra, a + "K", d, role, text)
            else:
                self._put(new, to, c + extra + REROLE, a + "R", d, ROLE[to], text)
        self.states = self._done(new)
        self._inserted()

    def end(self) -> tuple[int, str, str]:
        cost, audit, digest = min((self.states[k] for k in "0a" if k in self.states), key=lambda s: s[:2])
        return cost, "".join(self.shared) + audit, digest.sha.hexdigest()


class _Conversation:
    """Counts of one conversation and the kinds of its rows, fed in order."""

    memo: OrderedDict[str, tuple[int, str]] = OrderedDict()

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.least = self.most = self.last_turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.seen: set[bytes] = set()
        self.before = None
        self.kinds, self.roles, self.texts, self.bytes = [], [], [], 0
        self.long = None

    def add(self, turn, role: str, text: str) -> None:
        if turn is not None:
            if self.least is None:
                self.least = turn
            if turn != self.last_turn:
                self.turns += 1
            self.most = self.last_turn = turn
        initial = role[:1] or " "
        if self.before is not None and self.before + initial not in LEGAL:
            self.illegal += 1
        self.before = initial
        digest = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        body = text.rstrip(SPACE)
        kind = initial if initial in "sua" else "?"
        if not body:
            self.blank += 1
            kind = "!"
        elif digest in self.seen:
            self.duplicate += 1
            kind = "!"
        elif body[-1] not in ".!?":
            self.truncated += 1
            kind = kind.upper() if kind != "?" else "X"
        elif kind == "?":
            kind = "x"
        self.seen.add(digest)
        if self.long:
            self.long.row(kind, role, text)
            return
        self.kinds.append(kind)
        self.roles.append(role)
        self.texts.append(text)
        self.bytes += len(text)
        if len(self.kinds) > TABLE_TURNS or self.bytes > TABLE_BYTES:
            self.long = Long()
            for row in zip(self.kinds, self.roles, self.texts):
                self.long.row(*row)
            self.kinds, self.roles, self.texts = [], [], []

    def result(self) -> tuple:
        gaps = self.most - self.least + 1 - self.turns if self.least is not None else 0
        if self.long:
            cost, audit, sha = self.long.end()
        else:
            cost, audit = self.aligned("".join(self.kinds))
            digest = _Digest()
            for role, text in apply(audit, self.roles, self.texts):
                digest.add(role, text)
            sha = digest.sha.hexdigest()
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, sha

    @classmethod
    def aligned(cls, kinds: str) -> tuple[int, str]:
        got = cls.memo.get(kinds)
        if got is None:
            got = cls.memo[kinds] = align_lengths(kinds)
            if len(cls.memo) > MEMO:
                cls.memo.popitem(last=False)
        return got


NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string")
_ARROW = [*[pa.int64()] * 7, pa.string(), pa.string()]


def _repair_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of conversation and turn; a conversation may span batches."""
    now, out = None, []

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _ARROW)], NAMES)

    for batch in batches:
        for conv_id, turn, role, text, gone in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "gone"))):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    out.append(now.result())
                now = _Conversation(conv_id)
            if not gone:
                now.add(turn, role, text)
            if len(out) >= 1000:
                yield flush()
                out = []
    if now is not None:
        out.append(now.result())
    if out:
        yield flush()


def damaged(rows: DataFrame) -> DataFrame:
    """The rows with the faults that crc32 of `conv_id:turn` plants; `gone` rows stay as marks of their conversation."""
    def text(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"),
                       text("text").alias("text"), fault.alias("fault"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("fault") == 0).alias("gone"),
        F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def repair(rows: DataFrame) -> DataFrame:
    """One row a conversation: faults, cost, audit and digest of the repaired turns.

    rows: conv_id, turn, role, text, gone (no turn, a mark that the conversation exists).
    """
    laid = rows.repartition(partitions(rows.sparkSession), "conv_id")
    return laid.sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_repair_partition, SCHEMA)


def op12_conversations(spark, sf_dir: str) -> DataFrame:
    return repair(damaged(read_table(spark, sf_dir, "conversations")))
