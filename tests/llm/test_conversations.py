"""Conversation repair against a search over all edit sequences."""

import hashlib
import heapq
import random
import zlib

from epilake.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, cost string, audit long"


def brute(rows):
    """Cheapest (cost, audit, repaired) by a search over edits in order of cost and audit; rows: (role, text, fault)."""
    queue = [(0, "", 0, 0, ())]  # cost, audit, rows read, goal state, repaired
    while queue:
        cost, audit, i, state, done = heapq.heappop(queue)
        if i == len(rows) and state in (0, 3):  # nothing, or behind an assistant turn
            return cost, audit, done
        if sum(c == "I" for c in audit) < 2 * len(rows) + 2:
            role = "assistant" if state == 2 else "user"
            heapq.heappush(queue, (cost + 3, audit + "I", i, 3 if state == 2 else 2, (*done, (role, ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(queue, (cost + 4, audit + "D", i + 1, state, done))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault == "truncated" else 0
            if role[:1] == "s" and state == 0:
                heapq.heappush(queue, (cost + more, audit + "K", i + 1, 1, (*done, (role, text))))
            goal = "assistant" if state == 2 else "user"
            to = 3 if state == 2 else 2
            if role[:1] == goal[0]:
                heapq.heappush(queue, (cost + more, audit + "K", i + 1, to, (*done, (role, text))))
            heapq.heappush(queue, (cost + more + 3, audit + "R", i + 1, to, (*done, (goal, text))))


def plain(table):
    """The contract's columns of all conversations, one by one."""
    out = {}
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in (r[:4] for r in table if r[0] == conv):
            k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if k == 1 else text.translate({ord(c): None for c in ".!?"}) if k == 2 else text
            rows += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, marked = set(), []
        for _, role, text in rows:
            words = text.strip(C.SPACE)
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        initials = [r[0][:1] or " " for r in marked]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, done = brute(marked)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest()
        out[conv] = (gaps, *[sum(r[2] == f for r in marked) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha)
    return out


def _table(seed=3):
    rng = random.Random(seed)
    rows = []
    for conv in range(150):
        for turn in range(rng.randint(1, 6)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None])
            text = rng.choice(["Yes.", "no end", "", None, " \t", "Why?", "a", "b!", "né.", "x\x85", "Yes.\n "])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 4, None]), role, text, "c", 1))
    rows += [(None, 1, "user", "hi.", "c", 1), (None, None, "assistant", "yo.", "c", 1), (900, None, "user", "a.", "c", 1)]
    rows += [(901, 5, "user", "same.", "c", 1)] * 3
    rng.shuffle(rows)
    return rows


def test_against_search(spark):
    rows = _table()
    got = C.repair(C.damaged(spark.createDataFrame(rows, SCHEMA))).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == plain(rows)
    assert len(got) == len({r[0] for r in rows})


def test_dropped_conversations_and_empty_table(spark):
    gone = [c for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    got = C.repair(C.damaged(spark.createDataFrame([(c, 0, "user", "Hi.", "", 0) for c in gone], SCHEMA))).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted(tuple(r) for r in got) == [(c, 0, 0, 0, 0, 0, 0, "", empty) for c in gone]
    assert C.repair(C.damaged(spark.createDataFrame([], SCHEMA))).collect() == []


def _long(rows):
    long = C.Long()
    for kind, role, text in rows:
        long.row(kind, role, text)
    return long.end()


def test_long_form_gives_the_same_edits():
    rng = random.Random(8)
    for size in [*range(9)] * 40 + [20, 30, 45, 60]:
        kinds = "".join(rng.choice("uuaaUAsSxX!") for _ in range(size))
        roles = [{"u": "user", "a": "assistant", "s": "system"}.get(k.lower(), "tool") for k in kinds]
        texts = [f"t{i % 3}" for i in range(size)]
        cost, audit = C.align_lengths(kinds)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in C.apply(audit, roles, texts)).encode()).hexdigest()
        assert _long(zip(kinds, roles, texts)) == (cost, audit, sha), kinds


def test_long_conversations_stream(spark):
    """A conversation of thousands of turns and one of few, very long texts beside short ones."""
    rng = random.Random(4)
    rows = [(7, t, rng.choice(["user", "assistant"]), f"turn {t}.", "", 0) for t in range(5000)]
    rows += [(8, t, ["user", "assistant"][t % 2], f"{t} " + "long text " * 300_000 + ".", "", 0) for t in range(4)]
    rows += [(9, 0, "user", "Hi.", "", 0), (9, 1, "assistant", "Hello.", "", 0)]
    got = {r.conv_id: r for r in C.repair(C.damaged(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert set(got) == {7, 8, 9}
    r = got[7]
    roles = []
    for t in range(5000):
        k = zlib.crc32(f"7:{t}".encode()) % 20
        roles += ["" if k == 0 else "!" if k == 1 else "u" if k == 4 else rows[t][2][0]][:k != 0] + ["!"] * (k == 3)
    assert sum(c != "I" for c in r.audit) == len(roles) and r.blank + r.duplicate == roles.count("!")
    assert len([c for c in r.audit if c != "D"]) % 2 == 0
    assert r.cost == 3 * r.audit.count("R") + 4 * r.audit.count("D") + 3 * r.audit.count("I") + 3 * _kept_truncated(r.audit, rows[:5000])


def _kept_truncated(audit, rows):
    """Rows without an end mark (fault 2) that stay."""
    damaged = []
    for _, t, *_ in rows:
        k = zlib.crc32(f"7:{t}".encode()) % 20
        damaged += [k] * (0 if k == 0 else 2 if k == 3 else 1)
    return sum(k == 2 and c != "D" for k, c in zip(damaged, audit.replace("I", "")))


def test_whole_table_against_search(spark):
    from conftest import SF_SMALL
    from epilake.llm.tables import read_table
    rows = [tuple(r) for r in read_table(spark, SF_SMALL, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = C.op12_conversations(spark, SF_SMALL).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == plain(rows)
