import hashlib
import random
import zlib

import pytest

from pixelloom.llm import convrepair as R
from pixelloom.llm import queries

BLANK = " \t\n\x0b\x0c\r"
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NAME = {"u": "user", "a": "assistant"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 0:
            continue
        text = "" if k == 1 else "".join(c for c in text if c not in ".!?") if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def report(rows):
    """What one conversation comes to, by trying every edit from the end; rows have been damaged."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        t = text.strip(BLANK)
        faults.append(1 if not t else 2 if (role, text) in seen else 3 if t[-1] not in ".!?" else 0)
        seen.add((role, text))
    best = {0: (0, "", []), 3: (0, "", []), 2: (3, "I", ["assistant:"]), 1: (6, "II", ["user:", "assistant:"])}
    for (_, _, role, text), fault in zip(reversed(rows), reversed(faults), strict=True):
        base = {}
        for q in range(4):
            ways = [(best[q][0] + 4, "D" + best[q][1], best[q][2])]
            if fault not in (1, 2):
                for e, letter, line, c in [("R", x, f"{NAME[x]}:{text}", 3) for x in "ua"] + [("K", role[:1], f"{role}:{text}", 0)]:
                    if (q, letter) in STEP:
                        b = best[STEP[q, letter]]
                        ways.append((c + (3 if fault == 3 else 0) + b[0], e + b[1], [line] + b[2]))
            base[q] = min(ways)
        for _ in range(3):
            for q in range(4):
                for x in "ua":
                    if (q, x) in STEP:
                        b = base[STEP[q, x]]
                        base[q] = min(base[q], (3 + b[0], "I" + b[1], [NAME[x] + ":"] + b[2]))
        best = base
    turns = [r[1] for r in rows if r[1] is not None]
    i = [r[2][:1] for r in rows]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(i, i[1:], strict=False))
    cost, audit, lines = best[0]
    return gaps, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def truth(table):
    out = {r[0]: [] for r in table}
    for r in damage(table):
        out[r[0]].append(r)
    return {k: report(v) for k, v in out.items()}


def table(seed, conversations=60):
    rng, out = random.Random(seed), []
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \n", None, "Yes. ", "A. b", "x", "ends.\x0b", "é"]
    for c in range(conversations):
        for t in range(rng.choice([1, 2, 3, 5, 8, 30])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "umpire", "", None])
            out.append((c if c else None, rng.choice([t, t, t, t + 3, None]), role, rng.choice(texts) if rng.random() < 0.7 else f"text {c} {t}."))
            if rng.random() < 0.1:
                out.append(out[-1])
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_matches_brute_force(spark, block):
    rows = table(block)
    t = spark.createDataFrame(rows, SCHEMA).withColumn("times", R.F.lit("clash")).repartition(3)
    got = {r[0]: tuple(r)[1:] for r in R.repaired(t, R.damaged(t), block).collect()}
    want = truth(rows)
    assert got.keys() == want.keys()
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}


def test_one_long_conversation_in_blocks(spark, tmp_path):
    rng = random.Random(5)
    rows = [(7, i, rng.choice(["user", "assistant", "system"]), rng.choice(["same.", f"text {i}.", f"cut {i}", ""])) for i in range(3000)]
    rows += [(8, 1, "user", "again.")] * 50 + [(9, None, None, None)]
    t = spark.createDataFrame(rows, SCHEMA)
    got = {r[0]: tuple(r)[1:] for r in R.repaired(t, R.damaged(t), 100).collect()}
    assert got == truth(rows)
    t.write.parquet(str(tmp_path / "conversations.parquet"))
    assert {r[0]: tuple(r)[1:] for r in queries.op12_conversation_repair(spark, str(tmp_path)).collect()} == got


def test_meeting_in_the_middle_is_the_least_of_all_edits():
    rng = random.Random(1)
    for _ in range(400):
        rows = [(0, i, rng.choice("sua") + "x", rng.choice([f"a{i}.", f"a{i}.", f"b{i}", "same.", ""])) for i in range(rng.randrange(0, 12))]
        seen, units = set(), []
        for _, _, role, text in rows:
            fault = 1 if not text else 2 if (role, text) in seen else 3 if text[-1] != "." else 0
            seen.add((role, text))
            units.append(R.unit(role[0], fault in (1, 2), fault == 3))
        assert R.audit(units) == report(rows)[6]


def test_empty_and_vanished(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert R.repaired(empty, R.damaged(empty)).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    t = spark.createDataFrame([(gone, 0, "user", "Hello.")], SCHEMA)
    assert tuple(R.repaired(t, R.damaged(t)).first()) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    kept = R.repaired(t).first()  # as given, without damage
    assert kept.audit == "D" and kept.cost == 4 or kept.audit == "KI"
