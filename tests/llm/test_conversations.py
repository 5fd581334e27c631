import hashlib
import itertools
import random
import re
import zlib

import pytest

from motionfield.llm import conversations as C
from motionfield.llm.conversations import cheapest_edits, conversation_report, damaged, edited, repair, row_faults

BLANKS = " \t\n\x0b\x0c\r"


def best_edits(roles, faults):
    """By dynamic programming forward over states: (cost, edits) least in both, in that order."""
    keeps = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    wanted = {"": "u", "s": "u", "u": "a", "a": "u"}

    def inserted(at):
        out = dict(at)
        for _ in range(4):
            for s, (c, e) in list(out.items()):
                new = (c + 2, e + "I")
                if wanted[s] not in out or new < out[wanted[s]]:
                    out[wanted[s]] = new
        return out

    at = {"": (0, "")}
    for role, fault in zip(roles, faults, strict=True):
        new = {}
        for s, (c, e) in inserted(at).items():
            tries = [(s, c + 3, e + "D")]
            if fault in "-t":
                more = fault == "t"
                tries += [(keeps[s][role[:1]], c + more, e + "K")] if role[:1] in keeps[s] else []
                tries += [(wanted[s], c + 2 + more, e + "R")]
            for to, cost, edits in tries:
                if to not in new or (cost, edits) < new[to]:
                    new[to] = (cost, edits)
        at = new
    return min(v for s, v in inserted(at).items() if s in ("", "a"))


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, [])
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if d:
            text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
            convs[conv] += [(turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    out = []
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        roles, texts = [r[1] for r in own], [r[2] for r in own]
        faults = "".join("b" if not t.strip(BLANKS) else "d" if (r, t) in zip(roles[:k], texts[:k], strict=True) else "-" if t.strip(BLANKS)[-1] in ".!?" else "t" for k, (r, t) in enumerate(zip(roles, texts, strict=True)))
        cost, audit = best_edits(roles, faults)
        turns = {r[0] for r in own} - {None}
        fixed, k, state = [], 0, ""
        for e in audit:
            want = {"": "user", "s": "user", "u": "assistant", "a": "user"}[state]
            role = want if e in "IR" else roles[k]
            if e != "D":
                fixed.append(f"{role}:{'' if e == 'I' else texts[k]}")
                state = role[:1]
            k += e != "I"
        assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in fixed))
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(roles))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((repr(conv), gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(fixed).encode()).hexdigest()))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, part int, cv string").repartition(3)


def run(spark, rows, **kw):
    return sorted((repr(r[0]), *r[1:]) for r in map(tuple, conversation_report(frame(spark, rows), **kw).collect()))


def made(rng, convs, longest):
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "User", "unknown", "", None]) if rng.random() < 0.4 else ("user", "assistant")[t % 2]
            text = rng.choice(["", " \t\n", "yes.", "no", "why? ", "ok!\x0b", "ça", None, f"{rng.random()}."])
            rows.append((c, t + (t > 3) * rng.randint(0, 2) if rng.random() < 0.95 else None, role, text))
    return rows


@pytest.mark.parametrize("block", [3, 128])
def test_against_brute_force(spark, block):
    rng = random.Random(block)
    rows = made(rng, 60, 9) + made(random.Random(9), 1, 300) + [(900, None, None, None), (900, None, "user", "x."), (None, 1, "user", "a."), (None, None, "assistant", "b"), (901, 5, "user", "z" * 300_000 + ".")]
    rows += [(902, k % 7, "user", "the same.") for k in range(40)]
    got = run(spark, rows, block=block)
    assert got == brute(rows) and len(got) == 64


def test_all_rows_dropped_and_empty_tables(spark):
    gone = [(c, t) for c in range(300) for t in range(20) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    rows = [(c, t, "user", "hello.") for c, t in gone if sum(g[0] == c for g in gone) == 1][:20]
    want = [(repr(c), 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in {r[0] for r in rows}]
    assert run(spark, rows) == sorted(want) == brute(rows)
    assert run(spark, []) == []


def test_search_equals_dynamic_programming():
    rng = random.Random(1)
    for n in [*range(9)] * 60 + [40, 80]:
        roles = [rng.choice(["user", "assistant", "system", "x"]) for _ in range(n)]
        faults = "".join(rng.choice("--tbd") for _ in range(n))
        edits, cost = cheapest_edits([r[:1] for r in roles], faults)
        assert (cost, edits) == best_edits(roles, faults)
        assert edited(edits, roles, [""] * n, faults)[2:] [0] == cost


def test_first_fault_of_each_row():
    roles, texts = ["user", "user", "user", "assistant", "user", "user"], ["a", "a", "", "a", "b.\r\n", " \x0b"]
    assert row_faults(roles, texts) == "tdbt-b"
    assert row_faults(roles, texts, {4}) == "ttbtdb"


def test_pieces_are_the_repaired_rows(spark):
    rows = [(1, 0, "system", "rules."), (1, 1, "user", "a."), (1, 2, "user", "b"), (2, 0, "assistant", "x.")]
    rows = [r for r in rows if zlib.crc32(f"{r[0]}:{r[1]}".encode()) % 20 > 4]
    pieces = repair(damaged(frame(spark, rows)), block=1).orderBy("cv", "part", "idx").collect()
    for c in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == c]
        faults = row_faults([r[2] for r in own], [r[3] for r in own])
        edits, _ = cheapest_edits([r[2][:1] for r in own], faults)
        want = edited(edits, [r[2] for r in own], [r[3] for r in own], faults)
        got = [p for p in pieces if p.conv_id == c]
        assert [x for p in got for x in p.roles] == want[0] and [x for p in got for x in p.texts] == want[1] and "".join(p.audit for p in got) == edits
    assert C.BLOCK * 4 < 900  # the search's depth stays below Python's limit
