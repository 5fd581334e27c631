"""Conversation structure repair by iterative-deepening A*.

A conversation's rows are edited (kept, given another role, deleted, or
preceded by an inserted empty row) until its roles read system (at most one,
first), then user and assistant in turn.  The cheapest edits are found by a
depth-first search in ASCII order of the edits' initials under a growing bound
on the cost; a table of failed states holds what is known of the cost still to
come from each.  The first path that is accepted is the answer.

Rows are range-partitioned by conversation and turn, so a conversation of any
length is shared by tasks.  One that lies within a block is repaired where it
is read.  Of others each block is summed up as a small table (least cost from
each state to each), the tables are folded from the end as a stream, each
block is searched with the cost to come behind it, and a stream from the front
picks the path of the state it arrives in.  An inserted row belongs to the
block of the row it precedes, so no path within a block is a prefix of
another, and the ASCII-least path is the chain of the blocks' ASCII-least ones.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, partitions

#: Fixed: white space, ends of sentences, costs.
BLANKS, ENDS = " \t\n\x0b\x0c\r", ".!?"
REROLE, DELETE, INSERT, OPEN = 2, 3, 2, 1
#: The role reached so far; conversations may end at the start (nothing left) or after an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
KEEPS = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
#: The one role that may be put in at each state.
WANTED = [USER, USER, ASSISTANT, USER]
ROLE = {USER: "user", ASSISTANT: "assistant"}
NEVER = 1 << 40
END = [0, NEVER, NEVER, 0]
#: Most rows and bytes of text of a block.
BLOCK, BLOCK_BYTES = 128, 4 << 20


def row_faults(roles: list[str], texts: list[str], repeated: set[int] | None = None) -> str:
    """The first fault of each row: b(lank), d(uplicate), t(runcated) or '-'; ``repeated`` are the places of duplicates, looked for here where it is None."""
    out, seen = [], set()
    for k, (role, text) in enumerate(zip(roles, texts, strict=True)):
        said = text.rstrip(BLANKS)
        again = k in repeated if repeated is not None else (role, text) in seen
        out.append("b" if not said else "d" if again else "-" if said[-1] in ENDS else "t")
        seen.add((role, text))
    return "".join(out)


def moves(state: int, initial: str, fault: str):
    """(edit, cost, new state) of the edits that use up a row, in ASCII order without the insertion between D and K."""
    yield "D", DELETE, state
    if fault in "-t":
        more = OPEN if fault == "t" else 0
        if initial in KEEPS[state]:
            yield "K", more, KEEPS[state][initial]
        yield "R", REROLE + more, WANTED[state]


def cheapest_edits(initials: list[str], faults: str, start: int = START, goal: list[int] = END, last: bool = True) -> tuple[str, int]:
    """(edits, cost with the goal's): the ASCII-least of the cheapest edits from ``start`` to a state that costs ``goal`` more."""
    n = len(faults)
    least = [min(goal)] * (n + 1)
    for i in range(n - 1, -1, -1):
        least[i] = least[i + 1] + {"b": DELETE, "d": DELETE, "t": min(OPEN, DELETE), "-": 0}[faults[i]]
    failed: dict[tuple[int, int], int] = {}
    path: list[str] = []

    def fits(i: int, state: int, left: int) -> int:
        """0 if ``left`` is enough, else the least cost to come that is known now."""
        known = failed.get((i, state), least[i])
        if known > left:
            return known
        if i == n and goal[state] <= left:
            return 0
        # while the state is open it counts as failed: a way round to it is never cheapest
        failed[i, state] = left + 1
        best = goal[state] if i == n else NEVER
        steps = [(edit, cost, i + 1, to) for edit, cost, to in moves(state, initials[i], faults[i])] if i < n else []
        if i < n or last:
            steps.insert(1, ("I", INSERT, i, WANTED[state]))
        for edit, cost, j, to in steps:
            path.append(edit)
            more = fits(j, to, left - cost)
            if not more and left >= cost:
                return 0
            path.pop()
            best = min(best, cost + more)
        failed[i, state] = max(best, left + 1)
        return failed[i, state]

    bound = least[0]
    while more := fits(0, start, bound):
        bound = more
    return "".join(path), bound


def edited(edits: str, roles: list[str], texts: list[str], faults: str, state: int = START) -> tuple[list[str], list[str], int, int]:
    """(roles, texts, cost, end state) after the edits."""
    out_roles, out_texts, cost, k = [], [], 0, 0
    for edit in edits:
        if edit == "I":
            state, cost = WANTED[state], cost + INSERT
            out_roles.append(ROLE[state]), out_texts.append("")
            continue
        for name, c, to in moves(state, roles[k][:1], faults[k]):
            if name == edit:
                cost, state = cost + c, to
        if edit != "D":
            out_roles.append(ROLE[state] if edit == "R" else roles[k]), out_texts.append(texts[k])
        k += 1
    return out_roles, out_texts, cost, state


def transfer(initials: list[str], faults: str) -> list[int]:
    """Least cost of a block from each state to each, row after row."""
    out = []
    for start in range(4):
        costs = [NEVER] * 4
        costs[start] = 0
        for initial, fault in zip(initials, faults, strict=True):
            for _ in range(3):
                for s in range(4):
                    costs[WANTED[s]] = min(costs[WANTED[s]], costs[s] + INSERT)
            new = [NEVER] * 4
            for s in range(4):
                for _, c, to in moves(s, initial, fault):
                    new[to] = min(new[to], costs[s] + c)
            costs = new
        out += costs
    return out


def behind(table: list[int], goal: list[int], last: bool) -> list[int]:
    """The cost to come before a block from that behind it."""
    if last:  # rows may be inserted after the last one
        goal = list(goal)
        for _ in range(3):
            goal = [min(goal[s], INSERT + goal[WANTED[s]]) for s in range(4)]
    return [min(NEVER, *(table[4 * s + q] + goal[q] for q in range(4))) for s in range(4)]


def damaged(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(cv, conv_id, turn, role, text, copies): rows damaged by crc32 of ``conv_id:turn`` modulo 20; a dropped row has 0 copies.  Nulls are one space in names and texts; a null turn stays null."""
    rows = conversations.select(
        F.col(conv_id).alias("conv_id"), F.coalesce(F.col(conv_id).cast("string"), F.lit(" ")).alias("cv"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(turn).cast("string"), F.lit(" ")).alias("t"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"),
    )
    rows = rows.withColumn("d", F.crc32(F.concat("cv", F.lit(":"), "t").cast("binary")) % 20)
    said = F.when(F.col("d") <= 1, "").when(F.col("d") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    return rows.select("cv", "conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"), said.alias("text"), F.when(F.col("d") == 0, 0).when(F.col("d") == 3, 2).otherwise(1).alias("copies"))


PIECE = [
    ("part", pa.int32()), ("idx", pa.int64()), ("whole", pa.bool_()), ("audit", pa.string()), ("cost", pa.int64()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
    ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("turn_min", pa.int64()), ("turn_max", pa.int64()), ("n_turns", pa.int64()),
]
PIECE_SCHEMA = (
    "part int, idx long, whole boolean, audit string, cost long, roles array<string>, texts array<string>, blank long, duplicate long, truncated long, illegal long, first string, last string, turn_min long, turn_max long, n_turns long"
)


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def _counts(faults: str) -> dict:
    return {"blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t")}


def _batches(rows, kinds, most: int = 512):
    """Arrow batches of dicts, small ones."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(map(len, r.get("texts") or ())) + 200
        if len(held) >= most or size > BLOCK_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array([x.get(n) for x in held], t) for n, t in kinds], [n for n, _ in kinds])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([x.get(n) for x in held], t) for n, t in kinds], [n for n, _ in kinds])


def _rows(batches):
    for b in batches:
        yield from b.to_pylist()


def _gather(block: int, id_kind):
    """Sorted rows to blocks; a conversation that ends within its first block, and isn't at an end of the partition, is repaired at once."""

    def blocks(batches, part):
        cv, conv_id, roles, texts, turns, size, cut, idx = None, None, [], [], [], 0, True, 0

        def close(whole: bool):
            nonlocal roles, texts, turns, size, idx
            initials, known = [r[:1] for r in roles], {t for t in turns if t is not None}
            out = {"cv": cv, "conv_id": conv_id, "part": part, "idx": idx, "whole": whole, "roles": roles, "texts": texts, "illegal": _illegal(initials), "first": initials[0] if roles else None, "last": initials[-1] if roles else None}
            out |= {"turn_min": min(known, default=None), "turn_max": max(known, default=None), "n_turns": len(known)}
            if whole:
                faults = row_faults(roles, texts)
                edits, _ = cheapest_edits(initials, faults)
                new_roles, new_texts, cost, _ = edited(edits, roles, texts, faults)
                out |= {"audit": edits, "cost": cost, "roles": new_roles, "texts": new_texts} | _counts(faults)
            roles, texts, turns, size, idx = [], [], [], 0, idx + 1
            return out

        for r in _rows(batches):
            if r["cv"] != cv:
                if cv is not None:
                    yield close(not cut)
                # of the first conversation a part may be in the partition before
                cut, cv, conv_id = cv is None, r["cv"], r["conv_id"]
            for _ in range(r["copies"]):
                if len(roles) >= block or size > BLOCK_BYTES:
                    cut = True
                    yield close(False)
                roles.append(r["role"]), texts.append(r["text"]), turns.append(r["turn"])
                size += len(r["text"])
        if cv is not None:
            yield close(False)

    def run(batches):
        from pyspark import TaskContext

        yield from _batches(blocks(batches, TaskContext.get().partitionId()), [("cv", pa.string()), ("conv_id", id_kind), *PIECE])

    return run


def _sum_up(batches):
    def rows():
        for r in _rows(batches):
            faults = row_faults(r["roles"], r["texts"], set(r["repeated"] or ()))
            yield {"cv": r["cv"], "part": r["part"], "idx": r["idx"], "faults": faults, "table": transfer([x[:1] for x in r["roles"]], faults)}

    yield from _batches(rows(), [("cv", pa.string()), ("part", pa.int32()), ("idx", pa.int64()), ("faults", pa.string()), ("table", pa.list_(pa.int64()))])


def _from_the_end(batches):
    """Blocks of each conversation, last one first: the cost to come behind each."""

    def rows():
        cv, goal = None, END
        for r in _rows(batches):
            last = r["cv"] != cv
            if last:
                cv, goal = r["cv"], END
            yield {"part": r["part"], "idx": r["idx"], "faults": r["faults"], "goal": goal, "final": last}
            goal = behind(r["table"], goal, last)

    yield from _batches(rows(), [("part", pa.int32()), ("idx", pa.int64()), ("faults", pa.string()), ("goal", pa.list_(pa.int64())), ("final", pa.bool_())])


def _from_the_front(id_kind):
    """Blocks of each conversation in order: each is searched from the state that the one before ended in."""

    def run(batches):
        def rows():
            cv, state = None, START
            for r in _rows(batches):
                if r["cv"] != cv:
                    cv, state = r["cv"], START
                edits = r["paths"][state]
                roles, texts, cost, state = edited(edits, r["roles"], r["texts"], r["faults"], state)
                yield r | {"audit": edits, "cost": cost, "roles": roles, "texts": texts} | _counts(r["faults"])

        yield from _batches(rows(), [("cv", pa.string()), ("conv_id", id_kind), *PIECE])

    return run


def _paths(names, kinds):
    def run(batches):
        def rows():
            for r in _rows(batches):
                initials = [x[:1] for x in r["roles"]]
                yield r | {"paths": [cheapest_edits(initials, r["faults"], s, r["goal"], r["final"])[0] for s in range(4)]}

        yield from _batches(rows(), [*zip(names, kinds, strict=True), ("paths", pa.list_(pa.string()))])

    return run


def repair(rows: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """(cv, conv_id, part, idx, whole, audit, cost, roles, texts, counts of faults ...): the repaired conversations in pieces, ordered by part and idx; ``whole`` pieces are conversations of their own.

    ``rows``: cv, conv_id, turn, role, text, copies, as by ``damaged``.  Rows
    of a conversation go by turn (nulls first), then by role and text.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark, kind = rows.sparkSession, rows.schema["conv_id"].dataType
    id_kind, head = to_arrow_type(kind), f"cv string, conv_id {kind.simpleString()}, "
    order = ["cv", "turn", "role", F.substring("text", 1, 64)]
    ranged = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order, "text")
    blocks = materialize(ranged.mapInArrow(_gather(block, id_kind), head + PIECE_SCHEMA), "conv-blocks")
    cut = blocks.filter("not whole")
    # duplicates of rows in other blocks: the first place of each role and text
    places = cut.select("cv", "part", "idx", F.posexplode(F.arrays_zip("roles", "texts")).alias("pos", "r"))
    places = places.select("cv", F.xxhash64("r.roles", "r.texts").alias("h1"), F.xxhash64(F.lit(1), "r.roles", "r.texts").alias("h2"), F.struct("part", "idx", "pos").alias("at"))
    firsts = places.groupBy("cv", "h1", "h2").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    again = places.join(firsts, ["cv", "h1", "h2"]).filter("at > first").groupBy("at.part", "at.idx").agg(F.collect_list("at.pos").alias("repeated"))
    tables = cut.join(again.hint("merge"), ["part", "idx"], "left").select("cv", "part", "idx", "roles", "texts", "repeated")
    tables = tables.mapInArrow(_sum_up, "cv string, part int, idx long, faults string, table array<long>")
    back = tables.repartition(partitions(spark), "cv").sortWithinPartitions("cv", F.desc("part"), F.desc("idx"))
    goals = materialize(back.mapInArrow(_from_the_end, "part int, idx long, faults string, goal array<long>, final boolean"), "conv-goals")
    wide = cut.join(goals.hint("merge"), ["part", "idx"])
    kinds = [to_arrow_type(f.dataType) for f in wide.schema]
    searched = wide.mapInArrow(_paths(wide.columns, kinds), T.StructType([*wide.schema.fields, T.StructField("paths", T.ArrayType(T.StringType()))]))
    front = searched.repartition(partitions(spark), "cv").sortWithinPartitions("cv", "part", "idx")
    return blocks.filter("whole").unionByName(front.mapInArrow(_from_the_front(id_kind), head + PIECE_SCHEMA))


def _join_pieces(id_kind):
    """Pieces of each conversation in order: one row for each, digests as streams."""
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def run(batches):
        def rows():
            cv = out = None
            for r in _rows(batches):
                if r["cv"] != cv:
                    if out:
                        yield done(out)
                    cv, out = r["cv"], {"conv_id": r["conv_id"], "audits": [], "sha": hashlib.sha256(), "any": False, "last": None, "lo": None, "hi": None, "n": 0} | dict.fromkeys(names, 0)
                for c in names[1:]:
                    out[c] += r[c]
                if r["first"] is not None:
                    out["illegal"] += out["last"] is not None and out["last"] + r["first"] not in ("su", "ua", "au")
                    out["last"] = r["last"]
                if r["turn_min"] is not None:
                    out["n"] += r["n_turns"] - (out["hi"] == r["turn_min"])
                    out["lo"], out["hi"] = r["turn_min"] if out["lo"] is None else out["lo"], r["turn_max"]
                out["audits"].append(r["audit"])
                for role, text in zip(r["roles"], r["texts"], strict=True):
                    out["sha"].update(f"{chr(10) if out['any'] else ''}{role}:{text}".encode())
                    out["any"] = True
            if out:
                yield done(out)

        def done(out):
            return out | {"gaps": out["hi"] - out["lo"] + 1 - out["n"] if out["n"] else 0, "audit": "".join(out["audits"]), "repaired_sha256": out["sha"].hexdigest()}

        yield from _batches(rows(), [("conv_id", id_kind), *[(n, pa.int64()) for n in names], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    return run


def conversation_report(conversations: DataFrame, *, block: int = BLOCK, **columns) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): a row for each conversation, damaged and repaired.

    Faults, gaps in the turns and illegal neighbours are counted on the rows
    after damage; ``audit`` are the initials of the cheapest edits.

    A null id is a conversation of its own, null roles and texts are one
    space, null turns come first and count in no gap; equal rows are
    duplicates of the first; rows of one turn go by role and text; a
    conversation without rows after damage has zeros, no edits and the digest
    of nothing; other columns are not read; an empty table gives an empty
    result.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    pieces = repair(damaged(conversations, **columns), block=block)
    kind = pieces.schema["conv_id"].dataType
    said = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    gaps = F.when(F.col("n_turns") > 0, F.col("turn_max") - F.col("turn_min") + 1 - F.col("n_turns")).otherwise(0).cast("long")
    own = pieces.filter("whole").select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(said, 256).alias("repaired_sha256"))
    cut = pieces.filter("not whole").repartition(partitions(pieces.sparkSession), "cv").sortWithinPartitions("cv", "part", "idx")
    schema = f"conv_id {kind.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return own.unionByName(cut.mapInArrow(_join_pieces(to_arrow_type(kind)), schema))
