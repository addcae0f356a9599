import hashlib
import re
import zlib

import numpy as np
import pytest

from flowsieve.llm import conversations as C

FOLDER = "/root/testdata/sf0.001"
# (s?(ua)+)? by hand: 0 nothing, 1 after s, 2 after u, 3 after a. 0 and 3 may end.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def plain_parse(rows):
    """Cheapest (cost, audit, lines) by carrying whole audits; rows are (role, text, fault)."""
    states = {0: (0, "", ())}

    def inserts(states):
        todo = dict(states)
        for _ in range(4):
            for q, (cost, audit, lines) in list(todo.items()):
                for sign, name in (("u", "user"), ("a", "assistant")):
                    to = STEPS.get((q, sign))
                    if to is not None:
                        new = (cost + 2, audit + "I", (*lines, name + ":"))
                        if to not in todo or new[:2] < todo[to][:2]:
                            todo[to] = new
        return todo

    for role, text, fault in rows:
        # Ways that end in insertions compare only once the next edit is known: all pairs are kept apart here.
        after = {}
        for origin, value in states.items():
            for q, (cost, audit, lines) in inserts({origin: value}).items():
                options = [(q, cost + 3, audit + "D", lines)]
                if fault not in ("blank", "duplicate"):
                    more = 1 if fault == "truncated" else 0
                    options += [(STEPS.get((q, role[:1])), cost + more, audit + "K", (*lines, f"{role}:{text}"))]
                    options += [(STEPS.get((q, n[0])), cost + 2 + more, audit + "R", (*lines, f"{n}:{text}")) for n in ("user", "assistant")]
                for to, *new in options:
                    if to is not None and (to not in after or new[:2] < list(after[to][:2])):
                        after[to] = tuple(new)
        states = after
    ends = [v for origin, value in states.items() for q, v in inserts({origin: value}).items() if q in (0, 3)]
    return min(ends, key=lambda v: v[:2])


def plain(rows):
    """The whole contract over (conv_id, turn, role, text) rows, in Python."""
    word = lambda v: " " if v is None else str(v)
    groups = {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20
        mine = groups.setdefault(conv, [])
        role, text = word(role), word(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        mine += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, mine in groups.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, judged = set(), []
        for _, role, text in mine:
            ink = re.sub(r"[\x20\x09-\x0D]", "", text)
            judged.append((role, text, "blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else ""))
            seen.add((role, text))
        turns = {t for t, *_ in mine if t is not None}
        cost, audit, lines = plain_parse(judged)
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(mine, mine[1:])]
        count = lambda f: sum(x[2] == f for x in judged)
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, count("blank"), count("duplicate"), count("truncated"),
                    sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_parser_finds_the_least_edits(seed):
    rng = np.random.default_rng(seed)
    for _ in range(250):
        size = int(rng.integers(0, 12))
        rows = [(str(rng.choice(["system", "user", "assistant", "tool", "", "unknown"], p=[0.15, 0.35, 0.35, 0.05, 0.05, 0.05])), f"t{k}", str(rng.choice(C.FAULTS, p=[0.7, 0.1, 0.1, 0.1]))) for k in range(size)]
        parse = C.Parse()
        for row in rows:
            parse.row(*row)
        cost, audit, lines = plain_parse(rows)
        assert parse.close() == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), rows
        assert re.fullmatch("(s?(ua)+)?", "".join(line[:1] for line in lines))


def test_long_conversation_needs_few_steps():
    rng = np.random.default_rng(9)
    rows = [(str(r), f"t{k}", str(f)) for k, (r, f) in enumerate(zip(rng.choice(["system", "user", "assistant", "x"], 3000), rng.choice(C.FAULTS, 3000)))]
    parse = C.Parse()
    for row in rows:
        parse.row(*row)
    cost, audit, lines = plain_parse(rows)
    assert parse.close() == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    assert len(C.Parse._steps) < 5000


def test_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(C.op13_conversation_repair(spark, FOLDER)) == plain(rows)


def test_nulls_ties_repeats_long_texts_and_other_columns(spark):
    rows = [(None, None, None, None), (None, 1, "user", "a."), (1, None, "user", "hi!"), (1, 5, "assistant", "yes."), (1, 5, "assistant", "yes."), (1, 5, "user", "no"), (1, 9, None, "x."), (2, 0, "user", None), (2, 1, "", "what?"), (3, 7, "user", " "), (3, 8, "assistant", "word " * 200_000 + "end.\n\n")]
    rows += [(k, t, r, f"{t} and {r}.") for k in range(10, 60) for t, r in enumerate(("system", "user", "assistant", "user", "tool"))]
    table = spark.createDataFrame([(*r, "clash", 7) for r in rows], "conv_id long, turn long, role string, text string, fault string, copy int")
    assert found(C.repair(C.damaged(table))) == plain(rows)


def test_conversation_with_all_rows_dropped_and_empty_table(spark):
    gone = next(k for k in range(10_000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    table = spark.createDataFrame([(gone, 0, "user", "hi.")], "conv_id long, turn long, role string, text string")
    assert found(C.repair(C.damaged(table))) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert C.repair(C.damaged(table.where("false"))).count() == 0


def test_one_shuffle(spark):
    plan = C.op13_conversation_repair(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
