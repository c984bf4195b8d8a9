"""Turns put in order against a plain simulation of the rules, and of restarts."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from thoughtloom.llm.reassembly import Reassembly, _Conversation, dealt


def plain(rows, batches, quiet):
    """Events by definition, over (conv, turn, role, text, batch) rows."""
    by, first = {}, {}
    for conv, turn, role, text, batch in rows:
        if turn is None:
            continue
        role, text = role or "", text or ""
        said = ((role + "|" + text).encode(), role.encode())
        at = by.setdefault(batch, {}).setdefault(conv, {})
        at[turn] = min(at.get(turn, said), said)
        first[conv] = min(first.get(conv, turn), turn)
    state, out = {}, []

    def close(conv, batch):
        s = state[conv]
        s["shut"], kept = True, s["kept"]
        waits = sorted(t for t in kept if t >= s["next"])
        breaks = sum(t - 1 in kept and kept[t - 1][1] == kept[t][1] for t in kept)
        out.append(("close", conv, -1, batch, None, waits, max(kept) - first[conv] + 1 - len(kept), breaks))

    for batch in range(batches + 1):
        for conv, turns in sorted(by.get(batch, {}).items(), key=str):
            s = state.setdefault(conv, {"kept": {}, "next": first[conv], "shut": False})
            s["last"] = batch
            for turn in sorted(turns):
                if s["shut"]:
                    out.append(("reject", conv, turn, batch, turns[turn][0].decode(), None, None, None))
                else:
                    s["kept"].setdefault(turn, turns[turn])
            while not s["shut"] and s["next"] in s["kept"]:
                out.append(("release", conv, s["next"], batch, s["kept"][s["next"]][0].decode(), None, None, None))
                s["next"] += 1
        for conv, s in state.items():
            if not s["shut"] and (batch - s["last"] >= quiet or batch == batches):
                close(conv, batch)
    return sorted(out, key=str)


def run(spark, rows, batches, quiet):
    schema = "conv_id long, turn long, role string, text string, batch int, key int, first string"
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], schema)
    got = Reassembly(df, batches, quiet).run()
    return sorted((tuple(r) for r in got.select("event", F.col("conv_id").cast("long"), "turn", "batch", "payload", "unreleased", "n_missing", "n_breaks").collect()), key=str)


def test_events_equal_those_of_a_plain_simulation(spark):
    rng, rows = random.Random(3), []
    for conv in range(40):
        begin = rng.randrange(-2, 5)
        for turn in range(begin, begin + (60 if conv == 7 else rng.randrange(1, 8))):  # one conversation has a third of the rows
            for _ in range(rng.choice((1, 1, 2, 3))):
                rows.append((conv, turn, rng.choice(("user", "assistant", None, "a|b")), rng.choice((None, "", "é x", "b|c", f"t{turn}")), rng.choice((0, 0, 1, 2, 5, 6))))
    rows += [(None, 1, "user", "nobody", 0), (None, 2, "user", "nobody", 1), (3, None, "user", "no turn", 0), (7, 9, "user", "late", 6), (rows[0]), (rows[0])]
    rows = [r for r in rows if r[4] not in (3, 4)]  # batches 3 and 4 are empty: all conversations close in 4 at the latest
    assert run(spark, rows, 7, 2) == plain(rows, 7, 2)


def test_an_empty_table_gives_no_events(spark):
    assert run(spark, [], 2, 2) == []


def test_state_is_the_same_after_being_stored():
    talk = _Conversation("5", 3)
    talk.arrive({3: "u", 5: "u", 6: "u", 9: "a"}, 0)
    again = _Conversation.stored("5", talk.to_store())
    again.arrive({4: "u", 6: "x"}, 2)
    assert [e[:5] for e in again.events] == [("release", "5", 4, 2, 2), ("release", "5", 5, 2, 0), ("release", "5", 6, 2, 0)]
    assert json.loads(again.to_store()[-1]) == [[9, 0, "a"]] and (again.breaks, again.kept, again.next) == (3, 5, 7)
    again.close(4)
    assert again.events[-1] == ("close", "5", -1, 4, None, [9], 2, 3) and again.to_store()[-1] == b"[]"


def test_rows_are_dealt_by_hash_and_some_come_again(spark):
    rows = [(c, t, "system", "x") for c in range(30) for t in range(3)] + [(1, None, "user", "y")]
    got = {tuple(r) for r in dealt(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).select("conv_id", "turn", "batch", "role").collect()}
    want = set()
    for c, t, role, _ in rows[:-1]:
        h = int(hashlib.sha256(f"{c}:{t}".encode()).hexdigest()[:8], 16)
        want |= {(c, t, h % 12, role)} | ({(c, t, (h + 5) % 12, "user")} if h % 7 < 2 else set())
    assert got == want
