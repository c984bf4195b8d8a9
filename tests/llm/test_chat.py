import xxhash

from thoughtloom.llm import chat


def place(role, text):
    """The hash that orders turns of one number, as Spark computes it over four values."""
    seed = 42
    for value in (role is None, role or "", text is None, text or ""):
        data = int(value).to_bytes(4, "little") if isinstance(value, bool) else value.encode()
        seed = xxhash.xxh64_intdigest(data, seed) if not isinstance(value, bool) else _int_hash(int(value), seed)
    return seed - (1 << 64) * (seed >> 63)


def _int_hash(value, seed):
    return xxhash.xxh64_intdigest(value.to_bytes(4, "little"), seed)


def brute(rows):
    convs = {}
    for conv, turn, role, text in set(rows):
        convs.setdefault(conv, []).append((turn is None, turn or 0, place(role, text), role is not None, role or "", text is not None, text or ""))
    convs = {c: sorted(t) for c, t in convs.items()}
    keys = {c: tuple(x[3:] for x in t) for c, t in convs.items()}
    out = []
    for c, k in keys.items():
        if any(len(o) > len(k) and o[: len(k)] == k for o in keys.values()):
            continue
        same = [o for o in keys if keys[o] == k]
        if c == min(same, key=lambda o: (o is None, o or 0)):
            text = "".join(f"<|{x[4] if x[3] else 'unknown'}|>\n{x[6]}\n<|end|>\n" for x in convs[c])
            out.append((c, len(k), len(same), text))
    return sorted(out, key=repr)


def run(spark, rows, block):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as block", "2 as start", "'x' as turns", "0 as l0")
    parts = {}
    for r in sorted(chat.format_chats(df, block).collect(), key=lambda r: r.part):
        parts.setdefault((r.conv_id, r.n_turns, r.n_copies), []).append(r.text)
    return sorted(((*k, "".join(v)) for k, v in parts.items()), key=repr)


def test_matches_brute_force(spark):
    rows = []
    base = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", ""), ("user", None), (None, "x"), ("user", "é")]
    for c in range(12):  # snapshots of one conversation, from another first number
        rows += [(c, i + c % 3, *base[i]) for i in range(c % 7 + 1)]
    rows += [(20, 0, "user", "hi"), (20, 1, "assistant", "other"), (21, 5, "user", "hi"), (21, 9, "assistant", "other")]
    rows += [(22, None, "user", "hi"), (22, None, "user", "hi"), (22, 3, "user", "first"), (None, 0, "user", "lost"), (None, 1, "user", "found")]
    rows += [(23, 1, "user", "tie"), (23, 1, "assistant", "tie"), (24, 0, "", "x"), (25, 0, None, "x"), (26, 0, "x", None), (27, 0, "x", "")]
    rows += [(30, i, "user", f"t{i}") for i in range(40)] + [(31, i, "user", f"t{i}") for i in range(33)]
    for block in (4, 256):
        assert run(spark, rows, block) == brute(rows)


def test_crowded_numbers_are_split(spark):
    rows = [(1, None, "user", f"t{i}") for i in range(200)] + [(2, 7, "user", f"u{i}") for i in range(90)] + [(2, 8, "user", "end"), (2, 1, "user", "begin")]
    rows += [(3, 7, "user", f"u{i}") for i in range(90)] + [(3, 1, "user", "begin")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert max(r.n for r in chat._blocks(df, 4, chat._crowds(df, 4)).selectExpr("size(turns) as n").collect()) < 20
    assert run(spark, rows, 4) == brute(rows)


def test_a_very_long_text(spark):
    rows = [(1, 0, "user", "x" * 2_000_000), (2, 0, "user", "x" * 2_000_000), (2, 1, "assistant", "y")]
    assert run(spark, rows, 256) == brute(rows)


def test_empty_table(spark):
    assert run(spark, [], 256) == []
