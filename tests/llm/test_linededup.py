import numpy as np
import xxhash

from thoughtloom.llm import linededup


def h(data, seed=42):
    return xxhash.xxh64_intdigest(data, seed)


def chunks(text, divisor, solo):
    """Lists of lines, as the rule says, from the text alone."""
    lines = text.split("\n")
    hashes = [h(x.encode()) for x in lines]
    out = []
    for i, line in enumerate(lines):
        before = hashes[i - 2] if i > 1 else 0
        if i == 0 or len(line) >= solo or len(lines[i - 1]) >= solo:
            new = True
        else:
            rolled = h(hashes[i - 1].to_bytes(8, "little"), h(before.to_bytes(8, "little")))
            new = (rolled - (1 << 64) * (rolled >> 63)) % divisor == 0
        if new:
            out.append([])
        out[-1].append(line)
    return out


def brute(rows, divisor=2, min_chars=20):
    """Each text line by line: chunks and windows of two lines that stood before mark their lines."""
    seen, result, done = set(), [], {}
    for key, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, (h((r[1] or "").encode()) ^ (1 << 63)))):
        if text is None:
            result.append((key, None, 0))
            continue
        if (key, text) not in done:
            lines, at, units = text.split("\n"), 0, []
            for c in chunks(text, divisor, min_chars):
                if len(c) > 2 or (len(c) == 1 and len(c[0]) >= min_chars):
                    units.append((at, tuple(c)))
                at += len(c)
            units += [(i, tuple(lines[i : i + 2])) for i in range(len(lines) - 1)]
            marked = set()
            for start, unit in sorted(units):
                if unit in seen:
                    marked.update(range(start, start + len(unit)))
                seen.add(unit)
            gone, run = set(), []
            for i in range(len(lines) + 1):
                if i in marked:
                    run.append(i)
                else:
                    if len("\n".join(lines[k] for k in run)) >= min_chars:
                        gone.update(run)
                    run = []
            done[key, text] = "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)
        result.append((key, *done[key, text]))
    return result


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "", r[2]))


#: Names that the operator uses for its own columns, besides those of the table.
CLASHING = ["n_removed", "h", "mark", "other", "other_key", "gone", "sieve_word", "sieve_bits", "own", "runs", "id"]


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *(f"'{c}' as {c}" for c in CLASHING))
    out = linededup.remove_repeated_chunks(docs, min_chars=20)
    assert out.columns == ["doc_id", "text", *CLASHING[1:], "n_removed"]
    found = out.collect()
    assert all(r[c] == c for r in found for c in CLASHING[1:])
    return order([(r.doc_id, r.text, r.n_removed) for r in found])


def corpus():
    rng = np.random.default_rng(5)
    short = [f"line {i}" for i in range(12)]
    long = [f"a long line that stands for itself {i}" for i in range(4)]
    passage = ["first of it", "second of it", "third of it", "fourth of it", "fifth of it"]
    rows = []
    for i in range(60):
        lines = list(rng.choice(short, 5)) + ([str(rng.choice(long))] if i % 3 == 0 else []) + (passage if i % 4 == 0 else []) + list(rng.choice(short, 3))
        rows.append((i, "\n".join(lines)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (None, rows[5][1]), (None, None), (102, None), (103, ""), (104, "\n\n\n\n"), (105, "\n\n\n\n"), (106, rows[8][1] + "\n"), (107, "é\r\n" * 9)]
    return rows + [rows[0], rows[4]]


def test_matches_brute_force(spark):
    got = run(spark, corpus())
    assert got == order(brute(corpus()))
    assert sum(r[2] > 0 for r in got) > 20


def test_equal_hashes_of_other_lines_are_no_copies(spark, monkeypatch):
    monkeypatch.setattr(linededup, "_line_hash", lambda line: linededup.F.pmod(linededup.F.xxhash64(line), linededup.F.lit(40)))
    before = {(k, t) for k, t in corpus()}
    got = run(spark, corpus())
    exact = {(k, t): n for k, t, n in order(brute(corpus()))}
    for _, text, n in got:
        assert n or text is None or any(text == t for _, t in before)
    # Nothing goes that exact comparison keeps: what collides stays whole.
    assert sum(r[2] for r in got) <= sum(exact.values()) + 2 and len(got) == len(corpus())


def test_a_copied_passage_goes_to_its_last_line(spark):
    rng = np.random.default_rng(6)
    own = lambda n: [f"only here {rng.integers(10**9)}" for _ in range(n)]
    passage = [f"one of its lines, number {i}" for i in range(4)]
    rows = [(i, "\n".join(own(3) + passage + own(2))) for i in range(40)]
    got = run(spark, rows)
    assert [n for _, _, n in got] == [0] + [4] * 39


def test_frequent_short_lines_stay(spark):
    assert [r[2] for r in run(spark, [(i, "hi\nthere") for i in range(5)])] == [0] * 5


def test_a_passage_within_one_text(spark):
    line = "word " * 30
    assert run(spark, [(1, f"a\n{line}\nb\n{line}")]) == [(1, f"a\n{line}\nb", 1)]


def test_a_very_long_text(spark):
    lines = [f"line {i}" for i in range(30_000)]
    got = run(spark, [(1, "\n".join(lines)), (2, "\n".join(["new", *lines[:29_000], "end"]))])
    assert got[0][2] == 0 and got[1] == (2, "new\nend", 29_000)


def test_empty_table(spark):
    assert run(spark, []) == []
