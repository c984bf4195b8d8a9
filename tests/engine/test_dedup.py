"""Raw concepts that become one, against the same rules applied one concept after the other."""

import random
import re

from thoughtloom.operators import dedup as D

SCHEMA = "ord long, name string, raw_content string, source_chunks array<string>, source_files array<string>, extraction_method string, confidence double"


def slug(name):
    return re.sub(r"[\s_-]+", "-", re.sub(r"[^\w\s-]", "", name.lower().strip())).strip("-")


def words(text):
    return set(re.findall(r"\w+", text.lower()))


def overlap(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def joined(one, two):
    known = {p.strip().lower() for p in one["content"].split("\n\n")}
    new = [p.strip() for p in two["content"].split("\n\n") if p.strip() and p.strip().lower() not in known]
    return {**one, "content": "\n\n".join([one["content"], *new])[:5000], "files": list(dict.fromkeys(one["files"] + two["files"])), "confidence": max(one["confidence"], two["confidence"])}


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(slug(r[1]), []).append({"name": r[1], "content": r[2], "files": list(r[4]), "confidence": r[6]})
    merged = []
    for group in groups.values():
        first = max(group, key=lambda c: (c["confidence"], len(c["content"])))
        out = first
        for other in group:
            out = out if other is first else joined(out, other)
        merged.append(out)
    pairs = {(i, j) for j, b in enumerate(merged) for i, a in enumerate(merged[:j]) if overlap(words(a["name"]), words(b["name"])) > 0.6 or overlap(words(a["content"][:500]), words(b["content"][:500])) > 0.75}
    kept, into = [], {}
    for j in range(len(merged)):
        heads = [i for i in kept if (i, j) in pairs]
        if heads:
            into[j] = heads[0]
        else:
            kept.append(j)
    result = {i: merged[i] for i in kept}
    for j, i in sorted(into.items()):
        result[i] = joined(result[i], merged[j])
    return sorted((c["name"], c["content"], tuple(c["files"]), c["confidence"]) for c in result.values())


def run(spark, rows):
    out = D.deduplicate(spark.createDataFrame(rows, SCHEMA))
    return sorted((r.name, r.raw_content, tuple(r.source_files), r.confidence) for r in out.collect())


def test_equals_one_after_the_other(spark):
    rng = random.Random(4)
    names = ["Vector Search", "vector search!", "Vector Search Index", "Cache", "Prompt Cache", "Rank Fusion", "Fusion of Ranks", "Attention"]
    texts = ["it ranks by meaning and not by word", "it ranks by meaning and not by words", "a store of keys\n\nand values", "heads that look at all places", "one list out of several"]
    rows = []
    for i in range(60):
        content = "\n\n".join(rng.sample(texts, rng.randint(1, 3))) + ("" if i % 2 else f"\n\nnumber {rng.randint(0, 30)}")
        rows.append((i, rng.choice(names) + (f" {rng.randint(0, 9)}" if i % 5 == 0 else ""), content, [f"c{i}"], [f"f{i % 7}"], "llm", rng.choice([0.5, 0.9])))
    assert run(spark, rows) == brute(rows)


def test_contents_end_at_the_limit(spark):
    rows = [(i, "Cache", f"{i} " + "x" * 900, [], [f"f{i}"], "llm", 0.5) for i in range(12)]
    got = run(spark, rows)
    assert got == brute(rows) and len(got[0][1]) == 5000


def test_chains_are_settled_in_order(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (7, 9), (8, 9)], "a long, b long")
    assert sorted((r.b, r.a) for r in D.absorbed(pairs).collect()) == [(2, 1), (4, 3), (9, 7)]


def test_none(spark):
    assert run(spark, []) == []
