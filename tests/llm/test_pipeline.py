"""The pipeline on a small corpus, against what a plain reading of its rules leaves."""

import numpy as np

import corpus_pipeline
from tests.llm import test_linededup, test_similar

PASSAGE = "a passage that many of the texts share word for word and that is much longer than the hundred and twenty characters of a short line, indeed"
ITEM = "which of the seven rivers flows past the old mill before it meets the northern sea at last"


def corpus():
    rng = np.random.default_rng(11)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "nu", "re", "so") for b in ("ta", "vo", "xi", "zu") for c in ("b", "d", "g", "k", "m", "p", "r", "s")]

    def text(n=60):
        return " ".join(rng.choice(words, n))

    rows, toxic, leaks = [], set(), set()
    for i in range(260):
        t = text()
        if i % 4 == 1:
            t, _ = t.replace(" ", " hatefulword ", 2), toxic.add(i)
        elif i % 10 == 2:
            t = f"{t}\n{PASSAGE}"
        elif i % 26 == 3:
            t, _ = f"{t} {ITEM} {text(9)}", leaks.add(i)
        rows.append((i, t))
    copies = [(1000 + i, rows[4 * i + 4][1]) for i in range(8)]
    near = [(2000 + i, test_similar.edited(rng, rows[4 * i + 8][1], 1)) for i in range(10, 20)]
    return rows + copies + near + [(3000, ""), (3001, None)], toxic, leaks


def plain(rows, toxic, leaks):
    """{id: words} of what stays: each rule by brute force, in the order of the stages."""
    rows = [(i, t) for i, t in rows if i not in toxic]
    cut = test_linededup.brute(rows, min_chars=100)
    rows = [(i, t) for i, t, gone in cut if not gone or t.strip()]
    groups = test_similar.brute(rows)
    rows = [(i, t) for (i, t), c in zip(rows, groups) if i == c]
    return {i: len((t or "").split()) for i, t in rows if i not in leaks}


def test_stages_leave_what_the_rules_leave(spark, tmp_path):
    rows, toxic, leaks = corpus()
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 5}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i, _ in rows if i % 7], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_words
    assert got == plain(rows, toxic, leaks)
    assert not any(1000 <= i < 2000 for i in got) and not set(got) & (toxic | leaks)


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some text", "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert docs.count() == 1
