from thoughtloom.operators import parsing as P
from thoughtloom.sources import files as S


def turns(spark, text):
    rows = P.parse_turns(spark.createDataFrame([("f", text)], "source_file string, text string")).orderBy("idx").collect()
    return [(r.idx, r.role, r.content) for r in rows]


def test_roles(spark):
    text = "lost\nHuman: hi\nthere\n## Assistant\nhello\n\nSystem: be kind\nGPT:\n\nuser : bye"
    assert turns(spark, text) == [(0, "human", "hi\nthere"), (1, "assistant", "hello"), (2, "system", "be kind"), (3, "human", "bye")]


def test_separators_alternate(spark):
    assert turns(spark, "Me: a\n---\nb\n---\nc") == [(0, "human", "a"), (1, "assistant", "b"), (2, "human", "c")]
    assert turns(spark, "a\n---\nb") == [(0, "assistant", "a\n---\nb")]


def test_no_marker_is_one_assistant_turn(spark):
    assert turns(spark, "  just text \n") == [(0, "assistant", "just text")]
    assert turns(spark, "Human:\n\n") == [(0, "assistant", "Human:")]


def chunks(spark, text):
    rows = P.chunk_turns(spark.createDataFrame([("f", 2, text)], "source_file string, idx int, content string")).orderBy("chunk_index").collect()
    return [(r.chunk_id, r.chunk_type, r.content) for r in rows]


def test_chunks(spark):
    long = "word " * 20 + "end"
    text = f"{long}\n\n{long}\n# Head\n{long}\n```py\nx = 1\n```\ntail"
    assert [c for _, _, c in chunks(spark, text)] == [long, long, f"# Head\n{long}", "```py\nx = 1\n```\n\ntail"]
    assert [t for _, t, _ in chunks(spark, text)] == ["prose", "prose", "prose", "code"]
    assert chunks(spark, "short")[0][0] == "f:t2:c0"


def test_small_chunks_merge(spark):
    assert [c for _, _, c in chunks(spark, "a\n\nb\n\n" + "c" * 90)] == ["a\n\nb\n\n" + "c" * 90]
    assert [c for _, _, c in chunks(spark, "c" * 90 + "\n\na")] == ["c" * 90 + "\n\na"]
    assert [c for _, _, c in chunks(spark, "a\n\n```\nx\n```")] == ["a", "```\nx\n```"]


def test_chunk_types(spark):
    assert [t for _, t, _ in chunks(spark, "- item one")] == ["list"]
    assert [t for _, t, _ in chunks(spark, "1. item one")] == ["list"]
    assert [t for _, t, _ in chunks(spark, "Vector Search is a method")] == ["definition"]


def test_batches_reset_and_keep_files_apart(spark):
    rows = [("a", 0, i, f"a{i}", "x" * n) for i, n in enumerate((40, 50, 30, 90, 200, 10))] + [("b", 0, 0, "b0", "y")]
    df = spark.createDataFrame(rows, "source_file string, turn_index int, chunk_index int, chunk_id string, content string")
    got = P.batch_chunks(df, 100).orderBy("source_file", "batch").collect()
    assert [r.chunk_ids for r in got] == [["a0", "a1"], ["a2"], ["a3"], ["a4"], ["a5"], ["b0"]]


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("Human: hi\nAssistant: yo")
    (tmp_path / "b.txt").write_text("plain")
    (tmp_path / "c.bin").write_text("no")
    got = S.read_transcripts(spark, str(tmp_path)).collect()
    assert sorted((r.source_file.rsplit("/")[-1], r.role) for r in got) == [("a.md", "assistant"), ("a.md", "human"), ("b.txt", "assistant")]
    assert {"md", "txt", "html"} <= set(S.registered_extensions())
