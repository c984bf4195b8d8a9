from pyspark.sql import functions as F

from thoughtloom.functions.text import sentences
from thoughtloom.operators import concepts as C


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).head()["x"]


def test_rule_concepts(spark):
    got = one(spark, C.rule_concepts(F.col("t")), t="The Vector Store keeps it. A Re-Rank Model helps, The Vector Store too! x Kubernetes. Last One")
    assert [(r.name, r.definition) for r in got] == [("The Vector Store", "The Vector Store keeps it"), ("A Re-Rank Model", "A Re-Rank Model helps, The Vector Store too"), ("Kubernetes", "x Kubernetes")]


def test_grounding(spark):
    for name, text, expected in (("RAG", "storage and drag", False), ("RAG", "use rag.", True), ("Vector Embeddings", "a vector embedding", True), ("C++", "in c++ we", True), ("", "x", False), ("Its", "it", False)):
        assert one(spark, C.is_grounded(F.col("n"), F.col("t")), n=name, t=text) is expected


def test_json_recovery(spark):
    for reply, expected in (('```json\n{"a": 1}\n```', '{"a": 1}'), ('so: {"a": {"b": 2}} ok', '{"a": {"b": 2}}'), ("nothing", None), ("{broken", None)):
        assert one(spark, C.json_object(F.col("r")), r=reply) == expected


def test_replies_and_markers(spark):
    reply = '{"concepts": [{"name": "KV Cache", "definition": "It  stores keys.", "explanation": "More.", "insights": ["saves a lot of work"], "examples": ["one"], "tags": ["a", "b"], "relationships": [{"target": "Attention", "type": "uses"}, {"target": "X", "type": "odd"}]}, {"name": "ab"}]}'
    df = C.parse_reply(spark.createDataFrame([("f", reply)], "f string, reply string"), ["f"])
    row = C.distill_marked(df).head()
    assert (row.name, row.definition, row.explanation, row.insights, row.examples, row.tags, row.links) == ("KV Cache", "It stores keys.", "More.", ["saves a lot of work"], ["one"], ["a", "b"], ["Attention", "X"])
    assert [(r.source, r.target, r.type, r.confidence) for r in row.relationships] == [("kv-cache", "attention", "uses", 0.85), ("kv-cache", "x", "related_to", 0.85)]


def test_groups_keep_all_sources(spark):
    rows = [("a", 0, "KV Cache", "short"), ("b", 3, "KV  cache", "a longer definition"), ("b", 1, "KV Cache", "short")]
    got = C.group_by_slug(spark.createDataFrame(rows, "source_file string, idx int, name string, definition string")).collect()
    assert [(r.slug, r.definition, r.source_files, r.mentions) for r in got] == [("kv-cache", "a longer definition", ["a", "b"], 3)]


def test_distillation(spark):
    text = "Intro words here. Cache is fast. The cache holds keys. Cache again. Another cache line. Unrelated matter entirely."
    definition = one(spark, C.build_definition(F.lit("Cache"), sentences(F.col("t"))), t=text)
    assert definition == "Cache is fast. The cache holds keys. Cache again."
    assert one(spark, C.build_explanation(sentences(F.col("t")), F.lit(definition)), t=text) == "Intro words here. Another cache line. Unrelated matter entirely."
    assert one(spark, C.remove_fluff(F.col("t")), t="Great question! Sure, it works.\n\n\n\nHope this helps!") == "it works."
    listed = "- a bullet of some length\n1. a numbered item here\nIt is important to note. Nothing"
    assert one(spark, C.insights(F.col("t"), F.lit("zzz")), t=listed)[:2] == ["a bullet of some length", "a numbered item here"]
    assert one(spark, C.examples(F.col("t")), t="Use it, for example, when reading large files. ```py\nx = 1 + 2 + 3\n```") == ["when reading large files", "```\nx = 1 + 2 + 3\n```"]


def test_merge(spark):
    rows = [("s", 1, "N", "short", "", 0.5, "deleted", "2024-01-02", ["x"], ["f"]), ("s", 2, "M", "longer", "e", 0.9, "active", None, ["y", "x"], ["g"])]
    schema = "slug string, o int, name string, definition string, explanation string, confidence double, status string, deleted_at string, tags array<string>, source_files array<string>"
    r = C.merge_concepts(spark.createDataFrame(rows, schema), "o").head()
    assert (r.name, r.definition, r.explanation, r.confidence, r.status, r.deleted_at, r.tags, r.source_files) == ("N", "longer", "e", 0.9, "active", None, ["x", "y"], ["f", "g"])


def test_first_wins(spark):
    rows = [("KV", 2), ("kv", 1), ("x", 3)]
    assert sorted(r.name for r in C.first_wins(spark.createDataFrame(rows, "name string, o int"), ["o"]).collect()) == ["kv", "x"]


def test_the_definition_is_not_computed_anew_for_each_sentence(spark):
    parts = ["It is a tree.", "It  is a TREE.", "Leaves fall in autumn.", "A tree.", "Leaves fall."]
    rows = spark.createDataFrame([(parts, "It is a tree.")], "parts array<string>, d string")
    out = rows.select(C.build_explanation(F.col("parts"), F.concat("d", F.lit(" MARK"))).alias("e"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MARK") == 1
    assert out.head().e == "Leaves fall in autumn. Leaves fall."
