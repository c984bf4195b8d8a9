import re

from thoughtloom.llm import decontaminate as d

UNITS = set(d.UNITS.split())


def tokens(text):
    marked = re.sub(r"(?<=[a-zéüß,;] )(?=[A-ZÉ][a-zéüß])", "\x01", text)
    out = re.sub(r"(?:[^\w\x01.,]|_|[.,](?!\d)|(?<!\d)[.,])+", " ", marked.lower()).strip(" ").split(" ")
    kinds = []
    for i, t in enumerate(out):
        number = t[:1].isdigit()
        kinds.append("<name>" if t[:1] == "\x01" else "<num>" if number else "<unit>" if i and out[i - 1][:1].isdigit() and t in UNITS else t)
    return out, kinds


def windows(text, w=8):
    out, kinds = tokens(text)
    return [(i, tuple(kinds[i : i + w]), tuple(o for o, k in zip(out[i : i + w], kinds[i : i + w]) if k.startswith("<"))) for i in range(len(out) - w + 1)]


def brute(docs, items):
    first = {}
    for i, t in items:
        if t is not None:
            first[t] = min(first.get(t, i), i)
    result = set()
    for key, text in docs:
        mine = windows(text or "")
        for t, item in first.items():
            own = [x for x in windows(t) if sum(not k.startswith("<") for k in x[1]) >= 4]
            matched, filled = 0, set()
            for _, kinds, slots in own:
                places = [(p, s) for p, k, s in mine if k == kinds]
                if places:
                    matched += 1
                    filled |= set(zip(slots, min(places)[1]))
            if own and matched >= min(6, len(own)) and matched and len({a for a, _ in filled}) == len(filled):
                result.add((key, item, matched, len(own), all(a == b for a, b in filled)))
    return sorted(result, key=repr)


ITEMS = [
    (1, "A train leaves the town of Berlin at 9 and travels 120 km in 2 hours, then Anna gets off with 3 bags of flour and 9 eggs"),
    (2, "the quick brown fox jumps over the lazy dog while the old cat sleeps near the warm stove all day long"),
    (3, "too short"),
    (4, None),
    (5, "the quick brown fox jumps over the lazy dog while the old cat sleeps near the warm stove all day long"),
    (6, "one two three four five six seven eight"),
]
DOCS = [
    (10, "Before. " + ITEMS[0][1] + " and after."),
    (11, "A train leaves the town of Paris at 7 and travels 80 km in 5 hours, then Maria gets off with 4 bags of flour and 7 eggs"),
    (12, "A train leaves the town of Paris at 7 and travels 80 km in 5 hours, then Maria gets off with 4 bags of flour and 8 eggs"),
    (13, "x " + ITEMS[1][1].replace("lazy dog", "LAZY,\ndog!") + " y"),
    (14, "the quick brown fox jumps over the lazy"),
    (15, "nothing of this is known to the benchmark at all, and it stays so"),
    (16, None),
    (17, ""),
    (None, ITEMS[1][1]),
    (18, ITEMS[1][1] + ". " + ITEMS[1][1]),
    (19, "so it is one two three four five six seven eight"),
    (20, "é 1,000.5 kg " * 3000 + ITEMS[1][1]),
    (10, "Before. " + ITEMS[0][1] + " and after."),
]


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item", "2 as pos", "3 as h", "'b' as mark", "4 as other", "5 as other_mark", "6 as sieve_bits"), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as h")


def test_matches_brute_force(spark):
    got = sorted((tuple(r) for r in d.find_leaks(*frames(spark, DOCS, ITEMS)).drop("text_hash").collect()), key=repr)
    assert got == brute(DOCS, ITEMS)
    assert {(r[0], r[1]) for r in got} == {(10, 1), (11, 1), (13, 2), (None, 2), (18, 2), (19, 6), (20, 2)}
    assert {r[0]: r[4] for r in got}[11] is False


def test_a_large_benchmark_finds_the_same(spark, monkeypatch):
    monkeypatch.setattr(d, "SENT", 3)
    got = sorted((tuple(r) for r in d.find_leaks(*frames(spark, DOCS, ITEMS)).drop("text_hash").collect()), key=repr)
    assert got == brute(DOCS, ITEMS)


def test_leaks_are_removed(spark):
    docs, items = frames(spark, DOCS, ITEMS)
    left = d.remove_leaks(docs, items)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [12, 14, 15, 16, 17]


def test_empty_tables(spark):
    docs, items = frames(spark, DOCS, ITEMS)
    assert d.find_leaks(docs.limit(0), items).count() == 0
    assert d.find_leaks(docs, items.limit(0)).count() == 0


def test_a_rejected_variant_hides_no_copy(spark):
    far = "and now for something else that fills the space between the two, word by word, to the end. "
    longer = ITEMS[0][1].replace("then Anna", "and then at last Anna")
    docs = [(1, f"{DOCS[2][1]}. {far}{DOCS[0][1]}"), (2, f"{DOCS[2][1]}. {far}{longer}"), (3, f"{DOCS[2][1]}. {far}{DOCS[2][1]}")]
    got = {(r.doc_id, r.item_id, r.exact) for r in d.find_leaks(*frames(spark, docs, ITEMS)).collect()}
    assert got == {(1, 1, True), (2, 1, True)}


def test_names_that_begin_a_sentence(spark):
    item = "Anna has 12 apples. Anna gives 5 to Ben. How many apples does Anna have left?"
    docs = [(1, item.replace("Anna", "Maria")), (2, f'He said: "{item}"'), (3, "3 Maria has 12 apples. Anna gives 5 to Ben. How many apples does Anna have left?")]
    got = {(r.doc_id, r.exact) for r in d.find_leaks(*frames(spark, docs, [(1, item)])).collect()}
    assert got == {(1, False), (2, True)}


def test_items_without_a_window_are_found_as_they_are(spark):
    items = [(1, "Who wrote Faust?"), (2, "12 km + 7 km - 3 km * 2 km = 4,5 km"), (3, "12 km + 7 km - 3 km * 2 km = 8 km"), (4, ""), (5, "?")]
    docs = [(1, "He asked: who wrote  Faust, and when?"), (2, "Who wrote it? Faust?"), (3, "so " + items[1][1] + " it is"), (4, ""), (5, None), (6, "Faust"), (7, "Who wrote Faust")]
    got = {(r.doc_id, r.item_id) for r in d.find_leaks(*frames(spark, docs, items)).collect()}
    assert got == {(1, 1), (3, 2), (7, 1)}
