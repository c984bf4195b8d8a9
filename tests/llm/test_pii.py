import hashlib
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from thoughtloom.llm import pii

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def base(text):
    return [s[:3] for s in pii.find_spans(text) if s.kind in pii.BASE]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aZ09.5@-+ ()_é%", max_size=60))
def test_base_spans_equal_the_plain_patterns(text):
    assert base(text) == plain(text)


def test_known_spans():
    text = "Mail a.b@x.example.com or b@@c.d.e, 10.0.0.255 300.1.1.1 4337166598464399 +1 (988) 555-2485 IBAN GB82 WEST 1234 5698 7654 32 ssn 123-45-6789 and 321-45-6789"
    kinds = [(s.kind, text[s.start : s.end]) for s in pii.find_spans(text)]
    assert ("email", "a.b@x.example.com") in kinds and ("ip", "10.0.0.255") in kinds
    assert ("phone", "+1 (988) 555-2485") in kinds and ("iban", "GB82 WEST 1234 5698 7654 32") in kinds
    assert ("national_id", "123-45-6789") in kinds
    assert base(text) == plain(text)


def test_context_decides_added_spans():
    assert [s.kind for s in pii.find_spans("order 123-45-6789 shipped")] == []
    assert [s.kind for s in pii.find_spans("passport no. X1234567")] == ["passport"]


def test_long_runs_take_linear_time():
    begun = time.time()
    for text in ("a" * 500_000, "1" * 500_000, "1." * 250_000, "+" * 300_000, "+1" + " " * 500_000, "@a" * 200_000, "GB11" * 100_000):
        pii.find_spans(text)
    assert time.time() - begun < 20


def test_query_digest(spark):
    rows = [(1, "x@y.zz +49 1234 56789"), (2, None), (3, ""), (None, "é x@y.zz"), (1, "x@y.zz +49 1234 56789")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'old' as spans", "1 as kind")
    got = pii.detect(docs).orderBy("doc_id").collect()
    assert [[(s.kind, s.start, s.end) for s in r.spans] for r in got] == [[("email", 2, 8)], *[[("email", 0, 6), ("phone", 7, 21)]] * 2, [], []]
    assert pii.detect(docs.limit(0)).count() == 0


def test_query(spark, tmp_path):
    spark.createDataFrame([(1, "x@y.zz +49 1234 56789"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    one, two = pii.op3_pii(spark, str(tmp_path)).orderBy("doc_id").collect()
    digest = hashlib.sha256(b"email:0:6,phone:7:21").hexdigest()
    assert tuple(one) == (1, 1, 0, 0, 1, digest, "email:0:6,phone:7:21")
    assert tuple(two) == (2, 0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "")
