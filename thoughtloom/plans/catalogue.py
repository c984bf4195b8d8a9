"""The registered queries over the engine's own operators, each with its DuckDB counterpart.

``QUERIES`` maps a name to (spark, folder) -> DataFrame, ``ORACLE_SQL`` a name to SQL over the same
tables. Both run over whole tables; a limit stands only where it is the feature (top-k).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import asking as Q
from ..operators import cells as W
from ..operators import concepts as C
from ..operators import dedup as D
from ..operators import evaluation as E
from ..operators import extraction as X
from ..operators import graph as G
from ..operators import hygiene as H
from ..operators import index as I
from ..operators import lifecycle as L
from ..operators import linking as K
from ..operators import names as N
from ..operators import parsing as P
from ..operators import retrieval as R
from ..operators import scans as Z
from ..service import tools as A
from ..sources import buckets as U
from ..sources import files as S
from ..sources import storage as O
from ..streaming import events as V
from ..streaming import staleness as Y
from . import tables as B

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: The query of the search reports, and the time that stands for "now".
ASKED, NOW = "the reader of ander and the thing", "2024-06-01 00:00:00"


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# --- shared SQL ---------------------------------------------------------------------------------


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _slug(x: str) -> str:
    kept = f"regexp_replace({_strip(f'lower({x})')}, '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g')"
    return f"regexp_replace(regexp_replace({kept}, '[\\s_-]+', '-', 'g'), '^-+|-+$', '', 'g')"


def _squeeze(x: str) -> str:
    return _strip(f"regexp_replace({x}, '\\s+', ' ', 'g')")


def _sentences(x: str) -> str:
    parts = f"string_split(regexp_replace({_strip(x)}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({parts}, lambda s: {_strip('s')}), lambda s: s <> '')"


_STOP = ", ".join(f"'{w}'" for w in sorted(T.STOPWORDS))
_TITLE = C.TITLE_CASE


def _mentions(role: str, p: str = "") -> str:
    return f"""
{p}sent AS (
  SELECT source_file, idx, unnest(l) AS s, generate_subscripts(l, 1) AS si
  FROM (SELECT conv_id::VARCHAR AS source_file, turn AS idx, string_split_regex(text, '[.!?]\\s+') AS l FROM conversations WHERE role = '{role}')
), {p}found AS (
  SELECT source_file, idx, si, s, unnest(p) AS name, generate_subscripts(p, 1) AS pi
  FROM (SELECT *, regexp_extract_all(regexp_replace(s, '[^\\x00-\\x7F]', '_', 'g'), '{_TITLE}', 1) AS p FROM {p}sent)
), {p}firsts AS (
  SELECT *, row_number() OVER (PARTITION BY source_file, idx, name ORDER BY si, pi) AS k FROM {p}found WHERE length(name) >= 3
), {p}ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY source_file, idx ORDER BY si, pi) - 1)::INTEGER AS rank FROM {p}firsts WHERE k = 1
), {p}mentions AS (
  SELECT source_file, idx, rank, name, substr({_strip('s')}, 1, 300) AS definition, {_slug('name')} AS slug FROM {p}ranked WHERE rank < 3
)"""


def _concepts(role: str = "assistant", p: str = "") -> str:
    return f"""{_mentions(role, p)}, {p}base AS (
  SELECT slug, list(DISTINCT source_file ORDER BY source_file) AS source_files, count(*) AS mentions FROM {p}mentions WHERE slug <> '' GROUP BY slug
), {p}best AS (
  SELECT slug, name, definition, row_number() OVER (PARTITION BY slug ORDER BY length(definition) DESC, definition DESC, name DESC) AS k FROM {p}mentions
), {p}words AS (
  SELECT slug, unnest(t) AS w, generate_subscripts(t, 1) AS p0
  FROM (SELECT slug, regexp_extract_all(lower(definition), '[a-zA-Z][a-zA-Z0-9_]*') AS t FROM {p}best WHERE k = 1)
), {p}counted AS (
  SELECT slug, w, count(*) AS n, min(p0) AS p0 FROM {p}words WHERE length(w) > 2 AND w NOT IN ({_STOP}) GROUP BY slug, w
), {p}tagged AS (
  SELECT slug, list(w ORDER BY n DESC, p0) AS tags FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY n DESC, p0) AS r FROM {p}counted) WHERE r <= 5 GROUP BY slug
), {p}concepts AS (
  SELECT b.name, base.slug, b.definition, coalesce(t.tags, []::VARCHAR[]) AS tags, base.source_files, 0.9::DOUBLE AS confidence, base.mentions,
         substr(sha256(b.name || ':' || b.definition), 1, 12) AS hash
  FROM {p}base base JOIN {p}best b ON b.slug = base.slug AND b.k = 1 LEFT JOIN {p}tagged t ON t.slug = base.slug
)"""


_KINDS = " ".join(f"WHEN regexp_matches(s, '{pattern}') THEN '{kind}'" for kind, pattern in K.WORDINGS)


def _links(p: str = "") -> str:
    return f"""
{p}c AS (
  SELECT slug, name, tags, lower(definition) || ' ' AS low, list_distinct(regexp_extract_all(lower(substr(definition, 1, 200)), '[\\p{{L}}\\p{{N}}_]+')) AS words FROM {p}concepts
), {p}scored AS (
  SELECT a.slug AS source, b.slug AS target, b.name AS target_name, a.low,
         round(least(((length(a.low) - length(replace(a.low, lower(b.name), ''))) // length(b.name)) * 0.3, 1.0)
         + len(list_intersect(a.tags, b.tags)) / greatest(len(a.tags), 1) * 0.5
         + CASE WHEN len(a.words) = 0 OR len(b.words) = 0 THEN 0.0 ELSE len(list_intersect(a.words, b.words)) / (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words))) END * 0.4, 9) AS score
  FROM {p}c a JOIN {p}c b ON a.slug <> b.slug
), {p}links AS (
  SELECT source, target, target_name, score, least(score, 1.0) AS confidence,
    coalesce(list_filter(list_transform(list_filter(string_split_regex(low, '[.!?]\\s+'), lambda s: contains(s, lower(target_name))), lambda s: CASE {_KINDS} END), lambda t: t IS NOT NULL)[1], 'related_to') AS type
  FROM {p}scored WHERE score >= 0.3
)"""


_GRAPH = f"WITH {_concepts()}, {_links()}, pairs AS (SELECT source, target, max(confidence) AS confidence FROM links GROUP BY source, target), both_ways AS (SELECT source AS a, target AS b FROM pairs UNION SELECT target, source FROM pairs)"


def _keyword(docs: str, key: str, text: str, asked: str = ASKED) -> str:
    """CTEs that end in ``kw`` (key, score)."""
    words = asked.lower().split()
    values = ", ".join(f"('{w}', {words.count(w)})" for w in dict.fromkeys(words))
    return f"""
kd AS (SELECT {key}, regexp_extract_all(lower({text}), '[a-z0-9]+') AS t FROM {docs}),
kq AS (SELECT * FROM (VALUES {values}) AS v(w, times)),
ktf AS (SELECT {key}, len(t) AS len, w, times, len(list_filter(t, lambda x: x = w)) AS tf FROM kd, kq),
kdf AS (SELECT w, count(*) AS df FROM ktf WHERE tf > 0 GROUP BY w),
kraw AS (SELECT {key}, sum(tf / len * ln(((SELECT count(*) FROM kd) - df + 0.5) / (df + 0.5) + 1) * times) AS raw FROM ktf JOIN kdf USING (w) WHERE tf > 0 GROUP BY {key}),
kw AS (SELECT {key}, raw / (SELECT max(raw) FROM kraw) AS score FROM kraw WHERE raw > 0)"""


# --- text ---------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {_slug('text')} AS slug FROM documents")
def text_slugify(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "documents").select("doc_id", T.slugify(F.col("text")).alias("slug"))


@query("SELECT doc_id, substr(sha256(text), 1, 12) AS hash FROM documents")
def text_hash(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "documents").select("doc_id", T.content_hash(F.col("text")).alias("hash"))


@query(f"SELECT doc_id, {_squeeze('text')} AS text FROM documents")
def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "documents").select("doc_id", T.normalize_whitespace(F.col("text")).alias("text"))


@query(f"SELECT doc_id, (generate_subscripts(l, 1) - 1)::INTEGER AS pos, unnest(l) AS sentence FROM (SELECT doc_id, {_sentences('text')} AS l FROM documents)")
def text_sentences(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


@query("SELECT doc_id, '<retrieved-content>' || chr(10) || regexp_replace(text, '[\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{2064}\\x{FEFF}\\x{E0000}-\\x{E007F}]', '', 'g') || chr(10) || '</retrieved-content>' AS wrapped FROM documents")
def text_strip_hidden(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "documents").select("doc_id", T.wrap_retrieved(F.col("text")).alias("wrapped"))


@query(f"""
WITH w AS (SELECT doc_id, unnest(t) AS word, generate_subscripts(t, 1) AS p0 FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-zA-Z][a-zA-Z0-9_]*') AS t FROM documents)),
c AS (SELECT doc_id, word, count(*) AS n, min(p0) AS p0 FROM w WHERE length(word) > 2 AND word NOT IN ({_STOP}) GROUP BY doc_id, word)
SELECT doc_id, rank, word, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p0)::INTEGER AS rank FROM c) WHERE rank <= 15
""")
def text_keywords(spark: SparkSession, d: str) -> DataFrame:
    return T.keywords(B.table(spark, d, "documents"), "doc_id", "text")


@query("""
WITH w AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS s FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))), 9) AS similarity
FROM w a JOIN w b ON a.item_id < b.item_id WHERE len(list_intersect(a.s, b.s)) > 0
""")
def text_jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of items with a word in common; words bring them together, sizes give the ratio."""
    w = B.table(spark, d, "benchmark").select("item_id", F.explode(T.word_set(F.col("text"))).alias("w"))
    n = w.groupBy("item_id").agg(F.count("*").alias("n"))
    both = w.join(w.select(F.col("item_id").alias("other"), "w"), "w").where("item_id < other").groupBy("item_id", "other").agg(F.count("*").alias("c"))
    rows = both.join(n, "item_id").join(n.select(F.col("item_id").alias("other"), F.col("n").alias("m")), "other")
    return rows.select(F.col("item_id").alias("a"), F.col("other").alias("b"), F.round(F.col("c") / (F.col("n") + F.col("m") - F.col("c")), 9).alias("similarity"))


# --- turns and chunks ---------------------------------------------------------------------------


@query("SELECT conv_id::VARCHAR AS source_file, turn AS idx, CASE role WHEN 'user' THEN 'human' ELSE role END AS role, text AS content FROM conversations")
def turns_normalized(spark: SparkSession, d: str) -> DataFrame:
    return B.turns(spark, d)


@query("SELECT conv_id::VARCHAR AS source_file, turn AS idx, text AS content FROM conversations WHERE role = 'assistant'")
def assistant_turns(spark: SparkSession, d: str) -> DataFrame:
    return B.turns(spark, d).where("role = 'assistant'").drop("role")


@query("SELECT CASE role WHEN 'user' THEN 'human' ELSE role END AS role, count(*) AS n, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1")
def role_counts(spark: SparkSession, d: str) -> DataFrame:
    return B.turns(spark, d).groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))


@query("""
SELECT doc_id, (generate_subscripts(l, 1) - 1)::INTEGER AS idx, CASE generate_subscripts(l, 1) % 2 WHEN 1 THEN 'human' ELSE 'assistant' END AS role, unnest(l) AS content
FROM (SELECT item_id AS doc_id, [regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'), 'noted', regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')] AS l FROM benchmark)
""")
def marked_turns(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark item as a transcript: a prefix, a heading, and a separator that hands back."""
    item = T.normalize_whitespace(F.col("text"))
    files = B.table(spark, d, "benchmark").select("item_id", F.concat(F.lit("lost\nUser: "), item, F.lit("\n## Assistant\nnoted\n---\n"), item).alias("text"))
    return P.parse_turns(files, "item_id").withColumnRenamed("source_file", "doc_id")


@query(f"SELECT doc_id, 0 AS idx, 'assistant' AS role, {_strip('text')} AS content FROM documents")
def doc_turns(spark: SparkSession, d: str) -> DataFrame:
    return P.parse_turns(B.table(spark, d, "documents"), "doc_id").withColumnRenamed("source_file", "doc_id")


@query(f"""
SELECT doc_id || ':t0:c0' AS chunk_id, doc_id, 0 AS chunk_index, content,
  CASE WHEN regexp_matches(content, '^[-*]\\s') OR regexp_matches(content, '^\\d+\\.\\s') THEN 'list'
       WHEN regexp_matches(content, '^[A-Z][\\p{{L}}\\p{{N}}_\\s]{{2,30}}(?:is|refers to|means|describes|represents)\\b') THEN 'definition' ELSE 'prose' END AS chunk_type
FROM (SELECT doc_id, {_strip('text')} AS content FROM documents) WHERE content <> ''
""")
def doc_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The documents have neither fences nor blank lines: each is one chunk."""
    chunks = P.chunk_turns(P.parse_turns(B.table(spark, d, "documents"), "doc_id"))
    return chunks.select("chunk_id", F.col("source_file").alias("doc_id"), "chunk_index", "chunk_type", "content")


_BATCHES = f"""
ch AS (SELECT conv_id::VARCHAR AS source_file, turn, {_strip('text')} AS content FROM conversations WHERE role = 'assistant' AND {_strip('text')} <> ''),
num AS (SELECT *, source_file || ':t' || turn || ':c0' AS chunk_id, length(content) AS n, row_number() OVER (PARTITION BY source_file ORDER BY turn) AS i FROM ch),
fold AS (SELECT source_file, i, chunk_id, content, 0 AS batch, n AS used FROM num WHERE i = 1
  UNION ALL SELECT m.source_file, m.i, m.chunk_id, m.content, CASE WHEN f.used > 0 AND f.used + m.n > 6000 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.used > 0 AND f.used + m.n > 6000 THEN m.n ELSE f.used + m.n END
  FROM fold f JOIN num m ON m.source_file = f.source_file AND m.i = f.i + 1),
batches AS (SELECT source_file, batch, string_agg(chunk_id, ' ' ORDER BY i) AS chunk_ids, string_agg(content, chr(10) || chr(10) ORDER BY i) AS content FROM fold GROUP BY source_file, batch)"""


@query(f"WITH RECURSIVE {_BATCHES} SELECT source_file, batch, chunk_ids, content FROM batches")
def chunk_batches(spark: SparkSession, d: str) -> DataFrame:
    """The turns have neither fences nor blank lines: each is one chunk."""
    turns = B.turns(spark, d).where("role = 'assistant'")
    return P.batch_chunks(P.chunk_turns(turns)).withColumn("chunk_ids", F.array_join("chunk_ids", " "))


_ONE_FILE = f"""ch AS (SELECT doc_id, length({_strip('text')})::BIGINT AS n FROM documents WHERE {_strip('text')} <> ''),
num AS (SELECT doc_id, n, row_number() OVER (ORDER BY doc_id) - 1 AS pos, sum(n) OVER (ORDER BY doc_id)::BIGINT AS e FROM ch),
starts AS (SELECT 0::BIGINT AS pos, 0 AS batch UNION ALL SELECT min(c.pos), s.batch + 1 FROM starts s JOIN num a ON a.pos = s.pos JOIN num c ON c.pos > s.pos AND c.e > a.e - a.n + 6000 GROUP BY s.batch HAVING min(c.pos) IS NOT NULL)"""


@query(f"WITH RECURSIVE {_ONE_FILE} SELECT n.doc_id, max(s.batch) AS batch FROM num n JOIN starts s ON s.pos <= n.pos GROUP BY n.doc_id")
def one_file_batches(spark: SparkSession, d: str) -> DataFrame:
    """The batches of a single file that holds all documents, a turn each."""
    text = T.stripped(F.col("text"))
    rows = B.table(spark, d, "documents").select(F.lit("all").alias("source_file"), F.col("doc_id").alias("turn_index"), F.lit(0).alias("chunk_index"), F.col("doc_id").cast("string").alias("chunk_id"), F.length(text).alias("n")).where("n > 0")
    return Z.batch_numbers(rows).select(F.col("chunk_id").cast("bigint").alias("doc_id"), "batch")


@query(f"""SELECT (row_number() OVER (ORDER BY conv_id, turn) - 1)::INTEGER AS idx, CASE role WHEN 'user' THEN 'human' ELSE role END AS role, {_strip('text')} AS content
FROM conversations WHERE {_strip('text')} <> ''""")
def one_file_turns(spark: SparkSession, d: str) -> DataFrame:
    """The turns of a single transcript that holds all conversations, from its lines."""
    said = F.concat(F.initcap("role"), F.lit(": "), "text")
    lines = B.table(spark, d, "conversations").where("role in ('user', 'assistant', 'system')").select(F.lit("all").alias("source_file"), F.col("conv_id").alias("block"), "turn", F.posexplode(F.split(said, "\n", -1)).alias("i", "line"))
    return Z.turns_of_lines(lines.withColumn("at", F.struct("turn", "i"))).select("idx", "role", "content")


def _extracted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    chunks = G.stored(P.chunk_turns(B.turns(spark, d).where("role = 'assistant'")))
    return X.extract_concepts(P.batch_chunks(chunks), chunks)


_RAW = f"""{_BATCHES}, bs AS (SELECT source_file, batch, unnest(l) AS s, generate_subscripts(l, 1) AS si FROM (SELECT source_file, batch, string_split_regex(content, '[.!?]\\s+') AS l FROM batches)),
bf AS (SELECT source_file, batch, si, s, unnest(p) AS name, generate_subscripts(p, 1) AS pi FROM (SELECT *, regexp_extract_all(regexp_replace(s, '[^\\x00-\\x7F]', '_', 'g'), '{_TITLE}', 1) AS p FROM bs)),
bn AS (SELECT *, row_number() OVER (PARTITION BY source_file, batch, name ORDER BY si, pi) AS k FROM bf WHERE length(name) >= 3),
br AS (SELECT *, (row_number() OVER (PARTITION BY source_file, batch ORDER BY si, pi) - 1)::INTEGER AS rank FROM bn WHERE k = 1),
found AS (SELECT source_file, batch, rank, lower(name) AS low, name, substr({_strip('s')}, 1, 300) AS definition FROM br WHERE rank < 3)"""
_STANDS = lambda text: f"(regexp_matches(lower({text}), '(^|[^a-z0-9])' || low || '($|[^a-z0-9])') OR (low LIKE '%s' AND length(low) > 3 AND regexp_matches(lower({text}), '(^|[^a-z0-9])' || substr(low, 1, length(low) - 1) || '($|[^a-z0-9])')))"


@query(f"""WITH RECURSIVE {_RAW}, kept AS (SELECT f.*, row_number() OVER (PARTITION BY low, f.source_file ORDER BY f.batch, rank) AS first FROM found f JOIN batches b USING (source_file, batch) WHERE {_STANDS('substr(b.content, 1, 6000)')})
SELECT k.source_file, k.batch, k.rank, k.name, string_agg(o.chunk_id, ' ' ORDER BY o.i) AS source_chunks FROM kept k JOIN fold o ON o.source_file = k.source_file AND o.batch = k.batch AND {_STANDS('o.content')} WHERE first = 1 GROUP BY ALL""")
def raw_concepts(spark: SparkSession, d: str) -> DataFrame:
    """Concepts of batches of chunks, with those of the chunks that name them."""
    raw = _extracted(spark, d)[0]
    return raw.select("source_file", "batch", "rank", "name", F.array_join("source_chunks", " ").alias("source_chunks"))


@query(f"""WITH RECURSIVE {_RAW}, told AS (SELECT {_STANDS('substr(b.content, 1, 6000)')} AS ok FROM found f JOIN batches b USING (source_file, batch))
SELECT (SELECT count(*) FROM fold) AS chunks_processed, (SELECT count(*) FROM batches) AS calls, (SELECT count(*) FROM told WHERE ok) AS concepts_extracted, 0::BIGINT AS parse_failures, (SELECT count(*) FROM told WHERE NOT ok) AS rejected_by_grounding""")
def extraction_counters(spark: SparkSession, d: str) -> DataFrame:
    return _extracted(spark, d)[1]


_DEDUP = f"""{_mentions('assistant')},
raw AS (SELECT slug, name, definition AS content, source_file, row_number() OVER (ORDER BY source_file, idx, rank) AS ord FROM mentions WHERE slug <> ''),
lead AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY length(content) DESC, ord) = 1 AS is_first FROM raw),
turned AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY is_first DESC, ord) - 1 AS turn FROM lead),
own AS (SELECT slug, min(turn) AS turn, lower({_strip('content')}) AS low FROM turned GROUP BY slug, low),
new AS (SELECT t.slug, string_agg({_strip('t.content')}, chr(10) || chr(10) ORDER BY t.turn) AS added FROM turned t JOIN own o ON o.slug = t.slug AND o.turn = t.turn WHERE t.turn > 0 GROUP BY t.slug),
one AS (SELECT t.slug, t.name, CASE WHEN n.added IS NULL THEN t.content ELSE substr(t.content || chr(10) || chr(10) || n.added, 1, 5000) END AS content, (SELECT min(ord) FROM raw r WHERE r.slug = t.slug) AS ord FROM turned t LEFT JOIN new n ON n.slug = t.slug WHERE t.turn = 0),
ws AS (SELECT *, list_distinct(regexp_extract_all(lower(name), '[\\p{{L}}\\p{{N}}_]+')) AS nw, list_distinct(regexp_extract_all(lower(substr(content, 1, 500)), '[\\p{{L}}\\p{{N}}_]+')) AS cw, row_number() OVER (ORDER BY ord) AS k FROM one),
sim AS (SELECT a.k AS a, b.k AS b FROM ws a JOIN ws b ON a.k < b.k WHERE (len(a.nw) > 0 AND len(b.nw) > 0 AND len(list_intersect(a.nw, b.nw)) / (len(a.nw) + len(b.nw) - len(list_intersect(a.nw, b.nw))) > 0.6)
  OR (len(a.cw) > 0 AND len(b.cw) > 0 AND len(list_intersect(a.cw, b.cw)) / (len(a.cw) + len(b.cw) - len(list_intersect(a.cw, b.cw))) > 0.75)),
before AS (SELECT w.k, coalesce(list(s.a) FILTER (s.a IS NOT NULL), []) AS near FROM ws w LEFT JOIN sim s ON s.b = w.k GROUP BY w.k),
heads AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS kept UNION ALL SELECT b.k, CASE WHEN len(list_intersect(h.kept, b.near)) = 0 THEN list_append(h.kept, b.k) ELSE h.kept END FROM heads h JOIN before b ON b.k = h.k + 1),
final AS (SELECT kept FROM heads ORDER BY k DESC LIMIT 1),
joined AS (SELECT w.k, w.slug, CASE WHEN list_contains((SELECT kept FROM final), w.k) THEN w.k ELSE list_min(list_intersect((SELECT kept FROM final), b.near)) END AS head FROM ws w JOIN before b USING (k))"""


@query(f"WITH RECURSIVE {_DEDUP} SELECT w.slug, w.name, count(*) AS members, count(DISTINCT r.source_file) AS files FROM joined j JOIN ws w ON w.k = j.head JOIN raw r ON r.slug = j.slug GROUP BY w.slug, w.name".replace("count(*) AS members", "count(DISTINCT j.k) AS members"))
def deduplicated_concepts(spark: SparkSession, d: str) -> DataFrame:
    """Raw concepts merged by slug, then by similar names or contents."""
    out = D.deduplicate(_raw_mentions(spark, d))
    return out.select("slug", "name", "members", F.size("source_files").cast("long").alias("files"))


def _raw_mentions(spark: SparkSession, d: str) -> DataFrame:
    rows = B.mentions(spark, d).where(T.slugify(F.col("name")) != "")
    place = F.struct("source_file", "idx", "rank")
    return G.stored(rows.select(place.alias("ord"), "name", F.col("definition").alias("raw_content"), F.array(F.concat_ws(":", "source_file", "idx")).alias("source_chunks"), F.array("source_file").alias("source_files"), F.lit("llm").alias("extraction_method"), F.lit(0.9).alias("confidence")))


@query(f"WITH {_DEDUP.split('ws AS (')[0].rstrip().rstrip(',')} SELECT slug, name, content AS raw_content FROM one")
def merged_by_slug(spark: SparkSession, d: str) -> DataFrame:
    """Raw concepts of one slug as one, each paragraph once."""
    return D.merge_by_slug(_raw_mentions(spark, d)).select("slug", "name", "raw_content")


_VISIBLE = "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<head\\b.*?</head\\s*>', ' ', 'g'), '(?i)</p>|</div>|</li>|</h[1-6]>|<br\\s*/?>', chr(10), 'g'), '<[^>]*>', '', 'g')"
for _code, _sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _VISIBLE = f"replace({_VISIBLE}, '{_code}', '{_sign}')"


@query(f"SELECT page_id, 0 AS idx, 'assistant' AS role, {_strip('text')} AS content FROM (SELECT page_id, {_VISIBLE} AS text FROM pages)")
def page_turns(spark: SparkSession, d: str) -> DataFrame:
    """Extension: pages as transcripts, through the reader for HTML."""
    pages = B.table(spark, d, "pages").select("page_id", S.page_text(F.col("html")).alias("text"))
    return P.parse_turns(pages, "page_id").withColumnRenamed("source_file", "page_id")


# --- concepts -----------------------------------------------------------------------------------


@query(f"WITH {_mentions('assistant')} SELECT source_file, idx, rank, name, definition FROM mentions")
def mock_concepts(spark: SparkSession, d: str) -> DataFrame:
    return B.mentions(spark, d)


@query(f"""WITH {_mentions('assistant')}, w AS (SELECT DISTINCT source_file, lower(name) AS name FROM mentions), t AS (SELECT conv_id::VARCHAR AS source_file, turn AS idx, lower(text) AS low FROM conversations)
SELECT t.source_file, t.idx, w.name, regexp_matches(low, '(^|[^a-z0-9])' || name || '($|[^a-z0-9])')
   OR (name LIKE '%s' AND length(name) > 3 AND regexp_matches(low, '(^|[^a-z0-9])' || substr(name, 1, length(name) - 1) || '($|[^a-z0-9])')) AS grounded
FROM t JOIN w USING (source_file)""")
def concept_grounding(spark: SparkSession, d: str) -> DataFrame:
    """Whether each name of a conversation stands in each of its turns."""
    names = B.mentions(spark, d).select("source_file", F.lower("name").alias("name")).distinct()
    rows = B.turns(spark, d).join(names, "source_file")
    return rows.select("source_file", "idx", "name", C.is_grounded(F.col("name"), F.col("content")).alias("grounded"))


@query(f"WITH {_concepts()} SELECT name, slug, definition, array_to_string(tags, ' ') AS tags, array_to_string(source_files, ' ') AS source_files, confidence, mentions, hash FROM concepts")
def concept_groups(spark: SparkSession, d: str) -> DataFrame:
    c = B.concepts(spark, d)
    return c.select("name", "slug", "definition", F.array_join("tags", " ").alias("tags"), F.array_join("source_files", " ").alias("source_files"), "confidence", "mentions", "hash")


@query(f"""WITH {_mentions('assistant')}
SELECT slug, source_file AS transcript_path, array_to_string(list(DISTINCT idx ORDER BY idx), ' ') AS turn_indices, arg_min(definition, {{'idx': idx, 'd': definition}}) AS snippet
FROM mentions WHERE slug <> '' GROUP BY slug, source_file""")
def concept_provenance(spark: SparkSession, d: str) -> DataFrame:
    return C.provenance(B.mentions(spark, d)).withColumn("turn_indices", F.array_join(F.col("turn_indices").cast("array<string>"), " "))


@query(f"WITH {_mentions('assistant')} SELECT lower(name) AS name, source_file, idx FROM (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY source_file, idx, rank) AS k FROM mentions) WHERE k = 1")
def first_names(spark: SparkSession, d: str) -> DataFrame:
    return C.first_wins(B.mentions(spark, d), ["source_file", "idx", "rank"]).select(F.lower("name").alias("name"), "source_file", "idx")


@query(f"""
SELECT conv_id, turn, {_strip('''regexp_replace(regexp_replace(regexp_replace(text, '(?i)\\b(?:sure|absolutely|definitely|of course)[!,.]?\\s*', '', 'g'), '(?i)\\b(?:you''re right|exactly|precisely)\\b[!,.]?\\s*', '', 'g'), '(?i)\\b(?:in (?:our|the|this) (?:conversation|discussion|chat))\\b[,.]?\\s*', '', 'g')''')} AS text
FROM (SELECT conv_id, turn, 'Sure, ' || text || ' of course. In this chat, exactly. And so on' AS text FROM conversations)
""")
def fluff_clean(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit("Sure, "), "text", F.lit(" of course. In this chat, exactly. And so on"))
    return B.table(spark, d, "conversations").select("conv_id", "turn", C.remove_fluff(said).alias("text"))


def _named_texts(spark: SparkSession, d: str) -> DataFrame:
    """Each concept of each assistant turn, with the sentences of the turn."""
    named = B.mentions(spark, d).select("source_file", "idx", "rank", "name")
    return B.turns(spark, d).join(named, ["source_file", "idx"]).select("source_file", "idx", "rank", "name", "content", T.sentences(F.col("content")).alias("parts"))


_NAMED = f"""{_mentions('assistant')}, named AS (
  SELECT m.source_file, m.idx, m.rank, m.name, {_sentences('c.text')} AS parts
  FROM mentions m JOIN conversations c ON c.conv_id::VARCHAR = m.source_file AND c.turn = m.idx
), defined AS (
  SELECT *, {_squeeze("array_to_string((CASE WHEN len(list_filter(parts, lambda s: contains(lower(s), lower(name)))) > 0 THEN list_filter(parts, lambda s: contains(lower(s), lower(name))) ELSE parts END)[1:3], ' ')")} AS definition FROM named
)"""


@query(f"WITH {_NAMED} SELECT source_file, idx, rank, name, definition FROM defined")
def definitions(spark: SparkSession, d: str) -> DataFrame:
    return _named_texts(spark, d).select("source_file", "idx", "rank", "name", C.build_definition(F.col("name"), F.col("parts")).alias("definition"))


@query(f"""WITH {_NAMED}, s AS (
  SELECT source_file, idx, rank, definition, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM defined
), n AS (
  SELECT *, lower({_squeeze('part')}) AS norm, lower(definition) AS known FROM s
), u AS (
  SELECT *, row_number() OVER (PARTITION BY source_file, idx, rank, norm ORDER BY i) AS k,
    list_distinct(regexp_extract_all(norm, '[\\p{{L}}\\p{{N}}_]+')) AS a, list_distinct(regexp_extract_all(known, '[\\p{{L}}\\p{{N}}_]+')) AS b FROM n
), f AS (
  SELECT *, row_number() OVER (PARTITION BY source_file, idx, rank ORDER BY i) AS r FROM u
  WHERE k = 1 AND NOT contains(known, norm) AND NOT contains(norm, known)
    AND (len(a) = 0 OR len(b) = 0 OR len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) <= 0.7)
), e AS (
  SELECT source_file, idx, rank, {_squeeze("string_agg(part, ' ' ORDER BY i)")} AS explanation FROM f WHERE r <= 8 GROUP BY source_file, idx, rank
)
SELECT d.source_file, d.idx, d.rank, coalesce(e.explanation, '') AS explanation FROM defined d LEFT JOIN e USING (source_file, idx, rank)""")
def explanations(spark: SparkSession, d: str) -> DataFrame:
    rows = _named_texts(spark, d).withColumn("definition", C.build_definition(F.col("name"), F.col("parts")))
    return rows.select("source_file", "idx", "rank", C.build_explanation(F.col("parts"), F.col("definition")).alias("explanation"))


_TELLS = " OR ".join(f"contains(lower(s), '{p}')" for p in C.KEY_PHRASES)


@query(f"""
WITH s AS (
  SELECT conv_id, turn, i, {_squeeze('s')} AS s FROM (SELECT conv_id, turn, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (SELECT conv_id, turn, {_sentences('text')} AS l FROM (SELECT conv_id, turn, 'Note that ' || text || ' This is a key benefit.' AS text FROM conversations)))
), k AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn, lower(s) ORDER BY i) AS k FROM s WHERE ({_TELLS}) AND length(s) > 15
)
SELECT conv_id, turn, string_agg(s, ' | ' ORDER BY i) AS insights FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS r FROM k WHERE k = 1) WHERE r <= 10 GROUP BY conv_id, turn
""")
def key_insights(spark: SparkSession, d: str) -> DataFrame:
    rows = B.table(spark, d, "conversations").select("conv_id", "turn", C.insights(F.concat(F.lit("Note that "), "text", F.lit(" This is a key benefit.")), F.lit("\u0003")).alias("i"))
    return rows.where(F.size("i") > 0).select("conv_id", "turn", F.array_join("i", " | ").alias("insights"))


@query(f"""WITH {_concepts()}, {_concepts('user', 'u_')}, v AS (
  SELECT 1 AS o, * FROM concepts UNION ALL SELECT 2 AS o, * FROM u_concepts
), t AS (SELECT slug, string_agg(x, ' ' ORDER BY o, i) AS tags FROM (
  SELECT slug, x, min(o * 100 + i) // 100 AS o, min(o * 100 + i) AS i FROM (SELECT slug, o, unnest(tags) AS x, generate_subscripts(tags, 1) AS i FROM v) GROUP BY slug, x) GROUP BY slug)
SELECT v.slug, arg_min(v.name, v.o) AS name, arg_max(v.definition, {{'n': length(v.definition), 'o': -v.o}}) AS definition, max(v.confidence) AS confidence, coalesce(any_value(t.tags), '') AS tags
FROM v LEFT JOIN t ON t.slug = v.slug GROUP BY v.slug""")
def merged_concepts(spark: SparkSession, d: str) -> DataFrame:
    """Concepts of the assistant's turns merged with those of the users'."""
    one, two = B.concepts(spark, d).withColumn("o", F.lit(1)), B.concepts(spark, d, "human").withColumn("o", F.lit(2))
    versions = one.unionByName(two).withColumn("explanation", F.lit("")).withColumn("deleted_at", F.lit(None).cast("timestamp"))
    return C.merge_concepts(versions, "o").select("slug", "name", "definition", "confidence", F.array_join("tags", " ").alias("tags"))


@query()
def parsed_replies(spark: SparkSession, d: str) -> DataFrame:
    """Model replies in a fence, as every assistant turn would give them, parsed to concepts and distilled."""
    concept = F.struct(F.array(F.struct(F.col("name"), F.col("definition"), F.array("definition").alias("insights"), F.array(F.lit("a"), F.lit("b")).alias("tags"), F.array(F.struct(F.lit("The").alias("target"), F.lit("uses").alias("type"))).alias("relationships"))).alias("concepts"))
    replies = B.mentions(spark, d).select("source_file", "idx", "rank", F.concat(F.lit("```json\n"), F.to_json(concept), F.lit("\n```")).alias("reply"))
    rows = C.distill_marked(C.parse_reply(replies, ["source_file", "idx", "rank"]))
    return rows.select("source_file", "idx", "rank", "name", "definition", F.array_join("tags", " ").alias("tags"), F.array_join("links", " ").alias("links"), F.col("relationships")[0]["target"].alias("target"))


ORACLE_SQL["parsed_replies"] = f"WITH {_mentions('assistant')} SELECT source_file, idx, rank, name, {_squeeze('definition')} AS definition, 'a b' AS tags, 'The' AS links, 'the' AS target FROM mentions WHERE definition NOT LIKE '- %' AND definition NOT LIKE 'Examples:%'"


# --- links and graph ----------------------------------------------------------------------------


@query(f"WITH {_concepts()}, {_links()} SELECT source, target, score, confidence FROM links")
def links_scored(spark: SparkSession, d: str) -> DataFrame:
    return B.links(spark, d).select("source", "target", "score", "confidence")


@query(f"WITH {_concepts()}, {_links()} SELECT source, target, type FROM links")
def links_typed(spark: SparkSession, d: str) -> DataFrame:
    return B.links(spark, d).select("source", "target", "type")


@query(f"""WITH {_concepts()}, t AS (SELECT slug, lower(definition) || ' ' AS text FROM concepts)
SELECT t.slug, c.slug AS target, ((length(text) - length(replace(text, lower(c.name), ''))) // length(c.name))::INTEGER AS n FROM t JOIN concepts c ON contains(text, lower(c.name))""")
def name_mentions(spark: SparkSession, d: str) -> DataFrame:
    c = G.stored(B.concepts(spark, d))
    texts = c.select(F.col("slug").alias("key"), F.concat("definition", F.lit(" ")).alias("text"))
    return N.mention_counts(texts, c.select(F.col("slug").alias("target"), "name")).withColumnRenamed("key", "slug")


@query(f"WITH {_concepts()}, {_links()} SELECT source, target, type, score FROM links")
def links_after_changes(spark: SparkSession, d: str) -> DataFrame:
    """The store held what users said and comes to hold what assistants say: links by the changed concepts alone."""
    before, after = G.stored(B.concepts(spark, d, "human")), G.stored(B.concepts(spark, d))
    links = G.stored(K.score_links(before))
    return K.relink(links, after, G.stored(K.changed_concepts(before, after))).select("source", "target", "type", "score")


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The concepts and their edges, each computed once and then walked along several times."""
    concepts = G.stored(B.concepts(spark, d))
    nodes, edges = G.build(concepts, K.score_links(concepts))
    return nodes, G.stored(edges)


@query(f"WITH {_concepts()} SELECT slug, name FROM concepts")
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return B.concepts(spark, d).select("slug", "name")


@query(f"{_GRAPH} SELECT source, target, type, max(confidence) AS confidence FROM links GROUP BY ALL")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d)[1].select("source", "target", "type", "confidence")


@query(f"{_GRAPH} SELECT a AS slug, b AS neighbor FROM both_ways")
def neighbors(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    return G.neighbors(edges, nodes)


@query(f"""{_GRAPH}, e AS (SELECT source AS slug FROM pairs UNION ALL SELECT target FROM pairs), g AS (SELECT slug, count(*) AS degree FROM e GROUP BY slug)
SELECT c.slug, coalesce(g.degree, 0) AS degree, coalesce(g.degree, 0) / ((SELECT count(*) FROM concepts) - 1) AS centrality FROM concepts c LEFT JOIN g USING (slug)""")
def degree_centrality(spark: SparkSession, d: str) -> DataFrame:
    return G.degree_centrality(*_graph(spark, d))


_REACH = "reach AS (SELECT slug AS a, slug AS b FROM concepts UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON e.a = r.b), clusters AS (SELECT a AS slug, min(b) AS cluster FROM reach GROUP BY a)"
_RECURSIVE = _GRAPH.replace("WITH", "WITH RECURSIVE", 1)


@query(f"""{_RECURSIVE}, {_REACH}, n AS (SELECT (SELECT count(*) FROM concepts) AS nodes, (SELECT count(*) FROM (SELECT DISTINCT source, target, type FROM links)) AS edges, (SELECT count(*) FROM pairs) AS pairs, (SELECT count(DISTINCT cluster) FROM clusters) AS clusters)
SELECT nodes, edges, pairs, clusters, round(CASE WHEN nodes > 1 THEN pairs / (nodes * (nodes - 1)) ELSE 0.0 END, 4) AS density FROM n""")
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return G.stats(*_graph(spark, d))


@query(f"{_RECURSIVE}, {_REACH} SELECT slug, cluster FROM clusters")
def components(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    return G.clusters(nodes, G.forest(edges))


@query(f"{_RECURSIVE}, {_REACH} SELECT slug, cluster FROM clusters")
def components_after_changes(spark: SparkSession, d: str) -> DataFrame:
    """The graph was that of what users said and comes to be that of the assistants': clusters by the difference."""
    before, after = G.stored(B.concepts(spark, d, "human")), G.stored(B.concepts(spark, d))
    changed = G.stored(K.changed_concepts(before, after))
    linked = lambda c: K.marked_ends(K.score_links(G.stored(K.marked(c, changed))))
    old = G.stored(G.forest(linked(before)))
    added = G.stored(G.forest(linked(after).where("not kept")))
    return G.reclustered_around(G.clusters(before, old), after, old.where("kept"), added, changed)


@query(f"""{_GRAPH}, seed AS (SELECT slug FROM concepts ORDER BY mentions DESC, slug LIMIT 1), r1 AS (SELECT DISTINCT b AS slug FROM both_ways WHERE a IN (SELECT slug FROM seed)),
r2 AS (SELECT DISTINCT b AS slug FROM both_ways WHERE a IN (SELECT slug FROM r1)),
n AS (SELECT slug FROM seed UNION SELECT slug FROM r1 UNION SELECT slug FROM r2)
SELECT source, target, type FROM links WHERE source IN (SELECT slug FROM n) AND target IN (SELECT slug FROM n)""")
def subgraph(spark: SparkSession, d: str) -> DataFrame:
    """The edges around the concept that is mentioned most."""
    nodes, edges = _graph(spark, d)
    return G.subgraph(edges, R.top(nodes, "mentions", "slug", 1), 2)[1].select("source", "target", "type")


def _hops(n: int) -> str:
    """CTEs ``d1`` .. ``dn`` of nodes at that distance from the start, and ``p1`` .. of the shortest paths to them."""
    out = ["d0 AS (SELECT slug FROM concepts ORDER BY mentions DESC, slug LIMIT 1)", "p0 AS (SELECT slug AS b, slug AS path FROM d0)"]
    for k in range(1, n + 1):
        nearer = " UNION ALL ".join(f"SELECT slug FROM d{i}" for i in range(k))
        out.append(f"d{k} AS (SELECT DISTINCT b AS slug FROM both_ways WHERE a IN (SELECT slug FROM d{k - 1}) AND b NOT IN ({nearer}))")
        out.append(f"p{k} AS (SELECT e.b, p.path || chr(1) || e.b AS path FROM p{k - 1} p JOIN both_ways e ON e.a = p.b WHERE e.b IN (SELECT slug FROM d{k}))")
    return ", ".join(out)


_PATHS = f"""{_GRAPH}, {_hops(4)}, allp AS ({' UNION ALL '.join(f'SELECT * FROM p{k}' for k in range(1, 5))}),
routes AS (SELECT (SELECT slug FROM d0) AS a, b, row_number() OVER (PARTITION BY b ORDER BY path)::INTEGER AS rank, replace(path, chr(1), ' > ') AS path FROM allp)"""


@query(f"{_PATHS} SELECT a, b, rank, path FROM routes WHERE rank <= 3")
def shortest_paths(spark: SparkSession, d: str) -> DataFrame:
    """From the most mentioned concept to every other."""
    nodes, edges = _graph(spark, d)
    start = R.top(nodes, "mentions", "slug", 1).select(F.col("slug").alias("a"))
    pairs = nodes.select(F.col("slug").alias("b")).join(F.broadcast(start))  # one row
    return G.shortest_paths(edges, pairs).select("a", "b", "rank", F.array_join("path", " > ").alias("path"))


@query(f"""{_PATHS}, steps AS (SELECT b, generate_subscripts(l, 1) AS i, l[generate_subscripts(l, 1)] AS x, l[generate_subscripts(l, 1) + 1] AS y FROM (SELECT b, string_split(path, ' > ') AS l FROM routes WHERE rank = 1)),
kinds AS (SELECT source, target, min(type) AS type FROM links GROUP BY source, target)
SELECT s.b, string_agg(coalesce(f.type, r.type), ' ' ORDER BY i) AS edge_types FROM steps s LEFT JOIN kinds f ON f.source = s.x AND f.target = s.y LEFT JOIN kinds r ON r.source = s.y AND r.target = s.x WHERE s.y IS NOT NULL GROUP BY s.b""")
def path_types(spark: SparkSession, d: str) -> DataFrame:
    """The types of the edges along the first shortest path from the most mentioned concept to each other."""
    nodes, edges = _graph(spark, d)
    start = R.top(nodes, "mentions", "slug", 1).select(F.col("slug").alias("a"))
    pairs = nodes.select(F.col("slug").alias("b")).join(F.broadcast(start))  # one row
    return A.typed_paths(G.shortest_paths(edges, pairs, keep=1), edges).select("b", F.array_join("edge_types", " ").alias("edge_types"))


@query(f"{_GRAPH}, e AS (SELECT DISTINCT ON (source, target) source, target, type, confidence FROM links ORDER BY source, target, confidence DESC, type DESC) SELECT source, target, type, confidence FROM e")
def surest_edges(spark: SparkSession, d: str) -> DataFrame:
    """Outgoing neighbours with the surest edge to each."""
    return G.outgoing_types(_graph(spark, d)[1])


_WALK = f"""{_keyword('(SELECT slug, name || chr(32) || definition AS t FROM concepts)', 'slug', 't')},
seeds AS (SELECT slug, score FROM kw ORDER BY score DESC, slug LIMIT 10),
h1 AS (SELECT s.slug AS seed, s.score AS sigma, p.target AS mid, p.confidence FROM seeds s JOIN pairs p ON p.source = s.slug WHERE p.target <> s.slug),
h2 AS (SELECT h.seed, h.sigma, p.target, p.confidence FROM h1 h JOIN pairs p ON p.source = h.mid WHERE p.target <> h.seed AND p.target <> h.mid),
parts AS (SELECT slug, score AS s FROM seeds UNION ALL SELECT mid, sigma * confidence * 0.5 FROM h1 UNION ALL SELECT target, sigma * confidence * 0.2 FROM h2),
wraw AS (SELECT slug, sum(s) AS raw FROM parts GROUP BY slug),
walk AS (SELECT slug, raw / (SELECT max(raw) FROM wraw) AS score FROM wraw),
fused AS (SELECT slug, round(0.6 * coalesce(k.score, 0) + 0.4 * coalesce(w.score, 0), 9) AS total FROM kw k FULL JOIN walk w USING (slug))"""


@query(f"{_GRAPH}, {_WALK} SELECT slug, round(score, 9) AS score FROM walk")
def graph_walk(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    kw = R.keyword_scores(nodes, "slug", R.concept_text(nodes), ASKED)
    return G.walk_scores(R.seed_pool(kw, kw.limit(0)), nodes, edges).select("slug", F.round("score", 9).alias("score"))


# --- retrieval ----------------------------------------------------------------------------------


@query(f"WITH {_concepts()}, {_keyword('(SELECT slug, name || chr(32) || definition AS t FROM concepts)', 'slug', 't')} SELECT slug, round(score, 9) AS score FROM kw ORDER BY score DESC, slug LIMIT 10")
def keyword_topk(spark: SparkSession, d: str) -> DataFrame:
    c = B.concepts(spark, d)
    kw = R.keyword_scores(c, "slug", R.concept_text(c), ASKED).withColumn("score", F.round("score", 9))
    return R.top(kw, "score", "slug", 10)


@query(f"WITH {_keyword('documents', 'doc_id', 'text')} SELECT doc_id, round(score, 9) AS score FROM kw ORDER BY round(score, 9) DESC, doc_id LIMIT 20")
def document_topk(spark: SparkSession, d: str) -> DataFrame:
    kw = R.keyword_scores(B.table(spark, d, "documents"), "doc_id", F.col("text"), ASKED).withColumn("score", F.round("score", 9))
    return R.top(kw, "score", "doc_id", 20)


@query(f"WITH {_keyword('documents', 'doc_id', 'text')} SELECT doc_id::VARCHAR AS key, round(score, 9) AS score FROM kw ORDER BY round(score, 12) DESC, doc_id::VARCHAR LIMIT 20")
def index_topk(spark: SparkSession, d: str) -> DataFrame:
    """The texts that fit a question best, through a stored index."""
    index = I.KeywordIndex(spark, O.scratch(spark, "index"))
    index.build(B.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("key"), "text"))
    return index.search(ASKED, 20).withColumn("score", F.round("score", 9))


_BOTH = "(SELECT doc_id::VARCHAR AS key, text FROM documents UNION ALL SELECT item_id::VARCHAR, text FROM benchmark WHERE item_id NOT IN (SELECT doc_id FROM documents))"


@query(f"WITH {_keyword(_BOTH, 'key', 'text')} SELECT key, round(score, 9) AS score FROM kw ORDER BY round(score, 12) DESC, key LIMIT 20")
def index_after_update(spark: SparkSession, d: str) -> DataFrame:
    """An index of the benchmark into which the documents come; those of equal keys replace its items."""
    index = I.KeywordIndex(spark, O.scratch(spark, "index"))
    index.build(B.table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("key"), "text"))
    index.update(B.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("key"), "text"))
    return index.search(ASKED, 20).withColumn("score", F.round("score", 9))


_VECTOR = """
q AS (SELECT embedding FROM embeddings WHERE vec_id = 0),
cos AS (SELECT vec_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])), 6) AS cosine FROM embeddings e, q),
sem AS (SELECT vec_id, cosine, round(cosine / max(cosine) OVER (), 6) AS score FROM (SELECT * FROM cos ORDER BY cosine DESC, vec_id LIMIT 50))"""


def _semantic(spark: SparkSession, d: str) -> DataFrame:
    vectors = B.table(spark, d, "embeddings")
    asked = vectors.where("vec_id = 0").select("embedding").head()[0]  # one vector
    best = R.vector_scores(vectors, "vec_id", "embedding", F.array(*(F.lit(float(x)) for x in asked)), digits=6)
    return best.select("vec_id", "cosine", F.round("score", 6).alias("score"))


@query(f"WITH {_VECTOR} SELECT vec_id, cosine, score FROM sem")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return _semantic(spark, d)


@query(f"WITH {_VECTOR} SELECT vec_id, cosine, score FROM sem")
def vector_cells_topk(spark: SparkSession, d: str) -> DataFrame:
    """The nearest vectors, through stored cells of which few are opened."""
    vectors = B.table(spark, d, "embeddings")
    cells = W.VectorCells(spark, O.scratch(spark, "cells"))
    cells.build(vectors.select(F.format_string("%019d", "vec_id").alias("key"), F.col("embedding").alias("vector")))
    asked = vectors.where("vec_id = 0").select("embedding").head()[0]  # one vector
    return cells.nearest([float(x) for x in asked], 50, digits=6).select(F.col("key").cast("bigint").alias("vec_id"), "cosine", F.round("score", 6).alias("score"))


@query(f"""WITH {_VECTOR}, {_keyword('documents', 'doc_id', 'text')},
k AS (SELECT doc_id AS slug, round(score, 9) AS score FROM kw ORDER BY round(score, 9) DESC, doc_id LIMIT 10),
v AS (SELECT vec_id AS slug, score FROM sem ORDER BY score DESC, vec_id LIMIT 10)
SELECT slug, max(score) AS score FROM (SELECT * FROM k UNION ALL SELECT * FROM v) WHERE score > 0 GROUP BY slug""")
def seed_pool(spark: SparkSession, d: str) -> DataFrame:
    kw = R.keyword_scores(B.table(spark, d, "documents"), "doc_id", F.col("text"), ASKED).select(F.col("doc_id").alias("slug"), F.round("score", 9).alias("score"))
    return R.seed_pool(kw, _semantic(spark, d).select(F.col("vec_id").alias("slug"), "score"))


@query(f"{_GRAPH}, {_WALK} SELECT slug, total FROM fused WHERE total > 0 ORDER BY total DESC, slug LIMIT 10")
def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    return R.top(R.hybrid(nodes, edges, ASKED), "total", "slug", 10).select("slug", "total")


@query(f"""{_GRAPH}, {_WALK}, hits AS (SELECT slug, round(total, 3) AS total, row_number() OVER (ORDER BY total DESC, slug)::INTEGER AS rank FROM fused WHERE total > 0),
near AS (SELECT a AS slug, array_to_string(list(b ORDER BY b)[1:5], ' ') AS related FROM both_ways GROUP BY a)
SELECT h.rank, h.slug, c.name, h.total, c.definition, array_to_string(c.tags, ' ') AS tags, coalesce(n.related, '') AS related FROM hits h JOIN concepts c USING (slug) LEFT JOIN near n USING (slug) WHERE h.rank <= 5""")
def search_hits(spark: SparkSession, d: str) -> DataFrame:
    """What the search tool answers with."""
    rows = A.search_rows(*_graph(spark, d), ASKED)
    return rows.withColumn("tags", F.array_join("tags", " ")).withColumn("related", F.array_join("related", " "))


@query(f"""WITH {_concepts()}, {_concepts('user', 'u_')}, asked AS (SELECT upper(name) AS name FROM u_concepts UNION SELECT slug FROM u_concepts),
m AS (SELECT a.name, c.slug, 0 AS k FROM asked a JOIN concepts c ON c.slug = {_slug('a.name')} UNION ALL SELECT a.name, c.slug, 1 FROM asked a JOIN concepts c ON lower(c.name) = lower(a.name))
SELECT name, arg_min(slug, {{'k': k, 's': slug}}) AS slug FROM m GROUP BY name""")
def resolved_names(spark: SparkSession, d: str) -> DataFrame:
    """Names and slugs from the users' turns, resolved to concepts of the assistant's."""
    asked = B.concepts(spark, d, "human")
    names = asked.select(F.upper("name").alias("name")).unionByName(asked.select(F.col("slug").alias("name"))).distinct()
    return A.resolve(B.concepts(spark, d), names)


@query(f"WITH {_concepts()} SELECT name, slug, confidence, array_to_string(tags, ' ') AS tags FROM concepts WHERE list_contains(list_transform(tags, lambda t: lower(t)), (SELECT min(tags[1]) FROM concepts))")
def listed_concepts(spark: SparkSession, d: str) -> DataFrame:
    """The concepts with the tag that comes first in the alphabet among the leading ones."""
    concepts = G.stored(B.concepts(spark, d))
    tag = concepts.agg(F.min(F.get("tags", F.lit(0)))).head()[0] or ""
    return A.list_concepts(concepts, tag.upper()).withColumn("tags", F.array_join("tags", " "))


@query(f"""WITH {_VECTOR}, {_keyword('documents', 'doc_id', 'text')}
SELECT slug, round(0.4 * coalesce(k.score, 0) + 0.4 * coalesce(s.score, 0), 9) AS total, coalesce(k.score, 0) > 0 AS by_keyword, coalesce(s.score, 0) > 0 AS by_vector
FROM (SELECT doc_id AS slug, score FROM kw) k FULL JOIN (SELECT vec_id AS slug, score FROM sem) s USING (slug)
WHERE round(0.4 * coalesce(k.score, 0) + 0.4 * coalesce(s.score, 0), 9) > 0""")
def hybrid_documents(spark: SparkSession, d: str) -> DataFrame:
    kw = R.keyword_scores(B.table(spark, d, "documents"), "doc_id", F.col("text"), ASKED).withColumnRenamed("doc_id", "slug")
    sem = _semantic(spark, d).select(F.col("vec_id").alias("slug"), "score")
    out = R.fuse(kw, sem, kw.limit(0), R.WEIGHTS["hybrid"])
    return out.select("slug", "total", F.array_contains("matched_via", "keyword").alias("by_keyword"), F.array_contains("matched_via", "semantic").alias("by_vector"))


@query(f"WITH {_concepts()} SELECT slug, confidence FROM concepts WHERE list_contains(tags, (SELECT min(tags[1]) FROM concepts)) AND confidence >= 0.5")
def filtered_concepts(spark: SparkSession, d: str) -> DataFrame:
    concepts = G.stored(B.concepts(spark, d))
    tag = concepts.agg(F.min(F.get("tags", F.lit(0)))).head()[0] or ""
    return R.filter_concepts(concepts, tag=tag, min_confidence=0.5).select("slug", "confidence")


@query(f"WITH {_concepts()} SELECT slug, name || '. ' || definition AS text FROM concepts")
def embedding_texts(spark: SparkSession, d: str) -> DataFrame:
    """What an embedding model would be given of each concept."""
    concepts = B.concepts(spark, d)
    return concepts.select("slug", R.embedding_text(concepts).alias("text"))


@query(f"{_GRAPH} SELECT 'node' AS kind, count(*) AS n FROM concepts UNION ALL SELECT 'edge', count(*) FROM (SELECT DISTINCT source, target, type FROM links) UNION ALL SELECT 'stats', 1")
def graph_export(spark: SparkSession, d: str) -> DataFrame:
    """The rows of the graph's JSON form by kind; each must be an object."""
    rows = O.graph_json(*_graph(spark, d))
    return rows.where(F.try_parse_json("json").isNotNull()).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"""{_GRAPH}, {_WALK}, hits AS (SELECT slug, total FROM fused WHERE total > 0 ORDER BY total DESC, slug LIMIT 10),
own AS (SELECT DISTINCT source, type, target FROM links WHERE source IN (SELECT slug FROM hits))
SELECT (SELECT string_agg(slug, ' ' ORDER BY total DESC, slug) FROM hits) AS concepts,
  coalesce((SELECT string_agg(source || ' ' || type || ' ' || target, ' | ' ORDER BY source || ' ' || type || ' ' || target) FROM own), '') AS relationships,
  coalesce((SELECT string_agg(DISTINCT target, ' ' ORDER BY target) FROM own WHERE target NOT IN (SELECT slug FROM hits)), '') AS neighbor_slugs,
  (SELECT round(avg(total), 6) FROM hits) AS confidence""")
def context_pack(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    pack = R.context_pack(R.top(R.hybrid(nodes, edges, ASKED), "total", "slug", 10), edges)
    return pack.select(F.array_join("concepts", " ").alias("concepts"), F.array_join("relationships", " | ").alias("relationships"), F.array_join("neighbor_slugs", " ").alias("neighbor_slugs"), F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {_keyword('documents', 'doc_id', 'text')}, r AS (
  SELECT d.source, k.doc_id, round(k.score, 9) AS score, row_number() OVER (PARTITION BY d.source ORDER BY round(k.score, 9) DESC, k.doc_id)::INTEGER AS rank FROM kw k JOIN documents d USING (doc_id))
SELECT source, doc_id, score, rank FROM r WHERE rank <= 3 ORDER BY score DESC, source, doc_id LIMIT 20""")
def cross_source_topk(spark: SparkSession, d: str) -> DataFrame:
    docs = B.table(spark, d, "documents")
    kw = R.keyword_scores(docs, "doc_id", F.col("text"), ASKED).withColumn("score", F.round("score", 9))
    return R.per_group(kw.join(docs.select("doc_id", "source"), "doc_id"), "source", "score", "doc_id", 3).select("source", "doc_id", "score", "rank")


# --- hygiene and lifecycle ----------------------------------------------------------------------

_USERS = f"""u AS (SELECT 'user-' || user_id AS slug, 'User ' || user_id AS name, max(ts) AS last, count(DISTINCT event_type) AS n, least(round(avg(value) / 1000, 6), 1.0) AS base FROM events GROUP BY user_id),
aged AS (SELECT *, greatest(date_diff('microsecond', last, TIMESTAMP '{NOW}') / 86400000000, 0) AS age FROM u),
adj AS (SELECT *, round(greatest(0, least(1, base * (0.5 + 0.5 * greatest(exp(-age / 62), least(1, log2(1 + n) / 4))))), 3) AS adjusted FROM aged)"""


@query(f"WITH {_USERS} SELECT slug, round(age, 6) AS age, adjusted, adjusted < 0.3 AND age > 90 AS stale FROM adj")
def decay(spark: SparkSession, d: str) -> DataFrame:
    age = H.age_days(F.col("last_reinforced_at"), F.lit(NOW))
    adjusted = H.adjusted_confidence(F.col("confidence"), age, F.size("source_files"))
    return B.users_as_concepts(spark, d).select("slug", F.round(age, 6).alias("age"), adjusted.alias("adjusted"), H.is_stale(adjusted, age).alias("stale"))


@query(f"WITH {_USERS} SELECT slug, name, 'stale' AS reason, adjusted FROM adj WHERE adjusted < 0.3 AND age > 90")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    return H.review_queue(B.users_as_concepts(spark, d), F.lit(NOW))


@query(f"WITH {_USERS} SELECT slug, epoch_us(last) // 1000 AS last, n::INTEGER AS sources FROM adj WHERE adjusted < 0.3 AND age > 90")
def stale_stream(spark: SparkSession, d: str) -> DataFrame:
    """The users that have turned stale, told by the timers of a stream over the event log."""
    events = B.table(spark, d, "events").select(F.format_string("user-%d", "user_id").alias("slug"), "ts", F.col("event_type").alias("source"), (F.col("value") / 1000).alias("confidence"))
    return Y.stale_by(events, F.lit(NOW), O.scratch(spark, "stale")).select("slug", "last", "sources")


@query(f"""WITH {_concepts()}, {_concepts('user', 'u_')}, named AS (SELECT 'e' AS side, slug, lower(name) AS name FROM u_concepts UNION ALL SELECT 'a', slug, lower(name) FROM concepts),
m AS (SELECT side, slug, length(name) AS size, c, count(*) AS n FROM (SELECT side, slug, name, unnest(string_split(name, '')) AS c FROM named) WHERE c <> '' GROUP BY ALL)
SELECT e.slug AS e, a.slug AS a FROM m e JOIN m a ON e.c = a.c AND e.side = 'e' AND a.side = 'a' GROUP BY e.slug, a.slug, e.size, a.size HAVING sum(least(e.n, a.n)) * 2 >= (e.size + a.size) * 0.85 - 1e-9""")
def ratio_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Names of what users and assistants say whose characters allow a ratio of 0.85."""
    left = B.concepts(spark, d, "human").select(F.col("slug").alias("e"), F.col("name").alias("x"))
    right = B.concepts(spark, d).select(F.col("slug").alias("a"), F.col("name").alias("y"))
    return H.ratio_candidates(G.stored(left), G.stored(right), 0.85).select("e", "a")


_HAS = lambda t, w: f"contains(lower({t}), '{w}')"
_AGAINST = " OR ".join(f"({_HAS('a.s', x)} AND {_HAS('b.s', y)}) OR ({_HAS('a.s', y)} AND {_HAS('b.s', x)})" for x, y in H.OPPOSITES)


@query(f"""WITH s AS (SELECT conv_id || ':' || turn AS slug, (generate_subscripts(l, 1) - 1)::INTEGER AS i, unnest(l) AS s FROM (SELECT conv_id, turn, {_sentences("text || ' It is always all. It is sometimes some.'")} AS l FROM conversations))
SELECT a.slug, a.i, b.i AS j, a.s AS a, b.s AS b FROM s a JOIN s b ON a.slug = b.slug AND a.i < b.i WHERE {_AGAINST}""")
def insight_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """The sentences of a turn, with two that contradict each other, as its insights; words match anywhere."""
    said = T.sentences(F.concat("text", F.lit(" It is always all. It is sometimes some.")))
    rows = B.table(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("slug"), said.alias("insights"))
    return H.insight_conflicts(rows, whole_words=False)


@query("""WITH k AS (SELECT doc_id::VARCHAR AS path, sha256(text) AS h FROM documents), c AS (SELECT item_id::VARCHAR AS path, sha256(text) AS h FROM benchmark UNION ALL SELECT doc_id::VARCHAR, sha256(text) FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark))
SELECT path, CASE WHEN k.h IS NULL THEN 'new' WHEN c.h IS NULL THEN 'deleted' WHEN k.h = c.h THEN 'unchanged' ELSE 'modified' END AS state FROM k FULL JOIN c USING (path)""")
def change_detection(spark: SparkSession, d: str) -> DataFrame:
    """The documents against the same with the benchmark's items in the place of those of their ids."""
    docs = B.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    items = B.table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("path"), F.col("text").alias("content"))
    return L.detect_changes(L.file_hashes(docs), L.file_hashes(items.unionByName(docs.join(items, "path", "left_anti"))))


_TWO = f"WITH {_concepts()}, {_concepts('user', 'u_')}"
_CHANGE = "CASE WHEN a.hash IS NULL THEN 'added' WHEN b.hash IS NULL THEN 'deleted' WHEN a.hash <> b.hash THEN 'modified' ELSE 'same' END"


@query(f"{_TWO} SELECT slug, {_CHANGE} AS change FROM u_concepts a FULL JOIN concepts b USING (slug) WHERE {_CHANGE} <> 'same'")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """From the concepts of the users' turns to those of the assistant's."""
    return L.diff_snapshots(B.concepts(spark, d, "human"), B.concepts(spark, d))


@query(f"{_TWO} SELECT count(*) FILTER ({_CHANGE} = 'added') AS added, count(*) FILTER ({_CHANGE} = 'modified') AS updated, count(*) FILTER ({_CHANGE} = 'same') AS unchanged, count(*) FILTER ({_CHANGE} = 'deleted') AS removed FROM u_concepts a FULL JOIN concepts b USING (slug)")
def dry_run_counts(spark: SparkSession, d: str) -> DataFrame:
    return L.diff_counts(B.concepts(spark, d, "human"), B.concepts(spark, d))


_CLIENTS = """moments AS (SELECT DISTINCT date_trunc('month', valid_at)::TIMESTAMP + INTERVAL 1 MONTH AS ts FROM client_changes WHERE valid_at IS NOT NULL),
told AS (SELECT DISTINCT * FROM client_changes WHERE valid_at IS NOT NULL AND client_id IS NOT NULL),
states AS (SELECT m.ts, t.*, sha256(concat_ws('|', coalesce(t.source, ''), coalesce(t.segment, ''), coalesce(t.city, ''), t.change_id::VARCHAR)) AS hash FROM moments m JOIN told t ON t.valid_at < m.ts
  QUALIFY row_number() OVER (PARTITION BY m.ts, client_id ORDER BY valid_at DESC, change_id DESC) = 1),
held AS (SELECT * FROM states WHERE op IS DISTINCT FROM 'D')"""


def _client_store(spark: SparkSession, d: str) -> tuple[U.BucketStore, list]:
    """Clients in buckets, brought up to date at the end of each month by its changes alone; and those times."""
    told = B.table(spark, d, "client_changes").where("valid_at IS NOT NULL AND client_id IS NOT NULL").withColumn("month", F.trunc("valid_at", "month"))
    state = F.sha2(F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in ("source", "segment", "city")), F.col("change_id").cast("string")), 256)
    last = told.groupBy("month", "client_id").agg(F.max_by(F.struct("op", "source", "segment", "city", "balance", state.alias("hash")), F.struct("valid_at", "change_id")).alias("x"))
    last = G.stored(last.select("month", "client_id", "x.*"))
    store = U.BucketStore(spark, O.scratch(spark, "clients"), "client_id bigint, source string, segment string, city string, balance double, hash string", key="client_id", told="hash")
    moments = [r[0] for r in last.select(F.add_months("month", 1).cast("timestamp").alias("ts")).distinct().orderBy("ts").collect()]
    for ts in moments:
        own = last.where(F.add_months("month", 1).cast("timestamp") == F.lit(ts))
        store.apply(own.where(~F.col("op").eqNullSafe("D")), own.where("op = 'D'"), F.lit(ts))
    return store, moments


@query(f"WITH {_CLIENTS} SELECT ts, client_id, source, segment, city, balance FROM held")
def store_versions(spark: SparkSession, d: str) -> DataFrame:
    """The clients as each month left them, read from the versions of a store in buckets."""
    store, moments = _client_store(spark, d)
    out = store.rows().withColumn("ts", F.lit(None).cast("timestamp")).limit(0)
    for version, ts in enumerate(moments, 1):
        out = out.unionByName(store.rows(version).withColumn("ts", F.lit(ts)))
    return out.select("ts", "client_id", "source", "segment", "city", "balance")


@query(f"WITH {_CLIENTS}, asked AS (SELECT s.sale_id, s.client_id, m.ts FROM sales s ASOF LEFT JOIN moments m ON s.sold_at >= m.ts) SELECT a.sale_id, a.client_id, h.hash FROM asked a LEFT JOIN held h ON h.client_id = a.client_id AND h.ts = a.ts")
def store_as_of(spark: SparkSession, d: str) -> DataFrame:
    """What the store held of each sale's client when it was sold, from the changes of its versions."""
    store, _ = _client_store(spark, d)
    asked = B.table(spark, d, "sales").select("sale_id", "client_id", "sold_at")
    return U.as_of(asked, store.changes(), "client_id", "sold_at").select("sale_id", "client_id", "hash")


@query(f"""WITH {_CLIENTS}, a AS (SELECT client_id, hash FROM held WHERE ts = (SELECT min(ts) FROM moments)), b AS (SELECT client_id, hash FROM held WHERE ts = (SELECT max(ts) FROM moments))
SELECT client_id, {_CHANGE} AS change FROM a FULL JOIN b USING (client_id) WHERE {_CHANGE} <> 'same'""")
def store_changed_between(spark: SparkSession, d: str) -> DataFrame:
    """How the clients of the last version differ from those of the first."""
    store, _ = _client_store(spark, d)
    changes = store.changes()
    times = changes.agg(F.min("ts"), F.max("ts")).head()
    return U.changed_between(changes, F.lit(times[0]), F.lit(times[1]), "client_id")


_CHANGED = "changed AS (SELECT DISTINCT conv_id::VARCHAR AS path FROM conversations WHERE role = 'system')"
_SOFT = "soft AS (SELECT c.slug, array_to_string(list(f.f ORDER BY f.f) FILTER (f.f IS NOT NULL AND ch.path IS NULL), ' ') AS source_files, count(f.f) FILTER (ch.path IS NULL) AS n FROM concepts c LEFT JOIN (SELECT slug, unnest(source_files) AS f FROM concepts) f ON f.slug = c.slug LEFT JOIN changed ch ON ch.path = f.f GROUP BY c.slug)"


def _soft_deleted(spark: SparkSession, d: str) -> DataFrame:
    changed = B.turns(spark, d).where("role = 'system'").select(F.col("source_file").alias("path")).distinct()
    rows = B.concepts(spark, d).withColumn("deleted_at", F.lit(None).cast("timestamp"))
    return L.drop_sources(rows, changed, F.lit(NOW).cast("timestamp"))


@query(f"WITH {_concepts()}, {_CHANGED}, {_SOFT} SELECT slug, coalesce(source_files, '') AS source_files, CASE WHEN n = 0 THEN 'deleted' ELSE 'active' END AS status FROM soft")
def soft_delete(spark: SparkSession, d: str) -> DataFrame:
    """The conversations with a system turn have changed: their concepts lose them as sources."""
    return _soft_deleted(spark, d).select("slug", F.array_join("source_files", " ").alias("source_files"), "status")


@query(f"WITH {_concepts()}, {_CHANGED}, {_SOFT} SELECT slug FROM soft WHERE n > 0")
def prune(spark: SparkSession, d: str) -> DataFrame:
    return L.prune(_soft_deleted(spark, d), 30, F.lit("2024-08-01").cast("timestamp")).select("slug")


@query(f"WITH {_concepts()} SELECT count(*) AS concepts, round(avg(confidence), 6) AS mean_confidence, 0 AS insights, sum(len(tags))::BIGINT AS tags, sum(len(source_files))::BIGINT AS sources FROM concepts")
def kb_stats(spark: SparkSession, d: str) -> DataFrame:
    return L.kb_stats(B.concepts(spark, d))


@query(f"""WITH {_concepts()} SELECT slug, '---' || chr(10) || 'title: "' || name || '"' || chr(10) || 'slug: "' || slug || '"' || CASE WHEN len(tags) > 0 THEN chr(10) || 'tags: [' || array_to_string(tags, ', ') || ']' ELSE '' END
  || chr(10) || 'confidence: 0.90' || chr(10) || 'sources:' || chr(10) || array_to_string(list_transform(source_files, lambda f: '  - "' || f || '"'), chr(10)) || chr(10) || '---' || chr(10) || chr(10)
  || '# ' || name || chr(10) || chr(10) || '## Definition' || chr(10) || chr(10) || definition || chr(10) AS markdown FROM concepts""")
def rendered_concepts(spark: SparkSession, d: str) -> DataFrame:
    c = B.concepts(spark, d)
    return c.select("slug", S.render_concept(c).alias("markdown"))


# --- evaluation ---------------------------------------------------------------------------------


@query(f"WITH {_concepts()}, t AS (SELECT slug, unnest(tags) AS tag FROM concepts) SELECT DISTINCT a.slug AS query, b.slug AS relevant FROM t a JOIN t b ON a.tag = b.tag AND a.slug <> b.slug")
def judgments(spark: SparkSession, d: str) -> DataFrame:
    return E.judgments(B.concepts(spark, d))


_RELEVANT = "t AS (SELECT slug, unnest(tags) AS tag FROM concepts), rel AS (SELECT DISTINCT a.slug AS query, b.slug AS relevant FROM t a JOIN t b ON a.tag = b.tag AND a.slug <> b.slug), sizes AS (SELECT query, count(*) AS n FROM rel GROUP BY query)"


def _ranked_links(concepts: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "target"))
    return K.score_links(concepts).select(F.col("source").alias("query"), F.col("target").alias("item"), rank.alias("rank"))


@query(f"""WITH {_concepts()}, {_links()}, {_RELEVANT}, got AS (SELECT source AS query, target AS item, row_number() OVER (PARTITION BY source ORDER BY score DESC, target) AS rank FROM links),
h AS (SELECT g.query, count(*) AS hits FROM got g JOIN rel r ON r.query = g.query AND r.relevant = g.item WHERE g.rank <= 5 GROUP BY g.query)
SELECT q.query, round(coalesce(coalesce(h.hits, 0) / s.n, 0.0), 9) AS recall FROM (SELECT query FROM got UNION SELECT query FROM rel) q LEFT JOIN sizes s USING (query) LEFT JOIN h USING (query)""")
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    """How many of the concepts that share a tag are among the five best links."""
    concepts = G.stored(B.concepts(spark, d))
    out = E.recall_by_tags(concepts, _ranked_links(concepts), 5)
    return out.select("query", F.round("recall", 9).alias("recall"))


_COMPONENTS = """
cq AS (SELECT slug AS query, w, count(*) AS times FROM (SELECT slug, unnest(regexp_extract_all(lower(name || ' ' || array_to_string(tags, ' ')), '[a-z0-9]+')) AS w FROM concepts) GROUP BY 1, 2),
cd AS (SELECT slug AS item, regexp_extract_all(lower(name || ' ' || definition), '[a-z0-9]+') AS t FROM concepts),
ctf AS (SELECT item, len, w, count(*) AS tf FROM (SELECT item, len(t) AS len, unnest(t) AS w FROM cd) GROUP BY 1, 2, 3),
cidf AS (SELECT w, ln(((SELECT count(*) FROM cd) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM ctf GROUP BY w),
craw AS (SELECT query, item, sum(tf / len * idf * times) AS raw FROM cq JOIN cidf USING (w) JOIN ctf USING (w) GROUP BY 1, 2),
ckw AS (SELECT query, item, raw / max(raw) OVER (PARTITION BY query) AS keyword FROM craw),
cseed AS (SELECT query, item AS seed, keyword AS sigma FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(keyword, 9) DESC, item) AS r FROM ckw WHERE keyword > 0) WHERE r <= 10),
c1 AS (SELECT query, seed, sigma, target AS mid, confidence FROM cseed JOIN pairs ON source = seed WHERE target <> seed),
c2 AS (SELECT query, seed, sigma, mid, target, p.confidence FROM c1 JOIN pairs p ON p.source = mid WHERE target <> seed AND target <> mid),
cparts AS (SELECT query, seed AS item, sigma AS s FROM cseed UNION ALL SELECT query, mid, sigma * confidence * 0.5 FROM c1 UNION ALL SELECT query, target, sigma * confidence * 0.2 FROM c2),
cwalk AS (SELECT query, item, raw / max(raw) OVER (PARTITION BY query) AS graph FROM (SELECT query, item, sum(s) AS raw FROM cparts GROUP BY 1, 2)),
parts AS (SELECT query, item, round(coalesce(keyword, 0), 9) AS keyword, 0.0 AS semantic, round(coalesce(graph, 0), 9) AS graph FROM ckw FULL JOIN cwalk USING (query, item))"""


def _best_scores(spark: SparkSession, d: str, k: int) -> tuple[DataFrame, DataFrame]:
    nodes, edges = _graph(spark, d)
    return Q.best_scores(nodes, edges, k), nodes


@query(f"""{_GRAPH}, {_RELEVANT}, {_COMPONENTS},
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY total DESC, item) AS rank FROM (SELECT *, round(keyword * 0.6 + graph * 0.4, 9) AS total FROM parts) WHERE total > 0 AND item <> query),
h AS (SELECT r.query, count(*) AS hits FROM r JOIN rel ON rel.query = r.query AND rel.relevant = r.item WHERE rank <= 5 GROUP BY 1)
SELECT q.query, round(coalesce(coalesce(h.hits, 0) / s.n, 0.0), 6) AS recall FROM (SELECT query FROM r UNION SELECT query FROM rel) q LEFT JOIN sizes s USING (query) LEFT JOIN h USING (query)""")
def query_recall(spark: SparkSession, d: str) -> DataFrame:
    """Each concept's name and tags as a query: how many of those that share a tag are among the five best."""
    scores, nodes = _best_scores(spark, d, 5)
    return E.recall_by_tags(nodes, E.ranked(scores, R.WEIGHTS["no_vectors"]), 5).select("query", F.round("recall", 6).alias("recall"))


@query(f"""{_GRAPH}, {_RELEVANT}, {_COMPONENTS},
grid AS (SELECT a / 10 AS w_keyword, b / 10 AS w_semantic, (10 - a - b) / 10 AS w_graph FROM (SELECT unnest(range(11)) AS a), (SELECT unnest(range(11)) AS b) WHERE a + b <= 10),
w AS (SELECT *, round(keyword * w_keyword + semantic * w_semantic + graph * w_graph, 9) AS total FROM parts, grid),
r AS (SELECT *, row_number() OVER (PARTITION BY w_keyword, w_semantic, w_graph, query ORDER BY total DESC, item) AS rank FROM w WHERE total > 0 AND item <> query),
h AS (SELECT w_keyword, w_semantic, w_graph, r.query, count(*) AS hits FROM r JOIN rel ON rel.query = r.query AND rel.relevant = r.item WHERE rank <= 5 GROUP BY ALL),
m AS (SELECT w_keyword, w_semantic, w_graph, sum(hits / n) AS s FROM h JOIN sizes USING (query) GROUP BY ALL)
SELECT w_keyword, w_semantic, w_graph, round(coalesce(s, 0.0) / (SELECT count(DISTINCT query) FROM parts), 6) AS recall FROM grid LEFT JOIN m USING (w_keyword, w_semantic, w_graph)""")
def weight_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Recall over the grid of weights; as no vectors are asked here, the semantic weight only takes from the others."""
    scores, nodes = _best_scores(spark, d, 5)
    return E.sweep_by_tags(scores, nodes, E.weight_grid(spark), 5)


def _expected(spark: SparkSession, d: str) -> DataFrame:
    return B.concepts(spark, d, "human").select("slug", "name", F.col("tags").alias("key_phrases"))


@query(f"""{_TWO}, m AS (SELECT u.slug, u.tags, lower(c.definition) AS text FROM u_concepts u JOIN concepts c USING (slug)), p AS (SELECT text, unnest(tags) AS phrase FROM m),
n AS (SELECT (SELECT count(*) FROM u_concepts) AS expected, (SELECT count(*) FROM concepts) AS extracted, (SELECT count(*) FROM m) AS matched, (SELECT count(*) FROM p) AS phrases, (SELECT count(*) FROM p WHERE contains(text, phrase)) AS found)
SELECT round(CASE WHEN expected > 0 THEN matched / expected ELSE 1.0 END, 3) AS recall, round(CASE WHEN expected = 0 THEN CASE WHEN extracted = 0 THEN 1.0 ELSE 0.0 END ELSE matched / greatest(extracted, 1) END, 3) AS precision,
  round(CASE WHEN phrases > 0 THEN found / phrases ELSE 1.0 END, 3) AS phrase_grounding, matched, expected, extracted FROM n""")
def concept_scores(spark: SparkSession, d: str) -> DataFrame:
    """The users' concepts as expected, the assistant's as found, matched by slug."""
    expected, actual = _expected(spark, d), B.concepts(spark, d)
    same = expected.select("slug").join(actual.select("slug"), "slug").select(F.col("slug").alias("e"), F.col("slug").alias("a"))
    return E.concept_scores(expected, actual, same)


@query()
def eval_scores(spark: SparkSession, d: str) -> DataFrame:
    """As concept_scores, with names that are nearly equal matched, too."""
    expected, actual = G.stored(_expected(spark, d)), G.stored(B.concepts(spark, d))
    return E.concept_scores(expected, actual, E.match_concepts(expected, actual))


@query(f"""WITH {_concepts()}, {_links()}, e AS (SELECT DISTINCT target AS source, source AS target, type FROM links), a AS (SELECT source, target, min(type) AS found FROM links GROUP BY source, target),
n AS (SELECT count(*) AS expected, count(found) AS matched, count(*) FILTER (found = type) AS fit FROM e LEFT JOIN a USING (source, target))
SELECT round(CASE WHEN expected > 0 THEN matched / expected ELSE 1.0 END, 3) AS recall, round(CASE WHEN matched > 0 THEN fit / matched ELSE 1.0 END, 3) AS type_accuracy, matched, expected FROM n""")
def relationship_scores(spark: SparkSession, d: str) -> DataFrame:
    """Whether each link is also found in the other direction."""
    found = G.stored(B.links(spark, d).select("source", "target", "type"))
    return E.relationship_scores(found.select(F.col("target").alias("source"), F.col("source").alias("target"), "type").distinct(), found)


# --- extensions over the event log --------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return V.tumbling_counts(B.table(spark, d, "events"))


@query("SELECT s AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 3 HOUR, ts), time_bucket(INTERVAL 3 HOUR, ts) - INTERVAL 3 HOUR]) AS s FROM events) GROUP BY 1")
def event_sliding(spark: SparkSession, d: str) -> DataFrame:
    return V.sliding_counts(B.table(spark, d, "events"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return V.sessions(B.table(spark, d, "events"))


@query("SELECT user_id, max(ts) AS last_ts, count(*) AS n FROM events GROUP BY user_id")
def latest_per_user(spark: SparkSession, d: str) -> DataFrame:
    return V.latest_by_user(B.table(spark, d, "events"))
