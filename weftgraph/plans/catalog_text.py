"""Queries of text functions and corpus parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import lexicons as L
from weftgraph.functions import privacy, tokens
from weftgraph.functions import text as T
from weftgraph.operators import parsing
from weftgraph.plans import standins as S
from weftgraph.plans.registry import query, values

NAMES = [
    (1, "Phần thứ nhất QUY ĐỊNH CHUNG"), (2, "PHẦN 3"), (3, "phần thứ 12"), (4, "Chương IV Cá nhân"), (5, "chương 7"), (6, "Chương chưa phân loại"),
    (7, "Mục 2: Năng lực hành vi,,"), (8, "Tiểu mục 4: Hộ tịch "), (9, "  Phần thứ bảy "), (10, "không có gì"), (11, ""), (12, "Chương XXXIX"), (13, "CHƯƠNG LX"), (14, "Phần " + "a" * 200),
]
LAWS = [
    (1, "Quyền của cá nhân", "Theo Điều 5 và điều 7, ĐIỀU 9, điều 5. Tài sản ở khoản 2 Điều 10; Khoản 2, điểm a) và điểm b."),
    (2, "Hợp đồng", "Bên A gửi hợp đồng. Bồi thường thiệt hại theo khoản 3."),
    (3, "", "không nêu gì"),
    (4, "Giám hộ", "Người chưa thành niên có người giám hộ; công ty, nhà đất."),
]
CLAUSES = [
    (1, "Mở đầu.\n1. Khoản một:\na) điểm a\nb) điểm b\n2. Khoản hai.\n3. Khoản ba."),
    (2, "1. Chỉ một khoản\nđ) điểm đ\nA) hoa"),
    (3, "không có khoản nào"),
    (4, ""),
    (5, "1. x\n1. y lặp\n10. z"),
]
QUERIES = [
    (1, "Tóm tắt chương II"), (2, "Tài sản chung của vợ chồng"), (3, "Quy định về thừa kế"), (4, "Điều 25 là gì"), (5, "Nguyên tắc cơ bản ở khoản 2"), (6, "Hello"), (7, "Tổng quan điều 5"),
]
TALK = [
    (1, "Tôi đã hỏi gì trước đó?"), (2, "Bạn nhắc lại giúp"), (3, "Câu hỏi đầu tư là gì"), (4, "first question"), (5, "Tôi đã báo cho công ty 30 ngày trước đó."), (6, "do you remember"), (7, "Câu đầu tiên"), (8, "điều 5"),
]
ERRORS = [(1, "Error: 429 Too many"), (2, "API key not valid"), (3, "fetch failed"), (4, "Request Aborted 429"), (5, "400 bad"), (6, "x"), (7, "HTTP 503"), (8, "code 4291")]
PRIVATE = [
    (1, "Gửi nguyễna@x.vn và a.b@mail.example.com"), (2, "Gọi 0912 345 678 hoặc +84 (0)912-345-678"), (3, "CCCD 012345678901, CMND 123456789"), (4, "STK 1234-5678-9012"),
    (5, "ngày 01-02-2024, năm 2019 2020 2021"), (6, "1000000000 đồng"), (7, "số 1234567"), (8, "0912 345 678 9"),
]


def fixture(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


#: What stands in front of documents' titles, by id, so that they name levels.
FRONTS = ["Phần thứ nhất ", "Chương IX ", "Mục 2: ", "Tiểu mục 3: ", "PHẦN 12 ", "chương 40 ", "", "  Phần thứ bảy "]
NAMES_SQL = f"""WITH t AS (SELECT doc_id::BIGINT AS id, {FRONTS}[doc_id % {len(FRONTS)} + 1] || string_split(text, chr(10))[1] AS name FROM documents UNION ALL SELECT -id, name FROM (VALUES {values(NAMES)}) v(id, name))"""


def names(spark: SparkSession, d: str) -> DataFrame:
    """All documents' titles as names of levels, and the written names under negative ids."""
    front = F.get(F.lit(FRONTS), (F.col("doc_id") % len(FRONTS)).cast("int"))
    docs = S.table(spark, d, "documents").select(F.col("doc_id").cast("long").alias("id"), F.concat(front, F.split("text", "\n", 2)[0]).alias("name"))
    return docs.union(fixture(spark, NAMES, "id long, name string").select(-F.col("id"), "name"))


@query("clean_name", f"{NAMES_SQL} SELECT id::BIGINT AS id, CASE WHEN starts_with(lower(trim(name)), 'phần') AND length(trim(name)) <= 150 THEN trim(name) ELSE '' END AS part, CASE WHEN starts_with(lower(trim(name)), 'tiểu mục') AND length(trim(name)) <= 150 THEN trim(name) ELSE '' END AS subsection FROM t")
def clean_name(spark: SparkSession, d: str) -> DataFrame:
    return names(spark, d).select("id", T.clean_hierarchy_name(F.col("name"), "part").alias("part"), T.clean_hierarchy_name(F.col("name"), "subsection").alias("subsection"))


@query("part_number", f"""{NAMES_SQL} SELECT id::BIGINT AS id, coalesce(try_cast(nullif(regexp_extract(name, '(?i)phần (?:thứ )?([0-9]+)', 1), '') AS BIGINT),
  CASE WHEN contains(lower(name), 'thứ nhất') THEN 1 WHEN contains(lower(name), 'thứ bảy') THEN 7 ELSE 0 END)::BIGINT AS n FROM t""")  # fmt: skip
def part_number(spark: SparkSession, d: str) -> DataFrame:
    return names(spark, d).select("id", T.part_number(F.col("name")).alias("n"))


@query("chapter_info", f"""{NAMES_SQL}, r AS (SELECT id, name, nullif(upper(regexp_extract(name, '(?i)chương\\s+([IVXLCM]+)', 1)), '') AS r, nullif(regexp_extract(name, '(?i)chương\\s+([0-9]+)', 1), '') AS n FROM t)
  SELECT id::BIGINT AS id, coalesce(r, n) AS roman, CASE WHEN r IS NOT NULL THEN coalesce(v, 0) ELSE n::BIGINT END::BIGINT AS number FROM r LEFT JOIN (VALUES {values(L.roman_numerals().items())}) q(k, v) ON k = r""")  # fmt: skip
def chapter_info(spark: SparkSession, d: str) -> DataFrame:
    return names(spark, d).select("id", T.chapter_roman(F.col("name")).alias("roman"), T.chapter_number(F.col("name")).alias("number"))


@query("section_info", f"""{NAMES_SQL} SELECT id::BIGINT AS id, coalesce(try_cast(nullif(regexp_extract(name, '(?i)mục\\s+([0-9]+):\\s*(.+)', 1), '') AS BIGINT), 0) AS number,
  CASE WHEN regexp_matches(name, '(?i)mục\\s+([0-9]+):\\s*(.+)') THEN rtrim(trim(regexp_extract(name, '(?i)mục\\s+([0-9]+):\\s*(.+)', 2)), ',') ELSE name END AS short FROM t""")  # fmt: skip
def section_info(spark: SparkSession, d: str) -> DataFrame:
    return names(spark, d).select("id", T.section_number(F.col("name")).alias("number"), T.section_short_name(F.col("name")).alias("short"))


FILL = [
    (1, "Phần thứ nhất", "Chương I", "Mục 1: a", "", None), (2, None, None, None, "Tiểu mục 1: x", None), (3, "Phần thứ nhất", "Chương I", "Mục 2: b", None, None), (4, None, "Chương II", None, None, None),
    (5, None, None, "", None, None), (6, "Phần thứ hai", None, None, None, None), (7, None, "Chương I", "Mục 1: c", "Tiểu mục 1: y", None), (8, "Phần thứ hai", "Chương I", None, None, None),
]


@query("hier_filldown", f"""WITH t(pos, part, chapter, section, subsection) AS (SELECT doc_id, CASE WHEN doc_id % 40 = 0 THEN 'Phần ' || doc_id END, CASE WHEN doc_id % 10 = 3 THEN 'Chương ' || (doc_id % 30) END,
    CASE WHEN doc_id % 8 = 5 THEN '' WHEN doc_id % 4 = 1 THEN 'Mục ' || doc_id END, CASE WHEN doc_id % 6 = 2 THEN 'Tiểu mục ' || doc_id END FROM documents
    UNION ALL SELECT pos + 1000000000, part, chapter, section, subsection FROM (VALUES {values(FILL)}) v(pos, part, chapter, section, subsection, z)),
  p AS (SELECT *, last_value(part IGNORE NULLS) OVER (ORDER BY pos) AS part_name FROM t),
  p2 AS (SELECT *, sum(CASE WHEN part_name IS NOT DISTINCT FROM prev THEN 0 ELSE 1 END) OVER (ORDER BY pos) AS pg FROM (SELECT *, lag(part_name) OVER (ORDER BY pos) AS prev FROM p)),
  c AS (SELECT *, coalesce(last_value(chapter IGNORE NULLS) OVER (PARTITION BY pg ORDER BY pos), 'Chương chưa phân loại') AS chapter_name FROM p2),
  c2 AS (SELECT *, sum(CASE WHEN chapter_name IS NOT DISTINCT FROM prevc THEN 0 ELSE 1 END) OVER (PARTITION BY pg ORDER BY pos) AS cg FROM (SELECT *, lag(chapter_name) OVER (PARTITION BY pg ORDER BY pos) AS prevc FROM c))
  SELECT pos::BIGINT AS pos, part_name, chapter_name, coalesce(last_value(section IGNORE NULLS) OVER (PARTITION BY pg, cg ORDER BY pos), '') AS section_name,
    coalesce(last_value(subsection IGNORE NULLS) OVER (PARTITION BY pg, cg ORDER BY pos), '') AS subsection_name FROM c2""")  # fmt: skip
def hier_filldown(spark: SparkSession, d: str) -> DataFrame:
    """Documents as rows of which some begin a level, and the written ones behind them."""
    own = fixture(spark, [r[:5] for r in FILL], "pos long, part string, chapter string, section string, subsection string").withColumn("pos", F.col("pos") + 1_000_000_000)
    k = F.col("doc_id")
    part, chapter = F.when(k % 40 == 0, F.concat(F.lit("Phần "), k)), F.when(k % 10 == 3, F.concat(F.lit("Chương "), k % 30))
    section, subsection = F.when(k % 8 == 5, "").when(k % 4 == 1, F.concat(F.lit("Mục "), k)), F.when(k % 6 == 2, F.concat(F.lit("Tiểu mục "), k))
    rows = S.table(spark, d, "documents").select(k.cast("long").alias("pos"), part.alias("part"), chapter.alias("chapter"), section.alias("section"), subsection.alias("subsection")).union(own)
    return parsing.fill_down(rows, "pos").select("pos", "part_name", "chapter_name", "section_name", "subsection_name")


@query("hier_path", """WITH t AS (SELECT doc_id::BIGINT AS id, CASE WHEN doc_id % 4 > 0 THEN doc_id % 9 + 1 END AS p, CASE WHEN doc_id % 3 > 0 THEN doc_id % 50 + 1 END AS c, CASE WHEN doc_id % 5 > 1 THEN doc_id % 7 END AS s, CASE WHEN doc_id % 2 = 0 THEN doc_id % 6 END AS b FROM documents),
  i AS (SELECT *, 'chapter_p' || coalesce(p, 0) || '_c' || coalesce(c, 0) AS ci FROM t), j AS (SELECT *, 'section_' || ci || '_s' || coalesce(s, 0) AS si FROM i)
  SELECT id, concat_ws('/', 'part_' || p, CASE WHEN c IS NOT NULL THEN ci END, CASE WHEN s IS NOT NULL THEN si END, 'subsection_' || si || '_ss' || b) AS path FROM j""")  # fmt: skip
def hier_path(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    part, chapter = F.when(k % 4 > 0, F.concat(F.lit("Phần "), k % 9 + 1)), F.when(k % 3 > 0, F.concat(F.lit("Chương "), k % 50 + 1))
    section, subsection = F.when(k % 5 > 1, F.concat(F.lit("Mục "), k % 7, F.lit(": a"))), F.when(k % 2 == 0, F.concat(F.lit("Tiểu mục "), k % 6, F.lit(": b")))
    return S.table(spark, d, "documents").select(k.cast("long").alias("id"), parsing.hierarchical_path(part, chapter, section, subsection).alias("path"))


def with_documents(spark: SparkSession, d: str, rows: list[tuple], schema: str) -> DataFrame:
    """All documents (title: the first line), and the rows under negative ids."""
    docs = S.table(spark, d, "documents").select(F.col("doc_id").cast("long").alias("id"), F.split("text", "\n", 2)[0].alias("title"), "text")
    own = fixture(spark, rows, schema)
    title = F.col("title") if "title" in own.columns else F.lit("")
    return docs.unionByName(own.select((-F.col("id")).alias("id"), title.alias("title"), "text"))


ALL_DOCS = "SELECT doc_id::BIGINT AS id, string_split(text, chr(10))[1] AS title, text FROM documents"
CLAUSES_SQL = f"WITH t AS ({ALL_DOCS} UNION ALL SELECT -id, '', text FROM (VALUES {values(CLAUSES)}) v(id, text))"
_TRIM = "regexp_replace({}, '^[\\t-\\r\\x{{85}}\\p{{Z}}]+|[\\t-\\r\\x{{85}}\\p{{Z}}]+$', '', 'g')".format


@query("clause_split", f"""{CLAUSES_SQL}, s AS (SELECT id, string_split(regexp_replace(coalesce(text, ''), '(?m)^([0-9]+\\.\\s+)', chr(1) || '\\1', 'g'), chr(1)) AS raw FROM t),
  p AS (SELECT id, list_filter(raw, lambda x, i: i > 1 OR trim(x) <> '') AS p FROM s),
  m AS (SELECT id, list_transform(list_filter(p, lambda x: regexp_matches(x, '^[0-9]+\\.\\s')), lambda x: regexp_extract(x, '^([0-9]+)\\.', 1)) AS n,
    CASE WHEN len(p) = 0 THEN [''] WHEN len(p) > 1 AND NOT regexp_matches(p[1], '^[0-9]+\\.\\s') THEN list_concat([{_TRIM("p[1]")} || chr(10) || {_TRIM("p[2]")}], p[3:]) ELSE p END AS m FROM p),
  r AS (SELECT id, n, m, unnest(range(1, len(m) + 1)) AS place FROM m)
  SELECT id AS article_id, place::BIGINT AS place, coalesce(try_cast(n[place] AS BIGINT), 1)::BIGINT AS number, {_TRIM("m[place]")} AS text FROM r""")  # fmt: skip
def clause_split(spark: SparkSession, d: str) -> DataFrame:
    return parsing.split_clauses(with_documents(spark, d, CLAUSES, "id long, text string"), "id", "text")


_POINT = f"(?im)^([{L.POINT_LETTERS}])\\)\\s+(.+)$"


@query("point_split", f"""{CLAUSES_SQL}, r AS (SELECT id, regexp_extract_all(text, '{_POINT}', 1) AS a, regexp_extract_all(text, '{_POINT}', 2) AS b FROM t),
  u AS (SELECT id, a, b, unnest(range(1, len(a) + 1)) AS place FROM r) SELECT id AS clause_id, place::BIGINT AS place, lower(a[place]) AS letter, trim(b[place]) AS text FROM u""")  # fmt: skip
def point_split(spark: SparkSession, d: str) -> DataFrame:
    return parsing.split_points(with_documents(spark, d, CLAUSES, "id long, text string"), "id", "text")


LAWS_SCHEMA = "id long, title string, text string"
LAWS_SQL = f"WITH t AS ({ALL_DOCS} UNION ALL SELECT -id, title, text FROM (VALUES {values(LAWS)}) v(id, title, text))"


@query("keywords", f"""{LAWS_SQL}, k AS (SELECT * FROM (VALUES {values((i, w) for i, w in enumerate(L.LEGAL_TERMS))}) v(i, w))
  SELECT id::BIGINT AS id, coalesce(string_agg(w, ',' ORDER BY i), '') AS words FROM t LEFT JOIN k ON contains(lower(title || ' ' || text), w) GROUP BY id""")  # fmt: skip
def keywords(spark: SparkSession, d: str) -> DataFrame:
    return with_documents(spark, d, LAWS, LAWS_SCHEMA).select("id", F.array_join(T.keywords(F.col("title"), F.col("text")), ",").alias("words"))


def _refs(pattern: str, group: int) -> str:
    return f"{LAWS_SQL}, x AS (SELECT id, lower(unnest(regexp_extract_all(text, '{pattern}', {group}))) AS r, generate_subscripts(regexp_extract_all(text, '{pattern}', {group}), 1) AS i FROM t), f AS (SELECT id, r, min(i) AS i FROM x GROUP BY id, r) SELECT t.id::BIGINT AS id, coalesce(string_agg(r, ',' ORDER BY i), '') AS refs FROM t LEFT JOIN f ON f.id = t.id GROUP BY t.id"


@query("article_refs", _refs("(?i)điều\\s+([0-9]+)", 1))
def article_refs(spark: SparkSession, d: str) -> DataFrame:
    return with_documents(spark, d, LAWS, LAWS_SCHEMA).select("id", F.array_join(T.article_references(F.col("text")).cast("array<string>"), ",").alias("refs"))


@query("clause_refs", _refs("(?i)khoản\\s+([0-9]+)", 0))
def clause_refs(spark: SparkSession, d: str) -> DataFrame:
    return with_documents(spark, d, LAWS, LAWS_SCHEMA).select("id", F.array_join(T.clause_references(F.col("text")), ",").alias("refs"))


@query("point_refs", _refs("(?i)điểm\\s+([a-z])\\)?", 0))
def point_refs(spark: SparkSession, d: str) -> DataFrame:
    return with_documents(spark, d, LAWS, LAWS_SCHEMA).select("id", F.array_join(T.point_references(F.col("text")), ",").alias("refs"))


@query("ids_from_text", f"{LAWS_SQL}, x AS (SELECT id, unnest(regexp_extract_all(text, 'Điều\\s+([0-9]+)', 1)) AS r FROM t) SELECT DISTINCT id::BIGINT AS id, r::BIGINT AS article FROM x")
def ids_from_text(spark: SparkSession, d: str) -> DataFrame:
    from weftgraph.operators.search import article_ids_in

    return with_documents(spark, d, LAWS, LAWS_SCHEMA).select("id", F.explode(article_ids_in(F.col("text"))).alias("article"))


DOCS = "WITH t AS (SELECT doc_id AS id, text, string_split(text, chr(10))[1] AS title FROM documents)"


@query("embed_docs", """SELECT 0 AS kind_order, 'article' AS kind, 'article_' || doc_id AS id, lang AS title, text AS content FROM documents
  UNION ALL SELECT 1, 'clause', 'clause_' || conv_id || '_' || turn, role, 'Khoản ' || turn || ': ' || text FROM conversations
  UNION ALL SELECT 2, 'report', 'report_' || item_id, 'r', text || chr(10) || 'f' FROM benchmark""")  # fmt: skip
def embed_docs(spark: SparkSession, d: str) -> DataFrame:
    a = S.table(spark, d, "documents").select(F.concat(F.lit("article_"), "doc_id").alias("id"), F.col("lang").alias("title"), "text")
    c = S.table(spark, d, "conversations").select(F.concat_ws("_", F.lit("clause"), "conv_id", "turn").alias("id"), F.col("role").alias("title"), F.col("turn").alias("number"), "text")
    r = S.table(spark, d, "benchmark").select(F.concat(F.lit("report_"), "item_id").alias("id"), F.lit("r").alias("title"), F.col("text").alias("summary"), F.lit("f").alias("findings"))
    return parsing.embedding_documents(a, c, r)


@query("embed_text", f"{DOCS} SELECT id, sha256('title: ' || title || ' | text: ' || text) AS hash FROM t")
def embed_text(spark: SparkSession, d: str) -> DataFrame:
    return S.articles(spark, d).select(F.col("number").alias("id"), F.sha2(T.render_template(F.col("title"), F.col("text")), 256).alias("hash"))


WORDS = "len([w for w in regexp_split_to_array(text, '\\s+') if w <> ''])"


@query("count_tokens", f"{DOCS} SELECT id, greatest({WORDS}, ceil(length(text) / 4.0))::BIGINT AS tokens, length(text)::BIGINT AS est FROM t")
def count_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return S.table(spark, d, "documents").select(F.col("doc_id").alias("id"), T.count_tokens(t).alias("tokens"), T.estimate_input_tokens(t).alias("est"))


ASTRAL = "len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]'))"


@query("est_tokens", f"WITH t AS ({ALL_DOCS} UNION ALL VALUES (-1, '', 'a\U0001f600'), (-2, '', 'abc')) SELECT id::BIGINT AS id, (length(text) + 3 * {ASTRAL})::BIGINT AS est, greatest({WORDS}, ceil((length(text) + {ASTRAL}) / 4.0))::BIGINT AS tokens FROM t")
def est_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = with_documents(spark, d, [(1, "a\U0001f600"), (2, "abc")], "id long, text string")
    return rows.select("id", T.estimate_input_tokens(F.col("text")).alias("est"), T.count_tokens(F.col("text")).alias("tokens"))


@query("key_terms", f"{DOCS}, w AS (SELECT id, unnest(list_distinct([x for x in regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+') if length(x) >= 2])) AS w FROM t) SELECT id, count(*)::BIGINT AS terms, min(w) AS least FROM w WHERE w NOT IN (SELECT unnest([{', '.join(repr(x) for x in L.KEY_TERM_STOPS)}])) GROUP BY id")
def key_terms(spark: SparkSession, d: str) -> DataFrame:
    words = S.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.explode(T.key_terms(F.col("text"))).alias("w"))
    return words.groupBy("id").agg(F.count("*").alias("terms"), F.min("w").alias("least"))


@query("nfc", f"{DOCS} SELECT id, sha256(nfc_normalize(text)) AS hash FROM t")
def nfc(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2(T.nfc("text"), 256).alias("hash"))


@query("fold", f"{LAWS_SQL} SELECT id::BIGINT AS id, lower(strip_accents(replace(replace(text, 'đ', 'd'), 'Đ', 'D'))) AS folded FROM t")
def fold(spark: SparkSession, d: str) -> DataFrame:
    return with_documents(spark, d, LAWS, LAWS_SCHEMA).select("id", T.folded("text").alias("folded"))


@query("cap_tokens")
def cap_tokens(spark: SparkSession, d: str) -> DataFrame:
    docs = S.table(spark, d, "documents").select(F.col("doc_id").alias("id"), tokens.cap_tokens(64)("text").alias("text"), tokens.cap_observation(64)("text").alias("observation"))
    return docs.select("id", "text", "observation")


@query("truncations", f"{DOCS} SELECT id, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...' ELSE text END AS short FROM t")
def truncations(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "documents").select(F.col("doc_id").alias("id"), T.truncated(F.col("text"), 200).alias("short"))


@query("route_query", f"""WITH t AS (SELECT doc_id AS id, text AS q FROM documents UNION ALL SELECT -id, q FROM (VALUES {values(QUERIES)}) v(id, q)) SELECT id::BIGINT AS id, CASE WHEN len([w for w in {list(L.SHARED_TERMS)} if contains(lower(q), w)]) > 0 THEN 'local'
  WHEN len([w for w in {list(L.SUMMARY_TERMS)} if contains(lower(q), w)]) > 0 THEN 'global'
  WHEN len([w for w in {list(L.GLOBAL_TERMS)} if contains(lower(q), w)]) > 0 AND len([w for w in {list(L.LOCAL_TERMS)} if contains(lower(q), w)]) = 0 THEN 'global' ELSE 'local' END AS route FROM t""")  # fmt: skip
def route_query(spark: SparkSession, d: str) -> DataFrame:
    return with_documents(spark, d, QUERIES, "id long, text string").select("id", T.route_query(F.col("text")).alias("route"))


@query("valid_query", f"{DOCS} SELECT id, (trim(text) <> '' AND length(text) + {ASTRAL} <= 1000) AS ok FROM t")
def valid_query(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "documents").select(F.col("doc_id").alias("id"), T.valid_query(F.col("text")).alias("ok"))


@query("valid_keys", f"{S.GRAPH} SELECT src, dst, type, regexp_matches(src, '^article_[0-9]+$') AS source_ok, regexp_matches(dst, '^article_[0-9]+$') AS target_ok, coalesce(weight * ord / 4 IN (0, 1, 2, 3), false) AS level_ok FROM edges")
def valid_keys(spark: SparkSession, d: str) -> DataFrame:
    """Ends of edges as ids of articles, and a number made of each edge as a level."""
    level = F.col("weight") * F.col("ord") / 4
    return S.edges(spark, d).select("src", "dst", "type", T.valid_article_id(F.col("src")).alias("source_ok"), T.valid_article_id(F.col("dst")).alias("target_ok"), T.valid_level(level).alias("level_ok"))


@query("error_class", f"""WITH t AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT -id, text FROM (VALUES {values(ERRORS)}) v(id, text)) SELECT id::BIGINT AS id, CASE WHEN contains(lower(text), 'aborted') THEN 'aborted'
  WHEN regexp_matches(text, '(?i)\\b429\\b|RESOURCE_EXHAUSTED|rate.?limit|quota') THEN 'llm_rate_limited' WHEN regexp_matches(text, '(?i)\\b40[13]\\b|API key|PERMISSION_DENIED|UNAUTHENTICATED') THEN 'llm_auth_error'
  WHEN regexp_matches(text, '(?i)\\b400\\b|INVALID_ARGUMENT') THEN 'llm_error' WHEN regexp_matches(text, '(?i)fetch failed|ECONN|ENOTFOUND|ETIMEDOUT|network|\\b50[034]\\b') THEN 'llm_unreachable' ELSE 'internal' END AS code FROM t""")  # fmt: skip
def error_class(spark: SparkSession, d: str) -> DataFrame:
    return with_documents(spark, d, ERRORS, "id long, text string").select("id", T.error_class(F.col("text")).alias("code"))


@query("recall_intent")
def recall_intent(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    talk = S.table(spark, d, "conversations").select((F.col("conv_id") * 100_000 + F.col("turn")).cast("long").alias("id"), "text")
    return talk.union(fixture(spark, TALK, "id long, text string").withColumn("id", -F.col("id"))).select("id", T.recall_intent(t).alias("recall"), T.is_first_key(t).alias("first"), T.is_recent_key(t).alias("recent"))


@query("redact")
def redact(spark: SparkSession, d: str) -> DataFrame:
    docs = S.table(spark, d, "documents").select(F.col("doc_id").alias("id"), privacy.redact("text").alias("text"))
    return docs.unionByName(fixture(spark, PRIVATE, "id long, text string").select((-F.col("id")).alias("id"), privacy.redact("text").alias("text")))


@query("masked")
def masked(spark: SparkSession, d: str) -> DataFrame:
    e = S.table(spark, d, "events").select("event_id", "props")
    return e.select("event_id", privacy.masked_json(F.col("props"), "masked").alias("masked"), privacy.masked_json(F.col("props"), "metadata_only").alias("metadata"))


@query("canonical_json")
def canonical_json(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "events").select("event_id", privacy.canonical("props").alias("body"))


@query("row_hash", "SELECT doc_id AS id, sha256(repeat('0', 64) || text) AS row_hash FROM documents")
def row_hash(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "documents").select(F.col("doc_id").alias("id"), privacy.chained_hash(F.repeat(F.lit("0"), 64), F.col("text")).alias("row_hash"))


@query("md_format")
def md_format(spark: SparkSession, d: str) -> DataFrame:
    return with_documents(spark, d, LAWS, LAWS_SCHEMA).select("id", T.markdown_emphasis(F.col("text")).alias("text"))


@query("section_count")
def section_count(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "documents").select(F.col("doc_id").alias("id"), T.section_count(F.col("text")).alias("sections"))


@query("names_article")
def names_article(spark: SparkSession, d: str) -> DataFrame:
    return with_documents(spark, d, LAWS, LAWS_SCHEMA).select("id", T.names_article(F.col("text"), 5).alias("five"), T.names_article(F.col("text"), 1).alias("one"))


@query("content_normalize", f"WITH t AS ({ALL_DOCS}) SELECT id, CASE id % 5 WHEN 0 THEN text WHEN 1 THEN text WHEN 2 THEN title || chr(10) || text ELSE '' END AS text FROM t")
def content_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Documents as JSON of each kind: a string, an array of lines, an object, none, and null."""
    k, text = F.col("id") % 5, F.col("text")
    listed = F.to_json(F.array(text))
    json = F.when(k == 0, F.substring(listed, F.lit(2), F.length(listed) - 2)).when(k == 1, F.to_json(F.split(text, "\n"))).when(k == 2, F.to_json(F.struct(F.col("title").alias("p"), text.alias("q")))).when(k == 3, "null")
    return S.table(spark, d, "documents").select(F.col("doc_id").cast("long").alias("id"), F.split("text", "\n", 2)[0].alias("title"), "text").select("id", parsing.normalized_content(json).alias("text"))
