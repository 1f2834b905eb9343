"""The queries of this subpackage, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import decontamination, fill_in_middle, filter_audit, jaccard_join, lm_scoring, media, packing, quality, simhash_dedup, suffix_dedup, token_counts, token_files, url_rules
from weftgraph.llm.common import shared_folder

#: The rules that ``op10_url_rules`` judges by.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), threshold=0.75)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), width=5, num=75, den=100)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.payload_features(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_bytes(table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.digests(token_files.read_token_files(spark, path))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), size=2048, end_id=1)


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), RULES)


def op11_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    hashed = made.withColumn("digest", fill_in_middle.digests(made["output"], made["form"]))
    return hashed.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "digest.*")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_media_columns": op4_media_columns,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_token_counts": op7_token_counts,
    "op8_token_files": op8_token_files,
    "op9_packing": op9_packing,
    "op10_url_rules": op10_url_rules,
    "op11_simhash_dedup": op11_simhash_dedup,
    "op12_filter_audit": op12_filter_audit,
    "op13_fill_in_middle": op13_fill_in_middle,
}
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP2_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM w),
s AS (
  SELECT DISTINCT doc_id, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS g, i, n
  FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
sets AS (SELECT DISTINCT doc_id, g FROM s WHERE i <= greatest(n - 4, 1)),
n AS (SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN sets USING (doc_id) GROUP BY w.doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM met JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.doc_id, y FROM reach JOIN links ON x = other)
SELECT n.doc_id, n.n AS n_shingles, min(other) AS component_id FROM n JOIN reach USING (doc_id) GROUP BY 1, 2
"""

OP5_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, unnest(regexp_extract_all(h, '..')) AS x, unnest(range(length(h) // 2)) AS s FROM d),
b2 AS (SELECT *, x || lead(x) OVER o AS x2 FROM b WINDOW o AS (PARTITION BY doc_id ORDER BY s)),
b4 AS (SELECT *, x2 || lead(x2, 2) OVER o AS x4 FROM b2 WINDOW o AS (PARTITION BY doc_id ORDER BY s)),
b8 AS (SELECT *, x4 || lead(x4, 4) OVER o AS x8 FROM b4 WINDOW o AS (PARTITION BY doc_id ORDER BY s)),
b16 AS (SELECT *, x8 || lead(x8, 8) OVER o AS x16 FROM b8 WINDOW o AS (PARTITION BY doc_id ORDER BY s)),
g AS (SELECT doc_id, s, x16 || lead(x16, 16) OVER o || lead(x16, 32) OVER o || lead(x2, 48) OVER o AS k FROM b16 WINDOW o AS (PARTITION BY doc_id ORDER BY s)),
f AS (SELECT k, min(doc_id) AS least FROM g WHERE k IS NOT NULL GROUP BY k),
hit AS (SELECT g.doc_id, s, max(s + 50) OVER (PARTITION BY g.doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS covered
  FROM g JOIN f USING (k) WHERE least < g.doc_id),
marked AS (SELECT *, sum(CASE WHEN covered IS NULL OR s > covered THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS i FROM hit),
spans AS (SELECT doc_id, i, min(s) AS a, max(s) + 50 AS b FROM marked GROUP BY 1, 2),
ends AS (SELECT doc_id, a, b FROM spans UNION ALL SELECT doc_id, length(h) // 2, length(h) // 2 FROM d),
kept AS (SELECT doc_id, a, substring(h, 2 * coalesce(lag(b) OVER w, 0) + 1, 2 * (a - coalesce(lag(b) OVER w, 0))) AS part FROM ends JOIN d USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY a, b)),
text AS (SELECT doc_id, string_agg(part, '' ORDER BY a) AS h FROM kept GROUP BY 1)
SELECT d.doc_id, length(d.h) // 2 AS n_bytes, coalesce(sum(b - a), 0)::BIGINT AS n_removed, count(a)::BIGINT AS n_spans, sha256(unhex(any_value(text.h))) AS kept_sha256
FROM d JOIN text USING (doc_id) LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id, d.h
"""

_RULE_ROWS = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in RULES)

def _host(url: str) -> str:
    return rf"regexp_extract({url}, '://([^/?#]*)', 1)"


def _node(url: str) -> str:
    """A url without its scheme and fragment: host without a default port, path and query."""
    port = f"CASE WHEN regexp_matches({url}, '(?i)^http://') THEN ':80' WHEN regexp_matches({url}, '(?i)^https://') THEN ':443' ELSE '' END"
    tail = f"regexp_extract(substring({url}, strpos({url}, '://') + 3 + length({_host(url)})), '^[^#]*')"
    host = f"translate({_host(url)}, {_LOWER})"
    return f"CASE WHEN {port} <> '' AND ends_with({host}, {port}) THEN left({host}, length({host}) - length({port})) ELSE {host} END || CASE WHEN starts_with({tail}, '/') THEN '' ELSE '/' END || {tail}"


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _attribute(name: str) -> str:
    """The first attribute of that name of the list ``attrs``, unescaped."""
    first = rf"list_filter(attrs, lambda x: regexp_matches(x, '(?i)^{name}(?:[\s=]|$)'))[1]"
    value = rf"regexp_replace(regexp_replace({first}, '^[^\s=]*\s*=?\s*', ''), '(?s)^\"(.*)\"$|^''(.*)''$', '\1\2')"
    names = ", ".join(f"{_text('&' + k + ';')}: {_text(v)}" for k, v in url_rules.ENTITIES.items())
    number = "CASE WHEN {0} > 0 AND {0} < 1114112 AND {0} NOT BETWEEN 55296 AND 57343 THEN chr({0}::INTEGER) ELSE chr(65533) END".format
    hexed, plain = number("TRY_CAST('0x' || regexp_extract(z, '^&#[xX]([0-9a-fA-F]+)', 1) AS BIGINT)"), number("TRY_CAST(regexp_extract(z, '^&#([0-9]+)', 1) AS BIGINT)")
    one = f"CASE WHEN regexp_matches(z, '^&#[xX]') THEN {hexed} WHEN regexp_matches(z, '^&#') THEN {plain} ELSE coalesce(MAP {{{names}}}[z], z) END"
    return f"array_to_string(list_transform(regexp_extract_all({value}, {_text(url_rules.PIECES)}), lambda z: {one}), '')"


def _resolving(name: str, source: str, to: str, base: str) -> str:
    """A table: ``source`` with r, the absolute url that ``to`` means on ``base``."""
    dots = "list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split(substring(p, 2), '/'), lambda x: [x])), lambda done, x: CASE WHEN x[1] = '..' THEN done[1:len(done) - 1] WHEN x[1] = '.' THEN done ELSE list_concat(done, x) END)"
    return rf"""
{name}_1 AS (SELECT *, regexp_extract({base}, '^([^:/?#]*)://', 1) AS scheme, {_host(base)} AS host, regexp_extract(substring({base}, strpos({base}, '://') + 3), '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract({to}, '^[^?#]*') AS own FROM {source}),
{name}_2 AS (SELECT *, CASE WHEN starts_with(own, '/') THEN own ELSE CASE WHEN path = '' THEN '/' ELSE regexp_extract(path, '^.*/') END || own END AS p FROM {name}_1),
{name}_3 AS (SELECT *, regexp_replace('/' || array_to_string({dots}, '/') || CASE WHEN regexp_matches(p, '/\.\.?$') THEN '/' ELSE '' END, '^/+$', '/') AS clean FROM {name}_2),
{name} AS (SELECT * EXCLUDE (scheme, host, path, own, p, clean), CASE WHEN {to} = '' OR starts_with({to}, '#') THEN NULL WHEN starts_with({to}, '//') THEN scheme || ':' || {to} WHEN regexp_matches({to}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {to}
  WHEN regexp_matches({to}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL WHEN starts_with({to}, '?') THEN scheme || '://' || host || path || {to} ELSE scheme || '://' || host || clean || substring({to}, length(own) + 1) END AS r FROM {name}_3)"""


_TRIMMED = r"regexp_replace(regexp_replace({}, '^\s+|\s+$', '', 'g'), '[\t\r\n]', '', 'g')".format
_REFRESHED = " || ".join(f"regexp_extract(content, {_text(url_rules.REFRESH)}, {i})" for i in (1, 2, 3))
_MEANT = rf"CASE WHEN kind = 'link' AND list_contains(regexp_split_to_array(lower(rel), '\s+'), 'canonical') THEN href WHEN kind = 'meta' AND lower(trim(equiv)) = 'refresh' THEN {_REFRESHED} END"

OP10_SQL = rf"""
WITH RECURSIVE rules(verdict, rule, rh, rp) AS (VALUES {_RULE_ROWS}),
u AS (SELECT page_id, html, url, row_number() OVER () AS i, CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, html, url, i, regexp_extract(rest, '^[^/?#]*') AS raw, substring(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1) AS tail FROM u),
q AS (SELECT page_id, html, url, i, translate(raw, {_LOWER}) AS host, regexp_extract(tail, '^[^?#]*') AS path, CASE WHEN strpos(url, '://') > 0 THEN {_node("url")} END AS node FROM p),
tokens AS (SELECT i, url, unnest(regexp_extract_all(html, {_text(url_rules.token_pattern(""))})) AS tag, generate_subscripts(regexp_extract_all(html, {_text(url_rules.token_pattern(""))}), 1) AS place FROM q
  WHERE node IS NOT NULL AND regexp_matches(html, '(?i)canonical|refresh')),
tags AS (SELECT i, url, place, lower(regexp_extract(tag, '^<([A-Za-z]+)', 1)) AS kind, regexp_extract_all(regexp_replace(tag, '^<[^\s/>]*', ''), {_text(url_rules.attribute_pattern(""))}) AS attrs FROM tokens WHERE regexp_matches(tag, {_text(url_rules.WANTED)})),
read AS (SELECT i, url, place, kind, {_attribute("href")} AS href, {_attribute("rel")} AS rel, {_attribute("http-equiv")} AS equiv, {_attribute("content")} AS content FROM tags),
base_of AS (SELECT i, url, arg_min({_TRIMMED("href")}, place) AS b FROM read WHERE kind = 'base' AND href IS NOT NULL GROUP BY 1, 2),
{_resolving("placed", "base_of", "b", "url")},
meant AS (SELECT i, url, {_TRIMMED(_MEANT)} AS t FROM read WHERE kind <> 'base'),
found AS (SELECT meant.url, t, coalesce(r, meant.url) AS base FROM meant LEFT JOIN placed USING (i) WHERE t <> ''),
{_resolving("target", "found", "t", "base")},
edges AS (SELECT {_node("url")} AS a, {_node("r")} AS b FROM target WHERE r IS NOT NULL),
ways AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
nodes AS (SELECT DISTINCT a AS node, regexp_extract(a, '^[^/?#]*') AS host, regexp_extract(substring(a, length(regexp_extract(a, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM ways),
bad(node) AS (
  SELECT node FROM (SELECT node, max_by(verdict, length(rule)) AS v FROM nodes JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY node) WHERE v = 'block'
  UNION SELECT b FROM bad JOIN ways ON a = node),
own AS (SELECT page_id, host, path, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict FROM (SELECT DISTINCT page_id, host, path FROM q)
  JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY 1, 2, 3)
SELECT q.page_id, q.host, q.path, own.rule, coalesce(own.verdict, CASE WHEN bad.node IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM q LEFT JOIN own ON own.page_id = q.page_id AND own.host = q.host AND own.path = q.path LEFT JOIN bad ON bad.node = q.node
"""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Counts each step of each order from the documents' masks, without inversion.
OP12_SQL = rf"""
WITH l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x, {_WORDS} AS ws, doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS e FROM documents),
m AS (SELECT part, CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 2 * length(x) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN e THEN 16 ELSE 0 END AS mask,
  coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS t FROM m GROUP BY 1, 2),
f AS (SELECT chr(65 + i::INTEGER) AS letter, 1 << i::INTEGER AS bit FROM range(5) r(i)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
s AS (SELECT filter_order, i::INTEGER AS step, 1 << (ascii(filter_order[i]) - 65) AS bit, coalesce(list_sum([1 << (ascii(filter_order[j]) - 65) FOR j IN range(1, i)]), 0)::INTEGER AS done FROM o, range(1, 6) r(i)),
k AS (SELECT part, filter_order, step, sum(CASE WHEN mask & (done | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN mask & done = 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN mask & done <> 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN mask & done = 0 AND mask & bit <> 0 THEN g ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN mask & done = 0 AND mask & bit <> 0 THEN t ELSE 0 END)::BIGINT AS toxic_lost, any_value(bit) AS bit
  FROM c, s GROUP BY 1, 2, 3)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM k
"""

OP13_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^
]*
|[^
]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
d AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS one, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS two, ('0x' || h[25:32])::BIGINT % 100 AS kind FROM t),
p AS (SELECT doc_id, x, n, CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') THEN 'plain' WHEN kind < 50 THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(u[1:least(one, two)], '') AS a, array_to_string(u[least(one, two) + 1:greatest(one, two)], '') AS m, array_to_string(u[greatest(one, two) + 1:], '') AS s FROM d)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(a) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || a || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || a || '<M>' || m END) AS output_sha256, sha256(x) AS restored_sha256 FROM p
"""

#: The others need a tokenizer, a fitted model, fingerprints or image features;
#: tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op2_jaccard_join": OP2_SQL, "op5_suffix_dedup": OP5_SQL, "op10_url_rules": OP10_SQL, "op12_filter_audit": OP12_SQL, "op13_fill_in_middle": OP13_SQL}
