"""URL filters with redirect equivalence, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import dropped_after, written
from weftgraph.llm.components import connected_components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, rule); a rule is a host and a path in one, split at its first slash.
Rule = tuple[str, str]

#: What ends a tag's or an attribute's name, and elements whose content is no markup.
_RAW = ("script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes")


def token_pattern(possessive: str = "+") -> str:
    """Comments, elements of raw text, tags, and declarations of an html text, one
    after another, so that nothing inside one is taken for another.

    A value that is quoted after ``=`` may hold any sign.  Each token that isn't
    closed takes the rest of the text, so a scan is linear; with the possessive
    sign Java neither goes back nor recurses.
    """
    p = possessive
    body = rf"""(?:[^>=]+{p}|=\s*{p}(?:"[^"]*{p}"|'[^']*{p}')|=)*{p}"""
    comment = r"<!--(?:-?>|.*?(?:--!?>|\z))"
    raw = [rf"<{x}(?:[\s/]{body})?(?:>.*?(?:</{x}[\s/>]|\z)|\z)" for x in _RAW]
    return "(?is)" + "|".join([comment, *raw, rf"<[a-z]{body}(?:>|\z)", rf"<[!?/][^>]*{p}(?:>|\z)"])


def attribute_pattern(possessive: str = "+") -> str:
    """The attributes of a tag without its name: name, and value after ``=``."""
    p = possessive
    return rf"""[^\s/>][^\s/>=]*{p}(?:\s*{p}=\s*{p}(?:"[^"]*{p}"|'[^']*{p}'|[^\s>]*{p}))?"""


#: Tags that matter; a tag cut off by the end of the text is none.
WANTED = r"(?is)^<(?:link|meta|base)[\s/].*>$"
#: Of a refresh: seconds, a mark or a space, and the target, with ``url=`` or without.
REFRESH = r"""(?is)^\s*(?:\d+|\.)[\d.]*(?:\s*[;,]\s*|\s+)(?:url\s*=\s*)?(?:"([^"]*)|'([^']*)|(.*))"""
#: Pieces of a value: references to characters, and what is between them.
PIECES = r"(?s)&#[0-9]{1,7};?|&#[xX][0-9a-fA-F]{1,6};?|&[A-Za-z]{2,7};|[^&]+|&"
# Names of the characters that matter in urls.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "sol": "/", "colon": ":", "period": ".", "quest": "?", "num": "#", "equals": "=", "lowbar": "_", "percnt": "%", "commat": "@", "plus": "+", "comma": ",", "semi": ";",
    "excl": "!", "dollar": "$", "lpar": "(", "rpar": ")", "ast": "*", "Tab": "\t", "NewLine": "\n",
}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, and not pasted wherever it
    is used: plans stay as long as they are written."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def _raw_host(rest: Column) -> Column:
    return F.regexp_extract(rest, r"^[^/?#]*", 0)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in
    lower case; empty for a null or where there is no ``://``."""
    return F.coalesce(F.translate(_raw_host(_after_scheme(url)), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def resource_of(url: Column) -> Column:
    """Host, path and query: what two urls of one resource share.  The scheme,
    its default port and the fragment don't tell resources apart, and an empty
    path is ``/``; a null has none."""
    port = F.when(F.regexp_like(url, F.lit("(?i)^http://")), F.lit(":80")).when(F.regexp_like(url, F.lit("(?i)^https://")), F.lit(":443")).otherwise(F.lit("://"))

    def joined(x: Column) -> Column:
        host = F.when(F.endswith(x["host"], x["port"]), F.substring(x["host"], F.lit(1), F.length(x["host"]) - F.length(x["port"]))).otherwise(x["host"])
        return F.concat(host, F.when(F.startswith(x["rest"], F.lit("/")), F.lit("")).otherwise(F.lit("/")), x["rest"])

    rest = F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^#]*)", 1)
    return F.when(url.isNotNull(), let(F.struct(host_of(url).alias("host"), rest.alias("rest"), port.alias("port")), joined))


def without_dots(path: Column) -> Column:
    """A path from the root with ``.`` and ``..`` resolved; the last segment
    leaves a slash if it is one of them."""
    empty = F.array().cast("array<string>")
    up = lambda done: F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))

    def joined(parts: Column) -> Column:
        kept = F.aggregate(parts, empty, lambda done, x: F.when(x == "..", up(done)).when(x == ".", done).otherwise(F.concat(done, F.array(x))))
        last = F.when(F.element_at(parts, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
        return F.regexp_replace(F.concat(F.lit("/"), F.array_join(kept, "/"), last), "^/+$", "/")

    return let(F.split(F.substring(path, F.lit(2), F.length(path)), "/"), joined)


def resolved(target: Column, base: Column) -> Column:
    """The absolute url that a target means on the page ``base``; null for other
    schemes such as ``mailto:``, and for a mere fragment."""
    parts = F.struct(
        target.alias("to"), F.regexp_extract(base, r"^([^:/?#]*)://", 1).alias("scheme"), _raw_host(_after_scheme(base)).alias("host"), path_of(base).alias("path"),
        F.regexp_extract(target, r"^[^?#]*", 0).alias("own"), F.regexp_extract(target, r"(?s)^[^?#]*(.*)", 1).alias("rest"),
    )

    def joined(x: Column) -> Column:
        to = x["to"]
        folder = F.when(x["path"] == "", F.lit("/")).otherwise(F.regexp_extract(x["path"], r"^.*/", 0))
        place = F.when(F.startswith(to, F.lit("?")), x["path"]).otherwise(without_dots(F.when(F.startswith(to, F.lit("/")), x["own"]).otherwise(F.concat(folder, x["own"]))))
        return (
            F.when(to.isNull() | (to == "") | F.startswith(to, F.lit("#")), None)
            .when(F.startswith(to, F.lit("//")), F.concat(x["scheme"], F.lit(":"), to))
            .when(F.regexp_like(to, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://")), to)
            .when(F.regexp_like(to, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), None)
            .otherwise(F.concat(x["scheme"], F.lit("://"), x["host"], place, x["rest"]))
        )

    return let(parts, joined)


def unescaped(value: Column) -> Column:
    """A value with its references to characters resolved: numbers, and the names
    in ``ENTITIES``; a number that is no character gives U+FFFD."""
    names = F.create_map(*[F.lit(x) for name, sign in ENTITIES.items() for x in (f"&{name};", sign)])

    def sign(code: Column) -> Column:
        valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        return F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")

    def one(piece: Column) -> Column:
        hexed = F.conv(F.regexp_extract(piece, "^&#[xX]([0-9a-fA-F]+)", 1), 16, 10).cast("long")
        plain = F.regexp_extract(piece, "^&#([0-9]+)", 1).try_cast("long")
        return F.when(F.rlike(piece, F.lit("^&#[xX]")), sign(hexed)).when(F.rlike(piece, F.lit("^&#")), sign(plain)).otherwise(F.coalesce(names[piece], piece))

    return F.when(F.contains(value, F.lit("&")), F.array_join(F.transform(F.regexp_extract_all(value, F.lit(PIECES), 0), one), "")).otherwise(value)


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's first attribute of that name, unescaped; empty if it
    has none; null without the attribute."""
    every = F.regexp_extract_all(F.regexp_replace(tag, r"^<[^\s/>]*", ""), F.lit(attribute_pattern()), 0)
    first = F.get(F.filter(every, lambda x: F.rlike(x, F.lit(rf"(?i)^{name}(?:[\s=]|$)"))), F.lit(0))
    value = F.regexp_replace(first, r"^[^\s=]*\s*=?\s*", "")
    return unescaped(F.regexp_replace(value, r"""(?s)^"(.*)"$|^'(.*)'$""", "$1$2"))


def target_of(tag: Column) -> Column:
    """What a canonical link or a refresh points to, without white space around
    and line ends within; null for any other tag."""
    rel = F.split(F.lower(attribute(tag, "rel")), r"\s+")
    refresh = let(attribute(tag, "content"), lambda x: F.concat(*[F.regexp_extract(x, REFRESH, i) for i in (1, 2, 3)]))
    link = F.rlike(tag, F.lit(r"(?i)^<link[\s/]")) & F.array_contains(rel, "canonical")
    meta = F.rlike(tag, F.lit(r"(?i)^<meta[\s/]")) & (F.lower(F.trim(attribute(tag, "http-equiv"))) == "refresh")
    return _trimmed(F.when(link, attribute(tag, "href")).when(meta, refresh))


def _trimmed(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"^\s+|\s+$", ""), r"[\t\r\n]", "")


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as struct<rule, verdict>, or null.

    A rule fits its host and that host's subdomains where the path starts with
    the rule's.  Rules are a parameter, so this is one expression with no join.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the last is tested first
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): resources that a canonical link or a refresh redirect equates.

    Tags in comments, in scripts and other raw text, and in the values of other
    tags don't count; attributes are told by their whole names, and ``rel`` by its
    words.  Targets are resolved against the first ``base`` with an ``href``, else
    against the page's url, dot segments included.  Other schemes, mere
    fragments and pages without a ``://`` in their url give no edge.

    The targets are written once: html is read in one scan, and the steps after
    it see a row a page that has a target.
    """
    url, html = F.col(url_col), F.col(html_col)
    found = pages.where(html.isNotNull() & url.contains("://") & F.rlike(html, F.lit(r"(?i)canonical|refresh")))
    tokens = F.regexp_extract_all(html, F.lit(token_pattern()), F.lit(0))
    tags = found.select(url.alias("url"), F.filter(tokens, lambda x: F.rlike(x, F.lit(WANTED))).alias("tags"))
    is_base = lambda x: F.rlike(x, F.lit(r"(?i)^<base[\s/]"))
    bases = F.filter(F.transform(F.filter("tags", is_base), lambda x: _trimmed(attribute(x, "href"))), lambda x: x.isNotNull())
    targets = F.filter(F.transform(F.filter("tags", lambda x: ~is_base(x)), target_of), lambda x: x != "")
    ends = tags.select("url", F.get(bases, F.lit(0)).alias("base"), F.array_distinct(targets).alias("targets"))
    ends = written(ends.where(F.size("targets") > 0), "link-targets")
    placed = ends.select("url", F.coalesce(resolved(F.col("base"), F.col("url")), "url").alias("base"), F.explode("targets").alias("t"))
    pairs = placed.select(resource_of(F.col("url")).alias("a"), resource_of(resolved(F.col("t"), F.col("base"))).alias("b"))
    return pairs.where("a <> b").distinct()


def blocked_resources(groups: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The nodes of components of which a rule blocks a member."""
    node = F.concat(F.lit("http://"), F.col("node"))
    judged = groups.withColumns({"host": host_of(node), "path": path_of(node)}).withColumn("own", longest_rule(F.col("host"), F.col("path"), rules))
    bad = judged.groupBy("component").agg(F.max(F.coalesce(F.col("own")["verdict"] == "block", F.lit(False))).alias("bad")).where("bad").select("component")
    return groups.join(bad, "component", "left_semi").select("node")


def judge_urls(pages: DataFrame, rules: Sequence[Rule], edges: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """Verdicts on urls: id, host, path, rule, verdict.

    The longest fitting rule decides.  A url that no rule fits takes ``block``
    if it is an alias of a blocked one, that is, if the connected component of
    redirect and canonical-link edges that holds it has a resource which a rule
    blocks; else ``allow``.  A url that a rule allows explicitly stays allowed,
    whatever its aliases are.  Edges come from ``html_col``, and from ``edges``
    (from, to) if there is a table of redirects.

    A null url, and one without ``://``, has an empty host and path, fits no
    rule and has no alias: ``allow``.  Null ids and repeated rows are kept.
    """
    url = F.col("url")
    picked = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), *([F.col(html_col).cast("string").alias("html")] if html_col else []))
    judged = picked.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), resource_of(url).alias("resource"))
    judged = judged.withColumn("own", longest_rule(F.col("host"), F.col("path"), rules))

    def links() -> DataFrame:
        found = [alias_edges(picked)] if html_col else []
        if edges is not None:
            ends = edges.toDF("from", "to").where(F.col("from").contains("://") & F.col("to").contains("://"))
            found.append(ends.select(resource_of(F.col("from")).alias("a"), resource_of(F.col("to")).alias("b")))
        return reduce(DataFrame.union, found)

    out = judged.withColumn("aliased", F.lit(None).cast("string"))
    if html_col or edges is not None:
        with dropped_after(pages.sparkSession):
            blocked = written(blocked_resources(connected_components(links()), rules), "blocked-resources", keep=True)
        out = judged.join(blocked.withColumn("aliased", F.lit("block")), judged["resource"] == blocked["node"], "left")
    return out.select(
        F.col("page_id").alias(id_col), "host", "path", F.col("own")["rule"].alias("rule"),
        F.coalesce(F.col("own")["verdict"], F.col("aliased"), F.lit("allow")).alias("verdict"),
    )
