"""URL filters whose block decisions follow redirects and canonical links. DataFrame operations only.

A rule (host, path) fits a url whose host is the rule's or one of its subdomains and whose path starts
with the rule's; the longest rule wins. Urls without a rule inherit: pages that redirect to one
another or name one another as canonical are aliases, and if any alias is blocked by a rule, so are
those without a rule of their own. An allow rule of a url's own always stands.

Edges come from meta refresh elements and canonical links. A url's alias key is its scheme, its
lower-case host and the rest up to the fragment, which never reaches a server.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import LOWER, UPPER, cut
from corpusmill.llm.components import connected_components

#: (verdict, host, path)
Rule = tuple[str, str, str]


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` and for null."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null. Of equally long ones allow comes before block."""
    chain = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow", r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        chain = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chain)
    return chain


def alias_key(url: Column) -> Column:
    scheme = F.translate(F.substring_index(url, "://", 1), UPPER, LOWER)
    rest = F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(scheme, F.lit("://"), url_host(url), F.when(rest == "", F.lit("/")).otherwise(rest)))


_ATTRIBUTE = r"""(?is)\b{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def _attribute(tag: Column, name: str) -> Column:
    pattern = _ATTRIBUTE.format(name=name)
    return F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)])


#: Stands before what opens an element that is never closed, so that no pattern looks for its end.
_NEVER = "<\x00\x01"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _hidden(html: Column, last: Callable[[Column], Column], opening: str) -> Column:
    """``html`` with the openings (a case-insensitive pattern after ``<``) in its part last(html), after the last end, marked as never closed."""
    marked = lambda tail: F.regexp_replace(tail, f"(?i)<(?={opening})", _NEVER)
    return _let(html, lambda x: _let(last(x), lambda tail: F.concat(F.left(x, F.char_length(x) - F.char_length(tail)), marked(tail))))


def plain_html(html: Column) -> Column:
    """Html without comments, scripts and styles, up to its last ``>``; what is never closed stays. Linear in the text's length.

    A pattern that looks for an end from each opening would read the rest of the text for each that
    has none. All of those lie after the last end of their kind, so they are marked first.
    """
    html = _hidden(html, lambda x: F.substring_index(x, "-->", -1), "!--")
    for name in ("script", "style"):
        html = _hidden(html, lambda x, name=name: F.regexp_replace(x, rf"(?is)\A.*</{name}\s*+>", ""), rf"{name}\b")
    plain = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script\s*+>|<style\b.*?</style\s*+>", "")
    whole = lambda x: F.left(x, F.char_length(x) - F.char_length(F.substring_index(x, ">", -1)))  # no tag ends after it
    return F.replace(_let(plain, whole), F.lit(_NEVER), F.lit("<"))


def link_targets(url: Column, html: Column) -> Column:
    """The absolute urls that a page redirects to or names as canonical."""
    return _let(plain_html(html), lambda plain: _targets(url, plain))


def _targets(url: Column, plain: Column) -> Column:
    links = F.filter(F.regexp_extract_all(plain, F.lit(r"(?is)(<link\b[^>]*>)"), 1), lambda t: F.lower(_attribute(t, "rel")).rlike(r"(^|\s)canonical(\s|$)"))
    metas = F.filter(F.regexp_extract_all(plain, F.lit(r"(?is)(<meta\b[^>]*>)"), 1), lambda t: F.lower(F.trim(_attribute(t, "http-equiv"))) == "refresh")
    named = F.concat(F.transform(links, lambda t: _attribute(t, "href")), F.transform(metas, lambda t: F.regexp_extract(_attribute(t, "content"), r"(?i)url\s*=\s*['\"]?([^'\"]+)", 1)))
    base = F.concat(F.substring_index(url, "://", 1), F.lit("://"), F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0))
    folder = F.regexp_extract(url_path(url), r"^(.*/)", 1)

    def absolute(t: Column) -> Column:
        t = F.replace(F.trim(t), F.lit("&amp;"), F.lit("&"))
        return (
            F.when(t == "", F.lit(None))
            .when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), t)
            .when(t.startswith("//"), F.concat(F.substring_index(url, "://", 1), F.lit(":"), t))
            .when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
            .when(t.startswith("/"), F.concat(base, t))
            .when(t.startswith("?") | t.startswith("#"), F.concat(base, url_path(url), t))
            .otherwise(F.concat(base, F.when(folder == "", F.lit("/")).otherwise(folder), t))
        )

    return F.filter(F.transform(named, absolute), lambda t: t.isNotNull() & (F.instr(t, "://") > 0))


def _key_id(url: Column) -> Column:
    return F.unhex(F.md5(alias_key(url).cast("binary")))


def judge_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict and blocked_alias (whether an alias is blocked by a rule) of every page.

    A null url and one without ``://`` have an empty host and path, fit no rule, have no aliases and
    are allowed. Urls that are named but aren't pages carry their rules' decisions too. A null html has
    no edges. Repeated rows stay; an empty table gives an empty table; other columns are not read.
    """
    url, html = F.col(url_col), F.col(html_col)
    edges = pages.select(url.alias("a"), F.explode(link_targets(url, html)).alias("b")).where(F.instr("a", "://") > 0).distinct()
    edges = cut(edges.select(_key_id(F.col("a")).alias("u"), _key_id(F.col("b")).alias("v"), *[(longest_rule(url_host(F.col(c)), url_path(F.col(c)), rules)["verdict"] == "block").alias(n) for c, n in (("a", "block_u"), ("b", "block_v"))]).where("u <> v"))
    own = pages.select(F.col(id_col).alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"), url.alias("url"))
    own = own.withColumn("hit", longest_rule(F.col("host"), F.col("path"), rules))
    if edges.limit(1).count():
        members = connected_components(edges, "u", "v")
        bad = edges.where("block_u").select(F.col("u").alias("node")).unionByName(edges.where("block_v").select(F.col("v").alias("node"))).distinct()
        groups = cut(members.join(bad, "node").select("component").distinct())
        nodes = cut(members.join(groups, "component", "left_semi").select("node"))
        own = own.withColumn("k", F.coalesce(_key_id(F.col("url")), F.md5(F.col("page_id").cast("string").cast("binary")).cast("binary")))
        own = own.join(nodes.withColumn("blocked_alias", F.lit(True)), own["k"] == nodes["node"], "left").withColumn("blocked_alias", F.coalesce("blocked_alias", F.lit(False)))
    else:
        own = own.withColumn("blocked_alias", F.lit(False))
    verdict = F.coalesce(F.col("hit.verdict"), F.when(F.col("blocked_alias"), F.lit("block")).otherwise(F.lit("allow")))
    return own.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "blocked_alias")
