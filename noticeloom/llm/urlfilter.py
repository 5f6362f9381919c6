"""Operator 9: URL rules, and block decisions carried over redirects and canonical links."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeloom.llm.common import cut, sliced, table
from noticeloom.llm.components import connected_components

#: (verdict, host, path) of the production rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
AFTER = r"^.*?://"
#: The first link of either kind, as the SQL takes it.
CANONICAL = (
    r"<link\b[^>]*\brel=[\"']?canonical\b[^>]*\bhref=[\"']([^\"'>]+)",
    r"<link\b[^>]*\bhref=[\"']([^\"'>]+)[\"'][^>]*\brel=[\"']?canonical\b",
)
REFRESH = r"<meta\b[^>]*\bhttp-equiv=[\"']?refresh\b[^>]*\burl=[\"']?([^\"'>\s]+)"

#: Comments, scripts and styles, which hold no links, or a tag with its attributes, closed or not; quotes count after ``=`` only.
TAGS = re.compile(r"""(?is)<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1|\Z)|<(link|meta|base)(?=[\s/>])((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|[="'])*+)(>|\Z)""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
ENTITY = re.compile(r"&(?:#(\d+)|#[xX]([0-9a-fA-F]+)|([A-Za-z][A-Za-z0-9]*))(;|(?![=A-Za-z0-9]))")
RELOAD = re.compile(r"""(?is)^\s*[\d.]*\s*[;,\s]\s*(?:url\s*=\s*)?(?:"([^"]*)|'([^']*)|(.*))""")
SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")


def unescaped(value: str) -> str:
    """An attribute's value with its entities decoded; one without ``;`` only if no word goes on behind it."""

    def one(m: re.Match) -> str:
        if m.group(3):
            return html5.get(m.group(3) + m.group(4), m.group())
        code = int(m.group(1)[:8]) if m.group(1) else int(m.group(2)[:8], 16)
        return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else m.group()

    return ENTITY.sub(one, value)


def resolved(base: str, ref: str) -> str:
    """A reference as seen from the address ``base`` (with ``://``), by RFC 3986."""
    if SCHEME.match(ref):
        return ref
    scheme, _, rest = base.partition("://")
    if ref.startswith("//"):
        return f"{scheme}:{ref}"
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    own = re.match(r"[^?#]*", ref).group()
    if not own:
        return f"{scheme}://{host}{path}{ref}" if ref.startswith("?") else base.partition("#")[0] + ref
    parts: list[str] = []
    names = (own if own.startswith("/") else (path[: path.rfind("/") + 1] or "/") + own).split("/")[1:]
    for i, name in enumerate(names):
        if name == "..":
            del parts[-1:]
        if name not in (".", ".."):
            parts.append(name)
        elif i == len(names) - 1:
            parts.append("")
    return f"{scheme}://{host}/{'/'.join(parts)}{ref[len(own) :]}"


def page_aliases(url: str, html: str) -> list[str]:
    """The addresses that all canonical links and refresh redirects of a page name, seen from its ``<base>``."""
    base, found = None, []
    for m in TAGS.finditer(html):
        if not m.group(2) or not m.group(4):  # no tag, or one that swallows the rest of the page
            continue
        tag, has = m.group(2).lower(), {}
        for a in ATTRIBUTE.finditer(m.group(3)):
            has.setdefault(a.group(1).lower(), re.sub(r"[\t\n\r]", "", unescaped(a.group(2) or a.group(3) or a.group(4) or "")).strip() if a.group(1).lower() in ("href", "content") else (a.group(2) or a.group(3) or a.group(4) or "").lower())
        if tag == "base" and base is None and has.get("href"):
            base = resolved(url, has["href"])
        elif tag == "link" and "canonical" in has.get("rel", "").split():
            found.append(has.get("href", ""))
        elif tag == "meta" and has.get("http-equiv", "").strip() == "refresh":
            target = RELOAD.match(has.get("content", ""))
            found.append(next((x for x in target.groups() if x), "").strip() if target else "")
    base = base if base and "://" in base else url
    return list(dict.fromkeys(resolved(base, x) for x in found if x))


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.substring_index(F.substring_index(F.substring_index(_rest(url), "/", 1), "?", 1), "#", 1)
    return F.translate(rest, UPPER, LOWER)


def url_path(url: Column) -> Column:
    """From the host on up to ``?``, ``#`` or the end."""
    bare = F.substring_index(F.substring_index(_rest(url), "?", 1), "#", 1)
    return F.substring(bare, F.char_length(F.substring_index(bare, "/", 1)) + 1, F.lit(2**31 - 1))


def _rest(url: Column) -> Column:
    at = F.instr(url, F.lit("://"))
    return F.when(at > 0, F.substring(url, at + 3, F.lit(2**31 - 1))).otherwise("")


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as ``host`` + ``path``, and its verdict; equally long: allow first."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1], r[2]))
    name = verdict = None
    for what, at, start in ordered:
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(start)
        name = F.when(fits, at + start) if name is None else name.when(fits, at + start)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if name is None else (name, verdict)


def node(url: Column) -> Column:
    """An address as a node of the alias graph: without its fragment, host lower-cased."""
    bare = F.substring_index(url, "#", 1)
    at = F.instr(bare, F.lit("://"))
    return F.when(at > 0, F.concat(F.translate(F.substring_index(bare, "://", 1), UPPER, LOWER), F.lit("://"), url_host(bare), F.substring(_rest(bare), F.char_length(url_host(bare)) + 1, F.lit(2**31 - 1))))


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(src, dst)`` from every canonical link and refresh redirect; relative targets are resolved from the page's address."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            urls, texts = part.column("url"), part.column("html")
            pairs = [(u, to) for i in range(part.num_rows) for u in (urls[i].as_py(),) for to in page_aliases(u, texts[i].as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string())], ["url", "to"])

    html, url = F.col(html_col), F.col(url_col)
    likely = (F.lower(html).contains("canonical") | F.lower(html).contains("refresh")) & url.contains("://")
    links = pages.where(likely).select(url.alias("url"), html.alias("html")).mapInArrow(run, "url string, to string")
    return links.select(node(F.col("url")).alias("src"), node(F.col("to")).alias("dst")).where("src is not null and dst is not null")


def filter_urls(
    pages: DataFrame,
    redirects: DataFrame | None = None,
    rules: Sequence[tuple[str, str, str]] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    default: str = "allow",
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` and ``via`` of every page.

    A page's own rule decides first. Pages without one follow their aliases, the connected
    component of canonical links, refresh redirects and the optional ``redirects(src, dst)``: an
    explicit allow of any alias wins, else a block of any alias, else ``default``. ``via`` says
    which (rule, alias, default). A null url, or one without ``://``, has an empty host and path
    and no aliases. Repeated pages and cyclic redirects are fine.
    """
    edges = alias_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node(F.col("src")).alias("src"), node(F.col("dst")).alias("dst")))
    edges = cut(edges.distinct())
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), url_host(F.coalesce(url, F.lit(""))).alias("host"), url_path(F.coalesce(url, F.lit(""))).alias("path"), node(url).alias("node"))
    rule, own = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("own", own)
    if edges.isEmpty():
        rows = rows.withColumn("carried", F.lit(None).cast("string"))
    else:
        labels = connected_components(edges)
        name, said = rule_for(url_host(F.col("node")), url_path(F.col("node")), rules)
        said = labels.withColumn("said", said).groupBy("component").agg(F.min("said").alias("carried"))  # "allow" sorts before "block"
        carried = labels.join(said, "component").select("node", "carried")
        rows = rows.join(carried, "node", "left")
    verdict = F.coalesce("own", "carried", F.lit(default))
    via = F.when(F.col("own").isNotNull(), "rule").when(F.col("carried").isNotNull(), "alias").otherwise("default")
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), via.alias("via"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def _sql_node(url: str) -> str:
    bare = f"split_part({url}, '#', 1)"
    rest = f"substr({bare}, instr({bare}, '://') + 3)"
    host = f"regexp_extract({rest}, '^[^/?#]*')"
    return f"CASE WHEN instr({bare}, '://') > 0 THEN lower(split_part({bare}, '://', 1)) || '://' || lower({host}) || substr({rest}, length({host}) + 1) END"


def _sql_rule(host: str, path: str, what: str) -> str:
    ordered = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1], r[2]))
    return "CASE " + " ".join(f"WHEN ({host} = '{h}' OR {host} LIKE '%.{h}') AND {path} LIKE '{p}%' THEN '{h + p if what == 'rule' else v}'" for v, h, p in ordered) + " END"


_EXTRACTS = ", ".join("regexp_extract(coalesce(html, ''), '(?is)" + p.replace("'", "''") + "', 1)" for p in (*CANONICAL, REFRESH))
OP9_SQL = f"""
WITH RECURSIVE p AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (
  SELECT page_id, {_sql_node('url')} AS node, lower(regexp_extract(coalesce(rest, ''), '^[^/?#]*')) AS host,
         regexp_extract(substr(coalesce(rest, ''), length(regexp_extract(coalesce(rest, ''), '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM p),
t AS (SELECT url, unnest([{_EXTRACTS}]) AS link FROM pages),
f AS (
  SELECT url, CASE WHEN link LIKE '//%' THEN split_part(url, '://', 1) || ':' || link
                   WHEN link LIKE '/%' THEN split_part(url, '://', 1) || '://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) || link
                   ELSE link END AS link FROM t WHERE link <> ''),
d AS (SELECT DISTINCT {_sql_node('url')} AS a, {_sql_node('link')} AS b FROM f),
e AS (SELECT a, b FROM d WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM d WHERE a IS NOT NULL AND b IS NOT NULL),
reach AS (SELECT a AS node, a AS other FROM e UNION SELECT reach.node, e.b FROM reach JOIN e ON reach.other = e.a),
o AS (SELECT node, lower(regexp_extract(other, '://([^/?#]*)', 1)) AS host, regexp_extract(other, '://[^/?#]*([^?#]*)', 1) AS path FROM reach),
c AS (SELECT node, min({_sql_rule('host', 'path', 'verdict')}) AS carried FROM o GROUP BY node),
z AS (SELECT q.*, {_sql_rule('host', 'path', 'rule')} AS rule, {_sql_rule('host', 'path', 'verdict')} AS own FROM q)
SELECT page_id, host, path, rule, coalesce(own, carried, 'allow') AS verdict,
       CASE WHEN own IS NOT NULL THEN 'rule' WHEN carried IS NOT NULL THEN 'alias' ELSE 'default' END AS via
FROM z LEFT JOIN c ON z.node = c.node
"""
