"""URL block and allow rules whose decisions travel along redirects and canonical links."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, arrow_batch, map_batches, small, store, struct
from .components import connected_components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
#: What the named character references of HTML stand for.
_NAMED = json.dumps({name[:-1]: text for name, text in html5.items() if name.endswith(";")})
#: Up to so many rules are tested inside the scan; more go through a join on host suffixes.
INLINE_RULES = 256


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _SPLIT, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def _inline(rules: list[Rule], host: Column, path: Column) -> Column:
    """The longest rule that fits as struct(rule, verdict); of equally long ones allow wins."""
    table = F.array(*[F.struct(F.lit(len(r.name)).alias("size"), F.lit(r.verdict == "allow").alias("allows"), F.lit(r.name).alias("rule"), F.lit(r.host).alias("host"), F.lit(r.path).alias("path"), F.lit(r.verdict).alias("verdict")) for r in rules])
    fits = F.filter(table, lambda r: ((host == r.host) | host.endswith(F.concat(F.lit("."), r.host))) & path.startswith(r.path))
    return F.array_max(fits)


def match_rules(urls: DataFrame, rules: list[Rule], host: str = "host", path: str = "path") -> DataFrame:
    """``urls`` plus columns rule and decision (null where no rule fits)."""
    if not rules:
        return urls.withColumns({"rule": F.lit(None).cast("string"), "decision": F.lit(None).cast("string")})
    if len(rules) <= INLINE_RULES:
        best = urls.withColumn("__best", _inline(rules, F.col(host), F.col(path)))
        return best.withColumns({"rule": F.col("__best.rule"), "decision": F.col("__best.verdict")}).drop("__best")
    table = urls.sparkSession.createDataFrame([(r.host, r.path, r.verdict, r.name) for r in rules], "r_host string, r_path string, decision string, rule string")
    labels = F.split(F.col(host), r"\.")
    keyed = urls.select(host, path).distinct().withColumn("__suffix", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    hit = keyed.join(small(table, len(rules), 200), F.col("__suffix") == F.col("r_host")).where(F.col(path).startswith(F.col("r_path")))
    best = hit.groupBy(host, path).agg(F.max(F.struct(F.length("rule").alias("size"), (F.col("decision") == "allow").alias("allows"), "rule", "decision")).alias("best"))
    return urls.join(best, [host, path], "left").withColumns({"rule": F.col("best.rule"), "decision": F.col("best.decision")}).drop("best")


def node_of(url: Column) -> Column:
    """A URL as a node of the alias graph: no fragment, scheme and host in lower case."""
    bare = F.regexp_replace(F.trim(url), r"(?s)#.*$", "")
    head = F.regexp_extract(bare, r"(?s)^(.*?://[^/?]*)", 1)
    return F.concat(F.translate(head, _UPPER, _LOWER), F.substr(bare, F.length(head) + 1))


def unescaped(text: Column) -> Column:
    """HTML character references, named or by number and closed by a semicolon, as what they stand for."""
    named = F.from_json(F.lit(_NAMED), "map<string,string>")

    def piece(x: Column) -> Column:
        ref = F.regexp_extract(x, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        code = F.when(ref.rlike("^#[xX]"), F.conv(F.substr(ref, F.lit(3)), 16, 10)).when(ref.startswith("#"), F.substr(ref, F.lit(2))).cast("int")
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).when(ref != "", F.try_element_at(named, ref))
        return F.coalesce(F.concat(char, F.substr(x, F.length(ref) + 2)), F.concat(F.lit("&"), x))

    parts = F.split(text, "&")
    return F.when(text.contains("&"), F.array_join(F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(piece(x))), "")).otherwise(text)


def _undotted(path: Column) -> Column:
    """A path that starts with a slash, without its ``.`` and ``..`` segments."""
    parts = F.split(F.concat(path, F.when(path.rlike(r"/\.\.?$"), "/").otherwise("")), "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(x))))
    return F.when(path.contains("/."), F.array_join(kept, "/")).otherwise(path)


def resolve(base: Column, target: Column) -> Column:
    """The url that ``target`` names on the page ``base``, without fragment; null where it names none."""
    bare = F.regexp_replace(F.trim(target), r"(?s)#.*$", "")
    origin = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    path, query = F.regexp_extract(bare, r"(?s)^([^?]*)", 1), F.regexp_extract(bare, r"(?s)^[^?]*(.*)$", 1)
    folder = F.when(path_of(base) == "", "/").otherwise(F.regexp_replace(path_of(base), r"[^/]*$", ""))
    within = F.when(path.startswith("/"), path).otherwise(F.concat(folder, path))
    return (
        F.when(bare.rlike(_SCHEME + "//"), bare)
        .when((bare == "") | bare.rlike(_SCHEME) | (origin == ""), F.lit(None).cast("string"))
        .when(bare.startswith("//"), F.concat(F.regexp_extract(origin, r"(?s)^(.*?:)//", 1), bare))
        .when(bare.startswith("?"), F.concat(origin, path_of(base), bare))
        .otherwise(F.concat(origin, _undotted(within), query))
    )


_NAME = re.compile(r"<([A-Za-z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)|(["'])|(?=>)))?)""")
_REFRESH = re.compile(r"""(?is)\s*[\d.]*\s*[;,\s]\s*(?:url\s*=\s*)?(?:"([^"]*)|'([^']*)|(.*))""")
#: Elements whose content is text, whatever tags it looks like.
_RAW = {name: re.compile(rf"(?i)</{name}(?=[\s/>])") for name in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}


def start_tags(html: str) -> Iterator[tuple[str, dict[str, str]]]:
    """Start tags with their attributes, names in lower case, the first of equal names; in one pass over the text.

    Comments and the content of scripts, styles and other elements of plain text are passed over. A
    tag that the text ends in is none.
    """
    at = 0
    while (at := html.find("<", at)) >= 0:
        if html.startswith("<!--", at):
            at = html.find("-->", at + 2)
            if at < 0:
                return
            continue
        named = _NAME.match(html, at)
        if not named:
            at += 1
            continue
        at, attributes = named.end(), {}
        while (found := _ATTRIBUTE.match(html, at)) and not found[1]:
            if found[6]:  # a quote that nothing closes
                return
            attributes.setdefault(found[2].lower(), found[3] or found[4] or found[5] or "")
            at = found.end()
        if not found:
            return
        at, name = found.end(), named[1].lower()
        yield name, attributes
        if name in _RAW:
            end = _RAW[name].search(html, at)
            if not end:
                return
            at = end.start()


def targets_of(html: str) -> list[str]:
    """What the canonical links and refresh redirects of a page point to, as written."""
    out = []
    for name, attributes in start_tags(html):
        if name == "link" and "canonical" in attributes.get("rel", "").lower().split():
            out.append(attributes.get("href", ""))
        elif name == "meta" and attributes.get("http-equiv", "").strip().lower() == "refresh":
            found = _REFRESH.match(attributes.get("content", ""))
            out.append(next((x for x in found.groups() if x), "") if found else "")
    return [x for x in out if x.strip()]


def alias_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): a page's url and the targets of all its canonical links and refresh redirects."""
    url = F.col(url_col)
    rows = pages.where(url.isNotNull() & F.col(html_col).rlike("(?i)canonical|refresh")).select(url.alias("u"), F.col(html_col).alias("h"))
    schema = struct(u="string", t="array<string>")

    def run(batch):
        yield arrow_batch(schema, {"u": batch.column("u"), "t": [targets_of(h) for h in batch.column("h").to_pylist()]})

    found = map_batches(rows, run, schema)
    # two passes in the generator: each step is planned once, however often the next one names it
    targets = F.transform(F.transform("t", unescaped), lambda x: resolve(F.trim("u"), x))
    linked = found.select(F.col("u").alias("__url"), F.explode(targets).alias("__to")).where("__to is not null")
    return linked.select(node_of(F.col("__url")).alias("a"), node_of(F.col("__to")).alias("b"))


def judge(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None, url_col: str = "url", html_col: str | None = "html", id_col: str = "page_id", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) of every page.

    A page that a rule fits gets that rule's verdict (the longest rule; of equally
    long ones, allow). Redirects (from_url, to_url), canonical links and refresh
    redirects join urls into classes of aliases, also by way of urls that are no
    page. Where no rule fits a page, its class decides: an explicit allow of any
    member wins, else an explicit block of any member blocks, else ``default``.
    Relative targets are resolved against the page's url (``base`` tags aren't read) and
    their character references decoded; targets of schemes without ``//`` are not links. A url that is
    null or has no ``://`` has an empty host and path and the default verdict;
    repeated rows are judged each; null and empty html has no links, long html is searched whole;
    other columns aren't read, whatever their names; empty tables give no rows.
    """
    rows = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__u")).withColumns({"host": host_of(F.col("__u")), "path": path_of(F.col("__u"))})
    judged = match_rules(rows, rules)
    links = [alias_links(pages, url_col, html_col)] if html_col else []
    if redirects is not None:
        links.append(redirects.select(node_of(F.col("from_url")).alias("a"), node_of(F.col("to_url")).alias("b")))
    out = [F.col("__id").alias(id_col), "host", "path", "rule"]
    if not links:
        return judged.select(*out, F.coalesce("decision", F.lit(default)).alias("verdict"))
    edges = links[0] if len(links) == 1 else links[0].unionByName(links[1])
    classes = connected_components(edges)
    members = match_rules(classes.withColumns({"host": host_of(F.col("node")), "path": path_of(F.col("node"))}), rules)
    votes = members.groupBy("component").agg(F.bool_or(F.col("decision") == "allow").alias("allows"), F.bool_or(F.col("decision") == "block").alias("blocks"))
    shared = F.when(F.col("allows"), "allow").when(F.col("blocks"), "block")
    spread = store(classes.join(votes, "component").select(F.col("node").alias("__node"), shared.alias("__shared")).where("__shared is not null"), "alias-verdicts")
    n_nodes, size = spread.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("__node")), F.lit(0))).first()
    side = F.broadcast(spread) if size + 64 * n_nodes <= BROADCAST_BYTES else spread
    joined = judged.withColumn("__key", node_of(F.col("__u"))).join(side, F.col("__key") == F.col("__node"), "left")
    return joined.select(*out, F.coalesce("decision", "__shared", F.lit(default)).alias("verdict"))
