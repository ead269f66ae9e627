"""URL algebra as column expressions; no exceptions: a bad URL gives null or false."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File endings that are never fetched, and those of documents. Fixed values.
BINARY = ("zip", "tar", "gz", "7z", "exe", "dmg", "msi", "png", "jpg", "jpeg", "gif", "svg", "webp", "ico", "bmp", "mp3", "mp4", "webm", "mov", "woff", "woff2", "ttf", "eot", "css", "js", "map")
DOCUMENT = ("pdf", "docx")
#: Endings of pages.
PAGE = (".html", ".htm", ".aspx")
_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*)://"


def scheme(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, _SCHEME, 1), F.lit("")))


def host(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, _SCHEME + r"([^/?#:]*)", 2), F.lit("")))


def port(url: Column) -> Column:
    return F.regexp_extract(url, _SCHEME + r"[^/?#:]*(:[0-9]+)?", 2)


def path(url: Column) -> Column:
    return F.regexp_extract(url, _SCHEME + r"[^/?#]*([^?#]*)", 2)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"(\?[^#]*)", 1)


def normalized(url: Column, keep_extension: bool = False) -> Column:
    """Scheme and host in small letters, no default port, fragment, page ending or trailing slash; the query stays."""
    p = path(url)
    if not keep_extension:
        p = F.regexp_replace(p, r"(?i)\.(html|htm|aspx)$", "")
    p = F.regexp_replace(p, "/+$", "")
    plain = F.when((scheme(url) == "http") & (port(url) == ":80"), "").when((scheme(url) == "https") & (port(url) == ":443"), "").otherwise(port(url))
    return F.when(host(url).isNotNull(), F.concat(scheme(url), F.lit("://"), host(url), plain, p, query(url)))


def canonical_hash(url: Column) -> Column:
    return F.sha2(normalized(url), 256)


def host_key(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), host(url))


def first_segment(url: Column) -> Column:
    return F.regexp_extract(path(url), "^(/[^/]*/?)", 1)


def in_root_scope(url: Column, root: str) -> Column:
    """Same scheme and host as ``root``, and a path below the last slash of its path."""
    r = F.lit(root)
    base = F.regexp_extract(path(r), "^(.*/)", 1)
    return F.coalesce((scheme(url) == scheme(r)) & (host(url) == host(r)) & F.startswith(path(url), base), F.lit(False))


def refused(url: Column, allow: list[str], deny: list[str], documents: bool = False) -> Column:
    """Struct (reason, detail): why a URL is not fetched, and the ending or the pattern that says so; nulls if it is.

    A binary ending before the query or the end (a document's too, unless ``documents`` are read), then no allowed pattern, then
    the first denied one that it matches.  Patterns match in any case; an empty list matches nothing.
    """
    binary = F.lower(F.regexp_extract(url, r"(?i)\.(" + "|".join(BINARY) + r")(?:\?|$)", 1))
    document = F.lit("") if documents else F.regexp_extract(path(url), r"\.(" + "|".join(DOCUMENT) + ")$", 1)
    any_of = lambda patterns: F.lit(False) if not patterns else url.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))
    denied = F.coalesce(*[F.when(url.rlike(f"(?i){p}"), F.lit(p)) for p in deny], F.lit(None).cast("string"))
    made = lambda reason, detail: F.struct(F.lit(reason).alias("reason"), detail.alias("detail"))
    none = F.lit(None).cast("string")
    return F.when(F.concat(binary, document) != "", made("BinaryExtension", F.when(binary != "", binary).otherwise(document))).when(~any_of(allow), made("PatternMissAllowed", none)).when(denied.isNotNull(), made("PatternExclude", denied)).otherwise(made(None, none).cast("struct<reason: string, detail: string>"))


def refusal(url: Column, allow: list[str], deny: list[str], documents: bool = False) -> Column:
    """The reason of ``refused`` alone."""
    return refused(url, allow, deny, documents)["reason"]


def with_extension(url: Column, extension: str | None) -> Column:
    """``url`` with a page's ending, if its path has none and names a page; the fragment goes. Bad URLs stay as they are."""
    if not extension:
        return url
    p = path(url)
    fits = host(url).isNotNull() & (p != "") & ~F.endswith(p, F.lit("/")) & ~F.lower(p).rlike("(?:" + "|".join(e.replace(".", r"\.") for e in PAGE) + ")$")
    plain = F.when((scheme(url) == "http") & (port(url) == ":80"), "").when((scheme(url) == "https") & (port(url) == ":443"), "").otherwise(port(url))
    return F.when(fits, F.concat(scheme(url), F.lit("://"), host(url), plain, p, F.lit(extension), query(url))).otherwise(url)


def default_job(root: str) -> dict:
    """What a crawl of ``root`` takes unless told otherwise: patterns and depths."""
    site = root.split("://", 1)[-1].split("/", 1)[0].split("?")[0].split("#")[0].lower()
    return {"root": root, "allow": [site.replace(".", r"\.")], "deny": [r"/blog/", r"/login/", r"/signin/", r"/account/", r"#"], "scope_depth": 10, "host_depth": 2, "off_depth": 1}


def crawl_decision(url: Column, depth: Column, seen: Column, root: str, allow: list[str], deny: list[str], host_depth: int = 2, off_depth: int = 1, scope_depth: int = 0) -> Column:
    """Struct (decision, reason) in the crawler's order: seen, refused, code host, too deep, fetched. Scope depth 0: no limit."""
    scoped = in_root_scope(url, root)
    limit = F.when(scoped, scope_depth).when(host(url) == host(F.lit(root)), host_depth).otherwise(off_depth)
    no = refusal(url, allow, deny)
    reason = (
        F.when(seen, "AlreadyVisited").when(no.isNotNull(), no).when(host(url) == "github.com", "CodeHost")
        .when((limit > 0) & (depth > limit), F.when(scoped, "OffSiteDepth").when(host(url) == host(F.lit(root)), "SameHostDepth").otherwise("OffSiteDepth"))
    )
    decision = F.when(reason.isNull(), "Fetched").when(reason == "CodeHost", "Diverted").otherwise("Skipped")
    return F.struct(decision.alias("decision"), F.coalesce(reason, F.lit("")).alias("reason"))


def child_counters(url: Column, in_scope: Column, same_host: Column, off_site: Column, root: str) -> Column:
    """Struct (in_scope, same_host, off_site): steps to a link of a page that is so many steps away, by where the link leads;
    a link back into scope starts the others anew."""
    scoped = in_root_scope(url, root)
    same = F.coalesce((scheme(url) == scheme(F.lit(root))) & (host(url) == host(F.lit(root))), F.lit(False))
    made = lambda a, b, c: F.struct(a.cast("long").alias("in_scope"), b.cast("long").alias("same_host"), c.cast("long").alias("off_site"))
    return F.when(scoped, made(in_scope + 1, F.lit(0), F.lit(0))).when(same, made(in_scope, same_host + 1, off_site)).otherwise(made(in_scope, same_host, off_site + 1))


def code_host_parts(url: Column) -> Column:
    """Struct (owner, repo) of a github.com URL; nulls for others."""
    p = r"^https?://(?:www\.)?github\.com/([^/?#]+)/([^/?#]+)"
    part = lambda i: F.nullif(F.regexp_replace(F.regexp_extract(url, p, i), r"\.git$", ""), F.lit(""))
    return F.struct(part(1).alias("owner"), part(2).alias("repo"))


def is_rate_limited(status: Column, extra: tuple[int, ...] = ()) -> Column:
    return status.isin(429, 503, *extra)


def retry_after(header: Column, now: Column) -> Column:
    """Seconds to wait by a Retry-After header: a number of seconds, or an HTTP date less ``now``; null for neither, 0 at least."""
    at = F.try_to_timestamp(F.regexp_extract(header, r"^[A-Za-z]{3}, (.*) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    seconds = F.when(F.trim(header).rlike("^[0-9]{1,9}$"), F.trim(header).cast("long")).otherwise(F.unix_seconds(at) - F.unix_seconds(now))
    return F.when(seconds > 0, seconds).when(seconds.isNotNull(), F.lit(0).cast("long"))


def backoff_seconds(attempt: Column, cap: int = 5) -> Column:
    return F.least(F.lit(cap), F.pow(F.lit(2), attempt).cast("int"))


def failed_crawl(pages: Column, errors: Column) -> Column:
    return (pages == 0) | ((errors >= 10) & (errors > 10 * pages))
