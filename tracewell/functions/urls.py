"""URLs of runs, jobs, branches, files and repositories: parsing, building and keys; all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A host of labels, an IPv4 or a bracketed IPv6 address, and a port.
HOST = r"(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)*|\[[0-9a-f:.]+\])"
WHOLE = rf"(?i)^(https?)://({HOST})\.?(?::([1-9][0-9]{{0,4}}))?(/[^?#]*)?(?:\?([^#]*))?$"
LOCAL = ("localhost", "127.0.0.1", "[::1]")
SEGMENT = r"[A-Za-z0-9_.][A-Za-z0-9_.-]*"
#: The only parameters that a reference may carry.
QUERY = r"^(?:(?:ref_type=(?:heads|tags)|inline=(?:true|false))(?:&(?!$)|$))+$"


def reference(url: Column) -> Column:
    """(kind, base, project, pipeline_id, job_id, ref, file_path) of a GitLab URL; null if it is no such URL.

    ``kind`` is repository, pipeline, job or branch; a file is part of a branch, its name after the
    last slash, as a ref may hold slashes too. Hosts are lower-cased and default ports dropped. URLs
    with credentials, fragments, other parameters, steps upward, or plain HTTP to another host than
    the local one are refused.
    """
    raw = F.trim(url)
    scheme, host, port = F.lower(F.regexp_extract(raw, WHOLE, 1)), F.lower(F.regexp_extract(raw, WHOLE, 2)), F.regexp_extract(raw, WHOLE, 3)
    query = F.regexp_extract(raw, WHOLE, 5)
    path = F.regexp_replace(F.try_url_decode(F.replace(F.regexp_extract(raw, WHOLE, 4), F.lit("+"), F.lit("%2B"))), "/+$", "")
    default = F.when(scheme == "https", "443").otherwise("80")
    base = F.concat(scheme, F.lit("://"), host, F.when((port == "") | (port == default), "").otherwise(F.concat(F.lit(":"), port)))
    sound = raw.rlike(WHOLE) & ~raw.rlike(r"[\s\\\x00-\x1f\x7f]") & (F.length(raw) <= 8192) & ((scheme == "https") | host.isin(*LOCAL)) & (F.coalesce(port.try_cast("int"), F.lit(1)) <= 65535)
    sound = sound & path.isNotNull() & ~path.rlike(r"//|[%\\\x00-\x1f\x7f]|(?:^|/)\.{1,2}(?:/|$)")
    resource = F.when(path.contains("/-/"), F.regexp_extract(path, r"^.*?/-/(.*)$", 1))
    project = F.regexp_extract(path, r"^/(.*?)(?:/-/.*)?$", 1)
    project = F.when(resource.isNull(), F.regexp_replace(project, r"\.git$", "")).otherwise(project)
    found = lambda p, g=1: F.nullif(F.regexp_extract(resource, p, g), F.lit(""))
    pipeline, job = found("^pipelines/([1-9][0-9]*)$"), found("^jobs/([1-9][0-9]*)$")
    tree, ref, file = found("^tree/(.+)$"), found("^(?:blob|raw)/(.+)/([^/]+)$"), found("^(?:blob|raw)/(.+)/([^/]+)$", 2)
    kind = F.when(resource.isNull(), "repository").when(pipeline.isNotNull(), "pipeline").when(job.isNotNull(), "job").when(tree.isNotNull() | ref.isNotNull(), "branch")
    asked = F.when(kind == "branch", (query == "") | query.rlike(QUERY)).otherwise(query == "")
    ok = sound & kind.isNotNull() & asked & project.rlike(rf"^{SEGMENT}(?:/{SEGMENT})+$")
    none = F.lit(None).cast("string")
    parts = F.struct(kind.alias("kind"), base.alias("base"), project.alias("project"), pipeline.alias("pipeline_id"), job.alias("job_id"), F.coalesce(tree, ref).alias("ref"), F.coalesce(file, none).alias("file_path"))
    return F.when(ok, parts)


def quoted(part: Column, safe: str = "") -> Column:
    """Percent-encoded as in a path: a blank is ``%20``, what is in ``safe`` stays."""
    out = F.replace(F.replace(F.url_encode(part), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    out = F.replace(out, F.lit("%7E"), F.lit("~"))
    for c in safe:
        out = F.replace(out, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return out


def blob_url(provider: Column, web_url: Column, ref: Column, path: Column, line: Column) -> Column:
    """A link to a line of a source file; null without a ref, for an absolute path or another provider."""
    ok = (ref != "") & (path != "") & ~path.rlike(r"^(?:/|https?://)")
    between = F.when(F.lower(provider) == "gitlab", "/-/blob/").when(F.lower(provider) == "github", "/blob/")
    return F.when(ok, F.concat(F.regexp_replace(web_url, "/+$", ""), between, quoted(ref), F.lit("/"), quoted(path, "/"), F.coalesce(F.concat(F.lit("#L"), line.cast("string")), F.lit(""))))


def include_key(project: Column, path: Column, ref: Column) -> Column:
    """One key for a file that is included from another project at a ref."""
    return F.concat(F.lit("project-include://"), quoted(project), F.lit("?ref="), quoted(ref), F.lit("&file="), quoted(path))


def include_parts(key: Column) -> Column:
    """(project, ref, path) of an ``include_key``; null for anything else, or where the path is not plain."""
    pattern = r"^project-include://([^/?#]+)\?ref=([^&#]+)&file=([^&#]+)$"
    part = lambda g: F.try_url_decode(F.regexp_extract(key, pattern, g))
    ok = key.rlike(pattern) & part(1).rlike(rf"^{SEGMENT}(?:/{SEGMENT})+$") & ~part(3).rlike(r"^/|//|(?:^|/)\.{1,2}(?:/|$)|[\\*]") & ~part(2).rlike(r"[$\s]")
    return F.when(ok, F.struct(part(1).alias("project"), part(2).alias("ref"), part(3).alias("path")))


def own_host(url: Column, base: Column) -> Column:
    """The URL if it is on the host of ``base``, else null."""
    of = lambda x: F.lower(F.regexp_extract(x, r"^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#@]*)", 1))
    return F.when((of(url) == of(base)) & (of(url) != ""), url)
