"""URL functions over columns. Not covered: international host names, percent re-encoding, dot segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Query parameters that only track, and what is no page of text.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "mc_cid", "mc_eid", "ref", "source"]
BLOCKED_EXTENSIONS = [".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp", ".mp4", ".mp3", ".wav", ".pdf", ".zip", ".tar", ".gz"]
BLOCKED_HOSTS = ["youtube.com", "youtu.be", "vimeo.com", "dailymotion.com", "twitch.tv", "tiktok.com", "spotify.com", "podcasts.apple.com"]
BLOCKED_PATHS = [r"/video/", r"/videos/", r"/watch\b", r"/embed/", r"/podcast/", r"/episode/", r"/live\b"]

_URL = r"^\s*([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#@]*@)?([^/?#:\s]+)(:\d*)?([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, _URL, i)


def is_url(url: Column) -> Column:
    """Whether the text is an absolute URL with a host."""
    return F.coalesce(url.rlike(_URL), F.lit(False))


def split_requests(rows: DataFrame, url: str = "url") -> tuple[DataFrame, DataFrame]:
    """Rows whose address can be asked for, and the rejects with `reason`: `empty` or `not an address`."""
    blank = F.trim(F.coalesce(F.col(url), F.lit(""))) == ""
    rejects = rows.where(~is_url(F.col(url))).withColumn("reason", F.when(blank, "empty").otherwise("not an address"))
    return rows.where(is_url(F.col(url))), rejects


def host_of(url: Column) -> Column:
    return F.lower(_part(url, 2))


def path_of(url: Column) -> Column:
    p = F.regexp_replace(_part(url, 4), r"\s+$", "")
    return F.when(p == "", "/").otherwise(p)


def normalize_url(url: Column) -> Column:
    """One spelling per address: lower-case scheme and host, no default port, fragment or tracking parameter, the other parameters in the order of their names, no trailing slash but the root's. What is no URL stays as it is."""
    scheme, port = F.lower(_part(url, 1)), _part(url, 3)
    port = F.when((port == ":") | ((scheme == "http") & (port == ":80")) | ((scheme == "https") & (port == ":443")), "").otherwise(port)
    params = F.filter(F.split(F.regexp_replace(F.regexp_replace(_part(url, 5), r"\s+$", ""), r"^\?", ""), "&"), lambda p: p != "")
    kept = F.filter(F.transform(params, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("k"), i.alias("i"), p.alias("p"))), lambda s: ~(s["k"].isin(*TRACKING) | s["k"].startswith("utm_")))
    query = F.array_join(F.transform(F.array_sort(kept), lambda s: s["p"]), "&")
    path = path_of(url)
    whole = F.concat(scheme, F.lit("://"), host_of(url), port, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(is_url(url), F.when(whole.endswith("/") & (path != "/"), F.substring(whole, 1, F.length(whole) - 1)).otherwise(whole)).otherwise(url)


def is_analyzable_url(url: Column) -> Column:
    """Whether the address can be a page of text: http(s), and no blocked extension, host or path."""
    ext = F.lower(F.regexp_extract(path_of(url), r"(\.\w+)$", 1))
    target = F.concat(path_of(url), _part(url, 5))
    bare = F.regexp_replace(host_of(url), r"^www\.", "")
    return is_url(url) & F.lower(_part(url, 1)).isin("http", "https") & ~ext.isin(*BLOCKED_EXTENSIONS) & ~bare.isin(*BLOCKED_HOSTS) & ~target.rlike("(?i)" + "|".join(BLOCKED_PATHS))


def title_from_url(url: Column) -> Column:
    """A title from the last path segment, else the host; of what is no URL the first 80 characters."""
    segments = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    last = F.substring(F.regexp_replace(F.regexp_replace(F.try_element_at(segments, F.lit(-1)), "[-_]", " "), r"\.\w+$", ""), 1, 100)
    return F.when(is_url(url), F.coalesce(last, host_of(url))).otherwise(F.substring(url, 1, 80))


def publisher_from_url(url: Column) -> Column:
    return F.when(is_url(url), F.regexp_replace(host_of(url), r"^www\.", "")).otherwise("")
