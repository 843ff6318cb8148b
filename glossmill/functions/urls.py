"""Parts of URLs and resolution of links, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Schemes that mark a link as complete.
SCHEMES = "data file gopher http ldap mailto news nntp pop rlogin rtsp rtspu rsync snews telnet ssh urn".split()


def site_of(url: Column) -> Column:
    """The host, with or without ``http://`` before it, without a port."""
    return F.regexp_extract(url, r"^(?:https?://)?([^/:?#]*)", 1)


def base_of(url: Column) -> Column:
    """The folder of a URL without its scheme, ending in a slash."""
    bare = F.regexp_replace(url, "^http://", "")
    is_file = bare.rlike(r"\.[^./\\]{2,8}$") | bare.rlike(r"\?.*$")
    cut = F.when(is_file, F.regexp_replace(bare, r"[/\\][^/\\]*$", "")).otherwise(bare)
    return F.when(bare.rlike(r"[/\\]$"), bare).otherwise(F.concat(cut, F.lit("/")))


def _folded(url: Column) -> Column:
    """A URL whose ``..`` parts took the part before them away, however many there are; the last part stays."""
    parts = F.split(url, "/")

    def step(done: Column, part: Column) -> Column:
        top = F.element_at(done, -1)
        goes = (part == "..") & (F.size(done) > 1) & (top != "") & (top != "..")
        return F.when(goes, F.slice(done, 1, F.size(done) - 1)).otherwise(F.concat(done, F.array(part)))

    done = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), F.slice(parts, 1, 1), step)
    return F.when(F.size(parts) < 3, url).otherwise(F.array_join(F.concat(done, F.slice(parts, -1, 1)), "/"))


def clean_link(link: Column, page: Column) -> Column:
    """A link of ``page`` in full without ``http://``: fragment cut, prefix added, ``.`` and ``..``
    folded. A link that is only a fragment is the page."""
    bare = F.regexp_replace(link, "#.*$", "")
    base = F.concat(F.lit("http://"), base_of(page))
    prefix = F.when(bare.rlike("(?i)^(" + "|".join(SCHEMES) + ")"), F.lit("")).when(bare.startswith("/"), site_of(base)).otherwise(base)
    url = F.concat(prefix, bare)
    url = F.regexp_replace(url, r"/(\./)+", "/")
    url = _folded(url)
    url = F.regexp_replace(url, r"//(\.\./)+", "//")
    return F.when(bare == "", F.regexp_replace(page, "^http://", "")).otherwise(F.regexp_replace(url, "^http://", ""))
