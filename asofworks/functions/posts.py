"""Column expressions on posts, profiles and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Platforms by the label of a link, and by its host.
LABEL_PLATFORM = {
    "x": "x", "twitter": "x", "linkedin": "linkedin", "farcaster": "farcaster", "warpcast": "farcaster", "github": "github",
    "web": "website", "website": "website", "instagram": "instagram", "youtube": "youtube", "substack": "substack", "medium": "medium",
}
HOST_PLATFORM = {
    "twitter.com": "x", "x.com": "x", "linkedin.com": "linkedin", "farcaster.xyz": "farcaster", "warpcast.com": "farcaster",
    "github.com": "github", "instagram.com": "instagram", "youtube.com": "youtube", "substack.com": "substack", "medium.com": "medium",
}
# Typographic marks and what stands for them, in the wider fold of quote audits.
WIDE_MARKS, WIDE_PLAIN = "‘’‚‛“”„‟′″—–―", "''''\"\"\"\"'\"---"


def post_type(reposted: Column, quoted: Column, reply: Column) -> Column:
    """A repost before a quote, a quote before a reply; else original."""
    return F.when(reposted.isNotNull(), "retweet").when(quoted.isNotNull(), "quote").when(F.coalesce(reply, F.lit(False)), "reply").otherwise("original")


def alternate_host(url: Column, one: str, other: str) -> Column:
    """The same address at the other of two hosts; null at neither."""
    at = lambda h: F.lit(f"://{h}/")
    swap = lambda a, b: F.concat(F.substring_index(url, f"://{a}/", 1), at(b), F.substr(url, F.instr(url, f"://{a}/") + len(f"://{a}/")))
    return F.when(F.contains(url, at(one)), swap(one, other)).when(F.contains(url, at(other)), swap(other, one))


def platform(label: Column, url: Column) -> Column:
    """By the label, else by the host, else the label itself, else other."""
    key = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    host = F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")
    look = lambda table: F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(look(LABEL_PLATFORM), key), F.try_element_at(look(HOST_PLATFORM), host), F.nullif(key, F.lit("")), F.lit("other"))


def vanity_slug(url: Column) -> Column:
    """The last part of an address's path."""
    return F.nullif(F.regexp_extract(url, r"([^/]+)/*$", 1), F.lit(""))


def retry_delay(key: Column, attempt: Column, base: float = 8.0, growth: float = 2.5) -> Column:
    """Seconds before a retry: growing, with a jitter between 0.7 and 1.3 that the key and the attempt decide."""
    digest = F.sha1(F.concat(key, F.lit("-"), attempt.cast("string")))
    share = F.conv(F.substring(digest, 1, 4), 16, 10).cast("double") / 65535
    return base * F.pow(F.lit(growth), attempt) * (0.7 + 0.6 * share)


def folded(text: Column) -> Column:
    """Lower case, plain punctuation in the wider fold, single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.replace(F.translate(text, WIDE_MARKS, WIDE_PLAIN), F.lit("…"), F.lit("..."))), r"\s+", " "))


def front_matter(text: Column, key: str) -> Column:
    """The value of a key in the block between --- lines that a text begins with."""
    block = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)
    return F.nullif(F.trim(F.regexp_extract(block, rf"(?m)^{key}:[ \t]*(.*)$", 1)), F.lit(""))


def body(text: Column) -> Column:
    """A text without its front matter."""
    return F.regexp_replace(text, r"(?s)\A---\n.*?\n---(?:\n|\z)", "")
