"""Structured answers: views of four arrays, risk, hedges, bars, and where a post's transcript comes from, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import coerced, conviction

CITATION = "struct<date: string, quote: string>"
ENTRY = f"struct<name: string, item: string, parent_sector: string, conviction: string, horizon: string, why: string, provenance: string, age_note: string, citations: array<{CITATION}>>"
# The arrays of an answer, and what their entries are.
ARRAYS = {"sectors_excited": ("sector", "bullish"), "sectors_concerned": ("sector", "bearish"), "tokens_excited": ("token", "bullish"), "tokens_concerned": ("token", "bearish")}
HORIZONS = ("tactical", "structural")
PROVENANCES = ("stated", "inferred", "extrapolated")
RISKS = ("risk_on", "neutral", "risk_off", "no_view")
YOUTUBE = r"(?:youtube\.com/(?:embed/|watch\?v=)|youtu\.be/)([A-Za-z0-9_-]{11})"
SIMPLECAST = r"player\.simplecast\.com/([0-9a-fA-F-]{36})"


def entries(answer: Column, array: str) -> Column:
    """The entries of one array of an answer (JSON) that are objects with a name, or an item instead; others are left out."""
    kind, side = ARRAYS[array]
    # entry by entry, so that one that is no object does not spoil the others
    raw = F.coalesce(F.from_json(F.get_json_object(answer, f"$.{array}"), "array<string>"), F.array().cast("array<string>"))
    objects = F.transform(F.filter(raw, lambda x: x.startswith("{")), lambda x: F.from_json(x, ENTRY))
    filled = lambda c: F.when(c != "", c)
    named = F.filter(objects, lambda x: F.coalesce(filled(x["name"]), filled(x["item"])).isNotNull())
    quoted = lambda x: F.filter(F.coalesce(x["citations"], F.array().cast(f"array<{CITATION}>")), lambda c: (c["date"] != "") & (c["quote"] != ""))
    return F.transform(
        named,
        lambda x: F.struct(
            F.coalesce(filled(x["name"]), filled(x["item"])).alias("item"),
            F.lit(kind).alias("item_type"),
            x["parent_sector"].alias("parent_sector"),
            F.lit(side).alias("stance"),
            conviction(F.coalesce(x["conviction"], F.lit("50"))).alias("conviction"),
            F.coalesce(coerced(x["horizon"], HORIZONS, HORIZONS[0]), F.lit(HORIZONS[0])).alias("horizon"),
            F.coalesce(x["why"], F.lit("")).alias("rationale"),
            F.coalesce(coerced(x["provenance"], PROVENANCES, PROVENANCES[-1]), F.lit(PROVENANCES[-1])).alias("provenance"),
            x["age_note"].alias("age_note"),
            quoted(x).alias("citations"),
        ),
    )


def view_items(answer: Column) -> Column:
    """All items of an answer's four arrays, in their order."""
    return F.concat(*[entries(answer, a) for a in ARRAYS])


def risk(answer: Column) -> Column:
    """(stance, conviction, rationale, provenance) of an answer's risk regime; no view where there is none."""
    of = lambda name: F.get_json_object(answer, f"$.risk_regime.{name}")
    return F.struct(
        F.coalesce(coerced(of("stance"), RISKS, RISKS[-1]), F.lit(RISKS[-1])).alias("stance"),
        conviction(F.coalesce(of("conviction"), F.lit("0"))).alias("conviction"),
        F.coalesce(of("why"), F.lit("")).alias("rationale"),
        F.coalesce(coerced(of("provenance"), PROVENANCES, PROVENANCES[-1]), F.lit(PROVENANCES[-1])).alias("provenance"),
    )


def hedge_decision(answer: Column, default: str = "no_hedge") -> Column:
    """The stance of an answer's hedge; the default where it names none."""
    return F.coalesce(F.nullif(F.get_json_object(answer, "$.hedge.stance"), F.lit("")), F.lit(default))


def bars(response: Column) -> Column:
    """An array of (date, open, high, low, close, volume) of a response with numbers as strings and times in milliseconds, in order of dates; of one date the last."""
    names = ("open", "high", "low", "close", "volume")
    kind = "data array<struct<time:string," + ",".join(f"{n}:string" for n in names) + ">>"
    told = F.filter(F.from_json(response, kind)["data"], lambda x: x["time"].isNotNull())
    typed = F.transform(told, lambda x, i: F.struct(F.timestamp_millis(x["time"].cast("long")).cast("date").alias("date"), i.alias("i"), *[x[n].try_cast("double").alias(n) for n in names]))
    ordered = F.sort_array(typed)
    last = F.filter(ordered, lambda x, i: (i == F.size(ordered) - 1) | (F.get(ordered, i + 1)["date"] != x["date"]))
    return F.transform(last, lambda x: F.struct(x["date"].alias("date"), *[x[n].alias(n) for n in names]))


def years(text: Column) -> Column:
    """(start, end) of '2000 - Present 26 years' or '1973 - 1975'; no end for what goes on."""
    parts = F.split(F.trim(F.split(text, "·")[0]), r"\s*[–—-]\s*", 2)
    end = F.try_element_at(parts, F.lit(2))
    ended = F.nullif(F.trim(F.regexp_replace(end, r"\s*\d+\s+(?:years?|yrs?|months?|mos?)\b.*$", "")), F.lit(""))
    return F.struct(F.nullif(F.trim(parts[0]), F.lit("")).alias("start"), F.when(~end.rlike("(?i)present|current"), ended).alias("end"))


def tail(text: Column, n: int) -> Column:
    """The last n characters: what is kept of a memory."""
    return F.right(text, F.lit(n))


def transcript_route(formats: Column, html: Column) -> Column:
    """(format, source, media_id, note) of where a video's or podcast's transcript comes from, by its first format and the players in its page; null for other posts.

    A video player's id counts first; a podcast may have an audio player instead.
    """
    kind = F.try_element_at(formats, F.lit(1))
    found = lambda pattern: F.nullif(F.regexp_extract(F.coalesce(html, F.lit("")), pattern, 1), F.lit(""))
    video, audio = found(YOUTUBE), F.when(kind == "podcasts", found(SIMPLECAST))
    source = F.when(video.isNotNull(), "youtube").when(audio.isNotNull(), "whisper").otherwise("none")
    note = F.when(video.isNotNull() | audio.isNotNull(), "").when(kind == "videos", "video without youtube embed").otherwise("podcast without youtube or simplecast")
    return F.when(kind.isin("videos", "podcasts"), F.struct(kind.alias("format"), source.alias("source"), F.coalesce(video, audio).alias("media_id"), note.alias("note")))
