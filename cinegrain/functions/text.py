"""Scalar functions on texts, numbers and times, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of file names that say nothing about the content.
NOISE = "1080p 2160p 1440p 720p 540p 480p 360p 4k 5k 6k 8k uhd fhd hd sd hdr x264 x265 h264 h265 hevc avc av1 xvid mp4 mkv avi mov wmv webm m4v aac ac3 mp3 web dl webrip rip dvd bluray remux proper repack fps 30fps 60fps vr 180 360 sbs full video clip final the a an".split()


def noise_free(text: Column, noise: list[str] | None = None) -> Column:
    """The words of a name in order, each once: lower case, cut at dots, underscores, dashes and spaces, without other signs and noise words."""
    parts = F.transform(F.split(F.lower(text), r"[._\-\s]+"), lambda t: F.regexp_replace(t, r"[^\p{L}\p{N}]", ""))
    return F.array_distinct(F.filter(parts, lambda t: (t != "") & ~t.isin(noise or NOISE)))


def clock(seconds: Column) -> Column:
    """M:SS, from an hour on H:MM:SS; null stays null."""
    s = F.floor(seconds).cast("bigint")
    h, m = F.expr("0L") + F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", h, m, s % 60)).when(s.isNotNull(), F.format_string("%d:%02d", m, s % 60))


def seconds_of(text: Column) -> Column:
    """The seconds of the first MM:SS or HH:MM:SS in a text; null without one."""
    part = lambda i: F.try_to_number(F.nullif(F.regexp_extract(text, r"(?<!\d)(?:(\d{1,2}):)?(\d{1,2}):(\d{2})(?!\d)", i), F.lit("")), F.lit("99"))
    return (F.coalesce(part(1), F.lit(0)) * 3600 + part(2) * 60 + part(3)).cast("bigint")


def stem_ids(stem: Column) -> tuple[Column, Column]:
    """(item, frame) of a name such as s12_f0034; nulls if it is none."""
    part = lambda i: F.nullif(F.regexp_extract(stem, r"s(\d+)_f(\d+)", i), F.lit("")).cast("bigint")
    return part(1), part(2)


def links(html: Column) -> Column:
    """The addresses of the links of a page in order, each once, entities of & resolved."""
    return F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(r"""(?i)<a\b[^>]*?href\s*=\s*["']([^"']+)["']"""), 1), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&"))))


def shortened(items: Column, most: int = 5, total: Column | None = None) -> Column:
    """An array as text, cut to `most` with the number of the rest; total: how many there are, if the array has only the first."""
    rest = (F.size(items) if total is None else total) - most
    return F.concat(F.array_join(F.slice(items, 1, most), ", "), F.when(rest > 0, F.concat(F.lit(" ... and "), rest.cast("string"), F.lit(" more"))).otherwise(""))


def cut(text: Column, most: int = 200) -> Column:
    """A text cut to `most` characters with an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def xml_block(text: Column, tag: str) -> Column:
    """What stands between the first <tag> and </tag>; null without."""
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?s)<{tag}>(.*?)</{tag}>", 1)), F.lit(""))


def json_array(text: Column) -> Column:
    """The first [...] of a text as an array of strings; null if it is none."""
    return F.from_json(F.regexp_extract(text, r"(?s)(\[.*?\])", 1), "array<string>")


def escaped(text: Column) -> Column:
    """& < > as entities."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def week_text(ts: Column) -> Column:
    """Year and week, Monday first, days before the first Monday in week 00."""
    return F.format_string("%d-W%02d", F.year(ts), F.floor((F.dayofyear(ts) + 6 - F.weekday(ts)) / 7).cast("int"))


def listed(names: Column) -> Column:
    """One name, two joined by "and", more by commas with a last ", and"; empty for none."""
    n = F.size(names)
    last = F.element_at(names, -1)
    return F.when(n <= 0, "").when(n == 1, last).when(n == 2, F.array_join(names, " and ")).otherwise(F.concat(F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(", and "), last))


def caption(names: Column, template: str = "a frame featuring {tags}") -> Column:
    """The template with the listed names; empty without names."""
    return F.when(F.size(names) > 0, F.replace(F.lit(template), F.lit("{tags}"), listed(names))).otherwise("")


def negative_caption(names: Column) -> Column:
    return F.when(F.size(names) > 0, F.concat(F.lit("not featuring "), F.array_join(names, ", not featuring "))).otherwise("")
