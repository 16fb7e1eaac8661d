"""Scalar expressions for cue texts, clocks, labels and tokens. Unicode white space is meant throughout."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File name endings of media, token marks, the pattern of pre-tokens, and the formats' endings.
MEDIA = ("wav", "mp3", "flac", "m4a", "aac", "ogg", "oga", "opus", "wma", "mka", "mp4", "mkv", "mov", "webm", "avi", "m4v", "mpg", "mpeg", "ts")
SPECIAL = ("<unk>", "<pad>", "<blk>", "<blank>", "<s>", "</s>")
PRETOKENS = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
EXTENSIONS = {"md": "md", "json": "json", "txt": "txt", "srt": "srt", "vtt": "vtt"}


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_cue(c: Column) -> Column:
    """All runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def _ms(seconds: Column) -> Column:
    s = seconds.cast("double")
    ok = s.isNotNull() & ~F.isnan(s) & (F.abs(s) != float("inf"))
    return F.when(ok, F.greatest(s, F.lit(0.0))).otherwise(F.lit(0.0))


def clock(seconds: Column, mark: str = ",") -> Column:
    """HH:MM:SS and, behind the mark, milliseconds; what isn't a number, or is negative, is 0."""
    ms = F.round(_ms(seconds) * 1000).cast("long")
    return clock_ms(ms, mark)


def clock_ms(ms: Column, mark: str = ",") -> Column:
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def spoken(seconds: Column) -> Column:
    """1h02m03s, or 2m03s below an hour."""
    s = F.round(_ms(seconds)).cast("long")
    h, m = F.floor(s / 3600), F.floor(s / 60) % 60
    return F.when(h > 0, F.format_string("%dh%02dm%02ds", h, m, s % 60)).otherwise(F.format_string("%dm%02ds", m, s % 60))


def speaker_label(speaker: Column) -> Column:
    return F.when(speaker.isNotNull(), F.concat(F.lit("Hablante "), (speaker + 1).cast("string")))


def real_time_factor(total_s: Column, audio_s: Column) -> Column:
    return F.when(audio_s > 0, total_s / F.when(audio_s > 0, audio_s)).otherwise(F.lit(0.0))


def duration_s(samples: Column, rate: Column) -> Column:
    return F.when(rate == 0, F.lit(0.0)).otherwise(F.size(samples) / F.when(rate != 0, rate))


def point_distance(t: Column, start: Column, end: Column) -> Column:
    return F.greatest(start - t, t - end, F.lit(0))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def is_media(path: Column) -> Column:
    return extension(path).isin(*MEDIA)


def is_special(token: Column) -> Column:
    return token.isin(*SPECIAL) | token.startswith("<|")


def slug(label: Column) -> Column:
    return F.lower(F.regexp_replace(label, "[^A-Za-z0-9]", ""))


def vendor(brand: Column) -> Column:
    """The maker that a processor's name tells, the first of these that fits. Fixed values."""
    has = lambda *names: reduce(or_, [F.lower(brand).contains(n) for n in names])
    return (
        F.when(has("qualcomm", "snapdragon", "oryon"), "Qualcomm").when(has("intel"), "Intel")
        .when(has("amd", "ryzen"), "Amd").when(has("apple"), "Apple").otherwise("Unknown")
    )


def output_path(path: Column, fmt: str, folder: str | None = None) -> Column:
    """Where a file's result goes: its own folder (or the given one), its stem, the format's ending."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    bare = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    stem = F.when(bare == "", F.lit("salida")).otherwise(bare)
    parent = F.lit(folder.rstrip("/") + "/") if folder else F.regexp_extract(path, r"^(.*/)?", 0)
    return F.concat(parent, stem, F.lit("." + EXTENSIONS[fmt]))


def prompt(init: Column, previous: Column) -> Column:
    """Both texts, unless blank, with a space between."""
    some = lambda c: F.when(strip(c) != "", strip(c))
    return F.concat_ws(" ", some(init), some(previous))


def tail(items: Column, n: int) -> Column:
    return F.when(F.size(items) > n, F.slice(items, -n, n)).otherwise(items)


def argmax(x: Column) -> Column:
    """The place (from 0) of the first greatest finite number; null if there is none."""
    finite = F.filter(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    best = F.array_max(finite)
    return F.when(F.size(finite) > 0, F.array_position(x, best) - 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine_of(product: Column, na: Column, nb: Column) -> Column:
    """The cosine distance of two vectors from their dot product and norms; 1 if either norm is below 1e-8."""
    low = (na < 1e-8) | (nb < 1e-8)
    return F.when(low, F.lit(1.0)).otherwise(1 - product / F.when(low, F.lit(1.0)).otherwise(na * nb))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - a.b / (|a| |b|); 1 if either norm is below 1e-8."""
    return cosine_of(dot(a, b), F.sqrt(dot(a, a)), F.sqrt(dot(b, b)))


def hz_to_mel(f: Column) -> Column:
    return F.when(f >= 1000, 15 + F.log(F.greatest(f, F.lit(1.0)) / 1000) / (F.log(F.lit(6.4)) / 27)).otherwise(f * 3 / 200)


def mel_to_hz(m: Column) -> Column:
    return F.when(m >= 15, 1000 * F.exp((m - 15) * (F.log(F.lit(6.4)) / 27))).otherwise(m * 200 / 3)
