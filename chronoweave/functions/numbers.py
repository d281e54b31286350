"""Numbers, time codes, arrays and JSON in text. IDs in brackets are those of the survey's inventory."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Value = str | float | Column


def _c(x: Value) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def clamp(x: Value, low: Value, high: Value) -> Column:
    """A value held between two bounds."""
    return F.least(F.greatest(_c(x), _c(low)), _c(high))


def tc_to_seconds(text: Value) -> Column:
    """[T1] H:M:S with ',' or '.' before the fraction, M:S or plain seconds; anything else is 0."""
    parts = F.split(F.replace(F.trim(_c(text)), F.lit(","), F.lit(".")), ":")
    n = F.size(parts)
    at = lambda k: F.get(parts, k).try_cast("double")
    out = F.when(n == 3, at(0) * 3600 + at(1) * 60 + at(2)).when(n == 2, at(0) * 60 + at(1)).when(n == 1, at(0))
    return F.coalesce(out, F.lit(0.0))


def seconds_to_tc(x: Value, millis: bool = True) -> Column:
    """[T2] HH:MM:SS,mmm, truncating; or M:SS."""
    ms = F.floor(F.greatest(_c(x), F.lit(0.0)) * 1000 + 1e-6)
    s = F.floor(ms / 1000)
    if millis:
        return F.format_string("%02d:%02d:%02d,%03d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60, ms % 1000)
    return F.format_string("%d:%02d", F.floor(s / 60), s % 60)


def age_days(mtime: Value, now: Value) -> Column:
    """[T3] Days between two times in epoch seconds."""
    return (_c(now) - _c(mtime)) / 86400.0


def length_penalty(n: Value, kind: str = "scene") -> Column:
    """[M1] 1 up to a length (scene 60, line 90), then 1 / (1 + excess / 300 or 400), 0.5 at least."""
    limit, scale = (60, 300.0) if kind == "scene" else (90, 400.0)
    return F.when(_c(n) <= limit, 1.0).otherwise(F.greatest(F.lit(0.5), 1 / (1 + (_c(n) - limit) / scale)))


def jump_cap(dur: Value, scenes: Value, mean_scene: Value, lines: Value, base: Value = 0.0) -> Column:
    """[M2] Longest jump in seconds: the base, or three mean scenes held in 25..150 and rounded to 5; at least the time that
    one line has; 45 without scenes."""
    own = F.bround(clamp(3 * _c(mean_scene), 25.0, 150.0) / 5, 0) * 5
    cap = F.when(_c(base) > 0, _c(base)).otherwise(own)
    return F.when(F.coalesce(_c(scenes), F.lit(0)) == 0, 45.0).otherwise(F.greatest(cap, _c(dur) / F.greatest(_c(lines), F.lit(1))))


def target_chars(seconds: Value, per_second: float = 5.2) -> Column:
    """[M3] How many characters fit a time."""
    return F.greatest(F.lit(1), F.floor(_c(seconds) * per_second))


def fit_speed(voice: Value, span: Value, most: float = 1.35) -> Column:
    """[M3] (speed, trim): how much faster a voice has to be, and whether it still does not fit."""
    need = F.when(_c(span) > 0, _c(voice) / _c(span)).otherwise(F.lit(most + 1))
    return F.struct(F.least(F.greatest(need, F.lit(1.0)), F.lit(most)).alias("speed"), (need > most).alias("trim"))


def display_factor(seg: Value, voice: Value, tail: Value) -> Column:
    """[M3] By how much a picture is stretched to its voice and tail, held to 15 % either way."""
    return F.when(_c(seg) > 0, clamp((_c(voice) + _c(tail)) / _c(seg), 0.85, 1.15)).otherwise(1.0)


def segment_score(aligned: Value, event: Value, characters: Value, summary: Value, has_event: Value, duration: Value, dialogue_chars: Value, best: tuple[float, float] = (3.0, 12.0)) -> Column:
    """[M4] 50 if aligned, weighted overlaps with event, characters and summary, 10 for an event, 5 for a good length or minus
    5, a tenth for each character of dialogue."""
    length = F.when(_c(duration).between(*best), 5.0).otherwise(-5.0)
    return F.when(_c(aligned), 50.0).otherwise(0.0) + 0.8 * _c(event) + 0.3 * _c(characters) + 0.2 * _c(summary) + F.when(_c(has_event), 10.0).otherwise(0.0) + length + 0.1 * _c(dialogue_chars)


def crop_focus(x: Value) -> Column:
    """[M5] A focus held in 0..1; half where it is missing."""
    return clamp(F.coalesce(F.nanvl(_c(x), F.lit(0.5)), F.lit(0.5)), 0.0, 1.0)


def adaptive_fps(dur: Value, frames: int = 6000, low: float = 2.0, high: float = 8.0) -> Column:
    """[M5] Frames a second so that a recording has about ``frames``."""
    return clamp(frames / F.greatest(_c(dur), F.lit(1.0)), low, high)


def distribute(items: Value, n: int) -> Column:
    """[R1] n slots from m items in order: slot i gets items round(i*m/n) to round((i+1)*m/n), joined."""
    m = F.size(_c(items))
    bound = lambda i: F.bround(i * m / n, 0).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array_join(F.slice(_c(items), bound(i) + 1, bound(i + 1) - bound(i)), ""))


def map_lines_to_segs(lines: Value, n: Value) -> Column:
    """[R1] A text for each of n segments: lines spread evenly; with fewer lines than segments the longest are cut into sentences,
    then clauses, then equal parts, until there are enough."""
    have = lambda x: F.size(x) >= _c(n)
    fine = F.filter(F.flatten(F.transform(_c(lines), lambda t: F.regexp_extract_all(t, F.lit("([^。！？!?；;]+[。！？!?；;]*)"), F.lit(1)))), lambda t: F.trim(t) != "")
    finer = F.filter(F.flatten(F.transform(_c(lines), lambda t: F.regexp_extract_all(t, F.lit("([^，,、。！？!?；;]+[，,、。！？!?；;]*)"), F.lit(1)))), lambda t: F.trim(t) != "")
    whole = F.array_join(_c(lines), "")
    size = F.greatest(F.lit(1), F.ceil(F.length(whole) / _c(n)).cast("int"))
    equal = F.transform(F.sequence(F.lit(0), _c(n) - 1), lambda k: F.substring(whole, k * size + 1, size))
    parts = F.when(have(_c(lines)), _c(lines)).when(have(fine), fine).when(have(finer), finer).otherwise(equal)

    def spread(p: Column) -> Column:
        bound = lambda i: F.bround(i * F.size(p) / _c(n), 0).cast("int")
        return F.transform(F.sequence(F.lit(0), _c(n) - 1), lambda i: F.array_join(F.slice(p, bound(i) + 1, bound(i + 1) - bound(i)), ""))

    return F.get(F.transform(F.array(parts), spread), 0)


def reasons(ranks: dict[str, Value], keywords: Value | None = None, floor: float = 0.70) -> Column:
    """[R2] Up to three notes: every signal whose rank is high, keywords said, or a default. Names in order of the dict."""
    notes = [F.when(_c(r) >= floor, F.format_string(f"{name} peak (top %d%%)", F.greatest(F.lit(1), F.floor((1 - _c(r)) * 100 + 1e-9)).cast("int"))) for name, r in ranks.items()]
    if keywords is not None:
        notes.append(F.when(_c(keywords) > 0, "keywords said"))
    found = F.slice(F.array_compact(F.array(*notes)), 1, 3)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("overall peak")))


def dot(a: Value, b: Value) -> Column:
    """[R4] Inner product of two vectors."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(v: Value) -> Column:
    """[R4] A vector over its length; the zero vector stays."""
    n = F.sqrt(dot(v, v))
    return F.transform(_c(v), lambda x: x / F.when(n == 0, 1.0).otherwise(n))


def extract_json(text: Value, schema: str) -> Column:
    """[J1] The first balanced object in noisy text, read by a schema; null where there is none or it is broken."""
    flat = F.regexp_extract(_c(text), r"(?s)(\{[^{}]*\})", 1)
    nested = F.when(_c(text).rlike(r"(?s)\{[^}]*\{"), balanced_json(_c(text)))
    return F.from_json(F.coalesce(nested, F.when(flat != "", flat)), schema)


@F.pandas_udf(T.StringType())
def balanced_json(texts: pd.Series) -> pd.Series:
    """[J1] Nested braces, strings respected."""

    def one(s: str | None) -> str | None:
        depth, start, quoted, escaped = 0, -1, False, False
        for i, ch in enumerate(s or ""):
            if quoted:
                quoted, escaped = not (ch == '"' and not escaped), ch == "\\" and not escaped
            elif ch == '"' and depth:
                quoted = True
            elif ch == "{":
                start, depth = (i if not depth else start), depth + 1
            elif ch == "}" and depth:
                depth -= 1
                if not depth:
                    return s[start : i + 1]
        return None

    return texts.map(one)


def index_or_positional(rows: Value, n: Value) -> Column:
    """[J2] Rows with a field i: kept by it where all are in 0..n-1 and distinct, else by position if there are n of them, else
    empty. -> array of (i, row)."""
    r = _c(rows)
    ids = F.transform(r, lambda x: x["i"].cast("int"))
    complete = (F.size(F.array_distinct(ids)) == F.size(r)) & F.forall(ids, lambda i: F.coalesce((i >= 0) & (i < _c(n)), F.lit(False)))
    by_id = F.transform(r, lambda x: F.struct(x["i"].cast("int").alias("i"), x.alias("row")))
    by_place = F.transform(r, lambda x, k: F.struct(k.cast("int").alias("i"), x.alias("row")))
    return F.when(complete, by_id).when(F.size(r) == _c(n), by_place).otherwise(F.filter(by_id, lambda x: F.lit(False)))


STORY = "idx string, scene string, i string, story string, summary string, plot string, who string, characters string, act string, stage string, keywords string, keyword string, event_chain string, chain string"


def parse_story(line: Value, acts: list[str] = ("setup", "conflict", "climax", "resolution")) -> Column:
    """[J3] One JSON line under alternative names -> (scene_idx, story, who, act, keywords, event_chain)."""
    j = F.from_json(_c(line), STORY)
    pick = lambda *names: F.coalesce(*[F.nullif(F.trim(j[x]), F.lit("")) for x in names])
    words = F.regexp_replace(pick("keywords", "keyword"), r'[\[\]"]', "")
    return F.struct(
        pick("idx", "scene", "i").try_cast("int").alias("scene_idx"),
        F.left(pick("story", "summary", "plot"), F.lit(60)).alias("story"),
        F.left(pick("who", "characters"), F.lit(50)).alias("who"),
        F.when(pick("act", "stage").isin(list(acts)), pick("act", "stage")).alias("act"),
        F.slice(F.filter(F.transform(F.split(words, "[,，、;；]"), lambda w: F.trim(w)), lambda w: w != ""), 1, 5).alias("keywords"),
        pick("event_chain", "chain").alias("event_chain"),
    )


def parse_alignment(text: Value, scenes: Value) -> Column:
    """[J3] {"line": [scenes]} as text -> map of line to its valid scene numbers."""
    m = F.from_json(_c(text), "map<string,array<string>>")
    entries = F.transform(F.map_entries(m), lambda e: F.struct(e["key"].try_cast("int").alias("k"), F.filter(F.transform(e["value"], lambda v: v.try_cast("int")), lambda v: (v >= 0) & (v < _c(scenes))).alias("v")))
    return F.map_from_entries(F.filter(entries, lambda e: e["k"].isNotNull() & (F.size(e["v"]) > 0)))
