"""Text functions on columns. IDs in brackets are those of the survey's inventory."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lexicon as lx

CJK = "\\u4e00-\\u9fff"
Text = str | Column


def _c(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def _no_tags(x: Column) -> Column:
    return F.regexp_replace(x, r"\{[^}]*\}", "")


def line_weight(text: Text) -> Column:
    """[H1] 0 for at most one letter, 0.12 for one unit said over and over (a letter twice, a longer unit three times), else 1."""
    core = F.regexp_replace(F.coalesce(_c(text), F.lit("")), f"[^{CJK}\\p{{L}}\\p{{N}}]", "")
    return F.when(F.length(core) <= 1, 0.0).when(core.rlike(r"^(.)\1+$") | core.rlike(r"^(.{2,}?)\1{2,}$"), 0.12).otherwise(1.0)


def collapse_runs(text: Text) -> Column:
    """[H2] Without control characters; a word said four times or more in a row stands once, a CJK letter twice, a CJK phrase of
    2 to 6 letters said three times or more once (shortest period first), with the half phrase that ends it."""
    word = "(?i)(?U)" + lx.WORD_AGAIN
    s = F.regexp_replace(_c(text), lx.CONTROL, "")
    for _ in range(2):
        s = F.regexp_replace(s, word + "+", "$1")  # possessive: long runs need no deep stack
    s = F.coalesce(collapse_words(F.when(s.rlike(word), s)), s)  # folded words that stand together again
    s = F.regexp_replace(s, lx.LETTER_AGAIN, "$1$1")
    return F.coalesce(collapse_phrases(F.when(s.rlike("([\\u4e00-\\u9fa5]).{1,40}\\1"), s)), s)


@F.pandas_udf(T.StringType())
def collapse_words(texts: pd.Series) -> pd.Series:
    """[H2] The word step until nothing changes; few texts come here."""
    import re

    said = re.compile(lx.WORD_AGAIN, re.IGNORECASE)

    def one(s: str | None) -> str | None:
        before = None
        while s is not None and before != s:
            before, s = s, said.sub(r"\1", s)
        return s

    return texts.map(one)


@F.pandas_udf(T.StringType())
def collapse_phrases(texts: pd.Series) -> pd.Series:
    """[H2] The phrase step, which has to look through punctuation."""
    import re

    mark = lx.BETWEEN + "*"

    def one(s: str | None) -> str | None:
        if s is None:
            return None
        for n in range(2, 7):
            said = mark.join(r"([\u4e00-\u9fa5])" for _ in range(n))
            again = mark + mark.join(f"\\{k + 2}" for k in range(n))
            rest = "".join(f"(?:{mark}\\{k + 2}" for k in range(n - 1)) + ")?" * (n - 1)
            s = re.sub(f"({said})(?:{again}){{2,}}(?:{rest}(?={mark}$))?", r"\1", s)
        return s

    return texts.map(one)


def norm_text(text: Text, lower: bool = False) -> Column:
    """[H3] CJK letters, letters and digits only; lower-cased for reports."""
    s = F.regexp_replace(F.coalesce(_c(text), F.lit("")), f"[^{CJK}A-Za-z0-9]", "")
    return F.lower(s) if lower else s


def strip_markup(text: Text) -> Column:
    """[H4] Without {tag:...} marks, white space squeezed."""
    return F.trim(F.regexp_replace(_no_tags(_c(text)), r"\s+", " "))


def parse_markup(text: Text) -> Column:
    """[H5] Array of (type, content, value): stretches of text and tags in order."""
    parts = F.regexp_extract_all(_c(text), F.lit(r"(\{[^}]*\}|[^{]+)"), F.lit(1))
    body = lambda p: F.regexp_replace(p, r"^\{|\}$", "")
    return F.transform(
        parts,
        lambda p: F.when(
            p.startswith("{"),
            F.struct(F.regexp_extract(body(p), "^/?([^:]*)", 1).alias("type"), F.lit("").alias("content"), F.trim(F.regexp_extract(body(p), ":(.*)$", 1)).alias("value")),
        ).otherwise(F.struct(F.lit("text").alias("type"), p.alias("content"), F.lit("").alias("value"))),
    )


def pause_pieces(text: Text) -> Column:
    """[H6] Array of (text, seconds of pause after it); blank pieces go."""
    s = F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"\{/?(?:情绪|慢|快|高音|低音|大声|小声)(?::[^}]*)?\}", "")
    said = F.split(s, r"\{停顿\s*:\s*[0-9.]+\}")
    waits = F.transform(F.regexp_extract_all(s, F.lit(r"\{停顿\s*:\s*([0-9.]+)\}"), F.lit(1)), lambda w: F.coalesce(F.try_to_number(w, F.lit("999999.999999")).cast("double"), F.lit(0.0)))
    pairs = F.transform(said, lambda t, i: F.struct(t.alias("text"), F.coalesce(F.get(waits, i), F.lit(0.0)).alias("pause")))
    return F.filter(pairs, lambda p: F.trim(p["text"]) != "")


def strip_markdown(text: Text) -> Column:
    """[H7] Bold, italic, code, headings, quotes, list marks and links reduced to their text."""
    s = _c(text)
    for pattern, to in ((r"\*\*(.+?)\*\*", "$1"), (r"\*(.+?)\*", "$1"), (r"`+([^`]*)`+", "$1"), (r"(?m)^\s{0,3}#{1,6}\s*", ""), (r"(?m)^\s*>\s?", ""), (r"(?m)^\s*(?:[-*+]|\d+[.)、])\s+", ""), (r"!?\[([^\]]*)\]\([^)]*\)", "$1")):
        s = F.regexp_replace(s, pattern, to)
    return F.trim(s)


def strip_think(text: Text) -> Column:
    """[H8] Without think blocks, closed or not."""
    s = F.regexp_replace(_c(text), r"(?is)<think>.*?</think>", "")
    return F.trim(F.regexp_replace(s, r"(?is)<think>.*$", ""))


def _pairs(text: Column) -> Column:
    """All pairs of neighbouring characters. Letters are taken apart once, so a text costs its length, not the square of it."""
    letters = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    return let(letters, lambda c: F.transform(F.when(F.size(c) > 1, F.sequence(F.lit(0), F.size(c) - 2)).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.get(c, i), F.get(c, i + 1))))


def char_bigrams(text: Text) -> Column:
    """[H9] Distinct pairs of neighbouring characters; blank pairs go."""
    return F.array_distinct(F.filter(_pairs(F.coalesce(_c(text), F.lit(""))), lambda g: F.trim(g) != ""))


def share_bigram(x: str | None, y: str | None) -> bool:
    """Whether char_bigrams of two texts have one in common."""
    x, y = x or "", y or ""
    return not (set(zip(x, x[1:], strict=False)) - {(" ", " ")}).isdisjoint(zip(y, y[1:], strict=False))


def bigrams_by_clause(text: Text) -> Column:
    """[H9] As char_bigrams, but no pair crosses punctuation or white space."""
    parts = F.filter(F.split(F.coalesce(_c(text), F.lit("")), f"[^{CJK}\\p{{L}}\\p{{N}}]+"), lambda p: F.length(p) >= 2)
    return F.array_distinct(F.flatten(F.transform(parts, _pairs)))


def _window_sums(code: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of code points times powers of ``base`` modulo the prime 2**31 - 1, and the powers in falling order."""
    powers, step = np.ones(len(code) + 1, np.uint64), 1
    while step <= len(code):  # powers by doubling
        powers[step : 2 * step] = powers[: min(step, len(powers) - step)] * np.uint64(pow(base, step, PRIME)) % np.uint64(PRIME)
        step *= 2
    sums = np.zeros(len(code) + 1, np.uint64)
    np.cumsum((code.astype(np.uint64) + np.uint64(1)) * powers[:-1] % np.uint64(PRIME), out=sums[1:])
    return sums, powers[::-1]


PRIME, BASES = 2**31 - 1, (1_223_456_789, 987_654_323)


def longest_common(x: str, y: str) -> int:
    """Length of the longest stretch that both texts have. A stretch of n letters has one of n - 1, so lengths are halved upon; all
    windows of one length are compared by hashes (two, modulo a prime), and a hit counts only if the letters are the same.
    Memory is a few numbers for each letter."""
    code = np.frombuffer((x + y).encode("utf-32-le", "surrogatepass"), np.uint32)
    tables, own = [_window_sums(code, base) for base in BASES], len(x)

    def hit(n: int) -> bool:
        keys = np.zeros(len(code) - n + 1, np.uint64)
        for sums, powers in tables:
            window = (sums[n:] - sums[:-n]) % np.uint64(PRIME) * powers[: len(keys)] % np.uint64(PRIME)
            keys = keys << np.uint64(31) | window
        left, right = np.unique(keys[: own - n + 1], return_index=True), np.unique(keys[own:], return_index=True)
        _, i, j = np.intersect1d(left[0], right[0], assume_unique=True, return_indices=True)
        return any(x[a : a + n] == y[b : b + n] for a, b in zip(left[1][i].tolist(), right[1][j].tolist(), strict=True))

    low, high = 0, min(len(x), len(y))
    while low < high:
        n = (low + high + 1) // 2
        low, high = (n, high) if hit(n) else (low, n - 1)
    return low


@F.pandas_udf(T.IntegerType())
def lcs_contiguous(a: pd.Series, b: pd.Series) -> pd.Series:
    """[H10] Length of the longest common stretch, punctuation aside."""
    import re

    plain = re.compile(r"[\W_]+")
    return pd.Series([longest_common(plain.sub("", x or ""), plain.sub("", y or "")) for x, y in zip(a, b, strict=True)], dtype="int32")


class Stretches:
    """The letters of a text, and its stretches of each length that was asked for."""

    def __init__(self, text: str | None) -> None:
        self.letters, self.of = re.sub(r"[\W_]+", "", text or ""), {}

    def long(self, n: int) -> set[str]:
        if n not in self.of:
            self.of[n] = {self.letters[i : i + n] for i in range(len(self.letters) - n + 1)}
        return self.of[n]

    def common(self, other: Stretches, most: int = 10) -> int:
        """Length of the longest common stretch, ``most`` at most."""
        low, high = 0, min(most, len(self.letters), len(other.letters))
        while low < high:
            n = (low + high + 1) // 2
            low, high = (low, n - 1) if self.long(n).isdisjoint(other.long(n)) else (n, high)
        return low


@F.pandas_udf(T.IntegerType())
def lcs_up_to_ten(a: pd.Series, b: pd.Series) -> pd.Series:
    """[H10] As lcs_contiguous, but ten at most: a common stretch of n letters has one of n - 1, so sets of stretches are halved
    upon instead of comparing all places."""
    return pd.Series([Stretches(x).common(Stretches(y)) for x, y in zip(a, b, strict=True)], dtype="int32")


def letters_of(text: str | None) -> str:
    """The letters that edit_ratio compares; the same as LETTERS leaves."""
    return re.sub(LETTERS, "", text or "")


LETTERS = "[^一-鿿A-Za-z0-9]"


@F.pandas_udf(T.DoubleType())
def edit_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """[H11] Ratcliff-Obershelp ratio of the normalised texts; 0 when either has fewer than two letters."""
    import difflib

    def one(x: str | None, y: str | None) -> float:
        x, y = letters_of(x), letters_of(y)
        return difflib.SequenceMatcher(None, x, y).ratio() if len(x) > 1 and len(y) > 1 else 0.0

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def action_tokens(text: Text, actions: dict[str, list[str]] = lx.ACTIONS) -> Column:
    """[H12] Distinct ACT:<class> of the action words in a text; a word of two classes counts for the last."""
    of = {w: c for c, words in actions.items() for w in words}
    words = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(f"ACT:{c}").alias("c")) for w, c in of.items()])
    s = F.coalesce(_c(text), F.lit(""))
    return F.array_sort(F.array_distinct(F.transform(F.filter(words, lambda x: F.contains(s, x["w"])), lambda x: x["c"])))


def sentence_kind(text: Text) -> Column:
    """[H13] blank, quote, hook, transition or concrete, tried in this order; a transition with an action is concrete."""
    s = F.trim(F.coalesce(_c(text), F.lit("")))
    core = F.regexp_replace(s, r"[^\p{L}\p{N}_]", "")
    blank = (core == "") | core.rlike(f"^[{lx.BLANKS}]{{1,2}}$")
    return (
        F.when(blank, "blank")
        .when(s.rlike(lx.QUOTE_MARK) | s.rlike(lx.QUOTE_VERB), "quote")
        .when(s.rlike(lx.HOOK), "hook")
        .when(s.rlike(lx.TRANSITION) & (F.size(action_tokens(s)) == 0), "transition")
        .otherwise("concrete")
    )


def _count(s: Column, word: str) -> Column:
    """How often a word stands in a text, by bytes, which need no count of letters; most texts lack it and are not replaced in."""
    return F.when(F.contains(s, F.lit(word)), (F.octet_length(s) - F.octet_length(F.replace(s, F.lit(word)))) / len(word.encode())).otherwise(F.lit(0.0))


def _wide(s: Column, emotions: dict[str, list[str]], found: Column) -> Column:
    """``found``, but for texts of single bytes no look is needed if every word has a wider letter."""
    if any(w.isascii() for words in emotions.values() for w in words):
        return found
    return F.when(F.octet_length(s) == F.length(s), lx.NEUTRAL).otherwise(found)


def _strongest(hits: dict[str, Column]) -> Column:
    names = F.array(*[F.lit(n) for n in hits])
    most = lambda a: F.array_max(a)
    return let(F.array(*[h.cast("double") for h in hits.values()]), lambda a: F.when(most(a) < 2, lx.NEUTRAL).otherwise(F.element_at(names, F.array_position(a, most(a)).cast("int"))))


def emotion_of(text: Text, emotions: dict[str, list[str]] = lx.EMOTIONS) -> Column:
    """[H14] The class with most hits over a whole text, two at least; earlier classes win ties."""
    s = F.coalesce(_c(text), F.lit(""))
    return _wide(s, emotions, _strongest({n: sum((_count(s, w) for w in words), F.lit(0.0)) for n, words in emotions.items()}))


def clause_emotion(text: Text, emotions: dict[str, list[str]] = lx.EMOTIONS) -> Column:
    """[H14] The class with most distinct words in a clause, two at least."""
    s = F.coalesce(_c(text), F.lit(""))
    return _wide(s, emotions, _strongest({n: sum((F.contains(s, F.lit(w)).cast("int") for w in words), F.lit(0)) for n, words in emotions.items()}))


_BALANCED = "“[^”]*”?|‘[^’]*’?|「[^」]*」?|『[^』]*』?|（[^）]*）?|\\([^)]*\\)?|\\{[^}]*\\}?"

#: What opens a balanced stretch. Runs and groups are possessive: they never step back, so long texts need no deep stack.
_OPENERS = "“‘「『（({"


def split_clauses(text: Text) -> Column:
    """[H17] Array of (clause, mark): cut after commas, full stops and the like, never inside braces, brackets or quotes."""
    pieces = F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(f"((?:{_BALANCED}|[^，,。；;！!？?{_OPENERS}]++)*+[，,。；;！!？?]|(?:{_BALANCED}|[^，,。；;！!？?{_OPENERS}]++)++)"), F.lit(1))
    return F.transform(pieces, lambda p: F.struct(F.regexp_replace(p, "[，,。；;！!？?]$", "").alias("clause"), F.regexp_extract(p, "([，,。；;！!？?])$", 1).alias("mark")))


def split_sentences(text: Text, quotes: bool = True) -> Column:
    """[H16] Array of sentences with their marks; with ``quotes`` marks inside paired quotes do not cut."""
    s = F.coalesce(_c(text), F.lit(""))
    inside = f"(?:{_BALANCED}|[^。！？!?；{_OPENERS}]++)" if quotes else "[^。！？!?；]"
    parts = F.regexp_extract_all(s, F.lit(f"{inside}++(?:[。！？!?；]++[”’」』]?)?+|[。！？!?；]++[”’」』]?"), F.lit(0))  # each letter is read once
    marked = reduce(lambda a, m: a | F.contains(s, F.lit(m)), "！？!?；", F.contains(s, F.lit("。")))
    return F.filter(F.transform(F.when(marked, parts).otherwise(F.array(s)), lambda p: F.trim(p)), lambda p: p != "")


def prosody_markup(text: Text) -> Column:
    """[H15] Each clause between emotion tags, a pause tag by its mark; texts under 12 characters or with tags stay."""
    s = F.trim(F.coalesce(_c(text), F.lit("")))
    marks = "".join(lx.PAUSES)
    quoted = "[“‘「『][^”’」』]*[”’」』]?"
    pieces = F.regexp_extract_all(s, F.lit(f"((?:{quoted}|[^{marks}“‘「『]++)*+[{marks}]|(?:{quoted}|[^{marks}“‘「『]++)++)"), F.lit(1))
    pauses = F.create_map(*[F.lit(x) for kv in lx.PAUSES.items() for x in kv])

    def piece(p: Column, i: Column, last: Column) -> Column:
        pause = F.try_element_at(pauses, F.right(p, F.lit(1)))
        tag = F.when((i < last) & pause.isNotNull(), F.format_string("{停顿:%.2f}", pause)).otherwise("")
        return F.concat(F.lit("{情绪:"), clause_emotion(p), F.lit("}"), p, F.lit("{/情绪}"), tag)

    return F.when((F.length(s) < 12) | s.rlike(r"\{/?(?:情绪|停顿|慢|快|高音|低音|大声|小声)"), _c(text)).otherwise(let(pieces, lambda all_: F.array_join(F.transform(all_, lambda p, i: piece(p, i, F.size(all_) - 1)), "")))


def clamp_text(text: Text, n: int) -> Column:
    """[H20] At most n characters: cut at the last full stop, else comma, else space that leaves 60 % of n, else hard."""
    s = F.trim(F.coalesce(_c(text), F.lit("")))
    head, least = F.substring(s, 1, n), n * 0.6
    cuts = [F.regexp_extract(head, f"(?s)^(.*[{m}])", 1) for m in ("。！？；!?;", "，、,", "\\s")]
    long = [F.when(F.length(c) >= least, F.rtrim(c)) for c in cuts]
    return F.when(F.length(s) <= n, s).otherwise(F.coalesce(*long, head))


def clean_caption(text: Text) -> Column:
    """[H21] One line, without meta brackets and tags, without one layer of paired quotes around it."""
    s = F.regexp_replace(_no_tags(F.coalesce(_c(text), F.lit(""))), r"[\[【][^\]】]*[\]】]|<[^>]*>", "")
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    return F.trim(F.regexp_replace(s, "^(?:“([^“”]*)”|「([^「」]*)」|\"([^\"]*)\"|‘([^‘’]*)’)$", "$1$2$3$4"))


def is_silence(text: Text) -> Column:
    """[H21] Whether a caption says that nothing is said."""
    return F.lower(F.trim(F.coalesce(_c(text), F.lit("")))).isin("", "-", "—", "…", "...", "silence", "(silence)", "[silence]", "静音", "（静音）", "留白")


# Openings of guesses, and report verbs that need an object.
GUESSES = ["仿佛", "似乎", "好像", "也许", "或许", "可能", "令人不禁", "让人不禁"]
BROKEN = "(?:提到|说道|表示|指出|声称|写着|传来|喊道|问道|回答|说出|讲到|补充|解释)$"
DANGLING = "(?:传来|写着|喊道|叫着|念着|说道|听到|听见|播报|重复着|说了一句|报出)\\s*[：:，,、]?\\s*[。！？]?$"


def tidy_tail(text: Text) -> Column:
    """[H22] A comma at the end becomes a full stop; doubled marks and commas before full stops go."""
    s = F.regexp_replace(_c(text), r"[，,；;、]((?:\{[^}]*\})*)\s*$", "。$1")
    s = F.regexp_replace(s, r"([，。！？；：])\1+", "$1")
    return F.trim(F.regexp_replace(s, r"[，、；]\s*(?=[。！？])", ""))


def _joined(parts: Column) -> Column:
    return F.trim(F.array_join(F.transform(parts, lambda p: F.concat(p["clause"], p["mark"])), ""))


def drop_speculation(text: Text, guesses: list[str] = GUESSES) -> Column:
    """[H22] Without clauses that only guess; needs three clauses, keeps two, and keeps clauses that hold the subject."""
    any_guess, starts = "|".join(guesses), "^(?:" + "|".join(guesses) + ")"
    guess = lambda c: c.rlike(any_guess) & ~c.rlike("^[他她它]") & ((F.length(c) <= 16) | c.rlike(starts))
    keep = lambda parts: F.filter(parts, lambda p: let(F.trim(_no_tags(p["clause"])), lambda c: ~guess(c)))

    def cut(s: Column) -> Column:
        both = lambda parts: let(keep(parts), lambda kept: F.when((F.size(parts) >= 3) & (F.size(kept) >= 2) & (F.size(kept) < F.size(parts)), tidy_tail(_joined(kept))).otherwise(s))
        return F.when(s.rlike(any_guess), let(split_clauses(s), both)).otherwise(s)

    return let(F.coalesce(_c(text), F.lit("")), cut)


def drop_broken(text: Text) -> Column:
    """[H22] Without clauses that end in a report verb; never empty."""
    keep = lambda parts: F.filter(parts, lambda p: ~F.trim(_no_tags(p["clause"])).rlike(BROKEN))

    def cut(s: Column) -> Column:
        both = lambda parts: let(keep(parts), lambda kept: F.when((F.size(parts) >= 2) & (F.size(kept) > 0) & (F.size(kept) < F.size(parts)), tidy_tail(_joined(kept))).otherwise(s))
        told = s.rlike(BROKEN.removesuffix("$")) | F.contains(s, F.lit("{"))  # without such a verb (which a tag may part) nothing is cut
        return F.when(told, let(split_clauses(s), both)).otherwise(s)

    return let(F.coalesce(_c(text), F.lit("")), cut)


def strip_foreign(text: Text) -> Column:
    """[H22] Chinese text without foreign stretches; clauses left dangling by that go."""

    def scrubbed(c: Column) -> Column:
        c = F.regexp_replace(c, "['\"“”‘’「」『』](?=[^'\"“”‘’「」『』]*[A-Za-z][^'\"“”‘’「」『』]*[A-Za-z][^'\"“”‘’「」『』]*[A-Za-z])[^'\"“”‘’「」『』]{1,80}['\"“”‘’「」『』]", "")
        c = F.regexp_replace(c, r"[A-Za-z][A-Za-z'\-]*[\s,.!?]+[A-Za-z][A-Za-z'\-\s,.!?]*", "")
        c = F.regexp_replace(c, f"(?<=[{CJK}])\\s*[A-Za-z][A-Za-z'\\-]{{2,}}(?=[{CJK}]|$)", "")
        return F.trim(F.regexp_replace(F.regexp_replace(c, r"\s{2,}", " "), "^[，,。；;、\\s]+", ""))

    def cut(s: Column) -> Column:
        parts = F.transform(split_clauses(s), lambda p: F.struct(scrubbed(p["clause"]).alias("clause"), p["mark"].alias("mark"), p["clause"].alias("was")))
        keep = lambda p: (p["clause"] == p["was"]) | let(F.trim(_no_tags(p["clause"])), lambda c: (F.length(c) >= 8) & ~c.rlike(DANGLING))
        chinese = s.rlike("[A-Za-z]") & (F.regexp_count(s, F.lit(f"[{CJK}]")) >= 2)
        return F.when(chinese, let(F.filter(parts, keep), lambda kept: F.when(F.size(kept) > 0, tidy_tail(_joined(kept))).otherwise(""))).otherwise(s)

    return let(F.coalesce(_c(text), F.lit("")), cut)


def scrub(text: Text) -> Column:
    """[H22, H23] The scrubbing chain; what would be empty stays as it was."""
    chain = lambda raw: let(tidy_tail(drop_broken(drop_speculation(strip_foreign(raw)))), lambda new: F.when(F.trim(_no_tags(new)) == "", raw).otherwise(new))
    return let(F.coalesce(_c(text), F.lit("")), chain)


def scrub_texts(lines: DataFrame, text: str = "text") -> DataFrame:
    """[H23] Lines with their text scrubbed in place, none dropped, and ``changed`` where that did something."""
    d = lines.withColumn("_cw_new", scrub(text))
    return d.withColumn("changed", F.col("_cw_new") != F.coalesce(F.col(text), F.lit(""))).withColumn(text, F.col("_cw_new")).drop("_cw_new")


def quotes(text: Text) -> Column:
    """[H24] Quoted spans of 2 to 80 characters after a colon or a speech verb within 14 characters."""
    verb = "[：:]|说|道|喊|叫|问|答|吼|骂|念|写"
    found = F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(f"(?:{verb})[^“「『\"]{{0,13}}[“「『\"]([^”」』\"]{{2,80}})[”」』\"]"), F.lit(1))
    return F.transform(found, lambda q: F.trim(q))


def safe_title(text: Text, n: int = 20) -> Column:
    """[H25] Without characters that file names may not have and without quotes around, n characters at most."""
    s = F.trim(F.regexp_replace(F.coalesce(_c(text), F.lit("")), r'[\\/:*?"<>|\r\n\t]', ""))
    return F.left(F.trim(F.regexp_replace(s, "^[“”「」『』《》']+|[“”「」『』《》']+$", "")), F.lit(n))


def classify_error(message: Text) -> Column:
    """[H26] The first class whose pattern a message has, else other."""
    s, out = F.coalesce(_c(message), F.lit("")), None
    for kind, pattern in lx.ERRORS:
        hit = s.rlike(f"(?i){pattern}")
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("other")


def error_message(message: Text) -> Column:
    """[H26] The first 300 characters of a message."""
    return F.when(F.coalesce(_c(message), F.lit("")) == "", "未知错误").otherwise(F.substring(_c(message), 1, 300))


def apply_mapping(text: Text, mapping: Text) -> Column:
    """[H27] A map column's keys replaced by their values, in the map's order."""
    return F.aggregate(F.map_entries(_c(mapping)), _c(text), lambda s, e: F.replace(s, e["key"], e["value"]))


def compose_scene_text(*fields: Text, separator: str = "；") -> Column:
    """[H28] Fields that are neither blank nor placeholders, joined."""
    parts = F.array(*[F.trim(F.coalesce(_c(f), F.lit(""))) for f in fields])
    return F.array_join(F.filter(parts, lambda p: ~F.lower(p).isin("", "无", "none", "n/a", "未知", "unknown", "-")), separator)


def is_placeholder(text: Text) -> Column:
    """[B8] Whether a line only echoes a template, is one bracketed word, or has fewer than two letters."""
    s = F.trim(F.coalesce(_c(text), F.lit("")))
    return (
        s.rlike(r"^第\s*\d+\s*段\s*(?:润色|改写|优化|输出|结果|内容)?\s*(?:后|之后)?\s*$")
        | ((F.length(s) <= 24) & F.contains(s, F.lit("润色后")) & ~s.rlike("[，。！？；：]"))
        | s.rlike(r"^[<【\[][^<【\[\]>】\]]{0,16}[>】\]]$")
        | (F.length(F.regexp_replace(s, r"[^\p{L}\p{N}]+", "")) < 2)
    )


def is_promotion(text: Text, extra: list[str] = ()) -> Column:
    """[B7] Whether a burnt-in caption is blank, too short, only digits, or has a promotional word."""
    s = F.trim(F.coalesce(_c(text), F.lit("")))
    core = F.regexp_replace(s, r"[^\p{L}\p{N}]", "")
    words = F.array(*[F.lit(w) for w in [*lx.PROMOTIONS, *extra] if w])
    return s.isin(lx.NO_CAPTION) | (F.length(s) < 2) | core.rlike(r"^\p{Nd}*$") | F.exists(words, lambda w: F.contains(s, w))


def cjk_count(text: Text) -> Column:
    return F.regexp_count(F.coalesce(_c(text), F.lit("")), F.lit(f"[{CJK}]"))


def decode_bytes(content: Text) -> Column:
    """[A2] Text of bytes: UTF-16 by its mark, UTF-8 with or without one, gb18030, else UTF-8 without what is wrong."""
    b = _c(content)
    head = F.hex(F.substring(b, 1, 3))
    utf16 = F.when(head.startswith("FFFE") | head.startswith("FEFF"), F.decode(b, "UTF-16"))
    utf8 = F.regexp_replace(F.try_validate_utf8(F.when(F.is_valid_utf8(b.cast("string")), b.cast("string"))), "^\\ufeff", "")
    return F.coalesce(utf16, utf8, decode_gb(b))


@F.pandas_udf(T.StringType())
def decode_gb(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """[A2] The branch that Spark's decode() lacks."""

    def one(b: bytes | None) -> str | None:
        if b is None:
            return None
        try:
            return bytes(b).decode("gb18030")
        except UnicodeDecodeError:
            return bytes(b).decode("utf-8", "ignore")

    for s in batches:
        yield s.map(one)
