"""BPE encoding and decoding with the tokenizers library, by tree concatenation.

A text is cut into halves down to leaves; leaves are encoded on their own (those of very long texts on many tasks), and at
each join growing windows of the text are encoded anew until the window agrees exactly with a whole unit of either side.
Units are words between spaces, or single tokens inside a long stretch without a space.  A unit that both encodings share
makes the splice exact: every pair of neighbouring tokens then stands in one true encoding.  Words of tokenizers that never
carry state over a space are encoded once and kept in a bounded table of the worker.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HELD, buffers, spans

LEAF, SPREAD, FIRST_WINDOW, LONG_WORD, KNOWN, SPELT = 65536, 65536, 64, 128, 1_200_000, 300_000
#: Byte values to the letters by which byte-level vocabularies write them: printable ones stand for themselves, the rest follow
#: from code point 256 on.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
LETTERS = {b: chr(b) if b in PRINTED else chr(256 + k) for k, b in enumerate(sorted(range(256), key=lambda b: (b in PRINTED, b)))}
#: Pairs of white space, and white space that is rare: texts without them are cut by plain replacement.
PAIRS, RARE = ("  ", " \n", "\n ", "\n\n"), "\0\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
TAIL = ".,!?%*#$&|;:-\"()"
_loaded: dict[str, Words] = {}
HELD["bpe"] = _loaded.clear


def words_of(path: str) -> Words:
    """The worker's encoder for a vocabulary file."""
    if path not in _loaded:
        _loaded[path] = Words(path)
    return _loaded[path]


class Words:
    """Ids of texts, word by word where the tokenizer allows it.

    ``style`` is 'dropped' where white space only separates (it is never part of a token), 'leading' where one space joins the
    word after it, else 'whole': then only the library cuts texts."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens") or []
        plain = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or re.search(r"\s", t["content"]) for t in added)
        pre = json.dumps(spec.get("pre_tokenizer") or {})
        if plain and (spec.get("model") or {}).get("end_of_word_suffix") and '"invert": true' in pre and '"Removed"' in pre:
            self.style = "dropped"
        elif plain and not spec.get("normalizer") and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not spec["pre_tokenizer"]["add_prefix_space"] and spec["pre_tokenizer"].get("use_regex", True):
            self.style = "leading"
        else:
            self.style = "whole"
        self.joins_tokens = spec.get("decoder") is None
        self.names = [self.tok.id_to_token(i) for i in range(self.tok.get_vocab_size(with_added_tokens=True))]
        self.ids: dict[str, bytes] = {"": b""}
        self.texts: dict[str, str] = {}
        self.model = self.tok.model
        self.model._resize_cache(0)  # words are kept here; a second table only costs time
        #: Added tokens, the longest first: they end the stretch before them as the end of a text does.
        contents = sorted((t["content"] for t in added), key=len, reverse=True)
        self.has_added, self.added, self.begin = bool(added), re.compile("(" + "|".join(map(re.escape, contents)) + ")").split, os.path.commonprefix(contents)
        self.cut = re.compile(r" ?[^ \n]+|[ \n]").findall
        self.run = re.compile(r"\s\s(?:\s|\Z)").search

    def split(self, text: str) -> list[str]:
        if self.style == "dropped":
            return [w for w in text.replace("\n", " ").split(" ") if w]
        if self.style == "leading":
            if self.has_added and self.begin in text:
                return [w for k, part in enumerate(self.added(text)) for w in ([part] if k % 2 else self.stretch(part))]
            return self.stretch(text)
        return [text] if text else []

    def stretch(self, text: str) -> list[str]:
        """The words of a text without added tokens, where one space joins the word after it."""
        if not (any(x in text for x in PAIRS) or any(x in text for x in RARE)):
            return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        if not self.run(text):
            return self.cut(text)
        return [text] if text else []

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of the words, as a table that holds all of them; new words are kept while there is room."""
        new = words.difference(self.ids)
        if not new:
            return self.ids
        table = self.ids
        if len(table) > KNOWN:  # a table of these words alone, as plain as the kept one
            table = {w: self.ids[w] for w in words.difference(new)}
        rest = []
        for w in new:
            if len(w) > max(LEAF, LONG_WORD):  # long unsplit text
                table[w] = Tree(self).encode(w).bytes()
                continue
            head, tail = self.plain(w)
            if head is None:
                rest.append(w)
            elif tail:
                table[w] = self.word(head, table) + self.word(tail, table)
            else:
                self.word(head, table)
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            for w, e in zip(part, self.tok.encode_batch_fast(part, add_special_tokens=False), strict=True):
                table[w] = np.array(e.ids, "<u4").tobytes()
        return table

    def plain(self, w: str) -> tuple[str | None, str]:
        """A word of Latin letters and the marks after it, each a stretch that the tokenizer never joins with the other; else None."""
        body = w[1:] if w[0] == " " else w
        core = body.rstrip(TAIL)
        if not core.isalpha() or (not core.isascii() and (max(core) >= "\u0180" or len(core.lower()) != len(core))) or self.style == "whole" or (self.style == "dropped" and w[0] == " "):
            return None, ""
        return w[: len(w) - len(body) + len(core)], body[len(core) :]

    def word(self, w: str, table: dict[str, bytes]) -> bytes:
        """Ids of one stretch, straight from the model."""
        if w not in table and w in self.ids:
            return self.ids[w]
        if w not in table:
            own = w.lower() if self.style == "dropped" else w
            if own.isascii():  # printable, but for a space in front
                own = LETTERS[32] + own[1:] if own[0] == " " else own
            else:
                own = own.encode().decode("latin-1").translate(LETTERS)
            found = self.model.tokenize(own)
            table[w] = pack(f"<{len(found)}I", *[t.id for t in found])
        return table[w]

    def spell(self, w: str, ids: bytes) -> str:
        """The decoded text of one word."""
        if w not in self.texts:
            text = " ".join([self.names[i] for i in np.frombuffer(ids, "<u4").tolist()])
            if len(self.texts) > SPELT:
                return text
            self.texts[w] = text
        return self.texts[w]

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """Ids (little-endian unsigned 32-bit) and decoded text of each text."""
        cuts = [self.split(t) for t in texts]
        known = self.learn(set().union(*cuts))
        ids, out = [], []
        for c in cuts:
            own = [known[w] for w in c]
            ids.append(b"".join(own))
            out.append(" ".join([self.spell(w, i) for w, i in zip(c, own, strict=True) if i]) if self.joins_tokens else self.decode(ids[-1]))
        return ids, out

    def ids_only(self, texts: list[str]) -> list[bytes]:
        """As encode(), without decoding."""
        cuts = [self.split(t) for t in texts]
        known = self.learn(set().union(*cuts))
        return [b"".join(map(known.__getitem__, c)) for c in cuts]

    def decode(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, "<u4").tolist()
        return " ".join([self.names[i] for i in numbers]) if self.joins_tokens else self.tok.decode(numbers, skip_special_tokens=False)

    def units(self, text: str, at: int = 0) -> list[tuple[int, int, bytes]]:
        """(start, end, ids) of the units of a text that starts at ``at``; one call of the library for each long word."""
        words = [(m.start(), m.group()) for m in re.finditer(r"[^ \n]+", text)] if self.style == "dropped" else None
        if words is None:
            words, pos = [], 0
            for w in self.split(text):
                words.append((pos, w))
                pos += len(w)
        known = self.learn({w for _, w in words if len(w) <= LONG_WORD})
        out = []
        for start, w in words:
            if len(w) <= LONG_WORD:
                if w:
                    out.append((at + start, at + start + len(w), known[w]))
                continue
            e = self.tok.encode(w, add_special_tokens=False)
            for i, (a, b) in zip(e.ids, e.offsets, strict=True):
                if out and out[-1][1] > at + start + a and out[-1][0] >= at + start:  # tokens that share a character are one unit
                    s, t, own = out.pop()
                    out.append((s, max(t, at + start + b), own + i.to_bytes(4, "little")))
                else:
                    out.append((at + start + a, at + start + b, i.to_bytes(4, "little")))
        return out


class Tree:
    """Units of a stretch of one text; joined with its right neighbour into the units of both."""

    def __init__(self, words: Words, start: int = 0, text: str = "", units: list[tuple[int, int, bytes]] | None = None) -> None:
        self.words, self.start, self.text, self.units = words, start, text, units or []

    def bytes(self) -> bytes:
        return b"".join([u[2] for u in self.units])

    def encode(self, text: str, start: int = 0) -> Tree:
        if len(text) <= LEAF:
            return Tree(self.words, start, text, self.words.units(text, start))
        half = len(text) // 2
        return self.encode(text[:half], start).join(self.encode(text[half:], start + half))

    def join(self, right: Tree) -> Tree:
        """Both stretches as one, exactly as if encoded whole."""
        text, lo, mid = self.text + right.text, self.start, right.start
        hi, width = mid + len(right.text), FIRST_WINDOW
        while True:
            a, b = max(lo, mid - width), min(hi, mid + width)
            window = self.words.units(text[a - lo : b - lo], a)
            have = {u: k for k, u in enumerate(window)}
            i = next((k for k in range(len(self.units) - 1, -1, -1) if self.units[k] in have or self.units[k][0] < a), -1)
            left_ok = i >= 0 and self.units[i] in have
            j = next((k for k, u in enumerate(right.units) if u in have or u[1] > b), len(right.units))
            right_ok = j < len(right.units) and right.units[j] in have
            if (left_ok or a == lo) and (right_ok or b == hi):
                head = self.units[:i] if left_ok else []
                p = have[self.units[i]] if left_ok else 0
                q = have[right.units[j]] if right_ok else len(window)
                if p <= q:
                    return Tree(self.words, lo, text, head + window[p:q] + (right.units[j:] if right_ok else []))
            if a == lo and b == hi:
                return Tree(self.words, lo, text, window)
            width *= 2


def join_all(parts: list[Tree]) -> Tree:
    """Neighbours two by two, level by level."""
    while len(parts) > 1:
        parts = [parts[k].join(parts[k + 1]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0]


def encode_docs(docs: DataFrame, tokenizer: str, spread: int = SPREAD) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, ids binary of little-endian unsigned 32-bit, decoded string), a row for each row.

    Null and empty texts have no ids. Texts over ``spread`` characters are cut to leaves that many tasks encode; the leaves
    of one text then meet in one group, as large as that text. Repeated rows are encoded each; null doc_ids stay null."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(tokenizer)
        for batch in batches:
            _, offsets = buffers(batch.column(1).cast(pa.binary()))
            for s, e in spans(offsets):
                part = batch.slice(s, e - s)
                ids, texts = words.encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(tokenizer)
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                u = Tree(words).encode(one.column(4)[0].as_py(), one.column(3)[0].as_py()).units
                cols = [pa.array([[x[k] for x in u]], t) for k, t in ((0, pa.list_(pa.int64())), (1, pa.list_(pa.int64())), (2, pa.list_(pa.binary())))]
                yield pa.RecordBatch.from_arrays([*one.columns, *cols], ["doc_id", "row", "leaf", "start", "text", "starts", "ends", "ids"])

    def joined(group: pa.Table) -> pa.Table:
        words = words_of(tokenizer)
        group = group.sort_by("leaf")
        parts = [Tree(words, r["start"], r["text"], list(zip(r["starts"], r["ends"], r["ids"], strict=True))) for r in group.to_pylist()]
        ids = join_all(parts).bytes()
        return pa.table([pa.array([group["doc_id"][0].as_py()], pa.int64()), pa.array([ids], pa.binary()), pa.array([words.decode(ids)], pa.string())], ["doc_id", "ids", "decoded"])

    schema = "doc_id long, ids binary, decoded string"
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    size = F.coalesce(F.length("text"), F.lit(0))
    short = docs.where(size <= spread).mapInArrow(whole, schema)
    step = spread // 2
    cuts = F.transform(F.sequence(F.lit(0), F.ceil(size / step).cast("int") - 1), lambda k: F.substring(F.col("text"), k * step + 1, F.lit(step)))
    long = docs.where(size > spread).withColumn("row", F.monotonically_increasing_id())  # before the leaves: one number a text
    long = long.select("doc_id", "row", F.posexplode(cuts).alias("leaf", "part"))
    long = long.select("doc_id", "row", "leaf", (F.col("leaf").cast("long") * step).alias("start"), F.col("part").alias("text")).repartition("row", "leaf")
    long = long.mapInArrow(leaves, "doc_id long, row long, leaf int, start long, text string, starts array<long>, ends array<long>, ids array<binary>")
    return short.unionByName(long.groupBy("row").applyInArrow(joined, schema))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encode_docs(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
