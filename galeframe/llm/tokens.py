"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.llm.common import by_bytes, column, text

#: White space other than blank, tab, line feed and carriage return, by anyone's definition.
ODD_SPACE = [chr(c) for c in (0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)]
_UNIT = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
_BOUNDARY = re.compile("(?<=[^\\s᠎​⁠﻿])(?=[ \t\n\r])")


def _odd(whole: str) -> bool:
    return any(c in whole for c in (ODD_SPACE[:6] if whole.isascii() else ODD_SPACE))


def safe_units(whole: str) -> list[str]:
    """Cut a text before each run of plain white space that follows a visible character.

    No pre-tokenizer of the public vocabularies matches across such a place,
    so the pieces' tokens, one after the other, are those of the whole.
    """
    return _BOUNDARY.split(whole) if _odd(whole) else _UNIT.findall(whole)


def visible_units(whole: str) -> list[str]:
    """The same pieces without plain white space around them, for vocabularies that drop it."""
    return [u.strip(" \t\n\r") for u in _BOUNDARY.split(whole)] if _odd(whole) else whole.split()


#: Letters that every vocabulary's pre-tokenizer keeps together, that NFC leaves alone and that have one lower-case letter: Latin up to Extended-B without the capital dotted I.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
_PLAIN = re.compile(f"[{LETTERS}]+")
#: Marks that end a unit: between a plain letter and these every pre-tokenizer cuts. Not among them: apostrophes, which begin contractions, and the characters of special tokens.
MARKS = ".,;:!?&#*%$)]}+=-_/@~^\""


class UnitEncoder:
    """Encodes units in batches balanced by bytes and remembers the short ones, ``entries`` at most.

    A unit that ends in a plain letter and closing marks is encoded as the part
    up to the letter and the marks. ``lower``: the vocabulary lower-cases and
    drops white space, so words of plain letters are looked up in lower case
    and many are encoded as one text, whose ids are cut after the tokens that
    end words; then ``of`` gives a sequence with as many elements for each id.
    """

    def __init__(self, vocabulary: str, of, entries: int, batch_bytes: int, lower: bool = False) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.of, self.entries, self.batch_bytes, self.lower = Tokenizer.from_str(vocabulary), of, entries, batch_bytes, lower
        self.known: dict = {}
        self.ends = None
        if lower:
            tokens = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(tokens.values()) + 1, bool)
            self.ends[[i for t, i in tokens.items() if t.endswith("</w>")]] = True

    def _learn(self, fresh: set[str]) -> None:
        parts, need, words = [], set(), set()
        for u in fresh:
            if self.lower and len(u) <= 48 and u == u.lower() and _PLAIN.fullmatch(u):
                words.add(u)
                continue
            body = u.rstrip(MARKS)
            if not body or not _PLAIN.fullmatch(body[-1]):
                body = u
            if self.lower and _PLAIN.fullmatch(body):
                body = body.lower()
                words.add(body)
            else:
                need.add(body)
            marks = u[len(body) :]
            parts.append((u, body, marks))
            need.add(marks)
        known = self.known
        got = self._encode(list(need.difference(known)))
        got.update(self._encode_words(list(words.difference(known))))
        for u, body, marks in parts:
            value = got[body] if body in got else known[body]
            known[u] = value + (got[marks] if marks in got else known[marks]) if marks else value
        known.update((u, g) for u, g in got.items() if len(u) <= 48)

    def _encode(self, units: list[str]) -> dict:
        out, batch, total = {}, [], 0
        for u in [*units, None]:
            if batch and (u is None or total + len(u) > self.batch_bytes):
                ids = (e.ids for e in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False))
                out.update(zip(batch, map(self.of, ids), strict=True))
                batch, total = [], 0
            if u is not None:
                batch.append(u)
                total += len(u)
        return out

    def _encode_words(self, words: list[str], each: int = 2000) -> dict:
        out = {}
        for at in range(0, len(words), each):
            some = words[at : at + each]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.int64)
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(cuts) == len(some) and cuts[-1] == len(ids):
                whole = self.of(ids)
                wide = len(whole) // len(ids)
                out.update((w, whole[wide * i : wide * j]) for w, i, j in zip(some, [0, *cuts], cuts, strict=False))
            else:
                out.update(self._encode(some))
        return out

    def __call__(self, units: list[str]) -> list:
        distinct = set(units)
        fresh = distinct.difference(self.known)
        if len(self.known) + len(fresh) > self.entries:
            self.known.clear()
            fresh = distinct
        self._learn(fresh)
        got = list(map(self.known.__getitem__, units))
        for u in fresh:
            if len(u) > 48:
                del self.known[u]
        return got


_ENCODERS: dict = {}


def encoder(key: str, vocabulary: str, of, entries: int, batch_bytes: int, lower: bool = False) -> UnitEncoder:
    """One encoder for each worker process and use, so that its memory outlives a task."""
    if key not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _ENCODERS[key] = UnitEncoder(vocabulary, of, entries, batch_bytes, lower)
    return _ENCODERS[key]


def token_counts(
    docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text",
    batch_bytes: int = 1 << 21, cache_entries: int = 1 << 20,
) -> DataFrame:
    """(id, n_bytes, n_tokens) for every row; the vocabulary file is read by the driver and broadcast (about 2 MB).

    Texts are cut at safe boundaries, so a very long one is many small pieces;
    the pieces of about ``batch_bytes`` are encoded together and only lengths
    leave the function. Null and empty texts have 0 bytes and 0 tokens, null
    ids stay null, repeated rows give repeated results, an empty table gives
    an empty result, other columns are not read.
    """
    spark = docs.sparkSession
    with open(tokenizer_json, encoding="utf-8") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(f"count {tokenizer_json}", vocabulary.value, len, cache_entries, batch_bytes)
        for batch in by_bytes(batches, "_text", batch_bytes):
            ids, size, texts = batch.columns
            units, ends = [], []
            for t in texts.to_pylist():
                units += safe_units(t)
                ends.append(len(units))
            n, start, out = encode(units), 0, []
            for end in ends:
                out.append(sum(n[start:end]))
                start = end
            yield pa.RecordBatch.from_arrays([ids, size, pa.array(out, pa.int64())], ["_id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(column(id_col).alias("_id"), F.octet_length(text(text_col)).cast("long").alias("n_bytes"), text(text_col).alias("_text"))
    return rows.mapInArrow(count, f"_id {kind}, n_bytes long, n_tokens long").withColumnRenamed("_id", id_col)
