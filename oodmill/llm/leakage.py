"""Evaluation texts inside training texts: broadcast word n-grams, scanned over the stream of visible letters."""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oodmill.session import merged, spread

SOFT = "\x01"  # a place where a word may or may not end
# Tags that do not end a word.
INLINE = "a|abbr|b|bdi|big|cite|code|del|em|font|i|ins|kbd|mark|q|s|samp|small|span|strike|strong|sub|sup|tt|u|var|wbr"
_INLINE = re.compile(rf"<!--.*?-->|</?(?:{INLINE})\b[^<>]*>", re.I | re.S)
_TAG = re.compile(r"</?[a-z!?][^<>]*>", re.I)
_UNSEEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\u00ad\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufeff]")
_LINE = r"[ \t]*(?:(?:[>|*#;%]+|//)[ \t]*|remark[ \t]+\d+[ \t]+)*"
_BROKEN = re.compile(rf"[-\u2010\u2011][ \t]*\r?\n{_LINE}", re.I)
_PREFIX = re.compile(r"^[ \t]*remark[ \t]+\d+\b", re.I | re.M)
_COMMAND = re.compile(r"\\[a-z]+\*?(?:\[[^\]\n]*\])?\{?", re.I)
_LINK = re.compile(r"\]\([^()\s]*\)")
_MISREAD = re.compile("[\u00c2-\u00f4][\x80-\u00bf\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u2013-\u2021\u2022\u2026\u2030\u2039\u203a\u20ac\u2122]{1,3}")
_STRANGE = re.compile(r"[^\w\x00-\x7f]")
_MARK = re.compile("[\u0300-\u036f]")


def _reread(m: re.Match) -> str:
    for code in ("cp1252", "latin-1"):
        try:
            return m.group().encode(code).decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
    return m.group()


def visible(text: str | None) -> str:
    """The text as a reader sees it, in lower case without accents, markup and line breaks inside words.

    Places where a word may or may not end (hyphens at line ends, inline tags) become SOFT. NULL gives an empty text.
    """
    if not text:
        return ""
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _MISREAD.sub(_reread, text))
    if not text.isprintable():
        text = _UNSEEN.sub("", text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub(SOFT, text))
    if "\\" in text:
        text = _COMMAND.sub(SOFT, text)
    if "](" in text:
        text = _LINK.sub(" ", text)
    if "\n" in text:
        text = _PREFIX.sub("", _BROKEN.sub(SOFT, text))
    if not text.isascii():
        text = _STRANGE.sub(" ", _MARK.sub("", unicodedata.normalize("NFD", text)).replace("\u00df", "ss"))
    return text.lower()


_ENTITY = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")
_CLUSTER = re.compile("[^\x00-\x7f][\u0300-\u036f]*|[\x00-\x7f][\u0300-\u036f]+")
_WIDE = re.compile(r"[^\x00-\x7f]")


class Traced:
    """A text on its way to visible(), with the place in the first text that each character stands for."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))

    def sub(self, pattern: re.Pattern, new) -> None:
        text, start, end, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            a, b = m.span()
            put = new(m) if callable(new) else new
            text += [self.text[at:a], put]
            start += self.start[at:a] + [self.start[a]] * len(put)
            end += self.end[at:a] + [self.end[b - 1]] * len(put)
            at = b
        if at:
            self.text, self.start, self.end = "".join([*text, self.text[at:]]), start + self.start[at:], end + self.end[at:]


def traced(text: str) -> Traced:
    """visible(text), step by step, with the places its characters come from."""
    t = Traced(text)
    plain = lambda m: _STRANGE.sub(" ", _MARK.sub("", unicodedata.normalize("NFD", m.group())).replace("\u00df", "ss"))
    for _ in range(2):
        t.sub(_ENTITY, lambda m: html.unescape(m.group()))
    t.sub(_MISREAD, _reread)
    t.sub(_CLUSTER, lambda m: unicodedata.normalize("NFKC", m.group()))
    for pattern, new in ((_UNSEEN, ""), (_INLINE, SOFT), (_TAG, " "), (_COMMAND, SOFT), (_LINK, " ")):
        t.sub(pattern, new)
    if "\n" in t.text:
        t.sub(_BROKEN, SOFT)
        t.sub(_PREFIX, "")
    t.sub(_WIDE, plain)
    t.text = t.text.lower()
    return t


_WORD = re.compile(r"[^\W_]+")
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def _fingerprints(stream: np.ndarray, at: np.ndarray, words: int) -> np.ndarray:
    """Hash of the first 8 * words bytes from each place; the stream must reach that far."""
    eights = np.lib.stride_tricks.as_strided(stream, (len(stream) - 7, 8), (1, 1))
    out = np.zeros(len(at), np.uint64)
    for i in range(words):
        out = (out ^ np.ascontiguousarray(eights[at + 8 * i]).view(np.uint64)[:, 0]) * _MIX[i]
        out ^= out >> np.uint64(32)
    return out


class Passages:
    """The n-grams of a bounded set of test items, in arrays: the letters of all items in one row, and for each n-gram the
    hash of its beginning, place, length and item, ordered by hash. About 25 bytes a word and one a letter."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        letters, starts, sizes, owners, at = [], [], [], [], 0
        for item, text in items:
            tokens = [w.encode("utf-8", "ignore") for w in _WORD.findall(visible(text).replace(SOFT, ""))]
            if len(tokens) < n:
                continue
            edge = at + np.cumsum([0, *map(len, tokens)])
            starts.append(edge[:-n])
            sizes.append(edge[n:] - edge[:-n])
            owners.append(np.full(len(tokens) - n + 1, item, np.int64))
            letters.extend(tokens)
            at = int(edge[-1])
        self.letters = b"".join(letters)
        self.empty = not starts
        if self.empty:
            return
        start, size, owner = np.concatenate(starts), np.concatenate(sizes), np.concatenate(owners)
        self.words = max(1, min(6, int(size.min()) // 8))
        keys = _fingerprints(np.frombuffer(self.letters + bytes(64), np.uint8), start, self.words)
        order = np.argsort(keys, kind="stable")
        self.keys, self.start, self.size, self.owner = keys[order], start[order].astype(np.int32), size[order].astype(np.int32), owner[order]
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[(self.keys >> np.uint64(42)).astype(np.int64)] = True

    @property
    def nbytes(self) -> int:
        return len(self.letters) if self.empty else len(self.letters) + sum(x.nbytes for x in (self.keys, self.start, self.size, self.owner, self.sieve))

    def hits(self, seen: list[bytes]) -> Iterator[tuple[int, set[int], int, int]]:
        """(document, items, first byte, byte after the last) of each n-gram that stands in a document, in order."""
        if self.empty:
            return
        raw = np.frombuffer(b"\n".join([*seen, bytes(64)]), np.uint8)
        letter = _IS_WORD[raw]
        start_raw = letter & ~np.r_[False, letter[:-1]]
        stream = np.concatenate([raw[letter], np.zeros(64, np.uint8)])
        opens = start_raw[letter]
        begin = np.cumsum([0] + [len(s) + 1 for s in seen])[:-1]
        passed = np.r_[0, np.cumsum(letter)]
        first = passed[begin]  # place of each document in the stream
        places = np.flatnonzero(opens)
        places = places[places + 8 * self.words <= len(opens) + 56]
        keys = _fingerprints(stream, places, self.words)
        hit = self.sieve[(keys >> np.uint64(42)).astype(np.int64)]
        places, keys = places[hit], keys[hit]
        low, high = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, side="right")
        real = high > low
        places, low, high = places[real], low[real], high[real]
        if not len(places):
            return
        ends = np.r_[first[1:], passed[-1]]
        whole = stream.tobytes()
        back = np.flatnonzero(letter)
        docs = np.searchsorted(first, places, side="right") - 1
        for at, lo, hi, doc in zip(places.tolist(), low.tolist(), high.tolist(), docs.tolist(), strict=True):
            found: dict[int, set[int]] = {}
            for g in range(lo, hi):
                size, home = int(self.size[g]), int(self.start[g])
                end = at + size
                if end > ends[doc] or end < ends[doc] and not opens[end] or whole[at:end] != self.letters[home : home + size]:
                    continue
                found.setdefault(end, set()).add(int(self.owner[g]))
            for end, items in found.items():
                yield doc, items, int(back[at] - begin[doc]), int(back[end - 1] - begin[doc]) + 1

    def find(self, ids: np.ndarray, texts: list[str | None]) -> Iterator[tuple[int, int, int]]:
        """(document, item, windows) of each item with an n-gram in the document."""
        found: dict[tuple[int, int], int] = defaultdict(int)
        for doc, items, _, _ in self.hits([visible(t).encode("utf-8", "ignore") for t in texts]):
            for item in items:
                found[doc, item] += 1
        for (doc, item), count in found.items():
            yield int(ids[doc]), item, count

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item, start, end) of the passages in the text as it is written; n-grams that overlap or touch are one."""
        t = traced(text or "")
        char = np.repeat(np.arange(len(t.text)), [len(c.encode("utf-8", "ignore")) for c in t.text]) if t.text else np.empty(0, np.int64)
        last: dict[int, list[int]] = {}
        out: list[tuple[int, int, int]] = []
        for _, items, a, b in self.hits([t.text.encode("utf-8", "ignore")]):
            start, end = t.start[char[a]], t.end[char[b - 1]]
            for item in items:
                if item in last and start <= last[item][1]:
                    last[item][1] = max(last[item][1], end)
                    continue
                if item in last:
                    out.append((item, *last[item]))
                last[item] = [start, end]
        return sorted(out + [(item, *s) for item, s in last.items()])


def blocks(items: DataFrame, item: str, item_text: str, n: int, block_chars: int) -> Iterator[Passages]:
    """The items, block by block of at most block_chars letters (one item at least), however many there are."""
    wanted = items.select(F.col(f"`{item}`").cast("bigint"), F.col(f"`{item_text}`")).where(F.col(f"`{item_text}`").isNotNull())
    block, size = [], 0
    for ident, words in wanted.toLocalIterator():
        if block and size + len(words) > block_chars:
            yield Passages(block, n)
            block, size = [], 0
        block.append((ident, words))
        size += len(words)
    yield Passages(block, n)


def leaked(
    docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, n: int = 13, block_chars: int = 30_000_000
) -> DataFrame:
    """(doc_id, item_id, windows): documents that hold n or more consecutive words of an item, as a reader sees both.

    Items are a bounded test set: they are taken block by block of at most block_chars letters, each block becomes one
    broadcast set of n-grams (200 MB at most for words of four letters and more) and one scan of the documents, so
    nothing broadcast outgrows a block. Candidates from hashed window starts are verified letter by letter. Items of
    fewer than n words and NULL or empty texts have no case; documents of any length are scanned whole; repeated
    documents are rows of their own.
    """
    spark = docs.sparkSession
    held = docs.select(F.col(f"`{doc}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("text is not null")
    held = spread(held, "doc_id")

    def scan(passages: Passages) -> DataFrame:
        shared = spark.sparkContext.broadcast(passages)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = list(shared.value.find(batch["doc_id"].to_numpy(), list(batch["text"])))
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "windows"]).astype("int64")

        return held.mapInPandas(run, "doc_id bigint, item_id bigint, windows bigint")

    return reduce(DataFrame.unionByName, [scan(p) for p in blocks(items, item, item_text, n, block_chars)])


def leaked_spans(
    docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, n: int = 13, block_chars: int = 30_000_000
) -> DataFrame:
    """(doc_id, item_id, start_char, end_char): where leaked() finds an item, in characters of the text as written, markup
    and breaks inside a passage included. The same rules hold; a document has a row a passage and item."""
    spark = docs.sparkSession
    held = spread(docs.select(F.col(f"`{doc}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("text is not null"), "doc_id")

    def scan(passages: Passages) -> DataFrame:
        shared = spark.sparkContext.broadcast(passages)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                p, texts = shared.value, dict(zip(batch["doc_id"].tolist(), batch["text"], strict=True))
                hit = dict.fromkeys(d for d, _, _ in p.find(batch["doc_id"].to_numpy(), list(batch["text"])))
                rows = [(d, *s) for d in hit for s in p.spans(texts[d])]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "start_char", "end_char"]).astype({"doc_id": "int64", "item_id": "int64", "start_char": "int32", "end_char": "int32"})

        return held.mapInPandas(run, "doc_id bigint, item_id bigint, start_char int, end_char int")

    return reduce(DataFrame.unionByName, [scan(p) for p in blocks(items, item, item_text, n, block_chars)])


def without_leaks(docs: DataFrame, doc: str, found: DataFrame) -> DataFrame:
    """The documents that disclose no item, all columns kept."""
    return docs.join(merged(found.select(F.col("doc_id").alias("_leaked")).distinct()), F.col(f"`{doc}`") == F.col("_leaked"), "left_anti")


def without_passages(
    docs: DataFrame, text: str, items: DataFrame, item: str, item_text: str, mark: str = " ", n: int = 13, block_chars: int = 30_000_000
) -> DataFrame:
    """The documents with every leaked passage cut out of their text and `mark` put in its place; all rows and columns
    are kept, NULL texts stay NULL, and texts without a passage stay as they are."""

    def cut_out(passages: Passages, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = list(batch[text])
            hit = {d for d, _, _ in passages.find(np.arange(len(texts)), texts)}
            for d in hit:
                kept, at = [], 0
                for start, end in sorted((a, b) for _, a, b in passages.spans(texts[d])):
                    if start >= at:
                        kept += [texts[d][at:start], mark]
                    at = max(at, end)
                texts[d] = "".join([*kept, texts[d][at:]])
            batch[text] = texts
            yield batch

    out = docs
    for passages in blocks(items, item, item_text, n, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(passages)
        out = out.mapInPandas(lambda it, shared=shared: cut_out(shared.value, it), docs.schema)
    return out
