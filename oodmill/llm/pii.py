"""Personal information in free text: a character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oodmill.session import spread

TYPES = ["email", "phone", "id_number", "address", "name"]
STATES = 1 + 2 * len(TYPES)  # O, then B and I of each type
WEIGHTS = Path(__file__).with_name("pii_weights.npz")
WINDOW, STRIDE, STEP = 256, 192, 4  # characters; a step of the network reads STEP of them
SHUT = -40.0  # input of a gate that lets nothing through
# a mention begins with B of its type; I follows B or I of the same type only
BARRED = np.array([[-30.0 if j and j % 2 == 0 and i not in (j - 1, j) else 0.0 for j in range(STATES)] for i in range(STATES)], np.float32)
BARRED_START = BARRED[0]

# Characters with an id of their own; digits share one, other letters and signs one each.
SIGNS = " \n.,;:@()[]{}<>+-_'/\\\"&#%=!?*|~º°’"
_ID = {c: i + 6 for i, c in enumerate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + SIGNS)}
PAD, DIGIT, LOWER, UPPER, SPACE, OTHER = range(6)
VOCABULARY = len(_ID) + 6


def _char_id(c: str) -> int:
    base = unicodedata.normalize("NFD", c)[0]
    if c in _ID or base in _ID:
        return _ID.get(c, _ID.get(base))
    if c.isdigit():
        return DIGIT
    if c.isalpha():
        return UPPER if c.isupper() else LOWER
    return SPACE if c.isspace() else OTHER


_TABLE = np.array([_char_id(chr(i)) for i in range(0x3000)], np.uint8)


def encode(text: str) -> np.ndarray:
    if text.isascii():
        return _TABLE[np.frombuffer(text.encode("ascii"), np.uint8)]
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _TABLE[np.minimum(points, 0x2FFF)]


_BREAK = re.compile(r"[.!?]\s+(?=[A-ZÀ-Þ<])|\n\s*\n")


# 1: blank, 2: end of a sentence, 3: line end
_ENDS = np.zeros(256, np.uint8)
_ENDS[[SPACE, _ID[" "], _ID["\n"]]] = 1
_ENDS[[_ID[c] for c in ".!?" if c in _ID]] = 2
_ENDS[_ID["\n"]] = 3


def segments(text: str, ids: np.ndarray | None = None) -> list[tuple[int, int]]:
    """(start, end) of the stretches read at once: sentences, cut where the next cannot be part of a mention.

    A sentence ends after a word of four letters or more, a digit or a closing bracket; shorter words may be titles
    or initials.
    """
    out, at = [], 0
    ids = encode(text) if ids is None else ids
    kind = _ENDS[ids]
    for place in np.flatnonzero((kind[:-1] > 1) & (kind[1:] & 1)).tolist():
        m = _BREAK.match(text, place) if place >= at else None
        if not m:
            continue
        end = place
        if text[end] != "\n":
            before = text[end - 1 : end]
            if not (before.isdigit() or before in (")", "]") or end >= 4 and text[end - 4 : end].isalpha()):
                continue
            end += 1
        if end > at:
            out.append((at, end))
        at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


def side_by_side(sizes: list[int], most: int, cells: int) -> Iterator[list[int]]:
    """Indices in groups of like size, each of at most `most` members and, padded, at most `cells` places."""
    group: list[int] = []
    for i in sorted(range(len(sizes)), key=lambda i: sizes[i]):
        if group and (len(group) == most or (len(group) + 1) * sizes[i] > cells):
            yield group
            group = []
        group.append(i)
    if group:
        yield group


class Tagger:
    """Forward pass and decoding. Gate order: input, forget, output, candidate.

    Each step of either direction reads four characters and each of them gets scores of its own, which quarters the steps.
    """

    def __init__(self, weights: dict[str, np.ndarray]):
        h = weights["uf"].shape[0]
        half = np.array([0.5, 0.5, 0.5, 1.0], np.float32)[:, None, None]  # sigmoid(x) = (1 + tanh(x / 2)) / 2
        self.h = h
        by_gate = lambda w: np.ascontiguousarray(w.astype(np.float32).reshape(-1, 4, h).transpose(1, 0, 2) * half)
        # inputs of each two characters of a step, summed beforehand
        self.inputs = []
        for d in "fb":
            two = [weights[f"w{d}{i}"][:, None] + weights[f"w{d}{i + 1}"][None] for i in range(0, STEP, 2)]
            two[0] = two[0] + weights[f"b{d}"]
            two[0][PAD, PAD, :h] = SHUT  # padding leaves the state at zero
            self.inputs.append([by_gate(x.reshape(VOCABULARY**2, 4 * h)) for x in two])
        # hidden values are kept doubled, which saves a pass over them; the weights that read them are halved
        self.hidden = [by_gate(weights[f"u{d}"] * 0.5) for d in "fb"]
        self.out = [np.ascontiguousarray(weights[f"o{d}"].astype(np.float32).T * np.float32(0.5)) for d in "fb"]
        self.bias = weights["bias"].astype(np.float32)
        self.trans = weights["trans"].astype(np.float32) + BARRED
        self.start = weights["start"].astype(np.float32) + BARRED_START
        # what entering each B wins over staying in O
        self.into = np.maximum(self.trans[0] - self.trans[0, 0], self.start - self.start[0])[1::2]
        self.gain, self.extra = self._most_gain()

    def _most_gain(self, steps: int = 512) -> tuple[float, float]:
        """(a, b): a run outside O wins at most a * n + b by its transitions after the first character, n more of them
        and the way back, over staying in O."""
        stay = self.trans[0, 0]
        back = np.maximum(self.trans[1:, 0] - stay, 0.0)
        inside = self.trans[1:, 1:] - stay
        best, won = np.where(np.arange(1, STATES) % 2, 0.0, -1e9), []
        for _ in range(steps):
            won.append(float((best + back).max()))
            best = (best[:, None] + inside).max(0)
        gain = max(0.0, won[-1] - won[-2], (won[-1] - won[steps // 2]) / (steps - 1 - steps // 2)) + 1e-4
        return gain, max(w - gain * i for i, w in enumerate(won)) + 1e-3

    def leads(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By how much O leads over every other state, and over entering a mention; states are the second axis."""
        o = scores[:, 0]
        into = self.into.reshape(-1, *[1] * (scores.ndim - 2))
        return o - scores[:, 1:].max(1), o - (scores[:, 1::2] + into).max(1)

    def _run(self, pairs: list[np.ndarray], d: int) -> np.ndarray:
        """Doubled hidden values of one direction, (steps * batch, hidden), from pairs of shape (steps, batch). Each gate
        lies in a block of its own, so no pass strides over the others."""
        t, b = pairs[0].shape
        h = self.h
        out, cell, hidden = np.empty((t, b, h), np.float32), np.zeros((b, h), np.float32), np.zeros((b, h), np.float32)
        g, r, tmp = np.empty((4, b, h), np.float32), np.empty((4, b, h), np.float32), np.empty((b, h), np.float32)
        for i in range(t) if d == 0 else range(t - 1, -1, -1):
            np.matmul(hidden, self.hidden[d], out=g)
            for table, two in zip(self.inputs[d], pairs, strict=True):
                np.take(table, two[i], axis=1, out=r, mode="clip")
                g += r
            np.tanh(g, out=g)
            g[:3] += 1
            cell *= g[1]
            np.multiply(g[0], g[3], out=tmp)
            cell += tmp
            cell *= 0.5
            np.tanh(cell, out=tmp)
            hidden = out[i]
            np.multiply(g[2], tmp, out=hidden)
        return out.reshape(-1, h)

    def scores(self, windows: list[np.ndarray]) -> np.ndarray:
        """Scores of windows of like length side by side: (character of the step, states, steps, windows)."""
        size = np.array([len(w) for w in windows])
        t = -(-int(size.max()) // STEP)
        ids = np.full((len(windows), STEP * t), PAD, np.uint8)
        ids[np.arange(STEP * t) < size[:, None]] = np.concatenate(windows)
        wide = ids.astype(np.int64)
        pairs = [np.ascontiguousarray((wide[:, i::STEP] * VOCABULARY + wide[:, i + 1 :: STEP]).T) for i in range(0, STEP, 2)]
        both = self.out[0] @ self._run(pairs, 0).T
        both += self.out[1] @ self._run(pairs, 1).T
        both += np.tile(self.bias, STEP)[:, None]
        return both.reshape(STEP, STATES, t, len(windows))

    def viterbi(self, scores: list[np.ndarray], inner: list[tuple[bool, bool]] | None = None) -> list[np.ndarray]:
        """Best path through each of many stretches, those of like length decoded side by side.

        inner: whether O comes right before and right after a stretch; else it begins or ends there.
        """
        inner = inner or [(False, False)] * len(scores)
        paths: list[np.ndarray] = [None] * len(scores)  # type: ignore[list-item]
        for part in side_by_side([len(x) for x in scores], 1024, 200_000):
            part = part[::-1]  # longest first, so those still open at a step come first
            size = np.array([len(scores[i]) for i in part])
            longest, b = size[0], len(part)
            still = b - np.searchsorted(size[::-1], np.arange(longest + 1), side="right")
            block = np.zeros((longest, b, STATES), np.float32)
            for j, i in enumerate(part):
                block[: size[j], j] = scores[i]
            back = np.zeros((longest, b, STATES), np.uint8)
            best = np.where(np.array([inner[i][0] for i in part])[:, None], self.trans[0], self.start) + block[0]
            into_t = np.ascontiguousarray(self.trans.T)[None]
            for t in range(1, longest):
                n = still[t]
                into = best[:n, None, :] + into_t
                back[t, :n] = into.argmax(2)
                best[:n] = into.max(2) + block[t, :n]
            best += np.where(np.array([inner[i][1] for i in part])[:, None], self.trans[:, 0], 0.0)
            state = best.argmax(1)
            path = np.zeros((longest, b), np.uint8)
            at = np.arange(b)
            for t in range(longest - 1, -1, -1):
                n = still[t]
                path[t, :n] = state[:n]
                if t:
                    state[:n] = back[t, at[:n], state[:n]]
            for j, i in enumerate(part):
                paths[i] = path[: size[j], j]
        return paths

    def undecided(self, leads: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, int]]:
        """(stretch, start, end) of the places where the best path may leave O; elsewhere it is O for sure.

        A run outside O loses what O leads by and wins at most gain a step and extra in all. A place is open only if
        some run through it can come out ahead: best sums to both sides, by running maxima.
        """
        out = []
        for part in side_by_side([len(x) for x, _ in leads], 1024, 400_000):
            size = np.array([len(leads[i][0]) for i in part])
            win, enter = (np.full((size[-1], len(part)), -1e9, np.float32) for _ in range(2))
            for j, i in enumerate(part):
                win[: size[j], j], enter[: size[j], j] = self.gain - leads[i][0], -leads[i][1]
            total = np.cumsum(win, axis=0, dtype=np.float64)
            left = np.maximum.accumulate(enter - total, axis=0) + total
            right = np.maximum.accumulate(total[::-1], axis=0)[::-1] - total
            open_ = left + right + self.extra > 0
            edge = np.diff(np.pad(open_, ((1, 1), (0, 0))).astype(np.int8), axis=0).T
            col, start = np.nonzero(edge == 1)
            end = np.nonzero(edge == -1)[1]
            out += [(part[c], int(a), min(int(b), int(size[c]))) for c, a, b in zip(col, start, end, strict=True)]
        return out

    def spans(self, stretches: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
        """(start, end, type) of the mentions of each stretch.

        Long stretches are cut into overlapping windows; in an overlap each character takes the scores of the window
        in which it lies deeper, and one decoding over the whole stretch reconciles them.
        """
        windows, owner = [], []
        for k, s in enumerate(stretches):
            for at in range(0, max(1, len(s) - (WINDOW - STRIDE)), STRIDE):
                windows.append(s[at : at + WINDOW])
                owner.append((k, at))
        whole: dict[int, np.ndarray] = {}
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        size = np.array([len(w) for w in windows])
        part_of_long = np.array([len(stretches[k]) for k, _ in owner]) != size
        half = (WINDOW - STRIDE) // 2
        for part in map(np.array, side_by_side(size.tolist(), 768, 768 * WINDOW)):
            block = self.scores([windows[i] for i in part])
            lead, enter = (x.transpose(1, 0, 2).reshape(-1, len(part)) for x in self.leads(block))
            beyond = np.arange(len(lead))[:, None] >= size[part]
            lead[beyond] = enter[beyond] = 1e3
            # whether some run, entered here and carried on, can come out ahead
            # (single precision holds a window; the slack is wider than its error)
            total = np.cumsum(self.gain - lead, axis=0)
            near = (np.maximum.accumulate(total[::-1], axis=0)[::-1] - total + (self.extra + 5e-3) > enter).any(0)
            for j in np.flatnonzero(near | part_of_long[part]):
                k, at = owner[part[j]]
                n = size[part[j]]
                own = block[:, :, :, j].transpose(2, 0, 1).reshape(-1, STATES)
                if n == len(stretches[k]):
                    whole[k], known[k] = own[:n], (lead[:n, j], enter[:n, j])
                    continue
                if k not in whole:
                    whole[k] = np.empty((len(stretches[k]), STATES), np.float32)
                # the first half of an overlap belongs to the window before, the second to the one after
                skip, stop = half if at else 0, n if at + n == len(stretches[k]) else n - half
                whole[k][at + skip : at + stop] = own[skip:stop]
        some = list(whole)
        parts = [(some[i], a, b) for i, a, b in self.undecided([known[k] if k in known else self.leads(whole[k]) for k in some])] if some else []
        paths = self.viterbi([whole[k][a:b] for k, a, b in parts], [(a > 0, b < len(whole[k])) for k, a, b in parts])
        out: list[list[tuple[int, int, int]]] = [[] for _ in stretches]
        for (k, a, _), path in zip(parts, paths, strict=True):
            at = 0
            while at < len(path):
                if path[at]:
                    kind = (path[at] - 1) // 2
                    end = at + 1
                    while end < len(path) and path[end] == 2 * kind + 2:
                        end += 1
                    out[k].append((a + at, a + end, int(kind)))
                    at = end
                else:
                    at += 1
        return out


# exact checks of what the tagger found
_AT = r"\s?(?:@|\(at\)|\[at\])\s?"
_DOT = r"(?:\.|\s?(?:\[dot\]|\(dot\))\s?)"
_EMAIL = re.compile(rf"[\w.+'-]*\w[\w+'-]*{_AT}[\w-]+(?:{_DOT}[\w-]+)*{_DOT}[A-Za-z]{{2,}}", re.I)
_TITLE = re.compile(r"^(?:(?:dr|dra|prof|mr|mrs|ms|mme|sr|sra|herr|frau|mailto|tel|name)\b[.:]*\s*)+(?=\S)", re.I)
_WORDY = re.compile(r"\w")


def checked(text: str, start: int, end: int, kind: int) -> tuple[int, int] | None:
    """The mention with exact bounds, or None if it cannot be one of its type."""
    while start > 0 and end > start and text[start].isalnum() and text[start - 1].isalnum():
        start -= 1
    while end < len(text) and text[end - 1].isalnum() and text[end].isalnum():
        end += 1
    name = TYPES[kind]
    if name == "email":
        near = _EMAIL.search(text, max(0, start - 40), min(len(text), end + 40))
        while near and near.end() <= start:
            near = _EMAIL.search(text, near.end(), min(len(text), end + 40))
        if not near or near.start() >= end:
            return None
        start, end = near.start(), near.end()
    elif name == "name":
        title = _TITLE.match(text[start:end])
        if title and title.end() < end - start and title.group().rstrip()[-1] in ".:" or title and title.group().strip().lower() in ("frau", "herr"):
            start += title.end()
    first = _WORDY.search(text, start, end)
    if not first:
        return None
    start = first.start()
    digits = sum(c.isdigit() for c in text[start:end])
    if name == "phone" and digits < 7 or name == "id_number" and digits < 5 or name == "address" and digits < 1:
        return None
    if name == "name" and (digits or end - start < 3 or text[start].islower() and not re.search(r"\s", text[start:end])):
        return None
    return start, end


def load(path: str | Path = WEIGHTS) -> dict[str, np.ndarray]:
    with np.load(path) as z:
        return {k: z[k].astype(np.float32) for k in z.files}


def find(tagger: Tagger, texts: list[str | None], memo: dict[bytes, list] | None = None, most: int = 200_000) -> list[list[tuple[int, int, str]]]:
    """(start, end, type) of the mentions of each text. Stretches that read alike are tagged once."""
    memo = {} if memo is None else memo
    plan, fresh = [], {}
    for text in texts:
        ids = encode(text) if text else np.empty(0, np.uint8)
        parts = [(a, b, ids[a:b].tobytes()) for a, b in segments(text, ids)] if text else []
        plan.append(parts)
        for _, _, key in parts:
            if key not in memo:
                fresh[key] = None
    keys = list(fresh)
    for lo in range(0, len(keys), 4096):
        some = keys[lo : lo + 4096]
        fresh.update(zip(some, tagger.spans([np.frombuffer(k, np.uint8) for k in some]), strict=True))
    out = []
    for text, parts in zip(texts, plan, strict=True):
        found = []
        for a, _, key in parts:
            for s, e, kind in memo[key] if key in memo else fresh[key]:
                if bounds := checked(text, a + s, a + e, kind):
                    found.append((*bounds, TYPES[kind]))
        tidy: list[tuple[int, int, str]] = []
        for f in sorted(set(found)):
            if not tidy or f[0] >= tidy[-1][1]:
                tidy.append(f)
        out.append(tidy)
    if len(memo) + len(fresh) > most:
        memo.clear()
    memo.update(fresh)
    return out


def mentions(docs: DataFrame, doc: str, text: str, weights: str | Path = WEIGHTS) -> DataFrame:
    """(doc_id, start_char, end_char, pii_type): every mention of personal information.

    start_char is the 0-based place of its first letter or digit, end_char the place after its end. Texts are read
    whole, whatever their length. NULL and empty texts have no mention; repeated documents are rows of their own.
    """
    held = docs.select(F.col(f"`{doc}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("text is not null")
    model = held.sparkSession.sparkContext.broadcast(load(weights))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger, memo = Tagger(model.value), {}
        for batch in batches:
            for lo in range(0, len(batch), 1000):
                part = batch.iloc[lo : lo + 1000]
                rows = [(d, s, e, k) for d, found in zip(part["doc_id"], find(tagger, list(part["text"]), memo), strict=True) for s, e, k in found]
                yield pd.DataFrame(rows, columns=["doc_id", "start_char", "end_char", "pii_type"]).astype({"doc_id": "int64", "start_char": "int32", "end_char": "int32"})

    return spread(held, "doc_id").mapInPandas(run, "doc_id bigint, start_char int, end_char int, pii_type string")


def redacted(docs: DataFrame, doc: str, text: str, weights: str | Path = WEIGHTS) -> DataFrame:
    """(doc_id, text, mentions): each text with typed placeholders such as [EMAIL] in place of its mentions.

    NULL texts stay NULL, with no mention; all other characters are kept as they are.
    """
    held = docs.select(F.col(f"`{doc}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    model = held.sparkSession.sparkContext.broadcast(load(weights))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger, memo = Tagger(model.value), {}
        for batch in batches:
            texts, counts = [], []
            for text, found in zip(batch["text"], find(tagger, list(batch["text"]), memo), strict=True):
                counts.append(len(found))
                for s, e, k in reversed(found):
                    text = f"{text[:s]}[{k.upper()}]{text[e:]}"
                texts.append(text)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": texts, "mentions": np.array(counts, np.int32)})

    return spread(held, "doc_id").mapInPandas(run, "doc_id bigint, text string, mentions int")
