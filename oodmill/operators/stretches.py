"""Candidates for texts that share most of their windows, met by stretches of windows instead of single ones.

Of the n distinct k-letter windows of a text x at least `least` are to stand in a text y, so at most d of them are bad.
Cut x into stretches of `run` neighbouring windows, none in two stretches: a bad window spoils one stretch at most, so of
B stretches B - d are whole in y. A stretch is whole in y if its run + k - 1 letters are a walk over the windows of y that
overlap, and y lists all its walks: those along its letters, and those across places where k - 1 letters repeat. So
every true pair meets, in whatever order y has the windows, on keys that are far rarer than a window. Texts too short or too
repetitive for B > d put their single windows in instead, and others answer only with windows that such texts have.

Keys are dealt to buckets by hash in packed arrays, and buckets are handled in passes, so the disk holds a part of them
at once. Nothing is copied to blocks; what is broadcast is one bitmap of 2 MB and a table
of 4 MB: of the stretches of x, those that many texts have are left out first, as far as B - d allows it.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oodmill.session import cut

BITS = 7  # of an ASCII letter
SINGLE = np.uint64(1 << 63)  # marks keys that are one window
LOWER, UPPER = np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFF00000000)  # of a packed key: identifier, hash
MAP_BITS, CHUNK_BITS = 24, 18  # of the bitmap of single windows, and of a part of it
BUCKET = 20_000_000  # keys of a bucket
LEAST_BUCKETS = 6
PASS = 32_000_000  # keys of a pass, as long as there are no more than MOST_PASSES
MOST_PASSES = 8
HEAT_BITS, HEAT_LETTERS = 22, 4_000_000  # of the table of frequent keys, and letters that are counted for it
HITS = 8_000_000  # meetings held at once
LETTERS = 500_000  # letters taken apart at once


def _mixed(key: np.ndarray) -> np.ndarray:
    h = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1 and so on, `size` of each, one after another."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def most_bad(n: int, least: float) -> int:
    return n - ceil(least * n - 1e-9)


def _disjoint(windows: list, run: int) -> list[int]:
    """Starts of stretches that have no window in common, nor one window twice."""
    out, used, i = [], set(), 0
    while i + run <= len(windows):
        own = set(windows[i : i + run])
        if len(own) == run and used.isdisjoint(own):
            used |= own
            out.append(i)
            i += run
        else:
            i += 1
    return out


class Keys:
    """Keys of some texts: x (its stretches, or all its windows where they don't suffice), y (all its walks), `met`, how
    many keys of x every true partner has, and `singles`, the windows of the texts that put single ones in."""

    def __init__(self, seqs: list[str], k: int, least: float, run: int, heat: np.ndarray | None = None):
        self.k, self.least, self.run, self.count = k, least, run, len(seqs)
        self.met = np.zeros(len(seqs), np.int64)
        plain = np.array([s.isascii() for s in seqs], bool)
        parts = [self._ascii(np.flatnonzero(plain), [s for s in seqs if s.isascii()])]
        parts += [self._other(i, seqs[i]) for i in np.flatnonzero(~plain)]
        names = ("x_owner", "x_key", "y_owner", "y_key", "w_owner", "w_key")
        for name, *arrays in zip(names, *parts, strict=True):
            setattr(self, name, np.concatenate(arrays))
        if heat is not None:
            self._cool(heat)
        self.singles = self.x_key[(self.x_key & SINGLE) > 0]

    def _cool(self, heat: np.ndarray) -> None:
        """Leaves out the stretches that many texts have, as far as at least two are left that a partner must have."""
        hot = heat[(_mixed(self.x_key) >> np.uint64(64 - HEAT_BITS)).astype(np.int64)].astype(np.int64)
        hot[(self.x_key & SINGLE) > 0] = 0
        order = np.lexsort((-hot, self.x_owner))
        owner, hot = self.x_owner[order], hot[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        gone = (hot > 1) & (place < self.met[owner] - 2)
        self.met -= np.bincount(owner[gone], minlength=self.count)
        self.x_owner, self.x_key = owner[~gone], self.x_key[order][~gone]

    def _taken(self, at: int, n: int, stretches: int) -> bool:
        """Whether the stretches suffice; sets how many keys a partner has."""
        slack = stretches - most_bad(n, self.least)
        self.met[at] = slack if slack > 0 else n - most_bad(n, self.least)
        return slack > 0

    def _ascii(self, at: np.ndarray, seqs: list[str]) -> list[np.ndarray]:
        k, run = self.k, self.run
        wide = k + run - 1
        size = np.array([len(s) for s in seqs], np.int64)
        text = np.array(bytearray("".join(seqs).encode()), np.uint8).astype(np.int64)
        owner = np.repeat(np.arange(len(seqs)), size)
        begin = np.cumsum(size) - size
        rest = np.repeat(begin + size, size) - np.arange(len(text))
        padded = np.concatenate([text, np.zeros(wide, np.int64)])

        def code(m: int) -> np.ndarray:
            out = np.zeros(len(text), np.int64)
            for i in range(m):
                out = (out << BITS) | padded[i : i + len(text)]
            return out

        def distinct(m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Codes behind their owners, sorted and distinct; their number and that of the places, a text."""
            there = rest >= m
            both = (owner[there] << (BITS * k)) | code(m)[there]
            both.sort()
            both = both[np.r_[True, both[1:] != both[:-1]]] if len(both) else both
            return both, np.bincount(both >> (BITS * k), minlength=len(seqs)), np.maximum(size - m + 1, 0)

        words, n, places = distinct(k)
        _, joints, joint_places = distinct(k - 1)
        branched = joints != joint_places
        wides = code(wide)
        # walks: along the letters, or over all overlaps where k - 1 letters repeat
        along = (rest >= wide) & ~branched[owner]
        held = words[branched[words >> (BITS * k)]]
        walk, walker = held & ((1 << (BITS * k)) - 1), held >> (BITS * k)
        for _ in range(run - 1):
            ask = (walker << (BITS * k)) | ((walk & ((1 << (BITS * (k - 1))) - 1)) << BITS)
            lo, hi = np.searchsorted(held, ask), np.searchsorted(held, ask + (1 << BITS))
            new = _spread(lo, hi - lo)
            walk = (np.repeat(walk, hi - lo) << BITS) | (held[new] & ((1 << BITS) - 1))
            walker = np.repeat(walker, hi - lo)
        # stretches
        number = np.where(n == places, places // run, 0)
        starts = {}
        windows = code(k)
        for i in np.flatnonzero(n != places):
            starts[i] = begin[i] + np.array(_disjoint(windows[begin[i] : begin[i] + places[i]].tolist(), run), np.int64)
            number[i] = len(starts[i])
        enough = np.array([bool(m) and self._taken(at[i], int(m), int(number[i])) for i, m in enumerate(n)], bool)
        regular = np.flatnonzero(enough & (n == places))
        place = np.repeat(begin[regular], number[regular]) + run * _spread(np.zeros(len(regular), np.int64), number[regular])
        place = np.concatenate([place, *[s for i, s in starts.items() if enough[i]]]).astype(np.int64)
        word_owner, word = words >> (BITS * k), (words & ((1 << (BITS * k)) - 1)).astype(np.uint64) | SINGLE
        lone = ~enough[word_owner]
        return [
            at[np.r_[owner[place], word_owner[lone]]], np.r_[wides[place].astype(np.uint64), word[lone]],
            at[np.r_[owner[along], walker]], np.r_[wides[along], walk].astype(np.uint64), at[word_owner], word,
        ]

    def _other(self, at: int, s: str) -> list[np.ndarray]:
        """A text with letters beyond ASCII, in plain Python."""
        k, run = self.k, self.run
        windows = [s[i : i + k] for i in range(len(s) - k + 1)]
        after: dict[str, list[str]] = {}
        for w in set(windows):
            after.setdefault(w[:-1], []).append(w[-1])
        walks = list(set(windows))
        for _ in range(run - 1):
            walks = [w + c for w in walks for c in after.get(w[len(w) - k + 1 :], [])]
        starts = _disjoint(windows, run)
        n = len(set(windows))

        def key(t: str) -> int:
            """Equal texts get equal keys, on this path and the other."""
            if t.isascii():
                return reduce(lambda c, b: (c << BITS) | b, t.encode(), 0)
            return int.from_bytes(blake2b(t.encode(), digest_size=8).digest()) >> 1

        word = np.array([key(w) for w in set(windows)], np.uint64) | SINGLE
        whole = bool(n) and self._taken(at, n, len(starts))
        x = np.array([key(s[i : i + k + run - 1]) for i in starts], np.uint64) if whole else word
        y = np.array([key(w) for w in walks], np.uint64)
        own = lambda a: np.full(len(a), at, np.int64)
        return [own(x), x, own(y), y, own(word), word]


def _portions(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Rows of about LETTERS letters, whose identifiers agree above the lower 32 bits."""
    high = batch["id"].to_numpy() >> 32
    for h in np.unique(high):
        own = batch[high == h]
        part = np.cumsum(own["seq"].str.len().to_numpy()) // LETTERS
        for p in np.unique(part):
            yield own[part == p]


def _meetings(x: np.ndarray, y: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, keys in common) of those with at least `least`, of packed keys; y is sorted and distinct. Meetings are
    counted in parts by the identifiers of x."""
    x.sort()
    lo = np.searchsorted(y, x & UPPER)
    size = np.searchsorted(y, x | LOWER, side="right") - lo
    met = size > 0
    xi, lo, size = (x[met] & LOWER).astype(np.int64), lo[met], size[met]
    parts = int(size.sum() // HITS) + 1
    for p in range(parts):
        own = xi % parts == p
        if not own.any():
            continue
        # identifiers of 32 bits, so a pair fills 64
        pair = np.repeat(xi[own].astype(np.uint64) << np.uint64(32), size[own]) | (y[_spread(lo[own], size[own])] & LOWER)
        pair.sort()
        start = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        number = np.diff(np.r_[start, len(pair)])
        pair, number = pair[start[number >= least]], number[number >= least]
        yield (pair >> np.uint64(32)).astype(np.int64), (pair & LOWER).astype(np.int64), number


def candidates(left: DataFrame, right: DataFrame | None, k: int, least: float, run: int, most_passes: int = MOST_PASSES, pass_keys: int = PASS, bucket_keys: int = BUCKET) -> DataFrame:
    """(a, b): a superset of the pairs where at least `least` of the distinct k-letter windows of the one with fewer of
    them occur in the other; a of left, b of right, or both of left and a < b where right is None.

    Inputs: id bigint, seq string, each sequence once a side; both are read several times, so they should be cut. NULLs
    and texts shorter than k have no window and no pair. run: windows of a stretch, 1 / run should exceed 1 - least.
    """
    spark, across = left.sparkSession, right is not None
    sides = left.select("id", "seq", F.lit(0).alias("side"))
    if across:
        sides = sides.unionByName(right.select("id", "seq", F.lit(1).alias("side")))
    sides = sides.where(F.length("seq") >= k)
    letters = sides.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0))).first()[0]
    keys = letters * (1 + 1 / run)
    passes = max(1, min(most_passes, ceil(keys / pass_keys)))
    # few buckets: a true pair has its share of keys in one of them, and the more that is, the fewer meet by chance
    buckets = ceil(max(keys / bucket_keys, LEAST_BUCKETS) / passes)
    every = buckets * passes

    def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(0, np.uint64)
        for batch in batches:
            for part in _portions(batch):
                new = Keys(list(part["seq"]), k, least, run).singles
                seen = np.unique(np.r_[seen, _mixed(new) >> np.uint64(64 - MAP_BITS)])
        chunk = (seen >> np.uint64(CHUNK_BITS)).astype(np.int64)
        for c in np.unique(chunk):
            bits = np.zeros(1 << CHUNK_BITS, np.uint8)
            bits[(seen[chunk == c] & np.uint64((1 << CHUNK_BITS) - 1)).astype(np.int64)] = 1
            yield pd.DataFrame({"chunk": [c], "bits": [np.packbits(bits).tobytes()]})

    def together(part: pd.DataFrame) -> pd.DataFrame:
        bits = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in part["bits"]])
        return pd.DataFrame({"chunk": part["chunk"].iloc[:1].to_numpy(), "bits": [bits.tobytes()]})

    chunks = sides.select("id", "seq").mapInPandas(alone, "chunk bigint, bits binary").groupBy("chunk").applyInPandas(together, "chunk bigint, bits binary").collect()
    lone = np.zeros(1 << (MAP_BITS - 3), np.uint8) if chunks else np.zeros(0, np.uint8)
    for r in chunks:
        lone[r["chunk"] << (CHUNK_BITS - 3) : (r["chunk"] + 1) << (CHUNK_BITS - 3)] = np.frombuffer(r["bits"], np.uint8)
    # which keys many texts have is told from some texts; it decides which keys are left out, not which pairs are found
    share = min(1.0, HEAT_LETTERS / max(1, letters))
    some = [r["seq"] for r in sides.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000)).select("seq").toLocalIterator()]
    heat = np.zeros(1 << HEAT_BITS, np.int64)
    for i in range(0, len(some), 2000):
        heat += np.bincount((_mixed(Keys(some[i : i + 2000], k, least, run).y_key) >> np.uint64(64 - HEAT_BITS)).astype(np.int64), minlength=len(heat))
    # beside what keys that share a place have by chance
    heat = np.clip(heat - int(np.median(heat)), 0, 255).astype(np.uint8)
    wanted = spark.sparkContext.broadcast((lone, heat))

    def listed(this: int):
        def run_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            bits, heat = wanted.value
            for batch in batches:
                for side in (0, 1):
                    for part in _portions(batch[batch["side"] == side]):
                        yield from rows(part, side, bits, heat)

        def rows(part: pd.DataFrame, side: int, bits: np.ndarray, heat: np.ndarray) -> Iterator[pd.DataFrame]:
            ids = part["id"].to_numpy()
            low, high = (ids & 0xFFFFFFFF).astype(np.uint64), int(ids[0] >> 32)
            keys = Keys(list(part["seq"]), k, least, run, heat)
            # where one key is all that a partner is sure to have, it counts twice
            once = keys.met[keys.x_owner] == 1
            x_owner, x_key = np.r_[keys.x_owner, keys.x_owner[once]], np.r_[keys.x_key, keys.x_key[once]]
            # how many keys a partner has, rounded down to three binary places, so there are few levels
            places = np.maximum(np.floor(np.log2(np.maximum(keys.met, 2))).astype(np.int64) - 2, 0)
            share = (np.maximum(keys.met, 2) >> places << places)[x_owner]
            y_owner, y_key = keys.y_owner, keys.y_key
            if len(bits):
                at = (_mixed(keys.w_key) >> np.uint64(64 - MAP_BITS)).astype(np.int64)
                asked = (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1) > 0
                y_owner, y_key = np.r_[y_owner, keys.w_owner[asked]], np.r_[y_key, keys.w_key[asked]]
            for owner, key, level in ((x_owner, x_key, share), (y_owner, y_key, np.zeros(len(y_key), np.int64))):
                h = _mixed(key)
                bucket = ((h >> np.uint64(32)) % np.uint64(every)).astype(np.int64)
                own = bucket % passes == this
                group = level[own] * every + bucket[own]
                post = (h[own] << np.uint64(32)) | low[owner[own]]
                order = np.argsort(group, kind="stable")
                group, post = group[order], post[order]
                start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.empty(0, np.int64)
                yield pd.DataFrame(
                    {"bucket": group[start] % every // passes, "side": side, "level": group[start] // every, "high": high, "data": [p.tobytes() for p in np.split(post, start[1:])] if len(start) else []}
                )

        return run_

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Meetings in a bucket, which is streamed to arrays by side, level and upper half of the identifiers."""
        held: dict[tuple[int, int, int], bytearray] = {}
        for batch in batches:
            for side, level, high, data in zip(batch["side"], batch["level"], batch["high"], batch["data"], strict=True):
                held.setdefault((side, level, high), bytearray()).extend(data)
        for other, own_level, y_high in [x for x in held if x[1] == 0]:
            y = np.frombuffer(held[other, own_level, y_high], np.uint64)
            y.sort()
            y = y[np.r_[True, y[1:] != y[:-1]]]
            side = 1 - other if across else other
            for _, level, x_high in [x for x in held if x[0] == side and x[1] > 0]:
                # one bucket has its share of the keys; what others may have below theirs is granted
                share = -(-level // every)
                for x, y_, n in _meetings(np.frombuffer(held[side, level, x_high], np.uint64), y, share):
                    x, y_ = x | (x_high << 32), y_ | (y_high << 32)
                    if not across:
                        x, y_, n = (v[x != y_] for v in (x, y_, n))
                    for i in range(0, len(x), 1_000_000):
                        yield pd.DataFrame({"x": x[i : i + 1_000_000], "y": y_[i : i + 1_000_000], "n": n[i : i + 1_000_000] - share + 1, "side": side, "least": level - every * (share - 1)})

    found = []
    for this in range(passes):
        posts = sides.mapInPandas(listed(this), "bucket int, side bigint, level bigint, high bigint, data binary").repartitionById(buckets, "bucket")
        found.append(cut(posts.mapInPandas(met, "x bigint, y bigint, n int, side int, least int")))
        if this + 1 < passes:
            # keys of a pass stay on disk until the driver lets go of them
            del posts
            gc.collect()
            spark.sparkContext._jvm.System.gc()
    enough = reduce(DataFrame.unionByName, found).groupBy("x", "y", "side", "least").agg(F.sum("n").alias("n")).where("n >= least")
    a, b = (F.when(F.col("side") == 0, F.col("x")).otherwise(F.col("y")), F.when(F.col("side") == 0, F.col("y")).otherwise(F.col("x"))) if across else (F.least("x", "y"), F.greatest("x", "y"))
    return enough.select(a.alias("a"), b.alias("b")).distinct()
