"""Which sequences of two sides have to be compared: those that meet on enough short stretches, found without copies.

Of the n distinct k-letter windows of a sequence x at least `least` are to stand in y, so at most d of them are bad. x is
cut into stretches of RUN neighbouring windows, none in two stretches: a bad window spoils one of the B stretches at most,
so B - d are whole in y, as a walk over windows of y that overlap. y lists all its walks: those along its letters, and
those across places where k - 1 letters repeat. Stretches that many sequences have (a domain) are left out first, as far as
B - d allows it; which ones is told from some sequences, and cannot lose a pair. Sequences too short or too repetitive for
B > d ask for their single windows, which are the beginnings of the walks.

Each side lists its own keys once. Keys are handled in passes by their first window, a pass in buckets: the disk holds
one pass at a time, and what meets in a pass is counted by pair before anything goes on. A pair that has `met` keys in
common has its share of them in some pass, so single meetings by chance end there.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oodmill.operators.stretches import LOWER, UPPER, _disjoint, _mixed, _spread
from oodmill.session import cut, merged, parallelism

RUN = 3  # windows of a stretch; 1 / RUN exceeds 1 - least by a third of the windows, which is what may be left out
TAIL = 27 ** (RUN - 1)  # codes of the letters behind the first window, 0 where there is none
FACTOR = 0x9E3779B1  # odd, so it permutes the codes of windows
BUCKET = 16_000_000  # keys of a bucket
PASS = 30_000_000  # letters of a pass, as long as there are no more than MOST_PASSES
MOST_PASSES = 8
MOST_SHARE = 4  # meetings asked for in a pass; so many hardly ever come by chance
LETTERS = 1_000_000  # letters taken apart at once
HITS = 8_000_000  # meetings held at once
HEAT_BITS, HEAT_LETTERS, HOT = 24, 4_000_000, 3  # of the table of frequent stretches; letters counted; counts that are many


def freed(spark: SparkSession) -> None:
    """Shuffle files that nothing needs stay on disk until the driver lets go of them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Text:
    """Sequences (letters A to Z, at least k) one after another, and the code of the walk along the letters from each
    place that begins a window: window x TAIL + the letters behind it."""

    def __init__(self, seqs: list[str], k: int):
        self.k, self.size = k, np.array([len(s) for s in seqs], np.int64)
        text = np.frombuffer("".join(seqs).encode("ascii"), np.uint8).astype(np.int64) - 65
        self.text, self.begin = text, np.cumsum(self.size) - self.size
        owner = np.repeat(np.arange(len(seqs)), self.size)
        rest = np.repeat(self.begin + self.size, self.size) - np.arange(len(text))
        self.at = np.flatnonzero(rest >= k)
        self.owner = owner[self.at]
        self.window = self._codes(k)[self.at]
        tail = np.zeros(len(self.at), np.int64)
        padded = np.concatenate([text, np.zeros(RUN, np.int64)])
        for i in range(k, k + RUN - 1):
            tail = tail * 27 + np.where(rest[self.at] > i, padded[self.at + i] + 1, 0)
        self.walk = self.window * TAIL + tail
        self._rest, self._all_owner = rest, owner

    def _codes(self, m: int) -> np.ndarray:
        padded = np.concatenate([self.text, np.zeros(m, np.int64)])
        out = np.zeros(len(self.text), np.int64)
        for i in range(m):
            out = out * 26 + padded[i : i + len(self.text)]
        return out

    def joints(self) -> np.ndarray:
        """Numbers of distinct stretches of k - 1 letters."""
        there = self._rest >= self.k - 1
        both = self._all_owner[there] * 26 ** (self.k - 1) + self._codes(self.k - 1)[there]
        both = _distinct(both)
        return np.bincount(both // 26 ** (self.k - 1), minlength=len(self.size))


def _distinct(values: np.ndarray) -> np.ndarray:
    values.sort()
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def width(k: int) -> int:
    """Bits that hold the code of a window."""
    return (26**k - 1).bit_length()


def _slot(walk: np.ndarray) -> np.ndarray:
    return (_mixed(walk.astype(np.uint64)) >> np.uint64(64 - HEAT_BITS)).astype(np.int64)


def plans(seqs: list[str], k: int, least: float, heat: np.ndarray | None = None) -> tuple[np.ndarray, list[bytes], list[bytes]]:
    """Of each sequence: how many of its keys every partner has (below 0 if its keys are single windows), a bitmap of the
    places where its keys begin, and its walks that do not follow its letters."""
    t = Text(seqs, k)
    count, m = len(seqs), 26**k
    words = _distinct(t.owner * m + t.window)
    n, places = np.bincount(words // m, minlength=count), t.size - k + 1
    bad = n - np.ceil(least * n - 1e-9).astype(np.int64)
    # walks across places where k - 1 letters repeat
    branched = t.joints() != t.size - k + 2
    held = words[branched[words // m]]
    first, walker, last, tail = held % m, held // m, held % m, np.zeros(len(held), np.int64)
    for _ in range(RUN - 1):
        ask = walker * m + last % (m // 26) * 26
        lo, hi = np.searchsorted(held, ask), np.searchsorted(held, ask + 26)
        new = held[_spread(lo, hi - lo)] % m
        first, walker, tail = (np.repeat(v, hi - lo) for v in (first, walker, tail))
        last, tail = new, tail * 27 + new % 26 + 1
    walks = _distinct(walker * (m * TAIL) + first * TAIL + tail)
    own = branched[t.owner]
    along = np.sort(t.owner[own] * (m * TAIL) + t.walk[own])
    if len(walks):
        walks = walks[along[np.minimum(np.searchsorted(along, walks), len(along) - 1)] != walks]
    # stretches
    number = np.where(n == places, places // RUN, 0)
    starts = {}
    line = np.cumsum(places) - places  # the first place of each sequence among those that begin a window
    for i in np.flatnonzero(n != places):
        starts[i] = line[i] + np.array(_disjoint(t.window[line[i] : line[i] + places[i]].tolist(), RUN), np.int64)
        number[i] = len(starts[i])
    met, lone = number - bad, number <= bad
    met[lone] = (n - bad)[lone]
    regular = np.flatnonzero(~lone & (n == places))
    key = np.repeat(line[regular], number[regular]) + RUN * _spread(np.zeros(len(regular), np.int64), number[regular])
    key = np.concatenate([key, *[s for i, s in starts.items() if not lone[i]]]).astype(np.int64)
    if heat is not None:
        hot = heat[_slot(t.walk[key])].astype(np.int64)
        touched = np.zeros(count, bool)
        touched[t.owner[key[hot >= HOT]]] = True
        other = ~touched[t.owner[key]]
        order = np.flatnonzero(~other)
        order = order[np.argsort(t.owner[key[order]] * 256 + 255 - hot[order], kind="stable")]
        hot, by = hot[order], t.owner[key[order]]
        gone = (hot >= HOT) & (np.arange(len(by)) - np.searchsorted(by, by) < met[by] - 2)
        met = met - np.bincount(by[gone], minlength=count)
        key = np.concatenate([key[other], key[order[~gone]]])
    single = np.flatnonzero(lone[t.owner])
    single = single[np.unique(t.owner[single] * m + t.window[single], return_index=True)[1]]
    key = np.concatenate([key, single])
    # a bitmap of whole bytes a sequence
    octets = -(-t.size // 8)
    byte = np.cumsum(octets) - octets
    bits = np.zeros(int(octets.sum()) * 8, np.uint8)
    bits[byte[t.owner[key]] * 8 + t.at[key] - t.begin[t.owner[key]]] = 1
    packed = np.packbits(bits, bitorder="little").tobytes()
    cuts = np.searchsorted(walks, np.arange(count + 1) * (m * TAIL))
    walks = walks % (m * TAIL)
    return np.where(lone, -met, met), [packed[a : a + b] for a, b in zip(byte, octets, strict=True)], [walks[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]


def _portions(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Rows of about LETTERS letters, whose identifiers agree above the lower 32 bits."""
    high = batch["id"].to_numpy() >> 32
    for h in np.unique(high):
        own = batch[high == h]
        part = np.cumsum(own["seq"].str.len().to_numpy()) // LETTERS
        for p in np.unique(part):
            yield own[part == p]


def planned(df: DataFrame, rows: DataFrame, k: int, least: float) -> DataFrame:
    """df (id, seq, in_left, in_right) with the plan of each sequence of k letters or more, kept in the shared folder.
    rows (id, seq): where the sequences come from; some of them tell which stretches are frequent."""
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    letters = 64 * rows.where(dealt(64) == 0).agg(F.coalesce(F.sum(F.length("seq")), F.lit(0))).first()[0]
    share = min(1.0, HEAT_LETTERS / max(1, letters))
    some = list({r["seq"] for r in rows.where(dealt(1_000_000) < int(share * 1_000_000)).where(F.length("seq") >= k).select("seq").toLocalIterator()})
    heat = np.zeros(1 << HEAT_BITS, np.int32)
    for i in range(0, len(some), 2000):
        np.add.at(heat, _slot(Text(some[i : i + 2000], k).walk), 1)
    wanted = df.sparkSession.sparkContext.broadcast(np.minimum(heat, 255).astype(np.uint8))

    def with_plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _portions(batch):
                met, begins, walks = plans(list(part["seq"]), k, least, wanted.value)
                yield part.assign(met=met, begins=begins, walks=walks)

    out = cut(df.where(F.length("seq") >= k).select("id", "seq", "in_left", "in_right").mapInPandas(with_plan, "id bigint, seq string, in_left boolean, in_right boolean, met bigint, begins binary, walks binary"))
    freed(df.sparkSession)
    return out


def _posts(part: pd.DataFrame, k: int, this: int, passes: int, buckets: int) -> Iterator[pd.DataFrame]:
    """Keys of a pass in packed arrays, a bucket, side and kind: 0 for the walks, t for stretches of which t are asked for
    in a pass, t + MOST_SHARE for single windows."""
    bits = width(k)
    size = part["seq"].str.len().to_numpy().astype(np.int64)
    end = np.cumsum(size)
    text = np.frombuffer("".join(part["seq"]).encode("ascii"), np.uint8).astype(np.uint32 if bits <= 32 else np.uint64) - 65
    window = np.zeros_like(text)
    for i in range(k):
        window[: len(text) - i] *= 26
        window[: len(text) - i] += text[i:]
    ids = part["id"].to_numpy()
    low = (ids & 0xFFFFFFFF).astype(np.uint64)
    met = part["met"].to_numpy()
    asked = np.clip(-(-np.abs(met) // passes), 1, MOST_SHARE) + np.where(met < 0, MOST_SHARE, 0)
    # the windows of this pass are a range of their mixed codes
    least, most = -(-this * 2**bits // passes), -(-(this + 1) * 2**bits // passes)
    mix = lambda w: (w * w.dtype.type(FACTOR)) & w.dtype.type(2**bits - 1)
    mine = mix(window)
    mine = (mine >= least) & (mine < most)
    for i in range(1, k):
        mine[end - i] = False
    at = np.flatnonzero(mine)
    owner = np.searchsorted(end, at, side="right")
    walk = window[at].astype(np.int64)
    for i in range(k, k + RUN - 1):
        walk = walk * 27 + np.where(at + i < end[owner], text[np.minimum(at + i, len(text) - 1)].astype(np.int64) + 1, 0)
    octets = -(-size // 8)
    begins = np.frombuffer(b"".join(part["begins"]), np.uint8)
    inside = at - (end - size)[owner]
    begins = (begins[(np.cumsum(octets) - octets)[owner] + (inside >> 3)] >> (inside & 7).astype(np.uint8) & 1).astype(bool)
    extra = [np.frombuffer(b, np.int64) for b in part["walks"]]
    more, of = np.concatenate(extra), np.repeat(np.arange(len(extra)), [len(e) for e in extra])
    own = mix((more // TAIL).astype(text.dtype))
    own = (own >= least) & (own < most)
    walk, owner = np.concatenate([walk, more[own]]), np.concatenate([owner, of[own]])
    begins = np.concatenate([begins, np.zeros(len(walk) - len(begins), bool)])
    mixed = mix((walk // TAIL).astype(text.dtype)).astype(np.int64)
    bucket = ((mixed - least) * buckets) // (most - least)
    value = (mixed - least - -(-bucket * (most - least) // buckets)) * TAIL + walk % TAIL
    kind = asked[owner]
    value_x = np.where(kind > MOST_SHARE, value - walk % TAIL, value)
    for side, name in ((0, "in_left"), (1, "in_right")):
        mine = part[name].to_numpy().astype(bool)[owner]
        asking = mine & begins
        group = np.concatenate([bucket[mine] * 16, bucket[asking] * 16 + kind[asking]])
        post = np.concatenate([value[mine], value_x[asking]]).astype(np.uint64) << np.uint64(32) | np.concatenate([low[owner[mine]], low[owner[asking]]])
        order = np.argsort(group, kind="stable")
        group, post = group[order], post[order]
        start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.empty(0, np.int64)
        data = [p.tobytes() for p in np.split(post, start[1:])] if len(start) else []
        yield pd.DataFrame({"bucket": group[start] // 16, "side": side, "kind": group[start] % 16, "high": ids[0] >> 32, "data": data})


def _meet(x: np.ndarray, y: np.ndarray, single: bool, parts: int) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(part, packed pairs of x and y) of all meetings; y is sorted and distinct."""
    x.sort()
    lo = np.searchsorted(y, x & UPPER)
    end = x & UPPER
    size = (np.searchsorted(y, end + np.uint64(TAIL << 32)) if single else np.searchsorted(y, x | LOWER, side="right")) - lo
    there = size > 0
    x, lo, size = x[there] & LOWER, lo[there], size[there]
    chunk = np.cumsum(size) // HITS
    for c in _distinct(chunk.copy()):
        own = np.flatnonzero(chunk == c)
        part = (_mixed(x[own]) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        own, part = own[order], part[order]
        pair = np.repeat(x[own] << np.uint64(32), size[own]) | (y[_spread(lo[own], size[own])] & LOWER)
        start = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        ends = np.cumsum(size[own])
        yield part[start], [p.tobytes() for p in np.split(pair, ends[start[1:] - 1])]


def routes(plan: DataFrame, k: int, passes: int | None = None, bucket_keys: int = BUCKET) -> DataFrame:
    """(a, b): a superset of the pairs, a of the left and b of the right side of `planned`, where at least `least` of the
    distinct windows of the one with fewer of them stand in the other; kept in the shared folder."""
    spark = plan.sparkSession
    left, right = (x or 0 for x in plan.agg(F.sum(F.when(F.col("in_left"), F.length("seq"))), F.sum(F.when(F.col("in_right"), F.length("seq")))).first())
    passes = passes or max(1, min(MOST_PASSES, ceil((left + right) / PASS)))
    # a key fits into 32 bits beside its bucket
    buckets = max(parallelism(spark), ceil((left + right) * (1 + 1 / RUN) / bucket_keys / passes), ceil(2 ** width(k) * TAIL / 2**31 / passes))
    # meetings by chance, about: their number decides nothing but the number of tasks
    parts = max(parallelism(spark), ceil(2 / RUN * left * right / 3e8 / passes / HITS))

    def listed(this: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for part in _portions(batch):
                    yield from _posts(part, k, this, passes, buckets)

        return run

    def held(batches: Iterator[pd.DataFrame], by: list[str]) -> dict[tuple, bytearray]:
        out: dict[tuple, bytearray] = {}
        for batch in batches:
            for *key, data in zip(*[batch[c] for c in by], batch["data"], strict=True):
                out.setdefault(tuple(key), bytearray()).extend(data)
        return out

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        posts = held(batches, ["side", "kind", "high"])
        for side, y_high in [(s, h) for s, kind, h in posts if kind == 0]:
            y = _distinct(np.frombuffer(posts.pop((side, 0, y_high)), np.uint64))
            for other, kind, x_high in [p for p in posts if p[0] == 1 - side and p[1] > 0]:
                for part, data in _meet(np.frombuffer(posts[other, kind, x_high], np.uint64), y, kind > MOST_SHARE, parts):
                    yield pd.DataFrame({"part": part, "side": other, "kind": kind, "x_high": x_high, "y_high": y_high, "data": data})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = held(batches, ["side", "kind", "x_high", "y_high"])
        for side, kind, x_high, y_high in list(pairs):
            asked = (kind - 1) % MOST_SHARE + 1
            pair = np.frombuffer(pairs.pop((side, kind, x_high, y_high)), np.uint64)
            pair.sort()
            start = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
            number = np.diff(np.r_[start, len(pair)])
            pair, number = pair[start[number >= asked]], number[number >= asked]
            for i in range(0, len(pair), 1_000_000):
                own = pair[i : i + 1_000_000]
                x, y = (own >> np.uint64(32)).astype(np.int64) | (x_high << 32), (own & LOWER).astype(np.int64) | (y_high << 32)
                # what other passes may have below the number asked for is granted
                yield pd.DataFrame({"x": x, "y": y, "side": side, "asked": asked, "n": number[i : i + 1_000_000] - asked + 1})

    found = []
    for this in range(passes):
        posts = plan.mapInPandas(listed(this), "bucket int, side int, kind int, high bigint, data binary").repartitionById(buckets, "bucket")
        meetings = posts.mapInPandas(meet, "part int, side int, kind int, x_high bigint, y_high bigint, data binary").repartitionById(parts, "part")
        found.append(cut(meetings.mapInPandas(count, "x bigint, y bigint, side int, asked int, n bigint")))
        del posts, meetings
        freed(spark)
    met = plan.where("in_left").select(F.col("id").alias("x"), F.lit(0).alias("side"), F.abs("met").alias("met")).unionByName(plan.where("in_right").select(F.col("id").alias("x"), F.lit(1).alias("side"), F.abs("met").alias("met")))
    every = reduce(DataFrame.unionByName, found).groupBy("x", "y", "side", "asked").agg(F.sum("n").alias("n"))
    enough = every.join(merged(met), ["x", "side"]).where(F.col("n") >= F.col("met") - passes * (F.col("asked") - 1))
    first = F.col("side") == 0
    return cut(enough.select(F.when(first, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("b")).distinct())
