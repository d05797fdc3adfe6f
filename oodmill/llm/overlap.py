"""Same or near-same records across splits: training streamed through compressed indexes of the evaluation shards it meets."""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oodmill.llm import routes
from oodmill.session import cut, merged, parallelism

SORTED = 12  # letters by which suffixes are ordered: 12 letters of 5 bits fill a 60-bit key
SIGMA = 27
HELD = 4  # letters of the patterns whose intervals are kept


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values. Sorting in place beats numpy's hashing unique many times over on millions of numbers."""
    values.sort()
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


class FullTextIndex:
    """Burrows-Wheeler index of many sequences, suffixes ordered by their first SORTED letters.

    Intervals of patterns shorter than SORTED are exact in such an order. Ranks come from one bitmap a letter with
    sampled counts, about five bytes a letter of text. The intervals of all patterns of HELD letters are searched once,
    so longer ones go on from there.
    """

    def __init__(self, seqs: list[str]):
        text = np.frombuffer("@".join([*seqs, ""]).encode("ascii"), np.uint8).astype(np.int64) - 64
        n = len(text)
        key = np.zeros(n, np.int64)
        padded = np.concatenate([text, np.zeros(SORTED, np.int64)])
        for i in range(SORTED):
            key = (key << 5) | padded[i : i + n]
        self.suffix = np.argsort(key, kind="stable").astype(np.int32)
        del key, padded
        bwt = text[self.suffix - 1].astype(np.uint8)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=SIGMA))]).astype(np.int64)
        words = n // 64 + 1
        self.bits = np.zeros((SIGMA, words), np.uint64)
        self.count = np.zeros((SIGMA, words + 1), np.int32)
        for c in range(1, SIGMA):
            flags = np.zeros(words * 64, np.uint8)
            flags[:n] = bwt == c
            self.bits[c] = np.packbits(flags, bitorder="little").view(np.uint64)
            self.count[c, 1:] = np.cumsum(np.bitwise_count(self.bits[c]))
        ends = np.cumsum([len(s) + 1 for s in seqs])
        self.owner = np.searchsorted(ends, self.suffix, side="right").astype(np.int32)
        self.size = n
        lo, hi = np.zeros(1, np.int64), np.full(1, n, np.int64)
        for length in range(1, HELD + 1):
            lo, hi = self._step(np.repeat(np.arange(1, SIGMA), 26 ** (length - 1)), np.tile(lo, 26), np.tile(hi, 26))
        self.held = lo, hi

    def rank(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        low = self.bits[c, word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.count[c, word] + np.bitwise_count(low)

    def _step(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with the letters c put in front."""
        return self.first[c] + self.rank(c, lo), self.first[c] + self.rank(c, hi)

    def intervals(self, codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Interval of each pattern (base-26 code of k letters, at least HELD) by backward search."""
        tail = codes % 26**HELD
        lo, hi = self.held[0][tail], self.held[1][tail]
        for length in range(HELD, k):
            lo, hi = self._step(codes // 26**length % 26 + 1, lo, hi)
        return lo, hi


def _windows(seqs: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, code) of the distinct k-letter windows of each sequence, ordered by sequence."""
    text = np.frombuffer("".join(seqs).encode("ascii"), np.uint8).astype(np.int64) - 65
    sizes = np.array([len(s) for s in seqs], np.int64)
    owner = np.repeat(np.arange(len(seqs)), sizes)
    n = len(text) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code = text[:n].copy()
    for i in range(1, k):
        code = code * 26 + text[i : n + i]
    inside = owner[:n] == owner[k - 1 :]
    both = distinct(owner[:n][inside] * 26**k + code[inside])
    return both // 26**k, both % 26**k


def maximal_matches(a: str, b: str, k: int) -> tuple[int, int, int]:
    """(letters of a in matches, longest match, matches) of the stretches of k letters and more that both have and that
    cannot be grown to either side. Windows seen in both grow along their diagonal."""
    x, y = (_codes(s, k) for s in (a, b))
    order = np.argsort(y, kind="stable")
    lo, hi = np.searchsorted(y[order], x), np.searchsorted(y[order], x, side="right")
    size = hi - lo
    i = np.repeat(np.arange(len(x)), size)
    j = order[np.repeat(lo - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())] if len(i) else i
    if not len(i):
        return 0, 0, 0
    by = np.lexsort((i, i - j))
    i, d = i[by], (i - j)[by]
    start = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (i[1:] != i[:-1] + 1)])
    length = np.diff(np.r_[start, len(i)]) + k - 1
    edge = np.zeros(len(a) + 1, np.int64)
    np.add.at(edge, i[start], 1)
    np.add.at(edge, i[start] + length, -1)
    return int((np.cumsum(edge) > 0).sum()), int(length.max()), len(start)


def _codes(s: str, k: int) -> np.ndarray:
    text = np.frombuffer(s.encode("ascii"), np.uint8).astype(np.int64) - 65
    n = len(text) - k + 1
    code = text[:n].copy()
    for i in range(1, k):
        code = code * 26 + text[i : n + i]
    return code


def _first_of(owner: np.ndarray, weight: np.ndarray, size: np.ndarray, take: np.ndarray) -> np.ndarray:
    """Mask of the `take` entries of least weight of each owner; entries are grouped by owner, of `size` each."""
    order = np.argsort((owner << np.int64(32)) | np.minimum(weight, 2**31), kind="stable")
    start = np.r_[0, np.cumsum(size)[:-1]]
    out = np.zeros(len(owner), bool)
    out[order] = np.arange(len(owner)) - start[owner[order]] < take[owner[order]]
    return out


class Shard:
    """Index of one shard of evaluation sequences, and their rarest windows.

    Two sequences are alike if the shorter shares at least `least` of its n distinct windows, s of them. Then of its
    n - s + m rarest at least m are shared, whatever the order of rarity. The order here is the number of places in the
    shard, so windows that the shard lacks come first, and a training sequence from elsewhere meets nothing. m is up to
    4, so chance meetings of single windows go no further.
    """

    def __init__(self, seqs: list[str], k: int, least: float):
        self.seqs, self.k, self.least = seqs, k, least
        self.index = FullTextIndex(seqs)
        self.owner, self.code = _windows(seqs, k)
        self.n = np.bincount(self.owner, minlength=len(seqs))
        self.key = self.owner * 26**k + self.code
        lo, hi = self.index.intervals(self.code, k)
        take, self.meet = self.quota(self.n)
        rare = _first_of(self.owner, hi - lo, self.n, take)
        # the places of rare windows, in the order of the index, each window of a sequence once
        size = (hi - lo)[rare]
        at = np.repeat(lo[rare] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        own = self.index.owner[at] == np.repeat(self.owner[rare], size)
        at, window = at[own], np.repeat(np.flatnonzero(rare), size)[own]
        once = np.r_[True, window[1:] != window[:-1]] if len(window) else np.empty(0, bool)
        self.marked = distinct(at[once])

    def quota(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rarest windows to look at, how many of them must be shared) of a sequence of n windows that is the shorter."""
        need = np.ceil(self.least * n - 1e-9).astype(np.int64)
        meet = np.clip(need, 1, 4)
        return n - need + meet, meet

    def candidates(self, owner: np.ndarray, code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(training, evaluation) pairs that share enough of the rarest windows of the shorter of them."""
        lo, hi = self.index.intervals(code, self.k)
        take, meet = self.quota(n)
        out = []
        e = len(self.seqs)
        # training sequence shorter or equal: its rarest windows against all places; evaluation sequence shorter: all
        # windows against its marked places
        mark_lo, mark_hi = np.searchsorted(self.marked, lo), np.searchsorted(self.marked, hi)
        for rare, a, b, places in ((_first_of(owner, hi - lo, n, take), lo, hi, None), (hi > lo, mark_lo, mark_hi, self.marked)):
            size = (b - a)[rare]
            at = np.repeat(a[rare] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            window = np.repeat(np.flatnonzero(rare), size)
            who = self.index.owner[at if places is None else places[at]]
            # a window that an evaluation sequence has twice counts once
            once = distinct(window * e + who)
            pair = owner[once // e] * e + once % e
            pair.sort()
            start = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else np.empty(0, np.int64)
            met = np.diff(np.r_[start, len(pair)])
            t, v = pair[start] // e, pair[start] % e
            short = n[t] <= self.n[v]
            out.append(pair[start][short & (met >= meet[t]) if places is None else ~short & (met >= self.meet[v])])
        pair = distinct(np.concatenate(out))
        return pair // e, pair % e

    def shared(self, t: np.ndarray, e: np.ndarray, code: np.ndarray, n: np.ndarray, pairs_at_once: int = 4096) -> np.ndarray:
        """Exact numbers of shared windows of pairs."""
        out = np.zeros(len(t), np.int64)
        begin = np.r_[0, np.cumsum(n)[:-1]]
        for lo in range(0, len(t), pairs_at_once):
            x, y = t[lo : lo + pairs_at_once], e[lo : lo + pairs_at_once]
            size = n[x]
            window = np.repeat(begin[x] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            key = np.repeat(y, size) * 26**self.k + code[window]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            out[lo : lo + len(x)] = np.add.reduceat((self.key[at] == key).astype(np.int64), np.r_[0, np.cumsum(size)[:-1]])
        return out


def search_block(train: pd.DataFrame, shard: pd.DataFrame, k: int, least: float, letters_at_once: int = 1_000_000) -> pd.DataFrame:
    """Pairs of a block of training classes and a shard of evaluation classes that share enough windows. The shard is
    indexed once, the block streamed past it in parts."""
    out: list[pd.DataFrame] = []
    if len(train) and len(shard):
        evals = Shard(list(shard["eval_seq"]), k, least)
        names, classes = train["train_class"].to_numpy(), shard["eval_class"].to_numpy()
        every = list(train["train_seq"])
        part = np.cumsum([0, *map(len, every)])[:-1] // letters_at_once
        for p in range(int(part[-1]) + 1):
            own = np.flatnonzero(part == p)
            seqs = [every[i] for i in own]
            if not seqs:
                continue
            owner, code = _windows(seqs, k)
            n = np.bincount(owner, minlength=len(seqs))
            t, e = evals.candidates(owner, code, n)
            shared = evals.shared(t, e, code, n)
            keep = shared >= least * np.minimum(n[t], evals.n[e]) - 1e-9
            t, e, shared = t[keep], e[keep], shared[keep]
            grown = np.array([maximal_matches(seqs[x], evals.seqs[y], k) for x, y in zip(t, e, strict=True)], np.int64).reshape(-1, 3)
            out.append(
                pd.DataFrame(
                    {
                        "train_class": names[own[t]], "eval_class": classes[e], "shared": shared, "containment": shared / np.minimum(n[t], evals.n[e]),
                        "covered": grown[:, 0], "longest": grown[:, 1], "matches": grown[:, 2],
                    }
                )
            )
    return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype=t) for c, t in FOUND.items()})


FOUND = {"train_class": "int64", "eval_class": "int64", "shared": "int64", "containment": "float64", "covered": "int64", "longest": "int64", "matches": "int64"}


def handed_out(plan: DataFrame, k: int, shard_letters: int, block_letters: int) -> tuple[DataFrame, DataFrame, int]:
    """(training sequences by shard and block, evaluation sequences by shard and block, number of both): training goes only
    to the shards where it meets a sequence, and only evaluation sequences that are met are indexed."""
    spark = plan.sparkSession
    pairs = routes.routes(plan, k).select(F.col("a").alias("train_class"), F.col("b").alias("eval_class"))
    seqs = lambda side, c: plan.where(side).select(F.col("id").alias(c), "seq")
    size = lambda d, side, c: d.join(merged(plan.where(side).select(F.col("id").alias(c), F.length("seq").alias("n"))), c).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    evals = pairs.select("eval_class").distinct()
    letters = size(evals, "in_right", "eval_class")
    shards = max(1, ceil(letters / shard_letters), min(ceil(letters / 250_000), parallelism(spark)))
    trains = pairs.select("train_class", deal("eval_class", shards).alias("train_shard")).distinct()
    blocks = max(1, ceil(size(trains, "in_left", "train_class") / shards / block_letters))
    left = trains.join(merged(seqs("in_left", "train_class")), "train_class").select("train_class", F.col("seq").alias("train_seq"), "train_shard", deal("train_class", blocks).alias("train_block"))
    every = F.explode(F.array(*[F.lit(i) for i in range(blocks)])).alias("eval_block")
    right = evals.join(merged(seqs("in_right", "eval_class")), "eval_class").select("eval_class", F.col("seq").alias("eval_seq"), every, deal("eval_class", shards).alias("eval_shard"))
    return left, right, shards * blocks


def _searched(plan: DataFrame, k: int, least: float, shard_letters: int, block_letters: int) -> DataFrame:
    left, right, tasks = handed_out(plan, k, shard_letters, block_letters)
    schema = "train_class bigint, eval_class bigint, shared bigint, containment double, covered bigint, longest bigint, matches bigint"
    # a stated number of partitions is not coalesced: one task a shard and block, as far as hashing allows
    left, right = left.repartition(2 * tasks, "train_shard", "train_block"), right.repartition(2 * tasks, "eval_shard", "eval_block")
    both = left.groupBy("train_shard", "train_block").cogroup(right.groupBy("eval_shard", "eval_block"))
    return both.applyInPandas(lambda a, b: search_block(a, b, k, least), schema)


def planned_sides(train: DataFrame, held_out: DataFrame, k: int, least: float) -> DataFrame:
    side = lambda d, left: d.select(F.col("class_id").alias("id"), "seq", F.lit(left).alias("in_left"), F.lit(not left).alias("in_right"))
    both = side(train, True).unionByName(side(held_out, False))
    return routes.planned(both, both.select("id", "seq"), k, least)


def alike_across(
    train: DataFrame, held_out: DataFrame, k: int = 5, least: float = 0.8, shard_letters: int = 4_000_000, block_letters: int = 16_000_000
) -> DataFrame:
    """Pairs (train_class, eval_class, shared, containment, covered, longest, matches) of distinct sequences, where at least
    `least` of the distinct k-letter windows of the sequence with fewer of them occur in the other.

    Both inputs: class_id, seq (upper-case letters). Sequences that meet on stretches (`routes`) are brought together:
    evaluation classes are dealt to shards of bounded size, and each task indexes one shard and streams past it, by
    backward search, the training classes that meet something there. This is exact: no true pair misses the other's
    shard, and every window hit is located and counted. covered and longest describe the merged spans in the training
    sequence. Sequences shorter than k have no window and no pair.
    """
    return _searched(planned_sides(train, held_out, k, least), k, least, shard_letters, block_letters)


def cross_split_pairs(df: DataFrame, row: str, ident: Column, seq: Column, split: Column, k: int = 5, least: float = 0.8, shard_letters: int = 4_000_000, block_letters: int = 16_000_000) -> DataFrame:
    """(train_row, eval_row, same_id, containment, covered, longest, matches): records of train found again in val or test.

    ident and seq come cleaned (NULL where there is none); split is one of train, val, test, else the row is no
    case. A pair is found by equal ident or by its sequences; fields that do not apply are NULL. Repeated rows are
    rows; an empty table gives no pair. df is read several times, so it should be a table or cut: sequences are kept
    once in the shared folder, one a class, and rows only with their class.
    """
    base = df.select(F.col(f"`{row}`").alias("row_id"), ident.alias("ident"), seq.alias("seq"), split.alias("split")).where("split in ('train', 'val', 'test')")
    texts = base.where("seq is not null")
    classes = texts.groupBy("seq").agg(F.min("row_id").alias("id"), F.max(F.col("split") == "train").alias("in_left"), F.max(F.col("split") != "train").alias("in_right"))
    plan = routes.planned(classes, texts.select(F.col("row_id").alias("id"), "seq"), k, least)
    # rows without a sequence meet nothing, each on a key of its own
    keyed = base.select("row_id", "ident", "split", F.coalesce("seq", F.col("row_id").cast("string")).alias("seq"))
    members = cut(keyed.join(merged(plan.select("seq", "id")), "seq", "left").select("id", "row_id", "ident", "split"))
    routes.freed(df.sparkSession)
    found = _searched(plan, k, least, shard_letters, block_letters)
    train, held = members.where("split = 'train'").withColumnRenamed("row_id", "train_row"), members.where("split <> 'train'").withColumnRenamed("row_id", "eval_row")
    same = train.where("ident is not null").select("ident", "train_row").join(merged(held.where("ident is not null").select("ident", "eval_row")), "ident")
    member = lambda side, c, r: side.where("id is not null").select(F.col("id").alias(c), r)
    alike = found.join(merged(member(train, "train_class", "train_row")), "train_class").join(merged(member(held, "eval_class", "eval_row")), "eval_class")
    both = same.select("train_row", "eval_row", F.lit(True).alias("same_id"), *[F.lit(None).cast(t).alias(c) for c, t in (("containment", "double"), ("covered", "bigint"), ("longest", "bigint"), ("matches", "bigint"))])
    rows = both.unionByName(alike.select("train_row", "eval_row", F.lit(False).alias("same_id"), "containment", "covered", "longest", "matches"))
    return rows.groupBy("train_row", "eval_row").agg(F.max("same_id").alias("same_id"), *[F.max(c).alias(c) for c in ("containment", "covered", "longest", "matches")])
