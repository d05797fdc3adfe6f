"""Filling fixed-capacity containers: neighbours along a Hilbert curve of hashed document vectors are packed together."""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oodmill.session import cut, spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public split pattern of the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
DIMS, BITS, BUCKETS = 3, 10, 4096


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The byte-level BPE of a vocabulary file of ranks; special tokens are ordinary text."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def hilbert_key(coords: np.ndarray, bits: int) -> np.ndarray:
    """Place of each point (rows of non-negative integers below 2**bits) on the Hilbert curve, axes made one key."""
    x = [coords[:, i].astype(np.int64).copy() for i in range(coords.shape[1])]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            on = (x[i] & q) > 0
            swap = (x[0] ^ x[i]) & low
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = np.where(on, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(len(coords), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[n - 1] & q) > 0, turn ^ (q - 1), turn)
        q >>= 1
    key = np.zeros(len(coords), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | (((x[i] ^ turn) >> b) & 1)
    return key


def _projection() -> np.ndarray:
    return np.random.default_rng(11).choice([-1.0, 1.0], (BUCKETS, DIMS)).astype(np.float32)


def curve_keys(tokens: list[np.ndarray]) -> np.ndarray:
    """Hilbert key of each document: hashed token counts, projected by random signs, scaled to unit spread."""
    table = _projection()
    sizes = np.array([len(t) for t in tokens], np.int64)
    sums = np.zeros((len(tokens), DIMS), np.float64)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.concatenate([tokens[i] for i in full]).astype(np.uint64)
        bucket = ((flat * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.int64)
        start = np.cumsum(np.r_[0, sizes[full][:-1]])
        sums[full] = np.add.reduceat(table[bucket].astype(np.float64), start, axis=0)
    scaled = sums / np.maximum(sizes, 1)[:, None] * 4.0  # mean sign times 4: most texts lie well inside (-1, 1)
    grid = np.clip(((np.tanh(scaled) + 1) / 2 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
    return hilbert_key(grid, BITS)


class Packer:
    """Best fit among containers left open near the same stretch of the curve.

    A window of pieces is held back and placed largest first, so later short texts fill what long ones leave. New
    containers are of the largest kind while the window holds enough to fill one, else of the smallest kind that holds
    what is left. Of the containers still open after a window, the `open_most` with most room stay open: this bounds
    the state of a task and costs only the room left in those closed, which at the sizes measured is below 0.1 % of all.
    A window is packed largest first, so containers hold neighbours on the curve as far apart as a window is long.
    """

    def __init__(self, kinds: list[tuple[str, int]], name: str, window: int, open_most: int = 64):
        self.kinds = sorted(kinds, key=lambda k: k[1])
        self.most = self.kinds[-1][1]
        self.name, self.window, self.open_most = name, window, open_most
        self.open: list[tuple[int, int]] = []  # (room, container)
        self.made: list[str] = []
        self.held: list[tuple[int, int, int]] = []
        self.held_tokens = 0

    def add(self, doc: int, size: int) -> Iterator[tuple]:
        for piece, start in enumerate(range(0, max(size, 1), self.most)):
            part = min(self.most, size - start)
            self.held.append((part, doc, piece))
            self.held_tokens += part
        if len(self.held) >= self.window:
            yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        for part, doc, piece in sorted(self.held, key=lambda h: (-h[0], h[1], h[2])):
            at = bisect_left(self.open, (part, -1))
            if at < len(self.open):
                room, box = self.open.pop(at)
            else:
                kind, room = next((k for k in self.kinds if k[1] >= self.held_tokens), self.kinds[-1])
                box = len(self.made)
                self.made.append(kind)
            if room > part:
                insort(self.open, (room - part, box))
            self.held_tokens -= part
            yield doc, piece, part, self.made[box], f"{self.name}-{box}"
        self.held = []
        if len(self.open) > self.open_most:
            self.open = self.open[-self.open_most :]


def pack(
    docs: DataFrame, doc: str, text: str, capacities: dict[str, int], vocabulary: str = VOCABULARY, tokens_per_task: int = 4_000_000, window: int = 2048
) -> DataFrame:
    """(doc_id, piece, tokens, container_kind, container_id): the container of each document.

    Sizes are in tokens of the byte-level BPE in `vocabulary`. No text is cut unless it is larger than the largest
    container; such a text is cut into full containers and a rest (piece 0, 1, ...). NULL and empty texts have size 0
    and are put like the others; equal texts lie side by side on the curve but keep rows of their own. Ranges of the
    curve are packed in parallel, each of about tokens_per_task, so the room lost at range ends does not depend on the
    number of documents. Documents of any number may share a curve place: doc_id completes the sort key.
    """
    kinds = [(k, int(c)) for k, c in capacities.items()]
    if not kinds or min(c for _, c in kinds) < 1:
        raise ValueError("capacities must be positive")
    spark = docs.sparkSession

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer(vocabulary)
        for batch in batches:
            ids = [np.array(bpe.encode_ordinary(t), np.int64) if t else np.empty(0, np.int64) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "tokens": [len(i) for i in ids], "curve": curve_keys(ids)})

    held = docs.select(F.col(f"`{doc}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    sized = cut(spread(held, "doc_id").mapInPandas(measure, "doc_id bigint, tokens bigint, curve bigint"))
    total = sized.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    ranges = int(total // tokens_per_task) + 1
    # a range is a partition; all are fixed in the shared folder before packing, so a task that runs again sees the same
    ranged = cut(sized.repartitionByRange(ranges, "curve", "doc_id").withColumn("range", F.spark_partition_id()))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = None
        done = lambda rows: pd.DataFrame(rows, columns=["doc_id", "piece", "tokens", "container_kind", "container_id"]).astype({"doc_id": "int64", "piece": "int32", "tokens": "int64"})
        for batch in batches:
            rows: list[tuple] = []
            for part, ident, size in zip(batch["range"], batch["doc_id"], batch["tokens"], strict=True):
                packer = packer or Packer(kinds, str(part), window)
                rows.extend(packer.add(int(ident), int(size)))
            yield done(rows)
        if packer:
            yield done(list(packer.flush()))

    # the partitions of the checkpoint are the ranges: sorting inside them moves nothing
    return ranged.sortWithinPartitions("curve", "doc_id").mapInPandas(fill, "doc_id bigint, piece int, tokens bigint, container_kind string, container_id string")
