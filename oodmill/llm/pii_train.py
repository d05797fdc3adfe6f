"""Trains the tagger of pii.py: python -m oodmill.llm.pii_train DOCUMENTS.parquet [OUT.npz]; measures it on other
documents: python -m oodmill.llm.pii_train score DOCUMENTS.parquet OTHER.parquet [WEIGHTS.npz].

Labelled spans come from a bounded sample of documents (LABELLED_DOCS), labelled by the patterns and cue phrases
below, with names, streets and hosts partly replaced by invented ones so that the model learns their surroundings
and shapes rather than the words. Digits share one id, so numbers cannot be learned by heart.
"""

from __future__ import annotations

import re
import sys
from collections import Counter

import numpy as np

from oodmill.llm.pii import _EMAIL, BARRED, BARRED_START, PAD, SHUT, STATES, STEP, TYPES, VOCABULARY, WEIGHTS, WINDOW, Tagger, encode, find, load, segments

LABELLED_DOCS = 10_000
HIDDEN, BATCH, EPOCHS, RATE, SEED = 28, 64, 28, 8e-3, 9

UP = "A-ZÀ-Þ"
W = rf"[{UP}][\w'’-]+"
PHONE = re.compile(
    r"(?<![\w-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,5}(?:[ .-]?\d{2,6}){1,5}|0044 \d{4} \d{6}|\(\d{3,5}\) ?\d{3}[ -]\d{3,4}|0\d{4} \d{6}|\d{3}-\d{3}-\d{4}"
    r"|\d{3}-\d{4} ext\. \d{2,4}|1\d{10})(?![\w-])"
)
ID = re.compile(
    r"(?:passport(?: no\.?)?|id card number|social security no\.|SSN|tax id|national id:?|Steuer-ID|DNI|NI number|NIE|NIF)\s*:?\s*"
    r"((?:[A-Z]{1,2} ?)?\d[\d -]*\d(?:[ -]?[A-Z]\b)?)"
)
KIND = r"(?:Road|Street|St|Ave\.|Lane|Close|Court|Way|Drive|Terrace)"
TOWN = rf"[{UP}][\w-]+(?: [{UP}][\w-]+)?"
STREETS = [
    re.compile(rf"\d{{1,4}}[A-D]? (?:[{UP}][\w-]+ ){{1,3}}{KIND}(?:, Unit \d+)?(?:,\s|\n){TOWN}(?: (?:\d{{5}}|[A-Z]{{1,2}}\d{{1,2}} \d[A-Z]{{2}}))?"),
    re.compile(rf"\d{{1,4}} (?:rue|quai|avenue|place|boulevard) [\w' -]+?, \d{{5}} {TOWN}"),
    re.compile(rf"(?:Calle|Avenida|Plaza|Paseo) [\w ]+? \d{{1,4}}(?:, \d{{1,2}}º [A-Z])?, \d{{5}} {TOWN}"),
    re.compile(rf"(?:Am [{UP}]\w+|[{UP}]\w+(?:gasse|weg|straße|platz|allee)) \d{{1,4}}, \d{{5}} {TOWN}"),
]
CUE = re.compile(rf"(?:Name: |mounted by |Frau |Depositor: |Antragsteller: |Depositante: |Déposant : |ask for |Contact |beam time of |Dr\. |Prof\. )({W}) ({W})")
EPONYM = re.compile(rf"\bthe ({W}) (?:buffer|equation|plot|correction|assay|method|test|model|diagram|law)\b")


def name_words(texts: list[str]) -> tuple[set[str], set[str]]:
    first, last = Counter(), Counter()
    for t in texts:
        for a, b in CUE.findall(t):
            first[a.lower()] += 1
            for p in b.lower().split("-"):
                last[p] += 1
    return {w for w, n in first.items() if n >= 4}, {w for w, n in last.items() if n >= 4}


def name_pattern(first: set[str], last: set[str]) -> re.Pattern:
    f = "(?:" + "|".join(sorted(map(re.escape, first), key=len, reverse=True)) + ")"
    one = "(?:" + "|".join(sorted(map(re.escape, last), key=len, reverse=True)) + ")"
    double = rf"{one}(?:-{one}){{0,2}}"
    initial = r"[a-zà-þ]\."
    whole = rf"{f}(?: {initial})? {double}|{double}, (?:{f}|{initial})|{initial} ?(?:{initial} ?)?{double}|{f} {initial}"
    return re.compile(rf"(?<![\w@.+-])(?:{whole})(?![\w@+])", re.I)


def label(text: str, names: re.Pattern) -> list[tuple[int, int, int]]:
    spans: list[tuple[int, int, int]] = []

    def put(a: int, b: int, kind: str) -> None:
        if all(b <= s or a >= e for s, e, _ in spans):
            spans.append((a, b, TYPES.index(kind)))

    for m in _EMAIL.finditer(text):
        put(m.start(), m.end(), "email")
    for p in STREETS:
        for m in p.finditer(text):
            put(m.start(), m.end(), "address")
    for m in ID.finditer(text):
        put(m.start(1), m.end(1), "id_number")
    for m in PHONE.finditer(text):
        if not re.search(r"(?:no\.|lot|ref\.|DOI|PX-)\s*$", text[max(0, m.start() - 8) : m.start()]):
            put(m.start(), m.end(), "phone")
    for m in re.finditer(rf"Contacter M\. ({names.pattern})", text, re.I):
        put(m.start(1), m.end(1), "name")
    for m in names.finditer(text):
        # M. is a title after this verb, an initial elsewhere
        titled = text[: m.start()].endswith("Contacter ") and m.group()[:3] == "M. "
        put(m.start() + 3 * titled, m.end(), "name")
    out = []
    for a, b, k in sorted(spans):
        while not text[a].isalnum():
            a += 1
        out.append((a, b, k))
    return out


class Inventor:
    """Invented words in place of names, streets and hosts."""

    ON = "b c d f g h j k l m n p r s t v w z br ch cl cr dr fl gr kr pl sch sh st str th tr".split()
    VO = "a e i o u a e i o u ai ei ou ia y ä é ö ü á ño".split()
    CO = ["", "", "n", "r", "s", "l", "m", "t", "ck", "nd", "rt", "th", "x", "ng"]

    def __init__(self, rng: np.random.Generator):
        self.rng = rng

    def word(self) -> str:
        pick = lambda xs: xs[self.rng.integers(len(xs))]
        return "".join(pick(self.ON) + pick(self.VO) + pick(self.CO) for _ in range(self.rng.integers(1, 4))).capitalize()

    def like(self, w: str) -> str:
        new = "-".join(self.word() for _ in w.split("-"))
        if "'" in w or self.rng.random() < 0.03:
            new = "O'" + new
        return new.upper() if w.isupper() and len(w) > 2 else new

    def mention(self, old: str, kind: int) -> str:
        name = TYPES[kind]
        if name == "name":
            new = re.sub(r"[^\W\d_][\w'’]+(?:-[^\W\d_][\w'’]+)*", lambda m: self.like(m.group()), old)
            if self.rng.random() < 0.08:  # texts that were read in the wrong encoding
                new = new.replace("a", "Ã¤", 1)
            return new
        if name == "address":
            keep = re.compile(rf"^(?:{KIND}|Unit|rue|quai|avenue|place|boulevard|des|du|de|la|del|Calle|Avenida|Plaza|Am)$")
            return re.sub(r"[^\W\d_]{3,}", lambda m: m.group() if keep.match(m.group()) else self.like(m.group()).replace("'", "").lower() if m.group().islower() else self.like(m.group()).replace("'", ""), old)
        if name == "email":
            new = re.sub(r"(?<![\[(])\b(?!at\b|dot\b)[A-Za-z]{4,}", lambda m: re.sub(r"[^a-z]", "", self.word().lower()) or "ab", old)
            return new.upper() if old.isupper() else new
        return old


def varied(text: str, spans: list[tuple[int, int, int]], invent: Inventor, share: float) -> tuple[str, list[tuple[int, int, int]]]:
    out, new, at = "", [], 0
    for a, b, k in spans:
        out += text[at:a]
        mention = invent.mention(text[a:b], k) if invent.rng.random() < share else text[a:b]
        new.append((len(out), len(out) + len(mention), k))
        out += mention
        at = b
    return out + text[at:], new


def examples(texts: list[str], names: re.Pattern, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    """Windows and their states: every segment with a mention, in two versions, and as many without, look-alikes first."""
    invent = Inventor(rng)
    full, decoys, plain = [], [], []
    for t in texts:
        spans = label(t, names)
        for a, b in segments(t):
            own = [(s - a, e - a, k) for s, e, k in spans if s >= a and e <= b]
            piece = t[a:b]
            if own:
                full += [(piece, own), varied(piece, own, invent, 0.8), varied(piece, own, invent, 0.5)]
                if rng.random() < 0.1:
                    full.append((piece.lower(), own))
            elif EPONYM.search(piece) or re.search(r"atalogue no|ref\. PX|DOI|overs residues", piece):
                decoys.append((re.sub(EPONYM, lambda m: m.group().replace(m.group(1), invent.like(m.group(1))) if rng.random() < 0.5 else m.group(), piece), []))
            else:
                plain.append((piece, []))
    rng.shuffle(decoys)
    rng.shuffle(plain)
    out = []
    plain = [(p.upper() if rng.random() < 0.06 else p, o) for p, o in plain[: len(full) * 2 // 3]]
    for piece, own in full + decoys[: len(full) // 4] + plain:
        ids, states = encode(piece), np.zeros(len(piece), np.int64)
        for s, e, k in own:
            states[s], states[s + 1 : e] = 2 * k + 1, 2 * k + 2
        for lo in range(0, max(1, len(ids) - 64), 192):
            out.append((ids[lo : lo + WINDOW], states[lo : lo + WINDOW]))
    return out


def shifted(ids: np.ndarray, states: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The window without its first few characters, so that mentions begin at every place of a step."""
    n = int(rng.integers(0, STEP))
    return (ids, states) if len(ids) <= n or states[: n + 1].any() else (ids[n:], states[n:])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Trainer:
    """Both directions read STEP characters a step; the CRF is over single characters."""

    def __init__(self, rng: np.random.Generator, h: int = HIDDEN):
        self.h = h
        r = lambda *s, k=0.1: (rng.standard_normal(s) * k).astype(np.float32)
        self.p = {"bias": np.zeros(STATES, np.float32), "trans": r(STATES, STATES), "start": r(STATES)}
        for d in "fb":
            self.p |= {f"w{d}{i}": r(VOCABULARY, 4 * h, k=0.3) for i in range(STEP)}
            self.p |= {f"u{d}": r(h, 4 * h, k=1 / np.sqrt(h)), f"b{d}": np.zeros(4 * h, np.float32), f"o{d}": r(h, STEP * STATES, k=0.3)}
            self.p[f"b{d}"][h : 2 * h] = 1.0
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.step = 0

    def _forward(self, chars: list[np.ndarray], d: str) -> tuple[np.ndarray, list]:
        t, b = chars[0].shape
        h = self.h
        hid, cell = np.zeros((b, h), np.float32), np.zeros((b, h), np.float32)
        hs, tape = np.empty((t, b, h), np.float32), [None] * t
        inputs = sum(self.p[f"w{d}{i}"][c] for i, c in enumerate(chars)) + self.p[f"b{d}"]
        inputs[(chars[0] == PAD) & (chars[1] == PAD), :h] = SHUT
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            g = inputs[i] + hid @ self.p[f"u{d}"]
            s, c = _sigmoid(g[:, : 3 * h]), np.tanh(g[:, 3 * h :])
            new = s[:, h : 2 * h] * cell + s[:, :h] * c
            th = np.tanh(new)
            tape[i] = (hid, cell, s, c, th)
            hid, cell = s[:, 2 * h :] * th, new
            hs[i] = hid
        return hs, tape

    def _backward(self, chars: list[np.ndarray], d: str, tape: list, dhs: np.ndarray, grad: dict) -> None:
        t, b = chars[0].shape
        h = self.h
        dh, dc = np.zeros((b, h), np.float32), np.zeros((b, h), np.float32)
        dgs = np.empty((t, b, 4 * h), np.float32)
        for i in range(t - 1, -1, -1) if d == "f" else range(t):
            hid, cell, s, c, th = tape[i]
            dh += dhs[i]
            si, sf, so = s[:, :h], s[:, h : 2 * h], s[:, 2 * h :]
            dc += dh * so * (1 - th * th)
            dg = dgs[i]
            dg[:, :h] = dc * c * si * (1 - si)
            dg[:, h : 2 * h] = dc * cell * sf * (1 - sf)
            dg[:, 2 * h : 3 * h] = dh * th * so * (1 - so)
            dg[:, 3 * h :] = dc * si * (1 - c * c)
            grad[f"u{d}"] += hid.T @ dg
            dc = dc * sf
            dh = dg @ self.p[f"u{d}"].T
        dgs[(chars[0] == PAD) & (chars[1] == PAD)] = 0.0
        flat = dgs.reshape(-1, 4 * h)
        for i, ids in enumerate(chars):
            one = np.zeros((VOCABULARY, t * b), np.float32)
            one[ids.reshape(-1), np.arange(t * b)] = 1
            grad[f"w{d}{i}"] += one @ flat
        grad[f"b{d}"] += flat.sum(0)

    def batch(self, data: list[tuple[np.ndarray, np.ndarray]], rate: float) -> float:
        p, h = self.p, self.h
        b, t = len(data), -(-max(len(x) for x, _ in data) // STEP) * STEP
        size = np.array([len(x) for x, _ in data])
        ids, gold = np.full((t, b), PAD, np.int64), np.zeros((t, b), np.int64)
        for j, (x, y) in enumerate(data):
            ids[: len(x), j], gold[: len(x), j] = x, y
        mask = np.arange(t)[:, None] < size[None]
        chars = [ids[i::STEP] for i in range(STEP)]
        hf, tf = self._forward(chars, "f")
        hb, tb = self._forward(chars, "b")
        score = (hf @ p["of"] + hb @ p["ob"]).reshape(t // STEP, b, STEP, STATES).transpose(0, 2, 1, 3).reshape(t, b, STATES) + p["bias"]
        # forward-backward over the CRF, scaled at each character
        top = score.max(2).astype(np.float64)
        emit = np.exp(score - top[:, :, None])
        trans, start = p["trans"].astype(np.float64) + BARRED, p["start"].astype(np.float64) + BARRED_START
        move = np.exp(trans)
        alpha, scale = np.empty((t, b, STATES)), np.ones((t, b))
        for i in range(t):
            a = (np.exp(start) if i == 0 else alpha[i - 1] @ move) * emit[i]
            live = mask[i]
            scale[i] = np.where(live, a.sum(1), 1.0)
            alpha[i] = np.where(live[:, None], a / scale[i][:, None], alpha[i - 1] if i else a)
        log_z = (np.log(scale) + np.where(mask, top, 0.0)).sum(0)
        beta = np.ones((t, b, STATES))
        d_trans = np.zeros((STATES, STATES))
        for i in range(t - 2, -1, -1):
            live = mask[i + 1]
            ahead = emit[i + 1] * beta[i + 1] / scale[i + 1][:, None]
            beta[i] = np.where(live[:, None], ahead @ move.T, 1.0)
            d_trans += alpha[i][live].T @ ahead[live] * move
        post = alpha * beta * mask[:, :, None]
        gold_score = start[gold[0]] + (np.take_along_axis(score, gold[:, :, None], 2)[:, :, 0] * mask).sum(0)
        gold_score = gold_score + (trans[gold[:-1], gold[1:]] * mask[1:]).sum(0)
        loss = float((log_z - gold_score).sum() / b)
        ds = post
        np.put_along_axis(ds, gold[:, :, None], np.take_along_axis(ds, gold[:, :, None], 2) - 1, 2)
        ds = (ds * mask[:, :, None] / b).astype(np.float32)
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        np.subtract.at(d_trans, (gold[:-1][mask[1:]], gold[1:][mask[1:]]), 1)
        grad["trans"] = (d_trans / b).astype(np.float32)
        grad["start"] = ds[0].sum(0)
        grad["bias"] = ds.reshape(-1, STATES).sum(0)
        two = ds.reshape(t // STEP, STEP, b, STATES).transpose(0, 2, 1, 3).reshape(-1, STEP * STATES)
        grad["of"] = hf.reshape(-1, h).T @ two
        grad["ob"] = hb.reshape(-1, h).T @ two
        self._backward(chars, "f", tf, (two @ p["of"].T).reshape(t // STEP, b, h), grad)
        self._backward(chars, "b", tb, (two @ p["ob"].T).reshape(t // STEP, b, h), grad)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        self.step += 1
        for k, g in grad.items():
            g = g * min(1.0, 5.0 / (norm + 1e-9))
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.99 * self.v[k] + 0.01 * g * g
            p[k] -= rate * (self.m[k] / (1 - 0.9**self.step)) / (np.sqrt(self.v[k] / (1 - 0.99**self.step)) + 1e-8)
        return loss


def score_on(tagger: Tagger, texts: list[str], names: re.Pattern) -> dict[str, tuple[int, int, int]]:
    """Per type: found and right, found, and there, against the labels; a mention is right if start and type are."""
    out = {k: [0, 0, 0] for k in TYPES}
    memo: dict = {}
    for lo in range(0, len(texts), 500):
        part = texts[lo : lo + 500]
        for t, got in zip(part, find(tagger, part, memo), strict=True):
            have = {(s, k) for s, _, k in got}
            want = {(s, TYPES[k]) for s, _, k in label(t, names)}
            for s, k in have:
                out[k][1] += 1
                out[k][0] += (s, k) in want
            for _, k in want:
                out[k][2] += 1
    return {k: tuple(v) for k, v in out.items()}


def _texts(path: str) -> list[str]:
    import pyarrow.dataset as ds

    return [t for t in ds.dataset(path).to_table(columns=["text"])["text"].to_pylist() if t]


def score(path: str, other: str, weights: str = str(WEIGHTS)) -> None:
    """Prints score_on of all texts of `other`; the labels take their names from the training texts."""
    print(score_on(Tagger(load(weights)), _texts(other), name_pattern(*name_words(_texts(path)[:LABELLED_DOCS]))))


def main(path: str, out: str = str(WEIGHTS)) -> None:
    texts = _texts(path)[:LABELLED_DOCS]
    names = name_pattern(*name_words(texts))
    rng = np.random.default_rng(SEED)
    held = [t for i, t in enumerate(texts) if i % 10 == 0]
    data = examples([t for i, t in enumerate(texts) if i % 10], names, rng)
    print(len(data), "windows")
    trainer = Trainer(rng)
    per = len(data) // BATCH
    for epoch in range(EPOCHS):
        data.sort(key=lambda d: len(d[0]) + rng.random() * 24)
        starts = rng.permutation(per) * BATCH
        losses = []
        for i, s in enumerate(starts):
            at = (epoch * per + i) / (EPOCHS * per)
            losses.append(trainer.batch([shifted(*d, rng) for d in data[s : s + BATCH]], RATE * min(1.0, 20 * at + 0.05) * (1 - at) ** 0.9 + 1e-5))
        tagger = Tagger(trainer.p)
        print(epoch, round(float(np.mean(losses)), 4), score_on(tagger, held, names), flush=True)
        np.savez_compressed(out, **{k: v.astype(np.float16) for k, v in trainer.p.items()})


if __name__ == "__main__":
    score(*sys.argv[2:]) if sys.argv[1] == "score" else main(*sys.argv[1:])
