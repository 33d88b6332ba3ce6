"""PII: fixed rules, and a character-level bidirectional LSTM with CRF transitions, trained in numpy from labelled spans.

Rules find e-mail addresses, IPv4 addresses, card numbers and phone numbers; the network adds what is written in other
ways. Every kind has a digit or an @ in it, so the network looks at the tiles of TILE characters with one of these and at
their neighbours, wherever they are in the text: all others can't hold a span of any kind. Each tile is read in a window
that reaches half a tile beyond it on both sides, so windows overlap; scores of a character are averaged over the windows
that hold it, and each stretch of tiles is decoded as one by Viterbi over the CRF, so spans cross tiles. A decoded span
counts if it has its kind's share of digits or an @ (see _plausible) and overlaps no span of the rules.

Labelled spans for training: at most SAMPLE documents, by a hash of their text, give the surroundings; spans of each kind
are written into them, in the rules' forms and in others (see _write), and so are numbers that are none: versions, dates,
prices, hexadecimal keys. The spans that the rules find in the same texts are labels too. The model is a few matrices.

Positions count code points. Defined cases: null text is empty and has no spans; ties sort by start, then by kind as
listed in KINDS; repeated rows and rows with a null id are scanned each by itself; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, hashed_sample, keyed_texts, small_batches

KINDS = ("email", "ip", "card", "phone")
TILE, MARGIN, HIDDEN, SAMPLE, WINDOWS, EPOCHS, BATCH, RATE, SEED = 32, 16, 16, 300, 4800, 6, 48, 0.02, 3
TAGS = 1 + 2 * len(KINDS)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches; each is found from its @, so a long run without one costs nothing."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the rules, in order."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m.group())) <= 15]
    return sorted(out)


# --- the network ---------------------------------------------------------------------------------------------------------


def _codes(text: str) -> np.ndarray:
    """Characters as 0 (before and after the text), 1 to 127, or 128 for all others."""
    c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.minimum(np.maximum(c, 1), 128).astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    def __init__(self, seed: int = SEED):
        rng, h = np.random.default_rng(seed), HIDDEN
        f = np.float32
        self.p = {}
        for d in "fb":
            self.p["x" + d] = rng.normal(0, 0.3, (129, 4 * h)).astype(f)
            self.p["x" + d][:, h : 2 * h] += 1  # forget gates begin open
            self.p["h" + d] = rng.normal(0, 1 / np.sqrt(h), (h, 4 * h)).astype(f)
        self.p["o"] = rng.normal(0, 0.3, (2 * h, TAGS)).astype(f)
        self.p["ob"] = np.zeros(TAGS, f)
        self.p["t"] = rng.normal(0, 0.1, (TAGS, TAGS)).astype(f)

    def _lstm(self, x: np.ndarray, d: str, keep: bool = False):
        """x: steps by rows. Outputs of each step, and what training needs."""
        h, n = HIDDEN, x.shape[1]
        out = np.zeros((len(x), n, h), np.float32)
        state, cell, kept = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), []
        steps = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        for t in steps:
            z = self.p["x" + d][x[t]] + state @ self.p["h" + d]
            gates, g = _sigmoid(z[:, : 3 * h]), np.tanh(z[:, 3 * h :])
            old, before = cell, state
            cell = gates[:, h : 2 * h] * cell + gates[:, :h] * g
            tc = np.tanh(cell)
            state = gates[:, 2 * h :] * tc
            out[t] = state
            if keep:
                kept.append((t, before, old, gates, g, tc))
        return out, kept

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """x: rows by steps. Tag scores, rows by steps by tags."""
        x = x.T
        both = np.concatenate((self._lstm(x, "f")[0], self._lstm(x, "b")[0]), 2)
        return (both @ self.p["o"] + self.p["ob"]).transpose(1, 0, 2)

    def _back(self, d: str, x: np.ndarray, kept: list, dout: np.ndarray, g: dict) -> None:
        h = HIDDEN
        dstate, dcell = np.zeros_like(kept[0][1]), np.zeros_like(kept[0][1])
        g["x" + d], g["h" + d] = np.zeros_like(self.p["x" + d]), np.zeros_like(self.p["h" + d])
        for t, before, old, gates, cand, tc in reversed(kept):
            ds = dout[t] + dstate
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            dc = dcell + ds * o * (1 - tc * tc)
            dz = np.concatenate((dc * cand * i * (1 - i), dc * old * f * (1 - f), ds * tc * o * (1 - o), dc * i * (1 - cand * cand)), 1)
            np.add.at(g["x" + d], x[t], dz)
            g["h" + d] += before.T @ dz
            dstate, dcell = dz @ self.p["h" + d].T, dc * f

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Of the CRF's negative log-likelihood; x, y: rows by steps."""
        x, y = x.T, y.T
        f, kf = self._lstm(x, "f", True)
        b, kb = self._lstm(x, "b", True)
        both = np.concatenate((f, b), 2)
        e = (both @ self.p["o"] + self.p["ob"]).astype(np.float64)
        steps, n, _ = e.shape
        a = self.p["t"].astype(np.float64)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, steps):
            alpha[t] = e[t] + _lse(alpha[t - 1][:, :, None] + a, 1)
        for t in range(steps - 2, -1, -1):
            beta[t] = _lse(a + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = _lse(alpha[-1], 1)
        de = np.exp(alpha + beta - z[:, None])
        pair = np.zeros_like(a)
        for t in range(1, steps):
            pair += np.exp(alpha[t - 1][:, :, None] + a + (e[t] + beta[t])[:, None, :] - z[:, None, None]).sum(0)
        rows = np.arange(n)
        gold = e[np.arange(steps)[:, None], rows, y].sum() + a[y[:-1], y[1:]].sum()
        de[np.arange(steps)[:, None], rows, y] -= 1
        np.add.at(pair, (y[:-1], y[1:]), -1)
        de = (de / n).astype(np.float32)
        g = {"t": (pair / n).astype(np.float32), "o": both.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, TAGS), "ob": de.sum((0, 1))}
        dboth = de @ self.p["o"].T
        self._back("f", x, kf, dboth[:, :, :HIDDEN], g)
        self._back("b", x, kb, dboth[:, :, HIDDEN:], g)
        return float(z.sum() - gold) / n, g

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Tagger:
        rng = np.random.default_rng(seed)
        m, s = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        step, total = 0, epochs * -(-len(x) // BATCH)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), BATCH):
                own = order[i : i + BATCH]
                _, g = self.gradient(x[own], y[own])
                norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
                step += 1
                rate = RATE * (1 - (step - 1) / total)
                for k in self.p:
                    v = g[k] * min(1, 5 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * v
                    s[k] = 0.99 * s[k] + 0.01 * v * v
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)
        return self

    def decode(self, e: np.ndarray) -> np.ndarray:
        """The best tags of one stretch: steps by tags."""
        back, best = np.zeros(e.shape, np.int64), e[0]
        for t in range(1, len(e)):
            via = best[:, None] + self.p["t"]
            back[t] = via.argmax(0)
            best = via.max(0) + e[t]
        out = np.zeros(len(e), np.int64)
        out[-1] = best.argmax()
        for t in range(len(e) - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
        return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.log(np.exp(x - m).sum(axis)) + m.squeeze(axis)


# --- labelled spans ------------------------------------------------------------------------------------------------------


def _write(kind: int, rng: np.random.Generator) -> str:
    """A value of a kind, in the rules' form or in another."""
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    w = lambda: "".join(rng.choice(list("abcdefghijklmnoprstuvwy"), rng.integers(3, 9)))
    pick = lambda *xs: xs[rng.integers(len(xs))]
    if kind == 0:
        at, dot = pick(("@", "."), ("@", "."), (" @ ", "."), ("(@)", "."), (" [@] ", " . "))
        return f"{pick(w(), f'{w()}.{w()}', f'{w()}{d(2)}', d(2))}{at}{pick(w(), f'mail{d(1)}', f'{w()}.{w()}')}{dot}{pick('com', 'org', 'net', 'fr', 'de', 'es')}"
    if kind == 1:
        sep = pick(".", ".", ".", " . ", "[.]")
        return sep.join(str(x) for x in rng.integers(1, 256, 4))
    if kind == 2:
        sep = pick("", "", "-", " ", ".", "/")
        return sep.join(d(4) for _ in range(4))
    body = pick(f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(3)}/{d(7)}")
    return pick(f"+{d(1)} {body}", f"+{d(2)} {body}", body)


def _other(rng: np.random.Generator) -> str:
    """A number that is no one's: versions, dates, prices, keys, hours."""
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    return [f"{d(1)}.{d(1)}", f"20{d(2)}-{d(2)}-{d(2)}", f"{d(2)}/{d(2)}/20{d(2)}", f"{d(3)},{d(2)}", f"${d(2)}.{d(2)}", "".join(rng.choice(list("0123456789abcdef"), 40)), f"{d(2)}:{d(2)}", d(int(rng.integers(1, 7))), f"v{d(1)}.{d(2)}.{d(1)}", f"@{d(1)}", f"({d(2)})"][rng.integers(11)]


def labelled_windows(texts: list[str], n: int = WINDOWS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Codes and tags of windows of TILE + 2 * MARGIN characters with written spans."""
    rng, size = np.random.default_rng(seed), TILE + 2 * MARGIN
    texts = [t for t in texts if t] or ["and the of in"]
    xs, ys = np.zeros((n, size), np.int64), np.zeros((n, size), np.int64)
    for i in range(n):
        t = texts[rng.integers(len(texts))]
        at = int(rng.integers(0, max(len(t) - 100, 1)))
        cut = at + int(rng.integers(0, 70))
        spans = []
        head = t[at:cut]
        which = rng.random()
        value = _other(rng) if which < 0.3 else _write(k := int(rng.integers(4)), rng)
        glue = "" if rng.random() < 0.1 else " "
        if which >= 0.3:
            spans.append((len(head) + len(glue), k, len(head) + len(glue) + len(value)))
        text = f"{head}{glue}{value}{glue}{t[cut : cut + 100]}"
        if which < 0.3:
            spans += base_spans(text)
        else:
            spans += [s for s in base_spans(text) if s[2] <= spans[0][0] or s[0] >= spans[0][2]]
        tags = np.zeros(len(text), np.int64)
        for s, k, e in spans:
            tags[s] = 1 + 2 * k
            tags[s + 1 : e] = 2 + 2 * k
        lo = int(rng.integers(-MARGIN, max(len(text) - size, 1)))
        a, b = max(lo, 0), min(lo + size, len(text))
        xs[i, a - lo : b - lo], ys[i, a - lo : b - lo] = _codes(text)[a:b], tags[a:b]
    return xs, ys


# --- scanning ------------------------------------------------------------------------------------------------------------


def _plausible(kind: int, value: str) -> bool:
    digits = _DIGIT.findall(value)
    if kind == 0:
        return bool(re.search(r"[^\W_]\W{0,3}@\W{0,3}[^\W_]", value)) and "." in value.split("@", 1)[1]
    if kind == 1:
        parts = re.findall("[0-9]+", value)
        return len(parts) == 4 and all(len(p) < 4 and int(p) < 256 for p in parts)
    if kind == 2:
        return 12 <= len(digits) <= 19 and len(value) <= 2 * len(digits) and _luhn("".join(digits))
    return 9 <= len(digits) <= 15 and len(value) <= 2 * len(digits) and bool(re.search(r"[\x20().\x2D/]", value)) and not re.search("[A-Za-z]", value)


def added_spans(texts: list[str], bases: list[list], model: Tagger) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) that the network finds besides the rules' spans, for each text."""
    size, stretches, windows = TILE + 2 * MARGIN, [], []
    out: list[list] = [[] for _ in texts]
    for i, text in enumerate(texts):
        codes = _codes(text)
        at = np.flatnonzero(((codes >= 48) & (codes <= 57)) | (codes == 64))
        if not len(at):
            continue
        tiles = np.unique(at // TILE)
        tiles = np.unique(np.concatenate((tiles - 1, tiles, tiles + 1)))
        tiles = tiles[(tiles >= 0) & (tiles * TILE < len(codes))]
        padded = np.zeros((int(tiles[-1]) + 2) * TILE + 2 * MARGIN, np.int64)
        padded[MARGIN : MARGIN + len(codes)] = codes[: len(padded) - MARGIN]
        for run in np.split(tiles, np.flatnonzero(np.diff(tiles) > 1) + 1):
            stretches.append((i, int(run[0]), len(run), len(windows)))
            windows += [padded[t * TILE : t * TILE + size] for t in run.tolist()]
    scores = [model.emissions(np.array(windows[j : j + 1024])) for j in range(0, len(windows), 1024)]
    scores = np.concatenate(scores) if scores else None
    for i, first, n, w in stretches:
        lo, text = first * TILE, texts[i]
        total, times = np.zeros((n * TILE + 2 * MARGIN, TAGS)), np.zeros((n * TILE + 2 * MARGIN, 1))
        for j in range(n):
            total[j * TILE : j * TILE + size] += scores[w + j]
            times[j * TILE : j * TILE + size] += 1
        e = (total / times)[MARGIN : MARGIN + min(n * TILE, len(text) - lo)]
        tags = model.decode(e)
        kinds = np.where(tags > 0, (tags + 1) // 2, 0)
        begins = np.flatnonzero((kinds > 0) & ((np.r_[0, kinds[:-1]] != kinds) | (tags % 2 == 1)))
        for b in begins.tolist():
            end = b + 1
            while end < len(tags) and tags[end] == 2 * kinds[b]:
                end += 1
            s, t = lo + b, lo + end
            while s < t and text[s].isspace():
                s += 1
            while t > s and (text[t - 1].isspace() or text[t - 1] in ",;:"):
                t -= 1
            k = int(kinds[b]) - 1
            if (s and text[s - 1].isdigit() and text[s].isdigit()) or (t < len(text) and text[t].isdigit() and text[t - 1].isdigit()):
                continue  # a cut number
            if t > s and _plausible(k, text[s:t]) and not any(x < t and s < y for x, _, y in bases[i]):
                out[i].append((s, k, t))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Tagger:
    few = hashed_sample(docs.select("text"), sample)
    return Tagger().train(*labelled_windows(sorted(r[0] for r in few.collect())))  # SAMPLE texts of 20000 characters at most


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Tagger | None = None) -> DataFrame:
    """One row a document: doc_id, the number of the rules' spans of each kind, base and spans as arrays of (start, end, kind)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = keyed_texts(docs, id_col, text_col)
    shared = spark.sparkContext.broadcast(model or fit(docs))
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            texts = [t or "" for t in texts]
            base = [base_spans(t) if t else [] for t in texts]
            more = added_spans(texts, base, shared.value)
            cols = {"doc_id": b.column(b.schema.get_field_index("doc_id"))}
            for k, name in enumerate(KINDS):
                cols[f"n_{name}"] = pa.array([sum(s[1] == k for s in x) for x in base], pa.int64())
            for name, lists in (("base", base), ("spans", [sorted(x + y) for x, y in zip(base, more, strict=True)])):
                cols[name] = pa.array([[{"start": s, "end": e, "kind": KINDS[k]} for s, k, e in x] for x in lists], span)
            yield pa.record_batch(cols)

    # a text without digit and @ has no span of any kind and need not travel
    needed = docs.select("doc_id", F.when(F.col("text").rlike("[0-9@]"), F.col("text")).alias("text"))
    kind = "array<struct<start:int,end:int,kind:string>>"
    return needed.mapInArrow(work, f"doc_id long, {', '.join(f'n_{k} long' for k in KINDS)}, base {kind}, spans {kind}")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(documents(spark, sf_dir))

    def text(c: str):
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))
