"""Secret scans: fixed patterns, and a character network over all other candidates.

Every run of 16 or more key characters is a candidate.
A small convolutional network (numpy; characters in classes, one layer, maximum
over positions) reads it with 24 characters of context on both sides, a run of
more than ``INSIDE`` characters in windows that overlap, of which the likeliest
counts, and a logistic scale fitted on held-out findings calibrates its output. The threshold
is the largest that still finds ``RECALL`` of the held-out secrets. The network
is trained on labelled findings that ``labelled`` makes from a fixed seed
(shapes of published key formats, against identifiers, numbers, addresses, rules
and words that are no secrets, each as ``candidates`` finds it in its text), once on the driver, in a few seconds.

Spans of the fixed patterns always stay; the network adds the full extent of any
other candidate, but of those that lie within one of them. Positions are code points.

Edge cases: a null text is an empty one and has no spans; repeated rows are
scanned as often as they come; a very long text is read whole, and so is a very
long candidate, in windows; spans that start together are listed by kind; an
empty table gives no rows. Columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, release

KINDS = ("assign", "access", "hex", "learned")
#: The patterns, and the characters that a match (or its group) must have at least.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: Any match of HEX that is long enough; a run is searched for by its length, which is much faster.
LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
CONTEXT, INSIDE, STEP, RECALL = 24, 48, 8, 0.995
WIDTH = 2 * CONTEXT + INSIDE
FILTERS, SPAN, DEPTH = 24, 5, 12

_CLASSES = np.full(256, 11, np.int64)
for _i, _of in enumerate(["", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "0123456789", " \n\t", "=:", "\"'", "+/_-", ".,;!?@"]):
    _CLASSES[[ord(_c) for _c in _of]] = _i
_CLASSES[0] = 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, each kind leftmost and without overlaps."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    out += [(m.start(), m.end(), "hex") for m in LONG_HEX.finditer(text)]
    return out


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs that the network reads: all of 16 or more key characters."""
    return [m.span() for m in CANDIDATE.finditer(text)]


def window(text: str, start: int, end: int) -> bytes:
    """A candidate (its first 24 and last 24 characters, if it is longer than 48) between its contexts, one byte a character."""
    run = text[start:end] if end - start <= INSIDE else text[start : start + INSIDE // 2] + text[end - INSIDE // 2 : end]
    whole = text[max(0, start - CONTEXT) : start].rjust(CONTEXT, "\0") + run.ljust(INSIDE, "\0") + text[end : end + CONTEXT].ljust(CONTEXT, "\0")
    return whole.encode("latin-1", "replace")


def windows_of(text: str, start: int, end: int) -> list[bytes]:
    """The windows that a candidate is read in: every stretch of ``INSIDE - STEP`` characters stands whole in one of them."""
    out = [window(text, start, end)]
    if end - start > INSIDE:
        before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
        for a in [*range(start, end - INSIDE, STEP), end - INSIDE]:
            out.append(window(before + text[a : a + INSIDE] + after, len(before), len(before) + INSIDE))
    return out


def classes(windows: list[bytes]) -> np.ndarray:
    return _CLASSES[np.frombuffer(b"".join(windows), np.uint8)].reshape(len(windows), WIDTH)


def labelled(n: int = 4000, seed: int = 7) -> tuple[list[bytes], np.ndarray]:
    """Labelled findings: windows of secrets (1) and of what only looks like one (0)."""
    rng = np.random.default_rng(seed)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    def some(of: str, k: int) -> str:
        return "".join(of[i] for i in rng.integers(0, len(of), k))

    def word() -> str:
        w = some(lower, int(rng.integers(2, 9)))
        return w.capitalize() if rng.random() < 0.15 else w

    def prose(k: int) -> str:
        return " ".join(word() + ("," if rng.random() < 0.1 else "") for _ in range(k))

    def key() -> str:
        k, full = int(rng.integers(20, 64)), lower + upper + digits
        return [lambda: some(full, k), lambda: some(full + "+/", k) + "=" * int(rng.integers(0, 3)), lambda: some(full + "_-", k), lambda: "gh" + some("pous", 1) + "_" + some(full, 36), lambda: "sk_live_" + some(full, 24), lambda: "xoxb-" + some(digits, 11) + "-" + some(full, 24), lambda: "AIza" + some(full + "_-", 35), lambda: "eyJ" + some(full, 17) + ".eyJ" + some(full + "_-", 30) + "." + some(full + "_-", 30), lambda: some(lower + upper, k)][int(rng.integers(0, 9))]()

    def benign() -> str:
        return [
            lambda: word() + some(digits, int(rng.integers(1, 5))) + "." + word() + word() + "." + some(lower, 3),
            lambda: "/".join(word() for _ in range(4)) + "/" + some(digits, 4),
            lambda: "-".join([some(digits, 4), some(digits, 2), some(digits, 2)]) + "T" + some(digits, 2) + "-" + some(digits, 2) + "Z",
            lambda: "_".join(word() for _ in range(4)) + "_" + some(digits, 1),
            lambda: word() + word() + word() + "-" + some(digits, 2),
            lambda: "v" + ".".join(some(digits, int(rng.integers(1, 3))) for _ in range(3)) + "-" + word() + "-" + word(),
            lambda: some(upper, 2) + "-" + some(digits, 14),
            lambda: "www." + word() + word() + "." + some(lower, 3) + "/" + some(digits, 3),
            lambda: word() + word() + "=" + some(digits, 8),
            lambda: some(upper, 2) + some(digits, 20),
            lambda: some(lower, int(rng.integers(16, 40))),
            lambda: some(upper, int(rng.integers(16, 40))),
            lambda: some(upper, 1) + some(lower, int(rng.integers(15, 30))) + [".", "", "..."][int(rng.integers(0, 3))],
            lambda: "".join(some(lower, int(rng.integers(3, 9))).capitalize() for _ in range(4)),
            lambda: some("-=._+/", 1) * int(rng.integers(16, 80)),
            lambda: some(digits, int(rng.integers(16, 40))),
            lambda: "/".join(word() for _ in range(5)),
            lambda: ".".join(word() for _ in range(5)) + "...",
            lambda: "-".join(word() for _ in range(5)),
        ][int(rng.integers(0, 19))]()

    windows, truth = [], np.zeros(n, np.int64)
    for i in range(n):
        truth[i] = i % 2
        run = ""
        while len(run) < 16:
            run = key() if truth[i] else benign()
        before = prose(6) + [" ", "\n", ' = "', ": ", " (", " key "][int(rng.integers(0, 6))]
        text = before + run + [" ", "\n", '"', ")", ". ", ", "][int(rng.integers(0, 6))] + prose(6)
        middle = len(before) + len(run) // 2
        # as the scan would read it: with what else the run takes in
        windows.append(window(text, *next((a, b) for a, b in candidates(text) if a <= middle < b)))
    return windows, truth


class Network:
    """Embedding of character classes, one convolution, rectifier, maximum over positions, a logistic unit."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.p = {"e": rng.normal(0, 0.5, (12, DEPTH)), "k": rng.normal(0, (2 / (SPAN * DEPTH)) ** 0.5, (SPAN * DEPTH, FILTERS)), "b": np.zeros(FILTERS), "w": rng.normal(0, 0.3, 3 * FILTERS), "c": np.zeros(1)}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _parts(self):
        # the context before, the run and the context after have maxima of their own
        cuts = [0, CONTEXT, CONTEXT + INSIDE, WIDTH]
        return [(a, min(b, WIDTH - SPAN + 1)) for a, b in zip(cuts, cuts[1:])]

    def _forward(self, x: np.ndarray):
        e = self.p["e"][x]
        cols = np.lib.stride_tricks.sliding_window_view(e, SPAN, axis=1).transpose(0, 1, 3, 2).reshape(len(x), WIDTH - SPAN + 1, SPAN * DEPTH)
        h = cols @ self.p["k"] + self.p["b"]
        top = [a + h[:, a:b].argmax(axis=1) for a, b in self._parts()]
        pooled = np.concatenate([np.maximum(np.take_along_axis(h, t[:, None], axis=1)[:, 0], 0) for t in top], axis=1)
        return cols, top, pooled, pooled @ self.p["w"] + self.p["c"]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 256])[3] for i in range(0, len(x), 256)]) if len(x) else np.zeros(0)

    def chances(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities that the windows hold secrets."""
        return 1 / (1 + np.exp(-(self.scale * self.raw(x) + self.shift)))

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 14, rate: float = 0.01, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(u) for k, u in self.p.items()}
        t = 0
        for _ in range(rounds):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
                t += 1
                cols, top, pooled, z = self._forward(x[at])
                d = (1 / (1 + np.exp(-z)) - y[at]) / len(at)
                g = {"w": pooled.T @ d, "c": d.sum(keepdims=True), "k": np.zeros_like(self.p["k"]), "b": np.zeros(FILTERS), "e": np.zeros_like(self.p["e"])}
                back = d[:, None] * self.p["w"] * (pooled > 0)
                for i, pos in enumerate(top):
                    part = back[:, i * FILTERS : (i + 1) * FILTERS]
                    picked = np.take_along_axis(cols, pos[:, :, None], axis=1)  # rows x filters x inputs
                    g["k"] += np.einsum("nf,nfi->if", part, picked)
                    g["b"] += part.sum(axis=0)
                    into = (part[:, :, None] * self.p["k"].T[None]).reshape(len(at), FILTERS, SPAN, DEPTH)
                    chars = np.take_along_axis(x[at], (pos[:, :, None] + np.arange(SPAN)).reshape(len(at), -1), axis=1)
                    np.add.at(g["e"], chars.ravel(), into.reshape(-1, DEPTH))
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float = RECALL) -> None:
        """Platt's scale on held-out findings, then the largest threshold with the recall asked for."""
        z = self.raw(x)
        self.scale, self.shift = 1.0, 0.0
        for _ in range(300):
            p = 1 / (1 + np.exp(-(self.scale * z + self.shift)))
            self.scale -= 0.05 * float(((p - y) * z).mean())
            self.shift -= 0.05 * float((p - y).mean())
        found = np.sort(self.chances(x)[y == 1])
        self.threshold = float(found[int((1 - recall) * len(found))] - 1e-9) if len(found) else 0.5


@lru_cache(maxsize=1)
def trained() -> Network:
    windows, y = labelled()
    x, held = classes(windows), np.arange(len(y)) % 5 == 0
    net = Network()
    net.fit(x[~held], y[~held])
    net.calibrate(x[held], y[held])
    return net


def spans(texts: list[str], net: Network) -> list[list[tuple[int, int, str]]]:
    """All spans of each text by start, then kind; the network reads the candidates of all texts together."""
    out, open_, windows, firsts = [], [], [], []
    for i, text in enumerate(texts):
        found = base_spans(text)
        at, reach, ordered = 0, -1, sorted(found)
        for a, b in candidates(text):
            while at < len(ordered) and ordered[at][0] <= a:
                reach, at = max(reach, ordered[at][1]), at + 1
            if b > reach:  # else it lies within a span
                open_.append((i, a, b))
                firsts.append(len(windows))
                windows += windows_of(text, a, b)
        out.append(found)
    if windows:
        chances = np.concatenate([net.chances(classes(windows[k : k + 4096])) for k in range(0, len(windows), 4096)])
        for (i, a, b), p in zip(open_, np.maximum.reduceat(chances, firsts)):
            if p >= net.threshold:
                out[i].append((a, b, "learned"))
    return [sorted(x, key=lambda s: (s[0], KINDS.index(s[2]))) for x in out]


def joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


def _scan(net):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            rows = spans(texts, net.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in r] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])))], ["doc_id", "spans"])

    return run


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): the spans of each row's text."""
    net = docs.sparkSession.sparkContext.broadcast(trained())
    return docs.select("doc_id", "text").mapInArrow(_scan(net), f"doc_id {dict(docs.dtypes)['doc_id']}, spans array<struct<start:long,end:long,kind:string>>")


def digests(found: DataFrame) -> DataFrame:
    """Counts by kind, the base spans' SHA-256, and all spans as text."""
    text = lambda of: F.concat_ws(",", F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "learned")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), count("learned"))


MARK = "[SECRET]"


def _redact(net, where: int, count: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # a stage before this one may have left its worker large
        for batch, texts in chunks(batches):
            was = batch.column(where)
            out = []
            for text, found in zip(texts, spans(texts, net.value)):
                at, parts = 0, []
                for a, b, _ in found:
                    if b <= at:
                        continue
                    if a >= at:  # else it runs on from the last one
                        parts += [text[at:a], MARK]
                    at = b
                out.append("".join(parts) + text[at:])
            new = pa.array([t if was[i].is_valid else None for i, t in enumerate(out)], was.type)
            batch = batch.set_column(where, batch.schema.field(where), new)
            if count is not None:
                old = batch.column(count)
                batch = batch.set_column(count, batch.schema.field(count), pa.array([len(t) if t != o else n for t, o, n in zip(out, texts, old.to_pylist())], old.type))
            yield batch

    return run


def redact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with each secret replaced by a mark; ``n_chars``, if there, counts the new text of those changed."""
    net = docs.sparkSession.sparkContext.broadcast(trained())
    where, count = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    return docs.mapInArrow(_redact(net, where, count), docs.schema)
