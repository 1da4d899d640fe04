"""Language identification by a bidirectional gated recurrent network over bytes (operator 5).

The network reads the bytes of a segment (a stretch without white space, cut after SEGMENT
bytes) forwards and backwards and gives a distribution over languages at every byte.  A
document's distribution is the normalised geometric mean of those of all its bytes.  State
starts anew in each segment, so equal segments have equal results: a worker labels each
distinct segment once, and adds up a document from its segments.

Training is backpropagation through time in numpy, on a bounded sample: of each language at
most DOCS rows, chosen by a hash of the row, with one window of WINDOW characters each.  What
is counted or predicted covers all rows and whole texts.

Null texts and texts without a letter are ``und`` with score 0, and so is everything if no row
may be learned from.  Rows without doc_id are never learned from.  Ties between languages go
to the first by name; repeated rows get equal results; extra columns are ignored.  Texts of any length
are read whole, by their segments; an empty table gives an empty result.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heedline.llm.common import released

DOCS = 400
WINDOW = 2000
SEGMENT = 24
HIDDEN = 16
STEPS = 240
BATCH = 512
KNOWN_SEGMENTS = 300_000
UNKNOWN = "und"


def fold(divisor: int = 5) -> Column:
    """crc32 of doc_id as text, by remainder; null for a missing doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def segments(text: str) -> list[bytes]:
    words = text.encode("utf-8", "replace").split()
    if max(map(len, words), default=0) <= SEGMENT:
        return words
    return [w[i : i + SEGMENT] for w in words for i in range(0, len(w), SEGMENT)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Network:
    """Parameters by name; those of the two directions end in f and b."""

    labels: list[str]
    params: dict[str, np.ndarray]

    @classmethod
    def new(cls, labels: list[str], hidden: int = HIDDEN, seed: int = 1) -> "Network":
        rng, p = np.random.default_rng(seed), {}
        for side in "fb":
            p["in" + side] = rng.normal(0, 0.3, (256, 3 * hidden))
            p["rec" + side] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))
            p["out" + side] = rng.normal(0, 0.3, (hidden, len(labels)))
        p["bias"] = np.zeros(len(labels))
        return cls(labels, {k: v.astype(np.float32) for k, v in p.items()})

    def read(self, raw: np.ndarray, side: str, keep: bool = False):
        """States after each byte of equally long segments (a row each), in reading order."""
        p, h_size = self.params, self.params["recf"].shape[0]
        rec, inp = p["rec" + side], p["in" + side][raw]
        h, states, kept = np.zeros((len(raw), h_size), np.float32), [], []
        for t in range(raw.shape[1]):
            a = h @ rec
            x = inp[:, t]
            gates = _sigmoid(x[:, : 2 * h_size] + a[:, : 2 * h_size])
            z, r, a_n = gates[:, :h_size], gates[:, h_size:], a[:, 2 * h_size :]
            n = np.tanh(x[:, 2 * h_size :] + r * a_n)
            if keep:
                kept.append((h, z, r, a_n, n))
            h = n + z * (h - n)
            states.append(h)
        return np.stack(states, 1), kept

    def log_probabilities(self, raw: np.ndarray) -> np.ndarray:
        """(segment, byte, language)."""
        forward, _ = self.read(raw, "f")
        backward, _ = self.read(raw[:, ::-1], "b")
        p = self.params
        out = forward @ p["outf"] + backward[:, ::-1] @ p["outb"] + p["bias"]
        out -= out.max(2, keepdims=True)
        return out - np.log(np.exp(out).sum(2, keepdims=True))

    def gradients(self, raw: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        p, grad = self.params, {}
        sides = {"f": raw, "b": raw[:, ::-1]}
        read = {s: self.read(r, s, keep=True) for s, r in sides.items()}
        states = {"f": read["f"][0], "b": read["b"][0][:, ::-1]}
        out = states["f"] @ p["outf"] + states["b"] @ p["outb"] + p["bias"]
        out = np.exp(out - out.max(2, keepdims=True))
        delta = out / out.sum(2, keepdims=True)
        delta[np.arange(len(raw)), :, target] -= 1
        delta /= raw.size
        grad["bias"] = delta.sum((0, 1))
        for s in "fb":
            grad["out" + s] = np.tensordot(states[s], delta, ((0, 1), (0, 1)))
            back = delta @ p["out" + s].T
            if s == "b":
                back = back[:, ::-1]
            grad["in" + s], grad["rec" + s] = self._through_time(s, sides[s], read[s][1], back)
        return grad

    def _through_time(self, side: str, raw: np.ndarray, kept: list, back: np.ndarray):
        rec = self.params["rec" + side]
        d_in, d_rec = np.zeros_like(self.params["in" + side]), np.zeros_like(rec)
        carry = np.zeros_like(back[:, 0])
        for t in range(raw.shape[1] - 1, -1, -1):
            h, z, r, a_n, n = kept[t]
            d = back[:, t] + carry
            d_n = d * (1 - z) * (1 - n * n)
            d_z = d * (h - n) * z * (1 - z)
            d_r = d_n * a_n * r * (1 - r)
            d_x = np.concatenate([d_z, d_r, d_n], 1)
            d_a = np.concatenate([d_z, d_r, d_n * r], 1)
            np.add.at(d_in, raw[:, t], d_x)
            d_rec += h.T @ d_a
            carry = d * z + d_a @ rec.T
        return d_in, d_rec

    def train(self, words: list[bytes], target: np.ndarray, steps: int = STEPS, seed: int = 2) -> None:
        """Adam over batches of equally long segments, lengths in proportion to their bytes."""
        rng = np.random.default_rng(seed)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        lengths = sorted(by_length)
        share = np.array([n * len(by_length[n]) for n in lengths], float)
        mean = {k: np.zeros_like(v) for k, v in self.params.items()}
        square = {k: np.zeros_like(v) for k, v in self.params.items()}
        for step in range(1, steps + 1):
            length = lengths[rng.choice(len(lengths), p=share / share.sum())]
            rows = rng.choice(by_length[length], BATCH)
            raw = np.frombuffer(b"".join(words[i] for i in rows), np.uint8).reshape(-1, length)
            rate = 0.02 * (1 - 0.9 * step / steps)
            for k, g in self.gradients(raw, target[rows]).items():
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.01 * (g * g - square[k])
                m, s = mean[k] / (1 - 0.9**step), square[k] / (1 - 0.99**step)
                self.params[k] -= (rate * m / (np.sqrt(s) + 1e-8)).astype(np.float32)


class Labeller:
    def __init__(self, network: Network):
        self.network, self.at = network, {}
        self.table = np.zeros((1024, len(network.labels) + 1))

    def learn(self, new: list[bytes]) -> None:
        """Adds each segment's summed log probabilities and its length to the table."""
        start = len(self.at)
        while len(self.table) < start + len(new):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.at.update(zip(new, range(start, start + len(new))))
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(new):
            by_length.setdefault(len(w), []).append(i)
        for length, rows in by_length.items():
            for lo in range(0, len(rows), 8192):
                some = rows[lo : lo + 8192]
                raw = np.frombuffer(b"".join(new[i] for i in some), np.uint8).reshape(-1, length)
                at = start + np.array(some)
                self.table[at, :-1] = self.network.log_probabilities(raw).sum(1)
                self.table[at, -1] = length

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = []
        for lo in range(0, len(texts), 64):
            split = [segments(t or "") for t in texts[lo : lo + 64]]
            if len(self.at) > KNOWN_SEGMENTS:
                self.at.clear()
            self.learn(list({s for own in split for s in own}.difference(self.at)))
            for text, own in zip(texts[lo : lo + 64], split):
                if not own or not any(c.isalpha() for c in text):
                    out.append((UNKNOWN, 0.0))
                    continue
                where = np.fromiter(map(self.at.__getitem__, own), np.int64, len(own))
                total = self.table[where].sum(0)
                mean = total[:-1] / total[-1]
                p = np.exp(mean - mean.max())
                best = int(p.argmax())
                out.append((self.network.labels[best], float(p[best] / p.sum())))
        return out


def learn(docs: DataFrame, allowed: Column, per_language: int = DOCS, window: int = WINDOW) -> Network | None:
    """A network from rows where ``allowed`` holds and ``lang`` and ``text`` are known."""
    known = docs.where(allowed & F.col("lang").isNotNull() & (F.length("text") > 0)).select("doc_id", "lang", "text")
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    row = F.xxhash64("doc_id", "text")
    # Four times the sample by the hash alone, where the texts are read: a bounded set of windows moves.
    chance = F.pmod(row, F.lit(1 << 30)) / F.lit(float(1 << 30))
    # A row for each language, as many as the network has outputs.
    some = known.join(F.broadcast(counts), "lang").where(chance < 4.0 * per_language / F.col("n"))
    length = F.length("text")
    start = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.lit(1), length - window + 1)) + 1
    some = some.select("lang", row.alias("row"), F.col("text").substr(start.cast("int"), F.lit(window)).alias("t"))
    order = F.row_number().over(Window.partitionBy("lang").orderBy("row", "t"))
    rows = some.withColumn("k", order).where(F.col("k") <= per_language).select("lang", "t").collect()
    labels = sorted({r["lang"] for r in rows})
    words, target = [], []
    for r in sorted(rows, key=lambda r: (r["lang"], r["t"])):
        own = segments(r["t"])
        words += own
        target += [labels.index(r["lang"])] * len(own)
    if not words:
        return None
    network = Network.new(labels)
    if len(labels) > 1:
        network.train(words, np.array(target))
    return network


def identify(docs: DataFrame, network: Network | None) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to every row; all other columns stay."""
    docs = docs.drop("lang_pred", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(network) if network else None
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = labeller.predict(texts) if labeller else [(UNKNOWN, 0.0)] * len(texts)
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "lang_pred", "score"])

    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return docs.mapInArrow(released(run), schema)


def predictions(docs: DataFrame) -> DataFrame:
    network = learn(docs, fold() != 0)
    found = identify(docs.select("doc_id", "text"), network)
    held_out = F.coalesce(fold() == 0, F.lit(True)).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score")
