"""Language identification by a bidirectional gated recurrent network over bytes (operator 7).

The network reads chunks of a text's UTF-8 bytes in both directions and gives every byte a
distribution over the languages; a document's is the mean over all its bytes. Weights are trained in
numpy by backpropagation through time on a bounded sample of each language's labelled text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_remainder

#: Documents of each language that training draws from, about: their whole texts.
SAMPLE_DOCUMENTS = 2_000
#: Bytes of a chunk, width of each direction, chunks computed at once.
CHUNK, HIDDEN, BLOCK = 64, 8, 1024
STEPS, BATCH, RATE = 500, 256, 0.02

_LETTER = regex.compile(r"\p{L}")


@dataclass
class Direction:
    """One gated recurrent layer; gates in the order update, reset, candidate."""

    table: np.ndarray  # 256 x 3H: input weights of each byte, biases included
    inner: np.ndarray  # H x 3H
    bias: np.ndarray  # H: added to the candidate's inner part before the reset gate

    def run(self, codes: np.ndarray, mask: np.ndarray, out: np.ndarray, keep: list | None = None) -> None:
        """States after each step into out (T x B x H); codes and mask are T x B. Beyond the mask the
        state stays as it was before."""
        width = self.inner.shape[0]
        h = np.zeros((codes.shape[1], width), self.table.dtype)
        full = mask.all(axis=1)
        for t in range(len(codes)):
            x = self.table[codes[t]]
            inner = h @ self.inner
            gates = x[:, : 2 * width] + inner[:, : 2 * width]
            # The logistic function by tanh, which numpy computes in vector registers.
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            update, reset = gates[:, :width], gates[:, width:]
            beyond = inner[:, 2 * width :] + self.bias
            candidate = np.tanh(x[:, 2 * width :] + reset * beyond)
            new = candidate + update * (h - candidate)
            if not full[t]:
                new = np.where(mask[t][:, None], new, h)
            if keep is not None:
                keep.append((h, update, reset, beyond, candidate))
            out[t] = h = new

    def read(self, codes: np.ndarray, mask: np.ndarray, out: np.ndarray) -> None:
        """As run(), with states T x H x B and no memory for gradients: every array is contiguous,
        made once and small enough for the processor's cache."""
        width, count = self.inner.shape[0], codes.shape[1]
        # The logistic function is (1 + tanh(x / 2)) / 2; the halves go into the weights.
        half = np.repeat(np.array([0.5, 0.5, 1.0], self.table.dtype), width)
        table, weights = np.ascontiguousarray((self.table * half).T), np.ascontiguousarray((self.inner * half).T)
        bias = self.bias[:, None]
        h, x, inner = (np.zeros((k * width, count), table.dtype) for k in (1, 3, 3))
        full = mask.all(axis=1)
        for t in range(len(codes)):
            np.take(table, codes[t], axis=1, out=x, mode="clip")
            np.matmul(weights, h, out=inner)
            gates, candidate, beyond = x[: 2 * width], x[2 * width :], inner[2 * width :]
            gates += inner[: 2 * width]
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            beyond += bias
            beyond *= gates[width:]
            candidate += beyond
            np.tanh(candidate, out=candidate)
            h -= candidate
            h *= gates[:width]
            h += candidate
            if not full[t]:
                h[:, ~mask[t]] = out[t - 1][:, ~mask[t]] if t else 0
            out[t] = h

    def back(self, codes: np.ndarray, mask: np.ndarray, kept: list, grad_out: np.ndarray) -> Direction:
        """Gradients of the weights, from those of the states (T x B x H)."""
        width = self.inner.shape[0]
        table, inner, bias = np.zeros_like(self.table), np.zeros_like(self.inner), np.zeros_like(self.bias)
        down = np.zeros_like(grad_out[0])
        for t in range(len(codes) - 1, -1, -1):
            h, update, reset, beyond, candidate = kept[t]
            on = mask[t][:, None]
            total = grad_out[t] + down
            live = np.where(on, total, 0)
            d_candidate = live * (1 - update) * (1 - candidate**2)
            d_update = live * (h - candidate) * update * (1 - update)
            d_beyond = d_candidate * reset
            d_reset = d_candidate * beyond * reset * (1 - reset)
            d_inner = np.concatenate([d_update, d_reset, d_beyond], axis=1)
            np.add.at(table, codes[t], np.concatenate([d_update, d_reset, d_candidate], axis=1))
            inner += h.T @ d_inner
            bias += d_beyond.sum(axis=0)
            down = live * update + d_inner @ self.inner.T + np.where(on, 0, total)
        return Direction(table, inner, bias)


@dataclass
class ByteTagger:
    languages: list[str]
    forward: Direction
    backward: Direction
    output: np.ndarray  # 2H x L
    bias: np.ndarray  # L

    @classmethod
    def new(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 1, dtype=np.float32) -> ByteTagger:
        random = np.random.default_rng(seed)
        layer = lambda: Direction(random.normal(0, 0.3, (256, 3 * hidden)).astype(dtype), random.normal(0, hidden**-0.5, (hidden, 3 * hidden)).astype(dtype), np.zeros(hidden, dtype))
        return cls(languages, layer(), layer(), random.normal(0, 0.3, (2 * hidden, len(languages))).astype(dtype), np.zeros(len(languages), dtype))

    def parameters(self) -> list[np.ndarray]:
        return [self.forward.table, self.forward.inner, self.forward.bias, self.backward.table, self.backward.inner, self.backward.bias, self.output, self.bias]

    def states(self, codes: np.ndarray, mask: np.ndarray, keep: tuple[list, list] | None = None) -> np.ndarray:
        """T x B x 2H: both directions' states at every byte."""
        width = self.forward.inner.shape[0]
        out = np.empty((*codes.shape, 2 * width), self.output.dtype)
        self.forward.run(codes, mask, out[:, :, :width], keep[0] if keep else None)
        self.backward.run(codes[::-1], mask[::-1], out[::-1, :, width:], keep[1] if keep else None)
        return out

    def byte_probabilities(self, codes: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """T x L x B: the distribution at every byte."""
        width = self.forward.inner.shape[0]
        front, rear = (np.empty((len(codes), width, codes.shape[1]), self.output.dtype) for _ in range(2))
        self.forward.read(codes, mask, front)
        self.backward.read(codes[::-1], mask[::-1], rear[::-1])
        logits = np.matmul(self.output[:width].T, front)
        logits += np.matmul(self.output[width:].T, rear)
        logits += self.bias[:, None]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def loss_gradients(self, codes: np.ndarray, mask: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy over all bytes, and its gradients; target: a language for each chunk."""
        kept: tuple[list, list] = ([], [])
        states = self.states(codes, mask, kept)
        logits = states @ self.output + self.bias
        logits -= logits.max(axis=2, keepdims=True)
        probability = np.exp(logits)
        probability /= probability.sum(axis=2, keepdims=True)
        n = mask.sum()
        chosen = np.take_along_axis(probability, np.broadcast_to(target[None, :, None], (*codes.shape, 1)), axis=2)[:, :, 0]
        loss = float(-(np.log(chosen + 1e-12) * mask).sum() / n)
        delta = probability
        np.put_along_axis(delta, np.broadcast_to(target[None, :, None], (*codes.shape, 1)), (chosen - 1)[:, :, None], axis=2)
        delta *= mask[:, :, None] / n
        delta = delta.astype(states.dtype)
        width = self.forward.inner.shape[0]
        down = delta @ self.output.T
        front = self.forward.back(codes, mask, kept[0], down[:, :, :width])
        rear = self.backward.back(codes[::-1], mask[::-1], kept[1], down[::-1, :, width:])
        flat = states.reshape(-1, 2 * width)
        gradients = [front.table, front.inner, front.bias, rear.table, rear.inner, rear.bias, flat.T @ delta.reshape(-1, delta.shape[2]), delta.sum(axis=(0, 1))]
        return loss, gradients

    def document_probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean distribution over all bytes of each document; zeros for an empty one."""
        total = np.zeros((len(offsets) - 1, len(self.languages)))
        sizes = np.diff(offsets)
        parts = -(-sizes // CHUNK)
        owner = np.repeat(np.arange(len(sizes)), parts)
        start = offsets[:-1][owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)) * CHUNK
        length = np.minimum(offsets[1:][owner] - start, CHUNK)
        # Chunks of like length together: almost all blocks are full then.
        order = np.argsort(-length, kind="stable")
        for a in range(0, len(order), BLOCK):
            own = order[a : a + BLOCK]
            steps = np.arange(int(length[own].max()))[:, None]
            mask = steps < length[own]
            codes = data[np.minimum(start[own] + steps, len(data) - 1)]
            summed = (self.byte_probabilities(codes, mask) * mask[:, None, :]).sum(axis=0).T
            np.add.at(total, owner[own], summed)
        return total / np.maximum(sizes, 1)[:, None]


def train(texts: list[tuple[bytes, int]], languages: list[str], steps: int = STEPS, hidden: int = HIDDEN, seed: int = 1) -> ByteTagger:
    """Adam on batches of chunks drawn from the whole texts, with the same share for each language."""
    model = ByteTagger.new(languages, hidden, seed)
    random = np.random.default_rng(seed)
    data = np.frombuffer(b"".join(body for body, _ in texts), np.uint8)
    stops = np.cumsum([len(body) for body, _ in texts])
    parts = np.array([-(-len(body) // CHUNK) for body, _ in texts])
    owner = np.repeat(np.arange(len(texts)), parts)
    start = (stops - [len(body) for body, _ in texts])[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)) * CHUNK
    length = np.minimum(stops[owner] - start, CHUNK)
    target = np.array([label for _, label in texts])[owner]
    by_language = [np.flatnonzero(target == k) for k in range(len(languages))]
    steps_of_chunk = np.arange(CHUNK)[:, None]
    first, second = ([np.zeros_like(p) for p in model.parameters()] for _ in range(2))
    for step in range(1, steps + 1):
        own = np.concatenate([random.choice(x, max(1, BATCH // len(languages))) for x in by_language])
        mask = steps_of_chunk < length[own]
        codes = np.where(mask, data[np.minimum(start[own] + steps_of_chunk, len(data) - 1)], 0).astype(np.uint8)
        _, gradients = model.loss_gradients(codes, mask, target[own])
        norm = np.sqrt(sum(float((g.astype(np.float64) ** 2).sum()) for g in gradients))
        rate = RATE * min(1.0, 3 * (1 - step / (steps + 1)))
        for p, g, m, v in zip(model.parameters(), gradients, first, second, strict=True):
            g = g * min(1.0, 1.0 / (norm + 1e-12))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(p.dtype)
    return model


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> ByteTagger | None:
    """Trains on the whole texts of about SAMPLE_DOCUMENTS documents of each language that aren't held
    out, chosen by a hash; None without labelled text. Every language of the labelled rows is learnt,
    however rare. The driver holds the chosen texts."""
    usable = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where((id_remainder("key", 5) != 0) & F.col("lang").isNotNull() & (F.length("text") > 0))
    sizes = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    part = F.element_at(F.create_map(*[F.lit(x) for name, n in sorted(sizes.items()) for x in (name, min(1 << 20, -(-SAMPLE_DOCUMENTS * (1 << 20) // n)))]), F.col("lang"))
    rows = usable.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < part).select("key", "lang", "text").toPandas().sort_values(["key", "lang", "text"])
    languages = sorted(rows["lang"].unique())
    number = {name: k for k, name in enumerate(languages)}
    return train([(body, number[name]) for body, name in zip(rows["text"].str.encode("utf-8"), rows["lang"], strict=True)], languages)


def predict(docs: DataFrame, model: ByteTagger | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, lang_pred, score (the pooled probability of that language).

    `und` with score 0 if the text is null, has no letter, or nothing was learnt. Whole texts are
    read, in one narrow pass.
    """

    def run(batches):
        for batch in batches:
            texts = [t if t and _LETTER.search(t) else "" for t in batch.column(1).to_pylist()]
            bodies = [t.encode("utf-8") for t in texts]
            offsets = np.cumsum([0, *map(len, bodies)])
            names, scores = ["und"] * len(bodies), np.zeros(len(bodies))
            if model is not None and offsets[-1]:
                pooled = model.document_probabilities(np.frombuffer(b"".join(bodies), np.uint8), offsets)
                best = pooled.argmax(axis=1)
                names = [model.languages[k] if t else "und" for k, t in zip(best.tolist(), texts, strict=True)]
                scores = np.clip(pooled.max(axis=1), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["key", "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)


def byte_labels(docs: DataFrame, model: ByteTagger, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, labels): the likeliest language at every byte, as indexes into model.languages."""

    def run(batches):
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                body = np.frombuffer((t or "").encode("utf-8"), np.uint8)
                found = np.zeros(len(body), np.uint8)
                for a in range(0, len(body), CHUNK):
                    part = body[a : a + CHUNK, None]
                    found[a : a + CHUNK] = model.byte_probabilities(part, np.ones(part.shape, bool))[:, :, 0].argmax(axis=1)
                out.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["key", "labels"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, labels binary").withColumnRenamed("key", key)


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """predict() by a network trained on the rows that aren't held out (crc32 of the id modulo 5 is 0)."""
    found = predict(docs, fit(docs, text, lang, key), text, key)
    return found.withColumn("held_out", F.coalesce(id_remainder(key, 5) == 0, F.lit(False)))
