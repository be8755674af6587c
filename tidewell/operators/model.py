"""The sequence model in numpy: forward pass, backward pass, losses, and training with gradients summed over partitions.

Layers return what they give and a function from the gradient of that to the gradient of their input; weights' gradients
are added up on the way back. One session is a sequence; its windows are read in order.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.config import Network
from tidewell.operators.evaluate import IGNORE

Weights = dict[str, np.ndarray]
Back = Callable[[np.ndarray], np.ndarray]
#: The norm above which gradients are scaled down, and the share of new moments in the running ones.
CLIP_NORM, MOMENTUM = 5.0, 0.1
#: Of the normalisations, never trained by gradients.
RUNNING = ("mean", "var")


def init_weights(net: Network | None = None, seed: int = 0) -> Weights:
    """Small random weights of every layer, by name."""
    n, rng, w = net or Network(), generator(seed), {}

    def dense(name: str, into: int, out: int, *shape: int) -> None:
        w[f"{name}.w"] = (rng.standard_normal((out, into, *shape)) / np.sqrt(into * max(1, int(np.prod(shape))))).astype(np.float32)
        w[f"{name}.b"] = np.zeros(out, np.float32)

    into = n.channels
    for i, c in enumerate(n.filters):
        dense(f"conv{i}", into, c, n.kernel)
        for k, v in (("gain", 1.0), ("shift", 0.0), ("mean", 0.0), ("var", 1.0)):
            w[f"conv{i}.{k}"] = np.full(c, v, np.float32)
        into = c
    dense("embed", into, n.embedding)
    dense("fuse", n.embedding + n.hand, n.fusion)
    w["norm.gain"], w["norm.shift"] = np.ones(n.fusion, np.float32), np.zeros(n.fusion, np.float32)
    into = n.fusion
    for layer in range(n.layers):
        for way in ("forward", "backward"):
            dense(f"lstm{layer}.{way}.x", into, 4 * n.hidden)
            dense(f"lstm{layer}.{way}.h", n.hidden, 4 * n.hidden)
        into = 2 * n.hidden
    for head, out in (("class", n.classes), ("volume", 1)):
        dense(f"{head}.0", into, into // 2)
        dense(f"{head}.1", into // 2, out)
    return w


def generator(seed: int = 1337) -> np.random.Generator:
    """The one source of random numbers that a run takes, so that a seed repeats it."""
    return np.random.default_rng(seed)


def save_weights(path: str, w: Weights) -> None:
    np.savez(path, **w)


def load_weights(path: str) -> Weights:
    with np.load(path) as f:
        return dict(f)


class _Pass:
    """One session through the network. In training, normalisations take the session's own moments and layers drop out."""

    def __init__(self, w: Weights, net: Network, train: np.random.Generator | None = None):
        self.w, self.net, self.train = w, net, train
        self.grads: Weights = {}
        self.moments: Weights = {}

    def add(self, name: str, g: np.ndarray) -> None:
        self.grads[name] = self.grads[name] + g if name in self.grads else g

    def dense(self, name: str, x: np.ndarray) -> tuple[np.ndarray, Back]:
        def back(g: np.ndarray) -> np.ndarray:
            self.add(f"{name}.w", g.T @ x)
            self.add(f"{name}.b", g.sum(axis=0))
            return g @ self.w[f"{name}.w"]

        return x @ self.w[f"{name}.w"].T + self.w[f"{name}.b"], back

    def conv(self, name: str, x: np.ndarray) -> tuple[np.ndarray, Back]:
        """(windows, channels, samples), padded so that the length stays."""
        w = self.w[f"{name}.w"]
        k, (n, c, t) = w.shape[2], x.shape
        half = k // 2
        wide = np.pad(x, ((0, 0), (0, 0), (half, half)))
        views = np.lib.stride_tricks.sliding_window_view(wide, k, axis=2)[:, :, :t]

        def back(g: np.ndarray) -> np.ndarray:
            self.add(f"{name}.w", np.einsum("not,nctk->ock", g, views, optimize=True))
            self.add(f"{name}.b", g.sum(axis=(0, 2)))
            out = np.zeros_like(wide)
            for j in range(k):
                out[:, :, j : j + t] += np.einsum("not,oc->nct", g, w[:, :, j], optimize=True)
            return out[:, :, half : half + t]

        return np.einsum("nctk,ock->not", views, w, optimize=True) + self.w[f"{name}.b"][:, None], back

    def normalised(self, name: str, x: np.ndarray, axes: tuple[int, ...], running: bool) -> tuple[np.ndarray, Back]:
        """Zero mean and unit variance along axes (or by the running moments), then gain and shift."""
        shape = (-1, 1) if running else (-1,)
        gain, shift = self.w[f"{name}.gain"].reshape(shape), self.w[f"{name}.shift"].reshape(shape)
        own = not running or self.train is not None
        mean = x.mean(axis=axes, keepdims=True) if own else self.w[f"{name}.mean"].reshape(shape)
        var = x.var(axis=axes, keepdims=True) if own else self.w[f"{name}.var"].reshape(shape)
        if running and own:
            self.moments |= {f"{name}.mean": mean.ravel(), f"{name}.var": var.ravel()}
        scale = 1 / np.sqrt(var + 1e-5)
        z = (x - mean) * scale
        others = (0, 2) if running else (0,)

        def back(g: np.ndarray) -> np.ndarray:
            self.add(f"{name}.gain", (g * z).sum(axis=others).ravel())
            self.add(f"{name}.shift", g.sum(axis=others).ravel())
            g = g * gain
            return scale * (g - g.mean(axis=axes, keepdims=True) - z * (g * z).mean(axis=axes, keepdims=True)) if own else g * scale

        return z * gain + shift, back

    @staticmethod
    def relu(x: np.ndarray) -> tuple[np.ndarray, Back]:
        return np.maximum(x, 0), lambda g: g * (x > 0)

    @staticmethod
    def halved(x: np.ndarray) -> tuple[np.ndarray, Back]:
        """The larger of every two samples; an odd last one goes."""
        n, c, t = x.shape
        pairs = x[:, :, : t // 2 * 2].reshape(n, c, -1, 2)
        which = pairs.argmax(axis=3)[..., None]

        def back(g: np.ndarray) -> np.ndarray:
            spread = np.zeros_like(pairs)
            np.put_along_axis(spread, which, g[..., None], axis=3)
            return np.pad(spread.reshape(n, c, -1), ((0, 0), (0, 0), (0, t % 2)))

        return np.take_along_axis(pairs, which, axis=3)[..., 0], back

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, Back]:
        backs = []
        for i in range(len(self.net.filters)):
            for step in (lambda v, i=i: self.conv(f"conv{i}", v), lambda v, i=i: self.normalised(f"conv{i}", v, (0, 2), True), self.relu, self.halved):
                x, back = step(x)
                backs.append(back)
        length, shape = x.shape[2], x.shape
        out, last = self.dense("embed", x.mean(axis=2))

        def back(g: np.ndarray) -> np.ndarray:
            g = np.broadcast_to(last(g)[:, :, None] / length, shape)
            for b in reversed(backs):
                g = b(g)
            return g

        return out, back

    def recurrent(self, name: str, x: np.ndarray) -> tuple[np.ndarray, Back]:
        """One direction over one session; gates in the order input, forget, candidate, output."""
        hidden, wh = self.net.hidden, self.w[f"{name}.h.w"]
        into, back_x = self.dense(f"{name}.x", x)
        into = into + self.w[f"{name}.h.b"]
        h, c, kept = np.zeros(hidden, x.dtype), np.zeros(hidden, x.dtype), []
        out = np.empty((len(x), hidden), x.dtype)
        for t in range(len(x)):
            i, f, g, o = np.split(into[t] + wh @ h, 4)
            i, f, g, o = _sigmoid(i), _sigmoid(f), np.tanh(g), _sigmoid(o)
            before, c = (h, c), f * c + i * g
            h = o * np.tanh(c)
            kept.append((*before, i, f, g, o, c))
            out[t] = h

        def back(grad: np.ndarray) -> np.ndarray:
            gates = np.empty((len(x), 4 * hidden), x.dtype)
            dh, dc = np.zeros(hidden, x.dtype), np.zeros(hidden, x.dtype)
            for t in range(len(x) - 1, -1, -1):
                _, c0, i, f, g, o, c = kept[t]
                dh, top = dh + grad[t], np.tanh(c)
                dc = dc + dh * o * (1 - top**2)
                gates[t] = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dc * i * (1 - g**2), dh * top * o * (1 - o)])
                dh, dc = gates[t] @ wh, dc * f
            self.add(f"{name}.h.w", gates.T @ np.stack([k[0] for k in kept]))
            self.add(f"{name}.h.b", gates.sum(axis=0))
            return back_x(gates)

        return out, back

    def both_ways(self, layer: int, x: np.ndarray) -> tuple[np.ndarray, Back]:
        a, back_a = self.recurrent(f"lstm{layer}.forward", x)
        b, back_b = self.recurrent(f"lstm{layer}.backward", x[::-1])
        h = self.net.hidden
        return np.concatenate([a, b[::-1]], axis=1), lambda g: back_a(g[:, :h]) + back_b(g[:, h:][::-1])[::-1]

    def dropped(self, x: np.ndarray) -> tuple[np.ndarray, Back]:
        if self.train is None or not self.net.dropout:
            return x, lambda g: g
        keep = (self.train.random(x.shape) >= self.net.dropout) / (1 - self.net.dropout)
        return x * keep, lambda g: g * keep

    def head(self, name: str, x: np.ndarray) -> tuple[np.ndarray, Back]:
        a, back_a = self.dense(f"{name}.0", x)
        b, back_b = self.relu(a)
        c, back_c = self.dense(f"{name}.1", b)
        return c, lambda g: back_a(back_b(back_c(g)))

    def run(self, frames: np.ndarray, hand: np.ndarray) -> tuple[np.ndarray, np.ndarray, Callable[[np.ndarray, np.ndarray], None]]:
        """Logits and non-negative volumes of one session's windows, in order, and what takes both gradients back."""
        e, back_e = self.encode(frames)
        steps = [lambda x: self.dense("fuse", x), self.relu, lambda x: self.normalised("norm", x, (1,), False)]
        for layer in range(self.net.layers):
            steps.append(lambda x, layer=layer: self.both_ways(layer, x))
            if layer < self.net.layers - 1:
                steps.append(self.dropped)
        x, backs = np.concatenate([e, hand], axis=1), []
        for step in steps:
            x, back = step(x)
            backs.append(back)
        logits, back_l = self.head("class", x)
        raw, back_v = self.head("volume", x)

        def back(grad_logits: np.ndarray, grad_volume: np.ndarray) -> None:
            g = back_l(grad_logits) + back_v((grad_volume * _sigmoid(raw[:, 0]))[:, None])
            for b in reversed(backs):
                g = b(g)
            back_e(g[:, : e.shape[1]])

        return logits, np.logaddexp(0, raw)[:, 0], back


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def encode(w: Weights, frames: np.ndarray, net: Network) -> np.ndarray:
    """(windows, channels, samples) to embeddings: convolutions with normalisation, ReLU and halving, then the mean over time."""
    return _Pass(w, net).encode(frames.astype(np.float32))[0]


def forward(w: Weights, frames: np.ndarray, hand: np.ndarray, net: Network | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Logits and non-negative volumes of one session's windows, in order."""
    return _Pass(w, net or Network()).run(frames, hand)[:2]


@dataclass
class SessionGradient:
    """Of one session: the losses' sums, the weights' gradients and the normalisations' moments."""

    classification: float
    volume: float
    grads: Weights
    moments: Weights


def session_gradient(w: Weights, frames: np.ndarray, hand: np.ndarray, labels: np.ndarray, volume: np.ndarray, scales: tuple[float, float], net: Network, rng: np.random.Generator | None) -> SessionGradient:
    """labels: IGNORE doesn't count; volume: NaN doesn't. scales: what one window's cross-entropy and squared error weigh."""
    run = _Pass(w, net, rng)
    logits, guess, back = run.run(frames, hand)
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    at, measured = np.flatnonzero(labels != IGNORE), ~np.isnan(volume)
    loss = float(-np.log(np.maximum(p[at, labels[at]], 1e-30)).sum())
    gap = np.where(measured, guess - np.where(measured, volume, 0), 0)
    grad = np.zeros_like(p)
    grad[at] = p[at]
    grad[at, labels[at]] -= 1
    back(grad * scales[0], 2 * gap * scales[1])
    return SessionGradient(loss, float((gap**2).sum()), run.grads, run.moments)


def predict(windows: DataFrame, w: Weights, by: str = "session_id", net: Network | None = None) -> DataFrame:
    """(by, window_idx, logits, volume_pred): one session a group, as the recurrence needs its windows in order."""
    sent = windows.sparkSession.sparkContext.broadcast(w)
    kind = windows.schema[by].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("window_idx")
        logits, volume = forward(sent.value, *_stacked(rows), net)
        return pd.DataFrame({by: rows[by], "window_idx": rows["window_idx"], "logits": [x.astype(float).tolist() for x in logits], "volume_pred": volume.astype(float)})

    return windows.select(by, F.col("window_idx").cast("long"), "frames", "hand").groupBy(by).applyInPandas(run, f"`{by}` {kind}, window_idx long, logits array<double>, volume_pred double")


def losses(predicted: DataFrame, logits: str = "logits", label: str = "label", volume_pred: str = "volume_pred", volume: str = "volume", weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """classification (cross-entropy over labelled rows, 0 without any), volume (squared error over rows with a volume, 0 without any), and their weighted sum."""
    top = F.array_max(logits)
    total = F.aggregate(F.transform(logits, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, b: a + b)
    known = F.col(label).isNotNull() & (F.col(label) != IGNORE)
    ce = F.when(known, F.ln(total) + top - F.element_at(logits, F.when(known, F.col(label).cast("int") + 1).otherwise(1)))
    se = F.when(F.col(volume).isNotNull(), (F.col(volume_pred) - F.col(volume)) ** 2)
    got = predicted.agg(F.coalesce(F.avg(ce), F.lit(0.0)).alias("classification"), (F.coalesce(F.sum(se), F.lit(0.0)) / F.greatest(F.count(se), F.lit(1))).alias("volume"))
    return got.withColumn("combined", weights[0] * F.col("classification") + weights[1] * F.col("volume"))


def collate(windows: DataFrame, batch_size: int, by: str = "session_id", arrays: tuple[str, ...] = ("frames", "hand"), label: str = "label", volume: str = "volume") -> DataFrame:
    """Sessions as padded sequences, a row each: batch, length, labels, volume, vol_mask and `arrays`, all as long as the batch's longest session.

    Batches hold batch_size sessions in the order of a hash of their name. Missing labels and padding are IGNORE; missing
    volumes and padding are 0 with mask 0; arrays are padded with nulls.
    """
    known = F.struct("window_idx", F.coalesce(F.col(label).cast("long"), F.lit(IGNORE).cast("long")).alias("label"), F.coalesce(F.col(volume).cast("double"), F.lit(0.0)).alias("volume"), F.col(volume).isNotNull().cast("double").alias("mask"), *arrays)
    rows = windows.groupBy(by).agg(F.array_sort(F.collect_list(known)).alias("_s_")).withColumn("length", F.size("_s_"))
    hashed = F.md5(F.col(by).cast("string").cast("binary"))
    # ranks by the hash's first digits, so that no task numbers all sessions
    bins = rows.select(F.substring(hashed, 1, 3).alias("_bin_")).groupBy("_bin_").agg(F.count(F.lit(1)).alias("_n_"))
    bins = bins.select("_bin_", F.coalesce(F.sum("_n_").over(Window.orderBy("_bin_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before_"))  # 4096 rows at most
    rank = F.row_number().over(Window.partitionBy("_bin_").orderBy("_h_", by)) - 1
    rows = rows.withColumn("_h_", hashed).withColumn("_bin_", F.substring("_h_", 1, 3)).withColumn("_r_", rank).join(F.broadcast(bins), "_bin_")
    rows = rows.withColumn("batch", F.floor((F.col("_r_") + F.col("_before_")) / batch_size).cast("long")).withColumn("_longest_", F.max("length").over(Window.partitionBy("batch")))
    fill = lambda c, value: F.concat(F.transform("_s_", lambda x: x[c]), F.array_repeat(value, F.col("_longest_") - F.col("length")))
    kinds = {c: windows.schema[c].dataType for c in arrays}
    return rows.select(
        "batch", by, "length", fill("label", F.lit(IGNORE).cast("long")).alias("labels"), fill("volume", F.lit(0.0)).alias("volume"), fill("mask", F.lit(0.0)).alias("vol_mask"), *[fill(c, F.lit(None).cast(k)).alias(c) for c, k in kinds.items()]
    )


def sequence_labels(*_: object) -> None:
    """A head that labels every sample is only foreseen."""
    raise NotImplementedError("sample-wise labelling isn't defined")


def _stacked(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    frames = np.stack([np.stack([np.asarray(c, np.float32) for c in f]) for f in rows["frames"]])
    return frames, np.stack([np.asarray(h, np.float32) for h in rows["hand"]])


def gradients(windows: DataFrame, w: Weights, scales: tuple[float, float], net: Network, seed: int, train: bool = True, by: str = "session_id", parts: int = 16) -> tuple[SessionGradient, int]:
    """Sums over all sessions of windows, and how many there are. Each task adds up its sessions, so the driver gets `parts` rows at most."""
    sent = windows.sparkSession.sparkContext.broadcast(w)
    names = [k for k in w if not k.endswith(RUNNING)]
    running = [k for k in w if k.startswith("conv") and k.endswith(RUNNING)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, moments, loss, n = {k: np.zeros(w[k].shape) for k in names}, {k: np.zeros(w[k].shape) for k in running}, [0.0, 0.0], 0
        held: list[pd.DataFrame] = []

        def take() -> None:
            nonlocal n
            rows = pd.concat(held).sort_values("window_idx")
            got = session_gradient(sent.value, *_stacked(rows), rows["label"].fillna(IGNORE).to_numpy(np.int64), rows["volume"].to_numpy(np.float64), scales, net, generator(zlib.crc32(f"{seed}:{rows[by].iloc[0]}".encode())) if train else None)
            for k in names:
                total[k] += got.grads.get(k, 0)
            for k, v in got.moments.items():
                moments[k] += v
            loss[0] += got.classification
            loss[1] += got.volume
            n += 1
            held.clear()

        for batch in batches:  # rows of a session follow one another
            for _, rows in batch.groupby((batch[by] != batch[by].shift()).cumsum()):
                if held and held[0][by].iloc[0] != rows[by].iloc[0]:
                    take()
                held.append(rows)
        if held:
            take()
        if n:
            pack = lambda d, keys: np.concatenate([d[k].ravel() for k in keys] or [np.empty(0)]).astype(np.float64).tobytes()
            yield pd.DataFrame({"n": [n], "c": [loss[0]], "v": [loss[1]], "grads": [pack(total, names)], "moments": [pack(moments, running)]})

    rows = windows.select(by, "window_idx", "frames", "hand", F.col("label").cast("double").alias("label"), F.col("volume").cast("double").alias("volume"))
    got = rows.repartition(parts, by).sortWithinPartitions(by, "window_idx").mapInPandas(run, "n long, c double, v double, grads binary, moments binary").collect()

    def unpack(column: str, keys: list[str]) -> Weights:
        flat = np.sum([np.frombuffer(r[column], np.float64) for r in got], axis=0) if got else np.zeros(sum(w[k].size for k in keys))
        cut = np.split(flat, np.cumsum([w[k].size for k in keys])[:-1]) if keys else []
        return {k: x.reshape(w[k].shape) for k, x in zip(keys, cut, strict=True)}

    return SessionGradient(sum(r["c"] for r in got), sum(r["v"] for r in got), unpack("grads", names), unpack("moments", running)), sum(r["n"] for r in got)


@dataclass(frozen=True)
class Training:
    """Settings of a training run."""

    batch_size: int = 16
    rate: float = 3e-4
    decay: float = 1e-4
    epochs_synthetic: int = 40
    epochs_finetune: int = 20
    seed: int = 1337
    weights: tuple[float, float] = (1.0, 1.0)
    need_labels: bool = True

    @classmethod
    def from_yaml(cls, path: str) -> Training:
        from tidewell.config import load_yaml

        t = load_yaml(path)["training"]
        return cls(int(t["batch_size"]), float(t["lr"]), float(t["weight_decay"]), int(t["epochs_synthetic"]), int(t["epochs_finetune"]), int(t["seed"]), (float(t["loss_weights"]["classification"]), float(t["loss_weights"]["volume"])), bool(t["require_event_labels_for_classifier"]))


class Descent:
    """Adam with decoupled weight decay, on gradients cut to CLIP_NORM."""

    def __init__(self, w: Weights, rate: float, decay: float):
        self.w, self.rate, self.decay, self.step = dict(w), rate, decay, 0
        self.first = {k: np.zeros(v.shape) for k, v in w.items() if not k.endswith(RUNNING)}
        self.second = {k: np.zeros(v.shape) for k, v in w.items() if not k.endswith(RUNNING)}

    def __call__(self, grads: Weights, moments: Weights, sessions: int) -> None:
        self.step += 1
        norm = float(np.sqrt(sum((g**2).sum() for g in grads.values())))
        cut = min(1.0, CLIP_NORM / (norm + 1e-6))
        for k, g in grads.items():
            self.first[k] = 0.9 * self.first[k] + 0.1 * cut * g
            self.second[k] = 0.999 * self.second[k] + 0.001 * (cut * g) ** 2
            move = self.first[k] / (1 - 0.9**self.step) / (np.sqrt(self.second[k] / (1 - 0.999**self.step)) + 1e-8)
            self.w[k] = (self.w[k] * (1 - self.rate * self.decay) - self.rate * move).astype(np.float32)
        for k, m in moments.items():
            self.w[k] = ((1 - MOMENTUM) * self.w[k] + MOMENTUM * m / max(1, sessions)).astype(np.float32)


def fit(windows: DataFrame, w: Weights, settings: Training, epochs: int, net: Network | None = None, classify: bool = True, by: str = "session_id") -> tuple[Weights, list[dict[str, float]]]:
    """Weights after `epochs` over all sessions, and each epoch's mean losses. Every epoch deals the sessions into new batches by a seeded hash."""
    net = net or Network()
    rows = windows.where(F.col("frames").isNotNull())
    known = F.when(F.col("label").isNotNull() & (F.col("label") != IGNORE), 1).otherwise(0)
    sessions = rows.select(by).distinct().count()
    if not sessions:
        raise ValueError("no sessions to train on")
    many = max(1, round(sessions / settings.batch_size))
    descent, history = Descent(w, settings.rate, settings.decay), []
    for epoch in range(epochs):
        dealt = rows.withColumn("_batch_", F.pmod(F.xxhash64(F.col(by).cast("string"), F.lit(settings.seed), F.lit(epoch)), F.lit(many)))
        counts = {r[0]: (r[1], r[2]) for r in dealt.groupBy("_batch_").agg(F.sum(known), F.count("volume")).collect()}  # a row a batch
        seen = [0.0, 0.0, 0.0]
        for batch, (labelled, measured) in sorted(counts.items()):
            scales = (settings.weights[0] / max(1, labelled) if classify else 0.0, settings.weights[1] / max(1, measured))
            got, n = gradients(dealt.where(F.col("_batch_") == batch), descent.w, scales, net, settings.seed + epoch, True, by)
            descent(got.grads, got.moments, n)
            parts = got.classification / max(1, labelled) if classify else 0.0, got.volume / max(1, measured)
            seen = [a + b for a, b in zip(seen, (*parts, settings.weights[0] * parts[0] + settings.weights[1] * parts[1]), strict=True)]
        history.append(dict(zip(("classification", "volume", "loss"), (x / len(counts) for x in seen), strict=True)))
    return descent.w, history


def pretrain(windows: DataFrame, settings: Training | None = None, net: Network | None = None, by: str = "session_id") -> tuple[Weights, list[dict[str, float]]]:
    """A network from scratch on made-up sessions, both heads."""
    settings = settings or Training()
    return fit(windows, init_weights(net, settings.seed), settings, settings.epochs_synthetic, net, True, by)


def finetune(windows: DataFrame, w: Weights, settings: Training | None = None, net: Network | None = None, by: str = "session_id") -> tuple[Weights, list[dict[str, float]], bool]:
    """Go on with real sessions; the class head learns only if any window has a label (or labels aren't needed). Also says whether it did."""
    settings = settings or Training()
    labelled = not settings.need_labels or bool(windows.where(F.col("label").isNotNull() & (F.col("label") != IGNORE)).take(1))
    return (*fit(windows, w, settings, settings.epochs_finetune, net, labelled, by), labelled)
