"""A bidirectional gated recurrent network with attention pooling over words, in numpy.

A word's input is the embedding of its hash bucket beside the mean embedding of its character n-grams, so
that words never seen are read by their parts. Two gated recurrent passes read a window of words; attention
weighs their states; the weighted mean gives one logit. Gradients are written out and tested numerically.
"""

from __future__ import annotations

import numpy as np

WORD_BUCKETS, GRAM_BUCKETS = 1 << 18, 1 << 17
WORD_SIZE, GRAM_SIZE, HIDDEN, ATTENTION = 8, 12, 8, 8
GRAMS = (3, 4, 5)
LENGTH, STEP = 40, 32
SIDES = ("forward", "backward")


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word buckets, gram buckets one after another, number of grams per word). Grams are runs of characters of ``<word>``."""
    import xxhash

    marked = [f"<{w.decode()}>" for w in words]
    buckets = np.array([xxhash.xxh32_intdigest(w) for w in words], np.int64) % WORD_BUCKETS
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(m) for m in marked], np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # characters of the word from here on
    grams, owners = [], []
    mixed = np.zeros(len(codes), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        whole = max(0, len(codes) - n + 1)
        mixed[:whole] = mixed[:whole] * np.uint64(0x100000001B3) + codes[n - 1 :]
        if n in GRAMS:
            at = np.flatnonzero(room >= n)
            hashed = (mixed[at] ^ np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            grams.append((hashed >> np.uint64(40)).astype(np.int64) % GRAM_BUCKETS)
            owners.append(owner[at])
    order = np.argsort(np.concatenate(owners), kind="stable")
    return buckets, np.concatenate(grams)[order], np.bincount(np.concatenate(owners), minlength=len(words))


def new_model(seed: int = 1, dtype=np.float32) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    size = WORD_SIZE + GRAM_SIZE
    shapes = {"word": (WORD_BUCKETS, WORD_SIZE), "gram": (GRAM_BUCKETS, GRAM_SIZE), "a_w": (2 * HIDDEN, ATTENTION), "a_b": (ATTENTION,), "a_v": (ATTENTION,), "o_w": (2 * HIDDEN,), "o_b": (1,)}
    for s in SIDES:
        shapes |= {f"{s}_w": (size, 3 * HIDDEN), f"{s}_b": (3 * HIDDEN,), f"{s}_u": (HIDDEN, 3 * HIDDEN)}
    scale = {"word": 0.1, "gram": 0.3}
    return {k: (np.zeros(v) if k.endswith("_b") else rng.normal(0, scale.get(k, 0.3), v)).astype(dtype) for k, v in shapes.items()}


def inputs(model: dict, feats: tuple) -> np.ndarray:
    words, grams, counts = feats
    if not len(words):
        return np.zeros((0, WORD_SIZE + GRAM_SIZE), model["word"].dtype)
    starts = np.cumsum(counts) - counts
    mean = np.add.reduceat(model["gram"][grams], starts, axis=0) / counts[:, None].astype(model["gram"].dtype)
    return np.concatenate([model["word"][words], mean], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(np.minimum(x, 60, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _pass(u: np.ndarray, gates: np.ndarray, index: np.ndarray, mask: np.ndarray | None, back: bool, trace: list | None) -> np.ndarray:
    """States (time, window, hidden) of one direction; ``gates`` has the input part of each word."""
    n, length = index.shape
    h = np.zeros((n, HIDDEN), gates.dtype)
    states = np.empty((length, n, HIDDEN), gates.dtype)
    for t in range(length - 1, -1, -1) if back else range(length):
        given, own = gates[index[:, t]], h @ u
        zr = given[:, : 2 * HIDDEN] + own[:, : 2 * HIDDEN]
        zr *= 0.5  # the logistic function is a shifted tanh
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        c = r * own[:, 2 * HIDDEN :]
        c += given[:, 2 * HIDDEN :]
        np.tanh(c, out=c)
        new = h - c
        new *= z
        new += c
        if mask is not None:
            new = np.where(mask[:, t, None], new, h)
        if trace is not None:
            trace.append((t, h, z, r, c, own[:, 2 * HIDDEN :]))
        states[t] = h = new
    return states


def logits(model: dict, gates: dict[str, np.ndarray], index: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
    """One logit per window; ``index`` names rows of ``gates``, ``mask`` the words that are there (None: all)."""
    states = np.concatenate([_pass(model[f"{s}_u"], gates[s], index, mask, s == "backward", None) for s in SIDES], axis=2)
    weight = np.tanh(states @ model["a_w"] + model["a_b"]) @ model["a_v"]
    if mask is not None:
        weight = np.where(mask.T, weight, -1e9)
    weight = np.exp(weight - weight.max(axis=0))
    weight /= weight.sum(axis=0)
    return np.einsum("tn,tnh,h->n", weight, states, model["o_w"], optimize=True) + model["o_b"][0]


def gates_of(model: dict, x: np.ndarray) -> dict[str, np.ndarray]:
    return {s: x @ model[f"{s}_w"] + model[f"{s}_b"] for s in SIDES}


def gradients(model: dict, feats: tuple, index: np.ndarray, mask: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
    """Weighted mean cross entropy of windows and its gradient; embeddings as (rows, values)."""
    x = inputs(model, feats)
    gates = gates_of(model, x)
    traces = {s: [] for s in SIDES}
    states = np.concatenate([_pass(model[f"{s}_u"], gates[s], index, mask, s == "backward", traces[s]) for s in SIDES], axis=2)
    inner = np.tanh(states @ model["a_w"] + model["a_b"])
    score = np.where(mask.T, inner @ model["a_v"], -1e9)
    attend = np.exp(score - score.max(axis=0))
    attend /= attend.sum(axis=0)
    pooled = np.einsum("tn,tnh->nh", attend, states)
    logit = pooled @ model["o_w"] + model["o_b"][0]
    loss = float((weight * (np.logaddexp(0, logit) - label * logit)).sum() / weight.sum())
    d_logit = (weight * (_sigmoid(logit.copy()) - label) / weight.sum()).astype(x.dtype)
    grad = {"o_w": pooled.T @ d_logit, "o_b": d_logit.sum(keepdims=True)}
    d_pooled = d_logit[:, None] * model["o_w"]
    d_states = attend[:, :, None] * d_pooled
    d_attend = np.einsum("tnh,nh->tn", states, d_pooled)
    d_score = attend * (d_attend - (attend * d_attend).sum(axis=0))
    d_inner = d_score[:, :, None] * model["a_v"] * (1 - inner * inner)
    grad["a_v"] = np.einsum("tn,tna->a", d_score, inner)
    grad["a_w"] = np.einsum("tnh,tna->ha", states, d_inner, optimize=True)
    grad["a_b"] = d_inner.sum(axis=(0, 1))
    d_states = d_states + d_inner @ model["a_w"].T
    d_x = np.zeros_like(x)
    for k, s in enumerate(SIDES):
        u, d_u = model[f"{s}_u"], np.zeros_like(model[f"{s}_u"])
        d_gates = np.zeros_like(gates[s])
        d_h = np.zeros((len(index), HIDDEN), x.dtype)
        for t, h, z, r, c, own in reversed(traces[s]):
            d_h = d_h + d_states[t, :, k * HIDDEN : (k + 1) * HIDDEN]
            there = mask[:, t, None]
            d_new = np.where(there, d_h, 0)
            d_c = d_new * (1 - z) * (1 - c * c)
            d_z = d_new * (h - c) * z * (1 - z)
            d_r = d_c * own * r * (1 - r)
            d_own = np.concatenate([d_z, d_r, d_c * r], axis=1)
            np.add.at(d_gates, index[:, t], np.concatenate([d_z, d_r, d_c], axis=1))
            d_u += h.T @ d_own
            d_h = np.where(there, d_new * z, d_h) + d_own @ u.T
        grad[f"{s}_u"], grad[f"{s}_w"], grad[f"{s}_b"] = d_u, x.T @ d_gates, d_gates.sum(axis=0)
        d_x += d_gates @ model[f"{s}_w"].T
    words, grams, counts = feats
    per_gram = np.repeat(d_x[:, WORD_SIZE:] / counts[:, None].astype(x.dtype), counts, axis=0)
    for name, rows, values in (("word", words, d_x[:, :WORD_SIZE]), ("gram", grams, per_gram)):
        touched, place = np.unique(rows, return_inverse=True)
        total = np.zeros((len(touched), values.shape[1]), values.dtype)
        np.add.at(total, place, values)
        grad[name] = (touched, total)
    return loss, grad


class Adam:
    """Adam steps; of the embeddings only the rows that a batch touched move."""

    def __init__(self, model: dict, rate: float):
        self.rate, self.t = rate, 0
        self.m = {k: np.zeros_like(v) for k, v in model.items()}
        self.v = {k: np.zeros_like(v) for k, v in model.items()}

    def step(self, model: dict, grad: dict) -> None:
        self.t += 1
        parts = {k: g if isinstance(g, tuple) else (slice(None), g) for k, g in grad.items()}
        norm = np.sqrt(sum(float((g * g).sum()) for _, g in parts.values()))
        shrink = min(1.0, 1.0 / max(norm, 1e-9))
        rate = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, (rows, g) in parts.items():
            g = g * shrink
            m, v = self.m[k][rows] * 0.9 + 0.1 * g, self.v[k][rows] * 0.999 + 0.001 * g * g
            self.m[k][rows], self.v[k][rows] = m, v
            model[k][rows] -= (rate * m / (np.sqrt(v) + 1e-8)).astype(model[k].dtype)


def windows(n: int) -> list[int]:
    """Starts of the overlapping windows of ``n`` words: the last one ends at the last word."""
    if n <= LENGTH:
        return [0] if n else []
    return [*range(0, n - LENGTH, STEP), n - LENGTH]


def train(samples: list[tuple[list[list[bytes]], int]], epochs: int = 4, rate: float = 0.01, batch: int = 192, seed: int = 1) -> dict[str, np.ndarray]:
    """A model from documents (windows of words, label).

    A marked document's windows all count as marked at first; after two rounds those the model finds harmless
    (below 0.3) no longer do, as few windows hold what the document was marked for.
    """
    model = new_model(seed)
    flat = [(w, y) for doc, y in samples for w in doc if w]
    if not flat or len({y for _, y in flat}) < 2:
        return model
    known: dict[bytes, int] = {}
    index = np.zeros((len(flat), LENGTH), np.int64)
    mask = np.zeros((len(flat), LENGTH), bool)
    for i, (words, _) in enumerate(flat):
        index[i, : len(words)] = [known.setdefault(w, len(known)) for w in words]
        mask[i, : len(words)] = True
    buckets, grams, counts = features(list(known))
    ends = np.cumsum(counts)
    label = np.array([y for _, y in flat], np.float32)
    weight = np.where(label > 0, 0.5 / max(label.sum(), 1), 0.5 / max((1 - label).sum(), 1)).astype(np.float32) * len(flat)
    adam, rng = Adam(model, rate), np.random.default_rng(seed)
    use = np.ones(len(flat), np.float32)
    for epoch in range(epochs):
        if epoch >= 2:
            chance = 1 / (1 + np.exp(-window_logits(model, (buckets, grams, counts), index, mask)))
            use = np.where((label > 0) & (chance < 0.3), 0, 1).astype(np.float32)
        adam.rate = rate * (1 - epoch / epochs) + rate / 10
        order = rng.permutation(np.flatnonzero(use))
        for low in range(0, len(order), batch):
            rows = order[low : low + batch]
            local, inverse = np.unique(np.where(mask[rows], index[rows], index[rows][0, 0]), return_inverse=True)
            own = np.concatenate([grams[ends[i] - counts[i] : ends[i]] for i in local])
            _, grad = gradients(model, (buckets[local], own, counts[local]), inverse.reshape(len(rows), LENGTH), mask[rows], label[rows], weight[rows])
            adam.step(model, grad)
    return model


def window_logits(model: dict, feats: tuple, index: np.ndarray, mask: np.ndarray, block: int = 4096) -> np.ndarray:
    gates = gates_of(model, inputs(model, feats))
    return np.concatenate([logits(model, gates, index[i : i + block], mask[i : i + block]) for i in range(0, len(index), block)])


class Scorer:
    """Window logits of whole texts; remembers the gates of words it has met, up to a bound."""

    REMEMBERED = 150_000
    BLOCK = 4096

    def __init__(self, model: dict):
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.gates = {s: np.zeros((1 << 12, 3 * HIDDEN), np.float32) for s in SIDES}

    def _learn(self, new: list[bytes]) -> None:
        first, need = len(self.known), len(self.known) + len(new)
        for s in SIDES:
            if need > len(self.gates[s]):
                self.gates[s] = np.concatenate([self.gates[s], np.zeros((max(need, 2 * len(self.gates[s])) - len(self.gates[s]), 3 * HIDDEN), np.float32)])
        for low in range(0, len(new), 20_000):
            part = new[low : low + 20_000]
            for s, g in gates_of(self.model, inputs(self.model, features(part))).items():
                self.gates[s][first + low : first + low + len(part)] = g
        self.known.update(zip(new, range(first, need), strict=True))

    def score(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Per text the logits of all its windows, in order; none for a text without words."""
        if len(self.known) > self.REMEMBERED:
            self._reset()
        fresh = set().union(*texts).difference(self.known) if texts else set()
        self._learn(sorted(fresh))
        out: list[np.ndarray] = [np.empty(0, np.float32)] * len(texts)
        long, short = [i for i, t in enumerate(texts) if len(t) >= LENGTH], [i for i, t in enumerate(texts) if 0 < len(t) < LENGTH]
        if long:
            flat = np.fromiter((self.known[w] for i in long for w in texts[i]), np.int64, sum(len(texts[i]) for i in long))
            sizes = np.array([len(texts[i]) for i in long])
            starts = [np.array(windows(n)) + first for n, first in zip(sizes, np.cumsum(sizes) - sizes, strict=True)]
            every, many = np.concatenate(starts), np.cumsum([len(s) for s in starts])[:-1]
            blocks = [logits(self.model, self.gates, flat[every[k : k + self.BLOCK, None] + np.arange(LENGTH)], None) for k in range(0, len(every), self.BLOCK)]
            for i, values in zip(long, np.split(np.concatenate(blocks), many), strict=True):
                out[i] = values
        if short:
            index, mask = np.zeros((len(short), LENGTH), np.int64), np.zeros((len(short), LENGTH), bool)
            for k, i in enumerate(short):
                index[k, : len(texts[i])], mask[k, : len(texts[i])] = [self.known[w] for w in texts[i]], True
            for i, value in zip(short, logits(self.model, self.gates, index, mask), strict=True):
                out[i] = np.array([value])
        return out
