"""A gated recurrent language model in numpy: truncated backpropagation, class-factored output."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Steps of a window, documents that run side by side in learning and in scoring, and words after which
#: learning starts from an empty state again (scoring never does).
WINDOW, STREAMS, GROUP, SPAN = 32, 192, 384, 2048


def lanes(docs: Iterable[np.ndarray], width: int, start: int) -> Iterator[tuple]:
    """Windows of documents that run side by side: (numbers, came, inputs, words, live), the last three (steps, lanes).

    A document goes through its lane window by window, and the next one takes its place when it ends, so long
    documents hold up no others. ``came`` has each lane's place in the window before, -1 for a new document.
    """
    queue = ((i, d) for i, d in enumerate(docs) if len(d))
    held: list[list] = []
    while True:
        while len(held) < width and (more := next(queue, None)) is not None:
            held.append([*more, 0, -1])
        if not held:
            return
        words, inputs = np.zeros((len(held), WINDOW), np.int64), np.empty((len(held), WINDOW), np.int64)
        sizes = np.empty(len(held), np.int64)
        for lane, (_, doc, at, _) in enumerate(held):
            part = doc[at : at + WINDOW]
            sizes[lane] = len(part)
            words[lane, : len(part)] = part
            inputs[lane, 0] = doc[at - 1] if at else start
        inputs[:, 1:] = words[:, :-1]
        steps = int(sizes.max())
        yield np.array([h[0] for h in held]), np.array([h[3] for h in held]), inputs.T[:steps], words.T[:steps], np.arange(steps)[:, None] < sizes
        held = [[i, doc, at + WINDOW, lane] for lane, (i, doc, at, _) in enumerate(held) if at + WINDOW < len(doc)]


def carried(states: np.ndarray, came: np.ndarray) -> np.ndarray:
    """The states of the lanes of a window from those at the end of the window before."""
    out = np.zeros((len(came), states.shape[1]), np.float32)
    old = came >= 0
    out[old] = states[came[old]]
    return out


class Model:
    """Words 0..n-1 by falling frequency, in equal classes of neighbours; word n stands for every rarer one.

    log P(word) = log P(class | state) + log P(word | class, state); the last class is the rarer words',
    and tells them apart no further. The state starts at zero with a document, before any word.
    """

    def __init__(self, n_words: int, class_size: int = 64, width: int = 32, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.n, self.size, self.width = n_words, class_size, width
        self.classes = -(-n_words // class_size)
        normal = lambda *shape: (rng.normal(size=shape) * 0.1).astype(np.float32)
        zeros = lambda *shape: np.zeros(shape, np.float32)
        self.p = {
            "embed": normal(n_words + 2, width), "wx": normal(width, 3 * width), "wh": normal(width, 2 * width), "wg": normal(width, width), "b": zeros(3 * width),
            "class": normal(width, self.classes + 1), "class_b": zeros(self.classes + 1),
            "word": normal(self.classes, width, class_size), "word_b": zeros(self.classes, class_size),
        }
        self.start = n_words + 1
        filled = n_words - (self.classes - 1) * class_size
        self.p["word_b"][-1, filled:] = -1e9  # places that no word has
        self.squares = {k: np.full_like(v, 1e-6) for k, v in self.p.items()}

    def _class(self, words: np.ndarray) -> np.ndarray:
        return np.where(words < self.n, words // self.size, self.classes)

    # One window

    def forward(self, inputs: np.ndarray, h: np.ndarray, keep: bool = False, table: np.ndarray | None = None) -> tuple[np.ndarray, list]:
        """Hidden states (steps, streams, width) before each word is predicted; the gates of all steps for the way back.

        ``table`` holds every word's share of the gates, if it was made beforehand."""
        d = self.width
        x = (self.shares() if table is None else table)[inputs]
        states = np.empty((*inputs.shape, d), np.float32)
        tape = [np.empty((*inputs.shape, n * d), np.float32) for n in (2, 1)] if keep else []
        wh, wg = self.p["wh"] * np.float32(0.5), self.p["wg"]  # sigmoid(x) = (1 + tanh(x / 2)) / 2
        for t, xt in enumerate(x):
            zr = h @ wh
            zr += xt[:, : 2 * d]
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            g = (zr[:, d:] * h) @ wg
            g += xt[:, 2 * d :]
            np.tanh(g, out=g)
            if keep:
                tape[0][t], tape[1][t] = zr, g
            new = states[t]
            np.subtract(g, h, out=new)
            new *= zr[:, :d]
            new += h
            h = new
        return states, tape

    def shares(self) -> np.ndarray:
        """Every word's share of the gates, that of the sigmoids halved."""
        table = self.p["embed"] @ self.p["wx"] + self.p["b"]
        table[:, : 2 * self.width] *= 0.5
        return table

    def log_probs(self, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Natural log probability of each word (n: a rarer one) after its state."""
        p = self.p
        group = self._class(words)
        out = _softmax(states, p["class"], p["class_b"], group)[2]
        order, starts = _runs(group)
        states, places, own = states[order], words[order] % self.size, np.zeros_like(out)
        for c, lo, hi in _spans(group[order], starts):
            if c < self.classes:
                own[lo:hi] = _softmax(states[lo:hi], p["word"][c], p["word_b"][c], places[lo:hi])[2]
        out[order] += own
        return out

    # Training

    def gradients(self, inputs: np.ndarray, words: np.ndarray, live: np.ndarray, h: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Summed loss of the live places of a window, mean gradients, and the state to carry on."""
        p, d = self.p, self.width
        states, tape = self.forward(inputs, h, keep=True)
        flat, target, weight = states.reshape(-1, d), words.ravel(), live.ravel().astype(np.float32)
        scale = 1 / max(1.0, float(weight.sum()))
        grads = {k: np.zeros_like(v) for k, v in p.items()}
        group = self._class(target)
        at = np.arange(len(target))
        err, total, own = _softmax(flat, p["class"], p["class_b"], group)
        err *= (weight * scale / total)[:, None]
        err[at, group] -= weight * scale
        grads["class"], grads["class_b"], back = flat.T @ err, err.sum(axis=0), err @ p["class"].T
        order, starts = _runs(group)
        ordered, places, share = flat[order], target[order] % self.size, weight[order] * scale
        below, inside = np.zeros_like(ordered), np.zeros_like(own)
        for c, lo, hi in _spans(group[order], starts):
            if c < self.classes:
                err, total, inside[lo:hi] = _softmax(ordered[lo:hi], p["word"][c], p["word_b"][c], places[lo:hi])
                err *= (share[lo:hi] / total)[:, None]
                err[at[: hi - lo], places[lo:hi]] -= share[lo:hi]
                grads["word"][c], grads["word_b"][c] = ordered[lo:hi].T @ err, err.sum(axis=0)
                np.matmul(err, p["word"][c].T, out=below[lo:hi])
        back[order] += below
        loss = -float((own * weight).sum() + (inside * weight[order]).sum())
        back = back.reshape(states.shape)
        later = np.zeros_like(h)
        at_x = np.empty((*inputs.shape, 3 * d), np.float32)
        befores = np.concatenate([h[None], states[:-1]])
        zr, g = tape
        z, r = np.ascontiguousarray(zr[..., :d]), np.ascontiguousarray(zr[..., d:])
        resets, stay = r * befores, 1 - z
        slope_g, slope_z, slope_r = z * (1 - g * g), (g - befores) * z * stay, resets * (1 - r)  # of all steps at once
        wg, wh = np.ascontiguousarray(p["wg"].T), np.ascontiguousarray(p["wh"].T)
        for t in range(len(inputs) - 1, -1, -1):
            later += back[t]
            step = at_x[t]
            to_g = later * slope_g[t]
            to_rh = to_g @ wg
            step[:, 2 * d :] = to_g
            np.multiply(later, slope_z[t], out=step[:, :d])
            np.multiply(to_rh, slope_r[t], out=step[:, d : 2 * d])
            later *= stay[t]
            to_rh *= r[t]
            later += to_rh
            later += step[:, : 2 * d] @ wh
        at_x = at_x.reshape(-1, 3 * d)
        grads["wg"] = resets.reshape(-1, d).T @ at_x[:, 2 * d :]
        grads["wh"] = befores.reshape(-1, d).T @ at_x[:, : 2 * d]
        grads["b"] = at_x.sum(axis=0)
        order, starts = _runs(inputs.ravel())
        seen = inputs.ravel()[order[starts]]
        of_word = np.add.reduceat(at_x[order], starts, axis=0)
        grads["wx"] = p["embed"][seen].T @ of_word
        grads["embed"][seen] = of_word @ p["wx"].T
        return loss, grads, states[-1]

    def learn(self, docs: Iterable[np.ndarray], rate: float = 0.1, clip: float = 1.0) -> tuple[float, int]:
        """One pass of Adagrad over windows of the documents, every word of them. Loss and words.

        A document's state is carried from window to window; after SPAN words the next ones run beside it, so that
        one long document doesn't run alone at the end."""
        total, seen = 0.0, 0
        states = np.zeros((0, self.width), np.float32)
        spans = (doc[at : at + SPAN] for doc in docs for at in range(0, len(doc), SPAN))
        for _, came, inputs, words, live in lanes(spans, STREAMS, self.start):
            loss, grads, states = self.gradients(inputs, words, live, carried(states, came))
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for k, g in grads.items():
                g *= min(1.0, clip / (norm + 1e-9))
                self.squares[k] += g * g
                self.p[k] -= rate * g / np.sqrt(self.squares[k])
            total, seen = total + loss, seen + int(live.sum())
        return total, seen

    def train(self, docs: list[np.ndarray], passes: int = 2, rate: float = 0.1, clip: float = 1.0) -> list[float]:
        """Some passes over the documents, longest first; the mean loss of each."""
        queue = sorted(docs, key=len, reverse=True)
        losses = [self.learn(queue, rate, clip) for _ in range(passes)]
        return [loss / max(1, seen) for loss, seen in losses]

    # Averaging

    def to_vector(self) -> np.ndarray:
        """Parameters and sums of squared gradients as one vector, so that models can be averaged."""
        return np.concatenate([x[k].ravel() for x in (self.p, self.squares) for k in sorted(self.p)])

    def from_vector(self, values: np.ndarray) -> None:
        at = 0
        for x in (self.p, self.squares):
            for k in sorted(self.p):
                x[k] = values[at : at + x[k].size].reshape(x[k].shape).astype(np.float32)
                at += x[k].size

    # Scoring

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of each whole document. The state is carried from window to window, so a document
        of any length takes the memory of one window; the longest documents begin first."""
        out = np.zeros(len(docs))
        table = self.shares()
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        states = np.zeros((0, self.width), np.float32)
        for numbers, came, inputs, words, live in lanes((docs[i] for i in order), GROUP, self.start):
            tape, _ = self.forward(inputs, carried(states, came), table=table)
            logs = np.zeros(words.shape)
            logs[live] = self.log_probs(tape[live], words[live])
            out[[order[i] for i in numbers]] += logs.sum(axis=0)
            states = tape[-1]
        return out


def _runs(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal numbers together, and where each run of them starts."""
    if not len(numbers):
        return np.zeros(0, int), np.zeros(0, int)
    order = np.argsort(numbers.astype(np.uint16) if numbers.max() < 1 << 16 else numbers, kind="stable")
    ordered = numbers[order]
    return order, np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])


def _spans(ordered: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Of each run of equal numbers: the number, where it starts, and where it ends."""
    return zip(ordered[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(ordered)])


def _softmax(states: np.ndarray, weights: np.ndarray, bias: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each state: the exponentials of its scores, their sum, and the log probability of the column ``at``."""
    x = states @ weights
    x += bias
    x -= x.max(axis=1, keepdims=True)
    own = x[np.arange(len(x)), at]
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], x.dtype)
    return x, total, own - np.log(total)
