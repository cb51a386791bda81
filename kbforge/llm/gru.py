"""A gated recurrent language model in numpy with a class-factored output softmax, trained by truncated backpropagation.

Symbols are numbered by falling frequency; symbol 0 is TAIL (every word outside the vocabulary) and makes up class 0
alone, the others form classes of CLASS symbols. P(symbol | state) = P(class | state) * P(symbol | class, state).
"""

from __future__ import annotations

import numpy as np

HIDDEN, CLASS = 16, 128
#: Lanes and steps of a window of backpropagation, and windows that are dealt to the lanes at a time.
LANES, WINDOW, PORTION = 512, 16, 8
#: Lanes of the first portion; each further one has twice as many, up to LANES.
FIRST_LANES = 32
TAIL, END = 0, 1
#: Rows whose class logits are held at a time: they stay in a core's cache.
BLOCK = 1024


class Gru:
    """Parameters: Wx input rows (gates z, r, n, biases included), U recurrent, Wc and bc classes, Wo and bo symbols within classes."""

    NAMES = ("Wx", "U", "Wc", "bc", "Wo", "bo")

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params
        self.classes = params["bc"].shape[0] - 1

    @staticmethod
    def fresh(counts: np.ndarray, hidden: int = HIDDEN, seed: int = 5) -> "Gru":
        """counts of each symbol in training; the output biases start at the unigram frequencies."""
        rng = np.random.default_rng(seed)
        n = len(counts)
        groups = max(1, -(-(n - 1) // CLASS))
        smooth = np.full(groups * CLASS, -30.0, np.float64)
        smooth[: n - 1] = np.log(counts[1:] + 0.5)
        bo = smooth.reshape(groups, CLASS)
        per = np.logaddexp.reduce(bo, axis=1)
        bc = np.concatenate([[np.log(counts[0] + 0.5)], per])
        bc -= np.logaddexp.reduce(bc)
        wx = rng.normal(0, 0.1, (n, 3 * hidden))
        wx[:, :hidden] += 0.5  # the update gate starts half open towards memory
        params = {
            "Wx": wx, "U": rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)), "Wc": rng.normal(0, 0.05, (hidden, groups + 1)), "bc": bc,
            "Wo": rng.normal(0, 0.05, (groups, hidden, CLASS)), "bo": bo - per[:, None],
        }
        return Gru({k: v.astype(np.float32) for k, v in params.items()})

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.NAMES])

    def with_flat(self, flat: np.ndarray) -> "Gru":
        out, at = {}, 0
        for k in self.NAMES:
            n = self.p[k].size
            out[k] = flat[at : at + n].reshape(self.p[k].shape).astype(np.float32)
            at += n
        return Gru(out)

    def step(self, a: np.ndarray, h: np.ndarray, ut: np.ndarray) -> tuple[np.ndarray, tuple]:
        """a: what the inputs bring to each gate, h: the states; a column a lane, so that every gate is one piece of memory. ut: U transposed."""
        n = len(h)
        g = ut @ h
        zr = a[: 2 * n] + g[: 2 * n]
        np.tanh(np.multiply(zr, 0.5, out=zr), out=zr)
        np.add(np.multiply(zr, 0.5, out=zr), 0.5, out=zr)
        z, r, gn = zr[:n], zr[n:], g[2 * n :]
        new = r * gn
        np.tanh(np.add(new, a[2 * n :], out=new), out=new)
        out = h - new
        np.add(np.multiply(out, z, out=out), new, out=out)
        return out, (h, z, r, new, gn)

    def inputs(self, xs: np.ndarray) -> np.ndarray:
        """[T, gates, B] of symbols [T, B]."""
        return np.ascontiguousarray(self.p["Wx"].take(xs, axis=0).transpose(0, 2, 1))

    def _by_class(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]], np.ndarray]:
        """Class of each symbol, the order that sorts by it, (class, from, to) of the runs but class 0, and places within classes in that order."""
        c = (y + CLASS - 1) // CLASS
        order = np.argsort(c.astype(np.int16), kind="stable")
        cut = np.searchsorted(c[order], np.arange(self.classes + 2)).tolist()
        return c, order, [(k, cut[k], cut[k + 1]) for k in range(1, self.classes + 1) if cut[k] < cut[k + 1]], (y[order] - 1) % CLASS

    def log_probs(self, hs: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log P(y | state) for rows of states."""
        c, order, runs, place = self._by_class(y)
        out, inside = np.empty(len(y), hs.dtype), np.zeros(len(y), hs.dtype)
        wc = np.vstack([self.p["Wc"], self.p["bc"]])
        hs = _with_one(hs)
        for a in range(0, len(y), BLOCK):
            logits = hs[a : a + BLOCK] @ wc
            out[a : a + BLOCK] = logits[np.arange(len(logits)), c[a : a + BLOCK]] - _lse(logits)
        own = hs[order]
        wo = np.concatenate([self.p["Wo"], self.p["bo"][:, None]], axis=1)
        for k, first, last in runs:
            for a in range(first, last, BLOCK):
                b = min(a + BLOCK, last)
                inner = own[a:b] @ wo[k - 1]
                inside[a:b] = inner[np.arange(b - a), place[a:b]] - _lse(inner)
        out[order] += inside
        return out

    def score(self, docs: list[np.ndarray], window: int = 32, lanes: int = 2048) -> np.ndarray:
        """Natural log probability of whole documents, each an array of symbols with END last. State is carried from window to window."""
        total = np.zeros(len(docs))
        ut = np.ascontiguousarray(self.p["U"].T)
        order = np.argsort([-len(d) for d in docs], kind="stable")
        for at in range(0, len(order), lanes):
            own = order[at : at + lanes]
            lens = np.array([len(docs[i]) for i in own])
            h = np.zeros((self.p["U"].shape[0], len(own)), np.float32)
            last = np.full(len(own), END, np.int64)
            for t0 in range(0, int(lens[0]) if len(lens) else 0, window):
                live = int(np.searchsorted(-lens, -t0, "left"))  # lens > t0: a prefix, for lens fall
                own, lens, h, last = own[:live], lens[:live], h[:, :live], last[:live]
                ys = np.zeros((live, window), np.int64)
                for k, i in enumerate(own):
                    part = docs[i][t0 : t0 + window]
                    ys[k, : len(part)] = part
                states = np.empty((window, *h.shape), np.float32)
                xs = np.vstack([last, ys.T[:-1]])
                for t in range(window):
                    h, _ = self.step(self.inputs(xs[t : t + 1])[0], h, ut)
                    states[t] = h
                last = ys[:, -1]
                valid = np.arange(window)[None, :] < (lens - t0)[:, None]
                lp = self.log_probs(np.ascontiguousarray(states.transpose(2, 0, 1))[valid], ys[valid])
                total[own] += np.bincount(np.repeat(np.arange(live), valid.sum(1)), lp, live)
        return total

    def gradients(self, xs: np.ndarray, ys: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Loss per symbol, gradients and last state over a window of lanes [T, B]; fresh marks the steps at which a document begins (state 0).
        Of Wx come the rows that occur, "rows" naming them; of Wo and bo the classes that occur, "own" naming them."""
        p, steps, size = self.p, len(xs), h.shape[1]
        ut = np.ascontiguousarray(p["U"].T)
        stays = (~fresh).astype(h.dtype)
        h = np.ascontiguousarray(h.T)
        caches, hs, inputs = [], np.empty((steps, *h.shape), h.dtype), self.inputs(xs)
        for t in range(steps):
            h, cache = self.step(inputs[t], h * stays[t], ut)
            caches.append(cache)
            hs[t] = h
        states, y = np.ascontiguousarray(hs.transpose(0, 2, 1)).reshape(-1, size), ys.ravel()
        n = len(y)
        c, order, runs, place = self._by_class(y)
        # exponentials aren't divided by their sums one by one: what they are multiplied with is, and a last row of weights stands for the biases
        ones = _with_one(states)
        wc = np.vstack([p["Wc"], p["bc"]])
        gc, dhs, loss = np.zeros_like(wc), np.empty_like(states), 0.0
        for a in range(0, n, BLOCK):
            s = ones[a : a + BLOCK]
            q, part = s @ wc, dhs[a : a + BLOCK]
            loss += _softmax_gradient(q, s, c[a : a + BLOCK], p["Wc"], gc, part)
        gc /= n
        g = {"Wc": gc[:-1], "bc": gc[-1], "own": np.array([k - 1 for k, _, _ in runs], np.int64)}
        own = ones[order]
        down = np.zeros_like(states)
        wo = np.concatenate([p["Wo"], p["bo"][:, None]], axis=1)
        go = np.zeros((len(runs), *wo.shape[1:]), h.dtype)
        for i, (k, first, last) in enumerate(runs):
            for a in range(first, last, BLOCK):
                b = min(a + BLOCK, last)
                s = own[a:b]
                loss += _softmax_gradient(s @ wo[k - 1], s, place[a:b], p["Wo"][k - 1], go[i], down[a:b])
        go /= n
        g["Wo"], g["bo"] = go[:, :-1], go[:, -1]
        dhs[order] += down
        dhs = np.ascontiguousarray((dhs / n).reshape(steps, -1, size).transpose(0, 2, 1))
        dh, g["U"] = np.zeros_like(h), np.zeros_like(p["U"])
        das = np.empty((steps, 3 * size, h.shape[1]), h.dtype)
        for t in range(steps - 1, -1, -1):
            prev, z, r, new, gn = caches[t]
            dh += dhs[t]
            da = das[t]
            less = 1 - z
            dnew = np.multiply(dh, less, out=da[2 * size :])
            dnew *= 1 - new * new
            np.multiply(dh * (prev - new), z * less, out=da[:size])
            dgn = dnew * r
            np.multiply(dgn * (1 - r), gn, out=da[size : 2 * size])
            dg = np.concatenate([da[: 2 * size], dgn])
            g["U"] += prev @ dg.T
            dh *= z
            dh += p["U"] @ dg
            dh *= stays[t]
        x = xs.ravel()
        order = np.argsort(x.astype(np.uint16) if len(p["Wx"]) <= 1 << 16 else x, kind="stable")
        x = x[order]
        at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        # a gate is one piece of memory, in which what comes to a symbol is added up
        das = np.ascontiguousarray(das.transpose(1, 0, 2)).reshape(3 * size, n)
        g["rows"], g["Wx"] = x[at], np.ascontiguousarray(np.add.reduceat(das.take(order, axis=1, mode="clip"), at, axis=1).T)
        return float(loss / n), g, h.T

    def trainer(self, rate: float, lanes: int = LANES, window: int = WINDOW) -> "Trainer":
        return Trainer(self, rate, lanes, window)

    def train(self, docs: list[np.ndarray], lanes: int = LANES, window: int = WINDOW, rate: float = 0.1) -> tuple["Gru", float]:
        """One pass over documents; the trained model and its mean loss."""
        t = self.trainer(rate, lanes, window)
        t.feed(docs)
        t.finish()
        return t.model, t.loss / max(t.seen, 1)


class Trainer:
    """Truncated backpropagation with Adagrad steps over documents that are fed in portions. They lie end to end in one stream;
    enough of it for PORTION windows of all lanes is dealt to the lanes at a time, and every symbol is learned from once. Early
    portions have few lanes, so that many steps are taken while there is most to learn."""

    def __init__(self, model: Gru, rate: float, lanes: int, window: int):
        self.model = Gru({k: v.copy() for k, v in model.p.items()})
        self.squares = {k: np.full_like(v, 1e-4) for k, v in self.model.p.items()}
        self.rate, self.most, self.window = rate, lanes, window
        self.lanes = min(FIRST_LANES, lanes)
        self.held: list[np.ndarray] = []
        self.waiting = self.seen = 0
        self.loss = 0.0

    def feed(self, docs: list[np.ndarray]) -> None:
        for d in docs:
            if len(d):
                self.held.append(d)
                self.waiting += len(d)
            if self.waiting >= PORTION * self.window * self.lanes:
                self._learn(self.lanes)
                self.lanes = min(2 * self.lanes, self.most)

    def finish(self) -> None:
        """Learns from what is left over, in as many lanes as it fills."""
        if self.waiting:
            self._learn(max(1, min(self.lanes, self.waiting // self.window)))

    def _learn(self, lanes: int) -> None:
        ys = np.concatenate(self.held).astype(np.int64)
        fresh = np.zeros(len(ys), bool)
        fresh[np.cumsum([0, *(len(d) for d in self.held[:-1])])] = True
        self.held, self.waiting = [], 0
        xs = np.concatenate([[END], ys[:-1]])
        xs[fresh] = END
        width = -(-len(ys) // lanes)
        # lanes of equal width; the last ones may be a symbol short, which the first symbols of the stream fill
        pad = lanes * width - len(ys)
        lay = lambda v: np.concatenate([v, v[:pad]]).reshape(lanes, width).T
        xs, ys, fresh = lay(xs), lay(ys), lay(fresh).copy()
        fresh[0] = True
        h = np.zeros((lanes, self.model.p["U"].shape[0]), self.model.p["U"].dtype)
        for t in range(0, width, self.window):
            loss, g, h = self.model.gradients(xs[t : t + self.window], ys[t : t + self.window], fresh[t : t + self.window], h)
            n = xs[t : t + self.window].size
            self.loss, self.seen = self.loss + loss * n, self.seen + n
            for k in Gru.NAMES:
                at = g["rows"] if k == "Wx" else g["own"] if k in ("Wo", "bo") else slice(None)
                d = np.clip(g[k], -1, 1)
                q = d * d
                q += self.squares[k][at]
                self.squares[k][at] = q
                d *= self.rate
                d /= np.sqrt(q, out=q)
                self.model.p[k][at] -= d


def _with_one(x: np.ndarray) -> np.ndarray:
    """Rows with a 1 behind them."""
    out = np.empty((len(x), x.shape[1] + 1), x.dtype)
    out[:, :-1], out[:, -1] = x, 1
    return out


def _softmax_gradient(q: np.ndarray, states: np.ndarray, y: np.ndarray, weights: np.ndarray, g: np.ndarray, down: np.ndarray) -> float:
    """Loss of a softmax over logits q, which are used up, for places y. Adds the gradient of the weights (the biases' last) to g; down gets that of the states."""
    np.exp(q, out=q)
    total = _rows_sum(q)
    at = (np.arange(len(y)), y)
    own = q[at]
    q[at] = own - total
    share = 1 / total
    g += (states * share[:, None]).T @ q
    np.multiply(q @ weights.T, share[:, None], out=down)
    return -float(np.log(own * share + 1e-30).sum(dtype=np.float64))


def _rows_sum(x: np.ndarray) -> np.ndarray:
    return x @ np.ones(x.shape[1], x.dtype)


def _lse(x: np.ndarray) -> np.ndarray:
    """Log of the sum of exponentials of each row, which are left in x; logits are moderate, so no maximum is taken out."""
    return np.log(_rows_sum(np.exp(x, out=x)))
