"""A character-level bidirectional LSTM with CRF transitions, in numpy."""

from dataclasses import dataclass, field

import numpy as np

# padding, then every printable ASCII character but digits, which share a class, and the line break;
# other characters of the first plane by case, then all the rest
OWN = "\0\n" + "".join(chr(c) for c in range(32, 127) if not 48 <= c <= 57)
DIGIT, LOWER, UPPER, OTHER = range(len(OWN), len(OWN) + 4)
CLASSES = OTHER + 1


def _class(c: str) -> int:
    if c in OWN:
        return OWN.index(c)
    return DIGIT if "0" <= c <= "9" else LOWER if c.islower() else UPPER if c.isupper() else OTHER


_TABLE = np.array([_class(chr(c)) for c in range(1 << 16)], np.uint8)


def classes(text: str) -> np.ndarray:
    """The class of each character."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < len(_TABLE), _TABLE[np.minimum(points, len(_TABLE) - 1)], OTHER).astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


@dataclass
class Lean:
    """Weights in single precision, for scores only. Characters of a batch lie side by side in memory.

    Logistic gates are 1 / (1 + exp(-x)) and tanh(x) is 2 / (1 + exp(-2x)) - 1: the weights have these
    factors, so one call of exp serves gates and cell. ``joint`` takes the state and the embedding together.
    """

    embed: np.ndarray
    joint: list[np.ndarray]
    out: np.ndarray
    out_b: np.ndarray

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """(time, labels, batch) scores for (batch, time) classes."""
        batch, time = ids.shape
        h = len(self.joint[0]) // 4
        both = np.empty((time, 2 * h, batch), np.float32)
        letters = np.ascontiguousarray(self.embed[ids.T].transpose(0, 2, 1))
        z = np.empty((4 * h, batch), np.float32)
        kept, fresh = np.empty((h, batch), np.float32), np.empty((h, batch), np.float32)
        with np.errstate(over="ignore"):  # exp of a large number: the gate is 0
            for way, weights in enumerate(self.joint):
                known = np.zeros((weights.shape[1], batch), np.float32)
                state, cell = known[:h], np.zeros((h, batch), np.float32)
                for t in range(time) if way == 0 else range(time - 1, -1, -1):
                    known[h:] = letters[t]
                    np.matmul(weights, known, out=z)
                    np.exp(z, out=z)
                    z += 1
                    np.reciprocal(z, out=z)
                    np.multiply(z[h:2 * h], z[3 * h:], out=fresh)
                    fresh *= 2
                    fresh -= z[h:2 * h]
                    cell *= z[:h]
                    cell += fresh
                    np.multiply(cell, -2, out=kept)
                    np.exp(kept, out=kept)
                    kept += 1
                    np.divide(2, kept, out=kept)
                    kept -= 1
                    np.multiply(kept, z[2 * h:3 * h], out=state)
                    both[t, way * h:(way + 1) * h] = state
        return np.matmul(self.out, both) + self.out_b[:, None]


@dataclass
class Tagger:
    """``allowed[i, j]``: whether label j may follow label i. Windows are matrices of classes."""

    labels: int
    allowed: np.ndarray
    width: int = 12
    hidden: int = 20
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        r = np.random.default_rng(3)
        d, h, n = self.width, self.hidden, self.labels

        def matrix(a: int, b: int) -> np.ndarray:
            return r.normal(0, (1 / a) ** 0.5, (a, b))

        self.p = {"embed": r.normal(0, 0.5, (CLASSES, d)), "out": matrix(2 * h, n), "out_b": np.zeros(n),
                  "trans": np.zeros((n, n))}
        for way in "fb":
            self.p |= {f"w{way}": matrix(d, 4 * h), f"u{way}": matrix(h, 4 * h),
                       f"c{way}": np.concatenate([np.ones(h), np.zeros(3 * h)])}
        self.blocked = np.where(self.allowed, 0.0, -1e4)

    def _run(self, x: np.ndarray, way: str, keep: bool):
        """Hidden states (time, batch, hidden) of one direction; gates: forget, input, output, cell."""
        h, steps = self.hidden, range(len(x)) if way == "f" else range(len(x) - 1, -1, -1)
        state = cell = np.zeros((x.shape[1], h))
        out, held = np.empty((*x.shape[:2], h)), []
        inputs = x @ self.p["w" + way] + self.p["c" + way]
        for t in steps:
            z = inputs[t] + state @ self.p["u" + way]
            gates, fresh = _sigmoid(z[:, :3 * h]), np.tanh(z[:, 3 * h:])
            before, last = state, cell
            cell = gates[:, :h] * cell + gates[:, h:2 * h] * fresh
            squashed = np.tanh(cell)
            state = out[t] = gates[:, 2 * h:] * squashed
            if keep:
                held.append((t, gates, fresh, last, squashed, before))
        return out, held

    def emissions(self, ids: np.ndarray, keep: bool = False):
        """(time, batch, labels) scores for (batch, time) classes."""
        x = self.p["embed"][ids.T]
        (f, held_f), (b, held_b) = self._run(x, "f", keep), self._run(x, "b", keep)
        both = np.concatenate([f, b], axis=2)
        return both @ self.p["out"] + self.p["out_b"], (x, both, held_f, held_b)

    def lean(self) -> Lean:
        """The weights as decoding wants them."""
        factors = -np.concatenate([np.ones(3 * self.hidden), np.full(self.hidden, 2.0)])
        joint = [np.concatenate([self.p["u" + w], self.p["w" + w], self.p["c" + w][None]]) * factors for w in "fb"]
        embed = np.concatenate([self.p["embed"], np.ones((CLASSES, 1))], axis=1)
        return Lean(embed.astype(np.float32), [np.ascontiguousarray(j.T, np.float32) for j in joint],
                    np.ascontiguousarray(self.p["out"].T, np.float32), self.p["out_b"].astype(np.float32))

    def decode(self, ids: np.ndarray, lean: Lean | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The windows that may have another label than 0, their Viterbi labels (windows, time) and the
        marginal probability of each of them.

        A path that leaves label 0 gains its emissions and transitions over those of label 0. The most that
        any such stretch can gain is found with one number a character, whatever the labels in it (``_most``);
        where that is below nothing, the path is 0 everywhere and need not be searched for.
        """
        scores = (lean or self.lean()).emissions(ids)
        move = self.p["trans"] + self.blocked
        open_ = np.flatnonzero(self._most(scores, move) > -1e-3)
        e = np.ascontiguousarray(scores[:, :, open_].transpose(0, 2, 1), np.float64)
        if not len(open_):
            return open_, np.zeros((0, len(scores)), np.int64), np.zeros((0, len(scores)))
        score = e[0] + self.blocked[0]  # a window starts as after label 0
        back = np.empty(e.shape, np.int64)
        for t in range(1, len(e)):
            options = score[:, :, None] + move
            back[t] = options.argmax(axis=1)
            score = options.max(axis=1) + e[t]
        path = np.empty(e.shape[:2], np.int64)
        path[-1] = score.argmax(axis=1)
        rows = np.arange(e.shape[1])
        for t in range(len(e) - 1, 0, -1):
            path[t - 1] = back[t][rows, path[t]]
        alpha, beta = self._chain(e, move)
        total = _logsum(alpha[-1], 1)
        sure = np.exp(np.take_along_axis(alpha + beta, path[:, :, None], 2)[:, :, 0] - total)
        return open_, path.T, sure.T

    @staticmethod
    def _most(e: np.ndarray, move: np.ndarray) -> np.ndarray:
        """For each window a bound on what labels other than 0 gain, were any of them to follow any other."""
        gain = e[:, 1:] - e[:, :1]
        other = move - move[0, 0]
        entered = other[:, 1:].max(axis=0) + np.where(other[0, 1:] > -1e3, 0, -1e4)
        first = (gain + entered.astype(np.float32)[:, None]).max(axis=1)
        further = (gain + other[1:, 1:].max(axis=0).astype(np.float32)[:, None]).max(axis=1)
        most = held = first[0]
        for t in range(1, len(e)):
            held = np.maximum(first[t], held + further[t])
            most = np.maximum(most, held)
        return most + max(0.0, float(other[:, 0].max()))

    def _chain(self, e: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log sums over all label sequences up to and from each character."""
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0] + self.blocked[0]
        for t in range(1, len(e)):
            alpha[t] = _logsum(alpha[t - 1][:, :, None] + move, 1) + e[t]
        for t in range(len(e) - 2, -1, -1):
            beta[t] = _logsum(move + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        return alpha, beta

    def gradient(self, ids: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the gold labels (batch, time), and its gradient."""
        e, (x, both, held_f, held_b) = self.emissions(ids, keep=True)
        steps, batch, n = e.shape
        move, gold = self.p["trans"] + self.blocked, gold.T
        rows = np.arange(batch)
        alpha, beta = self._chain(e, move)
        total = _logsum(alpha[-1], 1)
        marginal = np.exp(alpha + beta - total[None, :, None])
        path = sum(e[t][rows, gold[t]] for t in range(steps))
        path = path + sum(move[gold[t - 1], gold[t]] for t in range(1, steps))
        g: dict[str, np.ndarray] = {}
        pairs = np.exp(alpha[:-1, :, :, None] + move + (e[1:] + beta[1:])[:, :, None, :]
                       - total[None, :, None, None]).sum(axis=(0, 1))
        np.subtract.at(pairs, (gold[:-1].ravel(), gold[1:].ravel()), 1.0)
        g["trans"] = pairs / batch
        d_e = marginal
        np.subtract.at(d_e, (np.arange(steps)[:, None], rows[None, :], gold), 1.0)
        d_e = d_e / batch
        g["out"] = both.reshape(-1, both.shape[2]).T @ d_e.reshape(-1, n)
        g["out_b"] = d_e.sum(axis=(0, 1))
        d_both = d_e @ self.p["out"].T
        d_x = np.zeros_like(x)
        for way, held, part in (("f", held_f, d_both[:, :, :self.hidden]),
                                ("b", held_b, d_both[:, :, self.hidden:])):
            d_x += self._back(x, way, held, part, g)
        g["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(g["embed"], ids.T.ravel(), d_x.reshape(-1, self.width))
        return float((total - path).mean()), g

    def _back(self, x: np.ndarray, way: str, held: list, d_out: np.ndarray, g: dict) -> np.ndarray:
        h, u = self.hidden, self.p["u" + way]
        d_z = np.empty((*x.shape[:2], 4 * h))
        g_u = np.zeros_like(u)
        d_state = d_cell = np.zeros((x.shape[1], h))
        for t, gates, fresh, last, squashed, before in reversed(held):
            forget, take, give = gates[:, :h], gates[:, h:2 * h], gates[:, 2 * h:]
            d_h = d_out[t] + d_state
            d_c = d_cell + d_h * give * (1 - squashed ** 2)
            d_gates = np.concatenate([d_c * last, d_c * fresh, d_h * squashed], axis=1)
            d_z[t] = np.concatenate([d_gates * gates * (1 - gates), d_c * take * (1 - fresh ** 2)], axis=1)
            g_u += before.T @ d_z[t]
            d_state, d_cell = d_z[t] @ u.T, d_c * forget
        flat = d_z.reshape(-1, 4 * h)
        g["u" + way], g["c" + way] = g_u, flat.sum(axis=0)
        g["w" + way] = x.reshape(-1, self.width).T @ flat
        return d_z @ self.p["w" + way].T

    def fit(self, ids: np.ndarray, gold: np.ndarray, epochs: int, batch: int = 32, rate: float = 0.02) -> float:
        """Adam over shuffled batches, with steps that shrink to a tenth; returns the loss of the last epoch."""
        order, step, loss = np.random.default_rng(5), 0, 0.0
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for epoch in range(epochs):
            pace = rate * (1 - 0.9 * epoch / epochs)
            shuffled, losses = order.permutation(len(ids)), []
            for at in range(0, len(ids), batch):
                chosen = shuffled[at:at + batch]
                value, g = self.gradient(ids[chosen], gold[chosen])
                losses.append(value)
                step += 1
                norm = sum(float((v * v).sum()) for v in g.values()) ** 0.5
                for k, v in g.items():
                    v = v * min(1.0, 5.0 / (norm + 1e-9))
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.99 * second[k] + 0.01 * v * v
                    self.p[k] = self.p[k] - pace * (first[k] / (1 - 0.9 ** step)) / (
                        np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)
            loss = float(np.mean(losses)) if losses else 0.0
        return loss
