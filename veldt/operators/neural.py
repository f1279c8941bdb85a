"""Small numpy networks with reverse-mode gradients: a two-tower retriever and a causal sequence model.

Training runs in one worker task on the prepared, bounded arrays; scoring is a forward pass in any task.
"""

import numpy as np


class Tape:
    """Values with gradients; just the operations that the two models need."""

    def __init__(self, data, parents=(), back=None):
        self.data, self.parents, self.back = np.asarray(data, float), parents, back
        self.grad = None

    def backward(self) -> None:
        order, seen = [], set()

        def visit(t):
            if id(t) not in seen:
                seen.add(id(t))
                for p in t.parents:
                    visit(p)
                order.append(t)

        visit(self)
        self.grad = np.ones_like(self.data)
        for t in reversed(order):
            if t.back is not None and t.grad is not None:
                for p, g in zip(t.parents, t.back(t.grad)):
                    g = _fit(g, p.data.shape)
                    p.grad = g if p.grad is None else p.grad + g


def _fit(g: np.ndarray, shape: tuple) -> np.ndarray:
    while g.ndim > len(shape):
        g = g.sum(0)
    for axis, n in enumerate(shape):
        if n == 1 and g.shape[axis] != 1:
            g = g.sum(axis, keepdims=True)
    return g


def add(a: Tape, b: Tape) -> Tape:
    return Tape(a.data + b.data, (a, b), lambda g: (g, g))


def mul(a: Tape, b: Tape) -> Tape:
    return Tape(a.data * b.data, (a, b), lambda g: (g * b.data, g * a.data))


def matmul(a: Tape, b: Tape) -> Tape:
    return Tape(a.data @ b.data, (a, b), lambda g: (g @ np.swapaxes(b.data, -1, -2), _fit(np.swapaxes(a.data, -1, -2) @ g, b.data.shape)))


def swap(a: Tape) -> Tape:
    return Tape(np.swapaxes(a.data, -1, -2), (a,), lambda g: (np.swapaxes(g, -1, -2),))


def relu(a: Tape) -> Tape:
    return Tape(np.maximum(a.data, 0), (a,), lambda g: (g * (a.data > 0),))


def take(table: Tape, ids: np.ndarray) -> Tape:
    def back(g):
        out = np.zeros_like(table.data)
        np.add.at(out, ids, g)
        return (out,)

    return Tape(table.data[ids], (table,), back)


def total(a: Tape, axis: int) -> Tape:
    return Tape(a.data.sum(axis), (a,), lambda g: (np.broadcast_to(np.expand_dims(g, axis), a.data.shape),))


def unit(a: Tape) -> Tape:
    n = np.maximum(np.sqrt((a.data**2).sum(-1, keepdims=True)), 1e-12)
    y = a.data / n
    return Tape(y, (a,), lambda g: ((g - y * (g * y).sum(-1, keepdims=True)) / n,))


def softmax(a: Tape) -> Tape:
    e = np.exp(a.data - a.data.max(-1, keepdims=True))
    p = e / e.sum(-1, keepdims=True)
    return Tape(p, (a,), lambda g: (p * (g - (g * p).sum(-1, keepdims=True)),))


def layer_norm(a: Tape, scale: Tape, shift: Tape) -> Tape:
    m = a.data.mean(-1, keepdims=True)
    s = np.sqrt(a.data.var(-1, keepdims=True) + 1e-5)
    x = (a.data - m) / s
    norm = Tape(x, (a,), lambda g: ((g - g.mean(-1, keepdims=True) - x * (g * x).mean(-1, keepdims=True)) / s,))
    return add(mul(norm, scale), shift)


def cross_entropy(logits: Tape, target: np.ndarray, weight: np.ndarray) -> Tape:
    """The weighted mean over rows of -log softmax at the target."""
    z = logits.data - logits.data.max(-1, keepdims=True)
    e = np.exp(z)
    p = e / e.sum(-1, keepdims=True)
    rows, n = np.arange(len(target)), max(weight.sum(), 1e-12)
    loss = -(weight * np.log(np.maximum(p[rows, target], 1e-300))).sum() / n

    def back(g):
        d = p.copy()
        d[rows, target] -= 1
        return (g * d * (weight / n)[:, None],)

    return Tape(loss, (logits,), back)


class Adam:
    def __init__(self, params: dict[str, Tape], rate: float):
        self.p, self.rate, self.t = params, rate, 0
        self.m, self.v = ({k: np.zeros_like(t.data) for k, t in params.items()} for _ in range(2))

    def step(self) -> None:
        self.t += 1
        for k, t in self.p.items():
            if t.grad is not None:
                self.m[k] = 0.9 * self.m[k] + 0.1 * t.grad
                self.v[k] = 0.999 * self.v[k] + 0.001 * t.grad**2
                t.data = t.data - self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)
            t.grad = None


class RowAdam:
    """Adam for a table of which a step uses few rows: a row is brought up to date when it is used next.

    The same as Adam over the whole table up to rounding: without a gradient a row still moves by its momentum, which
    after SPAN steps is below 1e-11 of what it was and no longer counts.
    """

    SPAN, CHUNK = 256, 32

    def __init__(self, table: Tape, rate: float):
        self.p, self.rate, self.t = table, rate, 0
        self.m, self.v = np.zeros_like(table.data), np.zeros_like(table.data)
        self.last = np.zeros(len(table.data), np.int64)
        self.p.data = np.array(table.data)  # changed in place

    def rows(self, at: np.ndarray) -> np.ndarray:
        """Distinct rows as they stand after the last step."""
        moved = at[(self.last[at] > 0) & (self.last[at] < self.t)]
        moved = moved[np.argsort(self.last[moved], kind="stable")]
        for a in range(0, len(moved), self.CHUNK):
            i = moved[a : a + self.CHUNK]
            gap = self.t - self.last[i]
            j = np.arange(1, min(gap.max(), self.SPAN) + 1)
            s = self.last[i][:, None] + j
            c = np.where(j <= gap[:, None], self.rate * 0.9**j / (1 - 0.9**s), 0.0)
            d = np.sqrt(0.999**j / (1 - 0.999**s))
            self.p.data[i] -= (self.m[i][:, None] * c[:, :, None] / (np.sqrt(self.v[i])[:, None] * d[:, :, None] + 1e-8)).sum(1)
            self.m[i] *= (0.9**gap)[:, None]
            self.v[i] *= (0.999**gap)[:, None]
            self.last[i] = self.t
        return self.p.data[at]

    def step(self, at: np.ndarray, grad: np.ndarray) -> None:
        """The next step for rows that rows() has just given; no other row has a gradient."""
        self.t += 1
        m, v = 0.9 * self.m[at] + 0.1 * grad, 0.999 * self.v[at] + 0.001 * grad**2
        self.p.data[at] -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)
        self.m[at], self.v[at], self.last[at] = m, v, self.t


def _filled(model, arrays: dict[str, np.ndarray]):
    """The model with stored parameters; arrays that do not fit raise."""
    for k, t in model.p.items():
        if f"p_{k}" not in arrays or arrays[f"p_{k}"].shape != t.data.shape:
            raise ValueError(f"parameter {k} is missing or of another shape")
        t.data = arrays[f"p_{k}"]
    return model


class TwoTower:
    """Users and items as unit vectors from an id, pooled categories and numbers; user row 0 is the cold start."""

    def __init__(self, users: int, items: int, user_cats: int = 0, user_dense: int = 0, item_cats: int = 0, item_dense: int = 0, dim: int = 32, temperature: float = 0.05, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.dim, self.temperature, self.sizes = dim, temperature, (users, items, user_cats, user_dense, item_cats, item_dense)
        self.p: dict[str, Tape] = {}
        for side, ids, cats, dense in (("u", users, user_cats, user_dense), ("i", items, item_cats, item_dense)):
            for name, shape in (("id", (max(ids, 1), dim)), ("cat", (max(cats, 1), dim)), ("dense", (max(dense, 1), dim)), ("h", (dim, dim)), ("hb", (dim,)), ("o", (dim, dim)), ("ob", (dim,))):
                self.p[side + name] = Tape(rng.standard_normal(shape) / np.sqrt(dim) if len(shape) == 2 else np.zeros(shape))

    def tower(self, side: str, ids: np.ndarray, cats: np.ndarray | None = None, dense: np.ndarray | None = None, table: Tape | None = None) -> Tape:
        """cats: (rows, slots) 0/1; dense: (rows, numbers); table: the rows that ids mean, if not those of the model."""
        h = take(self.p[side + "id"] if table is None else table, ids)
        if cats is not None and cats.shape[1]:
            h = add(h, matmul(Tape(cats / np.maximum(cats.sum(1, keepdims=True), 1)), self.p[side + "cat"]))
        if dense is not None and dense.shape[1]:
            h = add(h, matmul(Tape(dense), self.p[side + "dense"]))
        h = relu(add(matmul(h, self.p[side + "h"]), self.p[side + "hb"]))
        return unit(add(matmul(h, self.p[side + "o"]), self.p[side + "ob"]))

    def loss(self, u: Tape, v: Tape, items: np.ndarray) -> Tape:
        """In-batch softmax with popularity correction; other copies of the positive item are no negatives."""
        _, inverse, count = np.unique(items, return_inverse=True, return_counts=True)
        mask = np.where((items[:, None] == items[None]) & ~np.eye(len(items), dtype=bool), -1e30, 0.0) - np.log(count[inverse] / len(items))
        logits = add(mul(matmul(u, swap(v)), Tape(np.array(1 / self.temperature))), Tape(mask))
        return cross_entropy(logits, np.arange(len(items)), np.ones(len(items)))

    def fit(self, pairs: np.ndarray, user_side=(None, None), item_side=(None, None), epochs: int = 50, batch: int = 256, rate: float = 0.01, id_dropout: float = 0.1, seed: int = 0) -> list[float]:
        """pairs: (user, item) indices. With id_dropout a user stands as the cold-start row. Returns the loss per epoch."""
        rng, opt, out = np.random.default_rng(seed), Adam({k: t for k, t in self.p.items() if k not in ("uid", "iid")}, rate), []
        users, items = RowAdam(self.p["uid"], rate), RowAdam(self.p["iid"], rate)
        at = lambda x, i: None if x is None else x[i]
        for _ in range(epochs):
            order, losses = rng.permutation(len(pairs)), []
            for a in range(0, len(pairs), batch):
                u, i = pairs[order[a : a + batch]].T
                (us, ids), (its, here) = (np.unique(x, return_inverse=True) for x in (np.where(rng.random(len(u)) < id_dropout, 0, u), i))
                ut, it = Tape(users.rows(us)), Tape(items.rows(its))
                loss = self.loss(self.tower("u", ids, at(user_side[0], u), at(user_side[1], u), ut), self.tower("i", here, at(item_side[0], i), at(item_side[1], i), it), i)
                loss.backward()
                opt.step()
                users.step(us, ut.grad)
                items.step(its, it.grad)
                losses.append(float(loss.data))
            out.append(float(np.mean(losses)) if losses else 0.0)
        for table in (users, items):
            table.rows(np.arange(len(table.last)))
        return out

    def vectors(self, side: str, ids: np.ndarray, cats=None, dense=None) -> np.ndarray:
        return self.tower(side, ids, cats, dense).data

    def arrays(self) -> dict[str, np.ndarray]:
        return {"sizes": np.array(self.sizes), "shape": np.array([self.dim, self.temperature])} | {f"p_{k}": t.data for k, t in self.p.items()}

    @staticmethod
    def of(arrays: dict[str, np.ndarray]) -> "TwoTower":
        dim, temperature = arrays["shape"]
        return _filled(TwoTower(*[int(x) for x in arrays["sizes"]], dim=int(dim), temperature=float(temperature)), arrays)

    def save(self, path: str) -> None:
        """To one local file; models over DataFrames are saved through Spark's file system instead."""
        np.savez(path, **self.arrays())

    @staticmethod
    def load(path: str) -> "TwoTower":
        with np.load(path) as z:
            return TwoTower.of(dict(z))


class SequenceModel:
    """Causal self-attention over item tokens; token 0 pads. Scores are logits over tokens."""

    def __init__(self, vocab: int, dim: int = 64, length: int = 50, heads: int = 2, layers: int = 2, seed: int = 42):
        if dim % heads:
            raise ValueError("dim must be a multiple of heads")
        rng = np.random.default_rng(seed)
        self.config = (vocab, dim, length, heads, layers)
        w = lambda *s: Tape(rng.standard_normal(s) / np.sqrt(s[0]))
        self.p = {"e": Tape(rng.standard_normal((vocab, dim)) * 0.1), "pos": Tape(rng.standard_normal((length, dim)) * 0.1), "out": w(dim, vocab), "outb": Tape(np.zeros(vocab))}
        for k in range(layers):
            for h in range(heads):
                for n in "qkv":
                    self.p[f"{n}{k}.{h}"] = w(dim, dim // heads)
                self.p[f"m{k}.{h}"] = w(dim // heads, dim)
            self.p |= {f"f{k}": w(dim, 4 * dim), f"fb{k}": Tape(np.zeros(4 * dim)), f"g{k}": w(4 * dim, dim), f"gb{k}": Tape(np.zeros(dim))}
            for n in "ab":
                self.p |= {f"scale_{n}{k}": Tape(np.ones(dim)), f"shift_{n}{k}": Tape(np.zeros(dim))}

    def forward(self, tokens: np.ndarray, drop=lambda x: x, last: bool = False) -> Tape:
        """Logits at every position, or (last, without gradients before it) at the last one; drop is applied to each sublayer."""
        vocab, dim, length, heads, layers = self.config
        if tokens.shape[1] > length:
            raise ValueError(f"sequences may have at most {length} tokens")
        n = tokens.shape[1]
        x = drop(add(take(self.p["e"], tokens), take(self.p["pos"], np.arange(n))))
        later = Tape(np.triu(np.full((n, n), -1e9), 1))
        scale = Tape(np.array(1 / np.sqrt(dim // heads)))
        for k in range(layers):
            parts = None
            for h in range(heads):
                q, key, v = (matmul(x, self.p[f"{c}{k}.{h}"]) for c in "qkv")
                a = softmax(add(mul(matmul(q, swap(key)), scale), later))
                one = matmul(matmul(a, v), self.p[f"m{k}.{h}"])
                parts = one if parts is None else add(parts, one)
            x = layer_norm(add(x, drop(parts)), self.p[f"scale_a{k}"], self.p[f"shift_a{k}"])
            f = add(matmul(relu(add(matmul(x, self.p[f"f{k}"]), self.p[f"fb{k}"])), self.p[f"g{k}"]), self.p[f"gb{k}"])
            x = layer_norm(add(x, drop(f)), self.p[f"scale_b{k}"], self.p[f"shift_b{k}"])
        x = Tape(x.data[:, -1]) if last else x
        return add(matmul(x, self.p["out"]), self.p["outb"])

    def fit(self, inputs: np.ndarray, targets: np.ndarray, epochs: int = 50, batch: int = 16, rate: float = 1e-3, patience: int = 5, seed: int = 42, dropout: float = 0.0) -> list[float]:
        """Adam on the next item at every position that is not padding; stops when the loss no longer falls."""
        if not 0 <= dropout < 1:
            raise ValueError("dropout must be at least 0 and below 1")
        rng, opt, out, best, waited = np.random.default_rng(seed), Adam(self.p, rate), [], np.inf, 0
        noise = np.random.default_rng((seed, 1))

        def drop(x: Tape) -> Tape:
            return mul(x, Tape((noise.random(x.data.shape) >= dropout) / (1 - dropout))) if dropout else x

        for _ in range(epochs):
            order, losses = rng.permutation(len(inputs)), []
            for a in range(0, len(inputs), batch):
                i = order[a : a + batch]
                logits = self.forward(inputs[i], drop)
                rows = Tape(logits.data.reshape(-1, self.config[0]), (logits,), lambda g, s=logits.data.shape: (g.reshape(s),))
                y = targets[i].ravel()
                loss = cross_entropy(rows, y, (y > 0).astype(float))
                loss.backward()
                opt.step()
                losses.append(float(loss.data))
            out.append(float(np.mean(losses)) if losses else 0.0)
            if out[-1] < best - 1e-6:
                best, waited = out[-1], 0
            else:
                waited += 1
                if waited >= patience:
                    break
        return out

    def score_all(self, histories: list[list[int]]) -> np.ndarray:
        """Scores of all tokens after each history (newest last); an empty one gives the scores without context."""
        length = self.config[2]
        rows = np.zeros((len(histories), length), np.int64)
        for row, history in zip(rows, histories):
            if len(recent := history[-length:]):
                row[-len(recent) :] = recent
        return self.forward(rows, last=True).data

    def score(self, history: list[int]) -> np.ndarray:
        return self.score_all([history])[0]

    def arrays(self) -> dict[str, np.ndarray]:
        return {"config": np.array(self.config)} | {f"p_{k}": t.data for k, t in self.p.items()}

    @staticmethod
    def of(arrays: dict[str, np.ndarray]) -> "SequenceModel":
        return _filled(SequenceModel(*[int(x) for x in arrays["config"]]), arrays)

    def save(self, path: str) -> None:
        """To one local file; models over DataFrames are saved through Spark's file system instead."""
        np.savez(path, **self.arrays())

    @staticmethod
    def load(path: str) -> "SequenceModel":
        with np.load(path) as z:
            return SequenceModel.of(dict(z))
