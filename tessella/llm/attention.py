"""A small causal self-attention language model in numpy: training, and scores of long id sequences.

One attention layer and one feed-forward layer over windows of ``CONTEXT`` + ``STEP``
ids. Windows overlap by the context: a window's queries are its last STEP positions
only, so every id of a text is scored once, with CONTEXT to CONTEXT + STEP ids in
sight; what lies before the text is filled with a begin id.

The output has two levels: a softmax over ``GROUPS`` groups, and one over the ``EACH``
classes of the group that the target is in, times the id's share of its class in the whole training
corpus. Positions are sorted by their target's group, so the second level is a small
product a group. Classes are the most frequent ids alone, and sets of ids
with like neighbours; like classes share a group.
"""

from __future__ import annotations

import numpy as np

WIDTH, HIDDEN, GROUPS, EACH, CONTEXT, STEP = 20, 32, 32, 32, 8, 32
CLASSES, SPAN = GROUPS * EACH, CONTEXT + STEP
#: Classes of one frequent id, and of ids that the corpus has too rarely to know their neighbours.
ALONE, RARE = 384, 4
_MASK = (np.arange(SPAN)[None, :] <= np.arange(CONTEXT, SPAN)[:, None]).astype(np.float32)
#: Scores up to here need no shift before their exponential: neither it nor a sum of it leaves the range of 32-bit floats.
_PLAIN = 60.0
#: Sums of exponentials between this and its inverse are exact as they are.
_LEAST = 1e-25
#: Numbers of a state: its own, a 1 (so that products add the biases) and padding.
WIDE = 24


def windows(ids: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """Inputs (rows of SPAN ids) and targets (rows of STEP ids, -1 behind the text's end)."""
    n = len(ids)
    rows = -(-n // STEP)
    padded = np.full(CONTEXT + rows * STEP, begin, np.int32)
    padded[CONTEXT + 1 : CONTEXT + n] = ids[: n - 1]
    aims = np.full(rows * STEP, -1, np.int32)
    aims[:n] = ids
    return np.lib.stride_tricks.sliding_window_view(padded, SPAN)[::STEP], aims.reshape(rows, STEP)


def marks(counts: np.ndarray, final: np.ndarray) -> np.ndarray:
    """What a neighbour counts as: one of the 126 most frequent ids, or another that does or doesn't end a word."""
    out = np.full(len(counts), 126, np.int64)
    out[final] = 127
    order = np.argsort(-counts, kind="stable")[:126]
    out[order] = np.arange(len(order))
    return out


def _halves(x: np.ndarray, at: np.ndarray, parts: int) -> list[np.ndarray]:
    """``at`` in as many equal parts, each time halved along the direction in which its rows differ most."""
    if parts == 1:
        return [at]
    some = x[at] - x[at].mean(axis=0)
    v = np.ones(x.shape[1], np.float32)
    for _ in range(20):
        v = some.T @ (some @ v)
        v /= max(float(np.linalg.norm(v)), 1e-20)
    order = at[np.argsort(some @ v, kind="stable")]
    return _halves(x, order[: len(at) // 2], parts // 2) + _halves(x, order[len(at) // 2 :], parts // 2)


def classes(near: np.ndarray, counts: np.ndarray, final: np.ndarray, seed: int = 5) -> np.ndarray:
    """A class for every id; class c is of group c // EACH. ``near``: an id's counts of marks before it, then behind it; ``final``: ids that end a word."""
    size = len(counts)
    out = CLASSES - RARE + 2 * final.astype(np.int64) + (np.arange(size) % 2)
    place = np.zeros((CLASSES, near.shape[1]), np.float32)
    order = np.argsort(-counts, kind="stable")
    known = np.flatnonzero(counts >= 5)
    if len(known):
        x = np.sqrt(near[known] / np.maximum(near[known].sum(axis=1, keepdims=True), 1)).astype(np.float32)
        weight = np.sqrt(counts[known]).astype(np.float32)
        rng, k = np.random.default_rng(seed), min(CLASSES - RARE - ALONE, len(known))
        c = x[rng.choice(len(known), k, replace=False, p=weight / weight.sum())].copy()
        for _ in range(8):
            at = np.concatenate([((c * c).sum(axis=1)[None, :] - 2 * x[i : i + 4096] @ c.T).argmin(axis=1) for i in range(0, len(x), 4096)])
            sums, total = np.zeros_like(c), np.bincount(at, weight, minlength=k)
            np.add.at(sums, at, x * weight[:, None])
            c[total > 0] = (sums[total > 0] / total[total > 0, None]).astype(np.float32)
        out[known] = ALONE + at
        place[ALONE : ALONE + k] = c
        place[-RARE:] = x.mean(axis=0)
    top = order[:ALONE]
    top = top[counts[top] > 0]
    out[top] = np.arange(len(top))
    place[: len(top)] = np.sqrt(near[top] / np.maximum(near[top].sum(axis=1, keepdims=True), 1))
    new = np.empty(CLASSES, np.int64)
    new[np.concatenate(_halves(place, np.arange(CLASSES), GROUPS))] = np.arange(CLASSES)
    return new[out]


class Model:
    """Weights, and per id its class and log10 share of it."""

    def __init__(self, counts: np.ndarray, of: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        size = len(counts)
        self.begin, self.of = size, of.astype(np.int32)
        smooth = counts.astype(np.float64) + 0.05
        mass = np.bincount(of, smooth, minlength=CLASSES)
        self.share = np.log10(smooth / mass[of])

        def w(*shape, scale):
            return rng.normal(0, scale, shape).astype(np.float32)

        d, h = WIDTH, HIDDEN
        each = np.log(np.maximum(mass, 1e-9) / mass.sum()).reshape(GROUPS, EACH)
        of_group = np.log(np.exp(each).sum(axis=1))
        self.w = {
            "e": w(size + 1, d, scale=0.3), "p": w(SPAN, d, scale=0.1), "k": w(d, d, scale=d**-0.5), "v": w(d, d, scale=d**-0.5), "q": w(d, d, scale=d**-0.5 / 2), "o": w(d, d, scale=d**-0.5),
            "a": w(d, h, scale=d**-0.5), "ab": np.zeros(h, np.float32), "b": w(h, d, scale=h**-0.5 / 2), "g": w(d, GROUPS, scale=0.1), "gb": of_group.astype(np.float32),
            "u": w(GROUPS, d, EACH, scale=0.1), "ub": (each - of_group[:, None]).astype(np.float32),
        }

    def copy(self) -> Model:
        """The same model with weights of its own."""
        out = object.__new__(Model)
        out.__dict__ |= self.__dict__ | {"w": {k: x.copy() for k, x in self.w.items()}}
        return out

    def add(self, part: int, parts: int, change: np.ndarray) -> None:
        """Add changes of each ``parts``-th embedding from ``part`` on, or of all other weights in order of name (part -1)."""
        if part >= 0:
            self.w["e"][part::parts] += change.reshape(-1, WIDTH)
            return
        for k in sorted(self.w):
            if k != "e":
                self.w[k] += change[: self.w[k].size].reshape(self.w[k].shape)
                change = change[self.w[k].size :]

    def forward(self, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        """The state behind each of the last STEP positions of each window comes last; what gradients need before it."""
        return _Packed(self).forward(ids)

    def gradients(self, ids: np.ndarray, aims: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss (nats a class) and its gradients."""
        packed = _Packed(self)
        loss, dx = packed.gradients(ids, aims)
        g = {k: x.copy() for k, x in _views(packed.g).items()}
        return loss, g | {"e": (ids.reshape(-1), dx[:, :WIDTH])}

    def train(self, inputs: np.ndarray, aims: np.ndarray, epochs: int = 2, batch: int = 64, rate: float = 0.004, seed: int = 13) -> list[float]:
        """Adam over shuffled windows; the rate falls to a tenth. Returns the mean loss of each tenth of the steps."""
        rng, losses = np.random.default_rng(seed), []
        packed = _Packed(self)
        e, w, d, real = packed.e, packed.flat, packed.flat_g, packed.real
        m, u, moments = np.zeros_like(w), np.zeros_like(w), np.zeros((len(e), 2, WIDE), e.dtype)
        steps, t = max(1, epochs * -(-len(inputs) // batch)), 0
        for _ in range(epochs):
            order = rng.permutation(len(inputs))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                ids = inputs.take(some, axis=0)
                loss, dx = packed.gradients(ids, aims.take(some, axis=0))
                losses.append(loss)
                t += 1
                now = rate * (1 - 0.9 * t / steps) * min(1, t / 50)
                ids = ids.reshape(-1)
                if self.begin < 1 << 16:
                    ids = ids.astype(np.uint16)  # sorted by digits
                sort = np.argsort(ids, kind="stable")
                ids = ids.take(sort)
                first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
                used = ids.take(first)
                # Pairs of numbers add as complex ones do, in half the loops.
                de = np.add.reduceat(dx.take(sort, axis=0).view(np.complex64), first, axis=0).view(np.float32)
                de[:, WIDTH:] = 0
                # Rows of the embedding that a batch doesn't touch keep their moments.
                both = moments.take(used, axis=0)
                mean, square = both[:, 0] * 0.9, both[:, 1] * 0.99
                mean += 0.1 * de
                de *= de
                de *= 0.01
                square += de
                both[:, 0], both[:, 1] = mean, square
                moments[used] = both
                np.sqrt(square, out=square)
                square += 1e-8
                mean /= square
                mean *= 2 * now
                e[used] -= mean
                d *= real
                m *= 0.9
                m += 0.1 * d
                d *= d
                u *= 0.99
                u += 0.01 * d
                np.sqrt(u, out=d)
                d += 1e-8
                np.divide(m, d, out=d)
                d *= now * (1 - 0.99**t) ** 0.5 / (1 - 0.9**t)
                w -= d
        self.w = {k: np.ascontiguousarray(x) for k, x in packed.views().items()}
        step = max(1, len(losses) // 10)
        return [float(np.mean(losses[i : i + step])) for i in range(0, len(losses), step)]

    def prepared(self) -> dict[str, np.ndarray | _Packed]:
        """Keys, values (and a 1), inputs and queries by id and by place, so that scoring looks products up that training makes."""
        packed, d = _Packed(self), WIDTH

        def table(x: np.ndarray, one: int) -> tuple[np.ndarray, np.ndarray]:
            kvq = x @ packed.w["kvq"]
            return np.hstack([kvq[:, : 2 * d], np.full((len(x), 1), one, x.dtype)]), np.hstack([x, kvq[:, 2 * d :]])

        (kv, xq), (pkv, pxq) = table(packed.e, 0), table(packed.w["p"], 1)
        return {"packed": packed, "kv": kv, "xq": xq, "pkv": pkv, "pxq": pxq[CONTEXT:]}

    def states(self, ids: np.ndarray, made: dict[str, np.ndarray | _Packed]) -> np.ndarray:
        """What ``forward`` gives last, from prepared products."""
        w, n, d = made["packed"].w, len(ids), WIDTH
        kv = made["kv"].take(ids, axis=0, mode="clip")
        kv += made["pkv"]
        xq = made["xq"].take(ids[:, CONTEXT:], axis=0, mode="clip")
        xq += made["pxq"]
        s = np.matmul(xq[:, :, WIDE:], kv[:, :, :d].transpose(0, 2, 1))
        with np.errstate(over="ignore", invalid="ignore"):
            np.exp(s, out=s)
            s *= _MASK
            o = np.matmul(s, kv[:, :, d:]).reshape(n * STEP, d + 1)
        total = o[:, d:]
        if not (total.min() > _LEAST and total.max() < 1 / _LEAST):
            return made["packed"].forward(ids)[-1]
        h = (o[:, :d] / total) @ w["o"]
        h.reshape(n, STEP, WIDE)[:] += xq[:, :, :WIDE]
        return made["packed"].rise(h)[1]

    def log10(self, inputs: np.ndarray, aims: np.ndarray, batch: int = 128, made: dict[str, np.ndarray | _Packed] | None = None) -> np.ndarray:
        """The log10 probability of each window's targets."""
        out = np.zeros(len(inputs))
        made = self.prepared() if made is None else made
        for at in range(0, len(inputs), batch):
            z = self.states(inputs[at : at + batch], made)
            flat = aims[at : at + batch].reshape(-1)
            y = np.maximum(flat, 0)
            of = self.of.take(y)
            group, own, order, _, _, each = made["packed"].levels(z, of)
            rows = np.arange(0, len(of) * EACH, EACH)
            total = _log_share(each, rows + (of % EACH).take(order))
            score = _log_share(group, rows + own)
            score[order] += total
            score *= np.float32(1 / np.log(10))
            score = score + self.share.take(y)
            score[flat < 0] = 0
            out[at : at + batch] = score.reshape(-1, STEP).sum(axis=1)
        return out


def _by_group(of: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Each target's group, the order by it, and its cuts."""
    own = (of // EACH).astype(np.uint8)
    order = np.argsort(own, kind="stable")
    return own, order, np.searchsorted(own.take(order), np.arange(GROUPS + 1)).tolist()


def _views(w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The packed weights but embeddings, or their gradients, by the names that a model has for them."""
    d = WIDTH
    k, v, q = (w["kvq"][:d, i * d : (i + 1) * d] for i in range(3))
    return {
        "k": k, "v": v, "q": q, "p": w["p"][:, :d], "o": w["o"][:, :d], "a": w["a"][:d], "ab": w["a"][d], "b": w["b"][:, :d],
        "g": w["g"][:d], "gb": w["g"][d], "u": w["u"][:, :d], "ub": w["u"][:, d],
    }


class _Packed:
    """A model's weights as products want them: keys, values and queries in one, and biases as rows that meet the 1 in each state."""

    def __init__(self, model: Model):
        self.of = model.of
        shapes = {"kvq": (WIDE, 3 * WIDTH), "o": (WIDTH, WIDE), "a": (WIDE, HIDDEN), "b": (HIDDEN, WIDE), "g": (WIDE, GROUPS), "u": (GROUPS, WIDE, EACH), "p": (SPAN, WIDE)}
        size = sum(int(np.prod(x)) for x in shapes.values())
        kind = np.result_type(*model.w.values())
        self.flat, self.flat_g, self.real = np.zeros(size, kind), np.zeros(size, kind), np.zeros(size, kind)

        def cut(x: np.ndarray) -> dict[str, np.ndarray]:
            out, at = {}, 0
            for name, shape in shapes.items():
                n = int(np.prod(shape))
                out[name], at = x[at : at + n].reshape(shape), at + n
            return out

        self.w, self.g = cut(self.flat), cut(self.flat_g)
        for k, x in _views(self.w).items():
            x[:] = model.w[k]
        for x in _views(cut(self.real)).values():  # what is not padding
            x[:] = 1
        self.e = np.zeros((len(model.w["e"]), WIDE), kind)
        self.e[:, :WIDTH], self.e[:, WIDTH] = model.w["e"], 1
        self.held: dict[int, np.ndarray] = {}

    def views(self) -> dict[str, np.ndarray]:
        return _views(self.w) | {"e": self.e[:, :WIDTH]}

    def forward(self, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        w, n, d = self.w, len(ids), WIDTH
        x = self.e.take(ids, axis=0, mode="clip")
        x += w["p"]
        kvq = (x.reshape(-1, WIDE) @ w["kvq"]).reshape(n, SPAN, 3 * d)
        s, total = _weights(kvq[:, CONTEXT:, 2 * d :], kvq[:, :, :d])
        o = np.matmul(s, kvq[:, :, d : 2 * d])
        o /= total
        o = o.reshape(-1, d)
        h = o @ w["o"]
        h.reshape(n, STEP, WIDE)[:] += x[:, CONTEXT:]
        return x, kvq, s, total, o, h, *self.rise(h)

    def rise(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The feed-forward layer and the states behind it."""
        a = h @ self.w["a"]
        np.maximum(a, 0, out=a)
        z = a @ self.w["b"]
        z += h
        return a, z

    def levels(self, z: np.ndarray, of: np.ndarray):
        """Logits of the groups; each target's group, the order of positions by it, places of each group that occurs, sorted states, and logits of the classes in that order."""
        own, order, cuts = _by_group(of)
        zs = z.take(order, axis=0)
        each = np.empty((len(z), EACH), z.dtype)
        full = [(i, slice(b, c)) for i, (b, c) in enumerate(zip(cuts, cuts[1:], strict=False)) if c > b]
        for i, some in full:
            np.dot(zs[some], self.w["u"][i], out=each[some])
        return z @ self.w["g"], own, order, full, zs, each

    def gradients(self, ids: np.ndarray, aims: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean loss; gradients go to ``g`` (with padding), those of the inputs' embeddings (with padding) are returned."""
        w, g, n, d = self.w, self.g, len(ids), WIDTH
        x, kvq, s, total, o, h, a, z = self.forward(ids)
        k, v, q = kvq[:, :, :d], kvq[:, :, d : 2 * d], kvq[:, CONTEXT:, 2 * d :]
        flat = aims.reshape(-1)
        real = flat >= 0
        of = self.of.take(np.maximum(flat, 0))
        group, own, order, full, zs, each = self.levels(z, of)
        count = max(1, int(real.sum()))
        part = (real / count).astype(z.dtype)
        rows = np.arange(0, len(of) * EACH, EACH)
        loss = _descend(group, rows + own, part) + _descend(each, rows + (of % EACH).take(order), part.take(order))
        g["u"].fill(0)
        dzs = np.empty_like(zs)
        for i, some in full:
            np.dot(zs[some].T, each[some], out=g["u"][i])
            np.dot(each[some], w["u"][i].T, out=dzs[some])
        np.dot(z.T, group, out=g["g"])
        dz = group @ w["g"].T
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        dz += dzs.take(back, axis=0)
        np.dot(a.T, dz, out=g["b"])
        da = dz @ w["b"].T
        da *= a > 0
        np.dot(h.T, da, out=g["a"])
        dh = da @ w["a"].T
        dh += dz
        np.dot(o.T, dh, out=g["o"])
        do = dh @ w["o"].T
        do /= total.reshape(-1, 1)
        # The sum over places of dp times p is that over widths of do times o.
        inner = _sums(do * o).reshape(n, STEP, 1)
        do = do.reshape(n, STEP, d)
        if n not in self.held:
            self.held[n] = np.zeros((n, SPAN, 3 * d), z.dtype)  # queries of the context stay 0
        dkvq = self.held[n]
        np.matmul(s.transpose(0, 2, 1), do, out=dkvq[:, :, d : 2 * d])
        ds = np.matmul(do, v.transpose(0, 2, 1))
        ds -= inner
        ds *= s
        np.matmul(ds, k, out=dkvq[:, CONTEXT:, 2 * d :])
        np.matmul(ds.transpose(0, 2, 1), q, out=dkvq[:, :, :d])
        flat = dkvq.reshape(-1, 3 * d)
        np.dot(x.reshape(-1, WIDE).T, flat, out=g["kvq"])
        dx = flat @ w["kvq"].T
        dx.reshape(n, SPAN, WIDE)[:, CONTEXT:] += dh.reshape(n, STEP, WIDE)
        np.dot(np.ones(n, dx.dtype), dx.reshape(n, -1), out=g["p"].reshape(-1))
        return loss, dx


def _weights(q: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of the scores of each query with the keys that it sees, and their sums."""
    s = np.matmul(q, k.transpose(0, 2, 1))
    with np.errstate(over="ignore", invalid="ignore"):
        np.exp(s, out=s)
        s *= _MASK
        total = _sums(s.reshape(-1, SPAN)).reshape(len(s), STEP, 1)
    if not (total.min() > _LEAST and total.max() < 1 / _LEAST):
        s = np.matmul(q, k.transpose(0, 2, 1))
        s -= np.where(_MASK > 0, s, -np.inf).max(axis=2, keepdims=True)
        np.minimum(s, 0, out=s)  # of those that are hidden
        np.exp(s, out=s)
        s *= _MASK
        total = _sums(s.reshape(-1, SPAN)).reshape(len(s), STEP, 1)
    return s, total


def _descend(logits: np.ndarray, at: np.ndarray, part: np.ndarray) -> float:
    """Loss of a softmax over each row, whose target is at a flat place; in place of the logits come their gradients."""
    if not (logits.max() < _PLAIN and logits.min() > -_PLAIN):
        logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    total = _sums(logits)
    flat = logits.reshape(-1)
    loss = -float(np.log(np.maximum(flat.take(at) / total, 1e-30)) @ part)
    logits *= (part / total)[:, None]
    flat[at] -= part
    return loss


def _sums(x: np.ndarray) -> np.ndarray:
    """The sum of each row; a product is faster than a reduction."""
    return x @ np.ones(x.shape[1], x.dtype)


def _log_share(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log of the softmax of each row at one place, given as a flat one; the logits are lost."""
    own = logits.reshape(-1).take(at)
    if logits.max() < _PLAIN and logits.min() > -_PLAIN:
        np.exp(logits, out=logits)
        return own - np.log(_sums(logits))
    top = logits.max(axis=1)
    return own - top - np.log(np.exp(logits - top[:, None]).sum(axis=1))
