"""A small causal self-attention language model in numpy, over subword ids.

The ids of a text, behind a start mark and before an end mark, fall into blocks. A window is a block and the one
before it: the block's ids are scored, each exactly once, from the ids before them in the window, by one masked
attention over a batch of windows. Learning takes windows that don't overlap, in which every id is foretold from
those before it. The output is a softmax over classes of ids (frequent ids have a class of their
own) times the id's share of its class in the training corpus, given the class of the id before it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

BLOCK, WIDTH, HIDDEN = 16, 16, 32
#: Classes: single ids, the end mark, and groups of the other ids. Input ids beyond the most frequent share rows.
SINGLES, GROUPS, INPUTS = 95, 32, 4096
FREE = 64
NAMES = ("E", "P", "Q", "K", "V", "O", "W1", "b1", "W2", "U", "b")
#: 1 where an id may look: at itself and those before it in the window.
_OPEN = np.tri(2 * BLOCK, dtype=np.float32)


@dataclass
class Vocabulary:
    """What the corpus counts say: input row and class of each id, and the share of its class, alone and by the class
    before (log10; ``after[c, t]``, from Vocabulary.condition). The ids n and n + 1 are end and start."""

    row: np.ndarray
    cls: np.ndarray
    share: np.ndarray
    after: np.ndarray | None = None

    @property
    def end(self) -> int:
        return len(self.cls) - 2

    @property
    def start(self) -> int:
        return len(self.cls) - 1

    def condition(self, pairs: np.ndarray) -> None:
        """pairs[c, t]: how often id t follows an id of class c in the training corpus. Where that was seen little, the share alone counts."""
        few = np.float32(4)
        total = np.stack([np.bincount(self.cls[: pairs.shape[1]], p, self.classes) for p in pairs]).astype(np.float32)
        self.after = pairs.astype(np.float32)
        self.after += few * 10 ** self.share[: pairs.shape[1]]
        self.after /= total[:, self.cls[: pairs.shape[1]]] + few
        np.log10(self.after, out=self.after)

    @property
    def classes(self) -> int:
        return SINGLES + 1 + GROUPS


def vocabulary(counts: np.ndarray, near: np.ndarray | None = None) -> Vocabulary:
    """counts: of all ids in the training corpus, the end mark last. near[c, t]: how often id t follows an id of class c there, by
    a vocabulary without groups; ids that follow alike are grouped."""
    n = len(counts) - 1
    rank = np.argsort(-counts[:n], kind="stable")
    row = np.empty(n + 2, np.int32)
    row[rank[:INPUTS]] = np.arange(min(INPUTS, n))
    rest = rank[INPUTS:]
    row[rest] = INPUTS + rest % FREE
    row[n], row[n + 1] = INPUTS + FREE, INPUTS + FREE + 1
    cls = np.empty(n + 2, np.int32)
    cls[rank[:SINGLES]] = np.arange(SINGLES)
    cls[n], cls[n + 1] = SINGLES, SINGLES
    cls[rank[SINGLES:]] = SINGLES + 1 + (0 if near is None else _groups(rank[SINGLES:], counts, near[: SINGLES + 2]))
    smooth = counts + np.append(np.full(n, 0.01), 1.0)
    total = np.bincount(cls[: n + 1], smooth, SINGLES + 1 + GROUPS)
    share = np.append(np.log10(smooth / total[cls[: n + 1]]), 0.0).astype(np.float32)
    return Vocabulary(row, cls, share)


def _groups(rest: np.ndarray, counts: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Groups ids by the classes that they follow (k-means on the unit sphere); ids that never occur are dealt out evenly."""
    group = np.arange(len(rest)) % GROUPS
    seen = np.flatnonzero(counts[rest] > 0)
    if len(seen) < GROUPS:
        return group
    around = np.sqrt(near[:, rest[seen]].T.astype(np.float32))
    around /= np.linalg.norm(around, axis=1, keepdims=True) + 1e-9
    weight = counts[rest[seen]].astype(np.float32)
    centres = around[:GROUPS].copy()  # in order of frequency
    for _ in range(12):
        own = np.argmax(around @ centres.T, axis=1)
        for g in range(GROUPS):
            if (own == g).any():
                c = weight[own == g] @ around[own == g]
                centres[g] = c / (np.linalg.norm(c) + 1e-9)
    group[seen] = own
    return group


def fresh(seed: int = 1) -> dict[str, np.ndarray]:
    r, d = np.random.default_rng(seed), WIDTH
    shapes = {"E": (INPUTS + FREE + 2, d), "P": (2 * BLOCK, d), "Q": (d, d), "K": (d, d), "V": (d, d), "O": (d, d), "W1": (d, HIDDEN), "b1": (HIDDEN,), "W2": (HIDDEN, d), "U": (SINGLES + 1 + GROUPS, d), "b": (SINGLES + 1 + GROUPS,)}
    return {k: (np.zeros(s) if k in ("b1", "b") else r.normal(0, 0.3 if k == "E" else d**-0.5, s)).astype(np.float32) for k, s in shapes.items()}


def pack(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in NAMES])


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, like in fresh().items():
        out[k] = flat[at : at + like.size].reshape(like.shape).astype(np.float32)
        at += like.size
    return out


def rows(flat: np.ndarray, sizes: np.ndarray, vocab: Vocabulary, block: int):
    """(inputs, targets, rows by text): the ids of texts of so many ids, in rows of ``block``; a target is the id after
    its input, the end mark behind the last one, and -1 beyond."""
    count = -(-(sizes + 1) // block)
    first = (np.cumsum(count) - count) * block
    x, y = np.full(int(count.sum()) * block, vocab.start, np.int32), np.full(int(count.sum()) * block, -1, np.int32)
    at = np.arange(len(flat)) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
    x[at + 1], y[at] = flat, flat
    y[first + sizes] = vocab.end
    return x.reshape(-1, block), y.reshape(-1, block), count


def windows(flat: np.ndarray, sizes: np.ndarray, vocab: Vocabulary):
    """(inputs, targets, windows by text): windows of 2 * BLOCK inputs, and the BLOCK ids that follow the last ones (-1: none)."""
    x, y, count = rows(flat, sizes, vocab, BLOCK)
    before = np.empty_like(x)
    before[1:] = x[:-1]
    before[np.cumsum(count) - count] = vocab.start
    return np.concatenate([before, x], axis=1), y, count


@lru_cache(1)
def _exp():
    """Exponentials of a float32 array, in place or in a new one. onnxruntime's kernel takes a third of numpy's time; numpy's serves without it."""
    try:
        import onnxruntime as ort
    except ImportError:
        return lambda x: np.exp(x, out=x)
    # ModelProto (ir_version, graph, opset) of one node, by field number: length-delimited fields, and numbers
    part = lambda k, x: bytes([k << 3 | 2, len(x)]) + x
    number = lambda k, x: bytes([k << 3, x])
    value = lambda name: part(1, name) + part(2, part(1, number(1, 1)))
    graph = part(1, part(1, b"x") + part(2, b"y") + part(4, b"Exp")) + part(2, b"exp") + part(11, value(b"x")) + part(12, value(b"y"))
    options = ort.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    options.enable_cpu_mem_arena = False
    session = ort.InferenceSession(number(1, 8) + part(7, graph) + part(8, number(2, 17)), options, providers=["CPUExecutionProvider"])
    return lambda x: session.run(None, {"x": x})[0]


@lru_cache(8)
def _ones(n: int) -> np.ndarray:
    """For sums of rows by a product, which is faster than sum(1)."""
    return np.ones(n, np.float32)


class Scorer:
    """Log10 probabilities of texts. What depends on an input id alone is tabulated; biases are a row of the matrices, for a last 1 in the vectors."""

    def __init__(self, p: dict[str, np.ndarray], vocab: Vocabulary):
        self.vocab = vocab
        scale = np.float32(WIDTH**-0.5)
        self.kv, self.pkv = (np.concatenate([e @ p["K"], e @ p["V"] @ p["O"]], axis=1) for e in (p["E"], p["P"]))
        self.qe, self.pqe = (np.concatenate([e @ p["Q"] * scale, e], axis=1) for e in (p["E"], p["P"][BLOCK:]))
        self.w1, self.w2 = np.concatenate([p["W1"], p["b1"][None]]), p["W2"]
        self.u = np.concatenate([p["U"], p["b"][:, None]], axis=1)
        self.open = _OPEN[BLOCK:]

    def rows(self, ins: np.ndarray, outs: np.ndarray) -> np.ndarray:
        """Log10 probability of each window's targets together."""
        v = self.vocab
        r = v.row[ins]
        kv = np.take(self.kv, r, axis=0)
        kv += self.pkv
        qe = np.take(self.qe, r[:, BLOCK:], axis=0)
        qe += self.pqe
        a = qe[..., :WIDTH] @ kv[..., :WIDTH].transpose(0, 2, 1)
        a = _exp()(a)
        a *= self.open
        h = np.empty((*outs.shape, WIDTH + 1), np.float32)
        h[..., WIDTH] = 1
        np.divide(a @ kv[..., WIDTH:], (a.reshape(-1, 2 * BLOCK) @ _ones(2 * BLOCK)).reshape(*outs.shape, 1), out=h[..., :WIDTH])
        h[..., :WIDTH] += qe[..., WIDTH:]
        h = h.reshape(-1, WIDTH + 1)
        u = h @ self.w1
        np.maximum(u, 0, out=u)
        h[:, :WIDTH] += u @ self.w2
        z = h @ self.u.T
        flat = outs.ravel()
        t = np.maximum(flat, 0)
        own = z.ravel()[np.arange(0, z.size, z.shape[1]) + v.cls[t]]
        z = _exp()(z)
        got = (own - np.log(z @ _ones(z.shape[1]))) * np.float32(0.4342944819)
        got += v.share[t] if v.after is None else v.after[v.cls[ins[:, BLOCK:].ravel()], t]
        return np.where(flat >= 0, got, 0).reshape(outs.shape).sum(1, dtype=np.float64)

    def score(self, flat: np.ndarray, sizes: np.ndarray, batch: int = 256) -> np.ndarray:
        """Of each text of so many ids, end mark included."""
        if not len(sizes):
            return np.empty(0)
        ins, outs, count = windows(flat, sizes, self.vocab)
        got = np.concatenate([self.rows(ins[i : i + batch], outs[i : i + batch]) for i in range(0, len(ins), batch)])
        return np.add.reduceat(got, np.cumsum(count) - count)


def gradient(p: dict[str, np.ndarray], vocab: Vocabulary, ins: np.ndarray, outs: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss (natural logarithm, of the classes) of windows in which every id is a target, and its gradient; that of the
    embeddings is ("E": the rows of ids that occur, "dE": theirs)."""
    d, scale = WIDTH, np.float32(WIDTH**-0.5)
    r, flat = vocab.row[ins], outs.ravel()
    x = np.take(p["E"], r, axis=0)
    x += p["P"]
    shape, x = x.shape, x.reshape(-1, d)
    n, wide = len(x), shape[1]
    into = np.concatenate([p["Q"] * scale, p["K"], p["V"]], axis=1)
    qkv = (x @ into).reshape(*shape[:2], 3 * d)
    q, k, v = (qkv[..., i * d : (i + 1) * d] for i in range(3))
    a = q @ k.transpose(0, 2, 1)
    a = _exp()(a)
    a *= _OPEN[:wide, :wide]
    a *= (1 / (a.reshape(-1, wide) @ _ones(wide))).reshape(*shape[:2], 1)
    o = (a @ v).reshape(-1, d)
    h, z = np.empty((n, d + 1), np.float32), np.empty((n, d + 1), np.float32)  # the last column is 1, for the biases
    h[:, d] = z[:, d] = 1
    np.add(o @ p["O"], x, out=h[:, :d])
    u = h @ np.concatenate([p["W1"], p["b1"][None]])
    np.maximum(u, 0, out=u)
    np.add(u @ p["W2"], h[:, :d], out=z[:, :d])
    g = z @ np.concatenate([p["U"], p["b"][:, None]], axis=1).T
    g = _exp()(g)
    sums = g @ _ones(g.shape[1])
    at = np.arange(0, g.size, g.shape[1]) + vocab.cls[np.maximum(flat, 0)]
    own = g.ravel()[at]
    real = (flat >= 0).astype(np.float32)
    total = np.float32(max(real.sum(), 1))
    loss = float(np.log(sums / own) @ real / total)
    g.ravel()[at] = own - sums  # g times part is the gradient of the logits
    part = (real / total / sums)[:, None]
    out = {"U": g.T @ (z[:, :d] * part), "b": part[:, 0] @ g}
    dz = g @ p["U"]
    dz *= part
    du = dz @ p["W2"].T
    du *= u > 0
    out["W2"], out["W1"], out["b1"] = u.T @ dz, h[:, :d].T @ du, _ones(n) @ du
    dz += du @ p["W1"].T
    out["O"] = o.T @ dz
    do = dz @ p["O"].T
    along, do = np.einsum("ij,ij->i", do, o).reshape(*shape[:2], 1), do.reshape(shape)
    da = do @ v.transpose(0, 2, 1)
    da -= along
    da *= a
    dqkv = np.empty((*shape[:2], 3 * d), np.float32)
    np.matmul(da, k, out=dqkv[..., :d])
    np.matmul(da.transpose(0, 2, 1), q, out=dqkv[..., d : 2 * d])
    np.matmul(a.transpose(0, 2, 1), do, out=dqkv[..., 2 * d :])
    dqkv = dqkv.reshape(-1, 3 * d)
    mixed = x.T @ dqkv
    out["Q"], out["K"], out["V"] = mixed[:, :d] * scale, mixed[:, d : 2 * d], mixed[:, 2 * d :]
    dz += dqkv @ into.T
    out["P"] = dz.reshape(shape).sum(0)
    seen = r.ravel()
    out["E"] = np.flatnonzero(np.bincount(seen))
    cells = np.bincount((seen[:, None] * d + np.arange(d)).ravel(), dz.ravel())
    out["dE"] = cells.reshape(-1, d)[out["E"]].astype(np.float32)
    return loss, out


def learn(p: dict[str, np.ndarray], vocab: Vocabulary, ins: np.ndarray, outs: np.ndarray, rate: float, seed: int, batch: int = 128, state: dict | None = None) -> float:
    """One pass of Adam over the windows, in a shuffled order; changes p, and state, by which a later call goes on. Embeddings
    of ids that a batch lacks stay as they are. Returns the mean loss."""
    order, losses = np.random.default_rng(seed).permutation(len(ins)), []
    state, rest = {} if state is None else state, [k for k in NAMES if k != "E"]
    flat, first = np.concatenate([p[k].ravel() for k in rest]), 0
    for k in rest:  # all but the embeddings are parts of one array, to be moved at once
        p[k] = flat[first : first + p[k].size].reshape(p[k].shape)
        first += p[k].size
    ms = state.setdefault("ms", {"rest": (np.zeros_like(flat), np.zeros_like(flat)), "E": (np.zeros_like(p["E"]), np.zeros_like(p["E"]))})
    step = state.get("step", 0)
    for i in range(0, len(order), batch):
        at = order[i : i + batch]
        loss, grad = gradient(p, vocab, ins[at], outs[at])
        losses.append(loss)
        step += 1
        fix, unfix = np.float32(1 / (1 - 0.9**step)), np.float32(1 / (1 - 0.98**step))
        for x, (m, s), where, g in (
            (flat, ms["rest"], slice(None), np.concatenate([grad[k].ravel() for k in rest])), (p["E"], ms["E"], grad["E"], grad["dE"]),
        ):
            mk, sk = m[where], s[where]
            mk += np.float32(0.1) * (g - mk)
            sk += np.float32(0.02) * (g * g - sk)
            m[where], s[where] = mk, sk
            x[where] -= np.float32(rate) * fix * mk / (np.sqrt(sk * unfix) + np.float32(1e-6))
    state["step"] = step
    return float(np.mean(losses)) if losses else 0.0
