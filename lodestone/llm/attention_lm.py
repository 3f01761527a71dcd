"""Language-model scoring with a causal self-attention model trained in numpy on subword ids.

Tokens are the ids of a public byte-level tokenizer over the text with A-Z lowered, then one end id.
A position's input is the sum of an embedding of the id before it, of a hashed embedding of the two ids
before it and of its place in the window; one layer of masked attention and a feed-forward layer follow.
The output is factored in two steps, group and id within group, over the ids counted in all training
documents.  Each step adds to the attention's logits a bias that depends on the id before, which is fitted in
closed form from the smoothed counts of neighbouring ids of all training documents.  Ids beyond the
SLOTS - 1 most frequent share one slot and are told apart by their smoothed counts, so every text has a
positive probability and each step sums to one.

Texts are scored in overlapping windows of CONTEXT + STRIDE inputs: a window advances by STRIDE, the
first CONTEXT positions are context only, and every token is scored once by batched masked attention.

Every text is tokenized once.  Counts of words, ids and neighbouring ids come from all training documents.
The rest of the model is fitted by gradient steps: a first model on whole distinct documents of at most
WARM_IDS ids and WARM documents, then every partition of the training documents passes over all windows of
all its documents, and the parameters are averaged in the cluster, so the work and the data gathered grow
with the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import scratch

DIM = 16
CONTEXT = 8
STRIDE = 16
SPAN = CONTEXT + STRIDE
GROUPS = 32
WIDE = 48
SLOTS = GROUPS * WIDE
START = SLOTS  # the slot of the input before the first token
HIDDEN = 32
#: Rows of the hashed embedding of the two ids before a position.
PAIRS = 1 << 16
#: Counts that a neighbour's smoothing by the overall counts weighs.
SMOOTH = 12.0
#: Windows scored at once, and windows in a gradient step.
BATCH = 256
STEP = 128
#: Ids of texts that are held at once, one whole text at least.
TOKENS = 400_000
#: UTF-8 bytes of texts that a worker tokenizes at once, one whole text at least.
ROOM = 4_000_000
#: Distinct words after which a piece of documents ends; bounds a worker's table of words.
PIECE = 500_000
#: Parts of the words by their hash, at most 65,536; each part's words are summed in one task.
BUCKETS = 1024
#: Distinct documents and ids that the first model is fitted on at most, and its passes over them.
WARM, WARM_IDS, WARM_PASSES = 1000, 300_000, 2
#: The pass over all training documents takes one of SHARE of their windows: every one.
SHARE = 1
RATE, SPARSE_RATE = 5e-3, 0.3
#: Models averaged at once, and rows of the hashed embedding that travel together.
FAN, ROWS = 16, 1 << 13
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
SPARSE = ("emb", "pair")
F32 = np.float32
CAUSAL = np.tri(SPAN, dtype=F32)[CONTEXT:]
ONES_WIDE = np.ones(WIDE, F32)


def keep_pages() -> None:
    """Arrays up to 16 MB take the pages of freed ones, of which 64 MB are kept.

    By glibc's defaults the arrays of each step may give their pages back and fault new ones in: in a process
    of its own a quarter of a gradient step's time; a gain in Spark's workers was not found.
    """
    import ctypes

    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt:
        mallopt(-3, 16 << 20)  # M_MMAP_THRESHOLD
        mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD


def held_out(doc_id: int) -> bool:
    import zlib

    return zlib.crc32(str(doc_id).encode()) % 7 == 2


class Vocabulary:
    """Slots of ids by falling count: group = slot // WIDE; the last slot in use stands for all other ids."""

    def __init__(self, counts: dict[int, int], size: int):
        ranked = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
        top = ranked[: SLOTS - 1]
        self.slots = len(top) + 1
        self.slot = np.full(size, len(top), np.int32)
        self.extra = np.zeros(size)  # log10 of the id within the shared slot
        for s, (i, _) in enumerate(top):
            self.slot[i] = s
        rest = np.ones(size)
        for i, c in ranked[len(top) :]:
            rest[i] += c
        mine = self.slot == len(top)
        self.extra[mine] = np.log10(rest[mine] / max(rest[mine].sum(), 1))
        self.count = np.zeros(SLOTS)
        self.count[: self.slots] = 1
        for s, (_, c) in enumerate(top):
            self.count[s] += c


def neighbour_bias(pairs: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Logs of p(group | slot before) and p(slot | group, slot before), from counts by (slot before, slot)."""
    p = pairs + SMOOTH * (vocab.count / vocab.count.sum())
    p /= p.sum(axis=1, keepdims=True)
    p = p.reshape(SLOTS + 1, GROUPS, WIDE)
    group = p.sum(axis=2)
    with np.errstate(divide="ignore", invalid="ignore"):
        within = np.log(p / group[:, :, None])
    # slots without an id get no probability
    return np.maximum(np.log(np.maximum(group, 1e-30)), -30).astype(F32), np.nan_to_num(np.maximum(within, -1e4), nan=0.0).astype(np.float16)


def init(seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    w = lambda scale, *s: (r.standard_normal(s) * scale).astype(F32)
    return {
        "emb": w(0.1, SLOTS + 1, DIM), "pair": np.zeros((PAIRS, DIM), F32), "pos": w(0.01, SPAN, DIM), "q": w(0.1, DIM, DIM), "k": w(0.1, DIM, DIM),
        "v": w(0.1, DIM, DIM), "o": w(0.1, DIM, DIM), "f1": w(0.2, 2 * DIM, HIDDEN), "b1": np.zeros(HIDDEN, F32), "f2": w(0.1, HIDDEN, DIM),
        "g": w(0.01, DIM, GROUPS), "w": w(0.01, GROUPS, DIM, WIDE),
    }


def pairs_of(x: np.ndarray) -> np.ndarray:
    """Row of the hashed embedding of each position's two last inputs."""
    x = x.astype(np.uint32)  # wraps at a multiple of PAIRS, which is a power of two
    rows = x * np.uint32(7919)
    x *= np.uint32(1_000_003)
    rows[:, 1:] += x[:, :-1]
    rows[:, 0] += np.uint32(START * 1_000_003)
    rows &= np.uint32(PAIRS - 1)
    return rows.astype(np.intp)


def _by_group(target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, slot within it, order by group, cuts of the order)."""
    group = target // WIDE
    order = np.argsort(group.astype(np.uint8), kind="stable")
    return group, target - group * WIDE, order, np.searchsorted(group[order], np.arange(GROUPS + 1))


def _attend(p: dict[str, np.ndarray], x: np.ndarray, pad: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """(inputs, queries, keys, values, weights); rows: pairs_of(x)."""
    e = p["emb"].take(x, axis=0)
    e += p["pair"].take(rows, axis=0)
    e += p["pos"]
    # one product for the whole batch, instead of three per window
    qkv = (_flat2(e) @ np.concatenate([p["q"] * p["q"].dtype.type(DIM**-0.5), p["k"], p["v"]], axis=1)).reshape(*x.shape, -1)
    q, k, v = qkv[:, CONTEXT:, :DIM], qkv[..., DIM : 2 * DIM], qkv[..., 2 * DIM :]
    a = q @ k.transpose(0, 2, 1)
    _shift(a, CAUSAL)
    np.exp(a, out=a)
    a *= CAUSAL
    early = np.flatnonzero(pad[:, 0])  # a text's first windows alone reach before it
    if len(early):
        a[early] *= ~pad[early, None, :]
    _divide(_flat2(a))
    return e, q, k, v, a


def _divide(weights: np.ndarray, by: float = 1) -> None:
    """Divides each row by its sum, and by a number."""
    sums = weights @ np.ones(weights.shape[1], weights.dtype)
    np.maximum(sums, F32(1e-30), out=sums)
    np.divide(F32(1) / F32(by), sums, out=sums)
    weights *= sums[:, None]


def _flat2(t: np.ndarray) -> np.ndarray:
    return t.reshape(-1, t.shape[-1])


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b of long, narrow arrays, in parts that stay in cache."""
    parts = 8 if len(a) % 8 == 0 else 1
    return (a.reshape(parts, -1, a.shape[1]).transpose(0, 2, 1) @ b.reshape(parts, -1, b.shape[1])).sum(axis=0)


def _places(use: np.ndarray) -> tuple[np.ndarray | slice, np.ndarray]:
    """(positions of the windows' last STRIDE that are worked on, those of them that aren't used).

    Where few aren't used, all are worked on in place rather than copied together.
    """
    use = use[:, CONTEXT:].ravel()
    unused = np.flatnonzero(~use)
    if len(unused) * 8 < len(use):
        return slice(None), unused
    return np.flatnonzero(use), unused[:0]


def _row_sums(rows: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct rows, sums of d over each, times of each)."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")  # of at most PAIRS rows; 16 bits are sorted by digits
    ranked = rows.take(order)
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    times = np.diff(np.append(first, len(ranked)))
    sums = d.take(order.take(first), axis=0)  # most rows are met once
    again = np.flatnonzero(times > 1)
    if len(again):
        n = times.take(again)
        ends = np.cumsum(n)
        inside = np.arange(ends[-1]) + np.repeat(first.take(again) - ends + n, n)
        sums[again] = _summed(np.repeat(np.arange(len(again)), n), d.take(order.take(inside), axis=0), len(again))
    return ranked[first], sums, times


def _summed(rows: np.ndarray, d: np.ndarray, size: int) -> np.ndarray:
    """Sums of d over each of size rows, 0 where there is none."""
    width = d.shape[1]
    out = np.zeros(size * width, d.dtype)
    np.add.at(out, ((rows * width)[:, None] + np.arange(width)).ravel(), d.ravel())  # one-dimensional: its fast path
    return out.reshape(size, width)


def gradients(p: dict[str, np.ndarray], bias: tuple[np.ndarray, np.ndarray], x: np.ndarray, pad: np.ndarray, target: np.ndarray, use: np.ndarray) -> tuple[float, dict]:
    """(mean loss, gradient of it) over the positions `use` of the windows' last STRIDE.

    The gradients of SPARSE parameters are (rows, sums, times); x: windows of input slots, pad: True for
    positions before the text.
    """
    hashed = pairs_of(x)
    e, q, k, v, a = _attend(p, x, pad, hashed)
    c = a @ v
    own, unused = _places(use)
    mine, mixed = _flat2(e[:, CONTEXT:])[own], _flat2(c)[own]
    n = len(mine)
    used = max(1, n - len(unused))
    # the last column is for the bias
    h0 = np.ones((n, 2 * DIM + 1), e.dtype)
    h0[:, :DIM] = mine
    np.matmul(mixed, p["o"], out=h0[:, DIM : 2 * DIM])
    z = h0 @ np.concatenate([p["f1"], p["b1"][None]])
    r = np.maximum(z, 0)
    h = r @ p["f2"]
    h += mine
    goal, before = target[:, CONTEXT:].flatten()[own], x[:, CONTEXT:].ravel()[own]
    goal[unused] = 0
    group, within, order, cuts = _by_group(goal)
    logits = h @ p["g"]
    logits += bias[0].take(before, axis=0)
    loss = _residuals(logits, group, unused, used)
    grads: dict = {"g": _product(h, logits), "w": np.zeros_like(p["w"])}
    dh = logits @ p["g"].T
    ranked, logits = h.take(order, axis=0), bias[1].reshape(-1, WIDE).take((before * GROUPS + group).take(order), axis=0)
    spans = [(g, slice(i, j)) for g, (i, j) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())) if i < j]
    logits = logits.astype(h.dtype, copy=False)
    inner = np.empty_like(logits)
    for g, s in spans:
        np.dot(ranked[s], p["w"][g], out=inner[s])
    logits += inner
    at = np.empty_like(order)
    at[order] = np.arange(n)
    loss += _residuals(logits, within.take(order), at.take(unused), used)
    back = np.empty_like(ranked)
    for g, s in spans:
        own_logits = logits[s]
        np.dot(ranked[s].T, own_logits, out=grads["w"][g])
        np.dot(own_logits, p["w"][g].T, out=back[s])
    dh += back.take(at, axis=0)
    grads["f2"] = _product(r, dh)
    dz = dh @ p["f2"].T
    dz *= z > 0
    wide = _product(h0, dz)
    grads["f1"], grads["b1"] = wide[:-1], wide[-1]
    dh0 = dz @ p["f1"].T
    grads["o"] = _product(mixed, np.ascontiguousarray(dh0[:, DIM:]))
    dh += dh0[:, :DIM]
    dc = np.zeros_like(c)
    _flat2(dc)[own] = dh0[:, DIM:] @ p["o"].T
    dqkv = np.empty((*x.shape, 3 * DIM), e.dtype)
    dqkv[:, :CONTEXT, :DIM] = 0
    ds = dc @ v.transpose(0, 2, 1)
    ds -= np.einsum("bij,bij->bi", dc, c)[..., None]  # the weighted sum of ds over a position's inputs
    ds *= a
    np.matmul(ds, k, out=dqkv[:, CONTEXT:, :DIM])
    np.matmul(ds.transpose(0, 2, 1), q, out=dqkv[..., DIM : 2 * DIM])
    np.matmul(a.transpose(0, 2, 1), dc, out=dqkv[..., 2 * DIM :])
    scale = e.dtype.type(DIM**-0.5)
    wide = _product(_flat2(e), _flat2(dqkv))
    grads["q"], grads["k"], grads["v"] = wide[:, :DIM] * scale, wide[:, DIM : 2 * DIM], wide[:, 2 * DIM :]
    de = (_flat2(dqkv) @ np.concatenate([p["q"] * scale, p["k"], p["v"]], axis=1).T).reshape(e.shape)
    if isinstance(own, slice):
        de[:, CONTEXT:] += dh.reshape(-1, STRIDE, DIM)
    else:
        _flat2(de)[np.flatnonzero(use)] += dh
    grads["pos"] = (np.ones(len(x), e.dtype) @ de.reshape(len(x), -1)).reshape(SPAN, DIM)
    de = _flat2(de)
    # all rows of the smaller one, in place
    grads["emb"] = slice(None), _summed(x.ravel(), de, len(p["emb"])), None
    grads["pair"] = _row_sums(hashed.ravel(), de)
    return loss / used, grads


def _residuals(logits: np.ndarray, goal: np.ndarray, unused: np.ndarray, used: int) -> float:
    """Turns logits into probabilities less one at the goal, over used, in place; returns the loss.

    unused: rows that don't count.
    """
    _shift(logits)
    np.exp(logits, out=logits)
    _divide(logits, used)
    flat, cells = logits.ravel(), np.arange(0, logits.size, logits.shape[1]) + goal
    own = flat.take(cells)
    mean = F32(1 / used)
    flat[cells] = own - mean
    logits[unused], own[unused] = 0, mean
    return -float(np.log(own * F32(used) + F32(1e-30)).sum())


class Trainer:
    """Adam for the dense parameters, steps by accumulated squares for the rows of the SPARSE ones, in place."""

    def __init__(self, p: dict[str, np.ndarray], bias: tuple[np.ndarray, np.ndarray]):
        self.p, self.bias, self.t, self.seen = p, bias, 0, 0
        # the dense parameters' moments in one line
        self.dense = [n for n in p if n not in SPARSE]
        self.m, self.v = np.zeros((2, sum(p[n].size for n in self.dense)), F32)
        self.squares = {n: np.full(len(p[n]), 1e-8, F32) for n in SPARSE}
        self.touched = np.zeros(PAIRS, F32)

    def step(self, batch: tuple, part: float) -> None:
        """part: how much of the training is done, for the falling rate."""
        x, pad, target, use, _ = batch
        _, grads = gradients(self.p, self.bias, x, pad, target, use)
        self.t += 1
        self.seen += len(x)
        fall = 1 - 0.9 * part
        now = np.concatenate([grads[n].ravel() for n in self.dense])
        self.m *= F32(0.9)
        self.m += F32(0.1) * now
        now *= now
        now *= F32(0.01)
        self.v *= F32(0.99)
        self.v += now
        np.multiply(self.v, F32(1 / (1 - 0.99**self.t)), out=now)
        np.sqrt(now, out=now)
        now += F32(1e-8)
        np.divide(self.m, now, out=now)
        now *= F32(RATE * fall / (1 - 0.9**self.t))
        at = 0
        for n in self.dense:
            a = self.p[n]
            a -= now[at : at + a.size].reshape(a.shape)
            at += a.size
        for n in SPARSE:
            rows, d, times = grads[n]
            now = self.squares[n][rows]
            now += (d * d) @ np.full(DIM, 1 / DIM, F32)
            self.squares[n][rows] = now
            d *= (F32(SPARSE_RATE * fall) / np.sqrt(now))[:, None]
            if times is None:
                self.p[n] -= d
            else:
                np.subtract(self.p[n].take(rows, axis=0), d, out=d)
                whole = f"V{d[0].nbytes}"  # a row as one item is written faster
                self.p[n].view(whole)[rows] = d.view(whole)
                self.touched[rows] += times


def score_windows(p: dict[str, np.ndarray], bias: tuple[np.ndarray, np.ndarray], x: np.ndarray, pad: np.ndarray, target: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Natural log of the probability of the targets at the positions `use` of the windows' last STRIDE."""
    e, _, _, v, a = _attend(p, x, pad, pairs_of(x))
    own, unused = _places(use)
    late, c = _flat2(e[:, CONTEXT:])[own], _flat2(a @ v)[own]
    z = late @ p["f1"][:DIM]
    z += c @ (p["o"] @ p["f1"][DIM:])
    z += p["b1"]
    h = np.maximum(z, 0, out=z) @ p["f2"]
    h += late
    goal, before = target[:, CONTEXT:].flatten()[own], x[:, CONTEXT:].ravel()[own]
    goal[unused] = 0
    group, within, order, cuts = _by_group(goal)
    rows = np.arange(len(goal))
    logits = h @ p["g"]
    logits += bias[0].take(before, axis=0)
    _shift(logits)
    out = logits.ravel().take(rows * GROUPS + group)
    np.exp(logits, out=logits)
    out -= np.log(logits @ np.ones(GROUPS, F32))
    h, within = h.take(order, axis=0), within.take(order)
    logits = np.empty((len(goal), WIDE), F32)
    for g in range(GROUPS):
        i, j = cuts[g], cuts[g + 1]
        if i < j:
            np.dot(h[i:j], p["w"][g], out=logits[i:j])
    logits += bias[1].reshape(-1, WIDE).take((before * GROUPS + group).take(order), axis=0)
    _shift(logits)
    inner = logits.ravel().take(rows * WIDE + within)
    np.exp(logits, out=logits)
    out[order] += inner - np.log(logits @ ONES_WIDE)
    return out[use[:, CONTEXT:].ravel()] if len(unused) else out


def _shift(x: np.ndarray, seen: np.ndarray | None = None) -> None:
    """Takes each row's largest value away where some exp would overflow; values that aren't seen don't count."""
    if x.size and x.max() > 60:
        if seen is not None:
            x -= F32(1e9) * (1 - seen)
        x -= x.max(axis=-1, keepdims=True)


class Windows:
    """The windows of texts' slot sequences; each token is scored once. A window is laid out only when it is taken."""

    def __init__(self, slots: list[np.ndarray]):
        self.lengths = np.fromiter(map(len, slots), np.int64, len(slots))
        windows = -(-self.lengths // STRIDE)
        self.ends = np.cumsum(windows)  # windows up to and with each text
        self.begins = self.ends - windows
        # one line of all inputs: CONTEXT + 1 places before each text, whose windows are whole
        self.line = np.full(len(self) * STRIDE + len(slots) * (CONTEXT + 1), START, np.int32)
        for t, (s, at) in enumerate(zip(slots, (self.begins * STRIDE).tolist())):
            at += (t + 1) * (CONTEXT + 1)
            self.line[at : at + len(s)] = s

    def __len__(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(inputs, padding, targets, scored, text) of the windows of these numbers."""
        text = np.searchsorted(self.ends, numbers, side="right")
        number = numbers - self.begins.take(text)
        rows = np.lib.stride_tricks.sliding_window_view(self.line, SPAN + 1)[numbers * STRIDE + text * (CONTEXT + 1)]
        pad, use = np.zeros((2, len(numbers), SPAN), bool)
        pad[:, :CONTEXT] = (number == 0)[:, None]
        use[:, CONTEXT:] = np.arange(STRIDE) < (self.lengths.take(text) - number * STRIDE)[:, None]
        return rows[:, :-1], pad, rows[:, 1:], use, text


class Scorer:
    def __init__(self, params: dict[str, np.ndarray], bias: tuple[np.ndarray, np.ndarray], vocab: Vocabulary):
        self.p, self.vocab, self.bias = params, vocab, (bias[0], bias[1].astype(F32))

    def score(self, ids: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each sequence of ids; BATCH windows are laid out at a time, however long a text is."""
        total = np.array([self.vocab.extra[i].sum() for i in ids])
        windows = Windows([self.vocab.slot[i] for i in ids])
        for at in range(0, len(windows), BATCH):
            x, pad, target, use, text = windows.take(np.arange(at, min(at + BATCH, len(windows))))
            logp = score_windows(self.p, self.bias, x, pad, target, use)
            first = text[0]
            total[first : text[-1] + 1] += np.bincount(np.repeat(text - first, use.sum(axis=1)), logp, text[-1] - first + 1) / np.log(10)
        return total


def fit(p: dict[str, np.ndarray], bias: tuple[np.ndarray, np.ndarray], slots: list[np.ndarray], passes: int, seed: int) -> int:
    """Passes in place over all windows of texts; returns the windows seen."""
    windows, trainer, r = Windows(slots), Trainer(p, (bias[0], bias[1].astype(F32))), np.random.default_rng(seed)
    total = passes * len(windows)
    for _ in range(passes):
        order = r.permutation(len(windows))
        for at in range(0, len(order), STEP):
            trainer.step(windows.take(order[at : at + STEP]), trainer.seen / total)
    return trainer.seen


class Pass:
    """One pass over the windows of texts that come one after the other; TOKENS ids or one text are held."""

    def __init__(self, p: dict[str, np.ndarray], bias: tuple[np.ndarray, np.ndarray], seed: int):
        self.trainer, self.random = Trainer(p, (bias[0], bias[1].astype(F32))), np.random.default_rng(seed)
        self.slots, self.held, self.windows = [], 0, 0

    def add(self, slots: np.ndarray) -> None:
        self.slots.append(slots)
        self.held += len(slots)
        if self.held >= TOKENS:
            self.flush()

    def flush(self) -> None:
        windows = Windows(self.slots)
        own = self.random.permutation(np.arange(-self.windows % SHARE, len(windows), SHARE))
        self.windows += len(windows)
        for at in range(0, len(own), STEP):
            # an average of models ends the pass, so the rate doesn't fall with an end that isn't known
            self.trainer.step(windows.take(own[at : at + STEP]), 0.6)
        self.slots, self.held = [], 0


def _cut(values: np.ndarray, where: np.ndarray) -> pa.Array:
    """The bytes of runs of values, one from each place up to the next."""
    return pa.Array.from_buffers(pa.binary(), len(where) - 1, [None, pa.py_buffer((where * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def tokenized(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Written table of three kinds of rows, after one pass over the texts.

    Documents: piece, at, doc_id, held, learn, ids (16 bits each, without the end), words (32-bit numbers in the
    piece's list of words).  Words of a piece, by their hash's remainder modulo BUCKETS: piece, bucket, and packed
    words after words the 128 bits of XXH3 in hashes, the numbers, and in times how often the piece's training
    documents hold the word.  Ids of a piece: id, c.  A hot word comes once per piece, not per document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        from lodestone.llm.byte_bpe import ByteBPE
        from lodestone.llm.word_bpe import WordBPE

        keep_pages()
        bpe, piece = WordBPE(ByteBPE(tokenizer_path)), TaskContext.get().partitionId() << 32
        times, ids, at = np.zeros(0, np.int64), np.zeros(65536, np.int64), 0

        def table(n: int, **values) -> pa.RecordBatch:
            values["piece"] = np.full(n, piece)
            return pa.RecordBatch.from_arrays([pa.array(values[f.name], f.type) if f.name in values else pa.nulls(n, f.type) for f in ARROW], schema=ARROW)

        def words() -> Iterator[pa.RecordBatch]:
            hashes = np.empty((len(bpe.words), 2), np.int64)
            for i in range(0, len(bpe.words), 100_000):
                part = bpe.words.slice(i, 100_000).to_pylist()
                hashes[i : i + len(part)] = np.frombuffer(b"".join(xxhash.xxh3_128_digest(word[1:]) for word in part), np.int64).reshape(-1, 2)
            bucket = (hashes[:, 0] & (BUCKETS - 1)).astype(np.uint16)
            order = np.argsort(bucket, kind="stable")
            own, first = np.unique(bucket[order], return_index=True)
            where = np.append(first, len(order)).astype(np.int64)
            for i in range(0, len(own), 64):
                at, part = where[i : i + 65], order[where[i] : where[min(i + 64, len(own))]]
                yield table(len(at) - 1, bucket=own[i : i + 64].astype(np.int32), hashes=_cut(hashes[part].view("V16").ravel(), at - at[0]), numbers=_cut(part.astype(np.int32), at - at[0]), times=_cut(times[part], at - at[0]))
            found = np.flatnonzero(ids)
            yield table(len(found), id=found, c=ids[found])

        for batch in batches:
            text = pc.fill_null(batch.column("text"), "")
            ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False), dtype=np.int64)
            begin = 0
            while begin < len(text):
                # texts of ROOM bytes, one whole text at least
                end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + ROOM)))
                own, where, found, places = bpe.encode(pc.ascii_lower(text.slice(begin, end - begin)))
                doc = batch.column("doc_id").slice(begin, end - begin).to_pylist()
                held = np.array([d is not None and held_out(d) for d in doc], bool)
                learn = np.array([d is not None for d in doc], bool) & ~held
                taught = np.bincount(found[learn.repeat(np.diff(places))], minlength=len(bpe.words))
                taught[: len(times)] += times
                times = taught
                ids += np.bincount(own[learn.repeat(np.diff(where))], minlength=65536)
                yield table(end - begin, at=np.arange(at, at + end - begin), doc_id=doc, held=held, learn=learn, ids=_cut(own.astype("<u2"), where), words=_cut(found, places))
                at, begin = at + end - begin, end
                if len(bpe.words) >= PIECE:
                    yield from words()
                    bpe.clear()
                    times, at, piece = np.zeros(0, np.int64), 0, piece + 1
                    ids[:] = 0
        yield from words()

    return scratch.table(docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, TOKENIZED), "lm-tokens", compression="zstd")


TOKENIZED = "piece long, at int, doc_id long, held boolean, learn boolean, ids binary, words binary, bucket int, hashes binary, numbers binary, times binary, id int, c long"
ARROW = pa.schema([("piece", pa.int64()), ("at", pa.int32()), ("doc_id", pa.int64()), ("held", pa.bool_()), ("learn", pa.bool_()), ("ids", pa.binary()), ("words", pa.binary()), ("bucket", pa.int32()), ("hashes", pa.binary()), ("numbers", pa.binary()), ("times", pa.binary()), ("id", pa.int32()), ("c", pa.int64())])


def _ids(raw: bytes, size: int) -> np.ndarray:
    """Ids of a row of tokenized(), with the end."""
    return np.append(np.frombuffer(raw, "<u2").astype(np.int32), np.int32(size - 1))


def neighbours(learn: DataFrame, shared, size: int) -> np.ndarray:
    """Counts by (slot before, slot) over all rows of learn; at most SLOTS * (SLOTS + 1) numbers reach the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep_pages()
        slot, total = shared.value.slot, np.zeros((SLOTS + 1) * SLOTS, np.int64)
        for batch in batches:
            held: list[np.ndarray] = []
            n = 0

            def add() -> None:
                line = np.concatenate([part for ids in held for part in (np.array([START], np.int32), slot[ids])])
                cell = line[:-1] * np.int32(SLOTS) + line[1:]
                np.add(total, np.bincount(cell[line[1:] != START], minlength=len(total)), out=total)  # noqa: B023

            for raw in batch["ids"]:
                held.append(_ids(raw, size))
                n += len(held[-1])
                if n > 4_000_000:
                    add()
                    held, n = [], 0
            if held:
                add()
        found = np.flatnonzero(total)
        for i in range(0, len(found), 200_000):
            yield pd.DataFrame({"cell": found[i : i + 200_000].astype(np.int32), "c": total[found[i : i + 200_000]]})

    rows = learn.select("ids").mapInPandas(run, "cell int, c long").groupBy("cell").agg(F.sum("c").alias("c")).toPandas()
    out = np.zeros((SLOTS + 1) * SLOTS)
    out[rows["cell"].to_numpy(np.int64)] = rows["c"].to_numpy(np.float64)
    return out.reshape(SLOTS + 1, SLOTS)


def _flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([a.ravel() for a in p.values()])


def averaged(trained: DataFrame, spark: SparkSession) -> DataFrame:
    """Mean models (chunk, vec) of rows (part, chunk, vec, weight), FAN at a time until one is left.

    weight: of the chunk's values, or of equal runs of them.
    """

    def mean(group: pd.DataFrame) -> pd.DataFrame:
        total = weight = 0.0
        for vec, w in zip(group["vec"], group["weight"]):
            w = np.frombuffer(w, F32)
            total, weight = total + np.frombuffer(vec, F32).reshape(len(w), -1) * w[:, None], weight + w
        vec = (total / np.maximum(weight, F32(1e-30))[:, None]).astype(F32)
        return pd.DataFrame({"part": group["part"].iloc[:1] // FAN, "chunk": group["chunk"].iloc[:1], "vec": [vec.tobytes()], "weight": [weight.astype(F32).tobytes()]})

    left = trained.agg(F.coalesce(F.max("part"), F.lit(-1))).first()[0] + 1
    while left > 1:
        trained = scratch.table(trained.withColumn("team", F.expr(f"part div {FAN}")).groupBy("team", "chunk").applyInPandas(lambda g: mean(g.drop(columns="team")), trained.schema), "lm-mean")
        left = -(-left // FAN)
    return trained


def train(learn: DataFrame, params: dict[str, np.ndarray], bias: tuple[np.ndarray, np.ndarray], vocab: Vocabulary, size: int) -> dict[str, np.ndarray]:
    """The average of the models that partitions of learn make of params in their pass."""
    spark = learn.sparkSession
    start = spark.sparkContext.broadcast((params, bias, vocab))

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        keep_pages()
        params, bias, vocab = start.value
        p = {n: a.copy() for n, a in params.items()}
        taught = Pass(p, bias, 2)
        for batch in batches:
            for raw in batch["ids"]:
                taught.add(vocab.slot[_ids(raw, size)])
        taught.flush()
        if not taught.trainer.seen:
            return
        # a row of the hashed embedding weighs as often as it was met, everything else as the windows
        rest, seen = _flat({n: a for n, a in p.items() if n != "pair"}), np.full(1, taught.trainer.seen, F32)
        parts = [(rest, seen)] + [(p["pair"][i : i + ROWS], taught.trainer.touched[i : i + ROWS] + F32(1e-3)) for i in range(0, PAIRS, ROWS)]
        part = TaskContext.get().partitionId()
        for chunk, (vec, weight) in enumerate(parts):
            yield pd.DataFrame({"part": [part], "chunk": [chunk], "vec": [vec.tobytes()], "weight": [weight.tobytes()]})

    trained = scratch.table(learn.select("ids").mapInPandas(local, "part long, chunk int, vec binary, weight binary"), "lm-params")
    chunks = averaged(trained, spark).orderBy("chunk").collect()  # one model
    if not chunks:
        return params
    rest, at = np.frombuffer(chunks[0]["vec"], F32), 0
    out = {"pair": np.frombuffer(b"".join(r["vec"] for r in chunks[1:]), F32).reshape(PAIRS, DIM).copy()}
    for name, a in params.items():
        if name != "pair":
            out[name] = rest[at : at + a.size].reshape(a.shape).copy()
            at += a.size
    return out


def _sum_words(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows of a bucket with the words' counts over all pieces as times; n: of the row's own, kinds: distinct words met."""
    own = [np.frombuffer(t, np.int64) for t in rows["times"]]
    h, c = np.frombuffer(b"".join(rows["hashes"]), np.int64).reshape(-1, 2), np.concatenate(own)
    order = np.lexsort((h[:, 1], h[:, 0]))
    ranked = h[order]
    new = np.append(True, (ranked[1:] != ranked[:-1]).any(axis=1))
    sums = np.add.reduceat(c[order], np.flatnonzero(new))
    counts = np.empty_like(c)
    counts[order] = sums[np.cumsum(new) - 1]
    cuts = np.cumsum([0, *map(len, own)])
    kinds = np.zeros(len(rows), np.int64)
    kinds[0] = (sums > 0).sum()
    return pd.DataFrame({"piece": rows["piece"], "numbers": rows["numbers"], "times": [counts[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], "n": [int(t.sum()) for t in own], "kinds": kinds})


def base_scores(tokens: DataFrame, ends: int) -> tuple[DataFrame, int]:
    """((piece, at, n_tokens, n_known, base_score) of every document, number of training tokens).

    A word's count is summed in its bucket, where it comes once per piece at most, and goes back to each piece,
    where documents look their words up by number.
    """
    words = tokens.filter("bucket IS NOT NULL").select("piece", "bucket", "hashes", "numbers", "times")
    counted = scratch.table(words.groupBy("bucket").applyInPandas(_sum_words, "piece long, numbers binary, times binary, n long, kinds long"), "lm-words")
    n_words, distinct = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    total = n_words + ends
    size = total + distinct + (ends > 0) + 1

    def look_up(words: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        numbers = np.frombuffer(b"".join(words["numbers"]), np.int32)
        c = np.zeros(len(numbers), np.int64)
        c[numbers] = np.frombuffer(b"".join(words["times"]), np.int64)
        log = np.log10((c + 1) / size)
        out = []
        for at, raw in zip(docs["at"], docs["words"]):
            w = np.frombuffer(raw, np.int32)
            out.append((at, len(w) + 1, int((c[w] > 0).sum()) + int(ends > 0), float(log[w].sum()) + float(np.log10((ends + 1) / size))))
        frame = pd.DataFrame(out, columns=["at", "n_tokens", "n_known", "base_score"])
        return frame.assign(piece=docs["piece"].iloc[0] if len(docs) else 0)[["piece", "at", "n_tokens", "n_known", "base_score"]]

    docs = tokens.filter("words IS NOT NULL").select("piece", "at", "words")
    got = counted.select("piece", "numbers", "times").groupBy("piece").cogroup(docs.groupBy("piece")).applyInPandas(look_up, "piece long, at int, n_tokens long, n_known long, base_score double")
    return got, total


def score(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """RESULT, a row per row of docs: base score by counts of words, score by the model.

    docs: doc_id, text; extra columns are ignored.  Null and empty texts have the end token alone.  A null
    doc_id is not held out and isn't learned from; repeated rows are scored and learned from each.  Where
    nothing can be learned from, counts are zero and the model is untrained.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    tokens = tokenized(docs, tokenizer_path)
    texts = tokens.filter("ids IS NOT NULL")
    learn = texts.filter("learn")
    size = 65537  # 16-bit ids and the end
    id_rows = {r["id"]: r["c"] for r in tokens.filter("id IS NOT NULL").groupBy("id").agg(F.sum("c").alias("c")).collect()}  # at most the tokenizer's size
    ends = learn.count()
    if ends:
        id_rows[size - 1] = ends
    vocab = Vocabulary(id_rows, size)
    bias = neighbour_bias(neighbours(learn, spark.sparkContext.broadcast(vocab), size), vocab)
    keep_pages()
    params = init()
    # copies teach nothing: the first model's documents are distinct, in the order of their hash
    hashed = learn.select(F.xxhash64("ids").alias("h"), (F.octet_length("ids") / 2).alias("n"))
    ranked = hashed.groupBy("h").agg(F.max("n").alias("n")).orderBy("h").limit(WARM).collect()
    before = np.cumsum([0, *(r["n"] for r in ranked)])
    chosen = [r["h"] for r, b in zip(ranked, before) if b + r["n"] <= WARM_IDS]
    warm = learn.select("ids", F.xxhash64("ids").alias("h")).filter(F.col("h").isin(chosen)).dropDuplicates(["h"]).orderBy("h").collect() if chosen else []
    fit(params, bias, [vocab.slot[_ids(r["ids"], size)] for r in warm], WARM_PASSES, 1)
    params = train(learn, params, bias, vocab, size)
    shared = spark.sparkContext.broadcast((params, bias, vocab))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep_pages()
        scorer = Scorer(*shared.value)
        for batch in batches:
            done, ids, held = [], [], 0
            for raw in batch["ids"]:
                ids.append(_ids(raw, size))
                held += len(ids[-1])
                if held >= TOKENS:
                    done.append(scorer.score(ids))
                    ids, held = [], 0
            if ids:
                done.append(scorer.score(ids))
            yield batch[["piece", "at", "doc_id", "held"]].assign(doc_id=batch["doc_id"].astype("Int64"), score=np.concatenate(done) if done else np.zeros(0))

    modelled = texts.select("piece", "at", "doc_id", "held", "ids").mapInPandas(run, "piece long, at int, doc_id long, held boolean, score double")
    based, total = base_scores(tokens, ends)
    joined = scratch.table(modelled, "lm-scores").join(based, ["piece", "at"])
    return joined.select("doc_id", F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
