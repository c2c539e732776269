"""Language-model scores from a causal self-attention model over subword ids, trained in numpy.

Subwords come from a public byte-pair vocabulary, whose path is a parameter (without the file the query fails); each word (a
run without ASCII white space, A-Z lower-cased) is encoded with a space before it, and an end mark follows the last. The model
has one masked attention layer over token embeddings, with a learned bias for each distance, a residual path, and a softmax in
two levels (a cluster of classes of like frequency, then the class within) over all subwords of training, one class for all
others, and the end; a subword that training lacks has an equal share of the class of others.

Texts are cut into blocks of STRIDE tokens; each block's queries attend, causally, to itself and the block before it, so
windows of 2 * STRIDE overlap by half and every token is scored exactly once. Blocks of many texts form one batch, and the
mask keeps out later tokens, other texts and padding.

Words and subwords are counted over all training texts, and the output's biases start from these counts. Then all windows of
all training texts train the weights, in ROUNDS rounds. A hash of id and text deals the texts into shards of about
SHARD_TOKENS tokens, and a shard into a round. In a round each shard is trained by Adam from the round's weights, its texts in
the order of their hashes; the shards' weights are averaged by tokens and start the next round. Shards depend on the rows
alone, so the split into files and tasks changes the scores by no more than the rounding of these sums. A shard takes about
STEPS steps, of LEAST_BATCH blocks at least and BATCH at most.

The base score is a smoothed unigram model of words. The most frequent words, 2 ** FREQUENT_BITS at most, are broadcast;
all others are counted by text and joined with the table of counts.

Null texts count as empty and have the end mark alone. Repeated rows are scored each for itself. Very long texts are one row of
a task, and are worked through in pieces. Without training texts the base score is 0 a token less nothing known, and the model
has the class of others alone. Empty tables give an empty result. Columns other than the id and text are not read.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import crc_fold, materialize, small_batches, table
from .tokens import Words, slices

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WIDTH, KEYS, VALUES, STRIDE = 24, 8, 16, 16
#: A cluster of the softmax grows while its classes times its share of all tokens are at most SPAN. Logits are shifted where sums of their exponentials are beyond those of -LIMIT and LIMIT.
SPAN, LIMIT = 1.0, 60.0
LEAST_SUM, MOST_SUM = np.exp(-LIMIT), np.exp(LIMIT)
#: Steps a shard, blocks a step; Adam's rate in the first and the last round.
STEPS, LEAST_BATCH, BATCH, RATE, LAST_RATE = 64, 16, 512, 3e-2, 3e-3
SHARD_TOKENS, ROUNDS, MOST_TASKS = 1 << 19, 8, 8192
FREQUENT_BITS, LEAST_COUNTS = 20, 1024
#: Blocks scored at once; distinct words a task remembers, and the first bits of their hashes by which it finds them.
CHUNK, REMEMBERED, SLOT_BITS = 1024, 1 << 20, 22
#: Rows of a piece of the attention; places of a piece of the softmax; counts of words that a task holds before it sums them.
ROWS, PIECE, HELD = 256, 1024, 1 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file: base64 of the bytes and the rank, a line each."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def bytes_of(words: Words, first: np.ndarray, before: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of words, by their places, one after the other, each with some bytes before it; their sizes."""
    start = words.start[first] - before
    size = words.end[first] - start
    return words.data[np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)], size


class Subwords:
    """Words to subword ids. Each distinct word is encoded once, as long as no more than REMEMBERED are known; log: what is noted for a word's hash."""

    def __init__(self, ranks: dict[bytes, int], log=None):
        import tiktoken

        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.opens = np.zeros(max(ranks.values(), default=0) + 1, bool)
        self.opens[[r for b, r in ranks.items() if b[:1] == b" "]] = True
        self.log = log or (lambda h: np.zeros(len(h)))
        self.forget()

    def forget(self) -> None:
        self.slot, self.n = np.zeros(1 << SLOT_BITS, np.int32), 1
        self.hash, self.begin, self.size, self.noted, self.flat = np.zeros(1024, np.uint64), np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024), np.zeros(0, np.int32)

    def each(self, words: Words, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, by their places, in order; how many each has. They are encoded as one text: words hold no space, so a
        subword that begins with one, and no other, begins a word."""
        text, size = bytes_of(words, first, 1)
        if not len(size):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        text[np.cumsum(size) - size] = 32
        flat = np.array(self.encode(text.tobytes().decode("utf-8", "replace")), np.int32)
        return flat, np.bincount(np.cumsum(self.opens[flat]) - 1, minlength=len(size))

    def known(self, words: Words) -> np.ndarray:
        """The entry of each word; new words get one. A word's hash points at its last entry with the same first bits."""
        slot = (words.hash >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        at = self.slot[slot].astype(np.int64)
        miss = np.flatnonzero((self.hash[at] != words.hash) | (at == 0))
        if len(miss):
            if self.n > 1 and self.n + len(miss) > REMEMBERED:
                self.forget()
                return self.known(words)
            new, first, inverse = np.unique(words.hash[miss], return_index=True, return_inverse=True)
            flat, size = self.each(words, miss[first])
            a, b = self.n, self.n + len(new)
            while b > len(self.hash):
                self.hash, self.begin, self.size, self.noted = (np.concatenate([x, np.zeros_like(x)]) for x in (self.hash, self.begin, self.size, self.noted))
            self.hash[a:b], self.size[a:b], self.noted[a:b] = new, size, self.log(new)
            self.begin[a:b] = len(self.flat) + np.cumsum(size) - size
            self.flat, self.n = np.concatenate([self.flat, flat]), b
            self.slot[(new >> np.uint64(64 - SLOT_BITS)).astype(np.int64)] = np.arange(a, b)
            at[miss] = a + inverse
        return at

    def of(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the texts in order, how many each text has, and what is noted for each word."""
        at = self.known(words)
        n = self.size[at]
        ends = np.cumsum(n)
        place = np.repeat(self.begin[at] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)
        total = np.concatenate([[0], ends])
        return self.flat[place], total[words.first + words.count] - total[words.first], self.noted[at]


def blocks(ids: np.ndarray, sizes: np.ndarray, begin: int, end: int, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of STRIDE inputs and targets (pad: none), the text of each row, and whether it is the text's first. sizes: of the texts."""
    rows = sizes // STRIDE + 1
    start = (np.cumsum(rows) - rows) * STRIDE
    inputs, targets = np.full((2, int(rows.sum()) * STRIDE), pad, np.int32)
    place = np.arange(len(ids)) + np.repeat(start - np.cumsum(sizes) + sizes, sizes)
    inputs[start] = begin
    inputs[place + 1] = ids
    targets[place], targets[start + sizes] = ids, end
    owner = np.repeat(np.arange(len(sizes)), rows)
    return inputs.reshape(-1, STRIDE), targets.reshape(-1, STRIDE), owner, np.diff(owner, prepend=-1) != 0


def spans(mass: np.ndarray) -> np.ndarray:
    """Edges of clusters of classes by falling mass: a cluster grows while its size times its share of the mass is at most SPAN."""
    total, edges = np.concatenate([[0.0], np.cumsum(mass / mass.sum())]), [0]
    while (i := edges[-1]) < len(mass):
        n = np.searchsorted(np.arange(1, len(mass) - i + 1) * (total[i + 1 :] - total[i]), SPAN, "right")
        edges.append(i + max(1, int(n)))
    return np.array(edges)


def extreme(total: np.ndarray) -> bool:
    """Whether some sum of exponentials is too small or too large to be used, or not a number."""
    return not (LEAST_SUM < total.min(initial=1) and total.max(initial=1) < MOST_SUM)


def exponentials(w: np.ndarray, h: np.ndarray, at: np.ndarray, shift: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of logits w @ h.T (classes, rows): their exponentials, the sum of each row, and the logit of each row's class, which is at a place (flat). shift: by each row's maximum."""
    z = w @ h.T
    if shift:
        z -= z.max(axis=0)
    own = z.ravel()[at]
    np.exp(z, out=z)
    return z, np.ones(len(z), z.dtype) @ z, at, own


def by_row(y: np.ndarray) -> np.ndarray:
    """A view of (features, places) as (rows, features, STRIDE)."""
    return y.reshape(len(y), -1, STRIDE).transpose(1, 0, 2)


class Model:
    """Classes by falling frequency: all subwords of training, one of all others, the end; inputs have begin and pad besides. counts: of all subwords."""

    def __init__(self, counts: np.ndarray, ends: int, seed: int = 3):
        seen = np.flatnonzero(counts)
        mass = np.concatenate([counts[seen], [0, ends]]) + 0.5
        rank = np.argsort(-mass, kind="stable")
        place = np.argsort(rank)
        mass, self.classes = mass[rank], len(mass)
        self.other, self.end, self.begin, self.pad = int(place[-2]), int(place[-1]), len(mass), len(mass) + 1
        self.to_class = np.full(len(counts), self.other)
        self.to_class[seen] = place[:-2]
        self.within = np.where(counts == 0, -np.log(max(1, len(counts) - len(seen))), 0.0)
        self.edges = spans(mass)
        clusters = len(self.edges) - 1
        self.cluster = np.repeat(np.arange(clusters), np.diff(self.edges))
        self.narrow = np.uint16 if self.classes <= 1 << 16 else np.int64  # what is sorted fastest
        whole, rng = np.add.reduceat(mass, self.edges[:-1]), np.random.default_rng(seed)
        make = lambda scale, *s: (rng.standard_normal(s) * scale).astype(np.float32)
        self.p = {
            "E": make(0.3, self.classes + 2, WIDTH), "in": make(WIDTH**-0.5, WIDTH, 2 * KEYS + VALUES), "out": make(VALUES**-0.5, VALUES, WIDTH), "far": np.zeros(2 * STRIDE, np.float32),
            "G": make(0.02, clusters, WIDTH + 1), "O": make(0.02, self.classes, WIDTH + 1),
        }
        self.p["G"][:, WIDTH], self.p["O"][:, WIDTH] = np.log(whole / whole.sum()), np.log(mass / whole[self.cluster])
        self.far = np.maximum(0, np.arange(STRIDE)[:, None] + STRIDE - np.arange(2 * STRIDE))
        self.mask = np.where(np.arange(STRIDE)[:, None] + STRIDE < np.arange(2 * STRIDE), -np.inf, 0).astype(np.float32)

    def attend(self, own: np.ndarray, first: np.ndarray, table: np.ndarray | None = None):
        """own: (rows, STRIDE) inputs, each row after the one before it but where a text is first. The output's inputs h, with a 1
        at the end which takes the biases, and what training needs. But for x and h, places are the last axis, as products of
        small matrices are quick along it."""
        p, n = self.p, len(own)
        table, project = self.table() if table is None else table, np.zeros((VALUES, WIDTH + 1), p["E"].dtype)
        project[:, :WIDTH] = p["out"]
        x = table.take(own.ravel(), axis=0)
        # Queries, keys, values and a 1. STRIDE empty places come first, so that a row's window starts at the row before it.
        qkv = np.empty((2 * KEYS + VALUES + 1, (n + 1) * STRIDE), x.dtype)
        qkv[:, :STRIDE], qkv[-1] = 0, 1
        np.matmul(p["in"].T, x[:, :WIDTH].T, out=qkv[:-1, STRIDE:])
        q = by_row(qkv[:KEYS, STRIDE:])
        k, v = (as_strided(y, (n, len(y), 2 * STRIDE), (STRIDE * y.itemsize, *y.strides), writeable=False) for y in (qkv[KEYS : 2 * KEYS], qkv[2 * KEYS :]))
        far, o = (p["far"][self.far] + self.mask).astype(x.dtype), np.empty((VALUES + 1, n * STRIDE), x.dtype)
        for shift in (False, True):
            a = q.transpose(0, 2, 1) @ k
            a += far
            if shift:
                a[first, :, :STRIDE] = a[:1, :, :STRIDE] = -np.inf
                a -= a.max(axis=2, keepdims=True)
            with np.errstate(over="ignore", invalid="ignore"):
                np.exp(a, out=a)
                a[first, :, :STRIDE] = a[:1, :, :STRIDE] = 0
                np.matmul(v, a.transpose(0, 2, 1), out=by_row(o))
            if not extreme(o[VALUES]):
                break
        o, weight = o[:VALUES], o[VALUES]
        o /= weight
        h = o.T @ project
        h += x
        return h, (x[:, :WIDTH], q, k, v, a, o, weight)

    def table(self) -> np.ndarray:
        """The embeddings with a 1 at the end."""
        out = np.ones((len(self.p["E"]), WIDTH + 1), self.p["E"].dtype)
        out[:, :WIDTH] = self.p["E"]
        return out

    def attended(self, own: np.ndarray, first: np.ndarray, keep: bool = False):
        """attend() in pieces of ROWS rows, each with the row before it, so that a piece stays in a core's cache. keep: also the
        pieces' (row from which it is held, first row) and what training needs."""
        table, out, kept = self.table(), np.empty((own.size, WIDTH + 1), self.p["E"].dtype), []
        for i in range(0, len(own), ROWS):
            a = max(0, i - 1)
            h, more = self.attend(own[a : i + ROWS], first[a : i + ROWS], table)
            out[i * STRIDE : (i + ROWS) * STRIDE] = h[(i - a) * STRIDE :]
            if keep:
                kept.append((a, i, more))
        return out, kept

    def outputs(self, targets: np.ndarray):
        """The targets that aren't pad, in order of their classes: (places, targets, bounds of the clusters among them)."""
        t = targets.ravel()
        live = np.flatnonzero(t != self.pad)
        live = live[np.argsort(t[live].astype(self.narrow), kind="stable")]
        t = t[live]
        return live, t, np.searchsorted(t, self.edges)

    def softmaxes(self, h: np.ndarray, t: np.ndarray, bounds: np.ndarray, shift: bool):
        """Both levels for rows of h, in order of their classes t: (weights' name, rows, classes, exponentials and so on)."""
        cluster, place, size = self.cluster[t], np.arange(len(t)), np.diff(bounds)
        at = cluster * np.minimum(PIECE, len(t) - place // PIECE * PIECE) + place % PIECE
        for i in range(0, len(t), PIECE):
            rows = slice(i, min(i + PIECE, len(t)))
            yield "G", rows, slice(None), *exponentials(self.p["G"], h[rows], at[rows], shift)
        at = (t - self.edges[cluster]) * size[cluster] + place - bounds[cluster]
        for x, y, e, f in zip(bounds[:-1], bounds[1:], self.edges[:-1], self.edges[1:], strict=True):
            if y > x and f > e + 1:
                yield "O", slice(x, y), slice(e, f), *exponentials(self.p["O"][e:f], h[x:y], at[x:y], shift)

    def log_likelihood(self, h: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Log probability of each row's targets."""
        live, t, bounds = self.outputs(targets)
        h = h.take(live, axis=0)
        for shift in (False, True):
            got, totals = np.zeros(len(t), h.dtype), {k: np.ones(len(t), h.dtype) for k in "GO"}
            with np.errstate(over="ignore"):
                for name, rows, _, _, total, _, own in self.softmaxes(h, t, bounds, shift):
                    got[rows] += own
                    totals[name][rows] = total
            if not any(map(extreme, totals.values())):
                break
        whole = np.zeros(targets.size)
        whole[live] = got - np.log(totals["G"]) - np.log(totals["O"])
        return whole.reshape(targets.shape).sum(axis=1)

    def distribution(self, h: np.ndarray) -> np.ndarray:
        """Log probabilities of all classes for rows of h."""
        log = lambda z: (z := z - z.max(axis=0)) - np.log(np.exp(z).sum(axis=0))
        outer = log(self.p["G"] @ h.T)
        return np.concatenate([outer[c] + log(self.p["O"][e:f] @ h.T) for c, (e, f) in enumerate(zip(self.edges, self.edges[1:], strict=False))]).T

    def gradients(self, own: np.ndarray, targets: np.ndarray, first: np.ndarray) -> tuple[float, dict]:
        """Mean loss of the targets that aren't pad, and the gradient of each weight."""
        p = self.p
        h, kept = self.attended(own, first, keep=True)
        live, t, bounds = self.outputs(targets)
        hl, n, kind = h.take(live, axis=0), max(1, len(live)), h.dtype
        for shift in (False, True):
            g, back = {k: np.zeros_like(p[k]) for k in "EGO"}, np.zeros((WIDTH, len(t)), kind)
            got, totals = np.zeros(len(t), kind), {k: np.ones(len(t), kind) for k in "GO"}
            with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                for name, rows, classes, z, total, at, logit in self.softmaxes(hl, t, bounds, shift):
                    got[rows] += logit
                    totals[name][rows] = total
                    z.ravel()[at] -= total
                    z *= 1 / (n * total)
                    if name == "G":
                        g["G"] += z @ hl[rows]
                    else:
                        np.matmul(z, hl[rows], out=g["O"][classes])
                    back[:, rows] += p[name][classes, :WIDTH].T @ z
            if not any(map(extreme, totals.values())):
                break
        loss = float((got - np.log(totals["G"]) - np.log(totals["O"])).sum())
        place = np.full(len(h), len(t))
        place[live] = np.arange(len(t))
        dh = np.zeros((len(t) + 1, WIDTH), kind)
        dh[:-1] = back.T
        dh = dh.take(place, axis=0)
        # The attention. What comes back to a row's window goes to the row and to the one before it, which a piece holds for that alone.
        g |= {k: np.zeros_like(p[k]) for k in ("out", "in", "far")}
        dx, far = np.zeros_like(dh), np.zeros((STRIDE, 2 * STRIDE), kind)
        for start, i, (x, q, k, v, a, o, weight) in kept:
            part = slice(start * STRIDE, (i + ROWS) * STRIDE)
            dp = dh[part]
            if start < i:
                dp = dp.copy()
                dp[:STRIDE] = 0
            g["out"] += o @ dp
            do = np.empty((VALUES + 1, len(dp)), kind)
            np.matmul(p["out"], dp.T, out=do[:VALUES])
            do[:VALUES] /= weight
            do[VALUES] = -np.einsum("vn,vn->n", do[:VALUES], o)
            da = by_row(do).transpose(0, 2, 1) @ v
            da *= a
            far += da.sum(axis=0)
            dqkv, before = np.empty((2 * KEYS + VALUES, len(dp)), kind), np.empty((KEYS + VALUES, len(dp)), kind)
            np.matmul(k, da.transpose(0, 2, 1), out=by_row(dqkv[:KEYS]))
            for half, out in ((slice(STRIDE), before), (slice(STRIDE, None), dqkv[KEYS:])):
                np.matmul(q, da[:, :, half], out=by_row(out[:KEYS]))
                np.matmul(by_row(do[:VALUES]), a[:, :, half], out=by_row(out[KEYS:]))
            dqkv[KEYS:, :-STRIDE] += before[:, STRIDE:]
            g["in"] += (dqkv @ x).T
            dp += dqkv.T @ p["in"].T
            dx[part] += dp
        g["far"] += np.bincount(self.far.ravel(), weights=far.ravel(), minlength=2 * STRIDE).astype(kind)
        # A target is the input of the place after it, so that the order of the targets serves the embeddings too; an end's next place is a begin or pad.
        after, flat = np.minimum(live + 1, len(dx) - 1), own.ravel()
        gone = flat[after] != t
        after = dx.take(after, axis=0)
        after[gone] = 0
        if len(t):
            starts = np.flatnonzero(np.diff(t, prepend=-1))
            g["E"][t[starts]] = np.add.reduceat(after, starts, axis=0)
        g["E"][self.begin] = dx[flat == self.begin].sum(axis=0)
        return -loss / n, g

    def adam(self, rate):
        """A function that takes a batch and makes one step of Adam; rate: of the step's number from 1."""
        m, v, t = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0

        def step(own: np.ndarray, targets: np.ndarray, first: np.ndarray) -> float:
            nonlocal t
            t += 1
            loss, g = self.gradients(own, targets, first)
            # m and v are 10 and 100 times the usual ones, which saves their scaling.
            root = (1 - 0.99**t) ** -0.5
            size, least = np.float32(rate(t) / (1 - 0.9**t) / root), np.float32(1e-7 / root)
            for k, grad in g.items():
                m[k] *= np.float32(0.9)
                m[k] += grad
                grad *= grad
                v[k] *= np.float32(0.99)
                v[k] += grad
                np.sqrt(v[k], out=grad)
                grad += least
                np.divide(m[k], grad, out=grad)
                grad *= size
                self.p[k] -= grad
            return loss

        return step

    def train(self, ids: np.ndarray, sizes: np.ndarray, rate: float) -> int:
        """Adam over all windows of the texts, in order. The number of targets."""
        own, targets, _, first = blocks(self.to_class[ids], sizes, self.begin, self.end, self.pad)
        step, batch = self.adam(lambda t: rate * min(1, t / 10)), min(BATCH, max(LEAST_BATCH, len(own) // STEPS))
        for i in range(0, len(own), batch):
            a, b = max(0, i - 1), i + batch
            t = targets[a:b]
            if a < i:  # the block before, for the first one's window
                t = t.copy()
                t[0] = self.pad
            step(own[a:b], t, first[a:b])
        return len(ids) + len(sizes)

    def score(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Log10 probability of each text, its end included."""
        own, targets, owner, first = blocks(self.to_class[ids], sizes, self.begin, self.end, self.pad)
        out = np.zeros(len(own))
        for i in range(0, len(own), CHUNK):
            a, b = max(0, i - 1), i + CHUNK
            h, _ = self.attended(own[a:b], first[a:b])
            out[i:b] = self.log_likelihood(h[(i - a) * STRIDE :], targets[i:b])
        total = np.bincount(owner, weights=out, minlength=len(sizes))
        if len(ids):
            total += np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=self.within[ids], minlength=len(sizes))
        return total / np.log(10)


def hold_memory() -> None:
    """glibc gives freed memory back to the system beyond twice the largest block, of 32 MB at most, that it has seen mapped and
    freed; getting it anew for each batch costs a page fault a page. The block here is never touched."""
    np.empty(30 << 20, np.uint8)


def texts_in(column: pa.Array, kind: np.dtype):
    """Pieces of a column of ids as bytes: (first row, row after the last, all ids, how many each row has)."""
    for a, b in slices(column):
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset + a : column.offset + b + 1]
        data = column.buffers()[2]
        yield a, b, np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(kind) if data is not None else np.zeros(0, kind), np.diff(offsets).astype(np.int64) // kind.itemsize


def learned(model: Model, train: DataFrame, tokens: int, kind: np.dtype) -> Model:
    """(h: hash of id and text, ids) of all training texts, which have so many tokens -> the model trained on all of them."""
    shards = ROUNDS * max(1, -(-tokens // (ROUNDS * SHARD_TOKENS)))
    tasks = min(MOST_TASKS, shards // ROUNDS)
    dealt = train.withColumn("shard", F.pmod("h", F.lit(shards)))
    names = list(model.p)
    for i in range(ROUNDS):
        rate = RATE * (LAST_RATE / RATE) ** (i / max(1, ROUNDS - 1))
        part = dealt.where(F.col("shard") % ROUNDS == i).repartition(tasks, "shard").sortWithinPartitions("shard", "h", "ids").select("shard", "ids")
        model = averaged(model, part, names, rate, kind, tasks)
    return model


def averaged(model: Model, part: DataFrame, names: list[str], rate: float, kind: np.dtype, tasks: int) -> Model:
    """Every shard is trained from the same weights, which are then averaged by tokens: by task, in parts, and on the driver."""
    shared = part.sparkSession.sparkContext.broadcast(model)

    def learn(batches):
        hold_memory()
        own, total, weights = shared.value, 0, np.zeros(0)
        start, held, of = own.p, [], None

        def spend():
            nonlocal total, weights
            own.p = {k: v.copy() for k, v in start.items()}
            n = own.train(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), rate)
            flat = np.concatenate([own.p[k].ravel() for k in names]).astype(np.float64) * n
            total, weights, own.p = total + n, weights + flat if total else flat, start

        for batch in batches:
            shard = batch.column("shard").to_numpy()
            for a, b, ids, sizes in texts_in(batch.column("ids"), kind):
                edges = [0, *(np.flatnonzero(np.diff(shard[a:b])) + 1).tolist(), b - a]
                ends = np.concatenate([[0], np.cumsum(sizes)])
                for x, y in zip(edges, edges[1:], strict=False):
                    if held and shard[a + x] != of:
                        spend()
                        held = []
                    of = shard[a + x]
                    held.append((ids[ends[x] : ends[y]].copy(), sizes[x:y]))
        if held:
            spend()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([weights.tobytes()], pa.binary())], ["tokens", "weights"])

    def add(batches):
        total, weights = 0, 0
        for batch in batches:
            for n, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total, weights = total + n, weights + np.frombuffer(w)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([weights.tobytes()], pa.binary())], ["tokens", "weights"])

    form, parts = "tokens long, weights binary", min(32, -(-tasks // 16))
    total, weights = 0, 0
    for row in materialize(part.mapInArrow(learn, form).repartition(parts).mapInArrow(add, form)).toLocalIterator():
        total, weights = total + row.tokens, weights + np.frombuffer(row.weights)
    if total:
        at = 0
        for k in names:
            size = model.p[k].size
            model.p[k] = (weights[at : at + size] / total).astype(np.float32).reshape(model.p[k].shape)
            at += size
    shared.destroy()
    return model


def word_counts(train: DataFrame, named: bool = True) -> DataFrame:
    """(text) -> (h, n, word) of every word and its hash, each task's counts summed in parts before the shuffle. Words of one hash are one. named: with the word."""

    def count(batches):
        hold_memory()
        held: list = []

        def flush():
            keys = np.concatenate([x[0] for x in held])
            order = np.argsort(keys)
            keys = keys[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            out = [pa.array(keys[first].view(np.int64)), pa.array(np.add.reduceat(np.concatenate([x[1] for x in held])[order], first))]
            held_words = [pa.concat_arrays([x[2] for x in held]).take(pa.array(order[first]))] if named else []
            return pa.RecordBatch.from_arrays(out + held_words, ["h", "n", "word"][: 2 + named])

        for batch in batches:
            for a, b in slices(batch.column(0)):
                words = Words(batch.column(0).slice(a, b - a))
                if not len(words.hash):
                    continue
                if named:
                    keys, first, n = np.unique(words.hash, return_index=True, return_counts=True)
                    data, size = bytes_of(words, first)
                    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
                    held.append((keys, n, pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())))
                else:
                    held.append(np.unique(words.hash, return_counts=True))
                if sum(len(x[0]) for x in held) > HELD:
                    yield flush()
                    held = []
        if held:
            yield flush()

    # By hash alone, so that both sums need one shuffle; the first is a hash aggregate, which a maximum of words would not be.
    if not named:
        return train.select("text").mapInArrow(count, "h long, n long").repartition("h").groupBy("h").agg(F.sum("n").alias("n"))
    parts = train.select("text").mapInArrow(count, "h long, n long, word binary").repartition("h")
    return parts.groupBy("h", "word").agg(F.sum("n").alias("n")).groupBy("h").agg(F.sum("n").alias("n"), F.first("word").alias("word"))


def least_count(counts: DataFrame, total: int) -> int:
    """The least count of words such that those with it or more are 2 ** FREQUENT_BITS at most: found exactly up to LEAST_COUNTS, else one that suffices for any table of so many tokens."""
    held = dict(counts.groupBy(F.least("n", F.lit(LEAST_COUNTS)).alias("n")).agg(F.count("*").alias("words")).collect())
    words, floor = 0, -(-total // (1 << FREQUENT_BITS))
    for n in range(LEAST_COUNTS, 0, -1):
        words += held.get(n, 0)
        if words > 1 << FREQUENT_BITS:
            break
        floor = min(floor, n)
    return max(1, floor)


def subword_counts(texts: DataFrame, size: int, kind: np.dtype) -> np.ndarray:
    """The count of each subword in (ids). Tasks send the vocabulary's size at most, summed before the driver."""

    def count(batches):
        pieces = np.zeros(size, np.int64)
        for batch in batches:
            for _, _, ids, _ in texts_in(batch.column(0), kind):
                pieces += np.bincount(ids, minlength=size)
        have = np.flatnonzero(pieces)
        yield pa.RecordBatch.from_arrays([pa.array(have), pa.array(pieces[have])], ["id", "n"])

    out = np.zeros(size, np.int64)
    for row in texts.mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[row.id] = row.n
    return out


def scored(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, held_out, text) -> the columns of op7; the texts that aren't held out train."""
    spark = docs.sparkSession
    small_batches(spark)
    vocabulary = load_ranks(tokenizer)
    size = max(vocabulary.values(), default=0) + 1
    kind = np.dtype(np.uint16 if size <= 1 << 16 else np.int32)
    ranks = spark.sparkContext.broadcast(vocabulary)
    text = F.col("text").cast("string")
    train = docs.where(~F.col("held_out")).select(text.alias("text"))
    counts = materialize(word_counts(train, named=False))
    ends = train.count()
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, distinct = whole.n + ends, whole.v + (ends > 0)
    bottom, floor = total + 0.5 * (distinct + 1), least_count(counts, total)
    frequent = counts.where(F.col("n") >= floor).select("h", "n").toArrow()
    order = np.argsort(frequent.column("h").to_numpy())
    known = spark.sparkContext.broadcast((frequent.column("h").to_numpy()[order], np.log10((frequent.column("n").to_numpy()[order] + 0.5) / bottom)))

    def encode(batches):
        hold_memory()
        hashes, log = known.value

        def noted(h: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(hashes, h.view(np.int64)), max(0, len(hashes) - 1))
            return np.where(hashes[at] == h.view(np.int64), log[at], np.nan) if len(hashes) else np.full(len(h), np.nan)

        subwords = Subwords(ranks.value, noted)
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, b in slices(batch.column("text")):
                part = batch.slice(a, b - a)
                words, texts = Words(part.column("text")), b - a
                ids, sizes, log_of = subwords.of(words)
                hit = ~np.isnan(log_of)
                base = np.bincount(words.doc[hit], weights=log_of[hit], minlength=texts) + np.log10((ends + 0.5) / bottom)
                seen = np.bincount(words.doc[hit], minlength=texts) + (ends > 0)
                doc, rest = words.doc[~hit], words.hash.view(np.int64)[~hit]
                sort = np.lexsort((rest, doc))
                doc, rest = doc[sort], rest[sort]
                first = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(rest) != 0)])) if len(doc) else np.zeros(0, np.int64)
                times = np.diff(np.append(first, len(doc)))
                offsets = pa.array(np.searchsorted(doc[first], np.arange(texts + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (rest[first], times.astype(np.int32))]
                ends_at = np.concatenate([[0], np.cumsum(sizes)]) * kind.itemsize
                packed = pa.Array.from_buffers(pa.large_binary(), texts, [None, pa.py_buffer(ends_at.astype(np.int64)), pa.py_buffer(ids.astype(kind))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(uid + np.arange(texts)), part.column("doc_id"), part.column("held_out"), part.column("h"), pa.array(words.count + 1), pa.array(seen.astype(np.int64)), pa.array(base), packed, *lists], ["uid", "doc_id", "held_out", "h", "n_tokens", "seen", "base", "ids", "words", "times"])
                uid += texts

    key = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "held_out", F.xxhash64("doc_id", text).alias("h"), text.alias("text"))
    part = materialize(rows.mapInArrow(encode, f"uid long, doc_id {key}, held_out boolean, h long, n_tokens long, seen long, base double, ids binary, words array<long>, times array<int>"))
    learning = part.where(~F.col("held_out"))
    pieces = subword_counts(learning.select("ids"), size, kind)
    model = learned(Model(pieces, ends), learning.select("h", "ids"), int(pieces.sum()) + ends, kind)
    shared = spark.sparkContext.broadcast(model)

    def score(batches):
        hold_memory()
        for batch in batches:
            got = [shared.value.score(ids, sizes) for _, _, ids, sizes in texts_in(batch.column("ids"), kind)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(got) if got else np.zeros(0))], [*batch.schema.names[:-1], "score"])

    rare = part.select("uid", F.explode(F.arrays_zip("words", "times")).alias("w")).select("uid", F.col("w.words").alias("h"), F.col("w.times").alias("times"))
    rare = rare.join(counts.where(F.col("n") < floor).select("h", "n"), "h", "left")
    log = F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(float(bottom)))
    sums = rare.groupBy("uid").agg(F.sum(F.col("times") * log).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("also"))
    scores = part.select("uid", "doc_id", "held_out", "n_tokens", "seen", "base", "ids").mapInArrow(score, f"uid long, doc_id {key}, held_out boolean, n_tokens long, seen long, base double, score double")
    out = scores.join(sums, "uid", "left")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("seen") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score")


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs.select("doc_id", (crc_fold("doc_id", 5) == 1).alias("held_out"), "text"))
