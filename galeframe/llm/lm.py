"""LM scoring: a gated recurrent language model with a class-factored softmax, trained by truncated backpropagation, its state carried through whole documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.llm.common import by_bytes, column, durable, one_thread, text

END = b""  # no word is empty
CLASSES, EACH, TAILS = 64, 64, 64
WORDS = CLASSES * EACH
HIDDEN = 32
MODERATE = 60.0  # exp of it and of its negative, and their products with counts, are far within the range of float32
LONGEST = 64  # bytes of a word of the broadcast head
LOG10 = float(np.log(10))
BLOCK = 512  # rows whose class outputs fit a core's cache


def coded(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, place of each word of all texts among them, number of words of each text).

    Words are runs of characters other than ASCII white space, A-Z in lower case.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = split.flatten().dictionary_encode()
    distinct, at, ends = flat.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist(), flat.indices.to_numpy(), split.offsets.to_numpy()
    ends = ends - ends[0]
    if b"" in distinct:  # beside white space at an end of a text
        keep = at != distinct.index(b"")
        at, ends = at[keep], np.concatenate([[0], np.cumsum(keep)])[ends]
    return distinct, at, np.diff(ends)


def tail_class(word: bytes) -> int:
    """The class of a word that has no output of its own: by its ending."""
    return zlib.crc32(word[-3:]) % TAILS


def word_counts(docs: DataFrame, learn: Column, text_col: str = "text", batch_bytes: int = 1 << 22, flush: int = 1 << 20) -> DataFrame:
    """(token, cls, train, total) over all rows: occurrences where ``learn`` holds, and all; the end of a text is the empty token.

    A task sums its slices' counts whenever they have ``flush`` rows.
    """
    names = ["token", "train", "total"]

    def merged(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by("token").aggregate([("train", "sum"), ("total", "sum")]).select(["token", "train_sum", "total_sum"]).rename_columns(names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            t = merged(parts)
            cls = pa.array([tail_class(k) for k in t.column("token").to_pylist()], pa.int32())
            return pa.RecordBatch.from_arrays([t.column("token").combine_chunks(), cls, t.column("train").combine_chunks(), t.column("total").combine_chunks()], ["token", "cls", "train", "total"])

        parts: list[pa.Table] = []
        for batch in by_bytes(batches, "_text", batch_bytes):
            distinct, at, size = coded(batch.column(1))
            learns = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            train, total = np.bincount(at[np.repeat(learns, size)], minlength=len(distinct)), np.bincount(at, minlength=len(distinct))
            used = np.flatnonzero(total)
            tokens = pa.array([*(distinct[i] for i in used), END], pa.binary())
            parts.append(pa.table([tokens, pa.array(np.append(train[used], learns.sum()), pa.int64()), pa.array(np.append(total[used], len(learns)), pa.int64())], names))
            if sum(p.num_rows for p in parts) > flush:
                parts = [merged(parts)]
                if parts[0].num_rows > flush // 2:
                    yield out()
                    parts = []
        if parts:
            yield out()

    rows = docs.select(learn.alias("_learn"), text(text_col).alias("_text"))
    return rows.mapInArrow(count, "token binary, cls int, train long, total long").groupBy("token", "cls").agg(F.sum("train").alias("train"), F.sum("total").alias("total"))


@dataclass
class Lexicon:
    """The head of the vocabulary: at most ``len(tokens)`` words of LONGEST bytes at most, and numbers for the rest."""

    tokens: list[bytes]
    train: np.ndarray
    total: int  # N
    distinct: int  # V
    model_id: np.ndarray = field(default=None)  # input id: a word's own, or WORDS + its tail class
    place: np.ndarray = field(default=None)  # of a word with an output: class * EACH + place, else -1
    extra: np.ndarray = field(default=None)  # log10 of the share of its tail class, for words without an output
    tail_log: np.ndarray = field(default=None)  # log10 of a tail class's mass
    class_mass: np.ndarray = field(default=None)
    word_mass: np.ndarray = field(default=None)

    @property
    def log_base(self) -> float:
        return float(np.log10(self.total + 0.5 * (self.distinct + 1)))


def lexicon(counts: DataFrame, head: int) -> Lexicon:
    """At most the ``head`` commonest words of all rows go to the driver; masses of tail classes are summed over all words.

    A histogram over 64 steps for each doubling of the count gives the count
    from which on no more than ``head`` words remain.
    """
    short = counts.where(F.octet_length("token") <= LONGEST).withColumn("step", F.floor(F.log2(F.col("total").cast("double")) * 64).cast("int"))
    least, n = 1 << 30, 0
    for r in sorted(short.groupBy("step").count().collect(), reverse=True):
        n += r["count"]
        if n > head:
            break
        least = r["step"]
    top = short.where((F.col("step") >= least) | (F.col("token") == F.lit(END))).select("token", "train", "total").collect()
    top.sort(key=lambda r: (bytes(r["token"]) != END, -r["total"], bytes(r["token"])))
    tokens, train = [bytes(r["token"]) for r in top], np.array([r["train"] for r in top], np.int64)
    if END not in tokens[:1]:
        tokens, train = [END, *tokens], np.concatenate([[0], train])
    by_class = counts.groupBy("cls").agg(F.sum("train").alias("n"), F.sum((F.col("train") > 0).cast("long")).alias("v")).collect()
    mass = np.zeros(TAILS)
    for r in by_class:
        mass[r["cls"]] = r["n"] + 0.5 * r["v"]
    lex = Lexicon(tokens, train, sum(r["n"] for r in by_class), sum(r["v"] for r in by_class))
    cls = np.array([tail_class(t) for t in tokens])
    own = np.array([0, *sorted((i for i in range(1, len(tokens)) if train[i] > 0), key=lambda i: (-train[i], tokens[i]))[: WORDS - 1]])
    np.subtract.at(mass, cls[own], np.where(train[own] > 0, train[own] + 0.5, 0))
    mass = np.maximum(mass, 0) + 0.5  # and one word that was never seen
    lex.place = np.full(len(tokens), -1)
    lex.place[own] = np.arange(len(own))
    lex.model_id = np.where(lex.place >= 0, lex.place, WORDS + cls).astype(np.int32)
    lex.tail_log = np.log10(mass)
    lex.extra = np.where(lex.place >= 0, 0.0, np.log10(train + 0.5) - lex.tail_log[cls])
    lex.word_mass = np.zeros(WORDS)
    lex.word_mass[: len(own)] = train[own] + 0.5
    lex.class_mass = np.concatenate([lex.word_mass.reshape(CLASSES, EACH).sum(1), mass])
    return lex


SHAPES = {"E": (WORDS + TAILS, 3 * HIDDEN), "U": (HIDDEN, 3 * HIDDEN), "Wc": (HIDDEN, CLASSES + TAILS), "bc": (CLASSES + TAILS,), "Wi": (CLASSES, HIDDEN, EACH), "bi": (CLASSES, EACH)}


def fresh(lex: Lexicon, seed: int) -> dict[str, np.ndarray]:
    """Small random weights; output biases give the training words' own frequencies."""
    rng = np.random.default_rng(seed)
    p = {k: rng.normal(0, 0.1 if k in "EU" else 0.02, s).astype(np.float32) for k, s in SHAPES.items()}
    with np.errstate(divide="ignore"):
        p["bc"] = np.maximum(np.log(lex.class_mass), -30).astype(np.float32)
        p["bi"] = np.maximum(np.log(lex.word_mass.reshape(CLASSES, EACH)), -30).astype(np.float32)
    p["bc"] -= p["bc"].max()
    p["bi"] -= p["bi"].max(1, keepdims=True)
    return p


def run_window(p: dict, x: np.ndarray, start: np.ndarray, h: np.ndarray, keep: bool = False):
    """States (T, B, HIDDEN) after each input, from state h; ``start`` marks first inputs of texts, where the state is 0.

    With ``keep`` also (products with U, both gates, new values) of every step,
    a gate after the other, so that all sums run over whole blocks. A sigmoid
    is 1 / (1 + exp(-a)), which is 0 where the exponential is beyond all
    numbers; its sign is in U. Rows of E are fetched for a step at a time.
    """
    steps, lanes = x.shape
    kind = p["U"].dtype
    weights = by_gate(p["U"]) * np.array([-1, -1, 1], kind)[:, None, None]
    table, at, begins = p["E"].reshape(-1, HIDDEN), 3 * x[:, None].astype(np.int64) + np.arange(3)[:, None], start.any(1).tolist()
    out, kept, g = np.empty((steps, lanes, HIDDEN), kind), steps if keep else 1, np.empty((3, lanes, HIDDEN), kind)
    us, rzs, news = np.empty((3, kept, lanes, HIDDEN), kind), np.empty((2, kept, lanes, HIDDEN), kind), np.empty((kept, lanes, HIDDEN), kind)
    with np.errstate(over="ignore"):
        for t in range(steps):
            u, rz, n, o = us[:, t % kept], rzs[:, t % kept], news[t % kept], out[t]
            if begins[t]:
                h = np.where(start[t][:, None], h.dtype.type(0), h)
            table.take(at[t], 0, out=g, mode="clip")
            np.matmul(h, weights, out=u)
            np.subtract(u[:2], g[:2], out=rz)
            np.exp(rz, out=rz)
            rz += 1.0
            np.reciprocal(rz, out=rz)
            np.multiply(rz[0], u[2], out=n)
            n += g[2]
            np.tanh(n, out=n)
            np.subtract(h, n, out=o)
            o *= rz[1]
            o += n
            h = o
    return (out, h, (us, rzs, news)) if keep else (out, h)


def by_gate(a: np.ndarray) -> np.ndarray:
    """(3, HIDDEN, HIDDEN): the weights of each gate."""
    return np.ascontiguousarray(a.reshape(HIDDEN, 3, HIDDEN).transpose(1, 0, 2))


def by_class(y: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(order of the targets by class, (class, from, to) in that order for the classes whose words have outputs)."""
    cls = np.where(y < WORDS, y // EACH, CLASSES)
    order = np.argsort(cls.astype(np.int16), kind="stable")
    ends = np.searchsorted(cls[order], np.arange(CLASSES + 1)).tolist()
    return order, [(k, ends[k], ends[k + 1]) for k in range(CLASSES) if ends[k] < ends[k + 1]]


def shifted(a: np.ndarray, bias: np.ndarray, small: bool | None = None) -> np.ndarray:
    """The factors by which exp(a) is to be multiplied for exp(a + bias): those of the bias, or, where that might leave the range of numbers, ones, and ``a`` has the bias and its largest value is 0."""
    if (max(a.max(), -a.min()) + np.abs(bias).max() < MODERATE) if small is None else small:
        return np.exp(bias)
    a += bias
    a -= a.max(1, keepdims=True)
    return np.ones_like(bias)


def moderate(p: dict) -> list[bool]:
    """For which classes no state, which is within -1 and 1, gives outputs of MODERATE size or more."""
    return (np.abs(p["Wi"]).sum(1).max(1) + np.abs(p["bi"]).max(1) < MODERATE).tolist()


def target_logs(p: dict, h: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural log probability of each target: of its class, and of the word within the class where it has an output of its own."""
    cls, every = np.where(y < WORDS, y // EACH, CLASSES + y - WORDS), np.arange(len(y))
    if not len(y):
        return np.zeros(0, h.dtype)
    out = np.empty(len(y), h.dtype)
    for i in range(0, len(y), BLOCK):
        a, k, o = h[i : i + BLOCK] @ p["Wc"], cls[i : i + BLOCK], out[i : i + BLOCK]
        factor = shifted(a, p["bc"])
        np.add(a[every[: len(k)], k], np.log(factor)[k], out=o)
        o -= np.log(np.exp(a, out=a) @ factor)
    order, parts = by_class(y)
    n, small = parts[-1][2] if parts else 0, moderate(p)
    hs, ys, inner, total = h[order[:n]], y[order[:n]], np.zeros(n, out.dtype), np.ones(n, out.dtype)
    for k, i, j in parts:
        b = hs[i:j] @ p["Wi"][k]
        factor = shifted(b, p["bi"][k], small[k])
        at = ys[i:j] - k * EACH
        inner[i:j] = b[every[: j - i], at]
        if small[k]:
            inner[i:j] += p["bi"][k][at]
        np.dot(np.exp(b, out=b), factor, out=total[i:j])
    out[order[:n]] += inner - np.log(total)
    return out


def gradients(p: dict, x: np.ndarray, y: np.ndarray, start: np.ndarray, h: np.ndarray):
    """Mean loss gradients of a window, backpropagated to its first input and no further, and the state after it; that of E as (rows, values).

    A softmax is exp(a) times the factors of its bias over their sum; factors
    and sums are multiplied into the small sides of the products. Where a is
    exp(a), that of a target is reduced by sum / factor, which takes 1 from
    its probability.
    """
    states, last, (us, rzs, new) = run_window(p, x, start, h, keep=True)
    flat, yy = states.reshape(-1, HIDDEN), y.ravel()
    n = len(yy)
    scale, every = flat.dtype.type(1 / n), np.arange(n)
    cls, d, some = np.where(yy < WORDS, yy // EACH, CLASSES + yy - WORDS), np.empty_like(flat), np.empty((BLOCK, CLASSES + TAILS), flat.dtype)
    g = {k: np.zeros_like(p[k]) for k in ("Wc", "bc", "Wi", "bi")}
    for i in range(0, n, BLOCK):
        f, at, ds = flat[i : i + BLOCK], cls[i : i + BLOCK], d[i : i + BLOCK]
        a = np.dot(f, p["Wc"], out=some[: len(f)])
        factor = shifted(a, p["bc"])
        total = np.exp(a, out=a) @ factor
        a[every[: len(f)], at] -= total / factor[at]
        share = scale / total
        g["Wc"] += ((f * share[:, None]).T @ a) * factor
        g["bc"] += (share @ a) * factor
        np.dot(a, (p["Wc"] * factor).T, out=ds)
        ds *= share[:, None]
    order, classes = by_class(yy)
    m, small = classes[-1][2] if classes else 0, moderate(p)
    order = order[:m]
    fs, ats, ds = flat[order], yy[order] % EACH, np.empty((m, HIDDEN), flat.dtype)
    shares, totals, factors = np.empty(m, flat.dtype), np.empty(m, flat.dtype), np.exp(p["bi"])
    back = np.ascontiguousarray((p["Wi"] * factors[:, None]).transpose(0, 2, 1))
    for k, i, j in classes:
        f, w, factor, at, total = fs[i:j], back[k], factors[k], ats[i:j], totals[i:j]
        b = f @ p["Wi"][k]
        if not small[k]:
            factors[k] = shifted(b, p["bi"][k])
            w = (p["Wi"][k] * factor).T
        np.dot(np.exp(b, out=b), factor, out=total)
        b[every[: j - i], at] -= total / factor[at]
        share = np.divide(scale, total, out=shares[i:j])
        np.dot(b, w, out=ds[i:j])
        np.dot((f * share[:, None]).T, b, out=g["Wi"][k])
        np.dot(share, b, out=g["bi"][k])
    g["Wi"] *= factors[:, None]
    g["bi"] *= factors
    ds *= shares[:, None]
    d[order] += ds
    d, (r, z), un = d.reshape(states.shape), rzs, us[2]
    before = np.concatenate([h[None], states[:-1]])
    before[start] = 0
    # what a step's state has of the gradients of its three gates' sums; each is multiplied by the state's own on the way back
    gates, rest = np.empty((3, *states.shape), flat.dtype), 1 - z
    np.subtract(before, new, out=gates[1])
    gates[1] *= z
    gates[1] *= rest
    new *= new
    rest *= np.subtract(1, new, out=new)
    np.multiply(rest, r, out=gates[2])
    np.multiply(gates[2], un, out=gates[0])
    gates[0] *= np.subtract(1, r, out=r)
    back, begins, dh = np.ascontiguousarray(by_gate(p["U"]).transpose(0, 2, 1)), start.any(1).tolist(), np.zeros_like(h)
    three = np.empty((3, *h.shape), flat.dtype)
    for t in reversed(range(len(x))):
        dt, own = d[t], gates[:, t]
        dt += dh
        own *= dt
        np.matmul(own, back, out=three)
        np.multiply(dt, z[t], out=dh)
        for a in three:
            dh += a
        if begins[t]:
            dh[start[t]] = 0
    flat, each = before.reshape(-1, HIDDEN).T, gates.reshape(3, -1, HIDDEN)
    g["U"] = np.concatenate([flat @ a for a in each], axis=1)
    np.multiply(d, rest, out=gates[2])
    g["E"] = sums_by_id(x.ravel(), each)
    return g, last


def sums_by_id(ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct ids, sums of values (3, n, HIDDEN) by id, side by side): ids that come equally often are summed together, as one block."""
    count = np.bincount(ids)
    rows = np.flatnonzero(count)
    rows = rows[np.argsort(count[rows], kind="stable")]
    rank = np.empty(len(count), np.int16)  # which numpy sorts by digits
    rank[rows] = np.arange(len(rows))
    order = np.argsort(rank[ids], kind="stable")
    ordered = np.empty((len(ids), 3, HIDDEN), values.dtype)
    for k, a in enumerate(values):
        ordered[:, k] = a.take(order, 0)
    ordered, out, at = ordered.reshape(len(ids), -1), np.empty((len(rows), 3 * HIDDEN), values.dtype), 0
    often, first = np.unique(count[rows], return_index=True)
    for c, i, j in zip(often.tolist(), first.tolist(), [*first[1:].tolist(), len(rows)], strict=True):
        to = at + c * (j - i)
        np.add.reduce(ordered[at:to].reshape(j - i, c, -1), axis=1, out=out[i:j])
        at = to
    return rows, out


def lanes(lengths: list[int], n: int) -> list[list[int]]:
    """Texts dealt to n lanes, the longest first to the shortest lane; the longest lane comes first."""
    import heapq

    heap, out = [(0, k) for k in range(n)], [[] for _ in range(n)]
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        size, k = heapq.heappop(heap)
        out[k].append(i)
        heapq.heappush(heap, (size + lengths[i], k))
    return sorted((o for o in out if o), key=lambda o: -sum(lengths[i] for i in o))


def grid(texts: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(targets, text numbers, lane lengths): a column for each lane; beyond a lane's end the text number is -1."""
    dealt = lanes([len(t) for t in texts], n)
    size = np.array([sum(len(texts[i]) for i in o) for o in dealt])
    y, doc = np.zeros((size[0], len(dealt)), np.int32), np.full((size[0], len(dealt)), -1, np.int32)
    for k, o in enumerate(dealt):
        y[: size[k], k] = np.concatenate([texts[i] for i in o])
        doc[: size[k], k] = np.repeat(o, [len(texts[i]) for i in o])
    return y, doc, size


def inputs(y: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each target's input is the target before it; a text's first input is the end (id 0) with an empty state."""
    start = np.ones(y.shape, bool)
    start[1:] = doc[1:] != doc[:-1]
    x = np.zeros_like(y)
    x[1:] = y[:-1]
    x[start] = 0
    return x, start


def train_shard(p: dict, texts: list[np.ndarray], rate: float, epochs: int = 1, window: int = 32, width: int = 128, longest: int = 1024) -> dict:
    """Adam over the shard's texts in ``width`` lanes, ``window`` steps at a time, the state carried on; lanes that have ended are dropped.

    Texts of over ``longest`` words are cut, so that the lanes end together;
    all parts are trained on. Rows of E move with the windows that use them.
    """
    p = {k: v.copy() for k, v in p.items()}
    if not texts:
        return p
    texts = [t[at : at + longest] for t in texts for at in range(0, len(t), longest)]
    y, doc, size = grid(texts, width)
    x, start = inputs(y, doc)
    ends = sorted({*size.tolist(), *range(0, len(y), window)})  # a window has the same lanes throughout
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    total = epochs * len(ends)
    for _ in range(epochs):
        h = np.zeros((y.shape[1], HIDDEN), np.float32)
        for at, to in zip(ends, ends[1:], strict=False):
            n = int((size > at).sum())
            g, h = gradients(p, x[at:to, :n], y[at:to, :n], start[at:to, :n], h[:n])
            step += 1
            norm = float(np.sqrt(sum(float(np.vdot(a, a)) for a in (b[1] if k == "E" else b for k, b in g.items()))))
            shrink = np.float32(min(1.0, 1.0 / (norm + 1e-9)))
            lr = np.float32(rate * (1 - 0.9 * step / total) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step))
            for k, a in g.items():
                rows, a = a if k == "E" else (None, a)
                a *= shrink  # a window's own arrays
                mk, vk = (b[k] if rows is None else b[k].take(rows, 0) for b in (m, v))
                mk *= np.float32(0.9)
                vk *= np.float32(0.999)
                move = a * a
                move *= np.float32(0.001)
                vk += move
                a *= np.float32(0.1)
                mk += a
                np.sqrt(vk, out=move)
                move += np.float32(1e-7)
                np.divide(mk, move, out=move)
                move *= lr
                if rows is None:
                    p[k] -= move
                else:
                    m[k][rows], v[k][rows], p[k][rows] = mk, vk, np.subtract(p[k].take(rows, 0), move, out=move)
    return p


def pack(p: dict) -> bytes:
    return b"".join(p[k].astype("<f4").tobytes() for k in SHAPES)


def unpack(data: bytes) -> dict:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = np.frombuffer(data, "<f4", n, at).reshape(s).copy()
        at += 4 * n
    return out


def token_ids(lex: Lexicon, known: dict[bytes, int], texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(distinct words, their places in the head or -1, place of each word among them, number of words of each text, model ids of each text with its end)."""
    distinct, at, size = coded(texts)
    head = np.fromiter(map(known.get, distinct, repeat(-1)), np.int64, len(distinct))
    model = lex.model_id[head].astype(np.int32)
    far = np.flatnonzero(head < 0)
    model[far] = [WORDS + tail_class(distinct[i]) for i in far]
    ids = np.zeros(len(at) + len(size), np.int32)  # ends are 0
    ids[np.arange(len(at)) + np.repeat(np.arange(len(size)), size)] = model[at]
    return distinct, head, at, size, np.split(ids, np.cumsum(size + 1)[:-1])


_KNOWN: list = []


def places(shared) -> tuple[Lexicon, dict[bytes, int]]:
    """The broadcast lexicon and its dictionary, made once in a worker process."""
    lex = shared.value
    if not _KNOWN or _KNOWN[0] is not lex:
        _KNOWN[:] = [lex, {t: i for i, t in enumerate(lex.tokens)}]
    return lex, _KNOWN[1]


def fit(docs: DataFrame, lex: Lexicon, shared, learn: Column, id_col: str, text_col: str, shard_tokens: int, rounds: int, seed: int) -> dict:
    """Parallel stochastic gradient descent over all training texts: in each round every shard trains on its part of them from the mean of the round before.

    Every training text takes part once. Texts are dealt by a hash of id and
    text to rounds and, within a round, to shards of about ``shard_tokens`` of
    all rounds together, so that the number of shards grows with the corpus. A
    shard is a task; models are averaged by groups of 16 until 16 are left.
    """
    p = fresh(lex, seed)
    if not lex.total:
        return p
    shards = max(1, round(lex.total / shard_tokens))
    h = F.xxhash64(column(id_col), text(text_col), F.lit(seed))
    key = F.xxhash64(h)
    rows = docs.where(learn).select(F.pmod(key, F.lit(shards)).alias("shard"), F.pmod(F.shiftright(key, 40), F.lit(rounds)).cast("int").alias("turn"), text(text_col).alias("_text"))
    spark = docs.sparkSession
    for turn in range(rounds):
        given = spark.sparkContext.broadcast(pack(p))

        def learn_shard(table: pa.Table) -> pa.Table:
            one_thread()
            lex, known = places(shared)
            texts = [ids for part in table.sort_by("_text").column("_text").chunks for ids in token_ids(lex, known, part)[4]]
            got = train_shard(unpack(given.value), texts, 0.01)
            return pa.table({"shard": table.column("shard")[:1].combine_chunks(), "weight": pa.array([float(sum(map(len, texts)))]), "model": pa.array([pack(got)], pa.binary())})

        def mean(table: pa.Table) -> pa.Table:
            w, total = table.column("weight").to_pylist(), None
            for weight, m in zip(w, table.column("model"), strict=True):
                a = np.frombuffer(m.as_py(), "<f4") * np.float32(weight / sum(w))
                total = a if total is None else total + a
            return pa.table({"shard": table.column("shard")[:1].combine_chunks(), "weight": pa.array([sum(w)]), "model": pa.array([total.astype("<f4").tobytes()], pa.binary())})

        schema = "shard long, weight double, model binary"
        models, left = rows.where(F.col("turn") == turn).select("shard", "_text").groupBy("shard").applyInArrow(learn_shard, schema), shards
        while left > 16:
            models = durable(models.withColumn("shard", F.floor(F.col("shard") / 16))).groupBy("shard").applyInArrow(mean, schema)
            left = -(-left // 16)
        got = models.collect()
        given.unpersist()
        if got:
            total = sum(r["weight"] for r in got)
            p = unpack(sum(np.frombuffer(bytes(r["model"]), "<f4") * np.float32(r["weight"] / total) for r in got).astype("<f4").tobytes())
    return p


def score_texts(p: dict, texts: list[np.ndarray], width: int = 256, window: int = 64) -> np.ndarray:
    """Sum of the natural logs of each text's targets; lanes that have ended are dropped, and where few are left more steps are taken at a time."""
    y, doc, size = grid(texts, width)
    x, start = inputs(y, doc)
    total = np.zeros(len(texts))
    h = np.zeros((y.shape[1], HIDDEN), np.float32)
    at = 0
    while at < len(y):
        n = int((size > at).sum())  # lanes are sorted by length
        part = slice(at, at := at + min(max(window, width * window // 2 // n), 16 * window))
        states, h = run_window(p, x[part, :n], start[part, :n], h[:n])
        real = doc[part, :n] >= 0
        logs = target_logs(p, states[real], y[part, :n][real])
        total += np.bincount(doc[part, :n][real], weights=logs, minlength=len(texts))
    return total


def lm_scores(
    docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", head: int = 1 << 18,
    shard_tokens: int = 4_000_000, rounds: int = 2, batch_bytes: int = 1 << 23, seed: int = 5,
) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for every row; ``learn`` says which rows the counts and the model learn from.

    score is the model's log10 probability of the whole text and its end. A
    word is given by its class and its place in the class, or, beyond the
    ``WORDS`` commonest, by its ending's class and its share among the
    training words of that class, where one more stands for all unseen ones.
    Counts of all words are kept, and the model trains on every text of
    ``learn`` once. The ``head`` commonest of at most 64 bytes
    (thus 16 MB) are broadcast; the counts of others are joined by word, where
    none is frequent.

    Null and empty texts are an end alone; a null id is kept; repeated rows
    give repeated results; an empty table gives an empty result; without a row
    to learn from the model is at its random start; other columns are not
    read.
    """
    spark = docs.sparkSession
    counts = durable(word_counts(docs, learn, text_col))
    lex = lexicon(counts, head)
    shared = spark.sparkContext.broadcast(lex)
    model = spark.sparkContext.broadcast(pack(fit(docs, lex, shared, learn, id_col, text_col, shard_tokens, rounds, seed)))
    names = ["row", "_id", "own", "token", "n", "n_tokens", "n_known", "base", "score"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        lex, known = places(shared)
        p = unpack(model.value)
        base = np.log10(lex.train + 0.5) - lex.log_base
        seen = (lex.train > 0).astype(np.int64)
        for batch in by_bytes(batches, "_text", batch_bytes):
            distinct, head, at, size, texts = token_ids(lex, known, batch.column(2))
            doc, near = np.repeat(np.arange(len(size)), size), head >= 0
            by_text = lambda values: np.bincount(doc, weights=values[at], minlength=len(size))  # noqa: B023, E731
            tail = np.array([0 if n else tail_class(w) for w, n in zip(distinct, near, strict=True)], np.int64)
            base_sum = by_text(np.where(near, base[head], -lex.log_base)) + base[0]
            extra = by_text(np.where(near, lex.extra[head], -lex.tail_log[tail]))
            n_known = by_text(np.where(near, seen[head], 0)).astype(np.int64) + seen[0]
            logs = score_texts(p, texts) / LOG10 + extra
            far = ~near[at]
            pair, n = np.unique(doc[far] * len(distinct) + at[far], return_counts=True)
            row = batch.column(0).to_numpy()
            mine, m = np.zeros(len(pair), np.int64), len(pair)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([row, row[pair // max(len(distinct), 1)]])), pa.concat_arrays([batch.column(1), pa.nulls(m, batch.column(1).type)]), pa.array([True] * len(row) + [False] * m),
                pa.array([*(str(r).encode() for r in row.tolist()), *(distinct[i] for i in (pair % max(len(distinct), 1)).tolist())], pa.binary()), pa.array(np.concatenate([np.zeros(len(row), np.int64), n])),
                pa.array(np.concatenate([size + 1, mine])), pa.array(np.concatenate([n_known, mine])), pa.array(np.concatenate([base_sum, mine])), pa.array(np.concatenate([logs, mine])),
            ], names)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), column(id_col).alias("_id"), text(text_col).alias("_text"))
    scored = rows.mapInArrow(score, f"row long, _id {kind}, own boolean, token binary, n long, n_tokens long, n_known long, base double, score double")
    # a text's own row has a token of its own, matches nothing, and is dealt evenly
    known = scored.join(counts.select("token", F.lit(False).alias("own"), "train"), ["token", "own"], "left")
    c = F.coalesce("train", F.lit(0))
    far = F.sum(F.col("n") * F.log10(c + 0.5))
    total = known.groupBy("row").agg(
        F.max("_id").alias(id_col), F.sum("n_tokens").alias("n_tokens"), (F.sum("n_known") + F.sum(F.when(c > 0, F.col("n")).otherwise(0))).alias("n_known"),
        F.lit(lex.total).cast("long").alias("train_tokens"), (F.sum("base") + far).alias("base_score"), (F.sum("score") + far).alias("score"),
    )
    return total.drop("row")
